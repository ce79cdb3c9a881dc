"""Held-out evaluation passages inside a training corpus.

Method: spaced-seed hashing. A seed looks at a window of consecutive words through a fixed
mask and ignores the positions the mask leaves out, so a changed word at such a place does
not lose the hit. Seeds of the items and of the corpus are joined on their hash; around
each hit the overlap is extended along its diagonal, substitutions tolerated, and its
longest exact run measured. Words are compared after NFKC, case folding and the removal of
invisible characters; punctuation, spacing and line breaks do not count.

The items' seeds are broadcast only up to SEED_BOUND; beyond it the seeds are joined by a
shuffle. Any run of 12 equal words (or a whole shorter item) fills every window of its span
and is therefore found. Null and empty texts have no words and never match; duplicate rows
and copies of an item under another id are reported each.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlight.llm import bits
from cairnlight.session import spread, stored

RUN = 12
MASKS = ("110111011011", "111010110111")  # windows of RUN words; the zeros are ignored
SHORT = "11011101101"  # its first letters, closed by a 1, for items of fewer words
SEED_BOUND = 4_000_000  # seeds that may be broadcast (16 bytes each)
_INVISIBLE = regex.compile(r"\p{Cf}+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_MULTIPLIERS = np.random.default_rng(12).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def words(text: str | None) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).casefold()) if text else []


@functools.lru_cache(maxsize=200_000)
def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def hashed(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_hash, tokens), np.uint64, len(tokens))


def masks_for(size: int) -> tuple[str, ...]:
    """The masks under which an item of `size` words is indexed."""
    if size >= RUN:
        return MASKS
    return (SHORT[: size - 1] + "1",) if size else ()


def seeds(codes: np.ndarray, mask: str) -> np.ndarray:
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, len(mask) * 1_000_003 + int(mask, 2), np.uint64)
    for p, c in enumerate(mask):
        if c == "1":
            out += codes[p : p + n] * _MULTIPLIERS[p]
    return out


class Overlap(NamedTuple):
    start: int  # in the document's words
    words: int
    substituted: int
    longest_run: int


def verify(item: np.ndarray, doc: np.ndarray, diagonal: int) -> Overlap:
    """The overlap on one diagonal (document place - item place): the stretch between the first
    and the last of its matching runs that no gap of more than 2 words parts; of several the longest."""
    lo, hi = max(0, diagonal), min(len(doc), diagonal + len(item))
    same = doc[lo:hi] == item[lo - diagonal : hi - diagonal]
    at = np.flatnonzero(same)
    best = Overlap(lo, 0, 0, 0)
    for part in np.split(at, np.flatnonzero(np.diff(at) > 3) + 1):
        if len(part):
            runs = np.split(part, np.flatnonzero(np.diff(part) > 1) + 1)
            size = int(part[-1] - part[0]) + 1
            best = max(best, Overlap(lo + int(part[0]), size, size - len(part), max(map(len, runs))), key=lambda o: (o.longest_run, o.words))
    return best


class Index:
    """The seeds of a bounded set of items, sorted for search."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.items = items
        by_mask: dict[str, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for k, (_, codes) in enumerate(items):
            for m in masks_for(len(codes)):
                by_mask[m].append((seeds(codes, m), k))
        self.tables = {}
        for m, parts in by_mask.items():
            h = np.concatenate([s for s, _ in parts])
            owner = np.concatenate([np.full(len(s), k, np.int64) for s, k in parts])
            place = np.concatenate([np.arange(len(s)) for s, _ in parts])
            order = np.argsort(h, kind="stable")
            self.tables[m] = (h[order], owner[order], place[order])

    def hits(self, codes: np.ndarray) -> set[tuple[int, int]]:
        """(item, diagonal) pairs that share a seed with the words."""
        out = set()
        for m, (h, owner, place) in self.tables.items():
            s = seeds(codes, m)
            if len(s):
                a, b = np.searchsorted(h, s, "left"), np.searchsorted(h, s, "right")
                for i in np.flatnonzero(a < b):
                    out.update((int(owner[k]), int(i - place[k])) for k in range(a[i], b[i]))
        return out


def seed_count(sizes: list[int]) -> int:
    return sum(len(masks_for(n)) * (n - len(masks_for(n)[0]) + 1) for n in sizes if n)


_SCHEMA = "words int, substituted int, longest_run int, item_words int"


def overlaps(items: DataFrame, item_key: str, item_text: str, docs: DataFrame, doc_key: str, doc_text: str, seed_bound: int = SEED_BOUND) -> DataFrame:
    """(item_key, doc_key, words, substituted, longest_run, item_words): the best overlap of every
    item and document that share a seed."""
    ik, dk = items.schema[item_key].dataType.simpleString(), docs.schema[doc_key].dataType.simpleString()
    texts = docs.select(F.col(doc_key), F.col(doc_text)).where(F.col(doc_text).isNotNull() & F.col(doc_key).isNotNull())
    held = items.select(F.col(item_key), F.col(item_text)).where(F.col(item_text).isNotNull() & F.col(item_key).isNotNull())
    # at most one word in two characters and two seeds a word: the bound holds before anything is fetched
    size = held.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()[0]
    if size > seed_bound:
        return _joined(held, item_key, item_text, ik, texts, doc_key, doc_text, dk)
    listed = [(r[0], hashed(words(r[1]))) for r in held.toLocalIterator()]
    index = items.sparkSession.sparkContext.broadcast(Index([x for x in listed if len(x[1])]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = index.value
        for f in frames:
            rows = []
            for key, text in zip(f.iloc[:, 0], f.iloc[:, 1]):
                codes = hashed(words(text))
                best: dict[int, Overlap] = {}
                for k, diagonal in known.hits(codes):
                    o = verify(known.items[k][1], codes, diagonal)
                    if k not in best or (o.longest_run, o.words) > (best[k].longest_run, best[k].words):
                        best[k] = o
                rows += [(known.items[k][0], key, o.words, o.substituted, o.longest_run, len(known.items[k][1])) for k, o in best.items()]
            yield pd.DataFrame(rows, columns=[item_key, doc_key, "words", "substituted", "longest_run", "item_words"])

    return spread(texts).mapInPandas(run, f"`{item_key}` {ik}, `{doc_key}` {dk}, {_SCHEMA}")


def _joined(items: DataFrame, item_key: str, item_text: str, ik: str, docs: DataFrame, doc_key: str, doc_text: str, dk: str) -> DataFrame:
    """The same result for item sets of any size: item words are hashed once, seeds joined by hash,
    and the candidate pairs verified next to both word lists. Of the corpus only seeds are shuffled whose
    bits are set in a table of the items' seeds; masks that no item has are not looked at."""
    lengths = {n: masks_for(n) for n in range(1, RUN + 1)}

    def emit(key: str, masks, held=None):  # noqa: ANN001, ANN202
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                keys, places, found = [], [], []
                for k, text in zip(f.iloc[:, 0], f.iloc[:, 1]):
                    codes = hashed(words(text))
                    for m in masks_for(len(codes)) if masks is None else masks:
                        h = seeds(codes, m)
                        at = np.arange(len(h)) if held is None else bits.hits(held.value, h)
                        keys += [k] * len(at)
                        places.append(at)
                        found.append(h[at])
                if keys:
                    yield pd.DataFrame({key: keys, "place": np.concatenate(places).astype("int32"), "seed": np.concatenate(found).view(np.int64)})

        return run

    left = stored(items.mapInPandas(emit(item_key, None), f"`{item_key}` {ik}, place int, seed long"), "seeds")

    def sized(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"n": [min(RUN, len(words(t))) for t in f.iloc[:, 0]]})

    used = sorted({m for r in items.select(item_text).mapInPandas(sized, "n int").distinct().collect() for m in lengths.get(r.n, ())})  # RUN lengths at most
    table = items.sparkSession.sparkContext.broadcast(bits.table_of(left.select("seed").distinct(), F.col("seed")))
    left, right = left.alias("i"), spread(docs).mapInPandas(emit(doc_key, used, table), f"`{doc_key}` {dk}, place int, seed long").alias("d")
    pairs = left.join(right, F.col("i.seed") == F.col("d.seed")).select(F.col(f"i.{item_key}").alias("_i"), F.col(f"d.{doc_key}").alias("_d"), (F.col("d.place") - F.col("i.place")).alias("diagonal")).distinct()
    both = pairs.join(items.select(F.col(item_key).alias("_i"), F.col(item_text).alias("_it")), "_i").join(docs.select(F.col(doc_key).alias("_d"), F.col(doc_text).alias("_dt")), "_d")

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, d, it, dt, diagonal in zip(f["_i"], f["_d"], f["_it"], f["_dt"], f["diagonal"]):
                a = hashed(words(it))
                o = verify(a, hashed(words(dt)), int(diagonal))
                rows.append((i, d, o.words, o.substituted, o.longest_run, len(a)))
            yield pd.DataFrame(rows, columns=[item_key, doc_key, "words", "substituted", "longest_run", "item_words"])

    found = both.mapInPandas(check, f"`{item_key}` {ik}, `{doc_key}` {dk}, {_SCHEMA}")
    best = F.max(F.struct("longest_run", "words", "substituted", "item_words")).alias("b")
    return found.groupBy(item_key, doc_key).agg(best).select(item_key, doc_key, "b.words", "b.substituted", "b.longest_run", "b.item_words")


def leaked(found: DataFrame) -> DataFrame:
    """Overlaps that hold the whole item or at least RUN of its words in a row."""
    return found.where(F.col("longest_run") >= F.least(F.lit(RUN), F.col("item_words")))
