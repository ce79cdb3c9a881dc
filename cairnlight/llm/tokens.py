"""Encoding a corpus with a public byte-level BPE vocabulary.

Method: prefix dynamic programming. For every prefix of a piece the table keeps the one
token that ends the valid encoding of that prefix. A token t may end prefix i if the
prefix before it is encoded with last token s and the pair (s, t) is what merging yields
for their joined bytes. The table makes appends exact (it only grows) and edits local
(positions behind the edit are reused once they agree again over a token's length).

Null and empty texts give the empty list; every other text is encoded as it stands,
strings that look like special tokens included.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlight.session import spread

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the published pre-splitting pattern of the vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_LIMIT = 200_000  # distinct pieces and pairs kept per worker, to bound its memory


class PrefixTable:
    """The last valid token of every prefix of one piece of bytes."""

    def __init__(self, bpe: Bpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        """Extend the piece; the encodings of all earlier prefixes stay as they are."""
        start = len(self.data)
        self.data += more
        self.last += [-1] * len(more)
        self._fill(start, None)
        return self

    def replace(self, start: int, end: int, new: bytes) -> PrefixTable:
        """Put new in the place of data[start:end]; recompute only until the table agrees again."""
        old, shift, tail = self.last, len(new) - (end - start), len(self.data) - end
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1] + [-1] * (len(new) + tail)
        self._fill(start, (old, shift, start + len(new)))
        return self

    def _fill(self, start: int, known: tuple[list[int], int, int] | None) -> None:
        longest, last, size, valid = self.bpe.longest, self.last, self.bpe.size, self.bpe.valid
        lead = max(0, start - longest)
        agreed, done = 0, start
        for end, rank in self.bpe.matches(self.data, lead):
            i = end + 1
            if i <= start:
                continue
            if known and i != done and done > known[2]:
                agreed = agreed + 1 if last[done] == known[0][done - known[1]] else 0
                if agreed >= longest:
                    last[done + 1 :] = known[0][done + 1 - known[1] :]
                    return
            done = i
            j = i - size[rank]
            if j == 0 or (last[j] >= 0 and valid(last[j], rank)):
                last[i] = rank

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= self.bpe.size[self.last[i]]
        out.reverse()
        return out


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PIECES):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.bytes = {r: b for b, r in ranks.items()}
        self.size = {r: len(b) for b, r in ranks.items()}
        self.longest = max(self.size.values())
        self.auto = ahocorasick.Automaton()
        for b, r in ranks.items():
            if len(b) == 1 or self.merge(b) == [r]:  # tokens that merging never yields can't occur
                self.auto.add_word(b.decode("latin-1"), r)
        self.auto.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, list[int]] = {}

    def matches(self, data: bytes, start: int) -> Iterator[tuple[int, int]]:
        return self.auto.iter(data.decode("latin-1"), start)

    def merge(self, data: bytes) -> list[int]:
        """Plain merging by rank: the definition that pairs are held against."""
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.ranks.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def valid(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > CACHE_LIMIT:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def piece(self, piece: str) -> list[int]:
        got = self.cache.get(piece)
        if got is None:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            got = [whole] if whole is not None else PrefixTable(self, data).ids()
            if len(piece) <= 64:
                if len(self.cache) > CACHE_LIMIT:
                    self.cache.clear()
                self.cache[piece] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for m in self.split.finditer(text or ""):
            out += self.piece(m.group())
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Bpe:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return Bpe({base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())})


def encode_corpus(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) for every row of df: no shuffle, whole texts, one Arrow pass.

    Null and empty texts give []; duplicate rows give duplicate rows; other columns of df
    (whatever their names) are not read.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(name, folder)
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for t in batch.column(1).to_pylist():
                flat += bpe.encode(t)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    src = spread(df.select(F.col(key), F.col(text)))
    return src.mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")
