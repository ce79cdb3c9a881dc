"""Cutting oversized texts at natural boundaries.

Method: recursive bisection. A span longer than limit - overlap is cut at the strongest
boundary near its midpoint (paragraph, line, sentence, clause, word), both halves are
treated alike, and at last every piece is extended to the left by up to `overlap`
characters, starting at a word where it can. A run without whitespace stays whole up to
`limit`; a longer one is cut hard. The spans before the overlap tile the text, so nothing
is lost. Lengths count code points.

Null, empty and short texts: no rows from oversized(), one piece (none for null or empty)
from split_texts().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlight.session import spread

LIMIT, OVERLAP = 500, 50
# A boundary lies behind each match; the strengths order the kinds.
_GAPS = re.compile(r"\s+")
_SENTENCE, _CLAUSE = frozenset(".!?。！？…"), frozenset(",;:)]、，；")


def _boundaries(text: str, room: int) -> tuple[list[int], list[int]]:
    """Places to cut at (behind, before and, in long stretches, within whitespace) and their strengths."""
    places, power, last = [], [], 0
    for m in _GAPS.finditer(text):
        a, b, gap = m.start(), m.end(), m.group()
        before = text[a - 1] if a else ""
        lines = gap.count("\n")
        s = 5 if lines > 1 else 4 if before in _SENTENCE and before else 3 if lines else 2 if before in _CLAUSE and before else 1
        # before the gap as well where it is wide or behind a long run, which stays whole up to the limit without it
        if b - a > 1 or a - last >= room:
            inner = [a] * (a > 0) + list(range(a + max(1, room // 2), b, max(1, room // 2)))
            places += inner
            power += [0] * len(inner)
        last = b
        if 0 < b < len(text):
            places.append(b)
            power.append(s)
    return places, power


def split_spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start, core, end, cut): the piece is text[start:end], text[core:end] is new in it.

    cut says how the piece's core begins: 'start', 'natural' or 'hard' (inside a run of more
    than `limit` characters without whitespace).
    """
    if not text:
        return []
    if len(text) <= limit:
        return [(0, 0, len(text), "start")]
    from bisect import bisect_left, bisect_right

    room = max(1, limit - overlap)
    places, power = _boundaries(text, room)
    cores: list[tuple[int, int, str]] = []
    todo = [(0, len(text), "start")]
    while todo:
        a, b, how = todo.pop()
        if b - a <= room:
            cores.append((a, b, how))
            continue
        mid, cut, kind = (a + b) // 2, -1, "natural"
        for near in ((b - a) // 4, b - a):  # the middle half first, then anywhere inside
            lo, hi = bisect_right(places, max(a, mid - near)), bisect_left(places, min(b, mid + near))
            if lo < hi:
                cut = places[max(range(lo, hi), key=lambda k: (power[k] - 2 * abs(places[k] - mid) / (b - a), -places[k]))]
                break
        if cut < 0 and b - a <= limit:
            cores.append((a, b, how))
            continue
        if cut < 0:
            cut, kind = mid, "hard"
        todo += [(cut, b, kind), (a, cut, how)]
    out = []
    for a, b, how in cores:
        left = max(0, a - min(overlap, limit - (b - a))) if a else 0
        if how == "natural" and left < a:  # begin the overlap with a whole word
            k = bisect_left(places, left)
            while k < len(places) and places[k] < a and text[places[k]].isspace():
                k += 1
            left = places[k] if k < len(places) and places[k] <= a else a
        out.append((left, a, b, how))
    return out


def split_texts(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, start, core, end, cut, piece) of every text; one row per piece.

    Ties between equal boundaries go to the earlier place; duplicate rows are split each.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys, no, start, core, end, cut, piece = [], [], [], [], [], [], []
            for k, t in zip(f.iloc[:, 0], f.iloc[:, 1]):
                if t is None:
                    continue
                for i, (s, c, e, how) in enumerate(split_spans(t, limit, overlap)):
                    keys.append(k)
                    no.append(i)
                    start.append(s)
                    core.append(c)
                    end.append(e)
                    cut.append(how)
                    piece.append(t[s:e])
            yield pd.DataFrame({key: pd.Series(keys, dtype=f.dtypes.iloc[0]), "piece_no": pd.Series(no, dtype="int32"), "start": pd.Series(start, dtype="int32"), "core": pd.Series(core, dtype="int32"), "end": pd.Series(end, dtype="int32"), "cut": pd.Series(cut, dtype=object), "piece": pd.Series(piece, dtype=object)})

    src = spread(df.select(F.col(key), F.col(text)).where(F.col(text).isNotNull() & F.col(key).isNotNull()))
    return src.mapInPandas(run, f"`{key}` {kind}, piece_no int, start int, core int, end int, cut string, piece string")


def oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, cut) of the texts over the limit: 'hard' where a piece had to begin inside a word run."""
    long = df.where(F.length(text) > limit)  # before Python sees a row
    pieces = split_texts(long, key, text, limit, overlap)
    return pieces.groupBy(key).agg(F.when(F.max(F.col("cut") == "hard"), "hard").otherwise("natural").alias("cut"))
