"""Exact nearest neighbours by inner product.

Both sides are cut into blocks of a bounded number of vectors; every pair of blocks meets in
one task, is multiplied, and keeps k rows per query, and one window ranks them. The driver
holds no vector. A second path says the same in built-in functions and is its reference in tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlight.functions.vectors import inner_product, l2_normalised
from cairnlight.session import spread

ROWS = 4096  # vectors in a block: what one task multiplies at once, on either side
DIGITS = 6  # scores are ranked as rounded, so that ties break by id on every engine


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """pairs has qid, id, score; adds rank by (score desc, id)."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k_sql(queries: DataFrame, corpus: DataFrame, k: int, keep_self: bool = False) -> DataFrame:
    """queries (qid, v), corpus (id, v): all pairs inside the JVM, the reference for small sides; the planner chooses the join."""
    q = queries.where("v is not null").select("qid", l2_normalised(F.col("v")).alias("qv"))
    c = corpus.where("v is not null").select("id", l2_normalised(F.col("v")).alias("cv"))
    pairs = c.join(q, F.lit(True) if keep_self else F.col("id") != F.col("qid")).select("qid", "id", F.round(inner_product("qv", "cv"), DIGITS).alias("score"))
    return ranked(pairs, k)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=m.copy(), where=norm > 0)


def _packed(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Blocks of at most `rows` vectors as one row: their keys and the bytes of their unit matrix."""
    for f in frames:
        for i in range(0, len(f), rows):
            part = f.iloc[i : i + rows]
            m = _unit(np.stack(part.iloc[:, 1]).astype(np.float64))
            yield pd.DataFrame({"keys": [part.iloc[:, 0].tolist()], "n": [len(part)], "m": [m.tobytes()]})


def top_k(queries: DataFrame, corpus: DataFrame, k: int, keep_self: bool = False, rows: int = ROWS) -> DataFrame:
    """(qid, id, score, rank): the k nearest of every query.

    Blocks of queries are sent to the partitions of the corpus blocks by a join on a small number of
    parts: the corpus is cut into parts, every query block goes to each of them. Null vectors are left
    out; fewer than k vectors give fewer rows; an empty side gives none.
    """
    kinds = queries.schema["qid"].dataType.simpleString(), corpus.schema["id"].dataType.simpleString()
    parts = max(1, corpus.sparkSession.sparkContext.defaultParallelism)

    def blocks(df: DataFrame, key: str, kind: str) -> DataFrame:
        v = df.select(key, F.col("v").cast("array<double>").alias("v")).where("v is not null")
        return spread(v).mapInPandas(lambda frames: _packed(frames, rows), f"keys array<{kind}>, n int, m binary")

    q = blocks(queries, "qid", kinds[0]).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    c = blocks(corpus, "id", kinds[1]).withColumn("part", F.pmod(F.xxhash64("m"), F.lit(parts)).cast("int"))
    met = c.select("part", "keys", F.col("m").alias("m")).join(q.select("part", F.col("keys").alias("qkeys"), F.col("m").alias("qm")), "part")

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for own, m, ids, qm in zip(f["keys"], f["m"], f["qkeys"], f["qm"]):
                own, ids = np.asarray(own), np.asarray(ids)
                scores = np.frombuffer(qm).reshape(len(ids), -1) @ np.frombuffer(m).reshape(len(own), -1).T
                if not keep_self:
                    scores[ids[:, None] == own[None, :]] = -np.inf
                n = min(len(own), k)
                # all that the window may rank among the k: ties and what rounding makes equal stay
                edge = np.partition(scores, len(own) - n, axis=1)[:, len(own) - n] - 2 * 10.0**-DIGITS
                i, j = np.nonzero((scores >= edge[:, None]) & np.isfinite(scores))
                yield pd.DataFrame({"qid": ids[i], "id": own[j], "score": scores[i, j]})

    found = met.select("keys", "m", "qkeys", "qm").mapInPandas(nearest, f"qid {kinds[0]}, id {kinds[1]}, score double")
    return ranked(found.withColumn("score", F.round("score", DIGITS)), k)
