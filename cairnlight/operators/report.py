"""Run reports: newest runs, summaries, deltas, grids, gaps and enumerated order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_run(rows: DataFrame, keys: list[str], run: str = "run_id") -> DataFrame:
    """All rows of the lexicographically newest run of every key. Keys may be null; the newest
    runs are aggregated first and joined back, so a frequent key is never sorted in one task."""
    newest = rows.groupBy(*keys).agg(F.max(run).alias("_run"))
    same = [rows[k].eqNullSafe(newest[k]) for k in keys] + [rows[run] == newest["_run"]]
    return rows.join(newest, same, "left_semi")


def without_quarantined(rows: DataFrame, name: str, prefix: str = "summary_FAILED") -> DataFrame:
    return rows.where(~F.col(name).startswith(prefix))


def deltas(summary: DataFrame, keys: list[str], system: str, values: list[str], base: str, targets: Iterable[str]) -> DataFrame:
    """Targets against the base on the same keys; a missing first value drops the row, others stay null."""
    b = summary.where(F.col(system) == base).select(*keys, *[F.col(v).alias(f"{v}_baseline") for v in values])
    t = summary.where(F.col(system).isin(*targets)).select(*keys, F.concat(F.col(system), F.lit(f" - {base}")).alias("contrast"), *[F.col(v).alias(f"{v}_target") for v in values])
    d = b.join(t, keys).where(F.col(f"{values[0]}_baseline").isNotNull() & F.col(f"{values[0]}_target").isNotNull())
    return d.select(*keys, "contrast", *[x for v in values for x in (F.col(f"{v}_baseline"), F.col(f"{v}_target"), (F.col(f"{v}_target") - F.col(f"{v}_baseline")).alias(f"{v}_delta"))])


def grid(summary: DataFrame, row: str, column: str, value: str, order: list[str]) -> DataFrame:
    """One row per `row`, one column per name in `order`; empty cells are null."""
    return summary.groupBy(row).pivot(column, order).agg(F.first(value))


def missing_cells(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(present.select(*keys).distinct(), keys, "left_anti")


def enumerated(value: Column, order: list[str]) -> Column:
    """Place in an enumeration, unknown values behind all."""
    p = F.array_position(F.array(*[F.lit(o) for o in order]), value)
    return F.when(p > 0, p - 1).otherwise(len(order)).cast("int")


def long_form(wide: DataFrame, keys: list[str], metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """(keys..., metric, tier, value) from one column per metric: {column: (label, tier)}."""
    pairs = F.explode(F.array(*[F.struct(F.lit(label).alias("metric"), F.lit(tier).alias("tier"), F.col(c).cast("double").alias("value")) for c, (label, tier) in metrics.items()]))
    return wide.select(*keys, pairs.alias("m")).select(*keys, "m.*")


def attempt_budget(candidates: DataFrame, order: list, accepted: str, target: int, factor: int = 6) -> DataFrame:
    """Candidates in order until `target` were accepted or factor*target tried; a top-n, so only
    the first factor*target rows are ever ordered together."""
    first = candidates.orderBy(*order).limit(factor * target)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return first.withColumn("before", F.coalesce(F.sum(F.col(accepted).cast("int")).over(w), F.lit(0))).where(F.col("before") < target).drop("before")


def stratified(rows: DataFrame, stratum: str, order: list, each: int) -> DataFrame:
    """The first `each` rows of every stratum."""
    w = Window.partitionBy(stratum).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= each)


def seeded(seed: int, key: Column) -> Column:
    """A shuffle order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def outcome(base: Column, target: Column) -> Column:
    """KG+ / KG- / =: whether the target is better, worse or neither; a missing value is neither."""
    return F.when(target > base, "KG+").when(target < base, "KG-").otherwise("=")


def question_set(path: Column, vlm: Column) -> Column:
    """The file's name without folders and its last extension, and _captions behind it where not vlm."""
    name = F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"^(\.*[^.].*)\.[^.]*$", "$1")
    return F.concat(name, F.when(vlm, "").otherwise("_captions"))


def token_range(summary: DataFrame, system: str, tokens: str, base: str = "baseline") -> DataFrame:
    """One row with the least, most and mean tokens of the base system; missing ones and zeros do not count."""
    x = summary.where((F.col(system) == base) & (F.col(tokens) != 0))
    return x.agg(F.min(tokens).alias("least"), F.max(tokens).alias("most"), F.avg(tokens).alias("mean"))
