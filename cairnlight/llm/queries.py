"""The queries of the operators in this subpackage, over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.llm import percentiles as pct
from cairnlight.llm import answers, leakage, personal, quality, residue, scans, splitting, tokens
from cairnlight.session import broadcast_if_small, stored, table

Query = Callable[[SparkSession, str], DataFrame]


def _long(calls: DataFrame) -> DataFrame:
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("latency_ms", "cost_usd")])
    return calls.select("model", "day", F.explode(measures).alias("x")).select("model", "day", "x.*")


def _percentiles(spark: SparkSession, d: str, rel_error: float, once: bool) -> DataFrame:
    """Latency and cost per model: daily frequency tables, combined, then ranked."""
    calls = table(spark, d, "gen_result").select("call_id", "model", "latency_ms", "cost_usd", F.to_date("called_at").alias("day"))
    if once:
        calls = calls.dropDuplicates(["call_id"])
    daily = pct.frequencies(_long(calls), ["model", "measure", "day"], "value", rel_error)
    return pct.percentiles(pct.combine(daily, ["model", "measure"]), ["model", "measure"])


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of both tables with its defect, null where it is sound."""
    asked = table(spark, d, "questions_publaynet_text").select(F.lit("questions_publaynet_text").alias("src"), F.col("question_id").alias("row_id"), F.col("q").alias("prompt"), F.col("answer").alias("response"))
    ran = table(spark, d, "metrics").select(F.lit("metrics").alias("src"), F.col("metric_id").alias("row_id"), F.col("question").alias("prompt"), F.col("generated").alias("response"))
    return answers.pairs_with_defects(asked.unionByName(ran), answers.train_languages(table(spark, d, "documents"), "text", "lang"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pairs(spark, d).where(F.col("defect").isNotNull()).distinct()


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _percentiles(spark, d, 0.0, False)


def p2_percentiles_bounded(spark: SparkSession, d: str) -> DataFrame:
    return _percentiles(spark, d, 0.001, False)


def p2_percentiles_calls(spark: SparkSession, d: str) -> DataFrame:
    return _percentiles(spark, d, 0.0, True)


def p2_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """The cumulative frequency of every latency and cost per model: what all percentiles are read from."""
    calls = table(spark, d, "gen_result").select("model", "latency_ms", "cost_usd", F.to_date("called_at").alias("day"))
    return pct.cumulative(pct.combine(pct.frequencies(_long(calls), ["model", "measure", "day"], "value"), ["model", "measure"]), ["model", "measure"]).select("model", "measure", F.col("low").alias("value"), "n", "upto", "size")


def _scans(spark: SparkSession, d: str) -> scans.Noise:
    """All pages, and the chunks that are prose, with the document and number of their page."""
    pages = table(spark, d, "ingest_doclaynet")
    chunks = table(spark, d, "evidence").select("evidence_id", "source", "chunk")
    prose = broadcast_if_small(stored(quality.kinds(chunks, "evidence_id", "chunk", with_statistics=False).where("kind = 'prose'").select("evidence_id"), "prose"))
    place = pages.where(F.col("image_id").isNotNull()).groupBy(F.concat("image_id", F.lit(".txt")).alias("source")).agg(F.min(F.struct(F.col("original_filename").alias("doc"), F.col("page_no"))).alias("at"))
    place = broadcast_if_small(stored(place, "pages"))
    of_chunks = chunks.join(prose, "evidence_id", "left_semi").join(place, "source", "left").select(F.lit("evidence").alias("src"), F.col("evidence_id").alias("row_id"), F.col("chunk").alias("text"), "at.doc", "at.page_no")
    of_pages = pages.select(F.lit("ingest_doclaynet").alias("src"), F.col("page_id").alias("row_id"), F.col("page_text").alias("text"), F.col("original_filename").alias("doc"), "page_no")
    return scans.scan_noise(of_pages.unionByName(of_chunks))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).cases


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(_scans(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "evidence"), "evidence_id", "chunk")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(table(spark, d, "evidence"), "evidence_id", "chunk")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    captions = table(spark, d, "figure").select(F.lit("figure").alias("src"), F.col("figure_id").alias("row_id"), F.col("caption").alias("text"))
    errors = table(spark, d, "gen_result").select(F.lit("gen_result").alias("src"), F.col("call_id").alias("row_id"), F.col("error").alias("text"))
    return residue.residue_rows(captions.unionByName(errors), ["src", "row_id"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.unnatural(quality.kinds(table(spark, d, "evidence"), "evidence_id", "chunk", with_statistics=False), "evidence_id")


def p6_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The five statistics by name, from their definition in built-in expressions (the kinds are p6_found's)."""
    stats = quality.statistics_sql(table(spark, d, "evidence"), "evidence_id", "chunk")
    return stats.select("evidence_id", *[F.round(c, 6).alias(c) for c in ("words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words")])


def p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    """All statistics of every chunk, its kind and how certain that is."""
    return quality.kinds(table(spark, d, "evidence"), "evidence_id", "chunk")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p8_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return leakage.overlaps(table(spark, d, "benchmark"), "item_id", "text", table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(p8_overlaps(spark, d)).select("item_id", "doc_id").distinct()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.found_details(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "kind", "value").distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(table(spark, d, "documents"), "doc_id", "text")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_pairs, p2_cumulative, p2_percentiles, p2_percentiles_bounded, p2_percentiles_calls, p3_found, p3_repaired, p4_found, p4_pieces, p5_found, p6_found, p6_kinds, p6_statistics, p7_ids, p8_found, p8_overlaps, p9_found, p9_redacted)}

_RANKS = """
WITH calls AS ({calls}), long AS (
  SELECT model, 'latency_ms' AS measure, latency_ms AS value FROM calls WHERE latency_ms IS NOT NULL
  UNION ALL SELECT model, 'cost_usd', cost_usd FROM calls WHERE cost_usd IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model, measure ORDER BY value) AS r, count(*) OVER (PARTITION BY model, measure) AS n FROM long),
probs AS (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])::DOUBLE AS prob)
SELECT model, measure, prob, n::BIGINT AS n, value AS low, value AS high
FROM ranked JOIN probs ON r = greatest(1, ceil(prob * n)::BIGINT)
"""
SQL: dict[str, str] = {
    "p2_cumulative": """
WITH long AS (
  SELECT model, 'latency_ms' AS measure, latency_ms AS value FROM gen_result WHERE latency_ms IS NOT NULL
  UNION ALL SELECT model, 'cost_usd', cost_usd FROM gen_result WHERE cost_usd IS NOT NULL),
counted AS (SELECT model, measure, value, count(*) AS n FROM long GROUP BY ALL)
SELECT model, measure, value, n::BIGINT AS n, (sum(n) OVER (PARTITION BY model, measure ORDER BY value))::BIGINT AS upto, (sum(n) OVER (PARTITION BY model, measure))::BIGINT AS size
FROM counted
""",
    "p2_percentiles": _RANKS.format(calls="SELECT model, latency_ms, cost_usd FROM gen_result"),
    "p2_percentiles_calls": _RANKS.format(calls="SELECT DISTINCT ON (call_id) model, latency_ms, cost_usd FROM gen_result"),
    "p4_found": r"""
SELECT evidence_id, CASE WHEN list_max(list_transform(regexp_split_to_array(chunk, '[\s\x1c-\x1f\x85\p{Z}]+'), lambda x: length(x))) > 500 THEN 'hard' ELSE 'natural' END AS cut
FROM evidence WHERE length(chunk) > 500
""",
    "p6_statistics": rf"""
WITH t AS (SELECT evidence_id, regexp_replace(chunk, '\r\n?', chr(10), 'g') AS t FROM evidence),
x AS (SELECT evidence_id, t, list_filter(regexp_split_to_array(t, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+'), lambda w: w <> '') AS toks, list_filter(list_transform(string_split(t, chr(10)), lambda l: trim(l, ' ')), lambda l: l <> '') AS lines,
  regexp_extract_all(lower(t), '\p{{L}}+') AS words, length(regexp_replace(t, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', '', 'g')) AS chars FROM t)
SELECT evidence_id, CASE WHEN len(toks) > 0 THEN len(toks)::DOUBLE END AS words, CASE WHEN len(toks) > 0 THEN round(chars / len(toks), 6) END AS mean_word_length,
  CASE WHEN len(toks) > 0 THEN round(len(regexp_extract_all(t, '[^\p{{L}}\p{{N}}\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}.,;:!?''"()-]')) / chars, 6) END AS symbol_ratio,
  CASE WHEN len(toks) > 0 THEN round(len(list_filter(lines, lambda l: regexp_matches(l, '[.!?。！？…]["”’)\]]*$'))) / greatest(len(lines), 1), 6) END AS punctuated_lines,
  CASE WHEN len(toks) > 0 THEN round(len(list_filter(words, lambda w: list_contains([{", ".join(f"'{w}'" for w in sorted(set(quality.COMMON)))}], w))) / len(toks), 6) END AS common_words
FROM x""",
    "p8_found": r"""
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), '\p{Cf}+', '', 'g')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> ''), ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, ' ' || array_to_string(w[i:i + least(12, len(w)) - 1], ' ') || ' ' AS g FROM b, unnest(range(1, greatest(len(w) - 11, 1) + 1)) AS u(i) WHERE len(w) > 0)
SELECT DISTINCT item_id, doc_id FROM g JOIN d ON contains(t, g)
""",
}
