"""Queries of the composites (ingest, four-way comparison) and of the small report columns, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.functions import text as T
from cairnlight.functions.vectors import l2_normalised
from cairnlight.operators import ablation, audit, fusion, graph, ingest, metrics, providers, report
from cairnlight.plans import queries as Q
from cairnlight.plans.queries import query
from cairnlight.session import table


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'What is ' || s_name || '?' END AS q, CASE WHEN s_suppkey % 4 = 0 THEN 'n ' || s_nationkey END AS answer FROM supplier")
def q53_skipped_replies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    good = F.concat(F.lit('```json\n{"q": "What is '), "s_name", F.lit('?", "answer": "n '), F.col("s_nationkey").cast("string"), F.lit('"}\n```'))
    reply = F.when(k == 0, good).when(k == 1, '{"q": "SKIP", "answer": "SKIP"}').when(k == 2, "no JSON").otherwise('{"q": "Only?"}')
    return table(spark, d, "supplier").select("s_suppkey", T.authored(reply).alias("x")).select("s_suppkey", "x.q", "x.answer")


@query(r"SELECT doc_id, floor(length(text) / 4)::BIGINT AS by_characters, floor(len(list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda w: w <> '')) * 1.3::DOUBLE)::BIGINT AS by_words FROM documents WHERE text IS NOT NULL")
def q54_token_estimates(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where(t.isNotNull()).select("doc_id", T.estimated_tokens(t).alias("by_characters"), T.estimated_tokens(t, "words").alias("by_words"))


@query(r"SELECT question_id, regexp_replace(regexp_extract('sets/' || source, '[^/]*$'), '^(\.*[^.].*)\.[^.]*$', '\1') || CASE WHEN coalesce(level = 'hard', false) THEN '' ELSE '_captions' END AS name FROM questions_publaynet_text WHERE source IS NOT NULL")
def q55_set_names(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions_publaynet_text").where("source is not null")
    return q.select("question_id", report.question_set(F.concat(F.lit("sets/"), "source"), F.coalesce(F.col("level") == "hard", F.lit(False))).alias("name"))


@query("SELECT question_id, q FROM questions_publaynet_text ORDER BY question_id LIMIT 25")
def q56_first_questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions_publaynet_text").select("question_id", "q").orderBy("question_id").limit(25)


@query(f"""WITH {Q._FACTS}, f AS ({Q._FACT_RANK.format(rows='found')}), {Q._VOCABULARY},
g AS (SELECT fact, regexp_extract_all(fact, '[A-Za-z]{{3,}}') AS w FROM (SELECT DISTINCT fact FROM f)),
k AS (SELECT fact, count(*) AS n, count(v.word) AS known FROM (SELECT fact, unnest(list_transform(list_filter(w, lambda x: x <> upper(x)), lambda x: lower(x))) AS word FROM g) x LEFT JOIN vocabulary v USING (word) GROUP BY fact),
b AS (SELECT fact, CASE WHEN len(w) = 0 OR regexp_matches(fact, '[0-9]') THEN false ELSE coalesce((k.n - k.known) / k.n >= 0.5, false) END AS garbled FROM g LEFT JOIN k USING (fact))
SELECT (SELECT count(*) FROM asked)::INTEGER AS questions, count(DISTINCT qid) AS with_facts, round(count(*) / count(DISTINCT qid), 6) AS mean_facts, round(100.0 * count(*) FILTER (garbled) / count(*), 6)::DOUBLE AS garbled_percent FROM f JOIN b USING (fact)""")
def q57_fact_statistics(spark: SparkSession, d: str) -> DataFrame:
    q = Q.asked(spark, d)
    f = graph.facts(q, graph.edges(Q.triples(spark, d)))
    bad = audit.garbled(f.select("fact").distinct().withColumn("text", F.col("fact")), "fact", "text", audit.vocabulary(table(spark, d, "documents"), "text"))
    x = audit.fact_statistics(f.select("qid", "fact").join(bad, "fact"), q.count())
    return x.select(F.col("questions").cast("int").alias("questions"), "with_facts", F.round("mean_facts", 6).alias("mean_facts"), F.round("garbled_percent", 6).alias("garbled_percent"))


@query(f"WITH s AS ({Q._CALLS}) SELECT min(mean_in_tok) AS least, max(mean_in_tok) AS most, round(avg(mean_in_tok), 6) AS mean FROM s WHERE system_name = 'baseline' AND mean_in_tok <> 0")
def q58_token_range(spark: SparkSession, d: str) -> DataFrame:
    return report.token_range(Q.calls(spark, d), "system_name", "mean_in_tok").select("least", "most", F.round("mean", 6).alias("mean"))


@query("SELECT count(DISTINCT source) AS sources, count(*) AS chunks FROM evidence")
def q59_distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("chunks"))


@query("WITH c AS (SELECT md5(chunk) AS k FROM evidence WHERE chunk IS NOT NULL) SELECT count(*) AS chunks, count(*) FILTER (k < '8') AS cached, count(*) FILTER (k >= '8') AS open, count(DISTINCT k) FILTER (k >= '8') AS open_keys FROM c")
def q60_cache_counts(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "evidence").where("chunk is not null").select(T.chunk_key(F.col("chunk")).alias("chunk_key"))
    return providers.cache_counts(keys, keys.where("chunk_key < '8'"))


@query(f"WITH {Q._VOCABULARY} SELECT lower(trim(n_name)) AS word FROM nation WHERE length(trim(n_name)) > 2 UNION SELECT word FROM vocabulary")
def q61_dictionary_union(spark: SparkSession, d: str) -> DataFrame:
    return audit.known_words(table(spark, d, "nation").select(F.col("n_name").alias("word")), audit.vocabulary(table(spark, d, "documents"), "text"))


@query("SELECT metric_id, CASE WHEN answer_correct > faithfulness THEN 'KG+' WHEN answer_correct < faithfulness THEN 'KG-' ELSE '=' END AS outcome FROM metrics")
def q62_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metrics").select("metric_id", report.outcome(F.col("faithfulness"), F.col("answer_correct")).alias("outcome"))


@query("SELECT source, min(question_id) AS question_id FROM questions_publaynet_text WHERE source NOT IN (SELECT source FROM questions_publaynet_text WHERE level = 'hard' AND source IS NOT NULL) GROUP BY source")
def q63_unused_pages(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions_publaynet_text").where("source is not null").select("source", "question_id", "level")
    return ingest.unused(q, q.where("level = 'hard'"), "source", ["question_id"]).select("source", "question_id")


_L2 = """array_to_string(list_filter([coalesce(answer, ''), '', 'How I got this:', '  - Text source(s): ' || sources || '  (retrieved by text similarity)', CASE WHEN has_facts THEN '  - Knowledge-graph facts used: 2' END,
 '  - Figure: ' || image || '  (retrieved by CLIP, score ' || round(coalesce(score, 0.0)::DECIMAL(18, 8), 3) || ')'], lambda x: x IS NOT NULL), chr(10))"""


@query(f"WITH {Q._FUSED} SELECT question_id, md5(coalesce(answer, '')) AS level0_md5, md5({_L2}) AS level2_md5 FROM fused")
def q64_explain_levels(spark: SparkSession, d: str) -> DataFrame:
    args = (F.coalesce("answer", F.lit("")), F.col("passages"), F.col("facts"), F.col("figure.image"), F.col("figure.caption"), F.col("figure.score"))
    return Q.fused(spark, d).select("question_id", F.md5(fusion.explanation(fusion.parsed_level("0"), *args)).alias("level0_md5"), F.md5(fusion.explanation(fusion.parsed_level("x"), *args)).alias("level2_md5"))


@query(f"""
WITH e AS (SELECT question_id, bool_or(contains({Q._LOOSE.format(c='chunk')}, {Q._LOOSE.format(c='answer')}) AND {Q._LOOSE.format(c='answer')} <> '') AS a, bool_or(rank_no <= 3 AND contains({Q._LOOSE.format(c='chunk')}, {Q._LOOSE.format(c='answer')}) AND {Q._LOOSE.format(c='answer')} <> '') AS b,
  bool_or(rank_no <= 1 AND contains({Q._LOOSE.format(c='chunk')}, {Q._LOOSE.format(c='answer')}) AND {Q._LOOSE.format(c='answer')} <> '') AS c FROM questions_publaynet_text JOIN evidence USING (question_id) GROUP BY question_id),
n AS (SELECT count(*) FILTER (a) AS in_page, count(*) FILTER (a AND b) AS in_triples, count(*) FILTER (a AND b AND c) AS returned FROM e),
r AS (SELECT *, CASE WHEN in_page > 0 THEN in_triples / in_page ELSE 0.0 END::DOUBLE AS extract_rate, CASE WHEN in_triples > 0 THEN returned / in_triples ELSE 0.0 END::DOUBLE AS retrieve_rate FROM n)
SELECT *, CASE WHEN extract_rate < 0.4 THEN 'extraction' WHEN retrieve_rate < 0.4 THEN 'retrieval' ELSE 'neither' END AS verdict FROM r
""")
def q65_bottleneck(spark: SparkSession, d: str) -> DataFrame:
    """The three stages of the fact funnel; chunks of lower ranks stand for what extraction and retrieval leave."""
    q = table(spark, d, "questions_publaynet_text").select("question_id", T.loose(F.col("answer")).alias("a"))
    hit = F.contains(T.loose(F.col("chunk")), F.col("a")) & (F.col("a") != "")
    stages = ("in_page", "in_triples", "returned")
    e = q.join(table(spark, d, "evidence").select("question_id", "rank_no", "chunk"), "question_id").groupBy("question_id").agg(*[F.bool_or(hit & (F.col("rank_no") <= k)).alias(s) for s, k in zip(stages, (10**9, 3, 1))])
    return audit.bottleneck(audit.funnel(e, list(stages)), stages)


@query("SELECT type, list_sort(list(DISTINCT coalesce(level, '?'))) AS levels, count(*) AS questions FROM questions_publaynet_text GROUP BY type")
def q66_question_keys(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions_publaynet_text")
    return q.groupBy("type").agg(F.array_sort(F.collect_set(F.coalesce("level", F.lit("?")))).alias("levels"), F.count("*").alias("questions"))


@query(f"""WITH {Q._REGIONS}, t AS (SELECT page_id, string_agg(label || ' ' || x0 || ' ' || y0 || ' ' || x1 || ' ' || y1, chr(10) ORDER BY ord) AS text FROM regions WHERE category IN ('text', 'title', 'table') GROUP BY page_id),
kept AS (SELECT page_id FROM ingest_doclaynet WHERE doc_category = (SELECT min(doc_category) FROM ingest_doclaynet))
SELECT page_id, md5(text) AS text_md5 FROM t JOIN kept USING (page_id)""")
def q70_ingest_doclaynet(spark: SparkSession, d: str) -> DataFrame:
    """Page texts of one category; the stub reads the label and the box of a region as its text."""
    pages = table(spark, d, "ingest_doclaynet")
    first = pages.agg(F.min("doc_category")).first()[0]
    return ingest.doclaynet(pages, category=first).texts.select("page_id", F.md5("text").alias("text_md5"))


@query(f"""WITH {Q._REGIONS} SELECT page_id, page_id || '_' || CASE WHEN label = 'Formula' THEN 'formula' ELSE category END || (row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1) || '.png' AS image_name,
'A picture called ' || page_id || '_' || CASE WHEN label = 'Formula' THEN 'formula' ELSE category END || (row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1) || '.png.' AS caption FROM regions WHERE category IN ('figure', 'table') OR label = 'Formula'""")
def q71_ingest_crops(spark: SparkSession, d: str) -> DataFrame:
    return ingest.doclaynet(table(spark, d, "ingest_doclaynet")).crops.select("page_id", "image_name", "caption")


_HOTPOT = r"""
ev AS (SELECT DISTINCT ON (question_id, source) question_id AS id, source, trim(chunk, ' ') AS paragraph, rank_no FROM evidence WHERE source IS NOT NULL AND question_id IS NOT NULL ORDER BY question_id, source, evidence_id),
known AS (SELECT DISTINCT id, source FROM ev WHERE paragraph <> ''),
title AS (SELECT DISTINCT source FROM known),
gold AS (SELECT ev.id, list_sort(list(DISTINCT ev.source || '.txt')) AS gold FROM ev JOIN title USING (source) WHERE rank_no <= 2 GROUP BY ev.id HAVING count(DISTINCT ev.source) >= 2),
found AS (SELECT g.id, q.type, coalesce(q.level, 'unknown') AS level, gold FROM gold g JOIN questions_publaynet_text q ON q.question_id = g.id)"""


def _hotpot_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the question set's schema: the evidence of a question as its context, the two best as its support."""
    e = table(spark, d, "evidence").where("source is not null and question_id is not null")
    one = e.groupBy(F.col("question_id").alias("id"), "source").agg(F.min_by(F.struct("chunk", "rank_no"), "evidence_id").alias("x"))
    parts = F.array_sort(F.collect_list(F.struct("source", "x.chunk", "x.rank_no")))  # one page each, a bounded number
    c = one.groupBy("id").agg(parts.alias("p"))
    context = F.struct(F.transform("p", lambda x: x["source"]).alias("title"), F.transform("p", lambda x: F.array(F.coalesce(x["chunk"], F.lit("")))).alias("sentences"))
    support = F.struct(F.transform(F.filter("p", lambda x: x["rank_no"] <= 2), lambda x: x["source"]).alias("title"))
    q = table(spark, d, "questions_publaynet_text").select(F.col("question_id").alias("id"), F.col("q").alias("question"), "answer", "type", "level")
    return q.join(c.select("id", context.alias("context"), support.alias("supporting_facts")), "id")


@query(f"WITH {_HOTPOT} SELECT id, type, level, array_to_string(gold, '|') AS gold FROM found QUALIFY row_number() OVER (PARTITION BY type ORDER BY md5('42:' || id)) <= 20")
def q72_ingest_hotpotqa(spark: SparkSession, d: str) -> DataFrame:
    return ingest.hotpotqa(_hotpot_rows(spark, d), 20)[1].select("id", "type", "level", F.array_join("gold", "|").alias("gold"))


@query(f"WITH {_HOTPOT} SELECT type, count(*) AS found, least(count(*), 120) AS kept, greatest(120 - count(*), 0) AS short FROM found GROUP BY type")
def q72_hotpotqa_shortfall(spark: SparkSession, d: str) -> DataFrame:
    return ingest.hotpotqa(_hotpot_rows(spark, d), 120)[2]


def _ablated(spark: SparkSession, d: str) -> DataFrame:
    """The questions with all evidence; hard ones stand for questions about figures, whose gold is the figure."""
    f = Q.fused(spark, d)
    figure = F.col("level").eqNullSafe("hard") & F.col("figure").isNotNull()
    ranked = F.transform("images", lambda i: i["image_name"])
    return f.select("question_id", "q", "answer", F.when(figure, F.array("figure.image")).otherwise(F.array(F.coalesce("source", F.lit("")))).alias("expected"), figure.alias("is_image"), "passages", "facts", "images", ranked.alias("image_ranked"))


def _models(spark: SparkSession, d: str) -> dict[str, bool]:
    return {r.name: bool(r.vision) for r in table(spark, d, "model_pricing").select("name", "vision").distinct().orderBy("name").collect()}  # the fixed registry


_SAY = {k: "'" + v.replace("'", "''") + "'" for k, v in fusion.INSTRUCTIONS.items()}


@query(f"""WITH {Q._FUSED}, s AS (SELECT unnest(['baseline', '+KG', '+multimodal', '+both']) AS system),
x AS (SELECT f.*, s.system, m.name AS model, m.vision, s.system IN ('+KG', '+both') AS kg, s.system IN ('+multimodal', '+both') AS mm, coalesce(level = 'hard', false) AND image IS NOT NULL AS is_image FROM fused f, s, (SELECT DISTINCT name, vision FROM model_pricing) m),
y AS (SELECT *, CASE WHEN NOT mm OR image IS NULL THEN 'none' WHEN is_image AND vision THEN 'pixels' ELSE 'caption' END AS delivery FROM x)
SELECT question_id, system, model, delivery,
 md5(CASE WHEN kg AND mm THEN CASE WHEN delivery = 'pixels' THEN {_SAY['all+pixels']} ELSE {_SAY['all+captions']} END WHEN mm THEN CASE WHEN delivery = 'pixels' THEN {_SAY['text+pixels']} ELSE {_SAY['text+captions']} END WHEN kg THEN {_SAY['text+facts']} ELSE {_SAY['text']} END || chr(10)
 || CASE WHEN mm OR kg THEN CASE WHEN mm THEN 'Text context:' ELSE 'Context passages:' END ELSE 'Context:' END || chr(10) || context
 || CASE WHEN kg THEN chr(10) || chr(10) || 'Knowledge-graph facts:' || chr(10) || coalesce(fact_lines, '(none)') ELSE '' END
 || CASE WHEN mm AND delivery <> 'pixels' THEN chr(10) || chr(10) || 'Relevant images (described):' || chr(10) || coalesce(image_line, CASE WHEN kg THEN '(none)' ELSE '' END) ELSE '' END || chr(10) || chr(10) || 'Question: ' || q) AS prompt_md5,
 md5(bare || CASE WHEN kg THEN chr(10) || CASE WHEN has_facts THEN fact1 || chr(10) || fact2 ELSE '' END ELSE '' END || CASE WHEN mm THEN chr(10) || CASE WHEN image IS NULL THEN '' ELSE coalesce(caption, '') END ELSE '' END) AS evidence_md5,
 CASE WHEN is_image THEN mm::INTEGER ELSE coalesce(list_contains(ranked, expected), false)::INTEGER END AS recall
FROM y""")
def q73_ablation_plan(spark: SparkSession, d: str) -> DataFrame:
    p = ablation.planned(_ablated(spark, d), _models(spark, d))
    return p.select("question_id", "system", "model", "delivery", F.md5(F.concat("instruction", F.lit("\n"), "prompt")).alias("prompt_md5"), F.md5("evidence").alias("evidence_md5"), metrics.complete(F.col("ranked"), F.col("expected")).alias("recall"))


@query()
def n5_ablation(spark: SparkSession, d: str) -> DataFrame:
    """The whole comparison over the stub: one row per system and model, in the registry's order."""
    return ablation.summarised(ablation.compared(ablation.planned(_ablated(spark, d), dict(list(_models(spark, d).items())[:2])))).orderBy("place", "model")


@query()
def n6_authored_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions that the stub writes about the documents, with the reason why one is not taken."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", report.seeded(42, F.col("doc_id")).alias("place"))
    return providers.authored(docs, "doc_id", "text", target=40, order=["place"]).select("doc_id", "q", "answer", "rejected")


_WORDS = r"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


@query(f"""WITH m AS (SELECT metric_id, {_WORDS.format(c='generated')} AS h, {_WORDS.format(c='expected')} AS r FROM metrics WHERE generated IS NOT NULL AND expected IS NOT NULL),
e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
tok AS (SELECT token, v FROM (SELECT DISTINCT unnest(list_concat(h, r)) AS token FROM m) LEFT JOIN e ON vec_id = (ascii(token) * 31 + length(token) * 7) % 400),
hs AS (SELECT metric_id, i, h[i] AS token FROM m, unnest(range(1, len(h) + 1)) AS u(i)), rs AS (SELECT metric_id, i, r[i] AS token FROM m, unnest(range(1, len(r) + 1)) AS u(i)),
s AS (SELECT a.metric_id, a.i AS hi, b.i AS ri, CASE WHEN a.token = b.token THEN 1.0::DOUBLE ELSE coalesce(list_dot_product(x.v, y.v), 0.0) END AS s FROM hs a JOIN rs b USING (metric_id) JOIN tok x ON x.token = a.token JOIN tok y ON y.token = b.token),
p AS (SELECT metric_id, avg(s) AS p FROM (SELECT metric_id, hi, max(s) AS s FROM s GROUP BY ALL) GROUP BY metric_id), c AS (SELECT metric_id, avg(s) AS c FROM (SELECT metric_id, ri, max(s) AS s FROM s GROUP BY ALL) GROUP BY metric_id)
SELECT metric_id, round(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0.0 END, 4) AS f1 FROM p JOIN c USING (metric_id)""")
def q74_greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """Greedy matching of token vectors; the vectors of a fixed table stand for those of a model."""
    m = table(spark, d, "metrics").where("generated is not null and expected is not null").select(F.col("metric_id").alias("pair"), F.col("generated").alias("hypothesis"), F.col("expected").alias("reference"))
    words = m.select(F.explode(F.split(F.lower(F.concat_ws(" ", "hypothesis", "reference")), r"[^\p{L}\p{N}]+")).alias("token")).where("token <> ''").distinct()
    e = table(spark, d, "embeddings").select("vec_id", l2_normalised(F.col("embedding")).alias("v"))
    tokens = words.join(e, F.col("vec_id") == (F.ascii("token") * 31 + F.length("token") * 7) % 400).select("token", "v")
    return metrics.greedy_match(m, tokens).select(F.col("pair").alias("metric_id"), F.round("f1", 4).alias("f1"))
