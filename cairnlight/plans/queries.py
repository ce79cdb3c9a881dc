"""One query per operator of the engine, over whole tables, with its SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.functions import text as T
from cairnlight.functions.filenames import safe_name, safe_name_ascii
from cairnlight.operators import audit, fusion, graph, knn, layout, metrics, providers, report
from cairnlight.session import table
from cairnlight.streaming import pages as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Shared pieces of SQL: the whitespace class, chunks, regions, triples and questions over them.
_NORM = r"trim(regexp_replace({c}, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"
_CHUNKS = f"""
normal AS (SELECT doc_id, lang, {_NORM.format(c='text')} AS t FROM documents WHERE text IS NOT NULL),
chunks AS (SELECT doc_id, lang, (s // 450)::INTEGER AS chunk_ord, substring(t, s + 1, 500) AS chunk FROM normal, unnest(range(0, length(t), 450)) AS u(s) WHERE length(t) > 0)"""
_LABELS = "MAP {" + ", ".join(f"{k}: '{v}'" for k, v in layout.DOCLAYNET.items()) + "}"
_REGIONS = f"""
boxes AS (SELECT page_id, image_id, (i - 1)::INTEGER AS ord, ({_LABELS})[objects.category[i]] AS label, objects.bbox[i] AS b FROM ingest_doclaynet, unnest(range(1, len(objects.category) + 1)) AS u(i) WHERE objects IS NOT NULL),
regions AS (
  SELECT page_id, image_id, ord, label, CASE label WHEN 'Picture' THEN 'figure' WHEN 'Section-header' THEN 'title' WHEN 'Title' THEN 'title' WHEN 'Table' THEN 'table' ELSE 'text' END AS category,
    trunc(b[1])::INTEGER AS x0, trunc(b[2])::INTEGER AS y0, trunc(b[1] + b[3])::INTEGER AS x1, trunc(b[2] + b[4])::INTEGER AS y1
  FROM boxes WHERE label IS NOT NULL AND len(b) = 4 AND b[3] >= 4 AND b[4] >= 4)"""
_TRIPLES = """
triples AS (
  SELECT n_nationkey::BIGINT AS triple_ord, n_name AS subject, 'lies in' AS relation, r_name AS object, 'nation#' || n_nationkey AS source FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 1000000 + s_suppkey, s_name, 'comes from', n_name, 'supplier#' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 1000000000 + p_partkey, p_brand, 'makes ' || p_name, p_type, 'part#' || p_partkey FROM part)"""
_EDGES = (
    _TRIPLES
    + """,
named AS (SELECT lower(trim(subject)) AS src, lower(trim(object)) AS dst, relation, source, triple_ord FROM triples),
edges AS (SELECT src, dst, arg_max(relation, triple_ord) AS relation, arg_max(source, triple_ord) AS source, min(triple_ord) AS first_ord, max(triple_ord) AS last_ord FROM named GROUP BY src, dst),
nodes AS (SELECT node, min(o) AS node_ord FROM (SELECT src AS node, 2 * first_ord AS o FROM edges UNION ALL SELECT dst, 2 * first_ord + 1 FROM edges) GROUP BY node)"""
)
_ASKED = """
asked AS (SELECT s_suppkey AS qid, 'Does ' || s_name || ' of ' || n_name || ' ship to NATION_' || (s_suppkey % 7) || ' or ' || r_name || '?' AS q
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
matches AS (SELECT qid, node, node_ord FROM asked JOIN nodes ON regexp_matches(lower(q), '\\b' || regexp_escape(node) || '\\b') WHERE length(node) >= 5)"""
_FACTS = (
    _EDGES
    + ","
    + _ASKED
    + """,
found AS (
  SELECT qid, node_ord, 0 AS way, first_ord, src || ' ' || relation || ' ' || dst AS fact, source FROM matches JOIN edges ON node = src
  UNION ALL SELECT qid, node_ord, 1, first_ord, src || ' ' || relation || ' ' || dst, source FROM matches JOIN edges ON node = dst)"""
)
_PASSAGES = """
best AS (SELECT question_id, rank_no, arg_min(source, evidence_id) AS source, arg_min(coalesce(chunk, ''), evidence_id) AS chunk FROM evidence WHERE rank_no <= 3 AND source IS NOT NULL GROUP BY question_id, rank_no)"""
_RANKED = (
    _PASSAGES
    + """,
ranked AS (SELECT question_id, list(source ORDER BY rank_no) AS ranked FROM best GROUP BY question_id),
judged AS (SELECT question_id, source AS expected, coalesce(ranked, []) AS ranked, [source, 'x' || source, source] AS gold FROM questions_publaynet_text LEFT JOIN ranked USING (question_id) WHERE source IS NOT NULL)"""
)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return T.chunked(table(spark, d, "documents"), ["doc_id", "lang"], "text")


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_ord, length(chunk)::INTEGER AS n_chars, md5(chunk) AS chunk_key FROM chunks")
def q01_chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("doc_id", "chunk_ord", F.length("chunk").alias("n_chars"), T.chunk_key(F.col("chunk")).alias("chunk_key"))


@query(rf"WITH {_CHUNKS} SELECT lang, count(*) AS chunks, count(*) FILTER (NOT regexp_matches(chunk, '^\p{{Lu}}')) AS starts_mid, count(*) FILTER (NOT regexp_matches(chunk, '[.!?]$')) AS ends_mid FROM chunks GROUP BY lang")
def q02_chunk_boundary(spark: SparkSession, d: str) -> DataFrame:
    return audit.boundary_damage(chunks(spark, d), ["lang"])


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_ord, length(chunk)::INTEGER AS n_chars FROM chunks QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(chunk) DESC, chunk_ord) = 1")
def q03_longest_chunk(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).select("doc_id", "chunk_ord", F.length("chunk").alias("n"))
    return c.groupBy("doc_id").agg(F.max_by(F.struct("chunk_ord", "n"), F.struct("n", -F.col("chunk_ord"))).alias("x")).select("doc_id", "x.chunk_ord", F.col("x.n").alias("n_chars"))


@query("SELECT doc_id, md5('42:' || doc_id) AS place FROM documents WHERE length(trim(text)) >= 400 ORDER BY place LIMIT 35")
def q04_page_gate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.length(F.trim("text")) >= 400)
    return docs.select("doc_id", report.seeded(42, F.col("doc_id")).alias("place")).orderBy("place").limit(35)


@query("SELECT p_partkey, 'p_name: ' || coalesce(p_name, 'None') || ' | p_brand: ' || coalesce(p_brand, 'None') || ' | p_size: ' || coalesce(p_size::VARCHAR, 'None') AS sentence FROM part")
def q05_row_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.row_sentence(["p_name", "p_brand", "p_size"]).alias("sentence"))


@query("""
WITH h AS (SELECT md5(doc_id || ':' || n_chars) AS m FROM documents),
s AS (SELECT count(*) AS n, sum(('0x' || substr(m, 1, 8))::BIGINT) AS a, sum(('0x' || substr(m, 9, 8))::BIGINT) AS b, sum(('0x' || substr(m, 17, 8))::BIGINT) AS c, sum(('0x' || substr(m, 25, 8))::BIGINT) AS e FROM h)
SELECT n AS rows, substr(md5(a || ':' || b || ':' || c || ':' || e || ':' || n), 1, 16) AS fingerprint FROM s
""")
def q06_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return T.fingerprint(table(spark, d, "documents"), "doc_id", "n_chars")


def regions(spark: SparkSession, d: str) -> DataFrame:
    return layout.regions(table(spark, d, "ingest_doclaynet"), ["page_id", "image_id"])


@query(f"WITH {_REGIONS} SELECT page_id, ord, label, category, x0, y0, x1, y1 FROM regions WHERE category IN ('text', 'title', 'table')")
def q07_text_regions(spark: SparkSession, d: str) -> DataFrame:
    return layout.text_regions(regions(spark, d)).drop("image_id")


@query(f"""WITH {_REGIONS} SELECT page_id, ord, image_id || '_' || CASE WHEN label = 'Formula' THEN 'formula' ELSE category END || (row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1) || '.png' AS image_name
FROM regions WHERE category IN ('figure', 'table') OR label = 'Formula'""")
def q07_crop_names(spark: SparkSession, d: str) -> DataFrame:
    return layout.crops(regions(spark, d), "page_id", F.col("image_id")).select("page_id", "ord", "image_name")


@query(f"""WITH {_REGIONS}, u AS (SELECT page_id, greatest(0, min(x0) - 4)::INTEGER AS x0, greatest(0, min(y0) - 4)::INTEGER AS y0, least(max(x1) + 4, 1025)::INTEGER AS x1, least(max(y1) + 4, 1025)::INTEGER AS y1 FROM regions GROUP BY page_id)
SELECT * FROM u WHERE x1 - x0 >= 8 AND y1 - y0 >= 8""")
def q08_union_bbox(spark: SparkSession, d: str) -> DataFrame:
    return layout.union_box(regions(spark, d), ["page_id"], F.lit(1025), F.lit(1025))


@query("""
WITH lines AS (SELECT page_id, y::INTEGER - 1 AS y0, string_split(page_text, chr(10))[y] AS line FROM ingest_doclaynet, unnest(range(1, len(string_split(page_text, chr(10))) + 1)) AS u(y) WHERE page_text IS NOT NULL),
words AS (SELECT page_id, y0, x::INTEGER - 1 AS x0, string_split(line, ' ')[x] AS word FROM lines, unnest(range(1, len(string_split(line, ' ')) + 1)) AS u(x)),
tokens AS (SELECT *, y0 * 1000000 + x0 AS tok_ord, CASE WHEN y0 = 0 THEN 'title' WHEN regexp_matches(word, '^[0-9]') THEN 'table' ELSE 'paragraph' END AS label FROM words),
parts AS (SELECT page_id, label, min(tok_ord) AS first, string_agg(word, ' ' ORDER BY y0, x0, tok_ord) FILTER (trim(word) <> '') AS t FROM tokens GROUP BY page_id, label)
SELECT page_id, md5(string_agg(t, chr(10) ORDER BY first)) AS text_md5 FROM parts WHERE t IS NOT NULL GROUP BY page_id
""")
def q09_page_assembly(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "ingest_doclaynet").where("page_text is not null").select("page_id", F.posexplode(F.split("page_text", "\n")).alias("y0", "line"))
    tokens = lines.select("page_id", "y0", F.posexplode(F.split("line", " ")).alias("x0", "word")).withColumn("tok_ord", F.col("y0") * 1_000_000 + F.col("x0"))
    tokens = tokens.withColumn("label", F.when(F.col("y0") == 0, "title").when(F.col("word").rlike("^[0-9]"), "table").otherwise("paragraph"))
    return layout.assembled(tokens, "page_id").select("page_id", F.md5("text").alias("text_md5"))


_RUNS = """
WITH m AS (SELECT event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) AND row_number() OVER (ORDER BY event_id) > 1 THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (ORDER BY event_id) AS run FROM m)
SELECT run::BIGINT AS run, any_value(event_type) AS event_type, min(event_id) AS first_ord, max(event_id) AS last_ord, count(*) AS n FROM r GROUP BY run
"""


@query(_RUNS)
def q10_contiguous_runs(spark: SparkSession, d: str) -> DataFrame:
    return layout.contiguous_runs(table(spark, d, "events"), "event_id", "event_type")


@query(r"""
WITH t AS (SELECT question_id, q, substr(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(q, '[<>:"/\\|?*,()''\[\]]', '_', 'g')), '\s+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), 1, 100) AS n
  FROM questions_publaynet_text WHERE NOT regexp_matches(q, '[^\x00-\x7f]'))
SELECT question_id, CASE WHEN n = '' THEN 'untitled' ELSE n END || CASE WHEN length(q) > 100 THEN '_' || substr(md5(q), 1, 6) ELSE '' END AS file_name FROM t
""")
def q11_safe_filename(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "questions_publaynet_text").where(~F.col("q").rlike(r"[^\x00-\x7f]"))
    return asked.select("question_id", safe_name_ascii(F.col("q")).alias("file_name"))


@query("SELECT image_id, page_id, md5(page_text) AS text_md5 FROM ingest_doclaynet WHERE image_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY ingested_at DESC NULLS LAST, page_id DESC) = 1")
def q12_pool_last_wins(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "ingest_doclaynet").where("image_id is not null").select("image_id", "page_id", "ingested_at", F.md5("page_text").alias("text_md5"))
    return p.groupBy("image_id").agg(F.max_by(F.struct("page_id", "text_md5"), F.struct(F.col("ingested_at").isNotNull(), "ingested_at", "page_id")).alias("x")).select("image_id", "x.*")


@query("WITH p AS (SELECT DISTINCT question_id, source FROM evidence WHERE source IS NOT NULL) SELECT question_id, source FROM p WHERE question_id IN (SELECT question_id FROM p GROUP BY question_id HAVING count(*) >= 2)")
def q13_gold_two(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "evidence").where("source is not null").select("question_id", "source").distinct()
    return p.join(p.groupBy("question_id").count().where("count >= 2"), "question_id", "left_semi")


@query("SELECT type, question_id, row_number() OVER (PARTITION BY type ORDER BY md5('7:' || question_id)) AS place FROM questions_publaynet_text QUALIFY place <= 20")
def q14_stratified(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions_publaynet_text").select("type", "question_id", report.seeded(7, F.col("question_id")).alias("o"))
    return report.stratified(q, "type", ["o"], 20).select("type", "question_id", F.col("place").cast("long").alias("place"))


_KNN = """
unit AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE embedding IS NOT NULL),
near AS (SELECT q.vec_id AS qid, c.vec_id AS id, q.label AS wanted, c.label AS label, round(list_dot_product(q.v, c.v) / (q.n * c.n), 6) AS score FROM unit q JOIN unit c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INTEGER AS rank FROM near)"""


def neighbours(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return knn.top_k(e.where("id % 50 = 0").withColumnRenamed("id", "qid"), e, k)


@query(f"WITH {_KNN} SELECT qid, id, score, rank FROM ranked WHERE rank <= 3")
def q15_text_topk(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d, 3)


@query(f"WITH {_KNN} SELECT qid, id, rank, label, rank <= 1 AS as_pixels, rank <= 3 AS as_caption FROM ranked WHERE rank <= 5")
def q16_image_depths(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return neighbours(spark, d, 5).join(labels, "id").select("qid", "id", "rank", "label", (F.col("rank") <= 1).alias("as_pixels"), (F.col("rank") <= 3).alias("as_caption"))


def triples(spark: SparkSession, d: str) -> DataFrame:
    n, r, s, p = (table(spark, d, t) for t in ("nation", "region", "supplier", "part"))
    where = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("long").alias("triple_ord"), F.col("n_name").alias("subject"), F.lit("lies in").alias("relation"), F.col("r_name").alias("object"), F.concat(F.lit("nation#"), F.col("n_nationkey").cast("string")).alias("source"))
    comes = s.join(n, s.s_nationkey == n.n_nationkey).select((F.col("s_suppkey") + 1_000_000).alias("triple_ord"), F.col("s_name").alias("subject"), F.lit("comes from").alias("relation"), F.col("n_name").alias("object"), F.concat(F.lit("supplier#"), F.col("s_suppkey").cast("string")).alias("source"))
    makes = p.select((F.col("p_partkey") + 1_000_000_000).alias("triple_ord"), F.col("p_brand").alias("subject"), F.concat(F.lit("makes "), "p_name").alias("relation"), F.col("p_type").alias("object"), F.concat(F.lit("part#"), F.col("p_partkey").cast("string")).alias("source"))
    return where.unionByName(comes).unionByName(makes)


@query(f"WITH {_TRIPLES} SELECT triple_ord, subject, relation, object, source, md5(subject || relation || object) AS triple_key FROM triples")
def q17_triples(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d).withColumn("triple_key", T.chunk_key(F.concat("subject", "relation", "object")))


@query(f"WITH {_EDGES} SELECT * FROM edges")
def q18_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(triples(spark, d))


@query(f"WITH {_EDGES}, e AS (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) SELECT node, count(*) AS degree, any_value(node_ord) AS node_ord FROM e JOIN nodes USING (node) GROUP BY node")
def q19_graph_degree(spark: SparkSession, d: str) -> DataFrame:
    e = graph.edges(triples(spark, d))
    return graph.degrees(e).join(graph.nodes(e), "node")


def asked(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    text = F.concat(F.lit("Does "), "s_name", F.lit(" of "), "n_name", F.lit(" ship to NATION_"), (F.col("s_suppkey") % 7).cast("string"), F.lit(" or "), "r_name", F.lit("?"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("qid"), text.alias("q"))


@query(f"WITH {_EDGES}, {_ASKED} SELECT qid, node, node_ord FROM matches")
def q20_node_match(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_matches(asked(spark, d), graph.nodes(graph.edges(triples(spark, d))))


_FACT_RANK = "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY node_ord, way, first_ord, fact)::INTEGER AS rank, fact, source FROM (SELECT * FROM {rows} QUALIFY row_number() OVER (PARTITION BY qid, fact ORDER BY node_ord, way, first_ord, source) = 1) QUALIFY rank <= 8"


@query(f"WITH {_FACTS} {_FACT_RANK.format(rows='found')}")
def q21_facts_all(spark: SparkSession, d: str) -> DataFrame:
    return graph.facts(asked(spark, d), graph.edges(triples(spark, d)))


@query(f"WITH {_FACTS}, kept AS (SELECT * FROM found WHERE source = 'supplier#' || qid OR source = 'nation#' || (qid % 7)) {_FACT_RANK.format(rows='kept')}")
def q22_facts_allowed(spark: SparkSession, d: str) -> DataFrame:
    q = asked(spark, d)
    allowed = q.select("qid", F.explode(F.array(F.concat(F.lit("supplier#"), F.col("qid").cast("string")), F.concat(F.lit("nation#"), (F.col("qid") % 7).cast("string")))).alias("source"))
    return graph.facts(q, graph.edges(triples(spark, d)), allowed)


def passages(spark: SparkSession, d: str) -> DataFrame:
    """(question_id, passages): the three best, of rows repeated under a new id the first."""
    e = table(spark, d, "evidence").where("rank_no <= 3 and source is not null")
    best = e.groupBy("question_id", F.col("rank_no").alias("rank")).agg(F.min_by(F.struct("source", F.coalesce("chunk", F.lit("")).alias("chunk")), "evidence_id").alias("x")).select("question_id", "rank", "x.*")
    return fusion.retrieved(best, 3)


def fused(spark: SparkSession, d: str) -> DataFrame:
    """One row per question with its passages, two stand-in facts and the best figure of its page."""
    q = table(spark, d, "questions_publaynet_text").where("q is not null")
    f = table(spark, d, "figure").where("image is not null").select(F.concat(F.substring_index("image", "_", 1), F.lit(".txt")).alias("source"), F.struct(F.coalesce("score", F.lit(-1.0)).alias("s"), -F.col("figure_id")).alias("o"), "image", "caption", "score")
    best = f.groupBy("source").agg(F.max_by(F.struct("image", "caption", "score"), "o").alias("figure"))
    facts = F.when(F.col("level").isNotNull(), F.array(F.concat(F.coalesce("type", F.lit("?")), F.lit(" is "), "level"), F.concat(F.lit("level "), "level"))).otherwise(F.array().cast("array<string>"))
    images = F.when(F.col("figure").isNotNull(), F.array(F.struct(F.lit(1).alias("rank"), F.col("figure.image").alias("image_name"), F.col("figure.caption").alias("caption")))).otherwise(F.array().cast("array<struct<rank:int,image_name:string,caption:string>>"))
    return q.join(passages(spark, d), "question_id").join(best, "source", "left").select("question_id", "q", "answer", "passages", facts.alias("facts"), "figure", images.alias("images"), "source", "level")


_FUSED = (
    _PASSAGES
    + """,
figs AS (SELECT string_split(image, '_')[1] || '.txt' AS source, image, caption, score FROM figure WHERE image IS NOT NULL QUALIFY row_number() OVER (PARTITION BY string_split(image, '_')[1] ORDER BY coalesce(score, -1.0) DESC, figure_id) = 1),
texts AS (SELECT question_id, list(source ORDER BY rank_no) AS ranked, string_agg('[' || source || '] ' || chunk, chr(10) || chr(10) ORDER BY rank_no) AS context, string_agg(chunk, chr(10) || chr(10) ORDER BY rank_no) AS bare, string_agg('[' || source || '] ' || substring(chunk, 1, 400), chr(10) || chr(10) ORDER BY rank_no) AS short,
  array_to_string(list_distinct_first(list(source ORDER BY rank_no)), ', ') AS sources, string_agg('      [' || source || '] ' || substring(chunk, 1, 120) || '...', chr(10) ORDER BY rank_no) AS snippets FROM best GROUP BY question_id),
fused AS (SELECT q.question_id, q.q, q.answer, q.source AS expected, q.level, t.* EXCLUDE (question_id), CASE WHEN level IS NULL THEN NULL ELSE '- ' || coalesce(type, '?') || ' is ' || level || chr(10) || '- level ' || level END AS fact_lines, level IS NOT NULL AS has_facts,
  coalesce(type, '?') || ' is ' || level AS fact1, 'level ' || level AS fact2, f.image, f.caption, f.score, '- (' || f.image || ') ' || coalesce(f.caption, '') AS image_line
  FROM questions_publaynet_text q JOIN texts t USING (question_id) LEFT JOIN figs f ON q.source = f.source WHERE q.q IS NOT NULL)"""
)
_FUSED = _FUSED.replace("list_distinct_first(list(source ORDER BY rank_no))", "list_filter(list(source ORDER BY rank_no), lambda x, i: list_position(list(source ORDER BY rank_no), x) = i)")


@query(f"WITH {_FUSED} SELECT question_id, md5('Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || q) AS prompt_md5, md5(short) AS picture_md5 FROM fused")
def q23_context_text(spark: SparkSession, d: str) -> DataFrame:
    f = fused(spark, d)
    return f.select("question_id", F.md5(fusion.user_prompt(F.col("q"), fusion.context(F.col("passages")), plain=True)).alias("prompt_md5"), F.md5(fusion.context(F.col("passages"), cut=fusion.PICTURE_CONTEXT)).alias("picture_md5"))


@query(f"WITH {_FUSED} SELECT question_id, md5('Context passages:' || chr(10) || context || chr(10) || chr(10) || 'Knowledge-graph facts:' || chr(10) || coalesce(fact_lines, '(none)') || chr(10) || chr(10) || 'Question: ' || q) AS prompt_md5, md5(bare || chr(10) || CASE WHEN has_facts THEN fact1 || chr(10) || fact2 ELSE '' END) AS judge_md5 FROM fused")
def q24_context_kg(spark: SparkSession, d: str) -> DataFrame:
    f = fused(spark, d)
    return f.select("question_id", F.md5(fusion.user_prompt(F.col("q"), fusion.context(F.col("passages")), fusion.facts_block(F.col("facts")))).alias("prompt_md5"), F.md5(fusion.judge_context(F.col("passages"), F.col("facts"))).alias("judge_md5"))


@query(f"WITH {_FUSED} SELECT question_id, md5('Text context:' || chr(10) || context || chr(10) || chr(10) || 'Relevant images (described):' || chr(10) || coalesce(image_line, '') || chr(10) || chr(10) || 'Question: ' || q) AS prompt_md5, CASE WHEN image IS NULL THEN 'none' WHEN level = 'hard' THEN 'pixels' ELSE 'caption' END AS delivery FROM fused")
def q25_context_multimodal(spark: SparkSession, d: str) -> DataFrame:
    f = fused(spark, d)
    by = fusion.delivery(F.lit(True), F.coalesce(F.col("level") == "hard", F.lit(False)), F.lit(True), F.col("images"))  # hard ones stand for questions about figures
    return f.select("question_id", F.md5(fusion.user_prompt(F.col("q"), fusion.context(F.col("passages")), images=fusion.image_block(F.col("images"), none=False))).alias("prompt_md5"), by.alias("delivery"))


@query(f"WITH {_FUSED} SELECT question_id, md5('Text context:' || chr(10) || context || chr(10) || chr(10) || 'Knowledge-graph facts:' || chr(10) || coalesce(fact_lines, '(none)') || chr(10) || chr(10) || 'Relevant images (described):' || chr(10) || coalesce(image_line, '(none)') || chr(10) || chr(10) || 'Question: ' || q) AS prompt_md5 FROM fused")
def q26_context_both(spark: SparkSession, d: str) -> DataFrame:
    f = fused(spark, d)
    return f.select("question_id", F.md5(fusion.user_prompt(F.col("q"), fusion.context(F.col("passages")), fusion.facts_block(F.col("facts")), fusion.image_block(F.col("images"), none=True))).alias("prompt_md5"))


_ANSWER = "coalesce(answer, '')"
_L1 = "array_to_string(list_filter(['text[' || sources || ']', CASE WHEN has_facts THEN 'graph[2 facts]' END, 'figure[' || image || ' @CLIP ' || round(coalesce(score, 0.0)::DECIMAL(18, 8), 2) || ']'], lambda x: x IS NOT NULL), ' + ')"
_L3 = """array_to_string(list_filter([{a}, '', 'How I got this:', '  - Text source(s): ' || sources || '  (retrieved by text similarity)', CASE WHEN has_facts THEN '  - Knowledge-graph facts used: 2' END, CASE WHEN has_facts THEN '      • ' || fact1 || chr(10) || '      • ' || fact2 END,
 '  - Figure: ' || image || '  (retrieved by CLIP, score ' || round(coalesce(score, 0.0)::DECIMAL(18, 8), 3) || ')', CASE WHEN image IS NOT NULL THEN '      caption: ' || substring(coalesce(caption, ''), 1, 140) END, '  - Evidence snippets:', snippets], lambda x: x IS NOT NULL), chr(10))""".replace("{a}", _ANSWER)


@query(f"WITH {_FUSED} SELECT question_id, md5({_ANSWER} || chr(10) || chr(10) || 'How I got this: ' || {_L1}) AS level1_md5, md5({_L3}) AS level3_md5 FROM fused")
def q27_explain(spark: SparkSession, d: str) -> DataFrame:
    f = fused(spark, d)
    args = (F.coalesce("answer", F.lit("")), F.col("passages"), F.col("facts"), F.col("figure.image"), F.col("figure.caption"), F.col("figure.score"))
    return f.select("question_id", F.md5(fusion.explanation(1, *args)).alias("level1_md5"), F.md5(fusion.explanation(3, *args)).alias("level3_md5"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions_publaynet_text").where("source is not null")
    ranked = passages(spark, d).select("question_id", fusion.in_order(F.col("passages"), "rank", lambda p: p["source"]).alias("ranked"))
    gold = F.array("source", F.concat(F.lit("x"), "source"), "source")
    return q.join(ranked, "question_id", "left").select("question_id", F.col("source").alias("expected"), F.coalesce("ranked", F.array().cast("array<string>")).alias("ranked"), gold.alias("gold"))


@query(f"WITH {_RANKED}, p AS (SELECT *, coalesce(list_position(ranked, expected), 0) AS r FROM judged) SELECT question_id, (r > 0)::INTEGER AS recall, r::INTEGER AS rank, CASE WHEN r > 0 THEN round(1.0 / r, 6) ELSE 0.0 END::DOUBLE AS mrr, CASE WHEN r > 0 THEN round(1.0 / log2(r + 1.0), 6) ELSE 0.0 END::DOUBLE AS ndcg FROM p")
def q28_recall_mrr_ndcg(spark: SparkSession, d: str) -> DataFrame:
    r, e = F.col("ranked"), F.col("expected")
    return judged(spark, d).select("question_id", metrics.recall_at(r, e).alias("recall"), metrics.first_rank(r, e).alias("rank"), F.round(metrics.reciprocal_rank(r, e), 6).alias("mrr"), F.round(metrics.ndcg(r, e), 6).alias("ndcg"))


@query(f"WITH {_RANKED} SELECT question_id, round(len(list_filter(gold, lambda g: list_contains(ranked, g))) / 3.0, 6)::DOUBLE AS recall, coalesce(round(1.0 / list_min(list_filter(list_transform(gold, lambda g: coalesce(list_position(ranked, g), 0)), lambda p: p > 0)), 6), 0.0)::DOUBLE AS mrr FROM judged")
def q29_partial_recall(spark: SparkSession, d: str) -> DataFrame:
    r, g = F.col("ranked"), F.col("gold")
    return judged(spark, d).select("question_id", F.round(metrics.partial_recall(r, g), 6).alias("recall"), F.round(metrics.best_reciprocal_rank(r, g), 6).alias("mrr"))


@query(f"WITH {_RANKED} SELECT question_id, list_contains(ranked, expected)::INTEGER AS complete_one, 0 AS complete_all, 1 AS complete_none FROM judged")
def q30_complete(spark: SparkSession, d: str) -> DataFrame:
    r, g = F.col("ranked"), F.col("gold")
    return judged(spark, d).select("question_id", metrics.complete(r, F.slice(g, 1, 1)).alias("complete_one"), metrics.complete(r, g).alias("complete_all"), metrics.complete(r, F.slice(g, 1, 0)).alias("complete_none"))


@query("""
WITH r AS (SELECT metric_id, CASE metric_id % 5 WHEN 0 THEN answer_correct::VARCHAR WHEN 1 THEN 'Grade: ' || answer_correct WHEN 2 THEN '10' WHEN 3 THEN ' 1.' ELSE '' END AS reply FROM metrics)
SELECT metric_id, coalesce(starts_with(trim(reply), '1'), false)::INTEGER AS a, coalesce(starts_with(regexp_replace(reply, '[^01]', '', 'g'), '1'), false)::INTEGER AS b, coalesce(regexp_replace(reply, '[^01]', '', 'g') = '1', false)::INTEGER AS c FROM r
""")
def q31_verdicts(spark: SparkSession, d: str) -> DataFrame:
    m, k = table(spark, d, "metrics"), F.col("metric_id") % 5
    reply = F.when(k == 0, F.col("answer_correct").cast("string")).when(k == 1, F.concat(F.lit("Grade: "), F.col("answer_correct").cast("string"))).when(k == 2, "10").when(k == 3, " 1.").otherwise("")
    return m.select("metric_id", *[T.verdict(reply, g).alias(g) for g in "abc"])


@query("""
WITH t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '[["' || s_name || '", "in", "' || s_nationkey || '"], ["x"], 7, ["a", "b", 3]]' WHEN s_suppkey % 3 = 1 THEN '[["' || s_name || '", "in"' ELSE '{"a": 1}' END AS j FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 0 END AS triples, CASE WHEN s_suppkey % 3 = 0 THEN j ->> '$[0][0]' END AS subject, CASE WHEN s_suppkey % 3 = 0 THEN j ->> '$[1][0]' END AS other FROM t
""".replace("j ->> '$[1][0]'", "j ->> '$[3][2]'"))
def q32_json_triples(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    good = F.concat(F.lit('```json\n[["'), "s_name", F.lit('", "in", "'), F.col("s_nationkey").cast("string"), F.lit('"], ["x"], 7, ["a", "b", 3]]\n```'))
    reply = F.when(k == 0, good).when(k == 1, F.concat(F.lit('[["'), "s_name", F.lit('", "in"'))).otherwise('{"a": 1}')
    t = table(spark, d, "supplier").select("s_suppkey", T.json_triples(reply).alias("t"))
    return t.select("s_suppkey", F.size("t").alias("triples"), F.get(F.get("t", F.lit(0)), F.lit(0)).alias("subject"), F.get(F.get("t", F.lit(1)), F.lit(2)).alias("other"))


@query(f"SELECT question_id, regexp_matches(q, '{T.LEAK}') AS leaks, regexp_matches(q, '{T.ORPHAN}') AND NOT regexp_matches(regexp_replace(q, '{T.QUESTION_WORD}', ''), '{T.ANCHOR}') AS orphan FROM questions_publaynet_text")
def q33_leak_orphan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions_publaynet_text").select("question_id", T.leaks_modality(F.col("q")).alias("leaks"), T.has_orphan_reference(F.col("q")).alias("orphan"))


@query("""
SELECT run_id, count(*) AS questions, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(answer_correct), 6) AS acc, round(avg(faithfulness), 6) AS faith, round(avg(answer_relevancy), 6) AS rel,
  count(*) FILTER (answer_correct = 1 AND bleu < 0.3 AND rougel < 0.3) AS diverging FROM metrics GROUP BY run_id
""")
def q35_summary(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "metrics")
    means = [F.round(F.avg(c), 6).alias(n) for c, n in (("recall", "recall"), ("mrr", "mrr"), ("ndcg", "ndcg"), ("answer_correct", "acc"), ("faithfulness", "faith"), ("answer_relevancy", "rel"))]
    return m.groupBy("run_id").agg(F.count("*").alias("questions"), *means, F.count_if(metrics.diverges(F.col("answer_correct"), F.col("bleu"), F.col("rougel"))).alias("diverging"))


_CALLS = "SELECT model, system_name, count(*) AS calls, count(*) FILTER (error <> '') AS errors, bool_or(coalesce(error <> '', false)) AS any_error, round(avg(in_tok), 6) AS mean_in_tok, round(avg(out_tok), 6) AS mean_out_tok, round(avg(latency_ms), 6) AS mean_latency_ms FROM gen_result GROUP BY model, system_name"


def calls(spark: SparkSession, d: str) -> DataFrame:
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    means = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("in_tok", "out_tok", "latency_ms")]
    return table(spark, d, "gen_result").groupBy("model", "system_name").agg(F.count("*").alias("calls"), F.count_if(failed).alias("errors"), F.bool_or(failed).alias("any_error"), *means)


@query(_CALLS)
def q35_call_summary(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d)


@query("SELECT model, system_name, run_id, count(*) AS calls FROM gen_result g WHERE run_id = (SELECT max(run_id) FROM gen_result h WHERE h.model IS NOT DISTINCT FROM g.model AND h.system_name IS NOT DISTINCT FROM g.system_name) GROUP BY ALL")
def q36_latest_run(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gen_result").select("model", "system_name", "run_id", "call_id")
    return report.newest_run(g, ["model", "system_name"]).groupBy("model", "system_name", "run_id").agg(F.count("*").alias("calls"))


@query(f"""WITH s AS ({_CALLS}) SELECT b.model, t.system_name || ' - baseline' AS contrast, b.mean_in_tok AS mean_in_tok_baseline, t.mean_in_tok AS mean_in_tok_target, round(t.mean_in_tok - b.mean_in_tok, 4) AS mean_in_tok_delta,
  b.mean_latency_ms AS mean_latency_ms_baseline, t.mean_latency_ms AS mean_latency_ms_target, round(t.mean_latency_ms - b.mean_latency_ms, 4) AS mean_latency_ms_delta
FROM s b JOIN s t ON b.model = t.model WHERE b.system_name = 'baseline' AND t.system_name IN ('+KG', '+both') AND b.mean_in_tok IS NOT NULL AND t.mean_in_tok IS NOT NULL""")
def q37_kg_delta(spark: SparkSession, d: str) -> DataFrame:
    x = report.deltas(calls(spark, d), ["model"], "system_name", ["mean_in_tok", "mean_latency_ms"], "baseline", ("+KG", "+both"))
    return x.withColumns({c: F.round(c, 4) for c in x.columns if c.endswith("_delta")})


@query(f"WITH s AS ({_CALLS}) SELECT model, any_value(mean_in_tok) FILTER (system_name = 'baseline') AS baseline, any_value(mean_in_tok) FILTER (system_name = '+KG') AS kg, any_value(mean_in_tok) FILTER (system_name = '+multimodal') AS multimodal, any_value(mean_in_tok) FILTER (system_name = '+both') AS both_ FROM s GROUP BY model")
def q38_grid(spark: SparkSession, d: str) -> DataFrame:
    g = report.grid(calls(spark, d), "model", "system_name", "mean_in_tok", list(fusion.SYSTEMS))
    return g.select("model", "baseline", F.col("+KG").alias("kg"), F.col("+multimodal").alias("multimodal"), F.col("+both").alias("both_"))


@query("WITH r AS (SELECT DISTINCT question_id FROM gen_result), p AS (SELECT DISTINCT question_id, model FROM gen_result) SELECT r.question_id, m.name AS model FROM r, (SELECT DISTINCT name FROM model_pricing) m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.question_id IS NOT DISTINCT FROM r.question_id AND p.model = m.name)")
def q39_missing_cells(spark: SparkSession, d: str) -> DataFrame:
    """Registered models that were never asked a question: per question the registry less what it has, so no cross join."""
    names = [r[0] for r in table(spark, d, "model_pricing").select("name").distinct().orderBy("name").collect()]  # the fixed registry
    asked_ = table(spark, d, "gen_result").select("question_id", F.when(F.col("model").isin(names), F.col("model")).alias("model")).distinct()
    have = asked_.groupBy("question_id").agg(F.collect_set("model").alias("have"))  # no more than the registry
    return have.select("question_id", F.explode(F.array_except(F.array(*[F.lit(n) for n in names]), "have")).alias("model"))


@query(f"WITH s AS ({_CALLS}) SELECT system_name, calls, model, CASE system_name WHEN 'baseline' THEN 0 WHEN '+KG' THEN 1 WHEN '+multimodal' THEN 2 WHEN '+both' THEN 3 ELSE 4 END AS place FROM s")
def q40_enum_order(spark: SparkSession, d: str) -> DataFrame:
    s = calls(spark, d)
    return s.select("system_name", "calls", "model", report.enumerated(F.col("system_name"), list(fusion.SYSTEMS)).alias("place")).orderBy("place", "system_name", "model")


_VOCABULARY = "vocabulary AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS word FROM documents) GROUP BY word HAVING count(*) >= 3)"


@query(f"WITH {_VOCABULARY} SELECT * FROM vocabulary")
def q41_vocab_df(spark: SparkSession, d: str) -> DataFrame:
    return audit.vocabulary(table(spark, d, "documents"), "text")


@query(f"""WITH {_VOCABULARY}, h AS (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, list_filter(regexp_extract_all(t, '[A-Za-z]{{3,}}'), lambda x: x <> upper(x)) AS plain, len(regexp_extract_all(t, '[A-Za-z]{{3,}}')) AS n FROM h),
k AS (SELECT doc_id, count(*) AS n, count(v.word) AS known FROM (SELECT doc_id, unnest(list_transform(plain, lambda x: lower(x))) AS word FROM w) x LEFT JOIN vocabulary v USING (word) GROUP BY doc_id)
SELECT doc_id, CASE WHEN w.n = 0 OR regexp_matches(t, '[0-9]') THEN false WHEN len(list_filter(plain, lambda x: substring(x, 2) <> lower(substring(x, 2)))) > 0 THEN true ELSE coalesce((k.n - k.known) / k.n >= 0.5, false) END AS garbled FROM w LEFT JOIN k USING (doc_id)""")
def q42_ocr_garbage(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return audit.garbled(docs, "doc_id", "text", audit.vocabulary(docs, "text"))


@query(f"WITH {_EDGES}, {_ASKED}, top AS (SELECT node, count(DISTINCT qid) AS questions FROM matches GROUP BY node ORDER BY questions DESC, node LIMIT 12) SELECT * FROM top WHERE questions >= greatest(2, 0.1 * (SELECT count(*) FROM asked))")
def q43_match_magnets(spark: SparkSession, d: str) -> DataFrame:
    q = asked(spark, d)
    return audit.match_magnets(graph.node_matches(q, graph.nodes(graph.edges(triples(spark, d)))), q.count())


_LOOSE = "trim(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g'))"
_CONTENT = "list_distinct(list_filter(regexp_split_to_array({c}, ' +'), lambda w: length(w) > 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")))"


@query(f"""
WITH page AS (SELECT image_id || '.txt' AS source, arg_max(page_text, page_id) AS page_text FROM ingest_doclaynet WHERE page_text IS NOT NULL GROUP BY 1),
l AS (SELECT question_id, {_LOOSE.format(c='answer')} AS a, {_LOOSE.format(c='page_text')} AS t FROM questions_publaynet_text q JOIN page USING (source) WHERE answer IS NOT NULL),
c AS (SELECT *, {_CONTENT.format(c='a')} AS aw, {_CONTENT.format(c='t')} AS tw FROM l)
SELECT question_id, coalesce((a <> '' AND contains(t, a)) OR (len(aw) > 0 AND len(list_intersect(aw, tw)) >= 0.6 * len(aw)), false) AS in_page FROM c
""")
def q44_answer_in_page(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "ingest_doclaynet").where("page_text is not null and image_id is not null").groupBy(F.concat("image_id", F.lit(".txt")).alias("source")).agg(F.max_by("page_text", "page_id").alias("page_text"))
    q = table(spark, d, "questions_publaynet_text").where("answer is not null").select("question_id", "answer", "source")
    return q.join(p, "source").select("question_id", T.answer_in_text(F.col("answer"), F.col("page_text")).alias("in_page"))


@query(f"""
WITH e AS (SELECT question_id, bool_or(contains({_LOOSE.format(c='chunk')}, {_LOOSE.format(c='answer')}) AND {_LOOSE.format(c='answer')} <> '') AS in_any, bool_or(rank_no <= 3 AND contains({_LOOSE.format(c='chunk')}, {_LOOSE.format(c='answer')}) AND {_LOOSE.format(c='answer')} <> '') AS in_top FROM questions_publaynet_text JOIN evidence USING (question_id) GROUP BY question_id)
SELECT count(*) AS total, count(*) FILTER (in_any) AS in_any, count(*) FILTER (in_any AND in_top) AS in_top FROM e
""")
def q44_answer_funnel(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions_publaynet_text").select("question_id", T.loose(F.col("answer")).alias("a"))
    hit = F.contains(T.loose(F.col("chunk")), F.col("a")) & (F.col("a") != "")
    e = q.join(table(spark, d, "evidence").select("question_id", "rank_no", "chunk"), "question_id").groupBy("question_id").agg(F.bool_or(hit).alias("in_any"), F.bool_or(hit & (F.col("rank_no") <= 3)).alias("in_top"))
    return audit.funnel(e, ["in_any", "in_top"])


_TIGHT = "regexp_replace(lower({c}), '[^a-z0-9.%±]', '', 'g')"


@query(f"""
WITH cap AS (SELECT string_split(image, '_')[1] || '.txt' AS source, arg_min(caption, figure_id) AS caption FROM figure WHERE image IS NOT NULL AND caption IS NOT NULL GROUP BY 1),
r AS (SELECT q.type, q.answer, cap.caption, substring({_TIGHT.format(c='q.answer')}, 1, 14) AS probe, {_TIGHT.format(c='cap.caption')} AS c FROM questions_publaynet_text q LEFT JOIN cap USING (source) WHERE q.answer IS NOT NULL)
SELECT type, count(*) AS questions, count(caption) AS covered, count(*) FILTER (CASE WHEN answer = '' THEN false ELSE length(regexp_replace(answer, '[^0-9]', '', 'g')) / length(answer) > 0.15 END) AS numeric_like, round(avg(length(answer)), 6) AS mean_length, count(*) FILTER (probe <> '' AND contains(c, probe)) AS in_caption,
  round(avg(len(string_split(caption, ' '))), 6) AS caption_words FROM r GROUP BY type
""")
def q45_caption_audit(spark: SparkSession, d: str) -> DataFrame:
    cap = table(spark, d, "figure").where("image is not null and caption is not null").groupBy(F.concat(F.substring_index("image", "_", 1), F.lit(".txt")).alias("source")).agg(F.min_by("caption", "figure_id").alias("caption"))
    r = table(spark, d, "questions_publaynet_text").where("answer is not null").join(cap, "source", "left")
    probe = F.substring(T.loose_caption(F.col("answer")), 1, 14)
    return r.groupBy("type").agg(
        F.count("*").alias("questions"), F.count("caption").alias("covered"), F.count_if(T.numeric_ratio(F.col("answer")) > 0.15).alias("numeric_like"), F.round(F.avg(F.length("answer")), 6).alias("mean_length"),
        F.count_if((probe != "") & F.contains(T.loose_caption(F.col("caption")), probe)).alias("in_caption"), F.round(F.avg(F.when(F.col("caption").isNotNull(), F.size(F.split("caption", " ")))), 6).alias("caption_words"))


@query("WITH c AS (SELECT run_id, avg(in_tok) AS tok FROM gen_result WHERE system_name = 'baseline' GROUP BY run_id), m AS (SELECT run_id, avg(answer_correct) AS acc FROM metrics GROUP BY run_id) SELECT run_id, round(acc, 6) AS acc, round(tok, 6) AS mean_in_tok FROM c JOIN m USING (run_id) WHERE acc IS NOT NULL AND tok IS NOT NULL")
def q46_cost_quality(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "gen_result").where("system_name = 'baseline'").groupBy("run_id").agg(F.round(F.avg("in_tok"), 6).alias("mean_in_tok"))
    m = table(spark, d, "metrics").groupBy("run_id").agg(F.round(F.avg("answer_correct"), 6).alias("acc"))
    return c.join(m, "run_id").where("acc is not null and mean_in_tok is not null").select("run_id", "acc", "mean_in_tok")


@query("SELECT page_id FROM ingest_doclaynet WHERE page_id NOT IN (SELECT page_id FROM figure WHERE page_id IS NOT NULL)")
def q47_resume_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ingest_doclaynet").select("page_id").join(table(spark, d, "figure").select("page_id"), "page_id", "left_anti")


@query(f"""
WITH c AS (SELECT question_id, md5('42:' || question_id) AS place, NOT regexp_matches(q, '{T.LEAK}') AS accepted FROM questions_publaynet_text WHERE q IS NOT NULL ORDER BY place LIMIT 60),
b AS (SELECT *, coalesce(sum(accepted::INTEGER) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT question_id, place, accepted FROM b WHERE before < 10
""")
def q48_attempt_budget(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "questions_publaynet_text").where("q is not null").select("question_id", report.seeded(42, F.col("question_id")).alias("place"), (~T.leaks_modality(F.col("q"))).alias("accepted"))
    return report.attempt_budget(c, ["place"], "accepted", 10)


# Names and tiers of the nine metrics.
NINE = {
    "recall": ("Recall@3", "primary_retrieval"), "mrr": ("MRR", "primary_retrieval"), "ndcg": ("NDCG@3", "primary_retrieval"), "answer_correct": ("AnswerAccuracy", "primary_generation"), "faithfulness": ("Faithfulness", "primary_generation"),
    "answer_relevancy": ("AnswerRelevancy", "primary_generation"), "bleu": ("BLEU", "comparability_excluded"), "rougel": ("ROUGE-L", "comparability_excluded"), "bertscore_f1": ("BERTScore_F1", "comparability_excluded"),
}


@query(" UNION ALL ".join(f"SELECT run_id, '{label}' AS metric, '{tier}' AS tier, round(avg({c}), 6) AS value FROM metrics GROUP BY run_id" for c, (label, tier) in NINE.items()))
def q49_nine_metric_long(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "metrics").groupBy("run_id").agg(*[F.round(F.avg(c), 6).alias(c) for c in NINE])
    return report.long_form(wide, ["run_id"], NINE)


@query(_RUNS)
def q50_stream_runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return streams.streamed_runs(spark, f"{d}/events*.parquet", e, "event_id", "event_type")


@query("SELECT DISTINCT event_id, user_id FROM events")
def q51_stream_resume(spark: SparkSession, d: str) -> DataFrame:
    like = table(spark, d, "events").select("event_id", "user_id")
    return streams.resumed(spark, f"{d}/events*.parquet", like, ["event_id", "user_id"], "resume")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def q52_event_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.event_windows(table(spark, d, "events"), "ts", "event_type", "1 hour", "1 day").select(F.col("window.start").alias("start"), "event_type", "n")


@query()
def n1_overlap_scores(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "metrics").where("expected is not null and generated is not null")
    return m.select("metric_id", metrics.bleu("generated", "expected").alias("bleu"), metrics.rouge_l("generated", "expected").alias("rouge_l"), metrics.token_f1("generated", "expected").alias("token_f1"))


@query()
def n2_stub_answers(spark: SparkSession, d: str) -> DataFrame:
    f = fused(spark, d)
    prompts = f.select("question_id", fusion.user_prompt(F.col("q"), fusion.context(F.col("passages")), plain=True).alias("prompt"))
    return providers.called(prompts, "question_id", "prompt").select("question_id", "text", "in_tok", "error")


@query()
def n3_stub_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Ask: embed questions and pages with the stub, rank, and score against the page each question was made from."""
    pages = table(spark, d, "ingest_doclaynet").where("page_text is not null").groupBy("image_id").agg(F.max_by("page_text", "page_id").alias("page_text"))
    corpus = providers.embedded(pages, "image_id", "page_text").withColumnRenamed("image_id", "id")
    asked_ = table(spark, d, "questions_publaynet_text").where("q is not null and question_id % 50 = 0")
    found = knn.top_k(providers.embedded(asked_, "question_id", "q").withColumnRenamed("question_id", "qid"), corpus, 3, keep_self=True)
    return found.join(asked_.select(F.col("question_id").alias("qid"), "source"), "qid").select("qid", "rank", "id", (F.concat("id", F.lit(".txt")) == F.col("source")).alias("hit"))


@query()
def n4_unicode_filenames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions_publaynet_text").select("question_id", safe_name("q").alias("file_name"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Exact retrieval over the embeddings, scored by whether neighbours share the query's label."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    n = neighbours(spark, d, 3).join(labels.withColumnRenamed("vec_id", "id"), "id").join(labels.select(F.col("vec_id").alias("qid"), F.col("label").alias("wanted")), "qid")
    best = n.groupBy("qid").agg(F.min(F.when(F.col("label") == F.col("wanted"), F.col("rank"))).alias("r"))
    return best.agg(F.count("*").alias("queries"), F.avg(F.col("r").isNotNull().cast("double")).alias("recall_at_3"), F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce(1.0 / F.log2(F.col("r") + 1.0), F.lit(0.0))).alias("ndcg_at_3"))


from cairnlight.plans import composites  # noqa: E402, F401 - adds its queries
