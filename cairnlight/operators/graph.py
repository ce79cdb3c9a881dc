"""Fact graph: edges, nodes, whole-word node lookup and one-hop facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlight.functions.text import SPACE

SHORTEST, MOST_FACTS = 5, 8
WORDY = r"^[\p{L}\p{N}_]+(?: [\p{L}\p{N}_]+)*$"


def _node(c):  # noqa: ANN001, ANN202
    return F.lower(F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", ""))


def edges(triples: DataFrame) -> DataFrame:
    """(src, dst, relation, source, first_ord, last_ord): of equal (subject, object) the last triple wins."""
    t = triples.select(_node(F.col("subject")).alias("src"), _node(F.col("object")).alias("dst"), "relation", "source", "triple_ord")
    last = F.max_by(F.struct("relation", "source"), "triple_ord")
    return t.groupBy("src", "dst").agg(last.alias("x"), F.min("triple_ord").alias("first_ord"), F.max("triple_ord").alias("last_ord")).select("src", "dst", "x.relation", "x.source", "first_ord", "last_ord")


def nodes(edge: DataFrame) -> DataFrame:
    """(node, node_ord): in first-seen order, the subject of a triple before its object."""
    ends = edge.select(F.explode(F.array(F.struct(F.col("src").alias("node"), (2 * F.col("first_ord")).alias("o")), F.struct(F.col("dst").alias("node"), (2 * F.col("first_ord") + 1).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.min("o").alias("node_ord"))


def degrees(edge: DataFrame) -> DataFrame:
    """(node, degree): in plus out; a self-loop counts twice."""
    return edge.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def _runs_of(n: int):  # noqa: ANN202
    return F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))


def node_matches(questions: DataFrame, node: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(qid, node, node_ord) where the node stands as whole words in the question.

    Nodes of plain words are found by joining the question's word n-grams to them on
    equality (only for the sizes nodes have). Nodes with other characters are joined by the
    word of theirs that the fewest nodes have, then asked as a whole; those without any word,
    of marks alone, cannot stand as whole words and match nothing.
    """
    long = node.where(F.char_length("node") >= shortest)
    asked = questions.select("qid", F.lower("q").alias("t"))
    plain = long.where(F.col("node").rlike(WORDY)).withColumn("size", F.size(F.split("node", " ")))
    sizes = [r[0] for r in plain.select("size").distinct().collect()]  # a few small numbers
    words = asked.select("qid", F.split("t", r"(?U)[^\w]").alias("w"))
    grams = None
    for n in sizes:
        g = words.where(F.size("w") >= n).select("qid", F.explode(F.array_distinct(_runs_of(n))).alias("node"))
        grams = g if grams is None else grams.unionByName(g)
    hits = None
    if grams is not None:
        # slices of words may bridge other characters than one space, so the text is asked again
        near = grams.join(plain.select("node", "node_ord"), "node").join(asked, "qid")
        hits = near.where(F.expr(r"t rlike concat('(?U)\\b\\Q', node, '\\E\\b')")).select("qid", "node", "node_ord").distinct()
    odd = long.where(~F.col("node").rlike(WORDY)).select("node", "node_ord", F.explode(F.array_distinct(F.filter(F.split("node", r"(?U)[^\w]+"), lambda x: x != ""))).alias("word"))
    spread_ = odd.groupBy("word").agg(F.count("*").alias("n"))
    rarest = odd.join(spread_, "word").groupBy("node", "node_ord").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    said = words.select("qid", F.explode(F.array_distinct(F.filter("w", lambda x: x != ""))).alias("word"))
    other = said.join(rarest, "word").join(asked, "qid").where(F.expr(r"t rlike concat('(?U)\\b', regexp_replace(node, '([^\\p{L}\\p{N}_ ])', '\\\\$1'), '\\b')")).select("qid", "node", "node_ord").distinct()
    return other if hits is None else hits.unionByName(other)


def facts(questions: DataFrame, edge: DataFrame, allowed: DataFrame | None = None, most: int | None = MOST_FACTS, shortest: int = SHORTEST) -> DataFrame:
    """(qid, rank, fact, source): per matched node, in its order, out-facts then in-facts by first
    insertion; repeated texts keep their first place. allowed (qid, source) restricts them before the cap."""
    hit = node_matches(questions, nodes(edge), shortest)
    text = F.concat_ws(" ", "src", "relation", "dst")
    out = hit.join(edge, F.col("node") == F.col("src")).select("qid", "node_ord", F.lit(0).alias("way"), "first_ord", text.alias("fact"), "source")
    into = hit.join(edge, F.col("node") == F.col("dst")).select("qid", "node_ord", F.lit(1).alias("way"), "first_ord", text.alias("fact"), "source")
    all_ = out.unionByName(into)
    if allowed is not None:
        all_ = all_.join(allowed.select("qid", "source").distinct(), ["qid", "source"], "left_semi")
    first = all_.groupBy("qid", "fact").agg(F.min(F.struct("node_ord", "way", "first_ord", "source")).alias("at"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("at.node_ord", "at.way", "at.first_ord", "fact")))
    return (ranked if most is None else ranked.where(F.col("rank") <= most)).select("qid", "rank", "fact", F.col("at.source").alias("source"))
