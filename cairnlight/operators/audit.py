"""Read-only audits of corpora, graphs and question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlight.functions import text as T


def vocabulary(texts: DataFrame, text: str, least: int = 3) -> DataFrame:
    """(word, df): document frequency of three-letter-or-longer words."""
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") >= least)


def garbled(texts: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(key, garbled): no words or a digit - no; a capital inside a word - yes; else half or more of
    the words that are no acronyms are unknown. The vocabulary is joined, never collected."""
    words = F.regexp_extract_all(F.col(text), F.lit("[A-Za-z]{3,}"), F.lit(0))
    t = texts.select(key, F.col(text).alias("_t"), words.alias("_w"))
    plain = F.filter("_w", lambda w: w != F.upper(w))
    t = t.withColumn("_inner", F.exists(plain, lambda w: F.substring(w, 2, 1000) != F.lower(F.substring(w, 2, 1000)))).withColumn("_check", F.transform(plain, F.lower))
    asked = t.where((F.size("_w") > 0) & ~F.col("_t").rlike("[0-9]") & ~F.col("_inner")).select(key, F.posexplode("_check").alias("_p", "word"))
    known = asked.join(vocabulary.select("word", F.lit(1).alias("known")), "word", "left").groupBy(key).agg(F.count("*").alias("_n"), F.count("known").alias("_k"))
    unknown = (F.col("_n") - F.col("_k")) / F.col("_n") >= 0.5
    out = t.join(known, key, "left")
    verdict = F.when((F.size("_w") == 0) | F.col("_t").rlike("[0-9]"), False).when(F.col("_inner"), True).otherwise(F.coalesce(unknown, F.lit(False)))
    return out.select(key, verdict.alias("garbled"))


def boundary_damage(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Chunks that begin or end inside a sentence."""
    c = F.col("chunk")
    return chunks.groupBy(*by).agg(F.count("*").alias("chunks"), F.count_if(T.starts_mid_sentence(c)).alias("starts_mid"), F.count_if(T.ends_mid_sentence(c)).alias("ends_mid"))


def match_magnets(matches: DataFrame, questions: int, most: int = 12) -> DataFrame:
    """The nodes matched by most questions, of the first `most` those with at least 2 and 10 %."""
    top = matches.groupBy("node").agg(F.countDistinct("qid").alias("questions")).orderBy(F.desc("questions"), "node").limit(most)
    return top.where(F.col("questions") >= max(2.0, 0.1 * questions))


def funnel(rows: DataFrame, stages: list[str]) -> DataFrame:
    """Counts of rows that pass each boolean stage (and all before it)."""
    passed, cols = F.lit(True), [F.count("*").alias("total")]
    for s in stages:
        passed = passed & F.coalesce(F.col(s), F.lit(False))
        cols.append(F.count_if(passed).alias(s))
    return rows.agg(*cols)


def known_words(dictionary: DataFrame, corpus: DataFrame) -> DataFrame:
    """(word): the dictionary's words of three letters or more, trimmed and in lower case, and the corpus vocabulary."""
    words = dictionary.select(F.lower(F.trim("word")).alias("word")).where(F.length("word") > 2)
    return words.unionByName(corpus.select("word")).distinct()


def fact_statistics(facts: DataFrame, questions: int) -> DataFrame:
    """facts has qid and garbled, a row each; one row: questions, those with facts, mean facts of these, garbled percent."""
    one = facts.agg(F.countDistinct("qid").alias("with_facts"), F.count("*").alias("facts"), F.count_if("garbled").alias("garbled"))
    return one.select(F.lit(questions).alias("questions"), "with_facts", F.expr("try_divide(facts, with_facts)").alias("mean_facts"), F.expr("try_divide(100.0D * garbled, facts)").alias("garbled_percent"))


def bottleneck(counts: DataFrame, stages: tuple[str, str, str], least: float = 0.4) -> DataFrame:
    """One row of counts per stage with the share that passes the second and the third, and which of them loses
    most: 'extraction' or 'retrieval' where less than `least` passes, else 'neither'. An empty stage passes nothing."""
    a, b, c = stages
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    x = counts.select(*stages, share(b, a).alias("extract_rate"), share(c, b).alias("retrieve_rate"))
    return x.withColumn("verdict", F.when(F.col("extract_rate") < least, "extraction").when(F.col("retrieve_rate") < least, "retrieval").otherwise("neither"))
