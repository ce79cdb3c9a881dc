"""Text functions as Column expressions; everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"  # exactly what the source language counts as whitespace
CHUNK, OVERLAP = 500, 50

# The stop words of the loose answer matcher.
STOP_WORDS = ("the", "a", "an", "of", "in", "for", "to", "and", "or", "is", "was", "are", "were", "with", "by", "at", "on", "that", "this", "it", "as", "from", "be", "been", "has", "have", "had", "which", "who", "used")
# Words that give away the modality, generic references, and what anchors them.
LEAK = r"(?i)\b(figure|fig\.?|chart|image|graph|table|diagram|plot|panel|shown|depicted|illustrat|pictured|above|below|visual)\b"
ORPHAN = (
    r"(?i)\b(?:the|this|these|those|that)\s+(?:[\w-]+\s+){0,2}(stud(?:y|ies)|paper|article|workshop|trial|survey|experiment|interviews?|questionnaires?|participants?|patients?|subjects?|"
    r"cohort|sample|authors?|researchers?|analysis|research|investigation|project|programme|program|intervention|dataset|data\s?set|model|method|approach|framework|work|review|report|findings?|results?)\b"
)
ANCHOR = r"[A-Z][a-z]{2,}|\b\d{4}\b|\b\d+(?:\.\d+)?\s?(?:%|mg|ml|kg|mm|cm|µg|nm|mmol|units?|years?|months?|weeks?|days?)\b"
QUESTION_WORD = r"(?i)^\s*(what|how|which|when|where|who|why)\b"


def normalised(text: Column) -> Column:
    """Every stretch of whitespace to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def chunked(df: DataFrame, keys: list[str], text: str, size: int = CHUNK, overlap: int = OVERLAP, mode: str = "compat") -> DataFrame:
    """(keys..., chunk_ord, chunk) of fixed-size windows over the normalised text.

    Null and empty texts give no chunk. mode 'compat' keeps a last window that lies wholly
    in the overlap of the one before; 'corrected' drops it.
    """
    t = normalised(F.col(text))
    step = size - overlap
    last = F.length("_t") - 1 if mode == "compat" else F.greatest(F.lit(0), F.length("_t") - overlap - 1)
    spans = df.select(*keys, t.alias("_t")).where(F.length("_t") > 0).select(*keys, "_t", F.posexplode(F.sequence(F.lit(0), last, F.lit(step))).alias("chunk_ord", "_s"))
    return spans.select(*keys, "chunk_ord", F.substring(F.col("_t"), F.col("_s") + 1, F.lit(size)).alias("chunk"))


def chunk_key(chunk: Column) -> Column:
    return F.md5(chunk)


def starts_mid_sentence(chunk: Column) -> Column:
    """The first character is not an upper-case letter."""
    return ~chunk.rlike(r"^\p{Lu}")


def ends_mid_sentence(chunk: Column) -> Column:
    return ~chunk.rlike(r"[.!?]$")


def verdict(reply: Column, grammar: str) -> Column:
    """1 or 0 from a judge's reply. 'a': starts with 1; 'b': of its 0s and 1s the first is 1; 'c': they are exactly '1'. Null replies are 0."""
    reply = F.coalesce(reply, F.lit(""))
    digits = F.regexp_replace(reply, "[^01]", "")
    yes = {"a": F.regexp_replace(reply, f"^{SPACE}+", "").startswith("1"), "b": digits.startswith("1"), "c": digits == "1"}[grammar]
    return yes.cast("int")


def unfenced(text: Column) -> Column:
    """Markdown fences on lines of their own removed."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?m)^```(?:json)?|```$", ""))


def json_items(text: Column) -> Column:
    """The elements of a JSON array as raw JSON strings; null where the text is no array."""
    return F.from_json(unfenced(text), "array<string>")


def json_triples(text: Column) -> Column:
    """The three-element lists in a JSON array as arrays of strings; bad JSON gives an empty array."""
    parsed = F.transform(F.coalesce(json_items(text), F.array().cast("array<string>")), lambda x: F.from_json(x, "array<string>"))
    return F.filter(parsed, lambda x: x.isNotNull() & (F.size(x) == 3))


def authored(reply: Column) -> Column:
    """(q, answer) of an author's JSON reply; null for bad JSON, a missing question or answer, and SKIP."""
    x = F.from_json(unfenced(reply), "q string, answer string")
    return F.when(x["q"].isNotNull() & x["answer"].isNotNull() & (x["q"] != "SKIP"), x)


def estimated_tokens(text: Column, by: str = "characters") -> Column:
    """About four characters a token, or 1.3 tokens a word."""
    if by == "characters":
        return F.floor(F.length(text) / 4)
    return F.floor(F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != "")) * 1.3)


def loose(text: Column) -> Column:
    """Lower case, all but letters, digits and spaces turned into spaces (which are not collapsed)."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "))


def loose_caption(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9.%±]", "")


def content_words(text: Column) -> Column:
    words = F.split(loose(text), " +")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def answer_in_text(answer: Column, text: Column, threshold: float = 0.6) -> Column:
    """The loose answer is a part of the loose text, or enough of its content words are."""
    a, words = loose(answer), content_words(answer)
    some = F.size(F.array_intersect(words, content_words(text))) >= threshold * F.size(words)
    return F.coalesce(((a != "") & F.contains(loose(text), a)) | ((F.size(words) > 0) & some), F.lit(False))


def numeric_ratio(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, "[^0-9]", "")) / F.length(text)).otherwise(0.0)


def leaks_modality(question: Column) -> Column:
    return question.rlike(LEAK)


def has_orphan_reference(question: Column) -> Column:
    """A generic reference without a proper noun, year or quantity to pin it down."""
    return question.rlike(ORPHAN) & ~F.regexp_replace(question, QUESTION_WORD, "").rlike(ANCHOR)


def row_sentence(columns: list[str]) -> Column:
    """'name: value | name: value' of a row; missing cells print None."""
    return F.concat_ws(" | ", *[F.concat(F.lit(c + ": "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in columns])


def safe_float(c: Column) -> Column:
    return c.try_cast("double")


def fingerprint(df: DataFrame, name: str, *values: str) -> DataFrame:
    """One row: 16 hex digits over the sorted 'name:value:...' of all rows.

    Digests of the rows are made in parallel and summed per bucket of the name's hash, so no
    task sees more than BUCKETS strings; two corpora differ in it unless MD5 collides.
    """
    row = F.md5(F.concat_ws(":", name, *values))
    halves = [F.conv(F.substring(row, s, 8), 16, 10).cast("long") for s in (1, 9, 17, 25)]
    buckets = df.select(F.pmod(F.xxhash64(name), F.lit(BUCKETS)).alias("b"), *[h.alias(f"h{i}") for i, h in enumerate(halves)]).groupBy("b").agg(*[F.sum(f"h{i}").alias(f"h{i}") for i in range(4)], F.count("*").alias("n"))
    return buckets.agg(F.sum("n").alias("rows"), F.substring(F.md5(F.concat_ws(":", *[F.coalesce(F.sum(f"h{i}"), F.lit(0)).cast("string") for i in range(4)], F.coalesce(F.sum("n"), F.lit(0)).cast("string"))), 1, 16).alias("fingerprint"))


BUCKETS = 1024
