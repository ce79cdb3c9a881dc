"""Ranking metrics as Column expressions and text-overlap metrics as Arrow functions."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlight.functions.vectors import inner_product

LOW = 0.3  # an overlap below this counts as low


def first_rank(ranked: Column, expected: Column) -> Column:
    """1-based place of the expected source, 0 where it is absent; null rankings count as empty."""
    return F.coalesce(F.array_position(ranked, expected), F.lit(0)).cast("int")


def recall_at(ranked: Column, expected: Column) -> Column:
    return (first_rank(ranked, expected) > 0).cast("int")


def reciprocal_rank(ranked: Column, expected: Column) -> Column:
    r = first_rank(ranked, expected)
    return F.when(r > 0, 1.0 / r).otherwise(0.0)


def ndcg(ranked: Column, expected: Column) -> Column:
    r = first_rank(ranked, expected)
    return F.when(r > 0, 1.0 / F.log2(r + 1.0)).otherwise(0.0)


def partial_recall(ranked: Column, gold: Column) -> Column:
    """Share of the gold list (repeats count) that the ranking holds."""
    return F.when(F.size(gold) > 0, F.size(F.filter(gold, lambda g: F.array_contains(ranked, g))) / F.size(gold)).otherwise(0.0)


def best_reciprocal_rank(ranked: Column, gold: Column) -> Column:
    places = F.filter(F.transform(gold, lambda g: F.array_position(ranked, g)), lambda p: p > 0)
    return F.when(F.size(places) > 0, 1.0 / F.array_min(places)).otherwise(0.0)


def complete(ranked: Column, gold: Column) -> Column:
    """Whether every gold source was found; an empty gold list is complete."""
    return F.forall(gold, lambda g: F.array_contains(ranked, g)).cast("int")


def _pieces(text: str) -> list[str]:
    """Tokens of the international-standard BLEU splitting: punctuation apart, but not inside numbers."""
    t = f" {text} "
    t = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", t)
    t = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", t)
    t = re.sub(r"([\.,])([^0-9])", r" \1 \2", t)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", t).split()


def bleu_of(hypothesis: str, reference: str, order: int = 4) -> float:
    """Sentence BLEU in [0, 1] with effective order and exponential smoothing."""
    h, r = _pieces(hypothesis), _pieces(reference)
    if not h or not r:
        return 0.0
    logs, smooth, used = 0.0, 1.0, 0
    for n in range(1, min(order, len(h)) + 1):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (h, r))
        total, hit = sum(a.values()), sum((a & b).values())
        used += 1
        if hit == 0:
            smooth *= 2
            p = 1.0 / (smooth * total)
        else:
            p = hit / total
        logs += math.log(p)
    if not set(h) & set(r):
        return 0.0
    brevity = 1.0 if len(h) >= len(r) else math.exp(1 - len(r) / len(h))
    return brevity * math.exp(logs / used)


def _measure(stem_: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return len(re.findall("v+c+", _kinds(stem_)))


def _kinds(w: str) -> str:
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or c == "y" and i > 0 and out[-1] == "c" else "c"
    return out


def _short(w: str) -> bool:
    """Ends consonant, vowel, consonant (but w, x, y), or is a vowel and a consonant."""
    return _kinds(w)[-3:] == "cvc" and w[-1] not in "wxy" or len(w) == 2 and _kinds(w) == "vc"


# The suffixes of the second, third and fourth step and what stands for them.
_SECOND = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"))
_THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
_ODD = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}


@functools.lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    """The suffix-stripping stemmer of Porter with its common extensions; words of up to three letters stay."""
    if w in _ODD:
        return _ODD[w]
    if len(w) <= 3:
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    w = _past(w)
    if w.endswith("y") and len(w) > 2 and _kinds(w)[-2] == "c":
        w = w[:-1] + "i"
    for table in (_SECOND, _THIRD):
        hit = max((p for p in table if w.endswith(p[0])), key=lambda p: len(p[0]), default=None)
        if hit and _measure(w[: len(w) - len(hit[0]) + (hit[0] == "logi")]) > 0:
            w = w[: -len(hit[0])] + hit[1]
            if hit[0] == "alli":
                w = stem_second(w)
    last = max((x for x in _FOURTH if w.endswith(x)), key=len, default="")
    base = w[: len(w) - len(last)]
    if last and _measure(base) > 1 and (last != "ion" or base[-1:] in "st"):
        w = base
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def stem_second(w: str) -> str:
    """The second step once more."""
    hit = max((p for p in _SECOND if w.endswith(p[0])), key=lambda p: len(p[0]), default=None)
    return w[: -len(hit[0])] + hit[1] if hit and _measure(w[: -len(hit[0])]) > 0 else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        base = w[: -len(suffix)]
        if w.endswith(suffix) and "v" in _kinds(base):
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if len(base) > 1 and base[-1] == base[-2] and base[-1] not in "aeioulsz":
                return base[:-1]
            return base + "e" if _measure(base) == 1 and _short(base) else base
    return w


def rouge_l_of(hypothesis: str, reference: str) -> float:
    """F-measure of the longest common subsequence of stemmed words."""
    a, b = ([stem(t) if len(t) > 3 else t for t in re.findall(r"[a-z0-9]+", x.lower())] for x in (hypothesis, reference))
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    p, r = row[-1] / len(a), row[-1] / len(b)
    return 2 * p * r / (p + r) if p + r else 0.0


def token_f1_of(hypothesis: str, reference: str) -> float:
    a, b = (Counter(re.findall(r"\w+", x.lower())) for x in (hypothesis, reference))
    hit = sum((a & b).values())
    return 2 * hit / (sum(a.values()) + sum(b.values())) if hit else 0.0


def _pairwise(f):  # noqa: ANN001, ANN202
    @F.pandas_udf(T.DoubleType())
    def run(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
        return pd.Series([None if h is None or r is None else f(h, r) for h, r in zip(hypothesis, reference)], dtype="float64")

    return run


bleu, rouge_l, token_f1 = _pairwise(bleu_of), _pairwise(rouge_l_of), _pairwise(token_f1_of)


def greedy_match(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(pair, precision, recall, f1): each token of one side against its nearest of the other, by cosine.

    pairs has pair, hypothesis and reference (texts); tokens has token and v, unit vectors. Tokens
    without a vector match only themselves."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    side = lambda name: pairs.select("pair", F.posexplode(words(name)).alias("i", "token")).join(tokens, "token", "left").select("pair", "i", "token", "v")
    h, r = side("hypothesis").alias("h"), side("reference").alias("r")
    score = F.when(F.col("h.token") == F.col("r.token"), 1.0).otherwise(F.coalesce(inner_product("h.v", "r.v"), F.lit(0.0)))
    both = h.join(r, F.col("h.pair") == F.col("r.pair")).select(F.col("h.pair").alias("pair"), F.col("h.i").alias("hi"), F.col("r.i").alias("ri"), score.alias("s"))
    best = lambda i: both.groupBy("pair", i).agg(F.max("s").alias("s")).groupBy("pair").agg(F.avg("s").alias("m"))
    x = best("hi").withColumnRenamed("m", "precision").join(best("ri").withColumnRenamed("m", "recall"), "pair")
    p, c = F.col("precision"), F.col("recall")
    return x.select("pair", "precision", "recall", F.when(p + c > 0, 2 * p * c / (p + c)).otherwise(0.0).alias("f1"))


def diverges(correct: Column, bleu_score: Column, rouge_score: Column) -> Column:
    """Judged correct although both overlaps are low."""
    return (correct == 1) & (bleu_score < LOW) & (rouge_score < LOW)
