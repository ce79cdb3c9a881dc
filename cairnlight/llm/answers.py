"""Defective prompt and response pairs.

Method: the languages of prompt and response are compared by the posteriors of a naive
Bayes model over character trigrams, trained on labelled texts; a response that breaks off
is told by the likelihood that a text ends where it ends, taken from the n-grams before
all ends and all other places of the responses themselves: first of words (function words
as they are, others as classes), then of the characters of the last word.
The likelihood of a longer context leans on that of the next shorter one by STRENGTH
places, so it means the same in small and large corpora. Refusals are told by a word n-gram
model of declining phrases (refusals.py); copies and stand-ins for nothing by rules.

One defect at most per pair, looked for in this order: empty, copied, refusal, language,
truncated. A null response is empty; a null prompt rules out only 'copied' and 'language'.
Rows with equal keys are reported each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlight.llm.quality import COMMON
from cairnlight.llm.refusals import Refusals, declines, model
from cairnlight.session import spread, stored

SAMPLE = 400  # labelled texts per language that the language model may see
TEXT_CHARS = 4000  # training characters taken from one of them
ORDER = 6  # words of context before an end
PRIOR, FEW, STRENGTH = 0.5, 8.0, 120.0  # the likelihood before all, the places it counts for, and those a shorter context counts for in a longer one
END = 0.2  # a response whose last context ends texts less often than this breaks off
WORD_END = 0.02  # likewise for a last word that elsewhere begins longer words
MARGIN = 7.0  # log odds by which a response must be in another language
CLEAR = 2.0  # log odds by which the prompt must be in its own

# Stand-ins for nothing.
NOTHING = frozenset("n/a na n.a. none null nil nan nothing empty blank tbd unknown undefined k.a. no_answer s/o nd n.d. not_available no_response".split())
_LABEL = regex.compile(r"^\s*(?:q|a|question|answer|frage|antwort|réponse|pregunta|respuesta|prompt)\s*[:.]\s*", regex.I)
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_LETTERS = regex.compile(r"\p{L}+")
_TOKENS = regex.compile(r"[<>]?[+-]?\d[\d.,:/]*|[\p{L}\p{M}'’-]+|[^\s\p{L}\p{M}\d]")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Cc}--\n\t]", regex.V1)
_DONE = regex.compile(r"[.!?。！？)\]\"”’»]\s*$")
_OPEN = regex.compile(r"(?:…|\.\.\.|[,(=\[{:;–—/]|\p{L}-)\s*$")
_FUNCTION = frozenset(COMMON)


# --- languages ---------------------------------------------------------------------------


def trigrams(text: str, without: frozenset[str] = frozenset()) -> Counter:
    out: Counter = Counter()
    for w in _LETTERS.findall(text.lower()):
        if w not in without:
            p = f"_{w}_"
            out.update(p[i : i + 3] for i in range(len(p) - 2))
    return out


class Languages:
    """Naive Bayes over character trigrams."""

    def __init__(self, labelled: list[tuple[str, str]]):
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in labelled:
            counts[lang].update(trigrams(text))
        self.names = sorted(counts)
        grams = {g for c in counts.values() for g in c}
        self.unseen = [math.log(0.5 / (sum(counts[n].values()) + 0.5 * (len(grams) + 1))) for n in self.names]
        self.table = {g: [math.log((counts[n][g] + 0.5) / (sum(counts[n].values()) + 0.5 * (len(grams) + 1))) for n in self.names] for g in grams} if grams else {}

    def scores(self, grams: Counter) -> list[float]:
        """Log likelihood of the trigrams under each language; unseen ones tell nothing."""
        out = [0.0] * len(self.names)
        for g, n in grams.items():
            if row := self.table.get(g):
                for k, v in enumerate(row):
                    out[k] += n * v
        return out


def train_languages(texts: DataFrame, text: str, lang: str, sample: int = SAMPLE) -> Languages:
    """From at most `sample` labelled texts of each language, chosen by the hash of their content."""
    known = texts.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & ~F.col(lang).isin("und", "") & (F.length(F.trim(text)) > 20)).select(F.col(lang).alias("lang"), F.substring(text, 1, TEXT_CHARS).alias("text"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    rows = known.withColumn("r", F.row_number().over(first)).where(F.col("r") <= sample).select("lang", "text").collect()
    return Languages([(r.lang, r.text) for r in rows])


def other_language(languages: Languages, prompt: str, response: str, margin: float = MARGIN) -> bool:
    """Whether the response is in another language than the prompt, words they share left aside."""
    if len(languages.names) < 2:
        return False
    if not _DONE.search(response):  # the last word may be cut
        response = response.rstrip().rpartition(" ")[0] if len(response.split()) > 4 else response
    a, b = _LETTERS.findall(prompt.lower()), _LETTERS.findall(response.lower())
    shared = frozenset(a) & frozenset(b)
    if len([w for w in b if w not in shared and len(w) > 1]) < 2:
        return False
    said, asked = languages.scores(trigrams(response, shared)), languages.scores(trigrams(prompt))
    own = max(range(len(asked)), key=asked.__getitem__)
    best = max(range(len(said)), key=said.__getitem__)
    clear = asked[own] - max(x for k, x in enumerate(asked) if k != own) > CLEAR
    return clear and best != own and said[best] - said[own] > margin


# --- rules -------------------------------------------------------------------------------


def is_empty(response: str | None) -> bool:
    bare = _INVISIBLE.sub("", response or "").strip().strip("\"'()[]{}<>.“”").strip().lower()
    return not _WORDS.search(bare) or bare.replace(" ", "_") in NOTHING


def is_copy(prompt: str | None, response: str) -> bool:
    """Whether the response gives the prompt back, perhaps shortened or slightly changed, and nothing else."""
    q = _WORDS.findall((prompt or "").lower())
    a = _WORDS.findall(_LABEL.sub("", response).lower())
    if len(q) < 3 or len(a) < 3 or len(a) > len(q) + 2:
        return False
    row = [0] * (len(a) + 1)
    for x in q:
        prev = 0
        for j, y in enumerate(a):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    # what is no question must be a part of the prompt word by word: answers repeat the prompt's words in another order
    asks = regex.search(r"\?[\s\"'”»?]*$", response) is not None
    return row[-1] >= (0.8 * len(a) if asks else len(a)) and row[-1] >= 0.5 * len(q)


def is_refusal(response: str, refusals: Refusals | None = None) -> bool:
    return declines(_INVISIBLE.sub("", response), refusals or model())


# --- ends --------------------------------------------------------------------------------


def tokens(text: str) -> list[str]:
    return _TOKENS.findall(text)


def classed(token: str) -> str:
    t = token.lower()
    if t in _FUNCTION or not t[:1].isalnum() and not t[:1] in "<+-":
        return t
    return "#" if any(c.isdigit() for c in t) else "w"


def contexts(words: list[str], end: int) -> list[str]:
    """The contexts that end before place `end`, longest first."""
    seen = ["<s>", *words[:end]]
    least = 1 if seen[-1] in _FUNCTION else 2  # a class alone tells nothing
    return [" ".join(seen[-n:]) for n in range(min(ORDER, len(seen)), least - 1, -1)]


def _body(text: str) -> list[str]:
    """Classed tokens without the marks that close the text."""
    words = [classed(t) for t in tokens(text)]
    while words and words[-1] in {".", "!", "?", "。", '"', "”", "»", ")"}:
        words.pop()
    return words


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of contexts (kind 'w': texts ending there, places) and of word beginnings (kind 'c')."""
    for f in frames:
        ends: Counter = Counter()
        seen: Counter = Counter()
        for p, a in zip(f["prompt"], f["response"]):
            for text in (p, a):
                whole = _LETTERS.findall((text or "").lower())
                for t in whole if _DONE.search(text or "") else whole[:-1]:  # an open end may be cut
                    ends["c", t] += 1
                    for n in range(1, len(t) + 1):
                        seen["c", t[:n]] += 1
            if a:
                w = _body(a)
                for i in range(1, len(w) + 1):
                    stop = i == len(w)
                    if stop or w[i] not in ".!?":  # an inner sentence may end as well
                        for c in contexts(w, i):
                            seen["w", c] += 1
                            if stop:
                                ends["w", c] += 1
        yield pd.DataFrame([(k, c, float(ends[k, c]), float(n)) for (k, c), n in seen.items()], columns=["kind", "context", "ends", "places"])


def pairs_with_defects(pairs: DataFrame, languages: Languages) -> DataFrame:
    """pairs has src, row_id, prompt, response; the result src, row_id, defect (null where sound)."""
    spark = pairs.sparkSession
    pairs = spread(pairs.select("src", "row_id", "prompt", "response"))
    held = spark.sparkContext.broadcast((languages, model()))  # trigrams of a bounded sample, n-grams of fixed phrases

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            defect, last, word = [], [], []
            for p, a in zip(f["prompt"], f["response"]):
                d, c, w = None, [], None
                if is_empty(a):
                    d = "empty"
                elif is_copy(p, a):
                    d = "copied"
                elif is_refusal(a, held.value[1]):
                    d = "refusal"
                elif p and other_language(held.value[0], p, a):
                    d = "language"
                else:
                    text = _INVISIBLE.sub("", a).strip()
                    if _OPEN.search(text) and len(tokens(text)) > 3:
                        d = "truncated"
                    elif not _DONE.search(text):
                        body = _body(text)
                        if len(body) > 3 or body and body[-1] in _FUNCTION:  # else a short phrase
                            c = contexts(body, len(body))
                        tail = _LETTERS.findall(text.lower())
                        if len(body) > 3 and tail and text.lower().endswith(tail[-1]):
                            w = tail[-1]
                defect.append(d)
                last.append(c)
                word.append(w)
            yield pd.DataFrame({"src": list(f["src"]), "row_id": f["row_id"], "defect": pd.Series(defect, dtype=object), "last": last, "word": pd.Series(word, dtype=object)})

    kind = pairs.schema["row_id"].dataType.simpleString()
    judged = stored(pairs.mapInPandas(judge, f"src string, row_id {kind}, defect string, last array<string>, word string"), "pairs")
    open_ = judged.where(F.size("last") > 0)
    # one row per context of an open end; only these contexts are looked up
    asked = open_.select("src", "row_id", F.posexplode(F.transform("last", lambda c: F.concat(F.lit("w "), c))).alias("depth", "context")).unionByName(open_.where(F.col("word").isNotNull()).select("src", "row_id", F.lit(-1).alias("depth"), F.concat(F.lit("c "), "word").alias("context")))
    # equal pairs count once: copies of one broken response must not vouch for each other
    counted = spread(pairs.select("prompt", "response").distinct()).mapInPandas(_counts, "kind string, context string, ends double, places double")
    counted = counted.groupBy(F.concat_ws(" ", "kind", "context").alias("context")).agg(F.sum("ends").alias("ends"), F.sum("places").alias("places"))
    met = asked.join(counted, "context")
    rate = F.col("ends") / F.col("places")
    seen = F.sort_array(F.collect_list(F.when(F.col("depth") >= 0, F.struct("depth", "ends", "places"))), asc=False)  # the shortest first; ORDER at most
    # each place without the response itself; nested contexts tell much the same, so a shorter one counts for many places
    leaning = lambda p, x: F.when(p < 0, (x["ends"] - 1 + FEW * PRIOR) / (x["places"] - 1 + FEW)).otherwise((x["ends"] - 1 + STRENGTH * p) / (x["places"] - 1 + STRENGTH))
    sentence = F.nullif(F.aggregate(seen, F.lit(-1.0), leaning), F.lit(-1.0))
    verdict = met.groupBy("src", "row_id").agg(sentence.alias("sentence"), F.max(F.when(F.col("depth") == -1, rate)).alias("word_end")).where((F.col("sentence") < END) | (F.col("word_end") < WORD_END)).select("src", "row_id", F.lit("truncated").alias("cut"))
    return judged.join(verdict, ["src", "row_id"], "left").select("src", "row_id", F.coalesce("defect", F.when(F.size("last") > 0, F.col("cut"))).alias("defect"))
