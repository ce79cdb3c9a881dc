"""The seam to models: one row in, one row out, run exactly once per distinct input.

A provider is a picklable callable over a list of requests. Calls happen in mapInPandas
(an Arrow batch is a request batch), failures become rows with an error, and callers write
the result to a table before anything reads it, so no plan repeats paid calls. The stub is
deterministic and needs no network.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlight.session import stored

BATCH, ATTEMPTS = 1000, 5


class Result(NamedTuple):
    text: str | None
    model: str
    in_tok: int
    out_tok: int
    latency_ms: float
    cost_usd: float
    error: str


class Request(NamedTuple):
    """One model call; images is None for models without vision."""

    model: str
    system: str
    user: str
    images: list[bytes] | None = None
    max_tokens: int = 800
    temperature: float = 0.0


RESULT = "text string, model string, in_tok int, out_tok int, latency_ms double, cost_usd double, error string"


def attempted(call: Callable[[list], list], requests: list, attempts: int = ATTEMPTS, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """call(requests) with exponentially growing waits; the last exception is raised."""
    for a in range(attempts):
        try:
            return call(requests)
        except Exception:  # noqa: BLE001
            if a + 1 == attempts:
                raise
            sleep(wait * 2**a)
    return []


def batched(call: Callable[[list], list[Result]], requests: list, batch: int = BATCH, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> list[Result]:
    """The results of all requests, a batch a call. Where a batch fails, its requests are sent alone, and
    those that still fail give a row with the error; nothing is raised."""
    out: list[Result] = []
    for i in range(0, len(requests), batch):
        part = requests[i : i + batch]
        try:
            out += call(part)
            continue
        except Exception:  # noqa: BLE001, S110
            pass
        for x in part:
            try:
                out += attempted(call, [x], attempts, sleep=sleep)
            except Exception as e:  # noqa: BLE001
                out.append(Result("", "", 0, 0, 0.0, 0.0, f"{type(e).__name__}: {e}"))
    return out


def encoded(image: bytes, most: int = 1200) -> str:
    """Base64 of a picture for a request. Pictures larger than `most` a side are made smaller where a picture
    library is there; without one they are sent as they are."""
    import base64

    try:
        import io

        from PIL import Image

        picture = Image.open(io.BytesIO(image)).convert("RGB")
        picture.thumbnail((most, most))
        out = io.BytesIO()
        picture.save(out, format="PNG")
        image = out.getvalue()
    except ImportError:
        pass
    return base64.b64encode(image).decode()


class Clients:
    """One client a configuration and process, built at first use; a missing key fails there, as a row with an error."""

    def __init__(self, build: dict[str, Callable[[str], object]], keys: dict[str, str]):
        self.build, self.keys, self.made = build, keys, {}

    def of(self, name: str) -> object:
        if name not in self.made:
            if not self.keys.get(name):
                raise KeyError(f"no key for {name}")
            self.made[name] = self.build[name](self.keys[name])
        return self.made[name]


def first_responding(names: list[str], probe: Callable[[str], Result]) -> str:
    """The first model of a list that answers without an error; none is an error."""
    for n in names:
        try:
            if not probe(n).error:
                return n
        except Exception:  # noqa: BLE001, S112
            continue
    raise RuntimeError("no model responds")


class Stub:
    """Hash embeddings, extractive answers, string-match judgements, rule-based triples."""

    dims = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dims)
            for w in re.findall(r"\w+", (t or "").lower()):
                v[int(hashlib.md5(w.encode()).hexdigest(), 16) % self.dims] += 1
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return out

    def generate(self, prompts: list[str]) -> list[Result]:
        return [self._answer(p) for p in prompts]

    def _answer(self, prompt: str) -> Result:
        if prompt is None or "FAIL" in prompt:
            return Result("", "stub", 0, 0, 0.0, 0.0, "StubError: told to fail")
        asked = set(re.findall(r"\w{4,}", prompt.rpartition("Question:")[2].lower()))
        sentences = re.split(r"(?<=[.!?])\s+", prompt.rpartition("Question:")[0])
        best = max(sentences, key=lambda s: len(asked & set(re.findall(r"\w{4,}", s.lower()))), default="")
        best = best.strip().rpartition("\n")[2]
        return Result(best, "stub", len(prompt) // 4, len(best) // 4, 0.0, 0.0, "")

    def judge(self, prompts: list[str]) -> list[Result]:
        out = []
        for p in prompts:
            expected, generated = (re.search(rf"{k}: (.*)", p or "") for k in ("EXPECTED", "GENERATED"))
            ok = bool(expected and generated and expected.group(1).strip().lower() in generated.group(1).lower())
            out.append(Result("1" if ok else "0", "stub", len(p or "") // 4, 1, 0.0, 0.0, ""))
        return out

    def embed_images(self, images: list[bytes]) -> list[list[float]]:
        return self.embed([hashlib.md5(x).hexdigest() if x is not None else "" for x in images])

    def embed_for_images(self, texts: list[str]) -> list[list[float]]:
        """Texts in the space of the images."""
        return self.embed_images([None if t is None else t.encode() for t in texts])

    def ocr(self, pictures: list[str | bytes]) -> list[str]:
        return [p.decode("utf-8", "ignore") if isinstance(p, bytes) else p or "" for p in pictures]

    def caption(self, pictures: list[str | bytes]) -> list[str]:
        if any("FAIL" in x for x in self.ocr(pictures)):
            raise ValueError("told to fail")
        return [f"A picture called {x}." for x in self.ocr(pictures)]

    def call(self, requests: list[Request]) -> list[Result]:
        """The answer to the user part; pictures count as a thousand tokens each."""
        out = [self._answer(r.user) for r in requests]
        return [a._replace(model=r.model, in_tok=a.in_tok + 1000 * len(r.images or ())) for a, r in zip(out, requests)]

    def author(self, prompts: list[str]) -> list[Result]:
        """Questions as JSON about the first sentence with 'is' in it; SKIP where there is none."""
        import json

        out = []
        for p in prompts:
            m = re.search(r"([A-Z]\w+) is ([^.]*)\.", (p or "").rpartition("TEXT:")[2])
            reply = {"q": f"What is {m[1]}?", "answer": m[2]} if m else {"q": "SKIP", "answer": "SKIP"}
            out.append(Result(f"```json\n{json.dumps(reply)}\n```", "stub", len(p or "") // 4, 8, 0.0, 0.0, ""))
        return out

    def triples(self, chunks: list[str]) -> list[str]:
        """JSON lists of [subject, relation, object] from 'X is a Y' sentences."""
        import json

        return [json.dumps([[a, "is a", b] for a, b in re.findall(r"(\w+) is an? ([\w-]+ ?\w*)", c or "")]) for c in chunks]


def embedded(texts: DataFrame, key: str, text: str, provider: Stub | None = None, batch: int = BATCH) -> DataFrame:
    """(key, v): requests of at most `batch` texts, with retries."""
    p = provider or Stub()
    kind = texts.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                yield pd.DataFrame({key: part.iloc[:, 0], "v": attempted(p.embed, part.iloc[:, 1].tolist())})

    return texts.select(key, text).mapInPandas(run, f"`{key}` {kind}, v array<double>")


def called(prompts: DataFrame, key: str, prompt: str, provider: Stub | None = None, method: str = "generate") -> DataFrame:
    """(key, result...) written once to the shared folder: equal prompts are sent once, failures are rows."""
    p = provider or Stub()
    distinct = prompts.select(prompt).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = batched(getattr(p, method), f.iloc[:, 0].tolist())
            yield pd.DataFrame(rows, columns=Result._fields).assign(**{"_prompt": f.iloc[:, 0].to_numpy()})[["_prompt", *Result._fields]]

    answers = stored(distinct.mapInPandas(run, f"_prompt string, {RESULT}"), "calls")
    return prompts.select(key, prompt).join(answers, prompts[prompt].eqNullSafe(answers["_prompt"])).select(key, *Result._fields)


def cached_triples(chunks: DataFrame, cache: DataFrame, provider: Stub | None = None) -> tuple[DataFrame, DataFrame]:
    """chunks has chunk_key and chunk; (all triples as JSON per key, newly extracted part): only keys
    the cache (chunk_key, triples) misses go to the provider, each once."""
    p = provider or Stub()
    misses = chunks.dropDuplicates(["chunk_key"]).join(cache.select("chunk_key"), "chunk_key", "left_anti").select("chunk_key", "chunk")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"chunk_key": f["chunk_key"], "triples": attempted(p.triples, f["chunk"].tolist())})

    new = stored(misses.mapInPandas(run, "chunk_key string, triples string"), "triples")
    return cache.select("chunk_key", "triples").unionByName(new), new


def cache_counts(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: chunks, those cached and those open, by occurrence, and the distinct open keys that are extracted."""
    known = cache.select("chunk_key", F.lit(True).alias("_hit")).distinct()
    x = chunks.select("chunk_key").join(known, "chunk_key", "left")
    open_ = F.col("_hit").isNull()
    return x.agg(F.count("*").alias("chunks"), F.count("_hit").alias("cached"), F.count_if(open_).alias("open"), F.countDistinct(F.when(open_, F.col("chunk_key"))).alias("open_keys"))


def imaged(images: DataFrame, key: str, content: str, provider: Stub | None = None, method: str = "embed_images", batch: int = BATCH) -> DataFrame:
    """(key, v) of pictures, or with method 'embed_for_images' of texts in their space."""
    p = provider or Stub()
    kind = images.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                yield pd.DataFrame({key: part.iloc[:, 0].tolist(), "v": attempted(getattr(p, method), part.iloc[:, 1].tolist())})

    return images.select(key, content).mapInPandas(run, f"`{key}` {kind}, v array<double>")


def requested(rows: DataFrame, key: str, vision: dict[str, bool] | None = None, provider: Stub | None = None) -> DataFrame:
    """rows has model, system, user and images (binaries); (key, result...). Images are dropped for models without
    vision (by name, or by a column vision of the rows), equal requests are sent once, failures are rows."""
    p = provider or Stub()
    sees = F.col("vision") if vision is None else F.col("model").isin([m for m, v in vision.items() if v])
    asked = rows.select(key, "model", "system", "user", F.when(sees, F.col("images")).alias("images"))
    digest = F.sha2(F.concat_ws("\u0001", "model", "system", "user", F.array_join(F.transform(F.coalesce("images", F.array().cast("array<binary>")), lambda x: F.md5(x)), ",")), 256)
    asked = asked.withColumn("_digest", digest)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sent = [Request(m, s, u, None if i is None else [bytes(x) for x in i]) for m, s, u, i in zip(f["model"], f["system"], f["user"], f["images"])]
            yield pd.DataFrame(batched(p.call, sent), columns=Result._fields).assign(_digest=f["_digest"].to_numpy())[["_digest", *Result._fields]]

    answers = stored(asked.dropDuplicates(["_digest"]).mapInPandas(run, f"_digest string, {RESULT}"), "requests")
    return asked.select(key, "_digest").join(answers, "_digest").select(key, *Result._fields)


# The wording of the prompts that ask for questions.
AUTHORS = {
    "text": 'Write one question that the text alone answers, and its short answer. Do not speak of figures, of the page or of the study. Respond with ONLY a JSON object: {"q": "...", "answer": "..."}; if there is none, {"q": "SKIP", "answer": "SKIP"}.\n\nTEXT:\n',
    "multihop": 'Write one question that needs two facts of the text, and its short answer. Do not speak of figures, of the page or of the study. Respond with ONLY a JSON object: {"q": "...", "answer": "..."}; if there is none, {"q": "SKIP", "answer": "SKIP"}.\n\nTEXT:\n',
    "caption": 'Write one question that the described picture answers, and its short answer. Respond with ONLY a JSON object: {"q": "...", "answer": "..."}; if there is none, {"q": "SKIP", "answer": "SKIP"}.\n\nTEXT:\n',
}


def authored(pages: DataFrame, key: str, text: str, kind: str = "text", longest: int = 3000, target: int | None = None, order: list | None = None, provider: Stub | None = None) -> DataFrame:
    """(key, q, answer, rejected) of one question a page: rejected says why one is not taken ('unreadable', 'leak',
    'orphan'), null where it is. With a target, pages are tried in order until that many are taken or six
    times as many tried. longest is the author's limit of the text it is shown."""
    from cairnlight.functions import text as T
    from cairnlight.operators import report

    prompts = pages.select(key, *(order or []), F.concat(F.lit(AUTHORS[kind]), F.substring(text, 1, longest)).alias("prompt"))
    replies = called(prompts, key, "prompt", provider, "author").select(key, T.authored(F.col("text")).alias("x"))
    q = F.col("x.q")
    why = F.when(F.col("x").isNull(), "unreadable").when(T.leaks_modality(q), "leak").when(T.has_orphan_reference(q), "orphan")
    out = prompts.select(key, *(order or [])).join(replies, key).select(key, *(order or []), "x.q", "x.answer", why.alias("rejected"))
    if target is None:
        return out
    return report.attempt_budget(out.withColumn("_ok", F.col("rejected").isNull()), order or [key], "_ok", target).drop("_ok")
