"""The four-way comparison: every question under every system and model in one plan, and asking single questions.

A system differs from the others only in the evidence it sees; evidence is retrieved once a
question and projected per system. The plan is questions x systems x models with the two
small registries as literal arrays, so nothing is joined or shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight.functions import text as T
from cairnlight.operators import fusion, metrics, providers

# The wording of the judges' prompts.
JUDGES = {
    "answer": "You are grading a question-answering system. Decide whether the GENERATED answer is factually correct, given the EXPECTED answer. Minor wording differences are fine. Reply with ONLY the digit 1 or 0.\n\nQUESTION: {question}\nEXPECTED: {expected}\nGENERATED: {generated}\n\nGrade (1 or 0):",
    "faithfulness": "Check whether an answer is FAITHFUL to the context (every claim supported, nothing invented). Reply with ONLY the digit 1 or 0.\n\nCONTEXT:\n{context}\n\nANSWER:\n{generated}\n\nGrade (1 or 0):",
    "faithfulness with image": "Check whether the ANSWER is faithful to the evidence: every claim supported by the attached image and/or the text context, nothing invented. Reply with ONLY the digit 1 or 0.\n\nTEXT CONTEXT:\n{context}\n\nANSWER:\n{generated}\n\nGrade (1 or 0):",
    "relevancy": "Check whether an answer is RELEVANT to the question (addresses it, regardless of correctness). Reply with ONLY the digit 1 or 0.\n\nQUESTION: {question}\nANSWER: {generated}\n\nGrade (1 or 0):",
}


def chosen(wanted: list[str] | None = None, registry: dict = fusion.SYSTEMS) -> list[str]:
    """The wanted systems in the registry's order, all without a wish; an unknown one is an error."""
    unknown = [w for w in wanted or () if w not in registry]
    if unknown:
        raise ValueError(f"unknown system(s): {', '.join(unknown)}")
    return [s for s in registry if wanted is None or s in wanted]


def filled(template: str, **values: Column) -> Column:
    """A template as a projection: {name} replaced by a column, null by nothing."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.coalesce(values[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def routed(is_image: Column, text_ranked: Column, image_ranked: Column | None) -> Column:
    """The ranking that is scored: images for questions about images (none for systems without them), else texts."""
    none = F.array().cast("array<string>")
    images = none if image_ranked is None else F.coalesce(image_ranked, none)
    return F.when(is_image, images).otherwise(F.coalesce(text_ranked, none))


def instruction(facts: Column, images: Column, pixels: Column) -> Column:
    """The system part of the prompt: by the evidence a system has and the way images are delivered."""
    say = lambda k: F.lit(fusion.INSTRUCTIONS[k])
    both = F.when(pixels, say("all+pixels")).otherwise(say("all+captions"))
    pictures = F.when(pixels, say("text+pixels")).otherwise(say("text+captions"))
    return F.when(facts & images, both).when(images, pictures).when(facts, say("text+facts")).otherwise(say("text"))


def user_part(facts: Column, images: Column, pixels: Column, question: Column, passages: Column, fact_list: Column, image_list: Column) -> Column:
    """The user part: with pixels the image block is left out, the images travel beside the prompt."""
    text, block = fusion.context(passages), fusion.facts_block(fact_list)
    empty, none = fusion.image_block(image_list, none=False), fusion.image_block(image_list, none=True)
    prompt = fusion.user_prompt
    seen = F.concat(F.lit("Text context:\n"), text, F.lit("\n\nKnowledge-graph facts:\n"), block, F.lit("\n\nQuestion: "), question)
    bare = F.concat(F.lit("Text context:\n"), text, F.lit("\n\nQuestion: "), question)
    both = F.when(pixels, seen).otherwise(prompt(question, text, block, none))
    pictures = F.when(pixels, bare).otherwise(prompt(question, text, images=empty))
    return F.when(facts & images, both).when(images, pictures).when(facts, prompt(question, text, block)).otherwise(prompt(question, text, plain=True))


def planned(questions: DataFrame, models: dict[str, bool], systems: list[str] | None = None, vlm: bool = True) -> DataFrame:
    """One row per question, system and model: what is sent and how, and the ranking that will be scored.

    questions has question_id, q, expected, is_image, passages, facts, images and image_ranked; models maps
    names to whether they take images. Evidence a system does not see is emptied before prompts are made.
    """
    names = chosen(systems)
    axis = F.explode(F.array(*[F.struct(F.lit(s).alias("system"), *[F.lit(v).alias(k) for k, v in zip(("_text", "_facts", "_images"), fusion.SYSTEMS[s])]) for s in names])).alias("s")
    by_model = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(v).alias("vision")) for m, v in models.items()])).alias("m")
    x = questions.select("*", axis).select("*", by_model).select(*questions.columns, "s.*", "m.*")
    x = x.withColumn("facts", F.when(F.col("_facts"), F.col("facts")).otherwise(F.array().cast(x.schema["facts"].dataType)))
    x = x.withColumn("images", F.when(F.col("_images"), F.col("images")).otherwise(F.array().cast(x.schema["images"].dataType)))
    x = x.withColumn("delivery", fusion.delivery(F.lit(vlm), F.col("is_image"), F.col("vision"), F.col("images")))
    pixels = F.col("delivery") == "pixels"
    ranked = fusion.in_order(F.col("passages"), "rank", lambda p: p["source"])
    return x.select(
        *questions.columns, "system", "model", "vision", "delivery", instruction(F.col("_facts"), F.col("_images"), pixels).alias("instruction"), user_part(F.col("_facts"), F.col("_images"), pixels, F.col("q"), F.col("passages"), F.col("facts"), F.col("images")).alias("prompt"),
        _evidence().alias("evidence"), routed(F.col("is_image"), ranked, F.when(F.col("_images"), F.col("image_ranked"))).alias("ranked"),
    )


def _evidence() -> Column:
    """What faithfulness is judged against: chunks without sources, then the facts and captions the system saw."""
    text = fusion.context(F.col("passages"), tagged=False)
    facts = F.when(F.col("_facts"), F.concat(F.lit("\n"), F.array_join("facts", "\n"))).otherwise("")
    captions = F.when(F.col("_images"), F.concat(F.lit("\n"), F.array_join(F.transform("images", lambda i: F.coalesce(i["caption"], F.lit(""))), "\n"))).otherwise("")
    return F.concat(text, facts, captions)


def _answers(plan: DataFrame, key: str, provider: providers.Stub | None) -> DataFrame:
    """One model call a row of the plan; pictures travel as their names where the plan says pixels."""
    pictures = F.when(F.col("delivery") == "pixels", F.transform("image_ranked", lambda n: n.cast("binary")))
    sent = plan.select(key, "model", F.col("instruction").alias("system"), F.col("prompt").alias("user"), pictures.alias("images"), "vision")
    return providers.requested(sent, key, None, provider)


def compared(plan: DataFrame, provider: providers.Stub | None = None) -> DataFrame:
    """The plan's rows with their answer, the three judgements and the retrieval scores. Answers and
    judgements are written once; a failed call is a row with an error, judged as it stands."""
    keyed = plan.withColumn("cell", F.concat_ws("\u0001", F.col("question_id").cast("string"), "system", "model"))
    answers = _answers(keyed, "cell", provider).drop("model")
    rows = keyed.join(answers, "cell")
    for name, template in (("answer_correct", "answer"), ("faithfulness", "faithfulness"), ("answer_relevancy", "relevancy")):
        values = {"question": F.col("q"), "expected": F.col("answer"), "generated": F.col("text"), "context": F.col("evidence")}
        ask = filled(JUDGES[template], **values)
        if template == "faithfulness":
            ask = F.when(F.col("is_image") & (F.col("delivery") == "pixels"), filled(JUDGES["faithfulness with image"], **values)).otherwise(ask)
        said = providers.called(rows.select("cell", ask.alias("prompt")), "cell", "prompt", provider, "judge")
        rows = rows.join(said.select("cell", T.verdict(F.col("text"), "a").alias(name)), "cell")
    r, e = F.col("ranked"), F.col("expected")
    return rows.select("question_id", "system", "model", "delivery", "text", "in_tok", "out_tok", "error", "answer_correct", "faithfulness", "answer_relevancy", metrics.partial_recall(r, e).alias("recall"), metrics.best_reciprocal_rank(r, e).alias("mrr"), metrics.complete(r, e).alias("complete"))


def summarised(rows: DataFrame) -> DataFrame:
    """(system, model, place, ...means): the systems in registry order."""
    means = [F.avg(c).alias(c) for c in ("recall", "mrr", "complete", "answer_correct", "faithfulness", "answer_relevancy", "in_tok", "out_tok")]
    place = F.array_position(F.array(*[F.lit(s) for s in fusion.SYSTEMS]), F.col("system"))
    return rows.groupBy("system", "model").agg(F.count("*").alias("questions"), F.count_if(F.col("error") != "").alias("errors"), *means).withColumn("place", place.cast("int"))


def asked(questions: DataFrame, system: str, model: str, vision: bool = False, level: int = fusion.LEVEL, provider: providers.Stub | None = None) -> DataFrame:
    """(question_id, reply): the answer of one system to each question, explained at the level. The same frame
    as planned() takes; for a single question it has one row."""
    answers = _answers(planned(questions, {model: vision}, [system]), "question_id", provider).select("question_id", "text")
    sees = fusion.SYSTEMS[system]
    facts = F.col("facts") if sees[1] else F.array().cast("array<string>")
    best = F.get("images", F.lit(0)) if sees[2] else F.lit(None).cast(questions.schema["images"].dataType.elementType)
    x = questions.join(answers, "question_id").withColumn("_best", best)
    return x.select("question_id", fusion.explanation(level, F.col("text"), F.col("passages"), facts, F.col("_best.image_name"), F.col("_best.caption"), F.lit(None).cast("double")).alias("reply"))
