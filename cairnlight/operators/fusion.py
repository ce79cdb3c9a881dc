"""Evidence fusion: which system sees what, contexts, prompts and explanations as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The four systems: (text, facts, images); they differ only in the evidence they see.
SYSTEMS = {"baseline": (True, False, False), "+KG": (True, True, False), "+multimodal": (True, False, True), "+both": (True, True, True)}

# The instructions of the prompt templates.
INSTRUCTIONS = {
    "text": "Answer using only the provided context. If the answer isn't in it, say you don't know.",
    "text+facts": "Answer using only the provided context and knowledge-graph facts. If the answer isn't there, say you don't know.",
    "text+pixels": "Answer using only the provided text context and the attached image(s). If the answer isn't there, say you don't know.",
    "text+captions": "Answer using only the provided text context and image descriptions. If the answer isn't there, say you don't know.",
    "all+pixels": "Answer using only the provided text context, knowledge-graph facts, and the attached image(s). If the answer isn't in any of them, say you don't know.",
    "all+captions": "Answer using only the provided text context, knowledge-graph facts, and image descriptions. If the answer isn't in any of them, say you don't know.",
}
LEVEL = 2  # of explanations, where none can be read
PICTURE_CONTEXT = 400  # characters of a chunk next to a picture


def in_order(items: Column, by: str, render) -> Column:  # noqa: ANN001
    """Elements of an array of structs, rendered in the order of one field (a top-k list, hence bounded)."""
    return F.transform(F.array_sort(items, lambda a, b: F.when(a[by] < b[by], -1).when(a[by] > b[by], 1).otherwise(0)), render)


def context(passages: Column, tagged: bool = True, cut: int | None = None) -> Column:
    """Passages (rank, source, chunk) joined by blank lines, for the generator with their source in brackets."""
    chunk = lambda p: p["chunk"] if cut is None else F.substring(p["chunk"], 1, cut)
    return F.array_join(in_order(passages, "rank", (lambda p: F.concat(F.lit("["), p["source"], F.lit("] "), chunk(p))) if tagged else chunk), "\n\n")


def facts_block(facts: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n"), F.lit("")), F.lit("(none)"))


def image_block(images: Column, none: bool) -> Column:
    lines = F.coalesce(F.array_join(in_order(images, "rank", lambda i: F.concat(F.lit("- ("), i["image_name"], F.lit(") "), F.coalesce(i["caption"], F.lit("")))), "\n"), F.lit(""))
    return F.when(lines == "", "(none)").otherwise(lines) if none else lines


def judge_context(passages: Column, facts: Column | None = None, captions: Column | None = None) -> Column:
    """What a judge holds an answer against: chunks without sources, then facts and captions, each on a new line even if empty."""
    out = context(passages, tagged=False)
    for block in (facts, captions):
        if block is not None:
            out = F.concat(out, F.lit("\n"), F.array_join(block, "\n"))
    return out


def user_prompt(question: Column, text: Column, facts: Column | None = None, images: Column | None = None, plain: bool = False) -> Column:
    """Blocks that are None are left out; plain is the wording for text alone."""
    parts = [F.lit("Context:\n" if plain else "Context passages:\n" if images is None and facts is not None else "Text context:\n"), text]
    if facts is not None:
        parts += [F.lit("\n\nKnowledge-graph facts:\n"), facts]
    if images is not None:
        parts += [F.lit("\n\nRelevant images (described):\n"), images]
    return F.concat(*parts, F.lit("\n\nQuestion: "), question)


def image_question(sources: Column) -> Column:
    return F.exists(sources, lambda s: s.endswith(".png"))


def delivery(wants_pixels: Column, is_image: Column, vision: Column, images: Column) -> Column:
    """How images reach the generator: none, pixels or caption."""
    return F.when(F.size(F.coalesce(images, F.array())) == 0, "none").when(wants_pixels & is_image & vision, "pixels").otherwise("caption")


def provenance(sources: Column, n_facts: Column, image: Column, score: Column) -> Column:
    text = F.when(F.size(sources) > 0, F.concat(F.lit("text["), F.array_join(F.array_distinct(sources), ", "), F.lit("]")))
    graph = F.when(n_facts > 0, F.format_string("graph[%d facts]", n_facts))
    figure = F.when(image.isNotNull(), F.format_string("figure[%s @CLIP %.2f]", image, F.coalesce(score, F.lit(0.0))))
    line = F.concat_ws(" + ", text, graph, figure)
    return F.when(line == "", "(no evidence)").otherwise(line)


def explanation(level: int, answer: Column, passages: Column, facts: Column, image: Column, caption: Column, score: Column) -> Column:
    """The answer and, by level, where it comes from: 1 one line, 2 a list, 3 with facts, caption and snippets."""
    if level <= 0:
        return answer
    sources = F.array_distinct(in_order(passages, "rank", lambda p: p["source"]))
    if level == 1:
        return F.concat(answer, F.lit("\n\nHow I got this: "), provenance(sources, F.size(facts), image, score))
    lines = [answer, F.lit(""), F.lit("How I got this:"), F.when(F.size(sources) > 0, F.concat(F.lit("  - Text source(s): "), F.array_join(sources, ", "), F.lit("  (retrieved by text similarity)")))]
    lines.append(F.when(F.size(facts) > 0, F.format_string("  - Knowledge-graph facts used: %d", F.size(facts))))
    if level >= 3:
        lines.append(F.when(F.size(facts) > 0, F.array_join(F.transform(facts, lambda f: F.concat(F.lit("      • "), f)), "\n")))
    lines.append(F.when(image.isNotNull(), F.format_string("  - Figure: %s  (retrieved by CLIP, score %.3f)", image, F.coalesce(score, F.lit(0.0)))))
    if level >= 3:
        lines.append(F.when(image.isNotNull(), F.concat(F.lit("      caption: "), F.substring(F.coalesce(caption, F.lit("")), 1, 140))))
        snippets = F.array_join(in_order(passages, "rank", lambda p: F.concat(F.lit("      ["), p["source"], F.lit("] "), F.substring(p["chunk"], 1, 120), F.lit("..."))), "\n")
        lines += [F.when(F.size(passages) > 0, "  - Evidence snippets:"), F.when(F.size(passages) > 0, snippets)]
    return F.concat_ws("\n", *lines)


def parsed_level(text: str | None, default: int = LEVEL) -> int:
    """The level of a setting; the default where it is missing or no number."""
    try:
        return int(text)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default


def retrieved(evidence: DataFrame, k: int) -> DataFrame:
    """(question_id, passages) with the k best passages as an array of (rank, source, chunk); k bounds it."""
    return evidence.where(F.col("rank") <= k).groupBy("question_id").agg(F.collect_list(F.struct("rank", "source", "chunk")).alias("passages"))
