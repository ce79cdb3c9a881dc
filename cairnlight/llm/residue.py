"""Template residue, filler, error pages and script notices in place of content.

Method: texts are cut into parts (the whole, its sentences, the stretches around dashes and
bars, between brackets or marks, behind a short lead) and reduced to forms (case, digits,
identifiers, names of slots and repetitions folded). The trusted labels are those of SEEDS,
inspected pieces of residue that stand in no corpus at hand; they become forms among the others. Near-duplicate forms are found with
partitioned SimHash tables over words and character 4-grams: 64 bits in 8 blocks, a table
for each choice of 2 blocks, so that all forms within 6 bits share a bucket and most of
those within HAMMING, as far as one changed word moves a short text. In every bucket each
form is compared with the least and the greatest one, so a family of n copies gives 2n
candidates and not n * n; candidates are verified by their distance and by edit similarity
(0.8 or more). Labels spread through the connected components.

What tables of hashes cannot promise is made good exactly: from the labelled forms to all
others of edit similarity 0.8 or more until none is left. Candidates are compared in blocks
of like length by the character pairs and characters they do not share, at most two and one
an edit, which loses no pair. That costs labelled times other forms of like length. Filler
in random order has no near-duplicates: a text of which nearly all words (SHARE) stand
mostly in labelled texts is residue as well.

Everything runs on distinct values. A sound text around a slot or a note is never labelled
as a form itself, only the part is, so nothing spreads from it to its clean copies. Null,
empty and blank values are no cases. Rows repeated under one key are reported once; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight.session import broadcast_if_small, dropped, spread, stored

HAMMING, SIMILARITY = 16, 0.8
BLOCKS, CHOSEN = 8, 2
SKETCH, LETTERS, BLOCK = 512, 64, 2000  # bits of a form's character pairs, counts of its characters; forms compared at once
SALTS = 16  # copies of the verdicts, so that a frequent value is not joined in one task
SHARE, WORDS, SEEN, MOSTLY = 0.8, 4, 3, 0.25  # of a text's words, of which there must be some, each seen in labelled texts and in this share of all
ROWS = 50_000  # values that one task takes apart

# Inspected residue; {a|b} stands for either. The names in slots are folded to w, W or w_w.
SEEDS = (
    "{{title}}", "{{TITLE}}", "{{page_title}}", "{{PAGE_TITLE}}", "{title}", "{TITLE}", "{page_title}", "${title}", "${TITLE}", "${page_title}", "#{title}", "#{TITLE}", "#{page_title}", "{% title %}", "{% TITLE %}", "{% page_title %}", "<%= title %>", "<%= TITLE %>", "<%= page_title %>", "<% title %>",
    "[TITLE]", "[PAGE_TITLE]", "[page_title]", "<TITLE>", "<PAGE_TITLE>", "<page_title>", "__TITLE__", "__title__", "__PAGE_TITLE__", "__page_title__", "@@TITLE@@", "@@title@@", "@@PAGE_TITLE@@", "@@page_title@@", "$$TITLE$$", "$$title$$", "$$PAGE_TITLE$$", "$$page_title$$", "%TITLE%", "%title%", "%PAGE_TITLE%", "%page_title%", "%(title)s", "%(title)d",
    "[insert title here]", "[INSERT TITLE HERE]", "[insert page title here]", "[insert title]", "<insert title here>", "<insert title>", "<your title here>", "<your page title here>", "[your title here]", "<title here>", "<page title here>", "[title here]", "[page title here]", "[author: supply figure]", "[author: add text]", "[image to be added]", "[text to come]", "[placeholder]",
    "TBD", "TBA", "TODO", "FIXME", "N.N.", "TODO: describe this", "TODO: add text", "TODO text", "to be announced", "coming soon", "(coming soon)", "(to be added)", "(text to follow)", "caption to be added", "Caption to be supplied.", "text to follow", "Figure to come", "Insert caption here", "Type caption text here", "Enter your text here", "Add a description here", "Your text here",
    "No description yet", "(no description yet - fill in later)", "No caption available yet", "fill in later", "xxx insert figure legend xxx", "This figure will be replaced by the author.", "This image will be replaced later.", "Placeholder text", "This is placeholder text.", "Under construction",
    "lorem ipsum", "Lorem ipsum dolor sit amet", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "asdf asdf", "qwerty qwerty", "foo bar", "foo bar baz", "blah blah", "bla bla", "test test", "abc abc abc 123", "abc abc", "xxx xxx", "xxxxx xxxx xxxxxxx", "sample text", "Sample text. Sample text.", "some text here", "some text here some text here", "dummy text", "This is dummy text.", "Dummy caption 1", "example text", "undefined undefined", "undefined: undefined", "undefined", "null null", "NaN NaN", "[object Object]", "%s", "%s: %s", "%s - %s",
    "The {page|file|document|address}{| you requested| you asked for| behind this link} {could not be found|does not exist|is no longer available|cannot be displayed|has been moved|is restricted to members}", "Oops! We could not find that page.", "It may have moved or been deleted.", "Page not found", "404 page not found",
    "404 Not Found", "403 Forbidden", "410 Gone", "500 Internal Server Error", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Time-out", "Error 404 (Not Found)", "HTTP Status 404 – Not Found", "HTTP Status 404 – Not Found Type Status Report Description The server could not find the page", "HTTP Status 500 – Internal Server Error Type Status Report Description The server could not serve the page",
    "<html>", "<!doctype html>", "<body>", "<noscript>", "<html><head><title>404 Not Found</title></head><body><h1>Not Found</h1></body></html>",
    "Access denied. You do not have permission to view this page.", "You do not have permission to view this page.", "Access denied. Contact the webmaster.", "Your session has expired. Please log in again.", "Your session has expired.", "Please log in again to continue.", "Sorry, something went wrong on our end.", "Something went wrong on our end. Please try again.", "This site is down for maintenance.", "This site is down for maintenance. Please check back soon.", "Please check back soon.", "This page isn't working right now.", "Reload the page or contact the site owner.",
    "Unusual traffic was detected from your network.", "Unusual traffic was noticed from your network.", "Solve the puzzle below to go on.", "Please prove that you are human.", "Checking your browser before you proceed…", "Checking your browser before you proceed to the page.", "Checking your browser before you proceed to the page you asked for.", "Please wait while we check your browser.", "Scripts and cookies must be on.", "Return to the home page", "Go back to the start page",
    "Diese Seite wurde leider nicht gefunden.", "Die Seite wurde nicht gefunden.", "Zur Startseite", "Cette page n'existe plus.", "La page demandée est introuvable.", "Page introuvable", "Retour à l'accueil", "La página solicitada no existe.", "Lo sentimos, la página no existe.", "Volver al inicio",
    "Please {enable|allow} {JavaScript|JS|scripts|active content}{| and cookies}{| in your browser} {to view this page|to load the page|before opening the page}", "{Kindly|You have to|You must|To go on,} {enable|allow} JavaScript{| and cookies}{| in your browser} {to load the page|before opening the page}", "You need to {enable|turn on} JavaScript to run this app.", "Enable JavaScript and cookies to continue", "Enable JS and disable any ad blocker", "For full functionality of this site it is necessary to enable JavaScript.", "{JavaScript|JS|Scripts|Active content} {is {disabled|turned off|not supported|required}|seems to be blocked}{| in your browser| here}", "JavaScript is switched off in your browser.",
    "{This|Our} {site|page|viewer} {requires|needs|relies on|does not work without} {JavaScript|JS|scripts|active content}{| to be on}", "This viewer needs scripts to be allowed.", "Your browser blocks scripts, so the page cannot load.", "Your browser does not support JavaScript", "Loading… (this page requires JavaScript)", "Switch it on and reload.", "Reload after changing the setting.",
    "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "JavaScript ist deaktiviert.", "Activez JavaScript pour continuer.", "Activez JavaScript et les cookies pour continuer.", "Veuillez activer JavaScript.", "Para ver este contenido debe activar JavaScript en su navegador.", "Active JavaScript para continuar.",
)
# The words of slots that are kept, because they say what is to be done.
KEPT = ("insert", "here", "your", "author", "supply", "add", "to", "be", "added", "come", "placeholder", "html", "body", "noscript", "doctype", "object", "coming", "soon", "follow")
_SLOT = r"\{\{[^{}]*\}\}|\{%[^{}]*%\}|[#$]?\{[^{}]*\}|<%[^<>]*%>|<[^<>]*>|\[[^\[\]<>{}%]*\]|(?<!\w)(?:__[A-Za-z]\w*?__|@@\w+@@|\$\$\w+\$\$|%[A-Za-z]\w+%)(?!\w)|%\(\w+\)[sd]"
_STRETCH = r"\([^()]*\)"


def form(text: Column) -> Column:
    """Case, digits, identifiers, repetitions and spacing folded."""
    t = F.regexp_replace(F.lower(text), r"\b(?=[0-9a-f]*[0-9])[0-9a-f]{4,}\b", "0")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[0-9]+(?:[.,][0-9]+)*", "0"), r"\s+", " "))
    t = F.regexp_replace(t, r"(?<=\p{L})[\s.!?…:]+$", "")
    return F.regexp_replace(t, r"\b(\w{2,})\b(?:\W+\1\b)+", "$1 $1")


def slot(stretch: Column) -> Column:
    """The form of what stands between marks: the words in it folded by their shape, but for KEPT."""
    t = F.regexp_replace(stretch, "(?i)(?<![A-Za-z0-9_])(?:" + "|".join(KEPT) + ")(?![A-Za-z0-9_])", "\u0001$0\u0001")
    plain = "(?<![A-Za-z0-9_\u0001\u0002]){}(?![A-Za-z0-9_\u0001])"
    for name, put in (("[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+", "W"), ("[A-Z][A-Z0-9]{2,}", "W"), ("[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+", "ww"), ("[A-Za-z][A-Za-z0-9]{2,}", "w")):
        t = F.regexp_replace(t, plain.replace("{}", name) if "_" in name else plain.replace("{}", name), "\u0002" + put)
    t = F.regexp_replace(F.lower(F.regexp_replace(t, "\u0002W", "\u0003")), "\u0003", "W")
    t = F.regexp_replace(F.regexp_replace(t, "(?<=__)[A-Za-z]\\w*(?=__)", "w"), "[\u0001\u0002]", "")
    return F.concat(F.lit("\u0004"), F.regexp_replace(F.trim(t), r"(?<=[{%=<\[(])\s+|\s+(?=[}%>\])])", ""))


def parts(text: Column) -> Column:
    """The forms of a text and of the stretches it consists of."""
    cut = F.split(text, r"(?<=[.!?…])\s+|\s+[-–—|]\s+|\s*[\n;]+\s*|(?<=\w):\s+|,\s+|(?<=\p{Ll})\s+(?=\p{Lu}\p{Ll})")
    # what stands behind a lead of some words in lower case, and how stretches open
    led = F.filter(F.transform(F.concat(F.array(text), cut), lambda x: F.regexp_extract(x, r"^\s*\p{L}+(?: \p{Ll}+){0,2} (?=\p{Lu}\p{L}*[ ,!:])(.+)$", 1)), lambda x: x != "")
    openings = F.transform(F.concat(F.array(text), cut, led), lambda x: F.regexp_extract(x, r"^\W*(\p{Lu}{4,}(?= \p{L})|\p{L}+ \p{L}+(?= \p{L}+ \p{L}))", 1))
    bare = F.array(F.regexp_replace(text, r"\s*" + _STRETCH, ""))
    plain = F.transform(F.concat(F.array(text), cut, led, openings, bare, F.regexp_extract_all(text, F.lit(_STRETCH), F.lit(0))), form)
    slots = F.transform(F.regexp_extract_all(text, F.lit(_SLOT), F.lit(0)), slot)
    return F.array_distinct(F.filter(F.concat(plain, slots), lambda x: F.length(x) >= 2))


def _choices(pattern: str) -> list[str]:
    """All texts of a pattern; what stands in braces without a bar is no choice."""
    m = re.search(r"\{([^{}]*\|[^{}]*)\}", pattern)
    return [y for x in m.group(1).split("|") for y in _choices(pattern[: m.start()] + x + pattern[m.end() :])] if m else [pattern]


def seeds(spark) -> DataFrame:  # noqa: ANN001
    """(form) of SEEDS: whole, as slots where they are nothing else."""
    t = F.col("t")
    only = t.rlike("^(?:" + _SLOT + ")$")
    return spark.createDataFrame([(x,) for pattern in SEEDS for x in _choices(pattern)], "t string").select(F.when(only, slot(t)).otherwise(form(t)).alias("form")).distinct()


def _bits(text: str) -> int:
    """64-bit SimHash over words and character 4-grams."""
    padded = f"  {text} "
    grams = {padded[i : i + 4] for i in range(max(1, len(padded) - 3))} | set(text.split())
    codes = np.fromiter((xxhash.xxh64_intdigest(g) for g in grams), np.uint64, len(grams))
    ones = np.unpackbits(codes.view(np.uint8)).reshape(len(codes), 64).sum(0)
    return int(np.packbits(ones * 2 > len(codes)).view(np.int64)[0])


def _simhashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f.assign(bits=pd.Series([_bits(t) for t in f["form"]], dtype="int64"))


def alike(s: str, o: str, similarity: float) -> Column:
    """Whether the whole texts of two columns have that edit similarity or more."""
    return F.expr(f"levenshtein({s}, {o}, cast(floor({1 - similarity!r} * greatest(length({s}), length({o})) + 1e-9) as int)) >= 0")


def _placed(hashed: DataFrame) -> DataFrame:
    """(id, bits, t, key): every form in every table; the bits of the chosen blocks are the key."""
    size, tables = 64 // BLOCKS, []
    for t, chosen in enumerate(combinations(range(BLOCKS), CHOSEN)):
        mask = sum(((1 << size) - 1) << k * size for k in chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        tables.append(F.struct(F.lit(t).alias("t"), F.col("bits").bitwiseAND(F.lit(mask)).alias("key")))
    return hashed.select("id", "bits", F.inline(F.array(*tables)))


def near_links(others: DataFrame, labelled: DataFrame, hamming: int = HAMMING, similarity: float = SIMILARITY) -> DataFrame:
    """Both sides have id, form and bits; (a, b) of other forms a within the distance and similarity of a
    labelled form b: in each bucket the least and the greatest labelled one stand for all."""
    ends = stored(_placed(labelled).groupBy("t", "key").agg(F.min(F.struct("id", "bits")).alias("least"), F.max(F.struct("id", "bits")).alias("most")), "buckets")
    met = _placed(others).join(broadcast_if_small(ends), ["t", "key"]).select(F.col("id").alias("a"), "bits", F.explode(F.array("least", "most")).alias("o"))
    pairs = met.where((F.col("a") != F.col("o.id")) & (F.bit_count(F.col("bits").bitwiseXOR(F.col("o.bits"))) <= hamming)).select("a", F.col("o.id").alias("b")).distinct()
    return within(pairs, others, labelled, similarity)


def components_of(hashed: DataFrame, labelled: DataFrame) -> DataFrame:
    """The ids of the connected components that hold a labelled form: (id) of these and all forms linked to them.

    hashed has id, form and bits; labelled has id. Labels go one link further a round; components without a
    labelled form are never built, and what was reached before is in no later round."""
    done = new = stored(labelled.select("id").distinct(), "component")
    while True:
        links = near_links(hashed.join(done, "id", "left_anti"), hashed.join(new, "id", "left_semi"))
        new = stored(links.select(F.col("a").alias("id")).distinct(), "component")
        if not new.limit(1).count():
            return done
        done = stored(done.unionByName(new), "component")


def _sketch(text: str) -> bytes:
    """SKETCH bits of the hashed character pairs of a text, then LETTERS counts of its hashed characters, 255 at most."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    bits = np.zeros(SKETCH, np.uint8)
    bits[((codes[:-1] * 1_000_003 + codes[1:]) * 0x9E3779B1 >> 16) % SKETCH] = 1
    return np.packbits(bits).tobytes() + np.minimum(np.bincount((codes % LETTERS).astype(np.int64), minlength=LETTERS), 255).astype(np.uint8).tobytes()


def _sketched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"id": f["id"], "length": f["form"].str.len().astype("int32"), "sketch": [_sketch(t) for t in f["form"]]})


def _candidates(similarity: float):
    def unpacked(block: list) -> tuple:
        raw = np.frombuffer(b"".join(x["sketch"] for x in block), np.uint8).reshape(len(block), -1)
        pairs = np.unpackbits(raw[:, : SKETCH // 8], axis=1).astype(np.float32)
        return np.array([x["id"] for x in block], np.int64), np.array([x["length"] for x in block], np.float64), pairs, raw[:, SKETCH // 8 :].astype(np.int16)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for xs, ys in zip(f["xs"], f["ys"]):
                (a, n, p, c), (b, m, q, e) = unpacked(xs), unpacked(ys)
                most = np.floor((1 - similarity) * np.maximum(n[:, None], m) + 1e-9)
                i, j = np.nonzero((np.abs(n[:, None] - m) <= most) & (np.maximum(p.sum(1)[:, None], q.sum(1)) - p @ q.T <= 2 * most))
                for k in range(0, len(i), 100_000):
                    u, v = i[k : k + 100_000], j[k : k + 100_000]
                    more = c[u] - e[v]
                    ok = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1)) <= most[u, v]
                    yield pd.DataFrame({"a": a[u[ok]], "b": b[v[ok]]})

    return run


def _blocks(sketches: DataFrame, similarity: float, name: str) -> DataFrame:
    """(band, name): blocks of about BLOCK forms whose lengths differ by a factor of less than the similarity."""
    banded = sketches.withColumn("band", F.floor(F.log(F.col("length").cast("double")) / (-1.01 * float(np.log(similarity)))).cast("int"))
    sizes = banded.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).alias("cuts"))
    return banded.join(sizes, "band").groupBy("band", F.pmod(F.xxhash64("id"), "cuts").alias("cut")).agg(F.collect_list(F.struct("id", "length", "sketch")).alias(name)).drop("cut")


def within(pairs: DataFrame, first: DataFrame, second: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a of the first, b of the second forms) whose whole forms have that edit similarity or more."""
    x, y = (forms.select(F.col("id").alias(k), F.col("form").alias(f"f{k}")) for k, forms in (("a", first), ("b", second)))
    return pairs.join(x, "a").join(y, "b").where(alike("fa", "fb", similarity)).select("a", "b")


def reached(forms: DataFrame, labelled: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The ids of the labelled and of all forms that a chain of pairs of that edit similarity joins to one.

    forms has id and form (distinct); labelled has id. Only pairs with a labelled side are looked for.
    """
    sketches = stored(spread(forms.select("id", "form")).mapInPandas(_sketched, "id long, length int, sketch binary"), "sketches")
    done = new = stored(labelled.select("id").distinct(), "reached")
    while True:
        ours = _blocks(sketches.join(new, "id", "left_semi"), similarity, "xs")
        others = _blocks(sketches.join(done, "id", "left_anti"), similarity, "ys")
        near = ours.withColumn("band", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)]))).join(others, "band").select("xs", "ys")
        found = stored(near.repartition(forms.sparkSession.sparkContext.defaultParallelism).mapInPandas(_candidates(similarity), "a long, b long"), "candidates")
        new = stored(within(found, forms, forms, similarity).select(F.col("b").alias("id")).distinct(), "reached")
        dropped(found)
        if not new.limit(1).count():
            dropped(sketches)
            return done
        done = done.unionByName(new)


def _of_like_words(values: DataFrame, labelled: DataFrame) -> DataFrame:
    """The values that are not labelled but nearly all of whose words stand mostly in labelled ones."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))
    listed = values.join(labelled.withColumn("bad", F.lit(1)), "value", "left").select("value", F.coalesce("bad", F.lit(0)).alias("bad"), F.explode(words).alias("word"))
    listed = stored(listed, "words")
    kept = listed.groupBy("word").agg(F.sum("bad").alias("seen"), F.count("*").alias("n")).where((F.col("seen") >= SEEN) & (F.col("seen") >= MOSTLY * F.col("n"))).select("word", F.lit(1).alias("known"))
    share = listed.where("bad = 0").join(kept, "word", "left").groupBy("value").agg(F.count("known").alias("known"), F.count("*").alias("n"))
    return share.where((F.col("n") >= WORDS) & (F.col("known") >= SHARE * F.col("n"))).select("value")


def residue_labels(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """values has text (distinct); (value, way) of the texts that are or contain residue, value their hash and
    way how they were found: 'seed', 'component', 'chain' or 'words'; and (id, form) of all forms."""
    spark = values.sparkSession
    values = stored(values.select(F.xxhash64("text").alias("value"), "text"), "values")
    tasks = max(spark.sparkContext.defaultParallelism, values.count() // ROWS)
    seen = stored(values.repartition(tasks).select("value", F.explode(parts(F.col("text"))).alias("form")).withColumn("id", F.xxhash64("form")), "parts")
    sown = stored(seeds(spark).withColumn("id", F.xxhash64("form")), "seeds")
    forms = stored(seen.select("id", "form").unionByName(sown.select("id", "form")).distinct(), "forms")
    hashed = stored(spread(forms).mapInPandas(_simhashes, "id long, form string, bits long"), "simhash")
    linked = components_of(hashed, sown)
    bad = reached(forms, linked)
    way = F.min(F.when(F.col("sown").isNotNull(), 1).when(F.col("linked").isNotNull(), 2).otherwise(3)).alias("way")
    found = seen.join(bad, "id", "left_semi").join(sown.select("id", F.lit(1).alias("sown")), "id", "left").join(linked.withColumn("linked", F.lit(1)), "id", "left").groupBy("value").agg(way)
    found = stored(found.select("value", F.element_at(F.array(*map(F.lit, ("seed", "component", "chain"))), F.col("way")).alias("way")), "found")
    return found.unionByName(_of_like_words(values, found.select("value")).select("value", F.lit("words").alias("way"))), forms


def residue_rows(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The keys of all rows whose text is residue, each once."""
    there = rows.where(F.col(text).isNotNull() & (F.trim(text) != "")).select(*keys, F.col(text).alias("text"))
    found = residue_labels(there.select("text").distinct())[0].select("value").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = there.select(*keys, F.xxhash64("text").alias("value"), F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int").alias("salt"))
    return salted.join(found, ["value", "salt"], "left_semi").select(*keys).distinct()
