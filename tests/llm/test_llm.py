"""The operators for training data: edge cases, round trips, brute force and held-out accuracy."""

import itertools
import pathlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnlight.llm import answers, leakage, percentiles, personal, quality, residue, scans, splitting, tokens


def clashing(df, *names):
    """A frame with further columns whose names the operators use inside."""
    return df.select("*", *[F.lit("x").alias(n) for n in names if n not in df.columns])


# --- 7 ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    return tokens.load()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_tokens_equal_the_public_library(text):
    import tiktoken

    b = tokens.load()
    own = tiktoken.Encoding("own", pat_str=tokens.PIECES, mergeable_ranks=b.ranks, special_tokens={})
    assert b.encode(text) == own.encode_ordinary(text) and b.decode(b.encode(text)) == text


def test_prefix_tables_append_and_edit_exactly(bpe):
    r = random.Random(1)
    for _ in range(150):
        s = bytes(r.choice(b"the inga zq") for _ in range(r.randint(0, 70)))
        k = r.randint(0, len(s))
        t = tokens.PrefixTable(bpe, s[:k]).append(s[k:])
        assert t.ids() == bpe.merge(s)
        a = r.randint(0, len(s))
        c = r.randint(a, len(s))
        new = bytes(r.choice(b"then x") for _ in range(r.randint(0, 6)))
        assert t.replace(a, c, new).ids() == bpe.merge(s[:a] + new + s[c:])


def test_corpus_encoding_defines_empty_and_null(spark):
    df = clashing(spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "<|endoftext|> hi"), (4, "<|endoftext|> hi"), (5, "ab" * 20000)], "doc_id long, text string"), "ids")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df, "doc_id", "text").collect()}
    assert got[1] == got[2] == [] and got[3] and 50256 not in got[4] and len(got[5]) > 1000
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


# --- 4 ---------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,é😀", max_size=1600), st.integers(20, 120))
def test_pieces_tile_the_text(text, limit):
    overlap = limit // 5
    spans = splitting.split_spans(text, limit, overlap)
    assert "".join(text[c:e] for _, c, e, _ in spans) == text
    assert all(e - s <= limit and 0 <= c - s <= overlap for s, c, e, _ in spans)
    hard = any(k == "hard" for *_, k in spans)
    assert hard == (max(map(len, text.split()), default=0) > limit)


def test_runs_of_the_limit_stay_whole():
    for text, kind in (("x" * 500 + " " + "y" * 100, "natural"), ("x" * 501 + " " + "y" * 100, "hard"), ("y " * 60 + "x" * 500, "natural"), ("a " + "x" * 500 + " b", "natural"), ("x" * 500 + "\n" + "z" * 500, "natural")):
        spans = splitting.split_spans(text)
        assert ("hard" if any(k == "hard" for *_, k in spans) else "natural") == kind
        assert "".join(text[c:e] for _, c, e, _ in spans) == text and all(e - s <= 500 for s, _, e, _ in spans)


def test_oversized(spark):
    rows = [(1, "a" * 501), (2, "a" * 500), (3, "a b " * 200), (4, None), (5, ""), (6, " " * 600), (3, "a b " * 200)]
    df = clashing(spark.createDataFrame(rows, "id long, t string"), "cut", "piece", "start")
    assert sorted(map(tuple, splitting.oversized(df, "id", "t").collect())) == [(1, "hard"), (3, "natural"), (6, "natural")]
    assert splitting.split_texts(df.limit(0), "id", "t").count() == 0


# --- 2 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("rel_error", [0.0, 0.01])
def test_percentiles_of_combined_parts(spark, rel_error):
    r = random.Random(5)
    rows = [(g, d, v) for g in ("a", None, "b") for d in (1, 2, 3) for v in [r.choice((0.0, -0.0, -5.5, 7.0, r.random() * 1000, r.expovariate(0.01))) for _ in range(120 if g == "a" else 7)]]
    rows += [("a", 1, None), ("c", 1, None), ("a", 1, float("nan"))]
    df = clashing(spark.createDataFrame(rows, "g string, d int, v double"), "n", "low", "part")
    parts = [percentiles.frequencies(df.where(f"d = {d}"), ["g"], "v", rel_error) for d in (1, 2, 3)]
    both = percentiles.combine(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["g"])
    got = percentiles.percentiles(both, ["g"], (0.0, 0.5, 0.9, 1.0)).collect()
    assert len(got) == 12
    for x in got:
        vs = sorted(v for g, _, v in rows if g == x.g and v is not None and v == v)
        exact = vs[max(1, -(-int(round(x.prob * 10)) * len(vs) // 10)) - 1]
        assert x.low <= exact <= x.high and x.n == len(vs)
        if rel_error == 0:
            assert x.low == x.high
        elif exact > 0:
            assert x.high / x.low <= 1 + rel_error + 1e-9
    assert percentiles.percentiles(both.limit(0), ["g"]).count() == 0


# --- 8 ---------------------------------------------------------------------------------------


def runs_of(a, b):
    best = 0
    for i, j in itertools.product(range(len(a)), range(len(b))):
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        best = max(best, n)
    return best


@pytest.mark.parametrize("bound", [leakage.SEED_BOUND, 0])
def test_leaks_equal_brute_force(spark, bound):
    r = random.Random(2)
    word = lambda: r.choice("alpha beta gamma delta eps zeta".split())
    items = [(i, " ".join(word() for _ in range(r.choice((3, 8, 11, 12, 20))))) for i in range(12)] + [(90, None), (91, ""), (92, "--")]
    docs = []
    for k in range(40):
        body = [word() for _ in range(30)]
        src = r.choice(items[:12])[1].split()
        cut = src[: r.choice((5, 11, 12, len(src)))]
        docs.append((k, "  ".join(body[:10] + [w.upper().replace("E", "E­") for w in cut] + body[10:]) + "!"))
    docs += [(99, None), (98, "")]
    i = clashing(spark.createDataFrame(items, "item_id long, text string"), "words", "seed")
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string"), "words", "place")
    found = leakage.leaked(leakage.overlaps(i, "item_id", "text", d, "doc_id", "text", bound))
    want = set()
    for (a, x), (b, y) in itertools.product(items, docs):
        p, q = leakage.words(x), leakage.words(y)
        if p and q and runs_of(p, q) >= min(12, len(p)):
            want.add((a, b))
    assert {(z.item_id, z.doc_id) for z in found.collect()} == want and want


def test_substitutions_are_tolerated_and_words_folded():
    a = leakage.hashed([str(k) for k in range(30)])
    b = a.copy()
    b[15] = 1
    o = leakage.verify(a, b, 0)
    assert (o.words, o.substituted, o.longest_run) == (30, 1, 15)
    assert leakage.words("ﬁne­st ＡＢ—c​d") == ["finest", "ab", "cd"] and leakage.words(None) == []


# --- 1 ---------------------------------------------------------------------------------------


def test_defects(spark):
    en, de = "The rate of the flow was measured in the cold water of the tank.", "Die Rate der Strömung wurde in dem kalten Wasser des Behälters gemessen."
    lang = answers.train_languages(spark.createDataFrame([("en", en + " It is not the same with all of them.")] * 3 + [("de", de + " Es ist nicht mit allen das gleiche.")] * 3 + [("und", "x"), (None, "y")], "lang string, text string"), "text", "lang")
    full = ["The mean rate of the plates was 5.2 mg after the light had been turned off."] * 30
    rows = [("What was the mean rate of the plates?", t) for t in full]
    odd = [
        ("What was the rate?", None, "empty"), ("Why?", " ​", "empty"), ("Why?", "N/A", "empty"), ("How many?", "0", None), ("Why so?", "Yes", None),
        ("How many plates showed growth?", "Q: how many plates showed growth", "copied"), ("How many plates showed growth?", "How many plates showed growth? In total 5 of the plates showed growth.", None),
        ("How many?", "I'm sorry, but I can't help with that.", "refusal"), ("Wie viele?", "Dabei kann ich nicht helfen.", "refusal"), ("Why?", "The guidelines do not allow salt in water.", None), ("Why?", "32 patients declined to take part.", None),
        ("What was the rate of the flow in the water?", de, "language"), ("Wie war die Rate der Strömung in dem Wasser?", de, None),
        ("What was the mean rate of the plates?", "The mean rate of the plates was 5.2 mg after the", "truncated"), ("What was it?", "The mean rate of the plates was 5.2 mg after the light had been turned off", None), ("What was it?", "The mean rate of the pla", "truncated"),
        ("Why?", "We could not detect any growth after 4 days.", None), ("Why?", "The authors say we cannot exclude a bias.", None), ("Why?", "That is not something I am comfortable answering.", "refusal"), ("Why?", "I have to pass on this one.", "refusal"),
        ("What?", "a drop of 5 %", None), (None, "The mean rate of the plates was 5.2 mg after the light had been turned off.", None),
    ]
    data = [("s", i, p, a) for i, (p, a) in enumerate(rows)] + [("s", 100 + i, p, a) for i, (p, a, _) in enumerate(odd)]
    df = clashing(spark.createDataFrame(data, "src string, row_id long, prompt string, response string"), "defect", "last")
    got = {r.row_id: r.defect for r in answers.pairs_with_defects(df, lang).collect()}
    assert [got[100 + i] for i in range(len(odd))] == [w for *_, w in odd]
    assert answers.pairs_with_defects(df.limit(0), lang).count() == 0


# --- 5 ---------------------------------------------------------------------------------------


def test_residue(spark):
    yes = ["{{title}} of x", "TODO: describe this", "lorem ipsum dolor sit amet", "Sorry, the page you asked for could not be found!", "Checking your browser before you proceed to the page that was asked for, which takes a few seconds only.", "Chart of flow - <your caption here>", "Checking your browsar before you proceed to the page that was asked for, which takes a few seconds only.", "<html><body><h1>502 Bad Gateway</h1></body></html>", "test test test", "call failed: {% request_id %}", "reply was __REASON__", "Bar chart of flow (coming soon)"]
    yes += ["This picture will be replaced by the author.", "[Author: supply artwork]", "Access denied. Ask the webmaster.", "Please wait while we verify your browser"]
    no = ["Bar chart of flow by rate", "TemplateError: prompt needs 3 placeholders but got 1", "Screenshot of a browser showing a 404 message on the left", "The sets {a, b, c} and {c, d}", "", " ", None, "KeyError: 'x' in reply {'id': '1'}", "Plot of f(x) = {x | x > 0} at p <0.01 [95 % CI]", "Cost in US$ per item, 67 % above plan"]
    no += ["Figure 3 shows sample text from the corpus.", "The page was not found in the archive, so the plate was photographed again.", "Screenshot of the web page asking the visitor to enable JavaScript", "details pending in Table 2"]
    rows = [("a", i, t) for i, t in enumerate(yes)] + [("b", i, t) for i, t in enumerate(no)] + [("a", 0, yes[0])]
    df = clashing(spark.createDataFrame(rows, "src string, row_id long, text string"), "value", "form", "salt", "way")
    got = [tuple(r) for r in residue.residue_rows(df, ["src", "row_id"]).collect()]
    assert sorted(got) == [("a", i) for i in range(len(yes))]
    assert residue.residue_rows(df.limit(0), ["src", "row_id"]).count() == 0


def hashed(spark, texts):
    return spark.createDataFrame([(i, t, residue._bits(t)) for i, t in enumerate(texts)], "id long, form string, bits long")


def test_links_are_near_and_few_and_components_are_whole(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcdefg hij") for _ in range(60)) for _ in range(12)]
    texts = sorted({t for b in base for t in [b] + [b[:k] + r.choice("xyz") + b[k + 1 :] for k in (5, 30, 55)]} | {base[0][:k] + c + base[0][k + 1 :] for k in range(60) for c in "xyz"})
    forms = hashed(spark, texts)
    got = {(x.a, x.b) for x in residue.near_links(forms, forms).collect()}
    bits = [residue._bits(t) & (2**64 - 1) for t in texts]
    assert got and all((bits[i] ^ bits[j]).bit_count() <= residue.HAMMING and scans.distance(texts[i], texts[j], 12) <= 12 for i, j in got)
    assert len(got) <= 2 * 28 * len(texts)  # two links a form and table, however large the family
    family = {i for i, t in enumerate(texts) if scans.distance(t, base[0], 12) <= 12}
    one = spark.createDataFrame([(min(family),)], "id long")
    assert {x.id for x in residue.components_of(forms, one).collect()} == family and len(family) > 150
    assert residue.components_of(forms, one.limit(0)).count() == 0


def test_labels_reach_all_forms_of_like_edits(spark):
    r = random.Random(9)
    words = [f"{a}{b}" for a in ("ta", "lo", "mir", "ske", "und", "pra") for b in ("ne", "rk", "sol", "ti")]
    near = lambda t: " ".join(r.choice(words) if r.random() < 0.2 else w for w in t.split())
    texts = [" ".join(r.choices(words, k=n)) for n in (1, 2, 3, 5, 8, 12, 16, 30) for _ in range(4)]
    texts = sorted({t for base in texts for t in (base, near(base), near(near(base)), base[1:], base + "q")} | {"é", "ab\U0001f600cd", "abxcd"})
    assert len(texts) > 100
    alike = {(i, j) for i, j in itertools.permutations(range(len(texts)), 2) if scans.distance(texts[i], texts[j], 60) * 5 <= max(len(texts[i]), len(texts[j]))}
    seeds = {i for i in range(len(texts)) if i % 9 == 0 or "\U0001f600" in texts[i]}
    want, new = set(seeds), set(seeds)
    while new:
        new = {j for i, j in alike if i in new} - want
        want |= new
    assert len(want) > 2 * len(seeds)
    forms = spark.createDataFrame(list(enumerate(texts)), "id long, form string")
    assert {x.id for x in residue.reached(forms, spark.createDataFrame([(i,) for i in seeds], "id long")).collect()} == want
    assert residue.reached(forms, forms.limit(0).select("id")).count() == 0


def test_residue_spreads_over_a_changed_word_but_not_to_sound_remains(spark):
    yes = ["Checking your browser before you proceed to the page that was asked for.", "Checking the browser before you proceed to the page that was asked for.", "Bar chart of output, table of decay values by source ${model}", "Bar chart of output, table of decay values by rate (coming soon)"]
    no = ["Bar chart of output, table of decay values by source", "Bar chart of output, table of decay values by source mode", "Bar chart of output, table of decay values by rate"]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(yes)] + [("b", i, t) for i, t in enumerate(no)], "src string, row_id long, text string")
    assert sorted(tuple(x) for x in residue.residue_rows(df, ["src", "row_id"]).collect()) == [("a", i) for i in range(len(yes))]


def test_links_compare_whole_forms(spark):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefg hij") for _ in range(n))
    start, tail = text(2000), text(2000)
    forms = [start + tail, start + text(2000), start + tail[:-1] + "z"]
    df = hashed(spark, forms)
    assert {tuple(sorted((x.a, x.b))) for x in residue.near_links(df, df).collect()} == {(0, 2)}


def test_labels_come_by_propagation_and_by_words(spark):
    r = random.Random(3)
    verbs, things = ("enable", "allow", "turn on", "switch on"), ("view", "load", "show")
    texts = {f"Please {v} scripts in your browser to {t} the {x}" for v in verbs for t in things for x in ("page", "figure", "viewer", "chart")}
    filler = "lorem ipsum magnum quisque orci porta felix".split()
    texts |= {"Lorem ipsum " + " ".join(r.choices(filler, k=7)) for _ in range(20)} | {"Orci magnum porta felix quisque magnum orci"}
    texts |= {f"Bar chart of the {w} in the {x}" for w in ("rate", "loss", "flow") for x in ("tank", "page", "figure")}
    found, _ = residue.residue_labels(spark.createDataFrame([(t,) for t in sorted(texts)], "text string"))
    ways = {x.way: x.n for x in found.groupBy("way").agg(F.count("*").alias("n")).collect()}
    assert sum(ways.values()) == 48 + 21 and ways["words"] == 1 and ways["component"] + ways.get("chain", 0) > 40


# --- 6 ---------------------------------------------------------------------------------------


def test_kinds(spark):
    more = {
        "prose": ["The lamp was lit at noon and the water was kept warm. No change of the flow was seen in the tank after 3 days.", "Der Verlust war gering, obwohl das Wasser kalt war. Die Proben wurden in der Luft getrocknet.", "The loss rose with the flow (χ² = 3.1; p < 0.05), which is in line with the others."],
        "list": ["- red cap\n- blue cap\n- green cap\n- white cap", "1. red cap\n2. blue cap\n3. green cap\n4. white cap"],
        "table": ["cap | rim | lid\nred | 4.1 | 22 %\nblue | 3.9 | 19 %", "cap\trim\tlid\nred\t4.1\t22 %\nblue\t3.9\t19 %"],
        "junk": ["^%$#/\\|~*&^%$#@=+<>^%$#/\\|~*&^%$", "0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0"],
    }
    rows = [(i, k, t) for i, (k, t) in enumerate((k, t) for k, ts in more.items() for t in ts)] + [(90, None, None), (91, None, ""), (92, None, " \n")]
    df = clashing(spark.createDataFrame(rows, "id long, want string, t string"), "words", "kind", "letters")
    got = {r.id: r for r in quality.kinds(df, "id", "t").collect()}
    assert {i: got[i].kind for i, _, _ in rows} == {i: w for i, w, _ in rows} and got[91].words is None
    model = quality.fit(quality.statistics(df, "id", "t").where("words is not null"), tolerance=1e-3)
    assert all(a < b for a, b in zip(model["trace"], model["trace"][1:-1])) and len(model["trace"]) < quality.PASSES and model["trace"][-1] - model["trace"][-2] < 1e-3
    assert got[0].words == 25 and got[0].punctuated_lines == 1.0
    assert quality.kinds(df.limit(0), "id", "t").count() == 0
    odd = df.unionByName(clashing(spark.createDataFrame([(70, None, "a\x1cb\x85c\u2003d  e\r\nf\rg"), (71, None, "x" * 5000), (72, None, "1. a 2. b - c -d\t|x; y,z 1,2 n/a")], "id long, want string, t string"), "words", "kind", "letters"))
    one, two = (f(odd, "id", "t").orderBy("id").toPandas() for f in (quality.statistics, quality.statistics_sql))
    two = two[one.columns]
    assert ((one - two).abs().fillna(0) < 1e-9).all(axis=None) and (one.isna() == two.isna()).all(axis=None)


# --- 9 ---------------------------------------------------------------------------------------


def test_details_on_composed_sentences():
    weights, r = personal.train(), random.Random(12345)
    hit = said = true = 0
    for _ in range(300):
        text, gold = personal.composed(r)
        found = {(s.start, s.end, s.kind) for s in personal.decode(text, weights)}
        hit, said, true = hit + len(found & gold), said + len(found), true + len(gold)
    assert hit / said > 0.97 and hit / true > 0.95


def test_details_on_sentences_written_apart():
    """100 sentences written by hand, marked <kind|stretch>; none comes from the generator."""
    weights = personal.train()
    hit = said = true = 0
    for line in (pathlib.Path(__file__).parent / "personal_sentences.txt").read_text(encoding="utf-8").splitlines():
        text, gold = "", set()
        for piece in re.split(r"(<\w+\|[^>]+>)", line):
            m = re.fullmatch(r"<(\w+)\|([^>]+)>", piece)
            if m:
                gold.add((len(text), len(text) + len(m[2]), m[1]))
            text += m[2] if m else piece
        found = {(s.start, s.end, s.kind) for s in personal.decode(text, weights)}
        hit, said, true = hit + len(found & gold), said + len(found), true + len(gold)
    assert hit / said > 0.97 and hit / true > 0.9


def test_details_and_placeholders(spark):
    t = "We thank Dr Ines Torvaldsen for help. Contact ines.torvaldsen [at] lab [dot] example or +49 555 123 4567.\nHer passport no. is X1 234 5678. Signed: Ines Torvaldsen, 12 Elm Street, Brackford 12345."
    df = clashing(spark.createDataFrame([(1, t), (2, None), (3, ""), (4, "Grant no. 123-45-678B paid. The Torvald Institute kept 1234 5678 records. " * 300), (1, t)], "doc_id long, text string"), "kind", "value")
    got = {(r.doc_id, r.kind, r.value) for r in personal.found_details(df, "doc_id", "text").collect()}
    assert got == {(1, "name", "Ines Torvaldsen"), (1, "email", "ines.torvaldsen [at] lab [dot] example"), (1, "phone", "+49 555 123 4567"), (1, "identity", "X1 234 5678"), (1, "address", "12 Elm Street, Brackford 12345")}
    clean = {r.doc_id: r.text for r in personal.redacted(df, "doc_id", "text").collect()}
    assert clean[1].count("[NAME]") == 2 and "Torvald" not in clean[1] and clean[2] is None and clean[3] == ""
    assert personal.found_details(df.limit(0), "doc_id", "text").count() == 0


# --- 3 ---------------------------------------------------------------------------------------


def test_automaton_finds_all_candidates():
    r = random.Random(6)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(1, 7))) for _ in range(300)})
    trie = scans.Trie(words)
    for _ in range(200):
        q = "".join(r.choice("abcd") for _ in range(r.randint(0, 7)))
        assert trie.within(q) == sorted(w for w in words if scans.distance(w, q, 2) <= 2)
    assert scans.price("rnodern", "modern") == (scans.FIRST, 0) and scans.price("c0at1ng", "coating") == (scans.FIRST + scans.MORE, 0)
    assert scans.price("xeadings", "readings") == (scans.OTHER, 1) and scans.price("growths", "growth") == (scans.GAP, 1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 70))) for _ in range(2))
        table = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, table[0] = table[0], i
            for j, y in enumerate(b, 1):
                before, table[j] = table[j], min(table[j] + 1, table[j - 1] + 1, before + (x != y))
        assert scans.distance(a, b, 12) == min(table[-1], 13)


@pytest.mark.parametrize("shard", [scans.SHARD, 3])
def test_all_readings_are_found_in_shards(spark, shard):
    r = random.Random(8)
    words = {"".join(r.choice("il1o0es5") for _ in range(r.randint(3, 8))): r.choice((1, 2, 4, 60, 900)) for _ in range(150)} | {"readings": 500, "xeadings": 1, "growth": 700, "growkh": 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {(x.word, x.right) for x in scans.misreadings(df, shard=shard).collect()}
    trie = scans.Trie([w for w, n in words.items() if n >= scans.ATTESTED])
    want = set()
    for w, n in words.items():
        for v in trie.within(w):
            other = scans.price(w, v)[1]
            if v != w and words[v] > n and (not other and words[v] >= 12 * n and (len(w) > 3 or not scans.STRONG.isdisjoint(w)) or other and n < 5 and len(w) >= 5 and (other == 1 or len(w) >= 10)):
                want.add((w, v))
    assert got == want and ("xeadings", "readings") in got and ("growkh", "growth") in got
    assert scans.misreadings(df.limit(0)).count() == 0


def test_neighbours_decide_between_candidates(spark):
    one, two = "the samples were washed in cold water", "all cheques were cashed at a bank"
    rows = [("p", i, one if i % 2 else two, None, None) for i in range(400)] + [("p", 1000, one.replace("washed", "kashed"), None, None), ("p", 1001, two.replace("cashed", "kashed"), None, None), ("p", 1002, "here kashed nothing", None, None)]
    noise = scans.scan_noise(spark.createDataFrame(rows, "src string, row_id long, text string, doc string, page_no int"))
    assert {tuple(x)[1:] for x in noise.cases.collect()} == {(1000, "char", "washed"), (1001, "char", "cashed")}


def test_header_forms_beyond_the_broadcast_give_the_same(spark):
    body = ("", "Most plates", "Old lamps", "Both ends", "Some films")
    pages = [("p", 10 * d + n, f"Annals of {name} Studies\nThe plates of the {name} panel were\nkept in the dark.\n{n}", f"d{d}", n) for d, name in enumerate(("Panel", "Coating", "Water", "Vapour")) for n in range(1, 5)]
    pages += [("p", 90, "Annals of Oxide Studies\nOne page only has\nno header that recurs.", "e", 1), ("p", 91, "Annals of Oxide Studies 4 The plates of it were kept in the dark.", None, None)]
    df = spark.createDataFrame(pages, "src string, row_id long, text string, doc string, page_no int")
    a, b = ({tuple(x) for x in scans.scan_noise(df, bound).cases.collect()} for bound in (scans.FORMS, 0))
    assert a == b and {x for x in a if x[1] > 80 and x[2] == "header"} == {("p", 90, "header", "Annals of Oxide Studies"), ("p", 91, "header", "Annals of Oxide Studies")}


def test_scans(spark):
    body = ["The modern coating kept the temperature-driven loss small in all plates of the panel.", "The panel was coated and the plates were kept in water for the modern test."]
    pages = []
    for n in range(1, 9):
        text = f"Annals of Panel Studies\n{body[0]}\n{body[1]}\n{n}" if n % 2 else f"{body[0]}\n\n{body[1]}\nAnnals of Panel Studies\n- {n} -"
        pages.append(("p", n, text, "doc", n))
    pages += [("p", 20 + n, " ".join(body * 4), None, None) for n in range(12)]
    pages += [("p", 50, "Aiinals of Panel Studies\nThe rnodern coat-\ning kept the temperature-\ndriven 1oss srnall.\n\nAll p1ates of the panel.", "doc", 50), ("p", 51, "Annals of Panel Studies - 51 - The modern coat- ing was kept.", "doc", 51), ("p", 60, None, "doc", 60), ("p", 61, "", "doc", 61)]
    df = clashing(spark.createDataFrame(pages, "src string, row_id long, text string, doc string, page_no int"), "kind", "known")
    noise = scans.scan_noise(df)
    got = {tuple(r) for r in noise.cases.where("row_id in (3, 4, 50, 51)").collect()}
    assert {x[2:] for x in got if x[1] == 3} == {("header", "Annals of Panel Studies"), ("page_number", "3")}
    assert {x[2:] for x in got if x[1] == 4} == {("header", "Annals of Panel Studies"), ("page_number", "- 4 -")}
    assert {x[2:] for x in got if x[1] == 50} == {("header", "Aiinals of Panel Studies"), ("char", "modern"), ("hyphen", "coating"), ("hyphen", "temperature-driven"), ("char", "loss"), ("char", "small"), ("char", "plates")}
    assert {x[2:] for x in got if x[1] == 51} == {("header", "Annals of Panel Studies"), ("page_number", "- 51 -"), ("hyphen", "coating")}
    clean = {r.row_id: r.text for r in scans.repaired(noise).collect()}
    assert clean[50] == "The modern coating kept the temperature-driven loss small.\n\nAll plates of the panel."
    assert clean[51] == "The modern coating was kept."
    assert scans.scan_noise(df.limit(0)).cases.count() == 0
