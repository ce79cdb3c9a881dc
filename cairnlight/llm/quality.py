"""Per-document text quality statistics and the kinds of text they show.

Method: statistics are computed from token sums, standardized over all documents,
and a Gaussian mixture is fitted to them by expectation-maximization: every pass reads all
rows and returns one sum per component, until the mean log likelihood of a document rises
by less than TOLERANCE (at most PASSES passes). Inspected examples (EXAMPLES, one component
per group) only start the components, as spheres; they have no weight in the fit. Afterwards
a component is mapped to prose, list, table or junk by the examples it answers for, or by
the nearest one if it answers for none. A document's kind is the one with the largest
posterior.

Null and blank texts have no kind and null statistics; an empty table gives no rows.
Duplicate rows are each classified (equal texts alike).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlight.llm.words import tokenized
from cairnlight.session import spread, stored

# Frequent function words of the languages at hand.
COMMON = """
the of a an and in to was were is are by from with that for on at as be been had has not it its this these which than or but if when where
who how what why so there their they we he she his her into over under between each both after before during once only also most more
der die das den dem des und ist war wurde von mit zu im ein eine einer nicht auf für durch als dass sich bei nach um aus wird oder obwohl konnte
le la les un une des du et est était a été que qui ne pas par pour dans sur de au aux ce cette ces se sont l d il elle leur avec après malgré ni
el los las una y es fue era que no se por para en del al con este esta estos su sus cada durante después o pero como más lo
""".split()  # noqa: SIM905
_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_END = r"[.!?。！？…][\"”’)\]]*$"
_MARK = r"^(?:[-*•–·▪◦+]|\(?[0-9]{1,3}[.)]|\(?[a-z][.)]|\([A-Zivx]+\)|\[[0-9]+\])\s+\p{L}"
_NUMBER = r"^[<>~±+-]?[0-9][0-9.,]*%?$|^n/a$|^[±%|-]$"
_WORD = r"^[(\"“‘¿¡]*\p{L}+(?:['’-]\p{L}+)*[.,;:!?)\"”’…]*$"
FEATURES = ("words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "marked_lines", "inline_marks", "leaders", "numbers", "cells", "wordlike", "sentence_ends", "other_ends", "words_a_line", "longest_share", "distinct", "letters", "upper", "vowels", "unspaced", "messy")


def statistics_sql(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, one column per statistic), null for null and blank texts, in built-in expressions.

    The definition of the statistics. statistics() gives the same numbers at a fraction of
    the cost, because nearly all of them are sums over tokens, and tokens repeat."""
    t = F.col("_t")
    src = df.select(F.col(key), F.regexp_replace(F.col(text), r"\r\n?", "\n").alias("_t"))
    src = src.withColumn("_toks", F.filter(F.split(t, _SPACE + "+"), lambda x: x != "")).withColumn("_lines", F.filter(F.transform(F.split(t, r"\n"), lambda x: F.trim(x)), lambda x: x != ""))
    src = src.withColumn("_letters", F.regexp_replace(t, r"[^\p{L}]+", "")).withColumn("_words", F.regexp_extract_all(F.lower(t), F.lit(r"\p{L}+"), F.lit(0)))
    n, lines = F.size("_toks"), F.size("_lines")
    some = F.when(t.isNotNull() & (n > 0), True)
    chars = F.length(F.regexp_replace(t, _SPACE + "+", ""))
    share = lambda part, whole: F.when(some, part / F.greatest(whole, F.lit(1)))
    matching = lambda arr, pattern: F.size(F.filter(arr, lambda x: x.rlike(pattern)))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    less = lambda c, marks: F.length(c) - F.length(F.translate(c, marks, ""))
    cols: dict[str, Column] = {
        "words": F.when(some, n),
        "mean_word_length": share(chars, n),
        "symbol_ratio": share(count(r"[^\p{L}\p{N}\s\x0b\x1c-\x1f\x85\p{Z}.,;:!?'\"()-]"), chars),
        "punctuated_lines": share(matching("_lines", _END), lines),
        "common_words": share(F.size(F.filter("_words", lambda w: w.isin(COMMON))), n),
        "marked_lines": share(matching("_lines", _MARK), lines),
        "inline_marks": share(count(rf"(?:^|{_SPACE})(?:[-*•▪◦]|[0-9]{{1,3}}[.)]|\([a-z]\)|\[[0-9]{{1,3}}\]){_SPACE}+(?=\p{{L}})"), n),
        "leaders": share(count(r"\.{4,}|…{2,}"), n),
        "numbers": share(matching("_toks", _NUMBER), n),
        "cells": share(less(t, "\t|;") + count(r"\S  +(?=\S)") + count(r"[\p{L}\p{N}%],(?=[\p{L}\p{N}<-])"), n),
        "wordlike": share(matching("_toks", _WORD), n),
        "sentence_ends": share(count(r"(?<=[\p{L}%°)\]])\.(?:\s|$)|。"), n),
        "other_ends": share(count(r"[;:!?](?:\s|$)"), n),
        "words_a_line": share(n, lines),
        "longest_share": share(F.array_max(F.transform("_toks", F.length)), chars),
        "distinct": share(F.size(F.array_distinct("_toks")), n),
        "letters": share(F.length("_letters"), chars),
        "upper": share(F.regexp_count("_letters", F.lit(r"\p{Lu}")), chars),
        "vowels": share(less(F.lower("_letters"), "aeiouyäöüáéíóúàèùâêîôû"), F.greatest(F.length("_letters"), F.lit(1))),
        "messy": share(F.size(F.filter("_toks", lambda x: less(x, "\\/|;:'<>$#&~^*=_%") >= 3)), n),
        "unspaced": share(F.regexp_count("_letters", F.lit(r"[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]")), chars),
    }
    return src.select(F.col(key), *[c.cast("double").alias(k) for k, c in cols.items()])


_PER_TOKEN = ("chars", "symbols", "common", "leaders", "numbers", "cells", "wordlike", "sentence_ends", "other_ends", "letters", "upper", "vowels", "messy", "unspaced", "mark", "alpha", "longest")
_COMMAS, _CJK = regex.compile(r"[\p{L}\p{N}%],(?=[\p{L}\p{N}<-])"), regex.compile(r"[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]")
_LEADERS, _NUMERIC, _WORDLIKE = regex.compile(r"\.{4,}|…{2,}"), regex.compile(_NUMBER), regex.compile(_WORD)
_WIDE, _LINE_MARK = regex.compile(r"\S  +(?=\S)"), regex.compile(_MARK)
_INLINE = regex.compile(r"(?:[-*•▪◦]|[0-9]{1,3}[.)]|\([a-z]\)|\[[0-9]{1,3}\])$")
_VOWELS, _MESSY, _PLAIN, _COMMON = frozenset("aeiouyäöüáéíóúàèùâêîôû"), frozenset("\\/|;:'<>$#&~^*=_%"), frozenset(".,;:!?'\"()-"), frozenset(COMMON)
_STOPS, _CLOSERS = frozenset(".!?。！？…"), "\"”’)]"
_LAST, _FIRST = _STOPS | frozenset(_CLOSERS), frozenset("-*•–·▪◦+([0123456789")  # of lines that may end a sentence, or begin with a mark


class _Classes(dict):
    """The class of a character, for str.translate: v, l, V, L letters (vowels, others; upper case), c unspaced
    scripts, 0 numbers, p and m marks that make a token messy (m also a symbol), s other symbols, . other marks."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)
        if kind[0] == "L":
            out = "c" if _CJK.match(c) else "vlVL"[2 * (kind == "Lu") + (c.lower() not in _VOWELS)]
        elif kind[0] == "N":
            out = "0"
        elif c in _MESSY:
            out = "p" if c in _PLAIN else "m"
        else:
            out = "." if c in _PLAIN else "s"
        self[code] = out
        return out


class _Letters(dict):
    """Letters as they are, all else a space, for str.translate."""

    def __missing__(self, code: int) -> str:
        self[code] = out = chr(code) if unicodedata.category(chr(code))[0] == "L" else " "
        return out


_CLASSES, _LETTERS = _Classes(), _Letters()
_ASCII_CLASSES, _ASCII_LETTERS = (bytes(ord(table[c]) if c < 128 else 0 for c in range(256)) for table in (_CLASSES, {c: chr(c) if chr(c).isalpha() else " " for c in range(128)}))


def _line_end(line: str) -> bool:
    """_END without a search: what stands before the closing marks."""
    return line.rstrip(_CLOSERS)[-1:] in _STOPS if line else False


def _line_mark(line: str) -> bool:
    """_MARK, tried only where its first two characters are possible."""
    a = line[0]
    return (a in "-*•–·▪◦+([" or line[1:2] in ".)" or a.isdigit()) and _LINE_MARK.match(line) is not None


def _token(t: str) -> tuple[float, ...]:
    """What one token adds to the sums of its text, in the order of _PER_TOKEN. Patterns are tried
    only where the classes of its characters leave them possible."""
    n, plain = len(t), t.isascii()
    kinds = t.encode().translate(_ASCII_CLASSES).decode().count if plain else t.translate(_CLASSES).count
    vowels, unspaced, upper = kinds("v") + kinds("V"), kinds("c"), kinds("V") + kinds("L")
    letters = vowels + unspaced + kinds("l") + kinds("L")
    marks, digits = kinds("m"), kinds("0")
    last, low = t[-1], t.lower()
    words = [low] * (letters > 0) if plain and letters in (0, n) else low.encode().translate(_ASCII_LETTERS).decode().split() if plain else low.translate(_LETTERS).split()
    wordlike = letters > 0 and not marks and not digits and (letters == n or _WORDLIKE.search(t) is not None)
    return (
        n, marks + kinds("s"), sum(map(_COMMON.__contains__, words)), len(_LEADERS.findall(t)) if "...." in t or "……" in t else 0,
        (t[0].isdigit() or t[0] in "<>~±+-n%|") and _NUMERIC.search(t) is not None, t.count("|") + t.count(";") + (len(_COMMAS.findall(t)) if "," in t else 0), wordlike,
        (last == "." and n > 1 and (t[-2].isalpha() or t[-2] in "%°)]")) + t.count("。"), last in ";:!?", letters, upper, vowels, marks + kinds("p") >= 3, unspaced, n <= 5 and letters < n and _INLINE.match(t) is not None, t[0].isalpha(), n,
    )


class _Tokens(dict):
    """Token ids and their sums; emptied when it holds too many."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[float, ...]] = []  # not yet in the table
        self.table = np.empty((0, len(_PER_TOKEN)), np.float32)  # counts, exact in single precision

    def __missing__(self, t: str) -> int:
        self[t] = n = len(self.table) + len(self.rows)
        self.rows.append(_token(t))
        return n

    def sums(self) -> np.ndarray:
        if self.rows:
            self.table, self.rows = np.vstack([self.table, np.array(self.rows, np.float32)]), []
        return self.table


def _lines(t: str) -> tuple[int, int, int, int]:
    """How many lines of a text are not blank, how many of them end a sentence, how many begin with a mark,
    and how many gaps are as wide as those between cells."""
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    wide = t.count("\t") + (len(_WIDE.findall(t)) if "  " in t else 0)
    lines = [y for x in t.split("\n") if (y := x.strip(" "))]
    return len(lines), sum([_line_end(x) for x in lines if x[-1] in _LAST]), sum([_line_mark(x) for x in lines if x[0] in _FIRST or x[1:2] in ".)"]), wide


def _distinct(place: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """How many different tokens every text has."""
    pairs = np.repeat(np.arange(len(size), dtype=np.int64) * most, size) + place
    pairs.sort()
    return np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])] // most, minlength=len(size))


def _statistics(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    known = _Tokens()
    for f in frames:
        if len(known) > 300_000:
            known = _Tokens()
        texts = [t or "" for t in f.iloc[:, 1]]
        place, size, tokens = tokenized(texts)
        at = np.flatnonzero(size)
        out, columns = {key: f.iloc[:, 0]}, dict.fromkeys(FEATURES, np.nan)
        if len(at):
            ids = [known[t] for t in tokens]
            table = dict(zip(_PER_TOKEN, np.ascontiguousarray(known.sums()[ids].T)))
            ends = np.cumsum(size)[at]
            starts = ends - size[at]
            v = {c: np.add.reduceat(table[c][place], starts).astype(float) for c in _PER_TOKEN if c not in ("mark", "alpha", "longest")}
            v["longest"] = np.maximum.reduceat(table["longest"][place], starts).astype(float)
            # an inline mark is one that a word follows in the same text
            follows = np.append(table["alpha"][place[1:]], np.float32(0))
            follows[ends - 1] = 0
            v["mark"] = np.add.reduceat(table["mark"][place] * follows, starts).astype(float)
            n, lines, punctuated, marked, wide = np.array([(k, *_lines(texts[i])) for i, k in zip(at.tolist(), size[at].tolist())], float).T
            distinct = _distinct(place, size, len(tokens))[at].astype(float)
            lines, letters = np.maximum(lines, 1), np.maximum(v["letters"], 1)
            values = {
                "words": n, "mean_word_length": v["chars"] / n, "symbol_ratio": v["symbols"] / v["chars"], "punctuated_lines": punctuated / lines, "common_words": v["common"] / n, "marked_lines": marked / lines, "inline_marks": v["mark"] / n, "leaders": v["leaders"] / n, "numbers": v["numbers"] / n,
                "cells": (v["cells"] + wide) / n, "wordlike": v["wordlike"] / n, "sentence_ends": v["sentence_ends"] / n, "other_ends": v["other_ends"] / n, "words_a_line": n / lines, "longest_share": v["longest"] / v["chars"], "distinct": distinct / n, "letters": v["letters"] / v["chars"], "upper": v["upper"] / v["chars"],
                "vowels": v["vowels"] / letters, "messy": v["messy"] / n, "unspaced": v["unspaced"] / v["chars"],
            }
            for c in FEATURES:
                columns[c] = np.full(len(f), np.nan)
                columns[c][at] = values[c]
        yield pd.DataFrame(out | columns)


def statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, one column per statistic), null for null and blank texts; one Arrow pass, no shuffle."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInPandas(lambda frames: _statistics(frames, key), f"`{key}` {kind}, " + ", ".join(f"`{c}` double" for c in FEATURES))


# Inspected examples, one group per component; the part before the dot is the kind.
_GIBBER = "kzjw; iwvoq: vaookx? ow! uevexv! qjkuwx: qi? ojzju? akx! uwzx; ijq? jxqku: jazue! vuek! vu; wukke"
EXAMPLES: dict[str, tuple[str, ...]] = {
    "prose.long": (
        "The samples were washed twice and then dried in air. No change of colour was seen after 4 days. We measured the weight of 12 plates and found that the loss was small. The second series, which was kept in the dark, showed the same trend (p = 0.04).",
        "Both the rate and the yield fell when the water was cold. It is not clear why the older plants were less affected than the younger ones.\n\nA third test, run at 20 °C, gave a mean of 3.4 mg, compared with 5.1 mg for the control. The difference was kept over all weeks.",
    ),
    "prose.short": ("The light of the lamp was measured at a low angle.", "Because the rate depends on the flow, every reading was repeated 12 times.", "A decline of the growth was seen in the outer layer."),
    "prose.lines": (
        "The samples were washed twice and then\ndried in air. No change of the colour was\nseen after 4 days. We measured the wei-\nght of 12 plates and found that the loss\nwas small, whereas the control was not.",
        "Annual Report 2011  14\nBoth the rate and the yield fell when\nthe water was cold. It is not clear\nwhy the older plants were less affected\nthan the younger ones.\n- 14 -",
        "J. Lamp. Res. 12 (2011)\n- 305 -\nFor the older lamps, the mean was taken\nfrom 26 readings made after 51 days. A\nsecond series gave no such result.",
        "- 6 -\nThe loss rose from 5.1 to 6.3 mg once salt had\nbeen added. Both lamps differed (p = 0.2).",
        "| 52 |\nThis light, although weak, was seen in most\nof the plates. Therefore the rate was taken\nas the mean of both.",
    ),
    "prose.headed": ("14 Annual Report 2011 Both the rate and the yield fell when the water was cold. It is not clear why the older plants were less affected than the youn- ger ones.", "Rules for lamps The loss was small in the wei- ghed plates. The others were kept in the dark until the end of the week. - 7 -"),
    "prose.formula": (
        "The rate was constant over the week (χ² = 2.41; p < 0.05). The loss rose with the flow, i.e. k = 1.2 × 10³. The others were kept in the dark [4, 17]; see eq. (3). In most cases x ≥ 3y + 2 holds for the mean.",
        "Loss of heat explained 31 % of the variance in the flow (χ² = 4.1; p < 0.05). Neither the rate nor the yield changed, i.e. k = 0.9 × 10³.",
    ),
    "prose.code": (
        "The sequence of the strain was deposited as CGTACCGATTACGGCATTACGGATCCAGTACCGGTTAACCGATACGGATTACCAGATTACGGACATTACGGATCC and compared with the older one. It was found in 4 of the 12 samples.",
        "The file has the key Qk29vZGJ5ZSB3b3JsZCBhbmQgdGhhbmtzIGZvciBhbGwgdGhlIGZpc2g0YXBwbGVz in its header, which is checked before each run of the test.",
    ),
    "prose.german": ("Die Proben wurden zweimal gewaschen und dann an der Luft getrocknet. Nach 4 Tagen war keine Änderung der Farbe zu sehen. Weder die Dichte noch die Temperatur konnte durch den Versuch erklärt werden.", "Der Verlust war bei der zweiten Reihe gering, obwohl das Wasser kalt war."),
    "prose.romance": ("Les plaques ont été lavées deux fois puis séchées à l'air. Après 4 jours, la perte ne dépend pas de la température de l'eau. Ni la couche ni la mesure ne s'expliquent par le courant.", "Las muestras se lavaron dos veces y después se secaron al aire. Los resultados indican que la pérdida no depende de la temperatura del agua durante el ensayo."),
    "prose.unspaced": ("試料の表面は二回洗浄された。四日後、色の変化は見られなかった。温度は20℃で一定に保たれた。", "水が冷たいと反応速度は明らかに減少した。一方、収量は変化しなかった。"),
    "prose.damaged": ("Tbe sarnples vvere wa5hed tvvice and tben dried in a1r. N0 change of co|our was seen afler 4 days. We rneasured the wei- ght of 12 p1ates and f0und that the 1oss was srnall.", "B0th the rate and tbe yie1d fe|l when the vvater was cold. lt is n0t clear why the 0lder p|ants were less affecfed."),
    "list.marked": ("- dry leaf\n- cold water\n- thin layer\n- open flow\n- late bloom", "List of plates\n• slow growth\n• clean edge\n• dark ring\n• broken stem", "Required light steps:\n* warm lamp\n* low angle\n* short pulse\n* wide beam"),
    "list.numbered": ("1. dry leaf\n2. cold water\n3. thin layer\n4. open flow", "1) slow growth\n2) clean edge\n3) dark ring\n4) broken stem", "(a) warm lamp\n(b) low angle\n(c) short pulse\n(d) wide beam", "List of lamps\n[1] slow growth\n[2] clean edge\n[3] dark ring", "Required light steps:\n1. warm lamp\n2. low angle\n3. short pulse\n4. wide beam", "List of plates\n1. heliol, edge class 4\n2. barolin, ring grade 2\n3. fenotan, stem type 7"),
    "list.sentences": ("- check the dry leaf;\n- check the cold water;\n- check the thin layer;\n- check the open flow;", "1. Record the weight of all plates.\n2. Record the colour of all plates.\n3. Record the growth of all plants.\n4. Record the loss of all plants.", "Required light steps:\n(a) check the warm lamp;\n(b) check the low angle;\n(c) check the short pulse;"),
    "list.checks": ("check the dry leaf;\ncheck the cold water;\ncheck the thin layer;\ncheck the open flow;", "List of plates\ncheck the slow growth;\ncheck the clean edge;\ncheck the dark ring;", "Record the weight of all plates.\nRecord the colour of all plates.\nRecord the growth of all plants.\nRecord the loss of all plants."),
    "list.bare": ("dry leaf\ncold water\nthin layer\nopen flow\nlate bloom\nslow growth", "clean edge\ndark ring\nbroken stem\nwarm lamp\nlow angle", "heliol, edge class 4\nbarolin, ring grade 2\nfenotan, stem type 7\nmoradin, lamp class 3"),
    "list.items": ("- heliol, edge class 4\n- barolin, ring grade 2\n- fenotan, stem type 7\n- moradin, lamp class 3", "List of plates\n(a) heliol, edge class 4\n(b) barolin, ring grade 2\n(c) fenotan, stem type 7", "1) heliol, edge class 4\n2) barolin, ring grade 2\n3) fenotan, stem type 7\n4) moradin, lamp class 3"),
    "list.leaders": ("Growth ........ 12\nEdge ........ 31\nRing ........ 58\nStem ........ 77", "1. Growth ........ 12\n2. Edge ........ 31\n3. Ring ........ 58\n4. Stem ........ 77", "List of lamps\n- Growth ........ 12\n- Edge ........ 31\n- Ring ........ 58"),
    "list.flat": ("- dry leaf - cold water - thin layer - open flow - late bloom", "1. dry leaf 2. cold water 3. thin layer 4. open flow", "• slow growth • clean edge • dark ring • broken stem"),
    "table.wide": ("edge    ring    stem    lamp\nheliol    5.3 ± 0.3    71 %    n/a\nS12    4.1 ± 0.2    -    340\nring    1.2 ± 0.9    12 %    88", "edge  ring  stem\nheliol  75.80  553\nS12  87.02  -\nstem  35.78  n/a"),
    "table.tabs": ("edge\tring\tstem\tlamp\nheliol\t5.3 ± 0.3\t71 %\tn/a\nS12\t4.1 ± 0.2\t-\t340", "edge\tring\tstem\nheliol\t75.80\t553\nS12\t87.02\t-\nstem\t35.78\tn/a"),
    "table.bars": ("edge | ring | stem\n---|---|---\nheliol | 5.3 ± 0.3 | 71 %\nS12 | 4.1 ± 0.2 | -", "edge | ring | stem | lamp\nheliol | 75.80 | <0.01 | 553\nS12 | 87.02 | 12 % | -\nstem | 35.78 | n/a | 41 %"),
    "table.commas": ("edge,ring,stem\nheliol,75.80,553\nS12,87.02,-\nstem,35.78,n/a\nfenotan,5.1,88", "edge,ring,stem,lamp\nheliol,5.3 ± 0.3,71 %,n/a\nS12,4.1 ± 0.2,<0.01,340"),
    "table.semicolons": ("edge; ring; stem\nheliol; 75.80; 553\nS12; 87.02; -\nstem; 35.78; n/a", "edge; ring; stem; lamp\nheliol; 5.3 ± 0.3; 71 %; n/a\nS12; 4.1 ± 0.2; <0.01; 340"),
    "table.flat": ("edge | ring | stem heliol | 75.80 | 553 S12 | 87.02 | - stem | 35.78 | n/a", "edge ring stem heliol 75.80 553 S12 87.02 - stem 35.78 n/a fenotan 5.1 88 %", "edge,ring,stem heliol,75.80,553 S12,87.02,- stem,35.78,n/a", "edge; ring; stem heliol; 75.80; 553 S12; 87.02; - stem; 35.78; n/a"),
    "junk.symbols": ("% \\$=/.#.>%~$%</$=##|= % /#| *_ *~%^|*^&<&_<$\\__^_>|&>/$", "^*#=\\>| #|~*\\_ .//&| $|* $$^<_|/*^=#_<._<|~_.||&></##"),
    "junk.digits": ("48l0;/.1:7|92'6-3\\5,;08|41'/.;2l:9-37|6.5\\'1;0/8,24:|7l", "9;2/||1'7/6|01-/\\62: .|4\\|93ll.l3,3:07\\:.4;1,l0;1,510l3'"),
    "junk.blocks": ("╢▗▪┤┃▁▷╎╲▽┸╄┴╻╩╩┄┘▁◄┚╌◫◺╚╆┎▹▔▐◂░▧┢┯", "▹╢◂▝▎◕◔●◰◰┷◲▍┟┟╈□┚▼▾○■┏▆▶┤◎"),
    "junk.mojibake": ("Ã¼â€œâ€™â€œ� Â°â€œ â€™xxâ€™xâ€œ nnÃ¼Â°â€œâ€œâ€œÃ©Ã©nÃ©x", "â€™ï»¿Ã¼Ã¼â€™nÂ°nn�â€™nÂ° xÃ¼Ã¼xÂ°�â€œ�Â°Ã¼Ã¼"),
    "junk.encoded": ("Qk29vZGJ5ZSB3b3JsZCBhbmQgdGhhbmtzIGZvciBhbGwgdGhlIGZpc2g0YXBwbGVzk2HwFadLycg3Z1mOq+UnRxzfZu0GY5i/eQsOA==", "x8Hk2JdPq9LmZ3vTgB7yRwC5nXfE1sUoAi6KlMhD4cVrNbQtYzFpGjWeIuSxOa0+/hLkJ"),
    "junk.sequence": ("CGTACCGATTACGGCATTACGGATCCAGTACCGGTTAACCGATACGGATTACCAGATTACGGACATTACGGATCC", "ORIGIN TTAACCGATACGGATTACCAGATTACGGACATTACGGATCCCGTACCGATTACGGCATTACGG"),
    "junk.consonants": ("x xghgc ' jt'' gsv.j|. g 1ftbqq r bh'lxf pxlz cll||'h cI fb.s s'hlpvf glib. rxvl zr vllv.m", "d xd h.cj ljin. f1 jdl ' xx d. fgcIhq v1 wmc' fqknklI rmmvc l ' mrdgI nvjnr|d"),
    "junk.vowels": (_GIBBER, "xaoeaxqj! kexjqajw; aixkooju: uiok: xiiaqwkq! vejawukkz? uvkkvivz; akouu; uxkuxzou! ezuw: okqwx"),
    "junk.repeat": ("page page page page page page page page page page page page page page page page", "0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0"),
    "junk.function": ("the of the of the of the of the of the of the of the of the of", "of the and of the and of the and of the and of the and of the and"),
    "junk.rules": ("....................\n|\n________________\n~~\n|\n-- --\n:;.,\n~~", "====\n~~\n:;.,\n|\n-- --\n____________\n|\n~~"),
}
RIDGE = 0.05  # added to the variances of standardized statistics
PRIOR = 5.0  # rows that a component's last mean weighs in the next
TOLERANCE, PASSES = 0.01, 50  # the gain in log likelihood a document that ends the fit, and its bound
SLOTS = 8  # tasks that add up the sums of all partitions
FEW = 0.2  # examples, in sum, below which a component is named by the nearest


def _prepared(frame: pd.DataFrame) -> np.ndarray:
    """Statistics on scales where their groups are roughly normal."""
    x = frame[list(FEATURES)].to_numpy(np.float64, copy=True)
    at = {f: i for i, f in enumerate(FEATURES)}
    for f in ("words", "words_a_line", "mean_word_length"):
        x[:, at[f]] = np.log1p(x[:, at[f]])
    for f in ("cells", "inline_marks", "leaders", "other_ends", "sentence_ends", "symbol_ratio"):
        x[:, at[f]] = np.sqrt(np.minimum(x[:, at[f]], 4))
    return x


_PAIRS = np.triu_indices(len(FEATURES))
BLOCK = 1024  # rows whose monomials are made at once


def _monomials(z: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """1, all statistics and all their products: densities and moments are linear in them. Stored column by column."""
    d = z.shape[1]
    z, out, k = np.ascontiguousarray(z.T), np.empty((1 + d + len(_PAIRS[0]), len(z)), kind), 1 + d
    out[0], out[1:k] = 1, z
    for i in range(d):
        out[k : k + d - i] = z[i] * z[i:]
        k += d - i
    return out.T


def _weights(model: dict) -> np.ndarray:
    """The log densities of the components as coefficients of the monomials."""
    out = []
    for w, mean, cov in zip(model["weight"], model["mean"], model["cov"]):
        inverse = np.linalg.inv(cov)
        square = -0.5 * inverse * (2 - np.eye(len(mean)))  # products of two statistics stand once
        out.append(np.concatenate([[np.log(w) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * mean @ inverse @ mean], inverse @ mean, square[_PAIRS]]))
    return np.array(out).T


def _posterior(phi: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the components and the log densities of the rows, but for a constant."""
    d = (weights.T @ phi.T).T
    top = d.max(1, keepdims=True)
    p = np.exp(d - top)
    total = p.sum(1, keepdims=True)
    return p / total, (top + np.log(total))[:, 0]


def _standardized(x: np.ndarray, model: dict, kind: type = np.float64) -> np.ndarray:
    return _monomials((x - model["center"]) / model["scale"], kind)


def _blocks(x: np.ndarray) -> Iterator[np.ndarray]:
    return (x[i : i + BLOCK] for i in range(0, len(x), BLOCK))


def _update(n: np.ndarray, s: np.ndarray, ss: np.ndarray, model: dict) -> None:
    """Maximization from sums over the standardized rows."""
    d = s.shape[1]
    n = n + 1e-9
    mean = s / n[:, None]
    cov = ss / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    lean = (PRIOR / (n + PRIOR))[:, None]
    model["mean"] = (1 - lean) * mean + lean * model["mean"]
    # components of few rows lean on a spherical shape
    lean = (d * PRIOR / (5 * n + d * PRIOR))[:, None, None]
    model["cov"] = (1 - lean) * cov + lean * 0.15 * np.eye(d) + RIDGE * np.eye(d)
    weight = np.maximum(n / n.sum(), 1e-6)
    model["weight"] = weight / weight.sum()


def _started(ex: np.ndarray, owner: np.ndarray, center: np.ndarray, scale: np.ndarray) -> dict:
    """Spheres around the examples of each group."""
    z, k, d = (ex - center) / scale, owner.max() + 1, ex.shape[1]
    mean = np.array([z[owner == i].mean(0) for i in range(k)])
    return {"center": center, "scale": scale, "mean": mean, "cov": np.repeat(np.eye(d)[None], k, 0), "weight": np.full(k, 1 / k)}


def _named(model: dict, ex: np.ndarray, owner: np.ndarray, kinds_of: list[str]) -> list[str]:
    """The kind of every component: that of most examples it answers for, or of the nearest one."""
    names = sorted(set(kinds_of))
    p, _ = _posterior(_standardized(ex, model), _weights(model))
    share = p / np.bincount(owner)[owner][:, None]
    said = np.array([[share[[kinds_of[o] == n for o in owner], k].sum() for n in names] for k in range(len(model["mean"]))])
    z = (ex - model["center"]) / model["scale"]
    near = [kinds_of[owner[((z - m) ** 2 / np.diag(c)).sum(1).argmin()]] for m, c in zip(model["mean"], model["cov"])]
    return [names[row.argmax()] if row.sum() > FEW else n for row, n in zip(said, near)]


def _sums(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of one matrix a partition (slot int, m binary): added up in SLOTS tasks, so SLOTS rows come back
    however many partitions there are."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            for m in f["m"]:
                x = np.frombuffer(m)
                total = x if total is None else total + x
        if total is not None:
            yield pd.DataFrame({"m": [total.tobytes()]})

    rows = parts.repartition(SLOTS, "slot").select("m").mapInPandas(add, "m binary").collect()
    return sum((np.frombuffer(bytes(r.m)) for r in rows), np.zeros(shape[0] * shape[1])).reshape(shape)


def _slot() -> int:
    """The slot of this partition's sums."""
    context = TaskContext.get()
    return context.partitionId() % SLOTS if context else 0


def fit(stats: DataFrame, passes: int = PASSES, tolerance: float = TOLERANCE) -> dict:
    """The mixture of the statistics: {weight, mean, cov, center, scale, kinds, trace}; trace holds the
    mean log likelihood before each pass."""
    spark = stats.sparkSession
    groups, d = list(EXAMPLES), len(FEATURES)
    shown = [(i, t) for i, g in enumerate(groups) for t in EXAMPLES[g]]
    ex = _prepared(next(_statistics(iter([pd.DataFrame({"id": range(len(shown)), "t": [t for _, t in shown]})]), "id")))
    owner, kinds_of = np.array([i for i, _ in shown]), [g.split(".")[0] for g in groups]
    rows = stats.select(*FEATURES)

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.zeros(1 + 2 * d)
        for f in frames:
            x = _prepared(f)
            m += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
        yield pd.DataFrame({"slot": [_slot()], "m": [m.tobytes()]})

    sums = _sums(rows.mapInPandas(moments, "slot int, m binary"), (1, 1 + 2 * d))
    n = sums[0, 0]
    center = sums[0, 1 : 1 + d] / n if n else ex.mean(0)
    scale = np.sqrt(np.maximum(sums[0, 1 + d :] / n - center**2, 0)) if n else ex.std(0)
    model = _started(ex, owner, center, np.maximum(scale, np.maximum(ex.std(0) / 3, 1e-3)))
    trace: list[float] = []
    for _ in range(passes if n else 0):
        now = spark.sparkContext.broadcast(model)

        def expect(frames: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            weights, total = _weights(now.value).astype(np.float32), None
            for x in (x for f in frames for x in _blocks(_prepared(f))):
                # single precision within a block, double over blocks
                phi = _standardized(x, now.value, np.float32)
                p, density = _posterior(phi, weights)
                part = np.vstack([p.T @ phi, np.zeros(phi.shape[1])]).astype(np.float64)
                part[-1, 0] = density.sum(dtype=np.float64)
                total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"slot": [_slot()], "m": [total.tobytes()]})

        v = _sums(rows.mapInPandas(expect, "slot int, m binary"), (len(groups) + 1, 1 + d + len(_PAIRS[0])))
        now.unpersist()
        trace.append(v[-1, 0] / n)
        if len(trace) > 1 and trace[-1] - trace[-2] < tolerance:
            break
        second = np.zeros((len(groups), d, d))
        second[:, _PAIRS[0], _PAIRS[1]] = second[:, _PAIRS[1], _PAIRS[0]] = v[:-1, 1 + d :]
        _update(v[:-1, 0], v[:-1, 1 : 1 + d], second, model)
    return {**model, "kinds": _named(model, ex, owner, kinds_of), "trace": trace}


def kinds(df: DataFrame, key: str, text: str, passes: int = PASSES, with_statistics: bool = True) -> DataFrame:
    """(key, statistics..., kind, certainty) of every text; kind is null for null and blank ones."""
    stats = stored(statistics(spread(df.select(F.col(key), F.col(text))), key, text), "statistics")
    model = df.sparkSession.sparkContext.broadcast(fit(stats.where(F.col("words").isNotNull()), passes))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = sorted(set(model.value["kinds"]))
        which, weights = np.array([[k == n for n in names] for k in model.value["kinds"]], float), _weights(model.value)
        for f in frames:
            out, there = f.copy() if with_statistics else f[[key]].copy(), f["words"].notna().to_numpy()
            kind, sure = np.full(len(f), None, object), np.full(len(f), np.nan)
            if there.any():
                p = np.vstack([_posterior(_standardized(x, model.value), weights)[0] @ which for x in _blocks(_prepared(f[there]))])
                kind[there], sure[there] = np.array(names, object)[p.argmax(1)], p.max(1)
            out["kind"], out["certainty"] = kind, sure
            yield out

    kept = T.StructType(list(stats.schema.fields) if with_statistics else [stats.schema[key]]).add("kind", "string").add("certainty", "double")
    return stats.mapInPandas(run, kept)


def unnatural(found: DataFrame, key: str) -> DataFrame:
    return found.where(F.col("kind") != "prose").select(key, "kind")


