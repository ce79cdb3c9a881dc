"""Noise in text from scanned pages: divided and misread words, page furniture, reflow.

Method: every word is looked up with a Levenshtein automaton (a bit-parallel one, WIDTH
errors) that runs down the trie of the attested vocabulary and returns all words within that
distance. Candidates are ranked with context: the log odds of the candidate against the
word as it was read are log(n candidate / n read) less the price of the edits (those that
scanners make are cheap, all others dear) plus how much more often than by chance the
candidate stands behind the left and before the right neighbour in the whole corpus. The
best candidate replaces the word if its odds are positive. Page furniture is found at the
edges of pages: lines that recur over the pages of a document, lines of a form that
recurring lines of other documents have, and page numbers; then it is taken out and the
rest is reflowed into paragraphs.

No part of the vocabulary is left out and none is broadcast: the trie is built in shards of
at most SHARD words of one length, counts of joined words and of neighbours are joined.
What is broadcast are bit tables of bounded size (bits.py), whose false hits the joins drop, and
the header forms up to FORMS of them; beyond that each text's own forms are joined.
Null and empty texts have no cases and repair to themselves; rows repeated under one key are
repaired each and reported once; ties between candidates go to the alphabetically first.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlight.llm import bits
from cairnlight.llm.words import tokenized
from cairnlight.session import broadcast_if_small, spread, stored

WIDTH = 2  # errors the automaton admits
ATTESTED = 5  # occurrences a vocabulary word must have
FIRST, MORE = math.log(12), math.log(3)  # prices of edits: the first and a further confusion,
OTHER, GAP = math.log(5000), math.log(1_000_000)  # another character, a lost or an added one
LETTERS = 5  # letters of a word that other edits are considered for
SHARD = 20_000  # vocabulary words of one trie, and words looked up in it by one task
EDGES = 2  # lines at either end of a page that may be furniture
PAGES = 200  # neighbouring pages over which a line may recur
RECURS = 4  # pages of those on which a line is a header, or a fifth of them, at least 2
FORMS = 100_000  # header forms that are broadcast

# What scanners make of a character, right reading first.
CONFUSIONS = (
    ("l", "1"), ("l", "|"), ("l", "i"), ("i", "1"), ("i", "l"), ("i", "|"), ("i", "í"), ("i", "ì"), ("i", "!"), ("i", "j"), ("o", "0"), ("0", "o"), ("s", "5"), ("s", "$"), ("b", "6"), ("b", "h"), ("h", "b"), ("g", "9"), ("g", "q"), ("a", "@"), ("a", "o"), ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("t", "+"), ("t", "l"),
    ("z", "2"), ("b", "8"), ("q", "g"), ("u", "v"), ("v", "u"), ("m", "rn"), ("rn", "m"), ("w", "vv"), ("d", "cl"), ("cl", "d"), ("n", "ii"), ("u", "ii"), ("n", "u"), ("u", "n"), ("m", "nn"), ("m", "iii"), ("h", "li"), ("li", "h"), ("k", "lc"), ("a", "á"), ("o", "ó"), ("e", "é"), ("u", "ú"), ("ö", "o"), ("ü", "u"), ("ä", "a"), ("n", "ri"), ("ri", "n"), ("g", "y"), ("y", "v"),
)
STRONG = frozenset("1|0569@$!+28í")  # marks that stand in no word
HYPHENS = "-‐‑­¬"
_INVISIBLE = "​‌‍⁠﻿"

_STRIP = regex.compile(r"^[^\p{L}\p{N}@|]+|[^\p{L}\p{N}@|]+$")
_TOKEN = regex.compile(r"\S+")
_BREAK = re.compile(rf"[{HYPHENS}][{_INVISIBLE}]*([ \t]*\r?\n[ \t]*|[ \t]+)((?:[^\W_]|[@|!$+'’-])*(?:[^\W_]|[@|]))")
_INNER = frozenset("@|!$+'’-")
_ROMAN = r"[ivxlc]{1,7}"
_ORNAMENT = regex.compile(rf"^(?:[-–—|•·*~\[(<]+\s*(?P<a>[\dlIoO|]{{1,5}}|{_ROMAN})\s*[-–—|•·*~\])>]+|(?:page|pag\.?|p\.|pp\.|seite|página|s\.)\s*(?P<b>[\dlIoO]{{1,5}}|{_ROMAN})(?:\s*(?:of|/|von|de|sur)\s*[\dlIoO]{{1,5}})?|(?P<c>[\dlIoO]{{1,5}})\s*(?:of|/|von)\s*[\dlIoO]{{1,5}})$", regex.I)
_BARE = regex.compile(rf"^(?:\d{{1,5}}|[\dlIoO]{{1,4}}|{_ROMAN})$")
_ORNATE, _BARISH = frozenset("-–—|•·*~[(<pPsSlIoO0123456789"), frozenset("0123456789lIoOivxc")


def ornate(line: str) -> bool:
    """Whether a line is a page number with an ornament."""
    return line[:1] in _ORNATE and _ORNAMENT.match(line) is not None


def bare(line: str) -> bool:
    return len(line) < 8 and line[:1] in _BARISH and _BARE.match(line) is not None


# The letters that stand for those they are confused with when lines are compared.
_ALIKE = str.maketrans({"0": "o", "1": "l", "|": "l", "!": "l", "i": "l", "í": "l", "5": "s", "$": "s", "6": "b", "8": "b", "2": "z", "9": "g", "@": "a", "e": "c", "u": "v", "f": "t"})


_OTHERS = regex.compile(r"[^\p{L}]+")


class _Alike(dict):
    """For str.translate: letters that stand for others as these, other letters as they are, all else a space."""

    def __missing__(self, code: int) -> str:
        self[code] = out = _ALIKE.get(code) or _OTHERS.sub(" ", chr(code))
        return out


_FOLDS = _Alike()


@functools.lru_cache(maxsize=100_000)
def folded(text: str) -> str:
    """Letters only, with the characters that are confused most made equal."""
    t = text.lower()
    for read, right in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "n")):
        t = t.replace(read, right)
    return "".join(t.translate(_FOLDS).split())


@functools.lru_cache(maxsize=20_000)
def _places(text: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(text):
        masks[c] = masks.get(c, 0) | (1 << i)
    return masks


def distance(a: str, b: str, most: int) -> int:
    """Edit distance, or most + 1 if it is larger; the columns of the table as bits."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if not m:
        return n
    get, full, last = _places(b).get, (1 << m) - 1, 1 << (m - 1)
    up, down, score, bound = full, 0, m, most + n
    for c in a:
        bound -= 1  # each further character lessens the score by one at most
        eq = get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(h | up)), up & h
        score += ((more & last) != 0) - ((less & last) != 0)
        if score > bound:
            return most + 1
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | (full & ~(v | more)), more & v
    return min(score, most + 1)


# --- candidate retrieval -----------------------------------------------------------------


class Trie:
    """Vocabulary as nested dictionaries, forwards and backwards; '' marks the end of a word."""

    def __init__(self, words: Iterator[str] | list[str]):
        self.root: dict = {}
        self.back: dict = {}
        self.longest = 0
        for w in words:
            self.longest = max(self.longest, len(w))
            for root, letters in ((self.root, w), (self.back, w[::-1])):
                node = root
                for c in letters:
                    node = node.setdefault(c, {})
                node[""] = w

    def within(self, word: str, errors: int = WIDTH) -> list[str]:
        """All words within the edit distance: the automaton's states (bit sets of matched
        lengths, one per number of errors) run down the trie and die out where none is left.

        Either the first half of the word holds less than all errors: forwards, the last error is
        only admitted behind that half. Or it holds all: backwards, the second half must match as it stands."""
        if len(word) > self.longest + errors:
            return []
        full, half = (2 << len(word)) - 1, len(word) // 2
        behind = full & ~((1 << half) - 1)
        if errors < 2:
            return sorted(_run(self.root, word, (errors > 0) * full, 0))
        rest = full & ~((1 << (len(word) - half)) - 1)
        return sorted(_run(self.root, word, full, behind) | _run(self.back, word[::-1], rest, rest))


def _run(root: dict, word: str, second: int, third: int) -> set[str]:
    """The words whose path keeps a state of up to 0, 1 or 2 errors; states of 1 and 2 only at the lengths of these masks."""
    masks: dict[str, int] = {}
    for i, c in enumerate(word):
        masks[c] = masks.get(c, 0) | (2 << i)
    last = 1 << len(word)
    out, get = set(), masks.get
    stack = [(root, 1, 3 & second, 7 & third)]
    while stack:
        node, a, b, c = stack.pop()
        for letter, child in node.items():
            if letter == "":
                if (a | b | c) & last:
                    out.add(child)
                continue
            m = get(letter, 0)
            x = (a << 1) & m
            y = ((b << 1) & m | a | ((a | x) << 1)) & second
            z = ((c << 1) & m | b | ((b | y) << 1)) & third
            if x | y | z:
                stack.append((child, x, y, z))
    return out


_BY_READ: dict[str, list[tuple[str, int]]] = {}
for _right, _read in CONFUSIONS:
    _BY_READ.setdefault(_read[0], []).append((_right, len(_read)))
_READS = frozenset((r, w) for r, w in CONFUSIONS)


def price(read: str, right: str, errors: int = WIDTH) -> tuple[float, int]:
    """The least price of the edits that turn the right word into what was read, and how many of them no
    scanner confusion explains (at most `errors`)."""
    n, m = len(read), len(right)
    best: dict[tuple[int, int], tuple[int, float, int]] = {(0, 0): (0, 0.0, 0)}  # other edits, their price, confusions

    def better(i: int, j: int, cost: tuple[int, float, int]) -> None:
        if (i, j) not in best or cost < best[i, j]:
            best[i, j] = cost

    for i in range(n + 1):
        for j in range(max(0, i - 4), min(m, i + 4) + 1):
            if (now := best.get((i, j))) is None:
                continue
            other, paid, known = now
            if i < n and j < m and read[i] == right[j]:
                better(i + 1, j + 1, now)
            if i < n and known < 4:
                for r, size in _BY_READ.get(read[i], ()):
                    if right.startswith(r, j) and (r, read[i : i + size]) in _READS:
                        better(i + size, j + len(r), (other, paid, known + 1))
            if other < errors:
                for x, y, more in ((1, 1, OTHER), (1, 0, GAP), (0, 1, GAP)):
                    if i + x <= n and j + y <= m:
                        better(i + x, j + y, (other + 1, paid + more, known))
    other, paid, known = best.get((n, m), (errors + 1, math.inf, 0))
    return paid + (FIRST + (known - 1) * MORE if known else 0.0), other


_RARE_HYPHENS = HYPHENS.replace("-", "")
_BEHIND = frozenset(" \t\r\n" + _INVISIBLE)


def _minus_breaks(text: str) -> Iterator[re.Match]:
    """_BREAK.finditer() for a text whose only hyphens are '-': tried only at those that space follows."""
    at = text.find("-")
    while at >= 0:
        m = _BREAK.match(text, at) if text[at + 1 : at + 2] in _BEHIND else None
        if m:
            yield m
        at = text.find("-", m.end() if m else at + 1)


def broken(text: str) -> Iterator[tuple[int, int, int, str, str, str]]:
    """(start, mark, end, left, gap, right) where a hyphen is followed by space and a word."""
    for m in _BREAK.finditer(text) if any(h in text for h in _RARE_HYPHENS) else _minus_breaks(text):
        at = start = m.start()
        while start and (text[start - 1].isalnum() or text[start - 1] in _INNER):
            start -= 1
        if start < at and (text[at - 1].isalnum() or text[at - 1] in "@|"):
            yield start, at, m.end(), text[start:at], m.group(1), m.group(2)


def unbroken(text: str) -> str:
    """The text without its divided words."""
    out, at = [], 0
    for start, _, end, *_ in broken(text):
        if start >= at:
            out += [text[at:start], " "]
            at = end
    return "".join(out) + text[at:] if out else text


@functools.lru_cache(maxsize=200_000)
def word_of(token: str) -> str:
    """A token in lower case without invisible characters, ligatures and the punctuation around it."""
    t = token.translate(dict.fromkeys(map(ord, _INVISIBLE + "­")))
    t = t.replace("ﬁ", "fi").replace("ﬂ", "fl").replace("ﬀ", "ff").replace("ﬃ", "ffi").replace("ﬄ", "ffl")
    return _STRIP.sub("", t).lower()


def _worth(word: str) -> bool:
    return len(word) >= 3 and sum(c.isalpha() for c in word) * 2 > len(word)


def _summed(profile: DataFrame) -> DataFrame:
    return profile.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))


_PROFILE = "place string, doc string, page_no int, bare string, line string, fold string, word string, n long"


def _profile(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In one pass: the words of every batch with their counts (words divided at line ends are left out),
    and the lines at the edges of texts of known pages."""
    for f in frames:
        rows = []
        for place, doc, page, t in zip(f["place"], f["doc"], f["page_no"], f["text"]):
            if place is not None:
                rows += [(place, doc, page, *line, None, None) for line in edge_lines(t)]
        at, _, tokens = tokenized(list(map(unbroken, f["text"])))
        c: Counter = Counter()
        for token, n in zip(tokens, np.bincount(at, minlength=len(tokens)).tolist()):
            if _worth(w := word_of(token)):
                c[w] += n
        rows += [(None, None, None, None, None, None, w, n) for w, n in c.items()]
        yield pd.DataFrame(rows, columns=["place", "doc", "page_no", "bare", "line", "fold", "word", "n"]).astype({"page_no": "Int32", "n": "Int64"})


def _lookup(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """One shard of the vocabulary (left) and the words to look up in it."""
    counts = dict(zip(left["right"], left["n"])) if len(right) else {}
    trie, rows, most = Trie(counts), [], max(counts.values(), default=0)
    for w, n in zip(right["word"], right["n_read"]):
        rare = n < ATTESTED and len(w) >= LETTERS  # others are misread by confusions only
        least = n if rare else n * math.exp(FIRST) - 0.5
        if most <= least:  # nothing here is that much more frequent
            continue
        for v in trie.within(w):
            if v != w and counts[v] > least:
                cost, other = price(w, v)
                if other and (not rare or other > 1 and len(w) < 2 * LETTERS):
                    continue
                if other or math.log(counts[v] / n) >= FIRST and (len(w) > 3 or not STRONG.isdisjoint(w)):
                    rows.append((w, int(n), v, float(cost), int(counts[v])))
    return pd.DataFrame(rows, columns=["word", "n_read", "right", "price", "n"])


def misreadings(words: DataFrame, least: int = ATTESTED, shard: int = SHARD) -> DataFrame:
    """(word, n_read, right, price, n): for each of the words (word, n) all attested ones it may be a misreading of.

    Shards of the vocabulary hold words of one length; a word is looked up in those of all lengths
    it can come from. Both sides of a shard are bounded, however the words are spread."""
    sized = words.withColumn("size", F.length("word"))
    known = sized.where(F.col("n") >= least).select(F.col("word").alias("right"), "n", "size")
    asked = sized.select("word", F.col("n").alias("n_read"), F.explode(F.sequence(F.greatest(F.col("size") - WIDTH, F.lit(1)), F.col("size") + WIDTH)).alias("size"))
    cuts = known.groupBy("size").agg(F.ceil(F.count("*") / shard).alias("cuts")).join(asked.groupBy("size").agg(F.ceil(F.count("*") / shard).alias("parts")), "size")
    cuts = stored(cuts, "cuts")
    at = lambda c, n: F.pmod(F.xxhash64(c), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = known.join(cuts, "size").select("right", "n", "size", at("right", F.col("cuts")).alias("cut"), every("parts").alias("part"))
    right = asked.join(cuts, "size").select("word", "n_read", "size", at("word", F.col("parts")).alias("part"), every("cuts").alias("cut"))
    keys = ("size", "cut", "part")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_lookup, "word string, n_read long, right string, price double, n long")


# --- page furniture ----------------------------------------------------------------------


class Line(NamedTuple):
    start: int
    end: int
    text: str


_MARGIN = " \t\r\f\v\xa0" + _INVISIBLE


def edges_of(text: str) -> tuple[list[Line], list[Line]]:
    """The first EDGES lines that are not blank, and the last EDGES of the others, from the outside inwards."""
    head: list[Line] = []
    tail: list[Line] = []
    at, size = 0, len(text)
    while at < size and len(head) < EDGES:
        end = text.find("\n", at)
        end = size if end < 0 else end
        if t := text[at:end].strip(_MARGIN):
            s = text.index(t[0], at)
            head.append(Line(s, s + len(t), t))
        at = end + 1
    end = size
    while end >= at and len(tail) < EDGES:
        start = text.rfind("\n", at, end) + 1 or at
        if t := text[start:end].strip(_MARGIN):
            s = text.index(t[0], start)
            tail.append(Line(s, s + len(t), t))
        end = start - 1
    return head, tail


_NUMBER_FIRST = re.compile(rf"^(\d{{1,5}}|{_ROMAN})(?:\s{{2,}}|\t| [|·–-] )(?=\S)")
_NUMBER_LAST = re.compile(rf"(?<=\S)(?:\s{{2,}}|\t| [|·–-] )(\d{{1,5}}|{_ROMAN})$")


_DIGITISH = frozenset("0123456789ivxlc")


def without_number(line: str) -> tuple[str, str]:
    """A line without the page number before or behind it, and where that stood."""
    if line[:1] in _DIGITISH and (m := _NUMBER_FIRST.match(line)):
        return line[m.end() :], "before"
    if line[-1:] in _DIGITISH and (m := _NUMBER_LAST.search(line)):
        return line[: m.start()], "behind"
    return line, "none"


def form_of(line: str, frequent: frozenset[str] | None = None) -> str:
    """The form of a header: digits folded, names (words that are not frequent) as classes."""
    return " ".join(_form(t, frequent) for t in line.split())


_DIGITS = regex.compile(r"\d+")


@functools.lru_cache(maxsize=100_000)
def _form(t: str, frequent: frozenset[str] | None) -> str:
    w = t.strip(".,;:()").lower()
    if any(c.isdigit() for c in t):
        return _DIGITS.sub("#", t.lower())
    if not any(c.isalpha() for c in t) or frequent is not None and w in frequent:
        return w or t
    return "W" if t[:1].isupper() else "w"


def number_of(line: str, page_no: int | None, alone: bool) -> bool:
    """Whether a line is nothing but a page number: with an ornament, or bare and this page's own."""
    if ornate(line):
        return True
    if not bare(line):
        return False
    if page_no is None:
        return alone
    return line == str(page_no) or folded_number(line) == str(page_no) or line.lower() == roman(page_no)


def folded_number(line: str) -> str:
    return line.translate(str.maketrans("lI|oO", "11100"))


@functools.lru_cache(maxsize=10_000)
def roman(n: int) -> str:
    out = ""
    for v, s in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= v:
            out, n = out + s, n - v
    return out


class Furniture(NamedTuple):
    start: int
    end: int
    kind: str
    piece: str


@functools.lru_cache(maxsize=200_000)
def _far(fold: str, head: str) -> int | None:
    """The distance of a line to a known header, None if it is no reading of it."""
    most = max(1, len(head) // 6)
    if not fold or abs(len(fold) - len(head)) > most:
        return None
    d = distance(fold, head, most)
    return d if d <= most else None


def furniture_of_lines(text: str, page_no: int | None, known: list[str], forms: frozenset[str], frequent: frozenset[str]) -> list[Furniture]:
    """Header, footer and page-number lines at the edges of a text with line breaks."""
    out = []
    for side in edges_of(text):
        for k, line in enumerate(side):
            inner = side[k + 1] if k + 1 < len(side) else None
            head, _ = without_number(line.text)
            if number_of(line.text, page_no, inner is None or not bare(inner.text)):
                out.append(Furniture(line.start, line.end, "page_number", line.text))
            elif is_header(head, forms, frequent) or known and any(_far(fold, h) is not None for fold in (folded(head),) for h in known):
                out.append(Furniture(line.start, line.end, "header", line.text))
            else:
                break
    return out


def is_header(line: str, forms: frozenset[str], frequent: frozenset[str]) -> bool:
    if line[-1:] in _CLOSED or not forms:
        return False
    shaped, openings, _ = _shapes(forms)
    words = line.split()
    return len(words) in shaped and " ".join([_form(w, frequent) for w in words[:2]]) in openings and form_of(line, frequent) in forms


_CLOSED = frozenset((".", ",", ";", *HYPHENS))


@functools.lru_cache(maxsize=64)
def _shapes(forms: frozenset[str]) -> tuple[frozenset[int], frozenset[str], frozenset[str]]:
    """The numbers of tokens of all forms, their first two tokens and their last two."""
    return frozenset(f.count(" ") + 1 for f in forms), frozenset(" ".join(f.split(" ")[:2]) for f in forms), frozenset(" ".join(f.split(" ")[-2:]) for f in forms)


@functools.lru_cache(maxsize=2000)
def _styles(styles: tuple[str, ...]) -> tuple[list[tuple[str, int]], frozenset[int], bool]:
    """The folds of a document's headers with their numbers of tokens; whether it writes page numbers next to them."""
    heads = [(folded(h), len(h.split())) for h in (without_number(x)[0] for x in styles)]
    return heads, frozenset(n for _, n in heads), not styles or any(without_number(x)[1] != "none" for x in styles)


class _Edges:
    """The first and the last `most` tokens of a text; their places are looked for when they are asked."""

    def __init__(self, text: str, most: int):
        self.text, self.words, self.first, self.start, self.tail = text, text.split(None, most), 0, len(text), len(text)
        self.first = len(self.words)
        if len(self.words) > most:  # the last one is the rest of the text
            self.first = most
            self.start = text.rindex(self.words[-1])
            rest = self.words.pop().rsplit(None, most)
            self.tail = self.start + (len(rest[0]) if len(rest) > most else 0)
            self.words += rest[1:] if len(rest) > most else rest

    def place(self, i: int) -> tuple[int, int]:
        found = _TOKEN.finditer(self.text, 0, self.start) if i < self.first else _TOKEN.finditer(self.text, self.tail)
        return next(itertools.islice(found, i if i < self.first else i - self.first, None)).span()


def furniture_of_flat(text: str, page_no: int | None, known: list[str], styles: list[str], forms: frozenset[str], frequent: frozenset[str]) -> list[Furniture]:
    """The same at both ends of a text that was flattened to one line."""
    heads, counts, attached = _styles(tuple(styles))
    shaped, openings, closings = _shapes(forms)
    sizes = _sorted_sizes(counts, shaped)
    # two headers with a number on either side are the most that an end can hold
    edges = _Edges(text, 2 * max((*sizes[-1:], 3)) + 4)
    words = edges.words
    single = lambda a, b: " ".join(words[a:b])
    shape = lambda i: _form(words[i], frequent)
    out: list[Furniture] = []

    def number(i: int) -> bool:
        return bare(words[i]) and number_of(words[i], page_no, False)

    # most texts don't have the number of their page at the ends, so that no header can stand next to it
    own = () if page_no is None else (len(str(page_no)), len(roman(page_no)))
    beside_number = ((0, 0), (1, 0), (0, 1)) if attached and own and any([len(w) in own and w[0] in _BARISH and number(i) for i, w in enumerate(words)]) else ((0, 0),)

    def known_far(a: int, b: int) -> float | None:
        fold = folded(single(a, b))
        return min((float(x) for h, n in heads if n == b - a and (x := _far(fold, h)) is not None), default=None)

    def formed(a: int, b: int) -> bool:
        opens = b >= len(words) or words[b][:1].isupper() or words[b][:1] in "-|(" or words[b][:1].isdigit()
        return opens and words[b - 1][-1] not in _CLOSED and f"{shape(a)} {shape(a + 1)}" in openings and f"{shape(b - 2)} {shape(b - 1)}" in closings and " ".join(map(shape, range(a, b))) in forms

    def ornament(a: int, front: bool, left: int) -> tuple[str, int, int] | None:
        for n in (3, 2):
            s = a if front else a - n
            if n <= left and words[s][:1] in _ORNATE and ornate(single(s, s + n)):
                return "page_number", s, s + n
        return None

    def header(a: int, front: bool, left: int) -> tuple[str, int, int] | None:
        """The nearest to a known one, or of a known form (which counts as half an error), with a bare number
        next to it where this document writes it so."""
        best, hit = None, None
        for before, behind in beside_number:
            beside = (before if front else behind) > 0  # the number stands at the outer end, the same for all sizes
            if left < 2 + before + behind or beside and not number(a if front else a - 1):
                continue
            outer = a + beside if front else a - beside
            fits = (f"{shape(outer)} {shape(outer + 1)}" in openings if front else f"{shape(outer - 2)} {shape(outer - 1)}" in closings) if shaped else False
            for n in sizes if fits else counts:
                if n < 2 or n + before + behind > left:
                    continue
                h = outer if front else outer - n
                s = h - before
                if not beside and (before and not number(s) or behind and not number(h + n)):
                    continue
                far = known_far(h, h + n) if n in counts else None
                if far is None and fits and n in shaped and formed(h, h + n):
                    far = 0.5
                if far is not None and (best is None or (far, -before - behind, n) < best):
                    best, hit = (far, -before - behind, n), ("header", s, s + n + before + behind)
        return hit

    for front in (True, False):
        a = 0 if front else len(words)
        for _ in range(EDGES):
            left = len(words) - a if front else a
            hit = ornament(a, front, left) or header(a, front, left)
            if hit is None and left and number_of(words[a if front else a - 1], page_no, False):
                hit = ("page_number", a, a + 1) if front else ("page_number", a - 1, a)
            if hit is None:
                break
            kind, s, e = hit
            out.append(Furniture(edges.place(s)[0], edges.place(e - 1)[1], kind, single(s, e)))
            a = e if front else s
        if front and out and out[-1].end >= len(text.rstrip()):
            break
    return out


@functools.lru_cache(maxsize=2000)
def _sorted_sizes(counts: frozenset[int], shaped: frozenset[int]) -> list[int]:
    return sorted(counts | shaped)


def stretches(text: str, frequent: frozenset[str], sizes: frozenset[int]) -> set[str]:
    """All forms that the stretches at the ends of a text have: what header forms can match in it."""
    if "\n" in text.strip():
        head, tail = edges_of(text)
        return {form_of(without_number(x.text)[0], frequent) for x in (*head, *tail)}
    reach = 2 * max((*sizes, 3)) + 4
    words = _Edges(text, reach).words
    shapes = [_form(w, frequent) for w in words]
    return {" ".join(shapes[i : i + n]) for n in sizes for i in range(len(shapes) - n + 1)}


def outside(text: str, taken: list[tuple[int, int]]) -> list[str]:
    """The tokens of a text without some stretches; each of these leaves a mark between its neighbours."""
    if not taken:
        return text.split()
    out, at = [], 0
    for a, b in taken:
        if a >= at:
            out += [text[at:a], " \0 "]
        at = max(at, b)
    return "".join([*out, text[at:]]).split()


# --- divided words and reflow ------------------------------------------------------------


# Words that follow a hyphen which leaves out the second half of a compound.
_AND = frozenset(("and", "or", "und", "oder", "et", "ou", "y", "o"))


_LEAD = regex.compile(r"^[^\p{L}\p{N}@|]+")


class Break(NamedTuple):
    """A word that may be divided. `sure`: at a line end, or by a mark that stands for nothing else."""

    start: int
    end: int
    left: str
    right: str
    sure: bool


def breaks(text: str) -> list[Break]:
    out = []
    for start, mark, end, left, gap, right in broken(text):
        if left.isnumeric() or right.isnumeric() or not any(map(str.isalpha, left)) or not any(map(str.isalpha, right)) or right[:1].isupper() and not left.isupper():
            continue
        flat = "\n" not in gap
        if flat and right.lower() in _AND:
            continue
        l = word_of(left + "x")[:-1] or left.lower()  # noqa: E741
        out.append(Break(start, end, _LEAD.sub("", l), word_of(right), not flat or text[mark] != "-"))
    return out


def rejoined(halves: DataFrame, counted: DataFrame) -> DataFrame:
    """(left, behind, joined, divided) of the halves (left, behind) of words: a compound keeps its hyphen;
    divided says whether the word is one at all where only a hyphen and a space stand between."""
    l, r = F.col("left"), F.col("behind")
    asked = {"plain": F.concat(l, r), "compound": F.concat(l, F.lit("-"), r), "tail": F.substring_index(l, "-", -1), "l": l, "r": r}
    roles = halves.select(l, r, F.inline(F.array(*[F.struct(F.lit(k).alias("role"), c.alias("word")) for k, c in asked.items()])))
    met = roles.join(counted, "word", "left").groupBy("left", "behind").agg(*[F.coalesce(F.max(F.when(F.col("role") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in asked])
    tail = (F.col("n_tail") >= ATTESTED) & (F.col("n_r") >= ATTESTED) & (F.length(asked["tail"]) > 3) & (F.length(r) > 3)
    compound = (F.col("n_compound") > F.col("n_plain")) | ((F.col("n_compound") == 0) & (F.col("n_plain") == 0) & tail)
    whole = F.when(compound, F.col("n_compound")).otherwise(F.col("n_plain"))
    return met.select("left", "behind", F.when(compound, asked["compound"]).otherwise(asked["plain"]).alias("joined"), ((whole >= ATTESTED) | (F.col("n_r") < ATTESTED) | (F.col("n_l") < ATTESTED)).alias("divided"))


def reflowed(text: str, spans: list[Furniture], breaks: list[tuple[int, int, str]], right: dict[str, str]) -> str:
    """The text without furniture, with divided and misread words restored, one line per paragraph."""
    parts, at = [], 0
    edits = sorted([(f.start, f.end, None) for f in spans] + [(a, b, w) for a, b, w in breaks if not any(f.start < b and a < f.end for f in spans)])
    for a, b, w in edits:
        if a < at:
            continue
        parts.append(text[at:a])
        if w is not None:
            parts.append(w.capitalize() if text[a : a + 1].isupper() else w)
        at = b
    parts.append(text[at:])
    body = "".join(parts)

    def fix(m: regex.Match) -> str:
        token, w = m.group(), word_of(m.group())
        v = right.get(w)
        if v is None:
            return token
        k = token.lower().find(w)
        return token[:k] + (v.upper() if token[k : k + len(w)].isupper() and len(w) > 2 else v.capitalize() if token[k : k + 1].isupper() else v) + token[k + len(w) :] if k >= 0 else token

    paragraphs = [" ".join(p.split()) for p in regex.split(r"\n\s*\n", _TOKEN.sub(fix, body))]
    return "\n\n".join(p for p in paragraphs if p)


# --- Spark -------------------------------------------------------------------------------


def edge_lines(text: str) -> Iterator[tuple[str, str, str]]:
    """(line without its number, line, its fold) of what may be headers at both ends."""
    if "\n" not in text.strip():
        return
    head, tail = edges_of(text)
    for line in (*head, *tail):
        if line.text[-1] in _CLOSED:
            continue
        head, _ = without_number(line.text)
        fold = folded(head)
        if len(fold) > 5 and head[-1] not in _CLOSED:
            yield head, line.text, fold


def headers_of(texts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, frozenset[str]]:
    """(place, known, styles) of the lines that recur over the neighbouring pages of a document; (form) of
    the forms such lines have in several documents; the words frequent in them.

    A place holds at most PAGES pages with 2 * EDGES lines each. A frequent word stands in a
    fiftieth of the documents with headers, so there are at most fifty times the words of one
    document's headers."""
    sizes = texts.groupBy("place").agg(F.countDistinct("page_no").alias("pages"))
    often = edges.groupBy("place", "fold").agg(F.countDistinct("page_no").alias("on"), F.min("bare").alias("bare"), F.mode("line").alias("line"), F.first("doc").alias("doc"))
    kept = stored(often.join(sizes, "place").where(F.col("on") >= F.greatest(F.lit(2), F.least(F.lit(RECURS), F.col("pages") * 0.2))).select("place", "doc", "fold", "bare", "line"), "headers")
    of_place = kept.groupBy("place").agg(F.collect_set("fold").alias("known"), F.collect_set("line").alias("styles"))
    some = kept.agg(F.countDistinct("doc")).first()[0]
    frequent = kept.select("doc", F.explode(F.split(F.lower("bare"), r"[\s.,;:()]+")).alias("w")).where("w rlike '[a-z]'").groupBy("w").agg(F.countDistinct("doc").alias("docs")).where(F.col("docs") >= max(3, some / 50))
    common = frozenset(r.w for r in frequent.select("w").toLocalIterator())

    def shape(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc": list(f["doc"]), "form": [form_of(b, common) for b in f["bare"]]})

    forms = kept.select("doc", "bare").mapInPandas(shape, "doc string, form string").groupBy("form").agg(F.countDistinct("doc").alias("docs")).where("docs >= 3").select("form")
    return of_place, forms.where(~F.col("form").rlike("^[Ww]( [Ww])*$")), common


class Noise(NamedTuple):
    """What scan_noise() found: the cases, and what repaired() needs."""

    texts: DataFrame  # src, row_id, text, page_no, known, styles, own
    cases: DataFrame  # src, row_id, kind, piece
    readings: DataFrame  # src, row_id, word, right
    joins: DataFrame  # src, row_id, left, behind, joined
    context: tuple


def scan_noise(texts: DataFrame, forms_bound: int = FORMS) -> Noise:
    """texts has src, row_id, text, doc and page_no (both may be null: the page is not known)."""
    spark = texts.sparkSession
    place = F.when(F.col("doc").isNotNull() & F.col("page_no").isNotNull(), F.concat("doc", F.lit("\0"), F.floor(F.col("page_no") / PAGES)))
    texts = stored(spread(texts.where(F.col("text").isNotNull() & (F.trim("text") != "")).select("src", "row_id", "text", "doc", "page_no", place.alias("place"))), "scans")
    profile = stored(texts.select("place", "doc", "page_no", "text").mapInPandas(_profile, _PROFILE), "profile")
    of_place, forms, common = headers_of(texts.where(F.col("place").isNotNull()), profile.where("fold is not null"))
    counted = stored(_summed(profile), "words")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    readings = stored(misreadings(counted), "readings")
    doubtful = bits.table_of(readings.select("word").distinct(), F.xxhash64("word"))
    forms = stored(forms, "forms")
    many = forms.count() > forms_bound
    held = spark.sparkContext.broadcast((doubtful, frozenset() if many else frozenset(r.form for r in forms.toLocalIterator()), common))
    placed = texts.join(broadcast_if_small(stored(of_place, "places")), "place", "left")
    placed = _own_forms(placed, forms, common) if many else placed.withColumn("own", F.lit(None).cast("array<string>"))
    placed = placed.select("src", "row_id", "text", "page_no", "known", "styles", "own")

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, shapes, usual = held.value
        doubts = _Doubts(table)
        for f in frames:
            rows = []
            for src, row, text, page, known, styles, own in zip(f["src"], f["row_id"], f["text"], f["page_no"], f["known"], f["styles"], f["own"]):
                spans, parts = _taken(text, page, known, styles, own, shapes, usual)
                rows += [(src, row, s.kind, s.piece, None, None, True) for s in spans]
                for b in parts:
                    rows.append((src, row, "hyphen", None, b.left, b.right, b.sure))
                    if not b.sure:  # two words unless the counts say one
                        rows += [(src, row, "half", w, b.left, b.right, False) for w in (b.left, b.right) if doubts.word(w)]
                toks = outside(text, sorted([(s.start, s.end) for s in spans] + [(b.start, b.end) for b in parts]))
                for i, w in doubts.of(toks):
                    before, behind = i > 0 and toks[i - 1][-1] not in _CLOSING, i + 1 < len(toks) and toks[i][-1] not in _CLOSING
                    rows.append((src, row, "suspect", w, word_of(toks[i - 1]) if before else "", word_of(toks[i + 1]) if behind else "", True))
            doubts.emptied()
            yield pd.DataFrame(rows, columns=["src", "row_id", "kind", "piece", "left", "behind", "sure"])

    kind = texts.schema["row_id"].dataType.simpleString()
    seen = stored(placed.mapInPandas(look, f"src string, row_id {kind}, kind string, piece string, left string, behind string, sure boolean"), "seen")
    halves = seen.where("kind in ('hyphen', 'half')")
    joined = halves.join(rejoined(halves.select("left", "behind").distinct(), counted), ["left", "behind"])
    joins = stored(joined.where("kind = 'hyphen' and (sure or divided)").select("src", "row_id", "left", "behind", "joined"), "joins")
    apart = joined.where("kind = 'half' and not divided").select("src", "row_id", F.lit("suspect").alias("kind"), "piece", F.when(F.col("piece") == F.col("left"), "").otherwise(F.col("left")).alias("left"), F.when(F.col("piece") == F.col("left"), F.col("behind")).otherwise("").alias("behind"))
    whole = joins.select("src", "row_id", F.lit("hyphen").alias("kind"), F.col("joined").alias("piece"), F.lit("").alias("left"), F.lit("").alias("behind"))
    asked = seen.where("kind = 'suspect'").select("src", "row_id", "kind", "piece", "left", "behind").unionByName(apart).unionByName(whole)
    chosen = stored(_ranked(texts, asked.join(readings, F.col("piece") == F.col("word")), counted, total), "chosen")
    chars = chosen.where("kind = 'suspect'").select("src", "row_id", F.lit("char").alias("kind"), F.col("right").alias("piece"))
    fixed = chosen.where("kind = 'hyphen'").select("src", "row_id", "piece", F.col("right").alias("fixed")).distinct()
    hyphens = whole.select("src", "row_id", "piece").join(fixed, ["src", "row_id", "piece"], "left").select("src", "row_id", F.lit("hyphen").alias("kind"), F.coalesce("fixed", "piece").alias("piece"))
    lines = seen.where("kind in ('header', 'page_number')").select("src", "row_id", "kind", "piece")
    cases = lines.unionByName(hyphens).unionByName(chars).distinct()
    return Noise(placed, cases, chosen.select("src", "row_id", F.col("piece").alias("word"), "right").distinct(), joins, (held,))


_CLOSING = frozenset(".!?:;")  # behind these a neighbour tells nothing


class _Doubts:
    """Which tokens may be misreadings: their words, looked up in a bit table once a token."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.sound: set[str] = set()
        self.words: dict[str, str] = {}

    def word(self, token: str) -> str:
        """The word of a token if it may be a misreading, else nothing."""
        w = word_of(token)
        return w if _worth(w) and bits.hit(self.table, bits.hashed(w)) else ""

    def of(self, tokens: list[str]) -> Iterator[tuple[int, str]]:
        """(place, word) of the doubtful ones."""
        if self.sound.issuperset(tokens):
            return
        other = set(tokens).difference(self.sound)
        for t in other.difference(self.words):
            if w := self.word(t):
                self.words[t] = w
            else:
                self.sound.add(t)
        if not other.isdisjoint(self.words):
            yield from ((i, self.words[t]) for i, t in enumerate(tokens) if t in self.words)

    def emptied(self) -> None:
        if len(self.sound) + len(self.words) > 300_000:
            self.sound.clear()
            self.words.clear()


def _own_forms(placed: DataFrame, forms: DataFrame, common: frozenset[str]) -> DataFrame:
    """The header forms that can stand in each text, joined to it: the way for more forms than are broadcast."""
    sizes = frozenset(r.n for r in forms.select((F.size(F.split("form", " "))).alias("n")).distinct().toLocalIterator())
    kind = placed.schema["row_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(s, r, x) for s, r, t in zip(f["src"], f["row_id"], f["text"]) for x in stretches(t, common, sizes)]
            yield pd.DataFrame(rows, columns=["src", "row_id", "form"])

    met = placed.select("src", "row_id", "text").mapInPandas(run, f"src string, row_id {kind}, form string").join(forms, "form").groupBy("src", "row_id").agg(F.collect_set("form").alias("own"))
    return placed.join(met, ["src", "row_id"], "left")


def _ranked(texts: DataFrame, options: DataFrame, counted: DataFrame, total: int) -> DataFrame:
    """The best candidate of every occurrence whose odds against the word as it was read are positive."""
    options = stored(options.select("src", "row_id", "kind", "piece", "left", "behind", "right", "price", "n", "n_read"), "options")
    one = options.where("left <> ''").select(F.col("left").alias("a"), F.col("right").alias("b"), F.col("left").alias("other"), "n")
    two = options.where("behind <> ''").select(F.col("right").alias("a"), F.col("behind").alias("b"), F.col("behind").alias("other"), "n")
    needed = stored(one.unionByName(two).distinct(), "needed")
    table = options.sparkSession.sparkContext.broadcast(bits.table_of(needed, F.xxhash64("a").bitwiseXOR(F.shiftleft(F.xxhash64("b"), 7))))

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Ids()
        for f in frames:
            if len(known) > 300_000:
                known = _Ids()
            place, size, tokens = tokenized(f["text"])
            at = np.array([known[t] for t in tokens], np.int64)[place]
            h = known.hashes()[at]
            there = (at[:-1] > 0) & (at[1:] > 0)
            last = np.cumsum(size) - 1
            there[last[(last >= 0) & (last < len(there))]] = False  # the next token is another text's
            hit = np.flatnonzero(there)
            hit = hit[bits.hits(table.value, h[hit] ^ (h[hit + 1] << np.uint64(7)))]
            both, n = np.unique(at[hit] * len(known.words) + at[hit + 1], return_counts=True)
            if len(hit):
                yield pd.DataFrame({"a": [known.words[k // len(known.words)] for k in both], "b": [known.words[k % len(known.words)] for k in both], "m": n.astype("int64")})

    near = texts.select("text").mapInPandas(pairs, "a string, b string, m long").groupBy("a", "b").agg(F.sum("m").alias("m"))
    by_chance = F.coalesce("n_other", F.lit(1)) * F.col("n") / max(total, 1)
    lift = F.log((F.coalesce("m", F.lit(0)) + 0.5) / (by_chance + 0.5))
    lifts = needed.join(near, ["a", "b"], "left").join(counted.select(F.col("word").alias("other"), F.col("n").alias("n_other")), "other", "left").groupBy("a", "b").agg(F.max(lift).alias("lift"))
    l, r = lifts.select(F.col("a").alias("left"), F.col("b").alias("right"), F.col("lift").alias("lift_left")), lifts.select(F.col("a").alias("right"), F.col("b").alias("behind"), F.col("lift").alias("lift_behind"))
    scored = options.join(l, ["left", "right"], "left").join(r, ["right", "behind"], "left")
    odds = F.log(F.col("n") / F.col("n_read")) - F.col("price") + F.coalesce("lift_left", F.lit(0.0)) + F.coalesce("lift_behind", F.lit(0.0))
    best = F.min_by("right", F.struct(-F.col("odds"), -F.col("n"), F.col("right"))).alias("right")
    return scored.withColumn("odds", odds).where("odds > 0").groupBy("src", "row_id", "kind", "piece", "left", "behind").agg(best).select("src", "row_id", "kind", "piece", "right")


class _Ids(dict):
    """Tokens numbered by their word, from 1, with the hashes of the words; 0 is no word."""

    def __init__(self) -> None:
        super().__init__()
        self.words, self.hashed, self.of_word = [""], [0], {"": 0}

    def __missing__(self, token: str) -> int:
        w = word_of(token)
        k = self.of_word.get(w)
        if k is None:
            k = self.of_word[w] = len(self.words)
            self.words.append(w)
            self.hashed.append(bits.hashed(w))
        self[token] = k
        return k

    def hashes(self) -> np.ndarray:
        return np.array(self.hashed, np.uint64)


def _taken(text: str, page, known, styles, own, shapes: frozenset[str], common: frozenset[str]) -> tuple[list[Furniture], list[Break]]:  # noqa: ANN001
    """The furniture of a text and the divided words outside of it."""
    spans = _spans(text, page, known, styles, shapes if own is None else frozenset(own), common)
    return spans, [b for b in breaks(text) if not any(s.start < b.end and b.start < s.end for s in spans)]


def _spans(text: str, page, known, styles, forms: frozenset[str], common: frozenset[str]) -> list[Furniture]:  # noqa: ANN001
    page = None if page is None or page != page else int(page)
    known, styles = list(known) if known is not None else [], list(styles) if styles is not None else []
    if "\n" in text.strip():
        return furniture_of_lines(text, page, known, forms, common)
    return furniture_of_flat(text, page, known, styles, forms, common)


def repaired(noise: Noise) -> DataFrame:
    """(src, row_id, text): continuous readable paragraphs."""
    held = noise.context[0]
    keys = ["src", "row_id"]
    per_row = noise.readings.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("word", "right"))).alias("right"))
    halves = noise.joins.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct(F.concat("left", F.lit("\0"), "behind").alias("k"), "joined"))).alias("halves"))
    kind = noise.texts.schema["row_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, shapes, usual = held.value
        for f in frames:
            out = []
            for text, page, known, styles, own, right, joined in zip(f["text"], f["page_no"], f["known"], f["styles"], f["own"], f["right"], f["halves"]):
                right, joined = dict(right) if right is not None else {}, dict(joined) if joined is not None else {}
                spans, parts = _taken(text, page, known, styles, own, shapes, usual)
                whole = [(b.start, b.end, joined[k]) for b in parts if (k := f"{b.left}\0{b.right}") in joined]
                out.append(reflowed(text, spans, [(a, b, right.get(w, w)) for a, b, w in whole], right))
            yield pd.DataFrame({"src": list(f["src"]), "row_id": f["row_id"], "text": pd.Series(out, dtype=object)})

    rows = noise.texts.join(per_row, keys, "left").join(halves, keys, "left")
    return rows.select(*keys, "text", "page_no", "known", "styles", "own", "right", "halves").mapInPandas(run, f"src string, row_id {kind}, text string")
