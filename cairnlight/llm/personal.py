"""Personal details inside free text, and their replacement by typed placeholders.

Method: a semi-Markov conditional random field. Candidate segments of bounded length
(patterns per type, in several extents) are scored as whole spans: their shape, what they
are made of, the words before and behind, labels and titles nearby, and a transition score
for details that follow each other directly. Viterbi search over the candidate lattice
chooses boundaries and types jointly; text outside all segments scores zero. The weights
are trained by maximum conditional likelihood (forward-backward over the same lattice) on
sentences composed here from invented names, numbers and places (TRAINING of them, a
fixed and bounded set): letters, forms and notices of everyday kind, none of them taken from
a corpus. Names are sought in all scripts with upper case, with particles and prefixes
(van, de la, Mc, O'), and Japanese ones behind frequent family names.

Patterns run only where they can match: names inside runs of capitalised words, numbers
inside runs of digits, addresses in texts with a word for a street, mail around its marks.

Null, empty and very long texts are handled alike (lattices are cut at places no candidate
spans). Rows repeated under one key give equal details once per row.
"""

from __future__ import annotations

import functools
import math
import random
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlight.session import spread

TRAINING, EPOCHS, SEED = 2600, 5, 9
TYPES = ("email", "phone", "identity", "address", "name")

# Words that tell details from other numbers and capitals.
GIVEN = frozenset("""
Adam Ahmed Aisha Alexander Ali Alice Amina Ana Anders Andrea Anita Anna Anneke Antonio Astrid Beatriz Ben Bruno Carla Carlos Carmen Carol Chiara Clara Claire
Daniel David Diana Dimitri Elena Elif Ella Emil Emma Erik Eva Fatima Felix Francesca Frank Friedrich George Greta Hanna Hans Helena Henrik Henry Hugo Ida Igor Ilse
Ines Ingrid Irina Isabel Jakob James Jan Jane Javier Johann John Jonas Jorge Jose Josef Juan Julia Karim Karin Karl Kenji Lars Laura Leila Lena Leo Linda Lisa
Louis Lucas Lucia Luis Lukas Magnus Mara Marco Maria Marie Mark Marta Martin Mary Mateo Max Mehmet Michael Miguel Mohammed Nadia Natalia Nina Noor Olga Oliver Omar
Oskar Otto Pablo Patrick Paul Paula Pavel Pedro Peter Petra Philippe Pierre Rachel Robert Rosa Ruben Ruth Samuel Sander Sara Simon Sofia Sophie Stefan Susan Sven
Tariq Teodor Teresa Thomas Tom Ulrich Ursula Vera Victor Viktor Vincent Walter Wanda Yara Yuki Yusuf Zofia
""".split())  # noqa: SIM905
TITLES = frozenset("dr dr. mr mr. mrs mrs. ms ms. miss prof prof. professor mme mlle m. monsieur madame frau herr herrn doctor señor señora sr. sra. don doña".split())
ROLES = frozenset("patient nurse reviewer author volunteer contact contacto signed sheet by to at bei à a al beantwortet photograph thank according von unter appeler écrire kontakt asked doctor".split())
NOT_NAMES = frozenset("""
Institute University Street Road Lane Avenue Crescent Hospital Clinic Centre Center Department Group Journal Annals Report Handbook Table Figure Fig Section Chapter Part Tender Volume Issue
January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday
The This These Those In On At For From With Both Neither A An It We No Not Among Where Because Treatment Loss Further Initially Similarly Conversely However Therefore Insurance Driving Passport Ward Call Contact Write Send Signed Photograph
Der Die Das Den Dem Des Ein Eine Weder Nach Für Bei Dabei Zuständig Unterlagen Rückfragen Le La Les Un Une Des Dans Chaque Ces Ni El Los Las En Cada Se Después Her His Their According Correspondence Patient Reviewer Nurse
GmbH Partners Studies Ave Flat Software Catalogue Accession Grant Keywords Others One Similarly Mr Mrs Dr Mme Frau Herr Prof Contacto Escriba Courriel Kontakt Appeler Pour
""".split())  # noqa: SIM905
ID_LABELS = r"passport|tax (?:number|no|id)|identity (?:card|number|no)|id card|social security|insurance (?:number|no|policy)|national (?:id|insurance)|licen[cs]e|ausweis|steuer(?:nummer|-?id)|versicherung|führerschein|reisepass|carte d.identité|sécurité sociale|permis de conduire|passeport|numéro fiscal|documento de identidad|pasaporte|seguridad social|\bdni\b|\bnif\b|health (?:card|number)"
PHONE_LABELS = r"\btel\b|tel\.|phone|\bfax\b|voice|\bcall\b|mobile|reached (?:on|at)|the number|ring\b|telefon|rufnummer|unter\b|téléphone|\bau\b|appeler|teléfono|móvil|llame|\bor\b"
OTHER_LABELS = r"catalog(?:ue)?|isbn|issn|grant|lot\b|batch|version|\bdoi\b|accession|records?\b|ratios?|invoice|order|project no|test gave|kept|serial|figures?|between|item|article no|goods"

_C, _L = r"\p{Lu}", r"\p{Ll}"
_G, _U = r"\p{Lu}\p{Ll}[\p{Ll}\p{M}'’]*", r"\p{Lu}[\p{Lu}\p{M}'’]{2,}"
_PRE = r"(?:Mc|Mac|Fitz|O['’]|D['’]|L['’])"
# Particles of family names.
_OF = r"(?:(?:van|von|vom|de|der|den|del|della|di|da|do|dos|das|du|la|las|los|le|zu|zum|zur|ten|ter|af|av|bin|ibn|al|el|y|e|und) ){1,3}"
_GIV, _FAM, _UPP = rf"{_G}(?:-{_G})?", rf"(?:{_OF})?{_PRE}?{_G}(?:-{_PRE}?{_G})*", rf"(?:O['’]|MC|Mc)?{_U}(?:-{_U})*"
_TOWN = rf"{_G}(?:-{_G})*"
# Frequent Japanese family names.
_JA = "佐藤|鈴木|高橋|田中|伊藤|渡辺|渡邊|山本|中村|小林|加藤|吉田|山田|佐々木|山口|松本|井上|木村|斎藤|清水|林|山崎|森|池田|橋本|阿部|石川|山下|中島|前田|藤田|後藤|小川|岡田|長谷川|村上|近藤|石井"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
_DOT, _WDOT = r"\.", r"\s?[\[({]\s?(?:dot|punkt|point|punto)\s?[\])}]\s?|\s(?:dot|DOT|punkt|point|punto)\s"
_AT = r"@|\s?[\[({]\s?(?:at|AT|ät|arroba)\s?[\])}]\s?"
_EN = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Crescent|Cres|Close|Court|Drive|Way|Square|Terrace|Place|Gardens|Row|Hill|Walk|Grove|Boulevard|Blvd)\b"
_EDGE, _STOP = r"(?<![\p{L}\p{N}+/.,-])", r"(?![\p{L}\p{N}]|[.,/-]\d)"
PATTERNS: dict[str, tuple[tuple[str, str], ...]] = {
    "email": (("mark", rf"(?<![\p{{L}}\p{{N}}._+-])[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}._%+-]*(?:{_AT}){_LABEL}(?:(?:{_DOT}|{_WDOT}){_LABEL})+"), ("words", rf"(?<![\p{{L}}\p{{N}}._+-])[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}._%+-]*\s(?:at|AT|arroba)\s{_LABEL}(?:(?:{_WDOT}){_LABEL})+")),
    "phone": (
        ("plus", rf"{_EDGE}\+\d{{1,3}}(?:[ -]?\(0\))?(?:[ .\-/]?\d{{1,7}}){{2,6}}{_STOP}"),
        ("zeros", rf"{_EDGE}00[ -]?\d{{2}}(?:[ -]\d{{2,4}}){{2,5}}{_STOP}"),
        ("bracket", rf"(?<![\p{{L}}\p{{N}}])\(0\d{{2,5}}\)[ -]?\d{{2,4}}(?:[ -]\d{{2,4}}){{0,4}}{_STOP}"),
        ("slash", rf"{_EDGE}0\d{{2,5}} ?/ ?\d{{2,4}}(?:[ -]\d{{2,4}}){{0,4}}{_STOP}"),
        ("dashes", rf"{_EDGE}\d{{3}}[.-]\d{{4}}{_STOP}"),
        ("threes", rf"{_EDGE}\d{{3}}([.-])\d{{3,4}}\1\d{{4}}{_STOP}"),
        ("spaced", rf"{_EDGE}0\d{{1,4}}(?: \d{{2,4}}){{2,4}}{_STOP}"),
    ),
    "identity": (
        ("letter", rf"{_EDGE}\d{{7,9}}[A-Z]{_STOP}"),
        ("sixfour", rf"{_EDGE}\d{{6}}-\d{{4}}{_STOP}"),
        ("threetwofour", rf"{_EDGE}\d{{3}}-\d{{2}}-\d{{4}}{_STOP}"),
        ("prefixed", rf"{_EDGE}[A-Z]{{1,3}}\d{{6,10}}{_STOP}"),
        ("blocks", rf"{_EDGE}[A-Z]\d{{1,3}}(?: \d{{3,4}}){{2,3}}{_STOP}"),
        ("pairs", rf"{_EDGE}\d{{2}} \d{{2}} \d{{2}} \d{{3}} \d{{3}} \d{{2}}{_STOP}"),
        ("other", rf"{_EDGE}(?:[A-Z]{{1,2}} ?)?\d[\d -]{{5,18}}\d[A-Z]?{_STOP}"),
    ),
    "address": tuple(
        (f"{land}{extent}", rf"(?<![\p{{L}}\p{{N}}]){head}{body}{tail}(?![\p{{L}}\p{{N}}])")
        for land, heads, body, tails in (
            ("en", ("", rf"(?:Flat|Apartment|Apt\.?|Unit|Suite) \d+[a-z]?, "), rf"\d{{1,4}}[a-z]? (?:{_G} ){{1,3}}{_EN}(?:\.(?=[,.]|\s+[a-z])|(?<=Ave)\.)?", ("", rf", {_TOWN}", rf", {_TOWN}(?: {_G})? \d{{4,6}}")),
            ("de", ("",), rf"{_C}[\p{{L}}-]*(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer|STRASSE) \d{{1,4}} ?[a-z]?", ("", rf", \d{{4,5}} {_TOWN}", rf", {_TOWN}")),
            ("fr", ("",), rf"\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|chemin|boulevard|place|allée|impasse|quai|route) (?:(?:de la|de l['’]|du|des|de|d['’]) ?)?{_G}(?:-{_G})*", ("", rf", \d{{5}} {_TOWN}", rf", {_TOWN}")),
            ("es", ("",), rf"(?:Calle|Avenida|Plaza|Paseo|Camino|Ronda|Carrera|C/) ?(?:(?:de los|de las|de la|del|de) )?{_G}(?: {_G})* ?,? \d{{1,4}}[a-z]?", ("", rf", \d{{5}} {_TOWN}", rf", {_TOWN}")),
        )
        for extent, head, tail in ((f"{a}{b}", h, t) for a, h in enumerate(heads) for b, t in enumerate(tails))
    ),
    "name": tuple(
        (k, rf"(?<![\p{{L}}\p{{N}}.'’°-]){p}(?![\p{{L}}\p{{N}}]|[-'’]\p{{L}})")
        for k, p in (
            ("given family", rf"{_GIV} {_FAM}"), ("given initial family", rf"{_GIV} (?:{_C}\. ?){{1,2}}{_FAM}"), ("initial family", rf"(?:{_C}\. ?){{1,3}}{_FAM}"), ("FAMILY given", rf"{_UPP}, {_GIV}(?: {_C}\.)?"), ("FAMILY initial", rf"{_UPP}, (?:{_C}\. ?){{1,2}}(?<=\.)"),
            ("family given", rf"{_FAM}, {_GIV}"), ("family initial", rf"{_FAM}, (?:{_C}\. ?){{1,2}}(?<=\.)"), ("given FAMILY", rf"{_GIV} (?:{_C}\. ?)?{_UPP}"), ("initial FAMILY", rf"(?:{_C}\. ?){{1,2}}{_UPP}"), ("GIVEN FAMILY", rf"{_UPP} {_UPP}"), ("given given family", rf"{_GIV} {_GIV} {_FAM}"),
        )
    ) + (("ja", rf"(?<!\p{{Han}})(?:{_JA})[ 　]?[\p{{Han}}\p{{Hiragana}}]{{1,3}}(?=さん|様|氏|博士|教授|先生|[はがのをにとへ、。（(：:\s]|$)"),),
}
_COMPILED = {t: [(k, regex.compile(p)) for k, p in ps] for t, ps in PATTERNS.items()}
_IDS, _PHONES, _OTHERS = (regex.compile(p, regex.I) for p in (ID_LABELS, PHONE_LABELS, OTHER_LABELS))
_BEFORE, _BEHIND = regex.compile(r"[\p{L}\p{N}.'’]+|[^\s\p{L}\p{N}]"), regex.compile(r"\s*([\p{L}\p{N}'’]+|[^\s\p{L}\p{N}])")
_PARTS = regex.compile(r"[\p{L}'’]+\.?")


_CAPITAL_LEFT, _CAPITAL_RIGHT = regex.compile(rf"(?:{_C}\.|{_G}|{_U},) ?$"), regex.compile(rf"-| (?:{_C}\. ?)*{_G}|, (?:{_C}\.|{_G}\b)")


class Segment(NamedTuple):
    start: int
    end: int
    kind: str
    pattern: str


_CAPITAL = r"\p{Lu}[\p{L}\p{M}'’.-]*"
_NAMED = regex.compile(rf"{_CAPITAL}(?:,? ?(?:{_OF})?{_CAPITAL})+")
_NUMBERED = regex.compile(r"[+(]?(?:\p{Lu}{1,3} ?)?\d(?:[ ().\-/+]{0,3}\d)+[A-Z]?")
_STREETS = regex.compile(rf"{_EN}|stra(?:ß|ss)e|str\.|STRASSE|weg|allee|gasse|platz|ring|damm|ufer|rue|avenue|chemin|boulevard|place|impasse|quai|route|Calle|Avenida|Plaza|Paseo|Camino|Ronda|Carrera|C/")
_MARKED = regex.compile(rf"(?:@|[\[({{]\s?(?:at|AT|ät|arroba)\s?[\])}}]\s?){_LABEL}(?:(?:{_DOT}|{_WDOT}){_LABEL})+")
_SPOKEN = regex.compile(rf"\s(?:at|AT|arroba)\s{_LABEL}(?:(?:{_WDOT}){_LABEL})+")
_LOCAL = frozenset("._%+-")


def _mails(text: str) -> Iterator[Segment]:
    """Mail addresses: from the mark on forwards by pattern, backwards to the start of the local part."""
    ways = [("mark", _MARKED)] if "@" in text or "at" in text.lower() or "arroba" in text or "ät" in text else []
    if any(w in text for w in ("dot", "DOT", "punkt", "point", "punto")):
        ways.append(("words", _SPOKEN))
    for name, p in ways:
        for m in p.finditer(text):
            end = m.start() - (name == "mark" and text[m.start()] != "@" and text[m.start() - 1 : m.start()].isspace())
            start = end
            while start and (text[start - 1].isalnum() or text[start - 1] in _LOCAL):
                start -= 1
            while start < end and not text[start].isalnum():
                start += 1
            if start < end:
                yield Segment(start, m.end(), "email", name)


def candidates(text: str) -> list[Segment]:
    """All segments that some pattern admits, by start."""
    found = set(_mails(text))
    digits = [m.span() for m in _NUMBERED.finditer(text) if m.end() - m.start() > 6]
    for kind in ("phone", "identity"):
        for name, p in _COMPILED[kind]:
            for a, b in digits:
                for m in p.finditer(text, a, min(len(text), b + 2)):
                    if m.end() <= b:
                        found.add(Segment(m.start(), m.end(), kind, name))
    if any(map(str.isdigit, text)) and _STREETS.search(text):
        for name, p in _COMPILED["address"]:
            found.update(Segment(m.start(), m.end(), "address", name) for m in p.finditer(text))
    for m in _NAMED.finditer(text):
        a, b = m.start(), min(len(text), m.end() + 2)
        for name, p in _COMPILED["name"]:
            found.update(Segment(x.start(), x.end(), "name", name) for x in p.finditer(text, a, b, overlapped=True) if x.end() <= m.end())
    if _HAN.search(text):
        found.update(Segment(m.start(), m.end(), "name", "ja") for m in _COMPILED["name"][-1][1].finditer(text))
    return sorted(found)


_HAN = regex.compile(r"\p{Han}")


def features(text: str, s: Segment) -> list[str]:
    """Whole-span features of one segment."""
    span, k = text[s.start : s.end], s.kind
    left, right = text[max(0, s.start - 48) : s.start], text[s.end : s.end + 24]
    words = _BEFORE.findall(left)
    w1 = words[-1].lower() if words else "^"
    w2 = words[-2].lower() if len(words) > 1 else "^"
    m = _BEHIND.match(right)
    n1 = m.group(1).lower() if m else "$"
    out = [f"{k}", f"{k}:{s.pattern}", f"{k}<{w1}", f"{k}<{w2} {w1}", f"{k}>{n1}"]
    if k in ("phone", "identity"):
        near = left[-32:].rpartition("\n")[2]
        size = sum(c.isdigit() for c in span)
        out += [f"{k}:digits{min(size, 16)}", f"{k}:{s.pattern}:digits{min(size, 16)}"]
        a, b, c = (max((x.end() for x in p.finditer(near)), default=-1) for p in (_IDS, _PHONES, _OTHERS))
        out.append(f"{k}:label {'id' if a >= 0 and a >= b and a >= c else 'phone' if b >= 0 and b >= c else 'other' if c >= 0 else 'none'}")
        out.append(f"{k}:{s.pattern}:label {'id' if a >= 0 and a >= b and a >= c else 'phone' if b >= 0 and b >= c else 'other' if c >= 0 else 'none'}")
        if regex.match(r"\s*(?:mL|mg|kPa|Hz|nm|%|°C|±|µm|ppm|kJ|times|records)", right):
            out.append(f"{k}:unit")
    elif k == "address":
        out.append(f"address:left {'flat' if regex.search(r'(?:Flat|Apartment|Apt.?|Unit|Suite) [0-9]+[a-z]?, $', left) else 'digit' if left[-2:-1].isdigit() else '-'}")
        more = regex.match(rf", (?:\d{{4,5}} )?{_TOWN}(?: \d{{4,6}})?", right) or regex.match(r" \d{4,6}\b", right)
        out.append(f"address:{'more' if more else 'whole'}")
    elif k == "name":
        parts = [p for p in _PARTS.findall(span) if not p.islower()]
        initials = [p for p in parts if p.endswith(".") and len(p) == 2]
        full = [p.rstrip(".") for p in parts if p not in initials]
        given = full[-1] if s.pattern in ("FAMILY given", "family given") else full[0] if full else ""
        if s.pattern not in ("initial family", "FAMILY initial", "family initial", "initial FAMILY", "ja"):
            out.append(f"name:{s.pattern}:{'known' if given.title() in GIVEN else 'unknown'}")
            out.append(f"name:{'known' if given.title() in GIVEN else 'unknown'}")
        family = full[0] if s.pattern.lower().startswith("family") else full[-1] if full else ""
        out += [f"name:family {'given' if family.title() in GIVEN else 'other'}", f"name:end {family[-3:].lower()}"]
        bad = sum(p.title() in NOT_NAMES or p.title().split("-")[0] in NOT_NAMES for p in full)
        out.append(f"name:stop {min(bad, 2)}")
        lw = w1.strip(".,:;(<")
        out.append(f"name:before {'title' if w1 in TITLES or lw in TITLES else 'role' if lw in ROLES or w2.strip('.,:;') in ROLES and w1 in ',:' else 'start' if w1 in '^.!?' else 'other'}")
        out.append(f"name:{s.pattern}:before {'title' if w1 in TITLES or lw in TITLES else 'role' if lw in ROLES or w2.strip('.,:;') in ROLES and w1 in ',:' else 'other'}")
        if _CAPITAL_LEFT.search(left) and w1 not in TITLES and lw not in ROLES:
            out.append("name:left capital")
        if _CAPITAL_RIGHT.match(right):
            out.append("name:right capital")
        around = regex.findall(r"\p{L}{2,}", left[-24:] + " " + right[:24])
        out.append(f"name:{'capitals' if s.pattern in ('GIVEN FAMILY', 'FAMILY given') and sum(x.isupper() for x in around) > len(around) / 3 else 'mixed'} around")
        if regex.match(r"\s?[<(][\w.+-]+(?:@|\(at\)| \[at\])", right):
            out.append("name:email behind")
    else:
        out.append(f"email:{'mark' if '@' in span else 'written'}")
    return out


def _lattice(text: str, segs: list[Segment], weights: dict[str, float]) -> list[float]:
    return [sum(weights.get(f, 0.0) for f in features(text, s)) for s in segs]


def _joint(text: str, a: Segment, b: Segment) -> str | None:
    """The transition of two segments that follow each other directly."""
    gap = b.start - a.end
    return f"{a.kind}->{b.kind}:{text[a.end : b.start].strip()}" if 0 <= gap <= 4 else None


def decode(text: str, weights: dict[str, float]) -> list[Segment]:
    """The best-scoring set of segments that do not overlap."""
    segs = candidates(text)
    if not segs:
        return []
    segs.sort(key=lambda s: (s.end, s.start))
    own = _lattice(text, segs, weights)
    ends = [s.end for s in segs]
    top: list[tuple[float, int]] = []  # best chain among the first i segments, and its last one
    best, back = [0.0] * len(segs), [-1] * len(segs)
    from bisect import bisect_right

    for i, s in enumerate(segs):
        k = bisect_right(ends, s.start, 0, i)
        score, prev = top[k - 1] if k and top[k - 1][0] > 0 else (0.0, -1)
        j = k - 1
        while j >= 0 and s.start - ends[j] <= 4:
            t = weights.get(_joint(text, segs[j], s) or "", 0.0)
            if t and best[j] + t > score:
                score, prev = best[j] + t, j
            j -= 1
        best[i], back[i] = own[i] + score, prev
        top.append(max(top[-1], (best[i], i)) if top else (best[i], i))
    i = top[-1][1] if top[-1][0] > 0 else -1
    out = []
    while i >= 0:
        out.append(segs[i])
        i = back[i]
    return out[::-1]


# --- training ----------------------------------------------------------------------------


def _sum_exp(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


def gradient(text: str, gold: set[tuple[int, int, str]], weights: dict[str, float]) -> dict[str, float]:
    """Of the log likelihood of the labelled segments: observed less expected features."""
    segs = candidates(text)
    if not segs:
        return {}
    feats = [features(text, s) for s in segs]
    own = [sum(weights.get(f, 0.0) for f in fs) for fs in feats]
    n = len(segs)
    joint = [[None] * n for _ in range(n)]
    follows = [[j for j in range(n) if segs[j].end <= segs[i].start] for i in range(n)]
    for i in range(n):
        for j in follows[i]:
            joint[j][i] = _joint(text, segs[j], segs[i])
    order = sorted(range(n), key=lambda i: segs[i].start)
    alpha, beta = [0.0] * n, [0.0] * n
    for i in order:
        alpha[i] = own[i] + _sum_exp([0.0] + [alpha[j] + weights.get(joint[j][i] or "", 0.0) for j in follows[i]])
    for i in reversed(order):
        beta[i] = _sum_exp([0.0] + [beta[j] + own[j] + weights.get(joint[i][j] or "", 0.0) for j in range(n) if segs[i].end <= segs[j].start])
    z = _sum_exp([0.0, *alpha])  # chains by their last segment, and the empty one
    out: dict[str, float] = defaultdict(float)
    chosen = []
    for i, s in enumerate(segs):
        p = math.exp(min(0.0, alpha[i] + beta[i] - z))
        hit = (s.start, s.end, s.kind) in gold
        if hit and any(segs[c][:3] == s[:3] for c in chosen):
            hit = False  # the same stretch by another pattern
        if hit:
            chosen.append(i)
        for f in feats[i]:
            out[f] += hit - p
        for j in follows[i]:
            if joint[j][i]:
                q = math.exp(min(0.0, alpha[j] + weights.get(joint[j][i], 0.0) + own[i] + beta[i] - z))
                out[joint[j][i]] -= q
    for a, b in zip(chosen, chosen[1:]):
        if joint[a][b]:
            out[joint[a][b]] += 1.0
    return out


def _invented(r: random.Random) -> str:
    parts = "".join(r.choice(("br", "k", "t", "v", "m", "gr", "st", "p", "h", "l", "d", "qu", "f", "z", "sh", "j", "š", "ł", "r")) + r.choice(("a", "e", "i", "o", "u", "a", "e", "ö", "é", "á", "ı")) + r.choice(("n", "l", "r", "", "nd", "rk", "st", "m", "ch")) for _ in range(r.randint(1, 3)))
    return parts.capitalize() + r.choice(("", "", "er", "son", "ski", "ton", "ley", "mann", "ová", "ez", "ini", "hof", "sen", "ić", "ura", "than", "oglu", "dottir", "wala", "anu"))


def composed(r: random.Random) -> tuple[str, set[tuple[int, int, str]]]:
    """One invented text with its labelled segments."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    cap = lambda n: "".join(r.choice("ABCDEFGHKLMNPXYZ") for _ in range(n))
    noun = lambda: r.choice("garden roof window kitchen letter ticket engine bicycle song wheat bread winter village lesson carpet river printer mirror pencil forest".split())
    month = lambda: r.choice("January March May July October December".split())

    def given() -> str:
        return r.choice(sorted(GIVEN)) if r.random() < 0.65 else _invented(r)

    def family() -> str:
        f = _invented(r)
        way = r.random()
        if way < 0.1:
            return f"{f}-{_invented(r)}"
        if way < 0.2:
            return r.choice(("van ", "von ", "de ", "de la ", "van der ", "di ", "dos ", "el ", "bin ", "du ")) + f
        return r.choice(("Mc", "Mac", "O'", "O’", "D'")) + f if way < 0.26 else f

    def name() -> str:
        g, f, i = given(), family(), r.choice("ABCDEHJKLMNPRST") + "."
        return r.choice((f"{g} {f}",) * 7 + (f"{g} {i} {f}",) * 3 + (f"{i} {f}",) * 3 + (f"{f.upper()}, {g}",) * 4 + (f"{f}, {g}", f"{f.upper()}, {i}", f"{f}, {i}", f"{g} {f.upper()}", f"{g} {given()} {f}"))

    def email() -> str:
        local = r.choice((f"{given()}.{_invented(r)}", f"{given()}+{noun()}", f"{_invented(r)}_{d(2)}", f"{given()}-{_invented(r)}", f"{given()[0]}{_invented(r)}", f"{noun()}{d(3)}", "info", "office")).lower()
        dots = [_invented(r).lower() + r.choice(("", "-shop", "post", "-online")), *r.choice((["example", "org"], ["test"], ["example", "com"], ["invalid"], ["co", "test"]))]
        e = r.choice((local + "@" + ".".join(dots),) * 4 + (local + "(at)" + ".".join(dots), local + " [at] " + " [dot] ".join(dots), local + " at " + " dot ".join(dots), local + " (at) " + " (dot) ".join(dots)))
        return e.upper() if r.random() < 0.1 and "@" in e else e

    def phone() -> str:
        return r.choice((f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+44 (0){d(3)} {d(7)}", f"+1-{d(3)}-{d(4)}-{d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"00 {d(2)} {d(3)} {d(3)} {d(3)}", f"(0{d(3)}) {d(3)}-{d(4)}", f"(0{d(2)}) {d(4)} {d(4)}", f"0{d(3)}/{d(3)} {d(2)} {d(2)}", f"{d(3)}-{d(4)}", f"{d(3)}.{d(4)}.{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(3)} {d(4)}"))

    def identity() -> str:
        return r.choice((f"{d(8)}{cap(1)}", f"{d(6)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{cap(2)}{d(9)}", f"{cap(2)}{d(7)}", f"{cap(1)}{d(8)}", f"{cap(1)}{d(1)} {d(3)} {d(4)}", f"{cap(1)}{d(3)} {d(3)} {d(3)}", f"{d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}"))

    def town() -> str:
        return _invented(r) + r.choice(("", "", "bury", "feld", "ford"))

    def place(land: str) -> str:
        n, post, w = str(r.randint(1, 199)), d(5), _invented(r)
        if land == "de":
            s = w + r.choice(("straße", "weg", "allee", "gasse", "platz")) + " " + n + r.choice(("", "", "a", "b"))
            return s + r.choice((f", {post} {town()}", f", {post} {town()}", ""))
        if land == "fr":
            s = f"{n} {r.choice(('rue', 'avenue', 'chemin', 'boulevard', 'place'))} {r.choice(('de la ', 'du ', 'des ', 'de ', ''))}{w}{r.choice(('', '-' + _invented(r)))}"
            return s + r.choice((f", {post} {town()}", f", {post} {town()}", ""))
        if land == "es":
            s = f"{r.choice(('Calle', 'Avenida', 'Plaza', 'Paseo'))} {r.choice(('del ', 'de los ', 'de la ', 'de ', ''))}{w}{r.choice(('', ' ' + _invented(r)))} {n}"
            return s + r.choice((f", {post} {town()}", f", {post} {town()}", ""))
        s = r.choice(("", "", f"Flat {r.randint(1, 40)}, ")) + f"{n} {w} {r.choice(('Street', 'St', 'Road', 'Lane', 'Crescent', 'Ave.', 'Avenue', 'Close'))}"
        return s + r.choice(("", f", {town()}", f", {town()} {post}"))

    ja = lambda: r.choice(_JA.split("|")) + r.choice(("", " ")) + r.choice(("太郎", "花子", "健", "美咲", "翔太"))
    people = {"ja": ja, "name": name, "email": email, "phone": phone, "identity": identity}
    yes = (
        ("en", "Dear {T} {name}, many thanks for the letter you wrote in May."), ("en", "My name is {name} and I rent a room at {address}."), ("en", "You may email me on {email} or ring {phone} in the evening."), ("en", "Applicant: {name}; passport number {identity}; mobile: {phone}."), ("en", "Please deliver the parcel to {name}, {address}."), ("en", "The tenant, {name}, left {address} in a hurry."), ("en", "Reported by {name} ({email})."), ("en", "Kind regards, {name}"),
        ("en", "For bookings ring {phone} or drop a line to {email}."), ("en", "Social security no. {identity} was entered for {name}, {address}."), ("en", "{name} became head of the choir last autumn."), ("en", "{name} and friends sang for an hour."), ("en", "We spoke to {T} {name} on the phone."), ("en", "Her tax ID is {identity}. Nothing else was asked."), ("en", "His identity card ({identity}) had run out."), ("en", "Next of kin: {name}, telephone {phone}, {address}."), ("en", "Our shop at {address} is closed on Mondays."), ("en", "Bills go to {address}; copies to {email}."),
        ("en", "Cover drawing: {name}."), ("en", "Words by {name}, music by {name}"), ("en", "{name}, {name} and {name} signed the petition."), ("en", "Fax {phone}"), ("en", "tel. {phone} · {email}"), ("en", "From: {name} <{email}> To: {name} <{email}>"), ("en", "Health insurance number: {identity} (still valid)."), ("en", "Licence {identity}, issued to {name}, was found in a drawer."), ("en", "Visit us at {address} or phone {phone} first."), ("en", "Winner {name} took the prize home."), ("en", "The clerk, {name}, wrote {phone} on a card."), ("en", "Answers to {name} at {email}, please."), ("en", "Mother's name {name}, born in July, national insurance number {identity}, {address}."), ("en", "Ask for {T} {name} at the front door."), ("en", "As {name} told the court, the dog was hers."), ("en", "She now lives at {address} with her aunt."), ("en", "Mail the form back to {address}."), ("en", "His number is {phone}, hers {phone}."), ("en", "{name}, who owns the farm, was born in June."), ("en", "Passport {identity}, driving licence {identity}."), ("en", "{T} {name} holds insurance policy {identity} and answers on {phone}."), ("en", "Dial {phone} after six."),
        ("de", "Sehr geehrte Frau {name}, vielen Dank für Ihren Brief."), ("de", "Mein Name ist {name}, ich wohne seit Mai in der {address}."), ("de", "Sie erreichen mich unter {phone} oder per Mail an {email}."), ("de", "Reisepass Nr. {identity}, ausgestellt auf {name}."), ("de", "Lieferung an {name}, {address}."), ("de", "Meine Steuernummer ist {identity}."), ("de", "Versicherungsnummer: {identity}"), ("de", "Herr Dr. {name} singt im Chor ({email})."), ("de", "gez. {name}"), ("de", "Telefon {phone}, Fax {phone}"), ("de", "Frau Prof. {name} grüßt alle Gäste."), ("de", "Der Ausweis mit der Nummer {identity} ist weg."), ("de", "Bitte melden Sie sich bei {name}, {address}."), ("de", "Die Wohnung {address} ist frei."),
        ("fr", "Chère Madame {name}, merci pour votre lettre."), ("fr", "Je m'appelle {name} et j'habite {address}."), ("fr", "Vous pouvez me joindre au {phone} ou à l'adresse {email}."), ("fr", "Passeport {identity} au nom de {name}."), ("fr", "Mon numéro de sécurité sociale : {identity}."), ("fr", "Livrer chez {name}, {address}."), ("fr", "Signé : {name}"), ("fr", "Mme {name} chante le samedi, tél. {phone}."), ("fr", "Ma carte d'identité porte le numéro {identity}."), ("fr", "Mail : {email}. Merci !"), ("fr", "Selon M. {name}, la fête est finie."),
        ("es", "Estimada señora {name}: gracias por su carta."), ("es", "Me llamo {name} y vivo en {address}."), ("es", "Llámeme al teléfono {phone} o mande un correo a {email}."), ("es", "Pasaporte {identity} a nombre de {name}."), ("es", "Mi documento de identidad es {identity}."), ("es", "Entregar a {name}, {address}."), ("es", "Firmado: {name}"), ("es", "Mande la caja a {address}."), ("es", "La señora {name} canta los sábados."), ("es", "Correo: {email}. Gracias."),
        ("en", "The {J} {name} sold nothing all day."), ("en", "Our {J} {name} was late again."), ("en", "A song for {name} was lost in the post."), ("en", "Ring {name} on {phone} tonight."), ("en", "The last {J} was {name}."), ("en", "Sung by {name} and {name}."), ("en", "{name} won, {name} lost."), ("en", "Ask the {J} {name} about {address}."), ("de", "Der {J} {name} lacht."), ("en", "The diary of {name} is in a museum."),
        ("ja", "係は{ja}です。"), ("ja", "{ja}さんに電話してください。"), ("ja", "{ja}が歌を歌った。"), ("ja", "先生は{ja}、三十歳。"),
    )
    f, y = _invented, lambda: d(4)
    no = (
        lambda: f"The {f(r)} scale read {d(1)}.{d(3)}, {d(1)}.{d(3)} and {d(1)}.{d(3)}.", lambda: f"The {town()} Museum owns {y()} {y()} coins.", lambda: f"{f(r)} et al. wrote about the {noun()}.", lambda: f"{f(r)} and friends repaired the {noun()}.", lambda: f"In {month()} Street music came back.", lambda: f"Item {y()}-{d(3)} is sold out.", lambda: f"ISBN {d(3)}-{y()}-{d(3)}-{d(1)} is a cookbook.", lambda: f"Project no. {d(3)}-{d(2)}-{d(3)}{cap(1)} ended.", lambda: f"Grant {d(6)}-{d(4)} was spent on a {noun()}.", lambda: f"Version {d(1)}.{d(2)}.{d(4)} of the game is out.",
        lambda: f"Record {cap(2)}{d(6)} in the archive is a {noun()}.", lambda: f"doi 10.{d(4)}/{noun()}.{d(5)}", lambda: f"Scores of {d(3)} to {y()} were seen in batch {d(3)}/{d(2)}.", lambda: f"Batch {d(8)}{cap(1)} of the goods is late.", lambda: f"3 pens @ {d(2)} cents on 2030-{d(2)}-{d(2)}.", lambda: f"{f(r)} is a kind of {noun()} which nobody likes.", lambda: f"Nobody knew how the {noun()} got there.", lambda: f"{r.choice(('Dr', 'Mr', 'Mrs'))} {f(r)} was away.", lambda: f"The {f(r)} {f(r)} Club met in {town()}.", lambda: f"Die {f(r)} {r.choice(('Brücke', 'Kirche', 'Halle'))} ist alt.", lambda: f"Weder die {f(r)} noch der {noun().capitalize()} war neu.",
        lambda: f"{f(r)} Group — Annual Report 2030", lambda: f"Handbook of {f(r)} Gardens", lambda: f"J. {f(r)[:4]}. Hist. {d(2)} (2030)", lambda: f"Article no. {d(3)}-{d(4)} is cheap.", lambda: f"A{d(2)}    {d(3)}    {d(2)}.{d(2)}    {d(3)}", lambda: f"Order {d(3)}-{d(2)}-{d(4)} is paid.", lambda: f"The moon is {d(3)} {d(3)} {d(3)} m away.", lambda: f"Between {y()} and {y()} sheep were sold.", lambda: f"{f(r)} University, {town()}", lambda: f"Serial no. {cap(1)}{d(3)} {d(3)} {d(3)} is on the {noun()}.", lambda: f"Lake {f(r)} and Mount {f(r)} are far.", lambda: f"Table {d(1)}. {noun().capitalize()} by {month()}", lambda: f"{f(r)} Bridge was built by the {f(r)} Company.", lambda: f"Chapter {d(1)}: The {noun().capitalize()} of {town()}", lambda: f"VOLUME {d(2)}, ISSUE {d(1)}", lambda: f"{f(r).upper()} GARDEN NEWS", lambda: f"Section {d(1)}.{d(1)} {noun().capitalize()} Costs", lambda: f"El {noun()} de {f(r)} es viejo.", lambda: f"Le {noun()} de {f(r)} est vieux.", lambda: f"{town()}, {month()} 2030", lambda: f"According to the {f(r)} Society, the {noun()} is old.", lambda: f"Both {f(r)} and {f(r)} are far away.", lambda: f"Similarly, {f(r)} grew.", lambda: f"Where {f(r)} ends, {f(r)} begins.", lambda: f"{f(r)} {d(2)} % and {f(r)} {d(2)} %",
    )
    text, gold = "", set()
    for _ in range(r.randint(1, 3)):
        if r.random() < 0.62:
            land, template = r.choice(yes)
            for piece in regex.split(r"(\{\w+\})", template):
                key = piece[1:-1] if piece.startswith("{") else ""
                if key == "T":
                    text += r.choice(("Dr", "Mr", "Mrs", "Prof.", "Ms", "Dr."))
                elif key == "J":
                    text += r.choice("painter tailor farmer teacher singer smith author cook pilot miller poet captain".split())
                elif key:
                    value = place(land) if key == "address" else people[key]()
                    gold.add((len(text), len(text) + len(value), "name" if key == "ja" else key))
                    text += value
                else:
                    text += piece
        else:
            other = r.choice(no)()
            text += other.upper() if r.random() < 0.15 else other
        text += r.choice((" ", " ", "\n", "\n\n", "  "))
    return text, gold


@functools.lru_cache(maxsize=1)
def train(count: int = TRAINING, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, float]:
    """Weights by adaptive gradient ascent on the composed sentences."""
    r = random.Random(seed)
    data = [composed(r) for _ in range(count)]
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1.0)
    for epoch in range(epochs):
        r.shuffle(data)
        for text, gold in data:
            for f, g in gradient(text, gold, weights).items():
                g -= 0.0005 * weights[f]
                squares[f] += g * g
                weights[f] += 0.6 / (1 + 0.3 * epoch) * g / math.sqrt(squares[f])
    return {f: w for f, w in weights.items() if abs(w) > 1e-3}


# --- Spark -------------------------------------------------------------------------------


def found_details(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, value, start, end) of every detail; offsets in code points."""
    kind = df.schema[key].dataType.simpleString()
    weights = df.sparkSession.sparkContext.broadcast(train())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = weights.value
        for f in frames:
            rows = [(k, s.kind, t[s.start : s.end], s.start, s.end) for k, t in zip(f.iloc[:, 0], f.iloc[:, 1]) for s in decode(t, w)]
            yield pd.DataFrame(rows, columns=[key, "kind", "value", "start", "end"])

    src = spread(df.select(F.col(key), F.col(text)).where(F.col(text).isNotNull() & F.col(key).isNotNull()))
    return src.mapInPandas(run, f"`{key}` {kind}, kind string, value string, start int, end int")


def redacted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) with [EMAIL], [PHONE], [IDENTITY], [ADDRESS], [NAME] in the places of the details; null stays null."""
    kind = df.schema[key].dataType.simpleString()
    weights = df.sparkSession.sparkContext.broadcast(train())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for t in f.iloc[:, 1]:
                if t is not None:
                    for s in reversed(decode(t, weights.value)):
                        t = f"{t[: s.start]}[{s.kind.upper()}]{t[s.end :]}"
                out.append(t)
            yield pd.DataFrame({key: f.iloc[:, 0], "text": pd.Series(out, dtype=object)})

    return spread(df.select(F.col(key), F.col(text))).mapInPandas(run, f"`{key}` {kind}, text string")
