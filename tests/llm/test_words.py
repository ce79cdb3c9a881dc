"""What the passes over texts do at a fraction of the cost, held against plain definitions."""

import itertools
import random
import sys

import numpy as np
import pandas as pd

from cairnlight.llm import quality, scans

MARKS = [" ", "\n", "\t", "\r", "\xa0", " ", "　", "\x1c", "\x85", "a", "B", "é", "漢", "-", "‐", "\xad", "​", ".", "1", "(", "|"]


def _texts(n: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    return ["", " ", "a\xa0", *("".join(draw.choices(MARKS, k=draw.randint(1, 30))) for _ in range(n)), "ab "]


def test_tokens_are_those_of_split():
    from cairnlight.llm.words import tokenized

    for seed in range(300):  # the last text ends in white space: there Arrow reads beyond its buffer
        texts = _texts(10, seed)
        at, size, distinct = tokenized(texts)
        found = iter([distinct[k] for k in at])
        assert [list(itertools.islice(found, n)) for n in size] == [t.split() for t in texts]
        assert len(set(distinct)) == len(distinct) and "" not in distinct
    assert [len(x) for x in tokenized([])] == [0, 0, 0] and [len(x) for x in tokenized(["", " "])] == [0, 2, 0]


def test_divided_words_are_those_of_the_pattern():
    for t in _texts(5000, 1):
        plain = [m.span() for m in scans._BREAK.finditer(t)]
        if not any(h in t for h in scans.HYPHENS.replace("-", "")):
            assert [m.span() for m in scans._minus_breaks(t)] == plain
        assert [(at, end) for _, at, end, *_ in scans.broken(t)] == [(a, b) for a, b in plain if a and (t[a - 1].isalnum() or t[a - 1] in "@|")]


def test_distance_is_that_of_the_table():
    draw = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(draw.choices("abc", k=draw.randint(0, 12))) for _ in "ab")
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = list(itertools.accumulate(enumerate(b), lambda left, jy, r=row, x=x: min(left + 1, r[jy[0] + 1] + 1, r[jy[0]] + (x != jy[1])), initial=i))
        for most in (0, 1, 3, 12):
            assert scans.distance(a, b, most) == min(row[-1], most + 1)


def test_monomials_are_all_products_and_blocks_all_rows():
    z = np.random.default_rng(0).normal(size=(2500, len(quality.FEATURES)))
    pairs = np.triu_indices(z.shape[1])
    plain = np.hstack([np.ones((len(z), 1)), z, z[:, pairs[0]] * z[:, pairs[1]]])
    assert (quality._monomials(z) == plain).all() and (quality._monomials(z, np.float32) == plain.astype(np.float32)).all()
    assert [len(x) for x in quality._blocks(z)] == [1024, 1024, 452] and (np.vstack(list(quality._blocks(z))) == z).all()


def _work(run) -> int:
    """The calls, of Python and of built-in functions, that something takes: its cost, the same on every machine."""
    count = 0

    def seen(frame, event, arg) -> None:
        nonlocal count
        count += event in ("call", "c_call")

    sys.setprofile(seen)
    try:
        run()
    finally:
        sys.setprofile(None)
    return count


def test_statistics_take_few_calls_a_text():
    words = "the rate of the flow was seen in 12 of 30 plates and a late bloom fell when cold water ran over it".split()
    draw = random.Random(3)
    frame = pd.DataFrame({"id": range(200), "text": [" ".join(draw.choices(words, k=100)) for _ in range(200)]})
    next(quality._statistics(iter([frame]), "id"))
    assert _work(lambda: next(quality._statistics(iter([frame]), "id"))) < 40 * len(frame)  # 80 when every text was split in Python
