"""The tokens of a batch of texts, split and numbered inside Arrow: Python sees every distinct one once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def tokenized(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(at, size, distinct): of every token its place in `distinct`, of every text how many it has; as str.split()."""
    # behind white space at the end of a text Arrow reads on: the last text must not be at the end of the buffer
    split = pc.utf8_split_whitespace(pa.array([*texts, "."], pa.large_string()))
    coded = split.flatten().dictionary_encode()
    at, size, distinct = coded.indices.to_numpy()[:-1], np.diff(split.offsets.to_numpy())[:-1], coded.dictionary.to_pylist()
    if len(distinct) > (at.max() + 1 if len(at) else 0):
        del distinct[-1]
    if "" in distinct:  # what Arrow finds before and behind outer white space
        k = distinct.index("")
        size = size - np.bincount(np.repeat(np.arange(len(size)), size)[at == k], minlength=len(size))
        at = at[at != k]
        at = at - (at > k)
        del distinct[k]
    return at, size, distinct
