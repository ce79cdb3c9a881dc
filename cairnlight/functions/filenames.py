"""Titles to file names: an Arrow function where Unicode decomposition is needed."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORBIDDEN = "<>:\"/\\|?*,()'[]"  # fixed value
LONGEST, FALLBACK = 100, "untitled"


def safe_name_ascii(title: Column) -> Column:
    """The rule for ASCII titles, inside the JVM."""
    t = F.regexp_replace(title, r"""[<>:"/\\|?*,()'\[\]]""", "_")
    t = F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\s+", "_")
    t = F.regexp_replace(F.regexp_replace(t, "_+", "_"), "^_|_$", "")
    t = F.substring(t, 1, LONGEST)
    t = F.when(t == "", FALLBACK).otherwise(t)
    return F.when(F.length(title) > LONGEST, F.concat_ws("_", t, F.substring(F.md5(title), 1, 6))).otherwise(t)


def _name(title: str | None) -> str | None:
    if title is None:
        return None
    whole = unicodedata.normalize("NFC", title)
    plain = unicodedata.normalize("NFKD", whole).encode("ascii", "ignore").decode()
    parts = "".join("_" if c in FORBIDDEN else c for c in plain).split()
    name = re.sub("_+", "_", "_".join(parts)).strip("_")[:LONGEST] or FALLBACK
    lost = plain != whole or len(whole) > LONGEST
    return f"{name}_{hashlib.md5(whole.encode()).hexdigest()[:6]}" if lost else name


@F.pandas_udf(T.StringType())
def safe_name(titles: pd.Series) -> pd.Series:
    return titles.map(_name)


@F.pandas_udf(T.StringType())
def canonical_title(titles: pd.Series) -> pd.Series:
    return titles.map(lambda t: t if t is None else unicodedata.normalize("NFC", t).strip())
