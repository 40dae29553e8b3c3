"""Fuzzy ratio and span location: procedural semantics, in Arrow batches."""

from __future__ import annotations

import re
import zlib
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places on each side of a normalised hit where the span may begin in the original, and by how much more it may be there.
CORRIDOR, SLACK = 40, 80
#: What a normalised form keeps of a lower-cased text beside blanks.
KEPT = frozenset("abcdefghijklmnopqrstuvwxyz0123456789'")

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def ratio(a: str | None, b: str | None) -> float:
    """Matching-blocks ratio of the lower-cased texts; the order of arguments matters."""
    return SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio()


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype=float)


def could_reach(a: Column, b: Column, least: float) -> Column:
    """Whether lengths alone allow a ratio of ``least``; drops no pair that reaches it."""
    short, both = F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)
    return F.when(both == 0, F.lit(True)).otherwise(2.0 * short >= least * both)


def match_form(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9'\s]", " ", text.lower())).strip()


@F.pandas_udf(T.StringType())
def match_form_udf(text: pd.Series) -> pd.Series:
    return text.map(match_form, na_action="ignore")


def inner_runs(text: str, n: int, first: bool = False) -> np.ndarray:
    """Hashes of the distinct runs of n words of a text's normalised form, without its first and last word; or of the first run alone."""
    words = match_form(text).split(" ")[1:-1]
    if first:
        words = words[:n]
    if len(words) < n:
        return np.zeros(0, np.int64)
    codes = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total = (total ^ codes[i : i + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(total).view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def inner_runs_udf(text: pd.Series, n: pd.Series, first: pd.Series) -> pd.Series:
    return pd.Series([inner_runs(t, int(k), bool(f)) for t, k, f in zip(text, n, first)], dtype=object)


def _placed_form(text: str) -> tuple[str, list[int]]:
    """A text's normalised form, and where in the text each of its characters comes from."""
    signs: list[str] = []
    places: list[int] = []
    for i, c in enumerate(text):
        for x in c.lower():
            x = x if x in KEPT else " "
            if x != " " or signs and signs[-1] != " ":
                signs.append(x)
                places.append(i)
    return "".join(signs).rstrip(" "), places


def locate(span: str | None, text: str | None) -> tuple[int, int] | None:
    """Where a span stands in a text: exactly, else where their normalised forms agree.

    A span agrees with a place if the text's normalised form goes on like its own
    from there; blanks and signs that the form drops may come before. Of the places
    less than ``CORRIDOR`` characters from the number at which the forms agree
    first, the first counts, up to the last character needed; the text may be up to
    ``SLACK`` characters longer there than the span.
    """
    if not span or not text:
        return None
    at = text.find(span)
    if at >= 0:
        return at, at + len(span)
    wanted = match_form(span)
    form, places = _placed_form(text)
    near = form.find(wanted)
    if near < 0 or not wanted:
        return (0, 1) if not wanted else None
    low, high = max(0, near - CORRIDOR), min(len(text), near + CORRIDOR)
    room = max(len(span) - 4, len(wanted)) + SLACK
    k = near
    while k >= 0:
        before = k - 1 if k and form[k - 1] != " " else k - 2
        earliest = places[before] + 1 if before >= 0 else 0
        end = places[k + len(wanted) - 1] + 1
        start = max(earliest, low, end - room)
        if start <= places[k] and start < high:
            return start, end
        k = form.find(wanted, k + 1) if earliest < high else -1
    return None


@F.pandas_udf(SPAN)
def locate_udf(span: pd.Series, text: pd.Series) -> pd.DataFrame:
    found = [locate(s, t) or (None, None) for s, t in zip(span, text)]
    return pd.DataFrame(found, columns=["start", "end"]).astype("Int32")
