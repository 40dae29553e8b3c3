"""Structured records inside free text, and plug-ins by name."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def balanced_json(text: str | None) -> str | None:
    """The first balanced JSON object or list in a text that parses; brackets inside strings don't count."""
    text = text or ""
    for start, opener in enumerate(text):
        if opener not in "{[":
            continue
        depth, quoted, escaped = 0, False, False
        for at in range(start, len(text)):
            c = text[at]
            if quoted:
                quoted = escaped or c != '"'
                escaped = c == "\\" and not escaped
            elif c == '"':
                quoted, escaped = True, False
            elif c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
                if depth == 0:
                    try:
                        json.loads(text[start : at + 1])
                    except ValueError:
                        break
                    return text[start : at + 1]
    return None


@F.pandas_udf(T.StringType())
def balanced_json_udf(text: pd.Series) -> pd.Series:
    return pd.Series([balanced_json(t) for t in text])


def load(name: str) -> Callable:
    """The callable under ``module:attribute``, for taggers, chunkers and matchers given by name."""
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute, None)
    if not callable(found):
        raise ValueError(f"{name} is not a callable")
    return found
