"""Answers in responses, as column expressions.

All of it runs inside the JVM's generated code. Integers are compared as digit strings without
leading zeros, so no run of digits is too long.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

KINDS = ("integer", "label")


def candidates(text: Column, kind: str) -> Column:
    """Every candidate answer, in order: maximal digit runs once commas between digits are gone, or whole label words."""
    if kind == "integer":
        return F.regexp_extract_all(F.regexp_replace(text, fixed.COMMA_IN_NUMBER, ""), F.lit(fixed.DIGITS), 0)
    if kind == "label":
        words = "|".join(fixed.LABEL_WORDS)
        return F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![0-9A-Za-z_])({words})(?![0-9A-Za-z_])"), 1)
    raise ValueError(f"unknown answer kind {kind!r}; there are {', '.join(KINDS)}")


def _plain(answer: Column, kind: str) -> Column:
    return F.regexp_replace(answer, "^0+(?=.)", "") if kind == "integer" else answer


def prediction(found: Column) -> Column:
    """The last candidate; null without any."""
    return F.try_element_at(found, F.lit(-1))


def outcome(text: Column, answer: Column, kind: str) -> Column:
    """error for a null response, unparseable without a candidate, else whether the last one is right."""
    found = candidates(text, kind)
    right = _plain(prediction(found), kind) == _plain(answer, kind)
    return F.when(text.isNull(), "error").when(F.size(found) == 0, "unparseable").when(right, "correct").otherwise("wrong")


def lenient(text: Column, answer: Column, kind: str) -> Column:
    """Whether any candidate is right."""
    wanted = _plain(answer, kind)
    return F.coalesce(F.exists(candidates(text, kind), lambda c: _plain(c, kind) == wanted), F.lit(False))
