"""Fourteen surface features of a wording, each a column of doubles.

Word boundaries, white space and case folding follow Unicode. Offsets count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .text import stripped

ANY_CASE = "(?iuU)"


def _flag(condition: Column) -> Column:
    return condition.cast("int").cast("double")


def _has(pattern: str, flags: str = ANY_CASE) -> Callable[[Column], Column]:
    return lambda t: _flag(t.rlike(flags + pattern))


def _before(t: Column, pattern: str, flags: str = "") -> Column:
    """Code points before the first match; the whole length without one."""
    return F.length(F.split(t, flags + pattern, 2)[0])


def _slot_position(t: Column) -> Column:
    return F.when(t.rlike(fixed.SLOT), _before(t, fixed.SLOT) / F.length(t)).otherwise(F.lit(0.0))


def _format_first(t: Column) -> Column:
    both = t.rlike(ANY_CASE + fixed.FORMAT) & t.rlike(fixed.SLOT)
    return _flag(both & (_before(t, fixed.FORMAT, ANY_CASE) < _before(t, fixed.SLOT)))


FEATURES: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "chars": ("length in characters", lambda t: F.length(t).cast("double")),
    "words": ("length in words", lambda t: F.regexp_count(t, F.lit(r"(?U)[^\s\x1c-\x1f]+")).cast("double")),
    "sentences": ("sentence ends", lambda t: F.regexp_count(t, F.lit("(?dU)" + fixed.SENTENCE_END)).cast("double")),
    "is_question": ("has a question mark", lambda t: _flag(t.contains("?"))),
    "role_frame": ("begins by giving a role", lambda t: _flag(stripped(t).rlike(ANY_CASE + fixed.ROLE))),
    "think_cue": ("asks for thought first", _has(fixed.THINK)),
    "immediate_cue": ("asks for an answer without working", _has(fixed.IMMEDIATE)),
    "format_instruction": ("asks for the answer alone", _has(fixed.FORMAT)),
    "politeness": ("is polite or hedges", _has(fixed.POLITE)),
    "markdown": ("uses emphasis or code marks", _has(fixed.MARKDOWN, "(?U)")),
    "numbered_list": ("numbers its steps", _has(fixed.NUMBERED)),
    "shouty_caps": ("has two or more words in capitals", lambda t: _flag(F.regexp_count(t, F.lit("(?U)" + fixed.CAPITALS)) >= 2)),
    "slot_position": ("where the first placeholder stands, 0 to 1", _slot_position),
    "format_before_slot": ("names the format before the problem", _format_first),
}
NAMES = tuple(FEATURES)
#: Features that are amounts; all others are there or not.
COUNTED = ("chars", "words", "sentences", "slot_position")


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with a column for each feature."""
    return df.select("*", *(make(F.col(text)).alias(name) for name, (_, make) in FEATURES.items()))


def long_features(df: DataFrame, key: str = "p", text: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """A row for each wording and feature: key, columns named in ``others``, ord, name, x."""
    cells = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(name).alias("name"), make(F.col(text)).alias("x")) for k, (name, (_, make)) in enumerate(FEATURES.items())))
    return df.select(key, *others, F.inline(cells))
