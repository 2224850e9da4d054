"""Cleaning, validating and normalising wordings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: White space as Unicode and the separators of ASCII have it.
BLANK = r"[\s\x1c-\x1f]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+\z", "")


def normalised(text: Column) -> Column:
    """The key of exact duplicates: lower case, letters, digits and braces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), fixed.NOT_NORMAL, " "), " +", " "))


def candidate_lines(text: Column) -> Column:
    """The lines of a generator's reply without list marks; an array without blank lines."""
    pieces = F.split(text, r"\R|[\x1c-\x1e]")
    full = F.filter(pieces, lambda x: F.length(stripped(x)) > 0)
    marks = "^[" + fixed.LIST_MARKS.replace("-", r"\-") + "]+"
    return F.transform(full, lambda x: stripped(F.regexp_replace(stripped(x), marks, "")))


def _shown(found: Column) -> Column:
    """A list of strings as quoted text."""
    quoted = F.transform(found, lambda x: F.when(x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def rejection(text: Column, slots: tuple[str, ...], task: str, balanced: bool = False) -> Column:
    """Why a wording can't be used, by the first check that it fails; null if it can.

    ``balanced`` also rejects braces that belong to no placeholder, which would break rendering.
    """
    t = stripped(text)
    n = F.length(t)
    found = F.regexp_extract_all(t, F.lit(fixed.PLACEHOLDER), 0)
    wanted = ["{" + s + "}" for s in slots]
    times = lambda slot: F.size(F.filter(found, lambda x: x == slot))
    out = (
        F.when(n == 0, "empty")
        .when(t.contains("\n"), "multiline")
        .when((n < fixed.MIN_CHARS) | (n > fixed.MAX_CHARS), F.concat(F.lit("length "), n.cast("string"), F.lit(f" outside {fixed.MIN_CHARS}..{fixed.MAX_CHARS}")))
    )
    for slot in wanted:
        out = out.when(times(slot) != 1, F.concat(F.lit(f"placeholder {slot} appears "), times(slot).cast("string"), F.lit(" times")))
    others = F.filter(found, lambda x: ~x.isin(wanted))
    out = out.when(F.size(others) > 0, F.concat(F.lit("unexpected placeholder(s) "), _shown(others)))
    if task == "mult":
        out = out.when(t.rlike(fixed.LONG_NUMBER), "contains a 3+ digit number, which could be a leaked answer")
    if task == "entail":
        for word in fixed.LABEL_WORDS:
            out = out.when(~F.lower(t).rlike(rf"(?<![0-9a-z_]){word}(?![0-9a-z_])"), f"does not name the option '{word}'")
    if balanced:
        out = out.when(F.regexp_replace(t, fixed.PLACEHOLDER, "").rlike(r"[{}]"), "unbalanced brace")
    return out


def cut(template: Column, strict: bool = False) -> Column:
    """(texts, names): what stands between the template's placeholders, and these; ``strict`` raises an error for braces of none."""
    texts = F.split(template, fixed.SLOT, -1)
    names = F.transform(F.regexp_extract_all(template, F.lit(fixed.SLOT), 0), lambda k: F.substring(k, F.lit(2), F.length(k) - 2))
    if strict:
        stray = F.regexp_replace(template, fixed.SLOT, "").rlike(r"[{}]")
        texts = F.when(stray, F.raise_error(F.concat(F.lit("wording has a single brace: "), template))).otherwise(texts)
    return F.struct(texts.alias("texts"), names.alias("names"))


def filled(parts: Column, slots: Column, strict: bool = False) -> Column:
    """A cut template with every named slot of the map filled in. Placeholders without a value stay as they are, or, if ``strict``, raise an error."""
    missing = lambda k: F.raise_error(F.concat(F.lit("no value for {"), k, F.lit("}"))) if strict else F.concat(F.lit("{"), k, F.lit("}"))
    values = F.transform(parts["names"], lambda k: F.coalesce(F.try_element_at(slots, k), missing(k)))
    return F.array_join(F.zip_with(parts["texts"], values, lambda t, v: F.concat(t, F.coalesce(v, F.lit("")))), "")


def rendered(template: Column, slots: Column, strict: bool = False) -> Column:
    """The template filled in, one pass over its placeholders: values may hold braces."""
    return filled(cut(template, strict), slots, strict)


def verdict(reply: Column) -> Column:
    """What a judge says before the first semicolon, in capitals, at most 12 characters."""
    return F.substring(F.upper(stripped(F.split(reply, ";", 2)[0])), 1, 12)


def verdict_reason(reply: Column) -> Column:
    """What stands after the first semicolon, at most 200 characters; empty without one."""
    return F.substring(stripped(F.coalesce(F.get(F.split(reply, ";", 2), F.lit(1)), F.lit(""))), 1, 200)
