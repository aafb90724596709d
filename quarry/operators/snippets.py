"""Snippets: a window of text around the first hit, with the query's words marked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.html import folded

LENGTH, LEAD = 160, 60


def snippet(body: Column, marks: Column) -> Column:
    """``marks``: lower-case alphanumeric words, longest first."""
    text = folded(F.coalesce(body, F.lit("")))
    lowered = F.lower(text)
    hit = F.array_min(F.filter(F.transform(marks, lambda w: F.instr(lowered, w)), lambda at: at > 0))
    return F.get(F.transform(F.array(F.struct(text.alias("text"), F.greatest(F.coalesce(hit - 1 - LEAD, F.lit(0)), F.lit(0)).alias("start"))), lambda s: _window(s.text, s.start, marks)), F.lit(0))


def _window(text: Column, start: Column, marks: Column) -> Column:
    cut = F.substring(text, start + 1, F.lit(LENGTH))
    shown = F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(start + LENGTH < F.length(text), "…").otherwise(""))
    return F.when(F.size(marks) > 0, F.regexp_replace(shown, F.concat(F.lit("(?i)("), F.array_join(marks, "|"), F.lit(")")), F.lit("<mark>$1</mark>"))).otherwise(shown)
