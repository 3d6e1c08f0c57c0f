"""Comparing short label names: normal form, plural variants, closeness."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelgrid.functions.text import strip


def _base_letters() -> tuple[str, str]:
    """Characters that decompose into one base letter plus marks in U+0300..U+036F."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(p for p in parts if not 0x300 <= ord(p) <= 0x36F)
        if len(parts) > 1 and len(base) == 1:
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


MARKED, BASE = _base_letters()


def tag_norm(c: Column) -> Column:
    """Trimmed, lower case, without diacritics."""
    lowered = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.regexp_replace(F.translate(lowered, MARKED, BASE), "[\u0300-\u036f]", "")


def is_plural_variant(a: Column, b: Column) -> Column:
    """Equal, or one is the other plus ``s`` or ``es``; both already normalised."""
    return (a != "") & (b != "") & (
        (a == b)
        | (F.concat(a, F.lit("s")) == b)
        | (F.concat(b, F.lit("s")) == a)
        | (F.concat(a, F.lit("es")) == b)
        | (F.concat(b, F.lit("es")) == a)
    )


def allowed_edits(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest <= 4, 1).when(longest <= 7, 2).otherwise(3)


def similar(a: Column, b: Column) -> Column:
    """Same label for a reader: equal, plural, contained, or a few edits apart; both normalised."""
    shorter = F.least(F.length(a), F.length(b))
    contained = (shorter >= 3) & (a.contains(b) | b.contains(a))
    edits = F.levenshtein(a, b, 3)
    close = (edits >= 0) & (edits <= allowed_edits(a, b))
    return (a != "") & (b != "") & (is_plural_variant(a, b) | contained | close)
