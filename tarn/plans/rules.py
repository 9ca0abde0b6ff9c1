"""Rule sets as data, compiled to one CASE or one array expression."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.plans.rulebook import Rulebook


def contains_any(c: Column, parts: Sequence[str]) -> Column:
    """Substrings, inside words too; one alternation."""
    return c.rlike("|".join(re.escape(p) for p in parts)) if parts else F.lit(False)


def starts_with_any(c: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in parts], F.lit(False))


def matches(c: Column, pattern: str) -> Column:
    """In any case; only \\n ends a line."""
    return F.coalesce(c.rlike("(?iud)" + pattern), F.lit(False))


@dataclass(frozen=True)
class Rule:
    id: str
    when: Column


def first_match(rules: Sequence[Rule], otherwise: str) -> Column:
    """The id of the first rule that holds; later ones aren't evaluated."""
    return reduce(lambda out, r: out.when(r.when, r.id), rules[1:], F.when(rules[0].when, rules[0].id)).otherwise(otherwise)


def labels(text: Column, patterns: Sequence[tuple[str, str]] | Rulebook, primary: Column | None = None, fallback: str = "Industry Events") -> Column:
    """Every label whose pattern hits, in order, the primary one first if it is one of them all; else the fallback.

    Few patterns are tried one by one; a rulebook goes through the text once.
    """
    many = isinstance(patterns, Rulebook)
    hits = patterns.kinds(patterns.found(text)) if many else F.array(*[F.when(matches(text, p), label) for label, p in patterns])
    known = patterns.labels() if many else [label for label, _ in patterns]
    first = F.array(F.when(primary.isin(*known), primary)) if primary is not None else F.array().cast("array<string>")
    found = F.array_distinct(F.filter(F.concat(first, hits), lambda x: x.isNotNull()))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(fallback)))


def naics_codes(c: Column, separators: str = "[;,]") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separators), lambda x: F.trim(x)), lambda x: x != "")
