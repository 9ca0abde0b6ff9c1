"""Hundreds of patterns at once: rules as a dimension, and which of them a text holds in one pass.

A rule is (kind, pattern); its number is its place, and a smaller number comes first. Of each alternative of a pattern a
needle is taken, letters that whatever it matches must hold. One automaton over all needles says in one pass which rules
a text can match at all, and only those patterns are tried, so the time follows the text and its hits and hardly the
number of rules. Texts come in Arrow batches, equal ones once; a null text matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # without it every needle is looked for by itself
    ahocorasick = None


def needles(pattern: str) -> list[str]:
    """For each alternative of the pattern the longest run of plain characters that all its matches hold, in lower case;
    "" where there is none."""
    parser, out = re._parser, []
    tree = parser.parse(pattern, re.IGNORECASE)
    whole = list(tree)
    for part in whole[0][1][1] if len(whole) == 1 and whole[0][0] is parser.BRANCH else [whole]:
        runs = [""]
        for kind, value in part:
            if kind is parser.LITERAL and chr(value).isascii():
                runs[-1] += chr(value).lower()
            elif kind is not parser.AT:
                runs.append("")
            elif value is not parser.AT_BOUNDARY:
                runs.append("")
        out.append(max(runs, key=len))
    return out


def folded(text: str) -> str:
    """In lower case, with what a pattern of any case takes for an i or s beyond ASCII made one (k's double is lowered to k)."""
    text = text.lower()
    return text if text.isascii() else text.replace("i\u0307", "i").replace("\u0131", "i").replace("\u017f", "s")


class Rulebook:
    """literal: patterns are plain texts that may lie anywhere in a text, in any case; else they are regular expressions."""

    def __init__(self, rules: Sequence[tuple[str, str]], literal: bool = False):
        self.rules, self.literal = tuple(rules), literal

    def table(self, spark: SparkSession) -> DataFrame:
        """The dimension: rule, kind, pattern, needles."""
        rows = [(n, kind, p, [p.lower()] if self.literal else needles(p)) for n, (kind, p) in enumerate(self.rules)]
        return spark.createDataFrame(rows, "rule int, kind string, pattern string, needles array<string>")

    def finder(self):
        """A function from a text to the numbers of its rules, in order."""
        found = [[p.lower()] if self.literal else needles(p) for _, p in self.rules]
        tried = None if self.literal else [re.compile(p, re.IGNORECASE) for _, p in self.rules]
        always = {n for n, own in enumerate(found) if "" in own}
        of: dict[str, set[int]] = {}
        for n, own in enumerate(found):
            for needle in own if n not in always else ():
                of.setdefault(needle, set()).add(n)
        if ahocorasick is not None and of:
            automaton = ahocorasick.Automaton()
            for needle, numbers in of.items():
                automaton.add_word(needle, numbers)
            automaton.make_automaton()
            met = lambda text: (numbers for _, numbers in automaton.iter(text))
        else:
            met = lambda text: (numbers for needle, numbers in of.items() if needle in text)

        def find(text: str | None) -> list[int]:
            if text is None:
                return []
            can = set(always).union(*met(text.lower() if self.literal else folded(text)))
            return sorted(n for n in can if tried is None or tried[n].search(text))

        return find

    def found(self, c: Column) -> Column:
        """array<int>: the numbers of the rules that a text matches, in order."""
        held = []

        @F.pandas_udf("array<int>")
        def rules_of(texts: pd.Series) -> pd.Series:
            held or held.append(self.finder())
            codes, once = pd.factorize(texts)
            answers = [held[0](text) for text in once]
            return pd.Series([answers[k] if k >= 0 else [] for k in codes], dtype=object)

        return rules_of(c)

    def labels(self) -> list[str]:
        """The kinds, each once, in order."""
        return list(dict.fromkeys(kind for kind, _ in self.rules))

    def kinds(self, numbers: Column) -> Column:
        """array<string>: the kinds of rules found, each once, in order."""
        return F.array_distinct(F.transform(numbers, lambda n: self._kind(n)))

    def first_kind(self, numbers: Column) -> Column:
        """The kind of the first rule found, or null."""
        return F.when(F.size(numbers) > 0, self._kind(numbers[0]))

    def _kind(self, n: Column) -> Column:
        return F.element_at(F.array(*[F.lit(kind) for kind, _ in self.rules]), n + 1)
