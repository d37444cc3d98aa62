"""An inverted lexicon: all forms of all terms are looked for in one pass, whatever the number of terms.

A term is one or more words of letters, apart by blanks or dashes. It is found where a text in lower case has these
words between non-letters, again apart by blanks or dashes, the last one in the singular or plural. Forms are a tree of
letters in one pattern, which finds the places where some form begins; only the words at these places become n-grams,
which are looked up in one hash set. Plural forms are entries of their own."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperflow.tables import let

SEPARATORS = r"\s\x{2010}-\x{2015}\x{2212}-"
_PARTS = re.compile(r"[\s‐-―−-]+")


def words_of(term: str) -> list[str]:
    """The words of a term, the last one without the s that a longer plural has."""
    words = [w for w in _PARTS.split(term.strip()) if w]
    if not words or not all(w.isalpha() for w in words):
        raise ValueError(f"a term needs words of letters: {term!r}")
    if len(words[-1]) >= 5 and re.search(r"(?<!s|u|i)s$", words[-1]):
        words[-1] = words[-1][:-1]
    return words


def forms(term: str) -> list[str]:
    """The n-grams of a term, words apart by one blank: as it stands, with s and with es."""
    plain = " ".join(words_of(term))
    return [plain + ending for ending in ("", "s", "es")]


def quoted(values: Iterable[str]) -> str:
    """Words of letters and blanks as SQL literals."""
    return ", ".join(f"'{v}'" for v in values)


def strings(values: Iterable[str]) -> Column:
    """A literal array of strings, as one literal."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


@dataclass(frozen=True)
class Lexicon:
    """Named lists of terms. A term has the number of its place in all lists, one after the other."""

    lists: Mapping[str, Sequence[str]]

    @cached_property
    def terms(self) -> list[str]:
        return [t for terms in self.lists.values() for t in terms]

    @cached_property
    def numbers(self) -> dict[str, list[int]]:
        """The numbers of the terms that each form belongs to."""
        out: dict[str, list[int]] = {}
        for k, term in enumerate(self.terms):
            for form in forms(term):
                out.setdefault(form, []).append(k)
        return out

    @cached_property
    def pattern(self) -> str:
        """Where a form begins: its letters in a tree, so that a place is left at the first letter that no form has."""
        tree: dict = {}
        for form in self.numbers:
            node = tree
            for c in form:
                node = node.setdefault(c, {})
            node[""] = {}

        def branches(node: dict) -> str:
            ways = [("[" + SEPARATORS + "]++" if c == " " else c) + branches(node[c]) for c in sorted(node) if c]
            return "(?:" + "|".join(ways) + ")" + "?" * ("" in node) if len(ways) > 1 or (ways and "" in node) else "".join(ways)

        return rf"(?=[{''.join(sorted(tree))}])(?<!\p{{L}})(?={branches(tree)}(?!\p{{L}}))"

    def range_of(self, name: str) -> tuple[int, int]:
        """The numbers of a list: the first, and one past the last."""
        first = 0
        for other, terms in self.lists.items():
            if other == name:
                return first, first + len(terms)
            first += len(terms)
        raise KeyError(name)

    def found(self, text: Column) -> Column:
        """array<int>: the numbers of the terms that a text in lower case has, ascending."""
        none = F.array().cast("array<int>")
        if not self.terms:
            return none
        longest = max(f.count(" ") for f in self.numbers) + 1
        table = F.from_json(F.lit(json.dumps(self.numbers)), "map<string,array<int>>")
        # one expression in SQL for the set; Spark keeps more than ten values in a hash set
        is_form = F.expr(f"g -> g IN ({quoted(self.numbers)})")

        def looked_up(places: Column) -> Column:
            lengths = F.sequence(F.lit(1), F.lit(longest))
            of_place = lambda p: let(F.split(p, f"[{SEPARATORS}]+"), lambda w: F.transform(lengths, lambda n: F.array_join(F.slice(w, 1, n), " ")))
            grams = F.flatten(F.transform(F.array_distinct(places), of_place))
            return F.flatten(F.transform(F.call_function("filter", F.array_distinct(grams), is_form), lambda g: F.element_at(table, g)))

        # a place is the first word of a form with the words that follow it, as many as the longest form has
        place = rf"{self.pattern}(?=(\p{{L}}+(?:[{SEPARATORS}]+\p{{L}}+){{0,{longest - 1}}}))\p{{L}}+"
        return F.array_sort(F.array_distinct(let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(place), F.lit(1)), looked_up)))

    def name(self, number: Column) -> Column:
        return F.get(strings(self.terms), number)

    def hits(self, name: str, title: Column, body: Column) -> Column:
        """array<struct<term, in_title>> of a list's terms, in its order, from what title and body were found to have."""
        first, end = self.range_of(name)
        mine = F.filter(F.array_sort(F.array_union(title, body)), lambda k: (k >= first) & (k < end))
        return F.transform(mine, lambda k: F.struct(self.name(k).alias("term"), F.array_contains(title, k).alias("in_title")))
