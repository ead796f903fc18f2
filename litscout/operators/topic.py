"""Topic filter (FLT1 to FLT5)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Sources
from ..functions.text import contains_any, haystack
from .dedupe import keep_first

#: Terms beyond which texts go through an automaton: a search in the JVM is faster for few, and each costs a pass.
MANY_TERMS = 24


@dataclass
class Topics:
    """Lower-cased terms without blank ones, empty groups and empty sets (FLT4). Terms are not stripped."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    groups: list[list[str]] = field(default_factory=list)
    any_of: list[list[list[str]]] = field(default_factory=list)
    require_include: bool = False

    @classmethod
    def of(cls, s: Sources) -> Topics:
        def terms(x: list[str]) -> list[str]:
            return [t.lower() for t in x if t.strip()]

        def groups(x: list[list[str]]) -> list[list[str]]:
            return [g for g in map(terms, x) if g]

        return cls(
            terms(s.include_keywords),
            terms(s.exclude_keywords),
            groups(s.required_keyword_groups),
            [g for g in map(groups, s.required_any_group_sets) if g],
            s.require_topic_match,
        )

    def terms(self) -> list[str]:
        """All different terms that the predicate asks for."""
        groups = [g for s in self.any_of for g in s] if self.any_of else self.groups
        return sorted({x for g in [self.exclude, *groups, self.include if self.require_include else []] for x in g})

    def empty(self) -> bool:
        return not (self.include or self.exclude or self.groups or self.any_of)


#: Has the text one of these terms?
Has = Callable[[list[str]], Column]


def plainly(text: Column) -> Has:
    """One search of the text for each term, in the JVM."""
    return lambda terms: contains_any(text, terms)


@lru_cache(8)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        made.add_word(term, i)
    made.make_automaton()
    return made


def found_terms(text: Column, terms: list[str]) -> Column:
    """The numbers, ascending, of the terms that a text holds as substrings, overlapping ones too: one pass of an Aho-Corasick automaton, which a worker builds once."""
    held = tuple(terms)

    def run(texts: pa.Array) -> pa.Array:
        automaton = _automaton(held)
        return pa.array([None if x is None else sorted({i for _, i in automaton.iter(x)}) for x in texts.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text)


def by_automaton(text: Column, terms: list[str]) -> tuple[Column, Callable[[Column], Has]]:
    """The terms found in a text, and what asks them; the found terms are to be bound once."""
    number = {x: i for i, x in enumerate(terms)}
    return found_terms(text, terms), lambda found: lambda some: F.arrays_overlap(found, F.array(*[F.lit(number[x]) for x in some])) if some else F.lit(False)


def all_groups(has: Has, groups: list[list[str]]) -> Column:
    """FLT2: of every group some term is in the text."""
    return reduce(lambda a, b: a & b, [has(g) for g in groups], F.lit(True))


def any_set(has: Has, sets: list[list[list[str]]]) -> Column:
    """FLT3: some set matches with all of its groups."""
    return reduce(lambda a, b: a | b, [all_groups(has, g) for g in sets], F.lit(False))


def on_topic(text: Column, t: Topics, many: int = MANY_TERMS) -> Column:
    """The predicate: no excluded term; then the sets, or else the groups; then, if asked for, an included term.

    The text is bound once, however many terms there are. Over ``many`` of them are found in one pass, so that their number hardly matters.
    """
    terms = t.terms()
    if len(terms) <= many:
        return F.transform(F.array(text), lambda bound: _rules(plainly(bound), t))[0]
    found, asks = by_automaton(text, terms)
    return F.transform(F.array(found), lambda bound: _rules(asks(bound), t))[0]


def _rules(has: Has, t: Topics) -> Column:
    keep = ~has(t.exclude)
    if t.any_of:
        keep &= any_set(has, t.any_of)
    elif t.groups:
        keep &= all_groups(has, t.groups)
    if t.require_include and t.include:
        keep &= has(t.include)
    return keep


def topic_filter(candidates: DataFrame, t: Topics) -> DataFrame:
    """FLT1: filter, then exact dedupe; without any terms just the dedupe (FLT5)."""
    if not t.empty():
        candidates = candidates.where(on_topic(haystack(F.col("title"), F.col("abstract"), F.col("venue")), t))
    return keep_first(candidates)
