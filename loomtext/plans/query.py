"""Query languages: trees of terms, phrases and Boolean operators, and how they become one Boolean column.

Two dialects read text into the same trees. :func:`parse` knows parentheses, phrases and precedence (``OR`` < ``AND`` or
nothing < ``NOT``). :func:`parse_left_to_right` has none of these: operators apply strictly in order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import py_tokens

#: Limits of a query text.
MOST_CHARACTERS, MOST_LEXEMES = 4096, 256
_LEXEME = re.compile(r'"[^"]*"|[()]|[^\s()"]+')


class Query:
    """A query tree. Subclasses give ``parts`` and ``column``; ``&``, ``|`` and ``~`` build larger trees."""

    parts: tuple[Query, ...] = ()

    def column(self, has: Callable[[str], Column], places: Callable[[str], Column]) -> Column:
        """Whether a row's document matches, never null. ``has(term)`` is a Boolean, ``places(term)`` an array of positions."""
        raise NotImplementedError

    def leaves(self, positive: bool = True) -> Iterator[tuple[Query, bool]]:
        """The leaves and whether each stands under an even number of negations."""
        for part in self.parts:
            yield from part.leaves(positive)

    def terms(self) -> set[str]:
        """Terms that count for the score: those in positive polarity."""
        return {w for leaf, positive in self.leaves() if positive for w in leaf.words()}

    def all_terms(self) -> set[str]:
        return {w for leaf, _ in self.leaves() for w in leaf.words()}

    def phrase_terms(self) -> set[str]:
        return {w for leaf, _ in self.leaves() if isinstance(leaf, Phrase) for w in leaf.words()}

    def words(self) -> tuple[str, ...]:
        return ()

    def matches_nothing_present(self) -> bool:
        """Whether a document with none of the terms matches, so that documents without postings must be looked at."""
        raise NotImplementedError

    def __and__(self, other: Query) -> Query:
        return And(self, other)

    def __or__(self, other: Query) -> Query:
        return Or(self, other)

    def __invert__(self) -> Query:
        return Not(self)


@dataclass(frozen=True)
class Term(Query):
    value: str

    def column(self, has, places):
        return has(self.value)

    def leaves(self, positive=True):
        yield self, positive

    def words(self):
        return (self.value,)

    def matches_nothing_present(self):
        return False


@dataclass(frozen=True)
class Phrase(Query):
    """Words at consecutive positions; one word needs positions too."""

    value: tuple[str, ...]

    def __post_init__(self):
        if not self.value:
            raise ValueError("a phrase needs a word")

    def column(self, has, places):
        def shifted(i: int, word: str) -> Column:
            return F.transform(places(word), lambda p: p - i) if i else places(word)

        starts = [shifted(i, w) for i, w in enumerate(self.value)]
        return F.coalesce(F.size(reduce(F.array_intersect, starts)) > 0, F.lit(False))

    def leaves(self, positive=True):
        yield self, positive

    def words(self):
        return self.value

    def matches_nothing_present(self):
        return False


@dataclass(frozen=True)
class And(Query):
    left: Query
    right: Query

    @property
    def parts(self):
        return self.left, self.right

    def column(self, has, places):
        return self.left.column(has, places) & self.right.column(has, places)

    def matches_nothing_present(self):
        return self.left.matches_nothing_present() and self.right.matches_nothing_present()


@dataclass(frozen=True)
class Or(Query):
    left: Query
    right: Query

    @property
    def parts(self):
        return self.left, self.right

    def column(self, has, places):
        return self.left.column(has, places) | self.right.column(has, places)

    def matches_nothing_present(self):
        return self.left.matches_nothing_present() or self.right.matches_nothing_present()


@dataclass(frozen=True)
class Not(Query):
    """The complement over all documents, those without any token included."""

    child: Query

    @property
    def parts(self):
        return (self.child,)

    def column(self, has, places):
        return ~self.child.column(has, places)

    def leaves(self, positive=True):
        yield from self.child.leaves(not positive)

    def matches_nothing_present(self):
        return not self.child.matches_nothing_present()


def any_of(words: list[str]) -> Query:
    """``OR`` of distinct words in order, as free text is searched."""
    distinct = list(dict.fromkeys(words))
    if not distinct:
        raise ValueError("the query has no words")
    return reduce(Or, map(Term, distinct))


def parse(text: str) -> Query:
    """The tree of a query text; a text that is not a query is a ``ValueError`` that says why."""
    if len(text) > MOST_CHARACTERS:
        raise ValueError(f"the query is longer than {MOST_CHARACTERS} characters")
    if text.count('"') % 2:
        raise ValueError("a quote is not closed")
    lexemes = _LEXEME.findall(text)
    if not lexemes:
        raise ValueError("the query is empty")
    if len(lexemes) > MOST_LEXEMES:
        raise ValueError(f"the query has more than {MOST_LEXEMES} parts")
    return _climb(lexemes)


def _operand(lexeme: str) -> Query:
    words = py_tokens(lexeme)
    if lexeme.startswith('"'):
        if not words:
            raise ValueError("a phrase has no words")
        return Phrase(tuple(words))
    if len(words) != 1:
        raise ValueError(f"{lexeme!r} is not one word")
    return Term(words[0])


def _climb(lexemes: list[str]) -> Query:
    """Operator precedence with two explicit stacks, so depth of nesting is no matter."""
    rank = {"OR": 1, "AND": 2, "NOT": 3}
    output: list[Query] = []
    pending: list[str] = []
    wants_operand = True

    def reduce_top() -> None:
        op = pending.pop()
        right = output.pop()
        output.append(Not(right) if op == "NOT" else (And if op == "AND" else Or)(output.pop(), right))

    def binary(op: str) -> None:
        while pending and pending[-1] != "(" and rank[pending[-1]] >= rank[op]:
            reduce_top()
        pending.append(op)

    for lexeme in lexemes:
        if lexeme in ("AND", "OR"):
            if wants_operand:
                raise ValueError(f"{lexeme} needs something before it")
            binary(lexeme)
            wants_operand = True
            continue
        if lexeme == ")":
            if wants_operand:
                raise ValueError("something is missing before )")
            while pending and pending[-1] != "(":
                reduce_top()
            if not pending:
                raise ValueError(") without (")
            pending.pop()
            continue
        if not wants_operand:
            binary("AND")
            wants_operand = True
        if lexeme in ("(", "NOT"):
            pending.append(lexeme)
        else:
            output.append(_operand(lexeme))
            wants_operand = False
    if wants_operand:
        raise ValueError("the query ends where something is missing")
    while pending:
        if pending[-1] == "(":
            raise ValueError("( is not closed")
        reduce_top()
    return output[0]


def parse_left_to_right(text: str) -> Query:
    """The tree of the simple dialect: words joined by ``AND`` (or nothing) and ``OR`` in strict order, ``NOT`` before a
    word and repeatable; neither parentheses nor phrases."""
    tree: Query | None = None
    operator, negate, pending = "AND", False, True
    fresh = True
    for lexeme in text.split():
        if any(c in lexeme for c in '()"'):
            raise ValueError("this dialect has neither parentheses nor phrases")
        if lexeme in ("AND", "OR"):
            if tree is None or not fresh or negate:
                raise ValueError(f"{lexeme} needs something before it")
            operator, fresh, pending = lexeme, False, True
        elif lexeme == "NOT":
            negate, pending = not negate, True
        else:
            words = py_tokens(lexeme)
            if len(words) != 1:
                raise ValueError(f"{lexeme!r} is not one word")
            leaf: Query = Not(Term(words[0])) if negate else Term(words[0])
            tree = leaf if tree is None else And(tree, leaf) if operator == "AND" else Or(tree, leaf)
            operator, negate, pending, fresh = "AND", False, False, True
    if tree is None or pending:
        raise ValueError("the query ends where something is missing")
    return tree
