import itertools
import random

import pytest

from conftest import ids, texts
from loomtext.operators.index import build_index
from loomtext.operators.search import boolean_search, matched, matched_by_sets
from loomtext.plans.query import And, Not, Or, Phrase, Term, parse, parse_left_to_right

a, b, c = Term("a"), Term("b"), Term("c")
TREES = {
    "a OR b c": Or(a, And(b, c)),
    "(a OR b) c": And(Or(a, b), c),
    "NOT NOT a": Not(Not(a)),
    '"КІТ ДІМ"': Phrase(("кіт", "дім")),
    "a AND NOT (b OR c)": And(a, Not(Or(b, c))),
    '"a"\nb': And(Phrase(("a",)), b),
    "a NOT b OR c": Or(And(a, Not(b)), c),
    "NOT a b": And(Not(a), b),
    '"AND"': Phrase(("and",)),
    "a b c": And(And(a, b), c),
}
ERRORS = ["", " ", "()", "a AND", "a OR", "NOT", "a)", "(a", '"a', '""', "OR a", "a AND OR b", "a NOT OR b", "!!!", "well-known", "a" * 4097, "(" * 200 + "a" + ")" * 200, "( AND a)", "a NOT"]


@pytest.mark.parametrize("text", TREES)
def test_trees(text):
    assert parse(text) == TREES[text]


def test_long_tree():
    tree = parse('python AND (async OR await) NOT java "event loop"')
    assert tree == And(And(And(Term("python"), Or(Term("async"), Term("await"))), Not(Term("java"))), Phrase(("event", "loop")))
    assert tree == Term("python") & (Term("async") | Term("await")) & ~Term("java") & Phrase(("event", "loop"))
    assert tree.terms() == {"python", "async", "await", "event", "loop"}
    assert tree.all_terms() == tree.terms() | {"java"}


@pytest.mark.parametrize("text", ERRORS)
def test_errors(text):
    with pytest.raises(ValueError):
        parse(text)


def test_polarity():
    assert parse("NOT NOT a").terms() == {"a"}
    assert parse("NOT (a OR NOT b)").terms() == {"b"}


@pytest.fixture(scope="module")
def garden(spark):
    return build_index(texts(spark, "Кіт кіт дім café", "Дім сад", "Сад море", "")).written()


LTR = {
    "дім сад": [1], "дім AND сад": [1], "дім OR сад": [0, 1, 2], "сад NOT море": [1], "NOT сад": [0, 3], "NOT missing": [0, 1, 2, 3],
    "кіт OR NOT сад": [0, 3], "кіт OR дім сад": [1], "missing": [], "missing OR море": [2], "NOT NOT кіт": [0], "кіт NOT кіт": [],
}


def test_left_to_right(garden):
    for text, expected in LTR.items():
        assert [r.doc_id for r in boolean_search(garden, text).collect()] == expected, text
        assert [r.doc_id for r in boolean_search(garden, text, "sets").collect()] == expected, text


@pytest.mark.parametrize("text", ["", "  ", "AND кіт", "OR кіт", "кіт AND", "кіт OR OR сад", "кіт NOT OR сад", "!!!", "(кіт)", '"кіт"', "well-known", "кіт NOT"])
def test_left_to_right_errors(text):
    with pytest.raises(ValueError):
        parse_left_to_right(text)


def test_phrases(spark):
    index = build_index(texts(spark, "a b a a b", "b a", "a x b", "")).written()
    cases = {'"a b"': [0], '"a a b"': [0], '"b a"': [0, 1], 'a NOT "a b"': [1, 2], "NOT missing": [0, 1, 2, 3], '"a"': [0, 1, 2], '"a b" OR x': [0, 2]}
    for text, expected in cases.items():
        assert ids(matched(index, text)) == expected == ids(matched_by_sets(index, text)), text
    assert [r.positions for r in index.lookup("a").collect()][0] == [0, 2, 3]
    with pytest.raises(ValueError):
        matched(build_index(texts(spark, "a b"), positions=False), '"a"')


def test_random_trees_against_sets(spark):
    rng = random.Random(42)
    docs = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(4))) for _ in range(12)]
    index = build_index(texts(spark, *docs)).written()
    held = {t: {i for i, d in enumerate(docs) if t in d.split()} for t in "abcd"}

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            t = rng.choice("abcd")
            return Term(t), held[t]
        kind = rng.randrange(3)
        left, x = tree(depth - 1)
        if kind == 0:
            return Not(left), set(range(len(docs))) - x
        right, y = tree(depth - 1)
        return (And(left, right), x & y) if kind == 1 else (Or(left, right), x | y)

    for q, expected in itertools.islice((tree(3) for _ in range(10)), 10):
        assert ids(matched(index, q)) == sorted(expected)
