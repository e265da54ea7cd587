import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import filters as fl

ROWS = [{"a": "a1", "v": 1}, {"a": "b", "v": 2}, {"a": None, "v": None}, {"a": "A1", "v": 3}]


def passing(spark, f):
    df = spark.createDataFrame([(r["a"], r["v"]) for r in ROWS], "a string, v long")
    return [(r["a"], r["v"]) for r in df.where(f.on(lambda c: F.col(c) if c in df.columns else None)).collect()]


def test_not_has_two_values(spark):
    assert passing(spark, ~fl.where("a", "a1")) == [("b", 2), (None, None), ("A1", 3)]
    assert passing(spark, ~(fl.where("a", "a1") & fl.where("v", 1))) == [("b", 2), (None, None), ("A1", 3)]


def test_not_of_a_comparison_drops_null(spark):
    assert passing(spark, ~fl.compare("v", ">", 1)) == [("a1", 1)]
    assert fl.not_(fl.compare("v", ">", 1)) == fl.compare("v", "<=", 1, match_if_null=True)


def test_in_splits_null_and_flattens(spark):
    assert fl.where("a", []) == fl.NONE
    assert fl.where("a", ["x"]) == fl.where("a", "x")
    assert passing(spark, fl.where("a", ["b", ["a1", None]])) == [("a1", 1), ("b", 2), (None, None)]


def test_constants_fold():
    x = fl.where("a", 1)
    assert fl.and_() == fl.ALL and fl.or_() == fl.NONE
    assert fl.and_(x, fl.ALL) == x and fl.and_(x, fl.NONE) == fl.NONE
    assert fl.or_(x, fl.ALL) == fl.ALL and ~~x == x
    assert fl.and_(x, fl.where("a", 2)) == fl.NONE
    assert fl.and_(x, fl.where("a", [1, 2])) == x
    assert fl.and_(x, fl.compare("a", ">", 3)) == fl.NONE


def test_missing_columns(spark):
    assert len(passing(spark, fl.where("zz", None))) == 4
    assert passing(spark, fl.Where("zz", fl.IsNull(), null_if_absent=False)) == []
    assert passing(spark, fl.where("zz", 1)) == []


def test_like_and_regex(spark):
    assert passing(spark, fl.like("a", "a%")) == [("a1", 1)]
    assert passing(spark, fl.like("a", "a_", ignore_case=True)) == [("a1", 1), ("A1", 3)]
    assert passing(spark, fl.where("a", re.compile("a."))) == [("a1", 1), ("A1", 3)]


def test_editors():
    f = fl.where("a", 1) & fl.where("b", 2)
    assert fl.suppress(f, ["a"]) == fl.where("b", 2)
    assert fl.retain(f, ["a"]) == fl.where("a", 1)
    assert fl.suppress(fl.where("a", 1) | fl.where("b", 2), ["a"]) == fl.where("b", 2)
    with pytest.raises(ValueError):
        fl.retain(fl.where("a", 1) | fl.where("b", 2), ["a"])
    assert fl.shift(f, "a", 9) == fl.where("a", 9) & fl.where("b", 2)
    assert fl.shift(fl.where("b", 2), "a", 9, only_if_present=True) == fl.where("b", 2)
    assert fl.shift(fl.where("a", [1, 2]), "a", lambda x: x + 1) == fl.where("a", [2, 3])
    assert fl.pinned(f & fl.where("c", [4, 5])) == {"a": (1,), "b": (2,), "c": (4, 5)}


def test_common_part():
    a, b, c = fl.where("a", 1), fl.where("b", 2), fl.where("c", 3)
    assert fl.common([a & b, a & c, a]) == a
    assert fl.without(a & b, a) == b
    assert fl.common([a, fl.ALL]) == fl.ALL


@pytest.mark.parametrize("text, expected", [
    ("a==b", fl.where("a", "b")),
    ("a==1;b!=2", fl.where("a", 1) & ~fl.where("b", 2)),
    ("a=in=(x,y),c>=3", fl.where("a", ["x", "y"]) | fl.compare("c", ">=", 3)),
    ("(a==1,b==2);c=='x y'", (fl.where("a", 1) | fl.where("b", 2)) & fl.where("c", "x y")),
    ("a==x*", fl.like("a", "x%")),
    ("a=isnull=true", fl.where("a", None)),
])
def test_rsql(text, expected):
    assert fl.parse(text) == expected


def test_rsql_errors():
    for text in ("a==", "a==1;", "(a==1", "a~1"):
        with pytest.raises(ValueError):
            fl.parse(text)


leaf = st.builds(fl.where, st.sampled_from("ab"), st.one_of(st.none(), st.integers(0, 3), st.lists(st.one_of(st.none(), st.integers(0, 3)), max_size=3)))
tree = st.recursive(leaf, lambda x: st.one_of(st.builds(fl.and_, x, x), st.builds(fl.or_, x, x), st.builds(fl.not_, x)), max_leaves=6)
values = st.dictionaries(st.sampled_from("ab"), st.one_of(st.none(), st.integers(0, 3)))


@settings(max_examples=200, deadline=None)
@given(tree, tree, values)
def test_algebra_agrees_with_rows(f, g, row):
    assert fl.and_(f, g).accepts(row) == (f.accepts(row) and g.accepts(row))
    assert fl.or_(f, g).accepts(row) == (f.accepts(row) or g.accepts(row))
    assert fl.not_(f).accepts(row) != f.accepts(row)
    assert fl.from_json(fl.to_json(f)).accepts(row) == f.accepts(row)
    shared = fl.common([f, g])
    assert fl.and_(shared, fl.without(f, shared)).accepts(row) == f.accepts(row)
