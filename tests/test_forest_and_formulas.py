import pytest
from pyspark.sql import functions as F

from tessera.functions import filters as fl
from tessera.functions.expressions import infix, names_of, polish
from tessera.operators import measures as ms
from tessera.plans.forest import Forest

FOREST = Forest.of(
    ms.sum_("k"), ms.Filtrator("f", "k", fl.where("a", ["x", None])), ms.Combinator("r", ("f", "k"), "DIVIDE", {"nullNumeratorIsZero": True}),
    ms.Unfiltrator("u", "r", ("a",), retain=True), ms.Partitionor("p", ("k",), ("b",), "MAX"), ms.Shiftor("s", "k", "a", "y"), ms.with_tags(ms.Columnator("c", ("k",), ("a",)), "t"), ms.Combinator("broken", ("zz",)),
)


def test_round_trips():
    assert Forest.from_json(FOREST.to_json()).all() == FOREST.all()
    assert Forest.from_yaml(FOREST.to_yaml()).all() == FOREST.all()


def test_nested_and_anonymous():
    f = Forest.from_list([{"type": ".Combinator", "underlyings": [{"type": "Aggregator", "column": "k"}, "other"]}])
    assert list(f.all()) == ["anonymous-0", "anonymous-1"] and f.unknown() == ["other"]
    with pytest.raises(ValueError):
        Forest.from_list([{"type": "Nope", "name": "x"}])


def test_analysis():
    assert FOREST.roots() == ["broken", "c", "p", "s", "u"] and FOREST.leaves() == ["k"]
    assert FOREST.unknown() == ["zz"] and set(FOREST.reachable(["r"]).all()) == {"r", "f", "k"}
    assert FOREST.cycle() is None
    assert "graph TD" in FOREST.mermaid() and "->" in FOREST.graphviz()
    with pytest.raises(ValueError):
        FOREST.add(ms.sum_("other", "k"))


def test_concealing_keeps_the_shape():
    hidden = FOREST.concealed("salt")
    assert len(hidden) == len(FOREST) and not set(hidden.all()) & set(FOREST.all())
    assert sorted(type(m).__name__ for m in hidden.all().values()) == sorted(type(m).__name__ for m in FOREST.all().values())
    assert "'x'" not in repr(hidden.all()) and FOREST.concealed("salt").all() == hidden.all()


def value(spark, make):
    return spark.createDataFrame([(6, 4, "fr", None)], "a long, b long, c string, n long").select(make.alias("x")).first()[0]


@pytest.mark.parametrize("text, expected", [
    ("(a + 2 * b) / b", 3.5), ('c + "-" + a', "fr-6"), ('IF(a > 5 && b != 4, "p", "q")', "q"), ('STR_UPPER(c) + "!"', "FR!"), ("a ^ 2 - -1", 37.0),
    ("MAX(a, b, 9)", 9), ("a / 0", None), ("COALESCE(n, a)", 6), ("NOT(a = 6)", False), ("2 ^ 3 ^ 1", 8.0), ("a % 4", 2), ("ABS(b - a)", 2),
])
def test_infix(spark, text, expected):
    assert value(spark, infix(text, F.col)) == expected


def test_infix_errors():
    for text in ("NOPE(1)", "a +", "(a", "a b", "a ? b"):
        with pytest.raises(ValueError):
            infix(text, lambda n: F.lit(1))
    assert names_of("a + underlyings[1] * IF(b > 1, a, c)") == ["a", "underlyings[1]", "b", "c"]


@pytest.mark.parametrize("notation, options, expected", [
    ("underlyings[a],underlyings[b],+", {}, 10), ("underlyings[a],underlyings[b],int[3],+", {}, 13), ("underlyings[a],underlyings[b],int[3],+", {"two_operands": True}, None),
    ("(underlyings[a],double[0.5],*),underlyings[b],-", {}, -1.0), ("underlyings[a],underlyings[b],/", {}, 1.5), ("int[5],int[2],*", {}, None), ("int[5],int[2],*", {"null_if_none": False}, 10),
    ("aggregatedValue[a],null,+", {}, 6),
])
def test_polish(spark, notation, options, expected):
    assert value(spark, polish(notation, [F.col("a"), F.col("b")], **options)) == expected
