"""Measures on tables of a few rows."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import filters as fl
from tessera.operators import decompositions as dc
from tessera.operators import measures as ms
from tessera.plans.cube import Cube, CubeQuery, Schema, Top, composite
from tessera.plans.forest import Forest
from tessera.sources import tables as tb

SPARSE = [{"a": "a1", "k1": 123}, {"a": "a2", "b": "b1", "k2": 234}, {"a": "a1", "k1": 345, "k2": 456}, {"a": "a2", "b": "b2", "k1": 567}]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def cube(spark, data, *measures, **options):
    return Cube("c", tb.in_memory(spark, data), Forest.of(*measures), **options)


def test_aggregators_and_null_slices(spark):
    c = cube(spark, SPARSE, ms.sum_("k1"), ms.sum_("k2"), ms.count_rows())
    assert rows(c.query("k1", "k2", group_by="a")) == [("a1", 468, 456), ("a2", 567, 234)]
    assert rows(c.query("k1", group_by="b")) == [("b2", 567), (None, 468)]
    assert rows(c.query("k1", "count(*)")) == [(1035, 4)]


def test_without_measures_slices_come(spark):
    assert rows(cube(spark, SPARSE).query(group_by=["a", "b"])) == [("a1", None), ("a2", "b1"), ("a2", "b2")]


def test_grand_total_of_nothing_is_one_row(spark):
    c = cube(spark, SPARSE, ms.sum_("k1"), ms.count_rows("n"))
    assert rows(c.query("k1", "n", filter=fl.where("a", "none"))) == [(None, None)]
    assert rows(c.query("k1", group_by="a", filter=fl.where("a", "none"))) == []


def test_filtrator_and_divide(spark):
    c = cube(spark, SPARSE, ms.sum_("k1"), ms.Filtrator("one", "k1", fl.where("a", "a1")), ms.Combinator("r", ("one", "k1"), "DIVIDE"))
    assert rows(c.query("r")) == [(468 / 1035,)]
    assert rows(c.query("r", group_by="a")) == [("a1", 1.0)]


def test_divide_by_cases(spark):
    data = [{"g": "n/n", "x": 6, "y": 3}, {"g": "n/-", "x": 6}, {"g": "-/n", "y": 3}, {"g": "n/0", "x": 6, "y": 0}, {"g": "m/0", "x": -6, "y": 0}, {"g": "0/0", "x": 0, "y": 0}]
    got = dict(rows(cube(spark, data, ms.sum_("x"), ms.sum_("y"), ms.Combinator("r", ("x", "y"), "DIVIDE")).query("r", group_by="g")))
    assert got["n/n"] == 2 and math.isnan(got["n/-"]) and "-/n" not in got
    assert got["n/0"] == math.inf and got["m/0"] == -math.inf and math.isnan(got["0/0"])


def test_unfiltrator(spark):
    data = [{"a": "a1", "k": 100}, {"a": "a1", "k": 50}, {"a": "a2", "k": 200}]
    c = cube(spark, data, ms.sum_("k"), ms.Unfiltrator("all", "k", ("a",)))
    assert rows(c.query("k", "all", filter=fl.where("a", "a1"))) == [(150, 350)]
    assert rows(c.query("k", "all", group_by="a", filter=fl.where("a", "a1"))) == [("a1", 150, 150), ("a2", None, 200)]


def test_partitionor(spark):
    c = cube(spark, SPARSE, ms.sum_("k1"), ms.sum_("k2"), ms.Partitionor("p", ("k1", "k2"), ("a", "b"), "MAX"), ms.Partitionor("top", ("k1",), ("b",), "SUM", aggregation="MAX"))
    assert rows(c.query("p")) == [(468 + 234 + 567,)]
    assert rows(c.query("p", "top", group_by="a")) == [("a1", 468, 468), ("a2", 801, 567)]


CURRENCIES = [{"color": "red", "ccy": "EUR", "k": 123}, {"color": "red", "ccy": "USD", "k": 234}, {"color": "blue", "ccy": "EUR", "k": 345}, {"color": "green", "ccy": "JPY", "k": 456}, {"color": "yellow", "ccy": "CHN"}]


def test_shiftor_to_a_constant(spark):
    c = cube(spark, CURRENCIES, ms.sum_("k"), ms.Shiftor("eur", "k", "ccy", "EUR", only_if_present=False))
    assert rows(c.query("eur")) == [(468,)]
    assert rows(c.query("eur", group_by="ccy")) == [("CHN", 468), ("EUR", 468), ("JPY", 468), ("USD", 468)]
    assert rows(c.query("eur", group_by="color")) == [("blue", 345), ("red", 123)]
    assert rows(c.query("eur", group_by=["color", "ccy"])) == [("blue", "EUR", 345), ("red", "EUR", 123), ("red", "USD", 123)]


def test_shiftor_writes_slices_that_the_filter_names(spark):
    c = cube(spark, CURRENCIES, ms.sum_("k"), ms.Shiftor("eur", "k", "ccy", "EUR"))
    f = fl.where("color", "blue") & fl.where("ccy", ["JPY", "GBP"])
    assert rows(c.query("eur", group_by=["color", "ccy"], filter=f)) == [("blue", "GBP", 345), ("blue", "JPY", 345)]
    wide = fl.where("color", [f"c{i}" for i in range(200)]) & fl.where("ccy", [f"d{i}" for i in range(200)])
    with pytest.raises(ValueError, match="would write"):
        c.query("eur", group_by=["color", "ccy"], filter=wide)


def test_shiftor_by_function_and_editor(spark):
    data = [{"y": 1, "c": "x", "k": 10}, {"y": 2, "c": "x", "k": 20}, {"y": 4, "c": "z", "k": 40}]
    c = cube(spark, data, ms.sum_("k"), ms.Shiftor("before", "k", "y", lambda y: y - 1), ms.Shiftor("whole", "k", editor=lambda f, marker: fl.suppress(f, ["c"])))
    assert rows(c.query("before", "k", group_by="y")) == [(1, None, 10), (2, 10, 20), (4, None, 40)]
    assert rows(c.query("before", filter=fl.where("y", 2))) == [(10,)]
    assert rows(c.query("whole", filter=fl.where("c", "x"))) == [(70,)]


def test_columnator_routing_empty_and_unknown(spark):
    c = cube(spark, SPARSE, ms.sum_("k1"), ms.Columnator("need", ("k1",), ("a",)), ms.Columnator("hide", ("k1",), ("a",), hide_if_present=True), ms.EmptyMeasure("none"))
    assert rows(c.query("need")) == [] or rows(c.query("need")) == [(None,)]
    assert rows(c.query("need", group_by="a")) == [("a1", 468), ("a2", 567)]
    assert rows(c.query("need", filter=fl.where("a", "a1"))) == [(468,)]
    assert rows(c.query("hide", "k1", group_by="a")) == [("a1", None, 468), ("a2", None, 567)]
    with pytest.raises(ValueError, match="unknown measure"):
        c.query("zz")
    assert rows(c.query("zz", "none", "k1", group_by="a", options=["UNKNOWN_MEASURES_ARE_EMPTY"])) == [("a1", None, None, 468), ("a2", None, None, 567)]


def test_routing_must_declare(spark):
    c = cube(spark, SPARSE, ms.sum_("k1"), ms.Routing("r", (), lambda s: [type(s)(ms.sum_("k1"), s.filter, s.group_by, s.marker)]))
    with pytest.raises(ValueError, match="does not declare"):
        c.query("r")


def test_cycles_are_found(spark):
    c = cube(spark, SPARSE, ms.Combinator("x", ("y",)), ms.Combinator("y", ("x",)))
    with pytest.raises(ValueError, match="circle"):
        c.query("x")
    assert c.forest.cycle() == ["x", "y", "x"]


def test_linear(spark):
    data = [{"p": 1, "k": 10}, {"p": 10, "k": 100}, {"p": 100, "k": 7}, {"p": 50, "k": 99}]
    c = cube(spark, data, ms.sum_("k"), ms.Dispatchor("d", "k", dc.Linear("p", "end", 1, 100)))
    at = 100 * 9 / 99 + 99 * 49 / 99
    got = dict(rows(c.query("d", group_by="end")))
    assert got[1.0] == pytest.approx(10 + at) and got[100.0] == pytest.approx(7 + 199 - at)
    assert rows(c.query("d")) == [(216,)]


def test_many_to_many(spark):
    data = [{"c": "FR", "k": 123}, {"c": "CH", "k": 234}, {"c": "ZW", "k": 345}]
    d = dc.many_to_many(spark, "c", "g", {"FR": ["G8", "G20"], "CH": ["G20"]})
    c = cube(spark, data, ms.sum_("k"), ms.Dispatchor("m", "k", d))
    assert rows(c.query("m", group_by="g")) == [("G20", 357), ("G8", 123)]
    assert rows(c.query("m", filter=fl.where("g", ["G8", "G20"]))) == [(357,)]
    assert rows(c.query("m", group_by="c", filter=fl.where("g", "G8"))) == [("FR", 123)]
    assert rows(c.query("m", group_by="g", filter=fl.where("g", "G8"))) == [("G8", 123)]
    assert rows(c.query("k", group_by="g")) == [("generated", 702)]


def test_cumulating_without_its_column(spark):
    data = [{"y": 1, "k": 10}, {"y": 2, "k": 20}, {"y": 3, "k": 40}]
    c = cube(spark, data, ms.sum_("k"), ms.Dispatchor("t", "k", dc.Cumulating("y")))
    assert rows(c.query("t", group_by="y", filter=fl.compare("y", ">=", 2))) == [(2, 30), (3, 70)]
    assert rows(c.query("t", filter=fl.compare("y", "<=", 2))) == [(30,)]


def test_join_with_missing_keys_keeps_values(spark):
    lookup = spark.createDataFrame([("a1", "x")], "a string, z string")
    c = cube(spark, SPARSE, ms.sum_("k1"), ms.Dispatchor("j", "k1", dc.LookupJoin(("a",), ("z",), lookup)))
    assert rows(c.query("j", group_by="z")) == [("x", 468), (None, 567)]
    assert rows(c.query("j", filter=fl.where("z", "x"))) == [(468,)]


@pytest.mark.parametrize("key, options, expected", [
    ("SUM", {}, 10), ("MAX", {}, 4), ("MIN", {}, 1), ("COUNT", {}, 4), ("AVG", {}, 2.5), ("PRODUCT", {}, 24.0), ("RANK", {"rank": 2}, 3),
    ("RANK", {"rank": 2, "order": "ASC"}, 2), ("RANK", {"rank": 9}, None), ("UNION_SET", {}, [1, 2, 3, 4]), ("COALESCE", {}, 1),
])
def test_aggregation_keys_also_over_cubes(spark, key, options, expected):
    """A value is the same in one cube, and over two cubes that each hold a part (through states)."""
    one = [{"k": 1}, {"k": 2}, {"k": None}] if key != "COALESCE" else [{"k": 1}]
    two = [{"k": 3}, {"k": 4}, {"k": 4}] if key not in ("COALESCE", "SUM", "COUNT", "AVG", "PRODUCT") else [{"k": 3}, {"k": 4}] if key != "COALESCE" else [{"k": 1}]
    wrap = (lambda d: [{"k": [r["k"]]} for r in d if r["k"]]) if key == "UNION_SET" else (lambda d: d)
    m = ms.Aggregator("v", "k", key, options)
    schema = "k array<long>" if key == "UNION_SET" else "k long"
    cubes = [Cube(n, tb.in_memory(spark, wrap(d), schema), Forest.of(m)) for n, d in (("one", one), ("two", two))]
    whole = Cube("all", tb.in_memory(spark, wrap(one) + wrap(two), schema), Forest.of(m))
    assert rows(composite("both", cubes).query("v")) == ([(expected,)] if expected is not None else rows(composite("both", cubes).query("v")))
    got = rows(whole.query("v"))
    assert got == [(expected,)] or expected is None and got in ([], [(None,)])


def test_sums_of_what_is_no_number(spark):
    data = [{"g": "x", "k": "1"}, {"g": "x", "k": "2"}, {"g": "y", "k": "oops"}, {"g": "y", "k": "3"}]
    c = cube(spark, data, ms.Aggregator("s", "k", "SUM_ELSE_SET"), ms.Aggregator("t", "k", "SUM_ELSE_STRING"))
    assert rows(c.query("s", "t", group_by="g")) == [("x", "3.0", "3.0"), ("y", "{oops}", "oops")]


def test_coalesce_that_differs_fails(spark):
    c = cube(spark, [{"k": 1}, {"k": 2}], ms.Aggregator("v", "k", "COALESCE", {"failIfDifferent": True}))
    with pytest.raises(Exception, match="values differ"):
        c.query("v").collect()


def test_maps(spark):
    t = tb.Table(spark.createDataFrame([("x", {"p": 1}), ("x", {"p": 2, "q": 5}), ("y", None)], "g string, m map<string,long>"))
    c = Cube("c", t, Forest.of(ms.Aggregator("sum", "m", "ATOMIC_LONG_MAP"), ms.Aggregator("any", "m", "UNION_MAP")))
    got = {r["g"]: (r["sum"], r["any"]) for r in c.query("sum", "any", group_by="g").collect()}
    assert got["x"] == ({"p": 3, "q": 5}, {"p": 2, "q": 5})


def test_collections_meet_key_by_key(spark):
    data = [("x", {"p": 1}, ["b", None]), ("x", {"p": 2, "q": None}, ["b", "a"]), ("y", None, []), (None, {}, None), (None, {"r": 4}, ["c"])]
    t = tb.Table(spark.createDataFrame(data, "g string, m map<string,long>, s array<string>"))
    of = [ms.Aggregator("sum", "m", "ATOMIC_LONG_MAP"), ms.Aggregator("any", "m", "UNION_MAP"), ms.Aggregator("set", "s", "UNION_SET"), ms.count_rows("n")]
    c = Cube("c", t, Forest.of(*of, ms.Filtrator("in_x", "set", fl.where("g", "x"))))
    got = {r["g"]: tuple(r)[1:] for r in c.query("sum", "any", "set", "n", "in_x", group_by="g").collect()}
    assert got["x"] == ({"p": 3, "q": 0}, {"p": 2, "q": None}, ["a", "b", None], 2, ["a", "b", None])
    assert got["y"] == ({}, None, None, 1, None)
    assert got[None] == ({"r": 4}, {"r": 4}, ["c"], 2, None)
    assert tuple(c.query("sum", "set").first()) == ({"p": 3, "q": 0, "r": 4}, ["a", "b", "c", None])
    assert tuple(c.query("any", "set", filter=fl.where("g", "nowhere")).first()) == (None, None)
    plan = c.query("sum", group_by="g")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and "Generate explode" in plan


def test_coarser_groupings_come_from_one_scan(spark):
    c = cube(spark, SPARSE, ms.sum_("k1"), ms.Aggregator("mean", "k1", "AVG"), ms.Partitionor("n", ("k1",), ("b",), "CONSTANT", {"constant": 1}))
    q, _ = c.prepared(CubeQuery(("k1", "mean", "n"), ("a",)))
    p = c.planner(q)
    out, _ = p.compile(list(q.measures), q.filter, ("a",), None)
    assert len(p.log) == 1
    assert rows(out) == [("a1", 468, 234.0, 1), ("a2", 567, 567.0, 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_pruned_joins(spark):
    fact = spark.createDataFrame([(1, 10, 5), (2, 20, 7), (3, None, 9)], "id long, p long, k long")
    product = spark.createDataFrame([(10, "tea", 100)], "pid long, name string, c long")
    country = spark.createDataFrame([(100, "FR")], "cid long, country string")
    t = tb.Table(fact).left_join(product, "product", [("p", "pid")]).left_join(country, "country", [("c", "cid")], parent="product")
    c = Cube("c", t, Forest.of(ms.sum_("k")))

    def joins(df):
        return df._jdf.queryExecution().analyzed().toString().count("Join")

    assert joins(c.query("k", group_by="id")) == 0
    assert joins(c.query("k", group_by="name")) == 1
    assert joins(c.query("k", group_by="country")) == 2
    assert rows(c.query("k", group_by="country")) == [("FR", 5), (None, 16)]
    assert rows(c.query("k", group_by="product.name")) == [("tea", 5), (None, 16)]


def test_expression_leaves_keep_conditions(spark):
    c = cube(spark, SPARSE, ms.Aggregator("e", "sum(k1) + 1", "expression"), ms.sum_("k1"), ms.Filtrator("f", "e", fl.where("a", "a1")))
    assert rows(c.query("e", "f", "k1")) == [(1036, 469, 1035)]
    c = cube(spark, SPARSE, ms.Aggregator("e", "sum(k1 * (2 - 1))", "expression"), ms.Filtrator("f", "e", fl.where("a", "a1")), ms.Partitionor("n", ("e",), ("b",), "CONSTANT", {"constant": 1}))
    p = c.planner(CubeQuery())
    out, _ = p.compile(["e", "f", "n"], fl.ALL, ("a",), None)
    assert rows(out) == [("a1", 468, 468, 1), ("a2", 567, None, 1)] and len(p.log) == 1
    assert rows(c.query("e", group_by="a", options=["DRILLTHROUGH"])) == [("a1", 123), ("a1", 345), ("a2", 567), ("a2", None)]


def test_drillthrough(spark):
    data = [{"a": "a1", "k1": 123, "k2": 11}, {"a": "a2", "k1": 234, "k2": 22}, {"a": "a1", "k1": 345}, {"a": "a3", "k2": 44}]
    c = cube(spark, data, ms.sum_("k1"), ms.Aggregator("f", "k2", filter=fl.where("a", "a1")), ms.count_rows("n"))
    assert rows(c.query("k1", "f", "n", group_by="a", options=["DRILLTHROUGH"])) == [("a1", 123, 11, 1), ("a1", 345, None, 1), ("a2", 234, None, 1), ("a3", None, None, 1)]


def test_top_cache_views_and_coordinates(spark):
    c = cube(spark, SPARSE, ms.sum_("k1"), ms.count_rows("n"), cache=True)
    assert rows(c.query("k1", group_by="a", top=Top(("k1",), 1))) == [("a2", 567)]
    assert c.query("k1") is c.query("k1")
    assert c.query("k1", options=["NO_CACHE"]) is not c.query("k1")
    c.clear_cache()
    c.create_view("tessera_view", "k1", group_by="a")
    assert spark.sql("SELECT max(k1) FROM tessera_view").first()[0] == 567
    assert c.coordinates("a") == (2, ["a1", "a2"])
    assert c.coordinates("b", "b1", 5) == (1, ["b1"])
    group, future = c.execute_async(CubeQuery(("n",)))
    assert future.result(60)["n"].tolist() == [4]
    c.cancel(group)


def test_composites(spark):
    one = Cube("one", tb.in_memory(spark, [{"a": "x", "k": 1}, {"a": "y", "k": 2}]), Forest.of(ms.sum_("k"), ms.count_rows("n")))
    two = Cube("two", tb.in_memory(spark, [{"b": "p", "k": 4}]), Forest.of(ms.sum_("k")))
    c = composite("both", [one, two], Forest.of(ms.Combinator("twice", ("k",), lambda v, o, x: 2 * v[0])))
    assert rows(c.query("k", "n", "twice")) == [(7, 2, 14)]
    assert rows(c.query("k", group_by="a")) == [("two", 4), ("x", 1), ("y", 2)]
    assert rows(c.query("k", filter=fl.where("a", "x"))) == [(1,)]
    assert rows(c.query("k", filter=fl.where("a", "two"))) == [(4,)]
    assert rows(c.query("k", group_by="~CompositeSlicer")) == [("one", 3), ("two", 4)]


def test_schema(spark):
    s = Schema()
    s.register("t", tb.in_memory(spark, SPARSE))
    s.register("f", Forest.of(ms.with_tags(ms.sum_("k1"), "main")))
    s.open_cube("c", "t", "f", tags=frozenset(["demo"]))
    s.register_marker("ccy", ["EUR", "USD"], "EUR")
    m = s.metadata()
    assert m["cubes"]["c"]["measures"]["k1"] == {"type": "Aggregator", "tags": ["main"]} and s.tagged("demo") == ["c"]
    assert rows(s.execute("c", CubeQuery(("k1",)))) == [(1035,)]
    with pytest.raises(ValueError):
        s.register("t", tb.in_memory(spark, SPARSE))


def test_markers_reach_formulas(spark):
    c = cube(spark, SPARSE, ms.sum_("k1"), ms.Combinator("m", ("k1",), lambda v, o, ctx: v[0] * F.lit(ctx.marker or 1)))
    assert rows(c.query("m", marker=3)) == [(3105,)]
    assert rows(c.query("m")) == [(1035,)]


def test_arrow_sink(spark):
    c = cube(spark, SPARSE, ms.sum_("k1"))
    t = tb.to_arrow(c.query("k1", group_by="a"))
    assert t.num_rows == 2 and tb.to_ipc(c.query("k1"))


def test_carriers_sql_and_statistics(spark):
    c = cube(spark, SPARSE, ms.Aggregator("mean", "k1", "AVG"), ms.count_rows("n"), ms.Combinator("x", ("n",)))
    assert rows(c.query("mean", "n", group_by="a", options=["AGGREGATION_CARRIERS_STAY_WRAPPED"])) == [("a1", 468, 2, 2), ("a2", 567, 1, 2)]
    with pytest.raises(ValueError):
        c.query("x", options=["AGGREGATION_CARRIERS_STAY_WRAPPED"])
    assert rows(c.sql("SELECT a, max(k1) AS m FROM c GROUP BY a")) == [("a1", 345), ("a2", 567)]
    assert c.statistics("a").first()["cardinality"] == 2
    with pytest.raises(ValueError):
        c.query("n", options=["NO_SUCH_OPTION"])


def test_aliases(spark):
    t = tb.in_memory(spark, SPARSE).with_aliases(tb.prefixed("t_", ["a", "k1"])).with_aliases(tb.by_function(str.upper, ["b"]))
    c = Cube("c", t, Forest.of(ms.sum_("t_k1", "k")))
    assert rows(c.query("k", group_by=["t_a", "B"], filter=fl.where("t_a", "a2"))) == [("a2", "b2", 567)]
    assert tb.chained({"x": "y"}, {"y": "a"}) == {"x": "a", "y": "a"}
    with pytest.raises(ValueError):
        t.with_aliases({"z": "nowhere"})
    with pytest.raises(ValueError, match="unknown column"):
        c.query("k", group_by="nowhere")
