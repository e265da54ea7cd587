"""Sources, sinks and plans of the engine that no registered query shows."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import filters as fl
from tessera.operators import decompositions as dc
from tessera.operators import measures as ms
from tessera.plans import catalogue
from tessera.plans.cube import Cube, CubeQuery, Top, composite
from tessera.plans.forest import Forest
from tessera.sources import tables as tb
from tessera.streaming.incremental import states, values

ROWS = [("a1", 1, 2.5), ("a1", None, 4.0), (None, 7, None), ("a2", 3, 1.0)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "a string, k long, x double")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sums(t, by="a"):
    return {r[0]: r[1] for r in Cube("c", t, Forest.of(ms.sum_("k"), ms.count_rows("n"))).query("k", "n", group_by=by).collect()}


@pytest.mark.parametrize("kind, options", [("csv", {"header": "true"}), ("json", {}), ("orc", {}), ("parquet", {})])
def test_files_written_and_read_back(spark, rows, tmp_path, kind, options):
    path = str(tmp_path / kind)
    rows.write.format(kind).options(**options).save(path)
    assert sums(tb.files(spark, path, kind, inferSchema="true", **options) if kind == "csv" else tb.files(spark, path, kind)) == {"a1": 1, "a2": 3, None: 7}
    out = str(tmp_path / "out")
    tb.write(Cube("c", tb.Table(rows), Forest.of(ms.sum_("k"))).query("k", group_by="a"), out, kind="json", partition_by=["a"])
    assert {r["a"]: r["k"] for r in spark.read.json(out).collect()} == {"a1": 1, "a2": 3, None: 7}


def test_databases(spark, rows):
    url = "jdbc:derby:memory:tessera;create=true"
    rows.write.jdbc(url, "t", mode="overwrite", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    assert sums(tb.jdbc(spark, url, "t", **driver), "a") == {"a1": 1, "a2": 3, None: 7}
    ranged = tb.jdbc(spark, url, "t", key="k", bounds=(0, 8), partitions=3, **driver)
    assert ranged.base.rdd.getNumPartitions() == 3 and sums(ranged, "a") == {"a1": 1, "a2": 3, None: 7}
    assert sums(tb.jdbc_modulo(spark, url, "t", '"k"', 3, **driver), "a") == {"a1": 1, "a2": 3, None: 7}


def test_queries_run_apart(spark, rows):
    c = Cube("c", tb.Table(rows), Forest.of(ms.sum_("k")))
    group, future = c.execute_async(CubeQuery(("k",), ("a",)), lambda df: sorted(r["k"] for r in df.collect()))
    assert future.result(120) == [1, 3, 7]
    c.cancel(group)


def test_the_cache_is_bounded_and_tells_functions_apart(spark, rows):
    c = Cube("c", tb.Table(rows), Forest.of(ms.sum_("k")), cache=True, cache_size=2)
    for low in range(4):
        c.query("k", group_by="a", filter=fl.Where("k", fl.Predicate(lambda x, low=low: x > low)))
    assert len(c._cached) == 2
    assert {r["a"] for r in c.query("k", group_by="a", filter=fl.compare("k", ">", 2)).collect()} == {"a2", None}
    c.clear_cache()


def test_explanations_and_drawings(spark, rows, capsys):
    c = Cube("c", tb.Table(rows), Forest.of(ms.sum_("k")))
    assert c.query("k", group_by="a", options=("EXPLAIN",)).count() == 3
    assert c.explained and "group by ['a']" in capsys.readouterr().out
    assert "graph TD" in c.forest.mermaid() and "digraph" in c.forest.graphviz()
    assert [r["a"] for r in c.query("k", group_by="a", top=Top(("a",), 2, descending=False)).collect()] == ["a1", "a2"]


def test_decimals_stay_exact(spark):
    df = spark.createDataFrame([(decimal.Decimal("12345678901234567.89"),), (decimal.Decimal("0.01"),)], "p decimal(20, 2)")
    assert Cube("c", tb.Table(df), Forest.of(ms.sum_("p"))).query("p").first()[0] == decimal.Decimal("12345678901234567.90")


def test_unions_of_maps_and_sets_and_values(spark):
    df = spark.createDataFrame([("g", {"x": 1}, ["b"], "v"), ("g", {"x": 2, "y": 3}, ["a", "b"], "u"), ("g", None, None, None)], "g string, m map<string,long>, s array<string>, p string")
    forest = Forest.of(*(ms.Aggregator(c.upper(), c, "UNION") for c in "msp"))
    r = Cube("c", tb.Table(df), forest).query("M", "S", "P", group_by="g").first()
    assert (r["M"], r["S"], r["P"]) == ({"x": 2, "y": 3}, ["a", "b"], ["u", "v"])
    whole = Forest.of(ms.Aggregator("m", "m", "UNION_MAP"), ms.Partitionor("again", ("m",), ("p",), "IDENTITY", aggregation="UNION"))
    assert Cube("c", tb.Table(df), whole).query("again", group_by="g").first()["again"] == {"x": 2, "y": 3}


@pytest.mark.parametrize("key, expected", [("UNION_MAP", {"x": 2, "y": 3}), ("ATOMIC_LONG_MAP", {"x": 3, "y": 3})])
def test_maps_across_measures(spark, key, expected):
    df = spark.createDataFrame([({"x": 1}, {"x": 2, "y": 3}, None)], "m map<string,long>, n map<string,long>, o map<string,long>")
    across = ms.Combinator("z", ("m", "n", "o"), "AGGREGATION", {"aggregationKey": key})
    forest = Forest.of(*(ms.Aggregator(c, c, "UNION_MAP") for c in "mno"), across)
    assert Cube("c", tb.Table(df), forest).query("z").first()["z"] == expected


def test_other_aggregations_across_measures(spark):
    df = spark.createDataFrame([("g", 1.0, float("nan"), "q")], "g string, k double, l double, t string")
    leaves = [ms.Aggregator(c, c, "MAX") for c in "klt"]
    made = [ms.Combinator(k, of, "AGGREGATION", {"aggregationKey": k}) for k, of in (("SUM_NOT_NAN", ("k", "l")), ("SUM_ELSE_SET", ("k", "t")), ("SUM_ELSE_STRING", ("k", "t")))]
    r = Cube("c", tb.Table(df), Forest.of(*leaves, *made)).query(*(m.name for m in made), group_by="g").first()
    assert tuple(r)[1:] == (1.0, "{q}", "q")


def test_streams_honour_the_filters_of_measures(spark):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, "a", 1.0), (t, "b", 2.0), (t, None, 4.0)], "ts timestamp, k string, v double")
    kept = [ms.Aggregator("some", "v", filter=fl.where("k", "a")), ms.Aggregator("n", "*", "COUNT", filter=fl.where("k", None)), ms.sum_("v", "all")]
    assert tuple(values(states(df, kept, [], "ts", "1 day"), kept, []).first()) == (1.0, 1, 7.0)


def test_composites_drill_through_what_their_cubes_show(spark, rows):
    one = Cube("one", tb.Table(rows), Forest.of(ms.sum_("k"), ms.sum_("x")), implicit_filter=lambda q: fl.where("a", "a1"))
    two = Cube("two", tb.Table(rows.drop("a")), Forest.of(ms.sum_("k")))
    both = composite("both", [one, two], Forest.of(ms.Combinator("twice", ("k",), lambda v, o, c: v[0] * 2)))
    got = sorted(map(tuple, both.query("twice", group_by="a", options=("DRILLTHROUGH",)).collect()), key=repr)
    assert got == sorted([("a1", 1), ("a1", None), ("two", 1), ("two", None), ("two", 7), ("two", 3)], key=repr)
    assert both.drillthrough(CubeQuery(("x",), ("a",))).count() == 2
    assert both.query("k", group_by="a", filter=fl.where("a", "a2"), options=("DRILLTHROUGH",)).count() == 0
    asked = []
    seen = Cube("one", tb.Table(rows), Forest.of(ms.sum_("k")), implicit_filter=lambda q: (asked.append(q.marker), fl.where("a", "a2"))[1])
    assert composite("c", [seen]).query("k", marker="who").first()[0] == 3 and set(asked) == {"who"}
    _, found = composite("c", [seen]).coordinates("a")
    assert found == ["a2"]


def test_sql_shows_no_hidden_rows_and_reaches_measures(spark, rows):
    c = Cube("hidden", tb.Table(rows), Forest.of(ms.sum_("k"), ms.Combinator("k2", ("k",), lambda v, o, c: v[0] * 2)), implicit_filter=lambda q: fl.where("a", ["a1", "a2"]))
    assert c.sql("SELECT sum(k) AS s FROM hidden").first()[0] == 4
    assert {r["a"] for r in c.sql("SELECT * FROM hidden").collect()} == {"a1", "a2"}
    assert c.statistics("a").first()["cardinality"] == 2 and c.coordinates("a") == (2, ["a1", "a2"])
    got = c.sql("SELECT a, MEASURE(k2) + 1 AS z FROM hidden WHERE k > 0 GROUP BY a HAVING MEASURE(k2) > 2 ORDER BY a")
    assert list(map(tuple, got.collect())) == [("a2", 7)]
    assert c.sql("SELECT MEASURE(k) AS k FROM hidden").first()[0] == 4
    with pytest.raises(ValueError):
        c.sql("SELECT MEASURE(k) FROM elsewhere")


def test_errors_become_values_when_they_are_asked_to(spark, rows):
    broken = ms.Combinator("broken", ("k",), "THROWING", {"message": "no"})
    failing = ms.Combinator("failing", ("k",), lambda v, o, c: 1 / 0)
    c = Cube("c", tb.Table(rows), Forest.of(ms.sum_("k"), broken, failing))
    r = c.query("broken", "failing", "k", group_by="a", filter=fl.where("a", "a1"), options=("EXCEPTIONS_AS_MEASURE_VALUE",)).first()
    assert r["broken"] == "RuntimeError: no" and r["failing"] == "ZeroDivisionError: division by zero" and r["k"] == 1
    with pytest.raises(Exception, match="no"):
        c.query("broken", group_by="a").collect()


def test_plain_text_of_decompositions_and_editors(spark):
    ms.register_editor("no a", lambda f, marker: fl.suppress(f, ["a"]))
    forest = Forest.of(
        ms.sum_("k"),
        ms.Dispatchor("l", "k", dc.Linear("a", "b", 0, 1)),
        ms.Dispatchor("m", "k", dc.many_to_many(spark, "a", "g", {"a1": ["g1", "g2"]})),
        ms.Dispatchor("d", "k", dc.Duplicating({"s": ("u", "v")})),
        ms.Dispatchor("c", "k", dc.Cumulating("a")),
        ms.Shiftor("e", "k", editor=ms.EDITORS["no a"]),
    )
    again = Forest.from_json(forest.to_json())
    assert again.to_json() == forest.to_json() and again.get("e").editor is ms.EDITORS["no a"]
    with pytest.raises(ValueError):
        Forest.of(ms.Dispatchor("x", "k", dc.Lambda(lambda df: df))).to_json()


def test_running_totals_need_no_nested_loop(spark, small):
    plan = plan_of(catalogue.QUERIES["cumulate_by_flag"](spark, small))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_running_totals_with_null_and_missing_coordinates(spark):
    df = spark.createDataFrame([("p", 1, 10), ("p", 3, 5), ("q", 2, 7), ("q", None, 1)], "s string, t long, v long")
    c = Cube("c", tb.Table(df), Forest.of(ms.sum_("v"), ms.Dispatchor("total", "v", dc.Cumulating("t"))))
    got = sorted(map(tuple, c.query("total", group_by=("s", "t")).collect()), key=repr)
    assert got == sorted([("p", 1, 10), ("p", 2, 10), ("p", 3, 15), ("q", None, 1), ("q", 1, 1), ("q", 2, 8), ("q", 3, 8)], key=repr)


def test_members_are_spread_after_rows_are_grouped(spark, small):
    df = catalogue.QUERIES["calc_coordinate"](spark, small)
    plan = plan_of(df)
    below = plan[plan.index("Generate explode") :]
    assert "HashAggregate" in below


def test_pushed_down_filters(spark, small):
    plan = plan_of(catalogue.QUERIES["filters_pushed_down"](spark, small))
    assert "PushedFilters: [In(c_mktsegment, [BUILDING,FURNITURE])]" in plan
