"""The registered queries of the measure engine with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import filters as fl
from tessera.operators import decompositions as dc
from tessera.operators import measures as ms
from tessera.plans.cube import SLICER, Cube, Top, composite
from tessera.plans.forest import Forest
from tessera.sources import tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The snowflake in SQL.
STAR = """lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey"""
REVENUE = "sum(l_extendedprice * (1 - l_discount))"


def tpch_table(spark: SparkSession, d: str) -> tb.Table:
    """lineitem with its dimensions by LEFT joins."""

    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{d}/{name}.parquet")

    return (
        tb.Table(t("lineitem"), "lineitem")
        .left_join(t("orders"), "orders", [("l_orderkey", "o_orderkey")])
        .left_join(t("customer"), "customer", [("o_custkey", "c_custkey")], parent="orders")
        .left_join(t("nation"), "cust_nation", [("c_nationkey", "n_nationkey")], parent="customer")
        .left_join(t("region"), "cust_region", [("n_regionkey", "r_regionkey")], parent="cust_nation")
        .left_join(t("part"), "part", [("l_partkey", "p_partkey")])
        .left_join(t("supplier"), "supplier", [("l_suppkey", "s_suppkey")])
    )


def tpch_forest() -> Forest:
    return Forest.of(
        ms.count_rows(),
        ms.sum_("l_quantity", "quantity"),
        ms.Aggregator("revenue", REVENUE, "expression"),
        ms.Aggregator("avg_discount", "l_discount", "AVG"),
        ms.Partitionor("order_count", ("count(*)",), ("o_orderkey",), "CONSTANT", {"constant": 1}),
        ms.Partitionor("customer_count", ("count(*)",), ("c_custkey",), "CONSTANT", {"constant": 1}),
        name="tpch",
    )


def tpch(spark: SparkSession, d: str, *more: Any) -> Cube:
    return Cube("tpch", tpch_table(spark, d), tpch_forest().add(*more))


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def on_cube(name: str, sql: str, *measures: str, forest: tuple = (), **q: Any) -> None:
    """Register a query of the TPC-H cube."""
    query(sql, name)(lambda spark, d: plain(tpch(spark, d, *forest).query(*measures, **q)))


def plain(df: DataFrame) -> DataFrame:
    """Columns under names that need no quotes."""
    return df.select(*(F.col(f"`{c}`").alias(re.sub(r"\W+", "_", c).strip("_")) for c in df.columns))


# --- the flagship and plain aggregations -----------------------------------------------------------

on_cube(
    "tpch_measures_by_region",
    f"SELECT r_name, count(*) AS count, sum(l_quantity) AS quantity, {REVENUE} AS revenue, avg(l_discount) AS avg_discount FROM {STAR} GROUP BY r_name",
    "count(*)", "quantity", "revenue", "avg_discount", group_by=("r_name",),
)
on_cube("tpch_count_by_region", f"SELECT r_name, count(*) AS count FROM {STAR} GROUP BY 1", "count(*)", group_by=("r_name",))
on_cube("tpch_revenue_by_segment", f"SELECT c_mktsegment, {REVENUE} AS revenue FROM {STAR} GROUP BY 1", "revenue", group_by=("c_mktsegment",))
on_cube("tpch_avg_discount_by_returnflag", "SELECT l_returnflag, avg(l_discount) AS avg_discount FROM lineitem GROUP BY 1", "avg_discount", group_by=("l_returnflag",))
on_cube("tpch_order_count", f"SELECT r_name, count(DISTINCT o_orderkey) AS order_count FROM {STAR} GROUP BY 1", "order_count", group_by=("r_name",))
on_cube("tpch_customer_count", f"SELECT n_name, count(DISTINCT c_custkey) AS customer_count FROM {STAR} GROUP BY 1", "customer_count", group_by=("n_name",))
on_cube(
    "tpch_all_measures",
    f"SELECT o_orderpriority, count(*) AS count, sum(l_quantity) AS quantity, {REVENUE} AS revenue, avg(l_discount) AS avg_discount, count(DISTINCT o_orderkey) AS order_count, count(DISTINCT c_custkey) AS customer_count FROM {STAR} GROUP BY 1",
    "count(*)", "quantity", "revenue", "avg_discount", "order_count", "customer_count", group_by=("o_orderpriority",),
)
on_cube("tpch_grand_total", f"SELECT count(*) AS count, {REVENUE} AS revenue FROM lineitem", "count(*)", "revenue")
on_cube("agg_min_max", "SELECT l_returnflag, min(l_quantity) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1", "lo", "hi", forest=(ms.Aggregator("lo", "l_quantity", "MIN"), ms.Aggregator("hi", "l_extendedprice", "MAX")), group_by=("l_returnflag",))


@query("SELECT l_orderkey, product(1 + l_discount) AS p, product(1 + l_tax) FILTER (WHERE l_returnflag = 'R') AS p_r FROM lineitem GROUP BY 1")
def agg_product(spark, d):
    table = tpch_table(spark, d).with_column(tb.SqlColumn("grown", "1 + l_discount")).with_column(tb.SqlColumn("taxed", "1 + l_tax"))
    forest = Forest.of(ms.Aggregator("p", "grown", "PRODUCT"), ms.Aggregator("p_r", "taxed", "PRODUCT", filter=fl.where("l_returnflag", "R")))
    return Cube("c", table, forest).query("p", "p_r", group_by="l_orderkey")


on_cube(
    "agg_rank2_by_flag",
    "SELECT l_returnflag, max(v) FILTER (WHERE r = 2) AS second, min(w) FILTER (WHERE s = 3) AS third_least FROM (SELECT l_returnflag, l_extendedprice AS v, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS r, l_extendedprice AS w, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS s FROM lineitem) GROUP BY 1",
    "second", "third_least", forest=(ms.Aggregator("second", "l_extendedprice", "RANK", {"rank": 2}), ms.Aggregator("third_least", "l_extendedprice", "RANK", {"rank": 3, "order": "ASC"})), group_by=("l_returnflag",),
)
on_cube(
    "agg_filtered",
    "SELECT l_linestatus, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS q_r, count(*) FILTER (WHERE l_discount > 0.05) AS n_high, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1",
    "q_r", "n_high", "quantity", forest=(ms.Aggregator("q_r", "l_quantity", filter=fl.where("l_returnflag", "R")), ms.Aggregator("n_high", "*", "COUNT", filter=fl.compare("l_discount", ">", 0.05))), group_by=("l_linestatus",),
)
on_cube("agg_count_zero_is_absent", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'R' GROUP BY 1", "n", forest=(ms.Aggregator("n", "*", "COUNT", filter=fl.where("l_linestatus", "O")),), group_by=("l_returnflag",), filter=fl.where("l_returnflag", "R"))


def events_table(spark: SparkSession, d: str) -> tb.Table:
    return tb.parquet(spark, f"{d}/events.parquet")


@query("SELECT event_type, count(value) AS n FROM events GROUP BY 1")
def agg_count_column(spark, d):
    return Cube("events", events_table(spark, d), Forest.of(ms.Aggregator("n", "value", "COUNT"))).query("n", group_by="event_type")


@query("SELECT event_type, count(*) AS n, sum(value) AS value, avg(value) AS mean FROM events GROUP BY 1")
def events_by_type(spark, d):
    forest = Forest.of(ms.count_rows("n"), ms.sum_("value"), ms.Aggregator("mean", "value", "AVG"))
    return Cube("events", events_table(spark, d), forest).query("n", "value", "mean", group_by="event_type")


@query("SELECT n_name, min(r_name) AS r FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def agg_coalesce(spark, d):
    t = tb.parquet(spark, f"{d}/nation.parquet").left_join(spark.read.parquet(f"{d}/region.parquet"), "region", [("n_regionkey", "r_regionkey")])
    return Cube("n", t, Forest.of(ms.Aggregator("r", "r_name", "COALESCE", {"failIfDifferent": True}))).query("r", group_by="n_name")


@query("SELECT l_linestatus, sum(CASE WHEN l_quantity > 25 THEN 0 ELSE l_quantity END) AS s FROM lineitem GROUP BY 1")
def agg_sum_not_nan(spark, d):
    t = tpch_table(spark, d).with_column(tb.SqlColumn("gappy", "if(l_quantity > 25, double('NaN'), l_quantity)"))
    return Cube("c", t, Forest.of(ms.Aggregator("s", "gappy", "SUM_NOT_NAN"))).query("s", group_by="l_linestatus")


@query("SELECT r_name, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def agg_union_set(spark, d):
    t = tb.parquet(spark, f"{d}/nation.parquet").left_join(spark.read.parquet(f"{d}/region.parquet"), "region", [("n_regionkey", "r_regionkey")])
    t = t.with_column(tb.SqlColumn("one", "array(n_name)"))
    return Cube("n", t, Forest.of(ms.Aggregator("set", "one", "UNION_SET"), ms.Combinator("names", ("set",), lambda v, o, c: F.array_join(v[0], ",")))).query("names", group_by="r_name")


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def agg_atomic_long_map(spark, d):
    t = tpch_table(spark, d).with_column(tb.SqlColumn("m", "map(l_linestatus, 1L)"))
    by_key = [ms.Combinator(k.lower(), ("counts",), lambda v, o, c, k=k: F.nullif(F.coalesce(F.try_element_at(v[0], F.lit(k)), F.lit(0)), F.lit(-1))) for k in ("F", "O")]
    parts = Cube("c", t, Forest.of(ms.Partitionor("counts", ("n",), ("l_linestatus",), lambda v, o, c: F.create_map(F.coalesce(c.coordinate("l_linestatus"), F.lit("")), v[0]), aggregation="ATOMIC_LONG_MAP"), ms.count_rows("n"), *by_key))
    return parts.query("f", "o", group_by="l_returnflag")


@query("SELECT l_shipmonth, count(*) AS n FROM (SELECT date_trunc('month', l_shipdate) AS l_shipmonth FROM lineitem) GROUP BY 1 ORDER BY n DESC, l_shipmonth DESC LIMIT 10")
def top_clause(spark, d):
    t = tpch_table(spark, d).with_column(tb.SqlColumn("l_shipmonth", "date_trunc('month', l_shipdate)"))
    return Cube("c", t, Forest.of(ms.count_rows("n"))).query("n", group_by="l_shipmonth", top=Top(("n", "l_shipmonth"), 10))


on_cube("distinct_slices", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", group_by=("l_returnflag", "l_linestatus"))

# --- formulas ----------------------------------------------------------------------------------------

RETURNED = ms.Filtrator("returned", "quantity", fl.where("l_returnflag", "R"))
OPEN = ms.Filtrator("open", "quantity", fl.where("l_linestatus", "O"))
BY_SHIP = "SELECT l_returnflag, sum(l_quantity) AS q, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY 1"
on_cube("comb_divide_ratio", f"SELECT l_returnflag, CASE WHEN r IS NULL THEN NULL ELSE r / o END AS x FROM ({BY_SHIP}) WHERE r IS NOT NULL", "x", forest=(RETURNED, OPEN, ms.Combinator("x", ("returned", "open"), "DIVIDE")), group_by=("l_returnflag",), filter=fl.where("l_returnflag", ["A", "N", "R"]) & fl.where("l_linestatus", ["F", "O"]))
on_cube("comb_divide_null_numerator_is_zero", f"SELECT l_returnflag, coalesce(r, 0) / o AS x FROM ({BY_SHIP}) WHERE o IS NOT NULL", "x", forest=(RETURNED, OPEN, ms.Combinator("x", ("returned", "open"), "DIVIDE", {"nullNumeratorIsZero": True})), group_by=("l_returnflag",))
on_cube("comb_sum", f"SELECT l_returnflag, coalesce(r, 0) + coalesce(o, 0) AS x FROM ({BY_SHIP}) WHERE r IS NOT NULL OR o IS NOT NULL", "x", forest=(RETURNED, OPEN, ms.Combinator("x", ("returned", "open"))), group_by=("l_returnflag",))
on_cube("comb_sum_null_if_any_is", f"SELECT l_returnflag, r + o AS x FROM ({BY_SHIP}) WHERE r + o IS NOT NULL", "x", forest=(RETURNED, OPEN, ms.Combinator("x", ("returned", "open"), "SUM", {"customIfAnyNullOperand": True})), group_by=("l_returnflag",))
on_cube("comb_subtract", f"SELECT l_returnflag, coalesce(r, 0) - coalesce(o, 0) AS x FROM ({BY_SHIP}) WHERE r IS NOT NULL OR o IS NOT NULL", "x", forest=(RETURNED, OPEN, ms.Combinator("x", ("returned", "open"), "SUBSTRACTION")), group_by=("l_returnflag",))
on_cube("comb_product", f"SELECT l_returnflag, coalesce(r, 1) * coalesce(o, 1) AS x FROM ({BY_SHIP}) WHERE r IS NOT NULL OR o IS NOT NULL", "x", forest=(RETURNED, OPEN, ms.Combinator("x", ("returned", "open"), "PRODUCT")), group_by=("l_returnflag",))
on_cube("comb_minmax", f"SELECT l_returnflag, greatest(r, o) AS hi, least(r, o) AS lo FROM ({BY_SHIP}) WHERE r IS NOT NULL OR o IS NOT NULL", "hi", "lo", forest=(RETURNED, OPEN, ms.Combinator("hi", ("returned", "open"), "MAX"), ms.Combinator("lo", ("returned", "open"), "MIN")), group_by=("l_returnflag",))
on_cube("comb_coalesce", f"SELECT l_returnflag, coalesce(r, o, q) AS x FROM ({BY_SHIP})", "x", forest=(RETURNED, OPEN, ms.Combinator("x", ("returned", "open", "quantity"), "COALESCE")), group_by=("l_returnflag",))
on_cube("comb_rpn", "SELECT l_returnflag, (sum(l_quantity) * 2.5 + count(*)) - 1000 AS x FROM lineitem GROUP BY 1", "x", forest=(ms.count_rows("n"), ms.Combinator("x", ("quantity", "n"), "REVERSE_POLISH", {"notation": "(underlyings[quantity],double[2.5],*),underlyings[n],+,int[1000],-"})), group_by=("l_returnflag",))
on_cube("comb_expression", "SELECT l_returnflag, CASE WHEN sum(l_quantity) > 1000 THEN sum(l_quantity) / count(*) ^ 2 ELSE -1 END AS x FROM lineitem GROUP BY 1", "x", forest=(ms.count_rows("n"), ms.Combinator("x", ("quantity", "n"), "EXPRESSION", {"expression": "IF(quantity > 1000, quantity / underlyings[1] ^ 2, -1)"})), group_by=("l_returnflag",))
on_cube("comb_constant", "SELECT DISTINCT l_linestatus, 7 AS x FROM lineitem", "x", forest=(ms.Combinator("x", (), "CONSTANT", {"constant": 7}),), group_by=("l_linestatus",))
on_cube("comb_aggregation", f"SELECT l_returnflag, (coalesce(r, 0) + coalesce(o, 0) + q) / (1 + (r IS NOT NULL)::INT + (o IS NOT NULL)::INT) AS x FROM ({BY_SHIP})", "x", forest=(RETURNED, OPEN, ms.Combinator("x", ("returned", "open", "quantity"), "AGGREGATION", {"aggregationKey": "AVG"})), group_by=("l_returnflag",))
on_cube("comb_marker", "SELECT l_linestatus, sum(l_quantity) * 3 AS x FROM lineitem GROUP BY 1", "x", forest=(ms.Combinator("rate", ("quantity",), "CUSTOM_MARKER", {"path": "fx.rate", "default": 1}), ms.Combinator("x", ("quantity", "rate"), "PRODUCT")), group_by=("l_linestatus",), marker={"fx": {"rate": 3}})
on_cube("comb_lambda", "SELECT l_linestatus, sqrt(sum(l_quantity)) AS x FROM lineitem GROUP BY 1", "x", forest=(ms.Combinator("x", ("quantity",), lambda v, o, c: F.sqrt(v[0])),), group_by=("l_linestatus",))
on_cube("measure_alias", "SELECT l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY 1", "qty", forest=(ms.alias("qty", "quantity"),), group_by=("l_linestatus",))

# --- measures that move filters ------------------------------------------------------------------------

on_cube("filtrator_ratio", "SELECT l_linestatus, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') / sum(l_quantity) AS x FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1", "x", forest=(RETURNED, ms.Combinator("x", ("returned", "quantity"), "DIVIDE")), group_by=("l_linestatus",), filter=fl.where("l_linestatus", "F"))
on_cube(
    "unfiltrator_share",
    f"SELECT r_name, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') / sum(l_quantity) AS x FROM {STAR} WHERE l_linestatus = 'F' GROUP BY 1",
    "x", forest=(ms.Unfiltrator("whole", "quantity", ("l_returnflag",)), ms.Combinator("x", ("quantity", "whole"), "DIVIDE")), group_by=("r_name",), filter=fl.where("l_returnflag", "R") & fl.where("l_linestatus", "F"),
)
on_cube(
    "unfiltrator_retain",
    "SELECT l_returnflag, sum(l_quantity) AS only_status, sum(l_quantity) FILTER (WHERE l_discount > 0.05) AS quantity FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1",
    "only_status", "quantity", forest=(ms.Unfiltrator("only_status", "quantity", ("l_linestatus",), retain=True),), group_by=("l_returnflag",), filter=fl.compare("l_discount", ">", 0.05) & fl.where("l_linestatus", "F"),
)
MONTHLY = "SELECT datediff('month', DATE '1970-01-01', l_shipdate::DATE) AS m, sum(l_quantity) AS q FROM lineitem GROUP BY 1"


@query(f"WITH a AS ({MONTHLY}) SELECT a.m, a.q, p.q AS previous FROM a LEFT JOIN a p ON p.m = a.m - 1")
def shiftor_prev_month(spark, d):
    t = tpch_table(spark, d).with_column(tb.SqlColumn("m", "bigint(year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1"))
    forest = Forest.of(ms.sum_("l_quantity", "q"), ms.Shiftor("previous", "q", "m", lambda m: m - 1))
    return Cube("c", t, forest).query("q", "previous", group_by="m")


on_cube(
    "shiftor_fixed_flag",
    "WITH a AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2) SELECT a.l_returnflag, a.l_linestatus, a.quantity, b.quantity AS at_r FROM a LEFT JOIN a b ON b.l_returnflag = 'R' AND b.l_linestatus = a.l_linestatus",
    "quantity", "at_r", forest=(ms.Shiftor("at_r", "quantity", "l_returnflag", "R"),), group_by=("l_returnflag", "l_linestatus"),
)
on_cube("shiftor_filter_synthesis", "SELECT l_returnflag, q AS at_r FROM (VALUES ('A'), ('Z')) v(l_returnflag), (SELECT sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R')", "at_r", forest=(ms.Shiftor("at_r", "quantity", "l_returnflag", "R"),), group_by=("l_returnflag",), filter=fl.where("l_returnflag", ["A", "Z"]))
on_cube("shiftor_without_group", "SELECT sum(l_quantity) AS at_r FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'", "at_r", forest=(ms.Shiftor("at_r", "quantity", "l_returnflag", "R"),), filter=fl.where("l_returnflag", "A") & fl.where("l_linestatus", "F"))
on_cube("partitionor_max_then_sum", "SELECT l_returnflag, sum(q) AS x FROM (SELECT l_returnflag, l_suppkey, greatest(sum(l_quantity), count(*) * 30) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1", "x", forest=(ms.count_rows("n"), ms.Combinator("n30", ("n",), lambda v, o, c: v[0] * 30), ms.Partitionor("x", ("quantity", "n30"), ("l_suppkey",), "MAX")), group_by=("l_returnflag",))
on_cube("partitionor_share", "SELECT l_linestatus, max(q) / sum(q) AS x FROM (SELECT l_linestatus, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1", "x", forest=(ms.Partitionor("best", ("quantity",), ("l_returnflag",), "SUM", aggregation="MAX"), ms.Combinator("x", ("best", "quantity"), "DIVIDE")), group_by=("l_linestatus",))
on_cube("columnator_hide", "SELECT l_returnflag, sum(l_quantity) AS quantity, NULL::DOUBLE AS hidden, sum(l_quantity) AS shown FROM lineitem GROUP BY 1", "quantity", "hidden", "shown", forest=(ms.Columnator("hidden", ("quantity",), ("l_linestatus",)), ms.Columnator("shown", ("quantity",), ("l_linestatus",), hide_if_present=True)), group_by=("l_returnflag",))
on_cube("columnator_by_filter", "SELECT l_returnflag, sum(l_quantity) AS x FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1", "x", forest=(ms.Columnator("x", ("quantity",), ("l_linestatus",)),), group_by=("l_returnflag",), filter=fl.where("l_linestatus", "F"))


on_cube("routing_by_group", "SELECT l_linestatus, count(*) AS x FROM lineitem GROUP BY 1", "x", forest=(ms.count_rows("n"), ms.Routing("x", ("quantity", "n"), lambda s: [type(s)(ms.count_rows("n"), s.filter, s.group_by, s.marker)])), group_by=("l_linestatus",))


@query("SELECT l_linestatus, sum(l_quantity) FILTER (WHERE l_discount > 0.05) / sum(l_quantity) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def ratio_over_value(spark, d):
    c = tpch(spark, d, ms.share_at("l_returnflag", "A", "quantity"), ms.alias("x", "quantity share at A"))
    return c.query("x", group_by="l_linestatus", filter=fl.compare("l_discount", ">", 0.05))


@query("SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_discount > 0.05) / sum(l_quantity) AS x FROM lineitem GROUP BY 1")
def ratio_over_current(spark, d):
    c = tpch(spark, d, ms.share_of_own("l_returnflag", "quantity"), ms.alias("x", "quantity share of own l_returnflag"))
    return c.query("x", group_by="l_returnflag", filter=fl.compare("l_discount", ">", 0.05))


# --- decompositions -------------------------------------------------------------------------------------

on_cube(
    "dispatchor_linear",
    "SELECT bound, sum(v) AS x FROM (SELECT 1.0::DOUBLE AS bound, CASE WHEN l_quantity = 1 THEN q WHEN l_quantity = 50 THEN NULL ELSE q * (l_quantity - 1) / 49 END AS v FROM (SELECT l_quantity, sum(l_extendedprice) AS q FROM lineitem GROUP BY 1) UNION ALL SELECT 50.0::DOUBLE, CASE WHEN l_quantity = 1 THEN NULL WHEN l_quantity = 50 THEN q ELSE q - q * (l_quantity - 1) / 49 END FROM (SELECT l_quantity, sum(l_extendedprice) AS q FROM lineitem GROUP BY 1)) GROUP BY 1",
    "x", forest=(ms.sum_("l_extendedprice", "price"), ms.Dispatchor("x", "price", dc.Linear("l_quantity", "bound", 1, 50))), group_by=("bound",),
)
GROUPS = {"ASIA": ["east", "all"], "EUROPE": ["west", "all"], "AMERICA": ["west", "all"]}
BRIDGE = "(VALUES ('ASIA', 'east'), ('ASIA', 'all'), ('EUROPE', 'west'), ('EUROPE', 'all'), ('AMERICA', 'west'), ('AMERICA', 'all')) b(element, grp)"


def _m2m(spark: SparkSession, d: str) -> Cube:
    return tpch(spark, d, ms.Dispatchor("x", "quantity", dc.many_to_many(spark, "r_name", "grp", GROUPS)))


@query(f"SELECT grp, sum(l_quantity) AS x FROM {STAR} JOIN {BRIDGE} ON r_name = element GROUP BY 1")
def m2m_1d(spark, d):
    return _m2m(spark, d).query("x", group_by="grp")


@query(f"SELECT l_linestatus, sum(l_quantity) AS x FROM {STAR} WHERE r_name IN (SELECT element FROM {BRIDGE} WHERE grp IN ('west', 'all')) GROUP BY 1")
def m2m_filtered_once(spark, d):
    return _m2m(spark, d).query("x", group_by="l_linestatus", filter=fl.where("grp", ["west", "all"]))


@query(f"SELECT grp, sum(l_quantity) AS x FROM {STAR} JOIN (VALUES ('R', 'F', 'g1'), ('A', 'F', 'g1'), ('R', 'F', 'g2'), ('N', 'O', 'g2')) b(flag, status, grp) ON l_returnflag = flag AND l_linestatus = status GROUP BY 1")
def m2m_nd(spark, d):
    bridge = spark.createDataFrame([("R", "F", "g1"), ("A", "F", "g1"), ("R", "F", "g2"), ("N", "O", "g2")], ["l_returnflag", "l_linestatus", "grp"])
    return tpch(spark, d, ms.Dispatchor("x", "quantity", dc.ManyToMany(("l_returnflag", "l_linestatus"), "grp", bridge))).query("x", group_by="grp")


@query(f"SELECT zone, sum(l_quantity) AS x FROM {STAR} LEFT JOIN (VALUES ('ASIA', 'z1'), ('EUROPE', 'z2')) j(r, zone) ON r_name = r GROUP BY 1")
def join_decomp(spark, d):
    lookup = spark.createDataFrame([("ASIA", "z1"), ("EUROPE", "z2")], ["r_name", "zone"])
    return tpch(spark, d, ms.Dispatchor("x", "quantity", dc.LookupJoin(("r_name",), ("zone",), lookup))).query("x", group_by="zone")


on_cube("duplicate", "SELECT l_linestatus, scenario, sum(l_quantity) AS x FROM lineitem, (VALUES ('up'), ('down')) v(scenario) GROUP BY 1, 2", "x", forest=(ms.Dispatchor("x", "quantity", dc.Duplicating({"scenario": ("up", "down", "flat")})),), group_by=("l_linestatus", "scenario"), filter=fl.where("scenario", ["up", "down"]))
on_cube("generated_column_elsewhere", "SELECT 'generated' AS scenario, sum(l_quantity) AS quantity FROM lineitem", "quantity", forest=(ms.Dispatchor("x", "quantity", dc.Duplicating({"scenario": ("up", "down")})),), group_by=("scenario",))


@query(f"SELECT m, sum(q) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING) AS total FROM ({MONTHLY})")
def cumulate(spark, d):
    t = tpch_table(spark, d).with_column(tb.SqlColumn("m", "bigint(year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1"))
    return Cube("c", t, Forest.of(ms.sum_("l_quantity", "q"), ms.Dispatchor("total", "q", dc.Cumulating("m")))).query("total", group_by="m")


@query("SELECT y, l_returnflag, sum(q) AS total FROM (SELECT year(l_shipdate) AS y0, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) a JOIN (SELECT DISTINCT year(l_shipdate) AS y FROM lineitem) b ON y0 <= y WHERE y >= 1998 GROUP BY 1, 2")
def cumulate_by_flag(spark, d):
    t = tpch_table(spark, d).with_column(tb.SqlColumn("y", "bigint(year(l_shipdate))"))
    c = Cube("c", t, Forest.of(ms.sum_("l_quantity", "q"), ms.Dispatchor("total", "q", dc.Cumulating("y"))))
    return c.query("total", group_by=("y", "l_returnflag"), filter=fl.compare("y", ">=", 1998))


@query("SELECT l_linestatus, CASE WHEN l_quantity < 10 THEN 'small' ELSE 'large' END AS band, count(*) AS x FROM lineitem GROUP BY 1, 2")
def dispatch_map_entries(spark, d):
    t = tpch_table(spark, d).with_column(tb.SqlColumn("m", "map(if(l_quantity < 10, 'small', 'large'), 1L)"))
    t = tb.Table(t.frame(["l_linestatus", "m"]).select("l_linestatus", F.map_keys("m")[0].alias("k")))
    bands = ms.Partitionor("bands", ("n",), ("k",), lambda v, o, c: F.create_map(c.coordinate("k"), v[0]), aggregation="ATOMIC_LONG_MAP")
    return Cube("c", t, Forest.of(ms.count_rows("n"), bands, ms.Dispatchor("x", "bands", dc.Exploding("band")))).query("x", group_by=("l_linestatus", "band"))


# --- filters -----------------------------------------------------------------------------------------------


def shops(spark: SparkSession, d: str) -> tb.Table:
    """Customers by segment and nation, both null for some, under an alias and as stored."""
    t = tb.parquet(spark, f"{d}/customer.parquet").with_alias("stored", "c_mktsegment")
    return t.with_column(tb.SqlColumn("a", "nullif(c_mktsegment, 'MACHINERY')")).with_column(tb.SqlColumn("v", "if(c_acctbal >= 0, bigint(c_nationkey), null)"))


ROWS = "(SELECT nullif(c_mktsegment, 'MACHINERY') AS a, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS v, c_mktsegment AS stored FROM customer)"


def on_shops(name: str, condition: str, f: fl.Filter) -> None:
    sql = f"SELECT a, sum(v)::BIGINT AS v, count(*) AS n FROM {ROWS} WHERE {condition} GROUP BY 1"
    query(sql, name)(lambda spark, d: Cube("shops", shops(spark, d), Forest.of(ms.sum_("v"), ms.count_rows("n"))).query("v", "n", group_by="a", filter=f))


on_shops("filters_equals", "a = 'BUILDING'", fl.where("a", "BUILDING"))
on_shops("filters_pushed_down", "stored IN ('BUILDING', 'FURNITURE')", fl.where("stored", ["BUILDING", "FURNITURE"]))
on_shops("filters_not_equals_keeps_null", "a IS NULL OR a <> 'BUILDING'", ~fl.where("a", "BUILDING"))
on_shops("filters_in_with_null", "a IN ('BUILDING', 'FURNITURE') OR a IS NULL", fl.where("a", ["BUILDING", ["FURNITURE", None]]))
on_shops("filters_not_in", "a IS NULL OR a NOT IN ('BUILDING', 'FURNITURE')", ~fl.where("a", ["BUILDING", "FURNITURE"]))
on_shops("filters_is_null", "a IS NULL", fl.where("a", None))
on_shops("filters_like", "a LIKE 'F%NITUR_'", fl.like("a", "F%NITUR_"))
on_shops("filters_ilike", "a ILIKE 'f%nitur_'", fl.like("a", "f%nitur_", ignore_case=True))
on_shops("filters_regex", "regexp_full_match(a, '(?is)[a-h].*[gd]')", fl.where("a", re.compile("[a-h].*[gd]")))
on_shops("filters_comparing_drops_null", "v > 12", fl.compare("v", ">", 12, match_if_null=True))
on_shops("filters_not_comparing", "v <= 12", ~fl.compare("v", ">", 12))
on_shops("filters_and_or_not", "(a = 'BUILDING' OR v >= 12) AND NOT coalesce(a = 'HOUSEHOLD', false)", (fl.where("a", "BUILDING") | fl.compare("v", ">=", 12)) & ~fl.where("a", "HOUSEHOLD"))
on_shops("filters_text_ignore_case", "lower(a) = 'building'", fl.Where("a", fl.Text("Building", True)))
on_shops("filters_missing_column_is_null", "true", fl.where("nowhere", None))
on_shops("filters_missing_column_fails", "false", fl.Where("nowhere", fl.IsNull(), null_if_absent=False))
on_shops("filters_rsql", "(a = 'BUILDING' AND v > 3) OR a IN ('FURNITURE', 'HOUSEHOLD')", fl.parse("a==BUILDING;v>3,a=in=(FURNITURE,HOUSEHOLD)"))
on_shops("filters_predicate", "length(a) = 9", fl.Where("a", fl.Predicate(lambda c: F.length(c) == 9)))
on_shops("filters_matchers", "v > 3 AND (v < 9 OR v = 20) AND NOT v = 5", fl.Where("v", fl.AllOf((fl.compare("v", ">", 3).matcher, fl.AnyOf((fl.compare("v", "<", 9).matcher, fl.Equals(20))), fl.NotMatcher(fl.Equals(5))))))
on_shops("filters_from_json", "(a = 'BUILDING' OR a IS NULL) AND v >= 2", fl.from_json(fl.to_json((fl.where("a", "BUILDING") | fl.where("a", None)) & fl.compare("v", ">=", 2))))


# --- tables, joins, columns ------------------------------------------------------------------------------------

on_cube("drillthrough_rows", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity AS quantity, CASE WHEN l_returnflag = 'R' THEN l_quantity END AS quantity_2 FROM lineitem", "quantity", "returned", forest=(RETURNED,), group_by=("l_orderkey", "l_linenumber"), options=("DRILLTHROUGH",))
on_cube("drillthrough_filtered", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity AS quantity, CASE WHEN l_returnflag = 'R' THEN l_quantity END AS quantity_2 FROM lineitem WHERE l_discount > 0.05", "quantity", "returned", forest=(RETURNED,), group_by=("l_orderkey", "l_linenumber"), filter=fl.compare("l_discount", ">", 0.05), options=("DRILLTHROUGH",))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def implicit_filter(spark, d):
    c = Cube("c", tpch_table(spark, d), Forest.of(ms.count_rows("n")), implicit_filter=lambda q: fl.where("l_linestatus", "F"))
    return c.query("n", group_by="l_returnflag")


@query("SELECT upper(o_orderstatus) || '-' || l_returnflag AS tag, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS band, length(p_brand) AS len, sum(l_quantity) AS quantity FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3")
def calc_column(spark, d):
    t = tpch_table(spark, d).with_column(tb.FormulaColumn("tag", 'STR_UPPER(o_orderstatus) + "-" + l_returnflag'))
    t = t.with_column(tb.SqlColumn("band", "CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END")).with_column(tb.FunctionColumn("len", lambda b: F.length(b).cast("long"), ("p_brand",)))
    return Cube("c", t, tpch_forest()).query("quantity", group_by=("tag", "band", "len"))


@query("SELECT l_linestatus, sum(l_quantity) AS quantity FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE upper(o_orderstatus) || '!' = 'F!' GROUP BY 1")
def calc_column_filtered(spark, d):
    t = tpch_table(spark, d).with_column(tb.FormulaColumn("tag", 'STR_UPPER(o_orderstatus) + "!"'))
    return Cube("c", t, tpch_forest()).query("quantity", group_by="l_linestatus", filter=fl.where("tag", "F!"))


@query("SELECT l_returnflag, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1 UNION ALL SELECT '*', sum(l_quantity) FROM lineitem UNION ALL SELECT 'not N', sum(l_quantity) FROM lineitem WHERE l_returnflag <> 'N'")
def calc_coordinate(spark, d):
    members = tb.CalculatedMembers("l_returnflag", (("*", fl.ALL), ("not N", ~fl.where("l_returnflag", "N"))))
    return tpch(spark, d).query("quantity", group_by=(members,))


@query("SELECT r_name AS area, sum(s_acctbal) AS bal FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def snowflake_aliases(spark, d):
    t = tb.parquet(spark, f"{d}/supplier.parquet").left_join(spark.read.parquet(f"{d}/nation.parquet"), "n", [("s_nationkey", "n_nationkey")], aliases={"country": "n_name"})
    t = t.left_join(spark.read.parquet(f"{d}/region.parquet"), "r", [("n_regionkey", "r_regionkey")], parent="n").with_alias("area", "region_name").with_alias("region_name", "r_name")
    return Cube("s", t, Forest.of(ms.sum_("s_acctbal", "bal"))).query("bal", group_by="area")


@query("SELECT n_name AS customer_nation, sn AS supplier_nation, count(*) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN (SELECT n_nationkey AS k, n_name AS sn FROM nation) ON s_nationkey = k GROUP BY 1, 2")
def two_roles_of_one_table(spark, d):
    t = tpch_table(spark, d).left_join(spark.read.parquet(f"{d}/nation.parquet"), "supp_nation", [("s_nationkey", "n_nationkey")], parent="supplier")
    t = t.with_alias("customer_nation", "cust_nation.n_name").with_alias("supplier_nation", "supp_nation.n_name")
    return Cube("c", t, Forest.of(ms.count_rows("n"))).query("n", group_by=("customer_nation", "supplier_nation"))


@query("SELECT CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE l_returnflag END AS l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY 1")
def value_transcoding(spark, d):
    t = tpch_table(spark, d).with_values("l_returnflag", {"R": "returned", "A": "accepted"})
    return Cube("c", t, Forest.of(ms.count_rows("n"))).query("n", group_by="l_returnflag", filter=fl.where("l_returnflag", ["returned", "N"]))


@query("SELECT o_orderpriority, o_totalprice AS latest FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_row_per_key(spark, d):
    spark.read.parquet(f"{d}/orders.parquet").createOrReplaceTempView("tessera_orders")
    t = tb.query(spark, "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM tessera_orders) WHERE r = 1")
    return Cube("o", t, Forest.of(ms.sum_("o_totalprice", "latest"))).query("latest", group_by="o_orderpriority")


@query("SELECT l_returnflag AS L_RETURNFLAG, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def case_insensitive_columns(spark, d):
    c = Cube("c", tpch_table(spark, d), Forest.of(ms.count_rows("n")), case_insensitive=True)
    return c.query("n", group_by="L_RETURNFLAG", filter=fl.where("L_LineStatus", "F"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus), ())")
def grouping_sets_multi(spark, d):
    from tessera.plans.sets import grouping_sets

    return grouping_sets(tpch(spark, d), ["quantity"], [("l_returnflag",), ("l_linestatus",), ("l_returnflag", "l_linestatus"), ()])


@query("SELECT l_returnflag, l_linestatus, avg(l_discount) AS avg_discount, grouping(l_returnflag)::INT AS grouping_l_returnflag, grouping(l_linestatus)::INT AS grouping_l_linestatus FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_with_markers(spark, d):
    from tessera.plans.sets import grouping_sets, rollup

    return grouping_sets(tpch(spark, d), ["avg_discount"], rollup("l_returnflag", "l_linestatus"), markers=True)


# --- composites --------------------------------------------------------------------------------------------------


def _both(spark: SparkSession, d: str) -> Cube:
    orders = Cube("orders", tb.parquet(spark, f"{d}/orders.parquet").with_alias("status", "o_orderstatus"), Forest.of(ms.count_rows("n"), ms.Aggregator("price", "o_totalprice"), ms.Aggregator("mean", "o_totalprice", "AVG")))
    lines = Cube("lines", tb.parquet(spark, f"{d}/lineitem.parquet").with_alias("status", "l_linestatus"), Forest.of(ms.count_rows("n"), ms.Aggregator("price", "l_extendedprice"), ms.Aggregator("mean", "l_extendedprice", "AVG")))
    return composite("both", [orders, lines], Forest.of(ms.Combinator("per_row", ("price", "n"), "DIVIDE")))


UNION = "(SELECT o_orderstatus AS status, o_totalprice AS p, 'orders' AS cube, o_orderpriority AS prio FROM orders UNION ALL SELECT l_linestatus, l_extendedprice, 'lines', 'lines' FROM lineitem)"


@query(f"SELECT status, count(*) AS n, sum(p) AS price, avg(p) AS mean, sum(p) / count(*) AS per_row FROM {UNION} GROUP BY 1")
def composite_cubes(spark, d):
    return _both(spark, d).query("n", "price", "mean", "per_row", group_by="status")


@query(f"SELECT prio AS o_orderpriority, count(*) AS n FROM {UNION} GROUP BY 1")
def composite_missing_column(spark, d):
    return _both(spark, d).query("n", group_by="o_orderpriority")


@query(f"SELECT cube, count(*) AS n FROM {UNION} WHERE cube = 'lines' GROUP BY 1")
def composite_slicer(spark, d):
    return _both(spark, d).query("n", group_by=SLICER, filter=fl.where(SLICER, "lines")).withColumnRenamed(SLICER, "cube")


# --- examples, options, forests ------------------------------------------------------------------------------------


@query("SELECT event_type, CASE WHEN event_type = 'purchase' THEN 5 * n WHEN event_type = 'error' THEN -2 * n ELSE n END AS score FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def event_scores(spark, d):
    def score(v, o, c):
        kind = c.coordinate("event_type")
        return F.when(kind == "purchase", 5 * v[0]).when(kind == "error", -2 * v[0]).otherwise(v[0])

    forest = Forest.of(ms.count_rows("n"), ms.Partitionor("score", ("n",), ("event_type",), score))
    return Cube("events", events_table(spark, d), forest).query("score", group_by="event_type")


@query("SELECT sum(CASE WHEN event_type = 'purchase' THEN 5 * n WHEN event_type = 'error' THEN -2 * n ELSE n END)::BIGINT AS score FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def event_scores_total(spark, d):
    def score(v, o, c):
        kind = c.coordinate("event_type")
        return F.when(kind == "purchase", 5 * v[0]).when(kind == "error", -2 * v[0]).otherwise(v[0])

    forest = Forest.of(ms.count_rows("n"), ms.Partitionor("score", ("n",), ("event_type",), score))
    return Cube("events", events_table(spark, d), forest).query("score")


on_cube("unknown_measures_are_empty", "SELECT l_linestatus, sum(l_quantity) AS quantity, NULL::DOUBLE AS nothing FROM lineitem GROUP BY 1", "quantity", "nothing", group_by=("l_linestatus",), options=("UNKNOWN_MEASURES_ARE_EMPTY",))
on_cube("exceptions_as_values", "SELECT DISTINCT l_linestatus, 'ValueError: unknown measure nowhere' AS broken FROM lineitem", "broken", forest=(ms.Combinator("broken", ("nowhere",)),), group_by=("l_linestatus",), options=("EXCEPTIONS_AS_MEASURE_VALUE",))


@query("SELECT l_linestatus, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') / sum(l_quantity) AS share FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def forest_from_json(spark, d):
    text = """[{"name": "share", "type": "Combinator", "combination": "DIVIDE", "underlyings": [
        {"name": "returned", "type": "Filtrator", "underlying": {"type": "Aggregator", "column": "l_quantity"}, "filter": {"type": "column", "column": "l_returnflag", "matcher": "R"}},
        {"type": "Aggregator", "column": "l_quantity"}]}]"""
    return Cube("c", tpch_table(spark, d), Forest.from_json(text)).query("share", group_by="l_linestatus", filter=fl.where("l_linestatus", "F"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(value) AS value FROM events GROUP BY 1, 2")
def events_by_day(spark, d):
    t = events_table(spark, d).with_column(tb.SqlColumn("day", "date_format(ts, 'yyyy-MM-dd')"))
    return Cube("events", t, Forest.of(ms.count_rows("n"), ms.sum_("value"))).query("n", "value", group_by=("day", "event_type"))


@query(f"SELECT r_name, l_returnflag, {REVENUE} AS revenue, count(*) AS n FROM {STAR} WHERE p_brand LIKE 'Brand#1%' AND o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2 HAVING count(*) > 0")
def tpch_filtered_two_dimensions(spark, d):
    from datetime import datetime

    f = fl.like("p_brand", "Brand#1%") & fl.compare("o_orderdate", ">=", datetime(1996, 1, 1))
    return tpch(spark, d, ms.count_rows("n")).query("revenue", "n", group_by=("r_name", "l_returnflag"), filter=f)


# --- security: what a cube hides stays hidden on every path ------------------------------------------------------------


def _hiding(spark: SparkSession, d: str) -> Cube:
    return Cube("seen", tb.parquet(spark, f"{d}/lineitem.parquet"), Forest.of(ms.count_rows("n"), ms.sum_("l_quantity", "quantity")), implicit_filter=lambda q: fl.where("l_linestatus", "F"))


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def rls_sql(spark, d):
    return _hiding(spark, d).sql("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM seen GROUP BY l_returnflag")


@query("SELECT l_returnflag, sum(l_quantity) / count(*) AS per_row, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' AND l_discount > 0.02 GROUP BY 1 HAVING count(*) > 0")
def sql_of_measures(spark, d):
    return _hiding(spark, d).sql("SELECT l_returnflag, MEASURE(quantity) / MEASURE(n) AS per_row, MEASURE(`quantity`) AS q FROM seen WHERE l_discount > 0.02 GROUP BY l_returnflag HAVING MEASURE(n) > 0 ORDER BY l_returnflag LIMIT 100")


@query("SELECT l_linestatus AS value, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def rls_statistics(spark, d):
    top = _hiding(spark, d).statistics("l_linestatus").select(F.explode("top").alias("t"))
    return top.select(F.col("t.item").alias("value"), F.col("t.count").alias("n"))


@query("SELECT DISTINCT l_linestatus AS value FROM lineitem WHERE l_linestatus = 'F'")
def rls_coordinates(spark, d):
    _, found = _hiding(spark, d).coordinates("l_linestatus")
    return spark.createDataFrame([(x,) for x in found], "value string")


def _hiding_both(spark: SparkSession, d: str) -> Cube:
    orders = Cube("orders", tb.parquet(spark, f"{d}/orders.parquet").with_alias("status", "o_orderstatus"), Forest.of(ms.count_rows("n"), ms.Aggregator("price", "o_totalprice")), implicit_filter=lambda q: fl.where("o_orderpriority", "1-URGENT"))
    lines = Cube("lines", tb.parquet(spark, f"{d}/lineitem.parquet").with_alias("status", "l_linestatus"), Forest.of(ms.count_rows("n"), ms.Aggregator("price", "l_extendedprice")), implicit_filter=lambda q: fl.where("l_returnflag", "R"))
    return composite("both", [orders, lines])


SEEN = "(SELECT o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT l_linestatus, l_extendedprice FROM lineitem WHERE l_returnflag = 'R')"


@query(f"SELECT status, price FROM {SEEN} WHERE status = 'F'")
def rls_composite_drillthrough(spark, d):
    return _hiding_both(spark, d).query("price", group_by="status", filter=fl.where("status", "F"), options=("DRILLTHROUGH",))


@query(f"SELECT status, count(*) AS n, sum(price) AS p FROM {SEEN} GROUP BY 1")
def rls_composite_sql(spark, d):
    seen = _hiding_both(spark, d).visible(["status", "o_totalprice", "l_extendedprice"])
    # a column that a cube lacks has the cube's name there
    price = F.coalesce(F.col("o_totalprice").try_cast("double"), F.col("l_extendedprice").try_cast("double"))
    return seen.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(price).alias("p"))


@query(f"SELECT status, sum(p) * 3 AS priced FROM {UNION} GROUP BY 1")
def composite_marker(spark, d):
    def cube(name: str, status: str, price: str) -> Cube:
        forest = Forest.of(ms.Aggregator("price", price), ms.Combinator("rate", ("price",), "CUSTOM_MARKER", {"path": "fx.rate", "default": 1.0}), ms.Combinator("priced", ("price", "rate"), "PRODUCT"))
        return Cube(name, tb.parquet(spark, f"{d}/{name}.parquet").with_alias("status", status), forest)

    both = composite("both", [cube("orders", "o_orderstatus", "o_totalprice"), cube("lineitem", "l_linestatus", "l_extendedprice")])
    return both.query("priced", group_by="status", marker={"fx": {"rate": 3.0}})


# --- collections, text and states ------------------------------------------------------------------------------------------


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def agg_union_of_values(spark, d):
    t = tb.parquet(spark, f"{d}/nation.parquet").left_join(spark.read.parquet(f"{d}/region.parquet"), "region", [("n_regionkey", "r_regionkey")])
    return Cube("n", t, Forest.of(ms.Aggregator("set", "n_name", "UNION"), ms.Combinator("names", ("set",), lambda v, o, c: F.array_join(v[0], ",")))).query("names", group_by="r_name")


@query("SELECT r_name, max(n_nationkey)::BIGINT AS last, count(*) AS size FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def agg_union_map(spark, d):
    t = tb.parquet(spark, f"{d}/nation.parquet").left_join(spark.read.parquet(f"{d}/region.parquet"), "region", [("n_regionkey", "r_regionkey")])
    t = t.with_column(tb.SqlColumn("m", "map(n_name, bigint(n_nationkey))"))
    last, size = ms.Combinator("last", ("map",), lambda v, o, c: F.array_max(F.map_values(v[0]))), ms.Combinator("size", ("map",), lambda v, o, c: F.size(v[0]).cast("long"))
    return Cube("n", t, Forest.of(ms.Aggregator("map", "m", "UNION_MAP"), last, size)).query("last", "size", group_by="r_name")


@query("SELECT r_name, count(*) AS size FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def agg_union_of_maps(spark, d):
    t = tb.parquet(spark, f"{d}/nation.parquet").left_join(spark.read.parquet(f"{d}/region.parquet"), "region", [("n_regionkey", "r_regionkey")])
    t = t.with_column(tb.SqlColumn("m", "map(n_name, bigint(n_nationkey))"))
    return Cube("n", t, Forest.of(ms.Aggregator("map", "m", "UNION"), ms.Combinator("size", ("map",), lambda v, o, c: F.size(v[0]).cast("long")))).query("size", group_by="r_name")


@query("SELECT l_returnflag, 2 * count(*) AS size FROM lineitem GROUP BY 1")
def agg_union_list(spark, d):
    t = tpch_table(spark, d).with_column(tb.SqlColumn("pair", "array(l_linestatus, 'x')"))
    return Cube("c", t, Forest.of(ms.Aggregator("list", "pair", "UNION_LIST"), ms.Combinator("size", ("list",), lambda v, o, c: F.size(v[0]).cast("long")))).query("size", group_by="l_returnflag")


@query("SELECT o_orderstatus, '{' || string_agg(DISTINCT upper(o_orderpriority), ', ' ORDER BY upper(o_orderpriority)) || '}' AS s, string_agg(DISTINCT upper(o_orderpriority), ',' ORDER BY upper(o_orderpriority)) AS t FROM orders GROUP BY 1")
def agg_sum_else_text(spark, d):
    t = tb.parquet(spark, f"{d}/orders.parquet").with_column(tb.SqlColumn("p", "upper(o_orderpriority)"))
    return Cube("o", t, Forest.of(ms.Aggregator("s", "p", "SUM_ELSE_SET"), ms.Aggregator("t", "p", "SUM_ELSE_STRING"))).query("s", "t", group_by="o_orderstatus")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def agg_sum_else_number(spark, d):
    t = tb.parquet(spark, f"{d}/orders.parquet").with_column(tb.SqlColumn("one", "'1'"))
    number = ms.Combinator("n", ("s",), lambda v, o, c: v[0].cast("double").cast("long"))
    return Cube("o", t, Forest.of(ms.Aggregator("s", "one", "SUM_ELSE_SET"), number)).query("n", group_by="o_orderstatus")


@query("SELECT o_orderstatus, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS exact FROM orders GROUP BY 1")
def agg_sum_of_decimals(spark, d):
    t = tb.parquet(spark, f"{d}/orders.parquet").with_column(tb.SqlColumn("p", "cast(o_totalprice AS decimal(18, 2))"))
    return Cube("o", t, Forest.of(ms.sum_("p"), ms.Combinator("exact", ("p",), lambda v, o, c: v[0].cast("double")))).query("exact", group_by="o_orderstatus")


@query("SELECT l_returnflag, sum(l_quantity) AS sum_state, sum(l_discount) AS mean_sum, count(l_discount) AS mean_count FROM lineitem GROUP BY 1")
def carriers_stay_wrapped(spark, d):
    out = tpch(spark, d).query("quantity", "avg_discount", group_by="l_returnflag", options=("AGGREGATION_CARRIERS_STAY_WRAPPED",))
    return out.select("l_returnflag", F.col("`quantity#0`").alias("sum_state"), F.col("`avg_discount#0`").alias("mean_sum"), F.col("`avg_discount#1`").alias("mean_count"))


@query("SELECT l_linestatus, sqrt(sum(l_quantity * l_quantity)) AS x FROM lineitem GROUP BY 1")
def agg_own_function(spark, d):
    from tessera.operators.aggregations import Aggregation

    length = Aggregation(lambda c: [F.sum(c * c)], lambda s: [F.sum(s[0])], lambda s: F.sqrt(s[0]))
    return tpch(spark, d, ms.Aggregator("x", "l_quantity", length)).query("x", group_by="l_linestatus")


@query("SELECT l_linestatus, max(l_quantity) - min(l_quantity) AS x FROM lineitem GROUP BY 1")
def agg_registered(spark, d):
    from tessera.operators import aggregations as ag

    ag.register("SPREAD", lambda o: ag.Aggregation(lambda c: [F.min(c), F.max(c)], lambda s: [F.min(s[0]), F.max(s[1])], lambda s: s[1] - s[0], size=2))
    return tpch(spark, d, ms.Aggregator("x", "l_quantity", "SPREAD")).query("x", group_by="l_linestatus")


@query("SELECT l_linestatus, max(l_quantity) AS x FROM lineitem GROUP BY 1")
def agg_lambda(spark, d):
    return tpch(spark, d, ms.Aggregator("x", "l_quantity", F.max)).query("x", group_by="l_linestatus")


ACROSS = f"SELECT l_returnflag, coalesce(r, 0) + coalesce(o, 0) + q AS added, coalesce(r, 0) + coalesce(o, 0) + q AS not_nan, greatest(r, o, q) AS hi, list_count([r, o, q]) AS n FROM ({BY_SHIP})"


@query(ACROSS)
def comb_aggregations_across(spark, d):
    names = {"added": "SUM", "not_nan": "SUM_NOT_NAN", "hi": "MAX", "n": "COUNT"}
    return tpch(spark, d, RETURNED, OPEN, *(ms.Combinator(n, ("returned", "open", "quantity"), "AGGREGATION", {"aggregationKey": k}) for n, k in names.items())).query(*names, group_by="l_returnflag")


@query("SELECT l_returnflag, (sum(l_quantity) + count(*)) * 2 AS x FROM lineitem GROUP BY 1")
def comb_composed(spark, d):
    both = ms.Combinator("both", ("quantity", "n"), "SUM")
    return tpch(spark, d, ms.count_rows("n"), both, ms.Combinator("x", ("both",), lambda v, o, c: v[0] * 2)).query("x", group_by="l_returnflag")


on_cube("exceptions_at_run_time", "SELECT l_linestatus, 'RuntimeError: out of order' AS broken, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1", "broken", "quantity", forest=(ms.Combinator("broken", ("quantity",), "THROWING", {"message": "out of order"}),), group_by=("l_linestatus",), options=("EXCEPTIONS_AS_MEASURE_VALUE",))
on_cube("shiftor_always", "SELECT l_linestatus, (SELECT sum(l_quantity) FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = a.l_linestatus) AS at_r FROM lineitem a GROUP BY 1", "at_r", forest=(ms.Shiftor("at_r", "quantity", "l_returnflag", "R", only_if_present=False),), group_by=("l_linestatus",))
on_cube("shiftor_editor", "SELECT l_linestatus, sum(l_quantity) AS x FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1", "x", forest=(ms.Shiftor("x", "quantity", editor=lambda f, marker: fl.and_(fl.suppress(f, ["l_returnflag"]), fl.where("l_returnflag", marker))),), group_by=("l_linestatus",), filter=fl.where("l_returnflag", ["A", "N"]), marker="N")
on_cube("decomposition_identity", "SELECT l_linestatus, sum(l_quantity) AS x FROM lineitem GROUP BY 1", "x", forest=(ms.Dispatchor("x", "quantity", dc.Decomposition()),), group_by=("l_linestatus",))
on_cube(
    "decomposition_by_function",
    "SELECT half, sum(q) / 2 AS x FROM (SELECT l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY 1), (VALUES ('first'), ('second')) h(half) GROUP BY 1",
    "x", forest=(ms.Dispatchor("x", "quantity", dc.Lambda(lambda df: df.withColumn("half", F.explode(F.array(F.lit("first"), F.lit("second")))).withColumn("value", F.col("value") / 2), ("l_linestatus",), ("half",))),), group_by=("half",),
)


class Doubled(ms.Measure):
    """A measure of a kind of its own: what it plans is a formula over another step."""

    def build(self, planner, step):
        from tessera.plans.planner import Formula

        return Formula(step.group_by, lambda v: v[0] * 2, [planner.node("quantity", step.filter, step.group_by, step.marker)])


on_cube("measure_of_own_kind", "SELECT l_linestatus, 2 * sum(l_quantity) AS x FROM lineitem GROUP BY 1", "x", forest=(Doubled("x"),), group_by=("l_linestatus",))


@query("SELECT l_linestatus, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1")
def measures_by_tag(spark, d):
    forest = Forest.of(ms.with_tags(ms.sum_("l_quantity", "q"), "shown"), ms.with_tags(ms.count_rows("n"), "shown"), ms.sum_("l_tax", "hidden"))
    return Cube("c", tpch_table(spark, d), forest).query(*(m.name for m in forest.all().values() if "shown" in m.tags), group_by="l_linestatus")


@query(ORACLE_SQL["dispatchor_linear"])
def dispatchor_from_json(spark, d):
    forest = Forest.of(ms.sum_("l_extendedprice", "price"), ms.Dispatchor("x", "price", dc.Linear("l_quantity", "bound", 1, 50)))
    return Cube("c", tpch_table(spark, d), Forest.from_json(forest.to_json())).query("x", group_by="bound")


@query(ORACLE_SQL["m2m_1d"])
def m2m_from_yaml(spark, d):
    forest = Forest.of(ms.sum_("l_quantity", "quantity"), ms.Dispatchor("x", "quantity", dc.many_to_many(spark, "r_name", "grp", GROUPS)))
    return Cube("c", tpch_table(spark, d), Forest.from_yaml(forest.to_yaml())).query("x", group_by="grp")


@query("SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1")
def concealed_forest(spark, d):
    forest = Forest.of(ms.count_rows("n")).concealed("salt")
    name = next(iter(forest.all()))
    return Cube("c", tpch_table(spark, d), forest).query(name, group_by="l_linestatus").withColumnRenamed(name, "n")


# --- names, sources, schemas, streams ------------------------------------------------------------------------------------------


@query("SELECT r_name, n_name, count(*) AS n FROM (SELECT n_regionkey AS regionkey, n_name FROM nation) JOIN (SELECT r_regionkey AS regionkey, r_name FROM region) USING (regionkey) GROUP BY 1, 2")
def join_on_same_name(spark, d):
    nation, region = (spark.read.parquet(f"{d}/{t}.parquet").withColumnRenamed(f"{t[0]}_regionkey", "regionkey") for t in ("nation", "region"))
    return Cube("n", tb.Table(nation).left_join(region, "region", "regionkey"), Forest.of(ms.count_rows("n"))).query("n", group_by=("r_name", "n_name"))


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def aliases_by_function(spark, d):
    t = tb.parquet(spark, f"{d}/lineitem.parquet")
    names = tb.chained({"flag": "x_flag"}, tb.prefixed("x_", ["flag"]) | {"x_flag": "l_returnflag"}, tb.by_function(str.upper, ["l_tax"]))
    return Cube("c", t.with_aliases({"flag": names["flag"]}), Forest.of(ms.count_rows("n"))).query("n", group_by="flag")


@query("SELECT 'none' AS a, 0::BIGINT AS v WHERE false")
def empty_table(spark, d):
    return Cube("e", tb.empty(spark, "a string, v long"), Forest.of(ms.sum_("v"))).query("v", group_by="a")


@query("SELECT a, sum(v)::BIGINT AS v FROM (VALUES ('x', 1), ('x', 2), (NULL, 4)) t(a, v) GROUP BY 1")
def rows_in_memory(spark, d):
    return Cube("m", tb.in_memory(spark, [{"a": "x", "v": 1}, {"a": "x", "v": 2}, {"v": 4}]), Forest.of(ms.sum_("v"))).query("v", group_by="a")


@query("SELECT r_name, n_name, count(*) AS n FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def schema_with_levels(spark, d):
    from tessera.plans.cube import CubeQuery, Schema, levels

    schema = Schema()
    schema.register("places", tb.parquet(spark, f"{d}/nation.parquet").left_join(spark.read.parquet(f"{d}/region.parquet"), "region", [("n_regionkey", "r_regionkey")]))
    schema.register("counts", Forest.of(ms.count_rows("n")))
    schema.open_cube("nations", "places", "counts", tags=frozenset(["geo"]))
    return schema.execute(schema.tagged("geo")[0], CubeQuery(("n",), levels({"geo": ("r_name", "n_name", "n_nationkey")}, "geo", 2)))


@query("SELECT n_name, count(*) AS n FROM nation GROUP BY 1")
def explained_query(spark, d):
    return Cube("n", tb.parquet(spark, f"{d}/nation.parquet"), Forest.of(ms.count_rows("n"))).query("n", group_by="n_name", options=("EXPLAIN", "CONCURRENT", "PARTITIONED", "INDUCE_BY_ENGINE"))


@query("SELECT n_regionkey::BIGINT AS n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def cached_query(spark, d):
    c = Cube("n", tb.parquet(spark, f"{d}/nation.parquet"), Forest.of(ms.count_rows("n")), cache=True)
    c.query("n", group_by="n_regionkey")
    return c.query("n", group_by="n_regionkey", options=("NO_CACHE",))


@query("SELECT event_type, sum(value) AS value, count(*) FILTER (WHERE value > 100) AS high, avg(value) AS mean FROM events GROUP BY 1")
def states_by_window(spark, d):
    from tessera.streaming.incremental import states, values

    kept = [ms.sum_("value"), ms.Aggregator("high", "*", "COUNT", filter=fl.compare("value", ">", 100)), ms.Aggregator("mean", "value", "AVG")]
    return values(states(spark.read.parquet(f"{d}/events.parquet"), kept, ["event_type"], "ts", "1 day"), kept, ["event_type"])


@query("SELECT l_linestatus, l_returnflag, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2 UNION ALL SELECT l_linestatus, 'all but R', sum(l_quantity) FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def calc_coordinate_by_status(spark, d):
    members = tb.CalculatedMembers("l_returnflag", (("all but R", ~fl.where("l_returnflag", "R")),))
    return tpch(spark, d).query("quantity", group_by=("l_linestatus", members))
