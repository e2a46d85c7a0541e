"""Registered queries over the star-schema tables, each with its SQL equivalent.

``QUERIES`` maps a name to a callable (spark, folder); ``ORACLE_SQL`` maps it to SQL
with the same columns.  Averages and other sums of doubles are rounded, since
the order of addition differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .engine import Engine
from .functions.lookup import FunctionRegistry, LookupFunction, filter_inlined, filter_opaque
from .operators import encodings, requests, schedules, snapshots, text_index, vectors
from .operators.aggregates import aggregate, average_or_zero
from .operators.joins import equi_join, filtered_by
from .operators.lineage import scratch
from .operators.predicates import all_of, any_of, compare, inside
from .operators.snapshots import SnapshotStore
from .plans import estimates, statistics
from .plans.join_order import STRATEGIES, leaves
from .plans.planner import Planner, PlanOptions
from .plans.syntax import parse_query
from .sources import text_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            ORACLE_SQL[key] = sql
        return function

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def text_query(text: str, sql: str, name: str, names: list[str], options: PlanOptions | None = None) -> None:
    """Register a query written in the engine's own language; ``names`` are the result's columns."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        catalog = Catalog.of_parquet(spark, sf, TABLES)
        functions = FunctionRegistry()
        functions.register(LookupFunction("nation_name", "nation", "n_nationkey", "n_name"))
        return Planner(catalog, functions).plan(parse_query(text), options).frame.toDF(*names)

    query(sql, name)(run)


# The flagship: global aggregates over a chain of joins with two filters.

_FLAGSHIP = """PROJECT MIN{c.c_name}, MIN{o.o_orderstatus}, COUNT{l.l_orderkey} FROM region AS r
    JOIN nation AS n ON {r.r_regionkey} = {n.n_regionkey} JOIN customer AS c ON {n.n_nationkey} = {c.c_nationkey}
    JOIN orders AS o ON {c.c_custkey} = {o.o_custkey} JOIN lineitem AS l ON {o.o_orderkey} = {l.l_orderkey}
    WHERE {r.r_name} = ASIA AND {o.o_orderstatus} = F"""
_FLAGSHIP_SQL = """SELECT min(c_name) AS first_customer, min(o_orderstatus) AS status, count(l_orderkey) AS n_lines
    FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey
    JOIN lineitem ON o_orderkey = l_orderkey WHERE r_name = 'ASIA' AND o_orderstatus = 'F' HAVING count(*) > 0"""
text_query(_FLAGSHIP, _FLAGSHIP_SQL, "agg_projection_join", ["first_customer", "status", "n_lines"])
text_query(_FLAGSHIP.replace("ASIA", "NOWHERE"), _FLAGSHIP_SQL.replace("ASIA", "NOWHERE"), "agg_empty_input", ["first_customer", "status", "n_lines"])


def _join_order(strategy: str) -> None:
    """The flagship with the tree chosen from ANALYZE's numbers; ``n_tables`` counts the tree's leaves, ``no_worse`` says that
    the tree is estimated at no more rows than the order as written."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        catalog = Catalog.of_parquet(spark, sf, ["region", "nation", "customer", "orders", "lineitem"])
        keys = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus"], "lineitem": ["l_orderkey"]}
        known = {name: statistics.analyze(catalog.table(name).rows(), columns) for name, columns in keys.items()}
        planner, parsed = Planner(catalog), parse_query(_FLAGSHIP)
        chosen, written = (planner.plan(parsed, PlanOptions(join_order=o, statistics=known)) for o in (strategy, "as_written"))
        told = {"n_tables": F.lit(len(leaves(chosen.tree))), "no_worse": F.lit(chosen.cost <= written.cost)}
        return chosen.frame.toDF("first_customer", "status", "n_lines").withColumns(told)

    worse = "" if strategy != "largest_first" else " AND false"  # the strategy that is meant to be bad
    sql = _FLAGSHIP_SQL.replace("AS n_lines", f"AS n_lines, 5 AS n_tables, (true{worse}) AS no_worse")
    query(sql, f"join_order_{strategy}")(run)


for _strategy in STRATEGIES:
    if _strategy != "as_written":
        _join_order(_strategy)


# Scans, projections, predicates.


@query("SELECT c_custkey, c_name FROM customer")
def scan_project(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name")


@query("SELECT c_name AS name_a, c_custkey, c_name AS name_b FROM customer")
def project_duplicates(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_name").alias("name_a"), "c_custkey", F.col("c_name").alias("name_b"))


text_query("{*} FROM nation WHERE n_regionkey = 1", "SELECT * FROM nation WHERE n_regionkey = 1", "select_all_eq", ["n_nationkey", "n_name", "n_regionkey"])
text_query("PROJECT {c_name}, {c_acctbal} FROM customer WHERE {c_mktsegment} = BUILDING", "SELECT c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'", "project_single_table", ["c_name", "c_acctbal"])

_SIX = {"EQ": "=", "NE": "<>", "GT": ">", "GE": ">=", "LT": "<", "LE": "<="}


@query(" UNION ALL ".join(f"SELECT '{k}' AS op, count(*) AS n FROM part WHERE p_size {v} 25" for k, v in _SIX.items()))
def pred_six_ops(spark, sf):
    part = table(spark, sf, "part")
    counts = part.agg(*(F.count(F.when(compare(F.col("p_size"), k, F.lit(25)), 1)).alias(k) for k in _SIX))  # one scan
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("op"), F.col(k).alias("n")) for k in _SIX))).alias("r")).select("r.op", "r.n")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 45 AND l_returnflag = 'R') OR (l_discount >= 0.09 AND l_linestatus = 'O' AND l_tax < 0.02)")
def pred_and_or(spark, sf):
    c = F.col
    first = all_of(c("l_quantity") > 45, c("l_returnflag") == "R")
    second = all_of(c("l_discount") >= 0.09, c("l_linestatus") == "O", c("l_tax") < 0.02)
    return table(spark, sf, "lineitem").filter(any_of(first, second)).select("l_orderkey", "l_linenumber")


@query("SELECT (SELECT count(*) FROM region) AS all_of_none, CAST(0 AS BIGINT) AS any_of_none")
def pred_empty_lists(spark, sf):
    region = table(spark, sf, "region")
    return region.agg(F.count(F.when(all_of(), 1)).alias("all_of_none"), F.count(F.when(any_of(), 1)).alias("any_of_none"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20")
def range_exclusive(spark, sf):
    return table(spark, sf, "lineitem").filter(inside(F.col("l_quantity"), 10, 20)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def range_inclusive(spark, sf):
    return table(spark, sf, "lineitem").filter(F.col("l_quantity").between(10, 20)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20")
def range_count(spark, sf):
    return table(spark, sf, "lineitem").filter(inside(F.col("l_quantity"), 10, 20)).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_linenumber = 5")
def key_filter_count(spark, sf):
    return table(spark, sf, "lineitem").filter("l_linenumber = 5").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def index_point_lookup(spark, sf):
    return table(spark, sf, "orders").filter("o_orderkey = 77").select("o_orderkey", "o_totalprice")


# Joins.

_JOIN_SQL = "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def _strategy_query(strategy: str) -> None:
    @query(_JOIN_SQL, f"join_{strategy}")
    def run(spark, sf):
        supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
        return equi_join(supplier, nation, F.col("s_nationkey") == F.col("n_nationkey"), strategy).select("s_suppkey", "s_name", "n_name")


for _strategy in ("hash", "merge", "nested_loop", "broadcast"):
    _strategy_query(_strategy)


@query("SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name")
def join_multiway_bushy(spark, sf):
    left = equi_join(table(spark, sf, "region"), table(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    right = equi_join(table(spark, sf, "orders"), table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return equi_join(right, left, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


text_query(
    """PROJECT {cn.n_name}, {c.c_name}, {sn.n_name}, {s.s_name} FROM customer AS c JOIN nation AS cn ON {c.c_nationkey} = {cn.n_nationkey}
    JOIN nation AS sn ON {cn.n_regionkey} = {sn.n_regionkey} JOIN supplier AS s ON {sn.n_nationkey} = {s.s_nationkey} WHERE {cn.n_nationkey} = 3""",
    """SELECT cn.n_name AS customer_nation, c_name, sn.n_name AS supplier_nation, s_name FROM customer JOIN nation cn ON c_nationkey = cn.n_nationkey
    JOIN nation sn ON cn.n_regionkey = sn.n_regionkey JOIN supplier ON sn.n_nationkey = s_nationkey WHERE cn.n_nationkey = 3""",
    "join_self_alias",
    ["customer_nation", "c_name", "supplier_nation", "s_name"],
)
text_query(
    """PROJECT {c.c_custkey}, {s.s_suppkey} FROM customer AS c JOIN nation AS n ON {c.c_nationkey} = {n.n_nationkey}
    JOIN supplier AS s ON {n.n_nationkey} = {s.s_nationkey} WHERE {c.c_custkey} = {s.s_suppkey}""",
    "SELECT c_custkey, s_suppkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON n_nationkey = s_nationkey WHERE c_custkey = s_suppkey",
    "join_column_equality",
    ["c_custkey", "s_suppkey"],
)
text_query(
    "PROJECT {n.n_name}, {r.r_name} FROM nation AS n JOIN region AS r ON {n.n_regionkey} = {r.r_regionkey} ORDER BY {n.n_name}",
    "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY n_name",
    "join_order_by",
    ["n_name", "r_name"],
)


@query("SELECT l_returnflag, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 5 GROUP BY l_returnflag")
def join_lip_semi(spark, sf):
    small = table(spark, sf, "part").filter("p_size < 5").select("p_partkey")
    lines = filtered_by(table(spark, sf, "lineitem").select("l_partkey", "l_returnflag"), "l_partkey", small, "p_partkey")
    return equi_join(lines, small, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


# Aggregation.


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def agg_sum_group(spark, sf):
    return aggregate(table(spark, sf, "orders"), ["o_custkey"], {"total": ("SUM", "o_totalprice")}).withColumn("total", F.round("total", 2))


text_query(
    "SELECT COUNT(l_orderkey) FROM lineitem GROUP BY l_linenumber WHERE l_partkey > 20 and l_partkey < 120",
    "SELECT l_linenumber, count(l_orderkey) AS n FROM lineitem WHERE l_partkey > 20 AND l_partkey < 120 GROUP BY l_linenumber",
    "agg_count_group",
    ["l_linenumber", "n"],
)
text_query("PROJECT SUM{p_size} FROM part GROUP BY {p_brand}", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY p_brand", "agg_sum_grouped_text", ["p_brand", "total"])


@query("SELECT c_mktsegment, min(c_name) AS low, max(c_name) AS high FROM customer GROUP BY c_mktsegment")
def agg_min_max_string(spark, sf):
    return aggregate(table(spark, sf, "customer"), ["c_mktsegment"], {"low": ("MIN", "c_name"), "high": ("MAX", "c_name")})


@query(
    """SELECT l_returnflag, l_linestatus, count(l_orderkey) AS n, round(sum(l_quantity), 2) AS quantity, min(l_extendedprice) AS low, max(l_extendedprice) AS high
    FROM lineitem GROUP BY l_returnflag, l_linestatus"""
)
def agg_multi_key(spark, sf):
    measures = {"n": ("COUNT", "l_orderkey"), "quantity": ("SUM", "l_quantity"), "low": ("MIN", "l_extendedprice"), "high": ("MAX", "l_extendedprice")}
    return aggregate(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], measures).withColumn("quantity", F.round("quantity", 2))


@query("SELECT CAST(sum(p_size) AS BIGINT) AS total, count(*) AS n FROM part WHERE p_retailprice > 950 HAVING count(*) > 0")
def agg_filtered_sum(spark, sf):
    return aggregate(table(spark, sf, "part").filter("p_retailprice > 950"), [], {"total": ("SUM", "p_size"), "n": ("COUNT", "p_partkey")})


@query("SELECT round(coalesce(avg(value), 0), 6) AS average, count(*) AS n_rows FROM events WHERE event_id BETWEEN 100 AND 900")
def agg_avg_range(spark, sf):
    return average_or_zero(table(spark, sf, "events"), F.col("value"), F.col("event_id").between(100, 900))


@query("SELECT k AS key, round(coalesce(avg(l_quantity), 0), 6) AS average, count(l_quantity) AS n_rows FROM (VALUES (3), (-1)) t(k) LEFT JOIN lineitem ON l_suppkey = k GROUP BY k")
def agg_avg_key(spark, sf):
    """A key that has rows, and one that has none."""
    lines = table(spark, sf, "lineitem")
    found = [average_or_zero(lines, F.col("l_quantity"), F.col("l_suppkey") == k).withColumn("key", F.lit(k)) for k in (3, -1)]
    return found[0].unionByName(found[1])


@query("SELECT l_partkey, round(sum(l_quantity), 2) AS quantity, round(sum(l_quantity * l_extendedprice), 0) AS revenue FROM lineitem WHERE l_partkey = 7 GROUP BY l_partkey")
def agg_revenue(spark, sf):
    lines = table(spark, sf, "lineitem").filter("l_partkey = 7")
    return lines.groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), 0).alias("revenue"))


@query("SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag")
def agg_by_date(spark, sf):
    lines = table(spark, sf, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return lines.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("revenue"))


@query("SELECT event_type, string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) AS users, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 1")
def social_top_post(spark, sf):
    users = F.array_join(F.array_sort(F.collect_set(F.col("user_id").cast("string"))), ",")
    return table(spark, sf, "events").groupBy("event_type").agg(users.alias("users"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(1)


# Sorting and top-k.


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey")
def sort_single(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", "s_acctbal").orderBy("s_acctbal", "s_suppkey")


@query("SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size, p_partkey")
def sort_multi(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_brand", "p_size").orderBy("p_brand", "p_size", "p_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5")
def sample_limit(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(5)


_MCV = "SELECT value, n, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS rank FROM (SELECT l_partkey AS value, count(*) AS n FROM lineitem GROUP BY l_partkey)"


@query(f"SELECT * FROM ({_MCV}) WHERE rank <= 10")
def mcv_topk(spark, sf):
    return statistics.common_values(table(spark, sf, "lineitem"), "l_partkey", 10)


# Statistics and estimates.


@query("SELECT count(*) AS n_rows, count(DISTINCT p_size) AS p_size_ndv, min(p_size) AS p_size_min, max(p_size) AS p_size_max, count(DISTINCT p_brand) AS p_brand_ndv, min(p_brand) AS p_brand_min, max(p_brand) AS p_brand_max FROM part")
def stats_ndv_minmax(spark, sf):
    return statistics.extremes(table(spark, sf, "part"), ["p_size", "p_brand"])


@query(
    """WITH b AS (SELECT min(p_size)::BIGINT lo, max(p_size)::BIGINT hi FROM part), w AS (SELECT lo, hi, (hi - lo + 1 + 6) // 7 width FROM b),
    k AS (SELECT unnest(range(7)) bucket), e AS (SELECT bucket, lo + bucket * width AS low, least(lo + (bucket + 1) * width - 1, hi) AS high FROM k, w WHERE lo + bucket * width <= hi)
    SELECT bucket, low, high, (SELECT count(*) FROM part WHERE p_size BETWEEN low AND high) AS n FROM e"""
)
def hist_equi_width(spark, sf):
    return statistics.equi_width_histogram(table(spark, sf, "part"), "p_size", 7)


@query(
    """WITH s AS (SELECT o_custkey v, row_number() OVER (ORDER BY o_custkey) - 1 i, count(*) OVER () t FROM orders), k AS (SELECT unnest(range(10)) bucket)
    SELECT bucket, min(v) AS low, max(v) AS high, count(*) AS n FROM s JOIN k ON i >= bucket * t // 10 AND i < (bucket + 1) * t // 10 GROUP BY bucket"""
)
def hist_equi_depth(spark, sf):
    return statistics.equi_depth_histogram(table(spark, sf, "orders"), "o_custkey", 10)


def _one_row(spark: SparkSession, **values: float) -> DataFrame:
    return spark.createDataFrame([tuple(float(v) for v in values.values())], [*values])


@query(f"""WITH m AS (SELECT * FROM ({_MCV}) WHERE rank <= 10), t AS (SELECT count(*) r, count(DISTINCT l_partkey) d FROM lineitem)
    SELECT CAST((SELECT n FROM m WHERE rank = 1) AS DOUBLE) AS common, greatest(1.0, (r - (SELECT sum(n) FROM m)) / (d - 10))::DOUBLE AS rare FROM t""")
def est_equality(spark, sf):
    stats = statistics.analyze(table(spark, sf, "lineitem"), ["l_partkey"])
    top = stats.columns["l_partkey"].common[0][0]
    return _one_row(spark, common=estimates.equality(stats, "l_partkey", top), rare=estimates.equality(stats, "l_partkey", -1))


@query("""SELECT count(*)::DOUBLE * (19 - 11 + 1) / (max(p_size) - min(p_size) + 1) AS exclusive, count(*)::DOUBLE * (20 - 10 + 1) / (max(p_size) - min(p_size) + 1) AS inclusive FROM part""")
def est_range(spark, sf):
    stats = statistics.analyze(table(spark, sf, "part"), ["p_size"], 0)
    column = stats.columns["p_size"]
    return _one_row(spark, exclusive=estimates.uniform_range(stats.rows, column, 10, 20), inclusive=estimates.uniform_range(stats.rows, column, 10, 20, True))


@query("SELECT greatest(1.0, (SELECT count(*) FROM orders)::DOUBLE * (SELECT count(*) FROM customer) / greatest((SELECT count(DISTINCT o_custkey) FROM orders), (SELECT count(DISTINCT c_custkey) FROM customer)))::DOUBLE AS rows")
def est_join(spark, sf):
    o = statistics.analyze(table(spark, sf, "orders"), ["o_custkey"], 0)
    c = statistics.analyze(table(spark, sf, "customer"), ["c_custkey"], 0)
    return _one_row(spark, rows=estimates.join(o.rows, c.rows, o.columns["o_custkey"].distinct, c.columns["c_custkey"].distinct))


@query("""WITH e AS (SELECT count(*)::DOUBLE * 9 / (max(p_size) - min(p_size) + 1) est, count(*) FILTER (p_size > 10 AND p_size < 20)::DOUBLE act FROM part)
    SELECT est AS estimate, act AS actual, round(greatest(est / act, act / est), 9) AS q_error FROM e""")
def qerror(spark, sf):
    part = table(spark, sf, "part")
    stats = statistics.analyze(part, ["p_size"], 0)
    estimate = estimates.uniform_range(stats.rows, stats.columns["p_size"], 10, 20)
    actual = part.filter(inside(F.col("p_size"), 10, 20)).count()
    return _one_row(spark, estimate=estimate, actual=actual, q_error=round(estimates.q_error(estimate, actual), 9))


@query("""SELECT 1 AS tables, (SELECT count(*) FROM region) AS actual UNION ALL SELECT 2, (SELECT count(*) FROM region JOIN nation ON r_regionkey = n_regionkey)
    UNION ALL SELECT 3, (SELECT count(*) FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey)""")
def join_prefix_rows(spark, sf):
    region, nation, customer = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    two = equi_join(region, nation, F.col("r_regionkey") == F.col("n_regionkey"))
    three = equi_join(two, customer, F.col("n_nationkey") == F.col("c_nationkey"))
    parts = [f.agg(F.count(F.lit(1)).alias("actual")).select(F.lit(i + 1).alias("tables"), "actual") for i, f in enumerate((region, two, three))]
    return parts[0].union(parts[1]).union(parts[2])


# Lookup functions.

_UDF_SQL = "SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT n_name FROM nation WHERE n_nationkey = 3)"


def _nation_lookup(spark: SparkSession, sf: str):
    catalog = Catalog(spark)
    nation = table(spark, sf, "nation")
    catalog.register("nation", nation)
    return catalog, LookupFunction("nation_name", "nation", "n_nationkey", "n_name"), nation.filter("n_nationkey = 3").first()["n_name"]


@query(_UDF_SQL)
def udf_opaque(spark, sf):
    catalog, function, value = _nation_lookup(spark, sf)
    return filter_opaque(table(spark, sf, "customer"), "c_nationkey", value, function, catalog).select("c_custkey", "c_name")


@query(_UDF_SQL)
def udf_inlined(spark, sf):
    catalog, function, value = _nation_lookup(spark, sf)
    return filter_inlined(table(spark, sf, "customer"), "c_nationkey", value, function, catalog).select("c_custkey", "c_name")


# Changes.


@query("SELECT * FROM region UNION ALL SELECT 99, 'ATLANTIS'")
def dml_insert(spark, sf):
    return snapshots.insert_rows(table(spark, sf, "region"), [(99, "ATLANTIS")])


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey = 4 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_update(spark, sf):
    return snapshots.update_rows(table(spark, sf, "supplier"), {"s_acctbal": 0.0}, "s_nationkey", 4)


@query("SELECT * FROM nation WHERE NOT (n_regionkey = 2)")
def dml_delete(spark, sf):
    return snapshots.delete_rows(table(spark, sf, "nation"), "n_regionkey", 2)


# Schedules, versions, requests: events ordered by event_id stand for operations.


def _schedule(spark: SparkSession, sf: str) -> DataFrame:
    op = F.when(F.col("event_id") % 3 == 0, "WRITE").otherwise("READ")
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 40).alias("txn"), op.alias("op"), F.col("user_id").alias("item"))


def _as_of(spark: SparkSession, sf: str) -> Column:
    """A timestamp at three fifths of the history."""
    return F.lit(table(spark, sf, "events").agg(F.max("event_id")).first()[0] * 6 // 10)


_SCHEDULE_SQL = "SELECT event_id AS seq, event_id % 40 AS txn, CASE WHEN event_id % 3 = 0 THEN 'WRITE' ELSE 'READ' END AS op, user_id AS item FROM events"


@query(f"WITH s AS ({_SCHEDULE_SQL}) SELECT DISTINCT a.txn AS before, b.txn AS after FROM s a JOIN s b ON a.item = b.item AND a.txn <> b.txn AND a.seq < b.seq AND (a.op = 'WRITE' OR b.op = 'WRITE')")
def conflict_edges(spark, sf):
    return schedules.conflict_edges(_schedule(spark, sf))


@query(f"""WITH s AS ({_SCHEDULE_SQL}), w AS (SELECT *, last_value(CASE WHEN op = 'WRITE' THEN txn END IGNORE NULLS) OVER (PARTITION BY item ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS writer FROM s)
    SELECT seq, txn, item, writer FROM w WHERE op = 'READ'""")
def recoverability_readsfrom(spark, sf):
    return schedules.last_writer(_schedule(spark, sf))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events WHERE event_id <= (SELECT max(event_id) * 6 // 10 FROM events)) WHERE r = 1")
def mvcc_snapshot_read(spark, sf):
    versions = table(spark, sf, "events").select("user_id", "event_id", "value")
    return schedules.snapshot_read(versions, "user_id", "event_id", _as_of(spark, sf))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events WHERE event_id <= (SELECT max(event_id) * 6 // 10 FROM events) AND (event_id % 5 <> 0 OR user_id = 3)) WHERE r = 1")
def mvto_read(spark, sf):
    versions = table(spark, sf, "events").select("user_id", "event_id", "value")
    return schedules.snapshot_read(versions, "user_id", "event_id", _as_of(spark, sf), (F.col("event_id") % 5 != 0) | (F.col("user_id") == 3))


@query("""WITH c AS (SELECT user_id, max(event_id) now FROM events GROUP BY user_id), o AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id <= (SELECT max(event_id) * 6 // 10 FROM events) GROUP BY user_id)
    SELECT o.user_id, o.event_id FROM o JOIN c USING (user_id) WHERE o.event_id IS DISTINCT FROM c.now""")
def occ_validation(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id")
    current = events.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    observed = events.filter(F.col("event_id") <= _as_of(spark, sf)).groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return schedules.stale_reads(observed, current, "user_id", "event_id").select("user_id", "event_id")


@query(f"""WITH s AS ({_SCHEDULE_SQL}), r AS (SELECT DISTINCT txn, item FROM s WHERE op = 'READ'), w AS (SELECT DISTINCT txn, item, item * 7 % 50 AS value FROM s WHERE op = 'WRITE')
    SELECT DISTINCT r.txn AS reader, w.txn AS writer FROM r JOIN w ON r.item = w.item AND r.txn <> w.txn AND w.value BETWEEN 10 AND 30""")
def ssi_predicate_edges(spark, sf):
    s = _schedule(spark, sf)
    reads = s.filter("op = 'READ'").select("txn", "item", F.lit(10).alias("low"), F.lit(30).alias("high")).distinct()
    writes = s.filter("op = 'WRITE'").select("txn", "item", (F.col("item") * 7 % 50).alias("value")).distinct()
    return schedules.predicate_edges(reads, writes)


@query("SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS state FROM events GROUP BY user_id")
def kv_append_state(spark, sf):
    return requests.append_state(table(spark, sf, "events"), "user_id", "event_type", "event_id")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) r FROM events) WHERE r = 1")
def at_most_once(spark, sf):
    return requests.at_most_once(table(spark, sf, "events").select("event_id", "user_id", "event_type"), "user_id", "event_type", "event_id")


@query("""WITH v AS (SELECT DISTINCT o_custkey AS k, o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS r FROM orders),
    p AS (SELECT k, r AS now, lead(r) OVER (PARTITION BY k ORDER BY length(r), r) AS nxt FROM v) SELECT DISTINCT k FROM p WHERE nxt IS NOT NULL AND (NOT starts_with(nxt, now) OR nxt = now)""")
def append_prefix_check(spark, sf):
    value = F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(""))
    results = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), value.alias("r")).distinct()
    return requests.broken_append_chains(results, "k", "r")


@query("SELECT user_id, count(event_type) AS answers, count(DISTINCT event_type) AS different, CAST(0 AS BIGINT) AS undecided FROM events GROUP BY user_id")
def history_outcomes(spark, sf):
    return requests.outcome_counts(table(spark, sf, "events"), "user_id", "event_type")


# Text, vectors, space, keys.

_TOKENS = "SELECT doc_id, term, CAST(position AS INTEGER) AS position FROM (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS position FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents))"


@query(f"SELECT term, doc_id, array_to_string(list(position ORDER BY position), ',') AS positions FROM ({_TOKENS}) GROUP BY term, doc_id")
def inv_postings(spark, sf):
    return text_index.postings(table(spark, sf, "documents")).withColumn("positions", F.concat_ws(",", F.col("positions").cast("array<string>")))


@query(f"SELECT DISTINCT doc_id FROM ({_TOKENS}) WHERE term = 'the'")
def inv_lookup(spark, sf):
    return text_index.lookup(table(spark, sf, "documents"), "The")


@query(f"WITH t AS ({_TOKENS}) SELECT DISTINCT a.doc_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.term = 'the' AND b.term = 'was' AND abs(a.position - b.position) <= 3")
def inv_proximity(spark, sf):
    return text_index.proximity(table(spark, sf, "documents"), "the", "was", 3)


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 17)
    SELECT vec_id, round(list_distance(embedding::DOUBLE[], q.v), 6) AS distance FROM embeddings, q ORDER BY list_distance(embedding::DOUBLE[], q.v), vec_id LIMIT 10""")
def knn_exact(spark, sf):
    frame = table(spark, sf, "embeddings")
    target = frame.filter("vec_id = 17").first()["embedding"]
    return vectors.nearest(frame, "vec_id", "embedding", target, 10).withColumn("distance", F.round("distance", 6))


@query("SELECT vec_id FROM embeddings WHERE embedding[1]::DOUBLE BETWEEN -0.1 AND 0.1 AND embedding[2]::DOUBLE BETWEEN 0 AND 0.2")
def spatial_window(spark, sf):
    e = F.col("embedding")
    return vectors.in_rectangle(table(spark, sf, "embeddings"), e[0].cast("double"), e[1].cast("double"), (-0.1, 0.0), (0.1, 0.2)).select("vec_id")


@query("SELECT vec_id FROM embeddings ORDER BY sqrt(pow(embedding[1]::DOUBLE - 0.05, 2) + pow(embedding[2]::DOUBLE + 0.02, 2)), vec_id LIMIT 7")
def spatial_knn(spark, sf):
    points = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("p"))
    return vectors.nearest(points, "vec_id", "p", [0.05, -0.02], 7).select("vec_id")


@query("SELECT vec_id FROM embeddings WHERE " + " AND ".join(f"embedding[{i + 1}]::DOUBLE BETWEEN -0.15 AND 0.2" for i in range(4)))
def nd_range(spark, sf):
    return vectors.in_box(table(spark, sf, "embeddings"), "embedding", [-0.15] * 4, [0.2] * 4).select("vec_id")


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def prefix_lookup(spark, sf):
    return vectors.prefix(table(spark, sf, "customer"), "c_name", "Customer#00000001").select("c_custkey", "c_name")


@query("""WITH k AS (SELECT DISTINCT o_orderkey::DOUBLE k FROM orders), r AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS p, count(*) OVER () t FROM k), s AS (SELECT *, p * 8 // t AS segment FROM r)
    SELECT segment, count(*) AS n, min(k) AS low, max(k) AS high, round(regr_slope(p, k), 6) AS slope, round(regr_intercept(p, k), 3) AS intercept FROM s GROUP BY segment""")
def learned_segments(spark, sf):
    found = encodings.linear_segments(table(spark, sf, "orders"), "o_orderkey", 8)
    return found.withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 3)})


# Encodings.


@query("SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS code FROM part")
def dict_encode(spark, sf):
    return encodings.dictionary_encode(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "p_brand", "code")


@query("SELECT event_id, user_id - coalesce(lag(user_id) OVER (PARTITION BY event_id // 100 ORDER BY event_id), 0) AS delta FROM events")
def delta_encode(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", F.expr("event_id div 100").alias("block"))
    return encodings.delta_encode(events, "user_id", "event_id", ["block"]).select("event_id", "delta")


@query("SELECT event_id, user_id - min(user_id) OVER (PARTITION BY event_id // 100) AS offset, CAST(length(bin(max(user_id) OVER (PARTITION BY event_id // 100) - min(user_id) OVER (PARTITION BY event_id // 100))) AS INTEGER) AS bits FROM events")
def for_encode(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", F.expr("event_id div 100").alias("block"))
    return encodings.frame_of_reference(events, "user_id", ["block"]).select("event_id", "offset", "bits")


@query(
    """WITH RECURSIVE c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), h AS (SELECT list_sort(list(n)) AS l, CAST(0 AS BIGINT) AS bits FROM c
    UNION ALL SELECT list_sort(list_append(l[3:], l[1] + l[2])), CAST(bits + l[1] + l[2] AS BIGINT) FROM h WHERE len(l) > 1)
    SELECT (SELECT count(*) FROM c) AS n_values, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS n_rows, max(bits) AS bits FROM h"""
)
def huffman_code_length(spark, sf):
    """Bits of a column in its Huffman code: the sum of the merged weights."""
    return spark.createDataFrame([encodings.huffman_cost(table(spark, sf, "part"), "p_brand")], "n_values long, n_rows long, bits long")


@query("SELECT user_id, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY user_id HAVING count(*) > 0")
def upsert_sum(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("""WITH b AS (SELECT min(p_size)::BIGINT lo, max(p_size)::BIGINT hi FROM part), w AS (SELECT lo, hi, (hi - lo + 1 + 6) // 7 width FROM b),
    e AS (SELECT lo + k * width AS low, least(lo + (k + 1) * width - 1, hi) AS high FROM (SELECT unnest(range(7)) k), w WHERE lo + k * width <= hi),
    h AS (SELECT low, high, (SELECT count(*) FROM part WHERE p_size BETWEEN low AND high) AS n FROM e)
    SELECT round(sum(n * greatest(0, least(19, high) - greatest(11, low) + 1)::DOUBLE / (high - low + 1)), 6) AS estimate FROM h""")
def est_histogram(spark, sf):
    buckets = [(r["low"], r["high"], r["n"]) for r in statistics.equi_width_histogram(table(spark, sf, "part"), "p_size", 7).collect()]
    return _one_row(spark, estimate=round(estimates.histogram_range(buckets, 10, 20), 6))


_NEAR = "SELECT event_id AS seq, event_id // 40 + event_id % 2 AS txn, CASE WHEN event_id % 3 = 0 THEN 'WRITE' ELSE 'READ' END AS op, user_id AS item FROM events"


@query(f"""WITH RECURSIVE s AS ({_NEAR}), e AS (SELECT DISTINCT a.txn x, b.txn y FROM s a JOIN s b ON a.item = b.item AND a.txn <> b.txn AND a.seq < b.seq AND (a.op = 'WRITE' OR b.op = 'WRITE')),
    r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), c AS (SELECT x FROM r WHERE x = y), up AS (SELECT DISTINCT x AS n FROM r WHERE y IN (SELECT x FROM c)),
    down AS (SELECT DISTINCT y AS n FROM r WHERE x IN (SELECT x FROM c)) SELECT n AS node FROM up WHERE n IN (SELECT n FROM down)""")
def schedule_cycles(spark, sf):
    """Transactions of 40 operations, each interleaved with the next."""
    near = _schedule(spark, sf).withColumn("txn", F.expr("seq div 40 + seq % 2"))
    return schedules.cyclic_nodes(schedules.conflict_steps(near))


@query(f"""WITH s AS ({_SCHEDULE_SQL}), w AS (SELECT *, coalesce(last_value(CASE WHEN op = 'WRITE' THEN txn END IGNORE NULLS) OVER (PARTITION BY item ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS seen FROM s),
    l AS (SELECT *, lag(seen) OVER (PARTITION BY txn, item ORDER BY seq) AS prev FROM w WHERE op = 'READ') SELECT DISTINCT txn, item FROM l WHERE seen <> prev AND seen <> txn""")
def iso_nonrepeatable_reads(spark, sf):
    return schedules.nonrepeatable_reads(_schedule(spark, sf))


_ENDED = """SELECT event_id AS seq, event_id // 50 + event_id % 2 AS txn, CASE WHEN event_id % 3 = 0 THEN 'WRITE' ELSE 'READ' END AS op, user_id AS item FROM events
    UNION ALL SELECT (t + 1) * 50 + 0.5, t, CASE WHEN t % 7 = 3 THEN 'ABORT' ELSE 'COMMIT' END, NULL FROM (SELECT DISTINCT event_id // 50 + event_id % 2 AS t FROM events)"""


def _ended(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions of 50 operations, each interleaved with the next; every seventh aborts."""
    events = table(spark, sf, "events").withColumn("txn", F.expr("event_id div 50 + event_id % 2"))
    op = F.when(F.col("event_id") % 3 == 0, "WRITE").otherwise("READ")
    work = events.select(F.col("event_id").cast("double").alias("seq"), "txn", op.alias("op"), F.col("user_id").alias("item"))
    ends = events.select("txn").distinct().select(((F.col("txn") + 1) * 50 + 0.5).cast("double").alias("seq"), "txn", F.when(F.col("txn") % 7 == 3, "ABORT").otherwise("COMMIT").alias("op"))
    return work.unionByName(ends, allowMissingColumns=True)


_READS_FROM = f"""s AS ({_ENDED}), en AS (SELECT txn, min(seq) AS ended, min(CASE WHEN op = 'COMMIT' THEN seq END) AS committed, min(CASE WHEN op = 'ABORT' THEN seq END) AS aborted FROM s WHERE op IN ('COMMIT', 'ABORT') GROUP BY txn),
    rf AS (SELECT r.seq, r.txn, r.item, arg_max(w.txn, w.seq) AS writer FROM s r JOIN s w ON r.op = 'READ' AND w.op = 'WRITE' AND r.item = w.item AND w.seq < r.seq LEFT JOIN en ON en.txn = w.txn
    WHERE en.aborted IS NULL OR en.aborted > r.seq GROUP BY r.seq, r.txn, r.item)"""


@query(f"""WITH {_READS_FROM} SELECT rf.seq::DOUBLE AS seq, rf.txn, rf.item, writer FROM rf LEFT JOIN en ON en.txn = writer WHERE writer <> rf.txn AND (en.committed IS NULL OR en.committed > rf.seq)""")
def iso_dirty_reads(spark, sf):
    return schedules.dirty_reads(_ended(spark, sf))


@query(f"""WITH {_READS_FROM}, other AS (SELECT rf.*, w.committed AS wc, r.committed AS rc FROM rf LEFT JOIN en w ON w.txn = writer LEFT JOIN en r ON r.txn = rf.txn WHERE writer <> rf.txn)
    SELECT NOT EXISTS (SELECT 1 FROM other WHERE rc IS NOT NULL AND (wc IS NULL OR wc > rc)) AS recoverable, NOT EXISTS (SELECT 1 FROM other WHERE wc IS NULL OR wc > seq) AS cascadeless,
    NOT EXISTS (SELECT 1 FROM s a JOIN s b ON a.op = 'WRITE' AND a.item = b.item AND a.txn <> b.txn AND a.seq < b.seq LEFT JOIN en ON en.txn = a.txn WHERE en.ended IS NULL OR en.ended > b.seq) AS strict""")
def recovery_classes(spark, sf):
    found = schedules.recovery_classes(_ended(spark, sf))
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} boolean" for k in found))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id AS x, event_id % 25 AS y FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
    r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT EXISTS (SELECT 1 FROM r WHERE x = y) AS deadlock, EXISTS (SELECT 1 FROM r WHERE x = y AND x > 1000000) AS ordered_deadlock""")
def deadlock_cycle(spark, sf):
    """Waits between users and a few holders; and waits that all go one way, which cannot deadlock."""
    events = table(spark, sf, "events")
    first = events.agg(F.min("event_type")).first()[0]
    waits = events.filter(F.col("event_type") == first).select(F.col("user_id").alias("before"), (F.col("event_id") % 25).alias("after")).distinct()
    ordered = events.select((F.col("user_id") % 5).alias("before"), (F.col("user_id") % 5 + 1).alias("after")).distinct()
    return spark.createDataFrame([(schedules.has_deadlock(waits), schedules.has_deadlock(ordered))], "deadlock boolean, ordered_deadlock boolean")


@query(f"""WITH s AS ({_SCHEDULE_SQL}), t AS (SELECT txn, min(seq) AS started, max(seq) AS committed FROM s GROUP BY txn), w AS (SELECT DISTINCT txn, item, started, committed FROM s JOIN t USING (txn) WHERE op = 'WRITE')
    SELECT DISTINCT a.txn FROM w a JOIN w b ON a.item = b.item AND a.txn <> b.txn AND b.committed > a.started AND b.committed < a.committed""")
def ssi_first_committer(spark, sf):
    s = _schedule(spark, sf)
    runs = s.groupBy("txn").agg(F.min("seq").alias("started"), F.max("seq").alias("committed"))
    return schedules.first_committer_losers(runs, s.filter("op = 'WRITE'"))


_HALVES = "SELECT event_id AS seq, event_id % 40 AS txn, CASE WHEN event_id % 40 < 10 THEN 'READ' WHEN event_id % 40 >= 30 THEN 'WRITE' WHEN event_id % 3 = 0 THEN 'WRITE' ELSE 'READ' END AS op, user_id AS item FROM events"


@query(f"""WITH s AS ({_HALVES}), e AS (SELECT DISTINCT r.txn AS reader, w.txn AS writer FROM s r JOIN s w ON r.item = w.item AND r.txn <> w.txn AND r.op = 'READ' AND w.op = 'WRITE' AND w.item * 7 % 50 BETWEEN 10 AND 30)
    SELECT DISTINCT writer AS txn FROM e WHERE writer IN (SELECT reader FROM e)""")
def ssi_pivots(spark, sf):
    """All transactions, of which some only read, some only write and the others do both."""
    txn = F.col("event_id") % 40
    op = F.when(txn < 10, "READ").when((txn >= 30) | (F.col("event_id") % 3 == 0), "WRITE").otherwise("READ")
    s = table(spark, sf, "events").select(F.col("event_id").alias("seq"), txn.alias("txn"), op.alias("op"), F.col("user_id").alias("item"))
    reads = s.filter("op = 'READ'").select("txn", "item", F.lit(10).alias("low"), F.lit(30).alias("high")).distinct()
    writes = s.filter("op = 'WRITE'").select("txn", "item", (F.col("item") * 7 % 50).alias("value")).distinct()
    return schedules.dangerous_pivots(schedules.predicate_edges(reads, writes))


@query("""WITH o AS (SELECT event_id AS seq, user_id AS key, event_type AS value, event_id % 7 = 0 AS put FROM events), p AS (SELECT *, count(*) FILTER (put) OVER (PARTITION BY key ORDER BY seq) AS epoch FROM o),
    m AS (SELECT key, max(epoch) AS epoch FROM p GROUP BY key) SELECT key, string_agg(value, '' ORDER BY seq) AS value FROM p JOIN m USING (key, epoch) GROUP BY key""")
def kv_put_append(spark, sf):
    op = F.when(F.col("event_id") % 7 == 0, "PUT").otherwise("APPEND")
    return requests.key_value_state(table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), op.alias("op"), F.col("event_type").alias("value")))


@query("""WITH l AS (SELECT event_id AS lsn, event_id % 40 AS txn, user_id AS item, event_type AS after, 'start' AS before FROM events), w AS (SELECT item, arg_max(after, lsn) AS redone FROM l WHERE txn % 3 <> 0 GROUP BY item)
    SELECT item, coalesce(redone, 'start') AS value FROM (SELECT DISTINCT item FROM l) LEFT JOIN w USING (item)""")
def log_redo_undo(spark, sf):
    events = table(spark, sf, "events")
    writes = events.select(F.col("event_id").alias("lsn"), (F.col("event_id") % 40).alias("txn"), F.lit("WRITE").alias("op"), F.col("user_id").alias("item"), F.lit("start").alias("before"), F.col("event_type").alias("after"))
    ends = spark.range(40).filter("id % 3 != 0").select((F.lit(10**9) + F.col("id")).alias("lsn"), F.col("id").alias("txn"), F.lit("COMMIT").alias("op"))
    return schedules.redo_undo(writes.unionByName(ends, allowMissingColumns=True))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS x, n_regionkey AS y FROM nation UNION SELECT DISTINCT n_regionkey, (n_nationkey * 3) % 25 FROM nation),
    r AS (SELECT 24 AS state, 0 AS distance UNION SELECT e.y, r.distance + 1 FROM r JOIN e ON r.state = e.x WHERE r.distance < 4) SELECT state, min(distance) AS distance FROM r GROUP BY state""")
def state_search(spark, sf):
    nation = table(spark, sf, "nation")
    steps = nation.select(F.col("n_nationkey").alias("state"), F.col("n_regionkey").alias("next")).union(nation.select("n_regionkey", (F.col("n_nationkey") * 3) % 25)).distinct()
    start = spark.createDataFrame([(24,)], "state int")
    return requests.reachable_states(start, steps, 4)


# Statements, snapshots and files: each writes into the shared folder and reads back.


def _engine(spark: SparkSession, sf: str) -> Engine:
    return Engine(spark, Catalog.of_parquet(spark, sf, ["supplier"]), SnapshotStore(spark, scratch(spark, "store")))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 'moved; away' ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey NOT IN (5, 7)
    UNION ALL SELECT 1000001, 'new one', 4, 1.5""")
def dml_statements(spark, sf):
    engine = _engine(spark, sf)
    engine.execute("UPDATE supplier SET s_name = 'moved; away' WHERE s_nationkey = 3; DELETE FROM supplier WHERE s_nationkey = 5")
    engine.execute("BEGIN; DELETE FROM supplier WHERE s_nationkey = 7; SAVEPOINT kept; DELETE FROM supplier WHERE s_nationkey = 9; ROLLBACK TO kept; COMMIT")
    engine.execute("BEGIN; DELETE FROM supplier WHERE s_nationkey = 11; ABORT; INSERT INTO supplier VALUES (1000001, 'new one', 4, 1.5)")
    return engine.execute("{*} FROM supplier").rows


@query("SELECT * FROM supplier")
def image_copy_restore(spark, sf):
    engine = _engine(spark, sf)
    engine.execute("IMAGE COPY; DELETE FROM supplier WHERE s_nationkey = 3; UPDATE supplier SET s_name = lost WHERE s_nationkey = 4")
    engine.restore_image()
    return engine.execute("{*} FROM supplier").rows


@query("SELECT * FROM nation")
def load_bar_text(spark, sf):
    path = scratch(spark, "lines")
    text_files.write_tables(table(spark, sf, "nation"), "nation", path)
    catalog = Catalog(spark)
    catalog.create("nation", [("n_nationkey", "INT"), ("n_name", "STRING"), ("n_regionkey", "INT")])
    text_files.read_tables(spark, path, catalog)
    return catalog.table("nation").rows()


@query("SELECT key, CAST(sum(value) AS BIGINT) AS total FROM (SELECT CAST(o_custkey AS INTEGER) AS key, CAST(o_orderkey AS INTEGER) AS value FROM orders) GROUP BY key")
def load_pairs(spark, sf):
    path = scratch(spark, "pairs")
    table(spark, sf, "orders").select(F.concat_ws("\t ", "o_custkey", "o_orderkey")).write.text(path)
    return text_files.read_pairs(spark, path).groupBy("key").agg(F.sum("value").alias("total"))


@query("SELECT text, count(*) AS n FROM (SELECT replace(replace(p_name, chr(10), ' '), chr(13), ' ') AS text FROM part) GROUP BY text")
def load_documents(spark, sf):
    path = scratch(spark, "documents")
    table(spark, sf, "part").select(F.translate("p_name", "\n\r", "  ")).write.text(path)
    return text_files.read_documents(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_brand, p_size FROM part")
def columnar_file(spark, sf):
    path = scratch(spark, "columns")
    text_files.write_columns(table(spark, sf, "part"), path)
    return spark.read.parquet(path).select("p_partkey", "p_brand", "p_size")
