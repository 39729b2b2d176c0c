"""The registered queries of the index engine, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridx.functions import binning
from gridx.index import GridIndex
from gridx.operators import build, probe, requests, stats, synth
from gridx.plans import predicates
from gridx.plans.catalog import COMPRESSIONS, IndexSpec
from gridx.sources import datasource, sinks, tables
from gridx.streaming import append

# Bin edges, near the tables' quintiles; dates and timestamps count in days.
EDGES = {
    "l_quantity": [10.0, 21.0, 31.0, 41.0],
    "l_extendedprice": [21754.23, 42519.71, 63287.07, 84203.18],
    "l_discount": [0.02, 0.04, 0.06, 0.08],
    "l_tax": [0.02, 0.03, 0.05, 0.06],
    "o_totalprice": [100359.06, 199953.81, 299788.22, 400334.86],
    "o_custkey": [300.0, 600.0, 900.0, 1200.0],
    "o_orderdate": [9613.0, 10092.0, 10570.0, 11053.0],
    "value": [11.23, 25.71, 45.87, 79.91],
    "user_id": [30.0, 60.0, 90.0, 120.0],
    "p_size": [11.0, 21.0, 30.0, 40.0],
    "p_retailprice": [919.98, 939.96, 959.94, 979.92],
    "c_acctbal": [1224.26, 3469.2, 5720.51, 7827.89],
    "c_nationkey": [4.0, 9.0, 14.0, 19.0],
}
ORDERS = (("o_totalprice", "o_custkey"), ("o_orderdate",))
LINES = (("l_quantity", "l_extendedprice"), ("l_discount", "l_tax"))
ORDERS_QUERY = "o_totalprice >= 150000 and o_totalprice < 420000 and o_custkey < 700 and o_orderdate >= 9800 and o_orderdate < 11200"
LINES_QUERY = "l_quantity >= 15 and l_quantity < 35 and l_extendedprice < 50000 AND l_discount <= 0.04 and l_tax > 0.01"
DAY = "epoch(o_orderdate) / 86400.0"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_index(spark: SparkSession, sf_dir: str) -> GridIndex:
    return GridIndex.over(_table(spark, sf_dir, "orders"), ORDERS, rid="o_orderkey", edges=EDGES)


def lines_with_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.with_row_id(spark, f"{sf_dir}/lineitem.parquet")


def lines_index(spark: SparkSession, sf_dir: str) -> GridIndex:
    return GridIndex.over(lines_with_id(spark, sf_dir), LINES, rid="rid", edges=EDGES)


def _case(value: str, edges: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN {value} < {e!r} THEN {i}" for i, e in enumerate(edges)) + f" ELSE {len(edges)} END"


_B0, _B1, _D = _case("o_totalprice", EDGES["o_totalprice"]), _case("CAST(o_custkey AS DOUBLE)", EDGES["o_custkey"]), _case(DAY, EDGES["o_orderdate"])
_ORDER_BINS = f"SELECT *, {_B0} AS b0, {_B1} AS b1, {_D} AS d0 FROM orders"
_LINE_BINS = "SELECT *, " + ", ".join(f"{_case(c, EDGES[c])} AS q{i}" for i, c in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"))) + " FROM lineitem"


def _box(query_text: str, names: dict[str, str]) -> str:
    """The query's bins as SQL over bin columns."""
    ps = predicates.parse(query_text)
    spans = predicates.rectangle(ps, list(names), EDGES)
    return " AND ".join(f"{b} BETWEEN {low} AND {high - 1}" for b, (low, high) in zip(names.values(), spans, strict=True))


_ORDER_BOX = _box(ORDERS_QUERY, {"o_totalprice": "b0", "o_custkey": "b1", "o_orderdate": "d0"})
_LINE_BOX = _box(LINES_QUERY, {"l_quantity": "q0", "l_extendedprice": "q1", "l_discount": "q2", "l_tax": "q3"})
_SUPERSET = f"SELECT o_orderkey AS rid FROM ({_ORDER_BINS}) WHERE {_ORDER_BOX}"
_ORDERS_WHERE = ORDERS_QUERY.replace("o_orderdate", DAY)


# ------------------------------------------------------------------------------------------------------- binning
@query(f"SELECT o_orderkey, b0, b1, d0 FROM ({_ORDER_BINS})")
def bin_assign_orders(spark, sf_dir):
    df = _table(spark, sf_dir, "orders")
    value = binning.numbers(df, ["o_totalprice", "o_custkey", "o_orderdate"])
    return df.select("o_orderkey", *[binning.bin_of(value[c], EDGES[c]).alias(n) for c, n in zip(value, ("b0", "b1", "d0"), strict=True)])


@query(f"SELECT p_partkey, p_name, p_brand, p_type, {_case('p_size', EDGES['p_size'])} AS p_size, {_case('p_retailprice', EDGES['p_retailprice'])} AS p_retailprice FROM part")
def quantize_part(spark, sf_dir):
    return binning.quantize(_table(spark, sf_dir, "part"), {c: EDGES[c] for c in ("p_size", "p_retailprice")})


def _quantiles(c: str) -> str:
    return ", ".join(f"round(quantile_cont({c}, {i / 5}), 4) AS {c}_{i}" for i in range(1, 5))


@query(f"SELECT {_quantiles('l_extendedprice')}, {_quantiles('l_quantity')} FROM lineitem")
def quantile_edges_lineitem(spark, sf_dir):
    found = binning.quantile_edges(_table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], 5)
    named = {f"{c}_{i}": round(e, 4) for c, edges in found.items() for i, e in enumerate(edges, 1)}
    return spark.createDataFrame([tuple(named.values())], ", ".join(f"{n} double" for n in named))


@query(
    """
WITH f AS (SELECT min(CASE WHEN l_discount > 0 THEN l_discount END) AS n0, min(CASE WHEN l_discount > 0.05 THEN l_discount END) AS n5 FROM lineitem),
r AS (SELECT quantile_cont(l_discount, 0.5) AS m FROM lineitem WHERE l_discount NOT IN (0, 0.05)),
e AS (SELECT list_sort(list_distinct([round(n0 / 2, 6), 0.05, round(0.05 + (n5 - 0.05) / 2, 6), round(m, 6)])) AS x FROM f, r)
SELECT CAST(len(list_filter(x, lambda v: l_discount >= v)) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1
"""
)
def special_value_bins(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem")
    edges = binning.quantile_edges(df, ["l_discount"], 5, {"l_discount": [0.0, 0.05]}, digits=6)["l_discount"]
    return df.groupBy(binning.bin_of(F.col("l_discount"), edges).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey = 0 THEN 0 ELSE pow(2, floor(log2(sqrt(p_partkey)))) END AS BIGINT) AS near FROM part")
def po2_near_sqrt(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", binning.po2_near_sqrt(F.col("p_partkey")).alias("near"))


@query("SELECT p_partkey, substr(sha256(p_name), 1, 10) AS tag FROM part")
def name_digests(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", binning.digest(F.col("p_name")).alias("tag"))


def _space_sql(c: str, edges: list[float], low: float, high: float) -> str:
    full = [low, *edges, high]
    return "CASE " + " ".join(f"WHEN {c} <= {full[i + 1]!r} THEN greatest(0.0, {i} + ({c} - {full[i]!r}) / {full[i + 1] - full[i]!r})" for i in range(len(full) - 1)) + f" ELSE {float(len(full) - 1)} END"


@query(f"SELECT c_custkey, round({_space_sql('c_acctbal', EDGES['c_acctbal'], -1000.0, 10000.0)}, 6) AS place FROM customer")
def quantile_space_customer(spark, sf_dir):
    df = _table(spark, sf_dir, "customer")
    return df.select("c_custkey", F.round(binning.quantile_space(F.col("c_acctbal"), EDGES["c_acctbal"], -1000.0, 10000.0), 6).alias("place"))


# --------------------------------------------------------------------------------------------------------- build
@query(f"SELECT b0, b1, CAST(b0 * 5 + b1 AS BIGINT) AS cell, o_orderkey AS rid FROM ({_ORDER_BINS})")
def postings_orders(spark, sf_dir):
    return orders_index(spark, sf_dir).posts["o_totalprice-o_custkey"]


@query(f"SELECT CAST(b0 * 5 + b1 AS BIGINT) AS cell, count(*) AS cardinality, min(o_orderkey) AS first_rid, max(o_orderkey) AS last_rid, CAST(sum(o_orderkey) AS BIGINT) AS sum_rid FROM ({_ORDER_BINS}) GROUP BY 1")
def posting_lists_orders(spark, sf_dir):
    lists = orders_index(spark, sf_dir).lists("o_totalprice-o_custkey")
    total = F.aggregate("rids", F.lit(0).cast("long"), lambda a, b: a + b)
    parts = lists.select("cell", "cardinality", F.element_at("rids", 1).alias("first_rid"), F.element_at("rids", -1).alias("last_rid"), total.alias("sum_rid"))
    return parts.groupBy("cell").agg(F.sum("cardinality").alias("cardinality"), F.min("first_rid").alias("first_rid"), F.max("last_rid").alias("last_rid"), F.sum("sum_rid").alias("sum_rid"))


@query(
    f"""
WITH g AS (SELECT a.range AS b0, b.range AS b1 FROM range(5) a, range(5) b),
c AS (SELECT q0, q1, count(*) AS n FROM ({_LINE_BINS}) GROUP BY 1, 2)
SELECT CAST(b0 AS INTEGER) AS b0, CAST(b1 AS INTEGER) AS b1, b0 * 5 + b1 AS cell, coalesce(n, 0) AS cardinality FROM g LEFT JOIN c ON q0 = b0 AND q1 = b1
"""
)
def cell_histogram_lineitem(spark, sf_dir):
    spec = IndexSpec(LINES, EDGES)
    return build.histogram(lines_with_id(spark, sf_dir), spec, "l_quantity-l_extendedprice")


@query(f"SELECT CAST(b0 * 5 + b1 AS BIGINT) AS cell, count(*) AS back FROM ({_ORDER_BINS}) GROUP BY b0, b1")
def cell_coordinates_orders(spark, sf_dir):
    cells = orders_index(spark, sf_dir).posts["o_totalprice-o_custkey"]
    bins = binning.coordinates(F.col("cell"), [5, 5])
    return cells.where((bins[0] == F.col("b0")) & (bins[1] == F.col("b1"))).groupBy(binning.cell_of(bins, [5, 5]).alias("cell")).agg(F.count("*").alias("back"))


@query(
    f"""
SELECT 'o_totalprice-o_custkey' AS grp, '5x5' AS shape, CAST(25 AS BIGINT) AS cells, count(*) AS filled, CAST(sum(n) AS BIGINT) AS rows, max(n) AS max_cardinality, round(avg(n), 6) AS mean_cardinality FROM (SELECT count(*) AS n FROM ({_ORDER_BINS}) GROUP BY b0, b1)
UNION ALL SELECT 'o_orderdate', '5', 5, count(*), CAST(sum(n) AS BIGINT), max(n), round(avg(n), 6) FROM (SELECT count(*) AS n FROM ({_ORDER_BINS}) GROUP BY d0)
"""
)
def index_statistics_orders(spark, sf_dir):
    index = orders_index(spark, sf_dir)
    return stats.index_statistics(index.stats, index.spec).withColumn("mean_cardinality", F.round("mean_cardinality", 6))


# --------------------------------------------------------------------------------------------------------- probe
def _probe(name: str, **options) -> None:
    def run(spark, sf_dir):
        return orders_index(spark, sf_dir).ids(ORDERS_QUERY, **options)

    run.__name__ = name
    query(_SUPERSET)(run)


_probe("probe_superset_orders")
_probe("probe_count_orders", strategy="count")
_probe("probe_bitmap_orders", strategy="bitmap")
_probe("probe_expand_orders", strategy="expand", parts=4)
_probe("probe_exclude_orders", exclude=("o_orderdate", "o_totalprice-o_custkey"))
_probe("probe_exclude_count_orders", strategy="count", exclude=("o_orderdate", "o_totalprice-o_custkey"))
_probe("probe_exclude_bitmap_orders", strategy="bitmap", exclude=("o_orderdate", "o_totalprice-o_custkey"))
_probe("probe_exclude_expand_orders", strategy="expand", parts=3, exclude=("o_orderdate", "o_totalprice-o_custkey"))


@query(f"SELECT count(*) AS n FROM ({_SUPERSET})")
def probe_bitmap_total_orders(spark, sf_dir):
    return orders_index(spark, sf_dir).count(ORDERS_QUERY, strategy="bitmap")


@query(
    f"""
SELECT 'o_totalprice-o_custkey' AS grp, count(*) AS postings FROM ({_ORDER_BINS}) WHERE {_box(ORDERS_QUERY, {"o_totalprice": "b0", "o_custkey": "b1"})}
UNION ALL SELECT 'o_orderdate', count(*) FROM ({_ORDER_BINS}) WHERE {_box(ORDERS_QUERY, {"o_orderdate": "d0"})}
"""
)
def read_only_orders(spark, sf_dir):
    index = orders_index(spark, sf_dir)
    return probe.read_only(index.posts, index.plan(ORDERS_QUERY, exclude_above=1.0))


@query("SELECT o_orderkey AS rid FROM orders")
def unselective_orders(spark, sf_dir):
    return orders_index(spark, sf_dir).ids("o_totalprice > -1e9 and o_custkey >= -5")


@query("SELECT o_orderkey AS rid FROM orders WHERE false")
def contradiction_orders(spark, sf_dir):
    return orders_index(spark, sf_dir).ids("o_totalprice > 300000 and o_totalprice < 50000")


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_discount <= 0.04")
def edge_bound_lineitem(spark, sf_dir):
    base = lines_with_id(spark, sf_dir)
    rows = lines_index(spark, sf_dir).rows(base, "l_discount <= 0.04")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query(f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE {_ORDERS_WHERE}")
def refine_exact_orders(spark, sf_dir):
    found = orders_index(spark, sf_dir).rows(_table(spark, sf_dir, "orders"), ORDERS_QUERY)
    return found.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE {LINES_QUERY} GROUP BY 1, 2")
def refine_exact_lineitem(spark, sf_dir):
    rows = lines_index(spark, sf_dir).rows(lines_with_id(spark, sf_dir), LINES_QUERY)
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 450000 OR o_custkey BETWEEN 10 AND 20")
def other_filters_scan_orders(spark, sf_dir):
    return orders_index(spark, sf_dir).rows(_table(spark, sf_dir, "orders"), "o_totalprice > 450000 or o_custkey between 10 and 20").select("o_orderkey")


@query(f"SELECT o_orderkey FROM ({_ORDER_BINS}) WHERE {_ORDER_BOX}")
def enlarged_exact_orders(spark, sf_dir):
    ps = predicates.enlarge(predicates.parse(ORDERS_QUERY), EDGES)
    return orders_index(spark, sf_dir).rows(_table(spark, sf_dir, "orders"), predicates.render(ps)).select("o_orderkey")


# ---------------------------------------------------------------------------------------------------- query texts
@query(
    """
SELECT * FROM (VALUES ('split o_orderdate', 'o_orderdate >= 9800.0 and o_orderdate < 11200.0'), ('split o_totalprice-o_custkey', 'o_totalprice >= 150000.0 and o_totalprice < 420000.0 and o_custkey < 700.0'),
('enlarge', 'o_totalprice >= 100359.06 and o_custkey < 900.0 and o_orderdate >= 9613.0'), ('translate', 'p_size >= 1.0 and p_size < 3.0'), ('select', '((p_size < 11.0) or (p_size >= 30.0 and p_size < 40.0))')) t(what, txt)
"""
)
def query_texts(spark, sf_dir):
    ps = predicates.parse(ORDERS_QUERY)
    parts = predicates.split(ps, {IndexSpec.name_of(g): g for g in ORDERS})
    rows = [(f"split {g}", predicates.render(p)) for g, p in parts.items()]
    short = [p for p in ps if p.text() not in ("o_orderdate < 11200.0",)]
    rows.append(("enlarge", predicates.render(predicates.enlarge([p for p in short if p.value != 420000.0], EDGES))))
    rows.append(("translate", predicates.translate(["p_size >= 12 and p_size < 30"], {"p_size": EDGES["p_size"]}, {"p_size": [1.0, 2.0, 3.0, 4.0]})[0]))
    rows.append(("select", predicates.selection_text({"p_size": [0, 3], "p_retailprice": range(5)}, EDGES)))
    return spark.createDataFrame(rows, "what string, txt string")


# ---------------------------------------------------------------------------------------------------- statistics
@query(
    f"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE {LINES_QUERY}) AS exact_rows, count(*) FILTER (WHERE {_LINE_BOX}) AS index_rows,
  round((count(*) FILTER (WHERE {_LINE_BOX}) - count(*) FILTER (WHERE {LINES_QUERY})) / count(*) FILTER (WHERE {_LINE_BOX}), 9) AS false_positive_rate
FROM ({_LINE_BINS})
"""
)
def fpr_report(spark, sf_dir):
    spec = IndexSpec(LINES, EDGES)
    return stats.selectivity_report(_table(spark, sf_dir, "lineitem"), spec, LINES_QUERY).withColumn("false_positive_rate", F.round("false_positive_rate", 9))


@query(
    f"""
WITH b AS ({_LINE_BINS}), one AS (SELECT 'l_quantity-l_extendedprice' AS grp, q0, q1, {_box(LINES_QUERY, {"l_quantity": "q0", "l_extendedprice": "q1"})} AS hit FROM b
UNION ALL SELECT 'l_discount-l_tax', q2, q3, {_box(LINES_QUERY, {"l_discount": "q2", "l_tax": "q3"})} FROM b)
SELECT grp, count(*) FILTER (WHERE hit) AS selected, count(DISTINCT CASE WHEN hit THEN q0 * 5 + q1 END) AS cells, count(*) AS rows, round(count(*) FILTER (WHERE hit) / count(*), 9) AS share FROM one GROUP BY grp
"""
)
def group_selectivity(spark, sf_dir):
    index = lines_index(spark, sf_dir)
    return stats.group_selectivity(index.stats, index.spec, LINES_QUERY).withColumn("share", F.round("share", 9))


@query(
    f"""
WITH g AS (SELECT a.range AS b0, b.range AS b1 FROM range(5) a, range(5) b), c AS (SELECT q0, q1, count(*) AS n FROM ({_LINE_BINS}) GROUP BY 1, 2),
h AS (SELECT coalesce(n, 0) AS card, count(*) AS f FROM g LEFT JOIN c ON q0 = b0 AND q1 = b1 GROUP BY 1), p AS (SELECT card, f / sum(f) OVER () AS p FROM h)
SELECT round(-sum(p * log2(p)), 9) AS entropy, round(coalesce(sum(p) FILTER (WHERE card = 0), 0.0), 9) AS empty_share FROM p
"""
)
def entropy_cells(spark, sf_dir):
    found = stats.cell_entropy(cell_histogram_lineitem(spark, sf_dir))
    return found.select(F.round("entropy", 9).alias("entropy"), F.round("empty_share", 9).alias("empty_share"))


@query(
    """
SELECT CAST(round_even(sqrt((a.range - 2) * (a.range - 2) + (b.range - 2) * (b.range - 2) + (c.range - 2) * (c.range - 2)), 0) AS BIGINT) AS shell, count(*) AS n
FROM range(5) a, range(5) b, range(5) c GROUP BY 1
"""
)
def shell_counts(spark, sf_dir):
    return stats.shell_counts(spark, 3, 5)


_TASKS = "SELECT user_id % 8 AS worker_id, event_type AS type, CAST(epoch_us(ts) AS BIGINT) AS start_ns, CAST(epoch_us(ts) + floor(value * 1000) AS BIGINT) AS stop_ns FROM events"
_TYPES = ("click", "view", "purchase", "signup", "error")


def _tasks(spark, sf_dir):
    start = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz"))
    return _table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("worker_id"), F.col("event_type").alias("type"), start.alias("start_ns"), (start + F.floor(F.col("value") * 1000)).cast("long").alias("stop_ns"))


@query("SELECT worker_id, " + ", ".join(f"count(*) FILTER (WHERE type = '{t}') AS {t}" for t in _TYPES) + f" FROM ({_TASKS}) GROUP BY 1")
def pivot_task_counts(spark, sf_dir):
    return stats.pivot_tasks(_tasks(spark, sf_dir), _TYPES)


@query("SELECT worker_id, " + ", ".join(f"CAST(coalesce(sum(stop_ns - start_ns) FILTER (WHERE type = '{t}'), 0) AS BIGINT) AS {t}" for t in _TYPES) + f" FROM ({_TASKS}) GROUP BY 1")
def pivot_task_times(spark, sf_dir):
    return stats.pivot_tasks(_tasks(spark, sf_dir), _TYPES, value=F.col("stop_ns") - F.col("start_ns"))


@query(f"SELECT count(DISTINCT worker_id) AS workers, CAST(sum(stop_ns - start_ns) AS BIGINT) AS busy_ns, max(stop_ns) - min(start_ns) AS wall_ns, arg_max(type, stop_ns - start_ns) AS longest_type, round(sum(stop_ns - start_ns) / (count(DISTINCT worker_id) * (max(stop_ns) - min(start_ns))), 9) AS utilisation FROM ({_TASKS})")
def task_utilisation(spark, sf_dir):
    return stats.utilisation(_tasks(spark, sf_dir)).withColumn("utilisation", F.round("utilisation", 9))


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS price_mean, round(stddev_samp(o_totalprice), 4) AS price_std FROM orders GROUP BY 1")
def mean_std_by_group(spark, sf_dir):
    found = stats.mean_std(_table(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_totalprice"])
    return found.select("o_orderpriority", F.round("o_totalprice_mean", 4).alias("price_mean"), F.round("o_totalprice_std", 4).alias("price_std"))


@query("SELECT c_mktsegment, c_nationkey, round(avg(c_acctbal), 6) AS c_acctbal FROM customer GROUP BY 1, 2")
def group_means_customer(spark, sf_dir):
    found = stats.group_mean(_table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], ["c_acctbal"], ["c_acctbal"])
    return found.withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("SELECT o_orderstatus, round(median(o_totalprice), 6) AS o_totalprice FROM orders GROUP BY 1")
def configurable_aggregate(spark, sf_dir):
    return stats.aggregate(_table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice", "median").withColumn("o_totalprice", F.round("o_totalprice", 6))


@query("SELECT o_orderstatus, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(sum(o_totalprice), 2) AS sum, count(o_totalprice) AS count, round(stddev_samp(o_totalprice), 4) AS std FROM orders GROUP BY 1")
def configurable_aggregates(spark, sf_dir):
    """Every aggregate that may be asked for, side by side."""
    df, out = _table(spark, sf_dir, "orders"), None
    for how, digits in (("min", None), ("max", None), ("mean", 4), ("median", 4), ("sum", 2), ("count", None), ("std", 4)):
        one = stats.aggregate(df, ["o_orderstatus"], "o_totalprice", how)
        value = F.col("o_totalprice") if digits is None else F.round("o_totalprice", digits)
        one = one.select("o_orderstatus", value.alias(how))
        out = one if out is None else out.join(one, "o_orderstatus")
    return out


@query("SELECT 'n_name' AS name, count(DISTINCT n_name) AS n_distinct, count(DISTINCT n_name) <= 1 AS constant FROM nation UNION ALL SELECT 'one', 1, true FROM (SELECT 1)")
def constant_columns(spark, sf_dir):
    return stats.constant_columns(_table(spark, sf_dir, "nation").withColumn("one", F.lit(1)), ["n_name", "one"])


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def usage_counts(spark, sf_dir):
    return stats.usage(_table(spark, sf_dir, "lineitem"), "l_returnflag")


@query("SELECT event_type AS key, CAST(sum(user_id) AS BIGINT) AS value FROM events GROUP BY 1")
def summed_maps(spark, sf_dir):
    return stats.summed(_table(spark, sf_dir, "events").select(F.create_map("event_type", "user_id").alias("m")), "m")


@query("SELECT o_custkey, o_orderkey, o_orderkey - coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS delta, o_orderkey AS value FROM orders")
def delta_undelta(spark, sf_dir):
    d = stats.deltas(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_orderkey", "o_orderkey", ["o_custkey"])
    return stats.undeltas(d, "delta", "o_orderkey", ["o_custkey"])


# ------------------------------------------------------------------------------------------------------ requests
@query(
    """
WITH r AS (SELECT l_returnflag AS grp, l_partkey AS start, l_partkey + CAST(l_quantity AS BIGINT) % 7 AS stop FROM lineitem),
o AS (SELECT *, max(stop) OVER (PARTITION BY grp ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE start <> stop),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT grp, min(start) AS start, max(stop) AS stop, count(*) AS n FROM i GROUP BY grp, island
"""
)
def merge_requests_lineitem(spark, sf_dir):
    return _merged_parts(_table(spark, sf_dir, "lineitem"))


def _merged_parts(df: DataFrame) -> DataFrame:
    ranges = df.select(F.col("l_returnflag").alias("grp"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long") % 7).alias("stop"))
    return requests.merge_ranges(ranges)


# ---------------------------------------------------------------------------------------------------- generators
@query(
    f"""
WITH c AS (SELECT q0 * 5 + q1 AS cell, count(*) AS n FROM ({_LINE_BINS}) WHERE q0 BETWEEN 1 AND 3 GROUP BY 1), p AS (SELECT cell, n / sum(n) OVER () AS p FROM c),
h AS (SELECT CAST(cell AS BIGINT) AS cell, sum(p) OVER (ORDER BY cell) AS high FROM p)
SELECT cell, round(coalesce(lag(high) OVER (ORDER BY cell), 0.0), 9) AS low, round(high, 9) AS high FROM h
"""
)
def conditioned_cdf(spark, sf_dir):
    h = cell_histogram_lineitem(spark, sf_dir).where("cardinality > 0").select("cell", F.col("cardinality").cast("double").alias("p"), "b0")
    found = synth.cumulative(synth.conditioned(h, F.col("b0").between(1, 3)))
    return found.select("cell", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("SELECT a.range * 4 + b.range AS cell, c.range * 4 + d.range AS other FROM range(3) a, range(4) b, range(3) c, range(4) d WHERE abs(a.range - c.range) + abs(b.range - d.range) = 1")
def grid_neighbours(spark, sf_dir):
    return synth.grid_neighbours(spark, [3, 4])


def _u(seed: int, *keys: str) -> str:
    """SQL of the generators' random number."""
    return f"((CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))"


@query("SELECT range AS rid, " + ", ".join(f"{_u(1, 'range', repr(str(k)))} * CAST(100 AS DOUBLE) AS {c}" for k, c in enumerate("ABCDEFGHIJ")) + " FROM range(1000000)")
def uniform_table(spark, sf_dir):
    return synth.uniform_table(spark, 1_000_000, 10, seed=1)


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 ORDER BY ln(o_totalprice) - ln(-ln({_u(3, 'o_orderkey')})) DESC, o_orderkey LIMIT 100")
def weighted_top_gumbel(spark, sf_dir):
    return synth.gumbel_top(_table(spark, sf_dir, "orders"), "o_totalprice", 100, "o_orderkey", seed=3).select("o_orderkey", "o_totalprice")


@query(f"SELECT o_orderpriority, o_orderkey FROM orders WHERE o_totalprice > 0 QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY ln({_u(3, 'o_orderkey', 'o_orderpriority')}) / o_totalprice DESC, o_orderkey) <= 5")
def weighted_top_per_group(spark, sf_dir):
    return synth.reservoir_top(_table(spark, sf_dir, "orders"), "o_totalprice", 5, "o_orderkey", 3, by=["o_orderpriority"]).select("o_orderpriority", "o_orderkey")


@query(f"SELECT CAST(row_number() OVER (ORDER BY {_u(4, 'n_nationkey')}, n_nationkey) - 1 AS INTEGER) AS place, n_nationkey FROM nation")
def shuffled_nations(spark, sf_dir):
    rows = synth.shuffled(_table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", 4)
    return spark.createDataFrame([(i, r["n_nationkey"]) for i, r in enumerate(rows.collect())], "place int, n_nationkey " + rows.dtypes[0][1])  # 25 rows


@query(
    f"""
WITH c AS (SELECT q0 * 5 + q1 AS cell, count(*) AS n FROM ({_LINE_BINS}) GROUP BY 1), p AS (SELECT cell, n / sum(n) OVER () AS p FROM c),
h AS (SELECT CAST(cell AS BIGINT) AS cell, coalesce(sum(p) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS low, sum(p) OVER (ORDER BY cell) AS high FROM p),
t AS (SELECT max(high) AS top FROM h), d AS (SELECT o_orderkey, {_u(9, 'o_orderkey', "'cell'")} * top AS draw FROM orders, t)
SELECT o_orderkey, cell FROM d JOIN h ON draw >= low AND draw < high
"""
)
def sampled_cells_orders(spark, sf_dir):
    h = cell_histogram_lineitem(spark, sf_dir).where("cardinality > 0").select("cell", F.col("cardinality").cast("double").alias("p"))
    shares = synth.conditioned(h, F.lit(True)).select("cell", "p")
    return synth.sample_cells(_table(spark, sf_dir, "orders").select("o_orderkey"), shares, "o_orderkey", "cell", 9)


def _grids(spark):
    """Two grids whose regions, the first two of five slices, hold two fifths of a uniform axis."""
    grids, masses = {}, {}
    for g, dims in (("g1", 2), ("g2", 3)):
        p = synth.distribution_table(spark, synth.uniform_marginals(synth.shell_prior(dims, 5, 0.5)))
        inside = synth.conditioned(p, F.col("cell") < 2 * 5 ** (dims - 1))
        masses[g] = round(inside.first()["mass"], 9)
        grids[g] = inside.select("cell", "p")
    return grids, masses | {"g2": 0.6}


_BENCHMARK = "SELECT {share} AS share, CAST(4999 AS BIGINT) AS n, CAST(ceil({share} * 0.4 * 4999) AS BIGINT) AS in_all, CAST(0 AS BIGINT) AS in_none, CAST(0 AS BIGINT) AS outside, CAST(7 AS BIGINT) AS first, CAST(5005 AS BIGINT) AS last, CAST(4999 AS BIGINT) AS ids"


@query(" UNION ALL ".join(_BENCHMARK.format(share=f"CAST({x} AS DOUBLE)") for x in (0.25, 0.5, 1.0)))
def benchmark_rows(spark, sf_dir):
    """Of each generated table: its rows, those in all grids, in none, and outside their region, and its ids."""
    grids, masses = _grids(spark)
    inside = (F.col("g1").isNotNull()).cast("int") + (F.col("g2").isNotNull()).cast("int")
    parts = []
    for share in (0.25, 0.5, 1.0):
        rows = synth.benchmark_rows(spark, grids, masses, 4999, share, seed=2, start=7)
        one = rows.agg(F.count("*").alias("n"), F.count_if(inside == 2).alias("in_all"), F.count_if(inside == 0).alias("in_none"), F.count_if((F.col("g1") >= 10) | (F.col("g2") >= 50)).alias("outside"), F.min("rid").alias("first"), F.max("rid").alias("last"), F.count_distinct("rid").alias("ids"))
        parts.append(one.select(F.lit(share).alias("share"), "*"))
    return tables.appended(parts)


@query("SELECT a.range AS axis, b.range AS place, round(1 / 6.0, 6) AS mass FROM range(3) a, range(6) b")
def uniform_marginals_clusters(spark, sf_dir):
    p = synth.uniform_marginals(synth.cluster_prior(3, 6, [(1, 1, 1), (4, 4, 3)], 1.5))
    cells = synth.distribution_table(spark, p)
    axes = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("axis"), F.pmod(F.floor(F.col("cell") / 6 ** (2 - k)), F.lit(6)).cast("long").alias("place")) for k in range(3)])).alias("x")
    return cells.select("p", axes).groupBy("x.axis", "x.place").agg(F.round(F.sum("p"), 6).alias("mass"))


@query(
    """
WITH c AS (SELECT a.range * 5 + b.range AS cell, CAST(round_even(sqrt((a.range - 2) * (a.range - 2) + (b.range - 2) * (b.range - 2)), 0) AS INTEGER) AS shell FROM range(5) a, range(5) b)
SELECT cell, CASE shell WHEN 0 THEN round(1 / 45.0, 9) WHEN 1 THEN round(1 / 45.0, 9) WHEN 2 THEN round(1 / 15.0, 9) ELSE 0.0 END AS p FROM c
"""
)
def radial_shells(spark, sf_dir):
    """Shells up to 2 of a 5 x 5 grid: three slices, three unknowns, one solution."""
    return synth.radial_distribution(spark, 2, 5, 2).select("cell", F.round("p", 9).alias("p"))


_TRIAL = f"SELECT trial, name, row_number() OVER (PARTITION BY trial ORDER BY {_u(6, 'trial', 'name')}, name) AS rank FROM (SELECT range AS trial FROM range(1000)), (SELECT unnest(['a', 'b', 'c', 'd', 'e']) AS name)"


@query(
    f"""
WITH g AS (SELECT trial, CASE WHEN rank <= 2 THEN 0 WHEN rank <= 4 THEN 1 ELSE 2 END AS grp, string_agg(name, '-' ORDER BY name) AS members, count(*) AS n FROM ({_TRIAL}) GROUP BY 1, 2),
w AS (SELECT trial, string_agg(members, ' ' ORDER BY n DESC, members) AS groups FROM g GROUP BY 1), f AS (SELECT groups, min(trial) AS trial FROM w GROUP BY 1 ORDER BY trial LIMIT 8)
SELECT CAST(row_number() OVER (ORDER BY trial) - 1 AS INTEGER) AS number, groups FROM f
"""
)
def random_partitions(spark, sf_dir):
    found = synth.random_partitions(spark, "abcde", [2, 2, 1], 8, seed=6)
    return found.select("number", F.concat_ws(" ", "groups").alias("groups"))


_BOUNDED = ("l_quantity", "l_extendedprice", "l_discount")


def _terms_sql(c: str) -> str:
    low = f"CAST(floor({_u(5, 'n', repr(c))} * 4) AS INTEGER)"
    edges = f"CAST({EDGES[c]!r} AS DOUBLE[])"
    return f"CASE WHEN {low} > 0 THEN '{c} >= ' || CAST({edges}[{low}] AS VARCHAR) END, CASE WHEN {low} < 3 THEN '{c} < ' || CAST({edges}[{low} + 2] AS VARCHAR) END"


@query(f"SELECT n, concat_ws(' and ', {', '.join(_terms_sql(c) for c in _BOUNDED)}) AS txt FROM (SELECT range AS n FROM range(20))")
def random_range_queries(spark, sf_dir):
    edges = {c: EDGES[c] for c in _BOUNDED}
    return spark.createDataFrame(list(enumerate(synth.random_queries(edges, 0.4, 20, seed=5))), "n long, txt string")


# -------------------------------------------------------------------------------------------------- stored indexes
def _stored(spark, sf_dir, **options) -> tuple[str, GridIndex]:
    path = sinks.scratch(spark, "orders")
    return path, GridIndex.create(_table(spark, sf_dir, "orders"), path, ORDERS, rid="o_orderkey", edges=EDGES, **options)


@query(_SUPERSET)
def stored_probe_orders(spark, sf_dir):
    """An index written, opened again, and probed: the selected bins reach the scan of the posting files."""
    path, _ = _stored(spark, sf_dir)
    return GridIndex.open(spark, path).ids(ORDERS_QUERY)


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE {LINES_QUERY} GROUP BY 1, 2")
def clustered_rows_lineitem(spark, sf_dir):
    """The table in the order of its cells, filtered where it lies."""
    index = GridIndex.create(lines_with_id(spark, sf_dir), sinks.scratch(spark, "lines"), LINES, rid="rid", edges=EDGES, clustered=True)
    rows = index.rows(None, LINES_QUERY)
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(_SUPERSET)
def persisted_probe_orders(spark, sf_dir):
    return orders_index(spark, sf_dir).persist().ids(ORDERS_QUERY)


@query(_SUPERSET)
def plan_json_orders(spark, sf_dir):
    """A plan written as JSON, read back and run."""
    index, path = orders_index(spark, sf_dir), sinks.scratch(spark, "plans")
    sinks.plans(spark, [index.plan(ORDERS_QUERY)], path)
    return index.ids(sinks.read_plans(spark, path)[0])


@query(
    f"""
WITH g AS (SELECT 'o_totalprice-o_custkey' AS grp, count(*) FILTER (WHERE {_box(ORDERS_QUERY, {"o_totalprice": "b0", "o_custkey": "b1"})}) AS selected FROM ({_ORDER_BINS})
UNION ALL SELECT 'o_orderdate', count(*) FILTER (WHERE {_box(ORDERS_QUERY, {"o_orderdate": "d0"})}) FROM ({_ORDER_BINS}))
SELECT CAST(row_number() OVER (ORDER BY selected, grp) AS INTEGER) AS place, grp, selected FROM g
"""
)
def plan_order_orders(spark, sf_dir):
    """The order in which a plan reads the groups, with the rows that their cells select."""
    plan = orders_index(spark, sf_dir).plan(ORDERS_QUERY, exclude_above=1.0)
    return spark.createDataFrame([(i, g.name, g.selected) for i, g in enumerate(plan.groups, 1)], "place int, grp string, selected long")


_probe("probe_product_orders", strategy="expand", parts={"o_totalprice-o_custkey": 3, "o_orderdate": 2}, exclude_above=1.0)
_probe("probe_product_exclude_orders", strategy="expand", parts={"o_totalprice-o_custkey": 3, "o_orderdate": 2}, exclude=("o_orderdate", "o_totalprice-o_custkey"))
_probe("probe_parts_by_cells_orders", strategy="expand", parts=None)


@query("SELECT 'o_totalprice-o_custkey o_orderdate' AS groups, count(*) AS rows, 'o_orderkey' AS rid, 12 AS edges FROM orders")
def stored_configuration_orders(spark, sf_dir):
    path, _ = _stored(spark, sf_dir)
    spec = build.read_spec(spark, path)
    return spark.createDataFrame([(" ".join(spec.names), spec.rows, spec.rid, sum(map(len, spec.edges.values())))], "groups string, rows long, rid string, edges int")


@query(f"SELECT grp, cell, count(*) AS cardinality, min(rid) AS min_rid, max(rid) AS max_rid FROM (SELECT 'o_orderdate' AS grp, CAST(d0 AS BIGINT) AS cell, o_orderkey AS rid FROM ({_ORDER_BINS}) UNION ALL SELECT 'o_totalprice-o_custkey', CAST(b0 * 5 + b1 AS BIGINT), o_orderkey FROM ({_ORDER_BINS})) GROUP BY 1, 2")
def merged_batches_orders(spark, sf_dir):
    """Statistics of an index that grew by two batches, one of them written twice."""
    df, path = _table(spark, sf_dir, "orders"), sinks.scratch(spark, "batches")
    part = F.col("o_orderkey") % 3
    spec = GridIndex.create(df.where(part == 0), path, ORDERS, rid="o_orderkey", edges=EDGES).spec
    for batch in (1, 0, 1):
        build.append(df.where(part == batch + 1), spec, path, batch)
    return GridIndex.open(spark, path).stats.drop("coords")


@query(_SUPERSET)
def streamed_probe_orders(spark, sf_dir):
    """An index that a stream of the table's file has written, probed."""
    df, path = _table(spark, sf_dir, "orders"), sinks.scratch(spark, "stream")
    spec = IndexSpec(ORDERS, {c: EDGES[c] for g in ORDERS for c in g}, "o_orderkey")
    stream = spark.readStream.schema(df.schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    append.append_stream(stream, spec, f"{path}/index", f"{path}/checkpoint").awaitTermination()
    return append.open_stream_index(spark, spec, f"{path}/index").ids(ORDERS_QUERY)


_VALUE, _USER = _case("value", EDGES["value"]), _case("CAST(user_id AS DOUBLE)", EDGES["user_id"])


@query(f"SELECT time_bucket(INTERVAL '6 hours', ts) AS start, CAST({_VALUE} * 5 + {_USER} AS BIGINT) AS cell, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_cells_events(spark, sf_dir):
    spec = IndexSpec((("value", "user_id"),), {c: EDGES[c] for c in ("value", "user_id")}, "event_id")
    found = append.windowed_cells(_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")), spec, "value-user_id", "ts", "6 hours", "1 hour")
    return found.select(F.col("window.start").alias("start"), "cell", "n")


@query(f"SELECT o_orderkey AS rid, CAST(b0 * 5 + b1 AS BIGINT) AS cell, b0 AS o_totalprice, b1 AS o_custkey FROM ({_ORDER_BINS}) WHERE b0 >= 1 AND b1 < 3 AND b0 <> 2")
def data_source_orders(spark, sf_dir):
    path, index = _stored(spark, sf_dir)
    datasource.register(spark)
    rows = spark.read.format("gridx").option("path", path).option("group", "o_totalprice-o_custkey").option("spec", index.spec.to_json()).load()
    return rows.where("o_totalprice >= 1 and o_custkey < 3 and o_totalprice <> 2")


@query("SELECT k AS compression, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders, (SELECT unnest(['copy', 'zstd', 'zstdmore', 'zstdfaster', 'delta', 'delta+zstd', 'snappy']) AS k) GROUP BY 1")
def compressions_orders(spark, sf_dir):
    """Postings stored with every compression and read back."""
    parts = []
    for name in COMPRESSIONS:
        _, index = _stored(spark, sf_dir, compression=name)
        parts.append(index.posts["o_orderdate"].agg(F.count("*").alias("n"), F.sum("rid").alias("total")).select(F.lit(name).alias("compression"), "*"))
    return tables.appended(parts)


_NULLABLE = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS o_custkey, o_orderdate FROM orders"


def _nullable(spark, sf_dir):
    price, customer = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", price.alias("o_totalprice"), customer.alias("o_custkey"), "o_orderdate")


@query(f"SELECT CAST({_B0} * 5 + {_B1} AS BIGINT) AS cell, o_orderkey AS rid FROM ({_NULLABLE}) WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL")
def absent_rows_orders(spark, sf_dir):
    """Stored postings of a grid that leaves rows out."""
    index = GridIndex.create(_nullable(spark, sf_dir), sinks.scratch(spark, "absent"), ORDERS, rid="o_orderkey", edges=EDGES, absent=("o_totalprice-o_custkey",))
    return index.posts["o_totalprice-o_custkey"].select("cell", "rid")


@query(f"SELECT o_orderkey FROM ({_NULLABLE}) WHERE {_ORDERS_WHERE}")
def absent_rows_probe_orders(spark, sf_dir):
    base = _nullable(spark, sf_dir)
    index = GridIndex.over(base, ORDERS, rid="o_orderkey", edges=EDGES, absent=("o_totalprice-o_custkey",))
    return index.rows(base, ORDERS_QUERY, scan_above=None).select("o_orderkey")


def _volumes_sql(grp: str, names: dict[str, str], cells: int) -> str:
    return f"""SELECT '{grp}' AS grp, count(*) AS cells, CAST(sum(n) AS BIGINT) AS ids, CAST(sum(4 * n) AS BIGINT) AS id_bytes, CAST(sum(ceil(4 * n / 4096) * 4096) AS BIGINT) AS page_bytes,
  round(1 - sum(4 * n) / sum(ceil(4 * n / 4096) * 4096), 9) AS padding, round(count(*) / {cells}, 9) AS density FROM (SELECT count(*) AS n FROM ({_ORDER_BINS}) WHERE {_box(ORDERS_QUERY, names)} GROUP BY {', '.join(names.values())})"""


@query(" UNION ALL ".join((_volumes_sql("o_totalprice-o_custkey", {"o_totalprice": "b0", "o_custkey": "b1"}, 12), _volumes_sql("o_orderdate", {"o_orderdate": "d0"}, 4))))
def selected_volumes_orders(spark, sf_dir):
    index = orders_index(spark, sf_dir)
    found = stats.volumes(index.stats, index.spec, ORDERS_QUERY)
    return found.withColumns({"padding": F.round("padding", 9), "density": F.round("density", 9)})


@query(f"SELECT grp, CAST(sum(n) * 4 AS BIGINT) AS id_bytes, CAST(sum(ceil(4 * n / 4096) * 4096) AS BIGINT) AS page_bytes, true AS stored, true AS consistent FROM (SELECT 'o_totalprice-o_custkey' AS grp, count(*) AS n FROM ({_ORDER_BINS}) GROUP BY b0, b1 UNION ALL SELECT 'o_orderdate', count(*) FROM ({_ORDER_BINS}) GROUP BY d0) GROUP BY 1")
def index_sizes_orders(spark, sf_dir):
    """Stored files beside plain lists; their sizes differ by writer, so the query tells whether they agree with the listing."""
    path, index = _stored(spark, sf_dir)
    found = stats.index_sizes(spark, path, index.stats, index.spec)
    saved = F.abs(F.col("saved") - (1 - F.col("bytes") / F.col("page_bytes"))) < 1e-9
    return found.select("grp", "id_bytes", "page_bytes", ((F.col("files") > 0) & (F.col("bytes") > 0)).alias("stored"), saved.alias("consistent"))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total, true AS bounded FROM orders")
def bounded_files_orders(spark, sf_dir):
    """A table written in files of at most 2,000 rows."""
    path = sinks.scratch(spark, "files")
    sinks.parquet(_table(spark, sf_dir, "orders"), path, rows_per_file=2000)
    per_file = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))
    return per_file.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), (F.max("n") <= 2000).alias("bounded"))


@query(f"SELECT 'o_orderdate' AS grp, CAST(d0 AS BIGINT) AS cell, count(*) AS cardinality FROM ({_ORDER_BINS}) GROUP BY 2")
def written_report_orders(spark, sf_dir):
    path = sinks.scratch(spark, "report")
    sinks.report(orders_index(spark, sf_dir).stats.where("grp = 'o_orderdate'").select("grp", "cell", "cardinality"), path)
    return spark.read.schema("grp string, cell long, cardinality long").json(path)


# ------------------------------------------------------------------------------------------------------- sources
@query("SELECT count(*) AS n, CAST(min(r) AS BIGINT) AS low, CAST(max(r) AS BIGINT) AS high, CAST(sum(r) AS BIGINT) AS total FROM (SELECT row_number() OVER () - 1 AS r FROM lineitem)")
def row_ids_lineitem(spark, sf_dir):
    return lines_with_id(spark, sf_dir).agg(F.count("*").alias("n"), F.min("rid").alias("low"), F.max("rid").alias("high"), F.sum("rid").alias("total"))


@query("SELECT n_nationkey AS key, n_name AS name, CAST(NULL AS DOUBLE) AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, 1.0 FROM region")
def appended_tables(spark, sf_dir):
    a = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    b = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit(1.0).alias("extra"))
    return tables.appended([a, b])


@query("SELECT p_partkey, p_retailprice AS m_u, p_retailprice + 1 AS m_g, p_retailprice + 2 AS m_r, p_retailprice + 3 AS m_i, p_retailprice + 4 AS m_z, CAST(p_size AS BIGINT) AS s_0, CAST(p_size AS BIGINT) * 2 AS s_1 FROM part")
def flattened_vectors(spark, sf_dir):
    df = _table(spark, sf_dir, "part")
    packed = df.select("p_partkey", F.array(*[F.col("p_retailprice") + k for k in range(5)]).alias("m"), F.array(F.col("p_size").cast("long"), F.col("p_size").cast("long") * 2).alias("s"))
    return tables.flattened(packed, {"m": 5, "s": 2})


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(NULL AS DOUBLE) AS missing, n_name FROM nation")
def aligned_columns(spark, sf_dir):
    return tables.aligned(_table(spark, sf_dir, "nation"), {"n_nationkey": "bigint", "missing": "double", "n_name": "string"})


@query("SELECT n.n_name AS run, CAST(n.n_regionkey AS VARCHAR) AS stamp, n.n_nationkey AS n, r.r_name AS statistics FROM nation n LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) r ON n.n_regionkey = r.r_regionkey AND n.n_name >= 'F'")
def matched_results(spark, sf_dir):
    """Results with the statistics of the same run and stamp, where there are some."""
    results = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("run"), F.col("n_regionkey").cast("string").alias("stamp"), F.col("n_nationkey").alias("n"))
    regions = _table(spark, sf_dir, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").cast("string").alias("stamp"), F.col("r_name").alias("statistics"))
    statistics = results.where("run >= 'F'").select("run", "stamp").join(regions, "stamp")
    return tables.matched_results(results, statistics)
