"""Queries over the driver's tables, one for each operator, with DuckDB SQL that says the same thing naively."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import countdict, numeric, temporal, text, vector
from .functions.custom import Parameter, UserDefinedFunction
from .operators import cleaning, joins, profile
from .plans.features import Feature, FeatureList, point_in_time, request_column
from .plans.jobs import CalendarWindow, CronSchedule, Schedule
from .sources import requests, sinks, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_JOB = Schedule("1h", "5m", "15m")
_DAILY = CronSchedule("30 2 * * *", "UTC", "1h")


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Events with nulls, and a request for each event seven hours later.
def _events(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))


def _event_view(spark: SparkSession, d: str):
    return tables.EventTable(_events(spark, d), "event_id", "ts").get_view()


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", "user_id", temporal.add(F.col("ts"), 7 * 3_600_000_000).alias("POINT_IN_TIME"))


_E = """e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events),
r AS (SELECT event_id, user_id, ts + INTERVAL 7 HOUR AS pit FROM events)"""


def _hits(window: int, offset: int = 0) -> str:
    return f"""WITH {_E},
j AS (SELECT event_id, user_id, floor((epoch(pit) - 300) / 3600) * 3600 + 300 - 900 - {offset} AS w1 FROM r),
h AS (SELECT j.event_id AS rid, e.* FROM j JOIN e ON e.user_id = j.user_id AND epoch(e.ts) >= w1 - {window} AND epoch(e.ts) < w1)"""


def _window_sql(expr: str, window: int, offset: int = 0) -> str:
    return f"{_hits(window, offset)}, a AS (SELECT rid, {expr} AS x FROM h GROUP BY rid) SELECT r.event_id, a.x FROM r LEFT JOIN a ON a.rid = r.event_id"


def _rounded(c: Column) -> Column:
    return F.round(c.cast("double"), 4)


def _computed(request: DataFrame, features: list[Feature], keep: list[str], shape: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    out = FeatureList(features).compute_historical_features(request)
    return out.select(*keep, *[shape(F.col(f.name)).alias(f.name) for f in features])


_STD = "sqrt(CASE WHEN avg(value * value) - avg(value) * avg(value) < 0 THEN 0 ELSE avg(value * value) - avg(value) * avg(value) END)"
_METHODS = {
    "sum": "round(sum(value), 4)", "avg": "round(avg(value), 9)", "min": "round(min(value), 4)", "max": "round(max(value), 4)", "count": "count(*)", "na_count": "CAST(sum((value IS NULL)::INT) AS BIGINT)",
    "std": f"round({_STD}, 4)", "latest": "round(arg_max(coalesce(value, -1e9), (ts, event_id)), 4)",
}


def _add_windows() -> None:
    for method, sql in _METHODS.items():
        def run(spark: SparkSession, d: str, method: str = method) -> DataFrame:
            f = _event_view(spark, d).groupby("user_id").aggregate_over(None if method == "count" else "value", method, ["7d"], ["x"], _JOB)["x"]
            shape = {"count": lambda c: c, "na_count": lambda c: c, "avg": lambda c: F.round(c, 9)}.get(method, _rounded)
            return _computed(_requests(spark, d), [f], ["event_id"], shape)

        out = _window_sql(sql, 7 * 86400)
        query(out.replace("a.x FROM", "CASE WHEN a.x > -1e8 THEN a.x END AS x FROM") if method == "latest" else out, f"window_{method}")(run)


_add_windows()


@query(_window_sql("round(sum(value), 4)", 86400, 4 * 3600))
def window_offset(spark, d):
    return _computed(_requests(spark, d), [_event_view(spark, d).groupby("user_id").aggregate_over("value", "sum", ["24h"], ["x"], _JOB, offset="4h")["x"]], ["event_id"], _rounded)


@query(_window_sql("count(DISTINCT event_type) + max((event_type IS NULL)::INT)", 2 * 86400))
def window_count_distinct(spark, d):
    return _computed(_requests(spark, d), [_event_view(spark, d).groupby("user_id").aggregate_over("event_type", "count_distinct", ["2d"], ["x"], _JOB)["x"]], ["event_id"])


def _dict_sql(value: str) -> str:
    return f"""{_hits(86400)}, c AS (SELECT rid, coalesce(event_type, '__MISSING__') AS k, {value} AS v FROM h GROUP BY rid, k),
a AS (SELECT rid, coalesce(string_agg(k || '=' || printf('%.6f', v::DOUBLE), ';' ORDER BY k) FILTER (v IS NOT NULL), '') AS x FROM c GROUP BY rid)
SELECT r.event_id, a.x FROM r LEFT JOIN a ON a.rid = r.event_id"""


@query(_dict_sql("count(*)"))
def window_count_by_category(spark, d):
    return _computed(_requests(spark, d), [_event_view(spark, d).groupby("user_id", category="event_type").aggregate_over(None, "count", ["24h"], ["x"], _JOB)["x"]], ["event_id"], countdict.to_text)


@query(_dict_sql("round(max(value), 6)"))
def window_max_by_category(spark, d):
    return _computed(_requests(spark, d), [_event_view(spark, d).groupby("user_id", category="event_type").aggregate_over("value", "max", ["24h"], ["x"], _JOB)["x"]], ["event_id"], lambda c: countdict.to_text(F.transform_values(c, lambda k, v: F.round(v, 6))))


@query(f"""{_hits(7 * 86400)}, b AS (SELECT rid, count(*) AS n7, round(sum(value), 4) AS s7 FROM h GROUP BY rid),
j1 AS (SELECT event_id, user_id, floor((epoch(pit) - 300) / 3600) * 3600 + 300 - 900 AS w1 FROM r),
c AS (SELECT j1.event_id AS rid, round(sum(value), 4) AS s1 FROM j1 JOIN e ON e.user_id = j1.user_id AND epoch(e.ts) >= w1 - 86400 AND epoch(e.ts) < w1 GROUP BY j1.event_id)
SELECT r.event_id, coalesce(b.n7, 0) AS n7, b.s7, c.s1, round(c.s1 / nullif(b.s7, 0), 4) AS ratio FROM r LEFT JOIN b ON b.rid = r.event_id LEFT JOIN c ON c.rid = r.event_id""")
def feature_list_fused(spark, d):
    """Several windows and an expression over two of them: one pass of tiles."""
    g = _event_view(spark, d).groupby("user_id")
    s = g.aggregate_over("value", "sum", ["7d", "1d"], ["s7", "s1"], _JOB)
    n = g.aggregate_over(None, "count", ["7d"], ["n7"], _JOB, skip_fill_na=False)["n7"]
    out = FeatureList([n, s, (s["s1"] / s["s7"]).alias("ratio")]).compute_historical_features(_requests(spark, d))
    return out.select("event_id", "n7", *[_rounded(F.col(c)).alias(c) for c in ("s7", "s1", "ratio")])


@query(f"""WITH {_E}, j AS (SELECT event_id, user_id, floor((epoch(pit) - 300) / 3600) * 3600 + 300 - 900 AS w1 FROM r),
a AS (SELECT j.event_id AS rid, arg_max(e.event_id, (e.ts, e.event_id)) AS last FROM j JOIN e ON e.user_id = j.user_id AND epoch(e.ts) < w1 GROUP BY j.event_id)
SELECT r.event_id, round(e.value, 4) AS x FROM r LEFT JOIN a ON a.rid = r.event_id LEFT JOIN e ON e.event_id = a.last""")
def latest_ever(spark, d):
    return _computed(_requests(spark, d), [_event_view(spark, d).groupby("user_id").aggregate_over("value", "latest", [None], ["x"], _JOB)["x"]], ["event_id"], _rounded)


def _forward_sql(expr: str, window: int, offset: int = 0) -> str:
    return f"""WITH {_E}, a AS (SELECT r.event_id AS rid, {expr} AS x FROM r JOIN e ON e.user_id = r.user_id
AND floor(epoch(e.ts)) > floor(epoch(pit)) + {offset} AND floor(epoch(e.ts)) <= floor(epoch(pit)) + {offset + window} GROUP BY r.event_id)
SELECT r.event_id, a.x FROM r LEFT JOIN a ON a.rid = r.event_id"""


@query(_forward_sql("round(sum(value), 4)", 86400))
def forward_sum(spark, d):
    return _computed(_requests(spark, d), [_event_view(spark, d).groupby("user_id").forward_aggregate("value", "sum", "24h", "x")], ["event_id"], _rounded)


@query(_forward_sql("round(stddev_samp(value), 4)", 86400, 12 * 3600))
def forward_std_offset(spark, d):
    return _computed(_requests(spark, d), [_event_view(spark, d).groupby("user_id").forward_aggregate("value", "std", "24h", "x", offset="12h")], ["event_id"], _rounded)


@query(f"""WITH {_E}, j AS (SELECT event_id, user_id, CAST(date_trunc('day', CASE WHEN pit > date_trunc('day', pit) + INTERVAL 150 MINUTE THEN date_trunc('day', pit) + INTERVAL 150 MINUTE ELSE date_trunc('day', pit) - INTERVAL 1 DAY + INTERVAL 150 MINUTE END - INTERVAL 1 HOUR) AS TIMESTAMP) AS until FROM r),
a AS (SELECT j.event_id AS rid, round(sum(value), 4) AS x FROM j JOIN e ON e.user_id = j.user_id AND e.ts >= until - INTERVAL 7 DAY AND e.ts < until GROUP BY j.event_id)
SELECT r.event_id, a.x FROM r LEFT JOIN a ON a.rid = r.event_id""")
def calendar_days_sum(spark, d):
    return _computed(_requests(spark, d), [_event_view(spark, d).groupby("user_id").aggregate_over("value", "sum", [CalendarWindow("DAY", 7)], ["x"], _DAILY)["x"]], ["event_id"], _rounded)


_O = "o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderstatus FROM orders), q AS (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 3 DAY AS pit FROM orders)"


def _order_view(spark, d):
    return tables.EventTable(load(spark, d, "orders"), "o_orderkey", "o_orderdate").get_view()


def _order_requests(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_custkey", temporal.add(F.col("o_orderdate"), 3 * 86_400_000_000).alias("POINT_IN_TIME"))


@query(f"""WITH {_O}, j AS (SELECT *, CASE WHEN pit > date_trunc('day', pit) + INTERVAL 150 MINUTE THEN date_trunc('day', pit) + INTERVAL 150 MINUTE ELSE date_trunc('day', pit) - INTERVAL 1 DAY + INTERVAL 150 MINUTE END - INTERVAL 1 HOUR AS t FROM q),
k AS (SELECT *, CAST(date_trunc('month', t) AS TIMESTAMP) AS until FROM j),
a AS (SELECT k.o_orderkey AS rid, count(*) AS x FROM k JOIN o ON o.o_custkey = k.o_custkey AND o.o_orderdate >= until - INTERVAL 12 MONTH AND o.o_orderdate < until GROUP BY k.o_orderkey)
SELECT q.o_orderkey, coalesce(a.x, 0) AS x FROM q LEFT JOIN a ON a.rid = q.o_orderkey""")
def calendar_months_count(spark, d):
    return _computed(_order_requests(spark, d), [_order_view(spark, d).groupby("o_custkey").aggregate_over(None, "count", [CalendarWindow("MONTH", 12)], ["x"], _DAILY, skip_fill_na=False)["x"]], ["o_orderkey"])


_H = "h AS (SELECT o_custkey, o_orderdate AS eff, min(o_orderstatus) AS status, min(o_totalprice) AS price FROM orders GROUP BY 1, 2)"


def _history(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey", F.col("o_orderdate").alias("eff")).agg(F.min("o_orderstatus").alias("status"), F.min("o_totalprice").alias("price"))


def _scd(spark, d):
    return tables.SCDTable(_history(spark, d), "o_custkey", "eff")


@query(f"WITH {_O}, {_H} SELECT q.o_orderkey, h.status, h.price FROM q ASOF LEFT JOIN h ON q.o_custkey = h.o_custkey AND q.pit >= h.eff")
def scd_lookup(spark, d):
    fs = _scd(spark, d).get_view().as_features(["status", "price"], ["status", "price"])
    return _computed(_order_requests(spark, d), list(fs), ["o_orderkey"])


@query(f"WITH {_O}, {_H} SELECT q.o_orderkey, h.status FROM q ASOF LEFT JOIN h ON q.o_custkey = h.o_custkey AND q.pit - INTERVAL 30 DAY >= h.eff")
def scd_lookup_offset(spark, d):
    return _computed(_order_requests(spark, d), [_scd(spark, d).get_view()["status"].as_feature("status", offset="30d")], ["o_orderkey"])


@query(f"WITH {_O}, {_H} SELECT q.o_orderkey, h.price FROM q ASOF LEFT JOIN h ON q.o_custkey = h.o_custkey AND q.pit + INTERVAL 30 DAY >= h.eff")
def lookup_target(spark, d):
    return _computed(_order_requests(spark, d), [_scd(spark, d).get_view()["price"].as_target("price", offset="30d")], ["o_orderkey"])


@query(f"WITH {_H} SELECT o.o_orderkey, h.price AS past_price, h.status AS past_status FROM orders o ASOF LEFT JOIN h ON o.o_custkey = h.o_custkey AND o.o_orderdate > h.eff")
def asof_join_strict(spark, d):
    return joins.asof_join(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), _history(spark, d), ["o_custkey"], ["o_custkey"], F.col("o_orderdate"), F.col("eff"), {"price": "past_price", "status": "past_status"}, exact=False).select("o_orderkey", "past_price", "past_status")


@query(f"""WITH {_H}, g AS (SELECT *, eff + INTERVAL 40 DAY AS till FROM h), m AS (SELECT o.o_orderkey, o.o_orderdate, g.price, g.till FROM orders o ASOF LEFT JOIN g ON o.o_custkey = g.o_custkey AND o.o_orderdate > g.eff)
SELECT o_orderkey, CASE WHEN o_orderdate < till THEN price END AS price FROM m""")
def asof_join_end_time(spark, d):
    """Rows of the history are valid for 40 days; time lines are cut into quarters."""
    h = _history(spark, d).withColumn("till", temporal.add(F.col("eff"), 40 * 86_400_000_000))
    return joins.asof_join(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), h, ["o_custkey"], ["o_custkey"], F.col("o_orderdate"), F.col("eff"), {"price": "price"}, exact=False, end_ts=F.col("till"), period=90 * 86400).select("o_orderkey", "price")


@query(f"WITH {_H} SELECT o.o_orderkey, o.o_totalprice, h.status AS status_then FROM orders o ASOF LEFT JOIN h ON o.o_custkey = h.o_custkey AND o.o_orderdate >= h.eff")
def view_join_history(spark, d):
    v = _order_view(spark, d)[["o_custkey", "o_totalprice"]]
    return v.join(_scd(spark, d).get_view(), on="o_custkey", rsuffix="_then").df.select("o_orderkey", "o_totalprice", "status_then")


@query(f"""WITH {_H}, l AS (SELECT *, lag(status) OVER w AS past, row_number() OVER w AS n FROM h WINDOW w AS (PARTITION BY o_custkey ORDER BY eff)),
c AS (SELECT * FROM l WHERE n = 1 OR status IS DISTINCT FROM past)
SELECT o_custkey, CAST(epoch(eff) AS BIGINT) AS new_at, status AS new_status, CAST(epoch(lag(eff) OVER w) AS BIGINT) AS past_at, lag(status) OVER w AS past_status FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY eff)""")
def change_view(spark, d):
    v = _scd(spark, d).get_change_view("status").df
    return v.select("o_custkey", temporal.epoch(F.col("new_eff")).alias("new_at"), "new_status", temporal.epoch(F.col("past_eff")).alias("past_at"), "past_status")


_AT = f"""{_H}, v AS (SELECT *, lead(eff) OVER (PARTITION BY o_custkey ORDER BY eff) AS till FROM h),
q AS (SELECT DISTINCT o_orderstatus AS status, o_orderdate + INTERVAL 3 DAY AS pit FROM orders)"""


def _status_requests(spark, d):
    return load(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), temporal.add(F.col("o_orderdate"), 3 * 86_400_000_000).alias("POINT_IN_TIME")).distinct()


def _at_sql(expr: str, name: str, shift: str) -> str:
    return f"""WITH {_AT} SELECT q.status, CAST(epoch(q.pit) AS BIGINT) AS at, {expr} AS {name} FROM q LEFT JOIN v ON v.status = q.status AND v.eff <= q.pit {shift} AND (v.till IS NULL OR v.till > q.pit {shift}) GROUP BY q.status, q.pit"""


def _at(spark, d, feature, shape=lambda c: c):
    out = FeatureList([feature]).compute_historical_features(_status_requests(spark, d))
    return out.select("status", temporal.epoch(F.col("POINT_IN_TIME")).alias("at"), shape(F.col(feature.name)).alias(feature.name))


@query(_at_sql("count(v.eff)", "n", "- INTERVAL 7 DAY"))
def asat_count(spark, d):
    """Running sums of what begins and ends, not rows valid at each point."""
    return _at(spark, d, _scd(spark, d).get_view().groupby("status").aggregate_asat(None, "count", "n", offset="7d", skip_fill_na=False))


@query(_at_sql("round(avg(v.price), 7)", "mean_price", ""))
def asat_avg(spark, d):
    return _at(spark, d, _scd(spark, d).get_view().groupby("status").aggregate_asat("price", "avg", "mean_price"), lambda c: F.round(c, 7))


@query(_at_sql("max(v.price)", "most", ""))
def asat_max(spark, d):
    return _at(spark, d, _scd(spark, d).get_view().groupby("status").aggregate_asat("price", "max", "most"))


@query(_at_sql("round(sum(v.price), 2)", "total", "+ INTERVAL 7 DAY"))
def forward_asat_sum(spark, d):
    return _at(spark, d, _scd(spark, d).get_view().groupby("status").forward_aggregate_asat("price", "sum", "total", offset="7d"), lambda c: F.round(c, 2))


# Items: lines of orders.
def _items(spark, d):
    lines = load(spark, d, "lineitem").withColumn("line_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return tables.ItemTable(lines, "line_id", "l_orderkey", tables.EventTable(load(spark, d, "orders"), "o_orderkey", "o_orderdate"))


@query("SELECT o.o_orderkey, count(l.l_orderkey) AS n, round(sum(l.l_quantity), 4) AS quantity FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey")
def item_aggregate(spark, d):
    g = _items(spark, d).get_view().groupby("l_orderkey", serving_names=["o_orderkey"])
    fs = [g.aggregate(None, "count", "n", skip_fill_na=False), g.aggregate("l_quantity", "sum", "quantity")]
    out = FeatureList(fs).compute_historical_features(_order_requests(spark, d))
    return out.select("o_orderkey", "n", F.round("quantity", 4).alias("quantity"))


@query("WITH c AS (SELECT l_orderkey, l_returnflag AS k, count(*) AS v FROM lineitem GROUP BY 1, 2) SELECT o.o_orderkey, string_agg(k || '=' || printf('%.6f', v::DOUBLE), ';' ORDER BY k) AS flags FROM orders o LEFT JOIN c ON c.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey")
def item_aggregate_by_category(spark, d):
    f = _items(spark, d).get_view().groupby("l_orderkey", category="l_returnflag", serving_names=["o_orderkey"]).aggregate(None, "count", "flags")
    return _computed(_order_requests(spark, d), [f], ["o_orderkey"], countdict.to_text)


@query("SELECT o.o_orderkey, o.o_totalprice, max(l.l_extendedprice) AS dearest FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL")
def add_feature(spark, d):
    v = _order_view(spark, d)
    v.add_feature("dearest", _items(spark, d).get_view().groupby("l_orderkey").aggregate("l_extendedprice", "max", "dearest"))
    return v.df.select("o_orderkey", "o_totalprice", "dearest")


@query("SELECT l.l_orderkey, l.l_linenumber, o.o_orderpriority AS o_orderpriority_event, CAST(epoch(o.o_orderdate) AS BIGINT) AS at FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey")
def item_event_attributes(spark, d):
    v = _items(spark, d).get_view().join_event_table_attributes(["o_orderpriority"], "_event")
    return v.df.select("l_orderkey", "l_linenumber", "o_orderpriority_event", temporal.epoch(F.col("o_orderdate")).alias("at"))


@query("SELECT o.o_orderkey, c.c_mktsegment AS segment, c.c_acctbal AS balance FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey")
def dimension_lookup(spark, d):
    v = tables.DimensionTable(load(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").get_view()
    return _computed(_order_requests(spark, d), list(v.as_features(["c_mktsegment", "c_acctbal"], ["segment", "balance"])), ["o_orderkey"])


@query("SELECT e.event_id, CASE WHEN o.o_orderdate <= e.ts THEN o.o_totalprice END AS price FROM events e LEFT JOIN orders o ON o.o_orderkey = e.event_id")
def event_lookup(spark, d):
    """An event's attribute, null before it has happened."""
    f = _order_view(spark, d)["o_totalprice"].as_feature("price")
    req = load(spark, d, "events").select("event_id", F.col("event_id").alias("o_orderkey"), F.col("ts").alias("POINT_IN_TIME"))
    return _computed(req, [f], ["event_id"])


@query("""WITH s AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT e.event_id, s.n FROM events e LEFT JOIN s ON s.user_id = e.user_id AND s.day = date_trunc('day', e.ts) - INTERVAL 1 DAY""")
def snapshot_lookup(spark, d):
    snaps = load(spark, d, "events").groupBy("user_id", F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    f = tables.SnapshotsTable(snaps, "user_id", "day").get_view()["n"].as_feature("n")
    return _computed(load(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("POINT_IN_TIME")), [f], ["event_id"])


@query("SELECT c.c_custkey, n.n_nationkey, r.r_regionkey FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey")
def parent_lookup(spark, d):
    c = load(spark, d, "customer").select("c_custkey")
    a = load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    b = load(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    return tables.lookup_parents(c, [(a, "c_custkey", "n_nationkey"), (b, "n_nationkey", "r_regionkey")])


@query("WITH u AS (SELECT p_brand, min((p_name, p_partkey)) AS m FROM part GROUP BY p_brand) SELECT p.p_partkey, u.m[1] AS first_name FROM part p LEFT JOIN u ON u.p_brand = p.p_brand")
def dedup_left_join(spark, d):
    p = load(spark, d, "part")
    right = p.select("p_brand", F.col("p_name"), F.col("p_partkey").alias("k"))
    return joins.equi_join(p.select("p_partkey", "p_brand"), right, ["p_brand"], ["p_brand"], {"p_name": "first_name"}).select("p_partkey", "first_name")


@query("SELECT s.s_suppkey, n.n_name AS nation_name FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey")
def view_join_inner(spark, d):
    s = tables.DimensionTable(load(spark, d, "supplier"), "s_suppkey").get_view()
    n = tables.DimensionTable(load(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name")), "n_nationkey").get_view()
    return s.join(n, on="s_nationkey", how="inner", rprefix="nation_").df.select("s_suppkey", "nation_name")


@query("SELECT event_id, lag(value) OVER w AS past, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM (SELECT * FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag(spark, d):
    v = tables.EventTable(load(spark, d, "events"), "event_id", "ts").get_view()
    v["past"] = v["value"].lag("user_id")
    v["gap"] = v["ts"] - v["ts"].lag("user_id")
    return v.df.select("event_id", "past", "gap")


@query(f"""WITH {_E}, l AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM e),
j AS (SELECT event_id, user_id, floor((epoch(pit) - 300) / 3600) * 3600 + 300 - 900 AS w1 FROM r),
a AS (SELECT j.event_id AS rid, round(avg(gap), 3) AS x FROM j JOIN l ON l.user_id = j.user_id AND epoch(l.ts) >= w1 - 86400 AND epoch(l.ts) < w1 GROUP BY j.event_id)
SELECT r.event_id, a.x FROM r LEFT JOIN a ON a.rid = r.event_id""")
def window_avg_gap(spark, d):
    v = _event_view(spark, d)
    v["gap"] = v["ts"] - v["ts"].lag("user_id")
    return _computed(_requests(spark, d), [v.groupby("user_id").aggregate_over("gap", "avg", ["24h"], ["x"], _JOB)["x"]], ["event_id"], lambda c: F.round(c, 3))


# Scalar functions.
@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 4) AS div, CAST(l_orderkey % nullif(l_linenumber - 1, 0) AS BIGINT) AS mod, round(pow(l_quantity, 2), 4) AS pow, abs(l_discount - 0.05) AS abs,
round(sqrt(l_quantity), 6) AS sqrt, CAST(floor(l_extendedprice) AS BIGINT) AS floor, CAST(ceil(l_extendedprice) AS BIGINT) AS ceil, round(ln(l_quantity), 6) AS log, round(exp(l_discount), 6) AS exp,
round(cos(l_tax), 6) AS cos, round(sin(l_tax), 6) AS sin, round(tan(l_tax), 6) AS tan, round(acos(l_tax), 6) AS acos, round(asin(l_tax), 6) AS asin, round(atan(l_tax), 6) AS atan, round(atan2(l_tax, l_discount + 1), 6) AS atan2, CAST(floor(-l_quantity / 7) AS BIGINT) AS int_cast FROM lineitem""")
def math_functions(spark, d):
    v = tables.DimensionTable(load(spark, d, "lineitem"), "l_orderkey").get_view()
    p, q, t, disc = v["l_extendedprice"], v["l_quantity"], v["l_tax"], v["l_discount"]
    r = lambda x, n=6: F.round(x.col, n)
    cols = {"div": r(p / disc, 4), "mod": (v["l_orderkey"] % (v["l_linenumber"] - 1)).col.cast("bigint"), "pow": r(q**2, 4), "abs": (disc - 0.05).abs().col, "sqrt": r(q.sqrt()), "floor": p.floor().col, "ceil": p.ceil().col, "log": r(q.log()), "exp": r(disc.exp())}
    cols |= {n: r(getattr(t, n)()) for n in ("cos", "sin", "tan", "acos", "asin", "atan")} | {"atan2": F.round(numeric.atan2(t.col, (disc + 1).col), 6), "int_cast": ((q / 7) * -1).astype(int).col}
    return v.df.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in cols.items()])


@query("""SELECT event_id, year(ts) AS year, quarter(ts) AS quarter, month(ts) AS month, week(ts) AS week, day(ts) AS day, isodow(ts) - 1 AS dow, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second,
hour(ts + INTERVAL 8 HOUR) AS local_hour, day(ts + INTERVAL 330 MINUTE) AS kolkata_day, epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS micros_of_day, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600e6, 4) AS hours_since, CAST(floor(epoch(ts + INTERVAL 90 MINUTE)) AS BIGINT) AS later FROM events""")
def datetime_functions(spark, d):
    v = tables.EventTable(load(spark, d, "events"), "event_id", "ts").get_view()
    t = v["ts"]
    cols = {n: getattr(t.dt, n).col for n in ("year", "quarter", "month", "week", "day", "hour", "minute", "second")} | {"dow": t.dt.day_of_week.col, "local_hour": t.dt.tz_offset("+08:00").hour.col, "kolkata_day": t.dt.tz_offset("Asia/Kolkata").day.col}
    cols["micros_of_day"] = temporal.micros(t.col) - temporal.micros(temporal.truncate(t.col, "day"))
    cols["hours_since"] = F.round(temporal.difference(t.col, F.lit("2024-01-01").cast("timestamp_ntz"), "hour"), 4)
    cols["later"] = temporal.epoch(temporal.add(t.col, temporal.duration(F.lit(90), "minute")))
    return v.df.select("event_id", *[c.alias(n) for n, c in cols.items()])


@query("SELECT event_id, CAST(user_id * 3600 AS BIGINT) AS seconds, CAST(epoch(make_timestamp(CAST(user_id * 86400000000 AS BIGINT))) AS BIGINT) AS from_epoch, CAST(epoch(strptime(strftime(ts, '%d/%m/%Y %H:%M:%S'), '%d/%m/%Y %H:%M:%S')) AS BIGINT) AS parsed, CAST(floor(epoch(ts)) + 19800 AS BIGINT) AS zipped_local FROM events")
def timestamp_conversions(spark, d):
    e = load(spark, d, "events")
    said = F.date_format("ts", "dd/MM/yyyy HH:mm:ss")
    pair = temporal.zip_zone(F.col("ts"), F.lit("Asia/Kolkata"))
    return e.select("event_id", temporal.duration_in(temporal.duration(F.col("user_id"), "hour"), "second").cast("bigint").alias("seconds"), temporal.epoch(temporal.from_epoch(F.col("user_id") * 86400)).alias("from_epoch"), temporal.epoch(temporal.parse(said, "dd/MM/yyyy HH:mm:ss")).alias("parsed"), temporal.epoch(temporal.unzip_local(pair)).alias("zipped_local"))


@query("""SELECT p_partkey, length(p_name) AS len, lower(p_brand) AS low, upper(p_name) AS up, trim(p_name, 'a ') AS strip, ltrim(p_type, 'S') AS lstrip, rtrim(p_type, 'L') AS rstrip, replace(p_type, 'E', '') AS repl, lpad(p_brand, 12, '*') AS padl, rpad(p_brand, 12, '*') AS padr,
CASE WHEN length(p_brand) >= 12 THEN p_brand ELSE rpad(lpad(p_brand, 12 - CAST(ceil((12 - length(p_brand)) / 2.0) AS INT), '*'), 12, '*') END AS padb, CASE WHEN length(p_type) >= 3 THEN p_type ELSE lpad(p_type, 3, ' ') END AS uncut, contains(p_name, 'a') AS has, contains(lower(p_type), 'st') AS has_any_case, p_name[2:4] AS mid, p_brand || '/' || p_type AS cat FROM part""")
def string_functions(spark, d):
    v = tables.DimensionTable(load(spark, d, "part"), "p_partkey").get_view()
    n, b, t = v["p_name"], v["p_brand"], v["p_type"]
    cols = {"len": n.str.len(), "low": b.str.lower(), "up": n.str.upper(), "strip": n.str.strip("a "), "lstrip": t.str.lstrip("S"), "rstrip": t.str.rstrip("L"), "repl": t.str.replace("E", ""), "padl": b.str.pad(12, "left", "*"), "padr": b.str.pad(12, "right", "*"), "padb": b.str.pad(12, "both", "*"), "uncut": t.str.pad(3), "has": n.str.contains("a"), "has_any_case": t.str.contains("ST", case=False), "mid": n.str[1:4], "cat": b + "/" + t}
    return v.df.select("p_partkey", *[c.col.alias(k) for k, c in cols.items()])


@query("""SELECT event_id, CASE WHEN value > 50 THEN 50.0 ELSE value END AS capped, coalesce(event_type IN ('click', 'view'), false) AS seen, value IS NULL AS missing, coalesce(value, 0) AS filled, NOT (value > 10 AND value < 90) AS outside, CAST(user_id AS VARCHAR) AS text, TRY_CAST(event_type AS DOUBLE) AS number, event_type IS NOT NULL AS is_text
FROM (SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events)""")
def predicates_and_conditions(spark, d):
    v = _event_view(spark, d)
    x, k = v["value"], v["event_type"]
    cols = {"capped": x.where(x > 50, 50.0), "seen": k.isin(["click", "view"]), "missing": x.isnull(), "filled": x.fillna(0.0), "outside": ~((x > 10) & (x < 90)), "text": v["user_id"].astype(str), "number": k.try_astype("float")}
    return v.df.select("event_id", *[c.col.alias(n) for n, c in cols.items()], numeric.is_string(k.col).alias("is_text"))


@query("SELECT event_id, value FROM events WHERE value > 50 AND event_type <> 'view'")
def filter_project(spark, d):
    v = tables.EventTable(load(spark, d, "events"), "event_id", "ts").get_view()
    return v[(v["value"] > 50) & (v["event_type"] != "view")][["value"]].df.select("event_id", "value")


@query(f"""WITH {_E} SELECT event_id, CASE WHEN coalesce(value, -1) < 10 THEN 10 WHEN value > 90 THEN 90 ELSE value END AS value, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS event_type, CASE WHEN user_id IN (1, 2, 3) THEN 0 ELSE user_id END AS user_id FROM e""")
def cleaning_operations(spark, d):
    ops = {"value": [cleaning.MissingValue(10.0), cleaning.ValueBeyond("<", 10.0, 10.0), cleaning.ValueBeyond(">", 90.0, 90.0)], "event_type": [cleaning.UnexpectedValue(("click", "view"), "other")], "user_id": [cleaning.DisguisedValue((1, 2, 3), 0)]}
    ops["event_type"] = [cleaning.UnexpectedValue(("click", "view", "other"), "other")]
    return tables.EventTable(_events(spark, d), "event_id", "ts", cleaning=ops).get_view().df.select("event_id", "value", "event_type", "user_id")


@query("""WITH c AS (SELECT user_id, event_type AS k, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2), t AS (SELECT user_id, sum(v) AS t, count(*) AS n FROM c GROUP BY 1),
b AS (SELECT user_id, min((-v, k))[2] AS top, min((v, k))[2] AS low FROM c GROUP BY 1), g AS (SELECT user_id, v FROM c WHERE k = 'click')
SELECT t.user_id, round(-sum(c.v / t.t * ln(c.v / t.t)), 6) AS entropy, any_value(b.top) AS top, any_value(b.low) AS low, any_value(t.n) AS n, any_value(g.v) AS clicks,
CASE WHEN any_value(g.v) IS NOT NULL THEN 1.0 + sum((c.v < g.v)::INT) END AS rank_up, CASE WHEN any_value(g.v) IS NOT NULL THEN 1.0 + sum((c.v > g.v)::INT) END AS rank_down, round(coalesce(any_value(g.v) / any_value(t.t), 0), 6) AS share,
string_agg(k || '=' || printf('%.6f', c.v / t.t), ';' ORDER BY k) AS normal, string_agg(k || '=' || printf('%.6f', c.v / 4), ';' ORDER BY k) AS quarter
FROM c JOIN t USING (user_id) JOIN b USING (user_id) LEFT JOIN g USING (user_id) GROUP BY t.user_id""")
def count_dictionary_functions(spark, d):
    c = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("v"))
    m = F.col("m")
    f = {"entropy": F.round(countdict.entropy(m), 6), "top": countdict.most_frequent(m), "low": countdict.key_with_lowest_value(m), "n": countdict.unique_count(m), "clicks": countdict.get_value(m, "click"), "rank_up": countdict.get_rank(m, "click"), "rank_down": countdict.get_rank(m, "click", True), "share": F.round(countdict.get_relative_frequency(m, "click"), 6), "normal": countdict.to_text(countdict.normalize(m)), "quarter": countdict.to_text(countdict.divide(m, 4))}
    return c.groupBy("user_id").agg(countdict.from_rows(F.col("event_type"), F.col("v")).alias("m")).select("user_id", *[x.alias(n) for n, x in f.items()])


@query("""WITH c AS (SELECT user_id, event_type AS k, count(*)::DOUBLE AS v, max(value) AS w FROM events GROUP BY 1, 2)
SELECT user_id, round(sum(v * w) / (sqrt(sum(v * v)) * sqrt(sum(w * w))), 6) AS similarity FROM c GROUP BY user_id""")
def count_dictionary_cosine(spark, d):
    c = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("v"), F.max("value").alias("w")).groupBy("user_id").agg(countdict.from_rows(F.col("event_type"), F.col("v")).alias("a"), countdict.from_rows(F.col("event_type"), F.col("w")).alias("b"))
    return c.select("user_id", F.round(countdict.cosine_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_cosine(spark, d):
    e = load(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(vector.cosine_similarity(F.col("embedding"), F.col("other")), 5).alias("similarity"))


def _vector_sql(func: str) -> str:
    return f"WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, i - 1 AS i, round({func}(v), 4) AS v FROM x GROUP BY label, i"


def _vectors(spark, d, method):
    out = vector.elementwise(load(spark, d, "embeddings"), ["label"], "embedding", method, "v")
    return out.select("label", F.posexplode("v").alias("i", "v")).select("label", F.col("i").cast("bigint").alias("i"), F.round("v", 4).alias("v"))


for _m in ("sum", "max", "avg"):
    query(_vector_sql(_m), f"vector_{_m}")(lambda spark, d, m=_m: _vectors(spark, d, m))


@query("""SELECT s.s_suppkey, round(2 * 6371 * asin(sqrt(pow(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin(radians(y - x) / 2), 2))), 3) AS km
FROM (SELECT s_suppkey, (s_suppkey % 90)::DOUBLE AS a, (s_suppkey * 7 % 80)::DOUBLE AS b, (s_nationkey * 7)::DOUBLE AS x, -(s_nationkey * 3)::DOUBLE AS y FROM supplier) s""")
def haversine(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return load(spark, d, "supplier").select("s_suppkey", F.round(numeric.haversine((k % 90).cast("double"), (n * 7).cast("double"), (k * 7 % 80).cast("double"), -(n * 3).cast("double")), 3).alias("km"))


@query("SELECT event_id, CAST(hour(pit) AS BIGINT) AS hour, round(epoch(pit) - epoch(ts), 3) AS waited FROM (SELECT event_id, ts, ts + INTERVAL 7 HOUR AS pit FROM events)")
def request_columns(spark, d):
    req = load(spark, d, "events").select("event_id", "ts", temporal.add(F.col("ts"), 7 * 3_600_000_000).alias("POINT_IN_TIME"))
    pit = point_in_time()
    fs = [pit.dt.hour.alias("hour"), (pit - request_column("ts", "timestamp_ntz")).dt.second.alias("waited")]
    return FeatureList(fs).compute_historical_features(req).select("event_id", F.col("hour").cast("bigint").alias("hour"), F.round("waited", 3).alias("waited"))


@query(f"""{_hits(86400)}, a AS (SELECT rid, count(*) AS n FROM h GROUP BY rid) SELECT DISTINCT e.user_id, coalesce((SELECT count(*) FROM events x WHERE x.user_id = e.user_id AND epoch(x.ts) >= floor((epoch(TIMESTAMP '2024-01-20 12:00:00') - 300) / 3600) * 3600 + 300 - 900 - 604800 AND epoch(x.ts) < floor((epoch(TIMESTAMP '2024-01-20 12:00:00') - 300) / 3600) * 3600 + 300 - 900), 0) AS n FROM events e""")
def online_features(spark, d):
    """All entities as of one time, without points in time of their own."""
    f = _event_view(spark, d).groupby("user_id").aggregate_over(None, "count", ["7d"], ["n"], _JOB, skip_fill_na=False)["n"]
    return FeatureList([f]).compute_online_features(load(spark, d, "events").select("user_id").distinct(), "2024-01-20 12:00:00")


# Exploration.
@query("SELECT event_type AS key, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500")
def value_counts(spark, d):
    return profile.value_counts(load(spark, d, "events"), "event_type")


_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "unique", round(avg(({c} IS NULL)::INT) * 100, 4) AS missing, {m} FROM part"""
    for c, m in {c: f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75" if c in ("p_partkey", "p_size", "p_retailprice") else "NULL, NULL, NULL, NULL, NULL" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")}.items()
)


@query(_DESCRIBE)
def describe(spark, d):
    out = profile.describe(load(spark, d, "part"))
    return out.select("column", "unique", *[F.round(c, 4).alias(c) for c in ("missing", "mean", "std", "p25", "p50", "p75")])


@query("""SELECT event_id, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'valid' ELSE 'test' END AS fold FROM (SELECT event_id, CAST('0x' || substr(md5(event_id || '_7'), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM events)""")
def split(spark, d):
    return profile.split(load(spark, d, "events").select("event_id"), ["event_id"], {"train": 0.6, "valid": 0.2, "test": 0.2}, 7)


@query("""SELECT event_id, event_type, CASE WHEN event_type = 'view' THEN 4.0 ELSE 1.0 END AS row_weight FROM (SELECT event_id, event_type, CAST('0x' || substr(md5(event_id || '_7'), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM events) WHERE u < CASE WHEN event_type = 'view' THEN 0.25 ELSE 1.0 END""")
def down_sampling(spark, d):
    return profile.down_sample(load(spark, d, "events").select("event_id", "event_type"), "event_type", {"view": 0.25}, key=["event_id"], seed=7)


@query("SELECT o_custkey, count(*) FILTER (n > 1) AS duplicates, CAST(sum(a) AS BIGINT) AS active FROM (SELECT o_custkey, o_orderdate, count(*) AS n, sum((o_orderstatus = 'O')::INT) AS a FROM orders GROUP BY 1, 2) GROUP BY 1 HAVING count(*) FILTER (n > 1) > 0 OR sum(a) > 1")
def scd_validation(spark, d):
    return profile.invalid_history(load(spark, d, "orders").withColumn("open", F.col("o_orderstatus") == "O"), "o_custkey", "o_orderdate", "open")


@query("SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS first, CAST(floor(epoch(max(ts))) AS BIGINT) AS last, count(DISTINCT user_id) AS entities, count(*) AS rows, min(gap) AS least_gap FROM (SELECT *, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) AS BIGINT) AS gap FROM events)")
def observation_stats(spark, d):
    out = profile.observation_stats(load(spark, d, "events"), "ts", "user_id")
    return out.select(temporal.epoch(F.col("first")).alias("first"), temporal.epoch(F.col("last")).alias("last"), "entities", "rows", "least_gap")


@query("SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def time_range_scan(spark, d):
    return _order_view(spark, d).between("1995-01-01", "1996-01-01").df.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT e.* EXCLUDE (props, ts) FROM events e WHERE user_id IN (SELECT n_nationkey FROM nation)")
def entity_filter(spark, d):
    return tables.entity_filter(load(spark, d, "events"), load(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("user_id")), ["user_id"]).drop("props", "ts")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 100, 'NOWHERE'")
def merge_sink(spark, d):
    n = load(spark, d, "nation")
    new = n.filter("n_regionkey = 1").select("n_nationkey", F.concat(F.upper("n_name"), F.lit("!")).alias("n_name")).unionByName(spark.createDataFrame([(100, "NOWHERE")], "n_nationkey int, n_name string"))
    return sinks.merged(n.select("n_nationkey", "n_name"), new, ["n_nationkey"])


@query()
def sample(spark, d):
    return profile.sample(load(spark, d, "events"), 100)


@query("SELECT user_id, CAST(floor((epoch(ts) - (300 - 900)) / 3600) AS BIGINT) AS tile, count(*) AS n_rows, round(sum(value), 4) AS sum FROM events GROUP BY 1, 2")
def tiles(spark, d):
    from .streaming import tiles as streaming

    return streaming.tiles(load(spark, d, "events"), ["user_id"], "ts", "value", _JOB).select("user_id", "tile", "n_rows", F.round("sum", 4).alias("sum"))


@query("SELECT user_id, max(event_id) AS last_id FROM events GROUP BY 1")
def latest_features(spark, d):
    return sinks.latest_features(load(spark, d, "events").select("user_id", F.col("event_id").alias("last_id")), ["user_id"], "last_id")


# User-defined and on-demand functions, request tables, offline tables.
@query(f"""{_hits(7 * 86400)}, a AS (SELECT rid, sum(value) AS s FROM h GROUP BY rid)
SELECT r.event_id, round(ln(1 + abs(coalesce(a.s, 0)) * 2), 6) AS x FROM r LEFT JOIN a ON a.rid = r.event_id""")
def user_defined_function_on_feature(spark, d):
    f = UserDefinedFunction(spark, "asofar_scaled_log", [Parameter("x", "double", test=1.0), Parameter("k", "double", default=2.0, test=2.0)], "double", "ln(1 + abs(coalesce(x, 0)) * k)")
    s = _event_view(spark, d).groupby("user_id").aggregate_over("value", "sum", ["7d"], ["s"], _JOB)["s"]
    return _computed(_requests(spark, d), [f(s).alias("x")], ["event_id"], lambda c: F.round(c, 6))


@query("SELECT p_partkey, round(p_retailprice * 0.9 + p_size, 4) AS price, reverse(p_brand) AS code FROM part")
def user_defined_function_on_column(spark, d):
    """One function of our own, one that the session has."""
    price = UserDefinedFunction(spark, "asofar_price", [Parameter("p", "double"), Parameter("size", "double")], "double", "p * 0.9 + size")
    back = UserDefinedFunction(spark, "asofar_back", [Parameter("t", "string")], "string", function="reverse")
    v = tables.DimensionTable(load(spark, d, "part"), "p_partkey").get_view()
    return v.df.select("p_partkey", F.round(price(v["p_retailprice"], size=v["p_size"]).col, 4).alias("price"), back(v["p_brand"]).col.alias("code"))


@query("""WITH w AS (SELECT floor((epoch(TIMESTAMP '2024-01-20 12:00:00') - 300) / 3600) * 3600 + 300 - 900 AS w1),
a AS (SELECT user_id, round(sum(value), 4) AS s, count(*) AS n FROM events, w WHERE epoch(ts) >= w1 - 604800 AND epoch(ts) < w1 GROUP BY user_id)
SELECT e.event_id, round(a.s / nullif(e.event_id % 5, 0), 4) AS per_unit, coalesce(a.n, 0) + hour(e.ts) AS n FROM events e LEFT JOIN a ON a.user_id = e.user_id""")
def on_demand_features(spark, d):
    """Aggregations are stored; expressions with columns of the request are computed when it comes."""
    e = load(spark, d, "events")
    v = tables.EventTable(e, "event_id", "ts").get_view()
    g = v.groupby("user_id")
    s, n = g.aggregate_over("value", "sum", ["7d"], ["s"], _JOB)["s"], g.aggregate_over(None, "count", ["7d"], ["n"], _JOB, skip_fill_na=False)["n"]
    fl = FeatureList([(s / request_column("units", "bigint")).alias("per_unit"), (n + request_column("ts", "timestamp_ntz").dt.hour).alias("n")])
    stored = fl.ingest(e.select("user_id"), "2024-01-20 12:00:00")
    out = fl.serve(stored, e.select("event_id", "user_id", "ts", (F.col("event_id") % 5).alias("units")))
    return out.select("event_id", F.round("per_unit", 4).alias("per_unit"), F.col("n").cast("bigint").alias("n"))


@query(f"""{_hits(7 * 86400)}, a AS (SELECT rid, round(sum(value), 4) AS s, round(max(value), 4) AS m, count(*) AS n FROM h GROUP BY rid)
SELECT r.event_id, a.s, a.m, a.n FROM r LEFT JOIN a ON a.rid = r.event_id""")
def feature_batches(spark, d):
    """A plan for each two features; results meet on the request's row numbers."""
    g = _event_view(spark, d).groupby("user_id")
    fs = [g.aggregate_over("value", "sum", ["7d"], ["s"], _JOB)["s"], g.aggregate_over("value", "max", ["7d"], ["m"], _JOB)["m"], g.aggregate_over(None, "count", ["7d"], ["n"], _JOB)["n"]]
    out = FeatureList(fs).compute_in_batches(_requests(spark, d), sinks.workspace(spark, "batches"), 2)
    return out.select("event_id", _rounded(F.col("s")).alias("s"), _rounded(F.col("m")).alias("m"), "n")


@query("""SELECT event_id, hour(ts + INTERVAL 36 HOUR + INTERVAL 9 HOUR) AS local_hour, round(36.0 / 24, 6) AS days, CAST(floor((epoch(ts + INTERVAL 45 HOUR) / 86400 + 3) / 7) AS BIGINT) AS week,
isodow(ts + INTERVAL 45 HOUR) - 1 AS weekday FROM events""")
def forecast_point_features(spark, d):
    """Forecast points as texts in UTC, read in a column's time zone."""
    e = load(spark, d, "events").withColumn("FORECAST_POINT", temporal.formatted(temporal.add(F.col("ts"), 36 * 3_600_000_000), "yyyy/MM/dd HH:mm:ss.SSSSSS")).withColumn("zone", F.lit("Asia/Tokyo"))
    p = requests.ForecastPoint("WEEK", fmt="yyyy/MM/dd HH:mm:ss.SSSSSS", timezone_column="zone")
    fs = [p.local().dt.hour.alias("local_hour"), p.until("day").alias("days"), p.index().alias("week"), p.local().dt.day_of_week.alias("weekday")]
    out = FeatureList(fs).compute_historical_features(e.withColumnRenamed("ts", "POINT_IN_TIME"))
    return out.select("event_id", F.col("local_hour").cast("bigint").alias("local_hour"), F.round("days", 6).alias("days"), "week", F.col("weekday").cast("bigint").alias("weekday"))


_OBS = """o AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_type = 'view' THEN 4.0 ELSE 1.0 END AS row_weight FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'
AND CAST('0x' || substr(md5(event_id || '_1234'), 1, 8) AS BIGINT) / 4294967296.0 < CASE WHEN event_type = 'view' THEN 0.25 ELSE 1.0 END)"""


def _observations(spark, d):
    return requests.observation_table(load(spark, d, "events"), ["user_id"], "ts", "2024-01-05", "2024-01-20", ["event_id"], "event_type", {"view": 0.25}, ["event_id"])


@query(f"WITH {_OBS} SELECT event_id, user_id, event_type, row_weight, CAST(epoch_us(ts) AS BIGINT) AS at FROM o")
def observation_table(spark, d):
    return _observations(spark, d).df.select("event_id", "user_id", "event_type", "row_weight", temporal.micros(F.col("POINT_IN_TIME")).alias("at"))


@query(f"""WITH {_OBS} SELECT CAST(epoch_us(min(ts)) AS BIGINT) AS first, CAST(epoch_us(max(ts)) AS BIGINT) AS last, count(*) AS rows, min(gap) AS least_gap, count(DISTINCT user_id) AS n_user_id
FROM (SELECT *, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) AS BIGINT) AS gap FROM o)""")
def observation_table_stats(spark, d):
    s = _observations(spark, d).stats
    return s.select(temporal.micros(F.col("first")).alias("first"), temporal.micros(F.col("last")).alias("last"), "rows", "least_gap", "n_user_id")


def _daily_counts(spark, d):
    f = _event_view(spark, d).groupby("user_id").aggregate_over(None, "count", ["7d"], ["n"], _JOB, skip_fill_na=False)["n"]
    asked = requests.batch_request_table(load(spark, d, "events"), ["user_id"])
    return lambda at: FeatureList([f]).compute_online_features(asked, at)


def _counts_sql(at: str) -> str:
    end = f"floor((epoch(TIMESTAMP '{at}') - 300) / 3600) * 3600 + 300 - 900"
    return f"SELECT u.user_id, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN events e ON e.user_id = u.user_id AND epoch(e.ts) >= {end} - 604800 AND epoch(e.ts) < {end} GROUP BY u.user_id"


@query(f"SELECT '2024-01-10' AS snapshot, * FROM ({_counts_sql('2024-01-10 12:00:00')}) UNION ALL SELECT '2024-01-20', * FROM ({_counts_sql('2024-01-20 12:00:00')})")
def batch_feature_table(spark, d):
    """Overwritten by a first snapshot, then appended to; a snapshot that is run again is not doubled."""
    counts, path = _daily_counts(spark, d), sinks.workspace(spark, "batch")
    sinks.write_batch(counts("2024-01-01 12:00:00"), path, "2024-01-01", "overwrite")
    sinks.write_batch(counts("2024-01-10 12:00:00"), path, "2024-01-10", "overwrite")
    for _ in range(2):
        out = sinks.write_batch(counts("2024-01-20 12:00:00"), path, "2024-01-20")
    return out.select(F.col("snapshot").cast("string").alias("snapshot"), "user_id", "n")


@query(f"""SELECT '2024-01-10 12:00:00' AS at, a.user_id, a.n, CAST(NULL AS BIGINT) AS twice FROM ({_counts_sql('2024-01-10 12:00:00')}) a
UNION ALL SELECT '2024-01-20 12:00:00', a.user_id, a.n, 2 * a.n FROM ({_counts_sql('2024-01-20 12:00:00')}) a""")
def offline_feature_table(spark, d):
    """Appended twice at one time, which counts once, and a column added for the later time."""
    counts = _daily_counts(spark, d)
    t = sinks.OfflineTable(spark, sinks.workspace(spark, "offline"), ["user_id"])
    for at in ("2024-01-10 12:00:00", "2024-01-20 12:00:00", "2024-01-20 12:00:00"):
        t.append(counts(at), at)
    new = counts("2024-01-20 12:00:00").select("user_id", (2 * F.col("n")).alias("twice"), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz").alias("feature_timestamp"))
    t.add_columns(new)
    return t.read().select(temporal.formatted(F.col("feature_timestamp"), "yyyy-MM-dd HH:mm:ss").alias("at"), "user_id", "n", "twice")


@query("SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-20 06:00:00'")
def entity_universe(spark, d):
    g = _event_view(spark, d).groupby("user_id")
    fs = [g.aggregate_over("value", "sum", ["7d"], ["s"], _JOB)["s"], g.aggregate_over(None, "count", ["1d"], ["n"], _JOB)["n"]]
    return requests.entity_universe(fs, "2024-01-20", "2024-01-20 06:00:00")


@query("SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-10 04:00:00' AND value > 50")
def development_dataset(spark, d):
    """A table declared over all events, features of which are explored on a part of them."""
    t = tables.EventTable(_events(spark, d), "event_id", "ts").developed(load(spark, d, "events").filter("value > 50").drop("props"))
    f = t.get_view().groupby("user_id").aggregate_over("value", "sum", ["7d"], ["s"], _JOB)["s"]
    return requests.entity_universe([f], "2024-01-10", "2024-01-10 04:00:00")


@query("SELECT o_orderkey, strftime(o_orderdate - INTERVAL 3 MONTH, '%Y/%m/%d %H') AS quarter_before, strftime(o_orderdate + INTERVAL 1 MONTH, '%d.%m.%Y') AS month_after, CAST(epoch(date_trunc('month', o_orderdate)) AS BIGINT) AS month_start FROM orders")
def timestamp_arithmetic(spark, d):
    t = F.col("o_orderdate")
    return load(spark, d, "orders").select("o_orderkey", temporal.formatted(temporal.add_months(t, -3), "yyyy/MM/dd HH").alias("quarter_before"), temporal.formatted(temporal.add_months(t, 1), "dd.MM.yyyy").alias("month_after"), temporal.epoch(temporal.truncate(t, "month")).alias("month_start"))


_SERIES = "s AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2), q AS (SELECT event_id, user_id, ts FROM events)"


def _series(spark, d):
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day")
    return load(spark, d, "events").groupBy("user_id", day).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


_UNTIL = "CAST(date_trunc('day', CASE WHEN q.ts > date_trunc('day', q.ts) + INTERVAL 150 MINUTE THEN date_trunc('day', q.ts) + INTERVAL 150 MINUTE ELSE date_trunc('day', q.ts) - INTERVAL 1 DAY + INTERVAL 150 MINUTE END - INTERVAL 1 HOUR) AS TIMESTAMP)"


@query(f"""WITH {_SERIES}, u AS (SELECT *, {_UNTIL} AS until FROM q),
a AS (SELECT u.event_id, round(avg(s.total), 4) AS x FROM u JOIN s ON s.user_id = u.user_id AND s.day >= until - INTERVAL 3 DAY AND s.day < until GROUP BY 1) SELECT q.event_id, a.x FROM q LEFT JOIN a USING (event_id)""")
def time_series_window(spark, d):
    g = tables.TimeSeriesTable(_series(spark, d), "user_id", "day").get_view().groupby("user_id")
    req = load(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("POINT_IN_TIME"))
    return _computed(req, [g.aggregate_over("total", "avg", [CalendarWindow("DAY", 3)], ["x"], _DAILY)["x"]], ["event_id"], _rounded)


@query(f"""WITH {_SERIES}, u AS (SELECT *, {_UNTIL} AS until FROM q),
a AS (SELECT u.event_id, max(s.n) AS x FROM u JOIN s ON s.user_id = u.user_id AND s.day >= until - INTERVAL 6 DAY AND s.day < until - INTERVAL 1 DAY GROUP BY 1) SELECT q.event_id, a.x FROM q LEFT JOIN a USING (event_id)""")
def snapshots_window_offset(spark, d):
    g = tables.SnapshotsTable(_series(spark, d), "user_id", "day").get_view().groupby("user_id")
    req = load(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("POINT_IN_TIME"))
    return _computed(req, [g.aggregate_over("n", "max", [CalendarWindow("DAY", 5)], ["x"], _DAILY, offset=CalendarWindow("DAY", 1))["x"]], ["event_id"])


@query(f"""WITH {_E}, c AS (SELECT user_id, coalesce(event_type, '__MISSING__') AS k, count(*) AS v FROM e GROUP BY 1, 2)
SELECT user_id, count(*) AS all_keys, count(*) FILTER (k <> '__MISSING__') AS keys, max(v)::DOUBLE AS most FROM c GROUP BY user_id""")
def dictionary_missing_key(spark, d):
    c = _events(spark, d).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("v")).groupBy("user_id").agg(countdict.from_rows(F.col("event_type"), F.col("v")).alias("m"))
    m = F.col("m")
    return c.select("user_id", countdict.unique_count(m).alias("all_keys"), countdict.unique_count(m, False).alias("keys"), countdict.highest_value(m).alias("most"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS number, CASE WHEN event_id % 3 = 0 THEN '-1' ELSE CAST(user_id AS VARCHAR) END AS told, CAST(floor(epoch(ts)) AS BIGINT) - 9 * 3600 AS at FROM events""")
def cleaning_casts(spark, d):
    """Texts that aren't numbers, texts as numbers, and texts in a zone as timestamps."""
    e = load(spark, d, "events")
    said = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("user_id").cast("string"))
    raw = e.select("event_id", "ts", said.alias("number"), said.alias("told"), temporal.formatted(F.col("ts"), "dd.MM.yyyy HH:mm:ss").alias("at"))
    ops = {"number": [cleaning.CastToNumeric()], "told": [cleaning.StringValue("-1")], "at": [cleaning.ParseTimestamp("dd.MM.yyyy HH:mm:ss", "Asia/Tokyo")]}
    v = tables.EventTable(raw, "event_id", "ts", cleaning=ops).get_view()
    return v.df.select("event_id", "number", "told", temporal.epoch(F.col("at")).alias("at"))


@query("""WITH v AS (SELECT vec_id % 40 AS k, vec_id, embedding, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * CAST(vec_id % 97 AS INT) AS ts FROM embeddings), q AS (SELECT DISTINCT k FROM v),
x AS (SELECT k, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM v WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-04')
SELECT q.k, i - 1 AS i, round(max(x), 4) AS v FROM q JOIN x USING (k) GROUP BY 1, 2""")
def vector_window_max(spark, d):
    """Vectors within a window, element by element."""
    e = load(spark, d, "embeddings").select((F.col("vec_id") % 40).alias("k"), "vec_id", "embedding", temporal.add(F.lit("2024-01-01").cast("timestamp_ntz"), (F.col("vec_id") % 97) * 3_600_000_000).alias("ts"))
    f = tables.EventTable(e, "vec_id", "ts").get_view().groupby("k").aggregate_over("embedding", "max", ["2d"], ["v"], Schedule("1h"))["v"]
    out = FeatureList([f]).compute_historical_features(e.select("k").distinct().withColumn("POINT_IN_TIME", F.lit("2024-01-04").cast("timestamp_ntz")))
    return out.select("k", F.posexplode("v").alias("i", "v")).select("k", F.col("i").cast("bigint").alias("i"), F.round("v", 4).alias("v"))


@query("SELECT o_custkey, status, price FROM (SELECT *, lead(eff) OVER (PARTITION BY o_custkey ORDER BY eff) AS till FROM (SELECT o_custkey, o_orderdate AS eff, min(o_orderstatus) AS status, min(o_totalprice) AS price FROM orders GROUP BY 1, 2)) WHERE till IS NULL")
def current_rows(spark, d):
    return _scd(spark, d).current().select("o_custkey", "status", "price")


@query("SELECT n_nationkey AS key, n_name AS info_name, r_name AS info_region_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def flattened_structs(spark, d):
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return tables.flattened(n.select(F.col("n_nationkey").alias("key"), F.struct(F.col("n_name").alias("name"), F.struct(F.col("r_name").alias("name")).alias("region")).alias("info")))


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-02-26' AND '1995-04-03'")
def partition_filter(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", temporal.formatted(F.col("o_orderdate"), "yyyy-MM-dd").alias("day"))
    return tables.partition_filter(o, "day", "1995-02-28", "1995-04-01", 2, "yyyy-MM-dd").select("o_orderkey")
