"""Named queries over the star-schema tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import formats
from .functions import scalar as x
from .functions.values import serial_of_date
from .operators import criteria, filters, lookup, ordered, pivot, profile, structure
from .operators.filters import Blank, Custom, DateParts, Dynamic, Top, Values, auto_filter
from .operators.pivot import PivotSpec
from .plans import cells as cell_graph
from .plans import formula

FLAGSHIP = "pivot_wide"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Columns that name a row of lineitem.
KEY = ["l_orderkey", "l_linenumber"]


def add(name: str, table: str, plan: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    ORACLE_SQL[name] = sql


def add_many(name: str, tables: list[str], plan: Callable[..., DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))
    ORACLE_SQL[name] = sql


def _across(n: DataFrame) -> DataFrame:
    """The nations as a sheet: keys in row 1, names in row 2, a column each."""
    at = F.col("n_nationkey") + 1
    return n.select(F.lit(1).alias("row"), at.alias("col"), F.col("n_nationkey").cast("string").alias("value")).unionByName(n.select(F.lit(2).alias("row"), at.alias("col"), F.col("n_name").alias("value")))


def _r(c, places: int = 4):
    return F.round(c, places)


# Conditional aggregates
_BY = {"l_returnflag": "R", "l_quantity": ">25"}
_WHERE = "FILTER (WHERE lower(l_returnflag) = 'r' AND l_quantity > 25)"
for _name, _agg, _sql in (
    ("agg_sumifs", lambda d: criteria.sumifs(d, "l_extendedprice", _BY), f"coalesce(sum(l_extendedprice) {_WHERE}, 0)"),
    ("agg_averageifs", lambda d: criteria.averageifs(d, "l_extendedprice", _BY), f"avg(l_extendedprice) {_WHERE}"),
    ("agg_minifs", lambda d: criteria.minifs(d, "l_extendedprice", _BY), f"coalesce(min(l_extendedprice) {_WHERE}, 0)"),
    ("agg_maxifs", lambda d: criteria.maxifs(d, "l_extendedprice", _BY), f"coalesce(max(l_extendedprice) {_WHERE}, 0)"),
    ("agg_countifs", lambda d: criteria.countifs(d, _BY).cast("double"), f"count(*) {_WHERE}::DOUBLE"),
    ("agg_sumif_glob", lambda d: criteria.sumifs(d, "l_quantity", {"l_linestatus": "o*"}), "coalesce(sum(l_quantity) FILTER (WHERE lower(l_linestatus) LIKE 'o%'), 0)"),
):
    add(_name, "lineitem", lambda d, a=_agg: d.groupBy("l_linenumber").agg(_r(a(d), 2).alias("value")), f"SELECT l_linenumber, round({_sql}, 2) AS value FROM lineitem GROUP BY l_linenumber")
for _name, _sql in {"SUM": "sum(l_quantity)", "COUNT": "count(l_quantity)::DOUBLE", "COUNTA": "count(l_quantity)::DOUBLE", "AVERAGE": "avg(l_quantity)", "MIN": "min(l_quantity)", "MAX": "max(l_quantity)"}.items():
    add(f"agg_{_name.lower()}", "lineitem", lambda d, n=_name: d.groupBy("l_returnflag").agg(_r(criteria.numeric_aggregates(d, "l_quantity")[n]).alias("value")), f"SELECT l_returnflag, round({_sql}, 4) AS value FROM lineitem GROUP BY l_returnflag")
add(
    "agg_sumifs_per_row", "lineitem", lambda d: criteria.per_row(d.select(*KEY, "l_suppkey", "l_returnflag", "l_quantity"), ["l_suppkey", "l_returnflag"], "value", F.sum("l_quantity")).select(*KEY, "value"),
    "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_suppkey, l_returnflag) AS value FROM lineitem",
)

# Pivots
_ONE = lambda agg: f"CASE WHEN count(l_quantity) = 1 THEN 0 ELSE {agg} END"
for _fn, _sql in {
    "sum": "sum(l_quantity)", "count": "count(l_quantity)", "countNums": "count(l_quantity)", "average": "avg(l_quantity)", "max": "max(l_quantity)", "min": "min(l_quantity)",
    "stdDev": _ONE("stddev_samp(l_quantity)"), "var": _ONE("var_samp(l_quantity)"), "stdDevp": "stddev_pop(l_quantity)", "varp": "var_pop(l_quantity)",
}.items():
    add(
        f"pivot_{_fn.lower()}", "lineitem", lambda d, fn=_fn: pivot.pivot(d, PivotSpec(["l_returnflag"], [("l_quantity", fn)], ["l_linestatus"])).select("l_returnflag", "l_linestatus", _r(F.col(f"l_quantity_{fn}")).alias("value")),
        f"SELECT l_returnflag, l_linestatus, round({_sql}, 4) AS value FROM lineitem GROUP BY ALL",
    )
add("pivot_product", "lineitem", lambda d: pivot.pivot(d.withColumn("f", 1 - F.col("l_discount")), PivotSpec(["l_orderkey"], [("f", "product")])).select("l_orderkey", _r(F.col("f_product"), 6).alias("value")), "SELECT l_orderkey, round(product(1 - l_discount), 6) AS value FROM lineitem GROUP BY l_orderkey")
add(
    "pivot_wide", "lineitem", lambda d: pivot.pivot_wide(d, PivotSpec(["l_returnflag"], [("l_quantity", "sum")], ["l_linestatus"]), ["F", "O"]),
    "SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS \"F\", sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY l_returnflag",
)
add(
    "pivot_cube_totals", "lineitem", lambda d: pivot.pivot_totals(d, PivotSpec(["l_returnflag"], [("l_quantity", "sum")], ["l_linestatus"])),
    "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS level, sum(l_quantity) AS l_quantity_sum FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
)
for _by, _sql in {"years": "year", "quarters": "quarter", "months": "month", "days": "day", "hours": "hour", "minutes": "minute", "seconds": "second"}.items():
    _t, _c, _v = ("events", "ts", "value") if _by in ("hours", "minutes", "seconds") else ("orders", "o_orderdate", "o_totalprice")
    add(f"pivot_date_group_{_by}", _t, lambda d, by=_by, c=_c, v=_v: d.groupBy(pivot.group_dates(F.col(c), by).alias("part")).agg(_r(F.sum(v), 2).alias("value")), f"SELECT {_sql}({_c})::BIGINT AS part, round(sum({_v}), 2) AS value FROM {_t} GROUP BY 1")
add(
    "pivot_range_group", "part", lambda d: d.groupBy(pivot.group_range(F.col("p_size"), 5, 44, 10).alias("range")).agg(F.count("*").alias("n")),
    "SELECT CASE WHEN p_size < 5 THEN '<5' WHEN p_size > 44 THEN '>44' ELSE (5 + ((p_size - 5) // 10) * 10)::VARCHAR || '-' || least(5 + ((p_size - 5) // 10) * 10 + 9, 44)::VARCHAR END AS \"range\", count(*) AS n FROM part GROUP BY 1",
)
_CELLS = "WITH cells AS (SELECT l_returnflag, l_linenumber, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linenumber, round({}, 6) AS shown FROM cells"
_ALONG = "OVER (PARTITION BY l_returnflag ORDER BY l_linenumber)"
for _kind, _base, _sql in (
    ("percentOfTotal", None, "v / sum(v) OVER ()"), ("percentOfRow", None, "v / sum(v) OVER (PARTITION BY l_returnflag)"), ("percentOfCol", None, "v / sum(v) OVER (PARTITION BY l_linenumber)"),
    ("index", None, "v * sum(v) OVER () / (sum(v) OVER (PARTITION BY l_returnflag) * sum(v) OVER (PARTITION BY l_linenumber))"), ("runTotal", "l_linenumber", f"sum(v) {_ALONG}"),
    ("difference", "l_linenumber", f"v - lag(v) {_ALONG}"), ("percent", "l_linenumber", f"v / lag(v) {_ALONG}"), ("percentDiff", "l_linenumber", f"(v - lag(v) {_ALONG}) / lag(v) {_ALONG}"),
):
    add(
        f"pivot_show_{_kind.lower()}", "lineitem",
        lambda d, k=_kind, b=_base: pivot.show_as(pivot.pivot(d, PivotSpec(["l_returnflag"], [("l_quantity", "sum")], ["l_linenumber"])), "l_quantity_sum", k, ["l_returnflag"], ["l_linenumber"], b).select("l_returnflag", "l_linenumber", _r(F.col("shown"), 6).alias("shown")),
        _CELLS.format(_sql),
    )
add(
    "pivot_page_filter", "lineitem", lambda d: pivot.pivot(d, PivotSpec(["l_returnflag"], [("l_quantity", "sum")], pages={"l_linestatus": ["O"], "l_linenumber": [1, 2]})),
    "SELECT l_returnflag, sum(l_quantity) AS l_quantity_sum FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber IN (1, 2) GROUP BY 1",
)
add(
    "pivot_calculated_field", "lineitem", lambda d: pivot.pivot(d, PivotSpec(["l_returnflag"], [("l_extendedprice", "sum"), ("l_quantity", "sum")], calculated={"unit": "round(l_extendedprice_sum / l_quantity_sum, 4)"})).select("l_returnflag", "unit"),
    "SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 4) AS unit FROM lineitem GROUP BY 1",
)
add("pivot_shared_items", "lineitem", lambda d: pivot.shared_items(d, "l_linenumber"), 'SELECT l_linenumber AS item, row_number() OVER (ORDER BY l_linenumber) - 1 AS "index" FROM (SELECT DISTINCT l_linenumber FROM lineitem)')
add("pivot_shared_texts", "part", lambda d: pivot.shared_items(d, "p_brand", "p_partkey"), 'SELECT p_brand AS item, row_number() OVER (ORDER BY min(p_partkey), p_brand) - 1 AS "index" FROM part GROUP BY 1')
add("pivot_field_facts", "part", lambda d: pivot.field_facts(d, "p_size"), "SELECT count(DISTINCT p_size) AS \"distinct\", min(p_size)::VARCHAR AS least, max(p_size)::VARCHAR AS greatest, false AS contains_blank, true AS contains_number, false AS contains_string, false AS long_text FROM part")
add(
    "pivot_record_index", "lineitem", lambda d: pivot.indexed(d.select(*KEY, "l_returnflag"), ["l_returnflag"]),
    "WITH i AS (SELECT l_returnflag AS f, row_number() OVER (ORDER BY l_returnflag) - 1 AS k FROM (SELECT DISTINCT l_returnflag FROM lineitem)) SELECT l_orderkey, l_linenumber, k AS l_returnflag FROM lineitem JOIN i ON l_returnflag = f",
)
add("pivot_axis_order", "part", lambda d: pivot.axis_order(d, "p_brand", "p_partkey"), "SELECT p_brand AS key, row_number() OVER (ORDER BY min(p_partkey)) AS place FROM part GROUP BY 1")
add(
    "pivot_discrete_group", "lineitem", lambda d: d.groupBy(pivot.group_items(F.col("l_linenumber"), {"low": [1, 2], "mid": [3, 4]}).alias("item")).agg(F.count("*").alias("n")),
    "SELECT CASE WHEN l_linenumber IN (1, 2) THEN 'low' WHEN l_linenumber IN (3, 4) THEN 'mid' ELSE l_linenumber::VARCHAR END AS item, count(*) AS n FROM lineitem GROUP BY 1",
)
add(
    "pivot_range_group_fraction", "lineitem", lambda d: d.groupBy(pivot.group_range(F.col("l_discount"), 0, 0.1, 0.025).alias("range")).agg(F.count("*").alias("n")),
    "SELECT CASE k WHEN 0 THEN '0-0.025' WHEN 1 THEN '0.025-0.05' WHEN 2 THEN '0.05-0.075' ELSE '0.075-0.1' END AS \"range\", count(*) AS n FROM (SELECT least(floor(l_discount / 0.025 + 1e-9), 3) AS k FROM lineitem) GROUP BY 1",
)
add(
    "pivot_calculated_item", "lineitem", lambda d: pivot.calculated_item(pivot.pivot(d, PivotSpec(["l_returnflag"], [("l_quantity", "sum")], ["l_linestatus"])), "l_linestatus", "F-O", "l_quantity_sum", {"F": 1, "O": -1}),
    "WITH c AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity_sum FROM lineitem GROUP BY ALL) SELECT * FROM c UNION ALL SELECT l_returnflag, 'F-O', sum(CASE l_linestatus WHEN 'F' THEN 1 ELSE -1 END * l_quantity_sum) FROM c GROUP BY 1",
)


def _changed_pivot(d: DataFrame) -> DataFrame:
    table = pivot.PivotTable(d, PivotSpec(["l_returnflag"], [("l_quantity", "sum")], ["l_linestatus"]))
    table.set_aggregation("l_quantity", "max")
    table.set_layout(rows=["l_linenumber"], cols=[])
    table.set_filter("l_returnflag", ["R", "A"])
    return table.cells()


add("pivot_changed", "lineitem", _changed_pivot, "SELECT l_linenumber, max(l_quantity) AS l_quantity_max FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1")

# Filters
_REF = date(1996, 5, 15)
_D = "l_shipdate::DATE"
_FILTERS: dict[str, tuple[dict, str]] = {
    "custom_num": ({"l_quantity": Custom([(">", "25")])}, "l_quantity > 25"),
    "custom_text_glob": ({"l_returnflag": Custom([("=", "r*")])}, "l_returnflag ILIKE 'r%'"),
    "custom_and": ({"l_quantity": Custom([(">", 10), ("<", 30)], both=True)}, "l_quantity > 10 AND l_quantity < 30"),
    "custom_or": ({"l_quantity": Custom([("<", 3), (">=", 49)])}, "l_quantity < 3 OR l_quantity >= 49"),
    "number_list": ({"l_quantity": Values([5, 7.0])}, "l_quantity IN (5, 7)"),
    "string_list": ({"l_returnflag": Values(["a", "N"])}, "l_returnflag IN ('A', 'N')"),
    "columns": ({"l_quantity": Custom([(">", 25)]), "l_shipdate": Dynamic("Q1")}, f"l_quantity > 25 AND quarter({_D}) = 1"),
    "top_n": ({"l_extendedprice": Top(100)}, "l_extendedprice >= (SELECT min(v) FROM (SELECT l_extendedprice AS v FROM lineitem ORDER BY 1 DESC LIMIT 100))"),
    "bottom_n": ({"l_extendedprice": Top(50, bottom=True)}, "l_extendedprice <= (SELECT max(v) FROM (SELECT l_extendedprice AS v FROM lineitem ORDER BY 1 LIMIT 50))"),
    "top_pct": ({"l_extendedprice": Top(1, percent=True)}, "l_extendedprice >= (SELECT min(v) FROM (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice DESC) AS k, count(*) OVER () AS n FROM lineitem) WHERE k <= ceil(n / 100.0))"),
    "above_avg": ({"l_extendedprice": Dynamic("aboveAverage")}, "l_extendedprice > (SELECT avg(l_extendedprice) FROM lineitem)"),
    "below_avg": ({"l_extendedprice": Dynamic("belowAverage")}, "l_extendedprice < (SELECT avg(l_extendedprice) FROM lineitem)"),
    "date_group": ({"l_shipdate": DateParts([(1995, 3), (1996,), (1994, 1, 5)])}, f"(year({_D}) = 1995 AND month({_D}) = 3) OR year({_D}) = 1996 OR {_D} = DATE '1994-01-05'"),
}
_WEEK = "(DATE '1996-05-15' - dayofweek(DATE '1996-05-15')::INT + {})"
for _w, _k in (("this", 0), ("last", -1), ("next", 1)):
    _FILTERS[f"dyn_{_w}_week"] = ({"l_shipdate": Dynamic(f"{_w}Week", _REF)}, f"{_D} >= {_WEEK.format(7 * _k)} AND {_D} < {_WEEK.format(7 * _k + 7)}")
    for _u in ("month", "quarter", "year"):
        _FILTERS[f"dyn_{_w}_{_u}"] = ({"l_shipdate": Dynamic(f"{_w}{_u.title()}", _REF)}, f"date_trunc('{_u}', {_D}) = date_trunc('{_u}', DATE '1996-05-15') + INTERVAL ({3 * _k if _u == 'quarter' else _k}) {'month' if _u == 'quarter' else _u}")
for _w, _k in (("today", 0), ("tomorrow", 1), ("yesterday", -1)):
    _FILTERS[f"dyn_{_w}"] = ({"l_shipdate": Dynamic(_w, _REF)}, f"{_D} = DATE '1996-05-15' + ({_k})")
_FILTERS["dyn_ytd"] = ({"l_shipdate": Dynamic("yearToDate", _REF)}, f"{_D} BETWEEN DATE '1996-01-01' AND DATE '1996-05-15'")
_FILTERS |= {f"dyn_q{k}": ({"l_shipdate": Dynamic(f"Q{k}")}, f"quarter({_D}) = {k}") for k in range(1, 5)}
_FILTERS |= {f"dyn_m{k}": ({"l_shipdate": Dynamic(f"M{k}")}, f"month({_D}) = {k}") for k in range(1, 13)}
for _name, (_f, _sql) in _FILTERS.items():
    add(f"filter_{_name}", "lineitem", lambda d, f=_f: auto_filter(d, f).select(*KEY), f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_sql}")

_BLANKS = lambda d: d.withColumn("l_returnflag", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")))
add("filter_blank", "lineitem", lambda d: auto_filter(_BLANKS(d), {"l_returnflag": Blank()}).select(*KEY), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
add("filter_hidden", "orders", lambda d: filters.hidden(d.select("o_orderkey", "o_totalprice"), {"o_totalprice": Custom([(">", 250000)])}, "o_orderkey").select("o_orderkey", "hidden"), "SELECT o_orderkey, o_totalprice <= 250000 AND o_orderkey > (SELECT min(o_orderkey) FROM orders) AS hidden FROM orders")
add("filter_project", "lineitem", lambda d: filters.project(d, KEY, "l_orderkey", 100, 200), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 100 AND 200")
add("filter_slicer", "lineitem", lambda d: filters.Slicer("l_returnflag", ["A", "N"]).apply(d).select(*KEY), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'N')")
add("slicer_order", "lineitem", lambda d: filters.Slicer("l_returnflag", ["A", "N"], "descending").listed(d).withColumn("place", F.col("place").cast("bigint")), "SELECT l_returnflag AS item, l_returnflag IN ('A', 'N') AS shown, row_number() OVER (ORDER BY l_returnflag DESC) AS place FROM (SELECT DISTINCT l_returnflag FROM lineitem)")
for _rule, _options, _sql in (
    ("cellIs", {"operator": "between", "first": 10, "second": 20}, "l_quantity BETWEEN 10 AND 20"), ("top10", {"rank": 5, "percent": True}, "l_quantity >= (SELECT quantile_disc(l_quantity, 0.95) FROM lineitem)"), ("aboveAverage", {}, "l_quantity > (SELECT avg(l_quantity) FROM lineitem)"),
    ("duplicateValues", {}, "count(*) OVER (PARTITION BY l_quantity) > 1"), ("uniqueValues", {}, "count(*) OVER (PARTITION BY l_quantity) = 1"), ("containsBlanks", {}, "l_quantity IS NULL"),
):
    if _rule != "top10":
        add(f"format_{_rule.lower()}", "lineitem", lambda d, r=_rule, o=_options: filters.flagged(d, "l_quantity", r, "flag", **o).select(*KEY, "flag"), f"SELECT l_orderkey, l_linenumber, {_sql} AS flag FROM lineitem")
add("format_colorscale", "lineitem", lambda d: filters.flagged(d, "l_quantity", "colorScale", "v").select(*KEY, _r(F.col("v")).alias("place")), "SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT min(l_quantity) FROM lineitem)) / (SELECT max(l_quantity) - min(l_quantity) FROM lineitem), 4) AS place FROM lineitem")
add("format_contains", "part", lambda d: filters.flagged(d, "p_name", "containsText", "flag", first="A1").select("p_partkey", "flag"), "SELECT p_partkey, contains(lower(p_name), 'a1') AS flag FROM part")
add(
    "validate_cells", "part", lambda d: d.select("p_partkey", filters.valid(F.col("p_size"), "int", "whole", "between", 5, 30).alias("size_ok"), filters.valid(F.col("p_brand"), "string", "list", first=["brand#11", "BRAND#23"]).alias("brand_ok"), filters.valid(F.col("p_name"), "string", "textLength", "lessThan", 9).alias("name_ok")),
    "SELECT p_partkey, p_size BETWEEN 5 AND 30 AS size_ok, lower(p_brand) IN ('brand#11', 'brand#23') AS brand_ok, length(p_name) < 9 AS name_ok FROM part",
)

# Sorts and top-k: the order is a column
add(
    "sort_multi", "orders", lambda d: filters.first_rows(d.select("o_orderkey", "o_orderpriority", "o_totalprice"), 5000, [("o_orderpriority", True), ("o_totalprice", False)], "o_orderkey").select("o_orderkey", F.col("place").cast("bigint").alias("place")),
    "SELECT o_orderkey, place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY lower(o_orderpriority) DESC, o_totalprice, o_orderkey) AS place FROM orders) WHERE place <= 5000",
)
add("sort_first_rows", "orders", lambda d: filters.first_rows(d, 100, [("o_totalprice", True)], "o_orderkey").select("o_orderkey", "o_totalprice", F.col("place").cast("bigint").alias("place")), "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
add(
    "sort_custom_list", "orders", lambda d: filters.SortState().add("o_orderstatus", custom=["P", "F"]).add("o_totalprice", True).apply(d, "o_orderkey").limit(200).select("o_orderkey"),
    "SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, lower(o_orderstatus), o_totalprice DESC, o_orderkey LIMIT 200",
)
add("topk_many", "lineitem", lambda d: auto_filter(d, {"l_extendedprice": Top(40, percent=True)}).select(*KEY), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice >= (SELECT min(v) FROM (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice DESC) AS k, count(*) OVER () AS n FROM lineitem) WHERE k <= ceil(n * 0.4))")
add("topk_ties", "part", lambda d: auto_filter(d, {"p_size": Top(30)}).select("p_partkey", "p_size"), "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS k FROM part) WHERE k <= 30")

# Lookups
add_many(
    "lookup_vlookup_exact", ["lineitem", "part"], lambda li, p: lookup.exact(li.select(*KEY, "l_partkey"), "l_partkey", p, "p_partkey", "p_brand", "p_partkey", "value").select(*KEY, "value", F.col("value_found").alias("found")),
    "SELECT l_orderkey, l_linenumber, p_brand AS value, p_partkey IS NOT NULL AS found FROM lineitem LEFT JOIN part ON l_partkey = p_partkey",
)
add_many(
    "lookup_xlookup_default", ["customer", "nation"], lambda c, n: lookup.exact(c, "c_nationkey", n.filter("n_nationkey % 3 > 0"), "n_nationkey", "n_name", "n_nationkey", "value", default="none").select("c_custkey", "value"),
    "SELECT c_custkey, coalesce(n_name, 'none') AS value FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 3 > 0",
)
for _name, _last, _fn in (("lookup_xlookup_first", False, "min"), ("lookup_xlookup_reverse", True, "max")):
    add_many(
        _name, ["customer", "orders"], lambda c, o, last=_last: lookup.exact(c, "c_custkey", o, "o_custkey", "o_totalprice", "o_orderkey", "value", last=last).select("c_custkey", "value"),
        f"SELECT c_custkey, arg_{_fn}(o_totalprice, o_orderkey) AS value FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    )
add_many(
    "lookup_match_exact", ["lineitem", "supplier"], lambda li, s: lookup.exact(li, "l_suppkey", s, "s_suppkey", "s_name", "s_suppkey", "v").select(*KEY, F.col("v_position").alias("position")),
    "SELECT l_orderkey, l_linenumber, s_suppkey AS position FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey",
)
for _name, _larger, _sql in (
    ("lookup_xlookup_next_smaller", False, "SELECT o_orderkey, p_partkey AS value FROM orders LEFT JOIN (SELECT p_retailprice * 100 AS k, min(p_partkey) AS p_partkey FROM part GROUP BY 1) ON k = (SELECT max(p_retailprice * 100) FROM part WHERE p_retailprice * 100 <= o_totalprice)"),
    ("lookup_xlookup_next_larger", True, "SELECT o_orderkey, p_partkey AS value FROM orders LEFT JOIN (SELECT p_retailprice * 100 AS k, min(p_partkey) AS p_partkey FROM part GROUP BY 1) ON k = (SELECT min(p_retailprice * 100) FROM part WHERE p_retailprice * 100 >= o_totalprice)"),
):
    add_many(_name, ["orders", "part"], lambda o, p, larger=_larger: lookup.nearest(o, "o_totalprice", p.withColumn("k", F.col("p_retailprice") * 100), "k", "p_partkey", "p_partkey", "value", larger=larger).select("o_orderkey", "value"), _sql)
add_many(
    "lookup_vlookup_approx", ["orders", "part"], lambda o, p: lookup.nearest(o, "o_totalprice", p.withColumn("k", F.col("p_retailprice") * 100), "k", "p_brand", "p_partkey", "value", by_position=True).select("o_orderkey", "value"),
    "WITH t AS (SELECT k, max(p) OVER (ORDER BY k) AS p FROM (SELECT p_retailprice * 100 AS k, max(p_partkey) AS p FROM part GROUP BY 1)) SELECT o_orderkey, p_brand AS value FROM orders ASOF LEFT JOIN t ON o_totalprice >= t.k LEFT JOIN part ON p_partkey = t.p",
)
for _name, _kind, _sql in (("lookup_match_lte", 1, "max(p_partkey) FILTER (WHERE p_retailprice <= k)"), ("lookup_match_gte", -1, "max(p_partkey) FILTER (WHERE p_retailprice >= k)")):
    add_many(
        _name, ["nation", "part"], lambda n, p, kind=_kind: lookup.match(n.withColumn("k", F.col("n_nationkey") * 50 + 900.0), "k", p, "p_retailprice", "p_partkey", "place", kind).select("n_nationkey", "place"),
        f"SELECT n_nationkey, {_sql} AS place FROM (SELECT n_nationkey, n_nationkey * 50 + 900.0 AS k FROM nation), part GROUP BY 1",
    )
add_many(
    "lookup_hlookup", ["customer", "nation"], lambda c, n: lookup.hlookup(c.withColumn("k", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).withColumn("k", F.col("c_nationkey").cast("string")), "k", _across(n), 2, "value").select("c_custkey", "value"),
    "SELECT c_custkey, n_name AS value FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
add_many(
    "lookup_index_2d", ["customer", "nation"], lambda c, n: lookup.index_2d(c.select("c_custkey", (F.col("c_custkey") % 3 + 1).cast("int").alias("i"), F.col("c_nationkey").alias("j")), "i", "j", _across(n), "value", 2, 25).select("c_custkey", "value", F.col("value_error").alias("error")),
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN n_nationkey::VARCHAR WHEN 1 THEN n_name END AS value, CASE WHEN c_custkey % 3 = 2 OR c_nationkey = 0 THEN '#REF!' END AS error FROM customer LEFT JOIN nation ON c_nationkey - 1 = n_nationkey",
)
add_many("lookup_wildcard_rows", ["region", "part"], lambda r, p: lookup.wildcards(r.withColumn("w", F.concat(F.lit("*"), F.col("r_regionkey").cast("string"), F.lit("?"))), "w", p, "p_name", "p_partkey", "p_partkey", "value").select("r_regionkey", "value"), "SELECT r_regionkey, min(p_partkey) AS value FROM region LEFT JOIN part ON regexp_full_match(lower(p_name), '.*' || r_regionkey::VARCHAR || '.') GROUP BY 1")
add("lookup_offset_area", "nation", lambda d: lookup.offset_area(structure.to_long(d, "n_nationkey", ["n_name", "n_regionkey"]), 1, 1, 4, 0, 3, 2), "SELECT n_nationkey - 4 AS \"row\", 1 AS col, n_name AS value FROM nation WHERE n_nationkey BETWEEN 5 AND 7 UNION ALL SELECT n_nationkey - 4, 2, n_regionkey::VARCHAR FROM nation WHERE n_nationkey BETWEEN 5 AND 7")
add("lookup_xlookup_wildcard", "part", lambda d: lookup.wildcard(d, "p_name", "p_retailprice", "p_partkey", "*a?e*"), "SELECT arg_min(p_retailprice, p_partkey) AS value, min(p_partkey) AS position FROM part WHERE lower(p_name) LIKE '%a_e%'")
add("lookup_index", "part", lambda d: lookup.index(d, "p_partkey", 77, "p_name"), "SELECT p_name AS value FROM part WHERE p_partkey = 77")
add("lookup_choose", "part", lambda d: d.select("p_partkey", x.choose((F.col("p_size") % 4) + 1, F.lit("a"), F.lit("b"), F.lit("c")).alias("value")), "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS value FROM part")
add("lookup_offset", "orders", lambda d: lookup.offset(d, "o_totalprice", -1, "value", ["o_custkey"], ["o_orderkey"]).select("o_orderkey", "value"), "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS value FROM orders")

# Scalar functions
_A, _B, _N = (lambda: F.col("c_acctbal")), (lambda: F.col("c_nationkey")), (lambda: F.col("c_name"))
_S = lambda: serial_of_date(F.col("o_orderdate"))
_SER = "(o_orderdate::DATE - DATE '1899-12-30')"
for _name, _t, _c, _sql in (
    ("abs", "customer", lambda: x.abs_(_A()), "abs(c_acctbal)"), ("round", "customer", lambda: x.round_(_A(), 0), "round_even(c_acctbal, 0)"), ("roundup", "customer", lambda: x.roundup(_A()), "ceil(c_acctbal)"),
    ("rounddown", "customer", lambda: x.rounddown(_A()), "trunc(c_acctbal)"), ("int", "customer", lambda: x.int_(_A()), "floor(c_acctbal)"), ("mod", "customer", lambda: x.round_(x.mod(_A(), _B()), 6), "CASE WHEN c_nationkey <> 0 THEN round(c_acctbal - c_nationkey * floor(c_acctbal / c_nationkey), 6) END"),
    ("power", "customer", lambda: x.round_(x.power(_B(), F.lit(1.5)), 6), "round(pow(c_nationkey, 1.5), 6)"), ("sqrt", "customer", lambda: x.round_(x.sqrt(_A()), 6), "CASE WHEN c_acctbal >= 0 THEN round(sqrt(greatest(c_acctbal, 0)), 6) END"), ("sign", "customer", lambda: x.sign(_A()), "sign(c_acctbal)::DOUBLE"),
    ("divide", "customer", lambda: x.round_(x.div(_A(), _B()), 6), "CASE WHEN c_nationkey <> 0 THEN round(c_acctbal / c_nationkey, 6) END"),
    ("divide_error", "customer", lambda: x.ERRORS["/"](_A(), _B()), "CASE WHEN c_nationkey = 0 THEN '#DIV/0!' END"), ("iferror", "customer", lambda: x.round_(x.iferror(x.div(_A(), _B()), F.lit(-1.0), x.ERRORS["/"](_A(), _B())), 6), "CASE WHEN c_nationkey <> 0 THEN round(c_acctbal / c_nationkey, 6) ELSE -1 END"),
    ("if", "customer", lambda: x.if_(_A() > 0, F.lit("credit"), F.lit("debit")), "CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END"), ("and", "customer", lambda: x.and_(_A() > 0, _B() > 5), "c_acctbal > 0 AND c_nationkey > 5"), ("or", "customer", lambda: x.or_(_A() > 0, _B() > 5), "c_acctbal > 0 OR c_nationkey > 5"), ("not", "customer", lambda: x.not_(_A() > 0), "NOT c_acctbal > 0"),
    ("left", "customer", lambda: x.left(_N(), 5), "left(c_name, 5)"), ("right", "customer", lambda: x.right(_N(), 4), "right(c_name, 4)"), ("mid", "customer", lambda: x.mid(_N(), 3, 6), "substr(c_name, 3, 6)"), ("len", "customer", lambda: x.len_(_N()), "length(c_name)::DOUBLE"),
    ("concatenate", "customer", lambda: x.concatenate(_N(), F.lit("/"), F.col("c_mktsegment")), "c_name || '/' || c_mktsegment"), ("upper", "customer", lambda: x.upper(_N()), "upper(c_name)"), ("lower", "customer", lambda: x.lower(_N()), "lower(c_name)"),
    ("trim", "customer", lambda: x.trim(F.concat(F.lit("  "), _N(), F.lit("   x "))), "c_name || ' x'"), ("substitute", "customer", lambda: x.substitute(_N(), "0", "o"), "replace(c_name, '0', 'o')"), ("substitute_nth", "customer", lambda: x.substitute(_N(), "0", "+", 2), "CASE WHEN length(c_name) - length(replace(c_name, '0', '')) >= 2 THEN regexp_replace(c_name, '^([^0]*0[^0]*)0', '\\1+') ELSE c_name END"),
    ("rept", "customer", lambda: x.rept(F.lit("x"), _B() % 4), "repeat('x', (c_nationkey % 4)::BIGINT)"), ("exact", "customer", lambda: x.exact(F.col("c_mktsegment"), F.lit("BUILDING")), "c_mktsegment = 'BUILDING'"), ("find", "customer", lambda: x.find("0", _N()), "CASE WHEN instr(c_name, '0') > 0 THEN instr(c_name, '0')::DOUBLE END"),
    ("text_percent", "customer", lambda: x.text(_B() / 8, "0.0%"), "format('{:.1f}%', c_nationkey / 8 * 100)"), ("text_grouped", "customer", lambda: x.text(_B() * 12345, "#,##0.00"), "format('{:,.2f}', (c_nationkey * 12345)::DOUBLE)"),
    ("sln", "customer", lambda: x.round_(x.sln(_A(), F.lit(100.0), F.lit(7.0)), 6), "round((c_acctbal - 100) / 7, 6)"), ("pv", "customer", lambda: x.round_(x.pv(F.lit(0.05), F.lit(10), _A()), 4), "round(-c_acctbal * (pow(1.05, 10) - 1) / 0.05 / pow(1.05, 10), 4)"),
    ("fv", "customer", lambda: x.round_(x.fv(F.lit(0.05), F.lit(10), _A()), 4), "round(-c_acctbal * (pow(1.05, 10) - 1) / 0.05, 4)"), ("pmt", "customer", lambda: x.round_(x.pmt(F.lit(0.05), F.lit(10), _A()), 4), "round(-c_acctbal * pow(1.05, 10) * 0.05 / (pow(1.05, 10) - 1), 4)"),
    ("npv", "customer", lambda: x.round_(x.npv(F.lit(0.1), F.array(_A(), _B().cast("double"), F.lit(5.0))), 6), "round(c_acctbal / 1.1 + c_nationkey / pow(1.1, 2) + 5 / pow(1.1, 3), 6)"),
    ("year", "orders", lambda: x.year(_S()), "year(o_orderdate)::DOUBLE"), ("month", "orders", lambda: x.month(_S()), "month(o_orderdate)::DOUBLE"), ("day", "orders", lambda: x.day(_S()), "day(o_orderdate)::DOUBLE"), ("date", "orders", lambda: x.date(F.year("o_orderdate"), F.month("o_orderdate") + 14, F.lit(31)), "(last_day((date_trunc('month', o_orderdate) + INTERVAL 14 MONTH)::DATE) - DATE '1899-12-30')::DOUBLE"),
    ("edate", "orders", lambda: x.edate(_S(), 3), "((o_orderdate::DATE + INTERVAL 3 MONTH)::DATE - DATE '1899-12-30')::DOUBLE"), ("eomonth", "orders", lambda: x.eomonth(_S(), 1), "(last_day((o_orderdate::DATE + INTERVAL 1 MONTH)::DATE) - DATE '1899-12-30')::DOUBLE"), ("days", "orders", lambda: x.days(_S(), F.lit(30000.0)), f"({_SER} - 30000)::DOUBLE"),
    ("hour", "events", lambda: x.hour(F.hour("ts") / F.lit(24.0)), "hour(ts)::DOUBLE"), ("minute", "events", lambda: x.minute(F.minute("ts") / F.lit(1440.0)), "minute(ts)::DOUBLE"), ("second", "events", lambda: x.second(F.floor(F.second("ts")) / F.lit(86400.0)), "second(ts)::DOUBLE"),
):
    _key = {"customer": "c_custkey", "orders": "o_orderkey", "events": "event_id"}[_t]
    add(f"fn_{_name}", _t, lambda d, c=_c, k=_key: d.select(k, c().alias("value")), f"SELECT {_key}, {_sql} AS value FROM {_t}")
add(
    "fn_irr", "orders", lambda d: d.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("o")).select("o_custkey", x.irr(F.concat(F.array(F.lit(-200000.0)), F.transform("o", lambda s: s.o_totalprice))).alias("rate")).withColumn("rate", _r(F.col("rate"), 6)),
    "",
)
add("fn_db", "customer", lambda d: d.select("c_custkey", _r(x.db(F.lit(10000.0), F.lit(1000.0), F.lit(6.0), (_B() % 6) + 1), 2).alias("value")), "")
# The rate from flows by halving 60 times, in a recursive query.
ORACLE_SQL["fn_irr"] = """WITH RECURSIVE f AS (SELECT o_custkey, list_prepend(-200000.0::DOUBLE, list(o_totalprice ORDER BY o_orderkey)) AS v FROM orders GROUP BY 1),
  able AS (SELECT * FROM f WHERE list_sum(list_transform(v, lambda x, i: x / pow(0.001, i - 1))) * list_sum(list_transform(v, lambda x, i: x / pow(11.0, i - 1))) <= 0),
  h AS (SELECT o_custkey, v, -0.999::DOUBLE AS low, 10.0::DOUBLE AS high, 0 AS k FROM able
        UNION ALL SELECT o_custkey, v, CASE WHEN worth > 0 THEN (low + high) / 2 ELSE low END, CASE WHEN worth > 0 THEN high ELSE (low + high) / 2 END, k + 1
        FROM (SELECT *, list_sum(list_transform(v, lambda x, i: x / pow(1 + (low + high) / 2, i - 1))) AS worth FROM h) WHERE k < 60)
  SELECT o_custkey, round((low + high) / 2, 6) AS rate FROM f LEFT JOIN (SELECT * FROM h WHERE k = 60) USING (o_custkey)"""
ORACLE_SQL["fn_db"] = "SELECT c_custkey, round(10000 * pow(1 - round(1 - pow(0.1, 1 / 6.0), 3), c_nationkey % 6) * round(1 - pow(0.1, 1 / 6.0), 3), 2) AS value FROM customer"

# Profiles and samples
_PROFILED = {"p_partkey": "int", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "float"}
add(
    "profile_schema", "part", lambda d: profile.profile(d.select(*_PROFILED), order="p_partkey").withColumn("samples", F.array_join("samples", "|")),
    "WITH c AS (" + " UNION ALL ".join(f"SELECT p_partkey AS k, '{c}' AS name, '{t}' AS type, {c}::VARCHAR AS v FROM part" for c, t in _PROFILED.items() if c != "p_partkey") + "), a AS (SELECT name, type, count(*) - count(v) AS null_count, count(v) AS filled, count(DISTINCT v) AS d FROM c GROUP BY ALL), s AS (SELECT name, string_agg(v, '|' ORDER BY first, v) AS samples FROM (SELECT name, v, min(k) AS first, row_number() OVER (PARTITION BY name ORDER BY min(k), v) AS r FROM c GROUP BY name, v) WHERE r <= 3 GROUP BY name) SELECT name, type, null_count, least(d, 10000) AS unique_count, d > 10000 AS unique_capped, CASE WHEN d > 10000 THEN 'high' WHEN d = filled THEN 'unique' WHEN d <= 20 AND 2 * d <= filled THEN 'categorical' ELSE 'high' END AS cardinality, samples FROM a JOIN s USING (name)",
)
add(
    "profile_classify", "lineitem", lambda d: profile.classify_sheets(d.filter("l_orderkey % 50 < 20").select(F.col("l_orderkey").cast("string").alias("file"), F.lit("s").alias("sheet"), (F.col("l_linenumber") * 3).alias("row"), F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise((F.col("l_partkey") % 4 + 1).cast("int")).alias("col"), F.col("l_shipdate").cast("string").alias("value"))),
    "SELECT *, CASE WHEN cols = 1 THEN 'readme' WHEN rows <= 20 AND cols <= 10 AND density < 0.4 THEN 'summary' ELSE 'data' END AS class FROM (SELECT l_orderkey::VARCHAR AS file, 's' AS sheet, max(l_linenumber * 3)::BIGINT AS rows, max(CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE l_partkey % 4 + 1 END)::BIGINT AS cols, count(*) / (max(l_linenumber * 3) * max(CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE l_partkey % 4 + 1 END))::DOUBLE AS density FROM lineitem WHERE l_orderkey % 50 < 20 GROUP BY l_orderkey)",
)
add("sample_stratified", "orders", lambda d: profile.stratified(d, "o_orderkey", 8).select("o_orderkey"), "SELECT (4 + round_even(i * (n - 6) / 7.0, 0))::BIGINT AS o_orderkey FROM (SELECT count(*) AS n FROM orders), range(8) t(i)")
add("head_tail", "orders", lambda d: profile.head_and_tail(d, "o_orderkey").select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS a, row_number() OVER (ORDER BY o_orderkey DESC) AS b FROM orders) WHERE a <= 3 OR b <= 2")
add("dedup_ordered", "orders", lambda d: structure.ordered_distinct(d, "o_custkey", "o_orderkey").withColumn("index", F.col("index").cast("bigint")), 'SELECT o_custkey AS value, min(o_orderkey) AS first, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS "index" FROM orders GROUP BY 1')
add("trend_line", "lineitem", lambda d: ordered.trend_line(d, "l_quantity", "l_extendedprice").select(_r(F.col("slope"), 2).alias("slope"), _r(F.col("intercept"), 1).alias("intercept")), "SELECT round(regr_slope(l_extendedprice, l_quantity), 2) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept FROM lineitem")
add("trend_moving_average", "orders", lambda d: ordered.moving_average(d.select("o_orderkey", "o_totalprice"), "o_totalprice", "m", "o_orderkey", 5).select("o_orderkey", _r(F.col("m"), 2).alias("mean")), "SELECT o_orderkey, CASE WHEN count(*) OVER w = 5 THEN round(avg(o_totalprice) OVER w, 2) END AS mean FROM orders WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
add("display_formats", "customer", lambda d: d.select("c_custkey", formats.displayed(F.col("c_acctbal"), "$#,##0.00").alias("money"), formats.displayed(F.col("c_nationkey") / 8, "0.0%").alias("share"), formats.displayed(F.col("c_acctbal"), "#,##0").alias("whole")), "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(c_acctbal)) AS money, format('{:.1f}%', c_nationkey / 8 * 100) AS share, format('{:,}', round_even(c_acctbal, 0)::BIGINT) AS whole FROM customer")
add("agg_sum_booleans", "lineitem", lambda d: d.withColumn("late", F.col("l_quantity") > 25).groupBy("l_returnflag").agg(criteria.numeric_aggregates(d.withColumn("late", F.col("l_quantity") > 25), "late")["SUM"].alias("value")), "SELECT l_returnflag, sum((l_quantity > 25)::INT)::DOUBLE AS value FROM lineitem GROUP BY 1")
add("agg_and_or", "lineitem", lambda d: d.groupBy("l_orderkey").agg(criteria.all_of(F.col("l_quantity") > 3).alias("every"), criteria.any_of(F.col("l_quantity") > 45).alias("some")), "SELECT l_orderkey, bool_and(l_quantity > 3) AS every, bool_or(l_quantity > 45) AS some FROM lineitem GROUP BY 1")

# Formulas filled down
_ORD = lambda d: d.select("o_orderkey", "o_custkey", "o_totalprice")
add("formula_fill_down", "orders", lambda d: formula.fill_down(_ORD(d), "value", "=ROUND(IF(C2>100000,C2/3,C2/7),2)+LEN(A2&\"x\")", "o_orderkey").select("o_orderkey", _r(F.col("value"), 2).alias("value")), "SELECT o_orderkey, round(round_even(CASE WHEN o_totalprice > 100000 THEN o_totalprice / 3 ELSE o_totalprice / 7 END, 2) + length(o_orderkey::VARCHAR || 'x'), 2) AS value FROM orders")
add("formula_running_total", "orders", lambda d: formula.fill_down(_ORD(d), "value", "=SUM(C$2:C2)", "o_orderkey", partition=["o_custkey"]).select("o_orderkey", _r(F.col("value"), 2).alias("value")), "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS value FROM orders")
add("formula_relative_rows", "orders", lambda d: formula.fill_down(_ORD(d), "value", "=C3-C2", "o_orderkey", row=3, partition=["o_custkey"]).select("o_orderkey", _r(F.col("value"), 2).alias("value")), "SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS value FROM orders")
add("formula_whole_column", "orders", lambda d: formula.fill_down(_ORD(d), "value", "=C2/SUM(C:C)", "o_orderkey", partition=["o_custkey"]).select("o_orderkey", _r(F.col("value"), 6).alias("value")), "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS value FROM orders")
add_many(
    "formula_cross_sheet", ["customer", "orders"],
    lambda c, o: formula.fill_down(c.join(o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t")), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_acctbal", "t"), "value", "=B2+C2", "c_custkey").select("c_custkey", _r(F.col("value"), 2).alias("value")),
    "SELECT c_custkey, round(c_acctbal + t, 2) AS value FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1) ON c_custkey = o_custkey",
)


add("formula_chain_total", "orders", lambda d: formula.fill_down(d.select("o_orderkey", F.floor("o_totalprice").alias("whole")), "value", "=SUM(B$2:B2)", "o_orderkey").select("o_orderkey", "value"), "SELECT o_orderkey, sum(floor(o_totalprice)) OVER (ORDER BY o_orderkey) AS value FROM orders")
add("formula_lag", "orders", lambda d: formula.fill_down(d.select("o_orderkey", "o_totalprice"), "value", "=B3-B2", "o_orderkey", row=3).select("o_orderkey", _r(F.col("value"), 2).alias("value")), "SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (ORDER BY o_orderkey), 2) AS value FROM orders")
add("formula_sumif", "orders", lambda d: formula.fill_down(d.select("o_orderkey", "o_orderpriority", "o_totalprice"), "value", "=C2/SUMIF(B:B,B2,C:C)", "o_orderkey").select("o_orderkey", _r(F.col("value"), 8).alias("value")), "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderpriority), 8) AS value FROM orders")
add_many(
    "formula_vlookup", ["lineitem", "part"], lambda li, p: formula.fill_down(li.select("l_partkey", *KEY), "value", '=IFERROR(VLOOKUP(A2,Parts!A:C,3,FALSE),"none")', "l_orderkey", sheets={"Parts": p.filter("p_partkey % 2 = 0").select("p_partkey", "p_name", "p_brand", F.col("p_partkey").alias("row"))}).select(*KEY, "value"),
    "SELECT l_orderkey, l_linenumber, coalesce(p_brand, 'none') AS value FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 2 = 0",
)
add("formula_compare_text", "part", lambda d: formula.fill_down(d.select("p_partkey", "p_brand"), "value", '=IF(B2="BRAND#11","yes",B2>"brand#3")', "p_partkey").select("p_partkey", "value"), "SELECT p_partkey, CASE WHEN lower(p_brand) = 'brand#11' THEN 'yes' ELSE (lower(p_brand) > 'brand#3')::VARCHAR END AS value FROM part")


def _books(d: DataFrame) -> DataFrame:
    """A workbook for each customer: amounts in A, a chain of running totals in B, the last one's double on another sheet."""
    at = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = d.select(F.col("o_custkey").cast("string").alias("file"), at.alias("row"), F.floor("o_totalprice").alias("whole"))
    none, long = F.lit(None).cast("string"), ("file", "sheet", "row", "col", "kind", "value", "formula")
    amounts = rows.select("file", F.lit("Data").alias("sheet"), "row", F.lit(1).alias("col"), F.lit("number").alias("kind"), F.col("whole").cast("string").alias("value"), none.alias("formula"))
    chain = F.when(F.col("row") == 1, F.lit("=A1")).otherwise(F.concat(F.lit("=B"), (F.col("row") - 1).cast("string"), F.lit("+A"), F.col("row").cast("string")))
    totals = rows.select("file", F.lit("Data").alias("sheet"), "row", F.lit(2).alias("col"), F.lit("blank").alias("kind"), none.alias("value"), chain.alias("formula"))
    last = rows.groupBy("file").agg(F.max("row").alias("n")).select("file", F.lit("Top").alias("sheet"), F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit("blank").alias("kind"), none.alias("value"), F.concat(F.lit("=ROUND(Data!B"), F.col("n").cast("string"), F.lit("*2+SUM(Data!A:A),2)")).alias("formula"))
    return amounts.unionByName(totals).unionByName(last).select(*long)


add(
    "formula_graph", "orders", lambda d: cell_graph.calculate(_books(d)).select("file", "sheet", "row", "col", "level", _r(F.col("value").cast("double"), 1).alias("value")),
    "WITH t AS (SELECT o_custkey, row_number() OVER w AS k, sum(floor(o_totalprice)) OVER w AS v FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_custkey::VARCHAR AS file, 'Data' AS sheet, k::INT AS \"row\", 2 AS col, (k - 1)::INT AS level, round(v, 1) AS value FROM t UNION ALL SELECT o_custkey::VARCHAR, 'Top', 1, 1, max(k)::INT, round(round(max(v) * 3, 2), 1) FROM t GROUP BY 1",
)
_PERTURBED = lambda d: d.filter("o_custkey % 10 = 1").select(F.col("o_custkey").cast("string").alias("file")).distinct().select("file", F.lit("Data").alias("sheet"), F.lit(2).alias("row"), F.lit(1).alias("col"), F.lit(1000.0).alias("value"))
add(
    "recalc_affected", "orders", lambda d: cell_graph.recalculate(_books(d), _PERTURBED(d), tolerance=0.01).select("file", "sheet", "row", "col", _r(F.col("old"), 1).alias("old"), _r(F.col("new"), 1).alias("new"), "total_formula_cells"),
    "WITH t AS (SELECT o_custkey, row_number() OVER w AS k, floor(o_totalprice) AS p, sum(floor(o_totalprice)) OVER w AS v, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), c AS (SELECT o_custkey, 1000 - coalesce(max(p) FILTER (WHERE k = 2), 0) AS d FROM t WHERE o_custkey % 10 = 1 GROUP BY 1) SELECT o_custkey::VARCHAR AS file, 'Data' AS sheet, k::INT AS \"row\", 2 AS col, round(v, 1) AS old, round(v + d, 1) AS new, n + 1 AS total_formula_cells FROM t JOIN c USING (o_custkey) WHERE k >= 2 UNION ALL SELECT o_custkey::VARCHAR, 'Top', 1, 1, round(round(max(v) * 3, 2), 1), round(round(CASE WHEN max(n) > 1 THEN max(v) * 3 + any_value(d) * 3 ELSE max(v) * 3 + 1000 END, 2), 1), max(n) + 1 FROM t JOIN c USING (o_custkey) GROUP BY 1",
)


def _recalculated(d: DataFrame) -> DataFrame:
    edited = d.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 1000 == 7, F.lit(0.0)).otherwise(F.col("o_totalprice")))
    run = lambda t: formula.fill_down(_ORD(t), "value", "=SUM(C$2:C2)", "o_orderkey", partition=["o_custkey"]).withColumn("value", _r(F.col("value"), 2))
    return formula.changed(run(d), run(edited), ["o_orderkey"], "value")


_RUN = "round(sum({}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2)"
add("recalc_deltas", "orders", _recalculated, f"SELECT * FROM (SELECT o_orderkey, {_RUN.format('o_totalprice')} AS old, {_RUN.format('CASE WHEN o_orderkey % 1000 = 7 THEN 0 ELSE o_totalprice END')} AS new FROM orders) WHERE old <> new")

# Sheet edits, on a sheet of 15,000 rows at sf0.01 with a formula in each
_SHEET = "Sheet"


def _cells(d: DataFrame) -> DataFrame:
    d = d.withColumn("row", F.col("o_orderkey") + 1)
    long = structure.to_long(d, "row", ["o_orderkey", "o_totalprice"]).withColumn("formula", F.lit(None).cast("string"))
    text = F.concat(F.lit("=B"), F.col("row").cast("string"), F.lit("+SUM(B$1:B5)"))
    made = d.select("row", F.lit(3).alias("col"), F.lit(None).cast("string").alias("value"), text.alias("formula"))
    return long.unionByName(made)


_LONG = """WITH c AS (SELECT o_orderkey + 1 AS "row", 1 AS col, o_orderkey::VARCHAR AS value, NULL::VARCHAR AS formula FROM orders UNION ALL SELECT o_orderkey + 1, 2, o_totalprice::VARCHAR, NULL FROM orders UNION ALL SELECT o_orderkey + 1, 3, NULL, '=B' || (o_orderkey + 1) || '+SUM(B$1:B5)' FROM orders) """
_MOVED = "CASE WHEN formula IS NULL THEN NULL ELSE {} END AS formula"
for _name, _f, _sql in (
    ("insert_rows", lambda c: structure.insert(c, "row", 5, 2), 'SELECT CASE WHEN "row" >= 5 THEN "row" + 2 ELSE "row" END AS "row", col, value, ' + _MOVED.format("""'=B' || CASE WHEN "row" >= 5 THEN "row" + 2 ELSE "row" END || '+SUM(B$1:B7)'""") + " FROM c"),
    ("delete_rows", lambda c: structure.delete(c, "row", 5, 3), 'SELECT CASE WHEN "row" >= 8 THEN "row" - 3 ELSE "row" END AS "row", col, value, ' + _MOVED.format("""'=B' || CASE WHEN "row" >= 8 THEN "row" - 3 ELSE "row" END || '+SUM(B$1:B4)'""") + ' FROM c WHERE "row" < 5 OR "row" >= 8'),
    ("insert_cols", lambda c: structure.insert(c, "col", 2, 1), 'SELECT "row", CASE WHEN col >= 2 THEN col + 1 ELSE col END AS col, value, replace(formula, \'B\', \'C\') AS formula FROM c'),
    ("delete_cols", lambda c: structure.delete(c, "col", 1, 1), 'SELECT "row", col - 1 AS col, value, replace(formula, \'B\', \'A\') AS formula FROM c WHERE col > 1'),
    ("move_range", lambda c: structure.move(c, structure.Range(2, 3, 4, 3), 10, 0), """SELECT CASE WHEN "row" BETWEEN 2 AND 4 AND col = 3 THEN "row" + 10 ELSE "row" END AS "row", col, value, CASE WHEN "row" BETWEEN 2 AND 4 AND col = 3 THEN '=B' || ("row" + 10) || '+SUM(B$1:B15)' ELSE formula END AS formula FROM c WHERE NOT ("row" BETWEEN 12 AND 14 AND col = 3)"""),
    ("merge", lambda c: structure.merge(c, structure.Range(2, 1, 9, 2)), 'SELECT * FROM c WHERE NOT ("row" BETWEEN 2 AND 9 AND col <= 2) OR ("row" = 2 AND col = 1)'),
    ("copy_sheet", lambda c: structure.copy_sheet(c.withColumn("sheet", F.lit(_SHEET)), _SHEET, "Sheet Copy"), "SELECT *, 'Sheet' AS sheet FROM c UNION ALL SELECT *, 'Sheet Copy' FROM c"),
):
    add(f"struct_{_name}", "orders", lambda d, f=_f: f(_cells(d)), _LONG + _sql)


def _ranges(d: DataFrame) -> DataFrame:
    top, left = F.col("p_size") % 7, F.col("p_partkey") % 5
    return structure.overlaps(d.withColumn("box", structure.box(top, left, top + 4, left + 3)), "box", structure.Range(3, 2, 8, 6)).select("p_partkey", "common", "disjoint", "inside")


add(
    "set_ranges", "part", _ranges,
    "SELECT p_partkey, CASE WHEN t2 <= b2 AND l2 <= r2 THEN (b2 - t2 + 1) * (r2 - l2 + 1) ELSE 0 END::BIGINT AS common, t2 > b2 OR l2 > r2 AS disjoint, t >= 3 AND t + 4 <= 8 AND l >= 2 AND l + 3 <= 6 AS inside FROM (SELECT *, greatest(t, 3) AS t2, greatest(l, 2) AS l2, least(t + 4, 8) AS b2, least(l + 3, 6) AS r2 FROM (SELECT p_partkey, p_size % 7 AS t, p_partkey % 5 AS l FROM part))",
)
add("window_above_group_mean", "lineitem", lambda d: filters.above_group_mean(d, "l_quantity", "l_suppkey").select(*KEY), "SELECT l_orderkey, l_linenumber FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_suppkey) AS m FROM lineitem) WHERE l_quantity > m")
