"""The engine against SQL on the small tables, and against values worked out by hand."""

import glob
import shutil
import subprocess
import sys
from datetime import date
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark import catalog
from gridspark.functions import plain, scalar, values
from gridspark.operators import criteria, filters, lookup, pivot, profile, structure
from gridspark.plans import formula
from gridspark.sources import files
from gridspark.streaming import rows as stream


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {path.split('/')[-1].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def _rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted(repr(tuple(cell(r[k]) for k in order)) for r in found)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, sf, name):
    """Every query against its SQL; no result is empty."""
    got = catalog.QUERIES[name](spark, sf)
    found = got.collect()
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert found and _rows(got.columns, found) == _rows(want.columns, want.fetchall())


def _one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_scalar_vectors(spark):
    L = F.lit
    assert _one(spark, scalar.round_(L(3.14159), 2), scalar.round_(L(2.5)), scalar.roundup(L(3.141), 2), scalar.roundup(L(-1.5)), scalar.rounddown(L(-1.5)), scalar.int_(L(-3.2))) == (3.14, 2.0, 3.15, -1.0, -1.0, -4.0)
    assert _one(spark, scalar.mod(L(-7), L(3)), scalar.mod(L(1), L(0)), scalar.sqrt(L(-1.0)), scalar.power(L(-8.0), L(0.5)), scalar.sln(L(30000), L(7500), L(10))) == (2.0, None, None, None, 2250.0)
    assert _one(spark, scalar.trim(L("  hello   world  ")), scalar.rept(L("x"), L(-1)), scalar.find(L("l"), L("hello"), L(4)), scalar.substitute(L("aaaa"), "aa", "b", 2)) == ("hello world", "", 4.0, "aba")
    assert _one(spark, scalar.text(L(0.756), "0.0%"), scalar.text(L(1234567.89), "#,##0.00"), scalar.text(L(44197.0), "yyyy-mm-dd"), scalar.text(L(3.0), "General")) == ("75.6%", "1,234,567.89", "2021-01-01", "3")
    assert _one(spark, scalar.date(L(2000), L(1), L(1)), scalar.date(L(2024), L(2), L(31)), scalar.date(L(2023), L(14), L(1))) == (36526.0, 45351.0, 45323.0)
    assert _one(spark, scalar.year(L(60.0)), scalar.month(L(60.0)), scalar.day(L(60.0)), scalar.day(L(59.0)), scalar.day(L(61.0))) == (1900.0, 2.0, 29.0, 28.0, 1.0)
    assert _one(spark, scalar.hour(L(0.75)), scalar.minute(L(0.5 + 7 / 1440)), scalar.eomonth(L(45351.0), 1)) == (18.0, 7.0, 45382.0)
    (rate,) = _one(spark, scalar.irr(F.array(*map(L, (-100.0, 60.0, 60.0)))))
    assert abs(rate - 0.130662) < 1e-5
    assert _one(spark, scalar.irr(F.array(L(1.0), L(1.0)))) == (None,)


def test_a_rate_of_return_lies_above_minus_one():
    """Newton's steps leave for -1.45, which is a root but no rate."""
    flows = [-200000.0, 33514.78, 9900.64, 12525.19, 15176.94]
    found = [plain.rate_of_return(flows), *scalar.rates_of_return([np.array(flows), np.array([-100.0, 60.0, 60.0])])]
    assert [round(r, 6) for r in found] == [-0.343507, -0.343507, 0.130662]


def test_values(spark):
    got = [spark.createDataFrame([(v,)], "v string").select(values.num(F.col("v"))).first()[0] for v in ("5", "1d", " 5", "NaN", "1e3", "-.5", "", None)]
    assert got == [5.0, None, None, None, 1000.0, -0.5, None, None]
    df = spark.createDataFrame([("a*b",), ("axb",), ("A",)], "v string")
    assert [r[0] for r in df.filter(values.glob(F.col("v"), "a~*B")).collect()] == ["a*b"] and df.filter(values.glob(F.col("v"), "a?b")).count() == 2


def test_criteria(spark):
    df = spark.createDataFrame([("apple", "5"), ("Apricot", "x"), ("berry", None), (None, "7")], "k string, v string")
    count = lambda c, x: df.agg(criteria.countifs(df, {c: x})).first()[0]
    assert [count("k", "a*"), count("k", "<>apple"), count("k", None), count("v", 5), count("v", "<>5"), count("v", ">=6"), count("k", "Apple")] == [2, 3, 1, 1, 3, 1, 1]
    assert [count("k", "<m"), count("k", "<> apple "), count("k", "=b*"), count("k", "[ab]*y")] == [3, 3, 0, 1]


def _filtered(spark, data, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r["i"] for r in filters.auto_filter(df, {"v": f}).orderBy("i").collect()]


def test_filters(spark):
    C, T = filters.Custom, filters.Top
    assert _filtered(spark, [5.0, 15.0, 25.0], "double", C([(">", 10)])) == [1, 2]
    assert _filtered(spark, [5.0, 15.0, 25.0, 50.0], "double", C([(">", 10), ("<", 30)], both=True)) == [1, 2]
    assert _filtered(spark, ["apple", "banana", "apricot"], "string", C([("=", "ap*")])) == [0, 2]
    assert _filtered(spark, [10.0, 50.0, 20.0, 40.0], "double", T(2)) == [1, 3]
    assert _filtered(spark, [1.0, 2.0, 3.0, 4.0], "double", T(50, percent=True, bottom=True)) == [0, 1]
    assert _filtered(spark, [1.0, 1.0, 3.0], "double", T(0)) == [] and _filtered(spark, [3.0, 3.0, 1.0], "double", T(1)) == [0, 1]
    assert _filtered(spark, ["x", None, "Y"], "string", filters.Values(["y"], blank=True)) == [1, 2]
    assert _filtered(spark, [date(2024, 5, 11), date(2024, 5, 12), date(2024, 5, 18), date(2024, 5, 19)], "date", filters.Dynamic("thisWeek", date(2024, 5, 15))) == [1, 2]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([10.0, None, 50.0, 20.0])], "i int, v double")
    assert [r["i"] for r in filters.sort_rows(df, [("v", True)]).collect()] == [1, 2, 3, 0] and [r["i"] for r in filters.sort_rows(df, [("v", False)]).collect()] == [0, 3, 2, 1]


def test_pivot(spark):
    df = spark.createDataFrame([("North", "Q1", 100.0), ("North", "Q2", 150.0), ("South", "Q1", 450.0), ("South", "Q1", None)], "region string, quarter string, revenue double")
    cells = {(r[0], r[1]): r[2] for r in pivot.pivot(df, pivot.PivotSpec(["region"], [("revenue", "sum")], ["quarter"])).collect()}
    assert cells == {("North", "Q1"): 100.0, ("North", "Q2"): 150.0, ("South", "Q1"): 450.0}
    assert {r[0]: r[1] for r in pivot.pivot(df, pivot.PivotSpec(["quarter"], [("revenue", "stdDev")])).collect()}["Q2"] == 0.0
    with pytest.raises(ValueError):
        pivot.PivotSpec(["a"], [("b", "sum")], ["a"])
    assert [len(pivot.date_labels(by, "a", "b")) for by in ("months", "quarters", "days")] == [14, 6, 33]
    half = spark.createDataFrame([(v,) for v in (0.2, 0.7, 2.0, 1.9)], "v double").select(pivot.group_range(F.col("v"), 0, 2, 0.5))
    assert [r[0] for r in half.collect()] == ["0-0.5", "0.5-1", "1.5-2", "1.5-2"] and pivot.range_labels(0, 2, 0.5)[1:3] == ["0-0.5", "0.5-1"] and pivot.range_labels(0, 25, 10) == ["<0", "0-9", "10-19", "20-25", ">25"]
    many = spark.range(300).selectExpr("id", "concat('t', id % 9) AS t")
    assert pivot.shared_items(many, "id").count() == 0 and pivot.shared_items(many, "t", "id").count() == 9
    assert [r[0] for r in spark.createDataFrame([(v,) for v in (-1.0, 0.0, 9.0, 95.0, 101.0)], "v double").select(pivot.group_range(F.col("v"), 0, 100, 10)).collect()] == ["<0", "0-9", "0-9", "90-99", ">100"]


def test_nearest_lookups_over_many_partitions(spark):
    left = spark.range(500).selectExpr("id", "cast(id * 3 AS double) AS k")
    table = spark.range(90).selectExpr("id AS p", "cast(id * 17 AS double) AS t")
    for larger in (False, True):
        got = {r["id"]: r["v"] for r in lookup.nearest(left, "k", table, "t", "t", "p", "v", larger=larger).collect()}
        keys = [17.0 * i for i in range(90)]
        want = {i: (min((x for x in keys if x >= 3 * i), default=None) if larger else max((x for x in keys if x <= 3 * i), default=None)) for i in range(500)}
        assert got == want


def test_profile(spark):
    df = spark.createDataFrame([("1", "x", None, "1.5"), ("2", "x", None, "a"), ("3", "y", None, "2"), ("4", "x", None, None)], "a string, b string, c string, d string")
    got = {r["name"]: (r["type"], r["null_count"], r["unique_count"], r["cardinality"]) for r in profile.profile(df).collect()}
    assert got == {"a": ("int", 0, 4, "unique"), "b": ("string", 0, 2, "categorical"), "c": ("empty", 4, 0, "empty"), "d": ("mixed", 1, 3, "unique")}


def test_references():
    assert [structure.column_letter(n) for n in (1, 26, 27, 18278)] == ["A", "Z", "AA", "ZZZ"] and structure.column_number("ZZZ") == 18278
    a, b = structure.Range.parse("B2:D8"), structure.Range.parse("$C$5:F9")
    assert str(a.intersection(b)) == "C5:D8" and a.shift(1, 1).subset(structure.Range.parse("A1:Z99")) and a.disjoint(structure.Range.parse("E1"))
    assert structure.shift_formula('=SUM(A1:$A$10)&"A5"', "row", 3, 2) == '=SUM(A1:$A$12)&"A5"'
    assert structure.shift_formula("=A5+A9", "row", 5, -2) == "=#REF!+A7" and structure.translate_formula("=A1+$B$1+LOG10(C1)", 1, 1) == "=B2+$B$1+LOG10(D2)"


def test_formula_errors(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    for bad in ("=NOSUCH(A2)", "=A2+", "=(A2", "=$B$1", "=A2 # B2", "=Z2", "=Other!A2"):
        with pytest.raises(formula.UnsupportedFormula):
            formula.fill_down(df, "v", bad, "a")
    assert formula.fill_down(df, "v", '=IF(B2>=2,"y""s","n")', "a").first()["v"] == 'y"s'


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x ""y""\nz"\n007,\n')
    got = files.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in got] == [("1", 'x "y"\nz'), ("007", None)]


def test_date_formats():
    assert files.is_date_format("yyyy-mm-dd") and files.is_date_format('[$-409]d/m/yy;"day"') and not files.is_date_format('0.00" days"') and not files.is_date_format("General")


def test_stream(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "e"))
    out = stream.drain(stream.windowed(stream.stream_table(spark, str(tmp_path / "e")), "ts", ["event_type"], "value", "1 day", "1 hour"), "windows")
    plain = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").count()
    assert out.count() == plain.count() and out.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_entry_needs_all_but_the_corpus_parts(tmp_path):
    """Without the corpus parts the entry works; with them broken it doesn't."""
    root = Path(__file__).parents[1]
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    shutil.copytree(root / "gridspark", tmp_path / "gridspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    assert run("import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())").returncode == 0
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_anywhere")
    assert "no_such_module_anywhere" in run("import __spark_entry__").stderr
