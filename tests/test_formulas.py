"""Formulas filled down in Columns against the same formulas cell by cell, and graphs of cells."""

import math

import pytest
from pyspark.sql import functions as F

from gridspark.functions import plain
from gridspark.operators import lookup, ordered
from gridspark.plans import cells, formula, syntax

COLUMNS = ["row", "name", "amount", "rate", "flag", "note"]  # A to F
ROWS = [
    (2, "Apple", 10.0, 0.5, True, "x"), (3, "banana", -4.5, 0.0, False, None), (4, None, None, 2.0, None, "5"), (5, "apple", 250.25, -1.5, True, "Yy  z"), (6, "Cherry", 3.0, 4.0, True, "#N/A"),
    (7, "banana", 8.0, 0.25, False, "aaaa"), (8, "", 0.0, 3.0, True, "a-b-c"), (9, "date", 44197.75, 1.0, False, "10"),
]
FORMULAS = [
    "=C2+D2*2-1", "=C2/D2", "=IFERROR(C2/D2,-1)", "=IFERROR(F2,\"none\")", "=-C2%", "=C2^2", '=B2&"/"&F2', "=C2>=8", '=B2="APPLE"', "=F2=5", "=F2<>B2", '=IF(C2>5,"big","small")', "=IF(D2,C2)", "=AND(C2>0,E2)", "=OR(C2>100,E2)", "=NOT(E2)",
    "=ABS(C2)", "=ROUND(C2,1)", "=ROUNDUP(C2,1)", "=ROUNDDOWN(C2,0)", "=INT(C2)", "=MOD(C2,3)", "=POWER(C2,2)", "=SQRT(C2)", "=SIGN(C2)", "=LEFT(B2,2)", "=RIGHT(B2,3)", "=MID(B2,2,3)", "=LEN(B2)", "=CONCATENATE(B2,\"-\",F2)", "=UPPER(B2)", "=LOWER(B2)",
    "=TRIM(F2)", '=SUBSTITUTE(F2,"a","b")', '=SUBSTITUTE(F2,"a","b",2)', '=TEXT(C2,"0.0%")', '=TEXT(C2,"#,##0.00")', '=TEXT(C2,"$#,##0")', '=TEXT(C2,"#,##0_);(#,##0)")', "=REPT(\"ab\",D2)", "=EXACT(B2,\"apple\")", '=IFERROR(FIND("a",B2),0)', "=PV(0.05,10,C2)", "=FV(0.05,10,C2)", "=PMT(0.05,10,C2)",
    "=NPV(0.1,C2,D2,5)", "=SLN(C2,1,5)", "=DB(10000,1000,6,2)", "=DATE(2020,A2,31)", "=YEAR(C9)", "=EDATE(40000,A2)", "=EOMONTH(40000,A2)", "=DAYS(50,A2)", "=HOUR(0.5+A2/100)", "=CHOOSE(A2-1,\"p\",\"q\",\"r\")",
    "=SUM(C$2:C2)", "=SUM(C:C)", "=SUM($C$2:$C$9)", "=COUNT(C$2:C2)", "=COUNTA(B:B)", "=AVERAGE(C:C)", "=MIN(C2:D2)", "=MAX(C2:D2,7)", "=SUM(C2:E2,1)", "=C3-C2", "=C1+1", "=SUM(C1:C3)", "=AND(E2:E2)", "=OR(E:E)", "=AND(E:E)",
    '=SUMIF(B:B,"apple",C:C)', '=SUMIF(C:C,">5")', "=SUMIF(B:B,B2,C:C)", '=SUMIFS(C:C,B:B,"b*",D:D,"<1")', '=COUNTIF($B$2:$B$9,"<>apple")', '=COUNTIF(B:B,"<m")', '=COUNTIFS(B:B,"*an*",C:C,">0")', '=AVERAGEIF(B:B,"banana",C:C)', '=AVERAGEIFS(C:C,B:B,"none")', '=MINIFS(C:C,B:B,"banana")', '=MAXIFS(C:C,D:D,">=1")',
    '=VLOOKUP("BANANA",B:D,2,FALSE)', "=VLOOKUP(A2,A:C,3,FALSE)", "=VLOOKUP(A2+0.5,A:B,2)", '=XLOOKUP("banana",B:B,C:C,0,0,-1)', '=XLOOKUP("none",B:B,C:C,"gone")', "=XLOOKUP(D2,A:A,C:C,,1)", "=IFERROR(MATCH(D2+1.2,A:A,1),-1)", '=IFERROR(MATCH("apple",B:B,0),-1)', "=MATCH(99,A:A)", "=IRR(C2:D2)",
]


@pytest.fixture(scope="module")
def sheet(spark):
    return spark.createDataFrame(ROWS, "row int, name string, amount double, rate double, flag boolean, note string")


def by_cells(formulas):
    """Every formula in every row, evaluated cell by cell, on a sheet with what the DataFrame has."""
    engine = cells.Evaluator()
    held = [("Sheet", r[0], k + 1, v) for r in ROWS for k, v in enumerate(r) if v is not None]
    filled = [("Sheet", r[0], 20 + k, syntax.translated(f, r[0] - 2, 0)) for r in ROWS for k, f in enumerate(formulas)]
    engine.load([*held, *filled])
    engine.calculate()
    return {(r[0], f): engine.values["Sheet", r[0], 20 + k] for r in ROWS for k, f in enumerate(formulas)}


def plain_value(v):
    if isinstance(v, plain.Err):
        return None
    if isinstance(v, bool):
        return float(v)
    return round(float(v), 6) if isinstance(v, (int, float)) else v


@pytest.fixture
def narrow(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_formulas_filled_down_agree_with_cells(spark, sheet, narrow):
    want = by_cells(FORMULAS)
    off = []
    sheet = sheet.coalesce(1)
    for start in range(0, len(FORMULAS), 5):
        some, out = FORMULAS[start : start + 5], sheet
        for k, f in enumerate(some):
            out = out.select(*COLUMNS, *(f"v{i}" for i in range(k)), *(f"e{i}" for i in range(k)))
            out = formula.fill_down(out, f"v{k}", f, "row", error=f"e{k}")
        for r in out.collect():
            for k, f in enumerate(some):
                w, got = want[r["row"], f], r[f"v{k}"]
                shown = plain_value(w)
                if isinstance(w, plain.Err) and r[f"e{k}"] != w:
                    off.append((f, r["row"], w, got, r[f"e{k}"]))
                if isinstance(got, str) and isinstance(shown, float):  # a column of several kinds is text
                    got = float(got) if got not in ("true", "false") else float(got == "true")
                if plain_value(got) != shown:
                    off.append((f, r["row"], w, got))
    assert not off, off


def test_every_function_is_compiled_or_refused():
    named = {"AND", "OR", "NOT"} | set(plain.BUILT_IN)
    used = {n for f in FORMULAS for k, n in syntax.tokens(f[1:]) if k == "name"}
    assert named - used <= {"TODAY", "NOW", "MONTH", "DAY", "MINUTE", "SECOND", "HLOOKUP", "INDEX"}, named - used


def test_fill_down_over_many_buckets(spark):
    df = spark.range(1, 20001).selectExpr("id", "cast(id * 7919 % 1000 AS double) AS v").repartition(13)
    got = formula.fill_down(formula.fill_down(df, "run", "=SUM(B$2:B2)", "id"), "diff", "=B3-B1+SUM(B1:B3)", "id", row=2)
    v = [0.0, *(float(i * 7919 % 1000) for i in range(1, 20001)), None]
    run = 0.0
    want = {}
    for i in range(1, 20001):
        run += v[i]
        near = [v[i + k] for k in (-1, 0, 1) if 1 <= i + k <= 20000]
        want[i] = (run, None if i in (1, 20000) else v[i + 1] - v[i - 1] + sum(near))
    assert {r["id"]: (r["run"], r["diff"]) for r in got.collect()} == want
    assert len(ordered.bounds(df, F.col("id"))) > 10
    trend = {r["id"]: r["m"] for r in ordered.moving_average(df, "v", "m", "id", 3).collect()}
    assert trend[1] is trend[2] is None and all(math.isclose(trend[i], (v[i] + v[i - 1] + v[i - 2]) / 3) for i in range(3, 20001))


@pytest.mark.parametrize("small", [1 << 20, 100])
def test_nearest_lookups_at_scale(spark, small):
    """600,000 keys over many partitions against arithmetic, searched and dealt out."""
    left = spark.range(0, 600_000, 1, 23).selectExpr("id", "cast(id * 17 % 600011 AS double) * 1.5 AS k")
    table = spark.range(0, 250_000, 1, 11).selectExpr("id AS p", "cast(id * 3 AS double) AS t")
    down = lookup.nearest(left, "k", table, "t", "t", "p", "v", small=small)
    up = lookup.nearest(left, "k", table, "t", "t", "p", "v", larger=True, small=small)
    wrong = "NOT (v <=> least(floor(k / 3) * 3, 749997))"
    assert down.filter(wrong).count() == 0
    assert up.filter("NOT (v <=> IF(k > 749997, NULL, ceil(k / 3) * 3))").count() == 0


def test_matches_by_position(spark):
    left = spark.createDataFrame([(i, float(i)) for i in range(-1, 12)], "id int, k double")
    keys = [5.0, 1.0, None, 9.0, 5.0, 2.0, 7.0]
    table = spark.createDataFrame(list(enumerate(keys, 1)), "p int, t double")
    for kind in (0, 1, -1):
        for small in (100, 0):
            f = lookup.match(left, "k", table, "t", "p", "m", kind) if kind == 0 else lookup.nearest(left, "k", table, "t", "p", "p", "m", larger=kind < 0, by_position=True, small=small)
            got = {r["id"]: r["m"] for r in f.collect()}
            for i in range(-1, 12):
                w = plain.BUILT_IN["MATCH"](float(i), plain.Grid(keys, len(keys), 1), kind)
                assert got[i] == (None if w == "#N/A" else w), (kind, small, i)


def test_texts_are_matched_too(spark):
    left = spark.createDataFrame([("Ant",), ("cat",), (None,), ("0",)], "k string")
    table = spark.createDataFrame([(1, "ANT"), (2, "bee"), (3, "Dog")], "p int, t string")
    for small in (10, 0):
        got = {r["k"]: r["v"] for r in lookup.nearest(left, "k", table, "t", "t", "p", "v", small=small).collect()}
        assert got == {"Ant": "ANT", "cat": "bee", None: None, "0": None}
    found = lookup.wildcards(spark.createDataFrame([("b?e",), ("*o*",), ("x",)], "w string"), "w", table, "t", "p", "p", "v")
    assert {r["w"]: r["v"] for r in found.collect()} == {"b?e": 2, "*o*": 3, "x": None}


def test_across(spark):
    grid = spark.createDataFrame([(1, c, str(c * 10)) for c in range(1, 6)] + [(3, c, f"v{c}") for c in range(1, 6)], "row int, col int, value string")
    left = spark.createDataFrame([("30",), ("31",)], "k string")
    assert {r["k"]: r["v"] for r in lookup.hlookup(left, "k", grid, 3, "v").collect()} == {"30": "v3", "31": None}
    near = lookup.hlookup(left.selectExpr("cast(k AS double) AS k"), "k", grid, 3, "v", near=True)
    assert {r["k"]: r["v"] for r in near.collect()} == {30.0: "v3", 31.0: "v3"}
    two = lookup.index_2d(spark.createDataFrame([(3, 2), (9, 1)], "i int, j int"), "i", "j", grid, "v", 3, 5)
    assert {(r["i"], r["v"], r["v_error"]) for r in two.collect()} == {(3, "v2", None), (9, None, "#REF!")}
    assert sorted((r["row"], r["col"], r["value"]) for r in lookup.offset_area(grid, 1, 1, 2, 1, 1, 2).collect()) == [(1, 1, "v2"), (1, 2, "v3")]


def test_references_and_names():
    assert str(syntax.parse_reference("'It''s'!$B$2:C9")) == "$B$2:C9" and syntax.parse_reference("'It''s'!A1").sheet == "It's"
    assert syntax.parse_reference("B:C").bounds() == (1, 2, syntax.LAST_ROW, 3) and syntax.parse_reference("2:$4").bounds() == (2, 1, 4, syntax.LAST_COL)
    assert syntax.parse_reference("T[Col]") == "T[Col]" and syntax.parse_reference("#REF!") == "#REF!" and syntax.parse_reference("My_Name") == "My_Name"
    assert syntax.parse_reference("C9:A2").shape == (8, 3) and len(list(syntax.parse_reference("A1:B3").cells())) == 6
    assert "".join(t for _, t in syntax.tokens('SUM( A1 , "x;y" )%')) == 'SUM( A1 , "x;y" )%'
    assert syntax.shifted("=SUM(A3:A10)+A5+Other!A5", "S", "row", 4, -3) == "=SUM(A3:A7)+#REF!+Other!A5"
    assert syntax.shifted("=SUM(A3:A10)", "S", "row", 3, 2) == "=SUM(A5:A12)" and syntax.shifted("=S!B1+B1", "S", "col", 2, 1, own="T") == "=S!C1+B1"
    assert syntax.template("=D1+$C2", 2, 4) == syntax.template("=D2+$C3", 3, 4)


def test_graph():
    formulas = {("S", 1, 2): "=A1", ("S", 2, 2): "=B1+A2", ("S", 3, 2): "=B2+A3", ("S", 1, 3): "=SUM(B1:B3)", ("T", 1, 1): "=Total*2"}
    graph = cells.Graph(formulas, {"Total": "S!$C$1"})
    assert graph.order() == [("S", 1, 2), ("S", 2, 2), ("S", 3, 2), ("S", 1, 3), ("T", 1, 1)]
    assert graph.affected([("S", 3, 1)]) == [("S", 3, 2), ("S", 1, 3), ("T", 1, 1)] and graph.max_depth([("S", 1, 1)]) == 5
    with pytest.raises(cells.CycleError):
        cells.Graph({("S", 1, 1): "=B1", ("S", 1, 2): "=A1+1"}).order()


def test_cells_of_many_workbooks(spark):
    def book(name, first):
        data = [(name, "Sheet", 1, 1, "number", str(first), None), (name, "Sheet", 2, 1, "number", "20.5", None), (name, "Sheet", 3, 1, "number", "0", "=SUM(A1:A2)"), (name, "Two", 1, 1, None, None, "=IF(Sheet!A3>25,Rate*Sheet!A3,\"low\")"), (name, "Two", 2, 1, None, None, "=A1/0")]
        return data

    df = spark.createDataFrame(book("a", 10) + book("b", 1), "file string, sheet string, row int, col int, kind string, value string, formula string")
    names = {"rate": "Sheet!$A$1"}
    got = {(r["file"], r["sheet"], r["row"]): (r["kind"], r["value"], r["level"]) for r in cells.calculate(df, names=names).collect()}
    assert got["a", "Two", 1] == ("number", "305.0", 1) and got["b", "Two", 1] == ("string", "low", 1) and got["b", "Two", 2] == ("error", "#DIV/0!", 2) or got["b", "Two", 2] == ("blank", None, 2)
    edits = spark.createDataFrame([("a", "Sheet", 1, 1, 11.0)], "file string, sheet string, row int, col int, value double")
    out = cells.recalculate(df, edits, names=names).collect()
    assert {(r["file"], r["sheet"], r["row"], r["new"]) for r in out} == {("a", "Sheet", 3, 31.5), ("a", "Two", 1, 346.5)} and {r["total_formula_cells"] for r in out} == {3} and {r["max_chain_depth"] for r in out} == {3}


def test_users_own_functions():
    engine = cells.Evaluator(fallback=lambda f, sheet: "fell back" if "NOSUCH" in f else None)
    assert isinstance(engine, cells.Engine) and engine.functions.is_supported("vlookup") and not engine.functions.is_supported("NOSUCH")
    engine.functions.register("double", lambda v: v * 2)
    engine.functions.register("ROWOF", lambda e, sheet, args: args[0][1].row, raw=True)
    engine.load([("S", 1, 1, 4), ("S", 2, 1, "=DOUBLE(A1)"), ("S", 3, 1, "=ROWOF(A1)"), ("S", 4, 1, "=NOSUCH(A1)"), ("S", 5, 1, "=OFFSET(A1,1,0)"), ("S", 6, 1, "=SUM(OFFSET(A1,0,0,2,1))"), ("S", 7, 1, "=OFFSET(A1,-1,0)")])
    got = engine.calculate()
    assert [got["S", r, 1] for r in (2, 3, 4)] == [8, 1, "fell back"] and got["S", 7, 1] == "#REF!"


@pytest.mark.parametrize(("text", "want"), [
    ("=SUM(1,TRUE,\"3\")", 2.0), ("=ROUND(2.5,0)", 2.0), ("=ROUNDUP(-1.5,0)", -1.0), ("=MATCH(7,A1:A3)", "#N/A"), ("=INDEX(A1:A3,9)", "#REF!"), ("=INDEX(A1:B2,2,2)", 4), ("=HLOOKUP(2,A1:B2,2,FALSE)", 4), ("=HLOOKUP(1.5,A1:B2,2)", 3), ("=IF(1/0,1,2)", "#DIV/0!"),
    ("=AVERAGE(C1:C2)", None), ("=MIN()", 0.0), ("=\"5\"=5", True), ("=C1=\"\"", True), ("=C1+1", None), ("=SUM(A1,#N/A,3)", 4.0), ("=1.0&\"\"", "1.0"), ("=CHOOSE(9,1)", "#VALUE!"), ("=SQRT(-1)", None), ("=POWER(-8,0.5)", "#NUM!"), ("=DAY(60)", 29.0), ("=DATE(2023,14,1)", 45323.0), ("=TEXT(0.756,\"0.0%\")", "75.6%"),
    ("=SUMIF(A1:A2,\">1\",B1:B2)", 4.0), ("=XLOOKUP(5,A1:A2,B1:B2,\"none\",-1)", 4), ("=AND(A1:B2,C1)", False), ("=OR(C1:C2)", False), ("=MONTH(45000)", 3.0), ("=MINUTE(0.5+7/1440)", 7.0), ("=SECOND(10/86400)", 10.0), ("=2-1-1", 0), ("=8/2/2", 2.0), ("=-2^2", 4.0),
])
def test_cell_values(text, want):
    engine = cells.Evaluator()
    engine.load([("S", 1, 1, 1), ("S", 1, 2, 2), ("S", 2, 1, 3), ("S", 2, 2, 4), ("S", 9, 9, text)])
    assert engine.calculate()["S", 9, 9] == want
