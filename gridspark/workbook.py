"""A workbook as a catalogue of lazy sheets: cells in long form, rows as tables, names and tables, edits of its shape, formulas
and profiles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.formats import category, display
from .functions.plain import Err
from .operators import profile, structure
from .plans import cells as graph
from .plans.syntax import Area, Cell, parse_reference, renamed
from .sources import files, sinks
from .sources.xlsx import Details, Package

#: Rows beyond which row scans say they are streams (a fixed value).
STREAM_ROWS = 50_000


def open_workbook(spark: SparkSession, path: str, read_only: bool = False, data_only: bool = False, permissive: bool = False, password: str | None = None, modify: bool = False, keep_vba: bool = False) -> Workbook:
    """A workbook on a path that every executor can open. XLSB and XLS are for reading only; encrypted files aren't read."""
    kind, _, local = files.classify(path)
    if kind == "encrypted" or password is not None:
        raise files.UnreadableWorkbook("encrypted workbooks aren't read: decrypt the file first")
    if kind in ("xls", "xlsb") and (modify or read_only or keep_vba):
        raise files.UnreadableWorkbook(f"{kind} workbooks are read whole, and not modified")
    if kind not in ("xlsx", "xls", "xlsb", "ods"):
        raise files.UnreadableWorkbook(f"{path}: not a workbook")
    spark.dataSource.register(files.XlsxSource)
    whole = spark.read.format("xlsx").option("permissive", str(permissive).lower()).load(local)
    if kind == "xlsx":
        package = Package(local, permissive=permissive)
        names, defined, details = list(package.sheets), package.defined, {n: package.details(n) for n in package.sheets}
    else:
        names, defined, details = [r[0] for r in whole.groupBy("sheet").agg(F.min(F.monotonically_increasing_id()).alias("at")).orderBy("at").select("sheet").collect()], {}, {}
    sheets = {}
    for n in names:
        own = spark.read.format("xlsx").option("sheet", n).option("permissive", str(permissive).lower()).load(local)
        sheets[n] = Sheet(n, own, details.get(n, Details()), data_only)
    return Workbook(spark, sheets, dict(defined), path)


def workbook_of(spark: SparkSession, cells: DataFrame, names: list[str], defined: dict[str, str] | None = None) -> Workbook:
    """A workbook of sheets in long form."""
    return Workbook(spark, {n: Sheet(n, cells.filter(F.col("sheet") == n)) for n in names}, defined or {})


@dataclass
class Sheet:
    """One sheet. cells: file, sheet, row, col, kind, value, formula and, from files, formula_kind and number_format."""

    name: str
    cells: DataFrame
    details: Details = field(default_factory=Details)
    data_only: bool = False

    def records(self, area: str | None = None, include_empty: bool = False) -> DataFrame:
        """A row for each cell: row, col, coordinate, data_type, value, formula, number_format; include_empty: of every cell
        within the bounds."""
        got = self.within(area).withColumn("coordinate", F.concat(structure.letters(F.col("col")), F.col("row").cast("string")))
        kind = F.when(F.col("formula").isNotNull() & F.lit(not self.data_only), F.lit("formula")).otherwise(F.when(F.col("kind") == "bool", "boolean").when(F.col("kind").isin("date", "time"), "datetime").otherwise(F.col("kind")))
        shown = F.col("number_format") if "number_format" in got.columns else F.lit(None).cast("string")
        out = got.select("row", "col", "coordinate", kind.alias("data_type"), "value", "formula", shown.alias("number_format"))
        if not include_empty:
            return out
        top, left, bottom, right = self.bounds_of(area)
        every = self.cells.sparkSession.range(top, bottom + 1).select(F.col("id").cast("int").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(left), F.lit(right))))
        return every.join(out, ["row", "col"], "left").withColumns({"data_type": F.coalesce("data_type", F.lit("blank")), "coordinate": F.concat(structure.letters(F.col("col")), F.col("row").cast("string"))})

    def bounds_of(self, area: str | None) -> tuple[int, int, int, int]:
        if area is None:
            return self.dimensions()
        ref = parse_reference(area)
        return ref.bounds() if isinstance(ref, Area) else (ref.row, ref.col, ref.row, ref.col)

    def within(self, area: str | None) -> DataFrame:
        """The cells of A1, A1:B2, A:B or 1:3."""
        if area is None:
            return self.cells
        top, left, bottom, right = self.bounds_of(area)
        return self.cells.filter(F.col("row").between(top, bottom) & F.col("col").between(left, right))

    def dimensions(self) -> tuple[int, int, int, int]:
        """The first and last row and column with a cell: top, left, bottom, right; (1, 1, 1, 1) of an empty sheet."""
        r = self.cells.agg(F.min("row"), F.min("col"), F.max("row"), F.max("col")).first()
        return (1, 1, 1, 1) if r[0] is None else tuple(r)

    def dimension(self) -> str:
        top, left, bottom, right = self.dimensions()
        return str(structure.Range(top, left, bottom, right))

    def is_stream(self) -> bool:
        return self.dimensions()[2] > STREAM_ROWS

    def rows(self, min_row: int = 1, max_row: int | None = None, min_col: int = 1, max_col: int | None = None, fill: bool = True) -> DataFrame:
        """A row for each sheet row: row and values (an array of texts), blank cells null, short rows padded; fill: rows without
        a cell too."""
        _, _, bottom, right = self.dimensions()
        bottom, right = max_row or bottom, max_col or right
        inside = self.cells.filter(F.col("row").between(min_row, bottom) & F.col("col").between(min_col, right))
        by = inside.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
        if fill:
            by = self.cells.sparkSession.range(min_row, bottom + 1).select(F.col("id").cast("int").alias("row")).join(by, "row", "left")
        at = F.sequence(F.lit(min_col), F.lit(right))
        return by.select("row", F.transform(at, lambda c: F.try_element_at(F.coalesce("m", F.create_map().cast("map<int,string>")), c)).alias("values"))

    def columns(self, area: str | None = None) -> DataFrame:
        """A row for each column: col and its values by row, missing rows blank."""
        top, left, bottom, right = self.bounds_of(area)
        by = self.within(area).groupBy("col").agg(F.map_from_entries(F.collect_list(F.struct("row", "value"))).alias("m"))
        every = self.cells.sparkSession.range(left, right + 1).select(F.col("id").cast("int").alias("col")).join(by, "col", "left")
        return every.select("col", F.transform(F.sequence(F.lit(top), F.lit(bottom)), lambda r: F.try_element_at(F.coalesce("m", F.create_map().cast("map<int,string>")), r)).alias("values"))

    def headers(self, row: int | None = None) -> list[str]:
        """The first row's texts; a blank is ''."""
        top, left, _, right = self.dimensions()
        found = {r["col"]: r["value"] for r in self.cells.filter(F.col("row") == (row or top)).collect()}
        return [found.get(c) or "" for c in range(left, right + 1)]

    def table(self, area: str | None = None, header: bool = True) -> DataFrame:
        """The sheet or a part of it as a table, with `row`: names from its first row, columns typed by what they hold."""
        top, left, bottom, right = self.bounds_of(area)
        found = {r["col"]: r["value"] for r in self.cells.filter(F.col("row") == top).collect()} if header else {}
        names = unique([found.get(c) or structure.column_letter(c) for c in range(left, right + 1)])
        body = self.within(area).filter(F.col("row") >= top + header)
        kinds = {r["col"]: r["kinds"] for r in body.filter("kind <> 'blank'").groupBy("col").agg(F.collect_set("kind").alias("kinds")).collect()}
        casts = {"number": "double", "bool": "boolean", "date": "date", "datetime": "timestamp_ntz"}
        cast = lambda k: casts.get(kinds.get(k, [""])[0], "string") if len(kinds.get(k, [])) == 1 else "string"
        picks = [F.max(F.when(F.col("col") == left + k, F.col("value"))).try_cast(cast(left + k)).alias(n) for k, n in enumerate(names)]
        return body.groupBy("row").agg(*picks)

    def to_pandas(self, area: str | None = None, header: bool = True) -> pd.DataFrame:
        return self.table(area, header).orderBy("row").drop("row").toPandas()

    def cached_values(self) -> DataFrame:
        """row, col, value of formula cells, as the file has them."""
        return self.cells.filter("formula IS NOT NULL OR formula_kind = 'cached'").select("row", "col", "value")

    def array_formulas(self) -> DataFrame:
        """row, col, formula_kind, formula of array and data-table formulas and of the cells they spill into."""
        return self.cells.filter("formula_kind IN ('array', 'data_table', 'spill')").select("row", "col", "formula_kind", "formula")

    def visible(self) -> DataFrame:
        """Cells outside hidden rows and columns."""
        d = self.details
        return self.cells.filter(~F.col("row").isin(d.hidden_rows) & ~F.col("col").isin(d.hidden_columns)) if d.hidden_rows or d.hidden_columns else self.cells

    def profile(self) -> DataFrame:
        """Columns as the profile has them, with the number format first met and samples."""
        names = self.headers()
        out = profile.profile(self.table().drop("row"), order=None)
        formats = {names[r["col"] - 1]: r["f"] for r in self.cells.filter("row > 1 AND value IS NOT NULL").groupBy("col").agg(F.min_by("number_format", "row").alias("f")).collect() if r["col"] <= len(names)} if "number_format" in self.cells.columns else {}
        known = F.create_map(*(F.lit(x) for kv in formats.items() for x in kv)) if formats else F.create_map().cast("map<string,string>")
        return out.withColumn("format", F.try_element_at(known, F.col("name")))

    def classified(self) -> dict:
        top, left, bottom, right = self.dimensions()
        n = self.cells.filter("value IS NOT NULL").count()
        return {"rows": bottom if n else 0, "cols": right if n else 0, "class": profile.class_of(bottom if n else 0, right if n else 0, n)}


def unique(names: list[str]) -> list[str]:
    """Names with a number where one comes again, in any case."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n.lower(), 0)
        seen[n.lower()] = k + 1
        out.append(n if not k else f"{n}_{k + 1}")
    return out


@dataclass
class Workbook:
    spark: SparkSession
    sheets: dict[str, Sheet]
    defined: dict[str, str]
    path: str = ""

    @property
    def sheetnames(self) -> list[str]:
        return list(self.sheets)

    def __getitem__(self, name: str) -> Sheet:
        return self.sheets[name]

    def cells(self) -> DataFrame:
        """All sheets' cells."""
        found = [s.cells.withColumn("sheet", F.lit(s.name)) for s in self.sheets.values()]
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    def named(self, name: str) -> DataFrame:
        """The cells that a defined name, or a table of that name, stands for, in any case."""
        for sheet in self.sheets.values():
            for t in sheet.details.tables:
                if t.name.lower() == name.lower():
                    return sheet.table(t.ref, t.header_row)
        text = next((v for k, v in self.defined.items() if k.lower() == name.lower()), None)
        if text is None:
            raise KeyError(f"no name {name!r}")
        ref = parse_reference(text.removeprefix("="))
        if not isinstance(ref, (Cell, Area)):
            raise KeyError(f"{name!r} is no range: {text}")
        return self.sheets[ref.sheet].within(str(ref))

    def views(self) -> list[str]:
        """Temporary views of all sheets and tables, by name."""
        made = []
        for sheet in self.sheets.values():
            sheet.table().createOrReplaceTempView(f"`{sheet.name}`")
            made.append(sheet.name)
            for t in sheet.details.tables:
                sheet.table(t.ref, t.header_row).createOrReplaceTempView(f"`{t.name}`")
                made.append(t.name)
        return made

    # The order and names of sheets

    def create_sheet(self, name: str = "Sheet", index: int | None = None) -> Sheet:
        taken, base, k = {n.lower() for n in self.sheets}, name, 0
        while name.lower() in taken:
            k += 1
            name = f"{base}{k}"
        empty = self.spark.createDataFrame([], "file string, sheet string, row int, col int, kind string, value string, formula string, formula_kind string, number_format string")
        self._insert(Sheet(name, empty), len(self.sheets) if index is None else index)
        return self.sheets[name]

    def _insert(self, sheet: Sheet, at: int) -> None:
        items = [(n, s) for n, s in self.sheets.items() if n != sheet.name]
        items.insert(max(0, min(at, len(items))), (sheet.name, sheet))
        self.sheets = dict(items)

    def move_sheet(self, name: str, offset: int) -> None:
        """A sheet so many places on, held within the first and the last."""
        self._insert(self.sheets[name], self.sheetnames.index(name) + offset)

    def remove_sheet(self, name: str) -> None:
        if len(self.sheets) == 1:
            raise ValueError("a workbook needs a sheet")
        del self.sheets[name]
        self.defined = {k: v for k, v in self.defined.items() if not k.startswith(f"{name}!")}

    def rename_sheet(self, old: str, new: str) -> None:
        """Another name for a sheet: formulas and defined names follow."""
        if new.lower() in {n.lower() for n in self.sheets if n != old}:
            raise ValueError(f"there is a sheet {new!r}")
        rewrite = F.udf(lambda f: renamed(f, old, new) if f else f, "string")
        self.sheets = {new if n == old else n: replace(s, name=new if n == old else n, cells=s.cells.withColumn("formula", rewrite("formula")).withColumn("sheet", F.lit(new if n == old else n))) for n, s in self.sheets.items()}
        self.defined = {k.replace(f"{old}!", f"{new}!") if k.startswith(f"{old}!") else k: renamed(v, old, new) for k, v in self.defined.items()}

    def copy_worksheet(self, name: str, new: str | None = None) -> Sheet:
        """A copy of a sheet at the end, its tables renamed."""
        new = new or f"{name} Copy"
        source = self.sheets[name]
        tables = [replace(t, name=f"{t.name}_{len(self.sheets) + 1}") for t in source.details.tables]
        self._insert(Sheet(new, source.cells.withColumn("sheet", F.lit(new)), replace(source.details, tables=tables)), len(self.sheets))
        return self.sheets[new]

    # Formulas

    def calculate(self, make: Callable[[], graph.Evaluator] = graph.Evaluator) -> DataFrame:
        """Values of all formula cells: see cells.calculate."""
        return graph.calculate(self._book(), "file", self.defined, make)

    def recalculate(self, changes: dict[str, float], tolerance: float = 1e-10) -> DataFrame:
        """What changes when cells (Sheet!A1) do: see cells.recalculate."""
        first = self.sheetnames[0]
        rows = [("", *graph.key_of(k, first), float(v)) for k, v in changes.items()]
        return graph.recalculate(self._book(), self.spark.createDataFrame(rows, "file string, sheet string, row int, col int, value double"), "file", tolerance, self.defined)

    def _book(self) -> DataFrame:
        return self.cells().withColumn("file", F.lit("")).select("file", "sheet", "row", "col", "kind", "value", "formula")

    def save(self, path: str) -> None:
        """All sheets as one XLSX file, row by row; rows come to the driver as a stream."""
        def rows(sheet: Sheet):
            held, at = {}, None
            for c in sheet.cells.select("row", "col", "kind", "value", "formula").orderBy("row", "col").toLocalIterator():
                if at is not None and c["row"] != at:
                    yield files.row_xml([held.get(k) for k in range(1, max(held) + 1)], at).encode()
                    held = {}
                at = c["row"]
                v = graph.typed(c["kind"], c["value"], c["formula"])
                held[c["col"]] = v
            if held:
                yield files.row_xml([held.get(k) for k in range(1, max(held) + 1)], at).encode()

        files.write_package(path, {n: rows(s) for n, s in self.sheets.items()}, self.defined)

    # Commands

    def map(self) -> list[dict]:
        """Each sheet's size, class, headers and tables."""
        return [{"sheet": n} | s.classified() | {"headers": s.headers(), "tables": [t.name for t in s.details.tables]} for n, s in self.sheets.items()]

    def peek(self, sheet: str | None = None, n: int = 50, form: str = "box", width: int = 30) -> str:
        """The first rows of a sheet as text, csv, json or a box; only boxes have a cap on rows (0: none)."""
        s = self.sheets[sheet or self.sheetnames[0]]
        header, formats, rows = s.headers(), [], {}
        top, left, _, right = s.dimensions()
        body = s.cells.filter(F.col("row") > top).orderBy("row", "col")
        total = body.agg(F.max("row")).first()[0] or top
        wanted = body if form != "box" or not n else body.filter(F.col("row") <= top + n)
        found: dict[int, str] = {}
        for c in wanted.toLocalIterator():
            v = graph.typed(c["kind"], c["value"], None)
            rows.setdefault(c["row"], {})[c["col"]] = Err(v) if c["kind"] == "error" else v
            found.setdefault(c["col"], c["number_format"] if "number_format" in s.cells.columns else None)
        formats = [found.get(k) for k in range(left, right + 1)]
        grid = [[rows.get(r, {}).get(k) for k in range(left, right + 1)] for r in range(top + 1, (total if form != "box" or not n else min(total, top + n)) + 1)]
        if form == "text":
            return sinks.as_text(header, grid, formats)
        if form == "csv":
            return sinks.as_csv(header, grid, formats)
        if form == "json":
            return sinks.as_json(s.name, header, grid)
        text = sinks.boxed(header, grid, 0, width, formats)
        return text + (f"{len(grid)} of {total - top} rows shown\n" if n and total - top > len(grid) else "")

    def agent(self, max_tokens: int, count: Callable[[str], int] = lambda text: -(-len(text) // 4)) -> str:
        """A briefing within a number of tokens: an overview, then the largest data sheet's header, columns, names, first and
        last rows and samples; a section that doesn't fit is left out whole. count: tokens of a text (default: a fourth of its
        characters)."""
        maps = self.map()
        data = [m for m in maps if m["class"] == "data"]
        most = max((m["rows"] for m in data), default=0)
        target = next((m for m in reversed(data) if m["rows"] == most), maps[0])
        sheet = self.sheets[target["sheet"]]
        out = "Sheets: " + "; ".join(f"{m['sheet']} ({m['rows']} x {m['cols']}, {m['class']})" for m in maps) + "\n"
        top, left, bottom, right = sheet.dimensions()
        picks = profile.picks(bottom - top, 8, 3, 2)
        wanted = sorted({*range(top + 1, min(top + 3, bottom) + 1), *range(max(top + 1, bottom - 1), bottom + 1), *(top + p for p in picks)})
        rows: dict[int, dict[int, str]] = {}
        for c in sheet.cells.filter(F.col("row").isin(wanted)).collect():
            shown = display(graph.typed(c["kind"], c["value"], None), c["number_format"] if "number_format" in sheet.cells.columns else None)
            rows.setdefault(c["row"], {})[c["col"]] = shown
        line = lambda r: " | ".join(rows.get(r, {}).get(k, "") for k in range(left, right + 1))
        columns = [f"{r['name']}: {r['type']}, {r['cardinality']}, {r['null_count']} blank, {category(r['format'])}" for r in sheet.profile().orderBy("name").collect()]
        sections = [
            "Header: " + " | ".join(target["headers"]), "Columns: " + "; ".join(columns), "Names: " + "; ".join(f"{k} = {v}" for k, v in list(self.defined.items())[:8]) if self.defined else "",
            "First rows:\n" + "\n".join(line(r) for r in range(top + 1, min(top + 3, bottom) + 1)), "Last rows:\n" + "\n".join(line(r) for r in range(max(top + 1, bottom - 1), bottom + 1)), "Samples:\n" + "\n".join(line(top + p) for p in picks) if picks else "",
        ]
        for s in filter(None, sections):
            if count(out + s + "\n") <= max_tokens:
                out += s + "\n"
        return out


def dataframe_to_rows(df: pd.DataFrame, index: bool = True, header: bool = True) -> list[list]:
    """A pandas frame as rows: headers, a blank row if there are both index and headers, then values."""
    out = []
    if header:
        levels = df.columns.nlevels
        out = [[None] * (df.index.nlevels * index) + [c[k] if levels > 1 else c for c in df.columns] for k in range(levels)]
        if index:
            out.append(list(df.index.names))
    pad = (lambda i: list(i) if isinstance(i, tuple) else [i]) if index else (lambda i: [])
    return out + [pad(i) + [None if pd.isna(v) else v for v in r] for i, r in zip(df.index, df.itertuples(index=False), strict=True)]
