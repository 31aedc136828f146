"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON. Each query runs once to warm
up and is then timed; short ones three times, of which the median counts. Workbook figures are at the sizes that published figures have."""

import json
import os
import statistics
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridspark import catalog
from gridspark.operators import pivot
from gridspark.plans import cells, syntax
from gridspark.sources import files, sinks

HEADLINE = [
    "pivot_wide", "pivot_cube_totals", "pivot_stddev", "pivot_date_group_months", "pivot_show_index", "agg_sumifs", "agg_sumifs_per_row", "filter_columns", "filter_top_n", "filter_above_avg", "filter_dyn_this_quarter", "sort_multi",
    "topk_ties", "topk_many", "lookup_vlookup_exact", "lookup_vlookup_approx", "lookup_xlookup_next_larger", "fn_text_grouped", "fn_edate", "fn_irr", "formula_fill_down", "formula_running_total", "formula_chain_total", "recalc_deltas", "profile_schema", "struct_move_range",
]


def timed(run: Callable[[], object]) -> float:
    run()
    took = []
    while len(took) < 3 and sum(took) < 2:
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return round(statistics.median(took), 3)


def workbooks(spark: SparkSession, folder: str) -> dict[str, float]:
    """Reading, writing, editing and calculating workbooks."""
    spark.dataSource.register(files.XlsxSource)
    rows = spark.range(0, 100_000, 1, 4).select(*((F.col("id") * 10 + k).alias(f"c{k}") for k in range(10)))
    path, book = f"{folder}/rows.xlsx", f"{folder}/small.xlsx"
    small = [[r * 10 + c for c in range(10)] for r in range(10_000)]
    source = spark.createDataFrame([(f"r{i % 7}", f"q{i % 4}", float(i)) for i in range(10_000)], "region string, quarter string, revenue double").cache()
    source.count()
    spec = pivot.PivotSpec(["region"], [("revenue", "sum")], ["quarter"])
    chain = [("S", 1, 1, 1), ("S", 1, 2, "=A1*1.1"), *(c for i in range(2, 252) for c in (("S", i, 1, i), ("S", i, 2, f"=A{i}*1.1"), ("S", i, 3, f"=C{i - 1}+B{i}"))), ("S", 1, 3, "=B1"), ("S", 300, 1, "=SUM(B1:B251)")]
    formulas = [f"=SUM(A{i}:B{i + 9})+$C$1*D{i}" for i in range(1, 100_001)]

    def calculated() -> None:
        engine = cells.Evaluator()
        engine.load(chain)
        engine.calculate()

    out = {
        "xlsx_write_100k_x_10": timed(lambda: rows.write.format("xlsx").mode("overwrite").save(path)),
        "xlsx_read_100k_x_10": timed(lambda: sum(1 for _ in files.read_cells(path))),
        "xlsx_scan_100k_x_10": timed(lambda: spark.read.format("xlsx").load(path).write.format("noop").mode("overwrite").save()),
        "xlsx_write_10k_x_10": timed(lambda: files.write_xlsx(book, "S", [f"c{k}" for k in range(10)], iter(small))),
        "xlsx_touch_1_cell_100k": timed(lambda: sinks.modify(path, {("Sheet", 5, 5): 1}, f"{folder}/touched.xlsx")),
        "pivot_10k_rows": timed(lambda: pivot.pivot(source, spec).collect()),
        "calculate_503_formulas": timed(calculated),
        "shift_100k_formulas": timed(lambda: [syntax.shifted(f, "S", "row", 50, 3) for f in formulas]),
    }
    source.unpersist()
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {n: timed(lambda n=n: catalog.QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()) for n in HEADLINE}
    value = round(sum(took.values()), 3)
    with tempfile.TemporaryDirectory() as folder:  # one machine's benchmark
        took |= workbooks(spark, folder)
    print(json.dumps({"metric": "headline queries", "value": value, "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
