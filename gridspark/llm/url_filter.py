"""URL filter: host and path rules, then a ratio of two character models.

URLs that a rule decides are the examples. For accepted and for rejected URLs a variable-order Markov model of characters
(Witten-Bell smoothing: each context gives its escape weight to the next shorter one, down to a uniform alphabet) is built
from one table of n-gram counts. A URL's score is the difference of its two log-likelihoods divided by its length; the
threshold is calibrated on examples held out from the counts. All of it is joins and aggregates; no Python on executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, HOT_KEYS, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"
ALPHABET = 256
#: One in so many labelled URLs calibrates the threshold instead of being counted.
CALIBRATE_ONE_IN = 5


def parse_url(url):
    """host and path columns of a url column: see filter_urls."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules: list[tuple[str, str]]):
    """The longest fitting rule and its verdict. rules: (verdict, host/path)."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda x: len(x[1])):  # the longest is tested first, so it is wrapped last
        name, slash, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(said)).otherwise(verdict)
    return found, verdict


def _grams(df: DataFrame, order: int) -> DataFrame:
    """A row for each character: the gram of order+1 characters that ends there. Digits count as one character."""
    text = F.concat(F.lit(START * order), F.translate(F.concat("host", "path"), "123456789", "000000000"), F.lit(END))
    at = F.explode(F.sequence(F.lit(1), F.length("_t") - order))
    return df.withColumn("_t", text).withColumn("_at", at).withColumn("gram", F.expr(f"substring(_t, _at, {order + 1})")).drop("_t", "_at")


def gram_scores(counts: DataFrame, order: int) -> DataFrame:
    """gram, llr: log of accepted over rejected probability of a gram's last character, from gram, a and b counts."""
    lower = None
    for k in range(order + 1):
        # Counts of each suffix of k+1 characters, joined to its context's totals and the next shorter suffix.
        own = counts.groupBy(F.expr(f"right(gram, {k + 1})").alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        contexts = own.groupBy(F.expr(f"substring(g, 1, {k})").alias("ctx")).agg(
            *(f(x) for x in "ab" for f in (lambda x: F.sum(x).alias(f"n{x}"), lambda x: F.sum((F.col(x) > 0).cast("long")).alias(f"t{x}")))
        )
        own = own.withColumn("ctx_key", F.expr(f"substring(g, 1, {k})"))
        joined = own.join(contexts, own.ctx_key == contexts.ctx)
        if lower is None:
            joined = joined.withColumn("la", F.lit(1.0 / ALPHABET)).withColumn("lb", F.lit(1.0 / ALPHABET))
        else:
            joined = joined.withColumn("s", F.expr(f"right(g, {k})")).join(lower, F.col("s") == F.col("lower_g"))
        p = {x: F.when(F.col(f"n{x}") > 0, (F.col(x) + F.col(f"t{x}") * F.col(f"l{x}")) / (F.col(f"n{x}") + F.col(f"t{x}"))).otherwise(F.col(f"l{x}")) for x in "ab"}
        made = joined.select(F.col("g"), p["a"].alias("la"), p["b"].alias("lb"))
        lower = made.withColumnRenamed("g", "lower_g")
    return made.select(F.col("g").alias("gram"), (F.log("la") - F.log("lb")).alias("llr"))


def met(rows: DataFrame, side: DataFrame, on: list[str], often) -> DataFrame:
    """rows joined to side, which has a row for each key. Keys that `often` holds for, a condition on side that a bounded
    number of them meet, are broadcast, so that a key with very many rows never fills one task."""
    hot = F.broadcast(side.filter(often))
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(side.filter(~often), on))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", order: int = 4) -> DataFrame:
    """id, host, path, rule, verdict, score for every row of pages.

    host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the
    end. A null url, or one without `://`, has both empty. The longest fitting rule decides; else the model does: block if
    the score is under the threshold. Without examples of both kinds every URL that no rule fits is allowed. Repeated rows
    come out once each. `score` is null where a rule decides. Other columns are not read."""
    host, path = parse_url(F.col(url_col).cast("string"))
    base = pages.select(F.col(id_col).alias("_gs_id"), host.alias("host"), path.alias("path"))
    found, said = rule_of(F.col("host"), F.col("path"), rules)
    judged = base.select("*", found.alias("rule"), said.alias("said"))
    held = F.crc32(F.concat("host", "path").cast("binary")) % CALIBRATE_ONE_IN == 0

    # Each distinct host and path once from here: how often it occurs is its weight.
    urls = table(judged.groupBy("host", "path", "said").agg(F.count("*").alias("n")).withColumn("held", held), "urls")
    grams = _grams(urls, order)
    counted, asks = ~F.col("held"), F.col("said").isNull() | F.col("held")
    counts = table(
        grams.groupBy("gram").agg(
            F.sum(F.when(counted & (F.col("said") == "allow"), F.col("n")).otherwise(0)).alias("a"),
            F.sum(F.when(counted & (F.col("said") == "block"), F.col("n")).otherwise(0)).alias("b"),
            F.count(F.when(asks, 1)).alias("asked"),
        ),
        "url-grams",
    )
    model = table(gram_scores(counts, order).join(counts.select(F.col("gram").alias("c_gram"), "asked"), F.col("gram") == F.col("c_gram")).filter("asked > 0").select("gram", "llr", "asked"), "url-model")
    # Only URLs that the model decides, or that calibrate it, are scored. Grams that very many URLs have are few: those are
    # broadcast, and only the others' rows are shuffled by gram.
    rows, total = model.agg(F.count("*"), F.coalesce(F.sum("asked"), F.lit(0))).first()
    asked = met(grams.filter(asks), model, ["gram"], F.lit(rows <= BROADCAST_ROWS) | (F.col("asked") >= max(1000, total // HOT_KEYS)))
    scores = table(asked.groupBy("host", "path", "said", "n").agg((F.sum("llr") / F.count("*")).alias("score")), "url-scores")
    # One row of quantiles goes to the driver.
    cut = scores.agg(
        F.expr("percentile_approx(score, 0.05, 10000) FILTER (WHERE said = 'allow')").alias("low"),
        F.expr("percentile_approx(score, 0.95, 10000) FILTER (WHERE said = 'block')").alias("high"),
        F.expr("coalesce(sum(n), 0)").alias("rows"),
    ).first()
    threshold = float("-inf") if cut.low is None or cut.high is None else (cut.low + cut.high) / 2
    decided = judged.filter("said IS NOT NULL").select("_gs_id", "host", "path", "rule", F.col("said").alias("verdict"), F.lit(None).cast("double").alias("score"))
    own = scores.filter("said IS NULL").select("host", "path", "score", "n")
    open_ = met(judged.filter("said IS NULL"), own, ["host", "path"], F.col("n") >= max(1000, cut.rows // HOT_KEYS))
    verdict = F.when(F.col("score") < threshold, F.lit("block")).otherwise(F.lit("allow"))
    asked_rows = open_.select("_gs_id", "host", "path", "rule", verdict.alias("verdict"), "score")
    return decided.unionByName(asked_rows).withColumnRenamed("_gs_id", id_col)
