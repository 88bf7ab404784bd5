"""Scores of predicted names: metrics with roll-ups, distributions, regressions, folds and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomen.functions import columns as C
from nomen.operators._lineage import cut
from nomen.operators.kg import dense_ids
from nomen.operators.mapping import match_column


def _with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumn("precision", C.safe_divide("tp", "predict")).withColumn("recall", C.safe_divide("tp", "origin"))


def by_mode(compared: DataFrame, modes: list[str]) -> DataFrame:
    """Each compared row once per match mode."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), match_column(m).alias("hit")) for m in modes])).alias("x")
    return compared.select("*", pairs).select(*compared.columns, "x.mode", "x.hit")


def _counts() -> tuple:
    return F.count("truth").alias("origin"), F.count("pred").alias("predict"), F.count_if("hit").alias("tp")


def report_metrics(compared: DataFrame, modes: list[str]) -> DataFrame:
    """(app, mode, kind, origin, predict, tp, precision, recall); kind ``s`` sums an app's kinds."""
    rows = by_mode(compared, modes)
    counts = rows.groupingSets([["app", "mode", "kind"], ["app", "mode"]], "app", "mode", "kind").agg(*_counts(), F.grouping("kind").alias("g"))
    return _with_rates(counts.withColumn("kind", F.when(F.col("g") == 1, "s").otherwise(F.col("kind"))).drop("g"))


def overall_metrics(compared: DataFrame, modes: list[str]) -> DataFrame:
    """Micro-averages per mode over passes, apps and kinds (a roll-up; a level's missing columns read ``all``)."""
    rows = by_mode(compared, modes)
    levels = ["pass", "app", "kind"]
    sets = [["mode", *levels[:i]] for i in range(4)]
    counts = rows.groupingSets(sets, "mode", *levels).agg(*_counts(), *[F.grouping(c).alias(f"g_{c}") for c in levels])
    named = counts.select("mode", *[F.when(F.col(f"g_{c}") == 1, "all").otherwise(F.col(c).cast("string")).alias(c) for c in levels], "origin", "predict", "tp")
    return _with_rates(named)


def lib_split_metrics(compared: DataFrame) -> DataFrame:
    """(kind, lib_type, minified, recovered, tp, precision, recall, share): a cube over kind and lib / nonlib; share is of
    all compared items."""
    rows = compared.withColumn("lib_type", F.when(F.col("is_lib"), "lib").otherwise("nonlib"))
    cube = rows.cube("kind", "lib_type").agg(F.count("truth").alias("minified"), F.count("pred").alias("recovered"), F.count_if("matched").alias("tp"), F.count(F.lit(1)).alias("n"), F.grouping("kind").alias("gk"), F.grouping("lib_type").alias("gl"))
    total = compared.agg(F.count(F.lit(1)).alias("total"))
    named = cube.crossJoin(F.broadcast(total)).select(F.when(F.col("gk") == 1, "all").otherwise(F.col("kind")).alias("kind"), F.when(F.col("gl") == 1, "all").otherwise(F.col("lib_type")).alias("lib_type"), "minified", "recovered", "tp", C.safe_divide("tp", "recovered").alias("precision"), C.safe_divide("tp", "minified").alias("recall"), C.percent("n", "total").alias("share"))
    return named


def lib_packages_of_report(compared: DataFrame) -> DataFrame:
    """(app, package) of matched library packages and classes."""
    hit = compared.where(F.col("matched") & F.col("is_lib") & F.col("kind").isin("p", "c"))
    return hit.select("app", F.when(F.col("kind") == "p", F.col("key")).otherwise(C.before_last_dot("key")).alias("package")).distinct()


def flag_by_packages(compared: DataFrame) -> DataFrame:
    """Rows whose package (or class's package) is a library package of the same report get ``is_lib``."""
    owner = F.substring_index("key", ";", 1)
    package = F.when(F.col("kind") == "p", F.col("key")).otherwise(C.before_last_dot(owner))
    own, hit = (C.free_name(compared.columns, name) for name in ("_package", "_hit"))
    libs = lib_packages_of_report(compared).select("app", F.col("package").alias(own), F.lit(True).alias(hit))
    return compared.withColumn(own, package).join(libs, ["app", own], "left").withColumn("is_lib", F.coalesce(hit, F.lit(False))).drop(own, hit)


def report_flag_counts(compared: DataFrame) -> DataFrame:
    """(flag, lib, nonlib): counts of report letters (upper case: mismatch) by tag."""
    flag = F.when(F.col("matched"), F.col("kind")).otherwise(F.upper("kind"))
    return compared.groupBy(flag.alias("flag")).agg(F.count_if("is_lib").alias("lib"), F.count_if(~F.col("is_lib")).alias("nonlib"))


def metric_tables(metrics: DataFrame, modes: list[str]) -> DataFrame:
    """(kind, <mode>_tp, <mode>_precision, <mode>_recall): micro-averages with four decimals, match modes side by side."""
    sums = metrics.groupBy("kind").pivot("mode", modes).agg(F.sum("tp").alias("tp"), F.sum("predict").alias("predict"), F.sum("origin").alias("origin"))
    columns = [F.col("kind")]
    for m in modes:
        columns += [F.col(f"{m}_tp"), F.round(C.safe_divide(f"{m}_tp", f"{m}_predict"), 4).alias(f"{m}_precision"), F.round(C.safe_divide(f"{m}_tp", f"{m}_origin"), 4).alias(f"{m}_recall")]
    return sums.select(columns)


def compare_totals(compared: DataFrame) -> DataFrame:
    """(total, matched, precision, diff_rate) over all rows."""
    t = compared.agg(F.count(F.lit(1)).alias("total"), F.count_if("matched").alias("matched"))
    return t.withColumn("precision", C.safe_divide("matched", "total")).withColumn("diff_rate", F.lit(1.0) - F.col("precision"))


def inference_totals(request: DataFrame, result: DataFrame) -> DataFrame:
    """Requested against inferred labels by vertex: ``request(app, v, known, label)``, ``result(app, v, label)``.  Given labels
    are skipped; a vertex matches if the labels are equal and not ``?``."""
    asked = request.where(~F.col("known")).select("app", "v", F.col("label").alias("truth"))
    got = result.join(request.where("known").select("app", "v"), ["app", "v"], "left_anti").select("app", "v", F.col("label").alias("pred"))
    both = asked.join(got, ["app", "v"], "full_outer")
    return compare_totals(both.withColumn("matched", F.coalesce((F.col("truth") == F.col("pred")) & (F.col("truth") != "?"), F.lit(False))))


def chain_signatures(origin_to_new: DataFrame, new_to_pred: DataFrame) -> DataFrame:
    """(app, origin_sig, new_sig, pred) through the shared new signature."""
    return origin_to_new.join(new_to_pred, ["app", "new_sig"]).select("app", "origin_sig", "new_sig", "pred")


def empirical_cdf(values: DataFrame, kind: str, value: str, reverse: bool = False) -> DataFrame:
    """(kind, value, y): y = i / n for the i-th value from 0, as the least y of equal values.

    Values are counted before they are ordered, so the window runs over distinct values.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(kind, value).agg(F.count(F.lit(1)).alias("n"))
    order = F.desc(value) if reverse else F.asc(value)
    w = Window.partitionBy(kind)
    before = F.coalesce(F.sum("n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(kind, value, "n", (before / F.sum("n").over(w)).alias("y"))


def score_regression(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, n, slope, intercept, r): a least-squares line per group."""
    return points.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"))


def estimate_from_scores(scores: DataFrame, fits: DataFrame, group: str, x: str) -> DataFrame:
    """(group, estimate): the mean of each fitted line at the scores; ``fits`` has a row per match mode."""
    mean = scores.agg(F.avg(x).alias("mean_of_scores"))  # a line's mean is its value at the mean: one row meets the fits
    return fits.select(group, "slope", "intercept").crossJoin(F.broadcast(mean)).select(group, (F.col("slope") * F.col("mean_of_scores") + F.col("intercept")).alias("estimate"))


def average_scores(nodes: DataFrame, predictions: DataFrame, name_col: str = "name") -> DataFrame:
    """(n, tool_score, model_score): mean word similarity of two predictors to the original names, over class, method and
    field nodes with a name under three letters and an original of three or more.  A missing prediction counts as empty."""
    from nomen.functions.similarity import with_name_similarity

    some = nodes.where(F.col("type").isin("class", "method", "field") & (F.length(name_col) < 3) & (F.length("original_name") >= 3))
    joined = some.withColumn("gid", C.global_id("app", "id")).join(predictions.select("gid", F.col("value").alias("model_name")), "gid", "left")
    filled = joined.select("original_name", F.coalesce("tool_name", F.lit("")).alias("tool_name"), F.coalesce("model_name", F.lit("")).alias("model_name"))
    scored = with_name_similarity(with_name_similarity(filled, "original_name", "tool_name", "tool"), "original_name", "model_name", "model")
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg("tool").alias("tool_score"), F.avg("model").alias("model_score"))


def folds(items: DataFrame, id_col: str, n_folds: int = 10, seed: str = "0", kind: str = "blocks") -> DataFrame:
    """(id, fold): items in the order of a seeded hash.

    ``blocks``: near-equal blocks that cover all; ``rolling``: n_folds tests of floor(n / n_folds) items, the rest is
    never tested (null fold); ``split``: fold 0 is the first tenth, the others are null.
    """
    key = F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))
    ranked = cut(dense_ids(items.select(id_col).distinct().select(id_col, key.alias("k")), ["k", id_col], out="i"))
    n, i = ranked.count(), F.col("i")
    size = n // n_folds
    if kind == "blocks":  # the first n % n_folds blocks have one item more
        longer = n % n_folds
        fold = F.when(i < longer * (size + 1), F.floor(i / (size + 1))).otherwise(longer + F.floor((i - longer * (size + 1)) / max(1, size)))
        return ranked.select(id_col, fold.cast("int").alias("fold"))
    most = 1 if kind == "split" else n_folds
    return ranked.select(id_col, F.when(i < size * most, F.floor(i / max(1, size))).cast("int").alias("fold"))


def first_apps(items: DataFrame, id_col: str, n: int) -> DataFrame:
    """The first n ids in order: a limit on the training list."""
    return items.select(id_col).distinct().orderBy(id_col).limit(n)


def phase_events(events: DataFrame, key: str, order: list[str], event: str, ts: str, start: str, stop: str) -> DataFrame:
    """(key, started, stopped): each stop with the event right before it, if that is a start."""
    w = Window.partitionBy(key).orderBy(*order)
    only = events.where(F.col(event).isin(start, stop)).withColumn("was", F.lag(event).over(w)).withColumn("at", F.lag(ts).over(w))
    return only.where((F.col(event) == stop) & (F.col("was") == start)).select(key, F.col("at").alias("started"), F.col(ts).alias("stopped"))


def phase_timings(phases: DataFrame, key: str) -> DataFrame:
    """(key, n, total, longest, mean) seconds of phases; the mean of none is 1 by the divide rule."""
    seconds = (F.unix_micros(F.col("stopped").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6
    t = phases.select(key, seconds.alias("s")).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("total"), F.max("s").alias("longest"))
    return t.withColumn("mean", C.safe_divide("total", "n"))


def replay_log(lines: DataFrame) -> DataFrame:
    """(app, pass, train_seconds, predict_count, predict_total, predict_max, predict_mean) of test logs ``(app, line, event, pass, at)``.

    Events: pass, train_start, train_end, predict_start, predict_stop, by line within a log; the pass is carried down and
    each end pairs with the start right before it.
    """
    w = Window.partitionBy("app").orderBy("line")
    down = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("pass", F.last("pass", ignorenulls=True).over(down)).where("event <> 'pass'").withColumn("was", F.lag("event").over(w)).withColumn("since", F.lag("at").over(w))
    took = F.col("at") - F.col("since")
    spans = marked.select("app", "pass", F.when((F.col("event") == "train_end") & (F.col("was") == "train_start"), took).alias("t"), F.when((F.col("event") == "predict_stop") & (F.col("was") == "predict_start"), took).alias("p"))
    out = spans.groupBy("app", "pass").agg(F.sum("t").alias("train_seconds"), F.count("p").alias("predict_count"), F.sum("p").alias("predict_total"), F.max("p").alias("predict_max"))
    return out.withColumn("predict_mean", C.safe_divide("predict_total", "predict_count"))
