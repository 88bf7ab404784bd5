"""Name-mapping files: parsing, keys, merging and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomen.functions import columns as C
from nomen.operators._lineage import cut
from nomen.operators.lines import carry_down

# Line patterns (fixed values)
CLASS_LINE = r"([^ ]+) -> ([^ ]+):$"
TOOL_CLASS_LINE = r"^([^ ]+) -> ([^ ]+)$"
METHOD_LINE = r"([^ ]+) ([^ ]+)\((.*)\) -> ([^ ]+)$"
FIELD_LINE = r"([^ ]+) ([^ )]+) -> ([^ ]+)$"


def _members(lines: DataFrame, header: str, own_group: int, new: int, old_is_left: bool) -> DataFrame:
    """Lines with their kind and parts, and the class header carried down within the file."""
    v = F.col("value")
    is_class, is_field, is_method = v.rlike(header), v.rlike(FIELD_LINE), v.rlike(METHOD_LINE)
    kind = F.when(is_class, "c").when(is_field, "f").when(is_method, "m")
    g = lambda p, i: F.trim(F.regexp_extract(v, p, i))
    field_names = (g(FIELD_LINE, 2), g(FIELD_LINE, 3)) if old_is_left else (g(FIELD_LINE, 3), g(FIELD_LINE, 2))
    method_names = (g(METHOD_LINE, 2), g(METHOD_LINE, 4)) if old_is_left else (g(METHOD_LINE, 4), g(METHOD_LINE, 2))
    # the patterns are dear: each line meets them once, in a task of as many as there are, and what they found is written
    spread = lines.select("app", "line", "value").repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = cut(spread.withColumn("kind", kind)).where("kind IS NOT NULL")
    is_kind = lambda k: F.col("kind") == k
    parts = kinds.select(
        "app",
        "line",
        "kind",
        F.when(is_kind("c"), F.struct(F.regexp_extract(v, header, own_group).alias("cls"), F.regexp_extract(v, header, new).alias("origin_cls"))).alias("own"),
        F.when(is_kind("f"), g(FIELD_LINE, 1)).when(is_kind("m"), g(METHOD_LINE, 1)).alias("type"),
        F.when(is_kind("f"), field_names[0]).when(is_kind("m"), method_names[0]).alias("origin"),
        F.when(is_kind("f"), field_names[1]).when(is_kind("m"), method_names[1]).alias("obfus"),
        F.when(is_kind("m"), g(METHOD_LINE, 3)).alias("params"),
    )
    carried = carry_down(cut(parts), F.col("own"), "header")
    return cut(carried.select("app", "line", "kind", F.col("header.cls").alias("cls"), F.col("header.origin_cls").alias("origin_cls"), "type", "origin", "obfus", "params"))


def _last(x: Column) -> str:
    return F.substring_index(x, ".", -1)


def _rows(parsed: DataFrame, translate: bool) -> DataFrame:
    classes = parsed.where("kind = 'c'")
    changed = classes.where("cls <> origin_cls")
    c = changed.select("app", "line", F.lit("c").alias("kind"), F.col("cls").alias("key"), _last(F.col("origin_cls")).alias("value"))
    p0 = classes.select("app", "line", C.before_last_dot("cls").alias("key"), C.before_last_dot("origin_cls").alias("origin"))
    p = p0.where("key <> origin").select("app", "line", F.lit("p").alias("kind"), "key", _last(F.col("origin")).alias("value"))
    members = parsed.where("kind IN ('f', 'm') AND origin <> obfus")
    types = F.col("type"), F.col("params")
    if translate:  # types were written with original names: whole names of changed classes become the new ones
        # a file's changed classes and its members' types meet by name, so that no file is gathered in one row
        new = changed.groupBy("app", "origin_cls").agg(F.max_by("cls", "line").alias("to"))
        wanted = members.select("app", "line", F.posexplode(F.split(F.when(F.col("kind") == "f", F.col("type")).otherwise(F.col("params")), ",")).alias("pos", "t"))
        got = wanted.join(new.select("app", F.col("origin_cls").alias("t"), "to"), ["app", "t"], "left")
        joined = got.groupBy("app", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("to", "t").alias("t")))), lambda x: x["t"]), ",").alias("types"))
        members = members.join(joined, ["app", "line"])
        types = F.col("types"), F.col("types")
    key = F.when(F.col("kind") == "f", F.concat(F.col("cls"), F.lit(";->"), F.col("obfus"), F.lit(":"), types[0])).otherwise(F.concat(F.col("cls"), F.lit(";->"), F.col("obfus"), F.lit("("), types[1], F.lit(")")))
    m = members.select("app", "line", "kind", key.alias("key"), F.col("origin").alias("value"))
    return p.union(c).union(m).where("key IS NOT NULL").groupBy("app", "kind", "key").agg(F.max_by("value", "line").alias("value"))


def parse_mapping(lines: DataFrame) -> DataFrame:
    """(app, kind: p, c, f, m, key, value) of minifier mapping lines ``(app, line, value)``.

    Keys are new names, values the last part of the original name.  Unchanged names are dropped, later lines win,
    and field lines are tried before method lines.
    """
    return _rows(_members(lines, CLASS_LINE, 2, 1, True), True)


def parse_tool_mapping(lines: DataFrame) -> DataFrame:
    """The same of files with the new name on the left, no colon after headers, and types left as they are."""
    return _rows(_members(lines, TOOL_CLASS_LINE, 1, 2, False), False)


def mapping_from_graph(nodes: DataFrame) -> DataFrame:
    """(app, kind, key, value, is_lib): predictions of a recovered graph, where the recovered name differs."""
    kind = F.substring(F.substring_index("type", "_", 1), 1, 1)
    found = nodes.where(F.col("type").rlike("^(package|class|field|method)") & ~F.col("type").endswith("_lib") & F.col("recovered_name").isNotNull() & (F.col("recovered_name") != F.col("name")))
    return found.select("app", kind.alias("kind"), C.member_key("sig", F.substring_index("type", "_", 1)).alias("key"), F.col("recovered_name").alias("value"), F.lower("type").endswith("_3lib").alias("is_lib")).where("key IS NOT NULL")


def third_party_keys(nodes: DataFrame) -> DataFrame:
    """(app, key) of third-party nodes."""
    return nodes.where(F.lower("type").endswith("_3lib")).select("app", C.member_key("sig", F.lower(F.substring_index("type", "_", 1))).alias("key")).where("key IS NOT NULL").distinct()


def signature_map(lines: DataFrame) -> DataFrame:
    """(app, origin_sig, new_sig) of changed classes, fields and methods, in full signatures."""
    parsed = _members(lines, CLASS_LINE, 2, 1, True)
    classes = parsed.where("kind = 'c' AND cls <> origin_cls")
    new = classes.groupBy("app", "origin_cls").agg(F.max_by("cls", "line").alias("to"))
    members = parsed.where("kind IN ('f', 'm')")
    wanted = members.select("app", "line", F.posexplode(F.concat(F.array("type"), F.when(F.col("kind") == "m", F.split("params", ",")).otherwise(F.array().cast("array<string>")))).alias("pos", "t"))
    got = wanted.join(new.select("app", F.col("origin_cls").alias("t"), "to"), ["app", "t"], "left")
    types = got.groupBy("app", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("to", "t").alias("t")))), lambda x: x["t"]).alias("types"))
    joined = members.join(types, ["app", "line"])
    rest = F.array_join(F.slice("types", F.lit(2), F.greatest(F.size("types") - 1, F.lit(0))), ",")
    sig = lambda cls, t, name, params: F.concat(F.lit("<"), cls, F.lit(": "), t, F.lit(" "), name, F.when(F.col("kind") == "m", F.concat(F.lit("("), params, F.lit(")"))).otherwise(""), F.lit(">"))
    m = joined.select("app", sig(F.col("origin_cls"), F.col("type"), F.col("origin"), F.col("params")).alias("origin_sig"), sig(F.col("cls"), F.col("types")[0], F.col("obfus"), rest).alias("new_sig")).where("origin_sig <> new_sig")
    return classes.select("app", F.col("origin_cls").alias("origin_sig"), F.col("cls").alias("new_sig")).union(m).distinct()


def merge_predictions(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union by (app, kind, key); the second source wins."""
    a, b = first.select("app", "kind", "key", F.col("value").alias("v1")), second.select("app", "kind", "key", F.col("value").alias("v2"))
    return a.join(b, ["app", "kind", "key"], "full_outer").select("app", "kind", "key", F.coalesce("v2", "v1").alias("value"))


def match_column(mode: str, a: str = "truth", b: str = "pred") -> Column:
    """Equality or a common substring; ``similar`` needs a ``ratio`` column.  A missing side never matches."""
    if mode == "exact":
        found = F.col(a) == F.col(b)
    elif mode == "common_substr":
        found = C.common_substring(a, b)
    elif mode == "similar":
        found = (F.col(a) == F.col(b)) | (F.col("ratio") >= 0.6)
    else:
        raise ValueError(f"unknown match mode {mode}")
    return F.coalesce(found, F.lit(False))


def compare(truth: DataFrame, pred: DataFrame, mode: str = "exact", lib_keys: DataFrame | None = None) -> DataFrame:
    """(app, kind, key, truth, pred, matched, is_lib) by a full outer join on (app, kind, key)."""
    from nomen.functions.similarity import with_ratio

    a, b = truth.select("app", "kind", "key", F.col("value").alias("truth")), pred.select("app", "kind", "key", F.col("value").alias("pred"))
    both = a.join(b, ["app", "kind", "key"], "full_outer")
    both = with_ratio(both, "truth", "pred") if mode == "similar" else both
    out = both.select("app", "kind", "key", "truth", "pred", match_column(mode).alias("matched"))
    if lib_keys is None:
        return out.withColumn("is_lib", F.lit(False))
    marked = lib_keys.select("app", "key").distinct().withColumn("_lib", F.lit(True))
    return out.join(marked, ["app", "key"], "left").withColumn("is_lib", F.coalesce("_lib", F.lit(False))).drop("_lib")


def key_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of either mapping."""
    return a.select("app", "kind", "key").union(b.select("app", "kind", "key")).distinct()


def true_positives(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries that both mappings have with the same value."""
    c = ["app", "kind", "key", "value"]
    return a.select(c).intersect(b.select(c))


def mapping_stats(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(app, kind or ``total``, n_truth, n_pred, tp, recall, precision).

    The total is on keys merged over kinds, where a field wins over a class, and so on in the order p, c, f, m.
    """
    rank = F.expr("array_position(array('p','c','f','m'), kind)")
    whole = lambda m: m.groupBy("app", "key").agg(F.max_by("value", rank).alias("value")).withColumn("kind", F.lit("total"))
    both = compare(truth, pred).unionByName(compare(whole(truth), whole(pred)))
    stats = both.groupBy("app", "kind").agg(F.count("truth").alias("n_truth"), F.count("pred").alias("n_pred"), F.count_if("matched").alias("tp"))
    return stats.withColumn("recall", C.safe_divide("tp", "n_truth")).withColumn("precision", C.safe_divide("tp", "n_pred"))
