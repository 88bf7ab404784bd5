"""Feature graphs: labels, edge families, scopes, validity, obfuscation rates and graph splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nomen import model
from nomen.functions import columns as C


def select_families(edges: DataFrame, families: list[str] = model.DEFAULT_FAMILIES, relation: str = "relation") -> DataFrame:
    return edges.where(C.edge_family(relation).isin(families))


def edge_family_counts(edges: DataFrame, relation: str = "relation") -> DataFrame:
    """(family, n) with an ``all`` row."""
    rolled = edges.select(C.edge_family(relation).alias("family")).rollup("family").agg(F.count(F.lit(1)).alias("n"), F.grouping("family").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "all").otherwise(F.col("family")).alias("family"), "n")


def ablation_sets(spark: SparkSession, order: list[str] = model.ABLATION_ORDER) -> DataFrame:
    """(feature_set, family): nested sets of families, named by their parts."""
    rows = [("+".join(order[: i + 1]), f) for i in range(len(order)) for f in order[: i + 1]]
    return spark.createDataFrame(rows, "feature_set string, family string")


def ablation_counts(edges: DataFrame, relation: str = "relation", order: list[str] = model.ABLATION_ORDER) -> DataFrame:
    """(feature_set, n): edges of each nested set, counted by family first."""
    counts = edges.groupBy(C.edge_family(relation).alias("family")).agg(F.count(F.lit(1)).alias("n"))
    sets = ablation_sets(edges.sparkSession, order)
    return F.broadcast(sets).join(counts, "family", "left").groupBy("feature_set").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def vertex_labels(elements: DataFrame) -> DataFrame:
    """``elements(app, v, kind, name, sig, is_library)`` with (label, known): library elements by their signature;
    constructors and ``<...>`` methods, types, modifiers and constants by name; other app elements are to be inferred."""
    library = F.col("is_library") & F.col("kind").isin("package", "class", "method", "field")
    fixed = F.col("kind").isin("type", "modifier", "const") | (F.col("kind").isin("constructor") | ((F.col("kind") == "method") & F.col("name").startswith("<")))
    return elements.withColumn("label", F.when(library, F.col("sig")).otherwise(F.col("name"))).withColumn("known", library | fixed)


def promote_well_named(vertices: DataFrame) -> DataFrame:
    """Vertices with a name that is not obfuscated become known."""
    return vertices.withColumn("known", F.col("known") | ~C.is_name_obfuscated("name"))


def valid_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(app, a, b, kind): edges between two vertices that are not both of libraries; mixed ones get ``_LIB``."""
    side = lambda s: vertices.select("app", F.col("v").alias(s), F.col("is_library").alias(f"{s}_lib"))
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").join(side("a"), ["app", "a"]).join(side("b"), ["app", "b"]).where("NOT (a_lib AND b_lib)")
    return both.select("app", "a", "b", F.when(F.col("a_lib") != F.col("b_lib"), F.concat("kind", F.lit("_LIB"))).otherwise(F.col("kind")).alias("kind"))


def drop_mutual_order(edges: DataFrame, order_kind: str = model.ORDER_EDGE) -> DataFrame:
    """Edges of exactly that kind go where the reverse edge exists; all others stay."""
    order = edges.where(F.col("kind") == order_kind)
    back = order.select("app", F.col("b").alias("a"), F.col("a").alias("b")).distinct()
    return edges.where(F.coalesce(F.col("kind") != order_kind, F.lit(True))).unionByName(order.join(back, ["app", "a", "b"], "left_anti"), allowMissingColumns=True)


def scopes(members: DataFrame) -> DataFrame:
    """(app, scope, members): sorted vertex ids that must get different names; ``members(app, scope, v)``."""
    return members.groupBy("app", "scope").agg(F.array_sort(F.collect_set("v")).alias("members"))


def obfuscation_rates(elements: DataFrame) -> DataFrame:
    """(level, app, package, cls, obfuscated, total): per class its name and members; per package and per app the classes over
    a tenth.  ``elements(app, package, cls, kind: class or member, name)``.  Rates are compared in integers."""
    bad = F.when(F.col("kind") == "class", C.is_class_name_obfuscated("name")).otherwise(C.is_name_obfuscated("name"))
    classes = elements.groupBy("app", "package", "cls").agg(F.count_if(bad).alias("obfuscated"), F.count(F.lit(1)).alias("total"))
    over = F.col("obfuscated") * 10 > F.col("total")
    up = classes.rollup("app", "package").agg(F.count_if(over).alias("obfuscated"), F.count(F.lit(1)).alias("total"), F.grouping_id().alias("g"))
    level = F.expr("CASE g WHEN 0 THEN 'package' WHEN 1 THEN 'app' ELSE 'all' END")
    top = up.select(level.alias("level"), "app", "package", F.lit(None).cast("string").alias("cls"), "obfuscated", "total")
    return classes.select(F.lit("class").alias("level"), "app", "package", F.col("cls").cast("string").alias("cls"), "obfuscated", "total").union(top)


def training_filter(rates: DataFrame) -> DataFrame:
    """(app, package, cls): classes where neither their own nor their package's rate is over a tenth."""
    over = F.col("obfuscated") * 10 > F.col("total")
    packages = rates.where((F.col("level") == "package") & over).select("app", "package")
    good = rates.where((F.col("level") == "class") & ~over)
    return good.join(packages, (good["app"].eqNullSafe(packages["app"])) & (good["package"].eqNullSafe(packages["package"])), "left_anti").select("app", "package", "cls")


def split_graph(edges: DataFrame, scope_rows: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges inside a part (with it), the number of edges lost, and scopes cut into parts with two members or more.

    ``edges(app, a, b, kind)``, ``scope_rows(app, scope, members)``, ``parts(app, v, part)``.
    """
    side = lambda s: parts.select("app", F.col("v").alias(s), F.col("part").alias(f"{s}_part"))
    both = edges.join(side("a"), ["app", "a"], "left").join(side("b"), ["app", "b"], "left").withColumn("inside", F.coalesce(F.col("a_part") == F.col("b_part"), F.lit(False)))
    kept = both.where("inside").select("app", F.col("a_part").alias("part"), "a", "b", "kind")
    lost = both.groupBy("app").agg(F.count_if(~F.col("inside")).alias("lost"))
    cut = scope_rows.select("app", "scope", F.explode("members").alias("v")).join(parts, ["app", "v"]).groupBy("app", "scope", "part").agg(F.array_sort(F.collect_set("v")).alias("members")).where(F.size("members") > 1)
    return kept, lost, cut


def adjacency(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(app, id, neighbours) of both directions on ids from 1 in vertex order, and (app, vertices, edges) heads."""
    pairs = edges.where("a <> b").select("app", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    ends = pairs.select("app", F.col("x").alias("v")).union(pairs.select("app", "y")).distinct()
    ids = ends.withColumn("i", F.row_number().over(Window.partitionBy("app").orderBy("v")))
    side = lambda s: ids.select("app", F.col("v").alias(s), F.col("i").alias(f"{s}_i"))
    numbered = pairs.join(side("x"), ["app", "x"]).join(side("y"), ["app", "y"])
    both = numbered.select("app", F.col("x_i").alias("id"), F.col("y_i").alias("n")).union(numbered.select("app", "y_i", "x_i"))
    lists = both.groupBy("app", "id").agg(F.array_sort(F.collect_list("n")).alias("neighbours"))
    heads = pairs.groupBy("app").agg(F.count(F.lit(1)).alias("edges")).join(ids.groupBy("app").agg(F.count(F.lit(1)).alias("vertices")), "app").select("app", "vertices", "edges")
    return lists, heads
