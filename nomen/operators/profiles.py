"""Recovery of names from library method profiles.

``profiles(sig, id, ...)``: a structural signature and a dotted name; ``methods(app, node, sig, id)``: an app's methods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomen.functions import columns as C
from nomen.operators._lineage import cut


def profile_counts(profiles: DataFrame, allow_minified: bool = False) -> DataFrame:
    """(sig, id, count); rows with a minified id are skipped unless allowed."""
    kept = profiles if allow_minified else profiles.where(~C.is_method_minified("id"))
    return kept.groupBy("sig", "id").agg(F.count(F.lit(1)).alias("count"))


def add_counts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored totals plus new counts."""
    return stored.select("sig", "id", "count").unionByName(new.select("sig", "id", "count")).groupBy("sig", "id").agg(F.sum("count").alias("count"))


def profile_reduce(stored: DataFrame) -> DataFrame:
    """Without minified ids."""
    return stored.where(~C.is_method_minified("id"))


def profile_append(stored: DataFrame, library: DataFrame) -> DataFrame:
    """Library rows as they are."""
    return stored.unionByName(library, allowMissingColumns=True)


def match_profiles(methods: DataFrame, library: DataFrame, most_rows: int = 10) -> DataFrame:
    """(app, node, minified_id, lib_ids): distinct compatible library ids of each method whose signature has ``most_rows``
    library rows at most (also when none is compatible).

    Signatures are counted first, so that those of thousands of rows never enter the join.
    """
    counts = library.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    usable = library.join(counts.where(F.col("n") <= most_rows).select("sig"), "sig", "left_semi").select("sig", F.col("id").alias("lib_id"))
    asked = methods.select("app", "node", "sig", F.col("id").alias("minified_id")).join(counts, "sig", "left").where(F.coalesce("n", F.lit(0)) <= most_rows)
    joined = asked.join(usable, "sig", "left").withColumn("lib_id", F.when(C.names_compatible("lib_id", "minified_id"), F.col("lib_id")))
    return joined.groupBy("app", "node", "minified_id").agg(F.array_sort(F.collect_set("lib_id")).alias("lib_ids"))


def name_votes(matches: DataFrame, paths: DataFrame) -> DataFrame:
    """(app, node, choice, votes, method_count): every matched method adds 1 to each container's count, and 1 for each
    distinct prefix of its library ids that has the container's depth.

    ``paths(app, node, container, level)``: containers of a method below the root, from level 1.
    """
    # an id with fewer parts than the level gives no prefix there
    whole = F.filter(F.transform("lib_ids", lambda x: F.split(x, r"\.")), lambda x: F.size(x) >= F.col("level"))
    at = matches.join(paths, ["app", "node"]).withColumn("choices", F.array_distinct(F.transform(whole, lambda x: F.array_join(F.slice(x, F.lit(1), F.col("level")), "."))))
    total = at.groupBy("app", F.col("container").alias("node")).agg(F.count(F.lit(1)).alias("method_count"))
    votes = at.select("app", F.col("container").alias("node"), F.explode("choices").alias("choice")).groupBy("app", "node", "choice").agg(F.count(F.lit(1)).alias("votes"))
    return votes.join(total, ["app", "node"])


def best_names(votes: DataFrame, least: float = 0.6) -> DataFrame:
    """(app, node, choice, confidence): the only choice with most votes, if it reaches ``least`` of the methods."""
    w = Window.partitionBy("app", "node").orderBy(F.desc("votes"))
    top = votes.withColumn("r", F.rank().over(w)).where("r = 1").withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy("app", "node")))
    good = top.where("ties = 1").withColumn("confidence", F.col("votes") / F.col("method_count"))
    return good.where(F.col("confidence") >= least).select("app", "node", "choice", "confidence")


def ranked_choices(votes: DataFrame) -> DataFrame:
    """(app, node, place, choice, votes): all choices of a node by falling votes, then name."""
    place = F.row_number().over(Window.partitionBy("app", "node").orderBy(F.desc("votes"), "choice"))
    return votes.select("app", "node", place.alias("place"), "choice", "votes")


def prefix_match(methods: DataFrame, library: DataFrame, cls: str = "class_sig", package: str = "package_sig") -> DataFrame:
    """(app, node, lib_id): the only library id of the signature that starts with the class's recovered name, else with the
    package's."""

    # an id that starts with a name has all of the name's dotted parts but the last, so these are part of the key
    ids = library.select("sig", F.col("id").alias("lib_id")).distinct()
    parts = F.split("lib_id", r"\.")
    heads = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    headed = ids.select("sig", "lib_id", F.posexplode(heads).alias("n", "head"))

    def only(column: str) -> DataFrame:
        names = methods.select("app", "node", "sig", F.col(column).alias("p")).where("p IS NOT NULL")
        split = F.split("p", r"\.")
        asked = names.withColumn("n", F.size(split) - 1).withColumn("head", F.array_join(F.slice(split, F.lit(1), F.col("n")), "."))
        hits = asked.join(headed, ["sig", "n", "head"]).where(F.col("lib_id").startswith(F.col("p")))
        return hits.groupBy("app", "node").agg(F.count_distinct("lib_id").alias("n"), F.min("lib_id").alias("lib_id")).where("n = 1").drop("n")

    first, second = only(cls), only(package).withColumnRenamed("lib_id", "lib_id2")
    return first.join(second, ["app", "node"], "full_outer").select("app", "node", F.coalesce("lib_id", "lib_id2").alias("lib_id"))


def propagate_library(packages: DataFrame, contains: DataFrame) -> DataFrame:
    """(app, node): library packages with their classes and members, two levels down ``contains(app, parent, child)``."""
    down = lambda level: level.join(contains.select("app", F.col("parent").alias("node"), "child"), ["app", "node"]).select("app", F.col("child").alias("node"))
    classes = down(packages.select("app", "node"))
    return packages.select("app", "node").union(classes).union(down(classes)).distinct()


def apply_recovered(found: DataFrame, owners: DataFrame) -> DataFrame:
    """(app, node, sig, name): recovered signatures with the last proposal kept; a field's or method's also proposes its
    owner's, without the last part.  ``found(app, node, sig, ord)``; ``owners(app, node, owner)`` for members only."""
    up = found.join(owners, ["app", "node"]).select("app", F.col("owner").alias("node"), C.before_last_dot("sig").alias("sig"), "ord")
    last = found.select("app", "node", "sig", "ord").unionByName(up).groupBy("app", "node").agg(F.max_by("sig", F.struct("ord", "sig")).alias("sig"))
    return last.withColumn("name", F.substring_index("sig", ".", -1))


def extend_relations(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored(sig, id, relations)`` with the sorted union of new relations, where (sig, id) is stored exactly once; minified
    ids are skipped."""
    single = stored.groupBy("sig", "id").agg(F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")
    usable = new.where(~C.is_method_minified("id")).join(single, ["sig", "id"], "left_semi")
    more = usable.groupBy("sig", "id").agg(F.array_distinct(F.flatten(F.collect_list("relations"))).alias("more"))
    return stored.join(more, ["sig", "id"], "left").select("sig", "id", F.when(F.col("more").isNull(), F.col("relations")).otherwise(F.array_sort(F.array_union("relations", "more"))).alias("relations"))


def recover_by_profiles(methods: DataFrame, library: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(best container names, method ids): matches, votes, best names, then methods by the names of their containers.

    ``paths`` as for votes; a method's class is its last container and its package the one before.
    """
    best = best_names(name_votes(match_profiles(methods, library), paths))
    deepest = paths.groupBy("app", "node").agg(F.max("level").alias("deep"))
    placed = paths.join(deepest, ["app", "node"]).join(best.select("app", F.col("node").alias("container"), "choice"), ["app", "container"])
    cls = placed.where("level = deep").select("app", "node", F.col("choice").alias("class_sig"))
    package = placed.where("level = deep - 1").select("app", "node", F.col("choice").alias("package_sig"))
    named = methods.join(cls.join(package, ["app", "node"], "full_outer"), ["app", "node"])
    return best, prefix_match(named, library)
