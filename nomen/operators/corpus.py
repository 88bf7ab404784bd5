"""Pairing of build artifacts, and texts of app screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomen.functions import columns as C


def parse_artifacts(paths: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(path, project, variant, kind) of recognised paths (unaligned ones skipped), and the others."""
    parsed = paths.select(F.col(path).alias("path"), C.artifact_parts(path).alias("x")).select("path", "x.*")
    return parsed.where(~F.col("kind").isin("skipped", "unknown")), parsed.where("kind = 'unknown'").select("path")


def pair_artifacts(artifacts: DataFrame) -> DataFrame:
    """(mapping, debug, release): for each mapping the project's builds: the only candidate, else the equal variant, else the
    first variant that contains the mapping's (letters and digits only).  The last path of a variant wins; a mapping
    needs both builds in its project."""
    latest = artifacts.groupBy("project", "kind", "variant").agg(F.max("path").alias("path"))
    mappings = latest.where("kind = 'mapping'").select("project", F.col("variant").alias("wanted"), F.col("path").alias("mapping"))

    def choose(kind: str) -> DataFrame:
        builds = latest.where(F.col("kind") == kind).select("project", "variant", F.col("path").alias(kind), F.count(F.lit(1)).over(Window.partitionBy("project")).alias("n"))
        rank = F.when(F.col("n") == 1, 0).when(F.col("variant") == F.col("wanted"), 1).when(F.contains(C.generalise("variant"), C.generalise("wanted")), 2)
        found = mappings.join(builds, "project").withColumn("rank", rank).where("rank IS NOT NULL")
        return found.groupBy("mapping").agg(F.min_by(kind, F.struct("rank", "variant")).alias(kind))

    return choose("debug").join(choose("release"), "mapping").select("mapping", "debug", "release")


def visited_activities(states: DataFrame, declared: DataFrame) -> DataFrame:
    """Screen states whose activity is declared, by any of three spellings.

    ``states(package, component, ...)``; ``declared(package, activity)``.  A package must be on both sides.
    """
    spelled = F.explode(F.array_distinct(F.array(C.normalise_activity("component", "package"), F.substring_index("component", "/", -1), F.col("component")))).alias("activity")
    tried = states.select("*", spelled)
    names = declared.select("package", "activity").distinct()
    hit = tried.join(names, ["package", "activity"], "left_semi")
    return hit.withColumn("activity", C.normalise_activity("component", "package")).dropDuplicates()


def activity_texts(states: DataFrame) -> DataFrame:
    """(package, activity, views): the distinct lists of (text, rid, class) that an activity showed; ``states`` has ``views``."""
    return states.groupBy("package", "activity").agg(F.array_sort(F.collect_set("views")).alias("views"))


def common_packages(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("package").intersect(b.select("package"))


def package_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("app", "package").subtract(b.select("app", "package"))
