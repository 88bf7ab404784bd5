"""One knowledge graph of all apps, with dense ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nomen import model
from nomen.functions import columns as C
from nomen.operators._lineage import cut


def dense_ids(rows: DataFrame, order: list[str], start: int = 0, out: str = "kg_id", partitions: int | None = None) -> DataFrame:
    """``rows`` with dense ids in the order of ``order`` (whose values are distinct).

    Rows are dealt by range and sorted, which is their only shuffle; a part's rows are numbered as they are written and moved by the
    number of rows before the part.  The parts' counts are one row each.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # the part's number, then 33 bits that count its rows
    dealt = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", at))  # ranges are drawn from a sample: keep the one that the counts belong to
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + start
    return dealt.join(F.broadcast(before), "_part").withColumn(out, number.cast("long")).drop("_part", "_at", "_before")


def dense_within(rows: DataFrame, group: str, order: list[str], start: int = 0, out: str = "id") -> DataFrame:
    """``rows`` with dense numbers in each ``group`` by ``order``: global numbers less the group's first, so that a group of
    any size is numbered in parts."""
    numbered = cut(dense_ids(rows, [group, *order], start, out))
    first = numbered.groupBy(group).agg(F.min(out).alias("_first"))
    return numbered.join(first, group).withColumn(out, F.col(out) - F.col("_first") + start).drop("_first")


def known_entities(nodes: DataFrame) -> DataFrame:
    """(name): distinct known entity names of all apps."""
    return nodes.where(C.is_known("type", "name")).select(C.entity_name("type", "name", "sig").alias("name")).distinct()


def relation_ids(spark: SparkSession) -> DataFrame:
    """(relation, relation_id) in alphabetical order."""
    return spark.createDataFrame([(r, i) for i, r in enumerate(sorted(model.RELATIONS))], "relation string, relation_id long")


def unknown_names(nodes: DataFrame, include_3lib: bool = False) -> DataFrame:
    """(gid, original_name) of included nodes that are not known; rows without an original name go."""
    kept = nodes.where(C.is_included("type", include_3lib) & ~C.is_known("type", "name") & F.col("original_name").isNotNull())
    return kept.select(C.global_id("app", "id").alias("gid"), "original_name")


def build_knowledge_graph(nodes: DataFrame, edges: DataFrame, include_3lib: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """entities(name, kg_id), node ids(app, id, kg_id), relations, triples(head, tail, relation).

    Known names are numbered in order over all apps; other included nodes go on in the order of (app, id).  Triples
    need both ends and a listed relation; equal triples of different apps stay.
    """
    spark = nodes.sparkSession
    known = dense_ids(known_entities(nodes), ["name"])
    n_known = known.count()
    included = nodes.where(C.is_included("type", include_3lib)).select("app", "id", C.entity_name("type", "name", "sig").alias("name"))
    named = included.join(known, "name", "left")
    unknown = dense_ids(named.where("kg_id IS NULL").select("app", "id"), ["app", "id"], n_known)
    ids = named.where("kg_id IS NOT NULL").select("app", "id", "kg_id").unionByName(unknown)
    entities = known.select("name", "kg_id").union(unknown.select(C.global_id("app", "id"), "kg_id"))
    relations = relation_ids(spark)
    side = lambda s, o: ids.select("app", F.col("id").alias(s), F.col("kg_id").alias(o))
    triples = edges.join(F.broadcast(relations), "relation").join(side("source", "head"), ["app", "source"]).join(side("target", "tail"), ["app", "target"]).select("head", "tail", F.col("relation_id").alias("relation"))
    return entities, ids, relations, triples


def with_embeddings(names: DataFrame, entities: DataFrame, vectors: DataFrame) -> DataFrame:
    """(gid, original_name, kg_id, vector): names to entity ids to vectors(id, vector)."""
    return names.join(entities.select(F.col("name").alias("gid"), "kg_id"), "gid").join(vectors.select(F.col("id").alias("kg_id"), "vector"), "kg_id").select("gid", "original_name", "kg_id", "vector")


def kmeans_names(vectors: DataFrame, names: DataFrame, k: int = 1000, seed: int = 0, most_rounds: int = 20) -> DataFrame:
    """(cluster, n, names): entity vectors (id, vector) clustered, with the names(id, name) of each cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.where(F.col("vector").isNotNull()).select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    fitted = KMeans(k=k, seed=seed, maxIter=most_rounds).fit(data)
    found = fitted.transform(data).select("id", F.col("prediction").alias("cluster")).join(names, "id", "left")
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("name")).alias("names"))
