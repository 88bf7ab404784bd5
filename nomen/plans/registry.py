"""The registered queries of the name-recovery library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomen import model
from nomen.functions import columns as C
from nomen.functions.similarity import with_name_similarity, with_similar_ratio
from nomen.operators._lineage import cut, new_folder
from nomen.operators import corpus, evaluate, features, flow, graph, hierarchy, kg, library, mapping, matching, profiles, propagation, replay, vocab
from nomen.plans import oracles
from nomen.sources import adapters, graphs, text
from nomen.streaming import profiles as stream_profiles

MODES = ["exact", "common_substr"]
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in _QUERIES}


# -- library detection


def _sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = adapters.program_graph(spark, sf)
    return nodes, edges, cut(library.package_hash_sets(nodes, edges))


@query
def library_tagging(spark: SparkSession, sf: str) -> DataFrame:
    """Packages identified as library code, with the number of nodes tagged."""
    nodes, _, sets = _sets(spark, sf)
    matched = library.match_libraries(sets, library.library_hashes(sets, library.collect_libraries(sets)))
    tagged = library.tag_library_nodes(nodes, matched).where("lib_name IS NOT NULL")
    return tagged.groupBy("app", "package", "lib_name").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("type") == "method_3lib").alias("n_methods"))


@query
def node_hash(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = adapters.program_graph(spark, sf)
    return library.node_hash(nodes, edges, model.LIBRARY_RELATIONS)


@query
def package_hash_sets(spark: SparkSession, sf: str) -> DataFrame:
    return _sets(spark, sf)[2]


@query
def library_groups(spark: SparkSession, sf: str) -> DataFrame:
    found = library.collect_libraries(_sets(spark, sf)[2])
    return found.select("lib_name", "n_members", F.array_join("packages", ",").alias("packages"), F.array_join("paths", ",").alias("paths"))


@query
def library_matches(spark: SparkSession, sf: str) -> DataFrame:
    sets = _sets(spark, sf)[2]
    return library.match_libraries(sets, library.library_hashes(sets, library.collect_libraries(sets))).select("app", "package", "lib_name", "n_common")


@query
def superset_candidates(spark: SparkSession, sf: str) -> DataFrame:
    sets = _sets(spark, sf)[2]
    libs = library.collect_libraries(sets)
    return library.superset_candidates(sets, library.library_hashes(sets, libs)).join(libs.select("lib_id", "lib_name"), "lib_id").select("app", "package", "lib_name")


@query
def recover_library_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names copied from the library graph that holds a package's graph; libraries stand for their first member."""
    nodes, edges, sets = _sets(spark, sf)
    libs = library.collect_libraries(sets)
    hashes = library.library_hashes(sets, libs)
    package_nodes, package_edges = map(cut, library.package_subgraph(nodes, edges))
    # a library is represented by the least (app, package) of its members
    prints = sets.groupBy("app", "package").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("hash")), ","), 256).alias("lib_id"))
    stands = prints.join(libs.select("lib_id"), "lib_id").groupBy("lib_id").agg(F.min(F.struct("app", "package")).alias("m")).select("lib_id", "m.app", "m.package")
    lib_nodes = package_nodes.join(stands, ["app", "package"]).drop("app", "package")
    lib_edges = package_edges.join(stands, ["app", "package"]).drop("app", "package")
    candidates = library.superset_candidates(sets, hashes)
    return matching.recover_library_names(candidates, package_nodes, package_edges, lib_nodes, lib_edges)


@query
def package_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    """Size of each package's graph, with the packages whose names start with its own."""
    nodes, edges = library.package_subgraph(*adapters.program_graph(spark, sf), recursive=True)
    n = nodes.groupBy("app", "package").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if("static").alias("n_static"), F.count_distinct("hash").alias("n_hashes"))
    return n.join(edges.groupBy("app", "package").agg(F.count(F.lit(1)).alias("n_edges")), ["app", "package"])


@query
def common_package_names(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest package of each class name."""
    return library.most_common(adapters.elements(spark, sf), "cls", "pkg")


# -- graph normalisation and closures


@query
def normalised_edges(spark: SparkSession, sf: str) -> DataFrame:
    _, named = graph.normalise_graph(*adapters.program_graph(spark, sf, raw=True), columns=("type", "name"))
    ends = F.concat_ws("/", "source_name", "target_name")
    return named.groupBy("app", "source_type", "relation", "target_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(ends).alias("n_names"), F.min(ends).alias("first"), F.max(ends).alias("last")
    )


@query
def renumbered_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = graph.normalise_graph(*adapters.program_graph(spark, sf, raw=True))
    return nodes.select("app", "id", "type", "name", "sig")


@query
def attached_names(spark: SparkSession, sf: str) -> DataFrame:
    """Ground truth from mapping keys: every third class has a mapped name."""
    nodes, _ = adapters.program_graph(spark, sf)
    truth = nodes.where("type IN ('class', 'method') AND id % 3 = 0").select("app", C.member_key("sig", "type").alias("key"), F.concat(F.lit("Orig"), "name").alias("value"))
    return graph.attach_names(nodes, truth).where("original_name IS NOT NULL").select("app", "id", "type", "name", "original_name")


@query
def containment_paths(spark: SparkSession, sf: str) -> DataFrame:
    return graph.containment_paths(*adapters.program_graph(spark, sf))


@query
def package_sigs(spark: SparkSession, sf: str) -> DataFrame:
    """Dotted names along the containers, for a prefix tree under a root."""
    nodes, edges = _prefix_graph(spark, sf)
    return graph.package_sigs(nodes, edges).join(nodes.select("app", "id", F.col("sig").alias("prefix")), ["app", "id"]).select("app", "prefix", "sig")


def _prefix_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    tree = graph.package_prefix_tree(adapters.elements(spark, sf).select("app", F.col("pkg").alias("package")).distinct())
    roots = tree.select("app").distinct().select("app", F.lit("").alias("prefix"), F.lit(model.ROOT_NAME).alias("segment"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    rows = tree.union(roots).withColumn("id", (F.row_number().over(Window.partitionBy("app").orderBy("prefix")) - 1).cast("long"))
    nodes = rows.select("app", "id", F.lit("package").alias("type"), F.col("segment").alias("name"), F.col("prefix").alias("sig"))
    up = rows.where("depth > 0").select("app", F.col("id").alias("target"), F.coalesce("parent", F.lit("")).alias("prefix"))
    edges = up.join(rows.select("app", "prefix", F.col("id").alias("source")), ["app", "prefix"]).select("app", F.col("target").alias("ord"), "source", "target", F.lit("P_P_contains").alias("relation"))
    return nodes, edges


@query
def package_prefix_tree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.package_prefix_tree(adapters.elements(spark, sf).select("app", F.col("pkg").alias("package")).distinct())


@query
def predicted_package_names(spark: SparkSession, sf: str) -> DataFrame:
    packages = adapters.elements(spark, sf).select("app", F.col("pkg").alias("package")).distinct()
    tree = graph.package_prefix_tree(packages)
    known = tree.where("length(prefix) % 3 <> 0").select("app", "prefix", F.upper("segment").alias("name"))
    return graph.predicted_package_names(packages, known)


@query
def inherit_closure(spark: SparkSession, sf: str) -> DataFrame:
    return graph.ancestors(adapters.hierarchy(spark, sf)[0], ["app"])


@query
def subtree_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Descendants of each class, read from its interval label."""
    labels = hierarchy.forest_intervals(adapters.hierarchy(spark, sf)[0], ["app"])
    return labels.select("app", "node", F.expr("(hi - lo - 1) div 2").alias("descendants"))


@query
def override_edges(spark: SparkSession, sf: str) -> DataFrame:
    inherits, methods, _ = adapters.hierarchy(spark, sf)
    return graph.override_edges(methods, inherits)


@query
def reachable_methods(spark: SparkSession, sf: str) -> DataFrame:
    _, methods, calls = adapters.hierarchy(spark, sf)
    roots = methods.where("cls LIKE '%9'").select("app", F.col("cls").alias("root"), "method")
    return flow.reach_from(roots, calls)


@query
def call_circles(spark: SparkSession, sf: str) -> DataFrame:
    return flow.call_circles(adapters.ring_calls(spark, sf))


@query
def ring_reach(spark: SparkSession, sf: str) -> DataFrame:
    """What roots reach where methods also call one another in rings."""
    _, methods, _ = adapters.hierarchy(spark, sf)
    roots = methods.where("cls LIKE '%9'").select("app", F.col("cls").alias("root"), "method")
    return flow.reach_from(roots, adapters.ring_calls(spark, sf))


@query
def async_reach(spark: SparkSession, sf: str) -> DataFrame:
    inherits, methods, calls = adapters.hierarchy(spark, sf)
    roots = methods.where("cls LIKE '%9'").select("app", F.col("cls").alias("root"), "method")
    found = flow.reachable_with_async(roots, calls, methods, inherits, ["C0", "C1", "C2", "C3"])
    return found.select("app", "root", F.array_join("classes", ",").alias("classes"), F.array_join("methods", ",").alias("methods"))


@query
def structural_edges(spark: SparkSession, sf: str) -> DataFrame:
    el = cut(adapters.elements(spark, sf)).withColumn("c", F.concat("pkg", F.lit("."), "cls"))  # read by each kind of element
    none = F.array().cast("array<string>")
    classes = el.groupBy("app", F.col("c").alias("cls"), F.col("pkg").alias("package")).agg(F.min("ref").alias("super")).select("app", "cls", "package", "super", F.lit(None).cast("string").alias("outer"), none.alias("interfaces"), F.array(F.lit("public")).alias("modifiers"))
    fields = el.select("app", F.col("c").alias("cls"), F.concat("c", F.lit(".f"), "ref").alias("field"), F.col("ret").alias("type"), none.alias("modifiers"))
    methods = el.select("app", F.col("c").alias("cls"), F.concat("c", F.lit("."), "mth").alias("method"), "ret", F.array(F.lit("int"), F.col("ref")).alias("params"), none.alias("exceptions"), F.when(F.col("own"), F.array(F.concat("c", F.lit(".f"), "ref"))).otherwise(none).alias("uses_fields"), none.alias("uses_methods"), F.when(F.col("vol"), F.array(F.lit("volatile"))).otherwise(none).alias("modifiers"), F.lit(False).alias("is_constructor"))
    return graph.structural_edges(classes, fields, methods)


@query
def def_use_edges(spark: SparkSession, sf: str) -> DataFrame:
    return flow.def_use_edges(adapters.definitions(spark, sf))


@query
def usage_order_edges(spark: SparkSession, sf: str) -> DataFrame:
    return flow.usage_order_edges(*adapters.statements(spark, sf))


# -- knowledge graph


@query
def kg_entities(spark: SparkSession, sf: str) -> DataFrame:
    return kg.build_knowledge_graph(*adapters.program_graph(spark, sf))[0]


@query
def kg_triples(spark: SparkSession, sf: str) -> DataFrame:
    """Triples by relation: how many, and sums that tell which ids they join."""
    triples = kg.build_knowledge_graph(*adapters.program_graph(spark, sf))[3]
    mixed = F.sum((F.col("head") * 31 + F.col("tail") * 17) % 10007 * (F.col("tail") % 101 + 1))
    return triples.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.sum("head").alias("heads"), F.sum("tail").alias("tails"), mixed.alias("mixed"))


@query
def known_entities(spark: SparkSession, sf: str) -> DataFrame:
    return kg.known_entities(adapters.program_graph(spark, sf)[0])


@query
def unknown_names(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = adapters.program_graph(spark, sf)
    return kg.unknown_names(nodes.withColumn("original_name", F.when(F.col("id") % 3 > 0, F.upper("name"))))


@query
def embedded_names(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown names joined to entity ids and vectors (ids modulo the number of vectors)."""
    nodes, edges = adapters.program_graph(spark, sf)
    entities = kg.build_knowledge_graph(nodes, edges)[0]
    vectors = adapters.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    names = kg.unknown_names(nodes.withColumn("original_name", F.when(F.col("id") % 2 == 0, F.col("name"))))
    found = kg.with_embeddings(names, entities, vectors)
    return found.select("gid", "original_name", "kg_id", F.size("vector").alias("dims"))


@query
def kmeans_names(spark: SparkSession, sf: str) -> DataFrame:
    v = adapters.table(spark, sf, "embeddings")
    return kg.kmeans_names(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), v.select(F.col("vec_id").alias("id"), F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("name")), k=20)


# -- mappings and evaluation


@query
def parsed_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.parse_mapping(adapters.mapping_lines(spark, sf))


@query
def tool_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.parse_tool_mapping(adapters.tool_lines(spark, sf))


@query
def signature_map(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.signature_map(adapters.mapping_lines(spark, sf))


@query
def graph_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of a recovered graph by key, with those of third-party nodes marked."""
    nodes, _ = adapters.program_graph(spark, sf)
    kind = F.when((F.col("id") % 4 == 0) & F.col("type").isin("class", "method"), F.concat("type", F.lit("_3lib"))).otherwise(F.col("type"))
    recovered = nodes.withColumn("recovered_name", F.when(F.col("id") % 3 == 0, F.concat("name", F.lit("X"))).when(F.col("id") % 3 == 1, F.col("name"))).withColumn("type", kind)
    found = mapping.mapping_from_graph(recovered)
    marked = mapping.third_party_keys(recovered).withColumn("third_party", F.lit(True))
    return found.join(marked, ["app", "key"], "left").select("app", "kind", "key", "value", "is_lib", F.coalesce("third_party", F.lit(False)).alias("third_party"))


@query
def report_lib_packages(spark: SparkSession, sf: str) -> DataFrame:
    """Report rows whose package is a library package of the report."""
    rows = adapters.table(spark, sf, "part").selectExpr("concat('app', p_partkey % 20) AS app", "element_at(array('p', 'c', 'f', 'm'), cast(p_partkey % 4 AS int) + 1) AS kind", "concat('p', p_partkey % 60, CASE WHEN p_partkey % 4 > 0 THEN concat('.K', p_partkey) ELSE '' END, CASE WHEN p_partkey % 4 > 1 THEN concat(';->m', p_partkey) ELSE '' END) AS key", "p_name AS truth", "p_name AS pred", "p_partkey % 3 = 0 AS matched", "p_partkey % 5 = 0 AS is_lib")
    return evaluate.flag_by_packages(rows).select("app", "kind", "key", "is_lib")


@query
def rendered_mapping(spark: SparkSession, sf: str) -> DataFrame:
    p = adapters.table(spark, sf, "part").selectExpr("concat('app', p_partkey % 20) AS app", "concat('K', p_partkey) AS cls", "CASE WHEN p_partkey % 3 = 0 THEN concat('K', p_partkey) ELSE replace(p_name, ' ', '_') END AS pred", "p_partkey AS k")
    m = p.selectExpr("app", "cls", "stack(2, 'f', 0, 'int', concat('f', k), CAST(NULL AS string), CASE WHEN k % 2 = 0 THEN concat('f', k) ELSE 'count' END, 'm', 1, 'void', concat('m', k), 'int,long', CASE WHEN k % 6 = 0 THEN concat('m', k) ELSE 'run' END) AS (kind, ord, type, name, params, pred)")
    return text.render_mapping(p.drop("k"), m).select("app", "cls", "block")


@query
def compare_report(spark: SparkSession, sf: str) -> DataFrame:
    return text.report_lines(adapters.compared_parts(spark, sf)).select("app", "value")


@query
def parsed_report(spark: SparkSession, sf: str) -> DataFrame:
    lines = text.report_lines(adapters.compared_parts(spark, sf))
    return text.parse_compare_lines(lines)


@query
def mapping_stats(spark: SparkSession, sf: str) -> DataFrame:
    truth, pred, _ = adapters.mappings(spark, sf)
    return mapping.mapping_stats(truth, pred)


@query
def merged_predictions(spark: SparkSession, sf: str) -> DataFrame:
    truth, pred, _ = adapters.mappings(spark, sf)
    return mapping.merge_predictions(truth, pred)


@query
def key_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Number of keys of either mapping and of equal entries, per app."""
    truth, pred, _ = adapters.mappings(spark, sf)
    both = mapping.key_union(truth, pred).groupBy("app").agg(F.count(F.lit(1)).alias("n_keys"))
    same = mapping.true_positives(truth, pred).groupBy("app").agg(F.count(F.lit(1)).alias("n_same"))
    return both.join(same, "app", "left").select("app", "n_keys", F.coalesce("n_same", F.lit(0)).alias("n_same"))


@query
def report_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.report_metrics(adapters.compared_parts(spark, sf), MODES)


@query
def overall_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.overall_metrics(adapters.compared_parts(spark, sf), MODES)


@query
def lib_split_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.lib_split_metrics(adapters.compared_parts(spark, sf))


@query
def metric_tables(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.metric_tables(evaluate.report_metrics(adapters.compared_parts(spark, sf), MODES), MODES)


@query
def report_flag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.report_flag_counts(adapters.compared_parts(spark, sf))


@query
def similar_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of the ``similar`` mode."""
    compared = with_similar_ratio(adapters.compared_parts(spark, sf), "truth", "pred")
    return evaluate.report_metrics(compared, ["similar"])


@query
def common_substr_matches(spark: SparkSession, sf: str) -> DataFrame:
    truth, pred, _ = adapters.mappings(spark, sf)
    return mapping.compare(truth, pred, "common_substr").where("matched").select("app", "kind", "key", "truth", "pred")


@query
def name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return with_name_similarity(adapters.compared_parts(spark, sf).select("app", "key", "truth", "pred"), "truth", "pred")


@query
def average_scores(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.average_scores(*adapters.obfuscated_nodes(spark, sf))


@query
def compare_totals(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.compare_totals(adapters.compared_parts(spark, sf))


@query
def inference_totals(spark: SparkSession, sf: str) -> DataFrame:
    p = adapters.table(spark, sf, "part").selectExpr("concat('app', p_partkey % 20) AS app", "p_partkey AS v", "p_partkey % 4 = 0 AS known", "CASE WHEN p_partkey % 9 = 0 THEN '?' ELSE p_name END AS label")
    result = adapters.table(spark, sf, "part").where("p_partkey % 7 <> 0").selectExpr("concat('app', p_partkey % 20) AS app", "p_partkey AS v", "CASE WHEN p_partkey % 5 = 0 THEN '?' WHEN p_partkey % 9 = 0 THEN '?' WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS label")
    return evaluate.inference_totals(p, result)


@query
def chained_signatures(spark: SparkSession, sf: str) -> DataFrame:
    origin = mapping.signature_map(adapters.mapping_lines(spark, sf))
    pred = origin.where("length(new_sig) % 2 = 0").select("app", "new_sig", F.upper("new_sig").alias("pred"))
    return evaluate.chain_signatures(origin, pred.distinct())


# -- words


@query
def split_names(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = adapters.obfuscated_nodes(spark, sf)
    return nodes.select("app", "id", F.array_join(C.split_name("original_name"), " ").alias("words"))


@query
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.vocabulary(adapters.words(spark, sf))


@query
def word_counts_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.word_counts_by_type(adapters.words(spark, sf), "lang")


@query
def filtered_words(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.filter_words(vocab.count_words(adapters.words(spark, sf)), adapters.words(spark, sf, "benchmark"))


@query
def ordered_words(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.ordered_word_ids(vocab.filter_words(vocab.count_words(adapters.words(spark, sf)), adapters.words(spark, sf, "benchmark")))


@query
def encoded_names(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts as word numbers of the document vocabulary, padded by batch."""
    items = adapters.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("words"))
    coded = vocab.encode_words(items, vocab.vocabulary(adapters.words(spark, sf)), "id")
    return vocab.padded_batches(coded, "id", 16).select("id", "batch", "place", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "length")


@query
def decoded_names(spark: SparkSession, sf: str) -> DataFrame:
    items = adapters.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("words"))
    v = vocab.vocabulary(adapters.words(spark, sf))
    return vocab.decode_words(vocab.encode_words(items, v, "id"), v, "id")


@query
def pattern_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Words that documents share with benchmark items: how many, and the first and last of them."""
    origins = adapters.words(spark, sf, "benchmark").select(F.col("doc").alias("origin_id"), F.col("word").alias("item"))
    patterns = adapters.words(spark, sf).select(F.col("doc").alias("pattern_id"), F.col("word").alias("item"))
    found = vocab.pattern_overlap(origins, patterns)
    return found.select("origin_id", "pattern_id", F.size("common").alias("n"), F.element_at("common", 1).alias("first"), F.element_at("common", -1).alias("last"))


# -- profiles


@query
def profile_counts(spark: SparkSession, sf: str) -> DataFrame:
    lib, methods, _ = adapters.profiles(spark, sf)
    return profiles.profile_counts(lib.union(methods.select("sig", "id")))


@query
def profile_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Stored library counts, reduced, with an app's counts added."""
    lib, methods, _ = adapters.profiles(spark, sf)
    stored = profiles.profile_reduce(profiles.profile_counts(lib, allow_minified=True))
    return profiles.add_counts(stored, profiles.profile_counts(profiles.profile_append(lib, methods.select("sig", "id"))))


@query
def profile_match(spark: SparkSession, sf: str) -> DataFrame:
    lib, methods, _ = adapters.profiles(spark, sf)
    return profiles.match_profiles(methods, lib).select("app", "node", "minified_id", F.array_join("lib_ids", ",").alias("lib_ids"))


@query
def name_votes(spark: SparkSession, sf: str) -> DataFrame:
    lib, methods, paths = adapters.profiles(spark, sf)
    return profiles.name_votes(profiles.match_profiles(methods, lib), paths)


@query
def best_names(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.best_names(name_votes(spark, sf))


@query
def ranked_choices(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.ranked_choices(name_votes(spark, sf))


@query
def recover_by_profiles(spark: SparkSession, sf: str) -> DataFrame:
    lib, methods, paths = adapters.profiles(spark, sf)
    return profiles.recover_by_profiles(methods, lib, paths)[1]


@query
def extended_relations(spark: SparkSession, sf: str) -> DataFrame:
    p = adapters.table(spark, sf, "part")
    stored = p.where("p_size <= 30").selectExpr("p_type AS sig", "concat('com.', lower(replace(p_brand, '#', '')), '.run', p_partkey % 40) AS id", "array(concat('ret:', p_size), 'para:int') AS relations")
    new = p.where("p_size > 15").selectExpr("p_type AS sig", "concat('com.', lower(replace(p_brand, '#', '')), '.run', p_partkey % 40) AS id", "array(concat('refer:', p_size), 'para:int') AS relations")
    return profiles.extend_relations(stored, new).select("sig", "id", F.array_join("relations", ",").alias("relations"))


@query
def propagate_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours resolved by what recovered methods relate to, and by the profiles of the methods so resolved."""
    return propagation.propagate_relations(*adapters.relation_tables(spark, sf))


@query
def library_members(spark: SparkSession, sf: str) -> DataFrame:
    """Packages named com.lib.* with all their classes and methods, by containment."""
    nodes, edges = adapters.program_graph(spark, sf)
    packages = nodes.where("type = 'package' AND sig LIKE 'com.lib.%'").select("app", F.col("id").alias("node"))
    contains = edges.where(F.col("relation").endswith("_contains")).select("app", F.col("source").alias("parent"), F.col("target").alias("child"))
    return profiles.propagate_library(packages, contains)


@query
def applied_names(spark: SparkSession, sf: str) -> DataFrame:
    """Recovered signatures of methods, carried to their classes."""
    nodes, edges = adapters.program_graph(spark, sf)
    found = nodes.where("type = 'method' AND id % 5 = 0").select("app", F.col("id").alias("node"), F.concat(F.lit("org.x.K"), (F.col("id") % 11).cast("string"), F.lit("."), "name").alias("sig"), F.col("id").alias("ord"))
    owners = edges.where("relation = 'C_M_contains'").select("app", F.col("target").alias("node"), F.col("source").alias("owner"))
    return profiles.apply_recovered(found, owners)


# -- obfuscation and feature graphs


@query
def obfuscation_rates(spark: SparkSession, sf: str) -> DataFrame:
    return features.obfuscation_rates(adapters.name_elements(spark, sf))


@query
def training_filter(spark: SparkSession, sf: str) -> DataFrame:
    return features.training_filter(features.obfuscation_rates(adapters.name_elements(spark, sf)))


@query
def edge_family_counts(spark: SparkSession, sf: str) -> DataFrame:
    return features.edge_family_counts(features.select_families(adapters.feature_edges(spark, sf)[0], relation="kind"), "kind")


@query
def ablation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return features.ablation_counts(adapters.feature_edges(spark, sf)[0], "kind")


@query
def valid_edges(spark: SparkSession, sf: str) -> DataFrame:
    return features.valid_edges(*adapters.feature_edges(spark, sf)).distinct()


@query
def order_edges(spark: SparkSession, sf: str) -> DataFrame:
    return features.drop_mutual_order(features.valid_edges(*adapters.feature_edges(spark, sf)).distinct())


@query
def scopes(spark: SparkSession, sf: str) -> DataFrame:
    edges, _ = adapters.feature_edges(spark, sf)
    return features.scopes(edges.select("app", F.col("kind").alias("scope"), F.col("a").alias("v"))).select("app", "scope", F.array_join("members", ",").alias("members"))


@query
def vertex_labels(spark: SparkSession, sf: str) -> DataFrame:
    p = adapters.table(spark, sf, "part").selectExpr("concat('app', p_partkey % 20) AS app", "p_partkey AS v", "element_at(array('class', 'method', 'field', 'type', 'modifier', 'constructor'), cast(p_partkey % 6 AS int) + 1) AS kind", "CASE WHEN p_partkey % 13 = 1 THEN '<init>' WHEN p_partkey % 3 = 0 THEN substr(p_name, 1, 2) ELSE p_name END AS name", "concat('sig.', p_partkey) AS sig", "p_partkey % 5 = 0 AS is_library")
    return features.promote_well_named(features.vertex_labels(p)).select("app", "v", "label", "known")


@query
def graph_split(spark: SparkSession, sf: str) -> DataFrame:
    """Edges kept and lost, and scopes kept, with vertices dealt into parts by number."""
    edges, vertices = adapters.feature_edges(spark, sf)
    parts = vertices.select("app", "v", (F.col("v") % 3).alias("part"))
    groups = features.scopes(edges.select("app", F.col("kind").alias("scope"), F.col("a").alias("v")))
    kept, lost, cut = features.split_graph(edges.distinct(), groups, parts)
    counts = kept.groupBy("app").agg(F.count(F.lit(1)).alias("kept")).join(lost, "app").join(cut.groupBy("app").agg(F.sum(F.size("members")).alias("scope_members")), "app")
    return counts


@query
def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    lists, heads = features.adjacency(adapters.feature_edges(spark, sf)[0])
    return lists.join(heads, "app").select("app", "id", F.array_join("neighbours", ",").alias("neighbours"), "vertices", "edges")


# -- logs, folds and statistics


@query
def phase_timings(spark: SparkSession, sf: str) -> DataFrame:
    events = adapters.table(spark, sf, "events")
    phases = evaluate.phase_events(events, "user_id", ["ts", "event_id"], "event_type", "ts", "view", "purchase")
    out = evaluate.phase_timings(phases, "user_id")
    return out.select("user_id", "n", *[F.round(c, 3).alias(c) for c in ("total", "longest", "mean")])


def _test_log(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.table(spark, sf, "events").selectExpr("concat('u', user_id) AS app", "event_id AS line", "CASE event_type WHEN 'signup' THEN 'pass' WHEN 'view' THEN 'predict_start' WHEN 'purchase' THEN 'predict_stop' WHEN 'click' THEN 'train_start' ELSE 'train_end' END AS event", "CASE WHEN event_type = 'signup' THEN cast(event_id % 10 AS string) END AS pass", "cast(event_id AS double) AS at")


@query
def test_log_phases(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.replay_log(_test_log(spark, sf))


@query
def strict_log_phases(spark: SparkSession, sf: str) -> DataFrame:
    """Phases of logs in which each event must be one that its state expects."""
    return replay.strict_replay(_test_log(spark, sf))


@query
def ill_formed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of logs that come in a state which does not expect them."""
    return replay.ill_formed(_test_log(spark, sf))


@query
def score_table(spark: SparkSession, sf: str) -> DataFrame:
    return text.score_table(adapters.score_lines(spark, sf)).select("app", "end_score", "edge_count", F.round("score", 9).alias("score"))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    e = adapters.table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.avg("value").alias("x"), (F.count_if(F.col("event_type") == "click") / F.count(F.lit(1))).alias("y")).withColumn("mode", F.when(F.col("user_id") % 2 == 0, "exact").otherwise("similar"))


@query
def score_regression(spark: SparkSession, sf: str) -> DataFrame:
    r = evaluate.score_regression(_points(spark, sf), "mode", "x", "y")
    return r.select("mode", "n", *[F.round(c, 8).alias(c) for c in ("slope", "intercept", "r")])


@query
def estimated_scores(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    fits = evaluate.score_regression(points.where("user_id % 3 <> 0"), "mode", "x", "y")
    return evaluate.estimate_from_scores(points.where("user_id % 3 = 0").select("x"), fits, "mode", "x").select("mode", F.round("estimate", 8).alias("estimate"))


@query
def similarity_cdf(spark: SparkSession, sf: str) -> DataFrame:
    e = adapters.table(spark, sf, "events")
    return evaluate.empirical_cdf(e.select("event_type", F.floor("value").alias("v")), "event_type", "v").select("event_type", "v", "n", F.round("y", 9).alias("y"))


@query
def folds(spark: SparkSession, sf: str) -> DataFrame:
    apps = adapters.elements(spark, sf).select("app")
    a = evaluate.folds(apps, "app", 10).withColumnRenamed("fold", "block")
    b = evaluate.folds(apps, "app", 10, kind="rolling").withColumnRenamed("fold", "rolling")
    c = evaluate.folds(apps, "app", 10, kind="split").withColumnRenamed("fold", "held")
    return a.join(b, "app").join(c, "app")


@query
def first_apps(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.first_apps(adapters.elements(spark, sf), "app", 5)


@query
def rate_log(spark: SparkSession, sf: str) -> DataFrame:
    lines = adapters.table(spark, sf, "part").selectExpr("concat('f', p_partkey % 10) AS file", "p_partkey AS line", "CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN cast(p_retailprice AS string) ELSE CASE WHEN p_partkey % 4 = 0 THEN concat('a/', p_name) ELSE cast(p_size AS string) END END AS value")
    return graphs.parse_rate_log(lines)


@query
def word_freq_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = adapters.table(spark, sf, "part").selectExpr("CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE concat(p_size, ' ', p_name) END AS value")
    return text.parse_word_freq(lines, 10)[0].groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("freq").alias("freq"))


# -- corpus collection


@query
def parsed_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.parse_artifacts(adapters.artifacts(spark, sf))[0].distinct()


@query
def paired_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.pair_artifacts(cut(corpus.parse_artifacts(adapters.artifacts(spark, sf))[0]))  # each path is parsed once


@query
def activity_texts(spark: SparkSession, sf: str) -> DataFrame:
    states, declared = adapters.screen_states(spark, sf)
    found = corpus.activity_texts(corpus.visited_activities(states, declared))
    return found.select("package", "activity", F.array_join(F.transform("views", lambda v: F.concat_ws("/", v[0]["text"], v[0]["rid"], v[0]["class"])), "|").alias("views"))


@query
def package_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Packages of library look that are in no application of their own."""
    el = adapters.elements(spark, sf).select("app", F.col("pkg").alias("package"), "own")
    only = corpus.package_difference(el.where("NOT own").drop("own"), el.where("own").drop("own"))
    shared = corpus.common_packages(el.where("app IN ('app1', 'app5')"), el.where("app IN ('app2', 'app6')"))
    return only.join(shared.withColumn("shared", F.lit(True)), "package", "left").select("app", "package", F.coalesce("shared", F.lit(False)).alias("shared"))


# -- files: written, read back and counted


def _files(spark: SparkSession, name: str) -> str:
    return new_folder(spark, name)


@query
def graph_files(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes and edges by app as read back from graph files."""
    nodes, edges = adapters.program_graph(spark, sf)
    path = _files(spark, "graphs")
    graphs.write_graphs(nodes, edges, path)
    nodes, edges = graphs.load_graphs(spark, path)
    app = F.regexp_extract("app", "app=([^/]+)/", 1).alias("app")
    n = nodes.groupBy(app).agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("id").alias("ids"), F.min("sig").alias("first"), F.max("sig").alias("last"))
    e = edges.groupBy(app).agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("source") * 3 + F.col("target")).alias("ends"))
    return n.join(e, "app")


@query
def appended_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """Node counts of two sets of app graphs, one after the other."""
    nodes, _ = adapters.program_graph(spark, sf)
    both = graphs.append_graphs([nodes.where("app < 'app2'"), nodes.where("app >= 'app2'").withColumn("extra", F.lit(1))])
    return both.groupBy("app", "type").agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("n_extra"))


@query
def feature_graph_files(spark: SparkSession, sf: str) -> DataFrame:
    """Labels, edges by family and kind, and scopes as read back from feature graph lines."""
    edges, vertices = adapters.feature_edges(spark, sf)
    path = _files(spark, "features")
    scopes_ = features.scopes(edges.select("app", F.col("kind").alias("scope"), F.col("a").alias("v")))
    null = lambda kind: F.lit(None).cast(kind)
    entry = lambda a, b, f2, cn, n: F.struct(a.alias("a"), b.alias("b"), f2.alias("f2"), cn.alias("cn"), n.alias("n"))
    pairs = edges.select("app", entry(F.col("a"), F.col("b"), F.col("kind"), null("string"), null("array<long>")).alias("q"))
    groups = scopes_.select("app", entry(null("long"), null("long"), null("string"), F.lit("!="), F.col("members")).alias("q"))
    lines = pairs.union(groups).groupBy("app").agg(F.collect_list("q").alias("query"))
    label = F.struct("v", F.when(F.col("is_library"), F.col("name")).alias("giv"), F.when(~F.col("is_library"), F.col("name")).alias("inf"))
    lines.join(vertices.groupBy("app").agg(F.collect_list(label).alias("assign")), "app").drop("app").write.json(path)
    assign, read, scopes_ = graphs.load_feature_graphs(spark, path)
    out = read.groupBy(F.col("f2").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a") * 100 + F.col("b")).alias("total"))
    known = F.when(F.col("known"), "known").otherwise("inferred").alias("what")
    out = out.union(assign.groupBy(known).agg(F.count("label"), F.sum("v")))
    members = F.aggregate("members", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.union(scopes_.select(F.lit("scope").alias("what"), members.alias("m")).groupBy("what").agg(F.count(F.lit(1)), F.sum("m")))


@query
def mapping_files(spark: SparkSession, sf: str) -> DataFrame:
    """Mappings parsed from files, a folder per app."""
    path = _files(spark, "mappings")
    lines = adapters.mapping_lines(spark, sf).repartition("app").sortWithinPartitions("app", "line")
    lines.select("app", "value").write.partitionBy("app").text(path)
    read = text.load_lines(spark, path, "part*").withColumn("app", F.regexp_extract("app", "app=([^/]+)/", 1))
    return mapping.parse_mapping(read)


@query
def kg_files(spark: SparkSession, sf: str) -> DataFrame:
    """Entities by sort of name, and lines by file, as read back from knowledge graph files."""
    entities, _, relations, triples = kg.build_knowledge_graph(*adapters.program_graph(spark, sf))
    path = _files(spark, "kg")
    graphs.write_kg(entities.withColumnRenamed("kg_id", "id"), relations.select(F.col("relation").alias("name"), F.col("relation_id").alias("id")), triples, path)
    read = graphs.load_entity_ids(spark, f"{path}/entity2id")
    sort = F.when(F.contains("name", F.lit("->node:")), "node").otherwise(F.substring_index("name", ":", 1))
    out = read.groupBy(sort.alias("what")).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))
    for name in ("relation2id", "train2id"):
        lines = spark.read.text(f"{path}/{name}")
        number = F.split("value", "\t")
        out = out.union(lines.where(F.size(number) > 1).select(F.lit(name).alias("what"), F.try_element_at(number, F.lit(2)).cast("long").alias("x")).groupBy("what").agg(F.count(F.lit(1)), F.sum("x")))
    return out


@query
def embedding_files(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as read back from embedding files of 500 vectors."""
    path = _files(spark, "embeddings")
    v = adapters.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    graphs.save_embeddings(v, path, 500)
    read = graphs.load_embeddings(spark, path, 500)
    return read.select("id", F.size("vector").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"))


@query
def library_files(spark: SparkSession, sf: str) -> DataFrame:
    """Libraries and how many hashes each has, as read back from the library store."""
    sets = _sets(spark, sf)[2]
    libs = library.collect_libraries(sets)
    path = _files(spark, "libraries")
    graphs.save_libraries(libs, library.library_hashes(sets, libs), path)
    libs, hashes, _ = graphs.load_libraries(spark, path)
    n = hashes.groupBy("lib_id").agg(F.count(F.lit(1)).alias("n_hashes"), F.min("hash").alias("first"))
    return libs.join(n, "lib_id").select("lib_name", "n_members", "n_hashes", "first")


@query
def stored_library_matches(spark: SparkSession, sf: str) -> DataFrame:
    """``library_matches`` against a library store, whose buckets are joined where they lie."""
    sets = _sets(spark, sf)[2]
    libs = library.collect_libraries(sets)
    path = _files(spark, "store")
    graphs.save_libraries(libs, library.library_hashes(sets, libs), path)
    _, hashes, members = graphs.load_libraries(spark, path)
    return library.match_libraries(sets, hashes, members=members).select("app", "package", "lib_name", "n_common")


@query
def activity_files(spark: SparkSession, sf: str) -> DataFrame:
    """Declared activities as read back from activity maps, a file for each thousand conversations."""
    path = _files(spark, "activities")
    _, declared = adapters.screen_states(spark, sf)
    views = F.array(F.create_map(F.lit("text"), F.col("activity")))
    per = declared.groupBy("package").agg(F.map_from_entries(F.collect_list(F.struct("activity", views.alias("v")))).alias("m"))
    block = F.floor(F.regexp_extract("package", "([0-9]+)$", 1).cast("long") / 1000)
    files = per.groupBy(block.alias("block")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("package", "m")))).alias("value"))
    files.repartition("block").write.partitionBy("block").text(path)
    return graphs.load_activity_map(spark, path)


# -- streams, run until their input is read


@query
def streamed_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Profile totals that a stream of library files adds up."""
    lib, methods, _ = adapters.profiles(spark, sf)
    path = _files(spark, "profile-stream")
    for part in (lib, methods.select("sig", "id")):
        part.coalesce(2).write.mode("append").json(f"{path}/in")
    stream = spark.readStream.schema(stream_profiles.PROFILE).option("maxFilesPerTrigger", 2).json(f"{path}/in")
    stream_profiles.keep_totals(stream, f"{path}/totals", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream_profiles.read_totals(spark, f"{path}/totals")


@query
def streamed_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The last score that a stream of log lines shows for each log."""
    path = _files(spark, "score-stream")
    adapters.score_lines(spark, sf).repartition(2, "app").sortWithinPartitions("app", "line").withColumnRenamed("app", "log").write.json(f"{path}/in")
    lines = spark.readStream.schema("log string, line long, value string").json(f"{path}/in")
    lines = lines.withColumn("value", F.regexp_replace("value", r"^\[info\] ", ""))
    blocks = stream_profiles.score_blocks(stream_profiles.edge_count_lines(lines))
    sink = blocks.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("log string, end_score double, edge_count long").parquet(f"{path}/out")
    return found.groupBy("log").agg(F.count(F.lit(1)).alias("n"), F.max("edge_count").alias("edges"), F.round(F.sum("end_score"), 4).alias("total"))
