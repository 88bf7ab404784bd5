"""Operators on hand-made tables: rules that the derived tables don't show."""

import hashlib
import json
import re

import pytest

from pyspark.sql import functions as F

from nomen import model
from nomen.operators import evaluate, features, graph, kg, library, mapping, matching, profiles, propagation, vocab
from nomen.sources import graphs, text


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_last_edge_wins(spark):
    e = spark.createDataFrame([("a", 0, 1, 2, "x"), ("a", 5, 1, 2, "y"), ("a", 1, 2, 1, "z")], "app string, ord long, source long, target long, relation string")
    assert rows(graph.latest_edges(e).select("source", "target", "relation")) == [(1, 2, "y"), (2, 1, "z")]


def library_corpus(spark):
    """Package L is equal in two apps and renamed in a third; getters share a shape under three names; one package is alone."""
    nodes, edges = [], []

    def package(app, start, name, children):
        nodes.append((app, start, "package", name, name))
        nodes.append((app, start + 1, "class", "K", f"{name}.K"))
        edges.append((app, start, start + 1, "P_C_contains"))
        for i, kids in enumerate(children):
            m = start + 2 + i
            nodes.append((app, m, "method", f"m{i}", f"<{name}.K: void m{i}()>"))
            edges.append((app, start + 1, m, "C_M_contains"))
            edges.extend((app, m, k, "M_T_return") for k in kids)

    for app in "123":
        nodes.extend((app, k, "type", f"t{k}", f"t{k}") for k in range(900, 906))
        nodes.append((app, 950, "modifier", "volatile", "volatile"))
    shape = [[900, 901], [902], [903, 904, 905]]
    package("1", 0, "L", shape)
    package("2", 0, "L", shape)
    package("3", 0, "a.b", shape)
    for app, name in (("1", "g.x"), ("2", "g.y"), ("3", "g.z")):
        package(app, 100, name, [[900], [900]])
    package("1", 200, "only", [[901], [905], [900, 905]])
    edges.append(("1", 2, 950, "M_M_modifier"))  # volatile can change, so it doesn't count
    n = spark.createDataFrame(nodes, "app string, id long, type string, name string, sig string")
    e = spark.createDataFrame([(a, i, s, t, r) for i, (a, s, t, r) in enumerate(edges)], "app string, ord long, source long, target long, relation string")
    return n, e


def test_library_groups_and_match(spark):
    n, e = library_corpus(spark)
    sets = library.package_hash_sets(n, e)
    libs = library.collect_libraries(sets)
    assert [(r["lib_name"], r["n_members"], r["packages"], r["paths"]) for r in libs.collect()] == [("L", 3, ["L", "a.b"], ["1", "2", "3"])]
    found = library.match_libraries(sets, library.library_hashes(sets, libs))
    assert rows(found.select("app", "package", "lib_name")) == [("1", "L", "L"), ("2", "L", "L"), ("3", "a.b", "L")]
    tagged = library.tag_library_nodes(n, found).where("app = '3' AND type LIKE '%_3lib'")
    assert rows(tagged.select("type").distinct()) == [("class_3lib",), ("method_3lib",), ("package_3lib",)]
    assert rows(library.superset_candidates(sets, library.library_hashes(sets, libs)).select("app", "package")) == [("1", "L"), ("2", "L"), ("3", "a.b")]


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_hash_sets_move_edges_twice(spark):
    n, e = library_corpus(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # edges by target and by source, static nodes and own nodes to meet them, the sets, and two for the packages
        assert exchanges(library.package_hash_sets(n, e)) <= 7
        assert exchanges(library.node_hash(n, e, model.LIBRARY_RELATIONS)) <= 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hash_sets_of_several_relations(spark):
    """The last of several relations counts, also if it is not listed; static children without a name are marked."""
    n = spark.createDataFrame([("a", 0, "class", "K", "p.K"), ("a", 1, "type", "int", "int"), ("a", 2, "type", None, "x"), ("a", 3, "class", "L", "q.L")], "app string, id long, type string, name string, sig string")
    e = spark.createDataFrame([("a", 0, 0, 1, "M_T_return"), ("a", 1, 0, 1, "other"), ("a", 2, 3, 2, "M_T_return")], "app string, ord long, source long, target long, relation string")
    empty = "d41d8cd98f00b204e9800998ecf8427e"
    assert rows(library.package_hash_sets(n, e)) == [("a", "p", empty), ("a", "q", empty), ("a", "q", library.NO_HASH)]


def test_structural_edges_move_once(spark):
    none = "CAST(array() AS array<string>)"
    classes = spark.sql(f"SELECT 'a' AS app, 'K' AS cls, 'p' AS package, 'S' AS super, CAST(NULL AS string) AS outer, {none} AS interfaces, array('public', 'public') AS modifiers UNION ALL SELECT 'a', NULL, 'p', 'S', 'K', {none}, {none}")
    fields = spark.sql(f"SELECT 'a' AS app, 'K' AS cls, 'K.f' AS field, 'int' AS type, {none} AS modifiers")
    methods = spark.sql(f"SELECT 'a' AS app, 'K' AS cls, 'K.m' AS method, 'K.m' AS ret, array('int', NULL, 'int') AS params, CAST(NULL AS array<string>) AS exceptions, array('K.f', 'K.f') AS uses_fields, {none} AS uses_methods, {none} AS modifiers, CAST(NULL AS boolean) AS is_constructor")
    found = graph.structural_edges(classes, fields.union(fields), methods)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert exchanges(found) == 1 and plan.index("Generate explode(to") < plan.index("Exchange")  # lists move, not their entries
    want = [("K", "K.f", "has_field"), ("K", "K.m", "has_method"), ("K", "S", "inherit"), ("K", "p", "belongs_to"), ("K", "public", "modifier"), ("K.f", "int", "type"), ("K.m", "K.f", "use_field"), ("K.m", "int", "parameter_0"), ("K.m", "int", "parameter_2")]
    assert rows(found.select("source", "target", "kind")) == want


def test_prefix_filter_equals_plain_join(spark):
    import random

    r = random.Random(3)
    pool = [f"h{i}" for i in range(60)]
    libs = {f"l{i:02d}": set(r.sample(pool, r.randint(3, 25))) for i in range(25)}
    packs = {}
    for i in range(60):
        base = set(r.choice(list(libs.values())))
        packs[f"p{i}"] = (base - set(r.sample(sorted(base), 1)) if i % 3 else base) | (set(r.sample(pool, 1)) if i % 2 else set())
    sets = spark.createDataFrame([("a", p, h) for p, hs in packs.items() for h in hs], "app string, package string, hash string")
    lib = spark.createDataFrame([(k, k, h) for k, hs in libs.items() for h in hs], "lib_id string, lib_name string, hash string")
    expected = []
    for p, hs in packs.items():
        good = sorted(k for k, ls in libs.items() if len(hs & ls) >= 3 and 10 * len(hs & ls) > 9 * len(hs))
        if good:
            expected.append((p, good[0], len(hs & libs[good[0]])))
    assert rows(library.match_libraries(sets, lib).select("package", "lib_id", "n_common")) == sorted(expected, key=str)
    assert rows(library.superset_candidates(sets, lib).select("package", "lib_id")) == sorted(((p, k) for p, hs in packs.items() for k, ls in libs.items() if hs <= ls), key=str)


def test_closure_with_circle(spark):
    pairs = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("a", 3, 1), ("a", 9, 1)], "app string, child int, parent int")
    circle = {1, 2, 3}
    assert rows(graph.closure(pairs, ["app"])) == sorted([("a", x, y) for x in (1, 2, 3, 9) for y in circle], key=str)
    empty = pairs.where("false")
    assert graph.closure(empty, ["app"]).count() == 0


def test_order_edges(spark):
    e = spark.createDataFrame([("a", 1, 2, "UO_MF_MF"), ("a", 2, 1, "UO_MF_MF"), ("a", 1, 3, "UO_MF_MF"), ("a", 1, 2, "UO_MF_MF_LIB"), ("a", 2, 1, "UO_MF_MF_LIB")], "app string, a int, b int, kind string")
    assert rows(features.drop_mutual_order(e)) == [("a", 1, 2, "UO_MF_MF_LIB"), ("a", 1, 3, "UO_MF_MF"), ("a", 2, 1, "UO_MF_MF_LIB")]


MAPPING = """com.example.ExampleActivity -> com.a.a:
    java.lang.String helloMessage -> a
    android.widget.TextView helloTextView -> b
    void onCreate(android.os.Bundle) -> onCreate
com.example.Util -> com.a.b:
    java.lang.String getMessage() -> a
    12:14:com.example.Util copy(com.example.Util,com.example.Util[]) -> c"""


def test_mapping_file(spark, tmp_path):
    (tmp_path / "mapping.txt").write_text(MAPPING)
    got = mapping.parse_mapping(text.load_lines(spark, str(tmp_path)))
    assert rows(got.select("kind", "key", "value")) == [
        ("c", "com.a.a", "ExampleActivity"),
        ("c", "com.a.b", "Util"),
        ("f", "com.a.a;->a:java.lang.String", "helloMessage"),
        ("f", "com.a.a;->b:android.widget.TextView", "helloTextView"),
        ("m", "com.a.b;->a()", "getMessage"),
        ("m", "com.a.b;->c(com.a.b,com.example.Util[])", "copy"),
        ("p", "com.a", "example"),
    ]


def test_identity_prediction_scores_one(spark):
    m = spark.createDataFrame([("a", k, f"{k}{i}", f"v{i}") for k in "pcfm" for i in range(3)], "app string, kind string, key string, value string")
    stats = mapping.mapping_stats(m, m)
    assert all(r["recall"] == r["precision"] == 1.0 for r in stats.collect())
    none = mapping.mapping_stats(m, m.where("false"))
    assert all(r["precision"] == 1.0 and r["recall"] == 0.0 for r in none.collect())


def test_report_round_trip(spark, tmp_path):
    c = spark.createDataFrame([("a", "c", "x.Y", "N", "N", True, True), ("a", "p", "x", "n", None, False, False)], "app string, kind string, key string, truth string, pred string, matched boolean, is_lib boolean")
    text.write_compare_report(c, str(tmp_path / "r"))
    lines = spark.read.text(str(tmp_path / "r"), wholetext=False)
    assert sorted(r["value"] for r in lines.collect()) == ["[P](degd) x n/?", "[c](3lib) x.Y N/N"]
    parsed = text.load_compare_reports(spark, str(tmp_path / "r"), "part*", r"app=([^/]+)/")
    assert rows(parsed) == rows(c.select("app", "kind", "matched", "is_lib", "key", "truth", "pred"))
    old = spark.createDataFrame([("a", 0, "[c] com.a.b Util/Helper"), ("a", 1, "noise")], "app string, line int, value string")
    assert rows(text.parse_compare_lines(old).select("kind", "is_lib", "key", "truth", "pred")) == [("c", False, "com.a.b", "Util", "Helper")]


def test_graph_files(spark, tmp_path):
    g = {"nodes": [{"id": 0, "type": "package", "name": "p", "sig": "p"}, {"id": 1, "type": "class", "name": "K", "sig": "p.K"}], "edges": [{"source": 0, "target": 1, "relation": "P_C_contains"}]}
    (tmp_path / "in" / "x").mkdir(parents=True)
    (tmp_path / "in" / "x" / "g.json").write_text(json.dumps(g, indent=1))
    (tmp_path / "in" / "g.json").write_text("{ not json")
    nodes, edges = graphs.load_graphs(spark, str(tmp_path / "in"), "g.json")
    assert rows(nodes.select("id", "type")) == [(0, "package"), (1, "class")]
    assert rows(edges.select("ord", "source", "target")) == [(0, 0, 1)]
    graphs.write_graphs(nodes.select("app", "id", "type", "name", "sig"), edges, str(tmp_path / "out"))
    again, e2 = graphs.load_graphs(spark, str(tmp_path / "out"), "*.json")
    assert (again.count(), e2.count()) == (2, 1)


def test_feature_lines(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"query": [{"a": 0, "b": 1, "f2": "OO_x"}, {"cn": "!=", "n": [1, 0]}], "assign": [{"v": 0, "giv": "g"}, {"v": 1, "inf": "i"}]}) + "\n")
    assign, edges, scopes = graphs.load_feature_graphs(spark, str(tmp_path))
    assert rows(assign.select("v", "known", "label")) == [(0, True, "g"), (1, False, "i")]
    assert rows(edges.select("a", "b", "f2")) == [(0, 1, "OO_x")]
    assert scopes.first()["members"] == [1, 0]


def test_kg_files(spark, tmp_path):
    ent = spark.createDataFrame([("b", 1), ("a", 0)], "name string, id long")
    rel = spark.createDataFrame([("r", 0)], "name string, id long")
    tri = spark.createDataFrame([(0, 1, 0)], "head long, tail long, relation long")
    graphs.write_kg(ent, rel, tri, str(tmp_path / "kg"))
    lines = [x for f in sorted((tmp_path / "kg" / "entity2id").glob("part*")) for x in f.read_text().splitlines()]
    assert lines == ["2", "a\t0", "b\t1"]
    assert rows(graphs.load_entity_ids(spark, str(tmp_path / "kg" / "entity2id"))) == [("a", 0), ("b", 1)]
    (tmp_path / "e.json").write_text(json.dumps({"ent_embeddings": [[1.0, 2.0], [3.0, 4.0]]}))
    assert rows(graphs.load_embeddings(spark, str(tmp_path / "e.json"))) == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]


def test_dense_ids_any_partitions(spark):
    df = spark.createDataFrame([(f"n{i:03d}",) for i in range(50)], "name string").repartition(7)
    for n in (1, 4, 9):
        got = kg.dense_ids(df, ["name"], start=3, partitions=n)
        assert rows(got.select("name", "kg_id")) == [(f"n{i:03d}", i + 3) for i in range(50)]


def test_score_logs(spark, tmp_path):
    (tmp_path / "s.log").write_text("I End score 1.5\nI Edge count 4\nI End score 3.0\nI Edge count 0\n")
    got = text.load_score_logs(spark, str(tmp_path)).first()
    assert (got["end_score"], got["edge_count"], got["score"]) == (3.0, 0, 1.0)


def test_other_sources(spark, tmp_path):
    (tmp_path / "rates").mkdir()
    (tmp_path / "rates" / "log").write_text("one\n0.5\na/b\n0.7\ntwo\n0.25\n0.3\n")
    assert rows(graphs.load_rate_log(spark, str(tmp_path / "rates")).select("name", "rate")) == [("one", 0.5), ("two", 0.25), ("two", 0.3)]
    (tmp_path / "words").mkdir()
    (tmp_path / "words" / "w").write_text("12 get\n3 set\nbad line\n")
    assert rows(text.load_word_freq(spark, str(tmp_path / "words"), 5)) == [("get", 12)]
    (tmp_path / "acts.json").write_text(json.dumps({"p": {"A": [{"text": "t"}], "B": []}, "q": {"C": []}}))
    assert rows(graphs.load_activity_map(spark, str(tmp_path / "acts.json"), "p")) == [("p", "A"), ("p", "B")]


def test_pattern_overlap(spark):
    origins = spark.createDataFrame([(7, 0), (7, 1), (7, 2), (8, 4), (8, 4)], "origin_id int, item int")
    patterns = spark.createDataFrame([(i, x) for i, p in enumerate([[0, 1, 3], [0, 2, 3], [0, 3, 4]]) for x in p], "pattern_id int, item int")
    assert rows(vocab.pattern_overlap(origins, patterns, salts=2)) == [(7, 0, [0, 1]), (7, 1, [0, 2]), (7, 2, [0]), (8, 2, [4])]


def test_containment_in_circles(spark):
    nodes = spark.createDataFrame([("a", i) for i in range(7)], "app string, id long")
    up = [(1, 0), (2, 1), (3, 2), (4, 5), (5, 6), (6, 5)]  # 0 holds 1 holds 2 holds 3; 5 and 6 hold each other
    edges = spark.createDataFrame([("a", i, p, c, "X_contains") for i, (c, p) in enumerate(up)], "app string, ord long, source long, target long, relation string")
    got = rows(graph.containment_paths(nodes, edges).where("depth > 0").select("id", "ancestor", "depth"))
    assert got == [(1, 0, 1), (2, 0, 2), (2, 1, 1), (3, 0, 3), (3, 1, 2), (3, 2, 1), (4, 5, 1), (4, 6, 2), (5, 6, 1), (6, 5, 1)]


def test_containment_of_a_long_chain(spark):
    n = 300
    nodes = spark.range(n).selectExpr("'a' AS app", "id")
    edges = spark.range(1, n).selectExpr("'a' AS app", "id AS ord", "id - 1 AS source", "id AS target", "'X_contains' AS relation")
    got = graph.containment_paths(nodes, edges)
    assert got.count() == n * (n + 1) // 2 and got.where("depth <> id - ancestor").count() == 0


def test_closure_equals_brute_force(spark):
    import random

    r = random.Random(3)
    pairs = {(r.randrange(25), r.randrange(25)) for _ in range(40)}
    want = set(pairs)
    while more := {(a, d) for a, b in want for c, d in pairs if b == c} - want:
        want |= more
    df = spark.createDataFrame([("a", *p) for p in pairs], "app string, child long, parent long")
    assert rows(graph.closure(df, ["app"]).select("child", "ancestor")) == sorted(want, key=str)
    assert graph.closure(df.where("false"), ["app"]).count() == 0


def test_dense_numbers_within_groups(spark):
    df = spark.createDataFrame([(g, f"x{i:02d}") for g in ("a", "b", "c") for i in range(ord(g) - 90)], "app string, k string").repartition(5)
    want = sorted((g, f"x{i:02d}", i + 1) for g in ("a", "b", "c") for i in range(ord(g) - 90))
    assert rows(kg.dense_within(df, "app", ["k"], 1).select("app", "k", "id")) == want


def test_kmeans_finds_separate_groups(spark):
    data = [(i, [float(10 * (i % 3)) + 0.01 * i, float(-7 * (i % 3))], f"n{i % 3}") for i in range(30)] + [(30, None, "none")]
    df = spark.createDataFrame(data, "id long, vector array<float>, name string")
    got = kg.kmeans_names(df.select("id", "vector"), df.select("id", "name"), k=3).collect()
    assert sorted((x["n"], set(x["names"]) == {x["names"][0]}) for x in got) == [(10, True)] * 3


def test_similarities_by_hand(spark):
    from nomen.functions import similarity

    pairs = [("abcd", "bcde", 0.75), ("same", "same", 1.0), ("", "", 1.0), ("abc", "xyz", 0.0), ("getName", "setName", 6 / 7), ("tide", "diet", 0.25), (None, "a", None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string").withColumn("_left", F.lit(1))
    got = {(x["a"], x["b"]): x["ratio"] for x in similarity.with_ratio(df, "a", "b").collect()}
    assert all(got[a, b] == (pytest.approx(want) if want is not None else None) for a, b, want in pairs)
    similarity.register(spark)
    x = spark.sql("SELECT name_ratio('abcd', 'bcde') AS r, word_similarity(array('get', 'name'), array('set', 'name')) AS w").first()
    assert (x["r"], x["w"]) == (0.75, 0.5)


def test_propagate_relations(spark):
    sets = spark.createDataFrame(
        [("a", 0, ["para:x", "ret:y"], [(1, "para"), (2, "ret")]), ("a", 1, ["refer:u", "refer:v"], [(3, "refer"), (4, "refer")]), ("a", 2, ["refer:u", "refer:w"], [(3, "refer"), (5, "refer")])],
        "app string, ord int, relations array<string>, neighbours array<struct<node:long,relation:string>>",
    )
    assert rows(propagation.propagate_relations(sets).select("node", "name")) == [(1, "x"), (2, "y"), (3, "u"), (4, "v"), (5, "w")]


def test_propagate_relations_of_a_large_app(spark):
    n = 10_050
    sets = spark.range(n).selectExpr("'a' AS app", "id AS ord", "array(concat('para:x', id)) AS relations", "array(struct(id AS node, 'para' AS relation)) AS neighbours")
    got = propagation.propagate_relations(sets)
    assert got.count() == n and got.where("name <> concat('x', node)").count() == 0


def test_recover_library_names(spark):
    n, e = library_corpus(spark)
    edges = e.where(F.col("relation") == "M_T_return")
    hashed = n.join(library.node_hash(n, e, model.LIBRARY_RELATIONS), ["app", "id"], "left").withColumn("static", F.col("type").isin("type", "modifier"))
    pick = lambda app: hashed.where((F.col("app") == app) & ((F.col("id") < 100) | F.col("static")) & (F.col("type") != "modifier"))
    pn = pick("3").select("app", F.lit("a.b").alias("package"), "id", "type", "name", "sig", "hash", "static")
    pe = edges.where("app = '3' AND source < 100").select("app", F.lit("a.b").alias("package"), "source", "target", "relation")
    ln = pick("1").select(F.lit("L").alias("lib_id"), "id", "type", "name", "sig", "hash", "static")
    le = edges.where("app = '1' AND source < 100").select(F.lit("L").alias("lib_id"), "source", "target", "relation")
    candidates = spark.createDataFrame([("3", "a.b", "L")], "app string, package string, lib_id string")
    got = matching.recover_library_names(candidates, pn, pe, ln, le)
    assert ("<L.K: void m2()>",) in rows(got.where("id = 4").select("recovered_sig"))
    assert got.count() == 5


def test_folds_and_phases(spark):
    assert evaluate.folds(spark.createDataFrame([("x",)], "id string"), "id", 10).count() == 1
    items = spark.createDataFrame([(f"a{i}",) for i in range(23)], "id string")
    sizes = lambda kind: sorted(r["count"] for r in evaluate.folds(items, "id", 10, kind=kind).groupBy("fold").count().collect())
    assert sizes("blocks") == [2] * 7 + [3] * 3
    assert sizes("rolling") == [2] * 10 + [3]
    assert sizes("split") == [2, 21]
    log = spark.createDataFrame([("l", i, ev, p, float(t)) for i, (ev, p, t) in enumerate([("pass", "1", 0), ("train_start", None, 1), ("train_end", None, 5), ("predict_stop", None, 6), ("predict_start", None, 7), ("predict_stop", None, 9), ("predict_start", None, 10)])], "app string, line int, event string, pass string, at double")
    r = evaluate.replay_log(log).first()
    assert (r["train_seconds"], r["predict_count"], r["predict_total"], r["predict_mean"]) == (4.0, 1, 2.0, 2.0)


def test_streams_equal_batch(spark, tmp_path):
    from nomen.streaming import profiles as sp

    rows_ = [("s1", "com.foo.bar"), ("s1", "com.foo.bar"), ("s2", "com.foo.a"), ("s2", "com.foo.baz")]
    for i in range(2):
        spark.createDataFrame(rows_[2 * i : 2 * i + 2], sp.PROFILE).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = sp.read_profiles(spark, str(tmp_path / "in"))
    q = sp.keep_totals(stream, str(tmp_path / "totals"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = rows(profiles.profile_counts(spark.createDataFrame(rows_, sp.PROFILE)))
    assert rows(sp.read_totals(spark, str(tmp_path / "totals"))) == want
    slow = spark.readStream.schema(sp.PROFILE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for _ in range(2):  # run again, nothing is new
        sp.keep_totals(slow, str(tmp_path / "t2"), str(tmp_path / "cp2"), 2).trigger(availableNow=True).start().awaitTermination(120)
        assert rows(sp.read_totals(spark, str(tmp_path / "t2"))) == want
    assert sp.read_totals(spark, str(tmp_path / "none")).count() == 0


def test_streamed_score_blocks(spark, tmp_path):
    from nomen.streaming import profiles as sp

    spark.createDataFrame([("l", "Edge count 3\nEnd score 1.5\nnoise\nEnd score 2.0")], "log string, t string").selectExpr("log", "explode(split(t, '\n')) AS value").coalesce(1).write.json(str(tmp_path / "in"))
    lines = sp.edge_count_lines(spark.readStream.schema("log string, value string").json(str(tmp_path / "in")))
    q = sp.score_blocks(lines).writeStream.format("memory").queryName("score_blocks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("score_blocks")) == [("l", 1.5, 3), ("l", 2.0, None)]


def test_silent_logs_leave_the_state(spark, tmp_path):
    import time

    from nomen.streaming import profiles as sp

    def write(*found):
        spark.createDataFrame(list(found), "log string, value string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def held(q):
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    def wait(done):
        until = time.time() + 60
        while not done():
            assert time.time() < until and q.isActive
            time.sleep(0.5)

    write(("silent", "Edge count 3"), ("ended", "Edge count 4"), ("ended", "End score 1.0"))
    lines = spark.readStream.schema("log string, value string").json(str(tmp_path / "in"))
    blocks = sp.score_blocks(lines, 500).writeStream.format("memory").queryName("silent_logs").outputMode("append")
    q = blocks.option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        wait(lambda: spark.table("silent_logs").count() == 1 and held(q) == 0)  # the silent log alone was held, until its time was up
        write(("silent", "End score 2.0"))
        wait(lambda: spark.table("silent_logs").count() == 2)
    finally:
        q.stop()
    assert rows(spark.table("silent_logs")) == [("ended", 1.0, 4), ("silent", 2.0, None)]


def test_edges_meet_either_end_once(spark):
    n = spark.createDataFrame([("a", 0, "class", "K", "p.K"), ("a", 1, "type", "int[]", "int[]"), ("a", 2, "method", "m", "m")], "app string, id long, type string, name string, sig string")
    e = spark.createDataFrame([("a", 0, 2, 1, "MT_return"), ("a", 1, 0, 2, "XX_contains"), ("a", 2, 2, 9, "MT_return")], "app string, ord long, source long, target long, relation string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = graph.resolve_arrays(n, graph.latest_edges(e))[1]
        assert edges._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") <= 12  # 14 when types and arrays were joined apart
        assert rows(edges) == [("a", 0, 2, 3, "M_[T_return"), ("a", 1, 0, 2, "C_M_contains")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_normalised_edges_carry_their_ends(spark):
    n = spark.createDataFrame([("a", 3, "class", "K", "p.K"), ("a", 5, "type", "int[]", "int[]"), ("a", 7, "method", "m", "m"), ("a", 9, "class", "L", "p.L")], "app string, id long, type string, name string, sig string")
    e = spark.createDataFrame([("a", 0, 7, 5, "MT_return"), ("a", 1, 3, 7, "XX_contains")], "app string, ord long, source long, target long, relation string")
    nodes, edges = graph.normalise_graph(n, e, columns=("type", "name"))
    want = [("a", 0, 1, 2, "M_[T_return", "method", "m", "type", "int"), ("a", 1, 0, 1, "C_M_contains", "class", "K", "method", "m")]
    assert rows(edges.select("app", "ord", "source", "target", "relation", "source_type", "source_name", "target_type", "target_name")) == want
    assert rows(graph.with_endpoints(edges.select("app", "ord", "source", "target", "relation"), nodes, ("type", "name")).select(*edges.columns)) == rows(edges)
    assert rows(nodes.select("app", "id", "type", "name", "sig")) == [("a", 0, "class", "K", "p.K"), ("a", 1, "method", "m", "m"), ("a", 2, "type", "int", "int")]
    assert "BroadcastHashJoin [app" not in edges._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("Scan")[0]


def test_dense_ids_shuffle_rows_once(spark):
    df = spark.createDataFrame([(f"n{i}",) for i in range(40)], "name string")
    found = kg.dense_ids(df, ["name"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0]  # before: the written rows were dealt by part again
    assert [r["name"] for r in found.orderBy("kg_id").collect()] == sorted(f"n{i}" for i in range(40))


def test_package_subgraph_meets_edges_once(spark):
    n = [(0, "class", "K", "p.K"), (1, "class", "L", "p.q.L"), (2, "method", "m", "<p.K: void m()>"), (3, "type", "int", "int"), (4, "class_lib", "S", "java.S"), (5, "package", "p", "p"), (6, "package", "q", "p.q")]
    n = spark.createDataFrame([("a", *x) for x in n], "app string, id long, type string, name string, sig string")
    e = [(0, 0, 2, "C_M_contains"), (1, 2, 3, "M_C_refer"), (2, 2, 3, "M_T_return"), (3, 2, 4, "M_C_refer"), (4, 0, 4, "other"), (5, 1, 4, "M_C_refer"), (6, 2, 0, "M_C_refer")]
    e = spark.createDataFrame([("a", *x) for x in e], "app string, ord long, source long, target long, relation string")
    md5 = lambda *names: hashlib.md5("\n".join(names).encode()).hexdigest()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes, edges = library.package_subgraph(n, e, recursive=True)
        q = [("a", "p.q", 1, md5("S"), False), ("a", "p.q", 4, None, True), ("a", "p.q", 6, None, False)]
        p = [("a", "p", 0, md5(), False), ("a", "p", 1, md5("S"), False), ("a", "p", 2, md5("S", "int"), False), ("a", "p", 3, None, True), ("a", "p", 4, None, True), ("a", "p", 5, None, False), ("a", "p", 6, None, False)]
        assert rows(nodes.select("app", "package", "id", "hash", "static")) == sorted(p + q, key=str)
        assert rows(edges) == sorted([("a", "p", 2, 3, "M_T_return"), ("a", "p", 2, 4, "M_C_refer"), ("a", "p", 1, 4, "M_C_refer"), ("a", "p.q", 1, 4, "M_C_refer")], key=str)
        plan = nodes._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(app#\d+, source#\d+L, target#\d+L", plan)  # before: all edges were dealt by their ends too
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
