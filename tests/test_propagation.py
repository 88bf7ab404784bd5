"""Propagation of names against a replay of its rules in plain Python."""

import random

import pytest

from nomen.operators import propagation
from nomen.sources import adapters

KINDS = ("para", "ret", "refer")


def kind(text):
    return next((i for i, k in enumerate(KINDS) if text.startswith(k)), None)


def minified(name):
    parts = name.split(".")
    return len(parts) >= 2 and (len(parts[-1].split("$")[0]) == 1 or len(parts[-2].split("$")[0]) == 1)


def replay(sets, methods=(), near=(), stored=()):
    """Rounds over plain sets; all of them are judged anew in every round."""
    live, names = {}, {}
    for app, ord_, relations, neighbours in sets:
        rel, nodes = live.setdefault((app, 0, ord_), (set(), {}))
        rel.update(relations)
        for node, relation in neighbours:
            nodes[node] = max(relation, nodes.get(node, relation))
    of = {(app, node): (sig, owner) for app, node, sig, owner in methods}
    around, profile = {}, {}
    for app, node, neighbour, relation in near:
        own = around.setdefault((app, node), {})
        own[neighbour] = max(relation, own.get(neighbour, relation))
    for id_, sig, relations in stored:
        profile[id_, sig] = min(list(relations), profile.get((id_, sig), list(relations)))
    turn = 0
    while True:
        turn += 1
        best = {}
        for (app, t, o), (rel, nodes) in live.items():
            for k in range(3):
                rs, ns = [r for r in rel if kind(r) == k], [n for n, x in nodes.items() if kind(x) == k]
                if len(rs) == len(ns) == 1:
                    best[app, ns[0]] = min(best.get((app, ns[0]), ((9,), "")), ((0, t, o, k, ns[0]), rs[0]))
        member = {}
        for (app, t, o), (rel, nodes) in live.items():
            for n in nodes:
                member.setdefault((app, n), []).append((app, t, o))
        for (app, n), keys in member.items():
            common = set.intersection(*(live[x][0] for x in keys))
            if len(common) == 1:
                best[app, n] = min(best.get((app, n), ((9,), "")), ((1, 0, 0, 0, n), common.pop()))
        first = {}
        for x, (rank, r) in best.items():
            for s in member[x]:
                first[s, r] = min(first.get((s, r), rank), rank)
        goes = {x: r for x, (rank, r) in best.items() if all(first[s, r] == rank for s in member[x])}
        if not goes:
            return sorted((*x, name) for x, name in names.items())
        for (app, n), r in goes.items():
            names[app, n] = r.partition(":")[2] if ":" in r else r
            for s in member[app, n]:
                live[s][0].discard(r)
                live[s][1].pop(n)
        for app, n in goes:
            if (app, n) not in of:
                continue
            sig, owner = of[app, n]
            id_ = f"{owner}.{names[app, n]}"
            if minified(id_) or (id_, sig) not in profile:
                continue
            rel = {r for r in profile[id_, sig] if not r.endswith("init>")}
            now = {k: f"{r.split(':')[0]}:{names[app, k]}" if (app, k) in names else r for k, r in around.get((app, n), {}).items()}
            now = {k: r for k, r in sorted(now.items()) if not r.endswith("init>")}
            known = []
            for k, r in now.items():
                if r in rel:
                    rel.discard(r)
                    known.append(k)
            open_ = {k: r for k, r in now.items() if k not in known and (app, k) not in names}
            if rel and open_:
                live[app, turn, n] = (rel, open_)


SCHEMAS = (
    "app string, ord long, relations array<string>, neighbours array<struct<node:long,relation:string>>",
    "app string, node long, sig string, owner string",
    "app string, node long, neighbour long, relation string",
    "id string, sig string, relations array<string>",
)


def run(spark, *tables):
    frames = [spark.createDataFrame(t, s) for t, s in zip(tables, SCHEMAS)]
    return sorted(map(tuple, propagation.propagate_relations(*frames).collect()))


def test_chain_of_three(spark):
    """A set resolves a method, whose profile resolves the next one, whose profile resolves a third."""
    sets = [("a", 1, ["refer:two"], [(2, "refer")])]
    methods = [("a", n, f"s{n}", "com.lib.Cls") for n in (2, 3, 4)]
    near = [("a", 2, 3, "refer:x"), ("a", 2, 9, "refer:<init>"), ("a", 2, 8, "ret:int"), ("a", 3, 4, "para:y"), ("a", 3, 2, "refer:z"), ("a", 4, 2, "ret:q")]
    stored = [
        ("com.lib.Cls.two", "s2", ["refer:three", "refer:<init>", "ret:int"]),
        ("com.lib.Cls.three", "s3", ["para:four", "refer:two"]),
        ("com.lib.Cls.three", "other", ["para:wrong"]),
        ("com.lib.Cls.four", "s4", ["ret:two", "ret:five"]),
    ]
    want = [("a", 2, "two"), ("a", 3, "three"), ("a", 4, "four")]
    assert run(spark, sets, methods, near, stored) == want == replay(sets, methods, near, stored)
    assert run(spark, sets) == want[:1]


def random_case(seed):
    r = random.Random(seed)
    names = [f"name{i}" for i in range(12)] + ["x"]
    relation = lambda: f"{r.choice(KINDS)}:{r.choice(names)}"
    apps, nodes = ("a", "b"), range(14)
    sets = [(r.choice(apps), i, r.sample([relation() for _ in range(6)], r.randrange(1, 4)), [(r.choice(nodes), r.choice(KINDS)) for _ in range(r.randrange(1, 4))]) for i in range(6)]
    methods = [(app, n, f"s{n % 2}", "com.Cls") for app in apps for n in nodes if n % 5]
    near = [(app, n, r.choice(nodes), r.choice([relation(), relation(), "refer:<init>"])) for app in apps for n in nodes for _ in range(3)]
    stored = [(f"com.Cls.{name}", f"s{r.randrange(2)}", r.sample([relation() for _ in range(6)] + ["ret:<init>"], r.randrange(1, 4))) for name in names for _ in range(2)]
    return sets, methods, near, stored


@pytest.mark.parametrize("seed", [1, 2, 5])
def test_random_graphs(spark, seed):
    case = random_case(seed)
    want = replay(*case)
    assert run(spark, *case) == want and len(want) >= len(replay(case[0]))


def test_growth_is_tried(spark):
    assert any(len(replay(*random_case(s))) > len(replay(random_case(s)[0])) for s in range(6))


def test_no_sets(spark):
    assert run(spark, [], *random_case(1)[1:]) == []


def test_tables(spark, sf_dir):
    frames = adapters.relation_tables(spark, sf_dir)
    tables = [[tuple(r) for r in f.select(*[c.strip().split(" ")[0] for c in s.split(", ")]).collect()] for f, s in zip(frames, SCHEMAS)]
    want = replay(*tables)
    assert sorted(map(tuple, propagation.propagate_relations(*frames).collect())) == want
    assert len(want) > len(replay(tables[0]))


def test_large_rounds_broadcast_nothing(spark):
    each = spark.range(1, 3).selectExpr("'a' AS app", "cast(0 AS long) AS turn", "id AS ord", "1 AS kind")  # of known, small size
    rel, near = each.selectExpr("app", "turn", "ord", "concat('ret:', ord) AS r", "kind"), each.selectExpr("app", "turn", "ord", "ord + 6 AS node", "kind")
    live = rel.select("app", "turn", "ord")
    for n, broadcasts in ((propagation.LARGE - 1, True), (propagation.LARGE, False)):
        found = propagation._proposals(rel, near, live, propagation._side(n))
        assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) == broadcasts
        assert sorted((x["node"], x["r"]) for x in found.collect()) == [(7, "ret:1"), (8, "ret:2")]
