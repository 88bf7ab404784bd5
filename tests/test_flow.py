"""Circles, reach of many roots and flow within methods against brute force."""

import random

from nomen.operators import flow


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def closed(pairs):
    """All (key, x, y) with a way of one step or more from x to y."""
    want = set(pairs)
    while more := {(k, x, z) for k, x, y in want for k2, y2, z in pairs if k == k2 and y == y2} - want:
        want |= more
    return want


def calls_of(r, app, n, m):
    return [(app, f"m{r.randrange(n):02}", f"m{r.randrange(n):02}") for _ in range(m)]


CALLS = "app string, caller string, callee string"


def test_circles(spark):
    r = random.Random(3)
    calls = calls_of(r, "a", 30, 38) + calls_of(r, "b", 20, 18) + [("ring", f"m{i:02}", f"m{(i + 1) % 12:02}") for i in range(12)] + [("self", "x", "x"), ("a", None, "m01"), ("a", "m01", None)]
    every = closed([c for c in calls if None not in c])
    want = {}
    for app, x, y in every:
        if x != y and (app, y, x) in every:
            want[app, x] = min(want.get((app, x), x), y)
    df = spark.createDataFrame(calls + calls[:5], CALLS)
    got = rows(flow.call_circles(df))
    assert got == sorted(((app, x, c) for (app, x), c in want.items()), key=str) and {g[0] for g in got} >= {"a", "ring"}
    assert flow.call_circles(df.where("false")).count() == 0


def test_reach_of_many_roots(spark):
    """More roots than a row of bits holds, circles, roots without calls, several methods a root."""
    r = random.Random(5)
    calls = calls_of(r, "a", 40, 46) + calls_of(r, "b", 15, 25) + [("a", "m03", None)]
    roots = [("a", f"R{i}", f"m{r.randrange(40):02}") for i in range(150)] + [("b", f"R{i % 7}", f"m{i:02}") for i in range(15)] + [("c", "R", "alone"), ("a", None, "m01"), ("a", "R", None)]
    every = closed([c for c in calls if None not in c])
    start = {x for x in roots if None not in x}
    want = start | {(app, root, y) for app, root, m in start for k, x, y in every if (k, x) == (app, m)}
    df, starts = spark.createDataFrame(calls, CALLS), spark.createDataFrame(roots + roots[:9], "app string, root string, method string")
    assert rows(flow.reach_from(starts, df)) == sorted(want, key=str)
    assert rows(flow.reach_from(starts, df.where("false"))) == sorted(start, key=str)
    assert flow.reach_from(starts.where("false"), df).count() == 0


def test_a_circle_shares_one_set(spark):
    """What is written for a circle of 200 methods that 100 roots reach: two rows."""
    calls = spark.createDataFrame([("a", f"m{i}", f"m{(i + 7) % 200}") for i in range(200)], CALLS)
    roots = spark.createDataFrame([("a", f"R{i}", f"m{i}") for i in range(100)], "app string, root string, method string")
    members, sets, _ = flow.reach_sets(roots, calls)
    assert sets.count() == 2 and members.select("n").distinct().count() == 1 and members.count() == 200


def test_async_classes(spark):
    calls = spark.createDataFrame([("a", "main", "task"), ("a", "other", "main")], CALLS)
    methods = spark.createDataFrame([("a", "main", "Main"), ("a", "task", "Task"), ("a", "run", "Task"), ("a", "other", "Main"), ("b", "run", "Task")], "app string, method string, cls string")
    inherits = spark.createDataFrame([("a", "Task", "Middle"), ("a", "Middle", "Thread"), ("b", "Task", "Thread"), ("a", "Main", None)], "app string, child string, parent string")
    roots = spark.createDataFrame([("a", "R", "main")], "app string, root string, method string")
    assert rows(flow.below(inherits, ["Thread"])) == [("a", "Middle"), ("a", "Task"), ("b", "Task")]
    assert rows(flow.reachable_with_async(roots, calls, methods, inherits, ["Thread"])) == [("a", "R", ["Main", "Task"], ["main", "run", "task"])]
    assert rows(flow.reachable_with_async(roots, calls, methods, inherits, ["Main"])) == [("a", "R", ["Main", "Task"], ["main", "task"])]


def test_usage_order_with_loops(spark):
    r = random.Random(7)
    flows = [(app, m, s, s + 1) for app in "ab" for m in "fg" for s in range(15)] + [("a", "f", 9, 4), ("b", "g", 6, 6), ("a", "g", 12, 2), ("a", "g", 3, 11), ("a", "g", None, 3)]
    uses = [(app, m, r.randrange(16), f"x{r.randrange(14)}") for app in "ab" for m in "fg" for _ in range(12)] + [("a", "f", 99, "far"), ("a", "f", 3, None)]
    uses += [("c", "h", i, f"y{i}") for i in range(90)]
    flows += [("c", "h", i, i + 1) for i in range(89)]
    every = closed([((a, m), s, t) for a, m, s, t in flows if s is not None])
    pairs = {(a, x, y) for a, m, s, x in uses for b, m2, t, y in uses if (a, m) == (b, m2) and None not in (x, y) and x != y and ((a, m), s, t) in every}
    want = {(a, x, y) for a, x, y in pairs if (a, y, x) not in pairs}
    u = spark.createDataFrame(uses + uses[:4], "app string, method string, stmt long, member string")
    f = spark.createDataFrame(flows + flows[:4], "app string, method string, stmt long, next long")
    assert rows(flow.usage_order_edges(u, f)) == sorted(want, key=str) and len(want) > 4000 and len(pairs) > len(want)
    assert flow.usage_order_edges(u, f.where("false")).count() == flow.usage_order_edges(u.where("false"), f).count() == 0


def test_def_use_with_loops(spark):
    r = random.Random(9)
    kind = {(m, v): r.choice(["local", "local", "field", "parameter", "return"]) for m in "fg" for v in range(20)}
    steps = [("a", m, r.randrange(20), r.randrange(20)) for m in "fg" for _ in range(26)]
    uses = [(a, m, f"v{d}", f"v{u}", kind[m, d], kind[m, u]) for a, m, d, u in steps]
    every = closed([((a, m), d, u) for a, m, d, u in steps])
    want = {(a, m, f"v{d}", f"v{u}", f"DU_{kind[m, d][0].upper()}_{kind[m, u][0].upper()}") for (a, m), d, u in every if "local" not in (kind[m, d], kind[m, u]) and not (kind[m, d] == "parameter" and kind[m, u] != "field")}
    df = spark.createDataFrame(uses + uses[:5] + [("a", "f", None, "v1", "local", "field")], "app string, method string, def string, use string, def_kind string, use_kind string")
    assert rows(flow.def_use_edges(df)) == sorted(want, key=str) and any(x[2] == x[3] for x in want)
    assert flow.def_use_edges(df.where("false")).count() == 0
