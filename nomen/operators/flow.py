"""What reaches what along steps: circles, sets of roots and of members as bitmaps that spread until nothing changes.

Nodes are numbered by a hash of a running number, so that their order is random.  A mark is a bit: marks with dense numbers
are kept 64 to a row (n, block, bits), and a round of a join and a bitwise or moves those that the last round made new.
No list of all pairs is stored on the way; the number of rounds is that of the steps on the longest of the shortest ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomen.operators._lineage import Log, cut
from nomen.operators.kg import dense_ids


def numbered(names: DataFrame) -> DataFrame:
    """Distinct rows with a number ``n`` each, written down; rows with a null are dropped."""
    return cut(names.dropna().distinct().withColumn("n", F.xxhash64(F.monotonically_increasing_id())))


def steps_between(pairs: DataFrame, nodes: DataFrame, keys: list[str], name: str, source: str, target: str) -> DataFrame:
    """(s, t), distinct: ``pairs(keys, source, target)`` by the numbers of ``nodes(keys, name, n)``."""
    side = lambda column, out: nodes.select(*keys, F.col(name).alias(column), F.col("n").alias(out))
    both = pairs.select(*keys, source, target).distinct().join(side(source, "s"), [*keys, source]).join(side(target, "t"), [*keys, target])
    return cut(both.select("s", "t"))


def marks_of(rows: DataFrame) -> DataFrame:
    """(n, block, bits) of ``rows(n, number)``."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("number").bitwiseAND(63).cast("int"))
    return rows.groupBy("n", F.shiftright("number", 6).alias("block")).agg(F.bit_or(bit).alias("bits"))


def numbers_in(marks: DataFrame) -> DataFrame:
    """``marks(..., block, bits)`` with a row per bit and its ``number`` in place of both."""
    others = [c for c in marks.columns if c not in ("block", "bits")]
    places = marks.select(*others, "block", F.explode(F.expr("filter(sequence(0, 63), i -> (shiftright(bits, i) & 1) = 1)")).alias("bit"))
    return places.select(*others, (F.col("block") * 64 + F.col("bit")).alias("number"))


def arriving(steps: DataFrame, marks: DataFrame) -> DataFrame:
    """(n, block, bits): the ``marks(n, block, bits)`` that come to each node over one of ``steps(s, t)`` or more.

    A node's own marks come back to it only on a circle.  Several rows of a node and block hold different bits.
    """

    def moved(from_: DataFrame) -> DataFrame:
        went = from_.withColumnRenamed("n", "s").join(steps, "s")
        return went.groupBy(F.col("t").alias("n"), "block").agg(F.bit_or("bits").alias("bits"))

    seen = Log(moved(marks))
    new = seen.read()
    while not new.isEmpty():
        known = seen.read().groupBy("n", "block").agg(F.bit_or("bits").alias("old"))
        left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        new = seen.add(moved(new).join(known, ["n", "block"], "left").select("n", "block", left.alias("bits")).where("bits <> 0"))
    return seen.read()


def strong_components(steps: DataFrame) -> DataFrame:
    """(n, circle): nodes of ``steps(s, t)`` that reach one another have the same circle, a node of theirs.

    Nodes that are missing, or the only ones of their circle, lie on none.  Ends without a way on or back are trimmed.  Then
    each node learns the greatest number that reaches it and the greatest that it reaches: where both are the same, the node
    lies on that number's circle, and steps between nodes that differ in either lie on none.  With random numbers a chain
    of n circles takes about log n such phases.
    """
    left = cut(steps.select("s", "t").where("s <> t").distinct())
    found = Log(left.select(F.col("s").alias("n"), F.col("t").alias("circle")).where("false"))
    while not (left := _trimmed(left)).isEmpty():
        greatest = _greatest(left)
        found.add(greatest.where("above = below").select("n", F.col("above").alias("circle")))
        open_ = greatest.where("above <> below")
        side = lambda end: open_.select(F.col("n").alias(end), "above", "below")
        left = cut(left.join(side("s"), "s").join(side("t"), ["t", "above", "below"]).select("s", "t"))
    return found.read()


def _trimmed(steps: DataFrame) -> DataFrame:
    """Steps from a node with a way in to one with a way out, as long as a round drops a tenth of them."""
    size = steps.count()
    while size:
        into, out_of = steps.select(F.col("t").alias("s")).distinct(), steps.select(F.col("s").alias("t")).distinct()
        steps = cut(steps.join(into, "s", "left_semi").join(out_of, "t", "left_semi").select("s", "t"))
        left = steps.count()
        if 10 * left > 9 * size:
            break
        size = left
    return steps


def _greatest(steps: DataFrame) -> DataFrame:
    """(n, above, below): the greatest numbers that reach a node and that it reaches, its own included."""
    both = cut(steps.select(F.col("s").alias("n"), F.col("t").alias("to"), F.lit(True).alias("down")).union(steps.select("t", "s", F.lit(False))))
    n = F.col("n")
    state = cut(both.select("n").distinct().select("n", n.alias("above"), n.alias("below"), F.lit(True).alias("down"), F.lit(True).alias("up")))
    while not (moved := state.where("down OR up")).isEmpty():
        news = moved.select("n", F.explode(F.array(F.struct(F.lit(True).alias("down"), F.when(F.col("down"), F.col("above")).alias("top")), F.struct(F.lit(False).alias("down"), F.when(F.col("up"), F.col("below")).alias("top")))).alias("x"))
        pushed = news.select("n", "x.*").where("top IS NOT NULL").join(both, ["n", "down"])
        come = pushed.groupBy(F.col("to").alias("n")).agg(F.max(F.when(F.col("down"), F.col("top"))).alias("a"), F.max(F.when(~F.col("down"), F.col("top"))).alias("b"))
        more = lambda new, old: F.coalesce(F.col(new) > F.col(old), F.lit(False))
        state = cut(state.join(come, "n", "left").select("n", F.greatest("above", "a").alias("above"), F.greatest("below", "b").alias("below"), more("a", "above").alias("down"), more("b", "below").alias("up")))
    return state.select("n", "above", "below")


def call_circles(calls: DataFrame) -> DataFrame:
    """(app, method, circle): methods of ``calls(app, caller, callee)`` that call one another through others; a circle is
    named by its least method.  A method that only calls itself is in none; calls with a null are dropped."""
    nodes = numbered(calls.select("app", F.col("caller").alias("method")).union(calls.select("app", "callee")))
    found = cut(strong_components(steps_between(calls, nodes, ["app"], "method", "caller", "callee")).join(nodes, "n"))
    least = found.groupBy("circle").agg(F.min("method").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return found.join(least, "circle").select("app", "method", F.col("least").alias("circle"))


def reach_sets(roots: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members(app, method, n), sets(n, block, bits) and numbers(app, root, number) of ``roots(app, root, method)`` and
    ``calls(app, caller, callee)``: a method has the set of its ``n``, whose bits are the roots that reach it.

    Methods of a circle share one set, and what is written is a row per set and 64 roots, not one per root and method.
    """
    roots, calls = roots.select("app", "root", "method").dropna().distinct(), calls.select("app", "caller", "callee").dropna()
    nodes = numbered(roots.select("app", "method").union(calls.select("app", "caller")).union(calls.select("app", "callee")))
    steps = steps_between(calls, nodes, ["app"], "method", "caller", "callee")
    circles = cut(strong_components(steps))
    side = lambda end: circles.select(F.col("n").alias(end), F.col("circle").alias(f"{end}_circle"))
    merged = steps.join(side("s"), "s", "left").join(side("t"), "t", "left").select(F.coalesce("s_circle", "s").alias("s"), F.coalesce("t_circle", "t").alias("t"))
    members = cut(nodes.join(circles, "n", "left").select("app", "method", F.coalesce("circle", "n").alias("n")))
    numbers = cut(dense_ids(roots.select("app", "root").distinct(), ["app", "root"], out="number"))
    starts = cut(marks_of(roots.join(members, ["app", "method"]).join(numbers, ["app", "root"]).select("n", "number")))
    came = arriving(cut(merged.where("s <> t").distinct()), starts)
    return members, cut(came.unionByName(starts).groupBy("n", "block").agg(F.bit_or("bits").alias("bits"))), numbers


def reach_from(roots: DataFrame, calls: DataFrame) -> DataFrame:
    """(app, root, method): methods reachable from ``roots(app, root, method)`` over ``calls(app, caller, callee)``, a root's
    own included; rows with a null are dropped."""
    members, sets, numbers = reach_sets(roots, calls)
    return numbers_in(sets).join(numbers.select("root", "number"), "number").join(members, "n").select("app", "root", "method")


def reachable_with_async(roots: DataFrame, calls: DataFrame, methods: DataFrame, inherits: DataFrame, async_bases: list[str]) -> DataFrame:
    """(app, root, classes, methods): what a root reaches, with all methods of reached classes that extend an asynchronous base.

    ``methods(app, method, cls)``; ``inherits(app, child, parent)``.
    """
    members, sets, numbers = reach_sets(roots, calls)
    reached = cut(numbers_in(sets).join(numbers.select("root", "number"), "number").select("n", "root"))
    placed = cut(members.join(methods.select("app", "method", "cls"), ["app", "method"]))
    deferred = placed.select("app", "n", "cls").distinct().join(below(inherits, async_bases), ["app", "cls"], "left_semi")
    more = reached.join(deferred, "n").select("app", "root", "cls").distinct().join(methods, ["app", "cls"])
    both = reached.join(placed, "n").select("app", "root", "cls", "method").unionByName(more.select("app", "root", "cls", "method")).distinct()
    return both.groupBy("app", "root").agg(F.array_sort(F.collect_set("cls")).alias("classes"), F.array_sort(F.collect_set("method")).alias("methods"))


def below(inherits: DataFrame, bases: list[str]) -> DataFrame:
    """(app, cls): classes of ``inherits(app, child, parent)`` that extend one of ``bases``, at any distance."""
    nodes = numbered(inherits.select("app", F.col("child").alias("cls")).union(inherits.select("app", "parent")))
    down = steps_between(inherits, nodes, ["app"], "cls", "parent", "child")
    marks = nodes.where(F.col("cls").isin(bases)).select("n", F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("bits"))
    return arriving(down, marks).select("n").distinct().join(nodes, "n").select("app", "cls")


def def_use_edges(uses: DataFrame) -> DataFrame:
    """(app, method, source, target, kind): flow between fields, parameters and results of a method.

    ``uses(app, method, def, use, def_kind, use_kind)``: local def-use steps; kinds: local, field, return, parameter.  What is no
    local is a mark that spreads along the steps; edges go to ends that are no locals.  Rows with a null are dropped.
    """
    uses = uses.select("app", "method", "def", "use", "def_kind", "use_kind").dropna()
    kinds = cut(uses.select("app", "method", F.col("def").alias("x"), F.col("def_kind").alias("kind")).union(uses.select("app", "method", "use", "use_kind")).distinct())
    nodes = numbered(kinds.select("app", "method", "x"))
    ends = cut(kinds.where("kind <> 'local'").join(nodes, ["app", "method", "x"]))
    numbers = cut(dense_ids(ends.select("app", "method", "x", "n").distinct(), ["app", "method", "x"], out="number"))
    came = arriving(steps_between(uses, nodes, ["app", "method"], "x", "def", "use"), cut(marks_of(numbers)))
    to = ends.select("n", F.col("x").alias("target"), F.col("kind").alias("to_kind"))
    from_ = ends.join(numbers.select("n", "number"), "n").select("app", "method", "number", F.col("x").alias("source"), F.col("kind").alias("from_kind"))
    pairs = numbers_in(came.join(to, "n")).join(from_, "number").where("NOT (from_kind = 'parameter' AND to_kind <> 'field')")
    letter = lambda c: F.upper(F.substring(c, 1, 1))
    return pairs.select("app", "method", "source", "target", F.concat(F.lit("DU_"), letter("from_kind"), F.lit("_"), letter("to_kind")).alias("kind")).distinct()


def usage_order_edges(uses: DataFrame, flow: DataFrame) -> DataFrame:
    """(app, earlier, later): members used before others on some path; ``uses(app, method, stmt, member)``, ``flow(app, method, stmt, next)``.

    A statement adds its members to the bitmap that came to it over the flow; loops bring it round again until nothing is new.
    Pairs that occur in both orders cancel.  Rows with a null are dropped.
    """
    uses = uses.select("app", "method", "stmt", "member").dropna().distinct()
    nodes = numbered(flow.select("app", "method", "stmt").union(flow.select("app", "method", "next")))
    numbers = cut(dense_ids(uses.select("app", "method", "member").distinct(), ["app", "method", "member"], out="number"))
    placed = cut(uses.join(nodes, ["app", "method", "stmt"]).join(numbers, ["app", "method", "member"]).select("app", "member", "n", "number"))
    came = arriving(steps_between(flow, nodes, ["app", "method"], "stmt", "stmt", "next"), cut(marks_of(placed)))
    before = came.join(placed.select("app", F.col("member").alias("later"), "n"), "n").groupBy("app", "later", "block").agg(F.bit_or("bits").alias("bits"))
    named = numbers_in(before).join(numbers.select("number", F.col("member").alias("earlier")), "number")
    pairs = cut(named.where("earlier <> later").select("app", "earlier", "later").distinct())
    return pairs.join(pairs.select("app", F.col("later").alias("earlier"), F.col("earlier").alias("later")), ["app", "earlier", "later"], "left_anti")
