"""Names that spread from recovered methods to what they relate to, with a growing frontier of match sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomen.functions import columns as C
from nomen.operators._lineage import Log, cut

KINDS = ("para", "ret", "refer")
_SET = ["app", "turn", "ord"]
LARGE = 100_000  #: rows of relations from which on no join broadcasts
Side = Callable[[DataFrame], DataFrame]


def _side(rows: int) -> Side:
    """What is done to the right side of every join.  A broadcast takes 64 MB of the driver at least, and what is written is small for its rows, as names
    repeat: on large tables a round's broadcasts, of which many run at once, would fill the driver.  Small ones keep them, as rounds are many."""
    return (lambda df: df.hint("merge")) if rows >= LARGE else (lambda df: df)


def _kind(column: str) -> F.Column:
    return F.coalesce(*[F.when(F.col(column).startswith(k), F.lit(i)) for i, k in enumerate(KINDS)])


def _name(column: str) -> F.Column:
    return F.regexp_extract(column, "^[^:]*:?(.*)$", 1)


def _rank(*parts: F.Column) -> F.Column:
    return F.struct(*[p.cast("long").alias(f"r{i}") for i, p in enumerate(parts)])


def _proposals(rel: DataFrame, near: DataFrame, live: DataFrame, side: Side) -> DataFrame:
    """(app, node, r, rank): what the changed sets say of their neighbours, the best of each node."""
    # a kind with one relation and one neighbour
    one = lambda df, c: df.join(side(live), _SET, "left_semi").where("kind IS NOT NULL").groupBy(*_SET, "kind").agg(F.count(F.lit(1)).alias("n"), F.min(c).alias(c)).where("n = 1").drop("n")
    single = one(rel, "r").join(side(one(near, "node")), [*_SET, "kind"])
    single = single.select("app", "node", "r", _rank(F.lit(0), F.col("turn"), F.col("ord"), F.col("kind"), F.col("node")).alias("rank"))
    # a neighbour whose sets have one relation in common: only neighbours of changed sets are looked at, in all their sets
    asked = near.join(side(live), _SET, "left_semi").select("app", "node").distinct()
    member = near.join(side(asked), ["app", "node"], "left_semi").select(*_SET, "node")
    size = member.groupBy("app", "node").agg(F.count(F.lit(1)).alias("sets"))
    common = member.join(side(rel.select(*_SET, "r")), _SET).groupBy("app", "node", "r").agg(F.count(F.lit(1)).alias("sets"))
    shared = common.join(side(size), ["app", "node", "sets"]).groupBy("app", "node").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r")).where("n = 1")
    zero = F.lit(0)
    shared = shared.select("app", "node", "r", _rank(zero + 1, zero, zero, zero, F.col("node")).alias("rank"))
    best = single.unionByName(shared).groupBy("app", "node").agg(F.min(F.struct("rank", "r")).alias("p"))
    return best.select("app", "node", "p.r", "p.rank")


def _own_sets(goes: DataFrame, resolved: DataFrame, methods: DataFrame, near: DataFrame, stored: DataFrame, turn: int, side: Side) -> tuple[DataFrame, DataFrame]:
    """The match sets that newly named methods have themselves: (app, turn, ord, r) and (app, turn, ord, node, relation)."""
    ident = F.concat("owner", F.lit("."), "name")
    named = goes.join(side(methods), ["app", "node"]).withColumn("id", ident).where(~C.is_method_minified("id"))
    profile = stored.groupBy("id", "sig").agg(F.min("relations").alias("relations"))
    known = cut(named.join(side(profile), ["id", "sig"]).select("app", "node", "relations"))
    expected = known.select("app", "node", F.explode("relations").alias("r")).where("NOT endswith(r, 'init>')").distinct()
    around = near.join(side(known.select("app", "node")), ["app", "node"], "left_semi").groupBy("app", "node", "neighbour").agg(F.max("relation").alias("relation"))
    now = resolved.select("app", F.col("node").alias("neighbour"), F.col("name").alias("now"))
    renamed = F.when(F.col("now").isNull(), F.col("relation")).otherwise(F.concat(F.substring_index("relation", ":", 1), F.lit(":"), "now"))
    around = around.join(side(now), ["app", "neighbour"], "left").select("app", "node", "neighbour", renamed.alias("r"), F.col("now").isNotNull().alias("done"))
    around = cut(around.where("NOT endswith(r, 'init>')"))
    # an expected relation that a neighbour has already is taken by it (the least of several), and both go
    taken = around.join(side(expected), ["app", "node", "r"]).groupBy("app", "node", "r").agg(F.min("neighbour").alias("neighbour"))
    left = expected.join(side(taken), ["app", "node", "r"], "left_anti")
    open_ = around.where("NOT done").join(side(taken), ["app", "node", "neighbour"], "left_anti")
    both = cut(left.select("app", "node").distinct().join(side(open_.select("app", "node")), ["app", "node"], "left_semi"))
    place = [F.col("app"), F.lit(turn).cast("long").alias("turn"), F.col("node").cast("long").alias("ord")]
    rel = left.join(side(both), ["app", "node"], "left_semi").select(*place, "r")
    return rel, open_.join(side(both), ["app", "node"], "left_semi").select(*place, F.col("neighbour").alias("node"), F.col("r").alias("relation"))


def propagate_relations(sets: DataFrame, methods: DataFrame | None = None, near: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """(app, node, name): names of unresolved neighbours, by rounds of joins until nothing changes.

    ``sets(app, ord, relations: array<string>, neighbours: array<struct<node, relation>>)``: what a recovered method is
    expected to relate to (``para:``, ``ret:``, ``refer:`` and a name), and its unresolved neighbours.  A kind with one
    relation and one neighbour resolves both; otherwise a neighbour whose sets share one relation.  In a round all changed
    sets are judged as it finds them.  Of proposals that take the same relation from one set, the first goes (by the two
    rules, then set, kind and node); what is resolved leaves all sets.  The first proposal of all always goes, so that this ends.

    With the other three tables the frontier grows: a method that was given a name, with its class's name before it, gets a set of its own
    from the stored profile with that name and its signature.  ``methods(app, node, sig, owner)``: signatures, and names of
    classes; ``near(app, node, neighbour, relation)``: relations with the neighbours' present names; ``stored(id, sig,
    relations)``.  Constructors (``init>`` at the end), relations that a neighbour has already, and resolved neighbours are not
    part of it; minified names get none.  Of several stored rows with one name and signature the least list counts.

    A round reads the sets that the last one changed, and the other sets of their neighbours; it adds to what is
    written and rewrites nothing.  Null relations and neighbours are ignored.
    """
    rel = sets.select("app", F.lit(0).cast("long").alias("turn"), F.col("ord").cast("long").alias("ord"), F.explode("relations").alias("r"))
    rel = Log(rel.where("r IS NOT NULL").distinct().withColumn("kind", _kind("r")))
    flat = sets.select("app", F.lit(0).cast("long").alias("turn"), F.col("ord").cast("long").alias("ord"), F.explode("neighbours").alias("x"))
    flat = flat.select(*_SET, F.col("x.node").cast("long").alias("node"), "x.relation").where("node IS NOT NULL")
    one_kind = lambda df: df.groupBy(*_SET, "node").agg(F.max("relation").alias("k")).select(*_SET, "node", _kind("k").alias("kind"))
    around = Log(one_kind(flat))
    nothing = rel.read().where("false")
    lost_rel, named = Log(nothing.select(*_SET, "r")), Log(nothing.select("app", F.col("ord").alias("node"), F.col("r").alias("name")))
    live = cut(rel.read().select(*_SET).union(around.read().select(*_SET)).distinct())
    side = _side(rel.read().count() + around.read().count() + (near.count() if near is not None else 0))
    turn = 0
    while not live.isEmpty():
        turn += 1
        left_rel = rel.read().join(side(lost_rel.read()), [*_SET, "r"], "left_anti")
        left_near = around.read().join(side(named.read().select("app", "node")), ["app", "node"], "left_anti")
        asked = _proposals(left_rel, left_near, live, side)
        touched = cut(asked.join(side(left_near.select(*_SET, "node")), ["app", "node"]))
        if touched.isEmpty():
            break
        first = touched.groupBy(*_SET, "r").agg(F.min("rank").alias("first"))
        beaten = touched.join(side(first), [*_SET, "r"]).where("rank <> first").select("app", "node").distinct()
        goes = cut(touched.join(side(beaten), ["app", "node"], "left_anti"))
        new = goes.select("app", "node", _name("r").alias("name")).distinct()
        named.add(new)
        lost_rel.add(goes.select(*_SET, "r").distinct())
        live = touched.select(*_SET)
        if methods is not None and near is not None and stored is not None:
            more_rel, more_near = _own_sets(new, named.read(), methods, near, stored, turn, side)
            more_rel = cut(more_rel)
            rel.add(more_rel.withColumn("kind", _kind("r")))
            around.add(one_kind(more_near))
            live = live.union(more_rel.select(*_SET))
        live = cut(live.distinct())
    return named.read()
