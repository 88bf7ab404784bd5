"""Strict replay of test logs: a state machine whose steps compose, so that a log of any length is folded in parts.

States: 1 a pass was announced, 2 it trains, 3 it may predict or end, 4 it predicts.  An event that its state does not
expect changes nothing and is reported.  What a block of lines does to a log is a table of four rows (one for each state that it may
start in); such tables compose, so only they are chained over the blocks of a log, never its lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomen.functions import columns as C
from nomen.operators._lineage import cut

#: (state, event) to the next state
MOVES = {(1, "train_start"): 2, (2, "train_end"): 3, (3, "predict_start"): 4, (3, "pass"): 1, (4, "predict_stop"): 3}
START = 3
BLOCK_LINES = 1 << 16
_STEPS = "app string, line long, event string, pass string, pass_line long, state int, accepted boolean, seconds double"


def step(held: tuple, line: int, event: str | None, named: str | None, at: float | None) -> tuple[tuple, bool, float | None]:
    """What holds after a line, whether its event was expected, and the seconds that it ends.

    What holds is (state, since when, pass, the pass's line).
    """
    state, since, name, name_line = held
    after = MOVES.get((state, event))
    if after is None:
        return held, False, None
    seconds = None
    if event == "pass":
        name, name_line = named, line
    elif after in (2, 4):
        since = at
    elif since is not None and at is not None:
        seconds = at - since
    return (after, since, name, name_line), True, seconds


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[Iterator[tuple]]:
    """Each batch's rows as tuples, with None for what is missing."""
    for batch in batches:
        yield batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    columns = [c.split(" ") for c in schema.split(", ")]
    frame = pd.DataFrame(rows, columns=[c for c, _ in columns], dtype=object)
    return frame.astype({c: {"long": "Int64", "int": "Int32", "double": "float64"}[t] for c, t in columns if t in ("long", "int", "double")})


_TABLE = "app string, block long, state int, after int, since double, kept boolean, pass string, pass_line long"
_BEFORE = "app string, block long, state int, since double, pass string, pass_line long"
_UNSET = float("nan")  # a mark for "as it was before the block"


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The table of each block; the lines of a block follow one another, over as many batches as they take."""
    block, held = None, []

    def table() -> list[tuple]:
        return [(*block, i + 1, end, None if since is _UNSET else since, since is _UNSET, name, at) for i, (end, since, name, at) in enumerate(held)]

    for rows in _rows(batches):
        out = []
        for app, of, line, event, named, at in rows:
            if (app, of) != block:
                out += table() if block else []
                block, held = (app, of), [(state, _UNSET, None, None) for state in (1, 2, 3, 4)]
            held = [step(h, line, event, named, at)[0] for h in held]
        yield _frame(out, _TABLE)
    if block:
        yield _frame(table(), _TABLE)


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What holds before the first line of each block; the blocks of a log follow one another, in order."""
    log, block, held, before = None, None, None, None
    for rows in _rows(batches):
        out = []
        for app, of, state, after, since, kept, name, name_line in rows:
            if app != log:
                log, block, held = app, None, (START, None, None, None)
            if of != block:
                block, before = of, held
                out.append((app, of, *before))
            if state == before[0]:
                held = (after, before[1] if kept else since, *((name, name_line) if name_line is not None else before[2:]))
        yield _frame(out, _BEFORE)


def _replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The steps of the lines, whose first columns are what holds before their block."""
    block, held = None, None
    for rows in _rows(batches):
        out = []
        for app, of, line, event, named, at, *start in rows:
            if (app, of) != block:
                block, held = (app, of), tuple(start)
            state = held[0]
            held, accepted, seconds = step(held, line, event, named, at)
            out.append((app, line, event, held[2], held[3], state, accepted, seconds))
        yield _frame(out, _STEPS)


def replay_steps(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(app, line, event, pass, pass_line, state, accepted, seconds) for each row of ``lines(app, line, event, pass, at)``.

    ``pass`` and ``pass_line`` are the pass that the event belongs to (null before the first); ``state`` is the one in which it
    was read; ``seconds`` is how long a training or prediction took that it ends (null where a time is missing).  Rows with a
    null app or line are dropped, other events than the five count as not accepted, rows of one line go by event and time, and
    further columns are ignored.  Blocks are dealt to tasks, sorted and read as a stream: a task holds one state, no block and no log.
    """
    lines = lines.selectExpr("cast(app AS string) AS app", "cast(line AS long) AS line", "event", "cast(pass AS string) AS pass", "cast(at AS double) AS at")
    lines = lines.where("app IS NOT NULL AND line IS NOT NULL").withColumn("block", F.floor(F.col("line") / block_lines).cast("long"))
    lines = lines.select("app", "block", "line", "event", "pass", F.when(~F.isnan("at"), F.col("at")).alias("at"))
    order = ["app", "block", "line", *[F.col(c).asc_nulls_last() for c in ("event", "at", "pass")]]
    tables = lines.repartition("app", "block").sortWithinPartitions(*order).mapInPandas(_summaries, _TABLE)
    before = tables.repartition("app").sortWithinPartitions("app", "block", "state").mapInPandas(_chained, _BEFORE)
    before = cut(before).select("app", "block", *[F.col(c).alias(f"_{c}") for c in ("state", "since", "pass", "pass_line")])
    started = lines.join(before, ["app", "block"]).select(*lines.columns, "_state", "_since", "_pass", "_pass_line")
    return started.repartition("app", "block").sortWithinPartitions(*order).mapInPandas(_replayed, _STEPS)


def strict_replay(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(app, pass, train_seconds, predict_count, predict_total, predict_max, predict_mean, ignored) of test logs.

    A pass that is announced again starts anew: its last run counts.  Events before the first pass stand under a null pass.
    ``ignored`` counts the events of that run that came in a state which does not expect them; the mean of no prediction is 1.
    """
    all_steps = replay_steps(lines, block_lines)
    ends = F.when(F.col("accepted") & (F.col("event") == "train_end"), F.col("seconds"))
    predicted = F.when(F.col("accepted") & (F.col("event") == "predict_stop"), F.col("seconds"))
    runs = all_steps.groupBy("app", "pass", "pass_line").agg(
        F.max(ends).alias("train_seconds"),
        F.count(predicted).alias("predict_count"),
        F.sum(predicted).alias("predict_total"),
        F.max(predicted).alias("predict_max"),
        F.count_if(~F.col("accepted")).alias("ignored"),
    )
    values = ["train_seconds", "predict_count", "predict_total", "predict_max", "ignored"]
    last = runs.groupBy("app", "pass").agg(F.max_by(F.struct(*values), F.coalesce("pass_line", F.lit(-(2**62)))).alias("last"))
    out = last.select("app", "pass", *[F.col(f"last.{c}").alias(c) for c in values])
    return out.withColumn("predict_mean", C.safe_divide("predict_total", "predict_count"))


def ill_formed(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(app, line, event, state): the events that their state does not expect."""
    return replay_steps(lines, block_lines).where("NOT accepted").select("app", "line", "event", "state")
