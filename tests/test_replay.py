"""Strict replay of logs against a plain loop, and the bound on name ratios."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from nomen.functions import similarity
from nomen.operators import replay

LOG = "app string, line long, event string, pass string, at double, block int, state string"
EVENTS = ["pass", "train_start", "train_end", "predict_start", "predict_stop", "noise", None]


def plain(log):
    """Accepted spans by (app, pass) of the last run of a pass, and the events left out."""
    passes, bad, state, since, name = {}, [], 3, None, None
    for line, event, named, at in log:
        if state == 1 and event == "train_start":
            since, state = at, 2
        elif state == 2 and event == "train_end":
            passes.setdefault(name, [None, []])[0] = at - since
            state = 3
        elif state == 3 and event == "predict_start":
            since, state = at, 4
            passes.setdefault(name, [None, []])
        elif state == 3 and event == "pass":
            name, state = named, 1
            passes[name] = [None, []]
        elif state == 4 and event == "predict_stop":
            passes.setdefault(name, [None, []])[1].append(at - since)
            state = 3
        else:
            bad.append((line, event, state))
            passes.setdefault(name, [None, []])
    return passes, bad


def test_strict_replay_equals_a_loop(spark):
    r = random.Random(3)
    logs = {}
    for k in range(40):
        ordered = ["pass", "train_start", "train_end", *["predict_start", "predict_stop"] * 3]
        events = [r.choice(EVENTS) if r.random() < r.choice([0.1, 0.9]) else ordered[i % len(ordered)] for i in range(r.randrange(1, 70))]
        logs[f"l{k}"] = [(i, e, str(r.randrange(3)) if e == "pass" else None, float(i * i % 97)) for i, e in enumerate(events)]
    rows = [(app, *row, 1, "s") for app, log in logs.items() for row in log]
    r.shuffle(rows)
    lines = spark.createDataFrame([*rows, (None, 1, "pass", "1", 1.0, 1, "s"), ("l0", None, "pass", "1", 1.0, 1, "s")], LOG).repartition(5)
    want, bad = set(), set()
    for app, log in logs.items():
        passes, wrong = plain(log)
        bad |= {(app, *x) for x in wrong}
        for name, (train, spans) in passes.items():
            want.add((app, name, train, len(spans), sum(spans) if spans else None, max(spans, default=None)))
    for size in (1, 7, 1 << 16):  # blocks of a line, of some lines, of whole logs
        got = replay.strict_replay(lines, size).select("app", "pass", "train_seconds", "predict_count", "predict_total", "predict_max")
        assert {tuple(x) for x in got.collect()} == want
        assert {tuple(x) for x in replay.ill_formed(lines, size).collect()} == bad
    assert replay.strict_replay(lines.where("false")).count() == 0


def test_ratio_bound_spares_python(spark):
    r = random.Random(4)
    words = ["", "a", "get", "getName", "setName", "éa", "😀x", "nameGet", "x" * 300, "onCreate", "oncreate", "a+b$"]
    words += ["".join(r.choice("abcAé") for _ in range(r.randrange(12))) for _ in range(60)]
    pairs = spark.createDataFrame([(a, b) for a in words for b in r.sample(words, 20)] + [(None, "a"), ("a", None), (None, None)], "a string, b string")
    bounded = pairs.distinct().select("a", "b", similarity.ratio_bound("a", "b").alias("bound")).collect()
    for a, b, bound in bounded:
        if a is None or b is None:
            assert bound is None
        else:
            assert bound >= SequenceMatcher(a=a, b=b).ratio() - 1e-12
    full = similarity.with_ratio(pairs, "a", "b").where(F.col("ratio") >= similarity.SIMILAR)
    spared = similarity.with_similar_ratio(pairs, "a", "b")
    assert spared.count() == pairs.count()
    assert sorted(map(tuple, spared.where(F.col("ratio") >= similarity.SIMILAR).collect())) == sorted(map(tuple, full.collect()))
