"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from nomen.llm import _components, _words, decontaminate, license_scan, masked_lm, packing, pii, quality, queries, repeats, simhash, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


def clashing(df):
    """With columns named like what the operators return or use inside."""
    extra = ["id", "fp", "key", "part", "score", "spans", "kept", "ids", "bucket", "n_words", "component", "_id", "_stay"]
    return df.select("*", *[F.lit(1).alias(c) for c in extra])


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"


def babble(r, n, words="the of Ünder straße data set RUN of-x éa 42 9a"):
    return " ".join(r.choice(words.split()) for _ in range(n))


ODD = [None, "", "   \t\n", "x", "É", "\x0b\x0c", "a" * 30_000, "1" * 20_000, "+1" + " " * 5000, "@" * 3000, "1." * 3000, "日本語 テキスト", "😀 word 😀"]


# -- words


def test_word_tables_equal_patterns():
    r = random.Random(0)
    texts = [babble(r, r.randrange(80)) + r.choice(["", "\n", "!", "\t", "é"]) for _ in range(200)] + ODD
    column = pa.array(texts, pa.string())
    for classes, low, pattern in ((_words.ALPHANUMERIC, True, WORD), (_words.SPACE_SEPARATED, False, SPACED)):
        found, seen = [], {}
        for a, b, t in _words.tables(column, classes, low, 500):
            for k in range(b - a):
                words = [t.data[s:e].tobytes().decode() for s, e in zip(t.start[t.first[k] : t.first[k + 1]], t.end[t.first[k] : t.first[k + 1]])]
                found.append(words)
                for w, h in zip(words, t.hash[t.first[k] : t.first[k + 1]].tolist()):
                    assert seen.setdefault(w, h) == h
        assert found == [re.findall(pattern, lower(x) if low else x or "") for x in texts]
        assert len(set(seen.values())) == len(seen)


def test_sliced_columns():
    column = pa.array(["a b", None, "c d e", ""]).slice(1, 2)
    (got,) = list(_words.tables(column, _words.SPACE_SEPARATED, False))
    assert got[2].counts.tolist() == [0, 3]


# -- 1 personal data


def test_pii_base_spans_equal_patterns():
    r = random.Random(1)
    alphabet = ["a.b+c@d-e.co.uk", "@", "x@y", "a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "00012.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "+49", "12", " ", ".", "-", "é", "\n", "x"]
    for _ in range(400):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(25)))
        spans = pii.base_spans(text)
        joined = pii.joined([(k, a, b) for k in pii.BASE_KINDS for a, b in spans[k]])
        assert hashlib.sha256(joined.encode()).hexdigest() == pii.reference_digest(text), text
    for text in ODD:
        pii.candidates(text or "")


def test_pii_query_on_documents(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op1_pii(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d["doc_id"]]
        assert r["base_sha256"] == pii.reference_digest(d["text"])
        base = pii.base_spans(d["text"] or "")
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [len(base[k]) for k in pii.BASE_KINDS]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(pii.joined([(k, a, b) for k in base for a, b in base[k]]).split(",")) - {""} <= set(spans)
    secrets = [d["doc_id"] for d in docs if "password=" in (d["text"] or "")]
    assert all("secret:" in got[i]["spans"] for i in secrets)


def test_pii_edges(spark):
    docs = clashing(frame(spark, [*ODD, "mail me at a.b@c.de now", "mail me at a.b@c.de now", "password=hunter22x9 ok"]))
    model = pii.train(docs)
    got = pii.span_digests(docs, model)
    assert got.count() == len(ODD) + 3
    clean = pii.redact(docs, model)
    assert clean.columns == docs.columns and clean.where("text IS NULL").count() == 1
    assert clean.where("text = 'mail me at [EMAIL] now'").count() == 2
    empty = docs.where("false")
    assert pii.span_digests(empty, pii.train(empty)).count() == 0
    assert pii.fit({}).score("email|p000|0ss") == 0.5


# -- 2 near duplicates


def reference_components(texts, ids, bits=3):
    fps = []
    for t in texts:
        w = re.findall(SPACED, lower(t))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= bits and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    best = {}
    for i, g in enumerate(group):
        best[g] = min(best.get(g, ids[i]), ids[i])
    return [(i, f"{f:016x}", best[g]) for i, f, g in zip(ids, fps, group)]


def test_golay_keys_meet():
    code, r = simhash.Golay(), np.random.default_rng(2)
    assert np.bincount(code.index).min() == np.bincount(code.index).max() == 2048  # a perfect code
    for size in (21, 22):
        for _ in range(200):
            a = int(r.integers(1 << size))
            b = a ^ (1 << int(r.integers(size)))
            assert int(code.index[b]) in code.nearby(a, size) and int(code.index[a]) in code.nearby(b, size)


def test_simhash_search_loses_no_link(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 40, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(k) for k in r.choice(63, r.integers(1, 4), replace=False)) for b in base for _ in range(8)]
    fps = sorted({*map(int, base), *near})
    df = spark.createDataFrame([(f, None) for f in fps], "fp long, part long")
    stored = simhash.keys(df, False).select("key", F.col("fp").alias("a"))
    met = {(x["a"], x["fp"]) for x in stored.join(simhash.keys(df, True), "key").select("a", "fp").distinct().collect()}
    u = np.array(fps, np.int64).view(np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3)):
        assert (fps[i], fps[j]) in met


def test_simhash_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert rows(queries.op2_simhash(spark, sf_dir)) == sorted(reference_components([d["text"] for d in docs], [d["doc_id"] for d in docs]), key=str)


def test_simhash_edges(spark):
    r = random.Random(3)
    base = babble(r, 200)
    near = [base + f" tail{i}" for i in range(25)]
    texts = [*ODD, base, base, *near]
    docs = clashing(frame(spark, texts))
    got = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert rows(got) == sorted(reference_components(texts, list(range(len(texts)))), key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} == {c for _, _, c in reference_components(texts, list(range(len(texts))))}
    nulls = frame(spark, ["a b c d", "a b c d", "q w e"], [None, 4, None])
    assert rows(simhash.near_duplicates(nulls).select("doc_id", "component_id")) == [(4, 4), (None, 4), (None, None)]
    assert rows(simhash.keep_one(nulls).select("doc_id", "text")) == [(4, "a b c d"), (None, "q w e")]
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, bits=4)


def test_keep_one_with_repeated_ids(spark):
    one, two = "p q r s t u v w", "k l m n o a b c"
    docs = frame(spark, [one, one, two, two, one], [1, 1, 0, 1, None]).withColumn("_row", F.lit(1))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert rows(kept.select("doc_id", "text")) == sorted([(1, one), (0, two)], key=str)


@pytest.mark.parametrize("join", [True, False])
def test_near_copies_meet_in_proportion(spark, join):
    """Fingerprints within 3 bits of one base: no pairs within a part, and pairs with another part in proportion."""
    r = np.random.default_rng(7)
    base = int(r.integers(1 << 62))
    met = []
    for n in (250, 1000):
        fps = {base ^ sum(1 << int(k) for k in r.choice(63, 3, replace=False)) for _ in range(n)} - {base}
        other = {base ^ 0b1111 << 40} if join else set()
        df = spark.createDataFrame([(f, 1) for f in fps - other] + [(f, 2) for f in other], "fp long, part long")
        met.append(simhash.cross_links(df).count())
    assert met == [0, 0] if not join else 0 < met[1] < 8 * met[0]


def test_meet_across_equals_plain_join(spark):
    r = random.Random(5)
    rows_ = [(r.randrange(6), i, r.randrange(4) if i % 3 else 0) for i in range(300)]
    left = spark.createDataFrame([(k, i, i, p) for k, i, p in rows_], "key long, a long, x long, part long")
    right = spark.createDataFrame([(k, i, i, p) for k, i, p in rows_ if i % 2], "key long, b long, y long, part2 long")
    want = rows(left.join(right, "key").where("part <> part2").select("a", "x", "b", "y", "part", "part2"))
    assert rows(simhash.meet_across(left, right, block=7)) == want


def test_similar_groups(spark):
    r = random.Random(13)
    words = [f"w{i}" for i in range(2000)]
    base = [[r.choice(words) for _ in range(n)] for n in (300, 500, 800)]
    texts, near, far = [], [], []
    for k, b in enumerate(base):
        for i in range(12):
            edit = list(b)
            for at in r.sample(range(len(b)), max(1, len(b) // (300 if i else 1000))):
                edit[at] = f"x{i}"
            near.append((k, len(texts)))
            texts.append(" ".join(edit))
        for i in range(5):  # every tenth word replaced: a similarity of about 0.4
            far.append(len(texts))
            texts.append(" ".join(f"y{i}" if j % 10 == 3 else w for j, w in enumerate(b)))
    texts += [*ODD, "one two", "ONE  two"]
    docs = clashing(frame(spark, texts))
    kept = {x["doc_id"] for x in simhash.keep_dissimilar(docs).collect()}
    sets = [set(simhash._sets(t, 5).tolist()) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert kept == set(group) and set(far) <= kept
    assert simhash.keep_dissimilar(docs).columns == docs.columns
    assert simhash.keep_dissimilar(docs.where("false")).count() == 0
    nulls = frame(spark, ["a b c d", "a b c d", "q w e", None, ""], [None, 4, None, 9, 8])
    assert rows(simhash.keep_dissimilar(nulls).select("doc_id", "text")) == sorted([(4, "a b c d"), (None, "q w e"), (8, "")], key=str)


def test_shared_counts_equal_brute_force(spark):
    r = random.Random(3)
    texts = [babble(r, r.randrange(4, 40), "a b c d e") for _ in range(60)] + ["a b c d e f g"] * 3 + [None, "", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    sets = [frozenset(simhash._sets(t, 3).tolist()) for t in texts]
    many = {x: sum(x in s for s in set(sets)) for s in sets for x in s}
    want = sorted((k, len(s), sum(many[x] > 1 for x in s)) for k, s in enumerate(sets))
    assert sorted(map(tuple, simhash.shared_counts(docs, 3, 300, 64).collect())) == want


def test_changed_copies_are_no_pairs(spark, monkeypatch):
    """Copies of one base with too many changes of their own to be linked are no candidates of each other or of linked ones."""
    r = random.Random(17)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for i in range(160):
        edit = list(base)
        for k, at in enumerate(r.sample(range(150), 1 if i % 2 else 6)):
            edit[at] = f"x{i}_{k}"
        texts.append(" ".join(edit))
    written, write = {}, simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df, name: written.setdefault(name, write(df, name)) if name == "pairs" else write(df, name))
    kept = {x["doc_id"] for x in simhash.keep_dissimilar(frame(spark, texts)).collect()}
    sets = [set(simhash._sets(t, 5).tolist()) for t in texts]
    linked = {k for k, s in enumerate(sets) if len(s & sets[0]) >= 0.8 * len(s | sets[0])}
    assert len(linked) > 60 and kept == {0} | set(range(161)) - linked
    assert written["pairs"].count() < 100


def test_rows_that_grow_from_few_are_not_broadcast(spark):
    """A fingerprint has some 180 probing keys, which Spark counts as one row: no join may gather them on the driver."""
    parted = spark.range(50).select(F.col("id").alias("fp"), F.col("id").alias("part"))
    sized = parted.select(F.col("fp").alias("node"), F.lit(bytes(40)).alias("fp"), "part", F.struct(F.lit(1).alias("n"), F.lit(1).alias("m"), F.lit(0).cast("long").alias("hub"), F.lit(1).alias("o")).alias("at"))
    wide = lambda x, y, part, probing: simhash.wide_keys(sized, probing).select("key", F.col("node").alias(x), F.struct("word", "at").alias(y), F.col("part").alias(part))
    for df in (simhash.cross_links(parted), simhash.meet_across(wide("a", "x", "part", False), wide("b", "y", "part2", True))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 3 and "BroadcastHashJoin" not in plan


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    assert rows(_components.components(links)) == sorted([(i, 0) for i in range(201)] + [(500, 500), (501, 500)], key=str)
    assert _components.components(links.where("false")).count() == 0


# -- 3 quality


def test_quality_gradient():
    r = np.random.default_rng(0)
    samples = [([bytes(r.integers(97, 123, 40, dtype=np.uint8))] * 2, i % 2) for i in range(8)]
    assert quality.fit(samples, steps=3) is not None
    assert quality.fit([], 1) is None and quality.fit([([b"abcdefg"], 1)], 1) is None
    net, weight = quality.ByteConvNet.fresh(3), np.ones(8)
    for part in net.parts():
        part += (r.standard_normal(part.shape) * 0.1).astype(np.float32)

    def loss():
        p = np.array([naive_score(net, t[0]) for t, _ in samples])
        y = np.array([y for _, y in samples])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    samples = [([bytes(r.integers(97, 123, 40, dtype=np.uint8))], i % 2) for i in range(8)]
    for part, gradient in zip(net.parts()[2:], quality._gradients(net, samples, weight)[2:]):
        k = int(np.abs(gradient).argmax())
        old = part.flat[k]
        part.flat[k] = old + 1e-2
        up = loss()
        part.flat[k] = old - 1e-2
        assert (up - loss()) / 2e-2 == pytest.approx(gradient.flat[k], rel=0.1, abs=1e-3)
        part.flat[k] = old


def naive_score(net, text):
    """The definition, place by place."""
    data = text if len(text) >= quality.WIDTH else text + bytes(quality.WIDTH - len(text))
    hidden = []
    for a, b in quality.chunk_ranges(len(data)):
        best = [-np.inf] * quality.FILTERS
        for i in range(a, b - quality.WIDTH + 1):
            for f in range(quality.FILTERS):
                act = sum(float(net.embed[data[i + w]] @ net.kernel[w][:, f]) for w in range(quality.WIDTH))
                best[f] = max(best[f], act)
        pooled = [max(0.0, x + float(net.bias[f])) for f, x in enumerate(best)] + [(b - a) / quality.CHUNK, np.log2(b - a) / 9]
        hidden.append([max(0.0, float(np.dot(pooled, net.hidden[:, j]) + net.hidden_bias[j])) for j in range(quality.HIDDEN)])
    both = [*np.mean(hidden, axis=0), *np.max(hidden, axis=0)]
    return 1 / (1 + np.exp(-(np.dot(both, net.out) + float(net.out_bias[0]))))


def test_quality_scores_equal_the_definition():
    net, r = quality.ByteConvNet.fresh(2), random.Random(2)
    texts = [b"", b"abc", "é😀 x".encode(), babble(r, 60).encode(), babble(r, 180).encode(), bytes(range(256))]
    got = quality.score_texts(net, net.tables(), texts)
    assert np.allclose(got, [naive_score(net, t) for t in texts], atol=1e-4)


def test_quality_chunks_cover():
    for size in (6, 511, 512, 513, 5000, 10_001):
        got = quality.chunk_ranges(size)
        assert got[0][0] == 0 and got[-1][1] == size and all(a2 <= b - quality.WIDTH + 1 for (_, b), (a2, _) in zip(got, got[1:]))


def test_quality_pooling_by_hand():
    net = quality.ByteConvNet.fresh(1)
    data = np.frombuffer(b"some bytes to pool over", np.uint8)
    got = net.pooled(data, np.array([0, 5]), np.array([14, len(data)]), net.tables())
    for (a, b), row in zip([(0, 14), (5, len(data))], got):
        acts = [sum(net.embed[data[i + w]] @ net.kernel[w] for w in range(quality.WIDTH)) for i in range(a, b - quality.WIDTH + 1)]
        assert np.allclose(row[: quality.FILTERS], np.maximum(np.max(acts, axis=0) + net.bias, 0), atol=1e-4)


def test_quality_learns(spark):
    r = random.Random(4)
    good = [babble(r, 60, "the of under street data set run to and with") for _ in range(120)]
    bad = [" ".join(["!!".join("XYZ")] * 30) + str(i) for i in range(120)]
    texts = [t for p in zip(good, bad) for t in p]
    docs = clashing(frame(spark, [*texts, *ODD]))
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(240)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    net = quality.train(docs.unionByName(docs.where("doc_id < 9")), labels, rounds=4, steps=25)
    got = {x["doc_id"]: x for x in quality.score(docs, net).collect()}
    assert len(got) == 240 + len(ODD)
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items())
    held = [x for i, x in got.items() if x["held_out"] and i < 240]
    assert sum(x["predicted"] == 1 - x["doc_id"] % 2 for x in held) >= 0.95 * len(held)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got.values())
    kept = quality.keep(docs, net)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {i for i, x in got.items() if x["predicted"]}
    none = quality.train(docs, labels.where("false"))
    assert {x["score"] for x in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.where("false"), net).count() == 0


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {x["doc_id"]: x["quality"] for x in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [x for x in queries.op3_quality(spark, sf).collect() if x["held_out"] and x["doc_id"] in labels]
    assert sum(x["predicted"] == labels[x["doc_id"]] for x in held) >= 0.9 * len(held)


# -- 4 language model


def test_lm_gradient():
    r = np.random.default_rng(3)
    ids = r.integers(0, masked_lm.VOCABULARY, 60)
    around = masked_lm.neighbours(ids, np.array([0, 20, 20, 60]))
    reach = masked_lm.REACH
    assert around[0, 0] == around[reach - 1, 20] == masked_lm.PAD and around[reach, 0] == ids[1]
    net = masked_lm.WindowNetwork(r.standard_normal(masked_lm.SIZE) * 0.3)
    gradient = masked_lm.WindowNetwork(np.zeros(masked_lm.SIZE))
    net.forward(around, ids, gradient)
    for k in r.choice(np.flatnonzero(gradient.values), 25):
        loss = []
        for step in (1e-5, -1e-5):
            moved = net.values.copy()
            moved[k] += step
            loss.append(-masked_lm.WindowNetwork(moved).forward(around, ids).mean())
        assert (loss[0] - loss[1]) / 2e-5 == pytest.approx(gradient.values[k], abs=1e-6)


def test_lm_probabilities_sum_to_one():
    net = masked_lm.WindowNetwork(np.random.default_rng(1).standard_normal(masked_lm.SIZE))
    sides = [3, 9, 700, masked_lm.PAD, 5, 5, 8, 9][: masked_lm.PLACES]
    around = np.tile(np.array(sides)[:, None], (1, masked_lm.VOCABULARY))
    assert np.exp(net.forward(around, np.arange(masked_lm.VOCABULARY))).sum() == pytest.approx(1)


def test_lm_scores_equal_the_definition(spark, monkeypatch):
    """Documents' sums, word by word: the softmax over all numbers times the share of the word's class."""
    r = random.Random(8)
    texts = [*(babble(r, r.randrange(60)) for _ in range(12)), "only once", "", None]
    docs = frame(spark, texts)
    nets = []
    plain = masked_lm._train_round
    monkeypatch.setattr(masked_lm, "_train_round", lambda *a: nets.append(plain(*a)) or nets[-1])
    got = {x["doc_id"]: x for x in masked_lm.score_documents(docs, exact_words=0).collect()}
    net = nets[-1]
    words = [re.findall(WORD, lower(t)) for t in texts]
    counts = {}
    for w in (w for ws in words for w in ws):
        counts[w] = counts.get(w, 0) + 1
    hashes = {w: int(_words.WordTable(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), _words.ALPHANUMERIC, True).hash[0]) for w in counts}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    number = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (-counts[w], signed(hashes[w]))))}
    for k, ws in enumerate(words):
        total = 0.0
        for i, w in enumerate(ws):
            side = [number[ws[j]] if 0 <= (j := i + d) < len(ws) else masked_lm.PAD for d in range(-masked_lm.REACH, masked_lm.REACH + 1) if d]
            h = np.tanh(sum(net.places[p][n] for p, n in enumerate(side)) + net.bias)
            g, x = divmod(number[w], masked_lm.GROUP)
            a, b = h @ net.group + net.group_bias, net.word[g] @ h + net.word_bias[g]
            total += a[g] - np.log(np.exp(a).sum()) + b[x] - np.log(np.exp(b).sum())
        assert got[k]["log_prob"] == pytest.approx(total, abs=1e-3)


def test_lm_shares_of_rare_words():
    n = masked_lm.FREQUENT + 3 * masked_lm.OTHERS
    top = [((1 << 40) + i * 64 if i < masked_lm.FREQUENT else i, n + 5 - i) for i in range(n)]
    later = top[masked_lm.FREQUENT :]
    counts, types = np.zeros(masked_lm.OTHERS), np.zeros(masked_lm.OTHERS)
    for w, c in later:
        counts[w % masked_lm.OTHERS] += c
        types[w % masked_lm.OTHERS] += 1
    for most in (n, n - 2 * masked_lm.OTHERS):
        lexicon = masked_lm.Lexicon.of(top[:most], counts, types)
        ids, share = lexicon.look_up(np.array([w for w, _ in top], np.uint64))
        assert ids[: masked_lm.FREQUENT].tolist() == list(range(masked_lm.FREQUENT)) and not share[: masked_lm.FREQUENT].any()
        for c in range(masked_lm.OTHERS):
            of = [i for i, (w, _) in enumerate(top) if i >= masked_lm.FREQUENT and w % masked_lm.OTHERS == c]
            assert np.exp(share[of]).sum() == pytest.approx(1) and set(ids[of]) == {masked_lm.FREQUENT + c}


def test_lm_ignores_partitions(spark):
    r = random.Random(3)
    docs = frame(spark, [babble(r, r.randrange(80)) for _ in range(40)])
    one, two = (sorted((x["doc_id"], x["log_prob"]) for x in masked_lm.score_documents(docs.repartition(n)).collect()) for n in (1, 7))
    assert [x[0] for x in one] == [x[0] for x in two] and np.allclose([x[1] for x in one], [x[1] for x in two], rtol=1e-6)


def test_lm_learns_and_scores(spark):
    r = random.Random(6)
    texts = [" ".join(["red green blue yellow"] * r.randrange(20, 40)) for _ in range(60)] + [" ".join(r.sample("red green blue yellow".split() * 30, 100)) for _ in range(8)]
    docs = clashing(frame(spark, [*texts, *ODD]))
    got = {x["doc_id"]: x for x in masked_lm.score_documents(docs).collect()}
    assert len(got) == len(texts) + len(ODD)
    for i, t in enumerate([*texts, *ODD]):
        assert got[i]["n_words"] == len(re.findall(WORD, lower(t)))
        assert (got[i]["mean_log_prob"] is None) == (got[i]["n_words"] == 0)
    assert got[60]["mean_log_prob"] < got[0]["mean_log_prob"] <= 0
    counts = {x["word"]: x["n"] for x in masked_lm.word_counts(docs).collect()}
    assert sum(counts.values()) == sum(x["n_words"] for x in got.values())
    assert masked_lm.score_documents(docs.where("false")).count() == 0


# -- 5 top k


@pytest.mark.parametrize("seed", range(6))
def test_maxscore_equals_brute_force(seed):
    r = np.random.default_rng(seed)
    n, d, k = 200, 12, 5
    v = r.integers(-6, 7, (n, d)) * (r.random((n, d)) < (0.15 if seed % 2 else 0.9))
    ids = r.permutation(1000)[:n].astype(np.int64)
    shard = topk.Shard(ids, v)
    for q in (*range(0, n, 10),):
        got_ids, got = shard.search(int(ids[q]), v[q], k)
        s = v @ v[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        assert got_ids.tolist() == ids[order].tolist() and got.tolist() == s[order].tolist()


def test_topk_blocks_and_odd_rows(spark):
    r = np.random.default_rng(9)
    data = [(int(i), [float(x) for x in r.standard_normal(8)]) for i in range(120)]
    data += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [float("inf")]), (None, [1.0]), (50, data[50][1]), (1050, [0.5]), (1100, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in data], "vec_id long, embedding array<float>, id int").withColumn("shard", F.lit(1))
    v = topk.quantised(df)
    queries_ = v.where("id % 50 = 0")
    got = rows(topk.top_k(v, queries_, 5, shard_rows=30, block_rows=2).drop("query_row"))
    q = {i: np.floor(256 * np.array(x, np.float32).astype(np.float64)).astype(int) for i, x in data if i is not None and i not in (1000, 1001, 1002, 1003)}
    table = [(i, q[i]) for i, _ in data if i in q]
    expected = []
    for i in [i for i, _ in table if i % 50 == 0]:  # 50 asks twice
        scores = sorted(((-int(sum(a * b for a, b in zip(q[i], w))), j) for j, w in table if j != i))[:5]
        expected += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores, 1)]
    assert got == sorted(expected, key=str)
    assert topk.top_k(v.where("false"), queries_, 5).count() == 0
    assert topk.top_k(v, queries_.where("false"), 5).count() == 0


def test_topk_ranks_repeated_queries_apart(spark):
    v = spark.createDataFrame([(i, [i, 100 - i]) for i in range(1, 9)], "id long, v array<long>")
    asked = spark.createDataFrame([(50, [1, 0]), (50, [0, 1]), (50, [1, 0])], "id long, v array<long>")
    for most in (100, 2):
        got = {}
        for x in topk.top_k(v, asked, 3, shard_rows=most, block_rows=most).collect():
            got.setdefault(x["query_row"], []).append((x["rank"], x["id"], x["score"]))
        want = [[(1, 8, 8), (2, 7, 7), (3, 6, 6)], [(1, 1, 99), (2, 2, 98), (3, 3, 97)], [(1, 8, 8), (2, 7, 7), (3, 6, 6)]]
        assert sorted(map(sorted, got.values())) == sorted(want)


# -- 6 decontamination


def reference_hits(text, items):
    w = re.findall(WORD, lower(text))
    hit, ids = set(), set()
    for item_id, item in items:
        b = re.findall(WORD, lower(item))
        size = min(13, len(b))
        windows = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if b else set()
        for i in range(len(w) - size + 1):
            if windows and tuple(w[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                ids.add(str(item_id))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_contamination_both_ways(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate([0, 1, 2, 5, 12, 13, 14, 20, 40, 60, 60])]
    items += [(77, None), (None, "w1 w2"), (5, "w3 w4 w5 w6"), (8, " ".join(["w1"] * 40))]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(120))) for _ in range(30)]
    for i in range(40):
        piece = r.choice([t for _, t in items if t]).split()
        a = r.randrange(len(piece))
        texts.append(" ".join([*(r.choice(words) for _ in range(r.randrange(30))), *piece[a : a + r.randrange(1, 40)], *(r.choice(words) for _ in range(5))]).upper())
    texts += [*ODD, " ".join(["w1"] * 100)]
    docs, bench = clashing(frame(spark, texts)), spark.createDataFrame(items, "item_id long, text string")
    usable = [(i, t) for i, t in items if i is not None and t is not None]
    expected = sorted(((k, *reference_hits(t, usable)) for k, t in enumerate(texts)), key=str)
    assert rows(decontaminate.contamination(docs, bench)) == expected
    assert rows(decontaminate.contamination(docs, bench, broadcast_bytes=0)) == expected
    clean = {k for k, *_, bad in expected if not bad}
    for most in (1 << 20, 0):
        kept = decontaminate.keep_clean(docs, bench, broadcast_bytes=most)
        assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == clean
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0


def test_keep_clean_with_null_and_repeated_ids(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    bad = "so " + " ".join(f"w{i}" for i in range(15))
    docs = frame(spark, [bad, "one", bad, "two", "three"], [None, None, 7, 7, 8]).withColumn("_row", F.lit(1))
    for most in (1 << 20, 0):
        kept = decontaminate.keep_clean(docs, bench, broadcast_bytes=most)
        assert kept.columns == docs.columns
        assert rows(kept.select("doc_id", "text")) == [(7, "two"), (8, "three"), (None, "one")]


# -- 7 packing


def test_packing_round_trip(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = clashing(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).unionByName(frame(spark, [None, "", "x <|endoftext|> y", "😀é", "a" * 5000, "same", "same"], [9000, 9001, 9002, 9003, 9004, 9005, 9005])).repartition(5))
    pieces = packing.pack(docs, path).cache()
    t = Tokenizer.from_file(path)
    ids = {}
    for d in docs.collect():
        ids.setdefault(d["doc_id"], []).append([*t.encode(d["text"] or "", add_special_tokens=False).ids, 1])
    got = pieces.collect()
    end = {}
    for p in sorted(got, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == end.get(p["sequence_id"], 0)
        end[p["sequence_id"]] = p["offset"] + p["length"]
        whole = ids[p["doc_id"]][0]
        part = np.array(whole[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
        assert p["ids_crc32"] == zlib.crc32(part) and p["doc_tokens"] == len(whole) and bytes(p["ids"]) == part
    assert sorted(end) == list(range(len(end))) and all(end[s] == 2048 for s in list(end)[:-1])
    assert sum(p["length"] for p in got) == sum(len(x) for xs in ids.values() for x in xs)
    full = packing.sequences(pieces)
    assert full.count() == len(end) and full.where(f"length(ids) <> {4 * 2048}").count() <= 1
    assert packing.pack(docs.where("false"), path).count() == 0


def test_encoder_equals_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    r = random.Random(1)
    texts = [x or "" for x in ODD] + [end, f"{end} a", f"a {end} b", f"a{end}", f"a  {end}\n{end} b  c", f" {end}", f"x {end[:-1]} y", "a\x1cb \x85 c \u2003d"]
    texts += [babble(r, 40) + r.choice(["  ", "\n\n x", "'s it", "12 345", end, f" {end} ", " ", " z", "don't  we'll", "\t \t."]) + babble(r, 9) for _ in range(300)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        for most in (1 << 20, 5):
            mine = packing.Encoder(public_tokenizers.path(name), most)
            for a in range(0, len(texts), 50):
                for text, ids in zip(texts[a : a + 50], mine.encode(texts[a : a + 50])):
                    assert np.frombuffer(ids, mine.type).tolist() == t.encode(text, add_special_tokens=False).ids, text[:50]


def test_near_dedup_drops_what_packing_remembers(spark):
    """Workers are used again by other stages: the encoder's words do not stay while documents are compared."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = frame(spark, ["a b c d e f g"] * 640).repartition(64)

    def left(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [packing.encoder.cache_info().currsize]})

    packing.tokenised(docs, path).write.format("noop").mode("overwrite").save()
    assert max(r["n"] for r in spark.range(64, numPartitions=64).mapInArrow(left, "n long").collect()) == 1
    simhash.shingle_prints(docs.select(F.col("doc_id").alias("row"), "text"), 5).write.format("noop").mode("overwrite").save()
    assert max(r["n"] for r in spark.range(64, numPartitions=64).mapInArrow(left, "n long").collect()) == 0


def test_packing_long_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["a" + " " * 1_000_000 + "b <|endoftext|> c", "\n" * 1_200_000, "short"]
    want = {(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, x in enumerate(texts) for ids in [[*t.encode(x, add_special_tokens=False).ids, 1]]}
    pieces = packing.pack(frame(spark, texts), path, length=1 << 24)
    assert {(p["doc_id"], p["doc_tokens"], p["ids_crc32"]) for p in pieces.collect()} == want


# -- 8 repeated passages


def reference_repeats(texts, window=35):
    words = [re.findall(SPACED, t or "") for t in texts]
    counts = {}
    for w in words:
        for i in range(len(w) - window + 1):
            counts[tuple(w[i : i + window])] = counts.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for k, w in enumerate(words):
        gone = {j for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((k, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeats_equal_brute_force(spark):
    r = random.Random(11)
    passages = [babble(r, n, " ".join(f"p{i}" for i in range(300))) for n in (34, 35, 36, 60, 90, 200)]
    texts = []
    for _ in range(80):
        parts = [babble(r, r.randrange(60), " ".join(f"q{i}" for i in range(500)))]
        for _ in range(r.randrange(3)):
            piece = r.choice(passages).split()
            a = r.randrange(len(piece))
            parts += [" ".join(piece[a : a + r.randrange(120)]), babble(r, r.randrange(20), " ".join(f"q{i}" for i in range(500)))]
        texts.append("  ".join(parts))
    texts += [*ODD, "be " * 34, "be " * 35, "go " * 36, "go " * 300, "be\tgo " * 80, texts[0], texts[0], passages[3] + " " + passages[4], passages[3] + " x " + passages[4] + " " + passages[3]]
    docs = clashing(frame(spark, texts).repartition(5))
    got = repeats.remove_repeats(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept")
    assert rows(got) == reference_repeats(texts)
    kept = {x["doc_id"]: x["kept"] for x in repeats.remove_repeats(docs).collect()}
    assert all(hashlib.sha256(kept[k].encode()).hexdigest() == h for k, _, _, h in reference_repeats(texts))
    assert repeats.remove_repeats(docs.where("false")).count() == 0


def test_repeats_leave_texts_in_their_buckets(spark):
    line = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(i, f"{line} x{i}") for i in range(40)] + [(99, "short")], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = repeats.remove_repeats(docs, digest=True)
        plan = found._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.split("\n") if "FileScan" in line and "texts" in line]
        assert len(scans) == 2 and all("Bucketed: true" in line for line in scans)
        assert rows(found.select("doc_id", "n_removed")) == sorted([(i, 50) for i in range(40)] + [(99, 0)], key=str)
        assert [x["tableName"] for x in spark.sql("SHOW TABLES").collect() if x["tableName"].startswith("nomen_groups")] == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_full_bucket_of_windows_takes_little_memory():
    r = np.random.default_rng(3)
    blobs = [r.integers(1 << 62, size=12 * (1 << 12) // 8).astype(np.int64).tobytes() for _ in range(repeats.BUCKET_WINDOWS >> 12)]
    flags = [bytes((1 << 12) // 8)] * len(blobs)
    tracemalloc.start()
    repeats._repeated(blobs, flags, 12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


def test_repeats_same_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = frame(spark, [text, text, "other words"], [5, 5, None])
    assert rows(repeats.remove_repeats(docs).select("doc_id", "n_removed")) == [(5, 50), (5, 50), (None, 0)]


def test_locate_finds_what_only_the_phrases_tell():
    r = random.Random(13)
    for trial in range(60):
        letters = [b"w%d" % i for i in range(r.choice([2, 3, 400]))]
        phrases = [[r.choice(letters) for _ in range(r.randrange(35, 120))] for _ in range(r.randrange(1, 6))]
        docs = []
        for _ in range(r.randrange(1, 6)):
            words = [r.choice(letters) for _ in range(r.randrange(30))]
            for _ in range(r.randrange(4)):
                p = r.choice(phrases)
                a = r.randrange(len(p))
                words += p[a : a + r.randrange(20, 90)] + [r.choice([b"x", letters[0]])]
            docs.append(words)
        windows = {tuple(p[i : i + 35]) for p in phrases for i in range(len(p) - 34)}
        expected = [{j for i in range(len(d) - 34) if tuple(d[i : i + 35]) in windows for j in range(i, i + 35)} for d in docs]
        joined = [b" ".join(p) for p in phrases]
        for most in (1, 60, 400_000):
            assert [set(np.flatnonzero(h).tolist()) for h in repeats.locate(docs, joined, most)] == expected
        assert not any(h.any() for h in repeats.locate(docs, []))


def test_passages_end_with_documents_and_pieces():
    starts, doc = np.array([0, 1, 36, 72, 80, 81, 200]), np.array([0, 0, 0, 0, 0, 1, 1])
    found = repeats.passages(starts, doc, starts // 64)
    assert [x.tolist() for x in found] == [[0, 1, 1, 3], [0, 72, 81, 200], [71, 115, 116, 235]]
    assert [len(x) for x in repeats.passages(starts[:0], doc[:0], doc[:0])] == [0, 0, 0]


# -- 9 licences


def test_suffix_automaton_statistics():
    r = random.Random(12)
    sequences = [[r.randrange(4) for _ in range(r.randrange(1, 25))] for _ in range(12)]
    automaton = license_scan.SuffixAutomaton(sequences)
    for _ in range(60):
        stream = [r.randrange(4) for _ in range(30)]
        if r.random() < 0.7:
            s = r.choice(sequences)
            stream[5 : 5 + len(s)] = s
        longest = []
        for i in range(len(stream)):
            best = 0
            for size in range(i + 1, 0, -1):
                run = stream[i - size + 1 : i + 1]
                if any(s[j : j + size] == run for s in sequences for j in range(len(s) - size + 1)):
                    best = size
                    break
            longest.append(best)
        expected = [(i - n + 1, i + 1) for i, n in enumerate(longest) if n >= license_scan.LEAST_RUN and (i + 1 == len(stream) or longest[i + 1] != n + 1)]
        got = list(automaton.runs(stream))
        assert [(a, b) for a, b, _ in got] == expected
        for a, b, state in got:
            places = [(k, j + b - a - 1) for k, s in enumerate(sequences) for j in range(len(s) - (b - a) + 1) if s[j : j + b - a] == stream[a:b]]
            assert sorted(automaton.place[state]) == places


def naive_shares(words, templates):
    """Label to the covered share of the best chain, by comparing every run with every earlier one."""
    split = [license_scan.words_of(t) for _, t in templates]
    longest = []
    for i in range(len(words)):
        n = max((n for s in split for j in range(len(s)) for n in [next((m for m in range(min(i, j) + 2) if m > min(i, j) or words[i - m] != s[j - m]), 0)]), default=0)
        longest.append(n)
    runs = [(i - n + 1, i + 1) for i, n in enumerate(longest) if n >= license_scan.LEAST_RUN and (i + 1 == len(words) or longest[i + 1] != n + 1)]
    best = {}
    for (label, _), s in zip(templates, split):
        pieces, done = [], 0
        for a, b in runs:
            for j in range(len(s) - (b - a) + 1):
                if s[j : j + b - a] == words[a:b]:
                    pieces += [(a, b, j)] + [(done, b, j + done - a)] * (a < done < b)
            done = b
        chains = []
        for a, b, j in sorted(pieces):
            before = max(((v - license_scan.GAP_COST * (a - e), c, f) for v, c, f, e, t in chains if e <= a and t <= j), default=(0, 0, a))
            before = before if before[0] > 0 else (0, 0, a)
            chains.append((before[0] + b - a, before[1] + b - a, before[2], b, j + b - a))
        if chains:
            share = min(1.0, max(chains)[1] / len(s))
            best[label] = max(best.get(label, 0), share)
    return best


def test_license_chains_equal_brute_force(spark):
    r = random.Random(21)
    templates = [("a", " ".join(r.choice("k l m n o p q".split()) for _ in range(60))), ("a", "one two three four five six"), ("b", " ".join(f"t{i % 23}" for i in range(70)))]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(r.randrange(6)):
            s = r.choice(templates)[1].split()
            i = r.randrange(len(s))
            parts += [*s[i : i + r.randrange(25)], *("x" for _ in range(r.randrange(9)))]
        texts.append(" ".join(parts))
    scanner = license_scan.Scanner(tuple(templates))
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        (row,) = scanner.scan(_words.WordTable(data, np.array([0, len(data)]), _words.ALPHANUMERIC, True))
        want = naive_shares(text.split(), templates)
        assert row[6] == pytest.approx(max(want.values(), default=0.0)), text
        assert row[5] == ",".join(sorted(k for k, v in want.items() if v >= license_scan.LEAST_COVER))


def test_license_query_base_columns(spark, sf_dir):
    """The base columns of the registered query, by SQL."""
    import duckdb

    sql = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
    f(phrase, label) AS (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')),
    p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
    h AS (SELECT doc_id, i - 1 AS i, label FROM p, f WHERE w[i:i + len(phrase) - 1] = phrase)
    SELECT d.doc_id, any_value(len(w)) AS n_words, count(h.i) AS n_base, min(h.i) AS first_word, max(h.i) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
    FROM d LEFT JOIN h ON h.doc_id = d.doc_id GROUP BY d.doc_id"""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = queries.op9_license_scan(spark, sf_dir)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert rows(found.select(names)) == sorted(con.execute(sql).fetchall(), key=str)
    assert found.where("score < 0 OR score > 1 OR NOT contains(labels, base_labels)").where("base_labels <> 'cc-by,gpl'").count() == 0


def test_whole_licences_with_insertions(spark):
    whole = dict(license_scan.all_templates())
    mit = license_scan.SHORT[0][1].split()
    half = len(mit) // 2
    texts = [" ".join([*mit[:half], *mit[:5], *mit[half:]]), " ".join([*mit[:half], *["foreign"] * 6, *mit[half:]]), whole["mpl"], whole["apache"].upper(), " ".join(mit[half:] + mit[:half])]
    got = {x["doc_id"]: x for x in license_scan.scan_licenses(frame(spark, texts)).collect()}
    assert [got[i]["labels"] for i in range(2)] == ["mit", "mit"] and got[0]["score"] == got[1]["score"] == 1.0
    assert "mpl" in got[2]["labels"].split(",") and "apache" in got[3]["labels"].split(",")
    assert got[4]["labels"] == "" and 0.4 < got[4]["score"] < 0.6


def test_license_scan(spark):
    text = license_scan.SHORT[0][1]
    texts = ["Licensed under CC BY-NC 4.0. cc by", "This is under the GNU General Public License", "all rights. Reserved; ALL RIGHTS RESERVED", f"junk {text.upper()} more", text[: len(text) // 4], *ODD]
    got = {x["doc_id"]: x for x in license_scan.scan_licenses(clashing(frame(spark, texts))).collect()}
    assert [(got[i]["n_base"], got[i]["first_word"], got[i]["last_word"], got[i]["base_labels"]) for i in range(4)] == [(2, 2, 7, "cc-by"), (1, 5, 5, "gpl"), (2, 0, 3, "reserved"), (0, None, None, "")]
    assert "cc-by-nc" in got[0]["labels"].split(",") and got[3]["labels"] == "mit" and got[3]["score"] == 1.0
    assert got[3]["spans"][0]["first_word"] == 1 and got[4]["labels"] == "" and 0 < got[4]["score"] < 0.5
    for i, t in enumerate(texts):
        w = re.findall(WORD, lower(t))
        places = [k for p in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert got[i]["n_words"] == len(w) and got[i]["n_base"] == len(places)
    assert license_scan.scan_licenses(frame(spark, texts).where("false")).count() == 0


# -- 10 WARC


def test_warc_round_trip(spark, tmp_path):
    bodies = ["<p>a</p>", None, "", "<p>a</p>", "é" * 3000, "<p>a</p>", "é" * 3000, "x\r\n\r\nWARC/1.1\r\n"]
    pages = spark.createDataFrame([(i, f"http://h/{i}\n", b) for i, b in enumerate(bodies)] + [(None, None, "<p>a</p>"), (7, "u", bodies[7])], "page_id long, url string, html string").withColumn("key", F.lit(1))
    path = f"file://{tmp_path}/w"
    warc.write_archive(warc.to_records(pages).repartition(3), path, filebytes="300")
    data = [(b or "").encode() for b in bodies]
    last = {d: max(i for i, x in enumerate(data) if x == d) for d in data}
    expected = [(i, len(d), warc.base32_sha1(d), "response" if last[d] == i else "revisit", None if last[d] == i else last[d]) for i, d in enumerate(data)]
    expected += [(None, 8, warc.base32_sha1(b"<p>a</p>"), "revisit", 5), (7, len(data[7]), warc.base32_sha1(data[7]), "response", None)]
    assert rows(warc.archive_report(spark, path)) == sorted(expected, key=str)
    assert warc.to_records(pages, least_bytes=100).where("record_type = 'revisit'").count() == 1
    some = warc.read_archive(spark, path, payload=False).where("record_type = 'revisit' AND target_uri LIKE 'http://h/4%'")
    assert [x["record_id"] for x in some.collect()] == ["urn:page:4"]
    heads = warc.read_archive(spark, path, payload=False)
    assert heads.where("payload IS NOT NULL").count() == 0 and heads.count() == 10
    empty = f"file://{tmp_path}/e"
    warc.write_archive(warc.to_records(pages.where("false")), empty)
    assert warc.archive_report(spark, empty).count() == 0


def test_warc_foreign_records(tmp_path):
    import gzip

    record = lambda i, body: b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <u:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (b"response" if i % 2 else b"request", i, len(body), body)
    bodies = [b"x" * 10, b"y" * 200_000, b"", b"z" * 70_000]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(i, b)) for i, b in enumerate(bodies)))
    (tmp_path / "b.warc").write_bytes(b"".join(record(i, b) for i, b in enumerate(bodies)))
    for name in ("a.warc.gz", "b.warc"):
        fs, root = warc.filesystem(f"file://{tmp_path}")
        with fs.open_input_file(f"{root}/{name}") as f:
            got = list(warc.records(f, lambda r: r["record_type"] == "response", True))
        assert [(r["record_id"], r["payload"]) for r in got] == [("u:1", bodies[1]), ("u:3", bodies[3])]


def test_warc_pushes_filters():
    from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringStartsWith

    reader = warc._Reader({"path": "file:///tmp/none"})
    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), IsNotNull(("record_type",)), In(("target_uri",), ("a", "b")), StringStartsWith(("record_id",), "u"), EqualTo(("payload_length",), 3)]))
    assert [type(f).__name__ for f in rest] == ["IsNotNull", "EqualTo"]
    assert reader.wanted({"record_type": "revisit", "target_uri": "a", "record_id": "u1"}) and not reader.wanted({"record_type": "response", "target_uri": "a", "record_id": "u1"})


# -- SQL and the pipeline


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.select(*sorted(names))) == sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall()), key=str)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "packing"] and p.ORACLE_SQL is None
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {x["doc_id"] for x in quality.score(docs, net).where("predicted = 1").collect()}
    kept = p.quality_stage(spark, docs, sf_dir).cache()
    assert {x["doc_id"] for x in kept.collect()} == want
    one = p.near_dedup_stage(spark, kept, sf_dir).cache()
    texts = {x["doc_id"]: x["text"] for x in kept.collect()}
    ids = sorted(texts)
    stay = {x["doc_id"] for x in one.collect()}
    sets = {i: set(simhash._sets(texts[i], 5).tolist()) for i in ids}
    alike = lambda i, j: (both := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - both)
    assert all(any(alike(i, j) for j in ids if j != i) for i in set(ids) - stay)  # what goes is like another one
    left = [(i, j) for i in stay for j in stay if i < j and alike(i, j)]
    assert len(left) <= 0.1 * max(1, len(ids) - len(stay))
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = p.decontamination_stage(spark, one, sf_dir).cache()
    assert {x["doc_id"] for x in clean.collect()} == {x["doc_id"] for x in one.collect() if not reference_hits(x["text"], items)[-1]}
    hidden = p.pii_stage(spark, clean, sf_dir).cache()
    assert hidden.columns == docs.columns and hidden.dtypes == docs.dtypes and hidden.count() == clean.count()
    assert all(not pii.base_spans(x["text"])[k] for x in hidden.collect() for k in ("email", "ip", "card", "phone"))
    pieces = p.packing_stage(spark, hidden, sf_dir)
    assert {x["doc_id"] for x in pieces.select("doc_id").distinct().collect()} == {x["doc_id"] for x in hidden.collect()}


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_edges(spark, sf_dir, stage):
    import corpus_pipeline as p

    docs = frame(spark, [*ODD, "plain text here", "plain text here"]).withColumn("score", F.lit(1))
    for part in (docs, docs.where("false")):
        out = p.STAGES[stage][1](spark, part, sf_dir)
        assert out.count() >= 0 and (stage == 4 or out.columns == docs.columns)


def test_long_documents_hash_in_blocks(monkeypatch):
    r = random.Random(2)
    text = pa.array([babble(r, 3000), "z" * 900 + " " + babble(r, 50), ""])
    (_, _, whole), = _words.tables(text, _words.ALPHANUMERIC, True)
    monkeypatch.setattr(_words, "CHUNK_BYTES", 64)
    (_, _, pieces), = _words.tables(text, _words.ALPHANUMERIC, True, 1 << 20)
    assert whole.hash.tolist() == pieces.hash.tolist()
