"""Collocations, byte-level BPE and periodic runs against definitions on small texts and on the smallest tables."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from nomen.llm import byte_bpe, collocations, periodic_runs, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark, rows):
    """Documents with columns whose names clash with those that the operators use inside."""
    full = [(i, t, lang, "x", 1, [2], "y") for i, t, lang in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, id string, row long, ids array<int>, key string")


# -- byte-level BPE


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def round_trip(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def odd_texts():
    r = random.Random(1)
    parts = ["a", "b", "é", "'s", "'", "'ll", " ", "  ", "\n", " \n", "1", "22", "٣", "中", "。", "　", " ", "\x1c", "😀", "-", "!?", "\t", "don't "]
    texts = [None, "", "   ", "x", "a" * 500, "x" + " " * 500 + "y", "中" * 300, "1" * 300 + "a" * 300, "'" * 200 + "s" * 200]
    return texts + ["".join(r.choice(parts) for _ in range(r.randrange(400))) for _ in range(120)]


@pytest.mark.parametrize("chunk, overlap", [(40, 9), (64, 20), (7, 3), (1 << 16, 1 << 12)])
def test_bpe_chunks(spark, library, chunk, overlap):
    rows = list(enumerate(odd_texts())) + [(None, "hello world " * 50)] * 2 + [(3, "x")] * 2
    docs = table(spark, [(i, t, "en") for i, t in rows]).repartition(3)
    got = sorted((tuple(r) for r in byte_bpe.round_trip(docs, PATH, chunk=chunk, overlap=overlap).collect()), key=str)
    assert got == sorted(((i, *round_trip(library, t)) for i, t in rows), key=str)


def test_bpe_pieces(spark, library):
    """Ids of pieces follow one another, and their bytes are the text's."""
    docs = table(spark, [(i, t, "en") for i, t in enumerate(odd_texts())])
    found = byte_bpe.decode(byte_bpe.encode(docs, PATH, chunk=50, overlap=10), PATH).collect()
    for i, text in enumerate(odd_texts()):
        own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.piece)
        ids = [x for r in own for x in np.frombuffer(r.ids, "<u2").tolist()]
        assert ids == library.encode_ordinary(text or "")
        assert b"".join(bytes(r.data) for r in own).decode() == (text or "")
    assert max(sum(r.doc_id == i for r in found) for i in range(len(odd_texts()))) > 3


def test_bpe_blank_runs(library):
    own = byte_bpe.codec(PATH)
    text = "x" + " " * 20_000 + "y" + "\n" * 20_000 + " q" + "\t" * 20_000
    assert own.encode(text) == library.encode_ordinary(text)
    huge = "x" + " " * 1_200_000 + "y"
    assert own.decode(own.encode(huge)).decode() == huge


def test_bpe_tables(spark, sf_dir, documents, library):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_byte_bpe(spark, sf_dir).collect()}
    assert got == {r.doc_id: round_trip(library, r.text) for r in documents.collect()}
    assert byte_bpe.round_trip(documents.limit(0), PATH).count() == 0


# -- periodic runs


def all_runs(words):
    """Every period in turn."""
    w, found = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if words else np.zeros(0, int), {}
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[0], (w[:-q] == w[q:]).astype(int), [0]])
        edge = np.diff(same)
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if e + q - s >= max(6, 4 * q):
                found.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def run_report(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted(all_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n_, q in found for i in range(s + q, s + n_)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def periodic_texts():
    r = random.Random(2)
    texts = [None, "", " \t", "a", "a " * 5, "a " * 6, "ä b " * 4, "a b c\nd " * 3, "a a " * 9]
    for _ in range(150):
        block = [str(r.randrange(3)) for _ in range(r.randrange(1, 6))]
        inner = block * r.randrange(1, 9) + [str(r.randrange(3))]
        texts.append(" ".join(inner * r.randrange(1, 6) + [str(r.randrange(2)) for _ in range(r.randrange(40))]))
    return texts


def test_runs_small(spark):
    rows = list(enumerate(periodic_texts())) + [(None, "a b " * 9)] * 2 + [(1, "a b " * 9)] * 2
    docs = table(spark, [(i, t, "en") for i, t in rows]).repartition(3)
    got = sorted((tuple(r) for r in periodic_runs.run_digests(docs).collect()), key=str)
    assert got == sorted((run_report(i, t) for i, t in rows), key=str)


def test_runs_real_output(spark):
    docs = table(spark, [(1, "x a b a b a b a b y", "en"), (2, None, None)])
    one, two = periodic_runs.find_runs(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in one.runs] == [(1, 8, 2)] and one.collapsed == "x a b y" and one.exponent_milli == 4000
    assert two.runs == [] and two.collapsed == "" and two.start is None


def test_runs_tables(spark, sf_dir, documents):
    got = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, sf_dir).collect())
    want = sorted(run_report(r.doc_id, r.text) for r in documents.collect())
    assert got == want and sum(r[1] for r in want) > 10
    assert periodic_runs.run_digests(documents.limit(0)).count() == 0


@pytest.mark.parametrize("words", [np.zeros(200_000, np.int64), np.arange(200_000) % 1000, np.arange(200_000)])
def test_runs_long(words):
    """Long regular texts take a second, not the square of their length."""
    found = periodic_runs.runs(words, np.zeros(len(words), np.int64)).tolist()
    period = len(set(words[:1000].tolist())) if words[-1] < 1000 else None
    assert found == ([[0, len(words), period]] if period else [])


# -- collocations


def ranked_phrases(rows, least, top):
    count, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            own = count.setdefault(lang, Counter())
            for m in range(1, 6):
                own.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, own in count.items():
        n, kept = total[lang], []
        good = {p: a for p, a in own.items() if len(p) >= 2 and a >= least}
        parts = {}
        for p, a in good.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        parts[p[i:j]] = max(parts.get(p[i:j], 0), a)
        for p, a in good.items():
            if parts.get(p, -1) >= a:
                continue
            score, _, left, right = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def phrase_rows():
    r = random.Random(3)
    words = ["New", "york", "the", "of", "a", "ä", "中", "é"]
    rows = [(None, "en"), ("", None), (" ,.", "en"), ("x", None)]
    for i in range(120):
        parts = [r.choice(words) if r.random() < 0.7 else r.choice(["new york city hall is", "of the", "a a a a a a a"]) for _ in range(r.randrange(30))]
        text = "".join(w + r.choice([" ", " ", "\t", ". ", ",", "\n", ";"]) for w in parts)
        rows.append((text, r.choice(["en", None, "de", "und"])))
    return rows + rows[-9:] * 3


@pytest.mark.parametrize("least, top", [(3, 2000), (12, 7)])
def test_phrases_small(spark, least, top):
    rows = phrase_rows()
    docs = table(spark, [(None if i % 5 else i, t, lang) for i, (t, lang) in enumerate(rows)]).repartition(4)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=least, top=top).collect())
    assert got == ranked_phrases(rows, least, top) and got


def test_phrases_hot_leads(spark, monkeypatch):
    """Leading words of most suffixes are dealt by the fourth word, with the same result."""
    monkeypatch.setattr(collocations, "hot_leads", lambda docs, words, pairs, longest: every_lead(docs, words, pairs, longest))

    def every_lead(docs, words, pairs, longest):
        import pyarrow as pa

        def run(batches):
            for batch in batches:
                for _, g in collocations._groups(batch):
                    columns, _ = collocations.suffixes(g, words, pairs, longest)
                    yield pa.RecordBatch.from_arrays([pa.array(collocations._leading(columns).view(np.int64))], names=["lead"])

        found = docs.mapInArrow(run, "lead long").distinct().toArrow()["lead"].to_numpy().view(np.uint64)
        assert len(found) > 3
        return np.sort(found)[::2]

    rows = phrase_rows()
    docs = table(spark, [(i, t, lang) for i, (t, lang) in enumerate(rows)]).repartition(4)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=3).collect())
    assert got == ranked_phrases(rows, 3, 2000)


def test_phrases_hot_share(spark):
    rows = [(i, "of the sea " + " ".join(f"w{j % 40} x{j % 7}" for j in range(i, i + 9)), "en") for i in range(3000)]
    docs = table(spark, rows).select("text", "lang")
    words = collocations.bitmap(collocations.word_counts(docs).select("h"))
    pairs = collocations._pair_bitmap(collocations.frequent_pairs(docs, words, 1, 8))
    assert 0 <= len(collocations.hot_leads(docs, words, pairs, 5)) <= 2 * collocations.HOT_SHARE


def test_phrases_empty(spark, documents):
    assert collocations.collocations(documents.limit(0)).count() == 0
    assert collocations.collocations(table(spark, [(1, "a b c", "en")])).count() == 0


def test_phrases_tables(spark, sf_dir):
    found = queries.op11_collocations(spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cursor = con.execute(collocations.ORACLE)
    assert [d[0] for d in cursor.description] == found.columns
    assert sorted(tuple(r) for r in found.collect()) == sorted(cursor.fetchall())


# -- near copies of the pipeline


def test_recall_of_near_copies(spark):
    """At least nine tenths of the pairs of unequal texts with a similarity of 0.8 or more fall into one group."""
    from nomen.llm import simhash
    from nomen.llm._shared import numbered

    docs, row = numbered(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"), "all")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    sets = [simhash._sets(texts[i], 5) for i in ids]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    hashes = np.concatenate(sets)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    size = np.diff(np.append(first, len(hashes)))
    # shingles of more than 60 documents are left to the others of a pair, to keep this list short
    met = {(a, b) for f, n in zip(first.tolist(), size.tolist()) if 1 < n <= 60 for i, b in enumerate(owner[f : f + n].tolist()) for a in owner[f : f + i].tolist()}
    pairs = []
    for a, b in met:
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 0.8 <= both / (len(sets[a]) + len(sets[b]) - both) < 1:
            pairs.append((ids[a], ids[b]))
    group = {r.doc_id: r.group for r in simhash.similar_groups(docs, row).withColumnRenamed("row", row).join(docs, row).select("doc_id", "group").collect()}
    found = sum(group[a] == group[b] for a, b in pairs)
    assert len(pairs) > 40 and found >= 0.9 * len(pairs), (found, len(pairs))


# -- rounds of the masked model


@pytest.mark.parametrize("rounds", [1, 3])
def test_every_document_trains_once(spark, documents, monkeypatch, rounds):
    from nomen.llm import masked_lm

    seen = []
    monkeypatch.setattr(masked_lm, "_train_round", lambda tokens, net, shards: seen.append([r.id for r in tokens.select("id").collect()]) or net)
    scored = masked_lm.score_documents(documents, rounds=rounds)
    assert len(seen) == rounds and all(seen)
    assert sorted(x for part in seen for x in part) == sorted(r.doc_id for r in documents.select("doc_id").collect())
    assert scored.count() == documents.count()
    with pytest.raises(ValueError):
        masked_lm.score_documents(documents, rounds=0)
