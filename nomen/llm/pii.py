"""Personal data by weak supervision.

Rules and labelers propose and judge spans, their votes are counted over the whole corpus, expectation
maximisation estimates each labeler's reliability from the counts alone (no labels), and a logistic span
classifier is trained on the resulting soft labels.  Spans that pass the strict patterns always stay; the
classifier decides about all other candidates.

Two passes over the text.  What reaches the driver between them is one row per distinct vote-and-feature
pattern: at most ``len(KINDS) * 3**4 * 36`` rows whatever the size of the corpus.

Null text counts as empty, an empty table gives an empty result, repeated rows give a row each, and other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Each possessive form matches what the plain pattern matches, as no part can give characters back to another.
# The look-behind only leaves out starts inside a number, from where a match would have begun earlier.
_CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NAMED_SECRET = re.compile(r"(?i)(?<![a-z])(password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|private[_-]?key)[\x20\t]{0,4}[=:][\x20\t]{0,4}[\"']?([^\s\"',;]{6,}+)")
_LONG_TOKEN = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+")

# Gazetteers (fixed values)
_TLDS = frozenset("com org net edu gov io co uk de fr es it eu us info biz ca au ch at nl se no".split())
_CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420")
_ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "65", "2221", "2720")
_SECRET_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xox", "sk-", "AIza", "eyJ")
_FOR = {
    "email": re.compile(r"(?i)mail|contact|write|from|to:|@"),
    "ip": re.compile(r"(?i)\bip\b|address|host|server|login"),
    "card": re.compile(r"(?i)card|visa|master|credit|payment|amex"),
    "phone": re.compile(r"(?i)phone|tel|call|mobile|fax|contact|cell"),
    "secret": re.compile(r"(?i)pass|pwd|token|secret|key|credential|auth"),
}
_AGAINST = re.compile(r"(?i)version|isbn|release|order no|invoice|doi|rfc|section|commit|sha-?\d|md5|checksum|http|www|href|/")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` in linear time, from the at signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_PART:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def ips(text: str) -> Iterator[tuple[int, int, bool]]:
    """Four parts at a time of each chain of dotted numbers, with whether every part is 255 at most."""
    for chain in _CHAIN.finditer(text):
        parts, at = chain[0].split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            small = all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four)
            yield at, at + size, small
            at += size + 1


def _numbers(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int, str]]:
    for m in pattern.finditer(text):
        yield m.start(), m.end(), re.sub("[^0-9]", "", m[0])


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The strict spans of each base kind."""
    return {
        "email": list(emails(text)),
        "ip": [(a, b) for a, b, ok in ips(text) if ok],
        "card": [(a, b) for a, b, d in _numbers(_CARD, text) if 16 <= len(d) <= 19 and luhn(d)],
        "phone": [(a, b) for a, b, d in _numbers(_PHONE, text) if 8 <= len(d) <= 15],
    }


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    base: bool
    pattern: str  #: kind, the four votes (n, 0, p) and three features


def _vote(good: bool, bad: bool) -> str:
    return "p" if good and not bad else "n" if bad and not good else "0"


def _gazetteer(kind: str, span: str) -> str:
    if kind == "email":
        return _vote((known := span.rpartition(".")[2].lower() in _TLDS), not known)
    if kind == "phone":
        return _vote(span[1:].startswith(_CALLING_CODES), False)
    if kind == "card":
        return _vote((known := span.startswith(_ISSUERS)), not known)
    if kind == "ip":
        return _vote(False, span.startswith("0") or span.endswith(".0"))
    return _vote(span.startswith(_SECRET_PREFIXES), False)


def _shape(kind: str, span: str, before: str, after: str) -> str:
    if kind == "secret":
        digits = sum(c.isdigit() for c in span)
        letters = sum(c.isalpha() for c in span)
        mixed = digits >= 3 and letters >= 3 and len(set(span)) >= 8
        return _vote(mixed, digits < 2 or letters == 0)
    joined = before.isalnum() or after.isalnum() or (kind in ("ip", "card") and (before in ".-/" and before != "" or after in "-/" and after != ""))
    return _vote(not joined, joined)


def _side(c: str) -> str:
    return "s" if c == "" or c.isspace() else "q" if c in "\"'=:<>([])" else "o"


def _candidate(text: str, kind: str, a: int, b: int, base: bool, rule: str) -> Candidate:
    span, before, after = text[a:b], text[a - 1 : a] if a else "", text[b : b + 1]
    left = text[max(0, a - 32) : a]
    size = b - a
    votes = rule + _gazetteer(kind, span) + _vote(bool(_FOR[kind].search(left)), bool(_AGAINST.search(left))) + _shape(kind, span, before, after)
    features = ("0" if size < 12 else "1" if size < 20 else "2" if size < 32 else "3") + _side(before) + _side(after)
    return Candidate(kind, a, b, base, f"{kind}|{votes}|{features}")


def candidates(text: str) -> list[Candidate]:
    """Strict spans, spans that only look like them, and named or random-looking secrets, each with its votes."""
    found: list[Candidate] = []
    for a, b in emails(text):
        found.append(_candidate(text, "email", a, b, True, "p"))
    for a, b, ok in ips(text):
        found.append(_candidate(text, "ip", a, b, ok, "p" if ok else "n"))
    for a, b, d in _numbers(_CARD, text):
        if 15 <= len(d) <= 19:
            ok = luhn(d)
            found.append(_candidate(text, "card", a, b, ok and len(d) >= 16, "p" if ok else "n"))
    for a, b, d in _numbers(_PHONE, text):
        ok = 8 <= len(d) <= 15
        found.append(_candidate(text, "phone", a, b, ok, "p" if ok else "n"))
    taken = 0
    for a, b, named in sorted([(m.start(2), m.end(2), True) for m in _NAMED_SECRET.finditer(text)] + [(m.start(), m.end(), False) for m in _LONG_TOKEN.finditer(text)], key=lambda x: (x[0], -x[1])):
        if a >= taken:
            issued = text.startswith(_SECRET_PREFIXES, a) and b - a >= 16
            digits = any(c.isdigit() for c in text[a:b])
            found.append(_candidate(text, "secret", a, b, False, "p" if named or issued else "0" if digits else "n"))
            taken = b
    return found


@dataclass(frozen=True)
class SpanModel:
    """``prior``: share of true spans by kind; ``reliability``: labeler, truth (0, 1), vote (n, 0, p); ``weights``."""

    prior: dict[str, float]
    reliability: np.ndarray
    weights: np.ndarray
    threshold: float = 0.5

    def accepts(self, pattern: str) -> bool:
        return self.score(pattern) >= self.threshold

    def score(self, pattern: str) -> float:
        return float(1 / (1 + np.exp(-(_encode(pattern) @ self.weights))))


def _encode(pattern: str) -> np.ndarray:
    kind, votes, features = pattern.split("|")
    x = np.zeros(1 + len(KINDS) + 12 + 4 + 6)
    x[0] = 1
    x[1 + KINDS.index(kind)] = 1
    at = 1 + len(KINDS)
    for i, v in enumerate(votes):
        x[at + 3 * i + "n0p".index(v)] = 1
    at += 12
    x[at + int(features[0])] = 1
    x[at + 4 + "sqo".index(features[1])] = 1
    if features[2] != "o":
        x[at + 7 + "sq".index(features[2])] = 1
    return x


def fit(counts: dict[str, int], rounds: int = 50, steps: int = 300) -> SpanModel:
    """EM over the pattern counts, then a logistic classifier on the posteriors.  Same counts, same model."""
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    votes = np.array([["n0p".index(v) for v in p.split("|")[1]] for p in patterns], int).reshape(-1, 4)
    kinds = np.array([KINDS.index(p.split("|")[0]) for p in patterns], int)
    prior = np.full(len(KINDS), 0.5)
    reliability = np.tile(np.array([[0.5, 0.3, 0.2], [0.1, 0.3, 0.6]]), (4, 1, 1))
    truth = np.full(len(patterns), 0.5)
    for _ in range(rounds if patterns else 0):
        yes, no = np.log(prior[kinds]), np.log(1 - prior[kinds])
        for j in range(4):
            yes = yes + np.log(reliability[j, 1, votes[:, j]])
            no = no + np.log(reliability[j, 0, votes[:, j]])
        truth = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
        for k in range(len(KINDS)):  # one imagined span of each kind and vote keeps every estimate inside (0, 1)
            of = kinds == k
            prior[k] = ((n * truth)[of].sum() + 1) / (n[of].sum() + 2)
        for j in range(4):
            for v in range(3):
                of = votes[:, j] == v
                reliability[j, 1, v] = (n * truth)[of].sum() + 1
                reliability[j, 0, v] = (n * (1 - truth))[of].sum() + 1
            reliability[j] /= reliability[j].sum(axis=1, keepdims=True)
    w = np.zeros(_encode("email|0000|0ss").size)
    x = np.array([_encode(p) for p in patterns]).reshape(len(patterns), w.size)
    share = n / n.sum() if patterns else n
    for _ in range(steps if patterns else 0):  # Newton steps would need a solver for no gain: the problem is tiny
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= 2.0 * (x.T @ (share * (p - truth)) + 1e-4 * w)
    return SpanModel({k: float(prior[i]) for i, k in enumerate(KINDS)}, reliability, w)


def pattern_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(pattern, n): how often each vote-and-feature pattern occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(c.pattern for c in candidates(text or ""))
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    return docs.select(text_col).mapInArrow(count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text") -> SpanModel:
    return fit({r["pattern"]: r["n"] for r in pattern_counts(docs, text_col).collect()})


def _accepted(text: str, model: SpanModel, known: dict[str, bool]) -> list[Candidate]:
    kept = []
    for c in candidates(text):
        if not c.base:
            if c.pattern not in known:
                known[c.pattern] = model.accepts(c.pattern)
            if not known[c.pattern]:
                continue
        kept.append(c)
    return sorted(kept, key=lambda c: (KINDS.index(c.kind), c.start))


def find_spans(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans: array<struct<kind, start, end, base>>) for every row, by kind and start; positions in code points."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int,base:boolean>>"
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            spans = [[{"kind": c.kind, "start": c.start, "end": c.end, "base": c.base} for c in _accepted(t or "", model, known)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, item)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(find, schema)


def redact(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets; null stays null, all columns stay."""
    at = docs.columns.index(text_col)

    def clean(text: str | None, known: dict[str, bool]) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for c in sorted(_accepted(text, model, known), key=lambda c: (c.start, -c.end)):
            if c.end <= done:
                continue
            out += [text[done : max(done, c.start)], f"[{c.kind.upper()}]"]
            done = c.end
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            new = pa.array([clean(t, known) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def span_digests(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the strict spans, their digest, and all spans as one string."""
    found = find_spans(docs, model, id_col, text_col)
    line = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(id_col, *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def reference_digest(text: str | None) -> str:
    """The strict spans by the plain patterns, for tests on short texts."""
    text = text or ""
    spans = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append(("ip", m.start(), m.end()))
    for kind, pattern, least, most in (("card", r"[0-9]([\x20-]?[0-9])+", 16, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                spans.append((kind, m.start(), m.end()))
    return hashlib.sha256(joined(spans).encode()).hexdigest()
