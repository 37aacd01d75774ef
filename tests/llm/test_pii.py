"""Personal data: strict spans against the patterns as stated, labelers and classifier on planted cases."""

import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import _awkward

from splatloom.llm import pii

SF = "/root/testdata/sf0.001"


def _plain(t):
    """The strict spans by the stated patterns, leftmost and non-overlapping for each kind."""
    t = t or ""
    digits = lambda v: re.sub("[^0-9]", "", v)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


AWKWARD = [
    "a@b.c_d@e.f x@y @z.w a@@b.c a.@b..c me@x-.y-z.com", "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 001.002.003.0255 1..2.3.4 9999999999.1.1.1 1.1.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 0000000000000",
    "+1 (555) 555-0100. +49 30 901820 ++44 20 7946 0958-- +1 2 +123456789012345678 +(1) 5", "é@b.c \U0001f600 +33 1 23 45 67 89 \x00 a@b.c\n@", "+1 (826) 555-4081 190.137.2.1 and 0.0.0.0", "4" * 200 + " " + "4 " * 60, ".@a.b -+%@1.2.3.4",
]


def test_strict_spans_equal_the_stated_patterns():
    r = np.random.default_rng(4)
    texts = AWKWARD + ["".join(r.choice(list("ab01 .-@+()19_%"), 60)) for _ in range(4000)] + ["".join(r.choice(list("0123456789 .-+"), 80)) for _ in range(2000)]
    for t in texts:
        assert pii.strict_spans(t) == _plain(t), t


def test_scan_on_awkward_tables(spark):
    docs = _awkward(spark).union(spark.createDataFrame([(400 + i, t, None, None, 1, 1, 1, "", 1, "") for i, t in enumerate(AWKWARD)], _awkward(spark).schema))
    model = pii.train(docs)
    got = pii.scan(docs, model).collect()
    want = []
    for r in docs.collect():
        base = _plain(r["text"])
        want.append((r["doc_id"], *(sum(k == x for _, k, _ in base) for x in range(4)), hashlib.sha256(pii._listed(base).encode()).hexdigest()))
        listed = [x for x in pii._listed(base).split(",") if x]
        assert all(x in y["spans"].split(",") for y in got if y["doc_id"] == r["doc_id"] and y["doc_id"] not in (None, 105) for x in listed)
    assert sorted((tuple(r[:6]) for r in got), key=str) == sorted(want, key=str)
    again = pii.train(docs.repartition(7).orderBy(F.rand(3)))
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.rates, again.rates)
    safe = pii.redacted(docs, model)
    assert safe.columns == docs.columns and safe.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in safe.collect()}
    assert texts[100] is None and texts[101] == "" and texts[406].startswith("4")
    assert texts[400].startswith("[EMAIL][EMAIL] x@y")


def test_empty_tables_and_text_ids(spark):
    empty = spark.createDataFrame([], "doc_id string, text string, spans int")
    model = pii.train(empty)
    assert pii.scan(empty, model).count() == 0 and not model.weights.any()
    some = spark.createDataFrame([("x", "write to a@b.com, John Smith"), ("y", "John Smith"), ("z", None)], "doc_id string, text string")
    assert {r["doc_id"]: r["spans"] for r in pii.scan(some, model).collect()} == {"x": "email:9:16", "y": "", "z": ""}


def test_reliabilities_are_recovered():
    """Votes drawn from known reliabilities, without labels."""
    r = np.random.default_rng(1)
    n = 40_000
    truth = r.random(n) < 0.4
    right = np.array([[0.95, 0.9], [0.999, 0.9], [0.7, 0.95], [0.85, 0.6], [0.9, 0.9], [0.6, 0.8], [0.75, 0.75], [0.8, 0.85]])
    hit = r.random((n, 8)) < np.where(truth[:, None], right[:, 0], right[:, 1])
    votes = np.where(hit == truth[:, None], 1, 2) * (r.random((n, 8)) < 0.7)
    votes[:, pii.PATTERN] = 0
    rates, share = pii.estimate(np.full(n, pii.CARD), votes, np.ones(n))
    found = rates[pii.CARD]
    assert abs(share[pii.CARD] - 0.4) < 0.02
    for j in range(2, 8):
        assert abs(found[j, 1, 1] / (found[j, 1, 1] + found[j, 1, 2]) - right[j, 0]) < 0.04 and abs(found[j, 0, 2] / (found[j, 0, 1] + found[j, 0, 2]) - right[j, 1]) < 0.04
    assert ((pii.posterior(np.full(n, pii.CARD), votes, rates, share) > 0.5) == truth).mean() > 0.95


@pytest.fixture(scope="module")
def planted(spark):
    r = np.random.default_rng(9)
    base = [x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    good = [lambda: f"please call (0{d(2)}) 555-{d(4)}", lambda: f"my phone is 0{d(3)} {d(3)}-{d(4)}", lambda: f"mail to user{d(2)} [at] mail{d(1)} [dot] com", lambda: f"contact user{d(2)} at host dot org", lambda: f"her name is Maria and Dr. {r.choice(['Weber', 'Lopez', 'Stone'])} called"]
    bad = [lambda: f"invoice order 1234 {d(3)}-{d(4)} {d(4)} 12", lambda: f"serial id {4 * 10**15 + int(d(14)) * 10 + 3}"]
    rows = []
    for i, t in enumerate(base):
        words = t.split(" ")
        put = [good[i % len(good)](), f"write to u{i}@mail.example.com or +1 (212) 555-{d(4)}"] if i % 3 else [bad[i % 2]()]
        rows.append((i, " ".join(words[:20] + put + words[20:]), i % 3 != 0))
    return spark.createDataFrame(rows, "doc_id long, text string, good boolean")


def test_loose_spans_are_added_and_others_left_alone(planted):
    model = pii.train(planted)
    got = {r["doc_id"]: r for r in pii.scan(planted, model).collect()}
    want = {r["doc_id"]: r["good"] for r in planted.collect()}
    added = {i: r["n_added"] for i, r in got.items()}
    assert np.mean([added[i] >= 1 for i, g in want.items() if g]) > 0.9
    assert np.mean([added[i] == 0 for i, g in want.items() if not g]) > 0.9
    for r in got.values():
        spans = sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in r["spans"].split(",") if x))
        assert len(set(spans)) == len(spans)


@pytest.mark.parametrize("unit", ["a", "1", "1.", "1 ", "(1", "@", "a@", "+1", "é", "A1B2 ", "1:2:", "Dr. ", "a at b dot "])
def test_time_grows_with_the_text(unit):
    start = time.perf_counter()
    pii.strict_spans(unit * (1_000_000 // len(unit)))
    pii._proposals(unit * (100_000 // len(unit)))
    assert time.perf_counter() - start < 20
