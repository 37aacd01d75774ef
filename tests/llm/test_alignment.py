"""Token alignment against a plain version that tests all pairs of tokens, and against the tokenizers' own library."""

import collections
import hashlib
import itertools

import numpy as np
import pytest
from test_operators import _awkward

from splatloom.llm import alignment

SF = "/root/testdata/sf0.001"


def _spans(ids, table):
    ends = list(itertools.accumulate(len(table[i]) for i in ids))
    return list(zip([0, *ends], ends, ids, strict=False))


def _plain(rows):
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(alignment.TOKENIZER_A)
    first.encode_special_tokens = True
    (_, table_a), (second, table_b) = alignment.byte_level(alignment.TOKENIZER_A), alignment.pieces(alignment.TOKENIZER_B)
    docs = []
    for doc, t in rows:
        a = first.encode(" " + t, add_special_tokens=False).ids if t else []
        b = second([t])[0] if t else []
        raw = (" " + (t or "")).encode()
        if not t or b"".join(table_a[i] for i in a) != raw or b"".join(table_b[i] for i in b) != raw:
            docs.append((doc, 0, 0, 0, [], ""))
            continue
        x, y = _spans(a, table_a), _spans(b, table_b)
        links, at = [], 0
        for s, e, i in x:
            while y[at][1] <= s:
                at += 1
            k = at
            while k < len(y) and y[k][0] < e:
                links.append((i, y[k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        of = lambda spans: [[str(i) for s, e, i in spans if low < e <= high] for low, high in zip([0, *cuts], cuts, strict=False)] if len(cuts) < 3000 else None  # noqa: E731, B023
        ga, gb = of(x), of(y)
        listing = ";".join(f"{','.join(p)}|{','.join(q)}" for p, q in zip(ga, gb, strict=True)) if ga is not None else None
        docs.append((doc, len(a), len(b), len(cuts), links, hashlib.sha256(listing.encode()).hexdigest() if listing else None))
    n = collections.Counter(p for *_, links, _ in docs for p in set(links))
    most = collections.Counter()
    for (a, _), c in n.items():
        most[a] = max(most[a], c)
    return [(d, x, y, g, len(links), sum(n[p] == most[p[0]] for p in links), sum(n[p] for p in links), h) for d, x, y, g, links, h in docs]


@pytest.mark.parametrize("heavy", [0, 300, 1 << 18])
def test_alignment_equals_a_plain_version(spark, monkeypatch, heavy):
    monkeypatch.setattr(alignment, "HEAVY", heavy)
    monkeypatch.setattr(alignment, "HELD", 500)
    extra = [(300, "<|endoftext|> and <s> </s> <unk> <0x41>"), (301, "a ▁ b"), (302, "   x　"), (303, "① é \U0001f600\r\n\x00"), (304, "<|endoftext|>")]
    docs = _awkward(spark).where("length(text) < 5000 or doc_id = 103 or text is null").select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).repartition(5)
    want = {}
    for w in _plain([(r["doc_id"], r["text"]) for r in docs.collect()]):
        want.setdefault(w[:7], []).append(w[7])
    got = [tuple(r) for r in alignment.align(docs).collect()]
    assert len(got) == docs.count() and sorted(map(str, (g[:7] for g in got))) == sorted(str(k) for k, v in want.items() for _ in v)
    for g in got:
        assert want[g[:7]][0] in (None, g[7])
    assert {g[0]: g[1] for g in got}[301] == 0


def test_alignment_of_empty_tables_and_text_ids(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id string, text string, row int, pair int, n int, links string")).count() == 0
    got = alignment.align(spark.createDataFrame([("x", "one two"), (None, None)], "doc_id string, text string")).collect()
    assert sorted((r["doc_id"] or "", r["n_a"] > 0) for r in got) == [("", False), ("x", True)]


def test_ranks_give_the_ids_of_the_file():
    """Merges as ranks, against the library that the file is made for: all code points, in several surroundings."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(alignment.TOKENIZER_A)
    whole.encode_special_tokens = True
    encode, _ = alignment.byte_level(alignment.TOKENIZER_A)
    for low in range(0, 0x110000, 0x4000):
        some = [c for c in range(low, low + 0x4000, 1 if low < 0x30000 else 7) if not 0xD800 <= c < 0xE000]
        texts = [f" a{chr(c)}a 1{chr(c)}1 {chr(c)}{chr(c)}.{chr(c)}" for c in some]
        assert [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)] == encode(texts)


def test_groups_and_links_of_any_intervals():
    r = np.random.default_rng(2)
    for _ in range(50):
        n, m = r.integers(1, 9, 2)
        a, b = np.sort(r.choice(30, 2 * n, replace=False)).reshape(-1, 2), np.sort(r.choice(30, 2 * m, replace=False)).reshape(-1, 2)
        x, y = alignment.overlapping(a[:, 0], a[:, 1], b[:, 0], b[:, 1])
        assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == [(i, j) for i in range(n) for j in range(m) if a[i, 0] < b[j, 1] and b[j, 0] < a[i, 1]]
        both = np.vstack([a, b])
        order, group = alignment.coalesced(both[:, 0], both[:, 1], np.repeat([0, 1], [n, m]))
        assert group[-1] + 1 >= 1 and len(order) == n + m
        for k in range(group[-1]):
            assert both[order[group == k], 1].max() <= both[order[group == k + 1], 0].min()


def test_packing():
    for values in ([], [0], [1, 300, 1 << 40], list(range(1000))):
        data = alignment.packed(np.array(values, np.int64)) + b"rest"
        got, at = alignment.unpacked(data)
        assert got.tolist() == values and data[at:] == b"rest"
