import hashlib
import random

import numpy as np
import pytest

from chronoweave.llm import suffix_dedup
from tests.llm.conftest import clashing


def brute(texts, length=100):
    """(n_bytes, n_removed, n_spans, kept) of each text in order."""
    seen, out = set(), []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), len(t) - len(kept), spans, kept))
    return out


def texts_of(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("ab c") for _ in range(300)) for _ in range(3)]
    out = []
    for _ in range(40):
        parts = []
        for _ in range(r.randint(0, 4)):
            q, a = r.choice(base), r.randint(0, 200)
            parts.append(q[a : a + r.randint(20, 250)])
        out.append("".join(parts))
    return [*out, "a" * 500, "ab" * 300, "é" * 120, out[3], "", "x" * 99, "y" * 100, "y" * 100, "\0" * 150]


@pytest.mark.parametrize(("seed", "hot", "frequent", "salts"), [(0, 20_000, 100_000, 64), (1, 3, 100_000, 64), (2, 1, 2, 3), (3, 20_000, 2, 64), (4, 20_000, 20, 1)])
def test_against_brute_force(docs_of, seed, hot, frequent, salts):
    texts = texts_of(seed)
    got = {r.doc_id: r for r in suffix_dedup.dedup(docs_of(*texts), hot=hot, keep_bytes=True, frequent=frequent, salts=salts).collect()}
    for i, (n, removed, spans, kept) in enumerate(brute([t.encode() for t in texts])):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.kept_sha256) == (n, removed, spans, kept, hashlib.sha256(kept).hexdigest())
        assert sum(s.end - s.start for s in r.spans) == removed


def test_edges(docs_of):
    x, y = "q" * 60 + "z" * 60, "k" * 130
    rows = [(5, x), (2, x), (2, x), (None, y), (None, "m" + y), (9, None), (9, ""), (7, y)]
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(clashing(docs_of(*rows))).collect())
    # equal rows are one document, so neither loses its bytes; rows without an id come last
    assert [g for g in got if g[0] == 2] == [(2, 120, 0)] * 2
    assert [g for g in got if g[0] == 5] == [(5, 120, 120)]
    assert [g for g in got if g[0] == 9] == [(9, 0, 0)] * 2
    # in a run of one letter, all but the first byte is covered by a later window
    assert [g for g in got if g[0] == 7] == [(7, 130, 129)] and sorted(g[2] for g in got if g[0] == 99) == [130, 130]
    assert suffix_dedup.dedup(docs_of((1, "x")).where("false")).collect() == []


def test_frequent_anchors_are_dealt_out(docs_of):
    passage = "".join(random.Random(7).choices("abcdefgh ", k=400))
    texts = [f"{i} {passage} {'x' * (i % 7)}" for i in range(200)]
    rows = docs_of(*texts).selectExpr("doc_id as doc", "0L as sub", "cast(text as binary) as text")
    often = suffix_dedup.frequent_anchors(rows, 90_000, 100, suffix_dedup.TEXT_CHUNK, 150)
    assert 3 < len(often) < 30
    key, doc = np.repeat(often[:1], 500), np.arange(500)
    blocks = suffix_dedup.salted_bucket(key, doc, np.zeros(500, np.uint64), 1000, often, 64)
    assert 32 < len(set(blocks.tolist())) <= 64 and len(set(suffix_dedup.salted_bucket(key, doc, np.zeros(500, np.uint64), 1000, often[1:], 64).tolist())) == 1
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup(docs_of(*texts), frequent=150, salts=8).collect()}
    assert [got[i] for i in range(200)] == [b[1] for b in brute([t.encode() for t in texts])]


def test_ids_at_the_ends_of_the_range(docs_of):
    most, x = 2**63 - 1, "q" * 150
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup(docs_of((most, x), (1, x))).collect()}
    assert got == {most: 150, 1: 149}
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup(docs_of((most, x), (None, x), (1, "short"))).collect()}
    assert got == {most: 149, None: 150, 1: 0}


def test_long_text_in_pieces(docs_of):
    r = random.Random(5)
    t = "".join(r.choice("abcdef ") for _ in range(3000))
    text = t + t[500:900] + t[:150]
    for chunk in (700, 1500, 1 << 20):
        got = suffix_dedup.dedup(docs_of(text), keep_bytes=True, chunk=chunk).first()
        assert bytes(got.kept) == brute([text.encode()])[0][3]


def test_equal_prefix_groups():
    r = np.random.default_rng(1)
    t = r.integers(0, 3, 5000).astype(np.uint8)
    t[3000:3400] = t[100:500]
    sa, group = suffix_dedup.equal_prefix_groups(t, 100)
    cyclic = np.concatenate([t, t[:100]]).tobytes()
    of = {}
    for s, g in zip(sa.tolist(), group.tolist(), strict=True):
        assert of.setdefault(g, cyclic[s : s + 100]) == cyclic[s : s + 100]
    assert len(of) == len({cyclic[s : s + 100] for s in range(5000)})


def test_anchors_do_not_depend_on_what_is_around(monkeypatch):
    # hashes that agree in all but their lowest bits: the first place decides, in long buffers as in short ones
    monkeypatch.setattr(suffix_dedup, "gram_hashes", lambda t, k: t[: len(t) - k + 1].astype(np.uint64) % np.uint64(7) << np.uint64(12))
    r = np.random.default_rng(4)
    window = r.integers(0, 256, 100).astype(np.uint8)
    found = set()
    for before, after in ((0, 0), (3000, 0), (50, 200_000), (70_000, 70_000)):
        t = np.concatenate([r.integers(0, 256, before), window, r.integers(0, 256, after)]).astype(np.uint8)
        _, first, count, off, key = suffix_dedup.anchors(t, np.array([len(t)]), 100)
        of = int(np.searchsorted(first, before, "right")) - 1
        found.add((int(off[of] + first[of] - before), int(key[of])))
    assert len(found) == 1


def test_anchors_are_shared_by_equal_windows():
    r = np.random.default_rng(2)
    w = r.integers(97, 100, 160).astype(np.uint8)
    a = np.concatenate([r.integers(97, 100, 77).astype(np.uint8), w])
    keys = []
    for t, skip in ((a, 77), (w, 0)):
        _, first, count, _, key = suffix_dedup.anchors(t, np.array([len(t)]), 100)
        own = np.repeat(key, count)
        assert np.array_equal(np.repeat(first, count) + np.concatenate([np.arange(c) for c in count]), np.arange(len(t) - 99))
        keys.append(own[skip : skip + 61])
    assert np.array_equal(*keys)
