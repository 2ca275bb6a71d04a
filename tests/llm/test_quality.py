import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import quality_divergence as q
from tests.llm.conftest import clashing


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, cover = Counter(runs), set()
    for i, x in enumerate(runs):
        if seen[x] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), n < 50 or 100 * len(cover) > 50 * n)


def prose(r, lang, n=200):
    common = [w for w in q.COMMON[lang] if w not in q.MARKS]
    return " ".join(r.choice(common) if r.random() < 0.5 else "".join(r.choice("abdeilnorst") for _ in range(r.randint(3, 9))) for _ in range(n))


def rows_of(seed):
    r = random.Random(seed)
    out = [(i, prose(r, lang, r.randint(60, 300)), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 6)]
    repeated = "alpha beta gamma delta " * 40
    odd = [
        (100, None, "en"), (101, "", "en"), (102, "   \n\t ", "en"), (103, "a b", "en"), (104, "a b c", "en"), (105, repeated, "en"), (106, "x\ny\nx\n \nx", "en"), (107, "### $$$ a|b <c> 100% &*", "fr"),
        (108, "one\x0btwo\x0cthree\r\nfour\xa0five", "en"), (109, prose(r, "en"), None), (110, prose(r, "de"), "xx"), (111, "a a a a a b a a a", "en"), (112, "日本語 テキスト " * 60, "en"), (113, " ".join("#$%&*|" for _ in range(100)), "en"),
        (114, " ".join(str(i) for i in range(120)) + " 1 2 3", "en"), (None, prose(r, "en"), "en"), (115, "ends with spaces  ", "en"),
    ]
    return out + odd


@pytest.mark.parametrize("seed", [1, 2])
def test_base_counts(docs_of, seed):
    rows = rows_of(seed)
    got = {r.doc_id: r for r in q.judge(clashing(docs_of(*rows))).collect()}
    assert len(got) == len(rows)
    for doc, text, _ in rows:
        r = got[doc]
        assert (*[r[c] for c in q.COUNTS], r.base_failed) == base(text), doc
        assert not (r.base_failed and r.kept)


def test_counts_where_hashes_clash(docs_of, monkeypatch):
    for n in (1, 3, 1 << 20):
        monkeypatch.setattr(q, "WINDOW_HASH", lambda a, b, c, n=n: F.pmod(F.xxhash64(a, b, c), F.lit(n)))  # part of the plan
        rows = [r for r in rows_of(2) if r[0] is not None]
        got = {r.doc_id: r for r in q.judge(docs_of(*rows)).collect()}
        for doc, text, _ in rows:
            assert got[doc].n_repeat_words == base(text)[4], doc


def divergence(p, ref):
    n = sum(p)
    total = 0.0
    for c, x in zip(p, ref, strict=True):
        a = c / n if n else 0.0
        m = (a + x) / 2
        total += (a * math.log2(a / m) if a else 0) + (x * math.log2(x / m) if x else 0)
    return math.sqrt(max(total, 0) / 2)


def test_verdicts(docs_of):
    rows = rows_of(3)
    got = {r.doc_id: r for r in q.judge(docs_of(*rows)).collect()}
    assert all(got[i].kept for i in range(24))
    assert not got[112].kept and not got[113].kept and got[109].reference == "en"
    assert got[110].reference is None and got[110].kept  # a language without a list of common words: the base rules decide

    def words(t, lang):
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t)]
        own = [w.count(c) for c in q.COMMON[lang]]
        return [*own, len(w) - sum(own)]

    good = [t for _, t, lang in rows if lang == "en" and not base(t)[5]]
    sums = [sum(c) for c in zip(*(words(t, "en") for t in good), strict=True)]
    ref = [s / sum(sums) for s in sums]
    for doc, text, lang in rows:
        if lang == "en" and text and text.strip():
            assert got[doc].word_distance == pytest.approx(divergence(words(text, "en"), ref)), doc


def test_filter_and_empty(docs_of):
    rows = rows_of(4)
    documents = docs_of(*rows)
    kept = q.keep_good(documents)
    assert kept.columns == documents.columns
    want = {r.doc_id for r in q.judge(documents).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == want
    assert q.judge(documents.where("false")).collect() == [] and q.keep_good(documents.where("false")).collect() == []
    alone = q.judge(docs_of((1, "wort " * 10), (2, " ".join(f"w{i}" for i in range(60)), None))).collect()
    assert {r.doc_id: r.kept for r in alone} == {1: False, 2: True}  # no reference at all: base rules decide


def test_no_python_in_the_plan(docs_of):
    plan = q.judge(docs_of((1, "x y z")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_against_sql(docs_of):
    import duckdb

    documents = docs_of(*[r for r in rows_of(5) if r[0] is not None])
    c = duckdb.connect()
    c.register("documents", documents.toPandas())
    want = c.sql(q.oracle()).df().sort_values("doc_id").reset_index(drop=True)
    got = q.judge(documents).toPandas().sort_values("doc_id").reset_index(drop=True)[list(want.columns)]
    assert got.to_dict("list") == want.to_dict("list")
