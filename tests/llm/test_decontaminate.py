import random

import pytest

from chronoweave.llm import decontaminate as d
from tests.llm.conftest import clashing

R = random.Random(1)
VOCABULARY = ["".join(R.choices("abcdefghij", k=R.randint(3, 8))) for _ in range(2000)]


def prose(r, n):
    return " ".join(r.choices(VOCABULARY, k=n))


QUESTION = "If a train leaves with 12 passengers at 40 km per hour and Anna waits 12 minutes for it, how far does Anna walk before the next station?"


def bench(spark, *texts):
    return spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "item_id long, text string, doc_id int")


def pairs(df):
    return sorted((r.doc_id, r.item_id) for r in df.collect())


def test_passages(docs_of, spark):
    r = random.Random(2)
    items = [prose(r, n) for n in (40, 25, 12)] + [None, "", "too short here", QUESTION]
    clean = [prose(r, 300) for _ in range(20)]
    leaky = [f"{prose(r, 50)} {items[0]} {prose(r, 9)}", f"{items[1].title()}\n{prose(r, 30)}", f"{prose(r, 5)}. {items[2].upper()}", f"{prose(r, 40)}\n{' '.join(items[0].split()[5:30])}"]
    documents = docs_of(*clean, *leaky, (500, None), (501, ""), (None, items[0]), (20, leaky[0]))
    got = pairs(d.leaks(clashing(documents), bench(spark, *items)).where("doc_id is not null"))
    assert got == [(20, 0), (21, 1), (22, 2), (23, 0)]
    kept = d.clean_documents(documents, bench(spark, *items))
    ids = sorted(x.doc_id for x in kept.collect())  # the row without an id goes, the second row of 20 as well
    assert ids == [*range(20), 500, 501] and kept.columns == documents.columns


def swap(text, **values):
    for a, b in values.items():
        text = text.replace({"number": "12", "name": "Anna", "unit": "km", "speed": "40"}[a], b)
    return text


@pytest.mark.parametrize(("text", "found"), [
    (QUESTION, True),
    (swap(QUESTION, number="97", name="Bertram", unit="miles", speed="55"), True),
    (swap(QUESTION, number="1,500.5"), True),
    (QUESTION.replace("12 minutes", "13 minutes"), True),  # its slots contradict each other, but fifteen words are those of the item
    (QUESTION.replace("12 p", "55 p").replace("12 m", "99 m"), False),
    (QUESTION.replace("Anna waits", "Bert waits"), True),  # so are those after the name
    (QUESTION.replace("Anna waits", "Bert waits").replace("40 km", "50 km").replace("for it", "for us"), False),
    (" ".join(reversed(QUESTION.split())), False),
])
def test_reparameterised(docs_of, spark, text, found):
    r = random.Random(3)
    documents = docs_of(f"{prose(r, 60)}. {text} {prose(r, 60)}", prose(r, 100))
    assert pairs(d.leaks(documents, bench(spark, QUESTION))) == ([(0, 0)] if found else [])


def test_slots_must_agree(docs_of, spark):
    item = "Take 7 apples then give 7 apples to 9 friends now"
    same, mixed = "Take 5 apples then give 5 apples to 3 friends now", "Take 5 apples then give 6 apples to 3 friends now"
    merged = "Take 5 apples then give 5 apples to 5 friends now"
    got = d.leaks(docs_of(same, mixed, merged), bench(spark, item), window=10)
    assert pairs(got) == [(0, 0)] and got.first().n_slots == 3


def test_tokens():
    word = lambda w: d.token(w)[1]
    assert word("12") & d.NUMBER and word("$3.50") & d.NUMBER and word("7kg") & d.NUMBER and not word("7abcd") & d.NUMBER
    assert word("km") & d.UNIT and word("Anna") & d.CAPITAL and not word("ANNA") & d.CAPITAL and word("end.") & d.STOP
    assert d.token("Word,")[0] == d.token("word")[0] != d.token("words")[0]


def test_blocks_and_repeats(docs_of, spark):
    r = random.Random(4)
    items = [prose(r, 30) for _ in range(12)]
    documents = docs_of(*[f"{prose(r, 20)} {t} {prose(r, 20)}" for t in items])
    table = bench(spark, *items, items[3])
    want = [(i, i) for i in range(12)]
    assert pairs(d.leaks(documents, table)) == want == pairs(d.leaks(documents, table, to_all=0))
    assert d.leaks(documents, table.where("false")).collect() == [] and d.leaks(documents.where("false"), table).collect() == []
    whole = d.leaks(documents, table).where("doc_id = 3").first()
    assert (whole.n_tokens, whole.doc_start, whole.item_start) == (30, 20, 0)


def test_long_repetitive_text(docs_of, spark):
    text = "same words again and again in this line " * 3000
    item = "same words again and again in this line same words"
    got = d.leaks(docs_of(text), bench(spark, item)).collect()
    assert len(got) == 1 and got[0].n_tokens == 10


def test_items_without_id_and_slot_heavy_ones(docs_of, spark):
    nameless, numbers, short = "seven wise men of the east came by night to town", "1815 1848 1871 1914 1918 1933 1939 1945 1949", "Who wrote the Aeneid Pub"
    table = spark.createDataFrame([(None, nameless), (4, numbers), (5, short), (6, "too few words")], "item_id long, text string")
    documents = docs_of(f"some words first {nameless} and more", f"years: {numbers} end", f"so I asked who Wrote the aeneid pub yesterday", "nothing of 1815 1848 1871 1914", "too few words")
    got = sorted(((r.doc_id, r.item_id, r.n_tokens) for r in d.leaks(documents, table).collect()), key=str)
    assert got == [(0, None, 11), (1, 4, 9), (2, 5, 5)]
    assert sorted(r.doc_id for r in d.clean_documents(documents, table).collect()) == [3, 4]


UNIT_WORDS = ["km", "hours", "dollars"]


def canonical(text):
    """(type, word) of each word of a text of plain words, whole numbers, units and names."""
    out, words = [], text.split()
    for i, w in enumerate(words):
        bare = w.rstrip(".")
        if bare.isdigit():
            kind = "number"
        elif bare in UNIT_WORDS:
            kind = "unit" if i and words[i - 1].isdigit() else ""
        elif bare[0].isupper() and i and not words[i - 1].endswith("."):
            kind = "name"
        else:
            kind = ""
        out.append((kind, bare.lower()))
    return out


def brute(doc, item, window=8, verbatim=13, least=5):
    """Tokens matched on each diagonal, the most of all."""
    a, b = canonical(item), canonical(doc)
    best = 0
    if len(a) < least:
        return 0
    for shift in range(-len(a), len(b)):
        hit, plain = set(), set()
        for n, same, own in ((min(window, len(a)), lambda x, y: x[0] == y[0] and (x[0] or x[1] == y[1]), hit), (min(verbatim, len(a)), lambda x, y: x[1] == y[1], plain)):
            for p in range(len(a) - n + 1):
                if p + shift >= 0 and p + shift + n <= len(b) and all(same(a[p + i], b[p + shift + i]) for i in range(n)):
                    if own is plain or 2 * sum(not a[p + i][0] for i in range(n)) >= n:
                        own |= set(range(p, p + n))
        slots = [(a[p], b[p + shift]) for p in hit if a[p][0]]
        if all((x == u) == (y == v) or x[0] != u[0] for x, y in slots for u, v in slots):
            plain |= hit
        best = max(best, len(plain))
    return best


@pytest.mark.parametrize("to_all", [0, d.ROWS_TO_ALL])
def test_against_brute_force(docs_of, spark, to_all):
    r = random.Random(12)

    def sentence(n):
        return [r.choice([r.choice(VOCABULARY[:60]), r.choice(VOCABULARY[:60]), r.choice(VOCABULARY[:60]), str(r.randrange(3)), r.choice(UNIT_WORDS), r.choice(["Anna", "Bert", "Cid"])]) for _ in range(n)]

    items = [sentence(r.choice([4, 5, 7, 9, 20, 30])) for _ in range(25)]
    documents = [" ".join(sentence(40)) for _ in range(5)]
    for item in items * 5:
        other = list(item)
        for _ in range(r.choice([0, 1, 1, 2, 4])):  # other words, names and numbers, here and there or everywhere
            at = r.randrange(len(other))
            new = r.choice(sentence(8))
            other = [new if x == other[at] else x for x in other] if r.random() < 0.6 else other[:at] + [new] + other[at + 1 :]
        start = r.randrange(max(1, len(other) - 10))
        documents.append(" ".join([*sentence(r.randrange(12)), *other[start : start + r.choice([8, 13, 40])], *sentence(r.randrange(12))]))
    texts = [" ".join(x) for x in items]
    got = {(x.doc_id, x.item_id): x.n_tokens for x in d.leaks(docs_of(*documents), bench(spark, *texts), to_all=to_all).collect()}
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    want = {(k, first[t]): n for k, doc in enumerate(documents) for t in texts if (n := brute(doc, t))}
    assert got == want and 20 < len(want) < 0.9 * len(documents) * len(texts)
