import math
import random
import zlib
from functools import lru_cache

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import language_id
from tests.llm.conftest import clashing

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
WORDS = {"en": "the of and that with from house water people morning", "de": "der die und nicht haus wasser leute morgen straße über", "fr": "le la les dans maison eau gens matin être où", "es": "el los que casa agua gente mañana está año porque"}


def model():
    return language_id.fit(language_id.pieces(VOCABULARY), {k: dict.fromkeys(v.split(), 3) for k, v in WORDS.items()})


def test_forward_sums_all_segmentations():
    m = model()
    number = {p: i + 2 for i, p in enumerate(m.vocabulary)}

    def brute(word, j):
        w = language_id.START + word

        @lru_cache(None)
        def f(i):
            if i == len(w):
                return 1.0
            total = 0.0
            for e in range(i + 1, len(w) + 1):
                if w[i:e] in number:
                    total += m.prob[number[w[i:e]], j] * f(e)
                elif e == i + 1:
                    total += m.prob[language_id.STRANGE_PIECE, j] * f(e)
            return total

        return math.log(max(f(0), 1e-300))

    words = ["the", "morning", "straße", "日本", "x", "qqqqqq", "mañanas"]
    got = m.log_words(words)
    for i, w in enumerate(words):
        for j in range(len(m.langs)):
            assert got[i][j] == pytest.approx(brute(w, j))


def test_expected_uses_sum_to_the_counts():
    trie = language_id.Trie(["▁", "▁a", "a", "b", "ab", "▁ab"])
    import numpy as np

    lattice = language_id.Lattice(["ab", "aab"], trie)
    p = np.array([0, 1e-9, 0.1, 0.2, 0.3, 0.2, 0.1, 0.1])
    uses = lattice.expected(p, np.array([5.0, 2.0]))
    length = {2: 1, 3: 2, 4: 1, 5: 1, 6: 2, 7: 3}
    assert sum(uses[i] * n for i, n in length.items()) == pytest.approx(5 * 3 + 2 * 4)


def test_held_out_accuracy(docs_of):
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(WORDS[lang].split(), k=30)), lang) for i, lang in enumerate(sorted(WORDS) * 40)]
    got = language_id.identify(clashing(docs_of(*rows)), VOCABULARY).collect()
    assert len(got) == len(rows)
    for g in got:
        assert g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2)
        assert 0 <= g.score <= 1
    held = [g for g in got if g.held_out]
    assert len(held) > 20 and all(g.lang_pred == rows[g.doc_id][2] for g in held)


def test_lang_of_held_out_is_not_learned(docs_of):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    rest = [i for i in range(60) if i not in ids]
    rows = [(i, WORDS["en"], "zz") for i in ids] + [(i, WORDS["en"], "en") for i in rest]
    assert {g.lang_pred for g in language_id.identify(docs_of(*rows), VOCABULARY).collect()} == {"en"}


def test_edges(docs_of):
    rows = [(0, WORDS["en"], "en"), (1, WORDS["de"], "de"), (3, None, "en"), (4, "", "en"), (5, "123 !? 45", "en"), (None, WORDS["de"], None), (7, "x" * 500, "en"), (8, "straße " * 3000, None), (8, "straße " * 3000, None)]
    got = [(g.doc_id, g.held_out, g.lang_pred, g.score) for g in language_id.identify(docs_of(*rows), VOCABULARY).collect()]
    assert [g[2:] for g in got if g[0] in (3, 4, 5)] == [("und", 0.0)] * 3
    assert [g for g in got if g[0] is None][0][1:3] == (False, "de") and [g[2] for g in got if g[0] == 8] == ["de", "de"]
    assert language_id.identify(docs_of((1, "a")).where("false"), VOCABULARY).collect() == []
    assert language_id.identify(docs_of((1, "abc", None)), VOCABULARY).first().lang_pred == "und"


def test_letters():
    assert language_id.words_of("½ ② 5 Ⅷ x² _ 9th don't ÉTÉ日本") == ["x", "th", "don", "t", "été日本"]
    assert language_id.words_of("½ ② 5") == [] and language_id.words_of("a" * 50) == ["a" * 24, "a" * 24, "aa"]


def test_no_letter_is_undecided(docs_of):
    rows = [(0, WORDS["en"], "en"), (1, WORDS["de"], "de"), (3, "½ ② 5", "en"), (4, "½ the ②", None)]
    got = {g.doc_id: (g.lang_pred, g.score) for g in language_id.identify(docs_of(*rows), VOCABULARY).collect()}
    assert got[3] == ("und", 0.0) and got[4][0] == "en"


def brute_segments(word, number):
    """All ways to cut a marked word into pieces, or single letters that are none."""
    if not word:
        yield ()
    for e in range(1, len(word) + 1):
        piece = number.get(word[:e], language_id.STRANGE_PIECE if e == 1 else None)
        if piece is not None:
            for rest in brute_segments(word[e:], number):
                yield (piece, *rest)


def test_whole_query_against_brute_force(docs_of):
    r = random.Random(8)
    vocabulary = language_id.pieces(VOCABULARY)
    number, size = {p: i + 2 for i, p in enumerate(vocabulary)}, len(vocabulary) + 2
    letters = {"aa": "abcd", "bb": "cdef", "cc": "efga日"}
    words = lambda lang: " ".join("".join(r.choices(letters[lang], k=r.randint(1, 5))) for _ in range(r.randint(1, 9)))
    rows = [(i, words(lang), lang) for i, lang in enumerate(list(letters) * 12)]
    rows += [(100, rows[0][1], "aa"), (101, "", "bb"), (102, None, "cc"), (103, "12 ½", "aa"), (104, words("bb"), None)]  # a copy counts once
    texts = {lang: {t for d, t, own in rows if own == lang and t and any(map(str.isalpha, t)) and zlib.crc32(str(d).encode()) % 4 != 2} for lang in letters}
    prob = {}
    for lang in letters:
        counts = {}
        for t in texts[lang]:
            for w in t.split():
                if w.isalpha():
                    counts[w] = counts.get(w, 0) + 1
        p = dict.fromkeys(range(size), 1 / size)
        for _ in range(3):
            uses = {}
            for w, n in counts.items():
                ways = list(brute_segments(language_id.START + w, number))
                weights = [math.prod(p[x] for x in way) for way in ways]
                for way, weight in zip(ways, weights, strict=True):
                    for x in way:
                        uses[x] = uses.get(x, 0) + n * weight / sum(weights)
            uses.pop(language_id.STRANGE_PIECE, None)
            p = {x: (1 - language_id.UNSEEN) * uses.get(x, 0) / sum(uses.values()) + language_id.UNSEEN / size for x in range(size)}
            p[language_id.STRANGE_PIECE] = language_id.STRANGE
        prob[lang] = p
    got = language_id.identify(docs_of(*rows), VOCABULARY).collect()
    assert len(got) == len(rows)
    for g in got:
        own = [w for w in ({d: t for d, t, _ in rows}[g.doc_id] or "").split() if w.isalpha()]
        assert g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2)
        if not own:
            assert (g.lang_pred, g.score) == ("und", 0.0)
            continue
        logs = {lang: sum(math.log(sum(math.prod(p[x] for x in way) for way in brute_segments(language_id.START + w, number))) for w in own) for lang, p in prob.items()}
        best = max(logs, key=logs.get)
        assert g.lang_pred == best and g.score == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()), rel=1e-6)


def test_sample_is_of_different_texts(docs_of, spark):
    rows = [(i, "same words again", "aa") for i in range(3000)] + [(5000 + i, f"word{'x' * (i % 9)} {'y' * (i // 9)}", "aa") for i in range(60)] + [(9000, "one text alone", "bb")]
    counts = language_id.labelled_words(docs_of(*rows), F.lit(True), 30)
    assert counts["bb"] == {"one": 1, "text": 1, "alone": 1}
    assert counts["aa"].get("same", 0) <= 1 and 10 < sum(n for w, n in counts["aa"].items() if w.startswith("word")) < 55
    assert set(language_id.labelled_words(docs_of(*rows), F.lit(True), 30, most_languages=1)) == {"aa"}


def test_small_caches(monkeypatch):
    monkeypatch.setattr(language_id, "GROUP_WORDS", 4)
    m = model()
    want = list(model().predict([" ".join(v.split()[:9]) for v in WORDS.values()]))
    import numpy as np

    m.scores = np.zeros((5, len(m.langs)))
    got = list(m.predict([" ".join(v.split()[:9]) for v in WORDS.values()]))
    assert [g[0] for g in got] == [w[0] for w in want] == list(WORDS)
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want])
