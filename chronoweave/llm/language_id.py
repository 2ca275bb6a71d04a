"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over
all its segmentations into pieces, by the forward algorithm; a text's is the product over its words, and the
prediction is the language of the largest posterior. The piece probabilities are fitted by expectation maximisation
(forward-backward) on words counted over a sample of labelled documents.

The sample is bounded: about `sample_docs` different texts a language, those of least hash and at least one, whole texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm._common import LongTable, batch_of, prepare, trimmed

#: The vocabulary's mark for the start of a word.
START = "▁"
#: Runs of letters and of number signs such as ½ and ②, which words_of() tells apart.
WORDS = re.compile(r"[^\W\d_]+")
#: Longer runs of letters are cut here: a probability is a product over the word.
LONGEST_WORD = 24
#: Pieces are numbered from 2 on; 1 is any single letter that the vocabulary lacks.
STRANGE_PIECE = 1
#: Share of probability spread over pieces that a language hasn't used, and of single letters outside the vocabulary.
UNSEEN = 1e-3
STRANGE = 1e-7
CHUNK_WORDS = 4096
KNOWN_WORDS = 500_000
GROUP_WORDS = 200_000
UNDECIDED = "und"
#: What a model, which every task gets, may hold.
MOST_LANGUAGES = 2000


@lru_cache(maxsize=1)
def pieces(path: str) -> list[str]:
    """The vocabulary's pieces of lower-case letters, with or without the start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [p for p in names if (body := p.removeprefix(START)) == body.lower() and (not body or body.isalpha()) and len(body) <= LONGEST_WORD]


def words_of(text: str) -> list[str]:
    out = WORDS.findall(text.lower())
    if not all(map(str.isalpha, out)):
        out = "".join(c if c.isalpha() else " " for w in out for c in (*w, " ")).split()
    return out if all(len(w) <= LONGEST_WORD for w in out) else [w[i : i + LONGEST_WORD] for w in out for i in range(0, len(w), LONGEST_WORD)]


class Trie:
    """The pieces by their letters: (state, code point) to state, and the piece that each state is, numbered from 2 on."""

    def __init__(self, vocabulary: list[str]):
        self.longest = max(map(len, vocabulary), default=1)
        states: dict[str, int] = {"": 0}
        piece = [0]
        for i, p in enumerate(vocabulary):
            for k in range(1, len(p) + 1):
                if p[:k] not in states:
                    states[p[:k]] = len(states)
                    piece.append(0)
            piece[states[p]] = i + 2
        own = [(states[p[:-1]] << 21 | ord(p[-1]), n) for p, n in states.items() if p]
        self.step = LongTable([k for k, _ in own], [n for _, n in own], -1)
        self.piece = np.array(piece, np.int32)


class Lattice:
    """The pieces at every place of many words at once: at[word, start, length - 1] is a piece's number, or 0."""

    def __init__(self, words: list[str], trie: Trie):
        marked = [START + w for w in words]
        self.sizes = np.array([len(w) for w in marked], np.int64)
        width = int(self.sizes.max())
        codes = np.full((len(marked), width), -1, np.int64)
        codes[np.arange(width) < self.sizes[:, None]] = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        self.at = np.zeros((len(marked), width, min(trie.longest, width)), np.int32)
        word, start = np.nonzero(codes >= 0)
        state = np.zeros(len(word), np.int64)
        for k in range(self.at.shape[2]):
            inside = start + k < self.sizes[word]
            word, start, state = word[inside], start[inside], state[inside]
            state = trie.step.get(state << 21 | codes[word, start + k])
            alive = state >= 0
            word, start, state = word[alive], start[alive], state[alive]
            self.at[word, start, k] = trie.piece[state]
        single = self.at[:, :, 0]
        single[(single == 0) & (codes >= 0)] = STRANGE_PIECE

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """alpha[word, place, language]: the probability of all segmentations up to the place. prob: [piece number, language]."""
        n, width, longest = self.at.shape
        alpha = np.zeros((n, width + 1, prob.shape[1]))
        alpha[:, 0] = 1
        for e in range(1, width + 1):
            for k in range(1, min(longest, e) + 1):
                p = self.at[:, e - k, k - 1]
                hit = np.flatnonzero(p)
                if len(hit):
                    alpha[hit, e] += alpha[hit, e - k] * prob[p[hit]]
        return alpha

    def expected(self, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece under one language's prob, weighted by the words' counts."""
        n, width, longest = self.at.shape
        alpha = self.forward(prob[:, None])[..., 0]
        beta = np.zeros((n, width + 1))
        beta[np.arange(n), self.sizes] = 1
        uses = np.zeros(len(prob))
        total = alpha[np.arange(n), self.sizes]
        weight = np.where(total > 0, counts / np.where(total > 0, total, 1), 0)
        for s in range(width - 1, -1, -1):
            for k in range(1, min(longest, width - s) + 1):
                p = self.at[:, s, k - 1]
                hit = np.flatnonzero(p)
                if len(hit):
                    own = prob[p[hit]] * beta[hit, s + k]
                    beta[hit, s] += own
                    np.add.at(uses, p[hit], alpha[hit, s] * own * weight[hit])
        return uses


class Model:
    def __init__(self, vocabulary: list[str], langs: list[str], prob: np.ndarray):
        self.vocabulary, self.langs, self.prob = vocabulary, langs, prob
        self.prepare()

    def prepare(self) -> None:
        self.trie = Trie(self.vocabulary)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((KNOWN_WORDS, len(self.langs)))

    def __getstate__(self):
        return self.vocabulary, self.langs, self.prob

    def __setstate__(self, state):
        self.vocabulary, self.langs, self.prob = state
        self.prepare()

    def log_words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word, by language."""
        lattice = Lattice(words, self.trie)
        alpha = lattice.forward(self.prob)
        return np.log(np.maximum(alpha[np.arange(len(words)), lattice.sizes], 1e-300))

    def learn(self, words: set[str]) -> None:
        """Make the scores of words known, forgetting others if there would be too many."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > len(self.scores):
            self.known.clear()
            new = words
            if len(new) > len(self.scores):
                self.scores = np.zeros((len(new), len(self.langs)))
        ordered = sorted(new, key=len)
        for s in range(0, len(ordered), CHUNK_WORDS):
            own = ordered[s : s + CHUNK_WORDS]
            first = len(self.known)
            self.scores[first : first + len(own)] = self.log_words(own)
            self.known |= {w: first + i for i, w in enumerate(own)}

    def log_text(self, words: list[str]) -> np.ndarray:
        """Log probability of a text's words, all of them known, by language."""
        return self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """(language, posterior) of each text. Words are scored for some texts at a time, or for parts of a very long one."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(words_of(text) if text and self.langs else [])
            size += len(group[-1])
            if size >= GROUP_WORDS:
                yield from self._flush(group)
                group, size = [], 0
        yield from self._flush(group)

    def _flush(self, group: list[list[str]]) -> Iterator[tuple[str, float]]:
        if len(group) > 1:
            self.learn(set(chain.from_iterable(group)))
        for words in group:
            if not words:
                yield UNDECIDED, 0.0
                continue
            logs = np.zeros(len(self.langs))
            for at in range(0, len(words), GROUP_WORDS):
                part = words[at : at + GROUP_WORDS]
                if len(group) == 1:
                    self.learn(set(part))
                logs += self.log_text(part)
            best = int(np.argmax(logs))
            yield self.langs[best], float(1 / np.exp(np.maximum(logs - logs[best], -700)).sum())


def fit(vocabulary: list[str], counts: dict[str, dict[str, int]], rounds: int = 3) -> Model:
    """A model of the languages of counts (language: word: count)."""
    langs = sorted(counts)
    trie, size = Trie(vocabulary), len(vocabulary) + 2
    prob = np.zeros((size, len(langs)))
    for j, lang in enumerate(langs):
        words = sorted(counts[lang], key=lambda w: (len(w), w))
        chunks = [(Lattice(own, trie), np.array([counts[lang][w] for w in own], float)) for own in (words[i : i + CHUNK_WORDS] for i in range(0, len(words), CHUNK_WORDS))]
        p = np.full(size, 1 / size)
        for _ in range(rounds):
            uses = np.zeros(size)
            for lattice, n in chunks:
                uses += lattice.expected(p, n)
            uses[:2] = 0
            p = (1 - UNSEEN) * uses / max(uses.sum(), 1e-9) + UNSEEN / size
            p[0], p[STRANGE_PIECE] = 0, STRANGE
        prob[:, j] = p
    return Model(vocabulary, langs, prob)


def labelled_words(docs: DataFrame, learn: Column, sample_docs: int, most_languages: int = MOST_LANGUAGES) -> dict[str, dict[str, int]]:
    """Word counts by language over the sample of the documents of `learn` with a lang.

    Of each language the different texts are taken whose hash is in the least share that gives about sample_docs of
    them, and the one of least hash in any case; copies count once. If there are more than most_languages, those with
    most texts are learned, and the others never predicted.
    """
    span = 1 << 30
    own = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h")).withColumn("at", F.pmod("h", F.lit(span)))
    totals = own.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"), F.min("at").alias("first")).orderBy(F.desc("n"), "lang").limit(most_languages)
    upto = totals.select("lang", F.greatest(F.col("first"), F.least(F.lit(float(span)), span * F.lit(float(sample_docs)) / F.col("n")).cast("long")).alias("upto"))
    picked = own.join(F.broadcast(upto), "lang").where("at <= upto").groupBy("lang", "h").agg(F.min("text").alias("text"))
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{1,{LONGEST_WORD}}}"), F.lit(0)))
    out: dict[str, dict[str, int]] = {}
    for lang, w, n in picked.select("lang", word.alias("w")).groupBy("lang", "w").count().collect():
        if w.isalpha():
            out.setdefault(lang, {})[w] = n
    return out


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, vocabulary: str, sample_docs: int = 400) -> DataFrame:
    """The language of each of docs (doc_id, text, lang, any other columns).

    Learns from text and lang of documents that are not held out, predicts from text alone. Returns one row per row
    of docs: doc_id, held_out, lang_pred, score (the posterior, 0 to 1). A null text or one without letters is
    `und` with score 0, as is everything if no document has a lang to learn from. Ties go to the language first in
    order. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    model = fit(pieces(vocabulary), labelled_words(docs, ~is_held_out(), sample_docs))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            found = list(model.predict(b.column(2).to_pylist()))
            if found:
                names, scores = zip(*found, strict=True)
                yield batch_of(PREDICTED, b.column(0), b.column(1), names, [s if math.isfinite(s) else 0.0 for s in scores])

    return docs.select(F.col("doc_id").cast("long"), is_held_out(), "text").mapInArrow(trimmed(run), "doc_id long, held_out boolean, lang_pred string, score double")
