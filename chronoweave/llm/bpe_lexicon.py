"""Byte-level BPE encoding through a minimal acyclic transducer of frequent words, and decoding.

The words that the corpus itself uses most (counted over all documents, `lexicon_words` of them, a fixed bound) are
compiled with their token ids into one automaton: common prefixes and common suffixes are shared, and each arc adds a
number so that the sum along a word is the word's place in the id table. Its arrays are memory-mapped by the workers.
A word that it lacks is merged exactly, pair by pair, as the vocabulary's merge list says; so the lexicon only decides
the speed, never the ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm._common import LongTable, batch_of, prepare, trimmed

#: Below this code point, the pattern's letter and number classes are the same in every Unicode version in use.
SETTLED_END = 0x558
SETTLED = re.compile(f"[^\x00-{chr(SETTLED_END - 1)}]")
RARE_WORDS = 400_000
GROUP_WORDS = 200_000
#: Longer words are merged one by one.
SHORT_WORD = 32
NEVER = 1 << 40
FREQUENT = r" ?\p{L}+"


def byte_letters() -> dict[int, str]:
    """The vocabulary file's letter for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def settled_pattern() -> re.Pattern:
    """The vocabulary's split of a text into words, for texts of settled characters only, with its classes spelled out."""
    chars = [chr(i) for i in range(SETTLED_END)]
    of = {name: "".join(re.escape(c) for c in chars if regex.match(p, c)) for name, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))}
    letter, number, space = of["L"], of["N"], of["S"]
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Pairs:
    """Ranks of pairs of ids, for arrays."""

    def __init__(self, rank: dict[tuple[int, int], tuple[int, int]]):
        self.made = np.zeros(len(rank) + 1, np.int64)
        for r, made in rank.values():
            self.made[r] = made
        self.table = LongTable([a << 32 | b for a, b in rank], [r for r, _ in rank.values()], NEVER)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """NEVER for pairs that don't merge; ids below 0 are none."""
        return self.table.get(np.where((a < 0) | (b < 0), -2, a << 32 | b))


class Merges:
    """The vocabulary: exact merging of one word, ids to bytes, and the split of a text into words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.numbers = list(range(len(self.bytes_of)))
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.single = [vocab[letters[b]] for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.pairs = Pairs(self.rank)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = settled_pattern()
        self.path = path
        self._library = None

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Merge the pair of least rank, the leftmost first, until none is left."""
        return self.merge_all([word])[0]

    def merge_all(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """merge() of many words: those of about a length side by side, one merge of each a round."""
        out: list = [()] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for low, width in pairwise((0, 6, 9, 13, 20, SHORT_WORD)):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            for s in range(0, len(rows), 1 << 15):
                part = rows[s : s + (1 << 15)]
                for i, ids in zip(part.tolist(), self._merge_short([words[i] for i in part.tolist()], sizes[part], width), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(sizes > SHORT_WORD).tolist():
            out[i] = self._merge_long([self.single[b] for b in words[i]])
        return out

    def _merge_short(self, words: list[bytes], sizes: np.ndarray, width: int) -> list[tuple[int, ...]]:
        n, column = len(words), np.arange(width)
        ids = np.full((n, width), -1, np.int64)
        ids[column < sizes[:, None]] = np.array(self.single)[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((n, width), NEVER, np.int64)
        rank[:, :-1] = self.pairs.rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(n)
        own, ranks = ids, rank
        while len(live):
            at = ranks.argmin(axis=1)
            row = np.arange(len(live))
            best = ranks[row, at]
            go = best < NEVER
            if not go.all():
                ids[live[~go]] = own[~go]
                live, own, ranks, at, best = live[go], own[go], ranks[go], at[go], best[go]
                row = np.arange(len(live))
            shift = column + (column > at[:, None])
            shift[shift == width] = width - 1
            own, ranks = np.take_along_axis(own, shift, 1), np.take_along_axis(ranks, shift, 1)
            own[:, -1], ranks[:, -1] = -1, NEVER
            own[row, at] = self.pairs.made[best]
            left = np.maximum(at - 1, 0)
            ranks[row, left] = self.pairs.rank(own[row, left], own[row, np.minimum(left + 1, width - 1)])
            right = np.minimum(at + 1, width - 1)
            ranks[row, at] = np.where(right > at, self.pairs.rank(own[row, at], own[row, right]), NEVER)
        return [tuple(r[: k]) for r, k in zip(ids.tolist(), (ids >= 0).sum(axis=1).tolist(), strict=True)]

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a queue, for words of any length."""
        n, rank = len(ids), self.rank
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue = [(rank[p][0], i, p) for i, p in enumerate(pairwise(ids)) if p in rank]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if j < 0 or ids[i] != pair[0] or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = rank[pair][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := (ids[a], ids[b])) in rank:
                    heapq.heappush(queue, (rank[p][0], a, p))
        return tuple(i for i in ids if i >= 0)

    def words(self, text: str) -> list[str]:
        if SETTLED.search(text):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens in order; a special token is told from a word by its string."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.words(text)
        return list(chain.from_iterable([x] if x in self.special else self.words(x) for x in self.cut.split(text) if x))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


# --- the transducer


def compile_lexicon(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The automaton of the words with their ids, as one block of bytes. Words may come in any order."""
    entries = sorted(dict(entries).items())
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []  # of each finished state: (final, (label, target), ...)
    path: list[list] = [[False, []]]  # the states along the last word: final, arcs

    def close(keep: int) -> None:
        while len(path) > keep + 1:
            final, out = path.pop()
            state = (final, *out)
            if state not in register:
                register[state] = len(arcs)
                arcs.append(state)
            path[-1][1][-1] = (path[-1][1][-1], register[state])

    last = b""
    for word, _ in entries:
        common = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))  # noqa: B905
        close(common)
        for b in word[common:]:
            path[-1][1].append(b)
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    final, out = path[0]
    arcs.append((final, *out))
    below: list[int] = []  # words from each state on
    key, target, add = [], [], []
    for s, (final, *out) in enumerate(arcs):
        n = int(final)
        for label, to in out:
            key.append(s << 8 | label)
            target.append(to)
            add.append(n)
            n += below[to]
        below.append(n)
    offsets = np.cumsum([0, *(len(i) for _, i in entries)])
    arrays = [
        np.array(key, np.int64), np.array(target, np.int64), np.array(add, np.int64), np.array([a[0] for a in arcs], np.int64),
        offsets.astype(np.int64), np.array(list(chain.from_iterable(i for _, i in entries)), np.int64),
    ]
    return np.array([max((len(w) for w, _ in entries), default=0), *map(len, arrays)], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon over any buffer; in workers, over a memory-mapped file."""

    def __init__(self, buffer):
        head = np.frombuffer(buffer, np.int64, 7)
        self.longest, at, arrays = int(head[0]), 56, []
        for n in head[1:].tolist():
            arrays.append(np.frombuffer(buffer, np.int64, n, at))
            at += 8 * n
        self.key, self.target, self.add, self.final, self.offsets, self.ids = arrays

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """Over a file of this process that is gone when the process ends."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the id table, -1 for words that it lacks: all words walk the automaton together."""
        place = np.full(len(words), -1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero(sizes <= self.longest)
        if not len(live):
            return place
        text = np.frombuffer(b"".join([words[i] for i in live.tolist()]), np.uint8)
        size = sizes[live]
        start = np.cumsum(size) - size
        state, total = np.full(len(live), len(self.final) - 1), np.zeros(len(live), np.int64)
        for step in range(self.longest + 1):
            done = size == step
            hit = done & (self.final[state] == 1)
            place[live[hit]] = total[hit]
            go = ~done
            live, size, start, state, total = live[go], size[go], start[go], state[go], total[go]
            if not len(live) or not len(self.key):
                break
            want = state << 8 | text[start + step]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[at] == want
            live, size, start, at, total = live[ok], size[ok], start[ok], at[ok], total[ok]
            state, total = self.target[at], total + self.add[at]
        return place


_mapped: dict[str, Lexicon] = {}


def lexicon_of(name: str, data) -> Lexicon:
    if name not in _mapped:
        _mapped.clear()
        _mapped[name] = Lexicon.mapped(data.value)
    return _mapped[name]


class Encoder:
    def __init__(self, vocabulary: Merges, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.known: dict[str, tuple[int, ...]] = {s: (i,) for s, i in vocabulary.special.items()}
        self.rare: list[str] = []

    def learn(self, words: set[str]) -> None:
        """Make the ids of words known. Words of the lexicon stay known; merged ones are forgotten if there would be too many."""
        new = words.difference(self.known)
        if not new:
            return
        if len(self.rare) + len(new) > RARE_WORDS:
            for w in self.rare:
                del self.known[w]
            self.rare = []
            new = words.difference(self.known)
        ordered = list(new)
        raw = [w.encode() for w in ordered]
        places = self.lexicon.find(raw)
        unseen = np.flatnonzero(places < 0).tolist()
        merged = self.vocabulary.merge_all([raw[i] for i in unseen])
        shared = self.vocabulary.numbers.__getitem__  # one object for each id: what encoding touches stays in the caches
        self.rare += [ordered[i] for i in unseen]
        self.known |= {ordered[i]: tuple(map(shared, ids)) for i, ids in zip(unseen, merged, strict=True)}
        hits = np.flatnonzero(places >= 0)
        offsets, ids = self.lexicon.offsets, self.lexicon.ids
        starts, ends = offsets[places[hits]].tolist(), offsets[places[hits] + 1].tolist()
        for i, a, b in zip(hits.tolist(), starts, ends, strict=True):
            self.known[ordered[i]] = tuple(map(shared, ids[a:b].tolist()))

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text. Words are looked up for some texts at a time, or for parts of a very long one."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(self.vocabulary.pieces(text))
            size += len(group[-1])
            if size >= GROUP_WORDS:
                yield from self._flush(group)
                group, size = [], 0
        yield from self._flush(group)

    def _flush(self, group: list[list[str]]) -> Iterator[list[int]]:
        if len(group) > 1:
            self.learn(set(chain.from_iterable(group)))
        for words in group:
            ids: list[int] = []
            for at in range(0, len(words), GROUP_WORDS):
                part = words[at : at + GROUP_WORDS]
                if len(group) == 1:
                    self.learn(set(part))
                ids.extend(chain.from_iterable(map(self.known.__getitem__, part)))
            yield ids


def frequent_words(docs: DataFrame, limit: int) -> list[str]:
    """At most `limit` of the most frequent words of all documents.

    Counts are dealt into levels (eight to a doubling); whole levels are taken from the top as long as they fit, so
    that no task sends more than its part of them.
    """
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(FREQUENT), F.lit(0))).alias("w"))
    counted = words.groupBy("w").agg(F.floor(F.log2(F.count("*")) * 8).alias("level"))
    sizes = counted.groupBy("level").agg(F.count("*").alias("n"))
    within = sizes.withColumn("sum", F.sum("n").over(Window.orderBy(F.desc("level")))).where(F.col("sum") <= limit)
    least = within.agg(F.coalesce(F.min("level"), F.lit(1 << 20)).alias("least"))
    return [r[0] for r in counted.where(F.col("level") >= least.scalar()).select("w").collect()]


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def encode_documents(docs: DataFrame, vocabulary: str, lexicon_words: int = 200_000, keep: bool = False) -> DataFrame:
    """Encode every text of docs (doc_id, text, any other columns) and decode the ids again.

    vocabulary: path of a byte-level BPE tokenizer file, as installed on every node. Special tokens written in a
    text get their own id, as the tokenizers library does. Returns one row per row of docs: doc_id, n_tokens,
    ids_sha256 (of decimal ids joined by commas), decoded_sha256, and if keep is set ids and decoded (else null).
    A null text is empty: no tokens. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    model = merges(vocabulary)
    frequent = [w.encode() for w in frequent_words(docs, lexicon_words)]
    data = compile_lexicon(zip(frequent, model.merge_all(frequent), strict=True))
    name, sent = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(vocabulary)
        encoder = Encoder(model, lexicon_of(name, sent))
        for b in batches:
            ids_of, texts, rows, size = b.column(0).to_pylist(), b.column(1).to_pylist(), [], 0
            for doc, ids in zip(ids_of, encoder.encode([t or "" for t in texts]), strict=True):
                decoded = model.decode(ids)
                digest = hashlib.sha256(",".join(map(model.text_of.__getitem__, ids)).encode()).hexdigest()
                rows.append((doc, len(ids), digest, hashlib.sha256(decoded.encode()).hexdigest(), ids if keep else None, decoded if keep else None))
                size += len(ids) if keep else 0
                if size > 1 << 20:
                    yield batch_of(DIGESTS, *zip(*rows, strict=True))
                    rows, size = [], 0
            if rows:
                yield batch_of(DIGESTS, *zip(*rows, strict=True))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string")
