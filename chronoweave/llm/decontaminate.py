"""Benchmark decontamination by template canonicalisation.

Texts become sequences of tokens in which numbers, units after numbers and names (capitalised words within a
sentence) are typed placeholders, so that a question with other parameters has the same template. Windows of
`window` template tokens of the benchmark are hash-joined with those of the documents; a window needs at least half
of its tokens to be literal. Joined windows on one diagonal are laid together, and the match counts only if all their
slots agree: the same benchmark value always stands for the same document value of its type, and the other way round.
Beside the templates go windows of `verbatim` tokens as they are written (but for case), which need no slots to agree.

Documents are read once. A Bloom filter of the benchmark's window hashes, of a bounded size, goes to every task, and
only windows that pass it are shuffled: to the benchmark's windows of the same hash, and then by document, item and
diagonal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm._common import batch_of, checkpoint, joined_by, prepare, runs_of, trimmed
from chronoweave.llm.suffix_dedup import mixed

NUMBER, UNIT, CAPITAL, STOP = 1, 2, 4, 8
SLOTS = {NUMBER: 0x6E756D, UNIT: 0x756E6974, CAPITAL: 0x6E616D65}
# Units of measure and money, as written after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t oz lb lbs gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds ml cl l gal liter liters litre litres gallon gallons "
    "ms s sec secs min mins h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "% percent percents degree degrees $ € £ usd eur gbp dollar dollars euro euros cent cents".split()
)
NUMERIC = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*([%$€£]|[a-z]{1,3})?")
EDGE = "\"'“”‘’«»()[]{}<>,;:.!?…*#&|%$"
KNOWN_WORDS = 200_000


def token(word: str) -> tuple[bytes, int]:
    """The literal's hash (eight bytes) and the flags of one word between white space."""
    body = word[:-1] if word[-1] in ",.;:!?" else word
    if body.isalpha():  # most words: the same as below, in fewer steps
        low = body.lower()
        flags = UNIT if low in UNITS else CAPITAL if body[0].isupper() and body[1:].islower() else 0
        return xxhash.xxh64_digest(low), flags | (STOP if word[-1] in ".!?:" else 0)
    bare = word.strip(EDGE)
    flags = STOP if word.rstrip("\"'”’»)")[-1:] in (".", "!", "?", ":", "…") else 0
    core = bare.lower() or word
    m = NUMERIC.fullmatch(word.rstrip(".,;:!?").lower())
    if m and (not m[1] or m[1] in UNITS):
        flags |= NUMBER
    elif core in UNITS or word in UNITS:
        flags |= UNIT
    elif bare[:1].isupper() and bare[1:].islower():
        flags |= CAPITAL
    return xxhash.xxh64_digest(core), flags


class Tokens:
    """Words to literals and flags, remembered by word."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.literal = np.zeros(KNOWN_WORDS + 1, np.uint64)
        self.flags = np.zeros(KNOWN_WORDS + 1, np.uint8)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for s in range(0, len(words), KNOWN_WORDS):
            part = words[s : s + KNOWN_WORDS]
            at = np.fromiter(map(self.at.get, part, repeat(-1)), np.int64, len(part))
            new = np.flatnonzero(at < 0)
            if len(new):
                own = [part[i] for i in new.tolist()]
                missing = set(own)
                if len(self.at) + len(missing) > KNOWN_WORDS:
                    self.at.clear()
                    new, own, missing = np.arange(len(part)), part, set(part)
                first, end = len(self.at), len(self.at) + len(missing)
                found = list(map(token, missing))
                self.literal[first:end] = np.frombuffer(b"".join([h for h, _ in found]), "<u8")
                self.flags[first:end] = np.frombuffer(bytes([f for _, f in found]), np.uint8)
                self.at.update(zip(missing, range(first, end), strict=True))
                at[new] = np.fromiter(map(self.at.__getitem__, own), np.int64, len(own))
            out.append((self.literal[at], self.flags[at]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint8))


def line_starts(lines: list[list[str]]) -> np.ndarray:
    """Which words of the lines, laid end to end, are the first of theirs."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    first = np.zeros(int(sizes.sum()), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return first


_known: list[Tokens] = []


def known_tokens() -> Tokens:
    """The words that this process knows, from one task to the next."""
    if not _known:
        _known.append(Tokens())
    return _known[0]


def template(literal: np.ndarray, flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Template codes and slot types (0: literal) of texts laid end to end; first marks the first token of each line."""
    before = np.concatenate([[0], flags[:-1]]).astype(np.uint8)
    before[first] = STOP
    kind = np.where(flags & NUMBER, NUMBER, 0)
    kind = np.where((flags & UNIT != 0) & (before & NUMBER != 0), UNIT, kind)
    kind = np.where((flags & CAPITAL != 0) & (before & STOP == 0), CAPITAL, kind).astype(np.uint8)
    code = literal
    for k, v in SLOTS.items():
        code = np.where(kind == k, np.uint64(v), code)
    return code, kind


def window_hashes(code: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n template codes in a row."""
    h, base = np.zeros(max(0, len(code) - n + 1), np.uint64), np.uint64(0x9E3779B97F4A7C15)
    code = mixed(code)
    for i in range(n):
        h = h * base + code[i : i + len(h)]
    return mixed(h + np.uint64(n))


TEMPLATE, VERBATIM = 0, 1
WINDOWS = "h long, kind int, n int, key long, item_id long, place long, literal binary, slots binary"
FOUND = "h long, kind int, n int, doc_id long, sub long, place long, literal binary"
FOUND_SCHEMA = pa.schema([("h", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("doc_id", pa.int64()), ("sub", pa.int64()), ("place", pa.int64()), ("literal", pa.binary())])
WINDOWS_SCHEMA = pa.schema([("h", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("item_id", pa.int64()), ("place", pa.int64()), ("literal", pa.binary()), ("slots", pa.binary())])
LEAK = "doc_id long, sub long, item_id long, n_tokens long, n_slots long, doc_start long, item_start long"
LEAK_SCHEMA = pa.schema([("doc_id", pa.int64()), ("sub", pa.int64()), ("item_id", pa.int64()), ("n_tokens", pa.int64()), ("n_slots", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64())])
#: Bits of the filter: some for each window, within bounds.
BITS_A_WINDOW, LEAST_BITS, MOST_BITS = 256, 20, 29
#: The filter is put together in pieces of so many bits.
PIECE_BITS = 18
#: Windows (some 300 bytes each), and ids of documents, that may be sent to every task.
ROWS_TO_ALL, IDS_TO_ALL = 1 << 17, 1 << 21


def kinds_of(n_tokens: int, window: int, verbatim: int) -> list[tuple[int, int]]:
    """The windows (kind, length) that an item of so many tokens is cut into."""
    return [(TEMPLATE, min(window, n_tokens)), (VERBATIM, min(verbatim, n_tokens))]


def hashes_of(kind: int, n: int, code: np.ndarray, literal: np.ndarray) -> np.ndarray:
    return window_hashes(code if kind == TEMPLATE else literal ^ np.uint64(0x5DEECE66D), n)


class Filter:
    """A Bloom filter of two bits a hash; `bits` is the logarithm of its size."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    @staticmethod
    def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)

    def passing(self, h: np.ndarray) -> np.ndarray:
        """Where hashes are that may be in it."""
        at = np.arange(len(h))
        for n in (0, 1):
            place = self.places(h[at], self.bits)[n]
            at = at[(self.data[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
        return at


def filter_of(windows: DataFrame, n: int) -> Filter:
    """Tasks make pieces of the filter from windows (h), pieces are merged by Spark, and the driver gets the whole: 64 MB at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_A_WINDOW * n).bit_length()))
    size = 1 << min(PIECE_BITS, bits)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            place = np.unique(np.concatenate(Filter.places(b.column(0).to_numpy().view(np.uint64), bits)))
            for part in np.split(place, np.flatnonzero(np.diff(place // size)) + 1) if len(place) else []:
                data = own.setdefault(int(part[0]) // size, np.zeros(size // 8, np.uint8))
                np.bitwise_or.at(data, part % size >> 3, np.uint8(1) << (part & 7).astype(np.uint8))
        for piece, data in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([data.tobytes()])], names=["piece", "data"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, "piece"):
            data = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("data").to_pylist()])
            yield pa.RecordBatch.from_arrays([t.column("piece").combine_chunks().slice(0, 1), pa.array([data.tobytes()])], names=["piece", "data"])

    made = windows.select("h").mapInArrow(trimmed(pieces), "piece long, data binary")
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for piece, data in made.repartition("piece").sortWithinPartitions("piece").mapInArrow(trimmed(merged), "piece long, data binary").collect():
        whole[piece * size // 8 : (piece + 1) * size // 8] = np.frombuffer(data, np.uint8)
    return Filter(bits, whole)


def benchmark_windows(benchmark: DataFrame, window: int, verbatim: int, least: int) -> DataFrame:
    """All windows of all items: hash, kind, length, the item's key (of its text) and id, place, literals and slots of its tokens."""
    items = benchmark.where("text is not null").groupBy("text").agg(F.min("item_id").cast("long").alias("item_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = known_tokens()
        for b in batches:
            rows = []
            for text, key, item in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                lines = [line.split() for line in text.split("\n")]
                words = [w for line in lines for w in line]
                if len(words) < least:
                    continue
                literal, flags = tokens.of(words)
                code, slot = template(literal, flags, line_starts(lines))
                for kind, n in kinds_of(len(words), window, verbatim):
                    h = hashes_of(kind, n, code, literal).view(np.int64)
                    solid = np.convolve(slot == 0, np.ones(n, int), "valid")
                    for at in np.flatnonzero(2 * solid >= n).tolist() if kind == TEMPLATE else range(len(h)):
                        rows.append((int(h[at]), kind, n, key, item, at, literal[at : at + n].tobytes(), slot[at : at + n].tobytes()))
            if rows:
                yield batch_of(WINDOWS_SCHEMA, *zip(*rows, strict=True))

    return items.select("text", F.xxhash64("text").alias("key"), "item_id").mapInArrow(trimmed(run), WINDOWS)


def consistent(a: np.ndarray, b: np.ndarray, kinds: np.ndarray) -> bool:
    """Whether slot values a and b map one to one, type by type."""
    there: dict[tuple, int] = {}
    back: dict[tuple, int] = {}
    for x, y, k in zip(a.tolist(), b.tolist(), kinds.tolist(), strict=True):
        if k and (there.setdefault((k, x), y) != y or back.setdefault((k, y), x) != x):
            return False
    return True


def judged(windows: list[tuple[int, int, int, bytes, bytes, bytes]]) -> tuple[int, int, int] | None:
    """(tokens matched, slots among them, first place in the item) of a diagonal's windows (kind, n, place in the item, the item's
    literals, slots, the document's literals); None if they don't match.

    All template windows count if all their slots agree with each other; else only those do that are equal as they are written.
    """
    tokens: dict[int, tuple[int, int, int]] = {}
    plain: dict[int, tuple[int, int, int]] = {}
    for kind, n, place, item, slots, doc in windows:
        x, y, s = np.frombuffer(item, "<u8"), np.frombuffer(doc, "<u8"), np.frombuffer(slots, np.uint8)
        if not ((x == y) | ((s != 0) & (kind == TEMPLATE))).all():
            continue  # equal hashes of unequal windows
        own = plain if kind == VERBATIM else tokens
        for i in range(n):
            own[place + i] = (int(x[i]), int(y[i]), int(s[i]))
    if tokens:
        x, y, s = (np.array(c, np.uint64) for c in zip(*tokens.values(), strict=True))
        if consistent(x, y, s):
            plain |= tokens
    if not plain:
        return None
    return len(plain), sum(s != 0 for _, _, s in plain.values()), min(plain)


def row_key(text: Column) -> Column:
    """Tells rows of the same doc_id apart."""
    return F.xxhash64(text)


def row_leaks(docs: DataFrame, benchmark: DataFrame, window: int, verbatim: int, least: int, to_all: int) -> DataFrame:
    """A row per row of docs (doc_id, sub: by its text), item and matching diagonal."""
    prepare(docs.sparkSession)
    bench = checkpoint(benchmark_windows(benchmark, window, verbatim, least))
    lengths = sorted((r["kind"], r["n"]) for r in bench.select("kind", "n").distinct().collect())  # few: of no window is longer than these options
    total = bench.count()
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(bench, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, tokens = sent.value, known_tokens()
        for b in batches:
            texts = [[line.split() for line in (t or "").split("\n")] for t in b.column(2).to_pylist()]
            sizes = np.array([sum(map(len, t)) for t in texts], np.int64)
            ends = np.cumsum(sizes)
            lines = [line for t in texts for line in t]
            words = [w for line in lines for w in line]
            if not words:
                continue
            literal, flags = tokens.of(words)
            code, _ = template(literal, flags, line_starts(lines))
            ids, subs = b.column(0), b.column(1).to_numpy()
            for kind, n in lengths:
                h = hashes_of(kind, n, code, literal)
                at = sieve.passing(h)
                doc = np.searchsorted(ends, at, "right")
                inside = at + n <= ends[doc]
                at, doc = at[inside], doc[inside]
                for s in range(0, len(at), 1 << 14):
                    a, d = at[s : s + (1 << 14)], doc[s : s + (1 << 14)]
                    spans = [literal[x : x + n].tobytes() for x in a.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(h[a].view(np.int64)), pa.array(np.full(len(a), kind, np.int32)), pa.array(np.full(len(a), n, np.int32)), ids.take(pa.array(d)), pa.array(subs[d]), pa.array(a - (ends[d] - sizes[d])), pa.array(spans, pa.binary())], schema=FOUND_SCHEMA)

    text = F.col("text")
    passed = checkpoint(docs.select(F.col("doc_id").cast("long"), row_key(text), text).mapInArrow(trimmed(run), FOUND))
    sent.unpersist()
    passed = passed.withColumnRenamed("n", "length")
    known = bench.withColumnsRenamed({"kind": "item_kind", "n": "item_n", "place": "item_place", "literal": "item_literal"})
    if total <= to_all:
        both = passed.join(F.broadcast(known), "h")
    else:
        both = joined_by(passed, known.join(passed.groupBy("h").agg(F.count("*").alias("n")), "h"), "h", passed.count())
    both = both.where("kind = item_kind and length = item_n")
    met = both.select("doc_id", "sub", "key", (F.col("place") - F.col("item_place")).alias("shift"), "item_id", "kind", "length", "item_place", "item_literal", "slots", "literal")

    def diagonals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, "task", "sub", "key", "shift"):
            out = {}
            for doc, sub, shift, item, *w in zip(*(t.column(c).to_pylist() for c in ("doc_id", "sub", "shift", "item_id", "kind", "length", "item_place", "item_literal", "slots", "literal")), strict=True):
                out.setdefault((doc, sub, shift, item), []).append(tuple(w))
            rows = [(doc, sub, item, *hit[:2], shift + hit[2], hit[2]) for (doc, sub, shift, item), w in out.items() if (hit := judged(w))]
            if rows:
                yield batch_of(LEAK_SCHEMA, *zip(*rows, strict=True))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    task = F.xxhash64("doc_id", "sub", "key", "shift")
    dealt = met.withColumn("task", task).repartitionById(parts, F.pmod("task", F.lit(parts)).cast("int")).sortWithinPartitions("task", "sub", "key", "shift")
    return dealt.mapInArrow(trimmed(diagonals), LEAK)


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 8, verbatim: int = 13, least: int = 5, to_all: int = ROWS_TO_ALL) -> DataFrame:
    """Which documents of docs (doc_id, text, ...) hold a passage of which item of benchmark (item_id, text, ...).

    Returns a row per document and item: doc_id, item_id, n_tokens (tokens matched on the longest diagonal), n_slots
    (typed slots among them), doc_start and item_start (its first token in either). Items shorter than a window match as a
    whole, those shorter than `least` never. Equal benchmark texts are one item, that of the smallest item_id; items
    without an id count as others do, and their rows have a null item_id. Rows of docs that repeat a doc_id are matched
    one by one and give one row, the longest match; so do rows without doc_id. Null and empty texts match nothing; an empty
    table gives an empty result. A benchmark of up to `to_all` windows goes to every task, a larger one is shuffled.
    """
    found = row_leaks(docs, benchmark, window, verbatim, least, to_all)
    best = F.max(F.struct("n_tokens", "n_slots", "doc_start", "item_start")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 8, verbatim: int = 13, least: int = 5, to_all: int = ROWS_TO_ALL) -> DataFrame:
    """The rows of docs without a passage of the benchmark, all columns as they are. Each row is judged by its own text, with or without an id of its own."""
    gone = checkpoint(row_leaks(docs, benchmark, window, verbatim, least, to_all).select(F.col("doc_id").alias("_leaked"), F.col("sub").alias("_by_text")).distinct())
    if gone.count() <= IDS_TO_ALL:  # then the texts aren't shuffled
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_leaked")) & (row_key(F.col("text")) == F.col("_by_text")), "left_anti").select(*docs.columns)
