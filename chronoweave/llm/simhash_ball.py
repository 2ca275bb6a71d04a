"""Near duplicates by SimHash, with candidate search by meeting in the middle between Hamming balls.

Two fingerprints within three bits of each other: of three blocks of the fingerprint, deleting one that holds a
differing bit leaves at most two differences. So every fingerprint emits, for each deleted block, all variants of the
remaining bits within radius one (half of two): 3 + 42 + 43 + 43 of them. Both of a pair emit their midpoint, and
meet there when the variants are shuffled. Colliding pairs are verified on all 64 bits. Only distinct fingerprints take
part, so copies cost nothing here, and from the pairs verified at one variant a spanning forest goes on: it links the
same documents as all pairs do. Links become components by large-star/small-star.

For a similarity (Jaccard, of shingle sets) instead of a bit distance, balls alone can't be exact: texts 0.8 alike differ
in a dozen bits. So what meets in balls is held against the shingle sets, and links most near copies. The rest is found
exactly: texts meet at their leading shingles, in an order common to all texts that puts frequent ones last. As many lead
as it takes for two texts as similar as asked to share one. What meets is held against two bounds that no like pair
exceeds (sizes, and parities of classes of shingles) and then against the sets. Where many meet at one shingle, they are
laid out in order over many tasks, neighbours are tested first, and then all that no verified pairs link so far: a pair is
only left out if it would change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm._common import batch_of, checkpoint, connected_components, dealt, forget, joined_by, pack, partitions_for, prepare, runs_of, trimmed, unpack, written
from chronoweave.llm.suffix_dedup import bucket_of, mixed, per_bucket

RADIUS = 3
#: Bit ranges of the fingerprint, of which one at a time is deleted.
BLOCKS = ((0, 21), (21, 42), (42, 64))
SEED = 42
FINGERPRINTS_A_BLOCK = 4096
ROUTED = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("blob", pa.binary())])
PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("h", pa.int64())])
EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint(text: bytes, words: int) -> int:
    """Bit by bit the majority of the shingles' hashes; 0 for a text without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes).tolist()
    ends = (ends - 1)[min(words, len(parts)) - 1 :].tolist()
    ones, step, digest = np.zeros(64, np.int64), 1 << 15, xxhash.xxh64_intdigest
    for at in range(0, len(ends), step):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + step], ends[at : at + step])], "<u8")  # noqa: B905
        ones += ones_of(h)
    return int(np.packbits(2 * ones > len(ends), bitorder="little").view("<u8")[0])


def ones_of(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(h: np.ndarray) -> int:
    """The fingerprint of these hashes."""
    ones = sum((ones_of(h[at : at + (1 << 15)]) for at in range(0, len(h), 1 << 15)), np.zeros(64, np.int64))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp, h) of each row: h is a hash of the text, as Spark's xxhash64 gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t or b"", words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], schema=PRINTS)

    return hashed(docs).mapInArrow(trimmed(run), "doc_id long, fp long, h long")


def hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def flips() -> tuple[np.ndarray, np.ndarray]:
    """For each variant, the mask of the bits that stay and the bit that is flipped."""
    keep, flip = [], []
    for low, high in BLOCKS:
        mask = ~(((1 << (high - low)) - 1) << low) & 0xFFFFFFFFFFFFFFFF
        for bit in [0, *(1 << i for i in range(64) if not low <= i < high)]:
            keep.append(mask)
            flip.append(bit)
    return np.array(keep, np.uint64), np.array(flip, np.uint64)


def variant_key(fp: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """A bijective hash of the variant, apart for each deleted block."""
    keep, flip = flips()
    of = np.unique(keep, return_inverse=True)[1].astype(np.uint64)
    return mixed(((fp & keep[nth]) ^ flip[nth]) + (of[nth] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def emit_variants(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, most = 0, 1 << 15

        def flush(fps: np.ndarray):
            n = len(flips()[0])
            fp, nth = np.repeat(fps, n), np.tile(np.arange(n, dtype=np.uint8), len(fps))
            bucket = bucket_of(variant_key(fp, nth), buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            groups = np.split(order, cuts)
            yield batch_of(ROUTED, [0] * len(groups), [int(bucket[g[0]]) for g in groups], [pack([fp[g], nth[g]]) for g in groups])

        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), most):
                held.append(fps[at : at + most])
                size += len(held[-1])
                if size >= most:
                    yield from flush(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield from flush(np.concatenate(held))

    return run


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that link what the pairs within RADIUS link, one fewer than members of each part."""
    left, out = fps, []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= RADIUS
            if near.any():
                front += (found := list(left[near]))
                out += [(x, y) for y in found]
                left = left[~near]
    return out


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(blobs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(x, [np.uint64, np.uint8])[0] for x in blobs]
        fp, nth = (np.concatenate(c) for c in zip(*parts, strict=True))
        key = variant_key(fp, nth)
        order = np.argsort(key)
        key, fp = key[order], fp[order]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(key)))
        two = first[size == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
        pairs = [np.stack([fp[two], fp[two + 1]], 1)]
        for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if edges := forest(np.unique(fp[a : a + n])):
                pairs.append(np.array(edges, np.uint64))
        uv = np.concatenate(pairs).view(np.int64)
        if len(uv):
            uv = np.unique(np.sort(uv, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], schema=EDGES)

    return per_bucket(batches, one)


# --- by similarity


@dataclass(frozen=True)
class Sizes:
    """How the search by similarity is dealt over tasks. No result depends on these."""

    #: Members of a place up to which all their pairs are tested at once.
    few: int = 8
    #: A shingle that leads this many texts, by a sample, has them sent on one by one and not through its bucket.
    hot: int = 2_000
    #: How far apart, in their order, the members of a place are tested before components are looked at again.
    near: int = 64
    #: Members in a block.
    block: int = 4_096
    #: Texts, roughly, from which frequent shingles are learned, and how many of those at most are sent to every task.
    sample: int = 4_000
    frequent: int = 200_000


#: Bits of a shingle's hash, of the 64, that sets are made of, and their bytes.
SHINGLE_BITS, SHINGLE_BYTES = 48, 6
#: Words of 64 parities for a text, at least; a power of two.
PARITIES = 8
#: Leading shingles that meet in one bucket.
LEADS_A_BUCKET = 1 << 19
#: Sets that are compared in one task, at most where shingles are evenly spread.
TILE = 256
#: Documents whose ids may be sent to every task: 8 bytes each.
IDS_TO_ALL = 1 << 21
#: Pairs whose ends may be sent to every task: 16 bytes each.
PAIRS_TO_ALL = 1 << 20
MET = pa.schema([("kind", pa.int32()), ("k", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])
PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("tu", pa.int64()), ("tv", pa.int64())])


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hashes of the text's shingles, repeats included."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    ends = (ends - 1)[min(words, len(parts)) - 1 :].tolist()
    return np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)  # noqa: B905


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The distinct ones, cut to SHINGLE_BITS and sorted."""
    return np.unique(hashes >> np.uint64(64 - SHINGLE_BITS))


def packed(shingles: np.ndarray) -> bytes:
    return np.ascontiguousarray(shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHINGLE_BYTES]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // SHINGLE_BYTES, 8), np.uint8)
    out[:, :SHINGLE_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, SHINGLE_BYTES)
    return out.view("<u8").ravel()


def content_key(text: bytes) -> int:
    """The same for texts of the same words."""
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()), SEED)


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each of as many classes of shingles as there are shingles, or more, whether their number is odd: sets differ in at least as many elements as these bits."""
    classes = max(64 * PARITIES, 1 << (len(shingles) - 1).bit_length() if len(shingles) else 1)
    return np.packbits(np.bincount((mixed(shingles) & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1, bitorder="little").view("<u8")


def folded(w: np.ndarray, size: int) -> np.ndarray:
    """Parities of fewer classes, from those of more."""
    return np.bitwise_xor.reduce(w.reshape(-1, size), axis=0)


class Frequent:
    """Shingles of several texts of a sample, sorted, with their rank by frequency and about how many texts have them."""

    def __init__(self, shingles: np.ndarray, rank: np.ndarray, texts: np.ndarray):
        self.shingles, self.rank, self.texts = shingles, rank, texts

    def find(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each is or would be, whether it is)."""
        if not len(self.shingles):
            return np.zeros(len(shingles), np.int64), np.zeros(len(shingles), bool)
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return at, self.shingles[at] == shingles


def leading(shingles: np.ndarray, similarity: float, frequent: Frequent) -> np.ndarray:
    """The first elements of a set in an order common to all sets, so many that sets as similar as asked share one.

    Of n elements at least similarity * n are shared, so among the first n - that + 1 is one of them, and the first of
    those that two sets share is so in both. The order is: those not frequent, then by rank.
    """
    n = len(shingles)
    if not n:
        return shingles
    at, known = frequent.find(shingles)
    if known.any():
        shingles = shingles[np.argsort(np.where(known, frequent.rank[at] + 1, 0), kind="stable")]
    return shingles[: min(n, n - math.ceil(similarity * n - 1e-6) + 1)]


def frequent_shingles(docs: DataFrame, texts: int, words: int, sizes: Sizes) -> Frequent:
    """Learned from a sample by text hash. They order shingles and deal out work; no result depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(shingle_hashes(t or b"", words)).view(np.int64))], names=["s"])

    text = F.col("text").cast("binary")
    share = min(1.0, sizes.sample / max(1, texts))
    part = docs.select(text.alias("text")).where(F.pmod(F.xxhash64(text), F.lit(1_000_003)) < F.lit(math.ceil(1_000_003 * share))).distinct()
    top = part.mapInArrow(trimmed(run), "s long").groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(sizes.frequent).toArrow()
    s = top.column("s").to_numpy().view(np.uint64)
    order = np.argsort(s)
    return Frequent(s[order], (len(s) - 1 - np.arange(len(s)))[order], (top.column("count").to_numpy() / share)[order])


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, h) of each row: fp is the content key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([content_key(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], schema=PRINTS)

    return hashed(docs).mapInArrow(trimmed(run), "doc_id long, fp long, h long")


def sketched(docs: DataFrame, words: int, similarity: float, sent) -> DataFrame:
    """(fp, print, size, tile, w, s) of each content key: the fingerprint of 64 bits, the number of shingles, where their
    set is compared with like ones, their parities and they themselves, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        for b in batches:
            texts = [t or b"" for t in b.column(0).to_pylist()]
            keys = np.array([content_key(t) for t in texts], np.uint64)
            prints, tiles, own = np.zeros(len(texts), np.uint64), keys.copy(), []
            for i, t in enumerate(texts):
                h = shingle_hashes(t, words)
                own.append(shingle_set(h))
                prints[i] = majority(h)
                if len(lead := leading(own[-1], similarity, frequent)[:1]):
                    at, known = frequent.find(lead)
                    parts = 1 + int(frequent.texts[at[0]]) // TILE if known[0] else 1
                    tiles[i] = mixed(lead + (keys[i : i + 1] % np.uint64(parts) << np.uint64(SHINGLE_BITS)))[0]
            longs = [keys.view(np.int64), prints.view(np.int64), np.array([len(x) for x in own], np.int64), tiles.view(np.int64)]
            binary = [pa.array([f(x) for x in own], pa.binary()) for f in (lambda x: parities(x).tobytes(), packed)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, longs), *binary], names=["fp", "print", "size", "tile", "w", "s"])

    made = docs.select(F.col("text").cast("binary")).mapInArrow(trimmed(run), "fp long, print long, size long, tile long, w binary, s binary")
    return written(made.groupBy("fp").agg(F.min(F.struct("print", "size", "tile", "w", "s")).alias("t")).select("fp", "t.*"))


def leads_of(batch: pa.RecordBatch, similarity: float, frequent: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (fp, s): key and leading shingle, one beside the other, and the shingle's place among the frequent ones or -1."""
    lead = [leading(unpacked(s), similarity, frequent) for s in batch.column(1).to_pylist()]
    who = np.repeat(batch.column(0).to_numpy(), np.fromiter(map(len, lead), np.int64, len(lead)))
    lead = np.concatenate([*lead, np.zeros(0, np.uint64)])
    at, known = frequent.find(lead)
    return who, lead, np.where(known, at, -1)


def emit_leads(buckets: int, similarity: float, hot: int, sent):
    """Reads (fp, s): the leading shingles that aren't hot, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, most = 0, 1 << 18

        def flush():
            who, key = (np.concatenate(c) for c in zip(*held, strict=True))
            key = mixed(key)
            bucket = bucket_of(key, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            groups = np.split(order, cuts)
            short = key.astype(np.uint32)
            for at in range(0, len(groups), 256):
                part = groups[at : at + 256]
                yield batch_of(ROUTED, [0] * len(part), [int(bucket[g[0]]) for g in part], [pack([short[g], who[g]]) for g in part])

        for b in batches:
            who, lead, at = leads_of(b, similarity, frequent)
            cold = (at < 0) | (frequent.texts[at] < hot) if len(frequent.texts) else np.ones(len(lead), bool)
            held.append((who[cold], lead[cold]))
            size += len(held[-1][0])
            if size >= most:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def hot_members(similarity: float, hot: int, sent):
    """Reads (fp, s): (k, u) of the leading shingles that are hot, k below zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        for b in batches:
            who, _, at = leads_of(b, similarity, frequent)
            own = np.flatnonzero(at >= 0)
            own = own[frequent.texts[at[own]] >= hot]
            yield pa.RecordBatch.from_arrays([pa.array(-1 - at[own]), pa.array(who[own])], names=["k", "u"])

    return run


def meet_leads(few: int):
    """Pairs of texts that meet (kind 0: u, v), and the members of where more than `few` do (kind 1: k, u)."""

    def one(bucket: int, blobs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(x, [np.uint32, np.int64])[0] for x in blobs]
        key, who = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        pairs = [np.zeros((0, 2), np.int64)]
        for n in range(2, few + 1):
            own = first[size == n]
            pairs += [np.stack([who[own + i], who[own + j]], 1) for i in range(n) for j in range(i)]
        uv = np.sort(np.concatenate(pairs), axis=1)
        uv = np.unique(uv[uv[:, 0] != uv[:, 1]], axis=0)
        inside = np.repeat(size > few, size)
        k, u = bucket << 32 | key[inside].astype(np.int64), who[inside]
        for at in range(0, len(uv) + len(u), 1 << 17):
            x, y = uv[at : at + (1 << 17)], slice(max(0, at - len(uv)), max(0, at + (1 << 17) - len(uv)))
            kind = np.repeat(np.array([0, 1], np.int32), [len(x), len(u[y])])
            none = np.zeros(len(u[y]), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (kind, np.concatenate([np.zeros(len(x), np.int64), k[y]]), np.concatenate([x[:, 0], u[y]]), np.concatenate([x[:, 1], none]))], schema=MET)

    return lambda batches: per_bucket(batches, one, numbered=True)


def members_of(t: pa.Table) -> tuple[dict[str, np.ndarray], list[np.ndarray], np.ndarray]:
    """Columns as arrays, the parities, and those of the fewest classes as a matrix."""
    w = [np.frombuffer(x, "<u8") for x in t.column("w").to_pylist()]
    return {n: t.column(n).to_numpy() for n in t.column_names if n != "w"}, w, np.stack([folded(x, PARITIES) for x in w])


def pairs_batch(m: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Pairs of members, the smaller key first, with their tiles."""
    turn = m["u"][i] > m["u"][j]
    a, b = np.where(turn, j, i), np.where(turn, i, j)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (m["u"][a], m["u"][b], m["tile"][a], m["tile"][b])], schema=PAIRS)


class Bounds:
    """What no two sets as similar as asked exceed: their sizes, and by their parities how many elements they differ in."""

    def __init__(self, similarity: float):
        # sets that share s of their a and b elements differ in a + b - 2 s, which is at most this share of a + b
        self.similarity, self.differing = similarity, (1 - similarity) / (1 + similarity)

    def allow(self, size_a: np.ndarray, size_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """By parities of the fewest classes: where two sets may be like enough."""
        like = np.minimum(size_a, size_b) >= self.similarity * np.maximum(size_a, size_b) - 1e-6
        return like & (np.bitwise_count(a ^ b).sum(axis=-1) <= self.differing * (size_a + size_b) + 1e-6)

    def allow_two(self, size_a: int, size_b: int, a: np.ndarray, b: np.ndarray) -> bool:
        """By all parities of two sets."""
        if min(size_a, size_b) < self.similarity * max(size_a, size_b) - 1e-6:
            return False
        size = min(len(a), len(b))
        return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum()) <= self.differing * (size_a + size_b) + 1e-6

    def kept(self, m: dict[str, np.ndarray], w: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of members that the fewest parities allow, those that all do."""
        good = np.array([max(len(w[x]), len(w[y])) == PARITIES or self.allow_two(m["size"][x], m["size"][y], w[x], w[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
        return i[good], j[good]

    def pairs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reads (u, v, tu, tv, size_u, size_v, w_u, w_v): the pairs that are allowed."""
        for b in batches:
            sizes, w = (b.column(4).to_pylist(), b.column(5).to_pylist()), [[np.frombuffer(x, "<u8") for x in b.column(n).to_pylist()] for n in (6, 7)]
            good = [self.allow_two(*x) for x in zip(*sizes, *w, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(n).filter(pa.array(good, pa.bool_())) for n in range(4)], schema=PAIRS)


def apart(low: int, high: int, block: int, bounds: Bounds):
    """Reads members (task, k, u, pos, size, tile, w, c) by task and pos: of each two of the same k and different c that
    lie `low` up to `high` - 1 apart, the later in the task's block, those that the bounds allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, "task"):
            m, w, least = members_of(t)
            first = int(np.searchsorted(m["pos"], m["task"][0] * block))
            for d in range(low, min(high, len(t))):
                j = np.arange(max(first, d), len(t))
                i = j - d
                good = (m["k"][i] == m["k"][j]) & (m["c"][i] != m["c"][j])
                i, j = i[good], j[good]
                good = bounds.allow(m["size"][i], m["size"][j], least[i], least[j])
                i, j = bounds.kept(m, w, i[good], j[good])
                if len(i):
                    yield pairs_batch(m, i, j)

    return run


def all_apart(high: int, bounds: Bounds):
    """Reads members (task, k, mb, r, side, u, pos, size, tile, w, c, main) by task, k, mb, r, side: of each of side 0 with
    each of side 1, `high` or more apart and of different c, those that the bounds allow. Two of side 1 meet twice and go on once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, "task", "k", "mb", "r"):
            m, w, least = members_of(t)
            rest = np.flatnonzero(m["side"] == 1)
            block = np.flatnonzero(m["side"] == 0)
            other = m["c"][block] != m["main"][block]  # these are of side 1 too
            for i in rest.tolist() if len(block) else ():
                good = (np.abs(m["pos"][block] - m["pos"][i]) >= high) & (m["c"][block] != m["c"][i]) & (~other | (m["pos"][block] > m["pos"][i]))
                j = block[good]
                j = j[bounds.allow(m["size"][i], m["size"][j], least[i], least[j])]
                x, j = bounds.kept(m, w, np.full(len(j), i), j)
                if len(j):
                    yield pairs_batch(m, x, j)

    return run


def compared(similarity: float):
    """Reads sets (task, kind 0, u, s) and after them pairs (task, kind 1, u, v) of each task: the pairs as similar as asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, out = None, {}, []
        for b in batches:
            for task, kind, u, v, s in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if task != now:
                    now, sets = task, {}
                if kind == 0:
                    sets[u] = unpacked(s)
                    continue
                x, y = sets[u], sets[v]
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if common >= similarity * (len(both) - common):
                    out.append((u, v))
            if out:
                yield batch_of(EDGES, *zip(*out, strict=True))
                out = []

    return run


def verified(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame | None:
    """The pairs (u, v, tu, tv) whose shingle sets are as similar as asked, as edges (u, v); None if there are no pairs.

    A set travels once to each tile that it is asked for in, not once for each of its pairs.
    """
    kept = checkpoint(pairs.distinct())
    n = kept.count()
    if not n:
        return None
    pairs = kept.withColumn("task", F.xxhash64(F.least("tu", "tv"), F.greatest("tu", "tv")))
    asked = pairs.select("task", F.explode(F.array("u", "v")).alias("fp")).distinct()
    sets = texts.select("fp", "s").join(F.broadcast(asked) if n <= PAIRS_TO_ALL else asked, "fp")
    rows = sets.select("task", F.lit(0).alias("kind"), F.col("fp").alias("u"), F.lit(None).cast("long").alias("v"), "s")
    rows = rows.unionByName(pairs.select("task", F.lit(1).alias("kind"), "u", "v", F.lit(None).cast("binary").alias("s")))
    parts = partitions_for(2 * n, 16 * TILE, 8)
    out = rows.repartitionById(parts, F.pmod("task", F.lit(parts)).cast("int")).sortWithinPartitions("task", "kind").mapInArrow(trimmed(compared(similarity)), "u long, v long")
    out = checkpoint(out)
    forget(kept)
    return out


def linked_by_similarity(docs: DataFrame, prints: DataFrame, words: int, similarity: float, sizes: Sizes) -> DataFrame:
    """(node, component) over content keys, linked by all pairs of texts whose shingle sets are as similar as asked.

    First come pairs that meet by their fingerprints: most near copies, at little cost. Then the search is exact: texts
    meet at their leading shingles, and of those that no verified pairs link yet all are tested.
    """
    spark, bounds = docs.sparkSession, Bounds(similarity)
    sent = spark.sparkContext.broadcast(frequent_shingles(docs, prints.count(), words, sizes))
    texts = sketched(docs, words, similarity, sent)
    n = texts.count()
    links = None

    def link(pairs: DataFrame) -> None:
        """Verify pairs and bring the components up to date."""
        nonlocal links
        found = verified(texts, pairs, similarity)
        if found is None or found.isEmpty():
            return
        before, old = links, [] if links is None else [links.select(F.col("node").alias("u"), F.col("component").alias("v"))]
        links = checkpoint(connected_components(reduce(DataFrame.union, old, found)))
        for x in [found] if before is None else [found, before]:
            forget(x)

    def facts(*columns: str) -> DataFrame:
        """fp, its columns and its component c."""
        own = texts.select("fp", *columns)
        if links is None:
            return own.withColumn("c", F.col("fp"))
        return own.join(links.withColumnRenamed("node", "fp"), "fp", "left").select("fp", *columns, F.coalesce("component", "fp").alias("c"))

    # by fingerprint: of texts of the same one, each with the least; and the least of fingerprints in reach
    least = texts.groupBy("print").agg(F.count("*").alias("n"), F.min(F.struct("fp", "tile")).alias("m")).select("print", "n", F.col("m.fp").alias("v"), F.col("m.tile").alias("tv"))
    least = checkpoint(least)
    same = joined_by(texts.select("print", F.col("fp").alias("u"), F.col("tile").alias("tu")), least, "print", n).where("u <> v").select("u", "v", "tu", "tv")
    a, b = (least.select(F.col("print").alias(f"p{x}"), F.col("v").alias(x), F.col("tv").alias(f"t{x}")) for x in "uv")
    balls = ball_edges(least.select(F.col("print").alias("fp"))).toDF("pu", "pv").join(a, "pu").join(b, "pv").select("u", "v", "tu", "tv")

    # by leading shingles
    buckets = partitions_for(int(texts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] * (1 - similarity)) + n, LEADS_A_BUCKET, 4)
    leads = texts.select("fp", "s").mapInArrow(trimmed(emit_leads(buckets, similarity, sizes.hot, sent)), "kind int, bucket long, blob binary")
    met = checkpoint(dealt(leads, buckets).sortWithinPartitions("bucket").mapInArrow(trimmed(meet_leads(sizes.few)), "kind int, k long, u long, v long"))
    hot = texts.select("fp", "s").mapInArrow(trimmed(hot_members(similarity, sizes.hot, sent)), "k long, u long")
    a, b = (texts.select(F.col("fp").alias(x), F.col("tile").alias(f"t{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("size", "w")]) for x in "uv")
    few = met.where("kind = 0").select("u", "v").distinct().join(a, "u").join(b, "v").select("u", "v", "tu", "tv", "size_u", "size_v", "w_u", "w_v").mapInArrow(trimmed(bounds.pairs), "u long, v long, tu long, tv long")
    ordered, placed, total = positions(met.where("kind = 1").select("k", "u").union(hot), texts)

    def members() -> DataFrame:
        return placed.join(facts("size", "tile", "w").withColumnRenamed("fp", "u"), "u")

    def tested(low: int, high: int) -> DataFrame:
        """Pairs of members that lie so far apart in their order."""
        own = members().withColumn("task", F.explode(F.array_distinct(F.array(F.expr(f"pos div {sizes.block}"), F.expr(f"(pos + {high - 1}) div {sizes.block}")))))
        parts = partitions_for(total, 16 * sizes.block, 8)
        own = own.select("task", "k", "u", "pos", "size", "tile", "w", "c").repartitionById(parts, F.pmod("task", F.lit(parts)).cast("int")).sortWithinPartitions("task", "pos")
        return own.mapInArrow(trimmed(apart(low, high, sizes.block, bounds)), "u long, v long, tu long, tv long")

    first = same.union(balls).union(few)
    link(first.union(tested(1, 2)) if total else first)
    forget(met)
    forget(least)
    if total:
        link(tested(2, sizes.near))
        link(rest_with_all(members(), total, sizes, bounds))
    forget(ordered)
    forget(texts)
    sent.unpersist()
    return links if links is not None else prints.select(F.col("fp").alias("node"), F.col("fp").alias("component")).where("false")


def positions(members: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """A checkpoint of members (k, u) in order; on it, (k, u, pos), numbered through in the order of k, size and u; and how many there are.

    The order is dealt out by ranges, so a hot k lies in many partitions.
    """
    members = checkpoint(members)
    total = members.count()
    if not total:
        return members, members, 0
    parts = min(20_000, partitions_for(total, 200_000, 4))
    sized = members.join(texts.select(F.col("fp").alias("u"), "size"), "u")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = checkpoint(sized.repartitionByRange(parts, "k", "size", "u").sortWithinPartitions("k", "size", "u").select("k", "u", F.spark_partition_id().alias("part"), row.alias("row")))
    forget(members)
    offsets, at = [], 0
    for part, n in sorted(tuple(r) for r in ordered.groupBy("part").count().collect()):  # a row a partition
        offsets.append((part, at))
        at += n
    known = F.broadcast(ordered.sparkSession.createDataFrame(offsets, "part int, at long"))
    return ordered, ordered.join(known, "part").select("k", "u", (F.col("at") + F.col("row")).alias("pos")), total


def rest_with_all(members: DataFrame, total: int, sizes: Sizes, bounds: Bounds) -> DataFrame:
    """Pairs of members of the same k and different components that lie sizes.near or more apart.

    At least one of such two isn't in its k's largest component, so it is enough to lay these few beside all members
    of their k, a block of those at a time.
    """
    block = sizes.block
    by_c = members.groupBy("k", "c").agg(F.count("*").alias("m"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    by_k = by_c.groupBy("k").agg(F.sum("m").alias("n"), F.max("m").alias("most"), F.max_by("c", F.struct("m", "c")).alias("main"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    open_k = checkpoint(by_k.where((F.col("n") > F.col("most")) & (F.col("hi") - F.col("lo") >= sizes.near)))
    of = open_k.select("k", "n", "main", "lo", "hi", F.ceil((F.col("n") - F.col("most")) / block).cast("long").alias("chunks"))
    own = joined_by(members, of, "k", total)
    there = own.withColumns({"side": F.lit(0), "mb": F.expr(f"pos div {block}")}).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rest = own.where("c <> main").withColumns({"side": F.lit(1), "r": F.pmod(F.xxhash64("u"), F.col("chunks"))}).withColumn("mb", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"hi div {block}"))))
    both = there.unionByName(rest).withColumn("task", F.xxhash64("k", "mb", "r"))
    parts = partitions_for(total, 16 * block, 8)
    both = both.select("task", "k", "mb", "r", "side", "u", "pos", "size", "tile", "w", "c", "main").repartitionById(parts, F.pmod("task", F.lit(parts)).cast("int")).sortWithinPartitions("task", "k", "mb", "r", "side")
    return both.mapInArrow(trimmed(all_apart(sizes.near, bounds)), "u long, v long, tu long, tv long")


# --- components and what stays


def ball_edges(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) between fingerprints (fp) within RADIUS bits."""
    buckets = partitions_for(distinct.count(), FINGERPRINTS_A_BLOCK, 4)
    variants = distinct.select("fp").mapInArrow(trimmed(emit_variants(buckets)), "kind int, bucket long, blob binary")
    return dealt(variants, buckets).sortWithinPartitions("bucket").mapInArrow(trimmed(meet), "u long, v long")


def _components(prints: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """(fp, n rows, least doc_id of the fingerprint, component as a fingerprint) of fingerprints (doc_id, fp), as linked (node, component), or else by distance."""
    distinct = checkpoint(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")))
    linked = connected_components(ball_edges(distinct)) if linked is None else linked
    return distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("component"))


def _named(rows: DataFrame, of: DataFrame) -> DataFrame:
    """Each row (doc_id, fp, h) with the smallest doc_id of its component. Many rows may share a fingerprint, and many of those a component."""
    first = of.groupBy("component").agg(F.count("*").alias("n"), F.min("least").alias("component_id"))
    named = joined_by(of.withColumnRenamed("n", "rows"), first, "component", of.count()).select("fp", F.col("rows").alias("n"), "component_id")
    return joined_by(rows, named, "fp", rows.count())


def _linked(docs: DataFrame, words: int, similarity: float | None, sizes: Sizes) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp, h) of docs and the components of their fingerprints."""
    if similarity is None:
        rows = checkpoint(fingerprints(docs, words))
        return rows, _components(rows)
    rows = checkpoint(keyed_texts(docs))
    return rows, _components(rows, linked_by_similarity(docs, rows, words, similarity, sizes))


def near_duplicates(docs: DataFrame, words: int = 3, similarity: float | None = None, sizes: Sizes | None = None) -> DataFrame:
    """Link the near duplicates among docs (doc_id, text, any other columns).

    A text's shingles are the runs of `words` words of it, A-Z lower-cased, repeats included; fewer words make one
    shingle. Without similarity, documents are linked whose 64-bit fingerprints differ in at most three bits; with
    it, those whose sets of shingles have at least that Jaccard similarity, all of them, and those of the same words.

    Returns one row per row of docs: doc_id, fp (the fingerprint as a long, or a content key), component_id (the
    smallest doc_id that can be reached over links, its own included). A null text or one without words has
    fingerprint zero and is linked like any other. Rows without doc_id link as well but name no component;
    component_id is null if no member has an id. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows, of = _linked(docs, words, similarity, sizes or Sizes())
    return _named(rows, of).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 3, similarity: float | None = None, sizes: Sizes | None = None) -> DataFrame:
    """The rows of docs that stay when each group of near duplicates keeps one document, that of smallest doc_id.

    Rows without doc_id come last; of rows that share the id, that of the least text hash stays, and of rows equal in
    both, one. All columns of docs are kept as they are.
    """
    prepare(docs.sparkSession)
    rows, of = _linked(docs, words, similarity, sizes or Sizes())
    known = docs.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if known[0] == known[1] == known[2]:
        gone = checkpoint(_named(rows, of).where("doc_id <> component_id").select("doc_id"))
        if gone.count() <= IDS_TO_ALL:  # then the texts aren't shuffled
            gone = F.broadcast(gone)
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    best = joined_by(rows, of, "fp", rows.count()).groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("no"), F.col("doc_id").alias("id"), "h")).alias("b"))
    stay = best.select(F.col("b.id").alias("_stay_id"), F.col("b.h").alias("_stay_h"))
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    once = docs.withColumns({"_stay_key": F.xxhash64(text), "_stay_doc": F.col("doc_id")}).dropDuplicates(["_stay_doc", "_stay_key"])
    return once.join(stay, F.col("_stay_doc").eqNullSafe(F.col("_stay_id")) & (F.col("_stay_key") == F.col("_stay_h")), "left_semi").select(*docs.columns)
