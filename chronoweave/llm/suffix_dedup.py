"""Exact substring deduplication by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if some string of `length` bytes that covers it also starts earlier: in a document of smaller id, or
earlier in the same one.

How the work is dealt out. Every window of `length` bytes contains the k-byte string with the least hash, its
anchor (ties: the leftmost), which depends on the window's bytes only. So equal windows have equal anchors, and the
windows of one anchor can be compared apart from all others. Neighbouring windows with the same anchor travel as one
record: (anchor hash, document, first start, count, bytes). Records go to blocks by anchor hash, compressed in
columns; one shuffle of about 2.5 times the parquet input carries them. In a block, records whose anchor occurs
once are dropped, and of byte-identical records two are kept (the earliest and one later; further ones share the
latter's answer). What is left is concatenated, sorted by bounded prefix doubling into a suffix array and its BWT,
and intervals of strings that share a prefix are extended backwards breadth-first by one byte a level, which sets
the common-prefix values of neighbouring suffixes in increasing order (Beller et al., 2013). At `length` the
expansion stops: positions not separated by then start equal windows.

Skew: a block that outgrows its limit is compacted on the way. An anchor with more than `hot` distinct records is
not gathered: its records are cut by the offset of the anchor in the window into thirds, keyed again by the bytes
that all windows of a third share, and go through another round; at the last cut one window is one record, and equal
windows collapse. Anchors that a sample shows to be frequent (a passage of very many documents) are dealt over many
blocks by document in the first round: each of these keeps two of byte-identical records, and what is left of all is cut
as above and meets in the next round. Nothing is dropped or capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm._common import batch_of, checkpoint, dealt, pack, partitions_for, prepare, trimmed, unpack

ANCHOR = 20
GRAM_BASE = 0x100000001B3
SEED_LENGTH = 8
#: Offsets of the anchor in the window, per round: all of them, then thirds of thirds, then single ones.
WIDTHS = (81, 27, 9, 3, 1)
TEXT_CHUNK = 2 << 20
ROUTE_TEXT = 16 << 20
PART_RAW = 32 << 20
BLOCK_TEXT = 1 << 20
RECORD = [np.uint64, np.int64, np.uint64, np.int64, np.uint8, np.uint8]
RUN = [np.int64, np.uint64, np.int64, np.int64]
ROUTED = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("blob", pa.binary())])
NO_ID = np.iinfo(np.int64).max
#: Bits for a place in the bytes that anchors are looked for in at once: the same for all, as ties are decided by the others.
PLACE_BITS = 23
#: Bytes of text, roughly, in the sample that shows frequent anchors; how many records make one frequent; and over how many blocks those are dealt.
SAMPLE_BYTES, FREQUENT, SALTS = 64 << 20, 100_000, 64


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(t: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes of t, by doubling a polynomial one."""
    base, parts, h, size = GRAM_BASE, [], t.astype(np.uint64) + np.uint64(1), 1
    while True:
        if k & size:
            parts.append((size, h))
        if size * 2 > k:
            break
        h = h[:-size] * np.uint64(pow(base, size, 1 << 64)) + h[size:]
        size *= 2
    n, out, at = len(t) - k + 1, None, 0
    for size, h in reversed(parts):
        piece = h[at : at + n]
        out = piece if out is None else out * np.uint64(pow(base, size, 1 << 64)) + piece
        at += size
    return mixed(out)


def anchors(t: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end in t: document index, first start in t, count, offset of the anchor, anchor hash."""
    k, w = ANCHOR, length - ANCHOR + 1
    ends = np.cumsum(lengths)
    none = np.zeros(0, np.int64)
    if len(t) < length:
        return none, none, none, none, none.astype(np.uint64)
    h = gram_hashes(t, k)
    if len(h) >> PLACE_BITS:
        raise ValueError(f"anchors are looked for in {1 << PLACE_BITS} bytes at most")
    bits = np.uint64(PLACE_BITS)
    m = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < w:
        m = np.minimum(m[: len(m) - (w - size)], m[w - size :])
    at = (m & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)[: len(at)]
    good = np.arange(len(at)) + length <= ends[doc]
    new = np.empty(len(at), bool)
    new[:1] = True
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new & good)
    run = np.cumsum(new)
    count = np.bincount(run[good], minlength=run[-1] + 1)[run[heads]]
    return doc[heads], heads, count, at[heads] - heads, mixed(h[at[heads]] + np.uint64(1))  # least hashes are small: mix again


def anchor_keys(text: bytes, at: np.ndarray) -> np.ndarray:
    """The anchor hashes, as anchors() gives them, of the anchors that start at places of text."""
    power = np.array([pow(GRAM_BASE, ANCHOR - 1 - i, 1 << 64) for i in range(ANCHOR)], np.uint64)
    t, out = np.frombuffer(text, np.uint8), np.zeros(len(at), np.uint64)
    for i in range(ANCHOR):
        out += (t[at + i].astype(np.uint64) + np.uint64(1)) * power[i]
    return mixed(mixed(out) + np.uint64(1))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def routed(kind: int, bucket: np.ndarray, columns: list[np.ndarray], slices=None) -> Iterator[pa.RecordBatch]:
    """One compressed block for each bucket. slices: gives the bytes of the rows of an index array."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    rows, size = [], 0
    for part in np.split(order, cuts) if len(order) else []:
        rows.append((int(bucket[part[0]]), pack([c[part] for c in columns], slices(part) if slices else b"")))
        size += len(rows[-1][1])
        if size > 4 << 20:
            yield batch_of(ROUTED, [kind] * len(rows), [b for b, _ in rows], [x for _, x in rows])
            rows, size = [], 0
    if rows:
        yield batch_of(ROUTED, [kind] * len(rows), [b for b, _ in rows], [x for _, x in rows])


def pieces(batches: Iterator[pa.RecordBatch], length: int, chunk: int) -> Iterator[tuple[list, list[bytes], list[int]]]:
    """Groups of (doc, sub) and byte pieces of about `chunk` bytes; a longer text is cut with an overlap."""
    ids: list = []
    parts: list[bytes] = []
    starts: list[int] = []
    size = 0
    for b in batches:
        for doc, sub, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            for s in range(0, max(1, len(text) - length + 1), chunk):
                piece = text[s : s + chunk + length - 1]
                if len(piece) < length:
                    continue
                ids.append((doc, sub))
                parts.append(piece)
                starts.append(s)
                size += len(piece)
                if size >= chunk:
                    yield ids, parts, starts
                    ids, parts, starts, size = [], [], [], 0
    if parts:
        yield ids, parts, starts


def salted_bucket(key: np.ndarray, doc: np.ndarray, sub: np.ndarray, buckets: int, frequent: np.ndarray, salts: int) -> np.ndarray:
    """The block of an anchor's records; those of a frequent one (sorted list) are dealt over `salts` of them by document."""
    salt = np.where(np.isin(key, frequent), doc_hash(doc, sub) % np.uint64(salts) + np.uint64(1), np.uint64(0))
    return bucket_of(np.where(salt > 0, mixed(key + salt * np.uint64(0x9E3779B97F4A7C15)), key), buckets)


def anchor_sample(length: int, chunk: int):
    """Reads (doc, sub, text): the anchor of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts, _ in pieces(batches, length, chunk):
            key = anchors(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts]), length)[-1]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return run


def frequent_anchors(rows: DataFrame, total: int, length: int, chunk: int, frequent: int) -> np.ndarray:
    """Anchors, sorted, that by a sample of the documents have over `frequent` records. They only deal out work; no result depends on them."""
    share = min(1.0, SAMPLE_BYTES / max(1, total))
    part = rows.where(F.pmod(F.xxhash64("doc", "text"), F.lit(1_000_003)) < F.lit(math.ceil(1_000_003 * share)))
    least = max(2, int(frequent * share))  # at most total / frequent anchors have so many
    found = part.mapInArrow(trimmed(anchor_sample(length, chunk)), "key long").groupBy("key").count().where(F.col("count") > least).select("key").toArrow()
    return np.sort(found.column("key").to_numpy().view(np.uint64))


def emit_records(length: int, buckets: int, chunk: int, frequent: np.ndarray, salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        bufs: list[bytes] = []
        size = 0

        def flush():
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            key, *_, count, _, head, buf = columns
            ends = head + count + length - 1

            def cut(rows):
                return b"".join([bufs[i][a:b] for i, a, b in zip(buf[rows].tolist(), head[rows].tolist(), ends[rows].tolist(), strict=True)])

            return routed(0, salted_bucket(key, columns[1], columns[2], buckets, frequent, salts), columns[1:-2], cut)  # the key can be had from the bytes

        for ids, parts, starts in pieces(batches, length, chunk):
            buf = b"".join(parts)
            lengths = np.array([len(p) for p in parts])
            doc, head, count, off, key = anchors(np.frombuffer(buf, np.uint8), lengths, length)
            begin = np.cumsum(lengths) - lengths
            who = np.array([d for d, _ in ids], np.int64)[doc]
            sub = np.array([s for _, s in ids], np.int64).view(np.uint64)[doc]
            first = head - begin[doc] + np.array(starts, np.int64)[doc]
            held.append([key, who, sub, first, count.astype(np.uint8), off.astype(np.uint8), head, np.full(len(doc), len(bufs))])
            bufs.append(buf)
            size += len(buf)
            if size >= ROUTE_TEXT:
                yield from flush()
                held, bufs, size = [], [], 0
        if held:
            yield from flush()

    return run


# --- the transform


def bounded_suffix_array(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the cyclic text t in the order of the `depth` (at least) bytes from there, and the first SEED_LENGTH bytes of each."""
    n = len(t)
    k, size = np.concatenate([t, t[: SEED_LENGTH - 1]]).astype(np.uint64), 1
    while size < SEED_LENGTH:
        k = (k[:-size] << np.uint64(8 * size)) | k[size:]
        size *= 2
    sa = np.argsort(k)
    seed = k[sa]
    sa = sa.astype(np.int32)
    rank = np.empty(n, np.int32)
    slots = np.arange(n, dtype=np.int32)
    heads = np.concatenate([[True], seed[1:] != seed[:-1]])
    h = SEED_LENGTH
    while True:
        first = slots[np.maximum.accumulate(np.where(heads, np.arange(len(slots), dtype=np.int32), np.int32(0)))]
        rank[sa[slots]] = first
        alone = heads & np.concatenate([heads[1:], [True]])
        slots = slots[~alone]
        if not len(slots) or h >= depth:
            return sa, seed
        own = sa[slots]
        at = own + np.int32(h)
        at[at >= n] -= n
        key = (rank[own].astype(np.uint64) << np.uint64(32)) | rank[at].astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        sa[slots] = own[order]
        heads = np.concatenate([[True], key[1:] != key[:-1]])
        h *= 2


def equal_prefix_groups(t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the cyclic text t and, for each of its slots, the number of its group of equal `length`-byte prefixes."""
    n = len(t)
    sa, seed = bounded_suffix_array(t, length)
    bwt = t[sa - 1]
    by = np.argsort(bwt, kind="stable")
    by = by.astype(np.int32)
    lf = np.empty(n, np.int32)
    lf[by] = np.arange(n, dtype=np.int32)
    later, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    same = bwt[by[1:]] == bwt[by[:-1]]
    later[by[:-1][same]] = by[1:][same]
    before[by[1:][same]] = by[:-1][same]
    bound = np.zeros(n + 1, bool)
    bound[0] = bound[n] = True
    bound[1:n] = seed[1:] != seed[:-1]
    lo = np.flatnonzero(bound[:n]).astype(np.int32)
    hi = np.append(lo[1:], np.int32(n)) - np.int32(1)
    for _ in range(SEED_LENGTH, length):
        if not len(lo):
            break
        sizes = hi - lo + np.int32(1)
        stop = np.cumsum(sizes, dtype=np.int32)
        slot = np.arange(stop[-1], dtype=np.int32) + np.repeat(lo - (stop - sizes), sizes)
        last = slot[later[slot] > np.repeat(hi, sizes)]
        first = slot[before[slot] < np.repeat(lo, sizes)]
        last, first = np.sort(lf[last]), np.sort(lf[first])
        fresh = ~bound[last + 1]
        lo, hi = first[fresh], last[fresh]
        bound[hi + 1] = True
    return sa, np.cumsum(bound[:n]) - 1


def later_windows(text: bytes, first: np.ndarray, count: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Of records laid end to end in text (`count` windows each): which windows equal one of lower rank, in record order.

    rank: of each window, in the same order; equal ranks are one and the same window.
    """
    t = np.frombuffer(text, np.uint8)
    sa, group = equal_prefix_groups(t, length)
    of = np.empty(len(t), np.int64)
    of[sa] = group
    pos = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    g = of[pos]
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, g, rank)
    return rank > least[g]


class Records:
    """Records of one block, in columns; the bytes of all in one buffer."""

    def __init__(self, columns: list[np.ndarray], text: bytes, length: int):
        self.key, self.doc, self.sub, self.first, self.count, self.off = columns
        self.text, self.length = text, length
        sizes = self.count.astype(np.int64) + length - 1
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes

    def take(self, rows: np.ndarray) -> Records:
        columns = [c[rows] for c in (self.key, self.doc, self.sub, self.first, self.count, self.off)]
        return Records(columns, self.bytes_of(rows), self.length)

    def bytes_of(self, rows: np.ndarray) -> bytes:
        return b"".join([self.text[a:b] for a, b in zip(self.begin[rows].tolist(), self.end[rows].tolist(), strict=True)])

    @staticmethod
    def joined(parts: list[Records]) -> Records:
        cols = [[p.key, p.doc, p.sub, p.first, p.count, p.off] for p in parts]
        return Records([np.concatenate(c) for c in zip(*cols, strict=True)], b"".join(p.text for p in parts), parts[0].length)


def collapsed(r: Records, final: bool) -> tuple[Records, list[np.ndarray]]:
    """Keep two of byte-identical records, the earliest and the next; the others' windows are all repeats.

    final: also drop records whose anchor occurs once.
    """
    if final:
        _, inverse, seen = np.unique(r.key, return_inverse=True, return_counts=True)
        rows = np.flatnonzero(seen[inverse] > 1)
    else:
        rows = np.arange(len(r.key))
    if not len(rows):
        return r.take(rows), []
    text, digest = r.text, np.empty((len(rows), 2), np.uint64)
    for i, (a, b) in enumerate(zip(r.begin[rows].tolist(), r.end[rows].tolist(), strict=True)):
        d = xxhash.xxh3_128_intdigest(text[a:b])
        digest[i] = d & 0xFFFFFFFFFFFFFFFF, d >> 64
    own = (r.key[rows], r.off[rows], digest[:, 0], digest[:, 1])
    order = np.lexsort((r.first[rows], r.sub[rows], r.doc[rows], *own[::-1]))
    same = np.ones(len(rows) - 1, bool)
    for c in own:
        c = c[order]
        same &= c[1:] == c[:-1]
    head = np.concatenate([[True], ~same])
    nth = np.arange(len(rows)) - np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))
    extra = rows[order[nth > 1]]
    runs = [r.doc[extra], r.sub[extra], r.first[extra], r.count[extra].astype(np.int64)]
    return r.take(np.sort(rows[order[nth <= 1]])), runs if len(extra) else []


def split_up(r: Records, width: int, length: int) -> Records:
    """Cut records by the anchor's offset in the window into ranges of `width`, keyed by the bytes shared by a range's windows."""
    cols: list[list] = [[] for _ in range(6)]
    texts: list[bytes] = []
    for i, (a, first, count, off) in enumerate(zip(r.begin.tolist(), r.first.tolist(), r.count.tolist(), r.off.tolist(), strict=True)):
        low = off - count + 1
        for block in range(low // width, off // width + 1):
            o1, o2 = block * width, min(block * width + width, length - ANCHOR + 1) - 1
            hi, lo = min(off, o2), max(low, o1)
            at = a + off  # of the anchor, in r.text
            core = r.text[at - o1 : at - o2 + length]
            shift = off - hi
            cols[0].append(xxhash.xxh64_intdigest(core, seed=block))
            cols[3].append(first + shift)
            cols[4].append(hi - lo + 1)
            cols[5].append(hi)
            cols[1].append(i)
            texts.append(r.text[a + shift : a + shift + (hi - lo + 1) + length - 1])
    who = np.array(cols[1], np.int64)
    return Records([np.array(cols[0], np.uint64), r.doc[who], r.sub[who], np.array(cols[3], np.int64), np.array(cols[4], np.uint8), np.array(cols[5], np.uint8)], b"".join(texts), length)


def resolve(length: int, buckets: int, doc_buckets: int, round_: int, hot: int, frequent: np.ndarray):
    """Reads record blocks sorted by bucket; gives runs of repeated windows (kind 0), and records of hot anchors cut finer (kind 1).

    Those of frequent anchors are of many blocks in the first round, so all that are left of them go on.
    """

    def received(blob: bytes) -> Records:
        if round_:
            return Records(*unpack(blob, RECORD), length)
        columns, text = unpack(blob, RECORD[1:])
        r = Records([np.zeros(len(columns[0]), np.uint64), *columns], text, length)
        r.key = anchor_keys(text, r.begin + r.off)
        return r

    def sent_runs(runs: list[np.ndarray]):
        return routed(0, bucket_of(doc_hash(runs[0], runs[1]), doc_buckets), runs)

    def cut_finer(r: Records):
        cut = split_up(r, WIDTHS[round_ + 1], length)
        return routed(1, bucket_of(cut.key, buckets), [cut.key, cut.doc, cut.sub, cut.first, cut.count, cut.off], cut.bytes_of)

    def compact(r: Records, final: bool):
        out = []
        if final and not round_ and (known := np.isin(r.key, frequent)).any():
            passed, extra = collapsed(r.take(np.flatnonzero(known)), False)
            out += [sent_runs(extra)] if extra else []
            out.append(cut_finer(passed))
            r = r.take(np.flatnonzero(~known))
        r, extra = collapsed(r, final)
        out += [sent_runs(extra)] if extra else []
        if round_ + 1 < len(WIDTHS) and len(r.key):
            _, inverse, seen = np.unique(r.key, return_inverse=True, return_counts=True)
            heavy = seen[inverse] > hot
            if heavy.any():
                out.append(cut_finer(r.take(np.flatnonzero(heavy))))
                return r.take(np.flatnonzero(~heavy)), out, set(r.key[heavy].tolist())
        return r, out, set()

    def blocks(r: Records):
        order = np.argsort(r.key, kind="stable")
        size, begin = np.cumsum((r.end - r.begin)[order]), 0
        key = r.key[order]
        while begin < len(order):
            stop = int(np.searchsorted(size, (size[begin - 1] if begin else 0) + BLOCK_TEXT))
            stop = int(np.searchsorted(key, key[min(stop, len(key) - 1)], "right"))
            yield r.take(order[begin:stop])
            begin = stop

    def finish(r: Records):
        for x in blocks(r):
            count = x.count.astype(np.int64)
            who = np.repeat(np.arange(len(count)), count)
            start = x.first[who] + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            order = np.lexsort((start, x.sub[who], x.doc[who]))
            d, s, p = x.doc[who][order], x.sub[who][order], start[order]
            rank = np.empty(len(who), np.int64)
            rank[order] = np.cumsum(np.concatenate([[False], (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (p[1:] != p[:-1])]))
            hit = later_windows(x.text, x.begin, count, rank, length)
            head = hit & ~np.concatenate([[False], hit[:-1] & (who[1:] == who[:-1])])
            if head.any():
                at = np.flatnonzero(head)
                number = np.cumsum(head)[hit] - 1
                yield from sent_runs([x.doc[who[at]], x.sub[who[at]], start[at], np.bincount(number)])

    def one(blobs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        held: list[Records] = []
        size, limit, heavy = 0, 2 * PART_RAW, set()
        for blob in blobs:
            r = received(blob)
            if heavy and (known := np.isin(r.key, np.fromiter(heavy, np.uint64))).any():
                yield from cut_finer(r.take(np.flatnonzero(known)))
                r = r.take(np.flatnonzero(~known))
            held.append(r)
            size += len(r.text)
            if size > limit:
                r, out, more = compact(Records.joined(held), False)
                for x in out:
                    yield from x
                heavy |= more
                held, size = [r], len(r.text)
                limit = max(limit, 2 * size)
        r, out, _ = compact(Records.joined(held), True)
        for x in out:
            yield from x
        yield from finish(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from per_bucket(batches, one)

    return run


def per_bucket(batches: Iterator[pa.RecordBatch], one, numbered: bool = False) -> Iterator[pa.RecordBatch]:
    """Call one(blobs), or one(bucket, blobs) if numbered, for each run of rows with the same bucket; blobs are read as they are asked for."""
    rows = ((bucket, blob) for b in batches for bucket, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        bucket = ahead[0]

        def own(bucket=bucket):
            nonlocal ahead
            while ahead is not None and ahead[0] == bucket:
                blob, ahead = ahead[1], next(rows, None)
                yield blob

        yield from one(bucket, own()) if numbered else one(own())


def doc_hash(doc: np.ndarray, sub: np.ndarray) -> np.ndarray:
    return mixed(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + sub)


def emit_texts(doc_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[tuple] = []
        texts: list[bytes] = []
        size = 0

        def flush():
            doc, sub = np.array([d for d, _ in ids], np.int64), np.array([s for _, s in ids], np.int64).view(np.uint64)
            sizes = np.array([len(t) for t in texts], np.int64)
            return routed(1, bucket_of(doc_hash(doc, sub), doc_buckets), [doc, sub, sizes], lambda rows: b"".join([texts[i] for i in rows.tolist()]))

        for b in batches:
            for doc, sub, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                ids.append((doc, sub))
                texts.append(text)
                size += len(text)
                if size > 16 << 20:
                    yield from flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield from flush()

    return run


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def removed_spans(first: np.ndarray, count: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of bytes covered by windows that start at first .. first + count - 1."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], first[order] + count[order] + length - 1
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    return list(zip(begin[new].tolist(), reach[np.concatenate([new[1:], [True]])].tolist(), strict=True))


def apply_runs(length: int, keep_bytes: bool, no_id: int | None, shift: int):
    """Reads blocks sorted by bucket and kind: the runs of a bucket come first, then its texts, one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, index = None, [], {}
        for b in batches:
            for kind, now, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if now != bucket:
                    bucket, parts, index = now, [], None
                if kind == 0:
                    parts.append(unpack(blob, RUN)[0])
                    continue
                if index is None:
                    index = {}
                    if parts:
                        doc, sub, first, count = (np.concatenate(c) for c in zip(*parts, strict=True))
                        order = np.lexsort((sub, doc))
                        cuts = np.flatnonzero((np.diff(doc[order]) != 0) | (np.diff(sub[order]) != 0)) + 1
                        index = {(int(doc[rows[0]]), int(sub[rows[0]])): (first[rows], count[rows]) for rows in np.split(order, cuts)}
                (doc, sub, sizes), payload = unpack(blob, [np.int64, np.uint64, np.int64])
                ends = np.cumsum(sizes)
                out, size = [], 0
                for d, s, a, e in zip(doc.tolist(), sub.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                    spans = removed_spans(*index[d, s], length) if (d, s) in index else []
                    kept, at = [], a
                    for x, y in spans:
                        kept.append(payload[at : a + x])
                        at = a + y
                    kept.append(payload[at:e])
                    kept = b"".join(kept)
                    out.append((None if d == no_id else d + shift, e - a, e - a - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in spans], kept if keep_bytes else None))
                    size += len(kept) if keep_bytes else 100
                    if size > 4 << 20:
                        yield batch_of(KEPT, *zip(*out, strict=True))
                        out, size = [], 0
                if out:
                    yield batch_of(KEPT, *zip(*out, strict=True))

    return run


def dedup(docs: DataFrame, length: int = 100, hot: int = 20_000, keep_bytes: bool = False, chunk: int = TEXT_CHUNK, frequent: int = FREQUENT, salts: int = SALTS) -> DataFrame:
    """Remove repeated strings of `length` bytes from the texts of docs (doc_id, text, any other columns).

    Returns one row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (maximal removed runs,
    byte offsets, end exclusive) and kept (remaining bytes if keep_bytes, else null; a cut can fall within a
    character). A null text is empty. Documents come in the order of doc_id, null last; texts that share a doc_id
    come in the order of their hash; rows equal in both are one document and get the same result. Texts shorter than
    `length` lose nothing. An empty table gives an empty result. hot, chunk (bytes looked through at once, a text or more),
    frequent and salts deal out the work and change no result.
    """
    spark = docs.sparkSession
    prepare(spark)
    if not ANCHOR < length <= 128:
        raise ValueError(f"length must be over {ANCHOR} and at most 128")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    known = docs.agg(F.count("*"), F.count("doc_id"), F.sum(F.octet_length("text")), F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    ids = docs.select("doc_id").distinct().count() if known[0] else 0
    sub = F.lit(0).cast("long") if ids == known[0] == known[1] else F.xxhash64(text)
    # rows without an id come last, at the largest number; where that is an id itself, all ids move down by one
    no_id, shift = (None, 0) if known[0] == known[1] else (int(NO_ID), int(known[4] == NO_ID))
    if shift and known[3] == -NO_ID - 1:
        raise ValueError("ids from the least to the largest number leave no room for rows without one")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long") - shift, F.lit(int(NO_ID))).alias("doc"), sub.alias("sub"), text.alias("text"))
    total = known[2] or 0
    parts = partitions_for(4 * total, PART_RAW, 4)
    buckets, doc_parts = 2 * parts, partitions_for(total, 16 << 20, 4)
    doc_buckets = 2 * doc_parts
    routed_type = "kind int, bucket long, blob binary"
    long_enough = rows.where(F.octet_length("text") >= length)
    often = frequent_anchors(long_enough, total, length, chunk, frequent)
    records = long_enough.mapInArrow(trimmed(emit_records(length, buckets, chunk, often, salts)), routed_type)
    runs, round_ = None, 0
    while True:
        solved = dealt(records, parts).sortWithinPartitions("bucket").mapInArrow(trimmed(resolve(length, buckets, doc_buckets, round_, hot, often)), routed_type)
        solved = checkpoint(solved)
        own = solved.where("kind = 0")
        runs = own if runs is None else runs.unionByName(own)
        records = solved.where("kind = 1")
        round_ += 1
        if round_ == len(WIDTHS) or records.isEmpty():
            break
    texts = rows.mapInArrow(trimmed(emit_texts(doc_buckets)), routed_type)
    both = dealt(runs.unionByName(texts), doc_parts).sortWithinPartitions("bucket", "kind")
    return both.mapInArrow(trimmed(apply_runs(length, keep_bytes, no_id, shift)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary")
