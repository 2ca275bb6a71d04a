"""URL filtering: allow and block rules on hosts and paths, and gradient-boosted trees for the urls that no rule fits.

The trees see lexical features only: lengths, depth, digit ratio, entropy, counts of parameters, hyphens and
subdomains, and how often urls of the same host suffix are blocked among the labelled ones (for a labelled url: among
those of the other folds). They are fitted to labelled urls: those that the rules decide, a bounded sample of `sample_urls` of least
hash.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm._common import batch_of, prepare, trimmed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NAMES = ("url_length", "host_length", "path_length", "query_length", "depth", "digit_ratio", "host_entropy", "path_entropy", "parameters", "hyphens", "labels", "suffix_blocked", "domain_blocked")
#: Weight of the overall rate in a suffix's rate.
SMOOTH = 5.0
#: Labelled urls are dealt into so many folds by their text; the rates that a fold learns with are those of the others.
FOLDS = 5


def host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, with A-Z in lower case; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ? or #; empty without a host's ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule (verdict, host, path) that fits, both null without one; of equal length the first in text order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def suffixes(name: str) -> tuple[str, str]:
    """The last label and the last three (a registrable part and what stands before it)."""
    labels = name.split(".")
    return labels[-1], ".".join(labels[-3:])


def fold_of(url: str) -> int:
    return zlib.crc32(url.encode(errors="replace")) % FOLDS


class Suffixes:
    """Smoothed rates of blocked urls by host suffix."""

    def __init__(self, hosts: list[str], blocked: list[float]):
        self.rate = sum(blocked) / len(blocked) if blocked else 0.5
        self.tables: list[dict[str, float]] = []
        for names in zip(*map(suffixes, hosts), strict=True) if hosts else ((), ()):
            n, bad = Counter(names), Counter()
            for s, b in zip(names, blocked, strict=True):
                bad[s] += b
            self.tables.append({s: (bad[s] + SMOOTH * self.rate) / (n[s] + SMOOTH) for s in n})

    def of(self, name: str) -> list[float]:
        return [t.get(s, self.rate) for t, s in zip(self.tables, suffixes(name), strict=True)]


def lexical(url: str, host: str, path: str) -> list[float]:
    query = url.partition("?")[2].partition("#")[0]
    return [
        len(url), len(host), len(path), len(query), sum(1 for p in path.split("/") if p), sum(map(str.isdigit, url)) / max(1, len(url)),
        entropy(host), entropy(path), sum(1 for p in query.split("&") if p), host.count("-"), host.count(".") + 1,
    ]


class Trees:
    """Boosted regression trees on the logistic loss, on features cut into at most `bins` quantile bins."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = math.log(mean / (1 - mean))
        cuts = [np.unique(np.quantile(c, np.arange(1, self.bins) / self.bins)) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree: list = []
            score += self.rate * self._grow(tree, binned, cuts, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
        return self

    def _grow(self, tree: list, binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
        """Append the subtree of rows to tree, as [feature, cut, left, right] or [value]; gives each row's value (0 elsewhere)."""
        node = len(tree)
        g, h = float(grad[rows].sum()), float(hess[rows].sum())
        tree.append([g / (h + self.ridge)])
        best = (1e-6, -1, -1)
        for f in range(len(cuts)) if depth else ():
            size = len(cuts[f]) + 1
            gl = np.cumsum(np.bincount(binned[f, rows], grad[rows], size))[:-1]
            hl = np.cumsum(np.bincount(binned[f, rows], hess[rows], size))[:-1]
            gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
            gain[(hl < self.least) | (h - hl < self.least)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
        out = np.zeros(len(grad))
        if best[1] < 0:
            out[rows] = tree[node][0]
            return out
        _, f, cut = best
        left = binned[f, rows] <= cut
        tree[node] = [f, float(cuts[f][cut]), len(tree), 0]
        out += self._grow(tree, binned, cuts, grad, hess, rows[left], depth - 1)
        tree[node][3] = len(tree)
        return out + self._grow(tree, binned, cuts, grad, hess, rows[~left], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of each row of features."""
        score = np.full(len(x), self.start)
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                for node in np.unique(at).tolist():
                    if len(tree[node]) == 4:
                        f, cut, left, right = tree[node]
                        own = at == node
                        at[own] = np.where(x[own, f] <= cut, left, right)
            score += self.rate * np.array([t[0] if len(t) == 1 else 0.0 for t in tree])[at]
        return 1 / (1 + np.exp(-score))


class Filter:
    """The fitted suffix table and trees."""

    def __init__(self, labelled: list[tuple[str, str, str, bool]]):
        y = [float(b) for *_, b in labelled]
        self.suffixes = Suffixes([h for _, h, _, _ in labelled], y)
        self.trees = Trees()
        if len(set(y)) > 1:
            folds = [fold_of(r[0]) for r in labelled]
            others = [Suffixes([r[1] for r, g in zip(labelled, folds, strict=True) if g != f], [b for b, g in zip(y, folds, strict=True) if g != f]) for f in range(FOLDS)]
            self.trees.fit(features([r[:3] for r in labelled], [others[f] for f in folds]), np.array(y))
        else:  # one kind of label or none: nothing to learn from
            self.trees.start = -1.0 if not y or not y[0] else 1.0

    def blocked(self, rows: list[tuple[str, str, str]]) -> np.ndarray:
        return self.trees.predict(features(rows, [self.suffixes] * len(rows)))


def features(rows: list[tuple[str, str, str]], rates: list[Suffixes]) -> np.ndarray:
    """Of each (url, host, path), with the suffix rates to use for it."""
    return np.array([lexical(*r) + t.of(r[1]) for r, t in zip(rows, rates, strict=True)], float).reshape(len(rows), len(NAMES))


JUDGED = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("block_score", pa.float64())])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], sample_urls: int = 20_000) -> DataFrame:
    """Allow or block each url of pages (page_id, url, any other columns).

    rules: (verdict, host, path), a bounded list. Returns one row per row of pages: page_id, host, path, rule (null
    if none fits), verdict, block_score (the trees' probability; null where a rule decides). A null url or one
    without :// has empty host and path and goes by the trees. Without labelled urls of both kinds the verdict is
    that of the labelled ones, or allow. An empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    url = F.col("url")
    rule, verdict = matched_rule(rules, F.col("host"), F.col("path"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(url, F.lit("")).alias("url"), host(url).alias("host"), path(url).alias("path"))
    ruled = split.withColumns({"rule": rule, "verdict": verdict})
    sample = ruled.where("rule is not null").select("url", "host", "path", (F.col("verdict") == "block").alias("b")).distinct()
    span, total = 1 << 30, sample.count()
    share = min(1.0, sample_urls / max(1, total))  # so that each task sends its part of the sample, not a whole one
    near = sample.where(F.pmod(F.xxhash64("url"), F.lit(span)) < F.lit(int(share * span) + 1))
    labelled = [tuple(r) for r in near.orderBy(F.xxhash64("url"), "url").limit(sample_urls).collect()]
    sent = pages.sparkSession.sparkContext.broadcast(Filter(labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            page, url, name, where, rule, verdict = (c.to_pylist() for c in b.columns)
            free = [i for i, r in enumerate(rule) if r is None]
            score: list[float | None] = [None] * len(page)
            if free:
                for i, s in zip(free, model.blocked([(url[i], name[i], where[i]) for i in free]).tolist(), strict=True):
                    score[i], verdict[i] = s, "block" if s > 0.5 else "allow"
            yield batch_of(JUDGED, page, name, where, rule, verdict, score)

    return ruled.mapInArrow(trimmed(run), "page_id long, host string, path string, rule string, verdict string, block_score double")
