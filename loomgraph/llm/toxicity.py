"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct lower-case words of the whole text and their leading 4 to 7 letters (so inflected
forms share a term), hashed to ``SPACE`` buckets. The score is the logistic of

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

with x_i = 1 for terms present, so a pair such as an insult with a mention of a group has a weight of its
own. Buckets that fewer than ``SUPPORT`` training documents hold are left out. Of the others, those take part whose
rates in both labels differ by ``SIGNAL`` standard errors, be it among all documents or among those that hold
a bucket of the first kind: a term that is as frequent in clean texts as in toxic ones, but not beside an insult, is in.
The model is fitted on at most ``MAX_LABELLED`` labelled documents, chosen by hash and with both labels drawn alike up to half
of it; of rows with one id, one is taken.

Defined results: null and empty texts get the score of no terms (the intercept); words are whole, texts are
whole; without labels of both kinds every score is 0; repeated rows get equal scores; of several labels of
one document the highest counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SPACE = 1 << 22
MAX_LABELLED = 12_000
SUPPORT = 4
#: Standard errors between the rates in both labels, at least.
SIGNAL = 5.0
RANK = 8
EPOCHS = 30
WORD = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6, 7)
MAX_KEPT = 300_000


def terms(word: str) -> list[int]:
    """Buckets of a word and of its leading letters."""
    out = [xxhash.xxh32_intdigest(word) % SPACE]
    out += [xxhash.xxh32_intdigest(word[:n] + "-") % SPACE for n in PREFIXES if len(word) > n]
    return out


def buckets(text: str | None, kept: dict[str, list[int]]) -> list[int]:
    """Distinct buckets of a text; ``kept`` is a table of words seen before."""
    found: set[int] = set()
    for word in set(WORD.findall((text or "").lower())):
        own = kept.get(word)
        if own is None:
            own = terms(word)
            if len(kept) < MAX_KEPT:
                kept[word] = own
        found.update(own)
    return sorted(found)


class Machine:
    """w0, weights and factors of the active buckets."""

    def __init__(self, active: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.active, self.w0, self.w, self.v = active, w0, w, v
        self.index = {int(b): i for i, b in enumerate(active)}
        self.kept: dict[str, tuple[int, ...]] = {}

    def logit(self, ids: np.ndarray) -> float:
        if not len(ids):
            return self.w0
        v = self.v[ids]
        s = v.sum(0)
        return float(self.w0 + self.w[ids].sum() + 0.5 * (s @ s - (v * v).sum()))

    def score(self, text: str | None) -> float:
        found: set[int] = set()
        kept, index = self.kept, self.index
        for word in set(WORD.findall((text or "").lower())):
            own = kept.get(word)
            if own is None:
                own = tuple(i for b in terms(word) if (i := index.get(b)) is not None)
                if len(kept) < MAX_KEPT:
                    kept[word] = own
            found.update(own)
        z = self.logit(np.fromiter(found, dtype=np.int64, count=len(found)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def differing(n: np.ndarray, pos: np.ndarray, docs: int, toxic: float) -> np.ndarray:
    """Buckets with enough support whose rates differ between the labels, in order; n, pos: how many of ``docs`` documents, and of its ``toxic`` ones, hold each."""
    some = np.flatnonzero(n >= SUPPORT)
    n, pos = n[some].astype(np.int64), pos[some].astype(float)
    n1, n0 = max(toxic, 1), max(docs - toxic, 1)
    p = n / docs
    z = (pos / n1 - (n - pos) / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    return some[np.abs(z) >= SIGNAL]


def holding(rows: Iterable[np.ndarray], space: int) -> np.ndarray:
    """How many rows hold each bucket."""
    n = np.zeros(space, np.int32)
    for r in rows:
        n[r] += 1  # a row's buckets are distinct
    return n


def numbered(rows: list[np.ndarray], kept: np.ndarray, space: int) -> list[np.ndarray]:
    """The rows with the places of their buckets in ``kept``; others are left out."""
    at = np.full(space, -1, np.int32)
    at[kept] = np.arange(len(kept))
    return [x[x >= 0] for r in rows for x in (at[r],)]


def informative(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets that differ between the labels, alone or beside one that does, in order.

    Rows are counted one by one: the driver holds them and their supported buckets, no table of all their terms.
    """
    space = 1 + max((int(r.max()) for r in rows if len(r)), default=-1)
    n = holding(rows, space)
    # A bucket too rare among all documents is too rare beside any other.
    supported = np.flatnonzero(n >= SUPPORT)
    n, rows, toxic = n[supported], numbered(rows, supported, space), y > 0
    space = len(supported)
    alone = differing(n, holding((rows[i] for i in np.flatnonzero(toxic)), space), len(rows), float(toxic.sum()))
    found = [alone]
    held = numbered(rows, alone, space)
    flat, doc = np.concatenate([np.empty(0, np.int32), *held]), np.repeat(np.arange(len(rows), dtype=np.int32), [len(h) for h in held])
    doc = doc[np.argsort(flat, kind="stable")]
    for holders in np.split(doc, np.cumsum(n[alone])[:-1]) if len(alone) else ():
        bad = holders[toxic[holders]]
        if 0 < len(bad) < len(holders):
            found.append(differing(holding((rows[i] for i in holders), space), holding((rows[i] for i in bad), space), len(holders), float(len(bad))))
    return supported[np.unique(np.concatenate(found))]


def fit(rows: list[np.ndarray], y: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, seed: int = 5) -> Machine:
    """Adagrad on mini-batches; squared weights are held down."""
    rng = np.random.default_rng(seed)
    active = informative(rows, y)
    m = len(active)
    ids = numbered(rows, active, 1 + max((int(r.max()) for r in rows if len(r)), default=-1))
    w0 = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    w, v = np.zeros(m), rng.normal(0, 0.01, (m, rank))
    gw, gv, g0 = np.full(m, 1e-2), np.full((m, rank), 1e-1), 1.0
    order = np.arange(len(rows))
    for _ in range(epochs):
        rng.shuffle(order)
        for start in range(0, len(order), 64):
            batch = order[start : start + 64]
            sizes = np.array([len(ids[i]) for i in batch])
            flat = np.concatenate([ids[i] for i in batch])
            doc = np.repeat(np.arange(len(batch)), sizes)
            vf = v[flat]
            sums = np.vstack([np.zeros(rank), np.cumsum(vf, 0)])
            ends = np.cumsum(sizes)
            s = sums[ends] - sums[ends - sizes]
            sq = np.bincount(doc, weights=(vf * vf).sum(1), minlength=len(batch))
            z = w0 + np.bincount(doc, weights=w[flat], minlength=len(batch)) + 0.5 * ((s * s).sum(1) - sq)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]
            step = error.sum() / len(batch)
            g0 += step**2
            w0 -= 0.05 * step / np.sqrt(g0)
            if not len(flat):
                continue
            turn = np.argsort(flat, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(flat[turn]) > 0])
            used = flat[turn][at]
            dw = np.add.reduceat(error[doc][turn], at) + 2e-2 * w[used]
            dv = np.add.reduceat((error[doc][:, None] * (s[doc] - vf))[turn], at, axis=0) + 5e-2 * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= 0.1 * dw / np.sqrt(gw[used])
            v[used] -= 0.02 * dv / np.sqrt(gv[used])
    return Machine(active, w0, w, v)


def choose(marked: DataFrame, label: Column, key: Column, max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, dict[int, int]] | None:
    """At most ``max_labelled`` keys, those of the least hashes, up to half of it of each label, and how many there are of each."""
    rows = marked.where(label.isNotNull()).select(key.alias("key"), (label > 0).cast("int").alias("y"), F.xxhash64(F.lit(3), key).alias("h"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0, 1}:
        return None
    some = [rows.where(F.col("y") == k).orderBy("h", "key").limit(max_labelled // 2).select("key", "y") for k in (0, 1)]
    return some[0].unionByName(some[1]), counts


def learn(docs: DataFrame, chosen: tuple[DataFrame, dict[int, int]] | None, id_col: str = "doc_id", text_col: str = "text") -> Machine | None:
    """Fit on the documents of the chosen keys; None without labels of both kinds."""
    if chosen is None:
        return None
    keys, counts = chosen
    # At most MAX_LABELLED keys: small enough to send to every task. Of rows with one key, the least text counts.
    drawn = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(keys), "key").groupBy("key", "y").agg(F.min("text").alias("text")).select("text", "y")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[int]] = {}
        for b in batches:
            found = pa.array([np.array(buckets(t.as_py(), kept), dtype=np.int32).tobytes() for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([found, b.column("y")], names=["terms", "y"])

    got = drawn.mapInArrow(hashed, "terms binary, y int").toArrow()
    rows_ = sorted(zip(got.column("terms").to_pylist(), got.column("y").to_pylist()))  # the same whatever the order of tasks
    del got
    y = np.array([k for _, k in rows_], dtype=float)
    if not 0 < y.sum() < len(y):
        return None
    machine = fit([np.frombuffer(t, dtype=np.int32) for t, _ in rows_], y)
    # Both labels were drawn up to a bound of their own; the intercept returns to their true ratio.
    machine.w0 += np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return machine


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score."""
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if machine is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    parts = (machine.active, machine.w0, machine.w, machine.v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(*parts)
        for b in batches:
            s = pa.array([own.score(t.as_py()) for t in b.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), s], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
