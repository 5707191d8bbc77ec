"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are TF-IDF vectors over their own words, the document frequencies being counted over all
documents. A randomised SVD, whose products with the passage matrix are sums over distributed rows, gives the
latent space of about ``RANK`` items, with a dimension for each, so every item keeps its whole norm in it. Windows of each whole document are projected into it; a window
whose cosine with an item, over the words that its block of the benchmark knows, is at least ``CANDIDATE`` is a
candidate. Words outside do not count, so neither other vocabulary nor the number of documents makes it stricter.

Every candidate is checked; none stands for the others. It is a leak if the longest common subsequence of the item and
the document's words around the window has at least ``MATCH`` of the item's words (so small changes, dropped and added words do not hide
it) and at least ``ANSWER`` of the words of its last sentence, which holds the answer.

Words are counted for blocks of ``BLOCK`` items in one pass; each block has a space for about every ``RANK`` of
its items.

Defined results: null and empty texts and items match nothing; items with fewer words than ``LEAST_WORDS``
match only word for word; repeated rows and items are judged one by one; ids of either side may be null and of any
type; without an item nothing is found; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches

#: About so many items share a latent space.
RANK = 256
OVERSAMPLE = 16
POWER_STEPS = 2
BLOCK = 2_000
#: Window lengths are this times powers of three, from that of the shortest to that of the longest item: an item
#: fills a third of some window, or is filled by a third of it.
WINDOW = 16
CANDIDATE = 0.45
MATCH = 0.6
ANSWER = 0.5
LEAST_WORDS = 8
#: Texts of about so many characters together are cut into words at once.
SLICE = 4_000_000
#: Models that go to a task together.
SENT = 8
#: Windows that start within so many words are projected together.
STRETCH = 2_048
SENTENCE = re.compile(r"[.!?]+\s+")
EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»“”‘’„…¿¡"


def word(token: str) -> str:
    return token.strip(EDGE)


def words(text: str | None) -> list[str]:
    return [w for t in (text or "").lower().split() if (w := word(t))]


def split(texts: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """``words`` of each text, by Arrow: the number of the first text of a slice, the slice's words, and where each of its texts begins and ends."""
    # Stripped, as Arrow reads beyond the end of a text that ends in white space, and may then leave it in the last word.
    lowered = [(t or "").lower().strip() for t in texts.to_pylist()]
    upto = np.r_[0, np.cumsum([len(t) for t in lowered], dtype=np.int64)]
    first = 0
    while first < len(lowered):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + SLICE, "right")) - 1)
        tokens = pc.utf8_split_whitespace(pa.array(lowered[first:last], pa.string()))
        found = pc.utf8_trim(tokens.flatten(), EDGE)
        some = pc.not_equal(found, "")
        at = np.r_[0, np.cumsum(some.to_numpy(zero_copy_only=False))]
        offsets = tokens.offsets.to_numpy()
        yield first, found.filter(some), at[offsets - offsets[0]]
        first = last


class Vocabulary:
    """Numbers of words: the benchmark word's, or ``unknown``."""

    def __init__(self, names: dict[str, int]):
        self.names, self.unknown = pa.array(sorted(names, key=names.__getitem__), pa.string()), len(names)

    def numbers(self, found: pa.Array) -> np.ndarray:
        return pc.index_in(found, value_set=self.names).fill_null(self.unknown).to_numpy()

    def ids(self, text: str | None) -> np.ndarray:
        return next(self.numbers(found) for _, found, _ in split(pa.array([text], pa.string())))


class Model:
    """A block of items and its latent space."""

    def __init__(self, items: list[tuple], names: dict[str, int], idf: np.ndarray, basis: np.ndarray):
        self.ids = [i for i, _ in items]
        self.names, self.idf = names, idf
        self.words = [words(t) for _, t in items]
        self.numbers = [np.array([names[w] for w in ws], np.int32) for ws in self.words]
        # The last sentence, or what there is.
        self.answers = []
        for _, t in items:
            parts = [p for p in SENTENCE.split((t or "").strip()) if words(p)]
            self.answers.append(len(words(parts[-1])) if parts else 0)
        latent = np.array([(basis[n] * idf[n, None]).sum(0) for n in self.numbers]) if items else np.zeros((0, basis.shape[1]))
        norms = np.linalg.norm(latent, axis=1, keepdims=True)
        self.latent = (latent / np.where(norms > 0, norms, 1)).astype(np.float32)
        # Of each word, what it adds to the product with each item in the latent space.
        self.loaded = ((basis * idf[:-1, None]) @ self.latent.T.astype(np.float64)).astype(np.float32)
        longest, shortest = max(map(len, self.words), default=0), min((len(w) for w in self.words if w), default=WINDOW)
        self.windows = [WINDOW, 3 * WINDOW]
        while self.windows[-1] < longest:
            self.windows.append(3 * self.windows[-1])
        while self.windows[0] > 3 * shortest:
            self.windows.insert(0, self.windows[0] // 3)
        # A window of less weight has no candidate cosine, even if all its words are the item's most frequent one.
        self.floor = min((CANDIDATE**2 * float(((c * idf[at]) ** 2).sum()) / int(c.max()) ** 2 for at, c in (np.unique(n, return_counts=True) for n in self.numbers) if len(at)), default=0.0)


def tf_idf(numbers: np.ndarray, idf: np.ndarray) -> np.ndarray:
    row = np.bincount(numbers, weights=idf[numbers], minlength=len(idf) - 1)[: len(idf) - 1]
    norm = np.linalg.norm(row)
    return row / norm if norm else row


def frequencies(docs: DataFrame, names: dict[str, int]) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each word, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = Vocabulary(names), np.zeros(len(names) + 2, np.int64)
        size = len(names) + 1
        for b in batches:
            counts[-1] += b.num_rows
            for _, found, offsets in split(b.column("text")):
                pairs = np.repeat(np.arange(len(offsets) - 1) * size, np.diff(offsets)) + own.numbers(found)
                counts[:-1] += np.bincount(pc.unique(pa.array(pairs)).to_numpy() % size, minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["k", "n"])

    out = np.zeros(len(names) + 2, np.int64)
    for r in docs.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return int(out[-1]), out[:-1]


def svd_basis(items: DataFrame, names: dict[str, int], idf: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """Right singular vectors (words x rank) of the TF-IDF matrix whose rows are distributed, by randomised subspace iteration."""
    size, k = len(names), min(rank + OVERSAMPLE, len(names))

    def product(q: np.ndarray) -> np.ndarray:
        """A'(A q), summed over the tasks' rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, q.shape[1]))
            for b in batches:
                for t in b.column("text"):
                    row = tf_idf(np.array([names[w] for w in words(t.as_py())], np.int32), idf)
                    at = np.flatnonzero(row)
                    total[at] += row[at][:, None] * (row[at] @ q[at])[None, :]
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["part"])

        out = np.zeros((size, q.shape[1]))
        for r in items.mapInArrow(run, "part binary").toLocalIterator():
            out += np.frombuffer(r["part"], np.float32).reshape(out.shape)
        return out

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, k)))[0]
    for _ in range(POWER_STEPS):
        q = np.linalg.qr(product(q))[0]
    values, vectors = np.linalg.eigh(q.T @ product(q))
    order = np.argsort(values)[::-1][:rank]
    order = order[values[order] > 1e-9]
    return q @ vectors[:, order]


def in_order(items: DataFrame) -> list[tuple]:
    return sorted(((r["item_id"], r["text"]) for r in items.collect()), key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1]))


def models(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", text_col: str = "text", rank: int = RANK, block: int = BLOCK) -> list[Model]:
    """A model for about every ``rank`` items; the list is as long as the benchmark is large, never larger with the corpus."""
    texts = small_batches(docs).select(F.col(text_col).alias("text"))
    rows = benchmark.where(F.length(F.coalesce(F.col(item_text), F.lit(""))) > 0).select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    blocks = max(1, -(-rows.count() // block))
    out = []
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        held = in_order(part)
        every = {w: i for i, w in enumerate(sorted({w for _, t in held for w in words(t)}))}
        if not every:
            continue
        n, counts = frequencies(texts, every)
        spaces = -(-len(held) // rank)
        for j in range(spaces):
            share = part.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(spaces)) == j)
            items = in_order(share)
            names = {w: i for i, w in enumerate(sorted({w for _, t in items for w in words(t)}))}
            if not names:
                continue
            df = counts[[every[w] for w in names]]
            # The last entry is for words outside the benchmark, which have no weight.
            idf = np.append(np.log((n + 1) / (df + 1)) + 1, 0)
            out.append(Model(items, names, idf, svd_basis(share, names, idf, len(items))))
    return out


def common_subsequence(a: np.ndarray, masks: dict[int, int], length: int) -> int:
    """Bits of the item's positions in a longest common subsequence with ``a`` (bit-parallel), as an integer."""
    full = (1 << length) - 1
    v = full
    for x in a.tolist():
        m = masks.get(x)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return full & ~v


class Scanner:
    def __init__(self, model: Model):
        self.m = model
        self.vocabulary = Vocabulary(model.names)
        self.masks, self.places, self.counts = [], [], []
        for n in model.numbers:
            masks: dict[int, int] = {}
            for i, x in enumerate(n.tolist()):
                masks[x] = masks.get(x, 0) | 1 << i
            self.masks.append(masks)
            own, counts = np.unique(n, return_counts=True)
            self.places.append(own)
            self.counts.append(counts)
        self.least = np.array([MATCH * len(n) if len(n) >= LEAST_WORDS else max(1, len(n)) for n in model.numbers])
        self.longest = max(map(len, model.numbers), default=0)
        self.weight = model.idf**2
        self.lengths = np.array([len(n) for n in model.numbers])
        # How often each word stands in each item.
        self.held = np.zeros((len(model.names), len(model.numbers)), np.float32)
        for k, (own, counts) in enumerate(zip(self.places, self.counts)):
            self.held[own, k] = counts

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, first word, end) of windows that may have the candidate cosine, by item and in order."""
        m, n = self.m, len(ids)
        weights = np.r_[0, np.cumsum(self.weight[ids])]
        starts, ends = [], []
        for width in m.windows:
            at = np.arange(0, max(1, n - width + 1), max(1, width // 4))
            if n > width and at[-1] != n - width:
                at = np.append(at, n - width)
            to = np.minimum(at + width, n)
            held = weights[to] - weights[at]
            near = (held >= m.floor * (1 - 1e-6)) & (held > 0)
            starts.append(at[near])
            ends.append(to[near])
        starts, ends = np.concatenate(starts), np.concatenate(ends)
        out = []
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        # A word that stands repeatedly counts once each time, which is at most the norm: no cosine is taken for less.
        least = (CANDIDATE * np.sqrt(weights[ends] - weights[starts])).astype(np.float32)
        cuts = np.searchsorted(starts, np.arange(0, n + STRETCH, STRETCH))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if i == j:
                continue
            lo, hi = starts[i], ends[i:j].max()
            # Items that have too few of their words here, and around, cannot have the subsequence either.
            around = np.unique(ids[max(0, lo - self.longest) : hi + self.longest])
            own = np.flatnonzero(self.held[around[around < len(m.names)]].sum(0) >= self.least)
            if not len(own):
                continue
            inside = ids[lo:hi] < len(m.names)
            upto = np.r_[0, np.cumsum(inside)]
            sums = np.zeros((int(upto[-1]) + 1, len(own)), np.float32)
            np.cumsum(m.loaded[np.ix_(ids[lo:hi][inside], own)], axis=0, out=sums[1:])
            products = sums[upto[ends[i:j] - lo]] - sums[upto[starts[i:j] - lo]]
            at = np.flatnonzero(products >= least[i:j, None])
            if len(at):
                w, k = np.divmod(at, products.shape[1])
                out.append((own[k], starts[i + w], ends[i + w]))
        if not out:
            return (np.empty(0, np.int64),) * 3
        k, s, e = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((s, k))
        return k[order], s[order], e[order]

    def cosine(self, ids: np.ndarray, k: int) -> float:
        """Of a window and an item."""
        at, times = np.unique(ids[ids < len(self.m.names)], return_counts=True)
        return float(times @ self.m.loaded[at, k] / np.sqrt((times**2 * self.weight[at]).sum()))

    def common(self, ids: np.ndarray, k: int) -> int:
        """Bits of the item's positions in a longest common subsequence, or 0 if it holds too few of the item's words."""
        places, least = self.places[k], self.least[k]
        at = np.minimum(np.searchsorted(places, ids), len(places) - 1)
        own = places[at] == ids
        if np.minimum(np.bincount(at[own], minlength=len(places)), self.counts[k]).sum() < least:
            return 0
        found = common_subsequence(ids[own], self.masks[k], len(self.m.numbers[k]))
        return found if found.bit_count() >= least else 0

    def hits(self, text: str | None) -> list[tuple]:
        """(item, cosine, share of words matched, share of answer matched, first word, last word) by item."""
        return self.found(self.vocabulary.ids(text))

    def all_hits(self, found: pa.Array, offsets: np.ndarray) -> Iterator[list[tuple]]:
        """The ``hits`` of each text of a slice of ``split``."""
        ids = self.vocabulary.numbers(found)
        for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            yield self.found(ids[i:j])

    def found(self, ids: np.ndarray) -> list[tuple]:
        m, n = self.m, len(ids)
        if not n:
            return []
        items, starts, ends = self.candidates(ids)
        if not len(items):
            return []
        lows, highs = np.maximum(0, starts - self.lengths[items]), np.minimum(n, ends + self.lengths[items])
        # Windows whose surroundings overlap are first checked as one: what that lacks, none of them has.
        apart = items * (n + 1)
        upto = np.maximum.accumulate(highs + apart)
        first = np.flatnonzero(np.r_[True, (lows + apart)[1:] >= upto[:-1]])
        last = np.r_[first[1:], len(items)]
        best: dict[int, tuple] = {}
        for i, j, k, lo, hi in zip(first.tolist(), last.tolist(), items[first].tolist(), lows[first].tolist(), (upto[last - 1] - apart[first]).tolist()):
            whole = self.common(ids[lo:hi], k)
            if not whole:
                continue
            length, answer = len(m.numbers[k]), m.answers[k]
            for s, e, lo, hi in zip(*(x[i:j].tolist() for x in (starts, ends, lows, highs))):
                found = whole if j == i + 1 else self.common(ids[lo:hi], k)
                if not found:
                    continue
                share = found.bit_count() / length
                answered = (found >> (length - answer)).bit_count() / answer if answer else 1.0
                if answered >= ANSWER and (k not in best or (share, answered) > best[k][:2]):
                    best[k] = (share, answered, lo, hi, s, e)
        return [(m.ids[k], self.cosine(ids[s:e], k), share, answered, lo, hi) for k, (share, answered, lo, hi, s, e) in best.items()]


def sent(spark, models_: list[Model]) -> list:
    """The models as broadcasts of at most ``SENT`` of them, whatever the size of the benchmark."""
    return [spark.sparkContext.broadcast(models_[i : i + SENT]) for i in range(0, len(models_), SENT)]


def leaks(docs: DataFrame, models_: list[Model], id_col: str = "doc_id", text_col: str = "text", item_type: str = "long") -> DataFrame:
    """A row per document and item that it holds: doc_id, item_id, cosine, matched, answer_matched.

    Each part of the benchmark is a scan of its own, so a task holds the models of one part only."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("item_id", T._parse_datatype_string(item_type)), *(T.StructField(c, T.DoubleType()) for c in ("cosine", "matched", "answer_matched"))])
    item = to_arrow_type(schema["item_id"].dataType)

    def part(table):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [Scanner(m) for m in table.value]
            for b in batches:
                at, found = [], []
                for first, *texts in split(b.column("text")):
                    for s in own:
                        for i, hits in enumerate(s.all_hits(*texts), first):
                            at += [i] * len(hits)
                            found += hits
                target = b.column("doc_id").take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([target, pa.array([h[0] for h in found], item), *(pa.array([h[j] for h in found], pa.float64()) for j in (1, 2, 3))], names=["doc_id", "item_id", "cosine", "matched", "answer_matched"])

        return rows.mapInArrow(run, schema)

    out = None
    for table in sent(docs.sparkSession, models_):
        out = part(table) if out is None else out.unionByName(part(table))
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, models_: list[Model], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; in one pass over the texts, without a join."""

    def part(rows: DataFrame, table) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [Scanner(m) for m in table.value]
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for first, *texts in split(b.column(text_col)):
                    for s in own:
                        for i, hits in enumerate(s.all_hits(*texts), first):
                            keep[i] &= not hits
                yield b.filter(pa.array(keep))

        return rows.mapInArrow(run, rows.schema)

    out = docs
    for table in sent(docs.sparkSession, models_):
        out = part(out, table)
    return out
