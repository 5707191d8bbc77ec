"""N-gram Jaccard join by a token-group matrix.

Documents are sets of hashed 5-word shingles; two link when their Jaccard similarity is at least 0.8. Equal
sets are one class from the start. The join is exact: no bucket, group or candidate list has a cap.

1. Order. A table of the most frequent shingles (bounded in size; it orders, it does not decide) lets each
   class keep a prefix of its rarest ``n - ceil(0.8 n) + SHARED`` shingles. Of a pair that links, one lies wholly
   behind its prefix with no more than the rest of the larger set, so the prefixes share at least
   ``ceil(4 (n + m) / 9)`` less that rest (``least_shared``): about 0.09 n of them for sets of one size.
2. Columns of few. A rare shingle that at most ``FEW`` classes hold opens them at once: its holders that agree
   in size meet in pairs, which are at most ``FEW * (FEW - 1) / 2`` a shingle however large the corpus.
   Only shingles with more holders (common ones) need groups, and only classes that hold ``SHARED`` of them:
   a pair that shares a rare shingle of few holders is among the pairs already. Common shingles with the same
   holders are one column, with their number as its weight.
3. Groups. Of the classes that share a common shingle, the most central leads: the one with the largest part
   of its rare shingles common, as an original has whose copies each have changes of their own. Each class
   is checked exactly against one leader, that which most classes could follow, in streams that hold one leader's
   set at a time; connected components of all links found so far are the groups of similar documents. A group
   of n copies costs n checks, not n * n.
4. Copies of one leader. Let x and y be classes that were checked against the same leader, of whose sets they hold o and p
   shingles. If they share none outside it, their overlap is at most the smaller of o and p, so they can link only
   if ``4 (n + m) / 9`` is not more than that: if m is at most ``9 o / 4 - n`` and n at most ``9 p / 4 - m`` (a class's
   ``room``), which for failed checks is less than the leader's size. All others must share a shingle
   outside the leader. The checks emit those shingles; classes of one leader meet on them alone
   (again by leaders first), so copies with changes of their own never meet in pairs.
5. Matrix. Rows (column, group) with the sizes of the group's members. A class and another group (of another
   leader, or with room for it) are a candidate if the columns that they share weigh what a member of its sizes needs; the groups' unions of
   whole sets then bound the overlap with each of their members, and groups whose bound is under 0.8 stay closed.
6. Opening. A class is checked exactly against those members of the groups left that share enough columns
   with it. Components of all links are the result.

Sets are hashed with 64 bits (48 in the exact check), so a false answer has odds of about 1e-9 a pair.

Defined results: null texts and texts without words are empty and link with nothing; fewer words than five
are one shingle; rows with equal ids are judged one by one; null ids are kept and never name a component
unless it has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import drop, materialise, small_batches, tidy

WIDTH = 5
#: Rare shingles that linked sets share at least.
SHARED = 4
#: A shingle with at most so many holders brings them together in pairs.
FEW = 8
#: Shingles in the table of frequent ones at most, and how often one must occur to be in it.
FREQUENT = 1 << 19
FREQUENT_AT = 8
#: How often one must occur there to be common without a count of its holders, and over how many tasks these are dealt.
COMMON_AT = 64
SALTS = 64
#: Shingles that a task holds before it counts them, and how often one must occur among them to be reported.
HELD = 1_500_000
REPORT_AT = 3
#: Bits of the filter that tells tasks which classes' sets are needed.
FILTER_BITS = 1 << 26
#: Sets checked against one copy of a leader's set.
SHARE = 2_000
#: Words, and classes, that a task remembers.
MAX_KEPT = 150_000
#: Bytes or pairs that a task gathers before it sends them on.
FLUSH = 8_000_000
PAIRS = 200_000

_mult = np.uint64(0x9E3779B97F4A7C15)
_mix = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """64-bit hashes of words; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_KEPT:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


def shingles(text: str | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    # bytes.lower() touches A-Z only, and bytes.split() splits at \\x20 and \\x09-\\x0D only.
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    h = w[: n - width + 1].copy()
    for k in range(1, width):
        h *= _mult
        h ^= h >> np.uint64(29)
        h += w[k : n - width + 1 + k]
    h ^= h >> np.uint64(32)
    h *= _mix
    h ^= h >> np.uint64(29)
    return np.unique(h)


def class_of(s: np.ndarray) -> int:
    """Identity of a set as a signed 64-bit number."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def prefix_length(n: int) -> int:
    return min(n, n - (4 * n + 4) // 5 + SHARED)


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def census(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, h, n, cls) for every document, h being its text's hash, and (tok, times) for shingles that are frequent within a task."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, held, total = WordHashes(), Seen(), [], 0

        def frequent(ids: pa.DataType) -> pa.RecordBatch:
            toks, times = np.unique(np.concatenate(held), return_counts=True)
            at = times >= REPORT_AT
            k = int(at.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(k, ids), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), signed(toks[at]), pa.array(times[at].astype(np.int32))], names=["doc_id", "h", "n", "cls", "tok", "times"])

        ids = None
        for b in batches:
            ids = b.column("doc_id").type
            sizes, classes = [], []
            for t in b.column("text"):
                s = shingles(t.as_py(), hashes, width)
                sizes.append(len(s))
                classes.append(c := class_of(s) if len(s) else None)
                if c is not None and seen.first(c):
                    held.append(s)
                    total += len(s)
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(sizes, pa.int32()), pa.array(classes, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32())], names=["doc_id", "h", "n", "cls", "tok", "times"])
            if total >= HELD:
                yield frequent(ids)
                held, total = [], 0
        if held:
            yield frequent(ids)

    return docs.withColumn("h", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind}, h long, n int, cls long, tok long, times int")


class Seen(set):
    """Classes met in a task; starts anew when full, so that some may be met again."""

    def first(self, c: int) -> bool:
        if c in self:
            return False
        if len(self) >= MAX_KEPT:
            self.clear()
        self.add(c)
        return True


class Frequent:
    """The most frequent shingles, sorted by hash, with how often each was counted."""

    def __init__(self, toks: np.ndarray, times: np.ndarray):
        self.toks, self.times = toks, times

    def rarest(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A set's prefix: shingles outside the table by hash, then those of the table, most frequent last; and which are common for sure."""
        n = prefix_length(len(s))
        if not len(self.toks):
            return s[:n], np.zeros(n, bool)
        at = np.minimum(np.searchsorted(self.toks, s), len(self.toks) - 1)
        inside = self.toks[at] == s
        rare, rest = s[~inside], s[inside]
        times = self.times[at[inside]]
        order = np.lexsort((rest, times))[: max(0, n - len(rare))]
        return np.concatenate([rare[:n], rest[order]]), np.r_[np.zeros(min(n, len(rare)), bool), times[order] >= COMMON_AT]


def frequent_table(counted: DataFrame) -> Frequent:
    top = counted.where(F.col("tok").isNotNull()).groupBy("tok").agg(F.sum("times").alias("n")).where(F.col("n") >= FREQUENT_AT).orderBy(F.desc("n"), "tok").limit(FREQUENT).toArrow()
    toks = top.column("tok").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(toks)
    return Frequent(toks[order], top.column("n").to_numpy().astype(np.int64)[order])


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sizes are close enough for a link."""
    return (5 * a.astype(np.int64) >= 4 * b.astype(np.int64)) & (4 * a.astype(np.int64) <= 5 * b.astype(np.int64))


MEETING = ["a", "b", "an", "bn", "times", "tok"]


def counted_pairs(held: list[tuple]) -> pa.RecordBatch:
    a, b, an, bn = (np.concatenate([h[i] for h in held]) for i in range(4))
    order = np.lexsort((b, a))
    a, b, an, bn = a[order], b[order], an[order], bn[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    times = np.diff(np.r_[first, len(a)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(an[first]), pa.array(bn[first]), pa.array(times), pa.nulls(len(first), pa.int64())], names=MEETING)


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of tok, cls: pairs (a, b, times) of a token's few holders, or (tok, a, an) for each of more."""
    carry, told, held, total = None, False, [], 0

    def process(tok, cls, n, salt, told: bool, last: bool):
        """Emit the runs that are complete; returns (pairs, rows of common tokens, carry, told)."""
        first = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        size = np.diff(np.r_[first, len(tok)])
        common = (size > FEW) | (salt[first] > 0)
        common[0] |= told
        pairs = []
        closed = np.ones(len(first), bool)
        closed[-1] = last
        for k in range(2, FEW + 1):
            at = first[(size == k) & ~common & closed]
            for i in range(k) if len(at) else ():
                for j in range(i + 1, k):
                    x, y = at + i, at + j
                    ok = agree(n[x], n[y])
                    if ok.any():
                        pairs.append((cls[x[ok]], cls[y[ok]], n[x[ok]], n[y[ok]]))
        send = np.repeat(common, size)
        if told:
            send[0] = False
        rows = tok[send], cls[send], n[send]
        if last:
            return pairs, rows, None, False
        if common[-1]:
            return pairs, rows, tuple(x[-1:] for x in (tok, cls, n, salt)), True
        return pairs, rows, tuple(x[first[-1] :] for x in (tok, cls, n, salt)), False

    def batch(rows) -> pa.RecordBatch:
        tok, cls, n = rows
        k = len(tok)
        return pa.RecordBatch.from_arrays([pa.array(cls), pa.nulls(k, pa.int64()), pa.array(n), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.array(tok)], names=MEETING)

    for b in batches:
        if not b.num_rows:
            continue
        x = tuple(b.column(c).to_numpy() for c in ("tok", "cls", "n", "salt"))
        if carry is not None:
            x = tuple(np.r_[p, q] for p, q in zip(carry, x))
        new = np.r_[True, (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])]
        pairs, rows, carry, told = process(*(v[new] for v in x), told, False)
        if len(rows[0]):
            yield batch(rows)
        held += pairs
        total += sum(len(p[0]) for p in pairs)
        if total >= PAIRS:
            yield counted_pairs(held)
            held, total = [], 0
    if carry is not None and not told:
        pairs, rows, _, _ = process(*carry, False, True)
        if len(rows[0]):
            yield batch(rows)
        held += pairs
    if held:
        yield counted_pairs(held)


def met(docs: DataFrame, frequent: Frequent, width: int) -> DataFrame:
    """Rows (a, b, times) for pairs of classes that share rare shingles of few holders, and (tok, a, an) for holders of common ones.

    A pair may come several times. A shingle known to be common is dealt over several tasks, as its holders need not meet.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, own = WordHashes(), Seen(), table.value
        for b in batches:
            found, held = [], 0

            def out() -> pa.RecordBatch:
                sizes = [len(f[0]) for f in found]
                cls = np.repeat(np.array([f[2] for f in found], np.int64), sizes)
                n = np.repeat(np.array([f[3] for f in found], np.int32), sizes)
                salt = np.where(np.concatenate([f[1] for f in found]), 1 + cls % SALTS, 0).astype(np.int32)
                return pa.RecordBatch.from_arrays([signed(np.concatenate([f[0] for f in found])), pa.array(cls), pa.array(n), pa.array(salt)], names=["tok", "cls", "n", "salt"])

            for t in b.column("text"):
                s = shingles(t.as_py(), hashes, width)
                if len(s) < SHARED or not seen.first(c := class_of(s)):
                    continue
                found.append((*own.rarest(s), c, len(s)))
                held += 8 * len(found[-1][0])
                if held >= FLUSH:
                    yield out()
                    found, held = [], 0
            if found:
                yield out()

    rows = docs.mapInArrow(prefixes, "tok long, cls long, n int, salt int")
    return rows.repartition("tok", "salt").sortWithinPartitions("tok", "cls").mapInArrow(meetings, "a long, b long, an int, bn int, times int, tok long")


def behind(n: Column) -> Column:
    """How many shingles of a set its prefix leaves out."""
    return F.greatest(F.lit(0), F.floor((4 * n + 4) / 5).cast("int") - SHARED)


def least_shared(n: Column, m: Column) -> Column:
    """Shingles that the prefixes of sets of these sizes share at least if the sets link."""
    return F.ceil(4 * (n + m) / 9).cast("int") - F.greatest(behind(n), behind(m))


def columns_of(held: DataFrame) -> DataFrame:
    """(tok, cls, n, w): one of all shingles that the same classes hold, two or more, with their number; held: (tok, cls, n)."""
    # The holders' identity, from sums that tasks form before the shuffle.
    of = held.groupBy("tok").agg(F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"), F.count("*").alias("k")).where("k > 1")
    one = of.groupBy("x", "y", "k").agg(F.min("tok").alias("tok"), F.count("*").cast("int").alias("w")).select("tok", "w")
    return held.join(one, "tok")


def leaders(rows: DataFrame, least: int = SHARED) -> DataFrame:
    """Pairs (a, b): each class of rows (tok, cls, n, w) and, of the leaders that it shares ``least`` with and agrees with in size, that of most classes."""
    n, m = F.col("n"), F.col("leader_n")
    central = rows.groupBy("cls").agg(F.sum("w").alias("c"), F.max("n").alias("n")).select("cls", (F.col("c") * 1000 / (n - behind(n))).cast("int").alias("central"))
    top = rows.join(central, "cls").groupBy("tok").agg(F.max(F.struct("central", (-F.col("n")).alias("nn"), "cls")).alias("m")).select("tok", F.col("m.cls").alias("leader"), (-F.col("m.nn")).alias("leader_n"))
    fits = (F.col("cls") != F.col("leader")) & (5 * m >= 4 * n) & (4 * m <= 5 * n)
    led = rows.join(top, "tok").where(fits).groupBy("cls", "leader").agg(F.sum("w").alias("c")).where(F.col("c") >= least)
    following = led.groupBy("leader").agg(F.count("*").alias("size"))
    best = led.join(following, "leader").groupBy("cls").agg(F.max(F.struct("size", "c", "leader")).alias("m"))
    # Two classes may lead each other: one check is enough.
    pairs = best.select(F.greatest("m.leader", "cls").alias("x"), F.least("m.leader", "cls").alias("y"), F.col("m.leader").alias("a"), F.col("cls").alias("b"))
    return pairs.groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")


def needed_filter(numbers: DataFrame) -> np.ndarray:
    """A bit filter of fixed size over numbers (one column); it may let others pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: set[int] = set()
        for b in batches:
            c = b.column(0).to_numpy().view(np.uint64)
            bits.update((c % np.uint64(FILTER_BITS)).astype(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(bits), pa.int64())], names=["bit"])

    filled = np.zeros(FILTER_BITS // 8, np.uint8)
    packed = numbers.mapInArrow(run, "bit long").groupBy((F.col("bit") / 8).cast("int").alias("byte")).agg(F.bit_or(F.expr("cast(shiftleft(1, cast(bit % 8 as int)) as int)")).alias("v")).toArrow()
    filled[packed.column("byte").to_numpy()] = packed.column("v").to_numpy().astype(np.uint8)
    return filled


def sets_of(docs: DataFrame, counted: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """Rows (cls, n, bag): the sets of the classes named (and a few more), as 6 bytes a shingle in order.

    Of each class one text is looked for by its hash, so most texts are not cut into shingles again."""
    wanted = counted.join(classes, "cls").groupBy("cls").agg(F.min("h").alias("h")).select("h")
    bits = docs.sparkSession.sparkContext.broadcast(needed_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, own = WordHashes(), Seen(), bits.value
        for b in batches:
            rows, held = [], 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["cls", "n", "bag"])

            bit = (b.column("h").to_numpy().view(np.uint64) % np.uint64(FILTER_BITS)).astype(np.int64)
            for t in b.column("text").take(pa.array(np.flatnonzero(own[bit >> 3] >> (bit & 7) & 1))):
                s = shingles(t.as_py(), hashes, width)
                if len(s) and seen.first(c := class_of(s)):
                    rows.append((c, len(s), packed(s)))
                    held += len(rows[-1][2])
                    if held >= FLUSH:
                        yield out()
                        rows, held = [], 0
            if rows:
                yield out()

    return docs.select("text", F.xxhash64("text").alias("h")).mapInArrow(run, "cls long, n int, bag binary").dropDuplicates(["cls"])


def packed(s: np.ndarray) -> bytes:
    return np.ascontiguousarray(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(bag: bytes) -> np.ndarray:
    out = np.zeros((len(bag) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(bag, np.uint8).reshape(-1, 6)
    return out.view(">u8").ravel().astype(np.int64)


def checked(pairs: DataFrame, sets: DataFrame, many: bool = False) -> DataFrame:
    """Pairs (a, b, led) by exact intersection: an, bn (sizes), both (overlap), ok (similarity of 0.8 or more), rest (b's shingles outside a).

    ``rest`` is kept where a leads b. A hot ``a`` is dealt in shares of about ``SHARE`` pairs, each
    with a copy of its set. ``many`` pairs move the sets to them in any case, so the plan is the same at every size.
    """
    shares = pairs.groupBy("a").agg(F.count("*").alias("c")).select(F.col("a").alias("sa"), F.ceil(F.col("c") / SHARE).cast("int").alias("shares"))
    one = shares.select(F.col("sa").alias("cls"), F.col("sa").alias("a"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("b"), F.lit(False).alias("led"))
    other = pairs.join(shares, F.col("a") == F.col("sa")).select(F.col("b").alias("cls"), "a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("side"), "b", "led")
    asked = one.unionByName(other)
    routed = (asked.hint("merge") if many else asked).join(sets.select("cls", "bag"), "cls").drop("cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, np.empty(0, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for a, side, b, led, bag in zip(*(batch.column(c) for c in ("a", "side", "b", "led", "bag"))):
                a, led = a.as_py(), led.as_py()
                s = unpacked(bag.as_py())
                if side.as_py() == 0:
                    held, own = a, s
                    continue
                if held != a:
                    raise ValueError("a pair's set is missing")
                at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                inside = own[at] == s
                both = int(inside.sum())
                out.append((a, b.as_py(), led, len(own), len(s), both, 100 * both >= 80 * (len(s) + len(own) - both), s[~inside].tobytes() if led else b""))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["a", "b", "led", "an", "bn", "both", "ok", "rest"])

    rows = routed.repartition("a", "share").sortWithinPartitions("a", "share", "side")
    return rows.mapInArrow(run, "a long, b long, led boolean, an int, bn int, both int, ok boolean, rest binary")


def outside(tests: DataFrame) -> DataFrame:
    """Rows (tok, cls, n): a class's shingles outside its leader, each told apart by leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [np.frombuffer(x.as_py(), np.int64) for x in b.column("rest")]
            sizes = [len(x) for x in bags]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(c).to_numpy(), sizes)) for c in ("a", "b", "bn")] + [pa.array(np.concatenate(bags))], names=["a", "cls", "n", "t"])

    rows = tests.where("led").select("a", "b", "bn", "rest").mapInArrow(run, "a long, cls long, n int, t long")
    return rows.select(F.xxhash64("a", "t").alias("tok"), "cls", "n")


def links_of(tests: DataFrame) -> DataFrame:
    return tests.where("ok").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the group ``g`` of each class; a class without links is its own."""
    return rows.join(groups, "cls", "left").withColumn("g", F.coalesce("g", "cls"))


def apart(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """Of rows (key, ...) those of keys with more than one value in each column of ``by``."""
    ends = [f(c).alias(f"{n}_{c}") for c in by for n, f in (("lo", F.min), ("hi", F.max))]
    keys = rows.groupBy(key).agg(*ends)
    for c in by:
        keys = keys.where(F.col(f"lo_{c}") != F.col(f"hi_{c}"))
    return rows.join(keys.select(key), key)


def bounded(candidates: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (q, n, g, least) those whose overlap with the union of the group's sets can reach the threshold.

    groups: (cls, g). The matrix has a row per group and shingle, only of groups that are candidates.
    """

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [unpacked(x.as_py()) for x in b.column("bag")]
            if bags:
                k = pa.array(np.repeat(b.column("k").to_numpy(), [len(x) for x in bags]))
                g = pa.array(np.repeat(b.column("g").to_numpy(), [len(x) for x in bags]))
                yield pa.RecordBatch.from_arrays([k, g, pa.array(np.concatenate(bags))], names=["k", "g", "tok"])

    opened = candidates.select("g").distinct()
    members = groups.join(opened, "g").join(sets.select("cls", "bag"), "cls").select(F.col("cls").alias("k"), "g", "bag")
    matrix = members.mapInArrow(exploded, "k long, g long, tok long").select("g", "tok").distinct()
    asked = candidates.select("q", "g").join(sets.select("cls", "bag"), F.col("q") == F.col("cls")).select(F.col("q").alias("k"), "g", "bag").mapInArrow(exploded, "k long, g long, tok long")
    overlap = asked.join(matrix, ["g", "tok"]).groupBy(F.col("k").alias("q"), "g").agg(F.count("*").alias("both"))
    return candidates.join(overlap, ["q", "g"]).where(10 * F.col("both") >= 8 * F.greatest("n", "least")).select("q", "n", "g")


def components_of(links: DataFrame) -> DataFrame:
    groups = connected_components(links).select(F.col("node").alias("cls"), F.col("component").alias("g"))
    tidy(links.sparkSession)
    return groups


def named_in(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()


def either_way(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()


def less(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """``pairs`` without those of ``done`` (x, y), whichever way round."""
    return pairs.join(done, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    return labelled(docs, id_col, text_col, width).select("doc_id", "n_shingles", "component_id")


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row, beside what ``components`` gives: h (its text's hash) and c (its component's own number, null for an empty text)."""
    texts = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = materialise(census(texts, width), "census")
    found = materialise(met(texts, frequent_table(counted), width), "met")
    tidy(docs.sparkSession)
    # Common shingles of classes that have enough of them, and pairs by shingles of few holders.
    held = materialise(columns_of(found.where(F.col("tok").isNotNull()).select("tok", F.col("a").alias("cls"), F.col("an").alias("n"))), "held")
    heat = held.groupBy("cls").agg(F.sum("w").cast("int").alias("heat"))
    hot = materialise(held.join(heat.where(F.col("heat") >= SHARED).select("cls"), "cls", "left_semi"), "hot")
    times = found.where(F.col("tok").isNull()).groupBy("a", "b", "an", "bn").agg(F.sum("times").alias("times"))
    hottest = [heat.select(F.col("cls").alias(c), F.col("heat").alias(f"heat_{c}")) for c in ("a", "b")]
    reach = F.col("times") + F.least(F.coalesce("heat_a", F.lit(0)), F.coalesce("heat_b", F.lit(0)))
    opened = times.join(hottest[0], "a", "left").join(hottest[1], "b", "left").where(reach >= least_shared(F.col("an"), F.col("bn"))).select("a", "b")
    lead = materialise(leaders(hot), "pairs")
    opened = materialise(less(opened, either_way(lead)), "pairs")
    tidy(docs.sparkSession)
    first = lead.withColumn("led", F.lit(True)).unionByName(opened.withColumn("led", F.lit(False)))
    sets = materialise(sets_of(texts, counted, named_in(first), width), "sets")
    tests = materialise(checked(first, sets, many=True), "tests")
    tidy(docs.sparkSession)
    links = links_of(tests)
    groups = components_of(links)
    # Classes of one leader, on what they have outside it: leaders first, then the pairs left.
    own = materialise(apart(grouped(outside(tests), groups), "tok", "g"), "own")
    within = materialise(less(leaders(own.withColumn("w", F.lit(1)), 1), either_way(first)).withColumn("led", F.lit(False)), "pairs")
    more = materialise(checked(within, sets), "tests")
    tidy(docs.sparkSession)
    links = links.unionByName(links_of(more))
    groups = components_of(links)
    still = apart(grouped(own.drop("g"), groups), "tok", "g").select("tok", F.col("cls").alias("a"), F.col("n").alias("an"), F.col("g").alias("ag"))
    same_size = (5 * F.col("an") >= 4 * F.col("n")) & (4 * F.col("an") <= 5 * F.col("n"))
    beside = still.join(still.select("tok", F.col("a").alias("b"), F.col("an").alias("n"), F.col("ag").alias("bg")), "tok").where((F.col("a") < F.col("b")) & (F.col("ag") != F.col("bg")) & same_size).select("a", "b").distinct()
    # Classes of different leaders, on common shingles: rows of the matrix.
    leader = tests.where("led").select(F.col("b").alias("cls"), F.col("a").alias("p"), F.floor(9 * F.col("both") / 4 - F.col("bn")).cast("int").alias("room"))
    placed = grouped(hot, groups).join(leader, "cls", "left").withColumn("p", F.coalesce("p", "cls")).withColumn("room", F.coalesce("room", F.lit(-1)))
    rows = materialise(apart(placed, "tok", "g"), "placed")
    by_group = rows.groupBy("tok", "g", "p").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("room").alias("widest"))
    asked = rows.select("tok", F.col("cls").alias("q"), "n", "w", F.col("g").alias("own_g"), F.col("p").alias("own_p"), F.col("room").alias("own_room"))
    inside = (F.col("least") <= F.col("own_room")) & (F.col("n") <= F.col("widest"))
    fits = (F.col("own_g") > F.col("g")) & ((F.col("own_p") != F.col("p")) | inside) & (5 * F.col("most") >= 4 * F.col("n")) & (4 * F.col("least") <= 5 * F.col("n"))
    near = asked.join(by_group, "tok").where(fits).groupBy("q", "n", "own_p", "g", "p").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("w").alias("c"))
    # A group may spread over several leaders; what the class shares with the group is at most the sum.
    whole = near.groupBy("q", "n", "g").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("c").alias("c"))
    # What is needed grows up to the class's own size and falls behind it: the ends of the group's sizes need least.
    n, small, large = F.col("n"), F.greatest("least", F.ceil(4 * F.col("n") / 5).cast("int")), F.least("most", F.floor(5 * F.col("n") / 4).cast("int"))
    candidates = materialise(whole.where(F.col("c") >= F.least(least_shared(n, small), least_shared(n, large))).select("q", "n", "g", "least"), "candidates")
    tidy(docs.sparkSession)
    # Members that share enough common shingles with a class and agree in size, but for pairs already checked.
    member = rows.select("tok", F.col("cls").alias("a"), F.col("n").alias("an"), "g", "p", "room")
    asks = rows.select("tok", F.col("cls").alias("q"), "w", F.col("p").alias("own_p"), F.col("room").alias("own_room")).join(candidates, "q")
    roomy = (F.col("an") <= F.col("own_room")) & (F.col("n") <= F.col("room"))
    shared = asks.join(member, ["tok", "g"]).where(same_size & ((F.col("p") != F.col("own_p")) | roomy))
    pairs = shared.groupBy("a", "an", F.col("q").alias("b"), "n", "g").agg(F.sum("w").alias("c")).where(F.col("c") >= least_shared(F.col("an"), F.col("n"))).select("a", "b", "g")
    done = either_way(first.unionByName(within))
    pairs = materialise(less(pairs, done), "pairs")
    beside = materialise(less(beside, done), "pairs")
    # Common shingles alone bring classes in whose sets have not been needed so far.
    new = named_in(pairs).join(sets.select("cls"), "cls", "left_anti")
    others = materialise(sets_of(texts, counted, new, width), "sets")
    every = sets.unionByName(others.join(sets.select("cls"), "cls", "left_anti"))
    # A group of one is its own union: its check is the exact one.
    wide = candidates.join(pairs.select(F.col("b").alias("q"), "g").distinct(), ["q", "g"], "left_semi").join(groups.select("g").distinct(), "g", "left_semi")
    unions = groups.join(wide.select("g").distinct(), "g", "left_semi")
    shut = wide.select("q", "g").join(bounded(wide, unions, every).select("q", "g"), ["q", "g"], "left_anti").withColumnRenamed("q", "b")
    last = pairs.join(shut, ["b", "g"], "left_anti").select("a", "b").unionByName(beside).distinct()
    tests_left = materialise(checked(last.withColumn("led", F.lit(False)), every), "tests")
    tidy(docs.sparkSession)
    final = groups if tests_left.where("ok").isEmpty() else components_of(links.unionByName(links_of(tests_left)))
    final = final.select(F.col("cls").alias("node"), F.col("g").alias("component"))
    thin = counted.where(F.col("n").isNotNull()).select("doc_id", "h", "n", "cls")
    named = thin.join(final, F.col("cls") == F.col("node"), "left").select("doc_id", "h", "n", F.coalesce("component", "cls").alias("c"))
    smallest = named.where(F.col("c").isNotNull()).groupBy(F.col("c").alias("k")).agg(F.min("doc_id").alias("m"))
    out = named.join(smallest, F.col("c") == F.col("k"), "left").select("doc_id", "h", "c", F.col("n").cast("long").alias("n_shingles"), F.coalesce("m", "doc_id").alias("component_id"))
    result = materialise(out, "components")
    for used in (counted, found, held, hot, lead, opened, sets, others, tests, own, within, more, rows, candidates, pairs, beside, tests_left, final):
        drop(used)
    tidy(docs.sparkSession)
    return result


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each component (of its smallest id, one row). Empty texts are in none.

    A row is known by its id and its text's hash, since ids may be null or stand for several texts; rows alike in both
    are copies of each other. Texts move once, to meet the keys of the rows that go; only rows alike in id and text,
    where there are any, move again."""
    found = labelled(docs, id_col, text_col).where(F.col("c").isNotNull())
    rows = found.groupBy("c", "component_id", "doc_id", "h").agg(F.count("*").alias("times"))
    # The key that stays: of the smallest id (of a null one if there is no other), the smallest hash.
    stays = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("c").agg(F.min("h").alias("kept"))
    judged = rows.join(stays, "c").select("doc_id", "h", "times", (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("h") == F.col("kept"))).alias("stays"))
    judged = materialise(judged.where(~F.col("stays") | (F.col("times") > 1)), "judged")
    keyed = docs.withColumn("_h", F.xxhash64(text_col)).withColumn("_k", F.xxhash64(F.col(id_col), F.col("_h")))
    keys = judged.select(F.xxhash64("doc_id", "h").alias("_key"), F.col("doc_id").alias("_key_id"), F.col("h").alias("_key_h"), F.col("stays").alias("_stays"))
    same = (F.col("_k") == F.col("_key")) & F.col(id_col).eqNullSafe(F.col("_key_id")) & (F.col("_h") == F.col("_key_h"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # A merge join at every size: what is removed grows with the corpus.
    out = keyed.join(keys.hint("merge"), same, "left_anti").select(*columns)
    if not judged.where("stays").isEmpty():
        again = keyed.join(keys.where("_stays"), same, "left_semi").dropDuplicates([id_col, "_h"]).select(*columns)
        out = out.unionByName(again)
    return out
