"""Quality rules by weak supervision, with SQL functions only.

Ten rules look at a document's counts. Each votes good (1) or bad (-1), or abstains (0). Nothing says how far
a rule can be trusted, so expectation-maximisation estimates, over the vote patterns of all documents, each
rule's rate of bad votes among good documents (its false alarms) and among bad ones (its power); a document's
verdict is its posterior probability of being good. There are at most 3**10 patterns however many documents
there are, so the iteration runs on a table of bounded size.

Good documents are one class, in which rules err independently. Bad ones are a mixture of at most ``MODES``
kinds, since rules that look at the same fault (symbols and words without letters, capitals and exclamations)
fail together and would otherwise be counted as independent, and faults that have no rule in common would be
taken for two classes of their own. The iteration starts from the patterns in which two rules or more agree
that something is wrong; a single bad vote starts as a false alarm. From there on the data decides: all rates
have the same flat prior (one vote each way), and no rate or share is held or bounded.

Defined results: a null text has no words and fails the base rules; documents of fewer than ``MIN_WORDS`` words,
which fail them too, have abstentions only; an empty table gives an empty result; repeated rows are judged one by
one; columns other than the two named are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_SPACE, count_chars, materialise, words_of

SYMBOLS = "[#*$%&|<>]"
#: How many words a repeated window has.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Kinds of bad documents that are told apart at most; patterns of rarer kinds go to the nearest.
MODES = 8
ITERATIONS = 200
KEEP_AT = 0.5
RULES = ("word_length", "symbols", "lines", "repeats", "capitals", "digits", "exclamations", "stops", "letters", "variety")


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """How many of ``words`` lie in a window of ``width`` words (a power of two) that occurs twice or more.

    Windows are hashed by doubling, so each costs a few hashes whatever its width. Positions of hashes that
    occur again are merged as intervals; nothing is compared pair by pair.
    """
    n = F.size(words)

    def shifted(hashes: Column, step: int) -> Column:
        """Each hash together with the one ``step`` places later (at the end with none)."""

        def pairs(h: Column) -> Column:
            return F.zip_with(h, F.slice(h, F.lit(step + 1), F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))

        return F.transform(F.array(hashes), pairs)[0]

    def doubled(hashes: Column) -> Column:
        step = 1
        while step < width:
            hashes, step = shifted(hashes, step), 2 * step
        return hashes

    windows = F.slice(doubled(F.transform(words, lambda w: F.xxhash64(w))), F.lit(1), F.greatest(n - (width - 1), F.lit(0)))

    def covered(pairs: Column) -> Column:
        again = F.filter(pairs, lambda e, k: e["h"].eqNullSafe(F.get(pairs, k - 1)["h"]) | e["h"].eqNullSafe(F.get(pairs, k + 1)["h"]))
        at = F.sort_array(F.transform(again, lambda e: e["i"]))
        gaps = F.transform(F.array(at), lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width)))))[0]
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

    def once(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        slow = F.transform(F.array(pairs), covered)[0]
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(slow)

    return F.when(n < width, F.lit(0).cast("long")).otherwise(F.transform(F.array(windows), once)[0])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text: the contract's base counts and those that the rules need."""
    raw = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    split = raw.withColumn("w", words_of(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(NO_SPACE)))
    line_counts = F.transform(F.array(lines), lambda l: F.struct(F.size(l).alias("n"), (F.size(l) - F.size(F.array_distinct(l))).alias("dup")))[0]
    return split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count_chars(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        line_counts.alias("l"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        count_chars(F.col("t"), r"\p{Lu}").cast("long").alias("n_upper"),
        count_chars(F.col("t"), "[0-9]").cast("long").alias("n_digits"),
        count_chars(F.col("t"), "!").cast("long").alias("n_bangs"),
        count_chars(F.col("t"), "[.?!]").cast("long").alias("n_stops"),
        F.size(F.filter("w", lambda x: F.rlike(x, F.lit(r"\p{L}")))).cast("long").alias("n_lettered"),
        F.size(F.array_distinct(F.transform("w", lambda x: F.lower(x)))).cast("long").alias("n_distinct"),
    ).select("*", F.col("l.n").cast("long").alias("n_lines"), F.col("l.dup").cast("long").alias("n_dup_lines")).drop("l")


def votes() -> dict[str, Column]:
    c, nw = F.col, F.col("n_words")

    def rule(bad: Column, good: Column, applies: Column | None = None) -> Column:
        v = F.when(bad, -1).when(good, 1).otherwise(0)
        return v if applies is None else F.when(applies, v).otherwise(0)

    some = nw >= MIN_WORDS
    variety = F.log1p(c("n_distinct")) / F.log1p(nw)
    return {
        "word_length": rule((c("word_chars") > 7 * nw) | (10 * c("word_chars") < 33 * nw), (10 * c("word_chars") <= 62 * nw) & (10 * c("word_chars") >= 38 * nw), some),
        "symbols": rule(10 * c("n_symbols") > nw, 50 * c("n_symbols") <= nw, some),
        "lines": rule(10 * c("n_dup_lines") > 4 * c("n_lines"), 5 * c("n_dup_lines") <= c("n_lines"), some & (c("n_lines") > 2)),
        "repeats": rule(5 * c("n_repeat_words") > nw, 50 * c("n_repeat_words") <= nw, some),
        "capitals": rule(10 * c("n_upper") > 3 * c("word_chars"), 20 * c("n_upper") <= 3 * c("word_chars"), some),
        "digits": rule(10 * c("n_digits") > c("word_chars"), 50 * c("n_digits") <= c("word_chars"), some),
        "exclamations": rule(4 * c("n_bangs") > nw, 20 * c("n_bangs") <= nw, some),
        "stops": rule((2 * c("n_stops") > nw) | (100 * c("n_stops") < nw), (4 * c("n_stops") <= nw) & (50 * c("n_stops") >= nw), some),
        "letters": rule(5 * c("n_lettered") < 4 * nw, 10 * c("n_lettered") >= 9 * nw, some),
        "variety": rule(variety < 0.8, variety >= 0.9, some),
    }


Patterns = list[tuple[tuple[int, ...], int]]


def kinds(patterns: Patterns, modes: int = MODES) -> list[tuple[bool, ...]]:
    """The most frequent sets of two rules or more that vote bad together."""
    held: dict[tuple[bool, ...], int] = {}
    for vote, n in patterns:
        against = tuple(v < 0 for v in vote)
        if sum(against) > 1:
            held[against] = held.get(against, 0) + n
    return sorted(held, key=lambda k: (-held[k], k))[:modes]


def fit(patterns: Patterns, iterations: int = ITERATIONS, modes: int = MODES) -> tuple[list[float], list[list[float]]]:
    """Expectation-maximisation over (votes, documents) rows: each class's share, and each rule's rate of bad votes in it.

    Class 0 is good, the others are kinds of bad. Abstaining is no evidence.
    """
    starts = kinds(patterns, modes)
    k = len(starts) + 1
    rules = len(patterns[0][0]) if patterns else len(RULES)
    belief = []
    for vote, _ in patterns:
        against = tuple(v < 0 for v in vote)
        near = min(range(1, k), key=lambda c: (sum(x != y for x, y in zip(starts[c - 1], against)), c)) if sum(against) > 1 else 0
        belief.append([float(c == near) for c in range(k)])
    shares, rates = [1.0], [[0.5] * rules]
    for _ in range(iterations):
        mass, voted, against = [1.0] * k, [[2.0] * rules for _ in range(k)], [[1.0] * rules for _ in range(k)]
        for (vote, n), held in zip(patterns, belief):
            for c, p in enumerate(held):
                if p:
                    mass[c] += n * p
                    for j, v in enumerate(vote):
                        if v:
                            voted[c][j] += n * p
                            against[c][j] += n * p * (v < 0)
        shares = [m / sum(mass) for m in mass]
        rates = [[a / v for a, v in zip(x, y)] for x, y in zip(against, voted)]
        weights = evidence(shares, rates)
        following = [posterior(vote, weights) for vote, _ in patterns]
        settled = all(abs(x[0] - y[0]) < 1e-9 for x, y in zip(belief, following))
        belief = following
        if settled:
            break
    return shares, rates


def accuracies(shares: list[float], rates: list[list[float]]) -> list[tuple[float, float]]:
    """By rule: its rate of bad votes among good documents, and among all bad ones."""
    bad = sum(shares[1:])
    return [(good, sum(s * r for s, r in zip(shares[1:], own)) / bad if bad else 0.5) for good, *own in zip(*rates)]


def evidence(shares: list[float], rates: list[list[float]]) -> list[tuple[float, list[dict[int, float]]]]:
    """Of each class, its log share and what each rule's vote adds to its log-likelihood."""
    return [(math.log(s), [{1: math.log(1 - r), 0: 0.0, -1: math.log(r)} for r in row]) for s, row in zip(shares, rates)]


def posterior(vote: tuple[int, ...], weights: list[tuple[float, list[dict[int, float]]]]) -> list[float]:
    """Of each class; the first is that of being good."""
    z = [s + sum(e[v] for e, v in zip(row, vote)) for s, row in weights]
    top = max(z)
    e = [math.exp(x - top) for x in z]
    return [x / sum(e) for x in e]


def score(counted: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """Votes, posterior and verdict for a table of ``features`` that can be read twice."""
    voted = counted.select("*", *(v.alias(f"vote_{k}") for k, v in votes().items()))
    names = [f"vote_{k}" for k in RULES]
    patterns = [(tuple(r[n] for n in names), r["n"]) for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    shares, rates = fit(patterns)
    likelihoods = []
    for share, row in evidence(shares, rates):
        z = F.lit(share)
        for name, e in zip(names, row):
            z = z + F.when(F.col(name) == 1, e[1]).when(F.col(name) == -1, e[-1]).otherwise(0.0)
        likelihoods.append(z)
    top = F.greatest(*likelihoods) if len(likelihoods) > 1 else likelihoods[0]
    likelihoods = [F.exp(z - top) for z in likelihoods]
    total = likelihoods[0]
    for other in likelihoods[1:]:
        total = total + other
    nw = F.col("n_words")
    return (
        voted.withColumn("quality_p", likelihoods[0] / total)
        .withColumn("base_failed", (nw < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * nw))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality_p") >= keep_at))
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, votes, posterior and verdict for every document. Texts are read once; the counts go to shared storage."""
    return score(materialise(features(docs, id_col, text_col), "rules"))
