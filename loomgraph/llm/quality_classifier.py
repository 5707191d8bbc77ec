"""A quality classifier whose prior depends on the site: hierarchical empirical Bayes.

A logistic model over native text features, fitted on at most ``MAX_LABELLED`` labelled rows, gives each
document's evidence. Sites (``site_col``) and paths below them (``path_col``) get beta posteriors of their
mean quality: a site shrinks toward the global mean, a path toward its site, with a strength that the
spread of the group means over all documents determines (method of moments). A document's odds are its
evidence times the ratio of its path's prior odds to the global ones, so that groups with few documents
hardly move it.

Groups are summed map-side before the shuffle, so a site with a third of all rows is one row per task.

Defined results: a null text has the features of an empty one; null sites and paths are groups of their
own; without labels of both kinds, the evidence is the same for all documents and all are kept; an empty
table gives an empty result; of several labels of one document the lowest counts.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_SPACE, count_chars, materialise, words_of

MAX_LABELLED = 20_000
#: Bounds on the prior strength, in documents.
STRENGTH = (2.0, 1000.0)
#: How far a site or path may move the log-odds.
MAX_SHIFT = 1.5
KEEP_AT = 0.35
FEATURES = ("log_words", "word_length", "symbols", "capitals", "digits", "bangs", "distinct", "lines_again", "punctuation")


def features(docs: DataFrame, id_col: str, text_col: str, site_col: str, path_col: str, carry: bool = False) -> DataFrame:
    """doc_id, site, path and FEATURES; with ``carry`` also the input row as a struct ``row``."""
    row = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []
    t = docs.select(*row, F.col(id_col).alias("doc_id"), F.col(site_col).cast("string").alias("site"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = t.withColumn("w", words_of(F.lower("t")))
    n = F.greatest(F.size("w"), F.lit(1)).cast("double")
    chars = F.greatest(F.length("t"), F.lit(1)).cast("double")
    lines = F.transform(F.array(F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(NO_SPACE)))), lambda l: (F.size(l) - F.size(F.array_distinct(l))) / F.greatest(F.size(l), F.lit(1)))[0]
    return t.select(
        *(["row"] if carry else []), "doc_id", "site", "path",
        F.log1p(F.size("w")).alias("log_words"),
        F.least(chars / n, F.lit(30.0)).alias("word_length"),
        F.least(count_chars(F.col("t"), "[#*$%&|<>]") / n, F.lit(3.0)).alias("symbols"),
        (count_chars(F.col("t"), r"\p{Lu}") / chars).alias("capitals"),
        (count_chars(F.col("t"), "[0-9]") / chars).alias("digits"),
        F.least(count_chars(F.col("t"), "[!?]") / n, F.lit(3.0)).alias("bangs"),
        (F.log1p(F.size(F.array_distinct("w"))) / F.log1p(n)).alias("distinct"),
        lines.cast("double").alias("lines_again"),
        F.least(count_chars(F.col("t"), "[.,;:]") / n, F.lit(3.0)).alias("punctuation"),
    )


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (intercept first) of a ridge logistic model over features and their squares, by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / scale, -8, 8)
    a = np.hstack([np.ones((len(z), 1)), z, z**2])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + penalty * w
        hessian = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def model_logit(mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> Column:
    k = len(FEATURES)
    out = F.lit(float(w[0]))
    for i, name in enumerate(FEATURES):
        z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col(name) - float(mean[i])) / float(scale[i])))
        out = out + z * float(w[1 + i]) + z * z * float(w[1 + k + i])
    return F.greatest(F.lit(-12.0), F.least(F.lit(12.0), out))


def labelled_sample(feats: DataFrame, labels: DataFrame, id_col: str, label_col: str, bound: int) -> list:
    """At most ``bound`` labelled documents, those of the least hashes; of rows with one id, one."""
    own = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("y"))
    own = own.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(bound)
    one = feats.join(own, "doc_id").groupBy("doc_id").agg(F.min(F.struct("y", *FEATURES)).alias("r"))
    return one.select("r.*").collect()


def strength(groups: DataFrame, mean: str, prior: Column) -> float:
    """Documents that the prior counts as: within-group variance over between-group variance, in bounds."""
    r = groups.where(F.col("n") >= 5).agg(F.avg((F.col(mean) - prior) ** 2).alias("between"), F.avg(prior * (1 - prior) / F.col("n")).alias("noise"), F.avg(prior * (1 - prior)).alias("within")).first()
    if r is None or r["between"] is None:
        return STRENGTH[1]
    true = max(r["between"] - r["noise"] * 0.25, 1e-9)
    return min(STRENGTH[1], max(STRENGTH[0], r["within"] / true))


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


class Model:
    """The fitted evidence, and a table of the groups' posteriors (s, p, site_p, path_p)."""

    def __init__(self, evidence: Column, overall: float, groups: DataFrame):
        self.evidence, self.overall, self.groups = evidence, overall, groups

    def apply(self, feats: DataFrame, keep_at: float) -> DataFrame:
        """``feats`` with doc_p (evidence), site_p, path_p (posterior means), score, kept."""
        shift = F.greatest(F.lit(-MAX_SHIFT), F.least(F.lit(MAX_SHIFT), logit(F.col("path_p")) - math.log(self.overall / (1 - self.overall))))
        scored = feats.withColumn("doc_p", 1 / (1 + F.exp(-self.evidence)))
        joined = scored.join(self.groups, F.col("site").eqNullSafe(F.col("s")) & F.col("path").eqNullSafe(F.col("p")))
        return joined.withColumn("score", 1 / (1 + F.exp(-(logit(F.col("doc_p")) + shift)))).withColumn("kept", F.col("score") >= keep_at)


def learn(feats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    rows = labelled_sample(feats, labels, id_col, label_col, max_labelled)
    y = np.array([r["y"] for r in rows], dtype=float)
    if len(set(y)) == 2:
        evidence = model_logit(*fit(np.array([list(r[1:]) for r in rows], dtype=float), y))
    else:
        evidence = F.lit(1.0)
    scored = feats.select("site", "path", (1 / (1 + F.exp(-evidence))).alias("doc_p"))
    by_path = materialise(scored.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum("doc_p").alias("good")), "paths")
    total = by_path.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = total["good"] / total["n"] if total["n"] else 0.5
    overall = min(1 - 1e-6, max(1e-6, overall))
    sites = by_path.groupBy("site").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("m", F.col("good") / F.col("n"))
    a = strength(sites, "m", F.lit(overall))
    sites = sites.select(F.col("site").alias("s"), ((F.col("good") + a * overall) / (F.col("n") + a)).alias("site_p"))
    paths = by_path.join(sites, F.col("site").eqNullSafe(F.col("s"))).drop("s").withColumn("m", F.col("good") / F.col("n"))
    b = strength(paths, "m", F.col("site_p"))
    paths = paths.select(F.col("site").alias("s"), F.col("path").alias("p"), "site_p", ((F.col("good") + b * F.col("site_p")) / (F.col("n") + b)).alias("path_p"))
    return Model(evidence, overall, materialise(paths, "posteriors"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang", keep_at: float = KEEP_AT) -> DataFrame:
    """Per document: doc_id, site, path, doc_p, site_p, path_p, score, kept. Texts are read once."""
    feats = materialise(features(docs, id_col, text_col, site_col, path_col), "quality")
    return learn(feats, labels, id_col).apply(feats, keep_at).select("doc_id", "site", "path", "doc_p", "site_p", "path_p", "score", "kept")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept. Texts are read twice and never shuffled."""
    model = learn(materialise(features(docs, id_col, text_col, site_col, path_col), "quality"), labels, id_col)
    return model.apply(features(docs, id_col, text_col, site_col, path_col, carry=True), keep_at).where("kept").select("row.*")
