"""Each operator against brute force, a library or a round trip, and on nulls, empties, ties and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, html_text, jaccard, langid, mixing, quality_classifier, quality_rules, token_counts, toxicity, warc
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    """The small table with nulls in every column, empties, repeated rows and columns whose names clash with the operators' own."""
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(900001, None, None, None, None), (900002, "", "en", "src0", 0), (900003, " \n\t ", "en", "src1", 4), (None, "A null id and some words to follow it", "en", None, 30), (900004, "ÜBER ΣΑΣ ﬁ <|endoftext|>x", "de", "src1", 20), (900005, "one two", "en", "src1", 7), (900005, "one two", "en", "src1", 7)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    long = spark.createDataFrame([(900006, " ".join(f"w{i % 977}" for i in range(30_000)), "en", "src0", 1)], odd.schema)
    clash = {c: F.lit("x") for c in ("n", "w", "t", "cls", "row", "site", "path", "block", "score", "bundle")}
    return real.unionByName(odd).unionByName(long).withColumns(clash).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def empty(docs):
    return docs.where("false")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_by_force(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    holders = collections.defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for k, (_, s) in enumerate(sets):
        near = collections.Counter(j for x in s for j in holders[x] if j > k)
        for j, n in near.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                label[find(j)] = find(k)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k), i) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def test_jaccard_components(spark, docs, texts):
    rng = random.Random(1)
    base = [f"a{rng.randrange(10**6)}" for _ in range(60)]
    made = []
    for i in range(40):  # a chain of near copies around the threshold, and short texts
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(60)] = f"b{rng.randrange(10**6)}"
        made.append((800_000 + i, " ".join(w)))
    made += [(810_000 + i, " ".join(base[: 4 + i % 6])) for i in range(12)]
    rows = texts + made
    frame = docs.select("doc_id", "text", "n", "cls").unionByName(spark.createDataFrame([(i, t, "x", "y") for i, t in made], "doc_id long, text string, n string, cls string"))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.components(frame).collect()), key=str)
    assert got == components_by_force(rows)


def test_jaccard_large_groups_against_force(spark):
    """Groups far beyond FEW: copies with changes of their own around the threshold, shared passages, exact copies, all sizes."""
    rng = random.Random(21)
    word = lambda: f"v{rng.randrange(10**9)}"
    rows = []
    for group in range(4):
        base = [word() for _ in range(90 + 40 * group)]
        for i in range(60):  # one word in 45 changed drops about a tenth of the shingles
            w = list(base)
            for _ in range(rng.randrange(0, 2 + len(base) // 22)):
                w[rng.randrange(len(w))] = word() if i % 3 else f"same{group}"
            rows.append(" ".join(w if i % 4 else w[: len(w) - rng.randrange(0, 12)]))
    passage = [word() for _ in range(70)]
    rows += [" ".join([word() for _ in range(rng.randrange(0, 30))] + passage + [word() for _ in range(rng.randrange(0, 10))]) for _ in range(80)]
    rows += rows[:5] * 4
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(7)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.components(docs).collect()), key=str)
    want = components_by_force(list(enumerate(rows)))
    assert got == want and 40 < len({c for _, _, c in want}) < len(rows) - 40


def test_prefixes_share_what_sizes_need():
    """``least_shared`` is a bound for every pair that links: random sets under a common order."""
    rng = random.Random(6)
    for _ in range(3_000):
        n = rng.randrange(4, 80)
        a = set(rng.sample(range(200), n))
        b = set(a)
        for _ in range(rng.randrange(0, 1 + n // 5)):
            if rng.random() < 0.6 and len(b) > 4:
                b.discard(rng.choice(sorted(b)))
            if rng.random() < 0.6:
                b.add(rng.randrange(200))
        if 100 * len(a & b) >= 80 * len(a | b) and len(b) >= 4:
            first = [set(sorted(s)[: jaccard.prefix_length(len(s))]) for s in (a, b)]
            behind = max(len(s) - jaccard.prefix_length(len(s)) for s in (a, b))
            assert len(first[0] & first[1]) >= -(-4 * (len(a) + len(b)) // 9) - behind


def test_jaccard_meetings_over_batches():
    """Runs of a shingle that cross batches, with repeats, few and many holders."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    held = sorted({(t, rng.randrange(40)) for t in range(120) for _ in range(rng.choice([1, 2, 3, 8, 9, 30]))})
    rows = sorted(held + rng.sample(held, 200))
    cols = [np.array(x) for x in zip(*rows)]
    size = 90 + cols[1]
    for step in (1, 2, 7, 50, 5_000):
        batches = [pa.RecordBatch.from_arrays([pa.array(cols[0][i : i + step]), pa.array(cols[1][i : i + step]), pa.array(size[i : i + step].astype(np.int32)), pa.array(np.zeros(len(cols[0][i : i + step]), np.int32))], names=["tok", "cls", "n", "salt"]) for i in range(0, len(rows), step)]
        out = [r for b in jaccard.meetings(iter(batches)) for r in b.to_pylist()]
        by_tok = collections.defaultdict(list)
        for t, c in held:
            by_tok[t].append(c)
        pairs = collections.Counter()
        for r in out:
            if r["tok"] is None:
                pairs[r["a"], r["b"]] += r["times"]
        agree = lambda x, y: 5 * (90 + x) >= 4 * (90 + y) and 4 * (90 + x) <= 5 * (90 + y)
        assert pairs == collections.Counter((x, y) for c in by_tok.values() if 2 <= len(c) <= jaccard.FEW for i, x in enumerate(c) for y in c[i + 1 :] if agree(x, y))
        assert sorted((r["tok"], r["a"]) for r in out if r["tok"] is not None) == sorted((t, c) for t, cs in by_tok.items() if len(cs) > jaccard.FEW for c in cs)


def test_jaccard_empty_and_keep_one(docs):
    assert jaccard.components(empty(docs)).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 900005 in ids


def test_jaccard_leaves_no_broadcasts(spark, docs):
    """What its many queries have broadcast does not stay in the driver's memory."""
    time, sc = __import__("time"), spark.sparkContext

    def held() -> float:
        """MB of blocks in memory (a local master has one store); the cleaner works behind the collector."""
        return sc._jvm.org.apache.spark.SparkEnv.get().memoryManager().storageMemoryUsed() / 1e6

    jaccard.tidy(spark)
    time.sleep(3)
    before = held()
    rows = jaccard.components(docs)
    time.sleep(3)
    after = held()
    assert rows.count() == docs.count() and after - before < 7


def test_keep_one_with_null_and_repeated_ids(spark):
    text = lambda k, n=40: " ".join(f"t{k}w{i}" for i in range(n))
    rows = [(None, text(1)), (None, text(2)), (None, text(1)), (7, text(3)), (7, text(4)), (7, text(4)), (3, text(4) + " more"), (5, text(2) + " more"), (None, ""), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(docs).collect()), key=str)
    assert kept == sorted([(None, text(1)), (7, text(3)), (3, text(4) + " more"), (5, text(2) + " more"), (None, ""), (None, ""), (None, None)], key=str)


def test_token_counts_match_the_library(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.vocabulary("word_bpe_49k.json"))
    own = token_counts.counter(token_counts.vocabulary("word_bpe_49k.json"))
    extra = ["<|startoftext|>a<|endoftext|>", "don't we'll ''s", "a\x1cb\x85c d é Å", "½ ² Ⅷ 123 ٣", "İ ΑΣ Σ", "日本語テキスト", "😀🎉 ok", "x" * 3000, "<|endof", "\u0000�"]
    for text in [x or "" for _, x in texts] + extra:
        assert own.count(text) == len(t.encode(text, add_special_tokens=False).ids), text[:50]
    got = token_counts.count_tokens(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[900001]["n_tokens"] == 0 and by_id[900006]["over_limit"] and by_id[900001]["n_bytes"] == 0
    assert token_counts.count_tokens(empty(docs)).count() == 0


def rules_by_force(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, texts):
    rows = quality_rules.judge(docs).collect()
    got = sorted(((r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in rows), key=str)
    assert got == sorted(((i, rules_by_force(t)) for i, t in texts), key=str)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(empty(docs)).count() == 0


def good_share(rows):
    weights = quality_rules.evidence(*quality_rules.fit(rows))
    return [quality_rules.posterior(v, weights)[0] for v, _ in rows]


def test_weak_supervision_recovers_planted_accuracies():
    """Six rules that err independently, the last of which cries wolf on a third of the good documents."""
    rng = random.Random(8)
    false, power = [0.01, 0.02, 0.03, 0.05, 0.02, 0.33], [0.9, 0.8, 0.85, 0.7, 0.9, 0.6]
    drawn = collections.Counter()
    truth = collections.Counter()
    for _ in range(40_000):
        bad = rng.random() < 0.2
        v = tuple(0 if rng.random() < 0.1 else -1 if rng.random() < r else 1 for r in (power if bad else false))
        drawn[v] += 1
        truth[v, bad] += 1
    rows = sorted(drawn.items())
    shares, rates = quality_rules.fit(rows)
    assert abs(shares[0] - 0.8) < 0.03
    for (f, p), want_f, want_p in zip(quality_rules.accuracies(shares, rates), false, power):
        assert abs(f - want_f) < 0.03 and abs(p - want_p) < 0.06
    kept = dict(zip((v for v, _ in rows), good_share(rows)))
    assert sum(truth[v, kept[v] < 0.5] for v, _ in rows) >= 0.97 * 40_000
    assert kept[1, 1, 1, 1, 1, -1] > 0.9 and kept[0, 1, 1, 1, 1, -1] > 0.9  # one vote of an inaccurate rule


def test_weak_supervision_needs_rules_that_agree():
    """Kinds of faults without a rule in common are all found; a vote that no other rule ever joins is a false alarm."""
    good = (1,) * 10
    with_ = lambda *bad: tuple(-1 if i in bad else 1 for i in range(10))
    rows = [(good, 3000), (with_(1, 8), 200), (with_(3, 9), 150), (with_(4, 6, 7), 120), (with_(5), 60), ((0,) * 10, 50), (with_(1, 7, 8), 3)]
    assert [p > 0.5 for p in good_share(rows)] == [True, False, False, False, True, True, False]
    assert good_share([(good, 5), (with_(2), 1)])[1] > 0.5 and quality_rules.fit([])[0] == [1.0]


def test_mixing_spends_the_budget(docs):
    rows = mixing.mix(docs, target_entropy=0.99, max_repeat=3.0).collect()
    total = sum(r["n_tokens"] for r in rows)
    own = {i: len(WORD.findall(t or "")) for i, t in [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]}
    budget = sum(len(WORD.findall(r["text"] or "")) for r in docs.select("text").collect())
    by_source = collections.defaultdict(int)
    weight = {}
    for r in rows:
        assert r["n_tokens"] == own[r["doc_id"]]
        by_source[r["source"]] += r["n_tokens"]
        weight[r["source"]] = r["weight"]
    longest = max(own.values())
    for s, w in weight.items():
        assert w * budget - longest - 1 <= by_source[s] <= w * budget + 1
    assert total <= budget + len(weight)
    covered = {r["doc_id"] for r in mixing.mix(docs, 1.0, 2.0, "cover").collect()}
    assert covered == set(own)
    assert mixing.mix(empty(docs)).count() == 0


def test_temperature_limits():
    a, w = mixing.solve([900, 50, 50], 0.9, 100.0, None)
    assert mixing.entropy(w) >= 0.9 * mixing.math.log(3) - 1e-9 and mixing.entropy(mixing.tempered([0.9, 0.05, 0.05], a + 0.01)) < 0.9 * mixing.math.log(3)
    a, w = mixing.solve([900, 50, 50], 1.0, 2.0, None)
    assert max(1000 * x / t for x, t in zip(w, [900, 50, 50])) <= 2.0 + 1e-6
    assert mixing.solve([10], 1.0, 2.0, None)[1] == [1.0]


def test_quality_classifier(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_classifier.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    right = [r["kept"] == bool(truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth]
    assert sum(right) >= 0.9 * len(right)
    kept = quality_classifier.keep(docs, labels)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if r["kept"])
    assert all(r["kept"] for r in quality_classifier.classify(docs, labels.where("false")).collect())
    assert quality_classifier.classify(empty(docs), labels).count() == 0


def test_site_posteriors_shrink(spark):
    good = "The ant and the bee went to the sea with all of their friends on a warm day. It was fine."
    bad = "AA!! AA!! AA!! AA!! ###"
    rows = [(i, good if i % 5 else bad, "big", "p") for i in range(300)] + [(1000, bad, "small", "p")] + [(2000 + i, bad, "poor", "p") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(t == good)) for i, t, *_ in rows if i % 2], "doc_id long, quality int")
    site = {r["site"]: r["site_p"] for r in quality_classifier.classify(docs, labels).collect()}
    assert site["poor"] < site["small"] < site["big"]


def test_decontamination(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    common = [word() for _ in range(60)]
    prose = lambda n: [word() if rng.random() < 0.6 else rng.choice(common) for _ in range(n)]
    items = [(i, " ".join(prose(25)) + ". " + " ".join(prose(8)) + ".") for i in range(30)]
    rows, truth = [], set()
    for d in range(200):
        w = prose(rng.randrange(0, 400))
        if d % 10 == 0:
            i = rng.randrange(30)
            leak = items[i][1].split()
            if d % 20 == 0:  # a paraphrase: words dropped, added and exchanged
                leak = [x for x in leak if rng.random() > 0.1]
                for _ in range(3):
                    leak[rng.randrange(len(leak) - 8)] = word()
            at = rng.randrange(len(w) + 1)
            w[at:at] = leak
            truth.add((d, i))
        rows.append((d, " ".join(w)))
    rows += [(901, None), (902, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items + [(99, None), (98, "")], "item_id long, text string")
    models = decontaminate.models(docs, bench)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, models).collect()}
    assert got == truth
    clean = decontaminate.clean(docs, models)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in truth}
    assert decontaminate.leaks(docs.where("false"), models).count() == 0
    assert decontaminate.models(docs, bench.where("false")) == []
    # Blocks give the same as one model.
    blocks = decontaminate.models(docs, bench, block=7)
    assert len(blocks) > 1 and {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, blocks).collect()} == truth


@pytest.fixture(scope="module")
def many_items():
    """Passages of words of their own and of words that many share."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 9)))
    common = [word() for _ in range(80)]
    pool = [word() for _ in range(3000)]
    passage = lambda n: [rng.choice(pool) if rng.random() < 0.6 else rng.choice(common) for _ in range(n)]
    return [(i, " ".join(passage(rng.randrange(15, 60)))) for i in range(2000)], passage


def scanned(models, rows):
    scanners = [decontaminate.Scanner(m) for m in models]
    return [{h[0] for s in scanners for h in s.hits(t)} for t in rows]


@pytest.mark.parametrize("n", [1000, 2000])
def test_decontamination_with_many_items(spark, many_items, n):
    rng = random.Random(9)
    items, passage = many_items[0][:n], many_items[1]
    docs = spark.createDataFrame([(i, " ".join(passage(150))) for i in range(300)], "doc_id long, text string")
    models = decontaminate.models(docs, spark.createDataFrame(items, "item_id long, text string"))
    asked = rng.sample(items, 60)
    for changed in (0, 0.2):
        rows = []
        for _, t in asked:
            w = t.split()
            for at in rng.sample(range(len(w)), int(changed * len(w))):
                w[at] = passage(1)[0]
            before = passage(100)
            rows.append(" ".join(before + w + passage(100)))
        lost = [i for (i, _), got in zip(asked, scanned(models, rows)) if i not in got]
        assert not lost, f"{len(lost)} of {len(asked)} lost, {changed:.0%} of words changed"


def test_decontamination_checks_every_candidate_window(spark, many_items):
    """A line that repeats words of the item does not hide the copy beside it."""
    items, passage = many_items[0][:100], many_items[1]
    docs = spark.createDataFrame([(i, " ".join(passage(150))) for i in range(300)], "doc_id long, text string")
    models = decontaminate.models(docs, spark.createDataFrame(items, "item_id long, text string"))
    rows = [" ".join(passage(200) + t.split()[:3] * 16 + passage(300) + t.split() + passage(300)) for _, t in items[:60]]
    lost = [i for (i, _), got in zip(items, scanned(models, rows)) if i not in got]
    assert not lost, f"{len(lost)} of {len(rows)} lost"
    cosines = [h[1] for m in models for r in rows for h in decontaminate.Scanner(m).hits(r)]
    assert cosines and 0 < max(cosines) <= 1 + 1e-5


def test_decontamination_recall_does_not_fall_with_the_corpus(spark, many_items, monkeypatch):
    """Paraphrases with words from outside the benchmark, at two corpus sizes: the counts of the documents, and 300 times those."""
    rng = random.Random(10)
    items, passage = many_items[0][:100], many_items[1]
    docs = spark.createDataFrame([(i, " ".join(passage(150))) for i in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    count = decontaminate.frequencies
    for times in (1, 300):
        monkeypatch.setattr(decontaminate, "frequencies", lambda d, names, k=times: (lambda n, c: (k * n, k * c))(*count(d, names)))
        models = decontaminate.models(docs, bench)
        for changed in (0.2, 0.4):
            rows = []
            for _, t in items:
                w = t.split()
                for at in rng.sample(range(len(w)), int(changed * len(w))):
                    w[at] = f"outside{rng.randrange(5000)}"
                rows.append(" ".join([f"other{i}" for i in range(60)] + w + [f"more{i}" for i in range(60)]))
            lost = [i for (i, _), got in zip(items, scanned(models, rows)) if i not in got]
            assert not lost, f"{len(lost)} of {len(rows)} lost, {changed:.0%} changed, {times} times the documents"


def test_decontamination_odd_ids_rows_and_texts(spark):
    """Null and decimal ids, repeated rows, ties and long texts; against a longest common subsequence over whole texts."""
    import decimal

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(14)] for _ in range(4)]
    bench = spark.createDataFrame([(None, " ".join(items[0])), (decimal.Decimal("1.50"), " ".join(items[1])), (decimal.Decimal("2.50"), " ".join(items[2])), (decimal.Decimal("3.50"), " ".join(items[2])), (decimal.Decimal("4.50"), None)], "item_id decimal(9,2), text string")
    filler = lambda n: [word() for _ in range(n)]
    texts = [filler(30) + items[0] + filler(30), filler(20_000) + items[1] + filler(9), items[2], items[2][:7] + filler(400) + items[2][7:], filler(50), []]
    rows = [(None if i == 2 else decimal.Decimal(i), " ".join(t)) for i, t in enumerate(texts)] + [(decimal.Decimal(0), " ".join(texts[0]))]
    docs = spark.createDataFrame(rows, "doc_id decimal(5,0), text string")
    found = decontaminate.leaks(docs, decontaminate.models(docs, bench), item_type="decimal(9,2)")
    got = sorted(((r["doc_id"], r["item_id"]) for r in found.collect()), key=str)
    d = decimal.Decimal
    assert got == sorted([(d(0), None), (d(0), None), (d(1), d("1.50")), (None, d("2.50")), (None, d("3.50"))], key=str)
    kept = decontaminate.clean(docs, decontaminate.models(docs, bench))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "5"]
    none = decontaminate.models(docs, bench.where("false"))
    assert decontaminate.leaks(docs, none).count() == 0 and decontaminate.clean(docs, none).count() == 7 and decontaminate.leaks(docs.where("false"), decontaminate.models(docs, bench), item_type="decimal(9,2)").count() == 0


def test_decontamination_splits_texts_as_words_does(many_items, monkeypatch):
    """Whole batches are cut at once, in slices; every text gets the words and hits that it has alone."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(13)
    signs = list("a\u00df\u0130\u03a3\u03c3\u03c2\u00e9.!-_'\"\u00ab\u00bb\u201c\u2026\u00bf\t\n\x0b\x1c\x1f\x85\xa0\u2003\u2028\u3000\u200b\ufeff\x00\U0001d49c") + [" "] * 6
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)] + [None, "", "x" * 500]
    for size in (1, 100, 4_000_000):
        monkeypatch.setattr(decontaminate, "SLICE", size)
        cut = []
        for first, found, at in decontaminate.split(pa.array(["no"] + texts).slice(1)):
            assert first == len(cut)
            cut += [found.to_pylist()[i:j] for i, j in zip(at[:-1], at[1:])]
        assert cut == [decontaminate.words(t) for t in texts]
    assert list(decontaminate.split(pa.array([], pa.string()))) == []
    items, passage = many_items[0][:50], many_items[1]
    names = {w: i for i, w in enumerate(sorted({w for _, t in items for w in decontaminate.words(t)}))}
    scanner = decontaminate.Scanner(decontaminate.Model(items, names, np.append(np.ones(len(names)), 0), np.eye(len(names))))
    rows = [" ".join(passage(50)) + (f" {items[i][1].upper()}! " if i % 2 else " ") + " ".join(passage(50)) for i in range(50)] + [None, ""]
    monkeypatch.setattr(decontaminate, "SLICE", 3000)
    got = [h for _, *x in decontaminate.split(pa.array(rows)) for h in scanner.all_hits(*x)]
    assert got == [scanner.hits(t) for t in rows] and {h[0] for hs in got for h in hs} == set(range(1, 50, 2))


def test_common_subsequence_against_tables():
    rng = random.Random(5)
    np = decontaminate.np
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(0, 30))]
        b = [rng.randrange(6) for _ in range(rng.randrange(1, 30))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = {}
        for i, y in enumerate(b):
            masks[y] = masks.get(y, 0) | 1 << i
        assert decontaminate.common_subsequence(np.array(a, dtype=np.int32), masks, len(b)).bit_count() == table[-1][-1]


def test_language_id(docs):
    learn_from = docs.where(F.col("doc_id") % 4 != 2)
    d = langid.learn(learn_from, F.col("text"), F.col("lang"), F.col("doc_id"))
    rows = {r["doc_id"]: r for r in langid.identify(docs, d, carry=("lang",)).collect()}
    real = [r for i, r in rows.items() if i is not None and i < 900_000 and i % 4 == 2]
    assert sum(r["lang_pred"] == r["c_lang"] for r in real) >= 0.95 * len(real)
    assert rows[900001]["lang_pred"] == rows[900002]["lang_pred"] == rows[900003]["lang_pred"] == "und" and rows[900001]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    kept = langid.accepted(docs, d)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in langid.identify(docs, d).where("accepted").collect())
    none = langid.learn(empty(docs), F.col("text"), F.col("lang"), F.col("doc_id"))
    assert none == {} and {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def test_language_id_odd_texts_and_samples(spark):
    """Signs that are no letters are und; every language is learned; one id with many rows is a bounded sample."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rng = random.Random(2)
    own = [["".join(rng.choice(alphabet[k % 20 : k % 20 + 6]) for _ in range(4)) for _ in range(30)] for k in range(70)]
    rows = [(k * 10 + i, " ".join(rng.choice(own[k]) for _ in range(60)), f"l{k:02}") for k in range(70) for i in range(4)] + [(1, "same words here " * 3, "l00")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionaries = langid.learn(docs, F.col("text"), F.col("lang"), F.col("doc_id"))
    assert len(dictionaries) == 70
    odd = spark.createDataFrame([(1, "\u00b2 \u00bd \u2460"), (2, "\u2167 12"), (3, None), (4, ""), (5, " ".join(own[69][:20])), (None, " ".join(own[3][:20]))], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, dictionaries).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 4)) and got[5][0] == "l69" and got[None][0] == "l03"


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    machine = toxicity.learn(docs, toxicity.choose(labels, F.col("toxic"), F.col("doc_id")))
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(odd, machine).collect()}
    assert got[1] == got[2] < 0.7
    assert toxicity.choose(labels.where("toxic = 0"), F.col("toxic"), F.col("doc_id")) is None
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}


def test_factorization_machine_learns_pairs():
    """Neither term tells alone; both together do."""
    rng = random.Random(2)
    np = toxicity.np
    rows, y = [], []
    for i in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array(sorted([1] * a + [2] * b + [10 + rng.randrange(5)])))
        y.append(float(a and b))
    m = toxicity.fit(rows, np.array(y), epochs=60)
    at = {int(b): i for i, b in enumerate(m.active)}
    both, one = m.logit(np.array([at[1], at[2]])), m.logit(np.array([at[1]]))
    assert both > 0 > one and float(m.v[at[1]] @ m.v[at[2]]) > 0


def test_factorization_machine_against_a_sum_over_pairs():
    rng = __import__("numpy").random.default_rng(4)
    machine = toxicity.Machine(rng.permutation(50), 0.3, rng.normal(size=50), rng.normal(size=(50, 8)))
    for _ in range(20):
        ids = rng.choice(50, size=rng.integers(0, 12), replace=False)
        force = machine.w0 + sum(machine.w[i] for i in ids) + sum(float(machine.v[i] @ machine.v[j]) for k, i in enumerate(ids) for j in ids[:k])
        assert abs(machine.logit(ids) - force) < 1e-9


def test_pairs_without_a_signal_of_their_own():
    """A group's name is as frequent in clean as in toxic texts; only beside the insult does it tell. Held-out texts."""
    rng = random.Random(9)
    plain = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(4_000):
        words = rng.sample(plain, 12)
        insult, group = rng.random() < 0.3, rng.random() < 0.5
        toxic = insult and group
        rows.append((" ".join(words + ["vile"] * insult + ["groupname"] * (group if insult else rng.random() < 0.64)), float(toxic)))
    rate = [sum("groupname" in t for t, y in rows if y == k) / sum(y == k for _, y in rows) for k in (0.0, 1.0)]
    kept = {}
    np = __import__("numpy")
    sets = [np.array(toxicity.buckets(t, kept), dtype=np.int64) for t, _ in rows]
    machine = toxicity.fit(sets[:3_000], np.array([y for _, y in rows[:3_000]]))
    assert set(toxicity.terms("groupname")) <= set(machine.active.tolist())
    right = [(machine.score(t) >= 0.5) == bool(y) for t, y in rows[3_000:]]
    assert sum(right) >= 0.99 * len(right) and rate[0] > 0.4
    assert machine.score("word1 vile") < 0.5 and machine.score("word1 groupname") < 0.5 < machine.score("word1 vile groupname")


def test_informative_terms_need_little_memory():
    """4 million terms of 4,000 documents: the terms chosen are those of a table of all, without one on the driver."""
    tracemalloc = __import__("tracemalloc")
    np = toxicity.np
    rng = np.random.default_rng(6)
    y = (np.arange(4_000) % 4 == 0).astype(float)
    rows = [np.unique(np.r_[rng.zipf(1.2, 1_000) % 50_000, rng.integers(50_001, toxicity.SPACE, 500), [50_000] * int(rng.random() < 0.2 + 0.5 * k)]).astype(np.int32) for k in y]
    tracemalloc.start()
    got = toxicity.informative(rows, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6

    def force(some):
        docs, bad = len(some), y[some].sum()
        if not 0 < bad < docs:
            return set()
        n, pos = (np.bincount(np.concatenate([rows[i] for i in ids]), minlength=toxicity.SPACE) for ids in (some, [i for i in some if y[i]]))
        p = n / docs
        z = (pos / bad - (n - pos) / (docs - bad)) / np.sqrt(p * (1 - p) * (1 / bad + 1 / (docs - bad)) + 1e-12)
        return set(np.flatnonzero((n >= toxicity.SUPPORT) & (abs(z) >= toxicity.SIGNAL)).tolist())

    alone = force(range(len(rows)))
    assert 50_000 in alone and set(got.tolist()) == alone.union(*(force([i for i in range(len(rows)) if b in rows[i]]) for b in alone))


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, "vile groupname"), (1, "vile groupname"), (2, "kind"), (3, None), (4, ""), (None, "vile"), (5, "kind " * 50_000)] + [(100 + i, "vile x" if i % 2 else "kind x") for i in range(60)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "y", "key", "terms")})
    marked = spark.createDataFrame([(100 + i, i % 2) for i in range(60)] + [(1, 1)], "doc_id long, toxic int")
    chosen = toxicity.choose(marked, F.col("toxic"), F.col("doc_id"), max_labelled=40)
    assert chosen[0].count() == 40 and chosen[1] == {0: 30, 1: 31}
    machine = toxicity.learn(docs, chosen)
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(docs, machine).collect()]
    by_id = dict(got)
    assert len(got) == docs.count() and by_id[1] > 0.7 > by_id[2] and by_id[3] == by_id[4] and by_id[None] > 0.7 and by_id[5] < 0.5
    assert toxicity.score(docs.where("false"), machine).count() == 0
    assert toxicity.choose(marked.where("toxic = 1"), F.col("toxic"), F.col("doc_id")) is None and toxicity.learn(docs, None) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def test_warc_odd_ids_and_one_task_a_bundle(spark, tmp_path):
    rows = [(None, None, "a" * 200), ("None", "u", "a" * 200), ("x\r\ny >%", "u", "b" * 150), ("null:", "u", "b" * 150), ("", "u", None), ("+ 1", "u", "c"), ("\u00e9", None, "d" * 300), ("\u00e9", None, "d" * 300)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    index = warc.write(pages, f"file://{tmp_path}/odd", bundles=5)
    records = warc.read(index)
    assert records.rdd.getNumPartitions() == index.agg(F.max("bundle")).first()[0] + 1
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.digest_of(records, "string").collect()), key=str)
    want = [(None, 200, "revisit", "None"), ("None", 200, "response", None), ("x\r\ny >%", 150, "revisit", "null:"), ("null:", 150, "response", None), ("", 0, "response", None), ("+ 1", 1, "response", None), ("\u00e9", 300, "response", None), ("\u00e9", 300, "response", None)]
    assert got == sorted(want, key=str)


def test_warc_round_trip(spark, tmp_path):
    same = "x" * 200
    rows = [(5, "http://a/5", same), (3, "http://a/3", same), (9, None, same), (1, "http://a/1", "short"), (2, "http://a/2", "short"), (4, "http://a/4", None), (6, "http://a\r\n6", "ü" * 60), (6, "http://b/6", "ü" * 60), (None, "http://n", same), (7, "http://a/7", "y" * 700_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    index = warc.write(pages, bundles=3)
    got = warc.digest_of(warc.read(index), "bigint").collect()
    force = []
    for i, _, h in rows:
        p = (h or "").encode()
        first = min((k for k, _, g in rows if k is not None and (g or "").encode() == p), default=None) if len(p) >= 100 else None
        revisit = first is not None and (i is None or i > first)
        force.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(tuple, got), key=str) == sorted(force, key=str)
    back = warc.fetch(index.where("page_id in (6, 7, 9)")).collect()
    assert sorted((r["page_id"], len(r["payload"])) for r in back) == [(6, 120), (6, 120), (7, 700_000), (9, 0)]
    assert warc.read(warc.write(pages.where("false"))).count() == 0


def test_seek_table_is_the_public_format(spark, tmp_path):
    out = (tmp_path / "b.zst").open("wb")
    w = warc.BundleWriter(out)
    data = [b"r%d" % i * 50_000 for i in range(9)]
    at = [w.add(d) for d in data]
    w.close()
    out.close()
    import zstandard

    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress((tmp_path / "b.zst").read_bytes())
    assert whole == b"".join(data)
    reader = warc.BundleReader(warc.pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / "b.zst")))
    for (frame, offset), d in zip(at, data):
        assert reader.frame(frame)[offset : offset + len(d)] == d


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=/x>%s</a></li></ul></nav><div class="ad">Buy %s</div><article><h1>Head %d</h1><p><b>One &amp; two\n  %d<br><p>Three</p></article><div class="tagline">%s</div><footer>&copy; x</footer></body></html>'


def test_html_text(spark):
    rows = [(i, f"http://h.example/{i}", PAGE % ("menu", "now", i, i, "Our house style")) for i in range(12)]
    rows += [(100, None, None), (101, "http://solo.example", "<p>Only &lt;this&gt;"), (102, "u", ""), (103, "http://cut.example/", "<article><p>a<p>b &amp; c<scr"), (104, "http://c", "<div id=comments><p>no</p></div><main><p>yes</p><form><p>q</p></form></main>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_text(pages).collect()}
    for i in range(12):  # the tagline is unmarked, but the same on each page of the host
        assert got[i][0] == f"Head {i}\nOne & two {i}\nThree"
    assert got[100] == ("", 0) and got[102] == ("", 0) and got[101][0] == "Only <this>"
    assert got[103][0] == "a\nb & c" and got[104][0] == "yes"
    assert html_text.extract_text(pages.where("false")).count() == 0


def test_style_trees_alone_remove_what_repeats(spark):
    """No element or class of these templates says what it is; branches repeat on their host, or on all hosts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for host in range(4):
        bar, note = " ".join(f"<i>{word()}</i>" for _ in range(5)), text(12)
        for i in range(15 if host else 40):
            body = [text(rng.randrange(8, 40)) for _ in range(rng.randrange(1, 6))]
            page = f"<div class=a{host}><div class=x>{bar}</div><article><h2>{body[0]}</h2>" + "".join(f"<p>{b}" for b in body[1:]) + f"<div class=y>{note}</div></article><section><div class=z>Made with the same tool</div></section></div>"
            rows.append((host * 100 + i, f"https://h{host}.example/{i}", page))
            want[host * 100 + i] = "\n".join(body)
    rows += [(900 + i, f"https://h0.example/copy{i}", rows[0][2]) for i in range(60)]  # copies of a page are no template
    want |= {900 + i: want[0] for i in range(60)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages, marks=False).collect()}
    assert got == want


def test_style_trees_read_the_middle_of_blocks(spark):
    """Blocks that begin and end alike on every page are no template if they differ between."""
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(8))
    body = [f"Good morning, readers. {'. '.join(text() for _ in range(8))}. See you tomorrow." for _ in range(40)]
    note = "Good morning, readers. Made with the same tool. See you tomorrow."
    rows = [(i, f"https://daily.example/{i}", f"<div><h1>{text()}</h1><p>{b}</p><div class=z>{note}</div></div>") for i, b in enumerate(body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n")[1:] for r in html_text.extract_text(pages, marks=False).collect()}
    assert got == {i: [b] for i, b in enumerate(body)}
    assert html_text.segments("One. Two | three; one. One \u2014 Four") == ["One", "Two", "three", "one", "Four"]


def test_style_features_move_alike_at_every_size(spark, monkeypatch):
    """Copies, pages on two hosts, and equal blocks under different empty elements; pages meet their weights by a merge join, few as they are."""
    page = lambda i, more="": f"<div class=a><p>Shared. Text {i} of its own. More {i}</p><b>Menu | Home</b>{more}</div>"
    rows = [(h, page(i)) for i in range(30) for h in (i % 3, 0) for _ in range(1 + i % 2)] + [(1, page(5, "<div><hr></div>")), (1, page(1, "<ul><li></ul>")), (2, ""), (2, None)]
    of = {}
    for host, source in rows:
        number, found = html_text.features(source)
        of.setdefault((host, number), set()).update(found)
    holders, n = {}, collections.Counter()
    for (_, number), found in of.items():
        n[number] += sum(f[3] for f in found)
        for f in found:
            if f[3]:
                holders.setdefault(f[2], set()).add(number)
    own = collections.Counter(next(iter(h)) for h in holders.values() if len(h) == 1)
    force = {}
    for (host, number), found in of.items():
        for f in (*found, (html_text.WHOLE, 0, 0, False)) if own[number] else ():
            force[host, *f] = force.get((host, *f), 0) + min(1, own[number] / n[number])
    plans = {}
    monkeypatch.setattr(html_text, "materialise", lambda df, name, write=html_text.materialise: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    pages = spark.createDataFrame(rows, "host long, html string").repartition(3)
    new = html_text.materialise(html_text.novelty(pages), "novelty")
    got = {tuple(r)[:5]: r["c"] for r in html_text.weighted(pages, new).collect()}
    assert got.keys() == force.keys() and all(abs(got[k] - c) < 1e-9 for k, c in force.items())
    assert html_text.unimportant(pages).count() > 0 and "SortMergeJoin" in plans["by-host"] and "BroadcastHashJoin" not in plans["by-host"]


def test_notes_do_not_take_the_page(spark):
    body = "<p>One two three four five</p><p>Six seven eight nine ten</p>"
    kept = "One two three four five\nSix seven eight nine ten"
    rows = [f"<div class='content-with-sidebar'><article>{body}</article></div>", f"<div class='layout no-sidebar'><div>{body}</div></div>", f"<div class='search-result-article'><main>{body}</main></div>", f"<article><div class='post share'>{body}</div></article>",
            f"<div class=legal>{body}</div>", f"<form id=aspnetForm><div>{body}</div><input></form>", f"<article>{body}<div class=share>Tell</div></article><section class=comments><article class=comment><p>no</article></section>", f"<form><p>Search</form><article>{body}</article>"]
    assert [html_text.extract(r, frozenset()) for r in rows] == [kept] * len(rows)


def test_html_is_read_in_linear_time(spark):
    import time

    took = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        html_text.extract("<div>" * n + "</section>" * n + "<p>" * n + "<li>" * n + "x", frozenset())
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.2
    long = "<article>" + "".join(f"<p>w{i} &amp; more</p>" for i in range(50_000)) + "</article>"
    odd = spark.createDataFrame([(None, "https://long.example/", long), (1, "no host", "<p>a"), (1, "no host", "<p>a"), (2, None, "<p>\t\n b \u00a0 c")], "page_id long, url string, html string")
    got = sorted(((r["page_id"] or 0, r["text"].count("\n"), r["n_chars"]) for r in html_text.extract_text(odd).collect()))
    assert got == [(0, 49_999, sum(len(f"w{i} & more") + 1 for i in range(50_000)) - 1), (1, 0, 1), (1, 0, 1), (2, 0, 3)]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        after = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(after) <= before and len(after) >= 0.5 * len(before), name
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert all(i == c for i, _, c in components_by_force(rows))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_pipeline_stages_on_odd_rows(spark, docs):
    """Nulls in any column, empties, repeated rows, a very long text, clashing columns, and empty tables."""
    import corpus_pipeline

    base = docs.where("doc_id < 900000").orderBy("doc_id").limit(60).unionByName(docs.where("doc_id is null or doc_id > 900000")).cache()
    base = base.unionByName(base.where("doc_id = 900006").withColumn("doc_id", F.lit(900007).cast("long")))
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    whole = rows(base)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, base, SF)
        assert kept.columns == base.columns and not rows(kept) - whole, name
        assert stage(spark, base.where("false"), SF).count() == 0, name
    language = rows(stages["language"](spark, base, SF))
    assert all((t and any(map(str.isalpha, t))) for _, t in language) and language[None, "A null id and some words to follow it"] in (0, 1)
    single = rows(stages["near_duplicates"](spark, base, SF))
    assert single[900005, "one two"] == 1 and single[900001, None] == 1 and single[900002, ""] == 1 and sum(i in (900006, 900007) for i, _ in single) == 1
    assert rows(stages["benchmark"](spark, base, SF))[900005, "one two"] == 2
    mixed = stages["mixture"](spark, base, SF)
    assert {"doc_id", "text", "weight", "epoch"} <= set(mixed.columns) and not set(whole) - set(rows(mixed))
    assert stages["mixture"](spark, base.where("false"), SF).count() == 0
