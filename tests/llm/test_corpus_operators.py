"""Operators that compare documents, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import graph, mixing, near_dedup, suffix_dedup


def repeated(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        runs = int(np.count_nonzero(mask & ~np.append(False, mask[:-1])))
        kept = bytes(np.frombuffer(b, np.uint8)[~mask]) if len(b) else b""
        out.append((len(b), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_words(texts, length):
    """Whether each text holds a string of ``length`` words that also starts
    elsewhere."""
    raw = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    seen = defaultdict(int)
    for w in raw:
        for i in range(len(w) - length + 1):
            seen[tuple(w[i : i + length])] += 1
    return [any(seen[tuple(w[i : i + length])] > 1 for i in range(len(w) - length + 1)) for w in raw]


@pytest.mark.parametrize(("hot", "most"), [(2000, 2 << 20), (4, 700)])
def test_suffix_dedup(spark, hot, most):
    random.seed(7)
    words = ["".join(random.choices("abcdefgh", k=random.randint(1, 8))) for _ in range(200)]
    text = lambda n: " ".join(random.choices(words, k=n))
    passage, long = text(110), text(260)
    docs = [text(random.randint(0, 40)) + passage[random.randint(0, 30) : len(passage) - random.randint(0, 30)] + text(random.randint(0, 40)) for _ in range(40)]
    docs += ["ab " * 300, "ab " * 300, "x" * 399, "x" * 400, "x" * 401, None, "", long, long, long[:700] + "Z" + long[701:], "é" * 500, text(900), " \t".join(passage.upper().split()), "a b " * 26, "no " * 50]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(docs)] + [(7, docs[7], 2, "y"), (None, docs[3], 2, "z")], "doc_id long, text string, spans int, TEXT_ string").withColumnRenamed("TEXT_", "Doc_ID").repartition(4)
    rows = [(r[0], r[1]) for r in df.collect()]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    texts = [t for _, t in rows]
    want = order((d, a, long, some) for (d, _), a, long, some in zip(rows, repeated(texts), repeated_words(texts, 51), repeated_words(texts, 32), strict=True))
    got = order((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256), r.n_repeats) for r in suffix_dedup.digests(suffix_dedup.cut(df, hot=hot, most=most)).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    for (_, _, n), (_, _, long, some) in zip(got, want, strict=True):
        assert n > 0 if long else n == 0 if not some else n >= 0
    assert 5 < sum(x[2] > 0 for x in got) < len(got) - 5


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.cut(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_run_length_index_matches_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        rows = [rng.integers(0, 3, rng.integers(1, 12)).tolist() for _ in range(6)]
        text = np.array([x for k, r in enumerate(rows) for x in [*(v + 6 for v in r), k]])
        index = suffix_dedup.RunLengthIndex(text, 13)
        assert index.lengths.sum() == len(text) and (np.diff(index.heads) != 0).all()
        got = index.matching_statistics()
        for i in range(len(text)):
            best = 0
            for j in range(len(text)):
                n = 0
                while j != i and max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                    n += 1
                best = max(best, n)
            assert got[i] == best


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near(rows, k):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)] += [d] if d is not None else []
    label = [min(least[find(i)], default=None) for i in range(len(rows))]
    return sorted(((d is None, d or 0), len(sets[i]), label[i], d == label[i]) for i, (d, _) in enumerate(rows))


def test_near_duplicates(spark):
    random.seed(11)
    stock = [f"w{i}" for i in range(300)]
    data = []
    for g in range(4):
        first = random.choices(stock, k=50)
        for i in range(15):
            words = list(first)
            for _ in range(random.randint(0, 5)):
                words[random.randrange(50)] = random.choice(stock)
            data.append((g * 100 + i, " ".join(words)))
    data += [(500, None), (501, ""), (502, "one"), (503, "ONE"), (504, " one\ttwo "), (505, "One two"), (None, data[0][1]), (None, "only null"), (0, data[0][1]), (600, "x y " * 400)]
    df = spark.createDataFrame([(*r, 0) for r in data], "doc_id long, text string, set_id int").repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, k=2).collect())
    assert got == near(data, 2)


def test_drop_near_duplicates(spark):
    one = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(5, one, "a"), (3, one + " end", "b"), (3, one + " end", "b"), (9, "other text of its own", "c"), (7, None, "d"), (8, "", "e")], "doc_id long, text string, source string")
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8, 9]


def test_near_duplicates_empty(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (7, 7)] + [(300, 300 + i) for i in range(1, 40)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {150: 100, 200: 100} | {300 + i: 300 for i in range(1, 40)}


def test_mixing_meets_its_targets(spark):
    rng = random.Random(3)
    data = [(i, " ".join(["w"] * rng.randint(1, 40)), "big" if i % 3 else f"s{i % 5}") for i in range(900)] + [(2000, None, None), (2001, "", "empty")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("position", F.lit("clash"))
    mix = mixing.plan(docs, block_tokens=200)
    plan = {r.source: r for r in mix.collect()}
    used = mixing.realise(docs, mix)
    assert used.columns[:3] == ["doc_id", "text", "source"]
    uses = used.withColumn("n", mixing.tokens_of(F.col("text"))).groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.sum("n").alias("n")).collect()
    for r in uses:
        if plan[r.s].tokens:
            assert plan[r.s].target <= r.n < plan[r.s].target + 40
            assert 1 - 1e-9 <= plan[r.s].passes <= 2.0 + 1e-6
    assert used.select("doc_id").distinct().count() == len(data)
    assert used.groupBy("doc_id", "epoch").count().where("count > 1").count() == 0
    assert used.where("position < 0 or position >= 1").count() == 0
    assert abs(sum(r.weight for r in plan.values()) - 1) < 1e-6


def test_mixing_entropy_and_budget(spark):
    docs = spark.createDataFrame([(i, "a b c", "big" if i % 10 else "small") for i in range(400)], "doc_id long, text string, source string")
    mix = mixing.plan(docs, budget=900, repetition_limit=100.0, target_entropy=0.8).toPandas()
    entropy = -(mix.weight * np.log(mix.weight)).sum() / np.log(2)
    assert entropy == pytest.approx(0.8, abs=1e-3)
    p, a = mix.share, mix.exponent[0]
    assert np.allclose(mix.weight, p**a / (p**a).sum(), atol=1e-6)
    assert abs(mix.target.sum() - 900) <= 1
    none = docs.where("1 = 0")
    assert mixing.realise(none, mixing.plan(none)).count() == 0
