"""Inputs that are empty, null, repeated, long, or have clashing names; and
operators against brute force of their own."""

import cmath
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontam, langid, media, mixing, near_dedup, quality, secret_scan, suffix_dedup, tokens
from tidemark.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    """Nulls in every column, ties, repeated rows and names that clash by case
    or with what operators use."""
    rng = random.Random(2)
    stock = ["river", "stone", "walks", "slowly", "under", "green", "light", "and", "over", "quiet"]
    text = lambda n: " ".join(rng.choices(stock, k=n)) + "."
    same = text(80)
    rows = [(i, text(60 + i), "en", f"s{i % 3}", 5) for i in range(30)]
    rows += [(None, text(50), None, None, None), (None, None, None, None, None), (7, None, "en", "s0", 0), (8, "", "en", "s1", 0), (40, same, "en", "s0", 1), (40, same, "en", "s0", 1), (41, same + " end", "en", None, 1), (42, "!!!", None, "s2", 3)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("key", "whole", "position", "Epoch", "row", "h", "column_0", "x"):
        df = df.withColumn(name, F.lit(name))
    return df.toDF(*df.columns).select("*", F.lit(-1).alias("TEXT"), F.lit("y").alias("Doc_Id"), F.lit("z").alias("SOURCE"))


@pytest.fixture
def sf_dir(spark, tmp_path):
    """Labels and a test set beside the documents."""
    spark.createDataFrame([(i, 1 if i % 2 else 0, 0) for i in range(0, 30)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "river stone river stone river stone river stone river stone river"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}"


def test_stages_take_odd_tables(spark, sf_dir):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.where("1 = 0")):
            after = stage(spark, rows, sf_dir)
            got = after.collect()
            if name != "token_files":
                assert after.columns == docs.columns
            if rows is not docs:
                assert not got
            elif name == "minhash_near_dedup":
                texts = [r[1] for r in got]
                assert sum(t is not None and t.startswith(docs.where("n_chars = 1").first()[1][:60]) for t in texts) == 1
                assert sum(not t for t in texts) == 3 and len(got) == docs.count() - 2
            elif name in ("benchmark_decontamination", "token_files"):
                assert len(got) == docs.count()
            elif name == "source_mixing":
                assert set(map(tuple, got)) == set(map(tuple, docs.collect()))


def test_stages_without_labels_or_test_set(spark, sf_dir, tmp_path):
    docs = odd_documents(spark)
    none = f"file://{tmp_path}/none"
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").where("1 = 0").write.parquet(f"{none}/{t}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["quality_classifier"](spark, docs, none).count() == docs.count()
    assert stages["benchmark_decontamination"](spark, docs, none).count() == docs.count()


def test_operators_take_odd_tables(spark):
    docs = odd_documents(spark)
    n = docs.count()
    model, judge = langid.fit(docs), quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    runs = {
        "suffix": lambda d: suffix_dedup.digests(suffix_dedup.cut(d)),
        "near": lambda d: near_dedup.near_duplicates(d, k=2),
        "media": lambda d: media.digests(media.media_columns(d)),
        "langid": lambda d: langid.predict(d, model),
        "secrets": secret_scan.scan,
        "quality": lambda d: quality.score(d, judge),
        "tokens": lambda d: tokens.read_back(tokens.bases(tokens.encode_to_files(d, tokenizer_path()))),
        "decontam": lambda d: decontam.search(decontam.build_index(d), spark.createDataFrame([(1, "river stone")], "item_id long, text string")),
    }
    for name, run in runs.items():
        assert run(docs).count() == n, name
        assert run(docs.where("1 = 0")).count() == 0, name


def test_long_texts(spark):
    """A text of several blocks and a copy with one word changed."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    long = rng.choices(words, k=500_000)
    other = list(long)
    other[250_000] = "xxxxx"
    one, two = " ".join(long), " ".join(other)
    assert len(one) > 2.5 * 10**6
    docs = spark.createDataFrame([(0, one), (1, two), (2, "short")], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, k=2).collect()}
    assert got[1].component_id == 0 and got[2].component_id == 2 and got[0].n_shingles == len({(a, b) for a, b in zip(long[:-1], long[1:], strict=True)})
    found = decontam.search(decontam.build_index(docs), spark.createDataFrame([(9, " ".join(other[249_995:250_006]))], "item_id long, text string")).collect()
    assert {r.doc_id: r.n_hit for r in found} == {0: 0, 1: 11, 2: 0}
    cut = {r.doc_id: r for r in suffix_dedup.cut(docs).collect()}
    assert bytes(cut[1].kept) == b"xxxxx" and cut[0].n_removed == len(one) - len(long[250_000])
    assert cut[0].n_repeats > 20_000 and cut[2].n_repeats == 0


def test_token_pieces_make_the_same_ids():
    encoder = tokens.WordEncoder(tokenizer_path())
    text = "Hello, it's 12 o'clock \t naïve <|endoftext|> " * 40 + "x" * 90
    whole, n = encoder.encode(pa.array([text]), 2, "<u2")
    ids, count = [], 0
    for row, texts, last in tokens._pieces(pa.array([text]), True, 50):
        got, k = encoder.encode(texts, 2, "<u2")
        ids.append(got if last else got[:-1])
        count += k[0] - (not last)
        assert row == 0
    assert len(ids) > 10 and np.concatenate(ids).tolist() == whole.tolist() and count == n[0]


def test_word_encoder_equals_the_library():
    rng = random.Random(8)
    encoder = tokens.WordEncoder(tokenizer_path())
    letters = [*map(chr, range(1, 0x180)), "́", " ", "ǅ", "ﬁ", "İ", "😀", "中", "'s", "'LL", "<|endoftext|>", "  ", "12"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    ids, n = encoder.encode(pa.array(texts), 2, "<u4")
    at = 0
    for text, size in zip(texts, n.tolist(), strict=True):
        assert ids[at : at + size].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2], text
        at += size


def test_word_encoder_takes_plain_words_together(monkeypatch):
    """Only words that bytes don't settle are looked at one by one, and pieces
    met in every block are encoded once, however many others come and go."""
    rng = random.Random(9)
    monkeypatch.setattr(tokens, "KEPT_PIECES", 50)
    encoder = tokens.WordEncoder(tokenizer_path())
    alone, word, model, cut = [], encoder._word, encoder.model, Counter()

    class Model:
        def tokenize(self, piece):
            cut[piece] += 1
            return model.tokenize(piece)

    encoder.model = Model()
    monkeypatch.setattr(encoder, "_word", lambda x: alone.append(x) or word(x))
    for block in range(20):
        rare = ["".join(rng.choices("abcdefghijklmnop", k=12)) for _ in range(100)]
        texts = ["The river, the Été; 42 don't " + " ".join(rare), None, "", "Ωmega <|endoftext|>x 3×4"]
        ids, n = encoder.encode(pa.array(texts), 2, "<u2")
        want = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))
    assert set(alone) == {"don't", "Ωmega", "<|endoftext|>x", "3×4"}
    bytewise = "été".encode().decode("latin-1").translate(encoder.letters)
    assert [cut[x] for x in ("the", "river", ",", bytewise, "4", "don", "'t")] == [1] * 7
    for texts in ([None], ["", " \n"], ["中文", "'"]):
        ids, n = encoder.encode(pa.array(texts, pa.string()), 2, "<u2")
        assert ids.tolist() == [i for t in texts for i in [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]]


def test_fingerprints_against_plain_fourier_sums():
    for text in ("some words that vary a bit: " + "".join(map(chr, range(33, 127))) * 5, "é" * 100 + "abc" * 77):
        samples = media.payload(text)
        wave = [(b - 128) / 128 for b in samples]
        spectrum = []
        for at in range(0, len(wave) - media.FRAME + 1, media.FRAME // 2):
            frame = [x * (0.5 - 0.5 * math.cos(2 * math.pi * k / media.FRAME)) for k, x in enumerate(wave[at : at + media.FRAME])]
            spectrum.append([abs(sum(x * cmath.exp(-2j * math.pi * f * k / media.FRAME) for k, x in enumerate(frame))) for f in range(media.FRAME // 2 + 1)])
        assert np.allclose(spectrum, media.stft(samples), atol=1e-3)
        found = []
        for t, row in enumerate(spectrum):
            for low, high in zip(media.BANDS[:-1], media.BANDS[1:], strict=True):
                f = max(range(low, high), key=lambda k: row[k])
                if row[f] > sum(row) / len(row):
                    found.append((t, f))
        codes = []
        for t, f in found:
            later = [(u, g) for u, g in found if u > t]
            codes += [t << 32 | f << 20 | g << 8 | u - t for u, g in later[: media.FAN] if u - t <= media.REACH]
        assert media.fingerprint(samples).tolist() == sorted(codes)


def test_realised_mix_against_a_plain_count(spark):
    rng = random.Random(4)
    data = [(i if i % 9 else None, " ".join(["w"] * rng.randint(0, 30)) + f" {i}", "big" if i % 4 else f"s{i % 3}") for i in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    mix = mixing.plan(docs, block_tokens=100)
    plan = {r.source: r for r in mix.collect()}
    tokens_of = Counter()
    for _, t, s in data:
        tokens_of[s] += len(t.split())
    total = sum(tokens_of.values())
    share = {s: n / total for s, n in tokens_of.items()}

    def passes(a):
        z = sum(p**a for p in share.values())
        spent = max(tokens_of[s] / (share[s] ** a / z) for s in share)  # each source once at least
        return max(spent * share[s] ** a / z / tokens_of[s] for s in share)

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if passes(mid) <= mixing.REPETITION_LIMIT else (mid, high)
    assert plan["big"].exponent == pytest.approx(high, abs=2e-6)
    # of the last pass, the documents in order of their keys until the target is met
    keys = docs.select("source", "text", "doc_id", mixing.row_hash(F.col("doc_id"), F.col("text")).alias("row"))
    want = Counter()
    for s, p in plan.items():
        own = keys.where(F.col("source") == s).withColumn("k", mixing.key_of(F.col("row"), F.lit(p.full))).collect()
        left = p.target - p.full * p.tokens
        for r in sorted(own, key=lambda r: r.k):
            want[r.text] += p.full + (left > 0)
            left -= len(r.text.split())
    assert Counter(r.text for r in mixing.realise(docs, mix).collect()) == want


def test_kneser_ney_against_plain_counts():
    """Interpolated probabilities by their recursive definition."""
    words = {"x": ["abba", "aba", "bab", "ab", "ab", "abc"], "y": ["baca", "cab", "abba", "c"]}
    rows = []
    for lang, own in words.items():
        counts = Counter()
        for w in own:
            framed = f"\x02{w}\x03"
            counts.update(framed[e - n : e] for e in range(2, len(framed) + 1) for n in range(1, min(5, e) + 1))
        rows += [(lang, g, n) for g, n in counts.items()]
    model = langid.kneser_ney(pd.DataFrame(rows, columns=["lang", "gram", "n"]), ["x", "y"])
    uniform = 1 / (len({g for _, g, _ in rows if len(g) == 1}) + 1)
    for at, lang in enumerate(("x", "y")):
        raw = {g: n for la, g, n in rows if la == lang}

        def count(g):
            if len(g) == 5 or g[0] == "\x02":
                return raw[g]
            return sum(len(h) == len(g) + 1 and h[1:] == g for h in raw) or 1

        def discount(n):
            all_ = [count(g) for g in raw if len(g) == n]
            ones, twos = all_.count(1), all_.count(2)
            return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

        def p(context, symbol):
            n = len(context) + 1
            lower = p(context[1:], symbol) if context else uniform
            after = [g for g in raw if len(g) == n and g[:-1] == context]
            if not after:
                return lower
            total, d = sum(map(count, after)), discount(n)
            own = max(0, count(context + symbol) - d) if context + symbol in raw else 0
            return own / total + d * len(after) / total * lower

        for w in ("abba", "cab", "bb", "zzz", "aab"):
            framed = f"\x02{w}\x03"
            bits = -sum(math.log2(p(framed[max(0, e - 4) : e], framed[e])) for e in range(1, len(framed)))
            got, symbols = model.word_bits(pa.array([w]))
            assert got[0][at] == pytest.approx(bits, rel=1e-6) and symbols[0] == len(w) + 1


def test_quality_fit_against_a_direct_solution(spark):
    rng = np.random.default_rng(6)
    words = ["river", "stone", "walks", "slowly", "under", "Green", "light,", "and", "$$", "|", "over."]
    data = [(i, " ".join(rng.choice(words[: 4 + i % 8], rng.integers(3, 60)))) for i in range(240)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    y = np.array([float(i % 8 < 4 or i % 11 == 0) for i in range(240)])
    model = quality.fit(docs, spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int"))
    fold = np.array([r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("f")).orderBy("doc_id").collect()])
    stats = quality.document_statistics(pa.array([t for _, t in data]))
    scaled = np.clip((stats - stats.mean(axis=0)) / (stats.std(axis=0) + 1e-3), -quality.CLIP, quality.CLIP)
    w, b = quality._projection(stats.shape[1])
    z = np.hstack([np.sqrt(2 / quality.FEATURES) * np.cos(scaled @ w + b), np.ones((240, 1))])
    train = fold != 0
    # ridge as least squares with further rows
    penalty = np.sqrt(quality.RIDGE * train.sum() / 100)
    weights = np.linalg.lstsq(np.vstack([z[train], penalty * np.eye(z.shape[1])]), np.append(y[train], np.zeros(z.shape[1])), rcond=None)[0]
    assert np.allclose(model.raw(stats), z @ weights, atol=1e-6)
    # calibrated values: the min-max formula of isotonic regression
    raw = np.clip(((z[~train] @ weights + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = np.unique(raw)
    n, good = [np.array([f(y[~train][raw == k]) for k in bins]) for f in (len, np.sum)]
    n, good = np.concatenate([[0.5], n, [0.5]]), np.concatenate([[0.0], good, [0.5]])
    mean = lambda a, b: good[a : b + 1].sum() / n[a : b + 1].sum()
    want = np.array([max(min(mean(a, b) for b in range(k, len(n))) for a in range(k + 1)) for k in range(len(n))])
    at = np.interp((bins + 0.5) / quality.BINS * 2 - 0.5, model.knots, model.values)
    pools = [np.flatnonzero(want == v) for v in np.unique(want)]
    assert np.allclose(np.unique(model.values), [want[p[0]] for p in pools]) and (np.diff(at) >= -1e-12).all()


def test_no_control_string_stands_in_escaped_text():
    from tidemark.llm.chat import TagTemplate

    t, rng = TagTemplate(), random.Random(5)
    parts = [*t.RESERVED, "<", "\\", "[", "s>", "/s>", "|im_start|>", "\n", "x"]
    for _ in range(3000):
        turns = [("".join(rng.choices(parts, k=rng.randint(0, 3))), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for _ in range(2)]
        for text in (x for turn in turns for x in turn):
            assert not any(r in t.escape(text) for r in t.RESERVED) and t.unescape(t.escape(text)) == text
        assert t.parse(t(turns)) == turns


def test_secrets_by_repository_and_owner(spark):
    secret = "password = Zk81hsQw92"
    rows = [(i, secret, f"one/repo{i}") for i in range(3)] + [(10 + i, "password = Aa77hsQw92", f"one/repo{i}") for i in range(4)] + [(20 + i, "password = Bb66hsQw92", f"own{i}/r") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_live, r.n_example) for r in secret_scan.scan(docs).collect()}
    assert {got[i] for i in range(3)} == {(1, 0)}  # one owner, three repositories
    assert {got[10 + i] for i in range(4)} == {(0, 1)}  # four repositories
    assert {got[20 + i] for i in range(3)} == {(0, 1)}  # three owners


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from tidemark.llm import common

    class Context:
        isLocal = staticmethod(lambda: False)  # noqa: N815
        getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k: None)}))  # noqa: N815

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(ValueError, match=re.escape("spark.checkpoint.dir")):
        common.shared_dir(Session())
    assert common.shared_dir(spark)
