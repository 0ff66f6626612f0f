"""Importance resampling, language-model scoring and whitening against plain Python, and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import importance, ngram_model, whitening, words
from sparkloom.llm.storage import repeat_rows

from ..conftest import SF
from .test_llm import DOCS, empty, odd, prose  # noqa: F401

# ---- importance resampling


def plain_features(text, grams=1):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return found, [" ".join(found[i : i + n]) for i in range(len(found)) for n in range(1, grams + 1) if i + n <= len(found)]


def plain_draw(rows, target, grams=1, buckets=importance.BUCKETS, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, plain_features(text, grams)[1]))
    for text in target:
        t.update(map(bucket, plain_features(text, grams)[1]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out, pool = [], []
    for i, text in rows:
        found, features = plain_features(text, grams)
        weight = sum(gain(bucket(f)) for f in features)
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(found) >= least:
            pool.append(out[-1])
    pool.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, row in enumerate(pool[: percent * len(pool) // 100]):
        row[4] = k + 1
    return sorted(map(str, out))


@pytest.mark.parametrize("grams, buckets, percent, digit", [(1, 10_000, 10, 12), (3, 70_000, 50, 3), (2, 7, 100, 1)])
def test_draw_against_plain_python(spark, monkeypatch, grams, buckets, percent, digit):
    monkeypatch.setattr(importance, "DIGIT", digit)
    r = random.Random(5)
    rows = [(r.choice([i, i - 2**40, i + 2**62]), prose(r.randint(15, 60), r.randint(0, 60)) + r.choice(["", " Über Ünï 漢字-7", "\x00_x"])) for i in range(150)]
    rows += [rows[3]] * 30 + [(None, rows[4][1])] * 9 + [(rows[5][0], rows[6][1])] * 2 + [(7, None), (8, "")]
    target = [prose(40, k) for k in range(5)] + [None]
    docs, aim = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.draw(docs, aim, percent, grams, buckets).collect()
    assert sorted(str(list(x)) for x in got) == plain_draw(rows, target, grams, buckets, percent)


def test_draw_on_the_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(str(list(x)) for x in importance.op11_importance(spark, SF).collect()) == plain_draw(rows, target)


def test_draw_odd(spark, odd, empty):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(str(list(x)) for x in importance.draw(odd, odd, 30).collect()) == plain_draw(rows, [t for _, t in rows], percent=30)
    assert importance.draw(empty, odd).count() == 0
    assert {r.rank for r in importance.draw(odd, empty, 0).collect()} == {None}
    clash = odd.select("doc_id", "text", F.lit(1).alias("score"), F.lit(2).alias("a.b"), F.lit(3).alias("x`y"), F.create_map(F.lit(1), F.lit(2)).alias("rank"))
    assert importance.draw(clash, clash.select("text")).columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_selected_key_of_very_many_equal_rows(spark):
    rows = spark.range(9_000).select(F.lit(1).cast("long").alias("a"), F.when(F.col("id") < 30, F.col("id")).otherwise(77).alias("b"))
    assert importance.kth_key(rows, [F.col("a"), F.col("b")], 30) == ([1, 29], 29, 1)
    assert importance.kth_key(rows, [F.col("a"), F.col("b")], 5_000) == ([1, 77], 30, 8_970)
    got = repeat_rows(spark.createDataFrame([("a", 9_000), ("b", 1), ("c", 4096), ("d", 0)], "k string, copies long"), "copies", "i")
    assert {r.k: (r.n, r.d, r.m) for r in got.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("i").alias("d"), F.max("i").alias("m")).collect()} == {"a": (9_000, 9_000, 8_999), "b": (1, 1, 0), "c": (4096, 4096, 4095)}


@pytest.mark.parametrize("size", [1, 3, 7, 1 << 20])
def test_words_in_pieces(size):
    for text in ("", " ", "a", " ab  cde\n", "x" * 50, "one two-three  four " * 9, "é" * 20 + " b"):
        raw = text.encode()
        assert [w for part in words.split_words(raw, ngram_model._LOWER, size) for w in part] == raw.lower().split()


# ---- language-model scoring


def plain_tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + [None]


def plain_scores(rows, learned):
    """n_tokens, n_known, N, base and model score by exact counts of pairs, levels as defined."""
    c, two = Counter(), Counter()
    for text in learned:
        found = plain_tokens(text)
        c.update(found)
        two.update(zip(["<s>", *found], found))
    c["<s>"] = 0
    n, v = c.total(), len(c) - 1
    starts = c[None]
    base = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    out = {}
    for i, text in rows:
        found = plain_tokens(text)
        score = 0
        for a, b in zip(["<s>", *found], found):
            p, h = base(b), starts if a == "<s>" else c[a]
            if h and c[b]:
                most = max([math.ceil(1.5**k) for k in range(40) if math.ceil(1.5**k) <= two[a, b]], default=0)
                weight = ngram_model.MOST * h / (h + ngram_model.PRIOR)
                p += weight * (min(most, h, c[b]) / h - p)
            score += math.log10(p)
        out[i] = (len(found), sum(c[w] > 0 for w in found), n, sum(math.log10(base(w)) for w in found), score)
    return out


@pytest.mark.parametrize("limit", [ngram_model.LIMIT, 0])
def test_scores_against_plain_python(spark, monkeypatch, limit):
    """By the broadcast filter and by asking its shards, with many shards and blocks: base exactly, the model but for false answers of the filter."""
    for name, value in (("SHARD", 500), ("BLOCK", 4_000), ("BATCH", 90), ("WORDS", 40)):
        monkeypatch.setattr(ngram_model, name, value)
    r = random.Random(3)
    vocabulary = [prose(1, k) for k in range(80)]
    texts = ["  ".join(r.choices(vocabulary, range(80, 0, -1), k=r.randint(0, 80))) + r.choice(["", "\n", " Ä\x1f b", "\x0b X"]) for _ in range(120)] + [None, ""]
    rows = list(enumerate(texts * 2)) + [(900, "never seen before"), (901, texts[0] + " new")]
    learned = [t for i, t in rows if i % 10 and i < 900]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x[1:] for x in ngram_model.score(docs, docs.where("doc_id % 10 <> 0 AND doc_id < 900"), limit=limit).collect()}
    want = plain_scores(rows, learned)
    assert set(got) == set(want)
    apart = 0
    for i, (*exact, base, score) in want.items():
        assert list(got[i][:3]) == exact and got[i][3] == pytest.approx(base)
        assert got[i][4] >= score - 1e-9  # a false answer can only raise a level
        apart += abs(got[i][4] - score) > 1e-9
    assert apart < len(want) / 2 and sum(x[4] for x in got.values()) == pytest.approx(sum(x[4] for x in want.values()), rel=0.02)


@pytest.mark.parametrize("shards", [3, 70_000])
def test_pairs_travel_packed(spark, shards):
    """A batch sends one row for each shard, not one for each pair, and the rows hold every pair with its count."""
    texts = [f"a b w{k % 50} w{k % 7} a b" for k in range(200)]
    hashes = ngram_model._Hashes()
    plain = Counter(int(x) for t in texts for own in ngram_model._pair_hashes(t, hashes) for x in own)
    rows = ngram_model.count_pairs(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), shards).collect()
    got = [(r.shard, int(p), int(c)) for r in rows for p, c in zip(np.frombuffer(r.pairs, np.uint64), np.frombuffer(r.c, np.int32), strict=True)]
    assert {p: c for _, p, c in got} == plain and len(got) == len(plain) and all(p % shards == s for s, p, _ in got)
    assert len(rows) == len({r.shard for r in rows}) <= min(shards, len(plain))


def test_word_hashes_agree():
    words_ = [b"a", "é漢".encode(), ngram_model.END, ngram_model.START, b"x" * 1_000]
    hashes = ngram_model._Hashes()
    assert ngram_model.word_hashes(words_).tolist() == [hashes[w] for w in words_] and not len(ngram_model.word_hashes([]))


def test_filter_levels():
    r = np.random.default_rng(1)
    pair, count = r.integers(0, 1 << 63, 20_000).astype(np.uint64), r.zipf(1.6, 20_000).clip(max=10**6)
    size = -(-int(ngram_model.levels(count).sum()) * ngram_model.BITS // 64)
    built = ngram_model.Filter(1, {0: size})
    built.add(pair, count)
    got = built.levels(pair)
    assert (got >= ngram_model.levels(count)).all() and (got == ngram_model.levels(count)).mean() > 0.97
    assert (built.levels(r.integers(0, 1 << 63, 20_000).astype(np.uint64)) > 0).mean() < 0.02
    assert [int(x) for x in ngram_model.levels(np.array([1, 2, 3, 4, 5, 6]))] == [1, 2, 3, 4, 4, 5]


def test_model_beats_base_on_held_out_texts(spark):
    got = ngram_model.op12_lm_scoring(spark, SF).toPandas()
    held = got[got.held_out]
    assert len(held) and held.score.sum() > held.base_score.sum() and (got.score <= 0).all()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain_scores(docs, [t for i, t in docs if zlib.crc32(str(i).encode()) % 10])
    for r in got.itertuples():
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=0.05)


def test_scores_odd(spark, odd, empty):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = ngram_model.score(odd, odd).collect()
    want = plain_scores(rows, [t for _, t in rows])
    assert len(got) == len(rows) and sum(r.doc_id == 6 for r in got) == 3
    assert all(r.base_score == pytest.approx(want[r.doc_id][3]) for r in got if r.doc_id is not None)
    assert ngram_model.score(empty, odd).count() == 0
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in ngram_model.score(odd, empty).collect()} == {(0, 0, 0, 0)}
    clash = odd.select("doc_id", "text", F.lit(1).alias("block"), F.lit(2).alias("a.b"), F.create_map(F.lit(1), F.lit(2)).alias("word"))
    assert ngram_model.score(clash, clash).count() == len(rows)


# ---- whitening


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40])
def test_symmetric_qr(n):
    r = np.random.default_rng(n)
    a = r.normal(size=(n, n))
    for m in (a @ a.T, np.zeros((n, n)), np.eye(n), np.ones((n, n)), np.diag(np.arange(n) // 2.0), a @ a.T * 1e12, np.outer(a[0], a[0])):
        values, z = whitening.symmetric_qr(m)
        scale = max(1.0, np.abs(m).max())
        assert np.allclose(z @ m @ z.T, np.diag(values), atol=1e-11 * scale * n) and np.allclose(z @ z.T, np.eye(n), atol=1e-12)
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], atol=1e-11 * scale * n)


def test_moments_merge():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 6)) * 10 + 1e6
    parts = []
    for part in (x[:0], x[:1], x[1:300], x[300:]):
        parts.append(whitening.Moments(6))
        for row in part:
            parts[-1].add(row)
    total = whitening.Moments(6)
    for p in parts:
        total.merge(p.n, p.mean, p.scatter)
    assert total.n == 500 and np.allclose(total.mean, x.mean(0)) and np.allclose(total.scatter / 500, np.cov(x.T, bias=True), rtol=1e-9, atol=1e-9)


def check_whitened(rows, got, k=4):
    """rows: id and vector of those that take part, by exact fractions where the contract says exact."""
    width = max(len(v) for _, v in rows)
    whole = [(i, tuple([math.floor(256 * c) for c in v] + [0] * (width - len(v)))) for i, v in rows]
    fit = sorted({x for _, x in whole})
    n, k = len(fit), min(k, width)
    sums = [sum(x) for x in zip(*fit)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), []).append(r)
    assert len(got) == k * len(rows)
    flipped = None
    for i, x in whole:
        own = sorted(by[i, sum((n * a - s) ** 2 for a, s in zip(x, sums))], key=lambda r: r.component)[: k * 10]
        mine = [float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] @ vectors / np.sqrt(values)
        found = {r.component: r for r in own}
        assert set(found) == set(range(1, k + 1)) and {r.n for r in own} == {n}
        whitened = np.array([found[j + 1].whitened for j in range(k)])
        flipped = np.sign(whitened * mine) if flipped is None else flipped
        assert np.allclose(whitened * flipped, mine, rtol=1e-6, atol=1e-8)
        assert np.allclose([found[j + 1].explained for j in range(k)], values / np.trace(v), rtol=1e-9) and max(r.identity_error for r in own) < 1e-9


def test_whitening_on_the_tables(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitened(rows, whitening.op13_whitening(spark, SF).collect())


def test_whitening_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25, 3.0]), (2, [0.5, -0.25, 3.0]), (3, [-0.0, 1e-9, -1e-9]), (None, [2.0, 2.5]), (1, [7.25, 0.0, 1.0]), (4, [-0.3, 9.0, 2.0]), (5, [1.0, -4.0, 0.0])]
    bad = [(6, None), (7, [1.0, None, 2.0]), (8, [nan, 0.0, 0.0]), (9, [inf, 1.0, 1.0])]
    schema = "vec_id long, embedding array<double>"
    odd = spark.createDataFrame(rows + bad, schema).withColumn("x", F.lit("clash")).withColumn("a.b", F.lit(1)).withColumn("m", F.create_map(F.lit(1), F.lit(2))).repartition(4)
    check_whitened(rows, whitening.whiten(odd).collect())
    for nothing in ([], bad, [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(nothing, schema)).collect() == []
    one = whitening.whiten(spark.createDataFrame(rows[:2], schema)).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(9)], schema)).collect()
    assert {r.component for r in line if r.whitened is None} == {2} and max(r.identity_error for r in line) < 1e-9
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], schema)).collect()
    assert {r.deviation for r in huge} == {(1 << 63) - 1}
