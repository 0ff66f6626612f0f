"""The operators of sparkloom.llm: SQL twins, brute force on small tables, and odd inputs."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import llm
from sparkloom.llm import chat, exact_dedup, language_id, mixing, near_dedup, pieces, shingles, suffix_dedup, suffix_sort, topk_search, toxicity, url_filter
from sparkloom.llm.graph import components

from ..conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, node string"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_as_sql(name, same):
    same(llm.queries()[name], llm.oracle_sql()[name])


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns whose names clash."""
    long = prose(60_000, 1)
    base = prose(120, 2)
    texts = [None, "", " ", "\n\t ", "a", "a b", base, base, base.replace(" ", "  ", 5), base + " end", long, long + " x", "ünïcödé — 漢字 🙂", "\x00 nul", "▁ mark ▁", "1234 ##", prose(40, 3)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None, "k", "s", "n") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, None, None, 1, "", "", ""), (None, "alone " + prose(9, 4), None, None, 1, "", "", "")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# ---- language ID


def test_language_held_out_accuracy(spark):
    got = language_id.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 10 and (held.lang == held.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_odd(spark, odd, empty):
    model = language_id.train(odd)
    got = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[15].lang_pred == "und" and got[0].score == 0
    assert got[6].lang_pred == "en"
    assert language_id.predict(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, language_id.train(empty)).collect()} == {"und"}


def test_language_ignores_slices():
    texts = [prose(30, k) for k in range(20)] + ["x"]
    whole, counts = language_id.buckets(texts)
    parts = [language_id.buckets([t])[0] for t in texts]
    assert [len(p) for p in parts] == counts.tolist() and (np.concatenate(parts) == whole).all()


def plain_ngrams(text):
    """Buckets of the n-grams of a text, straight from the definition."""
    import unicodedata

    out = ""
    for c in text.lower():
        if unicodedata.category(c)[0] == "L":
            out += c
        elif not out.endswith(" "):
            out += " "
    if not out.strip():
        return Counter()
    out = (out if out.endswith(" ") else out + " ") + "   "
    found = Counter()
    for at in range(len(out) - 3):
        h = 0
        for size, c in enumerate(out[at : at + 4], 1):
            h = ((h ^ ord(c)) * 0x01000193 + size) % (1 << 32)
            x = ((h ^ (h >> 15)) * 0x85EBCA6B) % (1 << 32)
            found[(x ^ (x >> 13)) % (1 << language_id.BITS)] += 1
    return found


TALES = ["Straße über 42 Häuser", "a", "  ab  cd", "x1y22z", "漢字 かな, abc", "It's a test.", "ends with space ", "ends with two  ", "İstanbul ŞÖÜ", "..!", "é", prose(300, 7), "abc " * 50]


def test_language_against_plain_python(spark, monkeypatch):
    """Counting and scoring, also in pieces of few characters and in steps of few terms, against plain Python; slices and lengths change nothing."""
    r = random.Random(10)
    rows = [(i, t, r.choice(["aa", "bb", "cc"])) for i, t in enumerate(TALES * 4)] + [(900, None, "aa"), (901, "text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.train(docs)
    counts = {x: Counter() for x in ("aa", "bb", "cc")}
    for _, t, lang in rows:
        if t and lang:
            counts[lang] += plain_ngrams(t)
    for k, lang in enumerate(model.languages):
        own = np.array([counts[lang][b] for b in range(1 << language_id.BITS)]) + language_id.SMOOTHING
        assert np.allclose(model.log_prob[:, k], np.log(own / own.sum()))
    for piece, terms in ((1 << 18, 1 << 21), (3, 1 << 21), (1 << 18, 40), (7, 1)):
        monkeypatch.setattr(language_id, "PIECE", piece)
        monkeypatch.setattr(language_id, "TERMS", terms)
        got, prob = language_id.score([*TALES, None, ""], model)
        for t, lang, p in zip([*TALES, "", ""], got, prob):
            grams = plain_ngrams(t)
            if not grams:
                assert lang == "und" and p == 0
                continue
            logits = model.log_prior + sum((n * model.log_prob[b] for b, n in grams.items()), np.zeros(3))
            assert lang == model.languages[int(logits.argmax())]
            assert p == pytest.approx(1 / np.exp(logits - logits.max()).sum())


def test_language_bounds_and_names(spark, monkeypatch):
    docs = spark.createDataFrame([(7, f"word {k % 3}", "ab"[k % 2]) for k in range(200)], "doc_id long, text string, lang string")
    model = language_id.train(docs, per_language=10)  # one id for all rows: it is chosen for all or none
    assert set(model.languages) == {"a", "b"}
    got = language_id.predict(docs.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1)), model, keep=("doc_id", "score", "lang_pred"))
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.count() == 200
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError, match="more than 1"):
        language_id.train(docs)


# ---- exact dedup


def test_fingerprints_compose():
    text = prose(5_000, 5).encode()
    whole = exact_dedup.fingerprints([text])[0]
    for cut in (0, 1, 777, 4096, len(text)):
        a, b = exact_dedup.fingerprints([text[:cut], text[cut:]])
        assert a + b == whole
    assert len({f.packed for f in exact_dedup.fingerprints([text, text[:-1], text + b" ", text[1:]])}) == 4


def brute_copies(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    return {(i, min((x for x in ids if x is not None), default=None), len(ids), sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}


def test_exact_odd(odd, empty):
    got = exact_dedup.exact_classes(odd).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == brute_copies(odd.collect())
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert exact_dedup.exact_classes(empty).count() == 0
    kept = exact_dedup.keep_documents(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def check_exact(rows):
    """Groups, sizes and the one kept row of each, and the rows that a filter keeps, against plain Python."""
    found = rows.collect()
    got = exact_dedup.exact_classes(rows).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(each_copy(found))
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.keep_documents(rows)
    assert kept.columns == rows.columns
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert Counter((r.doc_id, sha256(plain(r.text).encode()).hexdigest()) for r in kept.collect()) == Counter((r.doc_id, r.text_sha256) for r in got if r.kept)


def each_copy(rows):
    of = {(i, digest): (i, least, n, digest) for i, least, n, digest in brute_copies(rows)}
    return [of[r.doc_id, sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()] for r in rows]


@pytest.mark.parametrize("ids", [(1, 2), (None, None), (1, 1), (1, None), (None, 1)])
def test_exact_keeps_texts_that_collide(spark, ids):
    """Two texts with one fingerprint under the bases and primes in use."""
    texts = ["nlmnlomnlllmllmnlomlnn", "lommolnlonnmoonlolnolm"]
    assert len({f.packed for f in exact_dedup.fingerprints([t.encode() for t in texts])}) == 1
    rows = [*zip(ids, texts), (ids[0], texts[0]), (7, texts[1]), (None, texts[0])]
    check_exact(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(r.text for r in corpus_pipeline.remove_copies(spark, docs, SF).collect()) == sorted(texts)


def test_exact_survives_collisions(spark, odd, monkeypatch):
    """All texts of a length modulo three share a fingerprint, so members differ in many rounds; ids are null, repeated and shared."""
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda texts: [exact_dedup.Fingerprint(len(t), (0, len(t) % 3)) for t in texts])
    scan = exact_dedup._scan
    monkeypatch.setattr(exact_dedup, "_scan", lambda rows: scan(rows).withColumn("n_bytes", F.lit(0).cast("long")))
    monkeypatch.setattr(exact_dedup, "COMPARED", 7)
    texts = ["ab", "ba", "abc", "cab", "a b", "a  b", "", None, "x" * 30, "x" * 29 + "y", "y" + "x" * 29]
    rows = [(i, t) for n, t in enumerate(texts) for i in (n, n % 3, None, None)]
    check_exact(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


ODD_NAMES = ["a.b", "c`d", "`", "e f", "ü.`x", "__mark2"]


def odd_columns(docs):
    """docs with columns whose names need quotes, and of types that have no order."""
    for k, name in enumerate(ODD_NAMES):
        docs = docs.withColumn(name, F.lit(k))
    return docs.withColumn("m.p", F.create_map(F.lit("k"), F.col("n_chars"))).withColumn("st", F.struct(F.lit(1).alias("x.y"), F.array(F.create_map(F.lit(1), F.lit(2))).alias("z`")))


def test_pipeline_stages_with_any_columns(spark, tmp_path):
    """Every stage but the last gives back the columns of documents, whatever their names and types, and the rows that it gives without them."""
    import corpus_pipeline

    docs = odd_ids(spark).unionByName(spark.createDataFrame([(i, f"{'awful' if i % 2 else 'fine'} " + prose(30, 700 + i), "en", "s1", i) for i in range(100, 140)], "doc_id long, text string, lang string, source string, n_chars int"))
    labels(spark, [(i, 1, i % 2) for i in range(100, 140)]).write.parquet(f"{tmp_path}/labels.parquet")
    wide = odd_columns(docs)
    wide = wide.unionByName(wide.where("doc_id = 4"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, wide, str(tmp_path))
        rows = got.collect()
        assert rows, name
        if not name.startswith("SentencePiece"):
            assert got.schema.simpleString() == wide.schema.simpleString(), name
            assert all(r["m.p"] == {"k": r.n_chars} and r["st"]["x.y"] == 1 for r in rows), name
            assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in stage(spark, wide.select(*(f"`{c}`" for c in docs.columns)), str(tmp_path)).collect()) or name.startswith("mixing")


# ---- mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return {**stopped, **share}
        stopped.update({s: most * sizes[s] for s in over})


def check_mix(docs, got, block):
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1


@pytest.mark.parametrize("block", [1, 7, 8192])
def test_mix_odd(odd, empty, block):
    rows = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = mixing.mix(rows, block=block if block > 7 else 64 * block).collect()
    assert len(got) == rows.count()
    check_mix(rows, got, block)
    assert {r.size for r in got if r.doc_id in (0, 1, 2, 3)} == {0}
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(rows.repartition(5), block=block if block > 7 else 64 * block).collect()))


def test_mix_repeats_nulls_and_nothing(spark, odd, empty):
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0), (0, 0)]
    assert mixing.repeat_documents(odd).columns == odd.columns


@pytest.mark.parametrize("quotas", [(600, 300, 100), (5_000, 17, 1_200, 3, 999), (1,), (700, 700)])
def test_every_prefix_of_the_schedule_is_even(spark, quotas):
    """Any number of first slots has each source's share to within log2(n) + 2; sources one behind the other would be off by hundreds."""
    sources = spark.createDataFrame(list(enumerate(quotas)), "number long, quota long")
    got = sorted((r.slot, r.number, r.rank) for r in mixing.schedule(sources, 1).collect())
    assert len({s for s, _, _ in got}) == len(got) and Counter(n for _, n, _ in got) == Counter(dict(enumerate(quotas)))
    for k, quota in enumerate(quotas):
        assert [r for _, n, r in got if n == k] == list(range(quota))  # in the order of slots
    had, total = [0] * len(quotas), sum(quotas)
    for n, (_, k, _) in enumerate(got, 1):
        had[k] += 1
        for h, quota in zip(had, quotas):
            assert abs(h - n * quota / total) <= np.log2(n) + 2


def test_mix_says_where_documents_stand(spark):
    """first_slot and n_blocks against the schedule, block by block in plain Python; the rows of the mix follow it."""
    r = random.Random(9)
    rows = [(i, prose(r.randint(0, 90), 600 + i), "abcd"[min(3, int(r.random() ** 2 * 6))]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {x.doc_id: x for x in mixing.mix(docs, block=64).collect()}
    size, source = {i: len(t.split()) for i, t, _ in rows}, {i: s for i, _, s in rows}
    sizes = Counter()
    for i in size:
        sizes[source[i]] += size[i]
    names = sorted(sizes)
    quota = {s: int(t) for s, t in brute_targets(sizes).items()}
    slots = {(x.number, x.rank): x.slot for x in mixing.schedule(spark.createDataFrame([(k, quota[s]) for k, s in enumerate(names)], "number long, quota long"), 64).collect()}
    for k, s in enumerate(names):
        stream = [i for i in sorted((i for i in size if source[i] == s), key=lambda i: (sha_order(i), i)) for _ in range(size[i])]
        words = (stream * 4)[: quota[s]]
        where = defaultdict(list)
        for at in range(0, len(words), 64):
            for part in {(i, p // len(stream)) for p, i in enumerate(words[at : at + 64], at)}:
                where[part[0]].append(slots[k, at // 64])
        for i in set(stream):
            assert (got[i].first_slot, got[i].n_blocks) == (min(where[i], default=-1), len(where[i])), (i, s)
    order = [x.doc_id for x in mixing.repeat_documents(docs).collect()]
    assert Counter(order) == Counter({i: n for i, x in got.items() if x.size and (n := (2 * x.taken + x.size) // (2 * x.size))})


def test_mix_rows_follow_the_schedule(spark, monkeypatch):
    """Any stretch of the mixed rows is near the weights."""
    monkeypatch.setattr(mixing._mix, "__defaults__", (mixing.WEIGHTS, mixing.MOST, 40, "doc_id", "text", "source", {}))
    docs = spark.createDataFrame([(i, prose(20, i), "abc"[i % 3]) for i in range(900)], "doc_id long, text string, source string").repartition(4)
    mixed = [x.source for x in mixing.repeat_documents(docs).collect()]
    for at in range(0, len(mixed) - 160, 80):
        part = Counter(mixed[at : at + 160])
        assert all(abs(part[s] / 160 - w / 8) < 0.15 for s, w in zip("abc", (5, 2, 1)))


# ---- chat


def test_chat_odd(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (4, 0, "user", "other"), (5, 0, None, None), (5, 0, None, None), (None, 0, "user", "lost"), (6, None, "user", "a"), (6, 1, "user", "b"), (7, 1, "user", "hi"), (7, 1, "user", "zz")]
    frame = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, k string")
    got = {r.conv_id: r for r in chat.render(frame).collect()}
    assert set(got) == {2, 4, 5, 6, 7} and got[2].n_copies == 2 and got[2].n_turns == 2
    assert got[2].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert got[5].text == "<|im_start|>user\n<|im_end|>\n" and got[6].text.index("\na") < got[6].text.index("\nb")
    assert chat.render(frame.limit(0)).count() == 0


# ---- URL filter


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("https://WWW.Example.com/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
        ("http://x.net/fr/", "x.net", "/fr/", "net/fr/", "block"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("http://x.com?q=/en/", "x.com", "", None, "allow"),
        ("x.net/es/", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://cheap-pills.org/a", "cheap-pills.org", "/a", None, "block"),
        ("http://cheap-cheap.org/a", "cheap-cheap.org", "/a", None, "allow"),
        ("http://casinos.org/", "casinos.org", "/", None, "allow"),
        ("http://a.org/CASINO", "a.org", "/CASINO", None, "block"),
        ("http://a.net:80/es/\n?", "a.net:80", "/es/\n", None, "allow"),
    ],
)
def test_url(spark, url, host, path, rule, verdict):
    frame = spark.createDataFrame([(1, url, "host")], "page_id long, url string, host string")
    r = url_filter.filter_urls(frame).first()
    assert (r.page_id, r.host, r.path, r.rule, r.verdict) == (1, host, path, rule, verdict)


def test_url_empty(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_rows(spark):
    """Repeated rows, very long urls, and rules of equal length."""
    long = "http://a.net/" + "x/" * 300_000 + "casino"
    frame = spark.createDataFrame([(1, long), (1, long), (2, "http://b.c.org/ab"), (None, "http://c.org/")], "page_id long, url string")
    rules = [url_filter.Rule("block", "c.org", "/ab"), url_filter.Rule("allow", "b.c.org", "/"), url_filter.Rule("block", "b.c.org", "/")]
    got = sorted(((r.page_id, r.rule, r.verdict, len(r.path)) for r in url_filter.filter_urls(frame, rules=rules).collect()), key=str)
    assert got == sorted([(1, None, "block", 600_007)] * 2 + [(2, "b.c.org/", "block", 3), (None, None, "allow", 1)], key=str)


def test_url_vocabulary_of_a_table(spark, monkeypatch):
    terms = spark.createDataFrame([("Bad", True), ("Bad", True), ("meh", False), ("so-so", False), (None, True), ("", False), ("x", None)], "term string, strict boolean")
    own = url_filter.vocabulary_of(terms)
    assert own == url_filter.Vocabulary(("Bad",), ("meh", "so-so"))
    hits = {u: url_filter.vocabulary_hits(u, own) for u in ("http://a/bad.bad", "http://a/badly", "http://a/meh-meh-so-so")}
    assert list(hits.values()) == [(2, 0), (0, 0), (0, 2)]
    monkeypatch.setattr(url_filter, "MOST_TERMS", 1)
    with pytest.raises(ValueError, match="more than 1 terms"):
        url_filter.vocabulary_of(terms)


def test_chat_names_and_long_conversations(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(3_000)] + [(2, k, "user", f"t{k}") for k in range(2_999)] + [(3, 0, "user", "x" * 1_000_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' n_turns", "'x' k", "'x' a", "'x' p0", "'x' turns")
    got = {r.conv_id: r for r in chat.render(frame).collect()}
    assert set(got) == {1, 3} and got[1].n_turns == 3_000 and len(got[3].text) > 1_000_000


# ---- near duplicates


def brute_near(rows):
    sets = shingles.shingle_sets([r.text for r in rows])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a in range(len(rows)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r.doc_id)
    least = {i: min((x for x in ids[find(i)] if x is not None), default=None) for i in range(len(rows))}
    return Counter((r.doc_id, least[i], links[i]) for i, r in enumerate(rows))


def near_rows(spark):
    r, rows = random.Random(3), []
    for g in range(12):
        words = prose(60 + 20 * g, g).split()
        for _ in range(1 + g):
            copy = list(words)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = "new" + str(r.random())[2:6]
            rows.append((len(rows), " ".join(copy)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("block", [3, 512])
def test_near_brute(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "VERIFIED", block)
    docs = near_rows(spark)
    got = Counter(map(tuple, near_dedup.near_classes(docs).collect()))
    assert got == brute_near(docs.collect())


def test_near_odd(odd, empty):
    got = Counter(map(tuple, near_dedup.near_classes(odd).collect()))
    assert got == brute_near(odd.collect())
    assert near_dedup.near_classes(empty).count() == 0
    check_kept(odd, near_dedup.keep_one_each(odd))
    assert near_dedup.keep_one_each(empty).count() == 0


def check_kept(docs, kept):
    """One row for each class: of its smallest id, or without one where it has none; and every row without words."""
    rows = docs.collect()
    sets = shingles.shingle_sets([r.text for r in rows])
    classes = near_components(rows, sets)
    want = Counter()
    for members in classes.values():
        least = min((rows[i].doc_id for i in members if rows[i].doc_id is not None), default=None)
        want.update([least] if len(sets[members[0]]) else [rows[i].doc_id for i in members])
    got = kept.collect()
    assert kept.columns == docs.columns and Counter(r.doc_id for r in got) == want
    texts = [t for members in classes.values() for t in {rows[i].text for i in members}]
    assert {(r.doc_id, r.text) for r in got} <= {(r.doc_id, r.text) for r in rows} and len(texts) >= len(classes) - 1


def near_components(rows, sets):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    out = defaultdict(list)
    for i in range(len(rows)):
        out[find(i)].append(i)
    return out


def test_near_keeps_one_of_lost_and_repeated_ids(spark):
    """An id with texts of two classes, a class without any id, and rows that repeat."""
    a, b, c = (prose(60, 500 + k) for k in range(3))
    rows = [(1, a), (1, b), (0, b + " end"), (None, c), (None, c + " end"), (2, a + " end"), (2, a + " end"), (5, a), (5, "x y"), (5, "x y"), (6, None), (6, "?")]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    assert Counter(map(tuple, near_dedup.near_classes(docs).collect())) == brute_near(docs.collect())
    kept = near_dedup.keep_one_each(docs)
    check_kept(docs, kept)
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text == "x y") == [(5, "x y")]


def test_near_large_groups(spark, monkeypatch):
    """Groups of many blocks: close copies of one text, copies at about the threshold's distance from it, chains, long and short members, copies of members."""
    monkeypatch.setattr(near_dedup, "VERIFIED", 8)
    r, texts = random.Random(12), []
    for g, (n, edits, words) in enumerate([(90, 1, 150), (60, 9, 180), (60, 4, 120), (40, 2, 60)]):
        base = prose(words, 700 + g).split()
        for k in range(n):
            copy = list(base)
            if g == 3:
                copy = copy[k // 2 :] + prose(k // 2, 800).split()
            for _ in range(r.randint(0, edits)):
                copy[r.randrange(len(copy))] = "x" + str(r.random())[2:7]
            if g == 0 and k % 9 == 0:
                copy += prose(r.randint(1, 30), k).split()
            texts += [" ".join(copy)] * (1 + (k % 13 == 0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert Counter(map(tuple, near_dedup.near_classes(docs).collect())) == brute_near(docs.collect())


def shuffled(spark, work, name):
    """Bytes that the jobs of some work write for shuffles."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    work()
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {k for job in tracker.getJobIdsForGroup(name) for k in tracker.getJobInfo(job).stageIds}
    context.setJobGroup("", "")
    return sum(store.lastStageAttempt(k).shuffleWriteBytes() for k in stages)


def test_near_large_buckets_move_little(spark, monkeypatch, request):
    """Members of large buckets are looked up once, and only what is compared of their signatures moves."""
    docs = near_rows(spark).localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables that are too large for it
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    large = shuffled(spark, lambda: near_dedup.near_classes(docs).collect(), "large")
    assert large < 8_000 * docs.count()  # 6,900; with whole signatures, and a look-up for each use, 10,000


def test_posterior_pruning_keeps_the_threshold():
    needed = near_dedup.least_matches()
    assert list(needed) == sorted(needed) and needed[-1] < 0.8 * 128
    r = np.random.default_rng(0)
    a = r.integers(0, 256, (4000, 128), np.uint8)
    b = np.where(r.random(a.shape) < 0.8, a, r.integers(0, 256, a.shape, np.uint8))
    c = np.where(r.random(a.shape) < 0.3, a, r.integers(0, 256, a.shape, np.uint8))
    both = np.concatenate((a, b, c))
    k = np.arange(4000)
    assert len(near_dedup.surviving(both, k, k + 4000, needed)) == 4000
    assert len(near_dedup.surviving(both, k, k + 8000, needed)) == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 200), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 100: 100, 101: 100, 300: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- top-k search


def test_search_brute(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=9).tolist()) for i in range(700)]
    rows += [(i, rows[3][1]) for i in range(700, 730)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for q, rank, i, s in topk_search.search(frame, frame.where("vec_id % 50 = 0"), k=7).orderBy("query_id", "rank").collect():
        got[q].append((i, s))
    v = {i: np.floor(256 * np.array(x)).astype(int) for i, x in rows}
    for q in range(0, 730, 50):
        want = sorted(((i, int(v[i] @ v[q])) for i in v if i != q), key=lambda x: (-x[1], x[0]))[:7]
        assert got[q] == want


def test_search_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [2.0]), (6, []), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (None, [9.0, 9.0])]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, score int")
    got = topk_search.search(frame, frame.where("vec_id = 0"), k=9).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 5, 256 * 512), (2, 7, 128 * 128), (3, 7, 128 * 128), (4, 6, 0)]
    assert topk_search.search(frame.limit(0), frame.limit(0)).count() == 0


def test_search_of_extreme_numbers(spark):
    import math
    from fractions import Fraction

    values = [0.0, 1.0, -1.0, 0.1, 1e18, -1e18, 3e300, 5e-324, 1.7e308, 2.0**45, 123456.789]
    r = random.Random(8)
    rows = [(i, [r.choice(values), r.choice(values)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    units = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in rows}
    capped = lambda s: max(-(1 << 124), min(1 << 124, s))
    got = defaultdict(list)
    for x in topk_search.search(frame, frame.where("vec_id % 7 = 0"), k=4).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    for q in range(0, 60, 7):
        scores = {i: sum(a * b for a, b in zip(units[i], units[q])) for i in units if i != q}
        best = [s for _, s in sorted(((i, s) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))[:4]]
        assert [min((1 << 63) - 1, max(-(1 << 63), s)) for s in best] == [s for _, s in got[q]]
        assert all(min((1 << 63) - 1, max(-(1 << 63), scores[i])) == s for i, s in got[q])
        assert [i for i, _ in got[q]] == [i for i, _ in sorted(scores.items(), key=lambda x: (-capped(x[1]), x[0]))[:4]] or max(map(abs, scores.values())) >= 1 << 124


@pytest.mark.parametrize("elements", [1 << 22, 40_000])
def test_search_thousands_through_the_index(spark, monkeypatch, elements):
    """Clustered rows, one vector shared by very many of them, ties and own rows, in one block and in several."""
    monkeypatch.setattr(topk_search, "ELEMENTS", elements)
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16))
    v = centres[r.integers(0, 40, 5_500)] + 0.2 * r.normal(size=(5_500, 16))
    v[r.random(5_500) < 0.3] = v[7]
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).astype(float)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for q, rank, i, s in topk_search.search(frame, frame.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[q].append((i, s))
    units = np.floor(256 * v).astype(np.int64)
    for q in range(0, 5_500, 100):
        scores = units @ units[q]
        scores[q] = -(10**9)
        assert got[q] == [(int(i), int(scores[i])) for i in np.lexsort((np.arange(5_500), -scores))[:5]]


def test_search_stops_on_proof():
    r = np.random.default_rng(4)
    clustered = r.normal(size=(100, 64))[r.integers(0, 100, 6_000)] + 0.1 * r.normal(size=(6_000, 64))
    for v, most in ((clustered, 0.3), (r.normal(size=(6_000, 64)), 0.8)):
        v = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True))
        ids = np.arange(6_000)
        index = topk_search.Index(ids, v, np.float32)
        found, processed = index.search(ids[:64], v[:64], 5)
        assert 0 < processed.mean() < most * sum(index.segments) and processed.max() < sum(index.segments)
        for q, (best, scores) in enumerate(found):
            want = (v @ v[q]).astype(int)
            want[q] = -(10**9)
            order = np.lexsort((ids, -want))[:5]
            assert best.tolist() == order.tolist() and scores.tolist() == want[order].tolist()


# ---- suffix dedup


def test_suffix_array():
    r = random.Random(2)
    for _ in range(3_000):
        text = bytes(r.choice(b"abc" if r.random() < 0.7 else b"a") for _ in range(r.randint(0, 40)))
        assert suffix_sort.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute_removals(rows, n=200):
    raw = [(r.text or "").encode() for r in rows]
    count = Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
    out = []
    for r, t in zip(rows, raw):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((np.diff(gone.astype(int), prepend=0) > 0).sum())
        out.append((r.doc_id, len(t), int(gone.sum()), spans, sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def passage_rows(spark):
    shared, line = prose(70, 20), prose(35, 21) + "\n"
    r = random.Random(4)
    texts = [prose(r.randint(5, 60), 100 + k) + shared[r.randrange(20) :] + prose(r.randint(0, 60), 200 + k) for k in range(30)]
    texts += [line * k for k in range(4)] + ["ab" * 150, "a" * 450, shared, shared[:199], shared[:200], shared[1:201], "é" * 150, texts[0], texts[0] + "!"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("group", [2, 512])
def test_removals_brute(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    docs = passage_rows(spark)
    got = sorted(map(tuple, suffix_dedup.removals(docs).collect()), key=str)
    assert got == brute_removals(docs.collect())


def test_removals_of_periodic_texts(spark, monkeypatch):
    """Stretches of many periods, alone, between other words, broken by a byte, and their single windows in other texts; also where a stretch goes over the edges of pieces."""
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 3_000)
    r = random.Random(8)
    unit = lambda p: "".join(r.choices("abcdefgh ", k=p))
    texts = ["x" * 5_000, "x" * 200, "y" * 200, "y" * 201, prose(50, 1) + "y" * 900 + prose(50, 2), "z" * 700 + "!" + "z" * 700, ("ab" * 2_000)[:3_777], "ab" * 110, "ba" * 100, "", None]
    for p in (2, 3, 7, 63, 64, 65, 100, 136, 137, 138, 150, 199, 200, 260):
        u = unit(p)
        texts += [prose(r.randint(0, 40), p) + (u * 4_000)[: r.randint(6, 14) * max(p, 200)] + prose(r.randint(0, 40), p + 1), (u * 300)[3:203]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, suffix_dedup.removals(docs).collect()), key=str) == brute_removals(docs.collect())


@pytest.mark.parametrize("unit", [b"a", b"ab", b"0123456789" * 9])
def test_periodic_texts_have_few_anchors(unit):
    data = np.frombuffer((unit * (1 << 22))[: 1 << 22], np.uint8)
    place, *_, stretches = suffix_dedup.anchors(data, np.array([len(data)]))
    assert len(place) < 400 and (stretches[:, 1] - stretches[:, 0]).sum() > 0.9 * len(data)


def test_contexts_without_company_share_nothing():
    r = random.Random(7)
    for _ in range(300):
        width = r.choice([1, 2, 3, 35, 137])
        core = bytes(r.choice(b"ab") for _ in range(suffix_dedup.LENGTH + width - 1))
        group, contexts, leads = [], [], []
        for _ in range(r.randint(1, 9)):
            whole = bytearray(core)
            for _ in range(r.randint(0, 2)):
                whole[r.randrange(len(whole))] = r.choice(b"xy")
            low = r.randrange(width)
            high = r.randrange(low, width)
            group.append(r.randrange(2)), contexts.append(bytes(whole[low : high + suffix_dedup.LENGTH])), leads.append(low)
        may = suffix_dedup.with_company(group, contexts, leads, width)
        for k, (low, high) in enumerate(may):
            own = {(at, contexts[k][at - leads[k] : at - leads[k] + suffix_dedup.LENGTH]) for at in range(leads[k], leads[k] + len(contexts[k]) - suffix_dedup.LENGTH + 1) if not low <= at - leads[k] < high}
            other = {(at, c[at - low : at - low + suffix_dedup.LENGTH]) for j, (g, c, low) in enumerate(zip(group, contexts, leads)) if j != k and g == group[k] for at in range(low, low + len(c) - suffix_dedup.LENGTH + 1)}
            assert not own & other


def test_removals_odd(odd, empty):
    assert sorted(map(tuple, suffix_dedup.removals(odd).collect()), key=str) == brute_removals(odd.collect())
    assert suffix_dedup.removals(empty).count() == 0


# ---- pieces


def test_removals_of_lost_and_repeated_ids(spark):
    shared = prose(80, 40)
    rows = [(None, prose(30, 41) + shared), (None, shared + prose(30, 42)), (3, prose(9, 43) + shared), (3, prose(50, 44)), (3, prose(50, 44)), (None, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, suffix_dedup.removals(docs).collect()), key=str)
    assert got == brute_removals(docs.collect()) and sum(r[2] > 0 for r in got) == 5


def test_pieces_like_the_library(spark, odd, empty):
    import sentencepiece

    path = pieces.model_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(5)
    texts = ["".join(r.choice("ab \n▁é🙂漢\t\x00. ") for _ in range(r.randint(0, 60))) for _ in range(400)] + [x.text for x in odd.select("text").collect()]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for x in pieces.encode(frame, path).collect():
        text = texts[x.doc_id] or ""
        assert x.ids == library.encode(text) and x.decoded == library.decode(x.ids)
        assert len(x.ends) == len(x.ids) and x.ends == sorted(x.ends)
        raw, at = text.encode(), 0
        assert (x.ends[-1] if x.ends else 0) == len(raw)
        for i, end in zip(x.ids, x.ends):
            if not library.is_byte(i):
                assert raw[at:end].decode().replace(" ", "▁") == library.id_to_piece(i)[1 if at == 0 and not raw[at:end].startswith(b" ") and library.id_to_piece(i).startswith("▁") and not text.startswith("▁") else 0 :] or at == 0
            at = end
    assert pieces.encode(empty, path).count() == 0


@pytest.mark.parametrize("limit, value", [("WORDS", 3), ("KEPT", 40), ("LONGEST", 4)])
def test_bounded_memory_of_words(monkeypatch, limit, value):
    monkeypatch.setattr(pieces, limit, value)
    own = pieces.Codec(pieces.model_path())
    for k in range(5):
        texts = [prose(20, k), prose(5, k + 9), "x" * 9_000 + " y"]
        ids, _, bounds, _ = own.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip([0, *bounds], bounds)] == [own.library.encode(t) for t in texts]


def test_normaliser_follows_a_character_map():
    import sentencepiece

    library = sentencepiece.SentencePieceNormalizer(rule_name="nfkc")
    spec = next(v for k, v in pieces._fields(library.serialized_model_proto()) if k == 3)
    own = pieces.Normaliser(spec)
    for text in ["plain", "ﬁne ｆｕｌｌ①", "é Å", "㍿ end", "", "  two  spaces "]:
        out, source = own(text.encode())
        assert out.decode() == library.normalize(text)
        assert len(source) == len(out) + 1 and (np.diff(source) >= 0).all()
        starts = [i for i in range(len(out)) if out[i] & 0xC0 != 0x80] + [len(out)]
        assert [len(text.encode()[: source[i]].decode()) for i in starts] == library.normalize(text, with_offsets=True)[1]


# ---- toxicity


def test_toxicity_learns(spark):
    r = random.Random(6)
    rows, known = [], []
    for i in range(400):
        bad = i % 8 == 0
        words = prose(40, i).split()
        if bad:
            words[r.randrange(40)] = "nastyword"
        rows.append((i, " ".join(words)))
        known.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.train(docs, labels(spark, known[:300]))
    got = {x.doc_id: x.is_toxic for x in toxicity.judge(docs, chain).collect()}
    assert sum(got[i] == (i % 8 == 0) for i in range(300, 400)) >= 98


def test_toxicity_on_the_tables(spark):
    got = toxicity.op10_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (got.is_toxic == (got.toxic == 1)).mean() > 0.9


def test_toxicity_odd(spark, odd, empty):
    known = labels(spark, [(0, 1, 1), (6, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, 1), (99, 1, 1)])
    for chain in (toxicity.train(odd, known), toxicity.train(odd, labels(spark)), toxicity.train(empty, known)):
        got = toxicity.judge(odd, chain)
        assert got.count() == odd.count() and toxicity.judge(empty, chain).count() == 0
    assert {x.is_toxic for x in got.collect()} == {False}
    assert toxicity.reject_toxic(odd, labels(spark)).columns == odd.columns


def plain_features(text):
    """Hashes of the features of a text, straight from the definition."""
    import re

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
        return x ^ (x >> 31)

    out = set()
    for word in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode()):
        h = 0xCBF29CE484222325
        for k, b in enumerate(word[:12], 1):
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
            if k == len(word):
                out.add(mix((h + 1) % (1 << 64)))
            if 4 <= k <= 8:
                out.add(mix((h + 2) % (1 << 64)))
    return out


def plain_chain(chain, text):
    """Probabilities of a text by a chain, number by number."""
    import math
    import re

    raw = (text or "").lower().encode()
    words, n = re.findall(rb"[0-9a-z\x80-\xff]+", raw), max(len(raw), 1)
    digits = sum(48 <= b < 58 for b in raw)
    marks = sum(32 < b < 128 and not 48 <= b < 58 and not 97 <= b < 123 for b in raw)
    dense = [math.log1p(len(words)) / 10, digits / n, marks / n, min(n / max(len(words), 1), 40) / 40]
    own = plain_features(text)
    at = [k for k, h in enumerate(chain.chosen.tolist()) if h in own]
    out = []
    for w in chain.weights:
        x = sum(w[k] for k in at) + sum(a * b for a, b in zip(dense, w[len(chain.chosen) :])) + w[-1]
        out.append(1 / (1 + math.exp(-max(-30, min(30, x)))))
        p = min(1 - 1e-3, max(1e-3, out[-1]))
        dense.append(math.log(p / (1 - p)))
    return out


def toxic_rows(n=600):
    r = random.Random(6)
    rows, known = [], []
    for i in range(n):
        words, bad, junk = prose(40, i).split(), i % 8 == 0, i % 5 == 0
        if bad:
            words[r.randrange(40)] = "nastyword"
        if junk:
            words[r.randrange(40)] = "12345 !!!! buynow"
        rows.append((i, " ".join(words)))
        known.append((i, int(not junk), int(bad)))
    return rows, known


def test_toxicity_against_plain_python(spark):
    """Counts, selection and prediction against plain Python."""
    rows, known = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labelled = labels(spark, known)
    sample = toxicity._sample(docs, labelled, "doc_id", "text", 10_000).cache()
    of = {r["text"]: r for r in sample.collect()}
    counted = {r["hash"] % (1 << 64): r for r in toxicity._counted(sample).collect()}
    df, pos = Counter(), Counter()
    for r in of.values():
        for h in plain_features(r["text"]):
            df[h, r["fold"]] += 1
            pos[h, r["fold"]] += r["toxic"]
    every = Counter()
    for (h, _), n in df.items():
        every[h] += n
    assert set(counted) == {h for h, n in every.items() if n >= toxicity.MIN_TEXTS}
    assert all(counted[h][f"n_{f}"] == df[h, f] and counted[h][f"toxic_{f}"] == pos[h, f] for h in counted for f in range(toxicity.FOLDS))
    totals = [{"n": sum(r["fold"] == f for r in of.values()), **{c: sum(r[c] for r in of.values() if r["fold"] == f) for c in toxicity.CATEGORIES}} for f in range(toxicity.FOLDS)]
    selected = toxicity._selected(toxicity._counted(sample), totals)
    for f in (-1, 2):
        folds = [g for g in range(toxicity.FOLDS) if g != f]
        n, y = sum(totals[g]["n"] for g in folds), sum(totals[g]["toxic"] for g in folds)
        told = []
        for h in counted:
            d, p = sum(df[h, g] for g in folds), sum(pos[h, g] for g in folds)
            if d >= toxicity.MIN_TEXTS and abs(p - d * y / n) / (d * y / n * (1 - y / n)) ** 0.5 > 3:
                told.append(h)
        assert len(told) < toxicity.SELECTED and selected["toxic", f].tolist() == sorted(told)
    chain = toxicity.train(docs, labelled)
    texts = [t for _, t in rows[:60]] + [None, "", "nastyword", "12345 !!!! buynow nastyword é"]
    assert np.allclose(chain.predict(texts), [plain_chain(chain, t) for t in texts])
    got = {x.doc_id: x.is_toxic for x in toxicity.judge(docs, chain).collect()}
    assert sum(got[i] == bool(t) for i, _, t in known) >= 595


def test_toxicity_threshold():
    p, y = np.array([0.1, 0.2, 0.3, 0.7, 0.8]), np.array([0, 0, 0, 1, 1])
    assert toxicity.best_threshold(p, y) == pytest.approx(0.5)
    assert toxicity.best_threshold(p / 100, y) == 0.1 and toxicity.best_threshold(p, y * 0) == 0.5
    cost = lambda t, p, y: (p[y == 1] < t).mean() + toxicity.CLEAN * (p[y == 0] >= t).mean()
    r = np.random.default_rng(5)
    for _ in range(50):
        y = (r.random(80) < 0.2).astype(int)
        p = np.round(np.clip(0.3 + 0.3 * y + 0.2 * r.normal(size=80), 0.11, 0.89), 2)
        t = toxicity.best_threshold(p, y)
        assert cost(t, p, y) == pytest.approx(min(cost(x, p, y) for x in np.arange(0.105, 0.9, 0.01)))


def test_toxicity_of_hot_ids_and_folds(spark):
    """One id for many rows teaches once; equal texts are in one fold."""
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(k, f"same {k % 3}") for k in range(2, 40)], "doc_id long, text string")
    rows = toxicity._sample(docs, labels(spark, [(k, 1, k % 2) for k in range(40)]), "doc_id", "text", 100).collect()
    assert len(rows) == 39
    folds = defaultdict(set)
    for r in rows:
        folds[r["text"]].add(r["fold"])
    assert all(len(f) == 1 for f in folds.values())


# ---- pipeline


def words_of(text):
    return (text or "").split()


def brute_mix(rows):
    """Rows (doc_id, source, text) as often as the mix takes them."""
    sizes = Counter()
    for _, s, text in rows:
        sizes[s] += len(words_of(text))
    target, want = brute_targets(sizes), Counter()
    for s in sizes:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (sha_order(r[0]), r[0] is not None, r[0] or 0, len(words_of(r[2]))))
        quota, at = int(target[s]), 0
        for i, _, text in own:
            n = len(words_of(text))
            if n:
                taken = n * (quota // sizes[s]) + max(0, min(n, quota % sizes[s] - at))
                want[i, s, text] += (2 * taken + n) // (2 * n)
            at += n
    return +want


def check_stages(spark, docs, sf):
    """Each stage against brute force on what the stage before has kept."""
    import re

    import sentencepiece

    import corpus_pipeline

    chains, train = [], toxicity.train
    toxicity.train = lambda *a: chains.append(train(*a)) or chains[-1]
    try:
        for name, stage in corpus_pipeline.STAGES:
            rows, after = docs.collect(), stage(spark, docs, sf)
            got = after.collect()
            if name.startswith("toxicity"):
                chain = chains[0]
                is_toxic = {t: bool(chain.weights) and plain_chain(chain, t)[-1] >= chain.threshold for t in {r.text for r in rows}}
                assert Counter(map(str, got)) == Counter(str(r) for r in rows if not is_toxic[r.text])
            elif name.startswith("exact"):
                normal = [(r.doc_id, " ".join(("|" + (r.text or "") + "|").replace("\x1c", "?").split(" "))) for r in rows]
                import re

                normal = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in rows]
                least = {t: min((i for i, x in normal if x == t and i is not None), default=None) for _, t in normal}
                assert Counter((r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in got) == Counter((i, t) for t, i in least.items())
            elif name.startswith("n-gram"):
                check_kept(docs, after)
            elif name.startswith("mixing"):
                assert Counter((r.doc_id, r.source, r.text) for r in got) == brute_mix([(r.doc_id, r.source, r.text) for r in rows])
            else:
                library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
                digest = lambda x: sha256(x.encode()).hexdigest()
                ids = [(r, library.encode(r.text or "")) for r in rows]
                assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == Counter((r.doc_id, len(x), digest(",".join(map(str, x))), digest(library.decode(x))) for r, x in ids)
                continue
            assert after.columns == docs.columns
            docs = spark.createDataFrame(got, after.schema).repartition(3)
    finally:
        toxicity.train = train


def test_pipeline_stages(spark):
    check_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)


def test_pipeline_stages_of_odd_rows(spark, odd, empty, tmp_path):
    words = [(i, f"{'awful' if i % 4 == 0 else 'fine'} " + prose(30, 900 + i), "en", "s1", None, "k", "s", "n") for i in range(100, 180)]
    docs = odd.unionByName(odd_ids(spark).selectExpr("doc_id", "text", "lang", "source", "cast(n_chars as long) n_chars", "'a' kept", "'b' size", "'c' node")).unionByName(spark.createDataFrame(words, DOCS))
    labels(spark, [(i, 1, int(i % 4 == 0)) for i in range(100, 180)] + [(None, 1, 1), (6, None, 1)]).write.parquet(f"{tmp_path}/labels.parquet")
    check_stages(spark, docs.repartition(4), str(tmp_path))
    check_stages(spark, empty, str(tmp_path))


def test_pipeline_runs(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_hash"} <= set(got.columns)


def odd_ids(spark):
    """Ids that are null, repeated with one text, and repeated with several; ids 1, 2 and 3 share their texts crosswise."""
    a, b, c, d = (prose(30, 300 + k) for k in range(4))
    texts = [(1, a), (1, b), (2, a), (3, b.replace(" ", "  ")), (4, c), (4, c), (4, c + " more"), (None, d), (None, d), (None, a), (None, "lost " + d), (5, "lost too " + d), (5, None)]
    rows = [(i, t, "en", s, n) for n, (i, t) in enumerate(texts) for s in [None if n % 3 == 0 else f"s{n % 3}"]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)


def test_pipeline_removes_copies_of_odd_ids(spark, odd):
    import corpus_pipeline

    for docs in (odd_ids(spark), odd):
        rows = [(r.doc_id, " ".join(("|" + (r.text or "") + "|").split())) for r in docs.collect()]
        least = {t: min((i for i, x in rows if x == t and i is not None), default=None) for _, t in rows}
        got = [(r.doc_id, " ".join(("|" + (r.text or "") + "|").split())) for r in corpus_pipeline.remove_copies(spark, docs, SF).collect()]
        assert Counter(got) == Counter((i, t) for t, i in least.items())


def test_pipeline_mixes_odd_ids(spark):
    import corpus_pipeline

    docs = odd_ids(spark)
    got = Counter((r.doc_id, r.source, r.text) for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())
    assert got == brute_mix([(r.doc_id, r.source, r.text) for r in docs.collect()]) and any(i is None for i, _, _ in got)


def sha_order(doc_id):
    from hashlib import md5

    return md5(f"{'' if doc_id is None else doc_id}|mix".encode()).hexdigest()


def test_mix_takes_each_repeated_row(spark):
    docs = spark.createDataFrame([(1, prose(9, 400), "a", n) for n in range(3)] + [(None, prose(8, 401), "b", 0)], "doc_id long, text string, source string, n int")
    taken = sorted(((2 * r.taken + r.size) // (2 * r.size) for r in mixing.mix(docs).collect() if r.doc_id == 1), reverse=True)
    got = Counter(r.n for r in mixing.repeat_documents(docs).collect() if r.doc_id == 1)
    assert [got[n] for n in range(3)] == taken


def test_suffix_array_of_alike_texts():
    """Texts that occur twice or oftener with few changes, as groups of contexts do."""
    r = random.Random(21)
    for _ in range(300):
        base = bytes(r.choices(b"abc \xc3", k=r.randint(0, 40)))
        parts = [bytearray(base) for _ in range(r.randint(1, 4))]
        for part in parts:
            for _ in range(r.randint(0, 2) if part else 0):
                part[r.randrange(len(part))] = r.choice(b"abc ")
        text = b"\xff".join(map(bytes, parts))
        assert suffix_sort.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
