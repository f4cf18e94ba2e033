"""Language identification, language-model scoring, quality rules, decontamination."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import decontam, langid, lm_score, quality
from weft.llm import text as T
from weft.llm import text as T
from weft.sources.files import read_table
from tests.conftest import SF_SMALL

WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- array helpers

@pytest.mark.parametrize("texts", [[], [None], ["", "a"], ["a b", "", " c\n", "é  ü", None, "x"]])
def test_words_match_the_pattern(texts):
    data, offsets = T.utf8(pa.array(texts, pa.string()))
    words = T.Words(data, offsets)
    got = [[data[s:e].tobytes().decode() for s, e in zip(words.start[a:b], words.end[a:b])]
           for a, b in zip(words.first[:-1], words.first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    h = words.hashes()
    flat = [w for t in got for w in t]
    assert len(set(h.tolist())) == len(set(flat))


def test_hash_index_finds_exactly_its_hashes():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    h = np.concatenate([h, (h[:50] & ~np.uint64(0xFFFF)) | np.uint64(7)])  # crowd some slots
    index = T.HashIndex(h)
    assert (index.find(h) == np.arange(len(h))).all()
    other = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    assert (index.find(other[~np.isin(other, h)]) == -1).all()


# ---- language identification

def test_hashes_have_no_roots_in_texts():
    """The Thue-Morse word and its complement, of any length, differ under the hash; equal ranges agree."""
    word = b"a"
    for _ in range(12):
        word += bytes(97 + 98 - c for c in word)
        other = bytes(97 + 98 - c for c in word)
        data = np.frombuffer(word + other + word, np.uint8)
        n = len(word)
        got = T.span_hashes(data, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
        assert got[0] == got[2] != got[1]
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    start = rng.integers(0, 3990, 2000)
    end = np.minimum(start + rng.integers(0, 30, 2000), 4000)
    seen = {}
    for a, z, h in zip(start.tolist(), end.tolist(), T.span_hashes(data, start, end).tolist()):
        assert seen.setdefault(h, data[a:z].tobytes()) == data[a:z].tobytes()
    assert len(seen) == len({data[a:z].tobytes() for a, z in zip(start, end)})


def test_language_accuracy_on_held_out(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    got = langid.op2(spark, SF_SMALL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_mixtures_and_edge_cases(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    model = langid.train(docs)
    by = {r.lang: r.t for r in docs.where("n_chars > 600").groupBy("lang").agg(F.first("text").alias("t")).collect()}
    en, de = by["en"][:500], by["de"][:500]
    rows = [(1, en + " " + de + " " + de, False), (2, en, True), (3, None, False), (4, "", False), (5, "12 3.4 !?", True),
            (6, "… × ÷ ¿", False), (None, de, None), (2, en, True)]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), model).collect()
    assert [r.lang_pred for r in got] == ["de", "en", "und", "und", "und", "und", "de", "en"]
    assert set(got[0].languages) >= {"de", "en"} and got[1].languages == ["en"]
    assert [r.score for r in got[2:6]] == [0] * 4


def test_language_empty_tables(empty, docs):
    names, logp = langid.train(empty)
    assert names == []
    rows = docs.select("doc_id", "text", F.lit(False).alias("held_out"))
    assert {r.lang_pred for r in langid.predict(rows, (names, logp)).collect()} == {"und"}
    assert langid.predict(rows.where("false"), langid.train(docs)).collect() == []


# ---- language model

def brute_base(rows):
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    count = Counter()
    for t in train:
        count.update([*WORD.findall(lower(t)), None])
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        tokens = [*WORD.findall(lower(t)), None]
        out.append((i, len(tokens), sum(count[w] > 0 for w in tokens), n,
                    sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)))
    return out


@pytest.mark.parametrize("max_top", [1 << 17, 40])
def test_base_score_is_exact(docs, rows, monkeypatch, max_top):
    """Also when almost all words are counted by the join."""
    monkeypatch.setattr(lm_score, "MAX_TOP", max_top)
    monkeypatch.setattr(lm_score.start_model, "__defaults__", (max_top,))
    df = docs.withColumn("held_out", langid.fold(F.col("doc_id"), 5) == 1)
    got = lm_score.score(df, df.where("not held_out")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got, want = sorted(got, key=key), sorted(brute_base([r[:2] for r in rows]), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g.doc_id, g.n_tokens, g.n_known, g.train_tokens) == w[:4]
        assert g.base_score == pytest.approx(w[4], abs=1e-6)
        assert math.isfinite(g.score)


def test_model_probabilities_sum_to_one():
    """Over all words in the vocabulary and the unknown word, after any history."""
    rng = np.random.default_rng(0)
    counts = np.sort(rng.integers(1, 50, 300))[::-1].astype(float)
    h = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
    n, rare = int(counts.sum()) + 40, 40  # 40 more types, seen once, outside the frequent words
    model = lm_score.Model(h, counts, n, 300 + rare)
    model.weights = rng.normal(0, 1, model.weights.shape).astype(np.float32)
    rows = [np.full(lm_score.CLASSES, k) for k in (5, 77, 900)]
    gain = model.gains(rows, np.arange(lm_score.CLASSES))
    within = np.bincount(model.word_class, model.counts + 0.5, lm_score.CLASSES) / model.mass
    within[-1] = (rare * 1.5 + 0.5) / model.mass
    assert (within * 10 ** gain).sum() == pytest.approx(1, abs=1e-4)


def test_training_helps_on_held_out_text(spark):
    got = lm_score.op3(spark, "/root/testdata/sf0.01")
    r = got.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_language_model_empty_tables(empty, docs):
    df = docs.withColumn("held_out", F.lit(True))
    assert lm_score.score(df.where("false"), df).collect() == []
    for r in lm_score.score(df, empty).collect():  # nothing learned: every token is unknown
        assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and r.score == pytest.approx(0, abs=1e-3)


# ---- quality rules

def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            inside.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(inside))


def test_quality_statistics(docs, rows):
    got = quality.score_quality(docs)
    assert got.columns[0] == "doc_id"
    want = Counter()
    for i, t, *_ in rows:
        b = brute_quality(t)
        want[(i, *b, b[0] < 20 or 100 * b[4] > 30 * b[0])] += 1
    assert Counter(tuple(r)[:7] for r in got.collect()) == want
    assert not any(r.kept and r.base_failed for r in got.collect())


def test_cascade_keeps_what_every_rule_passes(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    texts = [r.text for r in docs.select("text").collect()]
    column = pa.array(texts)
    reject = np.any([r.rejects(quality.Texts(column)) for r in quality.RULES], axis=0)
    for order in (quality.RULES, quality.RULES[::-1], quality.ordered_rules(docs)):
        assert (quality.cascade(column, order) == np.flatnonzero(~reject)).all()
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and kept.count() == (~reject).sum()


def test_rules_are_ordered_by_rejections_per_cost(spark, monkeypatch):
    measured = [("few_words", 100, 5, 0.1), ("symbols", 100, 50, 0.1), ("dup_lines", 100, 50, 0.01)]
    monkeypatch.setattr(quality, "measure", lambda *a: measured)
    assert [r.name for r in quality.ordered_rules(None)][:3] == ["dup_lines", "symbols", "few_words"]


def test_clean_documents_are_kept(spark):
    labels = read_table(spark, "/root/testdata/sf0.01", "labels").where("quality = 1")
    clean = quality.op5(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("not base_failed")
    assert clean.where("not kept").count() <= 0.01 * clean.count()


def test_quality_empty_table(empty):
    assert quality.score_quality(empty).collect() == []
    assert quality.filter_quality(empty).collect() == []


# ---- decontamination

def leaky(spark):
    rng = random.Random(11)
    V = [f"t{k}" for k in range(900)]
    pick = lambda n: " ".join(rng.choice(V) for _ in range(n))
    items = [(k, f"{pick(rng.randrange(8, 30))}. {pick(rng.randrange(1, 12))}.") for k in range(60)] + [(60, None), (61, "")]
    rows, want = [], set()
    for d in range(300):
        text = pick(rng.randrange(5, 400))
        if d % 6 == 0:
            k = rng.randrange(60)
            text = f"{text} {items[k][1]} {pick(rng.randrange(0, 90))}"
            want.add((d, k))
        rows.append((d, text))
    rows += [(300, None), (301, ""), (None, items[3][1]), (302, items[4][1]), (302, items[4][1])]
    want |= {(None, 3), (302, 4)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_gone", F.lit(1)).withColumn("item_id", F.lit(2))
    return docs, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0)), want, items, rows


def test_contaminated_documents(spark, monkeypatch):
    docs, items, want, *_ = leaky(spark)
    got = decontam.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    left = decontam.decontaminate(docs, items)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.select("doc_id").collect())
    bad = {d for d, _ in want if d is not None}
    assert ids == Counter(r.doc_id for r in docs.select("doc_id").collect() if r.doc_id not in bad)
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 25)  # the same, index block by index block
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()} >= want


def test_item_blocks_do_not_change_verdicts(spark, monkeypatch):
    """Any number of index blocks gives the same matches with the same scores."""
    docs, items, want, *_ = leaky(spark)
    whole = {tuple(r) for r in decontam.contaminated(docs, items).collect()}
    assert {r[:2] for r in whole} == want
    for block in (25, 7):
        monkeypatch.setattr(decontam, "ITEM_BLOCK", block)
        got = sorted(map(tuple, decontam.contaminated(docs, items).collect()), key=str)
        assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in sorted(whole, key=str)]
        assert [r[2] for r in got] == pytest.approx([r[2] for r in sorted(whole, key=str)])


def test_a_long_item_does_not_widen_passages(spark):
    """Common word pairs scattered over a long clean text do not make a short item's match."""
    rng = random.Random(2)
    own = lambda k: [f"u{rng.randrange(10**9)}" for _ in range(k)]
    question, answer = own(8), own(5)
    item = " ".join(question) + ". " + " ".join(answer) + "."
    words = item.split()
    clean = [w for k in range(len(words) - 1) for w in own(60) + words[k:k + 2]]
    items = [(1, item), (2, " ".join(own(1500)) + ". " + " ".join(own(500)) + ".")] + [(k, " ".join(own(12))) for k in range(3, 30)]
    rows = [(1, " ".join(clean)), (2, " ".join(own(300) + words + own(50))), (3, " ".join(own(40)) + " " + items[1][1])]
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"),
                                spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(2, 1), (3, 2)}


def test_rows_with_null_and_repeated_ids_are_judged_by_their_text(spark):
    item = " ".join(f"q{k}" for k in range(30)) + ". " + " ".join(f"a{k}" for k in range(12))
    clean = " ".join(f"c{k}" for k in range(60))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(None, f"so {item} end"), (None, clean), (4, item), (4, clean), (5, None)],
                                 "doc_id long, text string")
    left = decontam.decontaminate(docs, items).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in left) == [(-1, clean), (4, clean), (5, "")]


def test_item_without_id(spark):
    """An item with a null id is searched like any other."""
    docs, items, want, held, _ = leaky(spark)
    items = items.select(F.when(F.col("item_id") != 4, F.col("item_id")).alias("item_id"), "text")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(d, None if k == 4 else k) for d, k in want}
    assert 302 not in {r.doc_id for r in decontam.decontaminate(docs, items).select("doc_id").collect()}


def test_retrieval_equals_scoring_everything(spark):
    """Block-max pruning loses no passage and item whose BM25 score reaches the threshold."""
    _, _, _, items, rows = leaky(spark)
    index = decontam.Index(items)
    held = [(i, t) for i, t in items if t]
    terms = [Counter(decontam._hashes(t).tolist()) for _, t in held]
    df, mean = Counter(w for c in terms for w in c), sum(sum(c.values()) for c in terms) / len(terms)

    def impact(c, w):
        idf = math.log1p((len(held) - df[w] + 0.5) / (df[w] + 0.5))
        norm = decontam.K1 * (1 - decontam.B + decontam.B * sum(c.values()) / mean)
        return idf * c[w] * (decontam.K1 + 1) / (c[w] + norm)

    want = {}
    texts = [t for _, t in rows]
    for d, text in enumerate(texts):
        h = decontam._hashes(text or "").tolist()
        starts = range(0, max(1, -(-(len(h) - 2 * index.longest) // index.longest) + 1) * index.longest, index.longest)
        for s in starts if h else ():
            here = set(h[s:s + 2 * index.longest])
            for k, c in enumerate(terms):
                score = sum(impact(c, w) for w in c if w in here) / sum(impact(c, w) for w in c)
                if score >= decontam.THRESHOLD:
                    want[(d, s, k)] = score
    data, offsets = T.utf8(pa.array(texts))
    words = T.Words(T.LOWER[data], offsets)
    got = {(d, s, k): v for d, s, k, v in zip(*(x.tolist() for x in decontam.retrieve(index, words.hashes(), words.first)))}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_decontamination_empty_tables(spark):
    docs, items, *_ = leaky(spark)
    assert decontam.contaminated(docs.where("false"), items).collect() == []
    assert decontam.contaminated(docs, items.where("false")).collect() == []
    assert decontam.decontaminate(docs, items.where("false")).count() == docs.count()
