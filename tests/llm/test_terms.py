"""Source divergence and collocations against plain Python over whole tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import collocations, divergence, spans

from tests.llm.conftest import word

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_audit(rows, min_docs, top):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(lower(text))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        mine = sorted(s for g, s in groups if g == lang)
        whole = Counter()
        for s in mine:
            whole.update({t: counts[lang, s][t] for t in kept})

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q, p = share(whole), {s: share(counts[lang, s]) for s in mine}
        for s in mine:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept)) for o in mine if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])) for t in kept
                     if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def mixed(rows):
    """The corpus with more languages and sources, one of them of most rows."""
    rng = random.Random(3)
    more = [(10_000 + k, " ".join(f"Zw{word(int(rng.paretovariate(0.7)) % 60)}é{'.' * (rng.random() < 0.1)}" for _ in range(40)),
             rng.choice(["de", "de", None, "fr"]), rng.choice(["hot"] * 4 + ["a", "b", None, "ß"])) for k in range(300)]
    return [*rows, *more, (1, "--- 12", "xx", "lonely"), (2, None, "xx", "other")]


@pytest.mark.parametrize("terms, sources, columns", [(2048, 64, 2048), (64, 2, 30)])
def test_divergence(spark, mixed, terms, sources, columns, monkeypatch):
    for name, value in (("TERMS", terms), ("SOURCES", sources), ("COLUMNS", columns)):
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame(mixed, "doc_id long, text string, lang string, source string").repartition(4)
    got = divergence.audit(docs.selectExpr("*", "1 as term", "2 as count", "3 as id", "4 as sid"))
    assert sorted(map(tuple, got.collect())) == brute_audit(mixed, divergence.MIN_DOCS, divergence.TOP)


def test_divergence_of_an_empty_table(empty):
    assert divergence.audit(empty).collect() == []


def brute_collocations(rows, min_count, top, contained=100):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        longer = Counter()
        for p, a in some.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i:i + k]] = max(longer[p[i:i + k]], a)
        best = []
        for p, a in some.items():
            if 100 * longer[p] >= contained * a:
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("range_bytes, shard, lot", [(1 << 23, 1 << 23, 1 << 16), (30_000, 20_000, 200)])
def test_collocations(spark, mixed, range_bytes, shard, lot, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "LOT", lot)
    docs = spark.createDataFrame(mixed, "doc_id long, text string, lang string, source string").repartition(4)
    docs = docs.selectExpr("*", "1 as phrase", "2 as n", "3 as range", "4 as words")
    got = collocations.collocations(docs, min_count=5, top=300, range_bytes=range_bytes).collect()
    want = brute_collocations(mixed, 5, 300)
    assert sorted(map(tuple, got)) == want
    assert len({r.lang for r in got}) > 2 and len(want) > 300


def test_collocations_of_an_empty_table(empty):
    assert collocations.collocations(empty).collect() == []


def test_automaton_accepts_its_rows_only():
    rng = random.Random(5)
    rows = np.array(sorted({tuple([rng.randrange(1, 6) for _ in range(k)] + [0] * (6 - k))
                            for k in (rng.randrange(1, 7) for _ in range(500))}), np.int64)
    weights = np.arange(1, len(rows) + 1)
    odd = np.arange(len(rows)) % 2 == 1
    got = collocations.Automaton(rows[odd], weights[odd]).compose(rows)
    assert (got == np.where(odd, weights, 0)).all()


def test_numbers_follow_the_bytes_of_the_terms():
    terms = ["b", "é", "a", "", "zz", "a", "ｚ", "𝒵"]
    number, names = spans.numbered(pa.array(terms, pa.large_string()))
    assert names.to_pylist() == sorted(set(terms), key=str.encode)
    assert [names[int(k)].as_py() for k in number] == terms
