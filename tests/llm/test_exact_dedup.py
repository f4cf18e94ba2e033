"""Exact deduplication against a dictionary of whole texts."""

import hashlib
import re

from pyspark.sql import functions as F

from weft.llm import exact_dedup


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def brute(rows):
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault(normal(text), []).append(doc)
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda x: (x is None, x or 0))
        for k, doc in enumerate(ids):
            out.append((doc, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, docs, tmp_path, parts=3):
    path = str(tmp_path / "docs")
    docs.repartition(parts).write.mode("append").parquet(path)
    return path


def test_equal_texts(spark, docs, rows, tmp_path):
    path = table(spark, docs, tmp_path)
    assert sorted(map(tuple, exact_dedup.decisions(spark, path).collect()), key=str) == brute(rows)


def test_digests_that_collide_are_told_apart_by_bytes(spark, docs, rows, tmp_path):
    path = table(spark, docs, tmp_path)
    got = exact_dedup.decisions(spark, path, digest=lambda sha: F.substring(F.hex(sha), 1, 1))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_state_goes_on_over_batches_and_restarts(spark, docs, rows, tmp_path):
    half = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
    root = str(tmp_path / "state")
    path = table(spark, docs.where(half), tmp_path)
    first = exact_dedup.decisions(spark, path, root, maxFilesPerTrigger="1").collect()
    spark.createDataFrame([(-5, rows[0][1], "en", "a")], "doc_id long, text string, lang string, source string").write.mode(
        "append").parquet(path)
    table(spark, docs.where(~half), tmp_path, parts=2)
    got = exact_dedup.decisions(spark, path, root, maxFilesPerTrigger="1")
    assert 0 < len(first) < len(rows)
    assert sorted(map(tuple, got.collect()), key=str) == brute([*rows, (-5, rows[0][1])])


def test_table_without_copies_keeps_all_columns(spark, docs, rows, tmp_path):
    path = table(spark, docs, tmp_path)
    got = exact_dedup.dedup(spark, path)
    assert got.columns == docs.columns
    assert sorted(normal(r.text) for r in got.collect()) == sorted({normal(t) for _, t, *_ in rows})


def test_empty_table(spark, empty, tmp_path):
    path = table(spark, empty, tmp_path)
    assert exact_dedup.decisions(spark, path).collect() == []
    assert exact_dedup.dedup(spark, path).collect() == []


def test_no_python_in_the_plan(spark, docs, tmp_path):
    plan = exact_dedup.decisions(spark, table(spark, docs, tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
