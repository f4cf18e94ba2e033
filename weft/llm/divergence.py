"""Source divergence audit: how the sources of a language differ in their terms, in exact integers.

1. Counts. Terms (runs of ASCII letters and non-ASCII characters, A-Z lower-cased) are counted per
   slice of texts and dealt out by term. Each language keeps the terms found in ``min_docs`` of its
   documents or more.
2. Shares. A group's share of a term is ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))``; a term of two
   groups costs ``floor((p - q)^2 / (p + q))``.
3. Joint tables. The kept terms of a language are cut into blocks of ``TERMS`` terms, its sources into
   blocks of ``SOURCES``. A block's one-hot matrix has an indicator column per (source, count level) and
   a row per term. Its transpose times itself holds, for every two sources, how many terms have
   which two levels. The products are taken column block by column block in float32; entries are
   at most ``TERMS``, so they are exact. Each joint table is priced once per pair of levels, and
   Spark sums the prices over the term blocks. Terms that neither block of sources holds are one joint
   entry, priced at the end.
4. The terms in which a source exceeds its language most come from the same shares.

A task sees the counts of ``TERMS`` terms in two blocks of sources, whatever the size of the corpus. The
pairs of sources are the result itself; terms are never paired.

Defined results: null text, language and source count as ''; repeated rows and rows with equal or null
ids are separate documents; a group without kept terms has N = 0, a language without any V = 0 and its
pairs the value 0; equal values are ranked by the item's bytes; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm import spans
from weft.llm import text as T
from weft.llm.registry import query
from weft.session import cut_lineage, spread_rows
from weft.sources.files import read_table

MIN_DOCS = 10
TOP = 10
SCALE = 10**9
TERMS = 2048     # terms of a block
SOURCES = 64     # sources of a block
COLUMNS = 2048   # one-hot columns of a product
LETTERS = spans.byte_set([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def _names(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) of slices of texts; the same term may have several rows."""
    def run(batches):
        for batch in T.slices(batches, max_bytes=1 << 22, max_rows=1 << 13):
            data, offsets = T.utf8(batch.column(2))
            lang, langs = spans.codes(batch.column(0))
            source, sources = spans.codes(batch.column(1))
            pairs, group = np.unique(lang * len(sources) + source, return_inverse=True)
            start, end, doc = spans.runs(data, offsets, LETTERS)
            term, names = spans.numbered(spans.strings(T.LOWER[data], start, end))
            key, times = np.unique((term * len(pairs) + group[doc]) * batch.num_rows + doc, return_counts=True)
            if not len(key):
                continue
            key //= batch.num_rows
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            term, group = np.divmod(key[head], len(pairs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()).take(pa.array(pairs[group] // len(sources))),
                 pa.array(sources, pa.string()).take(pa.array(pairs[group] % len(sources))),
                 names.take(pa.array(term)).cast(pa.string()), pa.array(np.add.reduceat(times, head)),
                 pa.array(np.diff(np.append(head, len(key))))], ["lang", "source", "term", "count", "docs"])

    return spread_rows(docs.select(*_names(docs), F.col("text").cast("string").alias("text"))).mapInArrow(
        run, "lang string, source string, term string, count long, docs long")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, lang, term, total, by): the kept terms with their counts by source. Written, since ``id`` must not change."""
    rows = term_counts(docs).repartition("lang", "term")  # counted by slice already; both groupings stay in place
    rows = rows.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    rows = rows.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"),
                                            F.collect_list(F.struct("source", "count")).alias("by"))
    return cut_lineage(rows.where(F.col("docs") >= min_docs).select(
        F.monotonically_increasing_id().alias("id"), "lang", "term", "total", "by"))


def source_groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n, v, all_n, sid): each group's N, its language's V and N, and its number in the language."""
    sizes = kept.select("lang", F.explode("by").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(
        F.sum("e.count").alias("n"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all_n"))
    order = Window.partitionBy("lang").orderBy("source")
    return cut_lineage(
        docs.select(*_names(docs)).distinct().join(sizes, ["lang", "source"], "left").join(terms, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "all_n")],
                (F.row_number().over(order) - 1).alias("sid")))


def _share(count: str, n: str) -> Column:
    """``1 + floor(SCALE * (count + 2) / (n + 2 v))`` in three decimal places at a time, so that 64 bits hold
    every product up to 9 * 10^15 words."""
    whole = f"nullif({n} + 2L * v, 0)"
    total, rest = f"(({count} + 2L) div {whole}) * {SCALE}L", f"(({count} + 2L) % {whole})"
    for unit in (10**6, 10**3, 1):
        total += f" + ({rest} * 1000L div {whole}) * {unit}L"
        rest = f"({rest} * 1000L % {whole})"
    return F.expr(f"1L + {total}")


def _cost(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _joint_prices(terms: np.ndarray, sid: np.ndarray, count: np.ndarray, share) -> tuple:
    """Sources, the matrix of the summed prices of every two of them over the terms of one block, and the number
    of those terms. Rows of a negative term only name a source."""
    sources, col = np.unique(sid, return_inverse=True)
    real = terms >= 0
    if not real.any():
        return sources, np.zeros((len(sources), len(sources)), np.int64), 0
    names, row = np.unique(terms[real], return_inverse=True)
    counts = np.zeros((len(names), len(sources)), np.int64)
    counts[row, col[real]] = count[real]
    level, price, first = np.empty_like(counts), [], [0]
    for j in range(len(sources)):  # the count levels of a source are its columns of the one-hot matrix
        values, level[:, j] = np.unique(counts[:, j], return_inverse=True)
        level[:, j] += first[-1]
        price.append(share(sources[j], values))
        first.append(first[-1] + len(values))
    price, first = np.concatenate(price), np.array(first)
    cuts = [0]
    for j in range(len(sources)):
        if first[j + 1] - first[cuts[-1]] > COLUMNS and j > cuts[-1]:
            cuts.append(j)
    cuts.append(len(sources))
    total = np.zeros((len(sources), len(sources)), np.int64)
    blocks = [(a, b, _one_hot(level[:, a:b] - first[a], first[b] - first[a])) for a, b in zip(cuts[:-1], cuts[1:])]
    for a, b, x in blocks:
        for c, d, y in blocks:
            if c < a:
                continue
            joint = (x.T @ y).astype(np.int64)
            p, q = price[first[a]:first[b], None], price[None, first[c]:first[d]]
            joint *= (p - q) ** 2 // (p + q)
            part = np.add.reduceat(np.add.reduceat(joint, first[a:b] - first[a], 0), first[c:d] - first[c], 1)
            total[a:b, c:d] = part
            total[c:d, a:b] = part.T
    return sources, total, len(names)


def _one_hot(level: np.ndarray, columns: int) -> np.ndarray:
    out = np.zeros((len(level), columns), np.float32)
    out[np.repeat(np.arange(len(level)), level.shape[1]), level.ravel()] = 1
    return out


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, sid, other, value): the cost of every two sources of a language, both ways."""
    groups = groups.withColumn("blocks", F.greatest(F.ceil(F.col("v") / TERMS), F.lit(1)).cast("long"))
    groups = groups.withColumn("mine", F.floor(F.col("sid") / SOURCES).cast("long")).withColumn(
        "last", F.floor((F.count("*").over(Window.partitionBy("lang")) - 1) / SOURCES).cast("long"))
    numbers = groups.select("lang", "source", "sid", "n", "v", "blocks", "mine", "last")
    counts = kept.select("id", "lang", F.explode("by").alias("e")).select(
        "id", "lang", F.col("e.source").alias("source"), F.col("e.count").alias("count"))
    entries = counts.join(numbers, ["lang", "source"]).withColumn("tb", F.pmod(F.xxhash64("id"), "blocks"))
    # Every block of terms knows all its sources, also those without a term in it.
    frame = numbers.withColumn("id", F.lit(-1).cast("long")).withColumn("count", F.lit(0).cast("long")).withColumn(
        "tb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ["lang", "tb", "mine", "last", "id", "sid", "count", "n", "v"]
    met = entries.select(*columns).unionByName(frame.select(*columns)).withColumn(
        "with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    met = met.select("lang", "tb", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"),
                     "id", "sid", "count", "n", "v")

    def price(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sid, n = table.column("sid").to_numpy(), table.column("n").to_numpy()
        size, v = dict(zip(sid.tolist(), n.tolist())), table.column("v")[0].as_py()

        def share(source, values):
            whole = size[int(source)] + 2 * v
            return np.array([1 + SCALE * (int(c) + 2) // whole for c in values] if whole else [1] * len(values), np.int64)

        sources, total, terms = _joint_prices(table.column("id").to_numpy(), sid,
                                              table.column("count").to_numpy(), share)
        block = sources // SOURCES
        a, b = np.nonzero((sources[:, None] != sources[None, :]) & ((block[:, None] != block[None, :]) | (i == j)))
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(a), pa.string()),
                         "sid": pa.array(sources[a]), "other": pa.array(sources[b]),
                         "value": pa.array(total[a, b]), "terms": pa.array(np.full(len(a), terms))})

    got = met.groupBy("lang", "tb", "i", "j").applyInArrow(
        price, "lang string, sid int, other int, value long, terms long")
    got = got.groupBy("lang", "sid", "other").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    mine = groups.select("lang", "sid", "source", "v", _share("0", "n").alias("p"))
    theirs = groups.select("lang", F.col("sid").alias("other"), F.col("source").alias("item"), _share("0", "n").alias("q"))
    rest = F.coalesce((F.col("v") - F.col("terms")) * _cost("p", "q"), F.lit(0))
    return got.join(mine, ["lang", "sid"]).join(theirs, ["lang", "other"]).select(
        "lang", "source", "item", (F.col("value") + rest).alias("value"))


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms a source has a larger share of than its language."""
    counts = kept.select("lang", F.col("term").alias("item"), "total", F.explode("by").alias("e")).select(
        "lang", "item", "total", F.col("e.source").alias("source"), F.col("e.count").alias("count"))
    return (counts.join(groups, ["lang", "source"])
            .withColumn("p", _share("count", "n")).withColumn("q", _share("total", "all_n"))
            .where("count > 0 and p > q").select("lang", "source", "item", _cost("p", "q").alias("value")))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source (part ``pair``) and the ``top`` terms (part ``term``)."""
    kept = kept_terms(docs, min_docs)
    groups = source_groups(docs, kept)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(kept, groups).withColumn("rank", rank).withColumn("part", F.lit("pair"))
    terms = term_values(kept, groups).withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY lang, term HAVING sum(docs) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(total) AS all_n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (
  SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0) AS n
  FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source LEFT JOIN k ON c.lang = k.lang AND c.term = k.term
  GROUP BY g.lang, g.source
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.n + 2 * v.v) AS HUGEINT) AS p,
    CAST(1 + ({SCALE}::HUGEINT * (k.total + 2)) // (v.all_n + 2 * v.v) AS HUGEINT) AS q
  FROM s JOIN k ON s.lang = k.lang JOIN v ON s.lang = v.lang
  LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), o AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(o.value, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN o ON o.lang = a.lang AND o.source = a.source AND o.item = b.source
), term AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
  FROM p WHERE n > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pair
UNION ALL
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM term
QUALIFY rank <= {TOP}
"""


@query("op12_source_divergence", ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))
