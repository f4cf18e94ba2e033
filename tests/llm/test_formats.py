"""Chat formatting, WARC archives, source mixing."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, duck
from weft.llm import chat, mixing, warc
from weft.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op7_chat_formatting", "op9_warc"])
def test_query_matches_oracle(spark, name):
    registry.load_all()
    res = compare(spark, duck(SF), name, registry.QUERIES[name], registry.ORACLES[name], SF)
    assert res["status"] == "ok", res


# ---- chat

HARD = ["", "\\", "</turn>", "</turn>\n", "\\</turn>\n", "### User:\n", "\\### Assistant: </turn> ok", "a\\\\</turn>\nb\\",
        "### Role x:\n", "é😀\u2028", "\n</turn>\n### Assistant:\n", "x" * 200_000]


def chats():
    rng = random.Random(2)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "assistant", "tool", "a:b\\n\n", "", None])
            rows.append((conv, turn, role, rng.choice(HARD + [None])))
    rows += [(70, t, "user" if t % 2 == 0 else "assistant", HARD[t]) for t in range(len(HARD))]
    rows += [(71, None, "user", "a"), (71, 0, "assistant", "b"), (71, 0, "assistant", "b"), (None, 0, "user", "n")]
    return rows


def test_chat_round_trip(spark):
    rows = chats()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("seq", F.lit("s")).withColumn("loss", F.lit(None).cast("string")).repartition(7)
    got = {r.conv_id: r for r in chat.read_chat(chat.format_chat(df)).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for conv, turns in by.items():
        turns.sort()
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for *_, a, t in turns).encode()).hexdigest()
        learnt = "".join(t for *_, a, t in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        order = [a for *_, a, _ in turns]
        state, ok = "start", True
        for role in order:
            state = chat.MACHINE[state].get(role, "broken")
            ok &= state != "broken"
        assert r.valid == ok
    assert got[70].valid and not got[71].valid


def test_formatted_text_follows_the_template(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u </turn>"), (1, 2, "assistant", "a")],
                               "conv_id long, turn long, role string, text string")
    parts = chat.format_chat(df).orderBy("seq").collect()
    assert "".join(p.text for p in parts) == (
        "### System:\ns</turn>\n### User:\nu \\</turn></turn>\n### Assistant:\na</turn>\n")
    assert [p.text for p in parts if p.loss] == ["a"]


@pytest.mark.parametrize("text", HARD)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text


def test_chat_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(df).collect() == []
    assert chat.read_chat(chat.format_chat(df)).collect() == []


# ---- WARC

def page_rows():
    big, bigger = "<p>é</p>\r\n\r\nWARC/1.1\r\n\r\n" * 60, "y" * 1000
    rows = [(k, f"http://h{k % 3}.example.org/p/{k}?q={k}", f"page {k} " * (k * 20)) for k in range(40)]
    rows += [(100 + k, "https://Same.Example.COM:8080/x", big) for k in range(5)]
    rows += [(200, None, bigger), (201, "not a url", bigger), (202, "http://[bad", bigger), (203, "http://a\r\nb/ü\t ", "z" * 999),
             (204, "", "z" * 999), (205, "http://e/", None), (206, "http://e/", ""), (None, "http://n/", "small"),
             (None, "http://n/", bigger), (300, "http://r/", "r" * 2000), (300, "http://r/", "r" * 2000), (-5, "http://neg/", "r" * 2000)]
    return rows


def brute_pages(rows):
    best = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= warc.MIN_DEDUP and p is not None:
            best[b] = max(p, best.get(b, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        keep = best.get(b, p)
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if p == keep else "revisit", None if p == keep else keep))
    return out


def sort_rows(rows):
    return sorted(rows, key=lambda r: [(x is None, x if x is not None else 0) for x in r])


@pytest.mark.parametrize("sizes", [(8 << 20, 512, 1 << 18), (3000, 2, 5)])
def test_warc_round_trip(spark, tmp_path, monkeypatch, sizes):
    """Also with many archives, ranges and blocks, so that lookups cross all levels of the index."""
    for name, value in zip(("ARCHIVE_BYTES", "BLOCK_ENTRIES", "RANGE_ENTRIES"), sizes):
        monkeypatch.setattr(warc, name, value)
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n", F.lit(1)).withColumn(
        "digest", F.lit("d")).repartition(4)
    path, index = str(tmp_path / "archives"), str(tmp_path / "index")
    warc.write_archives(pages, path)
    tops = warc.build_index(spark, path, index)
    found = warc.look_up(pages, spark, index, tops)
    got = warc.read_ranges(found, path).collect()
    assert sort_rows(tuple(r)[:5] for r in got) == sort_rows(brute_pages(rows))
    # only some of the pages
    some = warc.read_ranges(warc.look_up(pages.where("page_id in (3, 102, 104)"), spark, index, tops), path)
    assert sorted((r.page_id, r.record_type) for r in some.collect()) == [(3, "response"), (102, "revisit"), (104, "response")]


def test_archives_are_valid_warc(spark, tmp_path):
    rows = page_rows()
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"))
    seen = 0
    for file in (tmp_path / "a").glob("part-*"):
        content = file.read_bytes()
        for at, n, header in warc.scan_archive(content):
            seen += 1
            assert content[at:at + 8] == b"WARC/1.1" and content[at + n:at + n + 4] == b"\r\n\r\n"
            if header["WARC-Type"] == "response":
                payload = content[at:at + n].split(b"\r\n\r\n", 1)[1]
                assert header["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
    assert seen == len(rows)


def test_url_keys_sort_by_reversed_host():
    assert warc.url_key("http://Blog.Example.com:81/a?b=1#c") == "com,example,blog:81)/a?b=1"
    assert [warc.url_key(u) for u in (None, "", "nohost")] == ["", "", "nohost"]


def test_warc_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "a"))
    tops = warc.build_index(spark, str(tmp_path / "a"), str(tmp_path / "i"))
    found = warc.look_up(pages, spark, str(tmp_path / "i"), tops)
    assert warc.read_ranges(found, str(tmp_path / "a")).collect() == []


# ---- mixing

def brute_targets(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_share_all_words(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k}": rng.choice([0, 1, 10, 500, 10_000, 90_000]) for k in range(17)}
    sizes[None] = rng.randrange(5000)
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6) for s in want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def highest_quotients(weights, seats):
    quota = dict.fromkeys(weights, 0)
    for _ in range(seats):
        best = max(sorted(weights), key=lambda u: weights[u] / (2 * quota[u] + 1))
        quota[best] += 1
    return quota


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1003])
def test_quotas_are_sainte_lague(spark, seats):
    rng = random.Random(seats)
    weights = {k: rng.choice([0.0, 0.4, 3.0, 3.0, 17.5, 200.0, 1000.0]) for k in range(23)}
    df = spark.createDataFrame([(0, u, w, seats) for u, w in weights.items()], "g int, u int, w double, seats long")
    got = {r.u: r.quota for r in mixing.sainte_lague(df, ["g"], ["u"], "w", "seats").collect()}
    assert got == highest_quotients(weights, seats)


def test_mix_takes_the_targets(docs, rows):
    got = mixing.plan_mix(docs, shard_words=2000)
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    got = got.collect()
    assert len(got) == len(rows)
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        size[r.source] += r.size
        assert r.source_size >= r.size
    assert target.keys() == brute_targets(size).keys()
    for s, t in brute_targets(size).items():
        assert target[s] == pytest.approx(t)
        shards = size[s] // 2000 + 1
        assert abs(taken[s] - t) <= 2 * mixing.BLOCK_WORDS * (1 + shards)


def test_mix_reruns_agree(docs):
    key = lambda r: tuple((x is None, x or 0) for x in (r.doc_id, r.size, r.taken))
    first = sorted(map(key, mixing.mix(docs).collect()))
    assert sorted(map(key, mixing.mix(docs.repartition(3)).collect())) == first


def test_mix_empty_and_wordless_tables(spark, empty):
    assert mixing.mix(empty).collect() == []
    df = spark.createDataFrame([(1, None, "a"), (2, "", None), (None, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.source_size, r.target, r.taken) for r in mixing.mix(df).collect()] == [(0, 0, 0.0, 0)] * 3


def test_mix_plans_no_python(spark, docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
