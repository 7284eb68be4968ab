"""Archives and their index, the conversation trie and hard negatives, each against a plain version on small tables with odd rows."""

from __future__ import annotations

import base64
import glob
import gzip
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import negatives, trie, warc

# --- archives

PAGES = "page_id long, url string, html string, id long, key string, first string, range int, value string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "f", 2, "v") for r in rows], PAGES)


def captured():
    return F.timestamp_seconds(F.col("page_id") % 50)


def odd_pages(n=60, seed=4):
    draw = random.Random(seed)
    rows = [
        (1, "http://A.example.org/x y", "one\r\n\r\ntwo\r\n\r\n"), (2, None, None), (3, "http://b.example.org/\r\nWARC-Type: x", ""),
        (None, "http://b.example.org/", "<p>no id</p>"), (5, "no scheme", "\r\n"), (6, "http://c/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc"),
        (7, "http://c/", "\r\n\r\n\r\n"), (8, "http://c/", "é" * 70_000), (8, "http://c/", "é" * 70_000), (None, None, "é" * 70_000)]
    for i in range(n):
        rows.append((100 + i, "http://hot.example.com/p" if i % 3 else f"https://{draw.choice('abc')}.example.com/{i}", draw.choice(["same", "other", f"own {i}"])))
    draw.shuffle(rows)
    return rows


def expected_captures(rows):
    least = {}
    for i, _, html in rows:
        body = (html or "").encode()
        least.setdefault(body, []).append(i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        known = [x for x in least[body] if x is not None]
        first = min(known) if known else None
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "response" if i == first else "revisit", None if i == first else first))
    return out


def order(row):
    return tuple((x is not None, x) for x in row)


def test_archives_hold_every_row_and_equal_payloads_once(spark, tmp_path):
    rows = odd_pages()
    path = f"file://{tmp_path}/warc"
    index = warc.archive(pages(spark, rows).repartition(3), captured(), path=path)
    got = [(r["id"], r["bytes"], r["digest"], r["type"], r["refers_to"]) for r in index.collect()]
    assert sorted(got, key=order) == sorted(expected_captures(rows), key=order)
    kept = {(r["id"], bytes(r["payload"])) for r in warc.read_archives(spark, path, payload=True).where("type = 'response'").collect()}
    assert kept == {(i, (html or "").encode()) for (i, _, html), e in zip(rows, expected_captures(rows)) if e[3] == "response"}
    files = glob.glob(f"{tmp_path}/warc/*.gz")
    raw = {name.rsplit("/", 1)[1]: gzip.open(name).read() for name in files}
    for r in index.collect():                     # offset and length of the index cut whole records out of the archive
        record = raw[r["file"]][r["offset"]:r["offset"] + r["length"] + 4]
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        head = record.split(b"\r\n\r\n")[0].decode().split("\r\n")
        assert f"WARC-Type: {r['type']}" in head and len([h for h in head if h.startswith("WARC-Type")]) == 1


@pytest.mark.parametrize("run_rows,block,range_captures", [(7, 2, 5), (1000, 500, 1000), (1, 1, 1)])
def test_index_is_in_order_and_numbers_each_history(spark, run_rows, block, range_captures):
    path_rows = odd_pages(90)
    frame = pages(spark, path_rows).repartition(4)
    rows = warc.capture_rows(frame, captured()).select(
        "id", warc.url_key(F.col("url")).alias("key"), "time", "url", F.lit("response").alias("type"), "digest", "bytes",
        F.lit(None).cast("long").alias("refers_to"), F.lit("f").alias("file"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length"))
    got = warc.merged_index(rows, run_rows, block, range_captures).orderBy("range", "place").collect()
    want = sorted((r.asDict() for r in rows.collect()), key=warc._order)
    assert [(r["key"], r["time"], r["id"]) for r in got] == [(r["key"], r["time"], r["id"]) for r in want]
    seen = {}
    for r in got:
        seen[r["key"]] = seen.get(r["key"], 0) + 1
        assert r["seq"] == seen[r["key"]]
    if range_captures == 5:                        # the hot URL is spread over several ranges
        assert len({r["range"] for r in got if r["key"].startswith("com,example,hot)")}) > 1


def test_loser_tree_merges_any_number_of_lists():
    draw = random.Random(1)
    for k in range(12):
        lists = [sorted(draw.randrange(9) for _ in range(draw.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(lists, lambda x: x)) == sorted(x for own in lists for x in own)


def test_archive_of_no_pages_and_broken_archive(spark, tmp_path):
    assert warc.archive(pages(spark, []), captured()).count() == 0
    folder = tmp_path / "bad"
    folder.mkdir()
    with gzip.open(folder / "x.gz", "wb") as f:
        f.write(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 90\r\n\r\nshort")
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_archives(spark, f"file://{folder}").collect()


def test_least_bytes_keeps_short_payloads_whole(spark):
    rows = [(1, "http://a/", "ab"), (2, "http://a/", "ab"), (3, "http://a/", "abcdef"), (4, "http://a/", "abcdef")]
    got = warc.archive(pages(spark, rows), captured(), least_bytes=3)
    assert {r["id"]: r["type"] for r in got.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


# --- conversations

TURNS = "conv_id long, turn long, role string, text string, conv string, node int, depth int, range int, k0 string"


def odd_turns(seed=2):
    draw = random.Random(seed)
    rows = []
    for c in [*range(0, 45), -7, -21, 63, 104, 2 ** 40]:
        if c == 40:                                # bases 40 and 60 are absent
            continue
        for t in range(draw.randrange(0, 5)):
            rows.append((c, draw.choice([t, t, t, None]), draw.choice(["user", "bot", None]), draw.choice(["hi", "hello there", "", None, "a b c"])))
        if not c % 5:
            rows += [(c, 2, "user", "again")] * 2
    rows += [(None, 1, "user", "lost"), (20, 0, "user", "x " * 50_000)]
    rows += [(44, t, "user", "hi") for t in range(60)] + [(44, 3, "bot", "same")] * 30
    draw.shuffle(rows)
    return rows


def plain_trie(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append(((t is not None, t or 0), digest, role, text))
    turns = {c: [(role, text) for _, _, role, text in sorted(own)] for c, own in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        built[c] = tuple(turns.get(base, [])[:h]) + tuple(own[h:])
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    out, clock = {}, [0]

    def visit(path):
        enter, clock[0] = clock[0], clock[0] + 1
        members = sorted(nodes[path])
        leaves, saved = 0, (len(members) - 1) * len(path[-1][1].split()) if path else 0
        for kid in sorted(kids.get(path, []), key=lambda p: min(nodes[p])):
            a, b = visit(kid)
            leaves, saved = leaves + a, saved + b
        leaves = leaves or 1
        ends = ",".join(str(c) for c in members if built[c] == path)
        out[(members[0], len(path))] = (
            min(nodes[path[:-1]]) if path else None, len(members), len(kids.get(path, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest(),
            enter, clock[0])
        clock[0] += 1
        return leaves, saved

    if built:
        visit(())
    return out


@pytest.mark.parametrize("one_task", [1 << 16, 3])
def test_trie_like_a_recursive_one(spark, one_task, monkeypatch):
    monkeypatch.setattr(trie, "RANGE_NODES", 9)     # many ranges, so that runs cross them
    rows = odd_turns()
    frame = spark.createDataFrame([(*r, "c", 1, 2, 3, "k") for r in rows], TURNS).repartition(3)
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in trie.trie(frame, one_task=one_task).collect()}
    want = plain_trie(rows)
    assert got.keys() == want.keys()
    wrong = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    assert not wrong, list(wrong.items())[:3]


def test_trie_without_conversations_and_with_turnless_ones(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.trie(empty).collect() == []
    one = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 1)     # its only turn is replaced by one of an absent base
    frame = spark.createDataFrame([(one, 1, "user", "hi", "c", 1, 2, 3, "k")], TURNS)
    (root,) = trie.trie(frame).collect()
    assert (root["conv_id"], root["depth"], root["n_convs"], root["n_leaves"], root["saved_tokens"]) == (one, 0, 1, 1, 0)
    assert root["ends_sha256"] == hashlib.sha256(str(one).encode()).hexdigest()


def test_list_ranks_of_a_shuffled_list(spark):
    draw = random.Random(8)
    ids = draw.sample(range(10_000), 500)
    rows = [(i, s, draw.randrange(5), draw.randrange(3), draw.randrange(9)) for i, s in zip(ids, [*ids[1:], None])]
    frame = spark.createDataFrame(rows, "id long, succ long, place long, leaves long, savings long")
    got = {r["id"]: tuple(r)[1:] for r in trie.rank_list(frame, 20).collect()}
    before = (0, 0, 0)
    for i, _, *own in rows:
        assert got[i] == before
        before = tuple(a + b for a, b in zip(before, own))


def test_ends_of_a_node_with_many_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 4)
    frame = spark.createDataFrame([(c, 0, "user", "hi", "c", 1, 2, 3, "k") for c in range(0, 4000, 20)], TURNS)
    got = {r["depth"]: r["ends_sha256"] for r in trie.trie(frame).collect() if r["n_convs"] > 1}
    ends = [c for c in range(0, 4000, 20)]
    assert got[1] == hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()


# --- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, id long, vector string, score int, group int"


def plain_negatives(rows, positives=5, negatives_=10):
    kept = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in sorted({i for i, _, _ in kept if i % 100 == 0}):
        lab, vec = min((lab, v) for i, lab, v in kept if i == a)
        scored = sorted((-sum(x * y for x, y in zip(vec, v)), i, own) for i, own, v in kept if i != a)
        for score, p in [(-s, i) for s, i, own in scored if own == lab][:positives]:
            fit = [(-s, i) for s, i, own in scored if own != lab and 30 * score <= -100 * s <= 90 * score][:negatives_]
            out += [(a, p, n + 1, i, score, s) for n, (s, i) in enumerate(fit)]
    return sorted(out)


def odd_vectors(n=500, dims=6, seed=5):
    draw = random.Random(seed)
    rows = [(i, [draw.choice([draw.uniform(-1, 1), 0.5, 0.25]) for _ in range(dims)], 1 if i % 3 == 0 else draw.randrange(4)) for i in range(n)]
    rows += [(i, list(rows[7][1]), 2) for i in range(1000, 1040)]                        # copies: ties by id
    rows += [(2000, None, 1), (2001, [None] * dims, 1), (2002, [math.nan] * dims, 1), (2003, [math.inf] * dims, 2), (2100, [0.1] * dims, None),
             (None, [0.5] * dims, 1), (2200, [], 1), (2201, [0.9] * (dims + 3), 1), (2202, [0.9, 0.9], 2), (300, [0.75] * dims, 9), (300, [0.75] * dims, 9)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1 << 14, 2])
def test_hard_negatives_like_a_full_search(spark, block):
    rows = odd_vectors()
    frame = spark.createDataFrame([(*r, 1, "v", 2, 3) for r in rows], VECTORS).repartition(5)
    got = negatives.mine(frame, F.col("vec_id") % 100 == 0, block=block)
    assert [f.simpleString() for f in got.schema] == [
        "anchor_id:bigint", "positive_id:bigint", "rank:int", "negative_id:bigint", "positive_score:bigint", "negative_score:bigint"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_hard_negatives_without_rows_or_anchors(spark):
    assert negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).count() == 0
    frame = spark.createDataFrame([(1, [1.0], 1, 1, "v", 2, 3), (2, [1.0], 2, 1, "v", 2, 3)], VECTORS)
    assert negatives.mine(frame, F.col("vec_id") % 100 == 0).count() == 0


def test_scores_stay_exact_beyond_doubles():
    rows, anchors = np.array([[2.0 ** 27, 1.0]]), np.array([[2.0 ** 27 + 1, 3.0]])
    assert negatives.scores(rows, anchors)[0, 0] == 2 ** 27 * (2 ** 27 + 1) + 3


def test_best_rows_keep_the_first_of_each_group():
    draw = random.Random(3)
    offers = [(draw.randrange(3), draw.randrange(-4, 5), i) for i in range(200)]
    draw.shuffle(offers)
    best = negatives.BestRows(3, 4)
    for at in range(0, 200, 17):
        best.offer(*(np.array(c) for c in zip(*offers[at:at + 17])))
    group, score, ids = best.rows()
    for g in range(3):
        want = sorted((-s, i) for own, s, i in offers if own == g)[:4]
        assert [(-s, i) for own, s, i in zip(group, score, ids) if own == g] == want


# --- odd tables of earlier operators

def test_mix_of_a_table_that_has_its_columns_already(spark):
    from tidewatch.llm import mixing

    docs = spark.createDataFrame([(i, "t", "a" if i % 3 else "b", 1, 7, "x") for i in range(90)],
                                 "doc_id long, text string, source string, n_chars long, replica int, shuffle_key string")
    got = mixing.mix(docs)
    assert got.columns[:6] == docs.columns and len(set(got.columns)) == len(got.columns) and {r["replica"] for r in got.collect()} <= {7}


def test_url_verdicts_of_odd_pages(spark):
    from tidewatch.llm import urls

    model = urls.fit(urls.labelled_table(spark))
    schema = "page_id long, url string, host string, rule string"
    rows = [(1, None), (2, ""), (3, "http://x.org/" + "a" * 100_000), (3, "http://x.org/" + "a" * 100_000), (None, "https://sub.example.org/es/1"), (4, "no scheme")]
    got = urls.judge(spark.createDataFrame([(i, u, "h", "r") for i, u in rows], schema), model).collect()
    assert len(got) == len(rows) and all(r["verdict"] in ("allow", "block") for r in got)
    assert [r["rule"] for r in got if r["page_id"] is None] == ["example.org/es/"] and len({r["verdict"] for r in got if r["page_id"] == 3}) == 1
    assert urls.judge(spark.createDataFrame([], schema), model).count() == 0
