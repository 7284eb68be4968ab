"""Operators that compare documents: brute force on small tables, odd rows, SQL, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tidewatch.llm import decontam, lines, lm, mixing, quality, similar, simhash

EXTRA = "doc_id long, text string, source string, n_chars long, id int, key string, fp int, site string, rate double, _row int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, len(t or ""), 1, "k", 2, "x", 0.5, 3) for i, t, s in rows], EXTRA)


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]


def naive_print(text):
    words = words_of(text)
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(pairs, ids):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in pairs:
        root[find(a)] = find(b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    out = {}
    for members in groups.values():
        known = [ids[i] for i in members if ids[i] is not None]
        out.update(dict.fromkeys(members, min(known) if known else None))
    return out


def near_copies(n, seed=3):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(500)}" for _ in range(400)]
    rows = []
    for i in range(n):
        words = list(base) if i % 3 else [f"v{draw.randrange(900)}" for _ in range(60)]
        if i % 3 == 1:
            words[draw.randrange(400)] = f"z{i}"
        rows.append((1000 - i, " ".join(words), f"s{i % 4}"))
    return [*rows, (5, None, None), (4, "", "s1"), (4, "", "s1"), (None, "one two", "s1"), (None, "one two", "s1"), (77, "Ab", "s2"), (78, "aB", "s2"),
            (79, "long " * 50_000, "s2")]


@pytest.mark.parametrize("dense", [2, simhash.DENSE])
def test_simhash_against_all_pairs(spark, dense, monkeypatch):
    rows = near_copies(150)
    monkeypatch.setattr(simhash.links, "__defaults__", (2, 3, dense))
    got = simhash.near_duplicates(table(spark, rows)).collect()
    prints = [naive_print(t) for _, t, _ in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    component = naive_components(pairs, [r[0] for r in rows])
    want = Counter((r[0], prints[i], component[i]) for i, r in enumerate(rows))
    assert Counter((r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    kept = simhash.drop_near_duplicates(table(spark, rows))
    groups = {}
    for a, b in pairs:
        groups.setdefault(a, set()).add(b)
    roots = naive_components(pairs, list(range(len(rows))))
    assert kept.count() == len(set(roots.values())) and kept.columns == EXTRA.replace(",", "").split()[::2]


@pytest.mark.parametrize("partitions", [2, 3, 4])
def test_links_with_other_partitions(spark, partitions):
    draw = random.Random(partitions)
    prints = set()
    for _ in range(120):
        x = draw.getrandbits(64)
        prints |= {x, x ^ 1 << draw.randrange(64), x ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), partitions=partitions).collect()
    want = {(max(a, b), min(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 2}
    assert {(r["a"], r["b"]) for r in got} == want


def test_thresholds_cover_the_distance():
    costs = [{-1: 0.0, 0: 5.0, 1: 50.0, 2: 500.0}, {-1: 0.0, 0: 900.0, 1: 9000.0, 2: 90000.0}, {-1: 0.0, 0: 4.0, 1: 6.0, 2: 700.0}]
    assert simhash.allocate(costs) == [0, -1, 1]
    assert simhash.allocate([{-1: 0, 0: 1, 1: 2, 2: 3}] * 3) == [-1, -1, 2] or sum(simhash.allocate([{-1: 0, 0: 1, 1: 2, 2: 3}] * 3)) == 0
    groups = simhash.group_bits(np.eye(65))
    assert sorted(sum(groups, [])) == list(range(64)) and {len(g) for g in groups} <= {21, 22}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90)], "a long, b long")
    assert {(r["a"], r["root"]) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 41)} | {(100, 90)}


@pytest.mark.parametrize("dense", [1, 4, similar.DENSE])
def test_near_copies_against_all_pairs(spark, dense):
    draw = random.Random(8)
    rows = []
    for group in range(12):
        base = [f"g{group}w{draw.randrange(300)}" for _ in range(draw.choice([30, 90, 200]))]
        for _ in range(14 if group else 60):
            words = list(base)
            for _ in range(draw.randrange(1 + len(words) // 20)):
                words[draw.randrange(len(words))] = f"x{draw.randrange(10 ** 6)}"
            rows.append((10_000 - len(rows), " ".join(words), "s"))
    shared = " ".join(f"common{i}" for i in range(40))
    rows += [(20_000 + i, shared + " " + " ".join(f"own{i}x{k}" for k in range(6 + i)), "s") for i in range(30)]
    rows += [(5, None, None), (4, "", "s"), (4, "", "s"), (None, "one two", "s"), (None, "one two", "s"), (77, "Ab", "s"), (78, "aB", "s"), (79, "a b c d e f", "s")]
    sets = []
    for _, text, _ in rows:
        w = words_of(text)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    pairs = [(a, b) for a in range(len(rows)) for b in range(a)
             if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = naive_components(pairs, list(range(len(rows))))
    groups = {}
    for at, r in root.items():
        groups.setdefault(r, []).append(rows[at][0])
    want = Counter(min((i for i in g if i is not None), default=None) for g in groups.values())
    got = similar.drop_similar(table(spark, rows), dense=dense)
    assert Counter(r["doc_id"] for r in got.collect()) == want and got.columns == EXTRA.replace(",", "").split()[::2]
    prints = [naive_print(t) for _, t, _ in rows]
    far = sum((prints[a] ^ prints[b]).bit_count() > 2 for a, b in pairs)
    assert far > len(pairs) / 4                              # what two bits of three-word shingles would leave
    assert corpus_pipeline.near_dedup(spark, table(spark, rows), "").count() == len(groups)


def test_near_copies_go_through_the_pigeonhole(spark, monkeypatch):
    rows = near_copies(60)
    prints = sorted({naive_print(t) for _, t, _ in rows})
    want = naive_components([(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2], list(range(len(prints))))
    find, found, given, verify = similar.print_pairs, [], [], similar.verified

    def kept(classes):
        found.append((classes.collect(), find(classes)))
        return found[-1][1]

    def noted(pairs, texts, width, similarity, name):
        given.append({(r["a"], r["b"]) for r in pairs.collect()})
        return verify(pairs, texts, width, similarity, name)

    monkeypatch.setattr(similar, "print_pairs", kept)
    monkeypatch.setattr(similar, "verified", noted)
    first = similar.pigeonhole_pairs

    def stored(texts):
        out = first(texts)
        given.append({(max(r["a"], r["b"]), min(r["a"], r["b"])) for r in out.collect()})
        return out

    monkeypatch.setattr(similar, "pigeonhole_pairs", stored)
    corpus_pipeline.near_dedup(spark, table(spark, rows), "").collect()
    ((classes, pairs),) = found
    assert {r["fp"] % (1 << 64) for r in classes} == set(prints)
    at = {p: i for i, p in enumerate(prints)}
    linked = [(at[r["a"] % (1 << 64)], at[r["b"] % (1 << 64)]) for r in pairs.collect()]
    assert linked and naive_components(linked, list(range(len(prints)))) == want
    assert given[0] and given[0] <= given[1]                 # its pairs are among those that the exact sets decide on


def test_near_copies_without_rows(spark):
    assert similar.drop_similar(table(spark, [])).count() == 0


@pytest.mark.parametrize("slack", [0, 2, 7])
def test_proximity_stays_in_a_document(spark, slack):
    """Many short documents in one segment against all stretches of each; repeated items and words, nulls and no words."""
    draw = random.Random(slack)
    texts = [" ".join(draw.choice("alpha beta gamma delta eps zeta".split()) for _ in range(draw.randrange(9))) for _ in range(150)]
    texts += ["alpha beta gamma", "delta epsilon zeta", None, "", "!!"]
    docs = table(spark, [(i, t, "s") for i, t in enumerate(texts)])
    items = [(1, "gamma delta"), (2, "gamma delta"), (3, "beta beta zeta"), (4, None), (5, ""), (6, "nowhere alpha"), (7, "alpha beta gamma delta eps")]
    index = decontam.build_index(docs)
    found = decontam.matches(index, spark.createDataFrame(items, "item_id long, text string"), width=4, slack=slack).collect()
    places = {(r["segment"], d): i for r in index.where("term IS NULL").collect() for d, i in enumerate(r["ids"])}
    want = set()
    for i, t in enumerate(texts):
        words = (t or "").replace("!", " ").split()
        for item, text in items:
            own = (text or "").split()
            for w in {tuple(own[k:k + 4]) for k in range(max(1, len(own) - 3))} if own else ():
                for a in range(len(words)):
                    fit = [b for b in range(a, min(len(words), a + len(w) + slack)) if set(w) <= set(words[a:b + 1])]
                    if fit and words[a] in w:
                        want.add((i, a, fit[0] - a + 1, item))
    assert {(places[(r["segment"], r["doc"])], r["start"], r["length"], r["item_id"]) for r in found} == want and len(want) > 5


def test_line_dedup_against_a_loop(spark):
    rows = [(i, f"own {i}\nshared all\n\ntwo only {i % 2}", f"s{i % 12}") for i in range(24)] + [(30, "shared all", None), (30, "shared all", None), (31, None, "s1"), (None, "shared all\nx", "s1")]
    out, removed = lines.strip_boilerplate(table(spark, rows))
    got = Counter((r["doc_id"], r["text"], r[removed]) for r in out.collect())
    first = (0, 1)
    want = Counter()
    for i, text, _ in rows:
        keep = None if text is None else [x for at, x in enumerate(text.split("\n")) if x != "shared all" or (i, at) == first]
        want[(i, None if keep is None else "\n".join(keep), 0 if text is None else len(text.split("\n")) - len(keep))] += 1
    assert got == want
    assert out.columns[:-1] == EXTRA.replace(",", "").split()[::2]
    empty, _ = lines.strip_boilerplate(table(spark, []))
    assert empty.count() == 0


def test_near_threshold_lines_are_counted(spark):
    rows = [(i * 100 + k, f"line {k}", f"s{i}") for k in range(8, 13) for i in range(k)]
    bad = lines.boilerplate(lines.occurrences(table(spark, rows), "doc_id", "text", "source"))
    assert bad.count() == 3


def test_decontamination_against_a_loop(spark):
    item = " ".join(f"Alpha{i}" for i in range(14))
    phrase = item.lower().split()
    items = [(1, item), (2, "short one"), (3, None), (4, ""), (12, item), (None, "zzz never")]
    rows = [(1, " ".join(["x", *phrase[2:12], "y"]), "s"), (2, "a short, ONE here short one", "s"), (3, " ".join(phrase[:9]), "s"), (4, None, "s"), (4, "", "s"),
            (None, item, "s"), (5, item + " " + item, "s"), (5, item + " " + item, "s"), (6, "short " * 30_000 + "one", "s"), (7, "short", "s"), (8, "one", "s")]
    docs = table(spark, rows)
    got = decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = Counter()
    for i, text, _ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        hit, found = set(), set()
        for number, t in items:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
            for at in range(max(1, len(w) - 9)) if w else ():
                window = w[at:at + 10]
                for j in range(len(words) - len(window) + 1):
                    if words[j:j + len(window)] == window:
                        hit.update(range(j, j + len(window)))
                        found.add(str(number))
        want[(i, len(words), len(hit), len(found), ",".join(sorted(found)))] += 1
    assert Counter((r["id"], r["n_words"], r["n_hit"], r["n_items"], r["items"]) for r in got) == want
    left = decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(k[0]) for k, n in want.items() for _ in range(n) if not k[2])
    index = decontam.build_index(docs, segment_bytes=50)
    near = decontam.matches(index, spark.createDataFrame([(9, "one short here")], "item_id long, text string"), slack=2)
    assert sorted((r["start"], r["length"]) for r in near.collect()) == [(1, 3), (2, 3), (3, 3)] and index.select("segment").distinct().count() > 5


def test_decontamination_in_blocks_and_without_items(spark):
    docs = table(spark, [(1, "a b c d", "s"), (2, "c d", "s")])
    items = spark.createDataFrame([(k, t) for k, t in enumerate(["a b", "c d", "b c"])], "item_id long, text string")
    index = decontam.build_index(docs)
    assert decontam.matches(index, items, block_bytes=3).count() == decontam.matches(index, items).count() == 4
    assert decontam.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(docs.limit(0), items).count() == 0


def test_mixing_reaches_the_target(spark):
    rows = [(i, "x" * 10, "big" if i % 10 else "small") for i in range(6000)] + [(None, None, None), (1, "x" * 10, "big")]
    out = mixing.mix(table(spark, rows), weights={"big": 0.5, "small": 0.5}).collect()
    by = Counter(r["source"] for r in out)
    assert abs(by["small"] - 3000) < 200 and abs(by["big"] - 3000) < 250
    copies = Counter((r["doc_id"], r["source"]) for r in out)
    assert copies[(1, "big")] % 2 == 0                       # equal ids, equal draws
    again = mixing.mix(table(spark, rows), weights={"big": 0.5, "small": 0.5}).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again)) and mixing.mix(table(spark, [])).count() == 0


@pytest.mark.parametrize("rate", [0.3, 1.0, 5.0, 700.0])
def test_poisson_inversion(spark, rate):
    from pyspark.sql import functions as F

    steps = max(1, math.ceil(rate / mixing.LARGEST_STEP))
    rows = spark.range(4000).select(mixing.copies(mixing.cumulative(F.lit(rate / steps)), F.lit(steps), 1, F.col("id").cast("string")).alias("n"))
    n = np.array([r["n"] for r in rows.collect()])
    assert abs(n.mean() - rate) < 5 * math.sqrt(rate / 4000) and abs(n.var() / rate - 1) < 0.15
    if rate == 0.3:
        def draw(i):
            u = int(hashlib.md5(f"1|{i}|1".encode()).hexdigest()[:13], 16) / 2 ** 52
            k, term, total = 0, math.exp(-rate), math.exp(-rate)
            while total <= u:
                k, term = k + 1, term * rate / (k + 1)
                total += term
            return k
        assert n.tolist() == [draw(i) for i in range(4000)]


def test_language_model_against_counting(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice("a b c d the Of".split()) for _ in range(draw.randrange(30))), "s") for i in range(120)] + [(500, None, "s"), (None, "a b", "s"), (3, "a\u00a0b \x0b c", "s")]
    monkeypatch.setattr(lm.segments, "__defaults__", (300,))
    got = lm.score(table(spark, rows)).collect()
    part = lambda i: 2 if i is None else zlib.crc32(str(i).encode()) % 7
    tokens = [[*words_of(t), None] for _, t, _ in rows]
    one, two, kept_one, kept_two, docs, kept_docs = Counter(), Counter(), Counter(), Counter(), 0, 0
    for (i, _, _), t in zip(rows, tokens):
        if part(i) != 2:
            one.update(t), two.update(zip([0, *t], t))
            docs += 1
            if part(i) != lm.DEVELOPMENT:
                kept_one.update(t), kept_two.update(zip([0, *t], t))
                kept_docs += 1
    total, words = sum(one.values()), len(one)

    def shares(t, before, c1, c2, n, d):
        context = d if before == 0 else c1[before]
        return [1 / (words + 1), c1[t] / n, c2[(before, t)] / context if context else 0.0], sum(context >= e for e in lm.CONTEXT_EDGES)

    weights, last = {g: [1 / 3] * 3 for g in range(len(lm.CONTEXT_EDGES) + 1)}, -math.inf
    dev = [(t, b) for (i, _, _), ts in zip(rows, tokens) if part(i) == lm.DEVELOPMENT for b, t in zip([0, *ts], ts)]
    for _ in range(30):
        sums, gain = {g: [0.0] * 3 for g in weights}, 0.0
        for t, b in dev:
            p, g = shares(t, b, kept_one, kept_two, sum(kept_one.values()), kept_docs)
            mixed = sum(w * x for w, x in zip(weights[g], p))
            gain += math.log(mixed)
            for k in range(3):
                sums[g][k] += weights[g][k] * p[k] / mixed
        weights = {g: [x / sum(s) for x in s] if sum(s) else weights[g] for g, s in sums.items()}
        if gain - last <= 1e-4 * len(dev):
            break
        last = gain
    want = []
    for (i, _, _), ts in zip(rows, tokens):
        base = sum(math.log10((one[t] + 1) / (total + words + 1)) for t in ts)
        score = 0.0
        for b, t in zip([0, *ts], ts):
            p, g = shares(t, b, one, two, total, docs)
            w = [max(x, 1e-9) for x in weights[g]]
            score += math.log10(sum(a * x for a, x in zip(w, p)) / sum(w))
        want.append((str(i), part(i) == 2, len(ts), sum(one[t] > 0 for t in ts), total, round(base, 6), round(score, 6)))
    assert sorted((str(r["id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == sorted(want)


def test_language_model_without_rows(spark):
    assert lm.score(table(spark, [])).count() == 0
    alone = lm.score(table(spark, [(None, "a b", "s")])).first()
    assert alone["held_out"] and alone["train_tokens"] == 0 and alone["n_known"] == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf)
    con = duckdb.connect()
    item_windows = {w for (t,) in con.execute(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall() for w in decontam.windows([t])}
    rows = {r["doc_id"]: r["clean_text"] for r in quality.judge(docs).where("kept").collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sites, seen = {}, set()
    for i, text in rows.items():
        for line in text.split("\n"):
            sites.setdefault(line, set()).add(source[i])
    for i in sorted(rows):
        keep = []
        for line in rows[i].split("\n"):
            if not line.strip() or len(sites[line]) < lines.MIN_SITES or line not in seen:
                keep.append(line)
            seen.add(line)
        rows[i] = "\n".join(keep)
    ids = sorted(rows)
    prints = [naive_print(rows[i]) for i in ids]
    root = naive_components([(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2], ids)
    ids = [i for at, i in enumerate(ids) if root[at] == i]
    clean = []
    for i in ids:
        words = tuple(decontam.words_of(rows[i].encode()))
        if not any(words[j:j + len(w)] == w for w in item_windows for j in range(len(words) - len(w) + 1) if words[j] == w[0]):
            clean.append(i)
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert set(texts) <= set(clean) and all(texts[i] == rows[i] for i in texts)
    assert len(texts) > 0.4 * len(clean)
    assert got.columns == [*docs.columns, "replica", "shuffle_key"]
