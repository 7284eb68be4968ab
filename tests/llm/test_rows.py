"""Operators that judge each row by itself: counts by hand, odd rows, held-out accuracy."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from tidewatch.llm import html, licenses, oracles, quality, toxicity, urls

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (None, "one two three one two three"), (4, "one"), (5, "a b\n" * 20000)]


def naive_counts(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    seen = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_by_hand(spark):
    rows = [*ODD, (6, "a a a a"), (7, "x y z # $ x y z w"), (8, "é| ü|\né| ü|\n")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, kept int, _verdict int")
    got = [tuple(r) for r in quality.judge(docs).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()]
    assert got == [naive_counts(t) for _, t in rows]
    assert [c for c in quality.clean(docs).columns] == docs.columns


def test_quality_line_rules(spark):
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    docs = spark.createDataFrame([
        (1, f"{prose}\nHome | News | About | Contact.\nWe use cookies."), (2, prose + "\n" + " | ".join(f"w{i}" for i in range(200)) + " | end."),
        (3, prose)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert got[1]["kept"] and got[1]["n_bad_lines"] == 2 and got[1]["clean_text"] == prose
    assert not got[2]["kept"] and not got[2]["base_failed"] and got[3]["kept"] and got[3]["n_bad_lines"] == 0


def test_long_lines_may_mention_notices(spark):
    import corpus_pipeline

    words = " ".join(f"word{i}" for i in range(3000))
    long = f"{words} the site sets cookies and asks to sign up {words[:4000]}."
    docs = spark.createDataFrame([(1, long), (2, f"{words}.\nWe use cookies.\nSign up and log in."), (3, "We use cookies. " * 60)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert got == {1: long, 2: f"{words}."}


def test_quality_of_an_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Top <h2>site</h2></header>
<nav><ul><li><a href='/'>Home</a></li></ul></nav><div class="cookie-notice"><div>We use it</div> more</div><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p>First  one<br>goes on.<p>S.</p><form><input>Mail</form><script>var t="</p>";</script>
<p>Fish &lt;chips&gt; &eacute;</p><aside>Side</aside></article><section id="comments"><p>A long comment</p></section><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize("page, want", [
    (PAGE, "Head & line\n\nFirst one goes on.\n\nS.\n\nFish <chips> é"), (None, ""), ("", ""), ("<p", ""), ("<article><p>cut of", "cut of"),
    ("<div class=ad><div>x</div>y</div><main><p>m</p></main>", "m"), ("<script>x<p>y", ""),
])
def test_main_text(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("page, want", [
    ("<article><p>if a < b then the rest", "if a < b then the rest"), ("<article><p>a < 3</p><p>1 <2 <p", "a < 3\n\n1 <2"),
    ("<head><title>x</title><meta charset=utf-8><body><article><p>all of it</p></article>", "all of it"),
    ("<head><title>x</title><style>p{}</style><article><p>all of it</p></article>", "all of it"),
    ("<article><p>one <svg class=\"icon\"/> two</p><math/><p>three <svg><text>no</text></svg> four</p></article>", "one two\n\nthree four"),
])
def test_pages_are_read_to_the_end(page, want):
    assert html.main_text(page) == want


PROSE = "The dog of the house was in the yard and it is to be with us for a day. " * 5
SAID = PROSE.strip()


@pytest.mark.parametrize("page, want", [
    (f'<div class="content has-sidebar"><article><p>{PROSE}</p></article></div>', SAID),
    (f'<div class="page-sidebar"><article><p>{PROSE}</p></article></div>', SAID),
    (f"<body><form action=x><div><p>{PROSE}</p></div></form></body>", SAID),
    (f'<h1 class="entry-title">T</h1><div><p>{PROSE}</p></div>', f"T\n\n{SAID}"),
    (f"<article><p>Short one.</p></article><div><p>{PROSE}</p></div>", f"Short one.\n\n{SAID}"),
    (f"<article><p>{PROSE}</p></article><div class=comments><article><p>{PROSE * 3}</p></article></div>", SAID),
    (f"<div class=ad>{PROSE}</div><article><p>Short one.</p></article>", "Short one."),
    (f"<main><h1>T</h1><div class=menu-wrapper><p>{PROSE}</p></div></main>", f"T\n\n{SAID}"),
    (f"<div><p>{PROSE * 2}</p></div><div class=sidebar><p>{PROSE}</p></div><nav><p>{PROSE * 9}</p></nav>", (PROSE * 2).strip()),
])
def test_names_are_hints(page, want):
    assert html.main_text(page) == want


def test_blocks_inherit_from_neighbours():
    good, bad = ("x", 0.0, "article"), ("x", 0.0, "out")
    short = ("short words", 0.0, "")
    rules = html.BlockRules()
    assert html.labels([good, short, good], rules) == [True, True, True]
    assert html.labels([bad, short, bad], rules) == [False, False, False]
    assert html.labels([good, short, short, bad], rules) == [True, True, False, False]
    assert html.labels([short], rules) == [False]
    prose = "the cat of the house and the dog in the yard that was to be with it " * 5
    assert html.labels([(prose, 0.0, ""), short, (prose, 0.0, "")], rules) == [True] * 3
    assert html.labels([(prose, 0.9, "")], rules) == [False]


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = html.extract(pages).collect()
    assert [r["n_chars"] for r in got] == [len(html.main_text(PAGE))] * 2 + [0] and got[2]["text"] == ""
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("url, want", [
    ("http://A.Example.ORG/es/1?x#y", ("a.example.org", "/es/1", "example.org/es/")), ("https://example.org/en/12", ("example.org", "/en/12", "example.org/en/1")),
    ("https://x.org", ("x.org", "", None)), ("http://x.com?/fr/", ("x.com", "", None)), ("http://com/fr/1", ("com", "/fr/1", "com/fr/")),
    ("ftp://notcom/fr/", ("notcom", "/fr/", None)), ("/fr/x", ("", "", None)), (None, ("", "", None)), ("a://b://c/d", ("b:", "//c/d", None)), ("", ("", "", None)),
])
def test_url_parts_and_rules(spark, url, want):
    got = urls.judge(spark.createDataFrame([(1, url, 3)], "page_id long, url string, host int"), [0.0] * (urls.BUCKETS + 1)).first()
    assert (got["host"], got["path"], got["rule"]) == want


def test_url_model_on_left_out_rows(spark):
    right = total = 0
    for fold in range(3):                        # each third judged by a model of the others
        parts = [([u for i, u in enumerate(rows) if i % 3 != fold], rows[fold::3]) for rows in (urls.BLOCKED_URLS, urls.ALLOWED_URLS)]
        weights = urls.fit(urls.labelled_table(spark, parts[0][0], parts[1][0]))
        test = spark.createDataFrame([(1, u) for u in parts[0][1]] + [(0, u) for u in parts[1][1]], "page_id long, url string")
        got = urls.judge(test, weights, rules=(("none.invalid", "/", "allow"),)).collect()
        right += sum((r["verdict"] == "block") == (r["page_id"] == 1) for r in got)
        total += len(got)
    assert right / total > 0.75


def test_licenses_against_sql_and_variants(spark):
    import duckdb

    mit = licenses.KNOWN[0][1]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ;")), (3, mit + " more"), (4, None), (4, ""), (5, "x y.\nReleased under the MIT licence!"),
            (None, mit), (5, "x y.\nReleased under the MIT licence!")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    got = licenses.scan(docs, licenses.known_digests(spark)).toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    key = lambda r: tuple(map(str, r))
    want = con.execute(oracles.LICENSES).fetchall()
    as_rows = [(None if i != i else int(i), *r) for i, *r in got.astype(object).itertuples(index=False)]
    assert sorted(as_rows, key=key) == sorted(want, key=key)
    names = {r[0]: (r[2], r[3]) for r in want}
    assert names[1] == names[2] == ("MIT", "") and names[3][0] is None and names[5] == (None, "MIT")


def test_whole_licenses_at_any_line_wrap(spark):
    import textwrap

    import duckdb

    rows = []
    for name, text in licenses.KNOWN:
        for width in (*range(30, 100, 7), 10_000):
            body = "\n\n".join("\n".join(textwrap.wrap(p, width)) for p in text.split("\n\n"))
            rows.append((len(rows), "Copyright (c) 2020 Someone\n\n" + body, name))
    isc = next(t for n, t in licenses.KNOWN if n == "ISC")
    rows.append((len(rows), isc.replace("the above copyright", "the above\ncopyright"), "ISC"))
    heads = ["Copyright Someone", "Copyright: 2020 X", "(c) 2019 X", "\u00a9 X", "Copyright notices Inc", "Copyright <year> X", "All rights reserved.", "copyright  2001-2003", "Copyright Andover"]
    rows += [(len(rows) + i, f"{h}\n{isc}", None if "notices" in h else "ISC") for i, h in enumerate(heads)]
    rows.append((len(rows), "(c) you must keep\n" + isc, None))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs, licenses.known_digests(spark)).collect()}
    assert [(i, got[i]["license"]) for i, _, _ in rows] == [(i, name) for i, _, name in rows]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert sorted(con.execute(oracles.LICENSES).fetchall()) == sorted(map(tuple, got.values()))
    table = spark.createDataFrame([("Own", "My own terms.")], "license string, text string")
    assert licenses.scan(spark.createDataFrame([(1, "my OWN terms")], "doc_id long, text string"), licenses.known_digests(spark, table)).first()["license"] == "Own"


def test_toxicity_on_held_out_rows(spark):
    import random

    draw = random.Random(5)
    bad, fine = ["vile", "foul", "nasty"], [f"word{i}" for i in range(300)]
    rows = []
    for i in range(600):
        junk, toxic = i % 5 == 0, i % 3 == 0
        words = draw.choices(fine, k=40) + (draw.sample(bad, 2) if toxic else []) + (["%junk%"] if junk else [])
        draw.shuffle(words)
        rows.append((i, " ".join(words), int(junk), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (7, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[0] % 2], "doc_id long, junk int, toxic int")
    got = {r["id"]: r for r in toxicity.classify(docs, labels, ("junk", "toxic")).collect()}
    test = [r for r in rows if r[0] % 2 == 0]
    assert sum(got[r[0]]["toxic"] == bool(r[3]) for r in test) / len(test) > 0.95
    assert sum((got[r[0]]["p_junk"] > 0.5) == bool(r[2]) for r in test) / len(test) > 0.95
    none = toxicity.classify(docs, labels.limit(0), ("junk", "toxic")).collect()
    assert len(none) == 602 and not any(r["toxic"] for r in none)


def test_toxicity_fits_on_one_row_per_id(spark):
    rows = [(i, f"word{i} " + ("vile" if i % 3 == 0 else "fine")) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    many = spark.createDataFrame(rows + [rows[0]] * 300, "doc_id long, text string")
    got = [toxicity.train_chain(d, labels, ("toxic",))[0] for d in (once, many)]
    assert abs(got[0] - got[1]).max() < 1e-5


def test_toxicity_finds_one_word_in_long_texts(spark):
    """Held-out texts of 40 to 2,000 words, most words met in few texts, two telling words of twelve in a toxic one."""
    import random

    draw = random.Random(9)
    bad = [f"slur{i}" for i in range(12)]
    rows = []
    for i in range(1400):
        words = [f"w{int(draw.paretovariate(0.6)) % 60_000}" for _ in range(draw.choice([40, 200, 600, 2000]))]
        if i % 9 == 0:
            words += draw.sample(bad, 2)
        draw.shuffle(words)
        rows.append((i, " ".join(words), int(i % 7 == 0), int(i % 9 == 0)))
    docs = spark.createDataFrame([(*r[:2], 1.0, "x") for r in rows], "doc_id long, text string, p_toxic double, fold string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[0] % 2], "doc_id long, junk int, toxic int")
    got = {r["id"]: r["p_toxic"] for r in toxicity.classify(docs, labels, ("junk", "toxic")).collect()}
    test = [r for r in rows if r[0] % 2 == 0]
    clean = sorted(got[r[0]] for r in test if not r[3])
    cut = clean[int(0.9 * len(clean))]
    assert sum(got[r[0]] > cut for r in test if r[3]) / sum(r[3] for r in test) > 0.95
    assert toxicity.classify(docs.limit(0), labels, ("junk", "toxic")).count() == 0


@pytest.mark.parametrize("page,want", [
    ('<article><a name="top"><p>Some text of the article here.</p></article>', "Some text of the article here."),
    ('<article><h2><a name="s1">Head</h2><p>Body of it.</p></article>', "Head\n\nBody of it."),
    ("<article><p>Hi there all.</p><figure><pre>code x</pre><figcaption>Cap one.</figcaption></figure></article>", "Hi there all.\n\ncode x\n\nCap one."),
    ('<article><p>Words of it.</p><p>See <a href="x">the whole paper as it was</a>.</p><p>More.</p></article>', "Words of it.\n\nSee the whole paper as it was.\n\nMore."),
    ('<article><p>Text.</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></article>', "Text."),
    ('<article><p>Text with <a href="x">open link<p>Next paragraph is free.</article>', "Text with open link\n\nNext paragraph is free."),
    ("<article><p>" + "long words and more of the same, " * 20_000 + "</p></article>", ("long words and more of the same, " * 20_000).strip())])
def test_html_keeps_an_articles_own_text(page, want):
    assert html.main_text(page) == want


def test_quality_lets_a_long_line_mention_a_notice(spark):
    prose = " ".join(f"word{i}" for i in range(5000)) + " and the cookies of it."
    docs = spark.createDataFrame([(1, prose), (2, prose + "\nWe use cookies here."), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert got[1]["kept"] and got[1]["n_bad_lines"] == 0 and got[2]["kept"] and got[2]["n_bad_lines"] == 1 and not got[3]["kept"]


def test_licenses_under_any_title_and_holder_line(spark):
    """Every heading of a whole text, the holder in the line after the year, long texts, no rows."""
    by_name = {name: text for name, text in licenses.KNOWN if len(text) > 300 and not text.startswith(("MIT", "The MIT", "BSD"))}
    heads = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"],
             "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["The BSD 3-Clause License", "New BSD License"], "Zlib": ["zlib License"]}
    rows = []
    for name, own in heads.items():
        for head in own:
            for notice in ("", "Copyright (c) 2020\nJane Q. Doe <jane@example.org>\n\n", "(c) 2019-2021, ACME\n\n", "Copyright 2001, 2002\nExample Authors\n\n"):
                rows.append((len(rows), f"{head}\n\n{notice}{by_name[name]}", name))
                rows.append((len(rows), f"{notice}{head}\n\n{by_name[name]}", name))
    rows += [(len(rows), "MIT License", None), (len(rows) + 1, "a line of text\n" * 40_000 + "SPDX-License-Identifier: MIT", None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], "doc_id long, text string, mark string, digest int")
    got = {r["doc_id"]: r for r in licenses.scan(docs, licenses.known_digests(spark)).collect()}
    assert [(i, got[i]["license"]) for i, _, _ in rows] == [(i, name) for i, _, name in rows]
    assert got[len(rows) - 1]["notices"] == "MIT" and licenses.scan(docs.limit(0), licenses.known_digests(spark)).count() == 0
