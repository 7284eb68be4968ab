"""DuckDB SQL that gives the rows of the queries."""

from __future__ import annotations

from tidewatch.llm import licenses, lines, mixing, quality, warc

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
HAS_WORD = r"regexp_matches({}, '[^\x20\x09-\x0D]')"


def _quality() -> str:
    r = quality.LineRules()
    ends = "".join("''" if c == "'" else c for c in quality.ENDS)
    phrases = "|".join(r.phrases)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, {WORDS.format("text")} AS words FROM d),
win AS (SELECT rid, i, words[i] || chr(31) || words[i+1] || chr(31) || words[i+2] AS s
        FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (
          SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (
            SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, line, {HAS_WORD.format("line")} AS worded,
        length(line) - length(replace(line, ' ', '')) + 1 AS nw,
        regexp_replace(line, '[^{quality.MARKS}]+', '', 'g') AS marks,
        right(rtrim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)), 1) AS last
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)),
j AS (SELECT rid, line, worded, NOT worded OR (
        ((last <> '' AND instr('{ends}', last) > 0) OR (length(line) >= {r.prose_chars} AND contains(line, '. ')))
        AND (marks = '' OR (length(marks) <= nw * {r.max_marks} AND NOT (
              length(regexp_replace(marks, '[^{quality.SEPARATORS}]+', '', 'g')) >= {r.min_separators}
              AND length(regexp_replace(marks, '[^{quality.SEPARATORS}]+', '', 'g')) * {r.words_per_separator} >= nw)))
        AND NOT (regexp_matches(lower(line), '\b(?:{phrases})')
          AND len(regexp_extract_all(lower(line), '\b(?:{phrases})')) * {r.words_per_phrase} >= nw)) AS good FROM l),
g AS (SELECT rid, count(*) FILTER (NOT good) AS n_bad_lines, sum(length(line)) AS chars,
        coalesce(sum(length(line)) FILTER (NOT good), 0) AS lost,
        count(*) FILTER (worded) - count(DISTINCT line) FILTER (worded) AS n_dup_lines FROM j GROUP BY rid),
b AS (SELECT d.rid, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(rep.n, 0) AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words) AND NOT lost > chars * {r.max_lost} AS kept,
  n_bad_lines
FROM b JOIN g USING (rid)"""


QUALITY = _quality()

LINES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, doc_id, coalesce('s' || source, 'n') AS site, i, lines[i] AS line
      FROM (SELECT rid, doc_id, source, lines, unnest(range(1, len(lines) + 1)) AS i
            FROM (SELECT rid, doc_id, source, string_split(text, chr(10)) AS lines FROM d))),
bad AS (SELECT line FROM l WHERE {HAS_WORD.format("line")} GROUP BY line HAVING count(DISTINCT site) >= {lines.MIN_SITES}),
f AS (SELECT l.*, bad.line IS NOT NULL AND row_number() OVER (PARTITION BY l.line ORDER BY doc_id, i) > 1 AS gone
      FROM l LEFT JOIN bad USING (line)),
g AS (SELECT rid, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
      FROM f GROUP BY rid)
SELECT doc_id, n_removed, length(g.text) AS n_chars, g.text FROM d JOIN g USING (rid)"""

_UNIT = "(('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0)"

MIXING = f"""
WITH s AS (SELECT source, count(*) AS n, sum(n_chars)::DOUBLE AS size FROM documents GROUP BY source),
r AS (SELECT source, pow(size, 0.5) * sum(size) OVER () / sum(pow(size, 0.5)) OVER () / size AS rate FROM s),
q AS (SELECT source, greatest(ceil(rate / {mixing.LARGEST_STEP}), 1)::INT AS steps, rate / greatest(ceil(rate / {mixing.LARGEST_STEP}), 1) AS mean FROM r),
c AS (SELECT source, steps, list(p ORDER BY k) AS cdf FROM (
        SELECT source, steps, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
        FROM q, (SELECT unnest(range(0, 200)) AS k)) WHERE p < 1 - 1e-15 GROUP BY source, steps),
e AS (SELECT d.*, cdf, unnest(range(1, steps + 1)) AS step FROM documents d JOIN c USING (source)),
n AS (SELECT doc_id, text, lang, source, n_chars,
        sum(len(list_filter(cdf, lambda p: p <= {_UNIT.format("'42|' || doc_id || '|' || step")})))::BIGINT AS copies
      FROM e GROUP BY ALL),
x AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INT AS replica FROM n)
SELECT *, {_UNIT.format("'42 order|' || doc_id || '|' || replica")} AS shuffle_key FROM x"""

_RUNS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_RUNS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_RUNS.format(LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS s
       FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
hit AS (SELECT rid, i, dw.size, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.size = bw.size),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hit) GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS items
      FROM (SELECT DISTINCT rid, item_id::VARCHAR AS t FROM hit) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)"""


def _licenses() -> str:
    line = "trim(regexp_replace(line, '{}', ' ', 'g'))".format(licenses.PUNCTUATION)
    for other, usual in licenses.SPELLINGS:
        line = f"replace({line}, '{other}', '{usual}')"
    known = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.KNOWN)
    holder = f"regexp_matches(prev, '{licenses.NO_HOLDER}') AND regexp_matches(line, '{licenses.HOLDER}') AND NOT regexp_matches(line, '{licenses.NOT_HOLDER}')"
    canonical = f"CASE WHEN regexp_matches(line, '{licenses.COPYRIGHT}') OR coalesce({holder}, false) THEN '' ELSE {line} END"
    titles = ", ".join(f"'{t}'" for t in licenses.TITLES)
    lines = "SELECT {0}, unnest(l) AS line, unnest(range(len(l))) AS i, unnest([NULL] || l[:-2]) AS prev FROM (SELECT {0}, string_split(lower(text), chr(10)) AS l FROM {1})"
    whole = f"sha256(array_to_string(CASE WHEN list_contains([{titles}], cs[1]) THEN cs[2:] ELSE cs END, ' '))"
    return rf"""
WITH kl AS (SELECT rid, license, list(c ORDER BY i) AS cs FROM (SELECT rid, license, i, {canonical} AS c FROM (
       {lines.format('rid, license', f"(SELECT row_number() OVER () AS rid, license, text FROM (VALUES {known}) v(license, text))")})) WHERE c <> '' GROUP BY rid, license),
k AS (SELECT digest, min(license) AS license FROM (SELECT license, {whole} AS digest FROM kl) GROUP BY digest),
kn AS (SELECT c, min(license) AS license FROM (SELECT license, array_to_string(cs, ' ') AS c FROM kl) GROUP BY c),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, i, {canonical} AS c FROM ({lines.format('rid', 'd')})),
w AS (SELECT rid, {whole} AS digest FROM (SELECT rid, list(c ORDER BY i) AS cs FROM l WHERE c <> '' GROUP BY rid)),
n AS (SELECT rid, string_agg(license, ',' ORDER BY license) AS notices FROM (
        SELECT DISTINCT rid, license FROM l JOIN kn USING (c) WHERE c <> '') GROUP BY rid)
SELECT doc_id, coalesce(w.digest, sha256('')) AS digest, license, coalesce(notices, '') AS notices
FROM d LEFT JOIN w USING (rid) LEFT JOIN k ON k.digest = coalesce(w.digest, sha256('')) LEFT JOIN n USING (rid)"""


LICENSES = _licenses()

NEGATIVES = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM r a, r b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""

TRIE = rf"""
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || list_transform(range(8), lambda k: k),
        lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS v FROM range(256) r(i))),
ids AS (SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 20 AS b, xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(s) + 1),
        lambda j: ascii(s[j])::BIGINT), lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)]))) % 4 AS h FROM ids, tab),
t AS (SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS rn
      FROM (SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS digest, len({WORDS.format("text")}) AS words
            FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations))),
r AS (SELECT c, digest, words, row_number() OVER (PARTITION BY c ORDER BY src, rn) AS depth FROM (
        SELECT c, digest, words, 0 AS src, rn FROM convs JOIN t ON t.conv_id = b AND rn <= h
        UNION ALL SELECT c, digest, words, 1, rn FROM convs JOIN t ON t.conv_id = c AND rn > h)),
p AS (SELECT c, depth, words, string_agg(digest, '') OVER (PARTITION BY c ORDER BY depth) AS name,
        depth = max(depth) OVER (PARTITION BY c) AS last FROM r
      UNION ALL SELECT c, 0, 0, '', c NOT IN (SELECT c FROM r) FROM convs),
n AS (SELECT depth, name, min(c) AS c, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c)
        FILTER (last), '')) AS ends_sha256 FROM p GROUP BY depth, name),
k AS (SELECT p.depth, p.name, count(*) AS n_children FROM n JOIN p ON p.c = n.c AND p.depth = n.depth - 1 GROUP BY ALL),
s AS (SELECT p.depth, p.name, sum((k.n_children IS NULL)::BIGINT) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
      FROM n LEFT JOIN k USING (depth, name) JOIN p ON p.c = n.c AND p.depth <= n.depth GROUP BY ALL),
up AS (SELECT n.c, n.depth, m.c AS parent_conv_id FROM n JOIN p ON p.c = n.c AND p.depth = n.depth - 1 JOIN n m ON m.depth = p.depth AND m.name = p.name)
SELECT n.c AS conv_id, n.depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM n LEFT JOIN k USING (depth, name) JOIN s USING (depth, name) LEFT JOIN up ON up.c = n.c AND up.depth = n.depth
"""

WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
        lambda s: '{warc.BASE32}'[1 + ((('0x' || h[5 * i + 1:5 * i + 5])::BIGINT >> s) & 31)]), '')), '') AS payload_digest,
        min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to FROM d
"""
