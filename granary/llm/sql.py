"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from granary.llm import licences, line_dedup, multiset_hash

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 1 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh
  FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM e a JOIN e b ON a.g = b.g
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id,
       coalesce(component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c USING (doc_id)
"""


def line_dedup_sql(min_words: int = line_dedup.MIN_WORDS) -> str:
    """Maximal matches of all pairs of positions: equal lines on one diagonal without a gap."""
    return rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
  FROM documents WHERE text IS NOT NULL
), k AS (
  SELECT *, len(regexp_extract_all(value, '{line_dedup.WORD}')) AS words FROM l
), p AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS r FROM k WHERE words > 0
), pairs AS (
  SELECT b.doc_id, a.doc_id AS source, b.r - a.r AS shift, b.r, b.line, b.words
  FROM p a JOIN p b ON a.value = b.value AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.line < b.line)
), islands AS (
  SELECT *, r - row_number() OVER (PARTITION BY doc_id, source, shift ORDER BY r) AS island FROM pairs
), matches AS (
  SELECT doc_id, min(line) AS first, max(line) AS last FROM islands GROUP BY doc_id, source, shift, island HAVING sum(words) >= {min_words}
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS line FROM (SELECT DISTINCT doc_id, first, last FROM matches)
), marked AS (
  SELECT l.doc_id, l.line, l.value, g.line IS NOT NULL AS gone FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line
), runs AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY line), false) AS opens FROM marked
), texts AS (
  SELECT doc_id, coalesce(string_agg(value, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines,
         count(*) FILTER (WHERE gone) AS n_deleted_lines, count(*) FILTER (WHERE opens) AS n_runs
  FROM runs GROUP BY doc_id
)
SELECT d.doc_id, t.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted_lines, 0) AS n_deleted_lines, coalesce(n_runs, 0) AS n_runs
FROM documents d LEFT JOIN texts t USING (doc_id)
"""


def multiset_hash_sql() -> str:
    m = multiset_hash
    number = lambda text, start, n: f"CAST('0x' || substr({text}, {start}, {n}) AS BIGINT)"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), n AS (
  SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM d WINDOW w AS (ORDER BY doc_id DESC)
), e AS (
  SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM n
), t AS (
  SELECT doc_id, 0 AS which, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e
), grid AS (
  SELECT doc_id, which, l AS level, x AS lane FROM t, range({m.LEVELS}) AS a(l), range({m.LANES}) AS b(x)
), p AS (
  SELECT doc_id, which, unnest(string_split(text, chr(10))) AS p FROM t
), digests AS (
  SELECT doc_id, which, {" || ".join(f"sha256('{k}' || p)" for k in range(m.HALVES))} AS h FROM p
), dense AS (
  SELECT doc_id, which, string_agg(format('{{:0{m.DENSE_BITS // 4}x}}', v), '' ORDER BY i) AS digits
  FROM (SELECT doc_id, which, i, CAST(sum({number("h", "1 + 8 * i", 8)}) % {1 << m.DENSE_BITS} AS BIGINT) AS v FROM digests, range({m.DENSE}) AS r(i) GROUP BY doc_id, which, i) GROUP BY doc_id, which
), s AS (
  SELECT doc_id, which, unnest(string_split(replace(text, '. ', chr(10)), chr(10))) AS s FROM t
), placed AS (
  SELECT doc_id, which, {number("md5(s)", 1, 12)} AS h, h % {m.LANES} AS lane, h // {m.LANES} % 255 + 1 AS value, h // {m.LANES * 255} % {1 << (m.LEVELS - 1)} AS code,
         CASE WHEN code = 0 THEN {m.LEVELS - 1} ELSE {m.LEVELS - 1} - length(bin(code)) END AS level FROM s
), counts AS (
  SELECT doc_id, which, count(*) AS n FROM placed GROUP BY doc_id, which
), sums AS (
  SELECT doc_id, which, level, lane, sum(value) % 256 AS v FROM placed GROUP BY ALL
), lanes AS (
  SELECT g.doc_id, g.which, g.level, g.lane, CAST(coalesce(v, 0) AS BIGINT) AS v FROM grid g LEFT JOIN sums s ON g.doc_id = s.doc_id AND g.which = s.which AND g.level = s.level AND g.lane = s.lane
), words AS (
  SELECT doc_id, which, level, lane // {m.PACKED} AS word, CAST(sum(v * (1::BIGINT << CAST(8 * (lane % {m.PACKED}) AS INTEGER))) AS BIGINT) AS v FROM lanes GROUP BY ALL
), strata AS (
  SELECT doc_id, which, string_agg(format('{{:0{2 * m.PACKED}x}}', v), '' ORDER BY level, word) AS digits FROM words GROUP BY doc_id, which
), f AS (
  SELECT doc_id, which, dense.digits || strata.digits || format('{{:0{m.COUNT_BITS // 4}x}}', n) AS fingerprint, n FROM dense JOIN strata USING (doc_id, which) JOIN counts USING (doc_id, which)
), sides AS (
  SELECT doc_id, 1 AS side, doc_id AS other, 1 AS which FROM e UNION ALL SELECT doc_id, 0, next_id, 0 FROM e
), differ AS (
  SELECT x.doc_id, x.side, a.level, count(*) FILTER (WHERE a.v <> b.v) AS d
  FROM sides x JOIN lanes a ON a.doc_id = x.doc_id AND a.which = 0 JOIN lanes b ON b.doc_id = x.other AND b.which = x.which AND a.level = b.level AND a.lane = b.lane
  GROUP BY x.doc_id, x.side, a.level
), firsts AS (
  SELECT doc_id, side, least(max(CASE WHEN d > {m.FULL} THEN level + 1 ELSE 0 END), {m.LEVELS - 1}) AS first FROM differ GROUP BY doc_id, side
), apart AS (
  SELECT doc_id, side, sum(ln(1 - least(CAST(d AS DOUBLE), {m.LANES - 0.5}::DOUBLE) / {m.LANES}) / ln(1 - CAST(1 AS DOUBLE) / {m.LANES}) ORDER BY level) * pow(2.0::DOUBLE, any_value(first)) AS apart
  FROM differ JOIN firsts USING (doc_id, side) WHERE level >= first GROUP BY doc_id, side
), near AS (
  SELECT x.doc_id, x.side, CASE WHEN a.fingerprint = b.fingerprint THEN 1.0::DOUBLE ELSE least(0.999999::DOUBLE, round(greatest(0.0::DOUBLE, (a.n + b.n - apart) / (a.n + b.n + apart)), 6)) END AS near
  FROM sides x JOIN f a ON a.doc_id = x.doc_id AND a.which = 0 JOIN f b ON b.doc_id = x.other AND b.which = x.which JOIN apart p ON p.doc_id = x.doc_id AND p.side = x.side
)
SELECT e.doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, own.fingerprint AS fingerprint, changed.fingerprint AS edited_fingerprint, x.near AS near_edited, y.near AS near_next
FROM e JOIN f own ON own.doc_id = e.doc_id AND own.which = 0 JOIN f changed ON changed.doc_id = e.doc_id AND changed.which = 1
JOIN near x ON x.doc_id = e.doc_id AND x.side = 1 JOIN near y ON y.doc_id = e.doc_id AND y.side = 0
"""


def licence_sql() -> str:
    # From each line of a piece on, what is known there; words may stand on several lines.
    known = "(?:" + "|".join(licences.wrapped(p) for _, p in licences.SENTENCES) + ")"
    cases = " ".join(f"WHEN regexp_matches(x, '{pattern}') THEN '{name}'" for name, pattern in licences.SENTENCES)
    steps, last = [], "r0"
    for k, (name, ids) in enumerate(licences.RULES, 1):
        token = "".join(f",{i}," for i in ids)
        steps.append(f"r{k} AS (SELECT doc_id, sentence_ids, replace(rest, '{token}', '') AS rest, CASE WHEN contains(rest, '{token}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM {last})")
        last = f"r{k}"
    hint = licences.HINT.replace(" ", r"\W+")
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), stops AS (
  SELECT doc_id, regexp_replace(regexp_replace(text, '\b([vV])\. ', '\1 ', 'g'), '[.!?][ \t\r\n]+', chr(10) || chr(10), 'g') AS t FROM d WHERE regexp_matches(text, '(?i){hint}')
), plain AS (
  SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(t, ';[ \t\r]+([^ \t\r\n])', chr(10) || '\1', 'g')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), '(?m)^ ?(?:dnl|rem)(?: |$)', '', 'g') AS t FROM stops
), pieces AS (
  SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT doc_id, regexp_split_to_array(t, '\n[ \n]*\n') AS ps FROM plain)
), lines AS (
  SELECT doc_id, k, string_split(trim(regexp_replace(p, ' ?\n ?', chr(10), 'g'), ' ' || chr(10)), chr(10)) AS ls FROM pieces
), heads AS (
  SELECT doc_id, k, i, regexp_extract(array_to_string(ls[i:], chr(10)), '^{known}') AS x FROM lines, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)
), found AS (
  SELECT *, coalesce(lag(x) OVER (PARTITION BY doc_id, k ORDER BY i), '') AS before FROM heads WHERE x <> ''
), ids AS (
  SELECT doc_id, list(CASE {cases} END ORDER BY k, i) AS ids FROM (SELECT doc_id, k, i, replace(x, chr(10), ' ') AS x FROM found WHERE NOT ends_with(before, chr(10) || x)) GROUP BY doc_id
), i AS (
  SELECT d.doc_id, coalesce(list_filter(ids, lambda x: x IS NOT NULL), []) AS ids FROM d LEFT JOIN ids USING (doc_id)
), r0 AS (
  SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_transform(ids, lambda x: ',' || x || ','), '') AS rest, CAST([] AS VARCHAR[]) AS found FROM i
), {", ".join(steps)}
SELECT doc_id, CAST(CASE WHEN sentence_ids = '' THEN 0 ELSE len(string_split(sentence_ids, ',')) END AS BIGINT) AS n_sentences, sentence_ids,
       array_to_string(found, ',') AS licences, trim(replace(rest, ',,', ','), ',') AS unmatched
FROM {last}
"""


#: Words by pattern, their checksum bit by bit, gains and noise as they are defined, ranks over all scores.
RESAMPLING = r"""
WITH steps AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
texts AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT row, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
target AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
counts AS (SELECT row, w, count(*) AS n FROM (SELECT row, unnest(ws) AS w FROM words) GROUP BY row, w),
known AS (SELECT DISTINCT w FROM counts UNION SELECT DISTINCT w FROM target),
hexes AS (SELECT w, hex(encode(w)) AS h FROM known),
buckets AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexes, steps),
s AS (SELECT bucket, sum(n) AS n FROM counts JOIN buckets USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN buckets USING (w) GROUP BY bucket),
gains AS (SELECT i AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
sums AS (SELECT row, sum(n * gain) AS total FROM counts JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY row),
weights AS (SELECT doc_id, len(ws) AS n_features, CASE WHEN len(ws) > 0 THEN floor(total / len(ws)) ELSE 0 END::BIGINT AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM words LEFT JOIN sums USING (row)),
scores AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM weights),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS nth, count(*) OVER (PARTITION BY n_features >= 20) AS of FROM scores)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= 20 AND nth <= floor(10 * of / 100) THEN nth END AS rank FROM ranked
"""
