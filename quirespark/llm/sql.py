"""DuckDB SQL for the rows of the queries that SQL can express."""

OP9 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""

OP10 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS turn FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sums),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed WINDOW o AS (ORDER BY (2 * source_size)::DOUBLE / weight, source NULLS LAST)),
targets AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
queued AS (
  SELECT doc_id, size, turn, source_size, target,
         sum(size) OVER (PARTITION BY s.source ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
items AS (
  SELECT doc_id, size, turn, pass, (upto + source_size * pass)::DOUBLE / target AS finish
  FROM queued CROSS JOIN (VALUES (0), (1)) p(pass) WHERE size > 0),
run AS (SELECT *, sum(size) OVER (ORDER BY finish, turn, doc_id, pass ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM items),
took AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM run WHERE used <= (SELECT sum(source_size) * 1.5::DOUBLE FROM sums) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM queued LEFT JOIN took USING (doc_id)
"""


OP2 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS d FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM q)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM r
"""


#: What the licence query's SQL knows: whole sentences on lines of their own, and rules.
SENTENCES = (
    ("a", "licensed under the apache license version 2.0"),
    ("b", "you may not use this file except in compliance with the license"),
    ("c", "you may obtain a copy of the license at http www.apache.org licenses license-2.0"),
    ("g", "this work is licensed under the gnu general public license version 3"),
    ("h", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("i", "see the gnu general public license for more details"),
    ("m", "released under the mit license"),
    ("n", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("o", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("p", "the software is provided as is without warranty of any kind"),
    ("q", "licensed under cc by-nc 4.0"),
    ("r", "licensed under cc by 4.0"),
    ("s", "licensed under cc by-sa 4.0"),
    ("t", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("u", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("w", "all rights reserved"),
)

RULES = (
    ("MIT", "w*nw*ow*p"),
    ("MIT", "m|no?|op"),
    ("Apache-2.0", "w*abc|w*bc|a|c"),
    ("BSD-3-Clause", "w*t+u+"),
    ("BSD-2-Clause", "w*t"),
    ("GPL-3.0-only", "gi?"),
    ("GPL-1.0-or-later", "hi?"),
    ("CC-BY-NC-4.0", "q"),
    ("CC-BY-SA-4.0", "s"),
    ("CC-BY-4.0", "r"),
    ("Proprietary", "w"),
)

#: A stop counts before white space, so a version's "2.0" is whole.
ENDS = r"[.!?;:]+(?:[\x{9}-\x{D}\x{20}]|$)|\x{A}+"
OTHER = r"[^a-z0-9.\-]+"
#: A sentence that ends in a known one, the longest first.
KNOWN = "(?:^| )(" + "|".join(s.replace(".", "[.]") for _, s in sorted(SENTENCES, key=lambda e: -len(e[1]))) + ")$"


def license_sql() -> str:
    """The sentence map and the rules, each over what the rules before have left."""
    ids = " ".join(f"WHEN '{s}' THEN '{i}'" for i, s in SENTENCES)
    one = f"CASE regexp_extract(trim(regexp_replace(x, '{OTHER}', ' ', 'g'), ' '), '{KNOWN}', 1) {ids} ELSE '' END"
    step = f"SELECT doc_id, array_to_string(list_transform(string_split_regex(lower(coalesce(text, '')), '{ENDS}'), lambda x: {one}), '') AS sentence_ids FROM documents"
    step = f"SELECT *, sentence_ids AS rest, []::VARCHAR[] AS names, 0::BIGINT AS n FROM ({step}) s"
    for name, pattern in RULES:
        hits = f"len(regexp_extract_all(rest, '{pattern}'))"
        step = f"SELECT doc_id, sentence_ids, regexp_replace(rest, '{pattern}', '-', 'g') AS rest, CASE WHEN {hits} > 0 AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names, n + {hits} AS n FROM ({step}) r"
    return f"SELECT doc_id, sentence_ids, array_to_string(names, ',') AS licenses, n AS n_matches FROM ({step}) r"


OP11 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
rows AS (SELECT *, row_number() OVER () AS row_no FROM t),
windows AS (
  SELECT row_no, i, array_to_string(w[i:i + 7], ' ') AS eight FROM (SELECT row_no, w, unnest(range(1, len(w) - 6)) AS i FROM rows WHERE len(w) >= 8)),
twice AS (SELECT row_no, i FROM windows QUALIFY count(*) OVER (PARTITION BY row_no, eight) > 1),
repeats AS (SELECT row_no, count(DISTINCT i + k) AS n FROM twice CROSS JOIN range(8) o(k) GROUP BY row_no),
lines AS (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM rows),
dups AS (
  SELECT row_no, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_no),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines,
         coalesce(d.n_lines, 0) AS n_lines, coalesce(p.n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters
  FROM rows LEFT JOIN dups d USING (row_no) LEFT JOIN repeats p USING (row_no)),
bits AS (
  SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (100 * n_symbols > 10 * n_words)::BIGINT
         + 8 * (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT + 16 * (10 * word_chars < 25 * n_words)::BIGINT
         + 32 * (word_chars > 20 * n_words)::BIGINT + 64 * (100 * n_letter_words < 70 * n_words)::BIGINT + 128 * (100 * n_stutters > 30 * n_words)::BIGINT AS bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, bits FROM bits
"""

OP12 = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words CROSS JOIN (VALUES (1), (2), (3)) s(k)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
kept AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c AS x WHERE x.lang = c.lang AND x.k > c.k AND 100 * x.a >= 50 * c.a AND (array_to_string(x.w[1:2], ' ') = c.phrase OR array_to_string(x.w[2:3], ' ') = c.phrase))),
cuts AS (
  SELECT c.*, s.cut, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM kept c JOIN (VALUES (1), (2)) s(cut) ON s.cut < c.k
  JOIN f l ON l.lang = c.lang AND l.k = s.cut AND l.phrase = array_to_string(c.w[1:s.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.k = c.k - s.cut AND r.phrase = array_to_string(c.w[s.cut + 1:c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN n USING (lang) QUALIFY rank <= 2000
"""

OP13 = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flags AS (
  SELECT t.doc_id, part, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails,
         coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM t LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
counts AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags GROUP BY part, fails),
f(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM orders CROSS JOIN range(1, 6) s(step)),
each AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS failed,
         before <> '' AND regexp_matches(fails, '[' || CASE before WHEN '' THEN '-' ELSE before END || ']') AS gone
  FROM counts CROSS JOIN steps),
rows AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (failed AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (failed AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (failed AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (failed AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM each GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM rows
"""


def oracle_sql():
    return {"op2_warc": OP2, "op7_license_scan": license_sql(), "op9_exact_dedup": OP9, "op10_mixing": OP10, "op11_quality_rules": OP11, "op12_phrase_mining": OP12, "op13_filter_audit": OP13}
