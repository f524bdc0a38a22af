"""Statements that give the same rows in SQL, where SQL can express a query."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
 line AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
 keyed AS (SELECT *, trim(translate(line, '{UPPER}', '{LOWER}'), {WHITE}) AS key FROM line),
 gone AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
 marked AS (SELECT k.doc_id, k.pos, k.line, g.key IS NOT NULL AND k.doc_id <> g.last AS dropped
  FROM keyed k LEFT JOIN gone g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

MIXING = f"""
WITH sized AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5(doc_id::VARCHAR || ':' || md5(coalesce(text, ''))) AS place FROM documents),
 sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
 weighed AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight FROM sources),
 levels AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
  coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
  sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM weighed),
 lines AS (SELECT *, (budget - given) / rest AS level FROM levels),
 shares AS (SELECT *, (SELECT level FROM lines WHERE level * weight <= 2 * source_size ORDER BY given LIMIT 1) AS share FROM lines),
 goals AS (SELECT source, source_size, budget, least(coalesce(share * weight, 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size) AS target FROM shares),
 sent AS (SELECT s.*, g.source_size, g.target, g.budget, sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS sent
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
 passes AS (SELECT *, 0 AS pass, sent / target AS finish FROM sent UNION ALL SELECT *, 1, (sent + source_size) / target FROM sent),
 queue AS (SELECT *, sum(size) OVER (ORDER BY finish, source, place, doc_id, pass ROWS UNBOUNDED PRECEDING) AS used FROM passes)
SELECT doc_id, size, source_size, target, (count(*) FILTER (WHERE used <= budget) * size)::BIGINT AS taken
FROM queue GROUP BY doc_id, size, source_size, target"""

BENCH_WORDS = f"regexp_extract_all({FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH item AS (SELECT item_id::VARCHAR AS item_id, {BENCH_WORDS} AS w FROM benchmark),
 win AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS key
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
 doc AS (SELECT doc_id, {BENCH_WORDS} AS w FROM documents),
 gram AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS key
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
 hit AS (SELECT g.doc_id, g.i, g.size, v.item_id FROM gram g JOIN win v ON g.key = v.key AND g.size = v.size),
 covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
 named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
 sha256(coalesce(n.names, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM doc d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id"""

SUBSTRINGS = f"""
WITH doc AS (SELECT doc_id, {WORDS} AS w FROM documents),
 win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM doc WHERE len(w) >= 50)),
 first AS (SELECT key, min(doc_id) AS doc_id FROM win GROUP BY key),
 gone AS (SELECT DISTINCT doc_id, p FROM (SELECT v.doc_id, unnest(range(v.i, v.i + 50)) AS p FROM win v JOIN first f ON v.key = f.key WHERE v.doc_id > f.doc_id)),
 word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM doc),
 kept AS (SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.p) AS left_over FROM word k LEFT JOIN gone g ON k.doc_id = g.doc_id AND k.p = g.p WHERE g.p IS NULL GROUP BY k.doc_id),
 lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(l.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.left_over, '')) AS kept_sha256
FROM doc d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN lost l ON d.doc_id = l.doc_id"""

NGRAM_JOIN = f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
 size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
 common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
 link AS (SELECT a, b FROM common JOIN size p ON a = p.doc_id JOIN size q ON b = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
 reach AS (SELECT doc_id, doc_id AS r FROM doc UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(r.r) AS component_id
FROM doc d LEFT JOIN size s ON d.doc_id = s.doc_id JOIN reach r ON d.doc_id = r.doc_id GROUP BY d.doc_id, s.n"""

_MEASURES = {
    "symbol_rate": ("(n_symbols + 1) * 1000000 // word_chars", 2),
    "dup_line_rate": ("(n_dup_lines + 1) * 1000000 // n_words", 3),
    "mean_chars": ("word_chars * 1000 // n_words", 5),
}


def _quartiles(name: str, keys: str) -> str:
    """First and third quartile of merged sketches: where the bucket begins at which a quarter has been seen, and the one of three quarters ends."""
    by = f"{keys}, " if keys else ""
    end = "min(bucket + (1::BIGINT << greatest(length(bin(bucket)) - 8, 0)) - 1)"
    return (
        f"{name} AS (SELECT {by}measure, max(n) AS n, (min(bucket) FILTER (WHERE seen * 4 >= n))::DOUBLE AS q1, ({end} FILTER (WHERE seen * 4 >= n * 3))::DOUBLE AS q3 FROM "
        f"(SELECT {by}measure, bucket, sum(sum(c)) OVER (PARTITION BY {by}measure ORDER BY bucket) AS seen, sum(sum(c)) OVER (PARTITION BY {by}measure) AS n FROM sketch GROUP BY {by}measure, bucket) GROUP BY {by}measure)"
    )


QUALITY = (
    f"""
WITH doc AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
 win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, md5(array_to_string(w[i:i + 7], ' '))) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM doc WHERE len(w) >= 8)),
 rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win WHERE c > 1) GROUP BY doc_id),
 counted AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM doc d LEFT JOIN rep ON d.doc_id = rep.doc_id),
 rows AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, """
    + ", ".join(f"CASE WHEN n_words > 0 THEN greatest({e}, 1) END AS {m}" for m, (e, _) in _MEASURES.items())
    + """ FROM counted),
 long AS ("""
    + " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM rows WHERE NOT base_failed" for m in _MEASURES)
    + """),
 sketch AS (SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0) AS bucket, count(*) AS c FROM long GROUP BY 1, 2, 3, 4),
 """
    + ", ".join([_quartiles("own", "lang, source"), _quartiles("per_lang", "lang"), _quartiles("of_all", "")])
    + """,
 picked AS (SELECT o.lang, o.source, o.measure, CASE WHEN o.n >= 100 THEN o.q1 WHEN p.n >= 100 THEN p.q1 ELSE g.q1 END AS q1, CASE WHEN o.n >= 100 THEN o.q3 WHEN p.n >= 100 THEN p.q3 ELSE g.q3 END AS q3
  FROM own o JOIN per_lang p ON o.lang IS NOT DISTINCT FROM p.lang AND o.measure = p.measure JOIN of_all g ON o.measure = g.measure),
 ratio AS (SELECT *, q3 / q1 AS r FROM picked),
 fence AS (SELECT lang, source, """
    + ", ".join(f"max(q3 * ({' * '.join(['r'] * reach)})) FILTER (WHERE measure = '{m}') AS most_{m}" for m, (_, reach) in _MEASURES.items())
    + """, max(q1 / (r * r * r * r * r)) FILTER (WHERE measure = 'mean_chars') AS least FROM ratio GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(mean_chars >= least AND """
    + " AND ".join(f"{m} <= most_{m}" for m in _MEASURES)
    + """, true) AS kept
FROM rows r LEFT JOIN fence f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source"""
)

FEATURES = f"regexp_extract_all({FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: CRC-32 of a word: eight shifts for each byte of its UTF-8 form, by a table of 256 entries.
RESAMPLE = f"""
WITH crc_table AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(0, 256) AS r(n)),
 doc AS (SELECT doc_id, {FEATURES} AS w FROM documents),
 item AS (SELECT {FEATURES} AS w FROM benchmark),
 seen AS (SELECT doc_id, unnest(w) AS word FROM doc),
 wanted AS (SELECT unnest(w) AS word FROM item),
 spelled AS (SELECT word, hex(word) AS h FROM (SELECT word FROM seen UNION SELECT word FROM wanted)),
 hashed AS (SELECT word, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM spelled, crc_table),
 source AS (SELECT bucket, count(*) AS s FROM seen JOIN hashed USING (word) GROUP BY bucket),
 target AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (word) GROUP BY bucket),
 totals AS (SELECT (SELECT count(*) FROM seen) AS s_all, (SELECT count(*) FROM wanted) AS t_all),
 gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS g FROM source LEFT JOIN target USING (bucket), totals),
 weighed AS (SELECT doc_id, count(*) AS n, sum(g)::HUGEINT AS total FROM seen JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
 scored AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_features, (CASE WHEN n IS NULL THEN 0 WHEN ((total % n) + n) % n = 0 THEN total // n WHEN total < 0 THEN -((-total) // n) - 1 ELSE total // n END)::BIGINT AS weight,
  ('0x' || left(sha256('2024:' || d.doc_id), 8))::BIGINT AS h FROM doc d LEFT JOIN weighed v ON d.doc_id = v.doc_id),
 final AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
 places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM final WHERE n_features >= 20)
SELECT f.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM final f LEFT JOIN places p ON f.doc_id = p.doc_id"""

FILTER_AUDIT = f"""
WITH doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
 first AS (SELECT t, min(doc_id) AS low FROM doc GROUP BY t),
 said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
 failed AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > low THEN 'E' ELSE '' END AS f
  FROM doc d JOIN first USING (t) LEFT JOIN said s ON d.doc_id = s.doc_id),
 mask AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, f),
 letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 place AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, left(filter_order, step - 1) AS earlier FROM orders, range(1, 6) AS r(step)),
 counted AS (SELECT part, filter_order, step, own,
  coalesce(sum(n) FILTER (WHERE translate(f, earlier || own, '') = f), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE contains(f, own) AND translate(f, earlier, '') = f), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE contains(f, own) AND translate(f, earlier, '') <> f), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE f = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE contains(f, own) AND translate(f, earlier, '') = f), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE contains(f, own) AND translate(f, earlier, '') = f), 0)::BIGINT AS toxic_lost
  FROM mask, place GROUP BY part, filter_order, step, own)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted"""

ORACLES = {
    "op2_line_dedup": LINE_DEDUP,
    "op4_ngram_join": NGRAM_JOIN,
    "op5_quality": QUALITY,
    "op6_mixing": MIXING,
    "op7_decontamination": DECONTAMINATION,
    "op9_substring_dedup": SUBSTRINGS,
    "op12_resample": RESAMPLE,
    "op13_filter_audit": FILTER_AUDIT,
}
