"""Results of the operators in DuckDB SQL, for those that SQL can express."""

#: The three-word windows of the words ``w``: covered words are those in a window met twice or more.
_QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS o(k) GROUP BY 1),
m AS (
  SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN covered c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN lang ELSE 'other' END AS stratum FROM m),
f AS (SELECT doc_id, stratum, r.rule, r.x, base_failed FROM b, LATERAL (
        SELECT unnest(['symbols', 'dup_lines', 'repeats', 'long_words', 'short_words']) AS rule,
               unnest(CASE WHEN n_words = 0 THEN [NULL, NULL, NULL, NULL, NULL]
                      ELSE [1000 * n_symbols // n_words, 1000 * n_dup_lines // n_lines, 1000 * n_repeat_words // n_words,
                            1000 * word_chars // n_words, -(1000 * word_chars // n_words)] END) AS x) r),
cuts AS (SELECT rule, unnest(c) AS cut, generate_subscripts(c, 1) AS step FROM (VALUES
  ('symbols', [3000, 2500, 2000, 1500, 1000, 700, 500, 400, 300, 200, 150, 100, 50]),
  ('dup_lines', [900, 800, 700, 600, 500, 450, 400, 350, 300]),
  ('repeats', [500, 450, 400, 350, 300, 250, 200]),
  ('long_words', [20000, 15000, 12000, 10000, 9000, 8000, 7500, 7000]),
  ('short_words', [-1500, -2000, -2500, -3000, -3500, -3800])) v(rule, c)),
good AS (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) = 1),
held AS (SELECT stratum, f.rule, cut, step, count(*) AS n, count(*) FILTER (x > cut) AS k
         FROM f JOIN good USING (doc_id) JOIN cuts USING (rule) WHERE NOT base_failed GROUP BY 1, 2, 3, 4),
tested AS (SELECT *, k < n * 0.02 AND list_sum(list_transform(range(0, k + 1),
             lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln(0.02) + (n - j) * ln(0.98))))
             <= 0.05 / 25 AS good_cut FROM held),
walked AS (SELECT *, bool_and(good_cut) OVER (PARTITION BY stratum, rule ORDER BY step) AS passed FROM tested),
chosen AS (SELECT stratum, rule, arg_max(cut, step) AS cut FROM walked WHERE passed GROUP BY 1, 2),
hits AS (SELECT doc_id, list(rule) AS rules FROM f JOIN chosen USING (stratum, rule) WHERE x > cut GROUP BY 1),
order_of AS (SELECT ['symbols', 'dup_lines', 'repeats', 'long_words', 'short_words'] AS o)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND h.doc_id IS NULL AS kept,
       coalesce(array_to_string(list_filter(o, lambda r: list_contains(h.rules, r)), ','), '') AS removed_by
FROM b CROSS JOIN order_of LEFT JOIN hits h USING (doc_id)
"""

#: Words by number, windows of up to ten of them, and the document words that an equal window covers.
_DECONTAMINATE = r"""
WITH fold AS (SELECT 'd' AS side, doc_id::VARCHAR AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
              FROM documents UNION ALL
              SELECT 'b', item_id::VARCHAR, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT side, id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM fold),
items AS (SELECT id, len(list_slice(w, i, i + 9)) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS g
          FROM w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) WHERE side = 'b' AND len(w) > 0),
sizes AS (SELECT DISTINCT n FROM items),
spots AS (SELECT w.id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
          FROM w, sizes, unnest(range(1, len(w) - n + 2)) u(i) WHERE side = 'd'),
met AS (SELECT s.id, s.i, s.n, b.id AS item FROM spots s JOIN items b USING (n, g)),
hits AS (SELECT id, count(DISTINCT i + k) AS n FROM met, unnest(range(0, n)) u(k) GROUP BY 1),
found AS (SELECT id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY 1)
SELECT w.id::BIGINT AS doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(f.n, 0)::BIGINT AS n_items,
       sha256(coalesce(f.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM w LEFT JOIN hits h USING (id) LEFT JOIN found f USING (id) WHERE w.side = 'd'
"""



def _crc32(number: str) -> str:
    """CRC-32 of a number's decimal text, bit by bit."""
    bits = "flatten(list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT] || [-1 FOR _ IN range(8)]))".format(number)
    step = "CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END"
    return f"xor(list_reduce([4294967295::BIGINT] || {bits}, lambda x, y: {step}), 4294967295)"


#: Equal five-word windows at distance q, in islands, are stretches of a run: every run has five such words in a row.
_RUNS = rf"""
WITH h AS (SELECT rowid_, doc_id, {_crc32("doc_id")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
           FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)),
g AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g FROM h),
k AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
d AS (SELECT rowid_, doc_id, n, CASE WHEN a IS NULL THEN w ELSE
        [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] FOR i IN range(n)] END AS w FROM k),
v AS (SELECT rowid_, n, i, hash(w[i + 1], w[i + 2], w[i + 3], w[i + 4], w[i + 5]) AS v FROM d, unnest(range(0, n - 4)) u(i)),
m AS (SELECT x.rowid_, y.i - x.i AS q, x.i FROM v x JOIN v y ON x.rowid_ = y.rowid_ AND x.v = y.v AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT rowid_, q, min(i) AS start, count(*) + 4 + q AS length
      FROM (SELECT *, i - row_number() OVER (PARTITION BY rowid_, q ORDER BY i) AS island FROM m) GROUP BY rowid_, q, island),
r AS (SELECT rowid_, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
t AS (SELECT rowid_, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
             first(start ORDER BY length DESC, start, period) AS start, first(period ORDER BY length DESC, start, period) AS period,
             max(length) AS length FROM r GROUP BY 1),
gone AS (SELECT DISTINCT rowid_, i FROM r, unnest(range(start + period, start + length)) u(i)),
c AS (SELECT rowid_, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT rowid_, w[i + 1] AS x, i FROM d, unnest(range(0, n)) u(i)) ANTI JOIN gone USING (rowid_, i)
      GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (rowid_) LEFT JOIN c USING (rowid_)
"""

#: A node is a list of turns from the first on; what is below it is met through the smallest member of every node.
_TRIE = rf"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS t,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
           FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, c - c % 5 AS base, {_crc32("c")} % 9 AS h FROM (SELECT DISTINCT c FROM o)),
r AS (SELECT k.c, 0 AS own, o.place, role, t FROM k JOIN o ON o.c = k.base AND o.place < h
      UNION ALL SELECT k.c, 1, o.place, role, t FROM k JOIN o ON o.c = k.c AND o.place >= h),
p AS (SELECT c, row_number() OVER w AS depth, strlen(t) AS bytes,
             list(sha256(strlen(role) || ':' || role || t)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path
      FROM r WINDOW w AS (PARTITION BY c ORDER BY own, place)),
m AS (SELECT c, depth, bytes, sha256(array_to_string(path, ' ')) AS node,
             CASE WHEN depth = 1 THEN '' ELSE sha256(array_to_string(path[:depth - 1], ' ')) END AS up FROM p
      UNION ALL SELECT c, 0, 0, '', NULL FROM k),
l AS (SELECT c, max(depth) AS length FROM m GROUP BY c),
n AS (SELECT node, any_value(up) AS up, depth, any_value(bytes) AS bytes, min(c) AS c, count(*) AS n,
             coalesce(string_agg(CASE WHEN length = depth THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends FROM m JOIN l USING (c) GROUP BY node, depth),
ch AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
b AS (SELECT v.node, sum((u.n - 1) * u.bytes) AS saved, count(*) FILTER (ch.node IS NULL) AS leaves
      FROM n u JOIN m v ON v.c = u.c AND v.depth <= u.depth LEFT JOIN ch ON ch.node = u.node GROUP BY v.node)
SELECT n.c AS conv_id, n.depth, x.c AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n LEFT JOIN n x ON x.node = n.up LEFT JOIN ch ON ch.node = n.node JOIN b ON b.node = n.node
"""

SQL: dict[str, str] = {
    "op13_turn_trie": _TRIE,
    "op11_dyadic_runs": _RUNS,
    "op9_fm_index": _DECONTAMINATE,
    "op8_risk_rules": _QUALITY,
}
