"""DuckDB statements for the queries that SQL can express in reasonable time on whole tables."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op5_prefix_join_decontamination": f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) item, regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w
  FROM benchmark WHERE item_id IS NOT NULL
), iw AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, s, s + n - 1), ' ') g
  FROM (SELECT item, w, least(len(w), 10) n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM iw), dw AS (
  SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) s FROM d, sizes WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, s, n, item FROM dw JOIN iw USING (n, g)
), covered AS (
  SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item) n_items, string_agg(DISTINCT item, ',' ORDER BY item) said FROM hit GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(said, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op10_b_bit_minhash": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce({_LOWER}, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(list_slice(w, i, i + 3), ' ') FOR i IN range(1, len(w) - 2)]) END g,
    len(w) < 4 short FROM w
), n AS (SELECT doc_id, CAST(len(g) AS BIGINT) n_shingles FROM s),
sets AS (SELECT md5(CAST(short AS VARCHAR) || array_to_string(list_sort(g), chr(10))) class, min(doc_id) rep, any_value(g) g, any_value(short) short FROM s WHERE len(g) > 0 GROUP BY 1),
f AS (SELECT rep, len(g) n, unnest(g) x, short FROM sets),
pairs AS (
  SELECT a.rep a, b.rep b FROM f a JOIN f b ON a.x = b.x AND a.short = b.short AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT rep a, rep b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a rep, min(b) component FROM reach GROUP BY a),
member AS (
  SELECT s.doc_id, coalesce(c.component, s.doc_id) component_id
  FROM s LEFT JOIN sets t ON len(s.g) > 0 AND md5(CAST(s.short AS VARCHAR) || array_to_string(list_sort(s.g), chr(10))) = t.class LEFT JOIN comp c ON c.rep = t.rep
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id kept FROM n JOIN member USING (doc_id)
""",
    "op11_collocations": f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array(coalesce({_LOWER}, ''), '[.,;:!?\\x0A-\\x0D]')) p FROM documents
), w AS (
  SELECT lang, [x FOR x IN regexp_split_to_array(p, '[\\x20\\x09]+') IF x <> ''] w FROM pieces
), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) n FROM w GROUP BY lang),
f AS (
  SELECT lang, phrase, any_value(k) k, count(*) f FROM (
    SELECT lang, k, array_to_string(list_slice(w, s, s + k - 1), ' ') phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) s FROM w, (SELECT unnest(range(1, 6)) k) WHERE len(w) >= k)
  ) GROUP BY lang, phrase HAVING count(*) >= 100
), c AS (SELECT lang, phrase, k, f a, string_split(phrase, ' ') w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) i FROM c),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, i, l.f l, r.f r, n.n,
         CAST((1000::HUGEINT * a * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) score
  FROM cuts JOIN n ON n.lang = cuts.lang
  JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(list_slice(cuts.w, 1, i), ' ')
  JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(list_slice(cuts.w, i + 1, cuts.k), ' ')
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inner_ AS (
  SELECT DISTINCT lang, array_to_string(list_slice(w, s, s + m - 1), ' ') phrase, a longer
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) s FROM (SELECT lang, w, a, k, unnest(range(2, k)) m FROM c WHERE k > 2))
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_ x WHERE x.lang = b.lang AND x.phrase = b.phrase AND 100 * x.longer >= 100 * b.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) "rank", phrase, a, l, r, n, score
FROM kept QUALIFY "rank" <= 2000
""",
}
