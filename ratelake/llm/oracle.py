"""SQL that gives the rows of the queries which SQL can express, in DuckDB's dialect."""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || 'mix') AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM s
), o AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::BIGINT AS rest, (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS rest_weight
  FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, cap * rest_weight <= weight * rest AS stops FROM o
), t AS (
  SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE (weight * max(rest) FILTER (NOT stops) OVER ())::DOUBLE / max(rest_weight) FILTER (NOT stops) OVER () END AS target FROM f
), r AS (
  SELECT doc_id, size, source_size, target, (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS ahead,
    CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(floor(target)::BIGINT - epochs * source_size - ahead, 0), size))::BIGINT AS taken FROM r
"""

_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {pattern})"
_BENCHMARK_WORDS = _WORDS.format(text="coalesce(text, '')", pattern=r"'[0-9a-z\x{80}-\x{10FFFF}]+'")

DECONTAMINATION = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_BENCHMARK_WORDS} AS w FROM documents
), b AS (
  SELECT item_id, {_BENCHMARK_WORDS} AS w FROM benchmark
), wanted AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM wanted
), windows AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), found AS (
  SELECT r, i, n, item_id FROM windows JOIN wanted USING (n, s)
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

_TEXT_WORDS = _WORDS.format(text="coalesce(text, '')", pattern=r"'[^\x20\x09-\x0D]+'")

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_TEXT_WORDS} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), c AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN c cx ON cx.doc_id = x.doc_id JOIN c cy ON cy.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, cx.n, cy.n HAVING 100 * count(*) >= 75 * (cx.n + cy.n - count(*))
), reach AS (
  SELECT doc_id AS id, doc_id AS other FROM d UNION SELECT reach.id, l.b FROM reach JOIN l ON reach.other = l.a
), m AS (
  SELECT id, min(other) AS component_id FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN m ON m.id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

FILL_IN_MIDDLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents
), h AS (
  SELECT doc_id, x, length(x) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
    CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), o AS (
  SELECT *, substring(x, 1, p) AS a, substring(x, p + 1, q - p) AS b, substring(x, q + 1) AS z FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (q - p)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(x) AS restored_sha256
FROM o
"""

_PIECES = _WORDS.format(text="coalesce(text, '')", pattern=r"'[^.,;:!?\x0A-\x0D]+'")

COLLOCATIONS = rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest({_PIECES}) AS piece FROM documents)
), g AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT lang, k, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
), scored AS (
  SELECT u.lang, u.k, u.phrase, u.a, u.j, x.f AS l, y.f AS r, ((1000000::HUGEINT * u.a * u.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts u JOIN g x ON x.lang = u.lang AND x.phrase = u.head AND x.k = u.j JOIN g y ON y.lang = u.lang AND y.phrase = u.rest AND y.k = u.k - u.j
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), covers AS (
  SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY lang, phrase
), kept AS (
  SELECT worst.* FROM worst LEFT JOIN covers USING (lang, phrase) WHERE k = 3 OR longer IS NULL OR 100 * longer < 50 * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL = {
    "op3_decontamination": DECONTAMINATION,
    "op6_mixing": MIXING,
    "op8_near_dedup": NEAR_DEDUP,
    "op11_fill_in_middle": FILL_IN_MIDDLE,
    "op12_collocations": COLLOCATIONS,
}
