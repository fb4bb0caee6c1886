"""DuckDB SQL with the same rows as the queries, where SQL can express them."""

WORD = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP2 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n >= 2
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, text, l, regexp_extract_all({LOWER.format(x="l")}, {WORD}) AS lw FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS l FROM d)
), named AS (
  SELECT doc_id, source, text, l, array_to_string(lw, ' ') AS line, len(lw) AS n FROM lines WHERE len(lw) > 0
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM named GROUP BY doc_id
), frequent AS (
  SELECT f.source AS source, line FROM (SELECT source, line, count(DISTINCT doc_id) AS found FROM named GROUP BY source, line HAVING count(DISTINCT doc_id) > 20) f
  JOIN (SELECT source, count(*) AS documents FROM documents GROUP BY source) h ON f.source IS NOT DISTINCT FROM h.source WHERE 100 * found > documents
), removed AS (
  SELECT doc_id, sum(n.n) AS n FROM named n JOIN frequent f ON n.source IS NOT DISTINCT FROM f.source AND n.line = f.line GROUP BY doc_id
), base AS (
  SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(removed.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - removed_words) >= 30 * n_words AS kept
FROM base
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT) >> {s}) & 31 AS BIGINT) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0)
)

OP8 = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

OP9 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER.format(x="coalesce(text, '')")}, {WORD}) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT a, b FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a
), least AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT w.doc_id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

OP9_LINKS = (
    OP9.partition("), edges AS")[0]
    + """), again AS (SELECT b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c = x.n AND c = y.n)
SELECT a AS doc_id, b AS linked_id FROM links WHERE a NOT IN (SELECT b FROM again) AND b NOT IN (SELECT b FROM again)
"""
)


def _level(name: str, nodes: str, parents: list[str], own: str) -> str:
    """CTEs that share the parents' budgets among the ``own`` children of ``nodes``."""
    by = ", ".join(parents) if parents else "1"
    path = ", ".join([*parents, own])
    order = f"PARTITION BY {by} ORDER BY CASE WHEN weight > 0 THEN 0 ELSE 1 END, CASE WHEN weight > 0 THEN capacity / weight END NULLS FIRST, {own}"
    return f"""{name}_a AS (SELECT *, budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l, sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {nodes}),
{name}_b AS (SELECT *, weight > 0 AND CAST(capacity AS DOUBLE) * rest <= CAST(greatest(l, 0) AS DOUBLE) * weight AS short FROM {name}_a),
{name}_f AS (SELECT {path}, l AS fl, rest AS frest FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY capacity / weight, {own}) AS r FROM {name}_b WHERE weight > 0 AND NOT short) WHERE r = 1),
{name} AS (SELECT {", ".join(f"b.{c} AS {c}" for c in [*parents, own])}, CAST(CASE WHEN short THEN capacity WHEN weight > 0 THEN least(capacity, CAST(floor(CAST(fl AS DOUBLE) * weight / frest) AS BIGINT)) WHEN fl IS NULL THEN greatest(0, least(capacity, l)) ELSE 0 END AS BIGINT) AS budget
  FROM {name}_b b LEFT JOIN {name}_f f ON {" AND ".join(f"b.{c} = f.{c}" for c in parents) if parents else "TRUE"})"""


def op7(weights: list[tuple], share: float, epochs: int, seed: int) -> str:
    values = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v) for v in row) + ")" for row in weights)
    return f"""
WITH given(domain, lang, source, weight) AS (VALUES {values}),
d AS (SELECT doc_id, coalesce('=' || lang, '') AS kl, coalesce('=' || source, '') AS ks, 'domain' || translate(left(md5(coalesce(source, '')), 1), '0123456789abcdef', '0000111122223333') AS domain, lang, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORD})) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, kl AS lang, ks AS source, CAST(sum(n_tokens) AS BIGINT) AS supply, CAST(sum(n_tokens) * {epochs} AS BIGINT) AS capacity FROM d GROUP BY ALL),
total AS (SELECT CAST(floor({share} * sum(supply)) AS BIGINT) AS budget FROM leaf),
n1 AS (SELECT l.domain AS domain, CAST(sum(capacity) AS BIGINT) AS capacity, (SELECT budget FROM total) AS budget, coalesce(any_value(g.weight), 1.0) AS weight FROM leaf l LEFT JOIN given g ON g.domain = l.domain AND g.lang IS NULL GROUP BY l.domain),
{_level("s1", "n1", [], "domain")},
n2 AS (SELECT l.domain AS domain, l.lang AS lang, CAST(sum(capacity) AS BIGINT) AS capacity, any_value(s1.budget) AS budget, coalesce(any_value(g.weight), 1.0) AS weight FROM leaf l JOIN s1 ON s1.domain = l.domain LEFT JOIN given g ON g.domain = l.domain AND '=' || g.lang = l.lang AND g.source IS NULL GROUP BY l.domain, l.lang),
{_level("s2", "n2", ["domain"], "lang")},
n3 AS (SELECT l.domain AS domain, l.lang AS lang, l.source AS source, capacity, s2.budget AS budget, 1.0 AS weight FROM leaf l JOIN s2 ON s2.domain = l.domain AND s2.lang = l.lang),
{_level("s3", "n3", ["domain", "lang"], "source")},
shares AS (SELECT l.domain AS domain, l.lang AS lang, l.source AS source, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS full_epochs, CASE WHEN supply > 0 THEN budget % supply ELSE 0 END AS part FROM leaf l JOIN s3 USING (domain, lang, source)),
placed AS (SELECT d.*, full_epochs, part, coalesce(sum(n_tokens) OVER (PARTITION BY d.domain, kl, ks ORDER BY md5('{seed}|' || full_epochs || '|' || doc_id), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN shares s ON s.domain = d.domain AND s.lang = kl AND s.source = ks)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch AS INTEGER) AS epoch, n_tokens AS taken_tokens FROM (SELECT *, unnest(range(0, CAST(full_epochs AS BIGINT))) AS epoch FROM placed)
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, CAST(full_epochs AS INTEGER), CAST(least(n_tokens, part - start) AS BIGINT) FROM placed WHERE start < part
"""
