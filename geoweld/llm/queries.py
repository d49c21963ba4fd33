"""The queries of the numbered operators, with production parameters over whole tables, and their SQL.

Each query is thin: it calls its operator and derives the columns asked for.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweld.llm import ann, divergence, html_text, language_id, licenses, mixing, ngram_join, packing, personal_data, quality_rules, runs, tokens, url_filters
from geoweld.llm.common import shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents"), mixing.word_count(F.col("text")))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op2_multi_index_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, language_id.not_held_out())
    held_out = F.coalesce(~language_id.not_held_out(), F.lit(False))
    return language_id.predicted(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents")).select("doc_id", "license", "score")


#: A dated list: entry_id, key, action, date. The pages' table has no list and no fetch time, so the query has its own.
URL_LIST = (
    (1, "www.spam-farm.example.org", "block", "2024-01-01"),
    (2, "www.spam-farm.example.org", "remove", "2024-05-01"),
    (3, "www.spam-farm.example.org", "block", "2024-07-15"),
    (4, "example.net", "block", "2024-03-01"),
    (5, "example.net", "remove", "2024-09-01"),
    (6, "tionsh.example.net", "allow", "2024-04-01"),
    (7, "tionsh.example.net/en/", "block", "2024-06-01"),
    (8, "tionsh.example.net/en/", "allow", "2024-08-01"),
    (9, "example.com", "block", "2024-10-01"),
    (10, "blog.tionble.example.com", "allow", "2024-11-01"),
    (11, "www.ththes.example.net/fr/", "allow", "2024-03-15"),
    (12, "example.org", "block", "2024-12-01"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages, fetched page_id % 366 days after the first of 2024."""
    day = (F.col("page_id") % 366).cast("int")
    captures = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched_at"))
    entries = spark.createDataFrame(URL_LIST, "entry_id int, key string, action string, at string").withColumn("at", F.col("at").cast("date"))
    return url_filters.judged(captures, entries).select("page_id", "blocked", "rule_id", "rule_key")


def op7_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-shards-{uuid.uuid4().hex}"
    tokens.write_shards(tokens.token_shards(table(spark, sf_dir, "documents")), folder)
    return tokens.read_documents(spark.read.parquet(folder))


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality_rules.FIGURES, "base_failed", "kept")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = runs.with_runs(docs.select("doc_id", runs.with_planted_tail(docs).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    length, period = best["length"], -best["period"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data.with_spans(docs, personal_data.train(docs))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counted = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [counted(kind) for kind in personal_data.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


WORDS = r"[^\x20\x09-\x0D]+"

OP1_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size,
         md5(concat_ws('|', 11, doc_id, source)) AS key
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
bound AS (
  SELECT source, source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)]::DOUBLE AS w,
         2.0::DOUBLE * source_size AS bound
  FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(bound) OVER (ORDER BY bound / w, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY bound / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own
  FROM bound),
targets AS (
  SELECT source, source_size, least(bound, coalesce(max(CASE WHEN own * w <= bound THEN own END) OVER () * w, bound)) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END::BIGINT AS taken
FROM placed
"""

OP4_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}'), []) AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 3), ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

def _values(rows: tuple) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


OP6_SQL = rf"""
WITH folded AS (
  SELECT row_number() OVER () AS r, doc_id,
         replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(13) || chr(10), chr(10)) AS t
  FROM documents),
unit AS (
  SELECT r, row_number() OVER () AS u, regexp_extract_all(x, '[a-z0-9]+') AS w
  FROM (SELECT r, unnest(string_split(t, chr(10)) || string_split(t, chr(10) || chr(10)) || [t]) AS x FROM folded)),
ub AS (
  SELECT DISTINCT r, u, w[i] AS a, w[i + 1] AS b FROM (SELECT r, u, w, unnest(range(1, len(w))) AS i FROM unit WHERE len(w) >= 2)),
us AS (SELECT u, count(*) AS n FROM ub GROUP BY u),
template AS (
  SELECT row_number() OVER () AS k, name, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM (VALUES {_values(licenses.TEMPLATES)}) v(name, t)),
tb AS (SELECT DISTINCT k, name, w[i] AS a, w[i + 1] AS b FROM (SELECT k, name, w, unnest(range(1, len(w))) AS i FROM template)),
ts AS (SELECT k, count(*) AS n FROM tb GROUP BY k),
hit AS (
  SELECT r, name, 2.0::DOUBLE * c / (us.n + ts.n) AS score
  FROM (SELECT r, u, k, name, count(*) AS c FROM ub JOIN tb USING (a, b) GROUP BY ALL) JOIN us USING (u) JOIN ts USING (k)),
tw AS (SELECT k, name, len(w) - 1 AS span, n AS size FROM template JOIN ts USING (k)),
db AS (SELECT r, i, w[i] AS a, w[i + 1] AS b FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM (SELECT r, regexp_extract_all(t, '[a-z0-9]+') AS w FROM folded))),
enough AS (SELECT r, k FROM (SELECT DISTINCT r, a, b FROM db) JOIN tb USING (a, b) JOIN tw USING (k) GROUP BY r, k, size HAVING 3 * count(*) >= 2 * size),
amid AS (
  SELECT h.r, h.i, tw.k, tw.name, tw.size, count(DISTINCT (d.a, d.b)) AS own, count(DISTINCT (d.a, d.b)) FILTER (x.k IS NOT NULL) AS shared
  FROM (SELECT DISTINCT db.r, k, i FROM db JOIN tb USING (a, b) SEMI JOIN enough ON enough.r = db.r AND enough.k = tb.k) h JOIN tw ON tw.k = h.k JOIN (SELECT r AS dr, max(i) AS n FROM db GROUP BY r) z ON z.dr = h.r AND z.n > tw.span
    JOIN db d ON d.r = h.r AND d.i BETWEEN h.i AND h.i + tw.span - 1 LEFT JOIN tb x ON x.k = tw.k AND x.a = d.a AND x.b = d.b
  GROUP BY ALL),
every_hit AS (SELECT r, name, score FROM hit UNION ALL SELECT r, name, 2.0::DOUBLE * shared / (own + size) FROM amid),
best AS (SELECT r, name, score FROM every_hit WHERE score >= 0.8 QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, name) = 1)
SELECT doc_id, name AS license, score FROM folded LEFT JOIN best USING (r)
"""

OP9_SQL = rf"""
WITH list AS (SELECT entry_id, key, action, CAST(dated AS DATE) AS since FROM (VALUES {_values(URL_LIST)}) v(entry_id, key, action, dated)),
valid AS (SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since, entry_id) AS until FROM list),
c AS (
  SELECT row_number() OVER () AS r, page_id, DATE '2024-01-01' + (page_id % 366)::INT AS fetched,
         lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+(/[^?#]*)', 1) AS path
  FROM pages),
hit AS (
  SELECT r, entry_id, key, action
  FROM c JOIN valid v ON c.fetched >= v.since AND (v.until IS NULL OR c.fetched < v.until) AND v.action <> 'remove'
    AND (v.key = host OR ends_with(host, '.' || v.key) OR (v.key LIKE '%/' AND starts_with(host || path, v.key)))),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(key) DESC, entry_id DESC) = 1)
SELECT page_id, coalesce(action = 'block', FALSE) AS blocked, entry_id AS rule_id, key AS rule_key FROM c LEFT JOIN best USING (r)
"""

OP10_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         coalesce(regexp_extract_all(text, '{WORDS}'), []) AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT r, i, array_to_string(list_slice(words, i, i + 7), ' ') AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS at FROM again, range(8) AS t(k)) GROUP BY r),
f AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(words, lambda x: x = upper(x) AND x <> lower(x) AND length(x) >= 2)) AS n_capital_words,
         len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
         len(list_filter(lines, lambda x: regexp_matches(x, '{quality_rules.ENDED.replace("'", "''")}'))) AS n_ended_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_trailing_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines
  FROM w LEFT JOIN covered c USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR 10 * n_capital_words > 4 * n_words OR 10 * n_letter_words < 8 * n_words
                                OR word_chars NOT BETWEEN 1.5 * n_words AND 40 * n_words OR 10 * n_dup_lines > 8 * n_lines
                                OR n_lines >= 5 AND (10 * n_ended_lines < n_lines OR 10 * n_trailing_lines > 3 * n_lines
                                                     OR 10 * n_bullet_lines > 9 * n_lines)) AS kept
FROM b
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
o AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n_lang FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n_lang)::HUGEINT AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(gn.n, 0) + v.v) AS p,
         1 + 1000000000::HUGEINT * (k.n_lang + 1) // (v.n + v.v) AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
         LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows_ AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM rows_ QUALIFY part = 'pair' OR rank <= 200
"""

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_multi_index_ann,
        op3_html_text,
        op4_ngram_jaccard,
        op5_language_id,
        op6_license_scan,
        op7_token_index,
        op8_best_two_fit,
        op9_url_filter,
        op10_quality_cascade,
        op11_periodic_runs,
        op12_source_divergence,
        op13_personal_data,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": OP1_SQL,
    "op4_ngram_jaccard": OP4_SQL,
    "op6_license_scan": OP6_SQL,
    "op9_url_filter": OP9_SQL,
    "op10_quality_cascade": OP10_SQL,
    "op12_source_divergence": OP12_SQL,
}
