"""The operators' registered queries, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.llm import (
    ann,
    collocations,
    filter_audit,
    fingerprint,
    line_dedup,
    lm_scoring,
    mixing,
    near_dedup,
    packing,
    quality,
    sharding,
    suffix_dedup,
    url_filter,
)
from salesloom.llm.common import text_bytes
from salesloom.llm.url_filter import Rule

URL_RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without repeated lines, and how many lines went."""
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", "text"
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page. Listed are the canonical URLs that some page reaches by a feed."""
    pages = _read(spark, sf_dir, "pages", "page_id", "url")
    url = F.col("url")
    fed = pages.where(F.regexp_like(url, F.lit(r"\?[^#]*utm_source=")))
    listed = fed.select(url_filter.canonical(url_filter.host_of(url), url_filter.path_of(url)).alias("key"))
    return url_filter.judge(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies that each document belongs to."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return near_dedup.link(docs, words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are."""
    docs = fingerprint.edited(_read(spark, sf_dir, "documents", "doc_id", "text"))
    docs = docs.withColumn("edited_sketch", fingerprint.sketch(F.col("edited_text")))
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each one whose id is divisible by 20."""
    return ann.search(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"), every=20, nearest=20)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, tokenizer_path()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap"
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document without strings of 100 bytes that start earlier too."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log score under the n-grams of all others, rounded to compare."""
    scored = lm_scoring.score(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's perplexity, the threshold of its language and the verdict."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    judged = quality.judge(docs, _read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return judged.select("doc_id", "lang", "perplexity", F.col("most").alias("threshold"), "kept")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document, of eight with nearly equal bytes, and its place there."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return sharding.shard(docs, shards=8).select(
        "doc_id",
        "size",
        F.crc32(text_bytes()).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language."""
    return collocations.collocations(_read(spark, sf_dir, "documents", "text", "lang"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order of the five filters removes, by language."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return filter_audit.audit(docs, _read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_url_filter": op3_url_filter,
    "op4_near_dedup": op4_near_dedup,
    "op5_fingerprint": op5_fingerprint,
    "op6_ann": op6_ann,
    "op7_packing": op7_packing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality": op10_quality,
    "op11_sharding": op11_sharding,
    "op12_collocations": op12_collocations,
    "op13_filter_audit": op13_filter_audit,
}
_LINES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), windows AS (
  SELECT doc_id, pos, line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w AS win
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS again
  FROM windows WHERE win IS NOT NULL AND trim(win, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM later CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE again
)
SELECT d.doc_id, CAST(coalesce(l.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(l.n_removed, 0) AS INTEGER) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN coalesce(l.kept, '') END AS text
FROM documents d LEFT JOIN (
  SELECT a.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
    string_agg(CASE WHEN g.pos IS NULL THEN a.line END, chr(10) ORDER BY a.pos) AS kept
  FROM lines a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.pos = g.pos GROUP BY a.doc_id
) l ON d.doc_id = l.doc_id
"""

_URLS = r"""
WITH parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), named AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '')
    || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '') END AS key
  FROM parts
), listed AS (
  SELECT DISTINCT key FROM named WHERE regexp_matches(url, '\?[^#]*utm_source=') AND key IS NOT NULL
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
    coalesce(key IN (SELECT key FROM listed), false) AS listed
  FROM named
)
SELECT page_id, host, path, rule, listed, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

_SCORES = r"""
WITH lists AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS list
  FROM documents
), words AS (
  SELECT doc_id, unnest(list) AS w, generate_subscripts(list, 1) AS pos FROM lists
), runs AS (
  SELECT doc_id, pos, w, lag(w) OVER d AS v, lag(w, 2) OVER d AS u FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), d1 AS (SELECT doc_id, w, count(*) AS n FROM words GROUP BY doc_id, w
), d2 AS (SELECT doc_id, v, w, count(*) AS n FROM runs WHERE v IS NOT NULL GROUP BY doc_id, v, w
), d3 AS (SELECT doc_id, u, v, w, count(*) AS n FROM runs WHERE u IS NOT NULL GROUP BY doc_id, u, v, w
), o1 AS (SELECT doc_id, w, sum(n) OVER (PARTITION BY w) - n AS n FROM d1
), o2 AS (SELECT doc_id, v, w, sum(n) OVER (PARTITION BY v, w) - n AS n FROM d2
), o3 AS (SELECT doc_id, u, v, w, sum(n) OVER (PARTITION BY u, v, w) - n AS n FROM d3
), own AS (SELECT doc_id, len(list) AS n_words, (SELECT count(*) FROM words) - len(list) AS others FROM lists
), counted AS (
  SELECT r.doc_id, r.u, r.v, others, w.n AS w, vw.n AS vw, v.n AS v_, uvw.n AS uvw, uv.n AS uv
  FROM runs r JOIN own ON r.doc_id = own.doc_id
    JOIN o1 w ON r.doc_id = w.doc_id AND r.w = w.w
    LEFT JOIN o1 v ON r.doc_id = v.doc_id AND r.v = v.w
    LEFT JOIN o2 vw ON r.doc_id = vw.doc_id AND r.v = vw.v AND r.w = vw.w
    LEFT JOIN o2 uv ON r.doc_id = uv.doc_id AND r.u = uv.v AND r.v = uv.w
    LEFT JOIN o3 uvw ON r.doc_id = uvw.doc_id AND r.u = uvw.u AND r.v = uvw.v AND r.w = uvw.w
), scored AS (
  SELECT doc_id, sum(ln(CASE WHEN uvw > 0 THEN uvw / CAST(uv AS DOUBLE)
    ELSE CASE WHEN u IS NULL THEN 1.0 ELSE CAST(0.4 AS DOUBLE) END * CASE WHEN vw > 0 THEN vw / CAST(v_ AS DOUBLE)
    ELSE CASE WHEN v IS NULL THEN 1.0 ELSE CAST(0.4 AS DOUBLE) END * greatest(w, 1) / CAST(greatest(others, 1) AS DOUBLE) END END)) AS score
  FROM counted GROUP BY doc_id
)
SELECT own.doc_id, CAST(n_words AS BIGINT) AS n_words, round(coalesce(score, 0.0), 4) AS log_score
FROM own LEFT JOIN scored ON own.doc_id = scored.doc_id
"""

_AUDIT = r"""
WITH lists AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), failed AS (
  SELECT doc_id, part, [
    len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS f
  FROM lists
), known AS (
  SELECT doc_id, max(coalesce(quality = 1, false)::int) AS good, max(coalesce(toxic = 1, false)::int) AS toxic
  FROM labels GROUP BY doc_id
), kinds AS (
  SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, f
), letters AS (
  SELECT chr(64 + unnest([1, 2, 3, 4, 5])) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, ascii(filter_order[step]) - 64 AS this,
    list_transform(range(1, step), lambda k: ascii(filter_order[k]) - 64) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), met AS (
  SELECT part, filter_order, step, this, n, good, toxic, f[this] AS here,
    list_contains(list_transform(before, lambda k: f[k]), true) AS earlier, list_sum(list_transform(f, lambda x: x::int)) AS n_failed
  FROM kinds, steps
), counted AS (
  SELECT part, filter_order, step, this,
    coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0) AS kept,
    coalesce(sum(n) FILTER (here AND NOT earlier), 0) AS removed,
    coalesce(sum(n) FILTER (here AND earlier), 0) AS redundant,
    coalesce(sum(n) FILTER (here AND n_failed = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (here AND NOT earlier), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (here AND NOT earlier), 0) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, this
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, this) AS BIGINT) AS shapley
FROM counted
"""

_PHRASES = r"""
WITH pieces AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents)
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM lists GROUP BY lang
), counts AS (
  SELECT lang, phrase, m, count(*) AS a FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
    FROM lists, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m)
  GROUP BY lang, phrase, m HAVING count(*) >= 100
), split AS (
  SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w FROM counts
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
  FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k < m
), scores AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n, k, (1000 * c.a::HUGEINT * n) // (l.a::HUGEINT * r.a) AS score
  FROM cuts c JOIN counts l ON c.lang = l.lang AND c.lp = l.phrase JOIN counts r ON c.lang = r.lang AND c.rp = r.phrase
    JOIN totals t ON c.lang = t.lang
), worst AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM scores
), inside AS (
  SELECT DISTINCT p.lang, p.phrase FROM counts p JOIN (
    SELECT lang, a, unnest(list_concat(
      list_transform(range(1, m), lambda i: array_to_string(w[i:i + 1], ' ')),
      list_transform(range(1, m - 1), lambda i: array_to_string(w[i:i + 2], ' ')),
      list_transform(range(1, m - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) AS part, m
    FROM split WHERE m > 2) q
  ON p.lang = q.lang AND p.phrase = q.part AND p.m < q.m AND 100 * q.a >= 100 * p.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM worst WHERE cut = 1 AND (lang, phrase) NOT IN (SELECT (lang, phrase) FROM inside)
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op1_line_dedup": _LINES,
    "op3_url_filter": _URLS,
    "op9_lm_scoring": _SCORES,
    "op12_collocations": _PHRASES,
    "op13_filter_audit": _AUDIT,
}
