"""Registered queries of the text operators and, where SQL can say it, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm import automata, bloomlm, extraction, leaks, passages, pieces, repair, reputation, revisits, rules, simhash, toxicity, tries
from tollgate.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page url; the labelled outcome of a page is the quality label with its number."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    judged = reputation.filter_urls(table(spark, sf_dir, "pages"), outcomes)
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad")


def _shrunk(level: str, groups: str, parent: str) -> str:
    """Posterior counts a and b of the groups of one level; `groups` has bad, n and the parent's mean."""
    return f"""{level}_prior AS (SELECT *, (SELECT 1 / coalesce(least(0.5::DOUBLE, greatest(1e-4::DOUBLE, sum(n * (rate - {parent}) * (rate - {parent})
    - {parent} * (1 - {parent})) / nullif(sum((n - 1) * {parent} * (1 - {parent})), 0))), 1e-4::DOUBLE) - 1
    FROM (SELECT *, CAST(bad AS DOUBLE) / n AS rate FROM ({groups}) WHERE n > 0)) AS strength FROM ({groups})),
{level} AS (SELECT *, strength * {parent} + bad AS a, strength - strength * {parent} + n - bad AS b FROM {level}_prior)"""


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


_RANKED = sorted(reputation.RULES, key=lambda r: -len(r[0] + r[1]))
_NAME, _SAYS = ("CASE " + " ".join(f"WHEN {_fits(h, p)} THEN '{(h + p, v)[k]}'" for h, p, v in _RANKED) + " END" for k in (0, 1))
ORACLES["op9_host_reputation"] = f"""
WITH rests AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') AS rest FROM pages),
placed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{reputation.UPPER}', '{reputation.LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
outcomes AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
hosts AS (SELECT host, coalesce(sum(bad), 0) AS bad, count(bad) AS n, regexp_extract(host, '([^.]*\\.)?[^.]*$', 0) AS domain,
  regexp_extract(host, '[^.]*$', 0) AS suffix FROM placed LEFT JOIN outcomes USING (page_id) GROUP BY host),
domains AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM domains GROUP BY 1),
overall AS (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 5.0::DOUBLE) AS rate0 FROM suffixes),
{_shrunk("s", "SELECT * FROM suffixes, overall", "rate0")},
{_shrunk("d", "SELECT domains.*, s.a / (s.a + s.b) AS rate1 FROM domains JOIN s USING (suffix)", "rate1")},
{_shrunk("h", "SELECT hosts.*, d.a / (d.a + d.b) AS rate2 FROM hosts JOIN d USING (domain)", "rate2")},
bounds AS (SELECT host, n, bad, pow(sin(greatest(0, asin(sqrt(a / (a + b))) - 1.645::DOUBLE / (2 * sqrt(a + b + 1)))), 2) AS bound FROM h)
SELECT page_id, host, path, {_NAME} AS rule, coalesce({_SAYS}, CASE WHEN bound > 0.25 THEN 'block' ELSE 'allow' END) AS verdict,
  n AS n_labelled, CAST(bad AS BIGINT) AS n_bad FROM placed JOIN bounds USING (host)"""


@query
def op3_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    judged = rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op2_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extraction.extract(table(spark, sf_dir, "pages"))


@query
def op7_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, and whether they decode to the text itself."""
    return pieces.encode(table(spark, sf_dir, "documents"))


@query
def op10_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op8_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed bytes, removed runs and the digest of the rest of every document."""
    cut = passages.remove_passages(table(spark, sf_dir, "documents"))
    return cut.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_cgk_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the best matching span."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_bloom_filter_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and model score of every document."""
    return bloomlm.score_texts(table(spark, sf_dir, "documents"))


@query
def op6_not_modified_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base record, status and merged headers of every revisit among the archive records of the pages."""
    found = revisits.resolve(revisits.captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "canonical_url", "base_id", "status", F.array_join(F.array_sort(lines), "\n").alias("headers"))


@query
def op11_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and the digest of the rest of every document."""
    cut = automata.remove_windows(table(spark, sf_dir, "documents"))
    return cut.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


@query
def op13_interval_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, price, edits and digest of the cheapest repair of every conversation."""
    return repair.repair(table(spark, sf_dir, "conversations"))


ORACLES["op6_not_modified_revisits"] = r"""
WITH source AS (
  SELECT CAST(page_id AS BIGINT) AS page, url, html, CAST(page_id AS BIGINT) * 10 AS born,
         '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag FROM pages),
-- crc32 of the page number, by the eight-step remainder of each byte
digits AS (SELECT page, CAST(page AS VARCHAR) AS s FROM source),
crc AS (
  SELECT page, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), list_transform(range(8), lambda k: CAST(0 AS BIGINT))),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END)), CAST(4294967295 AS BIGINT)) AS pick FROM digits),
parts AS (
  SELECT source.*, pick, regexp_replace(regexp_replace(trim(coalesce(url, '')), '#[\s\S]*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM source JOIN crc USING (page)),
keyed AS (
  SELECT *, regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^www\.|:(80|443)$', '', 'g')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?([\s\S]*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) AS asked FROM parts),
named AS (SELECT *, place || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END AS key FROM keyed),
revisit AS (
  SELECT page * 2 + 1 AS record_id, key, born + pick % 5000 + 1 AS ts,
    CASE WHEN pick % 11 = 0 OR pick % 7 = 0 THEN NULL WHEN pick % 4 = 0 THEN '"changed"' WHEN pick % 3 = 0 THEN 'W/' || tag ELSE tag END AS etag,
    CASE WHEN pick % 11 <> 0 THEN born END AS modified FROM named),
ranked AS (
  SELECT r.*, b.page * 2 AS base_id, b.tag AS base_tag, b.born AS base_at, octet_length(encode(coalesce(b.html, ''))) AS size,
    row_number() OVER (PARTITION BY r.record_id ORDER BY b.born DESC, b.page DESC) AS n
  FROM revisit r LEFT JOIN named b ON r.key = b.key AND r.key <> '' AND b.born < r.ts),
judged AS (
  SELECT *, CASE WHEN base_id IS NULL THEN 'missing'
    WHEN etag IS NOT NULL THEN CASE WHEN replace(etag, 'W/', '') = base_tag THEN 'resolved' ELSE 'mismatch' END
    WHEN modified IS NULL THEN 'unverified' WHEN modified = base_at THEN 'resolved' ELSE 'mismatch' END AS status FROM ranked WHERE n = 1)
SELECT record_id, key AS canonical_url, base_id, status, CASE WHEN status = 'resolved' THEN array_to_string([
  'cache-control: max-age=60', 'content-length: ' || size, 'content-type: text/html', 'date: ' || ts, 'etag: ' || coalesce(etag, base_tag),
  'last-modified: ' || modified], chr(10)) END AS headers FROM judged"""
