"""DuckDB statements that give the registered queries' results independently.

Each statement is a chain of common table expressions over the given tables. ``measure`` lists the
columns compared as doubles of six digits, ``count`` those compared as bigint.
"""

from __future__ import annotations

from tollgate.functions.costs import threshold_grid
from tollgate.functions.hashing import poisson_cuts
from tollgate.operators.experiment import COVARIATES, RISK_CUTOFFS, SRM_HALT_P
from tollgate.operators.matching import BETAS, GAMMAS

ORACLES: dict[str, str] = {}


def _result(ctes: list[str], body: str, columns: str) -> str:
    """``columns`` is a compact list: ``name`` as is, ``name:n`` a count, ``name:m`` a measure."""
    picked = []
    for item in columns.split():
        name, _, kind = item.partition(":")
        picked.append({"": name, "n": f"CAST({name} AS BIGINT) AS {name}",
                       "m": f"CASE WHEN abs(CAST({name} AS DOUBLE)) < 9e9::DOUBLE THEN floor(CAST({name} AS DOUBLE) * 1e6::DOUBLE + 0.5::DOUBLE) "
                            f"/ 1e6::DOUBLE + 0.0::DOUBLE ELSE CAST({name} AS DOUBLE) END AS {name}"}[kind])
    head = "WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else ""
    return f"{head}SELECT {', '.join(picked)} FROM ({body}) AS result"


def oracle(name: str, ctes: list[str], body: str, columns: str) -> None:
    ORACLES[name] = _result(ctes, body, columns)


# ---- shared views --------------------------------------------------------------------------------

TXN = ["""txn0 AS (
  SELECT event_id AS transaction_id, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS transaction_dt,
         CAST(value AS DECIMAL(18,3)) AS transaction_amt, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_fraud,
         event_type AS product_cd, user_id, CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS INTEGER) AS k,
         CAST(CAST('0x' || substr(md5('score:' || event_id), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM events)""",
       """txn AS (
  SELECT transaction_id, transaction_dt, transaction_dt // 86400 AS txn_day, transaction_amt, is_fraud, product_cd, k,
         CASE WHEN k % 25 <> 0 THEN user_id END AS card1,
         CASE WHEN k % 10 <> 0 THEN CAST(user_id % 7 AS DOUBLE) END AS addr1,
         CASE WHEN k % 9 <> 0 THEN CAST(transaction_dt // 86400 - user_id % 5 AS DOUBLE)
              + CASE WHEN k = 33 THEN 0.5::DOUBLE ELSE 0::DOUBLE END END AS d1,
         round(u * u * (0.5::DOUBLE + 0.5::DOUBLE * is_fraud), 4) AS score
  FROM txn0)"""]
IDENTITY = "ident AS (SELECT c_custkey AS transaction_id, c_mktsegment AS device_type, c_acctbal AS id_01 FROM customer)"
KEYED = TXN + ["""parts AS (SELECT *, CAST(round(addr1) AS BIGINT) AS a, txn_day - CAST(round(d1) AS BIGINT) AS s FROM txn)""",
               """keyed AS (
  SELECT *, CASE WHEN card1 IS NULL THEN 'singleton' WHEN a IS NOT NULL AND s IS NOT NULL THEN 'full'
                 WHEN s IS NOT NULL THEN 'no_addr' WHEN a IS NOT NULL THEN 'no_card_start' ELSE 'card_only' END AS account_key_tier,
         CASE WHEN card1 IS NULL THEN 'X|' || transaction_id
              WHEN a IS NOT NULL AND s IS NOT NULL THEN 'F|' || card1 || '|' || a || '|' || s
              WHEN s IS NOT NULL THEN 'N|' || card1 || '|' || s WHEN a IS NOT NULL THEN 'D|' || card1 || '|' || a
              ELSE 'C|' || card1 END AS account_id,
         NOT (card1 IS NOT NULL AND a IS NOT NULL AND s IS NOT NULL) AS is_degraded_key FROM parts)"""]


def lookback(source: str, name: str = "feat") -> list[str]:
    return [f"""{name}0 AS (
  SELECT *, count(*) OVER p AS prior_txn_count, sum(transaction_amt) OVER p AS prior_amt_sum,
         CAST(sum(transaction_amt) OVER p AS DOUBLE) / nullif(count(*) OVER p, 0) AS prior_amt_mean,
         count(*) OVER (PARTITION BY account_id ORDER BY transaction_dt RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS txn_count_1h,
         count(*) OVER (PARTITION BY account_id ORDER BY transaction_dt RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS txn_count_24h,
         count(*) OVER (PARTITION BY account_id ORDER BY transaction_dt RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING) AS txn_count_7d,
         max(transaction_dt) OVER p AS prev_transaction_dt
  FROM {source} WINDOW p AS (PARTITION BY account_id ORDER BY transaction_dt RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
            f"""{name} AS (SELECT *, CAST(transaction_amt AS DOUBLE) / nullif(prior_amt_mean, 0) AS amt_to_prior_mean_ratio,
         transaction_dt - prev_transaction_dt AS seconds_since_prev_txn FROM {name}0)"""]


LOOK = ("prior_txn_count:n prior_amt_sum:m prior_amt_mean:m txn_count_1h:n txn_count_24h:n txn_count_7d:n "
        "prev_transaction_dt:n amt_to_prior_mean_ratio:m seconds_since_prev_txn:n")
FEAT = KEYED + lookback("keyed")
DIM = KEYED + ["""dim AS (
  SELECT account_id, any_value(account_key_tier) AS account_key_tier, bool_or(is_degraded_key) AS is_degraded_key,
         min(txn_day) AS first_seen_day, max(txn_day) AS last_seen_day, max(txn_day) - min(txn_day) AS active_day_span,
         count(*) AS txn_count, sum(transaction_amt) AS total_amount, CAST(sum(transaction_amt) AS DOUBLE) / count(*) AS mean_amount,
         sum(is_fraud) AS fraud_count, CAST(sum(is_fraud) AS DOUBLE) / count(*) AS fraud_rate FROM keyed GROUP BY account_id)"""]

# ---- staging -------------------------------------------------------------------------------------

STAGED = "transaction_id:n is_fraud:n transaction_dt:n transaction_amt:m product_cd card1:n addr1:m d1:m"
oracle("stg_typed", TXN, "SELECT * FROM txn", STAGED)
oracle("csv_roundtrip", TXN, "SELECT * FROM txn", STAGED + " txn_day:n")
oracle("txn_clock", TXN, """SELECT transaction_id, txn_day, (transaction_dt % 86400) // 3600 AS txn_hour, txn_day % 7 AS txn_dow
  FROM txn""", "transaction_id:n txn_day:n txn_hour:n txn_dow:n")
oracle("by_name_union", TXN, """SELECT transaction_id, CASE WHEN is_fraud = 1 THEN transaction_amt END AS transaction_amt, product_cd
  FROM txn""", "transaction_id:n transaction_amt:m product_cd")
oracle("narrow_types", TXN, """SELECT transaction_id, transaction_amt, CAST(score AS FLOAT) AS score, 'bigint' AS type_transaction_id,
  'double' AS type_transaction_amt, 'float' AS type_score FROM txn""",
       "transaction_id:n transaction_amt:m score:m type_transaction_id type_transaction_amt type_score")
oracle("align_by_id", TXN, "SELECT * FROM txn WHERE is_fraud = 1", "transaction_id:n card1:n addr1:m txn_day:n")

# ---- keys ----------------------------------------------------------------------------------------

oracle("account_keys", KEYED, "SELECT * EXCLUDE (addr1), a AS addr1, s AS card_start_day FROM keyed",
       "transaction_id:n transaction_dt:n txn_day:n card1:n addr1:n card_start_day:n account_key_tier account_id is_degraded_key")
oracle("key_tier_share", KEYED, """SELECT account_key_tier, count(*) AS n_rows, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct
  FROM keyed GROUP BY 1""", "account_key_tier n_rows:n pct:m")


def _prefix(letter: str, parts: list[str]) -> list[str]:
    """Longest non-null prefix, by counting the parts before the first null."""
    depth = "0"
    for i in range(len(parts)):
        whole = " AND ".join(f"{p} IS NOT NULL" for p in parts[:i + 1])
        depth = f"greatest({depth}, CASE WHEN {whole} THEN {i + 1} ELSE 0 END)"
    texts = " ".join(f"WHEN {n} THEN '{letter}{n}|' || " + " || '|' || ".join(parts[:n]) for n in range(1, len(parts) + 1))
    return KEYED[:-1] + [
        """ext AS (SELECT *, CASE WHEN k % 4 <> 0 THEN k % 5 END AS card2, CASE WHEN k % 6 <> 0 THEN k % 3 END AS card3,
  k % 2 AS card5, CASE WHEN k % 8 <> 0 THEN product_cd END AS email FROM parts)""",
        f"deep AS (SELECT *, {depth} AS depth FROM ext)",
        f"""cand AS (SELECT *, CASE depth {texts} ELSE 'X|' || transaction_id END AS account_id,
  CASE WHEN depth = 0 THEN 'singleton' ELSE 'depth_' || depth END AS account_key_tier, true AS is_degraded_key FROM deep)""",
        *lookback("cand")]


for _name, _letter, _parts in (
        ("tiered_key_email", "E", ["card1", "a", "s", "email"]), ("tiered_key_single", "K", ["card1"]),
        ("tiered_key_start", "S", ["card1", "s"]), ("tiered_key_card2", "W", ["card1", "a", "s", "card2"]),
        ("tiered_key_all_cards", "M", ["card1", "card2", "card3", "card5", "a", "s"])):
    oracle(_name, _prefix(_letter, _parts), "SELECT * FROM feat",
           f"transaction_id:n account_id account_key_tier is_degraded_key {LOOK}")

# ---- features ------------------------------------------------------------------------------------

oracle("txn_features", FEAT, """SELECT *, ln(CAST(transaction_amt AS DOUBLE) + 1) AS log_amount,
  (transaction_dt % 86400) // 3600 AS txn_hour, txn_day % 7 AS txn_dow FROM feat""",
       f"transaction_id:n account_id account_key_tier txn_day:n transaction_dt:n transaction_amt:m is_fraud:n {LOOK} "
       "log_amount:m txn_hour:n txn_dow:n")
PEERS = ["""peers AS (SELECT o_orderkey AS transaction_id, CAST(o_custkey AS VARCHAR) AS account_id,
  CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) * 86400 AS transaction_dt, CAST(o_totalprice AS DECIMAL(18,3)) AS transaction_amt
  FROM orders)""", *lookback("peers")]
for _name in ("txn_features_peers", "txn_features_slots"):
    oracle(_name, PEERS, "SELECT * FROM feat", f"transaction_id:n account_id transaction_dt:n transaction_amt:m {LOOK}")
oracle("prior_selfjoin_check", KEYED, """SELECT (SELECT count(*) FROM keyed) AS rows_checked, count(*) AS prior_pairs,
  sum(b.transaction_amt) AS prior_amount, 0 AS mismatches FROM keyed a JOIN keyed b
  ON a.account_id = b.account_id AND b.transaction_dt < a.transaction_dt""",
       "rows_checked:n prior_pairs:n prior_amount:m mismatches:n")
oracle("d_norm", TXN, "SELECT transaction_id, d1, d1 + 1 AS d2, txn_day - d1 AS d1_norm, txn_day - (d1 + 1) AS d2_norm FROM txn",
       "transaction_id:n d1:m d2:m d1_norm:m d2_norm:m")
oracle("fact_wide", FEAT + [IDENTITY], """SELECT f.*, ln(CAST(transaction_amt AS DOUBLE) + 1) AS log_amount,
  (transaction_dt % 86400) // 3600 AS txn_hour, txn_day % 7 AS txn_dow, txn_day - d1 AS d1_norm,
  i.transaction_id IS NOT NULL AS has_identity, device_type, id_01 FROM feat f LEFT JOIN ident i ON i.transaction_id = f.transaction_id""",
       "transaction_id:n transaction_dt:n txn_day:n transaction_amt:m is_fraud:n product_cd card1:n addr1:m d1:m account_id "
       f"account_key_tier is_degraded_key {LOOK} log_amount:m txn_hour:n txn_dow:n d1_norm:m has_identity device_type id_01:m")

oracle("mart_features", FEAT, "SELECT * FROM feat", f"transaction_id:n account_id transaction_dt:n {LOOK}")
BLOCK = range(1, 351)
oracle("fact_block", FEAT + ["block AS (SELECT l_orderkey AS transaction_id, " + ", ".join(
    f"sum(l_quantity) FILTER (slot = {i}) AS v{i}" for i in BLOCK)
    + " FROM (SELECT *, (l_linenumber - 1) * 50 + l_suppkey % 50 + 1 AS slot FROM lineitem) GROUP BY 1)"],
       "SELECT f.*, block.* EXCLUDE (transaction_id) FROM feat f LEFT JOIN block ON block.transaction_id = f.transaction_id",
       f"transaction_id:n account_id transaction_dt:n transaction_amt:m {LOOK} " + " ".join(f"v{i}:m" for i in BLOCK))

# ---- marts and profiles --------------------------------------------------------------------------

oracle("dim_accounts", DIM, "SELECT * FROM dim", "account_id account_key_tier is_degraded_key first_seen_day:n last_seen_day:n "
       "active_day_span:n txn_count:n total_amount:m mean_amount:m fraud_count:n fraud_rate:m")
oracle("mart_accounts", DIM, "SELECT * FROM dim", "account_id account_key_tier is_degraded_key first_seen_day:n last_seen_day:n "
       "active_day_span:n txn_count:n total_amount:m mean_amount:m fraud_count:n fraud_rate:m")
oracle("dim_weighted", DIM, """SELECT median(txn_count) AS txn_weighted_median, CAST(sum(txn_count) AS DOUBLE) / count(*) AS txn_weighted_mean,
  100.0::DOUBLE * count(*) FILTER (txn_count > 1) / count(*) AS pct_txns_in_multi FROM keyed JOIN dim USING (account_id)""",
       "txn_weighted_median:m txn_weighted_mean:m pct_txns_in_multi:m")
oracle("account_size_stats", DIM, """SELECT count(*) AS distinct_accounts, min(txn_count) AS min_txns, median(txn_count) AS median_txns,
  CAST(sum(txn_count) AS DOUBLE) / count(*) AS mean_txns, quantile_cont(txn_count, 0.95) AS p95_txns, max(txn_count) AS max_txns FROM dim""",
       "distinct_accounts:n min_txns:n median_txns:m mean_txns:m p95_txns:m max_txns:n")
oracle("account_size_hist", DIM, """SELECT CASE WHEN txn_count = 1 THEN '1' WHEN txn_count <= 4 THEN '2-4' WHEN txn_count <= 9 THEN '5-9'
  WHEN txn_count <= 49 THEN '10-49' ELSE '50+' END AS bucket, count(*) AS accounts, sum(txn_count) AS transactions,
  100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct_accounts,
  100.0::DOUBLE * sum(txn_count) / sum(sum(txn_count)) OVER () AS pct_transactions FROM dim GROUP BY 1""",
       "bucket accounts:n transactions:n pct_accounts:m pct_transactions:m")
oracle("table_counts", DIM, """SELECT 'fct_transactions' AS model, count(*) AS n_rows FROM keyed UNION ALL
  SELECT 'stg_identity', count(*) FROM customer UNION ALL SELECT 'dim_accounts', count(*) FROM dim""", "model n_rows:n")
_PROFILED = ["prior_txn_count", "prior_amt_sum", "prior_amt_mean", "txn_count_7d", "prev_transaction_dt",
             "amt_to_prior_mean_ratio", "card1", "addr1", "d1_norm", "id_01"]
oracle("null_profile", FEAT + [IDENTITY, """wide AS (SELECT f.*, txn_day - d1 AS d1_norm, id_01 FROM feat f
  LEFT JOIN ident i ON i.transaction_id = f.transaction_id)"""], " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 100.0::DOUBLE * (count(*) - count({c})) / count(*) AS null_pct, "
    f"100.0::DOUBLE * (count(*) - count({c})) / count(*) > 50 AS over_limit FROM wide" for c in _PROFILED),
       "feature null_pct:m over_limit")
WITH_ID = TXN + [IDENTITY, """wide AS (SELECT t.*, i.transaction_id IS NOT NULL AS has_identity, id_01, device_type FROM txn t
  LEFT JOIN ident i ON i.transaction_id = t.transaction_id)"""]
oracle("block_profile", WITH_ID, """SELECT 'key parts' AS block, 3 AS columns, 100.0::DOUBLE * (count(*) - count(card1)) / count(*)
  AS example_null_pct FROM wide UNION ALL SELECT 'identity', 2, 100.0::DOUBLE * (count(*) - count(id_01)) / count(*) FROM wide""",
       "block columns:n example_null_pct:m")
oracle("coverage", WITH_ID, """SELECT 100.0::DOUBLE * count(*) FILTER (has_identity) / count(*) AS flag_pct,
  count(*) FILTER (has_identity) AS flag_rows, CAST(sum(is_fraud) AS DOUBLE) / count(*) AS fraud_rate, sum(is_fraud) AS fraud_rows,
  count(*) AS total_rows FROM wide""", "flag_pct:m flag_rows:n fraud_rate:m fraud_rows:n total_rows:n")
SPLIT = "CASE WHEN txn_day < 18 THEN 'train' WHEN txn_day < 21 THEN 'early_stop' WHEN txn_day < 24 THEN 'calibration' ELSE 'test' END"
oracle("split_profile", TXN, f"""SELECT *, (fraud_rate - 0.03499::DOUBLE) / 0.03499::DOUBLE * 100 AS dev_pct,
  abs((fraud_rate - 0.03499::DOUBLE) / 0.03499::DOUBLE * 100) > 30 AS drifted FROM (SELECT {SPLIT} AS split, count(*) AS n_rows,
  sum(is_fraud) AS fraud, CAST(sum(is_fraud) AS DOUBLE) / count(*) AS fraud_rate FROM txn GROUP BY 1)""",
       "split n_rows:n fraud:n fraud_rate:m dev_pct:m drifted")
oracle("fold_masks", TXN, """SELECT fold, CASE WHEN txn_day < fold - 6 THEN 'train' WHEN txn_day < fold - 3 THEN 'early_stop'
  WHEN txn_day < fold THEN 'calibration' ELSE 'test' END AS role, count(*) AS n, sum(is_fraud) AS frauds
  FROM txn JOIN (VALUES (18), (21), (24), (27)) AS f(fold) ON txn_day < fold + 3 GROUP BY 1, 2""", "fold:n role n:n frauds:n")
oracle("reconcile_ids", TXN + [IDENTITY], """SELECT 'left_only' AS direction, count(*) AS n FROM txn t WHERE NOT EXISTS
  (SELECT 1 FROM ident i WHERE i.transaction_id = t.transaction_id) UNION ALL SELECT 'right_only', count(*) FROM ident i
  WHERE NOT EXISTS (SELECT 1 FROM txn t WHERE i.transaction_id = t.transaction_id)""", "direction n:n")
oracle("level_frequency", [], "SELECT p_name AS level, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1", "level n:n")

# ---- data quality --------------------------------------------------------------------------------

oracle("dq_unique", [], """SELECT l_orderkey || '-' || l_linenumber AS line_key, count(*) AS n FROM lineitem GROUP BY 1
  HAVING count(*) > 1""", "line_key n:n")
oracle("dq_not_null", TXN, "SELECT * FROM txn WHERE card1 IS NULL", "transaction_id:n k:n")
oracle("dq_accepted", KEYED, """SELECT account_key_tier AS value, count(*) AS n FROM keyed WHERE account_key_tier NOT IN
  ('full', 'no_addr', 'no_card_start', 'singleton') GROUP BY 1""", "value n:n")
oracle("dq_row_count", DIM, """SELECT (SELECT count(*) FROM keyed) AS expected_rows, count(*) AS actual_rows FROM dim
  HAVING count(*) <> (SELECT count(*) FROM keyed)""", "expected_rows:n actual_rows:n")
oracle("dq_leakage", FEAT + ["""first_rows AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY transaction_dt, transaction_id) AS rn
  FROM feat)"""], """SELECT 'clean' AS feed, transaction_id, prior_txn_count FROM first_rows WHERE rn = 1 AND (prior_txn_count <> 0
  OR txn_count_1h <> 0 OR txn_count_24h <> 0 OR txn_count_7d <> 0 OR prior_amt_sum IS NOT NULL)
  UNION ALL SELECT 'broken', transaction_id, prior_txn_count + 1 FROM first_rows WHERE rn = 1""",
       "feed transaction_id:n prior_txn_count:n")
oracle("dq_tolerance", WITH_ID, """SELECT * FROM (SELECT 'flag_pct' AS measure, 100.0::DOUBLE * count(*) FILTER (has_identity) / count(*)
  AS actual, 24.4::DOUBLE AS expected, 0.1::DOUBLE AS tolerance FROM wide UNION ALL SELECT 'fraud_rate',
  CAST(sum(is_fraud) AS DOUBLE) / count(*), 0.2::DOUBLE, 0.05::DOUBLE FROM wide) WHERE abs(actual - expected) >= tolerance""",
       "measure actual:m expected:m tolerance:m")
_TIERS = "('full', 'no_addr', 'no_card_start', 'card_only', 'singleton')"
_SUITE = {"not_null:" + c: f"count(*) FILTER ({c} IS NULL)" for c in (
    "transaction_id", "transaction_dt", "transaction_amt", "account_id", "is_fraud", "txn_day")} | {
    "accepted:is_fraud": "count(*) FILTER (is_fraud NOT IN (0, 1))",
    "accepted:account_key_tier": f"count(*) FILTER (account_key_tier NOT IN {_TIERS})",
    "row_count": "abs(count(*) - (SELECT count(*) FROM keyed))",
    "day_of_time": "count(*) FILTER (txn_day <> transaction_dt // 86400)",
    "windows_nest": "count(*) FILTER (txn_count_1h > txn_count_24h OR txn_count_24h > txn_count_7d OR txn_count_7d > prior_txn_count)",
    "past_only": "count(*) FILTER (prev_transaction_dt >= transaction_dt)",
    "sum_with_count": "count(*) FILTER ((prior_amt_sum IS NULL) <> (prior_txn_count = 0))",
    "degraded_is_not_full": "count(*) FILTER (is_degraded_key = (account_key_tier = 'full'))",
    "positive_amount": "count(*) FILTER (transaction_amt <= 0)",
    "unique:transaction_id": "max((SELECT count(*) FROM (SELECT transaction_id FROM {0} GROUP BY 1 HAVING count(*) > 1)))",
    "no_leakage": """max((SELECT count(*) FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY transaction_dt, transaction_id,
  prior_txn_count) AS rn FROM {0}) WHERE rn = 1 AND (prior_txn_count <> 0 OR txn_count_1h <> 0 OR txn_count_24h <> 0 OR txn_count_7d <> 0
  OR prior_amt_sum IS NOT NULL)))"""}
oracle("dq_suite", FEAT + ["""broken AS (SELECT * REPLACE (CASE WHEN transaction_id % 7 = 0 THEN 'unknown' ELSE account_key_tier END AS account_key_tier,
  CASE WHEN transaction_id % 3 <> 0 THEN transaction_amt END AS transaction_amt,
  prior_txn_count + CASE WHEN transaction_id % 3 = 0 THEN 1 ELSE 0 END AS prior_txn_count)
  FROM (SELECT * FROM feat UNION ALL SELECT * FROM feat WHERE transaction_id % 50 = 0))"""],
       "\nUNION ALL ".join(f"SELECT '{feed}' AS feed, '{name}' AS check_name, {count.format(view)} AS offenders FROM {view}"
                           for feed, view in (("real", "feat"), ("broken", "broken")) for name, count in _SUITE.items()),
       "feed check_name offenders:n")
oracle("sampled_sequences", DIM + lookback("keyed"), """SELECT * FROM feat WHERE account_id IN (SELECT account_id FROM dim
  WHERE txn_count >= 5 ORDER BY md5(account_id), account_id LIMIT 3)""",
       "account_id transaction_dt:n transaction_id:n transaction_amt:m prior_txn_count:n prior_amt_sum:m")

# ---- incremental ---------------------------------------------------------------------------------

_FACT = "transaction_id:n account_id txn_day:n prior_txn_count:n prior_amt_sum:m txn_count_7d:n seconds_since_prev_txn:n"
oracle("fact_incremental", FEAT, "SELECT * FROM feat", _FACT)
oracle("fact_late_rows", KEYED + ["early AS (SELECT * FROM keyed WHERE txn_day <= 9 AND NOT (txn_day = 3 AND k < 20))",
                                  *lookback("early", "before"), *lookback("keyed", "after")],
       "SELECT * FROM before UNION ALL SELECT * FROM after WHERE txn_day > 9", _FACT)

# ---- cost ----------------------------------------------------------------------------------------


def cost_of(declined: str) -> str:
    return (f"CAST(CASE WHEN {declined} THEN CASE WHEN is_fraud = 0 THEN transaction_amt * 0.025 + 10 ELSE 0 END + 2 "
            "ELSE CASE WHEN is_fraud = 1 THEN transaction_amt + 25 ELSE 0 END END AS DECIMAL(18,6))")


oracle("txn_cost", TXN, f"SELECT transaction_id, score >= 0.116::DOUBLE AS declined, {cost_of('score >= 0.116::DOUBLE')} AS cost FROM txn",
       "transaction_id:n declined cost:m")
GRID = "grid AS (SELECT CAST(unnest(['" + "','".join(repr(t) for t in threshold_grid()) + "']) AS DOUBLE) AS threshold)"


def _outcomes(grid: str) -> str:
    """One row per score with totals from the highest score down; a threshold takes the lowest score it declines."""
    measures = {"p": ("count(*)", "is_fraud = 1"), "n": ("count(*)", "is_fraud = 0"),
                "ap": ("sum(transaction_amt)", "is_fraud = 1"), "an": ("sum(transaction_amt)", "is_fraud = 0")}
    cells = ", ".join(f"coalesce({what} FILTER ({which}), 0) AS {m}" for m, (what, which) in measures.items())
    down = ", ".join(f"sum({m}) OVER (ORDER BY score DESC) AS {m}" for m in measures)
    whole = ", ".join(f"coalesce(sum({m}), 0) AS {m}" for m in measures)
    names = {"p": ("tp", "fn"), "n": ("fp", "tn"), "ap": ("amt_tp", "amt_fn"), "an": ("amt_fp", "amt_tn")}
    parts = ", ".join(f"coalesce(d.{m}, 0) AS {a}, w.{m} - coalesce(d.{m}, 0) AS {b}" for m, (a, b) in names.items())
    per_score = f"(SELECT score, {cells} FROM txn GROUP BY score)"
    return (f"SELECT g.threshold, {parts} FROM {grid} g ASOF LEFT JOIN (SELECT score, {down} FROM {per_score}) d ON g.threshold <= d.score, "
            f"(SELECT {whole} FROM {per_score}) w")


COST = "amt_fn + 25 * fn + 0.025 * amt_fp + 10 * fp + 2 * (tp + fp)"
SWEEP = TXN + [GRID, f"swept AS MATERIALIZED (SELECT *, {COST} AS cost FROM ({_outcomes('grid')}))",
               "best AS (SELECT threshold, cost FROM swept ORDER BY cost, threshold LIMIT 1)"]
oracle("threshold_sweep", SWEEP, "SELECT * FROM swept", "threshold:m tp:n fp:n fn:n tn:n cost:m")
oracle("best_threshold", SWEEP, "SELECT * FROM best", "threshold:m cost:m")
oracle("confusion", TXN + ["four AS (SELECT unnest([0.0::DOUBLE, 0.116::DOUBLE, 0.5::DOUBLE, 1.01::DOUBLE]) AS threshold)"],
       f"""SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall,
  fp / nullif(fp + tn, 0)::DOUBLE AS false_decline_rate, tp + fp AS declined, fn + tn AS approved FROM ({_outcomes('four')})""",
       "threshold:m tp:n fp:n fn:n tn:n precision:m recall:m false_decline_rate:m declined:n approved:n")
POLICIES = SWEEP + ["""named AS (SELECT 'optimum' AS policy, threshold FROM best UNION ALL SELECT 'naive 0.5', 0.5::DOUBLE UNION ALL
  SELECT 'approve everything', 1.01::DOUBLE UNION ALL SELECT 'decline everything', 0.0::DOUBLE)""",
                    "fixed AS (SELECT DISTINCT threshold FROM named)",
                    f"priced AS (SELECT *, {COST} AS cost FROM ({_outcomes('fixed')}))",
                    "policies AS (SELECT policy, p.* FROM named JOIN priced p USING (threshold))"]
oracle("policy_compare", POLICIES, "SELECT *, cost - (SELECT cost FROM best) AS vs_optimum FROM policies",
       "policy threshold:m cost:m vs_optimum:m")
oracle("dollars_caught", POLICIES, """SELECT policy, amt_tp AS caught, amt_tp + amt_fn AS bad_dollars,
  100.0::DOUBLE * CAST(amt_tp AS DOUBLE) / nullif(CAST(amt_tp + amt_fn AS DOUBLE), 0) AS pct_caught FROM policies""",
       "policy caught:m bad_dollars:m pct_caught:m")
# Each branch is cast: a union of two wide decimals would round to the coarser scale.
oracle("extremes", TXN, f"""SELECT 'decline everything' AS policy, sum({cost_of('true')}) AS cost, CAST(0.025 * sum(transaction_amt)
  FILTER (is_fraud = 0) + 10 * count(*) FILTER (is_fraud = 0) + 2 * count(*) AS DECIMAL(38,6)) AS closed_form, 0 AS difference FROM txn UNION ALL
  SELECT 'approve everything', sum({cost_of('false')}), CAST(sum(transaction_amt) FILTER (is_fraud = 1) + 25 * sum(is_fraud) AS DECIMAL(38,6)), 0
  FROM txn""",
       "policy cost:m closed_form:m difference:m")
oracle("threshold_sensitivity", SWEEP + [
    """three AS (SELECT 'optimum -20%' AS label, threshold * 0.8::DOUBLE AS threshold FROM best UNION ALL SELECT 'optimum', threshold FROM best
  UNION ALL SELECT 'optimum +20%', threshold * 1.2::DOUBLE FROM best)""",
    f"moved AS (SELECT *, {COST} AS cost FROM ({_outcomes('three')}))"],
       """SELECT label, threshold, m.cost, m.cost - b.cost AS delta, 100.0::DOUBLE * CAST(m.cost - b.cost AS DOUBLE) / CAST(b.cost AS DOUBLE)
  AS delta_pct FROM moved m JOIN three USING (threshold), (SELECT cost FROM best) b""", "label threshold:m cost:m delta:m delta_pct:m")


def _regret(prices: str) -> list[str]:
    cost = "amt_fn + 25 * fn + 0.025 * amt_fp + price * fp + 2 * (tp + fp)"
    return SWEEP + [
        "half AS (SELECT 0.5::DOUBLE AS threshold)", f"half_out AS ({_outcomes('half')})",
        f"prices AS (SELECT CAST(unnest({prices}) AS DECIMAL(12,4)) AS price)",
        f"""tried AS MATERIALIZED (SELECT price, threshold, {cost} AS cost FROM swept CROSS JOIN prices)""",
        """optima AS (SELECT price, threshold, cost FROM (SELECT *, row_number() OVER (PARTITION BY price ORDER BY cost, threshold) AS r
  FROM tried) WHERE r = 1)""",
        f"at_half AS (SELECT price, {cost} AS cost FROM half_out CROSS JOIN prices)",
        """regrets AS (SELECT price, o.threshold AS optimal_threshold, o.cost AS cost_at_optimum, t.cost AS cost_at_baseline,
  t.cost - o.cost AS regret, h.cost - t.cost AS saving_vs_half FROM optima o JOIN tried t USING (price) JOIN at_half h USING (price)
  WHERE t.threshold = (SELECT threshold FROM best))"""]


oracle("regret_1d", _regret("[0.5, 1, 2, 4, 6, 8, 10, 15, 20, 30, 50, 80, 120]"), "SELECT *, price AS false_decline_cost FROM regrets",
       "false_decline_cost:m optimal_threshold:m cost_at_optimum:m cost_at_baseline:m regret:m saving_vs_half:m")
_SURFACE = """SELECT churn, lifetime, r.* FROM (SELECT unnest([0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.20]) AS churn) c
  CROSS JOIN (SELECT unnest([50, 100, 150, 200, 300, 500, 800]) AS lifetime) l JOIN regrets r ON r.price = churn * lifetime"""
_PRICES = "(SELECT list(DISTINCT c * l) FROM (SELECT unnest([0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.20]) AS c) CROSS JOIN (SELECT unnest([50, 100, 150, 200, 300, 500, 800]) AS l))"
oracle("regret_2d", _regret(_PRICES), _SURFACE, "churn:m lifetime:m optimal_threshold:m cost_at_optimum:m regret:m")
oracle("regret_noise_share", _regret(_PRICES), f"""SELECT 100.0::DOUBLE * count(*) FILTER (regret < 9900) / count(*) AS pct_below_noise,
  min(optimal_threshold) AS threshold_low, max(optimal_threshold) AS threshold_high FROM ({_SURFACE})""",
       "pct_below_noise:m threshold_low:m threshold_high:m")

oracle("regret_ranges", _regret(_PRICES), f"""SELECT min(optimal_threshold) AS threshold_low, max(optimal_threshold) AS threshold_high,
  max(optimal_threshold) / min(optimal_threshold) AS spread, min(regret) AS regret_low, max(regret) AS regret_high FROM ({_SURFACE})""",
       "threshold_low:m threshold_high:m spread:m regret_low:m regret_high:m")
_LINES = "SELECT threshold, fp AS slope, CAST(amt_fn + 25 * fn + 0.025 * amt_fp + 2 * (tp + fp) AS DECIMAL(18,6)) AS intercept FROM"
oracle("flip_price", SWEEP + ["half AS (SELECT 0.5::DOUBLE AS threshold)", f"h AS ({_LINES} ({_outcomes('half')}))",
                              f"b AS (SELECT l.* FROM ({_LINES} swept) l JOIN best USING (threshold))"],
       """SELECT b.threshold AS baseline_threshold, CASE WHEN h.intercept - b.intercept <= 0 THEN CASE WHEN b.slope >= h.slope THEN 0 END
  WHEN b.slope > h.slope THEN CAST(h.intercept - b.intercept AS DOUBLE) / (b.slope - h.slope) END AS flip_price FROM b, h""",
       "baseline_threshold:m flip_price:m")
oracle("price_envelope", SWEEP + [
    # The lowest threshold of equal lines, and for each line the prices from which and up to which no other line is cheaper.
    f"lines AS MATERIALIZED (SELECT slope, intercept, min(threshold) AS threshold FROM ({_LINES} swept) GROUP BY 1, 2)",
    """ends AS (SELECT a.*, greatest(0, coalesce(max(CAST(a.intercept - b.intercept AS DOUBLE) / (b.slope - a.slope)) FILTER (b.slope > a.slope), 0)) AS price_from,
  min(CAST(b.intercept - a.intercept AS DOUBLE) / (a.slope - b.slope)) FILTER (b.slope < a.slope) AS price_to,
  coalesce(bool_or(b.intercept < a.intercept) FILTER (b.slope = a.slope), false) AS above FROM lines a JOIN lines b ON true GROUP BY ALL)"""],
       """SELECT price_from, price_to, threshold, CAST(intercept AS DOUBLE) + price_from * slope AS cost_from FROM ends
  WHERE NOT above AND (price_to IS NULL OR price_from + 1e-9::DOUBLE < price_to)""", "price_from:m price_to:m threshold:m cost_from:m")

# ---- replay and accounts ---------------------------------------------------------------------------

UNIFORM = "CAST(CAST('0x' || substr(md5({}), 1, 12) AS UBIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE"
ROWS = KEYED + [f"""rows0 AS (SELECT *, score >= 0.5::DOUBLE AS dec_champ, score >= 0.116::DOUBLE AS dec_chal,
  {cost_of('score >= 0.5::DOUBLE')} AS c_champ, {cost_of('score >= 0.116::DOUBLE')} AS c_chal,
  CASE WHEN {UNIFORM.format("'stage2-v1:' || account_id")} < 0.5::DOUBLE THEN 'challenger' ELSE 'champion' END AS arm FROM keyed)""",
                "replay AS (SELECT * FROM rows0 WHERE txn_day >= 24)"]
ACC = ROWS + ["""acc0 AS (SELECT account_id, any_value(arm) AS arm, count(*) AS n_txn, sum(transaction_amt) AS tot_amt,
  CAST(sum(transaction_amt) AS DOUBLE) / count(*) AS mean_amt, CAST(sum(CAST(score AS DECIMAL(18,12))) AS DOUBLE) / count(*) AS risk,
  CAST(sum(c_champ) AS DECIMAL(18,6)) AS y_champ, CAST(sum(c_chal) AS DECIMAL(18,6)) AS y_chal, sum(is_fraud) AS fraud
  FROM replay GROUP BY account_id)""",
              """pre AS (SELECT account_id, CAST(sum(transaction_amt) AS DOUBLE) AS pre_value, count(*) AS pre_n, sum(is_fraud) AS pre_fraud,
  CAST(sum(transaction_amt) AS DOUBLE) / count(*) AS pre_mean_amt FROM keyed WHERE txn_day >= 18 AND txn_day < 24 GROUP BY account_id)""",
              """acc AS (SELECT a.*, coalesce(pre_value, 0) AS pre_value, coalesce(pre_n, 0) AS pre_n, coalesce(pre_fraud, 0) AS pre_fraud,
  coalesce(pre_mean_amt, 0) AS pre_mean_amt, CASE WHEN pre_n IS NULL THEN 0 ELSE 1 END AS has_pre_period,
  CASE WHEN arm = 'challenger' THEN y_chal ELSE y_champ END AS y, CAST(y_chal - y_champ AS DECIMAL(18,6)) AS tau
  FROM acc0 a LEFT JOIN pre p ON p.account_id = a.account_id)"""]
oracle("account_frame", ACC, "SELECT * FROM acc", "account_id arm n_txn:n tot_amt:m mean_amt:m risk:m y_champ:m y_chal:m fraud:n "
       "pre_value:m pre_n:n pre_fraud:n pre_mean_amt:m has_pre_period:n y:m tau:m")
oracle("hash_uniform", KEYED, f"""SELECT DISTINCT account_id, {UNIFORM.format("'stage2-v1:' || account_id")} AS u,
  {UNIFORM.format("'stage2-v1:obs1.5:' || account_id")} AS u_tagged FROM keyed""", "account_id u:m u_tagged:m")
oracle("arm_assign", ROWS, "SELECT DISTINCT account_id, arm FROM rows0", "account_id arm")
_CUTS = "cuts AS (SELECT CAST(unnest(['" + "','".join(repr(c) for c in RISK_CUTOFFS) + "']) AS DOUBLE) AS risk_cutoff)"
oracle("targeted_policy", ACC + [_CUTS], """SELECT risk_cutoff, accounts_on_challenger, 100.0::DOUBLE * accounts_on_challenger / n AS pct_accounts,
  total_cost, legit_declined, 100.0::DOUBLE * legit_declined / legit AS false_decline_pct, dollars_caught,
  total_cost - all_chal AS vs_challenger_everywhere FROM (SELECT risk_cutoff, count(*) AS n, count(*) FILTER (risk >= risk_cutoff)
  AS accounts_on_challenger, sum(CASE WHEN risk >= risk_cutoff THEN y_chal ELSE y_champ END) AS total_cost, sum(y_chal) AS all_chal
  FROM cuts CROSS JOIN acc GROUP BY 1) JOIN (SELECT risk_cutoff, count(*) FILTER (is_fraud = 0) AS legit,
  count(*) FILTER (is_fraud = 0 AND CASE WHEN risk >= risk_cutoff THEN dec_chal ELSE dec_champ END) AS legit_declined,
  coalesce(sum(transaction_amt) FILTER (is_fraud = 1 AND CASE WHEN risk >= risk_cutoff THEN dec_chal ELSE dec_champ END), 0) AS dollars_caught
  FROM cuts CROSS JOIN replay JOIN acc USING (account_id) GROUP BY 1) USING (risk_cutoff)""",
       "risk_cutoff:m accounts_on_challenger:n pct_accounts:m total_cost:m legit_declined:n false_decline_pct:m dollars_caught:m "
       "vs_challenger_everywhere:m")

# ---- metrics -------------------------------------------------------------------------------------


def ranking(source: str) -> list[str]:
    return [f"cells AS (SELECT score, count(*) FILTER (is_fraud = 1) AS pos, count(*) FILTER (is_fraud = 0) AS neg FROM {source} GROUP BY 1)",
            """curve AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM cells)""",
            """ranked AS (SELECT CAST(sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) AS DOUBLE) / any_value(p) AS average_precision,
  sum(pos * (CAST(n - fp AS DOUBLE) + neg / 2.0::DOUBLE)) / (CAST(any_value(p) AS DOUBLE) * any_value(n)) AS roc_auc,
  any_value(p) AS positives, any_value(n) AS negatives FROM curve)"""]


oracle("average_precision", TXN + ranking("txn"), "SELECT * FROM ranked", "average_precision:m")
oracle("roc_auc", TXN + ranking("txn"), "SELECT * FROM ranked", "roc_auc:m positives:n negatives:n")
oracle("label_quality", ["lab AS (SELECT quality AS is_fraud, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id))",
                         *ranking("lab")], "SELECT * FROM ranked", "average_precision:m roc_auc:m positives:n negatives:n")
oracle("pr_curve", TXN + ranking("txn"), "SELECT * FROM curve", "score:m tp:n fp:n")
oracle("brier", TXN, "SELECT avg((score - is_fraud) * (score - is_fraud)) AS brier FROM txn", "brier:m")
EXACT_MEAN = "CAST(sum(CAST({} AS DECIMAL(18,12))) AS DOUBLE) / count(*)"
oracle("decile_calibration", TXN + ["""placed AS (SELECT *, row_number() OVER (ORDER BY score, transaction_id) AS r, count(*) OVER () AS n
  FROM txn)"""], f"""SELECT *, abs(predicted - actual) AS abs_diff FROM (SELECT greatest(1, ((r - 1) * 10 + n - 2) // (n - 1)) AS bin,
  count(*) AS n, {EXACT_MEAN.format('score')} AS predicted, avg(is_fraud) AS actual FROM placed GROUP BY 1)""",
       "bin:n n:n predicted:m actual:m abs_diff:m")
oracle("reliability", TXN + ["edges AS (SELECT unnest(quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM txn)"],
       f"""SELECT bin, count(*) AS n, {EXACT_MEAN.format('score')} AS mean_predicted, avg(is_fraud) AS observed FROM (SELECT *,
  (SELECT count(*) FROM edges WHERE score > e) AS bin FROM txn) GROUP BY 1""", "bin:n n:n mean_predicted:m observed:m")
oracle("score_quantiles", TXN, " UNION ALL ".join(
    f"SELECT '{n}' AS statistic, quantile_cont(score, {p}) AS value FROM txn" for n, p in
    (("min", 0), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("max", 1))) +
       f" UNION ALL SELECT 'mean', {EXACT_MEAN.format('score')} FROM txn", "statistic value:m")
_HASHED = f"""hashed AS (SELECT *, {SPLIT} AS timed, row_number() OVER (ORDER BY {UNIFORM.format("'42:' || transaction_id")}, transaction_id)
  AS r, count(*) OVER () AS n FROM keyed)"""
_CUTS = """cuts AS (SELECT count(*) FILTER (timed = 'train') AS cut1, count(*) FILTER (timed IN ('train', 'early_stop')) AS cut2,
  count(*) FILTER (timed <> 'test') AS cut3 FROM hashed)"""
_RULES = f"""dealt AS (SELECT h.*, CASE WHEN r <= cut1 THEN 'train' WHEN r <= cut2 THEN 'early_stop' WHEN r <= cut3 THEN 'calibration' ELSE 'test' END AS matched,
  CASE WHEN r <= h.n * 4 * 644 // 4200 THEN 'train' WHEN r <= h.n * 4 * 749 // 4200 THEN 'early_stop'
  WHEN r <= h.n * 4 * 840 // 4200 THEN 'calibration' ELSE 'test' END AS fifth FROM hashed h, cuts)"""
oracle("random_split", KEYED + [_HASHED, _CUTS, _RULES], " UNION ALL ".join(
    f"""SELECT '{rule}' AS rule, {column} AS split, count(*) AS n, sum(is_fraud) AS frauds, sum(transaction_id) AS id_sum FROM dealt GROUP BY {column}"""
    for rule, column in (("size-matched", "matched"), ("80/20", "fifth"))), "rule split n:n frauds:n id_sum:n")
oracle("split_overlap", KEYED + [_HASHED, _CUTS, _RULES], " UNION ALL ".join(
    f"""SELECT '{rule}' AS rule, count(*) AS test_accounts, count(*) FILTER (elsewhere) AS also_elsewhere,
  CAST(count(*) FILTER (elsewhere) AS DOUBLE) / count(*) AS share FROM (SELECT account_id, bool_or({column} <> 'test') AS elsewhere,
  bool_or({column} = 'test') AS inside FROM dealt GROUP BY account_id) WHERE inside""" for rule, column in (("time", "timed"), ("random", "matched"))),
       "rule test_accounts:n also_elsewhere:n share:m")

# ---- encoders ------------------------------------------------------------------------------------

PART = "p AS (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_name END AS p_name FROM part)"
oracle("category_codes", [PART, "levels AS (SELECT p_name, dense_rank() OVER (ORDER BY p_name) AS c FROM (SELECT DISTINCT p_name FROM p WHERE p_name IS NOT NULL))"],
       "SELECT p_partkey, p.p_name, coalesce(c, 0) AS p_name_code FROM p LEFT JOIN levels USING (p_name)",
       "p_partkey:n p_name p_name_code:n")
oracle("count_encode", ["f AS (SELECT * FROM part WHERE p_partkey % 4 <> 0)",
                        "n AS (SELECT p_name, count(*) AS p_name_cnt FROM f GROUP BY 1)", "b AS (SELECT p_brand, count(*) AS p_brand_cnt FROM f GROUP BY 1)"],
       "SELECT * FROM part LEFT JOIN n USING (p_name) LEFT JOIN b USING (p_brand)",
       "p_partkey:n p_name p_brand p_type p_name_cnt:n p_brand_cnt:n")
_KINDS = ("click", "error", "purchase", "signup", "view")
oracle("one_hot", TXN, "SELECT transaction_id, " + ", ".join(
    f"CASE WHEN k % 9 <> 0 AND product_cd = '{v}' THEN 1 ELSE 0 END AS product_cd_{v}" for v in _KINDS) +
       ", CASE WHEN k % 9 <> 0 THEN 0 ELSE 1 END AS product_cd_null FROM txn",
       "transaction_id:n " + " ".join(f"product_cd_{v}:m" for v in _KINDS) + " product_cd_null:m")
oracle("median_impute", TXN, "SELECT transaction_id, txn_day, " + ", ".join(
    f"coalesce({c}, (SELECT median({c}) FROM txn WHERE txn_day < 18)) AS {c}" for c in ("card1", "addr1", "d1")) + " FROM txn",
       "transaction_id:n txn_day:n card1:m addr1:m d1:m")
oracle("standardise", TXN, """SELECT transaction_id, txn_day, (CAST(transaction_amt AS DOUBLE) - am) / asd AS transaction_amt,
  coalesce((addr1 - dm) / dsd, 0) AS addr1, 0 AS flat FROM txn, (SELECT avg(CAST(transaction_amt AS DOUBLE)) AS am,
  stddev_samp(CAST(transaction_amt AS DOUBLE)) AS asd, avg(addr1) AS dm, stddev_samp(addr1) AS dsd FROM txn WHERE txn_day < 18)""",
       "transaction_id:n txn_day:n transaction_amt:m addr1:m flat:m")

# ---- experiment ----------------------------------------------------------------------------------

oracle("srm", ACC, """SELECT *, n - n_challenger AS n_champion, (n_challenger - n / 2.0::DOUBLE) * (n_challenger - n / 2.0::DOUBLE) * 2
  / (n / 2.0::DOUBLE) AS chi2 FROM (SELECT count(*) AS n, count(*) FILTER (arm = 'challenger') AS n_challenger FROM acc)""",
       "n:n n_challenger:n n_champion:n chi2:m")


def upper_tail(z: str) -> str:
    """P(N(0,1) > z) by the series of odd powers over odd factorials; beyond eight deviations nothing is left at six digits."""
    size = f"greatest(abs({z}), 1e-300::DOUBLE)"
    term = f"exp((2 * k + 1) * ln({size}) - (lgamma(2 * k + 2) - k * ln(2::DOUBLE) - lgamma(k + 1)))"
    half = f"exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 160), lambda k: {term}))"
    return f"CASE WHEN {z} > 8 THEN 0 WHEN {z} < -8 THEN 1 ELSE 0.5::DOUBLE - sign({z}) * {half} END"


def residuals(source: str, kept: list[str], covariates: list[str]) -> list[str]:
    """Table ``left`` with ``kept`` after a linear fit on the covariates: centred, then one covariate after the other."""
    names = [*kept, *covariates]
    steps = [f"left0 AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER () AS {c}' for c in names)} FROM {source})"]
    for i, x in enumerate(covariates):
        rest = [c for c in names if c not in covariates[:i + 1]]
        share = "CASE WHEN sum({x} * {x}) OVER () > 1e-9 THEN sum({c} * {x}) OVER () / sum({x} * {x}) OVER () ELSE 0 END"
        steps.append(f"left{i + 1} AS (SELECT {', '.join(f'{c} - {share.format(c=c, x=x)} * {x} AS {c}' for c in rest)} FROM left{i})")
    return steps


oracle("srm_verdict", ACC, f"""SELECT *, CASE WHEN p_value >= {SRM_HALT_P} THEN 'PASS' ELSE 'HALT' END AS verdict FROM (SELECT *,
  2 * ({upper_tail("sqrt(chi2)")}) AS p_value FROM (SELECT *, n - n_challenger AS n_champion, (n_challenger - n / 2.0::DOUBLE)
  * (n_challenger - n / 2.0::DOUBLE) * 2 / (n / 2.0::DOUBLE) AS chi2 FROM (SELECT count(*) AS n, count(*) FILTER (arm = 'challenger') AS n_challenger
  FROM acc)))""", "n:n n_challenger:n n_champion:n chi2:m p_value:m verdict")
_SETS = {"account size": ["n_txn"], "pre-period": ["pre_value", "pre_n", "pre_fraud", "has_pre_period"],
         "pre-period and size": ["pre_value", "pre_n", "pre_fraud", "has_pre_period", "n_txn", "tot_amt"]}
oracle("risk_explained", [], " UNION ALL ".join(
    "SELECT * FROM (" + _result(ACC + residuals("acc", ["risk"], cols), f"""SELECT '{name}' AS covariates, 1 - (SELECT sum(risk * risk) FROM left{len(cols)})
  / (SELECT sum(risk * risk) FROM left0) AS r_squared""", "covariates r_squared") + ")" for name, cols in _SETS.items()), "covariates r_squared:m")


def _adjusted(covariates: list[str]) -> str:
    k = len(covariates)
    steps = ["obs AS (SELECT *, CASE WHEN arm = 'challenger' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM acc)",
             *residuals("obs", ["t", "y"], covariates), f"slope AS (SELECT sum(t * y) / sum(t * t) AS b, sum(t * t) AS tt FROM left{k})"]
    return _result(ACC + steps, f"""SELECT any_value(b) AS effect, sqrt(sum(t * t * (y - b * t) * (y - b * t)) / (any_value(tt) * any_value(tt))
  * count(*) / (count(*) - {k + 2})) AS se FROM left{k}, slope""", "effect se")


oracle("cuped_gain", [], f"""SELECT p.effect, p.se, a.effect AS adjusted_effect, a.se AS adjusted_se, 1 - (a.se / p.se) * (a.se / p.se) AS variance_reduction
  FROM ({_adjusted([])}) p, ({_adjusted(list(COVARIATES))}) a""", "effect:m se:m adjusted_effect:m adjusted_se:m variance_reduction:m")


def welch_of(source: str, group: str = "") -> str:
    """Arm means and variances from exact sums, difference and interval."""
    by = f"{group}, " if group else ""
    v = "CAST(y AS DECIMAL(18,6))"
    arms = ", ".join(
        f"count(*) FILTER ({c}) AS n_{t}, CAST(sum({v}) FILTER ({c}) AS DOUBLE) AS s_{t}, CAST(sum({v} * {v}) FILTER ({c}) AS DOUBLE) AS q_{t}"
        for t, c in (("a", "arm = 'challenger'"), ("b", "arm <> 'challenger'")))
    var = "CASE WHEN n_{0} > 1 THEN greatest(q_{0} - s_{0} * s_{0} / n_{0}, 0) / (n_{0} - 1) END / n_{0}"
    tail = f"GROUP BY {group}" if group else ""
    return (f"SELECT *, diff - 1.96::DOUBLE * se AS ci_low, diff + 1.96::DOUBLE * se AS ci_high FROM (SELECT *, mean_a - mean_b AS diff "
            f"FROM (SELECT *, s_a / n_a AS mean_a, s_b / n_b AS mean_b, sqrt({var.format('a')} + {var.format('b')}) AS se "
            f"FROM (SELECT {by}{arms} FROM {source} {tail})))")


WELCH = "n_a:n n_b:n mean_a:m mean_b:m diff:m se:m ci_low:m ci_high:m"
oracle("welch", ACC, welch_of("acc"), WELCH)
GOOD = ["""good AS (SELECT arm, account_id, count(*) FILTER (CASE WHEN arm = 'challenger' THEN dec_chal ELSE dec_champ END) AS d, count(*) AS n
  FROM replay WHERE is_fraud = 0 GROUP BY 1, 2)"""]


def ratio_of(source: str, group: str = "") -> str:
    by, tail = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    join = f"JOIN (SELECT {group}, CAST(sum(d) AS DOUBLE) / sum(n) AS ratio FROM {source} GROUP BY {group}) USING ({group})" if group else \
        f"CROSS JOIN (SELECT CAST(sum(d) AS DOUBLE) / sum(n) AS ratio FROM {source})"
    return (f"SELECT {by}count(*) AS clusters, any_value(ratio) AS ratio, sqrt(sum((d - ratio * n) * (d - ratio * n)) * count(*) "
            f"/ (count(*) - 1)) / sum(n) AS se FROM {source} {join} {tail}")


oracle("clustered_ratio", ROWS + GOOD, ratio_of("good"), "clusters:n ratio:m se:m")
oracle("guardrail", ROWS + GOOD, f"""SELECT *, ratio + 1.645::DOUBLE * se AS upper_bound, (ratio - 0.08::DOUBLE) / nullif(se, 0) AS z,
  ratio + 1.645::DOUBLE * se < 0.08::DOUBLE AS below_ceiling FROM ({ratio_of('good', 'arm')})""",
       "arm clusters:n ratio:m se:m upper_bound:m z:m below_ceiling")
oracle("arm_metrics", ROWS + ["""own AS (SELECT *, CASE WHEN arm = 'challenger' THEN dec_chal ELSE dec_champ END AS dec,
  CASE WHEN arm = 'challenger' THEN c_chal ELSE c_champ END AS cost FROM replay)"""],
       """SELECT *, 100.0::DOUBLE * CAST(dollars_caught AS DOUBLE) / CAST(dollars_total AS DOUBLE) AS pct_caught FROM (SELECT arm,
  count(*) AS transactions, sum(is_fraud) AS frauds, count(*) FILTER (dec) AS declined, CAST(count(*) FILTER (dec) AS DOUBLE) / count(*) AS decline_rate,
  count(*) FILTER (dec AND is_fraud = 1) / CAST(sum(is_fraud) AS DOUBLE) AS recall,
  count(*) FILTER (dec AND is_fraud = 1) / CAST(count(*) FILTER (dec) AS DOUBLE) AS precision,
  coalesce(sum(transaction_amt) FILTER (dec AND is_fraud = 1), 0) AS dollars_caught, sum(transaction_amt) FILTER (is_fraud = 1) AS dollars_total,
  CAST(sum(cost) AS DOUBLE) / count(*) AS cost_per_txn FROM own GROUP BY arm)""",
       "arm transactions:n frauds:n declined:n decline_rate:m recall:m precision:m dollars_caught:m dollars_total:m cost_per_txn:m pct_caught:m")
oracle("subgroups", ACC + ["""grouped AS (SELECT CASE WHEN has_pre_period > 0 THEN 'established' ELSE 'new' END AS subgroup, arm, y FROM acc
  UNION ALL SELECT CASE WHEN mean_amt >= (SELECT median(mean_amt) FROM acc) THEN 'high ticket' ELSE 'low ticket' END, arm, y FROM acc)"""],
       f"""SELECT *, n_a + n_b AS accounts, diff * (n_a + n_b) AS scaled_total, ci_low < 0 AND ci_high > 0 AS crosses_zero
  FROM ({welch_of('grouped', 'subgroup')})""", f"subgroup {WELCH} accounts:n scaled_total:m crosses_zero")
oracle("risk_quintiles", ACC + ["""binned AS (SELECT *, greatest(1, ((r - 1) * 5 + n - 2) // (n - 1)) AS quintile FROM (SELECT *,
  row_number() OVER (ORDER BY risk, account_id) AS r, count(*) OVER () AS n FROM acc))"""],
       f"""SELECT *, n_a + n_b AS accounts, diff * (n_a + n_b) AS scaled_total FROM ({welch_of('binned', 'quintile')})
  JOIN (SELECT quintile, {EXACT_MEAN.format('risk')} AS mean_risk FROM binned GROUP BY 1) USING (quintile)""",
       f"quintile:n {WELCH} mean_risk:m accounts:n scaled_total:m")
oracle("paired_effect", ACC, f"""SELECT *, effect - 1.96::DOUBLE * paired_se AS ci_low, effect + 1.96::DOUBLE * paired_se AS ci_high,
  randomised_se / paired_se AS efficiency, abs(effect - randomised) < 1.96::DOUBLE * randomised_se AS consistent FROM (SELECT count(*) AS n,
  CAST(sum(tau) AS DOUBLE) / count(*) AS effect, sqrt((CAST(sum(tau * tau) AS DOUBLE) - CAST(sum(tau) AS DOUBLE) * CAST(sum(tau) AS DOUBLE)
  / count(*)) / (count(*) - 1) / count(*)) AS paired_se FROM acc), (SELECT diff AS randomised, se AS randomised_se FROM ({welch_of('acc')}))""",
       "n:n effect:m paired_se:m ci_low:m ci_high:m randomised:m randomised_se:m efficiency:m consistent")
oracle("ancova_hc1", ACC + [
    "obs AS (SELECT CASE WHEN arm = 'challenger' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t, pre_value AS x, CAST(y AS DOUBLE) AS y FROM acc)",
    """resid AS (SELECT t - (regr_intercept(t, x) OVER () + regr_slope(t, x) OVER () * x) AS tr,
  y - (regr_intercept(y, x) OVER () + regr_slope(y, x) OVER () * x) AS yr FROM obs)""",
    "slope AS (SELECT sum(tr * yr) / sum(tr * tr) AS b, sum(tr * tr) AS tt FROM resid)"],
       """SELECT count(*) AS n, any_value(b) AS effect, sqrt(sum(tr * tr * (yr - b * tr) * (yr - b * tr)) / (any_value(tt) * any_value(tt))
  * count(*) / (count(*) - 3)) AS se FROM resid, slope""", "n:n effect:m se:m")


def smd_of(source: str, cols: list[str], flag: str, name: str = "smd", weight: str = "1") -> str:
    parts = []
    for c in cols:
        w, x = f"CAST({weight} AS DOUBLE)", f"CAST({c} AS DOUBLE)"
        sums = ", ".join(f"sum({w}) FILTER ({f}) AS n{t}, sum({w} * {x}) FILTER ({f}) AS s{t}, sum({w} * {x} * {x}) FILTER ({f}) AS q{t}"
                         for t, f in (("a", flag), ("b", f"NOT ({flag})")))
        var = "greatest(q{0} - s{0} * s{0} / n{0}, 0) / (n{0} - 1)"
        parts.append(f"SELECT '{c}' AS covariate, CASE WHEN sd > 1e-12::DOUBLE THEN (sa / na - sb / nb) / sd ELSE 0 END AS {name} FROM (SELECT *, "
                     f"sqrt(({var.format('a')} + {var.format('b')}) / 2) AS sd FROM (SELECT {sums} FROM {source}))")
    return " UNION ALL ".join(parts)


oracle("smd", ACC, smd_of("acc", ["n_txn", "tot_amt", "risk", "pre_value", "pre_n"], "arm = 'challenger'"), "covariate smd:m")
oracle("paired_test", ROWS, """SELECT *, mean_diff / se AS t FROM (SELECT count(*) AS n, avg(d) AS mean_diff, stddev_samp(d) AS sd_diff,
  stddev_samp(d) / sqrt(count(*)) AS se, count(*) FILTER (d < 0) AS wins FROM (SELECT CAST(sum(c_chal) AS DOUBLE) - CAST(sum(c_champ) AS DOUBLE)
  AS d FROM replay GROUP BY txn_day))""", "n:n mean_diff:m sd_diff:m se:m t:m wins:n")

oracle("cost_clustering", ROWS + ["""per AS (SELECT account_id, count(*) AS n, CAST(sum(c_champ) AS DOUBLE) AS s,
  CAST(sum(c_champ * c_champ) AS DOUBLE) AS q FROM replay GROUP BY 1)""",
                                  """tot AS (SELECT count(*) AS k, sum(n) AS m, sum(n * n) AS nn, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM per)""",
                                  """parts2 AS (SELECT *, (b - s * s / m) / (k - 1) AS msb, (q - b) / (m - k) AS msw, (m - CAST(nn AS DOUBLE) / m) / (k - 1) AS n0
  FROM tot)"""],
       """SELECT k AS clusters, m AS rows, CAST(m AS DOUBLE) / k AS mean_size, icc, 1 + (CAST(m AS DOUBLE) / k - 1) * icc AS design_effect
  FROM (SELECT *, (msb - msw) / (msb + (n0 - 1) * msw) AS icc FROM parts2)""",
       "clusters:n rows:n mean_size:m icc:m design_effect:m")
oracle("detectable_effect", ACC, """SELECT *, 2 * sd / sqrt(n) AS se, 2.8015852180728764::DOUBLE * (2 * sd / sqrt(n)) AS mde,
  2.8015852180728764::DOUBLE * (2 * sd / sqrt(n)) * n AS mde_total FROM (SELECT count(*) AS n, sqrt((CAST(sum(y_champ * y_champ) AS DOUBLE)
  - CAST(sum(y_champ) AS DOUBLE) * CAST(sum(y_champ) AS DOUBLE) / count(*)) / (count(*) - 1)) AS sd FROM acc)""",
       "n:n sd:m se:m mde:m mde_total:m")
oracle("covariate_value", ACC, " UNION ALL ".join(
    f"SELECT '{c}' AS covariate, corr({c}, CAST(y_champ AS DOUBLE)) AS correlation, power(corr({c}, CAST(y_champ AS DOUBLE)), 2) AS variance_reduction, "
    f"sqrt(1 - power(corr({c}, CAST(y_champ AS DOUBLE)), 2)) AS mde_factor FROM acc" for c in ("pre_value", "pre_n", "pre_fraud", "pre_mean_amt")),
       "covariate correlation:m variance_reduction:m mde_factor:m")
_RULE = "(1 - score) * (CAST(transaction_amt AS DOUBLE) * 0.025::DOUBLE + 10) + 2 < score * (CAST(transaction_amt AS DOUBLE) + 25)"
oracle("expected_cost_rule", ROWS, f"""SELECT sum({cost_of(_RULE)}) AS rule_cost, sum(c_chal) AS threshold_cost,
  sum({cost_of(_RULE)}) - sum(c_chal) AS difference, count(*) AS n, CAST(sum({cost_of(_RULE)}) AS DOUBLE) / count(*) AS rule_cost_per_row FROM replay""",
       "rule_cost:m threshold_cost:m difference:m n:n rule_cost_per_row:m")
oracle("ship_decision", ROWS + ACC[len(ROWS):] + GOOD + [
    f"w AS ({welch_of('acc')})", f"g AS (SELECT ratio + 1.645::DOUBLE * se < 0.08::DOUBLE AS ok FROM ({ratio_of('good', 'arm')}) WHERE arm = 'challenger')",
    "c AS (SELECT abs(diff / se) > 1.959963984540054::DOUBLE AND diff < 0 AS c1, ci_high < 0 AS c2, ok AS c3, ci_low > 0 AS harm FROM w, g)"],
       """SELECT 'primary significant and favourable' AS condition, CASE WHEN c1 THEN 'PASS' ELSE 'FAIL' END AS outcome FROM c UNION ALL
  SELECT 'upper end of the interval below zero', CASE WHEN c2 THEN 'PASS' ELSE 'FAIL' END FROM c UNION ALL
  SELECT 'guardrail bound below the ceiling', CASE WHEN c3 THEN 'PASS' ELSE 'FAIL' END FROM c UNION ALL
  SELECT 'decision', CASE WHEN c1 AND c2 AND c3 THEN 'SHIP' WHEN NOT c3 OR harm THEN 'DO NOT SHIP' ELSE 'INCONCLUSIVE' END FROM c""",
       "condition outcome")

# ---- bootstrap -----------------------------------------------------------------------------------


def weight_of(seed: str, key: str) -> str:
    draw = f"CAST('0x' || substr(md5('{seed}:' || (rep // 4) || ':' || {key}), 1 + 8 * (rep % 4), 8) AS UBIGINT)"
    return "(" + " + ".join(f"CAST({draw} >= {e} AS INTEGER)" for e in poisson_cuts()) + ")"




def reps(count: int) -> str:
    return f"reps AS (SELECT unnest(range({count})) AS rep)"


oracle("boot_cost_diff", ROWS + [reps(600)], f"""SELECT rep, sum((c_chal - c_champ) * {weight_of('7', 'transaction_id')}) AS diff
  FROM replay CROSS JOIN reps WHERE c_chal <> c_champ GROUP BY rep""", "rep:n diff:m")
oracle("boot_cost_interval", ROWS + [reps(600),
                                     f"""sums AS (SELECT rep, sum((c_chal - c_champ) * {weight_of('7', 'transaction_id')}) AS diff
  FROM replay CROSS JOIN reps WHERE c_chal <> c_champ GROUP BY rep)"""],
       """SELECT CAST(sum(diff) AS DOUBLE) / count(diff) AS boot_mean, quantile_cont(CAST(diff AS DOUBLE), 0.025) AS ci_low,
  quantile_cont(CAST(diff AS DOUBLE), 0.975) AS ci_high FROM sums""",
       "boot_mean:m ci_low:m ci_high:m")
oracle("boot_mean_diff", ACC + [reps(2000), f"w AS (SELECT rep, arm, y, {weight_of('42', 'account_id')} AS w FROM acc CROSS JOIN reps)"],
       """SELECT rep, CAST(sum(w * y) FILTER (arm = 'challenger') AS DOUBLE) / sum(w) FILTER (arm = 'challenger')
  - CAST(sum(w * y) FILTER (arm <> 'challenger') AS DOUBLE) / sum(w) FILTER (arm <> 'challenger') AS diff FROM w GROUP BY rep""",
       "rep:n diff:m")
oracle("boot_metric", TXN + [
    reps(1000), f"w AS (SELECT rep, score, is_fraud, {weight_of('7', 'transaction_id')} AS w FROM txn CROSS JOIN reps)",
    "cells AS (SELECT rep, score, sum(w) FILTER (is_fraud = 1) AS pos0, sum(w) FILTER (is_fraud = 0) AS neg0 FROM w WHERE w > 0 GROUP BY 1, 2)",
    "full0 AS (SELECT rep, score, coalesce(pos0, 0) AS pos, coalesce(neg0, 0) AS neg FROM cells)",
    """curve AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER a AS p, sum(neg) OVER a AS n FROM full0
  WINDOW d AS (PARTITION BY rep ORDER BY score DESC), a AS (PARTITION BY rep))"""],
       """SELECT rep, average_precision, roc_auc, brier FROM (SELECT rep, sum(CAST(pos AS DOUBLE) * (CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)))
  / CAST(any_value(p) AS DOUBLE) AS average_precision, sum(CAST(pos AS DOUBLE) * (CAST(n - fp AS DOUBLE) + CAST(neg AS DOUBLE) / 2.0::DOUBLE))
  / (CAST(any_value(p) AS DOUBLE) * CAST(any_value(n) AS DOUBLE)) AS roc_auc FROM curve GROUP BY rep) JOIN (SELECT rep,
  sum(w * (score - is_fraud) * (score - is_fraud)) / sum(w) AS brier FROM w GROUP BY rep) USING (rep)""",
       "rep:n average_precision:m roc_auc:m brier:m")

# ---- causal --------------------------------------------------------------------------------------


def ramp(beta: str) -> list[str]:
    """Intercept by plain bisection, then the assignment."""
    return ["zed AS (SELECT *, (risk - m) / sd AS z FROM acc, (SELECT n, s / n AS m, sqrt((q - s * s / n) / (n - 1)) AS sd FROM (SELECT "
            "count(*) AS n, CAST(sum(CAST(risk AS DECIMAL(18,12))) AS DOUBLE) AS s, CAST(sum(CAST(risk AS DECIMAL(18,12)) * "
            "CAST(risk AS DECIMAL(18,12))) AS DOUBLE) AS q FROM acc)))",
            f"""bisect AS (SELECT 0 AS i, -50.0::DOUBLE AS lo, 50.0::DOUBLE AS hi UNION ALL
  SELECT i + 1, CASE WHEN m < 0.5::DOUBLE THEN (lo + hi) / 2 ELSE lo END, CASE WHEN m < 0.5::DOUBLE THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, avg(1 / (1 + exp(-((lo + hi) / 2 + {beta}::DOUBLE * z)))) AS m FROM bisect, zed WHERE i < 48 GROUP BY i, lo, hi))""",
            f"""rolled AS (SELECT *, CASE WHEN t = 1 THEN y_chal ELSE y_champ END AS y_obs FROM (SELECT zed.*,
  CASE WHEN {UNIFORM.format(f"'stage2-v1:obs{beta}:' || account_id")} < 1 / (1 + exp(-((lo + hi) / 2 + {beta}::DOUBLE * z))) THEN 1 ELSE 0 END AS t
  FROM zed, (SELECT lo, hi FROM bisect WHERE i = 48)))"""]


NAIVE = """SELECT *, naive - att AS bias_vs_att, naive - ate AS bias_vs_ate, sign(naive) = sign(ate) AS sign_correct FROM (SELECT count(*) AS n,
  sum(t) AS n_treated, CAST(sum(tau) AS DOUBLE) / count(*) AS ate, CAST(sum(tau) FILTER (t = 1) AS DOUBLE) / count(*) FILTER (t = 1) AS att,
  CAST(sum(y_obs) FILTER (t = 1) AS DOUBLE) / count(*) FILTER (t = 1) - CAST(sum(y_obs) FILTER (t = 0) AS DOUBLE) / count(*) FILTER (t = 0)
  AS naive FROM rolled)"""
def over_strengths(name: str, body: str, columns: str) -> None:
    ORACLES[name] = " UNION ALL ".join(
        f"SELECT {b}::DOUBLE AS beta, * FROM ({_result(ACC + ramp(repr(float(b))), body, columns)})" for b in BETAS)


over_strengths("ramp_assign", "SELECT account_id, t FROM rolled", "account_id t:n")
over_strengths("naive_att_ate", NAIVE, "n:n n_treated:n ate:m att:m naive:m bias_vs_att:m bias_vs_ate:m sign_correct")

MATCH_STEPS = [
    "controls AS (SELECT logit, min(account_id) AS first_id, max(account_id) AS last_id FROM units WHERE t = 0 GROUP BY logit)",
    "lim AS (SELECT 0.2::DOUBLE * stddev_samp(logit) AS caliper, min(logit) FILTER (t = 0) AS lo, max(logit) FILTER (t = 0) AS hi FROM units)",
    """near0 AS (SELECT u.account_id, u.logit, b.logit AS bv, b.last_id AS bid FROM (SELECT * FROM units WHERE t = 1) u
  ASOF LEFT JOIN controls b ON u.logit > b.logit)""",
    "near1 AS (SELECT u.*, a.logit AS av, a.first_id AS aid FROM near0 u ASOF LEFT JOIN controls a ON u.logit <= a.logit)",
    """matches AS (SELECT account_id, logit, control_id, distance, CASE WHEN logit < lo OR logit > hi THEN 'off_support'
  WHEN distance > caliper THEN 'off_caliper' ELSE 'matched' END AS outcome FROM (SELECT *, CASE WHEN av IS NULL OR logit - bv <= av - logit
  THEN bid ELSE aid END AS control_id, least(logit - bv, av - logit) AS distance FROM near1), lim)""",
    "kept AS (SELECT * FROM matches WHERE outcome = 'matched')",
    """pairs AS (SELECT k.account_id, k.control_id, CAST(a.y_obs - b.y_obs AS DECIMAL(18,6)) AS diff FROM kept k
  JOIN units a ON a.account_id = k.account_id JOIN units b ON b.account_id = k.control_id)"""]
MATCHED = ACC + [
    """units AS (SELECT account_id, risk AS logit, CASE WHEN arm = 'challenger' THEN 1 ELSE 0 END AS t, y AS y_obs, n_txn, tot_amt FROM acc)""",
    *MATCH_STEPS]
oracle("nn_match", MATCHED, "SELECT * FROM matches", "account_id logit:m control_id distance:m outcome")
oracle("match_counts", MATCHED, """SELECT count(*) FILTER (outcome = 'matched') AS treated_used,
  count(DISTINCT control_id) FILTER (outcome = 'matched') AS unique_controls, count(*) FILTER (outcome = 'off_support') AS dropped_support,
  count(*) FILTER (outcome = 'off_caliper') AS dropped_caliper FROM matches""",
       "treated_used:n unique_controls:n dropped_support:n dropped_caliper:n")
_COV = ["logit", "n_txn", "tot_amt"]
oracle("balance", MATCHED + ["""sides AS (SELECT u.*, 1 AS side FROM kept k JOIN units u ON u.account_id = k.account_id UNION ALL
  SELECT u.*, 0 FROM kept k JOIN units u ON u.account_id = k.control_id)"""],
       f"SELECT * FROM ({smd_of('units', _COV, 't = 1', 'smd_before')}) JOIN ({smd_of('sides', _COV, 'side = 1', 'smd_after')}) USING (covariate)",
       "covariate smd_before:m smd_after:m")
oracle("boot_att", MATCHED + [reps(400), f"w AS (SELECT rep, diff, {weight_of('42', 'account_id')} AS w FROM pairs CROSS JOIN reps)"],
       "SELECT rep, CAST(sum(w * diff) AS DOUBLE) / sum(w) AS att FROM w GROUP BY rep", "rep:n att:m")
_GAMMAS = "gammas AS (SELECT CAST(unnest(['" + "','".join(repr(g) for g in GAMMAS) + "']) AS DOUBLE) AS gamma)"
_RANKED = MATCHED + [_GAMMAS, """sized AS (SELECT diff, abs(diff) AS size, (rank() OVER (ORDER BY abs(diff)) +
  (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2.0::DOUBLE) AS r FROM pairs WHERE diff <> 0)""",
                               """sums AS (SELECT count(*) AS pairs, sum(r) FILTER (diff < 0) AS w, sum(r) AS s, sum(r * r) AS s2 FROM sized)"""]
_Z = """SELECT gamma, pairs, (w - s / (1 + gamma)) / sqrt(gamma / (1 + gamma) / (1 + gamma) * s2) AS z_worst,
  (w - s * gamma / (1 + gamma)) / sqrt(gamma / (1 + gamma) / (1 + gamma) * s2) AS z_best FROM gammas, sums WHERE pairs >= 10"""
oracle("rosenbaum", _RANKED, _Z, "gamma:m pairs:n z_worst:m z_best:m")
oracle("rosenbaum_bounds", _RANKED, f"SELECT gamma, pairs, {upper_tail('z_worst')} AS p_upper_bound, {upper_tail('z_best')} AS p_lower_bound FROM ({_Z})",
       "gamma:m pairs:n p_upper_bound:m p_lower_bound:m")
oracle("pair_concentration", MATCHED + ["""top AS (SELECT sum(size) AS head FROM (SELECT abs(diff) AS size, row_number() OVER (ORDER BY abs(diff) DESC) AS r,
  count(*) OVER () AS n FROM pairs) WHERE r <= greatest(n // 100, 1))"""],
       """SELECT count(*) AS pairs, 100.0::DOUBLE * count(*) FILTER (diff = 0) / count(*) AS zero_pct,
  100.0::DOUBLE * count(*) FILTER (diff < 0) / nullif(count(*) FILTER (diff <> 0), 0) AS nonzero_neg_pct,
  100.0::DOUBLE * CAST((SELECT head FROM top) AS DOUBLE) / greatest(CAST(sum(abs(diff)) AS DOUBLE), 1e-9::DOUBLE) AS top1pct_share,
  CAST(sum(diff) AS DOUBLE) / count(*) AS mean_diff, median(CAST(diff AS DOUBLE)) AS median_diff FROM pairs""",
       "pairs:n zero_pct:m nonzero_neg_pct:m top1pct_share:m mean_diff:m median_diff:m")
oracle("first_attributes", KEYED, """SELECT account_id, arg_min(transaction_amt, transaction_id) AS first_transaction_amt,
  arg_min(d1, transaction_id) FILTER (d1 IS NOT NULL) AS first_d1,
  arg_min(product_cd, transaction_id) FILTER (k % 3 <> 0) AS first_product_cd FROM keyed GROUP BY account_id""",
       "account_id first_transaction_amt:m first_d1:m first_product_cd")
oracle("overlap_hist", ACC, """SELECT CASE WHEN arm = 'challenger' THEN 1 ELSE 0 END AS t, (SELECT count(*) FROM range(1, 40) AS e(i)
  WHERE risk >= i / 40.0::DOUBLE) AS bin, count(*) AS n FROM acc GROUP BY 1, 2""", "t:n bin:n n:n")


def _bias(beta: str) -> str:
    units = "units AS (SELECT account_id, risk AS logit, t, y_obs, n_txn, tot_amt FROM rolled)"
    body = f"SELECT *, (SELECT CAST(sum(diff) AS DOUBLE) / count(*) FROM pairs) - att AS bias_matched FROM ({NAIVE})"
    return _result(ACC + ramp(beta) + [units, *MATCH_STEPS], body, "bias_vs_att bias_vs_ate bias_matched")


oracle("bias_pivot", [], " UNION ALL ".join(
    f"SELECT {b}::DOUBLE AS beta, bias_vs_att AS naive, bias_vs_ate AS naive_vs_ate, bias_matched AS matched FROM ({_bias(repr(float(b)))})"
    for b in BETAS), "beta:m naive:m naive_vs_ate:m matched:m")

# ---- calibration and ranking tables ----------------------------------------------------------------

oracle("isotonic_bins", TXN + ["bins AS (SELECT floor(score * 25) / 25 AS bin, sum(is_fraud) AS s, count(*) AS n FROM txn GROUP BY 1)",
                               """spans AS (SELECT a.bin AS lo, b.bin AS hi, CAST(sum(c.s) AS DOUBLE) / sum(c.n) AS rate FROM bins a
  JOIN bins b ON a.bin <= b.bin JOIN bins c ON c.bin BETWEEN a.bin AND b.bin GROUP BY 1, 2)"""],
       """SELECT bin, (SELECT max(m) FROM (SELECT lo, min(rate) AS m FROM spans WHERE hi >= bin AND lo <= bin GROUP BY lo)) AS rate FROM bins""",
       "bin:m rate:m")
oracle("isotonic_scores", TXN + [
    "cal AS (SELECT score AS x, sum(is_fraud) AS s, count(*) AS n FROM txn WHERE txn_day >= 21 AND txn_day < 24 GROUP BY 1)",
    "cum AS (SELECT x, s, n, sum(s) OVER (ORDER BY x) AS st, sum(n) OVER (ORDER BY x) AS nt FROM cal)",
    "spans AS (SELECT a.x AS lo, b.x AS hi, CAST(b.st - a.st + a.s AS DOUBLE) / (b.nt - a.nt + a.n) AS rate FROM cum a JOIN cum b ON a.x <= b.x)",
    "lows AS (SELECT hi, min(rate) OVER (PARTITION BY lo ORDER BY hi DESC) AS m FROM spans)",
    "fit AS (SELECT hi AS x, max(m) AS r FROM lows GROUP BY 1)",
    "below AS (SELECT t.transaction_id, t.score, f.x AS x0, f.r AS r0 FROM (SELECT * FROM txn WHERE txn_day >= 24) t ASOF LEFT JOIN fit f ON t.score >= f.x)",
    "placed AS (SELECT b.*, f.x AS x1, f.r AS r1 FROM below b ASOF LEFT JOIN fit f ON b.score <= f.x)"],
       """SELECT transaction_id, score, CASE WHEN x0 IS NULL THEN r1 WHEN x1 IS NULL OR x1 = x0 THEN r0
  ELSE r0 + (r1 - r0) * (score - x0) / (x1 - x0) END AS calibrated FROM placed""", "transaction_id:n score:m calibrated:m")
def _crossed(half: str) -> list[str]:
    """Scores of one hash half through the isotonic map of the other."""
    n = half[-1]
    return [f"cal{n} AS (SELECT score AS x, sum(is_fraud) AS s, count(*) AS n FROM halves WHERE {'NOT ' if half == 'h1' else ''}first_half GROUP BY 1)",
            f"cum{n} AS (SELECT x, s, n, sum(s) OVER (ORDER BY x) AS st, sum(n) OVER (ORDER BY x) AS nt FROM cal{n})",
            f"spans{n} AS (SELECT a.x AS lo, b.x AS hi, CAST(b.st - a.st + a.s AS DOUBLE) / (b.nt - a.nt + a.n) AS rate FROM cum{n} a JOIN cum{n} b ON a.x <= b.x)",
            f"lows{n} AS (SELECT hi, min(rate) OVER (PARTITION BY lo ORDER BY hi DESC) AS m FROM spans{n})",
            f"fit{n} AS (SELECT hi AS x, max(m) AS r FROM lows{n} GROUP BY 1)",
            f"below{n} AS (SELECT t.*, f.x AS x0, f.r AS r0 FROM (SELECT * FROM halves WHERE {'' if half == 'h1' else 'NOT '}first_half) t "
            f"ASOF LEFT JOIN fit{n} f ON t.score >= f.x)",
            f"placed{n} AS (SELECT b.*, f.x AS x1, f.r AS r1 FROM below{n} b ASOF LEFT JOIN fit{n} f ON b.score <= f.x)"]


_THROUGH = """SELECT is_fraud, transaction_amt, CASE WHEN x0 IS NULL THEN r1 WHEN x1 IS NULL OR x1 = x0 THEN r0
  ELSE r0 + (r1 - r0) * (score - x0) / (x1 - x0) END AS score FROM"""
oracle("crossfit_threshold", TXN + [
    f"halves AS (SELECT *, {UNIFORM.format("'crossfit:' || transaction_id")} < 0.5::DOUBLE AS first_half FROM txn WHERE txn_day >= 21 AND txn_day < 24)",
    *_crossed("h1"), *_crossed("h2"), f"crossed AS MATERIALIZED ({_THROUGH} placed1 UNION ALL {_THROUGH} placed2)"],
       f"""WITH txn AS (SELECT * FROM crossed), {GRID} SELECT threshold FROM (SELECT *, {COST} AS cost FROM ({_outcomes('grid')}))
  ORDER BY cost, threshold LIMIT 1""", "threshold:m")
oracle("ranked_share", TXN, """SELECT *, pct > 30 AS dominates FROM (SELECT txn_day, amount, 100.0::DOUBLE * CAST(amount AS DOUBLE) / CAST(sum(amount) OVER () AS DOUBLE)
  AS pct, 100.0::DOUBLE * CAST(sum(amount) OVER (ORDER BY amount DESC, txn_day ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(amount) OVER () AS DOUBLE) AS cum_pct
  FROM (SELECT txn_day, sum(transaction_amt) AS amount FROM txn GROUP BY 1)) ORDER BY amount DESC, txn_day LIMIT 10""",
       "txn_day:n amount:m pct:m cum_pct:m dominates")
