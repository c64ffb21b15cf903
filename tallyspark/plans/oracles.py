"""DuckDB SQL for the registered queries, written apart from the Spark expressions.

The three bundled cards appear as plain arithmetic here; `k` is the kind of an order (key modulo 8):
0 Swiggy, 1 no category, 2 fuel, 3 rent, 4 Amazon, 5 utility by Google Pay, 6 groceries, 7 Ola.
"""

from __future__ import annotations

from tallyspark.plans import cascade_sql, search_sql


def spends(scale: int = 1) -> str:
    return f"""s AS (SELECT CAST(o_custkey AS BIGINT) AS cycle_id, CAST(o_orderkey AS BIGINT) AS spend_id,
      CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS BIGINT) AS spend_seq,
      CAST(round(o_totalprice) AS BIGINT) * {scale} AS amount_paise, CAST(o_orderdate AS DATE) AS date,
      CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'online' ELSE 'offline' END AS channel, o_orderkey % 8 AS k, o_orderkey % 12 AS p12 FROM orders)"""


def _g(rate: str) -> str:
    return f"CAST(round(CAST(amount_paise AS DOUBLE) * CAST({rate} AS DOUBLE)) AS BIGINT)"


GROSS = f"""g AS (SELECT *, CASE WHEN k = 2 THEN 0 WHEN channel = 'online' THEN {_g('0.05')} ELSE {_g('0.01')} END AS sbi,
      CASE WHEN k IN (2, 3) THEN 0 WHEN k = 5 THEN {_g('0.05')} WHEN k IN (0, 7) THEN {_g('0.04')} ELSE 0 END AS axis_capped,
      CASE WHEN k IN (2, 3) THEN 0 ELSE {_g('0.015')} END AS axis_base,
      CASE WHEN k = 4 THEN {_g('0.05')} ELSE {_g('0.01')} END AS icici FROM s)"""
EMPTY = """r AS (SELECT *, least(sbi, 200000) AS sbi_paid, CASE WHEN least(axis_capped, 50000) > 0 THEN least(axis_capped, 50000) ELSE axis_base END AS axis_paid FROM g)"""
PER_CARD = """c AS (SELECT spend_id, 0 AS card_ord, 'sbi-cashback' AS card_id, sbi_paid AS rupees_paise FROM r
      UNION ALL SELECT spend_id, 1, 'axis-ace', axis_paid FROM r UNION ALL SELECT spend_id, 2, 'amazon-pay-icici', icici FROM r)"""
USED = """u AS (SELECT *, greatest(CASE WHEN channel = 'online' THEN 200000 - (spend_id % 5) * 50000 ELSE 200000 - (spend_id % 3) * 99990 END, 0) AS own_room,
      greatest(400000 - (spend_id % 7) * 66000, 0) AS all_room, greatest(50000 - (spend_id % 11) * 5000, 0) AS fast_room FROM g)"""
ONE = f"WITH {spends()}, {GROSS}, {EMPTY}, {PER_CARD}"

_RANKED = "q AS (SELECT *, row_number() OVER (PARTITION BY spend_id ORDER BY rupees_paise DESC, card_ord) AS rank FROM c)"

_GREEDY = f"""WITH RECURSIVE {spends(10)}, {GROSS}, t(cycle_id, spend_seq, online, offline, fast, card, rupees) AS (
  SELECT DISTINCT cycle_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST('' AS VARCHAR), CAST(0 AS BIGINT) FROM g
  UNION ALL
  SELECT cycle_id, spend_seq, online + CASE WHEN card = 'sbi-cashback' AND channel = 'online' THEN a ELSE 0 END, offline + CASE WHEN card = 'sbi-cashback' AND channel <> 'online' THEN a ELSE 0 END,
    fast + CASE WHEN card = 'axis-ace' AND f > 0 THEN f ELSE 0 END, card, CASE card WHEN 'sbi-cashback' THEN a WHEN 'axis-ace' THEN b ELSE icici END
  FROM (SELECT *, CASE WHEN a >= b AND a >= icici THEN 'sbi-cashback' WHEN b >= icici THEN 'axis-ace' ELSE 'amazon-pay-icici' END AS card FROM (
    SELECT *, CASE WHEN f > 0 THEN f ELSE axis_base END AS b FROM (
      SELECT g.*, t.online, t.offline, t.fast, least(sbi, CASE WHEN channel = 'online' THEN 200000 - t.online ELSE 200000 - t.offline END) AS a, least(axis_capped, 50000 - t.fast) AS f
      FROM t JOIN g ON g.cycle_id = t.cycle_id AND g.spend_seq = t.spend_seq + 1))))"""

_AMT = "CAST(amount_paise // 100 AS VARCHAR) || '.' || lpad(CAST(amount_paise % 100 AS VARCHAR), 2, '0')"

# what the cascade makes of each order's descriptor
_RESOLVED = f"""WITH RECURSIVE {spends()}, {cascade_sql.DESCRIPTORS}, {cascade_sql.cascade('d')},
  z AS (SELECT id AS spend_id, raw, candidates, stage, merchant_id, mcc FROM solved)"""
_LEDGER = f"""WITH {spends()}, b AS (SELECT *, 100000000 - CAST(sum(amount_paise) OVER (PARTITION BY cycle_id ORDER BY spend_seq) AS BIGINT) AS true_balance FROM s),
  l AS (SELECT cycle_id, spend_seq, -amount_paise AS amount_paise, CASE WHEN spend_id % 89 = 0 THEN NULL WHEN spend_id % 97 = 0 THEN true_balance + 100 ELSE true_balance END AS balance_paise FROM b),
  d AS (SELECT *, lag(balance_paise) OVER (PARTITION BY cycle_id ORDER BY spend_seq) + amount_paise AS expected_paise FROM l)"""
_LABELS = """WITH t0 AS (SELECT CAST(l_orderkey AS BIGINT) AS doc, 10 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS ord,
    CAST(l_shipdate AS DATE) AS date, -CAST(round(l_extendedprice) AS BIGINT) AS amount_paise, l_returnflag || ' ' || l_linestatus AS description, l_partkey AS part FROM lineitem),
  t AS (SELECT doc, ord, date, amount_paise, description FROM t0),
  k AS (SELECT doc, ord, date, amount_paise, CASE WHEN part % 11 = 0 THEN '  ' || lower(description) ELSE description END AS description, part FROM t0 WHERE part % 13 <> 0),
  p AS (SELECT doc, ord, date, amount_paise, description FROM k UNION ALL SELECT doc, ord + 1, date, amount_paise, description FROM k WHERE part % 17 = 0)"""
_EXTRA = "n // 4"  # dated lines without amounts are anchors too
_NORM = "trim(regexp_replace(upper(description), ' +', ' ', 'g'))"
_PAGES = f"""WITH {spends()}, b AS (SELECT *, 100000000 - CAST(sum(amount_paise) OVER (PARTITION BY cycle_id ORDER BY spend_seq) AS BIGINT) AS balance,
    CAST((spend_seq - 1) // 15 AS INTEGER) AS page, (spend_seq - 1) % 15 AS line,
    list_extract(['Swiggy','JioHotstar','CHANGAMP','BLNKT','Zomato','TollPlaza','QQZX','UberRides','ATM','SWIGGYL','PVRINOX','AmazonPay'], CAST(p12 AS INTEGER) + 1) AS payee FROM s),
  f AS (SELECT *, count(*) OVER (PARTITION BY cycle_id, page) AS n FROM b)"""
_MONEY_TEXT = f"""CASE spend_id % 8 WHEN 0 THEN {_AMT} WHEN 1 THEN {_AMT} || ' Dr' WHEN 2 THEN '(' || {_AMT} || ')' WHEN 3 THEN 'Rs. ' || {_AMT} WHEN 4 THEN '₹' || {_AMT} || '-' WHEN 5 THEN 'CR ' || {_AMT} WHEN 6 THEN 'SWIGGY' ELSE '12.345' END"""



def _rupees(paise: str) -> str:
    """Whole rupees of an amount that is not negative, grouped by thousand and then by hundreds."""
    whole = f"CAST(({paise}) // 100 AS VARCHAR)"
    head = f"ltrim(reverse(regexp_replace(reverse(left({whole}, length({whole}) - 3)), '(..)', '\\\\1,', 'g')), ',')"
    return f"'₹' || CASE WHEN length({whole}) > 3 THEN {head} || ',' || right({whole}, 3) ELSE {whole} END"


SQL: dict[str, str] = {
    "predicate_matrix": f"""WITH {spends()} SELECT spend_id, true AS p_always, channel = 'online' AS p_online, k IN (0, 6) AS p_food, k NOT IN (0, 6) AS p_not_food, k = 4 AS p_amazon,
      amount_paise >= 250000 AS p_large, date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AS p_1996, channel = 'online' AND k IN (0, 6) AS p_all, channel = 'online' OR k = 4 AS p_any FROM s""",
    "marginal_reward": f"""{ONE} SELECT c.spend_id, card_id, rupees_paise, CASE WHEN rupees_paise = 0 THEN NULL WHEN card_ord = 0 THEN channel
      WHEN card_ord = 1 THEN CASE WHEN k = 5 THEN 'utility_googlepay' WHEN k IN (0, 7) THEN 'food_and_travel' ELSE 'base' END ELSE CASE WHEN k = 4 THEN 'amazon_prime' ELSE 'base' END END AS rule_id,
      round(CAST(rupees_paise AS DOUBLE) / amount_paise, 6) AS effective_rate FROM c JOIN s ON s.spend_id = c.spend_id""",
    "rank_cards": f"{ONE}, {_RANKED} SELECT spend_id, CAST(rank AS INTEGER) AS rank, card_id, rupees_paise FROM q",
    "winner_advantage": f"""{ONE}, {_RANKED} SELECT spend_id, max(card_id) FILTER (rank = 1) AS winner, max(rupees_paise) FILTER (rank = 1) AS winner_paise,
      max(card_id) FILTER (rank = 2) AS runner_up, max(rupees_paise) FILTER (rank = 1) - max(rupees_paise) FILTER (rank = 2) AS advantage_paise FROM q GROUP BY spend_id""",
    "exclusions": f"""WITH {spends()} SELECT spend_id, 'sbi-cashback' AS card_id, 'fuel spends earn nothing on this card' AS why FROM s WHERE k = 2
      UNION ALL SELECT spend_id, 'axis-ace', CASE k WHEN 2 THEN 'fuel' ELSE 'rent' END || ' spends earn nothing on this card' FROM s WHERE k IN (2, 3)
      UNION ALL SELECT spend_id, 'mcc-test', 'MCC 6513 is excluded from rewards on this card' FROM s WHERE k = 3""",
    "points_conversion": f"WITH {spends()} SELECT spend_id, CAST(round({_g('0.02')} * 25 / CAST(100 AS DOUBLE)) AS BIGINT) AS rupees_paise FROM s",
    "bucket_outcomes": f"""WITH {spends()}, {GROSS}, {USED}, x AS (SELECT *, least(sbi, own_room, all_room) AS a, least(axis_capped, fast_room) AS f FROM u)
      SELECT spend_id, 'sbi-cashback' AS card_id, CASE channel WHEN 'online' THEN 'online_cap' ELSE 'offline_cap' END AS bucket_id, a AS applied_paise,
        CASE channel WHEN 'online' THEN (spend_id % 5) * 50000 ELSE (spend_id % 3) * 99990 END AS consumed_paise, own_room < sbi AND NOT all_room < least(sbi, own_room) AS clamped FROM x WHERE a > 0
      UNION ALL SELECT spend_id, 'sbi-cashback', 'overall_cap', a, (spend_id % 7) * 66000, all_room < least(sbi, own_room) FROM x WHERE a > 0
      UNION ALL SELECT spend_id, 'axis-ace', 'accelerated_cap', f, (spend_id % 11) * 5000, fast_room < axis_capped FROM x WHERE f > 0""",
    "spend_until_drop": f"""WITH {spends()}, {GROSS}, {USED}, x AS (SELECT *, least(sbi, own_room, all_room) AS a, least(axis_capped, fast_room) AS f FROM u)
      SELECT spend_id, 'sbi-cashback' AS card_id, CASE WHEN a > 0 THEN CAST(round(least(own_room, all_room) / CASE channel WHEN 'online' THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.01 AS DOUBLE) END) AS BIGINT) END AS spend_until_drop FROM x
      UNION ALL SELECT spend_id, 'axis-ace', CASE WHEN f > 0 THEN CAST(round(fast_room / CASE WHEN k = 5 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.04 AS DOUBLE) END) AS BIGINT) END FROM x
      UNION ALL SELECT spend_id, 'amazon-pay-icici', NULL FROM x""",
    "cap_gauge": f"""WITH {spends()}, {GROSS}, x AS (SELECT spend_id, 200000 AS lim, (spend_id % 5) * 50000 AS used, CASE WHEN channel = 'online' AND k <> 2 THEN sbi ELSE 0 END AS pending FROM g)
      SELECT spend_id, round(CAST(used AS DOUBLE) / lim, 6) AS used_fraction, round(CAST(pending AS DOUBLE) / lim, 6) AS pending_fraction,
        CASE WHEN used + pending >= lim THEN 'danger' WHEN CAST(used + pending AS DOUBLE) / lim >= 0.8 THEN 'warning' ELSE 'accent' END AS band,
        CASE WHEN used + pending > lim THEN {_rupees('used + pending - lim')} || '.' || lpad(CAST((used + pending - lim) % 100 AS VARCHAR), 2, '0') || ' over — drops to base rate' WHEN pending > 0 THEN 'this txn fits' ELSE {_rupees('lim - used')} || ' left this cycle' END AS status FROM x""",
    "cycle_replay": f"""WITH {spends(10)}, {GROSS}, x AS (SELECT *, CAST(coalesce(sum(axis_capped) OVER (PARTITION BY cycle_id ORDER BY spend_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM g)
      SELECT cycle_id, spend_seq, CASE WHEN axis_capped > 0 AND before < 50000 THEN least(axis_capped, 50000 - before) ELSE axis_base END AS rupees_paise FROM x""",
    "milestones": f"""WITH {spends()}, x AS (SELECT cycle_id, CAST(sum(amount_paise) AS BIGINT) AS spend_paise FROM s GROUP BY cycle_id)
      SELECT cycle_id, spend_paise, CAST(CASE WHEN spend_paise >= 1000000 THEN 50000 ELSE 0 END + CASE WHEN spend_paise >= 2500000 THEN 200000 ELSE 0 END AS BIGINT) AS milestone_paise,
        CAST(CASE WHEN spend_paise >= 1000000 THEN 1 ELSE 0 END + CASE WHEN spend_paise >= 2500000 THEN 1 ELSE 0 END AS BIGINT) AS milestones_earned FROM x""",
    "greedy_allocate": f"{_GREEDY} SELECT cycle_id, spend_seq, card AS card_id, rupees AS rupees_paise FROM t WHERE spend_seq > 0",
    "greedy_totals": f"""{_GREEDY} SELECT t.cycle_id, CAST(sum(rupees) AS BIGINT) AS reward_paise, CAST(sum(amount_paise) AS BIGINT) AS spend_paise, CAST(count(*) AS BIGINT) AS n_spends,
      round(CAST(sum(rupees) AS DOUBLE) / sum(amount_paise), 6) AS effective_rate FROM t JOIN s ON s.cycle_id = t.cycle_id AND s.spend_seq = t.spend_seq GROUP BY t.cycle_id""",
    "money_parse": f"""WITH {spends()} SELECT spend_id, CASE WHEN spend_id % 8 = 0 THEN amount_paise END AS paise, CASE WHEN amount_paise < 0 THEN '-' ELSE '' END || {_AMT} AS formatted FROM s""",
    "amount_parse": f"""WITH {spends()} SELECT spend_id, CASE WHEN spend_id % 8 IN (1, 2, 4) THEN -amount_paise WHEN spend_id % 8 IN (0, 3, 5) THEN amount_paise END AS paise,
      CASE WHEN spend_id % 8 IN (1, 2, 4, 5) THEN true WHEN spend_id % 8 IN (0, 3) THEN false END AS sign_explicit,
      CASE WHEN spend_id % 8 IN (1, 2, 4, 0, 3) THEN -amount_paise WHEN spend_id % 8 = 5 THEN amount_paise END AS debit_column FROM s""",
    "date_parse": "SELECT CAST(o_orderkey AS BIGINT) AS spend_id, CASE WHEN o_orderkey % 6 < 5 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date, o_orderkey % 6 < 5 AS at_start FROM orders",
    "format_rupees": f"""WITH {spends(997)}, x AS (SELECT spend_id, amount_paise * CASE WHEN spend_id % 3 = 0 THEN -1 ELSE 1 END AS p, CAST(amount_paise // 100 AS VARCHAR) AS w FROM s)
      SELECT spend_id, CASE WHEN p < 0 THEN '-' ELSE '' END || '₹' || CASE WHEN length(w) > 3 THEN ltrim(reverse(regexp_replace(reverse(left(w, length(w) - 3)), '(..)', '\\1,', 'g')), ',') || ',' || right(w, 3) ELSE w END || '.' || lpad(CAST(abs(p) % 100 AS VARCHAR), 2, '0') AS shown FROM x""",
    "mask_structure": "SELECT CAST(doc_id AS BIGINT) AS doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g')) AS masked_sha256 FROM documents",
    "normalise_description": "SELECT CAST(p_partkey AS BIGINT) AS part, trim(regexp_replace(upper(p_name || '  ' || p_type), ' +', ' ', 'g')) AS norm FROM part",
    "strip_noise": "SELECT CAST(p_partkey AS BIGINT) AS part, upper(replace(p_name, '-', ' ')) || ' ' || upper(replace(p_type, '-', ' ')) AS stripped FROM part",
    "trigram_similarity": """WITH x AS (SELECT p_partkey, '  ' || upper(p_name) || ' ' AS a, '  ' || upper(p_brand) || ' ' AS b FROM part),
      y AS (SELECT p_partkey, list_distinct(list_transform(range(1, length(a) - 1), lambda i: substr(a, i, 3))) AS u, list_distinct(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3))) AS v FROM x)
      SELECT CAST(p_partkey AS BIGINT) AS part, round(CAST(len(list_intersect(u, v)) AS DOUBLE) / len(list_distinct(list_concat(u, v))), 6) AS similarity FROM y""",
    "descriptor_parts": f"""WITH {spends()} SELECT spend_id, CASE p12 WHEN 8 THEN 'bankOperation' ELSE 'upi' END AS kind, CASE WHEN p12 <> 8 THEN lpad(CAST(spend_id AS VARCHAR), 12, '1') END AS reference,
      CASE WHEN p12 <> 8 THEN lower(list_extract(['Swiggy','JioHotstar','CHANGAMP','BLNKT','Zomato','TollPlaza','QQZX','UberRides','ATM','SWIGGYL','PVRINOX','AmazonPay'], CAST(p12 AS INTEGER) + 1)) END AS handle, CASE WHEN p12 <> 8 THEN 'Pay' END AS note FROM s""",
    "alias_match": f"""WITH RECURSIVE {cascade_sql.DESCRIPTORS}, {cascade_sql.cascade('d', "VALUES ('changamp', 'swiggy', 1), ('CHANGAMP', 'zepto', 2), ('Pay', 'nobody', 1), ('QQZX', 'blinkit', 1), ('qqzx', 'blinkit', 2)")}
      SELECT id AS spend_id, stage, merchant_id FROM solved""",
    "substring_baseline": f"WITH {cascade_sql.DESCRIPTORS} SELECT id AS spend_id, {cascade_sql.substring_baseline('raw')} AS merchant_id FROM d",
    "stage_histogram": f"""{_RESOLVED}, st(stage) AS (VALUES ('bankOperation'), ('userAlias'), ('exactCatalogue'), ('fuzzyCatalogue'), ('family'), ('unresolved')),
      n AS (SELECT st.stage, CAST(count(z.stage) AS BIGINT) AS n FROM st LEFT JOIN z ON z.stage = st.stage GROUP BY st.stage) SELECT stage, n, round(n * 100.0 / sum(n) OVER (), 6)::DOUBLE AS percent FROM n""",
    "mcc_distribution": f"{_RESOLVED} SELECT mcc, CAST(count(*) AS BIGINT) AS n FROM z WHERE mcc IS NOT NULL GROUP BY mcc",
    "unknown_queue": f"{_RESOLVED} SELECT coalesce(candidates[1], raw) AS payee, CAST(count(*) AS BIGINT) AS n FROM z WHERE stage = 'unresolved' GROUP BY 1",
    "cascade_vs_baseline": f"""{_RESOLVED}, y AS (SELECT *, {cascade_sql.substring_baseline('raw')} AS base FROM z)
      SELECT count(*) FILTER (merchant_id = base) AS both_agree, count(*) FILTER (merchant_id <> base) AS disagree, count(*) FILTER (merchant_id IS NOT NULL AND base IS NULL) AS cascade_only,
        count(*) FILTER (merchant_id IS NULL AND base IS NOT NULL) AS baseline_only, count(*) FILTER (stage <> 'unresolved') AS resolved, count(base) AS baseline_hits FROM y""",
    "balance_reconcile": f"{_LEDGER} SELECT cycle_id, CAST(spend_seq - 1 AS INTEGER) AS position, expected_paise, balance_paise AS actual_paise, balance_paise - expected_paise AS drift_paise FROM d WHERE expected_paise IS NOT NULL AND balance_paise IS NOT NULL",
    "consistency": f"""{_LEDGER}, m AS (SELECT cycle_id, count(*) FILTER (expected_paise IS NOT NULL AND balance_paise IS NOT NULL) AS checked, count(*) FILTER (balance_paise <> expected_paise) AS mismatches FROM d GROUP BY cycle_id)
      SELECT cycle_id, checked, mismatches, round(CASE WHEN checked = 0 THEN 1.0 ELSE CAST(checked - mismatches AS DOUBLE) / checked END, 6) AS consistency FROM m""",
    "extraction_score": f"""{_LABELS}, kt AS (SELECT doc, date, amount_paise, count(*) AS t FROM t GROUP BY ALL), kp AS (SELECT doc, date, amount_paise, count(*) AS p FROM p GROUP BY ALL),
      j AS (SELECT coalesce(kt.doc, kp.doc) AS doc, coalesce(t, 0) AS t, coalesce(p, 0) AS p FROM kt FULL JOIN kp ON kt.doc = kp.doc AND kt.date = kp.date AND kt.amount_paise = kp.amount_paise),
      a AS (SELECT doc, CAST(sum(t) AS BIGINT) AS truth, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(least(t, p)) AS BIGINT) AS matched FROM j GROUP BY doc),
      r AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(matched AS DOUBLE) / predicted WHEN truth = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN truth > 0 THEN CAST(matched AS DOUBLE) / truth ELSE 1.0 END AS q FROM a)
      SELECT doc, truth, predicted, matched, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q = 0 THEN 0.0 ELSE 2 * p * q / (p + q) END, 6) AS f1 FROM r""",
    "strict_score": f"""{_LABELS}, kt AS (SELECT doc, date, amount_paise, {_NORM} AS norm, count(*) AS t FROM t GROUP BY ALL), kp AS (SELECT doc, date, amount_paise, {_NORM} || CASE WHEN ord % 20 = 10 THEN ' X' ELSE '' END AS norm, count(*) AS p FROM p GROUP BY ALL),
      j AS (SELECT coalesce(kt.doc, kp.doc) AS doc, coalesce(t, 0) AS t, coalesce(p, 0) AS p FROM kt FULL JOIN kp ON kt.doc = kp.doc AND kt.date = kp.date AND kt.amount_paise = kp.amount_paise AND kt.norm = kp.norm),
      a AS (SELECT doc, CAST(sum(t) AS BIGINT) AS truth, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(least(t, p)) AS BIGINT) AS matched FROM j GROUP BY doc),
      r AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(matched AS DOUBLE) / predicted WHEN truth = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN truth > 0 THEN CAST(matched AS DOUBLE) / truth ELSE 1.0 END AS q FROM a)
      SELECT doc, truth, predicted, matched, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q = 0 THEN 0.0 ELSE 2 * p * q / (p + q) END, 6) AS f1 FROM r""",
    "missed_rows": f"""{_LABELS}, h AS (SELECT doc, date, amount_paise, count(*) AS have FROM p GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY doc, date, amount_paise ORDER BY ord DESC) AS nth FROM t)
      SELECT n.doc, n.ord, CAST(n.date AS VARCHAR) AS date, n.amount_paise, n.description FROM n LEFT JOIN h ON h.doc = n.doc AND h.date = n.date AND h.amount_paise = n.amount_paise WHERE nth > coalesce(have, 0)""",
    "spurious_rows": f"""{_LABELS}, h AS (SELECT doc, date, amount_paise, count(*) AS have FROM t GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY doc, date, amount_paise ORDER BY ord) AS nth FROM p)
      SELECT n.doc, n.ord, CAST(n.date AS VARCHAR) AS date, n.amount_paise, n.description FROM n LEFT JOIN h ON h.doc = n.doc AND h.date = n.date AND h.amount_paise = n.amount_paise WHERE nth > coalesce(have, 0)""",
    "row_cluster": f"{_PAGES} SELECT CAST(cycle_id AS VARCHAR) AS doc_id, page, CAST(count(*) AS BIGINT) AS n_rows FROM b GROUP BY ALL",
    "row_text": f"""{_PAGES} SELECT CAST(cycle_id AS VARCHAR) AS doc_id, page, CAST(line AS BIGINT) AS row_id,
      strftime(date, '%d-%m-%y') || ' UPI/DR/' || lpad(CAST(spend_id AS VARCHAR), 12, '1') || '/' || payee || ' - 0 ' || {_AMT} || ' ' || CAST(balance // 100 AS VARCHAR) || '.' || lpad(CAST(balance % 100 AS VARCHAR), 2, '0') AS text FROM b""",
    "table_locate": f"{_PAGES} SELECT CAST(cycle_id AS VARCHAR) AS doc_id, page, CAST(n AS BIGINT) AS anchors, CAST(n AS BIGINT) AS n_rows FROM f WHERE n >= 3 GROUP BY ALL",
    "column_detect": f"{_PAGES} SELECT CAST(cycle_id AS VARCHAR) AS doc_id, page, CAST(6 AS INTEGER) AS n_columns FROM f WHERE n >= 3 GROUP BY ALL",
    "statement_extract": f"""{_PAGES} SELECT CAST(cycle_id AS VARCHAR) AS doc_id, page, CAST(date AS VARCHAR) AS date, 'UPI/DR/' || lpad(CAST(spend_id AS VARCHAR), 12, '1') || '/' || payee AS description, -amount_paise AS amount_paise, balance AS balance_paise, true AS column_count_ok FROM f WHERE n >= 3""",
    "uneven_statements": f"""{_PAGES} SELECT CAST(cycle_id AS VARCHAR) AS doc_id, page, CAST(date AS VARCHAR) AS date, 'UPI/DR/' || lpad(CAST(spend_id AS VARCHAR), 12, '1') || '/' || payee || CASE WHEN line % 4 = 3 THEN ' VALUE DATE' ELSE '' END AS description, -amount_paise AS amount_paise, balance AS balance_paise, true AS column_count_ok FROM f WHERE n + {_EXTRA} >= 3""",
    "uneven_columns": f"{_PAGES} SELECT CAST(cycle_id AS VARCHAR) AS doc_id, page, CAST(CASE cycle_id % 2 WHEN 0 THEN 6 ELSE 4 END AS INTEGER) AS n_columns FROM f WHERE n + {_EXTRA} >= 3 GROUP BY ALL",
    "import_summary": f"WITH {spends()} SELECT CAST(count(*) AS BIGINT) AS spends, CAST(sum(amount_paise) AS BIGINT) AS spend_paise FROM s",
    "why_panel": f"""WITH {spends()}, {GROSS}, {USED}, x AS (SELECT *, least(sbi, own_room, all_room) AS a, least(axis_capped, fast_room) AS f,
        (spend_id % 7) * 66000 AS all_used, CASE channel WHEN 'online' THEN (spend_id % 5) * 50000 ELSE (spend_id % 3) * 99990 END AS own_used FROM u),
      c AS (SELECT spend_id, 0 AS card_ord, 'sbi-cashback' AS card_id, 'CASHBACK SBI Card' AS name, a AS rupees_paise, CASE WHEN a > 0 THEN channel END AS rule_id,
          CASE WHEN k = 2 THEN 'fuel spends earn nothing on this card' WHEN a <= 0 THEN 'no rule on this card matches this spend'
            ELSE CASE channel WHEN 'online' THEN '5% on online transactions' ELSE '1% on offline transactions' END ||
              CASE WHEN all_room < least(sbi, own_room) THEN ' — clipped by the Overall cashback cap' WHEN own_room < sbi THEN ' — clipped by the ' || CASE channel WHEN 'online' THEN 'Online' ELSE 'Offline' END || ' cashback cap' ELSE '' END END AS explanation,
          'www.sbicard.com' AS source_host, DATE '2026-08-15' AS retrieved_on, DATE '2026-08-15' AS valid_from, a > 0 AND (a < sbi OR 10 * (own_used + a) >= 8 * 200000 OR 10 * (all_used + a) >= 8 * 400000) AS tight FROM x
        UNION ALL SELECT spend_id, 1, 'axis-ace', 'Axis Bank ACE', CASE WHEN f > 0 THEN f ELSE axis_base END, CASE WHEN k IN (2, 3) THEN NULL WHEN f > 0 THEN CASE k WHEN 5 THEN 'utility_googlepay' ELSE 'food_and_travel' END ELSE 'base' END,
          CASE WHEN k = 2 THEN 'fuel spends earn nothing on this card' WHEN k = 3 THEN 'rent spends earn nothing on this card' WHEN f > 0 THEN CASE k WHEN 5 THEN '5% on utility bills and recharges through Google Pay' ELSE '4% on Swiggy, Zomato and Ola' END || CASE WHEN f < axis_capped THEN ' — clipped by the Accelerated cashback cap' ELSE '' END ELSE '1.5% on other eligible merchants, uncapped' END,
          'www.axis.bank.in', DATE '2026-08-15', DATE '2024-04-20', f > 0 AND (f < axis_capped OR 10 * ((spend_id % 11) * 5000 + f) >= 8 * 50000) FROM x
        UNION ALL SELECT spend_id, 2, 'amazon-pay-icici', 'Amazon Pay ICICI', icici, CASE k WHEN 4 THEN 'amazon_prime' ELSE 'base' END, CASE k WHEN 4 THEN '5% on Amazon.in for Prime members' ELSE '1% on all other payments, uncapped' END,
          'www.icici.bank.in', DATE '2026-08-15', DATE '2026-08-15', false FROM x)
      SELECT CAST(row_number() OVER (PARTITION BY spend_id ORDER BY rupees_paise DESC, card_ord) AS INTEGER) AS rank, * EXCLUDE (card_ord) FROM c""",
    "structure_inspection": f"""{_PAGES} SELECT CAST(cycle_id AS VARCHAR) AS doc_id, page, CAST(line AS BIGINT) AS row_id, CAST(96 + 18 * line AS DOUBLE) AS center_y,
      regexp_replace(regexp_replace(regexp_replace(strftime(date, '%d-%m-%y') || ' UPI/DR/' || lpad(CAST(spend_id AS VARCHAR), 12, '1') || '/' || payee || ' - 0 ' || {_AMT} || ' ' || CAST(balance // 100 AS VARCHAR) || '.' || lpad(CAST(balance % 100 AS VARCHAR), 2, '0'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g') AS masked
      FROM b WHERE page = 0 AND 96 + 18 * line BETWEEN 100 AND 200 ORDER BY doc_id, page, line LIMIT 60""",
    "cells_inspection": f"""{_PAGES}, shown AS (SELECT * FROM b WHERE page = 0 AND 96 + 18 * line BETWEEN 100 AND 200 ORDER BY CAST(cycle_id AS VARCHAR), line LIMIT 60),
      cells AS (SELECT *, [strftime(date, '%d-%m-%y'), 'UPI/DR/' || lpad(CAST(spend_id AS VARCHAR), 12, '1') || '/' || payee, '-', '0', {_AMT}, CAST(balance // 100 AS VARCHAR) || '.' || lpad(CAST(balance % 100 AS VARCHAR), 2, '0')] AS c FROM shown)
      SELECT CAST(cycle_id AS VARCHAR) AS doc_id, page, CAST(line AS BIGINT) AS row_id, CAST(96 + 18 * line AS DOUBLE) AS center_y, CAST(nth AS INTEGER) AS "column",
        regexp_replace(regexp_replace(regexp_replace(c[nth + 1], '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g') AS text FROM (SELECT *, unnest(range(6)) AS nth FROM cells)""",
    "first_mismatches": f"""{_LEDGER}, m AS (SELECT *, row_number() OVER (PARTITION BY cycle_id ORDER BY spend_seq) AS nth FROM d WHERE balance_paise <> expected_paise)
      SELECT cycle_id, CAST(spend_seq - 1 AS INTEGER) AS position, expected_paise, balance_paise AS actual_paise, balance_paise - expected_paise AS drift_paise FROM m WHERE nth <= 5""",
    "spend_projection": f"{_RESOLVED} SELECT s.spend_id, CAST(s.date AS VARCHAR) AS date, s.amount_paise, 'online' AS channel, z.mcc, z.merchant_id FROM s JOIN z ON z.spend_id = s.spend_id WHERE s.spend_id % 3 <> 0",
    "extraction_report": f"""{_PAGES}, g AS (SELECT *, 8 + length(replace('UPI/DR/' || lpad(CAST(spend_id AS VARCHAR), 12, '1') || '/' || payee, ' ', '')) + 2 + length({_AMT}) + length(CAST(balance // 100 AS VARCHAR)) + 3 AS chars,
        row_number() OVER (PARTITION BY cycle_id ORDER BY spend_seq) AS at FROM f)
      SELECT CAST(cycle_id AS VARCHAR) AS doc_id, CAST(sum(chars) AS BIGINT) AS glyphs, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT page) FILTER (n >= 3) AS BIGINT) AS tables, CAST(count(*) FILTER (n >= 3) AS BIGINT) AS transactions,
        CAST(greatest(count(*) FILTER (n >= 3) - 1, 0) AS BIGINT) AS checked, CAST(0 AS BIGINT) AS mismatches, CAST(1 AS DOUBLE) AS consistency FROM g GROUP BY cycle_id""",
}

_QUEUE = f"""WITH RECURSIVE {cascade_sql.SHOPS}, {cascade_sql.cascade('d')}, lines AS (SELECT stage = 'unresolved' AS unknown, coalesce(candidates[1], raw) AS payee FROM solved),
    q AS (SELECT payee, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, payee) AS top_n FROM lines WHERE unknown GROUP BY payee)"""
_POOLED = f"""SELECT CAST(count(*) AS BIGINT) AS statements, CAST(sum(glyphs) AS BIGINT) AS glyphs, CAST(sum("rows") AS BIGINT) AS "rows", CAST(sum(tables) AS BIGINT) AS tables, CAST(sum(transactions) AS BIGINT) AS transactions,
    CAST(sum(checked) AS BIGINT) AS checked, CAST(sum(mismatches) AS BIGINT) AS mismatches, CASE WHEN sum(checked) = 0 THEN CAST(1 AS DOUBLE) ELSE round((sum(checked) - sum(mismatches)) / CAST(sum(checked) AS DOUBLE), 6) END AS consistency
    FROM ({SQL['extraction_report']})"""
_PRESETS = "(VALUES ('swiggy', 'online', 0), ('amazon', 'online', 4), ('utility', 'online', 5), ('grocery', 'offline', 6), ('fuel', 'offline', 2), ('rent', 'online', 3)) v(preset, channel, k)"

SQL |= {
    "unknown_report": f"""{_QUEUE} SELECT regexp_replace(regexp_replace(payee, '[A-Z]', 'A', 'g'), '[0-9]', '9', 'g') AS payee, CAST(n AS BIGINT) AS n FROM q WHERE top_n <= 25""",
    "label_coverage": f"""{_QUEUE}, c AS (SELECT top_n, sum(n) OVER (ORDER BY top_n) AS covered FROM q)
      SELECT CAST(top_n AS INTEGER) AS top_n, CAST(covered AS BIGINT) AS covered, round(covered * 100.0 / (SELECT count(*) FILTER (unknown) FROM lines), 6) AS percent_of_queue, round(covered * 100.0 / (SELECT count(*) FROM lines), 6) AS percent_of_all
      FROM c WHERE top_n IN (5, 10, 20, 50)""",
    "pooled_totals": _POOLED,
    "import_metrics": f"""{_RESOLVED} SELECT p.* EXCLUDE (statements), (SELECT count(*) FROM z WHERE stage = 'unresolved') AS unresolved,
      (SELECT count(DISTINCT coalesce(candidates[1], raw)) FROM z WHERE stage = 'unresolved') AS unknown_payees FROM ({_POOLED}) p""",
    "pending_per_bucket": f"""WITH o AS ({SQL['bucket_outcomes']}), b(card_id, bucket_id) AS (VALUES ('sbi-cashback', 'online_cap'), ('sbi-cashback', 'offline_cap'), ('sbi-cashback', 'overall_cap'), ('axis-ace', 'accelerated_cap'))
      SELECT CAST(s.o_orderkey AS BIGINT) AS spend_id, b.card_id, b.bucket_id, CAST(coalesce(o.applied_paise, 0) AS BIGINT) AS pending_paise
      FROM orders s CROSS JOIN b LEFT JOIN o ON o.spend_id = s.o_orderkey AND o.card_id = b.card_id AND o.bucket_id = b.bucket_id""",
    "asked_presets": f"""WITH {spends()}, a AS (SELECT spend_id, amount_paise // 100 * 100 AS amount_paise FROM s),
      p AS (SELECT a.spend_id, a.amount_paise, v.preset, v.channel, v.k FROM a CROSS JOIN {_PRESETS}), {GROSS.replace('FROM s)', 'FROM p)')}, {EMPTY}
      SELECT spend_id, preset, 'sbi-cashback' AS card_id, amount_paise, sbi_paid AS rupees_paise FROM r UNION ALL SELECT spend_id, preset, 'axis-ace', amount_paise, axis_paid FROM r
      UNION ALL SELECT spend_id, preset, 'amazon-pay-icici', amount_paise, icici FROM r""",
}


def _from_state(card: str) -> str:
    """The fold of a cycle whose buckets hold something at its start; ``card`` chooses among a, b and icici."""
    return f"""WITH RECURSIVE {spends(10)}, {GROSS}, t(cycle_id, spend_seq, online, offline, overall, fast, card, rupees) AS (
      SELECT DISTINCT cycle_id, CAST(0 AS BIGINT), CAST(cycle_id % 5 * 50000 AS BIGINT), CAST(cycle_id % 3 * 99990 AS BIGINT), CAST(cycle_id % 7 * 66000 AS BIGINT), CAST(cycle_id % 11 * 5000 AS BIGINT), CAST('' AS VARCHAR), CAST(0 AS BIGINT) FROM g
      UNION ALL
      SELECT cycle_id, spend_seq, online + CASE WHEN card = 'sbi-cashback' AND channel = 'online' THEN a ELSE 0 END, offline + CASE WHEN card = 'sbi-cashback' AND channel <> 'online' THEN a ELSE 0 END,
        overall + CASE WHEN card = 'sbi-cashback' THEN a ELSE 0 END, fast + CASE WHEN card = 'axis-ace' THEN f ELSE 0 END, card, CASE card WHEN 'sbi-cashback' THEN a WHEN 'axis-ace' THEN b ELSE icici END
      FROM (SELECT *, {card} AS card FROM (SELECT *, CASE WHEN f > 0 THEN f ELSE axis_base END AS b FROM (
        SELECT g.*, t.online, t.offline, t.overall, t.fast, greatest(0, least(sbi, CASE WHEN channel = 'online' THEN 200000 - t.online ELSE 200000 - t.offline END, 400000 - t.overall)) AS a, greatest(0, least(axis_capped, 50000 - t.fast)) AS f
        FROM t JOIN g ON g.cycle_id = t.cycle_id AND g.spend_seq = t.spend_seq + 1))))"""


SQL |= {
    "greedy_from_state": f"""{_from_state("CASE WHEN a >= b AND a >= icici THEN 'sbi-cashback' WHEN b >= icici THEN 'axis-ace' ELSE 'amazon-pay-icici' END")} SELECT cycle_id, spend_seq, card AS card_id, rupees AS rupees_paise FROM t WHERE spend_seq > 0""",
    "mixed_replay": f"""{_from_state("CASE spend_seq % 3 WHEN 0 THEN 'sbi-cashback' WHEN 1 THEN 'axis-ace' ELSE 'amazon-pay-icici' END")}, k(card_id) AS (VALUES ('sbi-cashback'), ('axis-ace'), ('amazon-pay-icici')),
      o AS (SELECT t.cycle_id, t.card AS card_id, t.rupees, s.amount_paise FROM t JOIN s ON s.cycle_id = t.cycle_id AND s.spend_seq = t.spend_seq),
      p AS (SELECT y.cycle_id, k.card_id, CAST(count(o.rupees) AS BIGINT) AS n_spends, CAST(coalesce(sum(o.amount_paise), 0) AS BIGINT) AS spend_paise, CAST(coalesce(sum(o.rupees), 0) AS BIGINT) AS reward_paise
        FROM (SELECT DISTINCT cycle_id FROM s) y CROSS JOIN k LEFT JOIN o ON o.cycle_id = y.cycle_id AND o.card_id = k.card_id GROUP BY ALL)
      SELECT *, CAST(CASE WHEN card_id = 'amazon-pay-icici' THEN CASE WHEN spend_paise >= 10000000 THEN 50000 ELSE 0 END + CASE WHEN spend_paise >= 25000000 THEN 200000 ELSE 0 END ELSE 0 END AS BIGINT) AS milestone_paise,
        CASE WHEN card_id <> 'amazon-pay-icici' OR spend_paise < 10000000 THEN '' WHEN spend_paise < 25000000 THEN 'a' ELSE 'a,b' END AS milestones_earned FROM p""",
}
SQL |= {
    "glyph_round_trip": f"""{_PAGES}, x AS (SELECT *, strftime(date, '%d-%m-%y') || ' UPI/DR/' || lpad(CAST(spend_id AS VARCHAR), 12, '1') || '/' || payee || ' - 0 ' || {_AMT} || ' ' || CAST(balance // 100 AS VARCHAR) || '.' || lpad(CAST(balance % 100 AS VARCHAR), 2, '0') AS text FROM b)
      SELECT 'stmt.' || CAST(cycle_id AS VARCHAR) AS doc_id, page, CAST(line AS BIGINT) AS row_id, text, CAST(length(replace(text, ' ', '')) AS INTEGER) AS n_glyphs FROM x""",
    "labelled_round_trip": f"""WITH {spends()} SELECT 'cust.' || CAST(cycle_id AS VARCHAR) AS statement_id, 'sbi' AS issuer, 'fixtures/' || CAST(cycle_id AS VARCHAR) || '.json' AS glyph_fixture, CAST(spend_seq - 1 AS INTEGER) AS ord, CAST(date AS VARCHAR) AS date,
      list_extract({cascade_sql.lit(cascade_sql.domain.PAYEES)}, CAST(p12 AS INTEGER) + 1) AS description, -amount_paise AS amount_paise FROM s""",
}



def _winner(amount: str) -> str:
    """Of the first two cards: 0, 1, or null where neither pays."""
    pay = lambda rate: f"CAST(round(CAST({amount} AS DOUBLE) * CAST({rate} AS DOUBLE)) AS BIGINT)"
    sbi = f"CASE WHEN k = 2 THEN 0 ELSE least({pay('sbi_rate')}, sbi_room) END"
    axis = f"CASE WHEN k IN (2, 3) THEN 0 WHEN fast_rate > 0 AND least({pay('fast_rate')}, fast_room) > 0 THEN least({pay('fast_rate')}, fast_room) ELSE {pay('0.015')} END"
    return f"CASE WHEN greatest({sbi}, {axis}) <= 0 THEN NULL WHEN {sbi} >= {axis} THEN 0 ELSE 1 END"


# doubling and halving one step a round; the change itself among the amounts around each level passed
SQL["recommendation_flip"] = f"""WITH RECURSIVE {spends()}, {GROSS}, {USED},
  c AS (SELECT spend_id, k, amount_paise AS start, CASE channel WHEN 'online' THEN 0.05 ELSE 0.01 END AS sbi_rate, least(own_room, all_room) AS sbi_room, CASE WHEN k = 5 THEN 0.05 WHEN k IN (0, 7) THEN 0.04 ELSE 0 END AS fast_rate, fast_room FROM u),
  f AS (SELECT *, {_winner('start')} AS first FROM c),
  t(spend_id, low, high, halving) AS (
    SELECT spend_id, start, 2 * start + 100, false FROM f WHERE first IS NOT NULL
    UNION ALL
    SELECT spend_id, CASE WHEN same THEN probe ELSE low END, CASE WHEN halving THEN CASE WHEN same THEN high ELSE probe END WHEN same THEN 2 * high ELSE high END, halving OR NOT same
    FROM (SELECT *, {_winner('probe')} IS NOT DISTINCT FROM first AS same FROM (SELECT t.*, f.* EXCLUDE (spend_id), CASE WHEN halving THEN low + (high - low) // 2 ELSE high END AS probe FROM t JOIN f ON f.spend_id = t.spend_id)
      WHERE CASE WHEN halving THEN low + 100 < high ELSE high <= 50000000 END)),
  flip AS (SELECT spend_id, max(high) AS flip_paise FROM (SELECT *, row_number() OVER (PARTITION BY spend_id ORDER BY halving DESC, high - low) AS nth FROM t WHERE halving) WHERE nth = 1 GROUP BY spend_id),
  near AS (SELECT f.*, unnest([sbi_room / 0.015, sbi_room / nullif(fast_rate, 0), fast_room / sbi_rate]) AS a FROM f WHERE first IS NOT NULL),
  tried AS (SELECT *, CAST(floor(a) AS BIGINT) + d AS amount FROM (SELECT *, unnest(range(-101, 102)) AS d FROM near WHERE a IS NOT NULL)),
  change AS (SELECT spend_id, min(amount) AS changes_at_paise FROM tried WHERE amount > start AND amount <= 50000000 AND {_winner('amount')} IS DISTINCT FROM first GROUP BY spend_id)
  SELECT c.spend_id, flip_paise, changes_at_paise FROM c LEFT JOIN flip ON flip.spend_id = c.spend_id LEFT JOIN change ON change.spend_id = c.spend_id"""

# what each card pays for every subset of a cycle, and the best pair of disjoint subsets on the first two
# cards, the rest on the third, whose rules have no cap

def _searched(scale: int, told: str) -> str:
    return f"""WITH RECURSIVE l AS (SELECT l_orderkey AS cycle_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS spend_seq, count(*) OVER (PARTITION BY l_orderkey) AS n,
    CAST(round(l_extendedprice) AS BIGINT) * {scale} AS amount_paise, CASE WHEN l_linenumber % 2 = 0 THEN 'online' ELSE 'offline' END AS channel, p_size % 8 AS k FROM lineitem JOIN part ON p_partkey = l_partkey),
  s AS (SELECT * FROM l WHERE n <= 12), {GROSS},
  v(cycle_id, j, mask, online, offline, fast, sbi, axis, icici) AS (
    SELECT DISTINCT cycle_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM g
    UNION ALL
    SELECT cycle_id, j + 1, mask + take * (1 << j), online + take * CASE channel WHEN 'online' THEN a ELSE 0 END, offline + take * CASE channel WHEN 'online' THEN 0 ELSE a END, fast + take * greatest(f, 0), sbi + take * a, axis + take * CASE WHEN f > 0 THEN f ELSE axis_base END, icici + take * own
    FROM (SELECT v.*, g.channel, g.axis_base, g.icici AS own, greatest(0, least(g.sbi, CASE g.channel WHEN 'online' THEN 200000 - v.online ELSE 200000 - v.offline END, 400000 - v.online - v.offline)) AS a, least(g.axis_capped, 50000 - v.fast) AS f
      FROM v JOIN g ON g.cycle_id = v.cycle_id AND g.spend_seq = v.j + 1), (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) t(take)),
  w AS (SELECT v.* FROM v JOIN (SELECT DISTINCT cycle_id, n FROM s) m ON m.cycle_id = v.cycle_id AND m.n = v.j),
  whole AS (SELECT cycle_id, icici AS every FROM (SELECT *, row_number() OVER (PARTITION BY cycle_id ORDER BY mask DESC) AS nth FROM w) WHERE nth = 1),
  best AS (SELECT a.cycle_id, max(a.sbi - a.icici + b.axis - b.icici) AS more FROM w a JOIN w b ON a.cycle_id = b.cycle_id AND a.mask & b.mask = 0 GROUP BY a.cycle_id),
  t(cycle_id, j, online, offline, fast, paid) AS (
    SELECT DISTINCT cycle_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM g
    UNION ALL
    SELECT cycle_id, j + 1, online + CASE WHEN a >= b AND a >= own AND channel = 'online' THEN a ELSE 0 END, offline + CASE WHEN a >= b AND a >= own AND channel <> 'online' THEN a ELSE 0 END, fast + CASE WHEN a < b AND b >= own AND f > 0 THEN f ELSE 0 END, paid + greatest(a, b, own)
    FROM (SELECT *, CASE WHEN f > 0 THEN f ELSE axis_base END AS b FROM (SELECT t.*, g.channel, g.axis_base, g.icici AS own, greatest(0, least(g.sbi, CASE g.channel WHEN 'online' THEN 200000 - t.online ELSE 200000 - t.offline END)) AS a, least(g.axis_capped, 50000 - t.fast) AS f
      FROM t JOIN g ON g.cycle_id = t.cycle_id AND g.spend_seq = t.j + 1))),
  greedy AS (SELECT cycle_id, max(paid) AS paid FROM t GROUP BY cycle_id)
  SELECT CAST(best.cycle_id AS BIGINT) AS cycle_id, CAST(paid AS BIGINT) AS greedy_paise, CAST(every + more AS BIGINT) AS optimum_paise{told} FROM best JOIN whole ON whole.cycle_id = best.cycle_id JOIN greedy ON greedy.cycle_id = best.cycle_id"""


SQL["allocation_bounds"] = _searched(50, ", true AS between")
# at these amounts no cap is shared out wrongly, so the climb reaches the optimum
SQL["brute_force"] = f"SELECT cycle_id, optimum_paise AS allocated_paise, optimum_paise FROM ({_searched(1, '')})"

_CYCLES = f"""WITH RECURSIVE {spends(10)}, {GROSS}, scaled AS (SELECT 10 AS scale, * FROM g), {search_sql.routed('scaled')}"""
_SWEEP = f"""WITH RECURSIVE {spends()}, s1 AS (SELECT v.scale, s.* REPLACE (s.amount_paise * v.scale AS amount_paise) FROM s CROSS JOIN (VALUES (1), (2), (4), (8), (16), (32)) v(scale)), {GROSS.replace('FROM s)', 'FROM s1)')}, {search_sql.routed('g')}"""
SQL |= {
    "allocate_cycle": f"{_CYCLES} SELECT cycle_id, n_spends, spend_paise, greedy_paise, allocated_paise FROM routed",
    "leakage_report": f"{_CYCLES} SELECT {search_sql.REPORT} FROM routed",
    "leakage_sweep": f"{_SWEEP} SELECT CAST(scale AS BIGINT) AS scale, {search_sql.REPORT} FROM routed GROUP BY scale",
}

# the import resolves the printed descriptions, whose payees have no spaces
SQL["import_events"] = f"""WITH RECURSIVE st AS ({SQL['statement_extract']}), d AS (SELECT row_number() OVER () AS id, description AS raw FROM st), {cascade_sql.cascade('d')}, t AS ({_POOLED}),
  u AS (SELECT CAST(count(*) AS BIGINT) AS unresolved, CAST(count(DISTINCT coalesce(candidates[1], raw)) AS BIGINT) AS unknown_payees FROM solved WHERE stage = 'unresolved'),
  e(seq, kind, stage, label) AS (VALUES (1, 'progress', 'reading', 'Reading the PDF'), (2, 'progress', 'extractingGlyphs', 'Extracting glyphs'), (3, 'progress', 'clusteringRows', 'Finding rows'), (4, 'progress', 'detectingColumns', 'Detecting columns'),
    (5, 'progress', 'extractingTransactions', 'Reading transactions'), (6, 'progress', 'resolvingMerchants', 'Identifying merchants'), (7, 'progress', 'done', 'Done'), (8, 'succeeded', NULL, NULL))
  SELECT CAST(seq AS INTEGER) AS seq, kind, stage, label, CASE seq WHEN 4 THEN "rows" || ' rows' WHEN 5 THEN tables || ' tables' WHEN 6 THEN transactions || ' transactions' END AS detail, false AS needs_password,
    CASE seq WHEN 8 THEN glyphs END AS glyphs, CASE seq WHEN 8 THEN "rows" END AS "rows", CASE seq WHEN 8 THEN tables END AS tables, CASE seq WHEN 8 THEN transactions END AS transactions, CASE seq WHEN 8 THEN checked END AS checked,
    CASE seq WHEN 8 THEN mismatches END AS mismatches, CASE seq WHEN 8 THEN unresolved END AS unresolved, CASE seq WHEN 8 THEN unknown_payees END AS unknown_payees, CASE seq WHEN 8 THEN consistency END AS consistency
  FROM e, t, u"""
SQL |= cascade_sql.sql(SQL["statement_extract"])
