"""Oracle SQL (DuckDB dialect) for the registered queries.

Written independently of the DataFrame plans: correlated subqueries and plain
aggregates instead of the salted windows, so that agreement means something.
"""

from __future__ import annotations

from riskloom.sources.bindings import SQL_ID, SQL_ORDERS_TX, SQL_SCORED, SQL_TX, with_sql

ORACLE: dict[str, str] = {}


def r6(x: str) -> str:
    return f"floor(({x}) * 1000000 + 0.5) / 1000000"


BEFORE = "(h.TransactionDT < t.TransactionDT OR (h.TransactionDT = t.TransactionDT AND h.TransactionID < t.TransactionID))"
EARLIER = "h.TransactionDT < t.TransactionDT"

MERGED = with_sql(SQL_TX, SQL_ID) + """,
idd AS (SELECT TransactionID, DeviceInfo FROM (
          SELECT *, row_number() OVER (PARTITION BY TransactionID ORDER BY DeviceInfo NULLS LAST) AS rn FROM idt)
        WHERE rn = 1),
m AS (SELECT tx.*, i.DeviceInfo, CASE WHEN i.TransactionID IS NULL THEN 0 ELSE 1 END AS has_identity
      FROM tx LEFT JOIN idd i ON tx.TransactionID = i.TransactionID)"""


def _basic_cols() -> str:
    return f"""
  CAST(t.TransactionAmt AS DOUBLE) AS TransactionAmt_x,
  {r6('ln(1 + t.TransactionAmt)')} AS TransactionAmt_log,
  CAST((t.TransactionDT // 3600) % 24 AS BIGINT) AS transaction_hour,
  CAST(t.TransactionDT // 86400 AS BIGINT) AS transaction_day,
  CAST(t.has_identity AS BIGINT) AS has_identity,
  CAST(t.card1 IS NULL OR t.card2 IS NULL OR t.card3 IS NULL OR t.card4 IS NULL OR t.card5 IS NULL OR t.card6 IS NULL AS BIGINT) AS missing_card_info,
  CAST(t.addr1 IS NULL OR t.addr2 IS NULL AS BIGINT) AS missing_address,
  CAST((t.card2 IS NULL)::INT + (t.addr1 IS NULL)::INT + (t.addr2 IS NULL)::INT + (t.DeviceInfo IS NULL)::INT
       + (t.TransactionAmt IS NULL)::INT * 2 AS BIGINT) AS missing_value_count"""


def _batch_cols(src: str, rounded: bool = True) -> str:
    rr = r6 if rounded else (lambda x: x)
    money = "CAST(h.TransactionAmt AS DECIMAL(38,6))"
    cnt = f"(SELECT count(*) FROM {src} h WHERE h.card1 = t.card1 AND {BEFORE})"
    avg = f"(SELECT sum({money}) / count(*) FROM {src} h WHERE h.card1 = t.card1 AND {BEFORE})"
    return f"""
  {cnt} AS card_transaction_count,
  {rr(avg)} AS card_avg_amount,
  {rr(f'CASE WHEN {avg} = 0 THEN NULL ELSE t.TransactionAmt / {avg} END')} AS amount_vs_card_avg,
  CAST({cnt} = 0 AS BIGINT) AS new_card,
  (SELECT count(*) FROM {src} h WHERE h.card1 = t.card1 AND {BEFORE} AND h.TransactionDT >= t.TransactionDT - 3600) AS card_txn_count_1h,
  (SELECT count(*) FROM {src} h WHERE h.card1 = t.card1 AND {BEFORE} AND h.TransactionDT >= t.TransactionDT - 86400) AS card_txn_count_24h,
  CAST(t.DeviceInfo IS NOT NULL AS BIGINT) AS has_device_info,
  CASE WHEN t.DeviceInfo IS NULL THEN 0 ELSE (SELECT count(*) FROM {src} h WHERE h.DeviceInfo = t.DeviceInfo AND {BEFORE}) END AS device_profile_count,
  CASE WHEN t.DeviceInfo IS NULL THEN 0 ELSE (SELECT count(DISTINCT h.card1) FROM {src} h WHERE h.DeviceInfo = t.DeviceInfo AND {BEFORE}) END AS device_profile_unique_cards,
  CAST(t.DeviceInfo IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {src} h WHERE h.DeviceInfo = t.DeviceInfo AND {BEFORE}) AS BIGINT) AS new_device_profile,
  CASE WHEN t.DeviceInfo IS NULL THEN 0 ELSE (SELECT count(*) FROM {src} h WHERE h.DeviceInfo = t.DeviceInfo AND h.card1 = t.card1 AND {BEFORE}) END AS card_device_transaction_count,
  CAST(t.DeviceInfo IS NOT NULL AND EXISTS (SELECT 1 FROM {src} h WHERE h.DeviceInfo = t.DeviceInfo AND h.card1 = t.card1 AND {BEFORE}) AS BIGINT) AS card_device_seen_before,
  CASE WHEN t.DeviceInfo IS NULL THEN 0 ELSE
    (SELECT count(DISTINCT h.card1) FROM {src} h WHERE h.DeviceInfo = t.DeviceInfo AND h.card1 < t.card1)
    + CAST(EXISTS (SELECT 1 FROM {src} h WHERE h.DeviceInfo = t.DeviceInfo AND h.card1 = t.card1 AND {BEFORE}) AS BIGINT) END
    AS device_unique_cards_historical"""


def _pit_cols(src: str, rounded: bool = True) -> str:
    rr = r6 if rounded else (lambda x: x)
    money = "CAST(h.TransactionAmt AS DECIMAL(38,6))"
    cnt = f"(SELECT count(*) FROM {src} h WHERE h.card1 = t.card1 AND {EARLIER})"
    avg = (f"coalesce((SELECT sum({money}) / count(h.TransactionAmt) FROM {src} h "
           f"WHERE h.card1 = t.card1 AND {EARLIER} AND h.TransactionAmt IS NOT NULL), 0)")
    dev_ok = "(t.DeviceInfo IS NOT NULL AND trim(t.DeviceInfo) <> '')"
    dcnt = f"(SELECT count(*) FROM {src} h WHERE h.DeviceInfo = t.DeviceInfo AND {EARLIER})"
    pcnt = f"(SELECT count(*) FROM {src} h WHERE h.DeviceInfo = t.DeviceInfo AND h.card1 = t.card1 AND {EARLIER})"
    return f"""
  {cnt} AS card_transaction_count,
  {rr(avg)} AS card_avg_amount,
  {rr(f'CASE WHEN {avg} > 0 THEN coalesce(t.TransactionAmt, 0) / {avg} ELSE 0 END')} AS amount_vs_card_avg,
  CAST({cnt} = 0 AS BIGINT) AS new_card,
  (SELECT count(*) FROM {src} h WHERE h.card1 = t.card1 AND h.TransactionDT BETWEEN t.TransactionDT - 3600 AND t.TransactionDT - 1) AS card_txn_count_1h,
  (SELECT count(*) FROM {src} h WHERE h.card1 = t.card1 AND h.TransactionDT BETWEEN t.TransactionDT - 86400 AND t.TransactionDT - 1) AS card_txn_count_24h,
  CAST({dev_ok} AS BIGINT) AS has_device_info,
  CASE WHEN {dev_ok} THEN {dcnt} ELSE 0 END AS device_profile_count,
  CASE WHEN {dev_ok} THEN (SELECT count(DISTINCT h.card1) FROM {src} h WHERE h.DeviceInfo = t.DeviceInfo AND {EARLIER}) ELSE 0 END AS device_profile_unique_cards,
  CASE WHEN {dev_ok} THEN CAST({dcnt} = 0 AS BIGINT) ELSE 1 END AS new_device_profile,
  CASE WHEN {dev_ok} THEN {pcnt} ELSE 0 END AS card_device_transaction_count,
  CASE WHEN {dev_ok} THEN CAST({pcnt} > 0 AS BIGINT) ELSE 0 END AS card_device_seen_before,
  CASE WHEN {dev_ok} THEN (SELECT count(DISTINCT h.card1) FROM {src} h WHERE h.DeviceInfo = t.DeviceInfo AND h.card1 < t.card1) ELSE 0 END
    AS device_unique_cards_historical"""


ORACLE["features_batch"] = MERGED + f"""
SELECT t.TransactionID, {_basic_cols().replace('TransactionAmt_x', 'TransactionAmt')}, {_batch_cols('m')}
FROM m t"""

ORACLE["features_pit"] = MERGED + f"""
SELECT t.TransactionID, {_basic_cols().replace('TransactionAmt_x', 'TransactionAmt')}, {_pit_cols('m')}
FROM m t"""

ORACLE["features_batch_ties"] = with_sql(SQL_ORDERS_TX) + f"""
SELECT t.TransactionID, {_batch_cols('otx')} FROM otx t"""

ORACLE["features_pit_ties"] = with_sql(SQL_ORDERS_TX) + f"""
SELECT t.TransactionID, {_pit_cols('otx')} FROM otx t"""


# --- shared CTEs for the rule / metric oracles ------------------------------------
PROBE_START = 25 * 86400
FB = MERGED + f""",
fb AS (SELECT t.*, {_batch_cols('m', rounded=False)},
         floor(1.0 / (1.0 + exp(-(ln(1 + t.TransactionAmt) - 3.5 + 0.05 * ((t.TransactionDT // 3600) % 24))))
               * 100 + 0.5) / 100 AS score,
         t.isFraud AS y
       FROM m t)"""
PROBES = MERGED + f""",
hist AS (SELECT * FROM m WHERE TransactionDT < {PROBE_START}),
pr AS (SELECT * REPLACE (CASE WHEN TransactionID % 20 = 0 THEN 'unknown-device' ELSE DeviceInfo END AS DeviceInfo)
       FROM m WHERE TransactionDT >= {PROBE_START})"""

ORACLE["identity_keep_first"] = MERGED + "\nSELECT TransactionID, DeviceInfo FROM idd"

ORACLE["identity_rate_by_label"] = MERGED + f"""
SELECT isFraud, count(*) AS rows, CAST(sum(has_identity) AS BIGINT) AS with_identity,
       {r6('avg(has_identity)')} AS identity_rate
FROM m GROUP BY isFraud"""

ORACLE["history_lookup"] = PROBES + f"""
SELECT t.TransactionID, {_basic_cols().replace('TransactionAmt_x', 'TransactionAmt')}, {_pit_cols('hist')} FROM pr t"""

ORACLE["profile_lookup"] = ORACLE["history_lookup"]

ORACLE["cold_start_flags"] = PROBES + f""",
c AS (SELECT t.TransactionID, t.card1, t.TransactionDT, t.DeviceInfo,
        (SELECT count(*) FROM hist h WHERE h.card1 = t.card1 AND h.TransactionDT < t.TransactionDT) AS cc,
        (SELECT count(*) FROM hist h WHERE h.DeviceInfo = t.DeviceInfo AND h.TransactionDT < t.TransactionDT) AS dc,
        (SELECT count(*) FROM hist h WHERE h.DeviceInfo = t.DeviceInfo AND h.card1 = t.card1
                                     AND h.TransactionDT < t.TransactionDT) AS pc
      FROM pr t),
f AS (SELECT TransactionID,
        (card1 IS NOT NULL AND TransactionDT IS NOT NULL AND cc > 0) AS ch,
        (card1 IS NOT NULL AND TransactionDT IS NOT NULL AND DeviceInfo IS NOT NULL AND trim(DeviceInfo) <> ''
         AND upper(DeviceInfo) <> 'UNKNOWN-DEVICE' AND dc > 0) AS dh, pc FROM c)
SELECT TransactionID, CAST(NOT ch AS BIGINT) AS is_new_card, CAST(NOT dh AS BIGINT) AS is_new_device,
       CAST(NOT (ch AND dh AND pc > 0) AS BIGINT) AS is_new_card_device_pair,
       CAST(ch AS BIGINT) AS card_history_available, CAST(dh AS BIGINT) AS device_history_available,
       CAST(ch AND dh AND pc > 0 AS BIGINT) AS card_device_history_available
FROM f"""

ORACLE["card_profile"] = PROBES + f"""
SELECT t.TransactionID,
  (SELECT count(*) FROM hist h WHERE h.card1 = t.card1 AND h.TransactionDT < t.TransactionDT) AS card_history_count,
  {r6("coalesce((SELECT sum(CAST(h.TransactionAmt AS DECIMAL(38,6))) / count(h.TransactionAmt) FROM hist h WHERE h.card1 = t.card1 AND h.TransactionDT < t.TransactionDT AND h.TransactionAmt IS NOT NULL), 0)")} AS card_history_mean,
  {r6("coalesce((SELECT max(h.TransactionAmt) FROM hist h WHERE h.card1 = t.card1 AND h.TransactionDT < t.TransactionDT), 0)")} AS card_history_max,
  {r6("coalesce((SELECT min(h.TransactionAmt) FROM hist h WHERE h.card1 = t.card1 AND h.TransactionDT < t.TransactionDT), 0)")} AS card_history_min
FROM pr t"""

# Rule flags in the fixed order, with the registered test thresholds.
RULES = FB + """,
rf AS (SELECT *,
   (new_card = 1) AS nc, (new_device_profile = 1) AS nd,
   CAST(score >= 0.8 AS INT) AS r0,
   CAST(score < 0.8 AND score >= 0.6 AS INT) AS r1,
   CAST(new_card = 1 AND new_device_profile = 1 AND coalesce(TransactionAmt, 0) >= 150 AS INT) AS r2,
   CAST(NOT (new_card = 1 AND new_device_profile = 1) AND new_card = 1 AS INT) AS r3,
   CAST(NOT (new_card = 1 AND new_device_profile = 1) AND new_device_profile = 1 AS INT) AS r4,
   CAST(card_txn_count_1h >= 2 OR card_txn_count_24h >= 5 AS INT) AS r5,
   CAST(device_profile_unique_cards >= 140 AS INT) AS r6,
   CAST(new_card = 0 AND amount_vs_card_avg IS NOT NULL AND NOT isnan(amount_vs_card_avg)
        AND amount_vs_card_avg >= 3 AS INT) AS r7
 FROM fb)"""


def _score_level(h: str, m: str) -> str:
    return f"""CAST(CASE WHEN {h} >= 2 THEN 0.9 WHEN {h} = 1 THEN 0.85 WHEN {m} >= 2 THEN 0.65 WHEN {m} = 1 THEN 0.5
              ELSE 0.0 END AS DOUBLE) AS behavioral_risk_score,
       CASE WHEN {h} >= 1 THEN 'HIGH' WHEN {m} >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS behavioral_risk_level"""


ORACLE["rules_batch"] = RULES + f"""
SELECT TransactionID,
  concat_ws(',', CASE WHEN r2 = 1 THEN 'NEW_CARD_NEW_DEVICE_HIGH_AMOUNT' END, CASE WHEN r3 = 1 THEN 'NEW_CARD' END,
            CASE WHEN r4 = 1 THEN 'NEW_DEVICE' END, CASE WHEN r5 = 1 THEN 'HIGH_CARD_VELOCITY' END,
            CASE WHEN r6 = 1 THEN 'SHARED_DEVICE' END, CASE WHEN r7 = 1 THEN 'UNUSUAL_AMOUNT' END) AS rule_ids,
  CAST(r2 + r3 + r4 + r5 + r6 + r7 AS BIGINT) AS n_rules,
  {_score_level('(r5 + r6)', '(r2 + r3 + r4 + r7)')}
FROM rf"""

_REASONS = {
    0: ("HIGH_MODEL_RISK", "HIGH", "'Model risk score (' || printf('%.4f', score) || ') meets or exceeds high threshold (0.8).'"),
    1: ("MEDIUM_MODEL_RISK", "MEDIUM", "'Model risk score (' || printf('%.4f', score) || ') meets or exceeds medium threshold (0.6).'"),
    2: ("NEW_CARD_NEW_DEVICE_HIGH_AMOUNT", "MEDIUM",
        "'Transaction uses both a new card and a new device with a high amount ($' || printf('%.2f', coalesce(TransactionAmt, 0)) || ' >= $150.00); no prior history exists, so this is treated as a moderate signal rather than automatic high risk.'"),
    3: ("NEW_CARD", "MEDIUM", "'The payment card has no prior observed history; this is treated as a contextual signal, not proof of fraud.'"),
    4: ("NEW_DEVICE", "MEDIUM", "'The transaction device has no prior observed history; this is treated as a contextual signal, not proof of fraud.'"),
    5: ("HIGH_CARD_VELOCITY", "HIGH", "'High card transaction velocity detected (1h count: ' || CAST(card_txn_count_1h AS BIGINT) || ', 24h count: ' || CAST(card_txn_count_24h AS BIGINT) || ').'"),
    6: ("SHARED_DEVICE", "HIGH", "'Device is associated with multiple unique cards (' || CAST(device_profile_unique_cards AS BIGINT) || ' >= 140).'"),
    7: ("UNUSUAL_AMOUNT", "MEDIUM", "'Transaction amount is significantly higher than historical card average (ratio: ' || printf('%.2f', amount_vs_card_avg) || ').'"),
}
ORACLE["rule_hits_exploded"] = RULES + "\n" + "\nUNION ALL\n".join(
    f"SELECT TransactionID, CAST({' + '.join(['0'] + [f'r{j}' for j in range(i)])} AS BIGINT) AS rule_pos, "
    f"'{rid}' AS rule_id, '{sev}' AS severity, {reason} AS reason FROM rf WHERE r{i} = 1"
    for i, (rid, sev, reason) in _REASONS.items())

ORACLE["rule_trigger_rate"] = RULES + f"""
SELECT count(*) AS rows, {r6('avg(CAST(r2 + r3 + r4 + r5 + r6 + r7 > 0 AS DOUBLE))')} AS trigger_rate FROM rf"""

ORACLE["conservative_score"] = FB + f"""
SELECT TransactionID, {r6('''least(greatest(
   0.50 * greatest(least(greatest(coalesce(card_txn_count_1h, 0) / 3.0, 0.0), 1.0),
                   least(greatest(coalesce(card_txn_count_24h, 0) / 10.0, 0.0), 1.0))
 + 0.45 * CASE WHEN coalesce(new_card, 0) = 0
               THEN least(greatest((coalesce(amount_vs_card_avg, 1.0) - 1.5) / 2.5, 0.0), 1.0) ELSE 0.0 END
 + 0.05 * least(greatest((coalesce(TransactionAmt, 0.0) - 500.0) / 500.0, 0.0), 1.0), 0.0), 1.0)''')}
   AS conservative_score
FROM fb"""

ORACLE["fusion_decisions"] = RULES + f""",
sl AS (SELECT *, {_score_level('(r5 + r6)', '(r2 + r3 + r4 + r7)')} FROM rf),
fz AS (SELECT *, least(greatest(0.9 * least(greatest(score, 0.0), 1.0)
                               + 0.1 * least(greatest(behavioral_risk_score, 0.0), 1.0), 0.0), 1.0) AS fs FROM sl)
SELECT TransactionID, {r6('fs')} AS final_risk_score,
  CASE WHEN fs >= 0.7 THEN 'HIGH' WHEN fs >= 0.2618 THEN 'MEDIUM' ELSE 'LOW' END AS final_risk_level,
  CASE WHEN fs >= 0.2618 THEN 'REVIEW' ELSE 'APPROVE' END AS fusion_decision,
  CASE WHEN score >= 0.9 THEN 'HIGH' WHEN score >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS model_level,
  CASE WHEN score >= 0.7 THEN 'REVIEW' ELSE 'APPROVE' END AS model_decision,
  CASE WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS simple_level,
  CASE WHEN score >= 0.7 THEN 'REVIEW' WHEN score >= 0.3 THEN 'MONITOR' ELSE 'APPROVE' END AS simple_decision,
  CASE WHEN fs >= 0.8 THEN 'HIGH' WHEN fs >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS fused_level,
  CASE WHEN fs >= 0.5 THEN 'REVIEW' ELSE 'APPROVE' END AS final_decision,
  CASE WHEN score >= 0.5 OR behavioral_risk_level IN ('HIGH', 'MEDIUM') THEN 'REVIEW' ELSE 'APPROVE' END
    AS legacy_decision
FROM fz"""

ORD = with_sql(SQL_TX) + """,
o AS (SELECT TransactionID, TransactionDT, isFraud,
             row_number() OVER (ORDER BY TransactionDT, TransactionID) AS rn, count(*) OVER () AS n FROM tx),
s AS (SELECT *, floor(n * 0.7::DOUBLE) AS te, floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) AS ve FROM o)"""

ORACLE["time_split"] = ORD + """
SELECT TransactionID, CASE WHEN rn <= te THEN 'train' WHEN rn <= ve THEN 'validation' ELSE 'test' END AS split FROM s"""

ORACLE["temporal_windows"] = ORD + """,
l AS (SELECT TransactionID, isFraud, row_number() OVER (ORDER BY TransactionDT, TransactionID) AS p,
             count(*) OVER () AS nl,
             sum(isFraud) OVER (ORDER BY TransactionDT, TransactionID ROWS UNBOUNDED PRECEDING) AS cf
      FROM s WHERE rn > te),
b AS (SELECT min(CASE WHEN cf = 100 AND isFraud = 1 THEN p END) AS f1,
             min(CASE WHEN cf = 200 AND isFraud = 1 THEN p END) AS f2,
             max(nl) AS nl, greatest(1000, floor(max(nl) * 0.15::DOUBLE)) AS mw FROM l),
c AS (SELECT *, greatest(f1, mw) AS b1 FROM b),
d AS (SELECT *, least(greatest(f2, b1 + mw), nl - mw) AS b2 FROM c)
SELECT l.TransactionID, CASE WHEN p <= b1 THEN 'calibration' WHEN p <= b2 THEN 'policy' ELSE 'stability' END AS window
FROM l, d"""

ORACLE["top_k_review"] = with_sql(SQL_TX, SQL_SCORED) + """,
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, TransactionDT, TransactionID) AS rk, count(*) OVER () AS n FROM sc)
SELECT TransactionID, score FROM r WHERE rk <= least(n, greatest(1, ceil(n * 0.05::DOUBLE)))"""


def _ranking(src: str, by: str | None) -> str:
    part = f"PARTITION BY {by}" if by else ""
    g = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f""",
hh AS (SELECT {g}score, count(*) AS n, sum(y) AS pos, count(*) - sum(y) AS neg FROM {src} GROUP BY {g}score),
hc AS (SELECT *, coalesce(sum(n) OVER w, 0) AS n_below, coalesce(sum(pos) OVER w, 0) AS pos_below,
              coalesce(sum(neg) OVER w, 0) AS neg_below,
              sum(n) OVER ({part}) AS na, sum(pos) OVER ({part}) AS P, sum(neg) OVER ({part}) AS NN
       FROM hh WINDOW w AS ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
hm AS (SELECT *, P - pos_below AS tp, na - n_below AS sel FROM hc)
SELECT {g}CAST(max(na) AS BIGINT) AS rows, CAST(max(P) AS BIGINT) AS positives,
  {r6('CASE WHEN max(P) > 0 AND max(NN) > 0 THEN sum(pos * (2 * neg_below + neg)) / (2.0 * max(P) * max(NN)) END')} AS roc_auc,
  {r6('CASE WHEN max(P) > 0 THEN sum(CASE WHEN pos > 0 THEN (pos / P) * (tp / sel) END) ELSE 0.0 END')} AS average_precision,
  {r6('CASE WHEN max(P) > 0 THEN sum(CASE WHEN pos > 0 THEN (pos / P) * (tp / sel + CASE WHEN sel - n > 0 THEN (tp - pos) / (sel - n) ELSE 1.0 END) / 2 END) ELSE 0.0 END')} AS pr_auc_trapezoid
FROM hm {grp}"""


ORACLE["ranking_metrics"] = with_sql(SQL_TX, SQL_SCORED) + _ranking("sc", None)

ORACLE["ranking_metrics_by_segment"] = FB + """,
sg AS (SELECT *, (CASE WHEN new_card = 1 THEN 'new_card' ELSE 'existing_card' END) || '/' ||
                 (CASE WHEN new_device_profile = 1 THEN 'new_device' ELSE 'existing_device' END) AS segment FROM fb)""" \
    + _ranking("sg", "segment")


def _rates_sql(src: str) -> str:
    return f"""
  {r6('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END')} AS precision,
  {r6('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END')} AS recall,
  {r6('CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END')} AS f1,
  {r6('CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END')} AS fpr,
  {r6('CASE WHEN tp + fp + tn + fn > 0 THEN (tp + fp) / (tp + fp + tn + fn) ELSE 0 END')} AS review_rate"""


ORACLE["confusion_at_threshold"] = with_sql(SQL_TX, SQL_SCORED) + f""",
c AS (SELECT CAST(count_if(y = 0 AND score < 0.5) AS BIGINT) AS tn, CAST(count_if(y = 0 AND score >= 0.5) AS BIGINT) AS fp,
             CAST(count_if(y = 1 AND score < 0.5) AS BIGINT) AS fn, CAST(count_if(y = 1 AND score >= 0.5) AS BIGINT) AS tp FROM sc)
SELECT tn, fp, fn, tp, 0.5::DOUBLE AS threshold, {_rates_sql('c')},
  {r6('CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END')} AS fnr FROM c"""

ORACLE["threshold_sweep"] = with_sql(SQL_TX, SQL_SCORED) + f""",
g AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold),
c AS (SELECT threshold, CAST(count_if(y = 0 AND score < threshold) AS BIGINT) AS tn, CAST(count_if(y = 0 AND score >= threshold) AS BIGINT) AS fp,
             CAST(count_if(y = 1 AND score < threshold) AS BIGINT) AS fn, CAST(count_if(y = 1 AND score >= threshold) AS BIGINT) AS tp
      FROM g, sc GROUP BY threshold)
SELECT {r6('threshold')} AS threshold, tn, fp, fn, tp, {_rates_sql('c')} FROM c"""

ORACLE["brier_score"] = with_sql(SQL_TX, SQL_SCORED) + f"\nSELECT {r6('avg((score - y) * (score - y))')} AS brier FROM sc"


def _calib(edges_sql: str) -> str:
    return f""",
e AS ({edges_sql}),
b AS (SELECT sc.*, (SELECT count(*) FROM unnest(e.inner_edges) AS u(x) WHERE u.x < sc.score) AS bin FROM sc, e)
SELECT CAST(bin AS BIGINT) AS bin, count(*) AS rows, {r6('avg(y)')} AS prob_true, {r6('avg(score)')} AS prob_pred
FROM b GROUP BY bin"""


ORACLE["calibration_curve_uniform"] = with_sql(SQL_TX, SQL_SCORED) + _calib(
    "SELECT [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[] AS inner_edges")
ORACLE["calibration_curve_quantile"] = with_sql(SQL_TX, SQL_SCORED) + _calib(
    "SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS inner_edges FROM sc")


# --- profiling --------------------------------------------------------------------------
TX = with_sql(SQL_TX)

ORACLE["label_frequency"] = TX + f"""
SELECT isFraud, count(*) AS rows, {r6('count(*) * 100.0 / (SELECT count(*) FROM tx)')} AS percent
FROM tx GROUP BY isFraud"""

_RAW = ["TransactionAmt", "card1", "card2", "card3", "card4", "card5", "card6", "addr1", "addr2", "DeviceInfo"]
ORACLE["null_shares"] = MERGED + """,
u AS (""" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS nulls, count(*) AS n FROM m" for c in _RAW) + f""")
SELECT column_name, nulls, {r6('nulls * 100.0 / n')} AS null_percent FROM u ORDER BY nulls DESC, column_name LIMIT 30"""

ORACLE["id_coverage"] = MERGED + f"""
SELECT (SELECT count(DISTINCT TransactionID) FROM idt) AS identity_ids,
       (SELECT count(DISTINCT TransactionID) FROM tx) AS transaction_ids,
       {r6('(SELECT avg(CASE WHEN TransactionID IN (SELECT TransactionID FROM tx) THEN 1.0 ELSE 0.0 END) FROM (SELECT DISTINCT TransactionID FROM idt)) * 100')} AS found_percent"""

ORACLE["amount_describe_by_label"] = TX + f"""
SELECT isFraud, count(TransactionAmt) AS count, {r6('avg(TransactionAmt)')} AS mean, {r6('stddev_samp(TransactionAmt)')} AS std,
  {r6('min(TransactionAmt)')} AS min, {r6('quantile_cont(TransactionAmt, 0.25)')} AS p25,
  {r6('quantile_cont(TransactionAmt, 0.5)')} AS median, {r6('quantile_cont(TransactionAmt, 0.75)')} AS p75,
  {r6('max(TransactionAmt)')} AS max
FROM tx GROUP BY isFraud"""

ORACLE["amount_by_device_presence"] = MERGED + f"""
SELECT CAST(DeviceInfo IS NOT NULL AS INTEGER) AS has_device, count(TransactionAmt) AS count,
  {r6('min(TransactionAmt)')} AS min, {r6('max(TransactionAmt)')} AS max, {r6('avg(TransactionAmt)')} AS mean,
  {r6('quantile_cont(TransactionAmt, 0.5)')} AS median
FROM m GROUP BY 1"""

ORACLE["feature_means_by_label"] = FB + f"""
SELECT isFraud, {r6('avg(card_transaction_count)')} AS mean_card_transaction_count,
  {r6('avg(card_txn_count_24h)')} AS mean_card_txn_count_24h, {r6('avg(device_profile_count)')} AS mean_device_profile_count,
  {r6('avg((card2 IS NULL)::INT + (addr1 IS NULL)::INT + (addr2 IS NULL)::INT + (DeviceInfo IS NULL)::INT)')}
    AS mean_missing_value_count
FROM fb GROUP BY isFraud"""

ORACLE["fraud_rate_by_amount_decile"] = TX + f""",
e AS (SELECT list_sort(list_distinct(quantile_cont(TransactionAmt, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])))
             AS edges FROM tx),
b AS (SELECT tx.*, e.edges,
        1 + (SELECT count(*) FROM unnest(e.edges[2:len(e.edges) - 1]) AS u(x) WHERE u.x < tx.TransactionAmt) AS bin
      FROM tx, e WHERE TransactionAmt IS NOT NULL)
SELECT CAST(bin AS BIGINT) AS bin, {r6('any_value(edges[bin])')} AS lower, {r6('any_value(edges[bin + 1])')} AS upper,
       count(*) AS rows, {r6('avg(isFraud)')} AS rate
FROM b GROUP BY bin"""

ORACLE["hour_label_crosstab"] = TX + f""",
c AS (SELECT (TransactionDT // 3600) % 24 AS transaction_hour, isFraud, count(*) AS rows FROM tx GROUP BY 1, 2)
SELECT CAST(transaction_hour AS BIGINT) AS transaction_hour, isFraud, rows,
       {r6('rows * 1.0 / sum(rows) OVER (PARTITION BY transaction_hour)')} AS share FROM c"""

_FEATS = ["TransactionAmt", "TransactionAmt_log", "transaction_hour", "transaction_day", "has_identity",
          "missing_card_info", "missing_address", "missing_value_count", "card_transaction_count", "card_avg_amount",
          "amount_vs_card_avg", "new_card", "card_txn_count_1h", "card_txn_count_24h", "has_device_info",
          "device_profile_count", "device_profile_unique_cards", "new_device_profile", "card_device_transaction_count",
          "card_device_seen_before", "device_unique_cards_historical"]
ORACLE["feature_null_counts"] = MERGED + f""",
f AS (SELECT t.TransactionID, {_basic_cols().replace('TransactionAmt_x', 'TransactionAmt')}, {_batch_cols('m', rounded=False)} FROM m t)
SELECT column_name, nulls FROM (""" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS nulls FROM f" for c in _FEATS) + ")"

ORACLE["split_summary"] = ORD + f""",
l AS (SELECT *, CASE WHEN rn <= te THEN 'train' WHEN rn <= ve THEN 'validation' ELSE 'test' END AS split FROM s)
SELECT split, count(*) AS rows, CAST(sum(isFraud) AS BIGINT) AS frauds, {r6('avg(isFraud) * 100')} AS fraud_percent,
       min(TransactionDT) AS min_dt, max(TransactionDT) AS max_dt
FROM l GROUP BY split"""

ORACLE["velocity_summary"] = FB + f"""
SELECT bool_and(card_txn_count_24h >= card_txn_count_1h) AS invariant_24h_ge_1h,
  count(card_txn_count_1h) AS card_txn_count_1h_count, {r6('avg(card_txn_count_1h)')} AS card_txn_count_1h_mean,
  {r6('stddev_samp(card_txn_count_1h)')} AS card_txn_count_1h_std, CAST(min(card_txn_count_1h) AS BIGINT) AS card_txn_count_1h_min,
  CAST(max(card_txn_count_1h) AS BIGINT) AS card_txn_count_1h_max, CAST(count_if(card_txn_count_1h > 0) AS BIGINT) AS card_txn_count_1h_nonzero,
  count(card_txn_count_24h) AS card_txn_count_24h_count, {r6('avg(card_txn_count_24h)')} AS card_txn_count_24h_mean,
  {r6('stddev_samp(card_txn_count_24h)')} AS card_txn_count_24h_std, CAST(min(card_txn_count_24h) AS BIGINT) AS card_txn_count_24h_min,
  CAST(max(card_txn_count_24h) AS BIGINT) AS card_txn_count_24h_max, CAST(count_if(card_txn_count_24h > 0) AS BIGINT) AS card_txn_count_24h_nonzero,
  {r6('quantile_cont(card_txn_count_1h, 0.25)')} AS card_txn_count_1h_q25,
  {r6('quantile_cont(card_txn_count_1h, 0.5)')} AS card_txn_count_1h_q50,
  {r6('quantile_cont(card_txn_count_1h, 0.75)')} AS card_txn_count_1h_q75,
  {r6('quantile_cont(card_txn_count_24h, 0.25)')} AS card_txn_count_24h_q25,
  {r6('quantile_cont(card_txn_count_24h, 0.5)')} AS card_txn_count_24h_q50,
  {r6('quantile_cont(card_txn_count_24h, 0.75)')} AS card_txn_count_24h_q75
FROM fb"""

ORACLE["device_summary"] = MERGED + f"""
SELECT count(DISTINCT DeviceInfo) AS distinct_devices, {r6('avg(CAST(DeviceInfo IS NULL AS DOUBLE)) * 100')} AS missing_device_percent
FROM m"""

ORACLE["split_union_uniqueness"] = TX + """
SELECT count(*) AS rows, count(DISTINCT TransactionID) AS distinct_keys,
  (SELECT count(*) FROM (SELECT TransactionID FROM tx GROUP BY 1 HAVING count(*) > 1)) AS duplicated_keys FROM tx"""


# --- text, requests, contracts ---------------------------------------------------------------
_PHRASES = ["definitely fraudulent", "certainly fraudulent", "100% fraud", "confirmed fraud", "guaranteed fraud",
            "password"]
_PATTERNS = [r"gsk_[A-Za-z0-9_-]+", r"sk-[A-Za-z0-9_-]+", r'token = "[0-9a-f]+"', r"AKIA[0-9A-Z]{16}"]
_V = ("CASE WHEN " + " OR ".join(f"contains(lower(text), '{p}')" for p in _PHRASES) + " THEN 'unsupported_claim'"
      " WHEN NOT contains(text, CAST(n_chars % 10 AS VARCHAR)) THEN 'score_mismatch'"
      " WHEN NOT contains(text, 'en') THEN 'level_mismatch' WHEN NOT contains(text, 'ti') THEN 'decision_mismatch'"
      " WHEN " + " OR ".join("regexp_matches(text, '" + p.replace("'", "''") + "')" for p in _PATTERNS)
      + " THEN 'secret_exposure' END")
ORACLE["report_guardrail"] = f"""
SELECT doc_id, ({_V}) IS NULL AS passed, {_V} AS first_violation FROM documents"""

ORACLE["report_guardrail_nulls"] = f"""
SELECT doc_id, v IS NULL AS passed, v AS first_violation FROM (
  SELECT doc_id, CASE WHEN doc_id % 5 = 1 OR text IS NULL THEN 'missing_report'
    WHEN ({_V}) = 'unsupported_claim' THEN 'unsupported_claim'
    WHEN doc_id % 5 = 2 OR ({_V}) = 'score_mismatch' THEN 'score_mismatch'
    WHEN doc_id % 5 = 3 OR ({_V}) = 'level_mismatch' THEN 'level_mismatch'
    WHEN doc_id % 5 = 4 OR ({_V}) = 'decision_mismatch' THEN 'decision_mismatch'
    ELSE ({_V}) END AS v FROM documents)"""

ORACLE["id_validation"] = """
WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR)
                                            WHEN 1 THEN CAST(-event_id AS VARCHAR)
                                            WHEN 2 THEN ' ' || CAST(event_id AS VARCHAR) || ' '
                                            ELSE 'id' || CAST(event_id AS VARCHAR) END AS raw_id FROM events),
c AS (SELECT event_id, TRY_CAST(trim(raw_id) AS BIGINT) AS v FROM r)
SELECT event_id, CASE WHEN v > 0 THEN v END AS TransactionID,
       CASE WHEN v IS NULL THEN 'not_an_integer' WHEN v <= 0 THEN 'not_positive' END AS reason FROM c"""

ORACLE["payload_overlay"] = MERGED + """,
p AS (SELECT TransactionID AS request_id, card1 AS pc,
             CASE WHEN TransactionID % 3 = 1 THEN TransactionDT + 7 ELSE TransactionDT END AS pdt,
             CASE WHEN TransactionID % 3 = 2 THEN NULL ELSE CAST(TransactionAmt * 2 AS VARCHAR) END AS pamt,
             CASE WHEN TransactionID % 3 = 2 THEN 2 ELSE 3 END + 1 AS n_fields
      FROM tx),
first_row AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY card1, TransactionDT ORDER BY TransactionID) = 1)
SELECT p.request_id, CAST(f.TransactionID IS NOT NULL AS BIGINT) AS synthetic,
       CAST(f.TransactionID AS VARCHAR) AS TransactionID, CAST(p.pdt AS VARCHAR) AS TransactionDT,
       coalesce(p.pamt, CAST(f.TransactionAmt AS VARCHAR)) AS TransactionAmt, CAST(p.pc AS VARCHAR) AS card1,
       f.DeviceInfo AS DeviceInfo,
       CASE WHEN f.TransactionID IS NULL AND n_fields < 20 THEN 'PARTIAL' ELSE 'COMPLETE' END AS completeness
FROM p LEFT JOIN first_row f ON f.card1 = p.pc AND f.TransactionDT = p.pdt"""

ORACLE["feedback_validation"] = """
WITH r AS (SELECT event_id AS transaction_id,
             CASE event_type WHEN 'error' THEN 'CONFIRMED_FRAUD' WHEN 'click' THEN 'FALSE_POSITIVE'
                             WHEN 'view' THEN 'LEGITIMATE' WHEN 'purchase' THEN 'NEEDS_MORE_INFORMATION'
                             ELSE lower(event_type) END AS analyst_label FROM events)
SELECT transaction_id, analyst_label,
       CASE WHEN analyst_label IN ('CONFIRMED_FRAUD', 'FALSE_POSITIVE', 'LEGITIMATE', 'NEEDS_MORE_INFORMATION')
            THEN 1 ELSE 0 END AS accepted FROM r"""

ORACLE["label_join_contract"] = TX + """
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS unlabelled,
  (SELECT count(*) FROM (SELECT TransactionID FROM tx GROUP BY 1 HAVING count(*) > 1)) AS feature_dupes,
  (SELECT count(*) FROM (SELECT TransactionID FROM tx GROUP BY 1 HAVING count(*) > 1)) AS label_dupes
FROM tx"""

ORACLE["features_test_split"] = MERGED + f""",
o AS (SELECT *, row_number() OVER (ORDER BY TransactionDT, TransactionID) AS rn, count(*) OVER () AS n FROM m)
SELECT t.TransactionID, {_batch_cols('m')} FROM o t WHERE rn > floor(n * (0.7::DOUBLE + 0.15::DOUBLE))"""

_BEH = ["card_transaction_count", "card_avg_amount", "amount_vs_card_avg", "new_card", "card_txn_count_1h",
        "card_txn_count_24h", "has_device_info", "device_profile_count", "device_profile_unique_cards",
        "new_device_profile", "card_device_transaction_count", "card_device_seen_before",
        "device_unique_cards_historical"]
ORACLE["batch_pit_parity"] = MERGED + f""",
a AS MATERIALIZED (SELECT t.TransactionID, {_batch_cols('m', rounded=False)} FROM m t),
b AS MATERIALIZED (SELECT t.TransactionID, {_pit_cols('m', rounded=False)} FROM m t),
u AS (""" + "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST(a.{f} AS DOUBLE) AS x, CAST(b.{f} AS DOUBLE) AS y FROM a JOIN b USING (TransactionID)"
    for f in _BEH) + """)
SELECT feature, count(*) AS rows,
  CAST(count_if(NOT ((x IS NULL AND y IS NULL) OR (x IS NOT NULL AND y IS NOT NULL AND abs(x - y) <= 1e-8 + 1e-5 * abs(y)))) AS BIGINT)
    AS mismatches
FROM u GROUP BY feature"""

ORACLE["fusion_weight_search"] = RULES + f""",
sl AS (SELECT TransactionID, TransactionDT, y, score,
         {_score_level('(r5 + r6)', '(r2 + r3 + r4 + r7)')} FROM rf),
g AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]::DOUBLE[]) AS w),
f AS (SELECT g.w, sl.*, g.w * score + (1 - g.w) * behavioral_risk_score AS fused FROM g, sl),
rk AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY fused DESC, TransactionDT, TransactionID) AS r,
              count(*) OVER (PARTITION BY w) AS n, sum(y) OVER (PARTITION BY w) AS P FROM f),
th AS (SELECT w, quantile_cont(fused, 0.95) AS thr FROM f GROUP BY w),
mm AS (SELECT rk.w, any_value(th.thr) AS thr,
        sum(CASE WHEN r <= least(n, greatest(1, ceil(n * 0.05::DOUBLE))) THEN y ELSE 0 END) AS hit,
        any_value(least(n, greatest(1, ceil(n * 0.05::DOUBLE)))) AS k, any_value(P) AS P,
        CAST(count_if(y = 1 AND fused >= th.thr) AS BIGINT) AS tp, CAST(count_if(y = 0 AND fused >= th.thr) AS BIGINT) AS fp,
        CAST(count_if(y = 1 AND fused < th.thr) AS BIGINT) AS fn
      FROM rk JOIN th ON rk.w = th.w GROUP BY rk.w),
s AS (SELECT w, hit * 1.0 / P AS rec, hit * 1.0 / k AS prec, thr,
        CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM mm)
SELECT {r6('w')} AS model_weight, {r6('rec')} AS recall_at_5pct, {r6('prec')} AS precision_at_5pct,
  {r6('thr')} AS review_threshold, {r6('least(0.95, greatest(thr + 0.15, 0.70))')} AS high_threshold, {r6('f1')} AS f1,
  CAST(row_number() OVER (ORDER BY rec DESC, prec DESC, f1 DESC, w) = 1 AS BIGINT) AS chosen
FROM s"""


# --- streams: the stream's output must equal the batch answer ------------------------------------
ORACLE["stream_scoring"] = MERGED + f""",
hist AS (SELECT * FROM m WHERE TransactionDT < {PROBE_START}),
pr AS (SELECT * FROM m WHERE TransactionDT >= {PROBE_START}),
fp AS (SELECT t.*, {_pit_cols('hist', rounded=False)},
         floor(1.0 / (1.0 + exp(-(ln(1 + t.TransactionAmt) - 3.5 + 0.05 * ((t.TransactionDT // 3600) % 24)))) * 100 + 0.5) / 100 AS score
       FROM pr t),
fr AS (SELECT *, CAST(score >= 0.8 AS INT) AS r0, CAST(score < 0.8 AND score >= 0.6 AS INT) AS r1,
         CAST(new_card = 1 AND new_device_profile = 1 AND TransactionAmt >= 150 AS INT) AS r2,
         CAST(new_card = 1 AND new_device_profile = 0 AS INT) AS r3, CAST(new_card = 0 AND new_device_profile = 1 AS INT) AS r4,
         CAST(card_txn_count_1h >= 2 OR card_txn_count_24h >= 5 AS INT) AS r5,
         CAST(device_profile_unique_cards >= 140 AS INT) AS r6,
         CAST(new_card = 0 AND amount_vs_card_avg >= 3 AS INT) AS r7 FROM fp),
fs AS (SELECT *, {_score_level('(r0 + r5 + r6)', '(r1 + r2 + r3 + r4 + r7)')} FROM fr),
ff AS (SELECT *, least(greatest(0.8::DOUBLE * score + 0.2::DOUBLE * behavioral_risk_score, 0), 1) AS final FROM fs)
SELECT TransactionID, {_basic_cols().replace('TransactionAmt_x', 'TransactionAmt')},
  card_transaction_count, {r6('card_avg_amount')} AS card_avg_amount, {r6('amount_vs_card_avg')} AS amount_vs_card_avg,
  new_card, card_txn_count_1h, card_txn_count_24h, has_device_info, device_profile_count, device_profile_unique_cards,
  new_device_profile, card_device_transaction_count, card_device_seen_before, device_unique_cards_historical,
  concat_ws(',', CASE WHEN r0 = 1 THEN 'HIGH_MODEL_RISK' END, CASE WHEN r1 = 1 THEN 'MEDIUM_MODEL_RISK' END,
            CASE WHEN r2 = 1 THEN 'NEW_CARD_NEW_DEVICE_HIGH_AMOUNT' END, CASE WHEN r3 = 1 THEN 'NEW_CARD' END,
            CASE WHEN r4 = 1 THEN 'NEW_DEVICE' END, CASE WHEN r5 = 1 THEN 'HIGH_CARD_VELOCITY' END,
            CASE WHEN r6 = 1 THEN 'SHARED_DEVICE' END, CASE WHEN r7 = 1 THEN 'UNUSUAL_AMOUNT' END) AS rule_ids,
  behavioral_risk_level, CASE WHEN final >= 0.8 THEN 'HIGH' WHEN final >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS final_risk_level,
  CASE WHEN final >= 0.5 THEN 'REVIEW' ELSE 'APPROVE' END AS decision, {r6('score')} AS model_score, {r6('final')} AS final_risk_score
FROM ff t"""

ORACLE["stream_velocity"] = TX + """
SELECT t.TransactionID,
  (SELECT count(*) FROM tx h WHERE h.card1 = t.card1 AND h.TransactionDT BETWEEN t.TransactionDT - 3600 AND t.TransactionDT - 1) AS card_txn_count_1h,
  (SELECT count(*) FROM tx h WHERE h.card1 = t.card1 AND h.TransactionDT BETWEEN t.TransactionDT - 86400 AND t.TransactionDT - 1) AS card_txn_count_24h
FROM tx t"""

ORACLE["stream_feedback"] = """
SELECT * EXCLUDE (accepted) FROM (""" + ORACLE["feedback_validation"] + ") WHERE accepted = 1"


# --- T7-T9 / P16 / J5 ------------------------------------------------------------------------------
ORACLE["best_threshold_by_f1"] = with_sql(SQL_TX, SQL_SCORED) + f""",
g AS (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85,
                     0.9, 0.95]::DOUBLE[]) AS threshold),
c AS (SELECT threshold, CAST(count_if(y = 0 AND score < threshold) AS BIGINT) AS tn, CAST(count_if(y = 0 AND score >= threshold) AS BIGINT) AS fp,
             CAST(count_if(y = 1 AND score < threshold) AS BIGINT) AS fn, CAST(count_if(y = 1 AND score >= threshold) AS BIGINT) AS tp
      FROM g, sc GROUP BY threshold),
f AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c)
SELECT {r6('threshold')} AS threshold, {r6('f1')} AS f1, tp, fp, fn, tn FROM f
ORDER BY f1 DESC, threshold LIMIT 1"""

ORACLE["highest_score_row"] = with_sql(SQL_TX, SQL_SCORED) + """
SELECT TransactionID, TransactionDT, score, y FROM sc ORDER BY score DESC, TransactionDT, TransactionID LIMIT 1"""

ORACLE["earliest_latest_rows"] = TX + """
(SELECT TransactionID, TransactionDT, TransactionAmt, isFraud, 'earliest' AS "end" FROM tx
 ORDER BY TransactionDT, TransactionID LIMIT 5)
UNION ALL
(SELECT TransactionID, TransactionDT, TransactionAmt, isFraud, 'latest' AS "end" FROM tx
 ORDER BY TransactionDT DESC, TransactionID DESC LIMIT 5)"""

ORACLE["device_fill_and_known_ids"] = with_sql(SQL_TX, SQL_ID, SQL_ORDERS_TX) + """,
idd AS (SELECT TransactionID, min(DeviceInfo) AS DeviceInfo FROM idt GROUP BY 1),
o AS (SELECT TransactionID, card1, CASE WHEN TransactionID % 3 = 0 THEN NULL ELSE DeviceInfo END AS DeviceInfo FROM otx)
SELECT o.TransactionID, o.card1, coalesce(o.DeviceInfo, idd.DeviceInfo) AS DeviceInfo
FROM o LEFT JOIN idd ON o.TransactionID = idd.TransactionID
WHERE o.TransactionID IN (SELECT TransactionID FROM tx)"""

ORACLE["assessment_records"] = with_sql(SQL_TX, SQL_SCORED) + """
SELECT TransactionID AS transaction_id, score AS risk_score,
       CASE WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
       CASE WHEN score >= 0.7 THEN 'REVIEW' WHEN score >= 0.3 THEN 'MONITOR' ELSE 'APPROVE' END AS decision
FROM sc"""

ORACLE["features_batch_hot_keys"] = ORACLE["features_batch"]
ORACLE["features_pit_hot_keys"] = ORACLE["features_pit"]
ORACLE["history_lookup_hot_keys"] = PROBES + f"\nSELECT t.TransactionID, {_pit_cols('hist')} FROM pr t"


# --- exact cuts (M4-M7, M13-M16, M19, T3, T6) ----------------------------------------------------
_K = "CASE how WHEN 'ceil' THEN least(n, greatest(1, ceil(n * rate))) ELSE floor(n * rate) END"
ORACLE["review_capacity_sweep"] = with_sql(SQL_TX, SQL_SCORED) + f""",
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, TransactionDT, TransactionID) AS rk, count(*) OVER () AS n,
             sum(y) OVER () AS P FROM sc),
g AS (SELECT rate, how, CAST({_K} AS BIGINT) AS k FROM (SELECT count(*) AS n FROM sc),
      (SELECT unnest([0.01, 0.05, 0.10]::DOUBLE[]) AS rate), (SELECT unnest(['ceil', 'floor']) AS how))
SELECT how || '_' || CASE rate WHEN 0.01 THEN '0.01' WHEN 0.05 THEN '0.05' ELSE '0.10' END AS name, max(n) AS rows, k AS review_count,
  CAST(sum(CASE WHEN rk <= k THEN y ELSE 0 END) AS BIGINT) AS selected_fraud_count,
  {r6('sum(CASE WHEN rk <= k THEN y ELSE 0 END) * 1.0 / max(P)')} AS recall,
  {r6('CASE WHEN k > 0 THEN sum(CASE WHEN rk <= k THEN y ELSE 0 END) * 1.0 / k ELSE 0 END')} AS precision,
  {r6('coalesce(max(CASE WHEN rk = k THEN score END), 0)')} AS cutoff_score
FROM g, r GROUP BY how, rate, k"""

_GAPPY = with_sql(SQL_TX, SQL_SCORED) + """,
gp AS (SELECT TransactionID + 1152921504606846976 AS TransactionID, 7 AS TransactionDT,
              CASE WHEN TransactionID % 7 <= 1 THEN NULL ELSE round(score, 1) END AS score FROM sc)"""
ORACLE["top_k_large_ids"] = _GAPPY + """,
r AS (SELECT TransactionID, row_number() OVER (ORDER BY score DESC NULLS LAST, TransactionID) AS rk, count(*) OVER () AS n FROM gp)
SELECT TransactionID FROM r WHERE rk <= ceil(n * 0.80::DOUBLE)"""
ORACLE["time_split_large_ids"] = _GAPPY + """,
r AS (SELECT TransactionID, row_number() OVER (ORDER BY TransactionID) AS rk, count(*) OVER () AS n FROM gp)
SELECT TransactionID, CASE WHEN rk <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rk <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE))
       THEN 'validation' ELSE 'test' END AS split FROM r"""

ORACLE["fusion_stability"] = RULES + f""",
sl AS (SELECT TransactionID, TransactionDT, y, score, {_score_level('(r5 + r6)', '(r2 + r3 + r4 + r7)')} FROM rf),
f AS (SELECT *, 0.8::DOUBLE * score + (1 - 0.8::DOUBLE) * behavioral_risk_score AS fused FROM sl),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, TransactionDT, TransactionID) AS a,
             row_number() OVER (ORDER BY fused DESC, TransactionDT, TransactionID) AS b,
             greatest(1, ceil(count(*) OVER () * 0.05::DOUBLE)) AS k FROM f),
fs AS (SELECT sum(y) AS P, max(k) AS k, sum(CASE WHEN a <= k THEN y ELSE 0 END) AS ha, sum(CASE WHEN b <= k THEN y ELSE 0 END) AS hb
      FROM r)
SELECT CAST(hb >= ha AND (hb - ha) / k >= -0.01 AS BIGINT) AS enabled, {r6('ha / P')} AS baseline_recall,
  {r6('ha / k')} AS baseline_precision, {r6('hb / P')} AS fusion_recall, {r6('hb / k')} AS fusion_precision,
  {r6('hb / P - ha / P')} AS recall_change, {r6('hb / k - ha / k')} AS precision_change FROM fs"""

# fixed values: the 17 diagnostic segments
_SEGMENTS = {
    "all": "TRUE", "new_card": "new_card = 1", "known_card": "new_card = 0", "new_device": "new_device_profile = 1",
    "known_device": "new_device_profile = 0", "new_card_and_new_device": "new_card = 1 AND new_device_profile = 1",
    "known_card_new_device": "new_card = 0 AND new_device_profile = 1",
    "new_card_known_device": "new_card = 1 AND new_device_profile = 0",
    "new_card_device_pair": "card_device_seen_before = 0", "known_card_device_pair": "card_device_seen_before = 1",
    "high_amount_gt_200": "TransactionAmt > 200", "high_amount_gt_500": "TransactionAmt > 500",
    "amount_gt_2x_card_avg": "coalesce(amount_vs_card_avg, 0) > 2", "velocity_1h": "card_txn_count_1h > 0",
    "velocity_24h": "card_txn_count_24h > 0", "shared_device_10plus_cards": "device_profile_unique_cards >= 10",
    "shared_device_20plus_cards": "device_profile_unique_cards >= 20",
}
_C01 = lambda x: f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"
_CONSERVATIVE = _C01(
    f"0.50::DOUBLE * greatest({_C01('card_txn_count_1h / 3.0::DOUBLE')}, {_C01('card_txn_count_24h / 10.0::DOUBLE')}) + 0.45::DOUBLE * "
    f"(CASE WHEN new_card = 0 THEN {_C01('(coalesce(amount_vs_card_avg, 1) - 1.5::DOUBLE) / 2.5::DOUBLE')} ELSE 0 END) + "
    f"0.05::DOUBLE * {_C01('(TransactionAmt - 500.0::DOUBLE) / 500.0::DOUBLE')}")
_SEG_LONG = FB + f""",
fz AS (SELECT *, 0.8::DOUBLE * score + 0.2::DOUBLE * {_CONSERVATIVE} AS fused FROM fb),
names AS (SELECT * FROM (VALUES {', '.join(f"('{s}', {i})" for i, s in enumerate(_SEGMENTS))}) v(segment, i)),
sl AS ({' UNION ALL '.join(f"SELECT '{s}' AS segment, TransactionID, TransactionDT, y, score, fused FROM fz WHERE {c}" for s, c in _SEGMENTS.items())}),
lg AS (SELECT segment, 'score' AS score, TransactionID, TransactionDT, y, score AS v FROM sl
       UNION ALL SELECT segment, 'fused', TransactionID, TransactionDT, y, fused FROM sl),
rk AS (SELECT *, row_number() OVER (PARTITION BY segment, score ORDER BY v DESC, TransactionDT, TransactionID) AS r,
              greatest(1, ceil(count(*) OVER (PARTITION BY segment, score) * 0.05::DOUBLE)) AS k FROM lg),
ag AS (SELECT segment, score, count(*) AS n, sum(y) AS P, max(k) AS k, sum(CASE WHEN r <= k THEN y ELSE 0 END) AS h FROM rk
       GROUP BY segment, score),
sm AS (SELECT nm.segment, nm.i, s.score, n, P, k, CASE WHEN P > 0 THEN h / P WHEN P = 0 THEN 0 END AS rec, h / k AS prec
       FROM names nm CROSS JOIN (VALUES ('score'), ('fused')) s(score) LEFT JOIN ag ON ag.segment = nm.segment AND ag.score = s.score)"""
ORACLE["segment_review"] = _SEG_LONG + f"""
SELECT segment, score, CAST(coalesce(n, 0) AS BIGINT) AS rows, CAST(P AS BIGINT) AS frauds, CAST(k AS BIGINT) AS review_count,
  {r6('P / n')} AS fraud_rate, {r6('rec')} AS recall, {r6('prec')} AS precision FROM sm"""
ORACLE["segment_extremes"] = _SEG_LONG + f""",
d AS (SELECT a.segment, a.i, round(b.rec - a.rec, 9) AS dr, round(b.prec - a.prec, 9) AS dp FROM sm a JOIN sm b ON a.segment = b.segment
      WHERE a.score = 'score' AND b.score = 'fused' AND a.segment <> 'all'),
o AS (SELECT *, row_number() OVER (ORDER BY dr IS NULL, dr, dp, i) AS w, row_number() OVER (ORDER BY dr IS NULL, dr DESC, i) AS b FROM d)
SELECT 'worst' AS kind, w AS place, segment, {r6('dr')} AS change FROM o WHERE w <= 5
UNION ALL SELECT 'best', b, segment, {r6('dr')} FROM o WHERE b <= 5"""

ORACLE["cold_start_segment_points"] = FB + f""",
sg AS (SELECT *, (CASE WHEN new_card = 1 THEN 'new_card' ELSE 'existing_card' END) || '/' ||
                 (CASE WHEN new_device_profile = 1 THEN 'new_device' ELSE 'existing_device' END) AS segment FROM fb),
rk AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY score DESC, TransactionDT, TransactionID) AS r,
              greatest(1, ceil(count(*) OVER (PARTITION BY segment) * 0.05::DOUBLE)) AS k FROM sg),
c AS (SELECT segment, CAST(count_if(y = 0 AND score < 0.5) AS BIGINT) AS tn, CAST(count_if(y = 0 AND score >= 0.5) AS BIGINT) AS fp,
             CAST(count_if(y = 1 AND score < 0.5) AS BIGINT) AS fn, CAST(count_if(y = 1 AND score >= 0.5) AS BIGINT) AS tp,
             CAST(max(k) AS BIGINT) AS review_count, sum(CASE WHEN r <= k THEN y ELSE 0 END) AS h, sum(y) AS P FROM rk GROUP BY segment)
SELECT segment, tn, fp, fn, tp, review_count, {r6('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END')} AS precision,
  {r6('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END')} AS recall,
  {r6('CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END')} AS f1,
  {r6('CASE WHEN P > 0 THEN h / P ELSE 0 END')} AS recall_at_5pct, {r6('h / review_count')} AS precision_at_5pct FROM c"""

ORACLE["stored_row_lookup"] = TX + """
SELECT e.event_id + 3 AS TransactionID, coalesce(t.TransactionDT, -1) AS TransactionDT, t.TransactionID IS NOT NULL AS found
FROM events e LEFT JOIN tx t ON t.TransactionID = e.event_id + 3"""

ORACLE["stored_row_repeated_ids"] = """
WITH a AS (SELECT o_orderkey AS asked_by, o_custkey + o_orderkey % 2 AS k FROM orders)
SELECT a.asked_by, a.k AS TransactionID, count(s.o_orderkey) > 0 AS found,
       coalesce(min(datediff('day', DATE '1970-01-01', CAST(s.o_orderdate AS DATE))), -1) AS TransactionDT,
       coalesce(arg_min(s.o_orderkey, (CAST(s.o_orderdate AS DATE), s.o_orderkey)), -1) AS first_order
FROM a LEFT JOIN orders s ON s.o_custkey = a.k GROUP BY a.asked_by, a.k"""

ORACLE["history_by_days"] = TX + """
SELECT TransactionDT // 86400 AS day, TransactionID, TransactionDT, card1 FROM tx
WHERE TransactionDT // 86400 <= (SELECT (min(TransactionDT) + max(TransactionDT)) // 2 // 86400 FROM tx)"""

ORACLE["rejected_lines"] = TX + """,
w AS (SELECT TransactionID AS i, CASE WHEN TransactionID % 7 = 0 THEN 'noon'
               WHEN TransactionID % 13 = 0 THEN CAST(TransactionDT AS VARCHAR) || '.5'
               WHEN TransactionID % 17 <> 0 THEN CAST(TransactionDT AS VARCHAR) ELSE '' END AS t FROM tx)
SELECT CAST(-1 AS BIGINT) AS TransactionID, CAST(-1 AS BIGINT) AS TransactionDT, CAST(-1 AS BIGINT) AS card1,
       i || ',' || t || CASE WHEN i % 11 = 0 THEN '' ELSE ',x,' || (i % 5) END AS line
FROM w WHERE i % 7 = 0 OR i % 11 = 0 OR i % 13 = 0
UNION ALL
SELECT i, coalesce(try_cast(t AS BIGINT), -1), i % 5, '' FROM w WHERE i % 7 <> 0 AND i % 11 <> 0 AND i % 13 <> 0"""

# a null card or time gives the all-new answer whatever the counts say
ORACLE["cold_start_null_keys"] = PROBES + """
SELECT TransactionID, CAST(1 AS BIGINT) AS is_new_card, CAST(1 AS BIGINT) AS is_new_device, CAST(1 AS BIGINT) AS is_new_pair
FROM pr"""

ORACLE["features_tiny_amounts"] = MERGED + f""",
tiny AS (SELECT * REPLACE (TransactionAmt * 1e-8 AS TransactionAmt) FROM m),
f AS (SELECT t.TransactionID, {_batch_cols('tiny', rounded=False).replace('DECIMAL(38,6)', 'DECIMAL(38,18)')} FROM tiny t)
SELECT TransactionID, {r6('amount_vs_card_avg')} AS amount_vs_card_avg, {r6('card_avg_amount * 1e8')} AS scaled_avg FROM f"""

ORACLE["investigation_records"] = PROBES + f""",
fp AS (SELECT t.TransactionID, t.card1, t.TransactionDT, t.DeviceInfo, t.TransactionAmt, {_pit_cols('hist', rounded=False)},
         CASE WHEN t.TransactionID % 9 <> 0 THEN floor(1.0 / (1.0 + exp(-(ln(1 + t.TransactionAmt) - 3.5
              + 0.05 * ((t.TransactionDT // 3600) % 24)))) * 100 + 0.5) / 100 END AS score,
         coalesce((SELECT max(h.TransactionAmt) FROM hist h WHERE h.card1 = t.card1 AND {EARLIER}), 0) AS mx,
         coalesce((SELECT min(h.TransactionAmt) FROM hist h WHERE h.card1 = t.card1 AND {EARLIER}), 0) AS mn
       FROM pr t),
cs AS (SELECT *, card_transaction_count > 0 AS ch,
         coalesce(DeviceInfo IS NOT NULL AND upper(DeviceInfo) <> 'UNKNOWN-DEVICE' AND device_profile_count > 0, FALSE) AS dh FROM fp),
fr AS (SELECT *, NOT ch AS nc, NOT dh AS nd, CAST(coalesce(score >= 0.8, FALSE) AS INT) AS r0,
         CAST(coalesce(score < 0.8 AND score >= 0.6, FALSE) AS INT) AS r1,
         CAST(NOT ch AND NOT dh AND TransactionAmt >= 150 AS INT) AS r2, CAST(NOT ch AND dh AS INT) AS r3,
         CAST(ch AND NOT dh AS INT) AS r4, CAST(card_txn_count_1h >= 2 OR card_txn_count_24h >= 5 AS INT) AS r5,
         CAST(device_profile_unique_cards >= 140 AS INT) AS r6, CAST(ch AND amount_vs_card_avg >= 3 AS INT) AS r7 FROM cs),
fs AS (SELECT *, {_score_level('(r0 + r5 + r6)', '(r1 + r2 + r3 + r4 + r7)')} FROM fr),
ff AS (SELECT *, least(greatest(0.8::DOUBLE * coalesce(score, 0) + 0.2::DOUBLE * behavioral_risk_score, 0), 1) AS final FROM fs)
SELECT TransactionID, {r6('score')} AS model_score,
  CASE WHEN score >= 0.9 THEN 'HIGH' WHEN score >= 0.7 THEN 'MEDIUM' WHEN score IS NOT NULL THEN 'LOW' END AS model_level,
  CASE WHEN score >= 0.7 THEN 'REVIEW' WHEN score IS NOT NULL THEN 'APPROVE' END AS model_decision,
  {r6('behavioral_risk_score')} AS behavioral_score, behavioral_risk_level AS behavioral_level,
  concat_ws(',', CASE WHEN r0 = 1 THEN 'HIGH_MODEL_RISK' END, CASE WHEN r1 = 1 THEN 'MEDIUM_MODEL_RISK' END,
            CASE WHEN r2 = 1 THEN 'NEW_CARD_NEW_DEVICE_HIGH_AMOUNT' END, CASE WHEN r3 = 1 THEN 'NEW_CARD' END,
            CASE WHEN r4 = 1 THEN 'NEW_DEVICE' END, CASE WHEN r5 = 1 THEN 'HIGH_CARD_VELOCITY' END,
            CASE WHEN r6 = 1 THEN 'SHARED_DEVICE' END, CASE WHEN r7 = 1 THEN 'UNUSUAL_AMOUNT' END) AS rule_ids,
  {r6('final')} AS final_risk_score,
  CASE WHEN final >= 0.8 THEN 'HIGH' WHEN final >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS final_risk_level,
  CASE WHEN score IS NULL OR final >= 0.5 THEN 'REVIEW' ELSE 'APPROVE' END AS final_decision,
  CAST(nc AS BIGINT) AS is_new_card, CAST(nd AS BIGINT) AS is_new_device,
  CAST(NOT (ch AND dh AND card_device_transaction_count > 0) AS BIGINT) AS is_new_card_device_pair,
  CAST(ch AS BIGINT) AS card_history_available, CAST(dh AS BIGINT) AS device_history_available,
  'COMPLETE' AS input_completeness,
  CASE WHEN round(ln(1 + TransactionAmt), 3) >= round(0.05 * ((TransactionDT // 3600) % 24), 3) THEN 'TransactionAmt_log'
       ELSE 'transaction_hour' END AS evidence,
  card_transaction_count, {r6('card_avg_amount')} AS card_average_amount, {r6('mx')} AS card_max_amount, {r6('mn')} AS card_min_amount,
  DeviceInfo AS device_info, CASE WHEN DeviceInfo IS NULL THEN 0 ELSE device_profile_count END AS device_transaction_count,
  CASE WHEN DeviceInfo IS NULL THEN 0 ELSE device_profile_unique_cards END AS device_unique_cards
FROM ff"""

ORACLE["identity_keep_first_duplicates"] = with_sql(SQL_TX, SQL_ID) + """
SELECT TransactionID // 3 AS TransactionID, min(DeviceInfo) AS DeviceInfo FROM idt GROUP BY 1"""

ORACLE["label_join_unlabelled"] = TX + """,
l AS (SELECT TransactionID FROM tx WHERE TransactionID % 5 <> 0
      UNION ALL SELECT TransactionID FROM tx WHERE TransactionID % 5 <> 0 AND TransactionID % 7 = 0),
j AS (SELECT tx.TransactionID, l.TransactionID AS lid FROM tx LEFT JOIN l ON tx.TransactionID = l.TransactionID)
SELECT count(*) AS rows, CAST(count_if(lid IS NULL) AS BIGINT) AS unlabelled, CAST(0 AS BIGINT) AS feature_dupes,
  (SELECT count(*) FROM (SELECT TransactionID FROM l GROUP BY 1 HAVING count(*) > 1)) AS label_dupes FROM j"""

ORACLE["seeded_sample"] = TX + """
SELECT TransactionID, TransactionDT, isFraud FROM tx ORDER BY md5('42:' || CAST(TransactionID AS VARCHAR)), TransactionID LIMIT 5000"""


def _sentence(feature: str) -> str:
    """SQL of a feature's sentence from the fixed templates; v: value, c: contribution."""
    from riskloom.functions.explain_text import TEMPLATES
    text = TEMPLATES[feature]
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    if isinstance(text, tuple):
        return f"CASE WHEN v = 1 THEN {quoted(text[0])} ELSE {quoted(text[1])} END"
    text = text.replace("{dir}", "%s")
    args = ["CAST(trunc(v) AS BIGINT)" if "%d" in text else "v"]
    if "%s" in text:
        args.append("CASE WHEN c > 0 THEN 'increases' ELSE 'decreases' END")
    return f"printf({quoted(text)}, {', '.join(args)})"


def _contributions() -> str:
    from riskloom.plans.catalog import EXPLAINED
    rows = " UNION ALL ".join(
        f"SELECT TransactionID, {i} AS i, '{f}' AS feature, floor(CAST(coalesce({f}, 0) AS DOUBLE) * 10 + 0.5) / 10 AS v FROM ft" for i, f in enumerate(EXPLAINED))
    return MERGED + f""",
ft AS (SELECT t.TransactionID, {_basic_cols().replace('TransactionAmt_x', 'TransactionAmt')}, {_batch_cols('m', rounded=False)} FROM m t),
cv AS (SELECT *, (CASE WHEN TransactionID % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE * ((i + 1) / 8.0::DOUBLE) * v AS c FROM ({rows}))"""


def _explanations() -> str:
    from riskloom.plans.catalog import EXPLAINED
    cases = " ".join(f"WHEN '{f}' THEN {_sentence(f)}" for f in EXPLAINED)
    return _contributions() + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY TransactionID ORDER BY abs(c) DESC, i) AS rank FROM cv)
SELECT TransactionID, rank, feature, CASE WHEN c > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS impact,
  CASE feature {cases} END AS explanation FROM rk WHERE rank <= 5"""


ORACLE["explanation_sentences"] = _explanations()
ORACLE["global_importance_fixed"] = _contributions() + """
SELECT feature, round(avg(abs(c)), 3) AS mean_abs_contribution FROM cv GROUP BY feature"""

_CROWDED = MERGED + """,
cr AS (SELECT * REPLACE (CASE WHEN TransactionID % 3 = 0 THEN 7 ELSE card1 END AS card1,
         CASE WHEN TransactionID % 3 = 0 THEN 'crowd' ELSE DeviceInfo END AS DeviceInfo,
         CASE WHEN TransactionID % 3 = 0 THEN 864000 + TransactionDT % 86400 ELSE TransactionDT END AS TransactionDT) FROM m)"""
ORACLE["features_crowded_day"] = _CROWDED + f"\nSELECT t.TransactionID, {_batch_cols('cr')} FROM cr t"
ORACLE["features_crowded_day_pit"] = _CROWDED + f"\nSELECT t.TransactionID, {_pit_cols('cr')} FROM cr t"


# --- M20 on the fixed score: isotonic fit by its max-min formula ----------------------------------
_RANK_CTES, _RANK_SELECT = _ranking("ca", None).split("\nSELECT ", 1)
_TOP = "sum(CASE WHEN rk <= floor(n * {rate}::DOUBLE) THEN y ELSE 0 END) * 1.0 / max(p)"
_JOB_METRICS = [
    ("roc_auc", "SELECT roc_auc FROM rm"), ("pr_auc", "SELECT pr_auc_trapezoid FROM rm"),
    ("precision", "SELECT precision FROM cr"), ("recall", "SELECT recall FROM cr"), ("f1", "SELECT f1 FROM cr"),
    *[(f"recall_at_{int(rate * 100)}pct", f"SELECT {r6(_TOP.format(rate=rate))} FROM rt") for rate in (0.01, 0.05, 0.10)],
    ("brier_raw", f"SELECT {r6('avg((raw - y) * (raw - y))')} FROM ca"),
    ("brier_calibrated", f"SELECT {r6('avg((score - y) * (score - y))')} FROM ca")]
ORACLE["job_evaluate_and_calibrate_fixed"] = with_sql(SQL_TX, SQL_SCORED) + """,
so AS (SELECT *, row_number() OVER (ORDER BY TransactionDT, TransactionID) AS rn, count(*) OVER () AS n FROM sc),
va AS (SELECT * FROM so WHERE rn > floor(n * 0.7::DOUBLE) AND rn <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE))),
vh AS (SELECT score AS s, sum(y) AS p, count(*) AS w, row_number() OVER (ORDER BY score) AS i FROM va GROUP BY score),
cu AS (SELECT *, sum(p) OVER (ORDER BY i) AS cp, sum(w) OVER (ORDER BY i) AS cw FROM vh),
sg AS (SELECT a.i AS a, b.i AS b, CAST(b.cp - a.cp + a.p AS DOUBLE) / CAST(b.cw - a.cw + a.w AS DOUBLE) AS m
       FROM cu a JOIN cu b ON a.i <= b.i),
mn AS (SELECT vh.i, sg.a, min(sg.m) AS m FROM vh JOIN sg ON sg.a <= vh.i AND sg.b >= vh.i GROUP BY vh.i, sg.a),
iso AS (SELECT vh.s, max(mn.m) AS v FROM vh JOIN mn ON mn.i = vh.i GROUP BY vh.s),
te AS (SELECT TransactionID, TransactionDT, y, score AS raw, (SELECT max(s) FROM iso WHERE s <= score) AS sl,
         (SELECT min(s) FROM iso WHERE s >= score) AS su
       FROM so WHERE rn > floor(n * (0.7::DOUBLE + 0.15::DOUBLE))),
ca AS (SELECT te.*, CASE WHEN sl IS NULL THEN hi.v WHEN su IS NULL OR sl = su THEN lo.v
         ELSE lo.v + (hi.v - lo.v) * (raw - sl) / (su - sl) END AS score
       FROM te LEFT JOIN iso lo ON lo.s = te.sl LEFT JOIN iso hi ON hi.s = te.su)""" + _RANK_CTES + f""",
rm AS (SELECT {_RANK_SELECT}),
cc AS (SELECT CAST(count_if(y = 0 AND score < 0.5) AS BIGINT) AS tn, CAST(count_if(y = 0 AND score >= 0.5) AS BIGINT) AS fp,
         CAST(count_if(y = 1 AND score < 0.5) AS BIGINT) AS fn, CAST(count_if(y = 1 AND score >= 0.5) AS BIGINT) AS tp FROM ca),
cr AS (SELECT {_rates_sql('cc')} FROM cc),
rt AS (SELECT y, row_number() OVER (ORDER BY score DESC, TransactionDT, TransactionID) AS rk, count(*) OVER () AS n,
         sum(y) OVER () AS p FROM ca),
bi AS (SELECT ca.*, (SELECT count(*) FROM unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS u(x)
         WHERE u.x < ca.score) AS bin FROM ca),
cv AS (SELECT bin, {r6('avg(y)')} AS prob_true, {r6('avg(score)')} AS prob_pred FROM bi GROUP BY bin),
al AS (""" + "\nUNION ALL ".join(
    f"SELECT 'metrics' AS section, '{name}' AS metric, CAST(({sql}) AS DOUBLE) AS value" for name, sql in _JOB_METRICS) + """
UNION ALL SELECT 'calibration_curve', 'bin_' || CAST(bin AS VARCHAR) || '_mean_predicted', prob_pred FROM cv
UNION ALL SELECT 'calibration_curve', 'bin_' || CAST(bin AS VARCHAR) || '_fraction_positive', prob_true FROM cv)
SELECT 'evaluation_metrics' AS report, section, metric, value FROM al"""
