"""DuckDB SQL text for the oracle side of each registered query.

Each oracle is ``WITH <fixture CTE>, <shared CTEs> <final SELECT>``. Shared
CTEs mirror the Spark operators' definitions (not their physical plans):
DuckDB only has to compute the same values on the same parquet tables.
Doubles are compared after ``round(x, 6)`` on both sides.
"""

from __future__ import annotations

from txrisk.sources.fixtures import duckdb_fx1

TX = f"tx AS ({duckdb_fx1()})"

FEAT = """
ts AS (SELECT type, avg(amount) AS type_mean, stddev_samp(amount) AS type_std FROM tx GROUP BY type),
ti AS (SELECT type, CAST(dense_rank() OVER (ORDER BY type) - 1 AS INTEGER) AS type_encoded
       FROM (SELECT DISTINCT type FROM tx WHERE type IS NOT NULL)),
os AS (SELECT nameOrig, CAST(count(isFraud) AS BIGINT) AS orig_tx_count, sum(amount) AS orig_total_sent,
              CAST(count(DISTINCT nameDest) AS BIGINT) AS orig_unique_dests FROM tx GROUP BY nameOrig),
feat AS (
  SELECT t.*,
    ln(1 + amount) AS amount_log,
    (amount - ts.type_mean) / (ts.type_std + CAST(1e-9 AS DOUBLE)) AS amount_zscore,
    CAST(amount % 100 = 0 AS INTEGER) AS is_round_amount,
    newbalanceOrig - oldbalanceOrg AS balance_diff_orig,
    newbalanceDest - oldbalanceDest AS balance_diff_dest,
    newbalanceOrig / (oldbalanceOrg + 1) AS balance_ratio_orig,
    newbalanceDest / (oldbalanceDest + 1) AS balance_ratio_dest,
    abs(greatest(oldbalanceOrg - amount, CAST(0 AS DOUBLE)) - newbalanceOrig) AS orig_balance_error,
    abs(oldbalanceDest + amount - newbalanceDest) AS dest_balance_error,
    CAST(abs(greatest(oldbalanceOrg - amount, CAST(0 AS DOUBLE)) - newbalanceOrig) > CAST(0.01 AS DOUBLE) AS INTEGER) AS has_orig_error,
    CAST(abs(oldbalanceDest + amount - newbalanceDest) > CAST(0.01 AS DOUBLE) AS INTEGER) AS has_dest_error,
    CAST(oldbalanceOrg = 0 AS INTEGER) AS orig_zero_before,
    CAST(newbalanceOrig = 0 AS INTEGER) AS orig_zero_after,
    CAST(oldbalanceDest = 0 AS INTEGER) AS dest_zero_before,
    step % 24 AS hour_of_day,
    (step // 24) % 7 AS day_of_week,
    step % 24 AS step_mod_24,
    ti.type_encoded, os.orig_tx_count, os.orig_total_sent, os.orig_unique_dests
  FROM tx t LEFT JOIN ts USING (type) LEFT JOIN ti USING (type) LEFT JOIN os USING (nameOrig))
"""

SPLIT = """
sp AS (SELECT *, CASE WHEN step IS NULL THEN NULL WHEN step <= 600 THEN 'train'
                      WHEN step <= 672 THEN 'val' ELSE 'test' END AS split FROM feat)
"""

RULE = """
ru AS (SELECT *,
  least(
    CASE WHEN type IN ('CASH_OUT','TRANSFER') THEN CAST(0.20 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    + CASE WHEN oldbalanceOrg > 0 AND newbalanceOrig = 0 THEN CAST(0.30 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    + CASE WHEN amount > 500000 THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    + CASE WHEN oldbalanceDest = newbalanceDest AND amount > 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    + CASE WHEN amount % 100000 = 0 AND amount > 0 THEN CAST(0.10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END,
    CAST(1.0 AS DOUBLE)) AS rule_score
  FROM tx),
bl AS (SELECT *, least(score_stub + rule_score * CAST(0.1 AS DOUBLE), CAST(1.0 AS DOUBLE)) AS p FROM ru),
al AS (SELECT tx_id, step, type, amount, nameOrig, oldbalanceOrg, newbalanceOrig, nameDest, oldbalanceDest,
  newbalanceDest, isFraud, isFlaggedFraud, rule_score, round(p, 4) AS fraud_proba,
  p >= CAST(0.7 AS DOUBLE) AS is_fraud,
  CASE WHEN p >= CAST(0.9 AS DOUBLE) THEN 'CRITICAL' WHEN p >= CAST(0.7 AS DOUBLE) THEN 'HIGH'
       WHEN p >= CAST(0.5 AS DOUBLE) THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  coalesce(nullif(concat_ws('; ',
    CASE WHEN type IN ('CASH_OUT','TRANSFER') THEN 'High-risk tx type (' || type || ')' END,
    CASE WHEN newbalanceOrig = 0 AND oldbalanceOrg > 0 THEN 'Origin account fully drained' END,
    CASE WHEN oldbalanceDest = newbalanceDest THEN 'Destination balance unchanged (possible layering)' END,
    CASE WHEN amount > 1000000 THEN 'Very large amount ($' || format('{:,.0f}', amount) || ')' END,
    CASE WHEN rule_score > CAST(0.5 AS DOUBLE) THEN 'Rule engine score: ' || printf('%.2f', rule_score) END,
    CASE WHEN p > CAST(0.7 AS DOUBLE) THEN 'ML model confidence: ' || printf('%.2f', p * 100) || '%' END), ''),
    'ML model flagged') AS alert_reason
  FROM bl)
"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


GRAPH = """
nd AS (SELECT DISTINCT account FROM (SELECT nameOrig AS account FROM tx UNION ALL SELECT nameDest FROM tx) q WHERE account IS NOT NULL),
ed AS (SELECT nameOrig AS src, nameDest AS dst, arg_max(amount, (step, tx_id)) AS amount,
  ln(1 + arg_max(amount, (step, tx_id))) AS amount_log, arg_max(step, (step, tx_id)) AS step,
  arg_max(type_encoded, (step, tx_id)) AS tx_type, arg_max(isFraud, (step, tx_id)) AS is_fraud
  FROM feat WHERE nameOrig IS NOT NULL AND nameDest IS NOT NULL GROUP BY nameOrig, nameDest),
lb AS (SELECT nd.account, CAST(coalesce(s.f, 0) AS INTEGER) AS is_fraud FROM nd
  LEFT JOIN (SELECT nameOrig AS account, max(isFraud) AS f FROM tx GROUP BY nameOrig) s USING (account)),
dg AS (SELECT account, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) + coalesce(o.c, 0) AS degree,
  coalesce(i.w, 0) AS weighted_in_deg, coalesce(o.w, 0) AS weighted_out_deg
  FROM (SELECT src AS account, count(*) AS c, sum(amount) AS w FROM ed GROUP BY src) o
  FULL JOIN (SELECT dst AS account, count(*) AS c, sum(amount) AS w FROM ed GROUP BY dst) i USING (account)),
und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ed WHERE src <> dst),
adj AS (SELECT a AS u, b AS v FROM und UNION ALL SELECT b, a FROM und),
udeg AS (SELECT u, count(*) AS d FROM adj GROUP BY u),
tri AS (SELECT x.u, count(*) AS t FROM adj x JOIN adj y ON x.u = y.u AND x.v < y.v JOIN und z ON z.a = x.v AND z.b = y.v GROUP BY x.u),
cc AS (SELECT udeg.u AS account, CASE WHEN d >= 2 THEN CAST(2 AS DOUBLE) * coalesce(t, 0) / (d * (d - 1)) ELSE CAST(0 AS DOUBLE) END AS clustering_coeff
  FROM udeg LEFT JOIN tri ON tri.u = udeg.u),
an AS (SELECT ed.src AS account, avg(CAST(coalesce(dg.out_degree, 0) AS DOUBLE)) AS avg_neighbor_deg FROM ed LEFT JOIN dg ON dg.account = ed.dst GROUP BY ed.src),
lf AS (SELECT q.account, avg(CAST(coalesce(lb.is_fraud, 0) AS DOUBLE)) AS local_fraud_rate
  FROM (SELECT src AS account, dst AS nb FROM ed UNION ALL SELECT dst, src FROM ed) q LEFT JOIN lb ON lb.account = q.nb GROUP BY q.account)
"""


def pagerank_sql(iterations: int, alpha: str = "0.85") -> str:
    a = f"CAST({alpha} AS DOUBLE)"
    parts = [
        """wo AS (SELECT src, sum(amount) AS wout FROM ed GROUP BY src HAVING sum(amount) <> 0),
en AS (SELECT ed.src, ed.dst, ed.amount / wo.wout AS w FROM ed JOIN wo USING (src)),
nn AS (SELECT CAST(count(*) AS DOUBLE) AS N FROM nd),
fl AS (SELECT nd.account, wo.src IS NULL AS dangling FROM nd LEFT JOIN wo ON wo.src = nd.account),
p0 AS MATERIALIZED (SELECT account, dangling, 1 / N AS x FROM fl, nn)"""
    ]
    for i in range(1, iterations + 1):
        parts.append(
            f"""p{i} AS MATERIALIZED (SELECT fl.account, fl.dangling, {a} * (coalesce(c.s, 0) + d.ds / nn.N) + (CAST(1 AS DOUBLE) - {a}) / nn.N AS x
  FROM fl LEFT JOIN (SELECT en.dst, sum(p.x * en.w) AS s FROM p{i - 1} p JOIN en ON p.account = en.src GROUP BY en.dst) c ON c.dst = fl.account,
  (SELECT coalesce(sum(x), 0) AS ds FROM p{i - 1} WHERE dangling) d, nn)"""
        )
    return ",\n".join(parts)


def betweenness_sql(hops: int) -> str:
    """``bt`` (account, b): exact betweenness as a sum over pairs through each
    node. Distances and path counts take ``hops`` unrolled rounds, enough for
    shortest paths of that many edges."""
    parts = [
        """wt AS (SELECT src, dst, greatest(CAST(round(amount * 100) AS BIGINT), 1) AS w FROM ed),
d0 AS (SELECT account AS s, account AS v, CAST(0 AS BIGINT) AS d FROM nd)"""
    ]
    for i in range(1, hops + 1):
        parts.append(
            f"""d{i} AS MATERIALIZED (SELECT s, v, min(d) AS d FROM (SELECT * FROM d{i - 1}
  UNION ALL SELECT p.s, wt.dst, p.d + wt.w FROM d{i - 1} p JOIN wt ON wt.src = p.v) GROUP BY s, v)"""
        )
    parts.append(
        f"""dg1 AS MATERIALIZED (SELECT a.s, wt.src AS u, wt.dst AS v FROM d{hops} a JOIN wt ON wt.src = a.v
  JOIN d{hops} b ON b.s = a.s AND b.v = wt.dst WHERE a.d + wt.w = b.d),
g0 AS (SELECT s, v, CASE WHEN s = v THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS g FROM d{hops})"""
    )
    for i in range(1, hops + 1):
        parts.append(
            f"""g{i} AS MATERIALIZED (SELECT g0.s, g0.v, g0.g + coalesce(m.g, 0) AS g FROM g0
  LEFT JOIN (SELECT e.s, e.v, sum(p.g) AS g FROM dg1 e JOIN g{i - 1} p ON p.s = e.s AND p.v = e.u GROUP BY e.s, e.v) m
  ON m.s = g0.s AND m.v = g0.v)"""
        )
    parts.append(
        f"""sp1 AS MATERIALIZED (SELECT d.s, d.v, d.d, g.g FROM d{hops} d JOIN g{hops} g ON g.s = d.s AND g.v = d.v),
bt AS (SELECT a.v AS account, sum(a.g * b.g / t.g) AS b FROM sp1 a JOIN sp1 b ON b.s = a.v JOIN sp1 t ON t.s = a.s AND t.v = b.v
  WHERE a.s <> a.v AND b.v <> a.v AND a.s <> b.v AND a.d + b.d = t.d GROUP BY a.v)"""
    )
    return ",\n".join(parts)
