"""Fixture views: transaction tables derived by pure SQL from the driver tables.

The driver tables hold no transaction table of the reference's shape, so the
transaction table is *derived* from ``events`` (FX1, the default) or from
``lineitem`` x ``orders`` (FX2, the larger bench fixture). The same SQL text
runs in Spark and in DuckDB (the oracle), with two dialect placeholders.
Spark runs it through ``spark.sql`` with the source tables passed as
DataFrames, so Catalyst prunes columns and pushes filters into the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# FX1 `tx_events`; placeholders: {events} source, {STR} string type name.
FX1_SQL = """
WITH b AS (
  SELECT event_id AS tx_id,
    CAST((extract(day FROM ts)-1)*24 + extract(hour FROM ts) + 1 AS INT) AS step,
    CASE event_type WHEN 'click' THEN 'CASH_IN' WHEN 'error' THEN 'CASH_OUT' WHEN 'purchase' THEN 'DEBIT'
                    WHEN 'signup' THEN 'PAYMENT' ELSE 'TRANSFER' END AS type,
    CAST(CAST(round(value*100) AS BIGINT)*50 AS DOUBLE) AS amount,
    concat('C', CAST(user_id AS {STR})) AS nameOrig,
    concat(CASE WHEN event_type='signup' THEN 'M' ELSE 'C' END, regexp_extract(props,'([0-9]+)',1)) AS nameDest
  FROM {events}),
c AS (
  SELECT *, CASE tx_id % 4 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN amount
                           ELSE amount + CAST((tx_id % 1000)*100 AS DOUBLE) END AS oldbalanceOrg,
    CAST((tx_id % 5)*20000 AS DOUBLE) AS oldbalanceDest FROM b),
d AS (
  SELECT tx_id, step, type, amount, nameOrig, oldbalanceOrg,
    greatest(oldbalanceOrg-amount, CAST(0 AS DOUBLE)) + CASE WHEN tx_id % 10 = 0 THEN CAST(50 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS newbalanceOrig,
    nameDest, oldbalanceDest,
    CASE WHEN tx_id % 3 = 0 THEN oldbalanceDest ELSE oldbalanceDest + amount END AS newbalanceDest,
    CASE WHEN type IN ('CASH_OUT','TRANSFER') AND tx_id % 4 = 1 AND amount > 100000 THEN 1 ELSE 0 END AS isFraud,
    CASE WHEN type = 'TRANSFER' AND amount > 1000000 THEN 1 ELSE 0 END AS isFlaggedFraud
  FROM c)
SELECT *, round(CAST((tx_id*37) % 101 AS DOUBLE)/200 + CASE WHEN isFraud=1 THEN CAST(0.35 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  + CASE WHEN type IN ('CASH_OUT','TRANSFER') THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 6) AS score_stub
FROM d
"""

# FX2 `tx_orders`; placeholders: {lineitem} {orders} sources, {STR}, {DAYS}.
FX2_SQL = """
WITH b AS (
  SELECT ((l_orderkey*8 + l_linenumber)*100000 + l_partkey)*10000 + l_suppkey AS tx_id,
    CAST(floor(CAST({DAYS} AS DOUBLE)*744/2410) AS INT) + 1 AS step,
    CASE substring(o_orderpriority,1,1) WHEN '1' THEN 'CASH_IN' WHEN '2' THEN 'CASH_OUT' WHEN '3' THEN 'DEBIT'
                                        WHEN '4' THEN 'PAYMENT' ELSE 'TRANSFER' END AS type,
    CAST(round(l_extendedprice*10) AS DOUBLE) AS amount,
    concat('C', CAST(o_custkey AS {STR})) AS nameOrig, concat('M', CAST(l_suppkey AS {STR})) AS nameDest,
    l_returnflag AS rf, l_linenumber AS ln
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey),
c AS (
  SELECT *, CASE WHEN rf='R' THEN amount ELSE amount + CAST(ln*1000 AS DOUBLE) END AS oldbalanceOrg, CAST(ln*5000 AS DOUBLE) AS oldbalanceDest FROM b)
SELECT tx_id, step, type, amount, nameOrig, oldbalanceOrg, greatest(oldbalanceOrg-amount, CAST(0 AS DOUBLE)) AS newbalanceOrig,
  nameDest, oldbalanceDest, CASE WHEN rf='A' THEN oldbalanceDest ELSE oldbalanceDest + amount END AS newbalanceDest,
  CASE WHEN type IN ('CASH_OUT','TRANSFER') AND rf='R' AND ln=7 THEN 1 ELSE 0 END AS isFraud,
  CASE WHEN type='TRANSFER' AND amount > 1000000 THEN 1 ELSE 0 END AS isFlaggedFraud
FROM c
"""

_SPARK_DAYS = "datediff(o_orderdate, DATE'1995-01-01')"
_DUCK_DAYS = "date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX1: one transaction per ``events`` row (tx_id, 11 raw columns, score_stub)."""
    sql = FX1_SQL.replace("{STR}", "STRING")
    return spark.sql(sql, events=table(spark, sf_dir, "events"))


def tx_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX2: one transaction per ``lineitem`` row joined to its order."""
    sql = FX2_SQL.replace("{STR}", "STRING").replace("{DAYS}", _SPARK_DAYS)
    return spark.sql(
        sql, lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders")
    )


def duckdb_fx1() -> str:
    return FX1_SQL.replace("{STR}", "VARCHAR").replace("{events}", "events")


def duckdb_fx2() -> str:
    return (
        FX2_SQL.replace("{STR}", "VARCHAR")
        .replace("{DAYS}", _DUCK_DAYS)
        .replace("{lineitem}", "lineitem")
        .replace("{orders}", "orders")
    )
