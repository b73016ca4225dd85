"""Queries of the general training-data operators (p3 to p5) with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.cluster import tables
from tickloom.operators import changes, spikes
from tickloom.streaming import late_events


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_events.outcomes(late_events.trade_periods(tables(spark, sf_dir, "trades")))


def p3_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = late_events.trade_periods(tables(spark, sf_dir, "trades"))
    return p.select(F.col("key").alias("instrument_id"), "period_start_s", "n", "volume", F.round("notional", 2).alias("notional"), "low", "high", "day_n", "day_volume", "first_n", "n_late", "n_cut_off")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spikes.market_spikes(tables(spark, sf_dir, "market_data"), tables(spark, sf_dir, "trade_features"))
    return found.select("source_table", "row_id", "field")


def p4_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spikes.candidates(*spikes.market_readings(tables(spark, sf_dir, "market_data"), tables(spark, sf_dir, "trade_features")))
    return found.select("source_table", "field", "n_readings", "n_confirmed", "n_rule")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    alive = changes.resting_orders(tables(spark, sf_dir, "mbo_messages"))
    return alive.select(F.date_format("trade_date", "yyyy-MM-dd").alias("trade_date"), "instrument_id", "order_id", "price_ticks", "size")


QUERIES = {"p3_found": p3_found, "p3_periods": p3_periods, "p4_found": p4_found, "p4_candidates": p4_candidates, "p5_found": p5_found}

_P3 = """
WITH r AS (
  SELECT trade_date, trade_sequence, instrument_id, row_id, trade_price, trade_size,
         coalesce(ts, nullif(trade_ts_recv, 0) - trade_ts_in_delta) AS event,
         coalesce(nullif(trade_ts_recv, 0), ts + trade_ts_in_delta) AS arrival
  FROM trades),
f AS (
  SELECT *, event // 60000000000 * 60 AS p FROM r WHERE event IS NOT NULL AND arrival IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY trade_date, instrument_id, trade_sequence ORDER BY arrival, row_id) = 1),
l AS (SELECT *, arrival - (p + 60) * 1000000000 AS late FROM f)
"""

_P4 = """
WITH m AS (
  SELECT 'market_data' AS source_table, unnest(['trade_price', 'bid_px_00', 'ask_px_00']) AS field, symbol AS src, timestamp_ns AS t, row_id,
         unnest([trade_price, bid_px_00, ask_px_00]) AS v FROM market_data
  UNION ALL
  SELECT 'trade_features', 'mean_latency_ns_500ms', cast(instrument_id AS VARCHAR), ts_ns, row_id, mean_latency_ns_500ms FROM trade_features),
k AS (SELECT * FROM m WHERE v IS NOT NULL AND NOT (cast(v AS VARCHAR) = 'nan') AND v <> 0),
g AS (SELECT source_table, field, src, t, arg_min(v, row_id) AS v FROM k WHERE src IS NOT NULL AND t IS NOT NULL GROUP BY ALL),
n AS (
  SELECT *, lag(v, 1) OVER w AS b1, lag(v, 2) OVER w AS b2, lag(v, 3) OVER w AS b3, lead(v, 1) OVER w AS a1, lead(v, 2) OVER w AS a2, lead(v, 3) OVER w AS a3,
         CASE WHEN lag(v, 1) OVER w = v THEN 0 ELSE 1 END AS fresh FROM g
  WINDOW w AS (PARTITION BY source_table, field, src ORDER BY t)),
d AS (SELECT source_table, field, src, 12 * median(abs(v - b1)) AS lim FROM n GROUP BY ALL),
u AS (
  SELECT n.*, lim, sum(fresh) OVER (PARTITION BY source_table, field, src ORDER BY t) AS run FROM n JOIN d USING (source_table, field, src)),
c AS (SELECT *, count(*) OVER (PARTITION BY source_table, field, src, run) AS len FROM u),
bad AS (
  SELECT source_table, field, src, t, away > lim AS spike FROM (SELECT *, greatest(
    CASE WHEN b1 IS NOT NULL AND a1 IS NOT NULL THEN least(abs(v - b1), abs(v - a1)) ELSE 0 END,
    CASE WHEN b1 IS NOT NULL AND a2 IS NOT NULL THEN least(abs(v - b1), abs(v - a2), abs(a1 - b1), abs(a1 - a2)) ELSE 0 END,
    CASE WHEN b2 IS NOT NULL AND a1 IS NOT NULL THEN least(abs(b1 - b2), abs(b1 - a1), abs(v - b2), abs(v - a1)) ELSE 0 END,
    CASE WHEN b1 IS NOT NULL AND a3 IS NOT NULL THEN least(abs(v - b1), abs(v - a3), abs(a1 - b1), abs(a1 - a3), abs(a2 - b1), abs(a2 - a3)) ELSE 0 END,
    CASE WHEN b2 IS NOT NULL AND a2 IS NOT NULL THEN least(abs(b1 - b2), abs(b1 - a2), abs(v - b2), abs(v - a2), abs(a1 - b2), abs(a1 - a2)) ELSE 0 END,
    CASE WHEN b3 IS NOT NULL AND a1 IS NOT NULL THEN least(abs(b2 - b3), abs(b2 - a1), abs(b1 - b3), abs(b1 - a1), abs(v - b3), abs(v - a1)) ELSE 0 END) AS away FROM c)
  WHERE v < 0 OR away > lim OR fresh = 0 AND len >= CASE WHEN source_table = 'market_data' THEN 20 ELSE 12 END)
"""

_P5 = """
WITH d AS (
  SELECT * FROM mbo_messages WHERE sequence IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY trade_date, instrument_id, sequence ORDER BY seq) = 1),
n AS (
  SELECT trade_date, instrument_id, order_id, sequence, upper(action) AS act, upper(side) AS sd, coalesce(size, 0) AS size,
         CASE WHEN price IS NULL OR (cast(price AS VARCHAR) = 'nan') OR isinf(price) THEN 0 ELSE cast(round_even(price / 0.25, 0) AS BIGINT) END AS px FROM d),
e AS (
  SELECT n.*, max(CASE WHEN act = 'R' THEN sequence END) OVER (PARTITION BY trade_date, instrument_id) AS cleared FROM n),
k AS (
  SELECT *, CASE WHEN act IN ('A', 'M') AND px > 0 AND sd IN ('B', 'A') AND size > 0 THEN 1 WHEN act = 'M' AND px > 0 THEN 2 WHEN act = 'C' THEN 2 WHEN act = 'F' THEN 3 END AS kind
  FROM e WHERE cleared IS NULL OR sequence > cleared),
l AS (SELECT *, max(CASE WHEN kind < 3 THEN sequence END) OVER (PARTITION BY trade_date, instrument_id, order_id) AS born FROM k WHERE kind IS NOT NULL)
SELECT strftime(trade_date, '%Y-%m-%d') AS trade_date, instrument_id, order_id, max(CASE WHEN sequence = born THEN px END) AS price_ticks,
       cast(max(CASE WHEN sequence = born THEN size END) - coalesce(sum(CASE WHEN sequence > born AND kind = 3 THEN greatest(size, 0) END), 0) AS BIGINT) AS size
FROM l GROUP BY l.trade_date, instrument_id, order_id
HAVING max(CASE WHEN sequence = born THEN kind END) = 1
   AND max(CASE WHEN sequence = born THEN size END) > coalesce(sum(CASE WHEN sequence > born AND kind = 3 THEN greatest(size, 0) END), 0)
"""

ORACLES = {
    "p3_found": _P3 + "SELECT DISTINCT instrument_id, p AS period_start_s, CASE WHEN late >= 900000000000 THEN 'cut_off' ELSE 'corrected' END AS outcome FROM l WHERE late >= 5000000000",
    "p3_periods": _P3
    + """, a AS (
  SELECT instrument_id, p AS period_start_s, count(*) FILTER (WHERE late < 900000000000) AS n,
         cast(coalesce(sum(trade_size) FILTER (WHERE late < 900000000000), 0) AS BIGINT) AS volume,
         round(coalesce(sum(trade_price * trade_size) FILTER (WHERE late < 900000000000), 0), 2) AS notional,
         min(trade_price) FILTER (WHERE late < 900000000000) AS low, max(trade_price) FILTER (WHERE late < 900000000000) AS high,
         count(*) FILTER (WHERE late < 5000000000) AS first_n,
         count(*) FILTER (WHERE late >= 5000000000 AND late < 900000000000) AS n_late, count(*) FILTER (WHERE late >= 900000000000) AS n_cut_off
  FROM l GROUP BY 1, 2)
SELECT instrument_id, period_start_s, n, volume, notional, low, high,
       cast(sum(n) OVER w AS BIGINT) AS day_n, cast(sum(volume) OVER w AS BIGINT) AS day_volume, first_n, n_late, n_cut_off
FROM a WINDOW w AS (PARTITION BY instrument_id, period_start_s // 86400 ORDER BY period_start_s)""",
    "p4_found": _P4
    + """SELECT k.source_table, k.row_id, k.field FROM k JOIN bad USING (source_table, field, src, t)
UNION ALL SELECT source_table, row_id, field FROM k WHERE v < 0 AND (src IS NULL OR t IS NULL)""",
    "p4_candidates": _P4
    + """SELECT source_table, field, count(*) AS n_readings, count(spike) FILTER (WHERE spike) AS n_confirmed, count(spike) FILTER (WHERE spike) AS n_rule
FROM g LEFT JOIN bad USING (source_table, field, src, t) GROUP BY ALL""",
    "p5_found": _P5,
}
