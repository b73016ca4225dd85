"""Queries of the operators in this subpackage with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.cluster import tables
from tickloom.llm import digest, nearest, packing, spam, tokens
from tickloom.operators import ordered


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select(F.col("right_id").alias("snap_id"), F.col("left_id").alias("row_id"))


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select(F.col("left_id").alias("row_id"), "atm_iv", "net_gex", "distance_ns")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.regressor_snapshots(tables(spark, sf_dir, "regressors"), tables(spark, sf_dir, "options_features"))


def _percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.percentiles(digest.market_values(*(tables(spark, sf_dir, t) for t in ("markouts", "trade_features", "options_features"))))


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _percentiles(spark, sf_dir)


def p2_within_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _percentiles(spark, sf_dir)
    return p.select("metric", "grp", F.date_format("day", "yyyy-MM-dd").alias("day"), "over_days", "p", "n", (F.col("rank_error") <= F.col("bound")).alias("within_bound"))


def p2_certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact percentile of every group whose estimate the counting pass found within its bound, else null."""
    values = digest.market_values(*(tables(spark, sf_dir, t) for t in ("markouts", "trade_features", "options_features")))
    keys, qs = ["metric", "grp", "day"], list(digest.QUANTILES)
    days = ordered.exact_percentiles(values, keys, "value", qs)
    exact = days.withColumn("over_days", F.lit(False)).unionByName(ordered.exact_percentiles(values, keys[:2], "value", qs).withColumns({"day": F.lit(None).cast("date"), "over_days": F.lit(True)}))
    each = exact.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "over_days")], F.posexplode("q").alias("at", "exact"))
    p = digest.percentiles(values).withColumn("at", F.array_position(F.array(*map(F.lit, qs)), F.col("p")) - 1)
    same = (F.col("over_days") == F.col("_over_days")) & (p["at"] == each["at"])
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    sure = F.when(F.col("rank_error") <= F.col("bound"), F.round("exact", 6))
    return p.join(each, same).select("metric", "grp", F.date_format("day", "yyyy-MM-dd").alias("day"), "over_days", "p", "n", sure.alias("exact"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(tables(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(tables(spark, sf_dir, "documents"))


def p7_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with text and documents placed, containers above the capacity, documents divided without need, and whether there are at most 0.5 % and one container more than the tokens need."""
    placed = packing.pack_documents(tables(spark, sf_dir, "documents")).where(F.col("container_id").isNotNull())
    boxes = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).agg(F.count("*").alias("boxes"), F.sum("used").alias("tokens"), F.count(F.when(F.col("used") > packing.CAPACITY, 1)).alias("n_over_capacity"))
    docs = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("pieces")).agg(F.count("*").alias("n_placed"), F.count(F.when((F.col("pieces") > 1) & (F.col("size") <= packing.CAPACITY), 1)).alias("n_divided"))
    texts = tables(spark, sf_dir, "documents").where(F.length("text") > 0).agg(F.countDistinct("doc_id").alias("n_documents"))
    near = F.col("boxes") <= F.ceil(F.col("tokens") / packing.CAPACITY) * 1.005 + 1
    return texts.crossJoin(docs).crossJoin(boxes).select("n_documents", "n_placed", "n_over_capacity", "n_divided", near.alias("near_least"))  # one row each


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(tables(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p1_values": p1_values, "p2_percentiles": p2_percentiles, "p2_within_bound": p2_within_bound, "p2_certified": p2_certified, "p6_ids": p6_ids, "p7_containers": p7_containers, "p7_proof": p7_proof, "p8_found": p8_found}

_P1 = """
WITH s AS (
  SELECT instrument_id, ts_ns, min(snap_id) AS snap_id, arg_min(atm_iv, snap_id) AS atm_iv, arg_min(net_gex, snap_id) AS net_gex FROM options_features
  WHERE atm_iv IS NOT NULL AND NOT (cast(atm_iv AS VARCHAR) = 'nan') AND net_gex IS NOT NULL AND NOT (cast(net_gex AS VARCHAR) = 'nan') AND ts_ns IS NOT NULL GROUP BY 1, 2),
c AS (
  SELECT r.row_id, s.*, abs(r.ts_ns - s.ts_ns) AS distance_ns, s.ts_ns AS at FROM regressors r JOIN s ON r.instrument_id = s.instrument_id AND s.ts_ns BETWEEN r.ts_ns - 40000000000 AND r.ts_ns + 40000000000
  QUALIFY row_number() OVER (PARTITION BY r.row_id ORDER BY abs(r.ts_ns - s.ts_ns), s.ts_ns, snap_id) = 1)
"""

_V = """
WITH v AS (
  SELECT 'signed_markout' AS metric, cast(window_ms AS BIGINT) AS grp, trade_date, signed_markout AS x FROM markouts
  UNION ALL SELECT 'spread_ticks', instrument_id, trade_date, spread_ticks FROM trade_features
  UNION ALL SELECT 'net_gex', instrument_id, trade_date, net_gex FROM options_features),
k AS (SELECT * FROM v WHERE x IS NOT NULL AND NOT (cast(x AS VARCHAR) = 'nan'))
"""
_P2 = _V + """, c AS (
  SELECT metric, grp, strftime(trade_date, '%Y-%m-%d') AS day, FALSE AS over_days, count(*) AS n FROM v WHERE x IS NOT NULL AND NOT (cast(x AS VARCHAR) = 'nan') GROUP BY ALL
  UNION ALL SELECT metric, grp, NULL, TRUE, count(*) FROM v WHERE x IS NOT NULL AND NOT (cast(x AS VARCHAR) = 'nan') GROUP BY ALL)
SELECT metric, grp, day, over_days, cast(p AS DOUBLE) AS p, n, TRUE AS within_bound FROM c, (SELECT unnest([0.05, 0.5, 0.95, 0.99]) AS p)
"""

ORACLES = {
    "p1_found": _P1 + "SELECT snap_id, row_id FROM c",
    "p1_values": _P1 + "SELECT row_id, atm_iv, net_gex, distance_ns FROM c",
    "p2_within_bound": _P2,
    "p2_certified": _V
    + """, c AS (
  SELECT metric, grp, strftime(trade_date, '%Y-%m-%d') AS day, FALSE AS over_days, count(*) AS n, quantile_cont(x, [0.05, 0.5, 0.95, 0.99]) AS q FROM k GROUP BY ALL
  UNION ALL SELECT metric, grp, NULL, TRUE, count(*), quantile_cont(x, [0.05, 0.5, 0.95, 0.99]) FROM k GROUP BY ALL)
SELECT metric, grp, day, over_days, cast([0.05, 0.5, 0.95, 0.99][place] AS DOUBLE) AS p, n, round(q[place], 6) AS exact FROM c, (SELECT unnest([1, 2, 3, 4]) AS place)""",
    "p7_proof": "SELECT count(*) AS n_documents, count(*) AS n_placed, cast(0 AS BIGINT) AS n_over_capacity, cast(0 AS BIGINT) AS n_divided, TRUE AS near_least FROM documents WHERE length(text) > 0",
}
