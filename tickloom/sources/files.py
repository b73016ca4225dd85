"""Daily message files, option quote files, depth CSVs and model files; what is written back out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import options
from tickloom.sources.messages import session_label

#: Files from this size on hold a weekday's session.
WEEKDAY_BYTES = 10_000_000


def daily_files(spark: SparkSession, folder: str, pattern: str = "*", least_bytes: int = WEEKDAY_BYTES, days: int | None = None) -> DataFrame:
    """``path, bytes, session`` of a folder's files, by name; those of at least the size, and the first so many sessions of them.

    Only the listing is read; the contents are pruned.
    """
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    f = f.where(F.col("length") > least_bytes).select("path", F.col("length").alias("bytes"), session_label(F.col("path")).alias("session"))
    f = f.orderBy("path")
    return f.limit(days) if days is not None else f


def messages(spark: SparkSession, folder: str, pattern: str = "*.parquet", least_bytes: int = 0) -> DataFrame:
    """The message files of a folder with the ``session`` of each row's file; small files are left out as a whole by their metadata."""
    df = spark.read.option("pathGlobFilter", pattern).parquet(folder)
    return df.where(F.col("_metadata.file_size") > least_bytes).withColumn("session", session_label(F.col("_metadata.file_path")))


def convert(spark: SparkSession, paths: list[str], decode, schema: str, folder: str) -> None:
    """Binary message files to parquet, each by one task: ``decode`` turns a local path into pandas frames, so a file may be larger than memory. Convert once, then read the parquet."""
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(len(paths), 1), "path")

    def run(batches):
        for b in batches:
            for path in b["path"]:
                yield from decode(path)

    listed.mapInPandas(run, schema).write.mode("append").parquet(folder)


DEPTH_COLUMNS = 73


def depth_schema(levels: int = 10) -> T.StructType:
    """Positional columns of a depth CSV: side 5, trade price and size 7 and 8, level 0 from 12, levels 1 on from 16 in fours, symbol 72."""
    names = [f"c{k}" for k in range(DEPTH_COLUMNS)]
    names[5], names[7], names[8], names[72] = "side", "trade_price", "trade_size", "symbol"
    names[12:16] = ["bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00"]
    for k in range(1, levels):
        at = 16 + 4 * (k - 1)
        names[at : at + 4] = [f"bid_px_{k:02d}", f"bid_sz_{k:02d}", f"ask_px_{k:02d}", f"ask_sz_{k:02d}"]
    text = {n for n in names if n.startswith("c") or n in ("side", "symbol")}
    return T.StructType([T.StructField(n, T.StringType() if n in text else T.DoubleType()) for n in names])


def depth_csv(spark: SparkSession, path: str, symbol: str, price: tuple[float, float] = (6000.0, 7000.0), spread: tuple[float, float] = (0.0, 10.0), most: int | None = None) -> DataFrame:
    """Rows of a depth CSV of one symbol whose prices and spread are sane; short and broken rows are left out."""
    df = spark.read.csv(path, schema=depth_schema(), header=True, mode="PERMISSIVE")
    gap = F.col("ask_px_00") - F.col("bid_px_00")
    df = df.where((F.col("symbol") == symbol) & F.col("bid_px_00").between(*price) & F.col("ask_px_00").between(*price) & (gap > spread[0]) & (gap <= spread[1]))
    return df.limit(most) if most is not None else df


def option_quotes(df: DataFrame) -> DataFrame:
    """Quotes with parsed symbols and the middle of bid and ask."""
    return df.withColumns(options.parse_symbol(F.col("symbol"))).withColumn("opt_mid", (F.col("bid_px_00") + F.col("ask_px_00")) / 2)


def enriched_csv(df: DataFrame, path: str, order: list[str], columns: list[str] | None = None) -> None:
    """Rows in a global order as CSV, doubles with ten significant digits. Range partitions keep the order without one task sorting all."""
    df = df.select(*(columns or df.columns)).orderBy(*order)
    digits = [F.format_string("%.10g", F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    df.select(*digits).write.mode("overwrite").csv(path, header=True)


def parquet_sample(df: DataFrame, path: str, order: str, rows: int = 1000) -> None:
    """The first rows, for validation."""
    df.orderBy(order).limit(rows).write.mode("overwrite").parquet(path)


def spread_json(table: DataFrame) -> str:
    """A spread table as JSON with ``vol_tox_gex`` keys; a few hundred cells."""
    rows = table.select(F.concat_ws("_", "vol", "tox", "gex").alias("key"), "half_spread", "skew").collect()
    return json.dumps({"table": {r["key"]: r["half_spread"] for r in rows}, "skew_table": {r["key"]: r["skew"] for r in rows}}, sort_keys=True)


def transition_json(counts: DataFrame, probs: DataFrame, thresholds: tuple[float, float]) -> str:
    """Transition counts and probabilities as nested lists (regime, state, outcome) with the regime thresholds; 297 cells."""
    rows = counts.join(probs.select("regime", "state", "outcome", "prob"), ["regime", "state", "outcome"]).orderBy("regime", "state", "outcome").collect()
    shape: dict = {}
    for r in rows:
        shape.setdefault(r["regime"], {}).setdefault(r["state"], []).append((r["n"], r["prob"]))
    nest = lambda k: [[[x[k] for x in s] for s in g.values()] for g in shape.values()]
    return json.dumps({"counts": nest(0), "probs": nest(1), "vol_thresholds": list(thresholds)})


def execution_csv(result: DataFrame, folder: str) -> None:
    """Closed trades and cancelled orders as two CSVs."""
    for kind, name in (("trade", "closed_trades"), ("cancel", "cancelled_orders")):
        result.where(F.col("kind") == kind).drop("kind").write.mode("overwrite").csv(f"{folder}/{name}", header=True)
