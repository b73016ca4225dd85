"""Exported models: JSON files of linear models, calibrations, transitions and spread tables, written and read by Hadoop paths.

The files go through the session's file system, so a folder may lie on any storage that all machines share.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import models as ML

#: Names of the four models, and of the files that stand in for a missing one.
LABELS = tuple(ML.HORIZONS)
OLD_MODEL, OLD_CALIBRATION = "toxicity_model.json", "isotonic_calibration.json"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_json(spark: SparkSession, path: str, value: dict | str) -> None:
    """One file, replaced if it is there; arrays become lists."""
    fs, p = _path(spark, path)
    text = value if isinstance(value, str) else json.dumps(value, default=lambda v: v.tolist() if hasattr(v, "tolist") else str(v))
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict | None:
    """None where there is no such file."""
    fs, p = _path(spark, path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if fs.exists(p) else None


@dataclass
class Models:
    """What a folder of exports holds; a part without a file is missing."""

    linear: dict[str, ML.Linear] = field(default_factory=dict)
    calibration: dict[str, tuple[list[float], list[float]]] = field(default_factory=dict)
    probs: np.ndarray | None = None
    outcomes: list[float] = field(default_factory=list)
    vol_thresholds: tuple[float, ...] = ()
    half_spread: dict[str, float] = field(default_factory=dict)
    skew: dict[str, float] = field(default_factory=dict)
    spread_terms: dict[str, float] = field(default_factory=dict)

    def scored(self, df: DataFrame) -> DataFrame:
        """Adds ``toxicity_{label}`` and ``p_toxic_{label}`` of each model; without a calibration the probability is the score's size."""
        out: dict[str, Column] = {}
        for label, m in self.linear.items():
            score = m.score(df)
            size = F.abs(score)
            out |= {f"toxicity_{label}": score, f"p_toxic_{label}": ML.interpolate(size, *self.calibration[label]) if label in self.calibration else size}
        return df.withColumns(out) if out else df

    def expected(self, regime: Column, state: Column) -> dict[str, Column]:
        """``markov_expected`` and ``markov_uncertainty`` (ticks) of a regime and state; null without transitions or outside of them."""
        if self.probs is None:
            none = F.lit(None).cast("double")
            return {"markov_expected": none, "markov_uncertainty": none}
        v = np.array(self.outcomes)
        mean = self.probs @ v
        sd = np.sqrt(np.maximum(self.probs @ (v * v) - mean * mean, 0))
        table = lambda x: F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in x])
        pick = lambda x: F.get(F.get(table(x), regime), state)
        return {"markov_expected": pick(mean), "markov_uncertainty": pick(sd)}

    def quoted(self, vol: Column, tox: Column, gex: Column) -> dict[str, Column]:
        """``table_half_spread`` (1.0 where the table has no such cell) and ``table_skew`` (0) of a cell."""
        key = F.concat_ws("_", vol.cast("int"), tox.cast("int"), gex.cast("int"))
        look = lambda t, other: F.coalesce(F.create_map(*[x for k, v in t.items() for x in (F.lit(k), F.lit(float(v)))])[key], F.lit(other)) if t else F.lit(other)
        return {"table_half_spread": look(self.half_spread, 1.0), "table_skew": look(self.skew, 0.0)}


def linear_of(m: dict) -> ML.Linear:
    return ML.Linear(m["features"], np.array(m["weights"]), np.array(m["mean"]), np.array(m["var"]), None, m.get("target", ""), m.get("oof_stats", {}))


def load(spark: SparkSession, folder: str) -> Models:
    """The models of a folder: ``toxicity_{label}``, ``calibration_{label}`` or the older names, ``markov_model`` and ``spread_optimizer``."""
    out = Models()
    for label in LABELS:
        if m := read_json(spark, f"{folder}/toxicity_{label}.json") or read_json(spark, f"{folder}/{OLD_MODEL}"):
            out.linear[label] = linear_of(m)
            if c := read_json(spark, f"{folder}/calibration_{label}.json") or read_json(spark, f"{folder}/{OLD_CALIBRATION}"):
                out.calibration[label] = (c["X_thresholds"], c["y_thresholds"])
    if m := read_json(spark, f"{folder}/markov_model.json"):
        out.probs, out.outcomes, out.vol_thresholds = np.array(m["probs"]), m["outcome_values"], tuple(m.get("vol_thresholds") or ())
    if m := read_json(spark, f"{folder}/spread_optimizer.json"):
        out.half_spread, out.skew, out.spread_terms = m.get("table", {}), m.get("skew_table", {}), m.get("coefficients", {})
    return out


def save(spark: SparkSession, folder: str, models: Models) -> list[str]:
    """The files that ``load`` reads; their names."""
    made: dict[str, dict | str] = {f"toxicity_{k}": m.to_json(k) for k, m in models.linear.items()}
    made |= {f"calibration_{k}": {"X_thresholds": x, "y_thresholds": y, "n_thresholds": len(x)} for k, (x, y) in models.calibration.items()}
    if models.probs is not None:
        shape = dict(zip(("n_regimes", "n_states", "n_outcomes"), models.probs.shape))
        made["markov_model"] = shape | {"outcome_values": models.outcomes, "probs": models.probs, "vol_thresholds": list(models.vol_thresholds)}
    if models.half_spread:
        made["spread_optimizer"] = {"coefficients": models.spread_terms, "table": models.half_spread, "skew_table": models.skew}
    for name, value in made.items():
        write_json(spark, f"{folder}/{name}.json", value)
    return sorted(made)
