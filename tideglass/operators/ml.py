"""Point-in-time training rows and a scoring table. A score is an output row, never a risk state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideglass.functions.scalars import micros
from tideglass.operators.ordered import rolling
from tideglass.operators.temporal import point_in_time


def look_ahead_max(df: DataFrame, keys: list[str], ts: str, value: str, days: float, name: str) -> DataFrame:
    """Largest value in (t, t + days]: the look-back operator on mirrored time."""
    mirrored = df.withColumn("_mirror", F.timestamp_micros(-micros(ts)))
    return rolling(mirrored, keys, "_mirror", days, {name: ("max", value)}, include_current=False).drop("_mirror")


def training_extract(asks: DataFrame, history: DataFrame, outcomes: DataFrame, horizon: float, bad_from: int) -> DataFrame:
    """Features known at each (facility, T) with the outcome after T; nothing after T enters a feature."""
    known = point_in_time(
        asks, history, ["facility_id"], "asked_at", "knowledge_time", ["effective_at", "revision", "event_id"], ["value_numeric", "effective_at"]
    )
    recent = rolling(
        asks, ["facility_id"], "asked_at", 7, {"events_7d": ("count", "ask_id"), "max_dpd_7d": ("max", "dpd_now")}
    ).select("ask_id", "events_7d", "max_dpd_7d")
    label = look_ahead_max(outcomes, ["facility_id"], "event_time", "current_dpd", horizon, "_worst").select(
        F.col("event_id").alias("ask_id"), (F.coalesce("_worst", F.lit(0)) >= bad_from).cast("int").alias("label")
    )
    return known.join(recent, "ask_id").join(label, "ask_id").withColumnRenamed("value_numeric", "dpd_known")


def score(extract: DataFrame, features: list[str], target: str, horizon_days: int, version: str) -> DataFrame:
    """Logistic regression over the extract; probability and the driver with the largest contribution."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = extract.select("ask_id", "facility_id", "asked_at", F.col("label").cast("double").alias("label"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    raw = VectorAssembler(inputCols=features, outputCol="_raw").transform(rows)
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(raw).transform(raw)
    model = LogisticRegression(featuresCol="_x", labelCol="label", regParam=0.01, maxIter=20).fit(scaled)
    weights = [float(w) for w in model.coefficients]
    parts = F.array(*[
        F.struct(F.abs(vector_to_array("_x")[i] * weights[i]).alias("size"), F.lit(f).alias("feature")) for i, f in enumerate(features)
    ])
    return model.transform(scaled).select(
        "ask_id", "facility_id", "asked_at", F.lit(target).alias("target"), F.lit(horizon_days).alias("horizon_days"),
        F.round(vector_to_array("probability")[1], 6).alias("probability"), F.lit(version).alias("model_version"),
        F.array_max(parts)["feature"].alias("top_driver"),
    )
