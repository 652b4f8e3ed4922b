"""What fine-tuning needs around a model, over given vectors: contrastive loss, accuracy, warm-up, the choice of a setting, the gate for templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import sign_test_p

#: Temperature of the loss, and what templates must reach: mean margin, share of positive margins, first hits over chance.
TEMPERATURE = 0.05
LEAST_MARGIN, LEAST_POSITIVE, LEAST_OVER_CHANCE = 0.01, 0.8, 3.0


def flat_batches(pairs: DataFrame, number: Column, size: int) -> DataFrame:
    """With batch: size pairs each by their dense number from 0, the last with what is left."""
    return pairs.withColumn("batch", F.floor(number / size).cast("bigint"))


def contrastive(pairs: DataFrame, temperatures: tuple[float, ...] = (TEMPERATURE,)) -> DataFrame:
    """temperature, pairs, loss, accuracy of pairs (batch, pair, anchor, positive: unit vectors).

    An anchor's own positive is to score highest among the positives of its
    batch: cross entropy of the scores over the temperature, and the share whose
    own comes first (of equal scores the smaller pair).  A batch is what one task
    holds and has a fixed size; all else is a sum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(batches).sort_by("pair")
        x, y = (np.array(t.column(c).to_pylist(), np.float64) for c in ("anchor", "positive"))
        scores = x @ y.T
        own = np.arange(len(x))
        right = int((scores.argmax(axis=1) == own).sum())
        losses = []
        for temperature in temperatures:
            logits = scores / temperature
            top = logits.max(axis=1)
            losses.append(float((top + np.log(np.exp(logits - top[:, None]).sum(axis=1)) - logits[own, own]).sum()))
        return pa.table({"temperature": pa.array(temperatures, pa.float64()), "n": pa.array([len(x)] * len(losses), pa.int64()), "loss": losses, "right": pa.array([right] * len(losses), pa.int64())})

    rows = pairs.select("batch", "pair", "anchor", "positive").groupBy("batch").applyInArrow(lambda t: run(t.to_batches()), "temperature double, n bigint, loss double, right bigint")
    return rows.groupBy("temperature").agg(F.sum("n").alias("pairs"), F.round(F.sum("loss") / F.sum("n"), 6).alias("loss"), F.round(F.sum("right") / F.sum("n"), 6).alias("accuracy"))


def best_setting(results: DataFrame, setting: str, loss: str = "loss") -> DataFrame:
    """The setting of least loss, the smaller of equals: one row."""
    return results.agg(F.min_by(F.struct(setting, loss), F.struct(loss, setting)).alias("best")).select("best.*")


def warm_up(spark: SparkSession, steps: int, rate: float, warm: int) -> DataFrame:
    """step (from 0) and rate: rising in equal steps over the first warm ones, then constant."""
    return spark.range(steps).select(F.col("id").alias("step"), F.when(F.col("id") < warm, rate * (F.col("id") + 1) / warm).otherwise(F.lit(rate)).alias("rate"))


def template_gate(margins: DataFrame, firsts: DataFrame, labels: int) -> DataFrame:
    """templates, mean_margin, positive, first_rate, sign_p, passed (one row) from label, margin and queries, top_1 by label.

    The number of labels is small by nature; chance is one of them.
    """
    m = [r.margin for r in margins.select("margin").collect()]
    asked = firsts.agg(F.sum("queries").alias("n"), F.sum("top_1").alias("hits")).first()
    positive = sum(x > 0 for x in m)
    mean = sum(m) / len(m) if m else 0.0
    rate = (asked.hits or 0.0) / asked.n if asked.n else 0.0
    passed = mean > LEAST_MARGIN and positive >= LEAST_POSITIVE * len(m) and rate > LEAST_OVER_CHANCE / max(1, labels)
    row = (len(m), round(mean, 6), positive, round(rate, 6), round(sign_test_p(positive, len(m) - positive), 6), passed)
    return margins.sparkSession.createDataFrame([row], "templates bigint, mean_margin double, positive bigint, first_rate double, sign_p double, passed boolean")
