"""Vector matching: block-wise top-k by cosine, and trained classifiers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries held in a task at a time; a bounded block is broadcast, however many there are.
QUERY_BLOCK = 4_096
#: Cosines that a task holds at a time (8 bytes each): of some of the block's queries with a batch of rows.
CELLS = 1 << 20


def cosine_topk(rows: DataFrame, wanted: DataFrame, id_: str, vector: str, k: int) -> DataFrame:
    """(query, id, cosine, place): for each wanted vector its k nearest of all rows, itself left out, ties by id.

    Every block of queries meets all rows where they lie; each task keeps k per query, and only those are shuffled.
    """
    queries = wanted.select(F.col(id_).alias("q"), F.col(vector).alias("v"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    spark, out = rows.sparkSession, None
    for b in range(blocks):
        held = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toPandas()
        if held.empty:
            continue
        shared = spark.sparkContext.broadcast((held["q"].to_numpy(), _unit(np.stack(held["v"]))))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            q, units = shared.value
            for batch in batches:
                ids, vectors = batch["id"].to_numpy(), _unit(np.stack(batch["v"])).T
                n, step = min(k, len(ids)), max(1, CELLS // len(ids)) if len(ids) else len(q)
                for a in range(0, len(q) if len(ids) else 0, step):
                    some = q[a : a + step]
                    cosines = units[a : a + step] @ vectors
                    cosines[some[:, None] == ids[None, :]] = -np.inf
                    floor = np.partition(cosines, len(ids) - n, axis=1)[:, len(ids) - n]
                    at, col = np.nonzero((cosines >= floor[:, None]) & np.isfinite(cosines))  # ties at the edge stay
                    yield pd.DataFrame({"query": some[at], "id": ids[col], "cosine": cosines[at, col]})

        part = rows.select(F.col(id_).alias("id"), F.col(vector).alias("v")).mapInPandas(scan, "query long, id long, cosine double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query long, id long, cosine double, place long")
    from pyspark.sql import Window

    ranked = out.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 6)), "id")).cast("long"))
    return ranked.where(F.col("place") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def train_logistic(rows: DataFrame, features: Sequence[str], label: str, strength: float = 0.01):
    """Mean imputation, scaling and a multinomial logistic regression with balanced class weights."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # one row a class
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (len(counts) * n)).otherwise(weight)
    filled = [f"{f}_filled" for f in features]
    steps = [
        Imputer(inputCols=list(features), outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=filled, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight", regParam=strength, family="multinomial"),
    ]
    return Pipeline(stages=steps).fit(rows.withColumn("weight", weight))
