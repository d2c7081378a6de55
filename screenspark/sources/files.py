"""Delimited network files and ``.npy`` images as DataFrames."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """``g1, g2, score`` of a space-delimited file ``protein1 protein2 combined_score``; scores are thousandths."""
    rows = spark.read.csv(path, sep=" ", header=True, schema="protein1 string, protein2 string, combined_score int")
    return rows.select(F.col("protein1").alias("g1"), F.col("protein2").alias("g2"), (F.col("combined_score") / F.lit(1000.0)).alias("score"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """``id, name`` of a tab-delimited file whose first two columns are protein id and preferred name."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(F.col(f"`{rows.columns[0]}`").alias("id"), F.col(f"`{rows.columns[1]}`").alias("name"))


def read_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of parquet tables by name; columns that a table lacks are null."""
    first, *rest = (spark.read.parquet(p) for p in paths)
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def _pixels(batches):
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            image = np.load(io.BytesIO(content), allow_pickle=False)
            image = image[None] if image.ndim == 2 else image
            ch, y, x = np.indices(image.shape)
            yield pd.DataFrame({"path": path, "ch": ch.ravel(), "y": y.ravel(), "x": x.ravel(), "v": image.ravel().astype("float64")})


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Exploded pixels ``path, ch, y, x, v`` of ``.npy`` images (channels first, or one channel); a task holds one image."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInPandas(_pixels, "path string, ch long, y long, x long, v double")
