"""Readers for labelled tables, chunked libraries, array blocks and job configs."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molframe.plans.lineage import cut
from molframe.registry import LIBRARY_CHUNKS, DatasetSpec

CSV_OPTIONS = {
    # Quoted fields may hold line breaks and quotes; without multiLine rows would be torn.
    "header": True,
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
}


def labelled_schema(feature: str, tasks: Sequence[str], id: str | None = None) -> T.StructType:
    """Declared schema of a labelled table: nothing is inferred by scanning."""
    fields = [T.StructField(id, T.StringType())] if id and id != feature else []
    fields.append(T.StructField(feature, T.StringType()))
    fields += [T.StructField(task, T.DoubleType()) for task in tasks]
    return T.StructType(fields)


def read_labelled(
    spark: SparkSession,
    path: str | list[str],
    feature: str,
    tasks: Sequence[str],
    id: str | None = None,
    multiline: bool = False,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Sequence column, task columns and id of one or many CSV files.

    Files split into tasks only when ``multiline`` is false, which is right for
    sequences without line breaks.
    """
    schema = schema or labelled_schema(feature, tasks, id)
    return spark.read.options(**CSV_OPTIONS, multiLine=multiline).schema(schema).csv(path)


#: Holds the text of a row that does not fit the schema.
CORRUPT = "_corrupt"


def read_checked(
    spark: SparkSession, path: str | list[str], feature: str, tasks: Sequence[str], quarantine: str,
    id: str | None = None, multiline: bool = False, schema: T.StructType | None = None, header: bool = True,
) -> tuple[DataFrame, dict[str, int]]:
    """``read_labelled`` that keeps what it cannot read: good rows, and counts of all rows and of bad ones.

    A row with a label that is no number, or with too few or too many fields, is
    written to the folder ``quarantine`` with its text, file and the time of
    reading, instead of passing as a row without label. The files are parsed once.
    """
    declared = schema or labelled_schema(feature, tasks, id)
    checked = T.StructType([*declared.fields, T.StructField(CORRUPT, T.StringType())])
    options = {**CSV_OPTIONS, "header": header, "multiLine": multiline, "columnNameOfCorruptRecord": CORRUPT}
    rows = spark.read.options(**options).schema(checked).csv(path).withColumn("_file", F.col("_metadata.file_path"))
    parsed = cut(rows)
    # One column of the written table is read; ``observe`` would leave the session unfit for Spark ML.
    counts = parsed.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(CORRUPT).isNotNull()).alias("n_bad")).first().asDict()
    if counts["n_bad"]:
        bad = parsed.filter(F.col(CORRUPT).isNotNull())
        bad.select(F.col(CORRUPT).alias("record"), F.col("_file").alias("file"), F.current_timestamp().alias("read_at")).write.mode("append").parquet(quarantine)
    return parsed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, "_file"), counts


def read_chunks(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType, multiline: bool = False
) -> DataFrame:
    """One scan over many chunk files; split size follows spark.sql.files.maxPartitionBytes."""
    return spark.read.options(**CSV_OPTIONS, multiLine=multiline).schema(schema).csv(list(paths))


def chunk_manifest(spark: SparkSession, size: str, root: str = "") -> DataFrame:
    """Chunk number and path of each input file of a library of the named size."""
    count = LIBRARY_CHUNKS[size.lower()]
    return spark.range(count).select(
        F.col("id").alias("chunk"),
        F.concat(F.lit(root), F.format_string("chunk_%03d.csv", F.col("id"))).alias("path"),
    )


def rebalance(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Even out partitions: to a fixed number, or sized at run time."""
    return df.repartition(partitions) if partitions else df.hint("rebalance")


def read_library(
    spark: SparkSession, size: str, root: str, schema: T.StructType, partitions: int | None = None
) -> DataFrame:
    """All chunks of a library of the named size, in even partitions.

    The manifest has at most a few hundred paths. Sequences hold no line
    breaks, so every chunk file is split over many tasks.
    """
    paths = [r["path"] for r in chunk_manifest(spark, size, root).orderBy("chunk").collect()]
    return rebalance(read_chunks(spark, paths, schema), partitions)


def read_blocks(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Array blocks written by ``write_blocks``; only the named columns are scanned."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_npz(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Compatibility reader for .npz blocks: one file per task, pickles refused."""
    names = schema.fieldNames()

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as block:
                    yield pd.DataFrame({n: list(block[n]) for n in names})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    return files.select("content").mapInPandas(load, schema)


def read_config(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Nested JSON job config; the first record wins."""
    return spark.read.schema(schema).json(path, multiLine=True).limit(1)


def read_presplit(
    spark: SparkSession, root: str, schema: T.StructType, format: str = "csv", multiline: bool = False
) -> DataFrame:
    """Folders or files that already carry train, valid and test."""
    options = {**CSV_OPTIONS, "multiLine": multiline} if format == "csv" else {}
    suffix = ".csv" if format == "csv" else ""
    parts = [
        spark.read.format(format)
        .options(**options)
        .schema(schema)
        .load(f"{root}/{split}{suffix}")
        .withColumn("split", F.lit(split))
        for split in ("train", "valid", "test")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def rows_per_file(df: DataFrame, by: str | None = None) -> DataFrame:
    """Rows per input file (or per ``by``) and the overall total, header excluded."""
    source = F.col(by) if by else F.col("_metadata.file_path")
    return (
        df.select(source.alias("source"))
        .rollup("source")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.grouping("source").cast("int").alias("is_total"))
    )


def read_spec(spark: SparkSession, path: str | list[str], spec: DatasetSpec) -> DataFrame:
    """``read_labelled`` for a dataset description."""
    return read_labelled(spark, path, spec.feature, spec.tasks, spec.id)
