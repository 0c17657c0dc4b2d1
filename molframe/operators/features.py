"""Featurizers that need more than one expression, and the user hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from molframe.functions.tokens import PAD_ID, descriptors, tokenize
from molframe.operators.clean import drop_empty_features
from molframe.operators.split import minibatches
from molframe.plans.lineage import cut


def dummy(df: DataFrame, c: str) -> DataFrame:
    """The sequence itself is the feature."""
    return df.withColumn("x", F.col(c))


def pad_and_mask(
    df: DataFrame, ids: str, order: Sequence[str], batch: int, slices: int | None = None
) -> DataFrame:
    """Pad each batch to its longest sequence, with the attention mask.

    Batches are runs of ``batch`` rows in ``order``; rows alike in it, or null in
    it, are rows like any others and come as they are stored. The rows are written
    once, so what makes them is not run twice. Only the order key and the length
    of each are numbered and windowed (at most ``batch`` rows per window key); the
    sequences themselves meet the result in one join on the number of the row.
    """
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    keys = [*order, "_row"]
    lengths = minibatches(rows.select(*keys, F.size(ids).alias("_len")), keys, batch, slices).drop(*order)
    longest = F.max("_len").over(Window.partitionBy("batch_id"))
    sized = rows.join(lengths.withColumn("padded_len", longest), "_row").withColumn(
        "_gap", F.col("padded_len") - F.col("_len")
    )
    item = df.schema[ids].dataType.elementType
    return sized.withColumns(
        {
            "input_ids": F.concat(F.col(ids), F.array_repeat(F.lit(PAD_ID).cast(item), F.col("_gap"))),
            "attention_mask": F.concat(
                F.array_repeat(F.lit(1), F.col("_len")), F.array_repeat(F.lit(0), F.col("_gap"))
            ),
        }
    ).drop("_gap", "_len", "_row")


def describe(df: DataFrame, sequence: str, kind: str = "words") -> DataFrame:
    """Composition descriptors of each sequence as columns."""
    found = df.withColumn("_d", descriptors(tokenize(F.col(sequence), kind), kind))
    return found.select(*df.columns, "_d.*")


def descriptor_labels(df: DataFrame, id: str, sequence: str, kind: str = "words") -> DataFrame:
    """Multi-task regression set: the sequence is the input, its descriptors the labels."""
    found = df.withColumn("_d", descriptors(tokenize(F.col(sequence), kind), kind))
    names = found.schema["_d"].dataType.fieldNames()
    labels = F.array(*[F.col(f"_d.{n}").cast("double") for n in names])
    return found.select(id, F.col(sequence).alias("x"), labels.alias("y"), F.lit(1.0).alias("w"))


def featurize(
    df: DataFrame, fn: Callable[[pd.Series], pd.Series | pd.DataFrame], column: str, schema: T.DataType | str
) -> DataFrame:
    """Run a user's batch function over a column into ``x``; rows without features go.

    The function gets Arrow batches, so it is called once per batch, not per row.
    """
    out = df.withColumn("x", F.pandas_udf(fn, schema)(F.col(column)))
    return drop_empty_features(out) if isinstance(out.schema["x"].dataType, T.ArrayType) else out.filter("x is not null")


def featurize_rows(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], columns: Sequence[str], schema: T.StructType | str
) -> DataFrame:
    """Run a user's function that turns each batch of rows into any number of rows."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return df.select(*columns).mapInPandas(batches, schema)


def table_function(spark: SparkSession, name: str, fn: Callable[[str], Iterator[tuple]], schema: str) -> None:
    """Make a user's function of one text callable from SQL, as ``LATERAL name(text)``.

    Each tuple it yields is a row of ``schema``. The table function states its
    columns when the query is analyzed and refuses anything but one text; a null
    text has no rows.
    """
    fields = T.StructType.fromDDL(schema)

    class Rows:
        @staticmethod
        def analyze(*args: AnalyzeArgument) -> AnalyzeResult:
            if len(args) != 1 or args[0].dataType != T.StringType():
                raise ValueError(f"{name} takes one text")
            return AnalyzeResult(fields)

        def eval(self, text):
            if text is not None:
                yield from fn(text)

    spark.udtf.register(name, F.udtf(Rows))
