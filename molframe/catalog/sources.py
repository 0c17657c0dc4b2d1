"""Sources, sinks and shards."""

from pyspark.sql import functions as F

from molframe.catalog.base import ATOM_ORDER, register, split_sql, table
from molframe.functions.text import uri_parts
from molframe.operators.split import hash_split
from molframe.plans.lineage import scratch_path
from molframe.plans.ordered import Running, running, slice_by_range
from molframe.sources.readers import (
    chunk_manifest,
    labelled_schema,
    read_blocks,
    read_checked,
    read_chunks,
    read_labelled,
    read_presplit,
    rebalance,
    rows_per_file,
)
from molframe.sources.shards import merge_shards, merged_metadata, shard_ranges, shard_sizes, with_shard
from molframe.sources.sinks import write_blocks, write_splits


@register(
    "src_csv_roundtrip",
    "SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS text_md5, n_chars::DOUBLE AS n_chars FROM documents",
)
def src_csv_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "text", F.col("n_chars").cast("double").alias("n_chars")
    )
    path = scratch_path(spark, "labelled")
    docs.write.options(header=True, quote='"', escape='"').csv(path)
    back = read_labelled(spark, path, "text", ["n_chars"], "id", multiline=True)
    return back.select("id", F.md5("text").alias("text_md5"), "n_chars")


@register(
    "src_csv_malformed",
    """
    SELECT 'good' AS lane, CAST(o_orderkey AS VARCHAR) AS id, o_totalprice AS price, 0::BIGINT AS n_rows, 0::BIGINT AS n_bad
    FROM orders WHERE o_orderkey % 11 > 1
    UNION ALL
    SELECT 'bad', CAST(o_orderkey AS VARCHAR), NULL, 0, 0 FROM orders WHERE o_orderkey % 11 <= 1
    UNION ALL
    SELECT 'counts', NULL, NULL, count(*), count(*) FILTER (o_orderkey % 11 <= 1) FROM orders
    """,
)
def src_csv_malformed(spark, sf_dir):
    """Orders as CSV, some with a label that is no number and some with a field too many."""
    orders = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    extra = F.when(F.col("o_orderkey") % 11 == 1, ",1").otherwise("")
    path, aside = scratch_path(spark, "malformed"), scratch_path(spark, "quarantine")
    orders.select(F.concat(F.col("o_orderkey").cast("string"), F.lit(","), "o_orderstatus", F.lit(","), price, extra)).write.text(path)
    schema = labelled_schema("status", ["price"], "id")
    good, counts = read_checked(spark, path, "status", ["price"], aside, "id", schema=schema, header=False)
    bad = spark.read.schema("record string").parquet(aside)
    none = [F.lit(0).cast("bigint").alias(n) for n in ("n_rows", "n_bad")]
    lanes = good.select(F.lit("good").alias("lane"), "id", "price", *none).unionByName(
        bad.select(F.lit("bad").alias("lane"), F.split_part("record", F.lit(","), F.lit(1)).alias("id"), F.lit(None).cast("double").alias("price"), *none)
    )
    total = spark.range(1).select(
        F.lit("counts").alias("lane"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("double").alias("price"),
        *[F.lit(counts[n]).cast("bigint").alias(n) for n in ("n_rows", "n_bad")],
    )
    return lanes.unionByName(total)


@register(
    "merge_shards",
    """
    WITH numbered AS (SELECT vec_id % 2 AS part, (row_number() OVER (PARTITION BY vec_id % 2 ORDER BY vec_id) - 1) // 64 AS shard,
                             vec_id, len(embedding) AS d FROM embeddings),
    meta AS (SELECT part, shard, count(*) AS n_rows, max(d) AS d, row_number() OVER (ORDER BY part, shard) - 1 AS merged_shard FROM numbered GROUP BY 1, 2)
    SELECT vec_id AS ids, merged_shard, n_rows, n_rows || '' AS ids_shape, n_rows || 'x' || meta.d AS x_shape, n_rows || 'x1' AS y_shape, n_rows || 'x1' AS w_shape
    FROM numbered JOIN meta USING (part, shard)
    """,
)
def merged_shards(spark, sf_dir):
    """Two sharded halves of the vectors as one dataset of ids, X, y, w."""
    vectors = table(spark, sf_dir, "embeddings")
    y = F.array(F.col("label").cast("double"))
    data = vectors.select(F.col("vec_id").alias("ids"), F.col("embedding").alias("x"), y.alias("y"), F.array(F.lit(1.0)).alias("w"))
    halves = [with_shard(data.filter(F.col("ids") % 2 == i), ["ids"], 64) for i in (0, 1)]
    names = ["ids", "x", "y", "w"]
    rows, meta = merge_shards(*halves, shapes=names)
    shapes = [F.array_join(f"{c}_shape", "x").alias(f"{c}_shape") for c in names]
    return rows.select("ids", "merged_shard").join(meta.select("merged_shard", "n_rows", *shapes), "merged_shard")


@register("src_multi_path", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def src_multi_path(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    path = scratch_path(spark, "chunks")
    chunked = orders.withColumn("chunk", F.pmod("o_orderkey", F.lit(4)))
    chunked.write.partitionBy("chunk").options(header=True).csv(path)
    paths = [f"{path}/chunk={i}" for i in range(4)]
    return rebalance(read_chunks(spark, paths, orders.schema))


@register(
    "chunk_manifest",
    """
    SELECT 'library/chunk_' || lpad(CAST(l_orderkey % 25 AS VARCHAR), 3, '0') || '.csv' AS path, count(*) AS n_rows
    FROM lineitem GROUP BY 1
    """,
)
def manifest(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.pmod("l_orderkey", F.lit(25)).alias("chunk"))
    rows = lines.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(chunk_manifest(spark, "250m", "library/"), "chunk").select("path", "n_rows")


@register(
    "block_roundtrip",
    """
    SELECT vec_id, len(embedding) AS n_dims, round(list_sum(embedding::DOUBLE[]), 4) AS total,
           embedding[1]::DOUBLE AS first_value
    FROM embeddings
    """,
)
def block_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "blocks")
    write_blocks(table(spark, sf_dir, "embeddings"), path, ["vec_id", "embedding"])
    x = F.col("embedding").cast("array<double>")
    return read_blocks(spark, path, ["vec_id", "embedding"]).select(
        "vec_id",
        F.size("embedding").cast("bigint").alias("n_dims"),
        F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 4).alias("total"),
        F.get(x, F.lit(0)).alias("first_value"),
    )


LINE_ORDER = ["l_orderkey", *ATOM_ORDER]


@register(
    "shard_sizes",
    """
    WITH numbered AS (
      SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx
      FROM lineitem)
    SELECT idx // 4096 AS shard, count(*) AS n_rows FROM numbered GROUP BY 1
    """,
)
def sizes_of_shards(spark, sf_dir):
    return shard_sizes(with_shard(table(spark, sf_dir, "lineitem").select(*LINE_ORDER), LINE_ORDER))


def _local_shards(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", *LINE_ORDER)
    numbered = running(slice_by_range(lines, LINE_ORDER, ["l_returnflag"]), nth=Running("count"))
    return numbered.withColumn("shard", F.expr("(nth - 1) div 4096"))


@register(
    "merge_shard_metadata",
    """
    WITH numbered AS (
      SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag
        ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx
      FROM lineitem),
    shards AS (SELECT l_returnflag, idx // 4096 AS shard, count(*) AS n_rows FROM numbered GROUP BY 1, 2)
    SELECT l_returnflag, shard, n_rows,
           dense_rank() OVER (ORDER BY l_returnflag, shard) - 1 AS merged_shard
    FROM shards
    """,
)
def merge_metadata(spark, sf_dir):
    return merged_metadata(_local_shards(spark, sf_dir), "l_returnflag")


@register(
    "shard_assignment",
    """
    WITH numbered AS (
      SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx
      FROM lineitem),
    shards AS (SELECT idx // 1024 AS shard, count(*) AS n_rows FROM numbered GROUP BY 1),
    total AS (SELECT max(shard) + 1 AS s FROM shards),
    workers AS (SELECT range AS p FROM range(6))
    SELECT shard, n_rows, p AS worker
    FROM shards, total, workers
    WHERE shard >= (p * s) // 6 AND shard < ((p + 1) * s) // 6
    """,
)
def shard_assignment(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE_ORDER)
    return shard_ranges(shard_sizes(with_shard(lines, LINE_ORDER, 1024)), 6)


@register(
    "props_json",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def props_json(spark, sf_dir):
    props = F.from_json("props", "struct<k: bigint>")
    return table(spark, sf_dir, "events").select("event_id", props["k"].alias("k"))


@register(
    "split_sink_roundtrip",
    f"""
    SELECT split, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_chars
    FROM (SELECT {split_sql('doc_id')} AS split, n_chars FROM documents) GROUP BY 1
    """,
)
def split_sink_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "splits")
    write_splits(hash_split(table(spark, sf_dir, "documents"), "doc_id"), path)
    return spark.read.parquet(path).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars")
    )


@register(
    "rows_per_source",
    """
    SELECT source, count(*) AS n_rows, CAST(grouping(source) AS INTEGER) AS is_total
    FROM documents GROUP BY ROLLUP (source)
    """,
)
def rows_per_source(spark, sf_dir):
    return rows_per_file(table(spark, sf_dir, "documents"), by="source")


@register("presplit_union", f"SELECT doc_id, text, {split_sql('doc_id', 3)} AS split FROM documents")
def presplit_union(spark, sf_dir):
    docs = hash_split(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 3)
    root = scratch_path(spark, "presplit")
    for split in ("train", "valid", "test"):
        docs.filter(F.col("split") == split).drop("split").write.parquet(f"{root}/{split}")
    return read_presplit(spark, root, docs.drop("split").schema, "parquet")


@register(
    "uri_parts",
    r"""
    WITH p AS (SELECT page_id, url, string_split(url, '/') AS s FROM pages)
    SELECT page_id, split_part(url, '://', 1) AS scheme, s[3] AS bucket,
           array_to_string(s[4:len(s)], '/') AS key, s[len(s)] AS basename,
           regexp_extract(s[len(s)], '^([^.]*)', 1) AS stem, url LIKE 's3://%' AS is_object_store
    FROM p
    """,
)
def parts_of_uri(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", uri_parts(F.col("url")).alias("u")).select("page_id", "u.*")
