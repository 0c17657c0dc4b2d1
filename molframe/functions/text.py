"""Expressions on names, paths and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered (pattern, replacement) rules for parameter names.
PARAMETER_RULES = (
    (r"molformer\.embeddings\.word_embeddings", "tok_emb"),
    (
        r"molformer\.encoder\.layer\.(\d+)\.attention\.self\.feature_map\.weight",
        "blocks.layers.$1.attention.inner_attention.feature_map.omega",
    ),
    (
        r"molformer\.encoder\.layer\.(\d+)\.attention\.self\.(query|key|value)",
        "blocks.layers.$1.attention.$2_projection",
    ),
    (r"molformer\.encoder\.layer\.(\d+)\.attention\.output\.dense", "blocks.layers.$1.attention.out_projection"),
    (r"molformer\.encoder\.layer\.(\d+)\.attention\.output\.LayerNorm", "blocks.layers.$1.norm1"),
    (r"molformer\.encoder\.layer\.(\d+)\.intermediate\.dense", "blocks.layers.$1.linear1"),
    (r"molformer\.encoder\.layer\.(\d+)\.output\.dense", "blocks.layers.$1.linear2"),
    (r"molformer\.encoder\.layer\.(\d+)\.output\.LayerNorm", "blocks.layers.$1.norm2"),
    (r"molformer\.LayerNorm", "blocks.norm"),
    (r"lm_head\.transform\.dense", "lang_model.embed"),
    (r"lm_head\.transform\.LayerNorm", "lang_model.ln_f"),
    (r"lm_head\.decoder", "lang_model.head"),
)


def normalize_name(name: Column) -> Column:
    """Trim, and turn each run of blanks or a line continuation into one underscore."""
    return F.regexp_replace(F.trim(F.regexp_replace(name, r"\\\s*\n", " ")), r"\s+", "_")


def first_match_rewrite(
    key: Column, rules: Sequence[tuple[str, str]], strip: str | None = None
) -> Column:
    """Rewrite by the first rule whose pattern occurs; null when none does."""
    if strip:
        key = F.replace(key, F.lit(strip), F.lit(""))
    return F.coalesce(*[F.when(F.regexp_like(key, F.lit(p)), F.regexp_replace(key, p, r)) for p, r in rules])


def uri_parts(uri: Column) -> Column:
    """struct(scheme, bucket, key, basename, stem, is_object_store) of a path."""
    pieces = F.split(uri, "/")
    is_uri = uri.contains("://")
    key = F.when(is_uri, F.array_join(F.slice(pieces, 4, F.greatest(F.size(pieces) - 3, F.lit(0))), "/")).otherwise(uri)
    base = F.element_at(pieces, -1)
    return F.struct(
        F.when(is_uri, F.split_part(uri, F.lit("://"), F.lit(1))).alias("scheme"),
        F.when(is_uri, F.get(pieces, 2)).alias("bucket"),
        key.alias("key"),
        base.alias("basename"),
        F.regexp_extract(base, r"^([^.]*)", 1).alias("stem"),
        F.startswith(uri, F.lit("s3://")).alias("is_object_store"),
    )


def every(step: Column, k: int, offset: int = 0) -> Column:
    """Cadence predicate: ``step mod k = offset``."""
    return F.pmod(step, F.lit(k)) == F.lit(offset)
