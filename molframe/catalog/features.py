"""Tokens, fingerprints, vocabularies and training examples over whole texts."""

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from molframe.catalog.base import register, table
from molframe.functions.arrays import joined
from molframe.functions.tokens import WORD_CLASSES, hash_each, hashed_fp, mask_tokens, tokenize
from molframe.operators.features import describe, descriptor_labels, featurize, pad_and_mask, table_function
from molframe.operators.vocab import build_vocab, encode
from molframe.plans.lineage import cut, spread

TOKENS_SQL = r"toks AS (SELECT doc_id, regexp_extract_all(text, '[^ \n]+') AS t FROM documents)"
PLACED_SQL = f"{TOKENS_SQL}, placed AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS pos FROM toks)"
WORD32 = "('0x' || substr(md5({0}), {1}, 8))::BIGINT"

VOCAB_SIZE = 30_000


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def hashed_ids(tokens):
    return hash_each(tokens, VOCAB_SIZE - 5, 5)


@register(
    "feat_hashed_fp",
    f"""
    WITH {TOKENS_SQL},
    bits AS ({" UNION ALL ".join(
        f'''SELECT doc_id, unnest(list_transform(range(len(t)),
              lambda i: {WORD32.format(f"'{r}:' || array_to_string(t[greatest(i - {r}, 0) + 1:i + {r} + 1], ' ')", 1)} % 1024)) AS bit
            FROM toks''' for r in range(3))}),
    sets AS (SELECT doc_id, list_sort(list(DISTINCT bit)) AS bits FROM bits GROUP BY 1)
    SELECT doc_id, coalesce(len(bits), 0)::BIGINT AS n_bits, md5(coalesce(array_to_string(bits, ','), '')) AS bits_md5
    FROM toks LEFT JOIN sets USING (doc_id)
    """,
)
def fingerprints(spark, sf_dir):
    found = documents(spark, sf_dir).select("doc_id", hashed_fp(tokenize(F.col("text"))).alias("bits"))
    return found.select("doc_id", F.size("bits").cast("bigint").alias("n_bits"), F.md5(joined(F.col("bits"))).alias("bits_md5"))


@register(
    "tokenize",
    f"""
    WITH {TOKENS_SQL}
    SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM toks
    """,
)
def tokens(spark, sf_dir):
    found = documents(spark, sf_dir).select("doc_id", tokenize(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@register(
    "pad_and_mask",
    f"""
    WITH {TOKENS_SQL},
    ids AS (SELECT doc_id, list_transform(t, lambda w: {WORD32.format('w', 1)} % {VOCAB_SIZE - 5} + 5) AS ids,
                   (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id FROM toks),
    sized AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS padded_len FROM ids)
    SELECT doc_id, batch_id, padded_len, len(ids) AS n_real,
           md5(array_to_string(list_concat(ids, list_transform(range(padded_len - len(ids)), lambda i: 0::BIGINT)), ',')) AS ids_md5
    FROM sized
    """,
)
def padded(spark, sf_dir):
    ids = documents(spark, sf_dir).select("doc_id", hashed_ids(tokenize(F.col("text"))).alias("ids"))
    found = pad_and_mask(ids, "ids", ["doc_id"], 32)
    return found.select(
        "doc_id",
        "batch_id",
        F.col("padded_len").cast("bigint").alias("padded_len"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, m: a + m).alias("n_real"),
        F.md5(joined(F.col("input_ids"))).alias("ids_md5"),
    )


@register(
    "mlm_mask",
    f"""
    WITH {PLACED_SQL},
    keyed AS (SELECT doc_id, pos, {WORD32.format('tok', 1)} % {VOCAB_SIZE - 5} + 5 AS id,
                     '7|' || CAST(doc_id AS VARCHAR) || '|' || CAST(pos AS VARCHAR) AS k FROM placed),
    drawn AS (SELECT doc_id, pos, id, {WORD32.format('k', 1)} / 4294967296.0::DOUBLE < 0.15::DOUBLE AS chosen,
                     {WORD32.format('k', 9)} / 4294967296.0::DOUBLE AS fate,
                     {WORD32.format('k', 17)} % {VOCAB_SIZE - 5} + 5 AS other FROM keyed),
    made AS (SELECT doc_id, pos, CASE WHEN NOT chosen THEN id WHEN fate < 0.8::DOUBLE THEN 4
                                      WHEN fate < 0.9::DOUBLE THEN other ELSE id END AS input,
                    CASE WHEN chosen THEN id ELSE -100 END AS label FROM drawn),
    grouped AS (SELECT doc_id, string_agg(input::VARCHAR, ',' ORDER BY pos) AS inputs,
                       string_agg(label::VARCHAR, ',' ORDER BY pos) AS labels,
                       count(*) FILTER (label <> -100) AS n_chosen FROM made GROUP BY 1)
    SELECT doc_id, coalesce(n_chosen, 0) AS n_chosen, md5(coalesce(inputs, '')) AS inputs_md5, md5(coalesce(labels, '')) AS labels_md5
    FROM toks LEFT JOIN grouped USING (doc_id)
    """,
)
def masked(spark, sf_dir):
    ids = documents(spark, sf_dir).select("doc_id", hashed_ids(tokenize(F.col("text"))).alias("ids"))
    made = ids.select("doc_id", mask_tokens(F.col("ids"), F.col("doc_id"), VOCAB_SIZE, seed=7).alias("m"))
    return made.select(
        "doc_id",
        F.size(F.filter("m.labels", lambda v: v != -100)).cast("bigint").alias("n_chosen"),
        F.md5(joined(F.col("m.input_ids"))).alias("inputs_md5"),
        F.md5(joined(F.col("m.labels"))).alias("labels_md5"),
    )


CLASS_COUNTS_SQL = ", ".join(f"count(*) FILTER (regexp_matches(tok, '{p}')) AS {n}" for n, p in WORD_CLASSES.items())
DESCRIPTOR_SQL = f"""
{PLACED_SQL},
classes AS (SELECT doc_id, count(*) AS n_tokens, count(DISTINCT tok) AS n_distinct, {CLASS_COUNTS_SQL} FROM placed GROUP BY 1),
freq AS (SELECT doc_id, tok, count(*)::DOUBLE AS c FROM placed GROUP BY 1, 2),
ent AS (SELECT doc_id, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS entropy FROM freq GROUP BY 1),
described AS (
  SELECT doc_id, {", ".join(f"coalesce({n}, 0) AS {n}" for n in ["n_tokens", "n_distinct", *WORD_CLASSES])},
         round(coalesce(entropy, 0), 6) AS entropy
  FROM toks LEFT JOIN classes USING (doc_id) LEFT JOIN ent USING (doc_id))
"""


@register("descriptors", f"WITH {DESCRIPTOR_SQL} SELECT * FROM described")
def composition(spark, sf_dir):
    found = describe(documents(spark, sf_dir), "text").drop("text")
    return found.withColumn("entropy", F.round("entropy", 6))


@register(
    "descriptor_labels",
    f"""
    WITH {DESCRIPTOR_SQL}
    SELECT doc_id, md5(text) AS x_md5, CAST({" + ".join(f"{i + 1} * {n}" for i, n in enumerate(["n_tokens", "n_distinct", *WORD_CLASSES]))} AS DOUBLE) AS y_sum,
           1.0::DOUBLE AS w
    FROM described JOIN documents USING (doc_id)
    """,
)
def labels(spark, sf_dir):
    made = descriptor_labels(documents(spark, sf_dir), "doc_id", "text")
    counts = F.slice("y", 1, 2 + len(WORD_CLASSES))
    weighted = F.transform(counts, lambda v, i: v * (i + 1))
    return made.select(
        "doc_id", F.md5("x").alias("x_md5"), F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v).alias("y_sum"), "w"
    )


def composition_of_batch(texts: pd.Series) -> pd.Series:
    """A user's featurizer: the same counts as ``descriptors``, and the entropy, per text."""
    classes = [re.compile(p) for p in WORD_CLASSES.values()]

    def describe(text: str) -> list[float]:
        counts = Counter(t for t in re.split("[ \n]", text) if t)
        n = np.fromiter(counts.values(), dtype=float, count=len(counts))
        total = n.sum()
        entropy = np.log(total) - (n * np.log(n)).sum() / total if total else 0.0
        per_class = [float(sum(c for t, c in counts.items() if p.search(t))) for p in classes]
        return [float(total), float(len(counts)), *per_class, float(entropy)]

    return texts.map(describe)


@register("featurize_udf", f"WITH {DESCRIPTOR_SQL} SELECT * FROM described")
def user_featurizer(spark, sf_dir):
    found = featurize(documents(spark, sf_dir), composition_of_batch, "text", "array<double>")
    names = ["n_tokens", "n_distinct", *WORD_CLASSES]
    return found.select(
        "doc_id",
        *[F.get("x", F.lit(i)).cast("bigint").alias(n) for i, n in enumerate(names)],
        F.round(F.get("x", F.lit(len(names))), 6).alias("entropy"),
    )


def letters_of_words(text: str):
    """A user's function of one text: each word with its place and its first letter in upper case."""
    for place, word in enumerate(text.split(" ")):
        if word:
            yield place, word, word[0].upper()


@register(
    "featurize_table",
    r"""
    WITH words AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part),
    placed AS (SELECT p_partkey, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM words)
    SELECT p_partkey, place, word, upper(word[1]) AS initial FROM placed WHERE word <> ''
    """,
)
def table_featurizer(spark, sf_dir):
    """A user's table function, called from SQL beside each row."""
    table_function(spark, "letters_of_words", letters_of_words, "place bigint, word string, initial string")
    table(spark, sf_dir, "part").select("p_partkey", "p_name").createOrReplaceTempView("named_parts")
    return spark.sql("SELECT p_partkey, place, word, initial FROM named_parts, LATERAL letters_of_words(p_name)")


VOCAB_SQL = f"""
{PLACED_SQL},
words AS (SELECT tok AS token, count(*) AS n FROM placed
          WHERE tok NOT IN ('<pad>', '<unk>', '<s>', '</s>', '<mask>') GROUP BY 1 HAVING count(*) >= 2),
vocab AS (
  SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 4 AS token_id FROM words
  UNION ALL
  SELECT * FROM (VALUES ('<pad>', 0, 0), ('<unk>', 0, 1), ('<s>', 0, 2), ('</s>', 0, 3), ('<mask>', 0, 4)))
"""


def _vocab(spark, sf_dir):
    return build_vocab(documents(spark, sf_dir), tokenize(F.col("text")), min_count=2)


@register("vocab_tokens", f"WITH {VOCAB_SQL} SELECT token, n, token_id FROM vocab")
def vocabulary(spark, sf_dir):
    return _vocab(spark, sf_dir)


@register(
    "encode_tokens",
    f"""
    WITH {VOCAB_SQL},
    coded AS (SELECT doc_id, pos, coalesce(token_id, 1) AS id FROM placed LEFT JOIN vocab ON tok = token),
    grouped AS (SELECT doc_id, string_agg(id::VARCHAR, ',' ORDER BY pos) AS ids, count(*) AS n_ids,
                       count(*) FILTER (id = 1) AS n_unknown FROM coded GROUP BY 1)
    SELECT doc_id, coalesce(n_ids, 0) AS n_ids, coalesce(n_unknown, 0) AS n_unknown, md5(coalesce(ids, '')) AS ids_md5
    FROM toks LEFT JOIN grouped USING (doc_id)
    """,
)
def encoded(spark, sf_dir):
    found = encode(documents(spark, sf_dir), "doc_id", tokenize(F.col("text")), cut(_vocab(spark, sf_dir)))
    return found.select(
        "doc_id",
        F.size("input_ids").cast("bigint").alias("n_ids"),
        F.size(F.filter("input_ids", lambda v: v == 1)).cast("bigint").alias("n_unknown"),
        F.md5(joined(F.col("input_ids"))).alias("ids_md5"),
    )
