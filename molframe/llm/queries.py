"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe.llm import covertree, exactdedup, lattice, licenses, mixing, permutation, quotes, repair, secrets, simhash
from molframe.llm import tokenfile, toxicity, whitening
from molframe.llm.registry import LLM_ORACLE, LLM_QUERIES, query, table, word_count  # noqa: F401


@query("op9_mix_sources", mixing.SQL)
def op9_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = mixing.mixed(docs, "doc_id", "source", "size")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op3_secret_scan")
def op3_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = secrets.scan_secrets(docs, "doc_id", "text", owner="source", repo="doc_id")
    base = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")

    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text(F.sort_array(F.concat(base, "live"))).alias("spans"),
        F.size("live").cast("bigint").alias("n_live"),
        F.size(F.filter("found", lambda s: s["n_owners"] > 1)).cast("bigint").alias("n_shared"),
    )


@query("op6_license_scan")
def op6_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("op7_simhash_dedup")
def op7_simhash_dedup(spark, sf_dir):
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op1_exact_topk")
def op1_exact_topk(spark, sf_dir):
    return covertree.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)


@query("op8_permutation_ann")
def op8_permutation_ann(spark, sf_dir):
    return permutation.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)


@query("op4_toxicity_crf")
def op4_toxicity_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    trainable = toxicity.fold(F.col("doc_id")) != 1
    rows = toxicity.score_documents(docs, labels, "doc_id", "text", "toxic", trainable)
    rows = rows.select("doc_id", "toxicity.score", F.size("toxicity.spans").cast("bigint").alias("n_spans"))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 1, F.lit(False))
    predicted = (F.col("score") >= 0.7).cast("int")
    return rows.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "n_spans")


@query("op5_quote_links")
def op5_quote_links(spark, sf_dir):
    return quotes.link_quotes(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", keep=("role",))


@query("op2_token_file")
def op2_token_file(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return tokenfile.token_digest(table(spark, sf_dir, "documents"), "doc_id", "text", path)


@query("op10_sentencepiece")
def op10_sentencepiece(spark, sf_dir):
    import public_tokenizers

    pieces = lattice.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rows = lattice.encode(table(spark, sf_dir, "documents"), "doc_id", "text", pieces)
    decoded = F.md5(lattice.decode(F.col("ids"), pieces)).alias("decoded_md5")
    return rows.select("doc_id", F.size("ids").alias("n_pieces"), "ids", decoded)


@query("op12_exact_dedup", exactdedup.SQL)
def op12_exact_dedup(spark, sf_dir):
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("op11_whitening")
def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("op13_conversation_repair")
def op13_conversation_repair(spark, sf_dir):
    given = table(spark, sf_dir, "conversations")
    broken = repair.damaged(given, "conv_id", "turn", "role", "text")
    return repair.Repair(broken, "conv_id", "turn", "role", "text").summary(given)
