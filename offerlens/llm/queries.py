"""The registered queries of this package over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hash_tree_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents into 24 shards by weighted draws; the law is ``key``."""
    from offerlens.llm.sharding import even_tree, shard_documents

    return shard_documents(table(spark, folder, "documents"), even_tree(24)).select(
        "doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op2_chained_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words and more that a document repeats from an earlier one."""
    from offerlens.llm.chaining import repeated_passages

    return repeated_passages(table(spark, folder, "documents"))


def op3_surrogate_texts(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with surrogates in place of personal data and secrets."""
    from offerlens.llm.surrogates import pseudonymize

    return pseudonymize(table(spark, folder, "documents").select("doc_id", "text"), counts=True)


def op4_site_posteriors(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its evidence and the posteriors of its source (host) and
    of its language within it (path)."""
    from offerlens.llm import quality, site_bayes

    documents = table(spark, folder, "documents")
    model = quality.fit(documents, table(spark, folder, "labels"))
    scores = site_bayes.evidence(documents, model, ["doc_id", "source", "lang"])
    return site_bayes.posterior(scores, "source", "lang").select(
        "doc_id", "source", "lang", "logit", "path_n", "host_n", "global_rate", "host_rate", "path_rate", "posterior", "kept"
    )


def op5_jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    from offerlens.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


def op6_tree_scored_text(spark: SparkSession, folder: str) -> DataFrame:
    from offerlens.llm.tree_extract import extract

    return extract(table(spark, folder, "pages"))


def op7_ngram_quality(spark: SparkSession, folder: str) -> DataFrame:
    from offerlens.llm import quality

    documents = table(spark, folder, "documents")
    return quality.rate(documents, quality.fit(documents, table(spark, folder, "labels")))


def op8_segment_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from offerlens.llm.bpe import digests

    return digests(table(spark, folder, "documents"), tokenizer_path())


def op9_lattice_vectors(spark: SparkSession, folder: str) -> DataFrame:
    from offerlens.llm.lattice import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, folder, "embeddings"))


def op10_tiered_packing(spark: SparkSession, folder: str) -> DataFrame:
    from offerlens.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), tokenizer_path()).drop("ids")


def op11_prefix_filtered_items(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the words that lie in windows of benchmark items."""
    from offerlens.llm.decontaminate import contamination, documents_hit

    rows, hits = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return documents_hit(rows, hits).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op12_chebyshev_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All usable vectors on the 16 leading components, whitened."""
    from offerlens.llm.whitening import whitened

    return whitened(table(spark, folder, "embeddings"))


def op13_merge_path_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the groups and links of two tokenizers' tokens."""
    from offerlens.llm.alignment import aligned_documents

    return aligned_documents(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_hash_tree_shards, op2_chained_passages, op3_surrogate_texts, op4_site_posteriors, op5_jaccard_components,
        op6_tree_scored_text, op7_ngram_quality,
        op8_segment_tree_bpe, op9_lattice_vectors, op10_tiered_packing,
        op11_prefix_filtered_items, op12_chebyshev_whitening, op13_merge_path_alignment,
    )
}

# What SQL can express; the others are held against brute force in tests/llm.
_WORDS_11 = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE: dict[str, str] = {
    "op11_prefix_filtered_items": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS_11}, []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, coalesce({_WORDS_11}, []) AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[s + 1 : s + least(10, len(w))], ' ') AS win
       FROM (SELECT item, w, unnest(range(len(w) - least(10, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT r, size, s, array_to_string(w[s + 1 : s + size], ' ') AS win
       FROM (SELECT r, w, size, unnest(range(len(w) - size + 1)) AS s FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
hits AS (SELECT r, s, dw.size, item FROM dw JOIN bw USING (size, win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
}
