"""Driver queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolink.llm import (
    chat,
    html_text,
    mixing,
    packing,
    resampling,
    sentence_pieces,
    set_join,
    sharding,
    spelling,
    token_files,
    vector_dedup,
    vector_search,
    whitening,
)
from taxolink.session import table_path


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


#: Both turns of conversation -7: control strings of a common template inside ordinary text.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 1: all conversations formatted; digests read back from the formatted strings and loss masks."""
    rows = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    rows = rows.unionByName(planted)
    out = chat.format_chats(rows.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    turns = chat.read_turns(F.col("formatted"))
    out = out.withColumn("turns", turns).withColumn(
        "trained", F.array_join(chat.read_loss_texts(F.col("formatted"), F.col("loss_spans")), ""))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["body"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 2: all documents mixed to weights 5, 2, 1 at 150 % of all words, two copies of a document at most."""
    out = mixing.mix(_table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3: all documents resampled towards the text labelled good; the rows are the documents kept."""
    model, drawn = resampling.fit(_table(spark, sf_dir, "documents", "doc_id", "text"),
                                  _table(spark, sf_dir, "labels", "doc_id", "quality"))
    return resampling.sampled_scores(drawn, model).withColumn("kept", F.lit(True))


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 4: the 5 nearest vectors of every vector whose id is divisible by 50, among all others."""
    out = vector_search.nearest(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 5: all vectors linked from a cosine of 0.95, one kept per group."""
    out = vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), threshold=0.95)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 6: all documents packed into sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"),
                        public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0, spaced=True,
                        special=True)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 7: all documents written as token files and read back."""
    folder = token_files.new_folder(spark)
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents", "doc_id", "text"),
                                             public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1,
                                             special=True)
    return token_files.token_file_digests(folder, manifest)


def op8_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 8: all documents by 3-word shingles, linked from a Jaccard similarity of 0.9."""
    return set_join.similar_documents(_table(spark, sf_dir, "documents", "doc_id", "text"), n=3, num=90, den=100)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 9: all documents in 24 shards whose row counts differ by one at most."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = _table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.assign_shards(rows, tie=[F.col("text_crc32"), F.col("size")], shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 10: main text of all pages."""
    out = html_text.extract_pages(_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.select("page_id", "url", "text", "n_chars")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 11: all vectors whitened on their 16 leading components."""
    rows, model = whitening.whiten(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), components=16)
    out = whitening.component_rows(rows, model)
    return out.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").cast("long").alias("deviation"),
                      "whitened", "explained", "identity_error")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 12: words of all documents with their near words, forms and roots."""
    out = spelling.spelling_variants(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 13: all documents encoded with an end id and decoded again; digests of both."""
    return sentence_pieces.digests(_table(spark, sf_dir, "documents", "doc_id", "text"),
                                   public_tokenizers.path("piece_bpe_32k.model"))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS trained,
         sum(23 + length(replace(replace(role, '&', '&amp;'), '<', '&lt;'))
                + length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(trained) AS loss_chars, sha256(trained) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator, applied to its whole table with production parameters."""
    import corpus_pipeline
    return {"pipeline": corpus_pipeline.run, "op1_chat": op1_chat, "op2_mixing": op2_mixing, "op3_quality": op3_quality, "op4_vector_search": op4_vector_search,
            "op5_vector_dedup": op5_vector_dedup, "op6_packing": op6_packing,
            "op7_token_files": op7_token_files, "op8_set_join": op8_set_join,
            "op9_sharding": op9_sharding, "op10_html": op10_html, "op11_whitening": op11_whitening,
            "op12_spelling": op12_spelling, "op13_sentence_pieces": op13_sentence_pieces}


def llm_oracles() -> dict[str, str]:
    return {"op1_chat": OP1_SQL}
