"""Text preparation.

The encoder's downloaded word-piece vocabulary is replaced by a word vocabulary
built from the corpus itself: words are runs of letters and digits, ids follow
frequency rank (ties by the word), and ids 0, 1, 2 are reserved for padding,
unknown words and the mask token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolink.functions.keys import hash_u32, hash_unit
from taxolink.operators.ranking import exact_row_number
from taxolink.operators.splits import batches
from taxolink.session import write_and_read

WORD = r"[\p{L}\p{N}]+"
PAD_ID, UNK_ID, MASK_ID = 0, 1, 2
RESERVED = ("<pad>", "<unk>", "<mask>")
IGNORE = -100
#: Most frequent words that are looked up in the row itself, and the most characters of one: they bound what is sent out.
HEAD_WORDS, HEAD_CHARS = 65536, 64


def words(text: Column) -> Column:
    """Word tokens of a text (whole text)."""
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def build_vocab(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(token, id, cnt)`` over every word of every document; ids by descending count then
    word, after the reserved ids. Counting is a partial + final aggregation; the ranking uses
    :func:`exact_row_number`, so no single task sorts the whole vocabulary."""
    counts = (docs.select(F.explode(words(F.col(text_col))).alias("token"))
                  .groupBy("token").agg(F.count(F.lit(1)).alias("cnt")))
    ranked = exact_row_number(counts.withColumn("_neg", -F.col("cnt")), [], ["_neg", "token"], out_col="_rn")
    vocab = ranked.select("token", (F.col("_rn") - 1 + len(RESERVED)).alias("id"), "cnt")
    spark = docs.sparkSession
    reserved = spark.createDataFrame([(t, i, 0) for i, t in enumerate(RESERVED)], "token string, id long, cnt long")
    return reserved.unionByName(vocab)


def _looked_up(head: pa.Table, spark: SparkSession, tails: bool):
    """Per batch ``(_row, id, words)`` → ``(_row, id, ids, tail)``: ids of the head's words, the others as places and words."""
    sent = spark.sparkContext.broadcast([c.combine_chunks() for c in head.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_ids = sent.value
        for batch in batches:
            lists = batch.column(2)
            tokens, n = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            at = pc.index_in(tokens, value_set=known.cast(tokens.type))
            ids = pc.fill_null(known_ids.take(at), pa.scalar(UNK_ID, pa.int64()))
            left = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False)) if tails else np.zeros(0, np.int64)
            row = np.searchsorted(ends, left, "right")
            places = pa.StructArray.from_arrays([pa.array(left - (ends - n)[row], pa.int32()), tokens.take(pa.array(left))], ["pos", "token"])
            starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), ids),
                 pa.ListArray.from_arrays(pa.array(starts, pa.int32()), places)], names=["_row", "id", "ids", "tail"])
    return run


def _put_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, ids, patch)`` → ``(id, ids)`` with the patch's ids at their places."""
    for batch in batches:
        lists, patch = batch.column(1), batch.column(2)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        starts = np.concatenate([[0], ends])
        ids = lists.flatten().to_numpy(zero_copy_only=False).copy()
        row = np.repeat(np.arange(batch.num_rows), patch.value_lengths().to_numpy(zero_copy_only=False))
        pos, tid = patch.flatten().flatten()
        ids[starts[row] + pos.to_numpy(zero_copy_only=False)] = tid.to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int64()))], names=["id", "ids"])


def encode(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           max_len: int | None = None) -> DataFrame:
    """Words of the whole text (null reads as ``nan``) → ids (unknown → 1): ``(id, ids)``, an empty list for a
    text without words.
    A limit on the number of ids applies only where ``max_len`` asks for it.

    The vocabulary's frequent head (:data:`HEAD_WORDS` words of up to :data:`HEAD_CHARS` characters, so bounded) is sent to all
    executors and looked up in the row: no text moves for it. Only words outside it meet the rest of the vocabulary in a
    join, and only texts that hold such words meet their ids again; what is left of a hot word there is split by AQE's skew
    join, as the vocabulary side is unique.
    """
    spark = docs.sparkSession
    known = vocab.filter(F.col("id") >= len(RESERVED)).select(F.col("token").alias("_token"), F.col("id").cast("long").alias("_tid"))
    in_head = (F.col("_tid") < len(RESERVED) + HEAD_WORDS) & (F.length("_token") <= HEAD_CHARS)
    rest = known.filter(~in_head)
    tails = not rest.isEmpty()
    texts = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"),
                        words(F.coalesce(F.col(text_col), F.lit("nan"))).alias("words"))
    kind = texts.schema["id"].dataType.simpleString()
    looked = texts.mapInArrow(_looked_up(known.filter(in_head).toArrow(), spark, tails),
                              f"_row long, id {kind}, ids array<long>, tail array<struct<pos: int, token: string>>")
    if tails:
        looked = write_and_read(looked, "text-ids")  # the row numbers must not change between the two readings
        left = looked.select("_row", F.explode("tail").alias("t")).select("_row", "t.*")
        patch = (left.join(rest, F.col("token") == F.col("_token")).groupBy(F.col("_row").alias("_to"))
                 .agg(F.collect_list(F.struct("pos", F.col("_tid").alias("tid"))).alias("patch")))
        none = F.array().cast("array<struct<pos: int, tid: bigint>>")
        open_ = looked.filter(F.size("tail") > 0).select("_row", "id", "ids")
        mended = (open_.join(patch, F.col("_row") == F.col("_to"), "left").select("id", "ids", F.coalesce("patch", none).alias("patch"))
                  .mapInArrow(_put_in, f"id {kind}, ids array<long>"))
        looked = looked.filter(F.size("tail") == 0).select("id", "ids").unionByName(mended)
    ids = F.col("ids")
    return looked.select(F.col("id").alias(id_col), (ids if max_len is None else F.slice(ids, 1, max_len)).alias("ids"))


def longest_per_batch(encoded: DataFrame, id_col: str, batch_size: int) -> DataFrame:
    """Encoded texts in batches by id with ``longest``, the most ids of a text in the batch: what each is
    padded to."""
    numbered = batches(encoded.withColumn("_n", F.size("ids")), id_col, batch_size, shuffle=False)
    numbered = write_and_read(numbered, "text-batches")
    most = numbered.groupBy("batch_id").agg(F.max("_n").alias("longest"))
    return numbered.join(most, "batch_id").drop("_n", "row_index")


def pad(ids: Column, length: Column | int) -> tuple[Column, Column]:
    """Pad to ``length`` with the pad id; attention mask 1 for tokens, 0 for padding."""
    n = F.size(ids)
    length = F.lit(length) if isinstance(length, int) else length
    padded = F.concat(ids, F.array_repeat(F.lit(PAD_ID).cast("long"), length - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), length - n))
    return padded, mask


def mask_tokens(ids: Column, row_key: Column, vocab_size: int, rate: float = 0.15,
                seed: int = 42) -> tuple[Column, Column]:
    """Each token is chosen with probability ``rate`` (md5 of seed#row#pos); a chosen token
    becomes the mask id (80 %), a random vocabulary id (10 %) or stays (10 %). Returns
    ``(masked_ids, target_ids)``; targets are -100 where nothing was chosen."""
    n_words = vocab_size - len(RESERVED)

    def chosen(i):
        return hash_unit(seed, row_key, i) < F.lit(rate)

    def replaced(x, i):
        v = hash_unit(seed, F.lit("r"), row_key, i)
        rnd = F.lit(len(RESERVED)) + hash_u32(seed, F.lit("t"), row_key, i) % F.lit(max(n_words, 1))
        return (F.when(v < 0.8, F.lit(MASK_ID).cast("long"))
                 .when(v < 0.9, rnd.cast("long")).otherwise(x))

    # one draw per token; both arrays come from it
    drawn = F.transform(ids, lambda x, i: F.when(chosen(i), F.struct(replaced(x, i).alias("m"), x.alias("t")))
                        .otherwise(F.struct(x.alias("m"), F.lit(IGNORE).cast("long").alias("t"))))
    return drawn["m"], drawn["t"]
