"""Set-similarity self-join of documents' word n-grams with a token-group matrix. Exact.

Two documents link when the Jaccard similarity of their sets of word n-grams reaches a threshold. Equal sets are one
class from the start. The steps:

1. *Signatures.* Per document: set size, class id (a hash of the set), and the set's smallest token hashes. Of a set of
   n tokens at most ``e = n - ceil(t n)`` can be missing in a similar set. So with the ``e + L`` smallest hashes kept on each
   side, similar sets share at least ``L`` kept tokens (each side's kept part of the intersection is a first part of it
   in hash order, at least L long). A class that shares fewer kept tokens with all others has no link.
2. *Groups.* Classes with the same key token form a group; large ones are cut by hash into groups of about
   :data:`GROUP` members. The key is the smallest of a class's shared tokens that are about as frequent as most of them
   (within :data:`ALIKE` times their median): near copies share most of their tokens, so neither chance tokens of an edited
   place nor passages that many documents share decide it. Any grouping gives the same links.
3. *Token-group matrix*, in long form: the distinct (token, group) pairs, that is each group's token union.
4. *Bound.* Each class queries the matrix: its number of tokens in a group's union bounds its overlap with any member.
   Tokens in more than :data:`HOT` groups (passages that many documents share) are left out of this join, and the
   required number falls by the class's own number of them. Classes with so many hot tokens that nothing is left to
   require are matched among themselves with all their tokens: a link between two classes is found by
   a side that is not such, or else by that second search.
5. *Open.* Qualifying groups are opened: the query's whole set is compared with the group's whole union first
   (the bound again, now on all tokens), and with each member's set if that passes. These comparisons run in blocks of
   bounded size, one group's members with a block of its queries. Members of one group are compared with each other.

Out come the number of links per class and a spanning forest of each block's links; :mod:`components` joins the
forests. Pairs within a large group of near copies are compared, not emitted.

Words: maximal runs of characters other than space and U+0009-U+000D, A-Z lower-cased. With fewer than n words the
whole sequence is the one token. Sets of 64-bit hashes stand for sets of n-grams.

Defined results: a document without words, or null text, has an empty set and no link; rows with a null id have no
links and a null component; rows that repeat an id are documents of their own with that id; an empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolink.llm.components import connected_components
from taxolink.llm.sides import checked_side, rows_with_ids
from taxolink.llm.words import enter, mix, ngram_hashes, span_hashes, text_chunks, word_spans
from taxolink.session import write_and_read

GROUP, GROUP_SHINGLES = 512, 1 << 18
HOT = 64
ALIKE = 3
#: Shingles of queries that meet a group's members in one block.
BLOCK_SHINGLES = 1 << 18
#: Largest bitmap of shared tokens (32 MB).
FILTER_BITS = 1 << 28
_SALT = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, sorted distinct n-gram hashes)`` for every row of a batch with a ``text`` column."""
    for lo, hi, buf, offsets in text_chunks(batch):
        starts, ends, before = word_spans(buf, offsets)
        words = span_hashes(buf, starts, ends, lower=True)
        grams = ngram_hashes(words, n).view(np.int64)
        for i in range(hi - lo):
            a, b = int(before[i]), int(before[i + 1])
            if b - a >= n:
                yield lo + i, np.unique(grams[a:b - n + 1])
            elif b > a:
                yield lo + i, ngram_hashes(words[a:b], b - a).view(np.int64)
            else:
                yield lo + i, np.zeros(0, np.int64)


def set_id(tokens: np.ndarray) -> int:
    """64-bit id of a set of tokens."""
    if not len(tokens):
        return 0
    total = mix(tokens.view(np.uint64) ^ _SALT).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


class _Sizes:
    """Integer arithmetic of the threshold ``num / den``, for numbers and columns alike."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, n: int) -> int:
        """Fewest tokens that a set of n shares with a similar one."""
        return -(-self.num * n // self.den)

    def shared(self, n: int) -> int:
        """L: kept tokens beyond those that may be missing."""
        return min(self.least(n), n // 32 + 16)

    def kept(self, n: int) -> int:
        return n - self.least(n) + self.shared(n)

    def required(self, n: Column) -> Column:
        """Kept tokens that a set of n shares at least with any similar one: L of the smallest such set."""
        def least(x: Column) -> Column:
            return F.floor((x * self.num + self.den - 1) / self.den)
        small = least(n)
        return F.least(least(small), F.floor(small / 32) + 16).cast("long")


def signatures(docs: DataFrame, n: int, sizes: _Sizes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("set_join")
        for batch in batches:
            counts, ids, kept = [], [], []
            for _, tokens in shingle_sets(batch, n):
                counts.append(len(tokens))
                ids.append(set_id(tokens))
                kept.append(tokens[:sizes.kept(len(tokens))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(kept, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_id", "kept"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_id long, kept array<bigint>")


def _open_groups(sizes: _Sizes):
    """Compare one group's members with a block of queries; links per class and a spanning forest."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        enter("set_join")
        pdf = pdf.drop_duplicates(["set_id", "query"])
        members, queries = pdf[~pdf["query"]], pdf[pdf["query"]]
        ids, hard = members["set_id"].to_numpy(), members["hard"].to_numpy()
        copies = members["copies"].to_numpy()
        sets = [np.frombuffer(b, np.int64) for b in members["tokens"]]
        n = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(sets)), n)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        root: dict[int, int] = {}
        links: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        # the group's own members meet in its first block
        asking = [queries, members] if pdf["block"].iloc[0] == 0 and len(members) > 1 else [queries]
        for q in chain.from_iterable(x.itertuples() for x in asking):
            mine = np.frombuffer(q.tokens, np.int64)
            lo = np.searchsorted(tokens, mine, "left")
            width = np.searchsorted(tokens, mine, "right") - lo
            if np.count_nonzero(width) < sizes.least(len(mine)):
                continue  # not even the union of the group's sets holds enough of the query
            at = np.repeat(lo - np.cumsum(width) + width, width) + np.arange(width.sum())
            both = np.bincount(owner[at], minlength=len(ids))
            hit = (sizes.den * both >= sizes.num * (len(mine) + n - both)) & (ids != q.set_id)
            if q.own_gid == q.gid:
                ahead = ids > q.set_id
            else:
                ahead = np.full(len(ids), q.own_gid < q.gid)
            hit &= np.where(hard == q.hard, ahead, not q.hard)  # each pair counts once
            for k in np.flatnonzero(hit):
                d = int(ids[k])
                links[q.set_id] = links.get(q.set_id, 0) + int(copies[k])
                links[d] = links.get(d, 0) + int(q.copies)
                a, b = find(int(q.set_id)), find(d)
                if a != b:
                    root[max(a, b)] = min(a, b)
        out = [(x, find(x), links[x]) for x in links]
        return pd.DataFrame(out, columns=["a", "b", "n_links"]).astype("int64")
    return run


def class_links(docs: DataFrame, signed: DataFrame, classes: DataFrame, n: int, sizes: _Sizes) -> DataFrame:
    """``(a, b, n_links)``: spanning links between classes, with the links that class a gets in one block.

    ``signed`` are the documents' signatures, ``classes`` the distinct sets ``(set_id, first_doc, copies)``.
    """
    some = signed.filter("n_shingles > 0 and doc_id is not null")
    kept = some.select("set_id", F.explode("kept").alias("token"))
    shared = write_and_read(
        kept.groupBy("token").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y"), F.count(F.lit(1)).alias("df"))
        .filter("x < y").select(F.col("token").alias("shared_token"), "df"), "join-shared")
    slim = _likely_shared(some.select("set_id", "n_shingles", "kept"), shared)
    # a class's shared tokens, once however many copies it has; those that share too few have no link
    groups = (slim.join(shared, F.col("token") == F.col("shared_token")).groupBy("set_id")
              .agg(F.first("n_shingles").alias("n"), F.sort_array(F.collect_set(F.struct("df", "token"))).alias("by_df"))
              .withColumn("required", sizes.required(F.col("n"))).filter(F.size("by_df") >= F.col("required")))
    middle = F.element_at("by_df", F.floor((F.size("by_df") + 1) / 2).cast("int"))["df"]
    alike = F.filter("by_df", lambda x: (x["df"] * ALIKE >= F.col("middle")) & (x["df"] <= F.col("middle") * ALIKE))
    groups = (groups.withColumn("middle", middle)
              .withColumn("key", F.array_min(F.transform(alike, lambda x: x["token"])))
              .select("set_id", "n", "required", "key", F.transform("by_df", lambda x: x["token"]).alias("tokens")))
    groups = write_and_read(groups, "join-groups")
    large = groups.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / GROUP, F.sum("n") / GROUP_SHINGLES))
                                      .alias("parts")).filter(F.col("parts") > 1)
    cut = F.coalesce(F.col("parts"), F.lit(1))
    groups = write_and_read(
        groups.join(large, "key", "left").withColumn("gid", F.xxhash64("key", F.pmod(F.xxhash64("set_id"), cut)))
        .select("set_id", "gid", "n", "required", "tokens"), "join-groups")

    own = groups.select("set_id", "gid", "required", F.explode("tokens").alias("token"))
    matrix = write_and_read(own.select("token", "gid").distinct(), "join-matrix")
    hot = write_and_read(matrix.groupBy("token").agg(F.count(F.lit(1)).alias("in_groups"))
                         .filter(F.col("in_groups") > HOT).select(F.col("token").alias("hot_token")), "join-hot")
    n_hot = (own.join(hot, F.col("token") == F.col("hot_token")).groupBy("set_id").agg(F.count(F.lit(1)).alias("n_hot"))
             .withColumnRenamed("set_id", "hot_id"))
    need = F.col("required") - F.coalesce("n_hot", F.lit(0))
    info = write_and_read(
        groups.select("set_id", "gid", "n", "required").join(n_hot, F.col("set_id") == F.col("hot_id"), "left")
        .join(classes.select("set_id", "first_doc", "copies"), "set_id")
        .select("set_id", "gid", "n", "required", need.alias("need"), (need <= 0).alias("hard"), "first_doc", "copies"),
        "join-classes")

    # token-group overlap; hard classes among themselves with all tokens
    plain = own.join(hot, F.col("token") == F.col("hot_token"), "left_anti")
    per_group = matrix.withColumnsRenamed({"token": "m_token", "gid": "m_gid"})
    easy = (plain.join(per_group, (F.col("token") == F.col("m_token")) & (F.col("gid") != F.col("m_gid")))
            .groupBy("set_id", "m_gid").agg(F.count(F.lit(1)).alias("overlap")))
    hard_own = write_and_read(own.join(info.filter("hard").select("set_id"), "set_id", "left_semi"), "join-hard")
    hard_matrix = hard_own.select(F.col("token").alias("m_token"), F.col("gid").alias("m_gid")).distinct()
    stuck = (hard_own.join(hard_matrix, (F.col("token") == F.col("m_token")) & (F.col("gid") != F.col("m_gid")))
             .groupBy("set_id", "m_gid").agg(F.count(F.lit(1)).alias("overlap")))
    per = info.groupBy(F.col("gid").alias("p_gid")).agg(F.count(F.lit(1)).alias("members"), F.max("hard").alias("some_hard"))
    who = info.select("set_id", F.col("gid").alias("own_gid"), "n", "need", "required", "hard", "copies")
    easy = easy.join(who, "set_id").filter("not hard and overlap >= need")
    stuck = stuck.join(who, "set_id").filter("hard and overlap >= required")
    wanted = (easy.unionByName(stuck).join(per, F.col("m_gid") == F.col("p_gid"))
              .filter("own_gid <= m_gid or (some_hard and not hard)")
              .select("set_id", F.col("m_gid").alias("gid"), "own_gid", "n", "hard", "copies"))
    wanted = write_and_read(wanted, "join-wanted")

    # blocks of groups that are asked or have several members
    asked_n = wanted.groupBy("gid").agg(F.sum("n").alias("total"))
    blocks = write_and_read(
        per.join(asked_n, F.col("p_gid") == F.col("gid"), "left").filter("members > 1 or total is not null")
        .select(F.col("p_gid").alias("gid"),
                F.greatest(F.lit(1), F.ceil(F.coalesce("total", F.lit(0)) / BLOCK_SHINGLES)).alias("blocks")), "join-blocks")
    place = ["gid", "block", "own_gid", "hard", "copies", "query"]
    asked = (wanted.join(blocks, "gid")
             .withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")))
             .withColumn("query", F.lit(True)).select("set_id", *place))
    offered = (info.join(blocks, "gid")
               .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
               .withColumn("own_gid", F.col("gid")).withColumn("query", F.lit(False)).select("set_id", *place))
    # per class the blocks it takes part in: its set is made once and goes straight to them
    places = asked.unionByName(offered).groupBy("set_id").agg(F.collect_list(F.struct(*place)).alias("places"))
    need = write_and_read(places.join(info.select("set_id", "first_doc"), "set_id"), "join-need")
    units = _placed_sets(docs, need, n)
    return units.groupBy("gid", "block").applyInPandas(_open_groups(sizes), "a long, b long, n_links long")


def _likely_shared(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """``(token, set_id, n_shingles)`` for the kept tokens that are shared, and few others: most tokens have one class only
    and need not be shuffled again.

    A bitmap with 16 bits or more per shared token, of at most :data:`FILTER_BITS` bits, is built by an aggregation and sent to
    all executors; a token passes when its bit is set. Beyond the size bound more tokens pass; the join that follows is exact.
    """
    bits = min(FILTER_BITS, 1 << max(15, (16 * shared.count()).bit_length()))
    at = F.pmod("shared_token", F.lit(bits)) + 1
    parts = shared.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")).collect()
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in parts:
        bitmap[(r["b"] - 1) * 4096:r["b"] * 4096] = np.frombuffer(r["bitmap"], np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("set_join")
        for batch in batches:
            kept = batch.column(2)
            tokens = kept.flatten().to_numpy(zero_copy_only=False)
            p = tokens % bits
            some = (sent.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(kept.offsets)))[some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[some]), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))],
                names=["token", "set_id", "n_shingles"])

    return rows.mapInArrow(run, "token long, set_id long, n_shingles long")


def _placed_sets(docs: DataFrame, need: DataFrame, n: int) -> DataFrame:
    """The whole sets of the classes in ``need`` ``(set_id, places, first_doc)``, from their documents' texts: a row per place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("set_join")
        for batch in batches:
            wanted = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            offsets, places = np.asarray(lists.offsets) - np.asarray(lists.offsets)[0], lists.flatten()
            rows, tokens, held = [], [], 0

            def flush() -> pa.RecordBatch:
                count = np.array([offsets[i + 1] - offsets[i] for i in rows], np.int64)  # noqa: B023
                at = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in rows])  # noqa: B023
                which = pa.array(np.repeat(np.arange(len(rows)), count))
                taken = places.take(pa.array(at))  # noqa: B023
                return pa.RecordBatch.from_arrays(
                    [pa.array(wanted[rows]).take(which), *taken.flatten(), pa.array(tokens, pa.binary()).take(which)],  # noqa: B023
                    names=["set_id", *(f.name for f in taken.type), "tokens"])

            for i, found in shingle_sets(batch, n):
                if set_id(found) != wanted[i]:  # rows that share an id may hold other texts
                    continue
                rows.append(i)
                tokens.append(found.tobytes())
                held += len(tokens[-1]) * int(offsets[i + 1] - offsets[i])
                if held > 1 << 22:
                    yield flush()
                    rows, tokens, held = [], [], 0
            if rows:
                yield flush()

    # only the texts that are needed meet the places
    need = need.withColumnRenamed("set_id", "need_id")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = (rows_with_ids(texts, "doc_id", need.select("first_doc"))
             .join(need, F.col("doc_id") == F.col("first_doc")).select(F.col("need_id").alias("set_id"), "text", "places"))
    return texts.mapInArrow(run, "set_id long, gid long, block long, own_gid long, hard boolean, copies long, query boolean, "
                                 "tokens binary")


def similar_documents(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)`` for every row of ``docs`` ``(doc_id, text)``.

    ``component_id`` is the smallest id reachable by links; ``n_links`` counts the other documents linked directly, equal
    sets included. Similar: ``den * |A and B| >= num * |A or B|``.
    """
    sizes = _Sizes(num, den)
    signed = write_and_read(signatures(docs, n, sizes), "join-signed")
    classes = write_and_read(
        signed.filter("n_shingles > 0 and doc_id is not null").groupBy("set_id")
        .agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")), "join-classes")
    links = write_and_read(class_links(docs, signed, classes, n, sizes), "join-links")
    roots = connected_components(links)
    counts = links.groupBy(F.col("a").alias("set_id")).agg(F.sum("n_links").alias("others"))
    per = (classes.join(roots, F.col("set_id") == F.col("node"), "left")
           .withColumn("root", F.coalesce("root", "set_id")).drop("node"))
    smallest = per.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    per = (per.join(smallest, "root").join(counts, "set_id", "left")
           .select(F.col("set_id").alias("class_id"), "component_id",
                   (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    per = write_and_read(per, "join-result")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return (signed.select("doc_id", "n_shingles", "set_id")
            .join(per, (F.col("set_id") == F.col("class_id")), "left")
            .select("doc_id", "n_shingles",
                    F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    F.when(linked, F.col("n_links")).otherwise(0).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group of similar ones is kept.

    The smallest id of a group stays, of rows that share it the one with the smallest text checksum. Rows
    with a null id all stay.
    """
    first = similar_documents(docs, **how).filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id"))
    first = write_and_read(first.distinct(), "join-kept")
    stay = rows_with_ids(docs, "doc_id", first, nulls=True)
    twice = write_and_read(docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"))
                           .filter("n_rows > 1").select(F.col("doc_id").alias("kept_id")), "join-twice")
    if twice.isEmpty():  # ids are unique
        return stay
    twice = checked_side(twice)
    single = stay.join(twice, stay["doc_id"] == twice["kept_id"], "left_anti")
    several = stay.join(twice, stay["doc_id"] == twice["kept_id"], "left_semi")
    row = F.struct(*docs.columns)
    several = several.groupBy("doc_id").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return single.unionByName(several)
