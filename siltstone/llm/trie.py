"""The prefix trie of conversations, from chained digests.

A conversation's turns, in order, are chained: the digest of its first d turns is the SHA-256 of the
digest before and of the turn's own digest. Every prefix of every conversation is a row, and a group
of (depth, digest) is a node. A node's members are the conversations that start with it.

Sums over subtrees. Along a conversation the smallest member of its nodes never falls on the way
down, so the nodes with one smallest member are a path, and every node lies on exactly one path,
named by that member, its owner. Each path is exploded to all the paths that it hangs from, with the
depth where it leaves them, and a node adds up what leaves its path at its depth or below. Single
nodes exploded to all ancestors would give the same sums, but half the square of its turns for
each long conversation; a path hangs from fewer others than its owner has turns, so these rows are
never more than turns.

Hot keys: counts, minima and sums are added up before they are shuffled. What a node tells its many
members goes through (digest, bucket) pairs, with as many buckets as there are shuffle partitions.
Sums along a path go through blocks of BLOCK depths. A chain of digests is sequential by nature: one task
streams one conversation's turn digests, of 32 bytes each, and holds one at a time. The ids that end
at one node are joined into pieces in range-sorted partitions; only the pieces meet in one task,
which hashes them in order and holds one at a time.

Defined cases: null roles and texts count as empty; null turns come first; rows of one turn are
ordered by the digest of role and text, so equal rows are turns each; rows without a conv_id belong
to no conversation and are left out; an empty table has no conversations and gives no nodes, not even the root;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import importable, stored

#: A conversation takes its first turns from the first conversation of its family of so many ids, at most REACH of them.
FAMILY, REACH = 5, 9
#: Depths of a path that one group of a window holds.
BLOCK = 4096
#: Characters of joined ids in one piece of a node's list.
PIECE = 1 << 16
_EMPTY = hashlib.sha256(b"").digest()


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its family."""
    return F.crc32(conv_id.cast("string")) % REACH


def ranked(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, turn_digest, n_bytes): the turns of each conversation, numbered from 1.

    A turn's digest is of the role's length in bytes, the role and the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("turn_digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "turn_digest")
    return rows.select("conv_id", F.row_number().over(order).alias("rank"), "turn_digest", "n_bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations over ``ranked`` turns whose first ones come from the first conversation of their
    family, as a forked chat's do. Rank 0, without a digest, stands for the conversation itself."""
    c, h = F.col("conv_id"), shared_turns(F.col("conv_id"))
    own = turns.where(F.col("rank") > h)
    heads = turns.where("rank = 1").select("conv_id")
    opening = turns.where(F.col("rank") < REACH).select(c.alias("base"), "rank", "turn_digest", "n_bytes")
    taken = heads.select("conv_id", (c - c % FAMILY).alias("base"), h.alias("h")).join(opening, "base").where("rank <= h").select(*turns.columns)
    root = heads.select("conv_id", F.lit(0).alias("rank"), F.lit(None).cast("binary").alias("turn_digest"), F.lit(0).cast("long").alias("n_bytes"))
    return own.unionByName(taken).unionByName(root)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, parent, n_bytes, is_end): every prefix of every conversation.

    ``turns`` has a row of rank 0 for each conversation. ``n_bytes`` is the last turn's."""
    importable(turns.sparkSession)
    stream = turns.select("conv_id", "rank", "turn_digest", "n_bytes").repartition("conv_id").sortWithinPartitions("conv_id", "rank").select("conv_id", "turn_digest", "n_bytes")
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("n_bytes", pa.int64()), ("is_end", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the latest prefix, held back until it is known whether its conversation goes on
        for batch in batches:
            done = []
            for conv, turn, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is not None:
                    done.append((*last, conv != last[0]))
                if turn is None:
                    last = (conv, 0, _EMPTY, None, 0)
                else:
                    last = (conv, last[1] + 1, hashlib.sha256(last[2] + turn).digest(), last[2], size)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)] if done else [pa.array([], f.type) for f in schema], schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*last, True), schema, strict=True)], schema=schema)

    return stream.mapInArrow(run, "conv_id long, depth long, digest binary, parent binary, n_bytes long, is_end boolean")


def _hashed(ends: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256) of (depth, digest, conv_id): the hash of each node's ids, ascending and comma-joined."""
    importable(ends.sparkSession)
    ends = ends.select("depth", "digest", "conv_id")

    def batch_of(rows: list[tuple], kinds: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("depth", pa.int64()), ("digest", pa.binary()), ("first", pa.int64()), ("piece", pa.string())]
        now, ids, size = None, [], 0
        piece = lambda: (*now, ids[0], ",".join(map(str, ids)))
        for batch in batches:
            done = []
            for depth, digest, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, digest) != now or size >= PIECE:
                    if ids:
                        done.append(piece())
                    now, ids, size = (depth, digest), [], 0
                ids.append(conv)
                size += 20
            yield batch_of(done, kinds)
        if ids:
            yield batch_of([piece()], kinds)

    def digest_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("depth", pa.int64()), ("digest", pa.binary()), ("ends_sha256", pa.string())]
        now, state = None, None
        for batch in batches:
            done = []
            for depth, digest, _, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, digest) != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (depth, digest), hashlib.sha256(piece.encode())
                else:
                    state.update(f",{piece}".encode())
            yield batch_of(done, kinds)
        if now is not None:
            yield batch_of([(*now, state.hexdigest())], kinds)

    key = ("depth", "digest")
    pieces = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(join, "depth long, digest binary, first long, piece string")
    return pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest_all, "depth long, digest binary, ends_sha256 string")


def nodes(spark: SparkSession, found: DataFrame) -> DataFrame:
    """One row for each node of ``prefixes``: depth, digest, conv_id (smallest member), parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found = stored(spark, found, "prefixes")
    key = ["depth", "digest"]
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.hash("conv_id"), F.lit(salts)).alias("bucket")
    # Members by node and bucket; these rows also carry the owner's name back to the prefixes.
    parts = stored(spark, found.groupBy(*key, bucket).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.max("n_bytes").alias("n_bytes")), "node-parts")
    whole = stored(spark, parts.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.min("parent").alias("parent"), F.max("n_bytes").alias("n_bytes")), "nodes")
    child = whole.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest"), F.lit(1).cast("long").alias("n_children"))
    facts = whole.select(*key, F.lit(0).cast("long").alias("n_children"), F.struct("conv_id", "n_convs", (F.col("n_bytes") * (F.col("n_convs") - 1)).alias("saved")).alias("fact"))
    counted = facts.unionByName(child, allowMissingColumns=True).groupBy(*key).agg(F.max("fact").alias("fact"), F.sum("n_children").alias("n_children"))
    placed = stored(spark, counted.select(F.col("fact.conv_id").alias("owner"), "depth", "digest", F.col("fact.n_convs").alias("n_convs"), "n_children", (F.col("n_children") == 0).cast("long").alias("leaf"), F.col("fact.saved").alias("saved")), "placed")

    owners = parts.select(*key, "bucket").join(placed.select(*key, "owner"), key)
    above = found.select("conv_id", *key, bucket).join(owners, [*key, "bucket"]).where("owner < conv_id")
    hung = above.groupBy("conv_id", "owner").agg(F.max("depth").alias("depth"))
    paths = placed.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    hung = stored(spark, hung.join(paths, "conv_id"), "hung-paths")
    tops = hung.groupBy("conv_id").agg(F.max(F.struct("depth", "owner")).alias("at")).select(F.col("conv_id").alias("owner"), (F.col("at.depth") + 1).alias("depth"), F.col("at.owner").alias("above"))

    own = placed.select("owner", "depth", "leaf", "saved", F.struct("digest", "n_convs", "n_children").alias("fact"))
    gathered = own.unionByName(hung.select("owner", "depth", "leaf", "saved"), allowMissingColumns=True).unionByName(tops, allowMissingColumns=True)
    each = gathered.groupBy("owner", "depth").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.max("fact").alias("fact"), F.max("above").alias("above")).withColumn("block", F.floor(F.col("depth") / BLOCK))
    each = stored(spark, each, "paths")
    below = Window.partitionBy("owner").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = each.groupBy("owner", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    later = blocks.select("owner", "block", *(F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_later") for c in ("leaf", "saved")))
    within = Window.partitionBy("owner", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = each.join(later, ["owner", "block"]).select("*", *((F.sum(c).over(within) + F.col(f"{c}_later")).alias(f"{c}_all") for c in ("leaf", "saved")))
    out = summed.select(
        F.col("depth"),
        F.col("fact.digest").alias("digest"),
        F.col("owner").alias("conv_id"),
        F.when(F.col("depth") > 0, F.coalesce("above", "owner")).alias("parent_conv_id"),
        F.col("fact.n_convs").alias("n_convs"),
        F.col("fact.n_children").alias("n_children"),
        F.col("leaf_all").alias("n_leaves"),
        F.col("saved_all").alias("saved_tokens"),
    )
    ends = _hashed(found.where("is_end"))
    return out.join(ends, key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY.hex())))


def build(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of (conv_id, turn, role, text) rows."""
    return nodes(spark, prefixes(rebuilt(ranked(conversations))))
