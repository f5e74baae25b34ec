"""SimHash near-duplicates by covering locality-sensitive hashing.

Every text gets a 64-bit fingerprint from its word shingles. Distinct fingerprints are put into one
table for each of the structured masks; the masks guarantee that any two fingerprints within the
radius agree on the masked bits of at least one of them. In each bucket the fingerprints that links
connect are told by exact distances, and one edge to the smallest of them stands for each, so that a
group of any size gives as many edges as it has members and not all its pairs. Buckets are read as a
sorted stream. The edges of all tables are joined to components by alternating large and small stars.

Defined cases: a null or empty text, or one without words, has the fingerprint zero and links like
any other; a text of fewer words than a shingle is one shingle; equal texts share a fingerprint and
therefore a component; null ids are ignored for a component's smallest id (null if it has no other);
repeated rows give repeated rows; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import discard, free, importable, map_slices, stored

BITS, SHINGLE_WORDS, RADIUS, SEED = 64, 4, 4, 42
#: Shingles whose similarity ``keep_one`` may ask for; minima in a band, and bands: a pair at 0.8 shares one but for 3 in 100,000.
SIMILAR_WORDS, BAND_ROWS, BANDS = 5, 4, 20
#: Pivots that a key's members meet in the first turn; in each later one so many times more.
PIVOTS, MORE_PIVOTS = 4, 16
#: Hashes whose bits are counted at one time, and fingerprints compared with the rest at one time.
COUNT_ROWS, FRONTIER_ROWS = 1 << 16, 64
#: Members from which on a bucket is dealt once more.
MANY = 1 << 13


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The hashes of all shingles, in order; none for a text without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, "<u8")
    line = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    spans = zip([0, *ends], (e - 1 for e in ends[words - 1 :]), strict=False) if len(tokens) >= words else [(0, len(line))]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in spans], "<u8")


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """As an unsigned integer."""
    hashes = shingles(text, words)
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), COUNT_ROWS):
        counts += np.unpackbits(hashes[lo : lo + COUNT_ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp) for every row; fp holds the 64 bits as a long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=[id_col, "fp"])

        return work

    return map_slices(docs.select(id_col, text_col), make, f"`{id_col}` {id_type}, fp long")


def covering_masks(radius: int = RADIUS, places: range | list[int] = range(BITS)) -> list[int]:
    """2^(radius + 1) - 1 masks over the bits at ``places``, as signed longs.

    The i-th bit has the vector 1 + i mod (2^(radius + 1) - 1) over GF(2); mask v has the bits whose vector
    has an odd product with v. Any ``radius`` vectors of radius + 1 coordinates have a common
    orthogonal v other than zero, and mask v has none of their bits.
    """
    top = (1 << radius + 1) - 1
    masks = [sum(1 << p for i, p in enumerate(places) if ((1 + i % top) & v).bit_count() % 2) for v in range(1, top + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def bucket_roots(members: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each distinct fingerprint (unsigned), the smallest that links of at most ``radius`` bits
    connect it with. What has been reached leaves the array of candidates, so that dense buckets
    cost little more than one comparison each; what many members without links have in common is
    dealt once more, by masks over the bits in which they differ."""
    if len(members) > MANY:
        return _dealt_roots(members, radius)
    return _compared_roots(members, radius)


def _compared_roots(members: np.ndarray, radius: int) -> np.ndarray:
    roots = members.copy()
    rest = np.arange(len(members))
    while len(rest):
        reached = [rest[:1]]
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            now, frontier = frontier[:FRONTIER_ROWS], frontier[FRONTIER_ROWS:]
            near = np.zeros(len(rest), bool)
            for x in members[now]:
                near |= np.bitwise_count(members[rest] ^ x) <= radius
            if near.any():
                reached.append(rest[near])
                frontier = np.concatenate([frontier, rest[near]])
                rest = rest[~near]
        group = np.concatenate(reached)
        roots[group] = members[group].min()
    return roots


def _dealt_roots(members: np.ndarray, radius: int) -> np.ndarray:
    """``bucket_roots`` of a large bucket, by buckets within it."""
    differing = np.bitwise_or.reduce(members ^ members[0])
    places = [i for i in range(BITS) if int(differing) >> i & 1]
    masks = covering_masks(radius, places)
    parent = np.arange(len(members))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    at = {int(m): i for i, m in enumerate(members)}
    for mask in masks:
        keys = members & np.uint64(mask & (1 << 64) - 1)
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0, [True]]))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo > 1:
                group = members[order[lo:hi]]
                roots = bucket_roots(group, radius) if hi - lo < len(members) else _compared_roots(group, radius)
                for x, r in zip(group[roots != group].tolist(), roots[roots != group].tolist(), strict=True):
                    a, b = top(at[x]), top(at[r])
                    parent[max(a, b)] = min(a, b)
    tops = np.array([top(i) for i in range(len(members))])
    least = np.full(len(members), ~np.uint64(0))
    np.minimum.at(least, tops, members)
    return least[tops]


def bucket_edges(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect what links connect."""
    masks = covering_masks(radius)
    keys = F.explode(F.array(*(F.struct(F.lit(k).cast("short").alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for k, m in enumerate(masks))))
    dealt = prints.select("fp", keys.alias("k")).select("fp", "k.mask", "k.bucket").repartition("mask", "bucket").sortWithinPartitions("mask", "bucket", "fp")

    def edges(mask: np.ndarray, bucket: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (bucket[1:] != bucket[:-1])]))
        sizes = np.diff(np.concatenate([starts, [len(fp)]]))
        a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for lo, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            members = fp[lo : lo + n]
            roots = bucket_roots(members, radius)
            linked = roots != members
            a.append(members[linked])
            b.append(roots[linked])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            a, b = edges(*map(np.concatenate, zip(*parts, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list[list[np.ndarray]] = []  # parts of the buckets from the last one seen on
        for batch in batches:
            if not batch.num_rows:
                continue
            mask, bucket, fp = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("mask", "bucket", "fp"))
            fp = fp.view(np.uint64)
            last = int(np.flatnonzero((mask != mask[-1]) | (bucket != bucket[-1]))[-1]) + 1 if (mask[0], bucket[0]) != (mask[-1], bucket[-1]) else 0
            same = bool(held) and (held[-1][0][-1], held[-1][1][-1]) == (mask[0], bucket[0])
            if held and (last or not same):
                if same or last:
                    held.append([mask[:last], bucket[:last], fp[:last]])
                yield out(held)
                held = []
            elif last:
                yield out([[mask[:last], bucket[:last], fp[:last]]])
            held.append([mask[last:], bucket[last:], fp[last:]])
        if held:
            yield out(held)

    return dealt.mapInArrow(run, "a long, b long")


def connected(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root the smallest node of its component.

    Large-star and small-star steps alternate until nothing changes; each round's edges are written
    to the shared folder, so a round never recomputes the ones before."""
    now = stored(spark, edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.isEmpty():
        return now.toDF("node", "root")
    seen = None
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(first, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(first.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, stored(spark, small, "edges")
        discard(before)
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == seen:
            break
        seen = state
    return now.toDF("node", "root").union(now.select("b", "b").distinct())


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of the shingles of five words, sorted."""
    return np.unique(shingles(text, SIMILAR_WORDS))


def set_key(found: np.ndarray) -> int:
    """A hash of a shingle set: equal sets have equal keys."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band of minima over a shingle set that isn't empty."""
    rng = np.random.default_rng(SEED)
    factor, shift = rng.integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), np.uint64)
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for lo in range(0, len(found), COUNT_ROWS >> 4):
        least = np.minimum(least, (found[lo : lo + (COUNT_ROWS >> 4)] * (factor | np.uint64(1)) + shift).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, fp, s, n, bands) for every row: the fingerprint, the shingle set's key and size, its band keys."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            sets = [shingle_set(t) for t in texts]
            whole = lambda values: pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())
            bands = pa.array([band_keys(x).view(np.int64) if len(x) else [] for x in sets], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column(0), whole([fingerprint(t) for t in texts]), whole([set_key(x) for x in sets]), pa.array([len(x) for x in sets], pa.int32()), bands], names=[id_col, "fp", "s", "n", "bands"])

        return work

    return map_slices(docs.select(id_col, text_col), make, f"`{id_col}` {id_type}, fp long, s long, n int, bands array<long>")


def open_keys(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` (key, s, ...) with their ``root``, of keys whose members aren't all connected."""
    at = members.join(roots, "s")
    still = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return at.join(still, "key", "left_semi")


def prefixes(sets: DataFrame) -> DataFrame:
    """(key, s, n, left): of each set (s, items) its rarest shingles, as many as a set with the similarity can't do without.

    Two sets that have it share at least ceil(0.8 n) shingles, so in one order of all shingles their
    first n - ceil(0.8 n) + 1 have one in common. Shingles of one set only come first and are no keys.
    ``left`` counts the set's shingles from the key on."""
    each = sets.select("s", F.size("items").alias("n"), F.explode("items").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    own = each.join(shared, "key").groupBy("s", "n").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("keys"))
    most = F.expr("n - (4 * n + 4) div 5 + 1 - (n - size(keys))").cast("int")
    return own.where(most > 0).select(F.posexplode(F.slice("keys", F.lit(1), most)).alias("i", "k"), "s", "n", F.expr("n - size(keys)").alias("alone")).select("k.key", "s", "n", (F.col("n") - F.col("alone") - F.col("i")).alias("left"))


def choose_pivots(members: DataFrame, pivots: int, turn: int) -> DataFrame:
    """(key, p): of each of ``pivots`` shares of a key, the member that shares keys with most others."""
    share = F.pmod(F.xxhash64("s", F.lit(turn)), F.lit(pivots))
    return members.groupBy("key", share.alias("share")).agg(F.max(F.struct("w", "s", "n", "left", "root")).alias("p")).select("key", "p")


def pivot_pairs(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member with its key's pivots, where they aren't connected and what
    both have from the key on, if it is the first that they share, allows the similarity."""
    met = members.join(pivots, "key").where((F.col("root") != F.col("p.root")) & (9 * F.least("left", "p.left") >= 4 * (F.col("n") + F.col("p.n"))))
    return met.select(F.least("s", "p.s").alias("a"), F.greatest("s", "p.s").alias("b")).distinct()


def shingle_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(s, items) for the keys ``s`` in ``wanted``: the shingle sets, from the text of one id each."""
    ids = rows.join(wanted, "s", "left_semi").groupBy("s").agg(F.min(id_col).alias("wanted")).select("wanted").distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t) for t in batch.column(0).to_pylist()]
            keys = np.array([set_key(x) for x in sets], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["s", "items"])

        return work

    return map_slices(texts, make, "s long, items array<long>").dropDuplicates(["s"])


def similar_roots(spark: SparkSession, docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, root) for the roots in ``rows`` (id_col, root, s, n, bands) that equal shingle sets, or
    sets with a similarity of 0.8 or more, connect; others may be left out.

    Sets that share a band of minima are candidates; the rarest of their shingles become keys, as
    similar sets have one in common. A key isn't spelled out in pairs: in each turn all its members
    meet a few pivots, the sets themselves tell which are similar, links are joined, and keys whose
    members are connected by then are closed. The others go on without these pivots, which have met
    everyone, and with more new ones, until no key is open. So no link between candidates is lost,
    and a group of copies costs a few rows a member."""
    nodes = stored(spark, rows.groupBy("s").agg(F.min("root").alias("root"), F.first("n").alias("n"), F.first("bands").alias("bands")), "sets")
    equal = rows.select("s", F.col("root").alias("a")).distinct().join(nodes.select("s", F.col("root").alias("b")), "s").where("a != b").select("a", "b")
    base = stored(spark, connected(spark, equal), "equal")
    placed = nodes.join(base, nodes["root"] == base["node"], "left").select("s", "bands", F.coalesce(base["root"], nodes["root"]).alias("root"))
    banded = placed.select(F.explode("bands").alias("key"), "s", "root")
    crowded = banded.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    first = stored(spark, banded.join(crowded, "key", "left_semi").select("s", "root").distinct(), "roots")
    sets = stored(spark, shingle_sets(docs, rows, first.select("s"), id_col, text_col), "shingles")
    found = stored(spark, open_keys(prefixes(sets), first).drop("root"), "keys")
    weights = found.join(found.groupBy("key").agg(F.count("*").alias("c")), "key").groupBy("s").agg(F.sum("c").alias("w"))
    members = stored(spark, found.join(weights, "s").select("key", "s", "n", "left", "w"), "members")
    discard(found)
    roots, turn = first, 0
    while True:
        still = stored(spark, open_keys(members, roots), "open")
        discard(members)
        if still.isEmpty():
            break
        pivots = stored(spark, choose_pivots(still, PIVOTS * MORE_PIVOTS**turn, turn), "pivots")
        pairs = pivot_pairs(still, pivots)
        common = F.size(F.array_intersect("x", "y"))
        linked = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").where(9 * common >= 4 * (F.size("x") + F.size("y"))).select("a", "b")
        links = stored(spark, linked.join(roots.toDF("a", "ra"), "a").join(roots.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
        if not links.isEmpty():
            joined = connected(spark, links)
            roots = stored(spark, roots.join(joined.toDF("root", "wider"), "root", "left").select("s", F.coalesce("wider", "root").alias("root")), "roots")
        met = pivots.select("key", F.col("p.s").alias("s"))
        members = stored(spark, still.join(met, ["key", "s"], "left_anti").select("key", "s", "n", "left", "w"), "members")
        for used in (still, pivots, links):
            discard(used)
        turn += 1
    moved = first.toDF("s", "node").join(roots, "s").select("node", "root").distinct()
    later = moved.toDF("root", "wider")
    return base.join(later, "root", "left").select("node", F.coalesce("wider", "root").alias("root")).union(moved).distinct()


def classes(spark: SparkSession, rows: DataFrame, id_col: str, radius: int) -> DataFrame:
    """(fp, root, component_id) for the fingerprints of ``rows`` (id_col, fp) that aren't alone."""
    groups = stored(spark, rows.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count("*").alias("n")), "distinct")
    nodes = stored(spark, connected(spark, bucket_edges(groups, radius)), "components").withColumnRenamed("node", "fp")
    found = nodes.join(groups, "fp")
    least = found.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = found.join(least, "root").select("fp", "root", "component_id")
    alone = groups.where("n > 1").join(nodes, "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least_id").alias("component_id"))
    return stored(spark, linked.union(alone), "classes")


def components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id_col, fp, root, component_id) for every row: the fingerprint, the component's smallest
    fingerprint (as a long) and its smallest id."""
    importable(spark)
    rows = stored(spark, fingerprints(docs, id_col, text_col), "fingerprints")
    at = rows.join(classes(spark, rows, id_col, radius), "fp", "left")
    return at.select(id_col, "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col(id_col)).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, similar: bool = False) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (null ids last), then
    the smallest fingerprint. Of rows equal in both, any one. If ``similar``, texts with a similarity
    of 0.8 or more over shingles of five words are linked too."""
    if similar:
        importable(spark)
        sketched = stored(spark, sketches(docs, id_col, text_col), "sketches")
        near = classes(spark, sketched.select(id_col, "fp"), id_col, radius).select("fp", "root")
        rows = sketched.join(near, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        wider = similar_roots(spark, docs, rows, id_col, text_col).toDF("root", "wider")
        found = stored(spark, rows.select(id_col, "fp", "root").join(wider, "root", "left").select(id_col, "fp", F.coalesce("wider", "root").alias("root")), "found")
    else:
        found = stored(spark, components(spark, docs, id_col, text_col, radius), "found")
    best = found.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), "fp")).alias("k"))
    of, print_of, own = free(docs, "keep_id", "keep_fp", "fp")
    keep = best.select(F.col("k.id").alias(of), F.col("k.fp").alias(print_of))
    if not found.groupBy(id_col).count().where("count > 1").limit(1).count():
        # The kept ids grow with the documents, so they are never broadcast; hashing them spares sorting the texts.
        return docs.join(keep.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(of)), "left_semi")
    # Ids repeat: rows are told apart by their fingerprints too.
    names = docs.columns
    at = names.index(text_col)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64())], names=[*names, own])

        return work

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{own}` long"])
    marked = map_slices(docs, make, schema)
    kept = marked.join(keep.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(of)) & (F.col(own) == F.col(print_of)), "left_semi")
    return kept.dropDuplicates([id_col, own]).select(*(f"`{n}`" for n in names))
