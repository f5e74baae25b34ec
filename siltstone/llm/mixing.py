"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Targets: the sources, by code point with null last, weigh 5, 2, 1, repeating, and share a multiple
of all sizes; a target stops at the most copies' worth of its source and the excess is shared anew.
A document's expected copies are its source's target over its size; the whole part is given, the
fraction is rounded. Rounding pairs two fractions and moves words from one to the other, either way
with the chance that keeps both expectations, until one of them is none or whole. First each of a
source's HEAD largest documents is paired, from the largest on, with all smaller ones taken as one,
whose fractions move together. The others are dealt into bounded chunks, each of which leaves at most
one fraction, and the chunks' fractions go up the source's own reduction tree until one is left. That
one becomes a copy with the chance that it says. So expected copies hold for every document, and a
source's words miss the target by less than one document.

Defined cases: a null text has size 0; rows that share source and id (null ids too) are rounded as
one and get equal copies; documents of size 0 get the rounded copies of their source; an empty table
gives an empty result; other columns are ignored. Random numbers are hashes of the seed and the ids,
so reruns agree. No source's treatment depends on the others but for its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import free, stored

WEIGHTS = (5, 2, 1)
#: All targets together as a multiple of all sizes, and a target at most as one of its source's.
SHARE, MOST_COPIES = 1.5, 2
#: Largest documents that are rounded first; others in a chunk, and chunks whose fractions meet in one node, on average.
HEAD, CHUNK, FAN = 256, 256, 64
SEED = 20_240_607


def size_of(text: Column) -> Column:
    """The number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(spark: SparkSession, df: DataFrame, order: Column, sums: dict[str, Column]) -> DataFrame:
    """``df`` with running totals in ``order``. Rows are sorted in ranges; one task adds up the ranges'
    own totals, a row for each."""
    placed = stored(spark, df.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(F.col("range").alias("at")).agg(*(F.sum(x).cast("double").alias(n) for n, x in sums.items()))
    offsets = totals.select("at", *(F.coalesce(F.sum(n).over(earlier), F.lit(0.0)).alias(f"{n}_before") for n in sums))
    so_far = Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(offsets), F.col("range") == F.col("at"))
    return joined.withColumns({n: F.sum(x).over(so_far) + F.col(f"{n}_before") for n, x in sums.items()}).drop("range", "at", *(f"{n}_before" for n in sums))


def targets(spark: SparkSession, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, n_units, target) from (source, size).

    Words for each unit of weight are such that all targets, none above its limit, add up: the most
    that any number of sources, those first at their limits, leave to a unit of the others' weight."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_units"))
    placed = running(spark, per, F.col("source").asc_nulls_last(), {"place": F.lit(1)})
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(most))
    ranked = stored(spark, placed.withColumn("weight", weight).withColumn("limit", limit), "sources")
    words, units = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, units = (words or 0) * share, units or 0.0
    held = running(spark, ranked.where("limit > 0"), F.expr("limit / weight").asc(), {"at_limit": F.col("limit"), "of_weight": F.col("weight")})
    nothing = ranked.where("limit = 0").agg(F.sum("weight")).first()[0] or 0.0
    free = units - nothing
    left = F.when(F.lit(free) - F.col("of_weight") > 1e-9, (F.lit(total) - F.col("at_limit")) / (F.lit(free) - F.col("of_weight")))
    level = max(held.agg(F.max(left)).first()[0] or 0.0, total / free if free else 0.0)
    return ranked.select("source", "source_size", "n_units", F.least(F.lit(level) * F.col("weight"), "limit").alias("target"))


def _largest(id_type: str, seed: int) -> str:
    """SQL for a source's ``items`` (id, s), the largest first, each paired with all that come after
    it. The state: m of the s words of what comes after are still to be given; ``done`` (id, up)."""
    zero = f"named_struct('m', mass, 's', cast(source_size as double), 'done', cast(array() as array<struct<id: {id_type}, up: int>>))"
    # own: words of x to be given; a: words that can go from the rest to x; b: from x to the rest.
    shares = "named_struct('own', if(acc.s > 0, x.s * acc.m / acc.s, 0D), 'rest', greatest(acc.s - x.s, 0D))"
    moves = "named_struct('own', v.own, 'rest', v.rest, 'm', greatest(acc.m - v.own, 0D), 'a', least(x.s - v.own, greatest(acc.m - v.own, 0D)), 'b', least(v.own, v.rest - greatest(acc.m - v.own, 0D)))"
    chance = lambda k: f"(shiftrightunsigned(xxhash64({seed}, {k}, x.id), 11) / 9007199254740992D)"
    moved = f"""case when w.rest <= 0 or w.a + w.b <= 0 then named_struct('own', w.own, 'm', w.m, 'rest', w.rest)
        when {chance(1)} * (w.a + w.b) < w.b then named_struct('own', if(w.a = x.s - w.own, x.s, w.own + w.a), 'm', if(w.a = w.m, 0D, w.m - w.a), 'rest', w.rest)
        else named_struct('own', if(w.b = w.own, 0D, w.own - w.b), 'm', if(w.b = w.rest - w.m, w.rest, w.m + w.b), 'rest', w.rest) end"""
    settle = f"named_struct('m', y.m, 's', y.rest, 'done', concat(acc.done, array(named_struct('id', x.id, 'up', if({chance(2)} * x.s < y.own, 1, 0)))))"
    step = f"transform(transform(transform(array({shares}), v -> {moves}), w -> {moved}), y -> {settle})[0]"
    return f"aggregate(items, {zero}, (acc, x) -> {step})"


def _fold(id_type: str, seed: int) -> str:
    """SQL for one chunk: ``items`` (id, s: size, m: words of the fraction), largest first, become
    ``cur`` (the fraction that is left, or null) and ``done`` (id, up: whether a copy was added)."""
    item = f"struct<id: {id_type}, s: double, m: double>"
    zero = f"named_struct('cur', cast(null as {item}), 'done', cast(array() as array<struct<id: {id_type}, s: double, up: int>>))"
    # a: words that can go from x to cur; b: words that can go from cur to x.
    moves = f"named_struct('a', least(acc.cur.s - acc.cur.m, x.m), 'b', least(acc.cur.m, x.s - x.m), 'u', shiftrightunsigned(xxhash64({seed}, acc.cur.id, x.id), 11) / 9007199254740992D)"
    moved = """case when v.u * (v.a + v.b) < v.b
        then named_struct('i', if(v.a = acc.cur.s - acc.cur.m, acc.cur.s, acc.cur.m + v.a), 'j', if(v.a = x.m, 0D, x.m - v.a))
        else named_struct('i', if(v.b = acc.cur.m, 0D, acc.cur.m - v.b), 'j', if(v.b = x.s - x.m, x.s, x.m + v.b)) end"""
    settle = f"""named_struct(
        'cur', case when w.i > 0 and w.i < acc.cur.s then named_struct('id', acc.cur.id, 's', acc.cur.s, 'm', w.i)
                    when w.j > 0 and w.j < x.s then named_struct('id', x.id, 's', x.s, 'm', w.j)
                    else cast(null as {item}) end,
        'done', concat(acc.done,
            filter(array(named_struct('id', acc.cur.id, 's', acc.cur.s, 'up', if(w.i > 0, 1, 0))), d -> not (w.i > 0 and w.i < acc.cur.s)),
            filter(array(named_struct('id', x.id, 's', x.s, 'up', if(w.j > 0, 1, 0))), d -> not (w.j > 0 and w.j < x.s))))"""
    step = f"transform(transform(array({moves}), v -> {moved}), w -> {settle})[0]"
    return f"aggregate(items, {zero}, (acc, x) -> case when acc.cur is null then named_struct('cur', x, 'done', acc.done) else {step} end)"


def copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """(id_col, source, size, source_size, target, copies) for every row of ``docs``."""
    rows = stored(spark, docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")), "sizes")
    units = rows.groupBy("source", "id").agg(F.sum("size").alias("size"))
    id_type = rows.schema["id"].dataType.simpleString()
    key = F.struct(F.col("size").cast("double").alias("s"), "id")
    goal = stored(spark, targets(spark, units, weights, share, most), "targets")

    # The largest documents of each source, against all others of it; then the fraction that others have.
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("size"), F.desc("id")))
    largest = units.where("size > 0").withColumn("nth", nth).where(F.col("nth") <= HEAD).groupBy(F.col("source").alias("of")).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", key.alias("key")))), lambda x: F.struct(x["key"]["id"].alias("id"), x["key"]["s"].alias("s"))).alias("items"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    begun = goal.withColumn("rate", rate).withColumn("mass", (F.col("rate") - F.floor("rate")) * F.col("source_size")).join(largest, F.col("source").eqNullSafe(F.col("of")), "left")
    heads = stored(spark, begun.select("source", "source_size", "target", "n_units", "rate", F.expr("transform(slice(items, -1, 1), x -> named_struct('s', x.s, 'id', x.id))[0]").alias("least"), F.expr(_largest(id_type, seed)).alias("f")), "heads")
    left = F.when(F.col("f.s") > 0, F.col("f.m") / F.col("f.s")).otherwise(0.0)
    h = heads.select(F.col("source").alias("of"), "source_size", "target", "n_units", "rate", "least", F.when(left < 1e-9, 0.0).when(left > 1 - 1e-9, 1.0).otherwise(left).alias("p"))

    width_of = F.ceil((F.col("n_units") - HEAD) / CHUNK)
    level = (
        units.join(h.where("p > 0 and p < 1"), F.col("source").eqNullSafe(F.col("of")))
        .where(F.col("size") > 0).where(key < F.col("least"))
        .withColumn("width", F.greatest(width_of, F.lit(1)))
        .select("source", "width", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("width")).alias("chunk"), F.struct(F.col("id"), F.col("size").cast("double").alias("s"), (F.col("size") * F.col("p")).alias("m")).alias("item"))
    )
    width = h.where("p > 0 and p < 1").agg(F.max(F.greatest(width_of, F.lit(1)))).first()[0] or 0
    items = F.transform(F.sort_array(F.collect_list(F.when(F.col("item").isNotNull(), F.struct(F.col("item.s").alias("s"), F.col("item.id").alias("id"), F.col("item.m").alias("m")))), asc=False), lambda x: F.struct(x["id"].alias("id"), x["s"].alias("s"), x["m"].alias("m")))
    last = f"if(f.cur is null, f.done, concat(f.done, array(named_struct('id', f.cur.id, 's', f.cur.s, 'up', if(shiftrightunsigned(xxhash64({seed}, 3, f.cur.id), 11) / 9007199254740992D * f.cur.s < f.cur.m, 1, 0)))))"
    settled = [heads.select("source", F.explode("f.done").alias("d")).select("source", "d.id", "d.up")]
    while width:
        folded = stored(spark, level.groupBy("source", "width", "chunk").agg(items.alias("items")).select("source", "width", "chunk", F.expr(_fold(id_type, seed)).alias("f")), "rounded")
        done = F.when(F.col("width") == 1, F.expr(last)).otherwise(F.col("f.done"))
        settled.append(folded.select("source", F.explode(done).alias("d")).select("source", "d.id", "d.up"))
        if width == 1:
            break
        width = -(-width // FAN)
        level = folded.where("width > 1").select("source", F.expr(f"(width + {FAN - 1}) div {FAN}").alias("width"), F.expr(f"chunk div {FAN}").alias("chunk"), F.col("f.cur").alias("item"))
    up = settled[0]
    for more in settled[1:]:
        up = up.unionByName(more)
    up = up.select(F.col("source").alias("in"), F.col("id").alias("which"), "up")
    joined = rows.join(h, F.col("source").eqNullSafe(F.col("of"))).join(up, F.col("source").eqNullSafe(F.col("in")) & F.col("id").eqNullSafe(F.col("which")), "left")
    given = F.when(F.col("size") == 0, F.floor(F.col("rate") + 0.5)).otherwise(F.floor("rate") + F.coalesce("up", F.col("p").cast("int")))
    return joined.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", given.cast("int").alias("copies"))


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row repeated as often as its copies say."""
    found = copies(spark, docs, id_col, text_col, source_col, **options)
    of, origin, times, nth = free(docs, "id", "source", "copies", "nth")
    given = stored(spark, found.where("copies > 0").select(F.col(id_col).alias(of), F.col(source_col).alias(origin), F.col("copies").alias(times)).distinct(), "copies")
    # The copies grow with the documents, so they are never broadcast; hashing them spares sorting the texts.
    joined = docs.join(given.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(of)) & F.col(source_col).eqNullSafe(F.col(origin)))
    # A row of size 0 may share its key with others; rows of one key differ in copies only then.
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(f"`{n}`" for n in docs.columns))
