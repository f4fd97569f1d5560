"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are put in shuffled order and read as one stream of tokens, cut into equal blocks. Slots of the
mix get golden-ratio points; a point falls into one source's share of the cumulative targets, and the r-th slot of a
source takes that source's r-th block, starting over after its last one. Every stretch of the mix is then close to the
target shares. All steps are DataFrame expressions; a source with most of the rows is ranked in chunks of bounded size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.session import stored

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCK_TOKENS = 2048
_CELLS_PER_SOURCE = 8
#: The golden ratio's fraction in 40 bits (odd, so all points differ), and the width by which slot numbers are split.
_BITS = 40
_STEP = int((5**0.5 - 1) / 2 * 2**_BITS) | 1
_HALF = 1 << 20


def word_count(text: Column) -> Column:
    """Runs of characters outside space and \\x09-\\x0D; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def chunk_count(rows: int) -> int:
    """Chunks to rank so many rows of one key in: with their root, both the chunks and the rows in each stay few."""
    return 1 + math.isqrt(rows) // 4


def running_total(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: str, name: str) -> DataFrame:
    """Exclusive running sum of a column per key, in the order of ``chunk`` and then ``order``.

    Chunks are summed first and totalled among themselves, so no task sorts more than one chunk of a key.
    """
    sums = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*keys, chunk, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(bases, [*keys, chunk]).withColumn(name, F.col("_base") + F.col("_inside")).drop("_base", "_inside")


@dataclass(frozen=True)
class Mix:
    """``sources``: per source its rank, size and target. ``units``: groups of equal rows with what the mix takes of
    them. ``placed``: the units' places in their sources' streams. ``slots``: the schedule, in order: position, source
    rank, epoch, block and the tokens taken from it."""

    sources: DataFrame
    units: DataFrame
    placed: DataFrame
    slots: DataFrame
    block: int


def targets(sizes: DataFrame, weights: tuple[float, ...], max_repeats: int) -> DataFrame:
    """Per source: its share of all sizes by weight, held to ``max_repeats`` times its own size.

    Excess is shared again by weight: in the order of size over weight, the sources are at their limit up to the first
    one that is not, and the rest share what is left. There is one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name))
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(pattern, (F.col("rank") - 1) % len(weights) + 1))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(float(max_repeats)))
    whole = Window.partitionBy(F.lit(0))
    earlier = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    upto, later = earlier.rowsBetween(Window.unboundedPreceding, -1), earlier.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / F.sum("weight").over(later)
    ranked = ranked.withColumn("_level", level)
    # The level from the first source below its limit on holds for all after it.
    fits = F.col("_level") * F.col("weight") <= F.col("limit")
    held = F.min(F.when(fits, F.struct(F.col("limit") / F.col("weight"), "rank", "_level"))).over(whole)
    shared = F.col("weight") * held["_level"]
    target = F.when(held.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), shared))
    return ranked.select("source", "rank", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """Slots of the mix: golden-ratio points mapped through the cumulative quotas, ranked per source.

    A quota is the number of blocks that hold a target, whole epochs first. In twice as many slots as there are quotas every source reaches its own
    (the gaps between golden-ratio points are below 1.9 over their number); later slots of a source are left out, and
    its last block is taken as far as the target needs.
    """
    spark = sources.sparkSession
    goal = F.round("target").cast("long")
    whole = F.floor(goal / F.col("source_size"))
    quota = whole * F.ceil(F.col("source_size") / block) + F.ceil((goal - whole * F.col("source_size")) / block)
    quotas = sources.filter(goal > 0).withColumn("quota", quota)
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    quotas = quotas.withColumn("_high", F.sum("quota").over(upto))
    quotas = quotas.withColumn("_low", F.col("_high") - F.col("quota"))
    total = quotas.agg(F.sum("quota").alias("n"), F.count("*").alias("k")).first()
    slots, count = int(total["n"] or 0), int(total["k"])
    cells = max(1, count * _CELLS_PER_SOURCE)
    by_cell = quotas.select(
        "rank", "source_size", "target", "quota", "_low", "_high",
        F.explode(F.sequence(
            F.floor(F.col("_low") * cells / max(slots, 1)).cast("long"),
            F.floor((F.col("_high") - 1) * cells / max(slots, 1)).cast("long") + 1,
        )).alias("_cell"),
    )
    scale = 1 << _BITS
    far = _STEP * _HALF % scale
    number = F.col("id")
    point = ((number % _HALF) * _STEP + (F.floor(number / _HALF) * far) % scale) % scale
    points = spark.range(2 * slots + 2).select("id", F.floor(point.cast("double") / scale * slots).cast("long").alias("_at"))
    points = points.withColumn("_cell", F.floor(F.col("_at") * cells / max(slots, 1)).cast("long"))
    hit = points.join(by_cell, "_cell").filter((F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_high")))
    hit = hit.select("id", "rank", "source_size", "target", "quota", F.floor(F.col("id") / math.ceil((2 * slots + 2) / chunk_count(slots))).alias("_chunk"), F.lit(1).alias("_one"))
    ranked = running_total(hit, ["rank"], "_chunk", ["id"], "_one", "turn").filter(F.col("turn") < F.col("quota"))
    blocks = F.ceil(F.col("source_size") / block)
    ranked = ranked.withColumn("block", F.col("turn") % blocks).withColumn("epoch", F.floor(F.col("turn") / blocks))
    size = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    # What the slots of a source before this one have taken: whole epochs, then whole blocks.
    before = F.col("epoch") * F.col("source_size") + F.col("block") * block
    return ranked.select(
        F.col("id").alias("position"), "rank", "epoch", "block",
        F.greatest(F.lit(0), F.least(size, F.round("target").cast("long") - before)).alias("taken"),
    )


def mix(
    rows: DataFrame,
    size: Column,
    id_column: str = "doc_id",
    source_column: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    block: int = BLOCK_TOKENS,
    seed: int = 7,
) -> Mix:
    """Mix rows of a size into their sources' targets.

    Equal rows (same id, source and size) form one unit. A null source is a source of its own, the last one. A row
    without tokens is never taken. Reruns give the same mix; it does not depend on partitions.
    """
    spark = rows.sparkSession
    units = rows.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), size.alias("size"))
    units = stored(units.groupBy("id", "source", "size").agg(F.count("*").alias("copies")), "mix-units")
    units = units.withColumn("tokens", F.col("size") * F.col("copies"))
    sizes = units.groupBy("source").agg(F.sum("tokens").alias("source_size"), F.count("*").alias("n"))
    chunks = chunk_count(int(sizes.agg(F.max("n")).first()[0] or 0))
    sources = stored(targets(sizes.drop("n"), weights, max_repeats), "mix-sources")

    draw = F.xxhash64(F.lit(seed), "id", "size")
    placed = units.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.drop("_source").withColumn("_draw", draw).withColumn("_chunk", F.pmod("_draw", F.lit(chunks)))
    placed = running_total(placed, ["rank"], "_chunk", ["_draw", "id", "size"], "tokens", "start")

    slots = stored(schedule(sources, block), "mix-slots")
    used = slots.groupBy("rank", "block").agg(F.sum("taken").alias("_all"), F.count("*").alias("_uses"), F.max("taken").alias("_full"), F.min("taken").alias("_least"))
    spread = placed.withColumn(
        "_block",
        F.explode(F.when(F.col("tokens") > 0, F.sequence(
            F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("tokens") - 1) / block)
        )).otherwise(F.array(F.lit(-1).cast("long")))),
    )
    low = F.greatest(F.col("start") - F.col("_block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("tokens") - F.col("_block") * block, F.lit(block))
    # All uses of a block but the last take it whole; the last may stop before or within the row.
    last = F.greatest(F.lit(0), F.least(high, F.col("_least")) - low)
    part = F.coalesce((F.col("_uses") - 1) * (high - low) + last, F.lit(0))
    met = spread.join(used.withColumnRenamed("block", "_block"), ["rank", "_block"], "left")
    met = met.groupBy("id", "source", "rank", "size", "copies", "source_size", "target").agg(F.sum(part).alias("taken"))
    return Mix(sources, met, placed, slots, block)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Per document: size, its source's size and target, and the words the mix takes of it."""
    found = mix(docs, word_count(F.col("text"))).units
    # Equal rows share what their unit takes as evenly as whole words allow.
    each = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    rest = (F.col("_copy") <= F.col("taken") % F.col("copies")).cast("long")
    return each.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.floor(F.col("taken") / F.col("copies")) + rest).cast("long").alias("taken"),
    )


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The documents in the order of the mix, with all their columns, whatever their names: each as often as the mix takes
    its first word. An empty table stays empty.

    Documents without words are left out, as the mix takes nothing of them. Of rows with equal id, source and size each
    is taken as the copy it happens to be. Rows are range-partitioned and sorted by their place in the mix.
    """
    made = mix(docs, word_count(F.col("text")))
    rows = made.placed.filter("tokens > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    rows = rows.withColumn("_at", F.col("start") + (F.col("_copy") - 1) * F.col("size"))
    rows = rows.withColumn("block", F.floor(F.col("_at") / made.block)).drop("_block")
    met = rows.join(made.slots, ["rank", "block"]).filter(F.col("taken") > F.col("_at") - F.col("block") * made.block)
    taken = met.select(
        F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"),
        F.col("_copy").alias("__copy"), "copies", F.col("position").alias("__position"),
    )
    taken = stored(taken, "mix-taken")
    key = ["__id", "__source", "__size"]
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"),
        F.col("doc_id").alias("_id_"), F.col("source").alias("_source_"), word_count(F.col("text")).alias("_size_"),
    )
    same = F.col("_id_").eqNullSafe(F.col("__id")) & F.col("_source_").eqNullSafe(F.col("__source")) & (F.col("_size_") == F.col("__size"))
    single = keyed.join(taken.filter("copies = 1"), same)
    repeated = stored(taken.filter("copies > 1"), "mix-repeated")
    turn = F.row_number().over(Window.partitionBy("_id_", "_source_", "_size_").orderBy("_size_"))
    numbered = keyed.join(repeated.select(*key).distinct(), same, "left_semi").withColumn("_turn_", turn)
    again = numbered.join(repeated, same & (F.col("_turn_") == F.col("__copy"))).drop("_turn_")
    mixed = single.union(again).select("whole", "__position")
    return mixed.repartitionByRange("__position").sortWithinPartitions("__position").select("whole.*")
