"""Mixing sources to target weights.

A source's documents form one stream of words, cut into blocks of ``BLOCK_WORDS`` words; what is left
at the stream's end is a shorter block. The mix is dealt out in shards of ``SHARD_SLOTS`` slots. Each
shard's counts by source are a multinomial draw: every slot draws its source with the probability of
the source's share of all slots. Added up over shards, draws miss a source's slots by about their square
root; the slots that a source draws beyond its own go, in order, to the sources that drew too few, so
totals meet the targets. A source's slots, in order of shards, go through its blocks in pseudorandom
permutations, one for each pass, so no block is taken twice before all are taken once; the shorter
block is each pass's last. The last slot takes only the words that are missing to the target. Slots
and blocks are joined by source and index.

Permutations are swap-or-not networks keyed by hashes: any index can be computed where it is
needed, for a domain of any size. A document's place in its stream comes from its id and size, not
from the file or task that it is read in, so reruns agree on a cluster of any size.

Positions in a source's stream come from sums by buckets of documents, and a source's ranks from sums by
groups of shards, so a source that holds a third of all rows is spread over many tasks. The driver and
the windows over sources hold one row for each source; there is a weight for each, so they are few.

Defined results: null or empty texts have size 0 and are taken 0 times; a source without words
has target 0. Null is a source of its own, last in order. Repeated rows are numbered when
written and count each by itself; those of equal id and size are next to each other in the stream,
in order of their numbers. An empty table gives an empty result. Other columns are not looked at.
"""

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netlens.llm.columns import SPACE, documents, let, unused_name, with_row_id, word_count
from netlens.storage import materialize

# Weights in turn, the share of all words that the mix has, and the most passes over a source.
WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MOST_PASSES = 2
BLOCK_WORDS = 64
SHARD_SLOTS = 1024
#: Documents in a bucket of a source's stream, about; shards in a group; shards drawn in a task, about.
BUCKET_ROWS = 1024
SHARD_GROUP = 1024
TASK_SHARDS = 32
#: Slots that are made in a task, about.
TASK_SLOTS = 1 << 15
MOST_PARTITIONS = 4096
ROUNDS = 12


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """The image of an index in [0, size) under the permutation that the key names."""

    def one_round(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), size) - x + size, size)
        return let(
            other,
            lambda o: F.when(F.xxhash64(*key, r, F.greatest(x, o)).bitwiseAND(F.lit(1).cast("long")) == 1, o).otherwise(x),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, one_round)


def plan_sources(sizes: DataFrame) -> DataFrame:
    """One row for each source: ``sidx`` (its place by code point), ``source_size``, ``target``, ``full`` (blocks of
    full length), ``blocks`` (all), ``slots``, ``cut`` (words of the last slot, 0 if it takes its whole block), ``buckets``."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = sums.withColumn("sidx", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).cast("long") - 1)
    weighed = ranked.withColumn(
        "weight",
        F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("sidx") % len(WEIGHTS)).cast("int")),
    ).withColumn("cap", MOST_PASSES * F.col("source_size"))
    # Sources fill up in order of cap by weight. One is full if the level that the rest would share reaches its cap.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sidx")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.lit(TOTAL) * F.sum("source_size").over(everything)
    leveled = weighed.select("*", (wanted - before).alias("left"), after.alias("rest"))
    full = leveled.withColumn("full", F.col("cap") * F.col("rest") <= F.col("weight") * F.col("left"))
    # The level of the first that is not full; it falls with each further one.
    level = F.max(F.when(~F.col("full"), F.col("left") / F.col("rest"))).over(Window.partitionBy())
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        F.least(F.col("weight") * level, F.col("cap").cast("double"))
    )
    targeted = full.withColumn("target", target)
    size = F.greatest(F.col("source_size"), F.lit(1).cast("long"))
    wanted = F.round("target").cast("long")
    blocked = targeted.withColumns({
        "full": F.floor(F.col("source_size") / BLOCK_WORDS),
        "blocks": F.ceil(F.col("source_size") / BLOCK_WORDS),
        "passes": F.floor(wanted / size),
        "rest": wanted % size,
    })
    slots = F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / BLOCK_WORDS)
    return blocked.select(
        "source",
        "sidx",
        "source_size",
        "target",
        "full",
        "blocks",
        slots.alias("slots"),
        (F.col("rest") % BLOCK_WORDS).alias("cut"),
        F.ceil(F.col("n_docs") / BUCKET_ROWS).alias("buckets"),
    )


def pieces(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """The blocks that each document's words fall in: ``row``, ``sidx``, ``index``, ``first`` and ``last`` (exclusive), words
    of the document, and ``at``, the place of the first in its block."""
    rows = sizes.where("size > 0").join(
        plan.select("source", "sidx", "buckets"),
        sizes["source"].eqNullSafe(plan["source"]),
    ).select(
        "row",
        "doc_id",
        "size",
        "sidx",
        F.pmod(F.xxhash64("doc_id", "size"), "buckets").alias("bucket"),
    )
    totals = rows.groupBy("sidx", "bucket").agg(F.sum("size").alias("total"))
    starts = totals.select(
        "sidx",
        "bucket",
        F.coalesce(
            F.sum("total").over(Window.partitionBy("sidx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("bucket_start"),
    )
    inside = F.coalesce(
        F.sum("size").over(
            Window.partitionBy("sidx", "bucket").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    placed = rows.withColumn("inside", inside).join(starts, ["sidx", "bucket"]).withColumn(
        "start",
        F.col("bucket_start") + F.col("inside"),
    )
    indexed = placed.withColumn(
        "index",
        F.explode(F.sequence(F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS))),
    )
    zero, begin = F.lit(0).cast("long"), F.col("index") * BLOCK_WORDS - F.col("start")
    return indexed.select(
        "row",
        "sidx",
        "index",
        F.greatest(zero, begin).alias("first"),
        F.least(F.col("size"), begin + BLOCK_WORDS).alias("last"),
        F.greatest(zero, -begin).alias("at"),
    )


def longs(values) -> Column:
    """A column of one array, the same in each row."""
    return F.lit(np.array(list(values), np.int64)) if len(values) else F.array().cast("array<bigint>")


def interval_at(point: Column, starts: list[int]) -> Column:
    """The place of the last of the rising ``starts`` that is not above the point, by halving."""
    table, count = longs(starts), len(starts)

    def further(low: Column, step: Column) -> Column:
        return let(low + step, lambda at: F.when((at < count) & (F.get(table, at) <= point), at).otherwise(low))

    return F.aggregate(F.array(*(F.lit(1 << k) for k in reversed(range(max(1, count.bit_length()))))), F.lit(0), further)


class Drawn(NamedTuple):
    """The written draws (``shard``, ``sidx``, ``count``) and, by source, the slots wanted and drawn."""

    counts: DataFrame
    wanted: list[int]
    drawn: list[int]


def running(values: list[int]) -> list[int]:
    """The sum of those before each."""
    return [0, *np.cumsum(values).tolist()][:-1] if values else []


def draw_shards(plan: DataFrame, seed: int = 0) -> Drawn:
    """Multinomial counts of sources for each shard."""
    wanted = [r.slots for r in plan.orderBy("sidx").select("slots").collect()]
    total = sum(wanted)
    shards = -(-total // SHARD_SLOTS)
    numbered = plan.sparkSession.range(
        0,
        shards,
        1,
        max(1, min(MOST_PARTITIONS, shards // TASK_SHARDS)),
    ).withColumnRenamed("id", "shard")
    last = F.least(F.lit(SHARD_SLOTS).cast("long"), F.lit(total) - F.col("shard") * SHARD_SLOTS) - 1
    starts = running(wanted)
    point = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "shard", i), F.lit(max(1, total)).cast("long"))
    sources = F.transform(
        F.sequence(F.lit(0).cast("long"), last),
        lambda i: let(point(i), lambda p: interval_at(p, starts).cast("long")),
    )
    counts = materialize(
        numbered.select("shard", F.explode(sources).alias("sidx")).groupBy("shard", "sidx").count(),
        "mixing-draws",
    )
    found = {r.sidx: r.n for r in counts.groupBy("sidx").agg(F.sum("count").alias("n")).collect()}
    return Drawn(counts, wanted, [found.get(k, 0) for k in range(len(wanted))])


def ranked(drawn: Drawn) -> DataFrame:
    """One row for each slot: ``shard``, ``place`` in it, ``sidx`` and ``rank`` of the source's slots, after those drawn
    beyond a source's own have gone to the sources that are short."""
    groups = drawn.counts.withColumn("group", F.floor(F.col("shard") / SHARD_GROUP))
    before = lambda keys, order, value: F.coalesce(
        F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    starts = groups.groupBy("sidx", "group").agg(F.sum("count").alias("all")).select(
        "sidx",
        "group",
        before(["sidx"], "group", "all").alias("start"),
    )
    # Sources by groups of 1024 shards: a thousandth of the draws.
    offsets = groups.withColumns(
        {
            "inside": before(["sidx", "group"], "shard", "count"),
            "in_shard": before(["shard"], "sidx", "count"),
            "in_all": F.sum("count").over(Window.partitionBy("shard")),
        }
    )
    each = offsets.join(starts, ["sidx", "group"]).withColumn("first", F.col("start") + F.col("inside"))
    # A fixed number of partitions: the counts are short, and adaptive execution would make all slots in one task.
    parts = max(1, min(MOST_PARTITIONS, sum(drawn.wanted) // TASK_SLOTS + 1))
    spread = each.repartition(parts, "sidx", "shard")
    slots = spread.withColumn("drawn_rank", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)))
    place = F.col("in_shard") + F.col("drawn_rank") - F.col("first")
    over = [max(0, d - w) for w, d in zip(drawn.wanted, drawn.drawn, strict=True)]
    short = [max(0, w - d) for w, d in zip(drawn.wanted, drawn.drawn, strict=True)]
    of = lambda values, k: F.get(longs(values), k)
    spare = of(running(over), F.col("sidx").cast("int")) + F.col("drawn_rank") - of(drawn.wanted, F.col("sidx").cast("int"))
    numbered = slots.select(
        "shard",
        permuted(place, F.col("in_all"), F.lit("place"), F.col("shard")).alias("place"),
        "sidx",
        "drawn_rank",
        F.when(F.col("drawn_rank") >= of(drawn.wanted, F.col("sidx").cast("int")), spare).alias("spare"),
    )
    given = numbered.withColumn("to", F.when(F.col("spare").isNotNull(), interval_at(F.col("spare"), running(short))))
    moved = of(drawn.drawn, F.col("to")) + F.col("spare") - of(running(short), F.col("to"))
    return given.select(
        "shard",
        "place",
        F.coalesce(F.col("to").cast("long"), "sidx").alias("sidx"),
        F.coalesce(moved, "drawn_rank").alias("rank"),
    )


def slots(plan: DataFrame, drawn: Drawn, seed: int = 0) -> DataFrame:
    """The mix: ``shard``, ``place`` in it, the block ``sidx``, ``index`` that fills it, and ``cut``, its words that the
    slot takes if not all (0 else). ``plan`` has a row for each source, which is sent to all tasks."""
    named = ranked(drawn).join(
        F.broadcast(plan.select("sidx", "full", "blocks", "slots", F.col("cut").alias("last_cut"))),
        "sidx",
    )
    step = F.col("rank") % F.col("blocks")
    index = F.when(
        step < F.col("full"),
        permuted(step, F.col("full"), F.lit(seed), F.col("sidx"), F.floor(F.col("rank") / F.col("blocks"))),
    ).otherwise(F.col("full"))
    return named.select(
        "shard",
        "place",
        "sidx",
        index.alias("index"),
        F.when(F.col("rank") == F.col("slots") - 1, F.col("last_cut")).otherwise(0).cast("long").alias("cut"),
    )


def taken_pieces(sizes: DataFrame, plan: DataFrame, drawn: Drawn, seed: int = 0) -> DataFrame:
    """The pieces whose blocks the mix takes: ``times`` whole, ``part`` of their words once more, and ``shard``, the first that has them."""
    blocks = slots(plan, drawn, seed).groupBy("sidx", "index").agg(
        F.count_if(F.col("cut") == 0).alias("times"),
        F.max("cut").alias("cut"),
        F.min("shard").alias("shard"),
    )
    # Estimates of exploded rows are far too low; without the hint this side would be broadcast.
    joined = pieces(sizes, plan).join(blocks.hint("merge"), ["sidx", "index"])
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("cut") - F.col("at"), F.col("last") - F.col("first")))
    return joined.withColumn("part", part).where("times > 0 or part > 0")


def sized(docs: DataFrame, row: Column, id_column: str, text_column: str, source_column: str) -> DataFrame:
    return docs.select(
        row.alias("row"),
        F.col(id_column).alias("doc_id"),
        F.col(source_column).alias("source"),
        word_count(F.col(text_column)).alias("size"),
    )


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    seed: int = 0,
) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` and ``first_shard`` (null if none is taken) of each document."""
    sizes = materialize(sized(docs, F.monotonically_increasing_id(), id_column, text_column, source_column), "mixing-sizes")
    plan = materialize(plan_sources(sizes), "mixing-plan")
    pieces_taken = taken_pieces(sizes, plan, draw_shards(plan, seed), seed)
    taken = pieces_taken.groupBy("row").agg(
        F.sum((F.col("last") - F.col("first")) * F.col("times") + F.col("part")).alias("taken"),
        F.min("shard").alias("first_shard"),
    )
    named = plan.select(F.col("source").alias("_source"), "source_size", "target")
    whole = sizes.join(named, F.col("source").eqNullSafe(F.col("_source"))).join(taken, "row", "left")
    return whole.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_shard")


def resample(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    seed: int = 0,
) -> DataFrame:
    """The documents as the mix takes them: their taken words in order, and once more those taken twice."""
    row, record = (unused_name(docs, n) for n in ("row", "record"))
    numbered = with_row_id(docs, row).select(row, F.struct(*docs.columns).alias(record))
    flat = numbered.select(
        F.col(row).alias("row"),
        F.col(f"{record}.`{id_column}`").alias("doc_id"),
        F.col(f"{record}.`{source_column}`").alias("source"),
        F.col(f"{record}.`{text_column}`").alias("text"),
    )
    sizes = materialize(sized(flat, F.col("row"), "doc_id", "text", "source"), "mixing-sizes")
    plan = materialize(plan_sources(sizes), "mixing-plan")
    taken = taken_pieces(sizes, plan, draw_shards(plan, seed), seed).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("first", "last", "times", "part"))).alias("pieces")
    )
    joined = numbered.join(taken.withColumnRenamed("row", row), row)
    text = F.col(f"{record}.`{text_column}`")

    def copies(tokens: Column) -> Column:
        def of(n: int) -> Column:
            length = lambda p: F.when(
                p["times"] >= n,
                p["last"] - p["first"],
            ).when(p["times"] == n - 1, p["part"]).otherwise(0)
            return F.array_join(
                F.flatten(F.transform("pieces", lambda p: F.slice(tokens, (p["first"] + 1).cast("int"), length(p).cast("int")))),
                "",
            )

        return F.array(*(of(n) for n in range(1, MOST_PASSES + 1)))

    tokens = F.regexp_extract_all(text, F.lit(SPACE.replace("[", "[^") + "+" + SPACE + "*"), F.lit(0))
    made = joined.select(record, F.explode(F.filter(let(tokens, copies), lambda t: t != "")).alias(row))
    fields = {text_column: F.col(row)} | (
        {"n_chars": F.length(row).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    )
    return made.select(*(fields.get(c, F.col(f"{record}.`{c}`")).alias(c) for c in docs.columns))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
