"""Periodicity of flows: median and median absolute deviation of the client's inter-arrival times."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.operators.flows import FLOW_KEY, with_flow_key

SAMPLES = 8192
SIDE = (*FLOW_KEY, "a_to_b")
#: Packets of a range of indexes in which busy flows are counted, as a power of two.
RANGE_BITS = 16
LEAST_TIMES, LEAST_DELTAS = 5, 4
#: Deltas at which the evidence starts and is full.
THIN, FULL = 4.0, 30.0
LEAST_PACKETS, MOST_JITTER, LEAST_INTERVAL, MOST_INTERVAL = 8, 0.20, 0.5, 86400.0


def first_arrivals(keyed: DataFrame) -> DataFrame:
    """The packets without most of those that lie past the first ``SAMPLES`` of a busy flow's direction.

    Counts by ranges of indexes tell which ranges hold the first ones, so that no task has to sort an elephant flow.
    Only busy flows get a bound, so the table that is joined is short.
    """
    counts = keyed.groupBy(*SIDE, F.shiftright("index", RANGE_BITS).alias("range")).count()
    side = Window.partitionBy(*SIDE)
    before = F.coalesce(F.sum("count").over(side.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumns({"before": before, "all": F.sum("count").over(side)}).where(
        (F.col("all") > SAMPLES)
        & (F.col("before") < SAMPLES)
    )
    bounds = placed.groupBy(*SIDE).agg(F.max("range").alias("last_range"))
    return keyed.join(bounds, list(SIDE), "left").where(
        F.col("last_range").isNull()
        | (F.shiftright("index", RANGE_BITS) <= F.col("last_range"))
    ).drop("last_range")


def middle(ordered: Column) -> Column:
    """The median of a sorted array."""
    n = F.size(ordered)
    return 0.5 * F.get(ordered, F.floor((n - 1) / 2).cast("int")) + 0.5 * F.get(ordered, F.floor(n / 2).cast("int"))


def scores(packets: DataFrame, found_flows: DataFrame) -> DataFrame:
    """Interval, jitter and confidence of each flow that has enough arrivals in the client's direction.

    Arrivals are in order of index; steps that are not forward in time are left out. The first
    8192 arrivals count. Packets are shuffled once, by flow and direction; a direction's steps, no more than
    8192, are then one sorted array, and flows are joined to what came of them.
    """
    order = Window.partitionBy(*SIDE).orderBy("index")
    keyed = first_arrivals(with_flow_key(packets).select(*SIDE, "index", "ts_ns"))
    steps = keyed.withColumns(
        {"n": F.row_number().over(order), "step_ns": F.col("ts_ns") - F.lag("ts_ns").over(order)}
    ).where(F.col("n") <= SAMPLES)
    sides = steps.groupBy(*SIDE).agg(
        F.count("*").alias("times"),
        F.sort_array(F.collect_list(F.when(F.col("step_ns") > 0, F.col("step_ns") / 1e9))).alias("deltas"),
        ((F.max_by("ts_ns", "n") - F.min_by("ts_ns", "n")) / 1e9).alias("total_seconds"),
    )
    enough = sides.where((F.col("times") >= LEAST_TIMES) & (F.size("deltas") >= LEAST_DELTAS)).withColumns(
        {"samples": F.size("deltas").cast("long"), "interval": middle(F.col("deltas"))}
    )
    spread = enough.withColumn(
        "away",
        F.sort_array(F.transform("deltas", lambda x: F.abs(x - F.col("interval")))),
    ).withColumn("mad", middle(F.col("away"))).drop("deltas", "away")
    clients = found_flows.select(
        *FLOW_KEY,
        F.col("client_a").alias("a_to_b"),
        "flow",
        "client_packets",
        "server_ip",
        "server_port",
    )
    scored = clients.join(spread, list(SIDE)).drop("a_to_b").withColumn(
        "jitter",
        F.least(F.col("mad") / F.col("interval"), F.lit(1.0)),
    )
    evidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("samples") - THIN) / (FULL - THIN)))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - F.col("jitter")) * (0.6 + 0.4 * evidence)))
    return scored.withColumns({"confidence": confidence, "samples_truncated": F.col("client_packets") > SAMPLES})


def gated(
    scored: DataFrame,
    least_packets: int = LEAST_PACKETS,
    most_jitter: float = MOST_JITTER,
    least: float = LEAST_INTERVAL,
    most: float = MOST_INTERVAL,
) -> DataFrame:
    """Beacons: scores that pass the thresholds, the surest first."""
    passes = (
        F.col("client_packets") >= least_packets
    ) & (F.col("jitter") <= most_jitter) & F.col("interval").between(least, most)
    return scored.where(passes).orderBy(F.desc("confidence"), "flow")
