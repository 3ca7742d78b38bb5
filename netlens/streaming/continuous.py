"""Continuous analysis with Structured Streaming.

Captures that rotate into a folder are decoded as they come. The small aggregates run in complete
mode and are published as snapshots; flows carry their state by key. Times are never cut off by a
watermark unless one is asked for, so late packets count; a watermark bounds the state instead.
Whole reports, with findings, names and reassembly across batches, come from ``publish_reports``: packets
are decoded once and leave partial tables, and each report merges those. Split messages as they come, by
keyed state, are in ``recovery``.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netlens.decode import layers
from netlens.functions import names
from netlens.functions.addresses import text_of_key
from netlens.functions.text import whole_div
from netlens.operators.flows import FLOW_KEY, with_flow_key
from netlens.plans import report
from netlens.plans.analysis import Settings
from netlens.sources import capture
from netlens.streaming import snapshots

LEAST_REFRESH, MOST_REFRESH = 0.25, 60.0


def ends() -> list[Column]:
    """A flow's key with its addresses as text."""
    return [text_of_key(F.col(k)).alias(k.replace("_key", "_ip")) if k.endswith("_key") else F.col(k) for k in FLOW_KEY]


def packet_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded packets of captures as they appear, with ``ts`` for windows."""
    return with_time(layers.decode(capture.frames(capture.stream_captures(spark, folder))))


def with_time(packets: DataFrame) -> DataFrame:
    return packets.withColumn("ts", F.timestamp_micros(whole_div(F.col("ts_ns"), 1000)))


def timeline(packets: DataFrame, watermark: str | None = None) -> DataFrame:
    """Packets and bytes of each second."""
    timed = packets.where("ts_ns <> 0")
    timed = timed.withWatermark("ts", watermark) if watermark else timed
    return timed.groupBy(F.window("ts", "1 second")).agg(F.count("*").alias("packets"), F.sum("wire_len").alias("bytes")).select(
        F.unix_seconds("window.start").alias("second"),
        "packets",
        "bytes",
    )


def flow_totals(packets: DataFrame) -> DataFrame:
    """Packets, bytes and flags of each flow so far, for complete or update mode."""
    keyed = with_flow_key(packets)
    totals = keyed.groupBy(*FLOW_KEY).agg(
        F.count("*").alias("packets"),
        F.sum("wire_len").alias("bytes"),
        F.bit_or("tcp_flags").alias("flags"),
        F.min("ts_ns").alias("first_ns"),
        F.max("ts_ns").alias("last_ns"),
    )
    return totals.select(*ends(), "packets", "bytes", "flags", "first_ns", "last_ns")


def host_totals(packets: DataFrame) -> DataFrame:
    side = lambda ip, sent: F.struct(F.col(ip).alias("ip"), F.lit(sent).alias("sent"))
    both = packets.where(F.col("src_ip").isNotNull()).select(
        "wire_len",
        F.explode(F.array(side("src_ip", True), side("dst_ip", False))).alias("e"),
    )
    return both.groupBy("e.ip").agg(
        F.sum(F.when(F.col("e.sent"), F.col("wire_len")).otherwise(0)).alias("sent_bytes"),
        F.sum(F.when(F.col("e.sent"), 0).otherwise(F.col("wire_len"))).alias("received_bytes"),
    )


#: Registers of a distinct-count sketch, as a power of two: the standard error is about 1.04 / sqrt(2^n), here 1.6 %.
SKETCH_BITS = 12


def host_spread(packets: DataFrame) -> DataFrame:
    """About how many peers each host has met and how many (peer, port) pairs it has tried with bare SYNs, by sketches.

    A host's state is two sketches of at most 2^SKETCH_BITS bytes, however many peers it has. The batch tables
    (``operators.flows.hosts``, ``syn_ports``) count exactly. ``peers_sketch`` and ``tried_sketch`` merge with
    those of other stretches by ``merged_spread``.
    """
    tried = F.when(names.is_syn_only(F.col("tcp_flags")), F.concat("dst_key", F.lpad(F.hex("dst_port"), 4, "0").cast("binary")))
    side = lambda key, peer, port: F.struct(F.col(key).alias("key"), F.col(peer).alias("peer"), port.alias("tried"))
    ends = F.array(side("src_key", "dst_key", tried), side("dst_key", "src_key", F.lit(None).cast("binary")))
    both = packets.where(F.col("src_key").isNotNull() & F.col("dst_key").isNotNull()).select(F.inline(ends))
    sketches = both.groupBy("key").agg(
        F.hll_sketch_agg("peer", SKETCH_BITS).alias("peers_sketch"), F.hll_sketch_agg("tried", SKETCH_BITS).alias("tried_sketch")
    )
    return _estimated(sketches)


def merged_spread(stretches: DataFrame) -> DataFrame:
    """``host_spread`` of several stretches of packets together."""
    return _estimated(stretches.groupBy("key").agg(*(F.hll_union_agg(c).alias(c) for c in ("peers_sketch", "tried_sketch"))))


def _estimated(sketches: DataFrame) -> DataFrame:
    return sketches.select(
        text_of_key(F.col("key")).alias("ip"),
        "key",
        F.hll_sketch_estimate("peers_sketch").alias("peers"),
        F.hll_sketch_estimate("tried_sketch").alias("tried"),
        "peers_sketch",
        "tried_sketch",
    )


def flow_sessions(packets: DataFrame, gap: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Flows that end after a silence; an extension, as flows otherwise never end."""
    keyed = with_flow_key(packets).withWatermark("ts", watermark)
    return keyed.groupBy(*FLOW_KEY, F.session_window("ts", gap).alias("s")).agg(
        F.count("*").alias("packets"),
        F.sum("wire_len").alias("bytes"),
    ).select(
        *ends(),
        F.col("s.start").alias("start"),
        F.col("s.end").alias("end"),
        "packets",
        "bytes",
    )


HANDSHAKES = "src_ip string, dst_ip string, dst_port int, syns bigint, answered boolean"


def handshakes(packets: DataFrame, idle: str | None = None) -> DataFrame:
    """Whether a host's bare SYNs to a port were answered, by state that is kept for each triple.

    With ``idle``, say "10 minutes", a triple of which nothing came for that long in the packets' time is forgotten,
    which bounds the state; a later SYN starts its count again.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        syns, answered, last = state.get if state.exists else (0, False, 0)
        for pdf in batches:
            syns += int((pdf.answer == 0).sum())
            answered |= bool((pdf.answer == 1).any())
            last = max(last, int(pdf.ms.max()))
        state.update((syns, answered, last))
        if idle_ms:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame([(*key, syns, answered)], columns=["src_ip", "dst_ip", "dst_port", "syns", "answered"])

    timed = packets.withWatermark("ts", idle) if idle else packets
    flags = F.col("tcp_flags")
    back = F.coalesce(names.has(flags, names.SYN) & names.has(flags, names.ACK), F.lit(False))
    pick = lambda a, b: F.when(back, F.col(b)).otherwise(F.col(a))
    turned = timed.where(names.is_syn_only(flags) | back).select(
        "ts",
        pick("src_ip", "dst_ip").alias("src_ip"),
        pick("dst_ip", "src_ip").alias("dst_ip"),
        pick("dst_port", "src_port").alias("dst_port"),
        back.cast("int").alias("answer"),
        whole_div(F.col("ts_ns"), 1_000_000).alias("ms"),
    )
    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    state = "syns bigint, answered boolean, last bigint"
    return turned.groupBy("src_ip", "dst_ip", "dst_port").applyInPandasWithState(update, HANDSHAKES, state, "update", timeout)


def publish_reports(
    spark: SparkSession,
    folder: str,
    store: str,
    checkpoint: str,
    put: Callable[[dict, int], None],
    settings: Settings | None = None,
    listed: DataFrame | None = None,
    refresh: float = 2.0,
    once: bool = False,
) -> StreamingQuery:
    """Hand ``put`` the report of all captures in a folder with its generation, again whenever captures have come.

    Each batch leaves partial tables under ``store`` (see ``snapshots``), which a repeated batch replaces, so nothing
    counts twice; the report merges them. Streams and datagrams that reach over several files and batches are put
    together from the segments and fragments that are kept.
    """
    kept = snapshots.Store(spark, store)

    def take(files: DataFrame, number: int) -> None:
        snapshots.take_batch(kept, files, number, settings)
        analysis = snapshots.MergedAnalysis(kept, number + 1, settings, listed)
        put(report.build(analysis, folder), number)
        analysis.release()

    return publish(capture.stream_files(spark, folder), checkpoint, take, refresh, "append", once)


def publish(
    found: DataFrame,
    checkpoint: str,
    put: Callable[[DataFrame, int], None],
    refresh: float = 2.0,
    mode: str = "complete",
    once: bool = False,
) -> StreamingQuery:
    """Run an aggregate and hand each snapshot with its generation to ``put``."""
    writer = found.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put)
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{min(MOST_REFRESH, max(LEAST_REFRESH, refresh))} seconds").start()
