"""Reports that grow with the stream at a small cost: each micro-batch leaves partial tables, a report merges them.

A partial table holds what a stretch of batches tells in a form that merges: sums by flow, by pair of
hosts, by second; tried ports and hardware addresses made distinct; of a flow's arrivals those that periodicity
looks at; of its segments those near the head of a stream; messages without their packets. No packet is
kept, and a report's cost grows with flows, pairs of hosts and messages, not with packets.

Batch n writes a block of its own for each table. Whenever n + 1 is a multiple of FANOUT, the last FANOUT blocks are
merged into one of the next level, and so on, so at any time fewer than FANOUT blocks of each level cover all
batches, and which ones follows from n alone. A repeated batch writes the same blocks again; blocks that were
merged are deleted one batch later, so it still finds them.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.decode import applications, layers
from netlens.operators import beacon, flows, messages
from netlens.plans.analysis import Analysis, Settings, all_counters
from netlens.reassembly import streams
from netlens.sources import capture
from netlens.storage import delete, materialize, release

FANOUT = 8
ARRIVAL = ("index", "ts_ns", "src_key", "dst_key", "src_port", "dst_port", "ip_proto")
FRAGMENT = (*streams.FRAGMENT_KEY, "index", "ts_ns", "fragment_offset", "more_fragments", "ip_payload", "fragmented")


@dataclass(frozen=True)
class Table:
    """How a table comes from a batch's packets, and how its rows merge; both give the same columns."""

    make: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]


def totals_of(packets: DataFrame) -> DataFrame:
    return all_counters(packets).crossJoin(packets.agg(F.max("index").alias("last_index")))  # one row each


def merged_totals(partials: DataFrame) -> DataFrame:
    how = {"first_ns": F.min, "last_ns": F.max, "last_index": F.max}
    total: Callable[[str], Column] = lambda c: how[c](c) if c in how else F.coalesce(F.sum(c), F.lit(0))
    return partials.agg(*(total(c).alias(c) for c in partials.columns))


def added(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """Rows with equal keys become one with the sums of all else."""
    return lambda rows: rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in rows.columns if c not in keys))


def arrivals(packets: DataFrame) -> DataFrame:
    """The first packets of each flow's directions, and no more than the ranges that hold them."""
    return beacon.first_arrivals(flows.with_flow_key(packets.select(*ARRIVAL))).select(*ARRIVAL)


def as_segments(kept: DataFrame) -> DataFrame:
    """Kept segments as packets."""
    return kept.select("index", *applications.ENDPOINTS, F.struct("seq", "flags").alias("tcp"), F.lit(False).alias("fragmented"), "payload")


def same(rows: DataFrame) -> DataFrame:
    return rows


#: Segments are made with those of earlier batches at hand, so they are not in this list; errors come from the records.
TABLES = {
    "totals": Table(totals_of, merged_totals),
    "flows": Table(flows.flow_partials, flows.merged_partials),
    "peers": Table(flows.peer_totals, added("key", "peer")),
    "timeline": Table(flows.timeline, added("second")),
    "ports": Table(flows.tried_ports, DataFrame.distinct),
    "claims": Table(messages.arp_claims, DataFrame.distinct),
    "arrivals": Table(arrivals, arrivals),
    "fragments": Table(lambda p: p.where("fragmented").select(*FRAGMENT), same),
    "messages": Table(applications.messages, same),
}
MERGES = {**{k: t.merge for k, t in TABLES.items()}, "segments": lambda kept: streams.head_segments(as_segments(kept)), "errors": same}


def blocks(n: int) -> list[tuple[int, int]]:
    """(level, first batch) of the blocks that cover the batches before n, the largest first."""
    found, at, level = [], 0, 0
    while FANOUT ** (level + 1) <= n:
        level += 1
    while at < n:
        while FANOUT**level > n - at:
            level -= 1
        found.append((level, at))
        at += FANOUT**level
    return found


class Store:
    """Partial tables under a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, table: str, level: int, first: int) -> str:
        return f"{self.folder}/{table}/level={level}/first={first}"

    def read(self, table: str, n: int) -> DataFrame | None:
        """The merged rows of the batches before n; None if there are none."""
        paths = [self._path(table, *b) for b in blocks(n)]
        return MERGES[table](self.spark.read.parquet(*paths)) if paths else None

    def add(self, number: int, packets: DataFrame, errors: DataFrame) -> None:
        """Write the blocks that end with this batch. ``packets`` is read several times."""
        for name, table in TABLES.items():
            self._write(name, 0, number, table.make(packets))
        self._write("errors", 0, number, errors)
        before = self.read("segments", number)
        own = packets.select("index", *applications.ENDPOINTS, F.struct("tcp.seq", "tcp.flags").alias("tcp"), "fragmented", "payload").where(F.col("tcp.seq").isNotNull())
        seen = own if before is None else as_segments(before).unionByName(own)
        least = packets.agg(F.min("index")).first()[0]
        near = streams.head_segments(seen)
        self._write("segments", 0, number, near if least is None else near.where(F.col("index") >= least))
        level = 1
        while (number + 1) % FANOUT**level == 0:
            first, step = number + 1 - FANOUT**level, FANOUT ** (level - 1)
            for name, merge in MERGES.items():
                parts = [self._path(name, level - 1, first + k * step) for k in range(FANOUT)]
                self._write(name, level, first, merge(self.spark.read.parquet(*parts)))
            level += 1
        self._delete_merged_by(number - 1)

    def _write(self, table: str, level: int, first: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self._path(table, level, first))

    def _delete_merged_by(self, number: int) -> None:
        """Blocks that batch ``number`` merged into others."""
        level = 1
        while number >= 0 and (number + 1) % FANOUT**level == 0:
            first, step = number + 1 - FANOUT**level, FANOUT ** (level - 1)
            for name in MERGES:
                for k in range(FANOUT):
                    delete(self.spark, self._path(name, level - 1, first + k * step))
            level += 1

    def last_index(self, n: int) -> int | None:
        found = self.read("totals", n)
        return found.first()["last_index"] if found is not None else None


class MergedAnalysis(Analysis):
    """The analysis of the batches before n, from their partial tables."""

    def __init__(self, store: Store, n: int, settings: Settings | None = None, listed: DataFrame | None = None):
        tables = {name: store.read(name, n) for name in MERGES}
        self.errors, self.tables = tables["errors"], tables
        self.flow_packets = tables["arrivals"]
        self._derive(
            streams.recover_streams(as_segments(tables["segments"])),
            streams.recover_datagrams(tables["fragments"]),
            tables["messages"],
            flows.flows_of_partials(tables["flows"]),
            flows.hosts_of_peers(tables["peers"]),
            settings,
            listed,
        )

    def counters(self) -> DataFrame:
        return flows.summary(self.tables["totals"].drop("last_index"))

    def timeline(self) -> DataFrame:
        return self.tables["timeline"]

    def bindings(self) -> DataFrame:
        return messages.bindings_of_claims(self.tables["claims"])

    def scans(self) -> DataFrame:
        return flows.port_scans(flows.ports_by_target(self.tables["ports"]), self.settings.scan_ports)

    def written(self) -> list[DataFrame]:
        return [self.streams, self.datagrams, self.messages, self.flows, self.hosts, self.names]


def take_batch(store: Store, files: DataFrame, number: int, settings: Settings | None = None) -> None:
    """Decode a batch's capture files and write its partial tables."""
    last = store.last_index(number)
    base = 0 if last is None else (last // capture.FILE_SHIFT + 1) * capture.FILE_SHIFT
    found = materialize(capture.indexed(files, (settings or Settings()).legacy_link_type, base), "records")
    packets = materialize(layers.decode(capture.frames(found)), "packets")
    store.add(number, packets, capture.read_errors(found))
    release(packets)
    release(found)
