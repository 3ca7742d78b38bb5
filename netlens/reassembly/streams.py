"""Messages that are split over TCP segments or IP fragments.

Segments are dealt by flow and direction, fragments by datagram, sorted by key and index, and taken one by
one: a task holds one head or datagram at a time, however many segments or copies a key has. What
can't matter is left out before: segments past the head of a stream are dropped, so what one task sorts
of a stream is bounded by the head, not by the stream.
"""

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.decode.applications import ENDPOINTS, MESSAGE, message_row, parse, with_order
from netlens.functions.names import RST, SYN, TCP
from netlens.reassembly.ranges import MOST_RANGES, Ranges

HEAD = 16 * 1024
#: Packets' indexes over which one task carries a flow's latest opening along; the result does not depend on it.
CARRY = 1 << 16
MOST_DATAGRAM = 65_535
#: After a silence of so long an identification is a new datagram's; hosts give up an unfinished one sooner.
REUSED_AFTER_NS = 120 * 1_000_000_000
FIN, WRAP = 1, 1 << 32

RESULT = "index bigint, message string, conflicts bigint, segments bigint"


class Stream:
    """Head of one direction of a TCP connection: at most one message is recovered from it."""

    def __init__(self) -> None:
        self.tracked = self.done = self.by_syn = False
        self.base, self.segments, self.conflicts = 0, 0, 0
        self.got = Ranges()

    def push(self, seq: int, flags: int, payload: bytes, complete: bool, ports: tuple) -> tuple[str, dict] | None:
        """Take a segment; the message that it completes, if any. ``complete``: it holds a whole message itself."""
        if flags & (FIN | RST) or complete:
            self.done |= self.tracked
            return None
        if flags & SYN:
            if not self.done:
                self.tracked, self.by_syn, self.base = True, True, (seq + 1) % WRAP
                self.got, self.segments = Ranges(), 0
            return None
        if not payload:
            return None
        if not self.tracked:
            self.tracked, self.base = True, seq
        if self.done:
            return None
        before = (self.base - seq) % WRAP
        if not self.by_syn and 0 < before <= HEAD:
            self.got.shift(before)
            self.base = seq
        offset = (seq - self.base) % WRAP
        if offset >= HEAD:
            return None
        self.conflicts += self.got.write(offset, payload[: HEAD - offset])
        self.segments += 1
        if len(self.got.spans) > MOST_RANGES:
            self.done = True
            return None
        ready = self.got.contiguous()
        if self.segments < 2 or not ready:
            return None
        found = parse(bytes(self.got.data[:ready]), ports, True)
        if found and found[1]["complete"]:
            self.done = True
            return found
        self.done |= ready >= HEAD
        return None


class Datagram:
    """Fragments of one IP datagram."""

    def __init__(self) -> None:
        self.got, self.total, self.done, self.conflicts, self.fragments = Ranges(), 0, False, 0, 0

    def push(self, offset: int, more: bool, payload: bytes) -> bytes | None:
        """Take a fragment; the whole datagram when it is complete."""
        if offset >= MOST_DATAGRAM or self.done or not payload:
            return None
        piece = payload[: MOST_DATAGRAM - offset]
        self.conflicts += self.got.write(offset, piece)
        self.fragments += 1
        if not more and not self.total:
            self.total = offset + len(piece)
        if len(self.got.spans) > MOST_RANGES:
            self.done = True
            return None
        if 0 < self.total <= self.got.contiguous():
            self.done = True
            return bytes(self.got.data[: self.total])
        return None


def transport_payload(datagram: bytes, protocol: int) -> tuple[int, int, bytes] | None:
    """Ports and payload of a whole TCP or UDP datagram."""
    if protocol == TCP and len(datagram) >= 20 and (head := (datagram[12] >> 4) * 4) >= 20 and len(datagram) >= head:
        payload = datagram[head:]
    elif protocol == 17 and len(datagram) >= 8:
        length = int.from_bytes(datagram[4:6], "big")
        payload = datagram[8 : length if length >= 8 else None]
    else:
        return None
    return int.from_bytes(datagram[:2], "big"), int.from_bytes(datagram[2:4], "big"), payload


def segment_columns(packets: DataFrame) -> DataFrame:
    """What ``recover_streams`` reads of packets."""
    return packets.select("index", *ENDPOINTS, F.struct("tcp.seq", "tcp.flags").alias("tcp"), "fragmented", "payload").where("tcp.seq is not null")


def head_segments(packets: DataFrame) -> DataFrame:
    """Segments that can matter to the head of their stream.

    A segment counts if it ends or opens the stream, or lies within two heads, modulo 2^32, of the latest
    opening before it, or of the first segment if there is none. So an elephant flow reaches the grouping as
    no more than a head for each of its openings. The latest opening is carried along within a flow's range
    of ``CARRY`` indexes, and from range to range by one row for each, so no task sorts a whole flow.
    Of openings that follow each other those between the first and the last go, of ends those after the first,
    and all that comes after an end that follows an opening, as none of it changes the stream: a flow of
    openings and ends alone leaves a few segments for each range.
    """
    tcp = packets.where(F.col("tcp").isNotNull() & ~F.col("fragmented")).select(
        "index",
        *ENDPOINTS,
        F.col("tcp.seq").alias("seq"),
        F.col("tcp.flags").alias("flags"),
        "payload",
    )
    ranged = tcp.withColumn("_range", F.floor(F.col("index") / CARRY))
    is_opening = F.col("flags").bitwiseAND(F.lit(SYN)) != 0
    each = ranged.groupBy(*ENDPOINTS, "_range").agg(
        F.min_by("seq", "index").alias("_start"),
        F.max_by("seq", F.when(is_opening, F.col("index"))).alias("_syn"),
    )
    so_far = Window.partitionBy(*ENDPOINTS).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*ENDPOINTS).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = each.select(
        *ENDPOINTS,
        "_range",
        F.first("_start").over(so_far).alias("_first"),
        F.last("_syn", True).over(before).alias("_carried"),
    )
    near = lambda base: F.pmod(F.col("seq") - F.col(base) + HEAD, F.lit(WRAP)) <= 3 * HEAD
    ends = F.col("flags").bitwiseAND(F.lit(FIN | RST | SYN)) != 0
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*ENDPOINTS, "_range")]
    within = Window.partitionBy(*ENDPOINTS, "_range").orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = ranged.where(ends | F.col("payload").isNotNull()).withColumn(
        "_latest",
        F.last(F.when(is_opening, F.col("seq")), True).over(within),
    )
    order = Window.partitionBy(*ENDPOINTS, "_range").orderBy("index")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    is_end = F.col("flags").bitwiseAND(F.lit(FIN | RST)) != 0
    opens = is_opening & ~is_end
    latest = latest.withColumns(
        {
            "_opened": F.coalesce(F.max(opens).over(earlier), F.lit(False)),
            "_again": (opens & F.lag(opens, 1, False).over(order) & F.lead(opens, 1, False).over(order)) | (is_end & F.lag(is_end, 1, False).over(order)),
        }
    )
    latest = latest.withColumn("_over", F.coalesce(F.max(is_end & F.col("_opened")).over(earlier), F.lit(False))).where("not _over and not _again")
    joined = latest.alias("t").join(bases.alias("b"), same).withColumn("_base", F.coalesce("_latest", "_carried", "_first"))
    kept = joined.where(ends | near("_base"))
    return kept.select(*(F.col(f"t.{c}").alias(c) for c in tcp.columns))


def in_order(rows: DataFrame, key: tuple[str, ...], result: T.StructType, start: Callable[[tuple], "Recovery"]) -> DataFrame:
    """Each key's rows, in order of index, through a ``Recovery`` of its own; the key's columns and what it returns."""
    values = [c for c in rows.columns if c not in key]
    schema = T.StructType([*(rows.schema[c] for c in key), *result.fields])
    width = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        current, recovery = None, None
        for batch in batches:
            made: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:width] != current:
                    if recovery:
                        made += [current + x for x in recovery.end()]
                    current, recovery = row[:width], start(row[:width])
                made += [current + x for x in recovery.take(*row[width:])]
            yield table(made, arrow)
        if recovery:
            yield table([current + x for x in recovery.end()], arrow)

    def table(made: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
        columns = zip(*made, strict=True) if made else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    dealt = rows.select(*key, *values).repartition(*key).sortWithinPartitions(*key, "index")
    return dealt.mapInArrow(run, schema)


class Recovery:
    """What a key's rows come to; ``take`` and ``end`` return finished result rows."""

    def take(self, *row) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        raise NotImplementedError


class StreamRecovery(Recovery):
    """(index, message, conflicts, segments) of one direction of a flow."""

    def __init__(self, endpoints: tuple):
        self.ports = (endpoints[ENDPOINTS.index("src_port")], endpoints[ENDPOINTS.index("dst_port")])
        self.stream, self.message, self.at = Stream(), None, -1

    def take(self, index: int, seq: int, flags: int, payload: bytes | None) -> list[tuple]:
        own = parse(payload or b"", self.ports, True)
        found = self.stream.push(seq, flags, payload or b"", bool(own and own[1]["complete"]), self.ports)
        if found and self.message is None:
            self.message, self.at = json.dumps(message_row(found)), index
        return []

    def end(self) -> list[tuple]:
        return [(self.at, self.message, self.stream.conflicts, int(self.stream.tracked))]


def recover_streams(packets: DataFrame) -> DataFrame:
    """Per stream: the recovered message (JSON), the segment's index that completed it, and conflicts."""
    return in_order(head_segments(packets), ENDPOINTS, T._parse_datatype_string(RESULT), StreamRecovery)


FRAGMENT_KEY = ("src_ip", "dst_ip", "src_key", "dst_key", "ip_proto", "fragment_id")


class DatagramRecovery(Recovery):
    """(ports, index, message, conflicts, fragments) of each datagram of an identification."""

    def __init__(self, key: tuple, reused_after: int | None):
        self.proto, self.reused_after = key[FRAGMENT_KEY.index("ip_proto")], reused_after
        self._start()

    def _start(self) -> None:
        self.datagram, self.message, self.at, self.ports, self.last = Datagram(), None, -1, (None, None), None

    def take(self, index: int, ts_ns: int, offset: int, more: bool, payload: bytes | None) -> list[tuple]:
        done = []
        if self.reused_after is not None and self.last is not None and ts_ns - self.last > self.reused_after:
            done = self.end()
            self._start()
        self.last = max(ts_ns, self.last or ts_ns)
        whole = self.datagram.push(offset, more, payload or b"")
        if whole is not None:
            self.at = index
            found = transport_payload(whole, self.proto)
            if found:
                self.ports = found[:2]
                parsed = parse(found[2], self.ports, self.proto == TCP)
                self.message = json.dumps(message_row(parsed)) if parsed else None
        return done

    def end(self) -> list[tuple]:
        return [(*self.ports, self.at, self.message, self.datagram.conflicts, int(self.datagram.fragments > 0))]


def recover_datagrams(packets: DataFrame, reused_after: int | None = REUSED_AFTER_NS) -> DataFrame:
    """Per datagram: whether it is whole, its message (JSON) if it has one, its ports, and conflicts.

    Identifications have 16 bits and come again: after a silence of ``reused_after`` nanoseconds the same one
    begins another datagram, which is a row of its own; with None each identification is one datagram.
    """
    pieces = packets.where("fragmented").select(*FRAGMENT_KEY, "index", "ts_ns", "fragment_offset", "more_fragments", "ip_payload")
    schema = T._parse_datatype_string(f"src_port int, dst_port int, {RESULT}")
    return in_order(pieces, FRAGMENT_KEY, schema, lambda key: DatagramRecovery(key, reused_after))


def recovered_messages(recovered: DataFrame, origin: int) -> DataFrame:
    """Messages of recovered streams (origin 1) or datagrams (2), with the columns of ``applications.messages``."""
    there = recovered.where(F.col("message").isNotNull()).withColumn(
        "m",
        F.from_json("message", "struct<" + _colons(MESSAGE) + ">"),
    )
    return with_order(there.select("index", *ENDPOINTS, "m.*"), origin)


def _colons(columns: str) -> str:
    """A column list as the inside of a struct type."""
    return T._parse_datatype_string(columns).simpleString()[len("struct<") : -1]


def stats(recovered: DataFrame) -> DataFrame:
    """One row: keys tracked, messages or datagrams recovered, conflicts."""
    return recovered.agg(
        F.coalesce(F.sum("segments"), F.lit(0)).alias("tracked"),
        F.count_if(F.col("index") >= 0).alias("recovered"),
        F.coalesce(F.sum("conflicts"), F.lit(0)).alias("conflicts"),
    )
