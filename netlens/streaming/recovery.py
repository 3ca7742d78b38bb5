"""Split messages put together while packets stream in, by keyed state with timers.

A flow's direction, or an IP identification, keeps what it has received and not yet used: the bytes as a
list of disjoint pieces, and a few numbers. The bytes go as soon as the message is whole, the stream ends or
its head is full; the numbers, which tell late segments that all is done, go when nothing has come for
``idle`` in the packets' time. Bytes that never made a message are counted where they are let go, so a
report can say what it hasn't seen. State is bounded by the keys of ``idle``, times a head or a datagram.

Results are those of ``netlens.reassembly`` over the same packets, but for keys that fall silent for longer
than ``idle`` and come again, which start anew. Within a micro-batch a key's rows are put in order of
index; a batch holds whole what one key sends in it while its stream isn't done, so bound the batches
(``maxFilesPerTrigger``).

The session needs ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB provider; ``use_rocksdb`` sets it.
"""

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from netlens.decode.applications import ENDPOINTS, message_row, parse
from netlens.functions.names import RST, SYN, TCP
from netlens.reassembly.ranges import Ranges
from netlens.reassembly.streams import FIN, FRAGMENT_KEY, Datagram, Stream, transport_payload

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE = "2 minutes"

#: What a result row tells: a message, a stream or datagram let go before it made one, or one that fell silent.
MESSAGE_FOUND, LET_GO, SILENT = "message", "let go", "silent"
RESULT = "kind string, index bigint, src_port int, dst_port int, message string, conflicts bigint, dropped_bytes bigint"
RESULT_NAMES = [x.split()[0] for x in RESULT.split(", ")]
PIECES = "start bigint, data binary"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class KeyedRecovery(StatefulProcessor):
    """What streams and datagrams share: state, timers, order, accounting."""

    numbers = ""  # schema of what is kept beside the pieces
    key_names: tuple[str, ...] = ()

    def __init__(self, idle: str):
        self.idle_ms = milliseconds(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("numbers", f"{self.numbers}, timer bigint")
        self.pieces = handle.getListState("pieces", PIECES)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.kept.get() if self.kept.exists() else None
        got = Ranges()
        if kept and self.pieces.exists():
            for start, data in self.pieces.get():
                got.write(start, bytes(data))
        held, out = self.restored(kept, got), []
        had_pieces = bool(got.spans)
        last = 0
        wanted = []
        for r in rows:
            last = max(last, r["ms"])
            if not held.done:
                wanted.append(r)
        for r in sorted(wanted, key=lambda r: r["index"]):
            was_done = held.done
            bytes_before = sum(b - a for a, b in held.got.spans)
            found = self.push(held, key, r)
            if found:
                out.append(self.row(key, MESSAGE_FOUND, r["index"], *found, held.conflicts, 0))
            elif held.done and not was_done and bytes_before:
                out.append(self.row(key, LET_GO, r["index"], None, None, None, held.conflicts, bytes_before))
        if held.done:
            if had_pieces:
                self.pieces.clear()
        elif held.got.spans:
            self.pieces.put([(a, bytes(held.got.data[a:b])) for a, b in held.got.spans])
        timer = max(last, timerValues.getCurrentWatermarkInMs(), (kept[-1] - self.idle_ms) if kept else 0) + self.idle_ms
        if not kept or kept[-1] != timer:
            if kept:
                self.handle.deleteTimer(kept[-1])
            self.handle.registerTimer(timer)
        self.kept.update((*self.saved(held), timer))
        yield from out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.kept.exists():
            return
        dropped = sum(len(data) for _, data in self.pieces.get()) if self.pieces.exists() else 0
        conflicts = self.conflicts_of(self.kept.get())
        self.pieces.clear()
        self.kept.clear()
        if dropped or conflicts:
            yield self.row(key, SILENT, -1, None, None, None, conflicts, dropped)

    def close(self) -> None:
        pass

    def row(self, key: tuple, *values) -> Row:
        return Row(*self.key_names, *RESULT_NAMES)(*key, *values)

    def restored(self, kept: tuple | None, got: Ranges):
        raise NotImplementedError

    def saved(self, held) -> tuple:
        raise NotImplementedError

    def conflicts_of(self, kept: tuple) -> int:
        raise NotImplementedError

    def push(self, held, key: tuple, r: Row) -> tuple | None:
        """Take a row; ports and message (JSON, or None) if something is whole."""
        raise NotImplementedError


class StreamState(KeyedRecovery):
    numbers = "tracked boolean, done boolean, by_syn boolean, base bigint, segments bigint, conflicts bigint"
    key_names = tuple(f"k_{c}" for c in ENDPOINTS)

    def restored(self, kept, got):
        stream = Stream()
        if kept:
            stream.tracked, stream.done, stream.by_syn, stream.base, stream.segments, stream.conflicts = kept[:6]
        stream.got = got
        return stream

    def saved(self, held):
        return held.tracked, held.done, held.by_syn, held.base, held.segments, held.conflicts

    def conflicts_of(self, kept):
        return kept[5]

    def push(self, held, key, r):
        payload = bytes(r["payload"] or b"")
        ports = (key[ENDPOINTS.index("src_port")], key[ENDPOINTS.index("dst_port")])
        own = parse(payload, ports, True)
        found = held.push(r["seq"], r["flags"], payload, bool(own and own[1]["complete"]), ports)
        return (*ports, json.dumps(message_row(found))) if found else None


class DatagramState(KeyedRecovery):
    numbers = "total bigint, done boolean, conflicts bigint, fragments bigint"
    key_names = tuple(f"k_{c}" for c in FRAGMENT_KEY)

    def restored(self, kept, got):
        datagram = Datagram()
        if kept:
            datagram.total, datagram.done, datagram.conflicts, datagram.fragments = kept[:4]
        datagram.got = got
        return datagram

    def saved(self, held):
        return held.total, held.done, held.conflicts, held.fragments

    def conflicts_of(self, kept):
        return kept[2]

    def push(self, held, key, r):
        whole = held.push(r["fragment_offset"], r["more_fragments"], bytes(r["ip_payload"] or b""))
        if whole is None:
            return None
        proto = key[FRAGMENT_KEY.index("ip_proto")]
        found = transport_payload(whole, proto)
        parsed = parse(found[2], found[:2], proto == TCP) if found else None
        return (*(found[:2] if found else (None, None)), json.dumps(message_row(parsed)) if parsed else None)


def milliseconds(interval: str) -> int:
    import pandas as pd

    return int(pd.Timedelta(interval).total_seconds() * 1000)


def _timed(packets: DataFrame, watermark: str) -> DataFrame:
    return packets.withWatermark("ts", watermark).withColumn("ms", F.unix_millis("ts"))


def _keyed(rows: DataFrame, key: tuple[str, ...], processor: KeyedRecovery) -> DataFrame:
    schema = T.StructType([*(T.StructField(f"k_{c}", rows.schema[c].dataType) for c in key), *T.StructType.fromDDL(RESULT).fields])
    found = rows.groupBy(*key).transformWithState(processor, schema, "Append", "EventTime")
    ports = [c for c in ("src_port", "dst_port") if c in key]
    return found.drop(*ports).withColumnsRenamed({f"k_{c}": c for c in key})


def stream_recovery(packets: DataFrame, idle: str = IDLE, watermark: str = "10 seconds") -> DataFrame:
    """Messages recovered from the segments of streaming packets, and what was let go, one row each.

    ``packets`` has ``ts`` (see ``continuous.with_time``). Segments later than ``watermark`` still count as long as
    their stream is kept.
    """
    ends = F.col("tcp.flags").bitwiseAND(F.lit(FIN | RST | SYN)) != 0
    tcp = _timed(packets, watermark).where(F.col("tcp").isNotNull() & ~F.col("fragmented") & (ends | F.col("payload").isNotNull()))
    rows = tcp.select("ts", "ms", "index", *ENDPOINTS, F.col("tcp.seq").alias("seq"), F.col("tcp.flags").alias("flags"), "payload")
    return _keyed(rows, ENDPOINTS, StreamState(idle))


def datagram_recovery(packets: DataFrame, idle: str = IDLE, watermark: str = "10 seconds") -> DataFrame:
    """Datagrams recovered from the fragments of streaming packets, and what was let go, one row each.

    An identification that comes again after ``idle`` is a new datagram's.
    """
    rows = _timed(packets, watermark).where("fragmented").select("ts", "ms", "index", *FRAGMENT_KEY, "fragment_offset", "more_fragments", "ip_payload")
    return _keyed(rows, FRAGMENT_KEY, DatagramState(idle))


def accounting(recovered: DataFrame) -> DataFrame:
    """One row over recovered rows: messages, keys let go or silent with bytes, and those bytes."""
    lost = (F.col("kind") != MESSAGE_FOUND) & (F.col("dropped_bytes") > 0)
    return recovered.agg(
        F.count_if(F.col("kind") == MESSAGE_FOUND).alias("recovered"),
        F.count_if(lost).alias("dropped"),
        F.coalesce(F.sum("dropped_bytes"), F.lit(0)).alias("dropped_bytes"),
    )


def state_figures(query: StreamingQuery) -> dict[str, int]:
    """Keys, bytes and late rows of a query's state at its last batch with progress."""
    last = query.lastProgress
    operators = last["stateOperators"] if last else []
    return {
        "keys": sum(o["numRowsTotal"] for o in operators),
        "bytes": sum(o["memoryUsedBytes"] for o in operators),
        "late_rows": sum(o["numRowsDroppedByWatermark"] for o in operators),
    }
