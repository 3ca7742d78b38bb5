"""Captures: pcap and pcapng files to frames, and frames to pcap files.

Files are read through Spark's own ``binaryFile`` source, so any store that Spark reads will do,
in batches and as a stream. Rotated captures spread over tasks by file. Files of more than ``AT_ONCE`` bytes,
which that source would hold whole, are opened in the tasks and read in stretches, so a capture may have any
size; a pcap file of that size is split into ranges of bytes that many tasks read (``placed_ranges``). A ``capture`` data
source with the same reader, for local paths, and a writer can be registered for ``spark.read`` and
``df.write``.
"""

import os
import re
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StructField, StructType

from netlens.storage import materialize, release

# Magic numbers (byte order, nanoseconds per unit), block types and limits.
MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1000),
    b"\xa1\xb2\xc3\xd4": (">", 1000),
    b"\x4d\x3c\xb2\xa1": ("<", 1),
    b"\xa1\xb2\x3c\x4d": (">", 1),
}
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
ORDERS = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
MOST_CAPTURED, LEAST_BLOCK, MOST_BLOCK = 262_144, 12, 16 * 1024 * 1024
TSRESOL, MICROSECONDS = 9, 1_000_000
RECORDS_AT_ONCE = 4096
#: Bytes of a file that are taken whole, at most; bytes of a stretch of larger ones.
AT_ONCE, STRETCH = 128 << 20, 8 << 20
#: Bytes of a range of a large pcap file; headers in a row that make a record's start plausible; seconds they may lie apart.
RANGE, CHAIN, YEARS = 64 << 20, 8, 10 * 366 * 86_400
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
FILE_SHIFT = 1 << 40
#: Files whose places are broadcast, at most.
MOST_PLACES = 100_000
#: Indexes of streamed records: seconds from 2020 on, then so many bits for the number in the file.
FIRST_SECOND, NUMBER_BITS = 1_577_836_800, 33

SCHEMA = "file string, n bigint, ts_ns bigint, captured_len int, wire_len int, link_type int, iface_id int, data binary, error string"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


class CaptureError(ValueError):
    """What is wrong with a file; the frames before it are good."""


class Stretches:
    """An open file as bytes to slice from front to back, of which one stretch is held."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.size, self.start, self.held = file, size, 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop = part.start or 0, min(self.size, part.stop)
        if start < self.start or stop > self.start + len(self.held):
            self.file.seek(start)
            self.start, self.held = start, self.file.read(max(STRETCH, stop - start))
        return self.held[start - self.start : stop - self.start]


@contextmanager
def opened(path: str) -> Iterator[Stretches]:
    """A file of a mounted or remote store; ``path`` as Spark names it."""
    if path.startswith("file:") or "://" not in path:
        local = re.sub("^file:/*", "/", path)
        with open(local, "rb") as f:
            yield Stretches(f, os.path.getsize(local))
    else:
        store, inner = pa.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
        with store.open_input_file(inner) as f:
            yield Stretches(f, f.size())


def _numbers(layout: str, content: bytes | Stretches, at: int) -> tuple:
    return struct.unpack(layout, content[at : at + struct.calcsize(layout)])


def records(content: bytes | Stretches, legacy_link_type: bool = False) -> Iterator[tuple]:
    """(ts_ns, captured_len, wire_len, link_type, iface_id, data) of each frame. A cut-off last record ends the file; others are errors."""
    magic = bytes(content[:4])
    if magic in MAGICS:
        yield from _pcap(content, *MAGICS[magic])
    elif magic == SECTION.to_bytes(4, "big"):
        yield from _pcapng(content, legacy_link_type)
    else:
        raise CaptureError("unknown capture format")


def _pcap(content: bytes | Stretches, order: str, unit: int, at: int = 24, stop: int | None = None) -> Iterator[tuple]:
    """The records that start from ``at`` on and before ``stop``."""
    if len(content) < 24:
        raise CaptureError("file header is cut off")
    link = _numbers(order + "I", content, 20)[0]
    while at + 16 <= len(content) and (stop is None or at < stop):
        seconds, fraction, captured, wire = _numbers(order + "4I", content, at)
        if captured > MOST_CAPTURED:
            raise CaptureError(f"implausible record length {captured}")
        at += 16
        if at + captured > len(content):
            return
        yield seconds * 1_000_000_000 + fraction * unit, captured, max(wire, captured), link, 0, content[at : at + captured]
        at += captured


def _resolution(options: bytes, order: str) -> int:
    """Ticks per second of an interface."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "2H", options, at)
        if code == 0:
            break
        if code == TSRESOL and size >= 1 and at + 5 <= len(options):
            power = options[at + 4]
            if power & 0x80 and power & 0x7F <= 63:
                return 1 << (power & 0x7F)
            if power <= 18:
                return 10**power
        at += 4 + (size + 3) // 4 * 4
    return MICROSECONDS


def _pcapng(content: bytes | Stretches, legacy: bool) -> Iterator[tuple]:
    order, at, interfaces = "<", 0, []
    while at + 12 <= len(content):
        kind = _numbers(order + "I", content, at)[0]
        if content[at : at + 4] == SECTION.to_bytes(4, "big"):
            order, interfaces, kind = ORDERS.get(bytes(content[at + 8 : at + 12])), [], SECTION
            if order is None:
                raise CaptureError("section without byte order")
        size = _numbers(order + "I", content, at + 4)[0]
        if not LEAST_BLOCK <= size <= MOST_BLOCK or size % 4:
            raise CaptureError(f"implausible block length {size}")
        if at + size > len(content):
            return
        body = content[at + 8 : at + size - 4]
        at += size
        if kind == INTERFACE:
            if len(body) < 8:
                raise CaptureError("interface block is cut off")
            interfaces.append((struct.unpack_from(order + "H", body)[0], _resolution(body[8:], order)))
        elif kind == ENHANCED and len(body) >= 20:
            iface, high, low, captured, wire = struct.unpack_from(order + "5I", body)
            if captured > MOST_CAPTURED or 20 + captured > len(body):
                raise CaptureError(f"implausible record length {captured}")
            link, ticks = interfaces[iface] if iface < len(interfaces) else (1, MICROSECONDS)
            yield (
                high << 32
                | low
            ) * 1_000_000_000 // ticks, captured, max(wire, captured), 1 if legacy else link, iface, body[20 : 20 + captured]
        elif kind == SIMPLE and len(body) >= 4:
            wire, data = struct.unpack_from(order + "I", body)[0], body[4:]
            yield 0, len(data), max(wire, len(data)), 1 if legacy or not interfaces else interfaces[0][0], 0, data


def _batches(name: str, content: bytes | Stretches, legacy: bool, part: tuple[int, int, int] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of a file's records; of a pcap file's ``part`` those from a place on and up to another, numbered on from a number."""
    rows: list[tuple] = []
    n, error = part[2] if part else 0, None
    found = _pcap(content, *MAGICS[bytes(content[:4])], *part[:2]) if part else records(content, legacy)
    while True:
        try:
            record = next(found)
            n += 1
            rows.append((name, n, *record, None))
        except StopIteration:
            record = None
        except CaptureError as e:
            record, error = None, str(e)
            rows.append((name, n + 1, None, None, None, None, None, None, error))
        if rows and (record is None or len(rows) >= RECORDS_AT_ONCE):
            yield _batch(rows)
            rows = []
        if record is None:
            return


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
        COLUMNS,
    )


def _carrying(found: Iterator[pa.RecordBatch], names: list[str], values: list[pa.Scalar]) -> Iterator[pa.RecordBatch]:
    """Batches with further columns of one value each."""
    for batch in found:
        more = [pa.repeat(v, batch.num_rows) for v in values]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*COLUMNS, *names])


def records_of(files: DataFrame, legacy_link_type: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """Records of ``path`` and ``content`` rows, batch or streaming, with errors as rows of their own and the ``carried`` columns of their file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, *values in zip(*batch.columns, strict=True):
                yield from _carrying(_batches(path.as_py(), content.as_buffer().to_pybytes(), legacy_link_type), [*carried], values)

    return files.select("path", "content", *carried).mapInArrow(run, _schema(files, carried))


def records_of_large(files: DataFrame, legacy_link_type: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """Records of ``path`` rows, whose files the tasks open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, *values in zip(*batch.columns, strict=True):
                with opened(path.as_py()) as content:
                    yield from _carrying(_batches(path.as_py(), content, legacy_link_type), [*carried], values)

    return files.select("path", *carried).mapInArrow(run, _schema(files, carried))


def _schema(files: DataFrame, carried: tuple[str, ...]) -> StructType:
    return StructType([*StructType.fromDDL(SCHEMA).fields, *(files.schema[c] for c in carried)])


def _records(files: DataFrame, legacy_link_type: bool, carried: tuple[str, ...]) -> DataFrame:
    # The source checks the length before it reads a file.
    small, large = files.where(F.col("length") <= AT_ONCE), files.where(F.col("length") > AT_ONCE)
    return records_of(small, legacy_link_type, carried).unionByName(records_of_large(large, legacy_link_type, carried))


def _starts_chain(content: Stretches, order: str, most: int, at: int, second: int) -> bool:
    """Whether headers follow each other from here on, to the end of the file or CHAIN times; one header alone must end the file exactly."""
    for k in range(CHAIN):
        if at + 16 > len(content):
            return k > 1 or at == len(content)
        seconds, fraction, captured, wire = _numbers(order + "4I", content, at)
        if captured > MOST_CAPTURED or fraction >= most or not max(1, captured) <= wire or abs(seconds - second) > YEARS:
            return False
        at += 16 + captured
    return True


def _first_start(content: Stretches, order: str, unit: int, at: int, stop: int) -> int:
    """The first plausible start of a record from ``at`` on; ``stop`` if there is none before it."""
    second, most = _numbers(order + "I", content, 24)[0], 1_000_000_000 // unit
    while at < stop:
        window = np.frombuffer(content[at : min(at + STRETCH // 8, stop) + 15], np.uint8).astype(np.uint32)
        if len(window) < 16:
            return stop
        n = len(window) - 15
        octets = lambda k: [window[k + j : k + j + n] for j in range(4)]  # noqa: B023, E731
        number = lambda k: sum(x << np.uint32(8 * (j if order == "<" else 3 - j)) for j, x in enumerate(octets(k)))  # noqa: B023, E731
        may = np.flatnonzero((number(8) <= MOST_CAPTURED) & (number(4) < most) & (number(12) >= np.maximum(number(8), 1)))
        for k in may.tolist():
            if _starts_chain(content, order, most, at + k, second):
                return at + k
        at += n
    return stop


def _walk(content: Stretches, order: str, at: int, stop: int) -> tuple[int, int, bool]:
    """Where the first record from ``stop`` on starts, how many start before it, and whether the file ends there (cut off or in error)."""
    n = 0
    while at < stop:
        if at + 16 > len(content):
            return at, n, True
        captured = _numbers(order + "I", content, at + 8)[0]
        if captured > MOST_CAPTURED or at + 16 + captured > len(content):
            return at, n, True
        at, n = at + 16 + captured, n + 1
    return at, n, False


WALKED = "path string, place bigint, start bigint, stop bigint, first bigint, last bigint, records bigint, ends boolean, whole boolean"


def _walk_ranges(ranges: DataFrame) -> DataFrame:
    """What walking each range (path, place, start, stop, forced) tells; with ``forced`` a record is known to start there."""
    names = [x.split()[0] for x in WALKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                with opened(r["path"]) as content:
                    magic, at = bytes(content[:4]), r["forced"]
                    if magic not in MAGICS or len(content) < 40:  # other formats are the first range's work
                        made.append((r["path"], r["place"], r["start"], r["stop"], r["start"], r["stop"], 0, False, True))
                        continue
                    order, unit = MAGICS[magic]
                    if at is None:
                        at = 24 if r["start"] == 0 else _first_start(content, order, unit, r["start"], r["stop"])
                    last, n, ends = _walk(content, order, at, r["stop"])
                    made.append((r["path"], r["place"], r["start"], r["stop"], at, last, n, ends, False))
            kinds = [pa.string(), *[pa.int64()] * 6, pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names)

    tasks = max(1, ranges.sparkSession.sparkContext.defaultParallelism)
    return ranges.repartition(4 * tasks, "path", "start").mapInArrow(run, WALKED)


def placed_ranges(large: DataFrame, size: int | None = None) -> DataFrame:
    """Ranges of large files: path, place, first (where its first record starts), stop, before (records of the file before it), whole.

    Each range finds its first record by itself, as a chain of plausible headers, and walks to its end. Where the walk of the
    range before ends elsewhere, the range took other bytes for headers: it walks again from the right place, so what is
    read is exactly what one reader would read. Ranges behind the end of a cut-off or broken file are left out. Files that
    are no pcap are one range.
    """
    size = size or RANGE
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start")
    ranges = large.select("path", "place", "length", starts).select(
        "path", "place", "start", F.least(F.col("start") + size, "length").alias("stop"), F.lit(None).cast("long").alias("forced")
    )
    order = Window.partitionBy("path").orderBy("start")
    walked = materialize(_walk_ranges(ranges), "ranges")
    while True:
        before = F.lag("last").over(order)
        told = walked.withColumn("due", F.when(F.col("whole") | before.isNull(), F.col("first")).otherwise(F.greatest(before, "start")))
        # The first wrong range of a file is put right for certain, and most others, as walks soon fall in step.
        again = told.where("due <> first").select("path", "place", "start", "stop", F.col("due").alias("forced"))
        mended = materialize(_walk_ranges(again), "ranges")
        if mended.isEmpty():
            release(mended)
            break
        whole = materialize(walked.join(mended, ["path", "start"], "left_anti").select(*walked.columns).unionByName(mended), "ranges")
        release(walked)
        release(mended)
        walked = whole
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    counted = walked.withColumns(
        {
            "before": F.coalesce(F.sum("records").over(earlier), F.lit(0)),
            "over": F.coalesce(F.max("ends").over(earlier), F.lit(False)),
        }
    )
    return counted.where("not over and (not whole or start = 0)").select("path", "place", "first", "stop", "before", "whole")


def records_of_ranges(ranges: DataFrame, legacy_link_type: bool = False) -> DataFrame:
    """Records of ``placed_ranges``, numbered as in the whole file, with ``place``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["path"]) as content:
                    part = None if r["whole"] else (r["first"], r["stop"], r["before"])
                    yield from _carrying(_batches(r["path"], content, legacy_link_type, part), ["place"], [pa.scalar(r["place"], pa.int64())])

    tasks = max(1, ranges.sparkSession.sparkContext.defaultParallelism)
    spread = ranges.repartition(4 * tasks, "path", "first")
    # Ranges are few rows, so they are dealt out to more tasks than there are cores.
    return spread.mapInArrow(run, StructType([*StructType.fromDDL(SCHEMA).fields, StructField("place", LongType())]))


def indexed(files: DataFrame, legacy_link_type: bool = False, base: int = 0) -> DataFrame:
    """Records of ``binaryFile`` rows with ``index``: from ``base`` on, the number in the file, and the file's place by name in the high bits.

    The places meet the files' rows before these are read, so no record is shuffled. Up to MOST_PLACES of them are
    broadcast; more are joined as Spark sees fit, where every file is a key of its own.
    """
    places = files.select("path").withColumn("place", F.row_number().over(Window.orderBy("path")) - 1)
    few = files.select("path").limit(MOST_PLACES + 1).count() <= MOST_PLACES
    placed = files.join(F.broadcast(places) if few else places, "path").withColumn("place", F.col("place").cast("long"))
    # The source checks the length before it reads a file.
    found = records_of(placed.where(F.col("length") <= AT_ONCE), legacy_link_type, ("place",))
    large = placed.where(F.col("length") > AT_ONCE).select("path", "place", "length")
    if not large.isEmpty():
        found = found.unionByName(records_of_ranges(placed_ranges(large), legacy_link_type))
    return found.withColumn("index", base + F.col("place") * FILE_SHIFT + F.col("n")).drop("place", "n")


def first_records(found: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` records in order of files and places; the files' numbers of records are counted first."""
    place = F.call_function("div", F.col("index") - 1, F.lit(FILE_SHIFT))
    sizes = found.groupBy(place.alias("place")).agg(F.count("*").alias("n"))
    so_far = sizes.withColumn("upto", F.sum("n").over(Window.orderBy("place")))  # a row for each file
    last = so_far.where(F.col("upto") >= limit).orderBy("place").limit(1).first()
    return found if last is None else found.where(F.col("index") <= last.place * FILE_SHIFT + limit - (last.upto - last.n))


def read_capture(spark: SparkSession, path: str, legacy_link_type: bool = False) -> DataFrame:
    """All records under a path, with ``index`` (see ``indexed``)."""
    return indexed(spark.read.format("binaryFile").load(path), legacy_link_type)


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """Captures as they appear in a folder."""
    return spark.readStream.format("binaryFile").schema(BINARY_FILE).load(folder)


def stream_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Records of captures as they appear in a folder.

    ``index`` orders records by the second in which their file was last changed, then by their number in it, so it
    grows over rotated files; files of the same second interleave.
    """
    found = _records(stream_files(spark, folder), False, ("modificationTime",))
    second = F.unix_seconds("modificationTime") - FIRST_SECOND
    return found.withColumn("index", F.shiftleft(second, NUMBER_BITS) + F.col("n")).drop("modificationTime")


def frames(found: DataFrame) -> DataFrame:
    return found.where(F.col("error").isNull()).drop("error")


def read_errors(found: DataFrame) -> DataFrame:
    return found.where(F.col("error").isNotNull()).select("file", "index", "error")


def pcap_header(link_type: int) -> bytes:
    """Little-endian nanosecond pcap."""
    return struct.pack("<IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, MOST_CAPTURED, 101 if link_type in (12, 14) else link_type)


def pcap_record(ts_ns: int, wire_len: int, data: bytes) -> bytes:
    return struct.pack("<4I", ts_ns // 1_000_000_000 & 0xFFFFFFFF, ts_ns % 1_000_000_000, len(data), wire_len) + data


class CapturePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.legacy = options["path"], options.get("legacyLinkType", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            return [
                CapturePartition(os.path.join(self.path, f))
                for f in sorted(os.listdir(self.path))
                if not f.startswith((".", "_"))
            ]
        return [CapturePartition(self.path)]

    def read(self, partition: CapturePartition) -> Iterator[pa.RecordBatch]:
        with opened(partition.path) as content:
            yield from _batches(partition.path, content, self.legacy)


class CaptureMessage(WriterCommitMessage):
    def __init__(self, path: str, final: str):
        self.path, self.final = path, final


class CaptureWriter(DataSourceWriter):
    """One pcap file for each partition; files get their names when all are written."""

    def __init__(self, options: dict):
        self.path, self.link = options["path"], int(options.get("linkType", 1))

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        name = f"part-{TaskContext.get().partitionId():05d}.pcap"
        path = os.path.join(self.path, f".{name}-{TaskContext.get().taskAttemptId()}")
        with open(path, "wb") as f:
            f.write(pcap_header(self.link))
            for r in rows:
                f.write(pcap_record(r.ts_ns, r.wire_len, bytes(r.data)))
        return CaptureMessage(path, os.path.join(self.path, name))

    def commit(self, messages: list) -> None:
        for m in messages:
            os.replace(m.path, m.final)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class CaptureSource(DataSource):
    """``spark.read.format("capture")`` and ``df.write.format("capture")`` on paths that all machines share."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return CaptureReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return CaptureWriter(dict(self.options))


def write_capture(found: DataFrame, path: str, link_type: int = 1, files: int = 1) -> None:
    """Write frames in order of index to ``files`` pcap files that follow each other."""
    found.sparkSession.dataSource.register(CaptureSource)
    ordered = found.select("index", "ts_ns", "wire_len", "data").repartitionByRange(files, "index").sortWithinPartitions("index")
    ordered.write.format("capture").mode("append").option("linkType", str(link_type)).save(path)
