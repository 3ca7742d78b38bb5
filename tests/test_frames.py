"""Frames built from tables: evenly over the tasks, decoded once, with right checksums."""

import random

import pytest
from pyspark.sql import functions as F

from netlens.functions import wire
from netlens.plans import frames
from netlens.reassembly import streams


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of one small file each."""
    path = tmp_path_factory.mktemp("tables")
    for name, key in (("customer", "c_custkey"), ("part", "p_partkey")):
        spark.range(2000).select(F.col("id").alias(key)).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def spread(spark, built):
    counts = [r[1] for r in built.groupBy(F.spark_partition_id()).count().collect()]
    return len(counts), max(counts) / sum(counts)


def test_segments_of_one_file_are_built_by_all_tasks_and_decoded_once(spark, folder, monkeypatch):
    tasks, most = spread(spark, frames._split_requests(spark, folder))
    assert tasks > spark.sparkContext.defaultParallelism and most < 0.2
    decoded, decode = [], frames.layers.decode

    def counted(rows):
        seen = spark.sparkContext.accumulator(0)
        decoded.append(seen)
        out = decode(rows)

        def note(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return out.mapInArrow(note, out.schema)

    monkeypatch.setattr(frames.layers, "decode", counted)
    assert frames.recovered_streams(spark, folder).count() == 2000
    assert sum(x.value for x in decoded) == frames._split_requests(spark, folder).count()


def test_fragments_of_one_file_are_built_by_all_tasks(spark, folder):
    tasks, most = spread(spark, frames._split_datagrams(spark, folder))
    assert tasks > spark.sparkContext.defaultParallelism and most < 0.2


def test_segment_columns_are_all_that_recovery_reads(spark, folder):
    packets = frames.layers.decode(frames._split_requests(spark, folder).where("index < 3000"))
    whole, slim = (sorted(map(tuple, streams.recover_streams(p).collect()), key=repr) for p in (packets, streams.segment_columns(packets)))
    assert whole == slim and len(whole) == 300


def test_checksums(spark):
    rng = random.Random(5)
    rows = [b"\0\0", b"\xff\xff", b"\0" * 20, b"\xff" * 20, *(rng.randbytes(2 * rng.randint(1, 40)) for _ in range(300))]

    def plain(data):
        n = sum(int.from_bytes(data[k : k + 2], "big") for k in range(0, len(data), 2))
        while n >> 16:
            n = (n >> 16) + (n & 0xFFFF)
        return 0xFFFF - n

    found = spark.createDataFrame([(bytearray(r),) for r in rows], "d binary").select(wire.checksum(F.col("d"))).collect()
    assert [r[0] for r in found] == [plain(r) for r in rows]
