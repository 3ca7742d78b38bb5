"""Distinct counts by sketches, whole, merged and as a stream, within their stated error."""

from pyspark.sql import functions as F

from netlens.functions.addresses import key_of_v4
from netlens.operators import flows
from netlens.sources import capture, sample
from netlens.streaming import continuous

ERROR = 5 * 1.04 / 2 ** (continuous.SKETCH_BITS / 2)


def packets(spark, n):
    """One host that probes n others, thrice each, and a quiet pair."""
    k = F.col("id")
    many = spark.range(3 * n).select(
        key_of_v4(F.lit(167772161)).alias("src_key"), key_of_v4(F.lit(184549376) + k % n).alias("dst_key"), (k % n % 1000).cast("int").alias("dst_port"), F.lit(2).alias("tcp_flags")
    )
    pair = spark.range(4).select(key_of_v4(F.lit(1)).alias("src_key"), key_of_v4(F.lit(2)).alias("dst_key"), F.lit(80).alias("dst_port"), F.lit(24).alias("tcp_flags"))
    nobody = spark.range(1).select(*(F.lit(None).cast("binary").alias(c) for c in ("src_key", "dst_key")), F.lit(None).cast("int").alias("dst_port"), F.lit(2).alias("tcp_flags"))
    return many.union(pair).union(nobody)


def test_estimates_are_within_the_stated_error(spark):
    n = 50_000
    found = {r.ip: r for r in continuous.host_spread(packets(spark, n)).where("ip in ('10.0.0.1', '0.0.0.1', '0.0.0.2', '11.0.0.5')").collect()}
    assert abs(found["10.0.0.1"].peers / n - 1) < ERROR and abs(found["10.0.0.1"].tried / n - 1) < ERROR
    assert [(found[ip].peers, found[ip].tried) for ip in ("0.0.0.1", "0.0.0.2", "11.0.0.5")] == [(1, 0), (1, 0), (1, 0)]


def test_merged_stretches_equal_the_whole(spark):
    whole = packets(spark, 3000)
    halves = [continuous.host_spread(whole.where(F.crc32("dst_key") % 2 == k)) for k in (0, 1)]
    merged = {(r.ip, r.peers, r.tried) for r in continuous.merged_spread(halves[0].union(halves[1])).collect() if r.ip == "10.0.0.1"}
    ((_, peers, tried),) = merged
    assert abs(peers / 3000 - 1) < ERROR and abs(tried / 3000 - 1) < ERROR
    assert continuous.host_spread(whole.where("false")).count() == 0


def test_a_stream_of_captures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pcap").write_bytes(sample.capture_bytes())
    got = []
    stream = continuous.packet_stream(spark, str(tmp_path / "in"))
    query = continuous.publish(continuous.host_spread(stream), str(tmp_path / "cp"), lambda df, n: got.append(df.select("ip", "peers").collect()), once=True)
    query.awaitTermination()
    from netlens.decode import layers

    exact = {r.ip: r.peers for r in flows.hosts(layers.decode(capture.frames(capture.read_capture(spark, str(tmp_path / "in"))))).collect()}
    assert {r.ip: r.peers for r in got[-1]} == exact  # sketches of few values are exact
