"""Partial tables of batches against the tables of all packets."""

import os

import pytest
from pyspark.sql import functions as F

from netlens.decode import applications, layers
from netlens.operators import beacon, flows, messages
from netlens.reassembly import streams
from netlens.sources import capture, sample
from netlens.storage import materialize
from netlens.streaming import snapshots


def test_blocks_cover_all_batches_once():
    for n in range(0, 600):
        found = snapshots.blocks(n)
        covered = [k for level, first in found for k in range(first, first + snapshots.FANOUT**level)]
        assert covered == list(range(n))
        assert len(found) <= (snapshots.FANOUT - 1) * 4
        assert all(first % snapshots.FANOUT**level == 0 for level, first in found)


@pytest.fixture(scope="module")
def packets(spark, tmp_path_factory):
    """The made-up capture without most of its upload, and segments that come out of order over batches."""
    folder = tmp_path_factory.mktemp("captures")
    some = [f for k, f in enumerate(sample.frames()) if f[1] < 1000 or k % 40 == 0]
    request = b"GET /late HTTP/1.1\r\nHost: late.example\r\n\r\n"
    first = some[0][0]
    for at, offset, flags, data in ((0, 0, 2, b""), (1, 60_000, 24, b"far"), (2, 21, 24, request[20:]), (3, 1, 24, request[:20])):
        frame = sample.ethernet(sample.ipv4("192.168.1.5", "198.51.100.9", 6, sample.tcp(50100, 80, 7000 + offset, flags, data)))
        some.append((first + at * 400_000_000_000, len(frame), frame))
    some.sort(key=lambda f: f[0])
    (folder / "a.pcap").write_bytes(capture.pcap_header(1) + b"".join(capture.pcap_record(*f) for f in some))
    return materialize(layers.decode(capture.frames(capture.read_capture(spark, str(folder)))), "packets")


def rows(df, *columns):
    return sorted(map(repr, df.select(*(columns or sorted(df.columns))).collect()))


def test_merged_tables_equal_those_of_all_packets(spark, packets, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "FANOUT", 2)
    store = snapshots.Store(spark, str(tmp_path))
    errors = spark.createDataFrame([("f", 1, "e")], "file string, index bigint, error string")
    n, total = 7, packets.count()
    assert store.last_index(0) is None
    for k in range(n):
        part = packets.where(F.col("index").between(total * k // n + 1, total * (k + 1) // n))
        store.add(k, part, errors)
        if k in (3, 5):
            store.add(k, part, errors)  # a batch that is repeated
    assert store.last_index(n) == packets.agg(F.max("index")).first()[0]
    assert store.read("errors", n).count() == n
    left = {d for d in os.listdir(tmp_path / "flows" / "level=0")}
    assert left <= {"first=4", "first=5", "first=6"}, left  # merged blocks are gone
    assert rows(flows.flows_of_partials(store.read("flows", n))) == rows(flows.flows(packets))
    assert rows(flows.hosts_of_peers(store.read("peers", n))) == rows(flows.hosts(packets))
    assert rows(store.read("timeline", n)) == rows(flows.timeline(packets))
    assert rows(flows.ports_by_target(store.read("ports", n)), "src_ip", "dst_ip", "ports") == rows(flows.syn_ports(packets), "src_ip", "dst_ip", "ports")
    assert rows(messages.bindings_of_claims(store.read("claims", n))) == rows(messages.arp_bindings(packets))
    assert rows(store.read("totals", n).drop("last_index")) == rows(snapshots.all_counters(packets))
    assert rows(store.read("messages", n), "ord", "app", "src_ip") == rows(applications.messages(packets), "ord", "app", "src_ip")
    found = flows.flows(packets)
    assert rows(beacon.scores(store.read("arrivals", n), found)) == rows(beacon.scores(packets, found))
    kept = store.read("segments", n)
    assert kept.count() < packets.where("tcp is not null").count() / 2
    told = ("src_ip", "src_port", "index", "message")
    assert rows(streams.recover_streams(snapshots.as_segments(kept)).where("message is not null"), *told) == rows(
        streams.recover_streams(packets).where("message is not null"), *told
    )
    assert rows(streams.recover_datagrams(store.read("fragments", n))) == rows(streams.recover_datagrams(packets))


def test_a_batch_of_nothing(spark, packets, tmp_path):
    store = snapshots.Store(spark, str(tmp_path))
    none = packets.where("false")
    store.add(0, none, spark.createDataFrame([], "file string, index bigint, error string"))
    assert store.read("flows", 1).count() == 0 and store.last_index(1) is None
    store.add(1, packets, spark.createDataFrame([], "file string, index bigint, error string"))
    assert rows(flows.flows_of_partials(store.read("flows", 2))) == rows(flows.flows(packets))
