"""Split messages over micro-batches against the batch recovery of the same packets."""

import pytest

from netlens.decode import layers
from netlens.plans import frames
from netlens.reassembly import streams
from netlens.sources import capture, sample
from netlens.streaming import continuous, recovery

SECOND = 1_000_000_000
REQUEST = b"GET /x HTTP/1.1\r\nHost: split.example\r\n\r\n"


def file_of(rows):
    return capture.pcap_header(1) + b"".join(capture.pcap_record(int(at * SECOND), len(data), data) for at, data in rows)


def segment(offset, flags, payload=b"", port=50000):
    return sample.ethernet(sample.ipv4("10.0.0.1", "10.0.0.2", 6, sample.tcp(port, 80, 1000 + offset, flags, payload)))


def fragment(datagram, start, stop, more, ident=7):
    return sample.ethernet(sample.ipv4("10.0.0.1", "10.0.0.2", 17, datagram[start:stop], ident, start, more))


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    recovery.use_rocksdb(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, tmp_path, batches, make):
    """The rows of each micro-batch when each file comes as a batch of its own, and the query's last figures."""
    folder = tmp_path / "in"
    folder.mkdir()
    got, figures = [], {}
    for number, rows in enumerate(batches):
        (folder / f"{number}.pcap").write_bytes(file_of(rows))
        query = continuous.publish(
            make(continuous.packet_stream(spark, str(folder))),
            str(tmp_path / "checkpoint"),
            lambda found, n, at=number: got.extend((at, r) for r in found.collect()),
            mode="append",
            once=True,
        )
        query.awaitTermination()
        figures = recovery.state_figures(query)
    return got, figures


def test_messages_split_over_batches(rocks, tmp_path):
    datagram = sample.udp(5000, 53, sample.dns("parts.example.org"))
    batches = [
        [(1, segment(0, 2)), (1.1, segment(1, 24, REQUEST[:10])), (1.2, segment(500, 24, b"lost", 50001))],
        [(2, segment(11, 24, REQUEST[10:20])), (2.1, segment(11, 24, b"?" * 10)), (2.2, fragment(datagram, 24, 99, False))],
        [(3, segment(21, 24, REQUEST[20:])), (3.1, fragment(datagram, 0, 24, True))],
        [(4, segment(21, 24, REQUEST[20:])), (4.1, segment(504, 17, b"", 50001))],
        [(500, segment(0, 2, port=50002))],
        [(900, segment(0, 2, port=50003))],
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    found, figures = run(rocks, tmp_path / "a", batches, recovery.stream_recovery)
    told = sorted((r.src_port, r.kind, r.conflicts, r.dropped_bytes) for _, r in found)
    assert told == [(50000, "message", 1, 0), (50000, "silent", 1, 0), (50001, "let go", 0, 4)]
    assert [at for at, r in found if r.kind == "message"] == [2]
    assert "split.example" in next(r.message for _, r in found if r.kind == "message")
    assert figures["late_rows"] == 0
    datagrams, _ = run(rocks, tmp_path / "b", batches, recovery.datagram_recovery)
    assert [(at, r.kind, r.src_port, r.fragment_id) for at, r in datagrams] == [(2, "message", 5000, 7)]
    assert "parts.example.org" in datagrams[0][1].message


FOLDER = "/root/testdata/sf0.001"


def test_stream_equals_batch(rocks, tmp_path):
    """All split requests of the smallest tables, dealt over five files by their order of sending."""
    import os

    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    built = frames._split_requests(rocks, FOLDER).where("index < 600").union(frames._split_datagrams(rocks, FOLDER).where("index < 600"))
    rows = sorted(built.select("index", "data").collect(), key=lambda r: (r["index"] % 10, r["index"]))
    files = [[(k / 100, bytes(r.data)) for k, r in enumerate(rows) if r["index"] % 10 in places] for places in ((0, 1), (2,), (3, 4), (5,))]
    for n, (make, whole) in enumerate(((recovery.stream_recovery, streams.recover_streams), (recovery.datagram_recovery, streams.recover_datagrams))):
        (tmp_path / str(n)).mkdir()
        found, _ = run(rocks, tmp_path / str(n), files, make)
        packets = layers.decode(capture.frames(capture.indexed(rocks.read.format("binaryFile").load(str(tmp_path / str(n) / "in")))))
        expected = {(r.src_ip, r.message) for r in whole(packets).where("index >= 0").collect()}
        assert {(r.src_ip, r.message) for _, r in found if r.kind == "message"} == expected and len(expected) > 30


def test_accounting(spark):
    rows = [("message", 0), ("let go", 5), ("silent", 7), ("silent", 0)]
    found = recovery.accounting(spark.createDataFrame(rows, "kind string, dropped_bytes bigint")).first()
    assert tuple(found) == (1, 2, 12)
    assert tuple(recovery.accounting(spark.createDataFrame([], "kind string, dropped_bytes bigint")).first()) == (0, 0, 0)
    assert recovery.milliseconds("2 minutes") == 120_000
