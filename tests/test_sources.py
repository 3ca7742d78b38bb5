import struct

import pytest
from pyspark.sql import functions as F

from netlens.functions import addresses
from netlens.operators import indicators
from netlens.sources import capture, intel, sample


def block(kind, body, order="<"):
    body += bytes(-len(body) % 4)
    return struct.pack(order + "2I", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def test_pcap_orders_and_units():
    big = struct.pack(">IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 101) + struct.pack(">4I", 5, 7, 3, 9) + b"abc"
    assert list(capture.records(big)) == [(5_000_007_000, 3, 9, 101, 0, b"abc")]
    own = capture.pcap_header(12) + capture.pcap_record(1_500_000_001, 2, b"abc")
    assert list(capture.records(own)) == [(1_500_000_001, 3, 3, 101, 0, b"abc")]
    assert list(capture.records(own[:-1])) == [] and list(capture.records(own + b"\0" * 9)) == list(capture.records(own))


def test_pcapng():
    section = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    nano = block(1, struct.pack("<HHI", 113, 0, 0) + struct.pack("<HHB3xHH", 9, 1, 9, 0, 0))
    binary = block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3xHH", 9, 1, 0x80 | 10, 0, 0))
    ticks = 3_000_000_005
    packets = block(
        6,
        struct.pack("<5I", 0, ticks >> 32, ticks & 0xFFFFFFFF, 3, 8) + b"abc",
    ) + block(6, struct.pack("<5I", 1, 0, 1536, 1, 1) + b"z") + block(3, struct.pack("<I", 6) + b"simple")
    found = list(capture.records(section + nano + binary + block(77, b"skip") + packets))
    assert found == [(ticks, 3, 8, 113, 0, b"abc"), (1_500_000_000, 1, 1, 1, 1, b"z"), (0, 8, 8, 113, 0, b"simple\0\0")]
    assert next(capture.records(section + nano + packets, True))[3] == 1


@pytest.mark.parametrize(
    "content",
    [
        b"",
        b"junk",
        capture.pcap_header(1)[:10],
        capture.pcap_header(1) + struct.pack("<4I", 0, 0, 1 << 20, 1),
        struct.pack("<2I", 0x0A0D0D0A, 28) + b"\x4d\x3c\x2b\x1a" + b"\xff" * 16 + b"\1\0\0\0\7\0\0\0\0\0\0\0",
    ],
)
def test_broken_files(content):
    with pytest.raises(capture.CaptureError):
        list(capture.records(content))


def test_round_trip_on_spark(spark, tmp_path):
    frames = sample.frames()[:200]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pcap").write_bytes(capture.pcap_header(1) + b"".join(capture.pcap_record(*f) for f in frames[:120]))
    (folder / "b.pcap").write_bytes(
        capture.pcap_header(1)
        + b"".join(capture.pcap_record(*f) for f in frames[120:])
        + struct.pack("<4I", 0, 0, 1 << 20, 1)
    )
    records = capture.read_capture(spark, str(folder))
    found = capture.frames(records)
    assert [(r.ts_ns, r.wire_len, bytes(r.data)) for r in found.orderBy("index").collect()] == frames
    assert [r.error for r in capture.read_errors(records).collect()] == [f"implausible record length {1 << 20}"]
    capture.write_capture(found, str(tmp_path / "out"), files=2)
    again = capture.frames(capture.read_capture(spark, str(tmp_path / "out")))
    assert [(r.ts_ns, bytes(r.data)) for r in again.orderBy("index").collect()] == [(t, d) for t, _, d in frames]
    assert spark.read.format("capture").load(str(folder / "a.pcap")).count() == 120


def test_lists_and_feeds(spark, tmp_path):
    (tmp_path / "list.txt").write_text(
        "# all\n10.0.0.0/8 # net\n1.2.3.4\r\nEvil.Example.\n2e3003a416b4edad56a32683dfb5bfe1\nbad one\n1.2.3.4/40\n::1\n"
    )
    found = {(r.kind, r.value) for r in intel.read_list(spark, str(tmp_path / "list.txt")).collect()}
    assert found == {
        ("cidr", "10.0.0.0/8"),
        ("ip", "1.2.3.4"),
        ("domain", "evil.example"),
        ("ja3", "2e3003a416b4edad56a32683dfb5bfe1"),
        ("ip", "::1"),
    }
    assert intel.list_warnings(spark, str(tmp_path / "list.txt")).count() == 2

    class Answer:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            return self.data[:n]

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

    pages = {
        "feodo": b"# c\n5.6.7.8\n\n",
        "sslbl": b"# x\r\n2e3003a416b4edad56a32683dfb5bfe1,2020,2021,Stack\r\n",
        "urlhaus": b'"1","d","http://user@Bad.Example:80/x?y","online","l","malware","emotet,doc","u","r"\n',
    }

    def opener(request, timeout):
        for name, data in pages.items():
            if request.full_url == intel.FEEDS[name]["url"]:
                return Answer(data)
        raise OSError("down")

    assert intel.update_cache(spark, str(tmp_path / "cache"), list(intel.FEEDS), opener=opener) == {}
    loaded = {(r.kind, r.value, r.source, r.tag) for r in intel.load_cache(spark, str(tmp_path / "cache")).collect()}
    assert loaded == {
        ("ip", "5.6.7.8", "feodo", "botnet-c2"),
        ("ja3", "2e3003a416b4edad56a32683dfb5bfe1", "sslbl", "Stack"),
        ("domain", "bad.example", "urlhaus", "malware"),
    } or ("domain", "bad.example", "urlhaus", "malware") in loaded
    pages.clear()
    assert set(
        intel.update_cache(spark, str(tmp_path / "cache"), ["feodo"], opener=opener)
    ) == {"feodo"} and len(intel.manifest(str(tmp_path / "cache"))) == 3
    assert intel.load_cache(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        intel.fetch("http://plain.example/")


def test_address_hits(spark):
    listed = indicators.classify(
        spark.createDataFrame(
            [
                ("10.0.0.0/8", "a", None, 0),
                ("10.0.0.0/25", "b", None, 1),
                ("10.0.0.5", "c", "t", 2),
                ("2001:db8::/32", "d", None, 3),
            ],
            "token string, source string, tag string, ord int",
        )
    )
    from pyspark.sql import functions as F

    hosts = spark.createDataFrame(
        [("10.0.0.127", 1), ("10.0.0.5", 2), ("11.0.0.1", 3), ("2001:db8::9", 4), ("2001:db9::9", 5)],
        "ip string, count long",
    ).withColumn("key", indicators.key_of_text(F.col("ip")))
    found = {r.observed: r.indicator for r in indicators.address_hits(hosts, listed).collect()}
    assert found == {"10.0.0.127": "10.0.0.0/8", "10.0.0.5": "10.0.0.5", "2001:db8::9": "2001:db8::/32"}


def test_large_files_are_read_in_stretches(spark, tmp_path, monkeypatch):
    """Files past the limit give the same records, whatever the stretches."""
    content = sample.capture_bytes()
    (tmp_path / "a.pcap").write_bytes(content)
    (tmp_path / "b.pcap").write_bytes(content[:5000])
    (tmp_path / "c.txt").write_bytes(b"no capture at all" * 10)
    rows = lambda: sorted(map(tuple, capture.read_capture(spark, str(tmp_path)).collect()), key=repr)
    whole = rows()
    monkeypatch.setattr(capture, "AT_ONCE", 1000)
    assert rows() == whole and len(whole) > 4000
    monkeypatch.setattr(capture, "STRETCH", 100)
    with capture.opened(f"file:{tmp_path}/a.pcap") as stretches:
        assert list(capture.records(stretches)) == list(capture.records(content))


def test_addresses_as_text(spark):
    """Keys become the text that Python writes for them."""
    import ipaddress
    import random

    r = random.Random(5)
    keys = [b"\4" + r.randbytes(4) for _ in range(20)] + [b"\4\0\0\0\0", b"\4\xff\xff\xff\xff"]
    sixes = [
        bytes(16),
        bytes(15) + b"\1",
        b"\0" * 10 + b"\xff\xff\1\2\3\4",
        bytes.fromhex("20010db8000000000001000000000001"),
        bytes.fromhex("20010db8000000010000000000000001"),
        bytes.fromhex("00010000000200000003000000040000"),
    ]
    sixes += [
        b"".join(r.choice([b"\0\0", b"\0\0", r.randbytes(2), b"\0" + r.randbytes(1)]) for _ in range(8))
        for _ in range(200)
    ]
    keys += [b"\6" + x for x in sixes]
    frame = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    found = {bytes(r.key): r.text for r in frame.select("key", addresses.text_of_key(F.col("key")).alias("text")).collect()}
    assert found == {k: str(ipaddress.ip_address(k[1:])) for k in keys}


def test_limit_reaches_over_files(spark, tmp_path):
    """The first records are counted over files in order, so a short file doesn't use the limit up."""
    from netlens.plans.analysis import Analysis

    frames = sample.frames()
    for name, some in (("a", frames[:5]), ("b", []), ("c", frames[5:10])):
        (tmp_path / f"{name}.pcap").write_bytes(capture.pcap_header(1) + b"".join(capture.pcap_record(*f) for f in some))
    found = capture.read_capture(spark, str(tmp_path))
    for limit in (1, 5, 8, 10, 50):
        kept = sorted(r["index"] for r in capture.first_records(found, limit).collect())
        assert kept == [*range(1, 6), *((2 << 40) + k for k in range(1, 6))][:limit]
    assert Analysis(found, limit=8).packets.count() == 8


def test_records_are_not_shuffled_for_their_place(spark, tmp_path):
    """Places meet the file rows before these are read: above the reader there is no exchange and no join."""
    (tmp_path / "a.pcap").write_bytes(sample.capture_bytes())
    plan = capture.read_capture(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("MapInArrow")
    assert "Exchange" not in above and "Join" not in above and "BroadcastHashJoin" in below


def test_many_files_are_joined_without_broadcast(spark, tmp_path, monkeypatch):
    for name in "abc":
        (tmp_path / f"{name}.pcap").write_bytes(sample.capture_bytes()[:4000])
    few = sorted(map(tuple, capture.read_capture(spark, str(tmp_path)).collect()), key=repr)
    monkeypatch.setattr(capture, "MOST_PLACES", 2)
    assert sorted(map(tuple, capture.read_capture(spark, str(tmp_path)).collect()), key=repr) == few


def test_streamed_records_are_ordered_over_files(spark, tmp_path):
    import os

    folder = tmp_path / "in"
    folder.mkdir()
    frames = sample.frames()
    for name, some, second in (("z", frames[:3], 1_700_000_000), ("a", frames[3:6], 1_700_000_009)):
        (folder / f"{name}.pcap").write_bytes(capture.pcap_header(1) + b"".join(capture.pcap_record(*f) for f in some))
        os.utime(folder / f"{name}.pcap", (second, second))
    got = []
    query = (
        capture.stream_captures(spark, str(folder))
        .writeStream.foreachBatch(lambda df, n: got.extend(df.collect()))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    ordered = [bytes(r.data) for r in sorted(got, key=lambda r: r["index"])]
    assert ordered == [f[2] for f in frames[:6]]


def test_search_gives_the_largest_flows_in_order(spark):
    from netlens.operators import flows

    rows = [(f"10.0.0.{k}:1 -> x", k % 7, None) for k in range(40)]
    found = flows.search(spark.createDataFrame(rows, "flow string, bytes long, service string").repartition(4), "10.0.", 5).collect()
    assert [(r.flow, r.bytes) for r in found] == sorted([(f, b) for f, b, _ in rows], key=lambda x: (-x[1], x[0]))[:5]


def odd_frames():
    """Frames whose payloads look like records, are zeros, or are empty."""
    inner = b"".join(capture.pcap_record(1_700_000_000_000_000_000 + k, 40, bytes(range(40))) for k in range(12))
    some = [bytes(1400), inner, inner[7:], b"", b"\xff" * 333, capture.pcap_header(1) + inner]
    return [(1_700_000_000_000_000_000 + k * 1_000_000, max(60, len(some[k % 6])), some[k % 6]) for k in range(240)]


@pytest.mark.parametrize("tail", [b"\0" * 9, struct.pack("<4I", 1, 1, 1 << 20, 1) + b"x" * 5000])
def test_split_files_give_what_one_reader_gives(spark, tmp_path, monkeypatch, tail):
    """Ranges of bytes of any size, some starting within payloads that look like records, some behind an error."""
    content = capture.pcap_header(1) + b"".join(capture.pcap_record(*f) for f in odd_frames()) + tail
    swapped = b"".join(struct.pack(">4I", t // 10**9, t % 10**9 // 1000, len(d), w) + d for t, w, d in odd_frames()[:60])
    (tmp_path / "a.pcap").write_bytes(content)
    (tmp_path / "b.pcap").write_bytes(struct.pack(">IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + swapped)
    (tmp_path / "c.pcap").write_bytes(b"not a capture" * 1000)
    rows = lambda: sorted(map(tuple, capture.read_capture(spark, str(tmp_path)).collect()), key=repr)
    whole = rows()
    monkeypatch.setattr(capture, "AT_ONCE", 1000)
    monkeypatch.setattr(capture, "RANGE", 4_999)
    assert rows() == whole


def test_ranges_are_read_apart(spark, tmp_path):
    """Plausible starts are found without the range before, so all ranges but odd ones are right at once."""
    frames = [(1_700_000_000_000_000_000 + k, 200 + k % 900, bytes(200 + k % 900)) for k in range(400)]
    (tmp_path / "a.pcap").write_bytes(capture.pcap_header(1) + b"".join(capture.pcap_record(*f) for f in frames))
    files = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("path", "0L as place", "length")
    found = sorted(map(tuple, capture.placed_ranges(files, 30_000).select("first", "before").collect()))
    assert len(found) > 4 and [n for _, n in found] == sorted(n for _, n in found) and found[0] == (24, 0)
    with capture.opened(str(tmp_path / "a.pcap")) as content:
        for start in range(30_000, 150_000, 30_000):
            assert capture._first_start(content, "<", 1, start, start + 30_000) in {at for at, _ in found}


def test_drops_are_noted(spark):
    from netlens.plans.analysis import Analysis

    made = Analysis.__new__(Analysis)
    assert made.drop_notes == ()
    made.note_drops(2, 0)
    assert len(made.drop_notes) == 1 and made.drop_notes[0].startswith("2 TCP")
