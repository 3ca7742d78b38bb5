from hypothesis import given, settings
from hypothesis import strategies as st

from netlens.decode import layers
from netlens.reassembly import streams
from netlens.reassembly.ranges import Ranges, merged
from netlens.sources import sample

REQUEST = b"GET /private HTTP/1.1\r\nHost: h\r\nAuthorization: Basic x\r\n\r\n"
PORTS = (50000, 80)


def fed(stream, pieces, base=1000):
    found = None
    for at, data in pieces:
        found = stream.push((base + at) % (1 << 32), 24, data, False, PORTS) or found
    return found


def test_split_request_is_recovered():
    for base in (1000, (1 << 32) - 10):
        s = streams.Stream()
        s.push((base - 1) % (1 << 32), 2, b"", False, PORTS)
        kind, m = fed(s, [(20, REQUEST[20:]), (0, REQUEST[:20])], base)
        assert kind == "http" and m["has_authorization"] and s.conflicts == 0


def test_first_writer_stays():
    s = streams.Stream()
    m = fed(s, [(0, REQUEST[:20]), (10, b"X" * 10), (20, REQUEST[20:])])
    assert m[1]["uri"] == "/private" and s.conflicts == 1


def test_end_of_stream_and_far_segments():
    s = streams.Stream()
    fed(s, [(0, REQUEST[:10])])
    assert s.push(1010, 17, REQUEST[10:], False, PORTS) is None and s.done
    t = streams.Stream()
    assert fed(t, [(0, b"a"), (streams.HEAD, b"b"), (1 << 20, b"c")]) is None and t.segments == 1


def test_earlier_segment_moves_the_base():
    s = streams.Stream()
    assert fed(s, [(20, REQUEST[20:]), (0, REQUEST[:20])])[1]["complete"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, len(REQUEST) - 1), min_size=1, max_size=6, unique=True), st.randoms())
def test_any_split_in_any_order(cuts, rng):
    edges = [0, *sorted(cuts), len(REQUEST)]
    pieces = [(a, REQUEST[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    rng.shuffle(pieces)
    s = streams.Stream()
    s.push(999, 2, b"", False, PORTS)
    assert fed(s, pieces)[1]["host"] == "h"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 20)), max_size=12))
def test_ranges(writes):
    got, plain = Ranges(), {}
    for n, (start, size) in enumerate(writes):
        piece = bytes([n + 1]) * size
        conflict = got.write(start, piece)
        assert conflict == any(start + k in plain for k in range(size))
        for k in range(size):
            plain.setdefault(start + k, n + 1)
    assert all(got.data[k] == v for k, v in plain.items())
    assert got.spans == merged([(k, k + 1) for k in plain])


def test_datagram():
    d = streams.Datagram()
    assert d.push(8, False, b"world") is None and d.push(0, True, b"hello wo") == b"hello wo" + b"world"
    assert d.push(0, True, b"late") is None
    assert streams.transport_payload(sample.udp(1, 2, b"xyz"), 17) == (1, 2, b"xyz")


def test_segments_near_any_opening_are_kept(spark):
    """Ports used again: the request follows the second of three openings, in the range of its opening and past it."""
    half = len(REQUEST) // 2
    for gap in (1, streams.CARRY, 3 * streams.CARRY):
        # The last one is far from its own opening, though near the first.
        sent = [
            (1, 1 << 20, 2, b""),
            (2, 1 << 24, 2, b""),
            (2 + gap, (1 << 24) + 1, 24, REQUEST[:half]),
            (3 + gap, (1 << 24) + 1 + half, 24, REQUEST[half:]),
            (4 + 2 * gap, 1 << 28, 2, b""),
            (5 + 2 * gap, (1 << 20) + 1, 24, b"old"),
        ]
        rows = [
            ("f", k, 1, len(d), len(d), 1, d)
            for k, seq, flags, data in sent
            for d in [sample.ethernet(sample.ipv4("10.0.0.1", "10.0.0.2", 6, sample.tcp(50000, 80, seq, flags, data)))]
        ]
        packets = layers.decode(
            spark.createDataFrame(
                rows,
                "file string, index long, ts_ns long, captured_len int, wire_len int, link_type int, data binary",
            )
        )
        assert sorted(r["index"] for r in streams.head_segments(packets).collect()) == [k for k, *_ in sent[:5]]
        assert [
            r.http.summary
            for r in streams.recovered_messages(streams.recover_streams(packets), 1).collect()
        ] == ["GET h/private"]


def test_on_spark(spark):
    frames = [
        sample.ethernet(sample.ipv4("10.0.0.1", "10.0.0.2", 6, sample.tcp(50000, 80, 1, 24, REQUEST[:30]))),
        sample.ethernet(sample.ipv4("10.0.0.1", "10.0.0.2", 6, sample.tcp(50000, 80, 31, 24, REQUEST[30:]))),
        sample.ethernet(sample.ipv4("10.0.0.1", "10.0.0.2", 6, sample.tcp(50000, 80, 1 + (1 << 24), 24, b"far"))),
    ]
    rows = [("f", k, 1, len(d), len(d), 1, d) for k, d in enumerate(frames, 1)]
    packets = layers.decode(
        spark.createDataFrame(
            rows,
            "file string, index long, ts_ns long, captured_len int, wire_len int, link_type int, data binary",
        )
    )
    assert streams.head_segments(packets).count() == 2
    recovered = streams.recover_streams(packets)
    assert [r.http.summary for r in streams.recovered_messages(recovered, 1).collect()] == ["GET h/private"]
    assert tuple(streams.stats(recovered).first()) == (1, 1, 0)


def test_dropped_segments_change_nothing(spark, monkeypatch):
    """Streams of random openings, ends and pieces of a request come out as if every segment had been taken."""
    import random

    from netlens.decode.applications import parse

    monkeypatch.setattr(streams, "CARRY", 7)
    r = random.Random(3)
    sent, index = [], 0
    for port in range(41000, 41060):
        base = r.choice([1000, (1 << 32) - 20])
        for _ in range(r.randint(2, 40)):
            index += r.randint(1, 3)
            kind, cut = r.random(), r.randrange(0, len(REQUEST), 15)
            flags, data = (24, REQUEST[cut : cut + r.choice([15, 30])])
            if kind < 0.35:
                flags, data, cut = 2, b"", -1
            elif kind < 0.45:
                flags, data = r.choice([4, 17, 6]), b""
            elif kind < 0.5:
                data = REQUEST
            sent.append((index, port, (base + cut) % (1 << 32), flags, data))
    rows = []
    for k, port, seq, flags, data in sent:
        d = sample.ethernet(sample.ipv4("10.0.0.1", "10.0.0.2", 6, sample.tcp(port, 80, seq, flags, data)))
        rows.append(("f", k, 1, len(d), len(d), 1, d))
    schema = "file string, index long, ts_ns long, captured_len int, wire_len int, link_type int, data binary"
    packets = layers.decode(spark.createDataFrame(rows, schema))
    found = {x.src_port: (x.message is not None, x["index"], x.conflicts, x.segments) for x in streams.recover_streams(packets).collect()}
    expected = {}
    for port in sorted({x[1] for x in sent}):
        s, at = streams.Stream(), -1
        for k, _, seq, flags, data in (x for x in sent if x[1] == port):
            own = parse(data, (port, 80), True)
            if s.push(seq, flags, data, bool(own and own[1]["complete"]), (port, 80)) and at < 0:
                at = k
        expected[port] = (at >= 0, at, s.conflicts, int(s.tracked))
    assert found == expected and any(x[0] for x in expected.values())
    assert streams.head_segments(packets).count() < len(sent)


def test_a_flow_of_openings_and_ends_leaves_few_segments(spark):
    rows = []
    for k in range(3000):
        d = sample.ethernet(sample.ipv4("10.0.0.1", "10.0.0.2", 6, sample.tcp(50000, 80, k, 2 if k % 3 else 4, b"")))
        rows.append(("f", k + 1, 1, len(d), len(d), 1, d))
    schema = "file string, index long, ts_ns long, captured_len int, wire_len int, link_type int, data binary"
    assert streams.head_segments(layers.decode(spark.createDataFrame(rows, schema))).count() <= 4


def pieces_of(spark, rows):
    """(index, ts_ns, identification, offset, more, payload) as fragmented packets."""
    return spark.createDataFrame(
        [("10.0.0.1", "10.0.0.2", b"\4\n\0\0\1", b"\4\n\0\0\2", 17, r[2], r[0], r[1], r[3], r[4], r[5], True) for r in rows],
        "src_ip string, dst_ip string, src_key binary, dst_key binary, ip_proto int, fragment_id bigint, index bigint, ts_ns bigint, "
        "fragment_offset int, more_fragments boolean, ip_payload binary, fragmented boolean",
    ).repartition(3)


def test_identifications_come_again(spark):
    datagram = [sample.udp(5000, 53, sample.dns(f"n{k}.example.org")) for k in range(3)]
    rows, second = [], 1_000_000_000
    for k, at in enumerate((0, 500, 530)):  # the third comes too soon to be a new one
        rows += [(10 * k + 1, at * second, 7, 0, True, datagram[k][:24]), (10 * k + 2, at * second + 5, 7, 24, False, datagram[k][24:])]
    rows.append((99, 0, 8, 8, True, b"alone"))
    packets = pieces_of(spark, rows)
    found = sorted((r.fragment_id, r["index"], r.message is not None, r.conflicts) for r in streams.recover_datagrams(packets).collect())
    assert found == [(7, 2, True, 0), (7, 12, True, 0), (8, -1, False, 0)]
    once = sorted((r.fragment_id, r["index"]) for r in streams.recover_datagrams(packets, None).collect())
    assert once == [(7, 2), (8, -1)]
    assert streams.recover_datagrams(packets.where("false")).count() == 0


def test_a_flood_of_copies_is_one_datagram(spark):
    whole = sample.udp(5000, 53, sample.dns("copies.example.org"))
    rows = [(k, k, 7, 0, True, whole[:24]) for k in range(20_000)] + [(20_000, 20_000, 7, 24, False, whole[24:])]
    found = streams.recover_datagrams(pieces_of(spark, rows)).collect()
    assert [(r["index"], r.conflicts) for r in found] == [(20_000, 0)]
