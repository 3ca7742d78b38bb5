"""Frames to packets and payloads to messages."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from netlens.decode import applications, layers
from netlens.sources import sample

FRAME = "file string, index long, ts_ns long, captured_len int, wire_len int, link_type int, data binary"


def decoded(spark, *frames):
    rows = [("f", k, 1, len(d), len(d), link, d) for k, (link, d) in enumerate(frames, 1)]
    return layers.decode(spark.createDataFrame(rows, FRAME)).orderBy("index").collect()


def test_layers(spark):
    tagged = bytes(12) + bytes.fromhex("8100a00188a80fff0800") + sample.ipv4(
        "1.2.3.255",
        "255.0.0.1",
        6,
        sample.tcp(1, 65535, 4294967295, 18) + b"hi",
    )
    options = b"\0\1\0\2" + bytes(8) + bytes([0x80, 2]) + bytes(6) + bytes([2, 4, 5, 180, 1, 3, 3, 7, 4, 2, 8, 0])
    fragment = bytes([44, 0]) + bytes(6) + bytes([17, 0, 0, 1, 0, 0, 0, 9]) + sample.udp(7, 8, b"x")
    rows = decoded(
        spark,
        (1, tagged),
        (1, b"\0" * 13),
        (101, sample.ipv6("fe80::1", "2001:db8:0:0:1:0:0:1", 0, fragment)),
        (1, sample.ethernet(sample.ipv4("1.1.1.1", "2.2.2.2", 6, options))),
        (0, b"\x02\0\0\0" + sample.ipv4("9.9.9.9", "8.8.8.8", 1, b"\x08\0\0\0\0\5\0\6zz")),
        (9, b"x"),
        (1, sample.ethernet(sample.arp(2, "02:00:00:00:00:0a", "10.0.0.1", "10.0.0.2"), 0x0806)),
        (113, bytes(14) + b"\x08\0" + sample.ipv4("1.1.1.1", "2.2.2.2", 17, sample.udp(5, 6, b"abc"))),
        (1, sample.ethernet(sample.ipv4("1.1.1.1", "2.2.2.2", 17, b"abcd", 5, 16, False))),
    )
    a, b, c, d, e, f, g, h, i = rows
    assert [(v.tpid, v.priority, v.dei, v.vid) for v in a.eth.vlans] == [(0x8100, 5, False, 1), (0x88A8, 0, False, 0xFFF)]
    assert (
        a.src_ip,
        a.dst_ip,
        a.src_port,
        a.dst_port,
        a.tcp.seq,
        a.tcp_flags,
        bytes(a.payload),
        a.warnings,
    ) == ("1.2.3.255", "255.0.0.1", 1, 65535, 4294967295, 18, b"hi", [])
    assert b.warnings == ["ethernet: truncated"] and b.src_ip is None
    assert (
        c.src_ip,
        c.dst_ip,
        c.fragmented,
        c.fragment_id,
        c.src_port,
        bytes(c.payload),
    ) == ("fe80::1", "2001:db8::1:0:0:1", True, 9, 7, b"x")
    assert (d.tcp.options.mss, d.tcp.options.window_scale, d.tcp.options.sack, d.tcp.options.timestamps) == (1460, 7, True, False)
    assert (e.icmp.type, e.icmp.echo_id, e.icmp.echo_seq, e.icmp.payload_len) == (8, 5, 6, 2)
    assert f.warnings == ["unsupported link type LINKTYPE_9"]
    assert (g.arp.op, g.arp.sender_mac, g.arp.sender_ip, g.arp.target_ip) == (2, "02:00:00:00:00:0a", "10.0.0.1", "10.0.0.2")
    assert (h.src_port, h.payload_len) == (5, 3)
    assert (i.src_port, i.payload_len, i.fragment_offset, bytes(i.ip_payload)) == (None, 4, 16, b"abcd")


def test_fingerprint_text():
    hello = applications.parse_tls(sample.client_hello("example.com"))
    assert hello["ja3_text"] == "771,4865-4866,0-16-10-11-43,29,0" and hello["ja3"] == hashlib.md5(hello["ja3_text"].encode()).hexdigest() == "2e3003a416b4edad56a32683dfb5bfe1"
    assert (hello["sni"], hello["version"], hello["alpn"], hello["complete"]) == ("example.com", 0x0304, ["h2"], True)


def test_dns():
    m = applications.parse_dns(sample.dns("www.example.com", "1.2.3.4"))
    assert m["is_response"] and m["answers"] == [{"name": "www.example.com", "rtype": 1, "ttl": 60, "data": "1.2.3.4"}]
    cyclic = sample.dns("a")[:12] + b"\xc0\x0c" + bytes(4)
    assert applications.parse_dns(cyclic) is None and applications.parse_dns(b"\0" * 11) is None
    query = sample.dns("a.example")
    framed = len(query).to_bytes(2, "big") + query
    for payload, tcp in ((query, False), (query, True), (framed, True)):
        assert applications.parse(payload, (50000, 53), tcp)[1]["questions"][0]["name"] == "a.example"
    assert applications.parse(query, (1, 2), False) is None


def test_http():
    m = applications.parse_http(b"GET /x HTTP/1.1\r\nHost: h:8080\r\nCookie: a\r\nContent-Length: 12\r\n\r\nbody")
    assert (m["summary"], m["has_cookie"], m["content_length"], m["complete"]) == ("GET h:8080/x", True, 12, True)
    cut = applications.parse_http(b"POST /y HTTP/1.0\r\nAuthorization: Basic x")
    assert cut["has_authorization"] and not cut["complete"]
    assert applications.parse_http(b"HTTP/1.1 404 Not Found\r\n\r\n")["summary"] == "404"
    for wrong in (
        b"GET /x",
        b"BREW / HTTP/1.1\r\n\r\n",
        b"HTTP/1.1 99 x\r\n\r\n",
        b"\xff\xfe\r\n\r\n",
        b"",
        b"GET / HTTP/2\r\n\r\n",
    ):
        assert applications.parse_http(wrong) is None
    long = applications.parse_http(b"GET /" + b"\xc3\xa9" * 600 + b" HTTP/1.1\r\n\r\n")
    assert long["uri"].endswith("…") and len(long["uri"].encode()) <= 512 + 3


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=300), st.booleans(), st.sampled_from([53, 80, 443]))
def test_parsers_never_fail(payload, tcp, port):
    applications.message_row(applications.parse(payload, (50000, port), tcp))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 200), st.binary(min_size=1, max_size=4))
def test_broken_hellos_never_fail(at, noise):
    hello = sample.client_hello("example.com")
    applications.parse_tls(hello[:at] + noise + hello[at + len(noise) :])


@settings(max_examples=400, deadline=None)
@given(
    st.binary(max_size=120),
    st.sampled_from([0, 1, 101, 108, 113, 276, 77]),
    st.sampled_from([b"", b"\x45\0\0\x28", b"\x60\0\0\0", bytes(12) + b"\x08\0\x45", bytes(12) + b"\x86\xdd\x60"]),
)
def test_noise_never_fails(noise, link, start):
    layers.parse_frame(link, start + noise)
