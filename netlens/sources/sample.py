"""A small made-up capture in which most detections fire."""

import ipaddress
import struct


def ethernet(payload: bytes, kind: int = 0x0800, src: str = "02:00:00:00:00:01", dst: str = "02:00:00:00:00:02") -> bytes:
    return bytes.fromhex(dst.replace(":", "")) + bytes.fromhex(src.replace(":", "")) + struct.pack(">H", kind) + payload


def ipv4(src: str, dst: str, proto: int, payload: bytes, ident: int = 0, offset: int = 0, more: bool = False) -> bytes:
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(payload), ident, offset // 8 | (0x2000 if more else 0), 64, proto, 0)
    return head + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed + payload


def ipv6(src: str, dst: str, proto: int, payload: bytes) -> bytes:
    return struct.pack(
        ">IHBB",
        6 << 28,
        len(payload),
        proto,
        64,
    ) + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed + payload


def tcp(sport: int, dport: int, seq: int, flags: int, payload: bytes = b"") -> bytes:
    return struct.pack(">HHIIBBHHH", sport, dport, seq, 0, 0x50, flags, 0xFFFF, 0, 0) + payload


def udp(sport: int, dport: int, payload: bytes) -> bytes:
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def dns_name(name: str) -> bytes:
    return b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0"


def dns(name: str, answer: str | None = None, rcode: int = 0, response: bool = False) -> bytes:
    flags = (0x8180 if answer or response else 0x0100) | rcode
    body = dns_name(name) + struct.pack(">2H", 1, 1)
    if answer:
        body += b"\xc0\x0c" + struct.pack(">2HIH", 1, 1, 60, 4) + ipaddress.ip_address(answer).packed
    return struct.pack(">6H", 7, flags, 1, 1 if answer else 0, 0, 0) + body


def client_hello(sni: str | None, version: int = 0x0303, ciphers: tuple = (0x0A0A, 4865, 4866)) -> bytes:
    extensions = b""
    if sni:
        name = sni.encode()
        extensions += struct.pack(">2H", 0, len(name) + 5) + struct.pack(">HBH", len(name) + 3, 0, len(name)) + name
    extensions += struct.pack(
        ">2HHBB",
        16,
        5,
        3,
        2,
        0x68,
    ) + b"2" + struct.pack(">2HHH", 10, 4, 2, 29) + struct.pack(">2HBB", 11, 2, 1, 0)
    if version >= 0x0303:
        extensions += struct.pack(">2HBHH", 43, 5, 4, 0x0A0A, 0x0304)
    suites = b"".join(struct.pack(">H", c) for c in ciphers)
    body = struct.pack(">H", version) + bytes(32) + b"\0" + struct.pack(">H", len(suites)) + suites + b"\1\0" + struct.pack(
        ">H",
        len(extensions),
    ) + extensions
    hello = b"\1" + struct.pack(">I", len(body))[1:] + body
    return struct.pack(">BHH", 22, 0x0301, len(hello)) + hello


def arp(op: int, mac: str, ip: str, target: str) -> bytes:
    return struct.pack(
        ">HHBBH",
        1,
        0x0800,
        6,
        4,
        op,
    ) + bytes.fromhex(mac.replace(":", "")) + ipaddress.ip_address(ip).packed + bytes(6) + ipaddress.ip_address(target).packed


def frames() -> list[tuple[int, int, bytes]]:
    """(ts_ns, wire_len, data) of each frame, in order of time."""
    out: list[tuple[float, int, bytes]] = []

    def add(at: float, data: bytes, cut: int | None = None) -> None:
        out.append((at, len(data), data[:cut] if cut else data))

    me, resolver, server = "192.168.1.10", "192.168.1.1", "93.184.216.34"
    for k in range(25):  # a check-in every minute
        add(
            10 + 60.0 * k + (k % 3) * 0.4,
            ethernet(ipv4("192.168.1.50", "203.0.113.77", 6, tcp(50123, 443, 100 + 4 * k, 24, b"beat"))),
        )
    for k in range(60):  # names that carry data out
        label = f"{(k * 2654435761) % (1 << 32):08x}{(k * 40503 + 7) % (1 << 16):04x}q{chr(97 + k % 26)}"
        add(20 + 0.5 * k, ethernet(ipv4("192.168.1.77", resolver, 17, udp(51000, 53, dns(f"{label}.exfil.example")))))
    for k in range(20):  # ports tried
        add(60 + 0.01 * k, ethernet(ipv4("192.168.1.66", "192.168.1.20", 6, tcp(44000 + k, 20 + 7 * k, 1, 2))))
    add(70, ethernet(ipv4(me, resolver, 17, udp(50000, 53, dns("www.example.com")))))
    add(70.01, ethernet(ipv4(resolver, me, 17, udp(53, 50000, dns("www.example.com", server)))))
    request = b"GET /private HTTP/1.1\r\nHost: www.example.com\r\nUser-Agent: probe/1.0\r\nAuthorization: Basic eDp5\r\n\r\n"
    add(71, ethernet(ipv4(me, server, 6, tcp(50001, 80, 1000, 2))))
    add(71.01, ethernet(ipv4(server, me, 6, tcp(80, 50001, 5000, 18))))
    add(71.02, ethernet(ipv4(me, server, 6, tcp(50001, 80, 1001, 24, request[:40]))))
    add(71.03, ethernet(ipv4(me, server, 6, tcp(50001, 80, 1041, 24, request[40:]))))
    add(
        71.04,
        ethernet(
            ipv4(
                server,
                me,
                6,
                tcp(80, 50001, 5001, 24, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: 0\r\n\r\n"),
            )
        ),
    )
    add(80, ethernet(ipv4(me, server, 6, tcp(50002, 443, 1, 24, client_hello("www.example.com")))))
    add(81, ethernet(ipv4("192.168.1.11", server, 6, tcp(50003, 443, 1, 24, client_hello("old.example.com", 0x0301)))))
    for k in range(4500):  # one large upload
        add(
            100 + 0.01 * k,
            ethernet(ipv4("192.168.1.88", "198.51.100.5", 6, tcp(46000, 443, 1 + 1400 * k, 16, bytes(1400)))),
            96 if k < 8 else None,
        )
    for mac in ("02:00:00:00:00:0a", "02:00:00:00:00:0b"):
        add(150, ethernet(arp(2, mac, "192.168.1.1", me), 0x0806))
    add(160, ethernet(ipv4(me, "192.168.1.21", 6, tcp(50010, 23, 1, 24, b"login"))))
    datagram = udp(50005, 53, dns("split.example.org"))
    add(170, ethernet(ipv4(me, resolver, 17, datagram[:24], 77, 0, True)))
    add(170.1, ethernet(ipv4(me, resolver, 17, b"\xff" * 8, 77, 16, True)))
    add(170.2, ethernet(ipv4(me, resolver, 17, datagram[24:], 77, 24, False)))
    add(180, ethernet(ipv6("2001:db8::1", "2001:db8::2", 17, udp(40000, 123, bytes(48))), 0x86DD))
    return [(int(at * 1e9) + 1_700_000_000 * 10**9, wire, data) for at, wire, data in sorted(out, key=lambda x: x[0])]


def capture_bytes() -> bytes:
    """The frames as a pcap file."""
    from netlens.sources.capture import pcap_header, pcap_record

    return pcap_header(1) + b"".join(pcap_record(*f) for f in frames())
