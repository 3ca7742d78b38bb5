"""Frames put together in column expressions: headers, lengths, checksums and messages as binary concatenations.

The opposite of ``netlens.decode``: any table's columns can become traffic, without a Python worker. Numbers
are written big-endian unless said otherwise. Addresses are unsigned numbers for IPv4, 16 bytes for IPv6.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | int

# Types and tags of link layers, the pcap and pcapng numbers that files begin with.
IPV4, IPV6, ARP = 0x0800, 0x86DD, 0x0806
TLS_HANDSHAKE, TLS_RECORD = 22, 0x0301
PCAP_NANOSECONDS, PCAP_MICROSECONDS, SNAP = 0xA1B23C4D, 0xA1B2C3D4, 262_144
SECTION, BYTE_ORDER, INTERFACE, ENHANCED = 0x0A0D0D0A, 0x1A2B3C4D, 1, 6


def _long(n: Value) -> Column:
    return n.cast("long") if isinstance(n, Column) else F.lit(n).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once in ``body``, which uses it more than once; nested uses would double the plan each time."""
    return F.transform(F.array(value), body)[0]


def raw(digits: str) -> Column:
    return F.unhex(F.lit(digits))


def number(n: Value, size: int) -> Column:
    """The low ``size`` bytes of a number, up to 8."""
    return F.unhex(F.right(F.concat(F.lit("00" * size), F.hex(_long(n))), F.lit(2 * size)))


def little(n: Value, size: int) -> Column:
    """The same, the low byte first."""
    octet = lambda v, k: number(F.shiftright(v, 8 * k).bitwiseAND(F.lit(255).cast("long")), 1)
    return let(_long(n), lambda v: F.concat(*(octet(v, k) for k in range(size))))


def text(s: Column | str) -> Column:
    return F.encode(s if isinstance(s, Column) else F.lit(s), "UTF-8")


def zeros(n: Value) -> Column:
    return F.unhex(F.repeat(F.lit("00"), _long(n).cast("int")))


def joined(parts: Column) -> Column:
    """The members of an array of binaries, one behind the other."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def prefixed(data: Column, size: int) -> Column:
    """Bytes behind their length."""
    return let(data, lambda d: F.concat(number(F.length(d), size), d))


def checksum(data: Column) -> Column:
    """The internet checksum of an even number of bytes, three words at a time, as carries keep the rest by 65,535."""
    words = lambda digits, k: F.conv(F.substring(digits, 12 * k + 1, F.lit(12)), 16, 10).cast("long")
    places = lambda digits: F.sequence(F.lit(0), F.ceil(F.length(digits) / 12).cast("int") - 1)
    total = let(F.hex(data), lambda d: F.aggregate(places(d), F.lit(0).cast("long"), lambda a, k: a + words(d, k)))
    return F.lit(0xFFFF).cast("long") - let(total, lambda n: F.when(n > 0, (n - 1) % 0xFFFF + 1).otherwise(n))


def ethernet(payload: Column, kind: Value = IPV4, src: Value = 0x020000000001, dst: Value = 0x020000000002, tags: tuple = ()) -> Column:
    """A frame; ``tags`` are pairs of the tag's type and its control bits."""
    marks = [x for kind_, bits in tags for x in (number(kind_, 2), number(bits, 2))]
    return F.concat(number(dst, 6), number(src, 6), *marks, number(kind, 2), payload)


def cooked(payload: Column, kind: Value, version: int = 1) -> Column:
    """Linux cooked capture of the first or second kind."""
    return F.concat(zeros(14), number(kind, 2), payload) if version == 1 else F.concat(number(kind, 2), zeros(18), payload)


def ipv4(
    src: Value, dst: Value, proto: Value, payload: Column, ident: Value = 0, offset: Value = 0, more: Column | bool = False, ttl: Value = 64
) -> Column:
    """A packet with its checksum; ``offset`` in bytes, a multiple of 8."""
    flag = F.when(more if isinstance(more, Column) else F.lit(more), 0x2000).otherwise(0)
    rest = F.concat(number(ident, 2), number(_long(offset) / 8 + flag, 2), number(ttl, 1), number(proto, 1))
    head = lambda p: F.concat(raw("4500"), number(F.length(p) + 20, 2), rest, raw("0000"), number(src, 4), number(dst, 4))
    summed = lambda h: F.concat(F.substring(h, 1, 10), number(checksum(h), 2), F.substring(h, 13, 8))
    return let(payload, lambda p: F.concat(let(head(p), summed), p))


def ipv6(src: Column, dst: Column, proto: Value, payload: Column, hops: Value = 64) -> Column:
    return let(payload, lambda p: F.concat(raw("60000000"), number(F.length(p), 2), number(proto, 1), number(hops, 1), src, dst, p))


def hop_options(proto: Value, payload: Column) -> Column:
    """An empty hop-by-hop header (0) before the payload."""
    return F.concat(number(proto, 1), raw("00010400000000"), payload)


def tcp(sport: Value, dport: Value, seq: Value, flags: Value, payload: Column, options: Column | None = None) -> Column:
    """A segment; the length of ``options`` is a multiple of 4."""
    more = options if options is not None else raw("")
    words = number((F.length(more) / 4 + 5) * 16, 1)
    return F.concat(number(sport, 2), number(dport, 2), number(seq, 4), raw("00000000"), words, number(flags, 1), raw("ffff00000000"), more, payload)


def udp(sport: Value, dport: Value, payload: Column) -> Column:
    return let(payload, lambda p: F.concat(number(sport, 2), number(dport, 2), number(F.length(p) + 8, 2), raw("0000"), p))


def icmp(kind: Value, rest: Column) -> Column:
    return F.concat(number(kind, 1), raw("000000"), rest)


def arp(op: Value, mac: Value, ip: Value, target: Value) -> Column:
    return F.concat(raw("000108000604"), number(op, 2), number(mac, 6), number(ip, 4), raw("00" * 6), number(target, 4))


def dns_name(name: Column) -> Column:
    return F.concat(joined(F.transform(F.split(name, r"\."), lambda label: prefixed(text(label), 1))), raw("00"))


def dns(question: Column, qtype: Value, flags: Value, answer: Column | None = None, number_: Value = 7) -> Column:
    """A message of one question (``dns_name``) and at most one answer (``dns_answer``, or empty)."""
    head = F.concat(number(number_, 2), number(flags, 2), raw("0001"))
    asked = F.concat(raw("00000000"), question, number(qtype, 2), raw("0001"))
    answers = lambda a: number(F.when(F.length(a) > 0, 1).otherwise(0), 2)
    return let(answer if answer is not None else raw(""), lambda a: F.concat(head, answers(a), asked, a))


def dns_answer(rtype: Value, ttl: Value, data: Column) -> Column:
    """A record whose name points to the question's."""
    return F.concat(raw("c00c"), number(rtype, 2), raw("0001"), number(ttl, 4), prefixed(data, 2))


def extension(kind: Value, body: Column) -> Column:
    return F.concat(number(kind, 2), prefixed(body, 2))


def numbers(*values: Value) -> Column:
    """Two bytes each."""
    return F.concat(*(number(v, 2) for v in values))


def hello(client: bool, version: Value, ciphers: Column, extensions: Column) -> Column:
    """The record of a TLS client or server hello; a server's ``ciphers`` is the one it chose."""
    chosen = F.concat(prefixed(ciphers, 2), raw("0100")) if client else F.concat(ciphers, raw("00"))
    body = F.concat(number(version, 2), raw("00" * 33), chosen, prefixed(extensions, 2))
    return F.concat(number(TLS_HANDSHAKE, 1), number(TLS_RECORD, 2), prefixed(F.concat(number(1 if client else 2, 1), prefixed(body, 3)), 2))


def lines(*rows: Column | None) -> Column:
    """Text lines with the line ends of HTTP; null rows are left out."""
    return text(F.concat(F.concat_ws("\r\n", *(r for r in rows if r is not None)), F.lit("\r\n")))


def pcap_file(link_type: Value, records: Column, big_endian: bool = False, nanoseconds: bool = True) -> Column:
    put = number if big_endian else little
    magic = PCAP_NANOSECONDS if nanoseconds else PCAP_MICROSECONDS
    return F.concat(put(magic, 4), put(2, 2), put(4, 2), zeros(8), put(SNAP, 4), put(link_type, 4), records)


def pcap_record(ts_ns: Column, wire_len: Value, data: Column, big_endian: bool = False, nanoseconds: bool = True) -> Column:
    put, unit = (number if big_endian else little), 1 if nanoseconds else 1000
    second, rest = F.call_function("div", ts_ns, F.lit(10**9)), F.call_function("div", F.pmod(ts_ns, F.lit(10**9)), F.lit(unit))
    return F.concat(put(second, 4), put(rest, 4), put(F.length(data), 4), put(wire_len, 4), data)


def block(kind: Value, body: Column) -> Column:
    """A pcapng block, little-endian, padded to four bytes."""
    padded = let(body, lambda b: F.concat(b, zeros(F.pmod(-F.length(b), F.lit(4)))))
    size = lambda b: little(F.length(b) + 12, 4)
    return let(padded, lambda b: F.concat(little(kind, 4), size(b), b, size(b)))


def pcapng_file(link_type: Value, blocks: Column) -> Column:
    """A section with one interface whose clock counts nanoseconds."""
    section = block(SECTION, F.concat(little(BYTE_ORDER, 4), little(1, 2), zeros(2), raw("ff" * 8)))
    interface = block(INTERFACE, F.concat(little(link_type, 2), zeros(2), little(SNAP, 4), little(9, 2), little(1, 2), raw("09000000"), zeros(4)))
    return F.concat(section, interface, blocks)


def pcapng_block(ts_ns: Column, wire_len: Value, data: Column) -> Column:
    times = F.concat(little(F.shiftright(ts_ns, 32), 4), little(ts_ns.bitwiseAND(F.lit(0xFFFFFFFF)), 4))
    return block(ENHANCED, F.concat(zeros(4), times, little(F.length(data), 4), little(wire_len, 4), data))


def chosen(by: Column, values: list[Column]) -> Column:
    """``values[by]``."""
    return reduce(lambda rest, k: F.when(by == k, values[k]).otherwise(rest), range(len(values) - 1), values[-1])
