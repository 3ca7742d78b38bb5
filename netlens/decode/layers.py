"""Frames to packets: link, network and transport layers.

Headers are chains of variable offsets, so each frame is walked once, in Arrow batches on the
executors; all that follows is column work. Decoding never fails: what is wrong with a frame is
in ``warnings``.
"""

import ipaddress
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions import names

# Link types, address families of the loopback header, tags and extension headers.
ETHERNET, RAW, LOOPBACK, SLL, SLL2 = 1, (12, 14, 101), (0, 108), 113, 276
FAMILIES_V4, FAMILIES_V6 = (2,), (24, 28, 30)
IPV4, IPV6, ARP = 0x0800, 0x86DD, 0x0806
TAGS = (0x8100, 0x88A8, 0x9100)
MOST_TAGS, MOST_EXTENSIONS = 3, 16
HOP, ROUTING, FRAGMENT, AUTH, DESTINATION = 0, 43, 44, 51, 60

ETH = "struct<src:string,dst:string,vlans:array<struct<tpid:int,priority:int,dei:boolean,vid:int>>>"
IP4 = "struct<header_len:int,total_len:int,tos:int,id:bigint,dont_fragment:boolean,ttl:int>"
IP6 = "struct<traffic_class:int,flow_label:bigint,payload_length:int,hop_limit:int,extension_headers:int>"
ARP_TYPE = "struct<op:int,sender_mac:string,sender_ip:string,target_mac:string,target_ip:string>"
TCP = "struct<src_port:int,dst_port:int,seq:bigint,ack:bigint,flags:int,window:int,checksum:int,urgent:int,options:struct<mss:int,window_scale:int,sack:boolean,timestamps:boolean>>"
UDP = "struct<src_port:int,dst_port:int,length:int,checksum:int>"
ICMP = "struct<type:int,code:int,checksum:int,echo_id:int,echo_seq:int,payload_len:int>"
DECODED = (
    f"eth {ETH}, ethertype int, ip4 {IP4}, ip6 {IP6}, arp {ARP_TYPE}, tcp {TCP}, udp {UDP}, icmp {ICMP}, src_ip string, dst_ip string, src_key binary, dst_key binary, ip_proto int, src_port int, dst_port int, tcp_flags int, "
    "fragmented boolean, fragment_offset int, fragment_id bigint, more_fragments boolean, payload_len int, payload_at int, payload binary, ip_payload binary, warnings array<string>"
)
PASSED = ("file", "index", "ts_ns", "captured_len", "wire_len", "link_type")
_EMPTY = {
    **dict.fromkeys(
        (
            "eth",
            "ethertype",
            "ip4",
            "ip6",
            "arp",
            "tcp",
            "udp",
            "icmp",
            "src_ip",
            "dst_ip",
            "src_key",
            "dst_key",
            "ip_proto",
            "src_port",
            "dst_port",
            "tcp_flags",
            "fragment_offset",
            "fragment_id",
            "payload_at",
            "payload",
            "ip_payload",
        )
    ),
    "fragmented": False, "more_fragments": False, "payload_len": 0,
}


COLUMNS = (*_EMPTY, "warnings")


def mac_text(data: bytes) -> str:
    return data.hex(":")


def dotted(data: bytes) -> str:
    return "%d.%d.%d.%d" % tuple(data)


def parse_link(link: int, data: bytes, out: dict) -> tuple[int, int]:
    """Ethertype and offset of the network layer."""
    if link == ETHERNET:
        at, tags = 12, []
        kind = _u16(data, at, "ethernet")
        while kind in TAGS and len(tags) < MOST_TAGS:
            tci = _u16(data, at + 2, "ethernet")
            tags.append({"tpid": kind, "priority": tci >> 13, "dei": bool(tci >> 12 & 1), "vid": tci & 0xFFF})
            at += 4
            kind = _u16(data, at, "ethernet")
        out["eth"] = {"src": mac_text(data[6:12]), "dst": mac_text(data[:6]), "vlans": tags}
        return kind, at + 2
    if link in RAW:
        version = data[0] >> 4 if data else 0
        if version not in (4, 6):
            raise ValueError("raw link: unrecognised IP version")
        return (IPV4 if version == 4 else IPV6), 0
    if link in LOOPBACK:
        if len(data) < 4:
            raise ValueError("loopback header: truncated")
        family = int.from_bytes(data[:4], "little")
        if family not in (*FAMILIES_V4, *FAMILIES_V6):
            raise ValueError(f"loopback header: unknown address family {family}")
        return (IPV4 if family in FAMILIES_V4 else IPV6), 4
    if link in (SLL, SLL2):
        at, size, name = (14, 16, "linux cooked header") if link == SLL else (0, 20, "linux cooked v2 header")
        if len(data) < size:
            raise ValueError(f"{name}: truncated")
        return _u16(data, at, name), size
    raise ValueError(f"unsupported link type LINKTYPE_{link}")


def _u16(data: bytes, at: int, layer: str) -> int:
    if at + 2 > len(data):
        raise ValueError(f"{layer}: truncated")
    return data[at] << 8 | data[at + 1]


def parse_v4(data: bytes, at: int, out: dict) -> tuple[int, int, bool]:
    """Offset and end of the payload, and whether a transport header is there."""
    if at + 20 > len(data):
        raise ValueError("ipv4: truncated")
    first, tos, total, ident, flags, ttl, proto = struct.unpack_from(">BBHHHBB", data, at)
    head = (first & 15) * 4
    if first >> 4 != 4 or head < 20:
        raise ValueError("ipv4: malformed")
    if at + head > len(data):
        raise ValueError("ipv4: truncated")
    end = min(len(data), at + total) if total > head else len(data)
    offset, more = (flags & 0x1FFF) * 8, bool(flags & 0x2000)
    src, dst = data[at + 12 : at + 16], data[at + 16 : at + 20]
    out.update(
        ip4={"header_len": head, "total_len": total, "tos": tos, "id": ident, "dont_fragment": bool(flags & 0x4000), "ttl": ttl},
        ip_proto=proto,
        src_ip=dotted(src),
        dst_ip=dotted(dst),
        src_key=b"\4" + src,
        dst_key=b"\4" + dst,
        fragmented=more or offset > 0, fragment_offset=offset, fragment_id=ident, more_fragments=more,
    )
    return at + head, end, offset == 0


def parse_v6(data: bytes, at: int, out: dict) -> tuple[int, int, bool]:
    if at + 40 > len(data):
        raise ValueError("ipv6: truncated")
    first, length, kind, hops = struct.unpack_from(">IHBB", data, at)
    if first >> 28 != 6:
        raise ValueError("ipv6: malformed")
    src, dst = data[at + 8 : at + 24], data[at + 24 : at + 40]
    end = min(len(data), at + 40 + length) if length else len(data)
    p, headers, fragmented, offset, ident, more = at + 40, 0, False, 0, 0, False
    for _ in range(MOST_EXTENSIONS):
        if kind not in (HOP, ROUTING, DESTINATION, FRAGMENT, AUTH):
            break
        size = 8 if kind == FRAGMENT else 2
        if p + size > end:
            raise ValueError("ipv6: truncated")
        if kind == FRAGMENT:
            bits, ident = struct.unpack_from(">HI", data, p + 2)
            fragmented, offset, more = True, (bits >> 3) * 8, bool(bits & 1)
        else:
            size = 8 + data[p + 1] * (4 if kind == AUTH else 8)
        if p + size > end:
            raise ValueError("ipv6: truncated")
        kind, p, headers = data[p], p + size, headers + 1
        if offset:
            break
    out.update(
        ip6={
            "traffic_class": first >> 20 & 255,
            "flow_label": first & 0xFFFFF,
            "payload_length": length,
            "hop_limit": hops,
            "extension_headers": headers,
        },
        ip_proto=kind,
        src_ip=str(ipaddress.IPv6Address(src)),
        dst_ip=str(ipaddress.IPv6Address(dst)),
        src_key=b"\6" + src,
        dst_key=b"\6" + dst,
        fragmented=fragmented,
        fragment_offset=offset,
        fragment_id=ident,
        more_fragments=more,
    )
    return p, end, offset == 0


def parse_arp(data: bytes, at: int) -> dict:
    if at + 28 > len(data):
        raise ValueError("arp: truncated")
    if data[at : at + 6] != b"\0\1\x08\0\6\4":
        raise ValueError("arp: malformed")
    f = data[at + 6 : at + 28]
    return {
        "op": f[0] << 8 | f[1],
        "sender_mac": mac_text(f[2:8]),
        "sender_ip": dotted(f[8:12]),
        "target_mac": mac_text(f[12:18]),
        "target_ip": dotted(f[18:22]),
    }


def tcp_options(data: bytes) -> dict:
    """What is read before the first malformed option."""
    out = {"mss": None, "window_scale": None, "sack": False, "timestamps": False}
    at = 0
    while at < len(data) and data[at]:
        if data[at] == 1:
            at += 1
            continue
        if at + 2 > len(data) or data[at + 1] < 2 or at + data[at + 1] > len(data):
            break
        kind, body = data[at], data[at + 2 : at + data[at + 1]]
        if kind == 2 and len(body) >= 2:
            out["mss"] = body[0] << 8 | body[1]
        elif kind == 3 and body:
            out["window_scale"] = body[0]
        out["sack"] |= kind == 4
        out["timestamps"] |= kind == 8
        at += data[at + 1]
    return out


def parse_transport(data: bytes, at: int, end: int, out: dict) -> None:
    proto, have = out["ip_proto"], end - at
    if proto == names.TCP:
        if have < 20:
            raise ValueError("tcp: truncated")
        sport, dport, seq, ack, offset, flags, window, checksum, urgent = struct.unpack_from(">HHIIBBHHH", data, at)
        head = (offset >> 4) * 4
        if head < 20:
            raise ValueError("tcp: malformed")
        if head > have:
            raise ValueError("tcp: truncated")
        out["tcp"] = {
            "src_port": sport,
            "dst_port": dport,
            "seq": seq,
            "ack": ack,
            "flags": flags,
            "window": window,
            "checksum": checksum,
            "urgent": urgent,
            "options": tcp_options(data[at + 20 : at + head]) if head > 20 else None,
        }
        out.update(
            src_port=sport,
            dst_port=dport,
            tcp_flags=flags,
            payload_at=at + head,
            payload_len=have - head,
            payload=data[at + head : end] or None,
        )
    elif proto == names.UDP:
        if have < 8:
            raise ValueError("udp: truncated")
        sport, dport, length, checksum = struct.unpack_from(">4H", data, at)
        stop = min(end, at + length) if length >= 8 else end
        out.update(
            udp={"src_port": sport, "dst_port": dport, "length": length, "checksum": checksum},
            src_port=sport,
            dst_port=dport,
            payload_at=at + 8,
            payload_len=stop - at - 8,
            payload=data[at + 8 : stop] or None,
        )
    elif proto in (names.ICMP, names.ICMP6):
        echo = have > 0 and data[at] in ((128, 129) if proto == names.ICMP6 else (0, 8))
        size = 8 if echo else 4
        if have < size:
            raise ValueError("icmp: truncated")
        kind, code, checksum = struct.unpack_from(">BBH", data, at)
        ident, number = struct.unpack_from(">2H", data, at + 4) if echo else (None, None)
        out["icmp"] = {
            "type": kind,
            "code": code,
            "checksum": checksum,
            "echo_id": ident,
            "echo_seq": number,
            "payload_len": have - size,
        }
        out["payload_len"] = have - size
    else:
        out["payload_len"] = have


def parse_frame(link: int, data: bytes) -> dict:
    """The columns of DECODED for one frame."""
    out = dict(_EMPTY)
    out["warnings"] = []
    try:
        kind, at = parse_link(link, data, out)
        out["ethertype"] = kind
        if kind == ARP:
            out["arp"] = parse_arp(data, at)
        elif kind in (IPV4, IPV6):
            start, end, has_transport = (parse_v4 if kind == IPV4 else parse_v6)(data, at, out)
            end = max(start, end)
            if out["fragmented"]:
                out["ip_payload"] = data[start:end]
            if has_transport:
                parse_transport(data, start, end, out)
            else:
                out["payload_len"] = end - start
    except ValueError as e:
        out["warnings"].append(str(e))
    return out


def decode(frames: DataFrame) -> DataFrame:
    """Packets from frames (``file``, ``index``, ``ts_ns``, ``captured_len``, ``wire_len``, ``link_type``, ``data``).

    ``payload`` is the transport payload of TCP and UDP; ``ip_payload`` the network payload of fragments.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    slim = frames.select(*PASSED, "data")
    schema = StructType([*(slim.schema[c] for c in PASSED), *StructType.fromDDL(DECODED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = list(to_arrow_schema(schema))[len(PASSED) :]
        for batch in batches:
            links = batch.column(PASSED.index("link_type")).to_pylist()
            # Each row's dict is left at once for its values, which are in the order of COLUMNS.
            rows = [tuple(parse_frame(link, data).values()) for link, data in zip(links, batch.column(len(PASSED)).to_pylist(), strict=True)]
            found = dict(zip(COLUMNS, zip(*rows, strict=True), strict=True)) if rows else dict.fromkeys(COLUMNS, ())
            columns = [pa.array(found[f.name], f.type) for f in decoded]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(PASSED)], *columns], schema.fieldNames())

    return slim.mapInArrow(run, schema)


def summary_line(app: Column | None = None) -> Column:
    """One line for each packet: its endpoints, protocol and length."""
    ends = lambda ip, port: F.when(
        F.col(port).isNotNull(),
        F.concat(F.col(ip), F.lit(":"), F.col(port).cast("string")),
    ).otherwise(F.col(ip))
    label = F.coalesce(
        *([app] if app is not None else []),
        F.when(F.col("ip_proto").isNotNull(), names.protocol(F.col("ip_proto"))),
        F.when(F.col("arp").isNotNull(), "ARP"),
        names.ethertype(F.col("ethertype")),
        F.lit("?"),
    )
    flags = F.when(
        F.col("tcp_flags").isNotNull(),
        F.concat(F.lit(" ["), names.flags_text(F.col("tcp_flags")), F.lit("]")),
    ).otherwise("")
    arrow = F.coalesce(
        F.concat(ends("src_ip", "src_port"), F.lit(" -> "), ends("dst_ip", "dst_port")),
        F.concat(F.col("eth.src"), F.lit(" -> "), F.col("eth.dst")),
        F.lit("-"),
    )
    return F.concat(
        F.col("index").cast("string"),
        F.lit(" "),
        arrow,
        F.lit(" "),
        label,
        flags,
        F.lit(" len="),
        F.col("wire_len").cast("string"),
    )
