"""DNS, TLS hello and HTTP heads from payload bytes, and the frame of messages that they make.

These formats are pointers and lengths within bytes, which column expressions can't follow; the
parsers are small functions that run on Arrow batches of the payloads that may hold a message.
"""

import hashlib
import ipaddress
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.functions.names import TCP

# Limits and codes of the formats.
DNS_PORTS = (53, 5353, 5355)
MOST_OPCODE, MOST_QUESTIONS, MOST_ANSWERS, MOST_JUMPS, MOST_LABELS = 5, 64, 512, 16, 127
HANDSHAKE, CLIENT, SERVER = 22, 1, 2
SERVER_NAME, GROUPS, FORMATS, ALPN, VERSIONS = 0, 10, 11, 16, 43
METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "CONNECT", "TRACE")
HEAD_LIMIT, HEADER_LIMIT, URI_LIMIT, REASON_LIMIT = 16 * 1024, 256, 512, 120
KEPT = {
    "host": "host",
    "user-agent": "user_agent",
    "server": "server",
    "content-type": "content_type",
    "content-length": "content_length",
    "location": "location",
    "referer": "referer",
}

MESSAGE = (
    "app string, complete boolean, "
    "dns struct<id:int,is_response:boolean,opcode:int,rcode:int,truncated:boolean,questions:array<struct<name:string,qtype:int>>,answers:array<struct<name:string,rtype:int,ttl:bigint,data:string>>>, "
    "tls struct<kind:string,version:int,legacy_version:int,sni:string,alpn:array<string>,ciphers:array<int>,extensions:array<int>,ja3_text:string,ja3:string>, "
    "http struct<is_request:boolean,version:string,method:string,uri:string,status:int,reason:string,host:string,user_agent:string,server:string,content_type:string,content_length:bigint,location:string,referer:string,has_authorization:boolean,has_cookie:boolean,header_count:int,summary:string>"
)


def _text(data: bytes) -> str:
    return bytes(data).decode("utf-8", "replace")


def read_name(message: bytes, at: int) -> tuple[str, int]:
    """A possibly compressed name and the offset past it. Pointers must go back, so none can cycle."""
    labels, after, jumps = [], 0, 0
    while True:
        size = message[at]
        if size >= 0xC0:
            target = (size & 0x3F) << 8 | message[at + 1]
            after = after or at + 2
            jumps += 1
            if jumps > MOST_JUMPS or target >= at:
                raise ValueError("compression pointer")
            at = target
        elif size >= 0x40:
            raise ValueError("label type")
        elif size == 0:
            return ".".join(labels) or ".", after or at + 1
        else:
            if at + 1 + size > len(message) or len(labels) >= MOST_LABELS:
                raise ValueError("label")
            labels.append(_text(message[at + 1 : at + 1 + size]))
            at += 1 + size


def rdata_text(message: bytes, kind: int, at: int, size: int) -> str:
    data = message[at : at + size]
    if kind == 1 and size == 4 or kind == 28 and size == 16:
        return str(ipaddress.ip_address(data))
    if kind in (2, 5, 12) or kind == 15 and size > 2:
        try:
            name = read_name(message, at + 2 * (kind == 15))[0]
        except (ValueError, IndexError):
            return "<malformed>"
        return name if kind != 15 else f"{name} pref={int.from_bytes(data[:2], 'big')}"
    if kind == 16:
        parts, k = [], 0
        while k < size and k + 1 + data[k] <= size:
            parts.append(_text(data[k + 1 : k + 1 + data[k]]))
            k += 1 + data[k]
        return " ".join(parts)
    return f"<{size} bytes>"


def parse_dns(message: bytes) -> dict | None:
    """A message, or None. A broken question fails it; a broken answer ends the answers."""
    if len(message) < 12:
        return None
    number, flags, questions, answers = struct.unpack_from(">4H", message)
    opcode = flags >> 11 & 15
    if opcode > MOST_OPCODE or questions > MOST_QUESTIONS or answers > MOST_ANSWERS:
        return None
    out = {
        "id": number,
        "is_response": flags >= 0x8000,
        "opcode": opcode,
        "rcode": flags & 15,
        "truncated": bool(flags & 0x200),
        "questions": [],
        "answers": [],
    }
    at = 12
    try:
        for _ in range(questions):
            name, at = read_name(message, at)
            out["questions"].append({"name": name, "qtype": struct.unpack_from(">2H", message, at)[0]})
            at += 4
    except (ValueError, IndexError, struct.error):
        return None
    try:
        for _ in range(answers):
            name, start = read_name(message, at)
            kind, _, ttl, size = struct.unpack_from(">2HIH", message, start)
            if start + 10 + size > len(message):
                break
            out["answers"].append({"name": name, "rtype": kind, "ttl": ttl, "data": rdata_text(message, kind, start + 10, size)})
            at = start + 10 + size
    except (ValueError, IndexError, struct.error):
        pass
    return out


def grease(v: int) -> bool:
    return v & 0x0F0F == 0x0A0A and v >> 8 == v & 0xFF


class Cursor:
    """Bytes read in order; reading past the end is an IndexError."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if n > self.left():
            raise IndexError
        self.at += n
        return self.data[self.at - n : self.at]

    def u(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def vector(self, n: int) -> "Cursor":
        """What a length of n bytes says, or all that is left."""
        return Cursor(self.take(min(self.u(n), self.left())))

    def pairs(self) -> list[int]:
        return [self.u(2) for _ in range(self.left() // 2)]


def parse_tls(payload: bytes) -> dict | None:
    """A client or server hello at the start of the payload, or None."""
    try:
        return _hello(Cursor(payload))
    except IndexError:
        return None


def _hello(record: Cursor) -> dict | None:
    if record.u(1) != HANDSHAKE:
        return None
    record.u(2)
    size = record.u(2)
    complete = size <= record.left()
    r = Cursor(record.take(min(size, record.left())))
    kind = r.u(1)
    if kind not in (CLIENT, SERVER):
        return None
    r.u(3)
    legacy = r.u(2)
    r.take(32)
    r.take(r.u(1))
    if kind == CLIENT:
        ciphers = [v for v in Cursor(r.take(r.u(2))).pairs() if not grease(v)]
        r.take(r.u(1))
    else:
        ciphers = [r.u(2)]
        r.u(1)
    found = {"sni": None, "alpn": [], "groups": [], "formats": [], "version": legacy}
    extensions = []
    if r.left() >= 2:
        rest = r.vector(2)
        while rest.left() >= 4:
            extension, size = rest.u(2), rest.u(2)
            if size > rest.left():
                break
            data = Cursor(rest.take(size))
            if grease(extension):
                continue
            extensions.append(extension)
            try:
                _extension(extension, data, kind, found)
            except IndexError:
                continue
    dashed = lambda values: "-".join(map(str, values))
    parts = [str(legacy), dashed(ciphers), dashed(extensions)] + (
        [dashed(found["groups"]), dashed(found["formats"])] if kind == CLIENT else []
    )
    text = ",".join(parts)
    return {
        "kind": "client" if kind == CLIENT else "server",
        "version": found["version"],
        "legacy_version": legacy,
        "sni": found["sni"],
        "alpn": found["alpn"],
        "ciphers": ciphers,
        "extensions": extensions,
        "ja3_text": text, "ja3": hashlib.md5(text.encode()).hexdigest(), "complete": complete,
    }


def _extension(kind: int, data: Cursor, hello: int, found: dict) -> None:
    if kind == SERVER_NAME:
        found["sni"] = None
        names = data.vector(2)
        while names.left() >= 3:
            of, name = names.u(1), names.take(names.u(2))
            if of == 0:
                found["sni"] = _text(name)
                break
    elif kind == ALPN:
        protocols, listed = data.vector(2), []
        while protocols.left():
            listed.append(_text(protocols.take(protocols.u(1))))
        found["alpn"] = listed
    elif kind == GROUPS:
        data.u(2)
        found["groups"] += [v for v in data.pairs() if not grease(v)]
    elif kind == FORMATS:
        found["formats"] += list(data.take(min(data.u(1), data.left())))
    elif kind == VERSIONS:
        offered = [data.u(2)] if hello == SERVER else [v for v in data.vector(1).pairs() if not grease(v)]
        found["version"] = max([found["version"], *offered])


def shortened(s: str, limit: int) -> str:
    data = s.encode()
    return s if len(data) <= limit else data[:limit].decode("utf-8", "ignore") + "…"


def parse_http(payload: bytes) -> dict | None:
    """The head of a request or response at the start of the payload, or None."""
    head = payload[:HEAD_LIMIT]
    end = head.find(b"\r\n\r\n")
    try:
        lines = [x for x in (head if end < 0 else head[: end + 2]).decode().split("\r\n") if x]
    except UnicodeDecodeError:
        return None
    out = _start_line(lines[0]) if lines else None
    if out is None:
        return None
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            continue
        name, value = name.strip().lower(), value.strip()
        out["header_count"] += 1
        out["has_authorization"] |= name in ("authorization", "proxy-authorization")
        out["has_cookie"] |= name in ("cookie", "set-cookie")
        if name in KEPT:
            value = shortened(value, HEADER_LIMIT)
            out[KEPT[name]] = value if name != "content-length" else int(value) if value.isascii() and value.isdigit() and len(value) < 19 else None
    if out["is_request"]:
        out["summary"] = f"{out['method']} {out['host'] or ''}{out['uri']}"
    else:
        out["summary"] = f"{out['status']} {out['content_type'] or ''}".rstrip()
    return out | {"complete": end >= 0}


def _start_line(line: str) -> dict | None:
    out = dict.fromkeys(("method", "uri", "status", "reason", *KEPT.values())) | {
        "has_authorization": False,
        "has_cookie": False,
        "header_count": 0,
    }
    if line.startswith("HTTP/"):
        version, _, rest = line.partition(" ")
        status, space, reason = rest.partition(" ")
        if not (status.isascii() and status.isdigit() and 100 <= int(status) <= 599):
            return None
        return out | {
            "is_request": False,
            "version": version,
            "status": int(status),
            "reason": shortened(reason, REASON_LIMIT) if space else None,
        }
    parts = line.split(" ")
    if len(parts) < 3 or parts[0] not in METHODS or not parts[2].startswith("HTTP/1."):
        return None
    return out | {"is_request": True, "version": parts[2], "method": parts[0], "uri": shortened(parts[1], URI_LIMIT)}


def parse(payload: bytes, ports: tuple[int | None, int | None], tcp: bool) -> tuple[str, dict] | None:
    """The message at the start of a payload: DNS by port, then over TCP a hello or a head by content."""
    if not payload:
        return None
    if ports[0] in DNS_PORTS or ports[1] in DNS_PORTS:
        framed = tcp and len(payload) > 2 and int.from_bytes(payload[:2], "big") == len(payload) - 2
        found = (parse_dns(payload[2:]) if framed else None) or parse_dns(payload)
        if found:
            return "dns", found | {"complete": True}
    if not tcp:
        return None
    for kind, parser in (("tls", parse_tls), ("http", parse_http)):
        found = parser(payload)
        if found:
            return kind, found
    return None


def message_row(found: tuple[str, dict] | None) -> dict:
    """The columns of MESSAGE."""
    row = dict.fromkeys(("app", "complete", "dns", "tls", "http"))
    if found:
        kind, value = found
        row |= {"app": kind, "complete": value["complete"], kind: {k: v for k, v in value.items() if k != "complete"}}
    return row


ENDPOINTS = ("src_ip", "dst_ip", "src_key", "dst_key", "src_port", "dst_port", "ip_proto")


def messages(packets: DataFrame) -> DataFrame:
    """One row for each packet that holds an application message: ``ord``, endpoints and MESSAGE."""
    dns = F.coalesce(F.col("src_port").isin(*DNS_PORTS) | F.col("dst_port").isin(*DNS_PORTS), F.lit(False))
    may = packets.where(F.col("payload").isNotNull() & ~F.col("fragmented") & ((F.col("ip_proto") == TCP) | dns))
    slim = may.select("index", *ENDPOINTS, "payload")
    schema = T.StructType([*slim.drop("payload").schema.fields, *T._parse_datatype_string(MESSAGE).fields])
    return with_order(slim.mapInArrow(_parser(schema), schema), 0)


def _parser(schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                payload = r.pop("payload")
                found = parse(payload, (r["src_port"], r["dst_port"]), r["ip_proto"] == TCP)
                if found:
                    rows.append(r | message_row(found))
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return run


def with_order(found: DataFrame, origin: int) -> DataFrame:
    """Adds ``ord``: index, origin (0 packet, 1 stream, 2 datagram) and position."""
    return found.withColumn("ord", F.struct("index", F.lit(origin).alias("origin"), F.lit(0).alias("pos"))).drop("index")
