"""Queries that decode, reassemble and analyse traffic whose frames Spark builds from the driver's tables, and SQL for what must come out.

Every row of a table becomes one frame or one split message; the bytes go through the same decoders as
captures do. The SQL never sees the bytes: it states the fields from the table's columns.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.decode import applications, layers
from netlens.functions import text, wire
from netlens.plans import views
from netlens.plans.analysis import Analysis
from netlens.plans.views import CLIENT_BASE, FLAG_SETS, SERVER_BASE, SERVER_PORTS, URL_NAMES, _pick, _sql_ip, _sql_pick
from netlens.reassembly import streams
from netlens.sources import capture
from netlens.storage import materialize

SECOND = 1_000_000_000
START_NS = 1_700_000_000 * SECOND
V6_CLIENT, V6_SERVER = "20010db8" + "00" * 10, "20010db80001" + "00" * 8
#: In what order the three parts of a split message are sent.
ORDERS = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))
RECORDS_OF_FILE = 64


def framed(rows: DataFrame, index: Column, data: Column, link_type: Column | int = 1, wire_len: Column | None = None, ts_ns: Column | None = None) -> DataFrame:
    """The columns of captured frames."""
    built = rows.select(
        F.lit("built").alias("file"),
        index.cast("long").alias("index"),
        (ts_ns if ts_ns is not None else START_NS + index * 1_000_000).alias("ts_ns"),
        (link_type if isinstance(link_type, Column) else F.lit(link_type)).cast("int").alias("link_type"),
        wire_len.alias("wire") if wire_len is not None else F.lit(None).cast("long").alias("wire"),
        data.alias("data"),
    )
    size = F.length("data")
    return built.select("file", "index", "ts_ns", size.alias("captured_len"), F.coalesce("wire", size).cast("int").alias("wire_len"), "link_type", "data")


def _dealt(spark, sf_dir, name: str, key: str) -> DataFrame:
    """A table whose rows are dealt out by key to more tasks than there are cores.

    A file of a few megabytes is one split, but frames are built and decoded where its rows are, at some
    hundred microseconds a row; only the columns in use are moved, before any bytes are built from them."""
    tasks = max(1, spark.sparkContext.defaultParallelism)
    return views.table(spark, sf_dir, name).repartition(4 * tasks, key)


def _layer_frames(spark, sf_dir):
    """One frame for each event, in thirteen kinds of encapsulation."""
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_id") % 13
    payload = wire.zeros(e % 37)
    client, server = CLIENT_BASE + u, SERVER_BASE + u % 7
    sport, dport, flags, seq = 40000 + u % 20000, _pick(SERVER_PORTS, e), _pick(FLAG_SETS, e), F.pmod(e * 1_000_003, F.lit(1 << 32))
    client6, server6 = F.concat(wire.raw(V6_CLIENT), wire.number(u % 65000 + 1, 2)), F.concat(wire.raw(V6_SERVER), wire.number(e % 250 + 1, 2))
    segment, datagram = wire.tcp(sport, dport, seq, flags, payload), wire.udp(sport, dport, payload)
    v4 = lambda proto, body: wire.ipv4(client, server, proto, body, ttl=e % 200 + 1)
    v6 = lambda proto, body: wire.ipv6(client6, server6, proto, body, hops=e % 200 + 1)
    vid = e % 4094 + 1
    whole = wire.ethernet(v4(6, segment))
    data = wire.chosen(kind, [
        whole,
        wire.ethernet(v4(17, datagram), tags=((0x8100, vid),)),
        wire.ethernet(v4(6, wire.tcp(sport, dport, seq, flags, payload, wire.raw("020405b4"))), tags=((0x88A8, 100), (0x8100, vid))),
        wire.ethernet(v6(6, segment), wire.IPV6),
        wire.ethernet(v6(0, wire.hop_options(17, datagram)), wire.IPV6),
        v4(1, wire.icmp(8, F.concat(wire.number(u % 65536, 2), wire.raw("0001"), payload))),
        v6(58, wire.icmp(135, payload)),
        F.concat(wire.raw("02000000"), v4(17, datagram)),
        wire.cooked(v4(6, segment), wire.IPV4),
        wire.cooked(v6(6, segment), wire.IPV6, 2),
        wire.ethernet(wire.arp(e % 2 + 1, 0x020000000000 + u, client, server), wire.ARP),
        F.substring(whole, 1, 44),
        whole,
    ])
    links = F.element_at(F.array(*map(F.lit, (1, 1, 1, 1, 1, 101, 101, 0, 113, 276, 1, 1, 147))), (kind + 1).cast("int"))
    cut = F.when(kind == 11, 54 + e % 37)
    return framed(_dealt(spark, sf_dir, "events", "event_id"), e, data, links, cut, F.unix_micros(F.col("ts").cast("timestamp")) * 1000)


def decoded_layers(spark, sf_dir):
    """Link, network and transport fields of one frame for each event."""
    p = layers.decode(_layer_frames(spark, sf_dir))
    return p.select(
        "index",
        "ts_ns",
        "captured_len",
        "wire_len",
        "link_type",
        "ethertype",
        F.array_join(F.transform("eth.vlans", lambda v: v["vid"].cast("string")), ",").alias("vlans"),
        "src_ip",
        "dst_ip",
        "ip_proto",
        "src_port",
        "dst_port",
        "tcp_flags",
        F.col("tcp.seq").alias("seq"),
        F.col("tcp.options.mss").alias("mss"),
        F.coalesce("ip4.ttl", "ip6.hop_limit").alias("hops"),
        F.col("ip6.extension_headers").alias("extension_headers"),
        F.col("icmp.type").alias("icmp_type"),
        F.col("icmp.echo_id").alias("echo_id"),
        F.concat_ws(" ", F.col("arp.op").cast("string"), "arp.sender_mac", "arp.sender_ip", "arp.target_ip").alias("arp"),
        "payload_at",
        "payload_len",
        F.array_join("warnings", ";").alias("warnings"),
    )


def capture_records(spark, sf_dir):
    """Records of capture files in three formats, each of the frames of 64 events."""
    e = F.col("event_id")
    ts = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + e % 1000
    data = wire.text(F.concat("event_type", F.lit("#"), e.cast("string")))
    rows = views.table(spark, sf_dir, "events").select(
        F.call_function("div", e, F.lit(RECORDS_OF_FILE)).alias("g"), e.alias("e"), ts.alias("ts"), (F.length(data) + e % 5).alias("wire"), data.alias("data")
    )
    one = [
        wire.pcap_record(F.col("ts"), F.col("wire"), F.col("data")),
        wire.pcap_record(F.col("ts"), F.col("wire"), F.col("data"), True, False),
        wire.pcapng_block(F.col("ts"), F.col("wire"), F.col("data")),
    ]
    packed = rows.select("g", F.struct("e", wire.chosen(F.col("g") % 3, one).alias("r")).alias("x")).groupBy("g").agg(F.sort_array(F.collect_list("x")).alias("x"))
    body = wire.joined(F.transform("x", lambda x: x["r"]))
    files = packed.select(
        F.format_string("built-%d", "g").alias("path"),
        wire.chosen(F.col("g") % 3, [wire.pcap_file(1, body), wire.pcap_file(101, body, True, False), wire.pcapng_file(113, body)]).alias("content"),
    )
    return capture.records_of(files).select("file", "n", "ts_ns", "captured_len", "wire_len", "link_type", F.md5("data").alias("digest"), "error")


def _pages(spark, sf_dir):
    tasks = max(1, spark.sparkContext.defaultParallelism)
    return views.url_names(spark, sf_dir).withColumnRenamed("index", "i").repartition(4 * tasks, "i")


def _exchange(rows: DataFrame, back: Column, port: int, payload: Column, base: int, tcp: Column | bool = True) -> DataFrame:
    """A frame for each page: from its client to its server, or back, with the server's port."""
    i = F.col("i")
    client, server, sport = CLIENT_BASE + 65536 + i, SERVER_BASE + 65536 + i, 30000 + i % 30000
    ends = lambda a, b: F.when(back, b).otherwise(a)
    ports = ends(sport, F.lit(port)), ends(F.lit(port), sport)
    over = tcp if isinstance(tcp, Column) else F.lit(tcp)
    body = F.when(over, wire.tcp(*ports, i * 1000 + 1, 24, payload)).otherwise(wire.udp(*ports, payload))
    packet = wire.ipv4(ends(client, server), ends(server, client), F.when(over, 6).otherwise(17), body)
    return framed(rows, i + base, wire.ethernet(packet))


def _dns_frames(spark, sf_dir, base=0):
    i = F.col("i")
    back, kind, over = i % 2 == 1, _pick((1, 28, 16), i), i % 7 == 0
    denied = back & (i % 5 == 1)
    answers = wire.chosen(i % 3, [
        wire.dns_answer(1, i % 600, F.concat(wire.raw("cb0071"), wire.number(i % 9, 1))),
        wire.dns_answer(28, i % 600, F.concat(wire.raw(V6_CLIENT), wire.number(i % 9 + 1, 2))),
        wire.dns_answer(16, i % 600, wire.prefixed(wire.text(F.concat(F.lit("v="), i.cast("string"))), 1)),
    ])
    question = F.when(i % 11 == 0, wire.raw("c00c")).otherwise(wire.dns_name(F.col("host")))
    flags = F.when(back, 0x8180).otherwise(0x0100) + F.when(denied, 3).otherwise(0)
    message = wire.dns(question, kind, flags, F.when(back & ~denied, answers).otherwise(wire.raw("")))
    payload = F.when(over, wire.prefixed(message, 2)).otherwise(message)
    return _exchange(_pages(spark, sf_dir), back, 53, payload, base, over)


def dns_messages(spark, sf_dir):
    """DNS queries and responses of each page's host, over UDP and TCP; a name that points to itself is no message."""
    found = applications.messages(layers.decode(_dns_frames(spark, sf_dir)))
    question, answer = F.col("dns.questions")[0], F.get("dns.answers", 0)
    return found.select(
        "ord.index",
        "ip_proto",
        "dns.is_response",
        "dns.rcode",
        question["name"].alias("name"),
        question["qtype"].alias("qtype"),
        answer["name"].alias("answer_name"),
        answer["data"].alias("answer"),
        answer["ttl"].alias("ttl"),
    )


def _tls_frames(spark, sf_dir, base=0):
    i, none = F.col("i"), wire.raw("")
    back, version = i % 4 == 0, _pick((769, 770, 771, 772, 771), i)
    legacy, newest = F.least(version, F.lit(771)), version == 772
    name = wire.text(F.col("host"))
    named = wire.extension(0, wire.prefixed(F.concat(wire.raw("00"), wire.prefixed(name, 2)), 2))
    spoken = lambda *names: wire.extension(16, wire.prefixed(F.concat(*(wire.prefixed(wire.text(n), 1) for n in names)), 2))
    offered = F.concat(
        wire.extension(0x2A2A, none),
        F.when(i % 7 != 0, named).otherwise(none),
        F.when(i % 3 == 0, spoken("h2", "http/1.1")).otherwise(none),
        wire.extension(10, wire.prefixed(wire.numbers(0x1A1A, 29, i % 3 + 23), 2)),
        wire.extension(11, wire.raw("0100")),
        F.when(newest, wire.extension(43, wire.prefixed(wire.numbers(0x0A0A, 772, 771), 1))).otherwise(none),
    )
    answered = F.concat(F.when(newest, wire.extension(43, wire.numbers(772))).otherwise(none), F.when(i % 3 == 0, spoken("h2")).otherwise(none))
    cipher = i % 6 + 49195
    payload = F.when(back, wire.hello(False, legacy, wire.numbers(cipher), answered)).otherwise(wire.hello(True, legacy, wire.numbers(0x0A0A, 4865, cipher), offered))
    return _exchange(_pages(spark, sf_dir), back, 443, payload, base)


def tls_hellos(spark, sf_dir):
    """Client and server hellos of each page's host, with fingerprints."""
    found = applications.messages(layers.decode(_tls_frames(spark, sf_dir)))
    return found.select("ord.index", "tls.kind", "tls.version", "tls.legacy_version", "tls.sni", F.array_join("tls.alpn", ",").alias("alpn"), "tls.ja3_text", "tls.ja3", "complete")


def _http_frames(spark, sf_dir, base=0):
    i = F.col("i")
    back = i % 3 == 0
    path = F.regexp_extract("url", "^[^:]*://[^/]*([^#]*)", 1)
    some = lambda when, line: F.when(when, line)
    request = wire.lines(
        F.concat(_pick(("GET", "POST", "HEAD"), i), F.lit(" "), path, F.lit(" HTTP/1.1")),
        F.concat(_pick(("Host: ", "HOST:", "host:  "), F.call_function("div", i, F.lit(3))), F.col("host")),
        F.concat(F.lit("User-Agent: agent/"), (i % 6).cast("string")),
        some(i % 9 == 1, F.lit("Authorization: Basic eDp5")),
        some(i % 5 == 2, F.lit("Cookie: a=b")),
    )
    response = wire.lines(
        F.concat(F.lit("HTTP/1.0 "), _pick((200, 404), F.call_function("div", i, F.lit(3))).cast("string"), F.lit(" As said")),
        some(i % 2 == 0, F.lit("Content-Type: text/html")),
        F.concat(F.lit("Content-Length: "), i.cast("string")),
    )
    end = F.when(i % 10 == 9, wire.raw("")).otherwise(wire.raw("0d0a"))
    return _exchange(_pages(spark, sf_dir), back, 80, F.concat(F.when(back, response).otherwise(request), end), base)


def http_heads(spark, sf_dir):
    """Requests and responses of each page."""
    found = applications.messages(layers.decode(_http_frames(spark, sf_dir)))
    fields = ("is_request", "version", "method", "uri", "status", "reason", "host", "user_agent", "content_type", "content_length", "has_authorization", "has_cookie", "header_count", "summary")
    return found.select("ord.index", "complete", *(f"http.{f}" for f in fields))


def _parts(rows: DataFrame, key: Column, pieces: list[Column], odd: Column, at_end: Column | None = None) -> DataFrame:
    """Rows (place, part) of split messages: what is sent first, second and third, what disagrees (3) and what ends it (4) before the third.

    ``part``: 0 to 2, or 3 for the piece that disagrees, 4 for an end, 5 for an opening."""
    order = F.element_at(F.array(*(F.array(*map(F.lit, o)) for o in ORDERS)), (key % 6 + 1).cast("int"))
    sent = [F.struct(F.lit(place).alias("place"), order[n].alias("part"), wire.chosen(order[n], pieces).alias("piece")) for n, place in enumerate((1, 2, 5))]
    extra = [F.when(key % 5 == 0, F.struct(F.lit(3).alias("place"), F.lit(3).alias("part"), odd.alias("piece")))]
    if at_end is not None:
        extra += [
            F.when(key % 13 == 0, F.struct(F.lit(4).alias("place"), F.lit(4).alias("part"), wire.raw("").alias("piece"))),
            F.when(key % 2 == 0, F.struct(F.lit(0).alias("place"), F.lit(5).alias("part"), wire.raw("").alias("piece"))),
        ]
    whole = F.filter(F.array(*sent, *extra), lambda x: x.isNotNull() & ~((key % 11 == 0) & (x["part"] == 2)))
    return rows.select(key.alias("k"), F.inline(whole))


def _split_requests(spark, sf_dir, base=0):
    """A request for each customer in three segments, some wrapping around, some contradicted, ended early or never whole."""
    k = F.col("c_custkey")
    number = k.cast("string")
    request = wire.lines(
        F.concat(F.lit("GET /"), F.lpad(number, 12, "0"), F.lit(" HTTP/1.1")),
        F.lit("X-Pad: " + "p" * 30),
        F.concat(F.lit("Host: c"), number, F.lit(".example.net\r\n")),
    )
    parts = _parts(
        _dealt(spark, sf_dir, "customer", "c_custkey"),
        k,
        [F.substring(request, 1, 40), F.substring(request, 41, 20), F.substring(request, 61, 1000)],
        wire.text("q" * 8),
        F.lit(True),
    )
    k = F.col("k")
    start = F.when(k % 3 == 0, F.lit((1 << 32) - 30)).otherwise(k * 7919 % (1 << 32))
    offset = F.element_at(F.array(*map(F.lit, (1, 41, 61, 45, 61, 0))), F.col("part") + 1)
    flags = F.when(F.col("part") == 4, 17).when(F.col("part") == 5, 2).otherwise(24)
    segment = wire.tcp(40000, 80, F.pmod(start + offset, F.lit(1 << 32)), flags, F.col("piece"))
    packet = wire.ipv4(CLIENT_BASE + (1 << 20) + k, SERVER_BASE + (1 << 20) + k, 6, segment)
    return framed(parts, k * 10 + F.col("place") + base, wire.ethernet(packet))


def recovered_streams(spark, sf_dir):
    """Requests put together from segments in any order: the segment that completed each, and contradictions."""
    # Segments are read twice, for the bases of their streams and for themselves, but decoded once.
    packets = materialize(streams.segment_columns(layers.decode(_split_requests(spark, sf_dir))), "segments")
    found = streams.recover_streams(packets)
    http = F.from_json("message", "http struct<host:string,uri:string>")["http"]
    return found.select("src_ip", "index", http["host"].alias("host"), http["uri"].alias("uri"), "conflicts")


def _split_datagrams(spark, sf_dir, base=0):
    """A DNS query for each part in three fragments, some contradicted or never whole."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("p"), k.cast("string"), F.lit(".frag.example"))
    datagram = wire.udp(30000 + k % 20000, 53, wire.dns(wire.dns_name(name), 1, 0x0100))
    pieces = [F.substring(datagram, 1, 16), F.substring(datagram, 17, 8), F.substring(datagram, 25, 1000)]
    parts = _parts(_dealt(spark, sf_dir, "part", "p_partkey"), k, pieces, wire.raw("ff" * 8))
    k, part = F.col("k"), F.col("part")
    offset = F.element_at(F.array(*map(F.lit, (0, 16, 24, 16))), part + 1)
    packet = wire.ipv4(CLIENT_BASE + (1 << 21) + k, SERVER_BASE, 17, F.col("piece"), k % 65536, offset, part != 2)
    return framed(parts, k * 10 + F.col("place") + base, wire.ethernet(packet))


def recovered_datagrams(spark, sf_dir):
    """Datagrams put together from fragments in any order: the fragment that completed each, its query, and contradictions."""
    found = streams.recover_datagrams(layers.decode(_split_datagrams(spark, sf_dir)))
    dns = F.from_json("message", "dns struct<questions:array<struct<name:string>>>")["dns"]
    return found.select("src_ip", "fragment_id", "index", dns["questions"][0]["name"].alias("name"), "src_port", "conflicts")


def _probes(spark, sf_dir, base=0):
    """A bare SYN for each event, to a port of its user's server."""
    e, u = F.col("event_id"), F.col("user_id")
    segment = wire.tcp(1024 + e % 60000, 10000 + e % 1000, e % 1_000_000, 2, wire.raw(""))
    return framed(_dealt(spark, sf_dir, "events", "event_id"), e + base, wire.ethernet(wire.ipv4(CLIENT_BASE + u, SERVER_BASE + u % 7, 6, segment)))


def _claims(spark, sf_dir, base=0):
    """An ARP message for each supplier."""
    s = F.col("s_suppkey")
    message = wire.arp(s % 3, 0x020000000000 + s % 16, 0x0A000100 + F.col("s_nationkey"), 0x0A000100 + s % 25)
    return framed(_dealt(spark, sf_dir, "supplier", "s_suppkey"), s + base, wire.ethernet(message, wire.ARP))


def capture_findings(spark, sf_dir):
    """Every finding on one capture of all these frames."""
    built = (_http_frames, _tls_frames, _dns_frames, _split_requests, _split_datagrams, _probes, _claims)
    whole = None
    for number, frames in enumerate(built):
        one = frames(spark, sf_dir, number << 36)
        whole = one if whole is None else whole.unionByName(one)
    analysis = Analysis(whole.withColumn("error", F.lit(None).cast("string")))
    return analysis.findings().select("id", "severity", "title", F.size("evidence").alias("evidence"))


QUERIES = {f.__name__: f for f in (
    decoded_layers, capture_records, dns_messages, tls_hellos, http_heads, recovered_streams, recovered_datagrams, capture_findings,
)}

_P = f"WITH {URL_NAMES}, p AS (SELECT idx AS i, host, url FROM url_names)"
_CLIENT6, _SERVER6 = "'2001:db8::' || printf('%x', u % 65000 + 1)", "'2001:db8:1::' || printf('%x', e % 250 + 1)"
_DNS = "d AS (SELECT *, i % 2 = 1 AS back, i % 2 = 1 AND i % 5 = 1 AS denied FROM p WHERE i % 11 <> 0)"
_TLS = f"v AS (SELECT *, {_sql_pick((769, 770, 771, 772, 771), 'i')} AS version FROM p), t AS (SELECT *, i % 4 = 0 AS back, least(version, 771) AS legacy FROM v)"
_STREAMS = """s AS (SELECT *, c_custkey AS k, c_custkey % 6 IN (1, 4) AS middle_last, c_custkey % 11 = 0 AS never, c_custkey % 13 = 0 AS ended FROM customer),
streams AS (SELECT k, NOT never AND NOT ended AS whole, CASE WHEN k % 5 = 0 AND NOT (ended AND middle_last) THEN 1 ELSE 0 END AS conflicts FROM s)"""
# A contradicting piece that comes before the middle one completes the datagram in its stead.
_DATAGRAMS = """g AS (SELECT p_partkey AS k, p_partkey % 11 <> 0 AS whole, p_partkey % 5 = 0 AS odd, p_partkey % 6 IN (1, 4) AS middle_last FROM part),
datagrams AS (SELECT k, whole, whole AND odd AND middle_last AS twisted, whole AND NOT (odd AND middle_last) AS good, CASE WHEN odd AND NOT (whole AND middle_last) THEN 1 ELSE 0 END AS conflicts FROM g)"""
ORACLE_SQL = {
    "decoded_layers": f"""WITH e AS (SELECT event_id AS e, user_id AS u, event_id % 13 AS k, event_id % 37 AS n, epoch_us(ts) * 1000 AS ts_ns FROM events),
f AS (SELECT *, k IN (0, 1, 2, 5, 7, 8, 11) AS v4, k IN (3, 4, 6, 9) AS v6, k IN (0, 2, 3, 8, 9) AS is_tcp, k IN (1, 4, 7) AS is_udp,
  [54, 46, 66, 74, 70, NULL, NULL, 32, 56, 80, NULL, NULL, NULL][k + 1] AS pos FROM e),
s AS (SELECT *, CASE k WHEN 5 THEN 28 + n WHEN 6 THEN 44 + n WHEN 10 THEN 42 WHEN 11 THEN 44 WHEN 12 THEN 54 + n ELSE pos + n END AS size FROM f)
SELECT e AS index, ts_ns, CAST(size AS INT) AS captured_len, CAST(CASE k WHEN 11 THEN 54 + n ELSE size END AS INT) AS wire_len, [1, 1, 1, 1, 1, 101, 101, 0, 113, 276, 1, 1, 147][k + 1] AS link_type,
  CASE WHEN v4 THEN 2048 WHEN v6 THEN 34525 WHEN k = 10 THEN 2054 END AS ethertype,
  CASE WHEN k = 1 THEN CAST(e % 4094 + 1 AS VARCHAR) WHEN k = 2 THEN '100,' || (e % 4094 + 1) WHEN k IN (0, 3, 4, 10, 11) THEN '' END AS vlans,
  CASE WHEN v4 THEN {_sql_ip(f'{CLIENT_BASE} + u')} WHEN v6 THEN {_CLIENT6} END AS src_ip, CASE WHEN v4 THEN {_sql_ip(f'{SERVER_BASE} + u % 7')} WHEN v6 THEN {_SERVER6} END AS dst_ip,
  CASE WHEN is_tcp OR k = 11 THEN 6 WHEN is_udp THEN 17 WHEN k = 5 THEN 1 WHEN k = 6 THEN 58 END AS ip_proto,
  CASE WHEN is_tcp OR is_udp THEN 40000 + u % 20000 END AS src_port, CASE WHEN is_tcp OR is_udp THEN {_sql_pick(SERVER_PORTS, 'e')} END AS dst_port,
  CASE WHEN is_tcp THEN {_sql_pick(FLAG_SETS, 'e')} END AS tcp_flags, CASE WHEN is_tcp THEN e * 1000003 % 4294967296 END AS seq, CASE WHEN k = 2 THEN 1460 END AS mss,
  CASE WHEN v4 OR v6 THEN e % 200 + 1 END AS hops, CASE WHEN v6 THEN CASE k WHEN 4 THEN 1 ELSE 0 END END AS extension_headers,
  CASE k WHEN 5 THEN 8 WHEN 6 THEN 135 END AS icmp_type, CASE WHEN k = 5 THEN u % 65536 END AS echo_id,
  CASE WHEN k = 10 THEN (e % 2 + 1) || ' ' || regexp_replace(printf('02%010x', u), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') || ' ' || {_sql_ip(f'{CLIENT_BASE} + u')} || ' ' || {_sql_ip(f'{SERVER_BASE} + u % 7')} ELSE '' END AS arp,
  CAST(pos AS INT) AS payload_at, CAST(CASE WHEN k IN (10, 11, 12) THEN 0 ELSE n END AS INT) AS payload_len,
  CASE k WHEN 11 THEN 'tcp: truncated' WHEN 12 THEN 'unsupported link type LINKTYPE_147' ELSE '' END AS warnings FROM s""",
    "capture_records": f"""WITH e AS (SELECT event_id AS e, event_id // {RECORDS_OF_FILE} AS g, epoch_us(ts) * 1000 + event_id % 1000 AS ts, event_type || '#' || event_id AS data FROM events)
SELECT 'built-' || g AS file, row_number() OVER (PARTITION BY g ORDER BY e) AS n, CASE g % 3 WHEN 1 THEN ts // 1000 * 1000 ELSE ts END AS ts_ns, CAST(strlen(data) AS INT) AS captured_len, CAST(strlen(data) + e % 5 AS INT) AS wire_len,
  CASE g % 3 WHEN 0 THEN 1 WHEN 1 THEN 101 ELSE 113 END AS link_type, md5(data) AS digest, CAST(NULL AS VARCHAR) AS error FROM e""",
    "dns_messages": f"""{_P}, {_DNS} SELECT i AS index, CASE WHEN i % 7 = 0 THEN 6 ELSE 17 END AS ip_proto, back AS is_response, CASE WHEN denied THEN 3 ELSE 0 END AS rcode, host AS name, {_sql_pick((1, 28, 16), 'i')} AS qtype,
  CASE WHEN back AND NOT denied THEN host END AS answer_name, CASE WHEN back AND NOT denied THEN CASE i % 3 WHEN 0 THEN '203.0.113.' || i % 9 WHEN 1 THEN '2001:db8::' || (i % 9 + 1) ELSE 'v=' || i END END AS answer,
  CASE WHEN back AND NOT denied THEN i % 600 END AS ttl FROM d""",
    "tls_hellos": f"""{_P}, {_TLS}, j AS (SELECT *, CASE WHEN back THEN legacy || ',' || (i % 6 + 49195) || ',' || concat_ws('-', CASE WHEN version = 772 THEN '43' END, CASE WHEN i % 3 = 0 THEN '16' END)
  ELSE legacy || ',4865-' || (i % 6 + 49195) || ',' || concat_ws('-', CASE WHEN i % 7 <> 0 THEN '0' END, CASE WHEN i % 3 = 0 THEN '16' END, '10-11', CASE WHEN version = 772 THEN '43' END) || ',29-' || (i % 3 + 23) || ',0' END AS ja3_text FROM t)
SELECT i AS index, CASE WHEN back THEN 'server' ELSE 'client' END AS kind, version, legacy AS legacy_version, CASE WHEN NOT back AND i % 7 <> 0 THEN host END AS sni, CASE WHEN i % 3 <> 0 THEN '' WHEN back THEN 'h2' ELSE 'h2,http/1.1' END AS alpn, ja3_text, md5(ja3_text) AS ja3, true AS complete FROM j""",
    "http_heads": f"""{_P}, h AS (SELECT *, i % 3 <> 0 AS req, regexp_extract(url, '^[^:]*://[^/]*([^#]*)', 1) AS path FROM p),
r AS (SELECT i AS index, i % 10 <> 9 AS complete, req AS is_request, CASE WHEN req THEN 'HTTP/1.1' ELSE 'HTTP/1.0' END AS version, CASE WHEN req THEN CASE i % 3 WHEN 1 THEN 'POST' ELSE 'HEAD' END END AS method, CASE WHEN req THEN path END AS uri,
  CASE WHEN NOT req THEN CASE i // 3 % 2 WHEN 0 THEN 200 ELSE 404 END END AS status, CASE WHEN NOT req THEN 'As said' END AS reason, CASE WHEN req THEN host END AS host, CASE WHEN req THEN 'agent/' || i % 6 END AS user_agent,
  CASE WHEN NOT req AND i % 2 = 0 THEN 'text/html' END AS content_type, CASE WHEN NOT req THEN i END AS content_length, req AND i % 9 = 1 AS has_authorization, req AND i % 5 = 2 AS has_cookie FROM h)
SELECT *, CAST(CASE WHEN is_request THEN 2 + has_authorization::INT + has_cookie::INT ELSE 1 + (content_type IS NOT NULL)::INT END AS INT) AS header_count, CASE WHEN is_request THEN method || ' ' || host || uri ELSE concat_ws(' ', status, content_type) END AS summary FROM r""",
    "recovered_streams": f"""WITH {_STREAMS} SELECT {_sql_ip(f'{CLIENT_BASE + (1 << 20)} + k')} AS src_ip, CASE WHEN whole THEN k * 10 + 5 ELSE -1 END AS index, CASE WHEN whole THEN 'c' || k || '.example.net' END AS host,
  CASE WHEN whole THEN '/' || lpad(CAST(k AS VARCHAR), 12, '0') END AS uri, conflicts FROM streams""",
    "recovered_datagrams": f"""WITH {_DATAGRAMS} SELECT {_sql_ip(f'{CLIENT_BASE + (1 << 21)} + k')} AS src_ip, k % 65536 AS fragment_id, CASE WHEN twisted THEN k * 10 + 3 WHEN whole THEN k * 10 + 5 ELSE -1 END AS index, CASE WHEN good THEN 'p' || k || '.frag.example' END AS name,
  CASE WHEN whole THEN 30000 + k % 20000 END AS src_port, conflicts FROM datagrams""",
    "capture_findings": f"""{_P}, {_DNS}, {_TLS}, {_STREAMS}, {_DATAGRAMS},
names AS (SELECT DISTINCT host AS name FROM d UNION SELECT 'p' || k || '.frag.example' FROM datagrams WHERE good),
parents AS (SELECT regexp_extract(name, '([^.]*\\.)?[^.]*$') AS parent, name FROM names),
claims AS (SELECT s_nationkey AS ip FROM supplier WHERE s_suppkey % 3 = 2 GROUP BY 1 HAVING count(DISTINCT s_suppkey % 16) > 1),
scans AS (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_id % 1000) >= 15),
found(id, severity, title, n, evidence) AS (
SELECT 'arp-address-conflict', 'high', '%d IP(s) claimed by more than one MAC', count(*), NULL FROM claims
UNION ALL SELECT 'cleartext-http-credentials', 'high', 'HTTP Authorization sent in the clear on %d request(s)', count(*), NULL FROM p WHERE i % 3 <> 0 AND i % 9 = 1
UNION ALL SELECT 'dns-subdomain-volume', 'high', '%d domain(s) queried with unusually many subdomains', count(*), NULL FROM (SELECT parent FROM parents WHERE parent <> name GROUP BY 1 HAVING count(*) >= 40)
UNION ALL SELECT 'port-scan', 'high', '%d host(s) exhibiting port-scan behaviour', count(*), NULL FROM scans
UNION ALL SELECT 'obsolete-tls', 'medium', '%d TLS handshake(s) negotiated a deprecated version', count(*), NULL FROM t WHERE version <= 770
UNION ALL SELECT 'cleartext-service', 'low', '%d unencrypted service flow(s)', (SELECT count(*) FROM p) + (SELECT count(*) FROM streams), NULL
UNION ALL SELECT 'tcp-overlap-conflict', 'medium', '%d TCP segment(s) overlapped earlier data with different bytes', CAST(sum(conflicts) AS BIGINT), 1 FROM streams
UNION ALL SELECT 'ip-fragment-overlap', 'medium', '%d IP fragment(s) overlapped earlier data with different bytes', CAST(sum(conflicts) AS BIGINT), 1 FROM datagrams
UNION ALL SELECT 'capture-quality', 'info', 'Capture quality notes', 2, 2)
SELECT id, severity, replace(title, '%d', CAST(n AS VARCHAR)) AS title, CAST(coalesce(evidence, least(n, 12)) AS INT) AS evidence FROM found WHERE n > 0""",
}
