"""Traffic queries over derived packets, and the same in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.functions import names
from netlens.functions.text import whole_div
from netlens.operators import beacon, flows
from netlens.plans import views
from netlens.plans.views import PKT, PKT_LINES, PKT_SCAN, _sql_ip

FLOW_FACTS = (
    "flow", "client_ip", "client_port", "server_ip", "server_port", "service", "service_port", "scope", "packets", "bytes",
    "client_packets",
    "server_packets",
    "up_payload",
    "down_payload",
    "upload_ratio",
    "duration",
    "handshake",
    "reset",
    "unanswered",
)
TOP = 20


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.flows(views.pkt(spark, sf_dir))


def flow_table(spark, sf_dir):
    return _flows(spark, sf_dir).select(*FLOW_FACTS)


def top_flows(spark, sf_dir):
    return flows.top_flows(_flows(spark, sf_dir), TOP).select("flow", "bytes", "packets")


def host_table(spark, sf_dir):
    return flows.hosts(views.pkt(spark, sf_dir)).drop("key")


def top_talkers(spark, sf_dir):
    return flows.top_talkers(flows.hosts(views.pkt(spark, sf_dir)), TOP).select("ip", "total_bytes", "peers", "private")


def host_table_lines(spark, sf_dir):
    return flows.hosts(views.pkt_lines(spark, sf_dir)).drop("key")


def flow_table_lines(spark, sf_dir):
    return flows.flows(views.pkt_lines(spark, sf_dir)).select("flow", "packets", "bytes", "scope", "service", "up_payload")


def service_table(spark, sf_dir):
    return flows.services(_flows(spark, sf_dir))


def top_services(spark, sf_dir):
    return flows.top_services(flows.services(_flows(spark, sf_dir)), TOP)


def timeline(spark, sf_dir):
    return flows.timeline(views.pkt(spark, sf_dir))


def summary(spark, sf_dir):
    return flows.summary(flows.counters(views.pkt(spark, sf_dir)))


def beacon_candidates(spark, sf_dir):
    packets = views.pkt(spark, sf_dir)
    scored = beacon.scores(packets, flows.flows(packets))
    gate = (
        F.col("client_packets") >= beacon.LEAST_PACKETS
    ) & (F.col("jitter") <= beacon.MOST_JITTER) & F.col("interval").between(beacon.LEAST_INTERVAL, beacon.MOST_INTERVAL)
    return scored.select(
        "flow",
        "interval",
        "jitter",
        "confidence",
        "samples",
        "total_seconds",
        "samples_truncated",
        gate.alias("passes"),
    ).orderBy(F.desc("confidence"), "flow")


def beacon_gated(spark, sf_dir):
    packets = views.pkt(spark, sf_dir)
    return beacon.gated(
        beacon.scores(packets, flows.flows(packets)),
        most_jitter=0.45,
    ).select("flow", "interval", "jitter", "confidence")


def syn_ports(spark, sf_dir):
    return flows.syn_ports(views.pkt_scan(spark, sf_dir)).select("src_ip", "dst_ip", "ports")


def port_scans(spark, sf_dir):
    return flows.port_scans(flows.syn_ports(views.pkt_scan(spark, sf_dir)))


def unanswered_syns(spark, sf_dir):
    return flows.flows(views.pkt_scan(spark, sf_dir)).agg(
        F.count_if("unanswered").alias("unanswered"),
        F.count("*").alias("flows"),
    )


def upload_heavy(spark, sf_dir):
    return flows.upload_heavy(_flows(spark, sf_dir), 2000, 1.5).select(
        "flow",
        "up_payload",
        "down_payload",
        "upload_ratio",
        "duration",
    )


def cleartext_services(spark, sf_dir):
    return flows.cleartext_services(_flows(spark, sf_dir)).drop("service_ip")


def flow_search(spark, sf_dir):
    return flows.search(_flows(spark, sf_dir), "10.0.0.1:", 2000).select("flow", "bytes")


def reset_flows(spark, sf_dir):
    return _flows(spark, sf_dir).where("reset").select("flow", "client_ip")


def direction_stats(spark, sf_dir):
    return _flows(spark, sf_dir).select(
        "a_ip",
        "a_port",
        "b_ip",
        "b_port",
        names.protocol(F.col("ip_proto")).alias("protocol"),
        "a_packets",
        "a_bytes",
        "a_payload",
        names.flags_text(F.col("a_flags")).alias("a_flags"),
        "b_packets",
        "b_bytes",
        "b_payload",
        names.flags_text(F.col("b_flags")).alias("b_flags"),
        "initiator_a",
    )


def first_packets(spark, sf_dir):
    """The packets up to an index limit, as ``--limit`` has them."""
    return views.pkt(spark, sf_dir).where(F.col("index") <= 100).select("index", "src_ip", "dst_ip", "wire_len")


def flow_sessions(spark, sf_dir):
    """Sessions of a client with an hour's silence between them (an extension)."""
    packets = views.pkt(spark, sf_dir).withColumn("at", F.timestamp_micros(whole_div(F.col("ts_ns"), 1000)))
    return packets.groupBy("src_ip", F.session_window("at", "1 hour").alias("s")).agg(
        F.count("*").alias("packets"),
        F.sum("wire_len").alias("bytes"),
    ).select(
        "src_ip",
        F.unix_micros("s.start").alias("start_us"),
        "packets",
        "bytes",
    )


def _case(port: str, proto: str) -> str:
    arms = [
        f"WHEN {port} IN ({', '.join(map(str, ports))})" + {
            "T": f" AND {proto} = 6",
            "U": f" AND {proto} <> 6",
            "B": "",
        }[kind] + f" THEN '{name}'"
        for name, ports, kind in names.SERVICES
    ]
    return "CASE " + " ".join(arms) + " END"


def _private(n: str) -> str:
    from netlens.functions.addresses import PRIVATE_V4, _number

    return "(" + " OR ".join(f"{n} BETWEEN {_number(a)} AND {_number(b)}" for a, b in PRIVATE_V4) + ")"


def _flow_sql(source: str) -> str:
    """CTEs ``flows`` with the facts of each flow over a packet CTE."""
    text = lambda ip, port: f"{_sql_ip(ip)} || ':' || {port}"
    return f"""keyed AS (SELECT *, src < dst OR (src = dst AND src_port <= dst_port) AS ab FROM {source}),
ends AS (SELECT *, CASE WHEN ab THEN src ELSE dst END AS a, CASE WHEN ab THEN src_port ELSE dst_port END AS ap, CASE WHEN ab THEN dst ELSE src END AS b, CASE WHEN ab THEN dst_port ELSE src_port END AS bp,
  coalesce((tcp_flags & 2) <> 0 AND (tcp_flags & 16) = 0, false) AS syn FROM keyed),
grouped AS (SELECT a, ap, b, bp, ip_proto,
  count(*) FILTER (ab) AS a_packets, count(*) FILTER (NOT ab) AS b_packets,
  CAST(coalesce(sum(wire_len) FILTER (ab), 0) AS BIGINT) AS a_bytes, CAST(coalesce(sum(wire_len) FILTER (NOT ab), 0) AS BIGINT) AS b_bytes,
  CAST(coalesce(sum(payload_len) FILTER (ab), 0) AS BIGINT) AS a_payload, CAST(coalesce(sum(payload_len) FILTER (NOT ab), 0) AS BIGINT) AS b_payload,
  coalesce(bit_or(tcp_flags) FILTER (ab), 0) AS a_flags, coalesce(bit_or(tcp_flags) FILTER (NOT ab), 0) AS b_flags,
  min(ts_us) AS first_us, max(ts_us) AS last_us, bool_or(syn) AS handshake, coalesce(arg_min(ab, idx) FILTER (syn), arg_min(ab, idx)) AS initiator_a FROM ends GROUP BY ALL),
named AS (SELECT *, {_case('ap', 'ip_proto')} AS sa, {_case('bp', 'ip_proto')} AS sb FROM grouped),
sided AS (SELECT *, CASE WHEN handshake OR ap = bp THEN initiator_a WHEN sa IS NOT NULL AND sb IS NULL THEN false WHEN sa IS NULL AND sb IS NOT NULL THEN true ELSE ap > bp END AS ca FROM named),
both_sides AS (SELECT *, CASE WHEN ca THEN a ELSE b END AS c, CASE WHEN ca THEN ap ELSE bp END AS cp, CASE WHEN ca THEN b ELSE a END AS s, CASE WHEN ca THEN bp ELSE ap END AS sp,
  CASE WHEN ca THEN sa ELSE sb END AS sc, CASE WHEN ca THEN sb ELSE sa END AS ss,
  CASE WHEN ca THEN a_packets ELSE b_packets END AS client_packets, CASE WHEN ca THEN b_packets ELSE a_packets END AS server_packets,
  CASE WHEN ca THEN a_payload ELSE b_payload END AS up_payload, CASE WHEN ca THEN b_payload ELSE a_payload END AS down_payload FROM sided),
flows AS (SELECT *, {text('a', 'ap')} || ' <-> ' || {text('b', 'bp')} || CASE ip_proto WHEN 6 THEN ' TCP' ELSE ' UDP' END AS flow,
  {_sql_ip('c')} AS client_ip, cp AS client_port, {_sql_ip('s')} AS server_ip, sp AS server_port, coalesce(ss, sc) AS service, CASE WHEN ss IS NOT NULL THEN sp WHEN sc IS NOT NULL THEN cp END AS service_port,
  CASE WHEN {_private('c')} THEN CASE WHEN {_private('s')} THEN 'internal' ELSE 'outbound' END ELSE CASE WHEN {_private('s')} THEN 'inbound' ELSE 'external' END END AS scope,
  a_packets + b_packets AS packets, a_bytes + b_bytes AS bytes,
  CASE WHEN down_payload > 0 THEN up_payload / down_payload WHEN up_payload > 0 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END AS upload_ratio,
  (last_us - first_us) * 1000 / 1e9 AS duration, (a_flags & 4) <> 0 OR (b_flags & 4) <> 0 AS reset,
  ip_proto = 6 AND handshake AND server_packets = 0 AND client_packets <= 4 AS unanswered FROM both_sides)"""


def _host_sql(source: str) -> str:
    return f"""sides AS (SELECT src AS ip, dst AS peer, wire_len, true AS sent FROM {source} UNION ALL SELECT dst, src, wire_len, false FROM {source}),
hosts AS (SELECT {_sql_ip('ip')} AS ip, count(*) FILTER (sent) AS sent_packets, CAST(coalesce(sum(wire_len) FILTER (sent), 0) AS BIGINT) AS sent_bytes,
  count(*) FILTER (NOT sent) AS received_packets, CAST(coalesce(sum(wire_len) FILTER (NOT sent), 0) AS BIGINT) AS received_bytes, count(DISTINCT peer) AS peers,
  CAST(sum(wire_len) AS BIGINT) AS total_bytes, {_private('sides.ip')} AS private FROM sides GROUP BY sides.ip)"""


_FLAGS = lambda f: "CASE WHEN {0} = 0 THEN '-' ELSE ".format(f) + " || ".join(
    f"CASE WHEN ({f} & {bit}) <> 0 THEN '{letter}' ELSE '' END"
    for letter, bit in names.TCP_FLAGS
) + " END"
_BEACON = f"""{PKT}, {_flow_sql('pkt')},
mine AS (SELECT e.*, f.flow, f.client_packets FROM ends e JOIN flows f USING (a, ap, b, bp, ip_proto) WHERE e.ab = f.ca),
ordered AS (SELECT flow, client_packets, idx, ts_us, ts_us - lag(ts_us) OVER (PARTITION BY flow ORDER BY idx) AS d FROM mine),
deltas AS (SELECT flow, d * 1000 / 1e9 AS d FROM ordered WHERE d > 0),
medians AS (SELECT flow, median(d) AS interval, count(*) AS samples FROM deltas GROUP BY flow),
spread AS (SELECT flow, median(abs(d - interval)) AS mad FROM deltas JOIN medians USING (flow) GROUP BY flow),
spans AS (SELECT flow, any_value(client_packets) AS client_packets, count(*) AS times, (arg_max(ts_us, idx) - arg_min(ts_us, idx)) * 1000 / 1e9 AS total_seconds FROM ordered GROUP BY flow),
scored AS (SELECT flow, interval, least(mad / interval, 1.0) AS jitter, samples, total_seconds, client_packets FROM medians JOIN spread USING (flow) JOIN spans USING (flow) WHERE samples >= 4 AND times >= 5),
beacons AS (SELECT *, greatest(0.0, least(1.0, (1 - jitter) * (0.6 + 0.4 * greatest(0.0, least(1.0, (samples - 4.0::double) / 26.0))))) AS confidence FROM scored)"""

QUERIES = {f.__name__: f for f in (
    beacon_candidates,
    beacon_gated,
    flow_table,
    top_flows,
    host_table,
    top_talkers,
    host_table_lines,
    flow_table_lines,
    service_table,
    top_services,
    timeline,
    summary,
    syn_ports,
    port_scans,
    unanswered_syns,
    upload_heavy,
    cleartext_services,
    flow_search,
    reset_flows,
    direction_stats,
    first_packets,
    flow_sessions,
)}

_F, _H = f"WITH {PKT}, {_flow_sql('pkt')}", f"WITH {PKT}, {_host_sql('pkt')}"
_S = f"WITH {PKT_SCAN}, tried AS (SELECT src, dst, count(DISTINCT dst_port) AS ports FROM pkt_scan GROUP BY ALL)"
ORACLE_SQL = {
    "beacon_candidates": f"WITH {_BEACON} SELECT flow, interval, jitter, confidence, samples, total_seconds, client_packets > 8192 AS samples_truncated, client_packets >= 8 AND jitter <= 0.2 AND interval BETWEEN 0.5 AND 86400 AS passes FROM beacons",
    "beacon_gated": f"WITH {_BEACON} SELECT flow, interval, jitter, confidence FROM beacons WHERE client_packets >= 8 AND jitter <= 0.45 AND interval BETWEEN 0.5 AND 86400",
    "flow_table": f"{_F} SELECT {', '.join(FLOW_FACTS)} FROM flows",
    "top_flows": f"{_F} SELECT flow, bytes, packets FROM flows ORDER BY bytes DESC, a, ap, b, bp, ip_proto LIMIT {TOP}",
    "host_table": f"{_H} SELECT * FROM hosts",
    "top_talkers": f"{_H} SELECT ip, total_bytes, peers, private FROM hosts ORDER BY total_bytes DESC, ip LIMIT {TOP}",
    "host_table_lines": f"WITH {PKT_LINES}, {_host_sql('pkt_lines')} SELECT * FROM hosts",
    "flow_table_lines": f"WITH {PKT_LINES}, {_flow_sql('pkt_lines')} SELECT flow, packets, bytes, scope, service, up_payload FROM flows",
    "service_table": f"{_F} SELECT CASE ip_proto WHEN 6 THEN 'TCP' ELSE 'UDP' END AS protocol, service, service_port AS port, count(*) AS flows, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM flows WHERE service IS NOT NULL GROUP BY ALL",
    "top_services": f"{_F} SELECT CASE ip_proto WHEN 6 THEN 'TCP' ELSE 'UDP' END AS protocol, service, service_port AS port, count(*) AS flows, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM flows WHERE service IS NOT NULL GROUP BY ALL ORDER BY bytes DESC, service, port, protocol LIMIT {TOP}",
    "timeline": f"WITH {PKT} SELECT ts_us // 1000000 AS second, count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS bytes FROM pkt WHERE ts_us <> 0 GROUP BY 1",
    "summary": f"""WITH {PKT}, t AS (SELECT count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS wire_bytes, min(ts_us) * 1000 AS first_ns, max(ts_us) * 1000 AS last_ns,
  count(*) FILTER (ip_proto = 6) AS tcp, count(*) FILTER (ip_proto = 17) AS udp FROM pkt), d AS (SELECT *, (last_ns - first_ns) / 1e9 AS duration FROM t)
SELECT packets, wire_bytes, wire_bytes AS captured_bytes, CAST(0 AS BIGINT) AS truncated, first_ns, last_ns, packets AS ipv4, CAST(0 AS BIGINT) AS ipv6, tcp, udp, CAST(0 AS BIGINT) AS icmp, duration,
  packets / duration AS packets_per_second, wire_bytes * 8 / duration AS bits_per_second FROM d""",
    "syn_ports": f"{_S} SELECT {_sql_ip('src')} AS src_ip, {_sql_ip('dst')} AS dst_ip, ports FROM tried",
    "port_scans": f"{_S}, s AS (SELECT src, max(ports) AS widest, count(*) FILTER (ports > 1) AS targets FROM tried GROUP BY 1) SELECT {_sql_ip('src')} AS src_ip, widest, targets FROM s WHERE widest >= 15",
    "unanswered_syns": f"WITH {PKT_SCAN}, {_flow_sql('pkt_scan')} SELECT count(*) FILTER (unanswered) AS unanswered, count(*) AS flows FROM flows",
    "upload_heavy": f"{_F} SELECT flow, up_payload, down_payload, upload_ratio, duration FROM flows WHERE scope = 'outbound' AND up_payload >= 2000 AND upload_ratio >= 1.5",
    "cleartext_services": f"{_F} SELECT service, service_port, bytes, packets, flow FROM flows WHERE service IN ({', '.join(repr(x) for x in names.CLEARTEXT)}) AND a_payload + b_payload > 0",
    "flow_search": f"{_F} SELECT flow, bytes FROM flows WHERE contains(lower(flow), '10.0.0.1:') ORDER BY bytes DESC, flow LIMIT 2000",
    "reset_flows": f"{_F} SELECT flow, client_ip FROM flows WHERE reset",
    "direction_stats": f"{_F} SELECT {_sql_ip('a')} AS a_ip, ap AS a_port, {_sql_ip('b')} AS b_ip, bp AS b_port, CASE ip_proto WHEN 6 THEN 'TCP' ELSE 'UDP' END AS protocol, a_packets, a_bytes, a_payload, {_FLAGS('a_flags')} AS a_flags, b_packets, b_bytes, b_payload, {_FLAGS('b_flags')} AS b_flags, initiator_a FROM flows",
    "first_packets": f"WITH {PKT} SELECT idx AS index, {_sql_ip('src')} AS src_ip, {_sql_ip('dst')} AS dst_ip, wire_len FROM pkt WHERE idx <= 100",
    "flow_sessions": f"""WITH {PKT}, gaps AS (SELECT src, ts_us, wire_len, CASE WHEN ts_us - lag(ts_us) OVER w >= 3600000000 THEN 1 ELSE 0 END AS new FROM pkt WINDOW w AS (PARTITION BY src ORDER BY ts_us)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY src ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS n FROM gaps)
SELECT {_sql_ip('src')} AS src_ip, min(ts_us) AS start_us, count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS bytes FROM numbered GROUP BY src, n""",
}
