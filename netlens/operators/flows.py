"""Flows, hosts, services, timeline and counters from packets.

Packets have ``index``, ``ts_ns``, ``src_ip``, ``dst_ip`` (text), ``src_key``, ``dst_key`` (see
``functions.addresses``), ``src_port``, ``dst_port`` (null without), ``ip_proto``, ``tcp_flags``
(null unless TCP), ``wire_len``, ``captured_len``, ``payload_len``. Packets without addresses
belong to no flow. Groups are by the short binary keys; addresses become text afterwards, once a group. Every group is aggregated before it is shuffled, so one elephant flow does no harm.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions import addresses, names

FLOW_KEY = ("a_key", "a_port", "b_key", "b_port", "ip_proto")
MOST_SCAN_RESIDUE = 4
UPLOAD_BYTES, UPLOAD_RATIO = 5 * 1024 * 1024, 4.0


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Packets that have addresses, with the smaller endpoint as a, and ``a_to_b``."""
    ported = F.col("ip_proto").isin(names.TCP, names.UDP)
    port = lambda c: F.when(ported, F.coalesce(c, F.lit(0))).otherwise(0)
    there = packets.where(
        F.col("src_key").isNotNull()
        & F.col("dst_key").isNotNull()
    ).withColumns({"_sp": port("src_port"), "_dp": port("dst_port")})
    there = there.withColumn("a_to_b", F.struct(F.col("src_key"), F.col("_sp")) <= F.struct(F.col("dst_key"), F.col("_dp")))
    pick = lambda yes, no: F.when(F.col("a_to_b"), F.col(yes)).otherwise(F.col(no))
    return there.withColumns({
        "a_key": pick("src_key", "dst_key"), "b_key": pick("dst_key", "src_key"),
        "a_port": pick("_sp", "_dp"), "b_port": pick("_dp", "_sp"),
    }).drop("_sp", "_dp")


def flow_text(a_ip: Column, a_port: Column, b_ip: Column, b_port: Column, proto: Column) -> Column:
    bare = (a_port == 0) & (b_port == 0)
    ends = F.when(bare, F.concat(a_ip, F.lit(" <-> "), b_ip)).otherwise(
        F.concat(a_ip, F.lit(":"), a_port.cast("string"), F.lit(" <-> "), b_ip, F.lit(":"), b_port.cast("string"))
    )
    return F.concat(ends, F.lit(" "), names.protocol(proto))


def flows(packets: DataFrame) -> DataFrame:
    """One row for each flow: both directions' counts, times, flags, and what follows from them."""
    keyed = with_flow_key(packets)
    ab, syn = F.col("a_to_b"), names.is_syn_only(F.col("tcp_flags"))
    one = lambda cond, value: F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("long")
    grouped = keyed.groupBy(*FLOW_KEY).agg(
        one(ab, 1).alias("a_packets"), one(~ab, 1).alias("b_packets"),
        one(ab, F.col("wire_len")).alias("a_bytes"), one(~ab, F.col("wire_len")).alias("b_bytes"),
        one(ab, F.col("payload_len")).alias("a_payload"), one(~ab, F.col("payload_len")).alias("b_payload"),
        F.coalesce(F.bit_or(F.when(ab, F.col("tcp_flags"))), F.lit(0)).alias("a_flags"),
        F.coalesce(F.bit_or(F.when(~ab, F.col("tcp_flags"))), F.lit(0)).alias("b_flags"),
        F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"),
        F.max(syn).alias("handshake"),
        F.coalesce(F.min_by(ab, F.when(syn, F.col("index"))), F.min_by(ab, "index")).alias("initiator_a"),
    )
    return described(grouped)


#: Figures of a flow that add up over stretches of packets.
ADDED = ("a_packets", "b_packets", "a_bytes", "b_bytes", "a_payload", "b_payload")


def flow_partials(packets: DataFrame) -> DataFrame:
    """What a stretch of packets tells of each flow, in a form that ``merged_partials`` can merge with other stretches."""
    keyed = with_flow_key(packets)
    ab, syn = F.col("a_to_b"), names.is_syn_only(F.col("tcp_flags"))
    opened = F.when(syn, F.col("index"))
    one = lambda cond, value: F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("long")
    sides = [
        one(cond, value).alias(f"{side}_{name}")
        for name, value in (("packets", F.lit(1)), ("bytes", F.col("wire_len")), ("payload", F.col("payload_len")))
        for side, cond in (("a", ab), ("b", ~ab))
    ]
    flags = [F.coalesce(F.bit_or(F.when(cond, F.col("tcp_flags"))), F.lit(0)).alias(f"{side}_flags") for side, cond in (("a", ab), ("b", ~ab))]
    return keyed.groupBy(*FLOW_KEY).agg(
        *sides,
        *flags,
        F.min("ts_ns").alias("first_ns"),
        F.max("ts_ns").alias("last_ns"),
        F.min(opened).alias("opened_at"),
        F.min_by(ab, opened).alias("opened_by_a"),
        F.min("index").alias("began_at"),
        F.min_by(ab, "index").alias("began_by_a"),
    )


def merged_partials(partials: DataFrame) -> DataFrame:
    """One row for each flow again; merging merged rows further gives the same."""
    return partials.groupBy(*FLOW_KEY).agg(
        *(F.sum(c).alias(c) for c in ADDED),
        *(F.bit_or(c).alias(c) for c in ("a_flags", "b_flags")),
        F.min("first_ns").alias("first_ns"),
        F.max("last_ns").alias("last_ns"),
        F.min("opened_at").alias("opened_at"),
        F.min_by("opened_by_a", "opened_at").alias("opened_by_a"),
        F.min("began_at").alias("began_at"),
        F.min_by("began_by_a", "began_at").alias("began_by_a"),
    )


def flows_of_partials(partials: DataFrame) -> DataFrame:
    """The same rows as ``flows`` gives for all the packets."""
    initiator = F.coalesce("opened_by_a", "began_by_a").alias("initiator_a")
    kept = partials.select(
        *FLOW_KEY, *ADDED, "a_flags", "b_flags", "first_ns", "last_ns", F.col("opened_at").isNotNull().alias("handshake"), initiator
    )
    return described(kept)


def described(grouped: DataFrame) -> DataFrame:
    """Adds who is the client, service, scope, ratio and other facts to aggregated flows."""
    c = F.col
    service, private = lambda port: names.service(c(port), c("ip_proto")), lambda key: addresses.is_private(c(key))
    facts = F.struct(
        service("a_port").alias("a_service"),
        service("b_port").alias("b_service"),
        private("a_key").alias("a_private"),
        private("b_key").alias("b_private"),
        *(addresses.text_of_key(c(f"{x}_key")).alias(f"{x}_ip") for x in "ab"),
    )
    # One generated row each: the optimiser doesn't copy what is computed here into every use.
    known = grouped.select("*", F.explode(F.array(facts)).alias("f")).select(*grouped.columns, "f.*")
    client_a = (
        F.when(c("handshake") | (c("a_port") == c("b_port")), c("initiator_a"))
        .when(c("a_service").isNotNull() & c("b_service").isNull(), False)
        .when(c("a_service").isNull() & c("b_service").isNotNull(), True)
        .otherwise(c("a_port") > c("b_port"))
    )
    sided = known.select("*", F.explode(F.array(client_a)).alias("client_a"))
    side = lambda a, b: F.when(c("client_a"), c(a)).otherwise(c(b))
    both = sided.withColumns({
        "client_ip": side("a_ip", "b_ip"),
        "client_port": side("a_port", "b_port"),
        "server_ip": side("b_ip", "a_ip"),
        "server_port": side("b_port", "a_port"),
        "client_key": side("a_key", "b_key"), "server_key": side("b_key", "a_key"),
        "client_service": side("a_service", "b_service"), "server_service": side("b_service", "a_service"),
        "client_private": side("a_private", "b_private"), "server_private": side("b_private", "a_private"),
        "client_packets": side("a_packets", "b_packets"), "server_packets": side("b_packets", "a_packets"),
        "up_payload": side("a_payload", "b_payload"), "down_payload": side("b_payload", "a_payload"),
        "packets": c("a_packets") + c("b_packets"), "bytes": c("a_bytes") + c("b_bytes"),
        "duration": (c("last_ns") - c("first_ns")) / 1e9,
    })
    return both.withColumns({
        "service": F.coalesce("server_service", "client_service"),
        "service_ip": F.when(
            c("server_service").isNotNull(),
            c("server_ip"),
        ).when(c("client_service").isNotNull(), c("client_ip")),
        "service_port": F.when(
            c("server_service").isNotNull(),
            c("server_port"),
        ).when(c("client_service").isNotNull(), c("client_port")),
        "scope": F.when(
            c("client_private"),
            F.when(c("server_private"), "internal").otherwise("outbound"),
        ).otherwise(F.when(c("server_private"), "inbound").otherwise("external")),
        "upload_ratio": F.when(
            c("down_payload") > 0,
            c("up_payload") / c("down_payload"),
        ).when(c("up_payload") > 0, F.lit(float("inf"))).otherwise(0.0),
        "reset": names.has(c("a_flags"), names.RST) | names.has(c("b_flags"), names.RST),
        "unanswered": (c("ip_proto") == names.TCP) & c("handshake") & (c("server_packets") == 0) & (
            c("client_packets") <= MOST_SCAN_RESIDUE
        ),
        "flow": flow_text(c("a_ip"), c("a_port"), c("b_ip"), c("b_port"), c("ip_proto")),
    }).drop("a_service", "b_service", "a_private", "b_private", "client_service", "server_service", "client_private", "server_private")


def top_flows(found: DataFrame, n: int) -> DataFrame:
    return found.orderBy(F.desc("bytes"), "a_key", "a_port", "b_key", "b_port", "ip_proto").limit(n)


def hosts(packets: DataFrame) -> DataFrame:
    """One row for each address: what it sent and received, and its distinct peers."""
    return hosts_of_peers(peer_totals(packets))


def peer_totals(packets: DataFrame) -> DataFrame:
    """What each address sent to and received from each peer."""
    there = packets.where(F.col("src_key").isNotNull() & F.col("dst_key").isNotNull())
    side = lambda key, peer, sent: F.struct(
        F.col(key).alias("key"),
        F.col(peer).alias("peer"),
        F.lit(sent).alias("sent"),
    )
    both = there.select(
        "wire_len",
        F.explode(F.array(side("src_key", "dst_key", True), side("dst_key", "src_key", False))).alias("e"),
    ).select("wire_len", "e.*")
    # By peer first: the number of rows for a host is then that of its peers, and no set of peers is held.
    return both.groupBy("key", "peer").agg(*_sent_received())


SENT_RECEIVED = ("sent_packets", "sent_bytes", "received_packets", "received_bytes")


def hosts_of_peers(by_peer: DataFrame) -> DataFrame:
    sums = [F.sum(x).alias(x) for x in SENT_RECEIVED]
    each = by_peer.groupBy("key").agg(*sums, F.count("*").alias("peers"))
    return each.select(
        addresses.text_of_key(F.col("key")).alias("ip"),
        *each.columns,
        (F.col("sent_bytes") + F.col("received_bytes")).alias("total_bytes"),
        addresses.is_private(F.col("key")).alias("private"),
    )


def _sent_received() -> list[Column]:
    sent = F.col("sent")
    return [
        F.count_if(sent).alias("sent_packets"),
        F.coalesce(F.sum(F.when(sent, F.col("wire_len"))), F.lit(0)).cast("long").alias("sent_bytes"),
        F.count_if(~sent).alias("received_packets"),
        F.coalesce(F.sum(F.when(~sent, F.col("wire_len"))), F.lit(0)).cast("long").alias("received_bytes"),
    ]


def top_talkers(found: DataFrame, n: int) -> DataFrame:
    return found.orderBy(F.desc("total_bytes"), "ip").limit(n)


def services(found_flows: DataFrame) -> DataFrame:
    """Flows, packets and bytes of each (service, port, protocol)."""
    known = found_flows.where(F.col("service").isNotNull())
    return known.groupBy(
        names.protocol(F.col("ip_proto")).alias("protocol"),
        "service",
        F.col("service_port").alias("port"),
    ).agg(F.count("*").alias("flows"), F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))


def top_services(found: DataFrame, n: int) -> DataFrame:
    return found.orderBy(F.desc("bytes"), "service", "port", "protocol").limit(n)


def timeline(packets: DataFrame) -> DataFrame:
    """Packets and bytes of each second; packets without a time are left out."""
    timed = packets.where("ts_ns <> 0")
    return timed.groupBy(F.expr("ts_ns div 1000000000").alias("second")).agg(
        F.count("*").alias("packets"),
        F.sum("wire_len").cast("long").alias("bytes"),
    )


def counters(packets: DataFrame) -> DataFrame:
    """One row of totals over all packets."""
    timed = F.when(F.col("ts_ns") != 0, F.col("ts_ns"))
    proto = F.col("ip_proto")
    return packets.agg(
        F.count("*").alias("packets"),
        F.coalesce(F.sum("wire_len"), F.lit(0)).cast("long").alias("wire_bytes"),
        F.coalesce(F.sum("captured_len"), F.lit(0)).cast("long").alias("captured_bytes"),
        F.count_if(F.col("captured_len") < F.col("wire_len")).alias("truncated"),
        F.min(timed).alias("first_ns"), F.max(timed).alias("last_ns"),
        F.count_if(F.length("src_key") == 5).alias("ipv4"), F.count_if(F.length("src_key") == 17).alias("ipv6"),
        F.count_if(proto == names.TCP).alias("tcp"),
        F.count_if(proto == names.UDP).alias("udp"),
        F.count_if(proto.isin(names.ICMP, names.ICMP6)).alias("icmp"),
    )


def summary(total: DataFrame) -> DataFrame:
    """Counters with duration and rates; rates are 0 without a duration."""
    duration = F.coalesce((F.col("last_ns") - F.col("first_ns")) / 1e9, F.lit(0.0))
    rate = lambda x: F.when(F.col("duration") > 0, x / F.col("duration")).otherwise(0.0)
    return total.withColumn("duration", duration).withColumns(
        {"packets_per_second": rate(F.col("packets")), "bits_per_second": rate(F.col("wire_bytes") * 8)}
    )


def syn_ports(packets: DataFrame) -> DataFrame:
    """Distinct ports that a host's bare SYNs tried, by target."""
    return ports_by_target(tried_ports(packets))


def tried_ports(packets: DataFrame) -> DataFrame:
    return packets.where(names.is_syn_only(F.col("tcp_flags"))).select("src_key", "dst_key", "dst_port").distinct()


def ports_by_target(tried: DataFrame) -> DataFrame:
    ends = [addresses.text_of_key(F.col(f"{x}_key")).alias(f"{x}_ip") for x in ("src", "dst")]
    return tried.groupBy("src_key", "dst_key").agg(F.count("*").alias("ports")).select(*ends, "src_key", "dst_key", "ports")


def port_scans(tried: DataFrame, least: int = 15) -> DataFrame:
    """Hosts that tried ``least`` ports on one target: the most ports on one, and targets with several."""
    per_host = tried.groupBy("src_ip").agg(F.max("ports").alias("widest"), F.count_if(F.col("ports") > 1).alias("targets"))
    return per_host.where(F.col("widest") >= least)


def upload_heavy(found: DataFrame, least_bytes: int = UPLOAD_BYTES, least_ratio: float = UPLOAD_RATIO) -> DataFrame:
    return found.where(
        (F.col("scope") == "outbound")
        & (F.col("up_payload") >= least_bytes)
        & (F.col("upload_ratio") >= least_ratio)
    )


def cleartext_services(found: DataFrame) -> DataFrame:
    return found.where(
        names.is_cleartext(F.col("service"))
        & (F.col("a_payload") + F.col("b_payload") > 0)
    ).select("service", "service_ip", "service_port", "bytes", "packets", "flow").distinct()


def search(found: DataFrame, text: str, n: int = 200) -> DataFrame:
    """Flows whose text, server name, service or protocol holds the text: those of the most bytes, at most 2000, in order."""
    wanted = text.lower()
    hit = F.contains(F.lower("flow"), F.lit(wanted)) | F.coalesce(F.contains("service", F.lit(wanted)), F.lit(False))
    if "sni" in found.columns:
        hit = hit | F.coalesce(F.contains(F.lower("sni"), F.lit(wanted)), F.lit(False))
    if "protocols" in found.columns:
        hit = hit | F.exists(F.coalesce("protocols", F.array().cast("array<string>")), lambda p: F.contains(p, F.lit(wanted)))
    return found.where(hit).orderBy(F.desc("bytes"), "flow").limit(min(n, 2000))
