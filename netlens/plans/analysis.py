"""A capture's analysis: packets decoded once, tables from them, findings, and the report.

``Analysis`` keeps the decoded packets and messages as written tables, as about twenty aggregates
read them. Every section is a DataFrame; only what the report shows is collected.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.decode import applications, layers
from netlens.functions import names, text
from netlens.operators import beacon, flows, indicators, messages
from netlens.reassembly import streams
from netlens.sources import capture
from netlens.storage import materialize, release

EVIDENCE = 12
SEVERITIES = ("info", "low", "medium", "high")

# The findings' titles by id, which are part of the report's format.
TITLES = {
    "ioc-ip-match": "%d host(s) matched an address indicator",
    "ioc-domain-match": "%d name(s) matched a domain indicator",
    "ioc-ja3-match": "%d TLS client(s) matched a fingerprint indicator",
    "periodic-beaconing": "%d flow(s) with machine-regular timing",
    "dns-subdomain-volume": "%d domain(s) queried with unusually many subdomains",
    "high-entropy-dns": "%d high-entropy DNS name(s)",
    "port-scan": "%d host(s) exhibiting port-scan behaviour",
    "outbound-upload-heavy": "%d outbound flow(s) dominated by upload",
    "cleartext-http-credentials": "HTTP Authorization sent in the clear on %d request(s)",
    "cleartext-service": "%d unencrypted service flow(s)",
    "obsolete-tls": "%d TLS handshake(s) negotiated a deprecated version",
    "tcp-overlap-conflict": "%d TCP segment(s) overlapped earlier data with different bytes",
    "ip-fragment-overlap": "%d IP fragment(s) overlapped earlier data with different bytes",
    "arp-address-conflict": "%d IP(s) claimed by more than one MAC",
    "capture-quality": "Capture quality notes",
}


@dataclass(frozen=True)
class Settings:
    """Thresholds; ``clamped`` keeps them in the ranges that make sense."""

    top: int = 20
    beacon_packets: int = 8
    beacon_jitter: float = 0.20
    beacon_least: float = 0.5
    beacon_most: float = 86_400.0
    entropy: float = 3.8
    subdomains: int = 40
    scan_ports: int = 15
    upload_bytes: int = 5 * 1024 * 1024
    upload_ratio: float = 4.0
    legacy_link_type: bool = False

    def clamped(self) -> "Settings":
        return Settings(
            **(
                self.__dict__
                | {
                    "beacon_jitter": min(1.0, max(0.0, self.beacon_jitter)),
                    "beacon_packets": max(5, self.beacon_packets),
                    "subdomains": max(2, self.subdomains),
                    "scan_ports": max(2, self.scan_ports),
                }
            )
        )


class Analysis:
    """Tables of a capture's records (see ``sources.capture``), and indicators if there are any."""

    def __init__(
        self,
        records: DataFrame,
        settings: Settings | None = None,
        listed: DataFrame | None = None,
        limit: int | None = None,
    ):
        frames = capture.frames(records)
        if limit is not None:
            frames = capture.first_records(frames, max(1, limit))
        self._prepare(materialize(layers.decode(frames), "packets"), capture.read_errors(records), settings, listed)

    @classmethod
    def of_packets(
        cls,
        packets: DataFrame,
        errors: DataFrame,
        settings: Settings | None = None,
        listed: DataFrame | None = None,
    ) -> "Analysis":
        """The analysis of packets that are decoded and stored already."""
        made = cls.__new__(cls)
        made._prepare(packets, errors, settings, listed)
        return made

    def _prepare(self, packets: DataFrame, errors: DataFrame, settings: Settings | None, listed: DataFrame | None) -> None:
        self.packets, self.errors = packets, errors
        self.flow_packets = packets
        self._derive(
            streams.recover_streams(packets),
            streams.recover_datagrams(packets),
            applications.messages(packets),
            flows.flows(packets),
            flows.hosts(packets),
            settings,
            listed,
        )

    def _derive(
        self,
        recovered_streams: DataFrame,
        recovered_datagrams: DataFrame,
        found: DataFrame,
        base: DataFrame,
        hosts: DataFrame,
        settings: Settings | None,
        listed: DataFrame | None,
    ) -> None:
        """Write what many sections read."""
        self.settings = (settings or Settings()).clamped()
        self.listed = listed if listed is not None and not listed.isEmpty() else None
        self.streams = materialize(recovered_streams, "streams")
        self.datagrams = materialize(recovered_datagrams, "datagrams")
        for recovered, origin in ((self.streams, 1), (self.datagrams, 2)):
            found = found.unionByName(streams.recovered_messages(recovered, origin), allowMissingColumns=True)
        self.messages = materialize(found, "messages")
        self.flows = materialize(self._flows(base), "flows")
        self.hosts = materialize(hosts, "hosts")
        self.names = materialize(messages.dns_names(self.messages), "dns-names")

    def release(self) -> None:
        """Delete the tables that this analysis wrote."""
        for table in self.written():
            release(table)

    def written(self) -> list[DataFrame]:
        return [self.packets, self.streams, self.datagrams, self.messages, self.flows, self.hosts, self.names]

    def _flows(self, base: DataFrame) -> DataFrame:
        keyed = flows.with_flow_key(self.messages)
        told = messages.flow_messages(keyed, flows.FLOW_KEY)
        resolved = messages.dns_resolved(self.messages).select(F.col("ip").alias("server_ip"), F.col("name").alias("destination"))
        return base.join(told, list(flows.FLOW_KEY), "left").join(resolved, "server_ip", "left")

    #: Notes on what was let go before it could be put together.
    drop_notes: tuple[str, ...] = ()

    def note_drops(self, dropped_streams: int, dropped_datagrams: int) -> None:
        """Tell the report what a bounded recovery let go (see ``streaming.recovery.accounting``)."""
        told = (
            (dropped_datagrams, "%d fragmented datagram(s) were let go unfinished; their messages are missing"),
            (dropped_streams, "%d TCP direction(s) were let go unfinished; messages split over their segments are missing"),
        )
        self.drop_notes = tuple(text % n for n, text in told if n)

    def counters(self) -> DataFrame:
        return flows.summary(all_counters(self.packets))

    def timeline(self) -> DataFrame:
        return flows.timeline(self.packets)

    def bindings(self) -> DataFrame:
        return messages.arp_bindings(self.packets)

    def beacons(self) -> DataFrame:
        s = self.settings
        scored = beacon.gated(
            beacon.scores(self.flow_packets, self.flows),
            s.beacon_packets,
            s.beacon_jitter,
            s.beacon_least,
            s.beacon_most,
        )
        return scored.join(
            self.flows.select(*flows.FLOW_KEY, "sni", "destination"),
            list(flows.FLOW_KEY),
        ).orderBy(F.desc("confidence"), "flow")

    def subdomains(self) -> DataFrame:
        return messages.dns_subdomains(self.names)

    def scans(self) -> DataFrame:
        return flows.port_scans(flows.syn_ports(self.packets), self.settings.scan_ports)

    def indicator_hits(self) -> dict[str, DataFrame] | None:
        """Hits by kind, or None without indicators."""
        if self.listed is None:
            return None
        hosts = self.hosts.select("ip", "key", (F.col("sent_packets") + F.col("received_packets")).alias("count"))
        dns = self.names.withColumn("n", F.col("queries") + F.col("responses"))
        seen = indicators.merged_names(
            (dns, "name", "n", "dns"),
            (messages.http_hosts(self.messages), "host", "requests", "http"),
            (messages.tls_names(self.messages), "sni", "hellos", "tls"),
        )
        return {
            "ip": indicators.ordered_hits(indicators.address_hits(hosts, self.listed)),
            "domain": indicators.ordered_hits(indicators.domain_hits(seen, self.listed)),
            "ja3": indicators.ordered_hits(indicators.fingerprint_hits(messages.tls_fingerprints(self.messages), self.listed)),
        }

    def findings(self) -> DataFrame:
        return collect_findings(self)


def all_counters(packets: DataFrame) -> DataFrame:
    """One row of totals, with what only decoding tells."""
    more = packets.agg(
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"),
        F.count_if("fragmented").alias("fragments"),
        F.count_if(F.col("arp").isNotNull()).alias("arp"),
        F.count_if(F.col("src_key").isNull() & F.col("arp").isNull()).alias("other_l3"),
    )
    return flows.counters(packets).crossJoin(more)  # one row each


def finding(
    rows: DataFrame,
    order: list[Column],
    evidence: Column,
    kind: str,
    severity: Column | str,
    detail: str,
    technique: tuple[str, ...] = (),
) -> DataFrame:
    """One row from the rows that a rule found, or none: the title with their number, and the first evidence."""
    ranked = rows.select(F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order))).alias("by"), evidence.alias("e"), "*")
    # The evidence shown comes from a top-k, the number from a count that combines before it shuffles.
    shown = ranked.orderBy("by").limit(EVIDENCE).agg(F.sort_array(F.collect_list(F.struct("by", "e"))).alias("l"))
    facts = ranked.agg(F.count("*").alias("n"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"))
    whole = facts.where("n > 0").crossJoin(shown)  # one row each
    techniques = F.array(*map(F.lit, technique)) if technique else F.array().cast("array<string>")
    return whole.select(
        F.lit(kind).alias("id"),
        "severity",
        F.format_string(TITLES[kind], "n").alias("title"),
        F.lit(detail).alias("detail"),
        F.transform("l", lambda x: x["e"]).alias("evidence"),
        techniques.alias("technique"),
    )


def _fmt(pattern: str, *columns) -> Column:
    return F.format_string(pattern, *columns)


def collect_findings(a: Analysis) -> DataFrame:
    """All findings, the gravest first."""
    s, c = a.settings, F.col
    sni = F.coalesce(F.concat(F.lit(" sni="), c("sni")), F.lit(""))
    out: list[DataFrame] = []
    hits = a.indicator_hits() or {}
    units = {"ip": "packet(s)", "domain": "lookup(s)/hit(s)", "ja3": "handshake(s)"}
    for kind, found in hits.items():
        line = F.concat(
            c("indicator"),
            F.lit(" → "),
            c("observed"),
            F.lit(" ["),
            c("context"),
            F.lit("] via "),
            c("source"),
            F.coalesce(F.concat(F.lit(" ("), c("tag"), F.lit(")")), F.lit("")),
            _fmt(f" (%d {units[kind]})", c("count")),
        )
        out.append(
            finding(
                found,
                [-c("count"), c("observed")],
                line,
                f"ioc-{kind}-match",
                "high",
                "Check that the list is current and the indicator narrow before acting on a match.",
            )
        )
    strong = F.when(F.max("confidence") >= 0.8, "high").otherwise("medium")
    line = F.concat(
        c("flow"),
        F.lit(" every "),
        text.human_duration(c("interval")),
        F.lit(" (jitter "),
        text.human_percent(c("jitter")),
        _fmt(", %d samples, confidence %s)", c("samples"), text.fixed(c("confidence"), 2)),
        sni,
    )
    out.append(
        finding(
            a.beacons(),
            [-c("confidence"), c("flow")],
            line,
            "periodic-beaconing",
            strong,
            "Timing this even is a program's, not a person's; scheduled jobs and telemetry do it too.",
            ("T1071",),
        )
    )
    line = F.concat(c("parent"), _fmt(": %d distinct subdomains, e.g. ", c("subdomains")), c("example"))
    out.append(
        finding(
            messages.subdomain_volume(a.subdomains(), s.subdomains),
            [-c("subdomains"), c("parent")],
            line,
            "dns-subdomain-volume",
            "high",
            "Many names below one parent can carry data out over DNS; content networks also have many.",
            ("T1071.004",),
        )
    )
    line = F.concat(
        c("name"),
        _fmt(" (entropy %s bits/char, %d lookups", text.fixed(c("entropy"), 2), c("lookups")),
        F.when(c("nxdomain") > 0, _fmt(", %d NXDOMAIN", c("nxdomain"))).otherwise(""),
        F.lit(")"),
    )
    heavy = F.when(F.count_if(c("nxdomain") > 0) > 2, "high").otherwise("medium")
    out.append(
        finding(
            messages.high_entropy(a.names, s.entropy),
            [-c("entropy"), c("name")],
            line,
            "high-entropy-dns",
            heavy,
            "Generated names and encoded data look random; so do hashed host names of cloud services.",
            ("T1568.002",),
        )
    )
    line = F.concat(c("src_ip"), _fmt(": up to %d ports probed on a single host, %d host(s) targeted", c("widest"), c("targets")))
    out.append(
        finding(
            a.scans(),
            [-c("widest"), c("src_ip")],
            line,
            "port-scan",
            "high",
            "Connections were opened to many ports of one host; inventory scanners do the same.",
            ("T1046",),
        )
    )
    line = F.concat(
        c("flow"),
        F.lit(" sent "),
        text.human_bytes(c("up_payload")),
        F.lit(" up vs "),
        text.human_bytes(c("down_payload")),
        F.when(
            c("upload_ratio") == float("inf"),
            " down (ratio infx) over ",
        ).otherwise(_fmt(" down (ratio %sx) over ", text.fixed(c("upload_ratio"), 1))),
        text.human_duration(c("duration")),
        sni,
    )
    out.append(
        finding(
            flows.upload_heavy(a.flows, s.upload_bytes, s.upload_ratio),
            [-c("up_payload"), c("flow")],
            line,
            "outbound-upload-heavy",
            "medium",
            "An inside host sent far more than it got back; backups and sync do too.",
            ("T1048",),
        )
    )
    auth = a.messages.where(c("http.is_request") & c("http.has_authorization"))
    out.append(
        finding(
            auth,
            [c("ord")],
            c("http.summary"),
            "cleartext-http-credentials",
            "high",
            "Credentials went over plain HTTP; their values are not kept here.",
            ("T1040",),
        )
    )
    clear = a.flows.where(names.is_cleartext(c("service")) & (c("a_payload") + c("b_payload") > 0))
    line = F.concat(
        c("service"),
        F.lit(" on "),
        c("service_ip"),
        F.lit(":"),
        c("service_port").cast("string"),
        F.lit(" — "),
        text.human_bytes(c("bytes")),
        _fmt(" across %d packet(s)", c("packets")),
    )
    out.append(
        finding(
            clear.select(line.alias("line")).distinct(),
            [c("line")],
            c("line"),
            "cleartext-service",
            "low",
            "These services carry their data, and often passwords, without encryption.",
            ("T1040",),
        )
    )
    obsolete = a.messages.where(names.is_obsolete_tls(c("tls.version")))
    final = a.flows.where(names.is_obsolete_tls(c("tls_version")))
    shown = final.select(F.concat(c("flow"), F.lit(" "), names.tls_version(c("tls_version")), sni).alias("line"))
    title = finding(
        obsolete,
        [c("ord")],
        F.lit(""),
        "obsolete-tls",
        "medium",
        "Versions before TLS 1.2 have known weaknesses.",
        ("T1040",),
    )
    lines = shown.orderBy("line").limit(EVIDENCE).agg(F.sort_array(F.collect_list("line")).alias("lines"))
    out.append(title.crossJoin(lines).withColumn("evidence", c("lines")).drop("lines"))  # one row each
    for table, kind, unit in ((a.streams, "tcp-overlap-conflict", "stream(s)"), (a.datagrams, "ip-fragment-overlap", "datagram(s)")):
        total = streams.stats(table).where("conflicts > 0")
        line = _fmt(f"%d conflicting overlap(s) across %d tracked {unit}; first writer was kept", c("conflicts"), c("tracked"))
        out.append(
            total.select(
                F.lit(kind).alias("id"),
                F.lit("medium").alias("severity"),
                _fmt(TITLES[kind], c("conflicts")).alias("title"),
                F.lit(
                    "Two versions of the same bytes let a monitor and a host see different data; merged taps do it too."
                ).alias("detail"),
                F.array(line).alias("evidence"),
                F.array().cast("array<string>").alias("technique"),
            )
        )
    conflicts = messages.arp_conflicts(a.bindings())
    out.append(
        finding(
            conflicts,
            [c("ip")],
            F.concat(c("ip"), F.lit(" claimed by "), F.array_join("macs", ", ")),
            "arp-address-conflict",
            "high",
            "Several devices answered for one address: a poisoned cache, or a failover pair.",
            ("T1557.002",),
        )
    )
    out.append(capture_quality(a))
    whole = out[0]
    for one in out[1:]:
        whole = whole.unionByName(one)
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), c("severity")).cast("int") - 1
    return whole.withColumn("severity_rank", rank).orderBy(F.desc("severity_rank"), "id")


def capture_quality(a: Analysis) -> DataFrame:
    """What limits the analysis, one note for each condition."""
    c = F.col
    outside = a.hosts.agg((F.coalesce(F.min(~c("private")), F.lit(False)) & (F.count("*") > 0)).alias("outside"))
    facts = a.counters().crossJoin(outside).crossJoin(  # one row each
        streams.stats(a.streams).select(c("recovered").alias("tcp_recovered"))
    ).crossJoin(
        streams.stats(a.datagrams).select(c("recovered").alias("ip_recovered"))
    )
    notes = F.array(
        F.when(
            c("truncated") > 0,
            _fmt(
                "%d of %d packets (%s%%) were cut short by the capture's limit",
                c("truncated"),
                c("packets"),
                text.fixed(c("truncated") * 100.0 / c("packets"), 1),
            ),
        ),
        F.when(c("warnings") > 0, _fmt("%d decode warning(s) were raised", c("warnings"))),
        F.when(
            c("fragments") > 0,
            _fmt("%d IP fragment(s) seen; %d datagram(s) were reassembled from them", c("fragments"), c("ip_recovered")),
        ),
        F.when(
            c("tcp_recovered") > 0,
            _fmt("%d application message(s) were recovered from several TCP segments", c("tcp_recovered")),
        ),
        *(F.lit(note) for note in a.drop_notes),
        F.when(c("outside"), "no private address was seen: the capture point may be outside the network"),
    )
    kept = facts.select(F.filter(notes, lambda n: n.isNotNull()).alias("evidence")).where(F.size("evidence") > 0)
    return kept.select(
        F.lit("capture-quality").alias("id"),
        F.lit("info").alias("severity"),
        F.lit(TITLES["capture-quality"]).alias("title"),
        F.lit("What may limit this analysis.").alias("detail"),
        "evidence",
        F.array().cast("array<string>").alias("technique"),
    )


def analyze(
    spark: SparkSession,
    path: str,
    settings: Settings | None = None,
    listed: DataFrame | None = None,
    limit: int | None = None,
) -> Analysis:
    s = settings or Settings()
    return Analysis(capture.read_capture(spark, path, s.legacy_link_type), s, listed, limit)
