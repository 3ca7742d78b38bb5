"""The made-up capture from file to report, and the same as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from netlens.functions import text
from netlens.operators import beacon, flows, messages
from netlens.plans import report as reports
from netlens.plans.analysis import Settings, analyze
from netlens.sources import intel, sample
from netlens.streaming import continuous


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("captures")
    (path / "a.pcap").write_bytes(sample.capture_bytes())
    return path


@pytest.fixture(scope="module")
def analysis(spark, folder, tmp_path_factory):
    path = tmp_path_factory.mktemp("lists") / "list.txt"
    path.write_text("203.0.113.77\nexample.com\n")
    return analyze(spark, str(folder / "a.pcap"), listed=intel.read_list(spark, str(path)))


@pytest.fixture(scope="module")
def report(analysis):
    return reports.build(analysis, "a.pcap", 0.0)


def test_findings(report):
    found = [(f["severity"], f["id"]) for f in report["findings"]]
    assert found == [
        ("high", "arp-address-conflict"),
        ("high", "cleartext-http-credentials"),
        ("high", "dns-subdomain-volume"),
        ("high", "ioc-domain-match"),
        ("high", "ioc-ip-match"),
        ("high", "periodic-beaconing"),
        ("high", "port-scan"),
        ("medium", "ip-fragment-overlap"),
        ("medium", "obsolete-tls"),
        ("medium", "outbound-upload-heavy"),
        ("low", "cleartext-service"),
        ("info", "capture-quality"),
    ]


def test_summary_and_flows(report):
    s = report["summary"]
    assert (
        s["packets"],
        s["tcp"],
        s["udp"],
        s["ipv6"],
        s["fragments"],
        s["truncated"],
        s["arp"],
        s["warnings"],
    ) == (4621, 4553, 66, 1, 3, 8, 2, 0)
    assert report["top_flows"][0]["flow"] == "192.168.1.88:46000 <-> 198.51.100.5:443 TCP" and report["top_flows"][0]["packets"] == 4500
    web = next(f for f in report["top_flows"] if f["server_port"] == 80)
    assert web["protocols"] == ["http"] and web["cleartext_credentials"] and web["resolved_dest"] == "www.example.com"
    assert report["http"]["cleartext_auth"] == 1 and report["tls"]["obsolete"] == 1 and report["dns"]["unique_names"] == 62
    assert report["beacons"][0]["interval"] == 0.5 and report["beacons"][0]["confidence"] == 1.0


def test_outputs(analysis, report):
    assert json.loads(reports.to_json(report))["schema_version"] == 1
    assert "<script>alert" not in reports.to_html(
        report
        | {"source": "</script><script>alert(1)"}
    ) and "\\u003c/script" in reports.to_html(report | {"source": "</script>"})
    assert "[HIGH] 1 host(s) exhibiting port-scan behaviour (port-scan)" in reports.to_text(report)
    assert reports.gate(analysis.findings(), "high") == 2


def test_figures_are_rounded_from_their_exact_value(spark):
    """Halfway to the even digit, and 0.15 down, as it is less than that."""
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.5, 0.75, 1.005, 1.25, 1.5, 2.5, 2.25, 9.95, 99.95, 0.0005, 0.0625, 1e-300, 1.5e-3, 4503599627370495.5, 9007199254740991.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for places in range(4):
        found = rows.select("x", text.fixed(F.col("x"), places).alias("s")).collect()
        assert {r.x: r.s for r in found} == {v: f"{v:.{places}f}" for v in values}
    others = spark.sql("SELECT -1.5D AS a, double('inf') AS b, CAST(NULL AS DOUBLE) AS c")
    assert others.select(*(text.fixed(F.col(c), 1) for c in "abc")).first()[:2] == ("-1.5", "Infinity")
    n = spark.sql("SELECT 2415919104L AS a, 1152L AS b, 1024L AS c, 1023L AS d, 1300L << 40 AS e, 5L << 48 AS f")
    assert list(n.select(*(text.human_bytes(F.col(c)) for c in "abcdef")).first()) == ["2.2 GB", "1.1 KB", "1.0 KB", "1023 B", "1.3 PB", "1.2 PB"]
    shares = spark.sql("SELECT 0.145D AS a, 0.0125D AS b, 0.00125D AS c, 0.0D AS d, 0.000001D AS e")
    assert list(shares.select(*(text.human_percent(F.col(c)) for c in "abcde")).first()) == ["14%", "1.2%", "0.12%", "0%", "<0.001%"]
    times = spark.sql("SELECT 0.0125D AS a, 2.25D AS b, 90.5D AS c, 3720.0D AS d")
    assert list(times.select(*(text.human_duration(F.col(c)) for c in "abcd")).first()) == ["12ms", "2.2s", "1m30s", "1h02m"]


def test_clean_capture(spark, tmp_path):
    from netlens.sources.capture import pcap_header, pcap_record

    frames = [f for f in sample.frames() if b"www" in f[2]][:2]
    (tmp_path / "q.pcap").write_bytes(pcap_header(1) + b"".join(pcap_record(*f) for f in frames))
    a = analyze(spark, str(tmp_path / "q.pcap"), Settings(scan_ports=0))
    assert a.settings.scan_ports == 2 and a.indicator_hits() is None
    assert {r.severity for r in a.findings().collect()} <= {"info"} and reports.gate(a.findings(), "low") == 0


def series(spark, times):
    rows = [(k, int(t * 1e9), "10.0.0.1", "8.8.8.8", 50000, 443) for k, t in enumerate(times)]
    base = spark.createDataFrame(rows, "index long, ts_ns long, src_ip string, dst_ip string, src_port int, dst_port int")
    return base.withColumns(
        {
            "src_key": F.unhex(F.lit("040A000001")),
            "dst_key": F.unhex(F.lit("0408080808")),
            "ip_proto": F.lit(6),
            "tcp_flags": F.lit(16),
            "wire_len": F.lit(60),
            "captured_len": F.lit(60),
            "payload_len": F.lit(6),
        }
    )


@pytest.mark.parametrize(
    ("times", "interval", "jitter"),
    [
        ([60.0 * k for k in range(40)], 60, (0, 0)),
        ([60.0 * k for k in range(20) if k not in (7, 12)], 60, (0, 0.05)),
        ([0, 0.1, 0.2, 30, 30.05, 31, 90, 90.2, 200, 200.01, 200.5, 301], None, (0.5, 1)),
        ([0, 1, 2], None, None),
        ([5.0] * 9, None, None),
    ],
)
def test_beacons(spark, times, interval, jitter):
    packets = series(spark, times)
    found = beacon.scores(packets, flows.flows(packets)).collect()
    if jitter is None:
        assert not found
    else:
        assert jitter[0] <= found[0].jitter <= jitter[1] and (interval is None or found[0].interval == interval)


def test_stream_equals_batch(spark, folder, analysis, tmp_path):
    seen: dict[str, list] = {}
    packets = continuous.packet_stream(spark, str(folder))
    for name, frame, mode in (
        ("timeline", continuous.timeline(packets), "complete"),
        ("flows", continuous.flow_totals(packets), "complete"),
        ("hosts", continuous.host_totals(packets), "complete"),
        ("handshakes", continuous.handshakes(packets), "update"),
    ):
        query = continuous.publish(
            frame,
            str(tmp_path / name),
            lambda df, _, name=name: seen.__setitem__(name, df.collect()),
            mode=mode,
            once=True,
        )
        query.awaitTermination()
    assert sorted(map(tuple, seen["timeline"])) == sorted(map(tuple, flows.timeline(analysis.packets).collect()))
    assert {tuple(r[:7]) for r in seen["flows"]} == {
        tuple(r)
        for r in analysis.flows.select("a_ip", "a_port", "b_ip", "b_port", "ip_proto", "packets", "bytes").collect()
    }
    assert {(r.ip, r.sent_bytes, r.received_bytes) for r in seen["hosts"]} == {
        (r.ip, r.sent_bytes, r.received_bytes)
        for r in analysis.hosts.collect()
    }
    answered = {(r.src_ip, r.dst_port): r.answered for r in seen["handshakes"]}
    assert answered["192.168.1.10", 80] and sum(not v for v in answered.values()) == 20


def test_stream_reports_equal_batch(spark, tmp_path):
    """Reports over captures that come one after the other: the last one says what a batch over both says, findings and all."""
    from netlens.sources.capture import pcap_header, pcap_record

    (tmp_path / "in").mkdir()
    frames = list(sample.frames())
    seen: list[tuple[int, dict]] = []
    # Cut between two segments of one message, so that only both files together hold it.
    cut = len(frames) // 2
    for name, part in (("a.pcap", frames[:cut]), ("b.pcap", frames[cut:])):
        (tmp_path / "in" / name).write_bytes(pcap_header(1) + b"".join(pcap_record(*f) for f in part))
        query = continuous.publish_reports(
            spark,
            str(tmp_path / "in"),
            str(tmp_path / "store"),
            str(tmp_path / "state"),
            lambda r, n: seen.append((n, r)),
            once=True,
        )
        query.awaitTermination()
    whole = reports.build(analyze(spark, str(tmp_path / "in")), str(tmp_path / "in"))
    assert [n for n, _ in seen] == [0, 1]
    for section in set(whole) - {"generated_at"}:
        assert seen[-1][1][section] == whole[section], section
    assert len(whole["findings"]) > 8 and seen[0][1]["summary"]["packets"] < whole["summary"]["packets"]


def test_flow_values_keep_the_first_to_arrive(spark):
    schema = "flow string, ord struct<index:bigint,origin:int,pos:int>, dns struct<questions:array<struct<name:string>>>, http struct<host:string,user_agent:string>"
    rows = [("f", (1000 - k, 0, 0), ([(f"n{k:03d}",), (f"m{k:03d}",)],), None) for k in range(300)]
    rows += [("f", (2000 + k, 0, 0), None, (f"h{(k * 37) % 150:03d}", f"a{k % 40:02d}" if k % 3 else None)) for k in range(450)]
    rows += [("g", (1, 0, 0), None, ("only", None)), (None, (1, 0, 0), None, (None, "agent"))]
    found = {r.flow: r for r in messages.flow_values(spark.createDataFrame(rows, schema).repartition(5), ("flow",)).collect()}
    names = [x for k in range(299, -1, -1) for x in (f"n{k:03d}", f"m{k:03d}")]
    agents = list(dict.fromkeys(f"a{k % 40:02d}" for k in range(450) if k % 3))
    assert found["f"].dns_names == sorted(names[:256]) and found["f"].http_hosts == sorted(
        f"h{(k * 37) % 150:03d}"
        for k in range(64)
    ) and found["f"].user_agents == sorted(agents[:16])
    assert (
        found["g"].dns_names,
        found["g"].http_hosts,
        found["g"].user_agents,
    ) == ([], ["only"], []) and found[None].user_agents == ["agent"]


def test_busy_flows_are_cut_to_their_first_arrivals(spark, monkeypatch):
    """A flow past the number of arrivals that count is cut by ranges of indexes first; its score is that of the first ones."""
    times = [10.0 * k for k in range(60)] + [600 + 3.7 * k for k in range(300)]
    monkeypatch.setattr(beacon, "SAMPLES", 60)
    monkeypatch.setattr(beacon, "RANGE_BITS", 3)
    packets = series(spark, times)
    kept = beacon.first_arrivals(flows.with_flow_key(packets))
    assert 60 <= kept.count() < 80
    found = beacon.scores(packets, flows.flows(packets)).first()
    assert (found.interval, found.jitter, found.times, found.samples_truncated) == (10.0, 0.0, 60, True)


def test_idle_handshakes_are_forgotten(spark, tmp_path):
    """A triple that nothing came of for the idle time starts again; without an idle time it goes on."""
    from netlens.sources.capture import pcap_header, pcap_record

    def syn(second, host):
        data = sample.ethernet(sample.ipv4(host, "10.0.0.2", 6, sample.tcp(50000, 80, 1, 2, b"")))
        return pcap_record((1_700_000_000 + second) * 1_000_000_000, len(data), data)

    (tmp_path / "in").mkdir()
    seen: dict[str, dict] = {"kept": {}, "idle": {}}
    for n, frames in enumerate(([syn(0, "10.0.0.1")], [syn(5000, "10.0.0.9")], [syn(5001, "10.0.0.9")], [syn(5002, "10.0.0.1")])):
        (tmp_path / "in" / f"{n}.pcap").write_bytes(pcap_header(1) + b"".join(frames))
        for name, idle in (("kept", None), ("idle", "10 minutes")):
            found = continuous.handshakes(continuous.packet_stream(spark, str(tmp_path / "in")), idle)

            def put(df, _, name=name):
                seen[name].update({r.src_ip: r.syns for r in df.collect()})

            continuous.publish(found, str(tmp_path / name), put, mode="update", once=True).awaitTermination()
    assert seen == {"kept": {"10.0.0.1": 2, "10.0.0.9": 2}, "idle": {"10.0.0.1": 1, "10.0.0.9": 2}}
