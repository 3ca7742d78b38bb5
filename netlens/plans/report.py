"""The report: a versioned document of small tables, as JSON, text or HTML, and the exit gate."""

import json
import textwrap
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.functions import names, text
from netlens.operators import flows, messages
from netlens.plans.analysis import SEVERITIES, Analysis

SCHEMA_VERSION = 1
WIDTH = 92


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _pairs(df: DataFrame) -> list[list]:
    return [list(r) for r in df.collect()]


def build(a: Analysis, source: str, now: float | None = None) -> dict:
    """All sections. Each is cut to the top rows on Spark before it is collected."""
    n, c = a.settings.top, F.col
    total = _rows(a.counters().withColumns({"first": text.rfc3339(c("first_ns")), "last": text.rfc3339(c("last_ns"))}))[0]
    total |= {"flows": a.flows.count(), "hosts": a.hosts.count()}
    shown = flows.top_flows(a.flows, n).select(
        "flow",
        "client_ip",
        "client_port",
        "server_ip",
        "server_port",
        "scope",
        "service",
        "packets",
        "bytes",
        "up_payload",
        "down_payload",
        "duration",
        "reset",
        "protocols",
        "sni",
        "ja3",
        F.when(c("tls_version").isNotNull(), names.tls_version(c("tls_version"))).alias("tls_version"),
        "http_hosts",
        "cleartext_credentials",
        c("destination").alias("resolved_dest"),
    )
    top = lambda df, count, key: _pairs(messages.top(df, count, key, n).select(key, count))
    asked = a.names.select("name", (c("queries") + c("responses")).alias("n"))
    hits = a.indicator_hits()
    report = {
        "schema_version": SCHEMA_VERSION,
        "tool": "netlens",
        "generated_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(now)),
        "source": source,
        "summary": total,
        "findings": [
            {k: v for k, v in f.items() if k != "severity_rank" and (k != "technique" or v)}
            for f in _rows(a.findings())
        ],
        "talkers": _rows(flows.top_talkers(a.hosts, n).drop("key")),
        "services": _rows(flows.top_services(flows.services(a.flows), n)),
        "top_flows": [{k: v for k, v in f.items() if k != "resolved_dest" or v is not None} for f in _rows(shown)],
        "beacons": _rows(
            a.beacons().limit(n).select(
                "flow",
                "destination",
                "sni",
                "interval",
                "jitter",
                "confidence",
                "samples",
                "total_seconds",
                "samples_truncated",
            )
        ),
        "dns": _rows(messages.dns_overview(a.names))[0] | {
            "top_names": top(asked, "n", "name"),
            "top_parents": top(a.subdomains(), "subdomains", "parent"),
            "servers": _pairs(
                messages.dns_servers(a.messages).orderBy(F.desc("messages"), "key").limit(n).select("ip", "messages")
            ),
        },
        "tls": _rows(messages.tls_overview(a.messages))[0] | {
            "top_sni": top(messages.tls_names(a.messages), "hellos", "sni"),
            "top_ja3": top(messages.tls_fingerprints(a.messages), "hellos", "ja3"),
        },
        "http": _rows(messages.http_overview(a.messages))[0] | {
            "top_hosts": top(messages.http_hosts(a.messages), "requests", "host"),
            "top_agents": top(messages.http_agents(a.messages), "requests", "user_agent"),
        },
        "timeline": _pairs(a.timeline().orderBy("second")),
    }
    if hits is not None:
        report["ioc"] = {
            k: [{x: y for x, y in h.items() if x != "tag" or y is not None} for h in _rows(v)]
            for k, v in hits.items()
        }
    return report


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False, default=str)


def to_html(report: dict) -> str:
    """A page that shows the report from JSON in a script tag."""
    data = json.dumps(report, ensure_ascii=False, default=str).replace("<", "\\u003c")
    return f"""<!DOCTYPE html><html><head><meta charset="utf-8"><title>netlens report</title><style>body{{font:14px sans-serif;margin:2em}}td,th{{padding:.2em .8em;text-align:left}}</style></head>
<body><h1>netlens report</h1><div id="out"></div><script id="report" type="application/json">{data}</script>
<script>const r=JSON.parse(document.getElementById("report").textContent),o=document.getElementById("out");
for(const [k,v] of Object.entries(r)){{const h=document.createElement("h2");h.textContent=k;const p=document.createElement("pre");p.textContent=JSON.stringify(v,null,1);o.append(h,p)}}</script></body></html>"""


def table(headers: list[str], rows: list[list], right: tuple[int, ...] = ()) -> str:
    """Columns as wide as their widest cell; those in ``right`` are flush right."""
    if not rows:
        return "  (none)"
    cells = [headers, *([str(x) if x is not None else "-" for x in r] for r in rows)]
    widths = [max(len(r[k]) for r in cells) for k in range(len(headers))]
    return "\n".join(
        "  " + "  ".join(
            x.rjust(w)
            if k in right else x.ljust(w)
            for k, (x, w) in enumerate(zip(r, widths, strict=True))
        ).rstrip()
        for r in cells
    )


def to_text(report: dict) -> str:
    """The report for a terminal."""
    s = report["summary"]
    out = [
        f"netlens: {report['source']}",
        "",
        "SUMMARY",
        table(
            ["packets", "bytes", "flows", "hosts", "seconds"],
            [[s["packets"], s["wire_bytes"], s["flows"], s["hosts"], f"{s['duration']:.2f}"]],
            (0, 1, 2, 3, 4),
        ),
        "",
        "FINDINGS",
    ]
    for f in report["findings"]:
        out += [
            f"  [{f['severity'].upper()}] {f['title']} ({f['id']})",
            *textwrap.wrap(f["detail"], WIDTH, initial_indent="    ", subsequent_indent="    "),
            *(f"      - {e}" for e in f["evidence"]),
        ]
    if not report["findings"]:
        out.append("  (none)")
    sections = (
        ("TALKERS", "talkers", ("ip", "total_bytes", "peers")),
        ("SERVICES", "services", ("service", "port", "protocol", "flows", "bytes")),
        ("FLOWS", "top_flows", ("flow", "service", "packets", "bytes")),
        ("BEACONS", "beacons", ("flow", "interval", "jitter", "confidence")),
    )
    for title, key, columns in sections:
        out += ["", title, table(list(columns), [[r[x] for x in columns] for r in report[key]])]
    for title, section, key in (("DNS", "dns", "top_names"), ("TLS", "tls", "top_sni"), ("HTTP", "http", "top_hosts")):
        out += ["", title, table(["name", "count"], report[section][key], (1,))]
    return "\n".join(out)


def gate(findings: DataFrame, level: str) -> int:
    """2 if any finding is at least as grave as the level, else 0."""
    return 2 if findings.where(F.col("severity_rank") >= SEVERITIES.index(level)).limit(1).count() else 0
