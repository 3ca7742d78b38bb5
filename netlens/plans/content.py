"""Queries on names, messages and indicators derived from the driver's tables, and the same in SQL."""

from pyspark.sql import functions as F

from netlens.functions import names as fn
from netlens.functions import text
from netlens.operators import flows, indicators, messages
from netlens.plans import views
from netlens.plans.traffic import _F, _H
from netlens.plans.views import PKT, URL_NAMES, _sql_ip

QTYPES, VERSIONS = (1, 28, 16), (0x0301, 0x0302, 0x0303, 0x0304, 0x0303)
ANSWER_BASE = 3405803776
MESSAGE_TYPES = {
    "dns": "struct<is_response:boolean,rcode:int,questions:array<struct<name:string,qtype:int>>,answers:array<struct<name:string,rtype:int,data:string>>>",
    "tls": "struct<kind:string,version:int,sni:string,ja3:string>",
    "http": "struct<is_request:boolean,host:string,user_agent:string,has_authorization:boolean,summary:string>",
}


def _messages(spark, sf_dir, kind, value):
    n = F.col("index")
    base = views.url_names(spark, sf_dir).select(
        F.struct("index", F.lit(0).alias("origin"), F.lit(0).alias("pos")).alias("ord"),
        F.lit("10.0.0.9").alias("src_ip"),
        F.concat(F.lit("9.9.9."), (n % 5).cast("string")).alias("dst_ip"),
        F.lit(b"\x04\x0a\0\0\x09").alias("src_key"),
        F.unhex(F.concat(F.lit("040909090"), (n % 5).cast("string"))).alias("dst_key"),
        value(n).cast(MESSAGE_TYPES[kind]).alias(kind)
    )
    return base.withColumns({k: F.lit(None).cast(t) for k, t in MESSAGE_TYPES.items() if k != kind})


def _dns(spark, sf_dir, name=None):
    def value(n):
        question = F.struct(
            (F.col("host") if name is None else name).alias("name"),
            F.element_at(F.array(*map(F.lit, QTYPES)), (n % 3 + 1).cast("int")).alias("qtype"),
        )
        answer = F.struct(
            F.col("host").alias("name"),
            F.lit(1).alias("rtype"),
            F.concat(F.lit("203.0.113."), (n % 9).cast("string")).alias("data"),
        )
        return F.struct(
            (n % 2 == 1).alias("is_response"),
            F.when(n % 5 == 1, 3).otherwise(0).alias("rcode"),
            F.array(question).alias("questions"),
            F.when(n % 2 == 1, F.array(answer)).otherwise(
                F.array().cast("array<struct<name:string,rtype:int,data:string>>")
            ).alias("answers"),
        )

    return _messages(spark, sf_dir, "dns", value)


def _tls(spark, sf_dir):
    return _messages(
        spark,
        sf_dir,
        "tls",
        lambda n: F.struct(
            F.when(n % 4 == 0, "server").otherwise("client").alias("kind"),
            F.element_at(F.array(*map(F.lit, VERSIONS)), (n % 5 + 1).cast("int")).alias("version"),
            F.when(n % 7 != 0, F.col("host")).alias("sni"),
            F.md5("parent").alias("ja3"),
        ),
    )


def _http(spark, sf_dir):
    agent, request = F.concat(F.lit("agent/"), (F.col("index") % 6).cast("string")), F.col("index") % 3 != 0
    return _messages(
        spark,
        sf_dir,
        "http",
        lambda n: F.struct(
            request.alias("is_request"),
            F.when(request, F.when(n % 10 == 0, F.concat("host", F.lit(":8080"))).otherwise(F.col("host"))).alias("host"),
            F.when(request, agent).alias("user_agent"),
            (n % 9 == 1).alias("has_authorization"),
            F.concat(F.lit("GET http://"), "host").alias("summary"),
        ),
    )


def dns_names(spark, sf_dir):
    return messages.dns_names(_dns(spark, sf_dir)).select(
        "name",
        "queries",
        "responses",
        "nxdomain",
        F.array_join(F.col("qtypes").cast("array<string>"), ",").alias("qtypes"),
    )


def dns_subdomains(spark, sf_dir):
    return messages.dns_subdomains(messages.dns_names(_dns(spark, sf_dir)))


def dns_subdomain_volume(spark, sf_dir):
    return messages.subdomain_volume(messages.dns_subdomains(messages.dns_names(_dns(spark, sf_dir))), 3)


def dns_high_entropy(spark, sf_dir):
    """Every fourth name has a label of hexadecimal digits in front."""
    label = F.concat(F.substring(F.md5("url"), 1, 20), F.lit("."))
    return messages.high_entropy(
        messages.dns_names(_dns(spark, sf_dir, F.concat(F.when(F.col("index") % 4 == 0, label).otherwise(""), "host"))),
        3.3,
    )


def dns_servers(spark, sf_dir):
    return messages.dns_servers(_dns(spark, sf_dir)).drop("key")


def dns_resolved(spark, sf_dir):
    return messages.dns_resolved(_dns(spark, sf_dir))


def dns_answers(spark, sf_dir):
    found = _dns(spark, sf_dir)
    return messages.dns_answers(found, messages.dns_names(found)).select("name", F.array_join("resolved", ",").alias("resolved"))


def dns_overview(spark, sf_dir):
    return messages.dns_overview(messages.dns_names(_dns(spark, sf_dir)))


def tls_names(spark, sf_dir):
    return messages.top(messages.tls_names(_tls(spark, sf_dir)), "hellos", "sni", 20)


def tls_fingerprints(spark, sf_dir):
    return messages.tls_fingerprints(_tls(spark, sf_dir))


def tls_overview(spark, sf_dir):
    return messages.tls_overview(_tls(spark, sf_dir))


def tls_version_names(spark, sf_dir):
    return _tls(spark, sf_dir).groupBy(fn.tls_version(F.col("tls.version")).alias("version")).agg(F.count("*").alias("hellos"))


def flow_values(spark, sf_dir):
    """The first distinct hosts and agents of each flow."""
    found = _http(spark, sf_dir).withColumn(
        "http",
        F.col("http").withField(
            "user_agent",
            F.when(F.col("http.is_request"), F.concat(F.lit("agent/"), F.expr("ord.index div 7").cast("string"))),
        ),
    )
    kept = messages.flow_values(found, ("dst_ip",))
    return kept.select("dst_ip", *(F.array_join(kind, ",").alias(kind) for kind in ("http_hosts", "user_agents")))


def http_overview(spark, sf_dir):
    return messages.http_overview(_http(spark, sf_dir))


def http_hosts(spark, sf_dir):
    return messages.top(messages.http_hosts(_http(spark, sf_dir)), "requests", "host", 20)


def http_agents(spark, sf_dir):
    return messages.top(messages.http_agents(_http(spark, sf_dir)), "requests", "user_agent", 20)


def http_credentials(spark, sf_dir):
    return messages.http_credentials(_http(spark, sf_dir)).select("ord.index", "request")


def _arp(spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier")
    mac = F.concat(F.lit("02:00:00:00:00:"), F.lpad(F.lower(F.hex(F.col("s_suppkey") % 16)), 2, "0"))
    return s.select(
        F.struct(
            (F.col("s_suppkey") % 3).cast("int").alias("op"),
            mac.alias("sender_mac"),
            F.concat(F.lit("10.0.1."), F.col("s_nationkey").cast("string")).alias("sender_ip"),
            F.concat(F.lit("10.0.1."), (F.col("s_suppkey") % 25).cast("string")).alias("target_ip"),
        ).alias("arp")
    )


def arp_bindings(spark, sf_dir):
    return messages.arp_bindings(_arp(spark, sf_dir)).select("ip", F.array_join("macs", ",").alias("macs"))


def arp_conflicts(spark, sf_dir):
    return messages.arp_conflicts(messages.arp_bindings(_arp(spark, sf_dir))).select("ip", F.size("macs").alias("macs"))


def arp_counters(spark, sf_dir):
    return messages.arp_counters(_arp(spark, sf_dir))


def flow_first_last(spark, sf_dir):
    """First and last values by order, of conversations."""
    c = views.table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(
        F.min_by("role", "turn").alias("first_role"),
        F.max_by("role", "turn").alias("last_role"),
        F.max_by(F.length("text"), "turn").cast("long").alias("last_length"),
    )


def flow_destinations(spark, sf_dir):
    """Flows with the name that last resolved to their server."""
    found = flows.flows(views.pkt(spark, sf_dir)).select(
        "flow",
        "server_ip",
        F.concat(F.lit("203.0.113."), F.substring_index("server_ip", ".", -1)).alias("ip"),
    )
    return found.join(messages.dns_resolved(_dns(spark, sf_dir)), "ip", "left").select("flow", F.col("name").alias("destination"))


LISTED = (
    ("10.0.0.7", "list-a", "bot"),
    ("10.0.0.0/28", "list-a", None),
    ("10.0.0.0/24", "list-b", "wide"),
    ("93.184.216.0/30", "list-b", None),
    ("example.com", "list-a", "parent"),
    ("m.ththth.example.net", "list-b", None),
    ("example.net.", "list-a", None),
    ("10.0.0.7", "list-b", "later"),
    ("not an indicator", "list-b", None),
    ("10.0.0.0/33", "list-b", None),
)


def _listed(spark):
    tokens = spark.createDataFrame(
        [(t, s, g, k) for k, (t, s, g) in enumerate(LISTED)],
        "token string, source string, tag string, ord int",
    )
    return indicators.union(indicators.classify(tokens))


def ioc_addresses(spark, sf_dir):
    hosts = flows.hosts(views.pkt(spark, sf_dir)).select(
        "ip",
        "key",
        (F.col("sent_packets") + F.col("received_packets")).alias("count"),
    )
    return indicators.ordered_hits(indicators.address_hits(hosts, _listed(spark)))


def ioc_domains(spark, sf_dir):
    dns = messages.dns_names(_dns(spark, sf_dir)).withColumn("n", F.col("queries") + F.col("responses"))
    whole = indicators.merged_names(
        (dns, "name", "n", "dns"),
        (messages.http_hosts(_http(spark, sf_dir)), "host", "requests", "http"),
        (messages.tls_names(_tls(spark, sf_dir)), "sni", "hellos", "tls"),
    )
    return indicators.ordered_hits(indicators.domain_hits(whole, _listed(spark)))


def ioc_fingerprints(spark, sf_dir):
    listed = views.url_names(spark, sf_dir).where("parent = 'example.com'").select(
        F.lit("ja3").alias("kind"),
        F.md5("parent").alias("value"),
        F.lit("list-c").alias("source"),
        F.lit("stack").alias("tag"),
    ).distinct()
    return indicators.fingerprint_hits(messages.tls_fingerprints(_tls(spark, sf_dir)), listed)


def ioc_union(spark, sf_dir):
    return _listed(spark).select("kind", "value", "source", "tag")


def url_hosts(spark, sf_dir):
    return views.url_names(spark, sf_dir).select("url", "host", "parent")


def name_entropy(spark, sf_dir):
    return views.url_names(spark, sf_dir).select("host").distinct().select(
        "host",
        F.round(text.entropy(F.col("host")), 9).alias("entropy"),
    )


def token_kinds(spark, sf_dir):
    """Kinds of the address-shaped and domain-shaped words of documents."""
    word = F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9./-]*\.[A-Za-z0-9./-]+"), F.lit(0))).alias("token")
    # Each distinct token is classified once.
    tokens = views.table(spark, sf_dir, "documents").select(word).groupBy("token").agg(F.count("*").alias("n"))
    return tokens.groupBy(text.indicator_kind(F.col("token")).alias("kind")).agg(
        F.sum("n").alias("tokens"),
        F.count("*").alias("distinct_tokens"),
    )


def private_hosts(spark, sf_dir):
    return flows.hosts(views.pkt(spark, sf_dir)).groupBy("private").agg(
        F.count("*").alias("hosts"),
        F.sum("total_bytes").alias("bytes"),
    )


def human_figures(spark, sf_dir):
    """Bytes, shares and durations as people read them."""
    o = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"))
    return o.select(
        "n",
        text.human_bytes(F.col("n") * 1024 * 512).alias("bytes"),
        text.human_duration(F.col("n") * 7.0).alias("duration"),
        text.human_percent((F.col("n") + 0.04) / 400.0).alias("share"),
    )


def enriched_orders(spark, sf_dir):
    t = lambda n: views.table(spark, sf_dir, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(
        F.broadcast(t("nation")),
        F.col("c_nationkey") == F.col("n_nationkey"),
        "left",
    ).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUERIES = {f.__name__: f for f in (
    dns_names,
    dns_subdomains,
    dns_subdomain_volume,
    dns_high_entropy,
    dns_servers,
    dns_resolved,
    dns_answers,
    dns_overview,
    tls_names,
    tls_fingerprints,
    tls_overview,
    tls_version_names,
    flow_values,
    http_overview,
    http_hosts,
    http_agents,
    http_credentials,
    arp_bindings,
    arp_conflicts,
    arp_counters,
    flow_first_last,
    flow_destinations,
    ioc_addresses,
    ioc_domains,
    ioc_fingerprints,
    ioc_union,
    url_hosts, name_entropy, token_kinds, private_hosts, human_figures, enriched_orders,
)}

_N = f"WITH {URL_NAMES}"
_Q = f"{_N}, q AS (SELECT idx, host AS name, parent, idx % 2 = 1 AS r, CASE WHEN idx % 5 = 1 THEN 3 ELSE 0 END AS rcode, [1, 28, 16][CAST(idx % 3 + 1 AS INT)] AS qtype FROM url_names)"
_T = f"{_N}, t AS (SELECT idx, CASE WHEN idx % 4 = 0 THEN 'server' ELSE 'client' END AS kind, [769, 770, 771, 772, 771][CAST(idx % 5 + 1 AS INT)] AS version, CASE WHEN idx % 7 <> 0 THEN host END AS sni, md5(parent) AS ja3 FROM url_names)"
_W = f"{_N}, w AS (SELECT idx, idx % 3 <> 0 AS req, CASE WHEN idx % 3 <> 0 THEN host || CASE WHEN idx % 10 = 0 THEN ':8080' ELSE '' END END AS host, CASE WHEN idx % 3 <> 0 THEN 'agent/' || idx % 6 END AS user_agent, idx % 9 = 1 AS auth, 'GET http://' || host AS request FROM url_names)"
_A = "WITH a AS (SELECT s_suppkey % 3 AS op, '02:00:00:00:00:' || lpad(printf('%x', s_suppkey % 16), 2, '0') AS mac, '10.0.1.' || s_nationkey AS ip, '10.0.1.' || s_suppkey % 25 AS target FROM supplier), b AS (SELECT ip, mac FROM a WHERE op = 2 GROUP BY ALL)"
_SUB = f"{_Q}, s AS (SELECT parent, count(DISTINCT name) AS subdomains, min(name) AS example FROM q WHERE parent <> name GROUP BY 1)"
_RES = "r AS (SELECT '203.0.113.' || idx % 9 AS ip, arg_max(name, idx) AS name FROM q WHERE r GROUP BY 1)"
_ENT = "entropies AS (SELECT host, label, -sum(c / n * log2(c / n)) AS entropy FROM (SELECT host, label, ch, count(*)::double AS c, any_value(length(label))::double AS n FROM (SELECT host, label, unnest(string_split(label, '')) AS ch FROM labels) WHERE ch <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2)"
_IOC = "ioc(kind, value, bits, source, tag, ord) AS (VALUES ('ip', 167772167, 32, 'list-b', 'later', 7), ('cidr', 167772160, 28, 'list-a', NULL, 1), ('cidr', 167772160, 24, 'list-b', 'wide', 2), ('cidr', 1572395008, 30, 'list-b', NULL, 3))"
ORACLE_SQL = {
    "dns_names": f"{_Q} SELECT name, count(*) FILTER (NOT r) AS queries, count(*) FILTER (r) AS responses, count(*) FILTER (r AND rcode = 3) AS nxdomain, array_to_string(list_sort(list(DISTINCT qtype)), ',') AS qtypes FROM q GROUP BY 1",
    "dns_subdomains": f"{_SUB} SELECT * FROM s",
    "dns_subdomain_volume": f"{_SUB} SELECT * FROM s WHERE subdomains >= 3",
    "dns_high_entropy": f"""{_N}, q AS (SELECT idx % 2 = 1 AS r, CASE WHEN idx % 5 = 1 THEN 3 ELSE 0 END AS rcode, CASE WHEN idx % 4 = 0 THEN substr(md5(url), 1, 20) || '.' ELSE '' END || host AS name FROM url_names),
labels AS (SELECT DISTINCT name AS host, split_part(name, '.', 1) AS label FROM q), {_ENT}
SELECT e.host AS name, count(*) AS lookups, count(*) FILTER (r AND rcode = 3) AS nxdomain, any_value(entropy) AS entropy FROM q JOIN entropies e ON e.host = q.name WHERE strlen(label) >= 12 AND entropy >= 3.3 GROUP BY 1""",
    "flow_values": f"""{_W}, f AS (SELECT idx, '9.9.9.' || idx % 5 AS dst_ip, host, CASE WHEN req THEN 'agent/' || idx // 7 END AS agent FROM w),
v AS (SELECT dst_ip, 'host' AS kind, host AS v, min(idx) AS arrived FROM f WHERE host IS NOT NULL GROUP BY ALL UNION ALL SELECT dst_ip, 'agent', agent, min(idx) FROM f WHERE agent IS NOT NULL GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY dst_ip, kind ORDER BY arrived) AS n FROM v)
SELECT dst_ip, array_to_string(list_sort(list(v) FILTER (kind = 'host' AND n <= 64)), ',') AS http_hosts, array_to_string(list_sort(list(v) FILTER (kind = 'agent' AND n <= 16)), ',') AS user_agents FROM n GROUP BY 1""",
    "dns_servers": f"{_Q} SELECT CASE WHEN r THEN '10.0.0.9' ELSE '9.9.9.' || idx % 5 END AS ip, count(*) AS messages FROM q GROUP BY 1",
    "dns_resolved": f"{_Q}, {_RES} SELECT * FROM r",
    "dns_answers": f"{_Q}, f AS (SELECT name, min(idx) AS first FROM q GROUP BY 1), e AS (SELECT name, '203.0.113.' || idx % 9 AS ip, min(idx) AS seen FROM q JOIN f USING (name) WHERE r AND first <= idx GROUP BY 1, 2) SELECT name, string_agg(ip, ',' ORDER BY seen) AS resolved FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seen) AS n FROM e) WHERE n <= 32 GROUP BY 1",
    "dns_overview": f"{_Q} SELECT count(DISTINCT name) AS unique_names, count(*) FILTER (NOT r) AS queries, count(*) FILTER (r AND rcode = 3) AS nxdomain FROM q",
    "tls_names": f"{_T} SELECT sni, count(*) AS hellos FROM t WHERE sni IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "tls_fingerprints": f"{_T} SELECT ja3, count(*) AS hellos, arg_min_null(sni, idx) AS first_sni FROM t WHERE kind = 'client' GROUP BY 1",
    "tls_overview": f"{_T} SELECT count(*) FILTER (sni IS NOT NULL OR kind = 'client') AS handshakes, count(DISTINCT sni) AS unique_sni, count(*) FILTER (sni IS NULL AND kind = 'client') AS no_sni, count(*) FILTER (version BETWEEN 768 AND 770) AS obsolete FROM t",
    "tls_version_names": f"{_T} SELECT CASE version WHEN 769 THEN 'TLS 1.0' WHEN 770 THEN 'TLS 1.1' WHEN 771 THEN 'TLS 1.2' ELSE 'TLS 1.3' END AS version, count(*) AS hellos FROM t GROUP BY 1",
    "http_overview": f"{_W} SELECT count(*) FILTER (req) AS requests, count(*) FILTER (NOT req) AS responses, count(*) FILTER (req AND auth) AS cleartext_auth FROM w",
    "http_hosts": f"{_W} SELECT host, count(*) AS requests FROM w WHERE host IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "http_agents": f"{_W} SELECT user_agent, count(*) AS requests FROM w WHERE user_agent IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "http_credentials": f"{_W.replace(chr(39) + 'GET http://' + chr(39) + ' || host', chr(39) + 'GET http://' + chr(39) + ' || url_names.host')} SELECT idx AS index, request FROM w WHERE req AND auth ORDER BY idx LIMIT 50",
    "arp_bindings": f"{_A} SELECT ip, string_agg(mac, ',' ORDER BY mac) AS macs FROM b GROUP BY 1",
    "arp_conflicts": f"{_A} SELECT ip, CAST(count(*) AS INT) AS macs FROM b GROUP BY 1 HAVING count(*) > 1",
    "arp_counters": f"{_A} SELECT count(*) FILTER (op = 1) AS requests, count(*) FILTER (op = 2) AS replies, count(*) FILTER (ip = target) AS gratuitous FROM a",
    "flow_first_last": "SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, arg_max(length(text), turn) AS last_length FROM conversations GROUP BY 1",
    "flow_destinations": f"{_Q}, {_RES}, {_F[5:]} SELECT flow, name AS destination FROM flows LEFT JOIN r ON r.ip = '203.0.113.' || split_part(server_ip, '.', 4)",
    "ioc_addresses": f"""WITH {PKT}, {_IOC}, h AS (SELECT ip, count(*) AS count FROM (SELECT src AS ip FROM pkt UNION ALL SELECT dst FROM pkt) GROUP BY 1),
m AS (SELECT h.ip, h.count, ioc.*, row_number() OVER (PARTITION BY h.ip ORDER BY CASE kind WHEN 'ip' THEN 0 ELSE 1 END, ord) AS n FROM h JOIN ioc ON (h.ip >> (32 - bits)) = (value >> (32 - bits)))
SELECT {_sql_ip('value')} || CASE kind WHEN 'cidr' THEN '/' || bits ELSE '' END AS indicator, {_sql_ip('ip')} AS observed, 'host' AS context, source, tag, count FROM m WHERE n = 1""",
    "ioc_domains": f"""{_Q}, t AS (SELECT CASE WHEN idx % 7 <> 0 THEN host END AS sni FROM url_names), w AS (SELECT CASE WHEN idx % 3 <> 0 THEN host || CASE WHEN idx % 10 = 0 THEN ':8080' ELSE '' END END AS host FROM url_names),
seen AS (SELECT name AS observed, 'dns' AS context FROM q UNION ALL SELECT host, 'http' FROM w WHERE host IS NOT NULL UNION ALL SELECT sni, 'tls' FROM t WHERE sni IS NOT NULL),
merged AS (SELECT observed, count(*) AS count, array_to_string(list_sort(list(DISTINCT context)), '/') AS context FROM seen GROUP BY 1),
listed(value, source, tag) AS (VALUES ('example.com', 'list-a', 'parent'), ('m.ththth.example.net', 'list-b', NULL), ('example.net', 'list-a', NULL)),
m AS (SELECT *, row_number() OVER (PARTITION BY observed ORDER BY length(value) DESC) AS n FROM merged JOIN listed ON observed = value OR ends_with(observed, '.' || value))
SELECT value AS indicator, observed, context, source, tag, count FROM m WHERE n = 1""",
    "ioc_fingerprints": f"{_T} SELECT ja3 AS indicator, ja3 AS observed, coalesce('sni=' || arg_min_null(sni, idx), 'tls client') AS context, 'list-c' AS source, 'stack' AS tag, count(*) AS count FROM t WHERE kind = 'client' AND ja3 = md5('example.com') GROUP BY 1",
    "ioc_union": "SELECT * FROM (VALUES ('ip', '10.0.0.7', 'list-b', 'later'), ('cidr', '10.0.0.0/28', 'list-a', NULL), ('cidr', '10.0.0.0/24', 'list-b', 'wide'), ('cidr', '93.184.216.0/30', 'list-b', NULL), ('domain', 'example.com', 'list-a', 'parent'), ('domain', 'm.ththth.example.net', 'list-b', NULL), ('domain', 'example.net', 'list-a', NULL)) v(kind, value, source, tag)",
    "url_hosts": f"{_N} SELECT url, host, parent FROM url_names",
    "name_entropy": f"{_N}, labels AS (SELECT DISTINCT host, host AS label FROM url_names), {_ENT} SELECT host, round(entropy, 9) AS entropy FROM entropies",
    "token_kinds": r"""WITH t AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9./-]*\.[A-Za-z0-9./-]+')) AS token FROM documents),
k AS (SELECT token, CASE WHEN contains(token, '/') THEN CASE WHEN regexp_matches(token, '^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)/([12]?\d|3[0-2])$') THEN 'cidr' END
  WHEN regexp_matches(token, '^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$') THEN 'ip' ELSE 'domain' END AS kind FROM t)
SELECT kind, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens FROM k GROUP BY 1""",
    "private_hosts": f"{_H} SELECT private, count(*) AS hosts, CAST(sum(total_bytes) AS BIGINT) AS bytes FROM hosts GROUP BY 1",
    "human_figures": """SELECT p_partkey AS n, CASE WHEN p_partkey = 0 THEN '0 B' WHEN p_partkey < 2 THEN '512.0 KB' WHEN p_partkey < 2048 THEN printf('%.1f MB', p_partkey / 2.0::double) ELSE printf('%.1f GB', p_partkey / 2048.0::double) END AS bytes,
CASE WHEN p_partkey = 0 THEN '0ms' WHEN p_partkey * 7 < 60 THEN printf('%.1fs', p_partkey * 7.0::double) WHEN p_partkey * 7 < 3600 THEN printf('%dm%02ds', p_partkey * 7 // 60, p_partkey * 7 % 60) ELSE printf('%dh%02dm', p_partkey * 7 // 3600, p_partkey * 7 % 3600 // 60) END AS duration,
CASE WHEN p_partkey = 0 THEN printf('%.3f%%', 0.01::double) WHEN p_partkey >= 40 THEN printf('%.0f%%', (p_partkey + 0.04::double) / 4) WHEN p_partkey >= 4 THEN printf('%.1f%%', (p_partkey + 0.04::double) / 4) ELSE printf('%.2f%%', (p_partkey + 0.04::double) / 4) END AS share FROM part""",
    "enriched_orders": "SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
}
