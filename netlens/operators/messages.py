"""Aggregates over application messages: DNS, TLS, HTTP and ARP.

Messages have ``ord``, a struct that orders them (index, origin, position), ``src_ip``, ``dst_ip``
and one of the structs ``dns``, ``tls``, ``http``. What depends on order takes the smallest or
largest ``ord``; nothing relies on the order of rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.functions import names, text

SUBDOMAINS, RESOLVED, RESOLVED_PER_NAME, CREDENTIALS = 10_000, 8192, 32, 50
ENTROPY, LONG_LABEL, MANY_SUBDOMAINS = 3.8, 12, 40


def _questions(messages: DataFrame) -> DataFrame:
    one = messages.where(F.col("dns").isNotNull())
    return one.select(
        "ord",
        F.col("dns.is_response").alias("is_response"),
        F.col("dns.rcode").alias("rcode"),
        F.explode("dns.questions").alias("q"),
    ).select("ord", "is_response", "rcode", text.ascii_lower(F.col("q.name")).alias("name"), F.col("q.qtype").alias("qtype"))


def dns_names(messages: DataFrame) -> DataFrame:
    """Queries, responses, NXDOMAIN responses and types of each name asked for."""
    asked = _questions(messages)
    response = F.col("is_response")
    return asked.groupBy("name").agg(
        F.count_if(~response).alias("queries"),
        F.count_if(response).alias("responses"),
        F.count_if(response & (F.col("rcode") == 3)).alias("nxdomain"),
        F.array_sort(F.collect_set("qtype")).alias("qtypes"),
        F.min("ord").alias("first"),
    )


def dns_subdomains(found: DataFrame) -> DataFrame:
    """Distinct names below each parent, at most 10000 counted, and the first of them."""
    below = found.select("name", text.parent_domain(F.col("name")).alias("parent")).where("parent <> name")
    return below.groupBy("parent").agg(
        F.least(F.count("*"), F.lit(SUBDOMAINS)).alias("subdomains"),
        F.min("name").alias("example"),
    )


def subdomain_volume(subdomains: DataFrame, least: int = MANY_SUBDOMAINS) -> DataFrame:
    return subdomains.where(F.col("subdomains") >= least)


def high_entropy(found: DataFrame, least: float = ENTROPY) -> DataFrame:
    """Names whose first label is long and of high entropy."""
    label = F.substring_index("name", ".", 1)
    scored = found.where(F.octet_length(label) >= LONG_LABEL).select(
        "name",
        (F.col("queries") + F.col("responses")).alias("lookups"),
        "nxdomain",
        text.entropy(label).alias("entropy"),
    )
    return scored.where(F.col("entropy") >= least)


def dns_servers(messages: DataFrame) -> DataFrame:
    server, key = (F.when(F.col("dns.is_response"), F.col(f"src_{x}")).otherwise(F.col(f"dst_{x}")) for x in ("ip", "key"))
    return messages.where(F.col("dns").isNotNull()).groupBy(
        server.alias("ip"),
        key.alias("key"),
    ).agg(F.count("*").alias("messages"))


def _addresses(messages: DataFrame) -> DataFrame:
    one = messages.where(F.col("dns").isNotNull() & F.col("dns.is_response")).select(
        "ord",
        F.posexplode("dns.answers").alias("pos", "a"),
    )
    return one.where(F.col("a.rtype").isin(1, 28) & F.col("a.data").rlike(text.IPV4 + "|" + text.IPV6)).select(
        "ord",
        "pos",
        text.ascii_lower(F.col("a.name")).alias("name"),
        F.col("a.data").alias("ip"),
    )


def dns_resolved(messages: DataFrame) -> DataFrame:
    """The last name that was answered with each address."""
    return _addresses(messages).groupBy("ip").agg(F.max_by("name", F.struct("ord", "pos")).alias("name"))


def dns_answers(messages: DataFrame, found: DataFrame) -> DataFrame:
    """Addresses of names that had been asked for by then, at most 32 of each."""
    known = _addresses(messages).join(found.select("name", "first"), "name").where(F.col("first") <= F.col("ord"))
    each = known.groupBy("name", "ip").agg(F.min(F.struct("ord", "pos")).alias("at"))
    return each.groupBy("name").agg(
        F.slice(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "ip"))), lambda x: x["ip"]),
            1,
            RESOLVED_PER_NAME,
        ).alias("resolved")
    )


def dns_overview(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count("*").alias("unique_names"),
        F.coalesce(F.sum("queries"), F.lit(0)).alias("queries"),
        F.coalesce(F.sum("nxdomain"), F.lit(0)).alias("nxdomain"),
    )


def tls_names(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("tls.sni").isNotNull()).groupBy(
        text.ascii_lower(F.col("tls.sni")).alias("sni")
    ).agg(F.count("*").alias("hellos"))


def tls_fingerprints(messages: DataFrame) -> DataFrame:
    """Client hellos of each fingerprint, and the server name of the first."""
    return messages.where(F.col("tls.kind") == "client").groupBy(F.col("tls.ja3").alias("ja3")).agg(
        F.count("*").alias("hellos"),
        F.min_by("tls.sni", "ord").alias("first_sni"),
    )


def tls_overview(messages: DataFrame) -> DataFrame:
    """Handshakes are hellos with a name and client hellos without."""
    hellos = messages.where(F.col("tls").isNotNull())
    named, bare = F.col("tls.sni").isNotNull(), F.col("tls.sni").isNull() & (F.col("tls.kind") == "client")
    return hellos.agg(
        F.count_if(named | bare).alias("handshakes"),
        F.count_distinct(text.ascii_lower(F.col("tls.sni"))).alias("unique_sni"),
        F.count_if(bare).alias("no_sni"),
        F.count_if(names.is_obsolete_tls(F.col("tls.version"))).alias("obsolete"),
    )


def ja3_text(version: Column, ciphers: Column, extensions: Column, groups: Column, formats: Column) -> Column:
    """What a client fingerprint hashes; values that only keep the protocol flexible are left out."""
    dashed = lambda a: F.array_join(F.filter(a, lambda v: ~names.is_grease(v)).cast("array<string>"), "-")
    return F.concat_ws(
        ",",
        version.cast("string"),
        dashed(ciphers),
        dashed(extensions),
        dashed(groups),
        F.array_join(formats.cast("array<string>"), "-"),
    )


def http_overview(messages: DataFrame) -> DataFrame:
    request = F.col("http.is_request")
    return messages.where(F.col("http").isNotNull()).agg(
        F.count_if(request).alias("requests"),
        F.count_if(~request).alias("responses"),
        F.count_if(request & F.col("http.has_authorization")).alias("cleartext_auth"),
    )


def http_hosts(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("http.host").isNotNull()).groupBy(
        text.ascii_lower(F.col("http.host")).alias("host")
    ).agg(F.count("*").alias("requests"))


def http_agents(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("http.user_agent").isNotNull()).groupBy(
        F.col("http.user_agent").alias("user_agent")
    ).agg(F.count("*").alias("requests"))


def http_credentials(messages: DataFrame) -> DataFrame:
    """The first 50 requests that carry credentials."""
    return messages.where(
        F.col("http.is_request")
        & F.col("http.has_authorization")
    ).orderBy("ord").limit(CREDENTIALS).select("ord", F.col("http.summary").alias("request"))


def top(found: DataFrame, count: str, key: str, n: int) -> DataFrame:
    return found.orderBy(F.desc(count), key).limit(n)


#: The distinct values of a flow that are kept, by kind: the first that arrive.
FLOW_VALUES = {"dns_names": 256, "http_hosts": 64, "user_agents": 16}


def flow_values(messages: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``dns_names``, ``http_hosts`` and ``user_agents`` of each flow: of each the first distinct ones by arrival, sorted.

    Values are made distinct before they are ranked, so a flow that repeats itself brings few rows, and only what
    is kept is gathered.
    """
    value = lambda kind, v, pos: F.struct(F.lit(kind).alias("kind"), v.alias("value"), pos.alias("pos"))
    asked = F.transform(F.coalesce("dns.questions", F.array()), lambda q, i: value("dns_names", q["name"], i))
    told = F.concat(
        asked,
        F.array(value("http_hosts", F.col("http.host"), F.lit(0)), value("user_agents", F.col("http.user_agent"), F.lit(0))),
    )
    each = messages.select(*key, "ord", F.explode(told).alias("v")).where(F.col("v.value").isNotNull())
    first = each.groupBy(*key, "v.kind", "v.value").agg(F.min(F.struct("ord", "v.pos")).alias("at"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy(*key, "kind").orderBy("at")))
    kept = None
    for kind, most in FLOW_VALUES.items():
        within = (F.col("kind") == kind) & (F.col("n") <= most)
        kept = within if kept is None else kept | within
    gathered = [F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))).alias(kind) for kind in FLOW_VALUES]
    return ranked.where(kept).groupBy(*key).agg(*gathered)


def flow_messages(messages: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """What messages tell of their flow: protocols, names, the first SNI and client fingerprint, the version that counts."""
    tls, version = F.col("tls"), F.col("tls.version")
    server, client = F.col("tls.kind") == "server", F.col("tls.kind") == "client"
    first = lambda value, cond: F.min_by(value, F.when(cond, F.col("ord")))
    told = messages.groupBy(*key).agg(
        F.array_sort(
            F.collect_set(
                F.when(F.col("dns").isNotNull(), "dns").when(F.col("http").isNotNull(), "http").when(tls.isNotNull(), "tls")
            )
        ).alias("protocols"),
        first(F.col("tls.sni"), F.col("tls.sni").isNotNull()).alias("sni"),
        first(F.col("tls.ja3"), client).alias("ja3"),
        F.coalesce(F.max_by(version, F.when(server, F.col("ord"))), first(version, client)).alias("tls_version"),
        F.coalesce(F.max(F.col("http.has_authorization")), F.lit(False)).alias("cleartext_credentials"),
    )
    values = flow_values(messages, key).select(*(F.col(k).alias(f"_{k}") for k in key), *FLOW_VALUES)
    same = None
    for k in key:
        same = told[k].eqNullSafe(values[f"_{k}"]) if same is None else same & told[k].eqNullSafe(values[f"_{k}"])
    none = F.array().cast("array<string>")
    return told.join(values, same, "left").select(*told.columns, *(F.coalesce(kind, none).alias(kind) for kind in FLOW_VALUES))


def arp_claims(packets: DataFrame) -> DataFrame:
    """Distinct pairs of ``ip`` and the ``mac`` that replied for it."""
    replies = packets.where((F.col("arp.op") == 2) & (F.col("arp.sender_ip") != "0.0.0.0"))
    return replies.select(F.col("arp.sender_ip").alias("ip"), F.col("arp.sender_mac").alias("mac")).distinct()


def arp_bindings(packets: DataFrame) -> DataFrame:
    """Hardware addresses that replied for each protocol address."""
    return bindings_of_claims(arp_claims(packets))


def bindings_of_claims(claims: DataFrame) -> DataFrame:
    return claims.groupBy("ip").agg(F.array_sort(F.collect_list("mac")).alias("macs"))


def arp_conflicts(bindings: DataFrame) -> DataFrame:
    return bindings.where(F.size("macs") > 1)


def arp_counters(packets: DataFrame) -> DataFrame:
    op = F.col("arp.op")
    return packets.where(F.col("arp").isNotNull()).agg(
        F.count_if(op == 1).alias("requests"),
        F.count_if(op == 2).alias("replies"),
        F.count_if(F.col("arp.sender_ip") == F.col("arp.target_ip")).alias("gratuitous"),
    )
