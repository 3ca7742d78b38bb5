"""Indicators: classification, union, and joins with hosts, names and fingerprints.

Indicators have ``kind`` (ip, cidr, domain, ja3), ``value``, ``source``, ``tag`` and ``ord``, their
place in the lists. Address joins use keys (see ``functions.addresses``). A range join is an
equi-join for each distinct prefix length, suffix matches are an equi-join on exploded suffixes;
neither compares every pair, however long the lists are.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions import addresses, text


def classify(tokens: DataFrame) -> DataFrame:
    """Indicators from ``token``, ``source``, ``tag`` and ``ord``; tokens that are none are dropped."""
    kind = text.indicator_kind(F.col("token"))
    value = F.when(kind == "ip", F.col("token")).otherwise(text.ascii_lower(F.rtrim("token", F.lit("."))))
    return tokens.select(kind.alias("kind"), value.alias("value"), "source", "tag", "ord").where(F.col("kind").isNotNull())


def union(*sets: DataFrame) -> DataFrame:
    """All indicators once: the provenance of the last list counts. Ranges are kept as they are listed."""
    numbered = [s.withColumn("list", F.lit(k)) for k, s in enumerate(sets)]
    whole = numbered[0]
    for s in numbered[1:]:
        whole = whole.unionByName(s)
    order = F.struct("list", "ord")
    ranges = whole.where("kind = 'cidr'").select("kind", "value", "source", "tag", order.alias("ord"))
    last = whole.where("kind <> 'cidr'").groupBy("kind", "value").agg(
        F.max_by(F.struct("source", "tag"), order).alias("p"),
        F.max(order).alias("ord"),
    )
    return ranges.unionByName(last.select("kind", "value", "p.source", "p.tag", "ord"))


def key_of_text(ip: Column) -> Column:
    """Key of an IPv4 address's text. IPv6 text is expanded group by group."""
    octets = F.transform(F.split(ip, r"\."), lambda o: F.lpad(F.hex(o.cast("long")), 2, "0"))
    v4 = F.unhex(F.concat(F.lit("04"), F.array_join(octets, "")))
    halves = F.split(ip, "::")
    groups = lambda half: F.transform(F.filter(F.split(half, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))
    left, right = groups(F.get(halves, 0)), groups(F.coalesce(F.get(halves, 1), F.lit("")))
    v6 = F.unhex(
        F.concat(
            F.lit("06"),
            F.array_join(F.concat(left, F.array_repeat(F.lit("0000"), F.lit(8) - F.size(left) - F.size(right)), right), ""),
        )
    )
    return F.when(ip.rlike(text.IPV4), v4).when(ip.rlike(text.IPV6), v6)


def address_hits(hosts: DataFrame, found: DataFrame) -> DataFrame:
    """Hosts (``ip``, ``key``, ``count``) that an address or range names: an exact address beats ranges, of ranges the first listed counts."""
    exact = found.where("kind = 'ip'").select(
        key_of_text(F.col("value")).alias("key"),
        F.col("value").alias("indicator"),
        "source",
        "tag",
        "ord",
    )
    parts = F.split("value", "/")
    cidrs = found.where("kind = 'cidr'").select(
        F.col("value").alias("indicator"),
        "source",
        "tag",
        "ord",
        key_of_text(F.get(parts, 0)).alias("of"),
        F.get(parts, 1).cast("int").alias("bits"),
    )
    family = lambda key: F.length(key)  # noqa: E731  a key's length tells its family
    ranges = cidrs.select(
        "indicator",
        "source",
        "tag",
        "ord",
        "bits",
        addresses.prefix_of(F.col("of"), F.col("bits")).alias("prefix"),
    )
    # At most 33 + 129 rows: the lengths in use in each family, as a bounded table.
    lengths = cidrs.select(family("of").alias("family"), "bits").distinct()
    tried = hosts.select("ip", "key", "count", family("key").alias("family")).join(F.broadcast(lengths), "family").withColumn(
        "prefix",
        addresses.prefix_of(F.col("key"), F.col("bits")),
    )
    facts = F.struct(F.lit(1).alias("rank"), "ord", "indicator", "source", "tag")
    by_range = tried.join(ranges, ["bits", "prefix"]).select("ip", "key", "count", facts.alias("hit"))
    by_address = hosts.select("ip", "key", "count").join(exact, "key").select(
        "ip",
        "key",
        "count",
        F.struct(F.lit(0).alias("rank"), "ord", "indicator", "source", "tag").alias("hit"),
    )
    best = by_range.unionByName(by_address).groupBy("ip", "key", "count").agg(F.min("hit").alias("hit"))
    return best.select(
        F.col("hit.indicator").alias("indicator"),
        F.col("ip").alias("observed"),
        F.lit("host").alias("context"),
        "hit.source",
        "hit.tag",
        "count",
    )


def merged_names(*sets: tuple[DataFrame, str, str, str]) -> DataFrame:
    """Names from (frame, name column, count column, context): counts summed by lower-case name, contexts joined."""
    whole = None
    for df, name, count, context in sets:
        part = df.select(
            text.ascii_lower(F.col(name)).alias("observed"),
            F.col(count).alias("count"),
            F.lit(context).alias("context"),
        )
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy("observed").agg(
        F.sum("count").alias("count"),
        F.array_join(F.array_sort(F.collect_set("context")), "/").alias("context"),
    )


def domain_hits(names: DataFrame, found: DataFrame) -> DataFrame:
    """Names (``observed``, ``count``, ``context``) that a domain or a parent of it names; the most specific counts."""
    domains = found.where("kind = 'domain'").select(F.col("value").alias("indicator"), "source", "tag")
    tried = names.select(
        "observed",
        "count",
        "context",
        F.explode(text.suffixes(F.rtrim("observed", F.lit(".")))).alias("s"),
    ).select(
        "observed",
        "count",
        "context",
        F.col("s.depth").alias("depth"),
        F.col("s.suffix").alias("indicator"),
    )
    hits = tried.join(domains, "indicator").groupBy("observed", "count", "context").agg(
        F.min(F.struct("depth", "indicator", "source", "tag")).alias("hit")
    )
    return hits.select("hit.indicator", "observed", "context", "hit.source", "hit.tag", "count")


def fingerprint_hits(fingerprints: DataFrame, found: DataFrame) -> DataFrame:
    """Fingerprints (``ja3``, ``hellos``, ``first_sni``) that are listed."""
    listed = found.where("kind = 'ja3'").select(F.col("value").alias("indicator"), "source", "tag")
    seen = fingerprints.withColumn("indicator", text.ascii_lower(F.col("ja3")))
    return seen.join(listed, "indicator").select(
        "indicator",
        F.col("ja3").alias("observed"),
        F.coalesce(F.concat(F.lit("sni="), F.col("first_sni")), F.lit("tls client")).alias("context"),
        "source",
        "tag",
        F.col("hellos").alias("count"),
    )


def ordered_hits(hits: DataFrame) -> DataFrame:
    return hits.orderBy(F.desc("count"), "observed")
