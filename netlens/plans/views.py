"""Packets, names and tokens derived from the driver's tables, in Spark and in SQL."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.functions import addresses, text

CLIENT_BASE, SERVER_BASE = 167772160, 1572395008
SERVER_PORTS = (443, 80, 8443, 53, 25)
FLAG_SETS = (2, 18, 24, 16, 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple, by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _packets(rows: DataFrame) -> DataFrame:
    swap = F.col("swap")
    either = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    ends = rows.withColumns(
        {
            "src": either("client", "server"),
            "dst": either("server", "client"),
            "src_port": either("client_port", "server_port"),
            "dst_port": either("server_port", "client_port"),
        }
    )
    return ends.select(
        "index",
        "ts_ns",
        addresses.text_of_v4(F.col("src")).alias("src_ip"),
        addresses.text_of_v4(F.col("dst")).alias("dst_ip"),
        addresses.key_of_v4(F.col("src")).alias("src_key"),
        addresses.key_of_v4(F.col("dst")).alias("dst_key"),
        "src_port",
        "dst_port",
        "ip_proto",
        F.when(F.col("ip_proto") == 6, F.col("flags")).alias("tcp_flags"),
        "wire_len",
        F.col("wire_len").alias("captured_len"),
        (F.col("wire_len") - 54).alias("payload_len"),
    )


def pkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets from ``events``: one flow for each user."""
    e, user = table(spark, sf_dir, "events"), F.col("user_id")
    return _packets(e.select(
        F.col("event_id").alias("index"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        (F.lit(CLIENT_BASE) + user).alias("client"), (F.lit(SERVER_BASE) + user % 7).alias("server"),
        (F.lit(40000) + user).cast("int").alias("client_port"), _pick(SERVER_PORTS, user).alias("server_port"),
        F.when(user % 5 == 3, 17).otherwise(6).alias("ip_proto"), _pick(FLAG_SETS, F.col("event_id")).alias("flags"),
        (F.floor("value").cast("long") + 54).alias("wire_len"), (F.col("event_id") % 3 == 0).alias("swap"),
    ))


def pkt_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare SYNs from ``events`` to many ports."""
    return pkt(spark, sf_dir).withColumns(
        {"tcp_flags": F.lit(2), "dst_port": (F.col("index") % 1000).cast("int"), "ip_proto": F.lit(6)}
    )


def pkt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many packets from ``lineitem``: suppliers send to parts."""
    li = table(spark, sf_dir, "lineitem")
    return _packets(li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("index"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("ts_ns"),
        (F.lit(CLIENT_BASE) + F.col("l_suppkey")).alias("client"),
        (F.lit(SERVER_BASE) + F.col("l_partkey") % 251).alias("server"),
        F.lit(50000).alias("client_port"),
        _pick(SERVER_PORTS, F.col("l_linenumber")).alias("server_port"),
        F.lit(6).alias("ip_proto"),
        F.lit(24).alias("flags"),
        (F.floor("l_quantity").cast("long") + 54).alias("wire_len"), F.lit(False).alias("swap"),
    ))


def url_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host names from ``pages``."""
    host = text.url_host(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("index"),
        "url",
        host.alias("host"),
        text.parent_domain(host).alias("parent"),
    )


def _sql_ip(n: str) -> str:
    return f"((({n}) >> 24) & 255) || '.' || ((({n}) >> 16) & 255) || '.' || ((({n}) >> 8) & 255) || '.' || (({n}) & 255)"


def _sql_pick(values: tuple, by: str) -> str:
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def _sql_packets(name: str, rows: str) -> str:
    return f"""{name}_rows AS ({rows}),
{name} AS (SELECT idx, ts_us, CASE WHEN swap THEN server ELSE client END AS src, CASE WHEN swap THEN client ELSE server END AS dst,
  CASE WHEN swap THEN server_port ELSE client_port END AS src_port, CASE WHEN swap THEN client_port ELSE server_port END AS dst_port,
  ip_proto, CASE WHEN ip_proto = 6 THEN flags END AS tcp_flags, wire_len, wire_len - 54 AS payload_len FROM {name}_rows)"""


PKT = _sql_packets("pkt", f"""SELECT event_id AS idx, epoch_us(ts) AS ts_us, {CLIENT_BASE} + user_id AS client, {SERVER_BASE} + user_id % 7 AS server,
  40000 + user_id AS client_port, {_sql_pick(SERVER_PORTS, 'user_id')} AS server_port, CASE WHEN user_id % 5 = 3 THEN 17 ELSE 6 END AS ip_proto,
  {_sql_pick(FLAG_SETS, 'event_id')} AS flags, CAST(floor(value) AS BIGINT) + 54 AS wire_len, event_id % 3 = 0 AS swap FROM events""")
PKT_SCAN = PKT + ",\npkt_scan AS (SELECT idx, ts_us, src, dst, src_port, idx % 1000 AS dst_port, 6 AS ip_proto, 2 AS tcp_flags, wire_len, payload_len FROM pkt)"
PKT_LINES = _sql_packets("pkt_lines", f"""SELECT l_orderkey * 10 + l_linenumber AS idx, epoch_us(l_shipdate) AS ts_us, {CLIENT_BASE} + l_suppkey AS client, {SERVER_BASE} + l_partkey % 251 AS server,
  50000 AS client_port, {_sql_pick(SERVER_PORTS, 'l_linenumber')} AS server_port, 6 AS ip_proto, 24 AS flags, CAST(floor(l_quantity) AS BIGINT) + 54 AS wire_len, false AS swap FROM lineitem""")
URL_NAMES = r"""hosts_of AS (SELECT page_id AS idx, url, lower(trim(string_split(regexp_replace(regexp_extract(regexp_replace(url, '^.*?://', ''), '^[^/?#]*'), '^.*@', ''), ':')[1])) AS host FROM pages),
url_names AS (SELECT *, regexp_extract(rtrim(host, '.'), '([^.]*\.)?[^.]*$') AS parent FROM hosts_of)"""
