"""Indicator lists and feeds, and their cache."""

import json
import os
import time
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.functions import text
from netlens.operators import indicators

# The feeds (place, form, columns of value and tag from 0, a tag of all rows) and limits of fetching.
FEEDS = {
    "feodo": {"url": "https://feodotracker.abuse.ch/downloads/ipblocklist.txt", "form": "lines", "tag": "botnet-c2"},
    "sslbl": {"url": "https://sslbl.abuse.ch/blacklist/ja3_fingerprints.csv", "form": "csv", "value": 0, "tag_column": 3},
    "urlhaus": {"url": "https://urlhaus.abuse.ch/downloads/csv_recent/", "form": "url_csv", "value": 2, "tag_column": 5},
}
TIMEOUT_S, MOST_BYTES = 60, 128 * 1024 * 1024
MOST_WARNINGS = 100
MANIFEST = "manifest.json"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in order, of one file or several."""
    return spark.read.text(path, lineSep="\n").select(
        F.trim(F.regexp_replace("value", "\r$", "")).alias("line"),
        F.monotonically_increasing_id().alias("ord"),
    )


def _tokens_of_list(spark: SparkSession, path: str) -> DataFrame:
    token = F.trim(F.split_part("line", F.lit("#"), F.lit(1)))
    return _lines(spark, path).select(
        token.alias("token"),
        F.lit(path).alias("source"),
        F.lit(None).cast("string").alias("tag"),
        "ord",
    ).where(F.col("token") != "")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Indicators of a hand-written list: one on each line, with comments after ``#``."""
    return indicators.classify(_tokens_of_list(spark, path))


def list_warnings(spark: SparkSession, path: str) -> DataFrame:
    """The first entries that are no indicator."""
    tokens = _tokens_of_list(spark, path)
    return tokens.where(text.indicator_kind(F.col("token")).isNull()).orderBy("ord").limit(MOST_WARNINGS).select(
        "ord",
        F.concat(F.lit("not an indicator: "), "token").alias("warning"),
    )


def feed_tokens(spark: SparkSession, feed: str, path: str) -> DataFrame:
    """Tokens of a feed's file: plain lines, or a column of CSV, as it is or as the host of a URL."""
    how = FEEDS[feed]
    rows = _lines(spark, path).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    if how["form"] == "lines":
        return rows.select(F.col("line").alias("token"), F.lit(feed).alias("source"), F.lit(how["tag"]).alias("tag"), "ord")
    width = max(how["value"], how["tag_column"]) + 1
    parsed = rows.select(
        "ord",
        F.from_csv("line", F.lit(", ".join(f"c{k} string" for k in range(max(width, 9)))), {"escape": '"'}).alias("r"),
    )
    value, tag = F.trim(f"r.c{how['value']}"), F.trim(f"r.c{how['tag_column']}")
    token = text.url_host(value) if how["form"] == "url_csv" else value
    return parsed.select(
        token.alias("token"),
        F.lit(feed).alias("source"),
        F.when(tag != "", tag).alias("tag"),
        "ord",
    ).where(F.col("token") != "")


def read_feed(spark: SparkSession, feed: str, path: str) -> DataFrame:
    return indicators.classify(feed_tokens(spark, feed, path))


def fetch(url: str, key: str | None = None, opener=urllib.request.urlopen) -> bytes:
    """A feed's bytes over HTTPS, up to a limit."""
    if not url.startswith("https://"):
        raise ValueError("feeds are fetched over https only")
    request = urllib.request.Request(url, headers={"Auth-Key": key} if key else {})
    with opener(request, timeout=TIMEOUT_S) as answer:
        data = answer.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError("feed is larger than the limit")
    return data


def update_cache(
    spark: SparkSession,
    folder: str,
    feeds: list[str],
    key: str | None = None,
    opener=urllib.request.urlopen,
) -> dict[str, str]:
    """Fetch feeds into a folder. A feed that fails keeps its old copy; returns what failed."""
    os.makedirs(folder, exist_ok=True)
    entries = {e["id"]: e for e in manifest(folder)}
    failed = {}
    for feed in feeds:
        try:
            data = fetch(FEEDS[feed]["url"], key, opener)
        except (OSError, ValueError) as e:
            failed[feed] = str(e)
            continue
        path = os.path.join(folder, f"{feed}.data")
        with open(path + ".new", "wb") as f:
            f.write(data)
        os.replace(path + ".new", path)
        count = read_feed(spark, feed, path).select("kind", "value").distinct().count()
        entries[feed] = {
            "id": feed,
            "url": FEEDS[feed]["url"],
            "fetched_at": int(time.time()),
            "bytes": len(data),
            "indicators": count,
        }
    with open(os.path.join(folder, MANIFEST), "w") as f:
        json.dump({"feeds": [entries[k] for k in sorted(entries)]}, f, indent=1)
    return failed


def manifest(folder: str) -> list[dict]:
    path = os.path.join(folder, MANIFEST)
    if not os.path.exists(path):
        return []
    with open(path) as f:
        return json.load(f)["feeds"]


def load_cache(spark: SparkSession, folder: str) -> DataFrame | None:
    """Indicators of all cached feeds; unknown feeds and missing files are passed over."""
    sets = [
        read_feed(spark, e["id"], path)
        for e in manifest(folder)
        if e["id"] in FEEDS and os.path.exists(path := os.path.join(folder, f"{e['id']}.data"))
    ]
    return indicators.union(*sets) if sets else None
