"""Secret scans with linking of multipart credentials.

Keyword assignments, access identifiers and long hexadecimal runs are reported as they are.
Weaker candidates are reported only in company: parts of a text are joined as intervals, and a
candidate counts when its complements lie within ``SCOPE`` code points of it. A bare 40-character
token (``weak_secret``) needs an access identifier; a named account (``weak_id``) needs a secret
and an endpoint; an endpoint needs an identifier and a secret.

Patterns are row-local expressions: texts are not shuffled. Only the parts found go to the join,
which is by row and scope-sized bin of a part's two ends, so a bin holds no more parts than fit in its
characters, besides the few that only end or start there, and a part of any length is met.

Positions are code points, ends exclusive. Defined results: a null text counts as empty; a text
without findings has zero counts, the digest of the empty string and empty spans. Rows are
numbered when written, so repeated rows and ids are scanned each by itself. An empty table gives
an empty result. Other columns are not looked at.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm.columns import documents, let, scanned, unused_name
from netlens.storage import materialize

SCOPE = 300

# The kinds in order of report, and their patterns.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
WEAK_SECRET = "(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
WEAK_ID = r"\b(?:client|account|user|access|tenant)[_-]?(?:id|name)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}"
ENDPOINT = r"\b(?:https?|s3|postgres|postgresql|mysql|mongodb|redis|amqp|ssh)://[A-Za-z0-9_.:@/-]+"

EMPTY = "array<struct<start:bigint,rank:int,end:bigint>>"


def spans(text: Column, pattern: str, kind: str, passes=lambda match: F.lit(True)) -> Column:
    """Leftmost non-overlapping matches of a pattern that ``passes`` lets through, as (start, rank, end)."""
    rank = F.lit(KINDS.index(kind))

    def found(pieces: Column) -> Column:
        def placed(matches: Column) -> Column:
            steps = F.transform(matches, lambda m, i: (F.length(F.get(pieces, i)) + F.length(m)).cast("long"))
            ends = let(steps, lambda lengths: scanned(lengths, lambda a, b: a + b))

            def span(match: Column, end: Column) -> Column:
                return F.when(
                    passes(match),
                    F.struct((end - F.length(match)).alias("start"), rank.alias("rank"), end.alias("end")),
                )

            return let(ends, lambda e: F.array_compact(F.transform(matches, lambda m, i: span(m, F.get(e, i)))))

        return F.when(F.size(pieces) == 1, F.array().cast(EMPTY)).otherwise(
            let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
        )

    return let(F.split(text, pattern, -1), found)


def parts(docs: DataFrame, text: Column, *kept: str) -> DataFrame:
    """For each row the base spans ``base`` and the parts that need company, ``weak``."""
    least = lambda n: lambda m: F.length(m) >= n
    named = docs.select(
        *kept,
        text.alias("_text"),
        spans(text, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_ASSIGN).alias("_assign"),
        F.when(
            F.contains(text, F.lit("AKIA")),
            spans(text, ACCESS, "access", least(LEAST_ACCESS)),
        ).otherwise(F.array().cast(EMPTY)).alias("_access"),
        spans(text, f"[0-9a-f]{{{LEAST_HEX},}}", "hex").alias("_hex"),
        spans(text, WEAK_ID, "weak_id").alias("_id"),
        F.when(
            F.contains(text, F.lit("://")),
            spans(text, ENDPOINT, "endpoint"),
        ).otherwise(F.array().cast(EMPTY)).alias("_endpoint"),
    )
    mixed = lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
    secret = F.when(
        (F.size("_access") > 0) | (F.size("_id") > 0),
        spans(F.col("_text"), WEAK_SECRET, "weak_secret", mixed),
    ).otherwise(F.array().cast(EMPTY))
    return named.select(
        *kept,
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sort_array(F.concat("_assign", "_access", "_hex")).alias("base"),
        F.concat("_id", secret, "_endpoint").alias("weak"),
    )


def linked(found: DataFrame, row: str) -> DataFrame:
    """``row`` and ``extra``: the weak parts that have their complements within the scope."""
    kind = {k: i for i, k in enumerate(KINDS)}
    needing = found.where(F.size("weak") > 0)
    part = needing.select(row, F.explode(F.concat("base", "weak")).alias("p")).select(
        row,
        F.col("p.start").alias("start"),
        F.col("p.rank").alias("rank"),
        F.col("p.end").alias("end"),
    )
    # Parts don't overlap their company, so one of its ends lies in the scope, before or after: a part stands in the
    # bins of its two ends, and the other side looks into the bins of the scope before its start and after its end.
    bins = lambda a, b: F.sequence(F.floor(a / SCOPE), F.floor(b / SCOPE))
    around = F.array_union(bins(F.col("start") - SCOPE, F.col("start")), bins(F.col("end"), F.col("end") + SCOPE))
    looking = part.where(F.col("rank") >= kind["weak_id"]).withColumn("bin", F.explode(around))
    ends = F.array_distinct(F.array(F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE)))
    there = part.select(
        F.col(row).alias("_row"),
        F.col("start").alias("s2"),
        F.col("rank").alias("r2"),
        F.col("end").alias("e2"),
        F.explode(ends).alias("bin2"),
    )
    near = (F.col(row) == F.col("_row")) & (F.col("bin") == F.col("bin2")) & (F.col("s2") <= F.col("end") + SCOPE) & (
        F.col("e2") >= F.col("start") - SCOPE
    ) & (
        (F.col("e2") <= F.col("start"))
        | (F.col("s2") >= F.col("end"))
    )
    joined = looking.join(there.hint("merge"), near)
    is_id = F.col("r2").isin(kind["access"], kind["weak_id"])
    is_secret = F.col("r2").isin(kind["assign"], kind["hex"], kind["weak_secret"])
    company = joined.groupBy(row, "start", "rank", "end").agg(
        F.max(is_id).alias("id"),
        F.max(is_secret).alias("secret"),
        F.max(F.col("r2") == kind["endpoint"]).alias("endpoint"),
    )
    complete = F.when(F.col("rank") == kind["weak_secret"], F.col("id")).when(
        F.col("rank") == kind["weak_id"],
        F.col("secret") & F.col("endpoint"),
    ).otherwise(F.col("id") & F.col("secret"))
    return company.where(complete).groupBy(row).agg(F.collect_list(F.struct("start", "rank", "end")).alias("extra"))


def written(all_spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            all_spans,
            lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts and spans of each document; ``all`` holds the spans as structs."""
    slim = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    found = materialize(parts(slim, F.col("text"), "row", "doc_id"), "secret-parts")
    both = found.join(linked(found, "row"), "row", "left")
    every = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "extra")))
    return both.select(
        "doc_id",
        *(f"n_{k}" for k in KINDS[:3]),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(every).alias("spans"),
        every.alias("all"),
    )


MASK = "[secret]"
#: Code points of a chunk; a cut of the text looks at no more than its two outer chunks besides what it takes.
CHUNK = 512


def between(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a text that is given in chunks."""
    first, last = (F.floor(x / CHUNK).cast("int") for x in (start, end))
    at, until = ((x % CHUNK).cast("int") for x in (start, end))
    middle = F.when(last - first > 1, F.array_join(F.slice(chunks, first + 2, last - first - 1), "")).otherwise("")
    outer = F.concat(
        F.substring(F.get(chunks, first), at + 1, F.lit(CHUNK)),
        middle,
        F.coalesce(F.substring(F.get(chunks, last), F.lit(1), until), F.lit("")),
    )
    return F.when(start >= end, "").when(first == last, F.substring(F.get(chunks, first), at + 1, until - at)).otherwise(outer)


def masked(text: Column, found: Column) -> Column:
    """The text with each run of overlapping spans (sorted by start) replaced by MASK."""

    def cut(chunks: Column, reach: Column) -> Column:
        """``reach``: the largest end of the spans up to each."""

        def gap(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(reach, i - 1), F.lit(0).cast("long"))
            return F.when(
                (i == 0) | (s["start"] >= before),
                F.concat(between(chunks, before, s["start"]), F.lit(MASK)),
            ).otherwise("")

        size = (F.size(chunks) - 1) * CHUNK + F.length(F.element_at(chunks, -1))
        return F.concat(F.array_join(F.transform(found, gap), ""), between(chunks, F.element_at(reach, -1), size.cast("long")))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    ends = F.transform(found, lambda s: s["end"])
    reach = let(ends, lambda e: scanned(e, lambda a, b: F.greatest(a, b)))
    return F.when(F.size(found) == 0, text).otherwise(let(chunks, lambda c: let(reach, lambda r: cut(c, r))))


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents with their secrets masked; endpoints stay. Rows without weak parts never leave their task."""
    own = [unused_name(docs, n) for n in ("row", "record")]
    row, record = own
    text = F.col(f"{record}.{text_column}")
    slim = docs.select(F.monotonically_increasing_id().alias(row), F.struct(*docs.columns).alias(record))
    found = materialize(parts(slim, F.coalesce(text, F.lit("")), row, record), "secret-documents")
    weak = found.where(F.size("weak") > 0)
    extra = linked(found.select(row, "base", "weak"), row).withColumn(
        "extra",
        F.filter("extra", lambda s: s["rank"] != KINDS.index("endpoint")),
    )
    joined = weak.join(extra, row, "left").select(
        record,
        F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "extra"))).alias("base"),
    )
    both = found.where(F.size("weak") == 0).select(record, "base").unionByName(joined)
    clean = masked(text, F.col("base"))
    fields = {text_column: clean} | (
        {
            "n_chars": F.when(
                F.size("base") == 0,
                F.col(f"{record}.n_chars"),
            ).otherwise(F.length(clean)).cast(docs.schema["n_chars"].dataType)
        } if "n_chars" in docs.columns else {}
    )
    return both.select(*(fields.get(c, F.col(f"{record}.`{c}`")).alias(c) for c in docs.columns))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("all")
