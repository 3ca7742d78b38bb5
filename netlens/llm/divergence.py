"""Source divergence audit: how far the word use of each source is from that of the other sources of its language.

Each language keeps the terms of at least ``MIN_DOCUMENTS`` of its documents. A term's smoothed share in
a group is ``p = 1 + floor(SCALE * (count + 1) / (N + V))``, the divergence of p from q is
``f = floor((p - q)^2 / q)``. As p depends on the count alone, so does a pair of groups' f on the two
counts alone. For each pair of sources the kept terms are tallied by their (count, count)
combinations, and f is evaluated once for each combination and multiplied by its number of terms.

Only combinations of two positive counts are tallied. A term that one or both of the sources lack
lies in a zero cell, and those are implied: with a term's cells summed as if each source met
the others at zero (a histogram of each source's counts, not of pairs), each tallied
combination takes back what the sums hold too much for it (inclusion and exclusion). So work on terms
grows with the pairs of sources that share them, not with all pairs.

Tasks count terms in bounded tables before anything is shuffled, and tally combinations of a
block of terms before those are shuffled. A term's row holds its sources and counts, no documents. The
lists of a language's sources are joined by size, as Spark chooses. The leading terms of a group are
limited within each task before they meet.

Defined results: null text, lang and source are ''. Each row is a document, repeated ones too. A
group without terms takes part with counts of zero; where a language keeps no term, all values are 0.
Ties are ranked by the item's bytes. An empty table gives an empty result. Columns other than these
three are not looked at. All arithmetic is exact.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netlens.llm.columns import documents
from netlens.storage import materialize

MIN_DOCUMENTS = 3
SCALE = 1_000_000_000
TERM_RANKS = 200
#: Distinct terms of groups that a task holds while it counts.
HELD_TERMS = 250_000
#: Pairs of a block of terms that are tallied at once.
BLOCK_PAIRS = 1 << 21

#: Bytes of a term as they are, capital letters as small ones, all else a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and documents of bounded stretches of the documents; a term may have many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for text, lang, source in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                terms = text.as_py().translate(TERM_BYTES).split()
                if not terms:
                    continue
                counts, containing = groups.setdefault((lang, source), (Counter(), Counter()))
                before = len(counts)
                once = Counter(terms)
                counts.update(once)
                containing.update(once.keys())
                held += len(counts) - before
                if held >= HELD_TERMS:
                    yield from tables(groups)
                    groups, held = {}, 0
        yield from tables(groups)

    def tables(groups):
        for (lang, source), (counts, containing) in groups.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(counts), pa.string()),
                    pa.array([source] * len(counts), pa.string()),
                    pa.array(list(counts), pa.binary()).cast(pa.string()),
                    pa.array(list(counts.values()), pa.int64()),
                    pa.array([containing[t] for t in counts], pa.int64()),
                ],
                ["lang", "source", "term", "n", "documents"],
            )

    plain = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return plain.mapInArrow(run, "lang string, source string, term string, n long, documents long")


def kept_terms(docs: DataFrame, groups: DataFrame, min_documents: int) -> DataFrame:
    """lang, term, total and cells: the place of each source that has the term, with the count, by place."""
    by_source = (
        count_terms(docs)
        .repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    )
    placed = by_source.join(groups, ["lang", "source"])
    return (
        placed.groupBy("lang", "term")
        .agg(
            F.sum("documents").alias("documents"),
            F.sum("n").alias("total"),
            F.array_sort(F.collect_list(F.struct("place", "n"))).alias("cells"),
        )
        .where(F.col("documents") >= min_documents)
        .drop("documents")
    )


def source_places(docs: DataFrame) -> DataFrame:
    """lang, source and place: each occurring source of a language, numbered from 1."""
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    return named.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")))


def share(n: Column, total: Column, terms: Column) -> Column:
    """p; null where there are no terms at all."""
    wide = lambda c: c.cast("decimal(20,0)")
    scaled = wide(n + F.lit(1)) * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", scaled, F.nullif(wide(total + terms), F.lit(0)))


def divergence(p: Column, q: Column) -> Column:
    """f. Shares are below 2^30, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def language_table(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each language: terms (V), total, and by place: the sources' names, totals and p of count 0."""
    cells = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.place").alias("place")).agg(F.sum("c.n").alias("n"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("total"))
    filled = groups.join(cells, ["lang", "place"], "left").fillna(0, ["n"])
    lists = filled.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "source", "n"))).alias("s"))
    both = lists.join(terms, "lang", "left").fillna(0, ["terms", "total"])
    return both.select(
        "lang",
        "terms",
        "total",
        F.col("s.source").alias("sources"),
        F.col("s.n").alias("totals"),
        F.transform("s", lambda x: share(F.lit(0), x["n"], F.col("terms"))).alias("zeros"),
    )


def joint_counts(kept: DataFrame) -> DataFrame:
    """lang, a, b, na, nb, terms: for sources a < b, how many terms have these two positive counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            codes, names = langs.indices.to_numpy(), langs.dictionary
            cells = batch.column(1)
            sizes, places, counts = cells.value_lengths().to_numpy(), *(cells.flatten().field(k).to_numpy() for k in (0, 1))
            starts = np.cumsum(sizes) - sizes
            for k in np.unique(sizes[sizes > 1]):
                rows, (left, right) = np.flatnonzero(sizes == k), np.triu_indices(k, 1)
                step = max(1, BLOCK_PAIRS // len(left))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    grid = starts[some][:, None] + np.arange(k)
                    place, count = places[grid], counts[grid]
                    table = np.stack(
                        [
                            np.repeat(codes[some], len(left)).astype(np.int64),
                            place[:, left].ravel(),
                            place[:, right].ravel(),
                            count[:, left].ravel(),
                            count[:, right].ravel(),
                        ]
                    )
                    table = table[:, np.lexsort(table)]
                    first = np.concatenate([[True], (np.diff(table) != 0).any(axis=0)])
                    tally = np.diff(np.append(np.flatnonzero(first), table.shape[1]))
                    code, *columns = table[:, first]
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(code)), *(pa.array(c) for c in (*columns, tally))],
                        ["lang", "a", "b", "na", "nb", "terms"],
                    )

    schema = "lang string, a long, b long, na long, nb long, terms long"
    local = kept.select("lang", "cells").mapInArrow(run, schema)
    return local.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("terms").alias("n_terms"))


def pair_values(kept: DataFrame, languages: DataFrame) -> DataFrame:
    """lang, g, o (places) and value: the divergence of source g from source o over all kept terms."""
    at = lambda name, place: F.element_at(name, F.col(place).cast("int"))
    p = lambda n, place: share(F.col(n), at("totals", place), F.col("terms"))
    exact = lambda n, value: F.col(n).cast("decimal(18,0)") * value.cast("decimal(19,0)")

    def both_ways(rows: DataFrame, n: str, one: Column, other: Column) -> DataFrame:
        ways = F.array(
            F.struct(F.col("a").alias("g"), F.col("b").alias("o"), exact(n, one).alias("value")),
            F.struct(F.col("b").alias("g"), F.col("a").alias("o"), exact(n, other).alias("value")),
        )
        return rows.select("lang", F.inline(ways))

    joint = joint_counts(kept).join(languages, "lang").withColumns({"pa": p("na", "a"), "pb": p("nb", "b"), "za": at("zeros", "a"), "zb": at("zeros", "b")})
    f = lambda x, y: divergence(F.col(x), F.col(y))
    shared = both_ways(
        joint,
        "n_terms",
        f("pa", "pb") - f("pa", "zb") - f("za", "pb") + f("za", "zb"),
        f("pb", "pa") - f("pb", "za") - f("zb", "pa") + f("zb", "za"),
    )
    counts = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.place").alias("a"), F.col("c.n").alias("na")).agg(F.count("*").alias("n_terms"))
    alone = (
        counts.join(languages, "lang")
        .withColumns({"pa": p("na", "a"), "za": at("zeros", "a")})
        .select("lang", "a", "n_terms", "pa", "za", F.posexplode("zeros").alias("b", "zb"))
        .withColumn("b", F.col("b") + 1)
        .where("a <> b")
    )
    single = both_ways(alone, "n_terms", f("pa", "zb") - f("za", "zb"), f("zb", "pa") - f("zb", "za"))
    sources = languages.select("lang", "terms", "zeros", F.posexplode("zeros").alias("g", "zg"))
    empty = (
        sources.select("lang", "terms", "g", "zg", F.posexplode("zeros").alias("o", "zo"))
        .where("g <> o")
        .select("lang", (F.col("g") + 1).alias("g"), (F.col("o") + 1).alias("o"), F.coalesce(exact("terms", f("zg", "zo")), F.lit(0)).alias("value"))
    )
    every = empty.unionByName(single).unionByName(shared)
    return every.groupBy("lang", "g", "o").agg(F.sum("value").cast("long").alias("value"))


def term_values(kept: DataFrame, languages: DataFrame, ranks: int) -> DataFrame:
    """lang, g (place), item, value, rank: the leading terms of each source against its language."""
    cells = kept.join(languages.select("lang", "terms", F.col("total").alias("lang_total"), "totals"), "lang")
    each = cells.select("lang", "terms", "totals", "term", share(F.col("total"), F.col("lang_total"), F.col("terms")).alias("q"), F.inline("cells"))
    shares = each.withColumn("p", share(F.col("n"), F.element_at("totals", F.col("place").cast("int")), F.col("terms"))).where("p > q")
    valued = shares.select("lang", F.col("place").alias("g"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "g").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)


def audit(docs: DataFrame, *, min_documents: int = MIN_DOCUMENTS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank. ``docs`` has text, lang and source."""
    groups = materialize(source_places(docs), "sources")
    kept = materialize(kept_terms(docs, groups, min_documents), "kept-terms")
    languages = materialize(language_table(kept, groups), "languages")
    names = languages.select("lang", "sources")
    name_of = lambda place: F.element_at("sources", F.col(place).cast("int"))
    pairs = pair_values(kept, languages).join(names, "lang").select("lang", name_of("g").alias("source"), name_of("o").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = term_values(kept, languages, term_ranks).join(names, "lang")
    return (
        pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
        .unionByName(terms.select("lang", name_of("g").alias("source"), F.lit("term").alias("part"), "item", "value", "rank"))
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


ORACLE = rf"""WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
tokens AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM tokens GROUP BY ALL HAVING count(DISTINCT doc) >= {MIN_DOCUMENTS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
cells AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (t.n + s.v) AS HUGEINT) AS p
  FROM totals t JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c USING (lang, source, term)),
whole AS (SELECT k.lang, k.term, CAST(1 + {SCALE}::HUGEINT * (k.total + 1) // (s.n + s.v) AS HUGEINT) AS q FROM kept k JOIN sizes s USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, o.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source),
terms AS (SELECT c.lang, c.source, c.term AS item, CAST((c.p - w.q) * (c.p - w.q) // w.q AS BIGINT) AS value FROM cells c JOIN whole w USING (lang, term) WHERE c.n > 0 AND c.p > w.q),
both_parts AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' AS part FROM terms),
ranked AS (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TERM_RANKS}"""
