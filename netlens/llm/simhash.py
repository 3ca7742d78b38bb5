"""Near-duplicate linking by SimHash, with candidates from pigeonring filtering.

A fingerprint is cut into five segments on a ring. If two fingerprints differ in at most four
bits, then some segment starts a chain whose cumulative differences stay within their
proportional budgets: none in one segment, at most 1 in two, 2 in three, 3 in four, 4 in all
(pigeonring principle, strong form). The join key is the first three links of such a chain, 38 or 39
bits: the first segment as it is, and the next two with the bits changed in which the two fingerprints
may differ there. The changes are split over both sides of the join: one side changes no bit, one of the
second segment or one of the third, the other side no bit or one of the third, which makes up each
difference within the budgets in exactly one way. A pair counts at the first start whose whole chain
keeps its budgets and at that way alone, so it comes out once without a shuffle; the full
Hamming distance is checked last. With keys of 38 bits chance meetings stay below one for each
fingerprint up to some 10^8 of them.

Work is on distinct fingerprints: copies, however many, never meet in a join. Near copies are
few fingerprints, as only bits near a tie change. Components come from the links by rounds of
contraction.

Defined results: a text with no words, or a null text, has fingerprint zero and is linked like
any other. With one to three words the whole sequence is the only shingle. Rows with equal ids
give a row each. An empty table gives an empty result. Columns other than the id and the text
are not looked at. A null id is passed on; it never names a component unless the component has
no other id.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm.columns import documents, unused_name
from netlens.llm.components import connected_components
from netlens.storage import materialize

SHINGLE = 4
SEED = 42
DISTANCE = 4
SEGMENTS = 5
#: (first bit, width) of each segment, from the low end.
RING = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Shingles that are expanded to bits at once.
BLOCK = 1 << 15


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of a text's 4-word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], words[3:], strict=False))
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8", count=max(1, len(words) - SHINGLE + 1))
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), BLOCK):
        block = hashes[start : start + BLOCK]
        ones += np.unpackbits(block.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and ``fp``, the fingerprint as a signed long."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(made, "<u8").view("<i8"), pa.int64())],
                ["doc_id", "fp"],
            )

    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, schema)


def segment(fp: Column, k: int) -> Column:
    first, width = RING[k % SEGMENTS]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


#: Bits of a packed key below the key itself: the changed bit of the third link, from 1, or 0.
FLIP_BITS = 4


def ring_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints ``fp`` at distance 4 or less, each once."""
    one_side, other_side = [], []
    long = lambda n: F.lit(n).cast("long")
    for k in range(SEGMENTS):
        second, third = ([1 << b for b in range(RING[(k + j) % SEGMENTS][1])] for j in (1, 2))
        links = [segment(F.col("fp"), k + j) for j in range(3)]
        place = [1 << (FLIP_BITS + 13 * (2 - j)) for j in range(3)]
        plain = sum((x * long(p) for x, p in zip(links, place, strict=True)), long(k << (FLIP_BITS + 39)))
        # A bit of a link is the same bit of the packed key, moved to the link's place.
        changed = [plain.bitwiseXOR(long(b * place[2])) + long(n) for n, b in enumerate(third, 1)]
        one_side += [plain, *(plain.bitwiseXOR(long(b * place[1])) for b in second), *changed]
        other_side += [plain, *changed]

    def keyed(name: str, flip: str, packed: list[Column]) -> DataFrame:
        exploded = nodes.select(F.col("fp").alias(name), F.explode(F.array(*packed)).alias("packed"))
        return exploded.select(
            name,
            F.shiftright("packed", FLIP_BITS).alias("key"),
            F.col("packed").bitwiseAND(long((1 << FLIP_BITS) - 1)).cast("byte").alias(flip),
        )

    differ = F.col("a").bitwiseXOR(F.col("b"))
    counts = [F.bit_count(segment(differ, k)) for k in range(SEGMENTS)]

    def keeps(k: int) -> Column:
        upto = lambda n: sum((counts[(k + j) % SEGMENTS] for j in range(1, n)), counts[k])
        return (upto(1) == 0) & (upto(2) <= 1) & (upto(3) <= 2) & (upto(4) <= 3)

    first = F.coalesce(*(F.when(keeps(k), k) for k in range(SEGMENTS)))
    once = (F.col("flip_a") == 0) | (F.col("flip_b") > F.col("flip_a"))
    within = (F.col("a") < F.col("b")) & once & (F.bit_count(differ) <= DISTANCE) & (F.shiftright("key", 39) == first)
    joined = keyed("a", "flip_a", one_side).join(keyed("b", "flip_b", other_side).hint("merge"), "key")
    return joined.where(within).select("a", "b")


def link(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``,
    the smallest id that links reach."""
    prints = materialize(fingerprints(docs, id_column, text_column), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-nodes")
    roots = connected_components(ring_links(nodes)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = rooted.join(names, "root").select("fp", "component_id")
    return prints.join(by_print, "fp", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each component: that of the smallest id, the first row among equal ids."""
    row = unused_name(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    key = unused_name(docs, "key")
    linked = link(numbered.withColumn(key, F.struct("doc_id", row)), key)
    others = linked.where(F.col("doc_id") != F.col("component_id")).select(F.col(f"doc_id.{row}").alias(row))
    return numbered.join(others, row, "left_anti").select(*docs.columns)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir))
