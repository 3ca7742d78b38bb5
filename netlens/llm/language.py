"""Language identification with n-gram filters that share one bit-sliced Bloom filter.

Each slot of the filter holds one bit for each language, in as many words of 64 bits as the languages
need. An n-gram's slots are read once for each word and combined with AND: what is left are all
languages whose filter contains the n-gram. A text's score for a language is the share of its n-grams
that the language's filter contains, with the expected false positives (from that filter's fill) taken
out; the largest decides.

The filters learn from a sample of labelled texts whose size is a parameter, ``PER_LANGUAGE``
different texts of each language, about, the first by a hash of the text; copies of a text count once,
so no group of copies makes the sample larger. Every label that a text has is learned, be it of one
text. Sampled texts are cut into pieces of ``PIECE`` letters, and an n-gram counts once for each piece it is
in, so neither the number of a label's texts nor their length matters, only how much there is to learn from.
A filter holds the n-grams whose count is at least a ``LEAST_RATE`` of all that the label's pieces hold, by
``ERRORS`` standard errors of that expected count: what a small sample holds by chance is not taken for
frequent, so labels of little text hit less and never take the texts of others. A filter has at most
1 / ``LEAST_RATE`` n-grams, which bounds what the driver sees. Counting n-grams runs on Spark.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text
if nothing was learned. Ties go to the language that comes first by code point. Repeated rows
are judged each by itself; labels that are null are not learned from, and a language whose texts
have no letter has an empty filter. An empty table gives an empty result.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm.columns import documents
from netlens.storage import materialize, release

#: Labelled texts that the filters learn from, for each language; the bound of the training sample.
PER_LANGUAGE = 4000
#: Letters of one piece.
PIECE = 500
#: N-grams that are a smaller part of all in a label's pieces are left out of its filter, and standard errors of that bar.
LEAST_RATE = 1e-5
ERRORS = 3.0
SIZES = (2, 3, 4)
HASHES = 3
#: Slots for each n-gram of the language that has most, at least; and the fewest slots.
SLOTS_PER_GRAM = 16
LEAST_SLOTS = 1 << 12
#: Entries of one counting table; a fuller one is passed on.
COUNTED_AT_ONCE = 1_000_000
#: Languages of one word of a slot.
WORD_BITS = 64
#: Characters that are hashed at once.
BLOCK = 1 << 20
UNKNOWN = "und"

_tables: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or a blank if it is no letter."""
    if not _tables:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x20000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        table[0x20000:0x40000] = np.arange(0x20000, 0x40000)
        _tables.append(table)
    return _tables[0]


def letters(text: str) -> np.ndarray:
    """A text as lower-case letters, with one blank for each run of others and at both ends."""
    points = letter_table()[np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)]
    blank = points == 32
    keep = ~blank
    keep[0] = True
    keep[1:] |= ~blank[:-1]
    return points[keep]


def grams(points: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams of ``letters()``; those that are blank alone or span a blank inside are left out."""
    out = []
    blank = points == 32
    mixed = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in SIZES:
        m = len(points) - n + 1
        if m < 1:
            continue
        h = np.full(m, n, np.uint64)
        inside = np.zeros(m, bool)
        for i in range(n):
            h = (h ^ mixed[i : i + m]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
            if 0 < i < n - 1:
                inside |= blank[i : i + m]
        out.append(h[~inside])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def pieces(points: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of each piece, the last letters of one carried into the next so that none is lost."""
    for start in range(0, len(points), PIECE):
        yield grams(points[start : start + PIECE + max(SIZES) - 1])


def slots(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """The slots of each hash among ``size`` (a power of two), one array for each of the filter's hash functions."""
    step = (hashes >> np.uint64(40)) | np.uint64(1)
    return [((hashes + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.intp) for k in range(HASHES)]


class Filters:
    """One bit-sliced Bloom filter over all languages."""

    def __init__(self, by_language: dict[str, np.ndarray]):
        self.languages = sorted(by_language)
        most = max(map(len, by_language.values()), default=0)
        self.size = max(LEAST_SLOTS, 1 << (SLOTS_PER_GRAM * most).bit_length())
        self.bits = np.zeros((-(-len(self.languages) // WORD_BITS), self.size), np.uint64)
        fill = []
        for k, language in enumerate(self.languages):
            word, bit = self.bits[k // WORD_BITS], np.uint64(1 << k % WORD_BITS)
            for at in slots(by_language[language], self.size):
                word[at] |= bit
            fill.append(np.count_nonzero(word & bit) / len(word))
        self.false_positive = np.array([f**HASHES for f in fill])

    def containing(self, hashes: np.ndarray, word: int = 0) -> np.ndarray:
        """For each n-gram the bits of all languages of a word that contain it."""
        return self._meet(slots(hashes, self.size), word)

    def _meet(self, at: list[np.ndarray], word: int) -> np.ndarray:
        out = self.bits[word][at[0]]
        for more in at[1:]:
            out &= self.bits[word][more]
        return out

    def shares(self, text: str) -> np.ndarray | None:
        """Corrected share of the text's n-grams in each language; None without letters."""
        points = letters(text)
        if len(points) <= 1:
            return None
        hits, total = np.zeros(len(self.languages)), 0
        for start in range(0, len(points), BLOCK):
            hashes = grams(points[start : start + BLOCK + max(SIZES) - 1])
            at = slots(hashes, self.size)
            total += len(hashes)
            for word in range(len(self.bits)):
                found, first = self._meet(at, word), word * WORD_BITS
                count = min(WORD_BITS, len(self.languages) - first)
                hits[first : first + count] += [np.count_nonzero(found & np.uint64(1 << k)) for k in range(count)]
        return np.clip((hits / max(total, 1) - self.false_positive) / (1 - self.false_positive), 0, 1)

    def decide(self, text: str | None) -> tuple[str, float]:
        """The language and the share of its n-grams; see the module for texts without letters."""
        found = self.shares(text) if text and self.languages else None
        if found is None:
            return UNKNOWN, 0.0
        k = int(np.argmax(found))
        return self.languages[k], float(found[k])


def learn(labelled: DataFrame, text_column: str = "text", label_column: str = "lang") -> Filters:
    """Filters from a bounded sample of labelled texts."""
    rows = labelled.where(F.col(label_column).isNotNull() & F.col(text_column).isNotNull())
    rows = rows.select(
        F.col(label_column).alias("label"),
        F.col(text_column).alias("text"),
        F.xxhash64(text_column).alias("order"),
    )
    sample = _first_by_order(rows)

    def made(label: str, counts: Counter) -> pa.RecordBatch:
        values = np.fromiter(counts, np.uint64, len(counts)).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([label] * len(counts), pa.string()),
                pa.array(values, pa.int64()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            ["label", "gram", "times"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        totals: Counter = Counter()
        held = 0
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[label] += 0
                for hashes in pieces(letters(text)):
                    totals[label] += len(hashes)
                    own = counts.setdefault(label, Counter())
                    held -= len(own)
                    own.update(np.unique(hashes).tolist())
                    held += len(own)
                    if held >= COUNTED_AT_ONCE:
                        yield from (made(*x) for x in counts.items())
                        counts, held = {}, 0
        yield from (made(*x) for x in counts.items())
        # The null n-gram counts all n-grams.
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())],
            ["label", "gram", "times"],
        )

    schema = T.StructType(
        [T.StructField("label", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("times", T.LongType())]
    )
    counted = materialize(
        sample.select("label", "text").mapInArrow(count, schema).groupBy("label", "gram").agg(F.sum("times").alias("times")),
        "language-grams",
    )
    totals = counted.where(F.col("gram").isNull()).select(F.col("label").alias("of"), (F.col("times") * LEAST_RATE).alias("bar"))
    # One row for each language; a null n-gram makes an empty filter.
    kept = counted.join(totals.hint("broadcast"), F.col("label") == F.col("of")).where(
        F.col("gram").isNull()
        | (F.col("times") >= F.col("bar") + ERRORS * F.sqrt("bar"))
    )
    table = kept.select("label", "gram").orderBy("label", "gram").toArrow()
    release(counted)
    labels, held = table.column(0).combine_chunks().dictionary_encode(), table.column(1)
    valid = held.is_valid().to_numpy(zero_copy_only=False)
    codes, values = np.asarray(labels.indices)[valid], held.drop_null().to_numpy().view(np.uint64)
    return Filters({name: values[codes == k] for k, name in enumerate(labels.dictionary.to_pylist())})


def _first_by_order(rows: DataFrame) -> DataFrame:
    """At most about PER_LANGUAGE texts of each label, those of the smallest hashes, once each.

    The cut is a share of the hash range, from each label's count of different hashes, so no window
    gathers a label's rows. Copies of a text share its hash; they are merged before each shuffle.
    Labels of no more texts have no cut and keep all, so the broadcast table is short.
    """
    counts = rows.select("label", "order").distinct().groupBy("label").count().where(F.col("count") > PER_LANGUAGE)
    cuts = counts.select(
        F.col("label").alias("cut_label"),
        (F.lit(float(PER_LANGUAGE)) / F.col("count") * float(1 << 62) * 2).alias("cut"),
    )
    kept = F.col("cut").isNull() | (F.abs(F.col("order").cast("double")) <= F.col("cut"))
    return rows.join(
        F.broadcast(cuts),
        F.col("label") == F.col("cut_label"),
        "left",
    ).where(kept).groupBy("label", "order").agg(F.min("text").alias("text")).select("label", "text")


def identify(docs: DataFrame, filters: Filters, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of each document, from its text alone."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_column].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.decide(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, schema)


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: Texts whose best language has a smaller share of their n-grams are in no known language.
LEAST_SHARE = 0.3


def keep_known(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents whose text is in a known language."""
    filters = learn(docs.where(~held_out()), text_column)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.decide(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([language != UNKNOWN and share >= LEAST_SHARE for language, share in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, learn(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
