"""Language-model scores of whole documents.

Counts of all words in the training documents are gathered on Spark. The ``FREQUENT`` most
frequent words go to the tasks as a dictionary, a bound that doesn't grow with the data; the
counts of rarer words are joined by word, which no hot word can skew.

The model is a gated recurrent network (see ``gru``) that sees every word: the most frequent are symbols
of their own, all others share ``RESTS`` symbols by their last letters, which tell much of a word's
language and form. P(word) of those is P(symbol) times the word's smoothed share of the symbol's tokens,
so probabilities of all words and of one unknown word for each symbol add up to 1. Training passes
once over all training documents, in rounds over growing shares of them: in a round each task
trains a copy on its own documents, and the mean of the copies, weighted by tokens and summed on
Spark, starts the next round. The driver holds one copy of the weights.

Defined results: a null or empty text is one token, the end. A null id belongs to the training
part. With no training document all counts are 0 and so is every base score. Repeated rows are
scored each by itself. An empty table gives an empty result. Other columns are not looked at.
"""

import math
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm import gru
from netlens.llm.columns import documents
from netlens.storage import materialize

#: The end's entry among the words; no word holds white space.
END = "\n"
FREQUENT = 1 << 16
#: Longer words are never in the dictionary, which bounds its bytes.
LONGEST = 64
#: Symbols of the words that have none of their own, and the bytes at a word's end that choose among them.
RESTS, ENDING = gru.CLASS, 3
#: Bytes of text that are split at once and scored in lanes together, but for a longer text, which stands alone.
GROUP_BYTES = 24 << 20
#: Tokens that are laid out in lanes at once for training, and lanes.
TRAIN_TOKENS = 4_000_000
SCORE_LANES, TRAIN_LANES = 384, 192
#: (share of the training documents, learning rate) of each round; together they are all.
ROUNDS = ((1 / 16, 0.01), (3 / 16, 0.006), (12 / 16, 0.003))


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 7 == 2, F.lit(False))


class Tokens(NamedTuple):
    """Words of several texts: places in ``words``, which are distinct, one text after the other, and how many each text has."""

    codes: np.ndarray
    lengths: np.ndarray
    words: pa.Array


def tokenized(texts: pa.Array) -> Tokens:
    """Split, lower-cased and numbered by Arrow for all texts at once; a null text has no words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = lists.flatten().dictionary_encode()
    codes, words = found.indices.to_numpy(zero_copy_only=False), found.dictionary
    # White space at a text's ends, or nothing else, leaves empty words.
    nothing = pc.index(words, pa.scalar("", words.type)).as_py()
    if nothing >= 0:
        some = codes != nothing
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[some], minlength=len(lengths))
        codes = codes[some]
    return Tokens(codes, lengths, words)


def groups(batch: pa.RecordBatch, text_column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in stretches of about ``GROUP_BYTES`` of text."""
    ends = np.cumsum(pc.binary_length(batch.column(text_column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def count_words(texts: DataFrame) -> DataFrame:
    """``word`` and ``c``, with the end once for each text. ``texts`` has one column."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("c", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch, 0):
                found = tokenized(part.column(0))
                counts = np.bincount(found.codes, minlength=len(found.words))
                some = np.flatnonzero(counts)
                words = pa.concat_arrays([found.words.take(pa.array(some)), pa.array([END], found.words.type)])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.append(counts[some], len(part)), pa.int64())], ["word", "c"])

    return texts.mapInArrow(run, schema).groupBy("word").agg(F.sum("c").alias("c"))


def counted_words(found: Tokens, outside: np.ndarray) -> pa.MapArray:
    """For each text a map of its words that are ``outside`` (by place in the dictionary) to their counts there."""
    tokens = np.flatnonzero(outside[found.codes])
    text = np.searchsorted(np.cumsum(found.lengths), tokens, "right")
    pairs, counts = np.unique(text * len(outside) + found.codes[tokens], return_counts=True)
    offsets = np.searchsorted(pairs, np.arange(len(found.lengths) + 1) * len(outside))
    words = found.words.take(pa.array(pairs % max(1, len(outside))))
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), words, pa.array(counts, pa.int64()))


def rest_symbol(word: bytes) -> int:
    return crc32(word[-ENDING:]) % RESTS


def rest_symbol_column(word: Column) -> Column:
    return (F.crc32(F.substring(word.cast("binary"), -ENDING, ENDING)) % RESTS).cast("int")


class Vocabulary:
    """Frequent words by falling count, the end first, and totals over all words.

    ``rests``: tokens and distinct words of each rest symbol, if all words were among them.
    """

    def __init__(self, rows: list[tuple[str, int]], rests: dict[int, tuple[int, int]]):
        counts = dict(rows)
        ordered = [(END, counts.pop(END, 0)), *sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        self.words = pa.array([w for w, _ in ordered], pa.string())
        self.counts = np.array([c for _, c in ordered], np.int64)
        self.log_counts = np.log10(self.counts + 1)
        self.tokens, self.distinct = (sum(x[k] for x in rests.values()) for k in (0, 1))
        own = gru.OUTPUTS - RESTS
        symbol = np.fromiter((rest_symbol(w.encode()) for w, _ in ordered), np.int64, len(ordered))
        tokens, distinct = np.zeros(RESTS, np.int64), np.zeros(RESTS, np.int64)
        for k, (n, v) in rests.items():
            tokens[k], distinct[k] = n, v
        np.subtract.at(tokens, symbol[:own], self.counts[:own])
        np.subtract.at(distinct, symbol[:own], self.counts[:own] > 0)
        #: The denominator of a word's share of its rest symbol: its words' counts plus one each, and one unknown word.
        self.log_rest_sizes = np.log10(tokens + distinct + 1)
        self.id_of_place = np.where(np.arange(len(symbol)) < own, np.arange(len(symbol)), own + symbol).astype(np.int16)
        self.id_counts = np.zeros(gru.OUTPUTS)
        self.id_counts[: min(own, len(symbol))] = self.counts[:own]
        self.id_counts[own:] = tokens + 1

    def places(self, words: pa.Array) -> np.ndarray:
        """Each word's place, -1 for words outside."""
        return pc.index_in(words, self.words.cast(words.type)).fill_null(-1).to_numpy(zero_copy_only=False)

    def ids(self, words: pa.Array, places: np.ndarray) -> np.ndarray:
        """Each word's symbol."""
        out = self.id_of_place[places]
        outside = np.flatnonzero(places < 0)
        # Many words share an ending.
        endings = pc.binary_slice(words.take(pa.array(outside)).cast(pa.binary()), -ENDING).dictionary_encode()
        symbols = np.array([gru.OUTPUTS - RESTS + rest_symbol(e) for e in endings.dictionary.to_pylist()], out.dtype)
        out[outside] = symbols[endings.indices.to_numpy(zero_copy_only=False)]
        return out


def with_ends(values: np.ndarray, found: Tokens, end: float) -> np.ndarray:
    """The value of each token of all texts, from those of distinct words, with the end's after each text."""
    return np.insert(values[found.codes], np.cumsum(found.lengths), end)


def train(docs: DataFrame, vocabulary, start: np.ndarray, salt: str = "lm") -> np.ndarray:
    """Weights after one pass over ``docs`` (row key, text) in rounds."""
    schema = T.StructType([T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("tokens", T.LongType())])
    context = docs.sparkSession.sparkContext
    vector, low = start, 0.0
    place = F.pmod(F.xxhash64(F.lit(salt), "text", "key"), F.lit(1 << 20)) / (1 << 20)
    for share, rate in ROUNDS:
        sent = context.broadcast(vector)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:
            own, adam, total = sent.value.copy(), gru.Adam(rate), 0
            held: list[np.ndarray] = []
            tokens = 0

            def flush() -> None:
                gru.train(own, held, max(8, min(TRAIN_LANES, tokens // (gru.WINDOW * 50))), adam)

            for batch in batches:
                for part in groups(batch, 0):
                    found = tokenized(part.column(0))
                    symbols = vocabulary.value.ids(found.words, vocabulary.value.places(found.words))
                    ids = with_ends(symbols, found, vocabulary.value.id_of_place[0])
                    for one in np.split(ids, np.cumsum(found.lengths + 1)[:-1]):
                        held.append(one)
                        tokens += len(one)
                        if tokens >= TRAIN_TOKENS:
                            flush()
                            total, held, tokens = total + tokens, [], 0
            if held:
                flush()
                total += tokens
            if total:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own.astype(np.float64) * total], pa.list_(pa.float64())), pa.array([total], pa.int64())],
                    ["weights", "tokens"],
                )

        part = docs.where((place >= low) & (place < low + share)).select("text").mapInArrow(run, schema)
        sums = part.select(
            F.posexplode("weights").alias("at", "w"),
            "tokens",
        ).groupBy("at").agg((F.sum("w") / F.sum("tokens")).alias("w"))
        found = sums.collect()
        if found:
            vector = np.zeros(gru.LENGTH, np.float32)
            for r in found:
                vector[r.at] = r.w
        low += share
    return vector


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10)."""
    spark = docs.sparkSession
    slim = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).alias("doc_id"),
        held_out(id_column).alias("held_out"),
        F.col(text_column).alias("text"),
    )
    training = slim.where(~F.col("held_out"))
    counts = materialize(count_words(training.select("text")), "word-counts")
    rests = {
        r.symbol: (r.n, r.v)
        for r in counts.groupBy(
            rest_symbol_column(F.col("word")).alias("symbol")
        ).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    }
    short = (F.length("word") <= LONGEST) & (F.col("word") != END)
    frequent = counts.where(short).orderBy(F.desc("c"), "word").limit(FREQUENT).union(counts.where(F.col("word") == END))
    vocabulary = Vocabulary([(r.word, r.c) for r in frequent.collect()], rests)
    shared = spark.sparkContext.broadcast(vocabulary)
    weights = train(training.select(F.col("doc_id").alias("key"), "text"), shared, gru.start_vector(vocabulary.id_counts))
    sent = spark.sparkContext.broadcast(weights)

    schema = T.StructType([
        T.StructField("row", T.LongType()),
        docs.schema[id_column] if id_column == "doc_id" else T.StructField("doc_id", docs.schema[id_column].dataType),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_frequent", T.LongType()),
        T.StructField("rest_sizes", T.DoubleType()),
        T.StructField("network", T.DoubleType()),
        T.StructField("log_frequent", T.DoubleType()),
        T.StructField("log_rest", T.DoubleType()),
        T.StructField("rare", T.MapType(T.StringType(), T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        first_rest = gru.OUTPUTS - RESTS
        for batch in batches:
            for part in groups(batch, 3):
                found = tokenized(part.column(3))
                places = voc.places(found.words)
                symbols = voc.ids(found.words, places)
                inside, rest = places >= 0, symbols >= first_rest
                logs = np.where(inside, voc.log_counts[places], 0.0)
                rest_sizes = np.where(rest, voc.log_rest_sizes[np.maximum(symbols - first_rest, 0)], 0.0)
                ends = np.cumsum(found.lengths + 1)

                def sums(of_word: np.ndarray, of_end: float, found=found, ends=ends) -> np.ndarray:
                    return np.add.reduceat(with_ends(of_word, found, of_end), ends - found.lengths - 1)

                ids = with_ends(symbols, found, voc.id_of_place[0])
                network = gru.score(sent.value, np.split(ids, ends[:-1]), SCORE_LANES) / math.log(10)
                known = sums((inside & (voc.counts[places] > 0)).astype(np.int64), int(voc.counts[0] > 0))
                columns = [
                    pa.array(found.lengths + 1, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(sums(rest_sizes, 0.0), pa.float64()),
                    pa.array(network, pa.float64()),
                    pa.array(sums(logs, voc.log_counts[0]), pa.float64()),
                    pa.array(sums(np.where(rest, logs, 0.0), 0.0), pa.float64()),
                    counted_words(found, ~inside),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], schema.fieldNames())

    scored = materialize(slim.select("row", "doc_id", "held_out", "text").mapInArrow(run, schema), "scored-documents")
    rare = scored.select("row", F.explode("rare").alias("word", "times"))
    known = rare.join(counts, "word").groupBy("row").agg(
        F.sum("times").alias("n_rare"),
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("log_rare"),
    )
    whole = scored.drop("rare").join(known, "row", "left").na.fill({"n_rare": 0, "log_rare": 0.0})
    base = F.col("log_frequent") + F.col("log_rare") - F.col("n_tokens") * math.log10(vocabulary.tokens + vocabulary.distinct + 1)
    rest = F.col("log_rest") + F.col("log_rare") - F.col("rest_sizes")
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.col("n_rare")).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("network") + rest).alias("score"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
