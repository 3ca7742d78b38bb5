"""Spelling variants: words one edit apart, each led to its most frequent neighbour.

The dictionary is cut, in order of its words, into trie shards of bounded size, built where the words lie.
A few shards at a time are broadcast, never more words than ``PASS_WORDS``, and every word's
distance-one Levenshtein automaton runs over them depth-first: a state is a word, a trie
node and how far the two are shifted since the edit. The trie is compact: it has nodes only where
words part, so a node's children are looked up by one letter, and what lies between is checked when a
whole word is reached. Automata of many words run side by side in numpy blocks from a stack.
Each word gets from each round of shards how many neighbours it has there and the best of them;
these are reduced by word at the end. Forms lead to words of ten times the count, so they are followed
to the end in a few rounds.

Work on the words of a round grows with words times rounds, but a shard that holds no neighbour
drops a word after a few states at its root. Memory is bounded by the round, never by the dictionary; each
round's result is written to the shared folder.

Defined results: a null text has no runs, a null id counts as an empty one. Runs that a deletion makes too
short are no words. Repeated rows count each. A word with no neighbour has n_near 0 and is its own root. Of
neighbours with equal counts the first in code-point order is taken. An empty table gives an empty
result. Columns other than the id and the text are not looked at.
"""

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm.columns import documents
from netlens.storage import materialize, release

MIN_LENGTH = 7
MIN_COUNT = 2
#: A form occurs at least so many times as often as its variant.
FACTOR = 10
#: One run in so many, by its checksum, loses a letter.
DELETION = 31
#: Distinct words that a task holds while it counts.
HELD_WORDS = 300_000
#: Words of one shard, and of the shards of one broadcast, at most.
SHARD_WORDS = 1 << 17
PASS_WORDS = 1 << 19
#: Bytes of a shard's words, and of the words that run side by side, at most, but for one long word.
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 1 << 19
#: States of a block on the stack, and pairs of words that are compared at once.
BLOCK_STATES = 1 << 18
BLOCK_ROWS = 1 << 12

#: Latin-1 bytes of a run as they are, capital A-Z as small ones, all else a space.
RUN_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
NEAR = "word string, near long, best_n long, best string"
#: Label of the end of a word.
END = 0


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word and n of bounded stretches of the documents; a word may have many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # Every character of a run is one Latin-1 byte; others become question marks.
                runs = text.as_py().encode("latin-1", "replace").translate(RUN_BYTES).split()
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter([w for w in runs if len(w) >= MIN_LENGTH]).items():
                    checksum = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if checksum % DELETION == 0:
                        at = checksum % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < MIN_LENGTH:
                            continue
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield table(held)
                    held = Counter()
        if held:
            yield table(held)

    def table(held: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in held], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])

    plain = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.coalesce(F.col(text_column), F.lit("")))
    return plain.mapInArrow(run, "word string, n long")


class Trie:
    """A compact trie over sorted distinct words: nodes where words part, edges by letter, words as leaves.

    An edge's target is a node if it is 0 or more, else the word ``-target - 1``.
    """

    def __init__(self, words: list[bytes], counts: list[int]):
        self.words, self.counts = words, np.array(counts, np.int64)
        depth: list[int] = []
        edges: list[tuple[int, int, int]] = []
        self.skips: list[bool] = []
        todo = [(0, len(words), -1, 0, -1)]  # words from, up to; the edge that leads here: node, label; depth behind it
        shared = [_common(a, b) for a, b in zip(words, words[1:], strict=False)]
        while todo:
            low, high, parent, label, behind = todo.pop()
            if high - low == 1 and parent >= 0:
                edges.append((parent, label, -low - 1))
                continue
            node = len(depth)
            at = min(shared[low : high - 1], default=len(words[low]))
            depth.append(at)
            self.skips.append(at > behind + 1 if parent >= 0 else at > 0)
            if parent >= 0:
                edges.append((parent, label, node))
            cuts = [low, *(k + 1 for k in range(low, high - 1) if shared[k] == at), high]
            for a, b in zip(cuts, cuts[1:], strict=False):
                todo.append((a, b, node, words[a][at] if at < len(words[a]) else END, at))
        self.depth = np.array(depth, np.int32)
        self.skips = np.array(self.skips, bool)
        found = np.array(sorted(edges), np.int64).reshape(-1, 3)
        self.edge_label, self.edge_target = found[:, 1].astype(np.uint8), found[:, 2].astype(np.int32)
        self.first_edge = np.searchsorted(found[:, 0], np.arange(len(depth) + 1)).astype(np.int32)

    def opened(self) -> "Trie":
        """With the table of children by node and letter, which isn't sent."""
        n = len(self.depth)
        labels = np.unique(self.edge_label)
        self.column = np.zeros(256, np.uint8)
        self.column[labels] = np.arange(1, len(labels) + 1)
        self.child = np.full((n, len(labels) + 1), NO_CHILD, np.int32)
        nodes = np.repeat(np.arange(n), np.diff(self.first_edge))
        self.child[nodes, self.column[self.edge_label]] = self.edge_target
        self.offset = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        self.letters = np.frombuffer(b"".join(self.words) + b"\0", np.uint8)
        return self


NO_CHILD = np.iinfo(np.int32).min


def _common(a: bytes, b: bytes) -> int:
    """Letters that two words begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    if n > 64:
        return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))
    return next(k for k in range(n) if a[k] != b[k])


def neighbours(trie: Trie, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (place in ``words``, place in the trie's words) that are one edit apart, in order."""
    length = np.array([len(w) for w in words], np.int64)
    width = int(length.max()) + 2
    letters = np.zeros((len(words), width), np.uint8)
    letters[np.arange(width) < length[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    met_word, met_leaf = [], []

    def follow(query: np.ndarray, target: np.ndarray, shift: int | None) -> None:
        leaf = target < 0
        leaf &= target != NO_CHILD
        met_word.append(query[leaf])
        met_leaf.append(-1 - target[leaf])
        inner = target >= 0
        push(query[inner], target[inner], shift)

    def push(query: np.ndarray, node: np.ndarray, shift: int | None) -> None:
        for at in range(0, len(query), BLOCK_STATES):
            stack.append((query[at : at + BLOCK_STATES], node[at : at + BLOCK_STATES], shift))

    stack: list[tuple[np.ndarray, np.ndarray, int | None]] = []
    push(np.arange(len(words), dtype=np.int32), np.zeros(len(words), np.int32), None)
    while stack:
        query, node, shift = stack.pop()
        place = trie.depth[node] + (shift or 0)
        inside = place <= length[query]
        if shift is None:  # no edit so far
            inside_or_one_more = place <= length[query] + 1
            gap = trie.skips[node] & inside_or_one_more
            push(query[gap], node[gap], -1)  # a letter more in the trie, before this node
            query, node, place = query[inside], node[inside], place[inside]
            more = place < length[query]
            push(query[more], node[more], 1)  # a letter less
            own = letters[query, place]
            size = trie.first_edge[node + 1] - trie.first_edge[node]
            of = np.repeat(np.arange(len(query), dtype=np.int32), size)
            edge = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(trie.first_edge[node], size)
            label, target = trie.edge_label[edge], trie.edge_target[edge]
            same, letter = label == own[of], label != END
            follow(query[of[same]], target[same], None)
            other = letter & ~same & more[of]
            follow(query[of[other]], target[other], 0)  # another letter
            follow(query[of[letter]], target[letter], -1)  # a letter more here
        else:
            inside &= place >= 0
            query, node, place = query[inside], node[inside], place[inside]
            follow(query, trie.child[node, trie.column[letters[query, place]]], shift)
    return _one_apart(trie, letters, length, np.concatenate(met_word), np.concatenate(met_leaf))


def _one_apart(trie: Trie, letters: np.ndarray, length: np.ndarray, query: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the met pairs that really are one edit apart, each once."""
    size = (trie.offset[leaf + 1] - trie.offset[leaf]).astype(np.int64)
    close = np.abs(size - length[query]) <= 1
    pair = np.unique(query[close].astype(np.int64) << 32 | leaf[close])
    query, leaf = pair >> 32, pair & 0xFFFFFFFF
    kept = np.zeros(len(pair), bool)
    longest = np.maximum(length[query], trie.offset[leaf + 1] - trie.offset[leaf])
    order = np.argsort(longest, kind="stable")
    at = 0
    while at < len(order):  # words of like length together
        widest = int(longest[order[min(at + BLOCK_ROWS, len(order)) - 1]]) + 1
        some = order[at : at + min(BLOCK_ROWS, max(1, BLOCK_BYTES // widest))]
        at += len(some)
        q, j = query[some], leaf[some]
        la, lb = length[q], trie.offset[j + 1] - trie.offset[j]
        span = np.arange(int(longest[some].max()) + 1)
        a = letters[q[:, None], np.minimum(span, letters.shape[1] - 1)]
        a[span >= la[:, None]] = 0
        b = trie.letters[np.minimum(trie.offset[j][:, None] + span, len(trie.letters) - 1)]
        b[span >= lb[:, None]] = 0
        differ = a != b
        first = np.argmax(differ, axis=1)
        behind = span[:-1] >= first[:, None]
        later = behind & (a[:, :-1] != b[:, 1:])
        earlier = behind & (a[:, 1:] != b[:, :-1])
        kept[some] = np.where(
            la == lb,
            differ.sum(axis=1) == 1,
            np.where(la < lb, ~later.any(axis=1), ~earlier.any(axis=1)),
        )
    return query[kept], leaf[kept]


def shards(words: DataFrame) -> DataFrame:
    """shard, size and trie (pickled): the words in order, cut into shards of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        from pyspark import TaskContext

        number, held, counts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def made() -> pa.RecordBatch:
            data = pickle.dumps(Trie(held, counts), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(held)]), pa.array([data], pa.binary())], ["shard", "size", "trie"])

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(word.encode("latin-1"))
                counts.append(n)
                size += len(word)
                if len(held) >= SHARD_WORDS or size >= SHARD_BYTES:
                    yield made()
                    number, held, counts, size = number + 1, [], [], 0
        if held:
            yield made()

    ordered = words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
    return ordered.mapInArrow(run, "shard long, size long, trie binary")


def rounds(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Shards in order, as many in a round as have PASS_WORDS words together."""
    found: list[list[int]] = []
    room = 0
    for shard, size in sorted(sizes):
        if not found or size > room:
            found.append([])
            room = PASS_WORDS
        found[-1].append(shard)
        room -= size
    return found


def near_in(words: DataFrame, tries: list[bytes]) -> DataFrame:
    """word, near, best_n, best: for each word with neighbours in these shards how many there are, and the best."""
    sent = words.sparkSession.sparkContext.broadcast(tries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        opened = [pickle.loads(t).opened() for t in sent.value]  # noqa: S301  made by shards()
        for batch in batches:
            for first, last in stretches(batch.column(0)):
                part = batch.slice(first, last - first)
                own = [w.encode("latin-1") for w in part.column(0).to_pylist()]
                near, best_n = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                best = [b""] * len(own)
                for trie in opened:
                    query, leaf = neighbours(trie, own)
                    if not len(query):
                        continue
                    near += np.bincount(query, minlength=len(own))
                    order = np.lexsort((leaf, -trie.counts[leaf], query))
                    query, leaf = query[order], leaf[order]
                    ahead = np.concatenate([[True], np.diff(query) > 0])
                    for q, j in zip(query[ahead].tolist(), leaf[ahead].tolist(), strict=True):
                        n, word = trie.counts[j], trie.words[j]
                        if n > best_n[q] or n == best_n[q] and word < best[q]:
                            best_n[q], best[q] = n, word
                found = np.flatnonzero(near)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(found)),
                        pa.array(near[found]),
                        pa.array(best_n[found]),
                        pa.array([best[k].decode("latin-1") for k in found], pa.string()),
                    ],
                    ["word", "near", "best_n", "best"],
                )

    made = materialize(words.mapInArrow(run, NEAR), "near")
    sent.destroy()
    return made


def stretches(words: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of a batch's words that fit BLOCK_BYTES when all are as long as the longest."""
    sizes = pc.utf8_length(words).to_pylist()
    first = longest = 0
    for k, size in enumerate(sizes):
        if k > first and (k + 1 - first) * max(longest, size) > BLOCK_BYTES:
            yield first, k
            first, longest = k, 0
        longest = max(longest, size)
    if first < len(sizes):
        yield first, len(sizes)


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word."""
    spark = docs.sparkSession
    counted = count_words(docs, id_column, text_column).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)
    words = materialize(counted, "words")
    tries = materialize(shards(words), "trie-shards")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts: list[DataFrame] = []
    for some in rounds([(r.shard, r.size) for r in tries.select("shard", "size").collect()]):
        blobs = [bytes(r.trie) for r in tries.where(F.col("shard").between(some[0], some[-1])).select("trie").collect()]
        parts.append(near_in(words.select("word").repartition(tasks, "word"), blobs))
    near = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], NEAR)
    best = near.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form"))).alias("best"))
    led = F.col("form_n") >= FACTOR * F.col("n")
    joined = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")
    )
    formed = materialize(joined.withColumns({"form": F.when(led, F.col("form")), "form_n": F.when(led, F.col("form_n"))}), "forms")
    for table in (words, tries, *parts):
        release(table)
    roots = follow_forms(formed.where("form is not null").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def follow_forms(links: DataFrame) -> DataFrame:
    """word and root: each link followed to the last; every round doubles the steps."""
    links = materialize(links, "links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = materialize(moved, "links")
        release(links)
        links = moved.select("word", "root")
        links._scratch_path = moved._scratch_path
        if moved.where("moved").isEmpty():
            return links


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))
