"""Packing by power-of-two decomposition.

Each document's token ids are cut into pieces whose lengths are powers of two, the largest
first: as many full ``max_len`` pieces as fit, then the binary digits of the rest. A piece is
a sequence of its own, so no sequence crosses documents and none is padded. Sequences of
equal length share a bucket; the bucket's exponent forms the high bits of ``sequence_id``.
Cutting needs no shuffle, so a document's cost stays in the task that reads it.

Defined results: a null or empty text has the end id alone (one piece of length 1). Repeated
rows are packed each by itself. Columns other than the id and the text are not looked at.
An empty table gives an empty result.
"""

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm.columns import documents

MAX_LEN = 4096
END_ID = 2
#: Cached words of a worker, at most so many.
CACHE_ENTRIES = 600_000
#: Token bytes that one output batch holds, about.
BATCH_BYTES = 8_000_000

# Normaliser and splits of a tokenizer file whose words can be cached one by one. Any other file is used as it is.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
SPLITS = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# The contractions that the vocabulary's own split of a text keeps whole.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Texts of these characters normalise character by character; chunks with others go through the whole tokenizer.
PLAIN = "!-~\xa1-\u012f\u0131-\u024f"


def word_pattern() -> str:
    """Contractions, runs of letters, single digits, and runs of other characters, within PLAIN."""
    kinds = {"L": "", "N": ""}
    for c in map(chr, range(0x250)):
        kind = unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += c
    letters, numbers = kinds["L"], kinds["N"]
    return f"[{letters}]+|{CONTRACTIONS}|[{numbers}]|[^ \\t\\n\\r{letters}{numbers}]+"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if printable in Latin-1, else the next code point from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + b - sum(p < b for p in printable))
    return table


class CachedTokenizer:
    """Token ids of a text, as little-endian bytes, word by word.

    If the file's vocabulary lowers letters, drops white space and never joins across words, a text's
    ids are those of its words in order, and most words of a corpus repeat and come from a cache. Files with
    other settings encode each text as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        settings = json.loads(self.tokenizer.to_str())
        self.by_word = (
            (settings["normalizer"], settings["pre_tokenizer"], settings["model"]["type"]) == (NORMALIZER, SPLITS, "BPE")
            and not settings["model"].get("dropout")
            and all("<|" in t["content"] for t in settings["added_tokens"])
        )
        self.split = re.compile(word_pattern()).findall
        self.is_plain = re.compile(f"[ \t\n\r{PLAIN}]*").fullmatch
        self.alphabet = byte_alphabet()
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join(self.alphabet[b] for b in word.encode())
        found = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
        if len(self.words) >= CACHE_ENTRIES:
            self.words.clear()
        self.words[word] = found
        return found

    def ids(self, text: str) -> bytes:
        if not self.by_word:
            return self._whole(text)
        if "<|" in text or not self.is_plain(text):
            if len(chunks := re.split(r"[ \t\n\r]+", text)) > 1:
                return b"".join([self.ids(c) for c in chunks])
            return self._whole(text)
        known = self.words.get
        return b"".join([known(w) or self._word(w) for w in self.split(text.lower())])


_tokenizers: dict[str, CachedTokenizer] = {}


def tokenizer_at(path: str) -> CachedTokenizer:
    """One tokenizer for each worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = CachedTokenizer(path)
    return _tokenizers[path]


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """The pieces of n tokens: full ones, then the binary digits of the rest."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    max_len: int = MAX_LEN,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row for each piece: its id column, ``start``, ``length``, ``doc_tokens``, ``bucket``
    (exponent of the length), ``sequence_id``, ``offset`` (always 0) and ``ids`` (little-endian
    unsigned 32-bit). ``max_len`` is a power of two up to 32768.

    ``sequence_id`` holds the bucket, the task and a running number: it is unique and the same
    again when a lost task is repeated.
    """
    if max_len & (max_len - 1) or not 0 < max_len <= 32768:
        raise ValueError("max_len must be a power of two up to 32768")
    id_type = docs.schema[id_column].dataType
    schema = T.StructType([
        T.StructField(id_column, id_type),
        *(T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "bucket", "sequence_id", "offset")),
        T.StructField("ids", T.BinaryType()),
    ])
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, number = tokenizer_at(tokenizer_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows: list[int] = []
            numbers: list[list[int]] = [[] for _ in range(5)]
            ids: list[bytes] = []
            held = 0
            for i, text in enumerate(batch.column(1)):
                data = tokenizer.ids(text.as_py() or "") + end
                n, start = len(data) // 4, 0
                for length in piece_lengths(n, max_len):
                    bucket = length.bit_length() - 1
                    for column, value in zip(numbers, (start, length, n, bucket, bucket << 58 | number), strict=True):
                        column.append(value)
                    rows.append(i)
                    ids.append(data[4 * start : 4 * (start + length)])
                    start += length
                    number += 1
                    held += 4 * length
                    if held >= BATCH_BYTES:
                        yield made(batch, rows, numbers, ids)
                        rows, numbers, ids, held = [], [[] for _ in range(5)], [], 0
            if rows:
                yield made(batch, rows, numbers, ids)

    def made(batch, rows, numbers, ids):
        columns = [
            batch.column(0).take(pa.array(rows, pa.int32())),
            *(pa.array(x, pa.int64()) for x in numbers),
            pa.array([0] * len(rows), pa.int64()),
            pa.array(ids, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(cut, schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the pieces with one folder for each sequence length."""
    pieces.write.partitionBy("bucket").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "bucket",
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
