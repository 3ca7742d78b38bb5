"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

A text's pieces are those that merging neighbours by score, leftmost first, would leave. They are
found without merging the text: an Aho-Corasick automaton over the reversed pieces tells the longest
piece that starts at each place; pieces are laid one after the other, the longest first, and a piece
may follow another only if merging the characters of the two alone gives back just these two. Where
no piece fits, the place is marked in a bitfield and the piece before it is shortened. A sequence
all of whose neighbours are compatible in this way is the result of merging the whole.

No piece reaches over certain bounds (from a word to the space behind it, from letters to other
signs), so texts are cut there first; most cuts repeat in a corpus and come from a cache. The class
checks over the vocabulary that this holds, and takes texts whole if it doesn't.

Rows are independent: there is no shuffle, and a lost task is simply done again. Memory holds one
batch's ids; batches are sent on at about BATCH_IDS ids. Nulls among ids are left out.

Defined results: a null or empty text has no ids; null or empty ids decode to the empty text. Repeated
rows are encoded each by itself. Columns other than the id and the text are not looked at by ``encode``,
and are passed on by ``decode``. An empty table gives an empty result. Characters outside the vocabulary
become byte pieces. ``decode`` takes any ids of the model; bytes that are no UTF-8 become U+FFFD each.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm.columns import documents, unused_name

#: Cached segments and pairs of a worker, at most so many of each.
CACHE_ENTRIES = 250_000
#: Ids that one output batch holds, about; and texts or id lists of more than this stand alone.
BATCH_IDS = 1_000_000
NEVER = float("-inf")
NOTHING: dict[str, int] = {}
#: A segment of more characters is not worth keeping.
CACHED_CHARS = 64

# How the model's file writes a space, the letters that segments are cut at, and what an unknown id decodes to.
SPACE = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
UNKNOWN_TEXT = " ⁇ "


class MergeModel:
    """A SentencePiece BPE model with byte fallback and no normalisation but the space before a text."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        trainer, normalizer = proto.trainer_spec, proto.normalizer_spec
        plain = normalizer.add_dummy_prefix and not normalizer.remove_extra_whitespaces and not normalizer.precompiled_charsmap
        kinds = proto.SentencePiece
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or not plain:
            raise ValueError("a BPE model with byte fallback, a space before the text and no other normalisation is needed")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.score = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        id_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.id_bytes = {p: i.to_bytes(4, "little") for p, i in id_of.items()}
        byte_ids = [i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE]
        value = {i: int(proto.pieces[i].piece[1:-1], 16) for i in byte_ids}
        self.byte_id = {b: i for i, b in value.items()}
        self.controls = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.bytes_of = [
            bytes([value[i]]) if i in value
            else b"" if i in self.controls
            else UNKNOWN_TEXT.encode() if p.type == kinds.UNKNOWN
            else p.piece.replace(SPACE, " ").encode()
            for i, p in enumerate(proto.pieces)
        ]
        self.byte_ids = set(byte_ids)
        self.spaced = {i for p, i in id_of.items() if p.startswith(SPACE)}
        self.backward = ahocorasick.Automaton()
        for piece in self.score:
            self.backward.add_word(piece[::-1], len(piece))
        self.backward.make_automaton()
        self.cut = re.compile(self._segments()).findall
        self.segments: dict[str, bytes] = {}
        self.followers: dict[str, dict[str, int]] = {}
        self.n_pairs = 0

    def _segments(self) -> str:
        """What texts are cut into: spaces and the letters, or the other signs, that follow them."""
        letter = re.compile(f"[{LETTERS}]").match
        kind = lambda c: "s" if c == SPACE else "l" if letter(c) else "o"
        joined = {kind(a) + kind(b) for p in self.score for a, b in zip(p, p[1:], strict=False)}
        if joined <= {"ss", "sl", "so", "ll", "oo"}:
            return f"{SPACE}*(?:[{LETTERS}]+|[^{SPACE}{LETTERS}]+)|{SPACE}+"
        return r"(?s:.+)"

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging neighbours: the best score first, the leftmost among equals."""
        parts, get = list(text), self.score.get
        scores = [get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > NEVER:
            at = scores.index(best)
            made = parts[at] = parts[at] + parts.pop(at + 1)
            del scores[at]
            if at:
                scores[at - 1] = get(parts[at - 1] + made, NEVER)
            if at < len(scores):
                scores[at] = get(made + parts[at + 1], NEVER)
        return parts

    def fits(self, before: str, piece: str) -> bool:
        """Whether merging the two alone leaves the two; with nothing before, whether the piece is made at all."""
        return self.merged(before + piece) == ([before, piece] if before else [piece])

    def shorter(self, piece: str) -> int:
        """Characters of the longest piece that is a proper prefix of this one; 0 after a single character."""
        return next((k for k in range(len(piece) - 1, 1, -1) if piece[:k] in self.score), min(1, len(piece) - 1))

    def _judged(self, before: str, piece: str) -> int:
        """-1 if the piece may follow, else how long the next one to try is; kept in ``followers``."""
        if self.n_pairs >= CACHE_ENTRIES:
            self.followers.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        found = self.followers.setdefault(before, {})[piece] = -1 if self.fits(before, piece) else self.shorter(piece)
        return found

    def pieces(self, segment: str) -> list[str]:
        """The pieces of a segment, by backtracking over longest matches."""
        n = len(segment)
        longest = [1] * n
        for end, length in self.backward.iter(segment[::-1]):
            start = n - 1 - end
            if length > longest[start]:
                longest[start] = length
        failed = bytearray(n // 8 + 1)
        found: list[str] = []
        before, at, size = "", 0, longest[0] if n else 0
        while at < n:
            known = self.followers.get(before, NOTHING)
            while size:
                end = at + size
                piece = segment[at:end]
                if failed[end >> 3] >> (end & 7) & 1:
                    size = self.shorter(piece)
                    continue
                judged = known.get(piece)
                if judged is None:
                    judged = self._judged(before, piece)
                if judged < 0:
                    break
                size = judged
            if size:
                found.append(piece)
                before, at = piece, end
                size = longest[at] if at < n else 0
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(found.pop())
                size = self.shorter(before)
                before = found[-1] if found else ""
        return found

    def _segment(self, segment: str) -> bytes:
        known = self.id_bytes.get
        made = b"".join([known(p) or self._spelled(p) for p in self.pieces(segment)])
        if len(segment) <= CACHED_CHARS:
            if len(self.segments) >= CACHE_ENTRIES:
                self.segments.clear()
            self.segments[segment] = made
        return made

    def _spelled(self, character: str) -> bytes:
        return b"".join([self.byte_id[b].to_bytes(4, "little") for b in character.encode()])

    def encode(self, text: str) -> bytes:
        """The ids of a text, 32 bits each."""
        if not text:
            return b""
        known = self.segments.get
        return b"".join([known(s) or self._segment(s) for s in self.cut(SPACE + text.replace(" ", SPACE))])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: spaces for their sign but for one before the text, byte runs as UTF-8."""
        table = self.bytes_of
        if not ids:
            return ""
        first = next((k for k, i in enumerate(ids) if i not in self.controls), None)
        cut = first is not None and ids[first] in self.spaced
        try:
            text = b"".join([table[i] for i in ids]).decode()
        except UnicodeDecodeError:
            text = self._repaired(ids)
        return text[1:] if cut else text

    def _repaired(self, ids: list[int]) -> str:
        """As ``decode`` does, with runs of bytes that are no UTF-8."""
        parts: list[str] = []
        run = bytearray()
        for i in [*ids, None]:
            if i in self.byte_ids:
                run += self.bytes_of[i]
                continue
            while run:
                size = next((k for k in (1, 2, 3, 4) if _is_one_character(bytes(run[:k]))), 0)
                parts.append(run[:size].decode() if size else "�")
                del run[: size or 1]
            if i is not None:
                parts.append(self.bytes_of[i].decode())
        return "".join(parts)


def _is_one_character(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


_models: dict[str, MergeModel] = {}


def model_at(path: str) -> MergeModel:
    """One model for each worker process."""
    if path not in _models:
        _models[path] = MergeModel(path)
    return _models[path]


def encode(docs: DataFrame, model_path: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column and ``ids``, the ids of each text."""
    schema = T.StructType([
        T.StructField(id_column, docs.schema[id_column].dataType),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(model_path)
        for batch in batches:
            first, ids, held = 0, [], 0

            def made(upto: int) -> pa.RecordBatch:
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("<i4")  # noqa: B023
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])  # noqa: B023
                lists = pa.ListArray.from_arrays(pa.array(offsets), values)
                return pa.RecordBatch.from_arrays([batch.column(0)[first:upto], lists], [id_column, "ids"])  # noqa: B023

            for k, text in enumerate(batch.column(1)):
                ids.append(model.encode(text.as_py() or ""))
                held += len(ids[-1]) // 4
                if held >= BATCH_IDS:
                    yield made(k + 1)
                    first, ids, held = k + 1, [], 0
            if ids:
                yield made(batch.num_rows)

    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, schema)


def decode(frame: DataFrame, model_path: str, *, ids_column: str = "ids", into: str = "decoded") -> DataFrame:
    """The frame with the text of its ids in a further column, whose name gets an underscore if it is taken."""
    into = unused_name(frame, into)
    schema = T.StructType([*frame.schema.fields, T.StructField(into, T.StringType(), False)])
    place = frame.columns.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(model_path)
        for batch in batches:
            lists = batch.column(place)
            sizes = np.nan_to_num(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), float))
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH_IDS)) + 1
            for first, last in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if first < last:
                    part = batch.slice(int(first), int(last - first))
                    texts = [model.decode(x.values.drop_null().to_numpy().tolist()) if x.is_valid else "" for x in part.column(place)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], schema.names)

    return frame.mapInArrow(run, schema)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    both = decode(encode(documents(spark, sf_dir), path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
