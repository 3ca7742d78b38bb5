"""Media columns: payloads kept in baseline JPEG files, and features read from them.

``store`` writes a text's bytes, padded with blanks to a multiple of 192, as the quantised
coefficients of a colour image: an MCU of three 8 by 8 blocks holds 192 bytes. Coefficients are
what baseline JPEG keeps exactly, so the payload is lossless. ``inspect`` parses the markers of
any baseline file, decodes its scan, and gives dimensions, a DC-only luminance thumbnail's hash
and, for files that ``store`` made, the payload. Of other files only DC values are kept, so a file takes
memory in proportion to its bytes, whatever it claims.

Defined results: a null or empty text is 192 blanks. A null or broken file gives null features.
Repeated rows give a row each; equal texts give equal files. An empty table gives an empty
result. Other columns are not looked at.
"""

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm import jpeg
from netlens.llm.columns import documents

UNIT = 192
COMPONENTS = 3
#: MCUs between restart markers: the reader's lanes.
RESTART = 8
#: Largest height of an image in MCUs; larger payloads are wider.
MOST_ROWS = 8191
#: Payload bytes that are coded at once, about.
GROUP = 2 << 20

# Byte b as a coefficient that is never zero, and back.
TO_COEFFICIENT = np.array([b - 128 if b < 128 else b - 127 for b in range(256)], np.int16)


def padded(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT)


def write_files(texts: list[bytes]) -> list[bytes]:
    """A JPEG file for each text."""
    payloads = [padded(t) for t in texts]
    shapes = []
    for p in payloads:
        mcus = len(p) // UNIT
        columns = -(-mcus // MOST_ROWS)
        shapes.append((columns, -(-mcus // columns)))
    stored = [p.ljust(c * r * UNIT) for p, (c, r) in zip(payloads, shapes, strict=True)]
    step = UNIT * RESTART
    coded: list[list[bytes]] = [[] for _ in stored]
    group: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> None:
        data = np.frombuffer(b"".join(x for _, x in group), np.uint8)
        counts = [n for _, x in group for n in [RESTART * COMPONENTS] * (len(x) // step) + [len(x) % step // jpeg.BLOCK] if n]
        made = iter(jpeg.encode_segments(TO_COEFFICIENT[data].reshape(-1, jpeg.BLOCK), np.repeat(np.arange(len(counts)), counts), COMPONENTS))
        for k, x in group:
            coded[k] += [next(made) for _ in range(-(-len(x) // step))]

    for k, data in enumerate(stored):
        for start in range(0, len(data), GROUP // step * step):
            group.append((k, chunk := data[start : start + GROUP // step * step]))
            held += len(chunk)
            if held >= GROUP:
                flush()
                group, held = [], 0
    if group:
        flush()
    return [jpeg.joined(jpeg.header(8 * c, 8 * r, COMPONENTS, RESTART, b"payload %d %d" % (len(t), len(p))), s) for t, p, (c, r), s in zip(texts, payloads, shapes, coded, strict=True)]


#: Bits of the shortest code that ``write_files`` writes for a coefficient, with its sign and value.
LEAST_BITS = 6


def said_of(image: jpeg.Image) -> tuple[int, int] | None:
    """The text's and the payload's bytes that a file of ``write_files`` names; None for any other file."""
    said = re.fullmatch(rb"payload (\d{1,18}) (\d{1,18})", image.comment)
    if not said or len(image.blocks) != COMPONENTS:
        return None
    n, padded_size = int(said[1]), int(said[2])
    holds = image.mcus * UNIT
    if not n <= padded_size <= holds or padded_size % UNIT or holds * LEAST_BITS > 8 * sum(map(len, image.segments)):
        return None
    return n, padded_size


def payload_of(image: jpeg.Image, coefficients: np.ndarray) -> tuple[int, bytes] | None:
    """Length without padding and the payload of a file of ``write_files``; None for others."""
    said = said_of(image)
    if said is None:
        return None
    values = coefficients.ravel()
    data = (values + np.where(values < 0, 128, 127)).astype(np.uint8).tobytes()
    return said[0], data[: said[1]]


def read_files(files: list[bytes | None]) -> list[tuple | None]:
    """(image, coefficients) of each file, those of files without a payload cut to DC; None for broken ones."""
    images: dict[int, jpeg.Image] = {}
    for k, data in enumerate(files):
        if data:
            try:
                images[k] = jpeg.Image(data)
            except (ValueError, IndexError, KeyError):  # what the parser raises for broken markers
                continue
    alike: dict[tuple, list[int]] = {}
    for k, image in images.items():
        alike.setdefault((image.blocks, jpeg.BLOCK if said_of(image) else 1), []).append(k)
    out: list[tuple | None] = [None] * len(files)
    for (_, kept), group in alike.items():
        for k, found in zip(group, jpeg.decode([images[k] for k in group], kept), strict=True):
            out[k] = None if found is None else (images[k], found)
    return out


def grouped(values: list, size) -> Iterator[list]:
    group, held = [], 0
    for v in values:
        group.append(v)
        held += size(v)
        if held >= GROUP:
            yield group
            group, held = [], 0
    if group:
        yield group


def store(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``media``, the file that holds its text."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1).cast(pa.binary())]
            for group in grouped(texts, len):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(group)), pa.array(write_files(group), pa.binary())], ["doc_id", "media"])
                start += len(group)

    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, schema)


FEATURES = "width int, height int, thumbnail binary, thumbnail_hash string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string"


def inspect(media: DataFrame) -> DataFrame:
    """``doc_id`` and FEATURES of each file; the payload's are null for files of other origin."""
    extra = T._parse_datatype_string(FEATURES)
    schema = T.StructType([media.schema["doc_id"], *extra.fields])

    def row(data: bytes | None, found: tuple | None) -> tuple:
        if data is None or found is None:
            return (None,) * len(extra.fields)
        image, coefficients = found
        pixels = jpeg.thumbnail(image, coefficients)
        kept = payload_of(image, coefficients)
        of_payload = (kept[0], len(kept[1]), hashlib.sha256(kept[1]).hexdigest(), zlib.crc32(kept[1][-16:])) if kept else (None,) * 4
        return (image.width, image.height, pixels.tobytes(), jpeg.average_hash(pixels), *of_payload, len(data), hashlib.sha256(data).hexdigest())

    arrow = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for group in grouped(batch.column(1).to_pylist(), lambda x: len(x or b"")):
                rows = [row(d, f) for d, f in zip(group, read_files(group), strict=True)]
                columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(group)), *columns], schema.fieldNames())
                start += len(group)

    return media.select("doc_id", "media").mapInArrow(run, schema)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inspect(store(documents(spark, sf_dir)))
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash", F.md5("thumbnail"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
