"""Column helpers that several operators of this package share."""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.storage import materialize

# The separators between words, as a character class.
SPACE = r"[ \t\n\x0B\f\r]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once a row and use it in ``body``.

    A plain nested expression that a lambda refers to would be evaluated for each element.
    """
    return F.transform(F.array(value), body)[0]


def scanned(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element the combination of all up to it, in rounds over doubled steps: n log n in all.

    A fold that appends to an array would copy it at each step. ``combine`` is associative.
    """
    rounds = F.sequence(F.lit(0), F.length(F.bin(F.size(values).cast("long"))) - 1)

    def one_round(held: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        return let(step, lambda n: F.transform(held, lambda x, i: F.when(i < n, x).otherwise(combine(F.get(held, i - n), x))))

    return F.aggregate(rounds, values, one_round)


def words(text: Column) -> Column:
    """Words of a text between ASCII white space; empty for null."""
    parts = F.split(F.btrim(text, F.lit(SPACE_CHARS)), SPACE + "+")
    return F.when(
        F.coalesce(F.btrim(text, F.lit(SPACE_CHARS)), F.lit("")) == "",
        F.array().cast("array<string>"),
    ).otherwise(parts)


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def with_row_id(docs: DataFrame, row: str) -> DataFrame:
    """The frame with a column that identifies each row, the same in every pass over it.

    Rows of a file scan have a place in their file. Any other frame is numbered and written.
    """
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    if "_metadata" not in docs.columns:
        try:
            return docs.select("*", place.alias(row))
        except AnalysisException:
            pass
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
