"""Connected components by rounds of contraction, on DataFrames.

In each round every node points to the smallest of itself and its neighbours; pointers are
followed four steps, and the links are rewritten to what they point to. A node with a smaller
neighbour goes, so the links shrink at each round. Every step aggregates before it shuffles;
each round is written to the shared folder, so lineage stays short.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.storage import materialize, release


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of a link (a, b)."""
    links = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    roots = None
    while True:
        both = links.union(links.select("b", "a"))
        pointers = materialize(
            both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).withColumnRenamed("a", "node"),
            "pointers",
        )
        for _ in range(2):
            target = pointers.select(F.col("node").alias("to"), F.col("to").alias("further"))
            jumped = materialize(pointers.join(target, "to").select("node", F.col("further").alias("to")), "pointers")
            release(pointers)
            pointers = jumped
        if roots is None:
            moved = pointers.withColumnRenamed("to", "root")
        else:
            moved = roots.join(
                pointers.withColumnRenamed("node", "root"),
                "root",
                "left",
            ).select("node", F.coalesce("to", "root").alias("root"))
        moved = materialize(moved, "roots")
        first = pointers.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        second = pointers.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        rest = links.join(first, "a").join(second, "b").where("ta <> tb")
        rest = materialize(rest.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
        for table in (links, pointers, *([roots] if roots is not None else [])):
            release(table)
        links, roots = rest, moved
        if links.isEmpty():
            release(links)
            return roots
