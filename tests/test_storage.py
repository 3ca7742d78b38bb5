"""Intermediate tables are written, read again and deleted."""

import os

from netlens.storage import materialize, release, release_since, written


def places(df):
    return df._scratch_path.removeprefix("file://")


def test_tables_are_deleted_from_a_mark_on(spark):
    first, start = materialize(spark.range(5), "first"), written()
    others = [materialize(spark.range(n), "other") for n in range(3)]
    kept = materialize(spark.range(7), "kept")
    release_since(start, kept)
    assert [os.path.exists(places(x)) for x in (first, *others, kept)] == [True, False, False, False, True]
    assert kept.count() == 7 and written() == start + 1
    release(kept)
    release(first)
    assert not os.path.exists(places(kept)) and not os.path.exists(places(first))
