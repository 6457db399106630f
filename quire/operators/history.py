"""Undo and redo over versions of page lists.

Versions are rows: (version, page columns). A state is three numbers for the driver to keep: the version that is
current, the oldest that can be undone to, and the newest that can be redone to. Pages hold no pixels, so a
version is small; a long session should store versions now and then to cut their lineage.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.pages import operations_equal

CAP = 50
#: What of a page a snapshot keeps.
SNAPSHOT = [
    "document", "position", "id", "source_id", "source_page_index", "page_size_pts", "operations", "selected",
]


class State(NamedTuple):
    current: int
    oldest: int
    newest: int


def snapshot(pages: DataFrame) -> DataFrame:
    """Pages without thumbnails and whatever else isn't theirs."""
    return pages.select(*SNAPSHOT)


def restored(snapshots: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """Snapshots with a thumbnail (id, thumbnail), where there is one."""
    return snapshots.join(thumbnails.select("id", "thumbnail"), "id", "left")


def push(versions: DataFrame | None, state: State | None, pages: DataFrame) -> tuple[DataFrame, State]:
    """Adds the present pages as a version. What could be redone is gone; the newest CAP stay."""
    number = 0 if state is None else state.current + 1
    own = snapshot(pages).select(F.lit(number).alias("version"), *SNAPSHOT)
    if versions is not None:
        own = versions.filter(F.col("version") < number).unionByName(own)
    after = State(number, max(0 if state is None else state.oldest, number - CAP + 1), number)
    return capped(own), after


def capped(versions: DataFrame, cap: int = CAP) -> DataFrame:
    """The newest `cap` versions."""
    newest = versions.agg(F.max("version").alias("__newest"))
    return versions.join(F.broadcast(newest), F.col("version") > F.col("__newest") - cap).drop("__newest")


def undo(state: State) -> State:
    return state._replace(current=max(state.oldest, state.current - 1))


def redo(state: State) -> State:
    return state._replace(current=min(state.newest, state.current + 1))


def at(versions: DataFrame, state: State) -> DataFrame:
    return versions.filter(F.col("version") == state.current).drop("version")


def changed(versions: DataFrame) -> DataFrame:
    """version, id, and whether the page's operations differ from those one version earlier (null if it is new)."""
    before = versions.select((F.col("version") + 1).alias("version"), "id", F.col("operations").alias("__before"))
    same = operations_equal(F.col("operations"), F.col("__before"))
    return versions.join(before, ["version", "id"], "left").select(
        "version", "id", F.when(F.col("__before").isNotNull(), ~same).alias("changed")
    )


def snapshot_diff(snapshots: DataFrame, current: DataFrame) -> DataFrame:
    """Snapshot pages with needs_thumbnail: no current page of that id has a thumbnail of the same source page and
    operations. current has thumbnail, null where there is none."""
    old = current.select(
        F.col("id").alias("__id"),
        F.col("source_id").alias("__source_id"),
        F.col("source_page_index").alias("__index"),
        F.col("operations").alias("__ops"),
        F.col("thumbnail"),
    )
    fits = (
        F.col("thumbnail").isNotNull()
        & F.col("source_id").eqNullSafe(F.col("__source_id"))
        & F.col("source_page_index").eqNullSafe(F.col("__index"))
        & operations_equal(F.col("operations"), F.col("__ops"))
    )
    joined = snapshots.join(old, F.col("id") == F.col("__id"), "left")
    return joined.select(
        *snapshots.columns, (~fits).alias("needs_thumbnail"), F.when(fits, F.col("thumbnail")).alias("thumbnail")
    )
