"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import functools
import inspect
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.session import scratch_path

#: The white space that separates words.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
#: Setting of Spark 4.1 on; earlier ones ignore it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions inside remove their shuffle files when they end; else these stay until the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, held: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: what follows does not compute it anew, and a lost executor
    costs no more than one task. The files of its shuffles go at once. ``held`` collects the paths of tables for :func:`freed`."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    if held is not None:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession, held: list[str]) -> None:
    """Delete tables that :func:`stored` wrote, once all that was made of them is stored itself."""
    while held:
        removed(spark, held.pop())


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of this subpackage in the shared folder, when a later one has taken its place."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Parameters of operators that name a column of the documents.
ROLES = ("doc_id", "text", "lang", "source", "url")


def shielded(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let an operator on documents work under column names of its own, so that no column of the caller clashes with one
    inside. Columns come back under their names; those that have the name of a column that the operator adds are replaced."""
    form = inspect.signature(fn)

    @functools.wraps(fn)
    def run(documents: DataFrame, *args, **kwargs) -> DataFrame:
        given = form.bind(documents, *args, **kwargs)
        given.apply_defaults()
        roles = {r: given.arguments[r] for r in ROLES if r in given.arguments}
        inner = {c: f"u{i}_" for i, c in enumerate(documents.columns)}
        outer = {n: c for c, n in inner.items()}
        named = {c: inner[c] for c in roles.values()}
        for k, (name, value) in enumerate(given.arguments.items()):
            if k and isinstance(value, DataFrame):  # another table that shares the documents' id
                given.arguments[name] = value.withColumnsRenamed(named)
        given.arguments.update({r: named[c] for r, c in roles.items()})
        given.arguments[next(iter(form.parameters))] = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()])
        found = fn(*given.args, **given.kwargs)
        added = {c for c in found.columns if c not in outer}
        return found.select(*[F.col(c).alias(outer.get(c, c)) for c in found.columns if outer.get(c) not in added])

    return run


#: A key is hot if it holds more than this part of the counted rows, so there are fewer hot keys than that.
HOT_PARTS = 4096


def with_groups(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` left-joined with ``groups``, which has one row for each of some values of ``key`` and the number ``count`` of
    rows that hold it.

    Fewer than :data:`HOT_PARTS` keys can each hold more than that part of the rows; these are broadcast, so that a hot key
    moves nowhere. The other keys are small and meet their rows by a shuffle; rows without a key take part in none.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_PARTS > total
    near = rows.join(F.broadcast(groups.filter(hot)), key, "left")
    far = rows.join(F.broadcast(groups.filter(hot).select(key)), key, "left_anti").filter(F.col(key).isNotNull())
    settled = near.filter(F.col(key).isNull() | F.col(count).isNotNull())
    return settled.unionByName(far.join(groups.filter(~hot), key, "left"))


def words(text: Column) -> Column:
    """Runs of characters other than white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
