"""Exact dedup by progressive refinement: length, then a prefix hash, then a full hash of the groups that are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.llm.tables import stored, with_groups

#: The white space that counts besides the space itself.
BLANKS = "\t\n\x0b\x0c\r"
#: Characters of the prefix hash.
PREFIX = 256
#: 64-bit words of the filter of surviving groups: at most so many rows of 16 bytes are broadcast, whatever the table's size.
FILTER_WORDS = 1 << 17


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty. Single characters are replaced first, so that a
    regular expression runs only over texts with longer runs."""
    plain = F.coalesce(text.cast("string"), F.lit(""))
    for c in BLANKS:
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " {2,}", " ")).otherwise(plain)


def _place(length: str, prefix: str) -> tuple[Column, Column]:
    """Word and bit of a group in the filter."""
    bucket = F.pmod(F.xxhash64(length, prefix), F.lit(64 * FILTER_WORDS))
    return F.floor(bucket / 64).alias("word"), F.pmod(bucket, F.lit(64)).cast("int").alias("bit")


def surviving(measured: DataFrame) -> DataFrame:
    """Filter ``(word, bits)`` of the groups of ``measured(length, prefix)`` that more than one row shares: first lengths
    that recur, then among these prefixes that recur."""
    groups = stored(measured.groupBy("length", "prefix").agg(F.count("*").alias("n")), "prefixes")
    lengths = groups.groupBy("length").agg(F.sum("n").alias("rows")).filter("rows > 1").select("length")
    left = groups.filter("n > 1").join(lengths, "length", "left_semi")
    word, bit = _place("length", "prefix")
    return left.select(word, bit).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def exact_copies(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **extra: Column) -> DataFrame:
    """One row per row of ``documents``: ``doc_id, keep_id, group_size, kept`` and the columns ``extra``, which may use the
    normalised text under the name ``norm``.

    Texts are equal when they are identical after replacing each run of ASCII white space by one space; leading and trailing
    runs count like others, null is empty. Of equal texts the row with the smallest doc_id stays (null last; of rows with
    one id a single one), ``keep_id`` is its id and ``group_size`` counts the rows. An empty table gives no rows. Only
    ``doc_id`` and ``text`` are read, so other columns can have any name.

    The first pass over the texts counts (length, prefix hash). Groups of more than one row set a bit in a filter of fixed
    size, and the second pass hashes the whole text (SHA-256) of rows whose bit is set; a bit that two groups share costs a
    hash and no more. Texts never move; lengths, hashes and ids do.
    """
    source = documents.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("norm"))
    measured = source.select(
        "*", F.length("norm").alias("length"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix")
    )
    word, bit = _place("length", "prefix")
    left = F.broadcast(surviving(measured.select("length", "prefix")))
    full = F.when(F.expr("getbit(bits, bit)") == 1, F.sha2("norm", 256))
    columns = [c.alias(name) for name, c in extra.items()]
    hashed = stored(
        measured.select("*", word, bit)
        .join(left, "word", "left")
        .select("doc_id", F.monotonically_increasing_id().alias("row"), full.alias("full"), *columns),
        "hashed",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")).alias("first")
    groups = hashed.filter("full is not null").groupBy("full").agg(first, F.count("*").alias("n")).filter("n > 1")
    found = with_groups(hashed, stored(groups, "groups"), "full", "n")
    alone = F.col("n").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
        *extra,
    )


def keep_first(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one row of each group of equal texts, that which :func:`exact_copies` keeps; of wholly equal rows
    one. All columns stay as they are, whatever their names."""
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"))
    row = [F.col(f"doc.`{c}`") for c in documents.columns]
    keyed = packed.select("doc", F.xxhash64(*row).alias("key"), F.xxhash64(F.lit("row"), *reversed(row)).alias("check"))
    same = keyed.select("key", "check", F.col(f"doc.`{doc_id}`").alias("doc_id"), F.col(f"doc.`{text}`").alias("text"))
    distinct = same.dropDuplicates(["key", "check"])
    found = _kept_keys(distinct)
    return keyed.join(found, ["key", "check"], "left_semi").dropDuplicates(["key", "check"]).select("doc.*")


def _kept_keys(rows: DataFrame) -> DataFrame:
    """``(key, check)`` of the rows of ``rows(key, check, doc_id, text)`` that stay: the keys travel inside the id."""
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key", "check").alias("id"), "text")
    kept = exact_copies(named, "id", "text").filter("kept")
    return kept.select("doc_id.key", "doc_id.check")
