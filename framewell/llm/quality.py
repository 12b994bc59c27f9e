"""Quality rules whose thresholds come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.llm.tables import WORD, shielded, stored, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A group's quantiles are blended with those of its parent (language, then all documents), which count as so many documents.
PARENT_WEIGHT = 100
#: A fence by spread lies so many times the distance from median to quartile beyond the quartile.
FENCE = 6
#: Measure: (SQL form over the statistics, how its fence is found, rate that is never odd). A measure that most documents have
#: has a fence ``above`` or on ``both`` sides by spread. Of one that few documents have the quartiles are zero: its fence is the
#: ``tail``, the quantile 0.998 of the group. Most texts have no symbol at all and the tail of many groups is junk, so symbols
#: take the spread and a rate below which they are never odd.
MEASURES = {
    "symbols": ("1000 * n_symbols div greatest(n_words, 1L)", "above", 200),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1L)", "tail", 0),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1L)", "tail", 0),
    "word_length": ("100 * word_chars div greatest(n_words, 1L)", "both", 0),
}
QUANTILES = ["q250", "q500", "q750", "q998"]
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with word, symbol and repetition counts of the whole ``text``; null counts as an empty text.

    A repeated window is found by the 64-bit hashes of the windows of one text. Only texts with a repeated hash are
    sorted. Adds ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``; columns of these names are
    replaced.
    """
    full = F.coalesce(F.col(text), F.lit(""))
    base = df.drop(*STATISTICS, "n_lines")
    keep = base.columns
    split = base.select(
        *keep, words(F.col(text)).alias("_words"), F.filter(F.split(full, "\n"), lambda x: x.rlike(WORD)).alias("_lines")
    )
    n = F.size("_words").cast("long")
    counted = split.select(
        *keep,
        n.alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(full, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("_words") > WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("_words") - WINDOW + 1), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))
            ),
        ).alias("_windows"),
    )
    plain = [*keep, *STATISTICS[:4], "n_lines"]
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ranked = counted.select(
        *plain,
        F.when(
            repeated,
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i")))),
        ).alias("_ranked"),
    )

    def twin(s: Column, k: Column) -> Column:
        near = [F.get("_ranked", k + step)["h"] for step in (-1, 1)]
        return F.coalesce(near[0] == s["h"], F.lit(False)) | F.coalesce(near[1] == s["h"], F.lit(False))

    starts = ranked.select(
        *plain,
        F.sort_array(F.transform(F.filter("_ranked", twin), lambda s: s["i"])).alias("_starts"),
    )
    covered = F.aggregate(
        F.transform(
            "_starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1) - s, F.lit(WINDOW)))
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    return starts.select(*plain, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def quantile_sketches(stats: DataFrame, groups: list[str], measures: dict[str, str]) -> DataFrame:
    """Sketches of integer measures per group: rows ``(*groups, measure, bin, n)``.

    A bin keeps the six leading binary digits of a value (relative error below 1/32), so a sketch has at most 32 bins for
    each power of two, and sketches merge by adding the counts of equal bins, in any order.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(m).alias("m"), F.expr(e).cast("long").alias("v")) for m, e in measures.items()])
    )
    rows = stats.select(*groups, pairs.alias("_p")).select(
        *groups,
        F.col("_p.m").alias("measure"),
        F.expr("_p.v - _p.v % shiftleft(1L, greatest(length(bin(_p.v)) - 6, 0))").alias("bin"),
    )
    return rows.groupBy(*groups, "measure", "bin").agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """``(*groups, measure, n, q250, q500, q750, q998)``: values by rank, the lower two as the lowest value of their bin, the
    upper two as the highest."""
    keys = [*groups, "measure"]
    w = Window.partitionBy(*keys)
    ranked = sketches.withColumns(
        {
            "_below": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)),
            "_all": F.sum("n").over(w),
            "_top": F.expr("bin + shiftleft(1L, greatest(length(bin(bin)) - 6, 0)) - 1"),
        }
    )

    def at(rank: int, value: str) -> Column:
        return F.min(F.when(1000 * F.col("_below") >= rank * F.col("_all"), F.col(value))).alias(f"q{rank}")

    return ranked.groupBy(*keys).agg(
        F.max("_all").alias("n"), at(250, "bin"), at(500, "bin"), at(750, "_top"), at(998, "_top")
    )


def blended(child: str, parent: str) -> list[Column]:
    """Quantiles of ``child`` drawn towards those of ``parent``, the less the more documents the child has."""
    n = F.col(f"{child}.n")
    return [
        F.floor((n * F.col(f"{child}.{q}") + PARENT_WEIGHT * F.col(f"{parent}.{q}")) / (n + PARENT_WEIGHT)).alias(q)
        for q in QUANTILES
    ]


def adaptive_thresholds(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per language and source, nulls being a group of their own, with ``hi_<measure>`` and ``lo_<measure>``."""
    passing = stats.filter(~F.col("base_failed"))
    fine = quantile_sketches(passing, [lang, source], {m: e for m, (e, _, _) in MEASURES.items()})
    levels = F.array(
        *[
            F.struct(F.lit(k).alias("level"), a.cast("string").alias("lang"), b.cast("string").alias("source"))
            for k, a, b in (
                (0, F.col(lang), F.col(source)),
                (1, F.col(lang), F.lit(None)),
                (2, F.lit(None), F.lit(None)),
            )
        ]
    )
    merged = (
        fine.select(F.explode(levels).alias("_g"), "measure", "bin", "n")
        .groupBy("_g.level", "_g.lang", "_g.source", "measure", "bin")
        .agg(F.sum("n").alias("n"))
    )
    found = quantiles(merged, ["level", "lang", "source"])
    own = found.filter("level = 0").drop("level").alias("g0")
    by_lang = (
        found.filter("level = 1").alias("g1")
        .join(found.filter("level = 2").alias("g2"), F.col("g1.measure") == F.col("g2.measure"))
        .select("g1.lang", "g1.measure", *blended("g1", "g2"))
        .alias("p")
    )
    chosen = own.join(
        by_lang, (F.col("g0.measure") == F.col("p.measure")) & F.col("g0.lang").eqNullSafe(F.col("p.lang"))
    ).select(
        F.col("g0.lang").alias("_lang"),
        F.col("g0.source").alias("_source"),
        F.col("g0.measure").alias("measure"),
        *blended("g0", "p"),
    )
    above = F.col("q750") + FENCE * (F.col("q750") - F.col("q500"))
    fences = []
    for m, (_, kind, never) in MEASURES.items():
        here = F.col("measure") == m
        high = F.col("q998") if kind == "tail" else above + never
        fences.append(F.max(F.when(here, high)).alias(f"hi_{m}"))
        if kind == "both":
            low = F.col("q250") - FENCE * (F.col("q500") - F.col("q250"))
            fences.append(F.max(F.when(here, low)).alias(f"lo_{m}"))
    return chosen.groupBy("_lang", "_source").agg(*fences)


@shielded
def judge_quality(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``documents`` without the text, with the statistics, ``base_failed`` and ``kept``.

    A document is rejected by the base rules (too few words, too many words in repeated windows), or if one of its
    measures lies beyond the fence of its language and source (see :data:`MEASURES`). The quantiles come from the sketches of all
    documents that pass the base rules, each group's blended with its parent's by counts. Null and empty texts fail the base
    rules. A null language or source is a group of its own; repeated rows are judged and counted each.
    """
    extra = [c for c in documents.columns if c not in (text, *STATISTICS, "n_lines", "base_failed", "kept")]
    stats = stored(
        text_statistics(documents.select(*extra, text), text).drop(text).withColumn("base_failed", base_failed()), "quality"
    )
    limits = adaptive_thresholds(stats, lang, source)
    within = F.lit(True)
    for m, (form, kind, _) in MEASURES.items():
        within = within & F.coalesce(F.expr(form) <= F.col(f"hi_{m}"), F.lit(True))
        if kind == "both":
            within = within & F.coalesce(F.expr(form) >= F.col(f"lo_{m}"), F.lit(True))
    return stats.join(
        limits,
        stats[lang].cast("string").eqNullSafe(limits["_lang"]) & stats[source].cast("string").eqNullSafe(limits["_source"]),
        "left",
    ).select(*[stats[c] for c in stats.columns], (~F.col("base_failed") & within).alias("kept"))


@shielded
def keep_good(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``documents`` that :func:`judge_quality` keeps, with their columns unchanged. Verdicts meet their rows
    by two 64-bit hashes of the whole row; rows that repeat have equal verdicts."""
    row = [F.col(c) for c in documents.columns]
    hashes = {"_key": F.xxhash64(*row), "_check": F.xxhash64(F.lit("row"), *reversed(row))}
    keyed = documents.withColumns(hashes)
    judged = judge_quality(keyed.select(*hashes, text, lang, source), text, lang, source)
    rejected = judged.filter(~F.col("kept")).select(*hashes).distinct()
    return keyed.join(rejected, [*hashes], "left_anti").select(*documents.columns)
