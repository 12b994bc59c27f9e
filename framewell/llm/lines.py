"""Line dedup by a log-template tree: lines whose template recurs across documents are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewell.llm.tables import freed, shielded, shuffles_removed, stored, words

#: Leading tokens that lead to a leaf of the tree, after the number of tokens.
DEPTH = 3
#: Lines that a leaf must hold; documents in which a token must stand at a place of a leaf to be constant there, and in which a
#: template must stand to be dropped.
MIN_DOCS = 10
#: Lines of so many words on are passages: they recur if documents of two different texts hold them word by word.
PASSAGE = 50
#: Percent of a line's tokens that must be constant.
CONSTANT_PERCENT = 60
FIELD = "<*>"
#: Tokens that a task lays out at once; a leaf whose lines have more than the second number is dealt by token, not as a whole.
TASK_TOKENS, LEAF_TOKENS = 1 << 20, 1 << 16


def row_keys(df: DataFrame) -> dict[str, Column]:
    """Two 64-bit hashes of whole rows, which tell rows apart; rows that are wholly equal share them."""
    row = [F.col(c) for c in df.columns]
    return {"_key": F.xxhash64(*row), "_check": F.xxhash64(F.lit("row"), *reversed(row))}


def masked(tokens: Column) -> Column:
    """Tokens that hold a digit are fields."""
    return F.transform(tokens, lambda w: F.when(w.rlike("[0-9]"), FIELD).otherwise(w))


def named(text: Column) -> Column:
    """16 bytes of a hash that stand for ``text``."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def leaves(keyed: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(_key, _check, doc_id, line, n, leaf, wild, same, twin, whole)`` of all lines with words.

    A leaf is named by the number of tokens and the leading ones. ``wild`` has the leaves that a line falls into when one of
    its leading tokens goes to the wildcard child of its node; lines of fewer tokens than :data:`DEPTH` have no leaf, only
    their words. ``same`` and ``twin`` are hashes of the words with their digits, ``whole`` of the document's text.
    """
    # outer, since a plain explode would also split each text in a test of its size; a null text has no words
    lines = keyed.select(
        "_key",
        "_check",
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(text)).alias("whole"),
        F.posexplode_outer(F.split(text, "\n")).alias("line", "_text"),
    )
    ids = ["_key", "_check", "doc_id", "line", "whole"]
    split = lines.select(*ids, words(F.col("_text")).alias("_words")).filter(F.size("_words") > 0)
    lead = split.withColumns({"n": F.size("_words"), "_lead": masked(F.slice("_words", 1, DEPTH))})
    deep = F.col("n") >= DEPTH

    def wild(place: int) -> Column:
        return F.xxhash64("n", F.transform("_lead", lambda w, i: F.when(i == place, FIELD).otherwise(w)))

    return lead.select(
        *ids,
        "n",
        F.when(deep, F.xxhash64("n", "_lead")).alias("leaf"),
        F.when(deep, F.array_distinct(F.array(*[wild(place) for place in range(DEPTH)]))).alias("wild"),
        F.xxhash64("n", "_words").alias("same"),
        F.xxhash64(F.lit("twin"), "_words").alias("twin"),
    )


def placed_lines(found: DataFrame, held: list[str]) -> DataFrame:
    """``(_key, _check, line, leaf)`` of the lines whose leaf holds at least :data:`MIN_DOCS` lines.

    A line whose own leaf holds fewer has a leading token that few lines hold there. It goes to the first of its wildcard
    leaves that is a leaf of other lines already or that so many of such lines share. ``held`` gets the paths of the tables
    that the result is read from, here and below.
    """
    deep = found.filter(F.col("leaf").isNotNull()).select("_key", "_check", "line", "leaf", "wild")
    own = deep.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_DOCS).select("leaf")
    busy = stored(own, "busy", held)
    rare = stored(
        deep.join(busy, "leaf", "left_anti").select("_key", "_check", "line", F.posexplode("wild").alias("way", "leaf")),
        "rare",
        held,
    )
    shared = rare.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_DOCS).select("leaf")
    nodes = stored(busy.union(shared).distinct(), "nodes", held)
    first = F.min(F.struct("way", "leaf"))["leaf"].alias("leaf")
    caught = rare.join(nodes, "leaf").groupBy("_key", "_check", "line").agg(first)
    return deep.join(busy, "leaf").select("_key", "_check", "line", "leaf").unionByName(caught)


def exact_lines(found: DataFrame, held: list[str]) -> DataFrame:
    """Lines whose words enough other lines have, digits included, as rows of :func:`line_templates`: the template of such a line
    is the line itself, at any length."""
    enough = (F.col("lines") >= MIN_DOCS) | ((F.col("n") >= PASSAGE) & (F.col("lines") > 1))
    often = found.groupBy("same", "twin").agg(F.count("*").alias("lines"), F.min("n").alias("n")).filter(enough)
    again = stored(often.select("same", "twin"), "exact_leaves", held)
    return found.join(again, ["same", "twin"]).select(
        "_key",
        "_check",
        "doc_id",
        "line",
        F.col("same").alias("leaf"),
        F.concat(F.lit("="), F.col("twin").cast("string")).cast("binary").alias("template"),
        F.when(F.col("n") >= PASSAGE, F.col("whole")).alias("whole"),
    )


def wanted_lines(placed: DataFrame) -> DataFrame:
    """``(_key, _check, _wanted)``: line numbers and leaves of the ``placed`` lines of each document."""
    return placed.groupBy("_key", "_check").agg(F.array_sort(F.collect_set(F.struct("line", "leaf"))).alias("_wanted"))


def busy_lines(keyed: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(_key, _check, doc_id, line, leaf, same, form)`` of the ``wanted`` lines; a form is the tokens with a space between.

    Leaves are found on hashes alone; only then do the numbers of the lines that matter meet the texts.
    """
    found = keyed.select("_key", "_check", F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).join(
        wanted, ["_key", "_check"]
    )
    parts = found.select("_key", "_check", "doc_id", "_wanted", F.split("_text", "\n").alias("_parts"))
    chosen = F.transform(
        "_wanted", lambda w: F.struct(w["line"], w["leaf"], F.get("_parts", w["line"]).alias("text"))
    )
    rows = parts.select("_key", "_check", "doc_id", F.explode_outer(chosen).alias("_l"))
    form = F.array_join(masked(words(F.col("_l.text"))), " ").alias("form")
    return rows.select("_key", "_check", "doc_id", "_l.line", "_l.leaf", form).withColumn("same", named(F.col("form")))


def laid_out(forms: DataFrame) -> DataFrame:
    return forms.select("leaf", "same", "docs", F.posexplode(F.split("form", " ")).alias("place", "token"))


def joined_up(placed: DataFrame, fixed: Column) -> DataFrame:
    """``(leaf, same, template)`` of the forms with enough constant tokens, templates by a hash; ``fixed`` tells the constant ones of ``placed``."""
    token = F.when(fixed, F.col("token")).otherwise(FIELD)
    return (
        placed.groupBy("leaf", "same")
        .agg(F.sort_array(F.collect_list(F.struct("place", token.alias("token")))).alias("_parts"))
        .select("leaf", "same", F.col("_parts.token").alias("_tokens"))
        .filter(100 * F.size(F.array_remove("_tokens", FIELD)) >= CONSTANT_PERCENT * F.size("_tokens"))
        .select("leaf", "same", named(F.array_join("_tokens", " ")).alias("template"))
    )


def form_templates(forms: DataFrame, held: list[str]) -> DataFrame:
    """``(leaf, same, template)`` of ``forms(leaf, same, docs, form)``.

    A leaf meets in one task, so that its forms move once, as they are, and are laid out there token by token. Only leaves of
    more than :data:`LEAF_TOKENS` tokens are laid out before the shuffles and dealt by place and token.
    """
    sizes = stored(forms.groupBy("leaf").agg(F.sum(F.size(F.split("form", " "))).alias("n")), "leaf_sizes", held)
    with shuffles_removed(forms.sparkSession):
        total = sizes.agg(F.sum("n")).first()[0] or 0
    large = F.broadcast(sizes.filter(F.col("n") > LEAF_TOKENS).select("leaf"))
    tasks = max(forms.sparkSession.sparkContext.defaultParallelism, total // TASK_TOKENS)
    placed = laid_out(forms.join(large, "leaf", "left_anti").repartition(tasks, "leaf"))
    n = F.sum("docs").over(Window.partitionBy("leaf", "place", "token"))
    whole = joined_up(placed.withColumn("n", n), (F.col("n") >= MIN_DOCS) & (F.col("token") != FIELD))
    placed = laid_out(forms.join(large, "leaf", "left_semi"))
    constant = stored(  # both sides of the join below are dealt anew, so that it can split a hot token
        placed.groupBy("leaf", "place", "token")
        .agg(F.sum("docs").alias("n"))
        .filter((F.col("n") >= MIN_DOCS) & (F.col("token") != FIELD))
        .select("leaf", "place", "token", F.lit(True).alias("fixed")),
        "constant",
        held,
    )
    cut = joined_up(placed.join(constant, ["leaf", "place", "token"], "left"), F.coalesce("fixed", F.lit(False)))
    return whole.unionByName(cut)


def line_templates(keyed: DataFrame, doc_id: str, text: str, held: list[str]) -> DataFrame:
    """``(_key, _check, doc_id, line, leaf, template, whole)`` of the lines that fit a template with enough constant tokens, and
    of those that recur word by word; a line may be in both. ``whole`` tells the texts of passages apart.

    Below a leaf, a token is constant at its place if it stands there in at least :data:`MIN_DOCS` documents, else the
    place is a field. Only lines of leaves with that many lines can hold such a token; all others end with the hashes.
    Equal lines are counted before their tokens are laid out, so a line that very many documents share is one row from
    there on. The hashes of all lines are gone before the texts move.
    """
    own: list[str] = []
    numbers: list[str] = []
    found = stored(leaves(keyed, doc_id, text), "leaves", own)
    wanted = stored(wanted_lines(placed_lines(found, own)), "wanted", numbers)
    exact = stored(exact_lines(found, own), "exact_lines", held)
    freed(keyed.sparkSession, own)
    near = stored(busy_lines(keyed, wanted, doc_id, text), "lines", held)
    freed(keyed.sparkSession, numbers)
    seen = near.select("leaf", "same", "_key", "_check").distinct().groupBy("leaf", "same").agg(F.count("*").alias("docs"))
    forms = near.groupBy("leaf", "same").agg(F.first("form").alias("form"))
    forms = stored(forms.join(seen, ["leaf", "same"]), "forms", own)
    templates = stored(form_templates(forms, own), "templates", held)
    freed(keyed.sparkSession, own)
    ids = ["_key", "_check", "doc_id", "line", "leaf", "template"]
    fitting = near.join(templates, ["leaf", "same"]).select(*ids, F.lit(None).cast("long").alias("whole"))
    return fitting.unionByName(exact)


def repeated_lines(templated: DataFrame, held: list[str]) -> DataFrame:
    """``(_key, _check, lines)``: the line numbers to drop. Of each template that at least :data:`MIN_DOCS` documents hold, and of
    each passage in two different texts, the first line of the smallest doc_id stays (nulls last, of equal ids the smaller row
    hash). The first line of a template is also the first of its copies, so one always stays."""
    first = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "_key", "_check", "line")
    by_document = templated.groupBy("leaf", "template", "_key", "_check").agg(F.min(first).alias("first"), F.max("whole").alias("whole"))
    recurring = stored(  # both sides of the join below are dealt anew, so that it can split a hot template
        by_document.groupBy("leaf", "template")
        .agg(F.count("*").alias("docs"), F.min("first").alias("first"), (F.min("whole") < F.max("whole")).alias("texts"))
        .filter((F.col("docs") >= MIN_DOCS) | F.col("texts"))
        .select("leaf", "template", "first"),
        "recurring",
        held,
    )
    dropped = templated.join(recurring, ["leaf", "template"]).filter(first > F.col("first"))
    return dropped.groupBy("_key", "_check").agg(F.collect_set("line").alias("lines"))


@shielded
def drop_template_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with ``text`` less the lines whose template recurs, and ``n_lines, n_dropped``.

    A line is the text between line feeds. Blank lines stay. A line of fewer than :data:`DEPTH` tokens or of constant digits recurs
    word by word, in :data:`MIN_DOCS` documents as any other; a passage (:data:`PASSAGE` words) in two documents whose texts differ,
    so copies of one document are left to the dedup of documents. Documents keep their rows, even if no line is left. A null
    text stays null and has no lines. Wholly equal rows count as one document and lose the same lines, so the first of them
    stays whole in each. Columns with the added names are replaced.
    """
    keyed = documents.withColumns(row_keys(documents))
    # of the tables on the way only the numbers of dropped lines are left when the texts move
    spark, held, made = documents.sparkSession, [], []
    templated = stored(line_templates(keyed, doc_id, text, held), "templated", made)
    freed(spark, held)
    dropped = stored(repeated_lines(templated, made), "dropped_lines")
    freed(spark, made)
    parts = F.split(F.col(text), "\n")
    found = keyed.join(dropped, ["_key", "_check"], "left").withColumn("_parts", F.when(F.col("lines").isNotNull(), parts))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("lines"))
    rest = F.array_join(F.transform(kept, lambda i: F.get("_parts", i)), "\n")
    whole = F.when(F.col("lines").isNull(), F.col(text)).otherwise(rest)
    n = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    return found.select(
        *[whole.alias(c) if c == text else F.col(c) for c in documents.columns],
        n.cast("long").alias("n_lines"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_dropped"),
    )
