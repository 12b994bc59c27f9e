"""Mixing sources to target weights by soft membership: domain posteriors, then document rates by projected gradient."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.llm.tables import shielded, stored

#: Domains with the condition on the labelled table; the first that holds names a document's domain.
DOMAINS = {"good": "quality = 1 and toxic = 0", "low": "quality = 0 and toxic = 0", "toxic": "toxic = 1"}
#: Share of a domain's expected tokens that the mixture aims at.
SHARES = {"good": 1.0, "low": 0.25, "toxic": 0.25}
#: Labelled documents that the classifier is fitted on at most: those with the smallest hashes of their doc_id.
SAMPLE = 20_000
#: Features that speak for a domain at most, the most significant ones.
FEATURES = 64
#: A feature speaks for a domain if its share of the domain's documents is higher than that of all others by so many
#: standard errors and so many times, and if it stands in so many of the domain's labelled documents.
SIGNIFICANT, TIMES, SUPPORT = 4.0, 4.0, 10
#: Posteriors are whole numbers of this many parts.
PARTS = 100
#: Weight of the rates' distance from one beside the squared gaps: of all rates that leave the same gaps, the nearest to one are
#: taken, and a target that can be met is met but for about this part of its tokens.
RIDGE = 1e-6
#: Steps end at a stationary point: no condition is violated by more than this part of a domain's tokens.
TOLERANCE = 1e-10
#: Steps, beyond which an error is raised; a handful is usual.
MAX_STEPS = 200
#: A gap of more than this part of a domain's tokens is reported.
MET = 1e-4


def plain_words(text: Column) -> Column:
    """Lower-case words without punctuation."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s.,;:!?\"'()]+"), "")


def with_features(documents: DataFrame, text: str) -> DataFrame:
    """The other columns of ``documents`` with ``n_tokens`` (words) and ``_features``: the distinct words, and three
    measures of the text (symbols, distinct words and length) as words that no text holds."""
    keep = [c for c in documents.columns if c not in (text, "n_tokens", "_features")]
    full = F.coalesce(F.col(text), F.lit(""))
    split = documents.select(
        *keep, plain_words(F.col(text)).alias("_words"), F.regexp_count(full, F.lit("[#*$%&|<>]")).alias("_symbols")
    )
    n = F.size("_words")
    distinct = split.select(*keep, n.cast("long").alias("n_tokens"), "_symbols", F.array_distinct("_words").alias("_words"))
    share = F.greatest(F.col("n_tokens"), F.lit(1))
    measures = F.array(
        F.concat(F.lit("\n symbols "), F.least(F.lit(20), F.floor(10 * F.col("_symbols") / share)).cast("string")),
        F.concat(F.lit("\n distinct "), F.floor(10 * F.size("_words") / share).cast("string")),
        F.concat(F.lit("\n length "), F.length(F.bin("n_tokens")).cast("string")),
    )
    return distinct.select(*keep, "n_tokens", F.concat("_words", measures).alias("_features"))


class Classifier:
    """Naive Bayes over the presence and absence of a few telling features; ``base`` has the scores of a text without any
    of them, ``weights`` what each one adds, by domain."""

    def __init__(self, base: list[float], weights: dict[str, list[float]]) -> None:
        self.base, self.weights = base, weights

    def scores(self, features: Column) -> Column:
        words = sorted(self.weights)
        if not words:
            return F.array(*[F.lit(b) for b in self.base])
        listed = F.array(*[F.lit(w) for w in words])
        found = F.transform(F.array_intersect(features, listed), lambda w: F.array_position(listed, w).cast("int") - 1)

        def score(d: int) -> Column:
            table = F.array(*[F.lit(self.weights[w][d]) for w in words])
            return F.aggregate(found, F.lit(self.base[d]), lambda total, i: total + F.get(table, i))

        return F.array(*[score(d) for d in range(len(self.base))])


def fit_classifier(documents: DataFrame, labels: DataFrame, domains: dict[str, str], doc_id: str, text: str) -> Classifier:
    """Fit on at most :data:`SAMPLE` labelled documents.

    The first domain is what a document is without features that speak for another one. Those are few and strong, so that
    families of copies and long texts do not add up to an opinion. The driver gets at most :data:`FEATURES` features of
    each domain. Without labelled documents all domains are equally likely. Of several labels of a document the first by
    domain order counts.
    """
    k = len(domains)
    number = F.coalesce(*[F.when(F.expr(rule), F.lit(d)) for d, rule in enumerate(domains.values())])
    known = labels.select(F.col(doc_id).alias("_id"), number.alias("_domain")).filter("_id is not null and _domain is not null")
    sample = known.groupBy("_id").agg(F.min("_domain").alias("_domain")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    chosen = documents.select(F.col(doc_id).alias("_id"), text).join(F.broadcast(sample), "_id")
    # outer, since a plain explode would test the size of all features of all documents below the join
    rows = with_features(chosen, text).select("_domain", F.explode_outer("_features").alias("feature"))
    held = [F.count(F.when(F.col("_domain") == d, 1)).alias(f"n{d}") for d in range(k)]
    counts = stored(rows.groupBy("feature").agg(*held), "features")
    # each text has one measure of length, so these count the documents
    measured = counts.filter(F.col("feature").startswith("\n length "))
    sizes = list(measured.agg(*[F.coalesce(F.sum(f"n{d}"), F.lit(0)) for d in range(k)]).first())
    total = sum(sizes)
    base = [math.log((n + 1) / (total + k)) for n in sizes]
    weights: dict[str, list[float]] = {}
    everywhere = sum(F.col(f"n{d}") for d in range(k))
    for d in range(1, k):
        inside, outside = sizes[d] + 1, total - sizes[d] + 1
        n = F.col(f"n{d}")
        p, q, pooled = (n + 0.5) / inside, (everywhere - n + 0.5) / outside, (everywhere + 1) / (total + 2)
        z = (p - q) / F.sqrt(pooled * (1 - pooled) * (1 / inside + 1 / outside))
        scored = counts.filter(n >= SUPPORT).select("feature", p.alias("p"), q.alias("q"), z.alias("z"))
        telling = scored.filter((F.col("z") > SIGNIFICANT) & (F.col("p") > TIMES * F.col("q")))
        for r in telling.orderBy(F.col("z").desc(), "feature").limit(FEATURES).collect():
            absent = math.log((1 - r["p"]) / (1 - r["q"]))
            base[d] += absent
            weights.setdefault(r["feature"], [0.0] * k)[d] = math.log(r["p"] / r["q"]) - absent
    return Classifier(base, weights)


def with_posteriors(featured: DataFrame, classifier: Classifier) -> DataFrame:
    """``featured`` without its features, with ``q``: the posteriors in whole parts of :data:`PARTS`, which the most likely
    domain (of equally likely ones the first) fills up to their sum."""
    scored = featured.withColumn("_scores", classifier.scores(F.col("_features"))).drop("_features")
    top = F.array_max("_scores")
    scaled = scored.withColumn("_scores", F.transform("_scores", lambda s: F.exp(s - top)))
    total = F.aggregate("_scores", F.lit(0.0), lambda a, x: a + x)
    parts = scaled.withColumn("q", F.transform("_scores", lambda s: F.floor(PARTS * s / total).cast("int")))
    first = F.array_position("_scores", F.array_max("_scores")) - 1
    missing = PARTS - F.aggregate("q", F.lit(0), lambda a, x: a + x)
    filled = F.transform("q", lambda x, i: F.when(i == F.col("_first"), x + F.col("_missing")).otherwise(x))
    return (
        parts.withColumns({"_first": first, "_missing": missing})
        .withColumn("q", filled)
        .drop("_scores", "_first", "_missing")
    )


def rate(q: Column, pull: list[float]) -> Column:
    """The rate of a document of posteriors ``q``: one less the ``pull`` of its domains, at least zero."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum(F.get(q, F.lit(d)) / PARTS * F.lit(v) for d, v in enumerate(pull)))


def fit_rates(posteriors: DataFrame, shares: list[float]) -> tuple[list[float], list[float]]:
    """The pull of each domain that :func:`rate` takes, and the gap that each domain is left with, relative to its tokens.

    Projected gradient descent on the squared gaps between expected tokens and targets, each domain's relative to its tokens.
    A gradient step moves a rate by the gaps of its domains, so all steps from one add up to a pull for each domain, and
    projection cuts the rates at zero. Steps are scaled by the curvature over the documents whose rate is above zero and
    halved until they descend. They end at a stationary point of this convex problem, which is its least-squares answer.

    Documents of equal posteriors have equal rates, so tokens are summed by posteriors first; that table has at most as many
    rows as there are ways to part :data:`PARTS`. A step is an aggregation over it, and the driver sees a few sums for each
    pair of domains. Domains without tokens have no pull and no gap.
    """
    cells = stored(posteriors.groupBy("q").agg(F.sum("n_tokens").alias("tokens")), "cells")
    k = len(shares)
    p, tokens = [F.get("q", F.lit(d)) / PARTS for d in range(k)], F.col("tokens")
    base = np.array([x or 0.0 for x in cells.agg(*[F.sum(tokens * x) for x in p]).first()])
    some, target = base > 0, np.array(shares) * base
    safe = np.where(some, base, 1.0)

    def state(pull: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Height of the dual function (half the tokens times squared rates, plus the targets' pull), its slope and its
        curvature, and the gaps."""
        r = rate(F.col("q"), pull.tolist())
        above = F.when(r > 0, tokens).otherwise(0)
        pairs = [(d, e) for d in range(k) for e in range(d, k)]
        sums = cells.agg(
            F.sum(tokens * r * r), *[F.sum(tokens * x * r) for x in p], *[F.sum(above * p[d] * p[e]) for d, e in pairs]
        ).first()
        sums = [x or 0.0 for x in sums]
        expected, curve = np.array(sums[1 : k + 1]), np.diag(np.where(some, RIDGE * base, 1.0))
        for (d, e), x in zip(pairs, sums[k + 1 :], strict=True):
            curve[d, e] += x
            if d != e:
                curve[e, d] += x
        height = sums[0] / 2 + target @ pull + RIDGE / 2 * base @ (pull * pull)
        return height, target - expected + RIDGE * base * pull, curve, (expected - target) / safe

    pull = np.zeros(k)
    height, slope, curve, gaps = state(pull)
    for _ in range(MAX_STEPS):
        if np.abs(slope / safe).max() < TOLERANCE:
            return pull.tolist(), gaps.tolist()
        step, length = -np.linalg.solve(curve, slope), 1.0
        while True:
            found = state(pull + length * step)
            if found[0] <= height + 1e-4 * length * (slope @ step) + 1e-13 * abs(height) or length < 1e-6:
                break
            length /= 2
        pull = pull + length * step
        height, slope, curve, gaps = found
    raise RuntimeError(f"no stationary rates after {MAX_STEPS} steps, gaps {gaps.tolist()}")


@shielded
def mixture_rates(
    documents: DataFrame,
    labels: DataFrame,
    domains: dict[str, str] = DOMAINS,
    shares: dict[str, float] = SHARES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The other columns of ``documents`` with ``n_tokens``, ``p_<domain>``, ``rate`` and ``copies``.

    A classifier fitted on the labelled documents gives each document posteriors over the domains. The rates are at least
    zero and such that each domain's expected tokens (tokens times posterior times rate, summed) match its target: its
    share of the domain's expected tokens in the input; of all such rates they are the nearest to one. Where no rates meet the
    targets, the squared gaps are least and a warning names each gap. ``copies`` is how often the document is drawn: the whole part of
    the rate, and one more if a hash of the doc_id lies below the rest, so a run repeats itself. Null and empty texts have
    no tokens and a posterior from the prior and their measures. A null doc_id has a fixed hash. Repeated rows are drawn
    alike. An empty table has no rows.
    """
    classifier = fit_classifier(documents, labels, domains, doc_id, text)
    scored = stored(with_posteriors(with_features(documents, text), classifier), "posteriors")
    pull, gaps = fit_rates(scored, [shares[d] for d in domains])
    for name, gap in zip(domains, gaps, strict=True):
        if abs(gap) > MET:
            warnings.warn(f"target of domain {name} not met: {gap:+.4f} of its tokens", stacklevel=2)
    rated = scored.withColumn("rate", rate(F.col("q"), pull))
    luck = F.pmod(F.xxhash64(F.lit("draw"), F.col(doc_id)), F.lit(1 << 20)) / (1 << 20)
    copies = F.floor("rate") + F.when(luck < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    keep = [c for c in documents.columns if c != text]
    shown = [(F.get("q", F.lit(d)) / PARTS).alias(f"p_{name}") for d, name in enumerate(domains)]
    return rated.select(*keep, "n_tokens", *shown, "rate", copies.cast("long").alias("copies"))


@shielded
def mix(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with each row as often as :func:`mixture_rates` draws it. Draws meet their rows by two 64-bit hashes
    of the whole row."""
    row = [F.col(c) for c in documents.columns]
    keyed = documents.withColumns({"_key": F.xxhash64(*row), "_check": F.xxhash64(F.lit("row"), *reversed(row))})
    drawn = mixture_rates(keyed.select(doc_id, "_key", "_check", text), labels, doc_id=doc_id, text=text)
    other = stored(drawn.filter("copies <> 1").select("_key", "_check", "copies").distinct(), "draws")
    found = keyed.join(other, ["_key", "_check"], "left")
    times = F.expr("array_repeat(0, cast(coalesce(copies, 1) as int))")
    return found.select(*documents.columns, F.explode(times).alias("_copy")).drop("_copy")
