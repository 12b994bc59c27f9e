"""Operators on documents leave columns of any name alone."""

import pytest
from pyspark.sql import functions as F

from framewell.llm import exact, lines, mixing, near_texts, quality, simhash, url_filters

NAMES = """_key _check _id _text _words _parts _features _scores _first _missing _copy _wanted lines line leaf same tokens template q
best rate_ copies_ features full first n row word bit bits length prefix norm node bands size fp component measure bin level
_lang _source _domain feature draws rule_digest suffix digest u0_ u1_ place late key check members tile hi_symbols""".split()


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")


def operators(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return {
        "lines": lines.drop_template_lines,
        "mix": lambda d: mixing.mix(d, labels),
        "rates": lambda d: mixing.mixture_rates(d, labels),
        "quality": quality.keep_good,
        "judged": quality.judge_quality,
        "near": near_texts.keep_first,
        "simhash": simhash.keep_first,
        "exact": exact.keep_first,
        "urls": lambda d: url_filters.judge_urls(
            d.withColumn("url", F.concat(F.lit("http://a.example.org/es/"), "doc_id")),
            spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/1", "block")], "host string, path string, verdict string"),
        ),
    }


@pytest.mark.parametrize("name", ["lines", "mix", "rates", "quality", "judged", "near", "simhash", "exact", "urls"])
def test_columns_that_share_inner_names_stay(spark, sf_dir, name):
    run, docs = operators(spark, sf_dir)[name], documents(spark, sf_dir)
    more = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])
    plain, found = run(docs), run(more)
    assert set(found.columns) == set(plain.columns) | set(NAMES)
    rows = found.collect()
    assert all(r[n] == f"own {n}" for r in rows for n in NAMES)
    shown = [c for c in plain.columns]
    assert sorted(str([r[c] for c in shown]) for r in rows) == sorted(str([r[c] for c in shown]) for r in plain.collect())


def test_columns_with_added_names_are_replaced(spark, sf_dir):
    docs = documents(spark, sf_dir).limit(50).withColumns({"n_lines": F.lit("x"), "n_dropped": F.lit("y")})
    found = lines.drop_template_lines(docs)
    assert sorted(found.columns) == sorted(docs.columns) and dict(found.dtypes)["n_lines"] == "bigint"
