import itertools

import pytest
from pyspark.sql import functions as F

from tallyworks.functions import fields as X
from tallyworks.schema import RANKS, SOURCES


def lit_field(value, source, confidence=None):
    return X.make_field(F.lit(value).cast("string"), source, confidence)


def first(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_base_confidence_and_labels(spark):
    for source, (confidence, label) in SOURCES.items():
        r = first(spark, f=lit_field("x", source), l=X.source_label(F.lit(source)))
        assert r["f"]["confidence"] == pytest.approx(confidence) and r["l"] == label
    r = first(spark, f=lit_field(None, "xml"))
    assert r["f"].asDict() == {"value": None, "confidence": 0.0, "source": "missing"}


def test_merge_against_its_rule(spark):
    readings = [(v, s, c) for v in (None, "a") for s in SOURCES if s != "missing" for c in (0.5, 0.9)]
    rows = [(a, b) for a, b in itertools.product(readings, readings)]
    df = spark.createDataFrame([(k, *a, *[x + "2" if isinstance(x, str) and x == "a" else x for x in b]) for k, (a, b) in enumerate(rows)], "k int, v string, s string, c double, w string, t string, d double")
    merged = X.merge_from(X.make_field(F.col("v"), F.col("s"), F.col("c")), X.make_field(F.col("w"), F.col("t"), F.col("d")))
    for r in df.select("*", merged.alias("m")).collect():
        if r["w"] is None:
            want = r["v"]
        elif r["v"] is None:
            want = r["w"]
        else:
            want = r["w"] if (RANKS[r["t"]], r["d"]) > (RANKS[r["s"]], r["c"]) else r["v"]
        assert r["m"]["value"] == want


def test_fold_and_aggregate_agree(spark):
    readings = [("a", "vision", 0.9), (None, "manual", None), ("b", "xml", 0.7), ("c", "xml", 0.7), ("d", "qrCode", 1.0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(readings)], "k int, v string, s string, c double")
    f = X.make_field(F.col("v"), F.col("s"), F.coalesce("c", F.lit(1.0)))
    assert df.agg(X.merge_agg(f, F.col("k")).alias("m")).first()["m"]["value"] == "b"
    assert first(spark, m=X.merge_all(*[lit_field(v, s, c or 1.0) for v, s, c in readings]))["m"]["value"] == "b"
    assert df.where("v is null").agg(X.merge_agg(f, F.col("k")).alias("m")).first()["m"] is None


def test_trust(spark):
    r = first(
        spark, ok=X.trust(lit_field("x", "pdfText")), review=X.trust(lit_field("x", "vision")), none=X.trust(lit_field(None, "xml")),
        label=X.trust_label(lit_field("x", "vision")), needs=X.needs_review(lit_field("x", "pdfText")),
    )
    assert (r["ok"], r["review"], r["none"], r["label"], r["needs"]) == ("ok", "review", "missing", "待复核", False)


def test_invoice_predicates(spark):
    names = {"number": "xml", "issued_on": "pdfText", "seller_name": "vision", "total": "vision"}
    df = spark.range(1).select(*[lit_field("x", s).alias(n) for n, s in names.items()])
    r = df.select(X.fields_needing_review().alias("f"), X.min_key_confidence().alias("m"), X.is_complete().alias("c")).first()
    assert r["f"] == ["销售方名称", "价税合计"] and r["m"] == pytest.approx(0.75) and not r["c"]
    sure = df.withColumn("total", lit_field("x", "qrCode"))
    assert sure.select(X.is_complete().alias("c")).first()["c"]
    assert not sure.withColumn("seller_name", X.empty_field()).select(X.is_complete().alias("c")).first()["c"]
    assert first(spark, f=X.manual_field(F.lit("z")))["f"]["source"] == "manual"
