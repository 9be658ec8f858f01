"""The stages of the pipeline on rows that must not break them."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

DOC = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "The harbour was quiet when we came back from the market with bread and some old books for the children"
ROWS = [
    (1, GOOD, "en", "a", 100), (1, GOOD, "en", "a", 100), (1, "Another text under the same id, which has its own words about rivers and boats", None, None, None), (2, GOOD, None, "b", None), (None, None, None, None, None), (None, "A row without an id, but with a text about gardens that nobody else has written", None, None, None), (3, "", "en", "a", 0), (4, " \n ", "en", "a", 3),
    (5, "A very long story. " + " ".join(f"word{i}" for i in range(40_000)), "en", "a", 0),
]


@pytest.fixture(scope="module")
def odd(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    return real.unionByName(spark.createDataFrame([(None if i is None else i + 10**6, *r) for i, *r in ROWS], DOC)).withColumn("score", F.lit("x")).withColumn("__score", F.lit(1)).withColumn("dropped_lines", F.lit(2)).withColumn("ids", F.lit(3)).withColumn("keepers", F.lit(4))


def mine(df):
    return sorted(((r["doc_id"] and r["doc_id"] - 10**6 if r["doc_id"] is not None else None, (r["text"] or "")[:12]) for r in df.where("doc_id is null or doc_id > 999999").collect()), key=str)


def test_quality_scores_every_row(spark, odd, sf):
    out = p.quality_stage(spark, odd, sf)
    assert out.columns == list(p.COLUMNS)
    left = mine(out)
    assert left.count((1, GOOD[:12])) == 2 and (2, GOOD[:12]) in left and (1, "Another text") in left and (None, "A row withou") in left


def test_lines_keep_one_occurrence(spark, odd, sf):
    out = p.lines_stage(spark, odd, sf)
    assert out.columns == list(p.COLUMNS)
    left = mine(out)
    # the repeated rows of (1, GOOD) are one document and keep its line; (2, GOOD) holds nothing else and goes
    assert left.count((1, GOOD[:12])) == 2 and (2, GOOD[:12]) not in left and (1, "Another text") in left
    assert (None, "") in left and (None, "A row withou") in left and (3, "") in left and (4, " \n ") in left


def test_near_duplicates_keep_one_row(spark, odd, sf):
    out = p.near_duplicates_stage(spark, odd, sf)
    assert out.columns == list(p.COLUMNS)
    left = mine(out)
    # null and wordless texts are one class, of which the real tables may hold a row
    assert left.count((1, GOOD[:12])) == 1 and (2, GOOD[:12]) not in left and (1, "Another text") in left and (None, "A row withou") in left and (5, "A very long ") in left
    assert sum(not t.strip() for _, t in left) <= 1


def test_decontamination_goes_by_text(spark, odd, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 200").orderBy("item_id").first()["text"]
    more = odd.unionByName(spark.createDataFrame([(10**6 + 1, f"before it {item} after", None, None, None)], DOC), allowMissingColumns=True)
    out = p.decontamination_stage(spark, more, sf)
    assert out.columns == list(p.COLUMNS)
    left = mine(out)
    assert (1, "before it " + item[:2]) not in left and left.count((1, GOOD[:12])) == 2 and (1, "Another text") in left and (None, "") in left


def test_tokens_of_every_row(spark, odd, sf):
    out = p.tokens_stage(spark, odd, sf)
    assert out.columns == [*p.COLUMNS, "ids", "n_tokens", "round_trip"] and out.count() == odd.count()
    for r in out.where("doc_id is null or doc_id > 999999").collect():
        assert (r["n_tokens"], r["round_trip"]) == ((None, None) if r["text"] is None else (len(r["ids"]), True))
