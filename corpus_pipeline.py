"""From raw documents to token ids, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet into the shared folder and read again for the next one. All
but the last return the columns of `documents`.

1. quality: documents that the classifier rejects (score under 0.5) go.
2. lines: repeated lines go but for one occurrence; documents left without a
   line go; n_chars follows the text.
3. near_duplicates: one document of each group stays, the smallest id; groups
   hang together by five-word shingles of similarity 0.8 or more.
4. decontamination: documents that hold a benchmark passage go.
5. tokens: SentencePiece ids, their number, and whether decoding them gives
   the text back.

Given cases, for every stage: a table of no rows passes as one. Null, empty and
wordless texts get the classifier's prior, have no lines to lose, match no
benchmark, and have null or no ids; near_duplicates keeps one of them, as they
are one class. Very long texts are worked on whole. Rows that repeat an id with
an equal text share the outcome of stages 1, 2 and 4, and one row stays in stage
3; rows that share an id but not the text are judged each by its own text. Ties
go to the smallest (doc_id, text hash), null ids last (stage 2: first). Columns
beside those of `documents` are dropped at the start of a stage, so their names
can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import decontaminate, line_dedup, quality, sentencepiece_scan, simhash_dedup
from tracemill.session import discard, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.trained(docs, table(spark, sf_dir, "labels"))
    return quality.scores(docs.select(*COLUMNS), model, into="__score").where("__score >= 0.5").select(*COLUMNS)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(docs.select(*COLUMNS))
    changed = F.col("dropped_lines") > 0
    return kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_first(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = sentencepiece_scan.encode(docs.select(*COLUMNS), decoded="decoded")
    return done.withColumn("n_tokens", F.when(F.col("ids").isNotNull(), F.size("ids"))).withColumn("round_trip", F.col("decoded") == F.col("text")).drop("decoded")


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("tokens", tokens_stage),
]

#: No stage can be written as SQL (trained vectors, 64-bit hashes of the engine, trained vocabularies); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)  # what the stage before stored
        docs = done
    return docs
