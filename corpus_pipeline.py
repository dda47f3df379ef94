"""From raw documents to training tokens, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.llm._tables import table
from tonegrid.llm.anchors import drop_repeated_windows
from tonegrid.llm.decontaminate import decontaminate
from tonegrid.llm.pieces import encode_pieces
from tonegrid.llm.quality import fit_quality, score_quality
from tonegrid.llm.queries import public_tokenizer
from tonegrid.llm.shingles import keep_first_of_near
from tonegrid.operators.lineage import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of an Arrow batch, for texts of some kilobytes; the session's own value counts if it is smaller.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A document is rejected when it is more likely bad than good.
REJECT_UNDER = 0.5


def _small_batches(spark: SparkSession) -> None:
    """Bounds what the JVM and a Python worker hold of a batch of texts at a time, from now on in this session."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; it learns from all labels.

    Null and empty texts get the score of a text without words, and go if that is too low. Rows are judged one by one,
    so repeated rows and rows without an id share the fate of their text. Labels that are null or of no document teach
    nothing; without two kinds of labels all texts have one score. Further columns of ``docs`` are dropped.
    """
    _small_batches(spark)
    model = fit_quality(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return score_quality(docs, model, COLUMNS, REJECT_UNDER).where("predicted = 1").select(COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their five-word shingles, the one with the smallest id stays.

    SimHash fingerprints propose links by pigeonring filtering, a prefix join those that fingerprints can't promise, and
    the sets decide. Null, empty and blank texts are alike. Rows without an id stay, and link nothing; rows that repeat
    an id stay or go together. Further columns of ``docs`` are dropped.
    """
    _small_batches(spark)
    return keep_first_of_near(docs, COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words in windows of 13 that start in an earlier document too; n_chars follows a text that lost some.

    Lines stay lines; a text may become empty and its row stays. Null texts stay null. A null id counts as the last
    document; rows of one id are one document, so copies of a row lose nothing to each other. Further columns of
    ``docs`` are dropped.
    """
    _small_batches(spark)
    left = drop_repeated_windows(docs, COLUMNS)
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which a twentieth or more of the words stand in windows of benchmark items.

    Null and empty texts, and all texts where the benchmark is empty, stay. Rows are judged one by one, repeated rows
    and rows without an id too. Further columns of ``docs`` are dropped.
    """
    _small_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), COLUMNS).where("not contaminated").select(COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, n_tokens, digests of the ids (with begin and end) and of the text they decode to, and piece_ids.

    Null and empty texts are begin and end alone. Rows are encoded one by one, repeated rows and rows without an id too.
    """
    _small_batches(spark)
    return encode_pieces(docs, public_tokenizer("piece_bpe_32k.model"), ["doc_id"], decoded=False)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", to_pieces),
]

#: SQL cannot express a trained network or SentencePiece.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; each result is cut from its lineage, as later stages read it
    more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
