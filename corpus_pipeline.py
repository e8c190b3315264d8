"""A training-data pipeline: quality, near duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs.  All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.bpe import VOCABULARY, bpe_round_trip
from newsloom.llm.mixing import curriculum_mix, first_words
from newsloom.llm.ngram_join import ngram_components
from newsloom.llm.quality import held_out, quality_scores
from newsloom.llm.substring import remove_repeats
from newsloom.session import ready


def _stage(f):
    """A stage whose docs have only doc_id, text, lang and source by these names: other columns are set aside under numbers and
    come back at the end, so none can clash with what an operator adds."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ready(spark)
        aside = {c: f"__aside{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang", "source")}
        return f(spark, docs.withColumnsRenamed(aside), sf_dir, aside)

    return run


def _back(docs: DataFrame, aside: dict[str, str], columns: list[str]) -> DataFrame:
    """The columns that came in, under their names; n_chars is counted again where the text may have changed."""
    names = {new: old for old, new in aside.items()}
    return docs.select(*columns).withColumnsRenamed(names)


def _counted(docs: DataFrame, aside: dict[str, str]) -> DataFrame:
    return docs.withColumn(aside["n_chars"], F.length("text").cast("long")) if "n_chars" in aside else docs


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str, aside: dict[str, str]) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored like others; repeated rows and rows of null id are each judged by their text; extra columns come
    back as they are; an empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return _back(quality_scores(docs, labels, held_out("doc_id", 5, 0)).filter("predicted = 1"), aside, docs.columns)


@_stage
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str, aside: dict[str, str]) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays, once.

    Rows of null id all stay; null and empty texts are near nothing and stay.  Of rows equal in id and text the one whose other columns
    come first as JSON stays; rows of one id and different texts stay or go together.  Extra columns come back as they
    are; an empty table gives an empty one.
    """
    first = ngram_components(docs).filter("doc_id = component_id").select("doc_id")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = docs.join(first.distinct(), "doc_id", "left_semi")
    if others:
        row = F.struct(*others)
        kept = kept.groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias("__row")).select("doc_id", "text", "__row.*")
    else:
        kept = kept.distinct()
    return _back(kept.unionByName(docs.filter("doc_id is null")), aside, docs.columns)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, aside: dict[str, str]) -> DataFrame:
    """Passages that repeat are cut; a text that loses nothing stays as it is, one that loses all stays as ''.

    Null texts stay null; repeated rows and rows of null id are further documents, so a repeated text of 35 words or more loses all; extra
    columns come back as they are; an empty table gives an empty one.
    """
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _back(_counted(remove_repeats(docs).withColumn("text", text), aside), aside, docs.columns)


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str, aside: dict[str, str]) -> DataFrame:
    """One row for each copy that the mix takes, in training order; a copy that is cut short has its first words.

    Documents without words (null and empty texts too) take nothing and go.  Repeated rows and rows of null id are further documents with
    plans of their own; extra columns come back as they are; an empty table gives an empty one.
    """
    whole = docs.withColumnRenamed("source", "__source").withColumn("source", F.col("__source"))
    mix = curriculum_mix(whole, carry=("text", "lang", "__source", *aside.values()), ordered=False).withColumn("c", F.explode(F.arrays_zip("words", "positions")))
    taken = mix.filter("c.words > 0").withColumnRenamed("__source", "source")
    cut = F.col("c.words") < F.col("size")
    text = F.when(cut, first_words(F.when(cut, F.col("text")), F.col("c.words"))).otherwise(F.col("text"))  # whole texts do not pass through Python
    taken = _counted(taken.withColumn("text", text), aside)
    return _back(taken.orderBy("c.positions", "doc_id", F.xxhash64("text")), aside, docs.columns)


@_stage
def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str, aside: dict[str, str]) -> DataFrame:
    """Token ids of every copy (little-endian unsigned 32-bit), their number, and whether they decode to the text.

    Returns doc_id, lang, source, n_tokens, ids and round_trip.  Null and empty texts have no ids; each repeated row and each row of null id
    gives a row; extra columns are left out; an empty table gives an empty one.
    """
    out = bpe_round_trip(docs, public_tokenizers.path(VOCABULARY))
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select("doc_id", "lang", "source", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: The classifier is trained, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; what a stage returns is kept in the shared checkpoint folder.

    An empty table of documents gives an empty result; the result's files stay until that folder is cleared, those of earlier stages go.
    """
    ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus_pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
        if i:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}_{STAGES[i - 1][0]}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return docs
