"""Corpus pipeline: the training-data operators one after the other, over whole documents.

Every stage works on what the one before it kept. All but the last return the
columns of documents; the last returns the places of token pieces in sequences.

Defined results, in every stage: an empty table gives no rows; a further column
stays, but one with the name of a stage's own result is replaced by it; null
metadata is a value of its own, a null id counts as any other.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltide.llm import cotraining, language, minhash, packing, suffix_array
from voltide.llm.common import materialize, table
from voltide.llm.queries import tokenizer_file

# a language other than the stated one is believed from this posterior upwards
SURE = 0.99


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for good.

    Null and empty texts are judged by their metadata and as text without words;
    repeated rows are judged alike; without labels of both kinds all stay or go.
    """
    model = cotraining.train(docs, table(spark, sf_dir, "labels"))
    return cotraining.classify(docs, model).where("kept").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, and not surely in another one than they state.

    Null, empty and letterless texts go; without a stated language any will do;
    of languages that score the same the first by name is found.
    """
    pieces = language.piece_table(tokenizer_file("piece_bpe_32k.model"))
    found = language.predict(docs, language.train(docs, pieces), pieces)
    other = (F.col("lang_pred") != F.col("lang")) & (F.col("score") >= SURE)
    return found.where((F.col("lang_pred") != "und") & ~F.coalesce(other, F.lit(False))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies: the smallest id; of repeated rows one.

    Null counts as the empty text.
    """
    return minhash.near_duplicates(docs, floor=0.0).where("is_first").dropDuplicates(["class_text"]).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document, or an earlier place, holds.

    Earlier is by id; of repeated rows the first keeps its text. Characters of
    which a part was removed go as a whole, as do replacement characters in such
    texts. A text may become empty; null stays null.
    """
    done = suffix_array.remove_repeats(docs, keep="first")
    kept = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", "")
    cut = F.col("n_removed") > 0
    done = done.withColumn("text", F.when(cut, kept).otherwise(F.col("text")))
    return done.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences; null counts as the empty text, which is the end token alone."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), encode_special_tokens=False)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]
# the stages learn, sample hashes and tokenize: no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what passes between them is stored below the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
