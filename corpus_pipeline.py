"""From documents to shards of a training corpus: five stages, each an operator of proselens.llm.

STAGES lists (name, function). A function takes (spark, docs, sf_dir), where docs is what its predecessor kept; all but the
last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm import decontam, jaccard, langid, mixing, shards
from proselens.llm.common import pick, written

DOCUMENTS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
LEAST_SCORE = 0.2     # cosine with the predicted language; texts of a language learned have far more
LEAST_CHARS = 200     # shorter texts have too few n-grams for a cosine to tell


def documents(docs: DataFrame) -> DataFrame:
    return pick(docs, DOCUMENTS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go, and texts that are long enough to tell and resemble none of the languages of docs."""
    d = documents(docs)
    names, prototypes = langid.train(d)
    out = langid.identify(d, names, prototypes, list(DOCUMENTS))
    keep = (F.col("lang_pred") != langid.UNKNOWN) & ((F.col("score") >= LEAST_SCORE) | (F.length("text") < LEAST_CHARS)) if names else F.col("text").rlike(r"\p{L}")
    return out.where(keep).select(*DOCUMENTS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked by 5-word shingles with Jaccard similarity of 0.8 or more stays: that with the smallest doc_id."""
    return jaccard.one_of_each(documents(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of benchmark go."""
    return decontam.contaminated(documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=list(DOCUMENTS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded without bias: none to three times."""
    return mixing.repeated(documents(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: the columns of op6."""
    return shards.shard_documents(documents(docs))


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k < len(STAGES) - 1:
            out = written(out, name)
    return out
