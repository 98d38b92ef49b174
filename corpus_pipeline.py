"""A corpus pipeline: raw documents to packed training sequences, a stage at a time.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next
one's docs. All but the last return the columns that they are given, whatever others there are and however they are
called. Null and empty texts have no language, so the first stage drops them; later stages take them all the same.
Repeated rows are near copies, of which one stays. Rows without doc_id stay and are never the first of their group. Ties
go to the least doc_id. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm import decontaminate, language, packing, shared, simhash, surrogates


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those rejected go. A null lang becomes the language found."""
    model = language.train(docs)

    def apply(d: DataFrame) -> DataFrame:
        found = language.identify(d, model).where("NOT rejected")
        return found.withColumn("lang", F.coalesce("lang", "lang_pred"))

    return shared.apart(docs, [f.name for f in language.ADDED], apply)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id."""
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold the benchmark's passages."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return shared.apart(docs, [f.name for f in decontaminate.RESULT], lambda d: decontaminate.scan(d, benchmark).where("NOT contaminated"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows where a text changed."""

    def apply(d: DataFrame) -> DataFrame:
        found = surrogates.anonymise(d, surrogates.session_key(spark))
        if "n_chars" in d.columns:
            changed = F.coalesce(F.size("entities") > 0, F.lit(False))
            found = found.withColumn("n_chars", F.when(changed, F.length("text").cast(d.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
        return found

    return shared.apart(docs, ["entities"], apply)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.packed(spark, docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("contamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

#: Models, hashes of shingles and tokens aren't SQL's; tests state the rows by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
