"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
The first four return the columns of documents; the last one returns the pieces of
packed sequences.  Empty tables, null texts and null ids pass through every stage
without failing: a null text is dropped by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import exact_dedup, language, near_copies, packing, secret_ledger
from riskframe.llm.queries import new_ledger
from riskframe.operators.ordered import materialize

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A code this long per byte says no more than the byte itself.
NO_LANGUAGE_BITS = 8.0

#: Near copies: words in a shingle and their similarity.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, ``lang`` being set to it.  Texts without a
    letter go, and those that no language's model codes in fewer bits than they have."""
    trees = language.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = language.identify(docs, trees, carried=DOCUMENTS)
    kept = found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("bits_per_byte") < NO_LANGUAGE_BITS))
    return kept.withColumn("lang", F.col("lang_pred")).select(*DOCUMENTS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    dropped = exact_dedup.exact_copies(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash fingerprints link them by the
    operator's Gray-order index, minima of their shingles' hashes bring more pairs together,
    SimHash fingerprints narrow these, and the shingles verify all."""
    found = near_copies.near_copies(docs, SIMILARITY, SHINGLE_WORDS)
    dropped = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets replaced by a mark."""
    found = secret_ledger.update(docs, new_ledger(spark))
    out = docs.select(*DOCUMENTS).withColumn("blob", secret_ledger.address()).join(found, "blob", "left")
    hit = F.col("found").isNotNull()
    text = F.when(hit, secret_ledger.redact(F.col("text"), F.col("found"))).otherwise(F.col("text"))
    out = out.withColumn("text", text).withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*DOCUMENTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", keep_languages),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

#: Models and tokenizers can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else materialize(docs)
    return docs
