"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's docs; all but
the last return the columns of documents. ``docs`` may hold nulls in any column; each stage's operator says what it does with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import minhash, mixing, pieces, private, quality
from quantloom.llm.common import documents, fresh, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go. A null or empty text has no words, and goes; repeated rows stay or go together; other columns are not read."""
    return quality.quality_rules(docs).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, of the least id; repeated rows are such a group. A row without id stays if its group has no
    row with one. A row without words is in no group."""
    return minhash.deduplicated(docs)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows. A null text stays null; all rows stay, each by itself."""
    # columns of docs that have the names of what is found are kept beside it
    own, text = {c: fresh(docs, f"_own_{k}") for k, c in enumerate(docs.columns)}, fresh(docs, "_text")
    df = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias(text), *(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    found = private.find_private(df, text)
    changed = F.col("spans") != ""
    now = {
        "text": F.when(F.col(own["text"]).isNull(), F.lit(None).cast("string")).otherwise(F.col("redacted")),
        "n_chars": F.when(changed, F.length("redacted").cast("long")).otherwise(F.col(own.get("n_chars", own["text"]))),
    }
    return found.select(*(now.get(c, F.col(n)).alias(c) for c, n in own.items()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have their target weights. A null source or language is one more value; a null text has no
    tokens; rows of one id and cell stay or go together, and all rows without id of a cell."""
    return mixing.mix(docs, exact=True).filter("kept").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, ids): every document's pieces. A null or empty text has none; all rows stay."""
    df = pieces.encode(docs.select("doc_id", "lang", "source", "text"))
    return pieces.ids_array(df.select("doc_id", "lang", "source", "n_pieces", "ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("private_data", redact_private),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The random field and the encoder are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's output in the shared folder."""
    docs = documents(spark, sf_dir)
    to = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{to}/{k}-{name}")
        docs = spark.read.parquet(f"{to}/{k}-{name}")
    return docs
