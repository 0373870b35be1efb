"""The corpus pipeline: toxicity, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a DataFrame that
is written as Parquet and reread as the next one's input. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverframe.llm.common import materialize
from silverframe.llm.decontamination import without_contaminated
from silverframe.llm.packing import pack_documents
from silverframe.llm.pii import redact
from silverframe.llm.queries import table, tokenizer
from silverframe.llm.simhash import one_per_group
from silverframe.llm.toxicity import fit, without_toxic

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold."""
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return without_toxic(docs, model, TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash fingerprints or by verified five-word similarity."""
    return one_per_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    pieces = pack_documents(docs, tokenizer("word_bpe_49k.json"), end_id=1, seq_len=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: Kernels, fingerprints and tokenizers are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
