"""A corpus made ready for training: five stages, each an operator of `bindery.llm`.

Every stage takes `(spark, docs, sf_dir)` and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last return the
columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm import language, lines, packing, secretscan, vptrees
from bindery.llm.common import documents, free_name, quoted
from bindery.scratch import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those in which no language outweighs the rest.

    A null or empty text goes; repeated rows are judged alike; languages that tie leave
    none over half. Texts, however long, are read whole. An empty table stays empty.
    """
    model = language.fit_languages(docs.where(~F.coalesce(language.held_out(), F.lit(False))))
    names = tuple(free_name(name, docs.columns) for name in ("lang_pred", "score", "ambiguous"))
    rows = language.predict_languages(docs, model, names=names)
    kept = (F.col(names[0]) != language.UNKNOWN) & (F.col(names[1]) > 0.5)
    return rows.where(kept).select(*quoted(docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that occurred before, and documents of which none is left.

    Null, empty and blank texts go. Repeated rows lose the same lines; of equal lines the
    first by identifier stays, null identifiers last. An empty table stays empty.
    """
    rows = lines.drop_repeated_lines(docs)
    return rows.where(F.length(F.btrim(F.col("text"), F.lit(" \t\n\r\x0b\x0c"))) > 0)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest identifier of each group of near duplicates.

    Near means at most 3 of 64 bits of the three-word SimHash, as in `op5_simhash_dedup`.
    That finds close copies only: most pairs that share 0.8 of their five-word shingles
    are farther apart and both stay; the README gives the measured recall.
    """
    return vptrees.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets; every document stays."""
    return secretscan.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with a checksum of their ids.

    A null or empty text is its end id; repeated rows are documents of their own, long
    texts run over several sequences. An empty table gives no pieces.
    """
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Classifiers, fingerprints and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
