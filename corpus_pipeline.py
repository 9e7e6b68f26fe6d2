"""From raw documents to token counts: quality rules, line dedup, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, which
may have any names besides doc_id, text and lang. Texts of any length are read whole, and an empty table passes through
empty. Rows with null or empty text fall at the first stage (fewer than ten words).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wiregraph.llm import bpe, decontaminate, lines, ngram_join, quality
from wiregraph.llm.common import durable, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules keep.

    Repeated rows are judged each and alike; nulls in other columns do not matter, a null language is a stratum of its own.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template recurs, but in the first document that has it.

    The first is the least id; rows repeated with it keep the line too, and so do null ids if there is no other.
    """
    return lines.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least id, of equal ones by the hash of the text; null ids come last.

    Rows alike in id and text are copies: one stays.
    """
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; repeated rows stay or go together, null items hit nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded text, a row for each row; a null doc_id stays null."""
    return bpe.encode_decode(docs, bpe.default_vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL expresses neither the certified cutoffs nor the tokenizer; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
