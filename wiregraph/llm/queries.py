"""The registered query of each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from . import bpe, class_lm, decontaminate, fingerprints, licenses, lines, negatives, ngram_join, quality, sharding, substrings, urls, whitening
from .common import table


def queries() -> dict:
    return {
        "op1_sharding": lambda s, d: sharding.shard_documents(table(s, d, "documents")),
        "op2_benchmark_decontamination": lambda s, d: decontaminate.report(table(s, d, "documents"), table(s, d, "benchmark")),
        "op3_suffix_array_dedup": lambda s, d: substrings.remove_repeats(table(s, d, "documents")),
        "op4_line_dedup": lambda s, d: lines.report(table(s, d, "documents")),
        "op5_bpe": lambda s, d: bpe.encode_decode(table(s, d, "documents"), bpe.default_vocabulary()),
        "op6_class_lm": lambda s, d: class_lm.score(table(s, d, "documents")),
        "op7_license_scans": lambda s, d: licenses.report(table(s, d, "documents")),
        "op8_url_filters": lambda s, d: urls.judge_pages(table(s, d, "pages")),
        "op9_ngram_jaccard_join": lambda s, d: ngram_join.report(table(s, d, "documents")),
        "op10_quality_rules": lambda s, d: quality.report(table(s, d, "documents"), table(s, d, "labels")),
        "op11_embedding_whitening": lambda s, d: whitening.whiten(table(s, d, "embeddings")),
        "op12_document_fingerprints": lambda s, d: fingerprints.report(table(s, d, "documents")),
        "op13_hard_negatives": lambda s, d: negatives.report(table(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_benchmark_decontamination": decontaminate.ORACLE, "op8_url_filters": urls.ORACLE, "op13_hard_negatives": negatives.ORACLE}
