"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, language_id, line_dedup, mixing, near_dedup, packing, secrets, spelling, substring_dedup, tiff, topk, url_filter, whitening
from .common import table


def _over(name: str, query):
    return lambda spark, sf_dir: query(spark, table(spark, sf_dir, name))


QUERIES = {
    "op1_line_dedup": _over("documents", line_dedup.query),
    "op2_substring_dedup": _over("documents", substring_dedup.query),
    "op3_url_filter": url_filter.query_of,
    "op4_near_dedup": _over("documents", near_dedup.query),
    "op5_bpe": _over("documents", bpe.query),
    "op6_topk": _over("embeddings", topk.query),
    "op7_secrets": _over("documents", secrets.query),
    "op8_tiff": _over("documents", tiff.query),
    "op9_packing": _over("documents", packing.query),
    "op10_language_id": _over("documents", language_id.query),
    "op11_whitening": _over("embeddings", whitening.query),
    "op12_spelling": _over("documents", spelling.query),
    "op13_mixing": _over("documents", mixing.query),
}

#: Without SQL: exact windows of words over all documents (2), components of links (4), and what only tokenizers,
#: files, packing or a learned model decide (5, 8, 9, 10), eigenvectors (11), pairs one edit apart over all words (12) and
#: seeded draws (13). tests/llm holds these against brute force.
SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op3_url_filter": url_filter.SQL,
    "op6_topk": topk.SQL,
    "op7_secrets": secrets.SQL,
}
