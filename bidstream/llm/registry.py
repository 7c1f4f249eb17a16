"""The operators' queries and their SQL."""

from __future__ import annotations

from bidstream.llm import clusters, filters, fingerprints, licenses, lines, mixing, neardup, packing, passages, quality, secrets, substrings, topk


def queries() -> dict:
    return {
        "op1_secrets": secrets.op1_secrets, "op2_lines": lines.op2_lines, "op3_pack": packing.op3_pack, "op4_substrings": substrings.op4_substrings,
        "op5_licenses": licenses.op5_licenses, "op6_quality": quality.op6_quality, "op7_top_k": topk.op7_top_k, "op8_mix": mixing.op8_mix,
        "op9_fingerprints": fingerprints.op9_fingerprints,
        "op10_near_duplicates": neardup.op10_near_duplicates, "op11_filters": filters.op11_filters, "op12_clusters": clusters.op12_clusters,
        "op13_passages": passages.op13_passages,
    }


def oracle_sql() -> dict:
    return {
        "op2_lines": lines.OP2_SQL, "op7_top_k": topk.OP7_SQL, "op11_filters": filters.OP11_SQL, "op12_clusters": clusters.OP12_SQL,
        "op13_passages": passages.OP13_SQL,
    }
