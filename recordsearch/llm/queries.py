"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from recordsearch.llm import (
    decontaminate, html, language, merkle, mixing, mtree, neardup, negatives, pieces, pii, quality, repeats, warc,
)

QUERIES = {
    "op5_repeated_passages": repeats.op5_repeated_passages,
    "op9_near_duplicates": neardup.op9_near_duplicates,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op1_quality": quality.op1_quality,
    "op10_page_text": html.op10_page_text,
    "op3_mtree_top5": mtree.op3_mtree_top5,
    "op6_capture_index": warc.op6_capture_index,
    "op4_language_id": language.op4_language_id,
    "op7_pii": pii.op7_pii,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_piece_ids": pieces.op12_piece_ids,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}
SQL = {
    "op3_mtree_top5": mtree.SQL,
    "op6_capture_index": warc.SQL,
    "op8_mix_sources": mixing.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op13_hard_negatives": negatives.SQL,
}
