"""Queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, fingerprints, html_blocks, lattice, line_crf, line_quality, minhash, packing, piece_bpe, substring_dedup, toxicity, url_filters, whitening

QUERIES = {
    "op1_line_quality": line_quality.op1_line_quality,
    "op2_piece_bpe": piece_bpe.op2_piece_bpe,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_html_blocks": html_blocks.op5_html_blocks,
    "op6_packing": packing.op6_packing,
    "op7_line_crf": line_crf.op7_line_crf,
    "op8_minhash": minhash.op8_minhash,
    "op9_url_filters": url_filters.op9_url_filters,
    "op10_lattice": lattice.op10_lattice,
    "op11_fingerprints": fingerprints.op11_fingerprints,
    "op12_alignment": alignment.op12_alignment,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES = {
    "op1_line_quality": line_quality.SQL,
    "op3_substring_dedup": substring_dedup.SQL,
    "op8_minhash": minhash.SQL,
    "op9_url_filters": url_filters.SQL,
    "op10_lattice": lattice.SQL,
    "op11_fingerprints": fingerprints.SQL,
}
