"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidebook.llm import codebooks, fingerprints, jaccard, language, lines, mixing, neighbours, pieces, quality, repair, repeats, secret_scan, warc

QUERIES = {
    "op1_neighbours": neighbours.op1_neighbours,
    "op2_pieces": pieces.op2_pieces,
    "op3_jaccard": jaccard.op3_jaccard,
    "op4_secrets": secret_scan.op4_secrets,
    "op5_mixing": mixing.op5_mixing,
    "op6_warc": warc.op6_warc,
    "op7_quality": quality.op7_quality,
    "op8_language": language.op8_language,
    "op9_lines": lines.op9_lines,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_repeats": repeats.op11_repeats,
    "op12_repair": repair.op12_repair,
    "op13_codebooks": codebooks.op13_codebooks,
}

ORACLES = {**mixing.ORACLE, **warc.ORACLE, **repeats.ORACLE, **repair.ORACLE, **codebooks.ORACLE}
