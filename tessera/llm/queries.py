"""Queries of this subpackage and the SQL that states the same results, where SQL can."""

from __future__ import annotations

from . import fingerprint, htmltext, langid, linededup, mixing, packing, pivots, repair, rindex, setsketch, toxicity, warc, whitening

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_fingerprints": fingerprint.op2_fingerprints,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_language_id": langid.op4_language_id,
    "op5_mixing": mixing.op5_mixing,
    "op6_embedding_dedup": pivots.op6_embedding_dedup,
    "op7_line_dedup": linededup.op7_line_dedup,
    "op8_near_dedup": setsketch.op8_near_dedup,
    "op10_suffix_dedup": rindex.op10_suffix_dedup,
    "op9_html_extraction": htmltext.op9_html_extraction,
    "op11_warc": warc.op11_warc,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES = {
    "op6_embedding_dedup": pivots.ORACLE_SQL,
    "op7_line_dedup": linededup.ORACLE_SQL,
    "op8_near_dedup": setsketch.ORACLE_SQL,
    "op11_warc": warc.ORACLE_SQL,
    "op12_conversation_repair": repair.ORACLE_SQL,
}
