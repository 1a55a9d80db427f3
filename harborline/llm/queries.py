"""The opN queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontam, divergence, fingerprints, html_extract, jaccard_join, langid, mixing, packing, periodic_runs, substring_dedup, toxicity, warc

QUERIES = {
    "op1_language_id": langid.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_toxicity": toxicity.query,
    "op4_decontamination": decontam.query,
    "op5_chat_formatting": chat.query,
    "op6_fingerprints": fingerprints.query,
    "op7_html_extraction": html_extract.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_packing": packing.query,
    "op10_warc": warc.query,
    "op11_source_divergence": divergence.query,
    "op12_source_mixing": mixing.query,
    "op13_periodic_runs": periodic_runs.query,
}
ORACLE_SQL = {
    "op2_substring_dedup": substring_dedup.SQL,
    "op4_decontamination": decontam.SQL,
    "op5_chat_formatting": chat.SQL,
    "op8_jaccard_join": jaccard_join.SQL,
    "op10_warc": warc.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_source_mixing": mixing.SQL,
    "op13_periodic_runs": periodic_runs.SQL,
}
