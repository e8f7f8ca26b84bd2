"""Queries of the operators and of the pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tidewell.llm import chat, collocations, decontaminate, htmltext, infill, jaccard, langid, licenses, packing, quality, sharding, tokens, urls

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_ngram_jaccard": jaccard.query,
    "op3_token_counts": tokens.query,
    "op4_chat_perspectives": chat.query,
    "op5_best_fit_packing": packing.query,
    "op6_url_reputation": urls.query,
    "op7_decontamination": decontaminate.query,
    "op8_html_text": htmltext.query,
    "op9_sharding": sharding.query,
    "op10_language_id": langid.query,
    "op11_collocations": collocations.query,
    "op12_license_scan": licenses.query,
    "op13_fill_in_middle": infill.query,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_quality_rules": quality.SQL,
    "op4_chat_perspectives": chat.SQL,
    "op6_url_reputation": urls.SQL,
    "op7_decontamination": decontaminate.SQL,
    "op11_collocations": collocations.SQL,
    "op13_fill_in_middle": infill.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
