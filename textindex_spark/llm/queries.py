"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from . import chat, decontamination, html_extract, jaccard_join, licences, packing, quality_model, quality_rules, token_store, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_token_store": token_store.op2_token_store,
    "op3_chat": chat.op3_chat,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_licences": licences.op5_licences,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_quality": quality_model.op8_quality,
    "op9_html": html_extract.op9_html,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}
ORACLES = {
    "op7_decontamination": decontamination.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
}
