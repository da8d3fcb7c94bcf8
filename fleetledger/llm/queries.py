"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat_format, chat_repair, decontaminate, html_extract, language_id, lexical_search, minhash, packing, pii, quality_classifier, quality_rules, secrets, simhash

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_packing": packing.op5_packing,
    "op6_pii": pii.op6_pii,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_language_id": language_id.op8_language_id,
    "op9_simhash": simhash.op9_simhash,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_minhash": minhash.op11_minhash,
    "op12_chat_repair": chat_repair.op12_chat_repair,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
ORACLES = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op2_chat_format": chat_format.OP2_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op7_secret_scan": secrets.OP7_SQL,
    "op11_minhash": minhash.OP11_SQL,
    "op12_chat_repair": chat_repair.OP12_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
