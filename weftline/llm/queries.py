"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from weftline.llm import decontaminate, html, langid, licences, linededup, lm, mixing, simhash, topk, toxicity

QUERIES = {
    "op1_language": langid.op1_language,
    "op2_mixing": mixing.op2_mixing,
    "op3_lm": lm.op3_lm,
    "op4_simhash": simhash.op4_simhash,
    "op5_html": html.op5_html,
    "op6_licences": licences.op6_licences,
    "op7_lines": linededup.op7_lines,
    "op8_topk": topk.op8_topk,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_decontamination": decontaminate.op10_decontamination,
}

ORACLES = {
    "op2_mixing": mixing.ORACLE,
    "op7_lines": linededup.ORACLE,
    "op8_topk": topk.ORACLE,
}
