"""The registered queries of this subpackage, and the SQL that tells their results where SQL can."""

from __future__ import annotations

from . import chat, decontaminate, hamming, html_text, licenses, lines, minhash, packing, pitman_yor, quality

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_html_text": html_text.op3_html_text,
    "op4_quality": quality.op4_quality,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_minhash_dedup": minhash.op6_minhash_dedup,
    "op7_pack": packing.op7_pack,
    "op10_lm_score": pitman_yor.op10_lm_score,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_hamming_topk": hamming.op9_hamming_topk,
}
ORACLE_SQL = {
    "op1_chat_format": chat.ORACLE,
    "op2_decontaminate": decontaminate.ORACLE,
    "op9_hamming_topk": hamming.ORACLE,
}
