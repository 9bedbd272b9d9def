"""The subpackage's queries and the SQL that checks them."""

from __future__ import annotations

from . import bpe, chat, decontaminate, html_text, langid, quality, secret_scan, simhash, token_counts, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_secrets": secret_scan.op2_secrets,
    "op3_html": html_text.op3_html,
    "op4_quality": quality.op4_quality,
    "op5_chat": chat.op5_chat,
    "op6_bpe": bpe.op6_bpe,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_langid": langid.op8_langid,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_warc": warc.op10_warc,
}

#: The others need positions, sketches, trees or tokenizers; their tests compare them with brute force.
ORACLES = {
    "op5_chat": chat.ORACLE,
    "op9_decontamination": decontaminate.ORACLE,
    "op10_warc": warc.ORACLE,
}
