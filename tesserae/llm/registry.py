"""The queries of this subpackage by name, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from tesserae.llm import bpe, chat, codes, lexical, lines, minhash, packing, pieces, quality, secrets, substring, suffixes, topk

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_minhash": minhash.op3_minhash,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_substring_dedup": substring.op5_substring_dedup,
    "op6_packing": packing.op6_packing,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_chat_perspectives": chat.op9_chat_perspectives,
    "op10_topk": topk.op10_topk,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_piece_bpe": pieces.op13_piece_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality.ORACLE_SQL,
    "op9_chat_perspectives": chat.ORACLE_SQL,
    "op10_topk": topk.ORACLE_SQL,
    "op11_vector_codes": codes.ORACLE_SQL,
    "op12_lexical_search": lexical.ORACLE_SQL,
}
