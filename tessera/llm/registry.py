"""The queries of this subpackage, one an operator, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import bpe, decontaminate, divergence, exactdedup, infill, language, linededup, minhash, passages, simhash, substrings, tokenfile, toxicity

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "pages_language_id": language.pages_language_id,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_token_file": tokenfile.op3_token_file,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_exact_dedup": exactdedup.op5_exact_dedup,
    "op6_simhash": simhash.op6_simhash,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_repeated_bytes": substrings.op8_repeated_bytes,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_shared_passages": passages.op10_shared_passages,
    "op11_minhash": minhash.op11_minhash,
    "op12_fill_in_middle": infill.op12_fill_in_middle,
    "op13_source_divergence": divergence.op13_source_divergence,
}
ORACLES: dict[str, str] = {
    "op4_line_dedup": linededup.ORACLE,
    "op5_exact_dedup": exactdedup.ORACLE,
    "op11_minhash": minhash.op11_minhash,
    "op12_fill_in_middle": infill.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
