"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from plethora.llm import bpe, centroids, chat, exact_dedup, fingerprints, language_id, line_dedup, minhash, mixing, prefix_trie, secret_scan, token_files, toxicity

_MODULES = {
    "op1_minhash": minhash,
    "op2_exact_dedup": exact_dedup,
    "op3_fingerprints": fingerprints,
    "op4_bpe": bpe,
    "op5_chat": chat,
    "op6_toxicity": toxicity,
    "op7_secret_scan": secret_scan,
    "op8_mixing": mixing,
    "op9_line_dedup": line_dedup,
    "op10_language_id": language_id,
    "op11_token_files": token_files,
    "op12_prefix_trie": prefix_trie,
    "op13_centroids": centroids,
}


def queries() -> dict:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
