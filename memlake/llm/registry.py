"""The subpackage's queries and their SQL."""

from __future__ import annotations

from memlake.llm import bpe, chains, chat, lines, neardup, sharding, suffix, templates, topk, toxicity

QUERIES = {"op1_chat": chat.op1_chat, "op2_templates": templates.op2_templates, "op3_minhash": neardup.op3_minhash, "op4_toxicity": toxicity.op4_toxicity, "op5_byte_bpe": bpe.op5_byte_bpe, "op6_line_dedup": lines.op6_line_dedup, "op7_suffix_array": suffix.op7_suffix_array, "op8_chaining": chains.op8_chaining, "op9_sharding": sharding.op9_sharding, "op10_topk": topk.op10_topk}
ORACLES: dict[str, str] = {"op6_line_dedup": lines.ORACLE, "op7_suffix_array": suffix.ORACLE, "op10_topk": topk.ORACLE}
