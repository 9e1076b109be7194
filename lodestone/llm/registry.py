"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestone.llm.ann_collision import op1_nearest_neighbours
from lodestone.llm.chat_tools import GRAPHS_SQL, OP4_SQL, op4_tool_calls, tool_call_graphs
from lodestone.llm.kneser_ney import op9_quality
from lodestone.llm.langid import op7_language_id
from lodestone.llm.licenses import op8_license_scan
from lodestone.llm.media import op2_media_column
from lodestone.llm.mixing import op6_mix_sources
from lodestone.llm.order_minhash import op10_near_duplicates
from lodestone.llm.packing import op5_pack_sequences
from lodestone.llm.token_files import op3_token_files

QUERIES = {f.__name__: f for f in (op1_nearest_neighbours, op2_media_column, op3_token_files, op4_tool_calls, op5_pack_sequences, op6_mix_sources, op7_language_id, op8_license_scan, op9_quality, op10_near_duplicates, tool_call_graphs)}
ORACLE_SQL = {"op4_tool_calls": OP4_SQL, "tool_call_graphs": GRAPHS_SQL}
