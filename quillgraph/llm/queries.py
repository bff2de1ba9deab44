"""Queries of the training-data operators and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.ball_tree import OP10_SQL, op10_ball_tree_top_k
from quillgraph.llm.decontaminate import op6_simhash_leaks
from quillgraph.llm.fill_middle import OP13_SQL, op13_fill_in_middle
from quillgraph.llm.html_extract import op4_wrapper_extract
from quillgraph.llm.importance import OP11_SQL, op11_importance_resample
from quillgraph.llm.jaccard import op8_jaccard_components
from quillgraph.llm.langid import op3_subword_language
from quillgraph.llm.mixing import OP2_SQL, op2_weighted_fair_mix
from quillgraph.llm.pii import op1_skip_chain_pii
from quillgraph.llm.secrets import op7_guess_cost_secrets
from quillgraph.llm.suffix_dedup import OP12_SQL, op12_suffix_dedup
from quillgraph.llm.url_filter import OP9_SQL, op9_url_verdicts
from quillgraph.llm.warc import OP5_SQL, op5_warc_revisits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_skip_chain_pii": op1_skip_chain_pii,
    "op2_weighted_fair_mix": op2_weighted_fair_mix,
    "op3_subword_language": op3_subword_language,
    "op4_wrapper_extract": op4_wrapper_extract,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_simhash_leaks": op6_simhash_leaks,
    "op7_guess_cost_secrets": op7_guess_cost_secrets,
    "op8_jaccard_components": op8_jaccard_components,
    "op9_url_verdicts": op9_url_verdicts,
    "op10_ball_tree_top_k": op10_ball_tree_top_k,
    "op11_importance_resample": op11_importance_resample,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL: dict[str, str] = {
    "op2_weighted_fair_mix": OP2_SQL,
    "op5_warc_revisits": OP5_SQL,
    "op9_url_verdicts": OP9_SQL,
    "op10_ball_tree_top_k": OP10_SQL,
    "op11_importance_resample": OP11_SQL,
    "op12_suffix_dedup": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
