"""The queries of this subpackage by name, and their SQL where there is any."""

from __future__ import annotations

from . import decontaminate, forest, line_dedup, merkle, packing, parity_join, periodic, ppm_langid, quality_cnn, secrets, superkmer, tool_calls, warc

LLM_QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_prefix_forest": forest.op2_prefix_forest,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_tool_calls": tool_calls.op4_tool_calls,
    "op5_quality_cnn": quality_cnn.op5_quality_cnn,
    "op6_parity_join": parity_join.op6_parity_join,
    "op7_warc_revisits": warc.op7_warc_revisits,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_ppm_langid": ppm_langid.op9_ppm_langid,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_superkmer_dedup": superkmer.op12_superkmer_dedup,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
LLM_SQL = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op4_tool_calls": tool_calls.OP4_SQL,
    "op6_parity_join": parity_join.OP6_SQL,
    "op7_warc_revisits": warc.OP7_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op12_superkmer_dedup": superkmer.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
