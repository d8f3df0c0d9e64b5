"""Declared schemas of raw problems, benchmark rows and condition results."""

RAW = "id string, question string, answer string"

NOISE = "array<struct<type: string, position: string, text: string>>"
CHAIN = "struct<exprs: array<string>, final: string>"
CHECKS = "map<string, struct<class_constraints: boolean, no_leakage: boolean>>"

BENCHMARK = (
    f"id string, variant string, question string, answer string, schema struct<units: array<string>, pairs: array<string>, calc_chain: {CHAIN}>,"
    f" core_sentences array<string>, meta struct<calc_chain: string>, validated_noises {CHECKS}, meta_checks struct<truth_invariant: boolean>,"
    " question_sentences array<string>, evidence_sentence_ids array<int>, noise_sentence_ids array<int>, n_before int, n_after int, position string"
)

TRACE = "array<struct<tool: string, input: array<string>, output: string, tool_call_id: string>>"

RESULT = (
    "id string, variant string, mode string, pred_answer string, gold_answer string, answer_correct boolean, pred_evidence_ids array<int>, gold_evidence_ids array<int>,"
    " evidence_precision double, evidence_recall double, evidence_f1 double, evidence_exact_match boolean, n_chunks_seen int, tool_calls int, max_tool_calls_limit int,"
    f" tool_trace {TRACE}, expression string, reasoning string, tool_mode string, oracle_evidence boolean, force_tool_first_turn boolean, gate_action string, gate_p_continue double,"
    " gate_p_one_more double, gate_anchor_applied boolean, gate_one_more_used int, gate_step_continue_count int, gate_step_no_progress_blocks int,"
    " gate_step_duplicate_blocks int, gate_step_block_reasons map<string, int>"
)
