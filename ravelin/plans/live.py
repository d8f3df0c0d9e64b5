"""Live runs: problems under conditions, answered by a chat provider, as rows that ablation.scored takes.

Prompts are columns and every condition is a row, so a run is one map over rows, with a provider built in each partition;
its errors become columns. The commit gate works on the whole table between two such maps: the first one's rows are
written, the gate's model decides on all of them at once, and those that need one more turn go on from their messages.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin import schemas
from ravelin.functions import replies
from ravelin.functions.jsonrepair import THINK
from ravelin.plans import ablation, gate
from ravelin.sources import providers

SYSTEM = (
    "You solve a word problem from numbered information chunks, some of which do not matter. Call the tool calculate with calc_steps, a list of expressions, for all arithmetic. "
    'Then reply with JSON only: {"reasoning": why, "evidence_ids": [chunk numbers used], "final_answer": the value}.'
)
COT_SYSTEM = "You solve a word problem from numbered information chunks, some of which do not matter. Work step by step without tools and end with <result>."
COT_FORM = 'Reply with JSON in this order: {"calc_chain": the steps, ending with <result>, "evidence_ids": [chunk numbers used], "final_answer": the value in <result>}.'
REPAIR_PROMPT = "That was no valid JSON. Reply with JSON only, with calc_chain, evidence_ids and final_answer in this order."
RESCUE_SYSTEM = "Reply with one line of JSON only: calc_chain (short), evidence_ids (chunk numbers), final_answer (the value)."

KEPT = "id string, variant string, mode string, tool_mode string, max_tool_calls int, oracle_evidence boolean, commit_gate boolean, gold_answer string, gold_evidence_ids array<int>, prompt string, n_chunks_seen int"
FOUND = (
    "pred_answer string, pred_evidence_ids array<int>, reasoning string, expression string, trace_text string, messages_text string, error string,"
    " gate_p_continue double, gate_step_continue_count int, gate_step_no_progress_blocks int, gate_step_duplicate_blocks int, reasons_text string"
)


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def asked(crossed: DataFrame) -> DataFrame:
    """Rows of problems under conditions with what the model is shown: the question and the chunks, or the evidence alone, by their own numbers."""
    shown = F.when(F.col("oracle_evidence"), ablation.info_chunks(F.col("chunks"), "evidence")).otherwise(ablation.info_chunks(F.col("chunks")))
    block = F.array_join(F.transform("_shown", lambda c: F.concat(F.lit("["), c.index.cast("string"), F.lit("] "), c.text)), "\n")
    prompt = F.concat(F.lit("Question: "), F.coalesce("question_text", F.lit("")), F.lit("\n\nInformation chunks:\n"), block, F.lit("\n"))
    return crossed.withColumn("_shown", shown).withColumn("prompt", prompt).withColumn("n_chunks_seen", F.size("_shown")).drop("_shown", "chunks")


def said(llm, messages: list[dict]) -> str:
    """The text of a reply without tools."""
    reply = providers.with_retry(lambda: llm.chat(messages))
    return THINK.sub("", reply.content or "").strip()


def conversation(system: str, user: str) -> list[dict]:
    return [{"role": "system", "content": system}, {"role": "user", "content": user}]


def by_thought(llm, prompt: str, lenient: bool) -> dict:
    """A worked answer without tools. Where reading is lenient, broken JSON is sent back once, and what still lacks is asked for once more, shortly."""
    messages = conversation(COT_SYSTEM, f"{prompt}\n{COT_FORM}")
    final = said(llm, messages)
    if lenient and not {"calc_chain", "final_answer"} <= replies.read_strict(final).keys():
        again = said(llm, [*messages, {"role": "assistant", "content": final}, {"role": "user", "content": REPAIR_PROMPT}])
        final = again or final
    found = replies.chain_of_thought(final, lenient)
    if lenient and not (found["pred_answer"] and found["pred_evidence_ids"]):
        rescued = replies.chain_of_thought(said(llm, conversation(RESCUE_SYSTEM, prompt)), lenient)
        found |= {k: v for k, v in rescued.items() if v and (k == "reasoning" or not found[k])}
    return found


def one_row(llm, row, step_gate: Callable | None, base_url: str) -> dict:
    """FOUND of one row; an error is kept as its reasoning."""
    lenient, loop = providers.is_gemini(base_url), None
    try:
        if row.tool_mode == "notool":
            found = by_thought(llm, row.prompt, lenient)
        elif row.tool_mode == "fcprompt":
            found = replies.without_tools(said(llm, conversation(SYSTEM, row.prompt)), lenient)
        else:
            own = step_gate if row.step_gate and row.tool_mode == "real" else None
            loop = providers.Loop(llm, providers.tool_function(row.tool_mode, row.gold_answer), int(row.max_tool_calls), bool(row.force_tool_first_turn), base_url, own)
            found = replies.after_tools(loop.run(SYSTEM, row.prompt), loop.trace, row.tool_mode, lenient)
    except Exception as e:  # the row fails, not the task
        return {"pred_answer": "", "pred_evidence_ids": [], "reasoning": f"ERROR: {e}", "expression": "", "error": f"{type(e).__name__}: {e}"}
    if loop:
        found |= {"trace_text": json.dumps(loop.trace), "messages_text": json.dumps(loop.messages), "gate_p_continue": loop.scores[-1] if loop.scores else 0.0, "reasons_text": json.dumps(loop.reasons)}
        found |= {"gate_step_continue_count": loop.continued, "gate_step_no_progress_blocks": loop.no_progress, "gate_step_duplicate_blocks": loop.duplicates}
    return found


def mapped(rows: DataFrame, build: Callable[[], object], answer: Callable[[object, object], dict]) -> DataFrame:
    """answer(provider, row) of each row, beside KEPT."""
    kept, made = names(KEPT), names(FOUND)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        llm = build()
        for part in parts:
            found = [answer(llm, r) for r in part.itertuples()]
            own = {c: [f.get(c) for f in found] for c in made}
            zeros = {c: [x or 0 for x in own[c]] for c in made if c.startswith("gate_")}
            yield pd.concat([part[kept].reset_index(drop=True), pd.DataFrame(own | zeros, columns=made)], axis=1)

    return rows.mapInPandas(run, f"{KEPT}, {FOUND}")


def answered(rows: DataFrame, build: Callable[[], object], step_gate: Callable | None = None, base_url: str = "") -> DataFrame:
    """FOUND beside KEPT for rows of asked(). Write the result before using it twice: a recomputed partition calls the provider again."""
    own = rows.select(*names(KEPT), "step_gate", "force_tool_first_turn")
    return mapped(own, build, lambda llm, r: one_row(llm, r, step_gate, base_url))


def with_trace(found: DataFrame) -> DataFrame:
    trace = F.coalesce(F.from_json("trace_text", schemas.TRACE), F.array().cast(schemas.TRACE))
    return found.withColumn("tool_trace", trace).withColumn("max_tool_calls_limit", F.col("max_tool_calls"))


def committed(found: DataFrame, build: Callable[[], object], model: gate.LinearGate, base_url: str = "", prompt: str = providers.ONE_MORE_PROMPT) -> DataFrame:
    """found, as written, with the commit gate's verdicts; rows that need one more turn have their new answer."""
    lenient = providers.is_gemini(base_url)
    own = gate.with_commit_features(with_trace(found), "_x").withColumn("_p", model.probability(F.col("_x")))
    verdict = gate.commit_decision(F.col("_p"), F.col("pred_answer"), F.col("tool_trace"), F.lit(0))
    asks = (F.col("tool_mode") == "real") & F.col("commit_gate") & F.col("error").isNull()
    own = own.withColumn("_verdict", F.when(asks, verdict).otherwise(F.struct(F.lit("submit").alias("action"), F.lit(0.0).alias("p_one_more"))))
    own = own.select(*found.columns, F.col("_verdict.action").alias("gate_action"), F.col("_verdict.p_one_more").alias("gate_p_one_more"))
    more = own.filter("gate_action = 'one_more_turn'")

    def again(llm, r) -> dict:
        first = {c: getattr(r, c) for c in names(FOUND)} | {"pred_evidence_ids": list(r.pred_evidence_ids)}
        trace, messages = json.loads(r.trace_text), json.loads(r.messages_text)
        tool = providers.tool_function(r.tool_mode, r.gold_answer)
        for call in trace:  # the variables of the first turns are known again
            tool(call["input"])
        loop = providers.Loop(llm, tool, 1, True, base_url, messages=[*messages, {"role": "user", "content": prompt}], trace=trace)
        try:
            return first | replies.after_tools(loop.run(SYSTEM, r.prompt), loop.trace, r.tool_mode, lenient) | {"trace_text": json.dumps(loop.trace), "messages_text": json.dumps(loop.messages)}
        except Exception:  # the first answer stands
            return first

    keys = ["id", "variant", "mode"]
    verdicts = more.select(*[F.col(k).alias(f"_{k}") for k in keys], "gate_action", "gate_p_one_more")
    told = mapped(more.select(*names(KEPT), *names(FOUND)), build, again).join(verdicts, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]))
    return own.filter("gate_action <> 'one_more_turn'").unionByName(told.drop(*[f"_{k}" for k in keys]))


def results(found: DataFrame) -> DataFrame:
    """Result rows of answered() or committed(), scored."""
    own = with_trace(found)
    if "gate_action" not in own.columns:
        own = own.withColumns({"gate_action": F.lit("submit"), "gate_p_one_more": F.lit(0.0)})
    own = own.withColumns({"gate_anchor_applied": F.lit(False), "gate_one_more_used": (F.col("gate_action") == "one_more_turn").cast("int"), "gate_step_block_reasons": F.from_json("reasons_text", "map<string, int>")})
    return ablation.scored(own)


def run(
    benchmark: DataFrame, build: Callable[[], object], written: Callable[[DataFrame], DataFrame], *, only: list[str] | None = None, variants: list[str] | None = None, limit: int | None = None, offset: int = 0,
    order: str = "seq", step_gate: Callable | None = None, commit_model: gate.LinearGate | None = None, base_url: str = "",
) -> DataFrame:
    """Scored result rows of all problems under all conditions, answered by the provider that build makes in each partition.

    written(df) writes df and reads it again, so no call is made twice. step_gate(trace, text, turns) gives (action, p) inside the
    loop; commit_model decides on the written rows. base_url tells the family of models.
    """
    table = ablation.conditions(benchmark.sparkSession, step_gate=step_gate is not None, extended=commit_model is not None, only=only)
    problems = ablation.load_problems(benchmark, variants, limit, offset, order)
    found = written(answered(asked(ablation.crossed(problems, table)), build, step_gate, base_url))
    return results(written(committed(found, build, commit_model, base_url)) if commit_model else found)

