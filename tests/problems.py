"""Small problems and result rows of our own."""

RAW = [
    ("own/train/0", "Mia picked 14 apples on Friday and half as many on Sunday. How many apples did she pick altogether?", "Mia picked 14/2 = <<14/2=7>>7 apples on Sunday.\nThat is 14+7 = <<14+7=21>>21.\n#### 21"),
    ("own/train/1", "Omar has 8 boxes with 5 pens in each box. He gives away 4 pens. How many pens are left?", "He has 8*5 = <<8*5=40>>40 pens.\nThen 40-4 = <<40-4=36>>36 are left.\n#### 36"),
    ("own/train/2", "Each crate has 6 bottles. Then Lea buys 3 crates. How many bottles is that?", "<<6*3=18>>18"),
]


def call(output, *steps):
    return {"tool": "calculator", "input": list(steps), "output": output, "tool_call_id": "c"}


def result(k, variant, correct, calls, trace=(), mode="fc_baseline", **more):
    return {"id": f"own/{k}", "variant": variant, "mode": mode, "answer_correct": correct, "tool_calls": calls, "tool_trace": list(trace), "max_tool_calls_limit": 5, "n_chunks_seen": 6, "pred_answer": str(k), "reasoning": f"So it is {k}.", **more}


BASELINE = [
    result(0, "TB", False, 1, [call("3", "1+2")]),
    result(1, "TB", True, 2, [call("3", "1+2"), call("4", "2+2")]),
    result(2, "HU", False, 0),
    result(3, "HU", False, 3, [call("Error: x"), call("5"), call("5")]),
    result(4, "SP", True, 1, [call("9")]),
    result(5, "SP", False, 1, [call("Error: x")]),
]
COT = [result(k, v, c, 0, mode="fc_notool_cot") for k, v, c in ((0, "TB", True), (1, "TB", True), (2, "HU", True), (3, "HU", False), (4, "SP", False), (5, "SP", False))]
