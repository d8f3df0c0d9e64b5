"""Prompts in the chat template of a tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def chat_prompt(text: Column, tokenizer: Callable[[], object], template: str = "default", add_generation_prompt: bool = True, enable_thinking: bool = False) -> Column:
    """The text as one user message in the tokenizer's own template, untokenized; null stays null.

    tokenizer() makes an object with apply_chat_template(messages, tokenize, add_generation_prompt, enable_thinking), once in
    each task. Templates other than "default" are refused.
    """
    if template != "default":
        raise ValueError(f"unknown chat template: {template}")

    @F.pandas_udf("string")
    def prompts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = tokenizer()
        made = lambda t: own.apply_chat_template([{"role": "user", "content": t}], tokenize=False, add_generation_prompt=add_generation_prompt, enable_thinking=enable_thinking)
        for part in parts:
            yield part.map(made, na_action="ignore")

    return prompts(text)
