"""Prompt templates and rendering for long-document QA tasks.

Templates are data: a ``(model, task, template)`` table with named
placeholders.  Rendering is a chain of ``replace`` calls; the context (the
only caller text that may itself contain braces) is substituted last.  The
template wording here is this library's own; only the placeholder contract
is shared with the original prompts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .tokens import tokenize, truncate_middle_exact

MODELS = K.TEMPLATE_MODELS
TASKS = [t for t, _ in K.TASK_FILES]

_OPTIONS = "\n\nA. {OPTION_A}\nB. {OPTION_B}\nC. {OPTION_C}\nD. {OPTION_D}"
BASE_TEMPLATES = {
    "passkey": "A pass key is hidden in the text below. Find it.\n\n{context}\n\n{input}",
    "number_string": "A sequence of digits is hidden in the text below. Find it.\n\n{context}\n\n{input}",
    "kv_retrieval": "Find the value stored for the key in this JSON data.\n\n{context}\n\n{input}",
    "longbook_sum_eng": "Write a summary of the following book.\n\n{context}\n\nSummary:",
    "longbook_choice_eng": "Read the book and choose the right option.\n\n{context}\n\nQuestion: {question}" + _OPTIONS
                           + "\n\nThe right option is",
    "longbook_qa_eng": "Read the book and answer briefly.\n\n{context}\n\nQuestion: {question}\nAnswer:",
    "longbook_qa_chn": "阅读下面的书并简短回答问题。\n\n{context}\n\n问题：{question}\n回答：",
    "longdialogue_qa_eng": "Below is a script with one name masked as $$MASK$$. Who is it?\n\n{context}\n\nName:",
    "math_find": "{prefix}\n\n{context}\n\n{input}",
    "math_calc": "Work out the running value of this expression.\n\n{context}\n\nValues:",
    "code_run": "Here is a program.\n\n{context}\n\nWhat does {func_call} return? Trace {func} and answer with a number.",
    "code_debug": "One of the functions below has a bug. Which one?\n\n{context}" + _OPTIONS + "\n\nAnswer:",
}
MODEL_WRAPPERS = {
    "gpt4": ("", ""),
    "claude2": ("", ""),
    "kimi": ("", ""),
    "yarn-mistral": ("", "\n"),
    "Yi-6B-200K": ("", "\n"),
    "Yi-6b-Chat": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"),
    "llama": ("[INST] ", " [/INST]"),
}
# which placeholders each task fills (others stay as written)
TASK_FIELDS = {
    "code_run": ["func", "func_call", "context"],
    "code_debug": ["OPTION_A", "OPTION_B", "OPTION_C", "OPTION_D", "context"],
    "longdialogue_qa_eng": ["context"],
    "longbook_choice_eng": ["question", "OPTION_A", "OPTION_B", "OPTION_C", "OPTION_D", "context"],
    "longbook_qa_eng": ["question", "context"],
    "longbook_qa_chn": ["question", "context"],
    "longbook_sum_eng": ["context"],
    "math_calc": ["context"],
    "math_find": ["prefix", "input", "context"],
}
DEFAULT_FIELDS = ["input", "context"]


def template_rows() -> list[tuple[str, str, str]]:
    rows = []
    for m in MODELS:
        pre, post = MODEL_WRAPPERS[m]
        for t in TASKS:
            rows.append((m, t, pre + BASE_TEMPLATES[t] + post))
    return rows


def validate_template(task: str, template: str) -> None:
    """Reject placeholders the task cannot fill (would fail at render time)."""
    names = re.findall(r"\{([^{}]*)\}", template)
    allowed = set(TASK_FIELDS.get(task, DEFAULT_FIELDS))
    bad = [n for n in names if n not in allowed]
    if bad:
        raise ValueError(f"template for {task} has unknown placeholders {bad}")


def templates_frame(spark: SparkSession, rows=None) -> DataFrame:
    rows = rows or template_rows()
    for _, t, tpl in rows:
        validate_template(t, tpl)
    return spark.createDataFrame(rows, "model string, task string, template string")


def extract_call(text: Column) -> Column:
    """First ``func_<n>(<int>)`` call in the text, null when absent."""
    return F.nullif(F.regexp_extract(text, K.CALL_PATTERN, 0), F.lit(""))


def call_name(call: Column) -> Column:
    return F.substring_index(call, "(", 1)


def find_target(text: Column) -> Column:
    """``The ... of`` (greedy), lower-cased, without the trailing ``of``; null when absent."""
    m = F.nullif(F.regexp_extract(text, K.TARGET_PATTERN, 0), F.lit(""))
    return F.substring(F.lower(m), F.lit(1), F.length(m) - 3)


def find_prefix(text: Column) -> Column:
    return F.concat(F.lit("What is "), find_target(text), F.lit(" in the following list?"))


def fields(ex: DataFrame) -> dict[str, Column]:
    """Placeholder values of an example row (``context`` falls back to ``content``)."""
    ctx = F.coalesce(F.col("context"), F.col("content")) if "content" in ex.columns else F.col("context")
    opt = [F.try_element_at(F.col("options"), F.lit(i + 1)) for i in range(4)]
    call = extract_call(F.col("input"))
    return {
        "context": ctx, "question": F.col("input"), "input": F.col("input"),
        "prefix": find_prefix(F.col("input")), "func": call_name(call), "func_call": call,
        "OPTION_A": opt[0], "OPTION_B": opt[1], "OPTION_C": opt[2], "OPTION_D": opt[3],
    }


def render(ex: DataFrame, templates: DataFrame) -> DataFrame:
    """Join examples (with a ``task`` column) to templates on task and fill the placeholders.

    A template is cut once at its placeholders and the parts are joined, so a value that itself holds
    a placeholder stays as it is.  An example without a template, or without a value its template
    needs (no call, no target, fewer options), is kept with a null ``prompt`` and the reason in
    ``problem``.  ``math_calc`` for ``gpt4`` is the raw context (that model gets it as chat messages
    instead).  The template table is small (models x tasks): broadcast.
    """
    f = fields(ex)
    j = ex.join(F.broadcast(templates), "task", "left")
    values = F.create_map(*[x for name, c in f.items() for x in (F.lit(name), c)])
    parts = F.split("template", r"(?=\{)|(?<=\})")
    is_field = lambda p: p.rlike(r"^\{[^{}]*\}$")
    name = lambda p: F.substring(p, F.lit(2), F.length(p) - 2)

    def fill(v):
        return F.transform(parts, lambda p: F.when(is_field(p), F.try_element_at(v, name(p))).otherwise(p))
    filled = F.element_at(F.transform(F.array(values), fill), 1)
    raw = (F.col("model") == "gpt4") & (F.col("task") == "math_calc")
    j = j.withColumn("_filled", F.when(raw, F.array(f["context"])).otherwise(filled))
    lacks = F.exists("_filled", lambda x: x.isNull())
    missing = F.filter(F.transform(parts, lambda p, i: F.when(F.get("_filled", i).isNull(), name(p))), lambda n: n.isNotNull())
    problem = F.when(F.col("template").isNull(), F.lit("no template")).when(
        lacks, F.concat(F.lit("no value for "), F.array_join(F.array_distinct(missing), ", ")))
    return j.withColumn("prompt", F.when(F.col("template").isNotNull() & ~lacks, F.array_join("_filled", ""))).withColumn(
        "problem", problem).drop("_filled")


def system_message(task: Column) -> Column:
    return F.when(task == "math_calc", F.lit(K.CALC_SYSTEM_MESSAGE)).otherwise(F.lit(K.DEFAULT_SYSTEM_MESSAGE))


def chat_messages(prompt: Column, task: Column, max_tokens: int = K.CHAT_PROMPT_TOKEN_LIMIT) -> Column:
    """Chat messages: prompt cut to ``max_tokens`` in the middle; one-shot example for math_calc."""
    cut = F.array_join(truncate_middle_exact(tokenize(prompt), max_tokens), "")

    def msg(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    calc = F.array(msg("system", system_message(task)), msg("user", F.lit(K.CALC_EXAMPLE_QUESTION)),
                   msg("system", F.lit(K.CALC_EXAMPLE_ANSWER)), msg("user", cut))
    plain = F.array(msg("system", F.lit(K.CHAT_SYSTEM_MESSAGE)), msg("user", cut))
    return F.when(task == "math_calc", calc).otherwise(plain)


def needle_prompt(context: Column, question: str = K.DEFAULT_RETRIEVAL_QUESTION) -> Column:
    """Prompt wrapper of the needle test for locally served models."""
    return F.concat(F.lit(K.NEEDLE_PROMPT_PREFIX), context, F.lit(K.NEEDLE_PROMPT_MIDDLE), F.lit(question),
                    F.lit(K.NEEDLE_PROMPT_SUFFIX))


def needle_chat(context: Column, question: str = K.DEFAULT_RETRIEVAL_QUESTION) -> Column:
    """Chat form of the needle prompt for API-served models."""
    def msg(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(msg("system", F.lit(K.NEEDLE_SYSTEM_MESSAGE)), msg("user", context),
                   msg("user", F.lit(question + K.NEEDLE_QUESTION_SUFFIX)), msg("assistant", F.lit("")))
