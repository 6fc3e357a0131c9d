"""Token counts, budgets and chat messages as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.config import SYSTEM_PROMPT, Settings


def count_tokens(text: Column, measure=None) -> Column:
    """A quarter of the characters, or ``measure(str) -> int`` applied in Arrow batches."""
    if measure is None:
        return F.floor(F.length(text) / 4).cast("int")

    @F.pandas_udf(T.IntegerType())
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 0 if t is None else int(measure(t)))

    return counted(text)


def count_message_tokens(texts: Column, measure=None) -> Column:
    """Tokens of an array of strings plus three, by the counter of ``count_tokens``."""
    if measure is not None:

        @F.pandas_udf(T.IntegerType())
        def counted(arrays: pd.Series) -> pd.Series:
            return arrays.map(lambda a: 3 + sum(int(measure(t)) for t in a if t is not None))

        return counted(texts)
    sizes = F.transform(texts, lambda t: F.floor(F.length(t) / 4).cast("int"))
    return F.aggregate(sizes, F.lit(3), lambda total, size: total + size)


def history_texts(history: Column) -> Column:
    """All questions and answers of a history, flattened in order."""
    return F.flatten(F.transform(history, lambda pair: F.array(pair["q"], pair["a"])))


def context_budget(
    question: Column, history: Column, cfg: Settings = Settings(), measure=None
) -> Column:
    """Tokens left for retrieved text, all counted by ``measure``; may be negative."""
    fixed = cfg.token_window - cfg.answer_tokens - cfg.offcut_tokens
    size = measure(cfg.prompt_template) if measure else len(cfg.prompt_template) // 4
    template = int(size) + 3
    return (
        F.lit(fixed - template)
        - count_message_tokens(F.array(question), measure)
        - count_message_tokens(history_texts(history), measure)
    )


def trim_middle(text: Column, remaining: Column, step: int = 50, measure=None) -> Column:
    """Cut ``step`` characters off both ends until the tokens (+3) fit ``remaining``.

    Counting four characters a token, the number of cuts has a closed form; another
    ``measure`` needs the loop.
    """
    if measure is None:
        length = F.length(text)
        limit = F.lit(4) * (remaining - 3) + 3
        cuts = F.greatest(
            F.lit(0), F.ceil((length - limit) / (2 * step)).cast("int")
        )
        left = length - 2 * step * cuts
        return F.when(left > 0, F.substring(text, step * cuts + 1, left)).otherwise("")

    @F.pandas_udf(T.StringType())
    def trimmed(texts: pd.Series, budgets: pd.Series) -> pd.Series:
        def one(body, budget):
            while measure(body) + 3 > budget:
                if len(body) <= 2 * step:
                    return ""
                body = body[step:-step]
            return body

        return pd.Series([one(t or "", b) for t, b in zip(texts, budgets, strict=True)])

    return trimmed(text, remaining)


def prompt(question: Column, context: Column, template: str) -> Column:
    """Question first, then context, so a context mark inside a question is filled too."""
    asked = F.replace(F.lit(template), F.lit("{question}"), question)
    return F.replace(asked, F.lit("{context}"), context)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(prompt_text: Column, history: Column, system: str = SYSTEM_PROMPT) -> Column:
    """System line, the complete pairs of the history, then the prompt."""
    whole = F.filter(history, lambda pair: pair["q"].isNotNull() & pair["a"].isNotNull())
    turns = F.flatten(
        F.transform(
            whole, lambda pair: F.array(_message("user", pair["q"]), _message("assistant", pair["a"]))
        )
    )
    return F.concat(
        F.array(_message("system", F.lit(system))), turns, F.array(_message("user", prompt_text))
    )


def next_history(history: Column, question: Column, answer: Column) -> Column:
    """The new pair takes the place of the last one; an empty history gains it."""
    pair = F.struct(question.alias("q"), answer.alias("a"))
    kept = F.slice(history, F.lit(1), F.greatest(F.lit(0), F.size(history) - 1))
    return F.concat(kept, F.array(pair))


def rerank_pair(query: Column, document: Column, instruction: str) -> Column:
    return F.concat(
        F.lit(f"<Instruct>: {instruction}\n<Query>: "), query, F.lit("\n<Document>: "), document
    )


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def yes_probability(yes: Column, no: Column) -> Column:
    """Two-way softmax over the logits of yes and no."""
    return 1 / (1 + F.exp(no - yes))
