"""Prompts within a budget, and training rows baked from curated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sqlcorpus import schemas as S
from sqlcorpus.functions import prompts as P


def choose_variant(
    df: DataFrame, variants: dict[int, str], max_chars: int = S.MAX_PROMPT_CHARS, extra: Column | int = 0,
    times: int = 1,
) -> DataFrame:
    """Add ``num_rows, prompt, prompt_status``: the first variant that fits, or ``ContextLimit``.

    ``variants`` maps a number of sample rows to the column with that text, richest first;
    ``extra`` counts the characters that will be put around it, ``times`` how often it will be used.
    """
    extra = F.lit(extra) if isinstance(extra, int) else extra
    fits = {n: F.length(F.col(name)) * times + extra <= max_chars for n, name in variants.items()}
    chosen = F.coalesce(*[F.when(fits[n], F.lit(n)) for n in variants])
    text = F.coalesce(*[F.when(F.col("num_rows") == n, F.col(name)) for n, name in variants.items()])
    rest = [name for name in df.columns if name not in variants.values()]
    return df.withColumn("num_rows", chosen).select(
        *rest,
        "num_rows",
        text.alias("prompt"),
        F.when(F.col("num_rows").isNull(), S.CONTEXT_LIMIT).otherwise(S.SUCCESS).alias("prompt_status"),
    )


def render_prompts(
    questions: DataFrame,
    contexts: DataFrame,
    template: str,
    max_chars: int = S.MAX_PROMPT_CHARS,
    instructions: str = "",
) -> DataFrame:
    """Questions with ``num_rows, prompt, prompt_status``, the prompt null beyond the budget.

    ``contexts`` has ``db_id`` and columns ``context_<n>``. The text is chosen by its length, so one
    prompt is built a question.
    """
    variants = {
        int(name.removeprefix("context_")): name for name in contexts.columns if name.startswith("context_")
    }
    richest_first = dict(sorted(variants.items(), reverse=True))
    uses = P.slot_uses(template)
    asked = sum(
        (F.coalesce(F.length(name), F.lit(0)) * uses.get(slot, 0)
         for name, slot in (("question", P.QUESTION_SLOT), ("evidence", P.HINT_SLOT))), F.lit(0))
    extra = asked + P.template_chars(template) + len(instructions) * uses.get(P.FORMAT_SLOT, 0)
    joined = questions.join(contexts, "db_id", "left")
    filled = joined.withColumns({
        name: F.coalesce(F.col(name), P.no_metadata(F.col("db_id"))) for name in richest_first.values()})
    chosen = choose_variant(filled, richest_first, max_chars, extra, uses.get(P.CONTEXT_SLOT, 0))
    slots = P.prompt_slots(F.col("prompt"), F.col("question"), F.col("evidence"), instructions)
    prompt = F.when(F.col("prompt").isNotNull(), P.render_template(template, slots))
    return chosen.withColumn("prompt", prompt)


def bake(curated: DataFrame, contexts: DataFrame, template: str) -> DataFrame:
    """``prompt, completion, db_id, teacher_sql`` of curated rows, and ``split`` where given.

    The schema text comes from a join: it is built once a database, in the column ``context_3``.
    """
    plans = [F.col(name) for name in ("query_plan", "final_reasoning") if name in curated.columns]
    context = F.coalesce(F.col("context_3"), P.no_metadata(F.col("db_id")))
    slots = P.prompt_slots(context, F.col("question"), F.col("evidence"))
    return curated.join(contexts.select("db_id", "context_3"), "db_id", "left").select(
        P.close_prompt(P.render_template(template, slots)).alias("prompt"),
        P.completion(F.coalesce(*plans), F.col("predicted_sql")).alias("completion"),
        "db_id",
        F.col("predicted_sql").alias("teacher_sql"),
        *(["split"] if "split" in curated.columns else []),
    )


def combined_val(baked: DataFrame) -> DataFrame:
    """Both validation splits together."""
    return baked.filter(F.col("split").isin(S.VAL_IN, S.VAL_OUT))


def length_audit(
    df: DataFrame, text: str = "prompt", max_tokens: int = 15_000, chars_per_token: int = S.CHARS_PER_TOKEN,
    by: list[str] = (),
) -> DataFrame:
    """Rows, rows over a token limit, and the largest and mean size, at a fixed rate of characters."""
    tokens = F.ceil(F.length(text) / chars_per_token)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(tokens > max_tokens).alias("over_limit"),
        F.max(tokens).alias("max_tokens"),
        F.sum(tokens).alias("total_tokens"),
    )


def truncate_left(text: Column, max_tokens: int, chars_per_token: int = S.CHARS_PER_TOKEN) -> Column:
    """The end of a text that fits a token limit."""
    return F.right(text, F.lit(max_tokens * chars_per_token))
