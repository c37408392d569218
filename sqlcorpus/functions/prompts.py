"""Prompt templates with named slots."""

from __future__ import annotations

from collections import Counter
from string import Formatter

from pyspark.sql import Column, functions as F

from sqlcorpus.functions.text import strip_right

# The slots of a prompt template, and the heading between plan and statement.
CONTEXT_SLOT = "db_schema_context_hmr"
QUESTION_SLOT = "nl_question"
HINT_SLOT = "hint"
FORMAT_SLOT = "format_instructions"
SQL_HEADING = "\n\n## SQL Query:\n"


def render_template(template: str, slots: dict[str, Column]) -> Column:
    """The template with its slots filled; slot names inside filled-in text are left alone."""
    parts: list[Column] = []
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if slot is not None:
            parts.append(F.coalesce(slots[slot].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def template_chars(template: str) -> int:
    """Characters of the template outside its slots."""
    return sum(len(literal) for literal, *_ in Formatter().parse(template))


def slot_uses(template: str) -> dict[str, int]:
    """How often the template uses each slot."""
    return dict(Counter(slot for _, slot, _, _ in Formatter().parse(template) if slot is not None))


def prompt_slots(context: Column, question: Column, hint: Column, instructions: str = "") -> dict[str, Column]:
    return {
        CONTEXT_SLOT: context,
        QUESTION_SLOT: question,
        HINT_SLOT: hint,
        FORMAT_SLOT: F.lit(instructions),
    }


def no_metadata(db_id: Column) -> Column:
    """What stands for the schema of a database without a catalog entry. Fixed value."""
    return F.concat(F.lit("/* No schema metadata available for "), F.coalesce(db_id, F.lit("")), F.lit(". */"))


def close_prompt(prompt: Column) -> Column:
    """A prompt that ends in exactly one newline and no other white space."""
    return F.concat(strip_right(prompt), F.lit("\n"))


def completion(plan: Column, sql: Column) -> Column:
    """What a model should answer: the plan, the heading, the statement."""
    return F.concat(F.coalesce(plan, F.lit("")), F.lit(SQL_HEADING), F.coalesce(sql, F.lit("")))
