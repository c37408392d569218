"""Complexity labels of SQL text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sqlcorpus import schemas as S

# The words the labels are decided by.
JOIN_WORD = "JOIN"
SET_WORDS = ["UNION", "INTERSECT", "EXCEPT"]
SELECT_WORD = "SELECT"


def _mentions(text: Column, words: list[str], word_bounded: bool) -> Column:
    if word_bounded:
        return F.regexp_like(text, F.lit(r"\b(?:" + "|".join(words) + r")\b"))
    found = text.contains(words[0])
    for word in words[1:]:
        found = found | text.contains(word)
    return found


def sql_features(sql: Column, word_bounded: bool = False) -> Column:
    """``struct<select_count, has_join, has_set_op>`` of a SQL text; a null text counts as empty.

    Joins and set operators are substring tests, so a column ``joined_at`` counts as a join;
    ``word_bounded`` asks for whole words instead.
    """
    text = F.upper(F.coalesce(sql, F.lit("")))
    return F.struct(
        F.regexp_count(text, F.lit(rf"\b{SELECT_WORD}\b")).alias("select_count"),
        _mentions(text, [JOIN_WORD], word_bounded).alias("has_join"),
        _mentions(text, SET_WORDS, word_bounded).alias("has_set_op"),
    )


def classify_sql(sql: Column, word_bounded: bool = False) -> Column:
    """The complexity label of a SQL text."""
    text = F.upper(F.coalesce(sql, F.lit("")))
    nested = F.regexp_count(text, F.lit(rf"\b{SELECT_WORD}\b")) > 1
    combined = _mentions(text, [JOIN_WORD, *SET_WORDS], word_bounded)
    return (
        F.when(combined & nested, S.LEVEL_4)
        .when(combined, S.LEVEL_3)
        .when(nested, S.LEVEL_2)
        .when(_mentions(text, [SELECT_WORD], word_bounded), S.LEVEL_1)
        .otherwise(S.LEVEL_OTHER)
    )


def level_rank(level: Column) -> Column:
    """Position of a label in the fixed order, 0 for the most complex; unknown labels come last."""
    rank = F.lit(len(S.LEVELS))
    for position, name in reversed(list(enumerate(S.LEVELS))):
        rank = F.when(level == name, position).otherwise(rank)
    return rank
