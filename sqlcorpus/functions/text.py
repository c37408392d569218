"""SQL text, model output and identifiers, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from sqlcorpus import schemas as S

FENCE = "```"
# The characters that count as white space at the ends of a text.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Drop white space, in the Unicode sense, from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_right(text: Column) -> Column:
    """Drop white space from the end."""
    return F.rtrim(text, F.lit(WHITE_SPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once for all its uses in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_sql(sql: Column) -> Column:
    """A statement ready to run: no fence, no comments, no closing semicolon, with its leading verb.

    Comments are dropped before the verb is looked for, and not inside quoted text.
    """
    text = strip(F.coalesce(sql, F.lit("")))
    text = F.regexp_replace(text, r"(?iU)^```(?:sqlite|sql)?\s*|\s*```$", "")
    text = F.regexp_replace(text, r"""(?s)('[^']*'|"[^"]*"|`[^`]*`)|--[^\n]*|/\*.*?\*/""", "$1")
    text = strip(F.rtrim(strip(text), F.lit(";")))

    def with_verb(text: Column) -> Column:
        verb = F.regexp_like(text, F.lit(r"(?i)^(?:select|with)\b"))
        return F.when((text == "") | verb, text).otherwise(F.concat(F.lit("SELECT "), text))

    return let(text, with_verb)


def extract_with_reasoning(raw: Column) -> Column:
    """``struct<sql, reasoning, status>``: the first fenced block, and the text before it.

    Without a closed block the status is ``Failure`` and the reasoning is null.
    """
    start = F.instr(raw, FENCE)
    after = F.substr(raw, start + F.lit(len(FENCE)))
    found = (start > 0) & (F.instr(after, FENCE) > 0)
    body = F.substring_index(after, FENCE, 1)
    sql = strip(F.regexp_replace(body, r"(?i)^(?:sqlite|sql)", ""))
    return F.struct(
        F.when(found, sql).otherwise(S.NO_SQL_BLOCK).alias("sql"),
        F.when(found, strip(F.substring_index(raw, FENCE, 1))).alias("reasoning"),
        F.when(found, S.SUCCESS).otherwise(S.FAILURE).alias("status"),
    )


def extract_sql(raw: Column) -> Column:
    """The submitted statement in a model's answer, closed by a semicolon; empty if there is none.

    Tried in turn: a block marked as SQL; everything from the first line that begins with a
    SELECT or WITH clause; the whole answer, if it mentions SELECT at all.
    """

    def filled(text: Column) -> Column:
        return let(text, lambda text: F.when(text != "", text))

    def pick(answer: Column) -> Column:
        block = strip(F.regexp_extract(answer, r"(?is)```sql\n(.*?)\n```", 1))
        tail = F.regexp_extract(answer, r"(?Udims)^[^\S\n]*((?:select|with) [^\n]*?\S.*)", 1)
        whole = F.when(F.contains(F.upper(answer), F.lit("SELECT")), answer)
        return F.coalesce(filled(block), filled(tail), whole, F.lit(""))

    def close(sql: Column) -> Column:
        closed = (sql == "") | F.endswith(sql, F.lit(";"))
        return F.when(closed, sql).otherwise(F.concat(sql, F.lit(";")))

    thought = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?s)<think>.*?</think>", "")
    return let(strip(F.replace(let(strip(thought), pick), F.lit(FENCE), F.lit(""))), close)


def canonical_name(name: Column) -> Column:
    """A column name without quotes, in lower case, for look-up."""
    return F.lower(F.translate(strip(name), "`\"'", ""))


def quote_ident(name: Column) -> Column:
    """A double-quoted identifier; quotes inside are doubled."""
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def safe_id(raw_id: Column) -> Column:
    """An id usable as a file name: everything but letters, digits, ``_`` and ``-`` becomes ``_``."""
    return F.regexp_replace(raw_id, r"(?U)[^\w\-]", "_")


def truncate_cell(cell: Column, size: int = S.MAX_CELL_CHARS) -> Column:
    """A cell cut to ``size`` characters, with dots behind if anything was cut."""
    return F.when(F.length(cell) > size, F.concat(F.substring(cell, 1, size), F.lit("..."))).otherwise(cell)


def format_prediction(sql: Column, db_id: Column) -> Column:
    """A submission value: statement, separator, database."""
    return F.concat(sql, F.lit(S.PREDICTION_SEPARATOR), db_id)


def parse_prediction(value: Column) -> Column:
    """``struct<sql, db_id>`` of a submission value."""
    return F.struct(
        F.substring_index(value, S.PREDICTION_SEPARATOR, 1).alias("sql"),
        F.when(
            F.contains(value, F.lit(S.PREDICTION_SEPARATOR)),
            F.substring_index(value, S.PREDICTION_SEPARATOR, -1),
        ).alias("db_id"),
    )


def exact_match(predicted: Column, gold: Column) -> Column:
    """Whether two texts agree but for white space at their ends."""
    return strip(predicted) == strip(gold)
