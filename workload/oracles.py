"""SQL for DuckDB that computes what the registered queries should return.

Written from the meaning of each operator, in other terms than the Spark code where there is a
choice: greedy fills as ordered slots, results compared by set difference, texts by aggregation.
"""

from __future__ import annotations

from string import Formatter

from sqlcorpus import schemas as S
from sqlcorpus.functions import prompts as P
from workload import fixtures as X
from workload.queries import TEMPLATE

LEVEL_NAMES = [S.LEVEL_4, S.LEVEL_3, S.LEVEL_2, S.LEVEL_1]


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


QUESTIONS = X.duck(X.QUESTIONS)
RESULTS = X.duck(X.RESULTS)
RESPONSES = X.duck(X.RESPONSES)
GENERATIONS = X.duck(X.GENERATIONS)
LONG_ANSWERS = X.duck(X.LONG_ANSWERS)


def label(sql: str) -> str:
    text = f"upper(coalesce({sql}, ''))"
    selects = rf"len(regexp_extract_all({text}, '\bSELECT\b'))"
    linked = f"regexp_matches({text}, 'JOIN|UNION|INTERSECT|EXCEPT')"
    return (
        f"CASE WHEN {linked} THEN CASE WHEN {selects} > 1 THEN {lit(S.LEVEL_4)} ELSE {lit(S.LEVEL_3)} END "
        f"WHEN {selects} > 1 THEN {lit(S.LEVEL_2)} WHEN {text} LIKE '%SELECT%' THEN {lit(S.LEVEL_1)} "
        f"ELSE {lit(S.LEVEL_OTHER)} END"
    )


CTES = {
    "questions": QUESTIONS,
    "labelled": f"SELECT *, {label('gold_sql')} AS level FROM questions",
    "results": RESULTS,
    "responses": RESPONSES,
    "triaged": """
        SELECT q.question_id, q.db_id, coalesce(r.level, q.level) AS level,
         CASE WHEN r.question_id IS NULL THEN 'candidate'
          WHEN r.generation_status = 'Success' AND r.execution_match IS TRUE THEN 'success' ELSE 'failed' END AS cache_state
        FROM labelled q LEFT JOIN (SELECT * FROM results WHERE _corrupt_record IS NULL) r ON q.question_id = r.question_id""",
    "domains": """
        SELECT db_id, CASE WHEN place <= floor(n * 0.8) THEN 'in_domain' ELSE 'out_of_domain' END AS domain
        FROM (SELECT db_id, row_number() OVER (ORDER BY md5('42:' || db_id), db_id) AS place, count(*) OVER () AS n
         FROM (SELECT DISTINCT db_id FROM questions))""",
    "existing": """
        SELECT question_id, db_id, level, CASE CAST(question_id AS BIGINT) % 97 WHEN 1 THEN 'train' WHEN 2 THEN 'val_in_domain' ELSE 'val_out_of_domain' END AS split
        FROM labelled WHERE CAST(question_id AS BIGINT) % 97 IN (1, 2, 3)""",
    "placed": """
        SELECT question_id, db_id, level, CASE CAST(question_id AS BIGINT) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val_in_domain' ELSE 'val_out_of_domain' END AS split
        FROM labelled""",
    "success": "SELECT question_id, db_id, level FROM triaged WHERE cache_state = 'success'",
    "passed": """
        SELECT question_id, db_id, level FROM triaged WHERE cache_state = 'candidate' AND question_id IN
         (SELECT question_id FROM responses WHERE generation_status = 'Success' AND execution_match)""",
    "levels": "SELECT unnest([" + ", ".join(map(lit, LEVEL_NAMES)) + "]) AS level, unnest([0, 1, 2, 3]) AS level_no",
}

TRIAGED = ["questions", "labelled", "results", "triaged"]
POOLS = [*TRIAGED, "responses", "domains", "existing", "success", "passed", "levels"]


def build(final: str, names: list[str], **more: str) -> str:
    parts = [f"{name} AS ({CTES[name]})" for name in names]
    parts += [f"{name} AS ({text})" for name, text in more.items()]
    return f"WITH {', '.join(parts)} {final}"


PICKED = "question_id, db_id, level, split, stage"


def shuffled(pool: str, by: str = "") -> str:
    """Rows of a pool with their place in the shuffled order."""
    return (
        f"SELECT *, row_number() OVER ({by} ORDER BY md5('42:' || question_id), question_id) AS place FROM {pool}"
    )


def unused(pool: str, *used: str) -> str:
    parts = " ".join(f"AND question_id NOT IN (SELECT question_id FROM {name})" for name in used)
    return f"(SELECT * FROM {pool} WHERE true {parts})"


def held(rows: str) -> str:
    """Rows by label in train and validation."""
    return (
        f"SELECT level, level_no, (SELECT count(*) FROM {rows} r WHERE r.level = l.level AND split = 'train') AS tc, "
        f"(SELECT count(*) FROM {rows} r WHERE r.level = l.level AND split = 'val_in_domain') AS vc FROM levels l"
    )


def dual(pool: str, held_name: str, train: int, val: int, stage: str) -> str:
    """Fill both splits by walking places in the order of their fill ratios."""
    return f"""
        SELECT p.question_id, p.db_id, p.level, s.split, '{stage}' AS stage, s.slot, s.level_no
        FROM ({shuffled(pool, 'PARTITION BY level')}) p JOIN
        (SELECT *, row_number() OVER (PARTITION BY level ORDER BY ratio, priority) AS slot FROM
         (SELECT level, level_no, 'train' AS split, 0 AS priority, CAST(j AS DOUBLE) / {train} AS ratio
          FROM (SELECT *, unnest(generate_series(tc, {train} - 1)) AS j FROM {held_name})
          UNION ALL SELECT level, level_no, 'val_in_domain', 1, CAST(j AS DOUBLE) / {val}
          FROM (SELECT *, unnest(generate_series(vc, {val} - 1)) AS j FROM {held_name}))) s
        ON p.level = s.level AND p.place = s.slot"""


def dual_capped(pool: str, held_name: str, train: int, val: int, stage: str, rows: str) -> str:
    """The same while both splits have room in all, label by label."""
    return f"""
        SELECT {PICKED} FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY level_no, slot) AS total
         FROM ({dual(pool, held_name, train, val, stage)})) f
        WHERE total <= (CASE split WHEN 'train' THEN {4 * train} ELSE {4 * val} END) - (SELECT count(*) FROM {rows} r WHERE r.split = f.split)"""


def single(pool: str, rows: str, target: int, stage: str) -> str:
    """Fill one split label by label, while there is room in all."""
    of_split = f"{rows} r WHERE r.split = 'val_out_of_domain'"
    return f"""
        SELECT question_id, db_id, level, 'val_out_of_domain' AS split, '{stage}' AS stage FROM
        (SELECT *, row_number() OVER (ORDER BY level_no, place) AS total FROM ({shuffled(pool, 'PARTITION BY level')}) p JOIN levels USING (level)
         WHERE place <= {target} - (SELECT count(*) FROM {of_split} AND r.level = p.level))
        WHERE total <= {4 * target} - (SELECT count(*) FROM {of_split})"""


def backfill(pool: str, val: str, train: str, stage: str) -> str:
    return f"""
        SELECT question_id, db_id, level, CASE WHEN place <= {val} THEN 'val_in_domain' ELSE 'train' END AS split, '{stage}' AS stage
        FROM ({shuffled(pool)}) WHERE place <= {val} + {train}"""


def cover(pool: str, rows: str, density: str, budget: str, split: str) -> str:
    thin = f"""
        SELECT question_id, db_id, level FROM ({shuffled(pool, 'PARTITION BY db_id')}) p
        WHERE place <= {density} - (SELECT count(*) FROM {rows} r WHERE r.db_id = p.db_id)"""
    return f"""
        SELECT question_id, db_id, level, '{split}' AS split, '3.1' AS stage
        FROM ({shuffled(f'({thin})')}) WHERE place <= {budget}"""



def in_domain_chain(train: int, val: int) -> dict[str, str]:
    """The stages of both in-domain splits; sizes are by label."""
    inside = "db_id IN (SELECT db_id FROM domains WHERE domain = 'in_domain')"
    missing = {
        split: f"greatest(0, {size} - (SELECT count(*) FROM {{}} WHERE split = '{split}'))"
        for split, size in (("train", 4 * train), ("val_in_domain", 4 * val))
    }
    surplus = f"greatest(0, (SELECT count(*) FROM done3 WHERE split = 'train') - {4 * train})"
    budget = f"greatest(0, CAST(floor({4 * train} * 0.2) AS BIGINT) - {surplus})"
    density = f"(CASE WHEN {budget} >= (SELECT count(*) FROM domains WHERE domain = 'in_domain') THEN 2 ELSE 1 END)"
    return {
        "pool": f"SELECT * FROM success WHERE {inside}",
        "asked": f"SELECT * FROM passed WHERE {inside}",
        "held0": "SELECT level, level_no, 0 AS tc, 0 AS vc FROM levels",
        "stage1": f"SELECT {PICKED} FROM ({dual('pool', 'held0', train, val, '1')})",
        "held1": held("stage1"),
        "stage2": f"SELECT {PICKED} FROM ({dual('asked', 'held1', train, val, '2')})",
        "done2": "SELECT * FROM stage1 UNION ALL SELECT * FROM stage2",
        "stage3": backfill(
            unused("pool", "done2"), missing["val_in_domain"].format("done2"), missing["train"].format("done2"), "3"
        ),
        "done3": "SELECT * FROM done2 UNION ALL SELECT * FROM stage3",
        "stage31": cover(unused("asked", "done3"), "done3", density, budget, "train"),
        "done31": "SELECT * FROM done3 UNION ALL SELECT * FROM stage31",
        "stage4": backfill(
            unused("asked", "done31"), missing["val_in_domain"].format("done31"), missing["train"].format("done31"), "4"
        ),
        "in_domain_rows": "SELECT * FROM done31 UNION ALL SELECT * FROM stage4",
    }


def out_of_domain_chain(size: int) -> dict[str, str]:
    outside = "db_id IN (SELECT db_id FROM domains WHERE domain = 'out_of_domain')"
    missing = f"greatest(0, {4 * size} - (SELECT count(*) FROM {{}}))"
    budget = f"greatest(0, CAST(floor({4 * size} * 0.2) AS BIGINT) - greatest(0, (SELECT count(*) FROM odone3) - {4 * size}))"

    def rest(pool: str, done: str, stage: str) -> str:
        return (
            f"SELECT question_id, db_id, level, 'val_out_of_domain' AS split, '{stage}' AS stage "
            f"FROM ({shuffled(unused(pool, done))}) WHERE place <= {missing.format(done)}"
        )

    return {
        "opool": f"SELECT * FROM success WHERE {outside}",
        "oasked": f"SELECT * FROM passed WHERE {outside}",
        "ostage0": f"SELECT {PICKED} FROM (SELECT *, '' AS stage FROM existing) WHERE false",
        "ostage1": single("opool", "ostage0", size, "1"),
        "ostage2": single("oasked", "ostage1", size, "2"),
        "odone2": "SELECT * FROM ostage1 UNION ALL SELECT * FROM ostage2",
        "ostage3": rest("opool", "odone2", "3"),
        "odone3": "SELECT * FROM odone2 UNION ALL SELECT * FROM ostage3",
        "ostage31": cover(unused("oasked", "odone3"), "odone3", "1", budget, "val_out_of_domain"),
        "odone31": "SELECT * FROM odone3 UNION ALL SELECT * FROM ostage31",
        "ostage4": rest("oasked", "odone31", "4"),
        "out_of_domain_rows": "SELECT * FROM odone31 UNION ALL SELECT * FROM ostage4",
    }


GAPPY = f"""SELECT question_id, CASE WHEN CAST(question_id AS BIGINT) % 11 <> 0 THEN db_id END AS db_id, gold_sql,
 CASE WHEN CAST(question_id AS BIGINT) % 13 = 0 THEN '' WHEN CAST(question_id AS BIGINT) % 17 <> 0 THEN level END AS level
 FROM labelled"""

BLOCK_OPEN = "repeat(chr(96), 3)"


def extracted(raw: str) -> str:
    """The submission statement of a table of ``question_id, raw_content``."""
    return rf"""
        SELECT question_id, CASE WHEN sql = '' OR ends_with(sql, ';') THEN sql ELSE sql || ';' END AS sql FROM (
         SELECT question_id, {strip("replace(CASE WHEN block <> '' THEN block WHEN first_line > 0 THEN array_to_string(lines[first_line:], chr(10)) WHEN contains(upper(answer), 'SELECT') THEN answer ELSE '' END, " + BLOCK_OPEN + ", '')")} AS sql FROM (
          SELECT *, coalesce(list_position([starts_with(upper({strip('line')}), 'SELECT ') OR starts_with(upper({strip('line')}), 'WITH ') for line in lines], true), 0) AS first_line FROM (
           SELECT question_id, answer, string_split(answer, chr(10)) AS lines,
            {strip("regexp_extract(answer, '(?is)[`][`][`]sql" + chr(92) + "n(.*?)" + chr(92) + "n[`][`][`]', 1)")} AS block FROM (
             SELECT question_id, {strip("regexp_replace(coalesce(raw_content, ''), '(?s)<think>.*?</think>', '', 'g')")} AS answer FROM ({raw})))))"""


def fenced(raw: str) -> str:
    """Statement, reasoning and status of a table of ``question_id, raw_content``."""
    return rf"""
        SELECT question_id, CASE WHEN found THEN {strip("regexp_extract(raw_content, '(?is)[`][`][`](?:sqlite|sql)?(.*?)[`][`][`]', 1)")} ELSE {lit(S.NO_SQL_BLOCK)} END AS sql,
         CASE WHEN found THEN {strip("string_split(raw_content, " + BLOCK_OPEN + ")[1]")} END AS reasoning,
         CASE WHEN found THEN 'Success' ELSE 'Failure' END AS status
        FROM (SELECT *, coalesce(regexp_matches(raw_content, '(?s)[`][`][`].*[`][`][`]'), false) AS found FROM ({raw}))"""


PREDICTIONS = f"SELECT g.question_id, g.sql, q.db_id FROM ({extracted(GENERATIONS)}) g JOIN ({QUESTIONS}) q USING (question_id)"

# Schema catalog of the customers, one row a column.
CATALOG = {
    "tabs": f"""SELECT c_custkey AS ck, 'db_' || CASE WHEN c_custkey < 10 THEN '0' ELSE '' END || c_custkey AS db_id, c_name,
        CAST(t AS INTEGER) AS table_idx, CASE t WHEN 0 THEN 'Client' WHEN 1 THEN 'orders' ELSE 'Line"Item' END AS table_name,
        CASE t WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN 'orders' ELSE ' ' END AS table_friendly
        FROM (SELECT *, unnest(generate_series(0, c_custkey % 3)) AS t FROM customer)""",
    "cols": """SELECT *, CASE (ck + j) % 3 WHEN 0 THEN col_name WHEN 1 THEN ' ' ELSE c_name || ' field ' || j END AS col_friendly,
        CAST(row_number() OVER (PARTITION BY ck ORDER BY table_idx, j) AS INTEGER) AS col_idx
        FROM (SELECT *, CASE j WHEN 0 THEN 'KeyNo' || table_idx WHEN 1 THEN 'note' WHEN 2 THEN 'photo' WHEN 3 THEN 'Price' ELSE 'extra col' END AS col_name,
         CASE j WHEN 1 THEN 'text' WHEN 2 THEN 'Blob' WHEN 3 THEN 'real' ELSE 'integer' END AS col_type
         FROM (SELECT *, unnest(generate_series(0, 2 + (ck + table_idx) % 3)) AS j FROM tabs))""",
    "pks": """SELECT ck, db_id, table_idx AS pk_no, table_name, (ck + table_idx) % 2 = 1 AS composite,
        'KeyNo' || table_idx || CASE WHEN (ck + table_idx) % 2 = 1 THEN ', note' ELSE '' END AS columns FROM tabs""",
    "fks": """SELECT ck, db_id, CAST(table_idx - 1 AS INTEGER) AS fk_no, table_name AS from_table, 'note' AS from_column,
        'Client' AS to_table, 'KeyNo0' AS to_column FROM tabs WHERE table_idx > 0""",
    "described": """SELECT c.ck, c.db_id, c.table_idx, c.table_name, 'Table: ' || c.table_name
        || CASE WHEN trim(any_value(table_friendly)) <> '' AND any_value(table_friendly) <> c.table_name
         THEN chr(10) || '  Human-friendly Table name: ' || any_value(table_friendly) ELSE '' END || chr(10)
        || string_agg('  Column ' || col_name || ': Type -> ' || col_type
         || CASE WHEN trim(col_friendly) = '' THEN '' ELSE ', Desc -> ' || col_friendly END, chr(10) ORDER BY j) AS description
        FROM cols c GROUP BY c.ck, c.db_id, c.table_idx, c.table_name""",
}
LEGEND = " || chr(10) || ".join(
    lit(line) for line in (
        "Legend:", "  Human-friendly name: Real-world name for table/column.",
        "  Desc: Description or human-friendly name of the column.", "  PKs: Primary Keys.", "  FKs: Foreign Keys.",
    )
)

SAMPLES = {
    "picked": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db_id, table_idx ORDER BY o_orderkey) AS row_no FROM ({X.duck(X.SAMPLE_SOURCE)})) WHERE row_no <= 3",
    "cells": """SELECT db_id, table_idx, row_no, pos, coalesce(CASE WHEN length(cell) > 50 THEN left(cell, 50) || '...' ELSE cell END, 'None') AS cell
        FROM (SELECT db_id, table_idx, row_no, width, 0 AS pos, CAST(o_orderkey AS VARCHAR) AS cell FROM picked
         UNION ALL SELECT db_id, table_idx, row_no, width, 1, note FROM picked
         UNION ALL SELECT db_id, table_idx, row_no, width, 2, CAST(o_totalprice AS VARCHAR) FROM picked
         UNION ALL SELECT db_id, table_idx, row_no, width, 3, CAST(extra AS VARCHAR) FROM picked) WHERE pos < width""",
}


def context(n: int) -> dict[str, str]:
    """CTEs that end in ``context_<n>``, the schema text with n sample rows."""
    block = f"(SELECT text FROM blocks_{n} b WHERE b.db_id = d.db_id AND b.table_idx = d.table_idx)"
    return {
        f"lines_{n}": f"""SELECT db_id, table_idx, 0 AS row_no, CAST(row_number() OVER (PARTITION BY ck, table_idx ORDER BY j) - 1 AS INTEGER) AS pos, col_name AS cell
            FROM cols WHERE col_type <> 'Blob' UNION ALL SELECT * FROM cells WHERE row_no <= {n}""",
        f"sized_{n}": f"SELECT *, max(length(cell)) OVER (PARTITION BY db_id, table_idx, pos) AS width FROM lines_{n}",
        f"rows_{n}": f"SELECT db_id, table_idx, row_no, string_agg(lpad(cell, CAST(width AS INTEGER), ' ') || ' ', '' ORDER BY pos) AS line FROM sized_{n} GROUP BY ALL",
        f"blocks_{n}": f"""SELECT r.db_id, r.table_idx, '/*' || chr(10) || max(row_no) || ' rows from ' || any_value(table_name) || ' table:' || chr(10)
            || string_agg('  ' || line, chr(10) ORDER BY row_no) || chr(10) || '*/' || chr(10) AS text
            FROM rows_{n} r JOIN tabs t ON t.db_id = r.db_id AND t.table_idx = r.table_idx GROUP BY r.db_id, r.table_idx HAVING max(row_no) > 0""",
        f"context_{n}": f"""SELECT d.db_id, string_agg(description || chr(10) || coalesce({block}, '') || chr(10), '' ORDER BY table_idx) || {LEGEND} AS text
            FROM described d GROUP BY d.db_id""",
    }


CONTEXTS = {**CATALOG, **SAMPLES, **context(3), **context(1), **context(0)}


def prompt(context_text: str, instructions: str = "''") -> str:
    slots = {
        P.CONTEXT_SLOT: f"coalesce({context_text}, '/* No schema metadata available for ' || q.db_id || '. */')", P.QUESTION_SLOT: "question",
        P.HINT_SLOT: "coalesce(evidence, '')", P.FORMAT_SLOT: instructions,
    }
    parts = []
    for literal, slot, _, _ in Formatter().parse(TEMPLATE):
        parts += [lit(literal)] if literal else []
        parts += [slots[slot]] if slot else []
    return " || ".join(parts)


BAKED = f"""
    SELECT rtrim({prompt('c.text')}, chr(10) || ' ') || chr(10) AS prompt,
     final_reasoning || chr(10) || chr(10) || '## SQL Query:' || chr(10) || predicted_sql AS completion, q.db_id, predicted_sql AS teacher_sql,
     CASE CAST(q.question_id AS BIGINT) % 5 WHEN 0 THEN 'val_in_domain' WHEN 1 THEN 'val_out_of_domain' ELSE 'train' END AS split
    FROM questions q JOIN results r ON q.question_id = r.question_id LEFT JOIN context_3 c ON c.db_id = q.db_id
    WHERE execution_match IS TRUE AND _corrupt_record IS NULL"""

COMPARED = {
    "result_rows": X.duck(X.RESULT_ROWS),
    "runs": X.duck(X.EXECUTIONS),
    "unmatched": """SELECT DISTINCT pair_id FROM (
        (SELECT pair_id, c1, c2 FROM result_rows WHERE side = 'gold' EXCEPT SELECT pair_id, c1, c2 FROM result_rows WHERE side = 'pred')
        UNION ALL (SELECT pair_id, c1, c2 FROM result_rows WHERE side = 'pred' EXCEPT SELECT pair_id, c1, c2 FROM result_rows WHERE side = 'gold'))""",
    "tallies": "SELECT pair_id, count(*) FILTER (side = 'gold') AS g, count(*) FILTER (side = 'pred') AS p FROM result_rows GROUP BY pair_id",
    "compared": """SELECT CAST(r.pair_id AS VARCHAR) AS pair_id, gold_ok AS gold_exec_status, gold_ok AND pred_ok AS predict_exec_status,
        gold_ok AND pred_ok AND u.pair_id IS NULL AS match_status,
        CASE WHEN gold_ok AND pred_ok THEN coalesce(g, 0) ELSE 0 END AS num_gold_rows,
        CASE WHEN gold_ok AND pred_ok THEN coalesce(p, 0) ELSE 0 END AS num_predicted_rows,
        CAST(CASE WHEN gold_ok AND pred_ok AND g > 0 THEN 2 ELSE 0 END AS INTEGER) AS num_gold_cols,
        CAST(CASE WHEN gold_ok AND pred_ok AND p > 0 THEN 2 ELSE 0 END AS INTEGER) AS num_predicted_cols,
        CASE WHEN gold_ok AND pred_ok THEN 'part,quantity' ELSE '' END AS gold_cols,
        CASE WHEN gold_ok AND pred_ok THEN 'part,n' || (r.pair_id % 3) ELSE '' END AS predicted_cols,
        CASE WHEN gold_ok THEN error_msg END AS error_msg
        FROM runs r LEFT JOIN unmatched u ON r.pair_id = u.pair_id LEFT JOIN tallies t ON r.pair_id = t.pair_id""",
}

SCORED = {
    "made": extracted(GENERATIONS),
    **COMPARED,
    "scored": """SELECT l.level, m.sql = 'SELECT ' || o_custkey || ';' AS exact, coalesce(match_status, false) AS hit,
        coalesce(gold_exec_status, false) AS gold_ok, coalesce(predict_exec_status, false) AS pred_ok
        FROM made m JOIN labelled l ON m.question_id = l.question_id JOIN orders ON CAST(o_orderkey AS VARCHAR) = m.question_id
        LEFT JOIN compared c ON c.pair_id = m.question_id""",
}
METRICS = """CAST(count(*) FILTER (exact) AS DOUBLE) * 100 / count(*) AS exact_match_accuracy,
    CAST(count(*) FILTER (hit) AS DOUBLE) * 100 / count(*) AS execution_accuracy, count(*) AS total_samples,
    count(*) FILTER (NOT gold_ok) AS gold_query_execution_failures, count(*) FILTER (NOT pred_ok) AS predicted_query_execution_failures,
    count(*) FILTER (gold_ok AND NOT pred_ok) AS predicted_failures_given_gold_ok FROM scored"""


def distribution(source: str) -> str:
    return f"""WITH counts AS (SELECT {label('x')} AS level, count(*) AS n FROM ({source}) GROUP BY 1)
        SELECT level, n, CAST(n AS DOUBLE) * 100 / (SELECT sum(n) FROM counts) AS pct FROM counts
        UNION ALL SELECT 'Total', CAST(sum(n) AS BIGINT), 100.0 FROM counts"""


QUOTA = " UNION ALL ".join(
    f"SELECT '{split}' AS split, level, CAST({size} AS BIGINT) AS target FROM levels UNION ALL SELECT '{split}', {lit(S.LEVEL_OTHER)}, 0"
    for split, size in (("train", 500), ("val_in_domain", 25))
)

OTHERS = f"SELECT * FROM existing WHERE level = {lit(S.LEVEL_OTHER)}"


def offered(pool: str) -> dict[str, str]:
    return {"offered": f"SELECT * FROM {unused(pool, 'existing')}"}


DDL_REMARK = "CASE WHEN trim({0}) <> '' AND {0} <> {1} THEN ' -- ' || {0} ELSE '' END"


def ddl(annotate: bool) -> str:
    column_remark = DDL_REMARK.format("col_friendly", "col_name") if annotate else "''"
    table_remark = DDL_REMARK.format("table_friendly", "t.table_name") if annotate else "''"
    between = "chr(10) || chr(10)" if annotate else "chr(10)"
    return build(
        f"""SELECT t.db_id, string_agg('CREATE TABLE "' || replace(t.table_name, '"', '""') || '" (' || {table_remark} || chr(10) || body || chr(10) || ')', {between} ORDER BY t.table_idx) AS ddl
        FROM tabs t JOIN bodies b ON t.db_id = b.db_id AND t.table_idx = b.table_idx GROUP BY t.db_id""",
        [],
        **CATALOG,
        parts=f"""SELECT db_id, table_idx, 0 AS kind, j AS seq, '    "' || col_name || '" ' || col_type AS line, {column_remark} AS remark FROM cols
            UNION ALL SELECT db_id, pk_no, 1, 0, '    PRIMARY KEY ("' || replace(columns, ', ', '", "') || '")', '' FROM pks
            UNION ALL SELECT db_id, fk_no + 1, 2, 0, '    FOREIGN KEY ("' || from_column || '") REFERENCES "' || to_table || '" ("' || to_column || '")', '' FROM fks""",
        bodies="""SELECT db_id, table_idx, string_agg(line || CASE WHEN is_last THEN '' ELSE ',' END || remark, chr(10) ORDER BY kind, seq) AS body
            FROM (SELECT *, lead(line) OVER (PARTITION BY db_id, table_idx ORDER BY kind, seq) IS NULL AS is_last FROM parts) GROUP BY db_id, table_idx""",
    )


ORACLES: dict[str, str] = {
    "sql_features": rf"""SELECT question_id, CAST(len(regexp_extract_all(u, '\bSELECT\b')) AS INTEGER) AS select_count,
        contains(u, 'JOIN') AS has_join, regexp_matches(u, 'UNION|INTERSECT|EXCEPT') AS has_set_op
        FROM (SELECT question_id, upper(coalesce(gold_sql, '')) AS u FROM ({QUESTIONS}))""",
    "classify_sql": build("SELECT question_id, level FROM labelled", ["questions", "labelled"]),
    "classify_sql_word_bounded": rf"""SELECT question_id, CASE
        WHEN linked AND n > 1 THEN {lit(S.LEVEL_4)} WHEN linked THEN {lit(S.LEVEL_3)} WHEN n > 1 THEN {lit(S.LEVEL_2)}
        WHEN n = 1 THEN {lit(S.LEVEL_1)} ELSE {lit(S.LEVEL_OTHER)} END AS level
        FROM (SELECT question_id, len([w for w in words if w = 'SELECT']) AS n, list_has_any(words, ['JOIN', 'UNION', 'INTERSECT', 'EXCEPT']) AS linked
         FROM (SELECT question_id, regexp_split_to_array(upper(coalesce(gold_sql, '')), '\W+') AS words FROM ({QUESTIONS})))""",
    "level_distribution": distribution(f"SELECT gold_sql AS x FROM ({QUESTIONS})"),
    "level_distribution_documents": distribution("SELECT text AS x FROM documents"),
    "assign_question_id": """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0
        THEN CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS VARCHAR) ELSE 'q' || o_orderkey END AS question_id FROM orders""",
    "assign_question_id_by_file": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0
        THEN CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS VARCHAR) ELSE 'q' || o_orderkey END AS question_id FROM orders""",
    "validate_questions": build(
        "SELECT question_id, db_id, level FROM gappy WHERE db_id IS NOT NULL AND length(level) > 0",
        ["questions", "labelled"], gappy=GAPPY,
    ),
    "validation_report": build(
        """SELECT count(*) AS total, count(*) FILTER (db_id IS NOT NULL AND level <> '') AS valid,
        count(*) - count(question_id) AS missing_question_id, count(*) - count(db_id) AS missing_db_id,
        count(*) - count(gold_sql) AS missing_sql, count(*) - count(nullif(level, '')) AS missing_level FROM gappy""",
        ["questions", "labelled"], gappy=GAPPY,
    ),
    "triage_questions": build("SELECT * FROM triaged", TRIAGED),
    "merge_result": build(
        """SELECT l.question_id, l.db_id, coalesce(r.level, l.level) AS level, predicted_sql, generation_status, execution_match
        FROM labelled l LEFT JOIN (SELECT * FROM results WHERE _corrupt_record IS NULL) r ON l.question_id = r.question_id""",
        ["questions", "labelled", "results"],
    ),
    "first_result": """SELECT l_orderkey AS question_id, l_partkey, l_extendedprice FROM
        (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey) AS n FROM lineitem) WHERE n = 1""",
    "split_domains": build("SELECT * FROM domains", ["questions", "domains"]),
    "split_statistics": build(
        "SELECT domain, cache_state, count(*) AS n FROM triaged JOIN domains USING (db_id) GROUP BY ALL", [*TRIAGED, "domains"]
    ),
    "in_domain": build(
        "SELECT question_id, db_id FROM questions JOIN domains USING (db_id) WHERE domain = 'out_of_domain'", ["questions", "domains"]
    ),
    "remaining": build(
        "SELECT question_id, db_id FROM questions WHERE question_id NOT IN (SELECT question_id FROM results WHERE execution_match IS TRUE)",
        ["questions", "results"],
    ),
    "new_results": build(
        "SELECT question_id, generation_status FROM responses WHERE question_id NOT IN (SELECT question_id FROM results)",
        ["results", "responses"],
    ),
    "locked_ids": build("SELECT DISTINCT question_id FROM placed", ["questions", "labelled", "placed"]),
    "missing_databases": build(
        f"(SELECT DISTINCT db_id FROM questions UNION SELECT 'db_' || n_name FROM nation) EXCEPT SELECT db_id FROM placed WHERE level = {lit(S.LEVEL_2)} AND split = 'train'",
        ["questions", "labelled", "placed"],
    ),
    "target_counts": build(
        f"""SELECT o_custkey, size, level, r + CASE WHEN level_no < abs(rest) THEN sign(rest) ELSE 0 END AS target FROM
        (SELECT *, size - 4 * r AS rest FROM (SELECT *, CAST(round_even(size * CAST(0.25 AS DOUBLE), 0) AS BIGINT) AS r
         FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1))) JOIN levels ON true
        UNION ALL SELECT o_custkey, count(*), {lit(S.LEVEL_OTHER)}, 0 FROM orders GROUP BY 1""",
        ["levels"],
    ),
    "target_counts_strict": f"""WITH shares AS (SELECT * FROM (VALUES (0, {lit(S.LEVEL_4)}, 0.35), (1, {lit(S.LEVEL_3)}, 0.3),
         (2, {lit(S.LEVEL_2)}, 0.2), (3, {lit(S.LEVEL_1)}, 0.15), (4, {lit(S.LEVEL_OTHER)}, 0.0)) AS v(i, level, share)),
        rounded AS (SELECT p_partkey, size, i, level, CAST(round_even(CAST(share AS DOUBLE) * size, 0) AS BIGINT) AS r
         FROM (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS size FROM part), shares),
        rests AS (SELECT *, size - sum(r) OVER (PARTITION BY p_partkey) AS rest FROM rounded)
        SELECT p_partkey, size, level, CAST(r + CASE WHEN row_number() OVER (PARTITION BY p_partkey ORDER BY sign(rest) * r, i) <= abs(rest) THEN sign(rest) ELSE 0 END AS BIGINT) AS target FROM rests""",
    "fill_single": build(
        f"SELECT {PICKED} FROM ({single('(SELECT * FROM success WHERE question_id NOT IN (SELECT question_id FROM held_out))', 'held_out', 400, '1')})",
        POOLS, held_out="SELECT * FROM existing WHERE split = 'val_out_of_domain'",
    ),
    "fill_dual": build(dual_capped("offered", "held", 1500, 200, "1", "existing"), POOLS, held=held("existing"), **offered("success")),
    "fill_dual_capped": build(
        dual_capped("offered", "held", 100, 25, "1", "others"),
        POOLS, others=OTHERS, held=held("others"), offered=f"SELECT * FROM {unused('success', 'others')}",
    ),
    "pending": build(
        """SELECT split, level, target, coalesce(n, 0) AS filled, greatest(target - coalesce(n, 0), 0) AS need FROM quota
        LEFT JOIN (SELECT split, level, count(*) AS n FROM placed GROUP BY ALL) USING (split, level)""",
        ["questions", "labelled", "placed", "levels"], quota=QUOTA,
    ),
    "unfilled_levels": build(
        """SELECT level FROM levels l WHERE (SELECT count(*) FROM placed e WHERE e.level = l.level AND split = 'train') < 1000
        OR (SELECT count(*) FROM placed e WHERE e.level = l.level AND split = 'val_in_domain') < 3""",
        ["questions", "labelled", "placed", "levels"],
    ),
    "target_vs_filled": build(
        """SELECT *, CASE WHEN target > 0 THEN CAST(filled AS DOUBLE) * 100 / target ELSE 0.0 END AS pct_filled FROM (
         SELECT split, level, target, (SELECT count(*) FROM placed e WHERE e.split = q.split AND e.level = q.level) AS filled FROM quota q
         UNION ALL SELECT split, 'Total', CAST(sum(target) AS BIGINT), (SELECT count(*) FROM placed e WHERE e.split = q.split) FROM quota q GROUP BY split)""",
        ["questions", "labelled", "placed", "levels"], quota=QUOTA,
    ),
    "verify_fill_dual": build(dual_capped("offered", "held", 1500, 200, "2", "existing"), POOLS, held=held("existing"), **offered("passed")),
    "verify_fill_single": build(f"SELECT {PICKED} FROM ({single('offered', 'existing', 400, '2')})", POOLS, **offered("passed")),
    "backfill_dual": build(backfill("offered", "120", "700", "3"), POOLS, **offered("success")),
    "backfill_single": build(
        f"SELECT question_id, db_id, level, 'val_out_of_domain' AS split, '3' AS stage FROM ({shuffled('offered')}) WHERE place <= 300",
        POOLS, **offered("success"),
    ),
    "cover_dual": build(
        cover(unused("passed", "held"), "held", "2", "80", "train"), POOLS, held=f"SELECT * FROM existing WHERE level = {lit(S.LEVEL_4)}"
    ),
    "cover_single": build(
        cover(unused("passed", "held"), "held", "1", "20", "val_out_of_domain"), POOLS, held=f"SELECT * FROM existing WHERE level = {lit(S.LEVEL_2)}"
    ),
    "active_fill_dual": build(backfill("offered", "50", "250", "4"), POOLS, **offered("passed")),
    "active_fill_single": build(
        f"SELECT question_id, db_id, level, 'val_out_of_domain' AS split, '4' AS stage FROM ({shuffled('offered')}) WHERE place <= 200",
        POOLS, **offered("passed"),
    ),
    "curate_in_domain_large": build("SELECT * FROM in_domain_rows", POOLS, **in_domain_chain(1500, 200)),
    "curate_out_of_domain_large": build("SELECT * FROM out_of_domain_rows", POOLS, **out_of_domain_chain(400)),
    "curate_small": build(
        "SELECT * FROM in_domain_rows UNION ALL SELECT * FROM out_of_domain_rows", POOLS,
        **in_domain_chain(10, 2), **out_of_domain_chain(10),
    ),
    "curate_small_asked": build(
        "SELECT * FROM in_domain_rows UNION ALL SELECT * FROM out_of_domain_rows", POOLS,
        **in_domain_chain(10, 2), **out_of_domain_chain(10),
    ),
    "cover_customers_asked": build(
        cover(unused("asked", "held"), "held", "2", "(SELECT 2 * count(DISTINCT db_id) FROM owners)", "train"), POOLS,
        owners=X.duck(X.OWNERS),
        asked="SELECT p.question_id, o.db_id, p.level FROM passed p JOIN owners o USING (question_id)",
        held="SELECT e.question_id, o.db_id, e.level FROM existing e JOIN owners o USING (question_id)",
    ),
    "curate_records": build(
        """SELECT q.question_id, q.db_id, q.question, q.gold_sql, coalesce(r.level, q.level) AS level, q.evidence,
        CASE WHEN stage IN ('1', '3') THEN r.predicted_sql ELSE 'SELECT ' || q.question_id END AS predicted_sql,
        CASE WHEN stage IN ('1', '3') THEN r.final_reasoning ELSE 'first' END AS final_reasoning,
        'Success' AS generation_status, true AS execution_match, NULL::BOOLEAN AS predicted_exec_status,
        NULL::VARCHAR AS error_occurred, NULL::VARCHAR AS raw_output, NULL::VARCHAR AS prompt_template_string,
        NULL::VARCHAR AS error_message, split, stage
        FROM (SELECT * FROM in_domain_rows UNION ALL SELECT * FROM out_of_domain_rows) p
        JOIN labelled q ON p.question_id = q.question_id
        LEFT JOIN (SELECT * FROM results WHERE _corrupt_record IS NULL) r ON r.question_id = p.question_id AND stage IN ('1', '3')""",
        POOLS, **in_domain_chain(10, 2), **out_of_domain_chain(10),
    ),
    "database_coverage": build(
        """SELECT db_id, count(question_id) AS n, count(question_id) = 0 AS missing FROM domains
        LEFT JOIN (SELECT db_id, question_id FROM placed WHERE split = 'train') USING (db_id) WHERE domain = 'in_domain' GROUP BY db_id""",
        ["questions", "labelled", "placed", "domains"],
    ),
    "coverage_summary": build(
        f"""SELECT covered, total, CAST(covered AS DOUBLE) * 100 / total AS pct FROM (SELECT
        (SELECT count(DISTINCT db_id) FROM placed WHERE level = {lit(S.LEVEL_2)}) AS covered, (SELECT count(DISTINCT db_id) FROM questions) AS total)""",
        ["questions", "labelled", "placed"],
    ),
    "clean_sql": rf"""SELECT o_orderkey, CASE WHEN t = '' OR regexp_matches(t, '(?i)^(select|with)\b') THEN t ELSE 'SELECT ' || t END AS cleaned FROM (
        SELECT o_orderkey, {strip("rtrim(" + strip("regexp_replace(s, '(''[^'']*''|" + '"[^"]*"' + "|[`][^`]*[`])|--[^" + chr(92) + "n]*|/[*](?:[^*]|[*]+[^*/])*[*]+/', '" + chr(92) + "1', 'g')") + ", ';')")} AS t FROM (
         SELECT o_orderkey, regexp_replace(regexp_replace({strip("coalesce(sql, '')")}, '(?i)^[`][`][`](sqlite|sql)?\s*', ''), '\s*[`][`][`]$', '') AS s FROM ({X.duck(X.DIRTY_SQL)})))""",
    "extract_with_reasoning": fenced(GENERATIONS),
    "extract_with_reasoning_documents": fenced(LONG_ANSWERS),
    "extract_sql": extracted(GENERATIONS),
    "extract_sql_documents": extracted(LONG_ANSWERS),
    "safe_id": r"SELECT page_id, regexp_replace(url, '[^\w\-]', '_', 'g') AS safe FROM pages",
    "canonical_name": f"SELECT p_partkey, lower(replace(replace(replace({strip('name')}, chr(96), ''), chr(34), ''), chr(39), '')) AS canonical FROM ({X.duck(X.NAMES)})",
    "quote_ident": f"SELECT p_partkey, chr(34) || replace(name, chr(34), chr(34) || chr(34)) || chr(34) AS quoted FROM ({X.duck(X.NAMES)})",
    "truncate_cell": "SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS cell FROM documents",
    "format_prediction": f"SELECT question_id, sql || chr(9) || '----- bird -----' || chr(9) || db_id AS value FROM ({PREDICTIONS})",
    "parse_prediction": f"SELECT question_id, sql, db_id FROM ({PREDICTIONS})",
    "submission_round_trip": f"SELECT question_id, sql, db_id FROM ({PREDICTIONS})",
    "exact_match": f"SELECT doc_id, doc_id % 3 <> 0 OR {strip('text')} = {strip('lower(text)')} AS same FROM documents",
    "catalog_tables": build("SELECT db_id, table_idx, table_name, table_friendly FROM tabs", [], **CATALOG),
    "catalog_columns": build(
        "SELECT db_id, table_idx, table_name, table_friendly, col_idx, col_name, col_friendly, col_type FROM cols", [], **CATALOG
    ),
    "lookup_catalog": build(
        "SELECT q.db_id, question_id, tables FROM questions q LEFT JOIN (SELECT db_id, CAST(count(*) AS INTEGER) AS tables FROM tabs GROUP BY 1) c ON q.db_id = c.db_id",
        ["questions"], **CATALOG,
    ),
    "latest_catalog": """SELECT 'db_' || o_custkey AS db_id, o_totalprice AS entry FROM
        (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders WHERE o_custkey % 10 <> 0) WHERE n = 1""",
    "primary_keys": build("SELECT db_id, pk_no, table_name, columns FROM pks", [], **CATALOG),
    "foreign_keys": build("SELECT db_id, fk_no, from_table, from_column, to_table, to_column FROM fks", [], **CATALOG),
    "describe_tables": build("SELECT db_id, table_idx, table_name, description FROM described", [], **CATALOG),
    "render_schema": build(
        f"""SELECT d.db_id, string_agg(description || chr(10) || chr(10), '' ORDER BY table_idx)
        || 'Primary Keys (PKs):' || chr(10) || (SELECT string_agg('  ' || table_name || '.' || CASE WHEN composite THEN '(' || columns || ')' ELSE columns END || chr(10), '' ORDER BY pk_no) FROM pks p WHERE p.db_id = d.db_id) || chr(10)
        || coalesce('Foreign Keys (FKs):' || chr(10) || (SELECT string_agg('  ' || from_table || '.' || from_column || ' -> ' || to_table || '.' || to_column || chr(10), '' ORDER BY fk_no) FROM fks f WHERE f.db_id = d.db_id) || chr(10), '')
        || {LEGEND} AS schema_text FROM described d GROUP BY d.db_id""",
        [], **CATALOG,
    ),
    "render_schema_with_rows": build(
        "SELECT a.db_id, a.text AS context_3, b.text AS context_1, c.text AS context_0 FROM context_3 a JOIN context_1 b USING (db_id) JOIN context_0 c USING (db_id)",
        [], **CONTEXTS,
    ),
    "render_ddl": ddl(False),
    "render_ddl_annotated": ddl(True),
    "sample_tables": build(
        "SELECT db_id, table_idx, CAST(row_no AS INTEGER) AS row_no, string_agg(cell, '|' ORDER BY pos) AS cells FROM cells GROUP BY ALL", [], **SAMPLES
    ),
    "sample_rows": """
        (SELECT 'nation' AS table_name, CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation ORDER BY n_nationkey LIMIT 3)
        UNION ALL (SELECT 'part', CAST(p_partkey AS VARCHAR), CAST(p_retailprice AS VARCHAR) FROM part ORDER BY p_partkey LIMIT 3)
        UNION ALL (SELECT 'orders', CAST(o_orderkey AS VARCHAR), CAST(o_totalprice AS VARCHAR) FROM orders ORDER BY o_orderkey LIMIT 3)
        UNION ALL (SELECT 'customer', CAST(c_custkey AS VARCHAR), CAST(c_acctbal AS VARCHAR) FROM customer ORDER BY c_custkey LIMIT 3)""",
    "render_table": """SELECT o_orderkey, lpad('who', a, ' ') || ' ' || lpad(o_orderstatus, b, ' ') || ' ' || chr(10)
         || lpad(who, a, ' ') || ' ' || lpad(price, b, ' ') || ' ' || chr(10) || lpad('None', a, ' ') || ' ' || lpad(o_orderpriority, b, ' ') || ' ' AS "table"
        FROM (SELECT *, CAST(greatest(4, length(who)) AS INTEGER) AS a, CAST(greatest(length(o_orderstatus), length(price), length(o_orderpriority)) AS INTEGER) AS b
         FROM (SELECT *, CAST(o_custkey AS VARCHAR) AS who, CAST(o_totalprice AS VARCHAR) AS price FROM orders))""",
    "dedupe_columns": """SELECT l_orderkey, l_linenumber, l_extendedprice, string_agg(CASE WHEN n > 1 THEN name || '_' || (n - 1) ELSE name END, ',' ORDER BY pos) AS unique_names
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_extendedprice, name ORDER BY pos) AS n
         FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, unnest(names) AS name, generate_subscripts(names, 1) AS pos
          FROM (SELECT *, [l_returnflag, l_linestatus, 'n', l_returnflag, 'n', CAST(l_linenumber AS VARCHAR), l_linestatus, 'n', '1'] AS names FROM lineitem)))
        GROUP BY l_orderkey, l_linenumber, l_extendedprice""",
    "choose_variant": f"""SELECT doc_id, n AS num_rows, CASE n WHEN 3 THEN p3 WHEN 1 THEN p1 WHEN 0 THEN p0 END AS prompt,
        CASE WHEN n IS NULL THEN 'ContextLimit' ELSE 'Success' END AS prompt_status
        FROM (SELECT *, CASE WHEN length(p3) <= 1000 THEN 3 WHEN length(p1) <= 1000 THEN 1 WHEN length(p0) <= 1000 THEN 0 END AS n FROM ({X.duck(X.PROMPT_VARIANTS)}))""",
    "render_prompt": build(
        """SELECT question_id, n AS num_rows, CASE n WHEN 3 THEN p3 WHEN 1 THEN p1 WHEN 0 THEN p0 END AS prompt,
        CASE WHEN n IS NULL THEN 'ContextLimit' ELSE 'Success' END AS prompt_status
        FROM (SELECT *, CASE WHEN length(p3) <= 1600 THEN 3 WHEN length(p1) <= 1600 THEN 1 WHEN length(p0) <= 1600 THEN 0 END AS n FROM prompts)""",
        ["questions"], **CONTEXTS,
        prompts=f"""SELECT question_id, {prompt('a.text', "'Answer in SQL.'")} AS p3, {prompt('b.text', "'Answer in SQL.'")} AS p1, {prompt('c.text', "'Answer in SQL.'")} AS p0
            FROM questions q LEFT JOIN context_3 a ON a.db_id = q.db_id LEFT JOIN context_1 b ON b.db_id = q.db_id LEFT JOIN context_0 c ON c.db_id = q.db_id""",
    ),
    "render_prompt_from_file": build(
        """SELECT question_id, n AS num_rows, CASE n WHEN 3 THEN p3 WHEN 1 THEN p1 WHEN 0 THEN p0 END AS prompt,
        CASE WHEN n IS NULL THEN 'ContextLimit' ELSE 'Success' END AS prompt_status
        FROM (SELECT *, CASE WHEN length(p3) <= 1600 THEN 3 WHEN length(p1) <= 1600 THEN 1 WHEN length(p0) <= 1600 THEN 0 END AS n FROM prompts)""",
        ["questions"], **CONTEXTS,
        prompts=f"""SELECT question_id, {prompt('a.text', "'Answer in SQL.'")} AS p3, {prompt('b.text', "'Answer in SQL.'")} AS p1, {prompt('c.text', "'Answer in SQL.'")} AS p0
            FROM questions q LEFT JOIN context_3 a ON a.db_id = q.db_id LEFT JOIN context_1 b ON b.db_id = q.db_id LEFT JOIN context_0 c ON c.db_id = q.db_id""",
    ),
    "bake": build(BAKED, ["questions", "results"], **CONTEXTS),
    "combined_val": build(f"SELECT * FROM ({BAKED}) WHERE split <> 'train'", ["questions", "results"], **CONTEXTS),
    "length_audit": """SELECT lang, count(*) AS n, count(*) FILTER (t > 1000) AS over_limit, max(t) AS max_tokens, CAST(sum(t) AS BIGINT) AS total_tokens
        FROM (SELECT lang, CAST(ceil(length(text) / 4.0) AS BIGINT) AS t FROM documents) GROUP BY lang""",
    "truncate_left": "SELECT doc_id, right(text, 400) AS tail FROM documents",
    "compare_results": build("SELECT * FROM compared", [], **COMPARED),
    "set_equal": """SELECT true AS equal, 'orders' AS "case" UNION ALL SELECT count(*) = 0, 'parts' FROM (
        (SELECT l_partkey AS x FROM lineitem EXCEPT SELECT l_suppkey FROM lineitem)
        UNION ALL (SELECT l_suppkey FROM lineitem EXCEPT SELECT l_partkey FROM lineitem))
        UNION ALL SELECT count(*) = 0, 'all parts' FROM (
        (SELECT l_partkey AS x FROM lineitem EXCEPT SELECT p_partkey FROM part)
        UNION ALL (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem))""",
    "read_questions_json": build(
        "SELECT question_id, db_id, question, evidence, gold_sql, row_number() OVER (ORDER BY CAST(question_id AS BIGINT)) - 1 AS position FROM questions", ["questions"]),
    "read_catalog_json": """SELECT 'db_' || CASE WHEN c_custkey < 10 THEN '0' ELSE '' END || c_custkey AS db_id,
        1 + CAST(list_sum([3 + (c_custkey + t) % 3 for t in range(0, c_custkey % 3 + 1)]) AS BIGINT) AS n_columns,
        array_to_string(['Client', 'orders', 'Line"Item'][1:c_custkey % 3 + 1], ',') AS tables FROM customer""",
    "append_results": build(
        """SELECT question_id, predicted_sql, execution_match, final_reasoning FROM results WHERE _corrupt_record IS NULL AND generation_status = 'Success'
        UNION ALL SELECT question_id, CASE WHEN good THEN 'SELECT ' || question_id ELSE 'SELECT 0' END, good,
         CASE WHEN good THEN 'first' ELSE 'failed' END FROM
        (SELECT CAST(o_orderkey AS VARCHAR) AS question_id, o_orderkey % 5 <> 0 AS good FROM orders)
        WHERE question_id NOT IN (SELECT question_id FROM results WHERE _corrupt_record IS NULL)""", ["results"]),
    "write_curated": build(
        """SELECT l.question_id, coalesce(r.level, l.level) AS level, predicted_sql, execution_match, split
        FROM labelled l JOIN placed p ON p.question_id = l.question_id
        JOIN (SELECT * FROM results WHERE _corrupt_record IS NULL) r ON l.question_id = r.question_id""",
        ["questions", "labelled", "results", "placed"]),
    "read_splits": build("SELECT * FROM placed", ["questions", "labelled", "placed"]),
    "read_splits_resolved": build("SELECT * FROM placed", ["questions", "labelled", "placed"]),
    "live_ddl": " UNION ALL ".join(
        f"""SELECT '{db}' AS db_id, string_agg('CREATE TABLE "' || table_name || '" (' || chr(10) || cols || chr(10) || ')', chr(10) ORDER BY table_name) AS ddl
        FROM (SELECT table_name, string_agg('    "' || column_name || '" ' || CASE data_type WHEN 'VARCHAR' THEN 'STRING' WHEN 'INTEGER' THEN 'INT'
          ELSE data_type END, ',' || chr(10) ORDER BY column_index) AS cols FROM duckdb_columns() WHERE table_name IN ({names}) GROUP BY table_name)"""
        for db, names in (("geo", "'nation', 'region'"), ("shop", "'part', 'orders'"), ("crm", "'customer'"))),
    "write_baked": build(BAKED, ["questions", "results"], **CONTEXTS),
    "append_raw": GENERATIONS,
    "materialize_if_absent": build("SELECT question_id, level FROM labelled", ["questions", "labelled"]),
    "sorted_report": build(
        """SELECT CAST(row_number() OVER (ORDER BY level = 'Total', level) - 1 AS INTEGER) AS line, level, n FROM (
        SELECT level, count(*) AS n FROM labelled GROUP BY level UNION ALL SELECT 'Total', count(*) FROM labelled)""", ["questions", "labelled"]),
    "sample_databases": " UNION ALL ".join(
        f"""SELECT '{db}' AS db_id, '{name}' AS table_name, CAST(row_number() OVER (ORDER BY {key}) AS INTEGER) AS row_no,
        (SELECT string_agg(column_name, ',' ORDER BY column_index) FROM duckdb_columns() WHERE table_name = '{name}') AS header,
        CAST({key} AS VARCHAR) AS key FROM (SELECT {key} FROM {name} ORDER BY {key} LIMIT 3)"""
        for db, name, key in (("geo", "nation", "n_nationkey"), ("shop", "part", "p_partkey"),
                              ("shop", "orders", "o_orderkey"), ("crm", "customer", "c_custkey"))),
    "evaluate": build(f"SELECT {METRICS}", ["questions", "labelled"], **SCORED),
    "evaluate_by_level": build(f"SELECT level, {METRICS} GROUP BY level", ["questions", "labelled"], **SCORED),
    "generate_stub": """SELECT CAST(o_orderkey AS VARCHAR) AS question_id, 'SELECT ''question ' || o_orderkey || '''' AS predicted_sql,
        'plan' AS final_reasoning, 'Success' AS generation_status FROM orders""",
    "generate_failing": """SELECT CAST(o_orderkey AS VARCHAR) AS question_id,
        CASE WHEN o_orderkey % 7 <> 0 THEN 'SELECT ''question ' || o_orderkey || '''' END AS predicted_sql,
        CASE WHEN o_orderkey % 7 <> 0 THEN 'Success' ELSE 'Error' END AS generation_status,
        CASE WHEN o_orderkey % 7 = 0 THEN 'down' END AS error_message FROM orders""",
    "generate_logged": """SELECT CAST(o_orderkey AS VARCHAR) AS question_id,
        CASE WHEN o_custkey % 7 = 0 THEN 'late customer ' || o_custkey ELSE 'plan' || chr(10) || '```sql' || chr(10) ||
          'SELECT ''customer ' || o_custkey || '''' || chr(10) || '```' END AS raw_content,
        'Success' AS generation_status, NULL::VARCHAR AS error_message FROM orders""",
    "verify_candidates_joined": build(
        f"""SELECT t.question_id, t.level, CASE WHEN status = 'Success' THEN sql END AS predicted_sql,
        CASE WHEN status = 'Success' THEN 'Success' ELSE 'Error' END AS generation_status,
        CASE WHEN status = 'Success' THEN coalesce(match_status, false) END AS execution_match,
        CASE WHEN status = 'Success' THEN coalesce(predict_exec_status, false) END AS predicted_exec_status,
        CASE WHEN status <> 'Success' THEN 'Generation failed: {S.NO_SQL_BLOCK}' END AS error_message
        FROM triaged t JOIN blocks b ON t.question_id = b.question_id LEFT JOIN compared c ON c.pair_id = t.question_id WHERE cache_state = 'candidate'""",
        TRIAGED, blocks=fenced(GENERATIONS), **COMPARED,
    ),
    "stream_ingest_orders": f"SELECT question_id, raw_content, sql FROM ({extracted(GENERATIONS)}) JOIN ({GENERATIONS}) USING (question_id)",
    "stream_level_count": build("SELECT level, count(*) AS n FROM labelled GROUP BY level", ["questions", "labelled"]),
}
