"""Inputs derived from the given tables, as SQL that runs alike in Spark and DuckDB.

Names in braces are tables. ``of(spark, folder, text)`` runs a text on Spark; ``text.format(...)``
puts it into a DuckDB query.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def of(spark: SparkSession, folder: str, text: str) -> DataFrame:
    used = {slot for _, slot, _, _ in Formatter().parse(text) if slot}
    return spark.sql(text, **{name: table(spark, folder, name) for name in used})


def duck(text: str) -> str:
    """The text with plain table names."""
    return text.format(**{name: name for name in TABLES})


FENCE = "repeat(chr(96), 3)"

QUESTIONS = """
SELECT CAST(o_orderkey AS STRING) AS question_id,
 concat('db_', lpad(CAST(o_custkey % 69 AS STRING), 2, '0')) AS db_id,
 concat('question ', CAST(o_orderkey AS STRING)) AS question,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('status refers to ', o_orderstatus) END AS evidence,
 CASE CAST(o_orderkey % 14 AS INT)
  WHEN 0 THEN 'SELECT COUNT(*) FROM orders'
  WHEN 1 THEN 'SELECT o_orderstatus, COUNT(*) FROM orders GROUP BY o_orderstatus HAVING COUNT(*) > 10'
  WHEN 2 THEN 'SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)'
  WHEN 3 THEN 'select c.c_name from customer c join orders o on c.c_custkey = o.o_custkey'
  WHEN 4 THEN 'SELECT c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)'
  WHEN 5 THEN 'SELECT n_name FROM nation UNION SELECT r_name FROM region'
  WHEN 6 THEN 'SELECT n_nationkey FROM nation EXCEPT SELECT r_regionkey FROM region'
  WHEN 7 THEN 'WITH t AS (SELECT 1 AS x) SELECT x FROM t'
  WHEN 8 THEN 'SELECT joined_at FROM members'
  WHEN 9 THEN ''
  WHEN 10 THEN NULL
  WHEN 11 THEN 'SELECT c_name FROM customer, nation WHERE c_nationkey = n_nationkey'
  WHEN 12 THEN 'DELETE FROM orders'
  ELSE 'PRAGMA selected' END AS gold_sql
FROM {orders}
"""

# A database for each customer.
OWNERS = "SELECT CAST(o_orderkey AS STRING) AS question_id, concat('c_', CAST(o_custkey AS STRING)) AS db_id FROM {orders}"

# Stored results: absent for a third of the questions, some unreadable, some with an older label.
RESULTS = """
SELECT CAST(o_orderkey AS STRING) AS question_id,
 CASE WHEN o_orderkey % 50 = 1 THEN 'Level 2: Subquery' END AS level,
 concat('SELECT ', CAST(o_custkey AS STRING)) AS predicted_sql,
 concat('plan for ', o_orderpriority, ' order ', CAST(o_orderkey AS STRING)) AS final_reasoning,
 'Success' AS generation_status,
 CASE WHEN o_orderkey % 3 = 1 THEN TRUE WHEN o_orderkey % 2 = 0 THEN FALSE ELSE NULL END AS execution_match,
 CASE WHEN o_orderkey % 101 = 0 THEN 'cut off' END AS _corrupt_record
FROM {orders} WHERE o_orderkey % 3 <> 0 OR o_orderkey % 101 = 0
"""

# What a teacher answers, for any question it may be asked.
RESPONSES = """
SELECT CAST(o_orderkey AS STRING) AS question_id,
 CASE WHEN o_orderkey % 35 = 0 THEN 'Error' ELSE 'Success' END AS generation_status,
 o_orderkey % 5 <> 0 AS execution_match
FROM {orders}
"""

GENERATIONS = """
SELECT CAST(o_orderkey AS STRING) AS question_id,
 CASE CAST(o_orderkey % 8 AS INT)
  WHEN 0 THEN concat('**Query Plan**: open orders.', chr(10), repeat(chr(96), 3), 'sql', chr(10), 'SELECT ', CAST(o_custkey AS STRING), chr(10), repeat(chr(96), 3))
  WHEN 1 THEN concat('plan', chr(10), repeat(chr(96), 3), chr(10), 'SELECT 1', chr(10), repeat(chr(96), 3), ' tail')
  WHEN 2 THEN concat('plan', chr(10), repeat(chr(96), 3), 'sqlite', chr(10), 'SELECT 2;', chr(10), repeat(chr(96), 3))
  WHEN 3 THEN concat('<think>', repeat(chr(96), 3), 'sql', chr(10), 'SELECT 0', chr(10), repeat(chr(96), 3), '</think>x', chr(10), repeat(chr(96), 3), 'SQL', chr(10), 'SELECT 3', chr(10), repeat(chr(96), 3))
  WHEN 4 THEN concat('**Query Plan**: steps', chr(10), '## SQL Query:', chr(10), '  with t AS (SELECT 4 AS x)', chr(10), 'SELECT x FROM t -- done')
  WHEN 5 THEN 'the answer is: select 5'
  WHEN 6 THEN 'I cannot answer that.'
  ELSE NULL END AS raw_content
FROM {orders}
"""

# Answers that wrap a statement in the whole text of a document.
LONG_ANSWERS = """
SELECT CAST(doc_id AS STRING) AS question_id,
 CASE CAST(doc_id % 4 AS INT)
  WHEN 0 THEN concat(text, chr(10), repeat(chr(96), 3), 'sql', chr(10), 'SELECT ', CAST(n_chars AS STRING), chr(10), repeat(chr(96), 3))
  WHEN 1 THEN concat(text, chr(10), 'SELECT lang FROM documents', chr(10), text)
  WHEN 2 THEN concat('<think>', text, '</think>', 'SELECT ', CAST(doc_id AS STRING))
  ELSE text END AS raw_content
FROM {documents}
"""

DIRTY_SQL = """
SELECT o_orderkey,
 CASE CAST(o_orderkey % 10 AS INT)
  WHEN 0 THEN concat(repeat(chr(96), 3), 'sql', chr(10), 'SELECT ', CAST(o_custkey AS STRING), ';', chr(10), repeat(chr(96), 3))
  WHEN 1 THEN concat('-- ', o_orderpriority, chr(10), 'select ', CAST(o_custkey AS STRING), ' ;')
  WHEN 2 THEN concat('SELECT ', chr(39), 'a--', o_orderstatus, '/*b*/', chr(39), ' /* note', chr(10), 'two */ FROM t -- end')
  WHEN 3 THEN concat('name FROM t', CAST(o_custkey AS STRING), ' ;;')
  WHEN 4 THEN concat(chr(10), '  WITH x AS (SELECT 1) SELECT * FROM x', chr(9), ' ')
  WHEN 5 THEN '   '
  WHEN 6 THEN NULL
  WHEN 7 THEN concat('SELECT ', chr(34), 'x--', o_orderstatus, chr(34), ' FROM t --', o_orderpriority, chr(10), 'WHERE y = ', chr(39), 'it', chr(39), chr(39), 's -- ok', chr(39))
  WHEN 8 THEN concat(repeat(chr(96), 3), chr(10), 'with_count FROM t', CAST(o_custkey AS STRING), repeat(chr(96), 3))
  ELSE concat('Select', chr(10), CAST(o_custkey AS STRING)) END AS sql
FROM {orders}
"""

NAMES = """
SELECT p_partkey,
 CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN concat(' "', upper(p_name), '" ') WHEN 1 THEN concat(chr(96), p_name, chr(96))
  WHEN 2 THEN concat(p_name, chr(39), 's "', p_brand, '"') ELSE NULL END AS name
FROM {part}
"""

PROMPT_VARIANTS = """
SELECT doc_id, text AS p3,
 substr(text, 1, CASE WHEN doc_id % 3 = 0 THEN 900 ELSE 2000 END) AS p1,
 substr(text, 1, CASE WHEN doc_id % 10 = 1 THEN 1500 ELSE 200 END) AS p0
FROM {documents}
"""

RESULT_ROWS = """
SELECT l_orderkey AS pair_id, 'gold' AS side, l_partkey AS c1,
 CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS c2
FROM {lineitem}
UNION ALL
SELECT l_orderkey, 'pred', l_partkey,
 CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN l_quantity + 1 ELSE l_quantity END
FROM {lineitem} WHERE NOT (l_orderkey % 5 = 0 AND l_linenumber > 3)
UNION ALL
SELECT l_orderkey, 'pred', l_partkey,
 CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN l_quantity + 1 ELSE l_quantity END
FROM {lineitem} WHERE l_orderkey % 7 = 0 AND NOT (l_orderkey % 5 = 0 AND l_linenumber > 3)
"""

# Every order is a pair; some have no line items, so no rows.
EXECUTIONS = """
SELECT o_orderkey AS pair_id, o_orderkey % 17 <> 0 AS gold_ok, o_orderkey % 19 <> 0 AS pred_ok,
 split('part,quantity', ',') AS gold_cols, split(concat('part,n', CAST(o_orderkey % 3 AS STRING)), ',') AS pred_cols,
 CASE WHEN o_orderkey % 19 = 0 THEN concat('no such column in ', CAST(o_orderkey AS STRING)) END AS error_msg
FROM {orders}
"""

# Answers to candidates: each with a second, failed one and a third, good one.
SEVERAL_RESPONSES = """
SELECT CAST(o_orderkey AS STRING) AS question_id, CASE WHEN o_orderkey % 35 = 0 THEN 'Error' ELSE 'Success' END AS generation_status,
 o_orderkey % 5 <> 0 AS execution_match, concat('SELECT ', CAST(o_orderkey AS STRING)) AS predicted_sql, 'first' AS final_reasoning
FROM {orders}
UNION ALL
SELECT CAST(o_orderkey AS STRING), 'Success', FALSE, 'SELECT 0', 'failed' FROM {orders}
UNION ALL
SELECT CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 35 = 0 THEN 'Error' ELSE 'Success' END,
 o_orderkey % 5 <> 0, concat('SELECT ', CAST(o_orderkey AS STRING), ' again'), 'second'
FROM {orders}
"""

# One catalog row a customer: one to three tables of three to five columns. Spark only, as it is nested.
_TABLE = "CASE t WHEN 0 THEN 'Client' WHEN 1 THEN 'orders' ELSE concat('Line', chr(34), 'Item') END"
_COLUMN = (
    "CASE j WHEN 0 THEN concat('KeyNo', CAST(t AS STRING)) WHEN 1 THEN 'note' WHEN 2 THEN 'photo' "
    "WHEN 3 THEN 'Price' ELSE 'extra col' END"
)
_FRIENDLY = f"CASE (ck + j) % 3 WHEN 0 THEN {_COLUMN} WHEN 1 THEN ' ' ELSE concat(c_name, ' field ', CAST(j AS STRING)) END"
_TYPE = "CASE j WHEN 1 THEN 'text' WHEN 2 THEN 'Blob' WHEN 3 THEN 'real' ELSE 'integer' END"
_OFFSET = "CASE t WHEN 0 THEN 1 WHEN 1 THEN 4 + ck % 3 ELSE 7 + ck % 3 + (ck + 1) % 3 END"
_TABLE_FRIENDLY = "CASE t WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN 'orders' ELSE ' ' END"


def _each_column(expression: str) -> str:
    return f"flatten(transform(ts, t -> transform(sequence(0, 2 + (ck + t) % 3), j -> {expression})))"


CATALOG = f"""
SELECT concat('db_', CASE WHEN ck < 10 THEN '0' ELSE '' END, CAST(ck AS STRING)) AS db_id,
 transform(ts, t -> {_TABLE}) AS table_names_original,
 transform(ts, t -> {_TABLE_FRIENDLY}) AS table_names,
 concat(array(array('-1', '*')), {_each_column(f"array(CAST(t AS STRING), {_COLUMN})")}) AS column_names_original,
 concat(array(array('-1', '*')), {_each_column(f"array(CAST(t AS STRING), {_FRIENDLY})")}) AS column_names,
 concat(array('text'), {_each_column(_TYPE)}) AS column_types,
 concat(transform(ts, t -> CASE WHEN (ck + t) % 2 = 0 THEN CAST({_OFFSET} AS STRING)
  ELSE concat('[', CAST(t AS STRING), ',0,1,99]') END), array('9999')) AS primary_keys,
 concat(transform(filter(ts, t -> t > 0), t -> array({_OFFSET} + 1, 1)), array(array(5, 9999), array(5))) AS foreign_keys
FROM (SELECT CAST(c_custkey AS INT) AS ck, c_name, c_mktsegment,
 sequence(0, CAST(c_custkey % 3 AS INT)) AS ts FROM {{customer}})
"""

# Rows of the catalog's tables: the orders of each customer, dealt out to three tables.
SAMPLE_SOURCE = """
SELECT concat('db_', CASE WHEN o_custkey < 10 THEN '0' ELSE '' END, CAST(o_custkey AS STRING)) AS db_id,
 CAST(o_orderkey % 3 AS INT) AS table_idx, o_orderkey,
 CAST(2 + (o_custkey + o_orderkey % 3) % 3 AS INT) AS width,
 concat(o_orderpriority, ' ', repeat('x', CAST(o_orderkey % 70 AS INT))) AS note,
 o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS extra
FROM {orders}
"""

# Output columns of queries, one query a line item: names repeat.
QUERY_COLUMNS = """
SELECT l_orderkey, l_linenumber, l_extendedprice,
 array(l_returnflag, l_linestatus, 'n', l_returnflag, 'n', CAST(l_linenumber AS STRING), l_linestatus, 'n', '1') AS names
FROM {lineitem}
"""
