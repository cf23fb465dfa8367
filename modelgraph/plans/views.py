"""Model-shaped views over the driver tables, and the register of queries.

Each view is one SQL text that Spark and DuckDB accept unchanged; a query reads views as
DataFrames, its SQL twin reads the same texts as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "users": "SELECT c_custkey AS id, replace(c_name,'#','_') AS username, lower(replace(c_name,'#','_')) || '@x' || CAST(c_custkey % 900 AS STRING) AS email FROM customer",
    "projects": "SELECT o_orderkey AS id, o_custkey AS owner_id, 'p' || CAST(o_orderkey % 20 AS STRING) AS name, o_orderdate AS created_at FROM orders",
    "files": """SELECT l_orderkey AS project_id, CASE WHEN l_linenumber = 1 AND l_partkey % 2 = 0 THEN 'main' ELSE 'f' || CAST(l_partkey % 9 AS STRING) END
        || CASE WHEN l_returnflag = 'R' THEN '.tdl' WHEN l_returnflag = 'A' THEN '.ontol' ELSE '' END AS name,
        l_shipdate AS updated_at, 'v' || CAST(l_suppkey AS STRING) AS content, l_linenumber AS seq FROM lineitem""",
    "edits": "SELECT event_id, user_id AS project_id, event_type || '.ontol' AS name, ts, props AS content, event_type FROM events",
    "terms": """SELECT p_partkey % 50 AS ontology_id, p_partkey AS seq, CASE WHEN p_partkey % 10 = 0 THEN replace(p_name,' ','_') ELSE 't' || CAST(p_partkey AS STRING) END AS name,
        CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS label, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_type END AS description,
        CASE WHEN p_partkey % 3 = 0 THEN '#' || substr(p_brand,7) END AS color, CASE WHEN p_partkey % 17 = 0 THEN p_brand END AS note FROM part""",
    "function_args": """SELECT l_orderkey % 50 AS ontology_id, l_orderkey AS seq, 'fn' || CAST(l_orderkey AS STRING) AS function, l_linenumber AS pos,
        't' || CAST(l_partkey - l_partkey % 50 + l_orderkey % 50 AS STRING) AS term, CASE WHEN l_quantity > 48 THEN '' ELSE l_linestatus END AS label FROM lineitem""",
    "functions": """SELECT o_orderkey % 50 AS ontology_id, o_orderkey AS seq, 'fn' || CAST(o_orderkey AS STRING) AS name, o_orderpriority AS label,
        't' || CAST(o_custkey - o_custkey % 50 + o_orderkey % 50 AS STRING) AS output_term, CASE o_orderstatus WHEN 'F' THEN 'inheritance' WHEN 'O' THEN 'composition' END AS type,
        CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS output_label, CASE WHEN o_orderkey % 4 = 1 THEN '#' || CAST(100000 + o_orderkey % 1000 AS STRING) END AS color,
        CASE WHEN o_orderkey % 6 = 2 THEN '#00ff0' || CAST(o_orderkey % 7 AS STRING) END AS colorArrow, CASE WHEN o_orderkey % 5 = 3 THEN 'in ' || o_orderpriority END AS inputTitle, CASE WHEN o_orderkey % 5 = 4 THEN 'out' END AS outputTitle FROM orders""",
    "relationships": """SELECT l_partkey % 50 AS ontology_id, 10000000 + l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_quantity > 45 THEN 'r' || CAST(l_orderkey % 500 AS STRING) END AS name,
        't' || CAST(l_partkey AS STRING) AS parent, CASE l_suppkey % 8 WHEN 0 THEN 'dependence' WHEN 1 THEN 'association' WHEN 2 THEN 'directAssociation' WHEN 3 THEN 'inheritance'
        WHEN 4 THEN 'implementation' WHEN 5 THEN 'aggregation' WHEN 6 THEN 'composition' ELSE 'Inherits' END AS relationship, 't' || CAST((l_partkey + 50 * (l_suppkey % 5)) AS STRING) AS child,
        CASE l_returnflag WHEN 'R' THEN 'forward' WHEN 'A' THEN 'backward' ELSE CASE WHEN l_quantity > 30 THEN 'bidirectional' END END AS direction,
        CASE WHEN l_linenumber = 1 THEN '#' || CAST(100000 + l_suppkey AS STRING) END AS color, CASE WHEN l_linenumber = 2 THEN 'title ' || l_linestatus END AS title,
        CASE WHEN l_quantity < 10 THEN '*' END AS rightChar, CASE WHEN l_quantity > 25 THEN CAST(l_linenumber AS STRING) END AS leftChar FROM lineitem""",
    "imports": """SELECT p_partkey AS file_id, p_partkey * 2 + s AS target_id, s AS seq FROM part CROSS JOIN (SELECT 0 AS s UNION ALL SELECT 1 AS s) x
        UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 4) AS BIGINT), 2 FROM part WHERE p_partkey % 97 = 0""",
    "definitions": """SELECT p_partkey AS file_id, 1 AS seq, 'd' || CAST(p_partkey % 40 AS STRING) AS name, p_brand AS label, p_type AS description FROM part
        UNION ALL SELECT p_partkey, 2, 'e' || CAST(p_partkey AS STRING), p_name, p_type FROM part""",
    "model_imports": """SELECT p_partkey AS file_id, p_partkey * 8 AS target_id, 1 AS seq, pos, CASE pos WHEN 0 THEN 'f' WHEN 1 THEN 't' ELSE 'r' END || CAST(p_partkey * 8 AS STRING) AS name,
        CASE WHEN pos = 0 AND p_partkey % 7 = 0 THEN 'g' || CAST(p_partkey AS STRING) WHEN pos = 1 AND p_partkey % 5 = 0 THEN 'x' || CAST(p_partkey AS STRING) END AS alias
        FROM part CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 AS pos UNION ALL SELECT 2 AS pos) x WHERE p_partkey > 0 AND (pos <> 1 OR p_partkey % 3 > 0)
        UNION ALL SELECT p_partkey, p_partkey * 8 + 1, 2, 0, NULL, NULL FROM part WHERE p_partkey > 0""",
    "model_definitions": """SELECT p_partkey AS file_id, 10 AS seq, 'term' AS kind, 't' || CAST(p_partkey AS STRING) AS name, p_brand || '/' || p_type AS body, '' AS use1, '' AS use2 FROM part
        UNION ALL SELECT p_partkey, 11, 'term', 'c' || CAST(p_partkey % 400 AS STRING), p_type, '', '' FROM part WHERE p_partkey % 4 = 0
        UNION ALL SELECT p_partkey, 20, 'function', 'f' || CAST(p_partkey AS STRING), p_name, 't' || CAST(p_partkey AS STRING), CASE WHEN p_partkey % 6 = 0 THEN 'x' || CAST(p_partkey AS STRING) ELSE 't' || CAST(p_partkey * 8 + p_partkey % 2 AS STRING) END FROM part
        UNION ALL SELECT p_partkey, 30, 'relationship', CASE WHEN p_partkey % 2 = 0 THEN 'r' || CAST(p_partkey AS STRING) END, 'composition', 't' || CAST(p_partkey * 8 + 1 AS STRING), 't' || CAST(p_partkey AS STRING) FROM part
        UNION ALL SELECT p_partkey, 5, 'function', 'e' || CAST(p_partkey AS STRING), p_type, 't' || CAST(p_partkey * 8 + 1 AS STRING), 't' || CAST(p_partkey AS STRING) FROM part WHERE p_partkey % 3 = 0""",
    "generalizations": """SELECT p_partkey AS specific, CAST(floor(p_partkey / 2) AS BIGINT) AS general FROM part WHERE p_partkey > 1
        UNION ALL SELECT CAST(floor(p_partkey / 8) AS BIGINT), p_partkey FROM part WHERE p_partkey % 97 = 0 AND p_partkey > 7
        UNION ALL SELECT p_partkey, p_partkey - 1 FROM part WHERE p_partkey % 20 = 3""",
    "attributes": """SELECT l_partkey AS class, l_orderkey * 10 + l_linenumber AS seq, 'a' || CAST(l_linenumber AS STRING) AS name,
        CASE l_suppkey % 7 WHEN 0 THEN 'String' WHEN 1 THEN 'int' WHEN 2 THEN 'double' WHEN 3 THEN NULL WHEN 4 THEN 'string' WHEN 5 THEN CAST(l_suppkey AS STRING) ELSE 'bool' END AS type_,
        CAST(CAST(l_quantity AS INT) AS STRING) AS initial_value, CASE WHEN l_quantity > 40 THEN 'a' || CAST(l_suppkey % 9 AS STRING) END AS redefines FROM lineitem""",
    "association_ends": """SELECT l_orderkey AS assoc_id, l_linenumber AS end_no, l_partkey AS participant, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'composition'
        WHEN l_returnflag = 'A' AND l_linenumber <= 2 THEN 'aggregation' ELSE 'none' END AS aggregation,
        CASE l_suppkey % 6 WHEN 0 THEN '*' WHEN 1 THEN '1' WHEN 2 THEN '0..1' WHEN 3 THEN '1..*' WHEN 4 THEN '5..3' ELSE NULL END AS multiplicity FROM lineitem""",
    "replies": """SELECT conv_id % 50 AS ontology_id, conv_id, turn, role, text, concat('Sure. {"relationships": [{"parent": "t', CAST(conv_id AS STRING), '", "child": "t', CAST(conv_id + turn * 50 AS STRING), '", "relationship": "',
        CASE turn % 3 WHEN 0 THEN 'inheritance' WHEN 1 THEN 'composition' ELSE 'likes' END, '", "label": ', CASE WHEN conv_id % 3 = 0 THEN '"is a"' ELSE 'null' END, ', "is_bidirectional": ', CASE WHEN conv_id % 7 = 0 THEN 'null' WHEN conv_id % 5 = 0 THEN 'true' ELSE 'false' END, ', "comment": "c"}]} done') AS reply FROM conversations""",
    "meta_statements": """SELECT p_partkey % 50 AS ontology_id, p_partkey AS seq, CASE p_partkey % 8 WHEN 0 THEN 'version' WHEN 1 THEN 'title' WHEN 2 THEN 'author' WHEN 3 THEN 'description'
        WHEN 4 THEN 'type' WHEN 5 THEN 'date' WHEN 6 THEN 'colour' ELSE 'Title' END AS tag, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_brand END AS value FROM part""",
    "attribute_rows": """SELECT p_partkey % 50 AS ontology_id, p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN 'term' WHEN 1 THEN 'function' ELSE 'relationship' END AS kind,
        CASE p_partkey % 7 WHEN 0 THEN 'color' WHEN 1 THEN 'note' WHEN 2 THEN 'type' WHEN 3 THEN 'colorArrow' WHEN 4 THEN 'direction' WHEN 5 THEN 'title' ELSE 'bogus' END AS key,
        CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_brand END AS value FROM part""",
    "figure_lines": """SELECT p_partkey % 50 AS ontology_id, p_brand AS figure, 20000000 + p_partkey AS seq,
        CASE WHEN p_partkey % 23 = 0 THEN 'nobody' WHEN p_partkey % 19 = 5 THEN 'fn' || CAST(p_partkey AS STRING) WHEN p_partkey % 29 = 7 THEN 'r' || CAST(p_partkey % 500 AS STRING)
        WHEN p_partkey % 10 = 0 THEN replace(p_name,' ','_') ELSE 't' || CAST(p_partkey AS STRING) END AS member FROM part""",
    "classifiers": """SELECT p_partkey AS class, p_partkey AS seq, CASE p_partkey % 9 WHEN 0 THEN 'Classifier' ELSE 'Class' END AS kind,
        CASE p_partkey % 12 WHEN 0 THEN 'interface' WHEN 1 THEN 'utility' WHEN 2 THEN 'dataType' WHEN 3 THEN 'enumeration' END AS stereotype, p_partkey % 5 = 0 AS is_abstract,
        CASE p_partkey % 7 WHEN 1 THEN '1' WHEN 2 THEN '0..4' WHEN 3 THEN '2..*' END AS multiplicity FROM part""",
    "operations": """SELECT o_custkey AS class, o_orderkey AS op, CASE o_orderkey % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '#' ELSE '~' END AS visibility,
        'op' || CAST(o_orderkey % 3 AS STRING) AS name, CASE o_orderkey % 5 WHEN 0 THEN 'int' WHEN 1 THEN CAST(o_custkey + 1 AS STRING) WHEN 2 THEN NULL WHEN 3 THEN 'nothing' ELSE 'String' END AS return_type,
        o_orderkey % 2 = 0 AS is_abstract, o_orderkey % 3 = 0 AS is_query, CASE WHEN o_orderkey % 7 = 0 THEN 'classifier' ELSE 'instance' END AS scope, o_orderkey % 6 = 0 AS is_leaf,
        CASE o_orderkey % 8 WHEN 1 THEN 'guarded' WHEN 6 THEN 'concurrent' ELSE 'sequential' END AS concurrency FROM orders""",
    "parameters": """SELECT l_orderkey AS op, l_linenumber AS pos, 'x' || CAST(l_linenumber AS STRING) AS name,
        CASE l_suppkey % 5 WHEN 0 THEN 'int' WHEN 1 THEN CAST(l_partkey AS STRING) WHEN 2 THEN NULL WHEN 3 THEN 'ghost' ELSE 'bool' END AS type_,
        CASE l_suppkey % 4 WHEN 0 THEN 'in' WHEN 1 THEN 'out' WHEN 2 THEN 'inout' ELSE 'return' END AS direction, CASE WHEN l_quantity > 30 THEN CAST(CAST(l_quantity AS INT) AS STRING) END AS default_value FROM lineitem""",
    "dependencies": """SELECT p_partkey AS client, p_partkey + CAST(p_size AS BIGINT) - 3 AS supplier, CASE p_partkey % 6 WHEN 0 THEN 'use' WHEN 1 THEN 'CALL' WHEN 2 THEN 'вызов'
        WHEN 3 THEN 'Использование' WHEN 4 THEN 'instanceOf' ELSE 'friend' END AS stereotype FROM part""",
    "realizations": "SELECT p_partkey AS implementer, p_partkey + CAST(p_size AS BIGINT) % 7 AS interface FROM part WHERE p_partkey % 3 = 0",
}

_TABLES = "region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|pages|benchmark|labels|conversations"


class Views:
    """The views over the tables of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        text = re.sub(rf"\bFROM ({_TABLES})\b", r"FROM {\1}", VIEWS[name].replace("{", "{{").replace("}", "}}"))
        used = {t: self.table(t) for t in re.findall(r"FROM \{(\w+)\}", text)}
        return self.spark.sql(text, **used)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Registers a function of Views under name; sql may use the named views as tables."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            texts = [f"{v} AS ({VIEWS[v]})" for v in views.split()]
            body = sql.strip()
            if texts and body.startswith("WITH RECURSIVE"):
                ORACLES[name] = f"WITH RECURSIVE {', '.join(texts)}, {body.removeprefix('WITH RECURSIVE')}"
            elif texts and body.startswith("WITH "):
                ORACLES[name] = f"WITH {', '.join(texts)}, {body.removeprefix('WITH ')}"
            else:
                ORACLES[name] = (f"WITH {', '.join(texts)} " if texts else "") + body
        return f

    return register
