"""Tables of commits, coverage, diagnostics and scores derived from the given tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MESSAGES = [
    "fix: null pointer and lifetime", "fix: use after free, use-after-free in parser", "fix data race and deadlock with mutex",
    "security: sql injection in login", "fix off-by-one at boundary", "wrong parameter in api call", "resource leak: file not closed",
    "type error in casting", "update configuration settings", "slow query, needs optimization", "integration breaking change",
    "operator precedence and parentheses", "add type annotation for generic type", "stdlib mapping for std::vec",
    "codegen transform of syntax tree", "list comprehension generator bug ", "iterator chain with .map( call", "borrow checker move error",
    "docs: update README", "chore: bump version", "Merge branch fix issue", "revert: fix crash", "wip: fix bug ", "closes #123 bugfix: where clause bound",
]

_CODES = [
    ("E0308", None, None), ("E0277", None, None), ("E0502", "clippy::todo", None), ("E0382", None, None), ("E0425", None, None),
    ("E0599", None, None), ("E0658", None, None), ("E0412", None, None), (None, "clippy::unwrap_used", None), (None, "clippy::needless_collect", None),
    (None, "clippy::manual_map", None), (None, "clippy::panic", None), ("E9999", None, None), (None, "clippy::other", None),
    ("E0308", None, "Logic Errors"), (None, None, None),
]


def _text(x: str | None) -> str:
    return "CAST(NULL AS VARCHAR(64))" if x is None else "'" + x.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({i}, {_text(m)})" for i, m in enumerate(MESSAGES))
_CODE_ROWS = ", ".join(f"({i}, {', '.join(map(_text, row))})" for i, row in enumerate(_CODES))

#: SQL of each view; EPOCH(x) differs between the engines.
SQL = {
    "commits": f"""SELECT o.o_orderkey AS commit_id, md5(CAST(o.o_orderkey AS STRING)) AS hash,
        concat('repo-', CAST(o.o_custkey % 20 AS STRING)) AS repo, concat('dev', CAST(o.o_custkey % 50 AS STRING), '@example.com') AS author,
        EPOCH(o.o_orderdate) AS timestamp, t.message AS message, coalesce(l.files_changed, 0) AS files_changed,
        coalesce(l.lines_added, 0) AS lines_added, coalesce(l.lines_removed, 0) AS lines_removed
        FROM orders o JOIN (VALUES {_TEMPLATES}) AS t(tid, message) ON t.tid = o.o_orderkey % {len(MESSAGES)}
        LEFT JOIN (SELECT l_orderkey, count(*) AS files_changed, CAST(floor(sum(l_quantity)) AS BIGINT) AS lines_added,
            CAST(sum(l_linenumber) AS BIGINT) AS lines_removed FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
    "coverage": """SELECT l_orderkey % 200 AS test_id, (l_orderkey % 200) % 11 = 0 AS failed,
        concat('src/m', CAST(l_partkey % 25 AS STRING), '.rs') AS file, CAST(l_linenumber AS BIGINT) * 10 + l_suppkey % 10 AS line,
        CAST(floor(l_quantity) AS BIGINT) % 3 AS hits FROM lineitem""",
    "changed_lines": """SELECT l_orderkey AS fix_commit, concat('src/m', CAST(l_partkey % 25 AS STRING), '.rs') AS file,
        CAST(l_linenumber AS BIGINT) * 10 + l_suppkey % 10 AS line, l_returnflag = 'R' AS was_deleted FROM lineitem WHERE l_orderkey % 7 = 0""",
    "blame": """SELECT file, line, min(l_orderkey) AS commit_id FROM (SELECT concat('src/m', CAST(l_partkey % 25 AS STRING), '.rs') AS file,
        CAST(l_linenumber AS BIGINT) * 10 + l_suppkey % 10 AS line, l_orderkey FROM lineitem WHERE l_orderkey % 3 <> 0) x GROUP BY file, line""",
    "diagnostics": f"""SELECT event_id, concat('src/u', CAST(user_id AS STRING), '.rs') AS source_file, c.error_code, c.clippy_lint, c.given_category,
        CAST((event_id * 37) % 50 + 50 AS DOUBLE) / 100 AS confidence, EPOCH(ts) AS timestamp
        FROM events e JOIN (VALUES {_CODE_ROWS}) AS c(tid, error_code, clippy_lint, given_category) ON c.tid = e.event_id % {len(_CODES)}""",
    "file_features": """SELECT p_partkey AS row_id, concat('src/p', CAST(p_partkey AS STRING), '.rs') AS path,
        CAST((p_partkey * 7) % 101 AS DOUBLE) / 100 AS sbfl_score, CAST((p_partkey * 13) % 101 AS DOUBLE) / 100 AS tdg_score,
        CAST((p_partkey * 29) % 101 AS DOUBLE) / 100 AS churn_score, CAST((p_partkey * 31) % 101 AS DOUBLE) / 100 AS complexity_score,
        CAST((p_partkey * 37) % 101 AS DOUBLE) / 100 AS rag_similarity, p_size % 4 = 0 AS is_defect FROM part""",
    "predictions": """SELECT d.doc_id, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS score, CAST(l.quality AS INT) AS label
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    "repos": """SELECT concat('repo-', CAST(c.c_custkey AS STRING)) AS name, concat('org-', CAST(c.c_nationkey AS STRING), '/repo-', CAST(c.c_custkey AS STRING)) AS full_name,
        CASE c.c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Rust' WHEN 2 THEN 'Python' ELSE 'Go' END AS language,
        CAST(floor(abs(c.c_acctbal)) AS BIGINT) AS stars, max(o.o_orderdate) AS updated_at
        FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_nationkey, c.c_acctbal""",
    "bugs": f"""SELECT CAST(o.o_orderkey AS STRING) AS id, t.message AS title,
        concat('m', CAST(o.o_custkey % 25 AS STRING), '.rs line ', CAST(o.o_orderkey % 80 AS STRING), ' of failing tests') AS description,
        md5(CAST(o.o_orderkey AS STRING)) AS fix_commit, '' AS fix_diff, split(concat('src/m', CAST(o.o_custkey % 25 AS STRING), '.rs'), ',') AS affected_files,
        CASE t.tid % 3 WHEN 0 THEN 'Memory Safety' WHEN 1 THEN 'Logic Errors' ELSE 'Type Errors' END AS category, CAST(o.o_orderkey % 5 + 1 AS INT) AS severity,
        split(concat('crash,', t.message), ',') AS symptoms, concat('cause ', CAST(o.o_orderkey % 7 AS STRING)) AS root_cause, concat('check ', t.message) AS fix_pattern
        FROM orders o JOIN (VALUES {_TEMPLATES}) AS t(tid, message) ON t.tid = o.o_orderkey % {len(MESSAGES)}""",
    "tdg": """SELECT concat('repo-', CAST(p_partkey % 20 AS STRING)) AS repo, concat('src/m', CAST(p_partkey % 25 AS STRING), '.rs') AS file,
        max(CAST((p_partkey * 17) % 100 AS DOUBLE)) AS total FROM part GROUP BY p_partkey % 20, p_partkey % 25""",
}

_TABLES = {
    "commits": ["orders", "lineitem"], "coverage": ["lineitem"], "changed_lines": ["lineitem"], "blame": ["lineitem"],
    "diagnostics": ["events"], "file_features": ["part"], "predictions": ["documents", "labels"], "tdg": ["part"],
    "repos": ["customer", "orders"], "bugs": ["orders"],
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame; it reads only the columns it needs."""
    sql = SQL[name]
    for start in ("o.o_orderdate", "ts"):
        sql = sql.replace(f"EPOCH({start})", f"unix_timestamp(CAST({start} AS TIMESTAMP))")
    given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES[name]}
    for t in given:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {t}", f"{word} {{{t}}}")
    return spark.sql(sql, **given)


def oracle(name: str) -> str:
    """The view as a CTE of the other engine."""
    sql = SQL[name]
    for start in ("o.o_orderdate", "ts"):
        sql = sql.replace(f"EPOCH({start})", f"CAST(floor(epoch({start})) AS BIGINT)")
    return f"v_{name} AS ({sql})"
