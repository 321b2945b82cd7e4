"""Derived views shared by the queries and their SQL twins: (source table, projections).

The given tables hold no missing value, so missingness, constants, leakage and duplicates come
from projections whose text reads the same in Spark SQL and in ANSI SQL. All rows are kept.
"""

# Missing prices and priorities, a constant, an empty column and a leaking column.
DIRTY_ORDERS = (
    "orders",
    [
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice",
        "CASE WHEN o_orderstatus IN ('F', 'P') THEN NULL ELSE o_orderpriority END AS o_orderpriority",
        "1 AS batch",
        "CAST(NULL AS DOUBLE) AS spare",
        "o_totalprice * 2 + 1 AS gross",
    ],
)

# Few distinct rows among many: natural duplicates.
LOOSE_LINES = (
    "lineitem",
    ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax"],
)

# An identifier in text form and a high-cardinality text.
DOCUMENT_FACTS = (
    "documents",
    ["doc_id", "concat('doc', doc_id) AS ref_id", "text", "source", "n_chars"],
)


def as_sql(view: tuple[str, list[str]]) -> str:
    source, exprs = view
    return f"SELECT {', '.join(exprs)} FROM {source}"
