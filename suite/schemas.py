"""Static column lists (name, kind) of the inputs the registered queries use."""

from __future__ import annotations

from kiln.sources.derived import oracle_cte

TABLES: dict[str, list[tuple[str, str]]] = {
    "dirty_customer": [
        ("customer_id", "int"), ("customer_name", "str"), ("age", "int"), ("salary", "dbl"), ("city", "str"),
        ("city_copy", "str"), ("gender", "str"), ("segment", "str"), ("constant_col", "str"),
        ("near_constant", "str"), ("age_text", "str"), ("email", "str"), ("churn", "int"),
    ],
    "categorical_customer": [("customer_id", "int"), ("customer_name", "str"), ("city", "str"), ("gender", "str"), ("segment", "str"),
                             ("near_constant", "str")],
    "dirty_events": [("event_id", "int"), ("ts", "ts"), ("user_id", "int"), ("props", "str"), ("event_type", "str"),
                     ("value", "dbl")],
    "dirty_dates": [("order_id", "int"), ("line_no", "int"), ("order_date", "str"),
                    ("ship_date", "str"), ("quantity", "dbl"), ("price", "dbl"), ("part_key", "int"), ("supplier_key", "int"),
                    ("discount", "dbl"), ("tax", "dbl"), ("return_flag", "str"), ("line_status", "str"), ("customer_key", "int"),
                    ("order_status", "str"), ("order_total", "dbl"), ("order_priority", "str")],
    "people": [("person_id", "int"), ("date_of_birth", "str"), ("reference_date", "str"), ("start_date", "str"), ("end_date", "str"),
               ("age", "int"), ("years_experience", "dbl"), ("revenue", "dbl"), ("quantity", "dbl"), ("salary", "dbl"), ("grade", "str")],
    "labelled_documents": [("doc_id", "int"), ("text", "str"), ("lang", "str"), ("source", "str"),
                           ("n_chars", "int"), ("quality", "int"), ("toxic", "int")],
    "lineitem": [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"),
                 ("l_linenumber", "int"), ("l_quantity", "dbl"), ("l_extendedprice", "dbl"),
                 ("l_discount", "dbl"), ("l_tax", "dbl"), ("l_returnflag", "str"),
                 ("l_linestatus", "str"), ("l_shipdate", "ts")],
    "orders": [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "str"),
               ("o_totalprice", "dbl"), ("o_orderdate", "ts"), ("o_orderpriority", "str")],
    "events": [("event_id", "int"), ("ts", "ts"), ("user_id", "int"), ("event_type", "str"),
               ("value", "dbl"), ("props", "str")],
    "customer": [("c_custkey", "int"), ("c_name", "str"), ("c_nationkey", "int"),
                 ("c_acctbal", "dbl"), ("c_mktsegment", "str")],
    "part": [("p_partkey", "int"), ("p_name", "str"), ("p_brand", "str"), ("p_type", "str"),
             ("p_size", "int"), ("p_retailprice", "dbl")],
    "documents": [("doc_id", "int"), ("text", "str"), ("lang", "str"), ("source", "str"),
                  ("n_chars", "int")],
    "conversations": [("conv_id", "int"), ("turn", "int"), ("role", "str"), ("text", "str")],
    "pages": [("page_id", "int"), ("url", "str"), ("html", "str")],
    "benchmark": [("item_id", "int"), ("text", "str")],
}

TABLES["customer_age_copy"] = [*TABLES["dirty_customer"], ("age_copy", "int")]
TABLES["generated"] = [*TABLES["dirty_customer"], ("copy_Gen", "int"), ("const_Gen", "int"), ("bad_Ratio", "dbl"),
                       ("sparse_Gen", "dbl"), ("odd_Month", "int"), ("due_DayOfWeek", "dbl")]

# integral columns stored as 32-bit INTEGER (the rest of kind "int" are BIGINT)
INT32 = {("dirty_customer", "churn"), ("customer_age_copy", "churn"), ("labelled_documents", "quality"),
         ("labelled_documents", "toxic"), ("lineitem", "l_linenumber"), ("customer", "c_nationkey"),
         ("part", "p_size")}

DERIVED = {"dirty_customer", "dirty_events", "dirty_dates", "labelled_documents", "categorical_customer",
           "customer_age_copy", "people", "generated"}


def source_sql(table: str) -> str:
    """FROM-able SQL for a table or derived view (DuckDB side)."""
    if table in DERIVED:
        return f"({oracle_cte(table)})"
    return table


def cols(table: str) -> list[tuple[str, str]]:
    return TABLES[table]
