"""Stand-in inputs derived from the test tables.

The driver's tables have no nulls, blanks or duplicate rows, so cleaning and
quality operators would have nothing to do on them. Each view here only
reshapes a whole test table into the schema an operator expects (renamed
columns, injected blanks/nulls/invalid values, text dates). No rows are
filtered out; the operators learn nothing from how the dirt was made.

Every view is one SQL text valid in Spark SQL and DuckDB, with ``{table}``
placeholders: Spark binds them to DataFrames (``spark.sql(text, t=df)``),
the DuckDB oracle substitutes the registered view names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kiln.sources.io import read_table

# ---- fixed values: view definitions -----------------------------------------
DIRTY_CUSTOMER = """
SELECT
  c_custkey AS customer_id, c_name AS customer_name,
  CASE WHEN c_custkey % 7 = 0 THEN NULL
       WHEN c_custkey % 50 = 1 THEN -5
       WHEN c_custkey % 97 = 0 THEN 999
       ELSE 18 + c_custkey % 60 END AS age,
  c_acctbal AS salary,
  CASE c_nationkey % 5 WHEN 0 THEN 'Paris' WHEN 1 THEN 'Lyon' WHEN 2 THEN 'Nice'
       WHEN 3 THEN 'Lille' ELSE 'Brest' END AS city,
  CASE c_nationkey % 5 WHEN 0 THEN 'Paris' WHEN 1 THEN 'Lyon' WHEN 2 THEN 'Nice'
       WHEN 3 THEN 'Lille' ELSE 'Brest' END AS city_copy,
  CASE WHEN c_custkey % 11 = 0 THEN NULL
       WHEN ((c_nationkey % 5) % 2 = 0) = (c_custkey % 13 <> 5) THEN 'Female'
       ELSE 'Male' END AS gender,
  CASE WHEN c_custkey % 13 = 0 THEN '  ' ELSE c_mktsegment END AS segment,
  'SAME' AS constant_col,
  CASE WHEN c_custkey % 200 = 0 THEN 'B' ELSE 'A' END AS near_constant,
  CASE WHEN c_custkey % 7 = 0 THEN NULL
       WHEN c_custkey % 23 = 0 THEN 'unknown'
       ELSE CAST(18 + c_custkey % 60 AS STRING) END AS age_text,
  CASE WHEN c_custkey % 19 = 0 THEN 'not-an-email'
       ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END AS email,
  CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS churn
FROM {customer}
"""

DIRTY_EVENTS = """
SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS ts, user_id, props,
  CASE WHEN event_id % 17 = 0 THEN '  ' ELSE event_type END AS event_type,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value
FROM {events}
UNION ALL
SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS ts, user_id, props,
  CASE WHEN event_id % 17 = 0 THEN '  ' ELSE event_type END AS event_type,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value
FROM {events} WHERE event_id % 20 = 0
"""

DIRTY_DATES = """
SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_no,
  CASE WHEN l.l_orderkey % 25 = 0 THEN 'not-a-date'
       WHEN l.l_orderkey % 31 = 0 THEN '1850-01-01'
       ELSE substr(CAST(o.o_orderdate AS STRING), 1, 10) END AS order_date,
  CASE WHEN l.l_linenumber % 2 = 0
       THEN concat(CAST(month(l.l_shipdate) AS STRING), '/', CAST(day(l.l_shipdate) AS STRING),
                   '/', CAST(year(l.l_shipdate) AS STRING))
       ELSE substr(CAST(l.l_shipdate AS STRING), 1, 10) END AS ship_date,
  l.l_quantity AS quantity, l.l_extendedprice AS price, l.l_partkey AS part_key, l.l_suppkey AS supplier_key,
  l.l_discount AS discount, l.l_tax AS tax, l.l_returnflag AS return_flag, l.l_linestatus AS line_status,
  o.o_custkey AS customer_key, o.o_orderstatus AS order_status, o.o_totalprice AS order_total,
  o.o_orderpriority AS order_priority
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
"""

LABELLED_DOCUMENTS = """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, lb.quality, lb.toxic
FROM {documents} d LEFT JOIN {labels} lb ON d.doc_id = lb.doc_id
"""
CATEGORICAL_CUSTOMER = ("SELECT customer_id, customer_name, city, gender, segment, near_constant FROM ("
                        + DIRTY_CUSTOMER + ") dc")
CUSTOMER_AGE_COPY = "SELECT dc.*, age * 2 AS age_copy FROM (" + DIRTY_CUSTOMER + ") dc"

#: Orders as people with dates of birth, terms, money and quantities (some zero), dates as text.
PEOPLE = """
SELECT o_orderkey AS person_id,
  CASE WHEN o_orderkey % 29 = 0 THEN 'unknown'
       ELSE concat(CAST(1950 + o_custkey % 60 AS STRING), '-0', CAST(1 + o_custkey % 9 AS STRING), '-1',
                   CAST(o_custkey % 10 AS STRING)) END AS date_of_birth,
  substr(CAST(o_orderdate AS STRING), 1, 10) AS reference_date,
  concat(CAST(2000 + o_custkey % 20 AS STRING), '-03-0', CAST(1 + o_custkey % 9 AS STRING)) AS start_date,
  concat(CAST(2005 + o_custkey % 13 AS STRING), '-1', CAST(o_custkey % 3 AS STRING), '-2', CAST(o_custkey % 8 AS STRING))
    AS end_date,
  18 + o_custkey % 60 AS age, CAST(1 + o_custkey % 41 AS DOUBLE) AS years_experience,
  o_totalprice AS revenue, CAST(o_custkey % 7 AS DOUBLE) AS quantity,
  o_totalprice * o_totalprice * o_totalprice / 1e9 AS salary, o_orderpriority AS grade
FROM {orders}
"""
#: Customers with generated features as validation meets them: a copy, a constant, infinities, gaps, odd months.
GENERATED = """
SELECT dc.*, churn AS copy_Gen, 1 AS const_Gen,
  CASE WHEN customer_id % 10 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN customer_id % 10 = 1 THEN CAST('-Infinity' AS DOUBLE)
       ELSE salary / 2 END AS bad_Ratio,
  CASE WHEN customer_id % 3 = 0 THEN CAST(customer_id % 5 AS DOUBLE) END AS sparse_Gen,
  customer_id % 15 AS odd_Month, CAST(customer_id % 7 AS DOUBLE) AS due_DayOfWeek
FROM (""" + DIRTY_CUSTOMER + ") dc"
# ---- end of fixed values ----------------------------------------------------

VIEWS = {
    "customer_age_copy": (CUSTOMER_AGE_COPY, ("customer",)),
    "categorical_customer": (CATEGORICAL_CUSTOMER, ("customer",)),
    "dirty_customer": (DIRTY_CUSTOMER, ("customer",)),
    "dirty_events": (DIRTY_EVENTS, ("events",)),
    "dirty_dates": (DIRTY_DATES, ("lineitem", "orders")),
    "labelled_documents": (LABELLED_DOCUMENTS, ("documents", "labels")),
}
#: Views that only feature engineering reads.
FEATURE_VIEWS = {
    "generated": (GENERATED, ("customer",)),
    "people": (PEOPLE, ("orders",)),
}
_ALL = VIEWS | FEATURE_VIEWS


def derived(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A derived view as a lazy Spark plan over the test tables."""
    text, tables = _ALL[view]
    frames = {t: read_table(spark, f"{sf_dir}/{t}.parquet") for t in tables}
    return spark.sql(text, **frames)


def oracle_cte(view: str) -> str:
    """The same view for DuckDB (placeholders become the registered views)."""
    text, tables = _ALL[view]
    return text.format(**{t: t for t in tables})
