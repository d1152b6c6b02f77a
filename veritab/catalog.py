"""Registered queries: one Spark callable and (where SQL can say it) one
independent DuckDB oracle per operator of the inventory.

Query keys are ``<operator id>_<operator name>``. Every query reads the
driver's parquet tables in full; computed columns carry the same alias on
both sides, and floating results are rounded to the same number of decimals
on both sides so that the value hashes can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.operators import drift as D
from veritab.operators import profile as P
from veritab.operators import schema as C
from veritab.sources.tables import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rnd(df: DataFrame, digits: int = 6, cols: list[str] | None = None) -> DataFrame:
    """Round every DOUBLE column (or ``cols``) to ``digits`` decimals."""
    out = []
    for f in df.schema.fields:
        if (cols is None and f.dataType.typeName() in ("double", "float")) or (cols and f.name in cols):
            out.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# ---------------------------------------------------------------------------
# Shared inputs
# ---------------------------------------------------------------------------

SHIP_SPLIT = "1998-05-24"  # median ship date: lineitem halves
EVENT_SPLIT = "2024-01-16"
LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CAT = ["l_returnflag", "l_linestatus"]
LINE_ALL_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE_NUM]
LINE_ALL_CAT = [*LINE_CAT, "l_shipdate"]


def lineitem_halves(spark, sf):
    li = load_table(spark, sf, "lineitem")
    cut = F.lit(SHIP_SPLIT).cast("timestamp_ntz")
    return li.where(F.col("l_shipdate") < cut), li.where(F.col("l_shipdate") >= cut)


def events_halves(spark, sf):
    ev = load_table(spark, sf, "events")
    cut = F.lit(EVENT_SPLIT).cast("timestamp_ntz")
    return ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut)


LI_R = f"(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{SHIP_SPLIT}')"
LI_C = f"(SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{SHIP_SPLIT}')"
EV_R = f"(SELECT * FROM events WHERE ts < TIMESTAMP '{EVENT_SPLIT}')"
EV_C = f"(SELECT * FROM events WHERE ts >= TIMESTAMP '{EVENT_SPLIT}')"


# ---------------------------------------------------------------------------
# SQL builders for the oracle side (DuckDB dialect)
# ---------------------------------------------------------------------------

def sql_numeric_drift(r: str, c: str, col: str, digits: int = 10) -> str:
    return f"""SELECT '{col}' AS column_name,
  round(((abs(a.m - b.m) / (abs(a.m) + 1e-10)) + (abs(a.s - b.s) / (abs(a.s) + 1e-10))) / 2, {digits}) AS drift_score
FROM (SELECT avg({col}) AS m, stddev_samp({col}) AS s FROM {r}) a,
     (SELECT avg({col}) AS m, stddev_samp({col}) AS s FROM {c}) b"""


def sql_js_drift(r: str, c: str, col: str, digits: int = 10) -> str:
    return f"""SELECT '{col}' AS column_name,
  round(least(1.0, coalesce(sum(0.5 * (p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2)))), 0.0)), {digits}) AS drift_score
FROM (
  SELECT CASE WHEN coalesce(rp, 0) = 0 THEN 1e-10 ELSE rp END AS p,
         CASE WHEN coalesce(cp, 0) = 0 THEN 1e-10 ELSE cp END AS q
  FROM (SELECT CAST({col} AS VARCHAR) AS v, count(*) / sum(count(*)) OVER () AS rp
        FROM {r} WHERE {col} IS NOT NULL GROUP BY 1) x
  FULL OUTER JOIN
       (SELECT CAST({col} AS VARCHAR) AS v, count(*) / sum(count(*)) OVER () AS cp
        FROM {c} WHERE {col} IS NOT NULL GROUP BY 1) y
  USING (v)
) t"""


def sql_drift_report(r: str, c: str, num: list[str], cat: list[str], digits: int = 10) -> str:
    parts = [f"SELECT column_name, 'numeric' AS column_type, drift_score FROM ({sql_numeric_drift(r, c, x, 16)})"
             for x in num]
    parts += [f"SELECT column_name, 'categorical' AS column_type, drift_score FROM ({sql_js_drift(r, c, x, 16)})"
              for x in cat]
    body = "\nUNION ALL\n".join(parts)
    return f"""SELECT column_name, column_type, round(drift_score, {digits}) AS drift_score,
  coalesce(drift_score > 0.1, false) AS drift_detected
FROM ({body}) u"""


def sql_dataset_drift(r: str, c: str, num: list[str], cat: list[str], digits: int = 10) -> str:
    rep = sql_drift_report(r, c, num, cat, 16)
    return f"""SELECT round(CASE WHEN count(*) = 0 THEN 0.0 WHEN count(drift_score) < count(*) THEN NULL
                  ELSE avg(drift_score) END, {digits}) AS drift_score,
  coalesce(CASE WHEN count(*) = 0 THEN 0.0 WHEN count(drift_score) < count(*) THEN NULL
                ELSE avg(drift_score) END > 0.1, false) AS drift_detected,
  count(*) AS n_columns
FROM ({rep}) rep"""


def sql_skew(x: str) -> str:
    # DuckDB's skewness is already bias-corrected; constant -> 0, n < 3 -> NULL.
    return (f"CASE WHEN count({x}) < 3 THEN NULL WHEN stddev_samp({x}) = 0 THEN 0.0 "
            f"ELSE skewness({x}) END")


def sql_corr(x: str, y: str) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    return (f"covar_samp({x}, {y}) / nullif(stddev_samp(CASE WHEN {both} THEN {x} END) * "
            f"stddev_samp(CASE WHEN {both} THEN {y} END), 0)")


def sql_numeric_profile(table: str, cols: list[str], target: str | None, target_numeric=True,
                        digits: int = 6) -> str:
    parts = []
    for x in cols:
        if target is None:
            corr = "CAST(NULL AS DOUBLE)"
        elif target_numeric:
            corr = sql_corr(x, target)
        else:
            corr = "0.0"
        parts.append(f"""SELECT '{x}' AS column_name, round(CAST(min({x}) AS DOUBLE), {digits}) AS min,
  round(CAST(max({x}) AS DOUBLE), {digits}) AS max, round(avg({x}), {digits}) AS mean,
  round(quantile_cont({x}, 0.5), {digits}) AS median, round(stddev_samp({x}), {digits}) AS std,
  round({sql_skew(x)}, {digits}) AS skew, count(*) - count({x}) AS missing,
  round({corr}, {digits}) AS corr_target
FROM {table}""")
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------------------
# C: schema and roles
# ---------------------------------------------------------------------------

@register("c0_normalize_missing", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS l_discount,
       l_tax, l_returnflag
FROM lineitem""")
def q_c0(spark, sf):
    li = load_table(spark, sf, "lineitem")
    nan = F.lit(float("nan"))
    base = li.select("l_orderkey", "l_linenumber",
                     F.when(F.col("l_discount") == 0, nan).otherwise(F.col("l_discount")).alias("l_discount"),
                     "l_tax", "l_returnflag")
    return C.normalize_missing(base)


@register("c1_infer_roles", """
SELECT 0 AS position, 'o_orderkey' AS column_name, 'numeric' AS role, count(o_orderkey) AS non_null FROM orders
UNION ALL SELECT 1, 'o_custkey', 'numeric', count(o_custkey) FROM orders
UNION ALL SELECT 2, 'o_orderstatus', 'target', count(o_orderstatus) FROM orders
UNION ALL SELECT 3, 'o_totalprice', 'numeric', count(o_totalprice) FROM orders
UNION ALL SELECT 4, 'o_orderdate', 'categorical', count(o_orderdate) FROM orders
UNION ALL SELECT 5, 'o_orderpriority', 'categorical', count(o_orderpriority) FROM orders""")
def q_c1(spark, sf):
    return C.roles_table(load_table(spark, sf, "orders"), "o_orderstatus")


@register("c2_infer_task", """
SELECT 'o_orderstatus' AS target, least(count(DISTINCT o_orderstatus), 11) AS n_distinct_capped,
       'classification' AS task FROM orders
UNION ALL
SELECT 'l_linenumber', least(count(DISTINCT l_linenumber), 11),
       CASE WHEN count(DISTINCT l_linenumber) <= 10 THEN 'classification' ELSE 'regression' END FROM lineitem
UNION ALL
SELECT 'c_nationkey', least(count(DISTINCT c_nationkey), 11),
       CASE WHEN count(DISTINCT c_nationkey) <= 10 THEN 'classification' ELSE 'regression' END FROM customer
UNION ALL
SELECT 'label', least(count(DISTINCT label), 11),
       CASE WHEN count(DISTINCT label) <= 10 THEN 'classification' ELSE 'regression' END FROM embeddings""")
def q_c2(spark, sf):
    parts = [C.task_frame(load_table(spark, sf, t), col) for t, col in
             (("orders", "o_orderstatus"), ("lineitem", "l_linenumber"),
              ("customer", "c_nationkey"), ("embeddings", "label"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("c3_common_columns", f"""
SELECT l_discount, l_quantity, l_returnflag, 'reference' AS side FROM {LI_R}
UNION ALL
SELECT l_discount, l_quantity, l_returnflag, 'current' AS side FROM {LI_C}""")
def q_c3(spark, sf):
    r, c = lineitem_halves(spark, sf)
    a = r.select("l_quantity", "l_discount", "l_returnflag", "l_tax")
    b = c.select("l_discount", "l_returnflag", "l_linestatus", "l_quantity")
    return C.align_pair(a, b)


@register("c4_split_features_target", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, o_orderstatus AS label
FROM orders""")
def q_c4(spark, sf):
    return C.features_and_label(load_table(spark, sf, "orders"), "o_orderstatus")


@register("c5_first_n_numeric", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem""")
def q_c5(spark, sf):
    li = load_table(spark, sf, "lineitem")
    return li.select(*C.first_n_numeric(li, 5))


@register("c6_append_columns", """
SELECT *, CAST(o_orderstatus = 'F' AS DOUBLE) AS is_finished,
       round(o_totalprice / 1000, 6) AS price_k
FROM orders""")
def q_c6(spark, sf):
    o = load_table(spark, sf, "orders")
    return C.append_columns(o, {"is_finished": (F.col("o_orderstatus") == "F").cast("double"),
                                "price_k": F.round(F.col("o_totalprice") / 1000, 6)})


# ---------------------------------------------------------------------------
# D: drift
# ---------------------------------------------------------------------------

@register("d1_numeric_drift", "\nUNION ALL\n".join(
    sql_numeric_drift(LI_R, LI_C, x) for x in LINE_NUM))
def q_d1(spark, sf):
    r, c = lineitem_halves(spark, sf)
    return rnd(D.numeric_drift(r, c, LINE_NUM).select("column_name", "drift_score"), 10)


@register("d1_numeric_drift_shifted", "\nUNION ALL\n".join(
    sql_numeric_drift("lineitem", "(SELECT * FROM lineitem WHERE l_quantity > 20)", x)
    for x in LINE_NUM))
def q_d1s(spark, sf):
    li = load_table(spark, sf, "lineitem")
    return rnd(D.numeric_drift(li, li.where(F.col("l_quantity") > 20), LINE_NUM)
               .select("column_name", "drift_score"), 10)


@register("d2_categorical_drift", "\nUNION ALL\n".join(
    sql_js_drift(LI_R, LI_C, x) for x in LINE_CAT))
def q_d2(spark, sf):
    r, c = lineitem_halves(spark, sf)
    return rnd(D.categorical_drift(r, c, LINE_CAT), 10)


@register("d2_categorical_drift_lang", "\nUNION ALL\n".join(
    sql_js_drift("(SELECT * FROM documents WHERE lang = 'en')",
                 "(SELECT * FROM documents WHERE lang <> 'en')", x) for x in ["source", "lang"]))
def q_d2l(spark, sf):
    d = load_table(spark, sf, "documents")
    return rnd(D.categorical_drift(d.where(F.col("lang") == "en"), d.where(F.col("lang") != "en"),
                                   ["source", "lang"]), 10)


@register("d3_dataset_drift", sql_dataset_drift(LI_R, LI_C, LINE_ALL_NUM, LINE_ALL_CAT))
def q_d3(spark, sf):
    r, c = lineitem_halves(spark, sf)
    return rnd(D.dataset_drift(r, c), 10)


@register("d3_dataset_drift_events", sql_dataset_drift(EV_R, EV_C, ["event_id", "user_id", "value"], ["ts", "event_type", "props"]))
def q_d3e(spark, sf):
    r, c = events_halves(spark, sf)
    return rnd(D.dataset_drift(r, c), 10)


@register("d4_mean_shift", """
SELECT column_name, round(train_mean, 6) AS train_mean, round(test_mean, 6) AS test_mean,
       round(abs(train_mean - test_mean) / (abs(train_mean) + 1e-10) * 100, 6) AS shift_pct,
       coalesce(abs(train_mean - test_mean) / (abs(train_mean) + 1e-10) * 100 > 20, false) AS shifted
FROM (
  SELECT 'o_custkey' AS column_name, avg(o_custkey) FILTER (WHERE s) AS train_mean,
         avg(o_custkey) FILTER (WHERE NOT s) AS test_mean FROM (
    SELECT *, ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8))::BIGINT < 0.8 * 4294967296 AS s
    FROM orders) o
  UNION ALL
  SELECT 'o_totalprice', avg(o_totalprice) FILTER (WHERE s), avg(o_totalprice) FILTER (WHERE NOT s) FROM (
    SELECT *, ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8))::BIGINT < 0.8 * 4294967296 AS s
    FROM orders) o
) t""")
def q_d4(spark, sf):
    from veritab.operators.prep import train_test_split
    o = train_test_split(load_table(spark, sf, "orders"), 0.8, key="o_orderkey")
    return rnd(D.mean_shift(o, ["o_custkey", "o_totalprice"]), 6)


@register("d5_target_drift", sql_drift_report(LI_R, LI_C, [], ["l_returnflag"]) + "\nUNION ALL\n"
          + sql_drift_report(LI_R, LI_C, ["l_extendedprice"], []))
def q_d5(spark, sf):
    r, c = lineitem_halves(spark, sf)
    return rnd(D.target_drift(r, c, "l_returnflag").unionByName(
        D.target_drift(r, c, "l_extendedprice")), 10)


@register("d6_drift_report", sql_drift_report(LI_R, LI_C, LINE_ALL_NUM, LINE_ALL_CAT))
def q_d6(spark, sf):
    r, c = lineitem_halves(spark, sf)
    return rnd(D.drift_report(r, c), 10)


def _sql_quality(table: str, cols: list[str], side: str | None = None) -> str:
    miss = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in cols)
    side_sel = f"'{side}' AS side, " if side else ""
    return f"""SELECT {side_sel}count(*) AS row_count, CAST({len(cols)} AS BIGINT) AS column_count,
  CAST(coalesce(sum({miss}), 0) AS BIGINT) AS missing_cells,
  round(coalesce(sum({miss}), 0) / nullif(count(*) * {len(cols)}, 0) * 100, 6) AS missing_pct,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(cols)} FROM {table}) d) AS duplicate_rows
FROM {table}"""


LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

LI_NULLED = ("(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
             "nullif(l_discount, 0) AS l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate "
             "FROM lineitem)")


def lineitem_nulled(spark, sf):
    li = load_table(spark, sf, "lineitem")
    return li.select(*[F.nullif(F.col(c), F.lit(0.0)).alias(c) if c == "l_discount" else F.col(c)
                       for c in li.columns])


@register("d7_compare_quality", _sql_quality(LI_R, LI_ALL, "reference") + "\nUNION ALL\n"
          + _sql_quality(LI_C, LI_ALL, "current"))
def q_d7(spark, sf):
    r, c = lineitem_halves(spark, sf)
    return rnd(D.compare_quality(r, c), 6)


# ---------------------------------------------------------------------------
# Q: profiles
# ---------------------------------------------------------------------------

@register("q1_profile_numeric", sql_numeric_profile(
    LI_NULLED, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_discount", "l_tax"], "l_extendedprice"))
def q_q1(spark, sf):
    return rnd(P.profile_numeric(lineitem_nulled(spark, sf).drop("l_shipdate", "l_returnflag",
                                                                   "l_linestatus"),
                                 target="l_extendedprice"), 6)


@register("q1_profile_numeric_orders", sql_numeric_profile(
    "orders", ["o_orderkey", "o_custkey"], "o_orderstatus", target_numeric=False))
def q_q1o(spark, sf):
    o = load_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                               "o_orderdate", "o_orderpriority", "o_orderstatus")
    return rnd(P.profile_numeric(o, target="o_orderstatus", columns=["o_orderkey", "o_custkey"]), 6)


def _sql_cat_profile(table: str, cols: list[str]) -> str:
    parts = []
    for x in cols:
        parts.append(f"""SELECT '{x}' AS column_name, count(DISTINCT {x}) AS n_distinct,
  count(*) - count({x}) AS missing,
  (SELECT v FROM (SELECT CAST({x} AS VARCHAR) AS v, count(*) AS n FROM {table} WHERE {x} IS NOT NULL
                  GROUP BY 1) ORDER BY n DESC, v ASC LIMIT 1) AS most_common,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM {table} WHERE {x} IS NOT NULL GROUP BY {x})) AS most_common_count
FROM {table}""")
    return "\nUNION ALL\n".join(parts)


@register("q2_profile_categorical", _sql_cat_profile("orders", ["o_orderdate", "o_orderpriority"]))
def q_q2(spark, sf):
    return P.profile_categorical(load_table(spark, sf, "orders"), target="o_orderstatus")


@register("q2_profile_categorical_part", _sql_cat_profile("part", ["p_name", "p_brand", "p_type"]))
def q_q2p(spark, sf):
    return P.profile_categorical(load_table(spark, sf, "part"), target="p_retailprice")


@register("q3_profile_target_regression", """
SELECT 'p_retailprice' AS column_name, round(min(p_retailprice), 6) AS min, round(max(p_retailprice), 6) AS max,
  round(avg(p_retailprice), 6) AS mean, round(quantile_cont(p_retailprice, 0.5), 6) AS median,
  round(stddev_samp(p_retailprice), 6) AS std,
  round(CASE WHEN count(p_retailprice) < 3 THEN NULL WHEN stddev_samp(p_retailprice) = 0 THEN 0.0
             ELSE skewness(p_retailprice) END, 6) AS skew
FROM part""")
def q_q3(spark, sf):
    return rnd(P.profile_target_regression(load_table(spark, sf, "part"), "p_retailprice"), 6)


@register("q4_profile_target_classes", """
SELECT count(*) AS n_classes,
  arg_min(c, (-n, c)) AS most_frequent, max(n) AS most_frequent_count,
  arg_min(c, (n, c)) AS least_frequent, min(n) AS least_frequent_count
FROM (SELECT c_mktsegment AS c, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1) t""")
def q_q4(spark, sf):
    return P.profile_target_classes(load_table(spark, sf, "customer"), "c_mktsegment")


@register("q4_class_counts", """
SELECT CAST(l_linenumber AS VARCHAR) AS class, count(*) AS count FROM lineitem GROUP BY 1""")
def q_q4c(spark, sf):
    return P.class_counts(load_table(spark, sf, "lineitem"), "l_linenumber")


@register("q5_feature_stats", f"""
SELECT column_name, min, max, mean, median, std, skew, missing, 'numeric' AS type,
       CAST(NULL AS BIGINT) AS n_distinct, CAST(NULL AS VARCHAR) AS most_common,
       CAST(NULL AS BIGINT) AS most_common_count
FROM ({sql_numeric_profile('customer', ['c_custkey', 'c_nationkey', 'c_acctbal'], None)})
UNION ALL
SELECT column_name, NULL, NULL, NULL, NULL, NULL, NULL, missing, 'categorical', n_distinct, most_common,
       most_common_count
FROM ({_sql_cat_profile('customer', ['c_name'])})""")
def q_q5(spark, sf):
    return rnd(P.feature_stats(load_table(spark, sf, "customer"), "c_mktsegment"), 6)


@register("q6_correlation_ranking", "\nUNION ALL\n".join(
    f"SELECT '{x}' AS column_name, round(abs({sql_corr(x, 'l_extendedprice')}), 6) AS abs_corr FROM lineitem"
    for x in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]))
def q_q6(spark, sf):
    li = load_table(spark, sf, "lineitem").drop("l_shipdate", "l_returnflag", "l_linestatus")
    return rnd(P.correlation_ranking(li, "l_extendedprice"), 6)


@register("q7_histogram", """
WITH r AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
                  CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
           FROM (SELECT l_extendedprice AS x FROM lineitem WHERE l_extendedprice IS NOT NULL)),
b AS (SELECT CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS n
      FROM lineitem, r WHERE l_extendedprice IS NOT NULL GROUP BY 1)
SELECT g.bin, round(lo + g.bin * (hi - lo) / 30, 6) AS lower, round(lo + (g.bin + 1) * (hi - lo) / 30, 6) AS upper,
       coalesce(b.n, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) g CROSS JOIN r LEFT JOIN b ON g.bin = b.bin""")
def q_q7(spark, sf):
    return rnd(P.histogram(load_table(spark, sf, "lineitem"), "l_extendedprice", 30), 6)


@register("q8_category_frequencies", f"""
SELECT v AS value, round(coalesce(rp, 0), 10) AS ref_freq, round(coalesce(cp, 0), 10) AS cur_freq
FROM (SELECT l_returnflag AS v, count(*) / sum(count(*)) OVER () AS rp FROM {LI_R}
      WHERE l_returnflag IS NOT NULL GROUP BY 1) x
FULL OUTER JOIN (SELECT l_returnflag AS v, count(*) / sum(count(*)) OVER () AS cp FROM {LI_C}
      WHERE l_returnflag IS NOT NULL GROUP BY 1) y USING (v)""")
def q_q8(spark, sf):
    r, c = lineitem_halves(spark, sf)
    return rnd(P.category_frequencies(r, c, "l_returnflag"), 10)


@register("q9_quality_counts", _sql_quality(LI_NULLED, LI_ALL))
def q_q9(spark, sf):
    return rnd(P.quality_counts(lineitem_nulled(spark, sf)), 6)


@register("q10_dataset_summary", """
SELECT count(*) AS n_samples, CAST(5 AS BIGINT) AS n_features, 'o_orderstatus' AS target,
       'classification' AS problem_type FROM orders""")
def q_q10(spark, sf):
    return P.dataset_summary(load_table(spark, sf, "orders"), "o_orderstatus")


# ---------------------------------------------------------------------------
# S: sources and sinks
# ---------------------------------------------------------------------------

@register("s1_read_dataset", "SELECT * FROM orders")
def q_s1(spark, sf):
    from veritab.sources.readers import read_dataset
    return read_dataset(spark, "Orders Dataset", sf)


@register("s1_read_csv_line_breaks", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus,
       o_orderpriority || chr(10) || '"' || o_orderstatus || '", ' || o_custkey || chr(13) || chr(10) || '""' AS note
FROM orders""")
def q_s1_csv(spark, sf):
    import uuid

    from veritab.session import checkpoint_dir
    from veritab.sources.readers import read_dataset
    note = F.concat("o_orderpriority", F.lit('\n"'), "o_orderstatus", F.lit('", '), F.col("o_custkey").cast("string"),
                    F.lit('\r\n""'))
    root = f"{checkpoint_dir(spark).rstrip('/')}/veritab-csv/{uuid.uuid4().hex}"
    (load_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", note.alias("note"))
     .write.option("header", True).option("escape", '"').csv(f"{root}/order_notes.csv"))
    read = read_dataset(spark, "Order Notes", root)
    return read.withColumns({c: F.col(c).cast("bigint") for c in ("o_orderkey", "o_custkey")})


MIXED_RECORD = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '[' || event_id || ']' WHEN 2 THEN '{"k": "text"}'
 WHEN 3 THEN '{"k": 1' WHEN 4 THEN '{"k": 1.5, "n": ' || event_id || ', "z": {"a": [1, 2.5]}}'
 ELSE '{"k": {"deep": true}, "n": 0.5}' END"""


@register("s2_read_mixed_records", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN json_extract_string(props, '$.k') WHEN 2 THEN 'text' WHEN 4 THEN '1.5'
                 ELSE '{"deep":true}' END AS k,
       CASE event_id % 6 WHEN 4 THEN event_id::DOUBLE WHEN 5 THEN 0.5 END AS n,
       CASE event_id % 6 WHEN 4 THEN 2.5 END::DOUBLE AS second
FROM events WHERE event_id % 6 NOT IN (1, 3)""")
def q_s2_mixed(spark, sf):
    from veritab.sources.readers import read_records
    ev = load_table(spark, sf, "events").select("event_id", F.expr(MIXED_RECORD).alias("record"))
    return read_records(spark, ev, column="record", keep=["event_id"]).select(
        "event_id", "k", "n", F.col("z.a")[1].alias("second"))


@register("s2_count_records", """
SELECT count(*) AS records, count(*) FILTER (event_id % 6 NOT IN (1, 3)) AS read, count(*) FILTER (event_id % 6 IN (1, 3)) AS skipped
FROM events""")
def q_s2_count(spark, sf):
    from veritab.sources.readers import count_records
    ev = load_table(spark, sf, "events").select("event_id", F.expr(MIXED_RECORD).alias("record"))
    return count_records(spark, ev, "record")


@register("s2_read_records", """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def q_s2(spark, sf):
    from veritab.sources.readers import read_records
    ev = load_table(spark, sf, "events")
    return read_records(spark, ev, column="props", keep=["event_id", "event_type"])


ORDERS_SPLIT_SQL = """
SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8))::BIGINT
                         < 0.8 * 4294967296 THEN 'train' ELSE 'test' END AS split
FROM orders"""


@register("s5_save_load_prepared", ORDERS_SPLIT_SQL)
def q_s5(spark, sf):
    from veritab.operators.prep import train_test_split
    from veritab.sources.storage import load_prepared, save_prepared
    o = train_test_split(load_table(spark, sf, "orders").select("o_orderkey"), 0.8, key="o_orderkey")
    name = "orders_split_" + sf.rstrip("/").rsplit("/", 1)[-1].replace(".", "_")
    save_prepared(o, name)
    return load_prepared(spark, name).select("o_orderkey", "split")


# ---------------------------------------------------------------------------
# P: preparation
# ---------------------------------------------------------------------------

@register("p1_drop_nulls", f"SELECT * FROM {LI_NULLED} WHERE l_discount IS NOT NULL")
def q_p1(spark, sf):
    from veritab.operators.prep import drop_nulls
    return drop_nulls(lineitem_nulled(spark, sf))


def _z(c: str) -> str:
    return f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS {c}"


@register("p2_standardize", f"""
SELECT l_orderkey, l_linenumber, {_z('l_quantity')}, {_z('l_extendedprice')}, {_z('l_discount')},
       l_returnflag
FROM {LI_NULLED}""")
def q_p2(spark, sf):
    from veritab.operators.prep import standardize
    li = lineitem_nulled(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity",
                                           "l_extendedprice", "l_discount", "l_returnflag")
    return rnd(standardize(li, ["l_quantity", "l_extendedprice", "l_discount"]), 6)


PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _dummies(col: str, cats: list[str]) -> str:
    return ", ".join(f"CAST(coalesce({col} = '{v}', false) AS DOUBLE) AS \"{col}_{v}\"" for v in cats)


@register("p3_one_hot", f"""
SELECT p_partkey, p_name, p_brand, p_size, p_retailprice, {_dummies('p_type', PART_TYPES)} FROM part""")
def q_p3(spark, sf):
    from veritab.operators.prep import one_hot
    return one_hot(load_table(spark, sf, "part"), ["p_type"])


@register("p4_one_hot_drop_first", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       {_dummies('o_orderpriority', PRIORITIES[1:])} FROM orders""")
def q_p4(spark, sf):
    from veritab.operators.prep import one_hot_drop_first
    return one_hot_drop_first(load_table(spark, sf, "orders"), ["o_orderpriority"])


@register("p5_label_encode", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment
FROM customer""")
def q_p5(spark, sf):
    from veritab.operators.prep import label_encode
    return label_encode(load_table(spark, sf, "customer").select("c_custkey", "c_mktsegment"),
                        "c_mktsegment")[0]


@register("p5_label_encode_many", """
SELECT o_custkey, dense_rank() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS code, CAST(o_orderkey AS VARCHAR) AS back FROM orders""")
def q_p5m(spark, sf):
    """As many labels as orders: codes are ranks from range-dealt values, joined, and joined back."""
    from veritab.operators.prep import decode_by_table, label_encode
    o = load_table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("key"))
    encoded, table = label_encode(o, "key", "code", max_labels=100)
    return decode_by_table(encoded.select("o_custkey", "code"), "code", table, "back")


def _slots(df, vec: str):
    """(slot of the single one or NULL, number of slots) of a one-hot vector."""
    from pyspark.ml.functions import vector_to_array
    v = vector_to_array(vec)
    return F.nullif(F.array_position(v, F.lit(1.0)), F.lit(0)) - 1, F.size(v)


@register("p3_one_hot_wide", """
SELECT o_orderkey, dense_rank() OVER (ORDER BY CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) - 1 AS slot,
       (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) + 1 FROM orders) AS slots FROM orders""")
def q_p3w(spark, sf):
    """A column of thousands of values becomes sparse vectors with slots in sorted order."""
    from veritab.operators.prep import one_hot
    o = load_table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))
    out = one_hot(o, ["day"])
    slot, size = _slots(out, "day_vec")
    return out.select("o_orderkey", slot.cast("long").alias("slot"), size.cast("long").alias("slots"))


@register("p4_one_hot_drop_first_wide", """
SELECT o_orderkey, nullif(dense_rank() OVER (ORDER BY CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) - 1, 0) - 1 AS slot,
       (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) - 1 FROM orders) AS slots FROM orders""")
def q_p4w(spark, sf):
    from veritab.operators.prep import one_hot_drop_first
    o = load_table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))
    out = one_hot_drop_first(o, ["day"])
    slot, size = _slots(out, "day_vec")
    return out.select("o_orderkey", slot.cast("long").alias("slot"), size.cast("long").alias("slots"))


@register("p6_train_test_split", ORDERS_SPLIT_SQL)
def q_p6(spark, sf):
    from veritab.operators.prep import train_test_split
    return train_test_split(load_table(spark, sf, "orders").select("o_orderkey"), 0.8, key="o_orderkey")


@register("p6_train_test_split_exact", """
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY h, o_orderkey)
                             <= count(*) OVER () - ceil(0.2 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split
FROM (SELECT o_orderkey, ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8))::BIGINT AS h
      FROM orders) t""")
def q_p6x(spark, sf):
    from veritab.operators.prep import train_test_split
    return train_test_split(load_table(spark, sf, "orders").select("o_orderkey"), 0.8,
                            key="o_orderkey", exact=True)


def _z_pop(c: str, src: str) -> str:
    return (f"round(({c} - (SELECT avg({c}) FROM {src})) / "
            f"coalesce(nullif((SELECT stddev_pop({c}) FROM {src}), 0), 1), 6) AS {c}")


ORDERS_PREP_SRC = "(SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders)"


@register("p7_prepare", f"""
SELECT {_z_pop('o_orderkey', ORDERS_PREP_SRC)}, {_z_pop('o_custkey', ORDERS_PREP_SRC)},
       {_z_pop('o_totalprice', ORDERS_PREP_SRC)}, {_dummies('o_orderpriority', PRIORITIES)},
       CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus,
       CASE WHEN ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8))::BIGINT
                 < 0.8 * 4294967296 THEN 'train' ELSE 'test' END AS split
FROM {ORDERS_PREP_SRC} o""")
def q_p7(spark, sf):
    from veritab.plans.prepare import prepare
    o = load_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                               "o_orderpriority", "o_orderstatus")
    return rnd(prepare(o, ratio=0.8, key="o_orderkey").data, 6)


@register("p7_prepare_all_columns", f"""
SELECT {_z_pop('o_orderkey', 'orders')}, {_z_pop('o_custkey', 'orders')}, {_z_pop('o_totalprice', 'orders')}, {_dummies('o_orderpriority', PRIORITIES)},
       CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus,
       CASE WHEN ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8))::BIGINT
                 < 0.8 * 4294967296 THEN 'train' ELSE 'test' END AS split,
       dense_rank() OVER (ORDER BY CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) - 1 AS day_slot,
       (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) + 1 FROM orders) AS day_slots
FROM orders o""")
def q_p7a(spark, sf):
    """All six columns of orders; the date, as text, becomes a sparse vector."""
    from veritab.plans.prepare import prepare
    o = load_table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date").cast("string"))
    data = prepare(o, ratio=0.8, target="o_orderstatus", key="o_orderkey").data
    slot, size = _slots(data, "o_orderdate_vec")
    return rnd(data.withColumns({"day_slot": slot.cast("long"), "day_slots": size.cast("long")}).drop("o_orderdate_vec"), 6)


@register("p7_dataset_stats", """
SELECT count(*) AS rows, CAST(5 AS BIGINT) AS columns,
       count(*) FILTER (WHERE ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8))::BIGINT
                        < 0.8 * 4294967296) AS train_size,
       count(*) FILTER (WHERE ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8))::BIGINT
                        >= 0.8 * 4294967296) AS test_size,
       'o_orderkey|o_custkey|o_totalprice|o_orderpriority_1-URGENT|o_orderpriority_2-HIGH|o_orderpriority_3-MEDIUM|o_orderpriority_4-NOT SPECIFIED|o_orderpriority_5-LOW' AS features,
       'o_orderstatus' AS target, CAST(8 AS BIGINT) AS num_features,
       CAST(1 AS BIGINT) AS categorical_features, CAST(3 AS BIGINT) AS numerical_features
FROM orders""")
def q_p7s(spark, sf):
    from veritab.plans.prepare import prepare
    o = load_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                               "o_orderpriority", "o_orderstatus")
    st = prepare(o, ratio=0.8, key="o_orderkey").stats
    return st.withColumn("features", F.array_join("features", "|"))


# ---------------------------------------------------------------------------
# E: evaluation (deterministic predictions made from the data itself)
# ---------------------------------------------------------------------------

ORDER_PRED_SQL = """(SELECT o_orderkey, o_orderstatus AS label,
  CASE WHEN o_orderkey % 5 = 0 THEN 'P' WHEN o_orderkey % 7 = 0 THEN 'F' ELSE o_orderstatus END AS prediction
  FROM orders)"""
LINE_PRED_SQL = """(SELECT l_extendedprice AS label,
  l_extendedprice * (0.9 + 0.2 * l_tax) + l_quantity AS prediction FROM lineitem)"""


def order_predictions(spark, sf):
    o = load_table(spark, sf, "orders")
    pred = (F.when(F.col("o_orderkey") % 5 == 0, F.lit("P"))
            .when(F.col("o_orderkey") % 7 == 0, F.lit("F")).otherwise(F.col("o_orderstatus")))
    return o.select("o_orderkey", F.col("o_orderstatus").alias("label"), pred.alias("prediction"))


def line_predictions(spark, sf):
    li = load_table(spark, sf, "lineitem")
    return li.select(F.col("l_extendedprice").alias("label"),
                     (F.col("l_extendedprice") * (0.9 + 0.2 * F.col("l_tax")) + F.col("l_quantity"))
                     .alias("prediction"))


PER_CLASS_SQL = f"""
SELECT class, coalesce(a.n, 0) AS support, coalesce(p.n, 0) AS predicted, coalesce(t.n, 0) AS tp,
       coalesce(coalesce(t.n, 0) / nullif(coalesce(p.n, 0), 0), 0.0) AS precision,
       coalesce(coalesce(t.n, 0) / nullif(coalesce(a.n, 0), 0), 0.0) AS recall
FROM (SELECT label AS class, count(*) AS n FROM {ORDER_PRED_SQL} GROUP BY 1) a
FULL OUTER JOIN (SELECT prediction AS class, count(*) AS n FROM {ORDER_PRED_SQL} GROUP BY 1) p USING (class)
LEFT JOIN (SELECT label AS class, count(*) AS n FROM {ORDER_PRED_SQL} WHERE label = prediction GROUP BY 1) t
  USING (class)"""

PER_CLASS_F1_SQL = f"""SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1
FROM ({PER_CLASS_SQL}) pc"""


@register("e1_accuracy", f"""
SELECT round(avg(CAST(coalesce(label = prediction, false) AS DOUBLE)), 10) AS accuracy FROM {ORDER_PRED_SQL}""")
def q_e1(spark, sf):
    from veritab.operators.evaluate import accuracy
    return rnd(accuracy(order_predictions(spark, sf)), 10)


@register("e2_per_class_metrics", f"""
SELECT class, support, predicted, tp, round(precision, 10) AS precision, round(recall, 10) AS recall,
       round(f1, 10) AS f1 FROM ({PER_CLASS_F1_SQL}) x""")
def q_e2c(spark, sf):
    from veritab.operators.evaluate import per_class_metrics
    return rnd(per_class_metrics(order_predictions(spark, sf)), 10)


@register("e2_macro_precision_recall_f1", f"""
SELECT round(avg(precision), 10) AS precision, round(avg(recall), 10) AS recall, round(avg(f1), 10) AS f1
FROM ({PER_CLASS_F1_SQL}) x""")
def q_e2(spark, sf):
    from veritab.operators.evaluate import macro_precision_recall_f1
    return rnd(macro_precision_recall_f1(order_predictions(spark, sf)), 10)


CLASS_METRICS_SQL = f"""
SELECT 'Accuracy' AS name, avg(CAST(coalesce(label = prediction, false) AS DOUBLE)) AS value FROM {ORDER_PRED_SQL}
UNION ALL SELECT 'Precision', avg(precision) FROM ({PER_CLASS_F1_SQL}) x
UNION ALL SELECT 'Recall', avg(recall) FROM ({PER_CLASS_F1_SQL}) x
UNION ALL SELECT 'F1 Score', avg(f1) FROM ({PER_CLASS_F1_SQL}) x"""


@register("e2_classification_metrics", f"SELECT name, round(value, 10) AS value FROM ({CLASS_METRICS_SQL}) m")
def q_e2m(spark, sf):
    from veritab.operators.evaluate import classification_metrics
    return rnd(classification_metrics(order_predictions(spark, sf)), 10)


@register("e3_confusion_matrix", f"""
WITH c AS (SELECT label AS c FROM {ORDER_PRED_SQL} UNION SELECT prediction FROM {ORDER_PRED_SQL}),
n AS (SELECT label, prediction, count(*) AS n FROM {ORDER_PRED_SQL} GROUP BY 1, 2)
SELECT a.c AS label, b.c AS prediction, coalesce(n.n, 0) AS count
FROM c a CROSS JOIN c b LEFT JOIN n ON n.label = a.c AND n.prediction = b.c
WHERE a.c IS NOT NULL AND b.c IS NOT NULL""")
def q_e3(spark, sf):
    from veritab.operators.evaluate import confusion_matrix
    return confusion_matrix(order_predictions(spark, sf))


@register("e4_regression_metrics", f"""
WITH a AS (SELECT avg(pow(label - prediction, 2)) AS mse, avg(abs(label - prediction)) AS mae,
                  var_pop(label) AS vy FROM {LINE_PRED_SQL})
SELECT 'MSE' AS name, round(mse, 6) AS value FROM a
UNION ALL SELECT 'RMSE', round(sqrt(mse), 6) FROM a
UNION ALL SELECT 'MAE', round(mae, 6) FROM a
UNION ALL SELECT 'R² Score', round(CASE WHEN vy = 0 THEN CASE WHEN mse = 0 THEN 1.0 ELSE 0.0 END
                                   ELSE 1 - mse / vy END, 6) FROM a""")
def q_e4(spark, sf):
    from veritab.operators.evaluate import regression_metrics
    return rnd(regression_metrics(line_predictions(spark, sf)), 6)


ROC_SQL = """
WITH g AS (SELECT floor(o_totalprice / 1000) AS s, count(*) FILTER (WHERE o_orderstatus = 'F') AS pos,
                  count(*) FILTER (WHERE o_orderstatus <> 'F' OR o_orderstatus IS NULL) AS neg
           FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1),
p AS (SELECT s AS threshold,
             coalesce(sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                      / nullif(sum(neg) OVER (), 0), 0.0) AS fpr,
             coalesce(sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                      / nullif(sum(pos) OVER (), 0), 0.0) AS tpr
      FROM g
      UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0)"""


def order_scores(spark, sf):
    o = load_table(spark, sf, "orders")
    return o.select((F.col("o_orderstatus") == "F").cast("int").alias("label"),
                    F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score"))


@register("e6_roc_curve", ROC_SQL + """
SELECT threshold, round(fpr, 10) AS fpr, round(tpr, 10) AS tpr FROM p""")
def q_e6(spark, sf):
    from veritab.operators.evaluate import roc_points
    return rnd(roc_points(order_scores(spark, sf), "label", "score", positive=1), 10)


@register("e6_roc_auc", ROC_SQL + """
SELECT round(coalesce(sum(a), 0.0), 10) AS roc_auc FROM (
  SELECT (fpr - lag(fpr, 1, 0.0) OVER (ORDER BY threshold DESC))
         * (tpr + lag(tpr, 1, 0.0) OVER (ORDER BY threshold DESC)) / 2 AS a FROM p) t""")
def q_e6a(spark, sf):
    from veritab.operators.evaluate import roc_auc
    return rnd(roc_auc(order_scores(spark, sf), "label", "score", positive=1), 10)


@register("e6_roc_auc_raw_scores", """
WITH g AS (SELECT CASE WHEN o_custkey % 7 = 0 THEN -o_totalprice ELSE o_totalprice END AS s,
                  count(*) FILTER (WHERE o_orderstatus = 'F') AS pos, count(*) FILTER (WHERE o_orderstatus <> 'F') AS neg
           FROM orders GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS cum FROM g)
SELECT round(sum(neg * (cum - pos / 2.0)) / (sum(pos) * sum(neg)), 10) AS roc_auc FROM c""")
def q_e6r(spark, sf):
    from veritab.operators.evaluate import roc_auc
    o = load_table(spark, sf, "orders").select(
        "o_orderstatus", F.when(F.col("o_custkey") % 7 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("score"))
    return rnd(roc_auc(o, "o_orderstatus", "score", positive="F"), 10)


CLASS_SCORES = """SELECT CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 7 END AS label,
       CASE o_orderstatus WHEN 'F' THEN 4 ELSE 0 END + o_orderkey % 7 AS f,
       CASE o_orderstatus WHEN 'O' THEN 2 ELSE 0 END + o_custkey % 11 AS o,
       CASE o_orderstatus WHEN 'P' THEN 3 ELSE 0 END + o_orderkey % 5 + o_custkey % 3 AS p
FROM orders"""
CLASS_PAIRS_SQL = f"""
WITH x AS ({CLASS_SCORES}),
t AS (SELECT 1 AS class, label, o / (f + o + p + 1.0) AS s FROM x UNION ALL SELECT 2, label, f / (f + o + p + 1.0) FROM x
      UNION ALL SELECT 7, label, p / (f + o + p + 1.0) FROM x),
g AS (SELECT class, s, label, count(*) AS n, sum(CASE WHEN label = class THEN count(*) ELSE 0 END) OVER (PARTITION BY class, s) AS tied
      FROM t GROUP BY class, s, label),
c AS (SELECT *, sum(CASE WHEN label = class THEN n ELSE 0 END) OVER (PARTITION BY class ORDER BY s DESC RANGE UNBOUNDED PRECEDING) AS above
      FROM g),
a AS (SELECT class, label AS other, sum(n * (above - tied / 2.0)) AS area, sum(n) AS n_other FROM c GROUP BY class, label),
pairs AS (SELECT a.class, a.other, a.area / (z.n_other * a.n_other) AS auc, z.n_other::BIGINT AS n_class, a.n_other::BIGINT AS n_other
          FROM a JOIN a z ON z.class = a.class AND z.other = a.class WHERE a.other <> a.class)"""


def class_scores(spark, sf):
    load_table(spark, sf, "orders").createOrReplaceTempView("__orders_for_auc")
    x = spark.sql(CLASS_SCORES.replace("FROM orders", "FROM __orders_for_auc"))
    total = F.col("f") + F.col("o") + F.col("p") + F.lit(1.0)
    return x.select("label", F.array(*[F.col(c) / total for c in ("o", "f", "p")]).alias("probability"))


@register("e6_class_pair_auc", CLASS_PAIRS_SQL + """
SELECT class, other, round(auc, 10) AS auc, n_class, n_other FROM pairs""")
def q_e6_pairs(spark, sf):
    from veritab.operators.evaluate import class_pair_auc
    return rnd(class_pair_auc(class_scores(spark, sf), "label", labels=[1, 2, 7]), 10)


@register("e6_multiclass_auc", CLASS_PAIRS_SQL + """
SELECT round((SELECT avg(auc) FROM pairs), 10) AS by_pairs,
       round((SELECT avg(r) FROM (SELECT sum(auc * n_other) / sum(n_other) AS r FROM pairs GROUP BY class)), 10) AS by_classes""")
def q_e6_multi(spark, sf):
    from veritab.operators.evaluate import class_pair_auc, multiclass_auc
    pairs = class_pair_auc(class_scores(spark, sf), "label", labels=[1, 2, 7])
    out = (multiclass_auc(pairs).withColumnRenamed("roc_auc", "by_pairs")
           .join(multiclass_auc(pairs, "classes").withColumnRenamed("roc_auc", "by_classes"), F.lit(True)))
    return rnd(out, 10)


@register("e6_auc_labels_1_2", f"""
WITH x AS (SELECT label, f / (f + o + 1.0) AS s FROM ({CLASS_SCORES}) WHERE label IN (1, 2)),
r AS (SELECT label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM x)
SELECT round((sum(r) FILTER (label = 2) - count(*) FILTER (label = 2) * (count(*) FILTER (label = 2) + 1) / 2.0)
             / (count(*) FILTER (label = 2) * count(*) FILTER (label = 1)), 10) AS roc_auc FROM r""")
def q_e6_12(spark, sf):
    from veritab.operators.evaluate import class_pair_auc, multiclass_auc
    load_table(spark, sf, "orders").createOrReplaceTempView("__orders_for_auc")
    x = spark.sql(CLASS_SCORES.replace("FROM orders", "FROM __orders_for_auc")).where("label in (1, 2)")
    p = F.col("f") / (F.col("f") + F.col("o") + F.lit(1.0))
    return rnd(multiclass_auc(class_pair_auc(x.select("label", F.array(1 - p, p).alias("probability")), "label", labels=[1, 2])), 10)


@register("e6_log_loss", f"""
WITH x AS (SELECT label, f, o, p, f + o + p + 1.0 AS t FROM ({CLASS_SCORES}))
SELECT round(avg(-ln(greatest(CASE label WHEN 1 THEN o / t WHEN 2 THEN f / t ELSE p / t END, 1e-15))), 8) AS log_loss FROM x""")
def q_e6_log_loss(spark, sf):
    from veritab.operators.evaluate import log_loss
    return rnd(log_loss(class_scores(spark, sf), "label", labels=[1, 2, 7]), 8)


# ---------------------------------------------------------------------------
# T: tuning
# ---------------------------------------------------------------------------

@register("t2_assign_folds", """
SELECT o_orderkey, CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8))::BIGINT % 3 AS INTEGER)
       AS fold FROM orders""")
def q_t2(spark, sf):
    from veritab.operators.tuning import assign_folds
    return assign_folds(load_table(spark, sf, "orders").select("o_orderkey"), 3, key="o_orderkey")


@register("t2_assign_folds_stratified", """
SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY h, o_orderkey) - 1) % 3 AS INTEGER)
       AS fold
FROM (SELECT o_orderkey, o_orderstatus,
             ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8))::BIGINT AS h FROM orders) t""")
def q_t2s(spark, sf):
    from veritab.operators.tuning import assign_folds
    o = load_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return assign_folds(o, 3, key="o_orderkey", stratify="o_orderstatus").select("o_orderkey", "fold")


@register("t2_assign_folds_null_class", """
SELECT cls, fold, count(*) AS n FROM (
  SELECT cls, CAST((row_number() OVER (PARTITION BY cls ORDER BY h, o_orderkey) - 1) % 3 AS INTEGER) AS fold
  FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS cls,
               ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8))::BIGINT AS h FROM orders) t) f
GROUP BY ALL""")
def q_t2n(spark, sf):
    from veritab.operators.tuning import assign_folds
    o = load_table(spark, sf, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("cls"))
    return (assign_folds(o, 3, key="o_orderkey", stratify="cls").groupBy("cls", "fold")
            .agg(F.count("*").alias("n")))


@register("p6_train_test_split_null_keys", """
SELECT CAST(count(*) AS BIGINT) AS n, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS null_keys,
       true AS null_keys_on_both_sides FROM orders""")
def q_p6n(spark, sf):
    from veritab.operators.prep import train_test_split
    o = load_table(spark, sf, "orders").withColumn("k", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey")))
    out = train_test_split(o, 0.8, key="k", exact=True)
    train = F.count_if(F.col("k").isNull() & (F.col("split") == "train"))
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("k").isNull()).alias("null_keys"),
                   (F.abs(train / F.count_if(F.col("k").isNull()) - 0.8) < 0.1).alias("null_keys_on_both_sides"))


@register("t2_boundary_folds", """
WITH x AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS cls,
         ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8))::BIGINT AS h FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY cls) AS n FROM x)
SELECT o_orderkey, CAST(((CASE WHEN i >= n // 3 THEN 1 ELSE 0 END) + (CASE WHEN i >= 2 * n // 3 THEN 1 ELSE 0 END)
       + ('0x' || substr(md5(coalesce('=' || cls, '')), 1, 8))::BIGINT) % 3 AS INTEGER) AS fold
FROM r""")
def q_t2b(spark, sf):
    """Folds by boundary keys, stratified by a class with NULLs."""
    from veritab.operators.tuning import boundary_folds
    o = load_table(spark, sf, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("cls"))
    return boundary_folds(o, 3, key="o_orderkey", stratify="cls").select("o_orderkey", "fold")


@register("t4_rank_results", """
WITH s AS (SELECT l_linenumber AS combo, l_orderkey % 3 AS fold, avg(l_discount) AS score
           FROM lineitem GROUP BY 1, 2),
a AS (SELECT combo, avg(score) AS m, stddev_pop(score) AS sd FROM s GROUP BY 1)
SELECT combo, round(m, 10) AS mean_test_score, round(sd, 10) AS std_test_score,
       CAST(rank() OVER (ORDER BY m DESC) AS INTEGER) AS rank_test_score FROM a""")
def q_t4(spark, sf):
    from veritab.operators.tuning import rank_results
    li = load_table(spark, sf, "lineitem")
    scores = (li.groupBy(F.col("l_linenumber").alias("combo"), (F.col("l_orderkey") % 3).alias("fold"))
              .agg(F.avg("l_discount").alias("score")))
    return rnd(rank_results(scores), 10)


# ---------------------------------------------------------------------------
# G: gates and test suites
# ---------------------------------------------------------------------------

REQUIREMENTS = [("Accuracy", 0.9, "Model must achieve at least 90% accuracy"),
                ("Precision", 0.5, "Macro precision at least 0.5"),
                ("Latency", 100.0, "Model inference time must be under 100ms")]


def requirements_frame(spark):
    return spark.createDataFrame(REQUIREMENTS, "name string, threshold double, description string")


REQ_SQL = " UNION ALL ".join(f"SELECT '{n}' AS name, CAST({t} AS DOUBLE) AS threshold, '{d}' AS description"
                             for n, t, d in REQUIREMENTS)


@register("g1_check_requirements", f"""
SELECT r.name, r.threshold, CASE WHEN r.name IN ('Latency', 'Latency (ms)', 'MSE', 'RMSE', 'MAE') THEN '<='
       ELSE '>=' END AS direction, r.description, round(m.value, 10) AS value,
       CASE WHEN m.value IS NULL THEN 'unknown'
            WHEN (CASE WHEN r.name IN ('Latency', 'Latency (ms)', 'MSE', 'RMSE', 'MAE') THEN m.value <= r.threshold
                       ELSE m.value >= r.threshold END) THEN 'met' ELSE 'not-met' END AS status
FROM ({REQ_SQL}) r LEFT JOIN ({CLASS_METRICS_SQL}) m USING (name)""")
def q_g1(spark, sf):
    from veritab.operators.evaluate import classification_metrics
    from veritab.operators.gates import check_requirements
    m = classification_metrics(order_predictions(spark, sf))
    return rnd(check_requirements(m, requirements_frame(spark)), 10)


@register("g2_evaluation_gate", f"""
SELECT name, round(value, 10) AS value,
       CAST(CASE name WHEN 'Accuracy' THEN 0.9 WHEN 'Precision' THEN 0.85 WHEN 'Recall' THEN 0.8
                 WHEN 'F1 Score' THEN 0.85 WHEN 'Latency (ms)' THEN 100.0 ELSE 0.8 END AS DOUBLE) AS target,
       '>=' AS direction,
       value >= CASE name WHEN 'Accuracy' THEN 0.9 WHEN 'Precision' THEN 0.85 WHEN 'Recall' THEN 0.8
                 WHEN 'F1 Score' THEN 0.85 WHEN 'Latency (ms)' THEN 100.0 ELSE 0.8 END AS passed
FROM ({CLASS_METRICS_SQL}) m""")
def q_g2(spark, sf):
    from veritab.operators.evaluate import classification_metrics
    from veritab.operators.gates import evaluation_gate
    return rnd(evaluation_gate(classification_metrics(order_predictions(spark, sf))), 10)


def _details(total: str, failed: str) -> str:
    return (f"CASE WHEN {failed} > 0 THEN 'Ran ' || {total} || ' test cases with ' || {failed} || ' failures.' "
            f"ELSE 'All ' || {total} || ' test cases passed successfully.' END")


def _summ(name: str, cases_sql: str) -> str:
    return f"""SELECT '{name}' AS name, count(*) > 0 AND count(*) FILTER (WHERE NOT coalesce(passed, false)) = 0 AS passed,
  count(*) AS total_cases, count(*) FILTER (WHERE NOT coalesce(passed, false)) AS failed_cases,
  {_details('count(*)', "count(*) FILTER (WHERE NOT coalesce(passed, false))")} AS details
FROM ({cases_sql}) c"""


G4_CASES = ("SELECT " + " UNION ALL SELECT ".join(
    [f"(count(*) - count({c})) * 100.0 / count(*) <= 5.0 AS passed FROM {LI_NULLED} t" for c in LI_ALL])
    + f" UNION ALL SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {LI_NULLED}) d)) * 100.0 "
      f"/ count(*) <= 5.0 FROM {LI_NULLED} t2")

G5_CASES = f"""SELECT coalesce(m.value >= t.lim, false) AS passed
FROM (SELECT 'Accuracy' AS name, 0.8 AS lim UNION ALL SELECT 'Precision', 0.75 UNION ALL SELECT 'Recall', 0.7
      UNION ALL SELECT 'F1 Score', 0.75) t LEFT JOIN ({CLASS_METRICS_SQL}) m USING (name)"""

G6_CASES = f"SELECT NOT drift_detected AS passed FROM ({sql_drift_report(LI_R, LI_C, LINE_ALL_NUM, LINE_ALL_CAT)}) r"

FAIR_SRC = """(SELECT d.lang AS grp, l.quality AS label, l.toxic AS prediction
               FROM labels l JOIN documents d USING (doc_id))"""
G7_CASES = f"""WITH g AS (SELECT grp, avg(CAST(prediction = 1 AS DOUBLE)) AS sr,
    count(*) FILTER (WHERE label = 1 AND prediction = 1) / nullif(count(*) FILTER (WHERE label = 1), 0) AS tpr,
    avg(CAST(label = prediction AS DOUBLE)) AS acc FROM {FAIR_SRC} GROUP BY grp)
SELECT coalesce(max(sr) - min(sr) <= 0.1, false) AS passed FROM g
UNION ALL SELECT coalesce(max(tpr) - min(tpr) <= 0.1, false) FROM g
UNION ALL SELECT coalesce(max(acc) - min(acc) <= 0.1, false) FROM g"""


def fairness_input(spark, sf):
    lab = load_table(spark, sf, "labels")
    docs = load_table(spark, sf, "documents").select("doc_id", "lang")
    # labels covers a subset of documents; both sides are keyed by doc_id, so
    # this is a plain equi-join that Spark plans by size (AQE may broadcast).
    return lab.join(docs, "doc_id").select(F.col("lang"), F.col("quality").alias("label"),
                                           F.col("toxic").alias("prediction"))


@register("g3_suite_summary", f"""
WITH r AS ({_summ('DataQualityTest', G4_CASES)} UNION ALL {_summ('ModelPerformanceTest', G5_CASES)}
           UNION ALL {_summ('DataDriftTest', G6_CASES)} UNION ALL {_summ('BiasTest', G7_CASES)})
SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed,
       CASE WHEN count(*) FILTER (WHERE NOT passed) = 0 THEN 'passed' ELSE 'failed' END AS status FROM r""")
def q_g3(spark, sf):
    from veritab.operators import gates as G
    from veritab.operators.evaluate import classification_metrics
    r, c = lineitem_halves(spark, sf)
    results = (G.data_quality_test(lineitem_nulled(spark, sf))
               .unionByName(G.performance_test(classification_metrics(order_predictions(spark, sf))))
               .unionByName(G.drift_test(r, c))
               .unionByName(G.fairness_test(fairness_input(spark, sf), "lang")))
    return G.suite_summary(results)


@register("g4_data_quality_test", _summ("DataQualityTest", G4_CASES))
def q_g4(spark, sf):
    from veritab.operators.gates import data_quality_test
    return data_quality_test(lineitem_nulled(spark, sf))


@register("g5_performance_test", _summ("ModelPerformanceTest", G5_CASES))
def q_g5(spark, sf):
    from veritab.operators.evaluate import classification_metrics
    from veritab.operators.gates import performance_test
    return performance_test(classification_metrics(order_predictions(spark, sf)))


@register("g6_drift_test", _summ("DataDriftTest", G6_CASES))
def q_g6(spark, sf):
    from veritab.operators.gates import drift_test
    r, c = lineitem_halves(spark, sf)
    return drift_test(r, c)


@register("g7_fairness_by_group", f"""
SELECT grp AS "group", count(*) AS n, round(avg(CAST(prediction = 1 AS DOUBLE)), 10) AS selection_rate,
  round(count(*) FILTER (WHERE label = 1 AND prediction = 1) / nullif(count(*) FILTER (WHERE label = 1), 0), 10)
    AS true_positive_rate,
  round(avg(CAST(label = prediction AS DOUBLE)), 10) AS accuracy
FROM {FAIR_SRC} GROUP BY grp""")
def q_g7g(spark, sf):
    from veritab.operators.gates import fairness_by_group
    return rnd(fairness_by_group(fairness_input(spark, sf), "lang"), 10)


@register("g7_fairness_test", _summ("BiasTest", G7_CASES))
def q_g7(spark, sf):
    from veritab.operators.gates import fairness_test
    return fairness_test(fairness_input(spark, sf), "lang")


# ---------------------------------------------------------------------------
# M / E5 / E7 / T3 / T5 / T6 / G8 / S6: model work. A fitted model has no SQL
# twin, but what it was given and how it must do has: targets are made from the
# table, the split is a hash of the key, and the oracle computes rows and labels
# of both parts. ``beats_baseline`` compares with the majority share (plus 0.1)
# or, for regression, asks for an R² of 0.9.
# ---------------------------------------------------------------------------

LINE_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FOREST = {"n_estimators": 20, "max_depth": 8, "min_samples_split": 2}
BULKY = "CASE WHEN l_quantity * (1 - l_discount) > 23 THEN 1 ELSE 0 END"
BULKY_NAMED = "CASE WHEN l_quantity * (1 - l_discount) > 23 THEN 'bulky' ELSE 'small' END"
LINEAR = "3 * l_quantity - 40 * l_discount + 20 * l_tax + l_extendedprice / 5000"
KEY_SPLIT = """('0x' || substr(md5(CAST({k} AS VARCHAR) || ':42'), 1, 8))::BIGINT < 0.8 * 4294967296"""


def line_table(spark, sf, target: str, extra: list[str] = ()):
    """Key, features and a target made from them; as a model's input the key is one feature more."""
    li = load_table(spark, sf, "lineitem")
    return li.select("l_orderkey", *LINE_FEATS, *extra, F.expr(target).alias("target"))


def embedding_table(spark, sf, dims: int = 64):
    e = load_table(spark, sf, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)],
                    (F.col("embedding")[0] + F.col("embedding")[1] > 0).cast("int").alias("target"))


def _fit(table, model_type, params, key="l_orderkey", log=False, **kw):
    from veritab.plans.train import train_dataset
    return train_dataset(table, model_type, params, target="target", key=key, log=log, **kw)


def _checked(res) -> DataFrame:
    """One row: split sizes, the test labels' sum, and whether the model beats the baseline."""
    from veritab.operators import evaluate as E
    data = res.prepared.data
    sizes = data.agg(F.count_if(F.col("split") == "train").alias("train_rows"),
                     F.count_if(F.col("split") == "test").alias("test_rows"))
    labels = res.predictions.agg(F.round(F.sum(F.col("label").cast("double")), 4).alias("label_sum"),
                                 F.count("prediction").alias("predicted"))
    if res.task == "classification":
        majority = (res.predictions.groupBy("label").agg(F.count("*").alias("n"))
                    .agg((F.max("n") / F.sum("n")).alias("share")))
        good = E.accuracy(res.predictions).crossJoin(majority).select(
            (F.col("accuracy") > F.least(F.col("share") + 0.1, F.lit(0.95))).alias("beats_baseline"))
    else:
        good = (E.regression_metrics(res.predictions).where(F.col("name") == E.R2)
                .select((F.col("value") > 0.9).alias("beats_baseline")))
    return sizes.crossJoin(labels).crossJoin(good)


def _checked_sql(target: str, table: str = "lineitem", key: str = "l_orderkey") -> str:
    s = KEY_SPLIT.format(k=key)
    return f"""SELECT count(*) FILTER (WHERE {s}) AS train_rows, count(*) FILTER (WHERE NOT ({s})) AS test_rows,
       round(sum(CASE WHEN {s} THEN 0 ELSE CAST({target} AS DOUBLE) END), 4) AS label_sum,
       count(*) FILTER (WHERE NOT ({s})) AS predicted, true AS beats_baseline FROM {table}"""


@register("m1_random_forest_classifier", _checked_sql(BULKY))
def q_m1(spark, sf):
    return _checked(_fit(line_table(spark, sf, BULKY), "random_forest", FOREST))


@register("m1_random_forest_text_features", _checked_sql(
    "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 ELSE 0 END"))
def q_m1t(spark, sf):
    target = "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 ELSE 0 END"
    return _checked(_fit(line_table(spark, sf, target, LINE_CAT), "random_forest", FOREST))


@register("m2_random_forest_regressor", _checked_sql(LINEAR))
def q_m2(spark, sf):
    return _checked(_fit(line_table(spark, sf, LINEAR), "random_forest", {"n_estimators": 20, "max_depth": 12}))


@register("m3_svm_classifier", _checked_sql(BULKY))
def q_m3(spark, sf):
    return _checked(_fit(line_table(spark, sf, BULKY), "svm", {"C": 1.0, "kernel": "linear", "max_iter": 50}))


@register("m3_svm_classifier_rbf_own_labels", _checked_sql(f"1 + {BULKY}"))
def q_m3r(spark, sf):
    return _checked(_fit(line_table(spark, sf, f"1 + {BULKY}"), "svm", {"C": 10.0, "kernel": "rbf", "gamma": 0.05, "max_iter": 50}))


@register("m4_svm_regressor", _checked_sql(LINEAR))
def q_m4(spark, sf):
    return _checked(_fit(line_table(spark, sf, LINEAR), "svm", {"C": 1.0, "kernel": "linear", "max_iter": 100}))


EMB_TARGET = "CASE WHEN embedding[1] + embedding[2] > 0 THEN 1 ELSE 0 END"


@register("m5_mlp_classifier", _checked_sql(EMB_TARGET, "embeddings", "vec_id"))
def q_m5(spark, sf):
    return _checked(_fit(embedding_table(spark, sf), "neural_network",
                         {"hidden_layer_sizes": "16", "activation": "logistic", "max_iter": 100}, key="vec_id"))


@register("m5_mlp_classifier_relu", _checked_sql(EMB_TARGET, "embeddings", "vec_id"))
def q_m5r(spark, sf):
    return _checked(_fit(embedding_table(spark, sf), "neural_network",
                         {"hidden_layer_sizes": "16", "activation": "relu", "max_iter": 60, "lr": 0.02}, key="vec_id"))


@register("m6_mlp_regressor", _checked_sql(LINEAR))
def q_m6(spark, sf):
    return _checked(_fit(line_table(spark, sf, LINEAR), "neural_network",
                         {"hidden_layer_sizes": "16", "activation": "relu", "max_iter": 80, "lr": 0.03}))


@register("m7_predict", f"""
SELECT split, target, count(*) AS n, true AS mostly_right FROM (
  SELECT CASE WHEN {KEY_SPLIT.format(k='l_orderkey')} THEN 'train' ELSE 'test' END AS split, {BULKY} AS target
  FROM lineitem) t GROUP BY ALL""")
def q_m7(spark, sf):
    from veritab.operators.models import predict
    res = _fit(line_table(spark, sf, BULKY), "random_forest", FOREST)
    return (predict(res.model, res.prepared.data).groupBy("split", "target")
            .agg(F.count("*").alias("n"), (F.avg((F.col("prediction") == F.col("target")).cast("double")) > 0.8)
                 .alias("mostly_right")))


@register("m8_assemble", f"""
SELECT {', '.join(LINE_FEATS)}, [{', '.join(LINE_FEATS)}] AS features FROM lineitem""")
def q_m8(spark, sf):
    from veritab.operators.models import features_array
    return features_array(load_table(spark, sf, "lineitem").select(*LINE_FEATS), LINE_FEATS)


@register("m9_train", f"""
SELECT name, true AS sensible FROM (VALUES ('Accuracy'), ('Precision'), ('Recall'), ('F1 Score')) v(name)""")
def q_m9(spark, sf):
    """Labels are text, so the label encoder is part of the run."""
    res = _fit(line_table(spark, sf, BULKY_NAMED), "random_forest", FOREST, log=True, dataset_name="lineitem_m9")
    return res.metrics.select("name", F.col("value").between(0.8, 1.0).alias("sensible"))


ALL_ORDERS_CLASS = "CASE WHEN o_totalprice > 250000 OR o_orderpriority = '1-URGENT' THEN 'hot' ELSE 'cold' END"
ALL_ORDERS_NUMBER = "o_totalprice / 1000 + CASE WHEN o_orderpriority = '1-URGENT' THEN 80 ELSE 0 END"


@register("m9_train_all_columns", f"""
SELECT family, task, count(*) FILTER (WHERE {KEY_SPLIT.format(k='o_orderkey')}) AS train_rows,
       count(*) FILTER (WHERE NOT ({KEY_SPLIT.format(k='o_orderkey')})) AS predicted, true AS beats_baseline
FROM orders, (VALUES ('svm', 'classification'), ('neural_network', 'classification'),
                     ('svm', 'regression'), ('neural_network', 'regression')) f(family, task) GROUP BY family, task""")
def q_m9a(spark, sf):
    """SVMs and networks on all six columns of orders: three numbers, the status and
    the priority as dummies, and the day as a sparse vector of thousands of slots.
    (A forest trains on them as well, but a split looks at fifty of those slots.)"""
    from veritab.operators import evaluate as E
    from veritab.operators.models import train
    from veritab.plans.prepare import prepare
    o = load_table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date").cast("string"))
    out = None
    for task, target in (("classification", ALL_ORDERS_CLASS), ("regression", ALL_ORDERS_NUMBER)):
        p = prepare(o.withColumn("target", F.expr(target)), target="target", key="o_orderkey")
        data = p.data.persist()
        parts = {"svm": {"kernel": "linear", "C": 1.0, "max_iter": 25},
                 "neural_network": {"hidden_layer_sizes": "8", "activation": "relu", "max_iter": 25}}
        for family, params in parts.items():
            model = train(data.where("split = 'train'"), p.features, "target", family, task, params)
            pred = model.transform(data.where("split = 'test'")).select(F.col("target").alias("label"), "prediction")
            if task == "classification":
                share = pred.groupBy("label").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("share"))
                good = E.accuracy(pred).crossJoin(share).select((F.col("accuracy") > F.col("share") + 0.1).alias("beats_baseline"))
            else:
                good = E.regression_metrics(pred).where(F.col("name") == E.R2).select((F.col("value") > 0.9).alias("beats_baseline"))
            own = (data.agg(F.count_if(F.col("split") == "train").alias("train_rows"))
                   .crossJoin(pred.agg(F.count("prediction").alias("predicted"))).crossJoin(good)
                   .select(F.lit(family).alias("family"), F.lit(task).alias("task"), "*"))
            rows = spark.createDataFrame(own.collect(), own.schema)  # one row; the model's pass is done before the data goes
            out = rows if out is None else out.unionByName(rows)
        data.unpersist()
    return out


@register("s6_log_run", f"""
SELECT 'svm' AS model_type, 'lineitem_s6' AS dataset, '{{"C": 1.0, "kernel": "linear", "max_iter": 30}}' AS params,
       CAST(4 AS INTEGER) AS n_metrics, count(*) FILTER (WHERE NOT ({KEY_SPLIT.format(k='l_orderkey')})) AS reloaded_agrees
FROM lineitem""")
def q_s6(spark, sf):
    """The logged row of a run, and how many test rows the reloaded model predicts as the fitted one did."""
    from veritab.sources.storage import load_model, load_runs
    res = _fit(line_table(spark, sf, BULKY), "svm", {"C": 1.0, "kernel": "linear", "max_iter": 30}, log=True,
               dataset_name="lineitem_s6")
    test = res.prepared.data.where(F.col("split") == "test")
    again = load_model(spark, res.model_id).transform(res.model.transform(test).select(
        *test.columns, F.col("prediction").alias("first")))
    same = again.agg(F.count_if(F.col("prediction") == F.col("first")).alias("reloaded_agrees"))
    return (load_runs(spark).where(F.col("model_id") == res.model_id)
            .select("model_type", "dataset", "params", F.size("metrics").alias("n_metrics")).crossJoin(same))


@register("e5_evaluation_report", f"""
WITH t AS (SELECT *, {KEY_SPLIT.format(k='l_orderkey')} AS train FROM lineitem)
SELECT 'data_quality' AS section, 'row_count' AS name, CAST(count(*) FILTER (WHERE NOT train) AS DOUBLE) AS value FROM t
UNION ALL SELECT 'data_quality', 'column_count', 5.0
UNION ALL SELECT 'data_quality', 'missing_cells', 0.0
UNION ALL SELECT 'data_quality', 'missing_pct', 0.0
UNION ALL SELECT 'data_quality', 'duplicate_rows', CAST(count(*) - count(DISTINCT (l_orderkey, l_quantity,
  l_extendedprice, l_discount, l_tax)) AS DOUBLE) FROM t WHERE NOT train
UNION ALL SELECT 'quality', name, 1.0 FROM (VALUES ('Accuracy'), ('Precision'), ('Recall'), ('F1 Score')) v(name)
UNION ALL SELECT 'roc', 'roc_auc', 1.0
""")
def q_e5(spark, sf):
    """Data quality of the test features as computed; metrics and AUC as flags (1: at least 0.8)."""
    from veritab.plans.report import evaluation_report
    res = _fit(line_table(spark, sf, BULKY), "svm", {"C": 1.0, "kernel": "linear", "max_iter": 50}, steps=("drop_nulls",))
    rep = evaluation_report(res.predictions, res.prepared.data, res.prepared.features, res.task)
    dq = rep["data_quality"]
    dq_long = dq.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
                                           for c in dq.columns])))
    flag = (F.col("value") >= 0.8).cast("double").alias("value")
    return (rep["metrics"].select(F.lit("quality").alias("section"), "name", flag)
            .unionByName(rep["roc_auc"].select(F.lit("roc").alias("section"), F.lit("roc_auc").alias("name"),
                                               (F.col("roc_auc") >= 0.8).cast("double").alias("value")))
            .unionByName(dq_long.select(F.lit("data_quality").alias("section"), "name", "value")))


@register("e7_feature_importance", """
SELECT feature, feature = 'l_quantity' AS leads FROM
  (VALUES ('l_orderkey'), ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) v(feature)""")
def q_e7(spark, sf):
    """The target is made from the quantity above all."""
    from veritab.operators.evaluate import feature_importance
    res = _fit(line_table(spark, sf, BULKY), "random_forest", FOREST)
    first = F.rank().over(Window.orderBy(F.desc("importance"))) == 1
    return feature_importance(res.model.stages[-1], res.prepared.features).select("feature", first.alias("leads"))


SMALL_GRID = {"n_estimators": [10, 20], "max_depth": [4, 8]}


def _search(spark, sf):
    from veritab.plans.prepare import prepare
    from veritab.plans.search import grid_search
    p = prepare(line_table(spark, sf, BULKY), ("drop_nulls", "normalize"), target="target", key="l_orderkey")
    return grid_search(p.data, p.features, p.target, "random_forest", "classification", SMALL_GRID, k=3)


@register("t3_grid_search", """
SELECT CAST(i AS INTEGER) AS combo, CASE WHEN i < 2 THEN '4' ELSE '8' END AS max_depth,
       CASE WHEN i % 2 = 0 THEN '10' ELSE '20' END AS n_estimators, true AS ranked, true AS sensible
FROM range(4) r(i)""")
def q_t3(spark, sf):
    r = _search(spark, sf).results
    return r.select("combo", F.col("params")["max_depth"].alias("max_depth"), F.col("params")["n_estimators"].alias("n_estimators"),
                    F.col("rank_test_score").between(1, 4).alias("ranked"),
                    (F.col("mean_test_score").between(0.8, 1.0) & (F.col("std_test_score") < 0.1)).alias("sensible"))


@register("t5_cross_val_score", "SELECT true AS is_the_best_mean, true AS of_the_first_best")
def q_t5(spark, sf):
    from veritab.operators.tuning import best_result
    from veritab.plans.search import cross_val_score
    s = _search(spark, sf)
    best = best_result(s.results)
    return best.select((F.abs(F.col("mean_test_score") - F.lit(cross_val_score(s))) < 1e-9).alias("is_the_best_mean"),
                       (F.col("rank_test_score") == 1).alias("of_the_first_best"))


@register("t6_random_search", "SELECT CAST(2 AS BIGINT) AS combinations, true AS sensible")
def q_t6(spark, sf):
    from veritab.plans.prepare import prepare
    from veritab.plans.search import random_search
    p = prepare(line_table(spark, sf, BULKY), ("drop_nulls", "normalize"), target="target", key="l_orderkey")
    r = random_search(p.data, p.features, p.target, "random_forest", "classification", 2,
                      SMALL_GRID, k=3, objective="auc").results
    return r.agg(F.count("*").alias("combinations"), F.bool_and(F.col("mean_test_score") > 0.8).alias("sensible"))


def _customers(spark, sf):
    """A label in {1, 2}, a third class of it, and numeric features; 1,500 rows for each 0.01 of scale."""
    c = load_table(spark, sf, "customer")
    return c.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"),
                    F.expr("CASE WHEN c_acctbal + 300 * c_nationkey > 8000 THEN 2 ELSE 1 END").alias("target"))


def _networks_searched(spark, sf, model_type, objective=None, grid=None):
    from veritab.plans.prepare import prepare
    from veritab.plans.search import cross_validate
    from veritab.operators.tuning import grid_combinations, grid_dict
    p = prepare(_customers(spark, sf), ("drop_nulls", "normalize"), target="target", key="c_custkey")
    return cross_validate(p.data, p.features, p.target, model_type, "classification",
                          grid_combinations(grid or grid_dict(model_type)), 3, objective=objective)


@register("t3_grid_search_networks", """
SELECT CAST(i AS INTEGER) AS combo, CASE i // 9 WHEN 0 THEN '"relu"' ELSE '"tanh"' END AS activation_by_order,
       true AS ranked, true AS sensible
FROM range(18) r(i)""")
def q_t3n(spark, sf):
    """The default grid of networks, 54 fits in shared passes."""
    r = _networks_searched(spark, sf, "neural_network").results
    by_order = F.row_number().over(Window.orderBy(F.col("params")["activation"], F.col("params")["alpha"],
                                                  F.col("params")["hidden_layer_sizes"]))
    return r.withColumn("i", by_order - 1).select(
        F.col("i").cast("int").alias("combo"), F.col("params")["activation"].alias("activation_by_order"),
        F.col("rank_test_score").between(1, 18).alias("ranked"),
        (F.col("mean_test_score").between(0.85, 1.0) & (F.col("std_test_score") < 0.1)).alias("sensible"))


@register("t3_grid_search_svm", """
SELECT c AS c, k AS kernel, true AS sensible FROM (VALUES ('0.1'), ('1'), ('10')) a(c), (VALUES ('"linear"'), ('"rbf"')) b(k)""")
def q_t3s(spark, sf):
    """The default grid of support vector machines, 18 fits in shared passes."""
    r = _networks_searched(spark, sf, "svm", objective="f1").results
    return r.select(F.col("params")["C"].alias("c"), F.col("params")["kernel"].alias("kernel"),
                    F.col("mean_test_score").between(0.8, 1.0).alias("sensible"))


@register("t6_search_auc_own_labels", "SELECT CAST(2 AS BIGINT) AS combinations, true AS sensible")
def q_t6a(spark, sf):
    """Labels 1 and 2: the area is that of the second label's probability."""
    r = _networks_searched(spark, sf, "neural_network", "auc", {"hidden_layer_sizes": [[8]], "activation": ["relu", "tanh"]}).results
    return r.agg(F.count("*").alias("combinations"), F.bool_and(F.col("mean_test_score") > 0.9).alias("sensible"))


@register("m3_svm_poly_kernel", _checked_sql("CASE WHEN (l_quantity - 25) * (l_discount - 0.05) > 0 THEN 1 ELSE 0 END"))
def q_m3p(spark, sf):
    """A target that needs a product of two features."""
    target = "CASE WHEN (l_quantity - 25) * (l_discount - 0.05) > 0 THEN 1 ELSE 0 END"
    return _checked(_fit(line_table(spark, sf, target), "svm", {"C": 10.0, "kernel": "poly", "degree": 2, "max_iter": 60}))


CALIBRATED = "CASE WHEN l_quantity + l_linenumber * 6 + l_orderkey % 17 > 60 THEN 1 ELSE 0 END"


@register("m3_svm_calibration", f"""
SELECT count(*) FILTER (WHERE NOT ({KEY_SPLIT.format(k='l_orderkey')})) AS test_rows, true AS small_error, true AS small_in_bins FROM lineitem""")
def q_m3c(spark, sf):
    """Mean difference between the calibrated probability and the share of the
    label, over ten bins of the test rows, and the largest in a bin of size."""
    from pyspark.ml.functions import vector_to_array
    table = load_table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", F.col("l_linenumber").cast("double").alias("line"),
                                                     F.expr(CALIBRATED).alias("target"))
    res = _fit(table, "svm", {"C": 1.0, "kernel": "linear", "max_iter": 60})
    p = vector_to_array("probability")[1]
    bins = res.predictions.groupBy(F.floor(p * 10).alias("bin")).agg(F.avg("label").alias("y"), F.avg(p).alias("p"), F.count("*").alias("n"))
    gap, total = F.abs(F.col("y") - F.col("p")), F.sum("n")
    return bins.agg(total.alias("test_rows"), (F.sum(gap * F.col("n")) / total < 0.06).alias("small_error"),
                    (F.max(F.when(F.col("n") > 200, gap)) < 0.2).alias("small_in_bins"))


@register("g8_robustness_test", _summ("AdversarialTest", "SELECT true AS passed"))
def q_g8(spark, sf):
    from veritab.operators.gates import robustness_test
    res = _fit(line_table(spark, sf, BULKY), "svm", {"C": 1.0, "kernel": "linear", "max_iter": 50})
    test = res.prepared.data.where(F.col("split") == "test")
    return robustness_test(res.model, test, res.prepared.features, noise=0.05, max_flip=0.1)


@register("q11_profile_report", f"""
SELECT f.*, c.abs_corr FROM (
  SELECT column_name, min, max, mean, median, std, skew, missing, 'numeric' AS type,
         CAST(NULL AS BIGINT) AS n_distinct, CAST(NULL AS VARCHAR) AS most_common,
         CAST(NULL AS BIGINT) AS most_common_count
  FROM ({sql_numeric_profile('part', ['p_partkey', 'p_size'], None)})
  UNION ALL
  SELECT column_name, NULL, NULL, NULL, NULL, NULL, NULL, missing, 'categorical', n_distinct, most_common,
         most_common_count
  FROM ({_sql_cat_profile('part', ['p_name', 'p_brand', 'p_type'])})) f
LEFT JOIN (
  SELECT 'p_partkey' AS column_name, round(abs({sql_corr('p_partkey', 'p_retailprice')}), 6) AS abs_corr FROM part
  UNION ALL
  SELECT 'p_size', round(abs({sql_corr('p_size', 'p_retailprice')}), 6) FROM part) c USING (column_name)""")
def q_q11(spark, sf):
    from veritab.plans.report import profile_report
    rep = profile_report(load_table(spark, sf, "part"), "p_retailprice")
    return rnd(rep["features"].join(F.broadcast(rep["correlations"]), "column_name", "left"), 6)


# ---------------------------------------------------------------------------
# Extra coverage: NULL category in one-hot, integer labels in per-class metrics
# ---------------------------------------------------------------------------

@register("p3_one_hot_null_category", """
SELECT l_orderkey, l_linenumber,
       CAST(coalesce(nullif(l_linestatus, 'O') = 'F', false) AS DOUBLE) AS l_linestatus_F,
       CAST(nullif(l_linestatus, 'O') IS NULL AS DOUBLE) AS l_linestatus_nan
FROM lineitem""")
def q_p3n(spark, sf):
    from veritab.operators.prep import one_hot
    li = load_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif(F.col("l_linestatus"), F.lit("O")).alias("l_linestatus"))
    return one_hot(li, ["l_linestatus"])


@register("e2_per_class_metrics_int_labels", """
WITH p AS (SELECT quality AS label, toxic AS prediction FROM labels)
SELECT class, coalesce(a.n, 0) AS support, coalesce(q.n, 0) AS predicted, coalesce(t.n, 0) AS tp,
       round(coalesce(coalesce(t.n, 0) / nullif(coalesce(q.n, 0), 0), 0.0), 10) AS precision,
       round(coalesce(coalesce(t.n, 0) / nullif(coalesce(a.n, 0), 0), 0.0), 10) AS recall,
       round(coalesce(2 * coalesce(coalesce(t.n, 0) / nullif(coalesce(q.n, 0), 0), 0.0)
                        * coalesce(coalesce(t.n, 0) / nullif(coalesce(a.n, 0), 0), 0.0)
                      / nullif(coalesce(coalesce(t.n, 0) / nullif(coalesce(q.n, 0), 0), 0.0)
                               + coalesce(coalesce(t.n, 0) / nullif(coalesce(a.n, 0), 0), 0.0), 0), 0.0), 10) AS f1
FROM (SELECT CAST(label AS VARCHAR) AS class, count(*) AS n FROM p WHERE label IS NOT NULL GROUP BY 1) a
FULL OUTER JOIN (SELECT CAST(prediction AS VARCHAR) AS class, count(*) AS n FROM p
                 WHERE prediction IS NOT NULL GROUP BY 1) q USING (class)
LEFT JOIN (SELECT CAST(label AS VARCHAR) AS class, count(*) AS n FROM p WHERE label = prediction GROUP BY 1) t
  USING (class)""")
def q_e2i(spark, sf):
    from veritab.operators.evaluate import per_class_metrics
    lab = load_table(spark, sf, "labels").select(F.col("quality").alias("label"),
                                                 F.col("toxic").alias("prediction"))
    return rnd(per_class_metrics(lab), 10)


# ---------------------------------------------------------------------------
# Reports with all their tables, in long form
# ---------------------------------------------------------------------------

def _long_sql(section: str, sql: str, texts: list[str], numbers: list[str], digits: int = 6) -> str:
    item = f"concat_ws('|', {', '.join(f'CAST({t} AS VARCHAR)' for t in texts)})" if texts else "''"
    names = ", ".join(f"'{n}'" for n in numbers)
    values = ", ".join(f"CAST({n} AS DOUBLE)" for n in numbers)
    return f"""SELECT section, item, name, round(value, {digits}) AS value FROM (
  SELECT '{section}' AS section, {item} AS item, unnest([{names}]) AS name, unnest([{values}]) AS value FROM ({sql}) q)"""


def _histogram_sql(src: str, x: str, bins: int = 30) -> str:
    return f"""WITH r AS (SELECT CASE WHEN min({x}) = max({x}) THEN min({x}) - 0.5 ELSE min({x}) END AS lo,
                  CASE WHEN min({x}) = max({x}) THEN max({x}) + 0.5 ELSE max({x}) END AS hi FROM {src} WHERE {x} IS NOT NULL),
b AS (SELECT CAST(least(floor(({x} - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
      FROM {src}, r WHERE {x} IS NOT NULL GROUP BY 1)
SELECT g.bin, lo + g.bin * (hi - lo) / {bins} AS lower, lo + (g.bin + 1) * (hi - lo) / {bins} AS upper, coalesce(b.n, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})) g CROSS JOIN r LEFT JOIN b ON g.bin = b.bin"""


NUMERIC_PROFILE = ["min", "max", "mean", "median", "std", "skew", "missing", "corr_target"]


@register("q11_profile_report_all", "\nUNION ALL\n".join([
    _long_sql("summary", "SELECT 'p_retailprice' AS target, 'regression' AS problem_type, count(*) AS n_samples, 5 AS n_features FROM part",
              ["target", "problem_type"], ["n_samples", "n_features"]),
    _long_sql("features", sql_numeric_profile('part', ['p_partkey', 'p_size'], None), ["column_name", "'numeric'"],
              [*NUMERIC_PROFILE[:-1]]),
    _long_sql("features", sql_numeric_profile('part', ['p_partkey', 'p_size'], None), ["column_name", "'numeric'"], ["n_distinct", "most_common_count"])
    .replace("CAST(n_distinct AS DOUBLE), CAST(most_common_count AS DOUBLE)", "NULL::DOUBLE, NULL::DOUBLE"),
    _long_sql("features", _sql_cat_profile('part', ['p_name', 'p_brand', 'p_type']), ["column_name", "'categorical'", "most_common"],
              ["missing", "n_distinct", "most_common_count"]),
    _long_sql("features", _sql_cat_profile('part', ['p_name', 'p_brand', 'p_type']), ["column_name", "'categorical'", "most_common"],
              ["min", "max", "mean", "median", "std", "skew"])
    .replace(", ".join(f"CAST({n} AS DOUBLE)" for n in NUMERIC_PROFILE[:6]), ", ".join(["NULL::DOUBLE"] * 6)),
    _long_sql("target", f"""SELECT 'p_retailprice' AS column_name, min(p_retailprice) AS min, max(p_retailprice) AS max, avg(p_retailprice) AS mean,
  quantile_cont(p_retailprice, 0.5) AS median, stddev_samp(p_retailprice) AS std, {sql_skew('p_retailprice')} AS skew FROM part""",
              ["column_name"], NUMERIC_PROFILE[:6]),
    _long_sql("target_histogram", _histogram_sql("part", "p_retailprice"), [], ["bin", "lower", "upper", "count"]),
    _long_sql("correlations", "SELECT 'p_partkey' AS column_name, abs(" + sql_corr('p_partkey', 'p_retailprice') + ") AS abs_corr FROM part"
              " UNION ALL SELECT 'p_size', abs(" + sql_corr('p_size', 'p_retailprice') + ") FROM part", ["column_name"], ["abs_corr"]),
]))
def q_q11a(spark, sf):
    from veritab.plans.report import profile_report, report_long
    return rnd(report_long(profile_report(load_table(spark, sf, "part"), "p_retailprice")), 6)


FREQUENCY_SQL = f"""SELECT v AS value, coalesce(rp, 0) AS ref_freq, coalesce(cp, 0) AS cur_freq
FROM (SELECT l_returnflag AS v, count(*) / sum(count(*)) OVER () AS rp FROM {LI_R} WHERE l_returnflag IS NOT NULL GROUP BY 1) x
FULL OUTER JOIN (SELECT l_returnflag AS v, count(*) / sum(count(*)) OVER () AS cp FROM {LI_C}
                 WHERE l_returnflag IS NOT NULL GROUP BY 1) y USING (v)"""


@register("d5_target_drift_data", "\nUNION ALL\n".join([
    _long_sql("drift", sql_drift_report(LI_R, LI_C, [], ["l_returnflag"]), ["column_name", "column_type"], ["drift_score", "drift_detected"]),
    _long_sql("frequencies", FREQUENCY_SQL, ["value"], ["ref_freq", "cur_freq"]),
    _long_sql("price_drift", sql_drift_report(LI_R, LI_C, ["l_extendedprice"], []), ["column_name", "column_type"],
              ["drift_score", "drift_detected"]),
    _long_sql("price_reference_histogram", _histogram_sql(LI_R, "l_extendedprice"), [], ["bin", "lower", "upper", "count"]),
    _long_sql("price_current_histogram", _histogram_sql(LI_C, "l_extendedprice"), [], ["bin", "lower", "upper", "count"])]))
def q_d5d(spark, sf):
    """Drift and distributions of a text target and of a numeric one."""
    from veritab.plans.report import report_long
    r, c = lineitem_halves(spark, sf)
    text, number = D.target_drift_data(r, c, "l_returnflag"), D.target_drift_data(r, c, "l_extendedprice")
    return rnd(report_long(text | {f"price_{k}": t for k, t in number.items()}), 6)


@register("d7_compare_profiles", "\nUNION ALL\n".join([
    _long_sql("quality", _sql_quality(LI_R, LI_ALL, "reference") + " UNION ALL " + _sql_quality(LI_C, LI_ALL, "current"), ["side"],
              ["row_count", "column_count", "missing_cells", "missing_pct", "duplicate_rows"]),
    *[_long_sql(f"numeric_{side}", sql_numeric_profile(src, [c for c in LINE_ALL_NUM if c != "l_extendedprice"], "l_extendedprice"),
                ["column_name"], NUMERIC_PROFILE) for side, src in (("reference", LI_R), ("current", LI_C))],
    *[_long_sql(f"categorical_{side}", _sql_cat_profile(src, LINE_ALL_CAT), ["column_name", "most_common"],
                ["n_distinct", "missing", "most_common_count"]) for side, src in (("reference", LI_R), ("current", LI_C))]]))
def q_d7p(spark, sf):
    from veritab.plans.report import report_long
    r, c = lineitem_halves(spark, sf)
    return rnd(report_long(D.compare_profiles(r, c, "l_extendedprice")), 6)


E5_ROWS = f"""(SELECT *, {KEY_SPLIT.format(k='o_orderkey')} AS train, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS label,
  least(floor(o_totalprice / 1000) / 500, 1.0) AS p, CASE WHEN least(floor(o_totalprice / 1000) / 500, 1.0) > 0.3 THEN 2 ELSE 1 END AS prediction
  FROM orders)"""
E5_TEST = f"(SELECT * FROM {E5_ROWS} WHERE NOT train)"
E5_ROC = f"""WITH g AS (SELECT p, count(*) FILTER (label = 2) AS pos, count(*) FILTER (label <> 2) AS neg FROM {E5_TEST} GROUP BY p),
c AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(neg) OVER (ORDER BY p DESC) AS cn, sum(pos) OVER () AS np, sum(neg) OVER () AS nn
      FROM g)"""
E5_RATES = f"""WITH c AS (SELECT k, count(*) FILTER (label = k AND prediction = k) AS tp, count(*) FILTER (label = k) AS support,
  count(*) FILTER (prediction = k) AS predicted FROM {E5_TEST}, (VALUES (1), (2)) v(k) GROUP BY k),
r AS (SELECT tp / predicted AS precision, tp / support AS recall, tp, support FROM c)"""


@register("e5_evaluation_report_all", "\nUNION ALL\n".join([
    _long_sql("metrics", f"""{E5_RATES} SELECT 'Accuracy' AS name_, sum(tp) / sum(support) AS value_ FROM r
      UNION ALL SELECT 'Precision', avg(precision) FROM r UNION ALL SELECT 'Recall', avg(recall) FROM r
      UNION ALL SELECT 'F1 Score', avg(2 * precision * recall / (precision + recall)) FROM r""", ["name_"], ["value_"]).replace("['value_']", "['value']"),
    _long_sql("confusion_matrix", f"""SELECT a || '|' || b AS cell, (SELECT count(*) FROM {E5_TEST} WHERE label = a AND prediction = b) AS count
      FROM (VALUES (1), (2)) x(a), (VALUES (1), (2)) y(b)""", ["cell"], ["count"]),
    _long_sql("roc_curve", f"{E5_ROC} SELECT p AS threshold, cn / nn AS fpr, cp / np AS tpr FROM c UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0", [],
              ["threshold", "fpr", "tpr"]),
    _long_sql("roc_auc", f"{E5_ROC} SELECT sum(neg * (cp - pos / 2.0)) / (max(np) * max(nn)) AS roc_auc FROM c", [], ["roc_auc"]),
    _long_sql("class_auc", f"{E5_ROC} SELECT k AS class, sum(neg * (cp - pos / 2.0)) / (max(np) * max(nn)) AS auc FROM c, (VALUES (1), (2)) v(k) GROUP BY k",
              [], ["class", "auc"]),
    _long_sql("log_loss", f"SELECT avg(-ln(greatest(CASE label WHEN 2 THEN p ELSE 1 - p END, 1e-15))) AS log_loss FROM {E5_TEST}", [], ["log_loss"]),
    _long_sql("data_quality", _sql_quality(E5_TEST, ["o_custkey", "o_totalprice", "o_orderpriority"]), [],
              ["row_count", "column_count", "missing_cells", "missing_pct", "duplicate_rows"]),
    _long_sql("mean_shift", f"""SELECT column_name, a AS train_mean, b AS test_mean, abs(a - b) / (abs(a) + 1e-10) * 100 AS shift_pct,
        abs(a - b) / (abs(a) + 1e-10) * 100 > 20 AS shifted FROM (
          SELECT 'o_custkey' AS column_name, avg(o_custkey) FILTER (train) AS a, avg(o_custkey) FILTER (NOT train) AS b FROM {E5_ROWS}
          UNION ALL SELECT 'o_totalprice', avg(o_totalprice) FILTER (train), avg(o_totalprice) FILTER (NOT train) FROM {E5_ROWS})""",
              ["column_name"], ["train_mean", "test_mean", "shift_pct", "shifted"]),
    _long_sql("drift_detected", f"""SELECT max(s) > 20 AS drift_detected, max(s) AS max_shift_pct FROM (
          SELECT abs(avg(o_custkey) FILTER (train) - avg(o_custkey) FILTER (NOT train)) / (abs(avg(o_custkey) FILTER (train)) + 1e-10) * 100 AS s FROM {E5_ROWS}
          UNION ALL SELECT abs(avg(o_totalprice) FILTER (train) - avg(o_totalprice) FILTER (NOT train)) / (abs(avg(o_totalprice) FILTER (train)) + 1e-10)
            * 100 FROM {E5_ROWS})""", [], ["drift_detected", "max_shift_pct"])]))
def q_e5a(spark, sf):
    """Every section, on labels 1 and 2 with probabilities made from the data."""
    from veritab.operators.prep import train_test_split
    from veritab.plans.report import evaluation_report, report_long
    p = F.least(F.floor(F.col("o_totalprice") / 1000) / 500, F.lit(1.0))
    o = (train_test_split(load_table(spark, sf, "orders"), 0.8, key="o_orderkey")
         .withColumn("label", F.when(F.col("o_orderstatus") == "F", 2).otherwise(1)).withColumn("probability", F.array(1 - p, p))
         .withColumn("prediction", F.when(p > 0.3, 2).otherwise(1)))
    rep = evaluation_report(o.where("split = 'test'"), o, ["o_custkey", "o_totalprice", "o_orderpriority"], "classification", labels=[1, 2])
    return rnd(report_long(rep), 6)


@register("e7_permutation_importance", """
SELECT kind, feature, feature = 'l_quantity' AS leads FROM (VALUES ('svm'), ('neural_network')) k(kind),
  (VALUES ('l_orderkey'), ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) v(feature)""")
def q_e7p(spark, sf):
    """Importance for models without one of their own; the target is made from the quantity above all."""
    from veritab.operators.evaluate import permutation_importance
    out = None
    for kind, params in (("svm", {"C": 1.0, "kernel": "linear", "max_iter": 30, "probability": False}),
                         ("neural_network", {"hidden_layer_sizes": "8", "activation": "relu", "max_iter": 30})):
        res = _fit(line_table(spark, sf, BULKY), kind, params)
        test = res.prepared.data.where(F.col("split") == "test")
        first = F.rank().over(Window.orderBy(F.desc("importance"))) == 1
        own = permutation_importance(res.model, test, res.prepared.features, res.prepared.target).select(
            F.lit(kind).alias("kind"), "feature", first.alias("leads"))
        out = own if out is None else out.unionByName(own)
    return out
