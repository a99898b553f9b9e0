"""Registered queries: column clean-up, statistics, scaling, splits (§2.2, §2.4, §2.8, §2.10).

Feature view over ``lineitem`` with a few derived columns so every filter
has something to decide: ``f_sparse`` is mostly null, ``f_zero`` all zero.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from moltab.functions.rng import sql_hash32, sql_key, sql_lit
from moltab.operators import columns, scaling, splits, stats
from moltab.plans.common import LINE_KEY_SQL, line_key, r, round_doubles
from moltab.plans.registry import register, table

FEATS = ["f_qty", "f_price", "f_disc", "f_tax", "f_line", "f_sparse", "f_zero", "f_flag"]


def feat_view(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        line_key().alias("row_id"),
        F.col("l_quantity").alias("f_qty"), F.col("l_extendedprice").alias("f_price"),
        F.col("l_discount").alias("f_disc"), F.col("l_tax").alias("f_tax"),
        F.col("l_linenumber").cast("double").alias("f_line"),
        F.when(F.col("l_linenumber") >= 5, F.col("l_discount")).alias("f_sparse"),
        (F.col("l_discount") * 0.0).alias("f_zero"),
        (F.col("l_returnflag") == "R").cast("double").alias("f_flag"),
        F.col("l_returnflag"), F.col("l_linestatus"))


FEAT_SQL = f"""(SELECT {LINE_KEY_SQL} AS row_id, l_quantity AS f_qty,
  l_extendedprice AS f_price, l_discount AS f_disc, l_tax AS f_tax, CAST(l_linenumber AS DOUBLE) AS f_line,
  CASE WHEN l_linenumber >= 5 THEN l_discount END AS f_sparse, l_discount * 0.0 AS f_zero,
  CAST(l_returnflag = 'R' AS DOUBLE) AS f_flag, l_returnflag, l_linestatus FROM lineitem)"""


def long_sql(src: str, cols, ids=()) -> str:
    idsel = "".join(f"{i}, " for i in ids)
    return "(" + " UNION ALL ".join(
        f"SELECT {idsel}'{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {src}" for c in cols) + ")"


FEAT_LONG = f"(SELECT * FROM {long_sql(FEAT_SQL, FEATS)})"


def _stats_sql(select: str) -> str:
    return f"""WITH l AS {FEAT_LONG},
s AS (SELECT feature, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS n_null,
  avg(value) AS mean, stddev_samp(value) AS std, stddev_pop(value) AS std_pop, min(value) AS min,
  max(value) AS max, count(*) FILTER (WHERE value <> 0) AS n_nonzero FROM l GROUP BY feature)
SELECT {select} FROM s"""


def q_feature_stats(spark, sf):
    return round_doubles(columns.feature_stats(feat_view(spark, sf), FEATS), 4)


register("feature_stats", _stats_sql(
    "feature, n, n_null, round(mean, 4) AS mean, round(std, 4) AS std, round(std_pop, 4) AS std_pop, "
    "round(min, 4) AS min, round(max, 4) AS max, n_nonzero, n_nonzero = n AS all_nonzero, "
    "min = max AS is_constant"))(q_feature_stats)


def q_constant_cols(spark, sf):
    return columns.constant_cols(feat_view(spark, sf), FEATS)


register("constant_cols", _stats_sql(
    "feature, coalesce(min = max, false) AS is_constant, NOT coalesce(min = max, false) AS keep"))(
    q_constant_cols)


def q_skip_sparse(spark, sf):
    return round_doubles(columns.skip_sparse_decisions(feat_view(spark, sf), FEATS, 0.7))


register("skip_sparse_cols", _stats_sql(
    "feature, round(CAST(n_null AS DOUBLE) / n, 6) AS null_frac, CAST(n_null AS DOUBLE) / n < 0.7 AS keep"))(
    q_skip_sparse)


def q_low_std(spark, sf):
    return round_doubles(columns.low_std_decisions(feat_view(spark, sf), FEATS, 0.5), 4)


register("drop_low_std_cols", _stats_sql("feature, round(std, 4) AS std, coalesce(std >= 0.5, false) AS keep"))(
    q_low_std)


def q_drop_zero(spark, sf):
    return columns.zero_col_decisions(feat_view(spark, sf), FEATS)


register("drop_zero_cols", _stats_sql("feature, n_nonzero, n_nonzero > 0 AS keep"))(q_drop_zero)


def q_drop_null_cols(spark, sf):
    return columns.null_col_decisions(feat_view(spark, sf), FEATS)


register("drop_null_cols", _stats_sql("feature, n_null, n_null = 0 AS keep"))(q_drop_null_cols)


def q_all_nonzero(spark, sf):
    return columns.all_nonzero_decisions(feat_view(spark, sf), FEATS)


register("all_nonzero_cols", _stats_sql("feature, n_nonzero, n_nonzero = n AS keep"))(q_all_nonzero)


def q_select_features(spark, sf):
    v = feat_view(spark, sf)
    return round_doubles(columns.select_columns(v, FEATS, always=["row_id"], min_std=0.1,
                                                drop_zero=True, drop_constant=True, max_null_frac=0.7), 4)


register("select_features", f"""SELECT row_id, round(f_qty, 4) AS f_qty, round(f_price, 4) AS f_price,
  round(f_line, 4) AS f_line, round(f_flag, 4) AS f_flag FROM {FEAT_SQL}""")(q_select_features)


def q_drop_null_rows(spark, sf):
    v = feat_view(spark, sf).select("row_id", "f_qty", "f_sparse")
    return columns.drop_null_rows(v, ["f_qty", "f_sparse"])


register("drop_null_rows", f"""SELECT row_id, f_qty, f_sparse FROM {FEAT_SQL}
WHERE f_qty IS NOT NULL AND f_sparse IS NOT NULL""")(q_drop_null_rows)


def q_drop_rows_min_nonnull(spark, sf):
    li = table(spark, sf, "lineitem")
    v = li.select(line_key().alias("row_id"),
                  F.when(F.col("l_linenumber") >= 3, F.col("l_tax")).alias("a"),
                  F.when(F.col("l_quantity") > 25, F.col("l_discount")).alias("b"),
                  F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("c"))
    return columns.drop_rows_min_nonnull(v, 2, ["a", "b", "c"])


register("drop_rows_min_nonnull", f"""SELECT * FROM (SELECT {LINE_KEY_SQL} AS row_id,
  CASE WHEN l_linenumber >= 3 THEN l_tax END AS a, CASE WHEN l_quantity > 25 THEN l_discount END AS b,
  CASE WHEN l_returnflag = 'R' THEN l_quantity END AS c FROM lineitem)
WHERE (CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER) + CAST(c IS NOT NULL AS INTEGER)) >= 2""")(
    q_drop_rows_min_nonnull)


def q_fill_mean(spark, sf):
    v = feat_view(spark, sf).select("row_id", "f_sparse", "f_qty")
    return round_doubles(columns.fill_mean(v, ["f_sparse", "f_qty"], 0.9))


register("fill_mean", f"""WITH v AS (SELECT row_id, f_sparse, f_qty FROM {FEAT_SQL}),
m AS (SELECT avg(f_sparse) AS ms, avg(CAST(f_sparse IS NULL AS DOUBLE)) AS zs FROM v)
SELECT row_id, round(CASE WHEN zs < 0.9 THEN coalesce(f_sparse, ms) ELSE f_sparse END, 6) AS f_sparse,
  round(f_qty, 6) AS f_qty FROM v, m""")(q_fill_mean)


def q_label_two_class(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1e5).alias("t"))
    return columns.label_two_class(o, "t", bound=1.5).select("o_orderkey", "classes")


register("label_two_class", """SELECT o_orderkey, CAST(CASE WHEN o_totalprice / 1e5 < 1.5 THEN 0
  WHEN o_totalprice / 1e5 >= 1.5 THEN 1 END AS INTEGER) AS classes FROM orders""")(q_label_two_class)


def q_label_sentinel(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", F.lit("N"))
        .otherwise((F.col("value") - 10.0).cast("string")).alias("activity"))
    return columns.label_sentinel(e, "activity").select("event_id", "classes")


register("label_sentinel", """SELECT event_id, CAST(CASE WHEN event_type = 'error' OR value - 10.0 > 0 THEN 0
  ELSE 1 END AS INTEGER) AS classes FROM events""")(q_label_sentinel)


def q_coerce_numeric(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"),
                                          F.when(F.col("event_type") == "error", F.lit("n/a"))
                                          .otherwise(F.col("value").cast("string")).alias("v"))
    return columns.coerce_numeric(e, "v").select("event_id", "v")


register("coerce_numeric", """SELECT event_id, value AS v FROM events WHERE event_type <> 'error'""")(
    q_coerce_numeric)


def q_bool_to_int(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("is_f"),
                                          (F.col("o_totalprice") > 1e5).alias("big"))
    return columns.bool_to_int(o)


register("bool_to_int", """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS is_f,
  CAST(o_totalprice > 1e5 AS INTEGER) AS big FROM orders""")(q_bool_to_int)


def q_misclassified(spark, sf):
    from moltab.plans.q_metrics import clf_view
    v = clf_view(spark, sf)
    return columns.misclassified(v).select("l_orderkey", "l_linenumber", "known", "prediction")


register("misclassified", """SELECT l_orderkey, l_linenumber, CAST(l_discount >= 0.05 AS INTEGER) AS known,
  CAST(l_quantity / 50.0 >= 0.5 AS INTEGER) AS prediction FROM lineitem
WHERE CAST(l_discount >= 0.05 AS INTEGER) IS DISTINCT FROM CAST(l_quantity / 50.0 >= 0.5 AS INTEGER)""")(
    q_misclassified)


def q_coverage_check(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    return columns.coverage_check(o, li, "k")


register("coverage_check", """SELECT o_orderkey AS k FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")(q_coverage_check)


def q_align_test_cols(spark, sf):
    train_cols = ["row_id", "f_qty", "f_missing", "f_price"]
    v = feat_view(spark, sf).select("row_id", "f_price", "f_qty", "f_tax")
    return columns.align_test_cols(train_cols, v, key=["row_id"])


register("align_test_cols", f"SELECT row_id, f_qty, f_price FROM {FEAT_SQL}")(q_align_test_cols)


def q_fill_missing_cols(spark, sf):
    train_cols = ["f_qty", "f_missing", "f_price"]
    v = feat_view(spark, sf).select("row_id", "f_price", "f_qty")
    return columns.fill_missing_cols(train_cols, v, key=["row_id"], fill=0)


register("fill_missing_cols", f"SELECT row_id, f_qty, 0 AS f_missing, f_price FROM {FEAT_SQL}")(
    q_fill_missing_cols)


# ------------------------------------------------------------ statistics

def q_describe(spark, sf):
    return round_doubles(stats.describe(feat_view(spark, sf), ["f_qty", "f_price", "f_disc", "f_sparse"]), 4)


register("describe", f"""WITH l AS {long_sql(FEAT_SQL, ["f_qty", "f_price", "f_disc", "f_sparse"])}
SELECT feature, count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
  round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS q25,
  round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.75), 4) AS q75,
  round(max(value), 4) AS max FROM l GROUP BY feature""")(q_describe)


def q_histogram(spark, sf):
    v = feat_view(spark, sf)
    return stats.histogram(v, ["f_qty", "f_price", "f_tax", "f_zero"], bins=20, by=["l_returnflag"])


register("histogram", f"""WITH l AS (SELECT * FROM {long_sql(FEAT_SQL, ["f_qty", "f_price", "f_tax", "f_zero"],
                                                      ["l_returnflag"])} WHERE value IS NOT NULL),
g AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY feature)
SELECT l_returnflag, l.feature, CAST(CASE WHEN hi - lo > 0 THEN least(floor((value - lo) / (hi - lo) * 20), 19)
  ELSE 0 END AS INTEGER) AS bin, count(*) AS count
FROM l JOIN g ON l.feature = g.feature GROUP BY ALL""")(q_histogram)


def q_group_count(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.dayofmonth("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


register("group_count", "SELECT CAST(dayofmonth(ts) AS INTEGER) AS day, count(*) AS n FROM events GROUP BY 1")(
    q_group_count)


def q_value_occurrences(spark, sf):
    li = table(spark, sf, "lineitem")
    d = li.select("l_partkey", "l_quantity").dropDuplicates()
    return d.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"))


register("value_occurrences", """SELECT l_quantity, count(*) AS n FROM
  (SELECT DISTINCT l_partkey, l_quantity FROM lineitem) GROUP BY l_quantity""")(q_value_occurrences)


def q_drop_duplicates(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_partkey", "l_returnflag").dropDuplicates()


register("drop_duplicates", "SELECT DISTINCT l_partkey, l_returnflag FROM lineitem")(q_drop_duplicates)


CORR_COLS = ["f_qty", "f_disc", "f_tax", "f_line", "f_sparse", "f_zero"]


def q_corr_pearson(spark, sf):
    return round_doubles(stats.corr_features(feat_view(spark, sf), CORR_COLS, "f_price", "pearson"))


def _corr_sql(cols):
    return f"""WITH l AS {long_sql(FEAT_SQL, cols, ["f_price"])}
SELECT feature, count(*) AS n,
  round(covar_pop(value, f_price) / nullif(sqrt(var_pop(value) * var_pop(f_price)), 0), 6) AS r
FROM l WHERE value IS NOT NULL AND f_price IS NOT NULL GROUP BY feature"""


register("corr_features", _corr_sql(CORR_COLS))(q_corr_pearson)


def q_corr_pair(spark, sf):
    return round_doubles(stats.corr_pair(feat_view(spark, sf), "f_qty", "f_price", "pearson"))


register("corr_pair", f"""SELECT 'f_qty' AS x, 'f_price' AS y,
  round(covar_pop(f_qty, f_price) / nullif(sqrt(var_pop(f_qty) * var_pop(f_price)), 0), 6) AS r
FROM {FEAT_SQL} WHERE f_qty IS NOT NULL AND f_price IS NOT NULL""")(q_corr_pair)


def q_corr_matrix(spark, sf):
    cols = ["f_qty", "f_price", "f_disc", "f_tax", "f_sparse"]
    return round_doubles(stats.corr_matrix(feat_view(spark, sf), cols, "pearson"))


def _corr_matrix_sql():
    cols = ["f_qty", "f_price", "f_disc", "f_tax", "f_sparse"]
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"""SELECT '{a}' AS f1, '{b}' AS f2,
  round(covar_pop({a}, {b}) / nullif(sqrt(var_pop({a}) * var_pop({b})), 0), 6) AS r
  FROM {FEAT_SQL} WHERE {a} IS NOT NULL AND {b} IS NOT NULL""")
    return " UNION ALL ".join(parts)


register("corr_matrix", _corr_matrix_sql())(q_corr_matrix)


def _rank_sql(src: str, col: str, part: str) -> str:
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {col}) + "
            f"(count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2.0)")


def q_spearman(spark, sf):
    return round_doubles(stats.corr_features(feat_view(spark, sf), CORR_COLS, "f_price", "spearman",
                                             key="row_id"))


register("spearman", f"""WITH l AS (SELECT * FROM {long_sql(FEAT_SQL, CORR_COLS, ["row_id", "f_price"])}
   WHERE value IS NOT NULL AND f_price IS NOT NULL),
rk AS (SELECT feature, {_rank_sql('l', 'value', 'feature')} AS rx, {_rank_sql('l', 'f_price', 'feature')} AS ry FROM l)
SELECT feature, count(*) AS n, round(covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0), 6) AS r
FROM rk GROUP BY feature""")(q_spearman)


def q_kendall(spark, sf):
    p = table(spark, sf, "part")
    return round_doubles(stats.kendall_tau(p, "p_size", "p_retailprice", by=[]))


def _kendall_sql(x: str, y: str, src: str) -> str:
    return f"""WITH c AS (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, count(*) AS c FROM {src}
    WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2),
s AS (SELECT sum(CAST(a.c AS DOUBLE) * b.c * sign(b.x - a.x) * sign(b.y - a.y)) / 2.0 AS s FROM c a, c b),
n AS (SELECT CAST(sum(c) AS DOUBLE) AS n FROM c),
tx AS (SELECT sum(t * (t - 1) / 2.0) AS n1 FROM (SELECT sum(c) AS t FROM c GROUP BY x)),
ty AS (SELECT sum(t * (t - 1) / 2.0) AS n2 FROM (SELECT sum(c) AS t FROM c GROUP BY y))
SELECT CAST(n AS BIGINT) AS n,
  round(coalesce(s, 0) / nullif(sqrt((n * (n - 1) / 2 - n1) * (n * (n - 1) / 2 - n2)), 0), 6) AS tau
FROM n, tx, ty, s"""


register("kendall", _kendall_sql("p_size", "p_retailprice", "part"))(q_kendall)
