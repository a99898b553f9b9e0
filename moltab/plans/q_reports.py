"""Registered queries: regression metrics, reports, ensembles, sets, joins, order ops,
sources and sinks (§2.1, §2.3-2.7, §2.12)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from moltab.functions.rng import sql_hash32, sql_key, sql_lit
from moltab.operators import columns, metrics, reports, splits
from moltab.operators import fingerprints as fp
from moltab.plans.common import LINE_KEY_SQL, line_key, r, round_doubles, sql_counts
from moltab.plans.q_fingerprints import TEXT_KEYS
from moltab.plans.q_metrics import CLF_SQL, clf_view
from moltab.plans.registry import register, table
from moltab.session import scratch_path
from moltab.sources import io


def reg_view(spark, sf):
    """Two prediction 'models' of extendedprice (in thousands), long by model."""
    li = table(spark, sf, "lineitem")
    p = table(spark, sf, "part")
    avgp = p.agg(F.avg("p_retailprice").alias("_avgp"))
    j = li.join(p, li.l_partkey == p.p_partkey).crossJoin(F.broadcast(avgp))  # one-row side
    rid = line_key().alias("row_id")
    m1 = j.select(rid, F.lit("m1").alias("model"), (F.col("l_extendedprice") / 1000).alias("known"),
                  (F.col("l_quantity") * F.col("p_retailprice") / 1000).alias("prediction"))
    m2 = j.select(rid, F.lit("m2").alias("model"), (F.col("l_extendedprice") / 1000).alias("known"),
                  (F.col("l_quantity") * F.col("_avgp") / 1000).alias("prediction"))
    return m1.unionByName(m2)


REG_SQL = f"""(SELECT {LINE_KEY_SQL} AS row_id, 'm1' AS model, l_extendedprice / 1000 AS known,
   l_quantity * p_retailprice / 1000 AS prediction FROM lineitem JOIN part ON l_partkey = p_partkey
 UNION ALL
 SELECT {LINE_KEY_SQL}, 'm2', l_extendedprice / 1000,
   l_quantity * (SELECT avg(p_retailprice) FROM part) / 1000 FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _sql_reg_metrics(src: str, by: str, rounded: bool = False) -> str:
    base = f"""SELECT {by}, count(*) AS n, sum((known - prediction) * (known - prediction)) / count(*) AS mse,
  sum(abs(known - prediction)) / count(*) AS mae, var_pop(known - prediction) AS vare, var_pop(known) AS vary
  FROM {src} WHERE known IS NOT NULL AND prediction IS NOT NULL GROUP BY {by}"""
    if rounded:
        return f"""SELECT {by}, round(1 - vare / nullif(vary, 0), 2) AS variance, round(mae, 2) AS mae,
  round(mse, 2) AS mse, round(sqrt(round(mse, 2)), 6) AS rmse, round(1 - mse / nullif(vary, 0), 2) AS r2 FROM ({base})"""
    return f"""SELECT {by}, {r('1 - vare / nullif(vary, 0)')} AS variance, {r('mae')} AS mae, {r('mse')} AS mse,
  {r('sqrt(mse)')} AS rmse, {r('1 - mse / nullif(vary, 0)')} AS r2 FROM ({base})"""


def q_metrics_regression(spark, sf):
    return round_doubles(metrics.metrics_regression(reg_view(spark, sf), by=["model"]))


register("metrics_regression", _sql_reg_metrics(REG_SQL, "model"))(q_metrics_regression)


def q_metrics_regression_rounded(spark, sf):
    return round_doubles(metrics.metrics_regression(reg_view(spark, sf), by=["model"], rounded=True))


register("metrics_regression_holdout", _sql_reg_metrics(REG_SQL, "model", rounded=True))(
    q_metrics_regression_rounded)


def ord_reg_view(spark, sf):
    """Per order: known = total price, models = line sums (in thousands); numeric key."""
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem")
    sums = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("_s1"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("_s2"))
    j = o.join(sums, "o_orderkey")
    base = [F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / 1000).alias("known")]
    return j.select(F.lit("m1").alias("model"), *base, (F.col("_s1") / 1000).alias("prediction")).unionByName(
        j.select(F.lit("m2").alias("model"), *base, (F.col("_s2") / 1000).alias("prediction")))


ORD_REG_SQL = """(WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS s1,
    sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS s2 FROM lineitem GROUP BY l_orderkey)
  SELECT 'm1' AS model, o_orderkey AS row_id, o_totalprice / 1000 AS known, s1 / 1000 AS prediction
  FROM orders JOIN s ON l_orderkey = o_orderkey
  UNION ALL SELECT 'm2', o_orderkey, o_totalprice / 1000, s2 / 1000 FROM orders JOIN s ON l_orderkey = o_orderkey)"""


#: Folds of the written regression predictions; the SQL twins use the same number.
N_REG_FOLDS = 12


def _write_reg_folds(spark, sf):
    v = splits.kfold(ord_reg_view(spark, sf), "row_id", N_REG_FOLDS, seed=3, by=["model"])
    out = scratch_path(spark, "reg-folds")
    io.write_predictions(v.select("model", "fold", F.lit(0).cast("long").alias("pos"),
                                  F.col("row_id").alias("index"), "known", "prediction"), out)
    return out


def q_all_reg_report(spark, sf):
    out = _write_reg_folds(spark, sf)
    res = None
    for m in ("m1", "m2"):
        preds = io.read_fold_predictions_reg(spark, f"{out}/model={m}").withColumn("model", F.lit(m))
        rep = reports.all_reg_report(preds, by=["model"])
        res = rep if res is None else res.unionByName(rep)
    return round_doubles(res)


register("all_reg_report", _sql_reg_metrics(ORD_REG_SQL, "model"))(q_all_reg_report)


def q_src_folds_reg(spark, sf):
    out = _write_reg_folds(spark, sf)
    both = None
    for m in ("m1", "m2"):
        d = io.read_fold_predictions_reg(spark, f"{out}/model={m}").withColumn("model", F.lit(m))
        both = d if both is None else both.unionByName(d)
    return round_doubles(both.select("model", "index", "known", "prediction", "fold"))


H_REG = sql_hash32(sql_key("row_id"), sql_lit(3), sql_lit("kfold"))
register("src_folds_reg", f"""SELECT model, CAST(row_id AS BIGINT) AS index, round(known, 6) AS known,
  round(prediction, 6) AS prediction,
  CAST(ntile({N_REG_FOLDS}) OVER (PARTITION BY model ORDER BY {H_REG}, row_id) - 1 AS INTEGER) AS fold FROM {ORD_REG_SQL}""")(
    q_src_folds_reg)


def q_sink_predictions(spark, sf):
    out = _write_reg_folds(spark, sf)
    d = spark.read.option("header", True).schema(
        "pos LONG, index LONG, known DOUBLE, prediction DOUBLE, model STRING, fold INT").csv(out)
    return round_doubles(d.select("model", "fold", "index", "known", "prediction"))


register("sink_predictions", f"""SELECT model,
  CAST(ntile({N_REG_FOLDS}) OVER (PARTITION BY model ORDER BY {H_REG}, row_id) - 1 AS INTEGER) AS fold,
  CAST(row_id AS BIGINT) AS index, round(known, 6) AS known, round(prediction, 6) AS prediction
FROM {ORD_REG_SQL}""")(q_sink_predictions)


def _orders_clf(spark, sf):
    o = table(spark, sf, "orders")
    score = F.col("o_totalprice") / 500000.0
    return o.select(F.col("o_orderkey").alias("row_id"), "o_orderpriority",
                    F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("known"),
                    score.alias("score"), (score >= 0.3).cast("int").alias("prediction"))


ORD_CLF_SQL = """(SELECT o_orderkey AS row_id, o_orderpriority,
   CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS known, o_totalprice / 500000.0 AS score,
   CAST(o_totalprice / 500000.0 >= 0.3 AS INTEGER) AS prediction FROM orders)"""


def q_src_folds_clf(spark, sf):
    v = splits.kfold(_orders_clf(spark, sf), "row_id", 12, seed=11)
    # every order whose priority is 3-MEDIUM is also written, flipped, into the next fold
    dup = v.where(F.col("o_orderpriority") == "3-MEDIUM").withColumn("fold", (F.col("fold") + 1) % 12) \
        .withColumn("prediction", 1 - F.col("prediction"))
    allv = v.unionByName(dup)
    out = scratch_path(spark, "clf-folds")
    io.write_predictions(allv.select("fold", F.lit(0).cast("long").alias("pos"),
                                     F.col("row_id").alias("m_index"),
                                     F.col("known").cast("double").alias("known"),
                                     F.col("prediction").cast("double").alias("prediction"),
                                     (1 - F.col("score")).alias("prob0"), F.col("score").alias("prob1")), out)
    return round_doubles(io.read_fold_predictions_clf(spark, out))


H_CLF = sql_hash32(sql_key("row_id"), sql_lit(11), sql_lit("kfold"))
register("src_folds_clf", f"""WITH f AS (SELECT *, CAST(ntile(12) OVER (ORDER BY {H_CLF}, row_id) - 1 AS INTEGER) AS fold
  FROM {ORD_CLF_SQL}),
a AS (SELECT row_id, fold, known, prediction, score FROM f
      UNION ALL SELECT row_id, (fold + 1) % 12, known, 1 - prediction, score FROM f WHERE o_orderpriority = '3-MEDIUM'),
k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY fold) AS rn FROM a)
SELECT CAST(row_id AS BIGINT) AS m_index, CAST(known AS INTEGER) AS known, CAST(prediction AS INTEGER) AS prediction,
  round(1 - score, 6) AS prob0, round(score, 6) AS prob1 FROM k WHERE rn = 1""")(q_src_folds_clf)


def q_src_csv(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    out = scratch_path(spark, "csv")
    io.write_table(c, out, fmt="csv")
    return io.read_csv(spark, out, "c_custkey LONG, c_name STRING, c_acctbal DOUBLE, c_mktsegment STRING",
                       key="c_custkey")


register("src_csv", "SELECT c_custkey AS row_id, c_name, c_acctbal, c_mktsegment FROM customer")(q_src_csv)


def q_src_csv_noheader(spark, sf):
    s = table(spark, sf, "supplier")
    out_x = scratch_path(spark, "x")
    out_y = scratch_path(spark, "y")
    # several files each, written in key order: files are named by range, and the two
    # sides are cut at different places, so pairing them needs the true file order
    t = F.col("s_acctbal") > 0
    io.write_table(s.repartitionByRange(5, "s_suppkey").sortWithinPartitions("s_suppkey")
                   .select("s_nationkey", "s_acctbal"), out_x, fmt="csv", header=False)
    io.write_table(s.repartitionByRange(3, "s_suppkey").sortWithinPartitions("s_suppkey")
                   .select(t.cast("double").alias("t")), out_y, fmt="csv", header=False)
    d = io.read_aligned(spark, out_x, "f0 INT, f1 DOUBLE", out_y, "t DOUBLE")
    return d.select("row_id", "f0", "f1", "t")


register("src_csv_noheader", """SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_id, s_nationkey AS f0,
  s_acctbal AS f1, CAST(s_acctbal > 0 AS DOUBLE) AS t FROM supplier""")(q_src_csv_noheader)


def q_src_parquet(spark, sf):
    c = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = scratch_path(spark, "pq")
    io.write_table(c, out)
    return io.read_parquet(spark, out)


register("src_parquet", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")(q_src_parquet)


def q_src_pred_files(spark, sf):
    v = reg_view(spark, sf)
    paths = {}
    for m in ("m1", "m2"):
        p = scratch_path(spark, f"pred-{m}")
        io.write_table(v.where(F.col("model") == m).select(F.col("row_id").alias("pos"),
                                                            F.col("known").alias("actual"),
                                                            F.col("prediction").alias("predicted")), p, fmt="csv")
        paths[m] = p
    return round_doubles(io.read_prediction_files(spark, paths))


register("src_pred_files", f"""SELECT model, row_id, round(known, 6) AS actual, round(prediction, 6) AS predicted
FROM {REG_SQL}""")(q_src_pred_files)


def q_sink_metrics(spark, sf):
    m = metrics.metrics_regression(reg_view(spark, sf), by=["model"])
    out = scratch_path(spark, "metrics")
    io.write_metrics(m, out, fmt="json")
    back = spark.read.schema("model STRING, variance DOUBLE, mae DOUBLE, mse DOUBLE, rmse DOUBLE, r2 DOUBLE").json(out)
    return round_doubles(back)


register("sink_metrics", _sql_reg_metrics(REG_SQL, "model"))(q_sink_metrics)


def q_sink_feature_table(spark, sf):
    from moltab.plans.q_columns import feat_view
    v = feat_view(spark, sf).select("row_id", "f_qty", "f_disc")
    out = scratch_path(spark, "features")
    io.write_table(v, out, fmt="csv")
    return io.read_csv(spark, out, "row_id STRING, f_qty DOUBLE, f_disc DOUBLE", key="row_id")


register("sink_feature_table", f"""SELECT {LINE_KEY_SQL} AS row_id, l_quantity AS f_qty,
  l_discount AS f_disc FROM lineitem""")(q_sink_feature_table)


def q_sink_guard(spark, sf):
    """Writing twice without overwrite must refuse; the first table is returned."""
    c = table(spark, sf, "region")
    out = scratch_path(spark, "guard")
    io.write_table(c, out)
    try:
        io.write_table(c.limit(1), out)
        refused = False
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        refused = True
    return io.read_parquet(spark, out).withColumn("refused", F.lit(refused))


register("sink_guard", "SELECT *, true AS refused FROM region")(q_sink_guard)


# ------------------------------------------------------------ ensemble

def q_ensemble_mean(spark, sf):
    e = reports.ensemble_mean(reg_view(spark, sf).withColumnRenamed("known", "actual")
                              .withColumnRenamed("prediction", "predicted"), key="row_id")
    return round_doubles(e)


register("ensemble_mean", f"""SELECT row_id, round(arg_min(known, model), 6) AS actual, round(avg(prediction), 6) AS predicted
FROM {REG_SQL} GROUP BY row_id""")(q_ensemble_mean)


def q_ensemble_metrics(spark, sf):
    e = reports.ensemble_mean(reg_view(spark, sf).withColumnRenamed("known", "actual")
                              .withColumnRenamed("prediction", "predicted"), key="row_id")
    return round_doubles(metrics.metrics_regression(e.withColumn("model", F.lit("ensemble")), "actual",
                                                    "predicted", by=["model"]))


register("ensemble_metrics", _sql_reg_metrics(f"""(SELECT 'ensemble' AS model, arg_min(known, model) AS known,
  avg(prediction) AS prediction FROM {REG_SQL} GROUP BY row_id)""", "model"))(q_ensemble_metrics)


# ------------------------------------------------------------ classification reports

def q_all_class_report(spark, sf):
    v = clf_view(spark, sf).withColumn("is_synthetic", F.col("l_linestatus") == "O")
    rep = reports.all_class_report(v, "known", "prediction", score="score", by=["l_returnflag"],
                                   synthetic="is_synthetic")
    return rep


def _sql_class_report():
    cols = {"tpr": "tp, tp + fn", "fpr": "fp, fp + tn", "tnr": "tn, tn + fp", "fnr": "fn, fn + tp",
            "precision": "tp, tp + fp", "recall": "tp, tp + fn"}
    sel = ", ".join(f"(round(CAST({a.split(',')[0]} AS DOUBLE) / nullif({a.split(',')[1]}, 0), 2)) AS {k}"
                    for k, a in cols.items())
    return sel


def _fb(b):
    b2 = b * b
    p = "(CAST(tp AS DOUBLE) / nullif(tp + fp, 0))"
    rr = "(CAST(tp AS DOUBLE) / nullif(tp + fn, 0))"
    return f"(round(({1 + b2} * {p} * {rr}) / nullif({b2} * {p} + {rr}, 0), 2))"


from moltab.plans.common import sql_curve_cte, sql_curve_summary  # noqa: E402

register("all_class_report", f"""WITH v0 AS {CLF_SQL},
v AS (SELECT *, 'all' AS subset FROM v0 UNION ALL SELECT *, 'real' FROM v0 WHERE NOT (l_linestatus = 'O')),
lab AS (SELECT DISTINCT known AS label FROM v UNION SELECT DISTINCT prediction FROM v),
cm AS (SELECT l_returnflag, subset, label,
  sum(CASE WHEN known <> label AND prediction <> label THEN 1 ELSE 0 END) AS tn,
  sum(CASE WHEN known <> label AND prediction = label THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN known = label AND prediction <> label THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN known = label AND prediction = label THEN 1 ELSE 0 END) AS tp FROM v CROSS JOIN lab GROUP BY ALL),
vc AS (SELECT l_returnflag, subset, 1 AS class, known AS is_pos, score AS s FROM v WHERE known IS NOT NULL
  UNION ALL SELECT l_returnflag, subset, 0, 1 - known, 1 - score FROM v WHERE known IS NOT NULL),
cu AS {sql_curve_cte('vc', 'is_pos', 's', ['l_returnflag', 'subset', 'class'])},
au AS {sql_curve_summary('cu', ['l_returnflag', 'subset', 'class'])}
SELECT cm.l_returnflag, cm.subset, label AS class, {_sql_class_report()}, {_fb(0.5)} AS f_half, {_fb(1.0)} AS f1,
  {_fb(2.0)} AS f2,
  (round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 2)) AS mcc,
  (round(roc_auc, 2)) AS roc_auc, (round(pr_auc, 2)) AS pr_auc
FROM cm LEFT JOIN au ON au.l_returnflag = cm.l_returnflag AND au.subset = cm.subset AND au.class = label""")(q_all_class_report)


def q_fold_mean_std(spark, sf):
    v = splits.kfold(clf_view(spark, sf), "row_id", 5, seed=11)
    acc = metrics.with_rates(metrics.confusion(v, by=["l_returnflag", "fold"]))
    return round_doubles(reports.fold_mean_std(acc, "accuracy", ["l_returnflag"]))


register("fold_mean_std", f"""WITH v AS {CLF_SQL},
f AS (SELECT *, CAST(ntile(5) OVER (ORDER BY {H_CLF}, row_id) - 1 AS INTEGER) AS fold FROM v),
c AS (SELECT l_returnflag, fold, {sql_counts('known', 'prediction')} FROM f GROUP BY ALL),
a AS (SELECT l_returnflag, CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0) AS acc FROM c)
SELECT l_returnflag, round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS std FROM a GROUP BY l_returnflag""")(
    q_fold_mean_std)


# ------------------------------------------------------------ sets

def _members(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_returnflag").alias("set_name"), "l_partkey").unionByName(
        li.select(F.col("l_linestatus").alias("set_name"), "l_partkey"))


MEMBERS_SQL = """(SELECT DISTINCT l_returnflag AS s, l_partkey AS k FROM lineitem
  UNION SELECT DISTINCT l_linestatus, l_partkey FROM lineitem)"""


def q_set_overlap(spark, sf):
    return reports.set_overlaps(_members(spark, sf), "set_name", "l_partkey", max_order=3)


register("set_overlap", f"""WITH m AS {MEMBERS_SQL}
SELECT a.s || '&' || b.s AS sets, count(*) AS n FROM m a JOIN m b ON a.k = b.k AND a.s < b.s GROUP BY 1
UNION ALL
SELECT a.s || '&' || b.s || '&' || c.s, count(*) FROM m a JOIN m b ON a.k = b.k AND a.s < b.s
  JOIN m c ON c.k = a.k AND b.s < c.s GROUP BY 1""")(q_set_overlap)


def q_intersect_sets(spark, sf):
    m = _members(spark, sf)
    return reports.intersect_sets([m.where(F.col("set_name") == s) for s in ("R", "F", "A")], "l_partkey")


register("intersect_sets", f"""WITH m AS {MEMBERS_SQL}
SELECT k AS l_partkey FROM m WHERE s = 'R' INTERSECT SELECT k FROM m WHERE s = 'F'
INTERSECT SELECT k FROM m WHERE s = 'A'""")(q_intersect_sets)


def q_union_train_test(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", F.dayofmonth("ts").alias("day"))
    s = splits.split_temporal(e, "day")
    return s.where(~F.col("is_test")).drop("is_test").unionByName(s.where("is_test").drop("is_test"))


register("union_train_test", "SELECT event_id, value, CAST(dayofmonth(ts) AS INTEGER) AS day FROM events")(
    q_union_train_test)


def q_union_folds(spark, sf):
    out = _write_reg_folds(spark, sf)
    d = spark.read.option("header", True).schema(
        "pos LONG, index DOUBLE, known DOUBLE, prediction DOUBLE, model STRING, fold INT").csv(out)
    return d.groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n"))


register("union_folds", f"""SELECT model, CAST(ntile({N_REG_FOLDS}) OVER (PARTITION BY model ORDER BY {H_REG}, row_id) - 1 AS INTEGER) AS fold
FROM {ORD_REG_SQL}""".replace("SELECT model, CAST", "SELECT model, fold, count(*) AS n FROM (SELECT model, CAST") +
         ") GROUP BY model, fold")(q_union_folds)


# ------------------------------------------------------------ order operators

def q_topk_abs(spark, sf):
    from moltab.operators import stats
    from moltab.plans.q_columns import CORR_COLS, feat_view
    c = stats.corr_features(feat_view(spark, sf), CORR_COLS, "f_price").where(F.col("r").isNotNull())
    return round_doubles(reports.topk_abs(c.select("feature", "r"), "r", 3))


register("topk_abs", """SELECT feature, r FROM (SELECT feature, round(r, 6) AS r, abs(r0) AS a FROM
  (SELECT feature, covar_pop(value, y) / nullif(sqrt(var_pop(value) * var_pop(y)), 0) AS r0,
          covar_pop(value, y) / nullif(sqrt(var_pop(value) * var_pop(y)), 0) AS r FROM
    (SELECT 'f_qty' AS feature, l_quantity AS value, l_extendedprice AS y FROM lineitem
     UNION ALL SELECT 'f_disc', l_discount, l_extendedprice FROM lineitem
     UNION ALL SELECT 'f_tax', l_tax, l_extendedprice FROM lineitem
     UNION ALL SELECT 'f_line', CAST(l_linenumber AS DOUBLE), l_extendedprice FROM lineitem
     UNION ALL SELECT 'f_sparse', CASE WHEN l_linenumber >= 5 THEN l_discount END, l_extendedprice FROM lineitem
     UNION ALL SELECT 'f_zero', l_discount * 0.0, l_extendedprice FROM lineitem)
   WHERE value IS NOT NULL GROUP BY feature) WHERE r0 IS NOT NULL ORDER BY a DESC, feature LIMIT 3)""")(q_topk_abs)


def q_sort_by_key(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.dayofmonth("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy("day")


register("sort_by_key", "SELECT CAST(dayofmonth(ts) AS INTEGER) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1")(
    q_sort_by_key)


def q_argmax_abs(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_returnflag", line_key().alias("item"),
        (F.col("l_discount") - 0.05).alias("v"))
    return round_doubles(reports.argmax_abs(li, "l_returnflag", "item", "v"))


register("argmax_abs", f"""SELECT l_returnflag, item, round(a, 6) AS abs_value FROM (SELECT l_returnflag,
  {LINE_KEY_SQL} AS item, abs(l_discount - 0.05) AS a,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(l_discount - 0.05) DESC, {LINE_KEY_SQL}) AS rn
  FROM lineitem) WHERE rn = 1""")(q_argmax_abs)


def q_rank_candidates(spark, sf):
    li = table(spark, sf, "lineitem")
    grid = li.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("cand_id")) \
        .agg(F.avg("l_discount").alias("mean_score")).withColumn("metric", F.lit("disc"))
    return round_doubles(reports.rank_candidates(grid))


register("rank_candidates", """SELECT model, cand_id, round(mean_score, 6) AS mean_score, metric,
  CAST(rank() OVER (PARTITION BY model, metric ORDER BY mean_score DESC) AS INTEGER) AS rank FROM
  (SELECT l_returnflag AS model, l_linenumber AS cand_id, avg(l_discount) AS mean_score, 'disc' AS metric
   FROM lineitem GROUP BY 1, 2)""")(q_rank_candidates)


def q_keep_first(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity",
                                             "l_partkey", "l_suppkey")
    # (ship date, line number) repeats inside an order: part and supplier make the order total
    first = reports.keep_first(li, "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"])
    return first.select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")


register("keep_first", """SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM (SELECT *,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS rn
  FROM lineitem) WHERE rn = 1""")(
    q_keep_first)


# ------------------------------------------------------------ joins

def q_join_features(spark, sf):
    from moltab.plans.q_columns import feat_view
    a = feat_view(spark, sf).select("row_id", "f_qty", "f_price")
    b = feat_view(spark, sf).where(F.col("f_line") == 1).select("row_id", "f_price",
                                                                 (F.col("f_tax") * 2).alias("f_tax2"))
    l2, r2 = columns.suffix_overlap(a, b, ["row_id"], "_l", "_r")
    return l2.join(r2, "row_id", "left")


register("join_features", f"""SELECT a.row_id, a.f_qty, a.f_price AS f_price_l, b.f_price AS f_price_r, b.f_tax2 FROM
  (SELECT {LINE_KEY_SQL} AS row_id, l_quantity AS f_qty, l_extendedprice AS f_price FROM lineitem) a
  LEFT JOIN (SELECT {LINE_KEY_SQL} AS row_id, l_extendedprice AS f_price, l_tax * 2 AS f_tax2
             FROM lineitem WHERE l_linenumber = 1) b ON a.row_id = b.row_id""")(q_join_features)


def q_attach_ids(spark, sf):
    v = clf_view(spark, sf).select("row_id", "known", "prediction")
    li = table(spark, sf, "lineitem").select(line_key().alias("row_id"), "l_partkey")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return columns.misclassified(v).join(li, "row_id").join(p, "l_partkey") \
        .select("row_id", "p_name", "known", "prediction")


register("attach_ids", f"""SELECT {LINE_KEY_SQL} AS row_id, p_name, CAST(l_discount >= 0.05 AS INTEGER) AS known,
  CAST(l_quantity / 50.0 >= 0.5 AS INTEGER) AS prediction FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE CAST(l_discount >= 0.05 AS INTEGER) <> CAST(l_quantity / 50.0 >= 0.5 AS INTEGER)""")(q_attach_ids)


def _bit_importance(spark, sf):
    """Importance of pattern bits = share of documents with the bit (derived from data)."""
    f = fp.pattern_fp(table(spark, sf, "documents"), "doc_id", "text", TEXT_KEYS)
    ex = f.select(F.explode("bits").alias("bit"))
    tot = f.agg(F.count(F.lit(1)).alias("_n"))
    imp = ex.groupBy("bit").agg(F.count(F.lit(1)).alias("_c")).crossJoin(F.broadcast(tot)) \
        .select(F.concat(F.lit("fp_"), F.col("bit")).alias("feature"), (F.col("_c") / F.col("_n")).alias("importance"))
    return f, imp


def q_lookup_dict(spark, sf):
    _, imp = _bit_importance(spark, sf)
    extra = spark.createDataFrame([("delta_t", 0.5)], "feature string, importance double")
    imp = imp.unionByName(extra)
    d = spark.createDataFrame([(f"fp_{k}", p, lab) for k, p, _, lab in TEXT_KEYS],
                              "feature string, pattern string, label string")
    j = imp.join(F.broadcast(d), "feature", "left")  # fixed dictionary: ~20 rows
    return round_doubles(j.select("feature", "importance", F.coalesce("pattern", F.lit("not_in_dictionary")).alias("pattern"),
                                  F.coalesce("label", F.lit("not_in_dictionary")).alias("label")))


def _sql_text_fp_rows():
    parts = [f"SELECT doc_id, {k} AS bit FROM documents WHERE len(regexp_extract_all(text, '{p}')) > {mc}"
             for k, p, mc, _ in TEXT_KEYS if p != "?" and "'" not in p]
    return " UNION ALL ".join(parts)


def _sql_dict_values():
    vals = ", ".join("('fp_{0}', '{1}', '{2}')".format(k, p.replace("'", "''"), lab.replace("'", "''"))
                     for k, p, _, lab in TEXT_KEYS)
    return f"(VALUES {vals}) d(feature, pattern, label)"


register("lookup_dict", f"""WITH b AS ({_sql_text_fp_rows()}),
imp AS (SELECT 'fp_' || bit AS feature, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM documents) AS importance
        FROM b GROUP BY bit UNION ALL SELECT 'delta_t', 0.5)
SELECT imp.feature, round(importance, 6) AS importance, coalesce(pattern, 'not_in_dictionary') AS pattern,
  coalesce(label, 'not_in_dictionary') AS label FROM imp LEFT JOIN {_sql_dict_values()} ON imp.feature = d.feature""")(
    q_lookup_dict)


def q_complete_bits(spark, sf):
    from moltab.operators.explain import complete_bits
    f = fp.ngram_fp(table(spark, sf, "part"), "p_partkey", "p_name", n_max=1, n_bits=64, pattern=r"[A-Za-z0-9]+")
    imp = f.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).cast("double").alias("importance"))
    return complete_bits(imp, 64)


register("complete_bits", f"""WITH imp AS (SELECT bit, CAST(count(*) AS DOUBLE) AS importance FROM
  (SELECT DISTINCT p_partkey, CAST(CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 64 AS INTEGER) AS bit
   FROM (SELECT p_partkey, unnest(regexp_extract_all(p_name, '[A-Za-z0-9]+')) AS w FROM part)) GROUP BY bit)
SELECT CAST(r.range AS INTEGER) AS bit, coalesce(importance, 0.0) AS importance FROM range(64) r
LEFT JOIN imp ON imp.bit = r.range""")(q_complete_bits)


def q_coef_row_join(spark, sf):
    from moltab.operators.explain import row_bit_legend
    f, imp = _bit_importance(spark, sf)
    imp_bits = imp.where(F.col("feature").startswith("fp_")).select(
        F.regexp_extract("feature", r"^fp_(\d+)$", 1).cast("int").alias("bit"), "importance")
    return row_bit_legend(f, "doc_id", "bits", imp_bits)


register("coef_row_join", f"""WITH b AS ({_sql_text_fp_rows()}),
imp AS (SELECT bit, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM documents) AS importance FROM b GROUP BY bit)
SELECT doc_id, string_agg(bit || ' (' || printf('%.4f', importance) || ')', ', ' ORDER BY importance DESC, bit) AS legend
FROM b JOIN imp USING (bit) GROUP BY doc_id""")(q_coef_row_join)
