"""Registered queries: confusion metrics, curves, reports.

Classification view over ``lineitem`` (mapping of SURVEY §2.15):
known = ``l_discount >= 0.05``, score = ``l_quantity / 50``,
prediction = ``score >= 0.5``; ``l_returnflag`` plays the model.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from moltab.operators import curves, metrics
from moltab.plans.common import (LINE_KEY_SQL, line_key, r, round_doubles, sql_counts, sql_curve_cte, sql_curve_summary,
                                 sql_rate_select)
from moltab.plans.registry import register, table


def clf_view(spark, sf):
    li = table(spark, sf, "lineitem")
    score = F.col("l_quantity") / 50.0
    return li.select(line_key().alias("row_id"), "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
                     (F.col("l_discount") >= 0.05).cast("int").alias("known"),
                     score.alias("score"), (score >= 0.5).cast("int").alias("prediction"))


CLF_SQL = f"""(SELECT {LINE_KEY_SQL} AS row_id, l_orderkey, l_linenumber, l_returnflag, l_linestatus,
       CAST(l_discount >= 0.05 AS INTEGER) AS known, l_quantity / 50.0 AS score,
       CAST(l_quantity / 50.0 >= 0.5 AS INTEGER) AS prediction FROM lineitem)"""

RATES = ["accuracy", "tpr", "fpr", "tnr", "fnr", "g_mean", "f_half", "f1", "f2", "mcc",
         "precision", "recall"]


def q_metrics_binary(spark, sf):
    v = clf_view(spark, sf)
    return round_doubles(metrics.metrics_binary(v, "known", "prediction", score="score",
                                                by=["l_returnflag"]))


SQL_METRICS_BINARY = f"""
WITH v AS {CLF_SQL},
c AS (SELECT l_returnflag, {sql_counts('known', 'prediction')} FROM v GROUP BY l_returnflag),
cu AS {sql_curve_cte('v', 'known', 'score', ['l_returnflag'])},
a AS {sql_curve_summary('cu', ['l_returnflag'])}
SELECT c.l_returnflag, tn, fp, fn, tp, {sql_rate_select('')}, tp + fn AS support,
       {r('roc_auc')} AS roc_auc, {r('pr_auc')} AS pr_auc, {r('avg_precision')} AS avg_precision
FROM c JOIN a ON c.l_returnflag = a.l_returnflag
"""
register("metrics_binary", SQL_METRICS_BINARY)(q_metrics_binary)


def q_paper_table(spark, sf):
    m = metrics.metrics_binary(clf_view(spark, sf), "known", "prediction", by=["l_returnflag"])
    return round_doubles(m.select(F.col("l_returnflag").alias("model"), "accuracy",
                                  F.col("tpr").alias("sensitivity"), F.col("tnr").alias("specificity"),
                                  "mcc", "precision", "g_mean"))


register("paper_table", f"""
WITH v AS {CLF_SQL},
c AS (SELECT l_returnflag, {sql_counts('known', 'prediction')} FROM v GROUP BY l_returnflag),
m AS (SELECT l_returnflag, {sql_rate_select('')} FROM c)
SELECT l_returnflag AS model, accuracy, tpr AS sensitivity, tnr AS specificity, mcc, precision, g_mean FROM m
""")(q_paper_table)


def q_confusion_dict(spark, sf):
    return metrics.confusion(clf_view(spark, sf), "known", "prediction")


register("confusion_dict", f"WITH v AS {CLF_SQL} SELECT {sql_counts('known', 'prediction')} FROM v")(
    q_confusion_dict)


def q_confusion_matrix(spark, sf):
    return metrics.confusion_matrix(clf_view(spark, sf), "known", "prediction", labels=(0, 1),
                                    by=["l_linestatus"])


register("confusion_matrix", f"""
WITH v AS {CLF_SQL},
g AS (SELECT DISTINCT l_linestatus FROM v WHERE known IS NOT NULL AND prediction IS NOT NULL),
lab AS (SELECT * FROM (VALUES (0), (1)) t(label)),
cells AS (SELECT l_linestatus, known, prediction AS predicted, count(*) AS n FROM v
          WHERE known IS NOT NULL AND prediction IS NOT NULL GROUP BY ALL)
SELECT g.l_linestatus, CAST(k.label AS INTEGER) AS known, CAST(p.label AS INTEGER) AS predicted,
       CAST(coalesce(cells.n, 0) AS BIGINT) AS n
FROM g CROSS JOIN lab k CROSS JOIN lab p
LEFT JOIN cells ON cells.l_linestatus = g.l_linestatus AND cells.known = k.label AND cells.predicted = p.label
""")(q_confusion_matrix)


def mc_view(spark, sf):
    """Multi-class view: known = return flag, prediction = flag implied by quantity tercile."""
    li = table(spark, sf, "lineitem")
    pred = (F.when(F.col("l_quantity") <= 16, "A").when(F.col("l_quantity") <= 33, "N").otherwise("R"))
    return li.select("l_linestatus", F.col("l_returnflag").alias("known"), pred.alias("prediction"))


MC_SQL = """(SELECT l_linestatus, l_returnflag AS known,
   CASE WHEN l_quantity <= 16 THEN 'A' WHEN l_quantity <= 33 THEN 'N' ELSE 'R' END AS prediction
   FROM lineitem)"""


def q_confusion_multilabel(spark, sf):
    return metrics.confusion_multilabel(mc_view(spark, sf), "known", "prediction", by=["l_linestatus"])


SQL_MULTI_COUNTS = f"""
WITH v AS {MC_SQL},
lab AS (SELECT DISTINCT known AS label FROM v UNION SELECT DISTINCT prediction FROM v),
cm AS (SELECT l_linestatus, label,
  CAST(sum(CASE WHEN known <> label AND prediction <> label THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN known <> label AND prediction = label THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN known = label AND prediction <> label THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN known = label AND prediction = label THEN 1 ELSE 0 END) AS BIGINT) AS tp
  FROM v CROSS JOIN lab GROUP BY l_linestatus, label)"""

register("confusion_multilabel", SQL_MULTI_COUNTS + " SELECT * FROM cm")(q_confusion_multilabel)


def q_metrics_multilabel(spark, sf):
    cm = metrics.confusion_multilabel(mc_view(spark, sf), "known", "prediction", by=["l_linestatus"])
    return round_doubles(metrics.with_rates(cm))


register("metrics_multilabel", SQL_MULTI_COUNTS +
         f" SELECT l_linestatus, label, tn, fp, fn, tp, {sql_rate_select('')}, tp + fn AS support FROM cm")(
    q_metrics_multilabel)


_CLASS_PROBS = {"A": "p_a", "N": "p_n", "R": "p_r"}


def q_metrics_multilabel_areas(spark, sf):
    """ROC and precision-recall areas of every class by its own probability."""
    from moltab.operators.curves import roc_pr_all_classes
    li = table(spark, sf, "lineitem").select(
        "l_linestatus", F.col("l_returnflag").alias("known"), (F.col("l_quantity") / 50).alias("p_a"),
        (1 - F.col("l_quantity") / 50).alias("p_n"), F.col("l_discount").alias("p_r"))
    return round_doubles(roc_pr_all_classes(li, "known", _CLASS_PROBS, by=["l_linestatus"]))


def _class_areas_sql() -> str:
    src = "(" + " UNION ALL ".join(
        f"SELECT l_linestatus, '{c}' AS class, {e} AS score, (l_returnflag = '{c}')::INT AS known FROM lineitem"
        for c, e in (("A", "l_quantity / 50"), ("N", "1 - l_quantity / 50"), ("R", "l_discount"))) + ")"
    areas = sql_curve_summary(sql_curve_cte(src, "known", "score", ["l_linestatus", "class"]), ["l_linestatus", "class"])
    return f"""SELECT l_linestatus, class, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc,
  round(avg_precision, 6) AS avg_precision FROM {areas}"""


register("metrics_multilabel_areas", _class_areas_sql())(q_metrics_multilabel_areas)


def q_accuracy(spark, sf):
    cm = metrics.confusion_multilabel(mc_view(spark, sf), "known", "prediction", by=["l_linestatus"])
    return round_doubles(metrics.multiclass_accuracy(cm, by=["l_linestatus"]))


register("accuracy", SQL_MULTI_COUNTS + f"""
SELECT l_linestatus, {r('avg(CAST(tp AS DOUBLE) / nullif(tp + fn, 0))')} AS accuracy FROM cm GROUP BY l_linestatus
""")(q_accuracy)


def q_accuracy_pct(spark, sf):
    return round_doubles(metrics.accuracy_percentage(clf_view(spark, sf), "known", "prediction",
                                                     by=["l_returnflag"]))


register("accuracy_pct", f"""
WITH v AS {CLF_SQL}
SELECT l_returnflag, {r('100.0 * sum(CASE WHEN known = prediction THEN 1.0 ELSE 0.0 END) / count(*)')} AS accuracy_pct
FROM v GROUP BY l_returnflag""")(q_accuracy_pct)


def _rate_query(cols):
    def q(spark, sf):
        m = metrics.with_rates(metrics.confusion(clf_view(spark, sf), "known", "prediction",
                                                 by=["l_returnflag"]))
        return round_doubles(m.select("l_returnflag", *cols))
    sel = ", ".join(f"{c}" for c in cols)
    sql = f"""WITH v AS {CLF_SQL},
c AS (SELECT l_returnflag, {sql_counts('known', 'prediction')} FROM v GROUP BY l_returnflag),
m AS (SELECT l_returnflag, {sql_rate_select('')} FROM c)
SELECT l_returnflag, {sel} FROM m"""
    return q, sql


for _id, _cols in [("tpr", ["tpr", "tnr", "fpr", "fnr"]), ("precision", ["precision", "recall"]),
                   ("generalized_f", ["f_half", "f1", "f2"]), ("mcc", ["mcc"]), ("g_mean", ["g_mean"])]:
    _q, _s = _rate_query(_cols)
    register(_id, _s)(_q)


def q_prf_support(spark, sf):
    return round_doubles(metrics.prf_support(mc_view(spark, sf), "known", "prediction",
                                             by=["l_linestatus"]))


register("prf_support", SQL_MULTI_COUNTS + """
SELECT l_linestatus, label, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision,
  round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall,
  round((2.0 * (CAST(tp AS DOUBLE) / nullif(tp + fp, 0)) * (CAST(tp AS DOUBLE) / nullif(tp + fn, 0)))
     / nullif((CAST(tp AS DOUBLE) / nullif(tp + fp, 0)) + (CAST(tp AS DOUBLE) / nullif(tp + fn, 0)), 0), 6) AS f1,
  tp + fn AS support FROM cm""")(q_prf_support)


def q_imbalanced_report(spark, sf):
    return round_doubles(metrics.imbalanced_report(mc_view(spark, sf), "known", "prediction",
                                                   by=["l_linestatus"]))


register("imbalanced_report", SQL_MULTI_COUNTS + """,
per AS (SELECT l_linestatus, CAST(label AS VARCHAR) AS label,
  CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall,
  CAST(tn AS DOUBLE) / nullif(tn + fp, 0) AS specificity, tp + fn AS support FROM cm),
per2 AS (SELECT *, 2.0 * precision * recall / nullif(precision + recall, 0) AS f1,
  sqrt(recall * specificity) AS g_mean FROM per),
tot AS (SELECT l_linestatus, 'avg/total' AS label,
  sum(precision * support) / nullif(sum(CAST(support AS DOUBLE)), 0) AS precision,
  sum(recall * support) / nullif(sum(CAST(support AS DOUBLE)), 0) AS recall,
  sum(specificity * support) / nullif(sum(CAST(support AS DOUBLE)), 0) AS specificity,
  sum(f1 * support) / nullif(sum(CAST(support AS DOUBLE)), 0) AS f1,
  sum(g_mean * support) / nullif(sum(CAST(support AS DOUBLE)), 0) AS g_mean,
  CAST(sum(support) AS BIGINT) AS support FROM per2 GROUP BY l_linestatus)
SELECT l_linestatus, label, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(specificity, 6) AS specificity, round(f1, 6) AS f1, round(g_mean, 6) AS g_mean, support FROM per2
UNION ALL
SELECT l_linestatus, label, round(precision, 6), round(recall, 6), round(specificity, 6), round(f1, 6),
  round(g_mean, 6), support FROM tot""")(q_imbalanced_report)


# ------------------------------------------------------------ curves

def q_roc_curve(spark, sf):
    return round_doubles(curves.roc_curve(clf_view(spark, sf), "known", "score", by=["l_returnflag"]))


register("roc_curve", f"""
WITH v AS {CLF_SQL}, cu AS {sql_curve_cte('v', 'known', 'score', ['l_returnflag'])}
SELECT l_returnflag, CAST(cum_one AS BIGINT) AS ord, round(score, 6) AS threshold,
  {r('CAST(cum_neg AS DOUBLE) / nullif(N, 0)')} AS fpr, {r('CAST(cum_pos AS DOUBLE) / nullif(P, 0)')} AS tpr FROM cu
UNION ALL
SELECT DISTINCT l_returnflag, 0, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM v
WHERE known IS NOT NULL AND score IS NOT NULL""")(q_roc_curve)


def q_pr_curve(spark, sf):
    return round_doubles(curves.pr_curve(clf_view(spark, sf), "known", "score", by=["l_returnflag"]))


register("pr_curve", f"""
WITH v AS {CLF_SQL}, cu AS {sql_curve_cte('v', 'known', 'score', ['l_returnflag'])}
SELECT l_returnflag, CAST(cum_one AS BIGINT) AS ord, round(score, 6) AS threshold,
  {r('CAST(cum_pos AS DOUBLE) / nullif(P, 0)')} AS recall,
  {r('coalesce(CAST(cum_pos AS DOUBLE) / nullif(cum_pos + cum_neg, 0), 0.0)')} AS precision FROM cu
UNION ALL
SELECT DISTINCT l_returnflag, 0, CAST(NULL AS DOUBLE), 0.0, 1.0 FROM v
WHERE known IS NOT NULL AND score IS NOT NULL""")(q_pr_curve)


def q_auc_trapezoid(spark, sf):
    roc = curves.roc_curve(clf_view(spark, sf), "known", "score", by=["l_returnflag"])
    return round_doubles(curves.auc_trapezoid(roc, "fpr", "tpr", by=["l_returnflag"], order="ord"))


register("auc_trapezoid", f"""
WITH v AS {CLF_SQL}, cu AS {sql_curve_cte('v', 'known', 'score', ['l_returnflag'])},
a AS {sql_curve_summary('cu', ['l_returnflag'])}
SELECT l_returnflag, round(roc_auc, 6) AS auc FROM a""")(q_auc_trapezoid)


def q_avg_precision(spark, sf):
    s = curves.curve_summary(clf_view(spark, sf), "known", "score", by=["l_returnflag"])
    return round_doubles(s)


register("avg_precision", f"""
WITH v AS {CLF_SQL}, cu AS {sql_curve_cte('v', 'known', 'score', ['l_returnflag'])},
a AS {sql_curve_summary('cu', ['l_returnflag'])}
SELECT l_returnflag, {r('roc_auc')} AS roc_auc, {r('pr_auc')} AS pr_auc,
  {r('avg_precision')} AS avg_precision FROM a""")(q_avg_precision)


def q_roc_pr_all_classes(spark, sf):
    li = table(spark, sf, "lineitem")
    v = li.select("l_linestatus", F.col("l_returnflag").alias("known"),
                  (F.col("l_quantity") / 50.0).alias("pA"),
                  (F.col("l_discount") * 10.0).alias("pN"),
                  (F.col("l_tax") * 12.5).alias("pR"))
    return round_doubles(curves.roc_pr_all_classes(v, "known", {"A": "pA", "N": "pN", "R": "pR"},
                                                   by=["l_linestatus"]))


register("roc_pr_all_classes", f"""
WITH v AS (SELECT l_linestatus, l_returnflag AS known, 'A' AS class, l_quantity / 50.0 AS s,
             CAST(l_returnflag = 'A' AS INTEGER) AS is_pos FROM lineitem
           UNION ALL SELECT l_linestatus, l_returnflag, 'N', l_discount * 10.0,
             CAST(l_returnflag = 'N' AS INTEGER) FROM lineitem
           UNION ALL SELECT l_linestatus, l_returnflag, 'R', l_tax * 12.5,
             CAST(l_returnflag = 'R' AS INTEGER) FROM lineitem),
cu AS {sql_curve_cte('v', 'is_pos', 's', ['l_linestatus', 'class'])},
a AS {sql_curve_summary('cu', ['l_linestatus', 'class'])}
SELECT l_linestatus, class, {r('roc_auc')} AS roc_auc, {r('pr_auc')} AS pr_auc,
  {r('avg_precision')} AS avg_precision FROM a""")(q_roc_pr_all_classes)
