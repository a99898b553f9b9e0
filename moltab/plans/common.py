"""Shared pieces of the registered queries: driver-table views and SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moltab.functions.numeric import round_half_away

DIGITS = 6


def line_key():
    """Unique lineitem row key (order, line number, part, supplier, ship day) as text;
    ``(l_orderkey, l_linenumber)`` alone repeats in the driver tables."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in
                              ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                       F.date_format("l_shipdate", "yyyyMMdd"))


LINE_KEY_SQL = ("concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
                "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), strftime(l_shipdate, '%Y%m%d'))")


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every DOUBLE/FLOAT column (the oracle does the same); -0.0 becomes 0.0."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_half_away(f.name, digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def r(expr: str, digits: int = DIGITS) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}))"


# -- SQL twins of moltab.operators.metrics (inputs: tn, fp, fn, tp columns) --

def sql_div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def sql_rates(prefix: str = "") -> dict[str, str]:
    tn, fp, fn, tp = (f"{prefix}{c}" for c in ("tn", "fp", "fn", "tp"))
    prec = sql_div(tp, f"{tp}+{fp}")
    rec = sql_div(tp, f"{tp}+{fn}")
    tnr = sql_div(tn, f"{tn}+{fp}")

    def fb(b):
        b2 = float(b) ** 2
        return f"(({1.0 + b2} * {prec} * {rec}) / nullif({b2} * {prec} + {rec}, 0))"

    den = (f"sqrt(CAST({tp}+{fp} AS DOUBLE)*CAST({tp}+{fn} AS DOUBLE)*"
           f"CAST({tn}+{fp} AS DOUBLE)*CAST({tn}+{fn} AS DOUBLE))")
    return {
        "accuracy": sql_div(f"{tp}+{tn}", f"{tp}+{tn}+{fp}+{fn}"),
        "tpr": rec, "fpr": sql_div(fp, f"{fp}+{tn}"), "tnr": tnr, "fnr": sql_div(fn, f"{fn}+{tp}"),
        "g_mean": f"sqrt({rec} * {tnr})",
        "f_half": fb(0.5), "f1": fb(1.0), "f2": fb(2.0),
        "mcc": f"((CAST({tp} AS DOUBLE)*{tn} - CAST({fp} AS DOUBLE)*{fn}) / nullif({den}, 0))",
        "precision": prec, "recall": rec,
    }


def sql_rate_select(prefix: str = "") -> str:
    return ", ".join(f"{r(e)} AS {k}" for k, e in sql_rates(prefix).items())


def sql_counts(known: str, pred: str, positive: str = "1") -> str:
    kp, pp = f"{known} = {positive}", f"{pred} = {positive}"
    return (f"count(*) FILTER (WHERE NOT ({kp}) AND NOT ({pp})) AS tn, "
            f"count(*) FILTER (WHERE NOT ({kp}) AND {pp}) AS fp, "
            f"count(*) FILTER (WHERE {kp} AND NOT ({pp})) AS fn, "
            f"count(*) FILTER (WHERE {kp} AND {pp}) AS tp")


def sql_curve_cte(src: str, known: str, score: str, by: list[str], positive: str = "1") -> str:
    """CTE body producing (by, score, pos, neg, cum_pos, cum_neg, cum_one, P, N)."""
    b = ", ".join(by)
    bsel = (b + ", ") if by else ""
    part = f"PARTITION BY {b}" if by else ""
    return f"""
    (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg, row_number() OVER w AS cum_one,
            sum(pos) OVER ({part}) AS P, sum(neg) OVER ({part}) AS N
     FROM (SELECT {bsel} CAST({score} AS DOUBLE) AS score,
                  count(*) FILTER (WHERE {known} = {positive}) AS pos,
                  count(*) FILTER (WHERE {known} <> {positive}) AS neg
           FROM {src} WHERE {known} IS NOT NULL AND {score} IS NOT NULL
           GROUP BY ALL) s
     WINDOW w AS ({part} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def sql_curve_summary(cum: str, by: list[str]) -> str:
    bsel = (", ".join(by) + ", ") if by else ""
    tp, fp = "CAST(cum_pos AS DOUBLE)", "CAST(cum_neg AS DOUBLE)"
    tp0, fp0 = f"({tp} - pos)", f"({fp} - neg)"
    prec = f"({tp} / nullif({tp} + {fp}, 0))"
    prec0 = f"(CASE WHEN {tp0} + {fp0} = 0 THEN 1.0 ELSE {tp0} / ({tp0} + {fp0}) END)"
    return f"""(SELECT {bsel}
        sum(neg * ({tp} + {tp0}) / nullif(2.0 * N * P, 0)) AS roc_auc,
        sum(pos * ({prec} + {prec0}) / nullif(2.0 * P, 0)) AS pr_auc,
        sum(pos * {prec} / nullif(CAST(P AS DOUBLE), 0)) AS avg_precision
      FROM {cum} c GROUP BY ALL)"""
