"""Registered queries: scaling, one-hot, feature preparation, splits (§2.8, §2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from moltab.functions.rng import sql_hash32, sql_key, sql_lit
from moltab.operators import scaling, sparse, splits
from moltab.plans.common import round_doubles
from moltab.plans.registry import register, table

PART_NUM = ["p_size", "p_retailprice"]


def part_view(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"),
                                           "p_retailprice", "p_type", "p_brand")


def q_autoscale(spark, sf):
    return round_doubles(scaling.autoscale(part_view(spark, sf), PART_NUM).select("p_partkey", *PART_NUM))


register("autoscale", """WITH s AS (SELECT avg(p_size) AS m1, stddev_samp(p_size) AS s1,
  avg(p_retailprice) AS m2, stddev_samp(p_retailprice) AS s2 FROM part)
SELECT p_partkey, round((p_size - m1) / nullif(s1, 0), 6) AS p_size,
  round((p_retailprice - m2) / nullif(s2, 0), 6) AS p_retailprice FROM part, s""")(q_autoscale)


def q_minmaxscale(spark, sf):
    return round_doubles(scaling.minmaxscale(part_view(spark, sf), PART_NUM).select("p_partkey", *PART_NUM))


register("minmaxscale", """WITH s AS (SELECT min(p_size) AS a1, max(p_size) AS b1,
  min(p_retailprice) AS a2, max(p_retailprice) AS b2 FROM part)
SELECT p_partkey, round((p_size - a1) / nullif(b1 - a1, 0), 6) AS p_size,
  round((p_retailprice - a2) / nullif(b2 - a2, 0), 6) AS p_retailprice FROM part, s""")(q_minmaxscale)


def q_log_scale(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("l2"),
                                            F.col("c_acctbal").alias("l10"))
    c = scaling.log2_scale(c, ["l2"])
    return round_doubles(scaling.log10_scale(c, ["l10"]))


register("log2_scale", """SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN log2(c_acctbal) END, 6) AS l2,
  round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, 6) AS l10 FROM customer""")(q_log_scale)


def q_apply_train_scale(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    split = splits.split_temporal(o, "y")
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    return round_doubles(scaling.autoscale(test, ["o_totalprice"], fit_on=train)
                         .select("o_orderkey", "o_totalprice"))


register("apply_train_scale", """WITH o AS (SELECT o_orderkey, o_totalprice, year(o_orderdate) AS y FROM orders),
mx AS (SELECT max(y) AS my FROM o),
s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM o, mx WHERE y <> my)
SELECT o_orderkey, round((o_totalprice - m) / nullif(sd, 0), 6) AS o_totalprice FROM o, mx, s WHERE y = my""")(
    q_apply_train_scale)


def q_minmax_fit_apply(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    train = c.where(F.col("c_nationkey") < 20)
    test = c.where(F.col("c_nationkey") >= 20)
    model = scaling.minmax_fit(train, ["c_acctbal"])
    return round_doubles(model.transform(test).select("c_custkey", "c_acctbal"))


register("minmax_fit", """WITH s AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer WHERE c_nationkey < 20)
SELECT c_custkey, round(CASE WHEN b = a THEN c_acctbal - a ELSE (c_acctbal - a) / (b - a) END, 6) AS c_acctbal
FROM customer, s WHERE c_nationkey >= 20""")(q_minmax_fit_apply)


def q_onehot(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    train = o.where(F.col("o_orderstatus") != "P")
    model = scaling.onehot_fit(train, ["o_orderpriority", "o_orderstatus"])
    return model.transform(o)


register("onehot_fit", """SELECT o_orderkey,
  CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS "o_orderpriority_1-URGENT",
  CAST(o_orderpriority = '2-HIGH' AS INTEGER) AS "o_orderpriority_2-HIGH",
  CAST(o_orderpriority = '3-MEDIUM' AS INTEGER) AS "o_orderpriority_3-MEDIUM",
  CAST(o_orderpriority = '4-NOT SPECIFIED' AS INTEGER) AS "o_orderpriority_4-NOT SPECIFIED",
  CAST(o_orderpriority = '5-LOW' AS INTEGER) AS "o_orderpriority_5-LOW",
  CAST(o_orderstatus = 'F' AS INTEGER) AS o_orderstatus_F,
  CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O FROM orders""")(q_onehot)


def q_onehot_long(spark, sf):
    """A column of very many categories, encoded without a column per category."""
    o = table(spark, sf, "orders")
    train = o.where(F.col("o_orderstatus") != "P")
    cols = ["o_custkey", "o_orderpriority", "o_orderstatus"]
    return sparse.onehot_long(o, "o_orderkey", cols, sparse.onehot_dictionary(train, cols))


register("onehot_long", """WITH l AS (SELECT o_orderkey, o_orderstatus AS s, unnest(['o_custkey', 'o_orderpriority', 'o_orderstatus']) AS feature,
  unnest([o_custkey::VARCHAR, o_orderpriority, o_orderstatus]) AS value FROM orders),
d AS (SELECT feature, value, row_number() OVER (ORDER BY feature, value) - 1 AS index
      FROM (SELECT DISTINCT feature, value FROM l WHERE s <> 'P'))
SELECT o_orderkey, feature, index FROM l JOIN d USING (feature, value)""")(q_onehot_long)


def q_feature_prep(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment",
                                            (F.col("c_acctbal") > 0).alias("positive"))
    prep = scaling.FeaturePrep("some_categorical", categorical=["c_mktsegment"], exclude=["c_custkey"])
    train = c.where(F.col("c_custkey") % 5 != 0)
    model = prep.fit(train)
    return round_doubles(model.transform(c.where(F.col("c_custkey") % 5 == 0), key=["c_custkey"]))


register("feature_prep", """WITH tr AS (SELECT * FROM customer WHERE c_custkey % 5 <> 0),
s AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b,
  CAST(min(CAST(c_acctbal > 0 AS INTEGER)) AS DOUBLE) AS pa, CAST(max(CAST(c_acctbal > 0 AS INTEGER)) AS DOUBLE) AS pb FROM tr)
SELECT c_custkey, round((c_acctbal - a) / (b - a), 6) AS c_acctbal,
  round(CASE WHEN pb = pa THEN CAST(c_acctbal > 0 AS INTEGER) - pa
        ELSE (CAST(c_acctbal > 0 AS INTEGER) - pa) / (pb - pa) END, 6) AS positive,
  CAST(c_mktsegment = 'AUTOMOBILE' AS INTEGER) AS c_mktsegment_AUTOMOBILE,
  CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS c_mktsegment_BUILDING,
  CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS c_mktsegment_FURNITURE,
  CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS c_mktsegment_HOUSEHOLD,
  CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS c_mktsegment_MACHINERY
FROM customer, s WHERE c_custkey % 5 = 0""")(q_feature_prep)


# ------------------------------------------------------------ splits

def q_split_random(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    return splits.split_random(c, "c_custkey", 0.2, seed=42)


H_CUST_SPLIT = sql_hash32(sql_key("c_custkey"), sql_lit(42), sql_lit("split"))
register("split_random", f"""SELECT c_custkey, row_number() OVER (ORDER BY {H_CUST_SPLIT}, c_custkey)
  <= ceil(count(*) OVER () * 0.2) AS is_test FROM customer""")(q_split_random)


def q_kfold(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    return splits.kfold(c, "c_custkey", 10, seed=7)


H_CUST_KF = sql_hash32(sql_key("c_custkey"), sql_lit(7), sql_lit("kfold"))
register("kfold", f"""SELECT c_custkey, CAST(ntile(10) OVER (ORDER BY {H_CUST_KF}, c_custkey) - 1 AS INTEGER) AS fold
FROM customer""")(q_kfold)


def q_split_temporal(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.dayofmonth("ts").alias("day"))
    return splits.split_temporal(e, "day")


register("split_temporal", """SELECT event_id, CAST(dayofmonth(ts) AS INTEGER) AS day,
  dayofmonth(ts) = max(dayofmonth(ts)) OVER () AS is_test FROM events""")(q_split_temporal)


#: Customers held out by hand: every 13th key up to 150.
FIXED_IDS = list(range(13, 150, 13))


def q_split_ids(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    train, test = splits.split_by_ids(c, "c_custkey", FIXED_IDS)
    return splits.tag_origin(train, test)


_IDS = ", ".join(str(i) for i in FIXED_IDS)
register("split_ids", f"""SELECT c_custkey, c_nationkey,
  CASE WHEN c_custkey IN ({_IDS}) THEN 'test' ELSE 'train' END AS set FROM customer""")(q_split_ids)


def q_split_by_ids(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    ids = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey")
    _, test = splits.split_by_ids(li, "l_orderkey", ids)
    return test


register("split_by_ids", """SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")(q_split_by_ids)


def q_tag_origin(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.dayofmonth("ts").alias("day"))
    s = splits.split_temporal(e, "day")
    return splits.tag_origin(s.where(~F.col("is_test")).drop("is_test"), s.where("is_test").drop("is_test"))


register("tag_origin", """SELECT event_id, CAST(dayofmonth(ts) AS INTEGER) AS day,
  CASE WHEN dayofmonth(ts) = max(dayofmonth(ts)) OVER () THEN 'test' ELSE 'train' END AS set FROM events""")(
    q_tag_origin)


def q_class_weights(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return round_doubles(splits.class_weights(lab, "quality", "balanced").select("doc_id", "quality", "weight"))


register("class_weights", """WITH c AS (SELECT quality, count(*) AS nc FROM labels GROUP BY quality),
t AS (SELECT sum(nc) AS n, count(*) AS k FROM c)
SELECT doc_id, labels.quality, round(CAST(n AS DOUBLE) / (k * nc), 6) AS weight
FROM labels JOIN c ON labels.quality = c.quality, t""")(q_class_weights)
