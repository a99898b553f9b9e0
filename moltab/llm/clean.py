"""Pipeline-side uses of the operators: what a stage does with an operator's result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltab.llm import op5_language_id, op8_secret_scan
from moltab.llm.common import tmp
from moltab.llm.op9_minhash import Near, near_duplicates

REDACTED = "[SECRET]"


def keep_identified(docs: DataFrame, vocab: str, least: float = 0.5, margin: float = 0.0) -> DataFrame:
    """Rows whose text has a language: posterior at least ``least`` among the languages and
    a likelihood per letter above that of letters drawn one by one (by ``margin``, in nats).
    Null texts and texts without a letter go; repeated rows go or stay together; ties of
    languages count for neither.  An empty table stays empty; other columns pass through."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: f"c{i}" for i, n in enumerate(names)}
    model = op5_language_id.fit(docs, vocab)
    seen = op5_language_id.predict(plain, model, key=at["doc_id"], text=at["text"],
                                   keep=tuple(plain.columns))
    ok = seen.where((F.col("lang_pred") != "und") & (F.col("score") >= least) & (F.col("margin") > margin))
    return ok.select(*plain.columns).toDF(*names)


def keep_representatives(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One document of each near-duplicate group: the smallest id.  Different texts under
    one id are documents of their own; rows without an id stay."""
    own = tmp("own")
    rows = docs.where("doc_id is not null").withColumn(own, F.xxhash64("doc_id", "text"))
    of = near_duplicates(rows.select(own, "text"), near, key=own) \
        .select(F.col("doc_id").alias(own), "component_id").distinct()
    first = rows.select(own, "doc_id").distinct().join(of, own).groupBy("component_id") \
        .agg(F.min_by(own, F.struct("doc_id", own)).alias(own)).select(own)
    one = rows.join(first, own, "left_semi").groupBy(F.col(own).alias("k"), F.col("doc_id").alias("i")) \
        .agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("r")).select("r.*")
    return one.unionByName(docs.where("doc_id is null"))


def redact_secrets(docs: DataFrame, ledger: str) -> DataFrame:
    """Every span found is replaced by ``REDACTED`` (overlapping spans by one); a
    column ``n_chars`` follows the new text."""
    op8_secret_scan.update_ledger(docs, ledger)
    blob, spans = tmp("blob"), tmp("spans")
    per_blob = op8_secret_scan.findings(docs.sparkSession, ledger).groupBy(F.col("blob").alias(blob)) \
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans))
    rows = docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")), 256)) \
        .join(per_blob.hint("shuffle_hash"), blob, "left")
    text = F.col("text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def put(a, s):
        return F.when(s["start"] >= a["at"], F.struct(
            s["end"].alias("at"),
            F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1,
                                           (s["start"] - a["at"]).cast("int")),
                     F.lit(REDACTED)).alias("out"))) \
            .otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))

    clean = F.aggregate(F.col(spans), start, put, lambda a: F.concat(
        a["out"], F.substring(text, a["at"].cast("int") + 1, F.length(text))))
    out = rows.withColumn("text", F.when(F.col(spans).isNull(), text).otherwise(clean))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars"))
                             .otherwise(F.length("text").cast(kind)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
