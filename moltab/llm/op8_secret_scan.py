"""Secret scan over a content-addressed, incremental blob ledger (native).

Every version of a text is addressed by the SHA-256 of its bytes.  The ledger is
an append-only table of ``(blob, rules, hits)``: which rule versions a blob was
scanned with, and what they matched.  A run hashes all rows, keeps one row per
address, drops the (blob, rule version) pairs the ledger already has, scans the
rest, appends them and joins the findings of the current rules back to every row
that holds the blob.  A new rule version makes only its own pairs unseen.

Match positions come from ``split`` and ``regexp_extract_all``: the lengths of the
gaps and of the matches add up to offsets in code points.

Null text counts as empty: no findings.  Null keys and repeated rows are kept, a
result row per input row.  An empty table gives an empty result (and an empty
ledger).  Only the named columns are read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moltab.llm.common import table
from moltab.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; a match counts when its
    ``group`` has at least ``least`` characters.  ``hints`` are lower-case strings of
    which a text must hold one (empty: always scanned); ``quick`` a pattern that must
    occur."""
    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()
    quick: str = ""

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed base rules.  Runs of a class are greedy, so a bounded repeat finds the same
#: long enough runs; the assignment's value is measured after matching.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=6, hints=("passw", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]{16,}", hints=("akia",)),
    Rule("hex", r"[0-9a-f]{24,}", quick=r"[0-9a-f]{24}"),
)
#: The method's own rules.
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hints=("private key-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}", hints=("eyj",)),
)
RULES = BASE + EXTRA
LEDGER_SCHEMA = ("blob string, rules array<string>, "
                 "hits array<struct<rule:string,i:int,gap:int,size:int,counts:boolean>>")


def _hits(text: Column, low: Column, rule: Rule) -> Column:
    """Matches of one rule as ``(rule, i, gap before it, size, counts)``."""
    lit = F.lit(rule.pattern)
    pieces = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"),
                          F.regexp_extract_all(text, lit, F.lit(0)).alias("hit"),
                          F.regexp_extract_all(text, lit, F.lit(rule.group)).alias("value"))
    found = F.transform(F.filter(pieces, lambda p: p["hit"].isNotNull()), lambda p, i: F.struct(
        F.lit(rule.id).alias("rule"), i.cast("int").alias("i"), F.length(p["gap"]).alias("gap"),
        F.length(p["hit"]).alias("size"), (F.length(p["value"]) >= rule.least).alias("counts")))
    may = F.array_contains("rules", rule.id)
    if rule.hints:
        any_hint = F.contains(low, F.lit(rule.hints[0]))
        for h in rule.hints[1:]:
            any_hint = any_hint | F.contains(low, F.lit(h))
        may = may & any_hint
    if rule.quick:
        may = may & F.rlike(text, F.lit(rule.quick))
    return F.when(may, found).otherwise(F.array().cast(
        "array<struct<rule:string,i:int,gap:int,size:int,counts:boolean>>"))


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update_ledger(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES,
                  key: str = "doc_id", text: str = "text") -> None:
    """Scan what the ledger has not seen and append it."""
    spark = docs.sparkSession
    ids = F.array(*[F.lit(r.id) for r in rules])
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("body")) \
        .withColumn("blob", F.sha2("body", 256))
    # one row of every address stands for it; hashes are counted before any text moves
    one = rows.groupBy("blob").agg(F.min("k").alias("k"))
    seen = _ledger(spark, ledger)
    if seen is None:
        one = one.withColumn("rules", ids)
    else:
        had = seen.select("blob", F.explode("rules").alias("r")).groupBy("blob") \
            .agg(F.collect_set("r").alias("had"))   # at most one entry per rule version
        one = one.join(had, "blob", "left") \
            .withColumn("rules", F.when(F.col("had").isNull(), ids)
                        .otherwise(F.array_except(ids, "had"))).drop("had")
        one = one.where(F.size("rules") > 0)
    one = one.select(F.col("blob").alias("b"), F.col("k").alias("rep"), "rules")
    todo = rows.join(one.hint("shuffle_hash"),
                     (F.col("blob") == F.col("b")) & F.col("k").eqNullSafe(F.col("rep")))
    low = F.col("low")
    scanned = todo.withColumn("low", F.lower("body")).select(
        "blob", "rules", F.concat(*[_hits(F.col("body"), low, r) for r in rules]).alias("hits"))
    batch = f"{ledger.rstrip('/')}/batch={uuid.uuid4().hex}"
    scanned.write.parquet(batch)


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, kind, kind_no, start, end`` of the current rules, in code points."""
    number = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.id), F.lit(i))])
    kind = F.create_map(*[x for r in rules for x in (F.lit(r.id), F.lit(r.kind))])
    hits = _ledger(spark, ledger).where(F.size("hits") > 0) \
        .select("blob", F.explode("hits").alias("h")).select("blob", "h.*") \
        .where(F.col("rule").isin([r.id for r in rules])) \
        .dropDuplicates(["blob", "rule", "i"])   # repeated rows of one key, or two runs at once
    w = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(w)) \
        .where("counts") \
        .select("blob", kind[F.col("rule")].alias("kind"), number[F.col("rule")].alias("kind_no"),
                (F.col("end") - F.col("size")).alias("start"), "end")


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Update the ledger, then ``doc_id, blob, found`` per input row, ``found`` being the
    spans ``(start, kind_no, kind, end)`` in order (empty without findings)."""
    spark = docs.sparkSession
    update_ledger(docs, ledger, rules, key, text)
    per_blob = findings(spark, ledger, rules).groupBy("blob").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind_no", "kind", "end"))).alias("found"))
    rows = docs.select(F.col(key).alias("doc_id"),
                       F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))
    none = F.array().cast("array<struct<start:bigint,kind_no:int,kind:string,end:bigint>>")
    return rows.join(per_blob, "blob", "left") \
        .select("doc_id", "blob", F.coalesce("found", none).alias("found"))


def report(found: DataFrame) -> DataFrame:
    """Digest columns per row of ``scan``."""
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind_no"] < len(BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), count("assign").alias("n_assign"),
        count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"), "blob")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(table(spark, sf_dir, "documents"), scratch_path(spark, "secret-ledger")))
