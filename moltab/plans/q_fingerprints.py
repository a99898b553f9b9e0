"""Registered queries: fingerprints, patterns and similarity (§2.3, §2.8, §2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from moltab.functions.text import WORD_PATTERN, sql_bucket_of
from moltab.operators import fingerprints as fp
from moltab.operators import similarity as sim
from moltab.plans.common import round_doubles
from moltab.plans.registry import register, table

# A word-pattern dictionary for prose (key, pattern, min_count, label).
TEXT_KEYS = [
    (1, "?", 0, "undefined"),
    (2, "the", 2, "article the, more than twice"),
    (3, "and", 0, "conjunction and"),
    (4, "tion", 1, "-tion, twice or more"),
    (5, "[0-9]", 0, "a digit"),
    (6, "@", 0, "at sign"),
    (7, "http", 0, "link"),
    (8, "eau", 3, "eau, four or more"),
    (9, "ein", 0, "ein"),
    (10, "[A-Z][a-z]+ [A-Z][a-z]+", 0, "two capitalised words"),
    (11, "[.!?]", 5, "six or more sentence ends"),
    (12, "qu", 0, "qu"),
    (13, "ch", 2, "ch, three or more"),
    (14, "license|License|LICENSE", 0, "license word"),
    (15, "\n", 1, "two or more line breaks"),
    (16, "ing", 3, "-ing, four or more"),
    (17, "x", 0, "letter x"),
    (18, "el", 1, "el, twice or more"),
    (19, "[aeiou]{3}", 0, "three vowels in a row"),
    (20, "z", 0, "letter z"),
]

NAMED_PATTERNS = {"has_ring": "ring", "has_red": "red", "has_bolt_or_nut": "bolt|nut",
                  "has_small": "^small", "has_er": "er\\b"}


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_tokens(text: str, pattern: str = WORD_PATTERN) -> str:
    return f"regexp_extract_all({text}, {_sql_str(pattern)})"


def _sql_ngrams(tok: str, n_max: int) -> str:
    parts = [f"list_transform(range(1, len({tok}) - {n - 1} + 1), lambda i: array_to_string({tok}[i:i + {n - 1}], ' '))"
             for n in range(1, n_max + 1)]
    return "flatten([" + ", ".join(parts) + "])"


def _sql_bits(feats: str, n_bits: int) -> str:
    return f"list_sort(list_distinct(list_transform({feats}, lambda g: {sql_bucket_of('g', n_bits)})))"


def _sql_tok_rows(src: str, key: str, text: str, pattern: str = WORD_PATTERN) -> str:
    """(key, pos, w): one row per token, via unnest (linear, unlike list slicing)."""
    return f"""(SELECT {key}, unnest(range(1, len(tok) + 1)) AS pos, unnest(tok) AS w
      FROM (SELECT {key}, {_sql_tokens(text, pattern)} AS tok FROM {src}))"""


def _sql_lead_feats(src: str, key: str, text: str, exprs: list[str], n_bits: int, extra=()) -> str:
    """Bits from features built with lead() over token rows; every key kept (empty list if none)."""
    leads = ", ".join(f"lead(w, {d}) OVER (PARTITION BY {key} ORDER BY pos) AS w{d}" for d in range(1, 4))
    feats = " UNION ALL ".join(f"SELECT {key}, {e} AS g FROM l" for e in exprs)
    return f"""(SELECT s.{key}, coalesce(b.bits, []) AS b FROM {src} s LEFT JOIN
      (SELECT {key}, list_sort(list(DISTINCT {sql_bucket_of('g', n_bits)})) AS bits FROM
        (WITH l AS (SELECT {key}, w AS w0, {leads} FROM {_sql_tok_rows(src, key, text)}) {feats})
       WHERE g IS NOT NULL GROUP BY {key}) b ON b.{key} = s.{key})"""


def _csv(col):
    return F.array_join(F.col(col), ",")


def q_tokenize(spark, sf):
    d = fp.tokenize(table(spark, sf, "documents"), "text", WORD_PATTERN)
    return d.select("doc_id", F.size("tokens").alias("n_tokens"),
                    F.md5(F.array_join("tokens", " ")).alias("tok_md5"))


register("tokenize", f"""SELECT doc_id, CAST(len({_sql_tokens('text')}) AS INTEGER) AS n_tokens,
  md5(array_to_string({_sql_tokens('text')}, ' ')) AS tok_md5 FROM documents""")(q_tokenize)


def q_ngram_fp_part(spark, sf):
    f = fp.ngram_fp(table(spark, sf, "part"), "p_partkey", "p_name", n_max=2, n_bits=256,
                    pattern=WORD_PATTERN)
    return f.select("p_partkey", F.size("bits").alias("n_on"), _csv("bits").alias("bits"))


register("ngram_fp", f"""SELECT p_partkey, CAST(len(b) AS INTEGER) AS n_on, array_to_string(b, ',') AS bits FROM
  (SELECT p_partkey, {_sql_bits(_sql_ngrams(_sql_tokens('p_name'), 2), 256)} AS b FROM part)""")(q_ngram_fp_part)


def q_ngram_fp_docs(spark, sf):
    f = fp.ngram_fp(table(spark, sf, "documents"), "doc_id", "text", n_max=3, n_bits=1024,
                    pattern=WORD_PATTERN)
    return f.select("doc_id", F.size("bits").alias("n_on"), F.md5(_csv("bits")).alias("bits_md5"))


register("ngram_fp_documents", f"""SELECT doc_id, CAST(len(b) AS INTEGER) AS n_on, md5(array_to_string(b, ',')) AS bits_md5
FROM {_sql_lead_feats('documents', 'doc_id', 'text', ["w0", "w0 || ' ' || w1", "w0 || ' ' || w1 || ' ' || w2"], 1024)}""")(q_ngram_fp_docs)


def _entries(counts: str = "counts"):
    return F.array_join(F.transform(F.map_entries(counts), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")


def _with_words(df, text: str, least: int):
    """Rows that have a feature: a filter on the map itself would be evaluated before it."""
    return df.where(F.regexp_count(text, F.lit(WORD_PATTERN)) >= least)


def q_fp_nonzero(spark, sf):
    p = _with_words(table(spark, sf, "part"), "p_name", 1)
    m = fp.ngram_count_map(p, "p_partkey", "p_name", n_max=2, n_bits=64, pattern=WORD_PATTERN)
    return m.select("p_partkey", _entries().alias("counts"))


register("fp_nonzero", f"""SELECT p_partkey, string_agg(bit || ':' || n, ',' ORDER BY bit) AS counts FROM
  (SELECT p_partkey, bit, count(*) AS n FROM
    (SELECT p_partkey, unnest(list_transform({_sql_ngrams(_sql_tokens('p_name'), 2)},
        lambda g: {sql_bucket_of('g', 64)})) AS bit FROM part)
   GROUP BY ALL) GROUP BY p_partkey""")(q_fp_nonzero)


def q_pair_fp(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t"))
    f = fp.pair_fp(p, "p_partkey", "t", max_distance=3, n_bits=512, pattern=WORD_PATTERN)
    return f.select("p_partkey", F.size("bits").alias("n_on"), _csv("bits").alias("bits"))


def _sql_pairs(tok: str, dmax: int) -> str:
    parts = [f"list_transform(range(1, len({tok}) - {d} + 1), lambda i: concat_ws('|', least({tok}[i], {tok}[i + {d}]), "
             f"greatest({tok}[i], {tok}[i + {d}]), '{d}'))" for d in range(1, dmax + 1)]
    return "flatten([" + ", ".join(parts) + "])"


register("pair_fp", f"""SELECT p_partkey, CAST(len(b) AS INTEGER) AS n_on, array_to_string(b, ',') AS bits FROM
  (SELECT p_partkey, {_sql_bits(_sql_pairs(_sql_tokens("concat_ws(' ', p_name, p_type, p_brand)"), 3), 512)} AS b
   FROM part)""")(q_pair_fp)


def q_pair_counts(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t"))
    m = fp.pair_counts(_with_words(p, "t", 2), "p_partkey", "t", max_distance=3, n_bits=512, pattern=WORD_PATTERN)
    return m.select("p_partkey", _entries().alias("counts"))


register("pair_fp_counts", f"""SELECT p_partkey, string_agg(bit || ':' || n, ',' ORDER BY bit) AS counts FROM
  (SELECT p_partkey, bit, count(*) AS n FROM
    (SELECT p_partkey, unnest(list_transform({_sql_pairs(_sql_tokens("concat_ws(' ', p_name, p_type, p_brand)"), 3)},
        lambda g: {sql_bucket_of('g', 512)})) AS bit FROM part)
   GROUP BY ALL) GROUP BY p_partkey""")(q_pair_counts)


def q_path_fp(spark, sf):
    f = fp.path_fp(table(spark, sf, "documents"), "doc_id", "text", length=4, n_bits=1024, pattern=WORD_PATTERN)
    return f.select("doc_id", F.size("bits").alias("n_on"), F.md5(_csv("bits")).alias("bits_md5"))


def _sql_paths(tok: str, L: int) -> str:
    return (f"list_transform(range(1, len({tok}) - {L - 1} + 1), lambda i: least(array_to_string({tok}[i:i + {L - 1}], ' '), "
            f"array_to_string(list_reverse({tok}[i:i + {L - 1}]), ' ')))")


def q_path_counts(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t"))
    m = fp.path_counts(_with_words(p, "t", 3), "p_partkey", "t", length=3, n_bits=128, pattern=WORD_PATTERN)
    return m.select("p_partkey", _entries().alias("counts"))


register("path_fp_counts", f"""SELECT p_partkey, string_agg(bit || ':' || n, ',' ORDER BY bit) AS counts FROM
  (SELECT p_partkey, bit, count(*) AS n FROM
    (SELECT p_partkey, unnest(list_transform({_sql_paths(_sql_tokens("concat_ws(' ', p_name, p_type, p_brand)"), 3)},
        lambda g: {sql_bucket_of('g', 128)})) AS bit FROM part)
   GROUP BY ALL) GROUP BY p_partkey""")(q_path_counts)


register("path_fp", f"""SELECT doc_id, CAST(len(b) AS INTEGER) AS n_on, md5(array_to_string(b, ',')) AS bits_md5
FROM {_sql_lead_feats('documents', 'doc_id', 'text',
                      ["least(w0 || ' ' || w1 || ' ' || w2 || ' ' || w3, w3 || ' ' || w2 || ' ' || w1 || ' ' || w0)"], 1024)}""")(q_path_fp)


def q_pattern_fp(spark, sf):
    f = fp.pattern_fp(table(spark, sf, "documents"), "doc_id", "text", TEXT_KEYS)
    return f.select("doc_id", _csv("bits").alias("bits"))


def _sql_pattern_fp():
    parts = [f"CASE WHEN len(regexp_extract_all(text, {_sql_str(p)})) > {mc} THEN {k} END"
             for k, p, mc, _ in TEXT_KEYS if p != "?"]
    return f"""SELECT doc_id, array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ',') AS bits
FROM documents"""


register("pattern_fp", _sql_pattern_fp())(q_pattern_fp)


def q_fp_to_columns(spark, sf):
    f = fp.ngram_fp(table(spark, sf, "part"), "p_partkey", "p_name", n_max=1, n_bits=16, pattern=WORD_PATTERN)
    return fp.fp_to_columns(f, "p_partkey", "bits", 16)


register("fp_to_columns", "SELECT p_partkey, " + ", ".join(
    f"CAST(list_contains(b, {k}) AS INTEGER) AS fp_{k}" for k in range(16)) +
    f" FROM (SELECT p_partkey, {_sql_bits(_sql_ngrams(_sql_tokens('p_name'), 1), 16)} AS b FROM part)")(
    q_fp_to_columns)


def q_bits_to_text(spark, sf):
    f = fp.ngram_fp(table(spark, sf, "part"), "p_partkey", "p_name", n_max=2, n_bits=32, pattern=WORD_PATTERN)
    return f.select("p_partkey", fp.bits_to_text("bits", 32).alias("bit_text"))


register("bits_to_text", f"""SELECT p_partkey, array_to_string(list_transform(range(0, 32),
  lambda k: CASE WHEN list_contains(b, k) THEN '1' ELSE '0' END), '') AS bit_text FROM
  (SELECT p_partkey, {_sql_bits(_sql_ngrams(_sql_tokens('p_name'), 2), 32)} AS b FROM part)""")(q_bits_to_text)


def q_has_pattern(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", fp.has_pattern("text", "license|License").alias("has_license"))


register("has_pattern", """SELECT doc_id, CAST(regexp_matches(text, 'license|License') AS INTEGER) AS has_license
FROM documents""")(q_has_pattern)


def q_pattern_match_rows(spark, sf):
    return fp.pattern_match_rows(table(spark, sf, "part"), "p_name", "ring|gear").select("p_partkey", "p_name")


register("pattern_match_rows", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'ring|gear')")(
    q_pattern_match_rows)


def q_pattern_locate(spark, sf):
    return fp.pattern_locate(table(spark, sf, "documents"), "text", "qu[a-z]+", keep=["doc_id"])


register("pattern_locate", """SELECT doc_id,
  CAST(CASE WHEN regexp_matches(text, 'qu[a-z]+') THEN strpos(text, regexp_extract(text, 'qu[a-z]+')) ELSE 0 END AS INTEGER) AS match_pos,
  CASE WHEN regexp_matches(text, 'qu[a-z]+') THEN regexp_extract(text, 'qu[a-z]+') END AS match_text
FROM documents""")(q_pattern_locate)


def q_pattern_onehot(spark, sf):
    return fp.pattern_onehot(table(spark, sf, "part"), "p_name", NAMED_PATTERNS, keep=["p_partkey"])


register("pattern_onehot", "SELECT p_partkey, " + ", ".join(
    f"CAST(regexp_matches(p_name, {_sql_str(p)}) AS INTEGER) AS {n}" for n, p in NAMED_PATTERNS.items()) +
    " FROM part")(q_pattern_onehot)


# ------------------------------------------------------------ similarity

def emb_bits(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", sim.embedding_bits("embedding").alias("bits"))


EMB_SQL = """(SELECT vec_id, label, list_filter(list_transform(range(0, len(embedding)),
   lambda i: CASE WHEN embedding[i + 1] > 0 THEN i END), lambda x: x IS NOT NULL) AS bits FROM embeddings)"""


def _sql_tani(a, b):
    return f"(CAST(len(list_intersect({a}, {b})) AS DOUBLE) / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0))"


def _sql_dice(a, b):
    return f"(2.0 * len(list_intersect({a}, {b})) / nullif(len({a}) + len({b}), 0))"


def q_fp_similarity(spark, sf):
    e = emb_bits(spark, sf)
    a = e.select(F.col("vec_id").alias("i"), F.col("bits").alias("ba"))
    b = e.select((F.col("vec_id") - 1).alias("i"), F.col("vec_id").alias("j"), F.col("bits").alias("bb"))
    j = a.join(b, "i")
    return round_doubles(j.select("i", "j", sim.fp_similarity("ba", "bb").alias("tanimoto"),
                                  sim.fp_similarity("ba", "bb", dice=True).alias("dice")))


register("fp_similarity", f"""SELECT a.vec_id AS i, b.vec_id AS j, round({_sql_tani('a.bits', 'b.bits')}, 6) AS tanimoto,
  round({_sql_dice('a.bits', 'b.bits')}, 6) AS dice FROM {EMB_SQL} a JOIN {EMB_SQL} b ON b.vec_id = a.vec_id + 1""")(
    q_fp_similarity)


def q_fp_similarity_counts(spark, sf):
    c = fp.ngram_counts(table(spark, sf, "part"), "p_partkey", "p_name", n_max=2, n_bits=64, pattern=WORD_PATTERN)
    m = fp.fp_nonzero(c, "p_partkey")
    a = m.select(F.col("p_partkey").alias("i"), F.col("counts").alias("ca"))
    b = m.select((F.col("p_partkey") - 1).alias("i"), F.col("p_partkey").alias("j"), F.col("counts").alias("cb"))
    return round_doubles(a.join(b, "i").select("i", "j", sim.count_tanimoto_expr("ca", "cb").alias("sim")))


register("fp_similarity_counts", f"""WITH c AS (SELECT p_partkey AS k, bit, count(*) AS n FROM
    (SELECT p_partkey, unnest(list_transform({_sql_ngrams(_sql_tokens('p_name'), 2)},
        lambda g: {sql_bucket_of('g', 64)})) AS bit FROM part) GROUP BY ALL),
pairs AS (SELECT p_partkey AS i, p_partkey + 1 AS j FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)
          AND p_partkey IN (SELECT k FROM c) AND p_partkey + 1 IN (SELECT k FROM c)),
mins AS (SELECT pairs.i, pairs.j, sum(least(a.n, b.n)) AS smin FROM pairs JOIN c a ON a.k = pairs.i
         JOIN c b ON b.k = pairs.j AND b.bit = a.bit GROUP BY ALL),
tot AS (SELECT k, sum(n) AS s FROM c GROUP BY k)
SELECT pairs.i, pairs.j, round(coalesce(smin, 0) / nullif(ta.s + tb.s - coalesce(smin, 0), 0), 6) AS sim
FROM pairs LEFT JOIN mins ON mins.i = pairs.i AND mins.j = pairs.j
JOIN tot ta ON ta.k = pairs.i JOIN tot tb ON tb.k = pairs.j""")(q_fp_similarity_counts)


def q_sim_self_join(spark, sf):
    e = emb_bits(spark, sf)
    return round_doubles(sim.similarity_pairs(e, "vec_id", "bits", min_sim=0.6))


register("sim_self_join", f"""SELECT * FROM (SELECT a.vec_id AS i, b.vec_id AS j, round({_sql_tani('a.bits', 'b.bits')}, 6) AS sim
  FROM {EMB_SQL} a JOIN {EMB_SQL} b ON a.vec_id < b.vec_id WHERE len(a.bits) > 0 AND len(b.bits) > 0
  AND {_sql_tani('a.bits', 'b.bits')} >= 0.6)""")(q_sim_self_join)


def q_sim_join_ngrams(spark, sf):
    """Token n-grams in 1,024 bits: sparse sets of many words."""
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t"))
    f = fp.ngram_fp(p, "p_partkey", "t", n_max=2, n_bits=1024, pattern=WORD_PATTERN)
    return round_doubles(sim.similarity_pairs(f, "p_partkey", "bits", min_sim=0.7))


_PART_BITS = f"""(SELECT p_partkey, {_sql_bits(_sql_ngrams(_sql_tokens("concat_ws(' ', p_name, p_type, p_brand)"), 2), 1024)} AS bits FROM part)"""
register("sim_join_ngrams", f"""WITH f AS MATERIALIZED {_PART_BITS}
SELECT * FROM (SELECT a.p_partkey AS i, b.p_partkey AS j, round({_sql_tani('a.bits', 'b.bits')}, 6) AS sim FROM f a JOIN f b
  ON a.p_partkey < b.p_partkey AND len(a.bits) > 0 AND len(b.bits) > 0 AND {_sql_tani('a.bits', 'b.bits')} >= 0.7)""")(q_sim_join_ngrams)


def q_sim_cross_join(spark, sf):
    """The three matrices of two sets (even and odd labels): within each and between."""
    e = emb_bits(spark, sf)
    a, b = e.where(F.col("label") % 2 == 0), e.where(F.col("label") % 2 == 1)
    part = lambda name, x, y=None: sim.similarity_pairs(
        x, "vec_id", "bits", b=y, min_sim=0.6, metric="dice").withColumn("part", F.lit(name))
    return round_doubles(part("within_1", a).unionByName(part("within_2", b)).unionByName(part("between", a, b)))


register("sim_cross_join", f"""WITH e AS {EMB_SQL}
SELECT CASE WHEN a.label % 2 <> b.label % 2 THEN 'between' WHEN a.label % 2 = 0 THEN 'within_1'
    ELSE 'within_2' END AS part, a.vec_id AS i, b.vec_id AS j, round({_sql_dice('a.bits', 'b.bits')}, 6) AS sim
FROM e a JOIN e b ON (a.label % 2 = b.label % 2 AND a.vec_id < b.vec_id) OR (a.label % 2 = 0 AND b.label % 2 = 1)
WHERE len(a.bits) > 0 AND len(b.bits) > 0 AND {_sql_dice('a.bits', 'b.bits')} >= 0.6""")(q_sim_cross_join)


def q_sim_search(spark, sf):
    e = emb_bits(spark, sf)
    return round_doubles(sim.similarity_search(e.where(F.col("vec_id") == 0), e, "vec_id", "bits", 0.5))


register("sim_search", f"""SELECT b.vec_id AS number, a.vec_id AS fp_reference, b.vec_id AS fp_target,
  round({_sql_tani('a.bits', 'b.bits')}, 6) AS similarity
FROM {EMB_SQL} a, {EMB_SQL} b WHERE a.vec_id = 0 AND {_sql_tani('a.bits', 'b.bits')} >= 0.5""")(q_sim_search)


def q_sim_summary_above(spark, sf):
    e = emb_bits(spark, sf)
    pairs = sim.similarity_pairs(e, "vec_id", "bits", min_sim=0.5)
    return round_doubles(sim.similarity_summary(pairs, e))


register("sim_summary_above", f"""WITH p AS (SELECT {_sql_tani('a.bits', 'b.bits')} AS s FROM {EMB_SQL} a JOIN {EMB_SQL} b
   ON a.vec_id < b.vec_id WHERE len(a.bits) > 0 AND len(b.bits) > 0 AND {_sql_tani('a.bits', 'b.bits')} >= 0.5),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM embeddings),
a AS (SELECT coalesce(sum(s), 0) AS s1, coalesce(sum(s * s), 0) AS s2 FROM p)
SELECT CAST(n AS BIGINT) AS n, round((2 * s1 + n) / (n * n), 6) AS mean,
  round(sqrt(greatest((2 * s2 + n) / (n * n) - ((2 * s1 + n) / (n * n)) * ((2 * s1 + n) / (n * n)), 0)), 6) AS std
FROM a, n""")(q_sim_summary_above)


def q_sim_summary(spark, sf):
    return round_doubles(sim.dice_summary(emb_bits(spark, sf), "bits"))


register("sim_summary", f"""WITH p AS (SELECT CASE WHEN len(a.bits) + len(b.bits) = 0 THEN 0
    ELSE {_sql_dice('a.bits', 'b.bits')} END AS s FROM {EMB_SQL} a CROSS JOIN {EMB_SQL} b)
SELECT (SELECT count(*) FROM embeddings) AS n, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std
FROM p""")(q_sim_summary)
