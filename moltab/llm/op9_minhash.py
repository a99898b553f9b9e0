"""Near-duplicates of word shingles: MinHash with tensored banding.

A document's set is its distinct ``words``-word shingles.  ``groups`` small hash
collections of ``width`` minhashes each are computed per set; a table key joins the
keys of two collections, so ``groups * width`` minhashes serve
``groups * (groups - 1) / 2`` tables.  A pair with similarity s is missed only if
fewer than two of its collections agree: at the default (16 collections of 3) six
pairs in a million at s = 0.85, none to speak of above.

Documents with equal sets are one class, represented by the smallest id, before any
table is built.  A class is named by that id ``c`` and by ``v``, the first eight bytes of
its set's hash, which tells the versions of one id apart.  Collection keys held by one class only are dropped before keys are
joined.  A table bucket is never expanded into all pairs:

1. every member is compared with the bucket's leader, the one whose collection keys are
   held by the most classes (what stands in the middle of a group of near copies, not one at
   its edge); classes linked so far fall into components;
2. buckets whose members are all in one component are done;
3. the classes of all other buckets are joined by an exact prefix filter on their full
   sets (two sets of the wanted similarity share an element among the rarest of each),
   which finds every link that the buckets' pairs would give.  Classes of one component
   do not meet there.

Every link is confirmed on the full sets (64-bit shingle hashes).

Null and wordless texts have an empty set, link with nothing and are kept.  A null
id has a null component and is kept.  Rows that share an id count as versions of one
document: what is near any version is linked to the id, and all versions that have words
share a component.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moltab.llm.common import components, forget, importable, join_hot, staged, table


@dataclass(frozen=True)
class Near:
    """Shingle length, similarity ``num / den`` and the banding."""
    words: int = 5
    num: int = 80
    den: int = 100
    groups: int = 20
    width: int = 3

    @property
    def limit(self) -> float:
        return 1.0 - self.num / self.den


_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes.  ``bytes.lower`` and ``bytes.split`` change and
    cut at ASCII only: A-Z, blank and the control characters 9 to 13."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    n = max(len(h) - words + 1, 1)
    size = min(words, len(h))
    s = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        s = _mix(s * _MULT + h[j:j + n])
    return np.unique(s)


def _digest(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def _version(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _hashers(near: Near) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, near.groups * near.width + 1, dtype=np.uint64)
    return _mix(k * _MULT) | np.uint64(1), _mix(k + np.uint64(1 << 40))


def collection_keys(s: np.ndarray, near: Near, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 4096):
        low = np.minimum(low, (s[None, at:at + 4096] * a[:, None] + b[:, None]).min(axis=1))
    low = low.reshape(near.groups, near.width)
    key = np.arange(near.groups, dtype=np.uint64)
    for j in range(near.width):
        key = _mix(key * _MULT + low[:, j])
    return key.view(np.int64)


def _fingerprints(docs: DataFrame, near: Near, key: str, text: str) -> DataFrame:
    """``doc_id, n, set_hash, v, subs`` per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hashers(near)
        for batch in batches:
            n, digest, subs = [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), near.words)
                n.append(len(s))
                digest.append(_digest(s) if len(s) else None)
                subs.append(collection_keys(s, near, a, b) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array([d and _version(d) for d in digest], pa.int64()),
                 pa.array(subs, pa.list_(pa.int64()))], names=["doc_id", "n", "set_hash", "v", "subs"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n long, set_hash binary, v long, subs array<long>")


def _sets(docs: DataFrame, ids: DataFrame, near: Near, key: str, text: str) -> DataFrame:
    """``c, v, s``: the full set of every version of the ids of ``ids`` (column ``c``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):   # sets leave in small batches
                part = batch.slice(at, 256)
                found = [(c.as_py(), _version(_digest(s)), s) for c, t in zip(part.column(0), part.column(1))
                         if len(s := shingle_set(t.as_py(), near.words))]
                found = list({f[:2]: f for f in found}.values())
                ends = np.cumsum([0, *(len(f[2]) for f in found)], dtype=np.int32)
                every = np.concatenate([f[2] for f in found]) if found else np.empty(0, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int64()),
                     pa.array([f[1] for f in found], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(every.view(np.int64)))],
                    names=["c", "v", "s"])

    rows = docs.select(F.col(key).cast("long").alias("c"), F.col(text).cast("binary").alias("t"))
    known = rows.join(ids.hint("shuffle_hash"), "c", "left_semi")
    return known.mapInArrow(run, "c long, v long, s array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """``a, b`` of those of the distinct pairs that are linked, decided on the full sets."""
    x = sets.select(F.col("c").alias("a"), F.col("v").alias("va"), F.col("s").alias("x"))
    y = sets.select(F.col("c").alias("b"), F.col("v").alias("vb"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, ["a", "va"]).join(y, ["b", "vb"]) \
        .where(both * (near.num + near.den) >= near.num * (F.size("x") + F.size("y"))) \
        .select("a", "b")


def _pair(**columns: tuple[str, str]) -> list[Column]:
    """Columns of both sides of a pair, the side of the smaller id first; ``ab`` names
    the ids, the others are named ``<name>a, <name>b``."""
    x, y = columns.pop("ab")
    low = F.col(x) < F.col(y)
    first = lambda p, q: F.when(low, F.col(p)).otherwise(F.col(q))
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b"),
            *[c for n, (p, q) in columns.items()
              for c in (first(p, q).alias(f"{n}a"), first(q, p).alias(f"{n}b"))]]


def _near_size(n: Column, m: Column, share: float) -> Column:
    """Sizes that allow a similarity of ``share`` (a hair less, for rounding)."""
    return F.least(n, m) >= F.greatest(n, m) * (share - 1e-9)


def near_duplicates(docs: DataFrame, near: Near = Near(), key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per input row."""
    importable(docs.sparkSession)
    rows = staged(_fingerprints(docs, near, key, text), "near-rows")
    one = rows.where("set_hash is not null").groupBy("set_hash") \
        .agg(F.min("doc_id").alias("c")).where("c is not null")
    full = rows.where("doc_id is not null").select(F.col("set_hash").alias("h"), "doc_id", "n", "v", "subs")
    classes = staged(one.join(full, (F.col("set_hash") == F.col("h")) & (F.col("c") == F.col("doc_id")))
                     .select("c", "v", "n", "subs").dropDuplicates(["c", "v"]), "near-classes")
    links, used = _links(docs, classes, near, key, text)
    # classes that hold versions of one id belong together
    of_id = rows.where("doc_id is not null").select(F.col("set_hash").alias("h"), "doc_id") \
        .join(one, F.col("set_hash") == F.col("h")).select("doc_id", "c")
    several = of_id.groupBy("doc_id").agg(F.min("c").alias("b"), F.max("c").alias("hi")) \
        .where("b <> hi").select("doc_id", "b")
    ties = of_id.join(several, "doc_id").where("c <> b").select(F.col("c").alias("a"), "b")
    found = components(links.unionByName(ties))
    forget(classes, *used)
    top = one.join(found, F.col("c") == F.col("node"), "left") \
        .select(F.col("set_hash").alias("h"), F.coalesce("component", "c").alias("component_id"))
    return rows.join(top, F.col("set_hash") == F.col("h"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _links(docs: DataFrame, classes: DataFrame, near: Near, key: str, text: str) -> tuple[DataFrame, list[DataFrame]]:
    """Confirmed links ``a, b`` between classes, enough of them to give the components
    of all links, and the staged tables that they are read from."""
    # collection keys that more than one class holds
    subs = classes.select("c", "v", "n", F.posexplode("subs").alias("i", "u"))
    shared = subs.groupBy("i", "u").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    held = subs.join(shared, ["i", "u"]).groupBy("c", "v", "n").agg(
        F.array_sort(F.collect_list(F.struct("i", "u"))).alias("held"),   # at most `groups`
        (-F.sum("m")).alias("edge"))
    # tensor: every two of them, in order
    first = held.select("c", "v", "n", "edge", "held", F.posexplode("held").alias("p", "x"))
    both = first.select("c", "v", "n", "edge", "x", F.explode(F.slice(
        "held", F.col("p") + 2, F.size("held"))).alias("y"))
    keys = both.select(F.xxhash64("x.i", "x.u", "y.i", "y.u").alias("k"), "c", "v", "n", "edge")
    lead = keys.groupBy("k").agg(F.min(F.struct("edge", "c", "v")).alias("l"), F.count(F.lit(1)).alias("m")) \
        .where("m > 1").select("k", F.col("l.c").alias("a"), F.col("l.v").alias("va"))
    members = staged(keys.drop("edge").join(lead, "k"), "near-members")
    sets = staged(_sets(docs, members.select("c").distinct(), near, key, text), "near-sets")
    sizes = classes.select(F.col("c").alias("a"), F.col("v").alias("va"), F.col("n").alias("na"))

    # 1. members against leaders
    pairs = members.where("c <> a") \
        .select("a", "va", F.col("c").alias("b"), F.col("v").alias("vb"), "n").distinct() \
        .join(sizes, ["a", "va"]).where(_near_size(F.col("n"), F.col("na"), 1 - near.limit)) \
        .select(*_pair(ab=("a", "b"), v=("va", "vb"))).distinct()
    led = staged(_verified(pairs, sets, near), "near-led")

    # 2. buckets that still hold several components
    comp = components(led)
    at = members.join(comp, F.col("c") == F.col("node"), "left") \
        .withColumn("comp", F.coalesce("component", "c")).drop("node", "component")
    open_ = at.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")) \
        .where("lo <> hi").select("k")
    rest = staged(at.join(open_, "k").select("c", "v", "n", "comp").distinct(), "near-rest")

    # 3. their classes against each other
    late, used = _prefix_links(rest, sets, near)
    return led.unionByName(late), [members, sets, led, rest, *used]


def _prefix_links(rows: DataFrame, sets: DataFrame, near: Near) -> tuple[DataFrame, list[DataFrame]]:
    """All links ``a, b`` between classes of ``rows`` (``c, v, n, comp``) whose components
    differ, and the staged tables read.

    Similarity t needs an overlap of ``o = ceil(t / (1 + t) * (n + m))`` of sets with n and m
    elements.  The elements stand in the order of how many of these sets hold them, rare
    ones first; a pair's first common element then stands at a place with at least ``o``
    elements from there on in both sets.  So only elements among the first
    ``n - ceil(t * n) + 1`` of a set are joined, and a pair meets only where both places
    allow the overlap.  An element that one set holds joins nothing and only takes a place.
    """
    mine = sets.join(rows.select("c", "v").hint("shuffle_hash"), ["c", "v"])
    held = staged(mine.select("c", "v", F.explode("s").alias("h")), "near-elements")
    often = staged(held.groupBy("h").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "near-often")
    known = join_hot(held, often.withColumn("size", F.col("f")), ["h"], "size", held.count())
    # a set's shared elements, at most its own number, rare ones first
    n, c = F.col("n"), F.size("es")
    reach = n + F.floor(F.lit(-near.num) * n / near.den).cast("long") + 1 - (n - c)   # unshared ones come first
    heads = known.groupBy("c", "v").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("es")) \
        .join(rows, ["c", "v"]).where(reach > 0) \
        .select("c", "v", "n", "comp", (n - c).alias("own"), F.posexplode(F.slice("es", F.lit(1), reach.cast("int"))).alias("i", "e")) \
        .select("c", "v", "n", "comp", (F.col("own") + F.col("i")).alias("p"), F.col("e.h").alias("h"))
    heads = staged(heads, "near-heads")
    # one side of a pair is outside the element's largest component, whose rows never meet
    by_comp = heads.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("m"))
    mixed = by_comp.groupBy("h").agg(F.sum("m").alias("rows"), F.max("m").alias("most"),
                                     F.max_by("comp", F.struct("m", "comp")).alias("major")) \
        .where("rows > most").select("h", "major")
    heads_of = heads.join(mixed, "h")
    side = lambda i: [F.col(x).alias(f"{x}{i}") for x in ("c", "v", "n", "comp", "p")]
    x = heads_of.where("comp <> major").select("h", *side(1))
    y = heads_of.select("h", "major", *side(2))
    left = F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2"))
    met = x.join(y, "h").where(
        ((F.col("c1") < F.col("c2")) | (F.col("comp2") == F.col("major"))) & (F.col("comp1") != F.col("comp2"))
        & _near_size(F.col("n1"), F.col("n2"), 1 - near.limit)
        & (left * (near.num + near.den) >= near.num * (F.col("n1") + F.col("n2"))))
    pairs = met.select(*_pair(ab=("c1", "c2"), v=("v1", "v2"))).distinct()
    late = staged(_verified(pairs, sets, near), "near-late")
    return late, [held, often, heads, late]


#: The contract's measure: three words, similarity 0.85.
CONTRACT = Near(words=3, num=85, den=100, groups=16)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), CONTRACT)
