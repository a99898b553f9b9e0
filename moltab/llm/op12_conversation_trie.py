"""Trie of conversation prefixes by van Emde Boas recursion.

Every conversation c is rebuilt: the first h turns of conversation ``c - c % 5`` (all if it
has fewer, none if it is absent), then c's own turns behind its first h, with
``h = crc32(decimal c) % 9``.  Each distinct sequence of first d rebuilt turns is a node.

1. Up: turns get a 128-bit digest, and the names of aligned blocks of 2, 4, 8, ... turns are
   made from those of their halves, so the tables halve from level to level.
2. Down: a problem is a node together with the distinct sequences of the next 2^k turns
   behind it.  All problems of a level are cut at half depth at once.  Node and first half
   name the cut prefix; the distinct first halves are the upper trie (same node, half the
   range, one sequence for each name), and each cut prefix is the node of a lower problem
   (the second halves behind it).  Upper tries and lower forests go down a level together;
   after log2(depth) levels every node has been a cut prefix once.
3. Totals: each node gets the sum over its own block, combined from those of the two
   halves, from the finest level up.  Then, from the coarsest level down, what hangs below
   the end of a node's block is grafted on it: the cut prefixes there have their whole
   subtrees already.

No step holds a conversation, a class of equal conversations or a node's children in one
task: positions within a conversation come from a range partitioning and the counts of its
earlier partitions, equal conversations collapse into one row with a weight, counts are
combined before shuffles, and where children meet a parent of very many they meet it by a
broadcast of bounded size (``common.join_hot``).  The digest of the members that end in a
node is a stream over their sorted ids, which arrive as joined pieces.

Rows with a null conv_id take no part.  Null role or text is empty.  Turns are ordered by
turn, null first; turns of equal number by the digest of (role, text), so repeated rows are
turns of their own and the result does not depend on their order.  An empty table gives an
empty result (no root).  Ids are whole numbers, ``%`` keeps the sign of the id as in SQL.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moltab.llm.common import importable, join_hot, staged, table

FAMILY = 5
MOST_SHARED = 9
#: Ids joined to one piece of a digest's input.
PIECE = 4096
#: Digest of no turns: the root.
ROOT = hashlib.md5(b"").digest()


def _digest(*parts):
    return F.unhex(F.md5(F.concat(*parts)))


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``c, pos, dg, nb``: the turns of each conversation numbered from 1, without a window
    over a conversation."""
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    flat = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("t"),
        _digest(F.octet_length(who).cast("string"), F.lit(":"), who, said).alias("dg"),
        F.octet_length(said).cast("long").alias("nb"), F.monotonically_increasing_id().alias("spread"))
    order = ["c", "t", "dg", "spread"]      # `spread` parts equal rows, whose order says nothing

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Place of a row among those of its conversation in this partition."""
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            c = np.asarray(b.column(0))
            if not len(c):
                continue
            starts = np.flatnonzero(np.diff(c) != 0) + 1
            first = np.zeros(len(c), np.int64)
            first[starts] = starts
            k = np.arange(len(c)) - np.maximum.accumulate(first)
            if c[0] == last:
                k[:starts[0] if len(starts) else len(c)] += n
            last, n = c[-1], int(k[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(k), pa.array(np.full(len(c), part))],
                names=["c", "dg", "nb", "k", "part"])

    placed = staged(flat.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "dg", "nb").mapInArrow(
        number, "c long, dg binary, nb long, k long, part long"), "trie-turns")
    # only a conversation across a partition's border needs an offset: two rows a border
    counts = placed.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n"))
    wide = counts.groupBy("c").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("c")
    before = F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.join(wide, "c").select("c", "part", F.coalesce(before, F.lit(0)).alias("off"))
    return placed.join(F.broadcast(offsets), ["c", "part"], "left").select(
        "c", (F.col("k") + F.coalesce("off", F.lit(0)) + 1).alias("pos"), "dg", "nb")


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``c, len`` per conversation and ``c, pos, dg, nb`` per rebuilt turn."""
    h = F.crc32(F.col("c").cast("string").cast("binary")) % MOST_SHARED
    convs = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n")) \
        .select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("base"))
    shared = convs.select(F.col("c").alias("base"), F.col("n").alias("nb_"))
    convs = staged(convs.join(shared, "base", "left").select(
        "c", "n", "h", "base", F.least("h", F.coalesce("nb_", F.lit(0))).alias("shift"))
        .withColumn("len", F.col("shift") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-convs")
    rows = convs.agg(F.sum("n").alias("n")).first()["n"] or 0
    own = join_hot(turns, convs.select("c", "n", "h", "shift"), ["c"], "n", rows).where("pos > h") \
        .select("c", (F.col("pos") - F.col("h") + F.col("shift")).alias("pos"), "dg", "nb")
    first = turns.where(f"c % {FAMILY} = 0 and pos < {MOST_SHARED}").withColumnRenamed("c", "base") \
        .join(convs.select("base", "c", "h"), "base").where("pos <= h").select("c", "pos", "dg", "nb")
    return convs.select("c", "len"), staged(own.unionByName(first), "trie-rebuilt")


def _block_names(rebuilt: DataFrame, levels: int) -> list[DataFrame]:
    """For k = 0 .. levels: ``c, b, h``, the name of the b-th block of 2^k turns."""
    names = [rebuilt.select("c", (F.col("pos") - 1).alias("b"), F.col("dg").alias("h"))]
    side = lambda i: F.max(F.when(F.col("b") % 2 == i, F.col("h")))
    for k in range(1, levels + 1):
        names.append(staged(names[-1].groupBy("c", F.expr("b div 2").alias("up")).agg(side(0).alias("x"), side(1).alias("y"))
                            .select("c", F.col("up").alias("b"),
                                    _digest("x", F.coalesce("y", F.lit(b""))).alias("h")), f"trie-names-{k}"))
    return names


def _cut(problems: DataFrame, names: DataFrame, half: int) -> DataFrame:
    """Problems (``p, i, c, w, len``: node, its depth, a sequence, how many conversations it
    stands for, its end) with ``u``, the name of the sequence's first half behind the node."""
    at = problems.withColumn("b", F.expr(f"i div {half}"))
    return at.join(names, ["c", "b"]).select("p", "i", "c", "w", "len", _digest("p", "h").alias("u"))


def _ends(members: DataFrame) -> DataFrame:
    """``g, sha``: SHA-256 of the comma-joined ids ``c`` of each class ``g`` in order."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, first, ids, out = None, 0, [], []

        def batch():
            rows = pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.string())], names=["g", "first", "ids"])
            out.clear()
            return rows

        for b in batches:
            for key, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key != g or len(ids) == PIECE:
                    if ids:
                        out.append((g, first, ",".join(ids)))
                    g, first, ids = key, c, []
                ids.append(str(c))
                if len(out) == 1024:
                    yield batch()
        if ids:
            out.append((g, first, ",".join(ids)))
        yield batch()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, state, out = None, None, []

        def batch():
            rows = pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()),
                                               pa.array([o[1] for o in out], pa.string())], names=["g", "sha"])
            out.clear()
            return rows

        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key != g:
                    if state:
                        out.append((g, state.hexdigest()))
                    g, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if len(out) >= 1024:
                yield batch()
        if state:
            out.append((g, state.hexdigest()))
        yield batch()

    pieces = members.select("g", "c").repartitionByRange("g", "c").sortWithinPartitions("g", "c") \
        .mapInArrow(joined, "g binary, first long, ids string")
    return pieces.repartition("g").sortWithinPartitions("g", "first").select("g", "ids") \
        .mapInArrow(hashed, "g binary, sha string")


def conversation_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                      text: str = "text") -> DataFrame:
    """Per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``."""
    importable(rows.sparkSession)
    convs, rebuilt = _rebuilt(_turns(rows, conv, turn, role, text))
    deepest = convs.agg(F.max("len").alias("d")).first()["d"] or 0
    levels = int(deepest).bit_length()          # 2 ** levels exceeds every depth
    names = _block_names(rebuilt, levels)
    # equal conversations: one sequence with a weight
    root = F.lit(ROOT)
    members = staged(convs.join(names[levels].where("b = 0").select("c", "h"), "c", "left")
                     .select("c", "len", F.when(F.col("len") > 0, F.col("h")).otherwise(root).alias("g")), "trie-members")
    classes = members.groupBy("g").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("w"), F.min("len").alias("len"))
    problems = classes.where("len > 0").select(root.alias("p"), F.lit(0).cast("long").alias("i"), "c", "w", "len")
    cuts: list[DataFrame] = []                  # by t: problems of 2^(t+1) turns, cut behind 2^t
    for k in range(levels, 0, -1):
        half = 1 << (k - 1)
        done = staged(_cut(problems, names[k - 1], half), f"trie-cut-{k}")
        cuts.insert(0, done)
        cut = F.col("i") + half
        upper = done.groupBy("p", "i", "u").agg(F.min("c").alias("c"), F.sum("w").alias("w"),
                                                F.min(F.least("len", cut)).alias("len")).drop("u")
        lower = done.where(F.col("len") > cut).select(F.col("u").alias("p"), cut.alias("i"), "c", "w", "len")
        problems = upper.unionByName(lower)
    return _totals(members, rebuilt, cuts)


def _totals(members: DataFrame, rebuilt: DataFrame, cuts: list[DataFrame]) -> DataFrame:
    levels = len(cuts)
    long = lambda x: F.lit(x).cast("long")
    nodes = members.agg(F.min("c").alias("conv"), F.count(F.lit(1)).alias("n")).where("n > 0") \
        .select(F.lit(ROOT).alias("u"), F.lit(levels).alias("t"), long(0).alias("depth"), "conv", "n",
                F.lit(None).cast("binary").alias("p"))
    for t, done in enumerate(cuts):
        depth = F.col("i") + (1 << t)
        nodes = nodes.unionByName(
            done.where(F.col("len") >= depth).groupBy("p", "u", depth.alias("depth"))
            .agg(F.min("c").alias("conv"), F.sum("w").alias("n")).withColumn("t", F.lit(t)))
    # sequences that reach the end of a lower problem's range: (node, the cut prefix there)
    reach = [done.where(F.col("len") >= F.col("i") + (2 << t)).select(
        F.col("u").alias("v"), F.col("c").alias("conv"), (F.col("i") + (2 << t)).alias("depth"))
        for t, done in enumerate(cuts)]
    nodes = staged(nodes, "trie-nodes")
    kids = nodes.where("t = 0 and depth > 0").select("conv", "depth", F.col("p").alias("parent"))
    if levels:
        kids = kids.unionByName(reach[0].withColumnRenamed("v", "parent"))
    n_kids = kids.groupBy(F.col("parent").alias("u")).agg(F.count(F.lit(1)).alias("kids"))
    size = rebuilt.select(F.col("c").alias("conv"), F.col("pos").alias("depth"), "nb")
    nodes = staged(nodes.join(n_kids, "u", "left").join(kids, ["conv", "depth"], "left").join(size, ["conv", "depth"], "left")
                   .withColumn("kids", F.coalesce("kids", long(0)))
                   .withColumn("leaves", (F.col("kids") == 0).cast("long"))
                   .withColumn("saved", (F.col("n") - 1) * F.coalesce("nb", long(0))).drop("nb"), "trie-own")

    # own blocks, from the finest level up: b holds what lies strictly inside a node's block
    sums = [F.sum(x).alias(x) for x in ("leaves", "saved")]
    inside = None
    blocks: list[DataFrame] = []
    for t in range(levels + 1):
        own = nodes.where(F.col("t") == t).select("u", "p", "conv", "depth", "leaves", "saved")
        if inside is not None:
            b = inside.select("u", F.col("leaves").alias("bl"), F.col("saved").alias("bs"))
            own = own.join(b, "u", "left").select(
                "u", "p", "conv", "depth", (F.col("leaves") + F.coalesce("bl", long(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("bs", long(0))).alias("saved"))
        own = staged(own, f"trie-block-{t}")
        blocks.append(own)
        if t < levels:
            up = own.select(F.col("p").alias("u"), "leaves", "saved")
            # nodes of coarser levels keep what they have
            keep = [] if inside is None else [inside.join(own.select("u"), "u", "left_anti")]
            for x in keep:
                up = up.unionByName(x)
            inside = staged(up.groupBy("u").agg(*sums), f"trie-inside-{t}")

    # whole subtrees, from the coarsest level down
    whole = blocks[levels].select("u", "conv", "depth", "leaves", "saved")
    for t in range(levels - 1, -1, -1):
        graft = reach[t].join(whole.drop("u"), ["conv", "depth"]).select(F.col("v").alias("u"), "leaves", "saved") \
            .groupBy("u").agg(F.sum("leaves").alias("gl"), F.sum("saved").alias("gs"))
        now = staged(blocks[t].join(graft, "u", "left").select(
            "u", "conv", "depth", (F.col("leaves") + F.coalesce("gl", long(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("gs", long(0))).alias("saved")), f"trie-whole-{t}")
        whole = whole.unionByName(now)

    # members that end in a node
    first = members.groupBy("g").agg(F.min("c").alias("c"))
    at = first.where(F.col("g") == F.lit(ROOT)).select("g", F.lit(ROOT).alias("u"))
    for t, done in enumerate(cuts):
        ended = done.where(F.col("len") == F.col("i") + (1 << t)).select("c", "u")
        at = at.unionByName(first.join(ended, "c").select("g", "u"))
    ends = at.join(_ends(members), "g").select("u", "sha")

    total = nodes.count()
    parents = nodes.select(F.col("u").alias("parent"), F.col("conv").alias("parent_conv_id"), "kids")
    told = join_hot(nodes.where("parent is not null").drop("kids").join(
        nodes.select("u", F.col("kids").alias("n_children")), "u"), parents.where("kids > 0"), ["parent"], "kids", total)
    root = nodes.where("parent is null").withColumnRenamed("kids", "n_children") \
        .withColumn("parent_conv_id", F.lit(None).cast("long"))
    every = told.unionByName(root).select("u", "conv", "depth", "parent_conv_id", "n", "n_children")
    return every.join(whole.select("u", "leaves", "saved"), "u").join(ends, "u", "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) AS pos, dg, nb
  FROM (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS nb,
          md5(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS dg
        FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT c, c - c % 5 AS base, n,
    (SELECT xor(list_reduce(list_prepend(4294967295::BIGINT,
              list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
              lambda s, x: xor(s >> 8, t[1 + (xor(s, x) & 255)])), 4294967295) FROM crc_table) % 9 AS h
  FROM (SELECT c, count(*) AS n FROM turns GROUP BY c)),
rebuilt AS (
  SELECT v.c, t.pos, t.dg, t.nb FROM convs v JOIN turns t ON t.c = v.base AND t.pos <= v.h
  UNION ALL
  SELECT v.c, t.pos - v.h + least(v.h, coalesce(b.n, 0)), t.dg, t.nb
  FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h LEFT JOIN convs b ON b.c = v.base),
seqs AS (
  SELECT v.c, coalesce(l, []) AS l, coalesce(nbs, []) AS nbs
  FROM convs v LEFT JOIN (SELECT c, list(dg ORDER BY pos) AS l, list(nb ORDER BY pos) AS nbs FROM rebuilt GROUP BY c) s
    ON s.c = v.c),
places AS (
  SELECT c, d, len(l) AS n, array_to_string(l[1:d], '') AS k, CASE WHEN d > 0 THEN nbs[d] ELSE 0 END AS nb,
    CASE WHEN d > 0 THEN array_to_string(l[1:d-1], '') END AS up
  FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM seqs)),
nodes AS (
  SELECT k, d, min(c) AS c, any_value(up) AS up, count(*) AS n, (count(*) - 1) * any_value(nb) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends
  FROM places GROUP BY k, d),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY ALL),
own AS (SELECT n.*, coalesce(kids, 0) AS kids FROM nodes n LEFT JOIN kids USING (k, d)),
below AS (
  SELECT p.k, p.d, sum((o.kids = 0)::INT) AS leaves, sum(o.saved) AS saved
  FROM own o JOIN places p ON p.c = o.c AND p.d <= o.d GROUP BY p.k, p.d)
SELECT o.c AS conv_id, o.d::BIGINT AS depth, q.c AS parent_conv_id, o.n::BIGINT AS n_convs, o.kids::BIGINT AS n_children,
  b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, o.ends AS ends_sha256
FROM own o JOIN below b USING (k, d) LEFT JOIN nodes q ON q.k = o.up AND q.d = o.d - 1
"""
