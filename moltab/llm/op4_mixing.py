"""Mixing to target weights: soft domain membership and least-squares rates (native).

1. A hashed-word naive-Bayes classifier is counted from the label table (at most
   ``sample_rows`` labelled documents, those with the smallest id hash), calibrated on
   the same rows, and gives every document a posterior over the domains ``good``, ``plain`` and ``toxic``.
2. Nonnegative document rates are fitted so that the expected domain token totals
   ``sum_i rate_i * n_i * p_ik`` meet the targets: projected gradient on the
   least-squares misfit, weighted by the inverse of the domains' token-weighted Gram
   matrix (a step of length one is then safe; the Gram matrix of the rows not yet
   at zero gives a longer step, taken where it descends), starting from rate 1.  An iteration is one aggregation that
   returns one number per domain; a rate is the projection path replayed per row,
   so no per-document state is shuffled or collected.  With ``keep`` given, documents
   whose toxic posterior is below it have a rate of at least 1.

The classifier's word weights (one array of ``buckets`` numbers per factor) and the
residuals are all that reaches the driver.

Null text: no tokens, the posterior of no evidence.  Label rows of a document that
disagree count as their maximum.  Without labels all posteriors are the same and
the fit ends at the least-squares optimum, which cannot meet arbitrary targets; the
result says so in ``Fit.worst``.  Repeated rows get equal rates.  An empty table
gives an empty result.  Input columns never clash: the operator's own columns are
generated names.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moltab.llm.common import staged, table, tmp

DOMAINS = ("good", "plain", "toxic")
#: Target shares of the corpus's tokens.
SHARES = {"good": 0.8, "plain": 0.15, "toxic": 0.05}
BUCKETS = 1 << 14
#: Weight of the background distribution, in words.
PRIOR_WORDS = 20_000.0
#: A bucket has a weight only if its share of a class is so many standard deviations
#: off; words that tell nothing then add nothing, however long the text.
LEAST_Z = 4.0


@dataclass(frozen=True)
class Classifier:
    """Log odds of a word bucket, as text of an array, and the logistic line
    ``(slope, offset)`` that turns a text's sum into a posterior."""
    toxic: str
    quality: str
    line_toxic: tuple[float, float]
    line_quality: tuple[float, float]
    buckets: int


@dataclass(frozen=True)
class Fit:
    """``steps[t][k]``: what a unit of posterior k takes off a rate in step t;
    ``worst``: largest relative misfit; ``totals`` and ``targets`` by domain; ``keep``:
    toxic posterior below which no rate is under 1."""
    steps: tuple[tuple[float, ...], ...]
    totals: dict[str, float]
    targets: dict[str, float]
    worst: float
    keep: float | None = None


def _words(text: Column) -> Column:
    """Lower-case words between blanks and line ends (marks stay with their word)."""
    flat = F.lower(F.coalesce(text, F.lit("")))
    for c in "\n\t\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.hash(word), F.lit(buckets))


def fit_classifier(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000,
                   buckets: int = BUCKETS, key: str = "doc_id", text: str = "text") -> Classifier:
    spark = docs.sparkSession
    lab = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("k")).agg(
        F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"),
        F.coalesce(F.max("quality"), F.lit(0)).alias("quality"))
    # at most sample_rows rows of three numbers: a proven bound for the broadcast
    sample = lab.orderBy(F.md5(F.col("k").cast("string").cast("binary")), "k").limit(sample_rows)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("body")) \
        .join(F.broadcast(sample), "k")
    words = rows.select("toxic", "quality", F.explode(F.array_distinct(_words(F.col("body")))).alias("w"))
    n = words.groupBy(_bucket(F.col("w"), buckets).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"), F.sum("quality").alias("q"))
    counts = {r["b"]: (r["n"], r["t"], r["q"]) for r in n.collect()}   # at most `buckets` rows
    total = [sum(c[i] for c in counts.values()) for i in range(3)]
    def weights(i: int) -> str:
        out = []
        for b in range(buckets):
            c = counts.get(b, (0, 0, 0))
            back = PRIOR_WORDS * c[0] / max(total[0], 1)
            share = total[i] / max(total[0], 1)
            if abs(c[i] - c[0] * share) < LEAST_Z * math.sqrt(c[0] * share * (1 - share) + 1):
                out.append("0")
                continue
            yes = (c[i] + back) / (total[i] + PRIOR_WORDS)
            no = (c[0] - c[i] + back) / (total[0] - total[i] + PRIOR_WORDS)
            out.append(f"{math.log(yes / no):.6f}" if yes > 0 and no > 0 else "0")
        return ",".join(out)

    wt, wq = weights(1), weights(2)
    # calibration: sums in steps of a quarter, at most 481 bins a factor
    sums = rows.select("toxic", "quality", _scores(F.col("body"), wt, wq, buckets).alias("s"))
    lines = []
    for factor, name in (("t", "toxic"), ("q", "quality")):
        bins = sums.groupBy((F.round(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("s")[factor])) * 4)
                             / 4).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(name).alias("y"))
        lines.append(_logistic([(r["x"], r["n"], r["y"]) for r in bins.collect()]))
    return Classifier(wt, wq, lines[0], lines[1], buckets)


def _logistic(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic fit (Newton steps, slight ridge)."""
    a, b = 0.0, 0.0
    for _ in range(50):
        ga, gb, haa, hab, hbb = 0.01 * (a - 1), 0.01 * b, 0.01, 0.0, 0.01
        for x, n, y in bins:
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, a * x + b))))
            ga, gb = ga + (n * p - y) * x, gb + n * p - y
            w = n * p * (1 - p)
            haa, hab, hbb = haa + w * x * x, hab + w * x, hbb + w
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db) / 2)
        a, b = a - da / size, b - db / size
    return a, b


def _scores(text: Column, toxic: str, quality: str, buckets: int) -> Column:
    """Struct ``n, t, q``: words, and the sums of the distinct words' log odds."""
    table_ = lambda s: F.split(F.lit(s), ",").cast("array<double>")  # noqa: E731  folded to a constant
    wt, wq = table_(toxic), table_(quality)
    tells = ",".join(str(int((a, b) != ("0", "0"))) for a, b in zip(toxic.split(","), quality.split(",")))
    tells = F.split(F.lit(tells), ",").cast("array<int>")
    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("q"))
    at = lambda w: _bucket(w, buckets) + 1

    def add(acc: Column, w: Column) -> Column:
        return F.struct((acc["t"] + F.element_at(wt, at(w))).alias("t"),
                        (acc["q"] + F.element_at(wq, at(w))).alias("q"))

    def of(words: Column) -> Column:
        # most words tell nothing and leave before the sums
        telling = F.array_distinct(F.filter(words, lambda w: F.element_at(tells, at(w)) == 1))
        return F.aggregate(telling, zero, add, lambda a: F.struct(
            F.size(words).cast("long").alias("n"), a["t"].alias("t"), a["q"].alias("q")))

    # a one-element array binds the words, so that they are cut once
    return F.transform(F.array(_words(text)), of)[0]


def membership(text: Column, c: Classifier) -> Column:
    """Struct ``n, good, plain, toxic`` of a text: words and domain posteriors."""
    def prob(s: Column, line: tuple[float, float]) -> Column:
        z = F.lit(line[0]) * s + F.lit(line[1])
        return 1.0 / (1.0 + F.exp(-F.least(F.lit(60.0), F.greatest(F.lit(-60.0), z))))

    def of(s: Column) -> Column:
        t, q = prob(s["t"], c.line_toxic), prob(s["q"], c.line_quality)
        return F.struct(s["n"].alias("n"), ((1 - t) * q).alias("good"), ((1 - t) * (1 - q)).alias("plain"),
                        t.alias("toxic"))

    return F.transform(F.array(_scores(text, c.toxic, c.quality, c.buckets)), of)[0]


def least_rate(p: list[Column], keep: float | None) -> Column:
    if keep is None:
        return F.lit(0.0)
    return F.when(p[DOMAINS.index("toxic")] < keep, F.lit(1.0)).otherwise(F.lit(0.0))


def replay(steps, p: list[Column], start: Column | None = None, keep: float | None = None) -> Column:
    """The projected path of a rate: each step subtracts and clips at the least rate."""
    start = F.lit(1.0) if start is None else start
    if not steps:
        return start
    path = F.split(F.lit(";".join(",".join(repr(x) for x in s) for s in steps)), ";")
    path = F.transform(path, lambda s: F.split(s, ",").cast("array<double>"))

    def step(r: Column, s: Column) -> Column:
        move = s[0] * p[0]
        for k in range(1, len(p)):
            move = move + s[k] * p[k]
        return F.greatest(least_rate(p, keep), r - move)

    return F.aggregate(path, start, step)


def fit_rates(members: DataFrame, targets: dict[str, float], tolerance: float = 1e-3,
              max_steps: int = 100, restage: int = 16, keep: float | None = None) -> Fit:
    """Projected gradient over ``(n, good, plain, toxic)`` rows; ``targets`` are token
    totals per domain.  Raises when ``max_steps`` pass without settling."""
    now = members.select("n", *DOMAINS)
    size = len(DOMAINS)
    gram = now.agg(*[F.coalesce(F.sum(F.col("n") * F.col(DOMAINS[a]) * F.col(DOMAINS[b])), F.lit(0.0))
                     for a in range(size) for b in range(size)]).first()
    g = [[gram[a * size + b] for b in range(size)] for a in range(size)]
    goal = [float(targets[d]) for d in DOMAINS]
    rates = [F.col(d) for d in DOMAINS]

    def inverse(m) -> list[list[float]]:
        ridge = 1e-7 * max(max(m[k][k] for k in range(size)), 1e-12)
        return _inverse([[m[a][b] + (ridge if a == b else 0.0) for b in range(size)] for a in range(size)])

    def times(m, v) -> list[float]:
        return [sum(m[a][b] * v[b] for b in range(size)) for a in range(size)]

    def look(current, path):
        """Totals, and the Gram matrix of the rows whose rate is above the least."""
        live = [F.when(F.col("now") > least_rate(rates, keep), F.col("n") * F.col(DOMAINS[a]) * F.col(DOMAINS[b])).otherwise(0.0)
                for a in range(size) for b in range(a, size)]
        got = current.withColumn("now", replay(path, rates, F.col("r"), keep)).agg(
            *[F.coalesce(F.sum(F.col("n") * F.col("now") * F.col(d)), F.lit(0.0)) for d in DOMAINS],
            *[F.coalesce(F.sum(x), F.lit(0.0)) for x in live]).first()
        m, at = [[0.0] * size for _ in range(size)], size
        for a in range(size):
            for b in range(a, size):
                m[a][b] = m[b][a] = got[at]
                at += 1
        return list(got[:size]), m

    weight = inverse(g)
    current = now.withColumn("r", F.lit(1.0))
    steps, recent = [], []
    totals, live = look(current, recent)
    bold = True
    for _ in range(max_steps):
        miss = [totals[k] - goal[k] for k in range(size)]
        worst = max(abs(miss[k]) / max(goal[k], 1e-12) for k in range(size))
        if worst <= tolerance:
            break
        # the metric of the live rows is the longer step; where it does not descend,
        # the metric of all rows always does
        step = tuple(times(inverse(live) if bold else weight, miss))
        new, new_live = look(current, [*recent, step])
        after = [new[k] - goal[k] for k in range(size)]
        down = sum(x * y for x, y in zip(after, times(weight, after)))
        before = sum(x * y for x, y in zip(miss, times(weight, miss)))
        if bold and down > 0.9 * before:
            bold = False
            continue
        if down > (1 - 1e-4) * before:   # the least-squares optimum
            break
        steps.append(step)
        recent.append(step)
        totals, live, bold = new, new_live, True
        if len(recent) == restage:
            current = staged(current.select("n", *DOMAINS, replay(recent, rates, F.col("r"), keep).alias("r")),
                             "mix-rates")
            recent = []
    else:
        warnings.warn(f"rates did not settle in {max_steps} steps: misfit {worst:.3g}", stacklevel=2)
    return Fit(tuple(steps), dict(zip(DOMAINS, totals)), dict(zip(DOMAINS, goal)), worst, keep)


def _inverse(m: list[list[float]]) -> list[list[float]]:
    """Inverse of a small positive definite matrix (Gauss-Jordan)."""
    n = len(m)
    rows = [[*m[i], *(float(i == j) for j in range(n))] for i in range(n)]
    for c in range(n):
        best = max(range(c, n), key=lambda r: abs(rows[r][c]))
        rows[c], rows[best] = rows[best], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n):
            if r != c:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    return [r[n:] for r in rows]


def fit_mixture(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None,
                multiples: dict[str, float] | None = None, key: str = "doc_id",
                text: str = "text", sample_rows: int = 20_000,
                keep: float | None = None) -> tuple[Classifier, Fit]:
    """Classifier and rates for target ``shares`` of all tokens, or for ``multiples`` of
    each domain's present expected total."""
    c = fit_classifier(docs, labels, sample_rows, key=key, text=text)
    members = staged(docs.select(membership(F.col(text), c).alias("m")).select("m.*"), "mix-members")
    return c, fit_targets(members, shares, multiples, keep)


def fit_targets(members: DataFrame, shares: dict[str, float] | None = None,
                multiples: dict[str, float] | None = None, keep: float | None = None) -> Fit:
    """Rates over ``(n, good, plain, toxic)`` rows for ``shares`` or ``multiples``."""
    sums = members.agg(*[F.coalesce(F.sum(F.col("n") * F.col(d)), F.lit(0.0)) for d in DOMAINS]).first()
    if multiples is not None:
        targets = {d: sums[k] * multiples[d] for k, d in enumerate(DOMAINS)}
    else:
        targets = {d: sum(sums) * (shares or SHARES)[d] for d in DOMAINS}
    fit = fit_rates(members, targets, keep=keep)
    if fit.worst > 0.01:
        warnings.warn(f"targets cannot be met: misfit {fit.worst:.3g}", stacklevel=2)
    return fit


def with_rates(docs: DataFrame, c: Classifier, fit: Fit, text: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with two added columns, the membership struct and the rate; their
    generated names are returned with it."""
    m, r = tmp("member"), tmp("rate")
    out = docs.withColumn(m, membership(F.col(text), c))
    return out.withColumn(r, replay(fit.steps, [F.col(m)[d] for d in DOMAINS], keep=fit.keep)), m, r


def mix(docs: DataFrame, c: Classifier, fit: Fit, key: str = "doc_id", text: str = "text",
        seed: str = "mix") -> DataFrame:
    """Draw the mixture: each row occurs ``floor(rate + u)`` times, ``u`` in [0, 1) being a
    hash of its key, so that the drawn totals are the fitted ones in expectation."""
    rated, _, r = with_rates(docs, c, fit, text)
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))
                                 .cast("binary")), 1, 8), 16, 10).cast("double") / 2 ** 32
    copies = F.floor(F.col(r) + u)
    n = tmp("copy")
    return rated.withColumn(n, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))) \
        .select(*[F.col(f"`{c_}`") for c_ in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    c = fit_classifier(docs, table(spark, sf_dir, "labels"))
    members = staged(docs.select("doc_id", membership(F.col("text"), c).alias("m")).select("doc_id", "m.*"),
                     "mix-members")
    fit = fit_targets(members)
    return members.select("doc_id", F.col("n").alias("n_tokens"),
                          *[F.col(d).alias(f"p_{d}") for d in DOMAINS],
                          replay(fit.steps, [F.col(d) for d in DOMAINS]).alias("rate"))
