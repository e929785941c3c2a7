"""Mixing by soft membership: document rates whose expected domain totals meet targets.

A softmax classifier over hashed words, fitted on a bounded sample of the labelled
documents, gives every document posteriors p over the domains. With n tokens and rate
x, a document is expected to add x * n * p[k] tokens to domain k. The rates minimise the
squared distance of these totals to the targets, subject to x >= 0, by accelerated
projected gradient from x = 1, until the totals
are within TOLERANCE or a step changes less than STILL. Residuals count in units of the domain's present share,
so a rare domain is fitted as well as a common one and a step of 1 is safe. The gradient
of one document is p . c, where c is the residual vector of the whole corpus; so a step is one aggregation of a few numbers in
Spark, and the rate of a document is a fold of its posteriors over the short list of
residuals. No rate is stored or shuffled between steps.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from fieldloom.llm.common import CHUNK, free_name, mix64, slices, span_hashes, text, utf8, word_spans
from fieldloom.session import materialize

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.94, "low": 0.04, "toxic": 0.02}
"""Share of all tokens that each domain is to have."""
TRAIN_ROWS = 2000
"""Labelled documents per domain that the classifier is fitted on (those of smallest hash)."""
BUCKETS = 1 << 16
MIN_DOCS = 10
"""Training documents that a bucket must occur in to have weights."""
EPOCHS = 150
TOLERANCE = 1e-4
"""Shares of the present tokens that totals may be off."""
STILL = 1e-6
"""Mean change of the rates under a projected-gradient step that counts as none: the totals are then
as near to the targets as they get, which is reported."""

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(_LOWER.astype(np.uint64) + np.uint64(1))
MEMBERS = StructType([StructField("n_tokens", LongType()), StructField("p", ArrayType(DoubleType()))])


def default_domain(labels: DataFrame) -> Column:
    """Domain of a row of labels (quality, toxic); null where neither says anything."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


class _Hashed:
    def __init__(self, b: np.ndarray):
        self.b = b

    def __getitem__(self, part: slice) -> np.ndarray:
        return _BYTE[self.b[part]]


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word; a word that repeats the one before also hits bucket 0."""
    b, at = raw[at[0] : at[-1]], at - at[0]
    starts, ends, row = word_spans(b, at)
    h = span_hashes(_Hashed(b), starts, ends)
    bucket = (h % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) + 1
    return np.concatenate([row, row[again]]), np.concatenate([bucket, np.zeros(len(again), np.int64)])


def _rows(batches):
    """Training rows as (domain, bucket, share)."""
    for batch in batches:
        raw, at, _ = utf8(batch.column(1))
        for i in range(len(at) - 1):
            _, bucket = features(raw, at[i : i + 2])
            kinds, n = np.unique(bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[i : i + 1],
                    pa.array([kinds.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([n / max(1, n.sum()) ** 0.5], pa.list_(pa.float64())),
                ],
                names=["domain", "bucket", "share"],
            )


def fit(domain: np.ndarray, bucket: np.ndarray, share: np.ndarray, at: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Weights (BUCKETS + 1, k) of a softmax over word weights; the last row is the bias.

    ``share`` is a bucket's count over the root of the document's words, so that a few
    telling words count in a long text too. ``prior`` are the domains' shares among all labels.
    """
    rows, k = len(at) - 1, len(prior)
    weights = np.zeros((BUCKETS + 1, k))
    if not rows:
        return weights
    row = np.repeat(np.arange(rows), np.diff(at))
    often = np.bincount(bucket, minlength=BUCKETS)[bucket] >= MIN_DOCS
    row, bucket, share = row[often], bucket[often], share[often]
    used, column = np.unique(bucket, return_inverse=True)
    w, bias = np.zeros((len(used), k)), np.zeros(k)
    seen_w, seen_b = np.full(w.shape, 1e-8), np.full(k, 1e-8)
    truth = np.eye(k)[domain]
    for _ in range(EPOCHS):
        z = np.stack([np.bincount(row, share * w[column, j], rows) for j in range(k)], axis=1) + bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - truth) / rows
        for j in range(k):
            d = np.bincount(column, share * g[row, j], len(used)) + 1e-6 * w[:, j]
            seen_w[:, j] += d * d
            w[:, j] -= 3.0 * d / np.sqrt(seen_w[:, j])
        d = g.sum(axis=0)
        seen_b += d * d
        bias -= 0.5 * d / np.sqrt(seen_b)
    weights[used] = w
    # the sample holds rare domains more often than the labels do
    weights[-1] = bias + np.log(np.maximum(prior, 1e-6)) - np.log(np.maximum(truth.mean(axis=0), 1e-6))
    return weights


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, domain: Column, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Classifier weights. The sample is taken among labelled ids that ``docs`` holds; an id
    labelled twice takes the domain that comes last in DOMAINS, one of several texts the least."""
    order = F.array_position(F.array(*[F.lit(d) for d in DOMAINS]), F.col("domain"))
    named = labels.select(F.col(id_col).alias("id"), domain.alias("domain")).where(
        F.col("domain").isin(*DOMAINS) & F.col("id").isNotNull()
    )
    named = named.groupBy("id").agg(F.max(order).alias("domain"))
    here = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    named = materialize(named.join(here, "id", "left_semi"), "mixing-labels")
    share = {r["domain"]: r["count"] for r in named.groupBy("domain").count().collect()}
    prior = np.array([share.get(k, 0) for k in range(1, len(DOMAINS) + 1)], float)
    sample = None
    for k in range(1, len(DOMAINS) + 1):
        part = named.where(F.col("domain") == k).orderBy(F.xxhash64("id"), "id").limit(rows)
        sample = part if sample is None else sample.unionByName(part)
    sample = materialize(sample, "mixing-sample")  # at most rows * len(DOMAINS) ids
    got = (
        docs.select(F.col(id_col).alias("id"), F.coalesce(text(text_col), F.lit("")).alias("t"))
        .join(F.broadcast(sample), "id")
        .groupBy("id", "domain")
        .agg(F.min("t").alias("t"))
        .orderBy("id")
        .select((F.col("domain") - 1).cast("int").alias("domain"), "t")
        .mapInArrow(_rows, "domain int, bucket array<int>, share array<double>")
        .toArrow()
        .combine_chunks()
    )
    sizes = np.asarray(pa.compute.list_value_length(got["bucket"])).astype(np.int64)
    return fit(
        np.asarray(got["domain"]).astype(np.int64),
        np.asarray(pa.compute.list_flatten(got["bucket"])).astype(np.int64),
        np.asarray(pa.compute.list_flatten(got["share"])),
        np.concatenate([[0], np.cumsum(sizes)]),
        prior / max(prior.sum(), 1),
    )


def memberships(weights: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, posteriors) per text; a text without words has the domains' priors."""
    raw, at, _ = utf8(texts)
    n, k = len(texts), weights.shape[1]
    tokens, z = np.zeros(n, np.int64), np.zeros((n, k))
    for lo, hi in slices(at, CHUNK * 2):
        row, bucket = features(raw, at[lo : hi + 1])
        hits = np.bincount(row, minlength=hi - lo)
        tokens[lo:hi] = hits - np.bincount(row[bucket == 0], minlength=hi - lo)
        for j in range(k):
            z[lo:hi, j] = np.bincount(row, weights[bucket, j], hi - lo) / np.sqrt(np.maximum(hits, 1))
    z += weights[-1]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return tokens, e / e.sum(axis=1, keepdims=True)


def _fold(p: np.ndarray, history: np.ndarray, most: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rate, extrapolated rate, change by the last step) after the recorded steps; each is a row (momentum, c...)."""
    x = y = np.ones(len(p))
    change = np.full(len(p), np.inf)
    for momentum, *c in history:
        new = np.clip(y - p @ np.array(c), 0.0, most)
        change = np.abs(new - y)
        x, y = new, new + momentum * (new - x)
    return x, y, change


def fold_rates(p: np.ndarray, history: np.ndarray, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(rate, extrapolated rate) after the recorded steps."""
    return _fold(p, history, most)[:2]


def solve(members: DataFrame, targets: dict[str, float], steps: int | None = None, most: float = np.inf) -> np.ndarray:
    """History of projected-gradient steps for (n_tokens, p) rows; as many as it takes unless ``steps`` is given."""
    return solved(members, targets, steps, most)[0]


def solved(members: DataFrame, targets: dict[str, float], steps: int | None = None, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(history, residual per domain): shares of the present tokens by which the totals still miss."""
    spark = members.sparkSession
    k = len(DOMAINS)
    goal = np.array([targets[d] for d in DOMAINS]) / sum(targets.values())
    n, p = F.col("n_tokens").cast("double"), F.col("p")
    now = members.agg(F.sum(n).alias("m"), *[F.sum(n * p[j]).alias(f"s{j}") for j in range(k)]).first()
    if not now["m"]:
        return np.zeros((0, k + 1)), np.zeros(k)
    share = np.array([now[f"s{j}"] for j in range(k)]) / now["m"]
    # in these units the Hessian is a row-stochastic matrix, whose largest eigenvalue is 1
    step = 1.0 / np.maximum(share, 1e-12)
    history, t = np.zeros((0, k + 1)), 1.0
    ahead_type = StructType([StructField("x", DoubleType()), StructField("y", DoubleType()), StructField("change", DoubleType())])
    while True:
        held = spark.sparkContext.broadcast(history)

        @F.arrow_udf(ahead_type)
        def ahead(ps: pa.Array) -> pa.Array:
            folded = _fold(np.asarray(ps.flatten()).reshape(-1, k), held.value, most)
            return pa.StructArray.from_arrays([pa.array(v) for v in folded], names=ahead_type.names)

        a = members.select("n_tokens", "p", ahead("p").alias("a"))
        sums = a.agg(
            *[F.sum(n * p[j] * F.col("a.x")).alias(f"x{j}") for j in range(k)],
            *[F.sum(n * p[j] * F.col("a.y")).alias(f"y{j}") for j in range(k)],
            F.sum(n * F.col("a.change")).alias("change"),
        ).first()
        residual = np.array([sums[f"x{j}"] for j in range(k)]) / now["m"] - goal
        held.unpersist()
        met = np.abs(residual).max() < TOLERANCE
        if met or sums["change"] / now["m"] < STILL or len(history) == steps:
            break
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_by = np.array([sums[f"y{j}"] for j in range(k)]) / now["m"] - goal
        history = np.vstack([history, [(t - 1) / after, *(step * ahead_by)]])
        t = after
    if not met:
        off = ", ".join(f"{d} {r:+.4f}" for d, r in zip(DOMAINS, residual))
        warnings.warn(f"totals miss the targets after {len(history)} steps, in shares of the tokens: {off}", stacklevel=2)
    return history, residual


class Mix:
    """A fitted mix: columns for tokens, posteriors and rate of any text, and the residual of
    the totals. No rate is above ``most``; none is bounded unless it is given."""

    def __init__(
        self, docs: DataFrame, labels: DataFrame, targets=TARGETS, id_col="doc_id", text_col="text",
        domain: Column | None = None, most: float = np.inf,
    ):
        spark = docs.sparkSession
        weights = train(docs, labels, id_col, text_col, default_domain(labels) if domain is None else domain)
        held = spark.sparkContext.broadcast(weights)

        @F.arrow_udf(MEMBERS)
        def member(texts: pa.Array) -> pa.Array:
            tokens, p = memberships(held.value, texts)
            at = pa.array((np.arange(len(p) + 1) * p.shape[1]).astype(np.int32))
            return pa.StructArray.from_arrays(
                [pa.array(tokens), pa.ListArray.from_arrays(at, pa.array(p.ravel()))], names=MEMBERS.names
            )

        self.member = lambda col: member(text(col))
        rows = docs.select(F.col(id_col).alias("id"), self.member(text_col).alias("m")).select("id", "m.*")
        self.members = materialize(rows, "mixing-members")
        self.history, self.residual = solved(self.members, targets, most=most)
        steps = spark.sparkContext.broadcast(self.history)

        @F.arrow_udf(DoubleType())
        def rate(ps: pa.Array) -> pa.Array:
            return pa.array(fold_rates(np.asarray(ps.flatten()).reshape(-1, len(DOMAINS)), steps.value, most)[0])

        @F.arrow_udf(DoubleType())
        def text_rate(texts: pa.Array) -> pa.Array:
            return pa.array(fold_rates(memberships(held.value, texts)[1], steps.value, most)[0])

        self.rate, self.text_rate = rate, lambda col: text_rate(text(col))


def copies(rate: Column, key: Column, seed: int = 6) -> Column:
    """Whole copies of a row: the rate rounded up or down by a hash of its key, so that the
    expected number is the rate and a rerun gives the same."""
    u = F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return F.floor(rate + u).cast("int")


def rates(docs: DataFrame, labels: DataFrame, targets=TARGETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, p_<domain>..., rate, copies): one row per row of ``docs``.

    Tokens are words. Null, empty and blank texts have no tokens and prior posteriors, and
    do not move the totals. Without any usable label all posteriors are equal. Repeated rows
    count once each; a null id is kept. Other columns are ignored.
    """
    mix = Mix(docs, labels, targets, id_col, text_col)
    got = mix.members.select(F.col("id"), "n_tokens", "p", mix.rate("p").alias("rate"))
    return got.select(
        F.col("id").alias(id_col),
        "n_tokens",
        *[F.col("p")[j].alias(f"p_{d}") for j, d in enumerate(DOMAINS)],
        "rate",
        copies(F.col("rate"), F.col("id")).alias("copies"),
    )


def resample(docs: DataFrame, labels: DataFrame, targets=TARGETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its rate says (maybe not at all)."""
    mix = Mix(docs, labels, targets, id_col, text_col)
    columns = docs.columns
    name = free_name(docs, "copies")
    often = copies(mix.text_rate(text_col), F.col(id_col))
    got = docs.withColumn(name, often).where(F.col(name) > 0)
    return got.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name)))).select(*columns)
