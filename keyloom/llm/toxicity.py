"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features: a text's distinct lower-case words (split at the six ASCII separators) without outer
punctuation, and their first four and five bytes; fitting and scoring call the same function. Grades: 0 clean; a row labelled toxic is 1, 2 or 3 by the share of its words that
the labelled rows show to go with toxicity. Proportional odds: P(grade > k) = sigmoid(s - theta_k)
with one weight vector for all thresholds theta_0 < theta_1 < theta_2; the severity given out is the
expected grade, the sum of the three probabilities.

Fit: on the driver, in numpy, from at most ``MOST_TOXIC`` + ``MOST_CLEAN`` labelled rows (the ones
with the smallest hashed ids). Executors count their features; those that differ between toxic and
clean rows by fewer than ``Z_LEAST`` standard errors are left out and at most ``MOST_FEATURES``
stay, so the model is bounded, and only these of each row come to the driver. Scoring: one pass without a shuffle.

Nulls and the like: a null or empty text has no features and is never toxic; labels that are null
are ignored, of several labels of a document the largest counts, of several texts of a labelled id the one with the least hash; with no toxic or no clean label
nothing is called toxic. Repeated rows are scored alike. Extra columns are kept by ``score``.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import ship, stash, table

MOST_TOXIC, MOST_CLEAN = 4000, 8000
MOST_FEATURES, Z_LEAST = 20_000, 3.5
PREFIXES = (4, 5)
OUTER = string.punctuation.encode()
#: Shares of indicative words from which a toxic row is grade 2 and 3.
GRADE_SHARES = (0.02, 0.05)
STEPS, RATE, RIDGE = 300, 0.1, 1e-3


class Model:
    """Weights by feature, three thresholds, and the score from which a text is toxic."""

    def __init__(self, weights: dict[bytes, float], theta: np.ndarray):
        self.weights, self.theta = weights, theta

    def raw(self, text: str | None) -> float:
        get = self.weights.get
        return math.fsum(v for f in features(words(text)) if (v := get(f)) is not None)

    def above(self, s: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, 2."""
        return _sigmoid(np.asarray(s)[:, None] - self.theta[None])


def words(text: str | None) -> set[bytes]:
    """Distinct words without outer punctuation."""
    return {w for x in set((text or "").lower().encode("utf-8", "surrogatepass").split()) if (w := x.strip(OUTER))}


def features(words_: set[bytes]) -> set[bytes]:
    """Words and their beginnings; a word has no ``*`` at its end."""
    return words_.union(*({w[:k] + b"*" for w in words_ if len(w) >= k} for k in PREFIXES))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most MOST_TOXIC + MOST_CLEAN labelled rows: doc_id, toxic, size (distinct words), f (features)."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    one = one.withColumn("h", F.xxhash64("doc_id"))
    pick = [one.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(n) for k, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    chosen = F.broadcast(pick[0].unionByName(pick[1]).select("doc_id", "toxic"))  # bounded by the two limits
    rows = docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches):
        for b in batches:
            seen = [words(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "toxic": b.column(1), "size": pa.array(map(len, seen), pa.int32()), "f": pa.array([sorted(features(w)) for w in seen], pa.list_(pa.binary()))})

    return stash(rows.select(F.col("doc_id").cast("bigint"), "toxic", "text").mapInArrow(run, "doc_id bigint, toxic int, size int, f array<binary>"), "labelled")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Features are counted and chosen on executors; rows' chosen features come to the driver."""
    ship(docs.sparkSession)
    rows = sample(docs, labels)
    got = rows.select("doc_id", "toxic", "size").orderBy("doc_id").toArrow()
    names_, y = got["doc_id"].to_numpy(), got["toxic"].to_numpy().astype(np.int64)
    n_toxic, n = int(y.sum()), len(y)
    none = Model({}, np.array([30.0, 31.0, 32.0]))
    if not 0 < n_toxic < n:
        return none
    each = rows.select("doc_id", "toxic", F.explode("f").alias("f"))
    t, p = F.sum("toxic"), F.count("*") / n
    gap = F.abs(t / n_toxic - (F.count("*") - t) / (n - n_toxic))
    error = F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n_toxic + 1 / (n - n_toxic)))
    z = each.groupBy("f").agg(F.count("*").alias("n"), (gap / error).alias("z")).where((F.col("n") >= 3) & (F.col("z") >= Z_LEAST))
    chosen = [bytes(r.f) for r in z.orderBy(F.col("z").desc(), "f").limit(MOST_FEATURES).collect()]
    if not chosen:
        return none
    table_ = docs.sparkSession.createDataFrame(list(enumerate(chosen)), "i int, f binary")
    pairs = each.select("doc_id", "f").join(F.broadcast(table_), "f").select("doc_id", "i").toArrow()
    f, d = pairs["i"].to_numpy().astype(np.int64), np.searchsorted(names_, pairs["doc_id"].to_numpy())
    order = np.lexsort((f, d))  # sums don't depend on which task was first
    f, d = f[order], d[order]
    grade = _grades(f, d, y, np.maximum(got["size"].to_numpy(), 1), len(chosen))
    w, theta = _descend(f, d, grade, len(chosen))
    return Model(dict(zip(chosen, w.tolist(), strict=True)), theta)


def _grades(f: np.ndarray, d: np.ndarray, y: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    t = np.bincount(f, weights=y[d], minlength=n)
    c = np.bincount(f, minlength=n) - t
    odds = (t + 0.5) / (c + 0.5) * (len(y) - y.sum()) / y.sum()
    share = np.bincount(d, weights=odds[f] >= 8, minlength=len(y)) / size
    return y * (1 + (share >= GRADE_SHARES[0]) + (share >= GRADE_SHARES[1]))


def _descend(f: np.ndarray, d: np.ndarray, grade: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the mean negative log likelihood of the grades plus a ridge; thresholds as a first value and positive steps."""
    rows = len(grade)
    x = np.concatenate([np.zeros(n), [1.0, 0.0, 0.0]])
    m, v = np.zeros_like(x), np.zeros_like(x)
    up, low = np.minimum(grade, 2), np.maximum(grade - 1, 0)
    for step in range(1, STEPS + 1):
        w, a = x[:n], x[n:]
        gaps = np.exp(a[1:])
        theta = a[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(d, weights=w[f], minlength=rows)
        hi = np.where(grade < 3, _sigmoid(theta[up] - s), 1.0)  # P(grade <= g)
        lo = np.where(grade > 0, _sigmoid(theta[low] - s), 0.0)  # P(grade <= g - 1)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_s = (dhi - dlo) / rows  # of the loss by the score
        g_theta = np.bincount(up, weights=-dhi * (grade < 3), minlength=3) + np.bincount(low, weights=dlo * (grade > 0), minlength=3)
        g_theta /= rows
        g = np.concatenate([np.bincount(f, weights=g_s[d], minlength=n) + RIDGE * w, [g_theta.sum(), g_theta[1:].sum() * gaps[0], g_theta[2] * gaps[1]]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    a = x[n:]
    return x[:n], a[0] + np.concatenate([[0.0], np.cumsum(np.exp(a[1:]))])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with _severity (0 to 3), _p_toxic and _toxic beside its own columns."""
    ship(docs.sparkSession)
    at = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_FEATURES
    index = docs.columns.index(text)

    def run(batches):
        model = at.value
        for b in batches:
            seen: dict[str, float] = {}
            s = []
            for x in b.column(index).to_pylist():
                if x not in seen:
                    seen[x] = model.raw(x)
                s.append(seen[x])
            above = model.above(np.array(s, dtype=float).reshape(-1))
            for name, x in (("_severity", above.sum(1)), ("_p_toxic", above[:, 0]), ("_toxic", above[:, 0] >= 0.5)):
                b = b.append_column(name, pa.array(x))
            yield b

    # extra fields come last; any of the same names would clash
    docs = docs.drop(*[c for c in ("_severity", "_p_toxic", "_toxic") if c in docs.columns])
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kind}, _severity double, _p_toxic double, _toxic boolean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", F.col("_severity").alias("severity"), F.col("_p_toxic").alias("p_toxic"), F.col("_toxic").alias("toxic"))
