"""LM scoring: a log-bilinear model of word classes, trained in numpy by noise-contrastive estimation.

Counts are of all training tokens. Of the head, the tokens that are at least one in ``HEAD`` of all
(so at most HEAD), in order of frequency the first ``SINGLES`` have a
class each and the rest share ``SHARED`` classes by their last letters; all other tokens, seen or
not, share ``RARES`` classes in the same way. The model gives P(class | two classes before) and a
token's share of its class comes from the counts, (c + 0.5) / sum, with one more 0.5 in each rare
class for what was never seen, so token probabilities sum to one.

The class model has vectors r, bias b and position matrices: the prediction from (u, v) scores class
w as (r_u A + r_v B) . r_w + b_w. As that is bilinear, all scores are two class-by-class tables, and
the normalisers of all pairs (u, v) come from batched matrix products; a token costs three look-ups.
Training goes over all positions in ``ROUNDS`` rounds: the corpus is dealt by a hash of id and text
into splits of about ``SPLIT`` tokens, each split runs noise-contrastive steps from the common state,
and states are averaged, as exact sums, before the next round. So the model doesn't depend on how the
input is partitioned.

Tokens outside the head need their counts: (token, document) rows of those alone meet the counts in
a shuffle. None is one in HEAD of all tokens, so no key is hot.

Nulls and the like: a null text is empty, its one token is the end; a null id counts as training;
documents of one id and text are told apart by nothing and scored alike. With no training documents
N is 0 and all tokens are unknown. Extra columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import discard, ship, stash, table
from keyloom.llm.language import held_out

HEAD, SINGLES, SHARED, RARES = 500_000, 1024, 160, 64
RARE, BEFORE = SINGLES + SHARED, SINGLES + SHARED + RARES  # the first rare class; what stands before a text
CLASSES = BEFORE + 1
DIM, NOISE, DRAWS, BATCH, RATE, FIRST_GRADIENT = 16, 16, 64, 1024, 0.15, 1e-4
#: Training tokens of a split, rounds, and how states are summed: in units of 1 / UNIT, in so many rows.
SPLIT, ROUNDS, UNIT, BLOCKS = 1 << 20, 4, 1 << 24, 64
#: The end token; no word has white space.
END = b"\n"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_EMIT = 400_000


def tokens(text: str | None) -> list[bytes]:
    """Bytes split at exactly the six separators; then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(), END]


def ending(token: bytes, n: int) -> int:
    """A class by the last letters, without outer punctuation."""
    return xxhash.xxh32_intdigest(token.rstrip(b".,;:!?*#$%&|")[-3:]) % n


def token_counts(docs: DataFrame) -> DataFrame:
    """token, rare (its class if it isn't in the head), c over all given documents; counted in each task first."""
    ship(docs.sparkSession)

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_pydict({"token": pa.array(list(seen.keys()), pa.binary()), "n": pa.array(list(seen.values()), pa.int64()), "rare": pa.array([ending(t, RARES) for t in seen], pa.int32())})

        for b in batches:
            for x in b.column(0).to_pylist():
                seen.update(tokens(x))
            if len(seen) >= _EMIT:
                yield out()
                seen.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "token binary, n bigint, rare int").groupBy("token", "rare").agg(F.sum("n").alias("c"))


class Head:
    """Counts and classes of the most frequent tokens; bounded by HEAD."""

    def __init__(self, rows: list[tuple[bytes, int]], n: int, v: int, rare: dict[int, tuple[int, int]]):
        """rows: tokens and counts, most frequent first; rare: class -> sum of counts, tokens."""
        self.n, self.v = n, v
        self.of: dict[bytes, int] = {t: i for i, (t, _) in enumerate(rows)}
        self.count = np.array([c for _, c in rows], np.float64)
        self.kind = np.array([i if i < SINGLES else SINGLES + ending(t, SHARED) for i, (t, _) in enumerate(rows)], np.int64)
        mass = np.bincount(self.kind, weights=self.count + 0.5, minlength=CLASSES) if rows else np.zeros(CLASSES)
        for k in range(RARES):
            c, m = rare.get(k, (0, 0))
            mass[RARE + k] = c + 0.5 * (m + 1)
        #: log10 of a head token's share of its class, and of each rare class's mass
        self.share = np.log10((self.count + 0.5) / mass[self.kind]) if rows else np.zeros(0)
        self.rare_mass = np.log10(mass[RARE : RARE + RARES])
        self.prior = np.maximum(mass, 1e-3) / np.maximum(mass, 1e-3).sum()  # of classes; BEFORE is never predicted
        self.prior[BEFORE] = 0
        self.prior /= self.prior.sum()

    def indexes(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        """Head index of each token, -1 outside, and the tokens."""
        words = tokens(text)
        get = self.of.get
        return np.array([get(w, -1) for w in words], np.int64), words

    def classes(self, index: np.ndarray, words: list[bytes]) -> np.ndarray:
        out = self.kind[index] if len(self.kind) else np.zeros(len(index), np.int64)
        for i in np.flatnonzero(index < 0).tolist():
            out[i] = RARE + ending(words[i], RARES)
        return out


def start(head: Head) -> list[np.ndarray]:
    """The common start: small vectors, matrices near one half, bias as the class frequencies; then the sum of squared gradients of each."""
    rng = np.random.default_rng(11)
    r = rng.normal(0, 0.15, (CLASSES, DIM)).astype(np.float32)
    a, b = (np.eye(DIM, dtype=np.float32) * 0.5 for _ in range(2))
    bias = np.log(np.maximum(head.prior, 1e-12)).astype(np.float32)
    return [r, a, b, bias, *[np.full_like(x, FIRST_GRADIENT) for x in (r, a, b, bias)]]


def train(rows: np.ndarray, state: list[np.ndarray], head: Head, seed: int) -> list[np.ndarray]:
    """Noise-contrastive steps over all (u, v, w) rows in an order drawn by seed, from a state on -> the state after."""
    r, a, b, bias, *grad2 = (x.copy() for x in state)
    log_noise = np.log(np.maximum(head.prior, 1e-12) * NOISE).astype(np.float32)
    cum = np.cumsum(head.prior)
    rng = np.random.default_rng(seed)
    rows = rows[rng.permutation(len(rows))]

    def move(i: int, x: np.ndarray, g: np.ndarray) -> None:
        grad2[i] += g * g
        x -= np.float32(RATE) * g / np.sqrt(grad2[i])

    for at in range(0, len(rows), BATCH):
        u, v, w = rows[at : at + BATCH].T
        n = len(u)
        k = np.minimum(np.searchsorted(cum, rng.random(DRAWS)), BEFORE - 1).astype(np.int16)  # noise that the batch shares
        ru, rv, rw, rk = r[u], r[v], r[w], r[k]
        q = ru @ a + rv @ b
        # data: one each; noise: weighted so that it stands for NOISE draws a position
        e = -1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", q, rw) + (bias - log_noise)[w], -30, 30)))  # sigmoid - 1
        en = q @ rk.T
        en += (bias - log_noise)[k]
        np.clip(en, -30, 30, out=en)
        np.negative(en, out=en)
        np.exp(en, out=en)
        en += 1
        np.divide(np.float32(NOISE / DRAWS), en, out=en)
        gq = e[:, None] * rw + en @ rk
        gr = _summed(np.concatenate([w, k, u, v]), np.concatenate([e[:, None] * q, en.T @ q, gq @ a.T, gq @ b.T]))
        gb = np.bincount(w, e, CLASSES) + np.bincount(k, en.sum(0), CLASSES)
        scale = np.float32(1 / n)
        move(0, r, gr * scale)
        move(1, a, ru.T @ gq * scale)
        move(2, b, rv.T @ gq * scale)
        move(3, bias, (gb / n).astype(np.float32))
    return [r, a, b, bias, *grad2]


def _summed(index: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows added up by class."""
    order = np.argsort(index, kind="stable")  # 16 bits: a radix sort
    index = index[order]
    first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    out = np.zeros((CLASSES, rows.shape[1]), rows.dtype)
    out[index[first]] = np.add.reduceat(rows[order], first)
    return out


class Tables:
    """log10 P(w | u, v) as first[u, w] + second[v, w] + bias[w] - norm[u, v]."""

    def __init__(self, r: np.ndarray, a: np.ndarray, b: np.ndarray, bias: np.ndarray):
        keep = np.arange(CLASSES) != BEFORE
        self.first = ((r @ a) @ r.T).astype(np.float32)
        self.second = ((r @ b) @ r.T + bias[None]).astype(np.float32)
        self.norm = np.empty((CLASSES, CLASSES), np.float32)
        second = np.exp(np.clip(self.second[:, keep].astype(np.float64), -80, 80))
        for u in range(0, CLASSES, 64):  # exp of a sum is a product, so the sums over w are one matrix product
            first = np.exp(np.clip(self.first[u : u + 64, keep].astype(np.float64), -80, 80))
            self.norm[u : u + 64] = np.log(np.maximum(first @ second.T, 1e-300))

    def log10(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (np.clip(self.first[u, w], -80, 80) + np.clip(self.second[v, w], -80, 80) - self.norm[u, v]) / np.log(10)


def contexts(kinds: np.ndarray) -> np.ndarray:
    """(u, v, w) of every position of a text."""
    x = np.concatenate([np.array([BEFORE, BEFORE], kinds.dtype), kinds])
    return np.stack([x[:-2], x[1:-1], x[2:]], 1)


def positions(training: DataFrame, head: Head) -> DataFrame:
    """split, round, kinds (16-bit classes, each text's after two BEFORE): all training positions, one row a split and round.

    A split is about SPLIT tokens, so their number grows with the corpus; which one a document is in,
    its round and its place there come from a hash of id and text alone.
    """
    at = training.sparkSession.sparkContext.broadcast(head)
    splits = max(1, -(-head.n // SPLIT))

    def run(batches):
        head = at.value
        for b in batches:
            kinds = [head.classes(*head.indexes(x)).astype("<i2").tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"h": b.column(0), "kinds": pa.array(kinds, pa.binary())})

    def join(batches):
        now, some = None, []
        begin = np.full(2, BEFORE, "<i2").tobytes()

        def out():
            return pa.RecordBatch.from_pydict({"split": pa.array([now[0]], pa.int64()), "round": pa.array([now[1]], pa.int32()), "kinds": pa.array([begin + begin.join(some)], pa.binary())})

        for b in batches:
            for split, turn, kinds in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if (split, turn) != now:
                    if some:
                        yield out()
                    now, some = (split, turn), []
                some.append(kinds)
        if some:
            yield out()

    rows = training.select(F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(run, "h bigint, kinds binary")
    rows = rows.select(F.pmod("h", F.lit(splits)).alias("split"), F.pmod(F.shiftright("h", 40), F.lit(ROUNDS)).cast("int").alias("round"), "h", "kinds")
    dealt = rows.repartition("split").sortWithinPartitions("split", "round", "h", "kinds").select("split", "round", "kinds")
    return stash(dealt.mapInArrow(join, "split bigint, round int, kinds binary"), "lm-positions")


def _packed(state: list[np.ndarray], weight: int) -> np.ndarray:
    """A state as whole numbers times a weight: their sums are exact, so no order matters."""
    return np.concatenate([np.rint(x.ravel().astype(np.float64) * UNIT).astype(np.int64) for x in state]) * weight


def fit(training: DataFrame, head: Head) -> list[np.ndarray]:
    """Rounds of noise-contrastive training: in each, every split goes on from the common state over its positions of that round, and states are averaged.

    What a task sends is the size of the model; the result depends on the corpus, not on its partitions.
    """
    state = start(head)
    if not head.n:
        return state[:4]
    context = training.sparkSession.sparkContext
    rows = positions(training, head)
    for turn in range(ROUNDS):
        at = context.broadcast((state, head.prior))

        def run(batches, at=at):
            state, prior = at.value
            total, weights = None, 0
            for b in batches:
                for split, kinds in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    x = np.frombuffer(kinds.as_buffer(), "<i2")
                    x = np.stack([x[:-2], x[1:-1], x[2:]], 1)
                    x = x[x[:, 2] != BEFORE]
                    weight = -(-len(x) // 1024)
                    after = _packed(train(x, state, Prior(prior), split), weight)
                    total, weights = after if total is None else total + after, weights + weight
            if weights:
                blocks = np.array_split(total, BLOCKS)
                yield pa.RecordBatch.from_pydict({"block": pa.array(range(BLOCKS), pa.int32()), "weight": pa.array([weights] * BLOCKS, pa.int64()), "x": pa.array(blocks, pa.list_(pa.int64()))})

        made = rows.where(F.col("round") == turn).select("split", "kinds").mapInArrow(run, "block int, weight bigint, x array<bigint>")
        got = {r.block: r.x for r in made.groupBy("block").applyInArrow(_total, "block int, x array<double>").collect()}  # the size of the model
        if not got:
            continue
        flat, i = np.concatenate([got[k] for k in range(BLOCKS)]).astype(np.float32), 0
        for j, x in enumerate(state):
            state[j] = flat[i : i + x.size].reshape(x.shape)
            i += x.size
    discard(rows)
    return state[:4]


class Prior:
    """What training needs of a head."""

    def __init__(self, prior: np.ndarray):
        self.prior = prior


def _total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of the packed states by block."""
    weight, x = 0, None
    for b in batches:
        weight += sum(b.column("weight").to_pylist())
        for row in b.column("x"):
            row = row.values.to_numpy()
            x = row.copy() if x is None else x + row
    yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "x": pa.array([x / weight / UNIT], pa.list_(pa.float64()))})


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """docs: doc_id, text -> doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship(spark)
    counts = stash(token_counts(training), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ranked = [(bytes(r.token), r.c) for r in counts.where(F.col("c") * HEAD >= n).select("token", "c").collect()]  # at most HEAD
    ranked.sort(key=lambda r: (-r[1], r[0]))
    tail = counts.where(F.col("c") * HEAD < n)
    rare = {r.rare: (r.c, r.m) for r in tail.groupBy("rare").agg(F.sum("c").alias("c"), F.count("*").alias("m")).collect()}
    head = Head(ranked, n, v, rare)
    tables = Tables(*fit(training.select("doc_id", "text"), head))
    at = spark.sparkContext.broadcast((head, tables))  # bounded by HEAD and CLASSES
    z = float(np.log10(n + 0.5 * (v + 1)))

    def run(batches):
        head, tables = at.value
        known = np.log10(head.count + 0.5)
        for b in batches:
            docs_, heads, rest = [], [], []
            for name, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                index, words = head.indexes(x)
                kinds = head.classes(index, words)
                inside = index[index >= 0]
                model = float(tables.log10(*contexts(kinds).T).sum() + head.share[inside].sum() - head.rare_mass[kinds[index < 0] - RARE].sum())
                others = Counter(w for w, i in zip(words, index.tolist(), strict=True) if i < 0)
                docs_.append((name, len(words), len(inside), float(known[inside].sum()), model, sum(others.values())))
                heads.append(len(others))
                rest += others.items()
            # one row for each document, then one for each of its other tokens
            key = [xxhash.xxh64_intdigest((x or "").encode("utf-8", "surrogatepass")) >> 1 for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([d[0] for d in docs_], pa.int64()), "key": pa.array(key, pa.int64()), "n_tokens": pa.array([d[1] for d in docs_], pa.int64()), "n_head": pa.array([d[2] for d in docs_], pa.int64()), "base": pa.array([d[3] for d in docs_], pa.float64()), "model": pa.array([d[4] for d in docs_], pa.float64()), "n_rest": pa.array([d[5] for d in docs_], pa.int64()),
                "rest": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(heads)]), pa.int32()), pa.StructArray.from_arrays([pa.array([t for t, _ in rest], pa.binary()), pa.array([m for _, m in rest], pa.int32())], ["token", "m"])),
            })

    kind = "doc_id bigint, key bigint, n_tokens bigint, n_head bigint, base double, model double, n_rest bigint, rest array<struct<token binary, m int>>"
    rows = stash(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, kind), "lm-rows")
    # a text's other tokens, once for each text of an id
    texts = rows.select("doc_id", "key", "rest").where("n_rest > 0")
    pairs = texts.select("doc_id", "key", F.explode("rest").alias("t")).select("doc_id", "key", "t.token", "t.m")
    met = pairs.join(tail, "token", "left")
    part = met.groupBy("doc_id", "key").agg(F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rest_sum"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("rest_known"), F.sum("m").alias("m_all"))
    joined = rows.drop("rest").alias("r").join(part.alias("p"), F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("r.key") == F.col("p.key")), "left")
    # repeated rows of one id and text put their tokens in once each
    times = F.coalesce(F.col("n_rest") / F.col("m_all"), F.lit(0.0))
    rest_sum = F.coalesce(F.col("rest_sum") * times, F.lit(0.0))
    return joined.select(
        "r.doc_id", "n_tokens", (F.col("n_head") + F.coalesce(F.round(F.col("rest_known") * times), F.lit(0))).cast("bigint").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + rest_sum - F.col("n_tokens") * F.lit(z)).alias("base_score"), (F.col("model") + rest_sum).alias("score"),
    )


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 1)
    rows = score(docs, docs.where(~out))
    return rows.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
