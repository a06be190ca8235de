"""N-gram Jaccard join in Voronoi regions around pivots; exact.

Documents whose shingle sets are equal are one class, known by a key; only one document of a class
is joined. Jaccard distance is a metric, but it is 1 between most documents, so pivots drawn at random would
have everything on their boundary. The first pivots therefore come from an index: two sets of
similarity 0.75 share at least k shingles among the first n - ceil(0.75 n) + k of each, in any fixed
order. For every such shingle, documents that have it there are put in order of set size and cut
where sizes are too far apart to link; the first of a run is a pivot and the run is in its region,
so two documents that link are in a region together. A document that shares fewer than the k
shingles of its smallest possible partner links with nothing and leaves. Order: shingles that are
frequent, counted over all documents, come last, and the most frequent are dealt by size instead of
through one task; results don't depend on either, only sizes of regions do.

Documents of one large group of near copies are in a region for each shingle of their prefixes. A
first round therefore joins each document only in its largest and its smallest region. What links it
finds is left to chance, but regions whose documents are then of one component are done, and those
that nearly are, beside the same component, become one region (``left_over``). The second round is
exact on what is left: all pairs but those of one known component.

A region is joined by distances to pivots. Each document's home is the Voronoi cell of its nearest
pivot, or the far cell if it shares nothing with any. If x links with y, d(x, y) <= 0.25, then y is
at most 0.25 farther from x's pivot than x is, so at most 0.5 farther than from its own; and at
least 0.75 from all pivots if x is far. Documents in these windows are replicated into the cell.
Documents within 0.25 of a pivot (the core) are linked through it, and documents of a cell's largest
component never compared with each other; cells join in the same way, recursively. A region of more
than ``REGION`` documents or ``WEIGHT`` shingles is dealt in parts if few of its documents are outside
its largest component (they meet every part), and else cut into cells by a distributed pass, its
documents salted over tasks; smaller ones recurse inside one task. A cell that hardly shrinks is
compared block by block, each pair of blocks in a task of its own, core blocks not with one another.
Tasks give one link for every two known components that they join.

Nulls and the like: texts without words have an empty set and link with nothing; rows of one doc_id
are one document, to which the links of all its texts count; a null doc_id links with nothing and
has a null component. Extra columns are left out, or kept by ``distinct_documents``. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import bloom, hot_join, in_bloom, ship, small, stash, table, unpacker
from keyloom.llm.components import components
from keyloom.llm.shingles import mix, sets

#: Similarity as a share in hundredths.
PERCENT = 75
#: What a task takes of a region: documents, and shingles (8 bytes each, in a dozen arrays).
REGION, WEIGHT = 2000, 1_000_000
#: Frequent shingles are those in at least FREQUENT_SHARE of the different sets and FREQUENT_LEAST, and the most frequent in HOT_SHARE of them. SAMPLED: every document is counted.
SAMPLED, FREQUENT_SHARE, FREQUENT_LEAST, HOT_SHARE = 1, 1 / 5000, 3, 1 / 500
#: Shingles that a task counts at a time.
COUNTED = 4_000_000
#: k is one more than this share of a set.
EXTRA = 16
#: Tasks over which the rows of a most frequent shingle are dealt.
SALTS = 64
#: Pivots of a cell, cells that are compared outright, passes that cut a large region, and the share of a cell's parent beyond which it counts as not smaller.
PIVOTS, LEAF, LEVELS, SHRINK = 8, 32, 3, 0.75
#: Twice 0.25, and what rounding may cost.
WINDOW, SLACK = 2 * (100 - PERCENT) / 100, 1e-9
#: Comparisons that cost as much as reading a text.
TEXT = 500


def prefix_length(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - (PERCENT * n + 99) // 100 + 1 + n // EXTRA, 0)


def _texts(column) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _digests(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """128 bits of each set, as two numbers; the first is its class's key."""
    out = np.zeros((len(n), 2), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        at = (np.cumsum(n) - n)[full]
        for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            out[full, i] = np.add.reduceat(mix(flat ^ np.uint64(salt)), at)
    return out


def _fresh(keys: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which keys are new; they are put into seen."""
    out = np.zeros(len(keys), bool)
    for i, k in enumerate(keys.tolist()):
        if k not in seen:
            out[i] = True
            seen.add(k)
    return out


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key, more (the digest's other half) of every row; and rows with a count c of different sets that have a shingle (key).

    All rows of a task are counted, ``COUNTED`` shingles at a time; what occurs once among these is left out.
    """
    ship(docs.sparkSession)

    def counts(held):
        s, c = np.unique(np.concatenate(held), return_counts=True)
        s, c = s[c > 1].view(np.int64), c[c > 1]
        none = pa.nulls(len(s), pa.int64())
        return pa.RecordBatch.from_pydict({"doc_id": none, "n_shingles": none, "key": pa.array(s), "more": none, "c": pa.array(c.astype(np.int64))})

    def run(batches):
        held, size, seen = [np.zeros(0, np.uint64)], 0, set()
        for b in small(batches):
            flat, n = sets(_texts(b.column(1)))
            d = _digests(flat, n).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_shingles": pa.array(n.astype(np.int64)), "key": pa.array(d[:, 0]), "more": pa.array(d[:, 1]), "c": pa.nulls(len(n), pa.int64())})
            held.append(flat[np.repeat(_fresh(d[:, 0], seen), n)])
            size += len(held[-1])
            if size > COUNTED:
                yield counts(held)
                held, size = held[:1], 0
                seen.clear()
        yield counts(held)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, key bigint, more bigint, c bigint")


def frequent(counts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (key, c) of many of n different sets, sorted, and those of the most; at most mean set size / FREQUENT_SHARE."""
    got = counts.groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= max(FREQUENT_LEAST, n * FREQUENT_SHARE)).toArrow()
    s, c = got["key"].to_numpy().view(np.uint64), got["c"].to_numpy()
    return np.sort(s), np.sort(s[c >= max(FREQUENT_LEAST, n * HOT_SHARE)])


def _among(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x if len(sorted_) else np.zeros(len(x), bool)


def signatures(docs: DataFrame, often: np.ndarray, most: np.ndarray) -> DataFrame:
    """sig, x (class key), n, band: the prefix of every set, of equal sets once a task.

    A row of one of the most frequent shingles is there for the band of its size and for the next; two sizes that can link are in the same band or in neighbours. For all others band is -1.
    """
    at = docs.sparkSession.sparkContext.broadcast((often, most))

    def run(batches):
        (often, most), seen = at.value, set()
        for b in small(batches):
            flat, n = sets(_texts(b.column(0)))
            key = _digests(flat, n)[:, 0].view(np.int64)
            fresh = _fresh(key, seen)
            if len(seen) > 500_000:
                seen.clear()
            doc = np.repeat(np.arange(len(n)), n)
            late = _among(often, flat)
            n_late = np.bincount(doc, late, len(n)).astype(np.int64)
            before_own = np.cumsum(late) - late - (np.cumsum(n_late) - n_late)[doc]  # late ones before this in its set
            place = np.arange(len(flat)) - (np.cumsum(n) - n)[doc]
            rank = np.where(late, (n - n_late)[doc] + before_own, place - before_own)
            keep = (rank < prefix_length(n)[doc]) & fresh[doc]
            sig, doc = flat[keep], doc[keep]
            hot = np.flatnonzero(_among(most, sig))
            band = np.full(len(sig), -1, np.int16)
            band[hot] = np.floor(np.log(n[doc[hot]]) / np.log(100 / PERCENT) + SLACK)
            sig, doc, band = np.concatenate([sig, sig[hot]]), np.concatenate([doc, doc[hot]]), np.concatenate([band, band[hot] + np.int16(1)])
            yield pa.RecordBatch.from_pydict({"sig": pa.array(sig.view(np.int64)), "x": pa.array(key[doc]), "n": pa.array(n[doc].astype(np.int32)), "band": pa.array(band)})

    return docs.where("doc_id is not null and text is not null").select("text").mapInArrow(run, "sig bigint, x bigint, n int, band smallint")


def regions(signatures_: DataFrame) -> DataFrame:
    """x, p, n: classes beside the regions (by pivot, or shingle and size) they are in, without those that share too little to link."""

    def run(batches):
        last = held = None  # the last row's shingle, size, pivot and class; a run's first row until a second one comes
        for b in batches:
            s, d, n, band = (b.column(i).to_numpy() for i in range(4))
            hot = band >= 0
            # the most frequent shingles need no run: a region is a shingle and a band
            rows = [np.stack([d[hot], mix(s[hot].view(np.uint64) + band[hot].astype(np.uint64)).view(np.int64), n[hot]], 1)]
            s, d, n = s[~hot], d[~hot], n[~hot]
            other = np.ones(len(s), bool)  # not the same class, read by another task
            other[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
            other[:1] = last is None or s[:1] != last[0] or d[:1] != last[3]
            s, d, n = s[other], d[other], n[other]
            if len(s):
                before = np.concatenate([[last[0] if last else s[0]], s[:-1]]), np.concatenate([[last[1] if last else 0], n[:-1]])
                new = (s != before[0]) | (100 * before[1].astype(np.int64) < PERCENT * n.astype(np.int64))
                first = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
                p = np.where(first >= 0, d[np.maximum(first, 0)], last[2] if last else 0)
                out = ~new | np.append(~new[1:], False)
                rows.append(np.stack([d[out], p[out], n[out]], 1))
                if held and not new[0]:
                    rows.append(np.array([held], np.int64))
                held = (d[-1], d[-1], n[-1]) if new[-1] else None if new.any() or not new[0] else held
                last = (s[-1], n[-1], p[-1], d[-1])
            rows, times = np.unique(np.concatenate(rows), axis=0, return_counts=True)
            yield pa.RecordBatch.from_pydict({"x": pa.array(rows[:, 0]), "p": pa.array(rows[:, 1]), "n": pa.array(rows[:, 2].astype(np.int32)), "times": pa.array(times)})

    salt = F.when(F.col("band") >= 0, F.pmod(F.xxhash64("x", "band"), F.lit(SALTS))).otherwise(0)
    dealt = signatures_.repartition("sig", salt).sortWithinPartitions("sig", "n", "x").mapInArrow(run, "x bigint, p bigint, n int, times bigint")
    rows = stash(dealt.groupBy("x", "p", "n").agg(F.sum("times").alias("times")), "regions")
    smallest = F.ceil(F.col("n") * PERCENT / 100)
    able = rows.groupBy("x", "n").agg(F.sum("times").alias("times")).where(F.col("times") >= 1 + F.floor(smallest / EXTRA)).select("x")
    return rows.select("x", "p", "n").join(able, "x", "left_semi")


class Group:
    """Documents of a task: their sets as postings, and a union-find; known: a number each, equal where they are known to be of one component."""

    def __init__(self, flat: np.ndarray, n: np.ndarray, known: np.ndarray | None = None):
        self.flat, self.n = flat, n
        self.doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.start = np.cumsum(n) - n
        order = np.argsort(flat, kind="stable")
        s = flat[order]
        self.lists = self.doc[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(s)))
        term = np.empty(len(s), np.int32)
        term[order] = np.repeat(np.arange(len(first), dtype=np.int32), size)
        self.from_, self.size, self.term = first, size, term
        self.root = np.arange(len(n))
        if known is not None and len(n):
            _, first, which = np.unique(known, return_index=True, return_inverse=True)
            self.root = first[which]
        self.asked = np.zeros(len(n), bool)

    def shared(self, i: int) -> np.ndarray:
        """Shingles that each document shares with document i."""
        t = self.term[self.start[i] : self.start[i] + self.n[i]]
        t = t[self.size[t] > 1]
        if not len(t):
            out = np.zeros(len(self.n), np.int64)
        else:
            size = self.size[t]
            at = np.repeat(self.from_[t] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
            out = np.bincount(self.lists[at], minlength=len(self.n))
        out[i] = self.n[i]
        return out

    def ask(self, i: int, among: np.ndarray | None = None) -> np.ndarray:
        """Distances of all documents to i; i's component is joined with those of all that link with it."""
        both = self.shared(i)
        union = self.n + self.n[i] - both
        ok = (both > 0) & (100 * both >= PERCENT * union)
        if among is not None:
            ok &= among
            ok[i] = True
        roots = np.unique(self.root[ok])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]
        self.asked[i] = True
        return 1 - both / np.maximum(union, 1)

    def cells(self, cell: np.ndarray) -> list[np.ndarray]:
        """Members of the cells of some pivots."""
        distance = []
        nearest = np.full(len(cell), np.inf)
        for _ in range(PIVOTS):  # each pivot is the document farthest from those before it
            i = int(nearest.argmax())
            if nearest[i] <= WINDOW / 2:
                break
            distance.append(self.ask(int(cell[i]))[cell])
            nearest = np.minimum(nearest, distance[-1])
        d = np.stack(distance)
        home = np.where(nearest >= 1, -1, d.argmin(0))
        out = []
        for j in range(-1, len(d)):
            mine = home == j
            if not mine.any():
                continue
            if j < 0:
                inside = nearest >= 1 - WINDOW / 2 - SLACK
            else:
                inside = (d[j] <= nearest + WINDOW + SLACK) & (d[j] <= d[j][mine].max() + WINDOW / 2 + SLACK)
            out.append(cell[inside])
        return out

    def others(self, cell: np.ndarray) -> np.ndarray:
        """Documents of a cell outside its largest component; pairs inside that need no comparison."""
        roots, size = np.unique(self.root[cell], return_counts=True)
        return cell[(self.root[cell] != roots[size.argmax()]) & ~self.asked[cell]]

    def finish(self, cell: np.ndarray) -> None:
        """Compare a cell outright. Who has come to the largest component needs no turn: of two that had none both are in it."""
        roots, size = np.unique(self.root[cell], return_counts=True)
        lead = cell[self.root[cell] == roots[size.argmax()]][0]
        for i in cell:
            if self.root[i] != self.root[lead] and not self.asked[i]:
                self.ask(int(i))

    def join(self) -> np.ndarray:
        """Component of each document (an index), all pairs considered."""
        todo = [np.arange(len(self.n))] if len(self.n) else []
        while todo:
            cell = todo.pop()
            if len(self.others(cell)) <= LEAF:
                self.finish(cell)
                continue
            for inside in self.cells(cell):
                if len(inside) > SHRINK * len(cell):
                    self.finish(inside)
                else:
                    todo.append(inside)
        return self.root

    def join_across(self, left: np.ndarray) -> np.ndarray:
        """The same for pairs with one document on either side."""
        side = left if left.sum() <= (~left).sum() else ~left
        for i in np.flatnonzero(side):
            if (self.root[~side] != self.root[i]).any():
                self.ask(int(i), ~side)
        return self.root


def _join_task(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x, z, r (known component), side (-1: all pairs; else 0 or 1: pairs across) -> links (a, b) between known components, one less than it joins."""
    unpack = unpacker()
    x, r, side, flat, n = [], [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b in batches:
        f, k = sets([unpack(z.as_py()) for z in b.column("z")])
        flat.append(f)
        n.append(k)
        for to, name in ((x, "x"), (r, "r"), (side, "side")):
            to.append(b.column(name).to_numpy())
    x, side = np.concatenate(x), np.concatenate(side)
    group = Group(np.concatenate(flat), np.concatenate(n), np.concatenate(r))
    was = group.root.copy()
    root = group.join() if (side < 0).all() else group.join_across(side == 0)
    moved = np.flatnonzero((was == np.arange(len(root))) & (root != was))
    yield pa.RecordBatch.from_pydict({"a": pa.array(x[moved]), "b": pa.array(x[root[moved]])})


def _assign(batches):
    """p, salt, pivot, x, z with each (p, salt)'s pivots first -> x, p, q (pivot, null: far), home, core."""
    unpack = unpacker()
    region, names, pivots = None, [], []
    for b in batches:
        p, salt, is_pivot, x = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        flat, n = sets([unpack(z.as_py()) for z in b.column(4)])
        start = np.cumsum(n) - n
        out = []
        edges = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (salt[1:] != salt[:-1])])).tolist() + [len(p)] if len(p) else []
        for begin, end in zip(edges, edges[1:], strict=False):
            if region != (p[begin], salt[begin]):
                region, names, pivots = (p[begin], salt[begin]), [], []
            for i in range(begin, end):
                if is_pivot[i]:
                    names.append(x[i])
                    pivots.append(flat[start[i] : start[i] + n[i]])
            rows = np.arange(begin, end)[~is_pivot[begin:end]]
            if not len(rows):
                continue
            low, high = start[rows[0]], start[rows[-1]] + n[rows[-1]]
            own = flat[low:high]
            d = np.empty((len(pivots), len(rows)))
            for j, q in enumerate(pivots):
                upto = np.concatenate([[0], np.cumsum(_among(q, own))])
                both = upto[start[rows] + n[rows] - low] - upto[start[rows] - low]
                d[j] = 1 - both / (n[rows] + len(q) - both)
            nearest, home = d.min(0), d.argmin(0)
            for j, q in enumerate(names):
                inside = np.flatnonzero((d[j] <= nearest + WINDOW + SLACK) & (d[j] < 1))
                out.append((x[rows[inside]], np.full(len(inside), p[begin]), np.full(len(inside), q), (home == j)[inside], d[j][inside] <= WINDOW / 2 + SLACK, np.ones(len(inside), bool)))
            far = np.flatnonzero(nearest >= 1 - WINDOW / 2 - SLACK)
            out.append((x[rows[far]], np.full(len(far), p[begin]), np.zeros(len(far), np.int64), nearest[far] >= 1, np.zeros(len(far), bool), np.zeros(len(far), bool)))
        if out:
            c = [np.concatenate(k) for k in zip(*out, strict=True)]
            yield pa.RecordBatch.from_pydict({"x": pa.array(c[0].astype(np.int64)), "p": pa.array(c[1].astype(np.int64)), "q": pa.array(c[2].astype(np.int64), mask=~c[5]), "home": pa.array(c[3]), "core": pa.array(c[4])})


def cut(members: DataFrame, texts: DataFrame, level: int) -> DataFrame:
    """Large regions (x, p, n, size) -> their cells: x, p, q, home, core; q null: the far cell. Salted, so no region is one task."""
    salts = F.ceil(F.col("size") / REGION).cast("int")
    drawn = F.pmod(F.xxhash64("x", F.lit(level)), F.lit(1 << 30)) / float(1 << 30) < PIVOTS / F.col("size")
    first = members.groupBy("p").agg(F.min("x").alias("least"))
    with_text = members.join(texts, "x")
    pivots = members.join(first, "p").where((F.col("x") == F.col("least")) | drawn).drop("least").join(texts, "x")
    asked = with_text.select("p", F.pmod(F.xxhash64("x", F.lit(-1)), salts).cast("int").alias("salt"), F.lit(False).alias("pivot"), "x", "z")
    sent = pivots.select("p", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(True).alias("pivot"), "x", "z")
    dealt = asked.unionByName(sent).repartition("p", "salt").sortWithinPartitions("p", "salt", F.col("pivot").desc(), "x")
    return stash(dealt.mapInArrow(_assign, "x bigint, p bigint, q bigint, home boolean, core boolean"), f"cells-{level}")


def blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Regions (x, p, size, weight, core) whose cells don't get smaller -> rows of join tasks: all pairs of blocks, but for core ones with one another."""
    parts = F.greatest(F.ceil(F.col("size") * 2 / REGION), F.ceil(F.col("weight") * 2 / WEIGHT))
    placed = members.select("x", "p", "r", "core", F.pmod(F.xxhash64("x", F.lit(-2)), parts).cast("int").alias("block")).withColumn("block", F.col("block") * 2 + F.col("core").cast("int"))
    have = placed.select("p", "block").distinct()
    tasks = have.withColumnRenamed("block", "i").join(have.withColumnRenamed("block", "j"), "p").where("i <= j and not (i % 2 = 1 and j % 2 = 1)")
    with_text = placed.join(texts, "x").select("p", "block", "x", "r", "z")
    first = with_text.join(tasks.select("p", F.col("i").alias("block"), "j"), ["p", "block"]).select("p", F.col("block").alias("i"), "j", "x", "r", "z", F.when(F.col("block") == F.col("j"), -1).otherwise(0).alias("side"))
    second = with_text.join(tasks.where("i <> j").select("p", "i", F.col("j").alias("block")), ["p", "block"]).select("p", "i", F.col("block").alias("j"), "x", "r", "z", F.lit(1).alias("side"))
    return first.unionByName(second).select(F.xxhash64("p", "i", "j").alias("task"), "x", "r", "z", "side")


def _joined(rows: DataFrame) -> DataFrame:
    return rows.groupBy("task").applyInArrow(_join_task, "a bigint, b bigint")


def _task_rows(rows: DataFrame, texts: DataFrame) -> DataFrame:
    return rows.join(texts, "x").select("task", "x", "r", "z", F.lit(-1).alias("side"))


def _parts(size: str, weight: str):
    """Parts of half of what a task takes."""
    return F.greatest(F.ceil(F.col(size) * 2 / REGION), F.ceil(F.col(weight) * 2 / WEIGHT)).cast("int")


def first_links(members: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (x, p, n, size, weight) -> some links (a, b), and the regions (p) that are done.

    Each document is joined only with those that have the same largest or the same smallest region. A
    group that is too large for a task is dealt to several, some of it to all of them, so this is linear.
    """
    ends = members.groupBy("x").agg(F.max(F.struct("size", "p")).alias("large"), F.min(F.struct("size", "p")).alias("small"))
    one = stash(ends.select("x", F.explode(F.array_distinct(F.array("large.p", "small.p"))).alias("p")), "ends")
    chosen = members.join(one, ["x", "p"], "left_semi")
    sizes = stash(chosen.groupBy("p", "size").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.min("x").alias("least")).where("c > 1"), "sizes")
    fits = f"c <= {REGION} and w <= {WEIGHT}"
    known = hot_join(chosen.select("x", "p"), sizes.select("p", "c", "w", "least", F.col("c").alias("many"), _parts("c", "w").alias("parts"), F.expr(fits).alias("fits")), ["p"], members.count()).where("many is not null")
    known = stash(known, "chosen")
    drawn = (F.col("x") == F.col("least")) | (F.pmod(F.xxhash64("x", F.lit(-3)), F.lit(1 << 30)) / float(1 << 30) < PIVOTS / F.col("many"))
    part = F.when(F.col("fits"), F.array(F.lit(0))).when(drawn, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("x", F.lit(-4)), F.col("parts")).cast("int")))
    rows = known.select("x", F.col("x").alias("r"), "p", F.explode(part).alias("part")).select("x", "r", F.xxhash64("p", "part").alias("task"))
    return _joined(_task_rows(rows, texts)), sizes.where(f"c = size and {fits}").select("p")


def left_over(members: DataFrame, done: DataFrame, found: DataFrame) -> DataFrame:
    """members (x, p, n, size), found (node, root) -> x, p, n, r, size, weight, lead, few, few_weight of what is still to be joined.

    A region whose documents are all of one component is done. lead is the component with the most
    documents of a region; few of them are of others. Regions with one lead are one region where that
    takes less: a text costs ``TEXT`` comparisons.
    """
    total = members.count()
    known = stash(members.select("x", "p", "n").join(found, F.col("x") == F.col("node"), "left").select("x", "p", "n", F.coalesce("root", "x").alias("r")), "known")
    parts = known.groupBy("p", "r").agg(F.count("*").alias("c"))
    regions_ = parts.groupBy("p").agg(F.sum("c").alias("c"), F.max(F.struct("c", "r")).alias("m"), F.count("*").alias("roots")).where("roots > 1").join(done, "p", "left_anti")
    regions_ = stash(regions_.select("p", "c", F.col("m.r").alias("lead"), (F.col("c") - F.col("m.c")).alias("few")), "open")
    rows = stash(hot_join(known, regions_.drop("few"), ["p"], total).where("lead is not null"), "open-members")
    apart = regions_.groupBy("lead").agg(F.sum((F.col("few") + TEXT) * F.col("c")).alias("apart"), F.count("*").alias("regions"))
    union = rows.select("lead", "x", "r").distinct().groupBy("lead").agg(F.count("*").alias("size"), F.count_if(F.col("r") != F.col("lead")).alias("few"))
    merged = union.join(apart, "lead").where(((F.col("few") + TEXT) * F.col("size") < F.col("apart")) & (F.col("regions") > 1)).select("lead", F.lit(True).alias("merged"), F.col("size").alias("c"))
    rows = hot_join(rows, stash(merged, "merged"), ["lead"], total)
    rows = stash(rows.select("x", F.when(F.col("merged"), F.xxhash64("lead", F.lit("lead"))).otherwise(F.col("p")).alias("p"), "n", "r", "lead").distinct(), "left")
    of_others = F.col("r") != F.col("lead")
    sizes = rows.groupBy("p").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.count_if(of_others).alias("few"), F.coalesce(F.sum(F.when(of_others, F.col("n"))), F.lit(0)).alias("few_weight"), F.count("*").alias("c"))
    return stash(hot_join(rows, stash(sizes, "sizes"), ["p"], rows.count()), "members")


def few_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Large regions nearly all of whose documents are of one component: the others meet it part by part."""
    parts = _parts("size", "weight")
    part = F.when(F.col("r") != F.col("lead"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("x", F.lit(-4)), parts).cast("int")))
    rows = members.select("x", "r", "p", F.explode(part).alias("part")).select("x", "r", F.xxhash64("p", "part").alias("task"))
    return _joined(_task_rows(rows, texts))


def region_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """members (x, p, n), texts (x, z) -> links (a, b) of class keys."""
    sizes = stash(members.groupBy("p").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.count("*").alias("c")).where("size > 1"), "sizes")
    members = stash(hot_join(members, sizes, ["p"], members.count()).where("size is not null"), "members")
    first, done = first_links(members, texts)
    found = stash(components(first), "first")
    members = left_over(members, done, found).withColumn("core", F.lit(False))
    small_ = f"size <= {REGION} and weight <= {WEIGHT}"
    few = f"few * 2 <= {REGION} and few_weight * 2 <= {WEIGHT}"
    whole = lambda rows: _joined(_task_rows(rows.where(small_).withColumn("task", F.col("p")), texts))
    out = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(whole(members))
    out = out.unionByName(few_links(members.where(f"not ({small_}) and {few}"), texts))
    members = members.where(f"not ({small_}) and not ({few})")
    for level in range(LEVELS):
        if members.isEmpty():
            return out
        cells = cut(members.select("x", "p", "n", "size"), texts, level)
        out = out.unionByName(cells.where("core").select(F.col("x").alias("a"), F.col("q").alias("b")).where("a <> b"))
        named = cells.join(members.select("x", "p", "n", "r", F.col("size").alias("was")), ["x", "p"]).withColumn("cell", F.xxhash64("p", "q", F.lit(level)))
        # a cell in which nobody is at home, or all are of the core or of one component, has nothing left to compare
        have = named.groupBy("cell").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.max("was").alias("was"), F.max("home").alias("home"), F.min("core").alias("core"), F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("c")).where("home and not core and size > 1 and low < high").drop("home", "core", "low", "high")
        below = hot_join(named.select("x", "cell", "n", "r", "core"), stash(have, "cells"), ["cell"], cells.count()).where("size is not null")
        below = stash(below.withColumnRenamed("cell", "p"), "members")
        out = out.unionByName(whole(below))
        below = below.where(f"not ({small_})")
        stuck = F.col("size") > SHRINK * F.col("was") if level < LEVELS - 1 else F.lit(True)
        out = out.unionByName(_joined(blocks(below.where(stuck), texts)))
        members = below.where(~stuck).drop("was")
    return out


def widest(pairs: DataFrame) -> DataFrame:
    """x, p, n of regions of two or more; a region is left out if all of it is in the least one that its pivot is also in.

    That one has a smaller name, so what is left out for it is in a region that stays. What is known of
    a region joins its members by hot_join, as one region may hold a large part of all rows.
    """
    total = pairs.count()
    same = pairs.groupBy("p").agg(F.count("*").alias("size"), F.sum(F.xxhash64("x").bitwiseAND(F.lit((1 << 40) - 1))).alias("h"), F.bit_xor(F.xxhash64("x", F.lit(1))).alias("g")).where("size > 1")
    # of regions with the same members one stays
    sizes = stash(same.groupBy("size", "h", "g").agg(F.min("p").alias("p")).select("p", "size", F.col("size").alias("c")), "sizes")
    pairs = stash(hot_join(pairs, sizes, ["p"], total).where("size is not null"), "pairs")
    wider = pairs.select(F.col("x").alias("y"), F.col("p").alias("q"))
    own = pairs.where("x = p").select("p").join(wider, F.col("p") == F.col("y")).where("q < p").groupBy("p").agg(F.min("q").alias("q"))
    own = stash(own.join(sizes.select("p", "c"), "p"), "own")
    met = hot_join(pairs.select("x", "p", "size"), own, ["p"], total).where("q is not null")
    inside = met.join(wider.withColumnRenamed("y", "x"), ["x", "q"]).groupBy("p", "size").agg(F.count("*").alias("n")).where("n = size")
    gone = stash(inside.select("p", F.col("size").alias("c"), F.lit(True).alias("gone")), "gone")
    return hot_join(pairs.select("x", "p", "n"), gone, ["p"], total).where("gone is null").select("x", "p", "n")


def class_texts(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """heads (key, x: a document) -> x, z (its packed text); a fixed-size Bloom filter keeps other texts out of the shuffle."""
    spark = docs.sparkSession
    at = spark.sparkContext.broadcast(bloom(heads, "x"))

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            t = pa.Table.from_batches([b]).filter(pa.array(in_bloom(at.value, b.column(1).to_numpy())))
            z, keys = [], [np.zeros(0, np.int64)]
            for texts in small(t.to_batches()):
                raw = _texts(texts.column(2))
                keys.append(_digests(*sets(raw))[:, 0].view(np.int64))
                z += map(pack, raw)
            yield pa.RecordBatch.from_pydict({"x": t["x"].combine_chunks(), "key": pa.array(np.concatenate(keys)), "z": pa.array(z, pa.binary())})

    x = F.col("doc_id").cast("bigint")
    rows = docs.where("doc_id is not null and text is not null").select(x.alias("x"), F.xxhash64(x).alias("h"), "text")
    return rows.mapInArrow(run, "x bigint, key bigint, z binary").dropDuplicates(["x", "key"]).join(heads, ["x", "key"], "left_semi").select("x", "z")


def links(docs: DataFrame, base: DataFrame, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(a, b) of class names (rep) that are linked, enough of them to connect every component."""
    members = stash(widest(regions(signatures(docs, *often))), "widest")
    wanted = members.select(F.col("x").alias("key")).distinct()
    heads = stash(base.where("rep = doc_id").select("key", F.col("rep").alias("x")).distinct().join(wanted, "key", "left_semi"), "heads")
    texts = stash(class_texts(docs, heads), "texts", "uncompressed")
    named = stash(members.join(heads.withColumnRenamed("x", "doc"), F.col("x") == F.col("key")).select(F.col("doc").alias("x"), "p", "n"), "named")
    return region_links(named, texts)


def classes(docs: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """doc_id, n_shingles, key, more, rep: the least doc_id with an equal set; null for empty sets and null ids. Beside it, the frequent shingles."""
    rows = stash(set_table(docs), "sets")
    base = rows.where("c is null").drop("c")
    least = stash(base.where("n_shingles > 0").groupBy("n_shingles", "key", "more").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), "least")
    joined = hot_join(base, least, ["n_shingles", "key", "more"], base.count())
    often = frequent(rows.where("c is not null").select("key", "c"), least.count())
    return joined.select("doc_id", "n_shingles", "key", "more", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), often


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    base, often = classes(docs)
    base = stash(base, "classes")
    rows = base.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    # rows of one id whose sets differ are one document
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("doc_id")
    same = rows.join(ids, "doc_id", "left_semi").where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    # a document of several classes is in the graph by its own name too
    found = components(links(docs, base, often).unionByName(same))
    total = rows.agg(F.count("*")).first()[0]
    counted = rows.where("rep is not null").groupBy("rep").agg(F.count("*").alias("c")).join(found, F.col("rep") == F.col("node")).select("rep", "root", "c")
    named = hot_join(rows, counted, ["rep"], total)
    return named.select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the least id; rows of no id or no words all stay."""
    found = components_of(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(found, docs["doc_id"] == found["_id"], "left_anti")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
