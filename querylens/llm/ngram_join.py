"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles. Two sets link when their Jaccard similarity is at least
``threshold``. Sizes fall into bands [l, r] with r = l / threshold, so linked sets lie in one band or in neighbours;
a set takes part in its own band's instance and in the next one's. Linked sets of an instance differ in at most
k = 2 r (1 - t) / (1 + t) features. The instance cuts the feature domain (hash ranges) into ``groups`` first-level
partitions of three second-level ones and enumerates the two-of-three subsets: each gives a signature of the set's
features in it. Sets whose differences spare a subset that is not empty share its signature.

``groups`` is the least number with which a pair exactly at the threshold, its k differences and 3 k common features
thrown on the cells at random, shares no signature with probability under ``miss``; more similar pairs are missed far
less often. A small set, where that would take more signatures than it has features, has every feature as its own
partition, where no linked pair can be missed; with ``miss`` 0 every set has, at the price of a signature a feature.

The smallest set of a signature is its head. All sets that share a signature with a head form its group, one row a
member, so each candidate pair lies in some group. Pairs with a head are tested first: by exact lower bounds (sizes,
histograms of the features), then by exact intersection. Where members of a group are in different components by then,
they are compared with each other in blocks of bounded size, by the bounds and then exactly, and a pair is emitted only if
it links and ties two components together: never more pairs than members.

Edge cases: null or empty text is the empty set, linked with nothing; under ``size`` words the whole sequence is the
one shingle; equal sets (repeated rows and ties among them) are one class from the start, named by its smallest doc_id;
texts of any length are read whole, a text longer than a chunk alone; a set of which all rows have a null doc_id links
with nothing; an empty table gives an empty result; other columns are ignored. Features are 54-bit hashes, sets are named by
64-bit hashes.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.llm._spark import dropped, lookup, written
from querylens.llm._tokens import NOT_WHITE, U, Words, chunks, gram_hash, mix
from querylens.sources.scratch import spread

MISS = 1e-9
BITS = 10
#: Least cells of a histogram, and the features a cell holds on average at most.
CELLS, CELL_FEATURES = 64, 8
#: Signatures in one bucket, about; a task holds one bucket.
BUCKET_SIGNATURES = 2_000_000
#: Signatures that a mapper gathers before it sends them on.
FLUSH = 1_000_000
#: Most members and features in a block of a group, about, and members of small groups that are compared in one go.
BLOCK, BLOCK_FEATURES, BIN = 1024, 500_000, 4096
#: Most document ids that are broadcast to fetch candidates' texts; beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


@functools.cache
def bands(num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest sizes of the bands, for the threshold num / den."""
    low, high = [1], []
    while low[-1] < 1 << 40:
        high.append(max(low[-1], low[-1] * den // num))
        low.append(high[-1] + 1)
    return np.array(low[:-1]), np.array(high)


@functools.cache
def groups_for(band: int, num: int, den: int, most: float = MISS) -> int:
    """First-level partitions of a band's instance; 0: every feature is its own partition."""
    _, high = bands(num, den)
    r = int(high[band])
    k = 2 * r * (den - num) // (den + num)
    if k == 0:
        return 0

    def miss(g: int) -> float:
        clean, common = math.exp(-k / (3 * g)), num / (den - num) * k / (3 * g)
        hit = 3 * clean**2 * (1 - clean) * (1 - math.exp(-2 * common)) + clean**3 * (1 - math.exp(-3 * common))
        return (1 - hit) ** g

    if most <= 0:
        return 0
    low, up = 1, 4
    while miss(up) > most:
        if 3 * up > r:
            return 0
        up *= 2
    while low < up:
        mid = (low + up) // 2
        low, up = (low, mid) if miss(mid) <= most else (mid + 1, up)
    return low if 3 * low < r else 0


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(features sorted within each text, offsets of the texts)."""
    w = Words(data, offsets, NOT_WHITE)
    n, docs = w.counts, len(offsets) - 1
    grams = gram_hash(w.hash, size)
    owner = w.docs()
    whole = np.flatnonzero(owner[: len(grams)] == owner[size - 1 :]) if len(grams) else np.zeros(0, dtype=np.int64)
    keys = [(owner[whole].astype(U) << U(64 - BITS)) | (grams[whole] >> U(BITS))]
    for m in range(1, size):  # short texts: the whole sequence
        d = np.flatnonzero(n == m)
        if len(d):
            h = gram_hash(w.hash, m)[w.first[d]]
            keys.append((d.astype(U) << U(64 - BITS)) | (h >> U(BITS)))
    key = np.unique(np.concatenate(keys))
    first = np.searchsorted(key, np.arange(docs, dtype=U) << U(64 - BITS))
    return key & U((1 << (64 - BITS)) - 1), np.append(first, len(key))


def set_names(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set (signed); sets without features get 0."""
    sums = np.zeros(len(features) + 1, dtype=U)
    np.cumsum(mix(features), out=sums[1:])
    name = mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(U) * U(0x9E3779B97F4A7C15))
    return np.where(np.diff(first) > 0, name, U(0)).view(np.int64)


def cells_of(n: np.ndarray) -> np.ndarray:
    """Cells of the histograms of sets of these sizes: powers of two."""
    return CELLS * 2 ** np.ceil(np.log2(np.maximum(1, n / (CELLS * CELL_FEATURES)))).astype(np.int64)


def histograms(features: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Features of each set by cell (their low bits), at most 255 in one: differences never exceed the sets'."""
    n = np.diff(first)
    cells = cells_of(n)
    base = np.concatenate(([0], np.cumsum(cells)))
    at = np.repeat(base[:-1], n) + (features & np.repeat(cells - 1, n).astype(U)).astype(np.int64)
    flat = np.minimum(np.bincount(at, minlength=base[-1]), 255).astype(np.uint8).tobytes()
    return [flat[x:y] for x, y in zip(base[:-1], base[1:], strict=True)]


def folded(histogram: np.ndarray, cells: int) -> np.ndarray:
    """Histograms (a row each) over fewer cells."""
    return histogram.reshape(len(histogram), histogram.shape[1] // cells, cells).sum(axis=1, dtype=np.int32)


def signatures(features: np.ndarray, first: np.ndarray, num: int, den: int, miss: float = MISS) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) for all sets; both instances of each."""
    low, _ = bands(num, den)
    n = np.diff(first)
    band = np.searchsorted(low, n, side="right") - 1
    out_s, out_d = [], []
    for step in (0, 1):
        inst = band + step
        g = np.array([groups_for(int(b), num, den, miss) if b >= 0 else 0 for b in range(int(inst.max(initial=0)) + 1)], dtype=np.int64)[inst]
        owner = np.repeat(np.arange(len(n)), n)
        tag = mix(inst.astype(U) + U(1))
        single = g[owner] == 0
        out_s.append(mix(features[single] + tag[owner[single]]))
        out_d.append(owner[single])
        if single.all():
            continue
        f, o = features[~single], owner[~single]
        cells = 3 * g
        base = np.concatenate(([0], np.cumsum(cells)))
        # A hash range a cell: the features are sorted, so a cell's are neighbours.
        at = base[o] + ((f >> U(22)) * cells[o].astype(U) >> U(32)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        sums = np.zeros(base[-1], dtype=U)
        sums[at[starts]] = mix(np.add.reduceat(mix(f + U(7)), starts))
        sums = sums.reshape(-1, 3)
        group_owner = np.repeat(np.arange(len(n)), g)
        group = np.arange(len(sums)) - np.repeat(base[:-1] // 3, g)
        for left_out in range(3):
            x, y = sums[:, (left_out + 1) % 3], sums[:, (left_out + 2) % 3]
            some = (x != 0) | (y != 0)
            s = mix(x[some] + U(3) * y[some] + tag[group_owner[some]] + mix((group[some] * 3 + left_out).astype(U)))
            out_s.append(s)
            out_d.append(group_owner[some])
    return np.concatenate(out_s), np.concatenate(out_d)


def described(size: int):
    """Arrow batches (doc_id, text) -> one row a document: doc_id, n, name, cells (a histogram, as bytes)."""

    def run(batches):
        for b in batches:
            for i, j, data, offsets in chunks(b.column(1)):
                features, first = shingle_sets(data, offsets, size)
                columns = [b.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(set_names(features, first)), pa.array(histograms(features, first), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "name", "cells"])

    return run


def signed(size: int, num: int, den: int, buckets: int, miss: float):
    """Arrow batches (doc_id, text) -> a row for each bucket and flush: sorted (signature, set name) columns as bytes."""

    def send(sig: list, name: list):
        s, m = np.concatenate(sig), np.concatenate(name)
        order = np.argsort(s)
        s, m = s[order], m[order]
        # A bucket is a range of signatures.
        cut = np.searchsorted((s >> U(40)) * U(buckets) >> U(24), np.arange(buckets + 1, dtype=U))
        rows = [(b, x, y) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
        packed = []
        for _, x, y in rows:
            names, local = np.unique(m[x:y], return_inverse=True)
            # 6 bytes of the signature, 2 of the place in the table of names: flushes have fewer names than that.
            packed.append((((s[x:y] << U(8)) & ~U(0xFFFF)) | local.astype(U), names))
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([p[0].tobytes() for p in packed], pa.binary()), pa.array([p[1].tobytes() for p in packed], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "signatures", "names"])

    def run(batches):
        sig, name, held, seen = [], [], 0, set()
        for b in batches:
            for _, _, data, offsets in chunks(b.column(1)):
                features, first = shingle_sets(data, offsets, size)
                names = set_names(features, first)
                # A set that this flush has already signed is not signed again.
                new = np.array([k for k, x in enumerate(names.tolist()) if x and not (x in seen or seen.add(x))], dtype=np.int64)
                s, d = signatures(features, first, num, den, miss)
                mine = np.isin(d, new)
                sig.append(s[mine])
                name.append(names[d[mine]])
                held += len(sig[-1])
                if held >= FLUSH or len(seen) > 30_000:
                    yield send(sig, name)
                    sig, name, held, seen = [], [], 0, set()
        if held:
            yield send(sig, name)

    return run


PAIR_SCHEMA = "a long, b long, shared long"


def bucket_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Within one bucket: (head, member, number of shared signatures), a row for each member of a head's group."""
    sig, name = [], []
    for s, m in zip(pdf["signatures"], pdf["names"], strict=True):
        x = np.frombuffer(s, dtype=U)
        sig.append(x >> U(16))
        name.append(np.frombuffer(m, dtype=np.int64)[(x & U(0xFFFF)).astype(np.int64)])
    sig, name = np.concatenate(sig), np.concatenate(name)
    order = np.lexsort((name, sig))
    sig, name = sig[order], name[order]
    keep = np.concatenate(([True], (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])))
    sig, name = sig[keep], name[keep]
    starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    sizes = np.diff(np.append(starts, len(sig)))
    other = np.arange(len(sig)) != np.repeat(starts, sizes)
    head, member = np.repeat(name[starts], sizes)[other], name[other]
    order = np.lexsort((member, head))
    head, member = head[order], member[order]
    if not len(head):
        return pd.DataFrame({"a": head, "b": member, "shared": head})
    first = np.flatnonzero(np.concatenate(([True], (head[1:] != head[:-1]) | (member[1:] != member[:-1]))))
    return pd.DataFrame({"a": head[first], "b": member[first], "shared": np.diff(np.append(first, len(head)))})


def may_link(n1: np.ndarray, h1: np.ndarray, n2: np.ndarray, h2: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the exact lower bounds on the difference of sets allow links; histograms have equal cells."""
    apart = np.abs(h1.astype(np.int16) - h2.astype(np.int16)).sum(axis=1, dtype=np.int64)
    return (np.minimum(n1, n2) * den >= np.maximum(n1, n2) * num) & (apart * (num + den) <= (n1 + n2) * (den - num))


def shapes(column: pa.Array, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Histograms of sets of these sizes by their number of cells: {cells: (rows, histograms)}."""
    data, offsets = np.frombuffer(column.buffers()[2], dtype=np.uint8), np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset :]
    cells = cells_of(n)
    out = {}
    for c in np.unique(cells).tolist():
        rows = np.flatnonzero(cells == c)
        out[c] = rows, data[(offsets[rows][:, None] + np.arange(c)).ravel()].reshape(-1, c)
    return out


def head_bounds(num: int, den: int):
    """Arrow batches (a, b, shared, na, ha, nb, hb) -> (a, b, shared, near, nb); near: the bounds allow a link."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            near = np.zeros(len(na), dtype=bool)
            left, right = shapes(batch.column(4), na), shapes(batch.column(6), nb)
            for c1, (r1, h1) in left.items():
                for c2, (r2, h2) in right.items():
                    both, i, j = np.intersect1d(r1, r2, assume_unique=True, return_indices=True)
                    c = min(c1, c2)
                    near[both] = may_link(na[both], folded(h1[i], c), nb[both], folded(h2[j], c), num, den)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(near), batch.column(5)], ["a", "b", "shared", "near", "nb"])

    return run


FEATURE_BYTES = 6


def packed_features(features: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Each set's features, FEATURE_BYTES of each."""
    flat = (features >> U(54 - 8 * FEATURE_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :FEATURE_BYTES].tobytes()
    return [flat[FEATURE_BYTES * x : FEATURE_BYTES * y] for x, y in zip(first[:-1], first[1:], strict=True)]


class Block:
    """The sets of one group in one or two blocks: names, labels, sizes, and the features as numbers from 0."""

    def __init__(self, name: np.ndarray, label: np.ndarray, features: list[bytes]):
        self.name, self.root = name, label.copy()
        self.n = np.array([len(x) // FEATURE_BYTES for x in features])
        self.end = np.cumsum(self.n)
        wide = np.zeros((self.end[-1], 8), dtype=np.uint8)
        wide[:, :FEATURE_BYTES] = np.frombuffer(b"".join(features), dtype=np.uint8).reshape(-1, FEATURE_BYTES)
        kinds, self.flat = np.unique(wide.reshape(-1).view("<u8"), return_inverse=True)
        self.mark = np.zeros(len(kinds), dtype=bool)
        owner = np.repeat(np.arange(len(name)), self.n)
        self.cells = np.bincount(owner * CELLS + self.flat % CELLS, minlength=len(name) * CELLS).reshape(-1, CELLS)

    def ties(self, left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
        """Links of a left and a right set that tie components together."""
        out = []
        right = right[np.argsort(self.n[right], kind="stable")]
        sizes = self.n[right]
        for x in left.tolist():
            n = int(self.n[x])
            y = right[np.searchsorted(sizes, -(-n * num // den)) : np.searchsorted(sizes, n * den // num, side="right")]
            y = y[self.root[y] != self.root[x]]
            apart = np.abs(self.cells[y] - self.cells[x]).sum(axis=1)
            y = y[apart * (num + den) <= (self.n[y] + n) * (den - num)]
            if not len(y):
                continue
            own = self.flat[self.end[x] - n : self.end[x]]
            self.mark[own] = True
            many = self.n[y]
            starts = np.cumsum(many) - many
            at = np.arange(many.sum()) + np.repeat(self.end[y] - many - starts, many)
            shared = np.add.reduceat(self.mark[self.flat[at]].astype(np.int64), starts)
            self.mark[own] = False
            for z in y[shared * den >= (n + many - shared) * num].tolist():
                if self.root[z] != self.root[x]:
                    self.root[self.root == self.root[z]] = self.root[x]
                    out.append((int(self.name[x]), int(self.name[z])))
        return out


def block_ties(num: int, den: int):
    """Rows (a, low, name, label, features) of one block, of two, or of several small groups -> links that tie components."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("a")
        a, low, name, label = (rows.column(k).to_numpy() for k in ("a", "low", "name", "label"))
        features = rows.column("features").to_pylist()
        cut = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True])))
        out = []
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            block = Block(name[x:y], label[x:y], features[x:y])
            left, right = np.flatnonzero(low[x:y]), np.flatnonzero(~low[x:y])
            out += block.ties(left, right if len(right) else left, num, den)
        return pa.table({"a": pa.array([min(p) for p in out], pa.int64()), "b": pa.array([max(p) for p in out], pa.int64())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(name, label): the smallest name that each name of ``edges`` (a, b) reaches.

    Every round takes the smallest label around a name and then that label's own label; rounds are written.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    now = written(both.groupBy(F.col("a").alias("name")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        around = both.join(now.select(F.col("name").alias("b"), "label"), "b").groupBy(F.col("a").alias("name")).agg(F.min("label").alias("least"))
        step = now.join(around, "name").select("name", F.col("label").alias("old"), F.least("label", "least").alias("near"))
        jump = now.select(F.col("name").alias("near"), F.col("label").alias("far"))
        new = written(step.join(jump, "near", "left").select("name", "old", F.least("near", F.coalesce("far", "near")).alias("label")), "labels")
        changed = new.filter("old != label").limit(1).count()
        dropped(now)
        now = new.select("name", "label")
        if not changed:
            dropped(both)
            return now


def rooted(links: DataFrame) -> DataFrame:
    """(name, label) of links (a, b) with one a < b for each b: the root that each name leads to, by doubling of steps."""
    now = written(links.select(F.col("b").alias("name"), F.col("a").alias("label")), "labels")
    while True:
        step = now.join(now.select(F.col("name").alias("label"), F.col("label").alias("up")), "label", "left")
        new = written(step.select("name", F.coalesce("up", "label").alias("label"), F.col("up").isNotNull().alias("on")), "labels")
        dropped(now)
        on = new.filter("on").limit(1).count()
        now = new.select("name", "label")
        if not on:
            return now.union(now.select("label", "label").distinct())


def labelled(df: DataFrame, labels: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with the component of its sets ``col``; sets without links are their own."""
    return df.join(labels.select(F.col("name").alias(col), F.col("label").alias(out)), col, "left").withColumn(out, F.coalesce(out, F.col(col)))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links (a, b): only the components that these tie together are gone through."""
    between = labelled(labelled(links, labels, "a", "x"), labels, "b", "y").filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    tied = components(between)
    far = labels.join(tied.select(F.col("name").alias("label"), F.col("label").alias("far")), "label", "left").select("name", F.coalesce("far", "label").alias("label"))
    return written(far.union(tied.join(labels, "name", "left_anti").select("name", "label")), "labels")


def group_ties(groups: DataFrame, labels: DataFrame, docs: DataFrame, classes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between members of one group that tie different components together.

    ``groups``: (a, b, nb), the members b of each head a. Links with the head itself are known already. Large groups are
    cut into blocks, and each two of a group's blocks meet in a task; small groups share tasks.
    """
    members = written(labelled(groups, labels, "b", "lb"), "members")
    sizes = members.groupBy("a").agg(F.count("*").alias("m"), F.sum("nb").alias("f"), F.min("lb").alias("x"), F.max("lb").alias("y")).filter("x != y")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("f") / BLOCK_FEATURES)).cast("int")
    open_ = written(members.join(sizes.select("a", blocks.alias("blocks")), "a").select("a", "b", "lb", "blocks"), "open")
    total = open_.count()
    if not total:
        return open_.select("a", "b")
    ids = written(classes.join(open_.select(F.col("b").alias("name")).distinct(), "name", "left_semi").select(F.col("rep").alias("doc_id")), "ids")
    sets = written(feature_sets(docs, ids, size, True).dropDuplicates(["name"]).withColumnRenamed("name", "b"), "sets")
    mine, other = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = open_.withColumn("mine", mine).withColumn("other", other).join(sets, "b")
    small = F.col("blocks") == 1
    shared = F.pmod(F.xxhash64("a"), F.lit(-(-total // BIN))).cast("int")
    met = dealt.select(
        F.when(small, shared).otherwise(-1).alias("bin"), F.when(~small, F.col("a")).alias("big"), F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"),
        "a", (F.col("mine") <= F.col("other")).alias("low"), F.col("b").alias("name"), F.col("lb").alias("label"), "features",
    )
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(parts, "bin", "big", "p", "q").groupBy("bin", "big", "p", "q").applyInArrow(
        lambda rows: block_ties(num, den)(rows.select(["a", "low", "name", "label", "features"])), "a long, b long"
    )


def feature_sets(docs: DataFrame, ids: DataFrame, size: int, packed: bool = False) -> DataFrame:
    """(name, features) of the documents in ``ids`` (doc_id), one for each name; ``packed`` as bytes."""

    def run(batches):
        for b in batches:
            for _, _, data, offsets in chunks(b.column(1)):
                features, first = shingle_sets(data, offsets, size)
                held = pa.array(packed_features(features, first), pa.binary()) if packed else pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(features.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_names(features, first)), held], ["name", "features"])

    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return chosen.mapInArrow(run, f"name long, features {'binary' if packed else 'array<long>'}")


def linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose Jaccard similarity reaches the threshold."""
    names = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()
    ids = written(classes.join(names, "name", "left_semi").select(F.col("rep").alias("doc_id")), "ids")
    sets = written(feature_sets(docs, ids, size).dropDuplicates(["name"]), "sets")
    # The second set of a pair is rarely in another pair, so it travels to the first.
    there = pairs.select("a", "b").join(sets.select(F.col("name").alias("b"), F.col("features").alias("fb")), "b")
    met = there.join(sets.select(F.col("name").alias("a"), F.col("features").alias("fa")), "a")
    m = F.size(F.array_intersect("fa", "fb"))
    out = written(met.filter(m * den >= (F.size("fa") + F.size("fb") - m) * num).select("a", "b"), "links")
    dropped(ids)
    dropped(sets)
    return out


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: tuple[int, int] = (75, 100), miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    num, den = (threshold[0] // math.gcd(*threshold), threshold[1] // math.gcd(*threshold))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = written(docs.mapInArrow(described(size), "doc_id long, n long, name long, cells binary"), "described")
    total = seen.agg(F.sum("n")).first()[0] or 0
    own = seen.select("doc_id", F.col("n").alias("n_shingles"), "name")
    if not total:
        return own.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    by_name = seen.filter("n > 0").groupBy("name").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("cells").alias("cells"), F.count("*").alias("rows"))
    classes = written(by_name, "classes")
    buckets = max(64, total // BUCKET_SIGNATURES)
    sent = docs.mapInArrow(signed(size, num, den, buckets, miss), "bucket int, signatures binary, names binary")
    found = written(sent.groupBy("bucket").applyInPandas(bucket_pairs, PAIR_SCHEMA), "found")

    def side(x: str) -> DataFrame:
        return classes.select(F.col("name").alias(x), F.col("n").alias(f"n{x}"), F.col("cells").alias(f"h{x}"))

    pairs = found.groupBy("a", "b").agg(F.sum("shared").alias("shared")).join(side("b"), "b").join(side("a"), "a").select("a", "b", "shared", "na", "ha", "nb", "hb")
    groups = written(pairs.mapInArrow(head_bounds(num, den), "a long, b long, shared long, near boolean, nb long"), "groups")
    dropped(found)
    near = groups.filter("near").select("a", "b", "shared")
    # First each set with the head that it shares most signatures with, then the other heads while still apart.
    best = written(near.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b"), "best")
    labels = written(rooted(linked(best, docs, classes, size, num, den)), "labels")
    others = labelled(labelled(near.join(best, ["a", "b"], "left_anti"), labels, "a", "la"), labels, "b", "lb")
    others = written(others.filter("la != lb").select("a", "b"), "others")
    if others.limit(1).count():
        labels = merged(labels, linked(others, docs, classes, size, num, den))
    # Then members of one group that are still apart.
    ties = written(group_ties(groups, labels, docs, classes, size, num, den).distinct(), "ties")
    if ties.limit(1).count():
        labels = merged(labels, ties)
    reps = classes.join(labels, "name", "left").withColumn("label", F.coalesce("label", "name")).select("name", "rep", "rows", "label")
    low = reps.groupBy("label").agg(F.min("rep").alias("component_id"))
    final = written(reps.join(low, "label").select("name", "rows", "component_id"), "final")
    for table in (classes, groups, best, others, ties):
        dropped(table)
    return lookup(own, final, ["name"], "rows", seen.count(), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
