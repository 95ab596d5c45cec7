"""Language-model scores from a log-frequency Bloom filter.

Unigram and bigram counts of all training texts are summed in buckets of the hash space. A count c becomes the level
1 + floor(log_b c); an n-gram is entered once for each level up to its own, and its count is read back by probing levels
until one is absent: b ** (level - 1), never more than the count but for false positives. Bigrams seen fewer than
``min_count`` times are left out; by default none is. Each bucket builds its own segment of the filter in its own task,
at BITS_PER_ENTRY bits an entry whatever their number; segments never leave their tasks, as a filter of all n-grams of a
large corpus is too large to send to each worker. Texts are cut into batches of about BATCH tokens, each batch sends its
distinct n-grams to their buckets, and the levels found there come back to the batch. No level above the largest that a
segment holds is probed.

A word's probability is interpolated: half the bigram's share of its context (where the context is known) and the rest
from the smoothed unigram. A bigram's count is taken from the low end of its level and its context's from the high end,
so that but for false positives the shares of a context never sum to more than 1, nor do the smoothed unigrams. The base
score uses exact counts: those of words frequent enough that there can be no more
than HOT of them are broadcast, the rest are joined to the texts' remaining words by a shuffle.

Edge cases: null and empty texts are one end token; repeated rows are learned and scored one by one; without training
texts the counts are 0 and V is 0, so that base terms are log10(1 / 1) = 0; a null id is in no fold and is learned from;
texts of any length are scored whole, a text longer than BATCH as a batch of its own; there are no ties; an empty table
gives an empty result; other columns are ignored. Words are named by 64-bit hashes; a bigram's hash is cut to 40 bits
within its bucket, far more than the filter's own false positives leave.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.llm._spark import lookup, written
from querylens.llm._tokens import NOT_WHITE, U, Words, chunks, mix, mix1, packed, unpacked
from querylens.sources.scratch import spread

END = U(mix1(0x656E64))
BASE = 2**0.5
BITS_PER_ENTRY, PROBES = 12, 4
SALT = np.arange(1, PROBES + 1, dtype=U) * U(0x9E3779B97F4A7C15)
HOT = 1_000_000
FLUSH = 3_000_000
#: Tokens of a batch of texts; a longer single text is a batch of its own.
BATCH = 1_000_000
WEIGHT = 0.5


def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts, each text's words followed by END; offsets of the texts)."""
    w = Words(data, offsets, NOT_WHITE)
    first = w.first + np.arange(len(w.first))
    out = np.full(first[-1], END, dtype=U)
    out[np.arange(len(w.start)) + w.docs()] = w.hash
    return out, first


def bigrams(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it; a text's first token follows END."""
    before = np.empty_like(tokens)
    before[1:], before[first[:-1]] = tokens[:-1], END
    return mix(before * U(0x9E3779B97F4A7C15) + tokens)


def cuts(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of sorted hashes begins, and the end."""
    return np.searchsorted((h >> U(40)) * U(buckets) >> U(24), np.arange(buckets + 1, dtype=U))


SHORT = 5


def short(h: np.ndarray) -> bytes:
    """The SHORT bytes of each bigram's hash that count inside its bucket."""
    return np.ascontiguousarray((h << U(8) >> U(64 - 8 * SHORT)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT]).tobytes()


def long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // SHORT, 8), dtype=np.uint8)
    out[:, :SHORT] = np.frombuffer(data, dtype=np.uint8).reshape(-1, SHORT)
    return out.reshape(-1).view("<u8").astype(U)


def counted(buckets: int):
    """Arrow batches (text) -> rows (bucket, kind, packed); kind 1, unigrams: hashes, then counts; 2, bigrams: short hashes, then counts of a byte."""

    def sent(parts: list[np.ndarray], kind: int):
        h, c = np.unique(np.concatenate(parts), return_counts=True)
        cut = cuts(h, buckets)
        if kind == 1:  # whole hashes, as they name words in the exact table
            rows = [np.stack([h[x:y], c[x:y].astype(U)]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        else:  # a larger count takes several entries of at most 255
            times = (c + 254) // 255
            last = np.cumsum(times) - 1
            some = np.full(int(times.sum()), 255, dtype=np.uint8)
            some[last] = c - 255 * (times - 1)
            h, cut = np.repeat(h, times), np.append(0, last + 1)[cut]
            rows = [np.concatenate([np.frombuffer(short(h[x:y]), dtype=np.uint8), some[x:y]]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        keep = [k for k, p in enumerate(rows) if p.size]
        return pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([kind] * len(keep), pa.int32()), pa.array([rows[k].tobytes() for k in keep], pa.binary())], ["bucket", "kind", "packed"])

    def run(batches):
        one, two, held = [], [], 0
        for b in batches:
            for _, _, data, offsets in chunks(b.column(0)):
                tokens, first = sequences(data, offsets)
                one.append(tokens)
                two.append(bigrams(tokens, first))
                held += len(tokens)
                if held >= FLUSH:
                    yield sent(one, 1)
                    yield sent(two, 2)
                    one, two, held = [], [], 0
        if held:
            yield sent(one, 1)
            yield sent(two, 2)

    return run


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def quantised(level: np.ndarray) -> np.ndarray:
    """The least count of each level; 0 of level 0."""
    return np.where(level > 0, BASE ** (level - 1.0), 0.0)


def ceiling(level: np.ndarray) -> np.ndarray:
    """The largest count of each level; 0 of level 0."""
    return np.where(level > 0, np.maximum(np.ceil(BASE ** level.astype(float) - 1e-6) - 1, 1.0), 0.0)


def entry(keys: np.ndarray, level) -> np.ndarray:
    return mix(keys + np.asarray(level, dtype=U) * U(0xC2B2AE3D27D4EB4F))


class Segment:
    """One bucket's part of the filter."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, U(len(bits) * 8)

    def spots(self, e: np.ndarray, k: int) -> np.ndarray:
        x = mix(e + SALT[k])
        return ((x >> U(32)) * self.size) >> U(32)

    def add(self, e: np.ndarray) -> None:
        for k in range(PROBES):
            s = self.spots(e, k)
            np.bitwise_or.at(self.bits, (s >> U(3)).astype(np.int64), (U(1) << (s & U(7))).astype(np.uint8))


class LogBloom:
    """Segments in one array; ``top`` is the largest level that they hold."""

    def __init__(self, segments: list, top: int):
        self.top = top
        self.sizes = np.array([len(s) for s in segments], dtype=np.int64)
        self.base = np.concatenate(([0], np.cumsum(self.sizes)))[:-1] * 8
        self.bits = np.frombuffer(b"".join(segments), dtype=np.uint8)

    def holds(self, bucket: np.ndarray, e: np.ndarray) -> np.ndarray:
        out = self.sizes[bucket] > 0
        size, base = (self.sizes * 8)[bucket].astype(U), self.base[bucket]
        on = np.flatnonzero(out)
        for k in range(PROBES):
            x = mix(e[on] + SALT[k])
            s = base[on] + (((x >> U(32)) * size[on]) >> U(32)).astype(np.int64)
            hit = (self.bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
            out[on[~hit]] = False
            on = on[hit]
        return out

    def counts(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The quantised count of each key; ``hashes`` say the buckets."""
        return quantised(self.levels(keys, hashes))

    def levels(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        bucket = ((hashes >> U(40)) * U(len(self.sizes)) >> U(24)).astype(np.int64)
        level = np.zeros(len(keys), dtype=np.int64)
        on = np.arange(len(keys))
        for step in range(1, self.top + 1):
            on = on[self.holds(bucket[on], entry(keys[on], step))]
            level[on] = step
        return level


def key1(h: np.ndarray) -> np.ndarray:
    return mix(h + U(11))


BODY = "batch long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, kinds binary, which binary"


def bodies():
    """Arrow batches (doc_id, held_out, text) -> one row a batch of texts: its distinct tokens by frequency, and where each token is in them.

    A batch is named by the number of its first text, so that ``batch`` plus a place numbers all texts.
    """

    def body(batch: int, held: list[tuple]):
        kinds, which, times = np.unique(np.concatenate([x[2] for x in held]), return_inverse=True, return_counts=True)
        # Tokens are written by rank of frequency, as small numbers pack better.
        order = np.argsort(-times, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        which, kinds = rank[which], kinds[order]
        lists = [pa.concat_arrays([x[0] for x in held]), pa.concat_arrays([x[1] for x in held]), pa.array(np.concatenate([x[3] for x in held]))]
        whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        return pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), *whole, pa.array([kinds.tobytes()], pa.binary()), pa.array([packed(which)], pa.binary())], ["batch", "doc_id", "held_out", "n_tokens", "kinds", "which"])

    def run(batches):
        at, held, size = TaskContext.get().partitionId() << 33, [], 0
        for b in batches:
            for i, j, data, offsets in chunks(b.column(2)):
                tokens, first = sequences(data, offsets)
                held.append((b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), tokens, np.diff(first)))
                size += len(tokens)
                if size >= BATCH:
                    yield body(at, held)
                    at, held, size = at + sum(len(x[3]) for x in held), [], 0
        if held:
            yield body(at, held)

    return run


def restored(n_tokens, kinds: bytes, which: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct tokens, places of tokens in them, offsets of texts, hashes of bigrams) of a body."""
    k = np.frombuffer(kinds, dtype=U)
    order = np.argsort(k)
    place = np.empty(len(k), dtype=np.uint32)
    place[order] = np.arange(len(k), dtype=np.uint32)
    k, w = k[order], place[unpacked(which)]
    first = np.concatenate(([0], np.cumsum(np.asarray(n_tokens, dtype=np.int64))))
    return k, w, first, bigrams(k[w], first)


def asked(buckets: int):
    """Arrow batches (batch, n_tokens, kinds, which) -> rows (bucket, batch, one, two): the n-grams that a batch asks a bucket for."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                kinds, _, _, grams = restored(b.column(1)[r].values, b.column(2)[r].as_py(), b.column(3)[r].as_py())
                grams = np.unique(grams)
                x, y = cuts(kinds, buckets), cuts(grams, buckets)
                keep = np.flatnonzero((np.diff(x) > 0) | (np.diff(y) > 0))
                one = [kinds[x[k] : x[k + 1]].tobytes() for k in keep]
                two = [short(grams[y[k] : y[k + 1]]) for k in keep]
                yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([b.column(0)[r].as_py()] * len(keep), pa.int64()), pa.array(one, pa.binary()), pa.array(two, pa.binary())], ["bucket", "batch", "one", "two"])

    return run


MODEL = pa.schema([("bucket", pa.int32()), ("h", pa.list_(pa.int64())), ("c", pa.list_(pa.int64())), ("batch", pa.int64()), ("one", pa.binary()), ("two", pa.binary())])


def merged(min_count: int):
    """A bucket's sums and what is asked of it -> chunks of its exact unigram counts, and the levels of each batch's n-grams."""

    def run(key, sums: pa.Table, requests: pa.Table) -> pa.Table:
        kinds, data = sums.column("kind").to_pylist(), sums.column("packed").to_pylist()
        one = [np.frombuffer(x, dtype=U).reshape(2, -1) for x, k in zip(data, kinds, strict=True) if k == 1]
        two = [(x[: len(x) // (SHORT + 1) * SHORT], x[len(x) // (SHORT + 1) * SHORT :]) for x, k in zip(data, kinds, strict=True) if k == 2]
        h, c = summed(np.concatenate([x[0] for x in one]), np.concatenate([x[1] for x in one])) if one else (np.zeros(0, dtype=U),) * 2
        g, d = summed(long(b"".join(x for x, _ in two)), np.frombuffer(b"".join(x for _, x in two), dtype=np.uint8).astype(U))
        g, d = g[d >= min_count], d[d >= min_count]
        keys, level = np.concatenate([key1(h), mix(g) + U(22)]), levels(np.concatenate([c, d]).astype(np.float64))
        segment = Segment(np.zeros(max(64, int(level.sum()) * BITS_PER_ENTRY) // 8 + 1, dtype=np.uint8))
        for k in range(1, int(level.max(initial=0)) + 1):
            segment.add(entry(keys[level >= k], k))
        bloom = LogBloom([segment.bits], int(level.max(initial=0)))
        rows = [{"h": h[i : i + 100_000].view(np.int64), "c": c[i : i + 100_000].view(np.int64)} for i in range(0, len(h), 100_000)]
        for batch, x, y in zip(*(requests.column(k).to_pylist() for k in ("batch", "one", "two")), strict=True):
            a, b = np.frombuffer(x, dtype=U), long(y)
            found = bloom.levels(np.concatenate([key1(a), mix(b) + U(22)]), np.zeros(len(a) + len(b), dtype=U)).astype(np.uint8)
            rows.append({"batch": batch, "one": found[: len(a)].tobytes(), "two": found[len(a) :].tobytes()})
        return pa.Table.from_pylist([{"bucket": key[0].as_py()} | r for r in rows], MODEL)

    return run


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts, starts)


SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_hot", pa.int64()), ("hot", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64()))])


def scored(hot, total: int, distinct: int):
    """A batch's body and the levels of its n-grams -> what is known of each text; rare words are left for the join."""

    def run(body: pa.Table, replies: pa.Table) -> pa.Table:
        hot_h, hot_c = hot.value
        floor = total + distinct + 1
        n_tokens = body.column("n_tokens").combine_chunks().flatten().to_numpy()
        kinds, which, first, pairs = restored(n_tokens, body.column("kinds")[0].as_py(), body.column("which")[0].as_py())
        # Buckets are ranges of the hash, so their replies in order are in the order of the sorted n-grams.
        replies = replies.sort_by("bucket")
        one, two = (np.frombuffer(b"".join(replies.column(k).to_pylist()), dtype=np.uint8).astype(np.int64) for k in ("one", "two"))
        c_one, c_two = quantised(one), quantised(two)[np.unique(pairs, return_inverse=True)[1]]
        before = np.empty_like(which)
        before[1:], before[first[:-1]] = which[:-1], int(np.searchsorted(kinds, END))
        context = ceiling(one)[before]
        share = np.where(context > 0, np.minimum(c_two / np.maximum(context, 1), 1.0), 0.0)  # a false positive may exceed its context
        weight = np.where(context > 0, WEIGHT, 0.0)
        p = weight * share + (1 - weight) * (np.minimum(c_one[which], total) + 1) / floor
        score = np.add.reduceat(np.log10(p), first[:-1])
        spot = np.minimum(np.searchsorted(hot_h, kinds), max(0, len(hot_h) - 1))
        known = hot_h[spot] == kinds if len(hot_h) else np.zeros(len(kinds), dtype=bool)
        exact = np.where(known, np.log10(np.where(known, hot_c[spot] if len(hot_c) else 0, 0) + 1.0), 0.0)
        base = np.add.reduceat(exact[which], first[:-1])
        n_hot = np.add.reduceat(known[which].astype(np.int64), first[:-1])
        rare = np.flatnonzero(~known[which])
        cut = np.searchsorted(rare, first).astype(np.int32)
        row = body.column("batch")[0].as_py() + np.arange(len(n_tokens))
        own = [body.column(k).combine_chunks().flatten() for k in ("doc_id", "held_out", "n_tokens")]
        return pa.Table.from_arrays([pa.array(row), *own, pa.array(n_hot), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(cut), pa.array(kinds[which[rare]].view(np.int64)))], schema=SCORED)

    return run


def ngram_lm(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = 1, fold: tuple[int, int] = (7, 2)) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sc = docs.sparkSession.sparkContext
    remainder = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(fold[0]))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(remainder == fold[1], F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    buckets = max(64, 2 * docs.rdd.getNumPartitions())
    sums = docs.filter("not held_out").select("text").mapInArrow(counted(buckets), "bucket int, kind int, packed binary")
    texts = written(docs.mapInArrow(bodies(), BODY), "bodies")
    requests = texts.select("batch", "n_tokens", "kinds", "which").mapInArrow(asked(buckets), "bucket int, batch long, one binary, two binary")
    model = written(sums.groupBy("bucket").cogroup(requests.groupBy("bucket")).applyInArrow(merged(min_count), "bucket int, h array<long>, c array<long>, batch long, one binary, two binary"), "counts")
    vocabulary = model.filter("h is not null").select(F.explode(F.arrays_zip("h", "c")).alias("x")).select("x.h", "x.c")
    about = vocabulary.agg(F.sum("c"), F.count("*")).first()
    total, distinct = int(about[0] or 0), int(about[1])
    # Counts above total / HOT: fewer than HOT words can have one.
    least = total // HOT + 1
    hot = vocabulary.filter(F.col("c") >= least).toArrow() if total else None
    hot_h = hot.column("h").to_numpy().view(U) if hot else np.zeros(0, dtype=U)
    hot_c = hot.column("c").to_numpy() if hot else np.zeros(0, dtype=np.int64)
    order = np.argsort(hot_h)
    shipped = sc.broadcast((hot_h[order], hot_c[order]))
    replies = model.filter("batch is not null").select("batch", "bucket", "one", "two")
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_hot long, hot double, score double, rare array<long>"
    first = written(texts.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(scored(shipped, total, distinct), schema), "scored")
    rare = first.select("row", F.explode("rare").alias("h"))
    exact = rare.join(vocabulary.filter(F.col("c") < least), "h").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count("*").alias("n_more"))
    out = first.join(exact, "row", "left")
    base = F.col("hot") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op7_ngram_lm(spark, sf_dir: str) -> DataFrame:
    return ngram_lm(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
