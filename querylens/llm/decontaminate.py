"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of ``window`` consecutive words (a shorter item is one pattern). For each pattern
length, a shift table indexed by a hash of the block of the last BLOCK words says how far the search may jump. Where the
shift is 0, the suffix bucket of that hash holds the patterns whose last block has it; those with the text's first word
are compared with the text, hash by hash and then byte by byte. All segments of all texts of a chunk advance together in
numpy, and only the words that a position looks at are hashed.

The benchmark is compiled in slices of at most SLICE_WORDS words, which are broadcast one by one. A worker holds one slice
at a time and searches BUFFER bytes of texts with it before it takes the next, so a benchmark of any size is searched
with bounded memory, in one operator and without a shuffle.

Edge cases: null or empty texts have no words, so they are never hit, and such items have no pattern; items with one
item_id count once, and all items that share a window are found (ties); repeated documents are searched one by one; texts
of any length are searched whole, one longer than a chunk alone; a null doc_id is kept; an empty benchmark hits nothing;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.llm._tokens import ALNUM, U, Words, chunks, gram_hash
from querylens.sources.scratch import spread

BLOCK = 2
TABLE_BITS = 18
SEGMENT = 256
SLICE_WORDS = 500_000
#: Bytes of texts that wait for all slices, and (place, pattern) candidates compared at once.
BUFFER, CANDIDATES = 32 << 20, 65_536


class Slice:
    """Some benchmark items: the words of all, and for each length the patterns."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        raw = [t.encode() for _, t in items]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw], dtype=np.int64)))
        words = Words(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, ALNUM)
        self.ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        self.hash, self.start, self.end, self.data = words.hash, words.start, words.end, words.data.tobytes()
        places: dict[int, list] = {}
        for k, (i, _) in enumerate(items):
            n = int(words.counts[k])
            if n:
                at = np.arange(words.first[k], words.first[k + 1] - min(window, n) + 1)
                places.setdefault(min(window, n), []).append((at, np.full(len(at), number[i])))
        self.patterns = [Patterns(self, m, *(np.concatenate(x) for x in zip(*g, strict=True))) for m, g in sorted(places.items())]

    def text(self, word: int, n: int) -> list[bytes]:
        return [self.data[self.start[k] : self.end[k]] for k in range(word, word + n)]


class Patterns:
    """Patterns of one length: shift table, suffix buckets, and the items of each pattern."""

    def __init__(self, held: Slice, length: int, at: np.ndarray, items: np.ndarray):
        self.length, self.block, self.held = length, min(BLOCK, length), held
        full = gram_hash(held.hash, length)[at]
        order = np.lexsort((items, full))
        at, items, full = at[order], items[order], full[order]
        new = np.concatenate(([True], full[1:] != full[:-1]))
        self.at, self.items, self.first = at[new], items, np.append(np.flatnonzero(new), len(items))
        limit = length - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, limit, dtype=np.int32)
        for k in range(limit):  # the block that ends k words before the pattern's end
            slot = self.slots(held.hash[self.at[:, None] + np.arange(length - k - self.block, length - k)])
            self.shift[slot] = np.minimum(self.shift[slot], k)
        # Suffix buckets: the patterns by the hash of their last block.
        slot = self.slots(held.hash[self.at[:, None] + np.arange(length - self.block, length)])
        self.bucket = np.argsort(slot, kind="stable")
        self.begin = np.searchsorted(slot[self.bucket], np.arange((1 << TABLE_BITS) + 1))

    @staticmethod
    def slots(blocks: np.ndarray) -> np.ndarray:
        x = blocks[:, 0]
        for k in range(1, blocks.shape[1]):
            x = x * U(0x9E3779B97F4A7C15) + blocks[:, k]
        return ((x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9) >> U(64 - TABLE_BITS)).astype(np.int64)

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word index where it begins, pattern) of every occurrence in the texts of ``w``."""
        n, m = w.counts, self.length
        docs = np.flatnonzero(n >= m)
        none = np.zeros(0, dtype=np.int64)
        if not len(docs):
            return none, none
        starts = n[docs] - m + 1
        segments = -(-starts // SEGMENT)
        owner = np.repeat(docs, segments)
        part = np.arange(segments.sum()) - np.repeat(np.cumsum(segments) - segments, segments)
        at = w.first[owner] + part * SEGMENT
        stop = np.minimum(at + SEGMENT, w.first[owner] + n[owner] - m + 1)
        places, slots = [none], [none]
        while len(at):
            tail = at[:, None] + np.arange(m - self.block, m)
            slot = self.slots(w.span_hash(w.start[tail], w.end[tail]))
            jump = self.shift[slot]
            zero = jump == 0
            if zero.any():
                places.append(at[zero])
                slots.append(slot[zero])
            at = at + np.maximum(jump, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        place, slot = np.concatenate(places), np.concatenate(slots)
        sizes = self.begin[slot + 1] - self.begin[slot]
        found = []
        cut = np.append(np.flatnonzero(np.diff(np.cumsum(sizes) // CANDIDATES, prepend=-1)), len(place))
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            found.append(self.confirmed(w, place[x:y], slot[x:y], sizes[x:y]))
        if not found:
            return none, none
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def confirmed(self, w: Words, place: np.ndarray, slot: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which patterns of their buckets begin at these places."""
        m, hashes = self.length, self.held.hash
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        pattern = self.bucket[np.repeat(self.begin[slot], sizes) + inside]
        place = np.repeat(place, sizes)
        same = w.span_hash(w.start[place], w.end[place]) == hashes[self.at[pattern]]  # the prefix is one word
        place, pattern = place[same], pattern[same]
        span = place[:, None] + np.arange(m)
        same = (w.span_hash(w.start[span], w.end[span]) == hashes[self.at[pattern][:, None] + np.arange(m)]).all(axis=1)
        place, pattern = place[same], pattern[same]
        sure = [[w.data[w.start[k] : w.end[k]].tobytes() for k in range(p, p + m)] == self.held.text(int(self.at[q]), m) for p, q in zip(place.tolist(), pattern.tolist(), strict=True)]
        sure = np.array(sure, dtype=bool)
        return place[sure], pattern[sure]


def searched(slices: list):
    """Arrow batches (doc_id, text) -> the texts' hits over all slices."""

    def groups(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if len(slices) == 1 or size >= BUFFER:
                yield held
                held, size = [], 0
        if held:
            yield held

    def search(w: Words, held: Slice, spans: dict, found: dict) -> None:
        for p in held.patterns:
            place, which = p.find(w)
            doc = np.searchsorted(w.first, place, side="right") - 1
            for d in np.unique(doc):
                mine = doc == d
                begin = np.unique(place[mine] - w.first[d])
                # Neighbouring windows run together.
                edge = np.flatnonzero(np.diff(begin) > p.length)
                spans.setdefault(int(d), []).extend(zip(begin[np.append(0, edge + 1)].tolist(), (begin[np.append(edge, len(begin) - 1)] + p.length).tolist(), strict=True))
                got = found.setdefault(int(d), set())
                for k in np.unique(which[mine]):
                    got.update(held.ids[x] for x in p.items[p.first[k] : p.first[k + 1]])

    def run(batches):
        for group in groups(batches):
            parts = [(b.column(0).slice(i, j - i), data, offsets, {}, {}) for b in group for i, j, data, offsets in chunks(b.column(1))]
            for one in slices:
                for _, data, offsets, spans, found in parts:
                    search(Words(data, offsets, ALNUM), one.value, spans, found)
                if len(slices) > 1:
                    vars(one).pop("_value", None)  # what .value has loaded
            for ids, data, offsets, spans, found in parts:
                docs = range(len(ids))
                yield summed_up(ids, Words(data, offsets, ALNUM).counts, [joined(spans.get(k, ())) for k in docs], [sorted(found.get(k, ())) for k in docs])

    return run


def joined(spans) -> list[list[int]]:
    """The union of half-open spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def summed_up(ids: pa.Array, counts: np.ndarray, spans: list, items: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            ids, pa.array(counts), pa.array([sum(y - x for x, y in s) for s in spans], pa.int64()), pa.array([len(x) for x in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([bool(s) for s in spans], pa.bool_()), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
        ],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
    )


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<long>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the hit word ranges ``spans``."""
    sc = docs.sparkSession.sparkContext
    held, words, slices = [], 0, []
    for row in benchmark.select(F.col(item_col).cast("string"), item_text).toLocalIterator():
        held.append((str(row[0]), row[1] or ""))
        words += 1 + len(held[-1][1]) // 6
        if words >= SLICE_WORDS:
            slices.append(sc.broadcast(Slice(held, window)))
            held, words = [], 0
    if held or not slices:
        slices.append(sc.broadcast(Slice(held, window)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(searched(slices), RESULT)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM bi),
di AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m),
h AS (SELECT doc_id, i, m, item_id FROM (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM di) JOIN p USING (m, g)),
k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
