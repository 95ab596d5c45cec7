"""Counterfactually regularised toxicity classifier.

Labelled training rows, at most ``sample_rows`` of them in the order of a hash of their id, are reduced to sets of hashed
features: words, and their beginnings of PREFIXES bytes. Features whose share differs between the labels by more than
``min_z`` standard errors stay; they are counted on the executors and only those that stay reach the driver. In every
labelled text that mentions a group, each mentioned word is swapped for SWAPS other words of its family, the swapped text
is reduced to features anew, and what the swap takes away and adds makes a counterfactual row. A logistic model is fitted
on the driver with a ridge penalty and a counterfactual one, the mean squared change of the log odds over these rows, so
neutral mentions do not raise a score.

The sample is bounded by its parameter and the features by FEATURE_BITS, so is the model, which is broadcast. Scoring
is one pass over Arrow batches of whole texts. Labels, lang, source and doc_id are never features.

Edge cases: null and empty texts score the model's intercept; without labelled rows of both kinds the score is the
share of toxic training rows (0 without any); several labels of a document count as their largest, null labels do not
count; repeated rows are scored one by one, and each is learned from if its id is in the sample; ties of the hash go to
the smaller id; texts of any length are scored whole, one longer than a chunk alone; null ids are kept, in no fold; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.llm._spark import written
from querylens.llm._tokens import ALNUM, U, Words, chunks, mix, word_hash
from querylens.sources.scratch import spread

FEATURE_BITS = 22
PREFIXES = (5, 6, 8)
#: Words that a mention is swapped for in turn.
SWAPS = 2
# Words that name groups, by family; within a family they are swapped for each other.
GROUPS = {
    "gender": "women men woman man girls boys female male transgender nonbinary frauen männer femmes hommes mujeres hombres",
    "religion": "muslim muslims christian christians jewish jews hindu hindus buddhist buddhists atheist atheists musulmans chrétiens juifs christen juden moslems musulmanes cristianos judíos",
    "origin": "black white asian african american european mexican chinese arab latino immigrants refugees noirs blancs schwarze weiße negros blancos",
    "orientation": "gay lesbian bisexual straight heterosexual homosexual queer",
    "ability": "deaf blind disabled autistic paralyzed",
    "age": "elderly young teenage old",
}


def features_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) pairs, each once, ordered."""
    w = Words(data, offsets, ALNUM)
    owner = w.docs().astype(U)
    found = [w.hash]
    for k in PREFIXES:
        longer = w.end - w.start > k
        found.append(np.where(longer, w.span_hash(w.start, np.minimum(w.end, w.start + k)) + U(k), w.hash))
    key = np.unique(np.concatenate([(owner << U(FEATURE_BITS)) | (mix(h) >> U(64 - FEATURE_BITS)) for h in found]))
    return (key >> U(FEATURE_BITS)).astype(np.int64), (key & U((1 << FEATURE_BITS) - 1)).astype(np.int64)


class Mentions:
    """The words that name groups, by hash, and the others of their families."""

    def __init__(self):
        families = [[w.encode() for w in words.split()] for words in GROUPS.values()]
        self.others = {word_hash(w): [x for x in f if x != w] for f in families for w in f}
        self.hashes = np.array(sorted(self.others), dtype=U)

    def swapped(self, w: Words, doc: int) -> list[bytes]:
        """The text with each word that it mentions swapped everywhere, for SWAPS others in turn."""
        first, last = w.first[doc], w.first[doc + 1]
        hashes = w.hash[first:last]
        out = []
        for h in np.unique(hashes[np.isin(hashes, self.hashes)]):
            at = first + np.flatnonzero(hashes == h)
            others = self.others[int(h)]
            begin, end = w.start[first], w.end[last - 1]
            cut = [begin, *np.stack([w.start[at], w.end[at]], axis=1).ravel().tolist(), end]
            parts = [w.data[x:y].tobytes() for x, y in zip(cut[0::2], cut[1::2], strict=True)]
            # Which others come first differs from text to text.
            turn = int(np.bitwise_xor.reduce(hashes) % U(len(others)))
            out += [others[(turn + k) % len(others)].join(parts) for k in range(min(SWAPS, len(others)))]
        return out


def feature_counts(batches):
    """Arrow batches (text, toxic) -> (feature, n, n_toxic): in how many texts a feature is."""
    n, toxic = np.zeros(1 << FEATURE_BITS, dtype=np.int64), np.zeros(1 << FEATURE_BITS, dtype=np.int64)
    for b in batches:
        y = b.column(1).to_numpy(zero_copy_only=False)
        for i, _, data, offsets in chunks(b.column(0)):
            owner, feature = features_of(data, offsets)
            n += np.bincount(feature, minlength=len(n))
            toxic += np.bincount(feature[y[i + owner] > 0], minlength=len(n))
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(toxic[some])], ["feature", "n", "n_toxic"])


ROWS = "toxic int, columns array<int>, minus array<array<int>>, plus array<array<int>>"


def model_rows(chosen):
    """Arrow batches (text, toxic) -> the columns that a text has, and which each of its swaps takes away and adds."""

    def run(batches):
        column = np.full(1 << FEATURE_BITS, -1, dtype=np.int32)
        column[chosen.value] = np.arange(len(chosen.value), dtype=np.int32)
        mentions = Mentions()

        def kept(feature: np.ndarray) -> np.ndarray:
            c = column[feature]
            return c[c >= 0]

        for b in batches:
            out = []
            for i, j, data, offsets in chunks(b.column(0)):
                owner, feature = features_of(data, offsets)
                cut = np.searchsorted(owner, np.arange(j - i + 1))
                w = Words(data, offsets, ALNUM)
                named = set(w.docs()[np.isin(w.hash, mentions.hashes)].tolist())
                for d in range(j - i):
                    own = kept(feature[cut[d] : cut[d + 1]])
                    swaps = []
                    for text in mentions.swapped(w, d) if d in named else ():
                        other = kept(features_of(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))[1])
                        swaps.append((np.setdiff1d(own, other).tolist(), np.setdiff1d(other, own).tolist()))
                    swaps = [x for x in swaps if x[0] or x[1]]
                    out.append({"toxic": b.column(1)[i + d].as_py(), "columns": own.tolist(), "minus": [x for x, _ in swaps], "plus": [x for _, x in swaps]})
            yield from pa.Table.from_pylist(out, ROW_SCHEMA).to_batches()

    return run


ROW_SCHEMA = pa.schema([("toxic", pa.int32()), ("columns", pa.list_(pa.int32())), ("minus", pa.list_(pa.list_(pa.int32()))), ("plus", pa.list_(pa.list_(pa.int32())))])


def ragged(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(list index, value) of all values."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return owner, np.array([v for x in lists for v in x], dtype=np.int64)


class Model:
    def __init__(self, features: np.ndarray, weights: np.ndarray, intercept: float):
        self.weight = np.zeros(1 << FEATURE_BITS, dtype=np.float32)
        self.weight[features] = weights
        self.intercept = intercept

    def score(self, owner: np.ndarray, feature: np.ndarray, docs: int) -> np.ndarray:
        z = self.intercept + np.bincount(owner, weights=self.weight[feature], minlength=docs)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(chosen: np.ndarray, y: np.ndarray, columns: list[list[int]], minus: list[list[int]], plus: list[list[int]], ridge: float = 0.03, counterfactual: float = 1.0, steps: int = 800) -> Model:
    """The model of rows with labels ``y`` and ``columns`` (places in ``chosen``); (minus, plus) are the swaps' changes."""
    n, pos = len(y), int(y.sum())
    neg = n - pos
    if not pos or not neg:
        share = pos / n if n else 0.0
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log((share + 1e-12) / (1 - share + 1e-12))))
    size = len(chosen)
    row, col = ragged(columns)
    (r1, c1), (r2, c2) = ragged(minus), ragged(plus)
    # Counterfactual rows: -1 where the swap takes a feature away, 1 where it adds one.
    swap, at = np.concatenate([r1, r2]), np.concatenate([c1, c2])
    sign = np.concatenate([np.full(len(r1), -1.0), np.ones(len(r2))])
    w, bias = np.zeros(size), float(np.log(pos / neg))
    weight = np.where(y == 1, n / (2 * pos), n / (2 * neg))
    square = np.zeros(size + 1)
    for _ in range(steps):  # AdaGrad on the whole sample
        margin = bias + np.bincount(row, weights=w[col], minlength=n)
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y) / n
        grad = np.bincount(col, weights=error[row], minlength=size) + ridge * w / n
        if counterfactual and len(minus):
            change = np.bincount(swap, weights=sign * w[at], minlength=len(minus))
            grad += 2 * counterfactual / len(minus) * np.bincount(at, weights=sign * change[swap], minlength=size)
        full = np.append(grad, error.sum())
        square += full**2
        step = 0.3 * full / np.sqrt(square + 1e-12)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(chosen, w, bias)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 20_000, threshold: float = 0.7, fold: tuple[int, int] = (3, 1), min_z: float = 4.0, counterfactual: float = 1.0) -> DataFrame:
    """doc_id, held_out, score, predicted; rows of the fold's remainder are never learned from."""
    sc = docs.sparkSession.sparkContext

    def held_out(c):
        return F.coalesce(F.pmod(F.crc32(c.cast("string")), F.lit(fold[0])) == fold[1], F.lit(False))

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = written(docs.join(F.broadcast(ids), "doc_id").select("text", "toxic"), "labelled")
    about = sample.agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("long")).alias("pos")).first()
    n, pos = int(about["n"]), int(about["pos"] or 0)
    counts = sample.mapInArrow(feature_counts, "feature int, n long, n_toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("t"))
    p = F.col("n") / F.lit(max(1, n))
    apart = F.col("t") / F.lit(max(1, pos)) - (F.col("n") - F.col("t")) / F.lit(max(1, n - pos))
    z = apart / F.sqrt(F.greatest(p * (1 - p), F.lit(1 / max(1, n))) * F.lit(1 / max(1, pos) + 1 / max(1, n - pos)))
    chosen = np.sort(counts.filter((F.abs(z) >= min_z) & (F.col("n") >= 3)).select("feature").toArrow().column("feature").to_numpy().astype(np.int64))
    rows = sample.mapInArrow(model_rows(sc.broadcast(chosen)), ROWS).toArrow()
    swaps = [x for m in ("minus", "plus") for x in [[y for z in rows.column(m).to_pylist() for y in z]]]
    y = (rows.column("toxic").to_numpy() > 0).astype(np.float64)
    model = sc.broadcast(fit(chosen, y, rows.column("columns").to_pylist(), *swaps, counterfactual=counterfactual))

    def scored(batches):
        m = model.value
        for b in batches:
            for i, j, data, offsets in chunks(b.column(2)):
                s = m.score(*features_of(data, offsets), j - i)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
