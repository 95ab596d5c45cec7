"""Token counts from pre-token frequencies.

A byte-level BPE never merges across pre-tokens, so a text's count is the sum over its pre-tokens of their piece
counts. Texts are cut into batches and reduced to their pre-token frequencies: a batch is one row with its distinct
pre-tokens, and for each text the places of its own among them and how often they occur. A hash deals pre-tokens to
buckets; a bucket gets those of all batches, encodes each distinct one of the corpus once, and its numbers of pieces are
joined back to the batches that hold it, whose frequencies are multiplied and summed. Ids are never kept. A batch holds a
pre-token once and sends tens of thousands, so no bucket is hot.

Pre-tokens of texts whose code points all lie below SAFE are cut by one regular expression; others by the library
itself, whose Unicode tables may differ from those of ``regex``. Special strings split a text first and count as one
token each, as the library does by default.

Edge cases: null and empty texts have 0 bytes and tokens; repeated rows are counted one by one; a text of any length is
read whole and lies in one batch; there are no ties; null ids are kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.llm._spark import written
from querylens.llm._tokens import packed, unpacked
from querylens.sources.scratch import spread

#: A batch ends with the text that brings it to so many distinct pre-tokens, or to so many (text, pre-token) entries.
KINDS, ENTRIES = 300_000, 4_000_000
#: Buckets of pre-tokens; one for each eight partitions if those are more.
LEAST_BUCKETS = 64
SAFE = 0x250
# Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PreTokens:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
            raise ValueError("only byte-level BPE files without normalizer and prefix space")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pattern = regex.compile(PATTERN)
        self.special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.unsafe = regex.compile(f"[^\\x00-{chr(SAFE - 1)}]")

    def pretokens(self, text: str) -> list[str]:
        if self.unsafe.search(text) is None:
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """(pre-token frequencies, special strings)."""
        if self.cut is None or self.cut.search(text) is None:
            return Counter(self.pretokens(text)), 0
        parts, freq = self.cut.split(text), Counter()
        for part in parts:
            freq.update(self.pretokens(part))
        return freq, len(parts) - 1

    def pieces(self, tokens: list[str]) -> list[int]:
        """The number of pieces of each pre-token."""
        return [len(x) for x in self.tokenizer.encode_batch_fast(tokens, add_special_tokens=False)]


BODY = "batch long, doc_id array<long>, n_bytes array<long>, special array<long>, distinct array<long>, which binary, times binary, kinds array<binary>"


def strings(tokens: list[str]) -> bytes:
    """Texts as one: lengths and characters, compressed."""
    raw = [x.encode() for x in tokens]
    lengths, data = packed(np.array([len(x) for x in raw], dtype=np.uint32)), b"".join(raw)
    return len(lengths).to_bytes(8, "little") + lengths + len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def listed(data: bytes) -> list[str]:
    n = int.from_bytes(data[:8], "little")
    end = np.cumsum(unpacked(data[8 : 8 + n]).astype(np.int64)).tolist()
    size = int.from_bytes(data[8 + n : 16 + n], "little")
    raw = pa.decompress(data[16 + n :], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    return [raw[a:b].decode() for a, b in zip([0, *end], end, strict=False)]


def frequencies(tokenizer: str, buckets: int):
    """Arrow batches (doc_id, text) -> one row a batch of texts: its distinct pre-tokens and those of each text.

    ``kinds`` has the pre-tokens of each bucket in order; a text's places count through all buckets, ascending, and
    ``which`` holds their steps.
    """

    def body(number: int, ids: list, lists: tuple, kinds: dict, which: array, times: array) -> pa.RecordBatch:
        def one(x: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

        dealt: list[list[str]] = [[] for _ in range(buckets)]
        for x in sorted(kinds):
            dealt[zlib.crc32(x.encode()) % buckets].append(x)
        place = np.empty(len(kinds), dtype=np.int64)
        place[[kinds[x] for part in dealt for x in part]] = np.arange(len(kinds))
        distinct = np.frombuffer(lists[2], dtype=np.int64)
        at, n = place[np.frombuffer(which, dtype=np.uint32)], np.frombuffer(times, dtype=np.uint32)
        order = np.lexsort((at, np.repeat(np.arange(len(distinct)), distinct)))
        at, n = at[order], n[order]
        step = np.diff(at, prepend=0)
        first = (np.cumsum(distinct) - distinct)[distinct > 0]
        step[first] = at[first]
        columns = [pa.array([number], pa.int64()), one(pa.concat_arrays(ids)), *(one(pa.array(np.frombuffer(x, dtype=np.int64))) for x in lists)]
        columns += [pa.array([packed(x.astype(np.uint32))], pa.binary()) for x in (step, n)]
        columns.append(one(pa.array([strings(part) for part in dealt], pa.binary())))
        return pa.RecordBatch.from_arrays(columns, ["batch", "doc_id", "n_bytes", "special", "distinct", "which", "times", "kinds"])

    def run(batches):
        cutter, number = PreTokens(tokenizer), TaskContext.get().partitionId() << 33
        ids, lists, kinds, which, times = [], (array("q"), array("q"), array("q")), {}, array("I"), array("I")
        for b in batches:
            texts, begin = b.column(1).fill_null(""), 0
            lengths = pc.binary_length(texts).to_pylist()
            for k in range(len(texts)):
                freq, special = cutter.frequencies(texts[k].as_py())
                which.extend([kinds.setdefault(x, len(kinds)) for x in freq])
                times.extend(freq.values())
                for out, x in zip(lists, (lengths[k], special, len(freq)), strict=True):
                    out.append(x)
                if len(kinds) >= KINDS or len(which) >= ENTRIES:
                    ids.append(b.column(0).slice(begin, k + 1 - begin))
                    yield body(number, ids, lists, kinds, which, times)
                    begin, number = k + 1, number + 1
                    ids, lists, kinds, which, times = [], (array("q"), array("q"), array("q")), {}, array("I"), array("I")
            if begin < len(texts):
                ids.append(b.column(0).slice(begin))
        if ids:
            yield body(number, ids, lists, kinds, which, times)

    return run


def encoded(tokenizer: str):
    """The pre-tokens (bucket, of, tokens) of one bucket -> (of, bucket, pieces): for each batch ``of`` their pieces in order."""

    def run(asked: pa.Table) -> pa.Table:
        cutter, known = PreTokens(tokenizer), {}
        out = []
        for row in range(len(asked)):
            tokens = listed(asked.column("tokens")[row].as_py())
            new = [x for x in tokens if x not in known]
            known.update(zip(new, cutter.pieces(new), strict=True))
            out.append(packed(np.array([known[x] for x in tokens], dtype=np.uint32)))
        return pa.table({"of": asked.column("of"), "bucket": asked.column("bucket"), "pieces": pa.array(out, pa.binary())})

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def summed(limit: int):
    """A batch's body and the pieces of its pre-tokens, a row a bucket -> its texts' counts."""

    def run(body: pa.Table, replies: pa.Table) -> pa.Table:
        ids, n_bytes, special, distinct = (body.column(k).combine_chunks().flatten() for k in ("doc_id", "n_bytes", "special", "distinct"))
        step, times = (unpacked(body.column(k)[0].as_py()).astype(np.int64) for k in ("which", "times"))
        pieces = np.concatenate([np.zeros(0, dtype=np.uint32), *(unpacked(x) for x in replies.sort_by("bucket").column("pieces").to_pylist())]).astype(np.int64)
        distinct = distinct.to_numpy()
        end = np.cumsum(distinct)
        # Steps begin anew with each text.
        run_on = np.cumsum(step)
        base = np.concatenate(([0], run_on))[end - distinct]
        sums = np.concatenate(([0], np.cumsum(pieces[run_on - np.repeat(base, distinct)] * times)))
        n = sums[end] - sums[end - distinct] + special.to_numpy()
        return pa.Table.from_arrays([ids, n_bytes, pa.array(n), pa.array(n > limit)], schema=RESULT)

    return run


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; ``tokenizer`` is a path that every worker has, as an installed file."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = max(LEAST_BUCKETS, docs.rdd.getNumPartitions() // 8)
    bodies = written(texts.mapInArrow(frequencies(tokenizer, buckets), BODY), "frequencies")
    asked = bodies.select(F.col("batch").alias("of"), F.posexplode("kinds").alias("bucket", "tokens"))
    replies = asked.groupBy("bucket").applyInArrow(encoded(tokenizer), "of long, bucket int, pieces binary")
    return bodies.drop("kinds").groupBy("batch").cogroup(replies.groupBy("of")).applyInArrow(summed(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), public_tokenizers.path("byte_bpe_50k.json"))
