"""Toxicity, licence scans, HTML extraction, language model and token counts."""

import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from querylens.llm import html_extract as H
from querylens.llm import license_scan as LI
from querylens.llm import ngram_lm as LM
from querylens.llm import token_counts as TC
from querylens.llm import toxicity as TX


def held(i, n):
    return zlib.crc32(str(i).encode()) % n


# --- Token counts


@pytest.fixture(scope="module")
def tokenizer_path():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.json")


def test_token_counts(spark, edge_docs, edge_rows, no_docs, tokenizer_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path)
    got = {r["doc_id"]: tuple(r)[1:] for r in TC.token_counts(edge_docs, tokenizer_path).collect()}
    for i, text, *_ in edge_rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert got[i] == (len((text or "").encode()), n, n > 512)
    assert TC.token_counts(no_docs, tokenizer_path).count() == 0


def odd_texts():
    rng = random.Random(1)
    texts = ["a<|endoftext|>b  <|endoftext|>", "don't we'll  I'M\n\n x", "数据   　x", "１２３ ²½ Ⅷ", "é ​ x", "\U0001f600 ok", "   a b", "<|endoftext"]
    return texts + ["".join(rng.choice("ab 1.'\n\t éß  数") for _ in range(60)) for _ in range(200)]


@pytest.mark.parametrize(("kinds", "entries"), [(100_000, 2_000_000), (20, 2_000_000), (100_000, 30)])
def test_token_counts_equal_the_library(spark, tokenizer_path, monkeypatch, kinds, entries):
    """Whether a partition is one batch or many, each text counts as the library has it."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(TC, "KINDS", kinds)
    monkeypatch.setattr(TC, "ENTRIES", entries)
    t = Tokenizer.from_file(tokenizer_path)
    rows = list(enumerate(odd_texts())) + [(None, "no id"), (3, "twice 3")]
    got = Counter((r["doc_id"], r["n_tokens"]) for r in TC.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path).collect())
    assert got == Counter((i, len(t.encode(x, add_special_tokens=False).ids)) for i, x in rows)


def test_each_pre_token_is_encoded_once(tokenizer_path, monkeypatch):
    seen, own = [], TC.PreTokens.pieces
    monkeypatch.setattr(TC.PreTokens, "pieces", lambda self, tokens: seen.extend(tokens) or own(self, tokens))
    asked = pa.table({"bucket": [4, 4, 4], "of": [1, 2, 3], "tokens": [TC.strings(x) for x in (["one", " two"], [" two", "three"], [])]})
    out = TC.encoded(tokenizer_path)(asked).to_pylist()
    assert seen == ["one", " two", "three"] and [TC.unpacked(r["pieces"]).tolist() for r in out] == [[1, 1], [1, 1], []]
    assert [(r["of"], r["bucket"]) for r in out] == [(1, 4), (2, 4), (3, 4)]


def test_packed_strings():
    for tokens in ([], [""], ["a", "\0", "é 数", "x" * 1000, ""]):
        assert TC.listed(TC.strings(tokens)) == tokens


@pytest.mark.parametrize("values", [[], [0], [1, 65535, 65536, 2**32 - 1, 7]])
def test_packed_numbers(values):
    x = np.array(values, dtype=np.uint32)
    assert TC.unpacked(TC.packed(x)).tolist() == values


# --- Licence scans


def test_license_base(edge_docs, edge_rows, no_docs):
    got = {r["doc_id"]: r for r in LI.license_scan(edge_docs).collect()}
    for i, text, *_ in edge_rows:
        w = brute.ALNUM.findall(brute.low(text))
        at, labels = [], set()
        for p, label in LI.PHRASES.items():
            seq = [x.encode() for x in p.split()]
            for k in range(len(w) - len(seq) + 1):
                if w[k : k + len(seq)] == seq:
                    at.append(k)
                    labels.add(label)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == ((min(at), max(at)) if at else (None, None))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert LI.license_scan(no_docs).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a b c", 1.0), ("a x b c", 1.0), ("a x y z b c", None), ("a x y b c more", 1.0), ("a b", None), ("a o b c", 1.0), ("a x y b d c", None),
    ],
)
def test_automaton(text, want):
    from querylens.llm._tokens import word_hash

    a = LI.Automaton("a [o] {2} b [p q] c")
    got = a.run([word_hash(x.encode()) for x in text.split()])
    assert got == 1.0 if want == 1.0 else got < 1.0


@pytest.mark.parametrize(
    ("template", "text", "want"),
    [
        ("permission [is] hereby granted", "x permission hereby granted y", 1.0), ("permission [is] hereby granted", "x permission is hereby granted", 1.0), ("permission [is] hereby granted", "permission was hereby granted", 0.0),
        ("[the] mit (license|licence) [ok]", "MIT licence", 1.0), ("{2} granted {3}", "granted", 1.0), ("mit {2} license", "mit a b license", 1.0), ("mit {2} license", "mit a b c license", 0.5), ("(a|b) [c] {1} d", "b d", 1.0), ("one", "one", 1.0),
    ],
)
def test_templates_are_started_wherever_they_can_begin(spark, template, text, want):
    """Against a regular expression of the same template, on words split at blanks."""
    got = LI.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1), templates={"t": template}).first()
    assert got["score"] == want and got["labels"] == ("t" if want == 1.0 else "")


def test_templates_need_a_mandatory_word(spark):
    for template in ("", "[a b] {3}"):
        with pytest.raises(ValueError, match="mandatory"):
            LI.Automaton(template)


def as_pattern(template):
    """The template as a regular expression over words followed by a blank each."""
    out = ""
    for optional, free, choice, word in LI._PART.findall(template):
        out += f"(?:{''.join(f'(?:{x}) ' for x in optional.split())})?" if optional else f"(?:\\S+ ){{0,{free}}}" if free else f"(?:{choice or word}) "
    return re.compile("(?:^| )" + out)


def test_shipped_templates_against_regular_expressions(spark):
    """Each template's own wording with names filled in, alone, within other words, and with a word changed."""
    rng, rows = random.Random(6), []
    for t in LI.TEMPLATES.values():
        text = ""
        for optional, free, choice, word in LI._PART.findall(t):
            text += (optional.replace("|", " ").split(" ")[0] + " " if optional and "|" in optional else optional + " " if optional and rng.random() < 0.5 else "") + ("Jane Q " if free else "") + ((choice.split("|")[-1] if choice else word) + " " if not optional and not free else "")
        w = text.split()
        bad = [*w[: len(w) // 2], "other", *w[len(w) // 2 + 1 :]]
        rows += [(len(rows), text), (len(rows) + 1, "We say: " + text.upper() + ". End"), (len(rows) + 2, " ".join(bad))]
    got = {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in LI.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words = " ".join(x.decode() for x in brute.ALNUM.findall(brute.low(text))) + " "
        base = {label for p, label in LI.PHRASES.items() if f" {p} " in " " + words}
        assert got[i] == base | {label for label, t in LI.TEMPLATES.items() if as_pattern(t).search(words)}, text
        assert i % 3 == 2 or list(LI.TEMPLATES)[i // 3] in got[i]


def test_template_needs_all_mandatory_words(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0 (the License)"), (2, "Licensed under the Apache License"), (3, "licensed under CC BY-NC 4.0"), (4, "nothing")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in LI.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("apache,apache-2.0", 1.0) and got[3][0] == "cc-by,cc-by-variant"
    assert got[2][0] == "apache" and 0.5 <= got[2][1] < 1 and got[4] == ("", 0.0)


# --- Language model


def test_lm_base_is_exact(edge_docs, edge_rows, no_docs, monkeypatch):
    for hot in (1_000_000, 3):  # all words broadcast, or nearly none
        monkeypatch.setattr(LM, "HOT", hot)
        counts = Counter()
        tokens = [(i, [*brute.SPACE.findall(brute.low(t)), b" end"]) for i, t, *_ in edge_rows]
        for i, t in tokens:
            if held(i, 7) != 2:
                counts.update(t)
        n, v = sum(counts.values()), len(counts)
        got = {r["doc_id"]: r for r in LM.ngram_lm(edge_docs).collect()}
        for i, t in tokens:
            r = got[i]
            assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i, 7) == 2, len(t), sum(w in counts for w in t), n)
            assert r["score"] < 0
    assert LM.ngram_lm(no_docs).count() == 0


def test_bloom_never_undercounts_a_level():
    rng = np.random.default_rng(1)
    keys, counts = LM.mix(np.arange(5000, dtype=np.uint64)), rng.integers(1, 3000, 5000)
    level = LM.levels(counts.astype(float))
    s = LM.Segment(np.zeros(int(level.sum()) * LM.BITS_PER_ENTRY // 8, dtype=np.uint8))
    for k in range(1, int(level.max()) + 1):
        s.add(LM.entry(keys[level >= k], k))
    bloom = LM.LogBloom([s.bits.tobytes()], int(level.max()))
    got = bloom.counts(keys, keys)
    exact = LM.BASE ** (level - 1.0)
    assert (got >= exact * (1 - 1e-12)).all() and (got <= exact * 1.0001).mean() > 0.95 and (exact <= counts * (1 + 1e-9)).all()
    assert (bloom.counts(LM.mix(keys + np.uint64(10**9)), keys) > 0).mean() < 0.05


def plain_scores(rows, least):
    """Scores from exact counts, rounded down to levels, contexts up; {doc_id: score}."""
    one, two = Counter(), Counter()
    tokens = [(i, [*brute.SPACE.findall(brute.low(t)), b" end"]) for i, t in rows]
    for i, t in tokens:
        if held(i, 7) != 2:
            one.update(t)
            two.update(zip([b" end", *t], t))
    n, v = sum(one.values()), len(one)
    step = lambda c: LM.BASE ** math.floor(2 * math.log2(c) + 1e-9) if c else 0.0
    high = lambda c: math.ceil(step(c) * LM.BASE - 1e-6) - 1 if c else 0
    out = {}
    for i, t in tokens:
        score = 0.0
        for a, b in zip([b" end", *t], t):
            context = high(one[a])
            share = min(1.0, step(two[a, b] if two[a, b] >= least else 0) / context) if context else 0.0
            w = LM.WEIGHT if context else 0.0
            score += math.log10(w * share + (1 - w) * (min(step(one[b]), n) + 1) / (n + v + 1))
        out[i] = score
    return out


def test_lm_scores_against_a_plain_version(spark, edge_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(LM, "BITS_PER_ENTRY", 64)  # no false positives at this size
    want = plain_scores([(i, t) for i, t, *_ in edge_rows], 2)
    for size in (1_000_000, 50):  # one batch a partition, or many
        monkeypatch.setattr(LM, "BATCH", size)
        got = {r["doc_id"]: r["score"] for r in LM.ngram_lm(edge_docs, min_count=2).collect()}
        assert all(got[i] == pytest.approx(want[i], rel=1e-3) for i in want)


def test_lm_knows_bigrams_seen_once(spark, edge_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(LM, "BITS_PER_ENTRY", 64)
    rows = [(i, t) for i, t, *_ in edge_rows]
    want, without = plain_scores(rows, 1), plain_scores(rows, 2)
    got = {r["doc_id"]: r["score"] for r in LM.ngram_lm(edge_docs).collect()}
    assert all(got[i] == pytest.approx(want[i], rel=1e-3) for i in want)
    assert any(want[i] > 0.9 * without[i] for i in want)


def test_segments_grow_with_their_entries():
    n = 1_000_000  # of one bucket in 64, where the whole filter was held to 2**29 bits
    keys = LM.mix(np.arange(n + 100_000, dtype=np.uint64))
    sums = pa.table({"kind": [2], "packed": [LM.short(keys[:n]) + bytes([4]) * n]})
    asked = pa.table({"batch": [7], "one": [b""], "two": [LM.short(keys)]})
    out = LM.merged(2)((pa.scalar(3),), sums, asked).to_pylist()
    level = np.frombuffer(out[0]["two"], dtype=np.uint8)
    assert (out[0]["bucket"], out[0]["batch"]) == (3, 7) and (level[:n] >= 5).all()
    assert (level[:n] == 5).mean() > 0.98 and (level[n:] > 0).mean() < 0.02


def test_full_segment_ends():
    bloom = LM.LogBloom([b"\xff" * 100], 9)
    keys = LM.mix(np.arange(10, dtype=np.uint64))
    assert bloom.levels(keys, keys).tolist() == [9] * 10


def test_shares_and_unigrams_sum_to_one_at_most():
    """For any counts: low ends of the bigrams' levels over the high end of the context's."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        counts = rng.integers(1, rng.integers(2, 500), rng.integers(1, 40))
        level, context = LM.levels(counts.astype(float)), LM.levels(np.array([float(counts.sum())]))
        assert (LM.quantised(level) / LM.ceiling(context)).sum() <= 1 + 1e-9
        assert (LM.quantised(level) <= counts + 1e-9).all() and (LM.ceiling(level) >= counts).all()
        total = counts.sum()
        assert ((LM.quantised(level) + 1) / (total + len(counts) + 1)).sum() <= 1


def test_counts_over_a_byte(spark):
    rows = [(i, " ".join(["x"] * n)) for i, n in ((0, 700), (1, 256), (3, 511))]
    want = plain_scores(rows, 1)
    got = {r["doc_id"]: r["score"] for r in LM.ngram_lm(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == pytest.approx(want[i], rel=1e-3) for i in want)


def test_lm_beats_the_base_on_held_out_text(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        w, out = rng.randrange(50), []
        for _ in range(60):
            w = (w * 7 + rng.randrange(3)) % 50
            out.append(f"w{w}")
        rows.append((i, " ".join(out)))
    got = [r for r in LM.ngram_lm(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert len(got) > 20 and sum(r["score"] for r in got) > 0.85 * sum(r["base_score"] for r in got)


# --- Toxicity


def labelled(spark, n=600):
    rng, docs, labels = random.Random(4), [], []
    for i in range(n):
        bad = i % 5 == 0
        w = [f"w{rng.randrange(400)}" for _ in range(40)] + (["women"] if rng.random() < (0.6 if bad else 0.2) else [])
        if bad:
            w += rng.sample(["idiot", "scum", "moron", "loser"], 2)
        rng.shuffle(w)
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in TX.toxicity(docs, labels).collect()}
    assert all(r["held_out"] == (held(i, 3) == 1) and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    test = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["predicted"] == int(i % 5 == 0) for i in test) / len(test) > 0.97


def test_mentions_do_not_raise_scores(spark):
    docs, labels = labelled(spark)
    rows = [(10_000 + k, f"w1 w2 w3 {x}", None) for k, x in enumerate(["women", "men", "plain"])]
    more = docs.unionByName(spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string"))
    s = [r["score"] for r in TX.toxicity(more, labels).filter("doc_id >= 10000").orderBy("doc_id").collect()]
    assert abs(s[0] - s[1]) < 0.1 and max(s) < 0.5


def test_swapped_texts():
    from querylens.llm._tokens import ALNUM, Words

    text = "Women and the women's, deaf MEN".encode()
    w = Words(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), ALNUM)
    out = [x.decode() for x in TX.Mentions().swapped(w, 0)]
    assert len(out) == 3 * TX.SWAPS and len(set(out)) == len(out)
    for x in out:
        a, b = text.decode().lower().split(), x.split()
        changed = [(p, q) for p, q in zip(a, b, strict=True) if p != q]
        assert changed and len({p.strip("',s") for p, _ in changed}) == 1


def test_swaps_reduce_false_positives_on_neutral_mentions(spark):
    """A group word that stands mostly in toxic texts: without the penalty its neutral mentions score as toxic."""
    rng, docs, labels = random.Random(8), [], []
    for i in range(900):
        bad = i % 3 == 0
        w = [f"w{rng.randrange(300)}" for _ in range(12)] + (["muslim"] if rng.random() < (0.9 if bad else 0.03) else []) + (["christian"] if rng.random() < 0.2 else [])
        w += rng.sample(["idiot", "scum", "moron", "loser"], 1) if bad and rng.random() < 0.8 else []
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    neutral = [(5000 + k, " ".join([f"w{rng.randrange(300)}" for _ in range(12)] + ["muslim"])) for k in range(60)]
    plain = [(7000 + k, " ".join(f"w{rng.randrange(300)}" for _ in range(12))) for k in range(60)]
    df, ls = spark.createDataFrame(docs + neutral + plain, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    wrong, gap = {}, {}
    for c in (0.0, 1.0):
        got = {r["doc_id"]: r for r in TX.toxicity(df, ls, counterfactual=c).collect()}
        wrong[c] = sum(got[i]["predicted"] for i, _ in neutral)
        gap[c] = sum(got[i]["score"] for i, _ in neutral) / 60 - sum(got[i]["score"] for i, _ in plain) / 60
        test = [i for i, _ in docs if got[i]["held_out"]]
        assert sum(got[i]["predicted"] for i in test if i % 3 == 0) > 0.6 * sum(i % 3 == 0 for i in test)
    assert wrong[1.0] < 0.25 * wrong[0.0] and gap[1.0] < 0.5 * gap[0.0]


def test_toxicity_edges(spark, edge_docs, edge_rows, no_docs):
    _, labels = labelled(spark, 20)
    labels = labels.union(spark.createDataFrame([(3, None), (None, 1), (6, 1), (6, 0)], "doc_id long, toxic int"))
    for ls in (labels, labels.limit(0), labels.filter("toxic = 1")):
        got = TX.toxicity(edge_docs, ls).collect()
        assert len(got) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert TX.toxicity(no_docs, labels).count() == 0


# --- HTML


PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></ul></nav><!-- x --><div class='{c}'><h2>Head &amp; line {n}</h2><p><b>First   part {n}<br>second &lt;b&gt; {n}<p>Third <i>it</i>em {n}</div>{extra}<div class=cookie-notice>We use cookies</div><form>name<input></form><footer>&copy; all</footer>"


def test_pages(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.format(c="box", n=i, extra="<div class='x7'><p>Buy our things today</p></div>")) for i in range(12)]
    rows += [(100, "http://b.example/x", PAGE.format(c="box", n=7, extra="<div id='comments'><p>reader says</p></div><aside>side</aside>")), (101, None, None), (102, "", ""), (103, "u", "no markup &amp; text\n x"), (100, "http://b.example/x", "<p>again"), (104, "http://c.example/", "<article><header><h1>A</h1></header><p>one<p>two<div class=share>tell</div></article><div>outside</div><p>cut &am")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "text", "n", "low", "node")})
    out = H.html_extract(df).collect()
    assert len(out) == len(rows)
    body = lambda n: f"Head & line {n}\nFirst part {n}\nsecond <b> {n}\nThird item {n}"
    by = {}
    for r in out:
        by.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    for i in range(12):  # what all pages of the host repeat is gone, without any telling name
        assert by[i] == [body(i)]
    assert sorted(by[100]) == sorted([body(7), "again"])
    assert (by[101], by[102], by[103], by[104]) == ([""], [""], ["no markup & text x"], ["A\none\ntwo"])
    assert H.html_extract(df.limit(0)).count() == 0


def test_importance_counts_inside_and_outside_articles(spark):
    page = "<body><article><h1>Head {n}</h1><p>First {n}<p>Second {n}<div class=x7><p>Buy our things today</p></div></article><div class=xb>Body {n}</div><div class=xc>Open all day</div></body>"
    rows = [(i, f"https://a.example/{i}", page.format(n=i)) for i in range(12)] + [(100, "http://b.example/", "<article><p class=q>one</p></article><div class=r>outside</div>")]
    got = {r["page_id"]: r["text"] for r in H.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == f"Head {i}\nFirst {i}\nSecond {i}\nBody {i}"
    assert got[100] == "one"  # nothing is known of its nodes


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p><b title='it's'>bold</b> on", "bold on"), ('<p>a<a href="x>y">b</a>c', "abc"), ('<p>a<a href="x>b</a> c', "ab c"), ("<p>1 < 2 <3 & x", "1 < 2 <3 & x"), ("<p>one<svg/><p>two", "one\ntwo"),
        ("<p>a<select><option>b", "a\nb"), ("<p>a<script>if (a<b) x='</p>'", "a"), ("<p>a<script>x</SCRIPT >b", "ab"), ("<p>a<!-->b<!-- c", "ab"), ("<p>a</><b", "a"), ("<p>a<!doctype x>b<?php x ?>c", "abc"),
        ("<p title=a>b>c</p>", "b>c"), ("<p>a<noscript>x</noscript>b", "ab"), ("<p>x<br/>y<img src='a>b'/>z", "x\nyz"), ("<P CLASS=a>x<DIV>y</DIV>", "x\ny"), ('<p>say "a>b" <i x="1" y=\'"\'>c</i>', 'say "a>b" c'),
    ],
)
def test_markup(page, want):
    assert H.page_text(page, {}, 0.35) == want


@pytest.mark.parametrize("page", ["<a href=\"x'>" * 80_000, "<a href='x\">y " * 70_000, "<a " * 300_000, "<a b='c\" " * 100_000, "<select><p>x" * 80_000, "<b>" * 300_000 + "x", "<div><p>x" * 100_000, "<!-- " * 200_000, "<" * 10**6, "<svg>x<math>" * 80_000, "<li><b>" * 120_000, "<p ='\">" * 120_000])
def test_broken_pages_take_time_in_proportion(page):
    """About 1 MB of each; quadratic reading would take hours."""
    import time

    began = time.process_time()
    H.page_text(page, {}, 0.35)
    assert time.process_time() - began < 30


def test_tree_decides_without_article_tags(spark, sf_dir):
    """With every <article> a <div>, the tree alone finds the main text of nearly all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    plain = pages.withColumn("html", F.regexp_replace("html", "(</?)(?:article|main)\\b", "$1div"))
    with_tags = {r["page_id"]: r["text"].split("\n") for r in H.html_extract(pages).collect()}
    without = {r["page_id"]: r["text"].split("\n") for r in H.html_extract(plain).collect()}
    kept = sum(len(set(with_tags[i]) & set(without[i])) for i in with_tags)
    assert kept >= 0.95 * sum(len(set(x)) for x in with_tags.values())
    assert kept >= 0.9 * sum(len(set(x)) for x in without.values())


def test_salted_hosts_give_the_same(spark, sf_dir, monkeypatch):
    want = sorted(map(tuple, H.op6_html_extract(spark, sf_dir).collect()))
    monkeypatch.setattr(H, "BROADCAST_NODES", 0)
    monkeypatch.setattr(H, "SALT_PAGES", 3)
    assert sorted(map(tuple, H.op6_html_extract(spark, sf_dir).collect())) == want


def test_all_pages_of_the_sample(spark, sf_dir):
    got = {r["page_id"]: r["text"] for r in H.op6_html_extract(spark, sf_dir).collect()}
    import html

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)
        parts = re.split(r"</?(?:p|h1|br)>", m[1]) if m else []
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in parts]
        assert got[r["page_id"]] == "\n".join(x for x in blocks if x)
