"""Plain versions of the operators, row by row."""

import hashlib
import re

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return (text or "").encode().lower()  # bytes: only A-Z change


def shingles(text, size=5):
    w = SPACE.findall(low(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def components(rows, num=75, den=100):
    """{doc_id: (n_shingles, component)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                m = len(sets[a] & sets[b])
                if den * m >= num * (len(sets[a]) + len(sets[b]) - m):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def contamination(rows, items, window=10):
    grams = {}
    for item, text in items:
        w = ALNUM.findall(low(text))
        m = min(window, len(w))
        for k in range(len(w) - m + 1) if w else ():
            grams.setdefault(tuple(w[k : k + m]), set()).add(str(item))
    out = {}
    for i, text in rows:
        w = ALNUM.findall(low(text))
        hit, found = set(), set()
        for m in {len(g) for g in grams}:
            for k in range(len(w) - m + 1):
                got = grams.get(tuple(w[k : k + m]))
                if got:
                    hit.update(range(k, k + m))
                    found |= got
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def line_dedup(rows, min_chars=20, min_docs=3):
    """[(n_lines, n_dropped, kept text)] for each row."""

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({k: k + 32 for k in range(65, 91)})

    held = {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars and i is not None:
                held.setdefault(k, set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or not (len(held.get(key(x), ())) >= min_docs and i < max(held[key(x)]))]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for k in range(len(w) - 2):
        seen.setdefault(tuple(w[k : k + 3]), []).append(k)
    rep = {k + j for v in seen.values() if len(v) > 1 for k in v for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)
