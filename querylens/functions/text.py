"""Column functions on text: normalisers, token sets, phrases, categories, string similarities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def match_form(c: Column) -> Column:
    """Folded text whose words are runs of letters, digits and underscores, one space apart."""
    folded = F.replace(F.lower(_text(c)), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", " "))


def spaced_form(c: Column) -> Column:
    """Lower case with single spaces; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(_text(c)), r"\s+", " "))


def turkish_lower(c: Column) -> Column:
    return F.lower(F.translate(_text(c), "İI", "iı"))


def search_form(c: Column) -> Column:
    """Turkish lower case, ASCII punctuation as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(turkish_lower(c), ASCII_PUNCTUATION, " "), r"\s+", " "))


def words(form: Column) -> Column:
    """All words of a normalised text, repeats kept."""
    return F.filter(F.split(form, " "), lambda x: x != "")


def token_set(c: Column) -> Column:
    return F.array_distinct(words(match_form(c)))


def category_levels(c: Column) -> Column:
    return F.filter(F.transform(F.split(_text(c), "/"), F.trim), lambda x: x != "")


def category_level(levels: Column, i: int) -> Column:
    return F.coalesce(F.get(levels, i - 1), F.lit(""))


def category_key(c: Column) -> Column:
    """The first two levels, folded."""
    return F.array_join(F.slice(category_levels(F.lower(_text(c))), 1, 2), "/")


def flat_category(c: Column) -> Column:
    return F.replace(_text(c), F.lit("/"), F.lit(" "))


def holds_phrase(text: Column, phrase: Column) -> Column:
    """Whole-word containment of normalised forms; an empty phrase is nowhere."""
    t, p = match_form(text), match_form(phrase)
    return (p != "") & F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" ")))


def phrase_values(text: Column, lexicon: dict[str, str]) -> Column:
    """Distinct values of the lexicon's phrases that occur, in lexicon order."""
    padded = F.concat(F.lit(" "), match_form(text), F.lit(" "))
    entries = F.array(*[F.struct(F.lit(f" {p} ").alias("p"), F.lit(v).alias("v")) for p, v in lexicon.items()])
    return F.array_distinct(F.transform(F.filter(entries, lambda e: F.contains(padded, e["p"])), lambda e: e["v"]))


def first_phrase_value(text: Column, lexicon: dict[str, str], default: str = "") -> Column:
    return F.coalesce(F.get(phrase_values(text, lexicon), 0), F.lit(default))


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def share_of_first(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a|: coverage with the query first, precision with the document first."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(a))


def model_tokens(tokens: Column) -> Column:
    """Tokens of three or more ASCII letters and digits with at least one digit."""
    return F.filter(tokens, lambda x: x.rlike("^[a-z0-9]{3,}$") & x.rlike("[0-9]"))


def any_shared(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b).cast("int")


def both_but_disjoint(a: Column, b: Column) -> Column:
    return ((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)).cast("int")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def char_ngrams(c: Column, n: int) -> Column:
    """Distinct runs of n characters; a shorter text is its own. Characters are cut out once, so long texts take linear time."""
    chars = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    grams = chars
    for k in range(2, n + 1):
        grams = F.zip_with(grams, F.slice(chars, k, F.greatest(F.size(chars), F.lit(1))), lambda x, y: F.concat(x, y))
    every = F.filter(grams, lambda x: x.isNotNull())
    return F.array_distinct(F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.length(c) < n, F.array(c)).otherwise(every))


def char_ngram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    return jaccard(char_ngrams(a, n), char_ngrams(b, n))


def char_codes(c: Column) -> Column:
    """The code points of a text, each plus one."""
    return F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), lambda x: F.ascii(x).cast("long") + 1)


def gram_codes(codes: Column, n: int) -> Column:
    """``char_ngrams`` of ``char_codes`` for n of 3 at most, each run as one long of 21 bits a character.

    Longs are equal where the runs are, and Spark intersects arrays of them in compiled code.
    """
    if not 1 <= n <= 3:
        raise ValueError("a long holds three characters")
    grams = codes
    for k in range(2, n + 1):
        grams = F.zip_with(grams, F.slice(codes, k, F.greatest(F.size(codes), F.lit(1))), lambda x, y: F.shiftleft(x, 21) + y)
    own = F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 21) + x)
    every = F.filter(grams, lambda x: x.isNotNull())
    return F.array_distinct(F.when(F.size(codes).between(1, n - 1), F.array(own)).otherwise(every))


def set_jaccard(a: Column, b: Column) -> Column:
    """``jaccard`` of arrays without repeats, from one intersection: no branch keeps Spark from sharing it."""
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def category_overlap(a: Column, b: Column, form=lambda c: F.lower(_text(c))) -> Column:
    """Length of the shared path prefix over the deeper path's depth; levels are compared in their ``form``."""
    x, y = (F.filter(F.transform(F.split(_text(c), "/"), lambda p: F.trim(form(p))), lambda p: p != "") for c in (a, b))
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    prefix = F.aggregate(same, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, e: F.struct((s["on"] & e).alias("on"), (s["n"] + (s["on"] & e).cast("int")).alias("n")), lambda s: s["n"])
    return ratio(prefix, F.greatest(F.size(x), F.size(y)))
