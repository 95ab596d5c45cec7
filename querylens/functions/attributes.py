"""Attribute maps held in strings, and what items and queries say about colour, size and material."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querylens.functions.text import match_form, phrase_values

# Lexicons (value: its phrases). A phrase keeps its first place, its last value counts.
COLOURS = {
    "siyah": ("siyah", "black"),
    "beyaz": ("beyaz", "white", "krem", "ekru", "kırık beyaz"),
    "kırmızı": ("kırmızı", "kirmizi", "red", "bordo", "şarap", "sarap"),
    "mavi": ("mavi", "blue", "lacivert", "indigo", "navy", "deniz mavisi"),
    "yeşil": ("yeşil", "yesil", "green", "haki", "zeytin", "mint"),
    "sarı": ("sarı", "sari", "yellow", "gold", "altın"),
    "turuncu": ("turuncu", "orange"),
    "pembe": ("pembe", "pink", "fuşya", "fusya"),
    "mor": ("mor", "purple", "violet", "lila", "leylak"),
    "gri": ("gri", "gray", "grey", "antrasit", "füme", "fume", "gümüş", "gumus"),
    "kahverengi": ("kahverengi", "kahve", "brown", "taba", "tan", "camel", "bej", "beige"),
    "bej": ("bej", "beige", "kum", "krem"),
}
MATERIALS = {
    "deri": ("deri", "leather", "nubuk", "süet", "suede", "nappa"),
    "kumaş": ("kumaş", "fabric", "tekstil", "dokuma"),
    "pamuk": ("pamuk", "pamuklu", "cotton", "viskon", "viscose"),
    "polyester": ("polyester", "polyamid", "naylon", "nylon", "sentetik"),
    "yün": ("yün", "wool", "kaşmir", "cashmere", "angora"),
    "keten": ("keten", "linen"),
    "ipek": ("ipek", "silk", "saten", "satin"),
    "spandex": ("spandex", "elastan", "elastane", "likra", "lycra"),
}
GENDERS = {"kadın": ("kadın", "bayan", "women", "kız", "girl"), "erkek": ("erkek", "bay", "men", "boy")}
AGES = {"bebek": ("bebek", "baby", "infant"), "çocuk": ("çocuk", "cocuk", "kids", "kid", "child"), "genç": ("genç", "genc", "teen", "junior"), "yetişkin": ("yetişkin", "yetiskin", "adult")}
# The keys under which attributes name a colour, a size or a material.
COLOUR_KEYS = ("renk", "color", "colour", "ana renk", "primary color")
SIZE_KEYS = ("beden", "numara", "size", "no", "ayakkabı numarası", "beden/numara", "elbise bedeni", "pantolon bedeni")
MATERIAL_KEYS = ("materyal", "kumaş", "material", "fabric", "ana madde", "dış malzeme")


def lexicon(groups: dict[str, tuple[str, ...]]) -> dict[str, str]:
    return {phrase: value for value, phrases in groups.items() for phrase in phrases}


FLAT_KEY = r"(?:^|,)\s*([^,:{}]+?)\s*:"
FLAT_PAIR = r"(?:^|,)\s*([^,:{}]+?)\s*:\s*((?:(?!,\s*[^,:{}]+?\s*:).)*)"


def flat_map(c: Column) -> Column:
    """``k: v, k: v`` as a map of folded keys and values; a value may hold colons; the last of equal keys counts."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    pairs = F.arrays_zip(F.regexp_extract_all(low, F.lit(FLAT_PAIR), F.lit(1)).alias("k"), F.regexp_extract_all(low, F.lit(FLAT_PAIR), F.lit(2)).alias("v"))
    return last_wins(F.transform(pairs, lambda p: F.struct(F.trim(p["k"]).alias("k"), F.trim(p["v"]).alias("v"))))


def last_wins(entries: Column) -> Column:
    """A map of (k, v) structs in which the last of equal keys stays; blank keys go."""
    filled = F.filter(entries, lambda e: e["k"] != "")
    keys = F.array_distinct(F.transform(filled, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(filled, lambda e: e["k"] == k), -1)["v"]))


def literal_map(c: Column) -> Column:
    """Maps written as JSON or Python literals (single quotes, None, True, False); anything else is an empty map."""
    text = F.coalesce(c, F.lit(""))
    for python, json in (("None", "null"), ("True", "true"), ("False", "false")):
        text = F.regexp_replace(text, rf"(?<=[:\[,\s]){python}(?=\s*[,}}\]])", json)
    found = F.map_entries(F.from_json(text, "map<string,string>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"}))
    folded = F.transform(found, lambda e: F.struct(F.lower(F.trim(e["key"])).alias("k"), F.lower(F.trim(F.coalesce(e["value"], F.lit("none")))).alias("v")))
    return last_wins(F.coalesce(folded, F.array().cast("array<struct<k:string,v:string>>")))


def attribute_map(c: Column, literals: bool = True) -> Column:
    """Flat, JSON or Python-literal attributes as one map."""
    low = F.trim(F.coalesce(c, F.lit("")))
    return F.when(low.startswith("{"), literal_map(low)).otherwise(flat_map(c)) if literals else flat_map(c)


def attribute_value(m: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in keys], F.lit(""))


def flat_text(m: Column) -> Column:
    """``k v k v`` without anything but letters and digits."""
    entries = F.transform(F.map_entries(m), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    return F.trim(F.regexp_replace(F.lower(F.array_join(entries, " ")), r"[^\p{L}\p{N}]+", " "))


def known_or_raw(raw: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """The lexicon's value of what an item says, or the folded words themselves."""
    return F.coalesce(F.get(phrase_values(raw, lexicon(groups)), 0), F.lower(raw))


def item_colour(m: Column) -> Column:
    return known_or_raw(attribute_value(m, COLOUR_KEYS), COLOURS)


def item_material(m: Column) -> Column:
    return known_or_raw(attribute_value(m, MATERIAL_KEYS), MATERIALS)


# Patterns of sizes in queries with the group that holds the size, letter sizes, and numbers in items.
SIZE_PATTERNS = (
    (r"(?U)\b(xs|s|m|l|xl|xxl|xxxl|2xl|3xl)\b", 1),
    (r"(?U)\b(\d{1,2}[.,]?\d?)\s*(numara|no|beden|size)\b", 1),
    (r"(?U)\b(numara|beden|size)\s*:?\s*(\d{1,2}[.,]?\d?)\b", 2),
    (r"(?U)\b(\d{2,3})\s*cm\b", 1),
)
SIZE_LETTERS = ("xs", "s", "m", "l", "xl", "xxl", "xxxl", "2xl", "3xl")
SIZE_NUMBER = r"(?U)(\d{1,3}[.,]?\d?)"


def query_sizes(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    found = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), F.lit(g)) for p, g in SIZE_PATTERNS]))
    return F.array_distinct(F.transform(found, lambda x: F.replace(F.trim(x), F.lit(","), F.lit("."))))


def item_size(m: Column) -> Column:
    """The size attribute: a letter size, else its first number with a point, else what it says."""
    raw = F.trim(F.lower(attribute_value(m, SIZE_KEYS)))
    number = F.replace(F.regexp_extract(raw, SIZE_NUMBER, 1), F.lit(","), F.lit("."))
    return F.when(raw.isin(*SIZE_LETTERS) | (number == ""), raw).otherwise(number)


def query_colours(c: Column) -> Column:
    return phrase_values(c, lexicon(COLOURS))


def query_materials(c: Column) -> Column:
    return phrase_values(c, lexicon(MATERIALS))


def three_way(asked: Column, has: Column) -> Column:
    """0 if either side says nothing, 1 if the item's value is among those asked for, else -1."""
    return F.when((F.size(asked) == 0) | (F.coalesce(has, F.lit("")) == ""), 0).when(F.array_contains(asked, has), 1).otherwise(-1)


def gender_match(query: Column, gender: Column) -> Column:
    """-1, 0, 1; only if each side names exactly one gender."""
    asked = phrase_values(query, lexicon(GENDERS))
    own = F.filter(F.array(F.lit("kadın"), F.lit("erkek")), lambda g: F.contains(F.concat(F.lit(" "), match_form(gender), F.lit(" ")), F.concat(F.lit(" "), g, F.lit(" "))))
    return F.when((F.size(asked) != 1) | (F.size(own) != 1), 0).when(asked[0] == own[0], 1).otherwise(-1)


def age_match(query: Column, age: Column) -> Column:
    asked, own = phrase_values(query, lexicon(AGES)), phrase_values(age, lexicon(AGES))
    return F.when((F.size(asked) == 0) | (F.size(own) == 0), 0).when(F.arrays_overlap(asked, own), 1).otherwise(-1)


def piped_value(c: Column, key: str) -> Column:
    """The value of ``Key: value`` in a list split by ``|`` or ``;``."""
    return F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?i){key}\s*:\s*([^|;]+)", 1))
