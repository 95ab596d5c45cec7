"""SQL fragments that mirror the column functions and the logical tables, for comparison on another engine."""

from __future__ import annotations

from querylens.functions import attributes as A


def match(x: str) -> str:
    return rf"trim(regexp_replace(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '[^\pL\pN_]+', ' ', 'g'))"


def spaced(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g'))"


def split(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def tokens(x: str) -> str:
    return f"list_distinct({split(match(x))})"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0::DOUBLE END)"


def meet(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def jaccard(a: str, b: str) -> str:
    return ratio(meet(a, b), f"len(list_distinct(list_concat({a}, {b})))")


def coverage(a: str, b: str) -> str:
    return ratio(meet(a, b), f"len({a})")


def model_tokens(t: str) -> str:
    return f"list_filter({t}, lambda x: regexp_full_match(x, '[a-z0-9]{{3,}}') AND regexp_matches(x, '[0-9]'))"


def phrase(text: str, p: str) -> str:
    return f"({match(p)} <> '' AND contains(' ' || {match(text)} || ' ', ' ' || {match(p)} || ' '))"


def occurring(text: str, groups: dict[str, tuple[str, ...]]) -> str:
    """The values of all phrases that occur, in lexicon order."""
    entries = ", ".join(f"{{'p': ' {k} ', 'v': '{v}'}}" for k, v in A.lexicon(groups).items())
    return f"list_transform(list_filter([{entries}], lambda e: contains(' ' || {match(text)} || ' ', e.p)), lambda e: e.v)"


def values(text: str, groups: dict[str, tuple[str, ...]]) -> str:
    return f"list_distinct({occurring(text, groups)})"


def levels(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), '/'), lambda y: trim(y)), lambda y: y <> '')"


def _quoted(pattern: str) -> str:
    return "'" + pattern + "'"


def sizes(query: str) -> str:
    """What a query says about sizes, in the order of the patterns."""
    low = f"lower(coalesce({query}, ''))"
    return f"list_distinct(list_transform(flatten([{', '.join(f'regexp_extract_all({low}, {_quoted(p)}, {g})' for p, g in A.SIZE_PATTERNS)}]), lambda x: replace(trim(x), ',', '.')))".replace("(?U)", "")


def item_size(raw: str) -> str:
    low = f"trim(lower(coalesce({raw}, '')))"
    number = f"replace(regexp_extract({low}, '{A.SIZE_NUMBER}', 1), ',', '.')".replace("(?U)", "")
    return f"(CASE WHEN {low} IN ({', '.join(repr(x) for x in A.SIZE_LETTERS)}) THEN {low} WHEN {number} <> '' THEN {number} ELSE {low} END)"


def item_value(raw: str, groups: dict[str, tuple[str, ...]]) -> str:
    """The lexicon's value of an item, or what it says itself."""
    return f"coalesce({occurring(raw, groups)}[1], lower(coalesce({raw}, '')))"


def three_way(asked: str, has: str) -> str:
    return f"(CASE WHEN len({asked}) = 0 OR coalesce({has}, '') = '' THEN 0 WHEN list_contains({asked}, {has}) THEN 1 ELSE -1 END)"


CORPUS = "corpus AS (SELECT doc_id, text, lang || '/' || source AS category FROM documents)"
TERMS = f"terms AS (SELECT item_id AS query_id, {match('text')} AS query FROM benchmark)"
CATALOGUE = "catalogue AS (SELECT p_partkey AS item_id, p_name AS title, p_type || '/' || split_part(p_name, ' ', 2) AS category, p_brand AS brand, 'renk: ' || split_part(p_name, ' ', 1) || ', beden: ' || p_size AS attributes FROM part)"
PAIRS = "pairs AS (SELECT DISTINCT l_suppkey AS term_id, l_partkey AS item_id, 1 AS label FROM lineitem)"
PAIR_TERMS = "pair_terms AS (SELECT s_suppkey AS term_id, p_brand || ' ' || p_name || ' ' || p_size || ' beden' AS query FROM supplier JOIN part ON p_partkey = s_suppkey)"
SCORED = """scored AS (SELECT user_id AS term_id, event_id AS item_id, (event_type = 'purchase')::INT AS label, round(least(value / 100.0, 1.0), 6) AS p,
 round(least(greatest(json_extract_string(props, '$.k')::DOUBLE / 100.0, 0.0), 1.0), 6) AS q, (user_id % 5)::INT AS fold, ts, value, event_type FROM events)"""
LABELLED = "labelled AS (SELECT source AS term_id, doc_id AS item_id, quality AS label, round(1 - 1 / (1 + n_chars / 1000.0), 6) AS score, lang || '/' || source AS item_category, text AS query_text FROM documents JOIN labels USING (doc_id))"


def f1(tp: str, fp: str, fn: str) -> str:
    return f"(CASE WHEN 2 * {tp} + {fp} + {fn} > 0 THEN 2.0::DOUBLE * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0.0 END)"


MACRO = f"(({f1('tp', 'fp', 'fn')} + {f1('tn', 'fn', 'fp')}) / 2)"


def counts(y: str, hat: str) -> str:
    return ", ".join(f"sum(({y} = {a} AND {hat} = {b})::INT)::BIGINT AS {n}" for n, a, b in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0)))


def curve(keys: str, source: str, p: str = "p") -> str:
    """tp, fp, fn, tn at each distinct probability."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""pts AS (SELECT {k}{p} AS threshold, sum(label)::BIGINT AS pos, count(*) AS n FROM {source} GROUP BY ALL),
 cum AS (SELECT {k}threshold, sum(pos) OVER w AS tp, sum(n) OVER w AS taken, sum(pos) OVER (w2) AS pp, sum(n) OVER (w2) AS nn FROM pts WINDOW w AS ({part} ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING), w2 AS ({part})),
 cv AS (SELECT {k}threshold, tp::BIGINT AS tp, (taken - tp)::BIGINT AS fp, (pp - tp)::BIGINT AS fn, (nn - pp - taken + tp)::BIGINT AS tn FROM cum)"""


def bm25(doc_tokens: str, query_tokens: str, idf: str, k1: float, b: float, ratio_: float | None, top: int) -> str:
    if idf == "okapi":
        w, kept = "ln((n - df + 0.5) / (df + 0.5) + 1)", ""
    else:
        w = "CASE WHEN ln(n - df + 0.5) - ln(df + 0.5) < 0 THEN 0.25 * mean ELSE ln(n - df + 0.5) - ln(df + 0.5) END"
        kept = f"WHERE df <= {'floor(n * %s)' % ratio_ if idf == 'eligible' else 'n * %s::DOUBLE' % ratio_}" if ratio_ else ""
    mean = f"(SELECT avg(ln(n - df + 0.5) - ln(df + 0.5)) FROM d, c {kept if idf == 'eligible' else ''})"
    return f"""WITH {CORPUS}, {TERMS},
 t AS (SELECT doc_id, {doc_tokens} AS t FROM corpus), c AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM t),
 x AS (SELECT doc_id, token, any_value(dl) AS dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM t) GROUP BY doc_id, token),
 d AS (SELECT token, count(*) AS df FROM x GROUP BY token), m AS (SELECT {mean if idf != 'okapi' else '0.0'} AS mean),
 i AS (SELECT token, {w} AS idf FROM d, c, m {kept}),
 q AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({query_tokens}) AS token FROM terms) GROUP BY ALL),
 s AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) AS score FROM q JOIN i USING (token) JOIN x USING (token), c GROUP BY ALL HAVING score > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
 SELECT query_id, doc_id, score, rank FROM r WHERE rank <= {top}"""
