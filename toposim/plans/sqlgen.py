"""DuckDB SQL text for the oracle side of each query.

These helpers expand to plain DuckDB expressions (list lambdas), so the
oracle is an independent formulation of the same definition, not a
call back into Spark.
"""

from __future__ import annotations


def pad(s: str) -> str:
    return f"(' ' || {s} || ' ')"


def grams(s: str, n: int, padded: bool = True) -> str:
    p = pad(s) if padded else f"({s})"
    return f"list_transform(range(1, length({p}) - {n} + 2), lambda i: substr({p}, i, {n}))"


def skip_grams(s: str, k: int) -> str:
    p = pad(s)
    return (f"list_transform(range(1, length({p}) - {2 + k} + 2), "
            f"lambda i: substr({p}, i, 1) || substr({p}, i + {k + 1}, 1))")


def n_inter(a: str, b: str) -> str:
    return f"len(list_distinct(list_filter({a}, lambda x: list_contains({b}, x))))"


def n_union(a: str, b: str) -> str:
    return f"len(list_distinct(list_concat({a}, {b})))"


def jaccard(s1: str, s2: str) -> str:
    a = f"list_concat({grams(s1, 2)}, {grams(s1, 3)})"
    b = f"list_concat({grams(s2, 2)}, {grams(s2, 3)})"
    return f"(CAST({n_inter(a, b)} AS DOUBLE) / {n_union(a, b)})"


def cosine(s1: str, s2: str) -> str:
    a = f"list_concat({grams(s1, 2)}, {grams(s1, 3)})"
    b = f"list_concat({grams(s2, 2)}, {grams(s2, 3)})"

    def dot(x, y):
        return (f"coalesce(list_sum(list_transform(list_distinct({x}), "
                f"lambda g: len(list_filter({x}, lambda z: z = g)) * len(list_filter({y}, lambda z: z = g)))), 0)")
    den = f"(sqrt(CAST({dot(a, a)} AS DOUBLE)) * sqrt(CAST({dot(b, b)} AS DOUBLE)))"
    return (f"(CASE WHEN {den} = 0 THEN (CASE WHEN {s1} = {s2} THEN 1.0 ELSE 0.0 END) "
            f"ELSE CAST({dot(a, b)} AS DOUBLE) / {den} END)")


def dice(s1: str, s2: str) -> str:
    a = grams(s1, 2, padded=False)
    b = grams(s2, 2, padded=False)
    u = f"(len(list_distinct({a})) + len(list_distinct({b})))"
    return (f"(CASE WHEN {u} = 0 THEN (CASE WHEN {s1} = {s2} THEN 1.0 ELSE 0.0 END) "
            f"ELSE 2.0 * {n_inter(a, b)} / {u} END)")


def skipgram(s1: str, s2: str) -> str:
    a1, b1 = grams(s1, 2), grams(s2, 2)
    a2 = f"list_concat({skip_grams(s1, 1)}, {skip_grams(s1, 2)})"
    b2 = f"list_concat({skip_grams(s2, 1)}, {skip_grams(s1, 2)})"
    num = f"({n_inter(a1, b1)} + {n_inter(a2, b2)})"
    den = f"({n_union(a1, b1)} + {n_union(a2, b2)})"
    return (f"(CASE WHEN {den} = 0 THEN (CASE WHEN {s1} = {s2} THEN 1.0 ELSE 0.0 END) "
            f"ELSE CAST({num} AS DOUBLE) / {den} END)")


# DuckDB's jaro_similarity / damerau_levenshtein count UTF-8 bytes, not
# characters.  Edit and Jaro scores depend only on character equality, so
# the oracle maps the fixture's non-ASCII letters one-to-one onto ASCII
# symbols that never occur in names before calling them.
_BYTE_SAFE_FROM = "àéö"
_BYTE_SAFE_TO = "{}|"


def ascii_safe(s: str) -> str:
    return f"translate({s}, '{_BYTE_SAFE_FROM}', '{_BYTE_SAFE_TO}')"


def jw_from_jaro(s1: str, s2: str, j: str | None = None) -> str:
    """Jaro-Winkler from DuckDB's ``jaro_similarity`` (or ``j``) with the
    prefix rule written out: w > 0.7, both lengths > 3, common prefix up to
    4 that stops at a digit; an empty side scores 0."""
    j = j or f"jaro_similarity({ascii_safe(s1)}, {ascii_safe(s2)})"
    pre = (f"(CASE WHEN substr({s1},1,1) = substr({s2},1,1) AND NOT regexp_matches(substr({s1},1,1), '[0-9]') THEN "
           f"(CASE WHEN substr({s1},2,1) = substr({s2},2,1) AND NOT regexp_matches(substr({s1},2,1), '[0-9]') THEN "
           f"(CASE WHEN substr({s1},3,1) = substr({s2},3,1) AND NOT regexp_matches(substr({s1},3,1), '[0-9]') THEN "
           f"(CASE WHEN substr({s1},4,1) = substr({s2},4,1) AND NOT regexp_matches(substr({s1},4,1), '[0-9]') "
           f"THEN 4 ELSE 3 END) ELSE 2 END) ELSE 1 END) ELSE 0 END)")
    return (f"(CASE WHEN length({s1}) = 0 OR length({s2}) = 0 THEN 0.0 "
            f"WHEN {j} > 0.7 AND length({s1}) > 3 AND length({s2}) > 3 "
            f"THEN {j} + {pre} * 0.1::DOUBLE * (1.0 - {j}) ELSE {j} END)")


def jaro(s1: str, s2: str) -> str:
    return f"(CASE WHEN length({s1}) = 0 OR length({s2}) = 0 THEN 0.0 ELSE jaro_similarity({ascii_safe(s1)}, {ascii_safe(s2)}) END)"


def dl(s1: str, s2: str) -> str:
    return (f"(CASE WHEN greatest(length({s1}), length({s2})) = 0 THEN 1.0 ELSE "
            f"1.0 - CAST(damerau_levenshtein({ascii_safe(s1)}, {ascii_safe(s2)}) AS DOUBLE) / greatest(length({s1}), length({s2})) END)")


def r(x: str, d: int = 6) -> str:
    return f"round({x}, {d})"


def osa_ctes(src: str, key: str, a: str, b: str, name: str = "osa") -> str:
    """CTE text (to follow ``WITH RECURSIVE``) giving ``name(key, osa_d)``:
    optimal-string-alignment distance, one DP row per recursion step,
    each row folded left to right with ``list_reduce``."""
    return f"""{name}_src AS (SELECT {key} AS k, {a} AS a, {b} AS b FROM {src}),
{name}_dp(k, i, prev2, prev, a, b) AS (
  SELECT k, 0, CAST(NULL AS BIGINT[]), CAST(range(0, length(b) + 1) AS BIGINT[]), a, b FROM {name}_src
  UNION ALL
  SELECT k, i + 1, prev,
    list_reduce(range(1, length(b) + 1),
      lambda acc, j: list_append(acc, least(prev[j + 1] + 1, acc[j] + 1,
                       prev[j] + CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN 0 ELSE 1 END,
                       CASE WHEN i >= 1 AND j > 1 AND substr(a, i + 1, 1) = substr(b, j - 1, 1)
                                 AND substr(a, i, 1) = substr(b, j, 1) THEN prev2[j - 1] + 1
                            ELSE 1000000000 END)),
      [CAST(i + 1 AS BIGINT)]),
    a, b
  FROM {name}_dp WHERE i < length(a)),
{name} AS (SELECT k AS {key}, prev[length(b) + 1] AS osa_d,
           greatest(length(a), length(b)) AS osa_n FROM {name}_dp WHERE i = length(a))"""


def osa_sim(cte: str = "osa") -> str:
    return f"(CASE WHEN {cte}.osa_n = 0 THEN 1.0 ELSE 1.0 - CAST({cte}.osa_d AS DOUBLE) / {cte}.osa_n END)"


def tuned_ctes(src: str, key: str, a: str, b: str, name: str) -> str:
    """CTE text giving ``name(key, score)``: the tuned Jaro-Winkler.

    Characters are matched in the order of the first string, each with the
    first free equal one in the window; a matched pair out of order costs
    half.  The prefix is read up to four places, and after its first break
    one inserted, deleted or replaced character is passed over (in this
    order of preference) and one place more is read."""
    def run(i: str, k: str, limit: str) -> str:
        return (f"coalesce(list_min(list_filter(range(0, 7), lambda t: NOT ({i} + t < least({limit}, la) AND {k} + t < least({limit}, lb) "
                f"AND a[{i} + t + 1] = b[{k} + t + 1]))), 7)")

    def hit(i: str, k: str) -> str:
        return f"({i} < la AND {k} < lb AND coalesce(a[{i} + 1] = b[{k} + 1], false))"

    free = ("list_filter(range(greatest(1, z.i[1] - span), least(lb, z.i[1] + span) + 1), "
            "lambda p: b[p] = a[z.i[1]] AND NOT list_contains(acc.j, p))[1]")
    return f"""{name}_s AS (SELECT {key} AS k, string_split({a}, '') AS a, string_split({b}, '') AS b, length({a}) AS la, length({b}) AS lb FROM {src}),
{name}_w AS (SELECT *, greatest(greatest(la, lb) // 2 - 1, 0) AS span, greatest(la, lb) AS longest FROM {name}_s),
{name}_m AS (SELECT *, list_reduce(list_concat([{{'i': []::BIGINT[], 'j': []::BIGINT[]}}],
    list_transform(range(1, la + 1), lambda q: {{'i': [q], 'j': []::BIGINT[]}})),
    lambda acc, z: CASE WHEN {free} IS NULL THEN acc ELSE {{'i': list_append(acc.i, z.i[1]), 'j': list_append(acc.j, {free})}} END) AS g
  FROM {name}_w),
{name}_t AS (SELECT *, CAST(len(g.i) AS DOUBLE) AS m, len(list_filter(range(1, len(g.i) + 1), lambda p: a[g.i[p]] <> b[list_sort(g.j)[p]])) AS t FROM {name}_m),
{name}_j AS (SELECT *, CASE WHEN m = 0 THEN 0.0 ELSE (m / la + m / lb + (m - t / 2.0) / m) / 3.0 END AS w, least(longest, 4) AS lim FROM {name}_t),
{name}_p AS (SELECT *, {run('0', '0', 'lim')} AS r FROM {name}_j),
{name}_e AS (SELECT *, CASE WHEN NOT (la > 4 AND lb > 4 AND r < lim) THEN 0 WHEN {hit('r', 'r + 1')} THEN 1 WHEN {hit('r + 1', 'r')} THEN 2
    WHEN {hit('r + 1', 'r + 1')} THEN 3 ELSE 0 END AS edit FROM {name}_p),
{name}_n AS (SELECT *, r + [0, 1, 2, 2][edit + 1] AS i2, r + [0, 2, 1, 2][edit + 1] AS k2, CASE WHEN edit > 0 THEN least(lim + 1, longest) ELSE lim END AS lim2 FROM {name}_e),
{name}_q AS (SELECT *, CASE WHEN edit > 0 AND i2 < lim2 AND k2 < lim2 THEN {run('i2', 'k2', 'lim2')} ELSE 0 END AS more FROM {name}_n),
{name} AS (SELECT k AS {key}, CASE WHEN w > 0.7 AND la > 3 AND lb > 3 THEN w + (least(i2, k2) + more) * 0.1 * (1.0 - w) ELSE w END AS score FROM {name}_q)"""


def canon(s: str) -> str:
    """B2: lower -> strip accents -> transliteration -> delete punctuation."""
    from toposim.functions import text as T
    out = f"strip_accents(lower({s}))"
    for a, b in T.TRANSLIT:
        out = f"replace({out}, '{a}', '{b}')"
    cls = T.PUNCTUATION.replace("'", "''").replace("-", "\\-")
    return f"regexp_replace({out}, '[{cls}]', '', 'g')"


def str_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
