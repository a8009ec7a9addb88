"""Queries of the subpackage in the SQL of an independent engine, where SQL can express them."""

from rosterline.llm import quality
from rosterline.llm.common import ORACLES

WORD = "[^\\x20\\x09-\\x0D]+"

# --- op 10 -------------------------------------------------------------------------
_VALUES = {
    "word_length": "word_chars / greatest(n_words, 1)", "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)", "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
}
_SHARES = {"q10": 0.1, "q50": 0.5, "q90": 0.9}


def _quantiles(name: str, source: str, keys: str) -> str:
    picks = ", ".join(
        f"min(value) FILTER (WHERE upto >= ceil(total * CAST({q} AS DOUBLE))) AS {c}" for c, q in _SHARES.items()
    )
    return (
        f"{name} AS (SELECT {keys}, feature, any_value(total) AS total, {picks} FROM (SELECT *, CASE WHEN bucket IS NULL THEN 0.0 ELSE pow(CAST({quality.GAMMA} AS DOUBLE), bucket - 0.5) END AS value,"
        f" sum(n) OVER (PARTITION BY {keys}, feature ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY {keys}, feature) AS total FROM {source}) GROUP BY {keys}, feature)"
    )


def _quality() -> str:
    each = " UNION ALL ".join(f"SELECT r, lang, source, base_failed, '{f}' AS feature, CAST({v} AS DOUBLE) AS v FROM counted" for f, v in _VALUES.items())
    floors = "CASE o.feature " + " ".join(f"WHEN '{f}' THEN CAST({x} AS DOUBLE)" for f, x in quality.LEAST_SPREAD.items()) + " END"
    weight = f"(o.total / (o.total + CAST({quality.EVEN_ROWS} AS DOUBLE)))"
    pick = {c: f"({weight} * o.{c} + (1 - {weight}) * l.{c})" for c in _SHARES}
    return (
        f"WITH words AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),"
        " grams AS (SELECT r, i, w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)),"
        " repeats AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),"
        " covered AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM repeats) GROUP BY r),"
        f" lined AS (SELECT *, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines FROM words),"
        " counted AS (SELECT r, doc_id, lang, source, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,"
        " CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,"
        " coalesce(c.n, 0) AS n_repeat_words, length(regexp_replace(t, '\\P{Lu}', '', 'g')) AS n_upper,"
        " len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed FROM lined LEFT JOIN covered c USING (r)),"
        f" measured AS ({each}),"
        f" sketch AS (SELECT lang, source, feature, CASE WHEN v > 0 THEN CAST(ceil(ln(v) / ln(CAST({quality.GAMMA} AS DOUBLE))) AS INT) END AS bucket, count(*) AS n FROM measured WHERE NOT base_failed GROUP BY ALL),"
        " merged AS (SELECT lang, feature, bucket, sum(n) AS n FROM sketch GROUP BY ALL),"
        f" {_quantiles('own', 'sketch', 'lang, source')}, {_quantiles('wide', 'merged', 'lang')},"
        f" limits AS (SELECT o.lang, o.source, o.feature, {pick['q50']} - {quality.WIDTH} * greatest({pick['q50']} - {pick['q10']}, {floors}) AS low,"
        f" {pick['q50']} + {quality.WIDTH} * greatest({pick['q90']} - {pick['q50']}, {floors}) AS high"
        " FROM own o JOIN wide l ON l.lang IS NOT DISTINCT FROM o.lang AND l.feature = o.feature),"
        " judged AS (SELECT m.r, bool_and(coalesce(v BETWEEN low AND high, false)) AS inside FROM measured m LEFT JOIN limits t ON t.lang IS NOT DISTINCT FROM m.lang"
        " AND t.source IS NOT DISTINCT FROM m.source AND t.feature = m.feature GROUP BY m.r)"
        " SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM counted JOIN judged USING (r)"
    )


ORACLES["op10_adaptive_quality"] = _quality()


# --- op 11 -------------------------------------------------------------------------
#: Levels that the SQL builds: enough for 3 ** LEVELS documents of a source and 3 ** TOPS sources.
LEVELS, TOPS = 14, 7


def _levels(name: str, first: str, depth: int) -> list[str]:
    """name0, name1 ...: the nodes of every level; side0, side1 ...: what stands before and behind a node in its run."""
    out = [f"{name}0 AS MATERIALIZED ({first})"]
    for k in range(1, depth + 1):
        out.append(
            f"{name}{k} AS MATERIALIZED (SELECT tree, idx // 3 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest, (n + 2) // 3 AS n"
            f" FROM {name}{k - 1} WHERE n > 1 GROUP BY tree, idx // 3, n)"
        )
    run = "OVER (PARTITION BY tree, idx // 3 ORDER BY idx ROWS BETWEEN {} AND {})"
    before, behind = run.format("UNBOUNDED PRECEDING", "1 PRECEDING"), run.format("1 FOLLOWING", "UNBOUNDED FOLLOWING")
    for k in range(depth):
        out.append(
            f"{name}_side{k} AS MATERIALIZED (SELECT tree, idx, coalesce(string_agg(digest, '') {before}, '') AS pre,"
            f" coalesce(string_agg(digest, '') {behind}, '') AS post FROM {name}{k} WHERE n > 1)"
        )
    return out


def _manifest() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    # a byte is mixed in, then its eight bits are shifted out
    steps = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_concat([CAST(ascii(c) AS BIGINT)], list_transform(range(8), lambda z: CAST(-1 AS BIGINT)))))"
    crc = (
        f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda x, y: CASE WHEN y >= 0 THEN xor(x, y)"
        " WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END), CAST(4294967295 AS BIGINT))"
    )
    parts = [
        f"hashed AS (SELECT doc_id, source, sha256({head} || {field('text')}) AS leaf, sha256({head} || {field('changed')}) AS other"
        f" FROM (SELECT *, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents))",
        "leaves AS MATERIALIZED (SELECT *, row_number() OVER () AS r, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,"
        " row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM hashed)",
        *_levels("node", "SELECT tree, idx, leaf AS digest, n FROM leaves", LEVELS),
        "tops AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT tree, digest FROM node{k} WHERE n = 1" for k in range(LEVELS + 1)) + ")",
        *_levels("top", "SELECT 0 AS tree, tree AS idx, digest, (SELECT count(*) FROM tops) AS n FROM tops", TOPS),
        "root AS (" + " UNION ALL ".join(f"SELECT digest FROM top{k} WHERE n = 1" for k in range(TOPS + 1)) + ")",
        "way0 AS (SELECT r, tree, idx, other AS d, '' AS proof FROM leaves)",
    ]
    levels = [("node", k, f"s.tree = w.tree AND s.idx = w.idx // {3 ** k}") for k in range(LEVELS)]
    levels += [("top", k, f"s.idx = w.tree // {3 ** k}") for k in range(TOPS)]
    for i, (name, k, on) in enumerate(levels):
        parts.append(
            f"way{i + 1} AS (SELECT r, w.tree, w.idx, CASE WHEN s.idx IS NULL THEN d ELSE sha256(pre || d || post) END AS d, proof || coalesce(pre || post, '') AS proof"
            f" FROM way{i} w LEFT JOIN {name}_side{k} s ON {on})"
        )
    return (
        "WITH " + ", ".join(parts) + " SELECT doc_id, leaf, t.digest AS subroot, (SELECT digest FROM root) AS root, sha256(proof) AS proof_sha256, d AS folded_root,"
        f" d = (SELECT digest FROM root) AS verified FROM leaves l JOIN tops t USING (tree) JOIN way{len(levels)} w USING (r)"
    )


ORACLES["op11_merkle_pointer_jumping"] = _manifest()
