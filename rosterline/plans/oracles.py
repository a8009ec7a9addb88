"""The catalog's queries again, in the SQL of an independent engine (DuckDB).

The inputs come from the same definitions (plans/derived.py); the operators are
written anew with lists, joins and windows, not translated from the Spark side.
"""

from rosterline import vocab
from rosterline.plans import derived as D
from rosterline.functions.similarity import position_dictionary
from rosterline.plans.catalog import COMPANY_TITLES, SIMILAR_TARGETS, TARGETS

ORACLES: dict[str, str] = {}


# --- inputs ---------------------------------------------------------------------

def fields(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


def words(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


CONTACTS = (
    f"contacts AS (SELECT k, {fields(D.CONTACT_SQL)} FROM (SELECT {fields(D.CONTACT_KEYS)} FROM customer))"
)
SITES = f"sites AS (SELECT {fields(D.SITE_SQL)} FROM supplier)"
PEOPLE = f"people AS (SELECT {fields(D.PAGE_FIELDS)} FROM (SELECT {fields(D.PAGE_KEYS)} FROM customer))"
PAGE_ROWS = (
    "page_rows AS (SELECT page_id AS page_ord, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site_url,"
    " regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, url AS page_url, html FROM pages)"
)
VARIANTS = (
    f"variants AS (SELECT page_id AS page_ord, concat({D.VARIANT_HEAD}, html, {D.SOCIAL_TAIL}) AS html FROM pages)"
)
_HOSTED = "(SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages)"
ENTRIES = (
    f"entries AS (SELECT {D.PAGE_ENTRY} AS entry FROM {_HOSTED} UNION ALL SELECT {D.CUSTOMER_ENTRY} FROM customer)"
)


def classified(source: str, column: str = "entry", keep: str = "") -> str:
    """Rows of `source` with kind and value of an entry; value null if invalid."""
    value = f"trim({column})"
    web = f"regexp_matches({value}, '^(?i)https?://')"
    email = f"(length({value}) - length(replace({value}, '@', '')) = 1 AND NOT regexp_matches({value}, '\\s') AND regexp_matches(split_part({value}, '@', 2), '.\\..') AND split_part({value}, '@', 1) <> '')"
    inn = f"regexp_full_match({value}, '[0-9]{{10}}|[0-9]{{12}}')"
    bare = f"regexp_replace(split_part(split_part(lower(regexp_replace({value}, '^(?i)https?://', '')), '/', 1), ':', 1), '^www\\.', '')"
    return (
        f"SELECT {keep} CASE WHEN {web} THEN 'domain' WHEN {email} THEN 'email' WHEN {inn} THEN 'inn' ELSE 'domain' END AS kind,"
        f" CASE WHEN NOT {web} AND {email} THEN lower({value}) WHEN NOT {web} AND {inn} THEN {value}"
        f" WHEN contains({bare}, '.') AND length({bare}) >= 4 THEN {bare} END AS value FROM {source}"
        f" WHERE {value} <> '' AND NOT starts_with({value}, '#')"
    )


def listed(source: str) -> str:
    return f"SELECT DISTINCT kind, value FROM ({classified(source)}) WHERE value IS NOT NULL"


BLOCKLIST = ENTRIES + f", blocklist AS ({listed('entries')})"
KNOWN = f"known AS ({listed(f'(SELECT {D.CUSTOMER_ENTRY} AS entry FROM customer)')})"


def on_list(domain: str) -> str:
    """The domain or one of its parents is listed."""
    return (
        f"EXISTS (SELECT 1 FROM blocklist b WHERE b.kind = 'domain' AND ({domain} = b.value OR ends_with({domain}, '.' || b.value)))"
    )


def domain_of(url: str) -> str:
    host = f"regexp_replace(split_part(lower(regexp_extract({url}, '^(?i)https?://([^/?#]*)', 1)), ':', 1), '^www\\.', '')"
    return f"CASE WHEN contains({host}, '.') AND length({host}) >= 4 THEN {host} END"


def oracle(name: str, body: str, *ctes: str) -> None:
    ORACLES[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + body


def contact_rows(name: str, columns: str, more: str = "") -> None:
    oracle(name, f"SELECT page_ord, contact_ord, {columns} FROM contacts {more}", CONTACTS)


# --- sources --------------------------------------------------------------------
# a header in front of every file; the records' own line breaks count as lines
_RECORDS = {
    0: ("'ООО \"Ромашка\"' || chr(10) || 'и ' || s_name", "url", "inn", 2), 1: ("s_name", "url", "NULL", 3), 2: ("'5\" трубы'", "url", "'x'", 1),
    3: ("NULL", "url", "NULL", 1), 4: ("'a;bc'", "url", "url", 1), 5: ("'нет сайта' || chr(10) || ';'", "'https://нет сайта' || chr(10) || ';'", "NULL", 2),
}


def _by_record(place: int) -> str:
    return "CASE s_suppkey % 6 " + " ".join(f"WHEN {k} THEN {v[place]}" for k, v in _RECORDS.items()) + " END"


oracle(
    "read_sites_csv",
    f"SELECT CAST(sum(n) OVER (ORDER BY k) - n + f + 1 AS BIGINT) AS site_ord, url, company_name, inn FROM (SELECT s_suppkey AS k, {D.CSV_FILE} AS f, {_by_record(3)} AS n,"
    f" {_by_record(1)} AS url, {_by_record(0)} AS company_name, {_by_record(2)} AS inn FROM (SELECT s_suppkey, s_name, {D.SITE_SQL['url']} AS url, {D.SITE_SQL['inn']} AS inn FROM supplier))",
)
oracle(
    "read_sites_txt",
    "SELECT line_ord, part_ord, CASE WHEN regexp_matches(part, '^https?://') THEN part ELSE 'https://' || part END AS url FROM ("
    " SELECT line_ord, part_ord, regexp_replace(trim(p), '^[0-9]+[.)]\\s+', '') AS part, length(trim(p)) AS len FROM ("
    "  SELECT line_ord, unnest(parts) AS p, generate_subscripts(parts, 1) - 1 AS part_ord FROM ("
    "   SELECT line_ord, regexp_split_to_array(trim(line), '[,;\\t]+') AS parts FROM ("
    f"    SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS line_ord, {D.SITE_LINE} AS line FROM supplier)"
    "   WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')))) WHERE len >= 4 AND part <> ''",
)
SHEETS = (
    f"sheets AS (SELECT sheet_id, row_ord, string_split({D.SHEET_LINE}, '|') AS cells FROM (SELECT {fields(D.SHEET_KEYS)} FROM supplier))"
)
HEADER = (
    "header AS (SELECT sheet_id, coalesce(min(CASE WHEN row_ord < 10 AND len(list_filter(cells, lambda c: trim(c) <> '')) >= 2"
    f" AND len(list_filter(cells, lambda c: len(list_filter({words(vocab.HEADER_KEYWORDS)}, lambda w: contains(lower(c), w))) > 0)) > 0"
    " THEN row_ord END), 0) AS header_row FROM sheets GROUP BY sheet_id)"
)


def first_with(keywords) -> str:
    flags = f"list_transform(h.cells, lambda c: len(list_filter({words(keywords)}, lambda w: contains(lower(trim(c)), w))) > 0)"
    return f"CASE WHEN list_position({flags}, true) > 0 THEN CAST(list_position({flags}, true) - 1 AS BIGINT) END"


ROLES = (
    f"roles AS (SELECT h.sheet_id, {first_with(vocab.URL_COLUMN_KEYWORDS)} AS url_col, {first_with(vocab.NAME_COLUMN_KEYWORDS)} AS name_col,"
    f" {first_with(vocab.INN_COLUMN_KEYWORDS)} AS inn_col FROM sheets h JOIN header USING (sheet_id) WHERE h.row_ord = header_row)"
)
CONTENT = (
    "content AS (SELECT sheet_id, min(c) AS url_col FROM (SELECT sheet_id, c, count(*) FILTER (WHERE contains(v, '.') AND NOT contains(v, ' ')) AS n FROM ("
    " SELECT sheet_id, CAST(generate_subscripts(cells, 1) - 1 AS BIGINT) AS c, trim(unnest(cells)) AS v FROM sheets JOIN header USING (sheet_id)"
    " WHERE row_ord > header_row AND row_ord <= header_row + 5) GROUP BY sheet_id, c) WHERE n >= 2 GROUP BY sheet_id)"
)


def cleaned_cell(cell: str) -> str:
    parts = f"list_transform(string_split({cell}, ';'), lambda p: trim(p))"
    good = f"list_filter({parts}, lambda p: regexp_matches(p, '^https?://') OR (contains(p, '.') AND NOT contains(p, ' ') AND length(p) > 4))"
    url = f"(CASE WHEN contains({cell}, ';') AND len({good}) > 0 THEN {good}[1] ELSE trim({cell}) END)"
    return (
        f"CASE WHEN trim({cell}) = '' OR starts_with(trim({cell}), '#') THEN NULL"
        f" WHEN regexp_matches({url}, '^https?://') THEN {url} ELSE 'https://' || {url} END"
    )


oracle("find_header_row", "SELECT sheet_id, header_row FROM header", SHEETS, HEADER)
oracle("infer_column_roles", "SELECT * FROM roles", SHEETS, HEADER, ROLES)
oracle("infer_url_column_by_content", "SELECT * FROM content", SHEETS, HEADER, CONTENT)
oracle(
    "read_sites_table",
    f"SELECT sheet_id, site_ord, {cleaned_cell('u')} AS url, nullif(trim(n), '') AS company_name, nullif(trim(i), '') AS inn FROM ("
    " SELECT sheet_id, row_ord AS site_ord, cells[coalesce(r.url_col, c.url_col, 0) + 1] AS u, cells[r.name_col + 1] AS n, cells[r.inn_col + 1] AS i"
    " FROM sheets JOIN header USING (sheet_id) LEFT JOIN roles r USING (sheet_id) LEFT JOIN content c USING (sheet_id) WHERE row_ord > header_row)"
    f" WHERE {cleaned_cell('u')} IS NOT NULL",
    SHEETS, HEADER, ROLES, CONTENT,
)
oracle("clean_url_cell", f"SELECT page_id, {cleaned_cell('cell')} AS url FROM (SELECT page_id, {D.URL_CELL} AS cell FROM pages)")
oracle("read_pages", "SELECT page_ord, site_url, page_url, length(html) AS n_chars FROM page_rows", PAGE_ROWS)
oracle("read_blocklist_text", "SELECT * FROM blocklist", BLOCKLIST)
_CSV = (
    "SELECT 'mail' || CAST(c_custkey % 25 AS STRING) || '.example.com' AS entry FROM customer UNION ALL"
    " SELECT 'P' || CAST(c_custkey AS STRING) || '@x.example.ru' FROM customer UNION ALL SELECT CAST(7707083893 + c_custkey % 3 AS STRING) FROM customer"
)
oracle("read_blocklist_csv", listed(f"({_CSV})"))
_JSON = (
    "SELECT 'mail' || CAST(c_custkey % 25 AS STRING) || '.example.com' AS entry FROM customer WHERE c_custkey % 2 = 0 UNION ALL"
    " SELECT '7707083893' FROM customer WHERE c_custkey % 2 = 0 UNION ALL"
    " SELECT 'd' || CAST(c_custkey AS STRING) || '.example.com' FROM customer WHERE c_custkey % 2 = 1 UNION ALL"
    " SELECT 'A' || CAST(c_custkey AS STRING) || '@b.ru' FROM customer WHERE c_custkey % 2 = 1"
)
oracle("read_blocklist_json", listed(f"({_JSON})"))
oracle(
    "read_position_dictionary",
    "SELECT s_suppkey AS file_ord, CAST(o AS BIGINT) AS ord, CASE o WHEN 0 THEN 'Variant ' || s_suppkey WHEN 1 THEN 'second' ELSE 'Alpha' END AS variant,"
    " CASE o WHEN 0 THEN s_name WHEN 1 THEN 'x' ELSE 'y' END AS canonical FROM supplier CROSS JOIN range(3) t(o)",
)
oracle(
    "classify_blocklist_entry",
    "SELECT c_custkey, CASE WHEN value IS NOT NULL THEN kind END AS kind, value FROM ("
    + classified(f"(SELECT c_custkey, {D.CUSTOMER_ENTRY} AS entry FROM customer)", keep="c_custkey,") + ")",
)
oracle(
    "seed_sites_from_search_results",
    "SELECT domain, site_url AS url FROM (SELECT regexp_replace(host, '^www\\.', '') AS domain, site_url,"
    " row_number() OVER (PARTITION BY regexp_replace(host, '^www\\.', '') ORDER BY page_ord) AS n FROM page_rows) WHERE n = 1",
    PAGE_ROWS,
)
STOP = f"blocklist AS (SELECT 'domain' AS kind, unnest({words(vocab.STOPLIST_DOMAINS)}) AS value)"
LISTED = f"listed AS (SELECT page_id AS page_ord, {D.LISTED_URL} AS url FROM pages)"
oracle(
    "read_stoplist_domains",
    f"SELECT b.value, count(*) AS n FROM listed JOIN blocklist b ON {domain_of('url')} = b.value OR ends_with({domain_of('url')}, '.' || b.value) GROUP BY 1",
    STOP, LISTED,
)

# --- names and positions -----------------------------------------------------------


def tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def any_word(text: str, values, strip: str) -> str:
    chars = strip.replace("'", "''")
    return f"len(list_filter({tokens(f'lower({text})')}, lambda w: list_contains({words(values)}, trim(w, '{chars}')))) > 0"


def any_part(text: str, values) -> str:
    return f"len(list_filter({words(values)}, lambda m: contains(lower({text}), m))) > 0"


QUICK_NAME = (
    "coalesce(length({x}) BETWEEN 4 AND 70 AND NOT ({garbage}) AND NOT regexp_matches({x}, '[0-9]') AND NOT ({labels})"
    " AND NOT list_contains({genitive}, trim({tokens}[-1], '.,;:-')) AND NOT list_contains({places}, trim({tokens}[1], '.,;:-')), false)"
)


def quick_name(x: str) -> str:
    return QUICK_NAME.format(
        x=x, garbage=any_word(x, vocab.QUICK_NAME_GARBAGE, ".,;:-"), labels=any_word(x, vocab.QUICK_FIELD_LABELS, ".,;:-()"),
        genitive=words(vocab.QUICK_GENITIVE_SURNAMES), places=words(vocab.PREPOSITIONAL_PLACES), tokens=tokens(f"lower({x})"),
    )


def strict_name(x: str) -> str:
    parts = f"flatten(list_transform({tokens(f'trim({x})')}, lambda w: string_split(w, '-')))"
    lower_parts = f"list_filter({parts}, lambda p: rtrim(p, '.') <> '' AND NOT regexp_matches(rtrim(p, '.'), '^\\p{{Lu}}'))"
    return (
        f"coalesce(length(trim({x})) BETWEEN 4 AND 100 AND NOT regexp_matches({x}, '[0-9@:/]') AND len({tokens(x)}) BETWEEN 2 AND 5"
        f" AND len({lower_parts}) = 0 AND NOT ({any_part(x, vocab.ORG_TERMS)}) AND NOT ({any_part(x, vocab.POLITICIANS)}), false)"
    )


def final_name(x: str) -> str:
    t = tokens(f"trim({x})")
    real = f"len(list_filter({t}, lambda w: length(w) > 2 OR (length(w) = 2 AND ends_with(w, '.'))))"
    small = f"len(list_filter({t}, lambda w: NOT (length(w) <= 2 AND ends_with(w, '.')) AND NOT regexp_matches(w, '^[А-ЯЁA-Z]')))"
    long = f"list_transform(list_filter({t}, lambda w: length(w) > 2), lambda w: trim(lower(w), '.,;:-()'))"
    return (
        f"coalesce(length(trim({x})) BETWEEN 4 AND 70 AND NOT ({any_word(x, vocab.NAME_GARBAGE, '.,;:-()\"' + chr(39))}) AND {real} BETWEEN 2 AND 4"
        f" AND {small} = 0 AND NOT (len({long}) > 0 AND len(list_filter({long}, lambda w: NOT list_contains({words(vocab.CITIES)}, w))) = 0)"
        f" AND NOT regexp_matches({x}, '[0-9]') AND NOT ({any_word(x, vocab.FIELD_LABELS, '.,;:-()')})"
        f" AND NOT regexp_matches({x}, '[@#$%^&*=+{{}}<>/|~`\\[\\]\\\\]'), false)"
    )


def one_space(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def blocked_name(x: str) -> str:
    low = f"lower({one_space(x)})"
    return (
        f"coalesce(list_contains({words(vocab.BLOCKED_NAMES)}, {low})"
        f" OR list_contains({words(vocab.GENITIVE_SURNAMES)}, trim(string_split({low}, ' ')[-1], '.,;:-')), false)"
    )


EDGE_L, EDGE_R = "(^|[^\\p{L}\\p{N}_])", "($|[^\\p{L}\\p{N}_])"
PHONE_LIKE = "(\\+7|8[\\s\\-]?\\(?[0-9]{3})\\)?[\\s\\-]?[0-9]{3}"


def quick_position(x: str) -> str:
    return (
        f"coalesce(length({x}) BETWEEN 3 AND 100 AND NOT ({any_part(x, vocab.MONTHS_RU)}) AND NOT regexp_matches({x}, '^[0-9]')"
        f" AND NOT ({any_word(x, vocab.QUICK_POSITION_GARBAGE, '.,;:-')}) AND NOT contains({x}, '@') AND NOT contains(lower({x}), 'http')"
        f" AND NOT contains(lower({x}), 'www.') AND right({x}, 1) <> ':' AND NOT regexp_matches({x}, '{EDGE_L}20[12][0-9]{EDGE_R}'), false)"
    )


def strict_position(x: str) -> str:
    v = f"trim({x})"
    digits = f"(length({v}) - length(regexp_replace({v}, '[0-9]', '', 'g')))"
    marks = f"len(list_filter({words(vocab.ADDRESS_MARKERS)}, lambda m: contains(lower({v}), m)))"
    return (
        f"CASE WHEN length({v}) BETWEEN 3 AND 150 AND NOT contains({v}, '@') AND NOT regexp_matches(lower({v}), 'https?://|www\\.')"
        f" AND NOT regexp_matches({v}, '{PHONE_LIKE}') AND NOT regexp_matches({v}, '[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')"
        f" AND {digits} <= 4 AND {marks} < 2 AND len({tokens(v)}) <= 8 THEN {v} END"
    )


def final_position(x: str) -> str:
    v = f"trim({x})"
    return (
        f"CASE WHEN length({v}) BETWEEN 3 AND 100 AND NOT ({any_part(v, vocab.MONTHS_RU + vocab.MONTHS_EN)})"
        f" AND NOT regexp_matches({v}, '^[0-9]{{1,2}}\\s') AND NOT regexp_matches({v}, '^[0-9]{{1,2}}\\.[0-9]{{1,2}}\\.[0-9]{{2,4}}')"
        f" AND NOT regexp_full_match({v}, '[0-9\\s.,-]+') AND NOT contains({v}, '@') AND NOT contains(lower({v}), 'http') AND NOT contains(lower({v}), 'www.')"
        f" AND NOT regexp_matches({v}, '\\.[\\p{{L}}\\p{{N}}_]{{2,3}}$') AND NOT regexp_matches({v}, '{PHONE_LIKE}') AND right({v}, 1) <> ':'"
        f" AND NOT ({any_word(v, vocab.POSITION_GARBAGE, '.,;:-()\"' + chr(39))}) AND NOT regexp_matches({v}, '{EDGE_L}20[1-3][0-9]{EDGE_R}')"
        f" AND NOT (len({tokens(v)}) > 5 AND NOT ({any_word(v, vocab.POSITION_MARKERS, '.,;:-')})) AND NOT ({any_word(v, vocab.NEWS_WORDS, '.,;:-')}) THEN {v} END"
    )


contact_rows("name_quick_valid", f"full_name, {quick_name('full_name')} AS ok")
contact_rows("name_valid_strict", f"full_name, {strict_name('full_name')} AS ok")
contact_rows("name_valid_final", f"full_name, {final_name('full_name')} AS ok")
contact_rows("name_collapse_ws", f"{one_space('full_name')} AS full_name")
contact_rows("name_blocked", f"full_name, {blocked_name('full_name')} AS blocked")
contact_rows("position_quick_valid", f"position_raw, {quick_position('position_raw')} AS ok")
contact_rows("position_valid_strict", f"{strict_position('position_raw')} AS position")
contact_rows("position_valid_final", f"{final_position('position_raw')} AS position")
_PAIRS = ", ".join(
    f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate([*vocab.POSITIONS_RU.items(), *vocab.POSITIONS_EN.items()])
)
oracle(
    "position_normalize_exact",
    "SELECT page_ord, contact_ord, position_raw, canonical FROM contacts LEFT JOIN ("
    "SELECT lower(variant) AS variant, arg_min(canonical, ord) AS canonical FROM dictionary GROUP BY 1) d ON d.variant = lower(trim(position_raw))",
    CONTACTS, f"dictionary(ord, variant, canonical) AS (VALUES {_PAIRS})",
)
_BOTH = "lower(coalesce(position_raw, '') || ' ' || coalesce(position_normalized, ''))"
_HIT = f"len(list_filter({words(TARGETS)}, lambda t: contains({_BOTH}, t))) > 0"
oracle("substring_targets", f"SELECT page_ord, contact_ord FROM contacts WHERE {_HIT}", CONTACTS)


# Longest common subsequence of all pairs (a, b): a row of the table of prefixes per character of a.
def common(pairs: str) -> str:
    cell = "CASE WHEN k > 1 AND bs[k - 1] = as_[i + 1] THEN line[k - 1] + 1 ELSE line[k] END"
    row = f"list_transform(range(1, len(bs) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: {cell})))"
    return (
        "walk(a, b, as_, bs, i, line) AS (SELECT a, b, string_split(a, ''), string_split(b, ''), 0, list_transform(range(0, length(b) + 1), lambda z: CAST(0 AS BIGINT))"
        f" FROM {pairs} UNION ALL SELECT a, b, as_, bs, i + 1, {row} FROM walk WHERE i < len(as_)),"
        " lcs AS (SELECT a, b, line[-1] AS n FROM walk WHERE i = len(as_))"
    )


def sorted_words(text: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')), ' ')"


DICTIONARY = (
    "dictionary(ord, variant, canonical) AS (VALUES "
    + ", ".join("(" + str(i) + ", " + ", ".join("'" + x.replace("'", "''") + "'" for x in kv) + ")" for i, kv in enumerate(position_dictionary().items())) + ")"
)
KNOWN_POSITIONS = (
    "exact AS (SELECT lower(variant) AS low, arg_min(canonical, ord) AS canonical FROM dictionary GROUP BY 1),"
    " asked AS (SELECT DISTINCT position_raw AS p, lower(trim(position_raw)) AS low FROM contacts WHERE trim(position_raw) <> ''),"
    f" pairs AS (SELECT DISTINCT {sorted_words('q.low')} AS a, {sorted_words('lower(d.variant)')} AS b FROM asked q, dictionary d WHERE q.low NOT IN (SELECT low FROM exact)),"
    " near AS (SELECT * FROM pairs WHERE 200.0 * least(length(a), length(b)) >= 75 * (length(a) + length(b)))"
)
LOOKED_UP = (
    f"alike AS (SELECT q.low, d.canonical FROM asked q JOIN lcs ON lcs.a = {sorted_words('q.low')} JOIN dictionary d ON lcs.b = {sorted_words('lower(d.variant)')}"
    " WHERE 200.0 * n / (length(a) + length(b)) >= 75 QUALIFY row_number() OVER (PARTITION BY q.low ORDER BY 200.0 * n / (length(a) + length(b)) DESC, d.ord) = 1),"
    " answers AS (SELECT q.p, coalesce(e.canonical, s.canonical, q.p) AS canonical FROM asked q LEFT JOIN exact e ON e.low = q.low LEFT JOIN alike s ON s.low = q.low)"
)
for _name, _alias in (("position_normalize_fuzzy", "position"), ("fuzzy_dictionary_join", "canonical")):
    oracle(
        _name, f"SELECT page_ord, contact_ord, position_raw, canonical AS {_alias} FROM contacts LEFT JOIN answers ON p = position_raw",
        "RECURSIVE " + CONTACTS, DICTIONARY, KNOWN_POSITIONS, common("near"), LOOKED_UP,
    )

# all windows of the longer text, also those that hang over an end; of equally long texts both ways
_BOTH_TEXT = "lower(coalesce(position_raw, '') || ' ' || coalesce(position_normalized, ''))"


def by_target(name: str, targets: list[str], select: str) -> None:
    wanted = words([t.lower() for t in targets])
    window = "long[greatest(s, 0) + 1 : s + length(short)]"
    oracle(
        name, select, "RECURSIVE " + CONTACTS,
        f"texts AS (SELECT DISTINCT {_BOTH_TEXT} AS t, unnest({wanted}) AS w FROM contacts)",
        "sides AS (SELECT t, w, CASE WHEN length(w) <= length(t) THEN w ELSE t END AS short, CASE WHEN length(w) <= length(t) THEN t ELSE w END AS long FROM texts"
        " UNION SELECT t, w, t, w FROM texts WHERE length(t) = length(w))",
        f"windows AS (SELECT t, w, short AS a, {window} AS b FROM (SELECT *, unnest(range(1 - length(short), length(long))) AS s FROM sides WHERE NOT contains(t, w)))",
        "distinct_windows AS (SELECT DISTINCT a, b FROM windows)", common("distinct_windows"),
        "hits AS (SELECT DISTINCT t FROM texts WHERE contains(t, w) UNION SELECT t FROM windows JOIN lcs USING (a, b) WHERE 200.0 * n / (length(a) + length(b)) >= 70)",
    )


by_target("position_matches_targets", SIMILAR_TARGETS, f"SELECT page_ord, contact_ord, {_BOTH_TEXT} IN (SELECT t FROM hits) AS hit FROM contacts")
by_target("match_targets_join", SIMILAR_TARGETS, f"SELECT page_ord, contact_ord FROM contacts WHERE {_BOTH_TEXT} IN (SELECT t FROM hits)")
by_target("match_targets_similar", SIMILAR_TARGETS[:2], f"SELECT page_ord, contact_ord FROM contacts WHERE {_BOTH_TEXT} IN (SELECT t FROM hits)")

# --- declension ---------------------------------------------------------------------
FIO = (
    "fio AS (SELECT *, coalesce(t[1], trim(full_name), '') AS family, coalesce(t[2], '') AS name, coalesce(t[3], '') AS patronymic FROM ("
    "SELECT *, regexp_extract_all(full_name, '[А-ЯЁA-Z][а-яёa-z]*\\.?') AS t FROM contacts))"
)
GENDER = (
    "gender AS (SELECT *, CASE WHEN patronymic = '' THEN CASE WHEN len(list_filter(['ова', 'ева', 'ина', 'ая', 'яя'], lambda s: ends_with(family, s))) > 0 THEN 'ж' ELSE 'м' END"
    " WHEN ends_with(rtrim(lower(patronymic), '.'), 'ич') THEN 'м' WHEN ends_with(rtrim(lower(patronymic), '.'), 'на') THEN 'ж' ELSE 'м' END AS g,"
    " rtrim(family, '.') AS f FROM fio)"
)
DATIVE = (
    "dative AS (SELECT *, CASE WHEN g = 'м' THEN CASE WHEN right(lower(f), 2) IN ('ий', 'ый', 'ой') THEN left(f, length(f) - 2) || 'ому'"
    " WHEN right(lower(f), 1) = 'ь' THEN left(f, length(f) - 1) || 'ю' WHEN f <> '' AND contains('бвгджзйклмнпрстфхцчшщ', right(lower(f), 1)) THEN f || 'у' ELSE f END"
    " WHEN right(lower(f), 2) IN ('ая', 'яя') THEN left(f, length(f) - 2) || 'ой' WHEN right(lower(f), 3) IN ('ова', 'ева', 'ина') THEN left(f, length(f) - 1) || 'ой'"
    " WHEN right(lower(f), 1) = 'а' THEN left(f, length(f) - 1) || 'е' ELSE f END AS fam FROM gender)"
)
_INITIALS = "(CASE WHEN name = '' THEN '' ELSE upper(name[1]) || '.' END || CASE WHEN patronymic = '' THEN '' ELSE upper(patronymic[1]) || '.' END)"
FIO_DATIVE = f"CASE WHEN family = '' THEN '' WHEN {_INITIALS} = '' THEN fam ELSE fam || ' ' || {_INITIALS} END"
NAME_PATRONYMIC = "trim(name || ' ' || patronymic)"


def fio_rows(name: str, columns: str) -> None:
    oracle(name, f"SELECT page_ord, contact_ord, {columns} FROM dative", CONTACTS, FIO, GENDER, DATIVE)


fio_rows("split_fio", "family, name, patronymic")
fio_rows("detect_gender", "g AS gender")
fio_rows("gender_ending", "CASE g WHEN 'м' THEN 'ый' ELSE 'ая' END AS ending")
fio_rows("family_dative", "fam AS family")
fio_rows("fio_dative", f"{FIO_DATIVE} AS fio_dative")
fio_rows("name_patronymic", f"{NAME_PATRONYMIC} AS name_patronymic")

# --- fields -----------------------------------------------------------------------------


def digits(x: str) -> str:
    d = f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"
    return f"(CASE WHEN length({d}) = 11 AND {d}[1] = '8' THEN '7' || {d}[2:] WHEN length({d}) = 10 THEN '7' || {d} ELSE {d} END)"


def mobile(x: str) -> str:
    return f"CASE WHEN length({digits(x)}) >= 11 AND {digits(x)}[2] = '9' THEN {digits(x)} ELSE '' END"


def city(x: str) -> str:
    return f"CASE WHEN length({digits(x)}) >= 11 AND {digits(x)}[2] = '9' THEN '' ELSE {digits(x)} END"


def e164(x: str) -> str:
    kept = f"regexp_replace({x}, '[^0-9+]', '', 'g')"
    full = (
        f"(CASE WHEN length({kept}) = 11 AND {kept}[1] = '8' AND NOT contains({kept}, '+') THEN '+7' || {kept}[2:]"
        f" WHEN length({kept}) = 11 AND {kept}[1] = '7' AND NOT contains({kept}, '+') THEN '+' || {kept}"
        f" WHEN regexp_full_match({kept}, '[3489][0-9]{{9}}') THEN '+7' || {kept} ELSE {kept} END)"
    )
    ok = f"regexp_full_match({full}, '\\+7[34789][0-9]{{9}}') OR regexp_full_match({full}, '\\+[1-689][0-9]{{7,14}}')"
    return f"CASE WHEN {ok} THEN {full} ELSE nullif(trim(regexp_replace({x}, '[^0-9+()\\s-]', '', 'g')), '') END"


PHONE = (
    "((\\+7|8|7)[\\s\\-\\(\\.]*(\\d{3}|\\(\\d{3}\\))[\\s\\-\\)\\.]*\\d{3}[\\s\\-\\.]*\\d{2}[\\s\\-\\.]*\\d{2})"
    "|(\\+\\d{1,3}[\\s\\-\\(\\.]*\\d{2,4}[\\s\\-\\)\\.]*\\d{3,4}[\\s\\-\\.]*\\d{3,4})"
)
EMAIL = "[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}"
DOC_PHONES = f"doc_phones AS (SELECT doc_id, regexp_extract_all(text, '{PHONE}') AS found FROM documents)"
# distinct emails in text order
DOC_EMAILS = (
    "doc_emails AS (SELECT doc_id, email, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS pos FROM ("
    f" SELECT doc_id, email, min(place) AS place FROM (SELECT doc_id, unnest(found) AS email, generate_subscripts(found, 1) AS place FROM ("
    f"  SELECT doc_id, regexp_extract_all(text, '{EMAIL}') AS found FROM documents)) GROUP BY doc_id, email))"
)
oracle("extract_emails", "SELECT doc_id, pos, email FROM doc_emails", DOC_EMAILS)
oracle(
    "extract_phones",
    f"SELECT doc_id, generate_subscripts(found, 1) - 1 AS pos, {one_space('unnest(found)')} AS phone FROM doc_phones",
    DOC_PHONES,
)
oracle(
    "phone_e164",
    f"SELECT id, raw, {e164('raw')} AS phone FROM (SELECT doc_id AS id, {one_space('unnest(found)')} AS raw FROM doc_phones"
    " UNION ALL SELECT page_ord, phone FROM contacts)",
    DOC_PHONES, CONTACTS,
)
contact_rows("phone_digits", f"{digits('phone')} AS digits")
contact_rows("phone_mobile_city", f"{mobile('phone')} AS mobile, {city('phone')} AS city")


def box(e: str) -> str:
    return f"lower(trim(split_part({e}, '@', 1)))"


def bare(e: str) -> str:
    return f"replace(replace(replace({box(e)}, '-', ''), '.', ''), '_', '')"


def generic(e: str, prefixes=vocab.GENERIC_PREFIXES) -> str:
    listed_ = words(prefixes)
    norm = f"list_transform({listed_}, lambda p: replace(replace(replace(p, '-', ''), '.', ''), '_', ''))"
    return f"coalesce({e} <> '' AND (list_contains({listed_}, {box(e)}) OR list_contains({norm}, {bare(e)})), false)"


def generic_final(e: str) -> str:
    return (
        f"coalesce({e} <> '' AND ({generic(e, vocab.GENERIC_PREFIXES_FINAL)} OR length({box(e)}) <= 3"
        f" OR len(list_filter({words(vocab.DEPARTMENT_MARKERS)}, lambda m: contains({box(e)}, m))) > 0), false)"
    )


_ALL_MAIL = "mail AS (SELECT email FROM doc_emails UNION ALL SELECT personal_email FROM contacts)"
oracle("is_generic_email", f"SELECT email, {generic('email')} AS generic FROM mail", DOC_EMAILS, CONTACTS, _ALL_MAIL)
oracle("is_generic_email_final", f"SELECT email, {generic_final('email')} AS generic FROM mail", DOC_EMAILS, CONTACTS, _ALL_MAIL)
_NEW_PERSONAL = f"CASE WHEN {generic_final('personal_email')} THEN NULL ELSE lower(trim(personal_email)) END"
_NEW_COMPANY = (
    f"CASE WHEN {generic_final('personal_email')} AND coalesce(company_email, '') = '' THEN lower(trim(personal_email)) ELSE lower(trim(company_email)) END"
)
contact_rows("relocate_generic_email", f"{_NEW_PERSONAL} AS personal_email, {_NEW_COMPANY} AS company_email")


def only_digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def valid_inn(x: str) -> str:
    return f"CASE WHEN length({only_digits(x)}) IN (10, 12) THEN {only_digits(x)} END"


def valid_kpp(x: str) -> str:
    return f"CASE WHEN length({only_digits(x)}) = 9 THEN {only_digits(x)} END"


STRICT_INN = "CASE WHEN regexp_full_match(trim({x}), '[0-9]{{10}}|[0-9]{{12}}') THEN {x} END"
contact_rows(
    "validate_inn_kpp",
    f"{valid_inn('inn')} AS inn, {valid_kpp('kpp')} AS kpp, {STRICT_INN.format(x='inn')} AS strict_inn,"
    " CASE WHEN regexp_full_match(trim(kpp), '[0-9]{9}') THEN kpp END AS strict_kpp",
)


def control(weights: list[int], x: str) -> str:
    total = f"list_sum(list_transform(range(1, {len(weights) + 1}), lambda i: {weights}[i] * CAST({x}[i] AS INTEGER)))"
    return f"(CAST({total} AS BIGINT) % 11 % 10)"


oracle(
    "inn_checksum",
    f"SELECT c_custkey, {control([2, 4, 10, 3, 5, 9, 4, 6, 8], 'a')} = CAST(a[10] AS INTEGER) AS ok10,"
    f" ({control([7, 2, 4, 10, 3, 5, 9, 4, 6, 8], 'b')} = CAST(b[11] AS INTEGER) AND {control([3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8], 'b')} = CAST(b[12] AS INTEGER)) AS ok12"
    " FROM (SELECT c_custkey, a, a || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') AS b FROM ("
    "SELECT c_custkey, '7707' || lpad(CAST(c_custkey * 7919 % 1000000 AS STRING), 6, '0') AS a FROM customer))",
)
_FIRST_PART = "CASE WHEN contains(company_name, ';') THEN trim(split_part(company_name, ';', 1)) ELSE company_name END"
contact_rows("company_name_first_part", f"{_FIRST_PART} AS company_name")
_PREFIX = "|".join(vocab.COMPANY_JUNK_PREFIXES)
_TAIL = "|".join(vocab.COMPANY_JUNK_TAILS)
oracle(
    "company_name_clean",
    "SELECT c_custkey, CASE WHEN length(e) > 2 THEN e ELSE o END AS company_name FROM ("
    f"SELECT *, rtrim({one_space('d')}, '.-:;,') AS e FROM ("
    "SELECT *, CASE WHEN regexp_matches(c, '^.*?[«»](.+?)[«»].*$') THEN trim(regexp_extract(c, '^.*?[«»](.+?)[«»].*$', 1)) ELSE c END AS d FROM ("
    "SELECT *, trim(regexp_replace(b, '\\s*[-—]\\s*$', '')) AS c FROM ("
    f"SELECT *, trim(regexp_replace(a, '(?i)\\s*[-—:]+\\s*({_TAIL}).*$', '')) AS b FROM ("
    f"SELECT *, trim(regexp_replace(o, '(?i)^({_PREFIX})\\s*[-—:«»]?\\s*', '')) AS a FROM ("
    f"SELECT c_custkey, trim(coalesce({COMPANY_TITLES}, '')) AS o FROM customer))))))",
)
contact_rows("capitalize_first", "upper(lower(position_raw)[1]) || lower(position_raw)[2:] AS position")
oracle("scan_date_text", "SELECT event_id, strftime(ts, '%d.%m.%Y %H:%M') AS scan_date FROM events")
oracle(
    "safe_partition_name",
    "SELECT doc_id, left(translate(source || ':/' || lang || '*[x]?\\' || text, '/\\?*[]:', '_______'), 31) AS name FROM documents",
)
_RULES = ", ".join(
    f"({i}, '{EDGE_L}(" + p[5:-3].replace("\\w", "[\\p{L}\\p{N}_]") + f"){EDGE_R}', '{c}')"
    for i, (c, p) in enumerate(vocab.CATEGORY_RULES)
)
_EXACT = ", ".join(f"('{v}', '{c}')" for c, vs in vocab.CATEGORY_VARIANTS.items() for v in vs)
CATEGORY_TABLES = f"rules(ord, pattern, category) AS (VALUES {_RULES}), exact(variant, category) AS (VALUES {_EXACT})"
CATEGORISED = (
    "named AS (SELECT *, " + one_space("lower(coalesce(nullif(position_normalized, ''), position_raw))") + " AS pos FROM contacts),"
    " positions_seen AS (SELECT DISTINCT pos FROM named),"
    " decided AS (SELECT p.pos, coalesce(any_value(e.category), arg_min(r.category, r.ord) FILTER (WHERE r.ord IS NOT NULL)) AS category"
    " FROM positions_seen p LEFT JOIN exact e ON e.variant = p.pos LEFT JOIN rules r ON regexp_matches(p.pos, r.pattern) GROUP BY p.pos),"
    f" categorised AS (SELECT named.*, coalesce(d.category, '{vocab.DEFAULT_CATEGORY}') AS category FROM named LEFT JOIN decided d ON d.pos IS NOT DISTINCT FROM named.pos)"
)
CAT = (CONTACTS, CATEGORY_TABLES, CATEGORISED)
oracle("crm_category", "SELECT page_ord, contact_ord, category FROM categorised", *CAT)
_UI = "lower(coalesce(position_normalized, position_raw, ''))"
UI = (
    f"CASE WHEN contains({_UI}, 'директор') AND NOT contains({_UI}, 'финанс') AND NOT contains({_UI}, 'hr') AND NOT contains({_UI}, 'кадр') THEN 'director'"
    f" WHEN contains({_UI}, 'юрист') OR contains({_UI}, 'юридич') OR contains({_UI}, 'правов') THEN 'lawyer'"
    f" WHEN contains({_UI}, 'финанс') OR contains({_UI}, 'бухгалт') OR contains({_UI}, 'cfo') THEN 'cfo'"
    f" WHEN contains({_UI}, 'hr') OR contains({_UI}, 'кадр') OR contains({_UI}, 'персонал') OR contains({_UI}, 'рекрут') THEN 'hr' ELSE 'other' END"
)
contact_rows("ui_category", f"{UI} AS category")
contact_rows("has_useful_field", "concat(personal_email, phone, position_raw, inn) <> '' AS useful")
oracle(
    "json_from_text",
    "SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN '{\"a\": ' || c_custkey || '}' WHEN 1 THEN '{\"b\":[1]}' WHEN 2 THEN '{\"c\": \"x\"}' END AS json FROM customer"
    .replace("WHEN 1 THEN '{\"b\":[1]}'", "WHEN 1 THEN CAST(c_custkey AS STRING)"),
)
oracle(
    "truncate_text",
    "SELECT doc_id, CASE WHEN length(text) > 12288 THEN left(text, 12288) || chr(10) || '[текст обрезан]' ELSE text END AS text FROM documents",
)
contact_rows("role_comment", "'Роль: ' || nullif(comment, '') AS comment")
contact_rows(
    "words_overlap",
    f"(len({tokens('full_name')}) > 0 AND len(list_filter({tokens('lower(full_name)')}, lambda w: NOT list_contains({words(vocab.CITIES)}, w))) = 0) IS TRUE AS only_cities,"
    f" coalesce(list_has_any({tokens('lower(position_raw)')}, {words(vocab.POSITION_MARKERS)}), false) AS has_marker",
)
