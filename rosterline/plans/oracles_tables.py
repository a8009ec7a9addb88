"""Oracles of the table operators: pages, entities, joins, dedups, reports."""

from rosterline import vocab
from rosterline.operators.prompts import CORRECTION_TASK
from rosterline.operators.reports import TASK_LABELS
from rosterline.plans import derived as D
from rosterline.plans.oracles import (
    BLOCKLIST, CAT, CATEGORISED, CATEGORY_TABLES, CONTACTS, DATIVE, DOC_EMAILS, EMAIL, ENTRIES, FIO, FIO_DATIVE, GENDER, KNOWN, LISTED, NAME_PATRONYMIC,
    ORACLES, PAGE_ROWS, PEOPLE, SITES, STOP, STRICT_INN, UI, VARIANTS, blocked_name, city, contact_rows, domain_of,
    e164, fields, final_name, final_position, generic, generic_final, listed, mobile, on_list, one_space, only_digits,
    oracle, quick_name, strict_name, valid_inn, valid_kpp, words,
)

FIRST = "row_number() OVER (PARTITION BY {keys} ORDER BY k) = 1"

# --- sinks and reports -----------------------------------------------------------
_PHONE = "coalesce(nullif(phone, ''), phone_raw)"
oracle(
    "write_contacts_by_category",
    f"SELECT category, count(*) AS n, count(*) FILTER (WHERE {FIO_DATIVE} <> '') AS n_dative, count(*) FILTER (WHERE {mobile(_PHONE)} <> '') AS n_mobile"
    " FROM dative GROUP BY category",
    *CAT, FIO.replace("FROM contacts", "FROM categorised"), GENDER, DATIVE,
)
CATEGORY_COUNTS = (
    f"category_counts AS (SELECT category, CAST(sum(n) AS BIGINT) AS n FROM (SELECT category, count(*) AS n FROM categorised GROUP BY 1"
    f" UNION ALL SELECT '{vocab.DEFAULT_CATEGORY}', 0) GROUP BY 1)"
)
SITE_COUNTS = (
    "site_counts AS (SELECT url AS site_url, count(c.k) AS n FROM (SELECT DISTINCT url FROM sites) LEFT JOIN contacts c ON c.site_url = url GROUP BY url)"
)
oracle("category_counts", "SELECT * FROM category_counts", *CAT, CATEGORY_COUNTS)
oracle("site_counts", "SELECT * FROM site_counts", CONTACTS, SITES, SITE_COUNTS)
oracle(
    "statistics_table",
    "SELECT 'total' AS section, 'Итого контактов' AS label, CAST(count(*) AS VARCHAR) AS value FROM contacts UNION ALL"
    " SELECT 'category', category, CAST(n AS VARCHAR) FROM category_counts UNION ALL SELECT 'site', site_url, CAST(n AS VARCHAR) FROM site_counts UNION ALL"
    f" SELECT 'task', unnest({words(TASK_LABELS)}), unnest([strftime(created_at, '%d.%m.%Y %H:%M:%S'), coalesce(strftime(finished_at, '%d.%m.%Y %H:%M:%S'), '—'),"
    " 'Режим ' || mode, variant, CAST(errors AS VARCHAR), CAST(total_pages AS VARCHAR), (CAST(elapsed_seconds AS BIGINT) // 60) || ' мин ' || (CAST(elapsed_seconds AS BIGINT) % 60) || ' сек',"
    f" CAST(llm_tokens_used AS VARCHAR), CAST(fallback_count AS VARCHAR)]) FROM (SELECT {fields(D.STAT_TASK_SQL)} FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders))",
    *CAT, SITES, CATEGORY_COUNTS, SITE_COUNTS,
)
oracle(
    "site_log_table",
    "SELECT '03.02.2024 04:05' AS time, s.site_url, count(DISTINCT c.page_ord) AS n_pages, CASE WHEN any_value(n) > 0 THEN 'OK' ELSE 'Нет контактов' END || ': найдено ' || any_value(n) || ' контактов' AS status"
    " FROM site_counts s LEFT JOIN contacts c ON c.site_url = s.site_url GROUP BY s.site_url",
    CONTACTS, SITES, SITE_COUNTS,
)
oracle(
    "error_log",
    f"SELECT '[BLACKLIST] ' || url || ' — в чёрном списке' AS line FROM sites WHERE {on_list(domain_of('url'))} UNION ALL"
    f" SELECT '[PAGE_ERROR] ' || url || ': HTTP ' || status FROM (SELECT url, {D.FETCH_STATUS} AS status FROM pages) WHERE status IN ('403', '404', '429', '500', '503')"
    " UNION ALL SELECT '[SITE_ERROR] ' || url || ': bad inn' FROM sites WHERE inn = 'bad'",
    BLOCKLIST, SITES,
)
_SCAN = "strftime(TIMESTAMP '2024-01-01' + to_hours(k % 8760), '%d.%m.%Y %H:%M')"
EXPORT = (
    "page_ord, contact_ord, coalesce(company_name, '') AS company_name, site_url, coalesce(company_email, '') AS company_email, coalesce(position_raw, '') AS position_raw,"
    " coalesce(upper(position_normalized[1]) || position_normalized[2:], '') AS position_normalized, coalesce(full_name, '') AS full_name,"
    f" {FIO_DATIVE} AS fio_dative, {NAME_PATRONYMIC} AS name_patronymic, CASE g WHEN 'м' THEN 'ый' ELSE 'ая' END AS gender_ending,"
    f" coalesce(personal_email, '') AS personal_email, {mobile(_PHONE)} AS phone_mobile, {city(_PHONE)} AS phone_city,"
    f" coalesce(inn, '') AS inn, coalesce(kpp, '') AS kpp, source_url, coalesce(page_language, '') AS page_language, {_SCAN} AS scan_date"
)
oracle("export_projection", f"SELECT {EXPORT} FROM dative", CONTACTS, FIO, GENDER, DATIVE)
oracle(
    "list_records", f"SELECT {EXPORT} FROM (SELECT * FROM dative ORDER BY site_url, page_ord, contact_ord LIMIT 20 OFFSET 10)",
    CONTACTS, FIO, GENDER, DATIVE,
)
oracle("save_blocklist", "SELECT kind, value FROM blocklist", BLOCKLIST)
oracle("export_blocklist_tsv", "SELECT kind || chr(9) || value AS line FROM blocklist", BLOCKLIST)

# --- pages and URLs -----------------------------------------------------------------
_NORMAL = (
    "lower(regexp_extract({u}, '^(https?://[^/?#]*)', 1)) || (CASE WHEN regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1) = '/' THEN '/'"
    " ELSE rtrim(regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1), '/') END) || regexp_extract({u}, '^[^?#]*(\\?[^#]+)', 1)"
)


def normal(u: str) -> str:
    return _NORMAL.format(u=u)


oracle("normalize_url", f"SELECT page_id, {normal('url')} AS url FROM pages")
oracle("site_domain", f"SELECT page_id, {domain_of('url')} AS domain, {domain_of(D.LISTED_URL)} AS listed FROM pages")
_BASE, _OTHER = "regexp_replace(host, '^www\\.', '')", "regexp_replace(lower(other), '^www\\.', '')"
oracle(
    "same_domain",
    f"SELECT page_ord AS page_id, other <> '' AND ({_OTHER} = {_BASE} OR ends_with({_OTHER}, '.' || {_BASE})) AS same FROM"
    f" (SELECT page_ord, host, {D.OTHER_HOST.replace('page_id', 'page_ord')} AS other FROM page_rows)",
    PAGE_ROWS,
)
# every link of the stored pages is root-relative and without markup inside
LINKS = (
    "links AS (SELECT page_ord, link_ord, site_url || h AS url, lower(t) AS text FROM (SELECT page_ord, site_url, unnest(hs) AS h, unnest(ts) AS t,"
    " CAST(generate_subscripts(hs, 1) - 1 AS BIGINT) AS link_ord FROM (SELECT *, regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1) AS hs,"
    " regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2) AS ts FROM page_rows)))"
)
_KEYS = words(vocab.CONTACT_PAGE_KEYWORDS)
RELEVANT = (
    f"len(list_filter({_KEYS}, lambda w: contains(text, w) OR contains(lower(url), replace(w, ' ', '-')) OR contains(lower(url), replace(w, ' ', '_')))) > 0"
)
oracle("page_links", f"SELECT page_ord, link_ord, {normal('url')} AS url, text FROM links", PAGE_ROWS, LINKS)
oracle("is_contact_page_link", f"SELECT page_ord, link_ord, {RELEVANT} AS relevant FROM links", PAGE_ROWS, LINKS)
oracle(
    "rank_contact_links",
    "SELECT page_ord, row_number() OVER (PARTITION BY page_ord ORDER BY length(u), first) - 1 AS link_rank, u AS url FROM ("
    f"SELECT page_ord, {normal('url')} AS u, min(link_ord) AS first FROM links WHERE {RELEVANT} GROUP BY 1, 2)",
    PAGE_ROWS, LINKS,
)
oracle(
    "is_static_asset",
    f"SELECT page_id, list_contains({words(vocab.STATIC_EXTENSIONS)}, lower(regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1))) AS static FROM ("
    "SELECT page_id, split_part(split_part(url || ['.PDF', '/a.js?x=1', '.html', '/x.woff2'][page_id % 4 + 1], '#', 1), '?', 1) AS p FROM pages)",
)
oracle(
    "cap_pages_per_site",
    "SELECT site_url, page_ord, page_rank FROM (SELECT site_url, page_ord, row_number() OVER (PARTITION BY site_url ORDER BY length(page_url), page_ord) AS page_rank FROM page_rows) WHERE page_rank <= 10",
    PAGE_ROWS,
)
# robots files are chosen by the length of the host; their rules, read by hand:
# 0: /a   1: /the (second group)   2: none (no group before)   3: everything
oracle(
    "robots_filter",
    "SELECT page_ord FROM (SELECT page_ord, length(host) % 4 AS f, coalesce(nullif(regexp_extract(page_url, '^https?://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM page_rows)"
    " WHERE NOT (f = 0 AND starts_with(path, '/a')) AND NOT (f = 1 AND starts_with(path, '/the')) AND f <> 3",
    PAGE_ROWS,
)
_CAPTCHA = "|".join(vocab.CAPTCHA_MARKERS)
oracle("drop_captcha_pages", f"SELECT page_ord FROM variants WHERE NOT regexp_matches(left(html, 5000), '(?i){_CAPTCHA}')", VARIANTS)
oracle(
    "page_language",
    "SELECT page_id AS page_ord, CASE page_id % 7 WHEN 0 THEN 'ru' WHEN 2 THEN 'en' WHEN 1 THEN 'de'"
    " ELSE coalesce(nullif(left(lower(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)), 2), ''), 'unknown') END AS lang FROM pages"
    " WHERE page_id % 7 NOT IN (0, 2, 3, 4) UNION ALL"
    " SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'ru' WHEN 2 THEN 'en' ELSE 'unknown' END FROM pages WHERE page_id % 7 IN (0, 2, 3, 4)",
)
oracle(
    "drop_failed_fetches",
    f"SELECT page_id FROM (SELECT page_id, {D.FETCH_STATUS} AS s FROM pages) WHERE s IN ('200', '301', '401')",
)
_HIDDEN = "html"
for _tag in ("script", "style", "noscript", "head"):
    _HIDDEN = f"regexp_replace({_HIDDEN}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', chr(1), 'g')"
_PIECES = f"string_split(regexp_replace(regexp_replace({_HIDDEN}, '(?s)<!--.*?-->', '', 'g'), '<[a-zA-Z/!?][^>]*>', chr(1), 'g'), chr(1))"
_UNESCAPED = "p"
for _entity, _char in (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&nbsp;", "\u00a0"), ("&amp;", "&"),
):
    _UNESCAPED = f"replace({_UNESCAPED}, '{_entity}', '{_char}')"
oracle(
    "html_to_text",
    f"SELECT page_id, array_to_string(list_filter(list_transform({_PIECES}, lambda p: regexp_replace(regexp_replace({_UNESCAPED}, '^[\\s\u00a0]+', ''), '[\\s\u00a0]+$', '')), lambda p: p <> ''), ' ') AS text FROM pages",
)
# stored titles hold no separator that leaves a usable last part, so the rest is null
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def _last(sep: str) -> str:
    parts = f"list_filter(list_transform(string_split(t, '{sep}'), lambda p: trim(p)), lambda p: p <> '')"
    return (
        f"CASE WHEN len({parts}) >= 2 AND length({parts}[-1]) > 3 AND NOT list_contains({words(vocab.GARBAGE_TITLE_PARTS)}, lower({parts}[-1])) THEN {parts}[-1] END"
    )


_STORED_TITLE = _TITLE
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    _STORED_TITLE = f"replace({_STORED_TITLE}, '{_entity}', '{_char}')"
oracle(
    "company_name_from_page",
    "SELECT page_ord, CASE v WHEN 0 THEN 'Завод Прогресс' WHEN 1 THEN 'Рога & Копыта' WHEN 3 THEN 'ООО \"Ёлка\"' WHEN 2 THEN NULL WHEN 4 THEN NULL"
    f" ELSE coalesce({_last('|')}, {_last('—')}, {_last('–')}, {_last('·')}) END AS company_name"
    f" FROM (SELECT page_id AS page_ord, page_id % 7 AS v, {_STORED_TITLE} AS t FROM pages)",
)
oracle("dedup_pages", f"SELECT site_url, min(page_ord) AS page_ord FROM page_rows GROUP BY site_url, {normal('page_url')}", PAGE_ROWS)

# --- entities ------------------------------------------------------------------------
TEXTS = (
    "texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL"
    f" SELECT 'c', c_custkey, {D.CONTACT_TEXT} FROM customer)"
)
_RUNS = "regexp_extract_all(text, '[0-9]+')"
oracle("extract_inn", f"SELECT kind, id, list_filter({_RUNS}, lambda r: length(r) IN (10, 12))[1] AS inn FROM texts", TEXTS)
# a labelled number may be the start of a longer one; the texts hold no such case
oracle("extract_kpp", f"SELECT kind, id, list_filter({_RUNS}, lambda r: length(r) = 9)[1] AS kpp FROM texts", TEXTS)
oracle(
    "extract_labelled_inn_kpp",
    "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '500100732259' WHEN 2 THEN '500100732259' END AS inn,"
    " CASE c_custkey % 6 WHEN 0 THEN '770701001' WHEN 1 THEN '770701001' END AS kpp FROM customer",
)
oracle("extract_fio_first", "SELECT page_ord, name_a AS full_name FROM people", PEOPLE)
oracle(
    "extract_fio_all",
    "SELECT page_ord, CAST(0 AS BIGINT) AS pos, name_a AS full_name FROM people UNION ALL SELECT page_ord, 1, name_b FROM people WHERE kind <> 6", PEOPLE,
)
_SOCIAL = {
    "vk": {0: "https://www.vk.com/club1"}, "telegram": {0: "https://t.me/chan"}, "twitter": {1: "HTTPS://X.com/me"},
    "youtube": {1: "https://www.youtube.com/channel/UC1"}, "ok": {1: "https://ok.ru/g?a=1"},
    "linkedin": {2: "https://linkedin.com/in/a"}, "facebook": {2: "https://facebook.com/c"}, "instagram": {},
}
oracle(
    "extract_social_links",
    "SELECT page_id AS page_ord, "
    + ", ".join(
        "CASE page_id % 4 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in arms.items()) + f" ELSE NULL END AS {n}" if arms else f"CAST(NULL AS VARCHAR) AS {n}"
        for n, arms in _SOCIAL.items()
    )
    + " FROM pages",
)
_MAILS = "[personal_email, company_email]"
contact_rows(
    "split_generic_emails",
    f"array_to_string(list_transform(list_filter({_MAILS}, lambda e: {generic('e')}), lambda e: lower(e)), ',') AS company,"
    f" array_to_string(list_filter(list_transform(list_filter({_MAILS}, lambda e: NOT {generic('e')}), lambda e: lower(e)), lambda e: e IS NOT NULL), ',') AS personal",
)
oracle(
    "company_email",
    "SELECT page_ord, CASE WHEN kind <> 6 THEN 'info@site' || CAST(site_idx AS STRING) || '.example.ru' END AS company_email FROM people", PEOPLE,
)
_NEAR = "|".join(vocab.NEAR_POSITION_TITLES).replace("\\w", "[\\p{L}\\p{N}_]")
_NOUNS = "|".join(f"[А-ЯЁ][а-яё]+ {n}" for n in vocab.NEAR_POSITION_NOUNS)
_AROUND = "concat_ws(' ', 'Наш', position_raw, 'это', full_name, 'и другие')"
_WINDOW = f"{_AROUND}[greatest(instr({_AROUND}, full_name) - 200, 1) : instr({_AROUND}, full_name) + length(full_name) + 199]"
oracle(
    "position_near_name",
    f"SELECT page_ord, contact_ord, coalesce(nullif(regexp_extract({_WINDOW}, '(?i)({_NEAR})', 1), ''), nullif(regexp_extract({_WINDOW}, '(?i)({_NOUNS})', 1), '')) AS position"
    " FROM contacts WHERE full_name IS NOT NULL",
    CONTACTS,
)

# what the pages were built from is what must be found on them
SIDES = (
    "sides AS (SELECT *, 0 AS side, name_a AS full_name, position_a AS position, email_a AS email, phone_a AS phone_raw FROM people UNION ALL"
    " SELECT *, 1, name_b, position_b, email_b, phone_b FROM people WHERE kind <> 6)"
)
# kind 1 has an outer block that reads like its first card
BLOCKS = (
    "blocks AS (SELECT *, CAST(side + (kind = 1)::INT AS BIGINT) AS block_ord FROM sides WHERE kind < 5 UNION ALL"
    " SELECT *, 0 FROM sides WHERE kind = 1 AND side = 0)"
)
_CARD_TEXT = "full_name || ', ' || position || ' E-mail: ' || email || ' Тел: ' || phone_raw || ' VK'"
_ITEM_TEXT = "full_name || ' ' || position || ' ' || email || ' ' || phone_raw"
oracle(
    "person_blocks",
    f"SELECT page_ord, block_ord, CASE WHEN kind > 1 THEN {_ITEM_TEXT} WHEN kind = 1 AND block_ord = 0 THEN {_CARD_TEXT} || ' ' || (SELECT {_CARD_TEXT} FROM sides s WHERE s.page_ord = b.page_ord AND s.side = 1)"
    f" ELSE {_CARD_TEXT} END AS text FROM blocks b",
    PEOPLE, SIDES, BLOCKS,
)
oracle("person_blocks_fallback", f"SELECT page_ord, block_ord, {_ITEM_TEXT} AS text FROM blocks WHERE kind > 1", PEOPLE, SIDES, BLOCKS)
oracle("position_from_block", "SELECT page_ord, block_ord, position FROM blocks", PEOPLE, SIDES, BLOCKS)
_CHECK = (
    "page_ord, {place} AS contact_ord, site_url, CASE WHEN kind = 6 THEN '' ELSE 'ООО Пример ' || CAST(site_idx AS STRING) END AS company_name,"
    " CASE WHEN kind <> 6 THEN inn END AS inn, CASE WHEN kind <> 6 THEN kpp END AS kpp,"
    " CASE WHEN kind <> 6 THEN 'info@site' || CAST(site_idx AS STRING) || '.example.ru' END AS company_email, full_name, {position} AS position_raw,"
    " CASE WHEN kind <> 6 THEN email END AS personal_email, CASE WHEN kind <> 6 THEN " + e164("phone_raw") + " END AS phone,"
    " CASE WHEN kind <> 6 THEN phone_raw END AS phone_raw"
)


def checked(place: str, position: str) -> str:
    return _CHECK.replace("{place}", place).replace("{position}", position)


oracle(
    "contacts_from_blocks",
    f"SELECT {checked('block_ord', 'position')}, CASE WHEN kind < 2 THEN 'https://vk.com/id' || CAST(k AS STRING) END AS vk FROM blocks",
    PEOPLE, SIDES, BLOCKS,
)
# the first title of the page is within reach of both names
_FOUND = "CASE WHEN position_a IN ('Генеральный директор', 'Главный бухгалтер', 'Финансовый директор') THEN position_a WHEN position_b = 'Генеральный директор' THEN position_b END"
_NEAREST = f"CASE WHEN kind <> 6 THEN {_FOUND} END"
oracle("contacts_from_text", f"SELECT {checked('CAST(side AS BIGINT)', _NEAREST)} FROM sides", PEOPLE, SIDES)
_EXTRACTED = f"CASE WHEN kind < 5 THEN position WHEN kind = 5 THEN {_FOUND} END"
EXTRACTED = (
    f"SELECT {checked('CAST(side AS BIGINT)', _EXTRACTED)}, {_EXTRACTED} AS position_normalized,"
    " CASE WHEN kind = 6 THEN 'unknown' ELSE 'ru' END AS page_language FROM sides"
)
oracle("extract_contacts", EXTRACTED, PEOPLE, SIDES)
oracle("stream_extract_contacts", EXTRACTED, PEOPLE, SIDES)
oracle(
    "extract_page_entities",
    "SELECT page_ord, CASE WHEN kind = 6 THEN 'unknown' ELSE 'ru' END AS lang, CASE WHEN kind <> 6 THEN 'ООО Пример ' || CAST(site_idx AS STRING) END AS company_name,"
    " CASE WHEN kind <> 6 THEN inn END AS inn, CASE WHEN kind <> 6 THEN kpp END AS kpp, CASE WHEN kind <> 6 THEN 'info@site' || CAST(site_idx AS STRING) || '.example.ru' END AS company_email,"
    " CAST(CASE WHEN kind = 6 THEN 0 ELSE 2 END AS BIGINT) AS n_phones, CAST(CASE WHEN kind = 6 THEN 1 ELSE 2 END AS BIGINT) AS n_names,"
    " CAST(CASE WHEN kind = 6 THEN 0 ELSE 2 END AS BIGINT) AS n_personal FROM people",
    PEOPLE,
)
oracle(
    "extract_names_latin",
    f"SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[À-ɏ]', '_', 'g'), '\\b[A-Z][a-z]{{1,20}}\\s+[A-Z][a-z]{{1,20}}(?:\\s+[A-Z][a-z]{{1,20}})?\\b')) AS name FROM documents)"
    f" WHERE NOT list_contains({words(vocab.LATIN_NAME_STOP)}, name)",
)

# --- joins ------------------------------------------------------------------------------
oracle("block_domains", f"SELECT page_ord, page_url FROM page_rows WHERE NOT {on_list(domain_of('page_url'))}", PAGE_ROWS, BLOCKLIST)
oracle("stoplist_filter", f"SELECT page_ord, url FROM listed WHERE NOT {on_list(domain_of('url'))}", LISTED, STOP)


def mail_blocked(e: str) -> str:
    low = f"lower(trim({e}))"
    host = domain_of(f"'http://' || regexp_extract({low}, '^[^@]*@(.*)$', 1)")
    exact = f"EXISTS (SELECT 1 FROM blocklist b WHERE b.kind = 'email' AND b.value = {low})"
    return f"({exact} OR coalesce({on_list(host)}, false))"


def inn_blocked(i: str) -> str:
    return f"EXISTS (SELECT 1 FROM blocklist b WHERE b.kind = 'inn' AND b.value = trim({i}))"


MAIL = "mail AS (SELECT doc_id AS page_ord, email FROM doc_emails UNION ALL SELECT page_ord, personal_email FROM contacts)"
oracle("block_emails", f"SELECT page_ord, email FROM mail WHERE NOT {mail_blocked('email')}", DOC_EMAILS, CONTACTS, MAIL, BLOCKLIST)
oracle("block_inns", f"SELECT page_ord, contact_ord, inn FROM contacts WHERE NOT {inn_blocked('inn')}", CONTACTS, BLOCKLIST)
oracle(
    "block_any",
    f"SELECT page_ord, contact_ord FROM contacts WHERE NOT ({on_list(domain_of('site_url'))} OR {mail_blocked('personal_email')} OR {inn_blocked('inn')})",
    CONTACTS, BLOCKLIST,
)


def key_of(url: str) -> str:
    host = f"regexp_replace(lower(regexp_extract({url}, '(?i)^https?://([^/?#]*)', 1)), ':(80|443)$', '')"
    return f"(regexp_replace({host}, '^www\\.', '') || rtrim(regexp_extract({url}, '(?i)^https?://[^/?#]*([^?#]*)', 1), '/'))"


LISTS = (
    f"lists AS (SELECT *, {key_of('url')} AS key FROM (SELECT {fields(D.LISTED_SITE_SQL)} FROM supplier UNION ALL SELECT {fields(D.LISTED_PAGE_SQL)} FROM supplier)"
    " QUALIFY row_number() OVER (PARTITION BY key ORDER BY site_ord) = 1)"
)


def matched(source: str, page: str) -> str:
    """matched(k, ...): the listed site of every row of `source` that has one."""
    under = f"({key_of(page)} = l.key OR starts_with({key_of(page)}, l.key || '/'))"
    return (
        f"matched AS (SELECT t.k, l.url, l.site_ord, nullif(trim(l.company_name), '') AS company, nullif(l.inn, '') AS inn FROM {source} t JOIN lists l"
        f" ON {under} QUALIFY row_number() OVER (PARTITION BY t.k ORDER BY length(l.key) DESC) = 1)"
    )


_JOINED = "FROM contacts c LEFT JOIN matched m ON m.k = c.k"
oracle("site_defaults", f"SELECT page_ord, contact_ord, m.company AS site_company, m.inn AS site_inn {_JOINED}", CONTACTS, LISTS, matched("contacts", "source_url"))
oracle(
    "apply_input_company",
    "SELECT page_ord, contact_ord, CASE WHEN m.company IS NOT NULL THEN m.company WHEN length(coalesce(c.company_name, '')) < 3 THEN '' ELSE c.company_name END AS company_name,"
    f" {STRICT_INN.format(x='coalesce(m.inn, c.inn)')} AS inn {_JOINED}",
    CONTACTS, LISTS, matched("contacts", "source_url"),
)
oracle(
    "match_sites", "SELECT DISTINCT page_url, m.url AS listed_url, m.site_ord AS listed_ord FROM people p JOIN matched m ON m.k = p.k",
    PEOPLE, LISTS, matched("people", "page_url"),
)
oracle(
    "fill_from_page_text",
    "SELECT page_ord, contact_ord, coalesce(nullif(i, ''), CASE WHEN max(nullif(i, '')) OVER w IS NULL THEN t.inn END, i) AS inn,"
    " coalesce(nullif(c.kpp, ''), CASE WHEN max(nullif(c.kpp, '')) OVER w IS NULL THEN t.kpp END, c.kpp) AS kpp"
    " FROM (SELECT *, CASE WHEN page_ord % 2 = 0 THEN inn END AS i FROM contacts) c LEFT JOIN ("
    "SELECT site_url AS s, arg_min(inn, page_ord) AS inn, min(kpp) AS kpp FROM people WHERE kind <> 6 GROUP BY 1) t ON t.s = c.site_url WINDOW w AS (PARTITION BY site_url)",
    CONTACTS, PEOPLE,
)
INDEXED = "indexed AS (SELECT *, row_number() OVER (PARTITION BY site_url ORDER BY k) AS idx FROM contacts)"
FIXES = f"fixes AS (SELECT {fields(D.CORRECTION_SQL)}, true AS fixed FROM customer)"


def _over(column: str, fix: str) -> str:
    return f"coalesce(nullif(f.{fix}, ''), c.{column}) AS {column}"


def _into(column: str, fix: str) -> str:
    return f"coalesce(nullif(c.{column}, ''), nullif(f.{fix}, ''), c.{column}) AS {column}"


oracle(
    "apply_corrections",
    f"SELECT page_ord, contact_ord, {_over('company_name', 'company_name')}, {_over('full_name', 'full_name')}, {_into('position_raw', 'position')},"
    f" {_over('position_normalized', 'position')}, {_over('personal_email', 'personal_email')}, {_into('company_email', 'company_email')}, {_over('phone', 'phone')}"
    " FROM indexed c LEFT JOIN fixes f ON f.site_url = c.site_url AND f.idx = c.idx WHERE f.fixed IS NULL OR f.full_name IS NOT NULL",
    CONTACTS, INDEXED, FIXES,
)
oracle("contact_index", "SELECT page_ord, contact_ord, site_url, idx FROM indexed", CONTACTS, INDEXED)
GOLD = "gold AS (SELECT DISTINCT site_url, full_name FROM sides WHERE kind <> 6)"
oracle(
    "contacts_vs_gold",
    "SELECT site_url, name, bool_or(f) AS found, bool_or(g) AS in_gold FROM (SELECT site_url, lower(full_name) AS name, true AS f, false AS g FROM sides WHERE kind <> 6 UNION ALL"
    " SELECT site_url, lower(name_a), false, true FROM people UNION ALL SELECT site_url, lower(name_b), false, true FROM people WHERE k % 9 <> 0) GROUP BY site_url, name",
    PEOPLE, SIDES,
)
oracle(
    "precision_recall",
    "SELECT count(*) FILTER (WHERE a AND b) AS n_right, count(*) FILTER (WHERE a) AS n_found, count(*) FILTER (WHERE b) AS n_gold,"
    " round(count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE a), 6) AS precision, round(count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE b), 6) AS recall FROM ("
    " SELECT s, n, bool_or(a) AS a, bool_or(b) AS b FROM (SELECT site_url AS s, lower(trim(full_name)) AS n, true AS a, false AS b FROM contacts UNION ALL"
    " SELECT site_url, lower(full_name), false, true FROM gold) GROUP BY s, n)",
    CONTACTS, PEOPLE, SIDES, GOLD,
)

# --- dedup and aggregates --------------------------------------------------------------------
_NAME_KEY = "lower(trim(coalesce(full_name, ''))), lower(trim(coalesce(company_name, '')))"
_EXACT_KEY = "site_url, coalesce(full_name, ''), coalesce(personal_email, ''), coalesce(phone, '')"
oracle(
    "dedup_name_company",
    f"SELECT page_ord, contact_ord, full_name, company_name FROM contacts QUALIFY {FIRST.format(keys='site_url, page_ord, ' + _NAME_KEY)}", CONTACTS,
)
oracle(
    "dedup_name_email_phone",
    f"SELECT page_ord, contact_ord, full_name, personal_email, phone FROM contacts QUALIFY {FIRST.format(keys=_EXACT_KEY)}", CONTACTS,
)
_FIELDS = ["personal_email", "company_email", "phone", "inn", "kpp", "position_raw", "position_normalized"]
_W = f"(PARTITION BY site_url, {_NAME_KEY} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
MERGED = (
    "SELECT page_ord, contact_ord, full_name, company_name, "
    + ", ".join(f"first_value(nullif({c}, '') IGNORE NULLS) OVER {_W} AS {c}" for c in _FIELDS)
    + f" FROM contacts QUALIFY {FIRST.format(keys='site_url, ' + _NAME_KEY)}"
)
oracle("dedup_merge", MERGED, CONTACTS)
oracle("stream_upsert_merge", MERGED, CONTACTS)
_SITE_W = "(PARTITION BY site_url ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def propagated(column: str) -> str:
    return f"coalesce(nullif({column}, ''), first_value(nullif({column}, '') IGNORE NULLS) OVER {_SITE_W}) AS {column}"


contact_rows("propagate_inn_kpp", f"{propagated('inn')}, {propagated('kpp')}")
contact_rows("propagate_company_email", propagated("company_email"))
oracle("ui_category_counts", f"SELECT coalesce(c, 'all') AS category, count(*) AS n FROM (SELECT {UI} AS c FROM contacts) GROUP BY GROUPING SETS ((c), ())", CONTACTS)
_P, _C = "personal_email", "company_email"
FINAL = (
    f"final AS (SELECT k, site_url, {one_space('full_name')} AS full_name, CASE WHEN contains(company_name, ';') THEN trim(split_part(company_name, ';', 1)) ELSE company_name END AS company_name,"
    f" {final_name('full_name')} AS ok, {blocked_name('full_name')} AS bad, {final_position('position_raw')} AS pr,"
    f" CASE WHEN {generic_final(_P)} THEN NULL ELSE nullif(lower(trim({_P})), '') END AS pe, nullif(phone, '') AS phone, {valid_inn('inn')} AS inn FROM contacts)"
)
oracle(
    "normalization_report",
    "SELECT outcome, count(*) AS n_rows FROM (SELECT CASE WHEN NOT ok THEN 'name' WHEN bad THEN 'blocked_name' WHEN coalesce(pe, phone, pr, inn) IS NULL THEN 'no_field'"
    " WHEN row_number() OVER (PARTITION BY NOT ok OR bad OR coalesce(pe, phone, pr, inn) IS NULL, site_url, lower(trim(coalesce(full_name, ''))), lower(trim(coalesce(company_name, ''))) ORDER BY k) = 1"
    " THEN 'kept' ELSE 'merged' END AS outcome FROM final) GROUP BY outcome",
    CONTACTS, FINAL,
)
TASKS = f"tasks AS (SELECT {fields(D.TASK_SQL)} FROM orders)"
oracle(
    "task_totals",
    "SELECT count(*) AS total_tasks, CAST(sum(contacts_found) AS BIGINT) AS total_contacts, CAST(sum(processed_sites) AS BIGINT) AS total_sites, CAST(sum(total_pages) AS BIGINT) AS total_pages,"
    " round(avg(processed_sites / (elapsed_seconds / 60)) FILTER (WHERE status = 'completed' AND elapsed_seconds > 0 AND processed_sites > 0), 1) AS avg_speed,"
    " count(*) FILTER (WHERE status = 'completed') AS completed_tasks, count(*) FILTER (WHERE status = 'running') AS running_tasks, count(*) FILTER (WHERE status = 'failed') AS failed_tasks FROM tasks",
    TASKS,
)
oracle(
    "contacts_by_day",
    "SELECT strftime(d, '%Y-%m-%d') AS day, CAST(coalesce(sum(event_id % 9), 0) AS BIGINT) AS n FROM (SELECT unnest(generate_series(DATE '2024-01-27', DATE '2024-02-02', INTERVAL 1 DAY)) AS d)"
    " LEFT JOIN events ON CAST(ts AS DATE) = CAST(d AS DATE) GROUP BY d",
)
oracle("blocklist_stats", "SELECT coalesce(kind, 'total') AS kind, count(*) AS n FROM blocklist GROUP BY GROUPING SETS ((kind), ())", BLOCKLIST)
CALLS = "calls AS (SELECT role AS session, conv_id, turn, length(text) AS p, length(text) % 7 AS c FROM conversations)"
oracle(
    "token_usage",
    "SELECT CAST(1000000 AS BIGINT) AS budget, CAST(sum(p + c) AS BIGINT) AS used, CAST(greatest(1000000 - sum(p + c), 0) AS BIGINT) AS remaining, sum(p + c) >= 1000000 AS exhausted,"
    " count(*) AS request_count, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens FROM calls",
    CALLS,
)
oracle(
    "token_budget_cutoff",
    "SELECT session, conv_id, turn, CAST(CASE WHEN u >= 100000 THEN min(u) FILTER (WHERE u >= 100000) OVER (PARTITION BY session) ELSE u END AS BIGINT) AS used_before, u >= 100000 AS refused FROM (SELECT *, coalesce(sum(p + c) OVER (PARTITION BY session ORDER BY conv_id, turn"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM calls)",
    CALLS,
)
oracle(
    "site_summary",
    "SELECT site_url, count(*) FILTER (WHERE w = 'p') AS n_pages, count(*) FILTER (WHERE w = 'c') AS n_contacts, count(*) FILTER (WHERE w = 'e') AS n_errors FROM ("
    "SELECT site_url, 'p' AS w FROM page_rows UNION ALL SELECT site_url, 'c' FROM contacts UNION ALL"
    f" SELECT regexp_extract(url, '^(https?://[^/?#]*)', 1), 'e' FROM pages WHERE {D.FETCH_STATUS} IN ('403', '404', '429', '500', '503')) GROUP BY site_url",
    PAGE_ROWS, CONTACTS,
)
oracle(
    "upload_preview",
    "SELECT (SELECT count(*) FROM sites) AS rows_count, string_agg(url, ',' ORDER BY site_ord) AS preview_urls FROM (SELECT * FROM sites ORDER BY site_ord LIMIT 10)", SITES,
)
oracle("new_blocklist_entries", "SELECT count(*) AS added FROM (SELECT * FROM blocklist EXCEPT SELECT * FROM known)", BLOCKLIST, KNOWN)
oracle("blocklist_add", "SELECT * FROM blocklist UNION SELECT * FROM known", BLOCKLIST, KNOWN)
oracle("blocklist_remove", "SELECT * FROM blocklist EXCEPT SELECT * FROM known", BLOCKLIST, KNOWN)
oracle(
    "fallback_counts",
    "SELECT ['llm_timeout', 'llm_http_error', 'llm_unavailable'][event_id % 3 + 1] AS reason, count(*) AS n FROM events GROUP BY 1",
)
oracle(
    "progress_track",
    "SELECT event_id, task_id, processed, round(processed * 100.0 / 1000, 4) AS percent, round((1000 - processed) / (processed / s), 2) AS eta_seconds FROM ("
    "SELECT event_id, user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS processed, CAST(floor(epoch(ts)) - epoch(TIMESTAMP '2023-12-31 23:00:00') AS DOUBLE) AS s FROM events)",
)

# --- sort, paging, search, sets ------------------------------------------------------------------
oracle("list_tasks", "SELECT task_id, status FROM tasks WHERE status = 'completed' ORDER BY created_at DESC, task_id LIMIT 50 OFFSET 20", TASKS)
oracle("sort_tasks", "SELECT task_id, contacts_found FROM tasks ORDER BY contacts_found DESC, task_id", TASKS)
oracle(
    "search_contacts",
    "SELECT page_ord, contact_ord FROM contacts WHERE contains(lower(concat_ws(chr(1), full_name, company_name, coalesce(position_normalized, position_raw), personal_email, phone, inn)), 'иван')",
    CONTACTS,
)
contact_rows("sort_contacts", "full_name")
oracle(
    "order_categories",
    f"SELECT category, count(*) AS n, CAST(list_position({words([*vocab.CATEGORY_VARIANTS, vocab.DEFAULT_CATEGORY])}, category) - 1 AS BIGINT) AS category_ord FROM categorised GROUP BY category",
    *CAT,
)
contact_rows("union_site_results", "site_url")
oracle("distinct_values", "SELECT DISTINCT email FROM mail", DOC_EMAILS, CONTACTS, MAIL)

# --- streaming ---------------------------------------------------------------------------------------
# A watermark is the latest time of the batches before, less the delay; a batch without rows follows the last one.
def _marks(source: str, delay_ms: int, batches: int) -> str:
    return (
        f"marks AS (SELECT b, coalesce(greatest(max(m) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {delay_ms}, 0), 0) AS w FROM ("
        f"SELECT r.b, max(ms) AS m FROM (SELECT unnest(range({batches + 1})) AS b) r LEFT JOIN {source} s ON s.b = r.b GROUP BY r.b))"
    )


_HOUR = 3_600_000
ARRIVALS = (
    f"arrivals AS (SELECT {fields(D.ARRIVING_CONTACT_SQL)}, b, site_idx || '/' || person || '/' || coalesce(CASE k % 6 WHEN 4 THEN '' WHEN 5 THEN '' ELSE '1' END, '') AS key"
    f" FROM (SELECT {fields(D.CONTACT_KEYS)}, {D.arrival('c_custkey', 'customer', 4)} AS b FROM customer))"
)
oracle(
    "stream_dedup_contacts",
    "SELECT page_ord, contact_ord, site_url, full_name, phone, ms, 'late' AS outcome FROM timely WHERE late UNION ALL"
    " SELECT page_ord, contact_ord, site_url, full_name, phone, ms, 'first' FROM walk JOIN timely t ON t.key = walk.key AND t.b = walk.b AND t.ms = walk.came AND NOT late",
    "RECURSIVE " + ARRIVALS, _marks("arrivals", _HOUR, 4), "timely AS (SELECT a.*, a.ms < w AS late FROM arrivals a JOIN marks USING (b))",
    "firsts AS (SELECT key, b, min(ms) AS ms FROM timely WHERE NOT late GROUP BY ALL)",
    "walk(key, b, seen, came) AS (SELECT DISTINCT key, -1, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM arrivals UNION ALL"
    f" SELECT k.key, m.b, CASE WHEN k.seen + {_HOUR} >= m.w THEN k.seen ELSE f.ms END, CASE WHEN k.seen + {_HOUR} >= m.w THEN NULL ELSE f.ms END"
    " FROM walk k JOIN marks m ON m.b = k.b + 1 LEFT JOIN firsts f ON f.key = k.key AND f.b = m.b)",
)
STREAMED = f"streamed AS (SELECT {fields(D.STREAM_EVENT_SQL)}, {D.arrival('event_id', 'events', 4)} AS b FROM events)"
oracle(
    "stream_progress",
    "SELECT start, task_id, n_events, CAST(value AS DOUBLE) AS value, CAST(processed AS BIGINT) AS processed, round(100.0 * processed / 100000, 6) AS percent, round(processed / minutes, 6) AS rate,"
    " round(greatest(100000 - processed, 0) / (processed / minutes), 3) AS eta_minutes FROM (SELECT *, sum(n_events) OVER t AS processed, (start - min(start) OVER t) / 60000.0 + 30 AS minutes FROM ("
    " SELECT ms // 1800000 * 1800000 AS start, task_id, count(*) AS n_events, sum(value) AS value FROM streamed GROUP BY 1, 2)"
    f" WHERE start + 1800000 <= (SELECT max(ms) FROM streamed) - {4 * _HOUR} WINDOW t AS (PARTITION BY task_id ORDER BY start))",
    STREAMED,
)
oracle(
    "stream_terminal_status",
    "SELECT task_id, 'late' AS outcome, type, ms AS closed_at, CAST(1 AS BIGINT) AS n_events FROM timely WHERE late UNION ALL"
    " SELECT task_id, 'closed', done.type, done.ms, CAST(done.n AS BIGINT) FROM walk WHERE done IS NOT NULL",
    "RECURSIVE " + STREAMED, _marks("streamed", _HOUR, 4), "timely AS (SELECT s.*, s.ms < w AS late FROM streamed s JOIN marks USING (b))",
    "steps AS (SELECT task_id, b, count(*) AS n, arg_max(type, (ms, event_id)) AS type, max((ms, event_id)) AS last, max(ms) AS ms FROM timely WHERE NOT late GROUP BY task_id, b)",
    "walk(task_id, b, n, last, ms, type, done) AS (SELECT DISTINCT task_id, -1, CAST(0 AS BIGINT), CAST(NULL AS ROW(ms BIGINT, id BIGINT)), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR),"
    " CAST(NULL AS ROW(type VARCHAR, ms BIGINT, n BIGINT)) FROM streamed UNION ALL"
    " SELECT task_id, b, n + coalesce(sn, 0), CASE WHEN sl IS NULL OR last > sl THEN last ELSE sl END, CASE WHEN sl IS NULL OR last > sl THEN ms ELSE sm END,"
    " CASE WHEN sl IS NULL OR last > sl THEN type ELSE st END, done FROM (SELECT k.task_id, m.b, CASE WHEN shut THEN 0 ELSE k.n END AS n, CASE WHEN NOT shut THEN k.last END AS last,"
    " CASE WHEN NOT shut THEN k.ms END AS ms, CASE WHEN NOT shut THEN k.type END AS type, CASE WHEN shut THEN CAST(ROW(k.type, k.ms, k.n) AS ROW(type VARCHAR, ms BIGINT, n BIGINT)) END AS done,"
    " s.n AS sn, CAST(s.last AS ROW(ms BIGINT, id BIGINT)) AS sl, s.ms AS sm, s.type AS st FROM (SELECT w.*, coalesce(w.type IN ('completed', 'error', 'cancelled')"
    f" AND w.ms + {_HOUR} < (SELECT m.w FROM marks m WHERE m.b = w.b + 1), false) AS shut FROM walk w) k JOIN marks m ON m.b = k.b + 1"
    " LEFT JOIN steps s ON s.task_id = k.task_id AND s.b = m.b))",
)

# --- prompts and answers --------------------------------------------------------------------------------


def _dash(c: str) -> str:
    return f"coalesce(nullif({c}, ''), '-')"


oracle(
    "correction_prompts",
    "SELECT i.site_url, (idx - 1) // 500 AS part, count(*) AS n_contacts, 'Сайт: ' || i.site_url || chr(10) || 'Компания (из входного файла): ' || coalesce(any_value(m.company), '')"
    f" || chr(10) || chr(10) || '{CORRECTION_TASK}' || chr(10) || chr(10) || 'Таблица:' || chr(10) || string_agg("
    f"idx || '. ФИО: ' || {_dash('full_name')} || ' | Должность: ' || {_dash('position_raw')} || ' | Email: ' || {_dash('personal_email')} || ' | Тел: ' || {_dash('phone')},"
    " chr(10) ORDER BY idx) AS prompt FROM indexed i LEFT JOIN matched m ON m.k = i.site_url GROUP BY i.site_url, (idx - 1) // 500",
    CONTACTS, INDEXED, LISTS, matched("(SELECT DISTINCT site_url AS k, site_url FROM contacts)", "site_url"),
)
_NL = "chr(10)"
oracle(
    "page_prompts",
    f"SELECT doc_id AS page_ord, 'https://' || source AS page_url, part, 'Компания: ' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'неизвестна' END || {_NL} || 'URL: https://' || source || {_NL}"
    f" || 'Целевые должности для поиска: Юрист, CFO' || {_NL} || {_NL} || 'Текст страницы:' || {_NL} || substr(text, part * 12288 + 1, 12288) AS prompt"
    " FROM (SELECT *, unnest(range(CAST(greatest(ceil(length(text) / 12288.0), 1) AS BIGINT))) AS part FROM documents)",
)
oracle(
    "parse_answers",
    "SELECT 's' || c_custkey AS site_url, 1 + c_custkey % 9 AS idx, CAST(NULL AS VARCHAR) AS company_name, CASE WHEN c_custkey % 3 <> 0 THEN 'Новый Иван ' || c_custkey END AS full_name, 'Юрист' AS position,"
    " CAST(NULL AS VARCHAR) AS personal_email, CAST(NULL AS VARCHAR) AS company_email, '7' || c_custkey AS phone FROM customer UNION ALL"
    " SELECT 's' || c_custkey, 0, NULL, 'Без номера', NULL, NULL, NULL, NULL FROM customer",
)


# --- everything together --------------------------------------------------------------------------------
# The pages give valid names, positions and personal mailboxes only, so the
# checks remove nothing here; site list, blocklist, dedups and propagation do act.
_PERSON_W = "(PARTITION BY site_url, lower(full_name), lower(company_name) ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
FOUND = (
    "found AS (SELECT s.page_ord * 10 + side AS k, s.page_ord, CAST(side AS BIGINT) AS contact_ord, l.url AS site_url,"
    " coalesce(l.company, 'ООО Пример ' || CAST(site_idx AS STRING)) AS company_name, full_name,"
    f" {_EXTRACTED} AS position_raw, email AS personal_email, 'info@site' || CAST(site_idx AS STRING) || '.example.ru' AS company_email,"
    f" {e164('phone_raw')} AS phone, {STRICT_INN.format(x='coalesce(l.inn, s.inn)')} AS inn, kpp"
    f" FROM sides s JOIN matched l ON l.k = s.k WHERE kind <> 6 AND NOT {on_list(domain_of('l.url'))}"
    " QUALIFY row_number() OVER (PARTITION BY l.url, full_name, email, phone_raw ORDER BY s.page_ord, side) = 1)"
)
ONE_PERSON = (
    "one_person AS (SELECT k, page_ord, contact_ord, site_url, company_name, full_name, "
    + ", ".join(f"first_value({c} IGNORE NULLS) OVER {_PERSON_W} AS {c}" for c in ("position_raw", "personal_email", "company_email", "phone", "inn", "kpp"))
    + " FROM found QUALIFY row_number() OVER (PARTITION BY site_url, lower(full_name), lower(company_name) ORDER BY k) = 1)"
)
FILLED = (
    f"contacts AS (SELECT * EXCLUDE (inn), position_raw AS position_normalized, coalesce(inn, first_value(inn IGNORE NULLS) OVER {_SITE_W}) AS inn FROM one_person)"
)
oracle(
    "site_contacts",
    "SELECT site_url, page_ord, contact_ord, company_name, full_name, position_normalized, category, personal_email, company_email, phone, inn, kpp FROM categorised",
    PEOPLE, SIDES, LISTS, matched("people", "page_url"), BLOCKLIST, FOUND, ONE_PERSON, FILLED, CATEGORY_TABLES, CATEGORISED,
)
oracle(
    "expand_link_frontier",
    "SELECT w.site_url, w.k AS page_ord, CAST(min(w.depth) AS BIGINT) AS depth FROM walk w GROUP BY 1, 2",
    "RECURSIVE " + PEOPLE,
    "walk(site_url, k, depth) AS (SELECT site_url, min(k), 0 FROM people GROUP BY 1"
    " UNION SELECT w.site_url, p.k, w.depth + 1 FROM walk w JOIN people p ON p.site_url = w.site_url AND p.k - w.k IN (1, 2, 4, 8, 16, 32, 64, 128, 256, 512))",
)
