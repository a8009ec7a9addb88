"""Inputs derived from the given tables where these hold no contacts.

Field definitions are plain SQL text that Spark and an ANSI engine read alike,
so that both sides of a check start from the same rows.  They define inputs
only; no operator logic lives here.  A third of all rows fall on one site, so
every query over these tables meets a hot key.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(number: str, values: list[str | None]) -> str:
    """SQL: the value at `number` modulo the length of the list."""
    listed = "¦".join("∅" if v is None else v for v in values)
    value = f"split_part('{listed}', '¦', CAST(({number}) % {len(values)} + 1 AS INT))"
    return f"nullif({value}, '∅')" if None in values else value


MALE = ["Калашников", "Достоевский", "Толстой", "Соболь", "Белый", "Коваленко", "Фомин", "Зайцев"]
FEMALE = ["Петрова", "Достоевская", "Синяя", "Ильина", "Лебедева", "Шевчук", "Муха", "Соколова"]
MALE_NAMES = ["Иван", "Дмитрий", "Пётр", "Олег", "Сергей"]
FEMALE_NAMES = ["Мария", "Анна", "Ольга", "Инна", "Елена"]
MALE_PATRONYMICS = ["Иванович", "Владимирович", "Ильич", "Олегович"]
FEMALE_PATRONYMICS = ["Ивановна", "Владимировна", "Ильинична", "Олеговна"]

# names that some check must reject, and unusual forms that it must not
ODD_NAMES = [
    "Москва Казань", "Подробнее Иван Иванович", "Иван Иванович Менделеева", "Сидоров А.П.",
    "Путин Владимир Владимирович", "отдел продаж", "Иванов", "Тел. Петров Иван", None, "Петров2 Иван",
    "Группа Компаний Восток", "Иванов  Иван   Иванович", "Smith John", "Россия Иван Петрович",
    "Уфе Иван Иванович", "Салтыков-Щедрин Михаил Евграфович",
]
POSITIONS = [
    "Генеральный директор", "главный бухгалтер", "Финансовый директор", "Директор по персоналу", "Юрист",
    "Ведущий специалист", "Генеральный директорр", "директор генеральный", "Начальник отдела кадров",
    "Заместитель генерального директора", "CEO", "Head of Sales", "HR директор", "Коммерческий директор",
    "12 мая", "01.02.2024 форум", "Подробнее", "info@example.ru", "Тел: +7 (495) 123-45-67", "www.example.ru",
    "ул. Ленина, д. 5", "Итоги выставки", "Форум 2024", "Контакты:", None, "", "Руководитель пэо",
    "Начальник технологического отдела", "Открытие нового цеха завода прошло сегодня утром",
    "Вице-президент по финансам", "Менеджер по закупкам", "Главный механик", "Инженер-энергетик", "12345",
    "Директор по маркетингу и развитию сети продаж в регионах",
]
PHONES = [
    "+7 (495) 123-45-67", "8 (800) 555-35-35", "89161234567", "4951234567", "+1 (555) 234-5678", None,
    "тел. 79031112233", "+44 20 7946 0958", "123-45", "8-916-000-11-22", "",
]
INNS = ["7707083893", "500100732259", None, "770708389", "77 0708 3893", "12345678901", "7707083894", "", "ИНН 7707083893"]
KPPS = ["770701001", None, "77070100", "7707 01 001", "", "123456789"]

_K = "c_custkey"
# first level: keys of the row
CONTACT_KEYS = {
    "k": _K,
    "person": f"(CASE WHEN {_K} % 6 = 5 THEN {_K} - 1 ELSE {_K} END) % 40",
    "site_idx": f"CASE WHEN {_K} % 3 = 0 THEN 0 ELSE CAST(floor({_K} / 12) AS BIGINT) END",
}
FULL_NAME = (
    "CASE person % 2 WHEN 0 THEN "
    + pick("person", MALE) + " || ' ' || " + pick("person", MALE_NAMES) + " || ' ' || "
    + pick("person", MALE_PATRONYMICS)
    + " ELSE " + pick("person", FEMALE) + " || ' ' || " + pick("person", FEMALE_NAMES) + " || ' ' || "
    + pick("person", FEMALE_PATRONYMICS) + " END"
)
_SITE = "'https://site' || CAST(site_idx AS STRING) || '.example.ru'"
# second level: the fields of a contact
CONTACT_SQL = {
    "page_ord": "CAST(floor(k / 4) AS BIGINT)",
    "contact_ord": "k % 4",
    "company_name": (
        "CASE k % 10 WHEN 0 THEN 'ооо пример ' || CAST(site_idx AS STRING)"
        " WHEN 1 THEN 'ООО Пример ' || CAST(site_idx AS STRING) || '; Москва'"
        " WHEN 2 THEN CAST(NULL AS STRING) WHEN 3 THEN 'О' ELSE 'ООО Пример ' || CAST(site_idx AS STRING) END"
    ),
    "site_url": _SITE,
    "inn": pick("k", INNS),
    "kpp": pick("k", KPPS),
    "company_email": pick("k", ["info@example.ru", None, "Office@Example.ru", "", None]),
    "position_raw": pick("k", POSITIONS),
    "position_normalized": f"CASE k % 4 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN {pick('k', POSITIONS)} ELSE {pick('k + 3', POSITIONS)} END",
    "full_name": f"CASE WHEN k % 5 = 4 THEN {pick('k', ODD_NAMES)} ELSE {FULL_NAME} END",
    "personal_email": (
        "CASE k % 13 WHEN 0 THEN 'info@example.ru' WHEN 1 THEN CAST(NULL AS STRING) WHEN 2 THEN 'No-Reply@Example.ru'"
        " WHEN 3 THEN 'ab@example.ru' WHEN 4 THEN 'filial.msk@example.ru' WHEN 5 THEN '' WHEN 6 THEN 'H.R@example.ru'"
        " WHEN 7 THEN 'Ivan.Petrov' || CAST(person AS STRING) || '@Mail' || CAST(k % 50 AS STRING) || '.example.com'"
        " ELSE 'p' || CAST(person AS STRING) || '.user@corp.example.ru' END"
    ),
    "phone": pick("k", PHONES),
    "phone_raw": pick("k + 1", PHONES),
    "source_url": _SITE + " || '/team/' || CAST(floor(k / 4) AS BIGINT)",
    "page_language": pick("k", ["ru", "en", None]),
    "status": "'ok'",
    "comment": pick("k", [None, "sales", ""]),
}

SITE_SQL = {
    "site_ord": "s_suppkey",
    "url": "'https://site' || CAST(s_suppkey AS STRING) || '.example.ru'",
    "company_name": "CASE s_suppkey % 5 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '' ELSE 'АО ' || s_name END",
    "inn": pick("s_suppkey", ["7707083893", None, "bad", "500100732259"]),
}

# a site list as people write it: other case, ports, paths, queries, closing slashes, sites that no page has
_N = "CAST(s_suppkey - 1 AS STRING)"
LISTED_SITE_SQL = {
    "site_ord": "s_suppkey",
    "url": (
        f"CASE s_suppkey % 8 WHEN 1 THEN 'https://site' || {_N} || '.example.ru/' WHEN 2 THEN 'https://WWW.Site' || {_N} || '.example.ru'"
        f" WHEN 3 THEN 'http://site' || {_N} || '.example.ru:80/people/' WHEN 4 THEN 'https://site' || {_N} || '.example.ru:443/team?x=1#top'"
        f" WHEN 5 THEN 'HTTPS://SITE' || {_N} || '.EXAMPLE.RU' WHEN 6 THEN 'https://other' || {_N} || '.example.ru'"
        f" WHEN 7 THEN 'https://site' || {_N} || '.example.ru/peop' ELSE 'https://site' || {_N} || '.example.ru' END"
    ),
    "company_name": SITE_SQL["company_name"],
    "inn": SITE_SQL["inn"],
}
# the same sites once more, and single pages of them
LISTED_PAGE_SQL = {
    "site_ord": "s_suppkey + 1000000",
    "url": (
        f"CASE s_suppkey % 3 WHEN 0 THEN 'https://SITE' || {_N} || '.example.ru/#again'"
        f" WHEN 1 THEN 'http://www.site' || {_N} || '.example.ru/team/' || CAST(3 * s_suppkey - 2 AS STRING) || '/'"
        f" ELSE 'https://site' || {_N} || '.example.ru/people/' || CAST(12 * s_suppkey - 11 AS STRING) END"
    ),
    "company_name": "'Отдел ' || s_name",
    "inn": pick("s_suppkey", [None, "500100732259"]),
}

# pages of the sites: the person of the row and a second one (k + 7)
_PAGE_POSITIONS = ["Генеральный директор", "Главный бухгалтер", "Финансовый директор", "Ведущий специалист", "Юрист"]
PAGE_KEYS = {
    "k": _K,
    "person": f"{_K} % 40",
    "site_idx": CONTACT_KEYS["site_idx"],
}
PAGE_FIELDS = {
    "k": "k",
    "site_idx": "site_idx",
    "site_url": _SITE,
    "page_ord": "k",
    "page_url": _SITE + " || '/people/' || CAST(k AS STRING)",
    "kind": "k % 7",
    "name_a": FULL_NAME,
    "name_b": FULL_NAME.replace("person", "(person + 7)"),
    "position_a": pick("k", _PAGE_POSITIONS),
    "position_b": pick("k + 1", _PAGE_POSITIONS),
    "email_a": "'p' || CAST(k AS STRING) || '.one@corp.example.ru'",
    "email_b": "'p' || CAST(k AS STRING) || '.two@corp.example.ru'",
    "phone_a": "'+7 (495) 1' || lpad(CAST(k % 100 AS STRING), 2, '0') || '-45-67'",
    "phone_b": "'8 (916) 2' || lpad(CAST(k % 100 AS STRING), 2, '0') || '-00-11'",
    "inn": pick("k", ["7707083893", "500100732259"]),
    "kpp": "'770701001'",
}
_HEAD = (
    "'<!DOCTYPE html><html lang=\"ru-RU\"><head><title>Команда | ООО Пример ' || CAST(site_idx AS STRING)"
    " || '</title><script>var a = \"x@y.zz\";</script></head><body>'"
)


def _card(side: str) -> str:
    return (
        f"'<div class=\"person-card\"><h3>' || name_{side} || ',</h3><p class=\"position\">' || position_{side}"
        f" || '</p><p>E-mail: ' || email_{side} || '<br>Тел: ' || phone_{side}"
        f" || '</p><a href=\"https://vk.com/id' || CAST(k AS STRING) || '\">VK</a></div>'"
    )


def _item(side: str, tag: str) -> str:
    return (
        f"'<{tag}><b>' || name_{side} || '</b> <i>' || position_{side} || '</i> ' || email_{side} || ' '"
        f" || phone_{side} || '</{tag}>'"
    )


def _line(side: str) -> str:
    return f"'<p>' || position_{side} || ', ' || name_{side} || ', ' || email_{side} || ', ' || phone_{side} || '</p>'"


_FOOT = "'<footer>ИНН: ' || inn || ', КПП: ' || kpp || ' info@site' || CAST(site_idx AS STRING) || '.example.ru</footer></body></html>'"
# kinds 0, 1: cards, in 1 inside a card of their own; 2, 3, 4: plain siblings;
# 5: plain text; 6: challenge page
PAGE_HTML = (
    f"CASE kind WHEN 0 THEN {_HEAD} || '<div class=\"grid\">' || {_card('a')} || {_card('b')} || '</div>' || {_FOOT}"
    f" WHEN 1 THEN {_HEAD} || '<div id=\"team\">' || {_card('a')} || {_card('b')} || '</div>' || {_FOOT}"
    f" WHEN 4 THEN {_HEAD} || '<ul>' || {_item('a', 'li')} || {_item('b', 'li')} || '</ul>' || {_FOOT}"
    f" WHEN 5 THEN {_HEAD} || {_line('a')} || {_line('b')} || {_FOOT}"
    f" WHEN 6 THEN '<html><body><form id=\"challenge-form\">' || name_a || '</form></body></html>'"
    f" ELSE {_HEAD} || '<section>' || {_item('a', 'div')} || {_item('b', 'div')} || '</section>' || {_FOOT} END"
)

# raw blocklist entries: from the hosts of stored pages, and from customers
PAGE_ENTRY = (
    "CASE page_id % 11 WHEN 0 THEN 'https://WWW.' || host || '/path?x=1' WHEN 3 THEN upper(host) || ':8080/a'"
    " WHEN 5 THEN '# ' || host WHEN 7 THEN '' ELSE ' no-dot ' END"
)
CUSTOMER_ENTRY = (
    "CASE c_custkey % 5 WHEN 0 THEN 'P' || CAST(c_custkey % 40 AS STRING) || '.User@corp.example.ru'"
    " WHEN 1 THEN CAST(7707083893 + c_custkey % 3 AS STRING) WHEN 2 THEN 'mail' || CAST(c_custkey % 25 AS STRING) || '.example.com'"
    " WHEN 3 THEN 'site' || CAST(c_custkey AS STRING) || '.example.ru' ELSE '5001007322' || CAST(50 + c_custkey % 10 AS STRING) END"
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(sql).alias(name) for name, sql in fields.items()])


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw contacts with planted faults, from customer."""
    rows = _select(_select(_table(spark, sf_dir, "customer"), CONTACT_KEYS), {"k": "k", **CONTACT_SQL})
    return rows.withColumn(
        "scan_date", F.expr("timestampadd(HOUR, cast(k % 8760 as int), timestamp_ntz'2024-01-01 00:00:00')")
    ).drop("k")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(_table(spark, sf_dir, "supplier"), SITE_SQL)


def listed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = _table(spark, sf_dir, "supplier")
    return _select(supplier, LISTED_SITE_SQL).unionByName(_select(supplier, LISTED_PAGE_SQL))


def people_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages about two people each, with the fields they were built from."""
    return people_pages_of(_table(spark, sf_dir, "customer"))


def people_pages_of(customer: DataFrame) -> DataFrame:
    """A page per customer.  The keys are spread over the cores before the html
    is built: reading a page costs far more than its row in the input file."""
    spark = customer.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = customer.select("c_custkey").repartition(tasks, "c_custkey")
    fields = _select(_select(keys, PAGE_KEYS), PAGE_FIELDS)
    return fields.withColumn("html", F.expr(PAGE_HTML))


def pages_only(people: DataFrame) -> DataFrame:
    return people.select("site_url", "page_ord", "page_url", "html")


def blocklist_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw entries as they stand in an uploaded list."""
    pages = _table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/?#]*)", 1).alias("host")
    )
    from_pages = pages.select(F.expr(PAGE_ENTRY).alias("entry"))
    from_customers = _table(spark, sf_dir, "customer").select(F.expr(CUSTOMER_ENTRY).alias("entry"))
    return from_pages.unionByName(from_customers)


# --- inputs of the readers ------------------------------------------------------
SITE_LINE = (
    "CASE s_suppkey % 6 WHEN 0 THEN '# комментарий' WHEN 1 THEN '12. site' || CAST(s_suppkey AS STRING) || '.ru'"
    " WHEN 2 THEN '  https://www.site' || CAST(s_suppkey AS STRING) || '.ru/a ; b' WHEN 3 THEN ''"
    " WHEN 4 THEN 'a.ru,site' || CAST(s_suppkey AS STRING) || '.ru,,1c.ru,xyz' ELSE '1) http://s' || CAST(s_suppkey AS STRING) || '.ru' END"
)
# a file of site records: quotes, line breaks inside of them, separators inside of them
CSV_RECORD = (
    "CASE s_suppkey % 6 WHEN 0 THEN '\"ООО \"\"Ромашка\"\"{nl}и ' || s_name || '\";' || url || ';' || coalesce(inn, '')"
    " WHEN 1 THEN s_name || ';\"' || url || '\";\"{nl}{nl}\"' WHEN 2 THEN '5\" трубы;' || url || ';x' WHEN 3 THEN ';' || url"
    " WHEN 4 THEN '\"a;b\"c;\"\" ;\"' || url || '\"' ELSE '\"нет сайта{nl};\";;' END"
)
# files of different size
CSV_FILE = "CASE WHEN s_suppkey < 8 THEN 0 WHEN s_suppkey < 30 THEN 1 ELSE 2 END"
# sheets of 20 rows: a title, a blank row, a header of one of three kinds, data
SHEET_KEYS = {"sheet_id": "CAST(floor(s_suppkey / 20) AS BIGINT)", "row_ord": "s_suppkey % 20", "s": "s_suppkey"}
SHEET_LINE = (
    "CASE WHEN row_ord = 0 THEN 'Отчёт|' WHEN row_ord = 1 THEN '|'"
    " WHEN row_ord = 2 THEN CASE sheet_id % 3 WHEN 0 THEN 'N|Компания|Официальный сайт|ИНН'"
    " WHEN 1 THEN 'N|Название|Ресурс|Код' ELSE 'N|x|y|z' END"
    " WHEN row_ord % 7 = 6 THEN CAST(s AS STRING) || '|ООО ' || CAST(s AS STRING) || '|Имя ; тип ; site' || CAST(s AS STRING) || '.ru|'"
    " WHEN row_ord % 7 = 5 THEN CAST(s AS STRING) || '||# нет|1'"
    " ELSE CAST(s AS STRING) || '|ООО ' || CAST(s AS STRING) || '|site' || CAST(s AS STRING) || '.ru|7707083893' END"
)
URL_CELL = (
    "CASE page_id % 5 WHEN 0 THEN 'Имя; тип ;' || url WHEN 1 THEN '# ' || url WHEN 2 THEN '  ' || replace(url, 'https://', '')"
    " WHEN 3 THEN '' ELSE url || ' ' END"
)
ENTRY_CSV_LINE = (
    "'\"mail' || CAST(c_custkey % 25 AS STRING) || '.example.com\",P' || CAST(c_custkey AS STRING)"
    " || '@x.example.ru,,# note,' || CAST(7707083893 + c_custkey % 3 AS STRING)"
)
ENTRY_JSON = (
    "CASE c_custkey % 2 WHEN 0 THEN '[\"mail' || CAST(c_custkey % 25 AS STRING) || '.example.com\", 5, null, \"7707083893\"]'"
    " ELSE '{\"domains\": [\"d' || CAST(c_custkey AS STRING) || '.example.com\"], \"emails\": [\"A' || CAST(c_custkey AS STRING) || '@b.ru\", 7]}' END"
)
DICTIONARY_JSON = (
    "'{\"Variant ' || CAST(s_suppkey AS STRING) || '\": \"' || s_name || '\", \"second\": \"x\", \"Alpha\": \"y\"}'"
)
SEARCH_HTML = (
    "'<div><a href=\"/url?q=' || replace(replace(replace(url, '?', '%3F'), '&', '%26'), '#', '%23')"
    " || '&amp;sa=U\">t</a><a href=\"/search?q=x\">x</a></div>'"
)
LISTED_URL = (
    "CASE page_id % 5 WHEN 0 THEN 'https://www.vk.com/' || CAST(page_id AS STRING)"
    " WHEN 1 THEN 'http://jobs.hh.ru/x' WHEN 2 THEN 'https://nothh.ru/' ELSE url END"
)
FETCH_STATUS = pick("page_id", ["200", "403", "404", "301", "500", "429", "401", None, "503"])
OTHER_HOST = (
    "CASE page_id % 5 WHEN 0 THEN 'WWW.' || host WHEN 1 THEN 'shop.' || host WHEN 2 THEN 'x' || host WHEN 3 THEN '' ELSE host END"
)
# robots files by the length of the host; \n is written by the caller
ROBOTS_FILE = (
    "CASE length(host) % 4 WHEN 0 THEN 'User-agent: *{nl}Disallow: /a{nl}Allow: /about{nl}Crawl-delay: 1'"
    " WHEN 1 THEN 'User-agent: BadBot{nl}Disallow: /{nl}{nl}# c{nl}user-agent: rosterline{nl}Disallow:{nl}disallow:  /the '"
    " WHEN 2 THEN 'Disallow: /{nl}no colon' ELSE 'User-agent: *{nl}Disallow: /' END"
)
# page variants for language, title and site name
VARIANT_HEAD = (
    "CASE page_id % 7 WHEN 0 THEN '<html><head><meta name=\"language\" content=\"RU-ru\"><title>Контакты — Завод Прогресс</title>'"
    " WHEN 1 THEN '<html lang=\"de-DE\"><head><meta property=\"og:site_name\" content=\" Рога &amp; Копыта \"><title>a | b</title>'"
    " WHEN 2 THEN '<html><head><meta http-equiv=\"Content-Language\" content=\"en\"><title>О нас | Контакты</title>'"
    " WHEN 3 THEN '<html><head><title>Статья · ООО &quot;Ёлка&quot;</title>'"
    " WHEN 4 THEN '<html><head><title>Один</title><script>recaptcha()</script>'"
    " ELSE '' END"
)
SOCIAL_TAIL = (
    "CASE page_id % 4 WHEN 0 THEN '<a href=\"https://www.vk.com/club1\">v</a><a href=\"t.me/chan\">t</a>'"
    " WHEN 1 THEN '<a href=''HTTPS://X.com/me''>x</a> www.youtube.com/channel/UC1 ok.ru/g?a=1'"
    " WHEN 2 THEN '<p>linkedin.com/in/a linkedin.com/school/b facebook.com/c</p>' ELSE '' END"
)
# text with identifiers, mail and names, one per customer
CONTACT_TEXT = (
    "CASE c_custkey % 6 WHEN 0 THEN 'ИНН: 500100732259, КПП 770701001' WHEN 1 THEN 'инн № 7707083893 кпп:770701001 тел 123456789'"
    " WHEN 2 THEN 'код 7707083893 и 12345678901 ИНН 500100732259' WHEN 3 THEN 'ИНН77070838931 КПП 77070100'"
    " WHEN 4 THEN 'индекс 620000 ИНН-7707083893, 770701001' ELSE 'нет' END"
)
# an answer of the correction step for contact number 1 + (k mod 9)
ANSWER = (
    "'<think>try [1, 2]</think> Ответ: [{{\"idx\": ' || CAST(1 + k % 9 AS STRING) || ', \"full_name\": ' ||"
    " CASE k % 3 WHEN 0 THEN 'null' ELSE '\"Новый Иван ' || CAST(k AS STRING) || '\"' END"
    " || ', \"position\": \"Юрист\", \"phone\": 7' || CAST(k AS STRING) || '}}, 5, \"x\", {{\"full_name\": \"Без номера\"}}] конец ]'"
).replace("{{", "{").replace("}}", "}")
JSON_TEXT = (
    "CASE k % 5 WHEN 0 THEN ' {\"a\": ' || CAST(k AS STRING) || '} ' WHEN 1 THEN 'вот ```json' || CAST(k AS STRING) || '``` и {\"b\":[1]} конец'"
    " WHEN 2 THEN '```json {\"c\": \"x\"} ```' WHEN 3 THEN 'нет {плохо}' ELSE 'без' END"
)
# corrections keyed by site and contact number; null names remove a contact
CORRECTION_SQL = {
    "site_url": "'https://site' || CAST(CAST(floor(c_custkey / 12) AS BIGINT) AS STRING) || '.example.ru'",
    "idx": "c_custkey % 12 + 1",
    "company_name": pick("c_custkey", ["ООО Новое", None, ""]),
    "full_name": pick("c_custkey", ["Исправлен Иван Иванович", None, "Верный Пётр Олегович", "", "Точный Олег Ильич"]),
    "position": pick("c_custkey", [None, "Юрист", ""]),
    "personal_email": pick("c_custkey", ["new@fix.ru", None]),
    "company_email": pick("c_custkey", ["office@fix.ru", None, ""]),
    "phone": pick("c_custkey", [None, "79990001122"]),
}
# orders as tasks
TASK_SQL = {
    "task_id": "o_orderkey",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END",
    "created_at": "o_orderdate",
    "contacts_found": "o_orderkey % 50",
    "processed_sites": "o_orderkey % 20",
    "total_pages": "o_orderkey % 100",
    "elapsed_seconds": "CAST(o_orderkey % 600 AS DOUBLE)",
}

# events of tasks that arrive out of order (up to 200 minutes): a third falls on task 0, the others live for 40 events
EVENT_MS = "CAST(event_id AS BIGINT) * 60000 + (CAST(event_id AS BIGINT) * 7919 % 200) * 60000 + 1704067200000"
STREAM_EVENT_SQL = {
    "event_id": "CAST(event_id AS BIGINT)",
    "task_id": "CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(floor(event_id / 40) AS BIGINT) * 3 + event_id % 3 END",
    "ms": EVENT_MS,
    "type": "CASE WHEN event_id % 17 = 0 THEN 'completed' WHEN event_id % 19 = 0 THEN 'error' ELSE 'progress' END",
    "value": "event_id % 7",
}
# contacts that arrive out of order; in the hot site persons come again after a while
ARRIVING_CONTACT_SQL = {
    "site_url": CONTACT_SQL["site_url"],
    "full_name": FULL_NAME,
    "personal_email": "'p' || CAST(person AS STRING) || '@corp.example.ru'",
    "phone": "CASE k % 6 WHEN 4 THEN '' WHEN 5 THEN CAST(NULL AS STRING) ELSE '79031112233' END",
    "page_ord": CONTACT_SQL["page_ord"],
    "contact_ord": CONTACT_SQL["contact_ord"],
    "ms": "k * 60000 + (k * 7919 % 200) * 60000 + 1704067200000",
}


def arrival(key: str, table: str, batches: int) -> str:
    """SQL: the batch in which a row arrives, by its key."""
    return f"CAST(floor(CAST({key} AS BIGINT) * {batches} / (SELECT max({key}) + 1 FROM {table})) AS INT)"

# one task of the statistics
STAT_TASK_SQL = {
    "created_at": "o_orderdate",
    "finished_at": "CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END",
    "mode": "o_orderkey % 3 + 1",
    "variant": "'B'",
    "errors": "o_orderkey % 7",
    "total_pages": "o_orderkey % 100",
    "elapsed_seconds": "CAST(o_orderkey % 600 + 75 AS DOUBLE)",
    "llm_tokens_used": "o_orderkey * 3",
    "fallback_count": "o_orderkey % 5",
}
