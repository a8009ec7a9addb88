"""Every operator as a query over the given tables (or inputs derived from them).

A query is a function of (spark, folder of parquet tables).
"""

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline import vocab
from rosterline.functions import answers, categories, entities as E, fields, html as H, names as N, positions as P
from rosterline.functions import similarity as S, text as T, urls as U
from rosterline.functions.person_blocks import person_blocks
from rosterline.operators import blocklist as B, dedup, enrich, extraction as X, matching as M, pages as PG
from rosterline.operators import prompts, reports as R, site_keys as SK, tasks as TK
from rosterline.plans import contacts as plan
from rosterline.plans import derived as D
from rosterline.session import checkpoint_root
from rosterline.sources import sinks, sites as SR, tables as TR
from rosterline.streaming import jobs as J
from rosterline.streaming.levels import read_levels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TARGETS = ["директор", "юрист", "cfo"]
SIMILAR_TARGETS = ["ген директор", "аналитик данных", "Юрист"]
SPREAD = ["page_ord"]
CONTACT_SPREAD = ["page_ord", "contact_ord"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str):
    return F.col(name)


def scratch(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"


def stored_pages(spark, sf):
    return TR.as_pages(table(spark, sf, "pages"))


def html_pages(spark, sf):
    """Stored pages for queries that read the html."""
    return TR.as_pages(TR.spread_scan(table(spark, sf, "pages"), "page_id"))


def variant_pages(spark, sf):
    """Stored pages behind a changing head, so that every branch is met."""
    pages = TR.spread_scan(table(spark, sf, "pages"), "page_id")
    return TR.as_pages(pages.withColumn("html", F.concat(F.expr(D.VARIANT_HEAD), "html", F.expr(D.SOCIAL_TAIL))))


def documents(spark, sf):
    return TR.spread_scan(table(spark, sf, "documents"), "doc_id").select("doc_id", "text")


def blocklist(spark, sf):
    return B.blocklist_from_entries(D.blocklist_entries(spark, sf))


def people(spark, sf):
    return D.pages_only(D.people_pages(spark, sf))


def tasks(spark, sf):
    return D._select(table(spark, sf, "orders"), D.TASK_SQL)


def calls(spark, sf):
    """Conversation turns as requests of two sessions, one per role."""
    return table(spark, sf, "conversations").select(
        col("role").alias("session"), "conv_id", "turn",
        F.length("text").cast("long").alias("tokens_prompt"), (F.length("text") % 7).cast("long").alias("tokens_completion"),
    )


def raw_rows(contacts: DataFrame, *more) -> DataFrame:
    return contacts.select("page_ord", "contact_ord", *more)


# --- sources --------------------------------------------------------------------

def line_files(spark, lines):
    """Lines (file, place, value) as text files in their order, one per file."""
    path = scratch(spark)
    ordered = lines.repartition("file").sortWithinPartitions("file", "place")
    ordered.select("file", "value").write.partitionBy("file").text(path)
    return path


@query
def read_sites_csv(spark, sf):
    rows = table(spark, sf, "supplier").withColumns({"url": F.expr(D.SITE_SQL["url"]), "inn": F.expr(D.SITE_SQL["inn"])})
    records = rows.select(
        F.expr(D.CSV_FILE).alias("file"), col("s_suppkey").alias("place"), F.replace(F.expr(D.CSV_RECORD), F.lit("{nl}"), F.lit("\n")).alias("value")
    )
    heads = records.select("file").distinct().select("file", F.lit(-1).cast("long").alias("place"), F.lit("Название компании;Официальный сайт;ИНН").alias("value"))
    return SR.read_sites_csv(spark, line_files(spark, records.unionByName(heads)))


@query
def read_sites_txt(spark, sf):
    lines = table(spark, sf, "supplier").select(F.expr(D.CSV_FILE).alias("file"), col("s_suppkey").alias("place"), F.expr(D.SITE_LINE).alias("value"))
    return SR.read_sites_txt(spark, line_files(spark, lines))


def sheet_rows(spark, sf):
    keys = D._select(table(spark, sf, "supplier"), D.SHEET_KEYS)
    return keys.select("sheet_id", "row_ord", F.split(F.expr(D.SHEET_LINE), r"\|").alias("cells"))


@query
def read_sites_table(spark, sf):
    return SR.read_sites_table(sheet_rows(spark, sf))


@query
def find_header_row(spark, sf):
    return SR.find_header_row(sheet_rows(spark, sf))


@query
def infer_column_roles(spark, sf):
    rows = sheet_rows(spark, sf)
    headers = rows.join(SR.find_header_row(rows), "sheet_id").filter("row_ord = header_row")
    return SR.infer_column_roles(headers)


@query
def infer_url_column_by_content(spark, sf):
    rows = sheet_rows(spark, sf)
    return SR.infer_url_column_by_content(rows, SR.find_header_row(rows))


@query
def clean_url_cell(spark, sf):
    cell = F.expr(D.URL_CELL)
    return table(spark, sf, "pages").select("page_id", SR.clean_url_cell(cell).alias("url"))


@query
def read_pages(spark, sf):
    pages = TR.read_pages(spark, f"{sf}/pages.parquet")
    return pages.select("page_ord", "site_url", "page_url", F.length("html").cast("long").alias("n_chars"))


@query
def read_blocklist_text(spark, sf):
    path = scratch(spark)
    D.blocklist_entries(spark, sf).select(col("entry").alias("value")).write.text(path)
    return TR.read_blocklist_text(spark, path)


@query
def read_blocklist_csv(spark, sf):
    lines = table(spark, sf, "customer").select(F.expr(D.ENTRY_CSV_LINE).alias("line"))
    return B.blocklist_from_entries(TR.csv_cells(lines))


@query
def read_blocklist_json(spark, sf):
    return B.blocklist_from_entries(TR.json_entries(table(spark, sf, "customer").select(F.expr(D.ENTRY_JSON).alias("json"))))


@query
def read_position_dictionary(spark, sf):
    documents_ = table(spark, sf, "supplier").select(col("s_suppkey").alias("file_ord"), F.expr(D.DICTIONARY_JSON).alias("json"))
    return TR.dictionary_entries(documents_).withColumn("ord", col("ord").cast("long"))


@query
def classify_blocklist_entry(spark, sf):
    entry = T.strip_ws(F.expr(D.CUSTOMER_ENTRY))
    rows = table(spark, sf, "customer").select("c_custkey", B.classify_entry(entry).alias("e"))
    return rows.select("c_custkey", "e.kind", "e.value")


@query
def seed_sites_from_search_results(spark, sf):
    results = table(spark, sf, "pages").select(col("page_id").alias("result_ord"), F.expr(D.SEARCH_HTML).alias("html"))
    return SR.seed_sites_from_search_results(results)


def listed_pages(spark, sf):
    return table(spark, sf, "pages").select(col("page_id").alias("page_ord"), F.expr(D.LISTED_URL).alias("url"))


@query
def read_stoplist_domains(spark, sf):
    """Pages per stoplist domain they stand on."""
    pages = listed_pages(spark, sf).select("page_ord", F.explode(U.domain_suffixes(U.site_domain(col("url")))).alias("value"))
    return pages.join(B.stoplist(spark), "value").groupBy("value").agg(F.count("*").alias("n"))


# --- sinks ----------------------------------------------------------------------

@query
def write_contacts_by_category(spark, sf):
    path = scratch(spark)
    sinks.write_contacts_by_category(D.contacts(spark, sf), path)
    written = spark.read.parquet(path)
    return written.groupBy("category").agg(
        F.count("*").alias("n"), F.count_if(col("fio_dative") != "").alias("n_dative"), F.count_if(col("phone_mobile") != "").alias("n_mobile")
    )


@query
def statistics_table(spark, sf):
    orders = table(spark, sf, "orders")
    task = D._select(orders.join(orders.agg(F.max("o_orderkey").alias("o_orderkey")), "o_orderkey"), D.STAT_TASK_SQL)
    return R.statistics_table(D.sites(spark, sf), D.contacts(spark, sf), task)


@query
def site_log_table(spark, sf):
    contacts = D.contacts(spark, sf)
    pages = contacts.select("site_url", "page_ord").distinct()
    return R.site_log_table(D.sites(spark, sf), pages, contacts, F.lit("2024-02-03 04:05:06").cast("timestamp"))


@query
def error_log(spark, sf):
    sites = D.sites(spark, sf)
    blocked = B.blocked_by_domain(sites, "url", blocklist(spark, sf), ["site_ord"])
    failed = table(spark, sf, "pages").select("url", F.expr(D.FETCH_STATUS).alias("status"))
    page_errors = failed.filter(col("status").isin("403", "404", "429", "500", "503")).select("url", F.concat(F.lit("HTTP "), "status").alias("message"))
    site_errors = sites.filter(col("inn") == "bad").select("url", F.lit("bad inn").alias("message"))
    return R.error_log(blocked, page_errors, site_errors)


@query
def export_projection(spark, sf):
    return R.export_projection(D.contacts(spark, sf))


@query
def save_blocklist(spark, sf):
    path = scratch(spark)
    sinks.save_blocklist(blocklist(spark, sf), path)
    return TR.read_saved_blocklist(spark, path)


@query
def export_blocklist_tsv(spark, sf):
    return sinks.blocklist_tsv(blocklist(spark, sf))


# --- pages and URLs ---------------------------------------------------------------

@query
def normalize_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.normalize_url(col("url")).alias("url"))


@query
def site_domain(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", U.site_domain(col("url")).alias("domain"), U.site_domain(F.expr(D.LISTED_URL)).alias("listed")
    )


@query
def same_domain(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", U.url_host(col("url")).alias("host"))
    return pages.select("page_id", U.same_domain(col("host"), F.expr(D.OTHER_HOST)).alias("same"))


@query
def page_links(spark, sf):
    return PG.explode_links(html_pages(spark, sf)).select("page_ord", "link_ord", "url", "text")


@query
def is_static_asset(spark, sf):
    url = F.concat(col("url"), F.element_at(F.array(F.lit(".PDF"), F.lit("/a.js?x=1"), F.lit(".html"), F.lit("/x.woff2")), (col("page_id") % 4 + 1).cast("int")))
    return table(spark, sf, "pages").select("page_id", U.is_static_asset(F.split_part(url, F.lit("#"), F.lit(1))).alias("static"))


@query
def is_contact_page_link(spark, sf):
    links = PG.explode_links(html_pages(spark, sf))
    relevant = H.is_contact_link(F.struct("url", "text", "title"))
    return links.select("page_ord", "link_ord", relevant.alias("relevant"))


@query
def rank_contact_links(spark, sf):
    return PG.rank_contact_links(html_pages(spark, sf)).select("page_ord", "link_rank", "url")


@query
def cap_pages_per_site(spark, sf):
    pages = stored_pages(spark, sf).select("site_url", "page_ord", F.length("page_url").alias("len"))
    return PG.cap_pages_per_site(pages, ["len", "page_ord"], limit=10).select("site_url", "page_ord", "page_rank")


@query
def expand_link_frontier(spark, sf):
    """Pages of a site link to those 1, 2, 4 ... 512 further on; the walk starts at the first.

    The link targets stand in a generated navigation in front of the stored html.
    """
    people_ = D.people_pages(spark, sf)
    nav = F.concat(*[
        F.concat(F.lit('<a href="/people/'), (col("k") + (1 << i)).cast("string"), F.lit('">команда</a>')) for i in range(10)
    ])
    pages = people_.select("site_url", "page_ord", "page_url", F.concat(nav, "html").alias("html"))
    starts = pages.groupBy("site_url").agg(F.min_by("page_url", "page_ord").alias("url"))
    return PG.expand_link_frontier(pages, starts).select("site_url", "page_ord", "depth")


@query
def robots_filter(spark, sf):
    pages = stored_pages(spark, sf)
    host = U.url_host(col("page_url"))
    content = F.replace(F.expr(D.ROBOTS_FILE), F.lit("{nl}"), F.lit("\n"))
    robots = pages.select(host.alias("host")).distinct().select("host", content.alias("content"))
    return PG.robots_filter(pages, robots).select("page_ord")


@query
def drop_captcha_pages(spark, sf):
    return PG.drop_captcha_pages(variant_pages(spark, sf)).select("page_ord")


@query
def page_language(spark, sf):
    return variant_pages(spark, sf).select("page_ord", H.page_language(col("html")).alias("lang"))


@query
def drop_failed_fetches(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.expr(D.FETCH_STATUS).cast("int").alias("status"))
    return PG.drop_failed_fetches(pages).select("page_id")


@query
def html_to_text(spark, sf):
    return html_pages(spark, sf).select(col("page_ord").alias("page_id"), H.html_to_text(col("html")).alias("text"))


@query
def company_name_from_page(spark, sf):
    return variant_pages(spark, sf).select("page_ord", H.company_name_from_page(col("html")).alias("company_name"))


@query
def person_blocks_query(spark, sf):
    rows = D.people_pages(spark, sf).select("page_ord", F.explode(person_blocks(col("html"))).alias("b"))
    return rows.select("page_ord", col("b.block_ord").cast("long").alias("block_ord"), "b.text")


QUERIES["person_blocks"] = QUERIES.pop("person_blocks_query")


@query
def person_blocks_fallback(spark, sf):
    """Blocks that are no cards: plain siblings with names."""
    rows = D.people_pages(spark, sf).select("page_ord", F.explode(person_blocks(col("html"))).alias("b"))
    return rows.filter(col("b.html").rlike(r"^<\w+>")).select("page_ord", col("b.block_ord").cast("long").alias("block_ord"), "b.text")


@query
def dedup_pages(spark, sf):
    pages = stored_pages(spark, sf)
    repeated = pages.unionByName(pages.withColumn("page_url", F.concat("page_url", F.lit("#x"))).withColumn("page_ord", col("page_ord") + 1_000_000_000))
    return PG.dedup_pages(repeated).select("site_url", "page_ord")


# --- entities -----------------------------------------------------------------------

@query
def extract_emails(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(E.extract_emails(col("text"))).alias("pos", "email")).withColumn("pos", col("pos").cast("long"))


@query
def extract_phones(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(E.extract_phones(col("text"))).alias("pos", "phone")).withColumn("pos", col("pos").cast("long"))


def contact_texts(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.expr(D.CONTACT_TEXT).alias("text"))


@query
def extract_inn(spark, sf):
    from_docs = documents(spark, sf).select(F.lit("d").alias("kind"), col("doc_id").alias("id"), E.extract_inn(col("text")).alias("inn"))
    from_text = contact_texts(spark, sf).select(F.lit("c").alias("kind"), col("c_custkey").alias("id"), E.extract_inn(col("text")).alias("inn"))
    return from_docs.unionByName(from_text)


@query
def extract_kpp(spark, sf):
    from_docs = documents(spark, sf).select(F.lit("d").alias("kind"), col("doc_id").alias("id"), E.extract_kpp(col("text")).alias("kpp"))
    from_text = contact_texts(spark, sf).select(F.lit("c").alias("kind"), col("c_custkey").alias("id"), E.extract_kpp(col("text")).alias("kpp"))
    return from_docs.unionByName(from_text)


@query
def extract_labelled_inn_kpp(spark, sf):
    return contact_texts(spark, sf).select("c_custkey", E.labelled_inn(col("text")).alias("inn"), E.labelled_kpp(col("text")).alias("kpp"))


def people_text(spark, sf):
    return D.people_pages(spark, sf).select("page_ord", "kind", H.html_to_text(col("html")).alias("text"))


@query
def extract_fio_first(spark, sf):
    return people_text(spark, sf).select("page_ord", E.extract_fio_first(col("text")).alias("full_name"))


@query
def extract_fio_all(spark, sf):
    rows = people_text(spark, sf).select("page_ord", F.posexplode(E.extract_fio_all(col("text"))).alias("pos", "full_name"))
    return rows.withColumn("pos", col("pos").cast("long"))


@query
def extract_social_links(spark, sf):
    return variant_pages(spark, sf).select("page_ord", E.extract_social_links(col("html")).alias("s")).select("page_ord", "s.*")


@query
def split_generic_emails(spark, sf):
    parts = X.split_generic_emails(F.array("personal_email", "company_email"))
    rows = raw_rows(D.contacts(spark, sf), parts.alias("m"))
    return rows.select("page_ord", "contact_ord", F.array_join("m.company", ",").alias("company"), F.array_join("m.personal", ",").alias("personal"))


@query
def company_email(spark, sf):
    people_ = D.people_pages(spark, sf).select("page_ord", "site_url", H.html_to_text(col("html")).alias("text"))
    return people_.select("page_ord", E.company_email(E.all_emails(col("text")), col("site_url")).alias("company_email"))


@query
def position_near_name(spark, sf):
    text = F.concat_ws(" ", F.lit("Наш"), "position_raw", F.lit("это"), "full_name", F.lit("и другие"))
    return raw_rows(D.contacts(spark, sf).filter("full_name is not null"), E.position_near_name(text, col("full_name")).alias("position"))


@query
def position_from_block(spark, sf):
    blocks = D.people_pages(spark, sf).select("page_ord", F.explode(person_blocks(col("html"))).alias("b"))
    return blocks.select("page_ord", col("b.block_ord").cast("long").alias("block_ord"), X.position_from_block(col("b")).alias("position"))


CONTACT_CHECK = ["page_ord", "contact_ord", "site_url", "company_name", "inn", "kpp", "company_email", "full_name", "position_raw", "personal_email", "phone", "phone_raw"]


@query
def contacts_from_blocks(spark, sf):
    return X.contacts_from_blocks(people(spark, sf)).select(*CONTACT_CHECK, "social_links.vk")


@query
def contacts_from_text(spark, sf):
    return X.contacts_from_text(people(spark, sf)).select(*CONTACT_CHECK)


@query
def extract_page_entities(spark, sf):
    found = X.extract_page_entities(people(spark, sf))
    return found.select(
        "page_ord", "lang", "company_name", "inn", "kpp", "company_email", F.size("phones").cast("long").alias("n_phones"),
        F.size("fios").cast("long").alias("n_names"), F.size("mailboxes.personal").cast("long").alias("n_personal"),
    )


@query
def extract_contacts(spark, sf):
    return X.extract_contacts(people(spark, sf)).select(*CONTACT_CHECK, "position_normalized", "page_language")


@query
def apply_input_company(spark, sf):
    return enrich.apply_input_company(D.contacts(spark, sf), D.listed_sites(spark, sf)).select("page_ord", "contact_ord", "company_name", "inn")


@query
def extract_names_latin(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.explode(E.extract_names_latin(col("text"))).alias("name"))
    return rows


# --- scalar functions ------------------------------------------------------------------

@query
def phone_e164(spark, sf):
    phones = documents(spark, sf).select(col("doc_id").alias("id"), F.explode(E.extract_phones(col("text"))).alias("raw"))
    more = D.contacts(spark, sf).select(col("page_ord").alias("id"), col("phone").alias("raw"))
    return phones.unionByName(more).select("id", "raw", fields.phone_e164(col("raw")).alias("phone"))


@query
def phone_digits(spark, sf):
    return raw_rows(D.contacts(spark, sf), fields.phone_digits(col("phone")).alias("digits"))


@query
def phone_mobile_city(spark, sf):
    return raw_rows(D.contacts(spark, sf), fields.phone_mobile(col("phone")).alias("mobile"), fields.phone_city(col("phone")).alias("city"))


@query
def name_quick_valid(spark, sf):
    return raw_rows(D.contacts(spark, sf), "full_name", N.name_quick_valid(col("full_name")).alias("ok"))


@query
def name_valid_strict(spark, sf):
    return raw_rows(D.contacts(spark, sf), "full_name", N.name_valid_strict(col("full_name")).alias("ok"))


@query
def name_valid_final(spark, sf):
    return raw_rows(D.contacts(spark, sf), "full_name", N.name_valid_final(col("full_name")).alias("ok"))


@query
def name_collapse_ws(spark, sf):
    return raw_rows(D.contacts(spark, sf), N.name_collapse_ws(col("full_name")).alias("full_name"))


@query
def name_blocked(spark, sf):
    return raw_rows(D.contacts(spark, sf), "full_name", N.name_blocked(col("full_name")).alias("blocked"))


@query
def position_quick_valid(spark, sf):
    return raw_rows(D.contacts(spark, sf), "position_raw", P.position_quick_valid(col("position_raw")).alias("ok"))


@query
def position_valid_strict(spark, sf):
    return raw_rows(D.contacts(spark, sf), P.position_valid_strict(col("position_raw")).alias("position"))


@query
def position_valid_final(spark, sf):
    return raw_rows(D.contacts(spark, sf), P.position_valid_final(col("position_raw")).alias("position"))


@query
def position_normalize_exact(spark, sf):
    joined = M.exact_dictionary_join(D.contacts(spark, sf), M.positions_table(spark))
    return joined.select("page_ord", "contact_ord", "position_raw", "canonical")


@query
def position_normalize_fuzzy(spark, sf):
    return raw_rows(D.contacts(spark, sf), "position_raw", S.normalize_position(col("position_raw")).alias("position"))


@query
def position_matches_targets(spark, sf):
    hit = S.position_matches_targets(col("position_raw"), col("position_normalized"), SIMILAR_TARGETS)
    return raw_rows(D.contacts(spark, sf), hit.alias("hit"))


@query
def is_generic_email(spark, sf):
    docs = documents(spark, sf).select(F.explode(E.extract_emails(col("text"))).alias("email"))
    every = docs.unionByName(D.contacts(spark, sf).select(col("personal_email").alias("email")))
    return every.select("email", fields.is_generic_email(col("email")).alias("generic"))


@query
def is_generic_email_final(spark, sf):
    docs = documents(spark, sf).select(F.explode(E.extract_emails(col("text"))).alias("email"))
    every = docs.unionByName(D.contacts(spark, sf).select(col("personal_email").alias("email")))
    return every.select("email", fields.is_generic_email_final(col("email")).alias("generic"))


@query
def relocate_generic_email(spark, sf):
    personal, company = fields.relocate_generic_email(
        col("personal_email"), col("company_email"), fields.is_generic_email_final(col("personal_email"))
    )
    return raw_rows(D.contacts(spark, sf), personal.alias("personal_email"), company.alias("company_email"))


@query
def validate_inn_kpp(spark, sf):
    return raw_rows(
        D.contacts(spark, sf), fields.validate_inn(col("inn")).alias("inn"), fields.validate_kpp(col("kpp")).alias("kpp"),
        fields.strict_inn(col("inn")).alias("strict_inn"), fields.strict_kpp(col("kpp")).alias("strict_kpp"),
    )


@query
def inn_checksum(spark, sf):
    number = F.concat(F.lit("7707"), F.lpad((col("c_custkey") * 7919 % 1_000_000).cast("string"), 6, "0"))
    long_number = F.concat(number, F.lpad((col("c_custkey") % 100).cast("string"), 2, "0"))
    return table(spark, sf, "customer").select("c_custkey", fields.inn_checksum(number).alias("ok10"), fields.inn_checksum(long_number).alias("ok12"))


@query
def company_name_first_part(spark, sf):
    return raw_rows(D.contacts(spark, sf), fields.company_name_first_part(col("company_name")).alias("company_name"))


COMPANY_TITLES = D.pick("c_custkey", [
    "Контакты - ООО «Ромашка»", "ЗАО Вектор — новости и события", "Главная", "О компании: Завод", "ПАО «Сталь» | каталог",
    "Каталог", "ООО  Луч  -", "Имя; прочее.", None, "Новости", "Услуги — Мост",
])


@query
def company_name_clean(spark, sf):
    name = F.expr(COMPANY_TITLES)
    return table(spark, sf, "customer").select("c_custkey", fields.company_name_clean(name).alias("company_name"))


@query
def split_fio(spark, sf):
    return raw_rows(D.contacts(spark, sf), N.split_fio(col("full_name")).alias("f")).select("page_ord", "contact_ord", "f.*")


def fio_rows(spark, sf):
    rows = raw_rows(D.contacts(spark, sf), N.split_fio(F.coalesce("full_name", F.lit(""))).alias("f"))
    return rows.withColumn("g", N.detect_gender(col("f")))


@query
def detect_gender(spark, sf):
    return fio_rows(spark, sf).select("page_ord", "contact_ord", col("g").alias("gender"))


@query
def gender_ending(spark, sf):
    return fio_rows(spark, sf).select("page_ord", "contact_ord", N.gender_ending(col("g")).alias("ending"))


@query
def family_dative(spark, sf):
    return fio_rows(spark, sf).select("page_ord", "contact_ord", N.family_dative(col("f.family"), col("g")).alias("family"))


@query
def fio_dative(spark, sf):
    return fio_rows(spark, sf).select("page_ord", "contact_ord", N.fio_dative(col("f"), col("g")).alias("fio_dative"))


@query
def name_patronymic(spark, sf):
    return fio_rows(spark, sf).select("page_ord", "contact_ord", N.name_patronymic(col("f")).alias("name_patronymic"))


@query
def capitalize_first(spark, sf):
    return raw_rows(D.contacts(spark, sf), T.capitalize_first(F.lower("position_raw")).alias("position"))


@query
def scan_date_text(spark, sf):
    return table(spark, sf, "events").select("event_id", T.scan_date_text(col("ts")).alias("scan_date"))


@query
def safe_partition_name(spark, sf):
    name = F.concat("source", F.lit(":/"), "lang", F.lit("*[x]?\\"), "text")
    return table(spark, sf, "documents").select("doc_id", T.safe_partition_name(name).alias("name"))


@query
def crm_category(spark, sf):
    return raw_rows(R.with_category(D.contacts(spark, sf)), "category")


@query
def ui_category(spark, sf):
    return raw_rows(D.contacts(spark, sf), categories.ui_category(col("position_normalized"), col("position_raw")).alias("category"))


@query
def has_useful_field(spark, sf):
    useful = fields.has_useful_field(col("personal_email"), col("phone"), col("position_raw"), col("inn"))
    return raw_rows(D.contacts(spark, sf), useful.alias("useful"))


@query
def json_from_text(spark, sf):
    k = table(spark, sf, "customer").select(col("c_custkey").alias("k"))
    return k.select("k", answers.json_object_from_text(F.expr(D.JSON_TEXT)).alias("json"))


@query
def truncate_text(spark, sf):
    return documents(spark, sf).select("doc_id", T.truncate_text(col("text")).alias("text"))


@query
def role_comment(spark, sf):
    return raw_rows(D.contacts(spark, sf), T.role_comment(col("comment")).alias("comment"))


# --- joins --------------------------------------------------------------------------------

@query
def block_domains(spark, sf):
    return B.block_domains(stored_pages(spark, sf), "page_url", blocklist(spark, sf), SPREAD).select("page_ord", "page_url")


def emails_found(spark, sf):
    docs = documents(spark, sf).select(col("doc_id").alias("page_ord"), F.explode(E.extract_emails(col("text"))).alias("email"))
    return docs.unionByName(D.contacts(spark, sf).select("page_ord", col("personal_email").alias("email")))


@query
def block_emails(spark, sf):
    return B.block_emails(emails_found(spark, sf), "email", blocklist(spark, sf), ["page_ord", "email"])


@query
def block_inns(spark, sf):
    return raw_rows(B.block_inns(D.contacts(spark, sf), "inn", blocklist(spark, sf), CONTACT_SPREAD), "inn")


@query
def block_any(spark, sf):
    kept = B.block_any(D.contacts(spark, sf), blocklist(spark, sf), CONTACT_SPREAD, "site_url", "personal_email", "inn")
    return raw_rows(kept)


@query
def site_defaults(spark, sf):
    return raw_rows(enrich.site_defaults(D.contacts(spark, sf), D.listed_sites(spark, sf)), "site_company", "site_inn")


@query
def match_sites(spark, sf):
    pages = people(spark, sf).select("site_url", "page_url")
    return SK.match_sites(pages, D.listed_sites(spark, sf), "page_url", "site_url").select("page_url", "listed_url", "listed_ord")


@query
def fill_from_page_text(spark, sf):
    texts = D.people_pages(spark, sf).select("page_ord", "page_url", H.html_to_text(col("html")).alias("text"))
    contacts = D.contacts(spark, sf).withColumn("inn", F.when(col("page_ord") % 2 == 0, col("inn")))
    return raw_rows(enrich.fill_from_page_text(contacts, texts), "inn", "kpp")


@query
def fuzzy_dictionary_join(spark, sf):
    return raw_rows(M.fuzzy_dictionary_join(D.contacts(spark, sf)), "position_raw", "canonical")


def corrections(spark, sf):
    """Corrections for the first twelve contact numbers of every site."""
    return D._select(table(spark, sf, "customer"), D.CORRECTION_SQL)


CORRECTED = ["company_name", "full_name", "position_raw", "position_normalized", "personal_email", "company_email", "phone"]


@query
def apply_corrections(spark, sf):
    return raw_rows(enrich.apply_corrections(D.contacts(spark, sf), corrections(spark, sf)), *CORRECTED)


@query
def match_targets_join(spark, sf):
    targets = spark.createDataFrame([(t,) for t in SIMILAR_TARGETS], "target string")
    return raw_rows(M.match_targets_join(D.contacts(spark, sf), targets))


@query
def match_targets_similar(spark, sf):
    return raw_rows(M.match_targets_join(D.contacts(spark, sf), SIMILAR_TARGETS[:2]))


@query
def substring_targets(spark, sf):
    return raw_rows(M.substring_targets(D.contacts(spark, sf), TARGETS))


@query
def stoplist_filter(spark, sf):
    return B.block_domains(listed_pages(spark, sf), "url", B.stoplist(spark), SPREAD)


def gold(spark, sf):
    """Who really stands on the pages: those built without a challenge."""
    rows = D.people_pages(spark, sf).filter("kind <> 6")
    both = rows.select("site_url", "page_ord", F.explode(F.array("name_a", "name_b")).alias("full_name"))
    return both.select("site_url", "full_name").distinct()


@query
def contacts_vs_gold(spark, sf):
    """Pages with a challenge are not read, so their people are missed; some who are found are not in the table."""
    rows = D.people_pages(spark, sf)
    names = F.when(col("k") % 9 == 0, F.array("name_a")).otherwise(F.array("name_a", "name_b"))
    true = rows.select("site_url", F.explode(names).alias("full_name"))
    return enrich.contacts_vs_gold(X.extract_contacts(PG.drop_captcha_pages(D.pages_only(rows))), true)


@query
def precision_recall(spark, sf):
    return enrich.precision_recall(D.contacts(spark, sf), gold(spark, sf))


# --- aggregates, dedup, windows ---------------------------------------------------------------

@query
def dedup_name_company(spark, sf):
    return raw_rows(dedup.dedup_name_company(D.contacts(spark, sf)), "full_name", "company_name")


@query
def dedup_name_email_phone(spark, sf):
    return raw_rows(dedup.dedup_name_email_phone(D.contacts(spark, sf)), "full_name", "personal_email", "phone")


@query
def dedup_merge(spark, sf):
    return raw_rows(dedup.dedup_merge(D.contacts(spark, sf)), "full_name", "company_name", *dedup.MERGED_FIELDS)


@query
def propagate_inn_kpp(spark, sf):
    return raw_rows(enrich.propagate_inn_kpp(D.contacts(spark, sf)), "inn", "kpp")


@query
def propagate_company_email(spark, sf):
    return raw_rows(enrich.propagate_company_email(D.contacts(spark, sf)), "company_email")


@query
def category_counts(spark, sf):
    return R.category_counts(R.with_category(D.contacts(spark, sf)))


@query
def site_counts(spark, sf):
    return R.site_counts(D.sites(spark, sf), D.contacts(spark, sf))


@query
def ui_category_counts(spark, sf):
    return R.ui_category_counts(D.contacts(spark, sf))


@query
def normalization_report(spark, sf):
    return dedup.normalization_report(D.contacts(spark, sf))


@query
def task_totals(spark, sf):
    return TK.task_totals(tasks(spark, sf))


@query
def contacts_by_day(spark, sf):
    events = table(spark, sf, "events").select(col("ts").alias("created_at"), (col("event_id") % 9).alias("contacts_found"))
    return TK.contacts_by_day(events, F.lit("2024-02-02").cast("date")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query
def blocklist_stats(spark, sf):
    return B.blocklist_stats(blocklist(spark, sf))


@query
def token_usage(spark, sf):
    return TK.token_usage(calls(spark, sf))


@query
def site_summary(spark, sf):
    failed = table(spark, sf, "pages").filter(F.expr(D.FETCH_STATUS).isin("403", "404", "429", "500", "503"))
    errors = failed.select(F.regexp_extract("url", r"^(https?://[^/?#]*)", 1).alias("site_url"))
    return R.site_summary(stored_pages(spark, sf), D.contacts(spark, sf), errors)


@query
def upload_preview(spark, sf):
    return TK.upload_preview(D.sites(spark, sf)).select("rows_count", F.array_join("preview_urls", ",").alias("preview_urls"))


@query
def new_blocklist_entries(spark, sf):
    known = B.blocklist_from_entries(table(spark, sf, "customer").select(F.expr(D.CUSTOMER_ENTRY).alias("entry")))
    return B.new_blocklist_entries(known, D.blocklist_entries(spark, sf))


@query
def fallback_counts(spark, sf):
    events = table(spark, sf, "events").select(F.expr(D.pick("event_id", ["llm_timeout", "llm_http_error", "llm_unavailable"])).alias("reason"))
    return TK.fallback_counts(events)


@query
def token_budget_cutoff(spark, sf):
    out = TK.token_budget_cutoff(calls(spark, sf), ["session"], ["conv_id", "turn"], budget=100_000)
    return out.select("session", "conv_id", "turn", "used_before", "refused")


@query
def progress_track(spark, sf):
    seconds = F.unix_seconds(col("ts").cast("timestamp")).cast("double") - F.unix_seconds(F.lit("2023-12-31 23:00:00").cast("timestamp"))
    steps = table(spark, sf, "events").select(
        col("user_id").alias("task_id"), "ts", "event_id", F.lit(1000).alias("total_sites"), seconds.alias("elapsed_seconds")
    )
    out = TK.progress_track(steps, ["ts", "event_id"])
    return out.select("event_id", "task_id", "processed", F.round("percent", 4).alias("percent"), F.round("eta_seconds", 2).alias("eta_seconds"))


@query
def contact_index(spark, sf):
    return raw_rows(enrich.contact_index(D.contacts(spark, sf), pages_per_block=64), "site_url", "idx")


# --- sort, paging, search, sets --------------------------------------------------------------

@query
def list_tasks(spark, sf):
    return TK.list_tasks(tasks(spark, sf), "completed", offset=20, limit=50).select("task_id", "status")


@query
def list_records(spark, sf):
    return R.list_records(D.contacts(spark, sf), offset=10, limit=20)


@query
def search_contacts(spark, sf):
    return raw_rows(R.search_contacts(D.contacts(spark, sf), "ИВАН"))


@query
def sort_contacts(spark, sf):
    return raw_rows(R.sort_contacts(D.contacts(spark, sf), "full_name", descending=True), "full_name")


@query
def sort_tasks(spark, sf):
    return TK.sort_tasks(tasks(spark, sf), "contacts_found").select("task_id", "contacts_found")


@query
def order_categories(spark, sf):
    return R.order_categories(R.with_category(D.contacts(spark, sf)))


@query
def blocklist_add(spark, sf):
    known = B.blocklist_from_entries(table(spark, sf, "customer").select(F.expr(D.CUSTOMER_ENTRY).alias("entry")))
    return B.blocklist_add(known, D.blocklist_entries(spark, sf))


@query
def blocklist_remove(spark, sf):
    gone = table(spark, sf, "customer").select(F.expr(D.CUSTOMER_ENTRY).alias("entry"))
    return B.blocklist_remove(blocklist(spark, sf), gone)


@query
def union_site_results(spark, sf):
    contacts = D.contacts(spark, sf)
    hot = contacts.filter("site_url = 'https://site0.example.ru'")
    rest = contacts.filter("site_url <> 'https://site0.example.ru'")
    return raw_rows(R.union_site_results(hot, rest), "site_url")


@query
def distinct_values(spark, sf):
    return emails_found(spark, sf).select("email").distinct()


@query
def words_overlap(spark, sf):
    words = F.filter(F.split(F.lower(F.coalesce("full_name", F.lit(""))), r"\s+"), lambda w: w != "")
    roles = F.split(F.lower(F.coalesce("position_raw", F.lit(""))), r"\s+")
    return raw_rows(
        D.contacts(spark, sf), T.set_is_subset(words, vocab.CITIES).alias("only_cities"), T.sets_overlap(roles, vocab.POSITION_MARKERS).alias("has_marker")
    )


# --- streaming ---------------------------------------------------------------------------------

def arriving(spark, sf, name, key, batches, shape=lambda rows: rows):
    """A table as a stream of several files, one per micro-batch, in the order of a key."""
    path = scratch(spark)
    rows = table(spark, sf, name)
    last = rows.agg(F.max(key)).first()[0] or 0
    rows = shape(rows.withColumn("_batch", F.floor(col(key).cast("long") * batches / (last + 1)).cast("int")))
    for i in range(batches):
        rows.filter(col("_batch") == i).drop("_batch").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream_df):
    path = scratch(spark)
    J.write_batches(stream_df, f"{path}/out", f"{path}/state").awaitTermination()
    return J.read_batches(spark, f"{path}/out")


def arriving_customers(spark, sf, batches):
    return arriving(spark, sf, "customer", "c_custkey", batches, lambda rows: rows.select("c_custkey", "_batch"))


def stream_contacts(spark, sf, batches=5):
    """The contacts table arriving as a stream."""
    keys = D._select(arriving_customers(spark, sf, batches), D.CONTACT_KEYS)
    fields_ = D._select(keys, {**D.CONTACT_SQL, "k": "k"})
    return fields_.withColumn("scan_date", F.timestamp_seconds(1704067200 + col("k") % 31_536_000)).drop("k")


@query
def stream_extract_contacts(spark, sf):
    pages = D.pages_only(D.people_pages_of(arriving_customers(spark, sf, 3)))
    return run(spark, J.stream_extract_contacts(pages)).select(*CONTACT_CHECK, "position_normalized", "page_language")


@query
def stream_dedup_contacts(spark, sf):
    # a micro-batch is one file, which one task reads
    arriving_ = arriving_customers(spark, sf, 4).repartition(spark.sparkContext.defaultParallelism, "c_custkey")
    keys = D._select(arriving_, D.CONTACT_KEYS)
    rows = D._select(keys, D.ARRIVING_CONTACT_SQL).withColumn("scan_date", F.timestamp_millis("ms"))
    return raw_rows(run(spark, J.stream_dedup_contacts(rows, "1 hour")), "site_url", "full_name", "phone", "ms", "outcome")


@query
def stream_upsert_merge(spark, sf):
    path = scratch(spark)
    J.stream_upsert_merge(stream_contacts(spark, sf), f"{path}/out", f"{path}/state").awaitTermination()
    return raw_rows(J.read_merged(read_levels(spark, f"{path}/out")), "full_name", "company_name", *dedup.MERGED_FIELDS)


def stream_events(spark, sf):
    events = arriving(spark, sf, "events", "event_id", 4, lambda rows: rows.select("event_id", "_batch"))
    return D._select(events, D.STREAM_EVENT_SQL).withColumn("ts", F.timestamp_millis("ms"))


@query
def stream_progress(spark, sf):
    path = scratch(spark)
    J.stream_progress(stream_events(spark, sf), path, f"{path}/state", 100_000, "4 hours", "30 minutes").awaitTermination()
    return J.read_batches(spark, f"{path}/rows").select(
        F.unix_millis("window_start").alias("start"), "task_id", "n_events", col("value").cast("double").alias("value"), "processed",
        F.round("percent", 6).alias("percent"), F.round("rate", 6).alias("rate"), F.round("eta_minutes", 3).alias("eta_minutes"),
    )


@query
def stream_terminal_status(spark, sf):
    rows = run(spark, J.stream_terminal_status(stream_events(spark, sf), "1 hour"))
    return rows.select("task_id", "outcome", "type", F.unix_millis("closed_at").alias("closed_at"), "n_events")


# --- prompts and answers -------------------------------------------------------------------------

@query
def correction_prompts(spark, sf):
    return prompts.correction_prompts(D.contacts(spark, sf), D.listed_sites(spark, sf))


@query
def page_prompts(spark, sf):
    pages = table(spark, sf, "documents").select(
        col("doc_id").alias("page_ord"), F.concat(F.lit("https://"), "source").alias("page_url"),
        F.when(col("doc_id") % 2 == 0, col("lang")).alias("company_name"), "text",
    )
    return prompts.page_prompts(pages, ["Юрист", "CFO"])


@query
def parse_answers(spark, sf):
    k = table(spark, sf, "customer").select(col("c_custkey").alias("k"))
    texts = k.select(F.concat(F.lit("s"), col("k").cast("string")).alias("site_url"), F.expr(D.ANSWER).alias("answer"))
    return prompts.parse_answers(texts)


# --- everything together ----------------------------------------------------------------------------

@query
def site_contacts(spark, sf):
    """The flagship: pages and site list to the clean contact table."""
    table_ = plan.contact_table(people(spark, sf), D.listed_sites(spark, sf), blocklist(spark, sf))
    return R.with_category(table_).select(
        "site_url", "page_ord", "contact_ord", "company_name", "full_name", "position_normalized", "category",
        "personal_email", "company_email", "phone", "inn", "kpp",
    )
