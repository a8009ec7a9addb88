"""Pages -> contacts.  Everything up to the contact rows stays on the page row,
so the html never enters a shuffle."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions import entities as E
from rosterline.functions.fields import (
    is_generic_email, phone_e164, relocate_generic_email, strict_inn, strict_kpp,
)
from rosterline.functions.html import company_name_from_page, html_to_text, page_language
from rosterline.functions.names import name_valid_strict
from rosterline.functions.person_blocks import person_blocks
from rosterline.functions.positions import position_quick_valid, position_valid_strict
from rosterline.functions.similarity import normalize_position, position_matches_targets
from rosterline.functions.text import empty_to_null, let, strip_ws
from rosterline.operators.dedup import dedup_name_company
from rosterline.operators.skew import exploded



def split_generic_emails(emails: Column) -> Column:
    """Struct of company mailboxes and personal candidates, lower case."""
    generic = F.filter(emails, is_generic_email)
    personal = F.filter(emails, lambda e: ~is_generic_email(e))
    return F.struct(
        F.transform(generic, F.lower).alias("company"), F.transform(personal, F.lower).alias("personal")
    )


def extract_page_entities(pages: DataFrame) -> DataFrame:
    """One row per page with everything found in its text."""
    html, text = F.col("html"), F.col("text")
    lang = F.coalesce(F.col("lang"), page_language(html)) if "lang" in pages.columns else page_language(html)
    base = pages.select("site_url", "page_ord", "page_url", "html", lang.alias("lang"))
    read = base.withColumn("text", html_to_text(html)).withColumn("emails", E.all_emails(text))
    return read.select(
        "site_url", "page_ord", "page_url", "html", "lang", "text", "emails",
        company_name_from_page(html).alias("company_name"),
        E.extract_inn(text).alias("inn"),
        E.extract_kpp(text).alias("kpp"),
        E.company_email(F.col("emails"), F.col("site_url")).alias("company_email"),
        split_generic_emails(F.array_distinct("emails")).alias("mailboxes"),
        E.extract_phones(text).alias("phones"),
        E.extract_fio_all(text).alias("fios"),
        E.extract_social_links(html).alias("social_links"),
    )


def position_from_block(block: Column) -> Column:
    """A valid role element, else the string that follows the name."""
    def fits(text: Column) -> Column:
        return F.length(text).between(4, 99) & position_quick_valid(text)

    roles = F.filter(block.role_texts, fits)
    after_name = F.filter(
        block.strings,
        lambda s, i: fits(s)
        & ~s.rlike("^" + E.EMAIL)
        & F.coalesce(E.has_full_name(F.get(block.strings, i - 1)), F.lit(False)),
    )
    return F.coalesce(F.get(roles, F.lit(0)), F.get(after_name, F.lit(0)))


def block_candidates(blocks: Column) -> Column:
    """Array of contacts, one per block that holds a name."""
    def read(b: Column) -> Column:
        personal = F.filter(E.all_emails(b.html), lambda e: ~is_generic_email(e))
        return F.struct(
            E.extract_fio_first(b.text).alias("full_name"),
            position_from_block(b).alias("position_raw"),
            F.get(personal, F.lit(0)).alias("personal_email"),
            F.get(E.extract_phones(b.text), F.lit(0)).alias("phone_raw"),
            E.extract_social_links(b.html).alias("social_links"),
        )

    return F.filter(F.transform(blocks, read), lambda c: c.full_name.isNotNull())


def text_candidates(
    text: Column, fios: Column, emails: Column, phones: Column, social: Column, max_names: int | None = None, reach: int = 200
) -> Column:
    """Array of contacts of a page without blocks: the i-th name goes with the
    i-th email and the i-th phone.  All names count unless max_names is given."""
    def paired(first: Column, text_: Column, emails_: Column, phones_: Column, social_: Column) -> Column:
        return F.transform(
            first,
            lambda fio, i: F.struct(
                fio.alias("full_name"),
                E.position_near_name(text_, fio, reach).alias("position_raw"),
                F.get(emails_, i).alias("personal_email"),
                F.get(phones_, i).alias("phone_raw"),
                social_.alias("social_links"),
            ),
        )

    return let(fios if max_names is None else F.slice(fios, 1, max_names), paired, text, emails, phones, social)


def _contact_rows(found: DataFrame, candidates: Column) -> DataFrame:
    page = ["site_url", "page_ord", "page_url", "lang", "company_name", "inn", "kpp", "company_email"]
    rows = exploded(found, page, candidates, "contact_ord", "c")
    return rows.select(
        "page_ord", F.col("contact_ord").cast("long").alias("contact_ord"),
        F.coalesce("company_name", F.lit("")).alias("company_name"),
        "site_url", "inn", "kpp", "company_email",
        "c.position_raw", normalize_position(F.col("c.position_raw")).alias("position_normalized"),
        "c.full_name", "c.personal_email",
        phone_e164(F.col("c.phone_raw")).alias("phone"), "c.phone_raw", "c.social_links",
        F.col("page_url").alias("source_url"), F.col("lang").alias("page_language"),
        F.current_timestamp().alias("scan_date"), F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("comment"), F.lit("A").alias("extraction_variant"),
    )


def _with_blocks(pages: DataFrame) -> DataFrame:
    found = extract_page_entities(pages).withColumn("blocks", person_blocks(F.col("html")))
    return found.withColumn("from_blocks", block_candidates(F.col("blocks")))


def _from_text(max_names: int | None = None, reach: int = 200) -> Column:
    """Candidates of the plain text, written out in full so that a page with
    blocks, for which it is not evaluated, skips the search for names as well."""
    text, html = F.col("text"), F.col("html")
    return text_candidates(
        text, E.extract_fio_all(text), F.col("emails"), E.extract_phones(text), E.extract_social_links(html), max_names, reach
    )


def contacts_from_blocks(pages: DataFrame) -> DataFrame:
    return _contact_rows(_with_blocks(pages), F.col("from_blocks"))


def contacts_from_text(pages: DataFrame, max_names: int | None = None, reach: int = 200) -> DataFrame:
    """The text reading of every page, whether or not it has blocks."""
    return _contact_rows(extract_page_entities(pages), _from_text(max_names, reach))


def _valid_first_names(candidates: Column) -> Column:
    """Candidates with a valid name, the first of equal names on the page."""
    def firsts(valid: Column, names: Column) -> Column:
        return F.filter(valid, lambda c, i: F.array_position(names, F.get(names, i)) == i + 1)

    def with_names(valid: Column) -> Column:
        return let(valid, firsts, F.transform(valid, lambda c: F.lower(strip_ws(c.full_name))))

    return let(F.filter(candidates, lambda c: name_valid_strict(c.full_name)), with_names)


def match_targets(contacts: DataFrame, targets: list[str]) -> DataFrame:
    """Contacts whose position meets one of the wanted positions."""
    hit = position_matches_targets(F.col("position_raw"), F.col("position_normalized"), targets)
    return contacts.filter(hit)


def validate_strict(contacts: DataFrame, normalize: bool = True) -> DataFrame:
    """Per-page checks: name, position, mailbox kind, identifiers.

    normalize=False is for rows that already carry a normalised position
    wherever they have a raw one."""
    raw = position_valid_strict(F.col("position_raw"))
    personal, company = relocate_generic_email(
        F.col("personal_email"), F.col("company_email"), is_generic_email(F.col("personal_email"))
    )
    given = empty_to_null(F.col("position_normalized"))
    if normalize:
        given = F.coalesce(given, normalize_position(F.when(given.isNull(), raw)))
    return contacts.filter(name_valid_strict(F.col("full_name"))).withColumns({
        "position_raw": raw,
        "position_normalized": F.when(raw.isNotNull(), given),
        "personal_email": personal,
        "company_email": company,
        "inn": strict_inn(F.col("inn")),
        "kpp": strict_kpp(F.col("kpp")),
    })


def extract_contacts(
    pages: DataFrame, targets: list[str] | None = None, max_names: int | None = None, reach: int = 200
) -> DataFrame:
    """Contacts of every page: blocks first, the plain text where blocks gave none.

    Without targets the choice, the name check and the page-level dedup are all
    made inside the page row.  With targets the choice depends on the positions
    that match, so it needs one anti join on the page key.
    """
    found = _with_blocks(pages)
    if not targets:
        chosen = F.when(F.size("from_blocks") > 0, F.col("from_blocks")).otherwise(_from_text(max_names, reach))
        return validate_strict(_contact_rows(found, _valid_first_names(chosen)), normalize=False)
    page = ["site_url", "page_ord"]
    by_blocks = match_targets(_contact_rows(found, F.col("from_blocks")), targets)
    by_text = match_targets(contacts_from_text(pages, max_names, reach), targets)
    rest = by_text.join(by_blocks.select(*page).distinct(), page, "left_anti")
    return dedup_name_company(validate_strict(by_blocks.unionByName(rest.select(by_blocks.columns)), normalize=False))
