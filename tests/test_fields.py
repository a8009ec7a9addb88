"""Column functions on small literal inputs."""

from pyspark.sql import functions as F

from rosterline.functions import answers, categories, entities as E, fields, html as H, names as N, positions as P
from rosterline.functions import text as T, urls as U
from rosterline.functions.person_blocks import person_blocks
from rosterline.functions.similarity import normalize_position

TEAM_PAGE = """<html lang="ru"><head><title>Пекарня «Колос» | О нас</title></head>
<body><main><h2>Кто печёт хлеб</h2><ul>
<li class="card"><b>Зуева Алла Борисовна</b> <span class="role">Технолог</span><i>пишите: zueva.a@kolos.example, звоните +7 (383) 218-40-91</i></li>
<li class="card"><b>Громов Лев Олегович</b> <span class="role">Менеджер по снабжению</span><i>+7 (383) 218-40-92, lev@kolos.example</i></li>
<li>смена открыта с шести утра</li></ul></main>
<footer>Пекарня «Колос», ИНН 5406271843, КПП 540601001</footer></body></html>"""


def values(spark, expression, inputs):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, x string")
    return [r.v for r in df.select("i", expression(F.col("x")).alias("v")).orderBy("i").collect()]


def test_text_and_entities_of_a_page(spark):
    df = spark.createDataFrame([(TEAM_PAGE,)], "html string").withColumn("text", H.html_to_text(F.col("html")))
    text = F.col("text")
    row = df.select(
        E.extract_emails(text).alias("emails"), E.extract_phones(text).alias("phones"), E.extract_inn(text).alias("inn"),
        E.extract_kpp(text).alias("kpp"), E.extract_fio_all(text).alias("fios"), text,
    ).first()
    assert row.emails == ["zueva.a@kolos.example", "lev@kolos.example"]
    assert row.phones == ["+7 (383) 218-40-91", "+7 (383) 218-40-92"]
    assert (row.inn, row.kpp) == ("5406271843", "540601001")
    assert row.fios == ["Зуева Алла Борисовна", "Громов Лев Олегович"]
    assert "О нас" not in row.text  # the head is no text


def test_blocks_of_a_page(spark):
    df = spark.createDataFrame([(TEAM_PAGE,), ("<p>no names here</p>",)], "html string")
    first, second = [r.b for r in df.select(person_blocks(F.col("html")).alias("b")).collect()]
    assert second == []
    assert [b.strings[0] for b in first] == ["Зуева Алла Борисовна", "Громов Лев Олегович"]
    assert [b.role_texts for b in first] == [["Технолог"], ["Менеджер по снабжению"]]
    assert first[0].html.startswith('<li class="card">') and first[0].html.endswith("</li>")


def test_unclosed_and_nested_elements(spark):
    page = '<ul><li class="card">Иванов Иван Иванович, <b>шеф<li class="card">Петров Пётр Петрович, <br>тел</ul>'
    df = spark.createDataFrame([(page,)], "html string")
    blocks = df.select(person_blocks(F.col("html")).alias("b")).first().b
    assert [b.text for b in blocks] == ["Иванов Иван Иванович, шеф", "Петров Пётр Петрович, тел"]


def test_emails(spark):
    texts = ["a b.c+d@mail.co.uk, B.C@X.RU b.c+d@mail.co.uk", "none at all", "a@b", "x@y.com_z@w.net", None]
    assert values(spark, E.extract_emails, texts) == [
        ["b.c+d@mail.co.uk", "B.C@X.RU"], [], [], ["x@y.com", "_z@w.net"], [],
    ]


def test_emails_in_a_long_run_take_linear_time(spark):
    # a run without an at sign: a search from every position would not finish
    assert values(spark, E.extract_emails, ["a" * 2_000_000 + " x@y.com @"]) == [["x@y.com"]]


def test_inn_prefers_twelve_digits_and_whole_numbers(spark):
    texts = ["ИНН 770712345678", "инн: 7707123456", "число 77071234567", "7707123456", "КПП 770701001"]
    assert values(spark, E.extract_inn, texts) == ["770712345678", "7707123456", None, "7707123456", None]
    assert values(spark, E.labelled_inn, texts) == ["770712345678", "7707123456", None, None, None]


def test_phone_forms(spark):
    phones = ["8 (916) 123-45-67", "+7 495 123 45 67", "4951234567", "+1 (555) 234-5678", "доб. 12", None]
    assert values(spark, fields.phone_e164, phones) == [
        "+79161234567", "+74951234567", "+74951234567", "+15552345678", "12", None,
    ]


def test_names(spark):
    names = ["Иванов Иван Иванович", "Москва Казань", "Отдел Продаж", "иванов Иван", "Петров А.П.", "", None]
    assert values(spark, N.name_valid_final, names) == [True, False, False, False, True, False, False]
    assert values(spark, N.name_valid_strict, names)[:2] == [True, True]
    assert values(spark, N.name_blocked, ["Путин  Владимир Владимирович", "Институт им. Менделеева", "Иванов"]) == [True, True, False]


def test_declension(spark):
    def dative(x):
        fio = N.split_fio(x)
        return N.fio_dative(fio, N.detect_gender(fio))

    assert values(spark, dative, ["Калашников Дмитрий Владимирович", "Петрова Анна Ивановна", "Достоевский Ф.М.", ""]) == [
        "Калашникову Д.В.", "Петровой А.И.", "Достоевскому Ф.М.", "",
    ]


def test_positions(spark):
    texts = ["Главный инженер", "12 мая", "см. www.x.ru", "Форум 2024", "Руководство:", "ул. Мира, д. 5", None]
    assert values(spark, P.position_valid_final, texts)[:1] == ["Главный инженер"]
    assert values(spark, P.position_valid_final, texts)[1:5] == [None] * 4
    assert values(spark, P.position_valid_strict, texts)[5] is None


def test_category_and_dictionary(spark):
    texts = ["Генеральный  директор", "зам. генерального директора", "Ведущий юрист-аналитик", "повар", None]
    assert values(spark, categories.crm_category, texts) == ["Директора", "Директора", "Юрист", "Другие категории", "Другие категории"]
    assert values(spark, normalize_position, ["генеральный директорр", "director general", "шахтёр", " "]) == [
        "Генеральный директор", "director general", "шахтёр", None,
    ]


def test_urls(spark):
    urls = [" HTTPS://Ex.COM/a/b/?q=1#f", "ex.com", "http://ex.com/", "http://u.ru/a//;p?"]
    assert values(spark, U.normalize_url, urls) == ["https://ex.com/a/b?q=1", "https://ex.com", "http://ex.com/", "http://u.ru/a;p"]
    assert values(spark, U.site_domain, ["https://www.a.b.ru:80/x", "WWW.x.ru/y", "abc", "a.b"]) == ["a.b.ru", "x.ru", None, None]
    base = F.lit("https://s.ru/d/e.html")
    links = ["f.html", "../g", "/h", "//o.ru/x", "?q", "http://z.ru", "./i/"]
    assert values(spark, lambda h: U.resolve_url(base, h), links) == [
        "https://s.ru/d/f.html", "https://s.ru/g", "https://s.ru/h", "https://o.ru/x", "https://s.ru/d/e.html?q", "http://z.ru", "https://s.ru/d/i/",
    ]


def test_entities_in_html(spark):
    assert values(spark, H.unescape_entities, ["&#1048;&#x418; &amp;lt; &laquo;a&raquo;", "x"]) == ["ИИ &lt; «a»", "x"]


def test_json_in_answers(spark):
    texts = ['<think>{}</think> {"a": 1}', 'so: ```json\n{"b": 2}\n``` end', "none", '{"broken": ']
    assert values(spark, answers.json_object_from_text, texts) == ['{"a": 1}', '{"b": 2}', None, None]


def test_named_character_references(spark):
    texts = ["caf&eacute; &hellip; 5&euro; &commat;x &lt;b&gt;", "&amp;lt; &AMP; &nosuch; &#1046;&#x416;", "plain", None]
    assert values(spark, H.unescape_entities, texts) == ["café … 5€ @x <b>", "&lt; & &nosuch; ЖЖ", "plain", None]


def test_schemes_of_social_links(spark):
    got = values(spark, lambda c: E.extract_social_links(c)["vk"], ['<a href="HTTPS://vk.com/me">', '<a href="vk.com/you">', "none"])
    assert got[2] is None and got[0].lower() == "https://vk.com/me" and got[1] == "https://vk.com/you"


def test_mailboxes_move_when_outputs_reuse_input_names(spark):
    """Outputs named like inputs must not leak into the expressions beside them."""
    df = spark.createDataFrame([("ab@x.ru", None), ("p.person@x.ru", "info@x.ru")], "personal_email string, company_email string")
    personal, company = fields.relocate_generic_email(
        F.col("personal_email"), F.col("company_email"), fields.is_generic_email_final(F.col("personal_email"))
    )
    rows = df.select(personal.alias("personal_email"), company.alias("company_email")).collect()
    assert [tuple(r) for r in rows] == [(None, "ab@x.ru"), ("p.person@x.ru", "info@x.ru")]


def test_truncation_marks_only_long_text(spark):
    assert values(spark, lambda c: T.truncate_text(c, 3, "~"), ["abc", "abcd"]) == ["abc", "abc~"]


def test_long_runs_of_blanks_take_linear_time(spark):
    run = " " * 300_000
    assert values(spark, T.strip_ws, [f" a{run}b{run}"]) == [f"a{run}b"]
    assert values(spark, H.html_to_text, [f"<p>a{run}b</p>{run}<i> c </i>"]) == [f"a{run}b c"]
