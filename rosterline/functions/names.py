"""Person names: three levels of checks and Russian declension."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterline import vocab
from rosterline.functions.text import (
    alternation, collapse_ws, contains_any, has_word, let, one_of, strip_ws, word_count,
)

_EDGE = ".,;:-"


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def name_quick_valid(name: Column) -> Column:
    """Cheap check made on every name found in text."""
    return let(name, lambda n: let(F.lower(n), lambda lowered: _quick(n, lowered)))


def _quick(name: Column, lowered: Column) -> Column:
    edge = r"[.,;:\-]*"
    ends_genitive = lowered.rlike(
        rf"(?U)(?<!\S){edge}(?:{alternation(vocab.QUICK_GENITIVE_SURNAMES)}){edge}\s*$"
    )
    starts_place = lowered.rlike(
        rf"(?U)^\s*{edge}(?:{alternation(vocab.PREPOSITIONAL_PLACES)}){edge}(?!\S)"
    )
    return _yes(
        F.length(name).between(4, 70)
        & ~name.rlike(r"(?U)\d")
        & ~has_word(lowered, vocab.QUICK_NAME_GARBAGE, _EDGE)
        & ~has_word(lowered, vocab.QUICK_FIELD_LABELS, _EDGE + "()")
        & ~ends_genitive
        & ~starts_place
    )


def name_valid_strict(name: Column) -> Column:
    """Two to five capitalised words, no organisation, no politician."""
    return let(strip_ws(name), lambda v: let(F.lower(v), lambda lowered: _strict(v, lowered)))


def _strict(value: Column, lowered: Column) -> Column:
    lower_part = r"(?U)(?:^|[\s\-])(?!\.*(?:[\s\-]|$))[^\p{Lu}]"
    return _yes(
        F.length(value).between(4, 100)
        & ~value.rlike(r"(?U)[\d@:/]")
        & word_count(value).between(2, 5)
        & ~value.rlike(lower_part)
        & ~contains_any(lowered, vocab.ORG_TERMS)
        & ~contains_any(lowered, vocab.POLITICIANS)
    )


def name_valid_final(name: Column) -> Column:
    """The last check before export."""
    return let(strip_ws(name), lambda v: let(F.lower(v), lambda lowered: _final(v, lowered)))


def _final(value: Column, lowered: Column) -> Column:
    real_words = F.regexp_count(value, F.lit(r"(?U)(?<!\S)(?:\S{3,}|\S\.)(?!\S)"))
    # a word that is no initial and does not start with a capital
    small_word = r"(?U)(?<!\S)(?!\S?\.(?!\S))[^\sА-ЯЁA-Z]"
    long_word = r"(?U)(?<!\S)\S{3,}"
    edge = r"[.,;:\-()]*"
    no_city = rf"(?U)(?<!\S)(?!{edge}(?:{alternation(vocab.CITIES)}){edge}(?!\S))\S{{3,}}"
    only_cities = lowered.rlike(long_word) & ~lowered.rlike(no_city)
    return _yes(
        F.length(value).between(4, 70)
        & ~has_word(lowered, vocab.NAME_GARBAGE, ".,;:-()\"'")
        & real_words.between(2, 4)
        & ~value.rlike(small_word)
        & ~only_cities
        & ~value.rlike(r"(?U)\d")
        & ~has_word(lowered, vocab.FIELD_LABELS, ".,;:-()")
        & ~value.rlike(r"[@#$%^&*=+{}\[\]<>/\\|~`]")
    )


def name_blocked(name: Column) -> Column:
    """A listed public figure, or an object named after one (genitive)."""
    return let(F.lower(collapse_ws(name)), _blocked)


def _blocked(lowered: Column) -> Column:
    edge = r"[.,;:\-]*"
    genitive = lowered.rlike(
        rf"(?U)(?<!\S){edge}(?:{alternation(vocab.GENITIVE_SURNAMES)}){edge}$"
    )
    return _yes(one_of(lowered, vocab.BLOCKED_NAMES) | genitive)


def name_collapse_ws(name: Column) -> Column:
    return collapse_ws(name)


def split_fio(full_name: Column) -> Column:
    """Struct of family, name and patronymic; empty strings for missing parts.

    Hyphenated surnames split at the hyphen and initials count as words.
    """
    def parts(tokens: Column, whole: Column) -> Column:
        def token(i: int) -> Column:
            return F.coalesce(F.get(tokens, F.lit(i)), F.lit(""))

        family = F.when(F.size(tokens) > 0, token(0)).otherwise(strip_ws(whole))
        return F.struct(
            F.coalesce(family, F.lit("")).alias("family"),
            token(1).alias("name"),
            token(2).alias("patronymic"),
        )

    return let(F.regexp_extract_all(full_name, F.lit(r"[А-ЯЁA-Z][а-яёa-z]*\.?"), F.lit(0)), parts, full_name)


def detect_gender(fio: Column) -> Column:
    """`м` or `ж` from the patronymic, else from the surname; `м` by default."""
    family, patronymic = fio.family, F.regexp_replace(F.lower(fio.patronymic), r"\.+$", "")
    return (
        F.when(
            fio.patronymic == "",
            F.when(family.rlike("(?:ова|ева|ина|ая|яя)$"), "ж").otherwise("м"),
        )
        .when(patronymic.rlike("ич$"), "м")
        .when(patronymic.rlike("(?:вна|чна|на)$"), "ж")
        .otherwise("м")
    )


def gender_ending(gender: Column) -> Column:
    return F.when(gender == "м", "ый").otherwise("ая")


def family_dative(family: Column, gender: Column) -> Column:
    """Surname in the dative case by its ending."""
    return let(F.regexp_replace(family, r"\.+$", ""), _dative, gender)


def _dative(f: Column, gender: Column) -> Column:
    lowered = F.lower(f)
    without_one = F.left(f, F.length(f) - 1)
    without_two = F.left(f, F.length(f) - 2)
    male = (
        F.when(lowered.rlike("(?:ий|ый|ой)$"), F.concat(without_two, F.lit("ому")))
        .when(lowered.rlike("ь$"), F.concat(without_one, F.lit("ю")))
        .when(lowered.rlike("[бвгджзйклмнпрстфхцчшщ]$"), F.concat(f, F.lit("у")))
        .otherwise(f)
    )
    female = (
        F.when(lowered.rlike("(?:ая|яя)$"), F.concat(without_two, F.lit("ой")))
        .when(lowered.rlike("(?:ова|ева|ина)$"), F.concat(without_one, F.lit("ой")))
        .when(lowered.rlike("а$"), F.concat(without_one, F.lit("е")))
        .otherwise(f)
    )
    return F.when(gender == "м", male).otherwise(female)


def fio_dative(fio: Column, gender: Column) -> Column:
    """`Surname(dative) N.P.`"""
    def initial(part: Column) -> Column:
        return F.when(part == "", F.lit("")).otherwise(F.concat(F.upper(F.left(part, F.lit(1))), F.lit(".")))

    family = family_dative(fio.family, gender)
    initials = F.concat(initial(fio["name"]), initial(fio.patronymic))
    return (
        F.when(fio.family == "", F.lit(""))
        .when(initials == "", family)
        .otherwise(F.concat(family, F.lit(" "), initials))
    )


def name_patronymic(fio: Column) -> Column:
    return F.concat_ws(" ", F.nullif(fio["name"], F.lit("")), F.nullif(fio.patronymic, F.lit("")))
