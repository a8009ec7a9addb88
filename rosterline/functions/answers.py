"""JSON inside free text answers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterline.functions.text import strip_ws


def after_thinking(text: Column) -> Column:
    return strip_ws(F.regexp_replace(text, r"(?s)^.*</think>", ""))


def _valid(candidate: Column) -> Column:
    return F.when(F.try_parse_json(candidate).isNotNull() & (candidate != ""), candidate)


def json_object_from_text(text: Column) -> Column:
    """The JSON object of an answer after its thinking part: bare, fenced, or the first brace to the last."""
    text = after_thinking(text)
    bare = F.when(F.startswith(strip_ws(text), F.lit("{")), strip_ws(text))
    fenced = strip_ws(F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1))
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(_valid(bare), _valid(fenced), _valid(braces))


def json_array_from_text(text: Column) -> Column:
    """The first bracketed list after the thinking part, if it is valid JSON."""
    return _valid(F.regexp_extract(after_thinking(text), r"(?s)\[.*?\]", 0))
