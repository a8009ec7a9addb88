"""Text similarity with no built-in counterpart, as small Arrow UDFs.

ratio(a, b) = 100 * 2 * LCS(a, b) / (|a| + |b|), LCS being the longest common
subsequence.  Spark's levenshtein is another measure.
"""

import sys
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterline import vocab
from rosterline.functions.text import lookup as text_lookup
from rosterline.functions.text import strip_ws

# executors need not have this package: its functions travel with the plan
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _masks(text: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, char in enumerate(text):
        masks[char] = masks.get(char, 0) | (1 << i)
    return masks


def _lcs(masks: dict[str, int], width: int, other: str) -> int:
    """Length of the longest common subsequence, one bit per character."""
    full = (1 << width) - 1
    state = full
    for char in other:
        hit = state & masks.get(char, 0)
        state = ((state + hit) | (state - hit)) & full
    return width - state.bit_count()


def ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * _lcs(_masks(a), len(a), b) / (len(a) + len(b))


def sorted_tokens(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sort(a: str, b: str) -> float:
    return ratio(sorted_tokens(a), sorted_tokens(b))


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with any window of the longer one,
    windows that hang over either end included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0 if long else 100.0
    best = _best_window(short, long)
    return max(best, _best_window(long, short)) if len(a) == len(b) else best


def _best_window(short: str, long: str) -> float:
    width, masks = len(short), _masks(short)
    best = 0.0
    for start in range(1 - width, len(long)):
        window = long[max(start, 0):start + width]
        best = max(best, 200.0 * _lcs(masks, width, window) / (width + len(window)))
    return best


def _over_distinct(values: pd.Series, fn) -> pd.Series:
    """Apply a function once for each distinct value of the batch."""
    codes, uniques = pd.factorize(values)
    results = pd.Series([fn(u) for u in uniques] + [None], dtype=object)
    return results.take(codes).reset_index(drop=True)


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_sort(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else partial(x, y) for x, y in zip(a, b)], dtype="float64")


def dictionary_lookup(dictionary: dict[str, str], cutoff: float = 75.0):
    """UDF: lower-case position -> value of the most similar key, or null.

    The dictionary is a small fixed table that travels with the function; the
    first key wins a tie.  A key whose length alone rules out the cutoff is
    skipped.
    """
    keys = [(key.lower(), value) for key, value in dictionary.items()]

    @F.pandas_udf(T.StringType())
    def lookup(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        entries = [(len(s), s, _masks(s), v) for s, v in ((sorted_tokens(k), v) for k, v in keys)]
        memo: dict[str, str | None] = {}

        def best(text: str) -> str | None:
            if text not in memo:
                tokens, top, found = sorted_tokens(text), cutoff, None
                for width, _, masks, value in entries:
                    total = width + len(tokens)
                    if 200.0 * min(width, len(tokens)) < top * total:
                        continue
                    score = 200.0 * _lcs(masks, width, tokens) / total
                    if score > top or (found is None and score >= top):
                        top, found = score, value
                if len(memo) > 100_000:
                    memo.clear()
                memo[text] = found
            return memo[text]

        for batch in batches:
            yield _over_distinct(batch, best)

    return lookup


class Entries:
    """Sorted-token texts of a dictionary, scored against one text all at once.

    Texts of up to 64 characters are one machine word each: the bit state of the
    common subsequence is kept for all of them in one array and moves by one
    character of the asked text per step.  Longer texts are scored one by one.
    """

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.widths = np.array([len(t) for t in texts], dtype=np.int64)
        short = np.flatnonzero(self.widths <= 64)
        alphabet = sorted({c for i in short for c in texts[i]})
        self.rows = {c: i for i, c in enumerate(alphabet)}
        self.masks = np.zeros((len(alphabet) + 1, len(texts)), dtype=np.uint64)
        for i in short:
            for place, char in enumerate(texts[i]):
                self.masks[self.rows[char], i] |= np.uint64(1 << place)
        self.full = np.array([(1 << min(int(w), 64)) - 1 for w in self.widths], dtype=np.uint64)
        self.long = {int(i): _masks(texts[i]) for i in np.flatnonzero(self.widths > 64)}

    def scores(self, text: str, chosen: np.ndarray) -> np.ndarray:
        """ratio of the text with the chosen entries (numbers)."""
        full = self.full[chosen]
        state = full.copy()
        for char in text:
            hit = state & self.masks[self.rows.get(char, len(self.rows)), chosen]
            state = ((state + hit) | (state - hit)) & full
        common = self.widths[chosen] - np.bitwise_count(state).astype(np.int64)
        for place, i in enumerate(chosen.tolist()):
            if i in self.long:
                common[place] = _lcs(self.long[i], int(self.widths[i]), text)
        total = self.widths[chosen] + len(text)
        return np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)

    def best(self, text: str, cutoff: float) -> tuple[int, float] | None:
        """The first entry of the highest score that reaches the cutoff; lengths that rule it out are not scored."""
        widths = self.widths
        able = np.flatnonzero(200.0 * np.minimum(widths, len(text)) >= cutoff * (widths + len(text)))
        if len(able) == 0:
            return None
        scores = self.scores(text, able)
        top = int(np.argmax(scores))
        return (int(able[top]), float(scores[top])) if scores[top] >= cutoff else None


def position_dictionary() -> dict[str, str]:
    """Russian entries before English ones, in dictionary order."""
    return {**vocab.POSITIONS_RU, **{k: v for k, v in vocab.POSITIONS_EN.items() if k not in vocab.POSITIONS_RU}}


def position_exact(position: Column) -> Column:
    """Canonical name of a variant, ignoring case; null if there is none."""
    first: dict[str, str] = {}
    for variant, canonical in position_dictionary().items():
        first.setdefault(variant.lower(), canonical)
    return text_lookup(F.lower(strip_ws(position)), first)


def normalize_position(position: Column) -> Column:
    """Dictionary name of a position: exact, else similar, else the text itself.

    Only text that has no exact entry is sent to Python.
    """
    exact = position_exact(position)
    lookup = dictionary_lookup(position_dictionary())
    filled = position.rlike(r"(?U)\S")
    unknown = F.when(filled & exact.isNull(), F.lower(strip_ws(position)))
    return F.when(filled, F.coalesce(exact, lookup(unknown), position))


def partial_target_match(targets: list[str], cutoff: float = 70.0):
    """UDF: does any target reach the partial ratio against the text?"""
    wanted = [t.lower() for t in targets]

    @F.pandas_udf(T.BooleanType())
    def match(texts: pd.Series) -> pd.Series:
        return _over_distinct(texts, lambda text: any(partial(t, text) >= cutoff for t in wanted))

    return match


def position_matches_targets(raw: Column, normalized: Column, targets: list[str]) -> Column:
    """Substring match in the JVM first, the partial ratio only for the rest."""
    from rosterline.functions.positions import contains_target

    if not targets:
        return F.lit(True)
    direct = contains_target(raw, normalized, targets)
    text = F.lower(F.concat(F.coalesce(raw, F.lit("")), F.lit(" "), F.coalesce(normalized, F.lit(""))))
    similar = partial_target_match(targets)(F.when(~direct, text))
    return direct | F.coalesce(similar, F.lit(False))
