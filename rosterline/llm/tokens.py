"""Tokenizers inside tasks: loaded once per worker, with bounded memories of words already encoded."""

import os

#: Entries that a worker remembers at most; a full memory starts anew, which costs time and changes nothing.
REMEMBERED = 1_200_000

_LOADED: dict = {}


def bpe(path: str, plain_specials: bool = False):
    """The tokenizer of a JSON file, one per worker and setting."""
    from tokenizers import Tokenizer

    key = (path, plain_specials)
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        loaded = Tokenizer.from_file(path)
        loaded.encode_special_tokens = plain_specials
        _LOADED[key] = loaded
    return _LOADED[key]


def pieces(path: str):
    """The sentence-piece model of a file, one per worker."""
    import sentencepiece

    if path not in _LOADED:
        _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _LOADED[path]


def memory(*key) -> dict:
    """A dictionary that stays with the worker process from task to task."""
    return _LOADED.setdefault(("memory", *key), {})


def remembered(known: dict, wanted: list, make) -> dict:
    """`known`, brought up to date for every entry of `wanted`; `make` maps a list of new entries to their values."""
    fresh = list({w for w in wanted if w not in known})
    if fresh:
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = list(set(wanted))
        known.update(zip(fresh, make(fresh)))
    return known
