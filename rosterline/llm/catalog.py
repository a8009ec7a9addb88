"""Queries and oracles of the subpackage."""

from rosterline.llm import (  # noqa: F401
    alignment, edit_embedding, licenses, line_dedup, merkle, mixing, oracles, packing, pattern_packing, quality, secrets, sharding, simhash, toxicity,
)
from rosterline.llm.common import ORACLES, QUERIES  # noqa: F401
