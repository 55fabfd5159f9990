"""Imports every module that registers queries."""

from . import (  # noqa: F401
    bpe,
    chat,
    contamination,
    licenses,
    lines,
    manifest,
    near_dedup,
    pii,
    quality,
    repeats,
    sharding,
    spelling,
    toxicity,
)
