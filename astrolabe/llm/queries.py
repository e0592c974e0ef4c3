"""Imports every operator module, for the side effect of registering its query."""

from __future__ import annotations

from astrolabe.llm import ORACLES, QUERIES  # noqa: F401
from astrolabe.llm import ann, exact_dedup, filter_audit, language_id, licenses, mixing, quality, sentencepiece_bpe, simhash, spelling, substring_dedup, url_filter, warc  # noqa: F401
