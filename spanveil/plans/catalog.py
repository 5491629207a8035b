"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from . import q_chunk, q_detect, q_explain, q_redact, q_reports, q_review, q_sources, q_stream  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
