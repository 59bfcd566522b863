"""Streaming entry points (the reference itself has no stream; see receipts.py)."""

from .receipts import score_receipt_stream  # noqa: F401
