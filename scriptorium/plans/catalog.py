"""The named queries and their DuckDB counterparts."""

from __future__ import annotations

from . import agreement, annotated, evaluation, files, learning, relational, scoring, selecting, streams, texts, vector  # noqa: F401
from .base import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "agr7_pairwise_kappa"
