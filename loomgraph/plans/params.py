"""Constants of the graph's semantics."""

from __future__ import annotations

# Fixed values.
ALPHA = 0.85
LAMBDA_J, LAMBDA_TS, LAMBDA_SP, MAX_NEW_TS = 0.3, 0.3, 0.3, 100
TIER_WEIGHT = {"S": 1.0, "A": 0.7, "B": 0.5, "C": 0.3, "": 0.2}
CONFIDENCE_WEIGHT = {"high": 1.0, "medium": 0.6, "low": 0.3}
NEWS_WEIGHT, JD_WEIGHT = 0.4, 1.0
PAPER_HALF_LIFE, NEWS_HALF_LIFE, JD_HALF_LIFE = 730, 180, 365
UNKNOWN_DECAY, MIN_STRENGTH = 0.5, 0.05
PARTICIPATE, PROMOTE, PROMOTE_JOBS, PROMOTE_DOCS, PROMOTE_DOCS_JOBS = 0.15, 0.25, 0.30, 2, 3
SAMPLE_CAP, SAMPLE_FLOOR = 10_000, 30
HAMMING_MAX, JACCARD_MIN, NGRAM, DEDUP_MIN_CHARS = 6, 0.95, 3, 80
