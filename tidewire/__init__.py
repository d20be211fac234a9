"""Influence analytics on Spark: who starts a story, who carries it on, and what comes of it."""

from .operators import build_paths, derive_conversion_flag, eda_network, eda_tables, keywords_high_circ_conversion, network_view, preprocess, run_attribution_model
from .functions import clean_text, normalize_source
from .session import session
from .sources import read_articles

__all__ = ["build_paths", "clean_text", "derive_conversion_flag", "eda_network", "eda_tables", "keywords_high_circ_conversion", "network_view", "normalize_source", "preprocess", "read_articles", "run_attribution_model", "session"]
