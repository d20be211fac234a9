from .attribution import conversion_probability, run_attribution_model, transition_matrix
from .conversion import derive_conversion_flag
from .keywords import keywords_high_circ_conversion
from .cascades import cascades, predecessors
from .centrality import SMALL, betweenness
from .entities import named_entities
from .network import capitalised_spans, components, cooccurrence_edges, degrees, eda_network, gazetteer, network_summary, network_view
from .paths import amplifier_lags, build_paths, first_movers, touches
from .quantiles import quantile
from .preprocess import dedup_first, null_profile, preprocess, preview, remove_empty_columns, remove_empty_rows
from .tables import bar_data, conversion_summary, count_by, eda_tables, overall_sentiment_counts, sentiment_by_topic, sources_by_avg_circ, sources_count_avg_circ, top_publications, top_tags, volume

__all__ = [
    "SMALL", "amplifier_lags", "bar_data", "betweenness", "build_paths", "cascades", "capitalised_spans", "components", "conversion_probability", "conversion_summary", "cooccurrence_edges", "count_by",
    "dedup_first", "degrees", "derive_conversion_flag", "eda_network", "eda_tables", "first_movers", "gazetteer", "keywords_high_circ_conversion", "network_summary", "network_view",
    "null_profile", "overall_sentiment_counts", "predecessors", "preprocess", "preview", "quantile", "remove_empty_columns", "remove_empty_rows", "run_attribution_model", "sentiment_by_topic",
    "sources_by_avg_circ", "sources_count_avg_circ", "top_publications", "top_tags", "touches", "transition_matrix", "volume",
]
