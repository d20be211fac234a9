from .articles import CORE, NULL_TOKENS, conform, from_tables, read_articles, write_tables
from .figures import Figure, network_rows, save_figures

__all__ = ["CORE", "Figure", "NULL_TOKENS", "conform", "from_tables", "network_rows", "read_articles", "save_figures", "write_tables"]
