from .dates import parse_date
from .repair import repair
from .text import clean_text, fix_text, normalize_source, split_tags, strip, strip_emoji, tokens, word_count
from .values import overall_sentiment, sentiment_bin, sentiment_score, to_number, week_start, month_start

__all__ = ["clean_text", "fix_text", "month_start", "normalize_source", "overall_sentiment", "parse_date", "repair", "sentiment_bin", "sentiment_score", "split_tags", "strip", "strip_emoji", "to_number", "tokens", "week_start", "word_count"]
