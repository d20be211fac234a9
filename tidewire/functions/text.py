"""Text expressions: cleaning, tags, sources, words. All total, null-safe Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .repair import foreign, plain, repair

#: What cleaning turns into a space. `[\\p{L}\\p{N}_]` is a word character of Unicode; Java's own and RE2's are ASCII's.
NOISE = r"http\S+|\S+@\S+|#[\p{L}\p{N}_]+|@[\p{L}\p{N}_]+"
#: The same matches: an address starts where its word does, so a long word is searched for one once, not from each of its characters.
_NOISE_JAVA = NOISE.replace(r"\S+@", r"(?<!\S)\S+@")
#: White space of Unicode, for Java's regular expressions.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"
#: The same characters.
WHITE = "".join(c for c in map(chr, range(0x3001)) if re.match(SPACE, c, re.ASCII))
#: Code points of pictographs, regional letters, and the joiners and selectors that belong to them.
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{2B55}\x{231A}\x{231B}\x{23E9}-\x{23FA}\x{FE0F}\x{200D}\x{20E3}]"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " "}
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff"}


def strip(c: Column) -> Column:
    """Without white space at both ends: each end is looked at once."""
    return F.btrim(c, F.lit(WHITE))


def let(value: Column, f) -> Column:
    """f(value), with value found once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _replaced(c: Column, pairs: Mapping[str, str]) -> Column:
    for wrong, right in sorted(pairs.items(), key=lambda x: -len(x[0])):
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def fix_text(c: Column) -> Column:
    """Repairs misread UTF-8, HTML entities in texts without tags, curly quotes, ligatures, line ends and control characters. Each repair first looks whether there is anything to do."""
    c = repair(c)
    c = let(c, lambda x: F.when(x.contains("&") & ~x.contains("<"), _replaced(_replaced(x, ENTITIES), {"&amp;": "&"})).otherwise(x))
    c = let(c, lambda x: F.when(~plain(x) & x.rlike("[‘-„ﬀ-ﬂ]"), _replaced(F.translate(x, "‘’‚“”„", "'''\"\"\""), LIGATURES)).otherwise(x))
    c = let(c, lambda x: F.when(x.rlike(r"[\x00-\x08\x0d-\x1b\x7f]"), F.regexp_replace(F.regexp_replace(x, "\r\n?", "\n"), r"[\x00-\x08\x0e-\x1b\x7f]", "")).otherwise(x))
    return c


def strip_emoji(c: Column) -> Column:
    return let(c, lambda x: F.when(~plain(x) & foreign(x).rlike(EMOJI), F.regexp_replace(x, EMOJI, "")).otherwise(x))


def _without_noise(c: Column) -> Column:
    """NOISE is a space. All of it has one of three texts, which are looked for first."""
    return let(c, lambda x: F.when(x.contains("http") | x.contains("@") | x.contains("#"), F.regexp_replace(x, _NOISE_JAVA, " ")).otherwise(x))


def _collapsed(c: Column) -> Column:
    """Runs of white space are one space. In ASCII the other white space turns into spaces first, so that single spaces, which are most, aren't replaced."""
    c = let(c, lambda x: F.when(plain(x), F.regexp_replace(x, r"[\t-\r\x1c-\x1f]+", " ")).otherwise(F.regexp_replace(x, f"{SPACE}+", " ")))
    return let(c, lambda x: F.when(x.contains("  "), F.regexp_replace(x, " {2,}", " ")).otherwise(x))


def clean_text(c: Column) -> Column:
    """Null is empty; repairs, drops emoji, turns links, addresses, tags and names into a space, then collapses white space."""
    fixed = strip_emoji(fix_text(F.coalesce(c.cast("string"), F.lit(""))))
    return strip(_collapsed(_without_noise(fixed)))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, " "), lambda w: w != ""))


def split_tags(c: Column) -> Column:
    """Comma-separated tags, stripped, empties dropped; order, case and repeats stay. Null has none."""
    return F.coalesce(F.filter(F.transform(F.split(c, ","), strip), lambda t: t != ""), F.array().cast("array<string>"))


def normalize_source(c: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Lower case, one space between words, no scheme, no leading www., no trailing slash; then the alias, if any."""
    name = F.lower(strip(F.regexp_replace(c, f"{SPACE}+", " ")))
    name = F.regexp_replace(F.regexp_replace(name, r"^(https?://)?(www\.)?", ""), "/+$", "")
    if not aliases:
        return name
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(known[name], name)


def tokens(c: Column) -> Column:
    """Lower-case runs of two letters, digits or underscores, or more."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
