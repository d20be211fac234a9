"""Dates written freely in several languages: one scan into tokens, whose kinds in a row are the grammar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

#: Names of months, January first, and of days of the week, without accents.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "fr": "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre",
    "de": "januar februar marz april mai juni juli august september oktober november dezember",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "pt": "janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro",
}
DAYS = {
    "en": "monday tuesday wednesday thursday friday saturday sunday",
    "fr": "lundi mardi mercredi jeudi vendredi samedi dimanche",
    "de": "montag dienstag mittwoch donnerstag freitag samstag sonntag",
    "es": "lunes martes miercoles jueves viernes sabado domingo",
    "it": "lunedi martedi mercoledi giovedi venerdi sabato domenica",
    "pt": "segunda terca quarta quinta sexta sabado domingo",
}
#: What may stand between: articles, ordinals, marks of zones.
BETWEEN = "the of de del do da di le el il der den am um at a las alle h uhr feira st nd rd th er t z utc gmt / - + º ª ° m"
_ACCENTS = ("áàâãäåçéèêëíìîïñóòôõöúùûü", "aaaaaaceeeeiiiinooooouuuu")
_TOKEN = r"(\d+(?::\d+)+(?:[.,]\d+)?|\d+|[a-z]+|[^\s\da-z.,])"
#: Texts longer than this are no dates.
LONGEST = 64


def _prefixes(name: str, least: int = 3) -> set[str]:
    return {name[:k] for k in range(min(least, len(name)), len(name) + 1)}


def names(languages: tuple[str, ...]) -> tuple[list[set[str]], set[str]]:
    """For each month its names and their beginnings of three letters or more, unless another month's begin so too; and the same of weekdays, unless a month has it."""
    whole = [{MONTHS[k].split()[i] for k in languages} for i in range(12)]
    begin = [set().union(*map(_prefixes, w)) for w in whole]
    months = [{x for x in begin[i] if x in whole[i] or not any(x in begin[j] for j in range(12) if j != i)} for i in range(12)]
    days = set().union(*(_prefixes(d, 2) for k in languages for d in DAYS[k].split()))
    return months, days - set().union(*begin) - {*BETWEEN.split()}


def _kinds(text: Column, languages: tuple[str, ...]) -> Column:
    """Tokens that count: numbers as they are, months as m01 to m12, times of day as T, am and pm as P, anything unknown as ?; in one string."""
    months, days = names(languages)

    def kind(x: Column) -> Column:
        out = F.when(x.rlike(r"^\d+$"), x).when(x.contains(":"), "T").when(x.isin("am", "pm"), "P").when(x.isin(BETWEEN.split()), "")
        for i, m in enumerate(months, 1):
            out = out.when(x.isin(sorted(m)), f"m{i:02d}")
        return out.when(x.isin(sorted(days)), "").otherwise("?")

    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1)), kind), lambda x: x != "")
    # The time of day goes: a clock, or an hour with am or pm.
    return F.regexp_replace(F.array_join(found, " "), r"(?<= )(?:T P|T T|T|\d{1,2} P)$", "")


def parse_date(c: Column, day_first: bool | None = None, as_of: Column | None = None, languages: tuple[str, ...] = tuple(MONTHS)) -> Column:
    """Date of a text that says day, month and year in any of the languages, with or without weekday and time of day; else null.

    2025-07-04, 20250704, 4 July 2025, Friday the 4th of July 2025 3:05 pm, Jul 4, 2025, 4. März 2025, le 1er août 2025, 4 de julio de 2025.
    Of two numbers before a year the day is the one over 12; else the first if day_first, the second if not, and where that is None
    the second only if they are parted by slashes. Two digits of a year are 1969 to 2068. With as_of also "today", "yesterday",
    "N days ago" and "N weeks ago". The local calendar date counts."""
    low = F.translate(F.lower(strip(c)), *_ACCENTS)
    low = F.when(F.length(low) <= LONGEST, low)
    slashes = c.contains("/")
    month_first = slashes if day_first is None else F.lit(not day_first)
    kinds = let(_kinds(low, languages), lambda k: F.struct(F.split(F.trim(k), " ").alias("t"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(k), r"\bm\d\d\b", "M"), r"\b\d{4}\b", "Y"), r"\b\d{1,2}\b", "n").alias("shape")))

    def dated(k: Column) -> Column:
        t, shape = k["t"], k["shape"]
        at = lambda i: F.get(t, F.lit(i))
        month = lambda i: F.substr(at(i), F.lit(2))
        number = lambda i: F.when(F.length(at(i)) <= 2, at(i)).try_cast("int")
        second = (number(1) <= 12) & ((number(0) > 12) | ~month_first)
        text = (
            F.when(shape.isin("Y n n"), F.array(at(0), at(1), at(2)))
            .when(shape == "Y M n", F.array(at(0), month(1), at(2)))
            .when(shape.isin("n M Y", "n M n"), F.array(at(2), month(1), at(0)))
            .when(shape.isin("M n Y", "M n n"), F.array(at(2), month(0), at(1)))
            .when(shape.isin("n n Y", "n n n") & second, F.array(at(2), at(1), at(0)))
            .when(shape.isin("n n Y", "n n n"), F.array(at(2), at(0), at(1)))
            .when(at(0).rlike(r"^\d{8}$") & (F.size(t) == 1), F.array(F.substring(at(0), 1, 4), F.substring(at(0), 5, 2), F.substring(at(0), 7, 2)))
        )
        year = F.get(text, F.lit(0))
        year = F.when(F.length(year) == 2, F.concat(F.when(year < "69", "20").otherwise("19"), year)).otherwise(year)
        return F.when(F.length(year) == 4, F.concat_ws("-", year, F.get(text, F.lit(1)), F.get(text, F.lit(2)))).try_cast("date")

    out = let(kinds, dated)
    if as_of is None:
        return out
    ago = F.regexp_extract(low, r"^(\d{1,4}) (day|week)s? ago$", 1)
    days = F.when(low == "today", 0).when(low == "yesterday", 1).when(ago != "", ago.try_cast("int") * F.when(low.contains("week"), 7).otherwise(1))
    return F.coalesce(out, F.date_sub(as_of.cast("date"), days))
