"""Column functions that the operators share."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"


def season_of(ts: Column, turn: int = 10) -> Column:
    """The season of a day: its year, or the next one from the turning month on."""
    return (F.year(ts) + F.when(F.month(ts) >= turn, 1).otherwise(0)).cast("long")


def civil_date(ts: Column, zone: str = EASTERN) -> Column:
    """The civil date in a zone of a UTC time; the session's zone must be UTC."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def stamp(text: Column) -> Column:
    """A time from ISO text to the minute, or only to the day."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mmX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def day_range(day: str, zone: str = EASTERN) -> tuple[Column, Column]:
    """The UTC times at which a civil day begins and ends; constants, so that a filter on the raw time is pushed down."""
    begin = F.to_timestamp(F.lit(day))
    return F.to_utc_timestamp(begin, zone), F.to_utc_timestamp(F.to_timestamp(F.date_add(F.lit(day).cast("date"), 1)), zone)


def ratio(a: Column, b: Column, times: float = 1.0) -> Column:
    """a / b as a double, null where b is 0 or null."""
    return a.cast("double") * times / F.nullif(b.cast("double"), F.lit(0.0))


def blank_to_null(c: Column, blanks: tuple[str, ...] = ("", "-", "--")) -> Column:
    return F.when(~F.trim(c).isin(*blanks), F.trim(c))


def number(c: Column) -> Column:
    """Text as a double, null where it is blank or no number."""
    return blank_to_null(c).try_cast("double")


def two_parts(c: Column, sep: str = "-") -> tuple[Column, Column]:
    """``7-14`` as two integers; null where the text is not of that form."""
    at = rf"^\s*(\d+)\s*{sep}\s*(\d+)\s*$"
    return tuple(F.nullif(F.regexp_extract(c, at, i), F.lit("")).try_cast("long") for i in (1, 2))


def listed_sum(c: Column, positions: list[int]) -> Column:
    """Sum of chosen positions, from 1, of a comma list; null where none of them is reached."""
    parts = F.split(c, ",")
    picked = F.filter(F.array(*[F.try_element_at(parts, F.lit(p)).try_cast("long") for p in positions]), lambda x: x.isNotNull())
    return F.when(F.size(picked) > 0, F.aggregate(picked, F.lit(0).cast("long"), lambda a, x: a + x))


def letters(c: Column) -> Column:
    """The words of a name: runs of letters, in lower case."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda x: x != "")


@lru_cache
def _plain_letters() -> tuple[str, str]:
    """Lower-case letters of the Latin blocks that decompose to one letter and marks, and these letters."""
    out = {}
    for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(i) and chr(i).islower():
            out[chr(i)] = base
    return "".join(out), "".join(out.values())


def folded_name(c: Column) -> Column:
    """A name as it is matched: no accents (by decomposition, so that letters which do not decompose stay), hyphens as spaces, no generation suffix."""
    plain = F.regexp_replace(F.translate(F.lower(c), *_plain_letters()), r"\p{M}+", "")
    return F.regexp_replace(F.trim(F.regexp_replace(plain, r"[-\s]+", " ")), r" (jr\.?|sr\.?|ii|iii|iv|v)$", "")


def edit_budget(word: Column) -> Column:
    """How many edits a word of its length allows."""
    return F.when(F.length(word) <= 3, 0).when(F.length(word) <= 6, 1).otherwise(2)


def nth_weekday(day: Column, month: int, weekday: int, n: int) -> Column:
    """Whether a date is the n-th such weekday (1: Monday) of a month."""
    return (F.month(day) == month) & (F.weekday(day) + 1 == weekday) & F.dayofmonth(day).between(7 * n - 6, 7 * n)


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def possessions(attempts: Column, offensive: Column, turnovers: Column, free: Column) -> Column:
    """Plays that a side used, by the usual estimate."""
    return attempts - offensive + turnovers + F.lit(0.44) * free


def ratings(points: Column, allowed: Column, used: Column, games: Column) -> dict[str, Column]:
    """Pace, and what was scored and allowed in a hundred possessions, from season totals."""
    return {
        "pace": ratio(used, games), "offensive_rating": ratio(points, used, 100.0), "defensive_rating": ratio(allowed, used, 100.0), "net_rating": ratio(points - allowed, used, 100.0),
    }


def of_class(text: Column, some: tuple[str, ...] = (), none: tuple[str, ...] = (), equal: tuple[str, ...] = ()) -> Column:
    """Whether a type's text is one of ``equal``, or like one of ``some`` and none of ``none``, whatever its case; a null text is of no class."""
    like = F.lit(False)
    for p in some:
        like = like | text.ilike(p)
    for p in none:
        like = like & ~text.ilike(p)
    return F.coalesce(text.isin(*equal) | like if equal else like, F.lit(False))


def starts_word(c: Column, start: str) -> Column:
    """Whether a word of a name begins so."""
    return F.exists(letters(c), lambda w: F.startswith(w, F.lit(start.lower())))
