"""Text and identifier expressions (JVM side, no Python per row)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.numeric import col_of, let


def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Latin letters whose compatibility decomposition is plain, by rule from Unicode data."""
    src, dst, longer = [], [], {}
    blocks = [range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0xFB00, 0xFB07)]
    for cp in (c for block in blocks for c in block):
        char = chr(cp)
        plain = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if plain == char:
            continue
        if len(plain) == 1:
            src.append(char)
            dst.append(plain)
        elif plain.isascii() and plain.isalpha():
            longer[char] = plain
    return "".join(src), "".join(dst), longer


_FROM, _TO, _LIGATURES = _decompositions()


# The same letters for names on the driver (headers, tokens); combining marks go.
_PLAIN = {**str.maketrans(_FROM, _TO), **{ord(k): v for k, v in _LIGATURES.items()}, **dict.fromkeys(range(0x300, 0x370))}


def plain_words(name: str, word: str) -> list[str]:
    """Parts of a header or token that match ``word``, accents off."""
    return re.findall(word, name.translate(_PLAIN))


def strip_accents(c) -> Column:
    """Drop combining marks and decompose accented Latin letters."""

    def expand(text: Column) -> Column:
        expanded = text
        for char, plain in _LIGATURES.items():
            expanded = F.replace(expanded, F.lit(char), F.lit(plain))
        return F.when(text.rlike(f"[{''.join(_LIGATURES)}]"), expanded).otherwise(text)

    return F.regexp_replace(let(F.translate(col_of(c), _FROM, _TO), expand), r"\p{Mn}+", "")


def fold(c) -> Column:
    """Accents off, lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"\s+", " "))


def _alnum(c, gap: str) -> Column:
    return F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", gap)


def slug(c) -> Column:
    """Identifier form of a name: ``José Serra`` -> ``jose_serra``."""
    return F.trim(_alnum(c, "_"), F.lit("_"))


def normalize_name(c) -> Column:
    """Name in space separated lower-case ASCII tokens."""
    return F.trim(_alnum(c, " "))


# Texts that stand for "no number".
NO_NUMBER = ("", "nan", "N/A", "–", "—", "-")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_percent(c) -> Column:
    """First number in the text; above one it is read as a percentage."""
    text = F.replace(_strip(col_of(c).cast("string")), F.lit(","), F.lit("."))
    number = F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(
        ~text.isin(*NO_NUMBER), F.when(number > 1.0, number / 100.0).otherwise(number)
    )


def parse_locale_number(c) -> Column:
    """Number with either decimal comma or thousands dots; unreadable becomes null."""
    kept = F.regexp_replace(col_of(c).cast("string"), "[^0-9,.-]", "")
    dots = F.length(kept) - F.length(F.replace(kept, F.lit("."), F.lit("")))
    plain = (
        F.when(kept.contains(",") & ~kept.contains("."), F.replace(kept, F.lit(","), F.lit(".")))
        .when(dots > 1, F.replace(kept, F.lit("."), F.lit("")))
        .otherwise(kept)
    )
    return plain.try_cast("double")


def parse_vote_count(c) -> Column:
    """Number of votes: groups of three digits after dots are thousands, as votes are whole numbers."""
    kept = F.regexp_replace(col_of(c).cast("string"), "[^0-9,.-]", "")
    grouped = kept.rlike(r"^\d{1,3}(\.\d{3})+$")
    return F.when(grouped, F.replace(kept, F.lit("."), F.lit("")).try_cast("double")).otherwise(parse_locale_number(c))


# Month names in the two languages of the published tables.
MONTHS_PT = (
    "janeiro", "fevereiro", "marco", "abril", "maio", "junho",
    "julho", "agosto", "setembro", "outubro", "novembro", "dezembro",
)
MONTHS_EN = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)


def _month_number(name: Column, months: tuple[str, ...]) -> Column:
    position = F.array_position(F.array(*[F.lit(m) for m in months]), name)
    return F.when(position > 0, position.cast("int"))


def _date_of(year: Column, month: Column, day: Column) -> Column:
    """Date or null; impossible days become null under ANSI rules as well."""
    return F.try_to_date(
        F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string")), "y-M-d"
    )


def parse_period_end(c, year) -> Column:
    """Last day of a fieldwork period; a missing year is the given one."""
    text = _strip(F.regexp_replace(col_of(c), "[–—]", "-"))
    folded = fold(text)
    year = col_of(year)
    numeric = F.coalesce(
        F.try_to_date(F.regexp_extract(text, r"^(\d{4}-\d{1,2}-\d{1,2})$", 1), "yyyy-M-d"),
        F.try_to_date(
            F.translate(F.regexp_extract(text, r"^(\d{1,2}[/-]\d{1,2}[/-]\d{4})$", 1), "-", "/"),
            "d/M/yyyy",
        ),
    )

    def worded(pattern: str, months: tuple[str, ...]) -> Column:
        stated = F.regexp_extract(folded, pattern, 3).try_cast("int")
        return _date_of(
            F.coalesce(stated, year),
            _month_number(F.regexp_extract(folded, pattern, 2), months),
            F.regexp_extract(folded, pattern, 1),
        )

    return F.coalesce(
        numeric,
        worded(r"(\d{1,2})\s+de\s+([a-z]+)(?:\s+de\s+(\d{4}))?", MONTHS_PT),
        worded(rf"(\d{{1,2}})\s+({'|'.join(MONTHS_EN)})(?:\s+(\d{{4}}))?", MONTHS_EN),
    )


def parse_sample_size(c) -> Column:
    """First run of digits with its separators removed."""
    run = F.regexp_extract(col_of(c).cast("string"), r"([\d,.]+)", 1)
    return F.regexp_replace(run, "[^0-9]", "").try_cast("int")


def poll_id(year, pollster, poll_date, table) -> Column:
    """Stable surrogate id of a published poll."""
    parts = [col_of(x).cast("string") for x in (year, pollster, poll_date, table)]
    return F.concat(
        F.lit("hist_"), parts[0], F.lit("_"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)
    )


def slate_hash(ids) -> Column:
    """Short hash of a set of candidate ids, whatever their order."""
    ordered = F.array_sort(F.array_distinct(col_of(ids)))
    return F.substring(F.sha1(F.array_join(ordered, "|")), 1, 12)


def payload_hash(*columns: str) -> Column:
    """SHA-256 of the row as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)
