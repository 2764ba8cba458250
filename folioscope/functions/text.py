"""Text folding, identifiers and dates as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = r"\s+"
#: White space of Unicode, non-breaking kinds included.
WIDE_SPACES = r"[\s\x1c-\x1f\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
#: Curly quotes and dashes, and what they fold to; the soft hyphen goes.
FOLD_FROM = "‘’‚‛“”„–—−\u00ad"
FOLD_TO = "''''\"\"\"---"
#: Fixed form: a footnote marker set against the word it belongs to.
FOOTNOTE = r"\[\^[^\]\s]{1,16}\]"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(collapsed(text), "UTF-8"), 256)


def quote_folded(text: Column) -> Column:
    """Lower case, straight quotes and dashes, no footnote markers, one space: what a quotation is compared by.

    Compatibility forms stay as they are; see ``nfkc_folded``.
    """
    bare = F.regexp_replace(F.translate(text, FOLD_FROM, FOLD_TO), FOOTNOTE, "")
    return F.trim(F.regexp_replace(F.lower(bare), WIDE_SPACES, " "))


@F.pandas_udf(T.StringType())
def nfkc_folded(text: pd.Series) -> pd.Series:
    """Compatibility form and full case folding, which Spark has no function for."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


#: Letters besides a-z and 0-9 that slugs keep, and those that block ids keep.
SLUG_LETTERS, BLOCK_LETTERS = "æøåäöüïáčđŋšŧž", "æøåäöü"


def _dashed(text: Column, letters: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), f"[^a-z0-9{letters}]+", "-"), "^-+|-+$", "")


def slug(text: Column, most_bytes: int = 200) -> Column:
    """Runs of anything but letters and digits become one hyphen; beyond the cap in bytes, cut at the last hyphen within it, if any."""
    dashed = _dashed(text, SLUG_LETTERS)
    # a character cut in half goes
    prefix = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(dashed, "UTF-8"), 1, most_bytes).cast("string")), "\uFFFD+$", "")
    return F.when(F.octet_length(dashed) <= most_bytes, dashed).otherwise(F.regexp_replace(F.regexp_replace(prefix, "-[^-]*$", ""), "-+$", ""))


def document_slug(short_title: Column, title: Column, doc_id: Column) -> Column:
    """The slug of the short title, else of the title without what stands in brackets, else of the id: the first that is not empty."""
    bare = F.regexp_replace(title, r"[\[(].*?[\])]", "")
    return F.coalesce(*(F.nullif(slug(part), F.lit("")) for part in (short_title, bare, doc_id)), doc_id)


def block_id(heading: Column, most: int = 60) -> Column:
    """A hash sign and the heading's slug; empty where no letter or digit is left."""
    held = F.regexp_replace(F.substring(_dashed(heading, BLOCK_LETTERS), 1, most), "-+$", "")
    return F.when(held == "", "").otherwise(F.concat(F.lit("#"), held))


def section_id(written: Column) -> Column:
    """Canonical form of a section label: no sign, dot or blanks, lower case where the whole is an id."""
    bare = F.regexp_replace(F.regexp_replace(written, r"^[§\s]+", ""), r"[.\s]+$", "")
    whole = bare.rlike(r"^[0-9]+(\s*[a-zA-Z])?(-[0-9]+(\s*[a-zA-Z])?)*$")
    return F.when(whole, F.lower(F.regexp_replace(bare, SPACES, ""))).otherwise(bare)


def natural_key(identifier: Column) -> Column:
    """Sort key: runs of digits by number before runs of letters."""
    parts = F.regexp_extract_all(identifier, F.lit("([0-9]+|[^0-9-]+)"), F.lit(1))
    return F.transform(
        parts,
        lambda p: F.struct(
            (~p.rlike("^[0-9]+$")).cast("int").alias("is_text"),
            F.coalesce(p.try_cast("bigint"), F.lit(0)).alias("number"),
            p.alias("text"),
        ),
    )


#: Month names of written dates, in order.
MONTHS = ("januar", "februar", "mars", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "desember")


def written_date(text: Column) -> Column:
    """The first "D. month YYYY" that is a real calendar date."""
    form = rf"(\d{{1,2}})\.\s*({'|'.join(MONTHS)})\s+(\d{{4}})"
    day, month, year = (F.regexp_extract(F.lower(text), form, k) for k in (1, 2, 3))
    number = F.array_position(F.array(*map(F.lit, MONTHS)), month)
    return F.try_to_date(F.concat_ws("-", year, number.cast("string"), day), "yyyy-M-d")


def act_reference(text: Column) -> Column:
    """The first act citation as ``lov/YYYY-MM-DD[-N]``."""
    date = written_date(text)
    number = F.regexp_extract(text, r"(?i)\bnr\.?\s*(\d+)", 1)
    return F.when(
        date.isNotNull(),
        F.concat(F.lit("lov/"), F.date_format(date, "yyyy-MM-dd"), F.when(number != "", F.concat(F.lit("-"), number)).otherwise("")),
    )


def identity_number(number: Column) -> Column:
    """Eleven digits that begin with a possible day and month, offsets allowed, and have both weighted mod-11 check digits right."""
    weights = ((3, 7, 6, 1, 8, 9, 4, 5, 2, 1), (5, 4, 3, 2, 7, 6, 5, 4, 3, 2, 1))  # fixed values
    digits = F.transform(F.split(number, ""), lambda d: d.try_cast("int"))

    def holds(row: tuple[int, ...]) -> Column:
        products = F.zip_with(F.slice(digits, 1, len(row)), F.array(*map(F.lit, row)), lambda d, w: d * w)
        return F.pmod(F.aggregate(products, F.lit(0), lambda a, x: a + x), F.lit(11)) == 0

    # fixed values: what is added to the day of temporary numbers, and to the month of auxiliary and synthetic ones
    day, month = F.substring(number, 1, 2).try_cast("int"), F.substring(number, 3, 2).try_cast("int")
    possible = (F.when(day > 40, day - 40).otherwise(day).between(1, 31)) & (
        F.when(month > 80, month - 80).when(month > 40, month - 40).otherwise(month).between(1, 12)
    )
    return number.rlike("^[0-9]{11}$") & possible & holds(weights[0]) & holds(weights[1])
