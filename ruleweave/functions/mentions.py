"""How a document words a date: as a statement, in a note of an amendment or version, or as the start of a period."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleweave.functions.logic import let

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
# Wordings around a date that make it no plain statement.
RANGE_AFTER = r"(?i)^\s*(?:through|thru|to|until|[-–—])\s*(?:the\s+)?(?:[A-Z][a-z]+\.?\s+\d{1,2},?\s+\d{4}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"
AMENDED_BEFORE = r"(?i)\bamended\s+by\b|\brepealed\b[^\n]{0,60}\badded\s+by\b|\bas\s+amended\b|\btext\b[^\n.]{0,60}\beffective\b"
CURRENT_VERSION = r"(?i)\[\s*text\s+of\s+(?:the\s+)?section\s+as\s+amended\s+by\b[^\]]*$"
#: Characters looked at before and after a mention.
BEFORE, AFTER = 400, 60
#: Characters of the shortest mention, as in 1/1/26.
SHORTEST = 6


def date_pattern(iso: Column) -> Column:
    """A pattern of the ways a full date is commonly written; null for a partial one."""
    year, month, day = F.substring(iso, 1, 4), F.substring(iso, 6, 2).try_cast("int"), F.substring(iso, 9, 2).try_cast("int").cast("string")
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.greatest(F.lit(1), F.least(F.lit(12), month)))
    named = F.concat(F.lit("(?:"), name, F.lit("|"), F.substring(name, 1, 3), F.lit(r"\.?)"))
    number = month.cast("string")
    # Month and day in words, day and month in words, figures, and ISO.
    ordinal = r"(?:st|nd|rd|th)?"
    ways = [
        F.concat(named, F.lit(r"\s+0?"), day, F.lit(ordinal + r",?\s+"), year),
        F.concat(F.lit("0?"), day, F.lit(ordinal + r"\s+(?:day\s+of\s+)?"), named, F.lit(r",?\s+"), year),
        F.concat(F.lit(r"(?<![\d/-])0?"), number, F.lit("[/-]0?"), day, F.lit("[/-](?:"), year, F.lit("|"), F.substring(year, 3, 2), F.lit(r")(?![\d/-])")),
        iso,
    ]
    return F.when(iso.rlike(r"^\d{4}-(0[1-9]|1[0-2])-\d{2}$"), F.concat(F.lit("(?i)(?:"), F.concat_ws("|", *ways), F.lit(")")))


def date_context(text: Column, iso: Column) -> Column:
    """stated, version_note, amendment_note, period_start, not_found or partial.

    The text is cut at its mentions of the date; what stands before and after each is put together from the cuts, no
    further than it is looked at. A null text holds no mention.
    """
    return let(date_pattern(iso), lambda pattern: _worded(F.coalesce(text, F.lit("")), pattern))


def _worded(body: Column, pattern: Column) -> Column:
    """The context of a pattern's mentions. The text is searched twice, for mentions and for what is between them, however many there are."""
    cuts = F.struct(F.regexp_extract_all(body, pattern, F.lit(0)).alias("hits"), F.split(body, pattern).alias("gaps"))
    # most texts hold no mention, and need no cuts
    return F.when(pattern.isNull(), "partial").when(~F.rlike(body, pattern), "not_found").otherwise(let(cuts, lambda c: let(_kinds(c["hits"], c["gaps"]), _context)))


def _kinds(hits: Column, gaps: Column) -> Column:
    """How each mention is worded."""
    back_span, ahead_span = BEFORE // SHORTEST + 1, AFTER // SHORTEST + 1  # as many cuts as can stand in what is looked at

    def around(i: Column) -> Column:
        first = F.greatest(F.lit(0), i - back_span)
        back = F.concat(F.flatten(F.transform(F.sequence(first, i), lambda k: F.when(k < i, F.array(F.get(gaps, k), F.get(hits, k))).otherwise(F.array(F.get(gaps, k))))))
        ahead = F.flatten(F.transform(F.sequence(i + 1, i + ahead_span), lambda k: F.array(F.get(gaps, k), F.get(hits, k))))
        return F.struct(F.right(F.array_join(back, ""), F.lit(BEFORE)).alias("before"), F.left(F.array_join(ahead, ""), F.lit(AFTER)).alias("after"))

    def kind(near: Column) -> Column:
        bracket = F.regexp_substr(near["before"], F.lit(r"(?s)\[[^\[]*$"))
        line = F.regexp_extract(near["before"], r"([^\n]*)$", 1)
        noted = F.coalesce(bracket.rlike(CURRENT_VERSION), F.lit(False))
        return F.when(noted, "version").when(line.rlike(AMENDED_BEFORE), "amendment").when(near["after"].rlike(RANGE_AFTER), "period").otherwise("plain")

    return F.transform(hits, lambda _, i: let(around(i), kind))


def _context(kinds: Column) -> Column:
    n = lambda name: F.size(F.filter(kinds, lambda k: k == name))
    notes = n("version") + n("amendment")
    return F.when(n("plain") > 0, "stated").when((n("version") > 0) & (notes >= n("period")), "version_note").when(notes >= n("period"), "amendment_note").otherwise("period_start")
