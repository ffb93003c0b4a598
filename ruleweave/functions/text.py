"""Text functions: quote matching, citations, figures, descriptions, date wording, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleweave.functions.logic import let

# Characters that count as one another, or as nothing, when quotes are matched.
SINGLE = "‘’‚‛′"
DOUBLE = "“”„‟″"
DASHES = "‐‑‒–—―−"
GONE = "§­​‌‍⁠"
SPACES = r"[\s   -     　﻿]+"
SHORTEST_QUOTE = 20
# Number words of figures.
NUMBER_WORDS = {"one": 1, "first": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}
# The code of each category of law in rule ids.
CATEGORY_CODES = {
    "rent_increase_limits": "RENT", "just_cause_eviction": "EVICT", "security_deposits": "DEP",
    "application_screening_fees": "FEE", "screening_restrictions": "SCREEN", "algorithmic_rent_setting": "ALG",
}


def fold_chars(text: Column) -> Column:
    """Curly quotes and all dashes made plain; section signs, soft hyphens and zero-width characters removed."""
    return F.translate(text, SINGLE + DOUBLE + DASHES + GONE, "'" * len(SINGLE) + '"' * len(DOUBLE) + "-" * len(DASHES))


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalized(text: Column) -> Column:
    """Folded, with runs of white space as one space."""
    return squash(fold_chars(text))


def quote_pattern(quote: Column) -> Column:
    """A pattern that finds the literal text a quote stands for, whatever its quotes, dashes and spaces look like."""
    gone = f"[{GONE}]*"
    escaped = F.regexp_replace(normalized(quote), r"([\\.\[\]{}()*+?^$|#&~])", r"\\$1")
    chars = F.regexp_extract_all(escaped, F.lit(r"(\\?(?s:.))"), 1)
    shaped = F.transform(
        chars,
        lambda c: F.when(c == " ", f"{SPACES[:-1]}(?:{SPACES[:-1]}|[{GONE}])*").when(c == "'", f"['{SINGLE}]").when(c == '"', f'["{DOUBLE}]').when(c == "-", f"[-{DASHES}]").otherwise(c),
    )
    return F.array_join(shaped, gone)


def verify_quote(text: Column, quote: Column) -> Column:
    """struct(method, span_start, quoted_span): exact, normalized or failed; offsets are code points from 0."""
    said = F.trim(quote)
    at = F.instr(text, said) - 1
    pattern = quote_pattern(said)
    loose = F.regexp_substr(text, pattern)
    long_enough = F.length(said) >= SHORTEST_QUOTE
    exact = F.struct(F.lit("exact").alias("method"), at.alias("span_start"), said.alias("quoted_span"))
    near = F.struct(F.lit("normalized").alias("method"), (F.instr(text, loose) - 1).alias("span_start"), loose.alias("quoted_span"))
    failed = F.struct(F.lit("failed").alias("method"), F.lit(None).cast("int").alias("span_start"), F.lit(None).cast("string").alias("quoted_span"))
    return F.when(long_enough & (at >= 0), exact).when(long_enough & (F.length(normalized(said)) >= SHORTEST_QUOTE) & (F.length(loose) >= SHORTEST_QUOTE), near).otherwise(failed)


def contains_text(whole: Column, part: Column) -> Column:
    """Containment after quotes, dashes and spaces are made plain; an empty part is in nothing."""
    plain = lambda c: squash(F.translate(c, "‘’′“”″" + DASHES, "'''\"\"\"" + "-" * len(DASHES)))
    return F.contains(plain(whole), plain(part)) & (F.length(plain(part)) > 0)


def parse_header(text: Column) -> Column:
    """struct(source_url, retrieved_at) from the header lines of a document; null where missing."""
    head = F.substring(text, 1, 2000)
    found = lambda p: F.nullif(F.regexp_extract(head, p, 1), F.lit(""))
    return F.struct(found(r"(?m)^SOURCE:[ \t]*(\S+)[ \t]*$").alias("source_url"), F.trim(found(r"(?m)^RETRIEVED:[ \t]*(\S.*)$")).alias("retrieved_at"))


def normalize_citation(citation: Column) -> Column:
    """Lower case, without section signs and the words section(s) and sec., blanks as one."""
    plain = F.regexp_replace(F.lower(citation), "§", " ")
    return squash(F.regexp_replace(plain, r"\b(?:sections?|sec)\b\.?", " "))


def category_code(category: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in CATEGORY_CODES.items() for x in pair]), category)


def team_rule_id(jurisdiction: Column, category: Column, citation: Column) -> Column:
    """State, slugged city, category code and six hex digits of jurisdiction, category and citation."""
    name = F.upper(F.trim(F.regexp_extract(jurisdiction, r"^([^,]*)", 1)))
    city = F.when(F.contains(jurisdiction, F.lit(",")), F.regexp_replace(F.regexp_replace(name, r"[^A-Z0-9]+", "-"), "^-+|-+$", ""))
    state = F.upper(F.trim(F.regexp_extract(jurisdiction, r"([^,]*)$", 1)))
    digest = F.sha2(F.concat_ws("|", jurisdiction, category, normalize_citation(citation)), 256)
    return F.concat_ws("-", state, city, category_code(category), F.substring(digest, 1, 6))


def citation_in_source(citation: Column, text: Column) -> Column:
    """Whether every section token of the citation occurs in the text; false without any.

    A token begins with a digit that follows neither a letter, a digit nor an opening parenthesis, and keeps its letters.
    """
    dashed = lambda c: F.translate(c, DASHES, "-" * len(DASHES))
    tokens = F.regexp_extract_all(dashed(citation), F.lit(r"(?<![\w(])(\d[0-9A-Za-z]*(?:[.:-][0-9A-Za-z]+)*)"), 1)
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(dashed(text), t))


def fold_quantity(text: Column) -> Column:
    """Lower case, plain apostrophes, dashes as spaces."""
    return squash(F.translate(F.lower(text), "‘’′-" + DASHES, "'''" + " " * (1 + len(DASHES))))


def _number(word: Column) -> Column:
    named = F.create_map(*[x for w, n in NUMBER_WORDS.items() for x in (F.lit(w), F.lit(float(n)))])
    return F.coalesce(F.try_element_at(named, word), word.try_cast("double"))


def parse_months(text: Column) -> Column:
    """Distinct figures in months of rent; each wording is taken out of the text before the next is looked for.

    The unit phrase "times one month's rent" leaves two blanks behind a figure, so a plain "three times one month's
    rent" states no figure, while "one and a half times one month's rent" does.
    """
    n = r"(\d+(?:\.\d+)?|" + "|".join(NUMBER_WORDS) + ")"
    # The wordings of figures, in the order they are taken out.
    steps = [
        (rf"\b{n} and (?:one|a) half\b", lambda m: _number(m) + 0.5),
        (r"\b(\d+) 1/2\b", lambda m: _number(m) + 0.5),
        (r"\b(one half|half (?:of )?(?:a|one) month)\b", lambda m: F.lit(0.5)),
        (r"\b(twice|double)\b", lambda m: F.lit(2.0)),
        (rf"\b{n} (?:times|months?\b)", _number),
    ]
    rest = F.regexp_replace(fold_quantity(text), r"\btimes (?:the )?(?:one|a|1) month(?:'s|s')?(?: rent)?", " times ")

    def taken(rest: Column, at: int = 0) -> Column:
        """Figures of the steps from one on; each step's text is made once a row."""
        pattern, value = steps[at]
        found = lambda t: F.transform(F.regexp_extract_all(t, F.lit(pattern), 1), value)
        return let(rest, lambda t: found(t) if at == len(steps) - 1 else F.concat(found(t), taken(F.regexp_replace(t, pattern, " "), at + 1)))

    return F.array_sort(F.array_distinct(taken(rest)))


def parse_dollars(text: Column) -> Column:
    """Distinct dollar figures, signed or followed by the word dollars."""
    plain = F.regexp_replace(text, r"\s+", " ")
    # How a figure is written.
    signed = F.regexp_extract_all(plain, F.lit(r"\$\s?(\d[\d,]*(?:\.\d+)?)"), 1)
    worded = F.regexp_extract_all(plain, F.lit(r"(?i)\b(\d[\d,]*(?:\.\d+)?)\s+dollars\b"), 1)
    return F.array_sort(F.array_distinct(F.transform(F.concat(signed, worded), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))))


def single(figures: Column) -> Column:
    """The one figure; null if there are none or several."""
    return let(figures, lambda f: F.when(F.size(f) == 1, F.get(f, F.lit(0))))


def is_jurisdiction(text: Column) -> Column:
    return text.rlike(r"^([^,]+, )?[A-Z]{2}$")


def safe_href(url: Column) -> Column:
    return F.when(url.rlike("(?i)^https?://"), url)


# Named entities that are decoded.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "sect": "§", "mdash": "—", "ndash": "–", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“"}


def decode_entities(text: Column) -> Column:
    """Named and numeric character references decoded once; unknown names stay as they are."""
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def decoded(part: Column, i: Column) -> Column:
        name = F.lower(F.regexp_extract(part, r"^(#x?[0-9A-Fa-f]+|[A-Za-z]+);", 1))
        number = F.when(name.rlike("^#x[0-9a-f]+$"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.rlike("^#[0-9]+$"), F.substring(name, 2, 8)).cast("long")
        point = F.when(number.between(0, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        char = F.coalesce(point, F.try_element_at(named, name))
        rest = F.substr(part, F.length(name) + 2)
        return F.when(i == 0, part).when(char.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(char, rest))

    return F.array_join(F.transform(F.split(text, "&"), decoded), "")


def html_to_text(html: Column) -> Column:
    """Visible text of a page: hidden blocks dropped, ends of blocks as newlines, tags as blanks, entities decoded, blanks tidied."""
    # Elements whose content is hidden, and tags that end a line.
    text = F.regexp_replace(html, r"(?i)<(script|style|noscript|svg|head)\b[\s\S]*?</\1>", " ")
    text = F.regexp_replace(text, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/section|/article)\b[^>]*>", "\n")
    return tidy(decode_entities(F.regexp_replace(text, r"<[^>]+>", " ")))


def tidy(text: Column) -> Column:
    """Runs of blanks as one, lines trimmed, three or more newlines as two, the whole trimmed."""
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\u00a0]+", " "), r"[ \r\f\x0B]*\n[ \r\f\x0B]*", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^[\s\ufeff]+|[\s\ufeff]+$", "")


def docx_to_text(xml: Column) -> Column:
    """Text of a word-processing document's XML, a line a paragraph."""
    text = F.regexp_replace(F.regexp_replace(xml, r"<w:tab\b[^>]*/>", "\t"), r"<w:br\b[^>]*/>|</w:p>", "\n")
    return tidy(decode_entities(F.regexp_replace(text, r"<[^>]+>", "")))


def unit_bounds(description: Column) -> Column:
    """struct(units_min, units_max) that a use description states outright; null where it states none or several."""
    # The wordings of unit counts, the first that occurs decides; a bare figure counts before a U alone.
    between, over = r"(?i)(\d+)\s*(?:-|to)\s*(\d+)\s*-?\s*units?\b", r"(?i)>\s*(\d+)\s*-?\s*units?\b"
    plus, more = r"(?i)(\d+)\s*\+\s*units?\b", r"(?i)(\d+)\s*units?\s+or\s+more"
    worded = r"(?i)\b(two|three|four|five|six|seven|eight|nine|ten)\s+or\s+more\b"
    alone = r"(?<![\d.])(\d+)\s?U(?![A-Za-z]*NIT)(?=[^A-Za-z]|[A-Z]?$|G\b)"
    said = F.trim(description)
    first = lambda p, i=1: F.nullif(F.regexp_extract(said, p, i), F.lit(""))
    bounds = lambda a, b: F.struct(a.cast("int").alias("units_min"), b.cast("int").alias("units_max"))
    open_end = F.lit(None)
    single_figures = F.regexp_extract_all(said, F.lit(alone), 1)
    number = F.create_map(*[F.lit(x) for w, n in NUMBER_WORDS.items() for x in (w, n)])
    return (
        F.when(first(between).isNotNull(), bounds(first(between), first(between, 2)))
        .when(first(over).isNotNull(), bounds(first(over).cast("int") + 1, open_end))
        .when(first(plus).isNotNull(), bounds(first(plus), open_end))
        .when(first(more).isNotNull(), bounds(first(more), open_end))
        .when(first(worded).isNotNull(), bounds(F.try_element_at(number, F.lower(first(worded))), open_end))
        .when(F.size(single_figures) == 1, bounds(F.get(single_figures, F.lit(0)), F.get(single_figures, F.lit(0))))
    )


def text_filter(columns: list[Column], query: str) -> Column:
    """Case-insensitive containment of a query in the joined columns."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lower(F.trim(F.lit(query))))
