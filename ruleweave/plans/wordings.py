"""Made-up wordings chosen by a row's key, as a column and as DuckDB SQL, so that text queries take their inputs from tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CITATIONS = ["Sec. {a}.{b}", "Civ. Code § 19{a}.{b}", "Sections {a}A.03 and {b}(c)(2)", "Secs. {a}–{b}", "no number", "§{a}:{b}-1", "Section {b}(a)(1) , sec {a}"]
SOURCES = ["as in 19{a}.{b} and {a}A.03", "see {b}A.03 and 12(b), {a}.{b}", "rules {a}-{b} and {a}:{b}-1 of {b}(a)", "nothing"]
PLACES = ["CA", "San Jose, CA", "St. Paul, MN", "NJ", "New York City, NY", "--Odd  Name--, wa"]
CATEGORIES = ["rent_increase_limits", "just_cause_eviction", "security_deposits", "application_screening_fees", "screening_restrictions", "algorithmic_rent_setting"]
MONTHS = [
    "one month's rent", "{a} and a half months rent", "{a} months", "{a} 1/2 months", "twice the monthly rent", "three times one month's rent", "{a} months or {b} months",
    "no figure", "half of a month", "one half of it", "two and one-half times one month’s rent", "double rent, two times", "eleven month’s rent — {b} months", "first month",
]
DOLLARS = ["${a}", "${a},250.50 or {b} dollars", "{a} dollars and ${a}", "none", "US{a} dollars", "{a}-dollars", "{a} dollarsworth", "$ {a}  and {a}\tDOLLARS", "{a}.{b} dollars"]
UNITS = [
    "{a} TO {b} UNITS", "APARTMENT > {a} UNITS", "{a}+ UNITS", "{a} Units or more", "Five or more", "APT {a}U", "REAR {a}U, FRONT {b}U", "LOT K- {a} GARDEN FLATS", "{a} UNIT", "DUPLEX",
    "{a}UG", "{a}.5U", "{b} UNITED", "{a} U X", "{a}-{b} unit", "BLDG {a}UX", "single family",
]
STREETS = ["{a}-{b} MAIN ST APT {a}", "00{a}TH AVE", "{a}B 03RD ST", "{a} OAK ST", "{a} & {b} ELM ST SUITE {b}", "{a} 1/2 PINE ST", " {a}  HILL   RD # {b}", "{a}A-{b}C LAKE BLVD floor 2 X", "{a} FLINT ST"]
HEADERS = ["SOURCE: http://host/{a}\nRETRIEVED: 2026-01-{b}\n\n", "RETRIEVED:  {a} May \nSOURCE:\n", "", "x\nSOURCE: https://host/{b} \n", "SOURCE: two words\nRETRIEVED: {a}\n"]
PAGES = ["", "<p>a&amp;lt;b &#65;&#x1F600; &unknown; & x<br/>one<b>two</b></p>", "<SCRIPT>x</script >y</SCRIPT><li>z</li>&NBSP;q", "a\r\n \n\n\n b&sect;&mdash;"]


def worded(key: Column, said: list[str]) -> Column:
    """The wording of a key: one of those listed, with two small numbers put in."""
    chosen = F.element_at(F.array(*[F.lit(s) for s in said]), (key % len(said) + 1).cast("int"))
    return F.replace(F.replace(chosen, F.lit("{a}"), (key % 13 + 1).cast("string")), F.lit("{b}"), (key % 7 + 14).cast("string"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def worded_sql(key: str, said: list[str]) -> str:
    chosen = f"([{', '.join(map(quoted, said))}])[CAST({key} % {len(said)} + 1 AS INT)]"
    return f"replace(replace({chosen}, '{{a}}', CAST({key} % 13 + 1 AS VARCHAR)), '{{b}}', CAST({key} % 7 + 14 AS VARCHAR))"
