"""Places resolved from cached lookups: query variants in order, agreement of candidates, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SURE, VARIANT, AMBIGUOUS, FALLBACK = 0.95, 0.85, 0.7, 0.5
# Postal names of neighbourhoods, and the legal city each lies in.
NEIGHBOURHOODS = {
    "dorchester": "Boston, MA", "roxbury": "Boston, MA", "east boston": "Boston, MA", "brighton": "Boston, MA", "allston": "Boston, MA",
    "south boston": "Boston, MA", "jamaica plain": "Boston, MA", "hyde park": "Boston, MA", "mattapan": "Boston, MA", "san ysidro": "San Diego, CA",
}
# How assessors write units, ranges of house numbers, house letters and ordinal streets.
UNIT = r"(?i)\s+(?:(?:APT|UNIT|STE|SUITE|FL|FLOOR)\.?\s*[A-Z0-9-]+|#\s*[A-Z0-9-]+|\d+/\d+)\b"
RANGE = r"(?i)^(\d+)[A-Z]?\s*[-&]\s*(\d+)(?:\.\d+)?[A-Z]?\s+(.+)$"
HOUSE_LETTER = r"(?i)^(\d+)[A-Z]\b"
ZERO_ORDINAL = r"(?i)\b0+(\d+(?:ST|ND|RD|TH))\b"


def _clean(street: Column) -> Column:
    return F.regexp_replace(F.trim(street), r"\s+", " ")


def build_variants(street: Column, city: Column, state: Column, zip_code: Column) -> Column:
    """Ordered array of (variant, query) to try for an address; a repeated query keeps its first variant only.

    Only the address as given has its zip. Where the house number is a range, units and house letters are taken from
    the form with its first number.
    """
    street = _clean(street)
    line = lambda s: F.concat(s, F.lit(", "), city, F.lit(", "), state)
    ranged = street.rlike(RANGE)
    core = F.when(ranged, F.regexp_replace(street, RANGE, "$1 $3")).otherwise(street)
    no_unit = _clean(F.regexp_replace(core, UNIT, ""))
    tried = [
        ("as_given", F.when(F.coalesce(zip_code, F.lit("")) != "", F.concat(line(street), F.lit(" "), zip_code)).otherwise(line(street))),
        ("without_zip", line(street)),
        ("ordinal_zero_removed", line(F.regexp_replace(street, ZERO_ORDINAL, "$1"))),
        ("range_first", F.when(ranged, line(core))),
        ("range_last", F.when(ranged, line(F.regexp_replace(street, RANGE, "$2 $3")))),
        ("unit_removed", line(no_unit)),
        ("house_letter_removed", line(F.regexp_replace(no_unit, HOUSE_LETTER, "$1"))),
    ]
    every = F.filter(F.array(*[F.struct(F.lit(name).alias("variant"), q.alias("query")) for name, q in tried]), lambda v: v["query"].isNotNull())
    return F.filter(every, lambda v, i: ~F.exists(F.slice(every, 1, i), lambda o: o["query"] == v["query"]))


def postal_city(city: Column, state: Column) -> Column:
    """The legal city a postal name means: that of the neighbourhood table if it lies in the state, else the name itself."""
    table = F.try_element_at(F.create_map(*[F.lit(x) for pair in NEIGHBOURHOODS.items() for x in pair]), F.lower(F.trim(city)))
    return F.when(F.endswith(table, F.concat(F.lit(", "), state)), table).otherwise(F.concat(F.trim(city), F.lit(", "), state))


def matched_state(stated: Column, matched_address: Column) -> Column:
    """The state of a match: that of its geography, else the one its address ends with."""
    ending = F.nullif(F.regexp_extract(matched_address, r",\s*([A-Z]{2})\s*,?\s*\d{0,5}\s*$", 1), F.lit(""))
    return F.coalesce(F.upper(F.nullif(stated, F.lit(""))), ending)


def resolve(attempts: DataFrame, addresses: DataFrame) -> DataFrame:
    """One row an address: state, county, legal_city, method, confidence and note.

    attempts: (address_id, attempt_no, variant, matched_state, place, county): a row a match of a cached response, or one
    of nulls for a response without any. The first attempt whose matches in the address's state all name one place
    wins; else the first that offers the postal city among several; else the postal city itself. An address without any
    attempt is unresolved.
    """
    own = addresses.select("address_id", F.col("state").alias("own_state"), postal_city(F.col("postal_city"), F.col("state")).alias("postal"))
    inside = attempts.join(own, "address_id").filter(F.col("matched_state") == F.upper("own_state"))
    named = F.coalesce(F.col("place"), F.lit(""))
    is_postal = F.coalesce(F.concat("place", F.lit(", "), "own_state") == F.col("postal"), F.lit(False))
    per = inside.groupBy("address_id", "attempt_no", "variant").agg(
        F.count_distinct(named).alias("n"), F.min(named).alias("place"), F.min("county").alias("county"), F.bool_or(is_postal).alias("has_postal"), F.min(F.when(is_postal, F.col("county"))).alias("postal_county")
    )
    sure = F.when(F.col("n") == 1, F.struct("attempt_no", "variant", "place", "county"))
    among = F.when((F.col("n") > 1) & F.col("has_postal"), F.struct("attempt_no", "variant", F.col("postal_county").alias("county")))
    best = per.groupBy("address_id").agg(F.min(sure).alias("sure"), F.min(among).alias("among"))
    tried = attempts.groupBy("address_id").agg(F.count_distinct("attempt_no").alias("n_tried"))
    joined = addresses.join(best, "address_id", "left").join(tried, "address_id", "left")
    found, offered, asked = F.col("sure").isNotNull(), F.col("among").isNotNull(), F.col("n_tried").isNotNull()
    city = postal_city(F.col("postal_city"), F.col("state"))
    from_table = city != F.concat(F.trim("postal_city"), F.lit(", "), F.col("state"))
    note = (
        F.when(found, F.concat(F.lit("one place by "), "sure.variant", F.when(F.col("sure.place") == "", ", unincorporated").otherwise("")))
        .when(offered, F.concat(F.lit("several places by "), "among.variant", F.lit(", the postal city kept")))
        .when(asked, F.concat(F.lit("no place by "), F.col("n_tried").cast("string"), F.lit(" variants, postal "), F.when(from_table, "neighbourhood").otherwise("city")))
        .otherwise("no attempt")
    )
    return joined.select(
        "address_id", "state",
        F.when(found, F.col("sure.county")).when(offered, F.col("among.county")).alias("county"),
        F.when(found, F.when(F.col("sure.place") != "", F.concat("sure.place", F.lit(", "), "state"))).when(asked, city).alias("legal_city"),
        F.when(found | offered, "geocoder").when(asked, "postal_fallback").otherwise("unresolved").alias("method"),
        F.when(found, F.when(F.col("sure.variant") == "as_given", SURE).otherwise(VARIANT)).when(offered, AMBIGUOUS).when(asked, FALLBACK).otherwise(0.0).alias("confidence"),
        note.alias("note"),
    )


#: A cached entry as the geocoder's answers lie in it; layers are named with blanks, so they are keys of a map.
CACHE = (
    "struct<attempts:array<struct<variant:string,response:struct<result:struct<addressMatches:array<struct<"
    "matchedAddress:string,geographies:map<string,array<map<string,string>>>>>>>>>>"
)
# The notes of a resolved place.
BY_MATCH = "Census geocoder match ({variant}){rest}"
NO_PLACE = "; no incorporated place in the response (unincorporated)"
BY_CITY = "Census geocoder returned candidates in more than one place ({variant}); kept the candidate in the postal city."
BY_POST = "Postal fallback: the geocoder gave no unambiguous match for {n} address variants in {state}; legal city from the postal {source}."


def cached_matches(entry: Column) -> Column:
    """Attempts of a cached entry (JSON text) in order, each with its variant and matches: address, place, county and state."""
    layer = lambda m, name, field: F.try_element_at(F.try_element_at(F.try_element_at(m["geographies"], F.lit(name)), F.lit(1)), F.lit(field))
    match = lambda m: F.struct(
        m["matchedAddress"].alias("matched_address"), layer(m, "Incorporated Places", "BASENAME").alias("place"), layer(m, "Counties", "NAME").alias("county"),
        matched_state(layer(m, "States", "STUSAB"), m["matchedAddress"]).alias("state"),
    )
    none = F.array().cast("array<struct<matched_address:string,place:string,county:string,state:string>>")
    attempt = lambda a: F.struct(a["variant"].alias("variant"), F.coalesce(F.transform(a["response"]["result"]["addressMatches"], match), none).alias("matches"))
    return F.transform(F.from_json(entry, CACHE)["attempts"], attempt)


def resolve_cached(addresses: DataFrame, cache: DataFrame) -> DataFrame:
    """One row an address: state, county, legal_city, method, confidence, matched_address and note.

    addresses has address_id, state and postal_city, cache (address_id, entry) the geocoder's answers as JSON text. Attempts are
    taken in order: the first whose matches in the state all lie in one place gives that of its first match; else the
    first match that lies in the postal city, of the first attempt that has one; else the postal city itself. An address
    without an entry is unresolved. An entry is one row, so the one join by address is all that moves.
    """
    joined = addresses.join(cache, "address_id", "left").withColumn("_tried", cached_matches(F.col("entry")))
    legal = postal_city(F.col("postal_city"), F.col("state"))
    own = F.upper("state")
    inside = F.transform("_tried", lambda a: F.struct(a["variant"].alias("variant"), F.filter(a["matches"], lambda m: m["state"] == own).alias("matches")))
    placed = joined.withColumns({"_in": inside, "_legal": legal})
    one_place = lambda a: F.size(F.array_distinct(F.transform(a["matches"], lambda m: F.coalesce(m["place"], F.lit(""))))) == 1
    there = lambda m: F.coalesce(F.concat(m["place"], F.lit(", "), F.col("state")) == F.col("_legal"), F.lit(False))
    sure = F.get(F.filter("_in", one_place), F.lit(0))
    among = F.get(F.filter(F.transform("_in", lambda a: F.struct(a["variant"].alias("variant"), F.filter(a["matches"], there).alias("matches"))), lambda a: F.size(a["matches"]) > 0), F.lit(0))
    found = placed.withColumns({"_sure": sure, "_among": among})
    s, m = F.get("_sure.matches", F.lit(0)), F.get("_among.matches", F.lit(0))
    is_sure, is_among, is_asked = F.col("_sure").isNotNull(), F.col("_among").isNotNull(), F.col("_tried").isNotNull()
    pick = lambda by_match, by_city, by_post, none: F.when(is_sure, by_match).when(is_among, by_city).when(is_asked, by_post).otherwise(none)
    put = lambda template, **values: _filled(template, values)
    from_table = F.col("_legal") != F.concat(F.trim("postal_city"), F.lit(", "), F.col("state"))
    null = F.lit(None).cast("string")
    note = pick(
        put(BY_MATCH, variant=F.col("_sure.variant"), rest=F.when(s["place"].isNull(), NO_PLACE).otherwise("")), put(BY_CITY, variant=F.col("_among.variant")),
        put(BY_POST, n=F.size("_tried").cast("string"), state=F.col("state"), source=F.when(from_table, "neighbourhood table").otherwise("city name")), F.lit("no cached answer"),
    )
    return found.select(
        "address_id", "state", pick(s["county"], m["county"], null, null).alias("county"), pick(F.concat(s["place"], F.lit(", "), "state"), F.col("_legal"), F.col("_legal"), null).alias("legal_city"),
        pick(F.lit("geocoder"), F.lit("geocoder"), F.lit("postal_fallback"), F.lit("unresolved")).alias("method"),
        pick(F.when(F.col("_sure.variant") == "as_given", SURE).otherwise(VARIANT), F.lit(AMBIGUOUS), F.lit(FALLBACK), F.lit(0.0)).alias("confidence"), pick(s["matched_address"], m["matched_address"], null, null).alias("matched_address"), note.alias("note"),
    )


def _filled(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out
