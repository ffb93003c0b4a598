"""Facts a caller supplies beside the recorded ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTS = ("units", "year_built")


def overlay(recorded: Column, given: Column) -> Column:
    """struct(value, source): the recorded value, else the caller's, else none; the record is never overridden."""
    source = F.when(recorded.isNotNull(), "record").when(given.isNotNull(), "caller").otherwise("missing")
    return F.struct(F.coalesce(recorded, given).alias("value"), source.alias("source"))


def overlay_facts(places: DataFrame, supplied: str = "given") -> DataFrame:
    """places with every fact overlaid, <fact>_source beside it, and conflicts: facts the caller gives otherwise than recorded.

    places has a struct column ``supplied`` of the facts, null where nothing is supplied. Asked strictly, a row with
    conflicts is an error; in a batch the record wins and conflicts only tell.
    """
    given = {f: F.col(f"{supplied}.{f}") for f in FACTS}
    differs = F.array_compact(F.array(*[F.when(F.col(f).isNotNull() & given[f].isNotNull() & (F.col(f) != given[f]), F.lit(f)) for f in FACTS]))
    laid = places.withColumns({"conflicts": differs, **{f"_{f}": overlay(F.col(f), given[f]) for f in FACTS}})
    return laid.withColumns({**{f: F.col(f"_{f}.value") for f in FACTS}, **{f"{f}_source": F.col(f"_{f}.source") for f in FACTS}}).drop(supplied, *[f"_{f}" for f in FACTS])
