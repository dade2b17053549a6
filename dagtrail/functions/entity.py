"""Column expressions that turn entity-log text into typed entities."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from dagtrail import schemas as S

_ENTITIES = f"array<{S.ATS_ENTITY}>"


def _parse(text: Column) -> Column:
    """Objects of a text as an array; NULL if it is not a JSON list of objects.

    Text around the outermost braces is dropped. Brackets make a list of it, so
    one object, a comma-separated sequence and a bracketed list all fit.
    """
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(F.concat(F.lit("["), body, F.lit("]")), _ENTITIES)


def _known(parsed: Column) -> Column:
    return F.flatten(F.filter(parsed, lambda p: p.isNotNull()))


def _adjacent(text: Column) -> Column:
    """Objects that follow each other with only blanks between; NULL if a piece is bad."""
    pieces = F.transform(F.split(text, r"(?<=\})\s*(?=\{)"), _parse)
    checked = F.transform(
        F.array(pieces),
        lambda p: F.when(F.forall(p, lambda x: x.isNotNull()), F.flatten(p)),
    )
    return F.get(checked, 0)


def _by_braces(text: Column) -> Column:
    """Objects found by counting braces: other text between them is skipped, a bad
    object loses only itself, a surplus closing brace is ignored."""
    tokens = F.split(text, r"(?=[{}])")
    marks = F.transform(tokens, lambda t, i: F.struct(F.substring(t, 1, 1).alias("brace"), i.alias("at")))
    start = F.struct(
        F.lit(0).alias("depth"),
        F.lit(0).alias("open"),
        F.array().cast("array<struct<first: int, last: int>>").alias("spans"),
    )

    def step(state: Column, mark: Column) -> Column:
        opens, closes = mark["brace"] == "{", mark["brace"] == "}"
        depth = (
            F.when(opens, state["depth"] + 1)
            .when(closes, F.greatest(state["depth"] - 1, F.lit(0)))
            .otherwise(state["depth"])
        )
        done = F.struct(state["open"].alias("first"), mark["at"].alias("last"))
        return F.struct(
            depth.alias("depth"),
            F.when(opens & (state["depth"] == 0), mark["at"]).otherwise(state["open"]).alias("open"),
            F.when(closes & (state["depth"] == 1), F.array_append(state["spans"], done))
            .otherwise(state["spans"])
            .alias("spans"),
        )

    spans = F.aggregate(marks, start, step)["spans"]

    def cut(tokens: Column) -> Column:
        return F.transform(
            spans,
            lambda s: F.concat(
                F.array_join(F.slice(tokens, s["first"] + 1, s["last"] - s["first"]), ""), F.lit("}")
            ),
        )

    texts = F.get(F.transform(F.array(tokens), cut), 0)
    return _known(F.transform(texts, _parse))


def entities(line: Column) -> Column:
    """All top-level JSON objects of a line as typed structs.

    Most lines need one parse; the other two forms run only for lines on which the
    earlier ones fail.
    """
    return F.coalesce(_parse(line), _adjacent(line), _by_braces(line))


def event_type(entity: str) -> Column:
    """Type of the only entry of `events`, else UNKNOWN."""
    events = F.col(f"{entity}.events")
    return F.coalesce(F.when(F.size(events) == 1, F.get(events, 0)["eventtype"]), F.lit("UNKNOWN"))


def event_time(entity: str) -> Column:
    """Whole-number time of the only entry of `events`, else 0."""
    events = F.col(f"{entity}.events")
    return F.coalesce(F.when(F.size(events) == 1, F.get(events, 0)["timestamp"]), F.lit(0).cast("bigint"))


def single_filter(entity: str, name: str) -> Column:
    """A primary filter, if its list has exactly one entry."""
    values = F.col(f"{entity}.primaryfilters.{name}")
    return F.when(F.size(values) == 1, F.get(values, 0))


def pairs(entity: str) -> Column:
    """`otherinfo` as key/value pairs; an empty list if it is absent."""
    entries = F.map_entries(F.col(f"{entity}.otherinfo"))
    return F.coalesce(entries, F.array().cast("array<struct<key: string, value: string>>"))
