"""Column expressions on event payloads: key/value pairs and counter documents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagtrail import schemas as S


def _text(value: str) -> str:
    """A text literal in SQL."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def kv(name: str, data: str = "eventData") -> Column:
    """Value of the first pair with the key, NULL if there is none.

    Works on the two field arrays with `array_position`, so the lookup stays in
    generated code; position 0 (absent) becomes index -1, which `get` maps to NULL.
    """
    return F.expr(f"get({data}.value, cast(array_position({data}.key, {_text(name)}) as int) - 1)")


def kv_or_blank(name: str, data: str = "eventData") -> Column:
    """Same as `kv`, for text output: blank instead of NULL."""
    return F.coalesce(kv(name, data), F.lit(""))


def whole_number(text: Column) -> Column:
    """Text to BIGINT; NULL unless the whole text is an optionally signed number."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def is_llap(data: str = "eventData") -> Column:
    """Whether a vertex runs on LLAP; absent or malformed plugin JSON is false."""
    scheduler = F.get_json_object(kv("servicePlugin", data), "$.taskSchedulerName")
    return scheduler.eqNullSafe(F.lit(S.LLAP))


def op_type(name: Column) -> Column:
    """Operation type: text before the first blank unless the name starts with one."""
    return F.when(F.instr(name, " ") > 1, F.substring_index(name, " ", 1)).otherwise(name)


def task_type(name: Column) -> Column:
    """Task type as the report relation defines it: text before the first blank."""
    return F.substring_index(name, " ", 1)


def host_name(node: Column) -> Column:
    """Host part of a `host:port` node id."""
    return F.substring_index(node, ":", 1)


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def _tolerant_counters(document: Column) -> Column:
    """All counters of a document in which some group or counter is not an object.

    Groups and counters are cut out as texts first, so one that has the wrong
    shape only loses itself.
    """
    groups = F.from_json(document, "struct<counterGroups: array<string>>")["counterGroups"]
    texts = F.transform(groups, lambda g: F.from_json(g, "struct<counters: array<string>>")["counters"])
    texts = F.flatten(F.filter(texts, lambda t: t.isNotNull()))
    return F.transform(texts, lambda t: F.from_json(t, S.COUNTER))


def _let(value: Column, body) -> Column:
    """Bind a costly expression once and use it several times in `body`."""
    return F.get(F.transform(F.array(value), body), 0)


def counters(document: Column, names: list[str]) -> Column:
    """Counters with one of the names, in document order, group names ignored.

    The regular shape is read by a single parse. Only a document with a missing or
    oddly shaped group takes the slower, tolerant route.
    """

    def pick(doc: Column) -> Column:
        groups = doc["counterGroups"]
        regular = F.forall(groups, lambda g: g["counters"].isNotNull())
        return F.when(regular, F.flatten(groups["counters"])).otherwise(_tolerant_counters(document))

    found = _let(F.from_json(document, S.COUNTER_DOCUMENT), pick)
    return F.filter(found, lambda c: c["counterName"].isin(names))


def counter_texts(document: Column, names: list[str]) -> Column:
    """Values of the first counter with each name as they are written, in the order of the names.

    One array instead of one expression per name: two dozen lookups side by side make
    generated code too long for the JVM to compile.
    """

    def look_up(found: Column) -> Column:
        wanted = F.array(*[F.lit(n) for n in names])
        return F.transform(
            wanted, lambda n: F.get(found["values"], F.array_position(found["names"], n).cast("int") - 1)
        )

    def apart(found: Column) -> Column:
        return F.struct(found["counterName"].alias("names"), found["counterValue"].alias("values"))

    return _let(_let(counters(document, names), apart), look_up)


def counter_values(document: Column, names: list[str]) -> Column:
    """The same as whole numbers; what is none, or beyond 64 bits, is NULL."""
    return counter_texts(document, names).try_cast("array<bigint>")


def task_duration(counter: Column) -> Column:
    """The duration counter, else end minus start if both are whole numbers."""
    elapsed = F.try_subtract(whole_number(kv("endTime")), whole_number(kv("startTime")))
    return F.coalesce(counter, elapsed)


def with_counters(finishes: DataFrame) -> DataFrame:
    """Replace the payload by the 22 numeric report columns.

    The values are a column of their own first, so that the document is parsed once.
    """
    names = [S.DURATION_COUNTER if c == S.DURATION_COLUMN else S.REPORT_COUNTERS[c] for c in S.MEASURES]
    found = finishes.withColumn("_values", counter_values(kv("counters"), names))
    columns = {c: F.get("_values", F.lit(i)) for i, c in enumerate(S.MEASURES)}
    columns[S.DURATION_COLUMN] = task_duration(columns[S.DURATION_COLUMN])
    keep = [c for c in finishes.columns if c != "eventData"]
    return found.select(*keep, *[columns[c].alias(c) for c in S.MEASURES])
