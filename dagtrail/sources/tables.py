"""History events, task reports and entity lines derived from general test tables.

The two mappings give realistic, skewed-by-choice inputs for the registered queries;
they only project columns, so a query grows with the table it reads.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from dagtrail import schemas as S


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Report column <- expression on a line item; columns not listed are NULL.
_REPORT = {
    "eventTime": "unix_millis(cast(l_shipdate as timestamp))",
    "nodeID": "if(l_returnflag = 'R', null, concat('host', l_suppkey % 10, ':', l_suppkey + 15000))",
    "contID": "if(l_returnflag = 'R', null, concat('container_', l_suppkey))",
    "applID": "concat('app_', l_orderkey % 7)",
    "vertexID": "concat('vertex_', l_orderkey)",
    "dagID": "concat('dag_', l_orderkey % 35)",
    "taskID": "concat('task_', l_partkey)",
    "status": "case l_returnflag when 'N' then 'SUCCEEDED' when 'R' then 'KILLED' else 'FAILED' end",
    "hdfsBytesRead": "l_partkey * 1000",
    "hdfsBytesWritten": "l_suppkey * 100",
    "hdfsReadOps": "l_quantity",
    "taskDurationMillis": "floor(l_extendedprice)",
    "inputRecords": "l_quantity * 10",
    "inputSplitLengthBytes": "l_partkey",
    "consumerTimeNano": "l_suppkey",
    "decodeTimeNano": "l_quantity * 7",
    "hdfsTimeNano": "l_orderkey",
    "totalIONano": "l_partkey + l_suppkey",
    "specQueueNano": "round(l_tax * 100)",
    "specRunningNano": "round(l_discount * 100)",
    "vertexName": "concat(if(l_linestatus = 'O', 'Map ', 'Reducer '), l_linenumber)",
    "vertexNumTasks": "l_linenumber",
}


def report_from_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """A task report with one attempt per line item."""
    columns = [
        f"cast({_REPORT.get(f.name, 'null')} as {f.dataType.simpleString()}) as {f.name}"
        for f in S.TASK_REPORT.fields
    ]
    return table(spark, folder, "lineitem").selectExpr(*columns)


# All counters, each with a value of its own: the event's number and the name's place among all names.
_COUNTERS = "array({})".format(
    ", ".join(
        f"""concat('{{"counterName":"{name}","counterValue":', event_id * 100 + {i}, '}}')"""
        for i, name in enumerate(sorted(S.REPORT_COUNTERS.values()))
    )
)

# Source event type -> history event type and the pairs of its payload.
_HISTORY = {
    "signup": (
        S.DAG_SUBMITTED,
        """if(user_id % 35 < 28,
              array(named_struct('key', 'callerId', 'value', concat('caller_', k % 10))),
              cast(array() as array<struct<key: string, value: string>>))""",
    ),
    "click": (
        S.VERTEX_INITIALIZED,
        """array(
             named_struct('key', 'vertexName', 'value',
                          concat(if(user_id % 3 = 0, 'Map ', 'Reducer '), k % 5)),
             named_struct('key', 'numTasks', 'value', string(k)),
             named_struct('key', 'servicePlugin', 'value',
                          concat('{"taskSchedulerName":"', if(user_id % 4 <> 0 and k % 10 <> 3, 'LLAP', 'YARN'), '"}')))""",
    ),
    "view": (
        S.TASK_ATTEMPT_STARTED,
        """array(
             named_struct('key', 'nodeId', 'value', concat('host', k % 10, ':', k + 15000)),
             named_struct('key', 'containerId', 'value', concat('container_', k)))""",
    ),
    "purchase": (
        S.TASK_ATTEMPT_FINISHED,
        """array(
             named_struct('key', 'status', 'value',
                          case k % 10 when 0 then 'KILLED' when 1 then 'FAILED' else 'SUCCEEDED' end),
             named_struct('key', 'counters', 'value', concat(
                 '{"counterGroups":[{"counters":[', array_join(""" + _COUNTERS + """, ','), ']},{"counters":[',
                 if(k % 3 <> 0,
                    concat('{"counterName":"TASK_DURATION_MILLIS","counterValue":', ms, '}'), ''),
                 ']}]}')),
             named_struct('key', 'startTime', 'value', string(eventTime - ms - 7)),
             named_struct('key', 'endTime', 'value', string(eventTime)))""",
    ),
    "error": (
        S.TASK_FINISHED,
        """array(
             named_struct('key', 'timeTaken', 'value', string(ms)),
             named_struct('key', 'status', 'value', if(k % 5 <> 0, 'SUCCEEDED', 'FAILED')),
             named_struct('key', 'numFailedTaskAttempts', 'value', string(k % 3)))""",
    ),
}


def _typed(raw: DataFrame, event_type: str, event_data: str) -> DataFrame:
    """History events from raw ones, given expressions for type and payload."""
    named = raw.selectExpr(
        "event_id",
        "user_id",
        "event_type",
        "cast(regexp_extract(props, '[0-9]+', 0) as bigint) as k",
        "cast(floor(value * 100) as bigint) as ms",
        "unix_millis(cast(ts as timestamp)) as eventTime",
    )
    return named.selectExpr(
        f"{event_type} as eventType",
        "eventTime",
        # now and then the application is not set
        "if(event_id % 97 = 0, '', concat('app_', user_id % 7)) as appId",
        "concat('dag_', user_id % 35) as dagId",
        "concat('vertex_', user_id) as vertexId",
        "concat('task_', user_id, '_', k % 20) as taskId",
        "concat('attempt_', user_id, '_', k % 20) as taskAttemptId",
        f"{event_data} as eventData",
        "'events' as srcFile",
        "event_id as srcPos",
    )


def history_from(raw: DataFrame, types: list[str] | None = None) -> DataFrame:
    """History events from the general event table.

    Without types, one scan makes all events. With types, each is a scan of its own
    with the type as a constant: an operator that asks for one type then gets its
    filter pushed to the files, and the scans of the other types vanish.
    """
    if types is None:
        kinds = " ".join(f"when '{name}' then '{made}'" for name, (made, _) in _HISTORY.items())
        data = " ".join(f"when '{name}' then {pairs}" for name, (_, pairs) in _HISTORY.items())
        return _typed(raw, f"case event_type {kinds} end", f"case event_type {data} end")
    branches = [
        _typed(raw.where(f"event_type = '{name}'"), f"'{made}'", pairs)
        for name, (made, pairs) in _HISTORY.items()
        if made in types
    ]
    return reduce(DataFrame.unionByName, branches)


def history_from_events(
    spark: SparkSession, folder: str, types: list[str] | None = None, tasks: int | None = None
) -> DataFrame:
    """History events of the given table; dealt over so many tasks as the short rows they are made from, if wanted."""
    raw = table(spark, folder, "events")
    return history_from(raw if tasks is None else raw.repartition(tasks, "event_id"), types)


def manifest_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest entries, several per application; one caller has none."""
    raw = table(spark, folder, "events").where("event_type = 'signup'")
    k = raw.selectExpr("cast(regexp_extract(props, '[0-9]+', 0) as bigint) as k")
    return k.where("k < 50 and k % 10 <> 9").selectExpr("concat('caller_', k % 10) as appId")


def entity_lines_from(history: DataFrame) -> DataFrame:
    """History events written as entity-log lines, every second line with two objects.

    Counter and plugin documents become nested objects, as in real logs; the second
    object is a marker without an event.
    """
    texts = history.selectExpr(
        "srcPos",
        """to_json(struct(
             array(struct(eventType as eventtype, eventTime as timestamp)) as events,
             if(eventType = 'VERTEX_INITIALIZED', vertexId, taskAttemptId) as entity,
             if(eventType = 'VERTEX_INITIALIZED', 'TEZ_VERTEX_ID', 'TEZ_TASK_ATTEMPT_ID') as entitytype,
             struct(
               array(appId) as applicationId,
               array(dagId) as TEZ_DAG_ID,
               if(eventType = 'VERTEX_INITIALIZED', null, array(vertexId)) as TEZ_VERTEX_ID,
               array(taskId) as TEZ_TASK_ID) as primaryfilters)) as head""",
        """array_join(transform(eventData, p -> concat(
             '"', p.key, '":',
             if(startswith(p.value, '{'), p.value, concat('"', p.value, '"')))), ',') as info""",
    )
    return texts.selectExpr(
        """concat(
             if(srcPos % 2 = 0, concat('{"entity":"marker_', srcPos, '","events":[],"otherinfo":{}} '), ''),
             left(head, length(head) - 1), ',"otherinfo":{', info, '}}') as line"""
    )
