"""DuckDB SQL for the registered queries, on the same tables."""

# Task report from line items, independent of the Spark mapping.
_REPORT = """
with report as (
  select epoch_us(l_shipdate) // 1000 as eventTime,
         case when l_returnflag = 'R' then null
              else concat('host', l_suppkey % 10, ':', 15000 + l_suppkey) end as nodeID,
         case when l_returnflag = 'R' then null else concat('container_', l_suppkey) end as contID,
         concat('app_', l_orderkey % 7) as applID,
         concat('vertex_', l_orderkey) as vertexID,
         concat('dag_', l_orderkey % 35) as dagID,
         concat('task_', l_partkey) as taskID,
         case l_returnflag when 'N' then 'SUCCEEDED' when 'R' then 'KILLED' else 'FAILED' end as status,
         l_partkey * 1000 as hdfsBytesRead,
         l_suppkey * 100 as hdfsBytesWritten,
         cast(trunc(l_quantity) as bigint) as hdfsReadOps,
         cast(null as bigint) as hdfsWriteOps,
         cast(floor(l_extendedprice) as bigint) as taskDurationMillis,
         cast(trunc(l_quantity * 10) as bigint) as inputRecords,
         l_partkey as inputSplitLengthBytes,
         cast(null as bigint) as createdFiles,
         cast(null as bigint) as allocatedBytes,
         cast(null as bigint) as allocatedUsedBytes,
         cast(null as bigint) as cacheMissBytes,
         l_suppkey as consumerTimeNano,
         cast(trunc(l_quantity * 7) as bigint) as decodeTimeNano,
         l_orderkey as hdfsTimeNano,
         cast(null as bigint) as metaDataCacheMiss,
         cast(null as bigint) as decodeBatches,
         cast(null as bigint) as vectorBatches,
         cast(null as bigint) as rowsEmitted,
         cast(null as bigint) as selRowGroups,
         l_partkey + l_suppkey as totalIONano,
         cast(round(l_tax * 100) as bigint) as specQueueNano,
         cast(round(l_discount * 100) as bigint) as specRunningNano,
         concat(case l_linestatus when 'O' then 'Map ' else 'Reducer ' end, l_linenumber) as vertexName,
         cast(l_linenumber as bigint) as vertexNumTasks
    from lineitem
), succ as (
  select split_part(nodeID, ':', 1) as hostname, split_part(vertexName, ' ', 1) as taskType,
         report.* exclude (nodeID, applID, vertexID, dagID, status)
    from report
   where status = 'SUCCEEDED'
)
"""


def _mean(v: str) -> str:
    return f"cast(sum({v}) as double) / count({v})"


def _deviation(v: str) -> str:
    """Population deviation from exact integer sums."""
    total = f"cast(sum({v}) as hugeint)"
    return (
        f"sqrt(cast(count({v}) * cast(sum(cast({v} as bigint) * cast({v} as bigint)) as hugeint) "
        f"- {total} * {total} as double)) / count({v})"
    )


_AVERAGES = f"""
{_REPORT}, averages as (
  select hostname, taskType, count(*) as tasksInType,
         cast({_mean('taskDurationMillis')} as decimal(10,0)) as avg,
         cast({_deviation('taskDurationMillis')} as decimal(10,0)) as stddev
    from succ
   group by hostname, taskType
)
"""

# The report's counters.
_COUNTERS = {
    "hdfsBytesRead": "HDFS_BYTES_READ",
    "hdfsBytesWritten": "HDFS_BYTES_WRITTEN",
    "hdfsReadOps": "HDFS_READ_OPS",
    "hdfsWriteOps": "HDFS_WRITE_OPS",
    "inputRecords": "INPUT_RECORDS_PROCESSED",
    "inputSplitLengthBytes": "INPUT_SPLIT_LENGTH_BYTES",
    "createdFiles": "CREATED_FILES",
    "allocatedBytes": "ALLOCATED_BYTES",
    "allocatedUsedBytes": "ALLOCATED_USED_BYTES",
    "cacheMissBytes": "CACHE_MISS_BYTES",
    "consumerTimeNano": "CONSUMER_TIME_NS",
    "decodeTimeNano": "DECODE_TIME_NS",
    "hdfsTimeNano": "HDFS_TIME_NS",
    "metaDataCacheMiss": "METADATA_CACHE_MISS",
    "decodeBatches": "NUM_DECODED_BATCHES",
    "vectorBatches": "NUM_VECTOR_BATCHES",
    "rowsEmitted": "ROWS_EMITTED",
    "selRowGroups": "SELECTED_ROWGROUPS",
    "totalIONano": "TOTAL_IO_TIME_NS",
    "specQueueNano": "SPECULATIVE_QUEUED_NS",
    "specRunningNano": "SPECULATIVE_RUNNING_NS",
}
_PLACES = {name: i for i, name in enumerate(sorted(_COUNTERS.values()))}


def _measures() -> str:
    """The report's numbers: each counter has the event's number and its name's place."""
    counters = ", ".join(f"f.srcPos * 100 + {_PLACES[name]} as {column}" for column, name in _COUNTERS.items())
    return f"{counters}, case when f.k % 3 <> 0 then f.ms else f.ms + 7 end as taskDurationMillis,"


# The scalars behind every history event; payloads are never parsed here.
_HISTORY = """
with h as (
  select event_id as srcPos, user_id as u, epoch_us(ts) // 1000 as eventTime,
         cast(regexp_extract(props, '[0-9]+') as bigint) as k,
         cast(floor(value * 100) as bigint) as ms,
         case event_type when 'signup' then 'DAG_SUBMITTED' when 'click' then 'VERTEX_INITIALIZED'
              when 'view' then 'TASK_ATTEMPT_STARTED' when 'purchase' then 'TASK_ATTEMPT_FINISHED'
              when 'error' then 'TASK_FINISHED' end as eventType
    from events
), hist as (
  select eventType, eventTime, srcPos, u, k, ms,
         case when srcPos % 97 = 0 then '' else concat('app_', u % 7) end as appId,
         concat('dag_', u % 35) as dagId,
         concat('vertex_', u) as vertexId,
         concat('task_', u, '_', k % 20) as taskId,
         concat('attempt_', u, '_', k % 20) as taskAttemptId
    from h
), callers as (
  select dagId, arg_min(concat('caller_', k % 10), (eventTime, srcPos)) as callerId
    from hist
   where eventType = 'DAG_SUBMITTED' and u % 35 < 28
   group by dagId
), vertices as (
  select vertexId, arg_max(appId, (eventTime, srcPos)) as appId, bool_or(appId <> '') as named,
         case when arg_max(u, (eventTime, srcPos)) % 3 = 0 then 'Map' else 'Reducer' end as opType,
         concat(case when arg_max(u, (eventTime, srcPos)) % 3 = 0 then 'Map ' else 'Reducer ' end,
                arg_max(k, (eventTime, srcPos)) % 5) as vertexName,
         arg_max(k, (eventTime, srcPos)) as numTasks
    from hist
   where eventType = 'VERTEX_INITIALIZED' and u % 4 <> 0 and k % 10 <> 3
   group by vertexId
), starts as (
  select taskAttemptId, arg_max(k, (eventTime, srcPos)) as k
    from hist
   where eventType = 'TASK_ATTEMPT_STARTED'
   group by taskAttemptId
), finishes as (
  select hist.*, vertexName, numTasks,
         row_number() over (partition by taskAttemptId order by eventTime, srcPos) as nth
    from hist join vertices using (vertexId)
   where eventType = 'TASK_ATTEMPT_FINISHED'
), features as (
  select f.eventTime,
         case when s.k is not null then concat('host', s.k % 10, ':', s.k + 15000) end as nodeID,
         case when s.k is not null then concat('container_', s.k) end as contID,
         f.appId as applID, f.vertexId as vertexID, f.dagId as dagID, f.taskId as taskID,
         case f.k % 10 when 0 then 'KILLED' when 1 then 'FAILED' else 'SUCCEEDED' end as status,
         __MEASURES__
         f.vertexName, f.numTasks as vertexNumTasks
    from finishes f left join starts s on s.taskAttemptId = f.taskAttemptId and f.nth = 1
), detail as (
  select t.appId as applicationID, t.vertexId as vertexID, v.opType as type, t.taskId as taskID,
         t.ms as timeTaken, cast(t.k % 3 as integer) as failedAttempts
    from hist t join callers using (dagId) join vertices v on v.vertexId = t.vertexId
   where t.eventType = 'TASK_FINISHED' and t.k % 5 <> 0 and t.appId <> '' and v.named
)
"""
_HISTORY = _HISTORY.replace("__MEASURES__", _measures())

_IDS = "eventType, eventTime, appId, dagId, vertexId, taskId, taskAttemptId, srcPos"
_FEATURE_TYPES = "('VERTEX_INITIALIZED', 'TASK_ATTEMPT_STARTED', 'TASK_ATTEMPT_FINISHED')"
_TIME_TYPES = "('VERTEX_INITIALIZED', 'TASK_FINISHED')"
_MANIFEST = """(select distinct concat('caller_', k % 10) as callerId
                  from hist where eventType = 'DAG_SUBMITTED' and k < 50 and k % 10 <> 9)"""

_TIMES = f"""
{_HISTORY}
select applicationID, type, count(*) as count, min(timeTaken) as minTime, max(timeTaken) as maxTime,
       cast(trunc({_mean('timeTaken')}) as bigint) as avgTime,
       cast(trunc({_deviation('timeTaken')}) as bigint) as stdDevTime
  from detail
 group by applicationID, type
"""

_COUNTER_JSON = [
    f"""concat('{{"counterName":"{name}","counterValue":', srcPos * 100 + {i}, '}}')""" for name, i in _PLACES.items()
]

_FEATURES = f"{_HISTORY} select * from features"


# A third of all events belongs to one vertex.
_FEATURES_HOT = _FEATURES.replace(
    "concat('vertex_', u) as vertexId",
    "case when srcPos % 3 = 0 then 'vertex_1' else concat('vertex_', u) end as vertexId",
)


def oracle_sql() -> dict[str, str]:
    return {
        "status_distribution": f"""
            {_REPORT}
            select status as "taskFinishStatus", count(*) as "eventCount" from report group by status""",
        "node_restarts": f"""
            {_REPORT}
            select split_part(nodeID, ':', 1) as hostname, count(distinct nodeID) - 1 as "restartsAfterCrash"
              from report where status = 'SUCCEEDED' group by 1 order by 1""",
        "succ_task_events": f"{_REPORT} select * from succ",
        "duration_by_type": f"""
            {_REPORT}
            select taskType, count(*) as "numTasksByType",
                   cast({_mean('taskDurationMillis')} as decimal(10,0)) as "avgDurationMS",
                   cast({_deviation('taskDurationMillis')} as decimal(10,0)) as "stdDevDurationMS"
              from succ group by taskType""",
        "top_tasks": f"""
            {_REPORT}
            select taskDurationMillis * 1000000 as "taskDurationNano", specQueueNano,
                   specRunningNano as "specRunNano", consumerTimeNano, decodeTimeNano, hdfsTimeNano,
                   totalIONano as "total I/O Nano", inputRecords, inputSplitLengthBytes, decodeBatches,
                   vectorBatches, rowsEmitted, selRowGroups, vertexNumTasks
              from succ
             order by {', '.join(f'{i} desc nulls first' for i in range(1, 15))}
             limit 30""",
        "averages_by_node": f"{_AVERAGES} select * from averages",
        "node_averages_ranked": f"""
            {_AVERAGES}
            select hostname as "hostName", taskType, tasksInType as "numTasksByType",
                   avg as "avgForType", stddev as "stdDevPop"
              from averages order by taskType, tasksInType desc""",
        "node_distance": f"""
            {_AVERAGES}, a as (select taskType, cast(avg as bigint) as avg from averages),
            d as (
              select taskType, {_mean('avg')} as m, {_deviation('avg')} as sd,
                     greatest({_mean('avg')} - min(avg), max(avg) - {_mean('avg')}) as far
                from a group by taskType)
            select taskType, cast(m as decimal(10,0)) as "avgAllNodes",
                   cast(sd as decimal(10,0)) as "stdDevAllNodes",
                   cast(far as decimal(10,0)) as "maxDiff",
                   cast(far * 100 / m as decimal(4,1)) as "maxDiffPercent"
              from d""",
        "cluster_skew": f"""
            {_REPORT}, totals as (
              select hostname, cast(sum(taskDurationMillis) as bigint) as total, count(*) as n
                from succ where taskType = 'Map' group by hostname)
            select hostname as "hostName", total as "totalTimeMS",
                   cast(total * 100 / (select max(total) from totals) as decimal(4,1)) as "totalTimePercent",
                   n as "numTasks"
              from totals""",
        "task_report_roundtrip": f"{_REPORT} select * from report",
        "filter_event_types": f"{_HISTORY} select {_IDS} from hist where eventType in {_TIME_TYPES}",
        "event_kv": f"""
            {_HISTORY}
            select srcPos,
                   case when eventType = 'TASK_ATTEMPT_FINISHED' then
                          case k % 10 when 0 then 'KILLED' when 1 then 'FAILED' else 'SUCCEEDED' end
                        when eventType = 'TASK_FINISHED' then
                          case when k % 5 <> 0 then 'SUCCEEDED' else 'FAILED' end end as status,
                   case when eventType = 'VERTEX_INITIALIZED' then
                          concat(case when u % 3 = 0 then 'Map ' else 'Reducer ' end, k % 5) end as vertexName,
                   case when eventType = 'TASK_ATTEMPT_STARTED' then
                          concat('host', k % 10, ':', k + 15000) end as nodeId,
                   case when eventType = 'TASK_FINISHED' then cast(ms as varchar) end as timeTaken,
                   case when eventType = 'DAG_SUBMITTED' and u % 35 < 28 then concat('caller_', k % 10)
                        else '' end as callerId
              from hist""",
        "dag_callers": f"{_HISTORY} select * from callers",
        "events_with_caller": f"{_HISTORY} select {_IDS}, callerId from hist join callers using (dagId)",
        "caller_ids": f"""
            {_HISTORY}
            select distinct callerId from hist join callers using (dagId) where eventType in {_TIME_TYPES}""",
        "events_for_caller": f"""
            {_HISTORY}
            select {_IDS}, callerId from hist join callers using (dagId) where callerId = 'caller_3'""",
        "app_ids": f"""
            {_HISTORY}
            select distinct appId from hist join callers using (dagId)
             where eventType in {_TIME_TYPES} and appId <> ''""",
        "events_for_app": f"""
            {_HISTORY}
            select {_IDS}, callerId from hist join callers using (dagId) where appId = 'app_3'""",
        "manifest_by_app": f"""
            {_HISTORY}
            select concat('caller_', k % 10) as appId, count(*) as entries
              from hist where eventType = 'DAG_SUBMITTED' and k < 50 and k % 10 <> 9 group by 1""",
        "events_for_manifest": f"""
            {_HISTORY}
            select {_IDS}, callerId from hist join callers using (dagId) join {_MANIFEST} m using (callerId)""",
        "ingest_summary": f"""
            {_HISTORY}, c as (
              select count(*) as total, count(*) filter (callerId is null) as nocaller,
                     count(*) filter (callerId is not null and eventType not in {_TIME_TYPES}) as rejected,
                     count(*) filter (callerId is not null and eventType in {_TIME_TYPES}) as passed
                from hist left join callers using (dagId))
            select total as "totalEvents", nocaller as "eventsWithoutCaller", rejected as "rejectedEvents",
                   passed as "passedEvents", total - rejected as "survivingEvents",
                   (total - rejected) * 100 // total as "survivingPercent",
                   cast(1 as bigint) as "foundFiles"
              from c""",
        "llap_vertices": f"""
            {_HISTORY} select vertexId, appId, vertexName, opType, numTasks from vertices""",
        "task_finishes": f"""
            {_HISTORY}
            select appId, dagId, vertexId, taskId, ms as timeTaken, cast(k % 3 as integer) as failedAttempts,
                   k % 5 <> 0 as wasSuccessful, eventTime, srcPos
              from hist where eventType = 'TASK_FINISHED'""",
        "task_times": _TIMES,
        "time_detail": f"{_HISTORY} select * from detail",
        "attempt_placement": f"""
            {_HISTORY}
            select taskAttemptId, concat('host', k % 10, ':', k + 15000) as nodeId,
                   concat('container_', k) as containerId
              from starts""",
        "counter_values": f"""
            {_HISTORY}
            select srcPos, {', '.join(f'srcPos * 100 + {i} as "{n}"' for n, i in _PLACES.items())}
              from hist where eventType = 'TASK_ATTEMPT_FINISHED'""",
        "task_duration": f"""
            {_HISTORY} select srcPos, case when k % 3 <> 0 then ms else ms + 7 end as duration from hist where eventType = 'TASK_ATTEMPT_FINISHED'""",
        "task_features": _FEATURES,
        "ats_events": f"""
            {_HISTORY}
            select eventType, eventTime, appId, dagId, vertexId,  taskId,
                   case when eventType <> 'VERTEX_INITIALIZED' then taskAttemptId end as taskAttemptId
              from hist where eventType in {_FEATURE_TYPES}""",
        "ats_event_data": f"""
            {_HISTORY}, pairs as (
              select hist.*, unnest(case eventType
                when 'VERTEX_INITIALIZED' then [
                  ['vertexName', concat(case when u % 3 = 0 then 'Map ' else 'Reducer ' end, k % 5)],
                  ['numTasks', cast(k as varchar)],
                  ['servicePlugin', concat('{{"taskSchedulerName":"',
                                           case when u % 4 <> 0 and k % 10 <> 3 then 'LLAP' else 'YARN' end, '"}}')]]
                when 'TASK_ATTEMPT_STARTED' then [
                  ['nodeId', concat('host', k % 10, ':', k + 15000)],
                  ['containerId', concat('container_', k)]]
                else [
                  ['status', case k % 10 when 0 then 'KILLED' when 1 then 'FAILED' else 'SUCCEEDED' end],
                  ['counters', concat('{{"counterGroups":[{{"counters":[',
                     {" || ',' || ".join(_COUNTER_JSON)}, ']}},{{"counters":[',
                     case when k % 3 <> 0 then
                       concat('{{"counterName":"TASK_DURATION_MILLIS","counterValue":', ms, '}}')
                     else '' end, ']}}]}}')],
                  ['startTime', cast(eventTime - ms - 7 as varchar)],
                  ['endTime', cast(eventTime as varchar)]] end) as pair
                from hist where eventType in {_FEATURE_TYPES})
            select case when eventType <> 'VERTEX_INITIALIZED' then taskAttemptId end as taskAttemptId,
                   vertexId, eventTime, pair[1] as key, pair[2] as value
              from pairs""",
        "ats_task_features": _FEATURES,
        "limited_events": f"{_HISTORY} select {_IDS} from hist order by srcPos limit 100",
        "read_until": f"""
            {_HISTORY} select {_IDS} from hist where eventType = 'TASK_FINISHED' order by srcPos limit 100""",
        "file_status": f"""
            {_HISTORY}
            select cast(5 as bigint) as files, cast(1 as bigint) as damaged, count(*) as stated, count(*) as events
              from hist""",
        "lost_counters": f"""
            {_HISTORY}
            select '{min(_PLACES)}' as counter, count(*) as lost from hist
             where eventType = 'TASK_ATTEMPT_FINISHED' and srcPos % 4 = 0
            union all
            select '{max(_PLACES)}', count(*) from hist
             where eventType = 'TASK_ATTEMPT_FINISHED' and srcPos % 5 = 0""",
        "run_job_features": _FEATURES,
        "run_job_times": _TIMES,
        "run_job_features_json": _FEATURES,
        "run_job_limited": f"""
            {_HISTORY}
            select cast(floor(0.6 * count(*)) as bigint) as taken, cast(0 as bigint) as unknown,
                   true as several_tasks
              from hist where eventType in {_FEATURE_TYPES}""",
        "stream_task_features": _FEATURES,
        "stream_ats_features": _FEATURES,
        "stream_followed_features": _FEATURES,
        "task_features_hot": _FEATURES_HOT,
        "events_with_caller_hot": f"""
            {_HISTORY}, hot as (
              select * replace (case when srcPos % 3 = 0 then 'dag_1' else dagId end as dagId) from hist),
            called as (
              select dagId, arg_min(concat('caller_', k % 10), (eventTime, srcPos)) as callerId
                from hot where eventType = 'DAG_SUBMITTED' and u % 35 < 28 group by dagId)
            select {_IDS}, callerId from hot join called using (dagId)""",
        "entity_summary": f"""
            {_HISTORY}
            select count(*) + count(*) filter (srcPos % 2 = 0) as "totalEvents",
                   count(*) filter (eventType in {_FEATURE_TYPES}) as "passedEvents",
                   count(*) + count(*) filter (srcPos % 2 = 0)
                     - count(*) filter (eventType in {_FEATURE_TYPES}) as "rejectedEvents",
                   cast(4 as bigint) as "foundFiles"
              from hist""",
        "report_tables": f"{_AVERAGES} select * from averages",
        "time_detail_job": f"{_HISTORY} select * from detail",
        "own_processor": f"""
            {_HISTORY}
            select eventType, count(*) as events from hist join callers using (dagId) where appId <> '' group by 1
            union all
            select 'NAMED' as eventType, count(*) as events from hist
             where eventType = 'DAG_SUBMITTED' and appId = ''""",
    }
