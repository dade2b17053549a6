"""Schemas shared by sources, operators and sinks."""

from pyspark.sql import types as T

# Event types found in the history, as spelled in the data.
DAG_SUBMITTED = "DAG_SUBMITTED"
VERTEX_INITIALIZED = "VERTEX_INITIALIZED"
TASK_ATTEMPT_STARTED = "TASK_ATTEMPT_STARTED"
TASK_ATTEMPT_FINISHED = "TASK_ATTEMPT_FINISHED"
TASK_FINISHED = "TASK_FINISHED"

# Event types the two reports need.
FEATURE_TYPES = [VERTEX_INITIALIZED, TASK_ATTEMPT_STARTED, TASK_ATTEMPT_FINISHED]
TIME_TYPES = [VERTEX_INITIALIZED, TASK_FINISHED]

SUCCEEDED = "SUCCEEDED"
LLAP = "LLAP"

# Total order of events; (srcFile, srcPos) alone identifies one event.
IDENTITY = ["srcFile", "srcPos"]
ORDER = ["eventTime", *IDENTITY]

HISTORY_EVENT = {
    "eventType": "string",
    "eventTime": "bigint",
    "appId": "string",
    "dagId": "string",
    "vertexId": "string",
    "taskId": "string",
    "taskAttemptId": "string",
    "eventData": "array<struct<key: string, value: string>>",
    "srcFile": "string",
    "srcPos": "bigint",
}

MANIFEST = {"appId": "string"}


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


# One JSON entity. The filters are named fields so that a badly shaped one
# cannot take the others with it; `timestamp` only accepts a JSON integer.
ATS_ENTITY = (
    "struct<"
    "events: array<struct<eventtype: string, timestamp: bigint>>, "
    "entity: string, entitytype: string, "
    "primaryfilters: struct<TEZ_VERTEX_ID: array<string>, TEZ_DAG_ID: array<string>, "
    "applicationId: array<string>, TEZ_TASK_ID: array<string>>, "
    "otherinfo: map<string, string>>"
)

COUNTER = "struct<counterName: string, counterValue: string>"
COUNTER_DOCUMENT = f"struct<counterGroups: array<struct<counters: array<{COUNTER}>>>>"

# Report column <- counter name, in report order. The task
# duration sits between hdfsWriteOps and inputRecords, see `REPORT_COLUMNS`.
REPORT_COUNTERS = {
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
DURATION_COLUMN = "taskDurationMillis"
DURATION_COUNTER = "TASK_DURATION_MILLIS"

_counter_names = list(REPORT_COUNTERS)
MEASURES = [*_counter_names[:4], DURATION_COLUMN, *_counter_names[4:]]

REPORT_COLUMNS = [
    "eventTime", "nodeID", "contID", "applID", "vertexID", "dagID", "taskID", "status",
    *MEASURES,
    "vertexName", "vertexNumTasks",
]
_report_strings = {"nodeID", "contID", "applID", "vertexID", "dagID", "taskID", "status", "vertexName"}

TASK_REPORT = T.StructType(
    [T.StructField(c, T.StringType() if c in _report_strings else T.LongType()) for c in REPORT_COLUMNS]
)

# The titles in the text report that differ from the column names.
REPORT_TITLES = {"eventTime": "time", "vertexName": "vertextName"}

# Titles of the time report and of its detail section.
TIME_COLUMNS = ["applicationID", "type", "count", "minTime", "maxTime", "avgTime", "stdDevTime"]
DETAIL_COLUMNS = ["applicationID", "vertexID", "type", "taskID", "timeTaken", "failedAttempts"]
