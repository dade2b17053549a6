"""The task report kept up to date by keyed state, reading only what is new.

Three queries follow each other, each from its own checkpoint. Events are landed as before.
From the landed files a state per vertex lets finishes through once their vertex is known to run
in LLAP, and tells of each later start of it; finishes that came first wait in the state. From
finishes and attempt starts a state per attempt says which finish an attempt's placement
belongs to; what is kept of a start goes when its finish is met, and only its place in the order
of events stays, so that a later start or an earlier finish still has its effect.

Keys are dealt over a fixed number of buckets, and a bucket's states are read and written at once.

All that is written are appended changes: a batch reads its new events and the states of their
buckets, and nothing that was written before. The report is the newest change of each key.
"""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from dagtrail import schemas as S
from dagtrail.functions.payload import kv, with_counters
from dagtrail.operators.features import FINISH, attempt_finishes
from dagtrail.operators.vertices import vertices
from dagtrail.sources.paths import is_directory
from dagtrail.streaming.features import write_stream

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_SETTING = "spark.sql.streaming.stateStore.providerClass"
# A vertex may own a large part of all finishes; they are dealt over so many slices, each in a bucket of its own.
SLICES = 16
# Keys are dealt over so many buckets. A call of Python and its calls to the state cost milliseconds whatever they
# move, so they are made per bucket rather than per key; a batch reads the states of the buckets its keys are in.
BUCKETS = 4096
# Below every real time and position.
NEVER = -(1 << 63)
_UNUSED = (NEVER, "", NEVER)

_PLACE = "eventTime long, srcFile string, srcPos long"
# Finished attempts pass as text, which keeps whole numbers whole on their way through Python.
_FINISHED = [*FINISH, "vertexId", "applID", "dagID", "taskID", "status", *S.MEASURES]
_strings = {"taskAttemptId", "srcFile", "vertexId", "applID", "dagID", "taskID", "status"}
_FINISHED_SCHEMA = ", ".join(f"{c} {'string' if c in _strings else 'long'}" for c in _FINISHED)
_FINISHES = f"vertexId string, taskAttemptId string, {_PLACE}, body string"
_CHANGES = f"kind string, {_FINISHES}"
_NAMED = "vertexName string, numTasks long"
_PLACED = f"taskAttemptId string, {_PLACE}, nodeID string, contID string, moved boolean"


def _empty(schema: str) -> dict[str, list]:
    return {c.split()[0]: [] for c in schema.split(", ")}


def _frame(schema: str, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(_empty(schema), zip(*rows, strict=True), strict=True)))


def _changes(kind: str, rows: list[tuple]) -> pd.DataFrame:
    return _frame(_CHANGES, [(kind, *row) for row in rows])


class VertexState(StatefulProcessor):
    """Of each vertex of a bucket: the place of its latest LLAP start, and the finishes that wait for the first one.

    With a horizon, finishes that have waited that many milliseconds are let go with the next batch, each as a
    change `dropped`, so that they can be counted.
    """

    def __init__(self, horizon: int | None = None):
        self.horizon = horizon

    def init(self, handle) -> None:
        self._handle = handle
        self._latest = handle.getListState("latest", f"vertexId string, {_PLACE}")
        self._waiting = handle.getListState("waiting", f"since long, {_FINISHES}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = {v: tuple(place) for v, *place in self._latest.get()}
        before, newest, finishes = dict(latest), {}, []
        for batch in rows:
            started = batch["kind"] == "vertex"
            finishes.append(batch[~started])
            for row in batch[started].itertuples(index=False):
                place = (row.eventTime, row.srcFile, row.srcPos)
                if row.vertexId not in latest or place > latest[row.vertexId]:
                    latest[row.vertexId] = place
                    if row.slice == 0:
                        newest[row.vertexId] = row.body
        if latest != before:
            self._latest.put([(v, *place) for v, place in latest.items()])
        if newest:
            yield _changes("vertex", [(v, "", *latest[v], body) for v, body in newest.items()])
        if latest.keys() - before.keys():
            yield from self._let_go("finish", lambda since, vertex: vertex in latest)
        come = pd.concat(finishes)
        known = come["vertexId"].isin(latest.keys())
        if known.any():
            yield come.loc[known, list(_empty(_CHANGES))]
        if not known.all():
            now = timerValues.getCurrentProcessingTimeInMs()
            self._waiting.appendList([(now, *w) for w in come.loc[~known, list(_empty(_FINISHES))].itertuples(index=False)])
            if self.horizon is not None:
                self._handle.registerTimer(now + self.horizon)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        latest = timerValues.getCurrentProcessingTimeInMs() - self.horizon
        yield from self._let_go("dropped", lambda since, vertex: since <= latest)

    def _let_go(self, kind: str, which: Callable[[int, str], bool]) -> Iterator[pd.DataFrame]:
        """The waiting finishes that are asked for, as changes; the others go on waiting."""
        waiting = [tuple(w) for w in self._waiting.get()]
        gone = [which(w[0], w[1]) for w in waiting]
        if any(gone):
            staying = [w for w, goes in zip(waiting, gone, strict=True) if not goes]
            self._waiting.put(staying) if staying else self._waiting.clear()
            yield _changes(kind, [w[1:] for w, goes in zip(waiting, gone, strict=True) if goes])

    def close(self) -> None:
        pass


class AttemptState(StatefulProcessor):
    """Of each attempt of a bucket: a start that no finish has used, the first finish, and the place of the start it used.

    A start is used once, by the first finish, and let go then.
    """

    def init(self, handle) -> None:
        self._starts = handle.getListState("starts", f"taskAttemptId string, {_PLACE}, nodeID string, contID string")
        self._firsts = handle.getListState("firsts", f"taskAttemptId string, {_PLACE}, usedTime long, usedFile string, usedPos long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        starts = {attempt: tuple(start) for attempt, *start in self._starts.get()}
        firsts = {f[0]: (tuple(f[1:4]), tuple(f[4:])) for f in self._firsts.get()}
        before, earliest, newest = (dict(starts), dict(firsts)), {}, {}
        for batch in rows:
            columns = (batch[c].tolist() for c in ("kind", "taskAttemptId", *S.ORDER, "nodeID", "contID"))
            for kind, attempt, *place, node, container in zip(*columns, strict=True):
                place = tuple(place)
                if kind == "finish":
                    earliest[attempt] = min(earliest.get(attempt, place), place)
                elif attempt not in newest or place > newest[attempt][:3]:
                    newest[attempt] = (*place, node, container)
        placed = []
        for attempt in earliest.keys() | newest.keys():
            first, used = firsts.get(attempt, (None, _UNUSED))
            known, start = first, starts.get(attempt)
            if attempt in earliest:
                first = earliest[attempt] if first is None else min(first, earliest[attempt])
            if attempt in newest and newest[attempt][:3] > max(start[:3] if start else _UNUSED, used):
                start = newest[attempt]
            if first is None:
                if start is not None:
                    starts[attempt] = start
                continue
            if start is not None:
                starts.pop(attempt, None)
                used = start[:3]
                placed.append((attempt, *first, *start[3:], False))
            elif used != _UNUSED and first != known:
                placed.append((attempt, *first, None, None, True))
            firsts[attempt] = (first, used)
        if starts != before[0]:
            self._starts.put([(a, *s) for a, s in starts.items()]) if starts else self._starts.clear()
        if firsts != before[1]:
            self._firsts.put([(a, *first, *used) for a, (first, used) in firsts.items()])
        if placed:
            yield _frame(_PLACED, placed)

    def close(self) -> None:
        pass


@contextmanager
def _state_settings(spark: SparkSession) -> Iterator[None]:
    """State on disk, and no batches without data, which would never end where a timer is pending."""
    wanted = {PROVIDER_SETTING: PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _placed_in_order(df: DataFrame) -> DataFrame:
    filled = {"eventTime": NEVER, "srcFile": "", "srcPos": NEVER}
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in filled.items()})


def _vertex_rows(events: DataFrame, buckets: int) -> DataFrame:
    """What the state per vertex takes: LLAP starts, for every slice, and finishes, each for one."""
    finishes = attempt_finishes(events).select(
        *FINISH,
        "vertexId",
        F.col("appId").alias("applID"),
        F.col("dagId").alias("dagID"),
        F.col("taskId").alias("taskID"),
        kv("status").alias("status"),
        "eventData",
    )
    body = F.to_json(F.struct(*_FINISHED)).alias("body")
    own = F.pmod(F.xxhash64(*FINISH), F.lit(SLICES)).cast("int").alias("slice")
    finished = with_counters(finishes.where("vertexId is not null")).select(
        F.lit("finish").alias("kind"), "vertexId", own, *FINISH, body
    )
    inits = _placed_in_order(vertices(events).where("isLlap and vertexId is not null"))
    body = F.to_json(F.struct("vertexName", "numTasks")).alias("body")
    inits = inits.select("vertexId", F.lit("").alias("taskAttemptId"), *S.ORDER, body)
    started = inits.mapInPandas(_latest_starts, inits.schema).select(
        F.lit("vertex").alias("kind"),
        "vertexId",
        F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"),
        "taskAttemptId",
        *S.ORDER,
        "body",
    )
    return finished.unionByName(started).withColumn("bucket", _bucket(buckets, "vertexId", "slice"))


def _bucket(buckets: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _latest_starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The latest start of each vertex of a batch: each that is left goes to every slice."""
    for batch in batches:
        yield batch.sort_values(list(S.ORDER)).drop_duplicates("vertexId", keep="last")


def _fewer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first finish and the latest start of each attempt of a batch: an attempt with very many moves few rows."""
    for batch in batches:
        ordered = batch.sort_values(list(S.ORDER))
        first = ordered[ordered["kind"] == "finish"].drop_duplicates("taskAttemptId", keep="first")
        last = ordered[ordered["kind"] == "start"].drop_duplicates("taskAttemptId", keep="last")
        yield pd.concat([first, last])


def _attempt_rows(events: DataFrame, changes: DataFrame, buckets: int) -> DataFrame:
    starts = _placed_in_order(events.where(F.col("eventType") == S.TASK_ATTEMPT_STARTED)).select(
        F.coalesce("taskAttemptId", F.lit("")).alias("taskAttemptId"),
        *S.ORDER,
        kv("nodeId").alias("nodeID"),
        kv("containerId").alias("contID"),
        F.lit("start").alias("kind"),
    )
    finishes = changes.where("kind = 'finish'").select("taskAttemptId", *S.ORDER, "kind")
    both = starts.unionByName(finishes, allowMissingColumns=True)
    return both.mapInPandas(_fewer, both.schema).withColumn("bucket", _bucket(buckets, "taskAttemptId"))


def _appended(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write each batch to a folder of its own, which a batch that is run again replaces."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/batch-{batch_id}")

    with _state_settings(changes.sparkSession):
        writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")
        return writer.trigger(availableNow=True).start()


def _landed(spark: SparkSession, landing: str) -> DataFrame:
    reader = spark.readStream.schema(S.ddl(S.HISTORY_EVENT)).option("recursiveFileLookup", True)
    return reader.parquet(landing)


def follow(events: DataFrame, folder: str, horizon: int | None = None, buckets: int = BUCKETS) -> list[StreamingQuery]:
    """Take what has arrived into the report's changes below the folder, and give the three finished queries.

    Started again on the same folder it goes on where it stopped, also if it died in between. By default nothing
    is ever let go: a finish waits for its vertex as long as it takes. The number of buckets must stay what it was
    when the folder was begun; histories of very many attempts want more, so that each bucket stays small.
    """
    spark = events.sparkSession
    done = [write_stream(events, f"{folder}/landing", f"{folder}/checkpoint-landing")]
    done[0].awaitTermination()
    if not is_directory(spark, f"{folder}/landing"):
        return done
    mode = "None" if horizon is None else "ProcessingTime"
    grouped = _vertex_rows(_landed(spark, f"{folder}/landing"), buckets).groupBy("bucket")
    changes = grouped.transformWithStateInPandas(VertexState(horizon), _CHANGES, "Update", mode)
    done.append(_appended(changes, f"{folder}/changes", f"{folder}/checkpoint-vertices"))
    done[1].awaitTermination()
    let_through = spark.readStream.schema(_CHANGES + ", batch long").option("recursiveFileLookup", True)
    rows = _attempt_rows(_landed(spark, f"{folder}/landing"), let_through.parquet(f"{folder}/changes"), buckets)
    placed = rows.groupBy("bucket").transformWithStateInPandas(AttemptState(), _PLACED, "Update", "None")
    done.append(_appended(placed, f"{folder}/placements", f"{folder}/checkpoint-attempts"))
    done[2].awaitTermination()
    return done


def _newest(df: DataFrame, value: Column, by: Column, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, by).alias("newest"))


def followed_report(spark: SparkSession, folder: str) -> DataFrame:
    """The task report of all that `follow` has taken: no event is read, and no payload parsed, again."""
    reader = spark.read.option("recursiveFileLookup", True)
    changes = reader.schema(_CHANGES + ", batch long").parquet(f"{folder}/changes")
    rows = changes.where("kind = 'finish'").select(F.from_json("body", _FINISHED_SCHEMA).alias("r")).select("r.*")
    named = changes.where("kind = 'vertex'").select("vertexId", *S.ORDER, F.from_json("body", _NAMED).alias("v"))
    names = _newest(named, F.col("v"), F.struct(*S.ORDER), "vertexId")
    names = names.select("vertexId", "newest.vertexName", F.col("newest.numTasks").alias("vertexNumTasks"))
    placed = reader.schema(_PLACED + ", batch long").parquet(f"{folder}/placements")
    node = F.when(~F.col("moved"), F.struct("nodeID", "contID"))
    where = placed.groupBy("taskAttemptId").agg(
        F.max_by(F.struct(*S.ORDER), F.col("batch")).alias("first"),
        F.max_by(node, F.when(~F.col("moved"), F.col("batch"))).alias("node"),
    )
    where = where.select("taskAttemptId", "first.*", "node.nodeID", "node.contID")
    found = rows.join(names, "vertexId").withColumnRenamed("vertexId", "vertexID").join(where, FINISH, "left")
    return found.select(*S.REPORT_COLUMNS)
