"""Sessions of recurring exceptions: a storm of similar ones is one open event, small deltas, and one close event.

Exceptions cluster by the assertions they break and the pattern where. In the order of documents, the first of a cluster
opens a session; a later one ``fit``s if its shape was seen in the session, else it ``grow``s the session by it. After
``idle`` without one, or when the set of assertions (``config``) is another, the session is closed and the next exception
opens a new one (of both reasons ``evicted`` counts); what is open at the end of the stream closes with it.

``session_stream`` keeps one state a cluster, with a timer on event time that evicts it; ``close_open`` reads what is left
from the stored state. ``session_events`` gives the events of a whole table at once, by windows within blocks of
documents, so that no cluster is one task. Both give the same rows (see ``EVENT``) for the same order of documents.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.storage import materialize

#: ``observed`` of a delta is null where it is what the session was opened with; ``shape`` is the occurrence's at open and
#: grow; close has the counts.
EVENT = "session string, event string, refs array<string>, pattern string, ord long, path string, observed string, shape string, reason string, occurrences long, first long, last long"
_STATE = "id string, config string, opened string, shapes array<string>, first long, last long, last_ms long, occurrences long"
_BLOCK_BITS = 16


#: Rows that go into and come out of the state in one piece, as Arrow bytes; rows of a piece that comes out at most.
_PACK, _EVENTS, _OUT_ROWS = "refs array<string>, pattern string, at timestamp, data binary", "refs array<string>, pattern string, data binary", 1 << 16
_TEXTS = ("config", "path", "observed", "shape")


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.BufferReader(bytes(data))).read_all()


def _pack(batches):
    """Of each batch one row a cluster: (refs, pattern, its latest moment, its rows)."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        cluster = rows["cluster"].combine_chunks().dictionary_encode()
        data = rows.select(["ord", "ms"])
        for c in _TEXTS:
            data = data.append_column(c, rows[c].cast(pa.large_string()))
        for code in range(len(cluster.dictionary)):
            at = np.flatnonzero(cluster.indices.to_numpy() == code)
            some = rows.take(at)
            yield pa.RecordBatch.from_arrays([some["refs"].slice(0, 1).combine_chunks(), some["pattern"].slice(0, 1).combine_chunks(), pa.array([pc.max(some["at"]).as_py()], some["at"].type), pa.array([_packed(data.take(at))], pa.binary())], names=["refs", "pattern", "at", "data"])


def _unpack(batches):
    """The rows of ``EVENT`` from what the state gave."""
    for batch in batches:
        for k, data in enumerate(batch.column("data")):
            events = _unpacked(data.as_py())
            zeros = np.zeros(len(events), dtype=np.int64)
            for c in ("pattern", "refs"):
                events = events.add_column(2, c, batch.column(c).slice(k, 1).take(pa.array(zeros)))
            yield from events.combine_chunks().to_batches()


def _events(session, event, ord_=None, path=None, observed=None, shape=None, reason=None, occurrences=None, first=None, last=None) -> pa.Table:
    n = len(session)
    text, number = ((lambda x, t=t: pa.nulls(n, t) if x is None else pa.array(x, t) if not isinstance(x, pa.ChunkedArray | pa.Array) else x.cast(t)) for t in (pa.string(), pa.int64()))
    return pa.table({"session": text(session), "event": text(event), "ord": number(ord_), "path": text(path), "observed": text(observed), "shape": text(shape), "reason": text(reason), "occurrences": number(occurrences), "first": number(first), "last": number(last)})


def _codes(column: pa.ChunkedArray, also) -> tuple[np.ndarray, pa.Array, int]:
    """Numbers of equal values, nulls alike; the values; the number of ``also``, or -1."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    values = coded.dictionary
    at = np.flatnonzero(~values.is_valid().to_numpy(zero_copy_only=False)) if also is None else pc.indices_nonzero(pc.fill_null(pc.equal(values, pa.scalar(also, values.type)), False)).to_numpy()
    return coded.indices.to_numpy().astype(np.int64), values, int(at[0]) if len(at) else -1


class _Sessions(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("session", _STATE)

    def _told(self, key, events: pa.Table) -> Iterator[Row]:
        refs, pattern = key
        for at in range(0, len(events), _OUT_ROWS):
            yield Row(refs=list(refs), pattern=pattern, data=_packed(events.slice(at, _OUT_ROWS)))

    def _close(self, state: tuple, reason: str) -> pa.Table:
        return _events([state[0]], ["close"], reason=[reason], occurrences=[state[7]], first=[state[4]], last=[state[5]])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        refs, pattern = key
        state = tuple(self.state.get()) if self.state.exists() else None
        before = state[6] if state else None
        found = pa.concat_tables([_unpacked(r.data) for r in rows])  # one cluster's rows of one micro-batch
        found = found.take(pc.sort_indices(found, [("ord", "ascending"), ("path", "ascending")]))
        ord_, ms = found["ord"].to_numpy(), found["ms"].to_numpy()
        config, configs, own_config = _codes(found["config"], state[1] if state else None)
        shape, shapes, _ = _codes(found["shape"], None)
        observed, _, own_opened = _codes(found["observed"], state[2] if state else None)
        gap = np.diff(ms, prepend=state[6] if state else ms[0]) > self.idle_ms
        starts = gap | (np.diff(config, prepend=own_config if state else config[0]) != 0)
        starts[0] |= state is None
        begin = np.flatnonzero(starts)
        if state:
            yield from self._told(key, self._close(state, "evicted" if gap[0] else "config_changed")) if starts[0] else ()
            state = None if starts[0] else state
        # session 0 is the one that was open, if it goes on
        nth = np.cumsum(starts) - (state is None)
        names = ([state[0]] if state else []) + ["|".join((*refs, pattern, str(x))) for x in ord_[begin].tolist()]
        opened = np.concatenate([[own_opened] * (state is not None), observed[begin]]).astype(np.int64)
        new = np.zeros(len(nth), dtype=bool)
        new[np.unique(nth * len(shapes) + shape, return_index=True)[1]] = True
        if state:
            new &= ~((nth == 0) & np.isin(shape, [i for i, x in enumerate(shapes.to_pylist()) if x in state[3]]))
        event = pa.array(["fit", "grow", "open"]).take(pa.array(np.where(starts, 2, new)))
        masked = lambda c, hidden: pc.if_else(pa.array(hidden), pa.scalar(None, found[c].type), found[c])
        yield from self._told(key, _events(pa.array(names).take(pa.array(nth)), event, found["ord"], found["path"], masked("observed", ~starts & (observed == opened[nth])), masked("shape", ~new)))
        # where each session has its first row here, how many it has, and what the open one had before
        edge = np.concatenate([[0] * (state is not None), begin, [len(nth)]]).astype(np.int64)
        count, first, last = np.diff(edge), ord_[edge[:-1]], ord_[edge[1:] - 1]
        if state:
            count[0] += state[7]
            first[0] = state[4]
        if len(names) > 1:
            yield from self._told(key, _events(names[:-1], ["close"] * (len(names) - 1), reason=np.where(gap[edge[1:-1]], "evicted", "config_changed").tolist(), occurrences=count[:-1], first=first[:-1], last=last[:-1]))
        tail = slice(int(edge[-2]), None)
        goes_on = state is not None and len(names) == 1
        seen = list(state[3]) if goes_on else []
        seen += shapes.take(pa.array(shape[tail][new[tail]])).to_pylist()
        text = state[2] if goes_on else found["observed"][tail.start].as_py()
        now = (names[-1], configs[int(config[-1])].as_py(), text, seen, int(first[-1]), int(last[-1]), int(ms[-1]), int(count[-1]))
        self.state.update(now)
        if before is not None:
            self.handle.deleteTimer(before + self.idle_ms + 1)
        self.handle.registerTimer(now[6] + self.idle_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            yield from self._told(key, self._close(tuple(self.state.get()), "evicted"))
            self.state.clear()

    def close(self) -> None:
        pass


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Queries that start in here keep their state in RocksDB, which sessions need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def session_stream(found: DataFrame, idle_seconds: int, late_seconds: int = 0) -> DataFrame:
    """Events of a stream of exceptions (ord, at, config, refs, pattern, path, observed, shape); ``at`` is event time.

    Rows of one micro-batch are put in the order of ``ord``, micro-batches come in theirs; rows that are behind the
    watermark by more than ``late_seconds`` are Spark's to drop, together with those they travel with. Rows go to the state
    and events come from it in pieces of many, so that little is done for each alone.
    """
    rows = found.select("ord", "at", "config", "refs", "pattern", "path", "observed", "shape", F.unix_millis("at").alias("ms"), F.to_json(F.struct("refs", "pattern")).alias("cluster"))
    packs = rows.mapInArrow(_pack, _PACK).withWatermark("at", f"{late_seconds} seconds")
    events = packs.groupBy("refs", "pattern").transformWithState(_Sessions(idle_seconds * 1000), _EVENTS, "append", "eventTime")
    return events.mapInArrow(_unpack, EVENT)


def close_open(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Close events (``stream_end``) of the sessions that a stopped stream left open, from its checkpoint."""
    left = spark.read.format("statestore").option("stateVarName", "session").load(checkpoint)
    null = lambda kind: F.lit(None).cast(kind)
    return left.select(
        F.col("value.id").alias("session"), F.lit("close").alias("event"), "key.refs", "key.pattern", null("long").alias("ord"), null("string").alias("path"), null("string").alias("observed"),
        null("string").alias("shape"), F.lit("stream_end").alias("reason"), "value.occurrences", "value.first", "value.last",
    )


def _numbered(found: DataFrame) -> DataFrame:
    """``found`` with ``nth``, the number of its session in its cluster: breaks are counted within blocks of documents,
    and carried from block to block over one row a block."""
    key = ("refs", "pattern")
    rows = found.withColumn("ms", F.unix_millis("at")).withColumn("block", F.shiftright("ord", _BLOCK_BITS))
    here = Window.partitionBy(*key, "block").orderBy("ord", "path")
    broke = lambda ms, config: (F.col("ms") - ms > F.col("idle_ms")) | (F.col("config") != config)
    rows = rows.withColumn("starts", F.coalesce(broke(F.lag("ms").over(here), F.lag("config").over(here)), F.lit(False)).cast("long"))
    at = F.struct("ord", "path")
    blocks = rows.groupBy(*key, "block", "idle_ms").agg(F.min_by("ms", at).alias("ms"), F.min_by("config", at).alias("config"), F.max_by("ms", at).alias("end_ms"), F.max_by("config", at).alias("end_config"), F.sum("starts").alias("breaks"))
    over = Window.partitionBy(*key).orderBy("block")
    blocks = blocks.withColumn("starts_new", F.coalesce(broke(F.lag("end_ms").over(over), F.lag("end_config").over(over)), F.lit(False)).cast("long"))
    blocks = blocks.withColumn("base", F.sum(F.col("starts_new") + F.col("breaks")).over(over) - F.col("breaks"))
    rows = rows.join(blocks.select(*key, "block", "base"), [*key, "block"])
    return rows.withColumn("nth", F.col("base") + F.sum("starts").over(here))


def session_events(found: DataFrame, idle_seconds: int, until: Column | None = None) -> DataFrame:
    """The events of a table of exceptions (ord, at, config, refs, pattern, path, observed, shape).

    until: the last moment that was looked at; a session idle since before then counts as evicted, others as open to the
    end. Without it every cluster's last session is open to the end.
    """
    rows = _numbered(materialize(found).withColumn("idle_ms", F.lit(idle_seconds * 1000)))  # read several times
    session, at = ("refs", "pattern", "nth"), F.struct("ord", "path")
    whole = rows.groupBy(*session).agg(F.min_by(F.struct("ord", "path", "observed", "ms"), at).alias("opened"), F.max_by("ms", at).alias("end_ms"), F.max("ord").alias("last"), F.count("*").alias("occurrences"))
    whole = whole.withColumn("session", F.concat_ws("|", "refs", "pattern", F.col("opened.ord")))
    shapes = rows.groupBy(*session, "shape").agg(F.min(at).alias("seen"))
    some = rows.join(whole.select(*session, "session", "opened"), [*session]).join(shapes, [*session, "shape"])
    first, new = at == F.struct("opened.ord", "opened.path"), at == F.col("seen")
    occurred = some.select(
        "session", F.when(first, "open").when(new, "grow").otherwise("fit").alias("event"), "refs", "pattern", "ord", "path",
        F.when(first | ~F.col("observed").eqNullSafe(F.col("opened.observed")), F.col("observed")).alias("observed"), F.when(new, F.col("shape")).alias("shape"),
        *(F.lit(None).cast(t).alias(c) for c, t in (("reason", "string"), ("occurrences", "long"), ("first", "long"), ("last", "long"))),
    )
    follows = F.lead("opened.ms").over(Window.partitionBy("refs", "pattern").orderBy("nth"))  # one row a session
    idle = F.lit(False) if until is None else F.col("end_ms") + idle_seconds * 1000 < F.unix_millis(until)
    broken = F.when(follows - F.col("end_ms") > idle_seconds * 1000, "evicted").otherwise("config_changed")
    reason = F.when(follows.isNull(), F.when(idle, "evicted").otherwise("stream_end")).otherwise(broken)
    closed = whole.withColumn("reason", reason).select(
        "session", F.lit("close").alias("event"), "refs", "pattern", *(F.lit(None).cast(t).alias(c) for c, t in (("ord", "long"), ("path", "string"), ("observed", "string"), ("shape", "string"))),
        "reason", "occurrences", F.col("opened.ord").alias("first"), "last",
    )
    return occurred.unionByName(closed)
