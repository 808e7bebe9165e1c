"""The log operators on unbounded input, with Structured Streaming.

The same rules as the batch versions; tests hold both against each other on the same rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seqmill.operators.chips import Decoder


def onset_windows(stream: DataFrame, clock: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Onsets by tumbling window; rows later than ``late`` behind the watermark no longer count."""
    return stream.withWatermark(clock, late).groupBy(F.window(clock, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("begins"), "n")


def onset_sessions(stream: DataFrame, clock: str, key: str, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Rows of a key that lie within ``gap`` of one another are one session."""
    return stream.withWatermark(clock, late).groupBy(F.session_window(clock, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("begins"), "n")


def first_contents(stream: DataFrame, clock: str, content: str, late: str = "1 hour") -> DataFrame:
    """Each content once while the watermark remembers it."""
    hashed = stream.withColumn("content_hash", F.sha2(F.col(content), 256)).withWatermark(clock, late)
    return hashed.dropDuplicatesWithinWatermark(["content_hash"])


_INTERVAL = "key long, begins long, ends long, retriggered boolean"


def _pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the start of the open interval. Rows of a batch are put in order; a batch never goes back in time."""
    begun = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    out = []
    for clock, on in zip(rows["clock"], rows["on"], strict=True):
        if begun is not None:
            out.append((key[0], begun, clock, bool(on)))
        begun = int(clock) if on else None
    if begun is None:
        if state.exists:
            state.remove()
    else:
        state.update((begun,))
    yield pd.DataFrame(out, columns=["key", "begins", "ends", "retriggered"])


def intervals(stream: DataFrame, key: str, seq: str, clock: str, opens, closes) -> DataFrame:
    """Closed intervals as soon as they close: an opening ends at the next opening (retrigger) or closing."""
    edges = stream.select(F.col(key).cast("long").alias("key"), F.col(seq).alias("seq"), F.col(clock).alias("clock"), F.when(opens, True).when(closes, False).alias("on")).where("on IS NOT NULL")
    return edges.groupBy("key").applyInPandasWithState(_pair, _INTERVAL, "begun long", "append", GroupStateTimeout.NoTimeout)


def _changed(idle: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """State: the register's last value; idle for long, it is forgotten."""
        columns = ["track", "register", "seq", "value"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns).astype({"value": "Int64"})
            return
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        last = state.get[0] if state.exists else None
        out = []
        for seq, value in zip(rows["seq"], rows["value"], strict=True):
            value = None if pd.isna(value) else int(value)
            if not state.exists and not out or value != last:
                out.append((key[0], key[1], int(seq), value))
            last = value
        state.update((last,))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=columns).astype({"value": "Int64"})

    return run


def _timeout(idle: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout


def register_changes(stream: DataFrame, track: str, register: str, seq: str, value: str, idle: int | None = None) -> DataFrame:
    """Rows whose value is not the register's last one; the first of each register always.

    A register's last value is kept as long as the stream runs, or until nothing came for ``idle``
    milliseconds; the next row is a first one then.
    """
    rows = stream.select(F.col(track).cast("long").alias("track"), F.col(register).alias("register"), F.col(seq).cast("long").alias("seq"), F.col(value).cast("long").alias("value"))
    return rows.groupBy("track", "register").applyInPandasWithState(_changed(idle), "track long, register string, seq long, value long", "last long", "append", _timeout(idle))


_NOTE = "track_id string, emit int, channel int, pitch int, velocity int, sample_on long, sample_off long, patch array<int>, dac_sample_id long, noise_mode int"


def _decoded(idle: int | None):
    fields = ["channel", "pitch", "velocity", "sample_on", "sample_off", "patch", "dac_sample_id", "noise_mode"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """State: both chips' registers and open notes, and how many notes were put out; nothing of a track that has ended."""
        decoder, emit = pickle.loads(state.get[0]) if state.exists else (Decoder(), 0)
        found: list = []
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
            for kind, register, value, offset in zip(rows["type"], rows["register"], rows["value"], rows["pcm_offset"], strict=True):
                found += decoder.feed(int(kind), int(register), int(value), None if pd.isna(offset) else int(offset))
                if decoder.ended:
                    break
        if decoder.ended or state.hasTimedOut:
            found += decoder.finish()
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps((decoder, emit + len(found))),))
            if idle is not None:
                state.setTimeoutDuration(idle)
        frame = pd.DataFrame([(key[0], emit + k, *(getattr(n, f) for f in fields)) for k, n in enumerate(found)], columns=["track_id", "emit", *fields])
        yield frame.astype({"pitch": "Int32", "dac_sample_id": "Int64", "sample_off": "Int64"})

    return run


def decode_notes(stream: DataFrame, idle: int | None = None) -> DataFrame:
    """Notes of event rows (track_id, seq, type, register, value, pcm_offset) as they close, the rest at a track's end mark.

    What is kept of a track is the register file and its open notes, until its end mark, or until nothing
    came of it for ``idle`` milliseconds: its open notes are put out then. With ``idle`` the query has to
    run on a trigger that comes again: one that stops when all is read never does, as state may yet time out. Rows of a track after its end are
    dropped within a batch; in a later batch they begin a track anew. A batch never goes back in a track.
    """
    rows = stream.select("track_id", F.col("seq").cast("long").alias("seq"), F.col("type").cast("int").alias("type"), F.col("register").cast("int").alias("register"), F.col("value").cast("int").alias("value"), F.col("pcm_offset").cast("long").alias("pcm_offset"))
    return rows.groupBy("track_id").applyInPandasWithState(_decoded(idle), _NOTE, "chips binary", "append", _timeout(idle))
