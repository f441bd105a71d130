"""CNV-7 as a stream: the answers of many responses while their frames arrive, in whatever order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.conversations import parse_frames

COLUMNS = ["response_id", "from_seq", "to_seq", "text", "done", "total_tokens"]
PIECE = "response_id string, from_seq bigint, to_seq bigint, text string, done boolean, total_tokens bigint"


class Answers(StatefulProcessor):
    """Per response: the number of the next frame, and frames that came before their turn.

    Each call emits the gap-free run of frames that is there, as one piece of text; a frame that comes twice counts once. With
    ``timeout_ms``, a frame still missing so long after others came is given up: what waits behind it follows in order.
    """

    def __init__(self, first: int, timeout_ms: int | None) -> None:
        self.first, self.timeout_ms = first, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "seq bigint")
        self.waiting = handle.getMapState("waiting", "seq bigint", "delta string, done boolean, total_tokens bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else self.first
        frames = {r[0][0]: tuple(r[1]) for r in self.waiting.iterator()} if self.waiting.exists() else {}
        held = set(frames)
        for pdf in rows:
            for seq, *frame in zip(pdf["seq"], pdf["delta"], pdf["done"], pdf["total_tokens"]):
                if seq >= at and seq not in frames:
                    delta, done, tokens = frame
                    frames[int(seq)] = (None if pd.isna(delta) else delta, bool(done), None if pd.isna(tokens) else int(tokens))
        run = []
        while at + len(run) in frames:
            run.append(at + len(run))
        for seq in run:
            if seq in held:
                self.waiting.removeKey((seq,))
        for seq in frames.keys() - held - set(run):
            self.waiting.updateValue((seq,), frames[seq])
        self.next.update((at + len(run),))
        if self.timeout_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if len(frames) > len(run):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield from self._piece(key, run, frames)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        frames = {r[0][0]: tuple(r[1]) for r in self.waiting.iterator()} if self.waiting.exists() else {}
        if frames:
            self.waiting.clear()
            self.next.update((max(frames) + 1,))
        yield from self._piece(key, sorted(frames), frames)

    @staticmethod
    def _piece(key, run: list[int], frames: dict[int, tuple]) -> Iterator[pd.DataFrame]:
        if run:
            tokens = [frames[s][2] for s in run if frames[s][2] is not None]
            text = "".join(frames[s][0] for s in run if frames[s][0] is not None)
            yield pd.DataFrame([(key[0], run[0], run[-1], text, any(frames[s][1] for s in run), tokens[-1] if tokens else None)], columns=COLUMNS).astype({"total_tokens": "Int64"})

    def close(self) -> None:
        pass


def stream_answers(frames: DataFrame, first: int = 0, timeout_ms: int | None = None) -> DataFrame:
    """CNV-7, streaming form: pieces (response_id, from_seq, to_seq, text, done, total_tokens) as soon as they are whole.

    frames (response_id, seq from ``first`` on without a gap, block). Needs the RocksDB state store, see ``firings.STATE_STORE``.
    A time-out runs on the clock, so such a stream is one that goes on: with ``availableNow`` it would not end.
    """
    parsed = parse_frames(frames).select("response_id", F.col("seq").cast("bigint").alias("seq"), "delta", "done", F.col("usage.total_tokens").alias("total_tokens"))
    return parsed.groupBy("response_id").transformWithStateInPandas(
        statefulProcessor=Answers(first, timeout_ms), outputStructType=PIECE, outputMode="append", timeMode="None" if timeout_ms is None else "ProcessingTime"
    )


def whole_answers(pieces: DataFrame) -> DataFrame:
    """(response_id, content, done, total_tokens) of the pieces written so far, as ``conversations.assemble_stream`` gives them."""
    return pieces.groupBy("response_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("from_seq", "text"))), lambda p: p["text"]), "").alias("content"),
        F.bool_or("done").alias("done"),
        F.max_by("total_tokens", F.when(F.col("total_tokens").isNotNull(), F.col("from_seq"))).alias("total_tokens"),
    )
