"""Keyed state of the status-log stream: what of a run's log is kept, and the state that follows from it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from landwatch.schema import RUN_STATUSES

START, DONE = RUN_STATUSES["FetchingImagery"], (RUN_STATUSES["Completed"], RUN_STATUSES["Failed"])
RUN_STATE = "run_id string, status int, started_at bigint, completed_at bigint, before_scene_id string"
NO_TIME = -(2 ** 63)  # rows without a time come first

Step = tuple[int, int, int | None]  # at, seq, status


def needed(steps: list[Step]) -> list[Step]:
    """The steps, in order, that can still matter, whatever rows come later.

    These are the last step into a final status, the steps of that status right before it, the one step of
    another status before those, and all steps behind. What is older stays behind a step of another status for ever,
    so the needed steps of a union are those of the union of needed steps.
    """
    steps = sorted(set(steps), key=lambda s: (s[0], s[1], s[2] is not None, s[2] or 0))
    last = next((i for i in range(len(steps) - 1, -1, -1) if steps[i][2] in DONE), None)
    if last is None:
        return steps
    other = next((i for i in range(last - 1, -1, -1) if steps[i][2] != steps[last][2]), 0)
    return steps[other:]


def completed(steps: list[Step]) -> int | None:
    """Time of the last change into a final status, of steps in order."""
    at = None
    for i, step in enumerate(steps):
        if step[2] in DONE and (i == 0 or steps[i - 1][2] != step[2]):
            at = step[0]
    return None if at == NO_TIME else at


def steps_of(rows: pd.DataFrame) -> list[Step]:
    at, seq = rows["at"].astype("Int64").fillna(NO_TIME), rows["seq"].astype("Int64").fillna(NO_TIME)
    status = rows["status"].astype("Int64")
    return [(int(a), int(s), None if pd.isna(v) else int(v)) for a, s, v in zip(at, seq, status)]


def thinned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a batch without those that other rows of the batch make needless."""
    for batch in batches:
        keep = []
        for _, rows in batch.groupby("run_id", sort=False, dropna=False):
            steps = steps_of(rows)
            must = set(needed(steps))
            starts = [s[:2] for s in steps if s[2] == START and s[0] != NO_TIME]
            texts = [s[:2] for s, text in zip(steps, rows["before_scene_id"]) if text]
            must_at = {min(starts) if starts else None, max(texts) if texts else None}
            keep += [i for i, s in zip(rows.index, steps) if s in must or s[:2] in must_at]
        yield batch.loc[sorted(keep)]


class RunFold(StatefulProcessor):
    """State of a run: its needed steps, the first start and the last scene text with its place."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.steps = handle.getListState("steps", "at bigint, seq bigint, status int", self.keep_ms)
        self.facts = handle.getValueState("facts", "started bigint, scene string, scene_at bigint, scene_seq bigint", self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterable[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        steps = [tuple(s) for s in self.steps.get()] if self.steps.exists() else []
        started, scene, *place = self.facts.get() if self.facts.exists() else (None, None, None, None)
        for batch in rows:
            new = steps_of(batch)
            for (at, seq, status), text in zip(new, batch["before_scene_id"]):
                if status == START and at != NO_TIME and (started is None or at < started):
                    started = at
                if text and (scene is None or (at, seq) >= tuple(place)):
                    scene, place = text, [at, seq]
            steps = needed(steps + new)
        self.steps.put(steps)
        self.facts.update((started, scene, *place))
        whole = lambda v: pd.array([v], dtype="Int64")
        yield pd.DataFrame({"run_id": [key[0]], "status": pd.array([steps[-1][2]], dtype="Int32"), "started_at": whole(started),
                            "completed_at": whole(completed(steps)), "before_scene_id": [scene]})

    def close(self) -> None:
        pass
