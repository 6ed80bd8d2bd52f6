"""Adjacent distances over a stream of frames, keyed by utterance, with the last frame as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "utt_id string, frame long, dist double"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pdf = pd.concat(list(batches)).sort_values("frame")
    frames, vecs = pdf["frame"].to_list(), [np.asarray(v, float) for v in pdf["vec"]]
    if state.exists:
        frame, vec = state.get
        frames, vecs = [frame, *frames], [np.asarray(vec, float), *vecs]
    state.update((int(frames[-1]), [float(x) for x in vecs[-1]]))
    rows = [(key[0], f, float(np.sqrt(((a - b) ** 2).sum()))) for f, a, b in zip(frames, vecs, vecs[1:], strict=False)]
    yield pd.DataFrame(rows, columns=["utt_id", "frame", "dist"])


def stream_distances(frames: DataFrame) -> DataFrame:
    """utt_id, frame, dist to the next frame; frames of an utterance must arrive in order across batches."""
    return frames.groupBy("utt_id").applyInPandasWithState(_step, SCHEMA, "frame long, vec array<double>", "append", GroupStateTimeout.NoTimeout)
