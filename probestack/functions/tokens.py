"""Column functions on labels, paths and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that mark silence or noise and are dropped, whatever the tier.
DROPPED_LABELS = ("spn", "sp")


def phone(label: Column) -> Column:
    """Normalised phone: sil becomes SIL; a stress digit at the end goes; lower case."""
    return F.when(label == "sil", F.lit("SIL")).otherwise(F.lower(F.regexp_replace(label, "[012]$", "")))


def is_token(label: Column) -> Column:
    """Whether a normalised label is kept: not empty and not a silence marker."""
    return F.coalesce((F.length(label) > 0) & ~label.isin(*DROPPED_LABELS), F.lit(False))


def audio_path(root: Column | str, utterance: Column, ext: str = "flac") -> Column:
    """root / first two parts of the id / id.ext."""
    base = F.lit(root) if isinstance(root, str) else root
    parts = F.split(utterance, "-")
    return F.concat_ws("/", base, F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.concat(utterance, F.lit(f".{ext}")))


def word_pair(task: Column, fields: Column) -> Column:
    """w1, w2, score of a line of fields; some tasks order or write them their own way."""
    swapped = task == "simverb-3500"
    tagged = task.contains("men")
    cut = lambda w: F.when(tagged, F.substring_index(w, "-", 1)).otherwise(w)
    w1 = F.when(swapped, F.get(fields, F.lit(2))).otherwise(F.get(fields, F.lit(1)))
    w2 = F.when(swapped, F.get(fields, F.lit(3))).otherwise(F.get(fields, F.lit(2)))
    score = F.when(swapped, F.get(fields, F.lit(1))).otherwise(F.get(fields, F.lit(3)))
    return F.struct(cut(w1).alias("w1"), cut(w2).alias("w2"), score.try_cast("double").alias("score"))


def segment_frames(start: Column, end: Column, stride: float, n_frames: Column, middle_third: bool = False) -> tuple[Column, Column]:
    """First and last-but-one frame of a segment: floor and ceil of its times over the stride.

    middle_third leaves out a third at either end; an empty span becomes one frame; a span that ends
    one frame past the end is cut.
    """
    a, b = F.floor(start / stride).cast("long"), F.ceil(end / stride).cast("long")
    if middle_third:
        drop = F.floor((b - a + 1) / 3).cast("long")
        a, b = a + drop, b - drop
    b = F.when(b == a, a + 1).otherwise(b)
    b = F.when(b == n_frames + 1, n_frames).otherwise(b)
    return a, b


def truth_frames(start: Column, end: Column, stride: float, n_frames: Column) -> tuple[Column, Column]:
    """As segment_frames for reference boundaries: both ends are rounded up, one frame at least, then cut to the length.

    A segment that begins at or past the end has no frame: both are null.
    """
    a, b = F.ceil(start / stride).cast("long"), F.ceil(end / stride).cast("long")
    b = F.least(F.when(b <= a, a + 1).otherwise(b), n_frames)
    return F.when(a < b, a), F.when(a < b, b)


def pair_key(task: Column, subtask: Column, pair: Column) -> Column:
    """task_subtask_pair: names a sentence pair across tasks."""
    return F.concat(task.cast("string"), F.lit("_"), subtask.cast("string"), F.lit("_"), pair.cast("string"))
