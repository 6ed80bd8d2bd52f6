"""From frames to segments: range pooling, strided pooling, stacking, means."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector_means(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """keys, vec, n: the mean vector of each key. Each task hands on one sum per key, whatever the rows and dimensions.

    Rows with a null vector or a null component are left out; vectors of a key have one length.
    """
    whole = df.where(F.col(vec).isNotNull() & F.forall(F.col(vec), lambda x: x.isNotNull()))
    summed = whole.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    return summed.groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count("*").alias("n")).select(*keys, vector_to_array("_m").alias("vec"), "n")


#: Vectors up to this width are summed component by component; wider ones as a whole, so that rows don't multiply.
NARROW = 8


def mean_vectors(df: DataFrame, keys: list[str], vec: str = "vec", width: int | None = None) -> DataFrame:
    """keys, dim, value, n: the mean of each component, in long form.

    By way of vector_means, unless width says that the vectors are narrow: then a row per component is
    cheaper than a vector per group (nulls are left out component by component).
    """
    if width is not None and width <= NARROW:
        flat = df.select(*keys, F.posexplode(F.col(vec).cast("array<double>")).alias("dim", "x"))
        return flat.groupBy(*keys, "dim").agg(F.avg("x").alias("value"), F.count("*").alias("n"))
    return vector_means(df, keys, vec).select(*keys, F.posexplode("vec").alias("dim", "value"), "n")


def as_vectors(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Long form (keys, dim, value) back to arrays."""
    at = F.sort_array(F.collect_list(F.struct("dim", F.col(value).alias("x"))))
    return df.groupBy(*keys).agg(F.transform(at, lambda s: s["x"]).alias("vec"))


def segment_pool(frames: DataFrame, segments: DataFrame, utterance: str = "utt_id", keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """utterance, keys, dim, value, n: mean over the frames [first, last) of each segment of an utterance.

    The range is unrolled to (utterance, frame), so the join is an equi-join.
    """
    keys = keys or ["segment_id"]
    spans = segments.where("last > first").select(utterance, *keys, F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("frame"))
    return mean_vectors(spans.join(frames, [utterance, "frame"]), [utterance, *keys], width=width)


def strided_pool(frames: DataFrame, kernel: int, stride: int, utterance: str = "utt_id", keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Mean over frames o * stride .. o * stride + kernel - 1 for each output o with all its frames."""
    keys = keys or []
    low = F.ceil((F.col("frame") - kernel + 1) / stride).cast("long")
    outs = F.sequence(F.greatest(low, F.lit(0)), F.floor(F.col("frame") / stride).cast("long"))
    some = F.floor(F.col("frame") / stride).cast("long") >= F.greatest(low, F.lit(0))
    pooled = mean_vectors(frames.where(some).withColumn("out", F.explode(outs)), [utterance, *keys, "out"], width=width)
    return pooled.where(F.col("n") == kernel)


def stack_frames(frames: DataFrame, k: int, width: int, utterance: str = "utt_id") -> DataFrame:
    """k frames side by side; the last is padded with zeros. Frames count from 0 without gaps."""
    group = F.floor(F.col("frame") / k).cast("long")
    parts = F.sort_array(F.collect_list(F.struct("frame", F.col("vec").cast("array<double>").alias("v"))))
    joined = frames.groupBy(utterance, group.alias("out")).agg(F.flatten(F.transform(parts, lambda s: s["v"])).alias("vec"))
    pad = F.array_repeat(F.lit(0.0), (F.lit(k * width) - F.size("vec")).cast("int"))
    return joined.select(utterance, "out", F.concat("vec", pad).alias("vec"))


def long_form(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    return df.select(*keys, F.posexplode(vec).alias("dim", "value"))


def join_labels(reps: DataFrame, embed: DataFrame, label: Column | str = "label", word: str = "word") -> DataFrame:
    """Inner join of representations with a second view by label."""
    return reps.join(embed, reps[label] == embed[word]) if isinstance(label, str) else reps.join(embed, label == embed[word])


def align_frames(reps: DataFrame, other: DataFrame, utterance: str = "utt_id") -> DataFrame:
    """Frames that both have, as v1 and v2: the longer of two utterances is cut to the shorter."""
    return reps.withColumnRenamed("vec", "v1").join(other.select(utterance, "frame", F.col("vec").alias("v2")), [utterance, "frame"])


def match_rate(fbank: DataFrame, kernel: int, stride: int, utterance: str = "utt_id", width: int | None = None) -> DataFrame:
    """A filterbank brought to a layer's receptive field and stride: utterance, frame, vec."""
    pooled = as_vectors(strided_pool(fbank, kernel, stride, utterance, width=width), [utterance, "out"])
    return pooled.withColumnRenamed("out", "frame")
