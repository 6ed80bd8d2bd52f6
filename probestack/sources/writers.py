"""Writers: partitioned Parquet, text and JSON through Spark's own sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_layers(reps: DataFrame, path: str) -> None:
    """Representations by model and layer, so that reading one layer reads one folder."""
    write_table(reps, path, [c for c in ("model", "layer") if c in reps.columns])


def write_shards(segments: DataFrame, path: str) -> None:
    write_table(segments, path, ["shard"])


def write_scores(scores: DataFrame, path: str, digits: int = 3) -> None:
    """Append scores, rounded."""
    value = F.round("value", digits).alias("value")
    scores.select(*[value if c == "value" else F.col(c) for c in scores.columns]).write.mode("append").parquet(path)


def write_lines(df: DataFrame, path: str, *columns: str, sep: str = "\t", mode: str = "overwrite") -> None:
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in columns])).write.mode(mode).text(path)


def write_spans(spans: DataFrame, path: str) -> None:
    """Lines `start end xxx` in 10 ms units, a folder per utterance."""
    line = F.concat_ws(" ", F.col("start_u").cast("string"), F.col("end_u").cast("string"), F.lit("xxx"))
    spans.select("utt_id", line.alias("value")).write.mode("overwrite").partitionBy("utt_id").text(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_alignments(tokens: DataFrame, path: str, tier: str, split: str) -> None:
    """Tokens (utt_id, audio_path, start_s, end_s, token) of a tier and split: TSV lines, and JSON rows by token.

    The rows of a token lie in its folder, one per line, so that a frequent token is never one value.
    """
    write_lines(tokens, f"{path}/alignment_{tier}_{split}.tsv", "utt_id", "start_s", "end_s", "token")
    tokens.select("token", "utt_id", "audio_path", "start_s", "end_s").write.mode("overwrite").partitionBy("token").json(f"{path}/alignment_{tier}_{split}.json")


def score_path(path: str, mean_of_views: bool = False) -> str:
    """Where scores go: those of the mean of views are kept apart by a _mean before the suffix."""
    stem, dot, suffix = path.rpartition(".")
    if "/" in suffix or not dot:
        stem, dot, suffix = path, "", ""
    return f"{stem}_mean{dot}{suffix}" if mean_of_views else path


def write_best(best: DataFrame, path: str, key: str = "layer") -> None:
    """The best setting of each layer as JSON rows: metric, window, prominence and f1."""
    write_json(best.select(key, F.col("kind").alias("distance metrics"), F.col("window").alias("avg pooling window size"), "prominence", F.col("f1").alias("f1 score")), path)
