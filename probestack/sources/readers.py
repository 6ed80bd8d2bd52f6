"""Readers. Everything that comes in is a DataFrame with a stated schema."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probestack.functions.tokens import is_token, phone, word_pair

#: Layers of the models that can be named, as (contextualised, local).
MODEL_LAYERS = {
    "wav2vec_small": (12, 7),
    "wav2vec_vox": (24, 7),
    "hubert_small": (12, 7),
    "hubert_large": (24, 7),
    "avhubert_small_lrs3": (12, 0),
    "avhubert_small_lrs3_vc2": (12, 0),
    "avhubert_large_lrs3_vc2": (24, 0),
    "wavlm_small": (12, 7),
    "wavlm_large": (24, 7),
    "fastvgs_coco": (8, 0),
    "fastvgs_places": (8, 0),
    "fastvgs_plus_coco": (12, 0),
    "xlsr53_56": (24, 7),
    "xlsr128_300m": (24, 7),
}
#: Kernel and stride that bring a filterbank at 10 ms to each local layer.
RECEPTIVE_FIELDS = {"1": (79, 32), "2": (39, 16), "3": (19, 8), "4": (9, 4), "5": (4, 2), "6": (2, 1), "7": (1, 2), "avhubert0": (4, 4)}


def model_layers(model: str) -> tuple[int, int]:
    if model not in MODEL_LAYERS:
        raise ValueError(f"unknown model {model!r}; known: {', '.join(MODEL_LAYERS)}")
    return MODEL_LAYERS[model]


def model_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, *v) for m, v in MODEL_LAYERS.items()], "model string, contextualized int, local int")


def receptive_fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in RECEPTIVE_FIELDS.items()], "layer string, kernel int, stride int")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, stripped."""
    return spark.read.text(path).select(F.trim(F.col("value"), F.lit(" \t\r\n")).alias("line"))


def read_tsv(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("quote", "").csv(path)


def read_utterances(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, "utt_id string, path string")


def read_word_segments(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, "utt_id string, path string, start_s double, end_s double, word string", ",")


def read_json_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """key, value of a JSON object per file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """By suffix: .json objects, .parquet tables (key, value). Pickles are refused: they run code."""
    if path.endswith(".json"):
        return read_json_map(spark, path, value)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"{path}: give .json or .parquet")


#: A tier's header, and an interval's three fields, in either order of words per line.
_TIER = r'(?s)name\s*=\s*"(phones|words)".*?(?=item\s*\[\d+\]|\z)'
_INTERVAL = r'xmin\s*=\s*([0-9.eE+-]+)\s*xmax\s*=\s*([0-9.eE+-]+)\s*text\s*=\s*"((?:[^"]|"")*)"'


def read_textgrids(spark: SparkSession, path: str, glob: str = "*.TextGrid") -> DataFrame:
    """utt_id, tier, pos, start_s, end_s, text of the tiers phones and words."""
    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    named = files.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^/.]*$", 1).alias("utt_id"), "value")
    tiers = named.select("utt_id", F.explode(F.regexp_extract_all("value", F.lit(_TIER), 0)).alias("body"))
    tiers = tiers.withColumn("tier", F.regexp_extract("body", r'name\s*=\s*"(phones|words)"', 1))
    items = tiers.select("utt_id", "tier", F.posexplode(F.regexp_extract_all("body", F.lit(_INTERVAL), 0)).alias("pos", "item"))
    field = lambda i: F.regexp_extract("item", _INTERVAL, i)
    return items.select("utt_id", "tier", "pos", field(1).cast("double").alias("start_s"), field(2).cast("double").alias("end_s"), F.replace(field(3), F.lit('""'), F.lit('"')).alias("text"))


def alignments(grid: DataFrame) -> DataFrame:
    """Tokens of an alignment grid: phones normalised, empty texts and silence markers dropped."""
    token = F.when(F.col("tier") == "phones", phone(F.col("text"))).otherwise(F.col("text"))
    return grid.where(F.length("text") > 0).select("utt_id", "tier", "pos", "start_s", "end_s", token.alias("token")).where(is_token(F.col("token")))


def read_text_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """word, vec from lines `word v1 v2 ...`; of a word that repeats within a file, the last line counts."""
    lines = spark.read.text(path).select(F.split("value", " ").alias("f"), F.monotonically_increasing_id().alias("at")).where(F.size("f") > 1)
    vec = F.transform(F.slice("f", 2, F.size("f")), lambda x: x.cast("double"))
    return lines.select(F.get("f", F.lit(0)).alias("word"), vec.alias("vec"), "at").groupBy("word").agg(F.max_by("vec", "at").alias("vec"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word, props map<string,double> of lines `word TAB {'name': weight, ...}`; text is parsed, never evaluated."""
    cut = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    return cut.select(F.get("f", F.lit(0)).alias("word"), F.from_json(F.translate(F.get("f", F.lit(1)), "'", '"'), "map<string,double>").alias("props"))


def lexicon_dims(lexicon: DataFrame, order: str | None = None) -> list[str]:
    """Names of properties in order of first appearance (one row per name is collected)."""
    at = F.col(order) if order else F.monotonically_increasing_id()
    names = lexicon.withColumn("_at", at).select("_at", F.posexplode(F.map_keys("props")).alias("_in", "name"))
    first = names.groupBy("name").agg(F.min(F.struct("_at", "_in")).alias("f")).orderBy("f")
    return [r["name"] for r in first.collect()]


def read_word_pairs(spark: SparkSession, path: str) -> DataFrame:
    """task, w1, w2, score of the CSV files in a folder, named by task; headers and empty first words are dropped."""
    lines = spark.read.text(path, pathGlobFilter="*.csv").withColumn("task", F.regexp_extract(F.input_file_name(), r"([^/]+?)\.csv$", 1))
    pairs = lines.select("task", word_pair(F.col("task"), F.split("value", ",")).alias("p")).select("task", "p.*")
    return pairs.where((F.length("w1") > 0) & F.col("score").isNotNull())


def read_matrices(spark: SparkSession, path: str, glob: str = "layer_*.npy") -> DataFrame:
    """path, layer, row_id, vec of .npy matrices, a row per matrix row; decoded in the tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                m = np.load(io.BytesIO(content), allow_pickle=False)
                for at in range(0, len(m), 1000):
                    part = m[at : at + 1000]
                    yield pd.DataFrame({"path": name, "row_id": np.arange(at, at + len(part)), "vec": list(part.astype(np.float32))})

    rows = files.mapInPandas(decode, "path string, row_id long, vec array<float>")
    return rows.select("path", F.regexp_extract("path", r"layer_(\d+)\.npy$", 1).try_cast("int").alias("layer"), "row_id", "vec")


def frame_lengths(frames: DataFrame) -> DataFrame:
    return frames.groupBy("utt_id").agg((F.max("frame") + 1).alias("n_frames"))


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """row_id, fold of files split0.lst, split1.lst, ... with a row number per line."""
    lines = spark.read.text(path, pathGlobFilter="split*.lst").withColumn("fold", F.regexp_extract(F.input_file_name(), r"split(\d+)\.lst$", 1).try_cast("int"))
    return lines.select(F.trim("value").try_cast("long").alias("row_id"), "fold").where("row_id is not null and fold is not null")


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """Stored projections (keys, side, direction, dim, value), as write_table has written cca_parameters."""
    return spark.read.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """All shards that write_shards has written below a folder, as one table with column shard."""
    return spark.read.parquet(path)


def list_audio(spark: SparkSession, path: str, ext: str = "flac", depth: int | None = None) -> DataFrame:
    """utt_id, path of the audio files below a folder, at some depth of folders or any; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}")
    files = reader.option("recursiveFileLookup", True).load(path) if depth is None else reader.load(path.rstrip("/") + "/*" * depth + f"/*.{ext}")
    return files.select(F.regexp_extract("path", r"([^/.]+)[^/]*$", 1).alias("utt_id"), "path")


def extract(utterances: DataFrame, encode: Callable[[pd.DataFrame], Iterator[tuple[int, int, np.ndarray]]], model: str = "toy") -> DataFrame:
    """model, layer, utt_id, frame, vec: an encoder as a source.

    encode gets one utterance (a one-row frame of utterances) and yields (layer, frame, vector). Model
    inference is opaque to the engine; layers come out as rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                one = pdf.iloc[i : i + 1]
                rows = [(model, layer, one["utt_id"].iloc[0], frame, vec.astype(np.float32)) for layer, frame, vec in encode(one)]
                yield pd.DataFrame(rows, columns=["model", "layer", "utt_id", "frame", "vec"])

    return utterances.mapInPandas(run, "model string, layer int, utt_id string, frame long, vec array<float>")


def toy_encoder(layers: int = 3, dims: int = 4) -> Callable[[pd.DataFrame], Iterator[tuple[int, int, np.ndarray]]]:
    """A deterministic encoder for tests: one frame per character of the id."""

    def encode(one: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray]]:
        for layer in range(layers):
            for frame, c in enumerate(one["utt_id"].iloc[0]):
                yield layer, frame, np.cos((layer + 1) * ord(c) * np.arange(1, dims + 1) / 10)

    return encode


def with_order(df: DataFrame, utterance: str, *order: str) -> DataFrame:
    """df with frame, counted from 0 within each utterance."""
    return df.withColumn("frame", (F.row_number().over(Window.partitionBy(utterance).orderBy(*order)) - 1).cast("long"))
