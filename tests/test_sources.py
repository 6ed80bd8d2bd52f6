import json

import numpy as np
import pytest

from probestack.sources import audio, readers, writers
from probestack.streaming.boundaries import stream_distances

GRID = '''File type = "ooTextFile"
item []:
    item [1]:
        class = "IntervalTier"
        name = "words"
        intervals [1]:
            xmin = 0.0
            xmax = 0.5
            text = "say ""hi"""
        intervals [2]:
            xmin = 0.5
            xmax = 0.7
            text = ""
    item [2]:
        class = "IntervalTier"
        name = "phones"
        intervals [1]:
            xmin = 0.0
            xmax = 0.2
            text = "AH0"
        intervals [2]:
            xmin = 0.2
            xmax = 0.7
            text = "spn"
'''


def test_alignment_grids(spark, tmp_path):
    (tmp_path / "1" / "2").mkdir(parents=True)
    (tmp_path / "1" / "2" / "1-2-0003.TextGrid").write_text(GRID)
    grid = readers.read_textgrids(spark, str(tmp_path))
    got = sorted((r.utt_id, r.tier, r.pos, r.start_s, r.end_s, r.text) for r in grid.collect())
    assert got == [("1-2-0003", "phones", 0, 0.0, 0.2, "AH0"), ("1-2-0003", "phones", 1, 0.2, 0.7, "spn"), ("1-2-0003", "words", 0, 0.0, 0.5, 'say "hi"'), ("1-2-0003", "words", 1, 0.5, 0.7, "")]
    assert sorted((r.tier, r.token) for r in readers.alignments(grid).collect()) == [("phones", "ah"), ("words", 'say "hi"')]


def test_text_formats(spark, tmp_path):
    (tmp_path / "e.txt").write_text("cat 1 2\ndog 3 4\ncat 5 6\n")
    assert {r.word: r.vec for r in readers.read_text_embeddings(spark, str(tmp_path / "e.txt")).collect()} == {"cat": [5, 6], "dog": [3, 4]}
    (tmp_path / "l.tsv").write_text("a\t{'x': 1}\nb\t{'y': 2.5, 'x': 3}\n")
    lex = readers.read_lexicon(spark, str(tmp_path / "l.tsv"))
    assert readers.lexicon_dims(lex) == ["x", "y"] and lex.count() == 2
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "rw.csv").write_text("id,w1,w2,score\n1,a,b,2.5\n2,,b,1\n")
    assert [tuple(r) for r in readers.read_word_pairs(spark, str(tmp_path / "p")).collect()] == [("rw", "a", "b", 2.5)]
    (tmp_path / "m.json").write_text(json.dumps({"a": "1", "b": "2"}))
    assert {r.key: r.value for r in readers.read_map(spark, str(tmp_path / "m.json")).collect()} == {"a": "1", "b": "2"}
    with pytest.raises(ValueError):
        readers.read_map(spark, "x.pkl")
    (tmp_path / "u.tsv").write_text("u1\t/p/u1\n")
    assert tuple(readers.read_utterances(spark, str(tmp_path / "u.tsv")).first()) == ("u1", "/p/u1")
    (tmp_path / "s.csv").write_text("u1,/p,0.5,1.5,word\n")
    assert tuple(readers.read_word_segments(spark, str(tmp_path / "s.csv")).first()) == ("u1", "/p", 0.5, 1.5, "word")
    (tmp_path / "w.lst").write_text(" one \ntwo\n")
    assert [r.line for r in readers.read_lines(spark, str(tmp_path / "w.lst")).collect()] == ["one", "two"]


def test_matrices_and_layers(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    (tmp_path / "in").mkdir()
    np.save(tmp_path / "in" / "layer_7.npy", m)
    rows = readers.read_matrices(spark, str(tmp_path / "in"))
    assert [(r.layer, r.row_id, r.vec) for r in rows.orderBy("row_id").collect()] == [(7, i, m[i].tolist()) for i in range(4)]
    writers.write_layers(rows.drop("path"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).where("layer = 7")
    assert back.count() == 4 and "PartitionFilters: [isnotnull(layer" in back._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="unknown model"):
        readers.model_layers("nothing")
    assert readers.model_layers("wavlm_large") == (24, 7)


def test_encoder_source_and_writers(spark, tmp_path):
    utts = spark.createDataFrame([("ab",), ("xyz",)], "utt_id string")
    reps = readers.extract(utts, readers.toy_encoder(2, 3))
    assert reps.count() == 2 * 5 and {len(r.vec) for r in reps.collect()} == {3}
    assert {r.utt_id: r.n_frames for r in readers.frame_lengths(reps).collect()} == {"ab": 2, "xyz": 3}
    spans = spark.createDataFrame([("a", 0, 7)], "utt_id string, start_u long, end_u long")
    writers.write_spans(spans, str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == ["0 7 xxx"]
    scores = spark.createDataFrame([("mi", 0.12345)], "metric string, value double")
    for _ in range(2):
        writers.write_scores(scores, str(tmp_path / "sc"))
    assert [r.value for r in spark.read.parquet(str(tmp_path / "sc")).collect()] == [0.123, 0.123]
    writers.write_lines(scores, str(tmp_path / "t"), "metric", "value")
    writers.write_json(scores, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1 and spark.read.text(str(tmp_path / "t")).first().value == "mi\t0.12345"


def test_filterbank(spark):
    t = np.arange(16000) / 16000
    m = audio.log_mel(np.sin(2 * np.pi * 440 * t))
    assert m.shape == (101, 80) and m.max() <= 2 and m.min() >= m.max() - 1 - 1e-9
    centre = audio.hertz(np.linspace(audio.mel(np.array(50.0)), audio.mel(np.array(8000.0)), 82))[1:-1]
    assert abs(centre[m[50].argmax()] - 440) < 60
    df = spark.createDataFrame([("a", [0.0] * 1600)], "utt_id string, signal array<float>")
    assert audio.filterbanks(df).count() == 11


def test_stream_keeps_the_last_frame(spark, tmp_path):
    schema = "utt_id string, frame long, vec array<double>"
    for i, part in enumerate([[("a", 0, [0.0]), ("a", 1, [3.0])], [("a", 2, [4.0]), ("b", 0, [1.0])]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream_distances(stream).writeStream.format("memory").queryName("dists").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.utt_id, r.frame, r.dist) for r in spark.sql("select * from dists").collect()) in ([("a", 0, 3.0), ("a", 1, 1.0)], [("a", 0, 3.0), ("a", 2, 4.0)])


def test_layouts_and_depth(spark, tmp_path):
    tokens = spark.createDataFrame([("u1", "/a/u1.flac", 0.5, 1.0, "cat"), ("u2", "/a/u2.flac", 0.0, 0.25, "cat")], "utt_id string, audio_path string, start_s double, end_s double, token string")
    writers.write_alignments(tokens, str(tmp_path), "word", "dev")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/alignment_word_dev.tsv").collect()) == ["u1\t0.5\t1.0\tcat", "u2\t0.0\t0.25\tcat"]
    assert spark.read.json(f"{tmp_path}/alignment_word_dev.json").where("token = 'cat'").count() == 2
    assert writers.score_path("a.b/s.json", True) == "a.b/s_mean.json" and writers.score_path("s.json") == "s.json" and writers.score_path("a.b/s", True) == "a.b/s_mean"
    best = spark.createDataFrame([(3, "cosine", 4, 0.1, 0.5)], "layer int, kind string, window int, prominence double, f1 double")
    writers.write_best(best, f"{tmp_path}/best")
    assert spark.read.json(f"{tmp_path}/best").columns == ["avg pooling window size", "distance metrics", "f1 score", "layer", "prominence"]
    segments = spark.createDataFrame([(0, "u1"), (1, "u2")], "shard int, utt_id string")
    writers.write_shards(segments, f"{tmp_path}/shards")
    assert {(r.shard, r.utt_id) for r in readers.read_shards(spark, f"{tmp_path}/shards").collect()} == {(0, "u1"), (1, "u2")}
    (tmp_path / "audio" / "1" / "2").mkdir(parents=True)
    for name in ("0.flac", "1/1.flac", "1/2/3.flac", "1/2/x.wav"):
        (tmp_path / "audio" / name).write_bytes(b"x")
    ids = lambda depth: sorted(r.utt_id for r in readers.list_audio(spark, str(tmp_path / "audio"), depth=depth).collect())
    assert ids(None) == ["0", "1", "3"] and ids(2) == ["3"] and ids(0) == ["0"]
