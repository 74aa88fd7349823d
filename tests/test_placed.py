import os
import random

import pytest
from pyspark.sql import functions as F

from inkweave.sources import placed, readers


def test_documents_of_many_tasks_are_whole_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(placed, "GATHERED", 64)
    r = random.Random(1)
    rows = [(job, s, p, r.choice(["", "é", "x" * r.randint(1, 50), "漢字 \n", "\r\n"])) for job, n in (("big/job one%", 700), ("b", 3), ("c", 1)) for s in range(2) for p in range(n)]
    parts = spark.createDataFrame(rows, "job_id string, section int, pos long, text string").repartition(7)
    path = str(tmp_path / "out")
    placed.write_single(parts, path, ["section", "pos"])
    want = {}
    for job, _, _, text in sorted(rows):
        want[job] = want.get(job, b"") + text.encode()
    got = {x.job_id: (x.n_bytes, bytes(x.content)) for x in placed.single_documents(spark, path).collect()}
    assert got == {job: (len(data), data) for job, data in want.items()}
    assert len([f for _, _, names in os.walk(path) for f in names if f == "all_docs.md"]) == 3
    with pytest.raises(Exception, match="finished"):
        placed.write_single(parts, path, ["section", "pos"])


def test_writing_again_gives_the_same_bytes(tmp_path):
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(["j/a.md", "j/a.md", "j/b.md"]), pa.array([0, 2, 0]), pa.array(["é", "xyz", None])], ["file", "at", "text"])
    sink = placed._Placed(str(tmp_path / "o"))
    sink.write(iter([batch]))
    sink.write(iter([batch.slice(1), batch.slice(0, 1)]))  # another attempt, other batches
    assert (tmp_path / "o" / "j" / "a.md").read_text() == "éxyz" and (tmp_path / "o" / "j" / "b.md").read_bytes() == b""
    with pytest.raises(ValueError, match="leaves"):
        sink._flush("../../x", 0, [b"1"])
    with pytest.raises(ValueError, match="mounted"):
        placed._Placed("s3://bucket/x")


def test_markdown_files_keep_folders_and_unfinished_ones_do_not_count(spark, tmp_path):
    rows = [("h one/x", "a b/c+d.md", "# A\n"), ("h one/x", "index.md", "x"), ("g", "100%.md", "z\r\n")]
    files = spark.createDataFrame(rows, "job_id string, filename string, content string")
    placed.write_markdown(files, str(tmp_path / "md"))
    assert sorted(map(tuple, readers.markdown_folder(spark, str(tmp_path / "md")).collect())) == sorted(rows)
    with pytest.raises(FileNotFoundError):
        placed.single_documents(spark, str(tmp_path / "none"))


def test_offsets_of_one_large_job(spark):
    parts = spark.range(5000).select(F.lit("j").alias("job_id"), F.col("id").alias("pos"), F.repeat(F.lit("é"), (F.col("id") % 7).cast("int")).alias("text"))
    got = {x.pos: x.at for x in placed.with_offsets(parts, ["pos"]).collect()}
    want, total = {}, 0
    for k in range(5000):
        want[k] = total
        total += 2 * (k % 7)
    assert got == want
