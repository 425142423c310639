"""Static features by content, and CSV files of any encoding read in blocks."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from matchweave.operators import search
from matchweave.sources import readers

SKILLS = "job_id long, skill string, required boolean"


def test_an_unchanged_job_is_not_worked_out_again(spark):
    related = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    old = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "b", False)], SKILLS)
    known = search.refreshed_features(None, old, related)
    assert {(r.job_id, r.required, r.preferred, r.near, r.near2) for r in known.collect()} == {(1, 1, 0, 1, 2), (2, 1, 0, 1, 2), (3, 0, 1, 0, 0)}
    marked = known.withColumn("near", F.lit(99).cast("long"))  # tells what was kept
    new = spark.createDataFrame([(1, "a", True), (2, "a", True), (2, "c", False), (4, "b", True)], SKILLS)
    got = {r.job_id: (r.required, r.preferred, r.near, r.near2) for r in search.refreshed_features(marked, new, related).collect()}
    assert got == {1: (1, 0, 99, 2), 2: (1, 1, 1, 2), 4: (1, 0, 2, 3)}
    other = related.union(spark.createDataFrame([("a", "x")], related.schema))  # other edges change all
    assert {r.near for r in search.refreshed_features(marked, old, other).where("job_id < 3").collect()} == {2}
    again = related.select(F.col("dst").alias("src"), F.col("src").alias("dst"))  # the same edges from the other end
    assert {r.near for r in search.refreshed_features(marked, old, again).collect()} == {99}


@pytest.mark.parametrize("encoding, end", [("gb18030", "\n"), ("gb18030", "\r\n"), ("utf-8-sig", "\n"), ("utf-8", "\r\n")])
def test_one_file_in_many_tasks_equals_one_task(spark, tmp_path, encoding, end):
    r = random.Random(encoding + end)
    words = ["工程师", 'say "so"', "plain", "a,b", "two\nlines", "", "你\n\n好", '"', "é" if encoding != "gb18030" else "北京"]
    rows = [[str(i), r.choice(words), " ".join(r.choices(words, k=3))] for i in range(3000)]
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([["id", "标题", "text"], *rows])
    path = tmp_path / "big.csv"
    path.write_bytes(out.getvalue().encode(encoding))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    try:
        lines = readers.raw_lines(spark, str(path))
        assert lines.select("block").distinct().count() > 8
        got = readers.read_csv(spark, str(path))
        assert got.columns == ["id", "标题", "text"]
        have = {x["id"]: (x["标题"], x["text"]) for x in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {x["id"]: (x["标题"] or None, x["text"] or None) for x in csv.DictReader(io.StringIO(out.getvalue()))}
    assert have == want and len(have) == 3000


def test_files_of_two_encodings_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("x,y\n1,é\n\n".encode())
    (tmp_path / "b.csv").write_bytes("y,z\n工,2\n".encode("gb18030"))
    (tmp_path / "c.csv").write_bytes(b"")
    got = {(r.x, r.y, r.z) for r in readers.read_csv(spark, str(tmp_path)).collect()}
    assert got == {("1", "é", None), (None, "工", "2")}
    (tmp_path / "d.csv").write_bytes(b"y\n\xff\xff\n")
    with pytest.raises(Exception, match="decode"):
        readers.read_csv(spark, str(tmp_path)).collect()
