import os
import time

from pyspark.sql import functions as F
from test_operators import packed

from folioflow.plans.fulltext import bounded, download, full_text


def test_work_is_bounded():
    assert bounded(lambda x: x + 1, (1,)) == 2
    began = time.time()
    assert bounded(time.sleep, (30,), 0.3) is None and time.time() - began < 5
    assert bounded(lambda: 1 / 0, ()) is None and bounded(lambda: os._exit(3), ()) is None


def test_tiers(spark):
    tex = packed({"a.tex": rb"\begin{document}tex\end{document}"})
    rows = [(1, tex, "<p>html</p>", None), (2, b"broken", "<p>html</p>", None), (3, None, "<p> </p>", b"no pdf"), (4, None, None, None)]
    df = spark.createDataFrame(rows, "id int, a binary, h string, p binary")
    got = {r.id: r.t for r in df.select("id", full_text(F.col("a"), F.col("h"), F.col("p"), F.lit("x")).alias("t")).collect()}
    assert "tex" in got[1] and got[2] == "html" and got[3] is None and got[4] is None


def test_download(tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 3000)
    download(f"file://{tmp_path}/a", str(tmp_path / "b"), piece=100)
    assert (tmp_path / "b").read_bytes() == b"x" * 3000
