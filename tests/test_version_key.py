"""Natural order of names, against `sort -V`."""

import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as X


def ordered(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    return [r["name"] for r in df.orderBy(X.version_key("name")).collect()]


def test_names_of_chunks(spark):
    names = ["chunk_A_block_10.md", "chunk_A_block_2.md", "chunk_A_block_2.md~", "chunk_A_block_02.md", "chunk_B_block_1.md", "chunk_AA_block_1.md", ".hidden", "..", ".", ""]
    assert ordered(spark, names) == ["", ".", "..", ".hidden", "chunk_AA_block_1.md", "chunk_A_block_2.md~", "chunk_A_block_02.md", "chunk_A_block_2.md", "chunk_A_block_10.md", "chunk_B_block_1.md"]
    assert ordered(spark, ["a10", "a9", "a09", "a", "a~", "a.b", "ab", "a-", "a1b", "é", "z"])[:3] == ["a~", "a", "a.b"]


@pytest.mark.skipif(not shutil.which("sort"), reason="no sort")
def test_as_sort_does(spark):
    rng = random.Random(4)
    parts = ["a", "b", "Z", "0", "1", "9", "10", "007", "~", ".", "-", "_", ".md", ".tar", ".7z", "é", "Ж", " ", "chunk_", "block", "00"]
    names = sorted({"".join(rng.choices(parts, k=rng.randrange(1, 7))) for _ in range(3000)})
    out = subprocess.run(["sort", "-V"], input="\n".join(names), capture_output=True, text=True, env={"LC_ALL": "C"}, check=True).stdout.rstrip("\n").split("\n")
    assert ordered(spark, names) == out
    assert spark.createDataFrame([(None,)], "name string").select(X.version_key("name").alias("k")).filter(F.col("k.kind") == 0).count() == 1
