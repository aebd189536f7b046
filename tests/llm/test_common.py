import subprocess
import sys
from pathlib import Path

from tarnforge.llm import common

RUN = """
import sys
from pyspark.sql import SparkSession
from tarnforge.llm import common, tokens
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", sys.argv[1]).config("spark.ui.enabled", "false").getOrCreate()
df, path = common.cut(spark.range(5))
print("left", df.count(), path.startswith(sys.argv[1]))
"""


def test_scratch_goes_with_the_application(tmp_path):
    """What an operator called alone leaves in the shared folder is deleted when the driver ends."""
    root = Path(__file__).resolve().parents[2]
    said = subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], cwd=root, capture_output=True, text=True, timeout=300).stdout
    assert "left 5 True" in said and not list(tmp_path.glob("tarnforge*"))


def test_scratch_blocks(spark):
    with common.scratch() as outer:
        with common.scratch() as made:
            _, path = common.cut(spark.range(3))
            assert made == [path]
        assert outer == [path]
        common.release(spark, outer)
        assert outer == []
