"""What only shows where executors can't import the package: the driver alone has the repository on its path."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from tidemark.llm import queries
print("ROWS", *(queries.QUERIES[n](spark, "/root/testdata/sf0.001").count() for n in {names!r}))
"""


@pytest.mark.parametrize("names", [["op7_toxicity", "op9_quality"], ["op1_mixing", "op5_ann", "op10_suffixes"]])
def test_executors_without_the_package(names, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=str(REPO), names=names)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class Context:
                        @staticmethod
                        def getCheckpointDir():
                            class Nothing:
                                @staticmethod
                                def isDefined():
                                    return False

                            return Nothing

                    return Context

        class conf:
            @staticmethod
            def get(key, default):
                return default

    from tidemark.llm.common import shared_dir

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session)
