"""Shipping, the shared folder and the life of intermediate files."""

import glob
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tarnwork import runtime

OWN_TABLE = """
import sys
sys.path.insert(0, {root!r})
from tarnwork.runtime import session
from tarnwork.operators.hierarchy import hierarchy
from tarnwork.functions.markdown import chunk_documents
from tarnwork.functions.lexical import lexemes
from pyspark.sql import functions as F
spark = session(master="local[2]", shuffle_partitions=2, driver_memory="1g")
rows = [("s", "a", None, 1, 1), ("s", "b", "a", 1, 2)]
got = hierarchy(spark.createDataFrame(rows, "session_id string, agent_id string, parent_agent_id string, captured_at int, record_id int")).collect()
assert sorted(r["node_path"] for r in got) == ["a", "a/b"]
texts = spark.createDataFrame([("k", "# T\\n\\nrunning words")], "k string, body string")
assert texts.select(lexemes(F.col("body"))).first()[0]
print("fine")
"""


def test_callers_own_table_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", OWN_TABLE.format(root=root)], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": ""})
    assert done.stdout.strip().endswith("fine"), done.stderr[-3000:]


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        runtime.shared_folder(Session())


def test_intermediate_files_go(spark):
    folder = runtime.shared_folder(spark).removeprefix("file://")
    kept = set(glob.glob(f"{folder}/mine-*"))
    with runtime.scratch(spark):
        first = runtime.cut_lineage(spark.range(3), "mine")
        second, seen = runtime.cut_lineage_counting(spark.range(0), "mine", n=F.count("*"))
        assert first.count() == 3 and second.count() == 0 and seen == {"n": 0}
        runtime.release(first)
        assert len(set(glob.glob(f"{folder}/mine-*")) - kept) == 1
    assert set(glob.glob(f"{folder}/mine-*")) == kept
