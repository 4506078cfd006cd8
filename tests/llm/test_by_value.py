"""Operators started where the workers can't import this package."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PROGRAM = """
import sys
sys.path.insert(0, {repo!r})
from rollbook.session import local_session
from rollbook.llm.queries import QUERIES
spark = local_session("2", "by-value")
spark.sparkContext.setLogLevel("ERROR")
for name in {names!r}:
    print(name, QUERIES[name](spark, {data!r}).count())
"""


def test_classes_travel_with_their_objects(spark, tmp_path):
    data = str(tmp_path / "data")
    good = "the quick brown fox jumps over the lazy dog and runs home again in the evening. "
    docs = [(i, good * (1 + i % 3) + f"call +1 555 010 99{i:02d}, all rights reservd", "en", "s", 1) for i in range(40)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{data}/documents.parquet")
    spark.createDataFrame([("b1", good * 2)], "item_id string, text string").write.parquet(f"{data}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{data}/labels.parquet")
    names = ["op1_pii", "op2_quality", "op3_sentencepiece", "op4_licenses", "op5_decontamination", "op9_simhash", "op10_language", "op12_packing", "op13_collocations"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    program = PROGRAM.format(repo=REPO, names=names, data=data)
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert list(counts) == names, done.stderr[-2000:]
    assert all(counts[n] == "40" for n in names if n not in ("op13_collocations",))
