"""Operators on workers that have no copy of the library."""

import os
import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parents[2])

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})  # the driver's path only
import public_tokenizers
from pyspark.sql import SparkSession, functions as F
from breezeline.llm import chat, language, pieces, prefix_trie, quality, suffix_dedup, topk, whitening
from breezeline.session import configure
spark = configure(SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
                  .config("spark.ui.enabled", "false").getOrCreate())
def seen(_):
    try:
        import breezeline
        yield True
    except ImportError:
        yield False
assert not any(spark.sparkContext.parallelize([1, 2], 2).mapPartitions(seen).collect())
docs = spark.createDataFrame([(i, "the and of " * (i % 9 + 1), "en" if i % 2 else "fr", i % 2) for i in range(60)],
                             "doc_id long, text string, lang string, quality int")
assert language.learn_and_predict(docs).count() == 60
assert quality.learn_and_score(docs, docs.select("doc_id", "quality")).count() == 60
model = pieces.read_model(spark, public_tokenizers.path("piece_bpe_32k.model"))
assert pieces.encode_and_decode(docs, model, F.col("doc_id")).count() == 60
assert suffix_dedup.remove_repeats(docs, least=40).count() == 60
vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
assert whitening.whiten(vectors).count() == 120
assert topk.search_own(vectors, F.col("vec_id") < 2).count() == 10
turns = spark.createDataFrame([(i, t, "user", "x") for i in range(20) for t in range(3)], "conv_id long, turn long, role string, text string")
assert prefix_trie.rebuilt_prefix_nodes(turns).count() > 3
print("all ran")
"""


def test_workers_need_no_copy(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
