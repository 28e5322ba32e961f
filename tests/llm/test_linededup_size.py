"""Line dedup on many near copies and at hot words: no link is lost, and what is shuffled doesn't grow with the square of their number."""

import os
import subprocess
import sys

from tidepanel.llm import linededup
from tidepanel.llm.registry import ship

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

RUN = """
import os, sys
from tidepanel.llm import linededup
from tidepanel.session import build_session
spark = build_session("local[4]", "size", **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"})
linededup.BUCKETS, linededup.HOT = 1 << 10, 16
core = [f"core{i}" for i in range(58)]
rows = [(k, " ".join([*core, f"a{k}", f"b{k}"]) + "\\n" + " ".join(f"{j * 7919 + k:x}word{j * k:x}" for j in range(400))) for k in range(400)]
docs = spark.createDataFrame(rows, "doc_id long, text string")
found = linededup.match_lines(docs).collect()
assert sum(r.n_links for r in found) == 400 * 399 and sum(len(r.removed) for r in found) == 399
held = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(os.environ["SPARK_LOCAL_DIRS"]) for f in names if f.startswith("shuffle"))
print("HELD", held, sum(len(t) for _, t in rows))
"""


def test_shuffles_stay_near_the_size_of_the_texts(tmp_path):
    env = os.environ | {"SPARK_LOCAL_DIRS": str(tmp_path), "PYTHONPATH": REPO}
    said = subprocess.run([sys.executable, "-c", RUN], env=env, capture_output=True, text=True, timeout=600)
    assert said.returncode == 0, said.stderr[-2000:]
    held, texts = map(int, said.stdout.split("HELD")[1].split())
    assert held < 2 * texts, (held, texts)


def test_pair_with_a_later_cold_word_is_counted_at_its_hot_word(spark, monkeypatch):
    """x and y first share ``hot``, which the prefix of z holds too; at ``cold`` too few words are left for a match, which says nothing about the words before it."""
    ship(spark)
    monkeypatch.setattr(linededup, "HOT", 2)
    common = [f"w{i}" for i in range(7)]
    lines = [["u1", "hot", "cold", *common], ["u2", "hot", "cold", *common], ["hot", *common[:4]]]
    lines += [["cold", *[f"r{k}x{j}" for j in range(5)]] for k in range(12)]
    lines += [[*common, *[f"q{k}x{j}" for j in range(6)]] for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(line)) for k, line in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: (r.removed, r.n_links) for r in linededup.match_lines(docs).collect()}
    assert got[0] == ([], 1) and got[1] == ([0], 1)
    assert all(got[k] == ([], 0) for k in range(2, len(lines)))
