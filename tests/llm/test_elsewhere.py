"""Started from another folder, without PYTHONPATH: executors need no copy of the subpackage."""

import os
import subprocess
import sys

from tests.conftest import SF

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as entry
from studylake import get_session
spark = get_session("elsewhere", "local[2]", spark__sql__shuffle__partitions="2")
for name in ("op2_decontaminate", "op7_byte_bpe", "op10_lexicon_toxicity"):
    print(name, entry.queries()[name](spark, {SF!r}).count())
"""


def test_subpackage_is_not_needed_on_executors(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert len(counts) == 3 and all(int(n) > 0 for n in counts.values())
