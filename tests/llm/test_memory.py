from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# a session of its own: the workers of other tests hold what those took
CODE = r"""
import re, sys
import pyarrow as pa
from pyspark.sql import functions as F
from regiolens.llm import secrets
from regiolens.session import local_session

def workers(batches):
    import os
    from pathlib import Path
    yield from ()
    for b in batches:
        mb = []
        for p in Path("/proc").glob("[0-9]*"):
            try:
                if int(re.search(r"PPid:\s+(\d+)", (p / "status").read_text())[1]) == os.getppid():
                    mb.append(int(re.search(r"RssAnon:\s+(\d+)", (p / "status").read_text())[1]) // 1024)
            except OSError:
                pass
        yield pa.RecordBatch.from_pydict({"mb": [max(mb)]})

spark = local_session(1)
ask = lambda: spark.range(0, 1, 1, 1).mapInArrow(workers, "mb long").first()[0]
words = F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda i: F.concat(F.lit("w"), F.xxhash64("id", i).cast("string")))
docs = spark.range(0, 2500, 1, 1).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
docs.mapInArrow(lambda b: b, docs.schema).limit(1).collect()
before = ask()
n = secrets.redact_secrets(docs, ranks={}).where("length(text) > 1000").count()
print("RESULT", n, before, ask())
"""


def test_workers_give_back_what_a_task_took():
    """A worker that has seen 80 MB of texts is hardly larger afterwards."""
    run = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, env={**os.environ, "PYTHONPATH": ROOT, "PYTHONDONTWRITEBYTECODE": "1"},
                         capture_output=True, text=True, timeout=300)
    found = [x.split() for x in run.stdout.splitlines() if x.startswith("RESULT")]
    assert found, run.stderr[-2000:]
    n, before, after = map(int, found[0][1:])
    assert n == 2500 and after - before < 60, (before, after)
