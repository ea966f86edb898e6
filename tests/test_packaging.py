"""The package works from any folder, and can be sent to executors."""

import os
import subprocess
import sys
import zipfile

from tidemark import session

CODE = """
import sys
sys.path.insert(0, {root!r})
from tidemark.operators import retrieval
from tidemark.session import local_session
spark = local_session("elsewhere", cores="1")
print([r["embedding"] for r in retrieval.embed(spark.createDataFrame([("a b",)], "text string"), dims=2).collect()])
"""


def test_workers_find_the_package_from_another_folder(tmp_path):
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE.format(root=session.PACKAGE_ROOT)], cwd=tmp_path, env=clean, capture_output=True, text=True)
    assert run.returncode == 0 and "[[" in run.stdout, run.stderr[-2000:]


def test_the_package_is_shipped(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: sent.append(path))
    session.ship(spark)
    names = zipfile.ZipFile(sent[0]).namelist()
    assert "tidemark/session.py" in names and "tidemark/operators/lexical.py" in names and not any(n.startswith("tests") for n in names)
