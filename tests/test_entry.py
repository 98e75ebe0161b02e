import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_training_data_operators(tmp_path):
    """The rest works where the subpackage and the pipeline are gone."""
    for name in ("splicelake", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{ROOT}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "splicelake" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cluster_report' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_without_the_pipeline_alone(tmp_path):
    """The training-data operators stay where only the pipeline is gone."""
    for name in ("splicelake", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{ROOT}/{name}", str(tmp_path)], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert ('pipeline' not in q) and (any(n.startswith('op') for n in q) or e._llm is None)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
