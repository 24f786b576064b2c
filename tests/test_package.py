import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = """
import sys; sys.path.insert(0, sys.argv[1])
from quillmere.session import local_session
from quillmere.operators import search
spark = local_session(2)
rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
print("found", search.top_k(rows.withColumnRenamed("id", "question_id"), rows, 1).count())
"""


def test_tasks_need_no_installed_package(tmp_path):
    """Run from a folder in which tasks cannot import the package."""
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(ROOT)], cwd=tmp_path, capture_output=True, text=True, timeout=180,
        env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"},
    )
    assert "found 2" in done.stdout, done.stderr[-2000:]


ENTRY = """
import sys; sys.path.insert(0, sys.argv[1])
if len(sys.argv) > 2:
    sys.modules[sys.argv[2]] = None
import __spark_entry__ as entry
print("queries", len(entry.queries()), sum(k.startswith("op") and k[2].isdigit() for k in entry.queries()))
"""


def _entry(root, *missing):
    return subprocess.run([sys.executable, "-c", ENTRY, str(root), *missing], capture_output=True, text=True, timeout=180)


def test_entry_without_the_training_data_package(tmp_path):
    import shutil

    hidden = shutil.ignore_patterns("llm", "__pycache__", ".git", "corpus_pipeline.py", "testdata")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=hidden)
    done = _entry(tmp_path / "copy")
    assert done.stdout.startswith("queries") and done.stdout.split()[2] == "0", done.stderr[-2000:]


def test_entry_does_not_hide_a_missing_library():
    done = _entry(ROOT, "numpy.linalg")
    assert "Error" in done.stderr and "queries" not in done.stdout
    if (ROOT / "quillmere" / "llm").exists():
        done = _entry(ROOT, "xxhash")
        assert "xxhash" in done.stderr and "queries" not in done.stdout
