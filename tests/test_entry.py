from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_query_with_sql_is_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["scan_id", "relative_path", "change_type"] and df.count() > 0


def test_core_does_not_import_the_training_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "lodestack")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    assert "lodestack.llm" not in open(os.path.join(folder, name)).read(), name


def test_the_shared_folder_is_the_sessions(spark):
    from lodestack.session import cut_lineage, shared_dir

    folder = shared_dir(spark)
    assert shared_dir(spark) == folder and cut_lineage(spark.range(5)).count() == 5


def test_what_an_application_left_can_be_cleaned(spark, monkeypatch, tmp_path):
    from lodestack import session

    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    session.write_once(spark.range(3), "x")
    session.cut_lineage(spark.range(3))
    (tmp_path / "other").mkdir()
    (tmp_path / "lodestack-another-application").mkdir()
    checkpoints = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert any(n.startswith("rdd-") for n in os.listdir(checkpoints))
    assert session.clean_shared(spark) >= 2
    assert not any(n.startswith("rdd-") for n in os.listdir(checkpoints)) and os.listdir(session.own_dir(spark)) == []
    assert {"other", "lodestack-another-application"} < {p.name for p in tmp_path.iterdir()}


def test_a_broken_training_package_leaves_the_rest(tmp_path):
    """An import inside the subpackage that fails counts as a subpackage that isn't there."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['pyarrow'] = sys.modules['numpy'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p1_found' not in q and 'p1_found' not in e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


class Unset:
    """A session without the setting."""

    def __init__(self, master):
        self.sparkContext = self.conf = self
        self.master, self.folder = master, None

    def getConf(self):  # noqa: N802
        return self

    def get(self, *_):
        return None

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = folder


def test_a_machine_local_folder_is_used_only_in_local_mode():
    from lodestack.session import shared_dir

    one = Unset("local[4]")
    assert shared_dir(one) == shared_dir(one) == one.folder
    os.rmdir(one.folder)
    for master in ("yarn", "spark://x:7077", "local-cluster[3,2,3000]"):
        with pytest.raises(RuntimeError):
            shared_dir(Unset(master))
