"""Session helpers: checkpoint folder rules."""

import pytest

from estatelens.session import ensure_checkpoint_dir


class _Ctx:
    def __init__(self, master):
        self.master, self._dir = master, None

    def getCheckpointDir(self):
        return self._dir

    def setCheckpointDir(self, d):
        self._dir = d


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Session:
    def __init__(self, master, conf=None):
        self.sparkContext, self.conf = _Ctx(master), _Conf(conf or {})


def test_cluster_needs_shared_checkpoint_dir():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Session("yarn"))


def test_cluster_uses_configured_dir():
    s = _Session("spark://host:7077", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert ensure_checkpoint_dir(s) == "hdfs:///shared/ckpt"


def test_local_gets_scratch_dir():
    assert ensure_checkpoint_dir(_Session("local[4]"))


def test_entry_without_what_the_corpus_queries_need(monkeypatch):
    """A missing library or folder costs the corpus queries only."""
    import sys

    import __spark_entry__ as entry

    for module in [m for m in sys.modules if m.startswith("estatelens.llm")]:
        monkeypatch.delitem(sys.modules, module)
    monkeypatch.setitem(sys.modules, "estatelens.llm", None)
    assert set(entry.queries()) == set(entry.QUERIES) and set(entry.oracle_sql()) == set(entry.ORACLES)
