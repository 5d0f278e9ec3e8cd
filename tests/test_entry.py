import importlib
import sys

import __spark_entry__


def test_queries_and_sql_agree():
    names = set(__spark_entry__.queries())
    assert len(names) > 80 and set(__spark_entry__.oracle_sql()) <= names


def test_without_the_training_operators(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("trawl.llm")]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("trawl.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.reload(__spark_entry__)
    assert entry.llm is None and entry.queries() and not any(n.startswith("op1_") for n in entry.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_flagship(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["lang", "n_lines", "n_spans", "n_docs"]
    rows.collect()
