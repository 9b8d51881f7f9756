import sys

from check_oracle import load_entry

from changelens import session


def test_entry_without_the_optional_subpackage(monkeypatch):
    """A missing folder, one with compiled files only, or a missing package of its own."""
    whole = load_entry().queries()
    monkeypatch.setitem(sys.modules, "changelens.llm", None)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    for name in [m for m in sys.modules if m.startswith("changelens.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    core = load_entry().queries()
    assert "change_report" in core and set(core) <= set(whole)
    assert not [name for name in core if name.startswith("op") and name[2].isdigit()]
    assert set(load_entry().oracle_sql()) <= set(core)


def test_package_reaches_workers_that_start_elsewhere(spark, monkeypatch, tmp_path):
    sent = []
    monkeypatch.setattr(session, "_SHIPPED", set())
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda _, path: sent.append(path))
    monkeypatch.setenv("PYTHONPATH", "")
    monkeypatch.chdir(tmp_path)
    session.ship_package(spark)
    session.ship_package(spark)
    assert len(sent) == 1 and sent[0].endswith("changelens.zip")
    monkeypatch.chdir(session.Path(session.__file__).parents[1])
    monkeypatch.setattr(session, "_SHIPPED", set())
    session.ship_package(spark)
    assert len(sent) == 1
