import importlib
import os
import subprocess
import sys

import __spark_entry__ as entry
from genoloom.runtime import dense_ids, materialize, release


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_does_not_import_the_subpackage():
    code = "import sys, genoloom.plans.queries; assert not [m for m in sys.modules if m.startswith('genoloom.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))


def test_entry_works_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "genoloom.llm", None)
    monkeypatch.setitem(sys.modules, "genoloom.llm.queries", None)
    try:
        assert importlib.reload(entry).llm is None and "p2_found" in entry.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_dense_ids_and_written_tables(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id as x", "'c' as _other")
    got = dense_ids(df, "n", 5)
    assert sorted(r.n for r in got.collect()) == list(range(5, 1005)) and got.columns == ["x", "_other", "n"]
    assert dense_ids(df.limit(0), "n").count() == 0
    kept = materialize(df)
    assert kept.count() == 1000
    release(kept)


def test_running_totals(spark):
    from genoloom.runtime import running_totals

    rows = [(g, i * 3, (i * 7 + g) % 5) for g in (1, 2) for i in range(300)] + [(3, 0, 4)]
    df = spark.createDataFrame(rows, "g int, o long, v long").repartition(5)
    got = {(r.g, r.o): r.before for r in running_totals(df, "g", "o", "v", "before").collect()}
    want, total = {}, {}
    for g, o, v in sorted(rows):
        want[(g, o)] = total.get(g, 0)
        total[g] = total.get(g, 0) + v
    assert got == want


def test_a_cluster_needs_a_shared_folder():
    from genoloom import runtime

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}

    class Session:
        conf, sparkContext = {}, Context()

    try:
        runtime.shared_dir(Session())
    except ValueError as error:
        assert "spark.checkpoint.dir" in str(error)
    else:
        raise AssertionError
