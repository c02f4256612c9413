"""The registry imports without a session, and a few queries agree with their SQL on a small table set."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as registry

DATA = "/root/testdata/sf0.001"


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(registry.__file__), capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and said.stdout.split()[1] == "True", said.stderr[-500:]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_entry_and_sql_agree(spark):
    import duckdb

    assert registry.entry(spark).count() > 0
    base = duckdb.connect()
    for t in ("lineitem", "part", "orders"):
        base.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name in ("rolling_features", "session_ranking", "dated_dividend_yields", "backtest_journal", "quotes_from_pages"):
        mine = registry.queries()[name](spark, DATA).toPandas()
        other = base.execute(registry.oracle_sql()[name]).df()
        columns = sorted(other.columns)
        assert sorted(mine.columns) == columns
        rows = lambda df, c=columns: sorted(str([None if v != v else v for v in r]) for r in df[c].astype(object).values.tolist())
        assert rows(mine) == rows(other), name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_yearly_history_is_written_in_several_pages(spark, monkeypatch):
    from tidemark.sources import pages

    seen, read = [], pages.html_tables
    monkeypatch.setattr(pages, "html_tables", lambda page: seen.append(page) or read(page))
    assert registry.queries()["yearly_history_from_pages"](spark, DATA).count() == 175  # every fiscal year
    assert seen[0].count() > 1
