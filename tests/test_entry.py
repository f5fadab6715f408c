import duckdb
import pytest

import __spark_entry__ as E
from territoria.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["temporal_panel", "trend_backtest", "energy_demand", "scenario_fanout", "yearly_department_demand",
        "waterfall_lookup", "nearest_reference_lookup", "positional_assignment", "override_join", "fold_accents"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "ranking_prioridad" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", FAST)
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    ocols = [c[0] for c in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    key = sorted(df.columns)

    def canon(cols, rows):
        idx = [cols.index(c) for c in key]
        return sorted((tuple(repr(r[i]) if not isinstance(r[i], float) else repr(round(r[i], 9)) for i in idx)
                       for r in rows))
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(ocols, orows)
