"""Every query of the engine against its SQL, on the smallest tables."""

import pytest
from conftest import SMALL
from oracle import duck, same

from tidewell.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    same(catalogue.QUERIES[name](spark, SMALL).toPandas(), duck(SMALL).sql(catalogue.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, name):
    assert len(catalogue.QUERIES[name](spark, SMALL).toPandas()) > 0


def test_stream_equals_batch(spark):
    rows = catalogue.QUERIES["batch_equals_stream"](spark, SMALL).collect()
    assert rows and all(r.same and r.n_stream == r.n_batch for r in rows)


def test_wav_roundtrip_is_exact(spark):
    assert all(r.same for r in catalogue.QUERIES["wav_roundtrip"](spark, SMALL).collect())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
