"""Every registered query of the note-event library gives the rows of its SQL."""

from concurrent.futures import ThreadPoolExecutor
from numbers import Number

import duckdb
import numpy as np
import pandas as pd
import pytest

from segno.plans import registry
from segno.sources import quality

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]

    def one(v):
        """Every number as a float, whatever type holds it, so that both sides sort alike."""
        if not pd.api.types.is_scalar(v):
            return [one(x) for x in v]
        if pd.isna(v):
            return None
        return v if isinstance(v, (bool, np.bool_)) or not isinstance(v, Number) else round(float(v), 6) + 0.0

    return sorted((tuple(one(v) for v in row) for row in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def results(request, spark):
    """The rows of every query asked for, a few queries at a time: most of a small query is waiting."""
    quality.checkpoint_folder(spark)
    names = [i.callspec.params["name"] for i in request.session.items if i.path == request.path and hasattr(i, "callspec")]
    with ThreadPoolExecutor(5) as pool:
        yield {n: pool.submit(lambda q=registry.queries()[n]: q(spark, DATA).toPandas()) for n in names}
        pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(results, duck, name):
    got, want = results[name].result(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(results, name):
    assert len(results[name].result()) > 0
