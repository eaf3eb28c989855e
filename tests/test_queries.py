"""Every registered query that has SQL gives the same rows as DuckDB."""

import duckdb
import pandas as pd
import pytest

from scopelake.plans import structure_queries, view_queries  # noqa: F401 (register their queries)
from scopelake.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if pd.isna(x) else round(x, 6)
    return None if x is None or x is pd.NA else x.item() if hasattr(x, "item") else x


def as_rows(df, columns):
    return sorted(repr(tuple(plain(x) for x in r)) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = con.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert as_rows(got, columns) == as_rows(want, columns)


def test_streaming_matches_batch(spark, sf, tmp_path):
    from scopelake.streaming import events

    folder = str(tmp_path / "in")
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(folder)
    q = events.tumbling(events.read_events(spark, folder), late="400 days").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = events.tumbling(spark.read.parquet(folder))
    key = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("tumbled")) == key(batch)
    assert events.sliding(spark.read.parquet(folder)).count() > batch.count()
    assert events.sessions(spark.read.parquet(folder)).count() > 0
