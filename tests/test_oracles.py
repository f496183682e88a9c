"""Each registered query with an equivalent in SQL gives the same rows."""

import math

import duckdb
import pytest

from crestline.plans.oracles import ORACLES
from crestline.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
#: Slow loops by construction; compared with their fast twin in test_topology and test_graph.
SLOW = {"mst_by_rounds", "bootstrap_frequency_by_rounds", "tree_layers_by_rounds", "path_lengths_by_rounds", "hop_distances_by_rounds"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(frame):
    names = sorted(frame.columns)
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in frame[names].itertuples(index=False, name=None)), key=str), names


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_equals_sql(name, spark, sf_dir, duck):
    got, names = rows_of(QUERIES[name](spark, sf_dir).toPandas())
    want, wanted = rows_of(duck.execute(ORACLES[name]).df())
    assert names == wanted
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and abs(x - y) <= 2e-6) for x, y in zip(a, b, strict=True)), (a, b)


def test_every_query_has_a_distinct_place():
    assert set(ORACLES) <= set(QUERIES)
