import re
import zlib

import pytest

from trackloom.llm import queries

from ..oracle import same_rows

SF = "/root/testdata/sf0.001"
HELD_OUT = {"op3_quality": (4, 2), "op4_toxicity": (5, 0), "op5_suffix_tree": (10, 0), "op10_language": (4, 2)}
LEAST = {"op3_quality": 0.7, "op4_toxicity": 0.5}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    same_rows(spark, SF, queries.queries()[name], queries.oracle_sql()[name])


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.queries().keys() - queries.oracle_sql().keys() - {"op2_neighbours"}))
def test_query_returns_one_row_per_document(spark, name):
    docs = [r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    rows = queries.queries()[name](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    if name in HELD_OUT:
        n, remainder = HELD_OUT[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == remainder) for r in rows)
    if name in LEAST:
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= LEAST[name]) for r in rows)


def test_neighbour_query_ranks_the_whole_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = queries.op2_neighbours(spark, SF).collect()
    asked = {r["vec_id"] for r in vectors if r["vec_id"] % 20 == 0}
    assert {r["query_id"] for r in rows} == asked and len(rows) == len(asked) * min(20, len(vectors) - 1)
