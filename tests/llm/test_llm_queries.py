import pytest
from compare import DATA, assert_same
from pyspark.sql import functions as F

from marginalia.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert_same(spark, QUERIES[name], SQL[name])


def test_pieces_belong_to_oversized_pages(spark):
    pieces = QUERIES["p4_pieces"](spark, DATA)
    found = QUERIES["p4_found"](spark, DATA).where("case_kind = 'oversized'")
    assert pieces.select("page_id").distinct().count() == found.count()
    assert pieces.groupBy("page_id", "chunk_index").count().where("count > 1").count() == 0


def test_every_document_is_packed_and_labelled(spark):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    packed = QUERIES["p7_containers"](spark, DATA)
    assert packed.select("doc_id").distinct().count() == n
    assert packed.groupBy("container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("u")).where("u > 2048").count() == 0
    assert QUERIES["p8_subjects"](spark, DATA).count() == n
    assert QUERIES["p6_ids"](spark, DATA).count() == n


def test_found_columns(spark):
    kinds = {name: dict(QUERIES[name](spark, DATA).dtypes) for name in ("p2_found", "p3_found", "p4_found", "p5_found", "p6_ids", "p8_found")}
    assert kinds == {
        "p2_found": {"label_id_a": "bigint", "label_id_b": "bigint"},
        "p3_found": {"source": "string", "citation_id": "bigint"},
        "p4_found": {"page_id": "bigint", "case_kind": "string"},
        "p5_found": {"label_id": "bigint", "group_id": "bigint"},
        "p6_ids": {"doc_id": "bigint", "ids": "array<int>"},
        "p8_found": {"doc_id": "bigint", "subject": "string"},
    }
