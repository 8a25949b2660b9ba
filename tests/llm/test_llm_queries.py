import oracle
import pytest
from brindle.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    2: ["doc_id", "n_words", "n_removed", "kept_sha256"],
    3: ["doc_id", "held_out", "score", "predicted"],
    4: ["query_id", "rank", "vec_id", "score"],
    5: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    6: ["doc_id", "n_shingles", "component_id", "kept"],
    7: ["query_id", "rank", "vec_id", "score"],
    8: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    9: ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    10: ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_shape(spark, name):
    got = queries.QUERIES[name](spark, SF)
    n = int(name[2:].split("_")[0])
    assert set(COLUMNS[n]) <= set(got.columns)
    rows = got.count()
    if n in (4, 7):
        assert rows % 10 == 0 and rows > 0
    elif n == 9:
        assert rows >= 200
    else:
        assert rows == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_oracle(spark, name):
    oracle.same(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLE_SQL[name])
