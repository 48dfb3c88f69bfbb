"""Training examples move to validation as the SQL says, also where enough are held out."""

from collections import Counter

import duckdb
import pytest

from lexmill.operators import sft
from lexmill.plans import catalog


@pytest.mark.parametrize("n", [0, 1, 40, 7000])
def test_val_fallback_equals_its_sql(spark, tmp_path, n):
    ids = [*range(n), *([None, None, 7, 101] if n > 200 else [])]
    spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        expected = Counter(con.execute(catalog.ORACLES["val_fallback"]).fetchall())
    assert Counter(map(tuple, catalog.QUERIES["val_fallback"](spark, str(tmp_path)).collect())) == expected


def test_enough_held_out_stay_alone(spark):
    rows = spark.range(6000).selectExpr("id as ord", "if(id % 100 = 0, 'val', 'train') as split")
    assert Counter(sft.fallback_validation(rows).collect()) == Counter(rows.collect())
