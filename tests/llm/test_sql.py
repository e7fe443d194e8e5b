import duckdb
import pandas as pd
import pytest

from glyphsieve.llm import queries

SF = "/root/testdata/sf0.01"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(want)
    numbers = [c for c in columns if pd.api.types.is_numeric_dtype(want[c]) and not pd.api.types.is_bool_dtype(want[c])]

    def rows(df):
        df = df[columns].astype(dict.fromkeys(numbers, "float64"))
        return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))

    assert rows(got) == rows(want)
