"""Every query of the catalogue against its SQL on the smallest tables."""

import duckdb
import pytest

from tidyshelf.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, tmp_path, name):
    catalog.queries()[name](spark, DATA).write.parquet(str(tmp_path / "out"))
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = f"'{tmp_path}/out/*.parquet'"
    if name not in catalog.oracle_sql():
        assert c.sql(f"SELECT count(*) FROM {got}").fetchall()[0][0] > 0
        return
    sql = catalog.oracle_sql()[name]
    cols = ", ".join(f'"{x[0]}"' for x in sorted(c.sql(f"DESCRIBE {sql}").fetchall()))
    for a, b in ((f"({sql})", got), (got, f"({sql})")):
        assert c.sql(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}").fetchall() == []
