"""The registered corpus queries on the smallest tables: columns and types, against their SQL, or against facts that hold of every row."""

import zlib

import duckdb
import pytest

from tallyspark.llm import oracle, sharding
from tallyspark.llm.queries import queries
from tests.test_queries import TABLES, rows

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op3_warc_archive": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op4_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op5_source_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op6_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op7_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op9_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op10_sharding": "doc_id bigint, slot int, shard string",
    "op11_sort_means": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op12_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op13_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    out = queries()[name](spark, SF)
    types = dict(out.dtypes)
    for column in COLUMNS[name].split(", "):
        c, kind = column.split()
        assert types[c] == kind
    got = out.toPandas()
    if sql := oracle.oracle_sql().get(name):
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
        return
    table, key = ("pages", "page_id") if name.startswith("op2") else ("documents", "doc_id")
    n = duck.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    if not name.startswith("op9"):
        assert len(got) == n
    assert set(got[key]) == {r[0] for r in duck.execute(f"SELECT {key} FROM {table}").fetchall()}
    if "held_out" in got:
        m, r = (3, 1) if name.startswith("op1") else (4, 2)
        assert all(h == (zlib.crc32(str(i).encode()) % m == r) for i, h in zip(got["doc_id"], got["held_out"]))
    if "score" in got:
        assert got["score"].between(0, 1).all()
    if name == "op7_quality":
        assert ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    if name == "op10_sharding":
        table = sharding.fill(sharding.SHARDS)
        assert all(sharding.SHARDS[table[s]][0] == x for s, x in zip(got["slot"], got["shard"]))
