"""Numbers and plans as larger tables have them: keys that once met other tables' keys, joins that turn into broadcasts as they run."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioforge.operators import items, retrieval
from folioforge.plans import details, indexes, library
from folioforge.sources import vectors
from folioforge.sources.postings import Postings

SF = "/root/testdata/sf0.001"


def test_filtered_scores_where_a_join_becomes_a_broadcast(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"title {i % 7}", f"alpha beta gamma delta word{i % 5}") for i in range(200)], "item_key long, title string, document string")
    asked = spark.createDataFrame([(1, "alpha beta word1"), (2, "gamma title delta")], "query_id long, text string")
    eligible = docs.filter("item_key % 3 = 0").select("item_key")
    want = sorted(tuple(r) for r in retrieval.lexical_topk(docs, asked, 10, eligible=eligible, postings=Postings.of(docs, str(tmp_path))).collect())
    # Chosen as a join by sort, found small as it runs: its readers then take rows as they lie.
    said = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in said.items():
            spark.conf.set(k, v)
        got = sorted(tuple(r) for r in retrieval.lexical_topk(docs, asked, 10, eligible=eligible, postings=Postings.of(docs, str(tmp_path))).collect())
    finally:
        for k in said:
            spark.conf.unset(k)
    assert got == want


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    """Few rows with the keys of tables many times as large."""
    out = str(tmp_path_factory.mktemp("shifted"))
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    customers = read("customer").withColumn("c_custkey", F.col("c_custkey") + 500_000)
    orders = read("orders").withColumn("o_custkey", F.col("o_custkey") + 500_000)
    orders = orders.unionByName(orders.limit(50).withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))
    for name, rows in {"customer": customers, "orders": orders, "part": read("part").withColumn("p_partkey", F.col("p_partkey") + 500_000), "supplier": read("supplier"), "nation": read("nation")}.items():
        rows.write.parquet(f"{out}/{name}.parquet")
    db = duckdb.connect()
    for name in ("customer", "orders", "part", "supplier", "nation"):
        db.execute(f"create view {name} as select * from '{out}/{name}.parquet/*.parquet'")
    return out, db


@pytest.mark.parametrize("name", ["annotation_search", "notes_and_annotations", "filled_annotations", "feed_list"])
def test_large_keys_match_sql(spark, shifted, name):
    out, db = shifted
    got = details.QUERIES[name](spark, out)
    want = db.sql(details.SQL[name])
    at = [list(want.columns).index(c) for c in got.columns]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_sort_index_keeps_its_length(spark):
    rows = spark.createDataFrame([('{"pageIndex": 123456, "rects": [[10.7, 20.2, 30, 40]]}',), ('{"pageIndex": 7, "rects": [[1234567.5, 20.2]]}',), ('{"pageIndex": 3, "rects": [[1, 800]]}',)], "x string")
    got = [r[0] for r in rows.select(items.sort_index(F.col("x"), F.lit(792))).collect()]
    assert got == ["12345|000771|00010", "00007|000771|12345", "00003|-00008|00001"]


def test_spans_of_long_texts_match_sql(spark, tmp_path):
    docs = spark.createDataFrame([(1, 250_000), (2, 100_600), (3, 99_800), (4, 501), (5, 0), (6, None)], "doc_id long, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in library.QUERIES["span_overlap"](spark, str(tmp_path)).collect())
    assert got == sorted(db.sql(library.SQL["span_overlap"]).fetchall())


def test_a_task_gives_the_best_of_all_its_batches():
    """However many batches a task reads, k rows a query leave it."""
    rng = np.random.default_rng(3)
    rows = [(key, term, float(rng.integers(1, 5))) for key in range(400) for term in range(2)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + 50]]) for i in range(3)], names=["item_key", "term", "part"]) for at in range(0, len(rows), 50)]
    asked = [[0, 1], [1]]
    got = [r for b in retrieval._summed([10, 20], asked, 5, rows=60)(iter(batches)) for r in b.to_pylist()]
    want = []
    for q, name in enumerate((10, 20)):
        total: dict = {}
        for key, term, part in rows:
            if q in asked[term]:
                total[key] = total.get(key, 0.0) + part
        want += [(name, key, x) for key, x in sorted(total.items(), key=lambda t: (-t[1], t[0]))[:5]]
    assert sorted((r["query_id"], r["item_key"], r["exact"]) for r in got) == sorted(want)


def test_lists_of_a_batch_are_told_at_once():
    """A batch gives one batch of its best rows, and what it holds does not grow with the queries that read it."""
    rng = np.random.default_rng(4)
    n, queries = 20_000, 300
    v, asked = rng.normal(size=(n, 8)), rng.normal(size=(queries, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(v.tolist()), pa.array(np.zeros(n, np.int32)), pa.array(np.sqrt((v * v).sum(1)))], names=["item_key", "v", "list", "distance"])
    run = vectors._scored(list(range(queries)), asked, np.ones((queries, 1), bool), np.sqrt((asked * asked).sum(1))[:, None], np.full(queries, np.inf), 3, "l2")
    tracemalloc.start()
    got = list(run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 1 and got[0].num_rows == 3 * queries and most < 8 * n * queries
    one = [r["item_key"] for r in got[0].to_pylist() if r["query_id"] == 7]
    assert one == np.argsort(((v - asked[7]) ** 2).sum(1))[:3].tolist()


def test_ranges_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(indexes, "ROWS_A_RANGE", 100)
    made = []
    real = indexes.LayeredIndex.publish
    monkeypatch.setattr(indexes.LayeredIndex, "publish", lambda self, rows: made.append(self) or real(self, rows))
    indexes.QUERIES["index_replay"](spark, "/root/testdata/sf0.01")
    assert made[0].per_range == 100 and len(made[0].manifest(1)["ranges"]) == 10
