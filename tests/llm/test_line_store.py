"""The store of line hashes across sessions, and what a query leaves behind."""

from lookalike.llm import line_dedup


def keys(spark, rows):
    return spark.createDataFrame([(bytearray(h.encode()), d, n) for h, d, n in rows], "h binary, doc long, n_docs long")


def test_a_saved_store_goes_on(spark):
    store = line_dedup.LineRuns(spark, fanout=2)
    store.add(keys(spark, [("a", 9, 1), ("b", 9, 1)]))
    store.add(keys(spark, [("b", 5, 1), ("c", 5, 2)]))
    store.add(keys(spark, [("d", 4, 1)]))
    folder = store.save()
    store.close()
    again = line_dedup.LineRuns.open(spark, folder)
    assert sorted((bytes(r["h"]).decode(), r["doc"]) for r in again.runs().collect()) == [("a", 9), ("b", 9), ("c", 5), ("d", 4)]
    again.add(keys(spark, [("a", 1, 1), ("e", 1, 1)]))
    assert sorted((bytes(r["h"]).decode(), r["doc"]) for r in again.runs().collect()) == [("a", 9), ("b", 9), ("c", 5), ("d", 4), ("e", 1)]
    plan = again.unseen(keys(spark, [("z", 1, 1)]))._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan or "bucketed" in plan.lower()
    again.close()


def test_a_query_leaves_no_tables(spark):
    before = {t.name for t in spark.catalog.listTables()}
    docs = spark.createDataFrame([(i, f"this very line is in all documents\nown {i}") for i in range(5)], "doc_id long, text string")
    got = line_dedup.digest(docs)
    assert sum(r["n_dropped"] for r in got.collect()) == 4
    assert {t.name for t in spark.catalog.listTables()} == before
