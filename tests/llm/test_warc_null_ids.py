"""Pages without an id are written and read back."""

from lookalike.llm import warc
from lookalike.llm.common import shared_folder


def test_pages_without_id_are_records(spark):
    rows = [(None, None, "x"), (None, "u", "same"), (3, "v", "same"), (5, "w", "same"), (None, "z", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(df, shared_folder(spark, "test-null"), null_ids=True)).collect()
    found = sorted((r["page_id"] or -1, r["url"], r["record_type"], r["refers_to"], bytes(r["payload"]) if r["payload"] is not None else None) for r in got)
    name = "urn:sha1:" + warc.payload_digest(b"x")
    assert found == [(-1, "u", "revisit", 5, None), (-1, name, "response", None, b"x"), (-1, "z", "response", None, b""),
                     (3, "v", "revisit", 5, None), (5, "w", "response", None, b"same")]
    assert warc.round_trip(df, null_ids=True).count() == 5
