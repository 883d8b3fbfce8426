import datetime as dt
import json

import pytest

from varve.sources import records
from varve.streaming import witnesses as stream

SCHEMA = "doc_id bigint, url string, title string, status int, body string"


def test_captures(spark):
    body = [["timestamp", "original", "digest", "statuscode"], ["20100101000000", "u", "A", "200"], ["20110101000000", "u", "A", "200"], ["20120101000000", "u", "B", "302"], ["20130101000000", "u", "C", "-"]]
    r = spark.createDataFrame([(1, "u", None, 200, json.dumps(body)), (2, "u", None, 502, "x"), (3, "u", None, 200, "[]")], SCHEMA)
    got = sorted((x.doc_id, x.observed_at.year) for x in records.wayback(r).collect())
    assert got == [(1, 2010), (1, 2013)]


def test_line_records_and_coverage(spark):
    body = '{"urlkey":"a","timestamp":"20180101000000"}\nnoise\n{"message":"No Captures"}\n{"urlkey":"a","timestamp":"20190101000000"}\n{broken'
    r = spark.createDataFrame([(1, "c1", None, 200, body), (2, "c1", None, 404, body)], SCHEMA)
    assert sorted(x.observed_at.year for x in records.commoncrawl(r).collect()) == [2018, 2019]
    assert abs(records.crawl_coverage(r).first().coverage - (1 - 2.718281828459045 ** (-1 / 40))) < 1e-12


def test_postings_and_registrations(spark):
    hits = {"hits": [{"url": "http://www.ex.com/a/", "created_at": "2012-05-06T00:00:00Z"}, {"url": "https://ex.com/a", "created_at": "2011-05-06T00:00:00Z"}, {"url": "https://ex.com/b", "created_at": "2001-05-06T00:00:00Z"}]}
    r = spark.createDataFrame([(1, "https://ex.com/a", None, 200, json.dumps(hits))], SCHEMA)
    assert [x.observed_at.year for x in records.hackernews(r).collect()] == [2011]
    items = {"message": {"items": [{"DOI": "10.1000/x", "title": ["On rivers"], "created": {"date-time": "2005-02-03T00:00:00Z"}, "issued": {"date-parts": [[2004, 7]]}}]}}
    c = spark.createDataFrame([(1, "https://doi.org/10.1000/X", None, 200, json.dumps(items)), (2, "https://ex.com", "Totally different words", 200, json.dumps(items))], SCHEMA)
    assert sorted((x.doc_id, x.field, x.observed_at.date().isoformat()) for x in records.crossref(c).collect()) == [(1, "created", "2005-02-03"), (1, "issued", "2004-07-01")]
    atom = "<feed><entry><title>On rivers</title><published>2017-06-12T00:00:00Z</published></entry></feed>"
    a = spark.createDataFrame([(1, "https://arxiv.org/abs/1706.03762", None, 200, atom)], SCHEMA)
    assert [x.observed_at.date().isoformat() for x in records.arxiv(a).collect()] == ["2017-06-12"]


def test_collections_are_picked_by_time(spark):
    c = spark.createDataFrame([(str(y), dt.datetime(y, 1, 1)) for y in (2014, 2016, 2018, 2024)], "id string, started timestamp")
    t = spark.createDataFrame([(1, dt.datetime(2016, 2, 1)), (2, None)], "doc_id bigint, claimed timestamp")
    got = sorted((r.doc_id, r.collection) for r in records.pick_collections(c, t).collect())
    assert got == [(1, "2016"), (1, "2018"), (2, "2018"), (2, "2024")]


def test_unknown_sources_are_named(spark):
    with pytest.raises(ValueError, match="known"):
        records.collect({"elsewhere": spark.range(1)})


def test_running_bound_of_a_stream(spark, tmp_path):
    schema = "doc_id bigint, operator string, kind string, observed_at timestamp, reliability double, forgeability double"
    rows = [(1, "ia", "snapshot", dt.datetime(2012, 1, 1), 0.995, 1e-3), (1, "cc", "snapshot", dt.datetime(2010, 1, 1), 0.5, 0.5), (2, "a", "self_asserted", dt.datetime(2000, 1, 1), 0.9, 0.1)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = stream.running_bounds(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("bounds_test").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("bounds_test").collect()
    assert [(r.doc_id, r.not_after.year, r.method) for r in got] == [("1", 2012, "weighted-order-statistic")]
