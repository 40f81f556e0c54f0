"""Readers and sinks on small files."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from panelspark.sources import sinks
from panelspark.sources.articles import flatten_articles, latest_batch, read_articles
from panelspark.sources.bars import read_bars, read_messy_bars
from panelspark.sources.inspect import inspect_tables, require

HEAD = "Date,Open,High,Low,Close,Volume\n"


def test_read_bars_takes_the_id_from_the_file(spark, tmp_path):
    (tmp_path / "^NDX.csv").write_text(HEAD + "2024-01-02,1,2,0.5,1.5,100\n2024-01-03,1,2,0.5,NaN,0\n")
    (tmp_path / "A B.csv").write_text(HEAD + "2024-01-02,1,2,0.5,1.5,100\n")
    (tmp_path / "notes.txt").write_text("not bars")
    rows = {(r["id"], r["t"]): r["close"] for r in read_bars(spark, str(tmp_path)).collect()}
    assert rows == {("^NDX", dt.date(2024, 1, 2)): 1.5, ("^NDX", dt.date(2024, 1, 3)): None,
                    ("A B", dt.date(2024, 1, 2)): 1.5}


def test_empty_folder_fails_loudly(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_bars(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError, match="run download first"):
        require(spark, str(tmp_path / "none"), "download")


def test_messy_bars(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Price,^NDX,^NDX\nDate,,\n2024-01-02,5.5,abc\nbad,1,1\n2024-01-03,,7\n")
    out = read_messy_bars(spark, str(tmp_path), ["Date", "Close", "Open"], ["Date", "Close"]).collect()
    assert [(r["Date"], r["Close"], r["Open"]) for r in out] == [(dt.date(2024, 1, 2), 5.5, None)]


def test_articles_and_latest_batch(spark, tmp_path):
    doc = {"_id": "1", "abstract": "a", "headline": {"main": "h"}, "pub_date": "2024-01-31T10:00:00",
           "keywords": [{"name": "subject", "value": "Gold"}], "unused": 1}
    (tmp_path / "2024-01.json").write_text(json.dumps(doc) + "\n")
    (tmp_path / "2024-02.json").write_text(json.dumps({**doc, "_id": "2"}) + "\n")
    a = read_articles(spark, str(tmp_path)).withColumn("date", F.substring("pub_date", 1, 10))
    assert {r["batch_month"] for r in a.collect()} == {"2024-01", "2024-02"}
    assert [r["_id"] for r in latest_batch(a).collect()] == ["2"]
    assert flatten_articles(a).first()["headline"] == "h"


def test_a_rerun_replaces_only_its_days(spark, tmp_path):
    path = str(tmp_path / "days")
    two = spark.createDataFrame([("d1", "a"), ("d2", "b")], "date string, text string")
    sinks.write_articles_json(two, path)
    sinks.write_articles_json(spark.createDataFrame([("d2", "c")], "date string, text string"), path)
    back = {r["date"]: r["text"] for r in spark.read.schema("text string, date string").json(path).collect()}
    assert back == {"d1": "a", "d2": "c"}


def test_pending_and_inspection(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0])], "k int, v array<double>")
    assert [r["k"] for r in sinks.pending(df, df.filter("k = 1"), ["k"]).collect()] == [2]
    info = {r["column"]: r for r in inspect_tables({"t": df}).collect()}
    assert info["v"]["first_value"].startswith("size ") and info["k"]["n_rows"] == 2
