"""Landed provider files: row arrays, column pairs in either order, last row wins."""

import hashlib
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import signals as S
from tidemark.plans.study import Study
from tidemark.session import stage_root
from tidemark.sources import bars as B
from tidemark.sources import files


def test_row_array_files_and_other_shapes(spark, tmp_path):
    for name, rows in (("a", [{"Date": "2024-01-04", "Code": "62730", "Mkt": "0111", "S33": "0050"}]), ("b", [{"Date": "2024-01-04", "Code": "62740", "Mkt": "0111", "S33": " 0050"}] * 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, indent=2))
    df = B.read_json_rows(spark, str(tmp_path), B.MASTER_SCHEMA)
    assert df.count() == 3
    out = B.normalize_master(df.withColumn("ingest_pos", F.monotonically_increasing_id())).collect()
    assert sorted((r.Code, r.S33, r.CoName) for r in out) == [("62730", "0050", ""), ("62740", "0050", "")]
    bad = tmp_path / "bad"
    os.mkdir(bad)
    (bad / "x.json").write_text("not json")
    with pytest.raises(Exception):
        B.read_json_rows(spark, str(bad), B.MASTER_SCHEMA).collect()


@pytest.mark.parametrize("swap", [False, True])
def test_wide_table_in_either_level_order(spark, swap):
    name = (lambda t, f: f"{f}|{t}") if swap else (lambda t, f: f"{t}|{f}")
    cols = {name(t, f): float(i * 10 + j) for i, t in enumerate(("a", "b")) for j, f in enumerate(("Open", "High", "Low", "Close", "Volume"))}
    wide = spark.createDataFrame([("2024-01-04", *cols.values()), ("2024-01-05", *[None] * 10)], "Date string, " + ", ".join(f"`{c}` double" for c in cols))
    rows = sorted(map(tuple, B.wide_to_long(wide).collect()))
    assert rows == [("a", "2024-01-04", 0.0, 1.0, 2.0, 3.0, 4.0), ("b", "2024-01-04", 10.0, 11.0, 12.0, 13.0, 14.0)]


def test_bad_numbers_become_null_and_basis_is_checked(spark):
    row = {n: "1" for n in B.BAR_FIELDS} | {"Date": "2024-01-04", "Code": "62730", "C": "n/a", "AdjO": "10"}
    df = B.normalize_bars(spark.createDataFrame([row | {"ingest_pos": 0}]))
    assert df.first().C is None and B.price_basis(df, "adjusted").first().open == 10.0
    assert B.clean_ohlcv(B.price_basis(df, "raw")).count() == 0
    with pytest.raises(ValueError):
        B.price_basis(df, "other")


def test_stage_folder_is_kept_for_the_session(spark):
    assert stage_root(spark) == stage_root(spark)


def test_bundle_hash_is_a_tree_over_path_hashes(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(f"raw/k={i}", 1, sha(str(i)), "c" if i % 3 else "d") for i in range(700)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "relative_path string, bytes long, sha256 string, category string")

    def root(nodes, digits=(4, 2, 0)):
        for d in digits:
            up = {}
            for place, h in sorted(nodes):
                up.setdefault(place[:d], []).append(h)
            nodes = [(place, sha("".join(hs))) for place, hs in up.items()]
        return nodes[0][1]

    got = {r.category: (r.files, r.bundle_sha256) for r in files.bundle_hashes(df).collect()}
    for c in "cd":
        mine = [(sha(r[0]), sha(f"{r[0]}:{r[2]}")) for r in rows if r[3] == c]
        assert got[c] == (len(mine), root(mine))
    shuffled = files.bundle_hashes(df.orderBy(F.desc("sha256"))).collect()
    assert {r.category: (r.files, r.bundle_sha256) for r in shuffled} == got
    assert files.bundle_hashes(df.limit(0)).count() == 0


def test_tasks_by_ticker_grow_with_the_source(spark):
    from tidemark.sources import bars as B

    rows = spark.range(10).selectExpr("CAST(id AS string) AS ticker")
    few = B.by_ticker(rows).rdd.getNumPartitions()
    assert B.by_ticker(rows, rows=100).rdd.getNumPartitions() == few
    assert B.by_ticker(rows, rows=50 * B.TASK_ROWS + 1).rdd.getNumPartitions() == 51


def lines(spark, folder, n=400):
    """Small line items of 7 suppliers on 40 days, one supplier unknown, and their tables."""
    key = F.when(F.col("id") % 7 > 0, F.col("id") % 7)
    day = F.expr("date_add(date'2024-01-01', cast(id % 40 as int))")
    spark.range(n).select(
        key.alias("l_suppkey"), day.alias("l_shipdate"), (F.col("id") % 11 / 100).alias("l_discount"), (F.col("id") % 9 / 100).alias("l_tax"),
        (F.col("id") % 50 + 1.0).alias("l_quantity"), (F.col("id") % 997 + 1.0).alias("l_extendedprice"),
    ).write.parquet(f"{folder}/lineitem.parquet")


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_a_day_meet_in_tasks_that_grow_with_the_source(spark, tmp_path, monkeypatch):
    lines(spark, tmp_path)
    want = {(r.ticker, r.date): (r.volume, r.va) for r in B.index_bars(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(B, "TASK_ROWS", 20)
    bars = B.index_bars(spark, str(tmp_path))
    assert {(r.ticker, r.date): (r.volume, r.va) for r in bars.collect()} == want
    assert len(want) == 280 and None in {t for t, _ in want}
    # 400 lines, 20 a task; before, the aggregate had the session's count whatever the source.
    assert re.findall(r"hashpartitioning\(ticker#\d+, date#\d+, (\d+)\)", plan_of(bars))[0] == "20"


def test_days_and_weeks_read_one_shuffle(spark, tmp_path):
    lines(spark, tmp_path)
    study = Study(spark, str(tmp_path))
    frame = S.signal_frame(study.clean, liquidity=True)
    plan = plan_of(frame)
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 1
    assert len(re.findall(r"Exchange hashpartitioning", final)) == 2 + 1
    assert frame.where("ticker IS NULL").count() == 40
