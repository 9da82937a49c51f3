import pytest
from pyspark.sql import functions as F

from panelcast.operators.registry import Registry
from panelcast.operators.validate import validate_columns
from panelcast.session import shared_dir, workspace
from panelcast.sinks import writers
from panelcast.sources import readers
from panelcast.sources.ingest import ingest
from panelcast.sources.roles import Roles, detect_panel_roles, detect_series_roles, is_wide
from panelcast.spec import SeriesSpec

SPEC = SeriesSpec()


def test_roles():
    assert detect_series_roles(["Qty", "DATE", "sales"]) == Roles("DATE", "sales")
    assert detect_series_roles(["a", "b"]) == Roles(None, None)
    assert detect_panel_roles(["Date", "WEEK", "Units_Sold", "Store", "SKU"]) == Roles("Date", "Units_Sold", "Store", "SKU")
    days = [f"d_{i}" for i in range(1, 102)]
    assert is_wide(["item_id", *days]) and not is_wide(["item_id", *days[:100]]) and not is_wide(["name", *days])


def test_csv_round_trip_and_skipped_sources(spark, panel, tmp_path):
    df = panel({("A", "x"): range(120)}).select("date", F.col("units_sold").alias("sales"))
    good = writers.write_csv(df, str(tmp_path / "good"))
    odd = writers.write_csv(df.withColumnRenamed("sales", "other"), str(tmp_path / "odd"))
    merged, skipped = readers.read_many(spark, [good, odd, str(tmp_path / "absent")], "date", "sales")
    assert merged.count() == 120 and [s[0] for s in skipped] == [odd, str(tmp_path / "absent")]
    assert readers.peek_columns(spark, good) == ["date", "sales"]
    assert readers.read_folder(spark, good).count() == 120
    with pytest.raises(readers.IngestError):
        readers.read_folder(spark, str(tmp_path / "absent"))
    clean, meta = ingest(spark, [good])
    assert clean.count() == meta["n_rows"] == 120 and meta["date_range"] == ("2024-01-01", "2024-04-29") and meta["warnings"] == []
    with pytest.raises(readers.IngestError, match="insufficient"):
        ingest(spark, [good], min_rows=121)
    with pytest.raises(readers.IngestError, match="cannot tell"):
        ingest(spark, [odd])
    assert validate_columns(df, ["date", "price"]) == (False, "Missing columns: ['price']")


def test_headers_take_the_first_bytes(spark, tmp_path):
    """Columns in any order, quoted names, empty, compressed and very wide files; long bodies are not read for it."""
    import gzip

    from panelcast.sinks import files

    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.csv").write_text("date,sales\n2024-01-01,1\n" + "2024-01-02,1\n" * 30_000)
    (folder / "b.csv").write_text('\ufeff"sales","date","note, long"\r\n2,2024-01-01,"x\ny"\r\n')
    (folder / "empty.csv").write_text("")
    (folder / "odd.csv").write_text("day,sales\n2024-01-01,100\n")
    (folder / "notes.txt").write_text("date,sales\n2024-01-01,1000\n")
    (folder / "_hidden.csv").write_text("date,sales\n2024-01-01,1000\n")
    (folder / "deep" / "c.csv.gz").write_bytes(gzip.compress(b"date,sales\n2024-01-01,4\n"))
    wide = ",".join([f"c{i}" for i in range(20_000)])
    (folder / "wide.csv").write_text(f"{wide},date,sales\n{',' * 20_000}2024-01-01,8\n")
    df, skipped = readers.read_usable(spark, [str(folder)], "date", "sales", pathGlobFilter="*.csv*", multiLine="true")
    assert df.where("date = '2024-01-01'").agg(F.sum(F.col("sales").cast("int"))).first()[0] == 1 + 2 + 4 + 8
    assert sorted((p.rsplit("/", 1)[1], why) for p, why in skipped) == [("empty.csv", "no header line"), ("odd.csv", "no column date")]
    head = files.first_bytes(spark, [str(folder / "a.csv"), str(folder / "absent")], 10)
    assert head[0] == b"date,sales" and isinstance(head[1], Exception)
    assert "," in readers._headers(spark, [str(folder / "wide.csv")], "utf-8")[0][-12:]
    with pytest.raises(readers.IngestError, match="none of the sources"):
        readers.read_usable(spark, [str(folder / "empty.csv"), str(tmp_path / "nowhere")], "date", "sales")


def test_wide_melt(spark):
    wide = spark.createDataFrame([("a", "1", "2", None), ("b", "10", None, "x")], "item_id string, d_1 string, d_2 string, d_4 string")
    got = {str(r.date): r.demand for r in readers.melt_wide(wide, "2024-01-01").collect()}
    assert got == {"2024-01-01": 11.0, "2024-01-02": 2.0, "2024-01-04": 0.0}


def test_manifest(spark, sf_dir):
    row = readers.source_manifest(spark.read.parquet(f"{sf_dir}/orders.parquet")).first()
    assert row.file_name == "orders.parquet" and row.bytes > 0


def test_repeated_run_leaves_no_copies(spark, panel, tmp_path):
    path = str(tmp_path / "runs")
    for _ in range(2):
        writers.append_run(panel({("A", "x"): [1, 2]}), path, "r1")
    writers.append_run(panel({("A", "x"): [3]}), path, "r2")
    assert writers.read_runs(spark, path).count() == 3


def test_registry(spark, tmp_path):
    store = Registry(spark, str(tmp_path / "registry"))
    assert store.count() == 0
    store.register("a", "hybrid", metrics={"rmse": 2.0, "mae": 1.0}, tags=["x"])
    store.register("b", "sequence")
    with pytest.raises(ValueError, match="already"):
        store.register("a", "hybrid")
    assert store.update_metrics("a", {"rmse": 1.5}) and store.add_tags("a", ["y"]) and not store.add_tags("zz", ["y"])
    row = store.get("a").first()
    assert row.metrics == {"rmse": 1.5, "mae": 1.0} and sorted(row.tags) == ["x", "y"]
    assert [r.name for r in store.list().collect()] == ["b", "a"] and store.latest("hybrid").first().name == "a"
    store.register("a", "hybrid", version="2.0.0", overwrite=True)
    assert store.get("a").first().metrics is None and store.get("a").first().version == "2.0.0"
    assert store.remove("b") and not store.exists("b")
    store.clear()
    assert store.count() == 0


def test_shared_folder_comes_from_the_session(spark):
    assert workspace(spark, "t").startswith(shared_dir(spark))
