import datetime as dt

from pyspark.sql import functions as F

from foliospark.config import Settings
from foliospark.operators import jobs, sheets, stats

GRID = "doc_id string, sheet_idx int, sheet_name string, row_idx int, cells array<string>"


def grid(spark, rows, name="sales", doc="testdoc"):
    return spark.createDataFrame([(doc, 0, name, k, r) for k, r in enumerate(rows)], GRID)


def test_worked_sheet(spark):
    rows, heads = sheets.from_grid(grid(spark, [["region", "revenue"], ["North", "1200"], ["South", "3400"]]))
    got = {r["role"]: r for r in sheets.chunks(rows, heads).collect()}
    assert got["parent"]["chunk_id"] == "e0c7ca5baebf4a18" and got["child"]["chunk_id"] == "e16848c11b41f913"
    assert list(got["child"]["row_range"]) == [0, 1]


def test_headers(spark):
    _, heads = sheets.from_grid(grid(spark, [["1", "2", "3"], ["4", "5"]]))
    assert (heads.first()["has_header"], list(heads.first()["columns"])) == (False, ["col_0", "col_1", "col_2"])
    _, heads = sheets.from_grid(grid(spark, [["1", "x"], ["4", "5"]]))  # exactly half: a header
    assert heads.first()["has_header"]
    rows, heads = sheets.from_grid(grid(spark, [["a", "", None], ["1", "NA"], [None, "", "z", "wide"]]))
    assert list(heads.first()["columns"]) == ["a", "col_1", "col_2", "col_3"]
    kinds = [r["dtype"] for r in sheets.dtypes(rows, heads).orderBy("pos").collect()]
    assert kinds == ["int64", "object", "object", "object"]
    rows, heads = sheets.from_grid(grid(spark, [["a", "b"]]))
    assert rows.count() == 0 and sheets.chunks(rows, heads).count() == 1


def test_guard_and_batches(spark):
    rows, heads = sheets.from_grid(grid(spark, [["a", "b"], *[["1", "2"]] * 30]))
    few = sheets.batches(rows, heads, Settings(max_rows_per_chunk=3))
    assert few.agg(F.max(F.col("last_row") - F.col("first_row"))).first()[0] == 2
    guarded = sheets.chunks(rows, heads, Settings(max_rows_for_row_chunking=29)).collect()
    assert len(guarded) == 1 and "structured_query" in guarded[0]["metadata"]


def rollup(spark, *states):
    files = spark.createDataFrame([("j", str(k), s) for k, s in enumerate(states)], "job_id string, file_id string, status string")
    r = jobs.rollup(files, spark.createDataFrame([("j",)], "job_id string")).first()
    return r["progress"], r["status"]


def test_rollup(spark):
    assert rollup(spark) == (0, "queued")
    assert rollup(spark, "done", "running", "queued") == (50, "running")
    assert rollup(spark, "done", "partial") == (100, "partial")
    assert rollup(spark, "done", "queued")[1] == "running" and rollup(spark, "queued", "queued")[1] == "queued"
    assert rollup(spark, "done", "done")[1] == "done" and rollup(spark, "done", "failed")[1] == "partial"
    assert rollup(spark, "failed", "failed")[1] == "failed"
    assert rollup(spark, "done", *["queued"] * 7)[0] == 12


def test_latest_ignores_late_rows(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    log = spark.createDataFrame([("j", "f", "done", 100, at(3)), ("j", "f", "running", 50, at(1)), ("j", "f", "running", 50, at(3))], "job_id string, file_id string, status string, progress int, updated_at timestamp")
    assert jobs.latest(log).first()["status"] == "done"


def test_uploads(spark):
    files = spark.createDataFrame([("a.pdf", 5), ("B.CSV", 0), ("bad.txt", 5), ("big.pdf", 10**9)], "filename string, length bigint")
    got = {r["filename"]: r["rejected"] for r in jobs.validate(files, {".pdf", ".csv"}).collect()}
    assert got == {"a.pdf": None, "B.CSV": 400, "bad.txt": 415, "big.pdf": 413}


def test_flat_json_overwrites(spark):
    cols = "chunk_id string, doc_id string, parent_id string, role string, block_type string, text string, section_path array<string>, source_uri string, file_type string, page int, slide_number int, sheet_name string, row_range array<int>, token_count int, metadata string"
    row = ("c", "d", None, "child", "row", "t", ["a", "b"], "u", "csv", None, None, "s", [1, 2], 1, '{"role": "x", "k": "v"}')
    got = stats.flat_json(spark.createDataFrame([row], cols)).first()["metadata"]
    assert '"role":"x"' in got and '"row_start":"1"' in got and '"section_path":"a > b"' in got and "page" not in got.replace("page_", "")


def test_every_row_of_large_tables_is_packed(spark):
    from foliospark.plans import catalogue

    folder = "/root/testdata/sf0.001"
    rows, heads = catalogue._cut_sheets(spark, folder, most=40)
    assert rows.filter("row_idx >= 40").count() == 0 and heads.filter("doc_id = 'customer'").count() == 4
    cfg = Settings(max_rows_for_row_chunking=40)
    packed = sheets.batches(rows, heads, cfg)
    assert packed.selectExpr("sum(last_row - first_row + 1)").first()[0] == sum(spark.read.parquet(f"{folder}/{t}.parquet").count() for t in ("customer", "supplier", "part", "nation"))
