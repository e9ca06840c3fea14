from datetime import datetime

from foliospark.operators import jobs, stats

LOG = "job_id string, file_id string, filename string, file_type string, status string, progress int, created_at timestamp, updated_at timestamp"


def test_lookups_and_first_rows(spark):
    uploads = spark.createDataFrame([("f1", "a.pdf", "pdf"), ("f2", "b.csv", "csv")], "file_id string, filename string, file_type string")
    first = jobs.queued("j", uploads)
    assert [(r["job_id"], r["status"], r["progress"]) for r in first.collect()] == [("j", "queued", 0)] * 2
    at = datetime(2024, 1, 1)
    files = spark.createDataFrame([("j", "f2", "b", "csv", "done", 100, at, at), ("j", "f1", "a", "pdf", "queued", 0, at, at), ("k", "f3", "c", "pdf", "done", 100, at, at)], LOG)
    assert [r["file_id"] for r in jobs.files_of(files, "j").collect()] == ["f1", "f2"]
    assert [r["filename"] for r in jobs.file(files, "f3").collect()] == ["c"] and jobs.file(files, "none").count() == 0


def test_finished_rows(spark):
    at = datetime(2024, 1, 1)
    files = spark.createDataFrame([("j", "f1", "a", "pdf", "file:///a.pdf", at)], "job_id string, file_id string, filename string, file_type string, input_path string, created_at timestamp")
    results = spark.createDataFrame([("file:///a.pdf", "partial", 3, 1, 2, 40, "PAGE", ["w"], None)], "source_uri string, status string, chunk_count int, parent_count int, child_count int, total_tokens int, parent_strategy string, warnings array<string>, error string")
    row = jobs.finished(results, files).first()
    assert (row["status"], row["progress"], row["chunk_count"], row["warnings"]) == ("partial", 100, 3, '["w"]')


def test_report_in_order(spark):
    rows = [("pdf", "b", "success", 1, 2, 3, "HEADING", ["x", "y"]), ("csv", "z", "failed", 0, 0, 0, None, []), ("pdf", "a", "success", 1, 1, 1, "PAGE", [])]
    of = spark.createDataFrame(rows, "file_type string, source_uri string, status string, parent_count int, child_count int, total_tokens int, parent_strategy string, warnings array<string>")
    got = stats.report(of).collect()
    assert [(r["file_type"], r["source_uri"]) for r in got] == [("csv", "z"), ("pdf", "a"), ("pdf", "b")] and got[2]["warnings"] == "x; y"


def test_flags_of_sheets(spark):
    chunks = spark.createDataFrame([("d", '{"routing":"structured_query"}'), ("d", None), ("e", '{"sparse_sheet":true}'), ("f", "{}")], "doc_id string, metadata string")
    got = {r["doc_id"]: (r["guarded"], r["sparse_sheet"]) for r in stats.sheet_flags(chunks).collect()}
    assert got == {"d": (True, False), "e": (False, True), "f": (False, False)}
