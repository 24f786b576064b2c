import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillmere.session import shared_dir
from quillmere.sources import collections, files, jdbc, registry, rest


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("café ".encode("latin-1"))
    (tmp_path / "sub" / "b.md").write_text("# Head\n\ntext")
    (tmp_path / "c.csv").write_text("id,name\n" + "".join(f"{i},n{i}\n" for i in range(25)))
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    return tmp_path


def test_directory_scan(spark, folder):
    rows = files.scan_directory(spark, str(folder), ["*.txt", "*.md", "a*"])
    assert {r["file_name"]: (r["file_size"], r["file_extension"]) for r in rows.collect()} == {
        "a.txt": (5, ".txt"), "b.md": (12, ".md")
    }


def test_object_scan(spark, folder):
    rows = files.scan_objects(spark, str(folder), "sub").collect()
    assert [(r["key"], r["size"], bytes(r["content"])) for r in rows] == [("sub/b.md", 12, b"# Head\n\ntext")]
    listing = files.scan_objects(spark, str(folder)).select("key", "size")
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_load_documents(spark, folder):
    loaded = files.load_documents(files.scan_directory(spark, str(folder)))
    good, rejects = files.split_rejects(loaded)
    texts = {r["filename"]: r["content"] for r in good.collect()}
    assert texts["a.txt"] == "café" and texts["b.md"] == "Head\n\ntext"
    assert texts["c.csv"].startswith("CSV Data from c.csv:\n\nColumns: id, name\nTotal rows: 25\n\nSample data:\n0,n0\n")
    assert texts["c.csv"].endswith("9,n9")
    assert [(r["file_path"][-5:], r["error"]) for r in rejects.collect()] == [("d.pdf", "no text reader for pdf")]


CSV_FORMS = {
    "plain.csv": "a,b\n1,2\n3,4\n",
    "header only.csv": "a,b",
    "quotes.csv": 'id,"x, ""y""", z \n1,"two\nlines",\n\n2,"""",w\n3,"a\n\nb\n",c\n',
    "windows.csv": 'id,t\r\n1,"x\r\ny"\r\n2,z\r\n\r\n',
    "one long record.csv": "id,t\n" + '1,"' + "line\n" * 400 + '"\n2,x\n',
    "many.csv": "id,t\n" + "".join(f'{i},"{"q" * (i % 40)}\n{"" if i % 3 else chr(34) * 2}"\n' for i in range(120)),
    "open.csv": 'id,t\n1,"never\nclosed\n',
    "signs.csv": "naïve,日本\né,語\n",
}


@pytest.mark.parametrize("size", [48, 500, 1 << 20])
def test_csv_digest_is_one_however_files_are_split(spark, tmp_path, size):
    from quillmere.functions import text as tx

    for name, content in CSV_FORMS.items():
        (tmp_path / name).write_bytes(content.encode())
    (tmp_path / "empty.csv").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key, value in zip(before, (size, 1)):
            spark.conf.set(key, str(value))
        got = {r["file_path"].rsplit("/", 1)[1].replace("%20", " "): r for r in files.csv_digest(spark, str(tmp_path)).collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    rows = spark.createDataFrame(list(CSV_FORMS.items()), "n string, c string")
    wanted = {r["n"]: r["d"] for r in rows.select("n", tx.csv_digest_text(F.col("n"), F.col("c")).alias("d")).collect()}
    assert {n: r["content"].replace("%20", " ") for n, r in got.items()} == wanted
    assert {n: r["total_rows"] for n, r in got.items()} == {
        "plain.csv": 2, "header only.csv": 0, "quotes.csv": 3, "windows.csv": 2, "one long record.csv": 2, "many.csv": 120,
        "open.csv": 1, "signs.csv": 1}
    assert 'Columns: id, x, "y", z\n' in got["quotes.csv"]["content"]


def test_csv_digest_of_a_split_table(spark, folder):
    row = files.csv_digest(spark, str(folder / "c.csv")).first()
    assert row["total_rows"] == 25
    assert row["content"].endswith("Sample data:\n" + "\n".join(f"{i},n{i}" for i in range(10)))


def pages(total, fail_at=None):
    def fetch(endpoint, page, limit):
        if page == fail_at:
            raise RuntimeError("down")
        rows = [{"i": i} for i in range((page - 1) * limit, min(page * limit, total))]
        return {"results": rows} if endpoint == "b" else rows

    return fetch


@pytest.mark.parametrize("stripes", [1, 3])
@pytest.mark.parametrize("total", [0, 5, 20, 47])
def test_pages(spark, stripes, total):
    records, errors = rest.scan_endpoints(spark, ["a", "b"], pages(total), page_size=10, stripes=stripes)
    got = [json.loads(r["data"])["i"] for r in records.filter("endpoint = 'b'").collect()]
    assert sorted(got) == list(range(total)) and errors.count() == 0


@pytest.mark.parametrize("stripes", [1, 3])
def test_a_failed_page_ends_its_endpoint(spark, stripes):
    records, errors = rest.scan_endpoints(spark, ["a"], pages(100, fail_at=3), page_size=10, stripes=stripes)
    assert sorted(json.loads(r["data"])["i"] for r in records.collect()) == list(range(20))
    assert [(r["page"], r["error"]) for r in errors.collect()] == [(3, "down")]


def test_page_bodies():
    assert rest.page_records([1]) == [1] and rest.page_records({"data": [1, 2]}) == [1, 2]
    assert rest.page_records({"x": 1}) == [{"x": 1}] and rest.page_records("s") == ["s"] and rest.page_records([]) == []


def test_jdbc_options():
    config = {
        "type": "postgresql", "host": "h", "port": 1, "database": "d", "username": "u", "password": "p",
        "partitions": {"t": {"column": "id", "lower": 0, "upper": 100, "count": 4}},
    }
    assert jdbc.table_options(config, "t") == {
        "url": "jdbc:postgresql://h:1/d", "fetchsize": "10000", "user": "u", "password": "p", "dbtable": "t",
        "partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "4",
    }
    assert "partitionColumn" not in jdbc.table_options(config, "other")


def test_jdbc_scan(spark, monkeypatch):
    """The reader itself needs a database; its options and the shape of the
    records do not."""
    seen = []

    def fake(session, options):
        seen.append(options.get("dbtable") or options.get("query"))
        return session.createDataFrame([(1, "x"), (2, "y")], "id int, name string")

    monkeypatch.setattr(jdbc, "_load", fake)
    config = {"url": "jdbc:x", "tables": ["a", "b"], "incremental": "id"}
    rows = jdbc.scan_database(spark, config, "2024-01-01 00:00:00")
    assert {(r["table"], r["data"]) for r in rows.collect()} == {
        (t, json.dumps({"id": i, "name": n}, separators=(",", ":"))) for t in "ab" for i, n in ((1, "x"), (2, "y"))
    }
    assert jdbc.scan_table(spark, config, "a", "2024-01-01 00:00:00", mark=1).count() == 1
    assert jdbc.scan_database(spark, {"url": "jdbc:x", "query": "select 1"}, None).first()["table"] == "custom_query"
    assert seen == ["a", "b", "a", "select 1"]


def test_extract_runs_lose_nothing(spark):
    """Late rows at the mark, rows without a value, a run without news, a
    repeated run, repeated rows, and an empty table."""
    root, shape = shared_dir(spark, "extract"), "id int, at int, name string"
    rows = lambda *r: spark.createDataFrame(list(r), shape)
    run = lambda n, *r: sorted(tuple(x) for x in jdbc.extract_run(rows(*r), "at", root, n).collect())
    first = [(1, 5, "a"), (2, 7, "b"), (9, None, "n")]
    assert run(1) == []
    assert {r[0] for r in jdbc.extract_run(rows(*first), "at", root, 2).collect()} == {1, 2, 9}
    late = [*first, (3, 7, "late"), (10, None, "m")]
    assert {r[0] for r in jdbc.extract_run(rows(*late), "at", root, 3).collect()} == {3, 10}
    assert run(4, *late) == []
    assert {r[0] for r in jdbc.extract_run(rows(*late), "at", root, 3).collect()} == {3, 10}  # again
    more = [*late, (4, 7, "later"), (5, 8, "next"), (5, 8, "next")]
    assert sorted(r[0] for r in jdbc.extract_run(rows(*more), "at", root, 5).collect()) == [4, 5, 5]
    assert run(6, *more) == []
    kept = spark.read.parquet(f"{root}/marks/run=6").filter("mark is not null").collect()
    assert {r["mark"] for r in kept} == {8} and len(kept) == 1


def test_the_range_is_pushed_to_the_source(spark):
    root = shared_dir(spark, "extract")
    spark.range(100).selectExpr("id", "id % 10 AS at").write.parquet(f"{root}/t")
    seen = spark.createDataFrame([("x", 7)], "digest string, mark long")
    plan = jdbc.from_mark(spark.read.parquet(f"{root}/t"), "at", 7, seen)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(GreaterThanOrEqual(at,7),IsNull(at))]" in plan


def test_jdbc_scan_with_state(spark, monkeypatch):
    root, there = shared_dir(spark, "extract"), [(1, 1)]
    monkeypatch.setattr(jdbc, "_load", lambda session, options: session.createDataFrame(there, "id int, at int"))
    config = {"url": "jdbc:x", "tables": ["a"], "incremental": "at", "keys": {"a": ["id"]}}
    scan = lambda run: [json.loads(r["data"])["id"] for r in jdbc.scan_table(spark, config, "a", None, state=root, run=run).collect()]
    assert scan(1) == [1]
    there.append((2, 1))
    assert scan(2) == [2] and scan(3) == []


def test_collections(spark, tmp_path):
    (tmp_path / "posts").mkdir()
    (tmp_path / "posts" / "x.json").write_text('{"_id": {"$oid": "5f"}, "status": "published"}\n{"_id": {"$oid": "60"}, "status": "draft"}\n')
    rows, skipped = collections.scan_collections(spark, str(tmp_path), ["posts", "gone"], {"status": "published"})
    assert [json.loads(r["data"]) for r in rows.collect()] == [{"_id": "5f", "status": "published"}]
    assert list(skipped) == ["gone"]


def test_source_kinds(spark, folder):
    files = registry.read_source(spark, "filesystem", {"root_path": str(folder), "file_patterns": ["*.txt"]})
    assert files.rows.count() == 1 and files.problems.count() == 0
    api = registry.read_source(spark, "api", {"endpoints": ["a"], "fetch": pages(3)}, datetime(2024, 1, 1))
    assert {r["extracted_at"] for r in api.rows.collect()} == {datetime(2024, 1, 1)} and api.rows.count() == 3

    def failing(endpoint, page, limit):
        raise OSError("no route")

    broken = registry.read_source(spark, "api", {"endpoints": ["a"], "fetch": failing})
    assert [tuple(r) for r in broken.problems.collect()] == [("a, page 1", "no route")] and broken.rows.count() == 0
    with pytest.raises(ValueError):
        registry.read_source(spark, "fax", {})


def test_large_files_keep_their_row(spark, folder):
    rows = files.scan_directory(spark, str(folder), limit=1).select("file_name", "content", "file_size").collect()
    assert rows and all((r["content"] is None) == (r["file_size"] > 1) for r in rows)


def test_pages_are_fetched_once(spark, tmp_path):
    calls = tmp_path / "calls"

    def fetch(endpoint, page, limit):
        with calls.open("a") as log:
            log.write(f"{endpoint} {page}\n")
        return [{"n": page}] * (limit if page < 3 else 1)

    records, errors = rest.scan_endpoints(spark, ["a"], fetch, page_size=2)
    assert records.count() == 5 and errors.count() == 0 and records.filter("page = 1").count() == 2
    assert sorted(calls.read_text().split("\n")[:-1]) == ["a 1", "a 2", "a 3"]


def test_nulls_stay_in_records(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.json").write_text('{"a": 1, "b": null}\n{"a": null, "b": 2}\n')
    rows, _ = collections.scan_collections(spark, str(tmp_path), ["c"])
    assert sorted(r["data"] for r in rows.collect()) == ['{"a":1,"b":null}', '{"a":null,"b":2}']


def test_union_fills_missing_columns(spark):
    parts = [spark.range(1).withColumn("a", F.lit(1)), spark.range(1).withColumn("b", F.lit(2))]
    assert sorted(jdbc.union_sources(parts).columns) == ["a", "b", "id"]
