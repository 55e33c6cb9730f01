"""Report store: few files, ranges in document order, nothing visible of what failed."""

import json

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from pageloom import crawl_site, write_outputs
from pageloom.operators import report as rp
from pageloom.sources.packed import TaskFiles, newest, opened, read_index, read_packed, write_packed
from pageloom.sources.snapshots import SEEDS_SCHEMA
from small_site import SITE


def blocks(spark, crawls=300, each=4):
    n = F.col("id") % each
    lines = F.array(F.concat(F.lit("line "), n.cast("string")), F.repeat(F.lit("é"), (F.col("id") % 17).cast("int")))
    return spark.range(crawls * each, numPartitions=6).select((F.col("id") / each).cast("long").cast("string").alias("crawl_id"), n.alias("at"), lines.alias("lines"))


def documents(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.run, r.part, r.nr)):
        out[r.crawl_id] = out.get(r.crawl_id, "") + r.text
    return out


def expected(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r.at):
        out[r.crawl_id] = out.get(r.crawl_id, "") + "\n".join(r.lines) + "\n"
    return out


@pytest.mark.parametrize("options", [{}, {"file_bytes": 2000, "block_bytes": 90}, {"file_bytes": 1, "block_bytes": 1}], ids=str)
def test_documents_come_back(spark, tmp_path, options):
    folder, rows = str(tmp_path / "store"), blocks(spark)
    write_packed(rows, ["at"], folder, **options)
    want = expected(rows)
    assert documents(read_packed(spark, folder)) == want
    index = read_index(spark, folder)
    assert {r.crawl_id: r.n for r in index.groupBy("crawl_id").agg(F.sum("length").alias("n")).collect()} == {c: len(t.encode()) for c, t in want.items()}
    two = spark.createDataFrame([("7",), ("291",), ("none",), ("7",)], "crawl_id string")
    assert documents(read_packed(spark, folder, two)) == {c: want[c] for c in ("7", "291")}


def test_many_crawls_need_few_files(spark, tmp_path):
    folder = str(tmp_path / "store")
    write_packed(blocks(spark, 20_000, 1), ["at"], folder)
    _, runs = newest(*opened(folder))
    assert len(runs[0]["files"]) <= 4 and len(runs[0]["indexes"]) <= 4  # one a task
    assert runs[0]["ranges"] == 20_000
    assert len(list((tmp_path / "store").rglob("*.txt"))) <= 4


def test_one_range_is_read(spark, tmp_path):
    """A range is enough for its crawl: bytes outside it may be anything."""
    folder, rows = str(tmp_path / "store"), blocks(spark, 50, 2)
    write_packed(rows, ["at"], folder)
    keep = read_index(spark, folder).where("crawl_id = '31'").collect()
    for path in (tmp_path / "store").rglob("*.txt"):
        data, clean = bytearray(path.read_bytes()), bytearray(b"#" * path.stat().st_size)
        for r in keep:
            if path.name == r.file.split("/")[-1]:
                clean[r.offset : r.offset + r.length] = data[r.offset : r.offset + r.length]
        path.write_bytes(clean)
        for checksum in path.parent.glob(f".{path.name}.crc"):
            checksum.unlink()
    assert documents(read_packed(spark, folder, spark.createDataFrame([("31",)], "crawl_id string")))["31"] == expected(rows)["31"]


def test_append_and_overwrite(spark, tmp_path):
    folder = str(tmp_path / "store")
    first, second = blocks(spark, 20), blocks(spark, 30)
    write_packed(first, ["at"], folder)
    write_packed(second.where("crawl_id >= '25'"), ["at"], folder, mode="append")
    both = documents(read_packed(spark, folder))
    assert both["25"] == expected(second)["25"] and both["3"] == expected(first)["3"] + expected(second)["3"]
    write_packed(second, ["at"], folder)
    assert documents(read_packed(spark, folder)) == expected(second)
    assert len([p for p in (tmp_path / "store").iterdir() if p.is_dir()]) == 1
    assert len(list((tmp_path / "store").glob("manifest-*.json"))) == 1


def test_a_failed_task_leaves_nothing_visible(spark, tmp_path):
    folder, rows = str(tmp_path / "store"), blocks(spark, 20)
    write_packed(rows, ["at"], folder)

    @F.udf("array<string>")
    def broken(lines, crawl):
        if crawl == "13":
            raise ValueError("broken row")
        return lines

    with pytest.raises(Exception, match="broken row"):
        write_packed(rows.withColumn("lines", broken("lines", "crawl_id")), ["at"], folder)
    assert documents(read_packed(spark, folder)) == expected(rows)
    _, runs = newest(*opened(folder))
    assert len(runs) == 1


def test_files_of_an_attempt_without_a_commit_stay_unseen(spark, tmp_path):
    folder, rows = str(tmp_path / "store"), blocks(spark, 20)
    write_packed(rows, ["at"], folder)
    lost = TaskFiles(folder, "run-lost", 0, 100, 10)
    lost.add("1", b"not committed\n")
    lost.close()
    assert documents(read_packed(spark, folder)) == expected(rows)
    write_packed(rows, ["at"], folder)
    assert not (tmp_path / "store" / "run-lost").exists()
    assert TaskContext.get() is None


def test_empty_and_null(spark, tmp_path):
    rows = blocks(spark, 3)
    write_packed(rows.limit(0), ["at"], str(tmp_path / "empty"))
    assert read_index(spark, str(tmp_path / "empty")).collect() == []
    odd = rows.select(F.when(F.col("crawl_id") != "1", F.col("crawl_id")).alias("crawl_id"), "at", F.when(F.col("at") != 2, F.col("lines")).alias("lines"))
    write_packed(odd, ["at"], str(tmp_path / "odd"))
    got = documents(read_packed(spark, str(tmp_path / "odd")))
    assert set(got) == {None, "0", "2"} and got["0"].count("line") == 3
    with pytest.raises(FileNotFoundError):
        read_index(spark, str(tmp_path / "nothing"))


def test_outputs_of_a_crawl(spark, site_pages, tmp_path):
    seeds = spark.createDataFrame([("one", SITE + "docs/"), ("two", SITE + "docs/guide/")], SEEDS_SCHEMA)
    crawl = crawl_site(site_pages, seeds, 2)
    for layout in ("tree", "flat"):
        write_outputs(crawl, "both", str(tmp_path / layout), layout=layout, packed=True)
        write_outputs(crawl, "both", str(tmp_path / f"{layout}-folders"), layout=layout)
        for name in ("scraped_content", "menu_tree"):
            packed = documents(read_packed(spark, str(tmp_path / layout / name)))
            for crawl_id, text in packed.items():
                parts = sorted((tmp_path / f"{layout}-folders" / name / f"crawl_id={crawl_id}").glob("part-*"))
                assert text == "".join(p.read_text(encoding="utf-8") for p in parts)
            assert set(packed) == {"one", "two"}
        assert json.loads(documents(read_packed(spark, str(tmp_path / layout / "menu_tree")))["one"])["level"] == 0
    body = spark.read.parquet(str(tmp_path / "flat/pages/body"))
    want = rp.flat_pages(rp.number_pages(crawl.content, crawl.scratch), crawl.config)
    assert sorted(map(tuple, body.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        write_outputs(crawl, "text", str(tmp_path), layout="round")
