"""Pages from a folder to a table: restarts, equal contents, batches that are run again."""

import hashlib
import shutil

from geoweave.streaming import inbox, progress

PAGE = "path string, key string, length long"


def run(spark, base, name="*.pdf", **options):
    pages = inbox.new_pages(inbox.watch_folder(spark, str(base / "in"), name, files_per_batch=2), **options)
    q = inbox.deliver(pages, str(base / "out"), str(base / "cp"), availableNow=True)
    q.awaitTermination()
    return inbox.delivered(spark, str(base / "out"), PAGE + ", batch_id long").collect()


def key(content):
    return hashlib.sha256(content).hexdigest()[:24]


def test_pages_arrive_once(spark, tmp_path):
    """Two runs and one of a lost commit: equal contents, too large pages, other files, a file of no bytes."""
    folder = tmp_path / "in"
    folder.mkdir()
    assert run(spark, tmp_path) == []
    files = {"a.pdf": b"one", "b.pdf": b"two", "c.pdf": b"one", "d.txt": b"three", "e.pdf": b"x" * 100, "f.pdf": b""}
    for n, content in files.items():
        (folder / n).write_bytes(content)
    first = run(spark, tmp_path, most_bytes=50)
    assert sorted((r["key"], r["length"]) for r in first) == sorted((key(c), len(c)) for c in (b"one", b"two"))
    assert len({r["path"] for r in first}) == 2
    assert sorted(run(spark, tmp_path, most_bytes=50)) == sorted(first)  # nothing new
    (folder / "g.pdf").write_bytes(b"two")  # known from an earlier run
    (folder / "h.pdf").write_bytes(b"four")
    second = run(spark, tmp_path, most_bytes=50)
    assert sorted(r["key"] for r in second) == sorted(key(c) for c in (b"one", b"two", b"four"))
    # the commit of the last batch is lost after it was written: it is run again and takes its own place
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert sorted((r["key"], r["length"]) for r in run(spark, tmp_path, most_bytes=50)) == sorted((r["key"], r["length"]) for r in second)
    # without the sink's folder nothing comes back: the state, not the sink, knows the pages
    shutil.rmtree(tmp_path / "out")
    assert run(spark, tmp_path, most_bytes=50) == []


def test_event_lines_are_written_once(spark, tmp_path):
    """Event lines through the same sink, over two runs."""
    schema = "job_id long, seq long, type string"
    for part in range(2):
        spark.createDataFrame([(1, 2 * part, "step"), (2, 2 * part + 1, "done")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        lines = progress.sse_lines(spark.readStream.schema(schema).parquet(str(tmp_path / "events")))
        inbox.deliver(lines, str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    got = inbox.delivered(spark, str(tmp_path / "out"), "job_id long, line string, batch_id long").collect()
    assert sorted(r["line"] for r in got) == [f'data: {{"seq":{k},"type":"{"done" if k % 2 else "step"}"}}\n\n' for k in range(4)]
    assert {r["batch_id"] for r in got} == {0, 1}
