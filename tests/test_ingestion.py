"""Ingestion of a folder: what is read again, what is not, and runs that were stopped."""

import os

from lexaloom.streaming import ingestion
from lexaloom.streaming.ingestion import Ingestion


def put(folder, name, data, at=1_000_000):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    os.utime(path, (at, at))


def texts(job):
    return {r["path"].rsplit("/", 1)[-1]: r["text"] for r in job.texts().collect()}


def test_runs(spark, tmp_path):
    source = tmp_path / "in"
    put(source, "a.md", b"# A")
    put(source, "sub/b.txt", b"b text")
    put(source, "c.html", b"<p>c <b>bold</b></p>")
    put(source, "broken.docx", b"no archive")
    put(source, "large.txt", b"x" * 2000)
    job = Ingestion(spark, str(source), str(tmp_path / "kept"), tries=2, most_bytes=1000, most_files=3)
    assert job.run_all() == 5
    first = texts(job)
    assert set(first) == {"a.md", "b.txt", "c.html"} and first["a.md"] == "# A" and "bold" in first["c.html"]
    state = {r["path"].rsplit("/", 1)[-1]: r for r in job.known.state().collect()}
    assert state["broken.docx"]["error"] and state["broken.docx"]["tried"] == 1 and state["large.txt"]["hash"].startswith("stat ")
    # not opened: same size and time, other bytes; touched: opened, same text; changed; gone; new; retried once more
    put(source, "a.md", b"# Z")
    put(source, "sub/b.txt", b"b text", at=2_000_000)
    put(source, "c.html", b"<p>new</p>", at=2_000_000)
    before = state["b.txt"]["texts"]
    (source / "large.txt").unlink()
    put(source, "d.txt", b"d")
    assert job.run_all() == 5
    assert texts(job) == {"a.md": "# A", "b.txt": "b text", "c.html": "new", "d.txt": "d"}
    state = {r["path"].rsplit("/", 1)[-1]: r for r in job.known.state().collect()}
    assert state["b.txt"]["texts"] == before and state["broken.docx"]["tried"] == 2 and "large.txt" not in state
    assert job.run_all() == 0  # tried often enough
    put(source, "broken.docx", b"still none", at=3_000_000)
    assert job.run_all() == 1
    job.known.compact()
    assert job.run_all() == 1 and job.run_all() == 0 and texts(job)["d.txt"] == "d"


def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    for k in range(6):
        put(source, f"f{k}.txt", b"text %d" % k)
    job = Ingestion(spark, str(source), str(tmp_path / "kept"), most_files=4)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(job.known, "apply", stop)
        try:
            job.run_all()
        except RuntimeError:
            pass
    assert texts(job) == {}
    put(source, "a.txt", b"came later")  # the manifest that was begun does not have it
    again = Ingestion(spark, str(source), str(tmp_path / "kept"), most_files=4)
    assert again.run() == 4 and set(texts(again)) == {f"f{k}.txt" for k in range(4)}
    assert again.run_all() == 3 and len(texts(again)) == 7
    assert again.run_all() == 0
    (source / "f0.txt").unlink()
    put(source, "f1.txt", b"other length", at=5)
    with monkeypatch.context() as m:
        m.setattr(again, "_texts", stop)
        try:
            again.run_all()
        except RuntimeError:
            pass
    put(source, "f1.txt", b"changed once more!", at=6)
    assert again.run(()) == 2
    state = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in again.known.state().collect()}
    assert "f0.txt" not in state and state["f1.txt"] == "changed while it was read"
    assert again.run_all() == 1 and texts(again)["f1.txt"] == "changed once more!"


def test_plan(spark):
    known = [("same", 1, 1, "h", 0, None, 0), ("touched", 1, 1, "h", 0, None, 0), ("gone", 1, 1, "h", 0, None, 0), ("failed", 1, 1, None, 2, "e", None), ("given-up", 1, 1, None, 3, "e", None), ("mended", 1, 1, None, 3, "e", None)]
    scan = [("same", 1, 1), ("touched", 1, 2), ("failed", 1, 1), ("given-up", 1, 1), ("mended", 2, 1), ("new", 1, 1), ("large", 99, 1)]
    got = ingestion.plan(spark.createDataFrame(scan, "path string, size long, mtime long"), spark.createDataFrame(known, ingestion.KNOWN), 3, 50)
    assert {r["path"]: (r["action"], r["tried"]) for r in got.collect()} == {
        "same": ("same", 0), "touched": ("read", 0), "gone": ("gone", 0), "failed": ("retry", 2), "given-up": ("same", 0), "mended": ("read", 0), "new": ("read", 0), "large": ("large", 0),
    }
