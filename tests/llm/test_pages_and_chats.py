"""WARC archives, chat collapse, the pipeline and the catalog."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from lexaloom.llm import chat, warc


@pytest.fixture
def pages(spark):
    long = "<p>" + "é word " * 9000 + "</p>\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [
        (5, "http://a/5", "same " * 40), (3, "http://a/3", "same " * 40), (9, None, "same " * 40), (9, None, "same " * 40), (1, "http://b", "short"),
        (2, "http://b\nX: y", "short"), (4, None, None), (6, "", ""), (7, "http://c", long), (8, "http://d", long), (None, "http://e", "none " * 30),
    ]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, payload_digest string, number int")


@pytest.mark.parametrize("segment", [64, 5000, 10**7])
def test_round_trip(pages, segment):
    rows = pages.collect()
    first = {}
    for r in rows:
        if len((r["html"] or "").encode()) >= 100 and r["page_id"] is not None:
            first[r["html"]] = min(first.get(r["html"], 99), r["page_id"])
    want = []
    for r in rows:
        data = (r["html"] or "").encode()
        to = first.get(r["html"])
        to = None if r["page_id"] is None or to == r["page_id"] else to
        want.append((r["page_id"], len(data), hashlib.sha256(data).hexdigest(), "revisit" if to is not None else "response", to))
    key = lambda r: (str(r[0]), str(r[4]))
    assert sorted((tuple(r) for r in warc.round_trip(pages, segment).collect()), key=key) == sorted(want, key=key)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_well_formed(pages, tmp_path):
    warc.write_archives(pages, str(tmp_path / "w"), segment_bytes=1000)
    kinds = []
    for f in (tmp_path / "w").glob("part-*"):
        for fields, block in warc.parse(gzip.GzipFile(fileobj=io.BytesIO(f.read_bytes()))):
            kinds.append(fields["warc-type"])
            assert int(fields["content-length"]) == len(block) <= 1000
    assert kinds.count("continuation") > 50 and "revisit" in kinds


def test_framing():
    for data in (b"", b"a", b"x" * 10_000):
        assert warc.unchunked(warc.chunked(data, 7)) == data
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabcdefgh\r\n0\r\n\r\n")


def test_missing_segments_are_noticed(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(pages.where("page_id = 7"), path, segment_bytes=1000)
    f = max((tmp_path / "w").glob("part-*.gz"), key=lambda x: x.stat().st_size)
    data = gzip.decompress(f.read_bytes()).split(b"\r\n\r\nWARC/1.1\r\nWARC-Type: continuation")
    f.write_bytes(gzip.compress(b"\r\n\r\nWARC/1.1\r\nWARC-Type: continuation".join(data[:3] + data[4:])))
    (tmp_path / "w" / f".{f.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="segments are missing"):
        warc.read_archives(spark, path).collect()


def test_records_of_another_writer(spark, tmp_path):
    response = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>")], b"HTTP/1.1 200 OK\r\n\r\nhello")
    revisit = warc.record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:uuid:2>"), ("WARC-Payload-Digest", "sha256:ab")], b"HTTP/1.1 304 Not Modified\r\n\r\n")
    (tmp_path / "part-0.warc.gz").write_bytes(gzip.compress(response + b"\r\n\r\n") + gzip.compress(revisit + b"\r\n\r\n"))
    got = sorted((tuple(r) for r in warc.read_archives(spark, str(tmp_path)).collect()), key=lambda r: r[3])
    assert got == [(None, 5, hashlib.sha256(b"hello").hexdigest(), "response", None), (None, None, "ab", "revisit", None)]


def brute_chats(rows):
    convs = {}
    for c, k, role, text, *_ in rows:
        convs.setdefault(c, set()).add((k, role, text))
    order = lambda t: [(x is not None, x if x is not None else 0) if i == 0 else (x is not None, x or "") for i, x in enumerate(t)]
    seqs = {c: tuple((r, t) for _, r, t in sorted(v, key=order)) for c, v in convs.items()}
    out = {}
    for c, s in seqs.items():
        if not any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()):
            out.setdefault(s, []).append(c)
    return {min(v, key=lambda c: -1 if c is None else c): (len(s), len(v)) for s, v in out.items()}


def test_chats(spark):
    rows = []
    turns = [("user", "hello"), ("assistant", "hi"), ("user", "more"), ("assistant", None), (None, "last")]
    for c, n in enumerate((1, 2, 3, 5, 5, 4)):
        rows += [(c, k, *turns[k]) for k in range(n)]
    rows += [(10, 0, "user", "hello"), (10, 1, "assistant", "other"), (11, 0, "user", "hell"), (11, 1, "oassistant", "hi"), (12, None, "user", "hello"), (12, None, "user", "hello")]
    rows += [(None, 0, "user", "x"), (None, 0, "user", "hello"), (None, 1, "assistant", "other"), (13, 0, "user", ""), (14, 0, "user", None), (15, 0, "user", "long " * 50_000)]
    df = spark.createDataFrame([(*r, "clash", 2) for r in rows], "conv_id long, turn long, role string, text string, hashes string, last int")
    got = chat.format_chats(df.union(df)).collect()
    assert {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in got if r["conv_id"] is not None} == brute_chats([r for r in rows if r[0] is not None])
    alone = [(r["n_turns"], r["n_copies"], r["text"]) for r in got if r["conv_id"] is None]
    mark = "<|im_start|>{}\n{}<|im_end|>\n".format
    assert sorted(alone) == sorted([(1, 1, mark("user", "x")), (1, 1, mark("user", "hello")), (1, 1, mark("assistant", "other"))] * 2)
    one = next(r["text"] for r in got if r["conv_id"] == 10)
    assert one == "<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_pipeline(spark, docs, tmp_path, tokenizer):
    import corpus_pipeline

    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "never seen " * 8)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).persist()
        assert kept.columns == docs.columns, name
        seen.append({r["doc_id"] for r in kept.select("doc_id").collect()})
    assert seen[0] > seen[1] > seen[2] >= seen[3]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen[3]


def test_catalog_names_every_operator():
    from lexaloom.llm import catalog

    assert {int(n[2:].split("_")[0]) for n in catalog.QUERIES} == set(range(1, 14)) and set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_sieve_passes_every_key(spark):
    from lexaloom.llm.work import sieve

    keys = spark.range(0, 40_000, 7).withColumnRenamed("id", "k")
    test = sieve(keys, "k")
    passed = {r[0] for r in spark.range(40_000).where(test(F.col("id"))).collect()}
    assert passed >= set(range(0, 40_000, 7)) and len(passed) < 6000
