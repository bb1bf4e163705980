import gzip
import hashlib
import random
import zlib

from pyspark.sql import functions as F

from callweave.llm import warc

from .conftest import sample_documents


def record(i, payload, kind="response", **headers):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if kind == "response" else b"")
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:%d>" % i, b"Content-Type: application/http; msgtype=response", b"WARC-Payload-Digest: sha1:" + hashlib.sha1(payload).hexdigest().encode(), b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def kinds(found):
    return [(x["kind"], x["offset"], x["length"]) for x in found]


def test_whole_archive_round_trips(spark, tmp_path):
    rows = [(i, t, f"http://h/{i}") for i, t, _, _ in sample_documents()] + [(None, "x" * 2000, None), (500, "same" * 300, "u v"), (501, "same" * 300, "u"), (502, "same" * 300, "u"), (502, "same" * 300, "u"), (503, "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "u")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string").repartition(3)
    warc.write_warc(pages, f"{tmp_path}/w", F.col("html"), F.col("page_id"), F.col("url"), bytes_per_file=1000)
    got = warc.read_warc(spark, f"{tmp_path}/w").collect()
    assert {r.kind for r in got} == {"record"} and len(got) == len(rows)
    first = {}
    for i, t, _ in rows:
        if i is not None and len(t or "") >= 1000:
            first[t] = max(first.get(t, i), i)
    wanted = sorted((str(i), len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest(), "revisit" if t in first and i is not None and first[t] != i else "response") for i, t, _ in rows)
    assert sorted((r.record_id.removeprefix("<urn:page:").removesuffix(">") or "None", r.payload_bytes, r.payload_digest, r.record_type) for r in got) == wanted
    revisits = {r.record_id: r.refers_to for r in got if r.record_type == "revisit"}
    assert revisits["<urn:page:500>"] == revisits["<urn:page:501>"] == "<urn:page:502>"


def test_damage_is_passed_over_and_reported():
    a, b, c = record(1, b"first" * 50), record(2, b"second" * 50), record(3, b"third" * 50)
    hurt = bytearray(b)
    hurt[-20] ^= 255  # the digest fails
    found = list(warc.salvage(a + bytes(hurt) + c))
    assert kinds(found) == [("record", 0, len(a)), ("gap", len(a), len(b)), ("record", len(a) + len(b), len(c))]
    assert found[1]["reason"] == "payload digest differs"
    cut = list(warc.salvage(a + b[: len(b) // 2] + c + b"trailing"))
    assert [x["kind"] for x in cut] == ["record", "gap", "record", "gap"]
    assert sum(x["length"] for x in cut) == len(a) + len(b) // 2 + len(c) + 8  # every byte is accounted for
    assert list(warc.salvage(b"")) == []
    assert kinds(warc.salvage(b"junk")) == [("gap", 0, 4)]


def test_any_flipped_byte_loses_no_other_record():
    parts = [record(i, bytes([65 + i]) * 80) for i in range(5)]
    whole, rnd = b"".join(parts), random.Random(3)
    for _ in range(200):
        at = rnd.randrange(len(whole))
        data = whole[:at] + bytes([whole[at] ^ rnd.randint(1, 255)]) + whole[at + 1 :]
        found = list(warc.salvage(data))
        assert sum(x["length"] for x in found) == len(whole)
        hit = next(i for i in range(5) if at < sum(map(len, parts[: i + 1])))
        ids = {x.get("record_id") for x in found if x["kind"] == "record"}
        assert {f"<urn:page:{i}>" for i in range(5) if i != hit} <= ids


def test_gzip_members():
    parts = [record(i, bytes([65 + i]) * 500) for i in range(4)]
    members = [gzip.compress(p) for p in parts]
    assert [x["kind"] for x in warc.salvage_gzip(b"".join(members))] == ["record"] * 4
    hurt = bytearray(members[1])
    hurt[len(hurt) // 2] ^= 255
    found = list(warc.salvage_gzip(members[0] + bytes(hurt) + members[2] + members[3]))
    assert {x["record_id"] for x in found if x["kind"] == "record"} >= {"<urn:page:0>", "<urn:page:2>", "<urn:page:3>"}
    assert any(x["kind"] == "gap" for x in found)
    one = gzip.compress(b"".join(parts[:2]))  # a stream that is cut off keeps what came before
    assert "<urn:page:0>" in {x.get("record_id") for x in warc.salvage_gzip(one[:-12])}


def test_written_archive_loses_only_the_damaged_record(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice("abcdefgh é") for _ in range(800)), f"http://h/{i}") for i in range(40)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, html string, url string").coalesce(1), f"{tmp_path}/w", F.col("html"), F.col("page_id"), F.col("url"))
    (path,) = (tmp_path / "w").glob("part-*")
    whole = path.read_bytes()
    assert gzip.decompress(whole).count(b"WARC-Type: response") == 40  # other readers see plain gzip
    for _ in range(60):
        at = rnd.randrange(len(whole))
        hurt = whole[:at] + bytes([whole[at] ^ rnd.randint(1, 255)]) + whole[at + 1 :]
        found = [x for x in warc.salvage_gzip(hurt) if x["kind"] == "record"]
        assert len({x["record_id"] for x in found}) >= 39
    hurt = whole[:300] + bytes([whole[300] ^ 85]) + whole[301:]
    path.write_bytes(hurt)
    for crc in (tmp_path / "w").glob(".part-*.crc"):
        crc.unlink()
    got = warc.read_warc(spark, f"{tmp_path}/w").collect()
    assert len({r.record_id for r in got if r.kind == "record"}) == 39 and any(r.kind == "gap" for r in got)


def test_records_before_the_damage_are_kept():
    rnd = random.Random(6)
    parts = [record(i, bytes(rnd.choice(b"abcdefgh") for _ in range(300))) for i in range(30)]
    member, block = gzip.compress(b"".join(parts)), 1 << 12
    at = min(block - 200, len(member) - 20)  # within the first step
    engine = zlib.decompressobj(31)
    before = engine.decompress(member[:at]).count(b"WARC/1.1") - 1  # the last may be cut
    hurt = member[:at] + bytes(60) + member[at + 60 :]
    found = list(warc.salvage_gzip(hurt))
    ids = [x["record_id"] for x in found if x["kind"] == "record"]
    assert before > 5 and ids[:before] == [f"<urn:page:{i}>" for i in range(before)]
    (gap,) = [x for x in found if x["kind"] == "gap"]
    assert gap["offset"] >= at - 200 and gap["offset"] + gap["length"] == len(hurt)


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, html string, url string")
    warc.write_warc(none, f"{tmp_path}/n", F.col("html"), F.col("page_id"), F.col("url"))
    assert warc.read_warc(spark, f"{tmp_path}/n").count() == 0


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    rnd = random.Random(9)
    text = lambda n: "".join(chr(rnd.randrange(32, 1000)) for _ in range(n))
    rows = [(i, text(2_000), f"http://h/{i}") for i in range(60)] + [(100, text(100_000), "http://h/big"), (101, None, None)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, html string, url string").coalesce(1), f"{tmp_path}/w", F.col("html"), F.col("page_id"), F.col("url"), bytes_per_file=32_000)
    sizes = sorted(p.stat().st_size for p in (tmp_path / "w").glob("part-*"))
    assert len(sizes) > 3 and all(x < 32_000 + 8 * 4_000 for x in sizes[:-1])  # a row goes beyond by one record at most
    assert sizes[-1] > 100_000  # one record is larger than a file, and whole
    got = {r.record_id: r.payload_bytes for r in warc.read_warc(spark, f"{tmp_path}/w").collect()}
    assert got == {f"<urn:page:{i}>": len((t or "").encode()) for i, t, _ in rows}


def test_gaps_are_logged(spark, tmp_path):
    rows = [(i, f"text {i} " * 50, f"http://h/{i}") for i in range(20)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, html string, url string").coalesce(1), f"{tmp_path}/w", F.col("html"), F.col("page_id"), F.col("url"))
    (path,) = (tmp_path / "w").glob("part-*")
    whole = path.read_bytes()
    at = whole.index(b"\x1f\x8b\x08", 1000) + 20  # within a record's member
    path.write_bytes(whole[:at] + bytes(40) + whole[at + 40 :])
    for crc in (tmp_path / "w").glob(".part-*.crc"):
        crc.unlink()
    records = warc.salvaged(spark, f"{tmp_path}/w", f"{tmp_path}/log", with_payload=False)
    gaps = spark.read.parquet(f"{tmp_path}/log").where("kind = 'gap'").collect()
    assert records.count() == 19 and records.columns == [x.split()[0] for x in warc.SCHEMA.split(", ")]
    assert gaps and all(g.length > 0 and g.reason and g.path for g in gaps)
