"""Archives and summaries larger than a task may hold: dealt out, read by ranges and in chunks, in little memory."""

import io
import json
import random
import resource
import zipfile

import pytest

from waymark.sources import archives, listings, ranged


class Slow(io.BytesIO):
    """Gives a few bytes at a time, so that every value is cut somewhere."""

    def __init__(self, data, step):
        super().__init__(data)
        self.step = step

    def read(self, n=-1):
        return super().read(self.step)


def whole(data, inner="k"):
    text = data.decode("utf-8-sig")
    found = json.loads(text)
    if found and isinstance(found[0], dict) and isinstance(found[0].get(inner), list):
        found = found[0][inner]
    return [r for r in found if isinstance(r, dict)]


@pytest.mark.parametrize("step", [1, 2, 7, 1000])
def test_rows_are_those_of_the_whole_file(step, monkeypatch):
    r = random.Random(step)
    value = lambda d=0: r.choice([None, True, r.randint(-99, 99), r.random(), 'a"b\\{[]}é\U0001f600', [1, {"x": "]"}] if d > 1 else [value(d + 1)], {} if d > 1 else {"k2": value(d + 1)}])
    for _ in range(10):
        rows = [r.choice([{"n": value(), "m": "é" * r.randint(0, 5)}, 12, "text", None]) for _ in range(r.randint(0, 12))]
        for doc in (rows, [{"k": rows}], [{"other": 1, "k": rows}]):
            data = json.dumps(doc, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])).encode("utf-8-sig" if r.random() < 0.3 else "utf-8")
            got = list(ranged.array_rows(Slow(data, step), "k"))
            assert got[-1] == (None, True) and [x for x, _ in got[:-1]] == whole(data)
            cut = data[: r.randrange(len(data))]
            part = list(ranged.array_rows(Slow(cut, step), "k"))
            assert [x for x, fine in part if x is not None] == whole(data)[: sum(x is not None for x, _ in part)]


def test_a_row_too_long_is_a_fault(monkeypatch):
    monkeypatch.setattr(ranged, "MOST_ROW", 1000)
    monkeypatch.setattr(ranged, "MOST_HEAD", 1000)
    data = json.dumps([{"a": 1}, {"b": "x" * 500_000}, {"c": 2}]).encode()
    assert list(ranged.array_rows(Slow(data, 100), "k")) == [({"a": 1}, True), (None, False)]


def test_large_summary_in_little_memory(tmp_path):
    path = tmp_path / "s.json"
    with open(path, "w") as f:
        f.write('[{"summarizedActivitiesExport":[')
        f.write(",".join(json.dumps({"beginTimestamp": 1_600_000_000_000 + k, "activityType": "cycling", "name": "n" * 400}) for k in range(150_000)))
        f.write("]}]")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    with ranged.opened(str(path)) as stream:
        n = sum(row is not None for row, _ in ranged.array_rows(stream, listings.INNER))
    assert n == 150_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 40_000  # of 70 MB


def test_one_archive_is_many_tasks(spark, tmp_path):
    r = random.Random(9)
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        for k in range(60):
            z.writestr(f"activities/{k}.gpx", r.randbytes(20_000))
        z.writestr("inner.zip", _zip({"a.gpx": b"inner"}))
        z.writestr("notes.txt", b"x")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    (tmp_path / "empty.zip").write_bytes(_zip({}))
    df = archives.read_archives(spark, str(tmp_path), task_bytes=100_000)
    rows = df.collect()
    with_content = [x for x in rows if x["kind"] == "activity"]
    assert len(with_content) == 61 and {len(x["content"]) for x in with_content} == {20_000, 5}
    assert [x["error"] for x in rows if x["member"] is None][0].startswith("not an archive") and {x["member"] for x in rows if x["kind"] == "other"} == {"notes.txt"}
    from pyspark.sql import functions as F

    assert df.filter("kind = 'activity'").select(F.spark_partition_id().alias("p")).distinct().count() > 3
    names = {(x["archive"].rsplit("/", 1)[-1], x["member"]) for x in archives.read_directories(spark, str(tmp_path)).collect()}
    assert ("big.zip", "inner.zip") in names and ("broken.zip", None) in names and len(names) == 63


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_an_archive_of_2_gb_by_ranges(tmp_path):
    """Sparse, stored members: only the directory is read to plan, and a task reads its own stretch alone."""
    path = tmp_path / "huge.zip"
    zeros = bytes(1 << 20)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for k in range(35):
            with z.open(zipfile.ZipInfo(f"{k}.gpx"), "w", force_zip64=True) as f:
                for _ in range(60):
                    f.write(zeros)
    assert path.stat().st_size > 2 << 30
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    chunks = list(archives._chunks(str(path), archives.TASK_BYTES))
    assert len(chunks) == 35 and all(c[4] is None for c in chunks)
    with ranged.opened(str(path)) as f:
        packed = zipfile.ZipFile(f)
        (row,) = archives._member(packed, packed.infolist()[chunks[20][1]], str(path), True)
    assert row[1] == "20.gpx" and len(row[3]) == 60 << 20
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
    path.unlink()
