"""Archives written anew keep all else that is in them; large ones are read by their members."""

import gzip
import io
import os
import tarfile
import zipfile

import pytest
from test_ingest import fb2, rar5, zipped

from folioscope.plans.queries import queries
from folioscope.sources import archives, inpx, ingest, members
from folioscope.sources.archive_write import PACKERS, pack, without

STAMP = (2003, 4, 5, 6, 7, 8)


def zip_of(*entries, comment=b"c"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = comment
        for name, data in entries:
            info = zipfile.ZipInfo(name, STAMP)
            info.external_attr = 0o640 << 16
            z.writestr(info, data, zipfile.ZIP_DEFLATED if len(data) % 2 else zipfile.ZIP_STORED)
    return out.getvalue()


def tar_of(kind, *entries):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size, info.mtime, info.mode = len(data), 1049522828, 0o640
            t.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "a.fb2"
        t.addfile(link)
    return PACKERS[kind](out.getvalue())


MANY = (("d/", b""), ("a.fb2", b"one"), ("empty.nfo", b""), ("b.txt", b"two"), ("b.txt", b"again"), ("a.fbd", b"side"), ("ü.txt", b"three!"))


@pytest.mark.parametrize("kind", [".zip", ".jar"])
def test_zip_without_a_book(kind):
    less = without(kind, zip_of(*MANY), ["a.fb2"])
    with zipfile.ZipFile(io.BytesIO(less)) as z:
        assert z.comment == b"c" and [(x.filename, z.read(x), x.date_time, x.external_attr >> 16, x.compress_type) for x in z.infolist()] == [(n, d, STAMP, 0o640, zipfile.ZIP_DEFLATED if len(d) % 2 else zipfile.ZIP_STORED) for n, d in MANY if n not in ("a.fb2", "a.fbd")]


@pytest.mark.parametrize("kind", sorted(PACKERS))
def test_tar_without_a_book(kind):
    own = [x for x in MANY if not x[0].endswith("/")]
    less = without(kind, tar_of(kind, *own), ["a.fb2"])
    assert [(x.path, x.content) for x in archives.entries(kind, less)] == [(n, d) for n, d in own if n not in ("a.fb2", "a.fbd") and d]
    from folioscope.sources.archive_write import UNPACKERS

    with tarfile.open(fileobj=io.BytesIO(UNPACKERS[kind](less))) as t:
        assert [(x.name, x.mtime if x.isfile() else x.linkname, x.mode if x.isfile() else 0) for x in t] == [(n, 1049522828, 0o640) for n, _ in own if n not in ("a.fb2", "a.fbd")] + [("link", "a.fb2", 0)]


@pytest.mark.parametrize("kind", [".cpio", ".iso", ".7z", ".rar"])
def test_other_kinds_are_left_alone(kind):
    with pytest.raises(NotImplementedError):
        without(kind, b"anything", ["a.fb2"])
    inner = zip_of(("x" + kind, b"anything"), ("b.txt", b"b"))
    if kind == ".rar":  # goes whole, as its books do
        assert [x.path for x in archives.entries(".zip", without(".zip", inner, ["x.rar", "a.fb2"]))] == ["b.txt"]
    else:
        with pytest.raises(NotImplementedError):
            without(".zip", inner, ["x" + kind, "a.fb2"])


def test_nested_archives_without_a_book():
    outer = zip_of(("in.tar.xz", tar_of(".tar.xz", ("a", b"1"), ("b", b"2"))), ("c", b"3"))
    less = without(".zip", outer, ["in.tar.xz", "a"])
    assert [(x.path, x.content) for x in archives.entries(".zip", less) if x.path == "c"] == [("c", b"3")]
    assert [(x.path, x.content) for x in archives.entries(".tar.xz", next(x.content for x in archives.entries(".zip", less) if x.path == "in.tar.xz"))] == [("b", b"2")]
    assert without(".zip", zip_of(("a", b"1")), ["a"]) is None and without(".zip", zip_of(("a", b"1"), ("empty", b"")), ["a"]) is not None
    with pytest.raises(FileNotFoundError):
        without(".zip", outer, ["in.tar.xz", "none"])
    with pytest.raises(RuntimeError):
        sealed = bytearray(zip_of(("a", b"1"), ("b", b"2")))
        at = sealed.rfind(b"PK\x01\x02")
        sealed[at + 8] |= 1
        without(".zip", bytes(sealed), ["a"])


def _all(spark, folder):
    return sorted((r["file_path"].rsplit("/", 1)[-1], tuple(r["path_in_file"] or ()), r["fbd_path"], tuple(r["titles"]), tuple(r["dates"])) for r in ingest.parse(ingest.crawl(spark, str(folder))).collect())


def test_large_archives_give_all_their_books(spark, tmp_path, monkeypatch):
    books = {f"d{k}/{k}.fb2": fb2(f"Title {k}") for k in range(9)} | {"in.zip": zipped({"x.fb2": fb2("Inner")}), "e.bin": b"b", "e.fbd": fb2("Described"), "lone.fbd": fb2("Lone"), "empty.txt": b"", "noise.dat": os.urandom(4000)}
    (tmp_path / "a.zip").write_bytes(zipped(books))
    (tmp_path / "b.tar.gz").write_bytes(pack(".tar.gz", books))
    (tmp_path / "c.tar").write_bytes(pack(".tar", books))
    (tmp_path / "e.zip").write_bytes(b"PK" + b"\0" * 5000)
    (tmp_path / "f.txt").write_text("x" * 5000)
    want = _all(spark, tmp_path)
    assert len(want) == 3 * 11 + 1
    want = sorted([*want, ("e.zip", (), None, ("e",), want[-1][-1])])
    monkeypatch.setattr(ingest, "MAX_FILE_BYTES", 3500)
    got = _all(spark, tmp_path)
    assert got == want
    paths = [str(tmp_path / "a.zip")]
    assert members.members(spark, paths, group=1000).rdd.getNumPartitions() > 4
    assert {r["entry"]: r["content"] is None for r in members.members(spark, paths, most=3000).collect()}["noise.dat"]
    files, found = ingest.create(spark, str(tmp_path))
    assert files.where("file_hash is null").count() == 5 and found.count() > 30


def test_inpx_has_a_task_for_each_list(spark, tmp_path):
    line = lambda k: inpx.FIELD.join(["Pen,Ann,:", "sf:", f"Title {k}", "", "", str(k), "", "", "", "fb2", "", ""])
    lists = {f"l{n}.inp": "\r\n".join(line(k) for k in range(n * 10, n * 10 + 10)) + "\r\nlost" for n in range(7)}
    (tmp_path / "x.inpx").write_bytes(zipped(lists | {"version.info": "1", "empty.inp": ""}))
    (tmp_path / "y.inpx").write_bytes(b"no zip")
    files = spark.createDataFrame([(f"/lib/l{n}.zip",) for n in range(7)], "file_path string")
    rows = inpx.lists_of(spark, [str(tmp_path / "x.inpx"), str(tmp_path / "y.inpx")])
    assert rows.rdd.getNumPartitions() == 8
    content = spark.read.format("binaryFile").load(str(tmp_path / "x.inpx"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, inpx.lines_in(content).collect())) and rows.count() == 70
    assert inpx.load(spark, str(tmp_path / "*.inpx"), files, "/lib").count() == 70


def test_gzip_is_the_same_each_time():
    assert without(".tar.gz", tar_of(".tar.gz", *MANY[1:]), ["a.fb2"]) == without(".tar.gz", gzip.compress(gzip.decompress(tar_of(".tar.gz", *MANY[1:]))), ["a.fb2"])
    assert rar5 and "inpx_load" in queries()
