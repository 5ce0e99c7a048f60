"""Text extraction and binary records on bytes built here."""

import io
import os
import struct
import zipfile

import pyarrow as pa
import pytest

from loupe.functions import paths
from loupe.operators import catalog, settings
from loupe.operators.progress import Progress
from loupe.operators.tree import resolve_paths
from loupe.plans import samples
from loupe.sources import files, folders, records, volume


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def test_plain():
    for text, encoding in (("안녕 hello", "utf-8"), ("안녕 hello", "cp949")):
        assert files.decode_plain(text.encode(encoding)) == text
    assert files.decode_plain(bytes(range(128, 256))) == bytes(range(128, 256)).decode("latin-1")


def test_archives():
    w = 'xmlns:w="u:w"'
    doc = f"<w:document {w}><w:body><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/><w:tbl><w:p><w:t>cell</w:t></w:p></w:tbl><w:p><w:t>three</w:t></w:p></w:body></w:document>"
    assert files.extract_text(archive({"word/document.xml": doc}), ".DOCX") == "one two\nthree"
    sheet = '<worksheet><sheetData><row><c t="s"><v>1</v></c><c><v>2.5</v></c></row><row><c/></row><row><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    book = archive({"xl/sharedStrings.xml": "<sst><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>", "xl/worksheets/sheet1.xml": sheet})
    assert files.extract_text(book, ".xlsx") == "bc 2.5\nin"
    slides = archive({f"ppt/slides/slide{k}.xml": f"<a:t> s{k} &amp;</a:t><a:t></a:t>" for k in (1, 2, 10)})
    assert files.extract_text(slides, ".pptx") == "s1 &amp;\ns10 &amp;\ns2 &amp;"
    hwpx = archive({"Contents/b.xml": "<x xmlns:h='u'><h:t> two </h:t></x>", "Contents/a.xml": "<x><t>one</t></x>", "Contents/c.xml": "<broken", "other.xml": "<t>no</t>"})
    assert files.extract_text(hwpx, ".hwpx") == "one\ntwo"
    assert files.extract_text(b"not a zip", ".docx") is None and files.extract_text(None, ".txt") is None


def test_formats_without_a_reader():
    assert files.extract_text(b"%PDF-1.7 bytes", ".PDF") is None and files.extract_text(b"\xd0\xcf\x11\xe0", ".hwp") is None
    assert files.extract_text(b"plain", ".odd") == "plain"


def test_file_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("hello", encoding="utf-8")
    (tmp_path / "b.docx").write_bytes(b"bad")
    listed = {r["name"]: r for r in files.list_files(spark, str(tmp_path)).collect()}
    assert (listed["a.txt"]["size"], listed["a.txt"]["extension"]) == (5, ".txt") and listed["a.txt"]["modified"] > 1e9
    texts = {r["name"]: r["text"] for r in files.extract(files.read_files(spark, str(tmp_path))).collect()}
    assert texts == {"a.txt": "hello", "b.docx": None}


def journal_record(ref=5, parent=3, name="n.txt", reason=0x100, ticks=116444736010000000, usn=77):
    raw = name.encode("utf-16-le")
    return struct.pack("<IHHQQQQIIIIHH", 60 + len(raw), 2, 0, ref | 7 << 48, parent | 1 << 48, usn, ticks, reason, 0, 0, 32, len(raw), 60) + raw


def test_journal(spark):
    good = [journal_record(), journal_record(ref=6, name="한글.txt", ticks=0)]
    bad = [b"short", journal_record()[:62], journal_record(name="")]
    rows = spark.createDataFrame([(bytearray(b),) for b in good + bad], "record binary")
    got = sorted(tuple(r) for r in records.journal_records(rows).select("file_ref", "parent_ref", "name", "reason", "usn", "modified", "attributes").collect())
    assert got == [(5, 3, "n.txt", 256, 77, 1.0, 32), (6, 3, "한글.txt", 256, 77, 0.0, 32)]
    buffer = struct.pack("<Q", 99) + good[0] + good[1] + struct.pack("<I", 0) + b"rest"
    assert records.split_buffer(buffer) == (99, good) and records.split_buffer(buffer[:30]) == (99, [])
    whole = records.journal_buffers(spark.createDataFrame([(bytearray(buffer),), (None,)], "buffer binary"))
    assert [(r["next_usn"], bytes(r["record"])) for r in whole.collect()] == [(99, good[0]), (99, good[1])]


def test_data_runs():
    assert records.data_runs(bytes.fromhex("3105A00000" + "00")) == [(160, 5)]
    assert records.data_runs(bytes([0x11, 4, 100, 0x01, 9, 0x11, 2, 256 - 50, 0])) == [(100, 4), (50, 2)]
    assert records.data_runs(bytes([0x11, 4])) == [] and records.data_runs(b"") == []


def attribute(kind, body, resident=True, named=False):
    if resident:
        size = 24 + len(body) + -len(body) % 8
        head = struct.pack("<IIBBHHHIHH", kind, size, 0, int(named), 24, 0, 0, len(body), 24, 0)
        return head + body.ljust(size - 24, b"\0")
    return struct.pack("<IIBB", kind, 64, 1, int(named)).ljust(48, b"\0") + struct.pack("<Q", body) + b"\0" * 8


def name_attribute(name, namespace, parent):
    return attribute(0x30, struct.pack("<Q", parent | 9 << 48).ljust(64, b"\0") + bytes([len(name), namespace]) + name.encode("utf-16-le"))


def file_record(*attributes, flags=1, base=0, damaged=False):
    body = b"".join(attributes) + struct.pack("<I", 0xFFFFFFFF)
    head = b"FILE" + struct.pack("<HHQHHHHIIQ", 48, 3, 0, 1, 1, 56, flags, 0, 0, base)
    data = bytearray((head.ljust(48, b"\0") + b"\xaa\xbb" + b"\0" * 6 + body).ljust(1024, b"\0"))
    for k, end in enumerate((512, 1024), 1):
        data[48 + 2 * k : 50 + 2 * k] = data[end - 2 : end]
        data[end - 2 : end] = b"\xaa\xbc" if damaged else b"\xaa\xbb"
    return bytes(data)


def test_file_records(spark, tmp_path):
    big = 1 << 33
    times = attribute(0x10, struct.pack("<QQQQ", 0, 116444736020000000, 0, 0))
    good = file_record(times, name_attribute("LONGNA~1", 2, 5), name_attribute("long name.txt", 1, (1 << 33) + 5), name_attribute("other", 1, 7), attribute(0x80, big, resident=False))
    folder = file_record(name_attribute("dir", 3, 5), attribute(0x80, b"x" * 9, named=True), flags=3)
    small = file_record(name_attribute("s", 0, 5), attribute(0x80, b"x" * 9))
    assert records.file_record(good) == ((1 << 33) + 5, "long name.txt", False, big, 2.0)
    assert records.file_record(folder) == (5, "dir", True, 0, 0.0) and records.file_record(small) == (5, "s", False, 9, 0.0)
    for odd in (file_record(times, flags=1), file_record(name_attribute("d", 1, 5), flags=0), file_record(name_attribute("d", 1, 5), base=3), file_record(name_attribute("d", 1, 5), damaged=True), b"", b"FILE"):
        assert records.file_record(odd) is None
    (tmp_path / "table").write_bytes(good + folder + b"\0" * 1024 + small)
    ranges = records.table_image(spark, str(tmp_path / "table"), range_bytes=2048)
    assert ranges.collect() == records.table_image(spark, f"file://{tmp_path}/table").collect() and ranges.count() == 4
    got = records.file_records(records.table_image(spark, str(tmp_path / "table"))).collect()
    assert sorted((r["file_ref"], r["name"], r["parent_ref"], r["size"]) for r in got) == [(0, "long name.txt", (1 << 33) + 5, big), (1, "dir", 5, 0), (3, "s", 5, 9)]


def run_attribute(runs):
    body = bytes(runs)
    size = 64 + len(body) + -len(body) % 8
    return (struct.pack("<IIBB", 0x80, size, 1, 0).ljust(32, b"\0") + struct.pack("<H", 64)).ljust(64, b"\0") + body.ljust(size - 64, b"\0")


def test_volume_image(spark, tmp_path):
    cluster = 2048
    boot = bytearray(512)
    struct.pack_into("<HB", boot, 0x0B, 512, 4)
    struct.pack_into("<Q", boot, 0x30, 4)
    struct.pack_into("<b", boot, 0x40, -10)
    zero = file_record(name_attribute("$MFT", 1, 0), run_attribute([0x11, 2, 4, 0x11, 1, 6, 0]))  # clusters 4, 5 and 10
    table = [zero, file_record(name_attribute("a", 1, 5), flags=3), file_record(name_attribute("b.txt", 1, 1)), b"\0" * 1024, file_record(name_attribute("c.txt", 1, 99)), b"\0" * 1024]
    image = bytearray(cluster * 12)
    image[:512] = boot
    image[4 * cluster : 6 * cluster] = b"".join(table[:4])
    image[10 * cluster : 11 * cluster] = b"".join(table[4:])
    path = tmp_path / "c.img"
    path.write_bytes(image)
    found = volume.enumerate_volume(spark, str(path), "c")
    assert sorted((r["file_ref"], r["name"], r["is_dir"]) for r in found.collect()) == [(0, "$MFT", False), (1, "a", True), (2, "b.txt", False), (4, "c.txt", False)]
    assert {r["file_ref"]: r["path"] for r in resolve_paths(found, "C:/").collect()} == {1: "C:/a", 2: "C:/a/b.txt", 4: "C:/c.txt"}
    spark.dataSource.register(volume.VolumeImage)
    ranges = spark.read.format("volume_image").option("path", str(path)).option("rangeBytes", 2048).load()
    assert ranges.rdd.getNumPartitions() == 3 and ranges.count() == 6


def test_journal_listing_and_stream(spark, tmp_path):
    data = struct.pack("<Q", 99) + journal_record(usn=1, name="old") + journal_record(usn=2, name="new") + journal_record(ref=6, usn=3)
    listed = volume.journal_listing(spark.createDataFrame([(bytearray(data),)], "buffer binary"), "c").collect()
    assert sorted((r["drive"], r["file_ref"], r["name"], r["size"]) for r in listed) == [("C", 5, "new", 0), ("C", 6, "n.txt", 0)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b1").write_bytes(data)
    query = volume.journal_stream(spark, str(tmp_path / "in"), "c", 1, start_usn=2).writeStream.format("memory").queryName("journal_now").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["usn"], r["file_ref"]) for r in spark.table("journal_now").collect()) == [(2, 5), (3, 6)]
    kinds = spark.createDataFrame([("C", "Fixed", "ntfs"), ("D", "cdrom", "NTFS"), ("E", "removable", "FAT32"), ("F", "fixed", None)], "drive string, kind string, file_system string")
    assert [r["drive"] for r in volume.supported_volumes(kinds).collect()] == ["C"]


def test_settings(spark, tmp_path):
    path = str(tmp_path / "settings")
    assert "node_modules" in settings.load(spark, path)["excluded_dirs"]
    settings.save(spark, path, excluded_dirs=["z", "a"])
    assert settings.load(spark, path)["excluded_dirs"] == ["a", "z"] and "C:\\Windows" in settings.load(spark, path)["excluded_paths"]
    assert settings.add_path(["C:/A"], "c:\\a/") == ["C:/A"] and settings.add_path(["C:/A"], "C:/b") == ["C:/A", "C:/b"]
    one = settings.distinct_paths(spark.createDataFrame([("C:/A",), ("c:\\a",), ("D:/x/../y",)], "path string"))
    assert one.count() == 2
    offsets = spark.createDataFrame([("C", 1, 5)], "drive string, journal_id long, next_usn long")
    assert settings.offset_of(offsets, "c") == (1, 5) and settings.offset_of(offsets, "d") is None


def test_any_failure_or_no_text_is_null(spark):
    good = samples.office_bytes(0, "one\n two")
    assert files.extract_text(good, ".docx") == "one\n two"
    assert files.extract_text(samples.office_bytes(1, "a\nb\nc"), ".xlsx") == "a\nb\nc" and files.extract_text(samples.office_bytes(2, " a\nb & c"), ".pptx") == "a\nb & c"
    odd = bytearray(good)
    for mark, offset in ((b"PK\x03\x04", 8), (b"PK\x01\x02", 10)):
        at = odd.find(mark)
        odd[at + offset : at + offset + 2] = b"\x63\x00"  # a compression that no reader knows
    cases = [(bytes(odd), ".docx"), (samples.office_bytes(5, "x\ny"), ".xlsx"), (samples.office_bytes(4, "x"), ".docx")]
    cases += [(archive({"word/document.xml": "<d><body><p/></body></d>"}), ".docx"), (archive({"xl/worksheets/sheet1.xml": "<w/>"}), ".xlsx"), (archive({"a": ""}), ".pptx"), (archive({"Contents/a.xml": "<x><t> </t></x>"}), ".hwpx"), (b"", ".docx")]
    rows = spark.createDataFrame([(i, bytearray(d), e) for i, (d, e) in enumerate(cases)], "i int, content binary, extension string")
    assert [r["text"] for r in files.extract(rows).orderBy("i").collect()] == [None] * len(cases)
    assert files.extract_text(b"", ".txt") == ""


def test_unpacking_is_bounded(monkeypatch):
    monkeypatch.setattr(files, "MAX_CONTENT_BYTES", 20_000)
    assert files.extract_text(samples.office_bytes(0, "x" * 10_000), ".docx").startswith("xxx")
    packed = samples.office_bytes(0, "x" * 100_000)
    assert len(packed) < 2000 and files.extract_text(packed, ".docx") is None


def test_cells_lines_and_a_bad_slide():
    sheet = '<w><row><c t="b"><v>1</v></c><c><v>3</v></c><c><v>1E2</v></c><c t="str"><v> s</v></c><c t="e"><v>#N/A</v></c><f/></row></w>'
    assert files.extract_text(archive({"xl/worksheets/sheet1.xml": sheet}), ".xlsx") == "True 3 100.0  s #N/A"
    doc = '<w:d xmlns:w="u"><w:body><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:r><w:hyperlink><w:r><w:t>c</w:t></w:r></w:hyperlink><w:del><w:r><w:t>no</w:t></w:r></w:del></w:p></w:body></w:d>'
    assert files.extract_text(archive({"word/document.xml": doc}), ".docx") == "a\tb\nc"
    slides = archive({"ppt/slides/slide1.xml": "<a:t>one</a:t>", "ppt/slides/slide2.xml": b"\xff<a:t x='1'>two &#65;&lt;</a:t><a:t/>", "ppt/slides/slide3.xml": "<a:t>three</a:t>"})
    at = slides.find(b"three")
    slides = slides[:at] + b"THREE" + slides[at + 5 :]  # its checksum is wrong now
    assert files.extract_text(slides, ".pptx") == "one\n�two &#65;&lt;".replace("�", "")


def test_walk_prunes_and_reads_only_what_is_asked_for(spark, tmp_path):
    top = tmp_path / "top"
    for path, data in {"a.txt": "one", "d/b.md": "two", "d/node_modules/deep/er/c.txt": "no", "d/e/f/g.docx": "broken", "h/.git/x.txt": "no", "h/i.exe": "bytes", "h/j.txt": ""}.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(data)
    os.symlink(top, top / "h" / "loop")
    os.symlink(top / "a.txt", top / "h" / "link.txt")
    os.mkfifo(top / "d" / "node_modules" / "pipe.txt")  # opening it would wait for ever
    gone = lambda p: paths.excluded(p, (), ["node_modules"])
    listed = folders.walk(spark, f"file://{top}", gone)
    at = {r["path"].removeprefix(f"{top}/"): r for r in listed.collect()}
    assert sorted(at) == ["a.txt", "d/b.md", "d/e/f/g.docx", "h/i.exe", "h/j.txt", "h/link.txt"]
    assert (at["d/b.md"]["name"], at["d/b.md"]["extension"], at["d/b.md"]["size"]) == ("b.md", ".md", 3) and at["a.txt"]["modified"] == pytest.approx(os.stat(top / "a.txt").st_mtime, abs=1e-5)
    progress = Progress()
    files_ = spark.createDataFrame([(1, f"{top}/a.txt", "a.txt", ".txt", 3, at["a.txt"]["modified"], True, None)], "id long, path string, name string, extension string, size long, modified double, has_content boolean, file_ref long")
    opened = []

    def texts_of(stale):
        opened.extend(r["path"].removeprefix(f"{top}/") for r in stale.collect())
        return folders.read_texts(stale)

    f, c = catalog.reindex_changed(files_, spark.createDataFrame([(1, "one")], "file_id long, content string"), listed, texts_of, gone, progress=progress)
    found = {r["path"].removeprefix(f"{top}/"): (r["has_content"], r["content"]) for r in f.join(c, f["id"] == c["file_id"], "left").collect()}
    assert found == {"a.txt": (True, "one"), "d/b.md": (True, "two"), "d/e/f/g.docx": (False, None), "h/link.txt": (True, "one")}
    assert sorted(opened) == ["d/b.md", "d/e/f/g.docx", "h/link.txt"]  # known, excluded, unreadable and empty files stay closed
    assert progress.counts() == {"listed": 6, "read": 3, "failed": 1, "skipped": 3}
    assert folders.walk(spark, str(tmp_path / "none")).count() == 0 and folders.walk(spark, str(top / "d" / "node_modules"), gone).count() == 0


def test_few_bytes_are_values_at_once(spark, monkeypatch):
    """A batch of many files is taken in pieces; a larger file is alone."""
    monkeypatch.setattr(files, "SLICE_BYTES", 100)
    data = [b"x" * n for n in (0, 40, 60, 1, 500, 99, 1)] + [None, b"y"]
    batch = pa.record_batch([pa.array(range(len(data))), pa.array(data, pa.binary())], names=["i", "data"])
    parts = [p.column(1).to_pylist() for p in files.slices(batch, 1)]
    assert [x for p in parts for x in p] == data and [len(p) for p in parts] == [3, 1, 1, 3, 1]
    assert not list(files.slices(batch.slice(0, 0), 1))
    assert [x for p in files.slices(batch.slice(2, 5), 1) for x in p.column(1).to_pylist()] == data[2:7]
