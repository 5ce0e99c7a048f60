"""Files made of the test tables' texts, for queries whose operators read files."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import slices
from . import views

_RELS = '<Relationships>{}</Relationships>'


def _spelled(line: str) -> str:
    return escape(line, {"\r": "&#13;"})


def _docx(lines: list[str]) -> dict[str, str]:
    body = "".join(f"<w:p><w:r><w:t>{_spelled(x)}</w:t></w:r></w:p>" for x in lines)
    return {"word/document.xml": f'<w:document xmlns:w="u:w"><w:body>{body}<w:tbl><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tbl></w:body></w:document>'}


def _xlsx(lines: list[str]) -> dict[str, str]:
    """Two sheets, the first part second in the book's order; its rows are one shared string each, the other's inline."""
    half = len(lines) // 2
    inline = "".join(f'<row><c t="inlineStr"><is><t>{_spelled(x)}</t></is></c><c/></row>' for x in lines[:half])
    shared = "".join(f'<row><c t="s"><v>{i}</v></c></row>' for i in range(len(lines) - half))
    sheet = '<worksheet><sheetData>{}</sheetData></worksheet>'
    return {
        "xl/workbook.xml": '<workbook xmlns:r="u:r"><sheets><sheet r:id="b"/><sheet r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _RELS.format('<Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/>'),
        "xl/sharedStrings.xml": f'<sst>{"".join(f"<si><t>{_spelled(x)}</t></si>" for x in lines[half:])}</sst>',
        "xl/worksheets/sheet1.xml": sheet.format(shared), "xl/worksheets/sheet2.xml": sheet.format(inline),
    }


def _slide(lines: list[str]) -> str:
    body = "".join(f"<a:p><a:r><a:t>{_spelled(x)}</a:t></a:r></a:p>" for x in lines)
    return f'<p:sld xmlns:p="u:p" xmlns:a="u:a"><p:cSld><p:spTree><p:sp><p:txBody>{body}</p:txBody></p:sp></p:spTree></p:cSld></p:sld>'


def _pptx(lines: list[str]) -> dict[str, str]:
    """Two slides, the second part first in the presentation."""
    half = len(lines) // 2
    return {
        "ppt/presentation.xml": '<p:presentation xmlns:p="u:p" xmlns:r="u:r"><p:sldIdLst><p:sldId id="9" r:id="s2"/><p:sldId id="8" r:id="s1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": _RELS.format('<Relationship Id="s1" Target="slides/slide1.xml"/><Relationship Id="s2" Target="slides/slide2.xml"/>'),
        "ppt/slides/slide1.xml": _slide(lines[half:]), "ppt/slides/slide2.xml": _slide(lines[:half]),
    }


def _hwpx(lines: list[str]) -> dict[str, str]:
    half = len(lines) // 2
    section = lambda part: f'<hs:sec xmlns:hs="u:s">{"".join(f"<hs:t>{_spelled(x)}</hs:t>" for x in part)}</hs:sec>'
    return {"Contents/section1.xml": section(lines[half:]), "Contents/section0.xml": section(lines[:half]), "Contents/bad.xml": "<broken", "other.xml": "<t>no</t>"}


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def _encrypted(data: bytes) -> bytes:
    """The archive with every entry's encryption bit set."""
    out = bytearray(data)
    for mark, offset in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        at = out.find(mark)
        while at >= 0:
            out[at + offset] |= 1
            at = out.find(mark, at + 4)
    return bytes(out)


#: Fixed values of the test files: id modulo 8 -> extension.
OFFICE = (".docx", ".xlsx", ".pptx", ".hwpx", ".docx", ".xlsx", ".pptx", ".pptx")


def office_bytes(key: int, text: str) -> bytes:
    """A text's lines as an office document; 4: cut short, 5: encrypted, 6: without text, 7: slides without a presentation."""
    lines, kind = text.split("\n"), key % 8
    parts = (_docx, _xlsx, _pptx, _hwpx, _docx, _xlsx, _pptx, _pptx)[kind](["", " "] if kind == 6 else lines)
    data = _zip({k: v for k, v in parts.items() if kind != 7 or k.startswith("ppt/slides")})
    return data[: len(data) // 2] if kind == 4 else _encrypted(data) if kind == 5 else data


def office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ext and content (binary) of every document as an office file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, 1)):
            made = (office_bytes(k.as_py(), t.as_py() or "") for k, t in zip(part.column(0), part.column(1), strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary(), size=part.num_rows)], names=["doc_id", "content"])

    rows = views.table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, content binary")
    return rows.select("doc_id", F.element_at(F.array(*map(F.lit, OFFICE)), (F.col("doc_id") % 8 + 1).cast("int")).alias("ext"), "content")


def write_folder(spark: SparkSession, sf_dir: str, root: str) -> None:
    """The view ``files`` as files below root, each with its text and its time.  root is a local path that all executors see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, modified, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as out:
                    out.write((text or "").encode())
                os.utime(path, (modified, modified))
            yield batch.select(["path"])

    files = views.files(spark, sf_dir).join(views.contents(spark, sf_dir), F.col("id") == F.col("file_id"))
    rows = files.select(in_folder(root, F.col("path")).alias("path"), "modified", "content")
    rows.mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def in_folder(root: str, path: Column) -> Column:
    """A catalog path moved below root."""
    return F.concat(F.lit(root), F.substring(path, 3, 1 << 20))
