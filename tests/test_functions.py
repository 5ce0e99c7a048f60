"""Path, text and presentation expressions on hand-made edge cases."""

import hashlib
import html
import os
import re
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from loupe.functions import paths, present, text
from loupe.plans.queries import QUERIES


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


NAMES = ["a.py", ".bashrc", "a.tar.gz", "..a.b", "a.", "A.PY", "~$lock.docx", "$MFT", "", "plain", "...", "x.y."]


def test_extension_is_splitext(spark):
    assert column(spark, NAMES, paths.extension) == [os.path.splitext(n)[1].lower() for n in NAMES]


def test_path_parts(spark):
    given = ["C:/a/b.txt", "b", "C:/a/", "/x"]
    assert column(spark, given, paths.basename) == ["b.txt", "b", "", "x"]
    assert column(spark, given, paths.dirname) == ["C:/a", "", "C:/a", ""]
    assert column(spark, ["c:\\a\\b"], lambda p: paths.basename(p, "\\")) == ["b"]
    assert column(spark, given, paths.drive) == ["C", "?", "C", "?"]
    assert column(spark, ["\\\\?\\C:\\a"], paths.without_long_prefix) == ["C:\\a"]
    assert column(spark, ["C:\\a\\..//b/./c", "a", "/x/../../y", "C:/"], paths.normalized) == ["C:/b/c", "a", "/y", "C:"]


def test_under(spark):
    given = ["C:/En/x", "c:/en", "c:/ent/x", "C:/EN/"]
    assert column(spark, given, lambda p: paths.under(p, "c:/eN")) == [True, False, False, True]
    assert column(spark, given, lambda p: paths.under(p, "c:/eN/", or_equal=True)) == [True, True, False, True]
    assert column(spark, given, lambda p: paths.in_folders(p, [])) == [True] * 4


def test_excluded(spark):
    given = ["C:/a/~$x.docx", "C:/Windows", "C:/windows/system", "C:/windowsx/a", "C:/a/node_modules/b", "C:/a/Node_Modules/b", "C:/.git/x", "C:/$Recycle.Bin/x", "C:/a/.hidden", "C:/ok/x.txt"]
    out = column(spark, given, lambda p: paths.excluded(p, ["C:/Windows"], ["node_modules"]))
    assert out == [True, True, True, False, True, False, True, True, True, False]
    given = ["C:/Windows/x.txt", "C:\\Windows\\x.txt", "c:/WINDOWS", "C:\\Program Files (x86)\\a\\b", "C:/x/../Windows/y", "C://Windows//z", "C:\\Users\\me\\AppData\\q", "C:/Windowsx/a", "D:/Windows/a", "C:/x/Windows"]
    out = column(spark, given, lambda p: paths.excluded(p, paths.default_excluded_paths("C:\\Users\\me")))
    assert out == [True] * 7 + [False] * 3


def test_join_folders(spark):
    rows = spark.createDataFrame([("C:/a/b/c",), ("c:/A",), ("D:/x",)], "path string")
    tops = spark.createDataFrame([("c:/a",), ("C:/a/b/",)], "top string")
    pairs = {(r["path"], r["top"]) for r in paths.join_folders(rows, "path", tops, "top").collect()}
    assert pairs == {("C:/a/b/c", "c:/a"), ("C:/a/b/c", "C:/a/b/"), ("c:/A", "c:/a")}
    assert paths.join_folders(rows, "path", tops, "top", how="left_anti").select("path").collect()[0][0] == "D:/x"


def test_tokens(spark):
    given = ["Été naïve_x a.b-c's x² ½", "straße œuvre ﬁn", "한글 日本語", None, "e\u0301a", " -- "]
    got = column(spark, given, text.tokens)
    assert got == [["ete", "naive", "x", "a", "b", "c", "s", "x²", "½"], ["straße", "œuvre", "ﬁn"], ["한글", "日本語"], [], ["ea"], []]
    assert [text.fold_constant(g or "") for g in given] == got
    assert column(spark, given[:1] + given[5:], text.token_text) == [" ete naive x a b c s x² ½ ", " "]
    assert column(spark, given, lambda x: text.n_tokens(text.token_text(x))) == [len(t) for t in got]
    for c in map(chr, range(0xC0, 0x250)):
        base = unicodedata.normalize("NFD", c.lower())[0]
        assert text.fold_constant(c) in ([base], [c.lower()], [c.casefold()], [])


def test_format_size(spark):
    sizes = [0, 1023, 1024, 1536, 208128, 1048575, 1048576, 5 * 1024**3, 1024**4]

    def plain(n):
        for unit, limit in (("KB", 2), ("MB", 3)):
            if n < 1024**limit:
                return f"{n} B" if n < 1024 else f"{n / 1024 ** (limit - 1):.1f} {unit}"
        return f"{n / 1024**3:.1f} GB"

    assert column(spark, sizes, present.format_size, "long") == [plain(n) for n in sizes]


def test_time_label_percent(spark):
    assert column(spark, [None, 0.0, 1700000000.0], present.format_time, "double") == ["", "", "2023-11-14 22:13"]
    assert column(spark, ["filename", "both", "content", "odd"], present.match_label) == ["file name", "file name and content", "content", "odd"]
    assert column(spark, [0, 116444736000000000, 116444736010000000], present.filetime_to_unix, "long") == [0.0, 0.0, 1.0]
    assert column(spark, [0, 1, 3], lambda x: present.percent(x, F.lit(3)), "int") == [0, 33, 100]


@pytest.mark.parametrize(("query", "terms"), [('"import pandas"', ["import pandas"]), ("NEAR(def return, 10)", ["def", "return"]), ("A AND B", ["A", "B"]), ("^rep* (x)", ["rep", "x"]), ("", []), ('a* "b  c" near(d* e, 3) or (not "f") g', ["b  c", "f", "d", "e", "a", "g"]), ('x "y', ["x", '"y'])])
def test_highlight_terms(query, terms):
    assert present.highlight_terms(query) == terms


def test_highlight(spark):
    given = ["import <b> & b\nImport", "none", "aaaa"]
    assert column(spark, given[:2], lambda x: present.highlight(x, ["import", "b"])) == ["<b>import</b> &lt;<b>b</b>&gt; &amp; <b>b</b><br><b>Import</b>", "none"]
    assert column(spark, given[2:], lambda x: present.highlight(x, ["a"], limit=2)) == ["<b>a</b><b>a</b>aa"]
    assert column(spark, ["<'\">&"], present.html_escape) == [html.escape("<'\">&")]
    assert column(spark, ["AxaXa", "", "b"], lambda x: present.find_count(x, "a")) == [3, 0, 0]


def test_previews_at_the_production_limits(spark, tmp_path):
    texts = ["<p>a</p>\n" * 400 + "the <DIV>", "The end & 'x'\n" * 3000, "<div>" * 499 + "the", "the" * 501, "y" * 102_390 + "<div>" + "the" * 20, None]
    schema = "page_id long, html string"
    spark.createDataFrame(list(enumerate(texts)), schema).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def marked(x):
        return re.sub("(?i)(the|div)", r"<b>\1</b>", html.escape(x[:102_400]), count=500).replace("\n", "<br>")

    got = dict(QUERIES["highlight_page"](spark, str(tmp_path)).collect())
    assert got == {i: None if x is None else marked(x) for i, x in enumerate(texts)}
    got = {r["doc_id"]: (r["shown"], r["was_cut"]) for r in QUERIES["preview_document"](spark, str(tmp_path)).collect()}
    assert got == {i: (None, None) if x is None else (hashlib.md5(x[:102_400].encode()).hexdigest(), len(x) > 102_400) for i, x in enumerate(texts)}


def test_folds_every_letter_like_fts5(spark):
    """All letters, digits, private characters and marks, alone and inside a word."""
    points = [p for p in range(0x80, 0x110000) if not 0xD800 <= p < 0xE000 and (unicodedata.category(chr(p))[0] in "LN" or p in range(0x300, 0x370) or p in (0xE000, 0x10FFFD))]
    points = [p for p in points if not (0x19B0 <= p <= 0x19C9 or 0x1CF2 <= p <= 0x1CF3)]  # signs that later became letters
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(c)")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    texts = [(p, f"{chr(p)} a{chr(p)}b") for p in points]
    db.executemany("INSERT INTO t(rowid, c) VALUES (?, ?)", texts)
    want = {p: [] for p in points}
    for p, term in db.execute("SELECT doc, term FROM v ORDER BY doc, offset"):
        want[p].append(term)
    assert {p: text.fold_constant(t) for p, t in texts} == want
    known = [(p, t) for p, t in texts if (want[p][0] != t.split()[0] or p < 0x2000) and spark._jvm.java.lang.Character.isDefined(p)]  # the JVM knows fewer letters than Python
    got = {r["p"]: r["toks"] for r in spark.createDataFrame(known, "p int, t string").select("p", text.tokens(F.col("t")).alias("toks")).collect()}
    odd = {p for p in got if got[p] != want[p]}
    assert not odd, [(hex(p), got[p], want[p]) for p in sorted(odd)[:20]]
