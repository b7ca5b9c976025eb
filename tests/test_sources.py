import io
import json
import struct
import zipfile
from datetime import datetime as D

from pyspark.sql import functions as F

from librarium.plans import segment
from librarium.sources import epub, html, mobi, scan
from librarium.streaming import poll

PAGE = """<html><head><title>T</title><meta property="og:title" content=""><meta name="keywords" content="a, b;c"><meta property="article:tag" content=" b "><meta name="author" content="">
<meta property="article:author" content="A"></head><body><nav><ul><li>x</ul></nav><article><p>before</p><h1>One</h1><p>a <b>b <i>c</i></b><br>d</p><p>unclosed
<section><img src="i.png" alt="x" width="3" height="y"></section><pre><code class="hl language-py">x = 1</code></pre><blockquote>q</blockquote><ul><li>l1<li><li>l2</ul><hr><table><tr><td>no</td></tr></table>
<h2></h2><div><p>deep</p></div><p>link <a href="u">v</a></p></article></body></html>"""


def test_html_chapters(spark):
    df = spark.createDataFrame([(1, PAGE, 0), (2, "<p>only", 0), (3, None, 0), (4, "", 0)], "k INT, text STRING, title INT")
    got = {(r.k, r["index"]): r for r in html.html_chapters(df, "k").collect()}
    assert {k: (r.title, r.level) for k, r in got.items()} == {(1, 0): ("One", 0), (1, 1): ("第 2 章", 1), (2, 0): ("正文", 0), (4, 0): ("正文", 0)}
    one = got[1, 0].content
    assert [e.type for e in one] == ["Heading", "Paragraph", "Paragraph", "Image", "Code", "Quote", "ListBlock", "Divider"]
    assert [(s.text, s.styles) for s in one[1].spans] == [("a ", []), ("b ", ["BOLD"]), ("c", ["BOLD", "ITALIC"]), ("\n", []), ("d", [])]
    assert (one[3].src, one[3].width, one[3].height) == ("i.png", 3, None) and (one[4].text, one[4].language) == ("x = 1", "py") and len(one[6]["items"]) == 2
    two = got[1, 1].content
    assert [e.type for e in two] == ["Paragraph", "Paragraph"] and two[1].spans[1].link == "u" and two[1].spans[1].styles == ["UNDERLINE"]
    stats = html.html_chapters(df, "k").filter("k = 1 AND index = 0").select(segment.element_words(F.col("content")).alias("w"), segment.element_images(F.col("content")).alias("i")).first()
    assert (stats.w, stats.i) == (1 + 4 + 1 + 2 + 1 + 2, 1)


def test_html_metadata(spark):
    df = spark.createDataFrame([(1, PAGE, "f"), (2, "<p>x", "f")], "k INT, text STRING, name STRING")
    got = {r.k: r for r in html.html_metadata(df, "k", "text", "name").collect()}
    assert (got[1].title, got[1].author, got[1].tags) == ("T", "A", ["a", "b", "c"]) and got[2].title == "f" and got[2].tags == []


def book():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        z.writestr("OEBPS/c.opf", """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title><dc:creator> </dc:creator><dc:creator>A</dc:creator>
<dc:subject>s1</dc:subject><dc:subject>s2</dc:subject><dc:subject>s1</dc:subject><meta name="cover" content="cv"/></metadata><manifest><item id="ncx" href="toc.ncx"/><item id="a" href="t/a.xhtml"/><item id="b" href="t/b.xhtml"/>
<item id="d" href="t/d.xhtml"/><item id="cv" href="img/c.png" media-type="image/png"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="d"/><itemref idref="b"/><itemref idref="nope"/></spine></package>""")
        z.writestr("OEBPS/toc.ncx", """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>A</text></navLabel><content src="t/a.xhtml#x"/><navPoint><navLabel><text>B</text></navLabel>
<content src="t/b.xhtml"/></navPoint><navPoint><navLabel><text>B2</text></navLabel><content src="t/b.xhtml#2"/></navPoint></navPoint></navMap></ncx>""")
        z.writestr("OEBPS/t/a.xhtml", """<html xmlns:epub="x"><body><h1>A</h1><p>see <a epub:type="noteref" href="#n1"><img src="../img/note.png"/></a> and <sup>2</sup><img src="../img/c.png"/></p><div>line one<br/>line two</div>
<aside epub:type="footnote"><ol><li id="n1">the note</li></ol></aside><p id="fn7">def</p></body></html>""")
        z.writestr("OEBPS/t/b.xhtml", "<html><body><p>b</p></body></html>")
        z.writestr("OEBPS/t/d.xhtml", "<html><body><p>d</p></body></html>")
        z.writestr("OEBPS/img/c.png", b"\x89PNG")
    return bytearray(out.getvalue())


def test_epub(spark):
    df = spark.createDataFrame([(1, book()), (2, bytearray(b"no zip")), (3, None)], "k INT, content BINARY")
    docs = epub.epub_documents(df, "k").orderBy("index").collect()
    assert [(d["index"], d.href, d.in_toc, d.title, d.level) for d in docs] == [(0, "t/a.xhtml", True, "A", 0), (1, "t/b.xhtml", False, None, 0), (2, "t/d.xhtml", False, None, 0), (3, "t/b.xhtml", True, "B", 1)]
    first = docs[0].content
    assert [e.type for e in first] == ["Heading", "Image", "Paragraph", "Paragraph", "Paragraph", "Footnote", "Footnote"]
    note = first[2].spans[1]
    assert (note.text, note.styles, note.footnoteId, note.footnoteImage) == ("[1]", ["BOLD"], "n1", "img/note.png") and first[1].src == "img/c.png"
    assert [first[i].spans[0].text for i in (3, 4)] == ["line one", "line two"] and [first[i].id for i in (5, 6)] == ["n1", "fn7"]
    m = epub.epub_metadata(df, "k").collect()
    assert [(r.title, r.author, r.publisher, r.tags, r.cover) for r in m] == [("T", "A", None, ["s1", "s2"], "OEBPS/img/c.png")]
    assert [(r.path, bytes(r.content)) for r in epub.epub_resources(df, "k").collect()] == [("img/c.png", b"\x89PNG")]


def palm(records, exth=()):
    head = bytearray(232)
    body = b"".join(struct.pack(">II", k, 8 + len(v)) + v for k, v in exth)
    block = b"EXTH" + struct.pack(">II", 12 + len(body), len(exth)) + body
    struct.pack_into(">I", head, 20, 216)
    struct.pack_into(">I", head, 128, 0x40 if exth else 0)
    recs = [bytes(head) + block, *records]
    at = 78 + 8 * len(recs)
    table = b""
    for r in recs:
        table += struct.pack(">II", at, 0)
        at += len(r)
    return bytearray(bytes(76) + struct.pack(">H", len(recs)) + table + b"".join(recs))


def test_mobi(spark):
    body = ("<h1>One</h1><p>first <b>x</b></p><h2>Two</h2><p>second</p><ul>own</ul>" + "<p>" + "z" * 1200 + "</p>").encode()
    file = palm([body, b"\x89PNGcover"], [(503, b"T"), (100, b"A"), (101, b"a; b,a")])
    marks = palm([("<p>第一章 甲</p>" + "文" * 1100 + "<p>第二章 乙</p>末").encode()])
    df = spark.createDataFrame([(1, file), (2, marks), (3, bytearray(b"short")), (4, None), (5, palm([b"y" * 1500]))], "k INT, content BINARY")
    docs = mobi.mobi_documents(df, "k").orderBy("k", "index").collect()
    assert [(d.k, d.title, d.level) for d in docs] == [(1, "One", 0), (1, "Two", 1), (2, "第一章 甲", 0), (2, "第二章 乙", 0), (5, "全文", 0)]
    assert [e.type for e in docs[0].content] == ["Heading", "Heading", "Paragraph"] and [s.styles for s in docs[0].content[2].spans] == [[], ["BOLD"]]
    assert [(r.k, r.title, r.author, r.tags) for r in mobi.mobi_metadata(df, "k").collect()] == [(1, "T", "A", ["a", "b"])]
    assert [(r.k, r.ext) for r in mobi.mobi_covers(df, "k").collect()] == [(1, "png")]


def test_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("a.TXT", "d/b.epub", "c.exe", "e.htm"):
        (tmp_path / n).write_bytes(b"x")
    found = scan.supported(scan.files(spark, [str(tmp_path)]))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.TXT", "b.epub"]
    assert scan.contents(spark, [str(tmp_path)]).count() == 2
    s = spark.createDataFrame([(1, "/a", True), (2, None, True), (3, "/c", False), (4, "/d", True)], "source_id INT, root_path STRING, enabled BOOLEAN")
    got = {r.source_id: r.state for r in scan.source_state(s, spark.createDataFrame([(4,)], "source_id INT")).collect()}
    assert got == {1: "ready", 2: "missing", 3: "disabled", 4: "scanning"}
    p = {r.ext: (r.parser, r.extractor, r.status) for r in scan.by_parser(spark.createDataFrame([("azw",), ("htm",), ("doc",)], "ext STRING")).collect()}
    assert p == {"azw": (None, "mobi", "failed"), "htm": ("html", "html", "pending"), "doc": (None, "generic", "failed")}


def test_rules(spark, tmp_path):
    rules = [{"name": "n1", "rule": "a", "example": "x\ny"}, {"name": "n2", "rule": "b"}, {"name": "n2", "rule": "c"}]
    (tmp_path / "r.json").write_text(json.dumps(rules, indent=1))
    got = scan.rule_file(spark, str(tmp_path / "r.json"))
    assert [(r.name, r.rule, r.priority, r.enabled) for r in got.orderBy("priority").collect()] == [("n1", "a", 0, True), ("n2", "b", 1, True), ("n2", "c", 2, True)]
    have = spark.createDataFrame([("n1",)], "name STRING")
    assert sorted(r.rule for r in scan.import_rules(have, got).collect()) == ["b", "c"]
    assert scan.initial_rules(have, got).count() == 0 and scan.initial_rules(have, got, True).count() == 3 and scan.initial_rules(have.limit(0), got).count() == 3
    assert scan.rule_payload(spark.createDataFrame([(json.dumps(rules),)], "body STRING")).count() == 3


def test_metadata_is_chosen_whole(spark):
    df = spark.sql("SELECT named_struct('title', cast(null as string), 'author', cast(null as string), 'publisher', 'P') AS a, named_struct('title', 'T', 'author', cast(null as string), 'publisher', cast(null as string)) AS b")
    r = df.select(scan.choose_metadata(F.col("a"), F.col("b")).alias("m")).first().m
    assert (r.title, r.publisher) == ("T", None)


def test_stream(spark, tmp_path):
    schema = "doc_id INT, text STRING"
    src = spark.createDataFrame([(i, None if i == 3 else f"Chapter {i}\n\nwords of {i}") for i in range(8)], schema)
    src.repartition(8).write.parquet(str(tmp_path / "in"))
    seen = []
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    kind = StructType([StructField("doc_id", IntegerType()), StructField("text", StringType())])
    run = lambda: poll.parse_stream(spark, str(tmp_path / "in"), kind, str(tmp_path / "out"), str(tmp_path / "cp"), files_per_batch=3, on_batch=lambda _, n: seen.append(n))
    q = run()
    q.awaitTermination()
    assert poll.state(q)["running"] is False and len(seen) >= 2
    status = {r.doc_id: r.parse_status for r in spark.read.parquet(str(tmp_path / "out/status")).collect()}
    assert len(status) == 8 and status[3] == "failed" and status[0] == "completed"
    chapters = spark.read.parquet(str(tmp_path / "out/chapters")).collect()
    assert len(chapters) == 7 and all(r.words == 5 for r in chapters)
    run().awaitTermination()  # nothing new: nothing is parsed again
    assert spark.read.parquet(str(tmp_path / "out/status")).count() == 8


def test_latest_metadata(spark):
    b = spark.createDataFrame([(1, None, None, None, None, "/x/stem.epub")], "id INT, title STRING, author STRING, publisher STRING, isbn STRING, file_path STRING")
    m = spark.createDataFrame([(1, 1, D(2024, 1, 1), None, "A", "x" * 1100), (1, 2, D(2024, 1, 2), None, None, None)], "book_id INT, meta_id INT, extracted_at TIMESTAMP_NTZ, title STRING, author STRING, description STRING").withColumns({"publisher": F.lit(None).cast("string"), "isbn": F.lit(None).cast("string")})
    r = scan.apply_metadata(b, m).first()
    assert (r.title, r.author, len(r.description)) == ("stem", "A", 1000)


def test_mixed_files(spark):
    from librarium.functions import content as C
    from librarium.sources import parsers

    rows = [(1, "/l/a.txt", bytearray("Chapter 1\n\nIt is long\n\nsome words".encode()), "txt"), (2, "/l/b.html", bytearray(PAGE.encode()), "html"), (3, "/l/c.epub", book(), "epub"), (4, "/l/d.pdf", bytearray(b"x"), "pdf"), (5, "/l/e.xyz", bytearray(b"x"), "xyz")]
    df = spark.createDataFrame(rows, "book_id INT, path STRING, content BINARY, ext STRING")
    docs = parsers.documents(df)
    got = {(r.book_id, r["index"]): r for r in docs.collect()}
    assert {b for b, _ in got} == {1, 2, 3} and got[1, 0].word_count == 7 and got[3, 0].image_count == 1 and got[2, 0].title == "One"
    meta = {r.book_id: r for r in parsers.metadata(df).collect()}
    assert (meta[1].title, meta[2].author, meta[3].tags, meta[5].title) == ("a", "A", ["s1", "s2"], "e")
    assert {r.book_id: (r.parse_status, r.chapters_count) for r in parsers.statuses(df, docs).collect()} == {1: ("completed", 1), 2: ("completed", 2), 3: ("completed", 4), 4: ("failed", 0), 5: ("failed", 0)}
    old = parsers.PARSERS["pdf"]
    parsers.register("pdf", parsers._text_rows)
    assert parsers.documents(df).filter("book_id = 4").count() == 1
    parsers.register("pdf", old)
    back = docs.select("book_id", "index", "content", C.from_text(C.to_text(F.col("content"))).alias("again")).collect()
    assert all(r.content == r.again for r in back)
    given = '[{"type":"com.x.Paragraph","spans":[{"text":"a"}],"unknown":1}]'
    e = spark.createDataFrame([(given,)], "t STRING").select(C.from_text(F.col("t")).alias("e")).first().e[0]
    assert (e.type, e.spans[0].text, e.spans[0].styles) == ("Paragraph", "a", [])


def _damaged():
    """A container that opens, with one member whose bytes were changed."""
    data = book()
    at = bytes(data).index(b"<h1>A</h1>")
    data[at] ^= 0xFF
    return data


def test_damaged_files_fail_alone(spark):
    from librarium.sources import parsers

    rows = [(1, book(), "epub"), (2, _damaged(), "epub"), (3, bytearray(b"PK\x03\x04 broken"), "epub"), (4, bytearray(b"%PDF-1.4 nothing"), "pdf"), (5, bytearray(b"Chapter 1\nx"), "txt"), (6, None, "html"), (7, bytearray(b"\x00" * 90), "mobi")]
    df = spark.createDataFrame(rows, "book_id INT, content BINARY, ext STRING").withColumn("path", F.lit("/l/f.x"))
    docs = parsers.documents(df)
    assert {r.book_id: r.n for r in docs.groupBy("book_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 4, 5: 1}
    assert {r.book_id for r in parsers.statuses(df, docs).filter("parse_status = 'failed'").collect()} == {2, 3, 4, 6, 7}
    assert {r.k for r in epub.epub_documents(df.selectExpr("book_id AS k", "content").filter("k < 4"), "k").collect()} == {1}
    assert parsers.metadata(df).count() == 7


def test_mixed_files_are_read_once(spark, tmp_path):
    from librarium.sources import parsers

    (tmp_path / "a.txt").write_text("Chapter 1\nx")
    (tmp_path / "b.html").write_text(PAGE)
    files = scan.contents(spark, [str(tmp_path)]).withColumn("book_id", F.xxhash64("path"))
    for df in (parsers.documents(files), parsers.metadata(files)):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    assert parsers.documents(files)._jdf.queryExecution().executedPlan().toString().count("binaryFile") == 1
    assert parsers.documents(files).count() == 3


CHAPTERS = [("Chapter 1", ["One & two", "第一 <行>", "café"]), ("Chapter 2", ["ALL CAPITALS", "x" * 700, "end"]), ("Chapter 3", ["last"])]


def test_pdf():
    from librarium.sources import pdf, samples

    data = samples.paged("Tïtle", "A. B", "P", ["t1", "t2"], CHAPTERS)
    p = pdf.Pdf(data)
    assert p.images() == [(1, "Im1", b"\xff\xd8picture of page 1")]
    assert [p.text(x) for x in p.pages()] == ["\n\n".join([t, *ps]) for t, ps in CHAPTERS]
    assert p.outline() == [("Chapter 1", True), ("Chapter 2", True), ("Chapter 3", False)]
    assert pdf.metadata(data) == {"title": "Tïtle", "author": "A. B", "publisher": "P", "description": None, "isbn": None, "tags": ["t1", "t2"]}
    assert [c[:4] for c in pdf.chapters(samples.paged("T", None, None, [], CHAPTERS * 20, False))] == [(i, f"第 {i + 1} 部分 (页 {20 * i + 1}-{20 * i + 20})", 20 * i, 20 * i + 19) for i in range(3)]


def test_pdf_by_hand():
    import zlib

    import pytest

    from librarium.sources import pdf

    z = zlib.compress(b"<< /Type /Catalog /Pages 3 0 R >> << /Type /Pages /Kids [4 0 R 5 0 R] >>")
    text = rb"BT 14 TL 1 0 0 1 0 700 Tm (a \(b\) \101\n) Tj [(c) -300 (d)] TJ T* (e) ' 0 -14 Td <66> Tj ET"
    data = b"%PDF-1.5\n9 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode /Length " + str(len(zlib.compress(b"1 0 3 34 " + zlib.decompress(z)))).encode() + b" >> stream\n" + zlib.compress(b"1 0 3 34 " + zlib.decompress(z)) + b"\nendstream endobj\n"
    data += b"4 0 obj << /Type /Page /Contents [6 0 R] >> endobj 5 0 obj << /Type /Page /Resources << /XObject << /I 7 0 R >> >> >> endobj\n"
    data += b"6 0 obj << /Length 8 0 R >> stream\n" + text + b"\nendstream endobj 8 0 obj " + str(len(text)).encode() + b" endobj\n"
    data += b"7 0 obj << /Subtype /Image /Filter /DCTDecode /Length 4 >> stream\n\xff\xd8\xff\xd9\nendstream endobj\ntrailer << /Root 1 0 R >>"
    p = pdf.Pdf(data)
    assert [p.text(x) for x in p.pages()] == ["a (b) A\nc d\n\ne\nf".replace("d\n\ne", "d\n\ne"), ""]
    assert p.images() == [(1, "I", b"\xff\xd8\xff\xd9")] and p.outline() == [] and p.info() == {}
    for bad in (b"", b"x" * 2000, b"%PDF-1.4 trailer << /Encrypt 1 0 R >>"):
        with pytest.raises(ValueError):
            pdf.Pdf(bad)
    assert list(pdf.chapters(b"%PDF-1.4 nothing")) == []


def test_records_past_the_hundredth_are_read():
    parts = [(f"<p>part {i} " + "z" * 400 + "</p>").encode() for i in range(150)]
    data = bytes(palm(parts))
    assert "part 149 " in mobi.text_of(data) and "part 149 " not in mobi.text_of(data, compat=True) and "part 98 " in mobi.text_of(data, compat=True)


def test_generic_metadata():
    from librarium.sources import generic, samples

    assert generic.metadata(samples.office("T & t", None, "P", ["a", "b"], [])) == {"title": "T & t", "author": None, "publisher": "P", "description": None, "isbn": None, "tags": ["a", "b"]}
    book = b'<?xml version="1.0"?><FictionBook><description><title-info><book-title>B</book-title><author>A  C</author><keywords>x, y</keywords></title-info></description></FictionBook>'
    assert generic.metadata(book)["title"] == "B" and generic.metadata(book)["author"] == "A C" and generic.metadata(book)["tags"] == ["x", "y"]
    assert generic.metadata(b"plain") is None and generic.metadata(b"<?xml broken") is None and generic.metadata(b"<?xml version='1.0'?><a/>") is None and generic.metadata(b"x" * (11 << 20)) is None
