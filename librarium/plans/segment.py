"""From raw text to chapters and typed elements, as plans of built-in expressions.

A text is handled inside its own row with array functions: no shuffle, no window, and a huge text cannot unbalance a
window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from librarium.functions import text as X
from librarium.schemas import ELEMENT, SPAN

# What opens a chapter where no rules are given. "Chapter" and numbers, ordinal chapters, numbered items, volumes.
FALLBACK = [
    r"^(Chapter|CHAPTER|Ch\.|Ch)\s*([0-9]+|One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten).*$",
    r"^第([零一二三四五六七八九十百千万0-9]+)[章节回].*$",
    r"^([零一二三四五六七八九十百千万]+)[、．.].*$",
    r"^([0-9]{1,3})[、．.].*$",
    r"^第([零一二三四五六七八九十百千万0-9]+)[卷部篇].*$",
]
# The title of a text without chapters.
WHOLE = "全文"


def header_pattern(rules: DataFrame | None = None) -> str:
    """One pattern for all header rules: enabled ones by priority that compile, else the fall-back.

    The rules are a small table kept by hand; they are joined into one constant, so that matching stays a plain
    expression that needs no join.
    """
    patterns = []
    if rules is not None:
        pattern = rules.sparkSession._jvm.java.util.regex.Pattern
        for r in rules.filter("enabled").orderBy("priority", "id").select("rule").toLocalIterator():
            try:
                pattern.compile(r.rule)
                patterns.append(r.rule)
            except Exception:  # noqa: BLE001 - a rule that does not compile is passed over
                continue
    return "|".join(f"(?:{p})" for p in (patterns or FALLBACK))


def chapters(df: DataFrame, text: str = "text", pattern: str | None = None, compat: bool = False) -> DataFrame:
    """One row per chapter: the columns of df without the text, index, title, start_pos, end_pos (code points).

    A line that, trimmed, matches the pattern as a whole opens a chapter; it ends where the next one begins or the text
    ends. What stands before the first header belongs to no chapter. A text without headers is one chapter. Null texts
    give no chapter, an empty text one of length 0.

    compat reproduces two known offset errors of an older reader: a header line does not advance the position, and a
    line break of two characters counts as one.
    """
    others = [c for c in df.columns if c != text]
    rows = df.filter(F.col(text).isNotNull()).select(*others, chapter_structs(F.col(text), pattern, compat).alias("_found"))
    return rows.select(*others, F.inline("_found"))


def chapter_structs(text: Column, pattern: str | None = None, compat: bool = False) -> Column:
    """The same as an array of (index, title, start_pos, end_pos) inside the row; null for a null text."""
    pattern = pattern or header_pattern()
    # every line with its break, so that positions add up: split after each break
    lines = F.regexp_extract_all(text, F.lit(r"[^\r\n]*(?:\r\n|\n|\r|\z)"), 0)
    bare = lambda x: F.regexp_replace(x, r"[\r\n]+\z", "")
    # each line once: its title if it opens a chapter, and by how much it moves the position
    title = lambda x: X.utrim(bare(x))
    marked = F.transform(lines, lambda x: F.struct(F.when(X.full_match(title(x), pattern), title(x)).alias("title"), x.alias("line")))
    if compat:
        step = lambda m: F.when(m["title"].isNotNull(), F.lit(0)).otherwise(F.length(bare(m["line"])) + 1)
    else:
        step = lambda m: F.length(m["line"])
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<title:string,pos:int>>").alias("found"))

    def walk(acc: Column, m: Column) -> Column:
        found = F.when(m["title"].isNotNull(), F.concat(acc["found"], F.array(F.struct(m["title"].alias("title"), acc["pos"].alias("pos"))))).otherwise(acc["found"])
        return F.struct((acc["pos"] + step(m)).cast("int").alias("pos"), found.alias("found"))

    whole = F.array(F.struct(F.lit(WHOLE).alias("title"), F.lit(0).alias("pos")))

    def ends(acc: Column) -> Column:
        """Inside the fold, so that what was found is a variable there and is not found anew for each chapter."""
        xs = F.when(F.size(acc["found"]) > 0, acc["found"]).otherwise(whole)
        n = F.length(text) if compat else acc["pos"]
        return F.transform(xs, lambda c, i: F.struct(i.alias("index"), X.clean_title(c["title"]).alias("title"), c["pos"].alias("start_pos"), F.coalesce(F.try_element_at(xs, i + 2)["pos"], n).alias("end_pos")))

    return F.when(text.isNull(), F.lit(None)).otherwise(F.aggregate(marked, start, walk, ends))


def with_body(df: DataFrame, key: str, text: str = "text", pattern: str | None = None) -> DataFrame:
    """Chapters with their text (key, index, title, body), cut inside the row of the text."""
    both = chapters(df.select(key, text, F.col(text).alias("_keep")), text, pattern)
    return both.select(key, "index", "title", F.expr("substring(_keep, start_pos + 1, end_pos - start_pos)").alias("body"))


def _empty(kind: str, **known: Column) -> Column:
    fields = {
        "type": "string", "level": "int", "text": "string", "language": "string", "src": "string", "alt": "string", "width": "int", "height": "int", "ordered": "boolean", "id": "string",
        "spans": f"array<{SPAN.lower().replace('footnoteid', 'footnoteId').replace('footnoteimage', 'footnoteImage')}>",
        "items": f"array<struct<spans: array<{SPAN.lower().replace('footnoteid', 'footnoteId').replace('footnoteimage', 'footnoteImage')}>>>",
    }
    known = {"type": F.lit(kind)} | known
    return F.struct(*(known.get(c, F.lit(None)).cast(t).alias(c) for c, t in fields.items()))


def span(text: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(text.alias("text"), F.array().cast("array<string>").alias("styles"), null.alias("link"), null.alias("footnoteId"), null.alias("footnoteImage"))


def text_elements(body: Column, title: Column) -> Column:
    """Elements of a chapter of plain text: parts between blank lines; a first part that begins with the title is a heading, the others are paragraphs with a span per line."""
    parts = F.filter(F.transform(F.split(body, "\n\n"), X.utrim), lambda p: p != "")
    paragraph = lambda p: _empty("Paragraph", spans=F.transform(F.split(p, "\n"), span))
    return F.transform(parts, lambda p, i: F.when((i == 0) & F.coalesce(F.startswith(p, title), F.lit(False)), _empty("Heading", level=F.lit(1), text=p)).otherwise(paragraph(p)))


def pdf_elements(text: Column, title: Column) -> Column:
    """Elements of pages of text: the title, then parts between blank lines; short ones in capitals or with a chapter mark are headings."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), X.utrim), lambda p: p != "")
    # fixed value: what opens a chapter in the text of pages
    mark = r"(第[零一二三四五六七八九十百千万0-9]+[章节]|Chapter\s+\d+|\d+\.).*"
    head = lambda p: (F.length(p) < 100) & (p.rlike(r"^[\p{Lu}\s]+$") | X.full_match(p, mark))
    lines = lambda p: F.filter(F.transform(F.split(p, "\n"), X.utrim), lambda x: x != "")
    body = F.transform(parts, lambda p: F.when(head(p), _empty("Heading", level=F.lit(2), text=p)).otherwise(_empty("Paragraph", spans=F.transform(lines(p), span))))
    first = F.when(~X.is_blank(title), F.array(_empty("Heading", level=F.lit(1), text=title))).otherwise(F.array().cast(f"array<{ELEMENT}>"))
    return F.concat(F.coalesce(first, F.array().cast(f"array<{ELEMENT}>")), body)


def element_words(elements: Column) -> Column:
    """Words of elements: paragraphs, headings, quotes, code and lists count; footnotes, images and dividers do not."""
    of_spans = lambda xs: F.aggregate(F.coalesce(xs, F.array().cast(f"array<{SPAN}>")), F.lit(0).cast("bigint"), lambda a, s: a + X.word_count(s["text"]))

    def one(e: Column) -> Column:
        of_items = F.aggregate(F.coalesce(e["items"], F.array().cast(f"array<struct<spans: array<{SPAN}>>>")), F.lit(0).cast("bigint"), lambda a, i: a + of_spans(i["spans"]))
        return F.when(e["type"].isin("Paragraph", "Quote"), of_spans(e["spans"])).when(e["type"].isin("Heading", "Code"), X.word_count(e["text"])).when(e["type"] == "ListBlock", of_items).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(elements, F.lit(0).cast("bigint"), lambda a, e: a + one(e))


def element_images(elements: Column) -> Column:
    """Images at the top level."""
    return F.size(F.filter(elements, lambda e: e["type"] == "Image")).cast("bigint")


def page_parts(df: DataFrame, pages: str = "pages") -> DataFrame:
    """Parts of a paged document without an outline: 10 pages each up to 50 pages, 20 up to 200, else 30. Pages count from 0."""
    size = F.when(F.col(pages) <= 50, 10).when(F.col(pages) <= 200, 20).otherwise(30)
    rows = df.filter(F.col(pages) > 0).withColumn("_s", size)
    one = rows.select("*", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col(pages).cast("bigint") - 1, F.col("_s").cast("bigint"))).alias("index", "start_page"))
    end = F.least(F.col("start_page") + F.col("_s") - 1, F.col(pages) - 1)
    one = one.withColumn("end_page", end.cast("bigint"))
    label = F.concat(F.lit("第 "), (F.col("index") + 1).cast("string"), F.lit(" 部分 (页 "), (F.col("start_page") + 1).cast("string"), F.lit("-"), (F.col("end_page") + 1).cast("string"), F.lit(")"))
    return one.withColumn("title", label).drop("_s")


def outline_chapters(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Chapters from the top level of an outline. items: book_id, index, title, has_target; documents: book_id, pages.

    The first page is an estimate from the position in the outline (whole division, at least ten steps); a chapter ends
    before the next one begins, the last with the document.
    """
    start = F.when(F.col("has_target"), F.col("index") * F.expr("pages div 10")).otherwise(F.lit(0)).cast("bigint")
    rows = items.join(documents, "book_id").select("book_id", "index", F.coalesce("title", F.concat(F.lit("Chapter "), (F.col("index") + 1).cast("string"))).alias("title"), start.alias("start_page"), "pages")
    nxt = F.lead("start_page").over(Window.partitionBy("book_id").orderBy("index"))
    return rows.select("book_id", "index", "title", "start_page", F.coalesce(nxt - 1, F.col("pages") - 1).cast("bigint").alias("end_page"))


def first_per_position(matches: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of entries with one position the one that came first."""
    w = Window.partitionBy(*key).orderBy(order)
    return matches.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
