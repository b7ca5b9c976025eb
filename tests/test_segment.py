import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from librarium.plans import segment, toc

HEADER = re.compile("|".join(f"(?:{p})" for p in segment.FALLBACK))


def model(text, compat=False):
    """Chapters by hand, line after line."""
    if text is None:
        return []
    found, pos = [], 0
    for line in re.findall(r"[^\r\n]*(?:\r\n|\n|\r|$)", text):
        bare = line.rstrip("\r\n")
        head = HEADER.fullmatch(bare.strip()) is not None
        if head:
            found.append((bare.strip(), pos))
        pos += (0 if head else len(bare) + 1) if compat else len(line)
    found = found or [("全文", 0)]
    ends = [p for _, p in found[1:]] + [len(text)]
    return [(i, t, p, e) for i, ((t, p), e) in enumerate(zip(found, ends))]


def run(spark, texts, **how):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "k INT, text STRING, pos INT")
    out = [[] for _ in texts]
    for r in segment.chapters(df, **how).orderBy("k", "index").collect():
        out[r.k].append((r["index"], r.title, r.start_pos, r.end_pos))
    return out


def test_cases(spark):
    text = "x\n第一章 a\nbody\n第二章 b\nend"
    assert run(spark, [text])[0] == [(0, "第一章 a", 2, 13), (1, "第二章 b", 13, 22)]
    assert run(spark, [text], compat=True)[0] == [(0, "第一章 a", 2, 7), (1, "第二章 b", 7, 22)]
    assert run(spark, ["plain", "", None]) == [[(0, "全文", 0, 5)], [(0, "全文", 0, 0)], []]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["第一章 x", "Chapter 3", "body", " 1. y", "", "第二卷"]), max_size=6), min_size=30, max_size=30), st.sampled_from(["\n", "\r\n", "\r"]))
def test_model(spark, texts, end):
    texts = [end.join(t) for t in texts]
    assert run(spark, texts) == [model(t) for t in texts]
    if end == "\n":
        assert run(spark, texts, compat=True) == [model(t, True) for t in texts]


def elements(spark, body, title, how=segment.text_elements):
    df = spark.createDataFrame([(body, title)], "b STRING, t STRING").select(how(F.col("b"), F.col("t")).alias("e"))
    return [(e.type, e.text if e.spans is None else [s.text for s in e.spans]) for e in df.first().e]


def test_elements(spark):
    assert elements(spark, "T\n\np1\np2\n\np3", "T") == [("Heading", "T"), ("Paragraph", ["p1", "p2"]), ("Paragraph", ["p3"])]
    assert elements(spark, "T\nrest", "T") == [("Heading", "T\nrest")]
    assert elements(spark, "LOUD\n\nChapter 3 x\n\n a \n b", "T", segment.pdf_elements) == [("Heading", "T"), ("Heading", "LOUD"), ("Heading", "Chapter 3 x"), ("Paragraph", ["a", "b"])]


def test_page_parts(spark):
    df = spark.createDataFrame([(50,), (51,), (201,), (0,), (None,)], "pages INT")
    got = {}
    for r in segment.page_parts(df).orderBy("pages", "index").collect():
        got.setdefault(r.pages, []).append((r.start_page, r.end_page))
    assert len(got[50]) == 5 and got[51] == [(0, 19), (20, 39), (40, 50)] and len(got[201]) == 7 and got[201][-1] == (180, 200)


def test_rules_become_one_pattern(spark):
    rules = spark.createDataFrame([(1, "b+", True, 2), (2, "(", True, 1), (3, "a", True, 1), (4, "c", False, 0)], "id INT, rule STRING, enabled BOOLEAN, priority INT")
    assert segment.header_pattern(rules) == "(?:a)|(?:b+)"
    assert segment.header_pattern(rules.limit(0)) == segment.header_pattern()


def parents(levels):
    stack, out = [], []
    for i, lv in enumerate(levels):
        while stack and levels[stack[-1]] >= lv:
            stack.pop()
        if lv == 0:
            stack = []
        kept = lv == 0 or bool(stack)
        out.append((i, stack[-1] if stack else None, kept))
        if kept:
            stack.append(i)
    return out


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=12), min_size=20, max_size=20))
def test_tree(spark, books):
    rows = [(b, i, lv, True) for b, levels in enumerate(books) for i, lv in enumerate(levels)]
    df = spark.createDataFrame(rows, "book_id INT, doc_index INT, toc_level INT, in_toc BOOLEAN")
    got = {}
    for r in toc.tree(df).orderBy("book_id", "index").collect():
        got.setdefault(r.book_id, []).append((r["index"], r.parent_index, r.kept))
    assert got == {b: parents(levels) for b, levels in enumerate(books)}


def test_tree_case(spark):
    assert [(p if k else "dropped") for _, p, k in parents([1, 0, 1, 2, 1, 0, 2])] == ["dropped", None, 1, 2, 1, None, 5]


def test_navigation(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "book_id INT, doc_index INT")
    assert [tuple(r) for r in toc.navigation(df).orderBy("doc_index").collect()] == [(1, 0, None, 1), (1, 1, 0, 2), (1, 2, 1, None)]
