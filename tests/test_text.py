import random
import re

from pyspark.sql import functions as F

from librarium.functions import text as X


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


WIDE = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0xAC00, 0xD7AF)]


def words(text):
    """The count by hand: wide characters, then runs with a letter or digit of the basic plane."""
    if text is None:
        return 0
    wide = [c for c in text if any(a <= ord(c) <= b for a, b in WIDE)]
    rest = "".join(c for c in text if not any(a <= ord(c) <= b for a, b in WIDE))
    return len(wide) + sum(any((c.isalpha() or c.isdecimal()) and ord(c) < 0x10000 for c in w) for w in re.split(r"[ \t\n\x0b\f\r]+", rest))


def test_word_count(spark):
    given = ["第一章 hello world", "abc中def", "a1 b2 3", "— —", "\U00020000", "", None]
    assert column(spark, given, X.word_count) == [5, 2, 3, 0, 0, 0, 0]
    rng = random.Random(1)
    many = ["".join(rng.choice("ab1 中あ한\n\t—.é\U0001d509　") for _ in range(rng.randint(0, 20))) for _ in range(500)]
    assert column(spark, many, X.word_count) == [words(t) for t in many]


def test_word_count_plain(spark):
    assert column(spark, ["第一章 hello world", "abc中def", "a1 b", None], X.word_count_plain) == [5, 3, 1, 0]


def test_trim_and_titles(spark):
    assert column(spark, ["　 a b \n", "", None, "\x1fx"], X.utrim) == ["a b", "", None, "x"]
    assert column(spark, ["a\x00b ", None], X.clean_title) == ["ab", None]
    assert column(spark, ["", " 　", "x", None], X.is_blank) == [True, True, False, None]


def test_file_name_tags(spark):
    got = column(spark, ["a-1-b-x,y,z.epub", "nodash.txt", "a-.txt", "a-b, b ,,c.txt", None], X.filename_tags)
    assert got[:4] == [["x", "y", "z"], [], [], ["b", "c"]] and not got[4]


def test_keyword_tags(spark):
    assert column(spark, ["a, b;c/ d|a", "x" * 51, None, ""], X.keyword_tags) == [["a", "b", "c", "d"], [], None, []]


def test_paths(spark):
    df = spark.createDataFrame(
        [("../images/a.png", "OEBPS/text/c1.xhtml"), ("./a.png", "c1.xhtml"), ("/abs.png", "x/y"), ("../../../x.png", "a/b.xhtml"), ("http://h/x", "a/b"), (None, "a/b")], "p STRING, c STRING"
    )
    got = [r[0] for r in df.select(X.normalize_path(F.col("p"), F.col("c"))).collect()]
    assert got == ["OEBPS/images/a.png", "a.png", "/abs.png", "x.png", "http://h/x", None]
    assert column(spark, ["a/b/c.TXT", "c", None], lambda c: X.extension(X.file_name(c), "jpg")) == ["txt", "jpg", None]
    assert column(spark, ["a/b/c.txt", "c"], X.directory) == ["a/b", ""]
    assert column(spark, ["a.b.txt", "c"], X.stem) == ["a.b", "c"]
    assert column(spark, ["b/x", "c/x"], lambda c: X.strip_base(F.lit("b"), c)) == ["x", "c/x"]
    assert column(spark, ["x"], lambda c: X.join_base(F.lit("b"), c)) == ["b/x"]
    assert column(spark, ["a.html#x", "b"], X.fragment_free) == ["a.html", "b"]


def java_hash(s):
    h = 0
    for c in s:
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_hash_and_types(spark):
    given = ["", "abc", "书楼之夜", "The Painted Compass of Penaeth" * 3]
    assert column(spark, given, X.java_hash) == [java_hash(s) for s in given]
    assert column(spark, ["png", "JPG", "exe"], X.media_type) == ["image/png", "image/jpeg", "application/octet-stream"]
    assert column(spark, [bytearray(b"\xff\xd8x"), bytearray(b"\x89PN"), bytearray(b"GIF"), bytearray(b"zz")], X.image_type, "binary") == ["jpg", "png", "gif", None]
    assert column(spark, ["12", "-3", "x", "1.5", None, "99999999999"], X.safe_int) == [12, -3, None, None, None, None]


def test_urls_and_defaults(spark):
    assert column(spark, ["http://x", "y"], lambda c: X.absolute_url(c, F.lit("b/"))) == ["http://x", "b/y"]
    assert column(spark, [80, 443, 8080], lambda c: X.base_url(F.lit("http"), F.lit("h"), c), "int") == ["http://h", "http://h", "http://h:8080"]
    assert column(spark, ["t", None], lambda c: X.default_title(c, F.lit(4))) == ["t", "第5章"]
    assert column(spark, ["", "a", None], lambda c: X.first_non_empty(c, F.lit("z"))) == ["z", "a", "z"]
    assert column(spark, [" 　", " a "], lambda c: X.first_non_blank(c, F.lit("z"))) == ["z", "a"]
    assert column(spark, ["x" * 1200], lambda c: F.length(X.description(c))) == [1000]
    assert column(spark, ["第1章 x", " 第1章 x"], lambda c: X.full_match(c, "第[0-9]+章.*")) == [True, False]
