"""Scalar text functions as Column expressions; none needs a Python worker. A null argument gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as the trimming functions see it; Spark's trim knows the space only.
WHITE = r"[\s\x1C-\x1F\p{Z}]"
# The blocks whose characters count as one word each (ideographs, extension A, compatibility, kana, Hangul).
WIDE = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}]"
# Media types by extension.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "bmp": "image/bmp"}
#: Longest description that is kept.
DESCRIPTION = 1000


def utrim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def is_blank(c: Column) -> Column:
    """Nothing but white space; null for null."""
    return ~c.rlike(f"(?!{WHITE})(?s:.)")


def word_count(c: Column) -> Column:
    """Words of a text: each wide character is one; of the rest, runs between white space that hold a letter or digit.

    Only characters of the basic plane count as letters. Null counts 0.
    """
    rest = F.regexp_replace(c, WIDE, "")
    letter = r"[\p{L}\p{Nd}&&[\x{0}-\x{FFFF}]]"
    words = F.size(F.filter(F.split(rest, r"\s+"), lambda w: w.rlike(letter)))
    return F.coalesce(F.length(c) - F.length(rest) + words, F.lit(0)).cast("bigint")


def word_count_plain(c: Column) -> Column:
    """The simpler count: ideographs of the main block, and runs between white space made of ASCII letters only."""
    block = r"[\x{4E00}-\x{9FFF}]"
    rest = F.regexp_replace(c, block, " ")
    return F.coalesce(F.length(c) - F.length(F.regexp_replace(c, block, "")) + F.size(F.filter(F.split(rest, r"\s+"), lambda w: w.rlike("^[a-zA-Z]+$"))), F.lit(0)).cast("bigint")


def clean_title(c: Column) -> Column:
    """Without NUL characters and outer white space."""
    return utrim(F.regexp_replace(c, "\\x00", ""))


def full_match(c: Column, pattern: str) -> Column:
    """Whether the whole string matches; rlike alone would search."""
    return c.rlike(f"\\A(?:{pattern})\\z")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """What stands before the last slash, empty without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"(?s)/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def extension(name: Column, default: str = "") -> Column:
    """What stands after the last dot in lower case, `default` without one."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).when(name.isNotNull(), F.lit(default))


def stem(name: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(name, r"(?s)\.[^.]*$", "")


def fragment_free(href: Column) -> Column:
    """What stands before the first '#'."""
    return F.substring_index(href, "#", 1)


def normalize_path(path: Column, chapter: Column) -> Column:
    """A link of a chapter resolved against the chapter's folder; absolute paths and web addresses stay as they are.

    Empty parts and '.' vanish, '..' goes up and is ignored at the root.
    """
    parts = F.split(F.concat_ws("/", F.nullif(directory(chapter), F.lit("")), path), "/")

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    resolved = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(path.isNull(), path).when(path.rlike("^(/|https?://)"), path).otherwise(resolved)


def join_base(base: Column, href: Column) -> Column:
    return F.when(base == "", href).otherwise(F.concat(base, F.lit("/"), href))


def strip_base(base: Column, path: Column) -> Column:
    head = F.concat(base, F.lit("/"))
    return F.when((base != "") & F.startswith(path, head), F.substring(path, F.length(head) + 1, F.length(path))).otherwise(path)


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(utrim(c), F.lit("")) for c in columns))


def content_name(content: Column, ext: Column) -> Column:
    """Name of stored content: the first 16 hexadecimal digits of its SHA-256 and the extension."""
    return F.concat(F.left(F.sha2(content, 256), F.lit(16)), F.lit("."), ext)


def java_hash(c: Column) -> Column:
    """The 31-polynomial string hash with 32-bit wrap, over UTF-16 units (characters of the basic plane)."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.conv(F.hex(F.encode(x, "UTF-16BE")), 16, 10).cast("bigint"))
    wrap = lambda v: F.pmod(v + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, x: wrap(h * 31 + x)).cast("int")


def colour_bucket(c: Column, buckets: int = 10) -> Column:
    return F.abs(java_hash(c).cast("bigint")) % buckets


def media_type(ext: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(ext)), F.lit("application/octet-stream"))


def image_type(content: Column) -> Column:
    """By the first two bytes; null if it is none of the three kinds."""
    head = F.hex(F.substring(content, 1, 2))
    return F.when(head == "FFD8", "jpg").when(head == "8950", "png").when(head == "4749", "gif")


def absolute_url(url: Column, base: Column) -> Column:
    return F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(base, url))


def base_url(scheme: Column, host: Column, port: Column) -> Column:
    """Ports 80 and 443 are left out."""
    return F.concat(scheme, F.lit("://"), host, F.when(port.isin(80, 443), F.lit("")).otherwise(F.concat(F.lit(":"), port.cast("string"))))


def default_title(title: Column, index: Column) -> Column:
    return F.coalesce(title, F.concat(F.lit("第"), (index + 1).cast("string"), F.lit("章")))


def safe_int(c: Column) -> Column:
    """The integer a text spells, null for anything else."""
    return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("int"))


def description(c: Column) -> Column:
    return F.left(c, F.lit(DESCRIPTION))


def keyword_tags(c: Column, delimiters: str = ",;/|", longest: int = 50) -> Column:
    """Values between delimiters, trimmed, 1 to `longest` characters long, in order of first appearance."""
    parts = F.split(c, "[" + "".join("\\" + d for d in delimiters) + "]")
    return F.array_distinct(F.filter(F.transform(parts, utrim), lambda t: (F.length(t) >= 1) & (F.length(t) <= longest)))


def filename_tags(name: Column) -> Column:
    """Tags of a name like title-number-author-tag,tag.ext: the last of at least two parts between hyphens, parted by commas."""
    parts = F.split(stem(name), "-")
    return F.when(F.size(parts) >= 2, keyword_tags(F.element_at(parts, -1), ",")).otherwise(F.array().cast("array<string>"))
