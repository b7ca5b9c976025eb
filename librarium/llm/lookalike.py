"""Visually identical text with different characters (problem 6): one consistent form."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from librarium.session import checkpoint

# Letters of other scripts that look like a Latin letter, each beside the letter it looks like, after the
# public table of confusable characters of the Unicode security mechanisms (UTS 39): its single letters of these scripts.
CYRILLIC = "аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅԌԚԜѵӏ"
CYRILLIC_LIKE = "aeopcyxijshdqwABEKMHOPCTYXIJSGQWvl"
GREEK = "οανρυιΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϹϳͿ"
GREEK_LIKE = "oavpuiABEZHIKMNOPTYXcCjJ"
OTHER = "ɑɡıՕօոսհցզյՍ"
OTHER_LIKE = "agıOonuhgqjU"
COPTIC = "ⲟⲞⲣⲢⲥⲤⲔⲘⲚⲎⲒⲦⲬⲂⲈⲀ"
COPTIC_LIKE = "oOpPcCKMNHITXBEA"
CHEROKEE = "ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏔᏕᏙᏞᏟᏢᏦᏧᏴ"
CHEROKEE_LIKE = "DRTiAJEWMHYGZbWSVLCPKdB"
LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓳꓴ"
LISU_LIKE = "BPDTGKJCZFMNLSRVHWXYAEOU"
SMALL_CAPITALS = "ᴄᴏꜱᴠᴡᴢ"
SMALL_CAPITALS_LIKE = "cosvwz"
_TO_LATIN = {
    ord(a): b
    for a, b in zip(CYRILLIC + GREEK + OTHER + COPTIC + CHEROKEE + LISU + SMALL_CAPITALS, CYRILLIC_LIKE + GREEK_LIKE + OTHER_LIKE + COPTIC_LIKE + CHEROKEE_LIKE + LISU_LIKE + SMALL_CAPITALS_LIKE)
}
ARMENIAN = {b: a for a, b in zip(OTHER, OTHER_LIKE) if 0x530 <= ord(a) < 0x590}
#: Ranges of the scripts, and the way back from the Latin letters to theirs.
_SCRIPTS = [
    ((0x370, 0x400), (0x1F00, 0x2000), dict(zip(GREEK_LIKE, GREEK))), ((0x400, 0x530), (0x1C80, 0x1C90), dict(zip(CYRILLIC_LIKE, CYRILLIC))), ((0x530, 0x590), (0xFB13, 0xFB18), ARMENIAN),
    ((0x13A0, 0x1400), (0xAB70, 0xABC0), dict(zip(CHEROKEE_LIKE, CHEROKEE))), ((0xA4D0, 0xA500), (0, 0), dict(zip(LISU_LIKE, LISU))), ((0x2C80, 0x2D00), (0, 0), dict(zip(COPTIC_LIKE, COPTIC))),
]
_BACK = [{ord(a): b for a, b in back.items()} for _, _, back in _SCRIPTS]
#: Characters without a look of their own.
INVISIBLE = {0xAD, 0x34F, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF}
#: Joiners have a look in these scripts, and inside emoji.
_JOINERS = {0x200C, 0x200D, 0xFE0F}
_KIND: dict[str, int] = {}
STABLE, MARK, CHANGES = 0, 1, 2


def kind(c: str) -> int:
    """STABLE: the character stays as it is whatever stands around it; MARK: it may join the one before; CHANGES: it is replaced."""
    k = _KIND.get(c)
    if k is None:
        o = ord(c)
        if o < 0x80:
            k = STABLE
        elif o in INVISIBLE or o in _TO_LATIN or unicodedata.category(c) == "Zs":
            k = CHANGES
        elif unicodedata.combining(c) or 0x1160 <= o < 0x1200:
            k = MARK
        elif _fold_width(c) != c or not unicodedata.is_normalized("NFC", c) or _TO_LATIN.keys() & set(map(ord, unicodedata.normalize("NFD", c))):
            k = CHANGES
        else:
            k = STABLE
        if len(_KIND) < 200_000:
            _KIND[c] = k
    return k


def _fold_width(c: str) -> str:
    """Width, font, circled and squared forms of letters and digits, ligatures, radicals, numerals made of letters; punctuation keeps its width."""
    d = unicodedata.decomposition(c)
    if d.startswith(("<wide>", "<narrow>", "<font>", "<circle>", "<square>")) or (d.startswith("<compat>") and (0x2E80 <= ord(c) < 0x2FE0 or 0xFB00 <= ord(c) < 0xFB07 or 0x2160 <= ord(c) < 0x2180)):
        t = unicodedata.normalize("NFKC", c)
        if t.isalnum():
            return t
    return c


def _joins_matter(text: str, i: int) -> bool:
    """A joiner or selector between characters whose look it changes: Arabic, Indic, other joining scripts, emoji."""
    near = [text[j] for j in (i - 1, i + 1) if 0 <= j < len(text)]
    return any(0x600 <= ord(c) < 0x1100 or 0x1780 <= ord(c) < 0x18B0 or 0xFE00 <= ord(c) < 0xFE10 or (unicodedata.category(c) == "So" and not 0x2E80 <= ord(c) < 0x2FE0) for c in near)


def _canonical_segment(text: str, a: int, b: int, table: dict[int, str] = _TO_LATIN) -> str:
    out = []
    for i in range(a, b):
        c = text[i]
        o = ord(c)
        if o in INVISIBLE:
            if o in _JOINERS and _joins_matter(text, i):
                out.append(c)
        elif o >= 0x80 and unicodedata.category(c) == "Zs":
            out.append(" ")
        else:
            out.append(_fold_width(c) if o >= 0x80 else c)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(out)).translate(table))


def skeleton(text: str, table: dict[int, str] = _TO_LATIN) -> str:
    """The form by which texts that look the same are equal.

    Only segments that hold an unstable character are touched: each is widened to the character before it, with which
    a mark may combine, and to the next character that no mark can join; the canonical segments are spliced into the
    text that stays.
    """
    if text.isascii():
        return text
    n, i, done, out = len(text), 0, 0, []
    while i < n:
        if kind(text[i]) == STABLE:
            i += 1
            continue
        a = i
        while a > done and (a == i or kind(text[a]) == MARK):
            a -= 1
        b = i + 1
        while b < n and kind(text[b]) != STABLE:
            b += 1
        out.append(text[done:a])
        out.append(_canonical_segment(text, a, b, table))
        done = i = b
    out.append(text[done:])
    return "".join(out)


def consistent(text: str) -> str:
    """The skeleton with each word in one script: words that hold a letter only Cyrillic, Greek or another script has stay in that script."""
    s = skeleton(text)
    if s.isascii():
        return s
    return " ".join(w if w.isascii() else _in_one_script(o, w) for o, w in zip(skeleton(text, {}).split(" "), s.split(" ")))


def _in_one_script(own: str, latin: str) -> str:
    """A word with its own letters where one script besides Latin is left in it and can write all of it."""
    scripts = {x for c in latin if c.isalpha() and ord(c) >= 0x370 for x in [_script(c)] if x is not None}
    if len(scripts) != 1:
        return latin
    at = scripts.pop()
    out = []
    for o, c in zip(unicodedata.normalize("NFD", own), unicodedata.normalize("NFD", latin)):
        if o.isalpha() and _script(o) != at:
            if ord(c) < 0x370 and ord(c) not in _BACK[at]:
                return latin
            o = _BACK[at].get(ord(c), c)
        out.append(o)
    return unicodedata.normalize("NFC", "".join(out))


def _script(c: str) -> int | None:
    o = ord(c)
    return next((i for i, (a, b, _) in enumerate(_SCRIPTS) if a[0] <= o < a[1] or b[0] <= o < b[1]), None)


def normalized(df: DataFrame, columns: list[str], how=consistent, suffix: str = "_norm") -> DataFrame:
    """All columns of df, and for each of `columns` its consistent form as `column` + suffix. Null stays null, empty stays empty."""
    names = [c + suffix for c in columns]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.StringType()) for c in names)])
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = [pa.array([None if t is None else how(t) for t in batch.column(i).to_pylist()], pa.string()) for i in at]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    return df.mapInArrow(run, schema)


def several_spellings(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(id, look, spelling) of the rows whose look is spelled in two ways at least."""
    rows = normalized(df.select(F.col(key).cast("long").alias("id"), *columns).dropna(), columns, skeleton, "_look")
    both = lambda s: F.concat_ws("\x00", *(c + s for c in columns))
    rows = rows.select("id", both("_look").alias("look"), both("").alias("spelling"))
    several = rows.groupBy("look").agg(F.min("spelling").alias("a"), F.max("spelling").alias("b")).filter("a <> b").select("look")
    return checkpoint(rows.join(several, "look", "left_semi"))


def look_classes(df: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """(id, class_id, links): each row that has a partner in `same_look`, with the smallest id of its look and the number of its partners.

    The form that does not grow with the square of a group. Defined results as in `same_look`; repeated ids count once.
    Counts are combined in each task before two small tables (looks, spellings) are joined to the rows.
    """
    rows = several_spellings(df, columns, key).distinct()
    spelled = checkpoint(rows.groupBy("look", "spelling").agg(F.count(F.lit(1)).alias("mine"), F.min("id").alias("first")))
    looks = spelled.groupBy("look").agg(F.sum("mine").alias("all"), F.min("first").alias("class_id"))
    known = spelled.join(looks, "look").select("look", "spelling", "class_id", (F.col("all") - F.col("mine")).alias("links"))
    return rows.join(known, ["look", "spelling"]).select("id", "class_id", "links")


def same_look(df: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of rows whose `columns` all look the same while at least one differs in characters.

    Defined results: a row with a null in any of the columns is in no pair; rows that are identical in all columns make
    no pair with each other; ids are compared as stored, a null id is in no pair; empty texts are equal to empty texts.

    Looks are compared by hash: one shuffle finds the looks that have two spellings at least, and only their rows go
    on. Spellings of a look are paired first, and rows are attached to pairs of spellings, so a spelling that a third
    of all rows share is never compared with itself: work follows the size of the result.
    """
    rows = several_spellings(df, columns, key)
    spellings = rows.select("look", "spelling").distinct()
    pairs = spellings.join(spellings.withColumnRenamed("spelling", "other"), "look").filter("spelling < other")
    one = pairs.join(rows.select("look", "spelling", F.col("id").alias("x")), ["look", "spelling"])
    two = one.join(rows.select("look", F.col("spelling").alias("other"), F.col("id").alias("y")), ["look", "other"])
    return two.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).filter("id_a < id_b").distinct()
