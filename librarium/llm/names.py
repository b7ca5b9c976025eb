"""Variant spellings of names typed by people (problem 1).

Spellings are read into forms (tokens and initials without titles, roles and brackets). Equal forms belong together at
once. Other forms are blocked by the phonetic codes of their sorted tokens, compared within blocks by Jaro-Winkler and a
table of nicknames over the best assignment of their tokens, and accepted pairs are clustered by connected components.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import combinations
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from librarium.llm import mojibake
from librarium.session import checkpoint, spread

# Given names, each with its short forms.
NICKNAMES = """
abigail abby gail
alexander alex sandy sasha
amelia amy millie
andrew andy drew
anthony tony
barbara barb babs
beatrice bea trixie
benjamin ben benny
catherine cathy kate katie kitty
charles charlie chuck chas
christopher chris kit
clement clem
cornelia nell
daniel dan danny
david dave davy
deborah deb debbie
dolores lola
dominic dom nick
dorothea dora dorothy dot thea
edith edie
edward ed eddie ned ted teddy
eleanor ellie nell
elizabeth liz lizzie beth betty eliza betsy bess
ernest ernie
felix lix
frances fran fanny
francisco paco pancho
frederick fred freddie fritz
gregory greg
gustav gus
helen nell
henrietta hettie etta
henry harry hank
isabella bella izzy
jacob jake
james jim jimmy jamie
johannes hans
john jack johnny
jonathan jon
joseph joe joey
josephine jo josie
jose pepe
katherine kate kathy katie kitty kit
lawrence larry laurie
leonard len lenny
leopold leo poldi
lucinda lucy cindy
margaret maggie meg peggy daisy
martha patty
matilda tilly maud mattie
matthew matt
michael mike mick mickey
nathaniel nat nate
nicholas nick nicky
octavia tavy
patricia pat patty trish tricia
patrick pat paddy
peter pete
philip phil
prudence prue
quentin quin
ramona mona
rebecca becky becca
richard dick rick rich richie
robert bob bobby rob robbie bert
ronald ron ronnie
rupert bert
samuel sam sammy
sebastian seb
silvan sil
stephen steve
susannah sue susan susie
sylvia syl
tamara tammy
thaddeus thad tad
theodore ted teddy theo
theresa terry tess
thomas tom tommy
timothy tim
tobias toby
valentin val
victoria vicky tori
viola vi
walter walt wally
wilhelm willi
william bill billy will willie liam
winifred winnie freda
zachary zach zack
"""
# Abbreviations in names of organisations, and the words by which one is known.
ABBREVIATIONS = {
    "dept": "department", "inst": "institute", "soc": "society", "mus": "museum", "univ": "university", "uni": "university", "pr": "press", "assoc": "association",
    "assn": "association", "ass": "association", "acad": "academy", "bros": "brothers", "co": "company", "corp": "corporation", "inc": "incorporated", "ltd": "limited",
    "intl": "international", "int": "international", "natl": "national", "lib": "library", "pub": "public", "publ": "publishing", "rec": "records", "stud": "studies",
    "found": "foundation", "coll": "college", "gov": "government", "govt": "government", "comm": "committee", "cttee": "committee", "ctr": "center", "centre": "center",
}
ORGANISATION = {
    "department", "institute", "society", "museum", "university", "press", "association", "academy", "brothers", "company", "corporation", "international", "library", "college",
    "foundation", "committee", "center", "ministry", "office", "group", "publishing", "records", "studies", "council", "bureau", "federation", "union", "club", "school",
}
_FILL = {"the", "of", "and", "for", "der", "des", "de", "la", "du", "del", "et", "und", "y"}
# Traditional characters frequent in names, each above the simplified one. A part of the public tables only.
TRADITIONAL = "葉溫風龍陸謝蕭顧雲蘇硯書聽歸燈遠長無鶴張陳劉趙黃吳孫馬羅鄭許韓馮鄧鄒蔣賈閻錢湯盧龐畢賴譚廖萬賀龔嚴華蘭國東愛麗軍傑偉強鳳蓮豔慶曉興義榮貴寶學詩夢寧靜開關門問間陽陰難雙驚驕體頭顏飛魚鳥麥齊齡濤濱澤漢潔瑩瑤環現瓊畫異發盡聖聲職樂橋樹機權歡歲殘樓樸業極構標檔歷會傳優億儀價倫側偵備債傷傾僅從個來侶俠兒內兩冊"
SIMPLIFIED = "叶温风龙陆谢萧顾云苏砚书听归灯远长无鹤张陈刘赵黄吴孙马罗郑许韩冯邓邹蒋贾阎钱汤卢庞毕赖谭廖万贺龚严华兰国东爱丽军杰伟强凤莲艳庆晓兴义荣贵宝学诗梦宁静开关门问间阳阴难双惊骄体头颜飞鱼鸟麦齐龄涛滨泽汉洁莹瑶环现琼画异发尽圣声职乐桥树机权欢岁残楼朴业极构标档历会传优亿仪价伦侧侦备债伤倾仅从个来侣侠儿内两册"
_SIMPLE = {ord(a): b for a, b in zip(TRADITIONAL, SIMPLIFIED)}
_LETTERS = str.maketrans({"ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "ı": "i"})

_BRACKETS = re.compile(r"^\s*[\[(（【〔<《「](.*)[\])）】〕>》」]\s*$", re.S)
_ROLE_HEAD = re.compile(r"^\s*(?:by|author\s*[:：]|作者\s*[:：]|著者\s*[:：])\s*", re.I)
_ROLE_TAIL = re.compile(r"\s*[\[(（]\s*(?:author|ed|eds|editor|editors|translator|trans|hrsg|dir|coord|著|编|编著|译)\.?\s*[\])）]\s*$", re.I)
_ROLE_CJK = re.compile(r"\s*(?:编著|編著|主编|主編|著|编|編|译|譯)\s*$")
_TITLE_HEAD = re.compile(r"^\s*(?:(?:dr|prof|professor|mr|mrs|ms|sir|dame|herr|frau|rev)\b\.?\s+)+", re.I)
_TITLE_TAIL = re.compile(r"(?:,?\s+|,\s*)(?:ph\.?\s?d|m\.?d|d\.?phil|m\.?a|b\.?a|esq)\.?\s*$", re.I)
_CJK = re.compile(r"[⺀-鿿豈-﫿぀-ヿ가-힯]")


def _nicknames() -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for line in NICKNAMES.split("\n"):
        for short in (w := line.split())[1:]:
            out.setdefault(short, set()).add(w[0])
    return {k: frozenset(v) for k, v in out.items()}


NICKS = _nicknames()


def _lone(words: list[str], i: int) -> bool:
    """Whether the initial at i stands alone: not in "U. S. Office", nor as the German "und" in "Ahrens u. Co."."""
    return all(len(w) > 1 for w in words[max(i - 1, 0) : i] + words[i + 1 : i + 2]) and words[i + 1 : i + 2] not in (["company"], ["brothers"])


@lru_cache(maxsize=200_000)
def form(name: str) -> tuple[str, tuple[str, ...], tuple[str, ...]]:
    """(kind, tokens in sorted order, initials in order) of a spelling. kind: person, initials, organisation, ideographs or other."""
    t = unicodedata.normalize("NFKC", name)
    t = "".join(c for c in t if unicodedata.category(c) != "Cf")
    while True:
        before = t
        t = _ROLE_TAIL.sub("", _ROLE_HEAD.sub("", t))
        if m := _BRACKETS.match(t):
            t = m[1]
        t = _TITLE_TAIL.sub("", _TITLE_HEAD.sub("", t)).strip(" \t\r\n,;")
        if t == before:
            break
    if _CJK.search(t):
        k = re.sub(r"[\s·・]+", "", t)
        cut = _ROLE_CJK.sub("", k)
        k = (cut if len(cut) >= 2 else k).translate(_SIMPLE)
        return "ideographs", (k.casefold(),), ()
    t = "".join(c for c in unicodedata.normalize("NFD", t.casefold()) if not unicodedata.combining(c)).translate(_LETTERS)
    t = re.sub(r"['’`]", "", t).replace("&", " and ")
    words = re.findall(r"[^\W_]+", t)
    full = [ABBREVIATIONS.get(w, w) for w in words]
    if sum(w in ORGANISATION for w in full) >= 1 and len([w for w in full if w not in _FILL]) >= 2:
        full = ["university" if w == "u" and _lone(full, i) else w for i, w in enumerate(full)]
        return "organisation", tuple(sorted(w for w in full if w not in _FILL)), ()
    tokens = tuple(sorted(w for w in words if len(w) > 1))
    initials = tuple(w for w in words if len(w) == 1)
    kind = "person" if len(tokens) >= 2 else "initials" if len(tokens) == 1 and initials else "other"
    return kind, tokens, initials


_CLASS = str.maketrans("abcdefghijklmnopqrstuvwxyz", "0123012-022455012623-1-2-2")


@lru_cache(maxsize=200_000)
def code(token: str) -> str:
    """Phonetic code: classes of letters that sound alike, repeats once, vowels only at the start."""
    c = re.sub(r"[^0-6]", "", token.translate(_CLASS))
    c = re.sub(r"(.)\1+", r"\1", c)
    return c[:1] + c[1:].replace("0", "") if c else token[:1]


#: Of persons of so many names or fewer all parts of their names and all choices of full names are listed as keys. These
#: multiply with every name, so persons of more names are looked for by keys that only add up (codes of short forms merged,
#: single names that stay), which let through too much but leave nothing out, and each pair found is checked (meets, fits).
WHOLE = 5
#: Persons of more names list their choices of full names too, up to so many; those with more meet all others by merged codes.
CHOICES = 64


def full_names(token: str) -> set[str]:
    """What a name of a person may stand for: itself and, for a short form, each of its full names."""
    return {token, *NICKS.get(token, ())}


def _merged() -> dict[str, str]:
    """Each code of a short form or of one of its full names, with the code that stands for all that are linked to it so."""
    groups: dict[str, set[str]] = {}
    for short in NICKS:
        codes = {code(x) for x in full_names(short)}
        one = codes.union(*(groups.get(c, ()) for c in codes))
        groups.update(dict.fromkeys(one, one))
    return {c: min(g) for c, g in groups.items()}


MERGED = _merged()


def remains(options: set[str]) -> set[str]:
    """Code and length of a token, as any of its options, with at most one letter left out."""
    return {f"{code(y)}{len(y)}" for x in options for y in (x, *(x[:k] + x[k + 1 :] for k in range(len(x))))}


def many_choices(kind: str, tokens: tuple[str, ...]) -> bool:
    """Whether the choices of full names of a person are too many to be listed."""
    return kind == "person" and len(tokens) > WHOLE and prod(len({code(x) for x in full_names(w)}) for w in tokens) > CHOICES


def block_keys(kind: str, tokens: tuple[str, ...], merged: bool | None = None) -> set[str]:
    """Keys by which alike forms meet: the codes of all tokens but one, and code and length of that one with at most one letter left out.

    Two tokens one slip apart are equal once a letter is left out of one of them or of each, so forms that differ by a
    slip always share a key, and the length of what is left keeps apart most tokens that only sound alike. (Their codes may
    differ by two symbols: a consonant also parts two of one class.) A short form stands for its full names too. With
    `merged` codes (where the choices are too many, unless it is given) one code stands for all that short forms and full
    names have in common: two persons share a merged key whenever they share one of all choices listed, and `meets` says
    whether they do.
    """
    options = [full_names(x) if kind == "person" else {x} for x in tokens]
    codes = [{code(x) for x in o} for o in options]
    if many_choices(kind, tokens) if merged is None else merged:
        codes = [{MERGED.get(c, c) for c in own} for own in codes]
    out = set()
    for i, mine in enumerate(options):
        rest = [""]
        for j, other in enumerate(codes):
            if j != i:
                rest = [f"{r} {c}" for r in rest for c in other]
        rest = {" ".join(sorted(r.split())) for r in rest}
        out.update(f"{kind[0]}{len(tokens)}|{r}|{v}" for v in remains(mine) for r in rest)
    return out


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    hit_a, hit_b = [False] * n, [False] * m
    k = 0
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not hit_b[j] and b[j] == c:
                hit_a[i] = hit_b[j] = True
                k += 1
                break
    if not k:
        return 0.0
    x, y = [c for c, h in zip(a, hit_a) if h], [c for c, h in zip(b, hit_b) if h]
    moved = sum(p != q for p, q in zip(x, y)) / 2
    jaro = (k / n + k / m + (k - moved) / k) / 3
    same = 0
    while same < 4 and same < n and same < m and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def one_slip(a: str, b: str) -> bool:
    """Equal but for one letter put in, left out or changed, or two neighbours exchanged."""
    n, m = len(a), len(b)
    if abs(n - m) > 1 or a == b:
        return False
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    if n == m:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < n and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :] if n < m else a[i + 1 :] == b[i:]


#: Jaro-Winkler from which two tokens are one name typed twice, whatever parts them; and from which they are if a single
#: letter does: there the score falls with the length of the token, so it needs a bound of its own.
SIMILAR, SINGLE = 0.95, 0.8
#: A token that stands in more forms than this is an established name, not a slip, unless it is rare beside the other.
ESTABLISHED, BESIDE = 2, 0.05
#: Letters that a token needs for a slip to be told from another name.
LETTERS = 4


def slip(a: str, b: str, seen_a: int, seen_b: int) -> bool:
    """Whether two tokens are one name typed twice: Jaro-Winkler decides, of tokens of about one length of which one at least is rare."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < LETTERS or max(len(a), len(b)) < LETTERS + 1 or min(seen_a, seen_b) > max(ESTABLISHED, BESIDE * max(seen_a, seen_b)):
        return False
    return jaro_winkler(a, b) >= (SINGLE if one_slip(a, b) else SIMILAR)


def nickname(a: str, b: str) -> bool:
    return a in NICKS.get(b, ()) or b in NICKS.get(a, ()) or bool(NICKS.get(a, frozenset()) & NICKS.get(b, frozenset()))


def assigned(good: list[list[int]]) -> bool:
    """Whether each left item can have a right one of its own; good[i] lists those that suit i (augmenting paths)."""
    owner: dict[int, int] = {}

    def place(i: int, tried: set[int]) -> bool:
        for j in sorted(good[i], key=owner.__contains__):  # free ones first
            if j not in tried:
                tried.add(j)
                if j not in owner or place(owner[j], tried):
                    owner[j] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(good)))


def same_name(a: tuple[str, ...], ia: tuple[str, ...], b: tuple[str, ...], ib: tuple[str, ...], seen: dict[str, int], kind: str) -> bool:
    """Whether two forms of a kind mean the same: each token that differs has a partner that is a nickname or a slip of it, and no initials disagree."""
    if len(a) != len(b) or (ia and ib and ia != ib):
        return False
    x, y = list(a), list(b)
    for w in a:
        if w in y:
            x.remove(w)
            y.remove(w)
    return assigned([[j for j, v in enumerate(y) if (kind == "person" and nickname(w, v)) or slip(w, v, seen.get(w, 1), seen.get(v, 1))] for w in x])


def meets(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether two persons of equally many names would share a key if every choice of full names was listed.

    One name of each is left out, which have a remainder in common; the others pair off so that two of a pair have the code
    of a full name in common.
    """
    mine, other = [full_names(w) for w in a], [full_names(w) for w in b]
    codes = [{code(x) for x in o} for o in other]
    good = [[j for j, own in enumerate(codes) if not own.isdisjoint({code(x) for x in o})] for o in mine]
    single = [i for i, g in enumerate(good) if not g]  # without a partner, so only these can be left out
    if len(single) > 1:
        return False
    left = [remains(o) for o in other]
    for i in single or sorted(range(len(a)), key=lambda i: a[i] in b):
        for j in sorted(range(len(b)), key=lambda j: b[j] in a):
            if not left[j].isdisjoint(remains(mine[i])) and assigned([[x for x in g if x != j] for k, g in enumerate(good) if k != i]):
                return True
    return False


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of each component, for every node that has an edge.

    Labels start as the smallest neighbour; in each round every node takes the smallest label around it, then the label
    of its label, so chains shrink by half. A round is two shuffles of nodes; each is checkpointed. Rounds end when no
    label changes; the number of rounds grows with the logarithm of the longest chain.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("near")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("near")))
    both = checkpoint(both.filter("node <> near").distinct())
    labels = checkpoint(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("label")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("label").alias("least"))
        new = labels.join(around, "node").select("node", F.least("label", "least").alias("label"), F.col("label").alias("old"))
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = checkpoint(new.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "old"))
        if not new.filter("label <> old").limit(1).count():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")


_FORM = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("form", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("initials", T.ArrayType(T.StringType())),
])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(n, *form(n)) for n in batch.column(0).to_pylist()]
        cols = [[r[0] for r in rows], [f"{k[0]}|{' '.join(t)}|{' '.join(i)}" for _, k, t, i in rows], [r[1] for r in rows], [list(r[2]) for r in rows], [list(r[3]) for r in rows]]
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_FORM.names)


_KEYED = T.StructType([T.StructField("form", T.StringType()), T.StructField("block", T.StringType())])


def _blocks(batches: Iterator[pa.RecordBatch], keys: Callable[[str, tuple[str, ...]], Iterable[str]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        form_of, out = [], []
        for f, k, t in zip(*(c.to_pylist() for c in batch.columns)):
            ks = keys(k, tuple(t))
            form_of += [f] * len(ks)
            out += ks
        yield pa.RecordBatch.from_arrays([pa.array(form_of, pa.string()), pa.array(out, pa.string())], names=_KEYED.names)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _blocks(batches, block_keys)


def _many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _blocks(batches, lambda kind, tokens: block_keys(kind, tokens, True) if many_choices(kind, tokens) else ())


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _blocks(batches, lambda kind, tokens: () if many_choices(kind, tokens) else block_keys(kind, tokens, True))


def _accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of forms (with the number of forms each token stands in) that mean the same."""
    for batch in batches:
        a, b = [], []
        for fa, fb, sa, sb in zip(*(c.to_pylist() for c in batch.columns)):
            ka, ta, ia = fa.split("|")
            kb, tb, ib = fb.split("|")
            ta, tb = tuple(ta.split()), tuple(tb.split())
            seen = dict(zip(ta, sa)) | dict(zip(tb, sb))
            if ka == kb and same_name(ta, tuple(ia.split()), tb, tuple(ib.split()), seen, "person" if ka == "p" else "organisation") and (ka != "p" or len(ta) <= WHOLE or meets(ta, tb)):
                a.append(fa)
                b.append(fb)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])


def variants(df: DataFrame, column: str = "author", corpus: DataFrame | None = None) -> DataFrame:
    """(name, entity): every distinct spelling of `column` with the key of the person or organisation it means.

    * Spellings with equal forms are one entity: titles, roles, brackets, letter case, accents, order of the parts,
      spaces and traditional characters make no difference.
    * Forms of the same kind meet in blocks of phonetic codes and are accepted as `same_name` says.
    * A form with initials ("C. T. Zelen", "J. R. R. Tolkien", "G. Garcia Marquez") joins the entity that has its tokens
      and further names which begin with its initials, if there is exactly one; if several people fit, it stays apart.
    * Forms that differ only in a middle initial are two people; one without a middle initial joins them only if the
      others agree on it.

    Defined results: null, blank and garbled values (as problem 4 finds them, against `corpus`, a column text) are left
    out; values are compared exactly as stored, each distinct one once, so a value that a third of the rows share costs
    one comparison. Clusters are found from links between forms, never from pairs of all spellings.
    """
    names = df.select(F.col(column).alias("name")).filter("name IS NOT NULL AND trim(name) <> ''").distinct()
    names = checkpoint(names)
    broken = mojibake.search(names.withColumnRenamed("name", "value"), corpus if corpus is not None else names.withColumnRenamed("name", "text"))
    names = names.join(broken.select(F.col("value").alias("name")), "name", "left_anti")
    spelled = checkpoint(spread(names).mapInArrow(_forms, _FORM))
    forms = checkpoint(spelled.groupBy("form").agg(F.first("kind").alias("kind"), F.first("tokens").alias("tokens"), F.first("initials").alias("initials")))
    links = _links(forms)
    entity = connected_components(links)
    full = forms.join(entity, forms["form"] == entity["node"], "left").select("form", "kind", "tokens", "initials", F.coalesce("component", "form").alias("entity"), F.col("component").isNull().alias("alone"))
    full = checkpoint(full)
    joined = _initial_forms(full)
    named = full.join(joined, "form", "left").select("form", F.coalesce("joins", "entity").alias("entity"))
    return spelled.select("name", "form").join(named, "form").select("name", "entity")


def _links(forms: DataFrame) -> DataFrame:
    """Accepted pairs of forms."""
    whole = forms.filter(F.col("kind").isin("person", "organisation"))
    seen = whole.select(F.explode(F.array_distinct("tokens")).alias("token"), "kind", F.concat_ws(" ", "tokens").alias("all")).distinct().groupBy("token", "kind").agg(F.count(F.lit(1)).alias("n"))
    counts = whole.select("form", "kind", F.posexplode("tokens").alias("at", "token")).join(seen, ["token", "kind"]).groupBy("form").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("s"))
    counts = counts.select("form", F.col("s.n").alias("seen"))
    blocks = checkpoint(whole.select("form", "kind", "tokens").mapInArrow(_keyed, _KEYED))
    pairs = blocks.join(blocks.withColumnRenamed("form", "other"), "block").filter("form < other").select("form", "other")
    # persons whose choices are too many and those who have theirs listed
    long = whole.filter((F.col("kind") == "person") & (F.size("tokens") > WHOLE)).select("form", "kind", "tokens")
    mixed = long.mapInArrow(_many, _KEYED).join(long.mapInArrow(_few, _KEYED).withColumnRenamed("form", "other"), "block")
    pairs = pairs.unionByName(mixed.select(F.least("form", "other").alias("form"), F.greatest("form", "other").alias("other"))).distinct()
    pairs = pairs.join(counts, "form").join(counts.select(F.col("form").alias("other"), F.col("seen").alias("seen_b")), "other").select("form", "other", "seen", "seen_b")
    accepted = checkpoint(spread(pairs).mapInArrow(_accepted, T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])))
    # a form without a middle initial must not join people whose initials disagree
    middle = lambda c: F.nullif(F.substring_index(c, "|", -1), F.lit(""))
    both = accepted.unionByName(accepted.select(F.col("b").alias("a"), F.col("a").alias("b")))
    torn = both.filter(middle(F.col("a")).isNull() & middle(F.col("b")).isNotNull()).groupBy("a").agg(F.countDistinct(middle(F.col("b"))).alias("n")).filter("n > 1").select("a")
    bad = both.join(torn, "a", "left_semi").filter(middle(F.col("b")).isNotNull())
    bad = bad.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return accepted.join(bad, ["a", "b"], "left_anti")


def kept_parts(tokens: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], tuple[str, ...]]]:
    """(names that stay, names that become initials) in all ways a person's names may be shortened.

    Of more than WHOLE names only the ways that one of them becomes an initial or one stays; by the latter `_anchors` finds
    all short forms of two initials or more.
    """
    n = len(tokens)
    sizes = range(1, n) if n <= WHOLE else (1, n - 1)
    for size in sizes:
        for keep in combinations(range(n), size):
            yield tuple(tokens[i] for i in keep), tuple(tokens[i] for i in range(n) if i not in keep)


def listed(names: int, initials: int) -> bool:
    """Whether a short form of so many initials of a person of so many names is found by all names that stay, or else by one of them."""
    return names <= WHOLE or initials == 1


def first_letters(token: str) -> list[str]:
    """Initials of a name; a short form stands for its full names, so for their initials too."""
    return sorted({w[0] for w in full_names(token)})


def shortened(kind: str, initials: list[str], alone: bool) -> bool:
    """Whether a form may be a short form of another one."""
    return bool(initials) and (kind == "initials" or (kind == "person" and alone))


_SIDES = T.StructType([T.StructField(c, T.StringType()) for c in ("who", "kept", "firsts", "middle", "side")])


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short forms (side s, who = form) and persons (side p, who = entity) by the names that stay and the first letters of the others."""
    for batch in batches:
        out = set()
        for f, kind, tokens, initials, entity, alone in zip(*(c.to_pylist() for c in batch.columns)):
            if shortened(kind, initials, alone):
                for r in range(1, len(initials) + 1):
                    if listed(len(tokens) + r, r):
                        out.add((f, " ".join(tokens), "".join(sorted(initials[:r])), initials[r] if r < len(initials) else None, "s"))
            if kind == "person":
                for keep, gone in kept_parts(tuple(tokens)):
                    if listed(len(tokens), len(gone)):
                        letters = [""]
                        for w in gone:
                            letters = [x + c for x in letters for c in first_letters(w)]
                        out.update((entity, " ".join(keep), "".join(sorted(x)), initials[0] if initials else None, "p") for x in letters)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*sorted(out, key=repr)) if out else [[]] * 5)], names=_SIDES.names)


#: A person whose names may begin with more sets of letters than this is found by one name and the number of names alone.
SETS = 64


def letter_sets(tokens: tuple[str, ...]) -> set[str]:
    """The first letters that all names may have, each with its number; one empty set, which every short form looks for too, if there are more than SETS."""
    found = {()}
    for options in sorted(map(first_letters, tokens), key=len):
        found = {tuple(sorted((*x, c))) for x in found for c in options}
        if len(found) > SETS:
            return {""}
    return {"".join(f"{c}{n}" for c, n in Counter(x).items()) for x in found}


def anchors(tokens: tuple[str, ...]) -> set[str]:
    """Keys of a person of more than WHOLE names: each single name that may stay, with the number and first letters of all."""
    sets = letter_sets(tokens)
    return {f"{len(tokens)} {keep[0]} {x}" for keep, gone in kept_parts(tokens) if len(keep) == 1 for x in sets}


def short_anchors(tokens: tuple[str, ...], initials: tuple[str, ...]) -> set[str]:
    """Keys of a short form, of which it shares one with each person of more than WHOLE names that it may mean: its longest name, with all first letters and without."""
    out, stays = set(), max(tokens, key=lambda w: (len(w), w))
    for r in range(1, len(initials) + 1):
        n = len(tokens) + r
        if not listed(n, r):
            letters = Counter(sorted([w[0] for w in tokens] + list(initials[:r])))
            out.update((f"{n} {stays} {''.join(f'{c}{k}' for c, k in letters.items())}", f"{n} {stays} "))
    return out


def fits(tokens: tuple[str, ...], initials: tuple[str, ...], person: tuple[str, ...]) -> bool:
    """Whether a person's names are those of a short form and others that begin with its initials."""
    mine, other = Counter(tokens), Counter(person)
    if mine - other or len(tokens) + len(initials) != len(person):
        return False
    return assigned([[j for j, c in enumerate(initials) if c in first_letters(w)] for w in (other - mine).elements()])


_ANCHORS = T.StructType([T.StructField(c, T.StringType()) for c in ("who", "entity", "anchor")])


def _anchors(batches: Iterator[pa.RecordBatch], keys: Callable[[tuple[str, ...], tuple[str, ...]], Iterable[str]]) -> Iterator[pa.RecordBatch]:
    """Forms with their entity by the keys of their tokens and initials."""
    for batch in batches:
        out = [(f, entity, x) for f, tokens, initials, entity in zip(*(c.to_pylist() for c in batch.columns)) for x in keys(tuple(tokens), tuple(initials))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out) if out else [[]] * 3)], names=_ANCHORS.names)


def _short_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _anchors(batches, short_anchors)


def _long_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _anchors(batches, lambda tokens, initials: anchors(tokens))


_KNOWN = T.StructType([T.StructField(c, T.StringType()) for c in ("form", "entity", "middle", "has")])


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short forms with the entities of the persons they fit, and the middle initials of both."""
    for batch in batches:
        out = []
        for f, person, entity in zip(*(c.to_pylist() for c in batch.columns)):
            (_, ta, ia), (_, tb, ib) = ([x.split() for x in g.split("|")] for g in (f, person))
            r = len(tb) - len(ta)
            if fits(tuple(ta), tuple(ia[:r]), tuple(tb)):
                out.append((f, entity, ia[r] if r < len(ia) else None, ib[0] if ib else None))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out) if out else [[]] * 4)], names=_KNOWN.names)


def _known_by_anchors(full: DataFrame) -> DataFrame:
    """(form, entity, middle, has) of short forms of two initials or more and the persons of more than WHOLE names that they fit."""
    columns = ("form", "tokens", "initials", "entity")
    short = full.filter("kind = 'initials' OR (kind = 'person' AND alone)").filter((F.size("initials") > 1) & (F.size("tokens") + F.size("initials") > WHOLE))
    person = full.filter((F.col("kind") == "person") & (F.size("tokens") > WHOLE))
    short = short.select(*columns).mapInArrow(_short_side, _ANCHORS).select(F.col("who").alias("form"), "anchor")
    person = person.select(*columns).mapInArrow(_long_side, _ANCHORS).select(F.col("who").alias("person"), "entity", "anchor")
    return short.join(person, "anchor").select("form", "person", "entity").mapInArrow(_fitting, _KNOWN)


def _initial_forms(full: DataFrame) -> DataFrame:
    """(form, joins): forms with initials, and the one entity that fits them."""
    sides = checkpoint(full.select("form", "kind", "tokens", "initials", "entity", "alone").mapInArrow(_sides, _SIDES))
    short = sides.filter("side = 's'").select(F.col("who").alias("form"), "kept", "firsts", "middle")
    person = sides.filter("side = 'p'").select(F.col("who").alias("entity"), "kept", "firsts", F.col("middle").alias("has"))
    known = short.join(person, ["kept", "firsts"]).select("form", "entity", "middle", "has").unionByName(_known_by_anchors(full))
    known = known.groupBy("form", "entity").agg(F.max("middle").alias("middle"), F.max("has").alias("has"))
    # an entity known with another middle initial does not fit
    known = known.filter("middle IS NULL OR has IS NULL OR middle = has")
    one = known.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("any"), F.count_if(F.col("middle") == F.col("has")).alias("exact"), F.min(F.when(F.expr("middle = has"), F.col("entity"))).alias("same"))
    return one.select("form", F.when(F.col("exact") == 1, F.col("same")).when(F.col("n") == 1, F.col("any")).alias("joins")).filter("joins IS NOT NULL")


def pairs(named: DataFrame) -> DataFrame:
    """(name_a, name_b): all pairs of spellings of one entity, the result problem 1 asks for; its size is the work."""
    other = named.withColumnRenamed("name", "name_b")
    return named.withColumnRenamed("name", "name_a").join(other, "entity").filter("name_a < name_b").select("name_a", "name_b")
