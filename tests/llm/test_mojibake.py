import pytest

from librarium.llm import mojibake as M

CLEAN = [
    "José Chornos", "Renée Sasaem", "François Dicibiarn", "Günther Chelbeldiald", "Hélène Serkaeng", "Mónica Brevoldus", "Zoë Kemang", "Käthe Rudiath", "Björn Pothen", "Søren Vurner", "Éditions Crête-Bleue", "Königswehr Verlag",
    "Marrow’s Library", "Fennick—Oade", "Ediciones Pequeña Bahía", "Librería del Otoño Último", "白夜书局", "青石渡出版社", "秋水阁", "长灯文库", "老城遗梦", "云海旧账", "CORAÇÃO DE", "SÃO PAULO", "Старая книга", "Верхняя дорога",
    "Die Höhle von Fader", "Lámpara última", "The Road", "Tom & Ann", "Íñigo Kifern", "Ángela Dremback", "Thérèse Baelbaesith", "Grüne Straße über",
]


@pytest.fixture(scope="module")
def model():
    pairs = {}
    for t in CLEAN * 40:
        t = f"\x02{t}\x02"
        for p in map(str.__add__, t, t[1:]):
            pairs[p] = pairs.get(p, 0) + 1
    return M.Model(pairs)


@pytest.mark.parametrize("text", CLEAN)
def test_clean_values_stay(model, text):
    assert M.restore(text, model) == (False, text, False)


@pytest.mark.parametrize("read", ["cp1252", "latin_1", "cp1251", "mac_roman", "cp437", "gb18030"])
def test_round_trip_of_utf8(model, read):
    back = 0
    for t in CLEAN:
        if t.isascii():
            continue
        try:
            bad = t.encode("utf_8").decode(read)
        except UnicodeDecodeError:
            continue
        garbled, best, ok = M.restore(bad, model)
        assert garbled, (t, bad)
        back += best == t and ok
    assert back >= 8


def test_other_chains(model):
    once = lambda t, w, r: t.encode(w).decode(r)
    for t, bad in [
        ("Renée Sasaem", once(once("Renée Sasaem", "utf_8", "cp1252"), "utf_8", "cp1252")), ("白夜书局", once("白夜书局", "gb18030", "latin_1")), ("Mónica Brevoldus", once("Mónica Brevoldus", "cp1252", "cp437")),
        ("Marrow’s Library", "Marrow&rsquo;s Library"), ("Königswehr Verlag", "K&#246;nigswehr Verlag"), ("Käthe Rudiath", once("Käthe Rudiath", "cp1252", "mac_roman")),
    ]:
        assert M.restore(bad, model) == (True, t, True), bad
    assert M.restore("Éditions " + once("Crête-Bleue", "utf_8", "cp1252"), model)[1] == "Éditions Crête-Bleue"  # in part
    assert M.restore("Ren�e Sasaem", model)[::2] == (True, False)  # beyond recovery


def test_frame(spark):
    rows = [(i, t, None) for i, t in enumerate(CLEAN * 30)] + [(9000, "RenÃ©e Sasaem", ""), (9001, None, None), (9002, "Ren�e", "x" * 50_000 + "Ã©"), (9000, "RenÃ©e Sasaem", "")]
    df = spark.createDataFrame(rows, "meta_id LONG, title STRING, author STRING").selectExpr("*", "1 AS value", "2 AS field", "3 AS restored")
    got = sorted((r.meta_id, r.field, r.recovered) for r in M.garbled(df, ["title", "author"]).collect())
    assert got == [(9000, "title", True), (9000, "title", True), (9002, "author", True), (9002, "title", False)]
    assert M.garbled(df.limit(0), ["title"]).count() == 0


def test_words_are_restored_one_by_one(model):
    once = lambda t, r: t.encode("utf_8").decode(r)
    bad = f"{once('Renée', 'cp1252')} K�nig {once('Günther', 'mac_roman')} {once(once('Hélène', 'cp1252'), 'cp1252')} 白夜"
    assert M.restore(bad, model) == (True, "Renée K�nig Günther Hélène 白夜", False)
    deep = "Zoë"
    for _ in range(5):  # no bound on the number of misreadings
        deep = once(deep, "latin_1")
    assert M.restore(deep, model)[1] == "Zoë"


def test_best_of_a_word_is_the_best_of_all_reachable(model):
    """Against a search that visits everything reachable in falling order of cost."""
    for t in ["Renée", "Käthe", "白夜书局"]:
        for read in ("cp1252", "mac_roman", "gb18030", "cp437"):
            try:
                bad = t.encode("utf_8").decode(read)
            except UnicodeDecodeError:
                continue
            best, seen, todo = (model.cost(f"\x02{bad}\x02"), bad), {bad}, [(bad, 0, model.cost(f"\x02{bad}\x02"))]
            while todo:
                w, depth, have = todo.pop()
                for nxt in M.steps(w):
                    c = model.cost(f"\x02{nxt}\x02") + M.FURTHER * depth
                    if c < have and (nxt, depth) not in seen:
                        seen.add((nxt, depth))
                        todo.append((nxt, depth + 1, c))
                        if M._printable(nxt) and M._keeps_ascii(bad, nxt):
                            best = min(best, (c, nxt))
            assert M.restore_word(bad, "\x02", "\x02", model)[0] == best[1]
