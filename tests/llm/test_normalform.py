import random
import unicodedata

from factloom.llm import normalform as N
from factloom.llm.normalform import in_form, normal_form


def test_mapping_is_free_of_conflicts():
    assert N.checked().conflicts() == [] and len(N.mapping()) > 5_000
    assert N.Transducer({"x": "\u00a0"}).conflicts() == ["x"]  # an output that is not in the form itself
    assert all(N._by_rule(key) == value for key, value in N.mapping().items())


def test_clusters_are_read_whole():
    cases = {
        "a\u0302\u0323": "\u1ead", "a\u200b\u0323\u200d\u0302b": "\u1eadb", "o\u0301\u031b\u0323": "\u1ee3\u0301", "\u1100\u200b\u1161\u11a8": "\uac01", "\uffa1\uffc2": "\uac00",
        "\uff76\uff9e": "\u30ac", "q\u0308\u0323": "q\u0323\u0308", "\u0435\u0301t": "\u00e9t", "\u202ea\u202c": "a", "e\u0301\u0435": "\u00e9e",
    }
    for text, form in cases.items():
        assert normal_form(text) == form, ascii(text)


def test_forms():
    cases = {
        "Ｂｒｉｄｇｅ": "Bridge", "é": "é", "a b　c d": "a b c d", "zero​width­⁠﻿": "zerowidth", "ﬁnd": "find",
        "Patriсk": "Patrick", "Κathеrine": "Katherine", "Натирепирн": "Натирепирн", "J‍о": "J" + "o", "𝐃im": "Dim", "a – b": "a – b", "й": "й",
        "и Рeter": "и Peter", "ậ": "ậ", "tab\there": "tab here", "": "", "plain": "plain", "½ kg": "1⁄2 kg",
    }
    for text, form in cases.items():
        assert normal_form(text) == form, text
        assert in_form(text) == (text == form), text
    assert normal_form(None) is None


def test_idempotent_and_equal_to_the_compatibility_form_without_look_alikes():
    rng = random.Random(3)
    pool = [chr(c) for r in ((0x20, 0x250), (0x300, 0x370), (0x1E00, 0x1F00), (0x2000, 0x2070), (0x2100, 0x2190), (0xFB00, 0xFB07), (0xFF00, 0xFF60), (0x3130, 0x3150)) for c in range(*r) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    for _ in range(3_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))
        form = normal_form(text)
        assert normal_form(form) == form, ascii(text)
        plain = "".join(" " if c in N.BREAKS else c for c in text)
        plain = "".join(c for c in unicodedata.normalize("NFKC", "".join(c for c in plain if not N._invisible(c))) if not N._invisible(c))
        if not any(N.mixed(w) for w in N._LETTERS.findall(unicodedata.normalize("NFKC", plain))):
            assert unicodedata.normalize("NFKC", form) == unicodedata.normalize("NFKC", plain), ascii(text)


def test_words_without_look_alikes_stay_mixed():
    assert normal_form("gж") == "gж" and not in_form("gж")


def test_column(spark):
    rows = [(1, "Ｂ", "old"), (2, None, "old"), (3, "", "old"), (4, "plain", "old"), (5, "é" * 200_000, "old"), (6, "gж", "old")]
    df = spark.createDataFrame(rows, "id long, text string, form string")
    got = {r["id"]: (r["form"], r["changed"]) for r in N.with_form(df, "text").collect()}
    assert got == {1: ("B", True), 2: (None, False), 3: ("", False), 4: ("plain", False), 5: ("é" * 200_000, False), 6: ("gж", True)}
    assert N.with_form(df.limit(0), "text").count() == 0
