import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions import urls as U


def one(spark, f, *values):
    cols = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{c} string" for c in cols))
    return df.select(f(*[F.col(c) for c in cols]).alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [("hier :", "hier:"), ("Ende .", "Ende."), ("el\nectrolytic", "electrolytic"), ("Elektrolyt-\nkondensator", "Elektrolytkondensator"), ("winnt", "winnt"), ("Warte…", "Warte..."), ("a &amp; b", "A & b"), ("eins.\n\nzwei", "Eins. Zwei"), ("", ""), (None, None), ("  x  y ", "X y"), ("a &euro; &#228;&#x1F600; &nix; &amp;lt;", "A € ä😀 &nix; &lt;")],
)
def test_normalize(spark, given, want):
    assert one(spark, T.normalize, given) == want


@pytest.mark.parametrize("x", ["R1,R2", "U1/U2", "v2.1", "ESP32", "ABC-12/34", "USB 3.0", "hpcom-v11-6387f94d73599945123156"])
def test_technical(spark, x):
    assert one(spark, T.is_technical, x)


@pytest.mark.parametrize("x", ["3V", "5V", "3.3V", "100mA", "USB", "ESP", "LED", "GPIO", "www.a.de/b", "[display-posts category=\"x\"]", "git clone x", "1.5 %", ""])
def test_not_translatable(spark, x):
    assert not one(spark, T.is_translatable, x)


def test_language_hints(spark):
    assert one(spark, lambda t: T.already_in_target(t, F.lit("de"), F.lit("en")), "No module named 'serial'")
    assert not one(spark, lambda t: T.already_in_target(t, F.lit("de"), F.lit("en")), "Die Tür ist offen")


@pytest.mark.parametrize(
    ("source", "given", "want"),
    [("Herunterladen", "Download .", "Download"), ("PC World 115", "PC World", "PC World 115"), ("v2.1", "v2.1 2.1", "v2.1"), ("x", "2,2uFelectrolytic", "2,2uF electrolytic"), ("(Beschreibung)", "Description", "(Description)"), ("a", "⟦b⟧", "b"), ("v11 und 3", "v11 and 3", "v11 and 3"), ("a 11", "a 112", "a 112 11"), ("x", "2 3 2 3", "2 3"), ("x", "7 7 7", "7")],
)
def test_polish(spark, source, given, want):
    assert one(spark, T.polish, source, given) == want


def test_affix_split(spark):
    a = one(spark, T.affix_split, "(Beschreibung):")
    assert (a.prefix, a.core, a.suffix) == ("(", "Beschreibung", "):")
    assert one(spark, T.affix_split, "Beschreibung") is None and one(spark, T.affix_split, "...") is None


def test_mangled_tokens_come_back(spark):
    back = lambda t: T.unmask(t, F.array(F.lit("3,5 V"), F.lit("$1\\x")), "BTN")
    assert one(spark, back, "a __ btn 0 __ b ⟦BTN1⟧ c [BTN0]") == "a 3,5 V b $1\\x c 3,5 V"


def test_masks(spark):
    m = one(spark, lambda t: T.mask(t, T.LINK, "BTL"), "siehe https://a.de/b?c=1). Und www.x.org, oder a.de/!")
    assert m.originals == ["https://a.de/b?c=1", "www.x.org", "a.de/"] and m.masked.startswith("siehe __BTL0__). Und __BTL1__, oder __BTL2__")
    m = one(spark, T.mask_numbers, "3 V + 4 V + x")
    assert (m.masked, m.originals) == ("__BTN0____BTN2____BTN1____BTN3__x", ["3 V", "4 V", " + ", " + "])
    assert one(spark, lambda t: T.unmask(t, F.array(F.lit("3 V")), "BTN"), "a ⟦ 3 V ⟧ b [3 V]") == "a 3 V b 3 V"


def test_error_phrases(spark):
    assert one(spark, T.looks_english, "xNameError") is False and one(spark, T.looks_english, "ein NameError!") is True


def test_chunks(spark):
    assert one(spark, lambda t: T.chunks(t, 5), "  abcdefgh. ij ") == ["abcde", "ij"] and one(spark, T.chunks, " ") == []
    assert one(spark, lambda t: T.chunks(t, 12), "Eins zwei. Drei vier. Fünf.") == ["Eins zwei.", "Drei vier.", "Fünf."]
    assert one(spark, lambda t: T.chunks(t, 25), "Eins zwei. Drei vier. Fünf.") == ["Eins zwei. Drei vier.", "Fünf."]


def test_urls(spark):
    t = ("en", "fr")
    assert one(spark, lambda u: U.language_of(u, t, "de"), "https://x.de/en/a?b=1") == "en"
    assert one(spark, lambda u: U.without_language(u, t), "https://x.de/en/a?b=1") == "/a?b=1"
    assert one(spark, lambda u: U.url_for(u, F.lit("fr"), t, "de"), "/en/a?b=1") == "/fr/a/?b=1"
    assert one(spark, lambda u: U.is_excluded(u, ["/shop", "# x", "/"], t), "/en/shop/a")
    assert not one(spark, lambda u: U.is_excluded(u, ["/shop"], t), "/shopping")
