import datetime as dt

import plain_anchors as anchors
import pytest
from pyspark.sql import functions as F

from paperflow.operators import render


def hard(text):
    return sum(level == "hard" for level, _, _ in anchors.unanchored(text))


@pytest.mark.parametrize(
    "text",
    ["Spotřeba elektřiny klesla o 8 %, což znamená jednu zhasnutou žárovku v každém bytě.", "Z keřů zmizelo 15 % listů. Jinými slovy každý sedmý list chyběl.", "Hluku bylo víc 3krát (jako vedle rušné silnice v poledne).",
     "Nehod ubylo o 7 % – na každé křižovatce přibyl semafor.", "Knihovna eviduje 4 výpůjčky na sto obyvatel.", "Pokus trval 12 týdnů a voda měla 18 °C.", "Otevřeli 3. května, zavřeli 14. 9. 2019 večer.", "Viz https://priklad.cz/45 a signatura B52.",
     "Úroda vzrostla o 26 %, tedy zhruba o čtvrtinu obvyklé sklizně."],
)
def test_anchored(text):
    assert hard(text) == 0


@pytest.mark.parametrize("text", ["Plat vzrostl o 9 %.", "Slevu dostalo 14 promile nákupů a přeplatek 3 %.", "Motor běžel 2,5krát rychleji.", "Volnost stoupla o 4 procentní body.", "Prodali tři čtvrtiny jablek.", "Náklady činí 1 250 korun."])
def test_left_alone(text):
    assert hard(text) > 0


def test_what_is_found():
    assert [text for a, b, text in ((n.start, n.end, "-1 200,5 %"[: n.end - n.start]) for n in anchors.numbers("-1 200,5 % a x9 a 2024"))] == ["-1 200,5 %"]
    assert anchors.unanchored("Dotazník vyplnilo 40 starších dětí.") == [("warn", 18, 20)]


def test_no_text():
    assert anchors.unanchored(None) == anchors.unanchored("") == []


def test_day_pages(spark):
    day = dt.date(2026, 8, 19)
    rows = spark.createDataFrame([(day, 2, "B <b>", "javascript:x", ["A"], "one\n\ntwo", None), (day, 1, "A", "https://x.org/a", None, None, "short & late")], "date date, rank int, title string, url string, authors array<string>, summary string, notes string")
    html = render.day_pages(rows).first().html
    assert html.index(">A</a>") < html.index("B &lt;b&gt;") and "javascript" not in html and "19. srpna 2026" in html and "short &amp; late" in html and "<p>two</p>" in html
    assert render.day_pages(rows.limit(0)).count() == 0


def test_index_page(spark):
    rows = spark.createDataFrame([(dt.date(2026, 8, 18), "a", ["x"]), (dt.date(2026, 8, 19), "b", None)], "date date, category string, titles array<string>")
    html = render.index_page(rows, "en").first().html
    assert html.index("19. August") < html.index("18. August") and 'href="archive/2026-08-19.html"' in html
    assert "No days yet." in render.index_page(rows.limit(0), "en").first().html
    with pytest.raises(ValueError):
        render.index_page(rows, "xx")


def test_fill(spark):
    assert spark.range(1).select(render.fill("{a} {b}", a=F.lit("1")).alias("o")).first().o == "1 {b}"
