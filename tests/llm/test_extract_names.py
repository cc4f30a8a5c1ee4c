"""Names and signs that say nothing about furniture keep the article's text."""
import pytest

from tabscope.llm import extract

LONG = "Rivers carry stones and sand from the hills down to the plain where they settle in layers over many thousand years. "


def text_of(spark, *bodies):
    df = spark.createDataFrame([(i, "u", f"<html><body><nav><a href=x>Home</a></nav><article>{b}</article></body></html>") for i, b in enumerate(bodies)],
                               "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in extract.extract(df).collect()}


def test_article_text_stays(spark):
    kept = [f'<div class="entry-header"><h1>The title kept</h1></div><p>{LONG}</p>',
            f'<section id="search-algorithms"><p>A section kept. {LONG}</p></section><p>{LONG}</p>',
            f'<h2 id="navigation">Heading kept</h2><p>{LONG}</p>',
            f'<p title="a hidden gem">Gem kept. {LONG}</p><p>{LONG}</p>',
            f'<p data-id="share-12">Data kept. {LONG}</p><p>{LONG}</p>',
            f'<p class="stock-share-price">Price kept. {LONG}</p><p>{LONG}</p>',
            f'<p>Where a<b it is kept. {LONG}</p><p>{LONG}</p>',
            f'<p data-role="menu">Role kept. {LONG}</p><p>{LONG}</p>']
    got = text_of(spark, *kept)
    words = ["The title kept", "A section kept.", "Heading kept", "Gem kept.", "Data kept.", "Price kept.", "Where a<b it is kept.", "Role kept."]
    for i, w in enumerate(words):
        assert w in got[i] and got[i].count("Rivers carry") >= 1, (i, got[i])


@pytest.mark.parametrize("element", ['<div hidden>gone</div>', '<div aria-hidden="true">gone</div>', '<div style="color:red; display : none">gone</div>',
                                     '<div class="share-buttons">gone</div>', '<div id="comments">gone</div>', '<p class="advert">gone</p>',
                                     "<div class='site-header-wrapper'>gone</div>", '<div role=navigation>gone</div>'])
def test_furniture_goes(spark, element):
    assert "gone" not in text_of(spark, f"<p>{LONG}</p>{element}<p>{LONG}</p>")[0]
