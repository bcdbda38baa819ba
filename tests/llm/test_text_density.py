import pytest

from studylake.llm import text_density as T
from tests.llm.helpers import empty

LONG = "This sentence is long enough to look like the text of an article, and not like a menu."


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<html></html>", ""), ("plain &amp; simple", "plain & simple"),
    (f"<body><nav><a href=x>Home</a></nav><article><h1>T&eacute;</h1><p><b>{LONG}<br><p>two\n  three</article><footer>F</footer>", f"Té\n{LONG}\ntwo three"),
    (f"<div id=sidebar>{LONG}</div><main><p>{LONG}</p><form>f<input></form><ul><li>a<li>b</ul><script>x<p></script></main>", f"{LONG}\na\nb"),
    (f"<header><h1>Site</h1></header><article><header><h1>Head</h1></header><p>{LONG}</p><div class='comments'><p>{LONG}</p></div></article>", f"Head\n{LONG}"),
    (f"<div><p>{LONG}</p>tail<p>{LONG}</p></div><div class=cookie-notice><p>{LONG}</p></div>", f"{LONG}\ntail\n{LONG}"),
    (f"<article><p>{LONG}</p></article><p cut", LONG),
    (f"<article><p>{LONG}</p></article></div></span></p>", LONG),
    (f"<div class=ad>{LONG}{LONG}</div><article><p>Short.</p></article>", "Short."),
    (f"<article><table><tr><td>a<td>b<tr><td>{LONG}</table></article>", f"a b\n{LONG}"),
])
def test_pages(html, text):
    assert T.extract(html) == text


def test_menu_without_a_name_loses_to_the_text():
    menu = "".join(f"<li><a href=/{i}>Topic number {i} of the site</a></li>" for i in range(30))
    assert T.extract(f"<body><div><ul>{menu}</ul></div><div><p>{LONG}</p><p>{LONG}</p></div></body>") == f"{LONG}\n{LONG}"


def test_deep_and_large_pages():
    assert T.extract("<div>" * 20_000 + LONG + "</div>" * 20_000) == LONG
    assert T.extract("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>").count("\n") == 4999
    assert T.extract("</x>" * 20_000 + LONG) == LONG


def test_frame(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x"), (1, "u", f"<article><p>{LONG}</p></article>", "x"), (None, None, None, None)]
    got = T.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", LONG), ("1", LONG), ("None", "")]
    assert T.main_text(empty(spark, "page_id long, html string")).collect() == []
