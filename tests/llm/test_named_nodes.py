"""Words of a class or id do not take real content away."""

import pytest

from studylake.llm import text_density as T

LONG = "This sentence is long enough to look like the text of an article, and not like a menu."
LINKS = "".join(f"<li><a href=/{i}>Another article {i}</a></li>" for i in range(9))


@pytest.mark.parametrize("html, text", [
    (f"<body><div class='content no-sidebar'><p>{LONG}</p><p>{LONG}</p></div></body>", f"{LONG}\n{LONG}"),
    (f"<body><div class='has-sidebar'><div class=sidebar>{LINKS}</div><p>{LONG}</p><p>{LONG}</p></div></body>", f"{LONG}\n{LONG}"),
    (f"<body><div class='social-page'><p>{LONG}</p><p>{LONG}</p></div></body>", f"{LONG}\n{LONG}"),
    (f"<body><div id=comments><p>{LONG}</p></div></body>", LONG),
    *[(f"<article><h2 id={i}>Heading</h2><p>{LONG}</p></article>", f"Heading\n{LONG}") for i in ("related-work", "skip-connections", "social-effects", "widget-design", "comments")],
    (f"<article><p>{LONG}</p><section id=related-work><h2>Related work</h2><p id=social-effects>{LONG}</p></section></article>", f"{LONG}\nRelated work\n{LONG}"),
    # A page in a form, names of topics, short blocks beside the dense one, labels without a control.
    (f"<body><form id=aspnetForm><input type=hidden><div><p>{LONG}</p><p>{LONG}</p></div></form></body>", f"{LONG}\n{LONG}"),
    (f"<body><form><article><p>{LONG}</p></article></form></body>", LONG),
    (f"<article><p class='share-price'>The share price fell by ten.</p><p>{LONG}</p></article>", f"The share price fell by ten.\n{LONG}"),
    (f"<article><p>{LONG}</p><section class='related-work'><h2>Work</h2><p>{LONG}</p></section></article>", f"{LONG}\nWork\n{LONG}"),
    (f"<div><h1>Title</h1><div>{f'<p>{LONG}</p>' * 4}</div><p>End.</p></div>", f"Title\n{LONG}\n{LONG}\n{LONG}\n{LONG}\nEnd."),
    (f"<body><h1>Title</h1><div><div>{f'<p>{LONG}</p>' * 4}</div></div><p>End.</p></body>", f"Title\n{LONG}\n{LONG}\n{LONG}\n{LONG}\nEnd."),
    (f"<article><p><label>Note:</label> {LONG}</p></article>", f"Note: {LONG}"),
    # These still go.
    (f"<body><h1>Site</h1><div><h1>Title</h1>{f'<p>{LONG}</p>' * 4}</div><ul>{LINKS}</ul></body>", f"Title\n{LONG}\n{LONG}\n{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><form><label for=a>Name</label><input id=a><p>Leave your name</p></form></article>", LONG),
    (f"<article><p>{LONG}</p><div class='article-comments'><p>{LONG}</p></div><div class='ad-slot'><p>{LONG}</p></div></article>", LONG),
    (f"<article><p>{LONG}</p><label>Mail</label><input></article>", LONG),
    (f"<article><p>{LONG}</p><section id=comments><p>{LONG}</p></section></article>", LONG),
    (f"<article><p>{LONG}</p><section id=related-articles><ul>{LINKS}</ul></section></article>", LONG),
    (f"<div class=post><p>{LONG}</p></div><div id=comments><p>{LONG}</p><p>{LONG}</p></div>", LONG),
    (f"<div class=sidebar><p>{LONG}</p><p>{LONG}</p></div><main><p>{LONG}</p></main>", LONG),
])
def test_pages(html, text):
    assert T.extract(html) == text
