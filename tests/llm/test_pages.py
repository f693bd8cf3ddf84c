"""Main text of hand-written pages: layouts, marks that mislead, broken markup."""

import pytest

from tracelens.llm import html_text

A = "The river rose by two metres in a single night, and the lower town was under water before anyone had woken up."
B = "By noon the fire brigade had brought forty families to the school on the hill, where they were given soup and dry clothes."
C = "Nobody knows yet when the bridge will be open again, but the mayor hopes that it won't take longer than the spring."
ART = f"{A} {B} {C}"
BODY = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
MENU = '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul>'
NOTE = "We use cookies and similar methods in order to make this site better, and by staying here you agree to that use of them."
TALK = "I was there and it was much worse than you write here, the water stood at the second floor of our house that morning."

PAGES = {
    "plain paragraphs": (f"<html><body>{BODY}</body></html>", ART),
    "article element": (f"<body><header>{MENU}</header><article><h1>The flood</h1>{BODY}</article><footer>© Gazette</footer></body>", f"The flood {ART}"),
    "form around the page": (f'<body><form id="aspnetForm" method="post"><div class="menu">{MENU}</div><h1>The flood</h1>{BODY}<input type="hidden"></form></body>', f"The flood {ART}"),
    "form around the page, no headline": (f'<body><form id="aspnetForm">{BODY}</form></body>', ART),
    "content with sidebar": (f'<div class="content-with-sidebar">{BODY}</div><div class="sidebar"><p>{NOTE}</p></div>', ART),
    "no sidebar": (f'<main class="no-sidebar">{BODY}</main>', ART),
    "has sidebar on a wrapper": (f'<div class="has-sidebar layout"><div class="main">{BODY}</div></div>', ART),
    "comments enabled": (f'<article class="post comments-enabled">{BODY}</article>', ART),
    "an article on logging in": (f'<article id="how-to-login">{BODY}</article>', ART),
    "market share": (f'<section class="market-share">{BODY}</section>', ART),
    "cookie recipe": (f'<div class="cookie-recipe">{BODY}</div>', ART),
    "unclosed drawing": (f'<body><div class="logo"><svg viewBox="0 0 1 1"><path d="M0"/></div><article>{BODY}</article></body>', ART),
    "unclosed drawing in the body": (f'<body><svg><path d="M0"><article>{BODY}</article></body>', ART),
    "drawing with words": (f"<article><p>{A} <svg><title>icon</title><text>up</text></svg></p><p>{B}</p><p>{C}</p></article>", ART),
    "unclosed text area": (f"<article><p>{A}</p><textarea>your text<p>{B}</p><p>{C}</p></article>", ART),
    "unclosed text area before a closed one": (f"<body><div><textarea>one</div><article>{BODY}</article><div><textarea>two</textarea></div></body>", ART),
    "formula in a sentence": ("<article><p>It holds that <math><mi>a</mi><mo>&lt;</mo><mi>b</mi></math> for all such numbers, as the reader will easily see from the first lemma above.</p></article>", "It holds that a<b for all such numbers, as the reader will easily see from the first lemma above."),
    "annotated formula": ("<article><p>We call <math><mi>x</mi><annotation encoding=t>\\x</annotation></math> the root of the equation, which has no other one between zero and one.</p></article>", "We call x the root of the equation, which has no other one between zero and one."),
    "table layout": (f'<table><tr><td class="nav">{MENU}</td><td><h1>The flood</h1>{BODY}</td></tr></table>', f"The flood {ART}"),
    "list article": (f"<article><h1>Three things</h1><ol><li>{A}</li><li>{B}</li><li>{C}</li></ol></article>", f"Three things {ART}"),
    "list without article": (f'<div class="nav">{MENU}</div><div><h2>Three things</h2><ul><li>{A}</li><li>{B}</li><li>{C}</li></ul></div>', f"Three things {ART}"),
    "readers' comments": (f'<article>{BODY}</article><section id="comments"><h3>Comments</h3><p>{TALK}</p><p>{TALK} Yes.</p></section>', ART),
    "more comments than article": (f'<article><h1>The flood</h1>{BODY}</article><div class="comment-list">' + f'<article class="comment"><p>{TALK}</p></article>' * 8 + "</div>", f"The flood {ART}"),
    "comment form": (f'<article>{BODY}</article><form class="comment-form"><label>Name</label><p>{TALK}</p><textarea></textarea><button>Send</button></form>', ART),
    "cookie notice": (f'<div id="cookie-notice"><p>{NOTE}</p></div><div class="content">{BODY}</div>', ART),
    "notice between paragraphs": (f'<div class="entry"><p>{A}</p><div class="newsletter-signup"><p>Subscribe to our weekly letter and never miss a story again, it is free of charge.</p></div><p>{B}</p><p>{C}</p></div>', ART),
    "advert between paragraphs": (f'<article><p>{A}</p><div class="ad-slot">Buy the best boots in town, now at half the price, only this week.</div><p>{B}</p><p>{C}</p></article>', ART),
    "related stories": (f'<article>{BODY}</article><aside><h3>More</h3><ul><li><a href=1>Storm over the coast</a></li><li><a href=2>Snow in May</a></li></ul></aside>', ART),
    "related by class": (f'<div class="post">{BODY}</div><div class="related-posts"><p>Last year a storm took the roof off the town hall, read all about it in our long report.</p></div>', ART),
    "short paragraph in an article": (f"<article><p>{A}</p><p>Yes.</p><p>{B}</p><p>{C}</p></article>", f"{A} Yes. {B} {C}"),
    "nested menus": (f'<nav><div><div>{MENU}<p>{NOTE}</p></div></div></nav><div id="main">{BODY}</div>', ART),
    "site footer": (f'<div class="content">{BODY}</div><div class="site-footer"><p>Published by the Gazette, all rights reserved, no part may be copied without our leave in writing.</p></div>', ART),
    "hidden words": (f'<article><p>{A}<span style="display:none"> not shown</span></p><p>{B}</p><div hidden>{NOTE}</div><p>{C}</p></article>', ART),
    "scripts and styles": (f'<script>document.write("<p>no</p>")</script><style>p{{x:y}}</style><article>{BODY}</article><noscript>Turn it on</noscript>', ART),
    "unclosed paragraphs": (f"<body><div id=content><h2>The flood</h2><p>{A}<p>{B}<p>{C}</div><div class=footer>© 2001", f"The flood {ART}"),
    "quotation and figure": (f"<article><p>{A}</p><blockquote><p>{B}</p></blockquote><figure><img src=x><figcaption>The bridge</figcaption></figure><p>{C}</p></article>", f"{A} {B} The bridge {C}"),
    "code references": ("<article><p>Caf&eacute; &amp; &#66;ar &lt;b&gt; stand here, and &nbsp; the rest of it is only there to make a sentence.</p></article>", "Café & Bar <b> stand here, and the rest of it is only there to make a sentence."),
    "share buttons": (f'<article><h1>The flood</h1><div class="share-buttons"><a href=f>Share</a><a href=t>Post</a></div>{BODY}</article>', f"The flood {ART}"),
    "unclosed menu": (f"<body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul><h1>The flood</h1>{BODY}</body>", f"The flood {ART}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert html_text.main_text(page) == want


def test_many_unclosed_raw_elements_take_linear_time():
    page = "<div><textarea>x<video>" * 20_000 + f"<article>{BODY}</article>"
    assert html_text.main_text(page).endswith(C)
