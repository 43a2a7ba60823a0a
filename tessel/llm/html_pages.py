"""Labelled pages to train the extraction model on, made by rule from layouts and names in common use.

A labelled page marks elements with data-main="1" (main text, with all below)
or data-main="0" (not main text); the mark nearest above an element holds.
"""

from __future__ import annotations

import random

#: Elements and class or id names that hold no main text.
ASIDE = (
    "nav", "header", "footer", "aside", "form", "menu", "dialog", "noscript", "button", "select", "figcaption", "iframe",
    "div.nav", "div.navbar", "div.navigation", "div.menu", "ul.menu", "ul.nav", "div.topbar", "div.header", "div.masthead", "div.site-header",
    "div.footer", "div.site-footer", "div.colophon", "div.sidebar", "div.side-bar", "section.sidebar", "div.widget", "div.ad", "div.ads", "div.advert",
    "div.advertisement", "p.ad", "span.ad", "div.sponsored", "div.promo", "section.promo", "div.banner", "div.cookie", "div.cookie-notice", "div.cookie-banner",
    "div.consent", "div.gdpr", "div.notice", "p.notice", "div.alert", "div.popup", "div.modal", "div.overlay", "div.newsletter", "div.subscribe", "div.signup",
    "div.share", "div.social", "ul.share", "div.related", "section.related", "div.recommended", "div.more", "div.breadcrumb", "div.breadcrumbs", "ol.breadcrumb",
    "div.pagination", "div.pager", "section.comments", "div.comments", "div.comment", "ul.comments", "ol.comment-list", "section.comment-section", "div.disqus",
    "div.replies", "div.reviews", "div.login", "div.search", "div.tags", "div.meta", "p.copyright", "div.legal", "div.disclaimer", "div.toolbar", "section.ads",
    "aside.ad", "aside.related", "div#nav", "div#menu", "div#header", "div#footer", "div#sidebar", "div#ad", "div#comments", "div#cookie", "div#banner", "div#respond",
)
#: Elements and names that hold main text.
MAIN = (
    "article", "main", "section", "div", "div.content", "div#content", "div.main", "div#main", "div.post", "div.post-content", "div.entry", "div.entry-content",
    "div.article", "div.article-body", "div.article-content", "div.story", "div.story-body", "div.text", "div.body", "div.page", "section.content", "main#content",
    "article.post", "article.entry", "div.prose", "div.single", "div.container", "div.wrapper",
)
WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work".split()


#: What names are often prefixed with.
PREFIXES = ("", "", "", "", "user-", "site-", "top-", "global-", "block-", "js-", "my-", "l-")


def _open(name: str, main: int | None = None, prefix: str = "") -> tuple[str, str]:
    tag, attrs = name, ""
    for mark, attr in ((".", "class"), ("#", "id")):
        if mark in name:
            tag, value = name.split(mark)
            attrs = f' {attr}="{prefix}{value}"'
    return f"<{tag}{attrs}" + (f' data-main="{main}"' if main is not None else "") + ">", f"</{tag}>"


def _sentences(rng: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        words = rng.choices(WORDS, k=rng.randint(1, 22))
        out.append(" ".join(words).capitalize() + rng.choice(".....!?"))
    return " ".join(out)


def _link(rng: random.Random) -> str:
    return f'<a href="/{rng.choice(WORDS)}">{" ".join(rng.choices(WORDS, k=rng.randint(1, 4)))}</a>'


def _aside(rng: random.Random) -> str:
    start, end = _open(rng.choice(ASIDE), 0, rng.choice(PREFIXES))
    body = rng.choice((
        lambda: f"<h3>{rng.choice(WORDS)}</h3>" + "".join(f"<p>{_sentences(rng, rng.randint(1, 6))}</p>" for _ in range(rng.randint(1, 4))),
        lambda: "<ol>" + "".join(f'<li class="{rng.choice(("comment", "reply", "item", "entry"))}"><p>{_sentences(rng, rng.randint(1, 5))}</p></li>' for _ in range(rng.randint(1, 4))) + "</ol>",
        lambda: "<ul>" + "".join(f"<li>{_link(rng)}</li>" for _ in range(rng.randint(2, 8))) + "</ul>",
        lambda: " ".join(_link(rng) for _ in range(rng.randint(1, 6))),
        lambda: _sentences(rng, rng.randint(1, 3)),
        lambda: f"<p>{_sentences(rng, rng.randint(1, 4))}</p>",
        lambda: "".join(f"<div><b>{rng.choice(WORDS)}</b><p>{_sentences(rng, rng.randint(1, 4))}</p></div>" for _ in range(rng.randint(1, 4))),
        lambda: f"<h3>{rng.choice(WORDS)}</h3><p>{_sentences(rng, 1)}</p><label>{rng.choice(WORDS)}</label><input><button>{rng.choice(WORDS)}</button>",
        lambda: f"&copy; {rng.choice(WORDS)}.example &middot; {_sentences(rng, 1)}",
    ))()
    return start + body + end


def _block(rng: random.Random) -> str:
    return rng.choice((
        *(4 * [lambda: f"<p>{_sentences(rng, rng.randint(1, 8))}</p>"]),
        lambda: f"<p>{rng.choice(WORDS).capitalize()}.</p>",
        lambda: f"<p>{_link(rng)}</p>",
        lambda: f"<p><b>{_sentences(rng, 3)}<br><p>{_sentences(rng, 2)}</p>",
        lambda: f"<p>{_sentences(rng, 1)} {_link(rng)} {_sentences(rng, 1)}</p>",
        lambda: f"<h2>{rng.choice(WORDS)} {rng.choice(WORDS)}</h2>",
        lambda: "<ul>" + "".join(f"<li>{_sentences(rng, 1)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>",
        lambda: f"<blockquote><p>{_sentences(rng, 2)}</p></blockquote>",
        lambda: f"<pre>{rng.choice(WORDS)} = {rng.randint(0, 99)}</pre>",
        lambda: f"<table><tr><td>{rng.choice(WORDS)}</td><td>{rng.randint(0, 99)}</td></tr></table>",
        lambda: f"<div>{_sentences(rng, 3)}</div>",
        lambda: f"<p>{' | '.join(rng.choices(WORDS, k=rng.randint(3, 20)))}.</p>",
    ))()


def labelled_pages(n: int = 1500, seed: int = 7) -> list[str]:
    rng, pages = random.Random(seed), []
    for _ in range(n):
        aside = lambda most: "".join(_aside(rng) for _ in range(rng.randint(0, most)))
        start, end = _open(rng.choice(rng.choice((MAIN, MAIN, ("article", "main"), ("div", "section", "article")))), 1)
        heading = rng.choice(("", f"<h1>{_sentences(rng, 1)}</h1>"))
        inside = heading + "".join(_aside(rng) if rng.random() < 0.2 else _block(rng) for _ in range(rng.randint(1, 14)))
        if rng.random() < 0.25:
            inside = f"<div>{inside}</div>"
        if rng.random() < 0.15:  # text right under the body
            start, end, inside = "", "", "".join(f'<p data-main="1">{_sentences(rng, rng.randint(1, 6))}</p>' for _ in range(rng.randint(1, 6)))
        outer = rng.choice((("", ""), ("<div>", "</div>"), ('<div class="wrapper">', "</div>"), ('<div id="page">', "</div>"), ('<div class="container">', "</div>")))
        pages.append(f'<html><head><title>{rng.choice(WORDS)}</title></head><body data-main="0">{aside(4)}{outer[0]}{aside(1)}{start}{inside}{end}{aside(2)}{outer[1]}{aside(4)}</body></html>')
    return pages
