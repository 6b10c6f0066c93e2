"""A seeded writer of labelled pages in many layouts, for training the content model."""

from __future__ import annotations

import random
import re

_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi xo zu an el in or us".split()


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n)).capitalize()


def _links(r: random.Random, n: int, item: str = "li") -> str:
    return "".join(f'<{item}><a href="/{k}">{_words(r, r.randint(1, 3))}</a></{item}>' for k in range(n))


def _named(r: random.Random, tag: str, names: tuple[str, ...]) -> str:
    """An opening tag that tells its role by its name, by its class, or by both."""
    name = r.choice(names)
    return r.choice((f'<{tag} class="{name}">', f'<{tag} id="{name}">', f'<div class="{name}">', f'<div class="x-{name} y">'))


def _close(opening: str) -> str:
    return "</" + re.match(r"<(\w+)", opening)[1] + ">"


def _page(r: random.Random) -> str:
    """A page; elements of content bear the attribute data-y, and so does a body that holds the text itself."""

    def paragraph() -> str:
        n = r.choice((2, 5, 12, 30, 60, 120))
        text = _words(r, n) + "."
        if r.random() < 0.2:
            text = f"<b>{text}<br>" if r.random() < 0.5 else f'{text} <a href="/r">{_words(r, 2)}</a> <em>{_words(r, 3)}</em>'
        return f"<p data-y>{text}" + ("</p>" if r.random() < 0.85 else "")

    def body() -> str:
        parts = [f"<h1 data-y>{_words(r, r.randint(2, 10))}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 2, 3, 5, 8, 12))):
            x = r.random()
            if x < 0.72:
                parts.append(paragraph())
            elif x < 0.8:
                parts.append(f"<h{(n := r.randint(2, 4))} data-y>{_words(r, r.randint(1, 6))}</h{n}>")
            elif x < 0.86:
                parts.append("<ul data-y>" + "".join(f"<li data-y>{_words(r, r.randint(2, 15))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.9:
                parts.append(f"<blockquote data-y><p data-y>{_words(r, 20)}</p></blockquote>")
            elif x < 0.92:
                parts.append(f"<table data-y><tr data-y><td data-y>{_words(r, 3)}</td><td data-y>{_words(r, 4)}</td></tr></table>")
            elif x < 0.94:
                parts.append(f"<pre data-y>{_words(r, 12)}</pre>")
            elif x < 0.96:
                parts.append(f"<figure data-y><img src=x><figcaption data-y>{_words(r, 6)}</figcaption></figure>")
            elif x < 0.98:
                parts.append(r.choice((f'<div class="ad">{_words(r, 9)}</div>', f'<aside class="related"><ul>{_links(r, 3)}</ul></aside>', f'<div class="share">{_links(r, 3, "span")}</div>', f'<div class="newsletter-signup"><p>{_words(r, 8)}</p><form><input></form></div>')))
            else:
                parts.append(f"<div data-y>{paragraph()}</div>")
        return "".join(parts)

    def menu() -> str:
        o = _named(r, "nav", ("nav", "menu", "main-menu", "breadcrumbs", "pagination", "tabs"))
        o = r.choice(("<nav>", o))
        return o + r.choice((f"<ul>{_links(r, r.randint(3, 8))}</ul>", _links(r, 4, "span"), f"<p>{_words(r, 2)}</p><ul>{_links(r, 4)}</ul>")) + _close(o)

    def header() -> str:
        o = r.choice(("<header>", _named(r, "header", ("header", "site-header", "masthead", "topbar", "banner"))))
        return o + f"<div>{_words(r, 2)}</div><p>{_words(r, r.randint(2, 12))}</p>" + (menu() if r.random() < 0.4 else "") + _close(o)

    def footer() -> str:
        o = r.choice(("<footer>", _named(r, "footer", ("footer", "site-footer", "copyright", "legal"))))
        return o + r.choice((f"&copy; {_words(r, 2)} &middot; {_words(r, 7)}", f"<p>{_words(r, r.randint(4, 25))}</p>", f"<ul>{_links(r, 4)}</ul><p>{_words(r, 12)}</p>")) + _close(o)

    def side() -> str:
        o = r.choice(("<aside>", _named(r, "aside", ("sidebar", "side", "widget", "related", "recommended", "popular-posts"))))
        return o + f"<h3>{_words(r, 2)}</h3>" + r.choice((f"<ul>{_links(r, 5)}</ul>", f"<p>{_words(r, r.randint(5, 40))}</p>", f"<p>{_words(r, 25)}</p><p>{_words(r, 9)}</p>")) + _close(o)

    def advert() -> str:
        o = r.choice(('<div class="ad">', '<div class="ads">', '<div id="ad-1">', '<div class="advert">', '<div class="sponsored">', '<aside class="ad-slot">', '<section class="advertisement">'))
        return "<!-- ad 1 -->" + o + r.choice((_words(r, r.randint(3, 14)) + ".", f"<p>{_words(r, r.randint(3, 30))}</p>")) + _close(o)

    def notice() -> str:
        o = r.choice(('<div class="cookie">', '<div id="cookie-notice">', '<div class="consent-banner">', '<div class="notice">', '<div class="alert">', '<div class="newsletter">', '<section class="subscribe">', '<div class="popup" role="dialog">'))
        return o + r.choice((f"<p>{_words(r, r.randint(4, 30))}</p><button>Ok</button>", _words(r, 12), f"<p>{_words(r, 10)}</p><form><p>{_words(r, 3)}</p><input></form>")) + _close(o)

    def comments() -> str:
        o = r.choice(('<section class="comments">', '<div id="comments">', '<div class="comment-list">', '<ol class="commentlist">', '<section id="disqus_thread">', '<div class="replies">'))
        one = r.choice(('<div class="comment">', '<li class="comment">', '<article class="comment">', "<div>"))
        return o + f"<h3>{_words(r, 2)}</h3>" + "".join(one + f"<p>{_words(r, r.randint(3, 40))}</p>" + _close(one) for _ in range(r.randint(1, 5))) + _close(o)

    def form() -> str:
        return f'<form action="/s"><label>{_words(r, 2)}</label><p>{_words(r, r.randint(2, 9))}</p><input name=q></form>'

    def hidden() -> str:
        o = r.choice(("<noscript>", "<object>", "<svg>", "<template>", "<button>"))
        return o + r.choice((f"<p>{_words(r, r.randint(3, 40))}</p>", _words(r, r.randint(2, 30)), f"<div><p>{_words(r, 25)}</p></div>")) + _close(o)

    o = r.choice(("<article data-y>", "<article data-y>", "<main data-y>", '<div class="content" data-y>', '<div id="main-content" data-y>', '<div class="post-body" data-y>', '<div class="article-text" data-y>', '<div class="entry" data-y>', "<div data-y>", '<section class="story" data-y>', "<main data-y><article data-y>", '<div class="page" data-y><div class="content" data-y>'))
    closing = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", o)))
    before = [f() for f in (menu, header, advert, notice, side, form) if r.random() < 0.45]
    after = [f() for f in (side, comments, advert, notice, menu, form) if r.random() < 0.35]
    inner_after = [f() for f in (comments, advert, side) if r.random() < 0.12]
    bare = r.random() < 0.35  # the text stands in the body itself, or in no body at all
    if bare:
        o = closing = ""
        if r.random() < 0.5:
            before, after, inner_after = before[:1] if r.random() < 0.5 else [], [], []
    if r.random() < 0.2:
        inner_after.append(hidden())
        before += [hidden()] * (r.random() < 0.3)
    if r.random() < 0.15:
        after.append(_words(r, r.randint(1, 12)))
    r.shuffle(before)
    r.shuffle(after)
    if r.random() < 0.85:
        after.append(footer())
    head = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{_words(r, 5)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
    end = "</body></html>" if r.random() < 0.8 else ""
    if bare:
        head = head.replace("<body>", "<body data-y>") if r.random() < 0.6 else "<html data-y>"
    return head + "".join(before) + o + body() + "".join(inner_after) + closing + "".join(after) + end


def labelled_pages(parse: type, n: int = 400, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """(html, whether each element is content), elements in the parser's order."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        source = _page(r)
        labels = ["data-y" in a for a in parse(source).attrs]
        plain = source.replace(" data-y", "")
        assert len(parse(plain).tag) == len(labels)
        out.append((plain, labels))
    return out
