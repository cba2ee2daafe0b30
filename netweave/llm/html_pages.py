"""Made-up pages with known main text, which the block labeller is trained on.

Every block of text starts with a mark that tells whether it belongs to the
article. Words are random, so only place, path and shape tell blocks apart.
"""

from __future__ import annotations

import random

KEEP, DROP = "\x01", "\x02"
_SOUNDS = "a e i o u ba be ch de en er es ga ha in ing ion ka la le lo ma men mi na ne nt on or ou pa qu ra re ri ro sa se sh st ta te th ti to tion un ver vi zu é ü ñ".split()
_STYLES = (
    dict(container=("<article>", "</article>"), weight=6), dict(container=("<main>", "</main>"), weight=2),
    dict(container=('<main id="main"><article class="post">', "</article></main>"), weight=2),
    dict(container=('<div class="content">', "</div>"), weight=2), dict(container=('<div id="content"><div class="entry">', "</div></div>"), weight=1),
    dict(container=('<div class="post-body">', "</div>"), weight=1), dict(container=('<section class="story">', "</section>"), weight=1),
    dict(container=('<div class="article-text">', "</div>"), weight=1), dict(container=('<div id="main"><div>', "</div></div>"), weight=1),
    dict(container=('<div role="main">', "</div>"), weight=1), dict(container=("<div>", "</div>"), weight=2), dict(container=("", ""), weight=1),
    dict(container=("<table><tr><td>", "</td></tr></table>"), weight=1),
)


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.stock = ["".join(self.r.choices(_SOUNDS, k=self.r.randint(1, 4))) for _ in range(300)]

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = r.choices(self.stock, k=r.randint(low, high))
        shape = r.random()
        if shape < 0.08:
            out = [w + " |" for w in out]
        elif shape < 0.12:
            out = [w.upper() + "!!" for w in out]
        elif shape < 0.16:
            out = [w + r.choice(["%%%", "***", "$$$", "###"]) for w in out]
        else:
            out = [w + r.choice([".", ",", "", "", "", "", ""]) for w in out]
            out[0] = out[0].capitalize()
            out[-1] += "."
        if r.random() < 0.1:
            out.insert(r.randrange(len(out) + 1), r.choice(["&amp;", "&quot;x&quot;", "2024", "a@b.org", "&copy;", "+49 30 1234"]))
        return " ".join(out)

    def prose(self, mark: str, low: int = 1, high: int = 90) -> str:
        r = self.r
        text = self.words(low, r.choice([max(low, 3), max(low, 12), high, high]))
        kind = r.random()
        if kind < 0.12:
            text = f"<b>{text}<br>"
        elif kind < 0.2:
            text = f'{text} <a href="/{r.randrange(99)}">{self.words(1, 3)}</a> {self.words(1, 8)}'
        elif kind < 0.26:
            text = f"<em>{text}</em> {self.words(1, 5)}"
        elif kind < 0.3:
            inside = self.pick('<svg><path d="M0 0"/></svg>', "<script>var x = 1;</script>", "<noscript>off</noscript>", f"<x-term>{self.words(1, 2)}</x-term>", f"<abbr>{self.words(1, 1)}</abbr>")
            text = f"{text} {inside} {self.words(1, 5)}"
        return mark + text

    def links(self, mark: str, tag: str = "li", low: int = 2, high: int = 9) -> str:
        return "".join(f'<{tag}><a href="/{self.r.randrange(999)}">{mark}{self.words(1, 1).rstrip(".") if self.r.random() < 0.6 else self.words(1, 6)}</a></{tag}>' for _ in range(self.r.randint(low, high)))

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def junk(self) -> str:
        """A part that is no main text and may stand anywhere."""
        d, kind = DROP, self.r.randrange(6)
        if kind <= 1:
            name = self.pick("ad", "ads", "ad-slot", "advert", "advertisement", "sponsored", "promo", "banner", "adbox", "sponsor")
            return self.pick(f'<div class="{name}">{self.prose(d)}</div>', f'<div id="{name}"><p>{self.prose(d)}</p></div>', f'<aside class="{name}">{self.prose(d)}</aside>', f'<section class="{name}"><h4>{d}{self.words(1, 4)}</h4><p>{self.prose(d)}</p></section>')
        if kind == 2:
            name = self.pick("notice", "cookie-notice", "cookie-banner", "cookies", "alert", "gdpr", "consent", "warning", "message", "notification")
            return self.pick(f'<div class="{name}">{self.prose(d)}</div>', f'<div class="{name}"><p>{self.prose(d)}</p><button>{d}{self.words(1, 2)}</button></div>', f'<p class="{name}">{self.prose(d)}</p>', f'<div id="{name}" role="alert"><p>{self.prose(d)}</p></div>')
        if kind == 3:
            rows = "".join(f"<label>{d}{self.words(1, 3)}</label><input name=x>" for _ in range(self.r.randint(1, 4)))
            more = self.pick("", f"<p>{self.prose(d)}</p>", f"<h3>{d}{self.words(1, 4)}</h3>", f"<select><option>{d}{self.words(1, 2)}<option>{d}{self.words(1, 2)}</select>", f"<textarea>{d}{self.words(1, 9)}</textarea>")
            name = self.pick("", ' class="newsletter"', ' id="search"', ' class="signup"')
            return f"<form{name}>{more}{rows}<button>{d}{self.words(1, 2)}</button></form>"
        if kind == 4:
            name = self.pick("share", "social", "related", "tags", "breadcrumb", "pagination", "more-links", "toolbar")
            return f'<div class="{name}"><ul>{self.links(d, low=1, high=5)}</ul></div>'
        return f'<script>var t="</p>";{self.words(1, 5)}</script><!-- {self.words(1, 9)} --><style>.x{{}}</style>'

    def nav(self) -> str:
        d = DROP
        return self.pick(
            f"<nav><ul>{self.links(d)}</ul></nav>", f"<nav><ul>{self.links(d)}</ul></nav>", f'<ul class="menu">{self.links(d)}</ul>',
            f'<div id="navigation">{self.links(d, "span")}</div>', f'<div class="navbar"><ul>{self.links(d)}</ul></div>', f'<nav class="menu">{self.links(d, "div")}</nav>',
            f'<div role="navigation"><p>{self.prose(d, 1, 12)}</p><ul>{self.links(d)}</ul></div>',
        )

    def header(self) -> str:
        d = DROP
        inner = f"<h1>{d}{self.words(1, 6)}</h1>" + self.pick("", f"<p>{self.prose(d, 1, 30)}</p>", f"<div>{self.prose(d, 1, 10)}</div>")
        return self.pick(f"<header>{inner}</header>", f"<header>{inner}{self.nav()}</header>", f'<div id="header">{inner}</div>', f'<div class="site-header">{inner}</div>', f'<div class="masthead">{inner}</div>', f'<div class="topbar">{self.prose(d, 1, 12)}</div>')

    def footer(self) -> str:
        d = DROP
        inner = self.pick(f"&copy; {self.prose(d, 1, 25)}", f"<p>{self.prose(d, 1, 40)}</p>", f"<ul>{self.links(d)}</ul>", f"<p>{self.prose(d, 1, 25)}</p><ul>{self.links(d)}</ul>", f"<div>{self.prose(d, 1, 70)}</div>")
        inner = inner if DROP in inner else d + inner
        return self.pick(f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f'<div id="footer">{inner}</div>', f'<div class="footer">{inner}</div>', f'<div class="site-footer">{inner}</div>', f'<div class="copyright">{inner}</div>')

    def sidebar(self) -> str:
        d = DROP
        inner = "".join(self.pick(f"<h3>{d}{self.words(1, 4)}</h3>", f"<ul>{self.links(d)}</ul>", f"<p>{self.prose(d)}</p>") for _ in range(self.r.randint(1, 4)))
        return self.pick(f"<aside>{inner}</aside>", f"<aside>{inner}</aside>", f'<div class="sidebar">{inner}</div>', f'<div id="sidebar">{inner}</div>', f'<aside class="widget">{inner}</aside>', f'<div class="right-rail">{inner}</div>')

    def comments(self) -> str:
        d, n = DROP, self.r.randint(1, 6)
        kind = self.r.randrange(4)
        if kind == 0:
            inner = "".join(f'<div class="comment"><p>{self.prose(d)}</p></div>' for _ in range(n))
        elif kind == 1:
            inner = "<ol class=commentlist>" + "".join(f'<li class="comment"><cite>{d}{self.words(1, 2)}</cite><p>{self.prose(d)}</p></li>' for _ in range(n)) + "</ol>"
        elif kind == 2:
            inner = "".join(f"<p>{self.prose(d)}</p>" for _ in range(n))
        else:
            inner = "<ul>" + "".join(f"<li>{self.prose(d)}</li>" for _ in range(n)) + "</ul>"
        inner = self.pick("", f"<h2>{d}{self.words(1, 3)}</h2>", f"<h3>{d}{self.words(1, 3)}</h3>") + inner
        return self.pick(f'<section class="comments">{inner}</section>', f'<section id="comments">{inner}</section>', f'<div class="comments">{inner}</div>', f'<div id="comments">{inner}</div>', f'<div class="reader-comments">{inner}</div>', f'<section class="responses comments-area">{inner}</section>')

    def content(self) -> str:
        r, k = self.r, KEEP
        parts = [f"<h1>{k}{self.words(1, 14)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 2, 4, 8, 14])):
            kind = r.random()
            if kind < 0.78:
                parts.append(f"<p>{self.prose(k)}" + ("</p>" if r.random() < 0.93 else ""))
            elif kind < 0.84:
                parts.append(f"<h{r.choice('23')}>{k}{self.words(1, 9)}</h2>")
            elif kind < 0.89:
                parts.append("<ul>" + "".join(f"<li>{self.prose(k, 1, 30)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.92:
                parts.append(f"<blockquote><p>{self.prose(k)}</p></blockquote>")
            elif kind < 0.94:
                parts.append("<table>" + "".join(f"<tr><td>{k}{self.words(1, 3)}</td><td>{k}{self.words(1, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.96:
                parts.append(f"<div>{self.prose(k)}</div>")
            elif kind < 0.97:
                parts.append(f"<pre>{k}{self.words(3, 30)}</pre>")
            else:
                parts.append(f"<figure><img src=x><figcaption>{k}{self.words(2, 12)}</figcaption></figure>")
            if r.random() < 0.05:
                parts.append(self.junk())
        return "".join(parts)

    def page(self) -> str:
        r = self.r
        if r.random() < 0.02:  # text without any element, or hardly any
            return "<br>".join(KEEP + self.words(2, 60) for _ in range(r.randint(1, 4)))
        style = r.choices(_STYLES, [s["weight"] for s in _STYLES])[0]["container"]
        body = style[0] + self.content() + (self.comments() if r.random() < 0.08 else "") + style[1]
        above = [self.header() if r.random() < 0.4 else "", self.nav() if r.random() < 0.85 else "", self.junk() if r.random() < 0.45 else "", self.junk() if r.random() < 0.25 else "", self.sidebar() if r.random() < 0.12 else ""]
        below = [self.junk() if r.random() < 0.3 else "", self.comments() if r.random() < 0.3 else "", self.sidebar() if r.random() < 0.25 else "", self.junk() if r.random() < 0.15 else "", self.footer() if r.random() < 0.85 else ""]
        if r.random() < 0.15:
            body = f'<div class="{self.pick("wrapper", "container", "page", "row")}">' + body + "</div>"
        html = f"<!DOCTYPE html><html><head><title>{DROP}{self.words(1, 9)}</title></head><body>" + "".join(above) + body + "".join(below) + "</body></html>"
        if r.random() < 0.12:
            html = html[: r.randrange(len(html) // 3, len(html))]
        return html


def make_page(seed: int) -> str:
    """The page of that number, with marks."""
    return _Maker(seed).page()
