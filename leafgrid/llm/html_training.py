"""Labelled pages to learn from: pages of many layouts, built with the label of every block known."""

from __future__ import annotations

import random

_WRAPS = (
    ("article", ""), ("article", "post"), ("main", ""), ("main", "main content"), ("div", "content"), ("div", "entry content"),
    ("div", "post body"), ("div", "article body"), ("section", "story"), ("div", "main text"), ("div", ""),
    ("center", ""), ("td", "content"), ("td", ""), ("blockquote", ""),
)
_SIDE = (("aside", ""), ("div", "sidebar"), ("aside", "related posts"), ("div", "widget"), ("section", "related"), ("div", "recommended links"))
_ADS = (("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "sponsored"), ("aside", "promo"), ("div", "banner ad"), ("ins", "adsbygoogle"))
_NOTICES = (("div", "cookie notice"), ("div", "notice"), ("div", "cookie banner"), ("div", "gdpr consent"), ("div", "alert"), ("section", "newsletter"), ("div", "popup"), ("div", "subscribe box"))
_COMMENTS = (
    ("section", "comments"), ("div", "comments"), ("div", "comment list"), ("ol", "commentlist"), ("div", "disqus thread"), ("div", "reader comments"), ("ul", "comment thread"), ("section", "responses"),
    ("div", "user replies"), ("section", "replies"), ("ol", "reply list"), ("div", "discussion thread"), ("div", "guestbook"))
_HEADERS = (("header", ""), ("div", "header"), ("header", "site header"), ("div", "masthead"), ("div", "topbar"), ("div", "banner"))
_FOOTERS = (("footer", ""), ("div", "footer"), ("footer", "site footer"), ("div", "bottom copyright"))
_MENUS = (("nav", ""), ("nav", "menu"), ("div", "navigation"), ("ul", "menu"), ("div", "breadcrumbs"), ("div", "pagination"), ("div", "share social"), ("ul", "tags"))
_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de ng ve é ü ß ó ñ que ment".split()


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int, marks: bool = True) -> str:
        out = [self.word() for _ in range(self.r.randint(low, high))]
        out[0] = out[0].capitalize()
        if marks and self.r.random() < 0.9:
            for k in range(self.r.randint(4, 12), len(out) - 1, self.r.randint(6, 14)):
                out[k] += self.r.choice([",", ".", "."])
            out[-1] += "."
        if self.r.random() < 0.1:
            out[0] = f"{self.r.randint(1, 2030)}"
        return " ".join(out)

    def open(self, wrap: tuple[str, str]) -> tuple[str, str]:
        tag, names = wrap
        if not names:
            return f"<{tag}>", f"</{tag}>"
        kind = self.r.choice(["class", "class", "id"])
        joined = self.r.choice(["-", " ", "_"]).join(names.split())
        return f'<{tag} {kind}="{joined}">', f"</{tag}>"

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{k}">{self.words(1, 3, False)}</a></li>' for k in range(n))

    def menu(self) -> str:
        a, b = self.open(self.r.choice(_MENUS))
        if a.startswith("<ul"):
            return a + self.links(self.r.randint(2, 8)) + b
        return a + (f"<ul>{self.links(self.r.randint(2, 8))}</ul>" if self.r.random() < 0.8 else self.words(1, 4, False)) + b

    def aside(self) -> str:
        a, b = self.open(self.r.choice(_SIDE))
        body = f"<h3>{self.words(1, 3, False)}</h3>" * (self.r.random() < 0.6)
        body += f"<ul>{self.links(self.r.randint(2, 6))}</ul>" if self.r.random() < 0.6 else f"<p>{self.words(4, 40)}</p>"
        return a + body + b

    def short(self, wraps: tuple, low: int, high: int) -> str:
        a, b = self.open(self.r.choice(wraps))
        text = self.words(low, high)
        return a + (text if self.r.random() < 0.6 else f"<p>{text}</p>") + b

    def form(self) -> str:
        r = self.r
        return f"<form action='/x'><label>{self.words(1, 3, False)}</label><input name=q><p>{self.words(3, 15)}</p><button>{self.words(1, 2, False)}</button><select><option>{self.word()}<option>{self.word()}</select></form>" if r.random() < 0.6 else f"<form><div>{self.words(2, 12)}</div><button>{self.word()}</button></form>"

    def comments(self) -> str:
        a, b = self.open(self.r.choice(_COMMENTS))
        own = ""
        for _ in range(self.r.randint(1, 5)):
            inner = f"<p>{self.words(3, 50)}</p>"
            own += f'<div class="{self.r.choice(["comment", "comment", "reply", "user-reply", "response"])}"><b>{self.word()}</b>{inner}</div>' if self.r.random() < 0.6 else (f"<li>{inner}</li>" if a.startswith(("<o", "<u")) else inner)
        return a + f"<h3>{self.words(1, 3, False)}</h3>" * (self.r.random() < 0.5) + own + b

    def footer(self) -> str:
        a, b = self.open(self.r.choice(_FOOTERS))
        text = self.r.choice(["&copy; ", "Copyright ", ""]) + "www." + self.word() + ".example &middot; " + self.words(1, 30)
        return a + (text if self.r.random() < 0.6 else f"<p>{text}</p><ul>{self.links(3)}</ul>") + b

    def loose(self) -> str:
        """Text of an article without tags for its paragraphs."""
        r = self.r
        a, b = r.choice([("", ""), ("<font size=2>", "</font>"), ("<span>", "</span>")])
        return a + r.choice(["<br><br>", "<br>\n", "<hr>"]).join(self.words(8, 90) for _ in range(r.randint(1, 4))) + b

    def piece(self) -> str:
        """One or more blocks of an article."""
        r, k = self.r, self.r.random()
        if k < 0.62:
            return f"<p>{self.words(1, 120)}</p>" if r.random() < 0.8 else f"<p>{'<b>' * (r.random() < 0.5)}{self.words(1, 120)}<br>"
        if k < 0.7:
            return f"<h{(n := r.randint(2, 4))}>{self.words(1, 8, False)}</h{n}>"
        if k < 0.77:
            return "<ul>" + "".join(f"<li>{self.words(2, 25)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if k < 0.82:
            return f"<blockquote><p>{self.words(5, 50)}</p></blockquote>"
        if k < 0.86:
            return f"<p>{self.words(5, 40)} <a href='/y'>{self.words(1, 4, False)}</a> {self.words(3, 30)}</p>"
        if k < 0.9:
            return f"<figure><img src=x><figcaption>{self.words(3, 15)}</figcaption></figure>"
        if k < 0.94:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 4, False)}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if k < 0.97:
            return f"<pre>{self.words(3, 20)}</pre>"
        return f"<div>{self.words(10, 80)}</div>"


def labelled_page(seed: int) -> list[tuple[str, int]]:
    """Parts of a page in order, each with the label of its blocks: 1 for the article."""
    m = Maker(seed)
    r = m.r
    parts: list[tuple[str, int]] = [(f"<!DOCTYPE html><html><head><title>{m.words(2, 8)}</title><style>p{{}}</style></head><body>", 0)]
    alone = r.random() < 0.12  # an old page of text with hardly anything else
    chance = lambda p, make: parts.append((make(), 0)) if r.random() < (p / 8 if alone else p) else None
    bare = r.random() < 0.4
    chance(0.25, lambda: m.short(_NOTICES, 5, 40))
    chance(0.4, lambda: "<header>" + f"<h1>{m.words(1, 3, False)}</h1>" * (r.random() < 0.4) + m.menu() + f"<p>{m.words(2, 10)}</p>" * (r.random() < 0.4) + "</header>" if r.random() < 0.6 else m.short(_HEADERS, 1, 12))
    chance(0.8, m.menu)
    chance(0.5, lambda: m.short(_ADS, 2, 45))
    chance(0.15, m.form)
    chance(0.2, m.aside)
    a, b = m.open(_WRAPS[r.randrange(4)] if bare and not alone else r.choice(_WRAPS))
    if alone and r.random() < 0.3:
        a = b = ""
    parts.append((a, 0))
    if r.random() < (0.3 if alone else 0.85):
        parts.append((f"<h1>{m.words(1, 14, r.random() < 0.4)}</h1>", 1))
    untagged = r.random() < (0.6 if alone else 0.15)
    for _ in range(1 if alone and r.random() < 0.3 else r.randint(1, 12)):
        parts.append((m.loose() + "<hr>" if untagged else m.piece(), 1))
        if not bare:
            chance(0.1, lambda: m.short(_ADS, 2, 45))
            chance(0.03, m.aside)
            chance(0.02, m.form)
            chance(0.02, lambda: m.short(_NOTICES, 3, 30))
    if not bare:
        chance(0.15, m.menu)
        chance(0.15, m.comments)
    parts.append((b, 0))
    chance(0.3, m.comments)
    chance(0.3, m.aside)
    chance(0.25, m.form)
    chance(0.2, lambda: m.short(_ADS, 2, 45))
    chance(0.25, m.menu)
    chance(0.9, m.footer)
    chance(0.2, lambda: m.short(_NOTICES, 5, 40))
    return parts
