"""Labelled pages, made from a seed: the article's words stand between marks.

Layouts, element names, depths, lengths and the names of classes vary from page
to page.  A part of the pages has no names or meaningless ones, names of
article sections are now and then those of other parts, and every part comes
with short and with long texts, so that a name alone decides nothing.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: The article's words stand between these.
BEGIN, END = "<!--main-->", "<!--/main-->"

#: What sites call such parts, in some languages.
NAMES = {
    "article": "article content entry post story text body main artikel beitrag inhalt contenu texte articulo contenido noticia",
    "section": "section part chapter intro lead abschnitt kapitel partie seccion summary details discussion notes",
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs pager pagination tabs navegacion menue",
    "header": "header masthead banner top branding logo kopf entete cabecera",
    "footer": "footer bottom colophon legal copyright imprint fuss pied pie impressum",
    "side": "sidebar aside rail widget related recommended popular teaser trending seitenleiste barre lateral",
    "notice": "notice cookie consent alert popup modal overlay banner gdpr newsletter subscribe hinweis avis aviso",
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion werbung anzeige publicite publicidad anuncio",
    "comments": "comments comment discussion replies responses feedback thread kommentare commentaires comentarios",
    "form": "form search login signup contact suche recherche buscar",
    "share": "share social tags meta byline toolbar teilen partager compartir",
}


class Maker:
    """Makes one page."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        r = self.r
        self.words = ["".join(r.choice("aeiou") + r.choice("bcdfglmnprstvz") for _ in range(r.randint(1, 4))) for _ in range(300)]
        self.naming = r.choice(("named", "named", "named", "hashed", "none"))
        self.hashed: dict[str, str] = {}
        # whether the parts have elements of their own, or are plain divisions
        self.own = r.random() < 0.55

    def text(self, low: int, high: int, marks: bool = True) -> str:
        r, out = self.r, []
        for _ in range(r.randint(low, high)):
            word = r.choice(self.words)
            out.append(word.capitalize() if not out or out[-1].endswith(".") else word)
            if marks and r.random() < 0.12:
                out[-1] += r.choice(".,.")
        return " ".join(out) + ("." if marks and r.random() < 0.85 else "")

    def attrs(self, part: str) -> str:
        r = self.r
        if self.naming == "none" or r.random() < 0.12:
            return ""
        if self.naming == "hashed":
            name = self.hashed.setdefault(part, f"{r.choice('abcxyz')}{r.randrange(16 ** 5):05x}")
        else:
            if part == "section" and r.random() < 0.1:
                part = r.choice(list(NAMES))
            name = r.choice(NAMES[part].split())
            if r.random() < 0.4:
                name = r.choice((f"{name}-{r.choice(self.words)}", f"{r.choice(self.words)}-{name}", f"{name}_{r.randrange(9)}", f"site-{name}", f"{name}-wrap", f"{name} {r.choice(self.words)}"))
        return f' {r.choice(("class", "class", "id"))}="{name}"'

    def element(self, part: str, tag: str, inside: str) -> str:
        name = tag if self.own else "div"
        return f"<{name}{self.attrs(part)}>{inside}</{name}>"

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.r.choice(self.words)}">{self.text(low, high, False)}</a>'

    def links(self, n: int) -> str:
        if self.r.random() < 0.6:
            tag = self.r.choice(("ul", "ol", "ul"))
            return f"<{tag}>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + f"</{tag}>"
        return " ".join(self.link() for _ in range(n))

    # --- parts outside the article ---

    def menu(self) -> str:
        return self.element("menu", "nav", self.links(self.r.randint(2, 12)))

    def header(self) -> str:
        inside = self.link() if self.r.random() < 0.5 else f"<p>{self.text(2, 9)}</p>"
        return self.element("header", "header", inside + (self.menu() if self.r.random() < 0.4 else ""))

    def footer(self) -> str:
        r = self.r
        inside = r.choice(("&copy; ", "")) + self.text(3, 25) + (self.links(r.randint(1, 6)) if r.random() < 0.5 else "")
        return self.element("footer", "footer", f"<p>{inside}</p>" if r.random() < 0.4 else inside)

    def side(self) -> str:
        r = self.r
        parts = [f"<h3>{self.text(1, 3, False)}</h3>{self.links(r.randint(2, 8))}" for _ in range(r.randint(1, 3))]
        if r.random() < 0.4:
            parts.append(f"<p>{self.text(6, 40)}</p>")
        return self.element("side", "aside", "".join(parts))

    def notice(self) -> str:
        inside = f"<p>{self.text(5, 40)}</p>" if self.r.random() < 0.6 else self.text(5, 30)
        return f"<div{self.attrs('notice')}>{inside}<button>{self.text(1, 2, False)}</button></div>" if self.r.random() < 0.6 else f"<div{self.attrs('notice')}>{inside}</div>"

    def advert(self) -> str:
        r = self.r
        inside = r.choice((self.text(3, 20), f"<p>{self.text(4, 25)}</p>", f"{self.text(2, 8)} {self.link(2, 5)}"))
        return f"<div{self.attrs('advert')}>{inside}</div>"

    def comments(self) -> str:
        r = self.r
        many = r.random() < 0.5

        def one() -> str:
            who = r.choice((f"<b>{self.text(1, 2, False)}</b>", f"<span>{self.text(1, 2, False)}</span>", self.link(1, 2), ""))
            says = f"<p>{self.text(3, 45)}</p>" if r.random() < 0.7 else self.text(3, 30)
            return f"{who} {says}{self.link(1, 1) if many else ''}"

        n = r.randint(1, 9)
        if r.random() < 0.5:
            inside = "<ol>" + "".join(f"<li{self.attrs('comments')}>{one()}</li>" for _ in range(n)) + "</ol>"
        else:
            inside = "".join(f"<div{self.attrs('comments')}>{one()}</div>" for _ in range(n))
        return self.element("comments", "section", f"<h3>{self.text(1, 2, False)}</h3>{inside}{self.form() if r.random() < 0.4 else ''}")

    def form(self) -> str:
        return f"<form{self.attrs('form')}><label>{self.text(1, 4, False)}</label><input><button>{self.text(1, 2, False)}</button></form>"

    def share(self) -> str:
        return f"<div{self.attrs('share')}>{' '.join(self.link(1, 1) for _ in range(self.r.randint(2, 5)))}</div>"

    # --- the article ---

    def block(self) -> str:
        r, x = self.r, self.r.random()
        if x < 0.72:
            text = self.text(*r.choice(((1, 8), (10, 60), (10, 60), (40, 160))))
            if r.random() < 0.08:  # left open
                return f"<p><b>{text}<br>"
            if r.random() < 0.3:
                cut = text.split(" ")
                k = r.randrange(len(cut))
                cut[k] = r.choice((f'<a href="/x">{cut[k]}</a>', f"<b>{cut[k]}</b>", f"<em>{cut[k]}</em>", cut[k] + "<br>"))
                text = " ".join(cut)
            return f"<p>{text}</p>" if r.random() < 0.9 else f"<div>{text}</div>"
        if x < 0.82:
            return f"<h{(k := r.randint(2, 4))}>{self.text(1, 9, False)}</h{k}>"
        if x < 0.9:
            return "<ul>" + "".join(f"<li>{self.text(2, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if x < 0.93:
            return f"<blockquote><p>{self.text(6, 40)}</p></blockquote>"
        if x < 0.95:
            return f"<pre>{self.text(5, 30)}</pre>"
        if x < 0.97:
            return "<table>" + "".join(f"<tr><td>{self.text(1, 3, False)}</td><td>{self.text(1, 4, False)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
        return f"<figure><figcaption>{self.text(3, 15)}</figcaption></figure>"

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f"<h1>{self.text(2, 14, False)}</h1>")
        n, section = r.choice((1, 2, 4, 8, 14)), r.random() < 0.25
        for _ in range(n):
            if r.random() < 0.07:
                out.append(END + r.choice((self.advert, self.share, self.form, self.advert))() + BEGIN)
            one = self.block()
            out.append(f"<section{self.attrs('section')}>{one}{self.block()}</section>" if section and r.random() < 0.5 else one)
        inside = BEGIN + "".join(out) + END
        if r.random() < 0.2:
            inside += r.choice((self.share, self.advert, self.comments))()
        tag = r.choice(("article", "article", "main", "div"))
        made = f"<{tag}{self.attrs('article')}>{inside}</{tag}>" if tag == "div" or r.random() < 0.6 else f"<{tag}>{inside}</{tag}>"
        for _ in range(r.choice((0, 0, 1, 2))):
            made = f"<div{self.attrs('section')}>{made}</div>"
        return made

    def page(self) -> str:
        r = self.r
        may = lambda part, p: part() if r.random() < p else ""
        before = [may(self.notice, 0.25), may(self.header, 0.5), may(self.menu, 0.7), may(self.advert, 0.4), may(self.form, 0.2)]
        r.shuffle(before)
        middle = [self.article()]
        if r.random() < 0.45:
            middle.insert(r.choice((0, 1)), self.side())
        after = [may(self.share, 0.2), may(self.advert, 0.25), may(self.comments, 0.4), may(self.side, 0.2), may(self.notice, 0.1)]
        inside = "".join(before) + (f"<div>{''.join(middle)}</div>" if r.random() < 0.4 else "".join(middle)) + "".join(after) + may(self.footer, 0.8)
        return f"<!DOCTYPE html><html><head><title>{self.text(2, 9, False)}</title><script>var x='</p>';</script></head><body>{inside}</body></html>"


def pages(n: int, seed: int = 1) -> Iterator[str]:
    """n pages with marks around the article's words."""
    for i in range(n):
        yield Maker(seed * 1_000_003 + i).page()
