"""Labelled pages: layouts of many kinds, drawn by a seed, in which it is known what the main text is.

A page has menus, a header, adverts, notices, forms, an article, reader comments, sidebars and a footer, in
many arrangements and under many names; some pages name their elements by what they are, some by accident.
Elements with main text carry ``data-main="1"``, such within it that hold none carry ``data-main="0"``. The
prose is made of drawn syllables in all parts alike, so that layout, names and measures of the text decide.
"""

from __future__ import annotations

import random
from collections.abc import Callable

# Names and phrases that occur on pages of many sites.
ARTICLE = "article post entry story content article-body post-content entry-content story-body main-content text body-text single blog-post".split()
WRAP = "main content page wrapper container layout primary site-content col-md-8 column".split()
NAV = "nav menu navbar navigation main-menu topnav nav-links primary-nav breadcrumb breadcrumbs pagination pager tabs toc".split()
HEADER = "header site-header top masthead topbar banner branding page-header".split()
FOOTER = "footer site-footer bottom colophon copyright footer-links credits legal".split()
SIDEBAR = "sidebar aside widget widgets rail secondary related related-posts trending most-read recommended tags categories archive".split()
ADVERT = "ad ads advert advertisement sponsored promo banner-ad ad-slot adbox sponsor promotion teaser".split()
NOTICE = "cookie cookie-notice consent alert notice gdpr modal popup message disclaimer warning overlay".split()
FORM = "newsletter subscribe signup search login contact-form subscribe-box search-form".split()
COMMENTS = "comments comment comment-list responses discussion replies reader-comments disqus feedback".split()
SHARE = "share social social-links share-buttons follow meta byline author-box post-meta".split()
LINKS = (
    "Home About Contact News Sport Blog Products Shop Login Register Help FAQ Terms Privacy Impressum Datenschutz Kontakt Startseite Accueil Inicio Archive RSS"
    " Twitter Facebook Next Previous More Share Reply Print"
).split()
NOTICES = (
    "We use cookies to improve this site.", "Accept all", "By using this site you agree to our terms.", "Wir verwenden Cookies.", "Ce site utilise des cookies.",
    "Please enable JavaScript.", "Subscribe to our newsletter", "Sign up for updates", "Enter your email address", "Advertisement", "Sponsored", "Anzeige", "Skip to content",
)
FUNCTION = "the of and to in a is that for it der die und in den von zu le la de et les des que el en y los se".split()

#: Pages that are drawn where nothing else is said.
PAGES = 1_500


class _Drawn:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.sounds = [a + b + c for a in ("", "b", "st", "r", "th", "qu", "l", "k", "é", "ü") for b in "aeiou" for c in ("", "n", "r", "ng", "s", "ß", "ll")]
        self.noise = self.r.random() < 0.12  # every word with a sign behind it
        self.plain = self.r.random() < 0.25  # names that say nothing
        self.named = self.r.random() < 0.7  # elements for what they hold, not div

    def word(self) -> str:
        if self.r.random() < 0.4:
            return self.r.choice(FUNCTION)
        return "".join(self.r.choice(self.sounds) for _ in range(self.r.randint(1, 3)))

    def sentence(self, most: int = 25) -> str:
        words = [self.word() for _ in range(self.r.randint(1, most))]
        if self.noise:
            words = [w + self.r.choice(("$$$", "%%%", "***", "###", "&amp;&amp;")) for w in words]
        return (" ".join(words) + self.r.choice(("." * 8 + "!?:;"))).capitalize().replace("&Amp;", "&amp;")

    def prose(self, most: int = 8) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, self.r.randint(1, most)))))
        if self.r.random() < 0.15:
            cut = len(text) // 2
            text = f"{text[:cut].rpartition(' ')[0]} <{self.r.choice(('b', 'i', 'em', 'strong'))}>{text[cut:].lstrip()}<br>" if self.r.random() < 0.5 else f'{text} <a href="/x">{self.word()}</a> {self.sentence()}'
        return text

    def element(self, tag: str, names: list[str], inside: str, label: str = "", own: float = 0.8) -> str:
        """An element under one of the names, or a div, or under a name without sense."""
        if not self.named and tag not in ("ul", "form", "table", "p"):
            tag = "div"
        name = f"c{self.r.randint(1, 99)}" if self.plain else self.r.choice(names)
        marked = f' {self.r.choice(("class", "class", "id"))}="{name}"' if self.r.random() < own or tag == "div" else ""
        marked += f' data-main="{label}"' if label else ""
        return f"<{tag}{marked}>{inside}</{tag}>"

    def links(self, tag: str, names: list[str]) -> str:
        items = [self.r.choice(LINKS) if self.r.random() < 0.4 else self.word() for _ in range(self.r.randint(2, 12))]
        if self.r.random() < 0.75:
            inside = "<ul>" + "".join(f'<li><a href="/{k}">{w}</a></li>' for k, w in enumerate(items)) + "</ul>"
        else:
            inside = self.r.choice((" | ", " ", " &raquo; ", "</span><span>")).join(f'<a href="/{k}">{w}</a>' for k, w in enumerate(items))
        return self.element(tag, names, inside)

    def notice(self) -> str:
        text = self.r.choice(NOTICES) if self.r.random() < 0.6 else self.sentence()
        tag = self.r.choice(("p", "span", "div", "button"))
        return self.element(self.r.choice(("div", "aside", "section", "dialog")), NOTICE, f"<{tag}>{text}</{tag}>" if self.r.random() < 0.7 else text)

    def advert(self) -> str:
        text = self.r.choice(("", self.r.choice(NOTICES))) + self.prose(2)
        return self.element(self.r.choice(("div", "div", "aside", "ins", "p")), ADVERT, text if self.r.random() < 0.5 else f"<p>{text}</p>")

    def form(self) -> str:
        return self.element("form", FORM, f"<label>{self.r.choice(NOTICES)}</label><input name=q><p>{self.sentence(9)}</p><button>{self.r.choice(LINKS)}</button>")

    def comments(self) -> str:
        """What readers wrote, in words like the article's."""
        many = [f"<p>{self.word()} {self.r.randint(1, 30)} {self.word()} ago</p><p>{self.prose(4)}</p><a href='#'>Reply</a>" for _ in range(self.r.randint(1, 5))]
        if self.r.random() < 0.5:
            inside = "<ol>" + "".join(f'<li class="comment">{c}</li>' for c in many) + "</ol>"
        else:
            inside = "".join(self.element(self.r.choice(("div", "article")), COMMENTS, c) for c in many)
        return self.element("section", COMMENTS, f"<h3>{self.r.choice(('Comments', 'Kommentare', 'Commentaires', 'Responses'))}</h3>{inside}")

    def sidebar(self) -> str:
        boxes = [f"<h3>{self.sentence(3)}</h3>" + self.r.choice((lambda: self.links("div", SIDEBAR), lambda: f"<p>{self.prose(2)}</p>", self.form, self.advert))() for _ in range(self.r.randint(1, 3))]
        return self.element("aside", SIDEBAR, "".join(boxes))

    def header(self) -> str:
        inside = f"<h1>{self.word()} {self.word()}</h1>" if self.r.random() < 0.4 else f'<a href="/">{self.word()}</a>'
        return self.element("header", HEADER, inside + (f"<p>{self.sentence(6)}</p>" if self.r.random() < 0.5 else "") + (self.links("nav", NAV) if self.r.random() < 0.4 else ""))

    def footer(self) -> str:
        host = f"{self.word()}.example.com"
        inside = self.r.choice((f"&copy; {host} &middot; {self.prose(3)}", f"<p>&copy; {self.r.randint(1990, 2030)} {host}. {self.sentence(6)}</p>", f"<p>{self.sentence()}</p>"))
        return self.element("footer", FOOTER, inside + (self.links("nav", FOOTER) if self.r.random() < 0.4 else ""))

    def extra(self) -> str:
        """A part within the article that is none of its text."""
        made = self.r.choice((self.advert, self.form, self.notice, lambda: self.links("div", SHARE), self.sidebar, lambda: self.element("p", SHARE, f"{self.word()} {self.word()}, {self.r.randint(1, 30)}. {self.r.randint(1, 12)}. 2024")))()
        return f'<div data-main="0">{made}</div>' if self.r.random() < 0.5 else made.replace(">", ' data-main="0">', 1)

    def body(self, title: str) -> str:
        parts = [f"<{self.r.choice(('h1', 'h1', 'h2'))}>{title}</h1>"] if self.r.random() < 0.85 else [f"<p>{title}"]
        wrapped = self.r.choice(("p", "p", "p", "p", "div", "br"))
        if self.r.random() < 0.3:  # the title again, as a lead
            parts.append(f"<p>{'<b>' * self.r.randint(0, 1)}{title}{'<br>' * self.r.randint(0, 1)}" + "</p>" * self.r.randint(0, 1))
        for _ in range(self.r.choice((0, 1, 3, 6, self.r.randint(2, 25)))):
            kind = self.r.random()
            text = self.prose()
            if kind < 0.06:
                parts.append(f"<h{self.r.randint(2, 4)}>{self.sentence(6)}</h2>")
            elif kind < 0.09:
                parts.append("<ul>" + "".join(f"<li>{self.sentence(12)}" for _ in range(self.r.randint(2, 6))) + "</ul>")
            elif kind < 0.11:
                parts.append(f"<blockquote>{text}</blockquote>" if self.r.random() < 0.6 else f"<pre>{text}</pre>")
            elif kind < 0.13:
                parts.append("<table>" + "".join(f"<tr><td>{self.sentence(4)}<td>{self.r.randint(1, 999)}" for _ in range(3)) + "</table>")
            elif kind < 0.15:
                parts.append(f"<figure><img src=x><figcaption>{self.sentence(8)}</figcaption></figure>")
            else:
                parts.append(f"{text}<br><br>" if wrapped == "br" else f"<{wrapped}>{text}" + f"</{wrapped}>" * (self.r.random() < 0.9 or wrapped == "div"))
            if self.r.random() < 0.1:
                parts.append(self.extra())
        return "".join(parts)

    def page(self) -> str:
        r, title = self.r, self.sentence(9)
        tag = r.choice(("article", "article", "main", "div", "section", "td"))
        text = self.element(tag, ARTICLE, self.body(title), "1", own=0.4) if tag != "td" else f'<table class="{r.choice(WRAP)}"><tr><td>{self.links("div", NAV)}<td data-main="1">{self.body(title)}</table>'
        if r.random() < 0.25:
            text = self.element("div", WRAP, text)
        around: list[Callable[[], str]] = [self.advert, self.notice, self.form, self.sidebar, self.comments, lambda: self.links("nav", NAV), lambda: f"<p>{self.sentence(8)}</p>"]
        middle = [f() for f in r.choices(around, k=r.randint(0, 2))] + [text] + [f() for f in r.choices([self.comments, self.comments, self.sidebar, *around], k=r.randint(0, 3))]
        inside = "".join(middle)
        if r.random() < 0.6:
            inside = self.element(r.choice(("main", "div", "section")), WRAP, inside)
        before = [self.header] * (r.random() < 0.6) + [lambda: self.links("nav", NAV)] * (r.random() < 0.7) + [self.advert] * (r.random() < 0.4) + [self.notice] * (r.random() < 0.3)
        after = [self.sidebar] * (r.random() < 0.2) + [self.footer] * (r.random() < 0.9) + [self.notice] * (r.random() < 0.2)
        head = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        return head + "".join(f() for f in before) + inside + "".join(f() for f in after) + "</body></html>"


def labelled_pages(count: int = PAGES, seed: int = 1) -> list[str]:
    return [_Drawn(seed * 1_000_003 + k).page() for k in range(count)]
