"""Web pages with known main text, written by a fixed random generator, to fit the block labeller to."""

from __future__ import annotations

import random

_ONSETS = "b c d f g h j k l m n p r s t v w z br ch cl dr fl gr kn ph pl qu sch sh sl sp st str th tr wh é ñ ü".split()
_RIMES = "a e i o u ai ea ou ie an en er in on or at et it ut and ing ation ent est ly ó ä ö eux ción ung".split()
_MENU = "home about contact news shop login register search help faq blog archive topics sports weather jobs privacy terms imprint sitemap events gallery support team careers products services accueil kontakt inicio".split()
_NOTICE = ["We use cookies to improve your experience.", "Accept all cookies", "This site uses cookies.", "Sign up for our newsletter", "Subscribe now and save", "Your browser is out of date.", "Please enable JavaScript.", "By continuing you agree to our terms of use."]
_COMMENT = ["Great article, thanks!", "I don't agree with this at all.", "Reply", "Report this comment", "3 comments", "Leave a comment", "first!", "Thanks for sharing this with us."]


class Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.vocabulary = ["".join(rng.choice(_ONSETS) + rng.choice(_RIMES) for _ in range(rng.choice((1, 1, 2, 2, 3)))) for _ in range(370)] + list("aàäéèiíoóöuüyß0123456789,.-") + ["ä,", "a.", "é,"]
        self.main: set[str] = set()
        if self.chance(0.12):
            marks = rng.sample(["%%%", "***", "###", "$$$", "!!", "&&", "…", "|"], 3)
            self.vocabulary = [w + rng.choice(marks) for w in self.vocabulary]
        if self.chance(0.06):
            self.vocabulary = [w.upper() for w in self.vocabulary]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, lo: int, hi: int) -> str:
        out = self.rng.choices(self.vocabulary, k=self.rng.randint(lo, hi))
        return " ".join(w + ("," if self.chance(0.1) else "") for w in out).rstrip(",")

    def sentence(self, lo: int = 3, hi: int = 18) -> str:
        s = self.words(lo, hi)
        return s[:1].upper() + s[1:] + self.rng.choice("....!?")

    def prose(self) -> str:
        """A paragraph: mostly some sentences, at times a few words."""
        if self.chance(0.15):
            return self.sentence(1, 4)
        if self.chance(0.04):  # one word over and over
            return " ".join([self.words(1, 1)] * self.rng.randint(5, 300))
        return " ".join(self.sentence() for _ in range(self.rng.choice((1, 1, 2, 3, 5, 8, 14))))

    def good(self, text: str) -> str:
        text = " ".join(text.split())
        self.main.add(text)
        return text

    def named(self, tag: str, names: list[str], p: float = 0.85) -> tuple[str, str]:
        """Start and end tag; the class or id is given at the chance p."""
        attribute = f' {self.rng.choice(("class", "class", "id"))}="{self.rng.choice(names)}"' if names and self.chance(p) else ""
        return f"<{tag}{attribute}>", f"</{tag}>"

    def inline(self, text: str) -> str:
        """The same text with inline marks."""
        if self.chance(0.25):
            words = text.split(" ")
            i = self.rng.randrange(len(words))
            tag = self.rng.choice(("b", "i", "em", "strong", 'a href="/x"', "span", "code"))
            words[i] = f"<{tag}>{words[i]}</{tag.split()[0]}>"
            text = " ".join(words)
        return text

    # Parts that aren't the article

    def menu(self) -> str:
        wrap = self.rng.choice((("nav", ["menu", "main-nav", "navbar"]), ("div", ["menu", "nav", "navigation", "topnav"]), ("nav", []), ("ul", ["menu", "nav"])))
        a, z = self.named(*wrap, p=1.0 if wrap[0] != "nav" else 0.4)
        items = [self.rng.choice(_MENU).title() if self.chance(0.4) else self.words(1, 3) for _ in range(self.rng.randint(3, 9))]
        inner = "".join(f'<li><a href="/{i}">{x}</a></li>' if self.chance(0.95) else f"<li>{x}</li>" for i, x in enumerate(items))
        return f"{a}{inner if wrap[0] == 'ul' else '<ul>' + inner + '</ul>'}{z}"

    def head(self) -> str:
        a, z = self.named(*self.rng.choice((("header", ["site-header", "masthead"]), ("div", ["header", "banner", "top", "masthead"]))), p=1.0)
        inner = self.rng.choice((f'<a href="/">{self.words(1, 3)}</a>', f"<h1>{self.words(1, 4)}</h1><p>{self.words(2, 6)}</p>", f"<div>{self.words(1, 4)}</div>"))
        return a + inner + (self.menu() if self.chance(0.4) else "") + z

    def foot(self) -> str:
        a, z = self.named(*self.rng.choice((("footer", ["site-footer"]), ("footer", []), ("div", ["footer", "bottom", "copyright", "legal"]))), p=1.0)
        inner = self.rng.choice((f"&copy; {self.rng.randint(1999, 2025)} {self.words(1, 3)}. All rights reserved.", f"&copy; {self.words(1, 1)}.example.com &middot; {self.sentence()}", f"<p>{self.sentence()}</p><ul><li><a href='/p'>Privacy</a></li><li><a href='/t'>Terms</a></li></ul>"))
        return a + inner + z

    def side(self) -> str:
        a, z = self.named(*self.rng.choice((("aside", ["sidebar", "widget", "related"]), ("aside", []), ("div", ["sidebar", "side", "related", "widget", "rightcol", "recommended"]), ("section", ["related", "more", "popular"]))), p=1.0)
        kind = self.rng.random()
        if kind < 0.5:
            inner = f"<h3>{self.words(1, 4)}</h3><ul>" + "".join(f'<li><a href="/{i}">{self.words(2, 8)}</a></li>' for i in range(self.rng.randint(2, 6))) + "</ul>"
        else:
            inner = f"<h4>{self.words(1, 3)}</h4>" * self.chance(0.6) + "".join(f"<p>{self.prose()}</p>" for _ in range(self.rng.randint(1, 3)))
        return a + inner + z

    def advert(self) -> str:
        a, z = self.named(*self.rng.choice((("div", ["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner-ad"]), ("aside", ["ad", "promo", "sponsored"]), ("section", ["advertisement", "ad"]))), p=1.0)
        return a + self.rng.choice((self.sentence(), f"<p>{self.prose()}</p>", f"Advertisement<p>{self.sentence()}</p>", f'<a href="/buy">{self.words(2, 6)}</a>')) + z

    def notice(self) -> str:
        a, z = self.named("div", ["cookie", "cookie-notice", "notice", "consent", "banner", "alert", "popup", "newsletter", "gdpr"], p=1.0)
        return f"{a}<p>{self.rng.choice(_NOTICE) if self.chance(0.6) else self.sentence()}</p>" + "<button>OK</button>" * self.chance(0.5) + z

    def form(self) -> str:
        return f"<form action='/s'><label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>" + f"<p>{self.sentence()}</p>" * self.chance(0.4) + "<select><option>1<option>2</select>" * self.chance(0.2) + "</form>"

    def comments(self) -> str:
        a, z = self.named(*self.rng.choice((("section", ["comments", "responses", "discussion"]), ("div", ["comments", "comment-list", "disqus", "replies"]))), p=1.0)
        one = self.rng.choice((("div", ["comment", "reply"]), ("li", ["comment"]), ("article", ["comment"])))
        b, y = self.named(*one, p=1.0)
        inner = "".join(f"{b}<p>{self.rng.choice(_COMMENT) if self.chance(0.4) else self.prose()}</p>{y}" for _ in range(self.rng.randint(1, 5)))
        return f"{a}<h3>{self.rng.choice(('Comments', self.words(1, 2)))}</h3>{inner}{z}"

    def meta(self) -> str:
        a, z = self.named(*self.rng.choice((("div", ["byline", "meta", "share", "tags", "breadcrumb", "author", "social"]), ("p", ["byline", "meta", "date", "tags"]), ("nav", ["breadcrumb"]))), p=1.0)
        return a + self.rng.choice((f"By {self.words(1, 2).title()}", f"{self.rng.randint(1, 28)}.{self.rng.randint(1, 12)}.2021", '<a href="/s">Share</a> <a href="/t">Tweet</a>', f"Tags: {self.words(1, 4)}")) + z

    # The article

    def body(self) -> str:
        out = []
        closed = self.chance(0.8)
        heading = self.good(self.words(2, 12) + self.rng.choice(("", ".", "")))
        if self.chance(0.85):
            out.append(f"<h1>{heading}</h1>")
        if self.chance(0.2):
            out.append(self.meta())
        for _ in range(self.rng.choice((1, 2, 3, 5, 8, 12, 20, 30))):
            kind = self.rng.random()
            text = self.good(self.prose())
            if kind < 0.72:
                out.append(f"<p>{self.inline(text)}" + "</p>" * closed)
            elif kind < 0.78:
                out.append(f"<p><b>{text}<br>")
            elif kind < 0.83:
                out.append(self.heading())
            elif kind < 0.88:
                items = [self.good(self.sentence(1, 12)) for _ in range(self.rng.randint(2, 5))]
                out.append("<ul>" + "".join(f"<li>{x}" + "</li>" * closed for x in items) + "</ul>")
            elif kind < 0.91:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.93:
                cells = [[self.good(self.words(1, 4)) for _ in range(2)] for _ in range(self.rng.randint(1, 3))]
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in cells) + "</table>")
            elif kind < 0.95:
                out.append(f"<pre>{text}</pre>")
            elif kind < 0.97:
                out.append(f"<figure><img src=x><figcaption>{text}</figcaption></figure>")
            else:
                out.append(self.rng.choice((self.advert, self.side, self.form, self.notice, self.meta))())
        return "".join(out)

    def heading(self) -> str:
        n = self.rng.randint(2, 4)
        return f"<h{n}>{self.good(self.words(1, 7))}</h{n}>"

    def page(self) -> str:
        a, z = self.named(*self.rng.choice((("article", []), ("article", ["post", "entry"]), ("article", []), ("main", []), ("main", ["content"]), ("div", ["content", "article", "post", "entry-content", "story", "main", "post-body", "article-body"]))), p=1.0)
        article = a + self.body() + (self.comments() if self.chance(0.08) else "") + z
        if self.chance(0.3):
            b, y = self.named(*self.rng.choice((("main", []), ("div", ["wrapper", "container", "page", "main"]), ("section", []))), p=1.0)
            article = b + article + (self.side() if self.chance(0.3) else "") + y
        before = [f() for f, p in ((self.notice, 0.15), (self.head, 0.35), (self.menu, 0.7), (self.form, 0.1), (self.advert, 0.4), (self.side, 0.12), (self.meta, 0.08)) if self.chance(p)]
        after = [f() for f, p in ((self.comments, 0.25), (self.side, 0.3), (self.form, 0.1), (self.advert, 0.25), (self.notice, 0.1), (self.foot, 0.85)) if self.chance(p)]
        if self.chance(0.2):
            self.rng.shuffle(before)
        if self.chance(0.06):  # nothing but the article
            before, after = [], []
            if self.chance(0.5):
                article = f"{a}<p>{self.good(self.prose())}</p>{z}"
        title = f"<title>{self.words(2, 9)}</title>" if self.chance(0.85) else ""
        out = f'<!DOCTYPE html><html><head><meta charset="utf-8">{title}<style>p{{margin:0}}</style><script>var t="<p>x</p>";</script></head><body>' + "".join(before) + "<!-- x -->" + article + "".join(after) + "</body></html>"
        return out[: self.rng.randint(len(out) // 2, len(out))] if self.chance(0.12) else out


def sample_pages(n: int, seed: int) -> list[tuple[str, set[str]]]:
    """n pages with the texts of their main blocks. Of a page that is cut off, the last block may count as not main."""
    out = []
    for i in range(n):
        w = Writer(random.Random(seed * 1_000_003 + i))
        out.append((w.page(), w.main))
    return out
