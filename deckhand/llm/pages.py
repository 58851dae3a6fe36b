"""Made-up pages with known main text, on which the extraction model is trained and tested."""

from __future__ import annotations

import random

#: Marks the elements of the main text in a made-up page; removed before anything reads it.
MARK = "\x02"
SYLLABLES = "an the ing on er re at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        #: Some pages' text has no marks between sentences, as in lists of words and junk.
        self.plain = self.r.random() < 0.25
        #: Some have many short lines, many of them the same.
        self.short = self.r.random() < 0.2
        self.line = self.words(1, 5).capitalize() + "."

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self) -> str:
        if self.plain:
            return " ".join([self.word()] * self.r.randint(3, 30)) if self.r.random() < 0.3 else self.words(3, 60)
        s = self.words(3, 18).capitalize()
        return (s.replace(" ", ", ", 1) if self.r.random() < 0.3 else s) + self.r.choice("....?!")

    def prose(self, a: int, b: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(a, b)))

    def attribute(self, names: str, plain: float = 0.15) -> str:
        if self.r.random() < plain:
            return ""
        name = self.r.choice(names.split())
        if self.r.random() < 0.3:
            name = self.r.choice(["site-", "js-", "l-", "block-", "page-"]) + name
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def links(self, a: int, b: int) -> str:
        tag, n = self.r.choice(["li", "li", "span", ""]), self.r.randint(a, b)
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(n)]
        inner = "".join(f"<{tag}>{x}</{tag}>" if tag else x + " | " for x in items)
        return f"<ul>{inner}</ul>" if tag == "li" else inner

    def menu(self) -> str:
        return self.r.choice([lambda: f"<nav>{self.links(3, 9)}</nav>", lambda: f"<div{self.attribute('nav menu navbar navigation breadcrumb breadcrumbs toc tabs', 0.1)}>{self.links(3, 9)}</div>"])()

    def header(self) -> str:
        inner = f"<{self.r.choice(['h1', 'h2', 'div', 'p', 'a'])}>{self.words(1, 4)}"
        inner += f"</{inner[1:].split('>')[0]}>" + (f"<p>{self.sentence()}</p>" if self.r.random() < 0.5 else "")
        tag = self.r.choice(["header", "header", "div"])
        return f"<{tag}{self.attribute('header masthead topbar banner site-title', 0.3 if tag == 'header' else 0)}>{inner}{self.menu() if self.r.random() < 0.4 else ''}</{tag}>"

    def footer(self) -> str:
        tag = self.r.choice(["footer", "footer", "div"])
        inner = self.r.choice([f"&copy; {self.words(1, 3)}", f"<p>{self.prose(1, 2)}</p>", self.links(2, 6), f"&copy; {self.word()}.example.com &middot; {self.sentence()}"])
        return f"<{tag}{self.attribute('footer bottom colophon copyright legal', 0.5 if tag == 'footer' else 0)}>{inner}</{tag}>"

    def sidebar(self) -> str:
        tag = self.r.choice(["aside", "aside", "div", "section"])
        body = self.r.choice([self.links(3, 8), f"<p>{self.prose(1, 4)}</p>", f"<h3>{self.words(1, 3)}</h3>{self.links(2, 6)}", f"<div><h4>{self.words(1, 3)}</h4><p>{self.prose(1, 3)}</p></div>"])
        return f"<{tag}{self.attribute('sidebar side rail widget related recommended popular trending more-stories', 0.4 if tag == 'aside' else 0)}>{body}</{tag}>"

    def advert(self) -> str:
        tag = self.r.choice(["div", "div", "aside", "section", "p"])
        body = self.r.choice([self.sentence(), self.prose(1, 3), f'<a href="/{self.word()}">{self.sentence()}</a>', f"<span>{self.words(2, 6)}</span>"])
        return f"<{tag}{self.attribute('ad ads advert advertisement sponsored promo sponsor banner-ad ad-slot promotion', 0)}>{body}</{tag}>"

    def notice(self) -> str:
        body = self.prose(1, 3) + self.r.choice(["", "<button>OK</button>", f" <a href=/x>{self.words(1, 2)}</a>"])
        return f"<div{self.attribute('cookie cookies cookie-notice consent notice gdpr alert newsletter subscribe popup modal banner overlay paywall', 0)}><{(t := self.r.choice(['p', 'div', 'span']))}>{body}</{t}></div>"

    def form(self) -> str:
        label = f"<label>{self.words(1, 3)}</label><input name=q>"
        return f"<form{self.attribute('search login signup subscribe contact', 0.5)}>{self.r.choice(['', f'<p>{self.sentence()}</p>'])}{label}<button>{self.word()}</button></form>"

    def share(self) -> str:
        return f"<div{self.attribute('share social sharing social-links tools tags meta byline', 0)}>{self.links(2, 5)}</div>"

    def comments(self) -> str:
        one = lambda: self.r.choice([f"<li><b>{self.word()}</b><p>{self.prose(1, 4)}</p></li>", f'<div class="comment"><p>{self.prose(1, 4)}</p></div>', f'<article class="comment"><h4>{self.word()}</h4><p>{self.prose(1, 3)}</p></article>'])
        body = "".join(one() for _ in range(self.r.randint(1, 5)))
        tag = self.r.choice(["section", "div", "div", "ol"])
        return f"<{tag}{self.attribute('comments comment-list responses replies discussion disqus reader-comments', 0)}>{f'<h3>{self.words(1, 2)}</h3>' if tag != 'ol' else ''}{body}</{tag}>"

    def own(self) -> str:
        """A piece of the main text."""
        k = self.r.random()
        if k < 0.62:
            text = self.prose(1, 7)
            if self.short and self.r.random() < 0.8:
                text = self.r.choice([self.line, self.words(1, 6) + "."])
            if self.r.random() < 0.3:
                t = self.r.choice(["b", "i", "em", "strong", "span"])
                text = f"<{t}>{self.words(1, 5)}</{t}> {text}"
            if self.r.random() < 0.2:
                text += f' <a href="/{self.word()}">{self.words(1, 3)}</a>.'
            if self.r.random() < 0.2:
                return f"<p{MARK}><b{MARK}>{text}<br>"
            return f"<{(t := self.r.choice(['p', 'p', 'p', 'p', 'div']))}{MARK}>{text}</{t}>"
        if k < 0.72:
            return f"<{(t := self.r.choice(['h2', 'h3', 'h4']))}{MARK}>{self.words(1, 8)}</{t}>"
        if k < 0.8:
            items = "".join(f"<li{MARK}>{self.r.choice([self.sentence, lambda: self.words(1, 5)])()}</li>" for _ in range(self.r.randint(1, 6)))
            return f"<{(t := self.r.choice(['ul', 'ol']))}{MARK}>{items}</{t}>"
        if k < 0.87:
            return f"<blockquote{MARK}>{self.r.choice([self.prose(1, 3), f'<p{MARK}>{self.prose(1, 3)}</p>'])}</blockquote>"
        if k < 0.91:
            return f"<pre{MARK}>{self.words(3, 20)}</pre>"
        if k < 0.95:
            rows = "".join(f"<tr{MARK}>" + "".join(f"<td{MARK}>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(1, 4)))
            return f"<table{MARK}>{rows}</table>"
        return f"<figure{MARK}><img src=/a.png><figcaption{MARK}>{self.sentence()}</figcaption></figure>"

    def noise(self) -> str:
        return self.r.choice([self.advert, self.advert, self.sidebar, self.share, self.notice, self.form])()

    def article(self) -> str:
        title = f"<h1{MARK}>{self.words(2, 12)}</h1>" if self.r.random() < 0.85 else ""
        if title and self.r.random() < 0.15:
            title = f"<header{MARK}>{title}</header>"
        body = "".join(self.own() + (self.noise() if self.r.random() < 0.07 else "") for _ in range(self.r.choice([6, 14, 30, 60] if self.short else [1, 1, 2, 3, 4, 6, 9, 14, 25])))
        if self.r.random() < 0.15:
            body = f"<section{MARK}>{body}</section>"
        if self.r.random() < 0.1:
            body += self.comments()
        if self.r.random() < 0.15:
            body += self.footer()
        kind = self.r.random()
        if kind < 0.6:
            return f"<article{self.attribute('post article story entry hentry', 0.6)}{MARK}>{title}{body}</article>"
        tag = "main" if kind < 0.75 else self.r.choice(["div", "div", "section"])
        name = self.attribute("content article-body post-content entry-content main story-body article text post body-text", 0.05 if tag != "main" else 0.6)
        return f"<{tag}{name}{MARK}>{title}{body}</{tag}>"

    def page(self) -> str:
        top = "".join(f() for f in (self.notice, self.header, self.menu, self.form, self.advert) if self.r.random() < 0.45)
        low = "".join(f() for f in (self.sidebar, self.comments, self.advert, self.share, self.form, self.notice) if self.r.random() < 0.3)
        body = self.article() + low if self.r.random() < 0.8 else self.sidebar() + self.article() + low
        for _ in range(self.r.choice([0, 0, 0, 1, 1, 2])):
            body = f"<{(t := self.r.choice(['div', 'div', 'main', 'section']))}{self.attribute('wrapper container page layout row col main site', 0.3)}>{body}</{t}>"
        page = f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>{top}{body}{self.footer() if self.r.random() < 0.8 else ''}"
        return page + ("</body></html>" if self.r.random() < 0.8 else "")
