"""Labelled pages for training: invented words in many page layouts, each text
marked as part of the article or not.  A page is drawn from a seed, so training
is the same everywhere."""

from __future__ import annotations

import random

MAIN, REST = "\ue000", "\ue001"
_PARTS = "ba be bo ca ce co da de do el en er fa fe ga go ha he ir ka la le li lo ma me mi na ne no or pa ra re ri sa se si ta te ti to un ur va ve wo za é ö ñ ü".split()
_NAV = "nav menu navbar navigation breadcrumbs topnav toolbar links".split()
_HEADER = "header masthead site-header page-header topbar branding".split()
_SIDE = "sidebar widget related rail aside recommended popular trending".split()
_NOTICE = "notice cookie consent banner alert gdpr popup modal warning".split()
_ADVERT = "ad ads advert advertisement promo sponsored sponsor".split()
_COMMENT = "comments comment-list comment replies discussion disqus respond".split()
_FOOTER = "footer copyright site-footer legal colophon bottom".split()
_FORM = "newsletter signup search login subscribe contact".split()
_MAIN = "content post entry-content article-body story main-content article text".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.words = ["".join(self.r.choices(_PARTS, k=self.r.randint(1, 4))) for _ in range(300)]

    def text(self, mark: str, low: int, high: int) -> str:
        r = self.r
        words = r.choices(self.words, k=r.randint(low, high))
        out = words[0].capitalize()
        for w in words[1:]:
            out += r.choice((", ", ". ", " ", " ", " ", " ", " ", " ", " ")) + w
        if r.random() < 0.15:
            out += f" {r.randint(1, 9999)}"
        if r.random() < 0.1:
            out += r.choice((" !!", " ###", " $$$", " &amp; co", " %%%"))
        return mark + out + (r.choice(".....!?") if high > 6 and r.random() < 0.85 else "")

    def box(self, names: list[str], tags: tuple[str, ...], inner: str) -> str:
        r = self.r
        tag = r.choice(tags)
        kind = f' {r.choice(("class", "id"))}="{r.choice(names)}"' if tag in ("div", "section", "ul", "p", "span") or r.random() < 0.4 else ""
        return f"<{tag}{kind}>{inner}</{tag}>"

    def paragraph(self, mark: str, low: int = 3, high: int = 90) -> str:
        r, t = self.r, self.text(mark, low, high)
        if r.random() < 0.25:
            w = r.choice(self.words)
            t += f' {r.choice(("<b>%s</b>", "<em>%s</em>", "<a href=\"/x\">%s</a>", "<b>%s<br>", "<i>%s"))}' % w
        if r.random() < 0.12:
            t = t[0] + "<b>" + t[1:]
        return f"<p>{t}" + ("</p>" if r.random() < 0.8 else "")

    def listed(self, mark: str, n: int, high: int, link: bool) -> str:
        items = [self.text(mark, 1, high) for _ in range(n)]
        return "<ul>" + "".join(f'<li><a href="/{i}">{t}</a></li>' if link else f"<li>{t}</li>" for i, t in enumerate(items)) + "</ul>"

    def article(self) -> str:
        r, m = self.r, MAIN
        title = f"<h1>{self.text(m, 1, 10)}</h1>"
        parts = [title if r.random() < 0.8 else f"<header>{title}</header>"] if r.random() < 0.92 else []
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 12))):
            kind = r.random()
            if kind < 0.72:
                parts.append(self.paragraph(m, *r.choice(((1, 6), (3, 30), (10, 120), (40, 200)))))
            elif kind < 0.79:
                parts.append(f"<h{r.randint(2, 4)}>{self.text(m, 1, 8)}</h2>")
            elif kind < 0.85:
                parts.append(self.listed(m, r.randint(2, 5), r.choice((4, 20)), False))
            elif kind < 0.89:
                parts.append(f"<blockquote>{self.paragraph(m, 5, 50)}</blockquote>")
            elif kind < 0.92:
                parts.append("<table>" + "".join(f"<tr><td>{self.text(m, 1, 4)}</td><td>{self.text(m, 1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.94:
                parts.append(f"<pre>{self.text(m, 3, 20)}</pre>")
            elif kind < 0.96:
                parts.append(f"<figure><img src=x><figcaption>{self.text(m, 2, 12)}</figcaption></figure>")
            else:
                parts.append(self.advert() if r.random() < 0.6 else self.box(_SIDE, ("aside", "div"), self.listed(REST, 3, 6, True)))
        body = "".join(parts)
        style = r.random()
        if style < 0.6:
            return f"<article>{body}</article>"
        if style < 0.7:
            return f"<main>{body}</main>"
        if style < 0.8:
            return f"<main><article>{body}</article></main>"
        return self.box(_MAIN, ("div", "section"), body)

    def nav(self) -> str:
        inner = self.listed(REST, self.r.randint(2, 9), 3, True) if self.r.random() < 0.8 else "".join(f'<a href="/{i}">{self.text(REST, 1, 2)}</a> ' for i in range(4))
        return self.box(_NAV, ("nav", "nav", "div", "ul"), inner)

    def header(self) -> str:
        r = self.r
        inner = r.choice((f"<a href='/'>{self.text(REST, 1, 3)}</a>", f"<h1>{self.text(REST, 1, 3)}</h1>", f"<p>{self.text(REST, 1, 8)}</p>", f"<h2>{self.text(REST, 1, 4)}</h2>"))
        return self.box(_HEADER, ("header", "header", "div"), inner + (self.nav() if r.random() < 0.4 else ""))

    def advert(self) -> str:
        inner = self.text(REST, 2, 40) if self.r.random() < 0.7 else self.paragraph(REST, 2, 40)
        return self.box(_ADVERT, ("div", "div", "aside", "section"), inner)

    def side(self) -> str:
        inner = (f"<h3>{self.text(REST, 1, 4)}</h3>" if self.r.random() < 0.6 else "") + (self.listed(REST, self.r.randint(2, 6), 8, True) if self.r.random() < 0.6 else self.paragraph(REST, 3, 40))
        return self.box(_SIDE, ("aside", "aside", "div"), inner)

    def notice(self) -> str:
        inner = self.r.choice((self.text(REST, 4, 40), self.paragraph(REST, 4, 40))) + (f"<button>{self.text(REST, 1, 2)}</button>" if self.r.random() < 0.5 else "")
        return self.box(_NOTICE, ("div", "div", "section", "dialog"), inner)

    def form(self) -> str:
        inner = f"<label>{self.text(REST, 1, 5)}</label><input type=text>" + (f"<p>{self.text(REST, 3, 20)}</p>" if self.r.random() < 0.5 else "") + f"<button>{self.text(REST, 1, 2)}</button>"
        return self.box(_FORM, ("form",), inner) if self.r.random() < 0.7 else self.box(_FORM, ("div", "section"), f"<form>{inner}</form>")

    def comments(self) -> str:
        r = self.r
        each = "".join(r.choice(("<div class='comment'>%s</div>", "<li>%s</li>", "<article class='comment'>%s</article>", "%s")) % (f"<h4>{self.text(REST, 1, 2)}</h4>" * r.randint(0, 1) + self.paragraph(REST, 2, 70)) for _ in range(r.randint(1, 5)))
        return self.box(_COMMENT, ("div", "section"), (f"<h3>{self.text(REST, 1, 3)}</h3>" if r.random() < 0.6 else "") + each)

    def footer(self) -> str:
        r = self.r
        inner = r.choice(("&copy; ", "", "&copy; 2024 ")) + self.text(REST, 2, 30) if r.random() < 0.7 else self.paragraph(REST, 2, 30) + self.listed(REST, 3, 3, True)
        return self.box(_FOOTER, ("footer", "footer", "div"), inner)

    def page(self) -> str:
        r, some = self.r, lambda p, f: f() if r.random() < p else ""
        before = [some(0.4, self.header), some(0.75, self.nav), some(0.3, self.notice), some(0.5, self.advert), some(0.15, self.form)]
        after = [some(0.3, self.side), some(0.25, self.advert), some(0.3, self.comments), some(0.25, self.form), some(0.15, self.notice), some(0.85, self.footer)]
        early = some(0.15, self.side)
        body = "".join(before) + early + self.article() + "".join(after)
        head = f"<head><title>{self.text('', 1, 6)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head>"
        end = "</body></html>" if r.random() < 0.85 else ""
        return f"<!DOCTYPE html><html>{head}<body>{body}{end}"


def labelled_pages(n: int, seed: int = 1) -> list[str]:
    """n pages whose texts begin with MAIN or REST."""
    return [_Writer(seed * 1_000_003 + i).page() for i in range(n)]
