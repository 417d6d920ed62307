"""Labelled pages for the block labeller: made from a seed, with a mark before each main text.

The pages vary in what holds the article, in the names and tags of what surrounds it, in what
stands inside it, and in how broken the markup is. Words are invented, so nothing but structure and
the shape of texts can be learned.
"""

from __future__ import annotations

import random

MARK = "\u0001"

#: Ways to write each kind of container; {} is one of several neutral names.
CONTAINERS = {
    "article": [
        "article", "article", "article", 'article class="post"', "main", 'main id="content"', 'div id="content"', 'div class="post"',
        'div class="entry-content"', 'section class="story"', 'div class="article-body"', 'div role="main"', 'td class="body"', 'div class="{}"',
        'div id="main-text"', 'div class="page-content"', 'div itemprop="articleBody" class="text"',
    ],
    "nav": [
        "nav", "nav", 'nav class="{}"', 'div class="menu"', 'div id="nav"', 'ul class="navbar"', 'div role="navigation"', 'div class="breadcrumbs"',
        'div class="main-menu"', 'ol class="breadcrumb"', 'div class="pagination"', 'ul id="topnav"', 'div class="tabs"', 'nav class="toc"', 'div class="tag-links"',
    ],
    "header": ["header", "header", 'div id="header"', 'div class="masthead"', 'div role="banner"', 'header class="{}"', 'div class="top-bar"', 'div class="site-header"'],
    "footer": [
        "footer", "footer", 'div id="footer"', 'div class="site-info"', 'div role="contentinfo"', 'footer class="{}"', 'div class="copyright"', 'div class="bottom"',
        'div class="footer-links"', 'div class="legal"',
    ],
    "sidebar": [
        "aside", "aside", 'aside class="{}"', 'div class="sidebar"', 'div id="secondary"', 'div role="complementary"', 'div class="widget"', 'div class="related"',
        'div class="right-column rail"', 'div class="recommended"', 'div class="trending"', 'div class="more-stories"', 'section class="related-posts"', 'div class="author-bio"',
    ],
    "advert": [
        'div class="ad"', 'div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="banner"', 'div class="sponsored"', 'div id="ad-slot"',
        'section class="promo"', 'aside class="ad"', 'p class="ad"', 'div class="sponsor"', 'div class="promotion"', 'div class="ad-container"', 'div class="adsbox"', 'ins class="ads"',
    ],
    "notice": [
        'div class="cookie-notice"', 'div id="cookie-banner"', 'div class="consent"', 'div role="alert"', 'div class="alert"', 'div class="notice"', 'p class="notice"', 'div class="gdpr"',
        'div class="warning"', 'noscript', 'div class="popup"', 'div class="modal" role="dialog"', 'dialog', 'div class="paywall"', 'div class="disclaimer"', 'div class="privacy"', 'section class="notice"',
    ],
    "form": ["form", "form", 'form class="newsletter"', 'form id="search"', 'form class="login"', 'div class="newsletter"', 'div class="signup"', 'form action="/s" class="{}"', 'div class="subscribe"', "fieldset", 'div class="search-box"'],
    "comments": [
        'section id="comments"', 'div class="comments"', 'div id="comments"', 'ol class="comment-list"', 'div id="disqus_thread"', 'section class="discussion"',
        'div class="reader-comments"', 'ul class="comments"', 'div class="replies"', 'section class="comments"', 'div class="user-comments"', 'div class="responses"',
    ],
    "share": ['div class="share"', 'div class="social"', 'ul class="social-links"', 'div class="share-buttons"', 'div class="toolbar"', 'menu'],
}
NEUTRAL = "row col wrap block box c12 left grid inner section-a x1 unit module".split()
CUES = "cookies subscribe advertisement newsletter privacy terms comment reply share login copyright rights reserved".split()


class _Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.words = ["".join(self.rng.choice("aeioutnrshldcmé") for _ in range(self.rng.randint(2, 9))) for _ in range(300)]

    def some(self, low: int, high: int) -> str:
        n = int(low * (high / low) ** self.rng.random())
        out = [self.rng.choice(self.words) for _ in range(n)]
        out[0] = out[0].capitalize()
        return " ".join(w + self.rng.choice([".", ","]) if self.rng.random() < 0.12 else w for w in out)

    def sentence(self, low: int = 3, high: int = 90) -> str:
        return self.some(low, high) + self.rng.choice(["."] * 6 + ["!", "?", ""])

    def tag(self, kind: str) -> tuple[str, str]:
        spec = self.rng.choice(CONTAINERS[kind]).replace("{}", self.rng.choice(NEUTRAL))
        return f"<{spec}>", f"</{spec.split()[0]}>"

    def links(self, n: int) -> str:
        item = self.rng.choice(["<li><a href='/x'>{}</a></li>", "<a href=/x>{}</a> ", "<span><a href='#'>{}</a></span> | "])
        body = "".join(item.format(self.some(1, 4)) for _ in range(n))
        return f"<ul>{body}</ul>" if item.startswith("<li") else body

    def outside(self, kind: str) -> str:
        """A piece that is not main text."""
        r, (start, stop) = self.rng, self.tag(kind)
        cue = f" {r.choice(CUES)} " if r.random() < 0.3 else " "
        if kind == "nav" or kind == "share":
            return start + self.links(r.randint(2, 8)) + stop
        if kind == "form":
            return f"{start}<label>{self.some(1, 5)}</label><input name=q>{r.choice(['', f'<p>{self.sentence(3, 25)}{cue}</p>'])}<button>{self.some(1, 2)}</button>{stop}"
        if kind == "comments":
            one = r.choice(["<div class='comment'><p>{}</p></div>", "<li>{}</li>", "<p>{}</p>", "<div><b>{n}</b><p>{}</p></div>", "<article class='comment'><p>{}</p></article>"])
            title = r.choice(["", f"<h3>{self.some(1, 3)}{cue}</h3>", f"<h2>{self.some(1, 3)}</h2>"])
            return start + title + "".join(one.format(self.sentence(3, 60), n=self.some(1, 2)) for _ in range(r.randint(1, 5))) + stop
        if kind == "header":
            return f"{start}{r.choice(['', '<a href=/>' + self.some(1, 3) + '</a>'])}<{(h := r.choice(['div', 'p', 'h1', 'h2', 'span']))}>{self.some(1, 8)}</{h}>{r.choice(['', self.links(3)])}{stop}"
        if kind == "footer":
            return f"{start}{r.choice(['&copy; ', 'Copyright ', '', ''])}{self.some(1, 4)} {r.choice(['&middot; ', '', '| '])}{self.sentence(2, 25)}{r.choice(['', self.links(4)])}{stop}"
        if kind == "sidebar":
            inner = "".join(r.choice([f"<p>{self.sentence(3, 40)}</p>", self.links(r.randint(2, 5)), f"<h3>{self.some(1, 4)}</h3>"]) for _ in range(r.randint(1, 3)))
            return start + inner + stop
        text = self.sentence(3, 40) + cue
        return start + r.choice([text, f"<p>{text}</p>", f"<p>{text}</p><p>{self.sentence()}</p>", f"<div>{text}</div>"]) + stop

    def main(self, text: str) -> str:
        if self.rng.random() < 0.15:
            words = text.split(" ")
            words[len(words) // 2] = f"<a href='/y'>{words[len(words) // 2]}</a>"
            text = " ".join(words)
        if self.rng.random() < 0.2:  # what articles say of privacy or licences is theirs
            text = f"{text} {self.rng.choice(CUES)}" if self.rng.random() < 0.6 else " ".join(self.rng.sample(CUES, 3)) + "."
        return MARK + text

    def inside(self) -> str:
        """A piece of main text."""
        r, s = self.rng, self.sentence
        kind = r.random()
        if kind < 0.66:
            return f"<p>{self.main(s())}</p>"
        if kind < 0.72:
            return f"<p>{MARK}<b>{s(3, 30)}<br>"
        if kind < 0.78:
            return f"<h{(n := r.randint(2, 4))}>{MARK}{self.some(1, 8)}</h{n}>"
        if kind < 0.83:
            t = r.choice(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{self.main(s(1, 20))}</li>" for _ in range(r.randint(1, 5))) + f"</{t}>"
        if kind < 0.88:
            return f"<blockquote>{r.choice(['', '<p>'])}{self.main(s(3, 40))}</blockquote>"
        if kind < 0.91:
            return "<table>" + "".join(f"<tr><td>{MARK}{self.some(1, 3)}</td><td>{MARK}{self.some(1, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if kind < 0.94:
            return f"<figure><img src=x><figcaption>{self.main(s(2, 15))}</figcaption></figure>"
        if kind < 0.97:
            return f"<div>{self.main(s(3, 60))}</div>"
        return f"<pre>{MARK}{self.some(2, 20)}</pre>"

    def page(self) -> str:
        r = self.rng
        start, stop = self.tag("article") if r.random() < 0.93 else ("", "")
        title = f"<h1>{MARK}{self.some(1, 12)}</h1>"
        title = r.choice([title, title, title, f"<header>{title}</header>", ""])
        inner = [self.inside() for _ in range(max(1, int(r.expovariate(0.12))))]
        for kind in ("advert", "sidebar", "notice", "form", "nav", "share", "comments"):
            if r.random() < 0.22:
                inner.insert(len(inner) if kind in ("comments", "share") and r.random() < 0.7 else r.randint(0, len(inner)), self.outside(kind))
        much = r.choice([0.0, 0.2, 0.4, 0.6])  # from bare articles to crowded pages
        before = [self.outside(k) for k in ("header", "nav", "advert", "notice", "form", "sidebar") if r.random() < much]
        after = [self.outside(k) for k in ("share", "comments", "sidebar", "advert", "form", "notice") if r.random() < much]
        r.shuffle(before)
        r.shuffle(after)
        foot = self.outside("footer") if r.random() < 2 * much else ""
        wrap = r.choice([("", "")] * 3 + [("<div class='container'>", "</div>"), ("<div id='page'>", "</div>"), ("<table><tr>", "</table>")])
        body = wrap[0] + "".join(before) + start + title + "".join(inner) + stop + "".join(after) + wrap[1] + foot
        return f"<!DOCTYPE html><html><head><title>{self.some(1, 8)}</title><script>var t='</p>';</script></head><body>{body}{r.choice(['</body></html>', ''])}"


def labelled_pages(n: int, seed: int = 5) -> list[str]:
    """n pages; a block of main text has MARK in it."""
    writer = _Writer(seed)
    return [writer.page() for _ in range(n)]
