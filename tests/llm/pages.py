"""Pages by other hands than those the trees learn from: layouts of well-known kinds of sites, with their own names.

page(layout, seed) gives (html, main text). Words come from short lists of real ones.
"""

import random

TOPICS = "harbour council river engine museum bridge climate orchard railway market archive telescope festival library glacier vaccine senate tunnel island copper".split()
VERBS = "opened closed rebuilt measured described funded delayed praised questioned visited repaired studied extended moved replaced".split()
REST = "after years of debate|with help from volunteers|despite heavy rain|for the first time|near the old town|under a new law|at a cost of nine million|in front of a large crowd|as planned|without any notice".split("|")


class Made:
    def __init__(self, seed):
        self.rng = random.Random(seed)
        self.main = []

    def sentence(self):
        r = self.rng
        return f"The {r.choice(TOPICS)} near the {r.choice(TOPICS)} was {r.choice(VERBS)} {r.choice(REST)}."

    def prose(self, lo=2, hi=6):
        return " ".join(self.sentence() for _ in range(self.rng.randint(lo, hi)))

    def title(self):
        return f"{self.rng.choice(TOPICS).title()} {self.rng.choice(VERBS)} {self.rng.choice(REST)}"

    def keep(self, html, text=None):
        self.main.append(html if text is None else text)
        return html

    def paragraphs(self, n=None, tag="p"):
        out = []
        for _ in range(n or self.rng.randint(3, 8)):
            text = self.prose()
            out.append(f"<{tag}>{self.keep(text)}</{tag}>")
        return "\n".join(out)

    def links(self, n, tag="li"):
        return "".join(f'<{tag}><a href="/{w}">{w.title()}</a></{tag}>' for w in self.rng.sample(TOPICS, n))


def blog(m):
    nav = f'<div id="masthead"><p class="site-title">My notes</p><ul class="primary-nav-list">{m.links(6)}</ul></div>'
    title, quote = m.title(), m.sentence()
    body = f'<div class="hentry type-post"><h1 class="entry-title">{m.keep(title)}</h1><div class="entry-content">{m.paragraphs(3)}<blockquote><p>{m.keep(quote)}</p></blockquote>{m.paragraphs(2)}</div></div>'
    replies = "".join(f'<li><div class="vcard">{w.title()} says:</div><p>{m.sentence()}</p><a class="comment-reply-link" href="#">Reply</a></li>' for w in m.rng.sample(TOPICS, 4))
    side = f'<div id="secondary" class="widget-area"><h3>Recent posts</h3><ul>{m.links(8)}</ul><form><input name="s"><button>Search</button></form></div>'
    return f'{nav}<div id="primary">{body}<ol class="commentlist">{replies}</ol></div>{side}<div id="colophon">Proudly powered by nothing. All rights reserved 2021.</div>'


def encyclopedia(m):
    title = m.title()
    sections = ""
    for _ in range(3):
        head = m.rng.choice(TOPICS).title()
        sections += f"<h2><span>{m.keep(head)}</span></h2>{m.paragraphs(2)}"
    side = f'<div id="mw-panel"><div class="portal"><h3>Navigation</h3><ul>{m.links(9)}</ul></div></div>'
    return f'<div id="mw-head"><ul>{m.links(5)}</ul></div><div id="bodyContent" class="mw-body"><h1>{m.keep(title)}</h1>{sections}</div>{side}<div id="footer-places"><ul>{m.links(5)}</ul><p>Text is available under a licence; additional terms may apply.</p></div>'


def news(m):
    title, lead = m.title(), m.sentence()
    promo = f'<div class="sponsored-content"><p>{m.prose(1, 2)}</p><a href="#">Buy now</a></div>'
    body = f'<article itemprop="articleBody"><h1>{m.keep(title)}</h1><p class="standfirst"><strong>{m.keep(lead)}</strong></p>{m.paragraphs(2)}{promo}{m.paragraphs(3)}</article>'
    rail = f'<aside><h4>Most read</h4><ol>{m.links(7)}</ol></aside>'
    return f'<header role="banner"><a href="/">The Daily</a><nav><ul>{m.links(8)}</ul></nav></header><div id="gdpr-consent"><p>We and our partners store cookies on your device to show you adverts.</p><button>Accept all</button></div><main>{body}{rail}</main><footer><p>Copyright the Daily 2023. Contact us. Terms of use.</p><ul>{m.links(6)}</ul></footer>'


def table_layout(m):
    title = m.title()
    return f'<table width="800"><tr><td colspan="2" bgcolor="#ccc"><a href="/">Start</a> | <a href="/a">About</a> | <a href="/b">Archive</a> | <a href="/c">Mail</a></td></tr><tr><td width="150"><ul>{m.links(10)}</ul></td><td><h1>{m.keep(title)}</h1>{m.paragraphs(5)}</td></tr><tr><td colspan="2"><font size="1">Last updated 3 May 1999. Webmaster.</font></td></tr></table>'


def docs_site(m):
    title = m.title()
    items = "".join(f"<li>{m.keep(m.sentence())}</li>" for _ in range(4))
    code = f"<pre><code>{m.keep('install ' + m.rng.choice(TOPICS) + ' and run it')}</code></pre>"
    after = m.paragraphs(2)
    return f'<div class="wy-nav-side"><div class="search-box"><form><input></form></div><ul class="toctree">{m.links(12)}</ul></div><section class="wy-content-wrap"><div class="breadcrumb-row"><a href="/">Docs</a> &raquo; <a href="/x">Guide</a></div><div class="rst-content"><h1>{title}</h1><ul>{items}</ul>{code}{after}</div></section><footer>Built with a generator. <a href="/next">Next</a></footer>', title


def recipe(m):
    title = m.title()
    intro = m.paragraphs(2)
    steps = "".join(f"<li>{m.keep(m.sentence())}</li>" for _ in range(5))
    more = f'<div class="you-may-also-like"><h3>You may also like</h3>{m.links(6, "div")}</div>'
    return f'<nav>{m.links(5, "span")}</nav><div class="post-body recipe"><h1>{title}</h1>{intro}<ol class="steps">{steps}</ol></div><div class="share-buttons"><a href="#">Tweet</a> <a href="#">Pin</a> <a href="#">Mail</a></div>{more}<div class="newsletter-signup"><p>Get our letter every week.</p><form><input type="email"><button>Sign up</button></form></div>', title


def forum_post(m):
    title = m.title()
    own = m.paragraphs(4)
    replies = "".join(f'<div class="reply-row"><div class="user-cell">{w}</div><div class="message-cell">{m.prose(1, 3)}</div></div>' for w in m.rng.sample(TOPICS, 4))
    return f'<div class="top-bar"><a href="/">Board index</a> <a href="/login">Log in</a></div><div class="content"><h1>{title}</h1><div class="post-text">{own}</div></div><div id="discussion" class="replies-list"><h3>Replies</h3>{replies}</div><div class="footer-wrap">Forum software by nobody.</div>', title


def bare(m):
    title = m.title()
    return f"<h1>{m.keep(title)}</h1>{m.paragraphs(6)}<hr><p><small><a href='/'>Home</a> <a href='/next'>Next</a></small></p>"


def misleading(m):
    """Wrappers whose names speak of what else is on the page."""
    title, names = m.title(), m.rng.choice([("content with-sidebar", "entry has-comments"), ("post-comment-text", "text"), ("layout no-footer cookie-banner-shown", "page-with-ads"), ("search-result-page story", "share-enabled"), ("nav-open main", "related-off copy")])
    side = f'<div class="{m.rng.choice(["rail", "extra-col"])}"><h4>Also</h4><ul>{m.links(6)}</ul></div>'
    return f'<nav><ul>{m.links(6)}</ul></nav><div class="{names[0]}"><div class="{names[1]}"><h1>{m.keep(title)}</h1>{m.paragraphs(6)}</div>{side}</div><footer>Copyright. Terms of use.</footer>'


def nameless(m):
    """Nothing has a name, and the last paragraph ends the page."""
    return f"<ul>{m.links(7)}</ul><div>{m.paragraphs(m.rng.randint(2, 9))}</div>"


def german(m):
    """Names in another language; the last block ends the page, or a foot does."""
    title = m.title()
    foot = m.rng.choice(["", '<div class="fusszeile">Impressum und Datenschutz</div>'])
    return f'<div class="kopfzeile"><ul class="hauptmenue">{m.links(6)}</ul></div><div class="seitenleiste"><ul>{m.links(8)}</ul></div><div class="inhalt"><h1>{m.keep(title)}</h1>{m.paragraphs(5)}</div>{foot}'


LAYOUTS = [misleading, nameless, german, blog, encyclopedia, news, table_layout, docs_site, recipe, forum_post, bare]


def page(layout, seed):
    m = Made(seed)
    made = layout(m)
    html, first = made if isinstance(made, tuple) else (made, None)
    main = [first, *m.main] if first else m.main
    return f"<!DOCTYPE html><html><head><title>{TOPICS[seed % len(TOPICS)]}</title><script>var a=1;</script></head><body>{html}</body></html>", " ".join(main)
