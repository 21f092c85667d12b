"""Labelled pages, from which the extractor's weights are learned: invented sites put together from parts.

A page is a list of (part, is it article text). Parts come from lists of layouts, article containers and page
furniture, by a seeded draw, so that names meet in many combinations.
"""

from __future__ import annotations

import random

SENTENCES = [
    "The town council voted on Monday evening to keep the old harbour crane.",
    "Work on its feet begins in May and ends before the first frost.",
    "Cut on a dry day with a clean blade, and take dead wood first.",
    "A core of three kilometres holds the weather of eight hundred thousand years.",
    "They lifted the arch from a raft at low water.",
    "Trains on the coast line ran an hour late after a mast fell on the wire.",
    "So it stays.",
    "The prices of shares fell, and related work was put off.",
    "Nobody asked for a comment.",
    "Stir the flour in slowly, then leave the dough for a night.",
    "Each file holds a header, a list of blocks and a footer.",
    "In the second half the guests scored twice.",
    "Why?",
    "Gone.",
    "Not yet.",
]
LABELS = ["Home", "News", "Sport", "About us", "Contact", "Help", "Imprint", "Privacy", "Archive", "Next", "Previous", "Log in", "Sign up", "More", "Top"]
PITCHES = ["Buy two lamps and pay one today only", "We use cookies to make this site better", "Get our letter every week", "You may also like these stories", "All rights reserved", "Share this with friends", "Thank you, this helped me a lot", "I always do it in March", "Please enter your name and mail", "Our offices are closed on Friday"]

#: Furniture by the class, id or role values that sites give it.
MARKED = """ad|ads|advert|advertisement|ad-slot|ad-banner|sponsored|sponsor-box|promo|promotion-box|banner|banner-top|cookie-notice|cookies|cookie-consent|consent-banner|gdpr|notice|site-notice|alert|alert-box
newsletter|newsletter-signup|subscribe|subscribe-form|subscription-box|popup|modal|overlay|modal-overlay|sidebar|left-sidebar|sidebar-widget|widget|widgets|widget-area|menu|main-menu|menu-item|nav|navbar|main-nav|navigation|site-navigation
breadcrumb|breadcrumbs|toolbar|topbar|top-bar|footer|site-footer|page-footer|masthead|header|site-header|page-header|contentinfo|complementary|search|search-form|search-box|skip-link|skip|login|login-form|signup
comments|comment-list|comment|comment-body|comments-area|commentlist|replies|reply|respond|discussion|reader-comments|share|share-buttons|sharing|social|social-links|social-media|related|related-posts|related-articles|recommended|recommendations
pagination|pager|page-links|teaser|teasers|tags|tag-list|trending|most-read|popular-posts|author-bio|feedback|rating|poll|outbrain|taboola|disclaimer|legal|copyright""".replace("\n", "|").split("|")
#: Containers of article text.
HOLDERS = """content|main-content|post|post-content|entry|entry-content|article|article-body|story|story-body|text|body-text|page|page-content|main|blog-post|single|hentry|container|wrapper|row|col|section|block|box|inner|lead|intro|summary|figure|caption|recipe|steps|share-price|notice-board|related-work|item|list|table|quote""".split("|")


def _furniture(r: random.Random, between: bool = False) -> str:
    """`between`: among the blocks of an article, where something must mark it."""
    words = r.choice(PITCHES)
    links = "".join(f"<li><a href='/{k}'>{r.choice(LABELS)}</a></li>" for k in range(r.randint(2, 6)))
    flat = r.choice([" ", " | ", ""]).join(f"<a href='/{k}'>{r.choice(LABELS)}</a>" for k in range(r.randint(2, 6)))
    kind, name = r.randrange(14 if between else 15), r.choice(MARKED)
    mark = r.choice([f"class='{name}'", f'class="{name}"', f"id={name}", f"role='{name}'", f'class="box {name}"', f'id="{name}" class="inner"'])
    inside = r.choice([words, f"<p>{words}.</p>", f"<h3>{words}</h3><ul>{links}</ul>", flat, f"<div><span>{words}</span> <a href='#'>{r.choice(LABELS)}</a></div>", f"<p>{words}. {r.choice(SENTENCES)}</p><p>{r.choice(SENTENCES)}</p>"])
    if kind < 9:
        e = r.choice(["div", "div", "section", "aside", "p"])
        return f"<{e} {mark}>{inside if e != 'p' else r.choice([words, flat])}</{e}>"
    return [
        f"<nav><ul>{links}</ul></nav>",
        f"<footer><p>{words}</p>{flat}</footer>",
        f"<aside><h4>{words}</h4><ul>{links}</ul></aside>",
        f"<form><label>{r.choice(LABELS)}</label><input><button>{r.choice(LABELS)}</button></form>",
        f"<header><a href='/'>{words}</a>{flat}</header>",
        r.choice([f"<div>{flat}</div>", f"<ul>{links}</ul>", f"<menu>{links}</menu>", f"<button>{words}</button>", f"<dialog>{words}</dialog>", f"<aside><article><p>{words}.</p><p>{r.choice(SENTENCES)}</p></article></aside>"]),
    ][kind - 9]


def _block(r: random.Random) -> str:
    text = " ".join(r.choice(SENTENCES) for _ in range(r.randint(1, 5)))
    linked = text.replace(" the ", " <a href='/x'>the</a> ", 1)
    return r.choice([
        f"<p>{text}</p>", f"<p>{linked}</p>", f"<p><b>{text}</b></p>", f"<p>{text}<br>{linked}</p>", f"<div>{text}</div>", f"<h2>{r.choice(SENTENCES)}</h2><p>{text}</p>",
        f"<ul><li>{text}</li><li>{linked}</li></ul>", f"<ol><li>{text}</li></ol>", f"<blockquote>{text}</blockquote>", f"<table><tr><td>{text}</td><td>{r.choice(SENTENCES)}</td></tr></table>",
        f"<pre>{text}</pre>", f"<section><h3>{r.choice(SENTENCES)}</h3><p>{text}</p></section>", f"<figure><figcaption>{text}</figcaption></figure>", f"<dl><dt>{r.choice(SENTENCES)}</dt><dd>{text}</dd></dl>", f"{text}<br>",
        f"<div class='{r.choice(HOLDERS)}'><p>{text}</p></div>", f"<p><em>{text}</em> <span>{r.choice(SENTENCES)}</span></p>", f"<p>{text}<p>{linked}", f"<details><summary>{r.choice(SENTENCES)}</summary>{text}</details>",
    ])


def page(r: random.Random) -> list[tuple[str, bool]]:
    holder = r.choice(HOLDERS)
    opened, closed = r.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div class='{holder}'>", "</div>"), (f"<div id={holder}><div>", "</div></div>"), (f"<article class='{holder}'>", "</article>"), ("<div>", "</div>"), ("", ""), ("<section>", "</section>"), ("<table><tr><td>", "</td></tr></table>")])
    heading = r.choice(["<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>" if "article" in opened else "<h1>{}</h1>", ""]).format(r.choice(SENTENCES))
    parts = [("<html><body>", False), *((_furniture(r), False) for _ in range(r.randint(1, 4))), (opened, False), (heading, True)]
    for _ in range(r.randint(2, 7)):
        parts.append((_block(r), True))
        if r.random() < 0.4:
            parts.append((_furniture(r, True), False))
    if r.random() < 0.4:
        parts.append((f"<p>{r.choice(['Why?', 'Gone.', 'Not yet.', 'Last.'])}</p>", True))
    if r.random() < 0.3:  # comments inside the article's own element
        parts.append((f"<section class='{r.choice(['comments', 'discussion', 'replies', 'reader-comments'])}'><p>{r.choice(SENTENCES)}</p><p>{r.choice(SENTENCES)}</p></section>", False))
    parts += [(closed, False), *((_furniture(r), False) for _ in range(r.randint(1, 4))), ("</body></html>", False)]
    return parts


def pages(n: int = 1200, seed: int = 5) -> list[list[tuple[str, bool]]]:
    r = random.Random(seed)
    return [page(r) for _ in range(n)]
