"""Labelled pages from which the extraction weights are learned.

The pages are made from layouts: ways to hold the content, menus, headers, notices, adverts and comments,
combined in turn. Main content stands in elements marked ``data-main``; what stands within them and
isn't content is marked ``data-aside``; all other text is boilerplate. Texts are invented.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

_WORDS = "the path begins behind an old mill and follows slow water for three miles before it climbs to a meadow where herons stand in spring rain came early this year and growers report good harvests".split()

#: Ways in which pages hold their content: what begins and ends it.
HOLDERS = (
    ("<article data-main>", "</article>"), ("<main data-main>", "</main>"), ("<main><article data-main>", "</article></main>"), ("<div data-main class='content'>", "</div>"), ("<div data-main id='main'>", "</div>"),
    ("<div data-main class='post'>", "</div>"), ("<div class='page-wrapper'><div data-main class='entry-content'>", "</div></div>"), ("<section data-main class='story'>", "</section>"), ("<div data-main>", "</div>"),
    ("<table><tr><td data-main class='text'>", "</td></tr></table>"), ("<div class='container'><div class='row'><div data-main class='main-content'>", "</div></div></div>"), ("<div data-main id='article-body'>", "</div>"),
    ("<div data-main class='post-content'>", "</div>"), ("<div data-main class='page-content'>", "</div>"), ("<article data-main class='article'>", "</article>"), ("<div data-main class='story-body'>", "</div>"),
)
#: Elements within content that are content as well.
CONTENT = (
    "<h2 class='section-header'>{}</h2><p>{}</p>", "<ul><li>{}</li><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>", "<table><tr><th>{}</th><td>{}</td></tr></table>", "<div class='section-header'><h3>{}</h3></div><p>{}</p>",
    "<figure><img><figcaption>{}</figcaption></figure>", "<p class='lead'>{}</p>", "<div class='text-block'><p>{}</p></div>", "<section><h2>{}</h2><p>{}</p></section>", "<ol><li>{}</li></ol><p><a href='/x'>{}</a> {}</p>", "<div class='box-inner'>{}</div>",
    "<dl><dt>{}</dt><dd>{}</dd></dl>", "<div class='list-item'><p>{}</p></div>", "<pre>{}</pre>", "<div class='content-wrapper'><p>{}</p></div>", "<div class='left-col'><p>{}</p></div>", "<p class='intro'>{}</p>", "<div class='top-section'><p>{}</p></div>",
    "<div class='article-header'><p>{}</p></div>", "<div class='entry-header'><p>{}</p></div>", "<details><summary>{}</summary>{}</details>",
)
#: Elements that never hold content.
TAGS = ("nav", "footer", "aside", "form", "menu", "button", "dialog", "label", "fieldset")
#: Values of class, id or role that mark boilerplate.
NAMES = (
    "ad ads adv advert adverts advertisement advertising adsense adbox ad-box ad-container ad-wrapper ad-banner ad-slot ad-unit google-ads alert banner banner-top breadcrumb breadcrumbs breadcrumb-list byline comment comments"
    " comment-list comments-area comment-item comment-section comments-section comment-form comment-body commentlist commentform user-comments reader-comments complementary contentinfo consent cookie cookies cookie-banner"
    " cookie-notice cookie-consent cookie-bar discussion discussion-area disqus disqus-thread disclaimer feedback feedback-form footer site-footer page-footer footer-links footer-nav footer-bottom footerlinks gdpr header site-header"
    " page-header header-top header-inner login login-form masthead menu main-menu menu-list menu-item top-menu mainmenu modal modal-dialog nav main-nav nav-list nav-menu site-nav topnav navmenu navbar navigation main-navigation"
    " newsletter newsletter-form newsletter-signup newsletter-box notice notices outbrain pager pagination pagination-links paywall popup popup-overlay promo promo-box promotion reactions recommended recommended-articles related"
    " related-posts related-articles related-links relatedposts replies reply-list respond search search-box search-form share share-buttons share-bar sharing sharebar side-bar sidebar left-sidebar right-sidebar sidebar-widget sidebar-left"
    " signup signup-form skip skip-link social social-links social-share social-icons social-media sponsor sponsored sponsored-content sponsored-links subscribe subscribe-form subscription taboola teaser toc toolbar topbar top-bar bottom-bar"
    " widget widget-area site-notice site-title site-logo copyright legal-links"
).split()
#: Those that mark a paragraph.
PARAGRAPHS = "ad ads advert advertisement copyright cookie-notice disclaimer newsletter promo sponsored subscribe comment".split()


def _texts(seed: int) -> Iterator[str]:
    for k in count(seed):
        n = 5 + k * 7 % 11
        yield " ".join(_WORDS[(k * 5 + i * (1 + k % 3)) % len(_WORDS)] for i in range(n)).capitalize() + "."


def _filled(form: str, texts: Iterator[str]) -> str:
    while "{}" in form:
        form = form.replace("{}", next(texts), 1)
    return form


def labelled_pages(n: int = 4 * len(NAMES)) -> list[str]:
    """``n`` pages; each layout part comes in several of them, in several company."""
    pages = []
    for k in range(n):
        texts = _texts(k)
        pick = lambda options, step: options[(k * step + k // len(options)) % len(options)]
        begin, end = pick(HOLDERS, 1)
        kind = ("class", "id", "class", "role")[k % 4]
        boxes = [f"<{t} {kind}='{name}'{{}}><p>{next(texts)}</p><ul><li><a href='/a'>{next(texts)}</a></li></ul></{t}>" for t, name in (("div", pick(NAMES, 1)), ("section", pick(NAMES, 3)), ("ul", pick(NAMES, 7)))]
        tags = [f"<{t}{{}}><a href='/b'>{next(texts)}</a> {next(texts)}</{t}>" for t in (pick(TAGS, 1), pick(TAGS, 2))]
        made = "<main" in begin or "<article" in begin  # of elements made for content
        top = f"<header><a href='/'>{next(texts)}</a><p>{next(texts)}</p></header>" if k % 3 else f"<div>{next(texts)}</div>" * made
        head = f"<header{' class=entry-header' * (not made)}><h1>{next(texts)}</h1></header>" if k % 2 == made else f"<header><h1>{next(texts)}</h1></header>" if made and k % 5 else f"<h1>{next(texts)}</h1>"
        body = [head, f"<p>{next(texts)} {next(texts)}</p>", _filled(pick(CONTENT, 1), texts), f"<p>{next(texts)} {next(texts)}</p>", _filled(pick(CONTENT, 2), texts), f"<p>{next(texts)} {next(texts)} {next(texts)}</p>"]
        within = [boxes[2].replace("{}", " data-aside"), tags[1].replace("{}", " data-aside"), f"<p data-aside class='{pick(PARAGRAPHS, 1)}'>{next(texts)}</p>"]
        body[4:4] = within[k % 3 : k % 3 + 1]
        if k % 5 == 0:
            body.append(f"<footer data-aside>{next(texts)}</footer>")
        after = f"<p>{next(texts)}</p>" * (k % 4 == 1 and made)
        pages.append(f"<html><body>{top}{tags[0].replace('{}', '')}{boxes[0].replace('{}', '')}{begin}{''.join(body)}{end}{after}{boxes[1].replace('{}', '')}<footer>{next(texts)}</footer></body></html>")
    return pages
