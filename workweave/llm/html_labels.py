"""Labelled pages: a block whose text holds MAIN is main text, any other is not.

A dozen pages are written out. The others are layouts filled with invented words of varying number:
marks (classes, ids and elements that usually hold no main text) that are right, marks that mislead,
and blocks without any mark that only their links and neighbours tell apart.
"""

from __future__ import annotations

from random import Random

MAIN = "§"
#: Pages made of each layout.
EACH = 14

WRITTEN = (
    """<html><head><title>Harbour report</title></head><body><nav><ul><li><a href="/">Home</a></li>
    <li><a href="/n">News</a></li><li><a href="/a">About us</a></li></ul></nav>
    <div class="ad">Buy two lamps and get the third one free this week only.</div>
    <article><h1>Harbour opens again§</h1><p>The harbour opened again on Monday after two weeks of
    repairs to the northern quay and its cranes.§</p><p>Boats came in.§</p><p>Most of the crews had
    waited outside the bay, and some of them had gone on to the next port in the meantime.§</p>
    <p>All is well.§</p></article><footer>&copy; 2020 Harbour Press &middot; All rights reserved
    </footer></body></html>""",
    """<body><header><a href="/">The Daily Field</a><p>News since 1901</p></header><main><h1>A dry
    spring§</h1><p>Farmers in the valley say that the spring has been the driest in thirty years and
    that the wells are low.§</p><h2>What now§</h2><p>Rain is not expected before June.§</p><ul><li>
    Water is rationed§</li><li>Cattle are moved§</li></ul></main><aside><h3>Most read</h3><ul><li>
    <a href="1">Ten soups for cold days</a></li><li><a href="2">The old mill is sold</a></li></ul>
    </aside><form><p>Leave us your address and we will write to you every Friday.</p></form></body>""",
    """<div id="menu"><a href="1">Start</a> <a href="2">Shop</a> <a href="3">Contact</a></div>
    <div id="content"><h1>How to bind a book§</h1><p>You need thread, a needle, some thick paper and
    a good knife, and you need an hour without anybody who calls you away from the table.§</p><p>Fold
    every sheet once and press the fold with the back of the knife until it stays shut by itself.§
    </p><p>Sew the folds together and glue the back, then leave the book under a stone for a night.§
    </p></div><div class="sidebar"><p>Our book of the month tells the story of a binder in Leipzig
    who lost a library.</p></div><div class="footer">Imprint and privacy</div>""",
    """<body><div class="cookie-notice"><p>We use cookies to make this site better for you and for
    everyone who comes after you.</p></div><div class="header"><p>Welcome</p></div><article><h1>A
    short walk§</h1><p>We went up the hill before breakfast and saw the sea from the top, far and
    grey and still.§</p><p>Then home.§</p><div class="related"><p>Read also what our reader wrote
    about the long walk along the river last year.</p></div></article><section class="comments"><h2>
    Comments</h2><p>I walked there too when I was young and I remember a small house on the hill.</p>
    <p>Nice.</p></section></body>""",
    """<table><tr><td><a href="a">One</a></td><td><a href="b">Two</a></td></tr></table><p>The
    committee met on the third of May and agreed that the bridge must be closed to carts from now
    on.§</p><p>It also agreed to ask the county for money, since the town has none left this year.§
    </p><p><a href="x">Back</a> | <a href="y">Next</a></p><p>Copyright by the town</p>""",
    """<body><nav class="top">Menu</nav><article><header><h1>Letters from the north§</h1></header>
    <p>Snow fell for nine days and the mail did not come, so we read the old letters again.§</p>
    <blockquote>Nothing here is as cold as the morning.§</blockquote><p>Yes.§</p><p>On the tenth day
    the sledge came through with bread, coal and a bag of new letters for all of us.§</p><div
    class="share"><a href="s">Share</a> this page with friends</div></article><footer><p>Made with
    care by three people in a small room above the bakery of our town.</p></footer></body>""",
    """<div role="navigation"><ul><li><a href="1">Maps</a></li><li><a href="2">Tides</a></li></ul>
    </div><h1>Tides in April§</h1><p>High water comes at noon on the first day of the month and about
    fifty minutes later on every further day.§</p><p>Low water follows about six hours after it, and
    the sand is safe for an hour on either side.§</p><p><a href="1">More tides</a></p>""",
    """<body><div class="promo">Half price on all chairs and tables until the end of the month, as
    long as we have them.</div><main><p>The recipe is old and takes two days, but most of that time
    the dough rests and you do as well.§</p><p>Mix.§</p><p>Wait.§</p><p>Bake it hot and let it cool
    on a rack before you cut the first slice from it.§</p></main><div class="newsletter">Sign up and
    never miss a recipe again, it is free and you can leave whenever you like.</div></body>""",
    """<article><h1>Night trains§</h1><p>Night trains are back on the line to the coast, with seats
    in every carriage and beds in two of them.§</p><p>Book early.§</p></article>""",
    """<body><article><p><a href="w">The wind mill of Aldern</a> was built in 1790 and
    <a href="b">burned down</a> in the year of the flood.§</p><p><a href="r">A full report can be
    found here§</a></p><ul><li><a href="p">Plan of the mill§</a></li><li><a href="m">Map§</a></li>
    </ul><p>It was never built again.§</p></article></body>""",
    """<div class="nav"><a href="1">Top</a></div><p>This page is about a lake in the hills that no
    road reaches, and about the people who row there in summer.§</p><p>There are nine houses on its
    shore and a chapel on the only island, to which the priest comes once a year.§</p>""",
    """<body><main><p>Notes§</p><p>Sugar, flour, two eggs.§</p></main></body>""",
)

_WORDS = ("stone river early under morning window paper never between garden letter winter small "
          "carry silver across mountain evening answer bridge little village harbour question "
          "summer before animal colour corner distance forest great kitchen market people").split()
# Marks that are right for parts beside the main text, and some that are not for it
BESIDE = ("ad", "advert-box", "sidebar", "newsletter", "related", "cookie-notice", "promo", "footer",
          "social-links", "site-banner", "login")
MISLEADING = ("content right-sidebar", "post related-work", "promotion", "social-policy",
              "share-price", "article-with-comments", "alerts-free", "category-social",
              "page sidebar-left", "story promo-free", "news-alerts", "commented")


class _Writer:
    def __init__(self, seed: int):
        self.rng = Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join(self.rng.choices(_WORDS, k=self.rng.randint(low, high)))

    def links(self, low: int, high: int, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='x'>{self.words(1, 4)}</a></{tag}>"
                       for _ in range(self.rng.randint(low, high)))

    def main(self, low: int = 2, high: int = 6, tag: str = "") -> str:
        """Paragraphs of main text, short ones among them, and now and then a heading. Within an
        element of a name for main text they may end with a short one."""
        parts = [f"<p>{self.words(12, 60)}{MAIN}</p>"]
        for _ in range(self.rng.randint(low, high) - 1):
            parts.append(self.rng.choice((
                f"<p>{self.words(12, 60)}{MAIN}</p>", f"<p>{self.words(8, 30)}{MAIN}</p>",
                f"<p>{self.words(1, 5)}{MAIN}</p>",
                f"<p>{self.words(5, 20)} <a href='y'>{self.words(1, 4)}</a> {self.words(3, 9)}{MAIN}</p>",
                f"<h2>{self.words(1, 5)}{MAIN}</h2><p>{self.words(10, 40)}{MAIN}</p>")))
        head = self.rng.choice(("", f"<h1>{self.words(2, 8)}{MAIN}</h1>"))
        end = self.words(*self.rng.choice(((1, 2), (1, 6), (10, 40)) if tag in ("article", "main") else ((10, 40),)))
        text = head + "".join(parts) + f"<p>{end}{MAIN}</p>"
        return f"<{tag}>{text}</{tag}>" if tag else text

    def beside(self) -> str:
        mark = self.rng.choice(BESIDE)
        kind = self.rng.choice(("class", "id"))
        return f"<div {kind}='{mark}'>{self.rng.choice(('', '<p>'))}{self.words(3, 25)}</div>"

    def frame(self, inside: str) -> str:
        """With a menu and an end, marked or not."""
        menu = self.rng.choice((f"<nav><ul>{self.links(3, 8)}</ul></nav>", f"<ul>{self.links(3, 8)}</ul>",
                                f"<div class='menu'>{self.links(3, 6, 'span')}</div>", ""))
        end = self.rng.choice((f"<footer>{self.words(2, 25)}</footer>", "",
                               f"<p><a href='a'>{self.words(1, 1)}</a> | <a href='b'>{self.words(1, 1)}</a></p>"))
        return f"<body>{menu}{inside}{end}</body>"

    def pages(self) -> list[str]:
        mark = self.rng.choice(MISLEADING)
        box = self.rng.choice(("div", "section", "article", "main"))
        named = f"<{box} {self.rng.choice(('class', 'id'))}='{mark}'>"
        comments = "".join(f"<article class='comment'><p>{self.words(2, 40)}</p></article>"
                           for _ in range(self.rng.randint(1, 5)))
        return [
            self.frame(f"{self.beside()}{self.main(tag='article')}"),
            self.frame(f"{self.main(tag='main')}<aside><h3>{self.words(1, 3)}</h3><ul>"
                       f"{self.links(2, 5)}</ul><p>{self.words(5, 25)}</p></aside>"),
            self.frame(f"<header><p>{self.words(2, 9)}</p></header><div>{self.main()}</div>{self.beside()}"),
            self.frame(f"{named}{self.main()}</{box}>"),
            self.frame(f"{named}{self.main(4, 8)}{self.beside()}</{box}>"),
            self.frame(f"{named}{self.main(5, 9)}</{box}><aside><p>{self.words(20, 60)}</p></aside>"
                       f"{self.beside()}"),
            self.frame(f"{self.main(5, 9, 'article')}<div id='comments'>"
                       f"<p>{self.words(2, 40)}</p><div><p>{self.words(10, 60)}</p></div></div>"),
            self.frame(f"<article><p>{self.words(6, 14)}{MAIN}</p><p>{self.words(6, 14)}{MAIN}</p></article>"
                       f"<section class='comments'><article class='comment'><p>{self.words(2, 14)}</p>"
                       f"</article></section>{self.beside()}"),
            self.frame(f"{self.beside()}<main><p>{self.words(10, 25)}{MAIN}</p></main>"
                       f"<div class='comment-list'><p>{self.words(2, 12)}</p></div>"),
            self.frame(f"<div><p>{self.words(8, 14)}{MAIN}</p><p>{self.words(8, 14)}{MAIN}</p></div>"
                       f"<form><p>{self.words(3, 9)}</p></form>{self.beside()}"),
            f"{named}<p>{self.words(2, 9)}{MAIN}</p><p>{self.words(2, 9)}{MAIN}</p></{box}>",
            self.frame(f"<form action='z'>{self.main()}</form>"),
            self.frame(f"{self.main(tag='article')}<form><p>{self.words(5, 25)}</p></form>"),
            self.frame(f"{self.main(4, 8, 'article')}<section class='comments'>"
                       f"<h2>{self.words(1, 2)}</h2>{comments}</section>"),
            self.frame(f"<article>{self.main(3, 7)}<div class='share'>{self.links(1, 3, 'p')}</div>"
                       f"<div class='related'><p>{self.words(5, 25)}</p></div></article>"),
            self.frame(f"<div>{self.main(3, 7)}</div><ul>{self.links(4, 8)}</ul>"
                       f"<p>{self.words(2, 4)}</p><ul>{self.links(2, 5)}</ul>"),
            self.frame(f"<div><p>{self.words(15, 40)}{MAIN}</p><p><a href='r'>{self.words(4, 9)}{MAIN}</a></p>"
                       f"<p>{self.words(15, 40)}{MAIN}</p></div>"),
            f"<body><ul>{self.links(4, 9)}</ul></body>",
            f"<body><nav>{self.links(2, 6, 'p')}</nav><footer>{self.words(3, 25)}</footer></body>",
            f"<body><table><tr>{self.links(2, 5, 'td')}</tr></table>{self.main()}</body>",
            f"<p>{self.words(3, 9)}{MAIN}</p><p>{self.words(3, 20)}{MAIN}</p>",
        ]


PAGES = (*WRITTEN, *(page for seed in range(EACH) for page in _Writer(seed).pages()))
