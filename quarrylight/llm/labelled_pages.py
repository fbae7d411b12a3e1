"""Hand-made labelled pages (html, main text) that fit the extraction weights."""

_P = "Water runs down the old stone steps and gathers in a wide basin where birds come to drink each morning."
_Q = "The keeper of the garden writes down every visitor and the hour at which they leave by the north gate."
_R = "Nobody remembers who built the wall, but the letters cut into it have been copied many times since."
_LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("home", "news", "maps", "archive", "contact", "about us"))

PAGES = [
    (f"<html><head><title>Steps</title></head><body><nav><ul>{_LINKS}</ul></nav><article><h1>Steps</h1><p>{_P}</p><p>{_Q}</p></article><footer>Printed in the valley.</footer></body></html>", f"Steps\n{_P}\n{_Q}"),
    (f"<body><header><h2>The Valley Post</h2></header><main><h1>Walls</h1><p>{_R}<p>{_P}<ul><li>{_Q}</li></ul></main><aside><p>Read this next: a shop for seeds and pots.</p></aside></body>", f"Walls\n{_R}\n{_P}\n{_Q}"),
    (f'<body><div id="menu"><ul>{_LINKS}</ul></div><div class="content"><h1>Gate</h1><p>{_Q}</p><blockquote>{_R}</blockquote></div><div class="comments"><p>I liked this very much indeed.</p><p>So did I, and my aunt too.</p></div></body>', f"Gate\n{_Q}\n{_R}"),
    (f'<body><div><a href="/a">Seeds</a> <a href="/b">Pots</a> <a href="/c">Tools</a></div><div><p>{_P}</p><p>{_R}</p></div><div class="ad">Buy two pots and get one for free today.</div><div><a href="/x">Imprint</a> <a href="/y">Privacy</a></div></body>', f"{_P}\n{_R}"),
    (f'<body><article><h1>Basin</h1><p>{_P}</p><div class="advert">Seeds for less at the market.</div><p>{_R}</p><form><label>Your mail</label><input></form></article><div>All rights with the valley.</div></body>', f"Basin\n{_P}\n{_R}"),
    (f"<table><tr><td><a href='/1'>One</a></td><td><a href='/2'>Two</a></td></tr></table><table><tr><td><p>{_Q}</p><p>{_P}</p></td></tr></table>", f"{_Q}\n{_P}"),
]

# Class names seen on pages, by what the block that carries them holds; each makes a labelled page of its own.
ASIDE_NAMES = (
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert warning sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer masthead comment comments respond replies disqus share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay paywall widget skip hidden contentinfo complementary search toc"
).split()
TEXT_NAMES = "content article post entry story main body text page prose section chapter paragraph summary lead".split()

_SHORT = "Seeds for less at the market, and more of them each week."
PAGES += [(f'<body><div class="{name}">{_SHORT}</div><div><h1>Wall</h1><p>{_P}</p><p>{_R}</p></div></body>', f"Wall\n{_P}\n{_R}") for name in ASIDE_NAMES]
PAGES += [(f'<body><div><a href="/a">Seeds</a> <a href="/b">Pots</a></div><div class="{name}"><h1>Gate</h1><p>{_Q}</p><p>{_P}</p></div></body>', f"Gate\n{_Q}\n{_P}") for name in TEXT_NAMES]
