"""The small labelled table of the block classifier: invented pages whose main blocks carry ``data-main``."""

_LOREM = (
    "The harbour office reported on Monday that the old lighthouse will be repaired before the winter storms arrive.",
    "Engineers measured the tower twice. They found cracks near the top, but the foundation is sound and needs no work at all this year.",
    "Residents had asked for the repair since the lamp failed in spring; fishing boats now rely on a weaker signal farther along the coast.",
    "Costs are shared by three councils. The largest part, according to the plan, will be spent on stone that matches the original quarry.",
    "A short line ends it.",
    "Stir the flour into the butter and wait until it smells of nuts, then add the milk slowly. Keep stirring while it thickens.",
)


def _p(i: int, n: int = 1, tag: str = "p") -> str:
    return f"<{tag} data-main>{' '.join(_LOREM[(i + k) % len(_LOREM)] for k in range(n))}</{tag}>"


def _list(*names: str, cls: str = "") -> str:
    return f"<ul{cls}>" + "".join(f'<li><a href="/{x}">{x}</a></li>' for x in names) + "</ul>"


_NAV = "<nav>" + _list("Home", "News", "Sport", "Weather", "Contact us") + "</nav>"
_ADVERT = '<div class="ad">Buy two pairs of boots and get the third one free. Only this week in every store.</div>'
_FOOT = '<footer><p>Copyright 2020 The Harbour Post. All rights reserved.</p>' + _list("Terms", "Privacy", "Imprint") + "</footer>"
_COOKIE = '<div id="cookie-notice"><p>We use cookies to improve this site. By going on you accept our policy.</p><button>Accept</button></div>'
_SIDE = '<aside><h3>Most read</h3>' + _list("Ferry late again", "Mayor opens the new school", "Ten walks by the sea") + "<p>Sign up to get our letter every Friday morning.</p></aside>"
_COMMENTS = '<section class="comments"><h2>Comments</h2><div class="comment"><p>I have waited for this for years. Great news for all of us who sail here at night.</p></div><div class="comment"><p>Who pays for it in the end? I read that taxes will rise again. The council should say so.</p></div></section>'
_FORM = '<form action="/s"><label>Search this site for words</label><input name="q"></form>'

_SHORTER = (
    "The ferry was late again on Sunday, and nobody said why.",
    "Most of them went home. A few waited until the evening.",
    "It had rained for nine days before the river rose over the road.",
    "The mayor will speak about it next week. Until then the bridge stays closed for all cars.",
    "She found the letter in a box of old maps.",
)


def _s(i: int, n: int = 1) -> str:
    return "".join(f"<p data-main>{_SHORTER[(i + k) % len(_SHORTER)]}</p>" for k in range(n))


_END = {
    "line": "<p data-main>Why</p><p data-main>Because</p><p data-main>It is so</p>",
    "code": "<p data-main>Call it like this:</p><pre data-main>print(1)</pre>",
    "items": "<ul><li data-main>butter</li><li data-main>flour</li><li data-main>salt and pepper</li></ul>",
    "caption": "<figure><img src='a.png'><figcaption data-main>The tower in spring</figcaption></figure>",
    "unspaced": "<p data-main>灯台は冬の嵐が来る前に修理される予定です。</p><p data-main>漁船は今、海岸の先にある弱い信号に頼っています。</p>",
    "table": "<table><tr><td data-main>Height</td><td data-main>31</td></tr><tr><td data-main>Steps</td><td data-main>140</td></tr></table>",
    "sign": "<p data-main>Thank you for reading</p>",
}
_OPAQUE = "<div class='x1'><div class='x2'>Three people said</div><div class='x3'><b>Ann Lee</b><p>Great post! I sail there every week and never saw that crack.</p></div><div class='x3'><b>Tom</b><p>Who pays for it in the end?</p></div><div class='x3'><b>sea_rose</b><p>Thank you. Please write more about the quarry, it was closed when I was a child.</p></div></div>"
_OPAQUE_LAST = "<ul class='k7'>" + "".join(f"<li class='k8'><p>{x}</p><span>{who}, an hour ago</span></li>" for x, who in ((_LOREM[0], "Bo"), (_LOREM[2], "Kim"), (_LOREM[1], "Jo"))) + "</ul>"
_STEPS = "".join(f"<div class='s' data-main><b>Step {i}</b><p>{x}</p></div>" for i, x in ((1, _LOREM[5]), (2, _LOREM[1]), (3, _LOREM[0])))

#: Layouts by semantic elements, by class names, without either, short and long, with lists and headings.
PAGES = (
    f"<body>{_NAV}{_ADVERT}<article><h1 data-main>Lighthouse to be repaired</h1>{_p(0)}{_p(1)}{_p(2)}{_p(4)}</article>{_FOOT}</body>",
    f"<body>{_NAV}<article><h1 data-main>Storm</h1>{_p(4)}</article>{_FOOT}</body>",
    f"<body>{_NAV}{_ADVERT}<article><h1 data-main>Of the sea and the wind</h1>{_p(4)}{_p(0)}</article>{_FOOT}</body>",
    f"<body>{_COOKIE}<header><h1>The Harbour Post</h1>{_list('Home', 'About')}</header><main><h2 data-main>Repair begins</h2>{_p(2, 2)}{_p(3)}<h3 data-main>Costs</h3>{_p(3, 3)}</main>{_SIDE}{_COMMENTS}{_FOOT}</body>",
    f"<body><div id='menu'>{_list('Start', 'Recipes', 'Shop')}</div><div id='content'><h1 data-main>White sauce</h1>{_p(5, 2)}<ul><li data-main>two spoons of butter</li><li data-main>two spoons of flour</li><li data-main>half a litre of milk, warm</li></ul>{_p(5)}</div><div class='sidebar'><h3>Our shop</h3><p>Pans and pots at low prices, sent to you within two days or money back.</p></div>{_FORM}<div id='footer'>Made by cooks. Write to us.</div></body>",
    f"<body><table><tr><td>{_list('One', 'Two', 'Three')}</td><td>{_p(0, 2)}{_p(2, 2)}{_p(1)}</td></tr></table><p><a href='/a'>Back to start</a> | <a href='/b'>Next page</a></p><p>Last changed 2004</p></body>",
    f"<body>{_list('Front page', 'World', 'Money', 'Life')}<div><h1 data-main>Quarry opens again</h1><div data-main>{_LOREM[3]} {_LOREM[2]}</div><div data-main>{_LOREM[1]} {_LOREM[0]}</div><div data-main>{_LOREM[0]}</div></div><div class='related'><h4>More like this</h4>{_list('Stone of the north', 'Old roads')}</div><div class='share'>Share this with your friends</div></body>",
    f"<body>{_NAV}<main><article><header><h1 data-main>A longer day</h1></header>{_p(1, 3)}<blockquote data-main>{_LOREM[2]}</blockquote>{_p(0, 2)}<aside class='promo'><p>Read also our report on the ferries and why they are late. It costs nothing.</p></aside>{_p(3)}<div class='tags'>{_list('sea', 'stone')}</div></article>{_COMMENTS}</main>{_SIDE}{_FOOT}</body>",
    f"<body>{_COOKIE}{_NAV}<article>{_p(2)}{_p(4)}{_p(4)}</article><div class='newsletter'><p>Get the news by mail every morning before seven. No charge, and you can leave whenever you like.</p></div>{_FOOT}</body>",
    f"<body><div class='banner notice'>Our office is closed on Friday.</div>{_NAV}<div class='post'><h2 data-main>How we measured</h2>{_p(1)}{_p(0)}<p data-main>See the <a href='/x'>full table</a> for all heights, which we took at noon and again at dusk.</p></div><div id='comments'><h3>Two replies</h3><p>Nice work, thank you for the table. I will use it in my class next week.</p></div>{_FOOT}</body>",
    f"<body>{_NAV}{_ADVERT}<article><h1 data-main>Wind</h1><p data-main>It blows.</p><p data-main>And it rains</p></article>{_FOOT}</body>",
    f"<body>{_NAV}<h1>The Post</h1><p><a href='/1'>Bridge closed for a month</a></p><p><a href='/2'>New school opens its doors</a></p><p><a href='/3'>Rain until Sunday</a></p>{_FOOT}</body>",
    # One-word paragraphs inside long ones, and links right before or after the article.
    f"<body>{_NAV}{_ADVERT}<article><h1 data-main>Now</h1><p data-main>Yes.</p>{_p(0)}<p data-main>No.</p>{_p(1, 2)}<p data-main>So.</p><p data-main>Then.</p>{_p(3)}</article>{_FOOT}</body>",
    f"<body>{_NAV}<article>{_p(3, 4)}<p data-main>Well.</p>{_p(0, 5)}</article><ul><li><a href='/1'>Next</a></li><li><a href='/2'>Back</a></li></ul></body>",
    f"<body><article><h1 data-main>Ice</h1><p data-main>Cold.</p>{_p(2)}<p data-main>Out</p></article>{_FOOT}</body>",
    f"<body><p><a href='/'>Start</a></p><div>{_p(0, 3)}<p data-main>Why?</p>{_p(2, 2)}<p data-main>Nobody knows.</p></div><p><a href='/n'>Next</a></p></body>",
    f"<body>{_list('A', 'B', 'C')}<main><h1 data-main>Ten</h1><p data-main><a href='/s'>Source of this text</a></p>{_p(1)}<p data-main>Tea.</p>{_p(5)}</main>{_list('D', 'E')}<p>Terms apply</p></body>",
    f"<body><div>{_list('Inbox', 'Help')}</div><div><h2 data-main>Grain</h2>{_p(3)}<p data-main>Rye.</p>{_p(3, 2)}</div><div><a href='/u'>Up</a> <a href='/d'>Down</a></div></body>",
    f"<body>{_NAV}{_ADVERT}<article><h1 data-main>Ash</h1><p data-main>Dust</p></article>{_FOOT}</body>",
    f"<body>{_NAV}<article><h1 data-main>{_LOREM[4]}</h1>{_p(0, 6)}{_p(2, 6)}</article>{_COMMENTS}{_FOOT}</body>",
    # Nothing around the article.
    f"<body><article><h1 data-main>Tide</h1>{_p(0)}{_p(1)}</article></body>",
    f"<body>{_p(2)}</body>",
    f"<body>{_NAV}<main>{_p(5)}<p data-main>Serve.</p></main></body>",
    f"<body><div>{_p(1, 2)}{_p(3)}<p data-main>End of it.</p></div></body>",
    # Names of regions on wrappers of the whole page, forms around everything, and paragraphs with such names.
    f"<body>{_NAV}<div class='layout with-sidebar'><article><h1 data-main>Reeds</h1>{_p(0)}{_p(2)}</article>{_SIDE}</div>{_FOOT}</body>",
    f"<body><div class='page header-fixed'>{_NAV}<div class='content-with-rail'><h1 data-main>Slate</h1>{_p(1)}{_p(3)}<p data-main>Cut by hand.</p></div><div class='rail'><h3>More</h3>{_list('Lime', 'Clay')}<p>Get our letter with news of stone.</p></div></div>{_FOOT}</body>",
    f"<body><form id='aspnetForm' action='/'><div>{_list('Start', 'Map')}</div><div class='main-content'><h1 data-main>Tides</h1>{_p(2)}{_p(0, 2)}{_p(3)}</div><div id='footer'>Made in the north.</div></form></body>",
    f"<body class='has-sidebar'><div id='form1' class='form-wrapper nav-open'><h1 data-main>Moss</h1>{_p(0, 2)}{_p(5)}</div><div class='search'><label>Search</label></div></body>",
    f"<body>{_NAV}<article><h1 data-main>Oats</h1><p class='tags-intro' data-main>{_LOREM[2]} {_LOREM[0]}</p>{_p(1)}<p class='share-note'>Share this</p><p class='tags'><a href='/o'>oats</a> <a href='/f'>fields</a></p></article>{_FOOT}</body>",
    f"<body>{_NAV}<main><h1 data-main>Kelp</h1><p class='related-question' data-main>{_LOREM[5]}</p>{_p(3)}<p class='copyright'>Copyright 2021 The Harbour Post</p></main>{_FOOT}</body>",
    f"<body><div class='sidebar-left layout'><div class='sidebar-left-inner'><article>{_p(1, 2)}{_p(2)}</article></div></div>{_FOOT}</body>",
    f"<body><div class='widget-area notice-board'><main><h1 data-main>Rope</h1>{_p(3)}{_p(4)}</main></div><div class='notice'><p>The shop is closed on Monday and opens again on Tuesday at nine.</p></div></body>",
    # Linked paragraphs and link lists inside the article.
    f"<body>{_NAV}<article><h1 data-main>Sources</h1>{_p(0)}<p data-main><a href='/r'>{_LOREM[1]}</a></p>{_p(2)}<p data-main><a href='/q'>The full report of the council</a></p></article>{_FOOT}</body>",
    f"<body>{_NAV}<article><h1 data-main>Links</h1>{_p(3)}<ul><li data-main><a href='/1'>Plan of the tower</a></li><li data-main><a href='/2'>Costs of the stone, by year</a></li></ul><p data-main><a href='/z'>Read on at the library</a></p>{_p(0)}</article>{_SIDE}{_FOOT}</body>",
    f"<body>{_ADVERT}<main><h1 data-main>A list</h1><ol><li data-main>{_LOREM[4]}</li><li data-main><a href='/k'>Keep the lamp dry</a></li><li data-main>Oil</li></ol>{_p(5)}</main>{_COMMENTS}</body>",
    # Articles that are teasers or comments; long comments after a short text.
    f"<body>{_NAV}<article><h1 data-main>Gulls</h1>{_p(1)}{_p(0)}</article><aside><article><h3>Ferry late again</h3><p>Passengers waited for two hours on the pier, and no one told them why.</p></article><article><h3>Walks</h3><p>Ten walks by the sea for days without rain, all of them short.</p></article></aside>{_FOOT}</body>",
    f"<body>{_NAV}<main><article><h1 data-main>Nets</h1>{_p(3)}</article><div class='comments'>" + "".join(f"<article class='comment'><p>{x}</p></article>" for x in (_LOREM[0], _LOREM[2], _LOREM[1])) + f"</div></main>{_FOOT}</body>",
    f"<body>{_NAV}<div class='post'><h1 data-main>Salt</h1>{_p(4)}{_p(0)}</div><div id='comments' class='comment-list'>" + "".join(f"<div class='comment'><p>{x} {y}</p></div>" for x, y in zip(_LOREM, _LOREM[1:])) + f"</div>{_FOOT}</body>",
    f"<body>{_NAV}<main><h1 data-main>Today</h1>{_p(2, 2)}</main><div class='related'><article class='card'><h4>Bridge closed</h4><p>For a month nobody can cross the river here, says the council.</p></article></div>{_FOOT}</body>",
    f"<body>{_NAV}<article><h1 data-main>Ducks</h1><p data-main>They swim.</p><div class='newsletter'><p>Get the news by mail every morning before seven. No charge at all.</p></div><p data-main>They also fly.</p>{_p(2)}<div class='ad'>Boots for half the price, this week only in our store by the pier.</div>{_p(1)}</article>{_FOOT}</body>",
    f"<body>{_COOKIE}{_NAV}<article><header><h1 data-main>Fog</h1><p data-main>{_LOREM[4]}</p></header>{_p(0)}<footer><p>Written by the harbour desk</p></footer></article>{_COMMENTS}{_FOOT}</body>",
    f"<body>{_NAV}<article><h1 data-main>Ports</h1>{_p(2)}<p data-main><a href='/p'>{_LOREM[0]}</a></p>{_p(3)}</article></body>",
    f"<body>{_NAV}<main><h1 data-main>Piers</h1>{_p(0)}<p data-main><a href='/p'>{_LOREM[1]}</a></p>{_p(4)}</main></body>",
    # Articles that end in short blocks, code, items, captions and scripts without spaces, at the end of the page or not.
    *(f"<body>{_NAV}<{tag}><h2 data-main>Oak and elm</h2>{body}{end}</{tag}>{behind}</body>" for end in _END.values() for tag, body, behind in (("main", "", ""), ("article", _p(0), ""), ("main", _p(2), _FOOT), ("article", "", _SIDE + _FOOT), ("main", _p(1, 2), _OPAQUE))),
    # Reader comments told by their structure, after the article and beside it in its main element.
    f"<body>{_NAV}<article><h1 data-main>Locks</h1>{_p(0)}{_p(3)}</article>{_OPAQUE}{_FOOT}</body>",
    f"<body>{_NAV}<main><h1 data-main>Keys</h1>{_p(2)}{_p(1)}{_OPAQUE}</main>{_FOOT}</body>",
    f"<body>{_NAV}<main><article><h1 data-main>Doors</h1>{_p(1)}{_p(4)}</article>{_OPAQUE_LAST}</main>{_FOOT}</body>",
    f"<body>{_NAV}<main><h1 data-main>Hinges</h1>{_p(3)}{_p(0)}{_OPAQUE_LAST}</main></body>",
    f"<body><div class='a'>{_list('Start', 'Help')}</div><div class='b'><h1 data-main>Walls</h1>{_p(0)}{_p(2, 2)}</div>{_OPAQUE}<div class='c'>Made in the north</div></body>",
    f"<body><div class='b'><h1 data-main>Roofs</h1>{_p(5)}{_p(1)}<p data-main>Done.</p></div>{_OPAQUE_LAST}</body>",
    # Units of one kind inside an article.
    f"<body>{_NAV}<article><h1 data-main>How to mend a net</h1>{_p(0)}{_STEPS}</article>{_FOOT}</body>",
    f"<body>{_NAV}<article><h1 data-main>How to paint a boat</h1>{_STEPS}{_p(3)}</article>{_OPAQUE}</body>",
    f"<body>{_NAV}<main><article><h1 data-main>How to tie a knot</h1>{_p(4)}{_STEPS}</article>{_OPAQUE_LAST}</main>{_SIDE}</body>",
    # Short paragraphs without any element or name that says what is main.
    f"<body><div class='m'>{_NAV}</div><div class='t'><h1 data-main>Late</h1>{_s(0, 2)}</div>{_OPAQUE}</body>",
    f"<body><div class='m'>{_NAV}</div><div class='t'><h1 data-main>Rain</h1>{_s(1, 3)}</div>{_OPAQUE_LAST}</body>",
    f"<body><div class='m'>{_NAV}</div><div class='t'><h1 data-main>Rivers</h1>{_s(2, 5)}</div>{_FOOT}</body>",
    f"<body><div class='m'>{_NAV}</div><div class='t'><h1 data-main>Maps</h1>{_s(3, 4)}</div>{_SIDE}</body>",
    f"<body><div class='m'>{_NAV}</div><div class='t'><h1 data-main>Roads</h1>{_s(4, 3)}</div>{_COMMENTS}</body>",
    f"<body>{_list('One', 'Two')}<div><h2 data-main>Sunday</h2>{_s(1, 4)}</div><div>Made in the north</div></body>",
    f"<body><div>{_s(0, 5)}</div><div class='x1'>{_list('Next', 'Back')}</div></body>",
    f"<body><div id='top'>{_list('Start', 'Help')}</div><h1 data-main>Letters</h1>{_s(3, 3)}{_OPAQUE}</body>",
    f"<body>{_NAV}<main><h1 data-main>Quays</h1>{_s(2, 3)}{_OPAQUE}</main></body>",
    f"<body>{_NAV}<main><h1 data-main>Cranes</h1>{_s(1, 2)}{_OPAQUE}{_FOOT}</main></body>",
    f"<body>{_NAV}<main><h1 data-main>Cargo</h1>{_s(0, 4)}{_OPAQUE_LAST}</main>{_SIDE}</body>",
)
