import html
import re

import pytest

from evalkiln.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="</p><p>no";</script></head><body>
<div id="cookie-banner"><p>We use cookies here.</p></div><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<article><h1>A &amp; B</h1><p>First   paragraph with\n several words, and an &eacute;.<p>Second one.<br>goes on &lt;here&gt;.</p><form><label>Mail</label><input></form></article>
<aside>Read more</aside><section class="comments"><p>I disagree with all of this, sir.</p></section><footer>Copyright 2020</footer>"""


def test_article_is_kept_and_furniture_is_not(spark):
    row = H.extract_text(spark.createDataFrame([(1, PAGE)], "page_id bigint, html string")).first()
    assert row.text == "A & B\n\nFirst paragraph with several words, and an é.\n\nSecond one. goes on <here>."


WRAPPED = [
    ("<body><nav><a href=/>Home</a></nav><div class='layout with-sidebar'><article><h1>Title of it</h1><p>The whole article lies in a wrapper that is named after its sidebar.</p><p>It must be kept all the same.</p></article><div class='sidebar'><a href=/1>One</a> <a href=/2>Two</a></div></div></body>",
     "Title of it\n\nThe whole article lies in a wrapper that is named after its sidebar.\n\nIt must be kept all the same."),
    ("<body><article><h1>Head</h1><p class='tags-intro'>A story paragraph with an unlucky class name, which is rather long and has no link.</p><p>The second paragraph goes on from there, as it should.</p></article><footer>Imprint</footer></body>",
     "Head\n\nA story paragraph with an unlucky class name, which is rather long and has no link.\n\nThe second paragraph goes on from there, as it should."),
    ("<body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Linked</h1><p>The first paragraph has no link but says what it is about.</p><p><a href=/x>This paragraph of the article is one long link to its source.</a></p><p>The last paragraph closes the text again.</p></article></body>",
     "Linked\n\nThe first paragraph has no link but says what it is about.\n\nThis paragraph of the article is one long link to its source.\n\nThe last paragraph closes the text again."),
    ("<body><article><h1>Short</h1><p>It is a short text, but it has two sentences. Here is the second.</p></article><aside><article><h3>Teaser</h3><p>Another story is told elsewhere, and here one reads its first sentence.</p></article></aside></body>",
     "Short\n\nIt is a short text, but it has two sentences. Here is the second."),
]


@pytest.mark.parametrize("i", range(len(WRAPPED)))
def test_names_of_wrappers_are_no_gate(spark, i):
    page, want = WRAPPED[i]
    assert H.extract_text(spark.createDataFrame([(1, page)], "page_id bigint, html string")).first().text == want


_MENU = "<nav><ul><li><a href=/>Start</a></li><li><a href=/map>Map of the site</a></li></ul></nav>"
_SAID = "<div class='c-9f'><div>4 people wrote</div>" + "".join(f"<div class='c-2a'><span>{who}</span><p>{what}</p></div>" for who, what in (("Maria G", "Great post! It helped me a lot."), ("old_sailor", "I do not agree with the second part, where are the sources?"), ("Li", "Nice. When does the next part come out?"), ("Sam", "Same here."))) + "</div>"
#: Layouts that are not among the labelled pages: (page, blocks of the article).
HELD_OUT = [
    ("<main><h2>Q and A</h2><p>Why</p><p>Because</p><p>It is so</p></main>", ["Q and A", "Why", "Because", "It is so"]),
    (f"{_MENU}<main><h1>Setup</h1><p>Install it first and then start the server from the command line.</p><pre>print(2)</pre></main>", ["Setup", "Install it first and then start the server from the command line.", "print(2)"]),
    (f"{_MENU}<article><h1>Birds</h1><p>They come in spring and leave before the first frost.</p><figure><img src=b.jpg><figcaption>A stork on its nest</figcaption></figure></article>", ["Birds", "They come in spring and leave before the first frost.", "A stork on its nest"]),
    (f"{_MENU}<article><h1>Packing list</h1><p>Take these with you on the trip.</p><ol><li>tent</li><li>two ropes</li></ol></article>", ["Packing list", "Take these with you on the trip.", "tent", "two ropes"]),
    ("<article><p>港口办公室周一报告说，旧灯塔将在冬季风暴到来之前修复。</p><p>工程师测量了塔楼两次。他们在顶部附近发现了裂缝，但地基很稳固。</p></article>", ["港口办公室周一报告说，旧灯塔将在冬季风暴到来之前修复。", "工程师测量了塔楼两次。他们在顶部附近发现了裂缝，但地基很稳固。"]),
    (f"{_MENU}<article><h1>Boats</h1><p>The first boat was built of oak. The second one was not.</p><p>Both float.</p></article>{_SAID}<footer>Imprint</footer>", ["Boats", "The first boat was built of oak. The second one was not.", "Both float."]),
    (f"{_MENU}<main><h1>Trains</h1><p>The line is closed for the summer, as the company said on Friday.</p><p>Buses go every hour.</p>{_SAID}</main>", ["Trains", "The line is closed for the summer, as the company said on Friday.", "Buses go every hour."]),
    (f"<div class=m>{_MENU}</div><div class=t><h1>Planes</h1><p>They fly over the sea at night, and nobody in the village has slept since then. Some have moved.</p><p>The others stay. They say that the noise will end in autumn, when the new runway opens.</p></div>{_SAID}", ["Planes", "They fly over the sea at night, and nobody in the village has slept since then. Some have moved.", "The others stay. They say that the noise will end in autumn, when the new runway opens."]),
    (f"{_MENU}<article><h1>Bread</h1><p>It takes a day, most of which is waiting for the dough.</p><div class=k><b>Part one</b><p>Mix flour, water and salt, and let it rest.</p></div><div class=k><b>Part two</b><p>Bake it hot for forty minutes.</p></div></article><footer>Imprint</footer>", ["Bread", "It takes a day, most of which is waiting for the dough.", "Part one", "Mix flour, water and salt, and let it rest.", "Part two", "Bake it hot for forty minutes."]),
]


@pytest.mark.parametrize("i", range(len(HELD_OUT)))
def test_held_out_layouts(spark, i):
    page, want = HELD_OUT[i]
    assert H.extract_text(spark.createDataFrame([(1, f"<body>{page}</body>")], "page_id bigint, html string")).first().text.split("\n\n") == want


def test_very_long_page(spark):
    """One page of 20,000 paragraphs that ends inside its article with a short block is kept whole."""
    body = "".join(f"<p>Paragraph {i} tells what happened on that day, at some length.</p>" for i in range(20_000))
    text = H.extract_text(spark.createDataFrame([(1, f"<body>{_MENU}<article><h1>Diary</h1>{body}<p>The end</p></article></body>")], "page_id bigint, html string")).first().text
    assert text.count("\n\n") == 20_001 and text.startswith("Diary\n\n") and text.endswith("\n\nThe end")


def test_units_are_repeated_without_headings():
    found = lambda p: [b.repeated for b in H.blocks_of(p)]
    assert found("<div class=a><b>Ann</b><p>One.</p></div>" * 3) == [3] * 6
    assert found("<div class=a><h3>Ann</h3><p>One.</p></div>" * 3) == found("<div class=a><p>One.</p></div>" * 3) + [0] * 3 == [0] * 6
    assert found("<div class=a><b>Ann</b><p>One.</p></div><div class=b><b>Ann</b><p>One.</p></div>") == [0] * 4
    assert found("<div><b>Ann</b><p>One.") == [0, 0]


def test_tree_uses_words_and_links_of_neighbours(spark):
    text = H.described(H.trained_tree(spark))
    print(text)
    used = {line.split()[0] for line in text.splitlines()} - {"keep", "drop"}
    assert {"words", "links"} <= used and used & {"words_before", "words_after", "links_before", "links_after"} and {"main", "share"} & used


def test_test_pages_equal_their_articles_block_by_block(spark):
    """The blocks of the articles of the smallest table, split at their elements, joined by empty lines."""
    source = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    blocks = lambda a: [t for t in (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h[1-6]|div|ul|ol|li|blockquote|section|header|figure|figcaption|article)\b[^>]*>", a)) if t]
    want = {i: "\n\n".join(blocks(re.search("<article>(.*)</article>", s, re.S)[1])) for i, s in source.items()}
    rows = H.op7_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.text == want[r.page_id] for r in rows) == len(rows)


def test_test_pages_equal_their_articles(spark):
    source = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = H.op7_html_extraction(spark, "/root/testdata/sf0.01").collect()
    want = {i: " ".join(html.unescape(re.sub("<[^>]*>", " ", re.search("<article>(.*)</article>", s, re.S)[1])).split()) for i, s in source.items()}
    good = sum(" ".join(r.text.split()) == want[r.page_id] for r in rows)
    assert len(rows) == len(source) and good == len(rows) and all(r.n_chars == len(r.text) for r in rows)


def test_labelled_pages_are_learned(spark):
    tree = H.trained_tree(spark)
    found = [(b.label, bool(k)) for p in H.PAGES for bs in (H.blocks_of(p),) for b, k in zip(bs, H.classify(tree, H.features(bs)))]
    print([(b.text, b.label) for p in H.PAGES for bs in (H.blocks_of(p),) for b, k in zip(bs, H.classify(tree, H.features(bs))) if b.label != k])
    assert sum(a == b for a, b in found) >= 0.97 * len(found)


def test_blocks_of_odd_markup():
    text = lambda p: [b.text for b in H.blocks_of(p)]
    assert text(None) == text("") == text("<p></p>") == []
    assert text("a < b and <b>c</b>") == ["a < b and c"]
    assert text("<p>one<p>two<!-- <p>no --></div>three") == ["one", "two", "three"]
    assert text("<script>while(1){'</p>'}") == []
    assert text("<p>x<div style='display: none'>hidden</div>y</p>") == ["x", "y"]
    assert text('<p title="a > b">t</p>&nbsp;') == ["t"]
    assert len(text("<p>w</p>" * 3000)) == 3000


def test_edges(spark):
    rows = [(1, None, "k"), (2, "", "k"), (2, "", "k"), (3, "plain", "k")]
    out = H.extract_text(spark.createDataFrame(rows, "page_id bigint, html string, text string"))
    assert out.count() == 4 and {r.text for r in out.where("page_id < 3").collect()} == {""}
    assert H.extract_text(spark.createDataFrame([], "page_id bigint, html string")).count() == 0
    clash = spark.createDataFrame([(1, "<p>x</p>", "a", "b", "c")], "page_id bigint, html string, __html string, kept string, found string")
    assert H.extract_text(clash).columns == ["page_id", "__html", "kept", "found", "text"] and H.extract_text(clash).first().found == "c"
    assert H.extract_text(clash, keep=[]).columns == ["text"]
