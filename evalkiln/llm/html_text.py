"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks in page order. A block is described by its own word count and link
density, by those of the blocks before and after it, and by the elements around it. A decision tree, trained with
pyspark.ml on the blocks of the small labelled pages in ``labelled_pages.py``, keeps or drops each block. The tree has a bounded
depth; its nodes go to the tasks as a few tuples.

What the elements say is a feature among others, never a gate. Names such as "sidebar" count for the elements of
regions only (not for paragraphs, whose own class is another feature), up to the nearest ``main`` or ``article``; a
region that holds one of these, or the page's first heading, is a wrapper and says nothing; and the share of the
page's words that lie in a region is a feature too. Reader comments whose elements have names that say nothing are told by
their structure: siblings of one kind, each with a by-line and without a heading (``repeated``).
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from evalkiln.llm.common import filled, small_batches
from evalkiln.llm.labelled_pages import PAGES

#: Elements that start and end a text block.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
UNSEEN = frozenset("head script style noscript template svg math iframe object canvas audio video select button textarea datalist".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
FURNITURE = frozenset("nav header footer aside form menu dialog search".split())
#: Of these what is inside is no article even if it is marked as one.
OUTER = frozenset("nav footer aside menu dialog search".split())
MAIN = frozenset("article main".split())
#: Elements that are texts, not regions: their class describes one block.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr blockquote pre figcaption caption span a b i em strong small label q cite code time".split())
#: Classes of an ``article`` that is a comment or a teaser of another text.
_MINOR = re.compile(r"(?:^|[^a-z])(?:comments?|repl(?:y|ies)|related|teasers?|promo\w*|cards?|widgets?|recommend\w*)(?![a-z])")
_HINT = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|breadcrumbs?|sidebar|side-?bar|aside|rail|widget\w*|footer|foot|header|masthead|topbar|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|sign-up|login|comments?|commentlist|disqus|replies|reply|respond|share\w*|sharing|social\w*|related|recommend\w*|trending|tags?|pagination|pager|toolbar|toc|copyright|legal|disclaimer|paywall|search\w*|form|author-?bio|byline-?box|navigation|contentinfo|complementary)(?![a-z])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Scripts that are written without spaces; two such letters count as a word.
_UNSPACED = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")
#: Ends of sentences, with a space behind or, in scripts without spaces, anywhere.
_SENTENCE = re.compile(r"[.!?؟।](?=\s|$)|[。！？]")
#: Elements that may hold one reader comment, and the words that a by-line has at most.
UNIT = frozenset("div section article li".split())
BYLINE_WORDS = 5
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "main", "outside", "furniture", "share", "outer", "named", "heading", "item", "sentences", "after_heading", "repeated", "repeated_after")


def n_words(text: str) -> int:
    return len(text.split()) + len(_UNSPACED.findall(text)) // 2


class Region:
    """An element that may hold no main text: how many words it has, and whether it holds a main element or first heading."""

    __slots__ = ("words", "element", "main", "first_heading")

    def __init__(self, element: bool):
        self.words, self.element, self.main, self.first_heading = 0, element, False, False

    def wrapper(self) -> bool:
        return self.main or not self.element and self.first_heading


class Block:
    __slots__ = ("text", "words", "linked", "regions", "main", "outer", "named", "heading", "item", "label", "repeated")

    def __init__(self, text: str, linked: int, regions: tuple[Region, ...], around: Counter, tag: str, label: int):
        self.text, self.words, self.linked, self.regions = text, n_words(text), linked, regions
        self.repeated = 0
        self.main, self.outer, self.named = 2 if around["article"] else min(around["main"], 1), min(around["outer"], 1), min(around["named"], 1)
        self.heading, self.item, self.label = int(len(tag) == 2 and tag[0] == "h" and tag != "hr"), int(tag in ("li", "dd", "dt", "td", "th")), label


def _roles(name: str, attributes: str, inside_main: bool) -> tuple[str, ...]:
    roles = []
    if name in UNSEEN:
        roles.append("unseen")
    if name in FURNITURE and not (name == "header" and inside_main):
        roles.append("element")
        if name in OUTER:
            roles.append("outer")
    if name == "a":
        roles.append("link")
    main = name in MAIN
    if attributes:
        got = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attributes)}
        said = " ".join(got.get(k, "") for k in ("class", "id", "role")).lower()
        if name == "article" and _MINOR.search(said):
            main = False
            roles.append("hint")
        elif not main and re.search(r"(?:^|\s)main(?:\s|$)", got.get("role", "").lower()):
            main = True
        elif said and name not in ("html", "body") and not main and _HINT.search(said):
            roles.append("named" if name in TEXTUAL else "hint")
        style = got.get("style", "").lower().replace(" ", "")
        if re.search(r"(?:^|[\s\"'])hidden(?=$|[\s=/])", attributes.lower()) and "hidden" not in got.get("class", "") or "display:none" in style or "visibility:hidden" in style or got.get("aria-hidden", "").lower() == "true":
            roles.append("unseen")
        if "data-main" in attributes:
            roles.append("label")
    if main:
        roles.append("main")
        if name == "article":
            roles.append("article")
    return tuple(roles)


def _by_line(block: Block) -> bool:
    return block.words <= BYLINE_WORDS and not _SENTENCE.search(block.text)


def _mark_repeated(blocks: list[Block], units: list[tuple[int, str, int, int]]) -> None:
    """How many siblings of one kind there are of the unit around a block, if each has a by-line and none a heading.

    Inside an ``article`` such units are its steps or questions, and say nothing.
    ``units`` are (parent, kind, first block, block behind the last) of elements that are closed.
    """
    headings = np.cumsum([0, *(b.heading for b in blocks)])
    by: dict[tuple[int, str], list[tuple[int, int]]] = {}
    for parent, kind, first, end in units:
        if end - first > 1 and headings[first] == headings[end] and (_by_line(blocks[first]) or _by_line(blocks[end - 1])):
            by.setdefault((parent, kind), []).append((first, end))
    for siblings in by.values():
        if len(siblings) > 1:
            for first, end in siblings:
                for b in blocks[first:end]:
                    b.repeated = min(5, len(siblings)) if b.main < 2 else 0


def blocks_of(page: str | None) -> list[Block]:
    """Text blocks of a page in order; markup that never closes is read up to the end of the page."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []
    units: list[tuple[int, str, int, int]] = []
    opened: list[tuple[int, str, int]] = []  # number, kind and first block of the units around
    count = 0
    scopes: list[list[Region]] = [[]]  # the regions around, in one list for each main element around them
    open_tags, around = Counter(), Counter()
    text: list[str] = []
    linked, at, end, tag = 0, 0, len(page), ""

    def flush() -> None:
        nonlocal linked
        joined = " ".join(entities.unescape("".join(text)).split())
        if joined:
            block = Block(joined, min(linked, n_words(joined)), tuple(scopes[-1]), around, tag, int(around["label"] > 0))
            out.append(block)
            for region in (r for scope in scopes for r in scope):
                region.words += block.words
                region.first_heading |= tag == "h1"
        text.clear()
        linked = 0

    def pop() -> None:
        name, roles, is_unit = stack.pop()
        if is_unit:
            _, kind, first = opened.pop()
            units.append((opened[-1][0] if opened else 0, kind, first, len(out)))
        open_tags[name] -= 1
        for r in roles:
            around[r] -= 1
        if "main" in roles:
            scopes.pop()
        elif "element" in roles or "hint" in roles:
            scopes[-1].pop()

    while at < end:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = end if stop < 0 else stop
            if not around["unseen"]:
                piece = page[at:stop]
                text.append(piece)
                if around["link"]:
                    linked += n_words(piece)
            at = stop
            continue
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = end if stop < 0 else stop + 3
            continue
        m = _TAG.match(page, at) or _PLAIN_TAG.match(page, at)
        if not m:
            if page.startswith(("<!", "<?", "</"), at):
                stop = page.find(">", at)
                at = end if stop < 0 else stop + 1
            else:
                if not around["unseen"]:
                    text.append("&lt;")
                at += 1
            continue
        at, name = m.end(), m[2].lower()
        block = name in BLOCK
        if block:
            flush()
        if m[1]:
            if open_tags[name] > 0:
                while stack[-1][0] != name:
                    pop()
                pop()
            tag = next((n for n, *_ in reversed(stack) if n in BLOCK), "") if block else tag
            continue
        if name == "br":
            text.append(" ")
        if name in ("p", "li", "td", "th", "dt", "dd", "tr", "option", "a") and open_tags[name] > 0 and stack and (stack[-1][0] == name or name == "a"):
            while stack[-1][0] != name:
                pop()
            pop()
        elif block and stack and stack[-1][0] == "p":
            pop()
        if block:
            tag = name
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        roles = _roles(name, m[3], around["main"] > 0)
        is_unit = name in UNIT
        if is_unit:
            count += 1
            said = next((a or b or c for k, a, b, c in _ATTR.findall(m[3]) if k.lower() == "class"), "")
            opened.append((count, f"{name} {said}", len(out)))
        stack.append((name, roles, is_unit))
        open_tags[name] += 1
        for r in roles:
            around[r] += 1
        if "main" in roles:
            for region in (r for scope in scopes for r in scope):
                region.main = True
            scopes.append([])
        elif "element" in roles or "hint" in roles:
            scopes[-1].append(Region("element" in roles))
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else end
    flush()
    while stack:
        pop()
    _mark_repeated(out, units)
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block, columns as in FEATURES; beyond the ends of the page there are blocks without words."""
    if not blocks:
        return np.empty((0, len(FEATURES)))
    words = np.array([0, *(b.words for b in blocks), 0], float)
    links = np.array([0, *(b.linked / b.words for b in blocks), 0], float)
    heading = np.array([0, *(b.heading for b in blocks)], float)
    whole = max(1, sum(b.words for b in blocks))
    real = [[r for r in b.regions if not r.wrapper()] for b in blocks]
    has_main, repeated = any(b.main for b in blocks), np.array([*(b.repeated for b in blocks), 0], float)
    own = np.array([[b.main, int(has_main and not b.main), int(bool(rs)), max((r.words for r in rs), default=0) / whole, b.outer, b.named, b.heading, b.item, min(5, len(_SENTENCE.findall(b.text)))] for b, rs in zip(blocks, real)], float)
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], own, heading[:-1], repeated[:-1], repeated[1:]])


def labelled_rows() -> list[tuple[int, np.ndarray]]:
    """(label, features) of every block of the labelled pages."""
    return [(b.label, x) for page in PAGES for blocks in (blocks_of(page),) for b, x in zip(blocks, features(blocks))]


@lru_cache(maxsize=4)
def trained_tree(spark: SparkSession, depth: int = 12) -> tuple:
    """The tree as nested tuples (feature, threshold, left, right) with 0.0 or 1.0 as leaves."""
    table = spark.createDataFrame([(float(label), Vectors.dense(x)) for label, x in labelled_rows()], ["label", "features"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=2, seed=1).fit(table)

    def nodes(node) -> tuple | float:
        if node.subtreeDepth() == 0:
            return float(node.prediction())
        return (node.split().featureIndex(), node.split().threshold(), nodes(node.leftChild()), nodes(node.rightChild()))

    return nodes(model._call_java("rootNode"))


def described(tree: tuple | float, depth: int = 0) -> str:
    """The tree as text, one line for each node."""
    if not isinstance(tree, tuple):
        return "  " * depth + ("keep" if tree > 0.5 else "drop")
    feature, threshold, left, right = tree
    return "\n".join(["  " * depth + f"{FEATURES[feature]} <= {threshold:.3g}", described(left, depth + 1), described(right, depth + 1)])


def classify(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree > 0.5)
    feature, threshold, left, right = tree
    low = x[:, feature] <= threshold
    out = np.empty(len(x), bool)
    out[low], out[~low] = classify(left, x[low]), classify(right, x[~low])
    return out


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but the html) of every page with its main text.

    The text is the kept blocks in page order, joined by an empty line; empty for null, empty and text-free pages.
    A column named ``text_col`` is replaced, others may have any name. Each page is judged by itself, so repeated
    rows agree; pages are read whole, whatever their length. ``keep=[]`` leaves the text alone.
    """
    spark = pages.sparkSession
    small_batches(spark)
    keep = [c for c in ([c for c in pages.columns if c != html_col] if keep is None else keep) if c != text_col]
    tree = trained_tree(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            found = [blocks_of(x) for x in pdf["__text"]]
            kept = classify(tree, np.vstack([np.empty((0, len(FEATURES))), *map(features, found)]))
            at, texts = 0, []
            for blocks in found:
                texts.append("\n\n".join(b.text for b, k in zip(blocks, kept[at : at + len(blocks)]) if k))
                at += len(blocks)
            yield pdf[["kept"]].assign(found=texts)

    df = pages.select(F.struct(*keep).alias("kept") if keep else F.lit(None).cast("int").alias("kept"), F.col(html_col).alias("__text"))
    out = df.mapInPandas(run, df.select("kept").withColumn("found", F.lit("")).schema)
    return out.select(*[F.col("kept")[c].alias(c) for c in keep], F.col("found").alias(text_col))


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
