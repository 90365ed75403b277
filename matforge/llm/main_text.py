"""Main text of web pages by a decision tree over flat text blocks.

A page is cut into flat blocks: the text between one block-level tag and the next. For each block Spark works out
its number of words and link density, those of the blocks before and after it, and where it stands (inside an article,
a menu, a comment list, ...). A decision tree, fitted with Spark's own learner on the small labelled table below, says
which blocks belong to the article. The tree is then an ordinary column expression over the page's array of blocks, so a page is
one row from end to end and nothing is shuffled.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matforge.llm.words import chunks

#: Where a block stands: the innermost of its ancestors that say so decides, but nothing inside reader comments counts.
COMMENTS, APART, NOWHERE, NAMED_MAIN, MAIN = -2, -1, 0, 1, 2
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "zone", "heading")
BLOCKS = "array<struct<text: string, words: int, linked: int, zone: int, heading: int>>"
DEPTH = 7

# Elements and class names of the web, in groups.
_BREAKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_DROPPED = frozenset("button canvas datalist noscript object select svg template audio video".split())
_SPACE = frozenset("br img hr input td th".split())
_ELEMENT_ZONES = dict.fromkeys("article main".split(), MAIN) | dict.fromkeys("aside dialog fieldset footer form header menu nav search".split(), APART)
_ROLE_ZONES = {"main": MAIN, "article": MAIN} | dict.fromkeys("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split(), APART)
_NAMED_COMMENTS = frozenset("comment comments commentlist commenters disqus replies reply respond responses discussion".split())
_NAMED_APART = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie cookies copyright footer footnav gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion recommended related search "
    "share sharing sidebar sidenav signup social sponsor sponsored subscribe teaser toolbar topbar widget".split()
)
#: With one of these a name tells of something else on the page, as in "has-sidebar".
_QUALIFIERS = frozenset("has no with without".split())
_NAMED_MAIN = frozenset("article articlebody content entry main post story".split())
#: A start of one of these ends an open element of the same group in the same list, row or column.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|textarea|iframe|xmp|noembed|noframes)\b[^>]*>.*?(?:</\1[^>]*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WHITE = re.compile(r"[\x20\x09-\x0D]+")


def _zone(name: str, attributes: str, within: int) -> int:
    """The zone that a start tag opens; ``within`` is the one around it."""
    if within == COMMENTS or name in ("html", "body"):
        return within
    found = _ELEMENT_ZONES.get(name)
    if name == "header" and within == MAIN:  # an article's own head
        found = None
    if attributes:
        values = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(attributes)}
        names = {n.lower() for n in _NAME.findall(f"{values.get('class', '')} {values.get('id', '')}")}
        if names & _NAMED_COMMENTS:
            return COMMENTS
        style = values.get("style", "").replace(" ", "").lower()
        if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
            return APART
        if within >= NAMED_MAIN:  # as in the element's name, an article's own head
            names.discard("header")
        if names & _NAMED_APART and found != MAIN and not names & _QUALIFIERS:
            return APART
        found = _ROLE_ZONES.get(values.get("role", "").lower(), found)
        if found is None and (names & _NAMED_MAIN or values.get("itemprop", "").lower() == "articlebody"):
            found = max(within, NAMED_MAIN)
    return within if found is None else found


def flat_blocks(page: str | None) -> list[tuple[str, int, int, int, int]]:
    """(text, words, words in links, zone, in a heading) of each block with text, in page order."""
    blocks: list[tuple[str, int, int, int, int]] = []
    stack: list[tuple[str, int]] = []  # open elements but inline ones without a zone of their own, with the zone inside
    held: list[str] = []
    links: list[str] = []
    state = {"zone": NOWHERE, "heading": 0}
    opened: Counter[str] = Counter()
    in_link, dropped = False, 0

    def close(to: int) -> None:
        for name, _ in stack[to:]:
            opened[name] -= 1
        del stack[to:]

    def flush() -> None:
        text = _WHITE.sub(" ", html.unescape("".join(held))).strip(" ") if held else ""
        if text.strip():  # more than no-break spaces
            linked = len(_WHITE.sub(" ", html.unescape("".join(links))).split(" ")) if "".join(links).strip() else 0
            words = text.count(" ") + 1
            blocks.append((text, words, min(linked, words), state["zone"], state["heading"]))
        held.clear()
        links.clear()

    def say(text: str) -> None:
        if not dropped and text:
            if not held:
                state["zone"], state["heading"] = stack[-1][1] if stack else NOWHERE, int(any(n in _HEADINGS for n, _ in stack[-3:]))
            if held or text.strip():
                held.append(text)
                if in_link:
                    links.append(text)

    at = 0
    page = page or ""
    for token in _TOKEN.finditer(page):
        say(page[at : token.start()])
        at = token.end()
        if token[3] is None:
            continue
        name, closing = token[3].lower(), bool(token[2])
        if name in _DROPPED:
            dropped = max(0, dropped + (-1 if closing else 0 if token[4].endswith("/") else 1))
            if name == "button":
                say(" ")
            continue
        if dropped:
            # an unclosed dropped element ends with the element around it
            if not (closing and opened[name]):
                continue
            dropped = 0
        if name == "a":
            in_link = not closing
            if in_link and links:
                links.append(" ")
            continue
        if name in _BREAKS:
            flush()
            in_link = in_link and name not in ("p", "div", "li", "ul", "nav", "article", "section", "footer")
        elif name in _SPACE:
            say(" ")
        if closing:
            if opened[name]:
                close(max(i for i in range(len(stack)) if stack[i][0] == name) if stack[-1][0] != name else len(stack) - 1)
        elif name not in _VOID:
            if name in _BREAKS and stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            ends = _ENDS.get(name, ())
            while ends and stack and stack[-1][0] in ends:
                close(len(stack) - 1)
            within = stack[-1][1] if stack else NOWHERE
            zone = _zone(name, token[4], within)
            if name in _BREAKS or zone != within:
                if name not in _BREAKS and zone < within:
                    flush()
                stack.append((name, zone))
                opened[name] += 1
    say(page[at:])
    flush()
    return blocks


#: The labelled table: pages of blocks (zone, heading, words, words in links, belongs to the article).
LABELLED: tuple[tuple[tuple[int, int, int, int, int], ...], ...] = (
    # articles that are marked as such, with menus, adverts and footers around them
    ((0, 0, 1, 1, 0), (-1, 0, 6, 6, 0), (-1, 0, 8, 0, 0), (2, 1, 9, 0, 1), (2, 0, 60, 0, 1), (2, 0, 3, 0, 1), (2, 0, 45, 2, 1), (-1, 0, 12, 0, 0)),
    ((-1, 0, 1, 1, 0), (-1, 0, 2, 2, 0), (-1, 0, 14, 0, 0), (2, 1, 5, 0, 1), (2, 0, 1, 0, 1), (-1, 0, 40, 0, 0), (-1, 0, 3, 3, 0)),
    ((-1, 0, 1, 1, 0), (2, 1, 12, 0, 1), (2, 0, 20, 20, 1), (2, 0, 4, 4, 1), (2, 0, 120, 4, 1), (-1, 0, 25, 2, 0), (-2, 1, 2, 0, 0), (-2, 0, 70, 0, 0), (-2, 0, 4, 0, 0)),
    ((-1, 0, 60, 1, 0), (2, 0, 2, 0, 1), (2, 1, 2, 2, 1), (2, 0, 8, 0, 1), (2, 0, 15, 1, 1), (-2, 0, 30, 0, 0), (-1, 0, 30, 0, 0)),
    ((0, 0, 7, 0, 0), (2, 1, 4, 0, 1), (2, 0, 30, 0, 1), (2, 0, 11, 0, 1), (0, 0, 5, 0, 0), (0, 0, 4, 4, 0)),
    # long notices, sidebars and comments
    ((-1, 0, 90, 3, 0), (-1, 0, 2, 2, 0), (1, 1, 8, 0, 1), (1, 0, 80, 1, 1), (1, 0, 25, 0, 1), (-1, 0, 50, 0, 0), (-2, 0, 100, 0, 0), (-2, 0, 12, 1, 0), (-1, 0, 20, 6, 0)),
    ((-1, 0, 3, 3, 0), (1, 1, 6, 0, 1), (1, 0, 7, 0, 1), (1, 0, 50, 5, 1), (1, 0, 3, 3, 0), (1, 0, 2, 2, 0), (-1, 0, 9, 0, 0)),
    ((-1, 0, 3, 3, 0), (1, 1, 9, 0, 1), (1, 0, 33, 0, 1), (1, 0, 2, 0, 1), (1, 0, 41, 6, 1), (1, 0, 5, 5, 0), (-2, 0, 22, 0, 0), (-2, 0, 3, 1, 0)),
    # pages that mark nothing: words and links of a block and of its neighbours are all there is
    ((0, 0, 1, 1, 0), (0, 0, 1, 1, 0), (0, 0, 2, 2, 0), (0, 1, 7, 0, 1), (0, 0, 55, 0, 1), (0, 0, 70, 3, 1), (0, 0, 9, 0, 1), (0, 0, 48, 0, 1), (0, 0, 6, 0, 0), (0, 0, 4, 4, 0), (0, 0, 3, 3, 0)),
    ((0, 0, 2, 2, 0), (0, 0, 1, 1, 0), (0, 1, 10, 0, 1), (0, 0, 35, 1, 1), (0, 0, 28, 0, 1), (0, 0, 40, 2, 1), (0, 0, 3, 3, 0), (0, 0, 12, 12, 0), (0, 0, 9, 1, 0)),
    ((0, 0, 4, 4, 0), (0, 0, 8, 0, 0), (0, 0, 2, 2, 0), (0, 1, 5, 0, 1), (0, 0, 22, 0, 1), (0, 0, 19, 0, 1), (0, 0, 31, 0, 1), (0, 0, 2, 0, 0), (0, 0, 1, 1, 0)),
    ((0, 0, 3, 3, 0), (0, 0, 5, 5, 0), (0, 0, 6, 0, 0), (0, 0, 3, 3, 0), (0, 0, 90, 2, 1), (0, 0, 4, 0, 1), (0, 0, 64, 0, 1), (0, 0, 7, 0, 1), (0, 0, 72, 0, 1), (0, 0, 5, 1, 0), (0, 0, 8, 8, 0)),
    ((0, 0, 20, 18, 0), (0, 0, 16, 14, 0), (0, 1, 6, 0, 1), (0, 0, 120, 6, 1), (0, 0, 88, 2, 1), (0, 0, 25, 20, 0), (0, 0, 18, 16, 0)),
    ((0, 0, 30, 2, 1), (0, 0, 44, 0, 1)),
    ((0, 0, 26, 0, 1),),
    ((0, 1, 4, 0, 1), (0, 0, 38, 0, 1)),
)


def features(around: Column, at: Column) -> list[Column]:
    """The features of the block at a 0-based place of an array of blocks; a missing neighbour counts as one without words."""
    own, before, after = F.get(around, at), F.get(around, at - 1), F.get(around, at + 1)
    words = lambda b: F.coalesce(b["words"], F.lit(0)).cast("double")
    density = lambda b: F.coalesce(b["linked"] / F.greatest(b["words"], F.lit(1)), F.lit(0.0))
    return [words(own), density(own), words(before), density(before), words(after), density(after), own["zone"].cast("double"), own["heading"].cast("double")]


@functools.lru_cache(maxsize=4)
def _tree_text(spark: SparkSession, pages: tuple) -> str:
    rows = [([("", words, linked, zone, heading) for zone, heading, words, linked, _ in page], [float(b[-1]) for b in page]) for page in pages]
    table = spark.createDataFrame(rows, f"blocks {BLOCKS}, labels array<double>")
    places = table.select("blocks", "labels", F.explode(F.sequence(F.lit(0), F.size("blocks") - 1)).alias("at"))
    lines = places.select(*(c.alias(n) for n, c in zip(FEATURES, features(F.col("blocks"), F.col("at")))), F.get("labels", F.col("at")).alias("label"))
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(lines.coalesce(1))
    return DecisionTreeClassifier(maxDepth=DEPTH, maxBins=128, seed=1).fit(assembled).toDebugString


def fit_tree(spark: SparkSession, pages: tuple = LABELLED) -> list:
    """The tree over :data:`FEATURES` as nested [feature, threshold, left, right], a leaf as its prediction."""
    lines = [line.strip() for line in _tree_text(spark, pages).splitlines()[1:] if line.strip()]

    def node(at: int) -> tuple[list | float, int]:
        if lines[at].startswith("Predict"):
            return float(lines[at].split()[1]), at + 1
        found = re.fullmatch(r"If \(feature (\d+) <= ([-\d.E]+)\)", lines[at])
        left, at = node(at + 1)
        right, at = node(at + 1)  # after its "Else" line
        return [int(found[1]), float(found[2]), left, right], at

    return node(0)[0]


def keeps(tree: list | float, values: list[Column]) -> Column:
    """A fitted tree as a condition over the columns of its features."""
    if isinstance(tree, float):
        return F.lit(tree > 0.5)
    feature, threshold, left, right = tree
    return F.when(values[feature] <= threshold, keeps(left, values)).otherwise(keeps(right, values))


def with_blocks(pages: DataFrame, html_col: str, out: str) -> DataFrame:
    """``pages`` with the flat blocks of each page's whole html in place of the html."""
    others = [f for f in pages.schema if f.name != html_col]
    block = pa.struct([("text", pa.string()), ("words", pa.int32()), ("linked", pa.int32()), ("zone", pa.int32()), ("heading", pa.int32())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks([batch], html_col):
                offsets, columns = [0], [[], [], [], [], []]
                for page in part.column(html_col).to_pylist():
                    found = flat_blocks(page)
                    for column, values in zip(columns, zip(*found)):
                        column.extend(values)
                    offsets.append(offsets[-1] + len(found))
                inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, block)], fields=list(block))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in others), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)], [*(f.name for f in others), out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"`{out}` {BLOCKS}"])
    return pages.mapInArrow(parse, schema)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its article's blocks in page order, one a line.

    Character references are decoded, runs of space, tab, LF, VT, FF and CR become one space (a no-break space stays), a line
    break inside a block is such white space. Null and empty pages, and those without an article, have an empty text. Pages
    that are cut off or nest their tags wrongly are read as far as they go. Null ids and urls stay, repeated rows are read each,
    other columns are not returned. An empty table gives no rows.
    """
    plain = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    tree = fit_tree(pages.sparkSession)
    blocks = F.col("blocks")
    kept = F.filter(blocks, lambda _, at: keeps(tree, features(blocks, at)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return with_blocks(plain, "html", "blocks").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
