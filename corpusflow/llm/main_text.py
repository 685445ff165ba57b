"""Main text of web pages: the contiguous region of highest score, words counting for it and tags against it.

A page is a run of tokens, text and tags. Weights of both kinds are learned from labelled pages, one scan finds the
maximum-scoring contiguous run of tokens, and its text is read off block by block.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import text_of

# What HTML calls its elements.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "canvas", "select")
BOILERPLATE = ("nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "input")
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul"
).split()
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
CLOSED_BY = {"p": BLOCKS, "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr")}
NAMES = (
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu nav navbar "
    "navigation newsletter notice notices pagination popup promo promoted related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget"
).split()
LAYOUT = (
    "area bar block bottom box btn button buttons card center col column container content count fixed form group header icon icons image inner item items label left link "
    "links list main menu middle outer panel post posts right row section signup slot small sticky text title top wrap wrapper"
).split()  # words that stand beside a name without changing it: "ad-slot", "related-posts"
INLINE = "a abbr b bdi bdo cite code data dfn em font i kbd label mark math q s samp small span strong sub sup time u var".split()
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu")
MAIN = ("article", "main")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I | re.A) for name in RAW}  # on the page itself: lower() moves what follows some letters
SPACE = re.compile(r"\s+")
OUTSIDE = 200  # words outside content that make a class boilerplate
SAMPLE_PAGES = 2000  # bound of the labelled pages that the weights come from

Token = tuple[str, str, bool, bool]  # kind (text, open, close), name or text, in boilerplate, in the labelled region


NOT, PART, NAMED, SURE = range(4)  # boilerplate: no; by a class or id that names it in a later word ("left-sidebar"); in its first word; by anything else


def _by_name(own: str, learned: dict[str, float]) -> int:
    """What a class or id says: nothing, unless all of its words are names of boilerplate or layout words, or it was learned."""
    words = re.findall(r"[a-z]+", own)
    if words and all(word in NAMES or word in LAYOUT for word in words) and any(word in NAMES for word in words):
        return NAMED if words[0] in NAMES else PART
    return NAMED if learned.get("." + own, 0.0) < 0 else NOT


def _boilerplate(name: str, attributes: str, inside: bool, learned: dict[str, float]) -> int:
    """How surely an element is a menu, header, footer, sidebar, notice, advert, form or comment by its name or its own words.

    A header in marked content holds the headline. Headings and inline elements have ids and classes made from what they
    say, and sections in marked content such ids: those name no boilerplate.
    """
    if name in BOILERPLATE and not (name == "header" and inside):
        return SURE
    if not attributes.strip() or name in ("html", "body", *MAIN):
        return NOT
    found, named = NOT, name not in HEADINGS and name not in INLINE
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next(filter(None, values), "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return SURE
        if key == "role" and value in ROLES:
            return SURE
        if named and (key == "class" or key == "id" and not inside):
            found = max([found, *(_by_name(own, learned) for own in value.split())])
    return found


def _classes(attributes: str) -> list[str]:
    return [own for key, *values in ATTRIBUTE.findall(attributes) if key.lower() == "class" for own in next(filter(None, values), "").lower().split()]


def tokens(page: str, learned: dict[str, float] = {}, held: dict[str, list[int]] | None = None) -> Iterator[Token]:
    """The page's tokens in order. Scripts, styles and other raw elements are none; comments are left out.

    Boilerplate by a class or id word ends at an element of MAIN inside: that word names a wrapper of the content. It does
    not end where marked text came before an element whose class or id begins with such a word: cards and comments follow.
    `learned` has the classes that count as such words; `held` gets, for every class, its words inside MAIN and outside.
    """
    names: list[list[str]] = []  # classes of the open elements
    stack: list[tuple[str, int, bool]] = []  # open elements, what each adds to boilerplate, whether that holds in MAIN
    boilerplate = firm = depth = at = 0
    met = False  # marked text
    while at < len(page):
        found = TOKEN.match(page, at)
        at = found.end()
        name = found[2]
        if name is None:
            if not found[0].startswith(("<!", "<?")):
                met = met or (depth > 0 and not boilerplate and not found[0].isspace())
                if held is not None:
                    for own in {own for some in names[: len(stack)] for own in some}:
                        held.setdefault(own, [0, 0])[0 if depth > 0 else 1] += len(found[0].split())
                yield "text", found[0], boilerplate > 0, depth > 0
            continue
        name = name.lower()
        if found[1]:
            if any(element[0] == name for element in stack):
                while stack:
                    last, bad, holds = stack.pop()
                    boilerplate, firm = boilerplate - bad, firm - holds
                    depth -= last in MAIN
                    if last == name:
                        break
            yield "close", name, boilerplate > 0, depth > 0
            continue
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
            names[len(stack) :] = [[]]
            stack.append((name, 1, True))
            boilerplate, firm = boilerplate + 1, firm + 1
            continue
        while stack and name in CLOSED_BY.get(stack[-1][0], ()):
            _, bad, holds = stack.pop()
            boilerplate, firm = boilerplate - bad, firm - holds
        inside = depth > 0
        if name not in VOID and not found[3].endswith("/"):
            sure = _boilerplate(name, found[3], inside, learned)
            if held is not None:
                names[len(stack) :] = [_classes(found[3])]
            holds = sure == SURE or (sure == NAMED and met)
            bad = -boilerplate if name in MAIN and not firm else int(sure > NOT)
            stack.append((name, bad, holds))
            boilerplate, firm = boilerplate + bad, firm + holds
            depth += name in MAIN
        yield "open", name, boilerplate > 0, inside


def _name(token: Token) -> str:
    return "word" if token[0] == "text" else token[1]


def occurrences(page: str) -> dict[str, tuple[int, int]]:
    """How often words and each tag stand inside the labelled region and outside, if the page is labelled.

    A labelled page marks its content itself, with one of the elements in MAIN; boilerplate within counts as outside.
    """
    counts: dict[str, list[int]] = {}
    held: dict[str, list[int]] = {}
    labelled = False
    for token in tokens(page, held=held):
        good = token[3] and not token[2]
        labelled |= good
        counts.setdefault(_name(token), [0, 0])[0 if good else 1] += len(token[1].split()) if token[0] == "text" else 1
    counts |= {"." + own: n for own, n in held.items()}
    return {k: (a, b) for k, (a, b) in counts.items()} if labelled else {}


def weights_of(counts: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Weight of a word, positive, and of every tag, never above 0: log odds of the labelled content, in words.

    A tag weighs more against a region the more often it stands outside content; unknown tags weigh like the average tag.
    A class (".name") under which OUTSIDE words and next to none of the content stand counts like a word of NAMES.
    """
    classes = {k: -1.0 for k, (a, b) in counts.items() if k.startswith(".") and b >= OUTSIDE and 50 * a <= b}
    counts = {k: v for k, v in counts.items() if not k.startswith(".")}
    inside = sum(a for a, _ in counts.values()) + 1
    outside = sum(b for _, b in counts.values()) + 1
    odds = {k: math.log((a + 0.5) / inside) - math.log((b + 0.5) / outside) for k, (a, b) in counts.items()}
    word = max(odds.get("word", 0.0), 0.1)
    weights = {k: min(-0.1, v / word) for k, v in odds.items() if k != "word"}
    return classes | weights | {"word": 1.0, "": sum(weights.values()) / len(weights) if weights else -3.0}


def region(page: list[Token], weights: dict[str, float]) -> tuple[int, int]:
    """The first contiguous run of tokens of maximum score: from, to (exclusive); (0, 0) if no run scores above 0.

    Text scores its words, those in boilerplate against the region; a tag scores its weight.
    """
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, token in enumerate(page):
        if token[0] == "text":
            words = len(token[1].split()) * weights["word"]
            run += -words if token[2] else words
        else:
            run += weights.get(token[1], weights[""])
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, found = run, (start, i + 1)
    return found


def read(page: list[Token], low: int, high: int) -> str:
    """The text of a run of tokens: blocks by line, references decoded, white space (and a line break) single; boilerplate is left out."""
    blocks, parts = [], []
    for kind, value, bad, _ in page[low:high]:
        if kind == "text":
            if not bad:
                parts.append(html.unescape(value))
        elif value == "br":
            parts.append(" ")
        elif value in BLOCKS:
            blocks.append("".join(parts))
            parts = []
    blocks.append("".join(parts))
    return "\n".join(filter(None, (SPACE.sub(" ", b).strip() for b in blocks)))


def widened(page: list[Token], low: int, high: int) -> tuple[int, int]:
    """A region that begins or ends in marked content grows to all of it: the tokens around it that the page itself marks.

    It never shrinks: a headline before an article, or a body before cards that are articles, stays.
    """
    if low < high:
        while low and page[low][3] and page[low - 1][3]:
            low -= 1
        while high < len(page) and page[high - 1][3] and page[high][3]:
            high += 1
    return low, high


def extract(page: str, weights: dict[str, float]) -> str:
    run = list(tokens(page, weights))
    return read(run, *widened(run, *region(run, weights)))


def learn(pages: DataFrame, body: str = "html", most: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from at most `most` pages that mark their content; those with the smallest hashes, a repeatable sample."""
    labelled = pages.select(text_of(body).alias("body")).filter(F.lower("body").rlike(f"<({'|'.join(MAIN)})[\\s>]"))
    keyed = labelled.select("body", F.xxhash64("body").alias("h"))
    bound = keyed.select("h").orderBy("h").limit(most).agg(F.max("h")).first()[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for name, (a, b) in occurrences(page).items():
                    have = total.setdefault(name if len(name) <= 40 else "", [0, 0])
                    have[0], have[1] = have[0] + a, have[1] + b
        names = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[n][0] for n in names], pa.int64()), pa.array([total[n][1] for n in names], pa.int64())], ["name", "inside", "outside"])

    if bound is None:
        return weights_of({})
    sums = keyed.filter(F.col("h") <= bound).select("body").mapInArrow(count, "name string, inside bigint, outside bigint")
    top = sums.groupBy("name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).orderBy(F.desc(F.col("inside") + F.col("outside")), "name").limit(2000)
    return weights_of({r["name"]: (r["inside"], r["outside"]) for r in top.collect()})


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", most: int = SAMPLE_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null page counts as empty and gives an empty text, as does one without words outside boilerplate. Broken and cut-off
    markup is read as far as it goes. Repeated pages keep their rows; pages of any length are read whole, in linear time.
    """
    weights = learn(pages, body, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, weights) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    named = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), text_of(body).alias("body"))
    return named.mapInArrow(run, f"page_id {kinds[key]}, url {kinds[url]}, text string, n_chars bigint")
