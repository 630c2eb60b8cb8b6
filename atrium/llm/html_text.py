"""HTML extraction: parser events, text-to-tag ratio per line, Gaussian smoothing and threshold clustering."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns_of, map_arrow

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is never content.
SILENT = frozenset("script style noscript template iframe object svg canvas head title select button textarea datalist nav header footer aside form menu audio video".split())
#: Elements and words of names that are silent in the body alone: within an article or main they hold its text.
SILENT_OUTSIDE, HINT_OUTSIDE = frozenset(("dialog",)), frozenset(("search", "social"))
#: Elements whose text isn't read at all.
UNREAD = frozenset("script style noscript template iframe object svg canvas head title".split())
#: Words of a class, id or role that say the same of other elements, and words that may stand beside them in one name.
HINT = re.compile(r"ads?|advert\w*|banners?|sponsor\w*|promos?|promotions?|nav|navbar|navigation|menus?|breadcrumbs?|header|masthead|footer|sidebar|aside|notices?|cookies?|consent|popup|modal|newsletter|subscribe|share|sharing|social|related|comments?|disqus|replies|respond|complementary|contentinfo|search")
BESIDE = frozenset("site page main top bottom left right box bar block area wrap wrapper container list links section widget primary secondary global inner outer content form buttons icons reader user".split())


def hinted(value: str, inside: bool = False) -> bool:
    """Whether a name in a class, id or role is made of hint words: "cookie-notice" and "site-footer" are, "post-header" and "share-price" aren't.

    inside an article or main, HINT_OUTSIDE are no hint words.
    """
    for name in value.lower().split():
        parts = [x for x in re.split(r"[_-]+", name) if x]
        hints = [bool(HINT.fullmatch(x)) and not (inside and x in HINT_OUTSIDE) for x in parts]
        if any(hints) and all(h or x in BESIDE or x.isdigit() for h, x in zip(hints, parts, strict=True)):
            return True
    return False


#: Elements that part the body into boxes, and those of them that belong to the text around them unless they are links.
BOXES = frozenset("center div dl fieldset ol section table ul".split())
LISTS = frozenset("dl ol table ul".split())
#: Characters over tags from which a line is plain text; more doesn't raise the level that the body's lines and boxes must reach.
PLAIN = 100.0
SURE = 2 / 3
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE = re.compile(r"[\s]+")
#: An open element of the key is ended by a start of one of these.
ENDS = {"p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}


class Lines(HTMLParser):
    """Lines of a page, one per block: text, tags met, the region and the box they lie in, characters in links, whether it is a heading, and silent characters.

    Text of silent elements is left out, but its length and that of its links are known. boxes holds each one's outer
    box and tag; box 0 is the body.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int, bool]] = []
        self.lines: list[tuple[str, int, int, int, int, bool, int]] = []
        self.regions = ["body"]
        self.boxes = [(0, "body")]
        self.text: list[str] = []
        self.tags = self.linked = self.muted = 0

    @property
    def quiet(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    def close_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text or self.tags:
            self.lines.append((text, self.tags, *(self.stack[-1][2:4] if self.stack else (0, 0)), self.linked, any(x[0] in HEADINGS for x in self.stack[-2:]), self.muted))
        self.text, self.tags, self.linked, self.muted = [], 0, 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.close_line()
        while self.stack and tag in ENDS.get(self.stack[-1][0], ()):
            self.stack.pop()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        region, box, link = self.stack[-1][2:] if self.stack else (0, 0, False)
        inside = region > 0
        quiet = self.quiet or tag in SILENT or (tag in SILENT_OUTSIDE and not inside)
        if not quiet:
            hidden = tag not in ("html", "body", "article", "main") and any(k in ("class", "id", "role") and v and hinted(v, inside) for k, v in attrs)
            quiet = hidden or any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        if not quiet and (tag in ("article", "main") or ("role", "main") in attrs) and self.regions[region] == "body":
            self.regions.append("main")
            region = len(self.regions) - 1
        if tag in BOXES:
            self.boxes.append((box, tag))
            box = len(self.boxes) - 1
        self.stack.append((tag, quiet, region, box, link or tag == "a"))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.close_line()
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == tag:
                del self.stack[i:]
                break
            if tag not in BLOCKS and name in BLOCKS:
                break  # an inline end tag doesn't close the block around it

    def handle_data(self, data: str) -> None:
        if not self.quiet:
            self.text.append(data)
        elif not any(x[0] in UNREAD for x in self.stack):
            self.muted += len(data.strip())
        else:
            return
        if self.stack and self.stack[-1][4]:
            self.linked += len(data.strip())


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    r = int(np.ceil(2 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    return np.convolve(np.pad(x, r, mode="edge"), k, "valid") if len(x) else x


def weak_level(p: Lines, sigma: float) -> tuple[np.ndarray, float]:
    """Smoothed ratios of all lines, silent ones with their characters, and their mean over the page's link lines; 0 without any."""
    chars = np.array([len(x[0]) + x[6] for x in p.lines])
    ratio = smooth(chars / np.array([max(1, x[1]) for x in p.lines]), sigma)
    links = (chars > 0) & (2 * np.array([x[4] for x in p.lines]) > chars)
    return ratio, float(ratio[links].mean()) if links.any() else 0.0


def content_lines(p: Lines, index: list[int], region: np.ndarray, sigma: float, cut: float) -> tuple[np.ndarray, float]:
    """Which lines are content, by smoothed ratios, and the level that the body's lines must reach.

    A line is sure of it from cut standard deviations on. In an article or main the sure lines make one cluster, from
    the first to the last of them, and it goes on to both sides for as long as lines are above the weak level: what the
    page's link lines have in the mean. So short paragraphs at its ends stay, and lists of links there go.
    """
    raw = np.array([len(x[0]) / max(1, x[1]) for x in p.lines])
    ratio = smooth(raw, sigma)[index]
    capped = smooth(np.minimum(raw, PLAIN), sigma)[index]
    level = cut * capped.std()
    sure = np.where(region > 0, ratio >= min(cut * ratio.std(), ratio.max()), capped >= min(level, capped.max()))
    whole, weak = weak_level(p, sigma)
    fair = whole[index] >= weak
    for r in np.unique(region[(region > 0) & sure]):
        own = np.flatnonzero(region == r)
        at = np.flatnonzero(sure[own])
        first, last = at[0], at[-1]
        while first and fair[own[first - 1]]:
            first -= 1
        while last + 1 < len(own) and fair[own[last + 1]]:
            last += 1
        sure[own[first : last + 1]] = True
    return sure, level


def clusters(p: Lines, index: list[int], content: np.ndarray, level: float) -> np.ndarray:
    """Which lines of the body its content clusters select.

    A box, the lines in it but in no inner box, is in the high cluster if its characters over its tags reach level and
    at least SURE of its characters are in content lines; it is kept whole. Other lists and tables in such a box stay
    with it unless most of their characters are links. If no box is in the high cluster, lines are chosen one by one:
    content lines, those between two of them in one box, and headings right before one.
    """
    lines = [p.lines[i] for i in index]
    body = np.array([x[2] == 0 for x in lines])
    box = np.array([x[3] for x in lines])
    size, tags, linked = (np.bincount(box, np.array(v) * body, len(p.boxes)) for v in zip(*[(len(x[0]), max(1, x[1]), x[4]) for x in lines], strict=True))
    mass = np.bincount(box, np.array([len(x[0]) for x in lines]) * (body & content), len(p.boxes))
    high = (size > 0) & (size >= level * tags) & (mass >= SURE * size)
    if not high.any():
        keep = body & content
        for b in np.unique(box[keep]):
            own = np.flatnonzero(body & (box == b))
            at = np.flatnonzero(keep[own])
            first = at[0]
            while first and lines[own[first - 1]][5]:
                first -= 1
            keep[own[first : at[-1] + 1]] = True
        return keep
    for i, (outer, tag) in enumerate(p.boxes[1:], 1):  # outer boxes come first
        high[i] |= tag in LISTS and high[outer] and 2 * linked[i] <= size[i]
    return body & high[box]


def extract(html: str | None, sigma: float = 1.0, cut: float = 1.0) -> str:
    """The main text of one page.

    The ratio of a line is its characters over its tags; smoothed ratios above cut standard deviations over nothing
    (the threshold of the clustering) are content lines, with those that join them in an article or main. Each of these
    is a region; the body around them is one too, of which only what clusters() selects counts. If a marked region holds
    most content characters, the content lines of the marked ones are the text; if the body does, its clusters are, with
    those of the marked regions that reach the level without their neighbours' help.
    """
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    p.close_line()
    index = [i for i, x in enumerate(p.lines) if x[0]]
    if not index:
        return ""
    lines = [p.lines[i] for i in index]
    region, chars = np.array([x[2] for x in lines]), np.array([len(x[0]) for x in lines])
    content, level = content_lines(p, index, region, sigma, cut)
    body = clusters(p, index, content, level)
    mass = np.bincount(region, chars * content * (body | (region > 0)), len(p.regions))
    chosen = mass > 0
    if mass[0] > mass[1:].max(initial=0):
        tags = np.bincount(region, np.array([max(1, x[1]) for x in lines]), len(p.regions))
        chosen &= np.bincount(region, chars, len(p.regions)) >= level * tags
    else:
        body[:] = False  # the marked regions hold the text
    keep = body | (chosen[region] & (region > 0) & content)
    return "\n".join(x[0] for x, k in zip(lines, keep, strict=True) if k)


def extract_text(df: DataFrame, keep: list[str], html_col: str = "html", **limits) -> DataFrame:
    """The kept columns, text and n_chars of every row's whole page. No shuffle, one page in memory at a time.

    Null, empty or tag-only pages give an empty text; malformed markup is read as far as it goes; a very long page is
    parsed whole, in time that follows its length; repeated rows each give a row; an empty table gives an empty result;
    columns that aren't kept don't matter, and a kept one named text or n_chars is replaced by the result's. Of boxes
    with equal mass none is preferred: all in the high cluster stay.
    """
    keep = [c for c in keep if c not in ("text", "n_chars")]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["text string", "n_chars long"])

    def run(batches):
        for batch in batches:
            texts = [extract(x.as_py(), **limits) for x in columns_of(batch, ["__html"])[0]]
            yield pa.RecordBatch.from_arrays([*columns_of(batch, keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return map_arrow(df.select(*[df[c] for c in keep], df[html_col].alias("__html")), run, schema)
