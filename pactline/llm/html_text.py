"""Main text of web pages from streaming parser events.

The standard library's parser is fed once and every event is handled as it comes; no tree is built. Events fall into
lines, one per text block, each with its characters of text, its tags and the container it stands in. The logarithm of the
text-to-tag ratio per line is smoothed by a Gaussian over its neighbours and split by two-means clustering; lines above the
threshold are content lines and vote, by their length, for the containers they stand in.

What a page says of itself is evidence that the votes confirm or refute. A container that is marked as a menu, header,
footer, sidebar, notice, advert or form goes unless it holds half of all votes and no article stands beside it; a doubtful
mark (a word like share or search in a class) counts only where most of the container's text is in no content line.
Reader comments, scripts, styles and hidden parts always go. Articles and main elements are the content if they hold half
of the votes that are left; else the search goes down from the page to the smallest container with CORE of the votes,
and link lines without votes at its two ends go. Every other line of the elected containers is kept, short ones too.

Null and empty pages give an empty text. Repeated rows give repeated results. Broken markup never fails.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import slices

SIGMA, HALF, CORE = 1.0, 0.5, 0.9
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: Their text is never content.
SILENT = frozenset(
    "script style noscript template head title nav footer aside button select textarea input iframe object embed svg "
    "canvas audio video map menu dialog datalist legend label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
#: Words in class, id or role that mark what is not content: always, unless the votes refute it, or only if they confirm it.
COMMENTS = frozenset("comment comments disqus replies respond reviews".split())
MARKS = frozenset(
    "ad ads advert advertisement adverts advertising banner promo promotion sponsor sponsored sidebar aside menu nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notices popup modal overlay "
    "newsletter subscribe signup login sharing related recommended recommendations pagination pager toolbar contentinfo "
    "complementary dialog".split()
)
DOUBTFUL = frozenset("notice alert share social widget search form".split())
FREE, DOUBT, MARK, FIRM, MUTE = range(5)
_SPLIT = re.compile(r"[^a-z0-9]+")
#: HTML white space; a no-break space is text elsewhere but trims like a space here.
_SPACE = re.compile(r"\s+")


def _mark(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> int:
    """How surely an element is no content; inside: within an article."""
    if tag in SILENT:
        return MUTE
    found = MARK if tag in ("form", "fieldset") or (tag == "header" and not inside) else FREE  # an article's own header holds its title
    for name, value in attrs:
        value = (value or "").lower()
        if name in ("class", "id", "role") and (tag not in ("body", "html", "main", "article") or name == "role" or tag == "article"):
            words = set(_SPLIT.split(value))
            if tag == "article":  # a comment may be an article of its own
                found = max(found, FIRM if words & COMMENTS else FREE)
            else:
                found = max(found, FIRM if words & COMMENTS else MARK if words & MARKS else DOUBT if words & DOUBTFUL else FREE)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return MUTE
        elif name == "itemprop" and value in ("comment", "review"):
            found = FIRM
    return found


class _Events(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # tag, mute, container
        self.count: dict[str, int] = {}  # of open elements by tag
        self.parent, self.marks, self.article = [0], [FREE], [False]  # by container; 0 is the page
        self.lines: list[tuple[str, int, int, bool]] = []  # text, tags, container, whether it is a link's
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.mute, self.at = False, 0

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, self.at, 2 * self.linked > len(text)))
            self.tags = 0
        self.text.clear()
        self.linked = 0

    def _close(self, k: int) -> None:
        for tag, *_ in self.open[k:]:
            self.count[tag] -= 1
        del self.open[k:]
        _, self.mute, self.at = self.open[-1] if self.open else ("", False, 0)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCKS:
            self.end_line()
        if tag in VOID:
            return
        if tag == "body":  # a body ends whatever head left open
            self._close(0)
        if tag in ("p", "li") and self.count.get(tag):  # these end where the next of their kind begins
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    self._close(k)
                    break
                if self.open[k][0] in BLOCKS:
                    break
        mark = _mark(tag, attrs, self.article[self.at])
        mute = self.mute or mark == MUTE
        if not mute and (tag in CONTAINERS or mark):
            if tag not in BLOCKS:
                self.end_line()
            self.parent.append(self.at)
            self.marks.append(mark)
            self.article.append(self.article[self.at] or tag in ("article", "main"))
            self.at = len(self.parent) - 1
        self.mute = mute
        self.open.append((tag, mute, self.at))
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        if not self.count.get(tag):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if tag not in BLOCKS and self.open[k][2] != (self.open[k - 1][2] if k else 0):
                    self.end_line()  # an inline container ends
                self._close(k)
                return
            if tag not in BLOCKS and self.open[k][0] in BLOCKS:
                return  # an inline end tag doesn't close blocks

    def handle_data(self, data):
        if not self.mute:
            self.text.append(data)
            if self.count.get("a"):
                self.linked += len(data.strip())


def _smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(values, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def _threshold(values: np.ndarray) -> float:
    """Halfway between the two means of a one-dimensional clustering."""
    low, high = float(values.min()), float(values.max())
    for _ in range(32):
        cut = (low + high) / 2
        below, above = values[values <= cut], values[values > cut]
        if not len(below) or not len(above):
            return low
        now = float(below.mean()), float(above.mean())
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def content_lines(lines: list[tuple[str, int, int, bool]]) -> np.ndarray:
    """Of each line, whether its smoothed text-to-tag ratio is in the upper cluster."""
    ratio = _smooth(np.log1p([len(text) / max(1, tags) for text, tags, *_ in lines]), SIGMA)
    return ratio >= _threshold(ratio)


def _sums(parent: list[int], where: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of each container, the values of its lines and of all containers in it."""
    out = np.bincount(where, weights=values, minlength=len(parent))
    for k in range(len(parent) - 1, 0, -1):
        out[parent[k]] += out[k]
    return out


def _down(parent: list[int], flags: list[bool]) -> np.ndarray:
    """Whether a container or one around it has the flag."""
    out = np.array(flags)
    for k in range(1, len(parent)):
        out[k] |= out[parent[k]]
    return out


def main_text(html: str | None) -> str:
    """The main text's blocks in page order, joined by line ends."""
    events = _Events()
    try:
        events.feed(html or "")
        events.close()
    except AssertionError:  # the standard parser's own word for markup it gives up on: what came before it stands
        pass
    events.end_line()
    lines, parent, marks = events.lines, events.parent, events.marks
    if not lines:
        return ""
    where = np.array([x[2] for x in lines])
    length = np.array([len(x[0]) for x in lines], float)
    votes = np.where(content_lines(lines), length, 0.0)
    # which marks hold
    firm = _down(parent, [m == FIRM for m in marks])
    votes[firm[where]] = 0.0
    of, all_text = _sums(parent, where, votes), _sums(parent, where, length)
    free = _down(parent, [m >= MARK for m in marks])
    beside = bool(votes[np.array(events.article)[where] & ~free[where]].any())
    refuted = [m == MARK and not beside and of[k] >= HALF * of[0] > 0 for k, m in enumerate(marks)]
    confirmed = [m == DOUBT and of[k] < HALF * all_text[k] for k, m in enumerate(marks)]
    gone = _down(parent, [m == FIRM or (m == MARK and not r) or c for m, r, c in zip(marks, refuted, confirmed, strict=True)])
    left = ~gone[where]
    votes[~left] = 0.0
    # which containers hold the content
    own = np.array(events.article)[where] & left
    if own.any() and votes[own].sum() >= HALF * votes.sum():
        return "\n".join(x[0] for x, kept in zip(lines, own, strict=True) if kept)
    of, core = _sums(parent, where, votes), 0
    inner: dict[int, list[int]] = {}
    for k in range(1, len(parent)):
        inner.setdefault(parent[k], []).append(k)
    while deeper := [k for k in inner.get(core, ()) if of[k] >= CORE * of[0] > 0]:
        core = deeper[0]
    kept = np.flatnonzero(_down(parent, [k == core for k in range(len(parent))])[where] & left)
    first, last = 0, len(kept)
    while first < last and lines[kept[first]][3] and not votes[kept[first]]:
        first += 1
    while first < last and lines[kept[last - 1]][3] and not votes[kept[last - 1]]:
        last -= 1
    return "\n".join(lines[k][0] for k in kept[first:last])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text (string) and n_chars (long, code points) in place of any such columns, whatever their case."""
    taken = {html_col.lower(), "text", "n_chars"}
    kept = [c for c in pages.columns if c.lower() not in taken]
    source = pages.select(F.col(html_col).cast("string"), *kept)
    shape = StructType([*source.schema.fields[1:], StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches):
        for batch in slices(batches):
            texts = [main_text(h) for h in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*kept, "text", "n_chars"]
            )

    return source.mapInArrow(run, shape)
