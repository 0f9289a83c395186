"""Content of web pages by text-to-tag ratios.

The standard library's parser streams events; block-level tags and line breaks
end a line. A line's ratio is its text length over its number of tags. Ratios
are smoothed with a Gaussian kernel, and lines whose smoothed ratio reaches the
threshold (the standard deviation of the smoothed ratios, as in the
published method) are content; neighbouring content lines form a region.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread

RADIUS = 2
SIGMA = 1.0
LEVEL = 1.0
SILENT = frozenset("script style head noscript template svg math iframe object select textarea".split())
#: What may stand in a head, and elements whose content the parser takes raw.
HEADED = frozenset("title meta link script style base noscript template".split())
RAW = frozenset(("script", "style"))
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)


class Events(HTMLParser):
    """Streams (kind, tag or data); kind is one of ``start empty end data``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        self.found.append(("start", tag))

    def handle_startendtag(self, tag, attrs):
        self.found.append(("empty", tag))

    def handle_endtag(self, tag):
        self.found.append(("end", tag))

    def handle_data(self, data):
        self.found.append(("data", data))


def events(html: str) -> list[tuple[str, str]]:
    """The parser's events; markup the parser rejects is text."""
    parser = Events()
    rest = html
    while True:
        try:
            parser.feed(rest)
            parser.close()
            return parser.found
        except AssertionError:
            # a marked section that isn't one: step over its opening bracket
            rest = parser.rawdata[1:]
            parser.rawdata = ""


def silent_spans(found: list[tuple[str, str]]) -> list[int]:
    """For each event that opens a silent element, the event that ends it.

    An element ends at its end tag, or at that of a silent element around it; a
    head also before the first element that may not stand in one. An element
    that nothing ends is no silent one, as else a forgotten tag would swallow
    the rest of the page; only unclosed scripts and styles reach to the end, as
    in browsers. Entries of other events are -1.
    """
    ends = [-1] * len(found)
    stack: list[tuple[str, int]] = []
    open_: Counter[str] = Counter()
    for i, (kind, tag) in enumerate(found):
        if kind == "start":
            if open_["head"] and tag not in HEADED:
                # a noscript that the head leaves open doesn't keep it open
                k = next(k for k, (t, _) in enumerate(stack) if t == "head")
                if all(t in ("noscript", "head") for t, _ in stack[k:]):
                    ends[stack[k][1]] = i - 1
                    del stack[k]
                    open_["head"] -= 1
            if tag in SILENT:
                stack.append((tag, i))
                open_[tag] += 1
        elif kind == "end" and open_[tag]:
            while True:
                t, at = stack.pop()
                ends[at] = i
                open_[t] -= 1
                if t == tag:
                    break
    for tag, at in stack:
        if tag in RAW:
            ends[at] = len(found) - 1
    return ends


def lines(html: str) -> tuple[list[str], list[int]]:
    """(text, number of tags) of each line."""
    found = events(html)
    ends = silent_spans(found)
    texts: list[str] = []
    tags: list[int] = []
    held: list[str] = []
    count = 0

    def end_line() -> None:
        nonlocal held, count
        text = " ".join("".join(held).split())
        if text or count:
            texts.append(text)
            tags.append(count)
        held, count = [], 0

    until = -1
    for i, (kind, what) in enumerate(found):
        if i <= until:
            continue
        if ends[i] >= 0:
            until = ends[i]
        elif kind == "data":
            first, *rest = what.split("\n")
            held.append(first)
            for line in rest:
                if any(map(str.strip, held)):
                    end_line()
                held.append(line)
        elif kind == "end":
            count += 1
            if what in BLOCK:
                end_line()
        else:
            if what in BLOCK:
                end_line()
            count += 1
    end_line()
    return texts, tags


def smooth(ratios: np.ndarray, radius: int = RADIUS, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian-weighted mean over ``radius`` lines either side, within bounds."""
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    total, weight = np.zeros(len(ratios)), np.zeros(len(ratios))
    for k, w in zip(range(-radius, radius + 1), kernel):
        a, b = max(0, -k), min(len(ratios), len(ratios) - k)
        if a < b:
            total[a:b] += w * ratios[a + k : b + k]
            weight[a:b] += w
    return total / np.maximum(weight, 1e-300)


def extract(html: str | None, radius: int = RADIUS, sigma: float = SIGMA, level: float = LEVEL) -> tuple[str, int] | None:
    """(text of the content lines joined by newlines, number of regions)."""
    if html is None:
        return None
    texts, tags = lines(html)
    if not texts:
        return "", 0
    ratios = np.log1p(np.array([len(t) for t in texts]) / np.maximum(1, np.array(tags)))
    even = smooth(ratios, radius, sigma)
    # ratios of pages without clutter hardly vary, then all lines reach it
    content = (even >= level * even.std()) & (ratios >= level * even.std())
    kept = [t for t, ok in zip(texts, content) if ok and t]
    starts = int(np.count_nonzero(content & ~np.concatenate([[False], content[:-1]])))
    return "\n".join(kept), starts if kept else 0


def extracted(pages: DataFrame, radius: int = RADIUS, sigma: float = SIGMA, level: float = LEVEL) -> DataFrame:
    """(page_id, text, regions) for every row.

    Defined cases: null html gives null text and regions; empty html, or html
    without text, gives '' and 0; html without tags is one region of all its
    lines; malformed tags are read as the parser reads them; a silent element
    (head, select, noscript and the like) that is never closed is read as any
    other, see ``silent_spans``; null ids and repeated rows pass row by row; whole pages are read however long; an
    empty table gives an empty result; other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [extract(h, radius, sigma, level) for h in part.column(1).to_pylist()]
                yield pa.record_batch(
                    {
                        "page_id": part.column(0),
                        "text": pa.array([f and f[0] for f in found], pa.string()),
                        "regions": pa.array([f and f[1] for f in found], pa.int32()),
                    }
                )

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, text string, regions int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))
