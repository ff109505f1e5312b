"""Elements of HTML pages and types of JSON documents, read with a stack in Arrow batches (a pattern cannot nest)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, elements whose start ends a paragraph, and elements of formatting, whose end leaves others open.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
PROSE = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote")
ROWS = 200


class Elements(HTMLParser):
    """Wanted elements in the order of their start, each with the text of all that is in it but what is left out (by tag or id)."""

    def __init__(self, tags: frozenset, left_out: frozenset, left_out_ids: frozenset) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.left_out, self.left_out_ids = tags, left_out, left_out_ids
        self.stack: list[tuple[str, list | None, bool]] = []  # tag, its record, whether it is left out
        self.found: list[list] = []
        self.ids: set[str] = set()
        self.out = 0  # open elements that are left out

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = {k: v or "" for k, v in reversed(attrs)}  # of a repeated attribute the first counts
        if "id" in named:
            self.ids.add(named["id"])
        if tag in ENDS_PARAGRAPH:
            self._close("p", frozenset(("button", "table", "td", "th")))
        if tag == "li":
            self._close("li", frozenset(("ul", "ol", "menu")))
        record = None
        if tag in self.tags and not self.out:
            record = [tag, named, []]
            self.found.append(record)
        if tag in VOID:
            return
        gone = tag in self.left_out or named.get("id") in self.left_out_ids
        if gone and record:
            self.found.pop()
            record = None
        self.out += gone
        self.stack.append((tag, record, gone))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash at the end says nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        self._close(tag, frozenset(("td", "th", "table")) - {tag})

    def _close(self, tag: str, barriers: frozenset) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                gone = self.stack[k : k + 1] if tag in FORMATTING else self.stack[k:]
                self.out -= sum(g for *_, g in gone)
                del self.stack[k : k + len(gone)]
                return
            if self.stack[k][0] in barriers:
                return

    def handle_data(self, data: str) -> None:
        if not self.out:
            for _, record, _ in self.stack:
                if record is not None:
                    record[2].append(data)


def elements(html: str, tags: frozenset, left_out: frozenset, left_out_ids: frozenset = frozenset()) -> tuple[list[tuple[str, dict, str]], set[str]]:
    """(tag, attributes, text with single spaces) of the wanted elements, and all ids of the page."""
    page = Elements(tags, left_out, left_out_ids)
    page.feed(html)
    page.close()
    return [(tag, named, " ".join("".join(parts).split())) for tag, named, parts in page.found], page.ids


def page_elements(pages: DataFrame, tags: tuple, left_out: tuple = ()) -> DataFrame:
    """(url, at, tag, attributes, text) of the elements of each page with those tags, in order from 1; a null page has none."""
    wanted, out = frozenset(tags), frozenset(left_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                rows = [(url, at + 1, tag, list(named.items()), text) for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for at, (tag, named, text) in enumerate(elements(html or "", wanted, out)[0])]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["url", "at", "tag", "attributes", "text"])

    return pages.select(F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "url string, at int, tag string, attributes map<string,string>, text string")


def page_texts(pages: DataFrame, element_id: str, left_out: tuple = ("script", "style", "footer", "nav")) -> DataFrame:
    """(url, found, text): whether a page has an element of that id, and the text of its first `main`, or else of its body, without that element and what is left out."""
    out, ids = frozenset((*left_out, "head", "title")), frozenset((element_id,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                texts, found = [], []
                for html in b.column(1).to_pylist():
                    parts, met = elements(f"<body>{html or ''}", frozenset(("main", "body")), out, ids)
                    texts.append(next((text for tag, _, text in parts if tag == "main"), parts[0][2]))
                    found.append(element_id in met)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.bool_()), pa.array(texts, pa.string())], names=["url", "found", "text"])

    return pages.select(F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "url string, found boolean, text string")


def json_types(value: object) -> list[str]:
    """Types of a JSON-LD value: its own one or several, those of a list's values, and those of its graph, however deep."""
    open_, found = [value], []
    while open_:
        x = open_.pop()
        if isinstance(x, list):
            open_ += reversed(x)
        elif isinstance(x, dict):
            own = x.get("@type")
            found += [as_text(t) for t in own] if isinstance(own, list) else [as_text(own)] if own else []
            if isinstance(x.get("@graph"), list):
                open_.append(x["@graph"])
    return found


def as_text(x: object) -> str:
    """A JSON value as text: numbers as written by JSON, lists joined by commas, null and nothing as the empty text."""
    if isinstance(x, list):
        return ",".join(map(as_text, x))
    if isinstance(x, dict):
        return "[object Object]"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float) and x.is_integer():
        return str(int(x))
    return "" if x is None else str(x)


def parse_json(text: str) -> tuple[bool, object]:
    """Whether a text is JSON (strictly), and its value."""

    def refuse(_: str) -> None:
        raise ValueError("no JSON constant")

    try:
        return True, json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError):
        return False, None


def json_documents(rows: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """From (url, blocks): url, n_valid, n_invalid, and for each wanted type the first valid block that has it anywhere, as a map of the text of the fields asked for (of the block itself); fields that are lists have `field[]`, their length; null without such a block."""
    names = list(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid, invalid, out = [], [], {n: [] for n in names}
            for blocks in b.column(1).to_pylist():
                parsed = [parse_json(x) for x in blocks or []]
                good = [(v, set(json_types(v))) for ok, v in parsed if ok]
                valid.append(len(good))
                invalid.append(len(parsed) - len(good))
                for n in names:
                    block = next((v for v, kinds in good if n in kinds), None)
                    own = block if isinstance(block, dict) else {}
                    said = {f: as_text(own.get(f)) for f in wanted[n]} | {f"{f}[]": str(len(own[f])) for f in wanted[n] if isinstance(own.get(f), list)}
                    out[n].append(None if block is None else list(said.items()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(valid, pa.int64()), pa.array(invalid, pa.int64()), *(pa.array(out[n], pa.map_(pa.string(), pa.string())) for n in names)], names=["url", "n_valid", "n_invalid", *names])

    return rows.select(F.col("url").cast("string").alias("url"), "blocks").mapInArrow(run, "url string, n_valid long, n_invalid long, " + ", ".join(f"{n} map<string,string>" for n in names))
