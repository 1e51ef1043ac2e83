"""HTML pages to a table of nodes, one row each, over the parser of the standard library in Arrow batches.

``pre`` is the place in document order and ``end`` the ``pre`` of the last descendant, so ancestors are intervals.
The tree builder closes p, li, dd, dt, option, td and tr where HTML implies it, knows void elements, and drops open
elements down to the one an end tag names. It is no browser: malformed pages can give other trees.

The content of an open shadow root (<template shadowrootmode="open">) is a group of its own, and no other element's text
holds what scripts, styles, other templates and noscript hold.

``text_content`` is the first TEXT_CAP characters of an element's text. ``text_len`` is the length of all of it without white
space at its ends, and with what scripts and styles in the element hold. Elements that rules judge by their text at
any length (``read_whole``) have all of it in ``whole_text``; it is null for others.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NON_CONTENT = {"script", "style", "noscript", "template"}
BLOCK = set("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: An opening tag closes those of an open one, up to the named containers.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"})}
CLOSES_P = BLOCK - {"br", "option", "body", "html", "select", "td", "tr", "legend", "tbody", "thead", "tfoot", "th", "summary"}
TEXT_CAP = 240
#: Tags, and parts of the class attribute, of elements whose text is kept whole.
WHOLE, WHOLE_CLASSES = {"a", "title", "desc", "text"}, ("modal", "popup", "newsletter")
NODES = (
    "page_id long, node_id int, parent_id int, pre int, end int, depth int, n_children int, kind string, tag string, attrs map<string,string>, text string, grp int, "
    "in_non_content boolean, in_svg boolean, in_form boolean, in_article boolean, nearest_block int, text_content string, text_len int, whole_text string"
)


def read_whole(tag: str, attrs: dict) -> bool:
    return tag in WHOLE or attrs.get("role") == "dialog" or any(c in attrs.get("class", "") for c in WHOLE_CLASSES)


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.stack: list[dict] = []
        self.grp = 0

    def _add(self, kind: str, tag: str | None, attrs: dict | None, text: str | None) -> dict:
        up = self.stack[-1] if self.stack else None
        node = {
            "node_id": len(self.nodes), "parent_id": up and up["node_id"], "pre": len(self.nodes), "end": len(self.nodes), "depth": len(self.stack), "n_children": 0, "kind": kind, "tag": tag, "attrs": list((attrs or {}).items()), "text": text, "grp": None,
            "in_non_content": bool(up and (up["in_non_content"] or (up["tag"] in NON_CONTENT and not up["_open"]))), "in_svg": bool(up and (up["in_svg"] or up["tag"] == "svg")), "in_form": bool(up and (up["in_form"] or up["tag"] == "form")),
            "in_article": bool(up and (up["in_article"] or up["tag"] in ("article", "section", "aside", "nav"))), "nearest_block": up and (up["node_id"] if up["tag"] in BLOCK else up["nearest_block"]), "_text": [], "_len": 0, "_gap": 0, "_said": 0, "_open": tag == "template" and (attrs or {}).get("shadowrootmode") == "open", "_whole": [] if kind == "element" and read_whole(tag, attrs) else None,
        }
        self.nodes.append(node)
        if up and kind == "element":
            up["n_children"] += 1
        return node

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in IMPLIED:
            same, stop = IMPLIED[tag]
            closed = len(self.stack)
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i]["tag"] in stop:
                    break
                if self.stack[i]["tag"] in same:
                    closed = i
            del self.stack[closed:]
        elif tag in CLOSES_P:
            open_p = [i for i, n in enumerate(self.stack) if n["tag"] == "p"]
            if open_p:
                del self.stack[open_p[-1] :]
        if tag in BLOCK or tag == "template":
            self.grp += 1
        node = self._add("element", tag, {k: v or "" for k, v in reversed(attrs)}, None)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and any(n["tag"] == "svg" for n in self.stack):
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i]["tag"] == tag:
                del self.stack[i:]
                break
        if tag in BLOCK or tag == "template":
            self.grp += 1

    def handle_data(self, data: str) -> None:
        node = self._add("text", None, None, data)
        node["grp"] = self.grp
        # White space counts once something follows it.
        first, last = len(data) - len(data.lstrip()), len(data) - len(data.rstrip())
        zone = next((i for i, up in enumerate(self.stack) if up["tag"] in NON_CONTENT and not up["_open"]), len(self.stack))
        for i, up in enumerate(self.stack):
            if last == len(data):
                up["_gap"] += len(data) * (up["_len"] > 0)
            else:
                up["_len"] += (up["_gap"] + len(data) if up["_len"] else len(data) - first) - last
                up["_gap"] = last
            if i < zone < len(self.stack):
                continue  # what a script or style holds is no text of what stands around it
            if up["_said"] < TEXT_CAP + 16:
                piece = data if up["_said"] else data.lstrip()
                up["_text"].append(piece[: TEXT_CAP + 16])
                up["_said"] += len(piece)
            if up["_whole"] is not None:
                up["_whole"].append(data)

    def handle_comment(self, data: str) -> None:
        self._add("comment", None, None, data)

    def finish(self) -> list[dict]:
        for node in reversed(self.nodes):
            if node["parent_id"] is not None:
                up = self.nodes[node["parent_id"]]
                up["end"] = max(up["end"], node["end"])
        for node in self.nodes:
            said, length = "".join(node.pop("_text")).strip(), node.pop("_len")
            for name in ("_said", "_open", "_gap"):
                node.pop(name)
            whole = node.pop("_whole")
            node["whole_text"] = None if whole is None else "".join(whole).strip()
            element = node["kind"] == "element"
            node["text_content"], node["text_len"] = (said[:TEXT_CAP], length) if element else (None, None)
        return self.nodes


def parse(html: str) -> list[dict]:
    """The nodes of a page in document order."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.finish()


_ARROW = pa.schema([
    ("page_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("pre", pa.int32()), ("end", pa.int32()), ("depth", pa.int32()), ("n_children", pa.int32()), ("kind", pa.string()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("grp", pa.int32()),
    ("in_non_content", pa.bool_()), ("in_svg", pa.bool_()), ("in_form", pa.bool_()), ("in_article", pa.bool_()), ("nearest_block", pa.int32()), ("text_content", pa.string()), ("text_len", pa.int32()), ("whole_text", pa.string()),
])


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html", batch: int = 4096, url: str | None = None) -> DataFrame:
    """The node table of ``pages``, with the page's url on each node if ``url`` names its column.

    Filter pages before, as nothing is pushed through the parser. Null html has no nodes.
    """
    schema = _ARROW.append(pa.field("url", pa.string())) if url else _ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for some in batches:
            for i, (page, text) in enumerate(zip(some.column(0).to_pylist(), some.column(1), strict=True)):
                more = {"page_id": page} | ({"url": some.column(2)[i].as_py()} if url else {})
                rows.extend(more | n for n in parse(text.as_py() or ""))
                if len(rows) >= batch:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)

    return pages.select(key, html, *([url] if url else [])).mapInArrow(run, NODES + (", url string" if url else ""))
