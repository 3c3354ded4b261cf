"""Per-page helpers that run inside Spark tasks: markup to node rows and back.

Only what an expression cannot do lives here: reading markup into a pre-order node list,
writing a node list as markup, and rendering it as markdown. Rules over nodes are Spark
expressions (see gleanwork.operators.html).
"""

from __future__ import annotations

import html
import re
import sys
from html.parser import HTMLParser

from gleanwork.functions.text import readable_references

# Elements without content, and elements that are page noise.
VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr"
    " basefont bgsound command frame image isindex nextid spacer".split()
)
NOISE = frozenset("script style svg noscript link meta head".split())
RAW = frozenset(("script", "style", "template"))


class _Reader(HTMLParser):
    """Builds nodes in document order; an end tag closes the nearest open namesake."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        # Per tag, where its open elements stand in `open`: an end tag finds its partner, or
        # that it has none, without a walk over the others.
        self.places: dict[str, list[int]] = {}

    def _add(self, tag: str, attrs: dict | None, text: str | None) -> int:
        parent = self.open[-1] if self.open else -1
        pre = len(self.nodes)
        self.nodes.append(
            {"pre": pre, "size": 1, "parent": parent, "depth": len(self.open), "tag": tag,
             "attrs": attrs, "text": text, "linked": False, "noise": False}
        )
        return pre

    def handle_starttag(self, tag, attrs):
        pre = self._add(tag, {k: v if v is not None else "" for k, v in attrs}, None)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(pre)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        places = self.places.get(tag)
        if places:
            depth = places[-1]
            for pre in self.open[depth:]:
                self.places[self.nodes[pre]["tag"]].pop()
            del self.open[depth:]

    def handle_data(self, data):
        raw = bool(self.open) and self.nodes[self.open[-1]]["tag"] in RAW
        self._add("#raw" if raw else "#text", None, data)

    def handle_comment(self, data):
        self._add("#comment", None, data)

    def handle_decl(self, decl):
        self._add("#decl", None, decl)

    def unknown_decl(self, data):
        self._add("#text" if data.upper().startswith("CDATA[") else "#decl", None, data.removeprefix("CDATA["))

    def handle_pi(self, data):
        self._add("#decl", None, data)

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # no known section: a declaration up to the next bracket
            end = self.rawdata.find(">", i + 3)
            if end < 0:
                return -1
            self.handle_decl(self.rawdata[i + 2 : end])
            return end + 1


def nodes_of(markup: str) -> list[dict]:
    """The page's nodes without sizes and marks, which markdown does not look at."""
    reader = _Reader()
    reader.feed(readable_references(markup))
    reader.close()
    return reader.nodes


def read(markup: str) -> list[dict]:
    """The page's nodes, with subtree sizes and the marks the pruning rules use."""
    nodes = nodes_of(markup)
    for node in reversed(nodes):
        if node["tag"] == "a" and "href" in (node["attrs"] or {}):
            node["linked"] = True
        if node["parent"] >= 0:
            above = nodes[node["parent"]]
            above["size"] += node["size"]
            above["linked"] = above["linked"] or node["linked"]
    inside = [False] * len(nodes)
    for node in nodes:
        up = node["parent"]
        is_link = node["tag"] == "a" and node["attrs"] is not None and "href" in node["attrs"]
        inside[node["pre"]] = is_link or (up >= 0 and inside[up])
        if node["tag"].startswith("#"):
            # Text belongs to its element: it stays where that one stays.
            node["linked"] = up < 0 or nodes[up]["linked"]
        else:
            node["linked"] = node["linked"] or inside[node["pre"]]
        node["noise"] = (
            node["tag"] in NOISE or node["tag"] == "#comment" or (up >= 0 and nodes[up]["noise"])
        )
    return nodes


def _children(nodes: list[dict]) -> tuple[list[dict], dict[int, list[dict]]]:
    """Roots and children of a possibly filtered node list, in document order."""
    present = {node["pre"] for node in nodes}
    roots: list[dict] = []
    below: dict[int, list[dict]] = {}
    for node in nodes:
        if node["parent"] in present:
            below.setdefault(node["parent"], []).append(node)
        else:
            roots.append(node)
    return roots, below


def _attrs(node: dict) -> dict:
    attrs = node["attrs"]
    return dict(attrs) if attrs else {}


def write(nodes: list[dict]) -> str:
    """Markup of a node list (iterative, so depth is no limit)."""
    roots, below = _children(nodes)
    out: list[str] = []
    stack: list = list(reversed(roots))
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        tag = node["tag"]
        if tag == "#text":
            out.append(html.escape(node["text"], quote=False))
        elif tag == "#raw":
            out.append(node["text"])
        elif tag == "#comment":
            out.append(f"<!--{node['text']}-->")
        elif tag == "#decl":
            out.append(f"<!{node['text']}>")
        else:
            attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in _attrs(node).items())
            if tag in VOID:
                out.append(f"<{tag}{attrs}/>")
            else:
                out.append(f"<{tag}{attrs}>")
                stack.append(f"</{tag}>")
                stack.extend(reversed(below.get(node["pre"], [])))
    return "".join(out)


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_EMPHASIS = {"b": "**", "strong": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}
_BLOCKS = frozenset(
    "address article aside body dd div dl dt fieldset figure footer form header html main nav"
    " p section".split()
)

_ALL_BLOCKS = _BLOCKS | _HEADINGS | {"ul", "ol", "li", "br", "hr", "table", "tr", "pre", "blockquote"}
_BREAKS, _BLANKS, _MARKS = re.compile(r"[\t \r\n]*[\r\n][\t \r\n]*"), re.compile(r"[\t ]+"), re.compile(r"([*_])")


def _join(parts: list[str]) -> str:
    """Concatenate rendered pieces; blank lines meeting at a seam never add up past one."""
    out, tail = [], 0  # the line breaks at the end are kept apart
    for part in parts:
        if not part:
            continue
        core = part.lstrip("\n")
        lead = len(part) - len(core)
        tail = min(2, max(tail, lead)) if tail and lead else tail + lead
        if core:
            body = core.rstrip("\n")
            out += ["\n" * tail, body]
            tail = len(core) - len(body)
    return "".join(out) + "\n" * tail


def _finished(task):
    """What a task returns. A task yields the tasks it waits for, so that a page's depth
    costs memory of this stack alone."""
    stack, value = [task], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def _wrap(text: str, mark: str) -> str:
    """Put marks around the text and its outer blanks outside of them."""
    core = text.strip()
    if not core:
        return text
    start = " " if text[0].isspace() else ""
    end = " " if text[-1].isspace() else ""
    return f"{start}{mark}{core}{mark}{end}"


def _indent(text: str, width: int) -> str:
    pad = " " * width
    first, *rest = text.split("\n")
    return "\n".join([first, *[pad + line if line.strip() else line for line in rest]])


def markdown(nodes: list[dict]) -> str:
    """Markdown of a node list: `#` headings starting at one, `-` bullets, no images."""
    roots, below = _children(nodes)
    levels = [int(node["tag"][1]) for node in nodes if node["tag"] in _HEADINGS]
    shift = min(levels) - 1 if levels else 0
    by_pre = {node["pre"]: node for node in nodes}

    def kids(node: dict) -> list[dict]:
        return below.get(node["pre"], [])

    def is_block(node: dict | None) -> bool:
        return node is not None and node["tag"] in _ALL_BLOCKS

    def text_of(node: dict, before: dict | None, after: dict | None, verbatim: bool) -> str:
        text = node["text"]
        if verbatim:
            return text
        if "\n" in text or "\r" in text:
            text = _BREAKS.sub("\n", text)
        text = _BLANKS.sub(" ", text) if "  " in text or "\t" in text else text
        text = _MARKS.sub(r"\\\1", text) if "*" in text or "_" in text else text
        up = by_pre.get(node["parent"])
        if is_block(before) or (before is None and (up is None or is_block(up))):
            text = text.lstrip("\t \r\n")
        if is_block(after) or (after is None and (up is None or is_block(up))):
            text = text.rstrip("\t \r\n")
        return text

    def render(siblings: list[dict], verbatim: bool = False, depth: int = 0):
        shown = [n for n in siblings if n["tag"] not in ("#comment", "#decl", "#raw")]
        parts = []
        for place, node in enumerate(shown):
            if node["tag"] == "#text":
                before = shown[place - 1] if place else None
                after = shown[place + 1] if place + 1 < len(shown) else None
                parts.append(text_of(node, before, after, verbatim))
            else:
                parts.append((yield element(node, verbatim, depth)))
        return _join(parts)

    def listed(node: dict, depth: int, verbatim: bool):
        ordered = node["tag"] == "ol"
        start = _attrs(node).get("start", "1")
        number = int(start) if start.isdecimal() and len(start) <= sys.get_int_max_str_digits() else 1
        lines = []
        for item in kids(node):
            if item["tag"] != "li":
                if not item["tag"].startswith("#"):
                    lines.append((yield element(item, verbatim, depth)).strip("\n"))
                continue
            bullet = f"{number}. " if ordered else "- "
            number += 1
            body = (yield render(kids(item), verbatim, depth + 1)).strip()
            lines.append(bullet + _indent(body, len(bullet)))
        return "\n".join(line for line in lines if line)

    def rows(node: dict):
        found, waiting = [], list(reversed(kids(node)))
        while waiting:  # the rows of this table, not of those inside its cells
            below_it = waiting.pop()
            if below_it["tag"] == "tr":
                cells = []
                for cell in kids(below_it):
                    if cell["tag"] in ("td", "th"):
                        cells.append(" ".join((yield render(kids(cell))).split()))
                found.append(cells)
            elif below_it["tag"] != "table":
                waiting.extend(reversed(kids(below_it)))
        return found

    def element(node: dict, verbatim: bool, depth: int):
        tag = node["tag"]
        if tag == "img" or tag in NOISE:
            return ""
        if tag == "br":
            return "\n" if verbatim else "  \n"
        if tag == "hr":
            return "\n\n---\n\n"
        if tag in ("ul", "ol"):
            body = yield listed(node, depth, verbatim)
            return f"\n{body}" if depth else f"\n\n{body}\n\n"
        if tag == "pre":
            code = yield render(kids(node), True, depth)
            return f"\n\n```\n{code}\n```\n\n"
        if tag == "table":
            table = yield rows(node)
            if not table:
                return ""
            head, *rest = table
            lines = ["| " + " | ".join(head) + " |", "| " + " | ".join("---" for _ in head) + " |"]
            lines += ["| " + " | ".join(row) + " |" for row in rest]
            return "\n\n" + "\n".join(lines) + "\n\n"
        inner = yield render(kids(node), verbatim, depth)
        if tag in _HEADINGS:
            text = " ".join(inner.split())
            level = max(1, int(tag[1]) - max(shift, 0))
            return f"\n\n{'#' * level} {text}\n\n" if text else ""
        if tag in _EMPHASIS:
            return _wrap(inner, _EMPHASIS[tag])
        if tag in ("code", "kbd", "samp"):
            return inner if verbatim else _wrap(inner, "`")
        if tag == "a":
            href = _attrs(node).get("href")
            if not href or not inner.strip():
                return inner
            title = _attrs(node).get("title")
            if inner.replace(r"\_", "_") == href and not title:
                return f"<{href}>"
            label = f'{href} "{title}"' if title else href
            wrapped = _wrap(inner, "\0")
            start, core, end = wrapped.split("\0")
            return f"{start}[{core}]({label}){end}"
        if tag == "blockquote":
            quoted = "\n".join("> " + line if line else ">" for line in inner.strip().split("\n"))
            return f"\n{quoted}\n\n"
        if tag in _BLOCKS or tag == "li":
            text = inner.strip("\n \t")
            # A break at the end of a block is content, its trailing blanks included.
            if inner.rstrip("\n").endswith("  "):
                text = inner.strip("\n")
            return f"\n\n{text}\n\n" if text else ""
        return inner

    return _finished(render(roots)).strip()
