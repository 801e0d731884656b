"""Notation of one document: sanitise, tokenise, pair, recognise, normalise, and the projections of the result.

Pairing needs a stack and recognising needs its context, so both run here, on one text at a time, without Spark; ``parse`` brings it
to DataFrames in Arrow batches. Positions inside are code points; results have UTF-8 bytes.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np

from ..functions.tables import ACCENTS, BOUTEN, CLASS_PREFIX, CLOSERS, ELEMENT_PREFIX, ELEMENTS, GAIJI_DESCRIPTIONS, HEADINGS, KAERITEN, OPENERS, SECTIONS, SENTINELS, WHITE, gaiji_codes

TOKEN = re.compile("《《|》》|[｜《》［］＃※〔〕「」]|\n")
SENTINEL = re.compile("[\ue001-\ue004]")
_RULE = re.compile("-{10,}|={10,}|_{10,}")
_ACCENT = re.compile("|".join(map(re.escape, sorted(ACCENTS, key=len, reverse=True))))
_TORTOISE = re.compile("〔([^〕]*)〕")
_BASE = re.compile("[㐀-䶿一-鿿豈-﫿\U00020000-\U0002ffff々〆]")
_DIGITS = "([0-9０-９]+)"
_LEAF_INDENT, _LEAF_ALIGN = re.compile(_DIGITS + "字下げ"), re.compile(f"地から{_DIGITS}字上げ")
_OPEN_INDENT, _OPEN_ALIGN = re.compile(f"ここから{_DIGITS}字下げ"), re.compile(f"ここから地から{_DIGITS}字上げ")
_PICTURE = re.compile("挿絵（([^）]+)）入る", re.S)
_OKURIGANA = re.compile("（[ぁ-ゟ゠-ヿｦ-ﾟ一-鿿㐀-䶿豈-﫿]{1,6}）")
_UNICODE = re.compile(r"U\+([0-9A-Fa-f]{1,6})")


# Sanitising


def isolate_rules(text: str) -> str:
    """A blank line before each rule line that follows a line with something on it."""
    out, before = [], False
    for line in text.split("\n"):
        bare = line.strip(WHITE)
        if before and _RULE.fullmatch(bare):
            out.append("")
        out.append(line)
        before = bool(bare)
    return "\n".join(out)


def rewrite_accents(text: str) -> str:
    return _TORTOISE.sub(lambda m: "〔" + _ACCENT.sub(lambda a: ACCENTS[a[0]], m[1]) + "〕", text)


def sanitize(text: str) -> str:
    text = text.lstrip("\ufeff")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if _RULE.search(text):
        text = isolate_rules(text)
    return rewrite_accents(text) if "〔" in text else text


# Tokens and pairs


@dataclass(slots=True)
class Event:
    """``what``: text, newline, solo, open, close or unmatched; ``kind``: of the pair or trigger; ``match``: the other end's index."""

    what: str
    kind: str
    start: int
    end: int
    match: int = -1


def pair_up(text: str) -> tuple[list[Event], list[int], list[int]]:
    """All events; the indexes of closers that found their opener, in order; the openers left over, innermost first."""
    events, at, stack, closed = [], 0, [], []
    add, opener, closer = events.append, OPENERS.get, CLOSERS.get
    for m in TOKEN.finditer(text):
        start, end = m.span()
        if start > at:
            add(Event("text", "", at, start))
        at, token = end, m[0]
        if token == "\n":
            add(Event("newline", "", start, end))
        elif kind := opener(token):
            stack.append(len(events))
            add(Event("open", kind, start, end))
        elif kind := closer(token):
            if stack and events[stack[-1]].kind == kind:
                i = stack.pop()
                events[i].match = len(events)
                closed.append(len(events))
                add(Event("close", kind, start, end, i))
            else:
                add(Event("unmatched", kind, start, end))
        else:
            add(Event("solo", token, start, end))
    if at < len(text):
        add(Event("text", "", at, len(text)))
    return events, closed, stack[::-1]


# Recognising

#: A part of nested content: ("text", text), ("gaiji", description, ucs, mencode) or ("annotation", raw, kind).
Part = tuple


@dataclass(slots=True)
class Node:
    """``ref``: inline, blockLeaf, blockOpen or blockClose; ``kind``: as on the wire, except that containers have their own kind in ``a``."""

    ref: str
    kind: str
    start: int = 0
    end: int = 0
    a: dict = field(default_factory=dict)


def plain(content: list[Part]) -> list[Part]:
    """Text alone is one part."""
    if content and all(p[0] == "text" for p in content):
        return [("text", "".join(p[1] for p in content))]
    return content


def number(digits: str) -> int | None:
    n = int(digits.translate(str.maketrans("０１２３４５６７８９", "0123456789")))
    return n if n < 256 else None


def resolve(description: str, mencode: str | None) -> str | None:
    if mencode is not None:
        if found := gaiji_codes().get(mencode):
            return found
        if m := _UNICODE.fullmatch(mencode):
            code = int(m[1], 16)
            if code < 0x110000 and not 0xD800 <= code < 0xE000:
                return chr(code)
    return GAIJI_DESCRIPTIONS.get(description) or (description if len(description) == 1 else None)


EXACT = {
    "改ページ": ("blockLeaf", "pageBreak", {}),
    **{k: ("blockLeaf", "sectionBreak", {"section": v}) for k, v in SECTIONS.items()},
    "地付き": ("inline", "alignEnd", {"offset": 0}),
    "罫囲み": ("blockOpen", "keigakomi", {}),
    "罫囲み終わり": ("blockClose", "keigakomi", {}),
    "ここから字下げ": ("blockOpen", "indent", {"amount": 1}),
    "ここで字下げ終わり": ("blockClose", "indent", {"amount": 0}),
    "ここから地付き": ("blockOpen", "alignEnd", {"offset": 0}),
    "ここで地付き終わり": ("blockClose", "alignEnd", {"offset": 0}),
    "割り注": ("inline", "annotation", {"raw": "［＃割り注］", "annotation_kind": "warichuOpen"}),
    "割り注終わり": ("inline", "annotation", {"raw": "［＃割り注終わり］", "annotation_kind": "warichuClose"}),
    **{k: ("inline", "kaeriten", {"mark": k}) for k in KAERITEN},
}
#: Pattern, least number, place, kind, name of the number.
NUMBERED = [(_LEAF_INDENT, 1, "inline", "indent", "amount"), (_LEAF_ALIGN, 1, "inline", "alignEnd", "offset"), (_OPEN_INDENT, 0, "blockOpen", "indent", "amount"), (_OPEN_ALIGN, 0, "blockOpen", "alignEnd", "offset")]


def keyword(body: str) -> Node | None:
    """The node of a body that is a keyword."""
    if found := EXACT.get(body):
        return Node(found[0], found[1], a=dict(found[2]))
    for pattern, least, ref, kind, name in NUMBERED:
        if m := pattern.fullmatch(body):
            n = number(m[1])
            return Node(ref, kind, a={name: n}) if n is not None and n >= least else None
    if _OKURIGANA.fullmatch(body):
        return Node("inline", "kaeriten", a={"mark": body})
    if m := _PICTURE.fullmatch(body):
        return Node("blockLeaf", "sashie", a={"file": m[1]})
    return None


def base_start(text: str) -> int:
    """Where the trailing run of characters that may carry a reading begins."""
    i = len(text)
    while i and _BASE.match(text, i - 1):
        i -= 1
    return i


def first_quotes(text: str, least: int) -> dict[str, int] | None:
    """Where each quoted text (from an opening quote to the next closing one) is first opened; none if there are fewer than ``least`` different ones."""
    out, end = {}, -1
    for m in re.finditer("「", text):
        if end < m.end() and (end := text.find("」", m.end())) < 0:
            break
        if m.end() < end:
            out.setdefault(text[m.end() : end], m.start())
    return out if len(out) >= least else None


class Recognizer:
    """``spans``: (kind, start, end, node) that tile the text; kinds plain, newline, node."""

    def __init__(self, text: str, quoted_from: int | None = None):
        self.text = text
        self.quoted = None if quoted_from is None else first_quotes(text, quoted_from)
        self.events, self.closed, self.unclosed = pair_up(text)
        self.spans: list[tuple[str, int, int, Node | None]] = []
        self.firsts: dict[str, int] = {}
        self.run: int | None = None  # where the plain run that isn't written yet begins
        self._walk()

    # the walk over top-level events

    def _flush(self, to: int) -> None:
        if self.run is not None:
            if self.run < to:
                self.spans.append(("plain", self.run, to, None))
            self.run = None

    def _begin(self, at: int) -> None:
        if self.run is None:
            self.run = at

    def _newline(self, e: Event) -> None:
        self._flush(e.start)
        self.spans.append(("newline", e.start, e.end, None))

    def _as_plain(self, first: int, last: int) -> None:
        for e in self.events[first:last]:
            if e.what == "newline":
                self._newline(e)
            else:
                self._begin(e.start)

    def _walk(self) -> None:
        events, i, n = self.events, 0, len(self.events)
        mark = None  # a reference mark that a bracket may take
        while i < n:
            e = events[i]
            taken, mark = mark, None
            if taken is not None and not (e.what == "open" and e.kind == "bracket"):
                self._begin(taken)
                taken = None
            if e.what == "newline":
                self._newline(e)
            elif e.what == "solo" and e.kind == "※":
                mark = e.start
            elif e.what == "open":
                stop = e.match if e.match >= 0 else n
                if e.kind in ("quote", "tortoise"):
                    # dialogue and accent brackets hold plain text only
                    self._flush(e.start)
                    self._as_plain(i, min(stop + 1, n))
                else:
                    if e.kind == "bracket":
                        self._flush(e.start if taken is None else taken)
                    node = self._node(i, taken) if e.match >= 0 else None
                    if node:
                        self._flush(node.start)
                        self.spans.append(("node", node.start, node.end, node))
                    else:
                        if taken is not None:
                            self._begin(taken)
                        self._as_plain(i, min(stop + 1, n))
                i = min(stop, n)
            else:
                self._begin(e.start)
            i += 1
        if mark is not None:
            self._begin(mark)
        self._flush(len(self.text))

    def _node(self, i: int, mark: int | None) -> Node | None:
        kind = self.events[i].kind
        if kind == "ruby":
            return self._ruby(i)
        if kind == "doubleRuby":
            return self._double(i)
        if mark is not None:
            if found := self._gaiji(i, mark):
                return Node("inline", "gaiji", *found[:2], {"description": found[2][1], "ucs": found[2][2], "mencode": found[2][3]})
            self._begin(mark)
        return self._annotation(i)[0]

    # what stands at an opener

    def _between(self, i: int) -> str:
        return self.text[self.events[i].end : self.events[self.events[i].match].start]

    def _ruby(self, i: int) -> Node | None:
        e, close = self.events[i], self.events[self.events[i].match]
        if self.run is None or e.end >= close.start:
            return None
        before = self.text[self.run : e.start]
        bar = before.rfind("｜")
        start = self.run + (bar if bar >= 0 else base_start(before))
        base = self.text[start + (bar >= 0) : e.start]
        if not base:
            return None
        return Node("inline", "ruby", start, close.end, {"base": [("text", base)], "reading": self._content(i), "explicit": bar >= 0})

    def _double(self, i: int) -> Node | None:
        content = self._content(i)
        if not any(p[0] != "text" or p[1] for p in content):
            return None
        return Node("inline", "doubleRuby", self.events[i].start, self.events[self.events[i].match].end, {"content": content})

    def _content(self, i: int) -> list[Part]:
        """What lies between an opener and its closer; out-of-set characters and annotations in it are parts of their own."""
        events, close = self.events, self.events[i].match
        parts: list[Part] = []
        at, k = events[i].end, i + 1
        while k < close:
            e, found = events[k], None
            if e.what == "solo" and e.kind == "※" and k + 1 < close and events[k + 1].kind == "bracket" and events[k + 1].match in range(k, close):
                if g := self._gaiji(k + 1, e.start):
                    found, after = (g[0], g[1], g[2]), events[k + 1].match + 1
            if not found and e.what == "open" and e.kind == "bracket" and e.match in range(k, close):
                node, raw = self._annotation(k)
                if node:
                    found, after = (node.start, node.end, raw), e.match + 1
            if found:
                if found[0] > at:
                    parts.append(("text", self.text[at : found[0]]))
                parts.append(found[2])
                at, k = found[1], after
            else:
                k += 1
        if events[close].start > at:
            parts.append(("text", self.text[at : events[close].start]))
        return plain(parts)

    def _hash(self, i: int) -> bool:
        e = self.events[i + 1]
        return e.what == "solo" and e.kind == "＃"

    def _gaiji(self, i: int, mark: int) -> tuple[int, int, Part] | None:
        events, close = self.events, self.events[self.events[i].match]
        if not self._hash(i):
            return None
        description = mencode = None
        q = events[i + 2]
        if q.what == "open" and q.kind == "quote" and 0 <= q.match < events[i].match and q.end < events[q.match].start:
            description = self._between(i + 2)
            tail = self.text[events[q.match].end : close.start].strip(WHITE)
            mencode = tail[1:].strip(WHITE) if tail.startswith("、") else None
        else:
            body = self.text[events[i + 1].end : close.start].strip(WHITE)
            description, comma, rest = body.partition("、")
            description, mencode = (description.strip(WHITE), rest.strip(WHITE)) if comma else (body, None)
        if not description or "「" in description or "」" in description or "［＃" in description:
            return None
        return mark, close.end, ("gaiji", description, resolve(description, mencode), mencode)

    def _annotation(self, i: int) -> tuple[Node | None, Part | None]:
        """The node of a bracket, and the part it makes inside other content."""
        close = self.events[self.events[i].match]
        if not self._hash(i):
            return None, None
        start, raw = self.events[i].start, self.text[self.events[i].start : close.end]
        node = keyword(self.text[self.events[i + 1].end : close.start].strip(WHITE)) or self._forward(i)
        if node is None:
            node = Node("inline", "annotation", a={"raw": raw, "annotation_kind": "unknown"})
        node.start, node.end = start, close.end
        own = node.kind == "annotation"
        return node, ("annotation", node.a["raw"] if own else raw, node.a["annotation_kind"] if own else "unknown")

    def _first(self, target: str) -> int:
        """Where a target occurs first, looked up once for each."""
        if target not in self.firsts:
            self.firsts[target] = self.text.find(target)
        return self.firsts[target]

    def _forward(self, i: int) -> Node | None:
        """Emphasis, upright digits and headings, which name text that stands before them."""
        events, last = self.events, self.events[i].match
        targets, k, end = [], i + 2, 0
        while events[k].what == "open" and events[k].kind == "quote":
            if not 0 <= events[k].match < last:
                return None
            if body := self._between(k):
                targets.append(body)
            end, k = events[events[k].match].end, events[k].match + 1
        if not targets:
            return None
        suffix = self.text[end : events[last].start].strip(WHITE)
        if self.quoted is None:
            there = lambda t: 0 <= self._first(t) <= events[i].start - len(t)
        else:
            there = lambda t: self.quoted.get(t, len(self.text)) < events[i].start
        for lead, position in (("に", "right"), ("の左に", "left")):
            if suffix.startswith(lead) and (kind := suffix[len(lead) :]) in BOUTEN:
                if all(map(there, targets)):
                    return Node("inline", "bouten", a={"bouten_kind": kind, "position": position, "content": [("text", "、".join(targets))]})
                return None
        if suffix == "は縦中横" and there(targets[0]):
            return Node("inline", "tateChuYoko", a={"content": [("text", targets[0])]})
        if suffix.startswith("は") and (level := HEADINGS.get(suffix[1:])) and all(map(there, targets)):
            return Node("inline", "headingHint", a={"level": level, "target": "".join(targets)})
        return None


# Byte offsets


class Offsets:
    def __init__(self, text: str):
        self.sums = None
        if not text.isascii():
            if len(text) < 200:  # an array costs more than such a text
                self.sums = [0, *accumulate([1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4 for c in text])]
            else:
                code = np.frombuffer(text.encode("utf-32-le"), "<u4")
                self.sums = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))]).tolist()

    def __call__(self, at: int) -> int:
        return at if self.sums is None else self.sums[at]


# The whole


class Parsed:
    """Everything about one source text. Spans of nodes, pairs and diagnostics are bytes of the sanitised text, container pairs of the normalised."""

    def __init__(self, source: str, quoted_from: int | None = None):
        self.source, self.quoted_from = source, quoted_from
        self.text = sanitize(source)
        trivial = not TOKEN.search(self.text)
        self.at = Offsets(self.text)
        r = None if trivial else Recognizer(self.text, quoted_from)
        self.events, self.closed, self.unclosed = (r.events, r.closed, r.unclosed) if r else ([Event("text", "", 0, len(self.text))] if self.text else [], [], [])
        self.spans = r.spans if r else ([("plain", 0, len(self.text), None)] if self.text else [])
        self.nodes = [s[3] for s in self.spans if s[0] == "node"]
        self._normalize()

    def _normalize(self) -> None:
        out, size, stack = [], 0, []
        self.place: dict[int, Node] = {}  # by code point of the normalised text
        self.containers: list[tuple[Node, int, int]] = []
        for kind, start, end, node in self.spans:
            if kind == "plain":
                piece, lead = self.text[start:end], 0
            elif kind == "newline":
                piece, lead = "\n", 0
            else:
                block = node.ref != "inline"
                piece, lead = ("\n\n" if block else "") + SENTINELS[node.ref] + ("\n\n" if block else ""), 2 * block
                self.place[size + lead] = node
                if node.ref == "blockOpen":
                    stack.append((node, size + lead))
                elif node.ref == "blockClose" and stack:
                    opened, at = stack.pop()
                    self.containers.append((opened, at, size + lead))
            out.append(piece)
            size += len(piece)
        self.normalized = "".join(out)

    def diagnostics(self) -> list[dict]:
        row = lambda kind, severity, s, e, c=None, p=None: {"kind": kind, "severity": severity, "source": "source", "start": self.at(s), "end": self.at(e), "codepoint": c, "pair_kind": p}
        return [
            *(row("source_contains_pua", "warning", m.start(), m.end(), m[0]) for m in SENTINEL.finditer(self.text)),
            *(row("unmatched_close", "error", e.start, e.end, None, e.kind) for e in self.events if e.what == "unmatched"),
            *(row("unclosed_bracket", "error", e.start, e.end, None, e.kind) for e in (self.events[i] for i in self.unclosed)),
        ]

    def pair_links(self) -> list[dict]:
        out = []
        for i in self.closed:
            c, o = self.events[i], self.events[self.events[i].match]
            out.append({"kind": c.kind, "open_start": self.at(o.start), "open_end": self.at(o.end), "close_start": self.at(c.start), "close_end": self.at(c.end)})
        return out

    def wire_kind(self, n: Node) -> str:
        return {"blockOpen": "containerOpen", "blockClose": "containerClose"}.get(n.ref, n.kind)

    def node_rows(self) -> list[dict]:
        at = Offsets(self.normalized)
        out = []
        for p, n in self.place.items():
            a = dict(n.a)
            if n.ref in ("blockOpen", "blockClose"):
                a["container"] = n.kind
            for k in ("base", "reading", "content"):
                if k in a:
                    a[k] = [dict(zip(("seg_kind", "text"), p[:2], strict=True)) if p[0] == "text" else {"seg_kind": p[0], "text": p[1], "ucs": p[2], "mencode": p[3]} if p[0] == "gaiji" else {"seg_kind": p[0], "text": p[1], "annotation_kind": p[2]} for p in a[k]]
            if "bouten_kind" in a:
                a["bouten_kind"] = BOUTEN[a["bouten_kind"]][0]
            out.append({"node_ref": n.ref, "kind": self.wire_kind(n), "start": self.at(n.start), "end": self.at(n.end), "norm_pos": at(p), "attrs": a})
        return out

    def container_pairs(self) -> list[dict]:
        at = Offsets(self.normalized)
        return [{"kind": n.kind, "amount": n.a.get("amount"), "offset": n.a.get("offset"), "open_norm": at(o), "close_norm": at(c)} for n, o, c in self.containers]

    def span_rows(self) -> list[dict]:
        name = {"inline": "node", "blockLeaf": "node"}
        return [{"span_kind": k if n is None else name.get(n.ref, n.ref), "start": self.at(s), "end": self.at(e)} for k, s, e, n in self.spans]

    # projections

    def html(self) -> str:
        return _Html(self).result

    def serialize(self) -> str:
        """The canonical source. Private-use marks go before anything else is read, since what they kept apart may be notation without them."""
        if SENTINEL.search(self.text):
            return Parsed(SENTINEL.sub("", self.source), self.quoted_from).serialize()
        put = lambda m: source_of(n) if (n := self.place.get(m.start())) else ""
        out = re.sub("\n{3,}", "\n\n", SENTINEL.sub(put, self.normalized))
        return isolate_rules(out) if _RULE.search(out) else out

    def cst(self) -> list[dict]:
        """Preorder rows; the leaves' texts make up the sanitised text."""
        rows = [{"ord": 0, "depth": 0, "parent_ord": None, "kind": "Document", "text": None, "start": 0, "end": self.at(len(self.text))}]
        parents, at = [0], 0

        def add(kind: str, start: int, end: int, leaf: bool) -> int:
            rows.append({"ord": len(rows), "depth": len(parents), "parent_ord": parents[-1], "kind": kind, "text": self.text[start:end] if leaf else None, "start": self.at(start), "end": self.at(end)})
            return len(rows) - 1

        for n in self.nodes:
            if n.start > at:
                add("Plain", at, n.start, True)
            at = n.end
            if n.ref == "blockOpen":
                parents.append(add("Container", n.start, n.end, False))
                add("ContainerOpen", n.start, n.end, True)
            elif n.ref == "blockClose":
                add("ContainerClose", n.start, n.end, True)
                if len(parents) > 1:
                    rows[parents.pop()]["end"] = self.at(n.end)
            else:
                parents.append(add("Construct", n.start, n.end, False))
                add("ConstructText", n.start, n.end, True)
                parents.pop()
        if at < len(self.text):
            add("Plain", at, len(self.text), True)
        for p in parents[1:]:
            rows[p]["end"] = rows[0]["end"]
        return rows

    def pandoc(self) -> str:
        return json.dumps({"blocks": _Pandoc(self).blocks, "meta": {}, "pandoc-api-version": [1, 23]}, ensure_ascii=False, separators=(",", ":"))


# HTML


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#x27;")


def tag(name: str, classes: str, body: str, attributes: str = "") -> str:
    names = " ".join(CLASS_PREFIX + c for c in classes.split())
    return f'<{name} class="{names}"{attributes}>{body}</{name}>'


def html_part(p: Part) -> str:
    if p[0] == "text":
        return escape(p[1])
    if p[0] == "gaiji":
        if p[2]:
            points = " ".join(f"U+{ord(c):04X}" for c in p[2])
            return tag("span", "gaiji", p[2], f' data-codepoint="{points}"')
        return tag("span", "gaiji", escape(p[1]), f' data-description="{escape(p[1])}"')
    if p[2] == "warichuOpen":
        return f'<span class="{CLASS_PREFIX}warichu">'
    return "</span>" if p[2] == "warichuClose" else tag("span", "annotation", escape(p[1]), " hidden")


def html_content(content: list[Part]) -> str:
    return "".join(map(html_part, content))


def html_node(n: Node) -> str:
    a, kind = n.a, n.kind
    if n.ref == "blockClose":
        return "</div>"
    if n.ref == "blockOpen":
        names, data = {"indent": (f"indent container-indent-{a.get('amount')}", f' data-amount="{a.get("amount")}"'), "alignEnd": ("align-end", f' data-offset="{a.get("offset")}"')}.get(kind, (kind, ""))
        return tag("div", f"container container-{names}", "", data).removesuffix("</div>")
    if kind == "ruby":
        return f"<ruby>{html_content(a['base'])}<rp>(</rp><rt>{html_content(a['reading'])}</rt><rp>)</rp></ruby>"
    if kind == "bouten":
        return tag("em", f"bouten bouten-{BOUTEN[a['bouten_kind']][0]} bouten-{a['position']}", html_content(a["content"]))
    if kind == "tateChuYoko":
        return tag("span", "tcy", html_content(a["content"]))
    if kind == "gaiji":
        return html_part(("gaiji", a["description"], a["ucs"], a["mencode"]))
    if kind == "indent":
        return tag("span", f"indent indent-{a['amount']}", "", f' data-amount="{a["amount"]}"')
    if kind == "alignEnd":
        return tag("span", f"align-end align-end-{a['offset']}" if a["offset"] else "align-end", "", f' data-offset="{a["offset"]}"')
    if kind == "pageBreak":
        return tag("div", "page-break", "")
    if kind == "sectionBreak":
        return tag("div", f"section-break section-break-{a['section']}", "")
    if kind == "annotation":
        return html_part(("annotation", a["raw"], a["annotation_kind"]))
    if kind == "kaeriten":
        return tag("sup", "kaeriten", escape(a["mark"]))
    if kind == "doubleRuby":
        return tag("span", "double-ruby", f"≪{html_content(a['content'])}≫")
    return f"<!-- {ELEMENT_PREFIX}{ELEMENTS[kind]} -->"


class _Html:
    """Paragraphs: a blank line or a block ends one, a single line end is a break; blocks are kept apart by a line end."""

    def __init__(self, parsed: Parsed):
        self.out: list[str] = []
        self.open = self.gap = False
        text, at = parsed.normalized, 0
        for m in re.finditer("[\ue001-\ue004\n]", text):
            if m.start() > at:
                self._inline(escape(text[at : m.start()]))
            at = m.end()
            if m[0] == "\n":
                follows = text[at : at + 1]
                if follows == "\n":
                    self._close()
                elif follows and self.open:
                    self.out.append("<br />\n")
            elif node := parsed.place.get(m.start()):
                if node.ref == "inline":
                    self._inline(html_node(node))
                else:
                    self._close()
                    self._space()
                    self.out.append(html_node(node))
                    self.gap = True
        if at < len(text):
            self._inline(escape(text[at:]))
        self._close()
        self.result = "".join(self.out)

    def _space(self) -> None:
        if self.gap:
            self.out.append("\n")
            self.gap = False

    def _inline(self, html: str) -> None:
        if not self.open:
            self._space()
            self.out.append("<p>")
            self.open = True
        self.out.append(html)

    def _close(self) -> None:
        if self.open:
            self.out.append("</p>\n")
            self.open = self.gap = False


# Source


def source_part(p: Part) -> str:
    if p[0] == "gaiji":
        return f"※［＃「{p[1]}」" + (f"、{p[3]}" if p[3] is not None else "") + "］"
    return p[1]


def source_content(content: list[Part]) -> str:
    return "".join(map(source_part, content))


def source_of(n: Node) -> str:
    """The canonical notation of a node."""
    a, kind = n.a, n.kind
    if n.ref in ("blockOpen", "blockClose"):
        opens = n.ref == "blockOpen"
        if kind == "keigakomi":
            return "［＃罫囲み］" if opens else "［＃罫囲み終わり］"
        name = "地付き" if kind == "alignEnd" else "字下げ"
        return f"［＃ここから{name}］" if opens else f"［＃ここで{name}終わり］"
    if kind == "ruby":
        return f"｜{source_content(a['base'])}《{source_content(a['reading'])}》"
    if kind == "doubleRuby":
        return f"《《{source_content(a['content'])}》》"
    if kind == "gaiji":
        return source_part(("gaiji", a["description"], a["ucs"], a["mencode"]))
    if kind == "annotation":
        return a["raw"]
    target = a["content"][0][1] if "content" in a else a.get("target")
    inner = {
        "bouten": lambda: f"「{target}」{'の左に' if a['position'] == 'left' else 'に'}{a['bouten_kind']}",
        "tateChuYoko": lambda: f"「{target}」は縦中横",
        "headingHint": lambda: f"「{target}」は{[k for k, v in HEADINGS.items() if v == a['level']][0]}",
        "kaeriten": lambda: a["mark"],
        "pageBreak": lambda: "改ページ",
        "sectionBreak": lambda: [k for k, v in SECTIONS.items() if v == a["section"]][0],
        "indent": lambda: "字下げ" if a["amount"] == 1 else f"{a['amount']}字下げ",
        "alignEnd": lambda: f"地から{a['offset']}字上げ" if a["offset"] else "地付き",
        "sashie": lambda: f"挿絵（{a['file']}）入る",
    }[kind]
    return f"［＃{inner()}］"


# Pandoc


def _attr(name: str = "", **pairs) -> list:
    return ["", [CLASS_PREFIX + name], [[k, str(v)] for k, v in pairs.items() if v is not None]]


def _span(attr: list, inlines: list) -> dict:
    return {"t": "Span", "c": [attr, inlines]}


def _str(text: str) -> dict:
    return {"t": "Str", "c": text}


def _pandoc_part(p: Part) -> dict:
    if p[0] == "text":
        return _str(p[1])
    if p[0] == "gaiji":
        quote = p[2] and ("'" if len(p[2]) == 1 else '"')
        shown = f"{'Char' if len(p[2]) == 1 else 'Multi'}({quote}{p[2]}{quote})" if p[2] else "〓"
        return _span(_attr("gaiji", description=p[1], mencode=p[3]), [_str(shown)])
    return _span(_attr("annotation", kind={"unknown": "unknown"}.get(p[2], "other"), raw=p[1]), [])


def _pandoc_inline(n: Node) -> dict:
    a, kind = n.a, n.kind
    parts = lambda k: [_pandoc_part(p) for p in a[k]]
    if kind == "ruby":
        return _span(_attr("ruby", delim="explicit" if a["explicit"] else "implicit"), [_span(_attr("ruby-base"), parts("base")), _span(_attr("ruby-reading"), parts("reading"))])
    if kind == "bouten":
        return _span(_attr("bouten", kind=BOUTEN[a["bouten_kind"]][1], position=a["position"]), parts("content"))
    if kind in ("tateChuYoko", "doubleRuby"):
        return _span(_attr({"tateChuYoko": "tate-chu-yoko"}.get(kind, "double-ruby")), parts("content"))
    if kind == "gaiji":
        return _pandoc_part(("gaiji", a["description"], a["ucs"], a["mencode"]))
    if kind == "annotation":
        return _pandoc_part(("annotation", a["raw"], a["annotation_kind"]))
    names = {"indent": ("indent", ("amount",)), "alignEnd": ("align-end", ("offset",)), "kaeriten": ("kaeriten", ("mark",)), "headingHint": ("heading-hint", ("level", "target"))}
    name, keys = names[kind]
    return _span(_attr(name, **{k: a[k] for k in keys}), [])


class _Pandoc:
    def __init__(self, parsed: Parsed):
        self.stack: list[tuple[list, list, list]] = [([], [], [])]  # attributes, blocks, inlines of the paragraph in work
        at, text = 0, parsed.text
        for n in parsed.nodes:
            self._plain(text[at : n.start])
            at = n.end
            if n.ref == "inline":
                self.stack[-1][2].append(_pandoc_inline(n))
                continue
            self._paragraph()
            if n.ref == "blockOpen":
                name = {"alignEnd": "container-align-end"}.get(n.kind, f"container-{n.kind}")
                self.stack.append((_attr(name, **n.a), [], []))
            elif n.ref == "blockClose":
                self._pop()
            else:
                self.stack[-1][1].append(self._leaf(n))
        self._plain(text[at:])
        while len(self.stack) > 1:
            self._pop()
        self._paragraph()
        self.blocks = self.stack[0][1]

    def _plain(self, chunk: str) -> None:
        for i, line in enumerate(chunk.split("\n") if chunk else ()):
            if i and not line:
                self._paragraph()
            elif i:
                self.stack[-1][2].append({"t": "SoftBreak"})
            if line:
                self.stack[-1][2].append(_str(line))

    def _paragraph(self) -> None:
        _, blocks, inlines = self.stack[-1]
        if inlines:
            blocks.append({"t": "Para", "c": inlines[:]})
            inlines.clear()

    def _pop(self) -> None:
        self._paragraph()
        if len(self.stack) > 1:
            attr, blocks, _ = self.stack.pop()
            self.stack[-1][1].append({"t": "Div", "c": [attr, blocks]})

    def _leaf(self, n: Node) -> dict:
        if n.kind == "pageBreak":
            return {"t": "HorizontalRule"}
        if n.kind == "sectionBreak":
            return {"t": "Div", "c": [["", [f"{CLASS_PREFIX}section-break", f"{CLASS_PREFIX}section-break-{n.a['section']}"], []], []]}
        return {"t": "Para", "c": [{"t": "Image", "c": [_attr("sashie"), [], [n.a["file"], ""]]}]}
