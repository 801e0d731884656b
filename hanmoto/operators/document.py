"""One document without Spark, for callers that hold a single text."""

from __future__ import annotations

from .kernel import Parsed
from .wire import envelope


class Document:
    def __init__(self, source: str):
        self.source = source
        self._parsed = Parsed(source)

    def to_html(self) -> str:
        return self._parsed.html()

    def serialize(self) -> str:
        return self._parsed.serialize()

    def to_pandoc(self) -> str:
        return self._parsed.pandoc()

    def diagnostics(self) -> str:
        return envelope("diagnostics", self._parsed.diagnostics())

    def nodes(self) -> str:
        return envelope("nodes", self._parsed.node_rows())

    def pairs(self) -> str:
        return envelope("pairs", self._parsed.pair_links())

    def container_pairs(self) -> str:
        return envelope("container_pairs", self._parsed.container_pairs())

    def source_byte_len(self) -> int:
        return len(self.source.encode())

    def edit(self, start: int, end: int, replacement: str) -> Document:
        raw = self.source.encode()
        if not 0 <= start <= end <= len(raw):
            raise ValueError("the span isn't within the source")
        return Document((raw[:start] + replacement.encode() + raw[end:]).decode())

    def is_canonical(self) -> bool:
        """Whether serialising gives the source again, one byte-order mark and CRLF line ends aside."""
        return self.serialize() == self.source.removeprefix("﻿").replace("\r\n", "\n")


def parse_to_html(source: str) -> str:
    return Document(source).to_html()
