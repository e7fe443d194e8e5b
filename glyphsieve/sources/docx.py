"""Text of .docx files: the literal characters of runs in the body, headers, footers and notes."""

from __future__ import annotations

import io
import zipfile
from typing import BinaryIO
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# The parts that are read.
BODY = "word/document.xml"
PARTS = ("document", "header", "footer", "footnote", "endnote")
#: Bytes that the parts of one file may unpack to, if the settings say nothing else.
MOST_BYTES = 256 << 20
#: Bytes of a part that are parsed at once.
PIECE_BYTES = 1 << 16
_PARAGRAPH, _TEXT = f"{_W}p", f"{_W}t"
_SIGNS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
_SYMBOL, _CODE = f"{_W}sym", f"{_W}char"
#: Code points that XML has no way to hold, by their hexadecimal number in a symbol element.
UNFIT = {f"{c:04X}": chr(c) for c in (*range(9), 0x0B, 0x0C, *range(0x0E, 0x20), 0xFFFE, 0xFFFF)}


class CorruptFile(ValueError):
    """The content isn't what its name says."""


class TooLarge(ValueError):
    """The content may be sound, but unpacks to more than is allowed."""


def wanted(name: str) -> bool:
    return name.startswith("word/") and name.endswith(".xml") and any(p in name for p in PARTS)


class _Paragraphs:
    """What a part says, from its parser's events: run texts with tabs and breaks, a line a paragraph; no tree is held.

    Tab stops of a paragraph's properties count as tabs, and a paragraph inside another (a text box) is part of the
    outer one too and follows it; both are as the format is commonly read here.  Of symbols only those are read that
    stand for what XML can't hold; the others are signs of a font, and no text."""

    def __init__(self) -> None:
        self.said, self.none_yet, self.listening = io.StringIO(), True, False
        self.open: list[io.StringIO] = []
        self.inner: list[io.StringIO] = []

    def start(self, tag: str, attributes: dict) -> None:
        # the text of a run's text element is what stands before anything inside it
        self.listening = tag == _TEXT
        if tag == _PARAGRAPH:
            if self.open:
                self.inner.append(io.StringIO())
            elif not self.none_yet:
                self.said.write("\n")
            self.open.append(self.inner[-1] if self.open else self.said)
            self.none_yet = False
        elif tag in _SIGNS:
            self._say(_SIGNS[tag])
        elif tag == _SYMBOL:
            self._say(UNFIT.get(attributes.get(_CODE, "").upper(), ""))

    def data(self, text: str) -> None:
        if self.listening:
            self._say(text)

    def _say(self, text: str) -> None:
        for x in self.open:
            x.write(text)

    def end(self, tag: str) -> None:
        self.listening = False
        if tag == _PARAGRAPH:
            self.open.pop()
            if not self.open and self.inner:
                for x in self.inner:
                    self.said.write("\n" + x.getvalue())
                self.inner = []

    def close(self) -> str:
        return self.said.getvalue()


def part_text(part: BinaryIO, most: int) -> str:
    """The text of a part, which is read and parsed a piece at a time."""
    parser, size, broken = ElementTree.XMLParser(target=_Paragraphs()), 0, None
    while xml := part.read(PIECE_BYTES):
        size += len(xml)
        if size > most:
            raise TooLarge(f"a part unpacks to more than {most} bytes")
        try:
            if broken is None:
                parser.feed(xml)
        except Exception as why:  # read on: if the archive is damaged, that is what is told
            broken = why
    if broken is not None:
        raise broken
    return parser.close()


def docx_text(content: bytes, most: int = MOST_BYTES) -> str:
    """The texts of the parts in the archive's order, empty ones left out."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            parts = [x for x in archive.infolist() if wanted(x.filename)]
            if BODY not in {x.filename for x in parts}:
                raise CorruptFile("no document body")
            if sum(x.file_size for x in parts) > most:
                raise TooLarge(f"the parts unpack to more than {most} bytes")
            texts = []
            for x in parts:
                with archive.open(x) as f:
                    texts.append(part_text(f, most))
    except zipfile.BadZipFile as why:
        raise CorruptFile("not a zip archive") from why
    return "\n".join(filter(None, texts))
