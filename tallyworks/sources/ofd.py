"""OFD packages: an invoice XML part if there is one, else the text drawn on the pages."""

from __future__ import annotations

import io
import re
import zipfile
from xml.parsers import expat

from .einvoice import index_xml, is_invoice
from .files import decode

#: Bytes of a part that are read at most.
PART_CAP = 16 * 1024 * 1024


def text_runs(xml: str) -> str:
    """The page's TextCode runs, joined by blanks so that no two values touch."""
    runs: list[str] = []
    inside: list[str] | None = None

    def start(name: str, _: dict) -> None:
        nonlocal inside
        inside = [] if name.rsplit(":", 1)[-1].lower() == "textcode" else None

    def data(text: str) -> None:
        if inside is not None:
            inside.append(text)

    def end(_: str) -> None:
        nonlocal inside
        if inside and (text := "".join(inside).strip()):
            runs.append(text)
        inside = None

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse(re.sub(r"^\s*<\?xml[^>]*\?>", "", xml).encode("utf-8", "replace"), True)
    except expat.ExpatError:
        pass
    return " ".join(runs)


def page_number(name: str) -> int:
    """The digits of the last path segment that has any; parts without any come last."""
    for segment in reversed(name.split("/")):
        if digits := re.sub("[^0-9]", "", segment):
            return int(digits)
    return 1 << 32


def read_ofd(content: bytes) -> dict:
    """{"index" or None, "text"}; raises ValueError for what is no package."""
    index, pages = None, []
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError) as e:
        raise ValueError(f"OFD 包无法解压：{e}") from e
    with z:
        for name in z.namelist():
            if not name.lower().endswith(".xml"):
                continue
            try:
                with z.open(name) as f:
                    xml = decode(f.read(PART_CAP))
            except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError):
                continue
            if index is None and is_invoice(found := index_xml(xml)):
                index = found
            elif "content.xml" in name.lower():
                pages.append((page_number(name), xml))
    pages.sort(key=lambda p: p[0])
    return {"index": index, "text": "\n".join(text_runs(xml) for _, xml in pages)}
