"""ODS workbooks: cells of content.xml, with repeated rows and cells unrolled where they hold something."""

from __future__ import annotations

import io
from collections.abc import Iterator
from xml.etree import ElementTree
from zipfile import ZipFile

from .xlsx import Limits, check_archive

_T = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_O = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
_P = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}p"


def cells(data: bytes, sheet: str | None = None, limits: Limits | None = None) -> Iterator[tuple]:
    z = ZipFile(io.BytesIO(data))
    check_archive(z, limits or Limits())
    with z.open("content.xml") as f:
        name, row = None, 0
        for event, e in ElementTree.iterparse(f, events=("start", "end")):
            if event == "start" and e.tag == f"{_T}table":
                name, row = e.get(f"{_T}name"), 0
            elif event == "end" and e.tag == f"{_T}table-row":
                times, col, found = int(e.get(f"{_T}number-rows-repeated", 1)), 0, []
                for c in e:
                    if c.tag not in (f"{_T}table-cell", f"{_T}covered-table-cell"):
                        continue
                    n, kind = int(c.get(f"{_T}number-columns-repeated", 1)), c.get(f"{_O}value-type")
                    if kind:
                        found += [(col + k + 1, *_value(c, kind), (c.get(f"{_T}formula") or "").removeprefix("of:=") or None) for k in range(n)]
                    col += n
                if found and (sheet is None or sheet == name):
                    for k in range(times):
                        for at, what, value, formula in found:
                            yield name, row + k + 1, at, what, value, formula, "normal" if formula else None, "General"
                row += times
                e.clear()


def _value(c: ElementTree.Element, kind: str) -> tuple[str, str]:
    if kind in ("float", "currency", "percentage"):
        return "number", c.get(f"{_O}value")
    if kind == "boolean":
        return "bool", c.get(f"{_O}boolean-value")
    if kind == "date":
        moment = c.get(f"{_O}date-value")
        return ("datetime", moment.replace("T", " ")) if "T" in moment else ("date", moment)
    return "string", "\n".join("".join(p.itertext()) for p in c.findall(_P))
