"""Barcode templates such as i78:um8:i58: which part of the barcode is which, in the order of the read."""

from __future__ import annotations

import re
from dataclasses import dataclass

# fixed values: the tags of a template's parts
TAGS = ("i7", "i5", "um", "--")


@dataclass(frozen=True)
class Part:
    """length bases that begin offset before the barcode's end."""

    length: int
    offset: int


@dataclass(frozen=True)
class Template:
    text: str
    i7: Part | None
    i5: Part | None
    um: Part | None
    length: int


def parse_template(text: str) -> Template:
    """Offsets run from the barcode's end, so parts are read from the last on."""
    parts: dict[str, Part] = {}
    offset = 0
    for item in reversed(text.split(":")):
        tag, size = item[:2], item[2:]
        if tag not in TAGS or not re.fullmatch(r"[0-9]+", size):
            raise ValueError(f"{text!r} is not a template: {item!r}")
        offset += int(size)
        if tag != "--":
            if tag in parts:
                raise ValueError(f"{text!r} has {tag} twice")
            parts[tag] = Part(int(size), offset)
    if "i7" not in parts:
        raise ValueError(f"{text!r} has no i7")
    return Template(text, parts["i7"], parts.get("i5"), parts.get("um"), offset)


def render_template(layout: str, umi: bool, barcode_length: int, i7_length: int, i5_length: int) -> tuple[str, str, str]:
    """A detected layout, places7[:place5]_rc7:rc5, as template text with both rc flags. Gaps become --n; with umi, the
    longest gap (the first of equals) becomes um."""
    places, flags = layout.split("_")
    named = list(zip(map(int, places.split(":")), (("i7", i7_length), ("i5", i5_length))))
    items: list[tuple[str, int]] = []
    at = 0
    for place, (tag, size) in sorted(named):
        if place > at:
            items.append(("--", place - at))
        items.append((tag, size))
        at = max(at, place) + size
    if barcode_length > at:
        items.append(("--", barcode_length - at))
    gaps = [i for i, (tag, _) in enumerate(items) if tag == "--"]
    if umi and gaps:
        longest = max(gaps, key=lambda i: (items[i][1], -i))
        items[longest] = ("um", items[longest][1])
    rc7, rc5 = flags.split(":")
    return ":".join(f"{tag}{size}" for tag, size in items), rc7, rc5
