"""PNG and JPEG: one page with one element; only the header is read."""

from __future__ import annotations

import struct

from quillstrata.sources.decode import Box, Decoded, Element, ParseError, Picture, element_id, register


def size_of(data: bytes) -> tuple[str, int, int]:
    """(png or jpg, width, height)."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
        return "png", *struct.unpack(">II", data[16:24])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                break
            marker = data[at + 1]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # a frame header
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpg", width, height
            at += 2 + (0 if marker == 0xFF or 0xD0 <= marker <= 0xD9 else struct.unpack(">H", data[at + 2 : at + 4])[0])
            if marker == 0xFF:
                at -= 1
    raise ParseError("neither a PNG nor a JPEG header")


@register(".png", ".jpg", ".jpeg")
def decode_image(name: str, content: bytes) -> Decoded:
    kind, width, height = size_of(content)
    bare = name.rsplit("/", 1)[-1]
    out = Decoded(bare, "image/png" if kind == "png" else "image/jpeg", bare, {"page_count": "1", "parser": "image", "image_format": "PNG" if kind == "png" else "JPEG"}, [(1, float(width), float(height))])
    ref = f"p1_i000.{kind}"
    out.add_blob(ref, content)
    out.elements.append(Element(element_id(1, 0), 0, 1, "image", Box(0, 0, width, height), image=Picture(ref, width, height, kind), attrs={"standalone": "true"}))
    return out
