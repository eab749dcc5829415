"""Bytes as printable characters, and the ids of single bytes, which follow the order of those characters."""

from __future__ import annotations

#: Control tokens have the ids below this one.
BYTES_FROM = 8


def byte_symbols() -> list[str]:
    """For each byte the character that stands for it: itself where Latin-1 prints it, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


#: Bytes in the order of their characters, and each byte's id.
IN_ORDER = tuple(sorted(range(256), key=byte_symbols().__getitem__))
BYTE_IDS = tuple(BYTES_FROM + IN_ORDER.index(b) for b in range(256))
