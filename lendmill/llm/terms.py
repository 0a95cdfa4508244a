"""Terms of texts as UTF-8 bytes: maximal runs of the wanted bytes, with only A-Z lower-cased."""

from __future__ import annotations


def term_table(digits: bool) -> bytes:
    """A translation for ``terms_of``: letters (A-Z lower-cased) and all bytes beyond ASCII stay, also digits if asked for.

    Code points beyond ASCII are made of bytes from 0x80 on only, so runs of bytes are runs of code points.
    """
    kept = [b >= 128 or chr(b).isalpha() or digits and chr(b).isdigit() for b in range(256)]
    return bytes((b + 32 if 65 <= b <= 90 else b) if kept[b] else 32 for b in range(256))


def terms_of(text: str | None, table: bytes) -> list[bytes]:
    """All terms of the whole text in its order, with repeats; null has none."""
    return text.encode().translate(table).split() if text else []
