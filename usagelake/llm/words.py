"""Words of the operators that match phrases."""

from __future__ import annotations

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
_FOLD = bytes(
    low if (low := c + 32 if 0x41 <= c <= 0x5A else c) in _KEEP else 0x20 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: runs of ASCII digits, letters with A-Z in lower case, and all that is
    beyond ASCII."""
    return (text or b"").translate(_FOLD).split()
