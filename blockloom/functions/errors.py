"""What can be wrong with a bzip2 stream, as values."""

from __future__ import annotations

#: The names under which damage is reported.
NAMES = (
    "NotBzip2", "Truncated", "BadBlockMagic", "BadSymbolMap", "BadGroupCount", "BadSelectors", "BadCodeLengths",
    "BadHuffmanCode", "RunTooLong", "BlockTooLarge", "BadOriginPointer", "BlockCrcMismatch", "StreamCrcMismatch", "BadLevel",
)


class Damaged(ValueError):
    def __init__(self, name: str):
        assert name in NAMES
        super().__init__(name)
        self.name = name


def checked_level(level: int) -> int:
    if not 1 <= level <= 9:
        raise Damaged("BadLevel")
    return level
