"""Files of which only the needed byte ranges are read."""

from __future__ import annotations

import os
import re

#: Bytes of a page, and the pages that are kept: headers are read in many small pieces.
PAGE = 1 << 16
KEPT = 64


def local_path(path: str) -> str | None:
    """Path of a file that tasks can open themselves, local or mounted; None in other file systems."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(.*)$", path, re.DOTALL)
    if not scheme:
        return path
    return re.sub(r"^//[^/]*", "", scheme[2]) if scheme[1] == "file" else None


class Ranged:
    """Slices of a file as bytes; small ones come from pages that are kept for a while."""

    def __init__(self, path: str):
        self.path = path
        self.size = os.path.getsize(path)
        self.pages: dict[int, bytes] = {}
        self.bytes_read = 0

    def __len__(self) -> int:
        return self.size

    def _read(self, start: int, end: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(start)
            out = f.read(end - start)
        self.bytes_read += len(out)
        return out

    def _page(self, n: int) -> bytes:
        if n not in self.pages:
            if len(self.pages) >= KEPT:
                self.pages.pop(next(iter(self.pages)))
            self.pages[n] = self._read(n * PAGE, min((n + 1) * PAGE, self.size))
        return self.pages[n]

    def __getitem__(self, part: slice) -> bytes:
        start, end, _ = part.indices(self.size)
        if end <= start:
            return b""
        if end - start > PAGE:
            return self._read(start, end)
        first = start // PAGE
        got = b"".join(self._page(n) for n in range(first, (end - 1) // PAGE + 1))
        return got[start - first * PAGE : end - first * PAGE]
