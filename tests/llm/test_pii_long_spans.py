"""Spans longer than the windows' common part, at every offset, with a tagger that is always right about what it sees."""

from __future__ import annotations

import numpy as np
import pytest

from gneiss.llm import pii


class Right:
    """Tags obfuscated addresses, and the pieces of them that a window's edges leave."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.start, self.end = text, start, end

    def spans(self, x: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        out = []
        for row in x:
            shown = "".join(map(chr, row[row < 128]))
            at = self.text.index(shown)
            a, b = max(self.start, at) - at, min(self.end, at + len(shown)) - at
            out.append([(a, b, 0, 1.0)] if a < b else [])
        return out


@pytest.mark.parametrize("size", [40, 47, 48, 69, 94, 95, 96, 97, 120, 150, 700])
def test_long_address_at_every_offset(size):
    own = "firstname.lastname [at] department"
    own += ".university"[: size - len(own) - 4] if size < 60 else " [dot] "
    own += "x" * (size - len(own) - 4) + ".org"
    assert len(own) == size and pii.valid(0, own)
    words = " ".join(f"w{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}" for k in range(600))
    for offset in range(96):
        lead = words[: 200 + offset - 1] + " "
        text = f"{lead}{own} {words[1000:]}"
        (base, every), = pii.find_spans([text], Right(text, len(lead), len(lead) + size))
        assert base == [] and every == [(len(lead), 0, len(lead) + size)]
