"""What a function makes of tokens that come again and again."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

#: Tokens that are kept, and the longest of them.
KEPT, KEPT_LENGTH = 1 << 17, 64


class Known(dict):
    """What a function makes of tokens, worked out when first asked for; full, it begins anew."""

    def __init__(self, make: Callable[[bytes], Any]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, token: bytes) -> Any:
        out = self.make(token)
        if len(token) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[token] = out
        return out
