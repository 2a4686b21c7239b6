"""Cutting texts where every byte-level tokenizer pattern cuts too.

A token of these patterns has white space only at its start, or is white space
throughout. So a text may be cut before any blank that follows something else,
and the pieces be encoded alone, each distinct one once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable


def pieces(text: str) -> list[str]:
    """The text cut before each blank that follows something other than white space."""
    first, *rest = text.split(" ")
    out, held = [], first
    for part in rest:
        if not held or held[-1].isspace():
            held += " " + part
        else:
            out.append(held)
            held = " " + part
    return [*out, held] if held else out


class PieceCache:
    """Encoded pieces of texts as bytes; `encode` gets the pieces that are new.

    Holds at most `limit` pieces and starts over when more are needed.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.known: dict[str, bytes] = {}
        self.after_blank: dict[str, bytes] = {}

    def _learn(self, texts: set[str]) -> None:
        new = [t for t in texts if t not in self.known]
        self.known.update(zip(new, self.encode(new), strict=True))

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """For each text the encoded pieces, joined."""
        if len(self.known) + len(self.after_blank) > self.limit:
            self.known.clear()
            self.after_blank.clear()
        out = []
        for text in texts:
            first, *parts = text.split(" ")
            try:
                out.append(self._first(first) + b"".join(map(self.after_blank.__getitem__, parts)))
                continue
            except KeyError:
                pass
            unseen = {p for p in parts if p not in self.after_blank}
            # A piece that is empty or ends in white space goes on after the blank.
            if first and all(p and not p[-1].isspace() for p in [first[-1], *unseen]):
                new = list(unseen)
                self.after_blank.update(zip(new, self.encode([" " + p for p in new]), strict=True))
                out.append(self._first(first) + b"".join(map(self.after_blank.__getitem__, parts)))
            else:
                own = pieces(text)
                self._learn(set(own))
                out.append(b"".join(map(self.known.__getitem__, own)))
        return out

    def _first(self, piece: str) -> bytes:
        if not piece or piece[-1].isspace():
            raise KeyError(piece)
        if piece not in self.known:
            self._learn({piece})
        return self.known[piece]
