"""Exact whole-text encoding with a tokenizers file, sped up by remembering the ids of space-separated pieces."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from . import common

_STUCK = re.compile(r"(?:[^\w\s]|_)[.,] ")  # a stop or comma that continues a run of punctuation
_ENDS = (".", ",")


def _latin(text: str) -> bool:
    """Only characters below U+0100: these have no canonical compositions among them and plain lower case."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Neither kind of tokenizer merges over a space that stands after a character that isn't white space:
    byte-level ones start a new pre-token there, word-end ones drop the space. So a text's ids are those of
    its pieces in turn, and most pieces recur. A text in which such a boundary falls inside a run of white
    space is encoded as one, unless the tokenizer drops white space anyway; so is a text that holds one of the file's added
    tokens, which the library finds before all else (special_as_text: it is ordinary text instead). A stop or comma after a letter is a
    pre-token of its own as well; with it set apart, and in lower case where the tokenizer lowers it, pieces
    recur still more often. Memory: two dictionaries of at most `keep` pieces each.
    """

    def __init__(self, path: str, keep: int = 400_000, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.tok.no_truncation()
        self.tok.no_padding()
        one, a, b, up = (self._ids(x) for x in ("a b", "a", "b", "A"))
        self.drops, self.lowers = one == a + b, up == a
        found = [t.content for t in self.tok.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.added = [a.lower() if self.lowers else a for a in found]
        self.keep, self.new, self.old, self.heads = keep, {}, {}, {}
        self.ends = {p: self._one(p) for p in _ENDS}
        # of byte-level files: which tokens begin with a space
        self.leads = None
        if not self.drops and not any(" " in a for a in self.added):
            vocab = self.tok.get_vocab()
            self.leads = np.zeros(max(vocab.values()) + 1, bool)
            self.leads[[i for t, i in vocab.items() if t[:1] == "\u0120"]] = True
        self.wide = self.tok.get_vocab_size() > 1 << 16

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _one(self, text: str) -> bytes:
        return np.asarray(self._ids(text), "<u4").tobytes()

    def _first(self, piece: str) -> bytes:
        """Ids of a text's first piece, which no space leads."""
        if piece not in self.heads:
            if len(self.heads) > 20_000:
                self.heads.clear()
            self.heads[piece] = self._one(piece)
        return self.heads[piece]

    def _learn(self, pieces: set[str]) -> bool:
        """Makes all pieces known; False if one of them ends in white space, where a boundary may not be one."""
        if len(self.new) + 2 * len(pieces) > self.keep:
            self.old, self.new = self.new, {}
        old, new, todo, later = self.old, self.new, [], []
        again = old.keys() & pieces
        for p in again:
            new[p] = old.pop(p)
        for p in pieces - again:
            last = p[-1:]
            if last in _ENDS and (body := p[:-1]).isalpha() and _latin(body):
                later.append((p, body))
                if body not in new and body not in pieces:
                    if body in old:
                        new[body] = old.pop(body)
                    else:
                        todo.append(body)
            elif self.drops or (last and not last.isspace()):
                todo.append(p)
            else:
                return False
        if todo:
            if self.leads is not None:
                todo = self._together(todo)
            lead = todo if self.drops else [p if p[0] == "\n" else " " + p for p in todo]
            for p, e in zip(todo, self.tok.encode_batch_fast(lead, add_special_tokens=False), strict=True):
                new[p] = array("I", e.ids).tobytes()  # native order: little-endian wherever Spark's workers run
        for p, body in later:
            new[p] = new[body] + self.ends[p[-1]]
        return True

    def _together(self, todo: list[str]) -> list[str]:
        """Makes pieces known by encoding them as one text, which is cut where a token begins with a space; returns those left."""
        spaced = [p for p in todo if p[0] != "\n"]
        ids = np.array(self.tok.encode_batch_fast([" " + " ".join(spaced)], add_special_tokens=False)[0].ids if spaced else [], "<u4")
        cuts = np.flatnonzero(self.leads[ids])
        if len(cuts) != len(spaced):
            return todo
        raw, cuts = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
        for p, i, j in zip(spaced, cuts, cuts[1:], strict=False):
            self.new[p] = raw[i:j]
        return [p for p in todo if p[0] == "\n"]

    def _holds_added(self, text: str) -> bool:
        if self.lowers:  # then pieces are in lower case, where such a token could seem to be
            text = text.lower()
        return any(a in text for a in self.added)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self._holds_added(text):
            return self._one(text)
        head, spaced = b"", text
        if not self.drops:
            # a line feed between other signs is a pre-token of its own: it leads the piece after it
            spaced = text.replace("\n", " \n")
        elif _latin(text):
            spaced = text.replace("\n", " ")
            if self.lowers:
                spaced = spaced.lower()
            if not _STUCK.search(spaced):
                spaced = spaced.replace(", ", " , ").replace(". ", " . ")
        rest = spaced.split(" ")
        if not self.drops:
            first = rest.pop(0)
            if rest and (first[-1:].isspace() or (not first and rest[0][:1] == "\n")):
                return self._one(text)
            head = self._first(first) if first else b""
        got = list(map(self.new.get, rest))
        if None in got:
            missing = [i for i, x in enumerate(got) if x is None]
            if not self._learn({rest[i] for i in missing}):
                return self._one(text)
            for i in missing:
                got[i] = self.new[rest[i]]
        return head + b"".join(got)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker and file, until a task takes another's cache (common.take_turn)."""
    common.take_turn(path, lambda: _encoders.pop(path, None))
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
