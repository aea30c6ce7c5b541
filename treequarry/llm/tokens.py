"""Exact token ids of whole texts through caches of pre-tokens.

In the byte-level pattern of the vocabulary a single line end between other characters is a token of its own, and
a single space belongs to what follows it. So a text in which no white space stands beside white space splits at
line ends and spaces into chunks whose ids do not depend on their neighbours. Chunks are looked up. A missing chunk
is cut by the pattern, and the library's model encodes the pieces that are new. The library encodes whole every text
that does not split exactly (runs of white space, white space at either end, a special string), and every chunk
with characters for which Unicode versions might differ. Of a vocabulary that is not byte-level, or that has a normaliser,
every text is encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable
from functools import lru_cache

#: Longer chunks are encoded without being kept.
LONGEST = 48
#: Below it, letters, digits and the rest are told apart alike by every Unicode version.
SETTLED = "\u0250"
#: Bytes as the characters of byte-level vocabularies: printable ones stand for themselves, the others follow from U+0100.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_SIGNS = {b: chr(b) if b in PRINTABLE else chr(256 + sum(x not in PRINTABLE for x in range(b))) for b in range(256)}


def tokenizer_path(name: str) -> str:
    """A path as it is; the name of a public vocabulary by the place of its package on this machine."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def splits(chunk: str) -> bool:
    """Whether a chunk between spaces or line ends stands for itself: it is not empty, and no white space at its ends."""
    return bool(chunk) and not chunk[0].isspace() and not chunk[-1].isspace()


@lru_cache(maxsize=8)
def byte_level(path: str) -> bool:
    """Whether a vocabulary cuts texts by the known pattern into bytes, changes nothing before, and adds nothing after."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    cut, model = parts.get("pre_tokenizer") or {}, parts.get("model") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    bare = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    added = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in parts.get("added_tokens") or ())
    return plain and bare and not added and not parts.get("normalizer")


class PreTokens:
    """Values of whole texts. `value` turns a list of ids into what is kept of it (a count, bytes), `join` puts the values
    of parts together.

    Chunks come in two tiers: a first one that stays, and caches of at most `limit` entries each, which are emptied
    when they are full.
    """

    def __init__(self, name: str, value: Callable[[list[int]], object], join: Callable, first: dict | None = None, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        #: whether texts may be split; every other vocabulary is left to the library
        self.exact = byte_level(tokenizer_path(name))
        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.value, self.join, self.limit, self.first = value, join, limit, first or {}
        self.pieces: dict[str, object] = {}
        self.after_space, self.at_start = dict(self.first), {}
        self.line_end = self.whole("\n")

    def whole(self, text: str):
        return self.value(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def piece(self, piece: str):
        """What the pattern takes in one."""
        found = self.pieces.get(piece)
        if found is None:
            signs = piece.encode("utf-8").decode("latin-1").translate(BYTE_SIGNS)
            found = self.pieces[piece] = self.value([t.id for t in self.model.tokenize(signs)])
        return found

    def chunk(self, chunk: str, before: str):
        """A chunk after a space or, with an empty `before`, at the start of a line; None if the text may not be split there."""
        settled = len(chunk) <= LONGEST and (chunk.isascii() or max(chunk) < SETTLED)
        if settled and chunk.isalpha():
            return self.piece(before + chunk)
        if not splits(chunk):
            return None
        if settled and len(chunk.split()) == 1:
            return self.join([self.piece(p) for p in self.cut(before + chunk)])
        return self.whole(before + chunk)

    def learn(self, chunks: Iterable[str]) -> dict[str, object]:
        """Values of chunks that follow a space."""
        return {c: self.chunk(c, " ") for c in chunks}

    def many(self, texts: list[str | None], at_once: int = 64) -> list:
        """The value of each text; null counts as empty."""
        return [v for i in range(0, len(texts), at_once) for v in self._some(texts[i : i + at_once])]

    def _some(self, texts: list[str | None]) -> list:
        if len(self.after_space) > self.limit + len(self.first):
            self.after_space = dict(self.first)
        if len(self.at_start) > self.limit // 4:
            self.at_start = {}
        if len(self.pieces) > self.limit:
            self.pieces = {}
        lines = [None if not t or not self.exact or any(s in t for s in self.special) else [line.split(" ") for line in t.split("\n")] for t in texts]
        wanted: set[str] = set()
        for text in lines:
            for line in text or ():
                wanted.update(line[1:])
        look, start_look = self.after_space, self.at_start
        missing = wanted.difference(look)
        if missing:
            learned = self.learn(missing)
            look.update((c, v) for c, v in learned.items() if len(c) <= LONGEST)
            long = {c: v for c, v in learned.items() if len(c) > LONGEST}
            if long:
                look = look | long
        out = []
        for text, parted in zip(texts, lines, strict=True):
            if parted is None:
                out.append(self.whole(text or ""))
                continue
            values = []
            for start, *rest in parted:
                value = start_look.get(start)
                if value is None:
                    value = self.chunk(start, "")
                    if value is not None and len(start) <= LONGEST:
                        start_look[start] = value
                values.append(value)
                values += map(look.__getitem__, rest)
                values.append(self.line_end)
            values.pop()
            out.append(self.whole(text) if None in values else self.join(values))
        return out
