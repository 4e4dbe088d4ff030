"""Token ids of whole texts, by the tokenizers library, by ranks of byte strings, or with a bounded memo of pre-tokens.

The merges of a BPE vocabulary never cross the pieces that its pre-tokenizer cuts. A text's ids are therefore the
ids of its pieces in order, and pieces repeat far more often than texts do. The memo is used for the two kinds of
tokenizer files whose cutting pattern is written out here, and for texts within the Latin blocks that hold none of the
file's added tokens; any other text, and any other kind of file, goes to the library whole. A byte-level file whose merges can
be read as ranks of byte strings (``ranked``) encodes such texts by these ranks and needs no memo. All ids equal those of
``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: The letters, digits and white space of U+0000 to U+024F.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
DIGITS = "0-9²³¹¼-¾"
SPACES = "\t-\r \x85\xa0"
#: U+0130 changes its length in lower case; a few letters leave the range in lower case.
BEYOND = re.compile("[^\u0000-įı-ɏ]")
#: Pieces of the two vocabularies, by the kind that their tokenizer file declares.
PIECES = {
    "bytes": re.compile(f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{DIGITS}]+| ?[^{SPACES}{LETTERS}{DIGITS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"),
    "words": re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{DIGITS}]|[^{SPACES}{LETTERS}{DIGITS}]+"),
}
#: The first of them for the library of ranks, which cuts alike within the Latin blocks.
RANKED_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a file of each kind declares.
DECLARED = {
    "bytes": {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
    "words": {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    },
}
#: Byte-level vocabularies write a visible Latin-1 byte as itself and the others as the signs from U+0100 on, in order.
VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SIGNS = {b: b if b in VISIBLE else 0x100 + sum(x not in VISIBLE for x in range(b)) for b in range(256)}


def kind_of(declared: dict) -> str | None:
    """The kind in ``PIECES`` of a tokenizer file, None for any other."""
    of = lambda part: json.dumps(declared.get(part), sort_keys=True)
    model = declared.get("model") or {}
    plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if not plain or any(t.get("normalized") for t in declared.get("added_tokens") or []):
        return None
    for kind, known in DECLARED.items():
        if all(of(part) == json.dumps(known[part], sort_keys=True) for part in known):
            return kind
    return None


def ranked(declared: dict, model) -> object | None:
    """An encoder that reads a byte-level file's merges as ranks of byte strings. Both ways merge the first of the pairs of least rank.
    They see the same pairs if ids stand in the order of merges, if single bytes and merges are all entries, and if ``model`` makes
    of every entry that entry alone: then no two tokens that stand side by side spell an entry without being its merge. None
    for any other file."""
    import tiktoken

    vocabulary, byte_of = declared["model"]["vocab"], {chr(sign): bytes([b]) for b, sign in BYTE_SIGNS.items()}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in declared["model"]["merges"]]
    ids = [vocabulary.get(m, -1) for m in merged]
    added = {t["content"] for t in declared.get("added_tokens") or []}
    entries = {**dict.fromkeys(byte_of), **dict.fromkeys(merged)}
    if any(a >= b for a, b in zip([-1, *ids], ids)) or len(entries) != 256 + len(merged) or entries.keys() != vocabulary.keys() - added:
        return None
    if any([t.id for t in model.tokenize(x)] != [vocabulary[x]] for x in entries):
        return None
    ranks = {b"".join(map(byte_of.__getitem__, x)): vocabulary[x] for x in entries}
    return tiktoken.Encoding("ranked", pat_str=RANKED_PIECES, mergeable_ranks=ranks, special_tokens={})


class Encoder(dict):
    """piece -> its ids as bytes. When half of ``limit`` bytes are held (each piece counts with ``OVERHEAD`` for its objects),
    what is held becomes the older half, from which pieces come back when they are seen again; the older half of before is
    forgotten. A piece that is not known goes to the library's merge model, in the signs that stand for its bytes."""

    OVERHEAD = 250

    def __init__(self, path: str, limit: int = 64 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the library's own threads would only wait for cores that tasks use
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.limit, self.held, self.older, self.model = limit // 2, 0, {}, self.library.model
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as file:
            declared = json.load(file)
        self.kind = kind_of(declared)
        self.lower = self.kind == "words"
        self.added = [t["content"] for t in declared.get("added_tokens") or []]
        self.pieces = PIECES[self.kind].findall if self.kind else None
        self.ranked = ranked(declared, self.model) if self.kind == "bytes" else None

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_SIGNS))
            ids = array(self.dtype.char, [t.id for t in found]).tobytes()
        size = self.OVERHEAD + 2 * len(piece) + len(ids)
        if self.held + size > self.limit:
            self.older = dict(self)
            self.clear()
            self.held = 0
        if size <= self.limit:
            self[piece] = ids
            self.held += size
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text; the array is read-only."""
        if self.pieces is None or BEYOND.search(text) or any(t in text for t in self.added):
            return np.frombuffer(self.whole(text), self.dtype)
        if self.ranked:
            try:
                return np.frombuffer(array(self.dtype.char, self.ranked.encode_ordinary(text)).tobytes(), self.dtype)
            except BaseException as limit:  # its patterns give up on some endless runs of white space by a panic; the memo doesn't
                if isinstance(limit, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        cased = text.lower() if self.lower else text
        if self.lower and BEYOND.search(cased):
            return np.frombuffer(self.whole(text), self.dtype)
        return np.frombuffer(b"".join(map(self.__getitem__, self.pieces(cased))), self.dtype)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
