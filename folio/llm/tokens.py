"""Token ids of whole texts by the tokenizers library, each distinct word encoded once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

#: Bytes of distinct words, with what is known of them, that a worker remembers; beyond that it starts anew.
REMEMBERED = 64 << 20
#: What an entry of such a memory takes besides its texts.
ENTRY = 160


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str) -> str:
    """A vocabulary file's text, read once on the driver and shipped with the task: a few MB."""
    with open(path, encoding="utf-8") as file:
        return file.read()


@lru_cache(maxsize=4)
def _tokenizer(definition: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


_INSIDE = re.compile(r"(?<=\S)(?= )")


def pieces(text: str) -> list[str]:
    """text cut before each space that follows something else than white space; joined, it is the text again.

    Both public vocabularies used here split words so that no token spans such a cut: white space
    is either a token's start or a token of its own, and a run of it stays in one piece.
    """
    if "  " in text or "\0" in text or text[:1] == " " or text[-1:] == " ":
        return [p for p in _INSIDE.split(text) if p]
    return text.replace(" ", "\0 ").split("\0") if text else []


# Characters that both splitting rules below treat as Python's re does: ASCII and the letters of Latin-1.
_PLAIN = re.compile(r"[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_L, _S = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"\x20\x09-\x0d"
_ENDS = "'s|'t|'re|'ve|'m|'ll|'d"


def _byte_marks() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: 256 + i for i, b in enumerate(hidden)}


_MARKS = _byte_marks()


def splitting(definition: str) -> tuple[re.Pattern, bool] | None:
    """For a vocabulary with a known splitting rule, that rule for plain text and whether it is lower-cased first."""
    made = json.loads(definition)
    before, norm = made["pre_tokenizer"] or {}, made["normalizer"] or {}
    if made["model"]["type"] != "BPE" or len(made["model"]["vocab"]) > 1 << 16 or made["model"].get("unk_token") or made["model"].get("byte_fallback") or made["model"].get("ignore_merges"):
        return None
    if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not norm:
        return re.compile(rf"{_ENDS}| ?[{_L}]+| ?[0-9]+| ?[^{_S}{_L}0-9]+|[{_S}]+(?![^{_S}])|[{_S}]+"), False
    steps = before.get("pretokenizers", [])
    lowered = [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    if lowered and len(steps) == 2 and steps[0].get("pattern") == {"Regex": _ENDS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"} and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"]:
        return re.compile(rf"{_ENDS}|[{_L}]+|[0-9]|[^{_S}{_L}0-9]+"), True
    return None


@lru_cache(maxsize=1)
def _id_bytes() -> list[bytes]:
    """The bytes of the first 2^16 ids."""
    return [i.to_bytes(4, "little") for i in range(1 << 16)]


class Encoder:
    """Texts to ids as bytes of little-endian unsigned 32-bit integers, through a bounded memory of words.

    A plain text is split by the vocabulary's own rule, and each distinct part goes to the library's
    model once. Another text is cut at spaces, and each distinct piece goes through the whole
    library. A text that holds the string of an added token (such as an end mark) goes through the
    library whole, which takes it for that token; with by_word off, every text does.
    """

    def __init__(self, definition: str, by_word: bool = True, remembered: int = REMEMBERED):
        self.definition, self.by_word, self.remembered = definition, by_word, remembered
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.held = {id(self.known): 0, id(self.parts): 0}
        self.added = [t["content"] for t in json.loads(definition)["added_tokens"]]
        self.rule = splitting(definition) if by_word else None

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in _tokenizer(self.definition).encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_parts(self, new: list[str]) -> None:
        tokenize, coded = _tokenizer(self.definition).model.tokenize, _id_bytes()
        for p in new:
            if not p.isascii():
                marked = p.encode().decode("latin-1").translate(_MARKS)
            else:
                marked = p if p.isalnum() else p.translate(_MARKS)
            self.parts[p] = b"".join([coded[t.id] for t in tokenize(marked)])

    def _learn_pieces(self, new: list[str]) -> None:
        for at in range(0, len(new), 4096):
            self.known.update(zip(new[at : at + 4096], self._encode(new[at : at + 4096]), strict=True))

    def _joined(self, found: list[str], memory: dict[str, bytes], learn: Callable[[list[str]], None]) -> bytes:
        new = set(found).difference(memory)
        if new:
            # an id is four bytes, and a byte of text gives one id at most
            more = sum(map(len, new)) * 5 + ENTRY * len(new)
            if self.held[id(memory)] + more > self.remembered:
                memory.clear()
                new = set(found)
                self.held[id(memory)], more = 0, sum(map(len, new)) * 5 + ENTRY * len(new)
            learn(list(new))
            self.held[id(memory)] += more
        out = b"".join(map(memory.__getitem__, found))
        if self.held[id(memory)] > self.remembered:  # one text with more new words than are remembered
            memory.clear()
            self.held[id(memory)] = 0
        return out

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        for text in texts:
            if not text:
                yield b""
            elif not self.by_word or any(x in text for x in self.added):
                yield self._encode([text])[0]
            elif self.rule and _PLAIN.fullmatch(text):
                rule, lower = self.rule
                yield self._joined(rule.findall(text.lower() if lower else text), self.parts, self._learn_parts)
            else:
                yield self._joined(pieces(text), self.known, self._learn_pieces)


@lru_cache(maxsize=4)
def encoder(definition: str, by_word: bool = True) -> Callable:
    return Encoder(definition, by_word)


def in_slices(batches: Iterator, encode: Callable, most: int = 16 << 20) -> Iterator[tuple]:
    """Stretches of the batches' rows with the ids of their texts (second column), about `most` bytes of ids each; a longer text is one by itself."""
    for batch in batches:
        first, held, size = 0, [], 0
        for i in range(batch.num_rows):
            held += encode([batch.column(1)[i].as_py()])
            size += len(held[-1])
            if size >= most or i + 1 == batch.num_rows:
                yield batch.slice(first, i + 1 - first), held
                first, held, size = i + 1, [], 0
