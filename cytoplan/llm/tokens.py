"""Token ids of texts by a given tokenizer file, with a bounded cache of words.

A tokenizer whose normaliser turns blanks into single spaces and whose pre-tokenizer drops them encodes each stretch between
blanks by itself; those stretches repeat and are cached. Any other tokenizer gets whole texts. The ids are the same either way.
"""

from __future__ import annotations

import json
import re
from array import array

from tokenizers import Tokenizer

#: Words that a worker keeps; beyond it the cache starts anew, so memory stays bounded and results do not change.
CACHE_WORDS = 800_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def drops_blanks(spec: dict) -> bool:
    """Whether stretches between blanks are encoded independently of each other."""
    steps = spec.get("normalizer") or {}
    steps = steps.get("normalizers", [steps])
    cut = spec.get("pre_tokenizer") or {}
    cut = (cut.get("pretokenizers") or [cut])[0]
    return (
        all(s.get("type") in ("NFC", "Lowercase") or (s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"}) for s in steps)
        and cut.get("type") == "Split"
        and (cut.get("behavior"), cut.get("invert")) == ("Removed", True)
        and cut.get("pattern", {}).get("Regex") == "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        and (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[1:] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        and any(s.get("type") == "Lowercase" for s in steps)
        and not spec.get("post_processor")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec.get("added_tokens", []))
    )


def byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: Lower-case Latin letters, then ASCII marks that begin no contraction or special token. The pre-tokenizer cuts between the two.
PLAIN = re.compile(r"([a-zß-öø-ɏ]+)([!-&(-/:;=-@\[-^`{-~]*)")


class _Words(dict):
    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.model = tokenizer.model
        self.letters = byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        if word.isascii() and word.islower() and word.isalpha():
            ids = self[word] = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
            return ids
        short = word.lower()
        plain = PLAIN.fullmatch(short)
        if not plain:
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes() if word else b""
        elif plain[2]:
            ids = self[plain[1]] + self.marks(plain[2])
        elif short != word:
            ids = self[short]
        else:  # neither the normaliser nor the pre-tokenizer changes it but for its bytes' letters
            shown = word.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        self[word] = ids
        return ids

    def marks(self, run: str) -> bytes:
        ids = self.get(run)
        if ids is None:
            ids = self[run] = array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()
        return ids


_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = drops_blanks(json.load(f))
        self.words = _Words(self.tokenizer)
        self.size = self.tokenizer.get_vocab_size()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.by_word:
            # Python alone counts four control characters as blanks.
            words = text.replace("\n", " ").split(" ") if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
            return b"".join(map(self.words.__getitem__, words))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; one for each file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
