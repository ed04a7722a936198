"""Token ids of texts, with a memory of words seen before.

A tokenizer of the ``tokenizers`` library cuts a text into pre-tokens and encodes each of them on its
own.  With the two kinds of pre-tokenization in ``_KINDS`` a space or a line feed between two other
characters always ends a pre-token, so a text can be encoded word by word, and words that came before need not be
encoded again.  Words are encoded many at a time: the ids of each are told apart by the mark of a space in
its first token, or by the places that tokens come from; words of ASCII letters by the mark at their end, as each is one
pre-token, and a comma or a full stop after one is another.  Texts with any other white space, with
control characters or with special tokens are handed to the tokenizer whole, and so is every text if
the tokenizer is of another kind.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Words that are kept; about 150 bytes each.
MEMORY = 600_000
#: White space and separators besides a single space or line feed: such texts are encoded whole.
_ODD = re.compile("[\\x00\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_WORDS_AT_ONCE = 512
#: Characters whose words are in memory at once, unless a single text has more.
_CHARS_AT_ONCE = 2 << 20
#: Normalizer and pre-tokenizer of the kinds of files whose texts can be encoded word by word.
_KINDS = {
    "spaced": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    "ended": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    ),
}
_loaded: dict[str, "WordEncoder"] = {}


def encoder(path: str) -> "WordEncoder":
    """One for each file and Python process, so that later tasks profit from earlier ones."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


class WordEncoder:
    """encode(texts) gives the ids of each text as the bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        own = json.loads(self.tokenizer.to_str())
        found = [k for k, v in _KINDS.items() if v == (own["normalizer"], own["pre_tokenizer"]) and own["model"]["type"] == "BPE" and not own["model"].get("dropout") and not own["model"].get("ignore_merges")]
        #: "spaced": a word's space is part of its first token; "ended": its last token ends with a mark; None: encode whole texts
        self.kind = found[0] if found else None
        self.ends_words = self.kind == "ended"
        #: words are remembered with the space before them where it is part of a token
        self.before = " " if self.ends_words else ""
        self.mark = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for t, i in vocab.items():
            self.mark[i] = t.endswith("</w>") if self.ends_words else t.startswith("Ġ")
        self.memory: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> None:
        """Words of ASCII letters; many of them are encoded as one text, each with a space before it.  Where tokens mark the
        space, any words."""
        for at in range(0, len(words), _WORDS_AT_ONCE):
            some = words[at : at + _WORDS_AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([self.before + self.before.join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = np.flatnonzero(self.mark[ids])
            if len(cut) != len(some):
                raise ValueError("a word doesn't have one mark")
            self._keep(some, ids, np.append(cut[1:], len(ids)) if not self.ends_words else cut + 1)

    def _placed(self, words: list[str]) -> None:
        """Words with a space put before each, told apart by the places that their tokens come from."""
        for at in range(0, len(words), _WORDS_AT_ONCE):
            some = words[at : at + _WORDS_AT_ONCE]
            found = self.tokenizer.encode_batch([" " + " ".join(some)], add_special_tokens=False)[0]
            until = np.array([b for _, b in found.offsets], np.int64)
            self._keep(some, np.array(found.ids, dtype="<u4"), np.searchsorted(until, np.cumsum([len(w) + 1 for w in some]), "right"))

    def _keep(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        data, ends = ids.tobytes(), (4 * ends).tolist()
        self.memory.update(zip(words, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def _learn(self, new: set[str]) -> None:
        letters, spaced, odd, joined = set(), [], [], []
        for w in new:
            own = w if self.ends_words else w[1:] if w[:1] == " " else ""
            plain = own.isascii()
            if plain and own.isalpha():
                letters.add(w)
            elif plain and own[-1:] in (".", ",") and own[:-1].isalpha():
                joined.append(w)
                if w[:-1] not in self.memory:
                    letters.add(w[:-1])
            elif own:
                spaced.append(w)
            else:
                odd.append(w)
        odd += [x for x in ".," if joined and x not in self.memory]
        self._letters(list(letters))
        self._placed(spaced) if self.ends_words else self._letters(spaced)
        self.memory.update(zip(odd, self._whole(odd), strict=True))
        for w in joined:
            self.memory[w] = self.memory[w[:-1]] + self.memory[w[-1]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Null counts as empty."""
        out, some, size = [], [], 0
        for t in texts:
            some.append(t)
            size += len(t or "")
            if size >= _CHARS_AT_ONCE:
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some)

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        parts: list[list[str] | None] = []
        out: list[bytes] = [b""] * len(texts)
        whole = []
        for k, t in enumerate(texts):
            t = t or ""
            if not self.kind:
                plain, words = False, []
            elif self.ends_words:
                plain = not _ODD.search(t)
                words = t.split() if plain else []
            else:
                plain = not ("  " in t or " \n" in t or "\n " in t or "\n\n" in t or t[-1:] in " \n" or t[:1] in (" ", "\n") or _ODD.search(t))
                words = t.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00") if plain and t else []
            if plain and not any(s in t for s in self.special):
                parts.append(words)
            else:
                parts.append(None)
                whole.append(k)
        if len(self.memory) > MEMORY:
            self.memory.clear()
        wanted: set[str] = set()
        for words in parts:
            if words:
                wanted.update(words)
        self._learn(wanted.difference(self.memory))
        get = self.memory.__getitem__
        for k, words in enumerate(parts):
            if words:
                out[k] = b"".join(map(get, words))
        for k, x in zip(whole, self._whole([texts[k] or "" for k in whole]), strict=True):
            out[k] = x
        return out
