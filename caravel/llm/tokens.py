"""Token ids of whole texts. No token of word_bpe_49k crosses white space, so each distinct word is encoded once and remembered.

Most words are plain: ASCII, or letters of Latin-1 and Latin Extended-A. Their pieces (letters, single digits, the rest) go through a second
encoder with the same merges, in which a closing byte stands for the end of a piece; all others go through the tokenizer itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .textops import segments, spread, word_hashes, words

#: Words that a worker remembers, unless its encoder's limit says otherwise.
REMEMBERED = 1_500_000
#: Ends a piece; no plain word holds it.
CLOSE = b"\x01"
#: The tokenizer's own pieces of lower-case text, for plain words, which a line feed separates here.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|\n|[^a-z0-9ß-öø-ſ\n]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_of() -> dict[str, int]:
    """The bytes behind the characters of a byte-level vocabulary: printable ones stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _plain_encoder(path: str):
    """The encoder of closed pieces, and the id of a closed line feed; None if the vocabulary's ids are not in the order of its merges."""
    import tiktoken

    with open(path) as f:
        model = json.load(f)["model"]
    ids, suffix, byte_of = model["vocab"], model.get("end_of_word_suffix"), _byte_of()
    merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if not suffix or any(a >= b for a, b in zip(merged, merged[1:])) or (merged and merged[0] < 512):
        return None
    ranks = {}
    for token, i in ids.items():
        closed = token.endswith(suffix)
        text = token.removesuffix(suffix) if closed else token
        if all(c in byte_of for c in text):
            raw = bytes(byte_of[c] for c in text)
            if CLOSE not in raw or (raw == CLOSE and not closed):
                ranks[raw + CLOSE if closed else raw] = i
    return tiktoken.Encoding("plain", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={}), ranks[b"\n" + CLOSE]


def _odd(data: np.ndarray) -> np.ndarray:
    """How many bytes before each place are no part of a plain word."""
    before = np.append(np.uint8(0), data[:-1])
    lead = (data >= 0xC3) & (data <= 0xC5)
    follows = (data >= 0x80) & (data < 0xC0) & (before >= 0xC3) & (before <= 0xC5)
    follows &= ~((before == 0xC3) & ((data == 0x97) | (data == 0xB7))) & ~((before == 0xC4) & (data == 0xB0))
    bad = ~(((data > 0x20) & (data < 0x7F)) | lead | follows)
    bad |= (data == 0x7C) & (before == 0x3C)  # may begin a special token
    return np.append(0, np.cumsum(bad))


class Words:
    """The ids of the words met so far, by the words' hashes."""

    def __init__(self, path: str):
        self.path, self.own, self.plain, self.limit = path, None, _plain_encoder(path), REMEMBERED
        self.clear()

    @property
    def tokenizer(self):
        """Loaded for the first word that is not plain."""
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path)
        return self.own

    def clear(self) -> None:
        self.keys, self.at, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encoded_plain(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        encoder, feed = self.plain
        length = ends - starts + 1
        text = np.append(data, np.uint8(10))[spread(starts, length)]
        text[np.cumsum(length) - 1] = 10
        pieces = PIECES.findall(text.tobytes().decode().lower())
        ids = np.array(encoder.encode_ordinary("\x01".join(pieces) + "\x01"), np.uint32)
        feeds = np.flatnonzero(ids == feed)
        return ids[ids != feed], np.diff(np.append(-1, feeds)) - 1

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, end to end, and how many each has."""
        odd = _odd(data)
        plain = (odd[ends] == odd[starts]) if self.plain else np.zeros(len(starts), bool)
        flat, size = [np.zeros(0, np.uint32)], np.zeros(len(starts), np.int64)
        order = [np.flatnonzero(plain), np.flatnonzero(~plain)]
        if len(order[0]):
            ids, size[order[0]] = self._encoded_plain(data, starts[order[0]], ends[order[0]])
            flat.append(ids)
        raw = data.tobytes() if len(order[1]) else b""
        for lo in range(0, len(order[1]), 20_000):
            part = order[1][lo : lo + 20_000]
            found = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)], add_special_tokens=False)
            own = [e.ids for e in found]
            size[part] = [len(x) for x in own]
            flat.append(np.array([i for x in own for i in x], np.uint32))
        at = np.zeros(len(starts), np.int64)
        both = np.concatenate(order)
        at[both] = np.cumsum(size[both]) - size[both]
        return np.concatenate(flat)[spread(at, size)], size

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, ids of each word, hashes of the distinct words in order, which of them each word is) of the words of a chunk."""
        if len(self.keys) > self.limit:
            self.clear()
        distinct, index, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        i = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        new[i < len(self.keys)] = self.keys[i[i < len(self.keys)]] != distinct[i < len(self.keys)]
        if new.any():
            ids, size = self._encoded(data, starts[index[new]], ends[index[new]])
            at = len(self.flat) + np.cumsum(size) - size
            self.at, self.size = np.insert(self.at, i[new], at), np.insert(self.size, i[new], size)
            self.keys, self.flat = np.insert(self.keys, i[new], distinct[new]), np.append(self.flat, ids)
            i = np.searchsorted(self.keys, distinct)
        size = self.size[i][inverse]
        return self.flat[spread(self.at[i][inverse], size)], size, distinct, inverse


_known: dict[str, Words] = {}


def encoder(path: str) -> Words:
    """This process's memory of words."""
    if path not in _known:
        _known[path] = Words(path)
    return _known[path]


def encode(texts, path: str):
    """(first row, row after the last, ids end to end, their bounds) of a text column, without special tokens of its own; null: none."""
    held = []
    for a, b, data, bounds, last in segments(texts):
        starts, ends, first = words(data, bounds)
        ids, size, _, _ = encoder(path).encode(data, starts, ends)
        if held or not last:  # a long document in parts
            held.append(ids)
            if last:
                ids, held = np.concatenate(held), []
                yield a, b, ids, np.array([0, len(ids)])
        else:
            yield a, b, ids, np.append(0, np.cumsum(size))[first]
