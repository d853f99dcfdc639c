"""Encoding whole texts with a tokenizer file, chunk by chunk.

Added strings of the tokenizer (`<|endoftext|>` and the like) are parted from a text first and give their own
ids, as the library does. What stands between them is cut where no token can cross: at ASCII white space if the
tokenizer drops white space, else before a lone space or line end between two non-space characters. A mark
after a letter and before white space is a chunk of its own, so a word is encoded once for all marks after it. A
chunk's ids do not depend on its neighbours, and chunks recur, so most are looked up.

The rest are encoded by the library, many to a call. Words of letters alone, most of what is new, are one piece
for the tokenizer's pattern, so they go straight to its model: through the same file without normaliser and
pattern, their bytes spelled in the model's alphabet. Whether a file allows that is tried when it is opened.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np

_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r"[^\S \n]")
# the bytes that other white space is made of: one of them must be there before the pattern is asked
_SPACE_BYTES = b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_SPACE_RUNS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
# a mark after a letter and before white space or the end, in UTF-8 and in text
_MARK_BYTES = re.compile(rb"[.,;:!?](?![^\x20\x09-\x0d])(?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")
_MARK_TEXT = re.compile(r"[.,;:!?](?![^ \n])(?<=[A-Za-zÀ-ÖØ-öø-ÿ].)")
GROUP_BYTES = 1 << 19  # text whose unknown chunks are encoded together
KNOWN = 500_000  # chunks of a generation; two generations are kept
MARK = b"\x01"
FIRST = "\x00"
_APART, _LINE_APART = f" {FIRST}\\g<0>", f" {FIRST}\n {FIRST}"
ENDS = frozenset([*".,;:!?", *(bytes([b]) for b in b".,;:!?")])
RUN = 256  # chunks encoded in one call
PLAIN = "ɐ"  # letters before this have one lower-case form and compose with nothing, but for the next
DOTTED = "İ"


def _alphabet() -> dict[int, str]:
    """The characters that byte-level models write bytes in: printable ones stand for themselves, the others
    follow 255 in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: chr(b if b in own else next(other)) for b in range(256)}


_ALPHABET = _alphabet()
_SPACE, _LINE = _ALPHABET[32], _ALPHABET[10]


def _spelled(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_ALPHABET)


class Encoder:
    """path: a tokenizers JSON file; drops_space: whether it ignores white space and case; dtype: of the ids' bytes."""

    def __init__(self, path: str, drops_space: bool, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # added strings are parted from texts before it sees them
        self.drops_space, self.dtype = drops_space, np.dtype(dtype)
        if self.tokenizer.get_vocab_size() - 1 > np.iinfo(self.dtype).max:
            raise ValueError(f"{dtype} is too narrow for {path}")
        self.known: dict = {}
        self.older: dict = {}
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        if sys.byteorder != "little":
            raise RuntimeError("ids are written in this machine's byte order, which must be little-endian")
        self.added = {}
        for i, t in self.tokenizer.get_added_tokens_decoder().items():
            if t.lstrip or t.rstrip or t.single_word or t.normalized or not t.special:
                raise ValueError(f"{path}: the added string {t.content!r} takes more than its own characters")
            self.added[t.content.encode()] = np.array([i], self.dtype).tobytes()
        longest = sorted(self.added, key=len, reverse=True)
        self.parted = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")") if longest else None
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        if drops_space:
            (self.mark,) = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        else:
            (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.spaced = np.array([n.startswith(_SPACE) for n in names])
        self.ending = np.array([n.endswith("</w>") for n in names])
        self.quick = self._without_pattern(path)

    def _without_pattern(self, path: str):
        """The file's model alone, if it gives words of letters the ids that the whole tokenizer gives them."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        quick = Tokenizer.from_file(path)
        quick.encode_special_tokens = True
        quick.normalizer, quick.pre_tokenizer = None, WhitespaceSplit()
        words = ["a", "the", "word", "letters", "été", "größe", "niño", "xqzjvk", "œuvre", "łódź"]
        words = words if self.drops_space else [*words, "Ab", "ÉTÉ", "İx"]
        lead = "" if self.drops_space else _SPACE
        for w in words:
            want = self.tokenizer.encode(w if self.drops_space else " " + w, add_special_tokens=False).ids
            if quick.encode(lead + _spelled(w), add_special_tokens=False).ids != want or not want:
                return None
            if self.drops_space and self.ending[want].tolist() != [False] * (len(want) - 1) + [True]:
                return None
        return quick

    def chunks(self, text: bytes) -> list:
        """The keys of a text's chunks. Where white space counts, a key stands for itself with a space before
        it, and one that starts with FIRST for what follows."""
        if self.drops_space:
            return _MARK_BYTES.sub(rb" \g<0>", text.lower()).split()  # A-Z only; the tokenizer lowers the rest
        s = text.decode("utf-8", "replace")
        if not s:
            return []
        if FIRST in s:
            return [FIRST + s]
        other = len(text.translate(None, _SPACE_BYTES)) < len(text) or any(x in text for x in _SPACE_RUNS) and _OTHER_SPACE.search(s)
        if other or "  " in s or " \n" in s or "\n " in s or "\n\n" in s or s[0] in " \n" or s[-1] in " \n":
            keys = _LONE_SPACE.split(s)
            keys[0] = FIRST + keys[0]
            return keys
        return (FIRST + _MARK_TEXT.sub(_APART, s).replace("\n", _LINE_APART)).split(" ")

    def _letters(self, key) -> str | None:
        """A key's word as the model spells it, if it is letters alone; a key that starts with FIRST may not be."""
        if not self.drops_space:
            return _spelled(key) if key.isalpha() and (key.isascii() or max(key) < PLAIN) else None
        if key.isalpha():
            return key.decode()
        word = key.decode("utf-8", "replace")
        return _spelled(word.lower()) if word.isalpha() and max(word) < PLAIN and DOTTED not in word else None

    def _split(self, key) -> tuple | None:
        """Two keys whose ids make up this key's, if tokens surely part there."""
        if self.drops_space:
            stem = key[:-1]
            return (stem, key[-1:]) if stem[-1:].isalpha() or (stem and self._letters(stem)) else None
        if len(key) > 2 and key[-1] in ".,;:!?" and key[-2].isalpha():
            return key[:-1], FIRST + key[-1]
        return None

    def _learn(self, unknown: set) -> None:
        """Add keys to those known: from the generation before, from their two parts, or encoded."""
        known, older, joined, new, plain, bare, todo = self.known, self.older, [], set(), {}, {}, unknown
        quick = self.quick is not None
        while todo:
            parts = []
            for key in todo:
                if (had := older.get(key)) is not None:
                    known[key] = had
                elif quick and (spelled := self._letters(key)):
                    plain[key] = spelled
                elif quick and key[:1] == FIRST and (spelled := self._letters(key[1:])):
                    bare[key] = spelled
                elif key[-1:] in ENDS and (both := self._split(key)) is not None:
                    joined.append((key, *both))
                    parts += both
                else:
                    new.add(key)
            todo = set(filterfalse(known.__contains__, parts)).difference(new, plain, bare)
        self._encode_plain(list(plain), list(plain.values()))
        self._encode_bare(list(bare), list(bare.values()))
        self._encode_new(list(new))
        for key, one, other in reversed(joined):  # parts were found after what they make up
            known[key] = known[one] + known[other]

    def _runs(self, keys: list, texts: list[str], between: str, lead: str = "") -> Iterator[tuple[list, np.ndarray]]:
        joint = [lead + between.join(texts[i : i + RUN]) for i in range(0, len(texts), RUN)]
        for i, e in enumerate(self.quick.encode_batch_fast(joint, add_special_tokens=False)):
            yield keys[i * RUN : (i + 1) * RUN], np.array(e.ids, self.dtype)

    def _encode_plain(self, keys: list, words: list[str]) -> None:
        """Words of letters: the id that ends or starts each says where they part."""
        if self.drops_space:
            for run, ids in self._runs(keys, words, " "):
                stops = np.flatnonzero(self.ending[ids]) + 1
                self._keep(run, ids, np.r_[0, stops[:-1]], stops)
        else:
            for run, ids in self._runs(keys, words, " " + _SPACE, _SPACE):
                starts = np.flatnonzero(self.spaced[ids])
                self._keep(run, ids, starts, np.r_[starts[1:], len(ids)])

    def _encode_bare(self, keys: list, words: list[str]) -> None:
        """Words of letters without a space before them, a line end between each two."""
        for run, ids in self._runs(keys, words, f" {_LINE} "):
            cuts = np.flatnonzero(ids == self.line)
            self._keep(run, ids, np.r_[0, cuts + 1], np.r_[cuts, len(ids)])

    def _encode_new(self, new: list) -> None:
        """Many chunks share a call, and their ids are parted again: at a mark of one id where white space is
        dropped; else at the space that starts a chunk, or at a line end put between chunks that have none.
        Chunks that hold what parts them go alone."""
        if self.drops_space:
            alone = [c for c in new if MARK in c]
            self._encode_alone(alone, [c.decode("utf-8", "replace") for c in alone])
            joint = [c for c in new if MARK not in c] if alone else new
            between = b" " + MARK + b" "
            runs = [joint[i : i + RUN] for i in range(0, len(joint), RUN)]
            for run, e in zip(runs, self._ids([between.join(r).decode("utf-8", "replace") for r in runs]), strict=True):
                ids = np.array(e.ids, self.dtype)
                cuts = np.flatnonzero(ids == self.mark)
                self._keep(run, ids, np.r_[0, cuts + 1], np.r_[cuts, len(ids)])
            return
        spaced = [k for k in new if k[0] != FIRST]
        bare = [k for k in new if k[0] == FIRST]
        runs = [spaced[i : i + RUN] for i in range(0, len(spaced), RUN)]
        texts = [" " + " ".join(r) for r in runs]
        for run, text, e in zip(runs, texts, self._ids(texts), strict=True):
            ids = np.array(e.ids, self.dtype)
            cuts = np.flatnonzero(self.spaced[ids])
            if len(cuts) == len(run) and not _OTHER_SPACE.search(text) and "\n" not in text and "  " not in text:
                self._keep(run, ids, cuts, np.r_[cuts[1:], len(ids)])
            else:
                self._encode_alone(run, [" " + k for k in run])
        odd = [k for k in bare if len(k) < 2 or " " in k or "\n" in k or _OTHER_SPACE.search(k)]
        self._encode_alone(odd, [k[1:] for k in odd])
        joint = sorted(set(bare).difference(odd)) if odd else bare
        runs = [joint[i : i + RUN] for i in range(0, len(joint), RUN)]
        for run, e in zip(runs, self._ids(["\n".join([k[1:] for k in r]) for r in runs]), strict=True):
            ids = np.array(e.ids, self.dtype)
            cuts = np.flatnonzero(ids == self.line)
            if len(cuts) + 1 == len(run):
                self._keep(run, ids, np.r_[0, cuts + 1], np.r_[cuts, len(ids)])
            else:
                self._encode_alone(run, [k[1:] for k in run])

    def _ids(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _encode_alone(self, keys: list, texts: list[str]) -> None:
        for key, e in zip(keys, self._ids(texts), strict=True):
            self.known[key] = array(self.code, e.ids).tobytes()

    def _keep(self, keys: list, ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        data, w = ids.tobytes(), self.dtype.itemsize
        for key, start, stop in zip(keys, (w * starts).tolist(), (w * stops).tolist(), strict=True):
            self.known[key] = data[start:stop]

    def _parts(self, text: bytes) -> list:
        """The chunk lists of a text's stretches, and the ids of the added strings between them."""
        if self.parted is None or b"<" not in text or not self.parted.search(text):
            return [self.chunks(text)]
        return [self.added[p] if i % 2 else self.chunks(p) for i, p in enumerate(self.parted.split(text))]

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """The ids of each text, one after the other in little-endian bytes; a null text has none."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size < GROUP_BYTES):
                text = texts[at] or b""
                group.append(self._parts(text))
                size, at = size + len(text), at + 1
            yield from self._group(group)

    def _group(self, group: list[list]) -> Iterator[bytes]:
        """Every chunk is looked up once; those not found are learned together and put in."""
        look = self.known.get
        found = [p if isinstance(p, bytes) else list(map(look, p)) for parts in group for p in parts]
        flat = [p for parts in group for p in parts]
        unknown = {c for keys, ids in zip(flat, found, strict=True) if keys is not ids and None in ids for c, i in zip(keys, ids, strict=True) if i is None}
        if unknown:
            if len(self.known) + len(unknown) > KNOWN:
                self.older, self.known = self.known, {}
            self._learn(unknown)
            known = self.known
            for keys, ids in zip(flat, found, strict=True):
                if keys is not ids and None in ids:
                    for k, i in enumerate(ids):
                        if i is None:
                            ids[k] = known[keys[k]]
        made = iter([p if isinstance(p, bytes) else b"".join(p) for p in found])
        for parts in group:
            yield next(made) if len(parts) == 1 else b"".join([next(made) for _ in parts])


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, drops_space: bool, dtype: str) -> Encoder:
    """One encoder a worker and tokenizer: a worker serves many partitions."""
    key = (path, drops_space, dtype)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
