"""Whole texts to token ids with a public byte-level BPE tokenizer, in bounded memory.

The tokenizers library encodes everything; this module only avoids encoding the same
word over and over.  In this family of pre-tokenizers a token never runs from a
non-space character into white space, and a lone newline is a token of its own, so a
text without two adjacent white-space characters and without an added token may be cut before every space and on
both sides of every newline without changing its ids.  The pieces are looked up in a
per-worker memo of bounded size; unknown pieces are encoded by the library's model, if they
are letters, and otherwise in one library call per batch.  Other texts are encoded whole, or - when very long - in runs cut between a
non-space and a white-space character, which is also safe.

Where the pre-tokenizer drops white space altogether (``SpacelessEncoder``), every text may
be cut at every run of it, whatever it holds.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the id that ends each document.
END_ID = 0
END_BYTES = b"\0\0\0\0"

_LOADED: dict[str, "WordMemoEncoder"] = {}
#: Stands for "no space before"; texts that hold it, or other white space than spaces and newlines, go to the library whole.
_BARE = "\x01"
_OTHER_SPACE = re.compile("[\x01\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Letters that every Unicode version knows, and how byte-level models show a space and the bytes of other characters.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
_SPACE = "\u0120"
_SHOWN = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}
_CUT = re.compile(r"(?<=\S)(?=\s)")


def default_tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The public tokenizer file that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Tokens of their own after a letter and before white space.
_MARKS = ["\n", ",", "."]


class WordMemoEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``memo_entries`` bounds the remembered words (about 150 bytes each).  When it is half
    full a word is remembered only once a second batch holds it, as far as a table of hashes
    can tell, so that the many words that occur once take no more room; words that are not
    remembered are encoded again.
    """

    def __init__(self, path: str, memo_entries: int = 690_000, run_chars: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # letters in a row are one piece of a byte-level pre-tokenizer, and go to its model at once
        byte_level = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        self.model = self.tokenizer.model if byte_level else None
        # added tokens are found in whole texts, before words are: texts that hold one go to the library
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.seen = bytearray(1 << 21)
        self.memo_entries = memo_entries
        self.run_chars = run_chars
        self.marks = dict(zip(_MARKS, self._library(_MARKS), strict=True))
        self.memo["\n"] = self.marks["\n"]

    @staticmethod
    def stem(word: str) -> str:
        """The word without a comma or full stop that follows a letter at its end."""
        return word[:-1] if word[-1:] in (",", ".") and word[-2:-1].isalpha() else word

    def _plain(self, text: str) -> bool:
        """Whether spaces and newlines are the only white space, none touches another or an end, and no added token is there."""
        return not (
            "  " in text
            or "\n" in text
            and (" \n" in text or "\n " in text or "\n\n" in text)
            or text[0] in " \n"
            or text[-1] in " \n"
            or _OTHER_SPACE.search(text)
            or any(t in text for t in self.added)
        )

    def _library(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    def _runs(self, text: str) -> list[str]:
        """The text in runs of at least run_chars, cut where no token can lie across (added tokens hold no white space)."""
        runs, at = [], 0
        while len(text) - at > self.run_chars:
            cut = _CUT.search(text, at + self.run_chars)
            if cut is None:
                break
            runs.append(text[at : cut.start()])
            at = cut.start()
        runs.append(text[at:])
        return runs

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words without newlines, with the space before or, after _BARE, without; one call for many."""
        out: dict[str, bytes] = {}
        if self.model is not None:
            for w in words:
                core = w[1:] if w[:1] == _BARE else w
                if _LETTERS.fullmatch(core):
                    shown = core if core.isascii() else core.encode().decode("latin-1").translate(_SHOWN)
                    ids = [t.id for t in self.model.tokenize(shown if w[:1] == _BARE else _SPACE + shown)]
                    out[w] = struct.pack(f"<{len(ids)}I", *ids)
            words = [w for w in words if w not in out]
        newline = int(np.frombuffer(self.marks["\n"], "<u4")[0])
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            shown = [w[1:] if w[:1] == _BARE else " " + w for w in part]
            joined = ["\n".join(shown[k : k + 1000]) for k in range(0, len(part), 1000)]
            found: list[bytes] = []
            for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
                ids = np.asarray(x.ids, dtype="<u4")
                raw, ends = ids.tobytes(), np.flatnonzero(ids == newline) * 4
                starts = [0, *(ends + 4).tolist()]
                found += [raw[s:e] for s, e in zip(starts, [*ends.tolist(), len(raw)], strict=True)]
            out.update(zip(part, found, strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes, without the end id; null and empty give none."""
        out: list[bytes] = [b""] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if text and self._plain(text):
                plain.append(i)
            elif text:
                out[i] = b"".join(b"".join(self._library([r])) for r in self._runs(text))
        if not plain:
            return out
        # words, newlines, and commas and full stops between a letter and a space; _BARE stands before what no space precedes
        joined = pa.array([_BARE + texts[i] for i in plain], pa.large_string())
        spaced = pc.replace_substring(joined, "\n", f" \n {_BARE}")
        words = pc.split_pattern(pc.replace_substring_regex(spaced, r"([\pL\pN])([,.]) ", rf"\1 {_BARE}\2 "), " ")
        for i, raw in zip(plain, self._joined(words), strict=True):
            out[i] = raw
        return out

    def _joined(self, words: pa.ListArray) -> list[bytes]:
        """The ids of each list of words, one word after another."""
        coded = words.flatten().dictionary_encode()
        ids, lengths = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = coded.indices.to_numpy()
        # every word's ids in turn: repeat its place, counted up over its length
        each = lengths[codes]
        ends = np.cumsum(each)
        begins = np.cumsum(lengths) - lengths
        flat = ids[np.repeat(begins[codes] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[words.offsets.to_numpy()].tolist()
        return [flat[lo:hi].tobytes() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]

    def _known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the distinct words one after another, how many each has)."""
        memo = self.memo
        found = list(map(memo.get, words))
        open_ = [n for n, ids in enumerate(found) if ids is None]
        stems = [self.stem(words[n]) for n in open_]
        more = self._encode_words([s for s in dict.fromkeys(stems) if s not in memo])
        for n, stem in zip(open_, stems, strict=True):
            word, ids = words[n], more[stem] if stem in more else memo[stem]
            found[n] = ids + self.marks[word[-1]] if len(stem) < len(word) else ids
        seen, last = self.seen, len(self.seen) - 1
        if 2 * (len(memo) + len(more)) <= self.memo_entries:
            memo.update(more)
            more = {}
        for stem, ids in more.items():
            at = hash(stem) & last
            if not seen[at]:
                seen[at] = 1
            elif len(memo) < self.memo_entries:
                memo[stem] = ids
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4


#: White space that Unicode and every pattern language agree on.
_PLAIN_SPACE = r"[\t-\r]"
#: Letters and digits that stay so in lower case and join with no mark after them (the dotted capital I grows one).
_FIRM = r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]"
_FIRM_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-\u012f\u0131-\u024f]+")


class SpacelessEncoder(WordMemoEncoder):
    """For tokenizers that drop white space before they look for words: words are what stands between it.

    Tokens never reach across white space, normal forms and lower case don't either, and
    added tokens hold none, so words are encoded alone whatever else the text holds.
    A comma or full stop between a firm letter and white space is a word of its own.
    """

    #: Words above this are not remembered: texts without spaces.
    LONGEST = 64

    def __init__(self, path: str, memo_entries: int = 690_000):
        super().__init__(path, memo_entries)
        self.model = self.tokenizer.model
        self.memo = {"": b""}

    @staticmethod
    def stem(word: str) -> str:
        return word[:-1] if word[-1:] in (",", ".") and _FIRM_LETTERS.fullmatch(word[-2:-1]) else word

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for w in words:
            if _FIRM_LETTERS.fullmatch(w):
                low = w.lower()
                shown = low if low.isascii() else low.encode().decode("latin-1").translate(_SHOWN)
                ids = [t.id for t in self.model.tokenize(shown)]
                out[w] = struct.pack(f"<{len(ids)}I", *ids)
        words = [w for w in words if w not in out]
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            out.update(zip(part, self._library(part), strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        spaced = pc.replace_substring_regex(pa.array([t or "" for t in texts], pa.large_string()), _PLAIN_SPACE, " ")
        spaced = pc.replace_substring_regex(spaced, f"({_FIRM})([,.]) ", r"\1 \2 ")
        return self._joined(pc.split_pattern(spaced, " "))

    def _known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        long = [w for w in words if len(w) > self.LONGEST]
        held = dict(zip(long, self._library(long), strict=True)) if long else {}
        self.memo.update(held)
        try:
            return super()._known(words)
        finally:
            for w in held:
                self.memo.pop(w, None)


def drops_space(path: str) -> bool:
    """Whether the pre-tokenizer of a tokenizer file starts with a split that drops all white space."""
    with open(path, encoding="utf-8") as f:
        steps = json.load(f).get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    # fixed value: what such a pattern takes - letters, one digit, or signs, none of them white space
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def encoder(path: str) -> WordMemoEncoder:
    """One encoder per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = SpacelessEncoder(path) if drops_space(path) else WordMemoEncoder(path)
    return _LOADED[path]


def bounded_slices(column: pa.Array, size: int = 2_000_000):
    """Ranges (start, end) of consecutive texts of an Arrow column that together stay near so many bytes."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, end
        start = end
