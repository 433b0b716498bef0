"""Token ids of whole documents, a distinct word at a time."""

from __future__ import annotations

import re

import numpy as np

from lumenlog.llm.common import encode_words, words_of

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CACHED_WORDS = 600_000
SPECIAL = re.compile(r"<\|(?:start|end)oftext\|>")

# Fixed values of the vocabulary: its pre-tokens, for texts of the printable characters below U+0100.
_LETTER, _DIGIT = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_LETTER}{_DIGIT}]+")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for the bytes of a character below U+0100: printable bytes for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in shown)
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of a BPE with word ends, equal to encoding each text as a whole.

    Its pre-tokenizer drops white space and no rule reaches across it, so each distinct word is encoded once and
    remembered. A word of plain characters is parted into its pre-tokens here, and only pre-tokens not yet known go
    to the vocabulary's model; other new words go through one call of the whole tokenizer, parted by a word that is a
    lone NUL. A text that has a special token written out goes through the whole tokenizer: by default that is the
    one id of the special token, as in a plain call; with `special=False` such text is ordinary text.
    """

    def __init__(self, path: str | None = None, special: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.tokenizer.encode_special_tokens = not special
        self.model = self.tokenizer.model
        self.special = special
        self.letters = _byte_letters()
        mark = self._ids("\x00")
        assert len(mark) == 1
        self.mark = mark[0]
        self._clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.values = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 14, np.int64)
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _forget(self) -> None:
        """Drop the older half of the words and all pre-tokens; frequent ones are soon back."""
        kept = list(self.index)[len(self.index) // 2 :]
        at = np.fromiter((self.index[w] for w in kept), np.int64, len(kept))
        starts, sizes = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        begins = np.cumsum(sizes) - sizes
        ids = self.values[np.repeat(starts - begins, sizes) + np.arange(int(sizes.sum()))]
        self._clear()
        self._append(kept, ids, sizes)

    def _append(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, used = len(self.index), int(self.bounds[len(self.index)])
        while used + len(ids) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while n + len(lengths) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.values[used : used + len(ids)] = ids
        self.bounds[n + 1 : n + 1 + len(lengths)] = used + np.cumsum(lengths)
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def _learn(self, words: list[bytes]) -> None:
        pieces, tokenize, letters, split = self.pieces, self.model.tokenize, self.letters, _PIECES.findall
        done, flat, lengths, other = [], [], [], []
        for w in words:
            text = w.decode("utf-8", "replace")
            if not text.isascii():
                text = text.lower()
            if not text.isprintable() or max(text) > "\xff":
                other.append(w)
                continue
            before = len(flat)
            for p in (text,) if text.isalpha() else split(text):
                got = pieces.get(p)
                if got is None:
                    got = pieces[p] = tuple([t.id for t in tokenize(p if p.isascii() else p.translate(letters))])
                flat += got
            done.append(w)
            lengths.append(len(flat) - before)
        self._append(done, np.array(flat, np.uint32), np.array(lengths, np.int64))
        whole = [w for w in other if b"\x00" not in w]
        for at in range(0, len(whole), 4096):
            part = whole[at : at + 4096]
            ids = np.array(self._ids(" \x00 ".join(w.decode("utf-8", "replace") for w in part) + " \x00"), np.uint32)
            ends = np.flatnonzero(ids == self.mark)
            assert len(ends) == len(part)
            self._append(part, ids[ids != self.mark], np.diff(ends, prepend=-1) - 1)
        for w in other:
            if b"\x00" in w:
                ids = np.array(self._ids(w.decode("utf-8", "replace")), np.uint32)
                self._append([w], ids, np.array([len(ids)]))

    def encode(self, texts: list[str | None], end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids of `texts`, each text followed by `end`, and the bounds of the texts in them. Null: empty."""
        marked = [i for i, t in enumerate(texts) if t and SPECIAL.search(t)] if self.special else []
        if marked:
            rest = list(texts)
            for i in marked:
                rest[i] = None
            ids, bounds = self._encode(rest, end)
            parts = np.split(ids, bounds[1:-1])
            for i in marked:
                parts[i] = np.concatenate([np.array(self._ids(texts[i]), np.uint32), parts[i]])
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return self._encode(texts, end)

    def _encode(self, texts: list[str | None], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = words_of(texts)
        words, codes = encode_words(flat)
        del flat
        words = words.to_pylist()
        if len(self.index) + len(words) > CACHED_WORDS:
            self._forget()
        get = self.index.get
        at = np.array([get(w, -1) for w in words], np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            self._learn([words[i] for i in missing])
            at[missing] = [get(words[i]) for i in missing]
        starts, sizes = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        lengths = sizes[codes]
        begins = np.cumsum(lengths) - lengths
        ids = self.values[np.repeat(starts[codes] - begins, lengths) + np.arange(int(lengths.sum()))]
        word_ends = np.concatenate([[0], np.cumsum(lengths)])
        text_ends = word_ends[np.cumsum(counts)]
        if end is not None:
            ids = np.insert(ids, text_ends, end)
            text_ends = text_ends + np.arange(1, len(texts) + 1)
        return ids.astype(np.uint32), np.concatenate([[0], text_ends])
