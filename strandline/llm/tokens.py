"""Token ids of whole texts by public vocabularies, with a bounded memo of chunks.

A text is cut only where no token can cross: at a single blank or line end between other characters, and before a
comma or full stop between a letter or digit and a blank. Each distinct chunk is encoded by the tokenizers library once
while it stays in the memo, and the ids of a text are gathered from those of its chunks. Where a blank goes into the word after it,
many words are encoded as one string and told apart by the tokens that begin with a blank. Texts with runs of white space
are encoded whole. Cutting, telling chunks apart and finding those that are held is Arrow's work; Python sees new chunks only.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of any library, runs of it, and stops that do not stand alone after a word.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
RUNS = rf"{SPACE}[ \n]|[ \n]{SPACE}"
#: Characters of a chunk that outlives a cleaning of the memo.
LONG = 64
#: Words that are encoded as one string, and what such a word is: a blank and no other white space.
AT_ONCE = 500
WORD = rf"^ [^{SPACE[1:-1]}]+$"
#: Chunks whose ids are gathered at once.
GATHERED = 100_000
STOPS = r"[^\p{L}\p{N}][.,]|^[.,]"


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """``encode(texts)`` gives one uint32 array per text, equal to the library's ids of the whole text.

    ``joined``: the vocabulary takes a blank into the word after it (byte-level); otherwise white space is dropped.
    At most ``limit`` chunks and ``most_chars`` characters are held; beyond that those seen only once since the last cleaning go, and
    all that are longer than ``LONG`` (texts with runs of white space are one chunk each).
    """

    def __init__(self, path: str, joined: bool, limit: int = 1_000_000, most_chars: int = 16_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.joined, self.limit, self.most_chars = joined, limit, most_chars
        vocabulary = self.library.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # the byte-level sign of a blank
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.reset(pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def reset(self, memo: pa.Array, flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        self.memo, self.flat, self.first, self.size = memo, flat, first, size
        self.used = np.zeros(len(size), np.int64)
        self.chars = pc.sum(pc.utf8_length(memo), min_count=0).as_py()

    def chunks(self, texts: pa.Array) -> pa.Array:
        """A list of chunks for each text."""
        whole = pc.match_substring_regex(texts, RUNS)
        plain = pc.match_substring_regex(texts, STOPS)
        cut = texts if self.joined else pc.ascii_lower(texts)
        for stop in (", ", ". ", ",\n", ".\n"):
            cut = pc.if_else(plain, cut, pc.replace_substring(cut, stop, f"\x00{stop}"))
        cut = pc.replace_substring(cut, " ", "\x00 " if self.joined else "\x00")
        cut = pc.replace_substring(cut, "\n", "\x00\n\x00" if self.joined else "\x00")
        return pc.split_pattern(pc.if_else(whole, texts, cut), "\x00")

    def forget(self) -> None:
        """Keep the chunks that were used more than once."""
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > self.limit // 2:
            keep = keep[self.used[keep] > np.median(self.used[keep])]
        keep = keep[pc.utf8_length(self.memo).to_numpy()[keep] <= LONG]
        size = self.size[keep]
        ends = np.cumsum(size)
        self.reset(self.memo.take(pa.array(keep)), self.gather(keep), ends - size, size)

    def gather(self, slots: np.ndarray) -> np.ndarray:
        """Ids of the chunks in these places, one after the other."""
        out = [np.zeros(0, np.uint32)]
        for i in range(0, len(slots), GATHERED):
            part = slots[i : i + GATHERED]
            size = self.size[part]
            ends = np.cumsum(size)
            out.append(self.flat[np.repeat(self.first[part] - (ends - size), size) + np.arange(int(ends[-1]))])
        return np.concatenate(out)

    def strings(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each encoded for itself, and how many each has."""
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words, each of which has its only blank in front, from a few long strings."""
        flat, _ = self.strings(["".join(words[i : i + AT_ONCE]) for i in range(0, len(words), AT_ONCE)])
        size = np.diff(np.append(np.flatnonzero(self.begins[flat]), len(flat)))
        if len(size) != len(words):
            raise ValueError("the vocabulary is not byte-level")
        return flat, size

    def learn(self, memo: pa.Array) -> None:
        """Hold ``memo``, which begins with all that is held, and encode the rest of it."""
        new = memo[len(self.memo) :]
        word = pc.match_substring_regex(new, WORD).to_numpy(zero_copy_only=False) & self.joined
        places = np.flatnonzero(word), np.flatnonzero(~word)
        flat, size = (np.concatenate(x) for x in zip(self.words(new.take(pa.array(places[0])).to_pylist()), self.strings(new.take(pa.array(places[1])).to_pylist())))
        back = np.argsort(np.concatenate(places))
        self.first = np.concatenate([self.first, (len(self.flat) + np.cumsum(size) - size)[back]])
        self.size = np.concatenate([self.size, size[back]])
        self.flat = np.concatenate([self.flat, flat])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.memo = memo
        self.chars += pc.sum(pc.utf8_length(new)).as_py()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        marked = [i for i, t in enumerate(texts) if "\x00" in t]  # these hold the mark that chunks are cut at
        lists = self.chunks(pa.array(["" if "\x00" in t else t for t in texts] if marked else texts, pa.large_string()))
        if len(self.memo) > self.limit or self.chars > self.most_chars:
            self.forget()
        held = len(self.memo)
        codes = pa.concat_arrays([self.memo, lists.values]).dictionary_encode()  # what is held keeps its places
        if len(codes.dictionary) > held:
            self.learn(codes.dictionary)
        slots = codes.indices.to_numpy()[held:]
        self.used += np.bincount(slots, minlength=len(self.used))
        ends = np.concatenate([[0], np.cumsum(self.size[slots])])[lists.offsets.to_numpy()]
        out = np.split(self.gather(slots), ends[1:-1])
        for i in marked:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


_held: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, joined: bool) -> ChunkEncoder:
    """The worker's own encoder; it stays for the worker's later tasks."""
    if (path, joined) not in _held:
        _held[path, joined] = ChunkEncoder(path, joined)
    return _held[path, joined]
