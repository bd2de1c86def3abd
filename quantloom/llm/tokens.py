"""Encoding of whole texts with public tokenizer files, for use inside tasks."""

from __future__ import annotations

import array
import functools
import json
import os
import re

import numpy as np

from quantloom.llm.shingles import slices

#: Chunks a worker gathers, and their characters, before the older half of its memory is dropped.
KEPT_CHUNKS, KEPT_CHARS = 450_000, 9_000_000
#: For workers that share an executor with much else: chunks gathered, and characters encoded at once. Costs CPU time.
LEAN_CHUNKS, LEAN_CHARS = 100_000, 1_000_000
#: A space amid white space: only there a cut before the space could change the pre-tokens.
UNSAFE = re.compile(r"\s \s")
#: Marks that are cut off a word's end.
TAIL = ".,;:!?"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 characters
    stand for themselves, the other bytes, in order, for the characters from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ChunkCache:
    """Ids of whole texts, from the ids of their chunks.

    The byte-level pre-tokenizer never joins characters across a cut made before a space, unless
    white space stands on both sides of that space. So a text is cut before each space and each
    distinct chunk is encoded once per worker; texts with such a space, or with an added token
    inside, are encoded whole. A subclass says how, in `_whole`. A lean one keeps fewer chunks and
    cuts up few texts at a time, but for a single long one; the ids are the same.
    """

    def __init__(self, path: str, lean: bool = False):
        self.lean = lean
        with open(path, encoding="utf-8") as f:
            self.told = told = json.load(f)
        pre = told.get("pre_tokenizer") or {}
        self.cuts = told.get("normalizer") is None and told.get("post_processor") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        self.added = [x["content"] for x in told.get("added_tokens", [])]
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.chars = 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit unsigned integers in the machine's order."""
        return [x for a, b in slices(texts, LEAN_CHARS) for x in self._encode(texts[a:b])] if self.lean else self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if not self.cuts or UNSAFE.search(t) or any(a in t for a in self.added) else t.split(" ") for t in texts]
        whole = [i for i, x in enumerate(cut) if x is None]
        out: list[bytes] = [b""] * len(texts)
        for i, x in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = x
        firsts = [i for i, x in enumerate(cut) if x is not None]
        for i, x in zip(firsts, self._whole([cut[i][0] for i in firsts]), strict=True):
            out[i] = x
        if len(self.kept) > (LEAN_CHUNKS if self.lean else KEPT_CHUNKS) or self.chars > KEPT_CHARS:
            self.older, self.kept, self.bare, self.chars = self.kept, {}, {}, 0
        known = [list(map(self.kept.get, cut[i][1:])) for i in firsts]
        gaps = [[k for k, x in enumerate(ids) if x is None] if None in ids else [] for ids in known]
        new = {cut[i][k + 1] for i, at in zip(firsts, gaps, strict=True) for k in at}
        if self.older:
            again = {x: self.older[x] for x in new if x in self.older}
            self.kept |= again
            new -= again.keys()
        self._learn(new)
        for i, ids, at in zip(firsts, known, gaps, strict=True):
            chunks = cut[i]
            for k in at:
                ids[k] = self.kept[chunks[k + 1]]
            out[i] += b"".join(ids)
        return out

    def _learn(self, chunks: set[str]) -> None:
        """Ids of chunks, each after a space.

        Marks of TAIL after a letter or digit are pre-tokens of their own, and so is a line break
        between visible characters: words without them are encoded once. Chunks with other white
        space are encoded whole.
        """
        kept, words, marked, broken, other = self.kept, set(), [], [], []
        for x in chunks:
            if x.isprintable() and x:
                core = x.rstrip(TAIL)
                if len(core) < len(x) and core[-1:].isalnum():
                    marked.append((x, core))
                    x = core
                if x not in kept:
                    words.add(x)
            elif all(y and y.isprintable() for y in x.split("\n")):
                broken.append(x)
            else:
                other.append(x)
        self._learn_words(kept, list(words), " ")
        tails = {x[len(core) :] for x, core in marked}
        self._learn_words(self.bare, [x for x in tails if x not in self.bare], "")
        for x, core in marked:
            kept[x] = kept[core] + self.bare[x[len(core) :]]
        if broken:
            (mark,) = self._whole(["\n"])
            parts = [x.split("\n") for x in broken]
            self._learn({x[0] for x in parts if x[0] not in kept})
            self._learn_words(self.bare, list({y for x in parts for y in x[1:] if y not in self.bare}), "")
            for x, (first, *more) in zip(broken, parts, strict=True):
                kept[x] = mark.join([kept[first], *(self.bare[y] for y in more)])
        kept.update(zip(other, self._whole([" " + x for x in other]), strict=True))
        self.chars += sum(map(len, chunks))

    def _learn_words(self, to: dict[str, bytes], words: list[str], before: str) -> None:
        to.update(zip(words, self._whole([before + x for x in words]), strict=True))


class ChunkEncoder(ChunkCache):
    """With the tokenizers library."""

    def __init__(self, path: str, lean: bool = False):
        super().__init__(path, lean)
        del self.told  # large, and the library has its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        (self.mark,) = self._whole(["\n"])
        self.model, self.letters = self.library.model, {b: c for c, b in byte_letters().items()}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, to: dict[str, bytes], words: list[str], before: str) -> None:
        """A word of Latin letters is one pre-token, so it goes to the library's model at once. Of the
        others, one text of many, with a line break between them, costs less than many texts: the
        break's id parts them."""
        tokenize, lead, letters = self.model.tokenize, before and self.letters[ord(before)], self.letters
        others = words
        if self.cuts:
            others = []
            for w in words:
                if w.isalpha() and (w.isascii() or max(w) < "\u0250"):
                    spelt = w if w.isascii() else w.encode().decode("latin-1").translate(letters)
                    to[w] = array.array("I", [t.id for t in tokenize(lead + spelt)]).tobytes()
                else:
                    others.append(w)
        for i in range(0, len(others), 5000):
            some = others[i : i + 5000]
            (ids,) = self._whole([before + f"\n{before}".join(some)])
            places = 4 * np.flatnonzero(np.frombuffer(ids, "=u4") == np.frombuffer(self.mark, "=u4")[0])
            to.update((x, ids[a:b]) for x, a, b in zip(some, [0, *(places + 4).tolist()], [*places.tolist(), len(ids)], strict=True))


@functools.lru_cache(maxsize=4)
def chunk_encoder(path: str, lean: bool = False) -> ChunkEncoder:
    """One encoder for each file and Python worker; workers outlive tasks."""
    return ChunkEncoder(path, lean)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
