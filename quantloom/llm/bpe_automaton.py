"""Operator 5: byte-pair encoding and decoding with a tokenization automaton."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import common
from quantloom.llm.tokens import ChunkCache, byte_letters

#: The pre-tokenizer's pattern of byte-level BPE files. A fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
START = -1
NEVER = 1 << 40


class MergeAutomaton:
    """Accepts exactly the token strings that the merges produce.

    A state is the last token read, an arc is labelled with the next token and leads to its state.
    The automaton begins with one state for each byte and all arcs. The gadget of the k-th merge,
    a + b -> c, adds the state c, whose arcs out are those of b and arcs in those of a, and takes away
    the arc from a to b; if that arc is gone already, c is never produced. What a gadget copies is
    described by the edges of its token: the tokens that ended it, and began it, before each merge
    (`ends`, `begins`). An arc survives unless some gadget took it from two such ancestors while both
    stood there, so its cell of the transition table is worked out from the two edges when it is
    first read, and kept. Of two overlapping pairs of one merge the left is merged first.
    """

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.labels = {i: b for b, i in vocabulary.items()}
        self.when: dict[tuple[int, int], int] = {}
        self.ends: dict[int, list[tuple[int, int]]] = {}
        self.begins: dict[int, list[tuple[int, int]]] = {}
        self.table: dict[tuple[int, int], bool] = {}
        for i in (vocabulary[bytes([b])] for b in range(256) if bytes([b]) in vocabulary):
            self.ends[i], self.begins[i] = [(i, NEVER)], [(i, NEVER)]
        for k, (left, right) in enumerate(merges):
            self._gadget(k, vocabulary[left], vocabulary[right], vocabulary[left + right])
        self.tokens = {self.labels[i]: i for i in self.ends}
        self.lengths: dict[bytes, list[int]] = {}
        for b in sorted(self.tokens, key=len, reverse=True):
            at = self.lengths.setdefault(b[:2], [])
            if len(b) not in at:
                at.append(len(b))

    def _gadget(self, k: int, a: int, b: int, c: int) -> None:
        if a not in self.ends or b not in self.ends or (a, b) in self.when:
            return
        if self._taken(self.ends[a], self.begins[b]) or c in self.ends:
            self.when[a, b] = k
            return
        self.when[a, b] = k
        self.ends[c] = [(c, NEVER), (b, k), *self.ends[b][1:]]
        self.begins[c] = [(c, NEVER), (a, k), *self.begins[a][1:]]

    def _taken(self, ends: list[tuple[int, int]], begins: list[tuple[int, int]]) -> bool:
        for x, until in ends:
            for y, before in begins:
                k = self.when.get((x, y), NEVER)
                if k < until and k <= before and k < NEVER:
                    return True
        return False

    def arc(self, state: int, token: int) -> bool:
        if state == START:
            return True
        found = self.table.get((state, token))
        if found is None:
            if len(self.table) > 4_000_000:
                self.table.clear()
            found = self.table[state, token] = not self._taken(self.ends[state], self.begins[token])
        return found

    def encode(self, word: bytes) -> list[int]:
        """The one path of arcs whose labels spell the word, read off the table.

        The longest token that an arc admits is nearly always right; where that walk ends before the
        word does, `_search` goes back.
        """
        tokens, lengths, table, n = self.tokens, self.lengths, self.table, len(word)
        path, at, state = [], 0, START
        while at < n:
            for size in lengths.get(word[at : at + 2], (1,)):
                t = tokens.get(word[at : at + size])
                if t is not None and at + size <= n:
                    open_ = table.get((state, t))
                    if open_ or open_ is None and self.arc(state, t):
                        break
            else:
                t, size = tokens.get(word[at : at + 1]), 1
                if t is None or not self.arc(state, t):
                    return self._search(word)
            if t is None:
                return self._search(word)
            path.append(t)
            at, state = at + size, t
        return path

    def _search(self, word: bytes) -> list[int]:
        """As encode(), going back from places that lead nowhere; each is tried once."""
        path: list[int] = []
        spots = [(0, START, iter(self._choices(word, 0)))]
        dead: set[tuple[int, int]] = set()
        while spots:
            at, state, choices = spots[-1]
            if at == len(word):
                return path
            for t, end in choices:
                if self.arc(state, t) and (end, t) not in dead:
                    path.append(t)
                    spots.append((end, t, iter(self._choices(word, end))))
                    break
            else:
                dead.add((at, state))
                spots.pop()
                if path:
                    path.pop()
        raise ValueError(f"no path for {word!r}: the vocabulary lacks a byte")

    def _choices(self, word: bytes, at: int) -> list[tuple[int, int]]:
        """Tokens that begin at a place of the word, the longest first, and where they end."""
        out, tokens = [], self.tokens
        for n in self.lengths.get(word[at : at + 2], ()):
            t = tokens.get(word[at : at + n])
            if t is not None and at + n <= len(word):
                out.append((t, at + n))
        one = tokens.get(word[at : at + 1])
        if one is not None and (one, at + 1) not in out:
            out.append((one, at + 1))
        return out


class AutomatonEncoder(ChunkCache):
    """Whole texts by the automaton: added tokens are cut out, the rest is split into words."""

    def __init__(self, path: str):
        super().__init__(path)
        import regex

        model, letters = self.told["model"], byte_letters()
        if not self.cuts or model.get("type", "BPE") != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} isn't plain byte-level BPE")
        spell = lambda token: bytes(letters[c] for c in token)
        specials = {x["content"]: x["id"] for x in self.told["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocabulary = {spell(t): i for t, i in model["vocab"].items() if t not in specials}
        self.automaton = MergeAutomaton(vocabulary, [(spell(a), spell(b)) for a, b in pairs])
        self.specials = specials
        self.labels = dict(self.automaton.labels) | {i: t.encode() for t, i in specials.items()}
        self.labels |= {i: b for b, i in vocabulary.items()}
        self.split = regex.compile(WORDS).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(specials, key=len, reverse=True)) + ")").split if specials else lambda t: [t]
        self.words: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            ids = []
            for part in self.cut(text):
                if part in self.specials:
                    ids.append(np.array([self.specials[part]], "<u4").tobytes())
                else:
                    ids += map(self._word, self.split(part))
            out.append(b"".join(ids))
        return out

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > 300_000:
                self.words.clear()
            found = np.array(self.automaton.encode(word.encode()), "<u4").tobytes()
            if len(word) < 40:
                self.words[word] = found
        return found

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The labels of the arcs, one after another."""
        return b"".join(map(self.labels.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def automaton_encoder(path: str) -> AutomatonEncoder:
    """One for each file and Python worker."""
    return AutomatonEncoder(path)


def encode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each row's whole text; a null text has no ids. No shuffle."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = automaton_encoder(tokenizer)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [np.frombuffer(x, "<u4").astype("i4") for x in encoder.encode(batch["text"].tolist())]})

    rows = docs.select(F.col(id_column).alias("doc_id"), common.empty_text(text_column).alias("text"))
    return rows.mapInPandas(run, rows.select("doc_id").schema.add("ids", "array<int>"))


def decode(ids: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of a frame that encode() returns. Bytes that aren't UTF-8 become U+FFFD."""
    common.small_batches(ids.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = automaton_encoder(tokenizer)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [encoder.decode(x) for x in batch["ids"]]})

    return ids.select("doc_id", "ids").mapInPandas(run, ids.select("doc_id").schema.add("text", "string"))


def encode_report(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, in one pass.

    Null texts count as empty; repeated rows give repeated rows; other columns are ignored.
    """
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = automaton_encoder(tokenizer)
        names = {i: str(i) for i in encoder.labels}
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            n, ids_digest, text_digest = [], [], []
            for x in encoder.encode(batch["text"].tolist()):
                ids = np.frombuffer(x, "<u4").tolist()
                n.append(len(ids))
                ids_digest.append(digest(",".join(map(names.__getitem__, ids)).encode()))
                text_digest.append(digest(encoder.decode(ids).encode()))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": n, "ids_sha256": ids_digest, "decoded_sha256": text_digest})

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), common.empty_text(text_column).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
