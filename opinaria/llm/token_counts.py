"""Token counts by rank-synchronous array merging.

The file is a byte-level BPE model in the JSON form of the tokenizers library. A text is cut at the strings of the file's added
tokens, each of which counts as one token, as the library does unless told otherwise; what lies between is cut into pre-tokens.

1. pre-tokens: each distinct one of a task gets a number when it is first seen; a text is an array of numbers.
2. merging: the new pre-tokens of a slice of texts stand end to end in one array of symbols, a ragged one, as each knows its
   sequence. In a step, every sequence's pair of lowest rank is merged wherever it stands in it, all sequences at once;
   sequences without a pair that merges leave the array, and their length then is their count. There are as many steps as
   the sequence with most distinct merges needs. A long pre-token is first cut where two bytes meet that no token of the
   vocabulary has side by side, since no merge can cross that place.
3. counts: a text's tokens are the sum of its pre-tokens' counts.

All of a pair's places in a sequence may merge at once because a pair ranks behind those that its parts were merged from; if a
file doesn't keep that order, a step merges the leftmost place only. The letters and digits are those of the Unicode version
that Python's own tables have, as the library's are; `regex` knows later ones.

Defined cases. Null or empty text: 0 bytes, 0 tokens. Very long texts and pre-tokens are counted whole. Ties: of overlapping
equal pairs, as in aaa, the left one merges. Repeated rows, and rows with a null id, give a row each. Empty table: no rows.
Columns are read by name, so others may have any name. Settings of a file that change the count and that aren't covered here
(normalizers, other pre-tokenizers, dropout, byte fallback, added tokens that take space) raise an error."""
from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import slices

#: Fixed value: the library's splitting pattern for byte-level models, with places for its letters and digits.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
#: Characters of the texts held at a time; pre-tokens that a task remembers; symbols merged at a time; symbols of a
#: pre-token from which on it is cut first.
SLICE, REMEMBERED, SYMBOLS, LONG = 1 << 21, 1 << 20, 1 << 20, 64
NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary: itself if it can be seen, else one from 256 on."""
    seen = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in seen)
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


def later_letters() -> str:
    """The letters and digits of `regex` that Python's own tables don't have, as the inside of a character class."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = []
    for run in regex.findall(r"[\p{L}\p{N}]+", every):
        for c in run:
            if unicodedata.category(c) == "Cn":
                out.append(ord(c))
    runs: list[list[int]] = []
    for c in out:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in runs)


class Merger:
    """Counts the symbols that are left of byte sequences."""

    def __init__(self, model: dict):
        letters, vocabulary = byte_letters(), model["vocab"]
        self.single = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.single[b] = vocabulary[c]
        self.shift = max(vocabulary.values(), default=1).bit_length()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = {int(i): -1 for i in self.single}
        self.ordered, keys, new = True, [], []
        for rank, (a, b) in enumerate(merges):
            a, b, c = vocabulary[a], vocabulary[b], vocabulary[a + b]
            keys.append(a << self.shift | b)
            new.append(c)
            self.ordered = self.ordered and a in made and b in made and made.setdefault(c, rank) == rank
        self.keys, order = np.unique(np.array(keys, np.int64), return_index=True)
        self.ranks, self.made = order.astype(np.int64), np.array(new, np.int64)  # a pair that stands twice counts by its first rank
        self.joined = np.zeros((256, 256), bool)
        for token in vocabulary:
            raw = np.array([letters[c] for c in token if c in letters], np.uint8)
            self.joined[raw[:-1], raw[1:]] = True

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), NONE)
        key = a << self.shift | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece."""
        out, start, held = np.zeros(len(pieces), np.int64), 0, 0
        for i, p in enumerate(pieces):
            if held and held + len(p) > SYMBOLS:
                out[start:i] = self._count(pieces[start:i])
                start, held = i, 0
            held += len(p)
        out[start:] = self._count(pieces[start:])
        return out

    def _count(self, pieces: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        # sequences: pieces, long ones cut where no token crosses
        starts = np.zeros(len(raw), bool)
        starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        if (sizes > LONG).any():
            inner = (sizes[piece] > LONG)[1:] & ~self.joined[raw[:-1], raw[1:]]
            starts[1:] |= inner
        sequence = np.cumsum(starts) - 1
        of = piece[starts]
        left = self.merge(self.single[raw], sequence, len(of))
        return np.bincount(of, left, len(pieces)).astype(np.int64)

    def merge(self, symbols: np.ndarray, sequence: np.ndarray, n: int) -> np.ndarray:
        """Symbols left of each of n sequences, which stand end to end."""
        left = np.zeros(n, np.int64)
        pair = self._pairs(symbols, sequence)
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], sequence[1:] != sequence[:-1])))
            lengths = np.diff(np.append(first, len(symbols)))
            lowest = np.minimum.reduceat(pair, first)
            done = lowest == NONE
            if done.any():
                left[sequence[first[done]]] = lengths[done]
                keep = np.repeat(~done, lengths)
                symbols, sequence, pair, lengths, lowest = symbols[keep], sequence[keep], pair[keep], lengths[~done], lowest[~done]
                if not len(symbols):
                    break
            at = np.flatnonzero(pair == np.repeat(lowest, lengths))
            if len(at) > 1:
                near = sequence[at[1:]] == sequence[at[:-1]] if not self.ordered else at[1:] == at[:-1] + 1
                if near.any():
                    # of each run of overlapping places every second one from the left, or the first of the sequence
                    number, follows = np.arange(len(at)), np.concatenate(([False], near))
                    since = number - np.maximum.accumulate(np.where(follows, 0, number))
                    at = at[since % 2 == 0 if self.ordered else since == 0]
            symbols[at] = self.made[pair[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # where the merged places lie once the others are gone
            symbols, sequence, pair = symbols[keep], sequence[keep], pair[keep]
            touched = np.concatenate((moved, moved[moved > 0] - 1))
            pair[touched] = self._at(symbols, sequence, touched)
        return left

    def _pairs(self, symbols: np.ndarray, sequence: np.ndarray) -> np.ndarray:
        return self._at(symbols, sequence, np.arange(len(symbols)))

    def _at(self, symbols: np.ndarray, sequence: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each place."""
        out = np.full(len(places), NONE)
        inner = np.flatnonzero(places < len(symbols) - 1)
        inner = inner[sequence[places[inner]] == sequence[places[inner] + 1]]
        out[inner] = self.rank(symbols[places[inner]], symbols[places[inner] + 1])
        return out


class Tokenizer:
    """Counts the tokens of texts. `later`: letters and digits that don't count as such, as later_letters() gives them."""

    def __init__(self, path: str, later: str):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "ignore_merges"))
        if file.get("normalizer") or not plain or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space"):
            raise ValueError(f"{path} isn't a plain byte-level BPE model")
        added = file.get("added_tokens") or []
        if any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that take what stands beside them")
        names = sorted((a["content"] for a in added if a["content"]), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, names))).split if names else None
        self.names = names
        self.split = regex.compile(SPLIT.replace("[^\\s{L}{N}]", r"[^\s\p{L}\p{N}]").replace("{L}", r"\p{L}").replace("{N}", r"\p{N}")).findall
        self.is_later = regex.compile(f"[{later}]").search if later else lambda text: None
        self.split_later = regex.compile("(?V1)" + SPLIT.replace("[^\\s{L}{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{later}]]").replace("{L}", rf"[\p{{L}}--[{later}]]").replace("{N}", rf"[\p{{N}}--[{later}]]")).findall if later else self.split
        self.merger = Merger(model)
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = _Numbers()
        self.counts, self.wrong = np.zeros(0, np.int64), np.zeros(0, bool)

    def count(self, texts: list[str]) -> list[int]:
        if len(self.counts) > REMEMBERED:
            self._forget()
        number, found, special = self.numbers.__getitem__, [], []
        for text in texts:
            parts = self.cut(text) if self.cut and any(n in text for n in self.names) else [text]
            special.append(len(parts) - 1)
            found.append([np.fromiter(map(number, self.split(part)), np.int32) for part in parts])
        self._merge_new()
        # a pre-token with a later letter was cut by the wrong tables; those of its text are cut again
        if self.wrong.any():
            for text, own in zip(texts, found):
                if any(self.wrong[x].any() for x in own):
                    own[:] = [np.fromiter(map(number, self.split_later(part)), np.int32) for part in (self.cut(text) if self.cut else [text])]
            self._merge_new()
        return [sum(int(self.counts[x].sum()) for x in own) + s for own, s in zip(found, special)]

    def _merge_new(self) -> None:
        """Counts the pre-tokens that have got a number since."""
        new = list(islice(self.numbers, len(self.counts), None))
        if new:
            self.counts = np.concatenate((self.counts, self.merger.count([p.encode() for p in new])))
            self.wrong = np.concatenate((self.wrong, np.fromiter((not p.isascii() and self.is_later(p) is not None for p in new), bool, len(new))))


class _Numbers(dict):
    """Pre-tokens by the order in which they are first looked up."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row of docs. `path` is a file on every machine."""
    kept = T.StructField(key, docs.schema[key].dataType)
    out = T.StructType([kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    later = later_letters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        for part, texts in slices(batches, "text_", SLICE):
            tokenizer = tokenizer or Tokenizer(path, later)
            n = pa.array(tokenizer.count(texts), pa.int64())
            size = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), size, n, pc.greater(n, limit)], names=out.names)

    return docs.select(F.col(key).alias("key_"), F.col(text).cast("string").alias("text_")).mapInArrow(run, out)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.json"))
