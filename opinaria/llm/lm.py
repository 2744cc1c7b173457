"""Language-model scores by online logistic context mixing.

The model reads a text as its tokens (words with A-Z lowered, each closed by a space, and one end), and codes it by binary
decisions, whose probabilities multiply to that of the text; their logarithms give its bits per byte.

* Spelling. A token is spelled bit by bit. Hashed contexts of five lengths, bytes back from the bit within its token and
  before them the text's script class, each give a prediction from the zeros and ones seen in that context. (The class is a
  hash of the text's most common character beyond ASCII, which tells languages apart; it is sent ahead of the text at its
  cost.) A gated set of weights, picked by the bit's place in its byte, by how many contexts are known and by how sure the
  longest is, mixes the predictions in the logistic domain; an adaptive probability map refines the mix. Weights and map are
  learned online, bit by bit, each predicted as if its own occurrence hadn't been counted.
* Phrases. The hash of two words on end is a context across tokens. Where it falls on a 32nd of all values, it predicts
  the phrase that follows, up to the next such place or 64 tokens, as the one that followed most often in training. One bit
  says whether it does; an adaptive map over the counts gives the bit's probability. If it does, the phrase isn't spelled.
  A training text doesn't count itself here, so a text that occurs once is scored apart from one that occurs twice.

How it is spread out:
1. words: tasks count (token, class) in their documents; one shuffle of counts gives each token's training counts. phrases:
   likewise (context, phrase), then the context's best. Both have as many rows as the corpus calls for, and grow with it.
2. learn: tokens that were trained on are dealt into parts by hash, so a part's rows and their order depend on the corpus
   alone; each part counts, then predicts and learns. Counts add up in a tree of sixteen at a time; weights are averaged by
   what they have seen. The tables of contexts have 2^22 entries for each length, whatever the corpus, and are broadcast (20 MB).
3. price: each distinct (token, class) of the corpus is spelled once.
4. texts: tokens that make up at least a 2^-20th of the training tokens, of which there can be 2^20 at most, are broadcast
   with their prices (24 MB) and added up where the text is read. All others, and the phrases' contexts, meet what is known
   of them in one join, and are added up by text. No token in that join is frequent enough to be skewed; a context may be,
   and its rows stay on the side that Spark can split, as its phrase is one row.
Prices are whole numbers of 4096ths of a decimal digit, so sums are the same however rows are dealt.

Defined cases. Null or empty text: the end alone. Null keys: never held out. Repeated rows are scored alike, each gives a
row. Very long texts and tokens are read whole. Ties for a context's best phrase: the greater hash. No
training rows, or an empty table: every count 0, the untrained model. Extra columns are never read, so they may have any name."""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from opinaria.sources.scratch import cut, free

from .common import crc_split, numbers, slices

LENGTHS = (1, 2, 3, 5, 8)
SCRIPTS, LEVELS = 14, 13
HEAD_BITS, TABLE_BITS, CHUNK_BITS, PART_WORDS, FAN_IN = 20, 22, 14, 200_000, 16
DELTA, RATE, STEP = 0.1, 0.2, 1 << 14
BUCKETS, PRIOR = 33, 24.0
#: One phrase in so many tokens, its most tokens, and the levels that its counts are told apart by.
EVERY, LONGEST, COUNTS = 32, 64, 16
#: Of prices, and of the base's terms.
UNIT, BASE_UNIT = float(1 << 12), float(1 << 32)

_ASCII, _SHORT = bytes(range(128)), 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def script(raw: bytes) -> int:
    """0 for plain ASCII, otherwise a hash of the most common character beyond it (the least of equals)."""
    rest = raw.translate(None, _ASCII)
    if not rest:
        return 0
    n = Counter(rest.decode())
    most = max(n.values())
    return 1 + min(ord(c) for c, k in n.items() if k == most) % (SCRIPTS - 1)


def _mix64(x: np.ndarray) -> np.ndarray:
    for shift in (32, 29, 32):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def token_hashes(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token's bytes."""
    h = size.astype(np.uint64)
    at = np.flatnonzero(size <= _SHORT)
    for j in range(_SHORT):
        at = at[size[at] > j]
        if not len(at):
            break
        h[at] = (h[at] + flat[start[at] + j] + np.uint64(1)) * _ODD
    raw = None
    for i in np.flatnonzero(size > _SHORT).tolist():
        raw = flat.tobytes() if raw is None else raw
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + size[i]])
    return _mix64(h)


def keyed(h: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Hash of (token, class): even, as contexts of phrases are odd."""
    return _mix64(h + (kind.astype(np.uint64) + np.uint64(1)) * _ODD).view(np.int64) & ~np.int64(1)


@dataclass(frozen=True)
class Tokens:
    """The tokens of some texts on end."""
    flat: np.ndarray  # lowered bytes, each text closed by a line feed, which is its end
    start: np.ndarray
    size: np.ndarray
    text: np.ndarray  # number of the token's text
    first: np.ndarray  # each text's first token
    kind: np.ndarray  # each text's class
    h: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Tokens:
        raws = [t.encode().lower() for t in texts]
        flat = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
        ends = np.cumsum(np.array([len(r) + 1 for r in raws], np.int64)) - 1
        space = _SPACE[flat]
        edge = np.diff(space.astype(np.int8), prepend=np.int8(1))  # -1: a word starts, 1: it has ended
        word, over = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        starts = edge == -1
        starts[ends] = True
        start = np.flatnonzero(starts)
        size = np.ones(len(start), np.int64)
        size[~space[start]] = over - word
        text = np.searchsorted(ends, start)
        return cls(flat, start, size, text, np.searchsorted(text, np.arange(len(texts))), np.array([script(r) for r in raws], np.int64), token_hashes(flat, start, size))

    def keys(self) -> np.ndarray:
        return keyed(self.h, self.kind[self.text])

    def words(self, at: np.ndarray) -> pa.Array:
        """The bytes of some tokens."""
        size = self.size[at]
        offsets = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self.start[at] - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.flat[place])])

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each phrase's context and 47-bit hash, its first token, and each token's phrase (-1: before the text's first)."""
        n = len(self.h)
        number = np.arange(n)
        opens = np.zeros(n, bool)
        opens[self.first] = True
        context = np.zeros(n, np.uint64)
        context[2:] = _mix64(self.h[:-2] * np.uint64(3) + self.h[1:-1] * _ODD)
        begins = (context % np.uint64(EVERY) == 0) & (number - self.first[self.text] >= 2)
        head = np.maximum.accumulate(np.where(begins | opens, number, 0))
        begins |= (number > head) & ((number - head) % LONGEST == 0) & begins[head]
        bounds = np.flatnonzero(begins | opens)
        if not len(bounds):
            return context[:0].view(np.int64), context[:0].view(np.int64), number[:0], number
        group = np.cumsum(begins | opens) - 1
        weight = (_ODD ** np.arange(1, LONGEST + 1, dtype=np.uint64))[np.minimum(number - bounds[group], LONGEST - 1)]
        total = _mix64(np.add.reduceat(self.h * weight, bounds))
        is_phrase = begins[bounds]
        at = bounds[is_phrase]
        phrase = np.where(is_phrase, np.cumsum(is_phrase) - 1, -1)[group]
        return _mix64(context[at] + np.uint64(1)).view(np.int64) | np.int64(1), (total[is_phrase] >> np.uint64(17)).view(np.int64), at, phrase


@dataclass
class Mixer:
    """Weights by gate, and the adaptive map's counts."""
    weights: np.ndarray = field(default_factory=lambda: np.full((8 * LEVELS, len(LENGTHS)), 0.3))
    hits: np.ndarray = field(default_factory=lambda: np.zeros(256 * BUCKETS))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(256 * BUCKETS))


def lay_out(words: pa.Array, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens on end, each closed by a space but the end, each byte's place in its token and the token's
    class, and where tokens start."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    data, raw = np.frombuffer(words.buffers()[2], np.uint8), np.diff(offsets)
    sizes = raw + ~((raw == 1) & (data[np.minimum(offsets[:-1], len(data) - 1)] == 10))
    starts = np.cumsum(sizes) - sizes
    flat = np.full(int(sizes.sum()), 32, np.uint8)
    flat[np.repeat(starts - offsets[:-1], raw) + np.arange(offsets[0], offsets[-1])] = data[offsets[0] : offsets[-1]]
    return flat, np.arange(len(flat)) - np.repeat(starts, sizes), np.repeat(kinds.astype(np.uint32), sizes), starts


def contexts(flat: np.ndarray, place: np.ndarray, kind: np.ndarray) -> list[np.ndarray]:
    """A 32-bit hash for each context length and byte."""
    wide, h, out = flat.astype(np.uint32) + np.uint32(16), np.full(len(flat), 0x2545F491, np.uint32), []
    for lag in range(1, max(LENGTHS) + 1):
        back = np.zeros(len(flat), np.uint32)
        back[lag:] = wide[:-lag]
        h = h + np.where(place >= lag, back, np.where(place == lag - 1, kind + np.uint32(1), np.uint32(0)))
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if lag in LENGTHS:
            out.append(h.copy())
    return out


def nibble_slots(hashes: list[np.ndarray], salt: np.ndarray, bits: int) -> list[np.ndarray]:
    """First entry of each context's sixteen for the next four bits."""
    out = []
    for h in hashes:
        x = (h ^ salt) * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        out.append((x >> np.uint32(36 - bits)).astype(np.int64) << 4)
    return out


def bit_planes(flat: np.ndarray, hashes: list[np.ndarray], bits: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """For each of a byte's eight bits: its number, the contexts' entries, the part of the byte before it, the bit."""
    part = np.ones(len(flat), np.int64)
    for n in range(8):
        if n % 4 == 0:
            slots = nibble_slots(hashes, np.zeros(len(flat), np.uint32) if n == 0 else part.astype(np.uint32) * np.uint32(0x27D4EB2F), bits)
            node = np.ones(len(flat), np.int64)
        bit = (flat >> np.uint8(7 - n)) & np.uint8(1)
        yield n, [s | node for s in slots], part, bit
        node = node * 2 + bit
        part = part * 2 + bit


def mix(votes: list[np.ndarray], n: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gate of each bit and the mixed vote."""
    known = np.zeros(len(votes[0]), np.int64)
    for v in votes[:-1]:
        known += v != 0
    sure = np.abs(votes[-1])
    gate = np.where(sure > 0, 5 + np.minimum(sure, 7).astype(np.int64), known) * 8 + n
    total = np.zeros(len(votes[0]), np.float32)
    for i, v in enumerate(votes):
        total += weights[:, i].astype(np.float32).take(gate) * v
    return gate, np.clip(total, -14, 14)


def map_place(part: np.ndarray, vote: np.ndarray) -> np.ndarray:
    return part * BUCKETS + np.rint((vote + 8) * 2).clip(0, BUCKETS - 1).astype(np.int64)


def _steps(laid: tuple[np.ndarray, ...], bits: int):
    """The bit planes of `STEP` bytes at a time, with where they lie."""
    flat, place, kind, _ = laid
    for lo in range(0, len(flat), STEP):
        hi = min(len(flat), lo + STEP)
        back = max(0, lo - max(LENGTHS))
        hashes = [h[lo - back :] for h in contexts(flat[back:hi], place[back:hi], kind[back:hi])]
        for found in bit_planes(flat[lo:hi], hashes, bits):
            yield lo, hi, found


def learn(words: pa.Array, kinds: np.ndarray, counts: np.ndarray, bits: int = TABLE_BITS) -> tuple[np.ndarray, Mixer, np.ndarray]:
    """Counts, then predicts and corrects the weights, `STEP` bytes at a time; a bit is predicted from the counts without
    one occurrence of its own, as if it came anew. Returns the table of counts (context, entry, zeros and ones), the
    mixer, and how much each gate has seen. Later steps weigh more, as weights settle."""
    table, mixer = np.zeros((len(LENGTHS), 2 << bits), np.float32), Mixer()
    mass = np.zeros(len(mixer.weights))
    laid = lay_out(words, kinds)
    n_of = np.repeat(counts.astype(np.float32), np.diff([*laid[3], len(laid[0])]))
    pairs = [t.view(np.float64) for t in table]  # zeros and ones of an entry, fetched together
    for lo, hi, (_, entries, _, bit) in _steps(laid, bits):
        for i, e in enumerate(entries):
            np.add.at(table[i], 2 * e + bit, n_of[lo:hi])
    gates = len(mixer.weights)
    for lo, hi, (plane, entries, part, bit) in _steps(laid, bits):
        if plane == 0:
            worth, late = n_of[lo:hi].astype(np.float64) ** 0.75, hi / len(laid[0])
        own, votes = bit.astype(np.float32), []
        for i, e in enumerate(entries):
            seen = pairs[i].take(e).view(np.float32)
            votes.append(np.log((seen[1::2] - own + np.float32(DELTA)) / (seen[::2] + own + np.float32(DELTA - 1))))
        gate, vote = mix(votes, plane, mixer.weights)
        p = 1 / (1 + np.exp(-vote))
        miss = (bit - p) * worth
        weight = np.bincount(gate, worth, gates)
        for i, v in enumerate(votes):
            mixer.weights[:, i] += RATE * np.bincount(gate, miss * v, gates) / (weight + 1)
        mass += weight * late
        at = map_place(part, vote)
        mixer.seen += np.bincount(at, worth * late, len(mixer.seen))
        mixer.hits += np.bincount(at, worth * late * bit, len(mixer.hits))
    return table, mixer, mass


def to_votes(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Tenths of the logarithm of the odds."""
    return np.rint(np.log((ones + DELTA) / (zeros + DELTA)) * 10).clip(-127, 127).astype(np.int8)


@dataclass(frozen=True)
class Model:
    votes: np.ndarray  # (context, entry), tenths, int8
    mixer: Mixer
    bits: int = TABLE_BITS

    def log10(self, words: pa.Array, kinds: np.ndarray) -> np.ndarray:
        """log10 probability of each token."""
        laid = lay_out(words, kinds)
        cost = np.zeros(len(laid[0]))
        for lo, hi, (plane, entries, part, bit) in _steps(laid, self.bits):
            _, vote = mix([self.votes[i].take(e) * np.float32(0.1) for i, e in enumerate(entries)], plane, self.mixer.weights)
            p, at = 1 / (1 + np.exp(-vote)), map_place(part, vote)
            p = (p + (self.mixer.hits[at] + PRIOR * p) / (self.mixer.seen[at] + PRIOR)) / 2
            cost[lo:hi] += np.log10(np.where(bit, p, 1 - p).clip(1e-9, 1))
        return np.add.reduceat(cost, laid[3]) if len(words) else cost


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(a.tobytes() for a in arrays), 1)


def _pack_counts(counts: np.ndarray) -> tuple[int, bytes]:
    """How many counts aren't zero, and those: the steps between their places, then the counts, short if they are."""
    at = np.flatnonzero(counts)
    values = counts[at]
    short = not len(at) or values.max() < 1 << 16 and (values == np.floor(values)).all()
    return len(at), bytes([int(short)]) + _pack(np.diff(at, prepend=0).astype(np.uint16), values.astype(np.uint16 if short else np.float64))


def _add_counts(total: np.ndarray, n: int, part: bytes) -> None:
    raw = zlib.decompress(part[1:])
    total[np.cumsum(np.frombuffer(raw, np.uint16, n).astype(np.int64))] += np.frombuffer(raw[2 * n :], np.uint16 if part[0] else np.float64, n)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (w, at: array of (k, n)): the row, k and n of each element."""
    lists = batch.column("at")
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    inner = lists.flatten()
    return row, inner.field("k").to_numpy(zero_copy_only=False).astype(np.int64), inner.field("n").to_numpy(zero_copy_only=False)


_PARTS = "chunk int, at int, n int, part binary"


def _chunks() -> int:
    return (1 << TABLE_BITS) >> CHUNK_BITS


def _learn_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, w, at), a bucket's on end -> the bucket's tables in chunks, and its mixer."""
    chunk, chunks = 1 << CHUNK_BITS, _chunks()
    mixed = len(LENGTHS) * chunks  # number of the row that holds the mixer

    def done(bucket: int, held: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        row = lambda c, n, part: pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([bucket], pa.int32()), pa.array([n], pa.int32()), pa.array([part])], names=["chunk", "at", "n", "part"])
        table, mixer, mass = learn(pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
        for i in range(len(LENGTHS)):
            for c in range(chunks):
                part = table[i, 2 * c * chunk : 2 * (c + 1) * chunk]
                if part.any():
                    yield row(i * chunks + c, *_pack_counts(part))
        yield row(mixed, 0, _pack(mixer.weights * mass[:, None], mass, mixer.hits, mixer.seen))

    current, held = None, []
    for x in batches:
        buckets = x.column("bucket").to_numpy()
        row, k, n = _flat(x)
        keep = n > 0
        row, k, n = row[keep], k[keep], n[keep]
        of = buckets[row]
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if int(of[a]) != current:
                if held:
                    yield from done(current, held)
                current, held = int(of[a]), []
            held.append((x.column("w").take(pa.array(row[a:b])), k[a:b], n[a:b]))
    if held:
        yield from done(current, held)


def _added(pdf: pd.DataFrame) -> np.ndarray:
    """Sum of up to `FAN_IN` parts of a chunk, in the order of their numbers."""
    pdf = pdf.sort_values("at")
    if pdf.chunk.iat[0] == len(LENGTHS) * _chunks():
        return np.sum([np.frombuffer(zlib.decompress(p)) for p in pdf.part], axis=0)
    total = np.zeros(2 << CHUNK_BITS)
    for n, p in zip(pdf.n, pdf.part):
        _add_counts(total, n, p)
    return total


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total, number = _added(pdf), int(pdf.chunk.iat[0])
    n, part = (0, _pack(total)) if number == len(LENGTHS) * _chunks() else _pack_counts(total)
    return pd.DataFrame({"chunk": [number], "at": [int(pdf["at"].iat[0]) // FAN_IN], "n": [n], "part": [part]})


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    total, number = _added(pdf), int(pdf.chunk.iat[0])
    return pd.DataFrame({"chunk": [number], "part": [_pack(total if number == len(LENGTHS) * _chunks() else to_votes(total[::2], total[1::2]))]})


def train(words: DataFrame, n_words: int) -> Model:
    """words: (w, at: array of (k, n)), n_words rows."""
    buckets = max(1, -(-n_words // PART_WORDS))
    order = F.xxhash64("w")
    dealt = words.select(F.pmod(order, F.lit(buckets)).cast("int").alias("bucket"), "w", "at").repartition("bucket").sortWithinPartitions("bucket", order, "w")
    parts, width = dealt.select("bucket", "w", "at").mapInArrow(_learn_parts, _PARTS), buckets
    while width > FAN_IN:
        parts = parts.groupBy("chunk", F.expr(f"at div {FAN_IN}")).applyInPandas(_add, _PARTS)
        width = -(-width // FAN_IN)
    votes, mixer, chunks, chunk = np.zeros((len(LENGTHS), 1 << TABLE_BITS), np.int8), Mixer(), _chunks(), 1 << CHUNK_BITS
    # a fixed number of rows of 16 KB at most
    for r in parts.groupBy("chunk").applyInPandas(_finish, "chunk int, part binary").collect():
        raw = zlib.decompress(bytes(r.part))
        if r.chunk == len(LENGTHS) * chunks:
            all_of = np.frombuffer(raw)
            k, m = mixer.weights.size, len(mixer.weights)
            mass = all_of[k : k + m, None]
            mixer.weights = np.where(mass > 0, all_of[:k].reshape(m, -1) / np.maximum(mass, 1e-12), mixer.weights)
            mixer.hits, mixer.seen = all_of[k + m : k + m + mixer.hits.size], all_of[k + m + mixer.hits.size :]
        else:
            i, c = divmod(r.chunk, chunks)
            votes[i, c * chunk : (c + 1) * chunk] = np.frombuffer(raw, np.int8)
    return Model(votes, mixer)


def _out(names: list[str], columns: list, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def count_words(rows: DataFrame) -> DataFrame:
    """rows (h, t) -> (w, c, at): each token with its training count in all, and by class (0 where only held-out texts have
    it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []

        def merged() -> list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
            keys, first, at = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
            n = np.bincount(at, np.concatenate([x[1] for x in held]), len(keys)).astype(np.int64)
            return [(keys, n, np.concatenate([x[2] for x in held])[first], pa.concat_arrays([x[3] for x in held]).take(pa.array(first)))]

        for part, texts in slices(batches, "t"):
            found = Tokens.of(texts)
            trained = ~part.column("h").to_numpy(zero_copy_only=False)
            keys, first, at = np.unique(found.keys(), return_index=True, return_inverse=True)
            held.append((keys, np.bincount(at, trained[found.text], len(keys)), found.kind[found.text[first]].astype(np.int32), found.words(first)))
            if sum(len(x[0]) for x in held) > 1_500_000:
                held = merged()
                if len(held[0][0]) > 700_000:
                    yield from _out(["w", "k", "n"], [held[0][3], held[0][2], held[0][1]])
                    held = []
        if held:
            held = merged()
            yield from _out(["w", "k", "n"], [held[0][3], held[0][2], held[0][1]])

    found = rows.select("h", "t").mapInArrow(run, "w binary, k int, n long")
    # a token has a row at most for each class and task, so its rows are few: one shuffle serves both aggregates
    found = found.repartition("w").groupBy("w", "k").agg(F.sum("n").alias("n"))
    return found.groupBy("w").agg(F.sum("n").alias("c"), F.sort_array(F.collect_list(F.struct("k", "n"))).alias("at"))


def count_phrases(rows: DataFrame) -> DataFrame:
    """rows (h, t) -> (context, best, n_best, total): the phrase that followed most often in training, how often it and
    all did. Contexts that stand in one place of all texts are left out, as nothing can be predicted from them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "t"):
            found = Tokens.of(texts)
            context, phrase, at, _ = found.phrases()
            trained = ~part.column("h").to_numpy(zero_copy_only=False)[found.text[at]]
            pairs, where, m = np.unique(np.stack([context, phrase], 1), axis=0, return_inverse=True, return_counts=True) if len(at) else (np.zeros((0, 2), np.int64), at, at)
            yield from _out(["context", "phrase", "n", "m"], [np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]), np.bincount(where.ravel(), trained, len(pairs)).astype(np.int64), m])

    found = rows.select("h", "t").mapInArrow(run, "context long, phrase long, n long, m long")
    return best_phrases(found.groupBy("context", "phrase").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))


def best_phrases(pairs: DataFrame) -> DataFrame:
    """pairs (context, phrase, n in training, m everywhere) -> (context, best, n_best, total): most often in training first, then
    by larger hash. Count and hash make one number; where a count doesn't fit beside the hash, a decimal."""
    bits, most = 47, (1 << 16) - 1
    order = F.shiftleft(F.least("n", F.lit(most)), bits).bitwiseOR(F.col("phrase"))
    hash_of = lambda kind: F.lit(1 << bits).cast(kind)
    wide = F.when(F.col("n") >= most, F.col("n").cast("decimal(19,0)") * hash_of("decimal(16,0)") + F.col("phrase").cast("decimal(16,0)"))
    best = pairs.groupBy("context").agg(F.max(order).alias("best"), F.max(wide).alias("wide"), F.max("n").alias("n_best"), F.sum("n").alias("total"), F.sum("m").alias("everywhere"))
    phrase = F.when(F.col("wide").isNotNull(), F.pmod("wide", hash_of("decimal(16,0)")).cast("long")).otherwise(F.col("best").bitwiseAND(F.lit((1 << bits) - 1)))
    return best.where("everywhere > 1 and total > 0").select("context", phrase.alias("best"), "n_best", "total")


def _level(n_best: Column, others: Column) -> Column:
    return F.least(n_best, F.lit(COUNTS - 1)) * COUNTS + F.least(others, F.lit(COUNTS - 1))


def phrase_prices(phrases: DataFrame) -> tuple[list[int], list[int]]:
    """For each level, log10 of the chance that the predicted phrase follows, and that it doesn't, in units. Learned from
    the training texts, each occurrence predicted from all others."""
    hit = phrases.where("n_best > 1").select(_level(F.col("n_best") - 1, F.col("total") - F.col("n_best")).alias("level"), F.col("n_best").alias("yes"), F.lit(0).cast("long").alias("no"))
    miss = phrases.where("total > n_best").select(_level(F.col("n_best"), F.col("total") - F.col("n_best") - 1).alias("level"), F.lit(0).cast("long").alias("yes"), (F.col("total") - F.col("n_best")).alias("no"))
    seen = {r.level: (r.yes, r.no) for r in hit.unionByName(miss).groupBy("level").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()}
    yes, no = np.array([seen.get(i, (0, 0)) for i in range(COUNTS * COUNTS)], np.float64).T + 0.5
    return (np.rint(np.log10(yes / (yes + no)) * UNIT).astype(np.int64).tolist(), np.rint(np.log10(no / (yes + no)) * UNIT).astype(np.int64).tolist())


def price(words: DataFrame, model) -> DataFrame:
    """(key, c, n, s) of each (token, class): the token's training count, the pair's, and its log10 probability in units."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for x in batches:
            row, k, n = _flat(x)
            w = x.column("w")
            offsets = np.frombuffer(w.buffers()[1], np.int32)[w.offset : w.offset + len(w) + 1].astype(np.int64)
            h = token_hashes(np.frombuffer(w.buffers()[2], np.uint8), offsets[:-1], np.diff(offsets)) if len(w) else np.zeros(0, np.uint64)
            s = np.rint(m.log10(w.take(pa.array(row)), k) * UNIT).astype(np.int64)
            yield from _out(["key", "c", "n", "s"], [keyed(h[row], k), x.column("c").take(pa.array(row)), n, s])

    return words.select("w", "c", "at").mapInArrow(run, "key long, c long, n long, s long")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, held: int = 2) -> DataFrame:
    """A row for each row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), crc_split(key, modulus, held).alias("h"), F.col(text).cast("string").alias("t"))
    words = cut(count_words(rows), "lm-words")
    sums = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = sums.n or 0, sums.v
    phrases = cut(count_phrases(rows), "lm-phrases")
    follows, doesnt = phrase_prices(phrases)
    model = spark.sparkContext.broadcast(train(words.where("c > 0"), v))
    prices = cut(price(words, model), "lm-prices")
    free(words)
    # at most 2^20 rows can have so large a share each
    frequent = prices.where((F.col("n") > 0) & (F.col("n") * (1 << HEAD_BITS) >= n)).select("key", "c", "s").toArrow()
    keys, c, s = (x.to_numpy() for x in frequent.columns)
    order = np.argsort(keys)
    head = spark.sparkContext.broadcast((keys[order], np.rint(np.log10(c[order] + 1.0) * BASE_UNIT).astype(np.int64), s[order]))
    id_type = docs.schema[key].dataType
    main_type = pa.struct([("id", to_arrow_type(id_type)), ("h", pa.bool_()), ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.int64()), ("score", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_base, known_score = head.value
        for part, texts in slices(batches, "t"):
            rid, held_out = part.column("rid").to_numpy(), part.column("h")
            found = Tokens.of(texts)
            context, hashes, at, phrase = found.phrases()
            u, of = np.unique(found.keys(), return_inverse=True)
            place = np.minimum(np.searchsorted(known, u), max(0, len(known) - 1))
            yes = known[place] == u if len(known) else np.zeros(len(u), bool)
            base, spelled = (np.where(yes, x[place], 0)[of] if len(known) else np.zeros(len(of), np.int64) for x in (known_base, known_score))
            common = yes[of]
            # rare tokens, one row for each text, phrase and token
            rare = np.flatnonzero(~common)
            local = np.where(phrase < 0, -1, phrase - np.searchsorted(at, found.first)[found.text])
            order = rare[np.lexsort((of[rare], local[rare], found.text[rare]))]
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(of[order]) != 0) | (np.diff(local[order]) != 0) | (np.diff(found.text[order]) != 0)
            m = np.diff(np.append(np.flatnonzero(new), len(order)))
            order = order[new]
            of_phrase = np.zeros(len(at), np.int64)
            np.add.at(of_phrase, phrase[phrase >= 0], spelled[phrase >= 0])
            trained = ~held_out.to_numpy(zero_copy_only=False)
            total = lambda x: np.add.reduceat(x.astype(np.int64), found.first)
            main = pa.StructArray.from_arrays([part.column("id").cast(main_type.field("id").type), held_out, pa.array(np.diff(np.append(found.first, len(found.h)))), *(pa.array(total(x)) for x in (common, base, spelled)), pa.array(total(found.size + 1) - 1)], fields=list(main_type))
            a, b, c = len(order), len(at), len(texts)
            stack = lambda kind, *parts: pa.concat_arrays([x if isinstance(x, pa.Array) else pa.nulls(x, kind) if isinstance(x, int) else pa.array(x, kind) for x in parts])
            long, small = pa.int64(), pa.int32()
            yield from _out(["rid", "phrase", "key", "m", "hash", "spelled", "main"], [
                stack(long, rid[found.text[order]], rid[found.text[at]], rid), stack(small, local[order].astype(np.int32), local[at].astype(np.int32), np.full(c, -1, np.int32)),
                # a text's own row has a key of its own, so that it isn't skewed in the join
                stack(long, u[of[order]], context, rid),
                stack(small, m.astype(np.int32), trained[found.text[at]].astype(np.int32), c), stack(long, a, hashes, c), stack(long, a, of_phrase, c), stack(main_type, a, b, main)])

    # numbered where they are read; a task that runs again reads the same rows in the same order
    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "id", "h", "t")
    parts = numbered.mapInArrow(run, f"rid long, phrase int, key long, m int, hash long, spelled long, main struct<id: {id_type.simpleString()}, h: boolean, tokens: long, known: long, base: long, score: long, bytes: long>")
    none = F.lit(None).cast("long")
    # of a token: c and s; of a context: all that followed, how often the best did, and the best
    facts = prices.select("key", "c", "s", none.alias("best")).unionByName(phrases.select(F.col("context").alias("key"), F.col("total").alias("c"), F.col("n_best").alias("s"), "best"))
    both = parts.join(facts, "key", "left")
    is_main, is_phrase = F.col("main").isNotNull(), F.col("hash").isNotNull()
    hit = F.coalesce(F.col("hash") == F.col("best"), F.lit(False))
    # a training text's own occurrence doesn't count
    n_best = F.col("s") - F.when(hit, F.col("m")).otherwise(0)
    level = (_level(n_best, F.col("c") - F.col("m") - n_best) + 1).cast("int")
    narrow = both.where(~is_phrase | F.coalesce(n_best > 0, F.lit(False))).select(
        "rid", "phrase", "main", F.when(~is_main & ~is_phrase, F.col("m")).alias("m"), F.when(~is_main & ~is_phrase, F.col("c")).alias("c"),
        F.when(is_phrase, F.col("spelled")).when(~is_main, F.col("m") * F.col("s")).alias("inside"),
        F.when(is_phrase, F.when(hit, F.element_at(numbers(follows), level)).otherwise(F.element_at(numbers(doesnt), level))).alias("flag"), F.when(is_phrase & hit, True).alias("hit"))
    # a text's rows add up by phrase, then by text, after one shuffle
    rare = F.col("m").isNotNull()
    by_phrase = narrow.repartition("rid").select("rid", "phrase", "m", "c", "inside", "flag", "hit", "main.*").groupBy("rid", "phrase").agg(
        F.max("id").alias("id"), F.max("h").alias("h"), F.max("tokens").alias("tokens"), F.max("bytes").alias("bytes"), F.coalesce(F.sum("score"), F.lit(0)).alias("score"),
        F.sum(F.coalesce("known", F.when(F.col("c") > 0, F.col("m")), F.lit(0))).alias("known"),
        F.sum(F.coalesce("base", F.col("m") * F.round(F.log10(F.col("c") + 1.0) * BASE_UNIT).cast("long"), F.lit(0))).alias("base"),
        F.sum(F.coalesce("inside", F.lit(0))).alias("inside"), F.sum(F.when(rare, F.col("inside")).otherwise(0)).alias("tail"), F.sum(F.coalesce("flag", F.lit(0))).alias("flag"), F.max("hit").alias("hit"))
    per_text = by_phrase.groupBy("rid").agg(
        F.max("id").alias("id"), F.max("h").alias("h"), F.max("tokens").alias("tokens"), F.max("bytes").alias("bytes"), F.sum("known").alias("known"), F.sum("base").alias("base"),
        F.sum(F.col("score") + F.col("tail") + F.col("flag") - F.when(F.col("hit"), F.col("inside")).otherwise(0)).alias("score"))
    unit = float(np.log10(n + v + 1.0))
    scored = F.col("score") / UNIT - float(np.log10(SCRIPTS))
    return per_text.select(
        F.col("id").alias(key), F.col("h").alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / BASE_UNIT - F.col("tokens") * F.lit(unit)).alias("base_score"), scored.alias("score"), (-scored * float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte"))


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
