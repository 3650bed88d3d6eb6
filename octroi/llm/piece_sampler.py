"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text's pieces are drawn from all its segmentations: the forward pass sums, for each position, the weight
of every way to reach it over the piece lattice; the backward pass draws each last piece from those sums.
The random numbers are a hash of the row's key, the word's place and the step, so a row gets the same pieces
wherever and however often it is worked on. A piece's weight follows its rank in the model
(Zipf's law), to the power `alpha`: 0 draws among segmentations alike, larger values prefer the likely ones.

No piece of the model goes on after white space that it has begun with, so the lattice falls apart at word
beginnings and the forward pass runs once for each distinct word of a step, over all words at once in
numpy; every occurrence of a word is drawn anew.

Decoding gives back the text, byte for byte: white space isn't normalised, characters without a
piece become byte pieces, and so does a `▁` of the text itself.

Cases: null and empty texts have no pieces and decode to ''. A null doc_id is a key of its own. Rows that
repeat doc_id and text get the same pieces. Words of any length are one lattice. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octroi.llm.common import mix, ranges, small_batches, steps

ALPHA, SEED = 0.5, 1
#: Log weight of a character that has to be written as bytes.
BYTES_WEIGHT = -30.0
#: Stands for a `▁` of the text; no text holds a lone surrogate.
LITERAL = "\ud800"
#: Characters with a direct transition in the trie; others are looked up by bisection.
DIRECT = 256


class Pieces:
    """The model's pieces as a trie in arrays, and their bytes."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int64)
        nodes: dict[tuple[int, str], int] = {}
        piece = [-1]
        spelled = [b""] * n
        rank = 0
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_id[int(name[1:-1], 16)] = i
                spelled[i] = bytes([int(name[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if "▁" in name.lstrip("▁") or "\n" in name:
                    raise ValueError(f"a piece goes on after white space: {name!r}")
                spelled[i] = name.replace("▁", " ").encode()
                at = 0
                for c in name:
                    at = nodes.setdefault((at, c), len(piece))
                    if at == len(piece):
                        piece.append(-1)
                piece[at] = i
        self.piece = np.array(piece, np.int32)
        order = np.argsort([-model.get_score(int(i)) if i >= 0 else np.inf for i in self.piece], kind="stable")
        rank = np.zeros(len(piece))
        rank[order] = np.arange(len(piece))
        self.weight = np.where(self.piece >= 0, -alpha * np.log(rank + 2.7), -np.inf)
        self.longest = max((len(x) for x in names), default=1)
        self.near = np.full((len(piece), DIRECT), -1, np.int32)
        codes = lambda c: 0x20 if c == "▁" else ord(c)  # noqa: E731  the white-space mark is read as the blank that it stands for
        far = []
        for (at, c), to in nodes.items():
            if codes(c) < DIRECT:
                self.near[at, codes(c)] = to
            else:
                far.append(((at << 21) | ord(c), to))
        far.sort()
        self.far_key = np.array([k for k, _ in far] or [-1], np.int64)
        self.far_to = np.array([t for _, t in far] or [-1], np.int32)
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate([[0], np.cumsum([len(b) for b in spelled])]).astype(np.int64)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next nodes, -1 where there is none."""
        out = self.near[node, np.minimum(code, DIRECT - 1)]
        other = np.flatnonzero(code >= DIRECT)
        if len(other):
            key = (node[other].astype(np.int64) << 21) | code[other]
            k = np.minimum(np.searchsorted(self.far_key, key), len(self.far_key) - 1)
            out[other] = np.where(self.far_key[k] == key, self.far_to[k], -1)
        return out


class Lattice:
    """Forward sums of many words at once. Position p is the end of the p-th character of all words joined."""

    def __init__(self, pieces: Pieces, words: list[str]):
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        self.end = np.cumsum(size)
        begin = np.repeat(self.end - size, size)
        stop = begin + np.repeat(size, size)
        n, m = len(code), pieces.longest
        at, node, found = np.arange(n), np.zeros(n, np.int32), []
        for k in range(m):
            alive = at + k < stop[at]
            at, node = at[alive], node[alive]
            node = pieces.step(node, code[at + k])
            at, node = at[node >= 0], node[node >= 0]
            if not len(at):
                break
            whole = pieces.piece[node] >= 0
            found.append((at[whole] + k, node[whole]))
        m = max(1, len(found))
        arc = np.full((n, m), -np.inf)  # weight of the piece that ends with character p and has k + 1 characters
        self.id = np.full((n, m), -1, np.int32)
        for k, (p, node) in enumerate(found):
            arc[p, k] = pieces.weight[node]
            self.id[p, k] = pieces.piece[node]
        lone = np.flatnonzero(self.id[:, 0] < 0)  # characters without a piece
        arc[lone, 0] = BYTES_WEIGHT
        self.id[lone, 0] = -2 - code[lone].astype(np.int32)
        place = np.arange(n) - begin
        order = np.argsort(place, kind="stable")  # the first characters of all words, then the second ones, …
        cuts = np.searchsorted(place[order], np.arange(int(size.max(initial=0)) + 1))
        total = np.full(n, -np.inf)
        self.share = np.zeros((n, m), np.float32)
        for t in range(len(cuts) - 1):
            p = order[cuts[t] : cuts[t + 1]]
            reach = min(m, t + 1)
            before = p[:, None] - 1 - np.arange(reach)
            from_ = np.where(before >= begin[p][:, None], total[np.maximum(before, 0)], 0.0)
            way = from_ + arc[p, :reach]
            top = way.max(1)
            each = np.exp(way - top[:, None])
            sums = np.cumsum(each, axis=1)
            total[p] = top + np.log(sums[:, -1])
            self.share[p, :reach] = sums / sums[:, -1:]
            self.share[p, reach:] = 2.0

    def sample(self, word: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each occurrence, one after the other, and their numbers. word: which; key: its random key."""
        at = self.end[word]
        first = np.where(word > 0, self.end[word - 1], 0)
        active, made, count, k = np.arange(len(word)), [], np.zeros(len(word), np.int64), 0
        while len(active):
            # 24 bits: below 1 in single precision too, so a piece of some weight is always found
            draw = (mix(key[active] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            p = at[active] - 1
            size = (self.share[p] <= draw[:, None]).sum(1)
            made.append((active, self.id[p, size]))
            count[active] += 1
            at[active] -= size + 1
            active = active[at[active] > first[active]]
            k += 1
        start = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int64)
        for k, (active, ids) in enumerate(made):
            out[start[active] + count[active] - 1 - k] = ids
        return out, count


WORDS = re.compile("\n| +[^ \n]*|[^ \n]+")


class Sampler:
    def __init__(self, path: str, alpha: float = ALPHA, seed: int = SEED):
        self.pieces, self.seed = Pieces(path, alpha), seed

    def encode(self, keys: list, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of each text."""
        words = [WORDS.findall(" " + t.replace("▁", LITERAL)) if t else [] for t in texts]
        number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
        if not number:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        which = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        base = np.array([0 if k is None else (int(k) + 1) & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64)
        row = mix(mix(base) ^ np.uint64(self.seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        key = mix(np.repeat(row, sizes) + ranges(sizes).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        ids, count = Lattice(self.pieces, list(number)).sample(which, key)
        of_text = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(sizes)])]
        return self.spell_bytes(ids, np.diff(of_text))

    def spell_bytes(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Writes characters without a piece (-2 - code) as byte pieces."""
        lone = np.flatnonzero(ids < 0)
        if not len(lone):
            return ids, count
        codes, inverse = np.unique(-2 - ids[lone], return_inverse=True)
        spelled = [("▁" if c == ord(LITERAL) else chr(c)).encode() for c in codes.tolist()]
        width = np.ones(len(ids), np.int64)
        width[lone] = np.array([len(b) for b in spelled])[inverse]
        text = np.repeat(np.arange(len(count)), count)
        out = np.repeat(ids, width)
        at = np.cumsum(width) - width
        for k in range(4):
            has = width[lone] > k
            letter = np.array([b[k] if k < len(b) else 0 for b in spelled])[inverse[has]]
            out[at[lone[has]] + k] = self.pieces.byte_id[letter]
        return out, np.bincount(text, width, len(count)).astype(np.int64)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        p = self.pieces
        n = p.spelled_at[ids + 1] - p.spelled_at[ids]
        data = p.spelled[np.repeat(p.spelled_at[ids], n) + ranges(n)].tobytes()
        of_text = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(count)])].tolist()
        return [data[a + (b > a) : b] for a, b in zip(of_text[:-1], of_text[1:], strict=True)]


_samplers: dict[tuple, Sampler] = {}


def sampler(path: str, alpha: float, seed: int) -> Sampler:
    if (path, alpha, seed) not in _samplers:
        _samplers[path, alpha, seed] = Sampler(path, alpha, seed)
    return _samplers[path, alpha, seed]


def sampled_pieces(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = SEED, ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (ids as little-endian 32-bit integers), n_bytes and decoded_sha256 of the text decoded from them.

    ids: also the ids themselves. A text that doesn't decode to itself is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = sampler(path, alpha, seed)
        for rows, data, at in steps(batches, size=1 << 20):
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            found, count = code.encode(rows.column(0).to_pylist(), [t.decode() for t in texts])
            back = code.decode(found, count)
            if back != texts:
                raise ValueError("a text is not what its pieces decode to")
            ends = np.concatenate([[0], np.cumsum(count)])
            packed = found.astype("<u4")
            out = [rows.column(0), pa.array(count), pa.array([zlib.crc32(packed[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64()), pa.array([len(b) for b in back], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in back])]
            names = ["doc_id", "n_pieces", "ids_crc32", "n_bytes", "decoded_sha256"]
            if ids:
                out, names = [*out, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found.astype(np.int32)))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, n_bytes long, decoded_sha256 string" + ", ids array<int>" * ids)
