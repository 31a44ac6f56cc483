"""Token counts: greedy longest-match word pieces counted by a linear automaton, without building the pieces.

Words (runs of bytes other than space and 0x09-0x0D) are marked with a leading U+2581 and matched greedily against the pieces
of a public vocabulary; a byte that begins no piece counts as a piece by itself (byte fallback). The vocabulary's
trie has, for each node, a failure link and the number of pieces that are popped on the way: when no edge fits, the
longest piece on the path is popped and the rest of the path, matched again, is the node that is gone on from. So each byte is
read once. An Arrow batch counts every distinct word once, all words side by side.

Null and empty texts have 0 words and tokens. One row per input row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.text import Text, Words, flat, slices, sums

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
#: Words over this many bytes are counted one by one.
LONG = 200


def pieces(path: str) -> list[bytes]:
    """The ordinary pieces of a sentencepiece vocabulary as bytes."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
    return [model.id_to_piece(i).encode() for i in range(model.vocab_size()) if not special(i)]


class Automaton:
    """Trie with failure links; `edge` maps node * 256 + byte to a node, node 0 is the root.

    fail[v] is the node after popping from v, pops[v] the pieces popped; `end` counts the pieces of what v has read.
    """

    def __init__(self, vocabulary: Iterable[bytes]):
        edge: dict[int, int] = {}
        depth, last, piece = [0], [0], [False]
        order: list[tuple[int, int, int]] = []  # parent, byte, node

        def child(node: int, byte: int) -> int:
            to = edge.get(node * 256 + byte)
            if to is None:
                to = edge[node * 256 + byte] = len(depth)
                depth.append(depth[node] + 1)
                last.append(byte)
                piece.append(False)
                order.append((node, byte, to))
            return to

        for word in [bytes([b]) for b in range(256)] + list(vocabulary):
            node = 0
            for b in word:
                node = child(node, b)
            piece[node] = bool(word)
        order.sort(key=lambda x: depth[x[2]])
        fail, pops = [-1] * len(depth), [0] * len(depth)
        for parent, byte, node in order:
            if piece[node]:
                fail[node], pops[node] = 0, 1
                continue
            # What is left after the parent's pops, then the byte: pop on until the byte fits.
            at, n = fail[parent], pops[parent]
            while at * 256 + byte not in edge:
                n += pops[at]
                at = fail[at]
            fail[node], pops[node] = edge[at * 256 + byte], n
        end = [0] * len(depth)
        for _, _, node in order:
            end[node] = pops[node] + end[fail[node]]
        self.edge = edge
        self.fail, self.pops, self.end = (np.array(x, np.int64) for x in (fail, pops, end))
        # Open addressing over the edges, for many lookups at once.
        size = 1 << (len(edge) * 2).bit_length()
        self._mask, self._key, self._to = size - 1, np.full(size, -1, np.int64), np.zeros(size, np.int64)
        keys = np.fromiter(edge.keys(), np.int64, len(edge))
        to = np.fromiter(edge.values(), np.int64, len(edge))
        slot = self._slot(keys)
        while len(keys):
            free = self._key[slot] < 0
            take = np.flatnonzero(free)
            take = take[np.unique(slot[take], return_index=True)[1]]
            self._key[slot[take]], self._to[slot[take]] = keys[take], to[take]
            rest = np.ones(len(keys), bool)
            rest[take] = False
            keys, to, slot = keys[rest], to[rest], (slot[rest] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * 0x9E3779B1) >> 12) & self._mask

    def follow(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The edges' targets, -1 where there is none."""
        key = node * 256 + byte
        slot = self._slot(key)
        out = np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            seen = self._key[slot]
            hit = seen == key[todo]
            out[todo[hit]] = self._to[slot[hit]]
            on = ~hit & (seen >= 0)
            todo, slot = todo[on], (slot[on] + 1) & self._mask
        return out

    def count_one(self, word: bytes) -> int:
        edge, fail, pops, node, n = self.edge, self.fail, self.pops, 0, 0
        for b in word:
            to = edge.get(node * 256 + b)
            while to is None:
                n += int(pops[node])
                node = int(fail[node])
                to = edge.get(node * 256 + b)
            node = to
        return n + int(self.end[node])

    def count(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Pieces of each of the strings data[off[i]:off[i + 1]]."""
        length = np.diff(off)
        out = np.zeros(len(length), np.int64)
        for i in np.flatnonzero(length > LONG):
            out[i] = self.count_one(data[off[i] : off[i + 1]].tobytes())
        short = np.flatnonzero(length <= LONG)
        short = short[np.argsort(-length[short], kind="stable")]
        node, begin, size = np.zeros(len(short), np.int64), off[:-1][short], length[short]
        for place in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -place, "left"))
            byte = data[begin[:n] + place].astype(np.int64)
            to = self.follow(node[:n], byte)
            todo = np.flatnonzero(to < 0)
            while len(todo):
                at = node[todo]
                out[short[todo]] += self.pops[at]
                node[todo] = self.fail[at]
                to[todo] = self.follow(node[todo], byte[todo])
                todo = todo[to[todo] < 0]
            node[:n] = to
        out[short] += self.end[node]
        return out


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(pieces(path))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens, n_bytes of every document. The vocabulary file must be readable by every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(vocabulary)
        marked = len(MARK)
        for batch in batches:
            for part in slices(batch, 1):
                text = Text(part.column(1))
                words = Words(text)
                ids, distinct = words.encode()
                data, off = flat(distinct)
                to = off + marked * np.arange(len(off))
                with_mark = np.tile(np.frombuffer(MARK, np.uint8), len(distinct))
                body = np.ones(to[-1], bool)
                all_bytes = np.empty(to[-1], np.uint8)
                for k in range(marked):
                    body[to[:-1] + k] = False
                all_bytes[~body], all_bytes[body] = with_mark, data
                count = machine.count(all_bytes, to)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words.count), pa.array(sums(count[ids], words.first)), pa.array(np.diff(text.off))],
                    ["doc_id", "n_words", "n_tokens", "n_bytes"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_bytes long")
