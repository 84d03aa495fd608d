"""Sequence packing by minimum bin slack.

Documents are tokenised and laid into sequences of ``capacity`` tokens. A
document longer than the capacity first gives whole sequences; what is left of
each document goes into a window of open pieces. Each new sequence starts with
the longest open piece, and a bitset subset-sum dynamic programme over the
multiset of remaining lengths picks the pieces that fill it closest to
capacity; the stored bitsets are walked back to get the count of each length.
What slack is left is closed by cutting one more piece, and the last open
tokens of a task become sequences at powers of two, so that nothing is padded.

Windows live inside one input partition: no shuffle, memory bounded by the
window, and a lost task is redone from its own split alone.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from grovekit.llm.common import binary_docs, slices, text_bytes, trim

CAPACITY = 4096
END_ID = 2
WINDOW = 512  # open pieces from which a sequence is chosen
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TAIL = b"!#$%&()*+,-./:;=?@[]^_|~"  # ASCII signs that never share a token with a letter or digit before them
#: A comma or full stop at a word's end whose left neighbour isn't an ASCII letter or digit, or a Latin-1 letter.
_ODD_STOP = re.compile(rb"[.,][ \n](?<![a-z0-9]..)(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]..)", re.S)
#: First UTF-8 bytes of U+0300 to U+037F: a mark may join a small letter before it, and not the capital.
_MARKS = re.compile(rb"[\xcc\xcd]")
# The normalisation and word pattern for which words may be encoded one by one.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CACHE_WORDS, _CACHE_LEN, _CACHE_KEEP = 400_000, 48, 9


class WordTokenizer:
    """Token ids of whole texts, by way of a bounded cache of white-space-free chunks.

    No token of a word-level BPE spans white space, so a text's ids are the
    concatenated ids of its chunks, and each chunk is encoded once. Signs at the
    end of a chunk are parted from it where the tokenizer itself parts them from
    the last character. A tokenizer with another normalisation or word pattern
    than the known one encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._model = model = Tokenizer.from_file(path)
        self._encode = model.encode_batch_fast
        self._known: dict[bytes, bytes] = {}
        self._ending: dict[str, bool] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self.by_words = (spec["normalizer"] or {}).get("normalizers") == _NORMALIZERS and split == _WORDS and spec["model"].get("end_of_word_suffix") == "</w>"
        vocabulary = model.get_vocab(with_added_tokens=False)
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self._ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def _raw(self, chunks: list[bytes]) -> Iterator[bytes]:
        """Ids of each chunk. Plain words are encoded together and parted where an id ends a word."""
        for at in range(0, len(chunks), 500):
            part = [c.decode() for c in chunks[at : at + 500]]
            if all(x.isalpha() and x.lower().isalpha() for x in part):
                ids = np.asarray(self._encode([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
                ends = np.flatnonzero(self._ends[ids]) + 1
                if len(ends) == len(part):
                    raw, a = ids.tobytes(), 0
                    for z in (4 * ends).tolist():
                        yield raw[a:z]
                        a = z
                    continue
            for e in self._encode(part, add_special_tokens=False):
                yield np.asarray(e.ids, dtype="<u4").tobytes()

    def _parts(self, last: str) -> bool:
        """Whether signs after this character, letter or digit as it may seem, are words of their own."""
        found = self._ending.get(last)
        if found is None:
            words = self._model.pre_tokenizer.pre_tokenize_str(self._model.normalizer.normalize_str(last + "!"))
            found = self._ending[last] = last.isalnum() and words[-1][0] == "!"
        return found

    def _learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that aren't cached."""
        known, split, plain = self._known, {}, set()
        for c in new:
            base = c.rstrip(_TAIL)
            tail = c[len(base) :]
            if base and tail and b"<|" not in c and self._parts(base.decode()[-1]):
                split[c] = (base, tail)
                plain |= {x for x in (base, tail) if x not in known}
            else:
                plain.add(c)
        order = [c for c in plain if c.decode().isalpha()]
        order += plain.difference(order)
        got = dict(zip(order, self._raw(order), strict=True))
        for c, (base, tail) in split.items():
            got[c] = (known.get(base) or got.get(base, b"")) + (known.get(tail) or got.get(tail, b""))
        return got

    @staticmethod
    def _chunks(text: bytes) -> list[bytes]:
        """Lower-cased parts that are encoded by themselves: at white space, and before stops that end a word."""
        if b"<|" in text or _MARKS.search(text):
            return text.split()
        text = text.lower()
        if not _ODD_STOP.search(text):
            text = text.replace(b", ", b" , ").replace(b". ", b" . ").replace(b".\n", b" .\n")
        return text.split()

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_words:
            return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self._encode([t.decode() for t in texts], add_special_tokens=False)]
        known = self._known
        if len(known) > _CACHE_WORDS:  # short words are the common ones
            self._known = known = {c: v for c, v in known.items() if len(c) < _CACHE_KEEP}
            if len(known) > _CACHE_WORDS // 2:
                known.clear()
        words = [self._chunks(t) for t in texts]
        new = set().union(*words).difference(known) if words else set()
        extra = self._learn(new)
        known.update(extra)
        out = [b"".join(map(known.__getitem__, w)) for w in words]
        for c in [c for c in extra if len(c) > _CACHE_LEN]:
            del known[c]
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process, so that its cache serves all its tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of the lengths whose sum is closest to, and at most, ``capacity``."""
    mask, reach = (1 << (capacity + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # (length, copies in this step, reachable sums before it)
    for length in sorted(counts, reverse=True):
        left, copies = min(counts[length], capacity // length if length else 0), 1
        while left > 0:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            copies *= 2
        if reach >> capacity:
            break
    total, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] += take
            total -= length * take
    return dict(chosen)


class _Packer:
    """Open pieces of one task and the rows of the sequences closed so far."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next_id = capacity, base
        self.open: dict[int, list[tuple]] = defaultdict(list)
        self.n_open = self.open_tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, cap = len(ids) // 4, self.capacity
        whole = n - n % cap
        for at in range(0, whole, cap):
            self._close([(doc_id, at, ids[4 * at : 4 * (at + cap)], n)])
        if n > whole:
            self._push((doc_id, whole, ids[4 * whole :], n))

    def _push(self, piece: tuple) -> None:
        self.open[len(piece[2]) // 4].append(piece)
        self.n_open += 1
        self.open_tokens += len(piece[2]) // 4

    def _pop(self, length: int) -> tuple:
        pieces = self.open[length]
        piece = pieces.pop()
        if not pieces:
            del self.open[length]
        self.n_open -= 1
        self.open_tokens -= length
        return piece

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1

    def fill(self, target: int) -> None:
        """Close one sequence of exactly ``target`` tokens; as many are open."""
        longest = max((x for x in self.open if x <= target), default=0)
        pieces, room = [], target
        if longest:
            pieces.append(self._pop(longest))
            room -= longest
        if room:
            for length, k in best_fill({x: len(v) for x, v in self.open.items() if x <= room}, room).items():
                pieces += [self._pop(length) for _ in range(k)]
                room -= length * k
        if room:  # cut one more piece: all that are left are longer than the room
            doc_id, start, ids, n = self._pop(min(self.open, key=lambda x: (x < room, x)))
            pieces.append((doc_id, start, ids[: 4 * room], n))
            self._push((doc_id, start + room, ids[4 * room :], n))
        self._close(pieces)

    def drain(self, window: int) -> None:
        while self.n_open > window and self.open_tokens >= self.capacity:
            self.fill(self.capacity)

    def finish(self) -> None:
        while self.open_tokens >= self.capacity:
            self.fill(self.capacity)
        while self.open_tokens:
            self.fill(1 << (self.open_tokens.bit_length() - 1))

    def take(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """Pieces of documents laid into sequences; one row per piece (``SCHEMA``).

    Null and empty texts hold the end id only. Null ids are carried through.
    Repeated rows are packed as often as they occur. Other columns are ignored.
    Sequence ids are unique over the result; an empty table gives no rows.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = np.asarray([end_id], dtype="<u4").tobytes()
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        encode, task = tokenizer(tokenizer_path), TaskContext.get()
        packer = _Packer(capacity, (task.partitionId() if task else 0) << 40)

        def emit() -> Iterator[pa.RecordBatch]:
            if rows := packer.take():
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for b in slices(batches, 4 << 20):
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(text_bytes(b.column(1))), strict=True):
                packer.add(doc_id, ids + end)
            packer.drain(window)
            yield from emit()
        packer.finish()
        yield from emit()

    return binary_docs(docs).mapInArrow(pack, SCHEMA)
