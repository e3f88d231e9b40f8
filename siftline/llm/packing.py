"""Packing token streams into fixed windows by order-preserving dynamic programming.

Each task packs the documents of its partition in their order. Windows may be
cut at the end of a document (free), at the end of a sentence (`SENTENCE`) or,
in stretches without such ends, at every `GRID`-th token (`HARD`). A window
costs its padding: `size` less its length, nothing if that is a power of two.

With candidates p, the best cost f(j) is the least of f(i) + size - (p[j] - p[i])
over the windows that fit, plus the penalty at p[j]. f(i) + p[i] doesn't
depend on j, so its least value over the sliding range is kept in a monotone
queue; windows of a power of two are looked up besides. Each candidate enters
and leaves the queue once.

Memory is bounded: once `BLOCK` tokens wait, the plan for them is made and all
but its last window given out; the rest waits for what follows. A sequence's
id is the task's partition above 33 bits and its number there below.

Defined cases: a null text counts as empty, and an empty text has the closing
id alone; null ids pass through; repeated rows are packed one by one; an empty
table gives no rows; other columns are ignored; a document longer than a block
is packed whole, over many windows.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.bpe import WHITE, byte_alphabet, tokenizer
from siftline.llm.common import bounded_batches, id_and_text

SENTENCE, HARD, GRID, BLOCK = 16, 64, 32, 1 << 19
_CACHED, _LONGEST = 350_000, 40
_SPLIT = str.maketrans({c: " " for c in WHITE})


#: words of these characters are in normal form, and lower() changes each by itself
_SIMPLE = re.compile(r"[ -~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: the vocabulary's pre-tokens, in lower-case words of these characters
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
_ODD = re.compile(r"[\x1c-\x1f]")


class WordBPE:
    """Ids as the library gives them for a vocabulary that drops white space, so that words can be encoded apart.

    A cache of two generations keeps the ids of words. What it lacks is merged
    by tiktoken, for which a space after a pre-token stands for the
    vocabulary's end of word; words of other than simple characters, and any
    vocabulary whose ids aren't in the order of its merges, go to the library.
    """

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.lib, self.end = Tokenizer.from_file(path), np.uint32(end).astype("<u4").tobytes()
        self.lib.no_truncation()
        self.lib.no_padding()
        vocab = self.lib.get_vocab()
        special = set(self.lib.get_added_tokens_decoder())
        self.closes, self.last = np.zeros(len(vocab) + 1, bool), np.zeros(len(vocab) + 1, bool)
        for token, i in vocab.items():
            sign = token.removesuffix("</w>")
            self.last[i] = sign != token
            self.closes[i] = self.last[i] and any(c in ".!?" for c in sign) and not any(c.isalnum() for c in sign)
        self.fast = self._merger(vocab, special)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _merger(self, vocab: dict[str, int], special: set[int]):
        import tiktoken

        merges = json.loads(self.lib.to_str())["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if [vocab.get(a + b) for a, b in pairs] != list(range(512, 512 + len(pairs))):
            return None
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t.removesuffix("</w>")) + b" " * t.endswith("</w>"): i for t, i in vocab.items() if i not in special}
        return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 512 + len(pairs) else None

    def _encoded(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        joined = " ".join(words)
        if self.fast and "<|" not in joined and _SIMPLE.fullmatch(joined):
            return self._merged(joined.lower())
        simple = [w for w in words if self.fast and "<|" not in w and _SIMPLE.fullmatch(w)]
        found = dict(zip(simple, self._merged(" ".join(simple).lower()) if simple else (), strict=True))
        if other := [w for w in words if w not in found]:
            for w, e in zip(other, self.lib.encode_batch_fast(other, add_special_tokens=False), strict=True):
                found[w] = np.array(e.ids, "<u4").tobytes()
        return [found[w] for w in words]

    def _merged(self, joined: str) -> list[bytes]:
        """The ids of each of the words, lower-case and of simple characters, between single spaces."""
        words = joined.split(" ")
        # most are letters, or letters and one sign
        pieces = [w if w.isalpha() else f"{w[:-1]} {w[-1]}" if w[:-1].isalpha() else " ".join(_PIECES.findall(w)) for w in words]
        ids = self.fast.encode_to_numpy(" ".join(pieces) + " ", disallowed_special=()).astype("<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        stops = (ends[np.cumsum([p.count(" ") + 1 for p in pieces]) - 1] * 4).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *stops], stops)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers, the closing id last."""
        # split() would also take four separators that the library keeps
        parts = [[w for w in t.translate(_SPLIT).split(" ") if w] if _ODD.search(t) else t.split() for t in texts]
        young, old = self.young, self.old
        if missing := set(filterfalse(young.__contains__, chain.from_iterable(parts))):
            for w in [w for w in missing if w in old]:
                young[w] = old[w]
            if new := [w for w in missing if w not in young]:
                young.update(zip(new, self._encoded(new), strict=True))
        out = [b"".join(map(young.__getitem__, p)) + self.end for p in parts]
        for w in [w for w in missing if len(w) > _LONGEST]:
            del young[w]
        if len(young) > _CACHED:
            self.young, self.old = {}, young
        return out


def plan(ends: np.ndarray, penalties: np.ndarray, size: int) -> list[int]:
    """Where to cut a stream from 0 to ends[-1], of the places `ends` (ascending, none over `size` after the one before)."""
    p = np.concatenate([[0], ends])
    more: dict[int, list[int]] = {}
    for k in range(6, size.bit_length() - 1):
        at = np.searchsorted(p, p - (1 << k))
        for j in np.flatnonzero(p[at] == p - (1 << k)).tolist():
            more.setdefault(j, []).append(int(at[j]))
    place, extra = p.tolist(), [0, *penalties.tolist()]
    best, came = [0.0] * len(place), [0] * len(place)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # values f(i) + p[i], rising
    for j in range(1, len(place)):
        here = place[j]
        while place[queue[0][1]] < here - size:
            queue.popleft()
        value, i = queue[0]
        value += size - here
        for k in more.get(j, ()):
            if best[k] < value:
                value, i = best[k], k
        best[j], came[j] = value + extra[j], i
        key = best[j] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(place) - 1
    while j:
        out.append(place[j])
        j = came[j]
    return out[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, and their penalties."""
    sentences = np.flatnonzero(closes[ids]) + 1
    ends = np.union1d(sentences, doc_ends)
    starts = np.concatenate([[0], ends[:-1]])
    wide = np.flatnonzero(ends - starts > 2 * GRID)
    hard = [np.arange(starts[i] + GRID, ends[i], GRID) for i in wide]
    places = np.union1d(ends, np.concatenate(hard)) if hard else ends
    penalty = np.full(len(places), HARD, float)
    penalty[np.searchsorted(places, sentences)] = SENTENCE
    penalty[np.searchsorted(places, doc_ends)] = 0
    return places, penalty


class _Packer:
    """Takes documents in order and gives out pieces: (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, closes: np.ndarray, size: int):
        self.closes, self.size, self.sequence = closes, size, 0
        self.waiting: deque[list] = deque()  # doc_id, its ids as bytes, how many of them are given out
        self.tokens = 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        self.waiting.append([doc_id, ids, 0])
        self.tokens += len(ids) // 4
        if self.tokens >= BLOCK:
            yield from self.give(False)

    def give(self, last: bool) -> Iterator[tuple]:
        if not self.waiting:
            return
        lengths = np.array([len(d[1]) // 4 - d[2] for d in self.waiting])
        doc_ends = lengths.cumsum()
        stream = np.frombuffer(b"".join(memoryview(d[1])[4 * d[2] :] for d in self.waiting), "<u4")
        places, penalties = candidates(stream, doc_ends, self.closes)
        cuts = plan(places, penalties, self.size)
        done, at = (cuts if last else cuts[:-1]), 0
        for cut in done:
            offset = 0
            while at < cut:
                doc = self.waiting[0]
                whole = len(doc[1]) // 4
                n = min(cut - at, whole - doc[2])
                yield doc[0], doc[2], doc[1][4 * doc[2] : 4 * (doc[2] + n)], whole, self.sequence, offset
                doc[2] += n
                at += n
                offset += n
                if doc[2] == whole:
                    self.waiting.popleft()
            self.sequence += 1
        self.tokens -= at


def pack(docs: DataFrame, path: str, end: int = 1, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, ids (bytes: little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset.

    `path`: a vocabulary of the tokenizers library that drops white space. `end`: the id after each document.
    """
    bounded_batches(docs.sparkSession)
    narrow = id_and_text(docs, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(WordBPE, path, end)
        packer, first = _Packer(bpe.closes, size), TaskContext.get().partitionId() << 33
        id_type = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c[0], id_type), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.int64()), pa.array([first + s for s in c[4]], pa.int64()), pa.array(c[5], pa.int64())], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc_id, ids in zip(part.column(0).to_pylist(), bpe.encode_batch(part.column(1).to_pylist()), strict=True):
                    if rows := list(packer.add(doc_id, ids)):
                        yield batch_of(rows)
        if rows := list(packer.give(True)):
            yield batch_of(rows)

    return narrow.mapInArrow(packed, f"doc_id {kind}, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def digest(pieces: DataFrame) -> DataFrame:
    """Per piece: lengths and checksums instead of the ids."""
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
