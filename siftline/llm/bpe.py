"""BPE encoding and decoding, byte-level vocabulary: long texts by tree concatenation.

A text of more than `leaf` characters is halved until each part fits, wherever
the middle falls. The parts are encoded apart and joined pairwise, up the tree.
A join re-encodes a window around the cut, twice as wide each time, until both
sides agree exactly:

* the window begins and ends at places where the pre-tokenizer always
  separates (a character that isn't white space before one that is; a change
  between letters, digits and other signs, unless an apostrophe stands before
  it), and both parts have a token boundary there; or
* where no such place is near, as in the middle of a long run of one kind, it
  begins and ends at token boundaries of the parts, and the first and the last
  token of the window are those that the parts have there. Adjacent tokens
  that a BPE encoding keeps side by side remain so in any longer text, so
  agreement of one token on either side makes the whole exact.

Texts of more than `spread` characters are cut into pieces of that size that
tasks encode in parallel; their joins are the same.

Leaves are cut where the pre-tokenizer always separates, and a bounded cache
of two generations keeps the ids of short units. What it lacks is merged by
tiktoken if of simple characters, by the tokenizers library if not.

Defined cases: a null text counts as empty and has no ids; special tokens'
strings in a text become their ids, as in the library; null ids pass through;
repeated rows give repeated results; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import bounded_batches, id_and_text

#: what the pre-tokenizers take as white space (Unicode's White_Space)
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_CACHED, _LONGEST = 350_000, 40
#: units of these characters are read alike by every edition of Unicode; they begin with white space and end with another character
_SIMPLE = re.compile(r"[ \n]+[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: the pre-tokens of a byte-level vocabulary, as the library has them built in
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            out[chr(256 + len(out) - len(plain))] = b
    return out


def _kind(ch: str) -> str:
    """w, L, N or P: how the pre-tokenizer classes a character."""
    return "w" if ch in WHITE else c if (c := unicodedata.category(ch)[0]) in "LN" else "P"


class ByteBPE:
    """Encodes as the library does with this file, add_special_tokens=False, no truncation or padding."""

    def __init__(self, path: str, leaf: int = 4096):
        from tokenizers import Tokenizer

        self.lib, self.leaf = Tokenizer.from_file(path), leaf
        self.lib.no_truncation()
        self.lib.no_padding()
        alphabet = byte_alphabet()
        special = self.lib.get_added_tokens_decoder()
        self.bytes = [b""] * self.lib.get_vocab_size()
        for token, i in self.lib.get_vocab().items():
            self.bytes[i] = token.encode() if i in special else bytes(alphabet[c] for c in token)
        self.special = [t.content for t in special.values()]
        self.reach = max([len(s) for s in self.special], default=0)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.sizes = np.array([len(b) for b in self.bytes])
        self.fast = self._merger(special)

    def _merger(self, special: dict):
        """tiktoken with the same merges; None for a file whose ids aren't in the order of its merges, or that splits in another way."""
        import tiktoken

        said, vocab = json.loads(self.lib.to_str()), self.lib.get_vocab()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        known = said["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and said["normalizer"] is None
        if not known or [vocab.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
            return None
        return tiktoken.Encoding("units", pat_str=_PATTERN, mergeable_ranks={self.bytes[i]: i for i in vocab.values() if i not in special}, special_tokens={})

    def _encoded(self, units: list[str]) -> dict[str, tuple[int, ...]]:
        """Between a unit's last character and the next one's white space the pre-tokenizer separates, so simple units are merged as one text."""
        simple = [u for u in units if self.fast and _SIMPLE.fullmatch(u) and "<|" not in u]
        found: dict[str, tuple[int, ...]] = {}
        if simple:
            ids = self.fast.encode_to_numpy("".join(simple), disallowed_special=())
            stops = np.searchsorted(self.sizes[ids].cumsum(), np.cumsum([len(u.encode()) for u in simple])) + 1
            every, cuts = ids.tolist(), stops.tolist()
            found = {u: tuple(every[a:b]) for u, a, b in zip(simple, [0, *cuts], cuts)}
        if other := [u for u in units if u not in found]:
            for u, e in zip(other, self.lib.encode_batch_fast(other, add_special_tokens=False), strict=True):
                found[u] = tuple(e.ids)
        return found

    def leaf_ids(self, texts: list[str]) -> list[list[int]]:
        """The ids of short texts, unit by unit."""
        parts = [_UNIT.findall(t) for t in texts]
        young, old = self.young, self.old
        if missing := set(filterfalse(young.__contains__, chain.from_iterable(parts))):
            for u in [u for u in missing if u in old]:
                young[u] = old[u]
            if new := [u for u in missing if u not in young]:
                young.update(self._encoded(new))
        out = [list(chain.from_iterable(map(young.__getitem__, p))) for p in parts]
        for u in [u for u in missing if len(u) > _LONGEST]:
            del young[u]
        if len(young) > _CACHED:
            self.young, self.old = {}, young
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        leaves: list[str] = []
        trees = [self._halved(t, leaves) for t in texts]
        ids = self.leaf_ids(leaves)
        return [self._joined(t, tree, ids)[1] for t, tree in zip(texts, trees, strict=True)]

    def _halved(self, text: str, leaves: list[str]):
        """A tree of leaf numbers; adds the leaves' texts to `leaves`."""
        if len(text) <= self.leaf:
            leaves.append(text)
            return len(leaves) - 1
        mid = len(text) // 2
        return self._halved(text[:mid], leaves), self._halved(text[mid:], leaves)

    def _joined(self, text: str, tree, ids: list[list[int]]) -> tuple[str, list[int]]:
        if isinstance(tree, int):
            return text, ids[tree]
        mid = len(text) // 2
        a, b = self._joined(text[:mid], tree[0], ids)[1], self._joined(text[mid:], tree[1], ids)[1]
        return text, self.join(text, mid, a, b)

    def join(self, text: str, cut: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of `text`, given those of text[:cut] and text[cut:]."""
        if not left or not right:
            return left or right
        width = 32
        while True:
            a, keep = self._left_edge(text, cut, left, width)
            b, drop = self._right_edge(text, cut, right, width)
            if a is not None and b is not None:
                middle = self.leaf_ids([text[a:b]])[0]
                agree_left = keep == 0 or a in (cut,) or self._boundary(text, a) or (keep < len(left) and middle[:1] == left[keep : keep + 1])
                agree_right = drop == len(right) or self._boundary(text, b) or (drop > 0 and middle[-1:] == right[drop - 1 : drop])
                if agree_left and agree_right:
                    return left[:keep] + middle + right[drop:]
            width *= 2

    def _boundary(self, text: str, i: int) -> bool:
        """Whether the pre-tokenizer always separates before text[i], whatever else the text holds."""
        if i in (0, len(text)):
            return True
        x, y = _kind(text[i - 1]), _kind(text[i])
        if x == "w" or x == y:
            return False
        if y == "w":
            return True
        near = text[max(0, i - self.reach) : i + self.reach]
        return text[i - 1] != "'" and not any(s in near for s in self.special)

    def _inside_run(self, text: str, i: int) -> bool:
        """Whether text[i] is well inside a run of one kind, so that any token boundary there lies within one pre-token."""
        near = {_kind(c) for c in text[max(0, i - 8) : i + 8]}
        return len(near) == 1 and 8 <= i <= len(text) - 8

    def _left_edge(self, text: str, cut: int, ids: list[int], width: int) -> tuple[int | None, int]:
        """Where the window begins, and how many of the left ids stand before it; None if there is no such place within `width`."""
        low = max(0, cut - width)
        if low == 0:
            return 0, 0
        at = next((i for i in range(low, cut - 1) if self._boundary(text, i)), None)
        if at is None and not self._inside_run(text, low):
            return None, 0
        need, k = len(text[low if at is None else at : cut].encode()), len(ids)
        while need > 0 and k:
            k -= 1
            need -= len(self.bytes[ids[k]])
        if at is not None:
            return (at, k) if need == 0 else (None, 0)
        begin = self._char_at(text, low, need)
        return (begin, k) if begin is not None and self._inside_run(text, begin) else (None, 0)

    @staticmethod
    def _char_at(text: str, i: int, need: int) -> int | None:
        """The place -need bytes before text[i]; None if that is inside a character."""
        while need < 0 and i:
            i -= 1
            need += len(text[i].encode())
        return i if need == 0 else None

    def _right_edge(self, text: str, cut: int, ids: list[int], width: int) -> tuple[int | None, int]:
        """Where the window ends, and how many of the right ids it takes in."""
        high = min(len(text), cut + width)
        if high == len(text):
            return high, len(ids)
        at = next((i for i in range(high, cut + 1, -1) if self._boundary(text, i)), None)
        if at is None and not self._inside_run(text, high):
            return None, 0
        need, k = len(text[cut : high if at is None else at].encode()), 0
        while need > 0 and k < len(ids):
            need -= len(self.bytes[ids[k]])
            k += 1
        if at is not None:
            return (at, k) if need == 0 else (None, 0)
        end = high
        while need < 0 and end < len(text):
            need += len(text[end].encode())
            end += 1
        return (end, k) if need == 0 and self._inside_run(text, end) else (None, 0)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_MADE: dict[tuple, object] = {}


def tokenizer(kind: type, path: str, *more):
    """One for each Python worker, as its cache serves later tasks too."""
    if (kind, path, *more) not in _MADE:
        _MADE[kind, path, *more] = kind(path, *more)
    return _MADE[kind, path, *more]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 4096, spread: int = 1 << 20) -> DataFrame:
    """A row for each document: doc_id, ids (array of int), decoded (string)."""
    bounded_batches(docs.sparkSession)
    narrow = id_and_text(docs, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ByteBPE, path, leaf)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids = bpe.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ByteBPE, path, leaf)
        for batch in batches:
            for at in range(batch.num_rows):
                part = batch.slice(at, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bpe.encode_batch(part.column(3).to_pylist()), pa.list_(pa.int32()))], names=["row", "doc_id", "pos", "piece", "ids"])

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        bpe = tokenizer(ByteBPE, path, leaf)
        rows = rows.sort_values("pos")
        parts = [(t, list(i)) for t, i in zip(rows["piece"], rows["ids"], strict=True)]
        while len(parts) > 1:
            pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
            parts = [p[0] if len(p) == 1 else (p[0][0] + p[1][0], bpe.join(p[0][0] + p[1][0], len(p[0][0]), p[0][1], p[1][1])) for p in pairs]
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[:1], "ids": [parts[0][1]], "decoded": [bpe.decode(parts[0][1])]})

    out = f"doc_id {kind}, ids array<int>, decoded string"
    long = F.length("text") > spread
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / spread).cast("int")), lambda i: F.substr(F.col("text"), i * spread + 1, F.lit(spread)))
    cut = narrow.filter(long).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.posexplode(cuts).alias("pos", "piece")).repartition("row", "pos")
    apart = cut.mapInArrow(pieces, f"row bigint, doc_id {kind}, pos int, piece string, ids array<int>").groupBy("row").applyInPandas(joined, out)
    return narrow.filter(~long).mapInArrow(whole, out).unionByName(apart)


def digest(encoded: DataFrame) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    said = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
