"""Line deduplication by a segment-partition edit join, and by prefixes of runs of words for passages.

Lines link if few edits (insertions, deletions, substitutions of one character)
turn one into the other: one for each `each` characters of the longer line, at
most `edits`. Linked lines, and what links reach, are a class. So lines of fewer
than `each` characters are of one class only if they are equal.

1. Let t be the edits that a line s allows as the longer one. Each different
   line r is cut into t + 1 segments. If r is within t edits of s, a segment of r
   stands in s unchanged near its place. So r is filed under each segment (with
   its length by eights, t and the segment's number), for each t that a partner can allow,
   and s looks up, for each length from its own less t, the few substrings that
   can be such a segment (multi-match-aware choice).
2. Under a key, pairs go on of a line that looks it up and one filed, if their lengths
   and counts of characters are no further apart than so many edits can bring them.
3. The lines that go on get their texts, and each pair is compared once by banded
   bit-parallel edit distance.

Two edits are little in a passage. So lines also link if both have at least
`PASSAGE` words and at most a tenth of the longer one's words must be inserted,
deleted or substituted. An edit touches no two runs of `GRAM` words that don't
overlap. So a line's runs are taken in one order of all runs until more of them lie
apart than its longest partner allows edits. One of these is in any partner, too,
and among those that it takes if it takes as many in the order; else the other
way round. So a line is filed under the runs that it takes. The order is by hash,
but runs that many lines of a sample hold come last, as a passage within many
long lines would. An edit of a character changes at most two words, so links of lines
of many words are all of this kind, and those aren't filed by characters.

Under a key, of either kind, rows of few lines become pairs, and each pair of lines is
compared once; of many lines, each is compared with the one that has most partners by
counts, and if that doesn't join them all, all of the key's are. A spanning forest of
the links goes to `components`: a line already in a partner's component isn't compared again.

Keys are dealt by hash into parts in the tasks that make them, so a row that is
shuffled holds many keys, and a part is sorted by the task that gets it. A key of so
many lines that a part outgrows its task goes on as it is. Equal lines of a batch of
texts are shuffled as one row, so a common line makes no long partition.

A key with more than `most` lines, or with very long ones, is split into parts by
hash; each pair of parts is compared on its own, so no pair is lost.

Defined cases: a null text counts as empty and has one empty line; a line that
repeats, within a text or across texts, is of one class; null ids pass through
and come after all others; repeated rows have all their lines in classes of the
first; an empty table gives no rows; other columns are ignored, or returned as
they are, whatever their names. Lines of any length are compared whole. Lines
are told apart by 64-bit hashes and their lengths.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from siftline.llm.common import PAIRS, SIEVE, bounded_batches, id_and_text, shuffle_parts, sieve, written
from siftline.llm.components import components, joined

EDITS, EACH, MOST = 2, 12, 512
#: least words of a passage, what part of its words may differ (one in so many), and words to a key
PASSAGE, PART, GRAM = 20, 10, 4
#: texts of the sample, and how many of its passages hold a run of words that comes last as a key
SAMPLE, OFTEN = 20_000, 6
#: bytes of texts to a task that sorts keys, part by part, and rows of keys that a task holds before it deals them out
TASK_BYTES, HELD = 32 << 20, 1 << 19
_ROW = np.dtype([("k", "<i8"), ("h", "<i8"), ("bag", "<i8"), ("n", "<i4")])
_SEEN, _BLANK = 1_000_000, re.compile(r"\s")


def segments(length: int, tau: int) -> list[tuple[int, int]]:
    """Begin and length of each of tau + 1 segments, the longer ones last."""
    short, longer = divmod(length, tau + 1)
    out, at = [], 0
    for i in range(tau + 1):
        n = short + (i >= tau + 1 - longer)
        out.append((at, n))
        at += n
    return out


def lookups(length: int, tau: int) -> list[tuple[int, int, int, int]]:
    """(length of the filed line, segment, begin, segment's length) of each substring that a line of `length` looks up."""
    out = []
    for filed in range(max(tau + 1, length - tau), length + 1):
        gap = length - filed
        for i, (at, n) in enumerate(segments(filed, tau)):
            low = max(0, at - i, at + gap - (tau - i))
            high = min(length - n, at + i, at + gap + (tau - i))
            out += [(filed, i, k, n) for k in range(low, high + 1)]
    return out


def allowed(length: int, edits: int = EDITS, each: int = EACH) -> int:
    """Edits that a pair may be apart whose longer line has this length."""
    return min(edits, length // each)


#: odd, so that it has an inverse; its powers, and their inverses, weigh a text's characters by place
_BASE, _WIDE, _LOT = 0xD6E8FEB86659FD93, 4096, 1 << 15
_POWERS, _INVERSES = (np.multiply.accumulate(np.array([1] + [x] * (8 * _LOT), np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
_PLANS: dict[tuple[int, int, int], np.ndarray] = {}


def _plan(n: int, edits: int, each: int) -> np.ndarray:
    """Begin, end, seed and role of each key of a line of n characters, in four rows; role: 1 filed, 2 looked up, 3 both.

    Keys hold a line's length by eights, so that most lookups of neighbouring lengths are one.
    """
    if (n, edits, each) not in _PLANS:
        if len(_PLANS) > 20_000:
            _PLANS.clear()
        seed = lambda m, t, i: ((m >> 3) * 16 + t) * 16 + i
        of = {t for m in range(n, n + edits + 1) if (t := allowed(m, edits, each)) and m - n <= t}
        roles: dict[tuple[int, int, int], int] = {(at, at + k, seed(n, t, i)): 1 for t in sorted(of) if n > t for i, (at, k) in enumerate(segments(n, t))}
        if t := allowed(n, edits, each):
            for m, i, k, w in lookups(n, t):
                roles[key] = roles.get(key := (k, k + w, seed(m, t, i)), 0) | 2
        _PLANS[n, edits, each] = np.array([(*key, role) for key, role in roles.items()], np.int64).reshape(-1, 4).T
    return _PLANS[n, edits, each]


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(32))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _long_hash(text: str) -> int:
    """As `_line_keys` hashes a segment, for those of long lines."""
    if len(text) > _WIDE:
        return xxhash.xxh64_intdigest(text, 42)
    return int((_codes(text) * _POWERS[: len(text)]).sum(dtype=np.uint64))


def _line_keys(lines: list[str], edits: int, each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All lines' keys, their roles, and how many each line has: a segment's hash is a difference of two sums over its line's beginnings."""
    plans = [_plan(len(x), edits, each) for x in lines]
    times = np.array([p.shape[1] for p in plans], np.int64)
    plan = np.concatenate(plans, axis=1) if plans else np.zeros((4, 0), np.int64)
    lengths = np.array([len(x) for x in lines], np.int64)
    short = lengths <= _WIDE
    inner = np.where(short, lengths, 0)
    starts = np.cumsum(inner) - inner
    place = np.arange(int(inner.sum())) - np.repeat(starts, inner)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_codes("".join(x for x in lines if len(x) <= _WIDE)) * _POWERS[place], dtype=np.uint64)])
    whole, base = np.repeat(short, times), np.repeat(starts, times)
    begin, end = (np.where(whole, x, 0) for x in plan[:2])
    x = (sums[base + end] - sums[base + begin]) * _INVERSES[begin]
    if not whole.all():
        whose = np.repeat(np.arange(len(lines)), times)
        for i in np.flatnonzero(~whole).tolist():
            x[i] = _long_hash(lines[whose[i]][plan[0, i] : plan[1, i]])
    return _mixed(x ^ _mixed(plan[2].astype(np.uint64) + np.uint64(1))), plan[3], times


def keys(line: str, edits: int = EDITS, each: int = EACH) -> tuple[list[int], list[int]]:
    """The keys that a line is filed under, and those that it looks up."""
    k, role, _ = _line_keys([line], edits, each)
    return k[(role & 1) > 0].tolist(), k[(role & 2) > 0].tolist()


def bags(lines: list[str]) -> np.ndarray:
    """For each line the counts of its characters in 15 classes, modulo 16, four bits each; the lowest four bits are free."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = _codes("".join(lines))
    # the multiplication spreads neighbouring characters over the classes
    of = ((codes * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(15) + 1
    counts = np.bincount(np.repeat(np.arange(len(lines)) * 16, lengths) + of, minlength=16 * len(lines)).reshape(-1, 16) & 15
    return (counts.astype(np.uint64) << (4 * np.arange(16, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def _nibbles(bags: np.ndarray) -> np.ndarray:
    return ((bags.view(np.uint64)[:, None] >> (4 * np.arange(16, dtype=np.uint64))) & np.uint64(15)).astype(np.int8)


def _far(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Lower bounds of edits: an edit moves the counts by two at most in all."""
    d = np.abs(many - one)
    return np.minimum(d, 16 - d).sum(axis=1, dtype=np.int32)


def within(a: str, b: str, tau: int) -> bool:
    """Whether the edit distance is at most tau: banded and bit-parallel, on what common ends leave."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > tau:
        return False
    if a == b:
        return True
    low, high = 0, len(b)  # the common beginning, by bisection
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, len(b)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if len(a) <= tau or not b:
        return len(a) <= tau
    # Bit k of a column's word is the cell of a's character j + k - tau. Differences down a column
    # are +1 where `up` is set and -1 where `down` is.
    width = 2 * tau + 1
    every, top = (1 << width) - 1, 1 << (2 * tau)
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << (i + tau)
    up, down, distance = every ^ ((1 << tau) - 1), 0, tau
    edge, most = top >> 1, 2 * tau + len(b) - len(a)
    for j, ch in enumerate(b):
        same = (at.get(ch, 0) >> j) & every
        diagonal = ((((same & up) + up) ^ up) | same | down) & every
        right_up = (down | ~(diagonal | up)) & every
        right_down = diagonal & up
        if j < len(a) - tau:
            distance += not diagonal & top
        else:
            distance += bool(right_up & edge) - bool(right_down & edge)
            edge >>= 1
        if distance > most:
            return False
        moved = diagonal >> 1
        up = (right_down | ~(moved | right_up)) & every
        down = moved & right_up
    return distance <= tau


def _forest(lines: list[str], label: np.ndarray, edits: int, each: int) -> Iterator[tuple[int, int]]:
    """Links, as pairs of places, that join what all links by edits of characters join, but for what the labels say is joined."""
    counts, label = _nibbles(bags(lines)), label.copy()
    lengths = np.array([len(x) for x in lines])
    for i in range(len(lines)):
        if not (tau := allowed(int(lengths[i]), edits, each)):
            continue
        places = np.flatnonzero((label != label[i]) & (lengths <= lengths[i]) & (lengths >= lengths[i] - tau))
        places = places[_far(counts[i], counts[places]) <= 2 * tau]
        for j in places.tolist():
            if label[j] != label[i] and within(lines[i], lines[j], tau):
                yield i, j
                label[label == label[j]] = label[i]


def _word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """The words' hashes; `known` keeps those of words that come again."""
    if len(known) > _SEEN:
        known.clear()
    of = xxhash.xxh64_intdigest
    return np.fromiter((known[w] if w in known else known.setdefault(w, of(w, 42)) for w in words), np.uint64, len(words))


#: characters that part words: those of one byte, and all others
_SPACE, _FAR_SPACE = np.array([chr(i).isspace() and i < 128 for i in range(256)]), [chr(i) for i in range(128, 0x3001) if chr(i).isspace()]


def _pieces(lines: list[str]) -> Iterator[str]:
    """The lines, each with its end, joined to pieces of about `_LOT` characters that end between words."""
    held, n = [], 0
    for line in lines:
        at = 0
        while len(line) - at > _LOT and (end := _BLANK.search(line, at + _LOT)):
            held.append(line[at : end.start() + 1])
            yield "".join(held)
            held, n, at = [], 0, end.start() + 1
        held.append(line[at:] + "\n")
        n += len(line) - at + 1
        if n > _LOT:
            yield "".join(held)
            held, n = [], 0
    if held:
        yield "".join(held)


def _word_sum(word: np.ndarray) -> int:
    """As `_words` sums a word's bytes, for words longer than a piece."""
    return sum(int((word[i : i + _LOT] * _POWERS[: len(word[i : i + _LOT])]).sum(dtype=np.uint64)) * pow(_BASE, i, 1 << 64) for i in range(0, len(word), _LOT)) % (1 << 64)


def _words(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of lines, as `str.split` cuts them, and how many each line has."""
    hashes, counts, open_ = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for piece in _pieces(lines):
        if not piece.isascii():
            for x in _FAR_SPACE:
                piece = piece.replace(x, " ")
        codes = np.frombuffer(piece.encode("utf-8", "surrogatepass"), np.uint8)
        space = np.concatenate([[True], _SPACE[codes], [True]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        begin, end = edges[::2], edges[1::2]
        if len(codes) < len(_POWERS):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * _POWERS[: len(codes)], dtype=np.uint64)])
            hashes.append(_mixed((sums[end] - sums[begin]) * _INVERSES[begin]))
        else:
            hashes.append(_mixed(np.array([_word_sum(codes[i:j]) for i, j in zip(begin.tolist(), end.tolist(), strict=True)], np.uint64)))
        # a line may go on from the piece before
        before = np.searchsorted(begin, np.flatnonzero(codes == 10))
        counts.append(np.diff(before, prepend=-open_))
        open_ = len(begin) - int(before[-1]) if len(before) else open_ + len(begin)
    return np.concatenate(hashes), np.concatenate(counts)


def _apart(at: np.ndarray, whose: np.ndarray, lines: np.ndarray, enough: np.ndarray) -> np.ndarray:
    """Which of `lines` have at least `enough` runs of GRAM words, beginning at the sorted places `at`, that don't overlap."""
    count = np.zeros(len(lines), np.int64)
    i = np.searchsorted(whose, lines)
    stop = np.searchsorted(whose, lines, "right")
    after = np.searchsorted(at, at + GRAM)
    going = np.flatnonzero(i < stop)
    while len(going):  # the next one that begins behind the last one's end: no choice has more
        count[going] += 1
        going = going[count[going] < enough[going]]
        i[going] = after[i[going]]
        going = going[i[going] < stop[going]]
    return count >= enough


def _grams(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places and hashes of all runs of GRAM words within passages, given their words' hashes."""
    x, ends, inner = h, np.cumsum(n), np.ones(len(h), bool)
    for i in range(1, GRAM):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.roll(h, -i)
        inner[ends - i] = False
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero(inner)
    return at, (x ^ (x >> np.uint64(29)))[at]


def passage_keys(h: np.ndarray, n: np.ndarray, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The keys of passages, given all their words' hashes and how many words each has, and whose key each is. `often`: a sieve of the runs that come last."""
    at, x = _grams(h, n)
    of = np.repeat(np.arange(len(n)), n)[at]
    last = np.uint64(0)
    if often is not None:
        place = x.view(np.int64) % SIEVE
        last = (often.view(np.uint64)[place // 64] >> (place % 64).astype(np.uint64)) << np.uint64(63)
    x = x >> np.uint64(1) | last
    # the longest partner has n * PART / (PART - 1) words
    enough, found, left, share = n // (PART - 1) + 1, [], np.ones(len(n), bool), 0.5 / (PART - GRAM)
    while left.any():
        low, lines = np.flatnonzero(x <= np.uint64(share * 2**64)) if share < 1 else np.arange(len(x)), np.flatnonzero(left)
        done = np.zeros(len(n), bool)
        done[lines[_apart(at[low], of[low], lines, enough[lines])] if share < 1 else lines] = True
        taken = low[done[of[low]]]
        found.append((x[taken], of[taken]))
        left &= ~done
        rest = left[of]
        at, x, of, share = at[rest], x[rest], of[rest], share * 1.25
    x, of = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((x, of))
    x, of = x[order], of[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (of[1:] != of[:-1])])
    return x[new], of[new]


def _word_bags(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """As in `bags`, of the words of passages."""
    place = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(15)
    counts = np.bincount(np.repeat(np.arange(len(n)) * 16, n) + place.astype(np.int64) + 1, minlength=16 * len(n)).reshape(-1, 16) & 15
    return (counts.astype(np.uint64) << (4 * np.arange(16, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def _different(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[dict[int, str]]:
    """Lines of at least `least` characters by their hashes, some texts' at a time; a task says a line once as far as it remembers."""
    seen: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            new = {xxhash.xxh64_intdigest(line, 42): line for text in batch.column(0).slice(at, 200).to_pylist() for line in text.split("\n") if len(line) >= least}
            for h in seen.intersection(new):
                del new[h]
            if new:
                seen = set() if len(seen) > _SEEN else seen
                seen.update(new)
                yield new


def _worded(new: dict[int, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of different lines: the hashes of the passages, of all their words, and how many each has; and which lines no edits of characters need be looked for."""
    own, lines = np.fromiter(new, np.uint64, len(new)), list(new.values())
    may = np.flatnonzero(np.fromiter(map(len, lines), np.int64, len(lines)) >= 2 * PASSAGE - 1)
    of, n = _words([lines[i] for i in may.tolist()])
    enough = n >= PASSAGE
    counts = np.zeros(len(lines), np.int64)
    counts[may] = n
    return own[may[enough]], of[np.repeat(enough, n)], n[enough], counts


def _dealt(rows: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows dealt by their keys into `parts`: a row of bytes for each part."""
    part = (rows["k"].view(np.uint64) if rows.dtype.names else rows) % np.uint64(parts)
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    part, rows = part[order], rows[order]
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    at = np.append(starts, len(rows)).astype(np.int32) * np.int32(rows.itemsize)
    data = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(rows.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), data], names=["part", "data"])


def _parts(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
    """Each part's rows, in the pieces that `_dealt` made of them; batches come sorted by part."""
    pieces = ((part, np.frombuffer(data.as_buffer(), dtype).copy()) for batch in batches for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
    for part, found in itertools.groupby(pieces, lambda x: x[0]):
        yield part, (rows for _, rows in found)


def _often(texts: DataFrame, count: int) -> np.ndarray:
    """A sieve of the runs of words that `OFTEN` passages of a sample hold. It only says which come last, for all passages alike, so no link depends on it."""

    parts = shuffle_parts(texts.sparkSession)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for new in _different(batches, 2 * PASSAGE - 1):
            _, of, words, _ = _worded(new)
            if len(words):
                held.append(_grams(of, words)[1])
                n += len(held[-1])
            if n > 2 * HELD:
                yield _dealt(np.concatenate(held), parts)
                held, n = [], 0
        if n:
            yield _dealt(np.concatenate(held), parts)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _parts(batches, np.dtype("<u8")):
            x, times = np.unique(np.concatenate(list(found)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x[times >= OFTEN].view(np.int64))], names=["h"])

    one_in = count // SAMPLE
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0) if one_in > 1 else texts
    return sieve(some.mapInArrow(told, "part int, data binary").repartition("part").sortWithinPartitions("part").mapInArrow(counted, "h bigint"))


def _rows(k: np.ndarray, h: np.ndarray, bag: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows of keys; passages' are odd, lines' even."""
    k = k & ~np.uint64(1) | (n > 0)
    out = np.empty(len(k), _ROW)
    out["k"], out["h"], out["bag"], out["n"] = k.view(np.int64), h.view(np.int64), bag.view(np.int64), n
    return out


def _passage_rows(own: np.ndarray, of: np.ndarray, n: np.ndarray, often: np.ndarray | None) -> np.ndarray:
    k, whose = passage_keys(of, n, often)
    return _rows(k, own[whose], _word_bags(of, n)[whose], n[whose])


def _line_rows(lines: dict[int, str], edits: int, each: int) -> np.ndarray:
    k, role, times = _line_keys(list(lines.values()), edits, each)
    some = list(lines.values())
    length = np.repeat(np.fromiter(map(len, some), np.int64, len(some)), times)
    return _rows(k, np.repeat(np.fromiter(lines, np.uint64, len(some)), times), np.repeat(bags(some), times) | role.astype(np.uint64), -length)


def _passages(texts: DataFrame) -> DataFrame:
    """k, h, bag, n (words) of each passage."""
    often = _often(texts, texts.count())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for new in _different(batches, 2 * PASSAGE - 1):
            own, of, n, _ = _worded(new)
            if len(n):
                found = _passage_rows(own, of, n, often)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[c])) for c in _ROW.names], names=list(_ROW.names))

    return texts.mapInArrow(rows, "k bigint, h bigint, bag bigint, n int")


def _covered(edits: int) -> int:
    """Words from which on a line's partners by edits of characters are all passages that link by words: such an edit changes two words at most."""
    return max(2 * edits * PART, PASSAGE + 2 * edits)


def _filed(texts: DataFrame, edits: int, each: int, kinds: str) -> DataFrame:
    """part, data: the rows k, h, bag, n of all lines and passages, many to a row, dealt by k.

    n is a passage's words, or a line's characters below zero; a line's bag has its role under k in the lowest bits.
    """
    count, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    often = _often(texts, count) if "passages" in kinds else None
    tasks = 1 + size // TASK_BYTES
    parts = max(shuffle_parts(texts.sparkSession), 4 * tasks)
    least = max(1, each - edits) if "lines" in kinds else 2 * PASSAGE - 1
    covered = _covered(edits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, passages, n_words = [], 0, [], 0
        for new in itertools.chain(_different(batches, least), [None]):
            if n_words > HELD or passages and new is None:
                held.append(_passage_rows(*map(np.concatenate, zip(*passages, strict=True)), often))
                n += len(held[-1])
                passages, n_words = [], 0
            if new is None:
                break
            own, of, words, counts = _worded(new)
            if "passages" in kinds and len(words):
                passages.append((own, of, words))
                n_words += len(of)
            if "lines" in kinds:
                held.append(_line_rows({h: x for (h, x), c in zip(new.items(), counts.tolist(), strict=True) if c < covered}, edits, each))
                n += len(held[-1])
            if n > HELD:
                yield _dealt(np.concatenate(held), parts)
                held, n = [], 0
        if n:
            yield _dealt(np.concatenate(held), parts)

    return texts.mapInArrow(rows, "part int, data binary").repartition(tasks, "part")


def _near(edits: int, each: int, most: int):
    """Of the rows under a key those that have a partner by their counts: pairs u, v under few rows, else k, u and v, the one with most partners.

    Rows come as `_filed` deals them, a part's one behind the other.
    """

    def said(k: np.ndarray | None, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()) if k is None else pa.array(k), pa.array(u), pa.array(v)], names=["k", "u", "v"])

    def near(a: np.ndarray, b: np.ndarray, n: np.ndarray, role: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Which of the pairs of places may be linked."""
        longer, apart = np.maximum(np.abs(n[a]), np.abs(n[b])), np.abs(n[a] - n[b])
        t = np.where(n[a] > 0, longer // PART, np.minimum(edits, longer // each))
        # a line meets one that it looks up; of two lines the longer one does
        met = (n[a] > 0) | ((role[a] & 1) & (role[b] >> 1) | (role[a] >> 1) & (role[b] & 1) > 0)
        may = np.flatnonzero((apart <= t) & ((n[a] > 0) == (n[b] > 0)) & met)
        gap = np.abs(of[a[may]] - of[b[may]])
        return may[np.minimum(gap, 16 - gap).sum(axis=1, dtype=np.int32) <= 2 * t[may]]

    def picked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        k = rows["k"]
        order = np.argsort(k)
        k = k[order]
        again = np.concatenate([[False], k[1:] == k[:-1], [False]])
        rows = rows[order[again[1:] | again[:-1]]]
        if not len(rows):
            return
        rows = rows[np.lexsort((rows["h"], rows["k"]))]
        k, h, bag, n = (np.ascontiguousarray(rows[c]) for c in _ROW.names)
        one = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])]))
        role = np.bitwise_or.reduceat(bag & 15, one)
        k, h, n, of = k[one], h[one], n[one].astype(np.int64), _nibbles(bag[one])[:, 1:]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(starts, len(k)))
        few, partners = np.repeat(size <= PAIRS, size), np.zeros(len(k), np.int64)
        i, d, pairs = np.arange(len(k) - 1), 1, []
        while len(i := i[i + d < len(k)]) and len(i := i[k[i] == k[i + d]]):  # each row with the d-th after it
            both = i[near(i, i + d, n, role, of)]
            pairs.append(np.stack([h[both], h[both + d]])[:, few[both]])
            partners[both] += 1  # no place twice among them
            partners[both + d] += 1
            d += 1
        if pairs and (both := np.unique(np.concatenate(pairs, axis=1), axis=1)).size:
            yield said(None, both[0], both[1])
        if (keep := (partners > 0) & ~few).any():
            run = np.repeat(np.arange(len(starts)), size)
            best = np.lexsort((h, -partners, run))[starts]
            yield said(k[keep], h[keep], h[best][run][keep])

    def without_hot(all_: np.ndarray, hot: dict[int, int]) -> tuple[np.ndarray, list[pa.RecordBatch]]:
        """Keys with so many lines that most have a partner go on as they are, now and later; comparison looks at the counts again."""
        k, at, times = np.unique(all_["k"], return_index=True, return_counts=True)
        for i in np.flatnonzero(times > 16 * most).tolist():
            hot.setdefault(int(k[i]), int(all_["h"][at[i]]))
        out = []
        for x, v in hot.items():
            if (of := all_["k"] == x).any():
                u = np.unique(np.append(all_["h"][of], v))
                out.append(said(np.full(len(u), x), u, np.full(len(u), v)))
                all_ = all_[~of]
        return all_, out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _parts(batches, _ROW):
            held, n, limit, hot = [], 0, 4 * HELD, {}
            for piece in found:
                held.append(piece)
                n += len(piece)
                if n > limit:
                    all_, out = without_hot(np.concatenate(held), hot)
                    yield from out
                    held, n = [all_], len(all_)
                    limit = max(limit, 2 * n)
            all_, out = without_hot(np.concatenate(held), hot) if hot else (np.concatenate(held), [])
            yield from out
            yield from picked(all_)

    return rows


class _Words:
    """Lines with a character for each word, so that edits of words are edits of characters."""

    def __init__(self):
        self.code: dict[str, str] = {}

    def said(self, line: str) -> str:
        code = self.code
        return "".join(code[w] if w in code else code.setdefault(w, chr(len(code))) for w in line.split())

    def passage(self, line: str) -> str:
        """As `said`; empty if the line is no passage."""
        return said if len(line) >= 2 * PASSAGE - 1 and len(said := self.said(line)) >= PASSAGE else ""

    def centre(self, line: str) -> tuple[str, str]:
        """A line that others will be compared with, and as `passage`; all others before it are done with."""
        if len(self.code) > 500_000:
            self.code.clear()
        return line, self.passage(line)


def _passage_forest(lines: list[str], label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links, as pairs of places, that join what all links between passages join, but for what the labels say is joined."""
    known: dict[str, int] = {}
    words, parts, label = _Words(), [x.split() for x in lines], label.copy()
    said = [words.said(x) for x in lines]
    lengths = np.array([len(p) for p in parts])
    classes = np.repeat(np.arange(len(lines)) * 256, lengths) + (_word_hashes([w for p in parts for w in p], known) & np.uint64(255)).astype(np.int64)
    # fewer than there are only make passages look nearer
    counts = np.minimum(np.bincount(classes, minlength=256 * len(lines)), 1 << 14).astype(np.int16).reshape(-1, 256)
    for i in range(len(lines) - 1):
        t = np.maximum(lengths[i], lengths[i + 1 :]) // PART
        places = np.flatnonzero((label[i + 1 :] != label[i]) & (np.abs(lengths[i] - lengths[i + 1 :]) <= t))
        places = places[np.abs(counts[i + 1 + places] - counts[i]).sum(axis=1, dtype=np.int32) <= 2 * t[places]]
        for j in (places + i + 1).tolist():
            if label[j] != label[i] and within(said[i], said[j], int(max(lengths[i], lengths[j])) // PART):
                yield i, j
                label[label == label[j]] = label[i]


def _texts_of(texts: DataFrame, hashes: DataFrame, least: int) -> DataFrame:
    """h, line of the lines with these hashes. Lines that a sieve can rule out aren't shuffled."""
    bits = sieve(hashes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                lines = list({x for t in batch.column(0).slice(at, 200).to_pylist() for x in t.split("\n") if len(x) >= least})
                h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in lines), np.uint64, len(lines))
                place = h.view(np.int64) % SIEVE
                may = np.flatnonzero((bits[place // 64] >> (place % 64)) & 1)
                if len(may):
                    yield pa.RecordBatch.from_arrays([pa.array(h[may].view(np.int64)), pa.array([lines[i] for i in may.tolist()], pa.string())], names=["h", "line"])

    return texts.mapInArrow(rows, "h bigint, line string").join(hashes, "h", "left_semi").dropDuplicates(["h"])


def _linked(docs: DataFrame, edits: int, each: int, most: int, text_col: str, kinds: str) -> DataFrame:
    texts = docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text"))
    found = _filed(texts, edits, each, kinds).sortWithinPartitions("part").mapInArrow(_near(edits, each, most), "k bigint, u bigint, v bigint")
    found = written(found.distinct(), "near")
    # a pair's lines, and all lines of keys of many
    held = written(_texts_of(texts, found.select("u").unionAll(found.select("v")).select(F.col("u").alias("h")).distinct(), max(1, each - edits)), "held")
    words = _Words()

    def same(centre: tuple[str, str], line: str) -> bool:
        one, a = centre
        t = allowed(max(len(one), len(line)), edits, each) if "lines" in kinds and len(a) < _covered(edits) else 0
        if t and abs(len(one) - len(line)) <= t and within(one, line, t):
            return True
        b = words.passage(line) if "passages" in kinds and a else ""
        return bool(b) and within(a, b, max(len(a), len(b)) // PART)

    def forest(data: list[str], label: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
        return _passage_forest(data, label) if k & 1 else _forest(data, label, edits, each)

    return joined(found, held.select(F.col("h").alias("id"), F.col("line").alias("data")), most, words.centre, same, forest, keyed=True)


def links(docs: DataFrame, edits: int = EDITS, each: int = EACH, most: int = MOST, text_col: str = "text") -> DataFrame:
    """u, v: hashes of lines, links that join what all links by edits of characters would join, but for long passages, which `passage_links` joins."""
    return _linked(docs, edits, each, most, text_col, "lines")


def passage_links(docs: DataFrame, most: int = MOST, text_col: str = "text") -> DataFrame:
    """u, v: hashes of passages, links that join what all links of passages would join."""
    return _linked(docs, EDITS, EACH, most, text_col, "passages")


def _lines(docs: DataFrame, edits: int, each: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each line: doc_id, row (a hash of id and text), line, n_chars, blank, h, class_id, first (none, doc_id, row, line)."""
    bounded_batches(docs.sparkSession)
    narrow = id_and_text(docs, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # in order, so that the first of a batch's equal lines has the others behind it
            batch = batch.take(pc.sort_indices(batch, [("doc_id", "ascending"), ("row", "ascending")], null_placement="at_end"))
            texts = [t.split("\n") for t in batch.column(2).to_pylist()]
            all_ = [x for t in texts for x in t]
            n = np.fromiter(map(len, texts), np.int64, len(texts))
            whose = np.repeat(np.arange(len(texts)), n)
            line = (np.arange(len(all_)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in all_), np.uint64, len(all_))
            length = np.fromiter(map(len, all_), np.int64, len(all_))
            order = np.lexsort((length, h))
            new = np.concatenate([[True], (h[order[1:]] != h[order[:-1]]) | (length[order[1:]] != length[order[:-1]])])[: len(order)]
            one, more = order[new], order[~new]
            place = lambda at: [batch.column(0).take(pa.array(whose[at])), batch.column(1).take(pa.array(whose[at])), pa.array(line[at])]  # noqa: E731,B023
            stops = np.cumsum(~new)[np.append(np.flatnonzero(new)[1:], len(new)) - 1] if len(new) else np.zeros(0, np.int64)
            others = pa.ListArray.from_arrays(pa.array(np.append(0, stops).astype(np.int32)), pa.StructArray.from_arrays(place(more), ["doc_id", "row", "line"]), mask=pa.array(np.diff(stops, prepend=0) == 0))
            blank = pa.array([not all_[i] or not all_[i].strip(" \t\r") for i in one.tolist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*place(one), pa.array(h[one].view(np.int64)), pa.array(length[one]), blank, others], names=["doc_id", "row", "line", "h", "n_chars", "blank", "others"])

    rows = narrow.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    at = [narrow.schema["doc_id"], StructField("row", LongType()), StructField("line", IntegerType())]
    lines = rows.mapInArrow(cut, StructType([*at, StructField("h", LongType()), StructField("n_chars", LongType()), StructField("blank", BooleanType()), StructField("others", ArrayType(StructType(at)))]))
    roots = components(_linked(docs, edits, each, MOST, text_col, "lines and passages")).select(F.col("node").alias("h"), "root")
    roots = roots.unionByName(roots.select(F.col("root").alias("h"), "root").distinct())
    # one shuffle of different lines of batches: each finds the first of its equals (ids that are null come last), and its class if it has others
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line")
    equal = Window.partitionBy("h", "n_chars").orderBy(F.col("doc_id").isNull(), "doc_id", "row", "line")
    all_ = written(lines.repartition("h").withColumn("first", F.first(place).over(equal)).join(roots, "h", "left"), "lines")
    all_ = all_.drop("others").unionByName(all_.filter("others is not null").select("h", "n_chars", "blank", "first", "root", F.inline("others")))
    # equal hashes of different lengths that no link joins are classes of their own
    alone, linked = all_.filter("root is null").withColumn("root", F.col("h")), all_.filter("root is not null")
    firsts = linked.groupBy("root").agg(F.min("first").alias("first"))
    return alone.unionByName(linked.drop("first").join(firsts, "root")).withColumnRenamed("root", "class_id")


def classes(docs: DataFrame, edits: int = EDITS, each: int = EACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line: doc_id, line (from 0), n_chars, h, class_id (a hash), first_doc_id, first_line (the class's first line)."""
    return _lines(docs, edits, each, id_col, text_col).select("doc_id", "line", "n_chars", "h", "class_id", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line").alias("first_line"))


def deduplicated(docs: DataFrame, edits: int = EDITS, each: int = EACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs`, of each class of lines only the first left in the texts.

    Blank lines all stay, and so does every document, if need be with an empty text. Rows that repeat id and text are treated alike.
    """
    first = F.col("first")
    gone = _lines(docs, edits, each, id_col, text_col).filter(~F.col("blank") & ((F.col("row") != first["row"]) | (F.col("line") != first["line"])))
    gone = gone.groupBy("doc_id", "row").agg(F.collect_set("line").alias("gone")).withColumnRenamed("row", "gone_row")
    # the given columns stay apart in one of their own, so that no name can clash
    own = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("given"), docs[id_col].alias("id"), F.xxhash64(docs[id_col], F.coalesce(docs[text_col], F.lit(""))).alias("row"))
    both = own.join(gone, (F.col("row") == F.col("gone_row")) & F.col("id").eqNullSafe(F.col("doc_id")), "left").select("given", "gone")
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts = zip(columns[at].to_pylist(), batch.column(1).to_pylist(), strict=True)
            columns[at] = pa.array(["\n".join(x for i, x in enumerate(t.split("\n")) if i not in out) if out else t for t, g in texts for out in [frozenset(g or ())]], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in batch.schema.field(0).type])

    return both.mapInArrow(cut, docs.schema)
