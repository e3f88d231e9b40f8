"""SimHash near-duplicates by pigeonhole blocks.

A document's fingerprint has a bit for each bit of its shingles' 64-bit hashes:
1 if set in over half of them. Two fingerprints that differ in at most `radius`
bits agree in at least `blocks - radius` of `blocks` blocks, so each is filed
under every choice of that many blocks (6 blocks, radius 3: 20 keys of about 32
bits, so keys stay selective with billions of documents). Documents of one
fingerprint are one row from there on. Fingerprints under one key are compared
with each other, and a spanning forest of those that link goes on to
`components`: links that add nothing to the components are not written.

A key with more than `most` fingerprints is split: its rows are dealt by hash
into parts, and each pair of parts is compared on its own, which loses no pair.

`copies` finds near-copies by similarity of word shingles instead: five words,
a Jaccard similarity of 0.8 or more, exactly. Two texts of a and b different
shingles that are so similar differ in at most D = (a + b) / 9 of them. So a
fingerprint is made of D + 1 words: shingles are dealt by hash into so many
classes, and each class's SimHash is a word. At most D words differ, hence one at
least agrees: the pigeonhole rule, with words as blocks, and all blocks are
joined on. (An empty class is no block. That all agreeing classes are empty has
a chance under one in a million: D + 16 classes are taken where D is small, and
texts of under nine shingles have each as a class.) D depends on the level of a
text's length, levels growing by half; a text near a level's end is filed under
the next one too.

Pairs are compared by the Hamming distance of 128-bit SimHashes, with a bound that
no pair of 0.8 exceeds but for one in many millions, and then by their whole sets.

1. Each text is compared with the first one under each of its keys. That joins
   most groups, and what follows leaves out keys whose texts it has joined.
2. Keys of few texts name their other pairs, each of which is compared once.
3. Under a key of many texts that still aren't joined, texts are compared in
   cells, as above; a pair of one component isn't compared again.

Defined cases: a null or blank text has no words and fingerprint zero, linked
like any other; texts of fewer words than a shingle have their whole sequence
as one; repeated rows give repeated results; null ids stay, and count for a
component's smallest id only if it has no other; an empty table gives no rows;
other columns are ignored, or returned as they are, whatever their names. Whole
texts are read, in blocks of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import PAIRS, SIEVE, alike, bounded_batches, cells, discard, id_and_text, runs, sieve, written
from siftline.llm.components import components

_BLOCK = 1 << 16
#: most sets of shingles that a task remembers
_SEEN = 1_000_000
#: texts of fewer shingles than this have each as a class; the next levels are longer by half each
LEAST_LEVEL = 9
#: most bits of 128 in which near-copies differ: at 0.8 they differ in 19.4 with a deviation of 4.1 (24 and 4.4 for 4 against 5 shingles)
APART = 48


def shingle_hashes(text: str, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """The unsigned XXH64 of each shingle, in blocks. Lower case for A-Z only; words are what ASCII white space separates."""
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return
    joined, of = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        yield np.array([of(joined, seed)], np.uint64)
        return
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = lengths.cumsum() - 1
    starts = ends - lengths + 1
    for at in range(0, len(parts) - words + 1, _BLOCK):
        a, b = starts[at : min(at + _BLOCK, len(parts) - words + 1)].tolist(), ends[at + words - 1 : at + _BLOCK + words - 1].tolist()
        yield np.array([of(joined[x:y], seed) for x, y in zip(a, b, strict=True)], np.uint64)


def fingerprint(text: str, words: int = 3) -> int:
    """As a signed 64-bit number."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, fp (bigint)."""
    bounded_batches(docs.sparkSession)
    narrow = id_and_text(docs, id_col, text_col)

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return narrow.mapInArrow(printed, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp bigint")


def block_keys(fps: np.ndarray, radius: int, blocks: int) -> Iterator[np.ndarray]:
    """For each choice of blocks a key of each fingerprint; the choice's number is mixed in."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    unsigned = fps.view(np.uint64)
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        x = (unsigned & np.uint64(mask)) + np.uint64((number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # a bijection, so keys meet only if masked bits do, or a number's sum does
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        yield (x ^ (x >> np.uint64(31))).view(np.int64)


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among `fps`, as pairs of places."""
    n, out = len(fps), []
    label, x = np.arange(n), fps.view(np.uint64)
    for i in range(n - 1):
        near = np.flatnonzero((np.bitwise_count(x[i] ^ x[i + 1 :]) <= radius) & (label[i + 1 :] != label[i])) + i + 1
        for j in near.tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def links(fps: DataFrame, radius: int = 3, blocks: int = 6, most: int = 4096) -> DataFrame:
    """`fps`: distinct fingerprints (column fp). Returns u, v: links that join what all links would join."""

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for keys in block_keys(fp, radius, blocks):
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0)], names=["k", "fp"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, fp in runs(batches, 2):
            if pairs := forest(fp, radius):
                at = np.array(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(fp[at[:, 0]]), pa.array(fp[at[:, 1]])], names=["u", "v"])

    keys = written(fps.select("fp").mapInArrow(filed, "k bigint, fp bigint"), "blocks")
    sorted_cells = cells(keys, "fp", most).select("k", "cell", "fp").repartition("k", "cell").sortWithinPartitions("k", "cell", "fp")
    return sorted_cells.mapInArrow(compared, "u bigint, v bigint")


def clusters(docs: DataFrame, words: int = 3, radius: int = 3, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, fp, component_id (the smallest doc_id that links reach)."""
    printed = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    # copies of a text are one row from here on, so no group of copies is ever one task's
    classes = written(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes, radius, blocks)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return printed.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th 64-bit hash derived from each of `h`."""
    x = h + np.uint64((n + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majorities(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The SimHash of each run of hashes."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    n = np.diff(np.append(starts, len(h)))
    return np.packbits(ones * 2 > n[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """The different hashes of a text's shingles, sorted."""
    parts = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    short, long = sorted((a, b), key=len)
    both = int((long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum())
    return both / (len(a) + len(b) - both)


def levels(n: int, similarity: float) -> list[tuple[int, int]]:
    """(level, classes) that a text of n shingles is filed under; no classes: each shingle is one."""
    out, level, end = [], 0, LEAST_LEVEL
    while len(out) < 2:
        if n < end:
            apart = int(2 * (end - 1) * (1 - similarity) / (1 + similarity) + 1e-9)
            out.append((level, (apart + (1 if apart >= 12 else 16)) if level else 0))
            if int(n / similarity + 1e-9) < end:
                break
        level, end = level + 1, -(-end * 3 // 2)
    return out


def wide_blocks(h: np.ndarray, similarity: float = 0.8) -> np.ndarray:
    """The keys of the blocks of a set of shingles' hashes."""
    out = []
    for level, classes in levels(len(h), similarity):
        if not classes:
            out.append(_mixed(h, 100 + level))
            continue
        of = _mixed(h, 99) % np.uint64(classes)
        order = np.argsort(of, kind="stable")
        of = of[order]
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        out.append(_mixed(_majorities(h[order], starts) ^ _mixed(of[starts], 98), 100 + level))
    return np.concatenate(out)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (k, fp) sorted by both, those whose key others share, each once: k, u (the key's first), v. Holds a batch and a row."""
    held = first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if held is not None:
            k, fp = np.append(held[0], k), np.append(held[1], fp)
        new = np.append(True, (k[1:] != k[:-1]) | (fp[1:] != fp[:-1]))
        k, fp = k[new], fp[new]
        same = np.append(held is not None and held[2], k[1:] == k[:-1])  # as the row before
        place = np.maximum.accumulate(np.where(same, 0, np.arange(len(k))))
        u = fp[place]
        if same[0]:
            u[place == 0] = first
        keep = same[:-1] | same[1:]  # the last row waits for the next batch
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]) for x in (k, u, fp)], names=["k", "u", "v"])
        held, first = (k[-1:], fp[-1:], bool(same[-1])), u[-1]
    if held is not None and held[2]:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (held[0], np.array([first]), held[1])], names=["k", "u", "v"])


def _compared(left: DataFrame, of: DataFrame, sets: DataFrame, roots: DataFrame, joined, similarity: float, most: int, near, set_of) -> DataFrame:
    """Steps 2 and 3 of `copies`: the components after them."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs u, v of few texts, and of many texts those that have a partner (v null)."""
        for k, _, fp, c, size, p, q in runs(batches, 2):
            x, found, few = np.stack([p, q], axis=1).view(np.uint64), [], len(fp) <= PAIRS
            keep = np.zeros(len(fp), bool)
            for i in range(len(fp) - 1):
                j = np.flatnonzero(_may(x[i], x[i + 1 :], size[i], size[i + 1 :], similarity) & (c[i + 1 :] != c[i])) + i + 1
                if few:
                    found += [(fp[i], y) for y in fp[j]]
                else:
                    keep[i] |= len(j) > 0
                    keep[j] = True
            if found:
                at = np.array(found)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(at[:, 0]), pa.array(at[:, 1])], names=["k", "u", "v"])
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(fp[keep]), pa.nulls(int(keep.sum()), pa.int64())], names=["k", "u", "v"])

    dealt = cells(left.join(of, "fp"), "fp", most).select("k", "cell", "fp", "c", "size", "p", "q")
    found = written(dealt.repartition("k", "cell").sortWithinPartitions("k", "cell", "fp").mapInArrow(close, "k bigint, u bigint, v bigint").distinct(), "near")
    again = lambda more: components(more.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    roots = again(alike(found.filter("v is not null").select("u", "v").distinct(), sets, 4 * most, set_of, near))
    left = joined(roots, found.filter("v is null").select("k", F.col("u").alias("fp")))
    if left.isEmpty():
        return roots

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, fp, c, size, p, q, data in runs(batches, 2):
            x, own, out = np.stack([p, q], axis=1).view(np.uint64), [set_of(d) for d in data], []
            label = c.copy()
            for i in range(len(fp) - 1):
                for j in (np.flatnonzero(_may(x[i], x[i + 1 :], size[i], size[i + 1 :], similarity)) + i + 1).tolist():
                    if label[j] != label[i] and jaccard(own[i], own[j]) >= similarity:
                        out.append((fp[i], fp[j]))
                        label[label == label[j]] = label[i]
            if out:
                at = np.array(out)
                yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], names=["u", "v"])

    full = left.join(of, "fp").join(sets.withColumnRenamed("id", "fp"), "fp")
    dealt = cells(full, "fp", most, "octet_length(data)").select("k", "cell", "fp", "c", "size", "p", "q", "data")
    return again(dealt.repartition("k", "cell").sortWithinPartitions("k", "cell", "fp").mapInArrow(compared, "u bigint, v bigint"))


def copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, most: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each (id, text): row (their hash), doc_id, n (rows that repeat it), first_id and first_row (of its group of near-copies)."""
    bounded_batches(docs.sparkSession)
    narrow = id_and_text(docs, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    texts = narrow.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            own, size, prints, blocks = [], [], [], []
            for text in batch.column(2).to_pylist():
                h = shingle_set(text, words)
                own.append(xxhash.xxh64_intdigest(h.tobytes(), 7))
                size.append(len(h))
                prints.append([int(_majorities(_mixed(h, i), np.zeros(1, int))[0]) if len(h) else 0 for i in (0, 1)])
                # a task files a set once as far as it remembers, so neither copies nor all blocks need a shuffle to be told apart
                blocks.append(wide_blocks(h, similarity).view(np.int64) if len(h) and own[-1] not in seen else np.zeros(0, np.int64))
                seen = set() if len(seen) > _SEEN else seen
                seen.add(own[-1])
            p = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(np.array(own, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(blocks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "fp", "size", "p", "q", "blocks"])

    # texts of one set of shingles are one row from here on, so no group of copies is one task's
    filed = written(texts.mapInArrow(printed, f"row bigint, doc_id {kind}, fp bigint, size int, p bigint, q bigint, blocks array<bigint>"), "prints")
    all_ = written(filed.drop("blocks"), "rows")
    keys = filed.select(F.explode("blocks").alias("k"), "fp")
    shared = written(keys.repartition("k").sortWithinPartitions("k", "fp").mapInArrow(_shared, "k bigint, u bigint, v bigint"), "shared")
    discard(filed)
    single = all_.groupBy("fp").agg(F.min("row").alias("row"), F.min("size").alias("size"), F.min("p").alias("p"), F.min("q").alias("q"))
    held = written(shared.select(F.col("v").alias("fp")).distinct().join(single, "fp"), "held")

    # the sets of shingles of texts that share a key
    bits = sieve(held.select(F.col("row").alias("h")))

    def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy(zero_copy_only=False) % SIEVE
            may = batch.filter(pa.array(((bits[place // 64] >> (place % 64)) & 1).astype(bool)))
            sets = pa.array([shingle_set(t, words).tobytes() for t in may.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([may.column(0), sets], names=["row", "shingles"])

    of_rows = texts.select("row", "text").mapInArrow(sifted, "row bigint, shingles binary")
    sets = written(of_rows.join(held.select("row", "fp"), "row").groupBy(F.col("fp").alias("id")).agg(F.min("shingles").alias("data")), "sets")
    of = held.select("fp", "size", "p", "q")
    set_of = lambda data: np.frombuffer(data, np.uint64)
    near = lambda a, b: jaccard(a, set_of(b)) >= similarity

    def joined(roots: DataFrame, rows: DataFrame) -> DataFrame:
        """Of rows (k, fp) those whose key has different components, with their component c."""
        known = rows.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("k", "fp", F.coalesce("root", "fp").alias("c"))
        mixed = known.groupBy("k").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a < b").select("k")
        return written(known.join(mixed, "k"), "mixed")

    # 1. each text with the first of each of its keys
    edges = shared.select("u", "v").filter("u <> v").distinct()
    for c in ("u", "v"):
        edges = edges.join(of.select(F.col("fp").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("size", "p", "q"))), c)
    apart = F.bit_count(F.col("u_p").bitwiseXOR(F.col("v_p"))) + F.bit_count(F.col("u_q").bitwiseXOR(F.col("v_q")))
    sizes = F.least("u_size", "v_size") >= similarity * F.greatest("u_size", "v_size") - 1e-9
    roots = components(alike(edges.filter((apart <= APART) & sizes).select("u", "v"), sets, 4 * most, set_of, near))
    left = joined(roots, shared.select("k", F.col("v").alias("fp")))
    if not left.isEmpty():
        roots = _compared(left, of, sets, roots, joined, similarity, most, near, set_of)
    rows = all_.groupBy("row", "doc_id", "fp").agg(F.count(F.lit(1)).alias("n"))
    ids = all_.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    rooted = written(ids.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "groups")
    for done in (shared, held, sets):
        discard(done)
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = rooted.select("fp", "root").join(firsts, "root").select("fp", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row"))
    return rows.join(named, "fp").select("row", "doc_id", "n", "first_id", "first_row")


def _may(x: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the others can be near-copies, by Hamming distance and size."""
    apart = np.bitwise_count(x ^ others).sum(axis=1, dtype=np.int32)
    return (apart <= APART) & (np.minimum(size, sizes) >= similarity * np.maximum(size, sizes) - 1e-9)


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all columns, of each group of near-copies: that of the smallest id."""
    found = copies(docs, words, similarity, id_col=id_col, text_col=text_col).filter("row = first_row and doc_id <=> first_id")
    kept = written(found.select(F.col("row").alias("kept_row"), F.col("doc_id").alias("kept_id"), "n"), "kept")
    # the given columns stay apart in one of their own, so that no name can clash
    own = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("given"), docs[id_col].alias("id"), F.xxhash64(docs[id_col], F.coalesce(docs[text_col], F.lit(""))).alias("row"))
    same = (F.col("row") == F.col("kept_row")) & F.col("id").eqNullSafe(F.col("kept_id"))
    out = own.join(kept.filter("n = 1"), same, "left_semi").select("given.*")
    again = kept.filter("n > 1")
    if again.isEmpty():
        return out
    # rows that repeat id and text: any one of them
    return out.unionByName(own.join(again, same, "left_semi").dropDuplicates(["id", "row"]).select("given.*"))
