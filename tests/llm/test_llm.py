"""Operators of the subpackage against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from siftline.llm import bpe, images, lines, neighbours, packing, pii, sharding, simhash, tokencounts, toxicity
from siftline.llm.components import components

SF = "/root/testdata/sf0.001"
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


#: nulls, empty and long texts, ties and repeated rows, and columns named like those inside the operators
ODD = [
    (1, "", 1, "x", None, 1), (1, "", 1, "x", None, 1), (2, None, None, None, 2, None), (None, "some words here", 3, "y", 3, 3), (3, "word " * 6000, 4, "z", 4, 4), (4, "a" * 40_000, 5, "z", 5, 5),
    (5, "the same text of several words in a row", 6, "z", 6, 6), (6, "the same text of several words in a row", 6, "z", 6, 6), (6, "the same text of several words in a row", 6, "z", 6, 6),
    (7, "\n\n a@b.com\t\x1c<|endoftext|> é日本   end", 7, "z", 7, 7), (8, "!" * 9000 + "\n" + " " * 9000 + "x", 8, "z", 8, 8),
]
ODD_SCHEMA = "doc_id bigint, text string, h bigint, `__row` string, `__gone` bigint, shard int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


def packed_rightly(rows, want):
    """Each id in one piece, pieces of a sequence gapless; returns padding's share."""
    of, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, len(r.ids) // 4))
    for doc, copies in want.items():
        assert sorted(b"".join(p.ids for p in sorted(ps, key=lambda p: p.start)) for ps in runs(of[doc])) == sorted(copies)
    pad = total = 0
    for parts in seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= 2048
        total += at
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    return pad / max(1, pad + total)


def runs(pieces):
    """The pieces of a document, taken apart into its repeats."""
    out = []
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        if p.start == 0:
            out.append([])
        out[-1].append(p)
    return out


def test_packing(spark, docs, texts, odd):
    lib = Tokenizer.from_file(WORDS)
    ids = lambda t: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert packed_rightly(packing.pack(docs, WORDS).collect(), {d: [ids(t)] for d, t in texts.items()}) < 0.03
    want = defaultdict(list)
    for d, t, *_ in ODD:
        want[d].append(ids(t))
    packed_rightly(packing.pack(odd.coalesce(1), WORDS).collect(), want)
    assert packing.pack(odd.limit(0), WORDS).count() == 0


def test_packing_plan_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        ends = np.cumsum([rng.randint(1, 60) for _ in range(rng.randint(1, 30))])
        penalty = np.array([rng.choice([0, 16, 64]) for _ in ends], float)
        cuts = packing.plan(ends, penalty, 128)
        cost_of = {e: p for e, p in zip(ends.tolist(), penalty.tolist(), strict=True)}
        pad = lambda n: 0 if n in (64, 128) else 128 - n
        best = {0: 0.0}
        for e in ends.tolist():
            best[e] = min(best[s] + pad(e - s) + cost_of[e] for s in best if e - s <= 128)
        got = sum(pad(b - a) + cost_of[b] for a, b in zip([0, *cuts], cuts))
        assert got == best[ends[-1]] and cuts[-1] == ends[-1]


def test_bpe(docs, texts, odd):
    lib = Tokenizer.from_file(BYTES)
    for r in bpe.encode(docs, BYTES, leaf=512).collect():
        assert r.ids == lib.encode(texts[r.doc_id], add_special_tokens=False).ids and r.decoded == texts[r.doc_id]
    for spread in (1 << 20, 1000):  # whole, and in pieces that tasks encode apart
        got = sorted((r.doc_id or -1, r.ids) for r in bpe.encode(odd, BYTES, leaf=64, spread=spread).collect())
        assert got == sorted((d or -1, lib.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in ODD)
    one = bpe.digest(bpe.encode(odd.filter("doc_id = 7"), BYTES)).first()
    ids = lib.encode(ODD[9][1], add_special_tokens=False).ids
    assert one.n_tokens == len(ids) and one.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and one.decoded_sha256 == hashlib.sha256(ODD[9][1].encode()).hexdigest()
    assert bpe.encode(odd.limit(0), BYTES).count() == 0


def test_bpe_joins_anywhere():
    rng, lib, own = random.Random(4), Tokenizer.from_file(BYTES), bpe.ByteBPE(BYTES, 7)
    parts = ["a", "the", " ", "  ", "\n", "'s", "'", "'re", "12", "!!", "é", "日本語", "😀", "<|endoftext|>", "\xa0", "\x1c", "aaaa", "    ", "''''", "hello"]
    for _ in range(1500):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) + rng.choice(["", "a" * 150, "-" * 150, " " * 150, "".join(rng.choice("abcdefgh") for _ in range(200))])
        assert own.encode_batch([s])[0] == lib.encode(s, add_special_tokens=False).ids


def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda x: (x[1], ("email", "ip", "card", "phone").index(x[0])))


def test_pii(docs, texts, odd):
    for r in pii.pii_digest(pii.pii(docs)).collect():
        want = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in pii.BASE_KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))
    assert pii.pii(odd).count() == len(ODD) and pii.pii(odd.limit(0)).count() == 0
    masked = {r.doc_id: r.text for r in pii.masked(odd).collect()}
    assert "[EMAIL]" in masked[7] and masked[2] is None and pii.masked(odd).columns == odd.columns


def test_pii_kinds_and_context():
    found = lambda t: [k for k, *_ in pii.find_spans(t)]
    assert found("iban DE89 3704 0044 0532 0130 00.") == ["iban"] and found("iban DE89 3704 0044 0532 0130 01.") == []
    assert found("ssn 123-45-6789") == ["ssn"] and found("part no 123-45-6789") == []
    assert found("call (743) 555-3824") == ["phone_local"] and found("order (743) 555-3824") == []
    assert found("card 4111 1111 1111 1111") == ["card"] and found("card 4111 1111 1111 1112") == []
    assert pii.score("my card 1", "card", 8, 9, 50) > pii.score("my serial 1", "card", 10, 11, 50)


@pytest.mark.parametrize("iban", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606"])
@pytest.mark.parametrize("after", ["", ".", " Please pay", " BIC: X", " COBADEFF 12", " A", "\n2 x", " 7 days"])
def test_pii_iban_before_other_words(iban, after):
    text = f"pay to IBAN AB12 {iban}{after}"
    assert [(k, text[a:b]) for k, a, b, _ in pii.find_spans(text)] == [("iban", iban)]
    assert pii.mask(text, pii.find_spans(text)) == f"pay to IBAN AB12 [IBAN]{after}"
    assert not [k for k, *_ in pii.find_spans(f"IBAN {iban[:-1]}{(int(iban[-1]) + 1) % 10}{after}") if k == "iban"]


def test_pii_fuzz():
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice(["1", "23", "@", ".", "a", "-", " ", "+", "(", "é", "b.co", "1.2.3.4"]) for _ in range(rng.randint(0, 50)))
        assert sorted(pii.base_spans(t), key=lambda x: (x[1], pii.ORDER[x[0]])) == brute_base(t)


def brute_fingerprint(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes_of(items, linked):
    """Smallest member that links reach, for each item."""
    to = {x: x for x in items}

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                to[y] = x
    return {x: root(x) for x in items}


def test_simhash(spark, texts, odd):
    near = {d + 1000: t.replace("the", "thee", 1) for d, t in texts.items() if d < 60}
    df = spark.createDataFrame([*texts.items(), *near.items()], "doc_id bigint, text string")
    fp = {d: brute_fingerprint(t) for d, t in [*texts.items(), *near.items()]}
    group = classes_of(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.clusters(df).collect()}
    assert got == {(d, f, group[d]) for d, f in fp.items()}
    assert len(set(group.values())) < len(group) - 20
    rows = simhash.clusters(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert simhash.clusters(odd.limit(0)).count() == 0


def test_simhash_hot_keys_lose_no_link(spark):
    rng = random.Random(5)
    fps = list({(0x1234567890ABCDEF ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))) - (1 << 63) for _ in range(150)})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    want = classes_of(sorted(fps), lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 3)
    for most in (4096, 9):
        root = {r.node: r.root for r in components(simhash.links(df, most=most)).collect()}
        assert {f: root.get(f, f) for f in fps} == want


def shingles_of(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("most", [512, 3])
def test_near_copies(spark, most):
    """Texts of 1 to 400 words, a passage that many share and a large group of copies, against all pairs; keys whole and split."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9)))
    passage, rows = [word() for _ in range(40)], []
    for i, n in enumerate([*range(1, 24), 30, 45, 60, 90, 140, 200, 400]):
        base = [word() for _ in range(n)] + (passage if i % 5 == 0 else [])
        rows.append((i, " ".join(base)))
        for j in range(6):
            c, at = base[:], rng.randint(0, len(base))
            if j < 3:  # at the ends, where a word is in few shingles
                c = c[: max(1, len(c) - rng.randint(0, 1 + n // 6))] + [word() for _ in range(rng.randint(0, 1 + n // 30))]
            elif j < 5:
                c[at:at] = [word() for _ in range(rng.randint(1, 1 + n // 40))]
            rows.append((100 + 10 * i + j, " ".join(c).upper() if j == 5 else " ".join(c)))
    base = [word() for _ in range(50)]
    rows += [(1000 + i, " ".join([*base, *(word() for _ in range(i % 7))])) for i in range(60)] + [(2000, None), (2001, "  "), (2002, "")]
    sets = {d: shingles_of(t) for d, t in rows}
    linked = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    want = classes_of(sorted(sets), linked)
    got = {r.doc_id: r.first_id for r in simhash.copies(spark.createDataFrame(rows, "doc_id bigint, text string"), most=most).collect()}
    assert got == want and 60 < len(set(want.values())) < len(want) - 60


def test_shared_keys_of_repeated_rows():
    """Tasks file equal texts each, so rows (k, fp) may repeat, also across batches; each comes out once, and only where a key has others."""
    rng = random.Random(16)
    rows = sorted((rng.randrange(40), rng.randrange(6)) for _ in range(150)) + [(90, 1)] * 9 + [(91, 2)] * 9 + [(91, 3)] * 9
    of = defaultdict(set)
    for k, fp in rows:
        of[k].add(fp)
    want = sorted((k, min(fps), fp) for k, fps in of.items() if len(fps) > 1 for fp in fps)
    for size in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], names=["k", "fp"]) for i in range(0, len(rows), size)]
        assert sorted(r for b in simhash._shared(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)) == want


def test_near_copies_of_odd_rows(spark, odd):
    out = simhash.deduplicated(odd)
    assert out.columns == odd.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert len(left) == len(set(left)) and sum(d in (5, 6) for d, _ in left) == 1 and sum(d in (1, 2) for d, _ in left) == 1
    assert {r.doc_id: r["__row"] for r in out.collect()}[5] == "z" and simhash.deduplicated(odd.limit(0)).count() == 0


def test_levels_share_enough_classes():
    """Any two sizes that can be 0.8 alike meet at a level, with more classes than shingles that they can differ in."""
    for a in range(4, 700):
        for b in range(a, int(a / 0.8 + 1e-9) + 1):
            met = set(simhash.levels(a, 0.8)) & set(simhash.levels(b, 0.8))
            assert any(not classes or classes > (a + b) / 9 for _, classes in met)


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    nodes = sorted({x for e in edges for x in e})
    have = {frozenset(e) for e in edges}
    want = classes_of(nodes, lambda a, b: frozenset((a, b)) in have)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert {n: got.get(n, n) for n in nodes} == want


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def changed(rng, x, most=4):
    for _ in range(rng.randint(0, most)):
        i, o = rng.randint(0, len(x)), rng.random()
        x = x[:i] + rng.choice("abcz") + x[i:] if o < 0.33 else x[:i] + x[i + 1 :] if o < 0.66 else x[:i] + rng.choice("xyé") + x[i + 1 :]
    return x


def test_edit_distance_and_keys():
    rng = random.Random(8)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        b = changed(rng, a)
        d = distance(a, b)
        for edits in (1, 2, 3):
            assert lines.within(a, b, edits) == (d <= edits)
            for each in (3, 5, 12):
                short, long = sorted((a, b), key=len)
                if a != b and d <= lines.allowed(len(long), edits, each):
                    assert set(lines.keys(short, edits, each)[0]) & set(lines.keys(long, edits, each)[1])
                    assert lines._far(lines._nibbles(lines.bags([a]))[0], lines._nibbles(lines.bags([b])))[0] <= 2 * edits


def test_line_classes(spark, odd):
    """Lines of 0 to 60 characters against all pairs."""
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdef gh") for _ in range(n)) for n in [*range(0, 60, 2), 11, 12, 13, 22, 23, 24, 25]]
    rows = [(d, "\n".join(changed(rng, rng.choice(base), 3) for _ in range(rng.randint(1, 6)))) for d in range(160)]
    rows += [(500 + i, f"the same long beginning of a line {i:06d}") for i in range(60)] + [(600, "a\n\n \nb\na"), (601, "a\n\n\t")]
    all_ = [(d, n, x) for d, t in rows for n, x in enumerate(t.split("\n"))]
    near = lambda a, b: abs(len(a) - len(b)) <= (t := lines.allowed(max(len(a), len(b)))) and distance(a, b) <= t
    root = classes_of(sorted({x for *_, x in all_}), near)
    first = {}
    for d, n, x in all_:
        first[root[x]] = min(first.get(root[x], (d, n)), (d, n))
    assert {len(x) for x in root if root[x] != x} & {11, 12, 13} and {len(x) for x in root if root[x] != x} & {22, 23, 24, 25}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.line, r.first_doc_id, r.first_line) for r in lines.classes(df).collect()}
    assert got == {(d, n, *first[root[x]]) for d, n, x in all_}
    links = components(lines.links(df, most=5))  # keys split into parts
    assert links.count() == components(lines.links(df)).count()
    left = {r.doc_id: r.text for r in lines.deduplicated(df).collect()}
    assert left == {d: "\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip() or first[root[x]] == (d, n)) for d, t in rows}
    out = lines.deduplicated(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    kept = {r.doc_id: r for r in out.collect()}
    assert kept[6].text == "" and kept[5].text == ODD[6][1] and kept[5]["__row"] == "z" and lines.classes(odd.limit(0)).count() == 0 and lines.deduplicated(odd.limit(0)).count() == 0


def test_words_are_those_of_split():
    rng = random.Random(21)
    some = ["", "  x", "\x85\x1c k", "y" * 400_000 + " tail y", "word \u00e9 " * 30_000] + ["".join(rng.choice("ab\u3000 \t\x1f\u00e9") for _ in range(rng.randint(0, 90))) for _ in range(500)]
    h, n = lines._words(some)
    words = [w for x in some for w in x.split()]
    assert n.tolist() == [len(x.split()) for x in some] and len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))


def test_long_passages_need_no_keys_of_characters(spark):
    """Two edits of characters change four words at most, so lines of 40 words or more link by words, and aren't filed by characters."""
    rng, texts = random.Random(22), []
    for n in (*range(34, 44), 80):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n)]
        line = " ".join(words)
        gaps = [i for i, c in enumerate(line) if c == " "]
        cut = [line[:a] + line[a + 1 : b] + line[b + 1 :] for a, b in [sorted(rng.sample(gaps, 2))]]
        split = [line[:a] + " " + line[a + 1 : b] + " " + line[b + 1 :] for a, b in [(gaps[3] + 2, gaps[9] + 2)]]
        texts += [line, *cut, *split]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.first_doc_id for r in lines.classes(df).collect()}
    assert got == {i: i // 3 * 3 for i in range(len(texts))}
    data = lines._filed(df.select("text"), 2, 12, "lines and passages").collect()
    rows = np.concatenate([np.frombuffer(r.data, lines._ROW) for r in data])
    of = {lines.xxhash.xxh64_intdigest(x, 42): x for x in texts}
    filed = [of[h % 2**64] for h in rows["h"][rows["n"] < 0].tolist()]
    assert filed and all(len(x.split()) < 40 for x in filed) and {of[h % 2**64] for h in rows["h"][rows["n"] > 0].tolist()} == set(texts)


def test_keys_of_many_lines_lose_no_pair(monkeypatch):
    """Rows of a part beyond what a task holds: keys of many go on as they are, all others as pairs."""
    rng = random.Random(23)
    some = [f"the same beginning {rng.randrange(10**4):06d} {i % 40:04d}" for i in range(300)] + [changed(rng, "another line of some words here", 3) for _ in range(60)]
    of = {lines.xxhash.xxh64_intdigest(x, 42): x for x in some}
    near = {(a, b) for a in of.values() for b in of.values() if a < b and distance(a, b) <= lines.allowed(max(len(a), len(b)))}
    for held, most in ((1 << 19, 512), (20, 2)):
        monkeypatch.setattr(lines, "HELD", held)
        dealt = lines._dealt(lines._line_rows(of, 2, 12), 3)
        met, under = set(), {}
        for batch in lines._near(2, 12, most)(iter([dealt.slice(i, 1) for i in range(dealt.num_rows)] if held > 20 else [lines._dealt(rows, 3).slice(p, 1) for p in range(3) for rows in np.array_split(lines._line_rows(of, 2, 12), 12)])):
            for k, u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = of[u % 2**64], of[v % 2**64]
                met.add((min(a, b), max(a, b)))
                if k is not None:
                    under.setdefault(k, set()).update((a, b))
        assert near and all(p in met or any({*p} <= x for x in under.values()) for p in near)


def test_equal_lines_of_a_batch_are_shuffled_as_one_row(spark, monkeypatch):
    """So a very common line is no long partition."""
    df = spark.createDataFrame([(i or None, f"common\nown {i}\ncommon") for i in range(200)], "doc_id bigint, text string").coalesce(2)
    kept, write = {}, lines.written
    monkeypatch.setattr(lines, "written", lambda frame, label: kept.setdefault(label, write(frame, label)))
    got = {(r.doc_id, r.line): (r.first_doc_id, r.first_line) for r in lines.classes(df).collect()}
    assert got == {(i or None, n): (1, 0) if n != 1 else (i or None, 1) for i in range(200) for n in range(3)}
    assert kept["lines"].filter("n_chars = 6").select("h").groupBy("h").count().filter("count > 2").count() == 0


def test_passage_keys_meet_in_any_order():
    """Passages of at most a tenth of changed words share a key, whichever runs of words come last."""
    rng, known, met = random.Random(14), {}, 0
    for i in range(400):
        words = [str(w) for w in range(rng.choice((2, 5, 50, 3000)))]
        base = [rng.choice(words) for _ in range(rng.randint(20, 140))]
        other = base[:]
        for _ in range(rng.randint(0, len(base) // 9 + 1)):
            at, how = rng.randrange(len(other)), rng.random()
            other[at : at + 1] = [rng.choice(words)] if how < 0.5 else [] if how < 0.75 else [other[at], rng.choice(words)]
        if len(other) >= 20 and distance(base, other) <= max(len(base), len(other)) // 10:
            often = np.tile(np.array([rng.getrandbits(64) & rng.getrandbits(64) for _ in range(64)], np.uint64).view(np.int64), lines.SIEVE // 4096)
            k, whose = lines.passage_keys(lines._word_hashes(base + other, known), np.array([len(base), len(other)]), often if i % 2 else None)
            assert set(k[whose == 0]) & set(k[whose == 1])
            met += 1
    assert met > 200


def test_a_passage_within_many_lines_is_no_key(spark):
    """Lines that merely hold a passage aren't filed under it, so rows and pairs under keys don't grow with the square of such lines."""
    rng = random.Random(15)
    word = lambda a, b: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(a, b)))
    passage, rows = [word(12, 16) for _ in range(15)], []
    for i in range(120):
        own = [word(5, 9) for _ in range(60)]
        rows.append((i, " ".join(own[:30] + passage + own[30:])))
    keys = lines._passages(spark.createDataFrame(rows, "doc_id bigint, text string").select("text")).groupBy("k").count()
    assert max(r["count"] for r in keys.collect()) < 10


def test_passages_with_changed_words(spark):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    rows = []
    for p in range(8):
        base = [rng.choice(vocabulary) for _ in range((25, 55, 70, 130)[p % 4])]
        rows.append((100 * p, " ".join(base)))
        for j in range(1, 9):
            words = base[:]
            for _ in range(rng.randint(1, len(words) // 7)):
                i, how = rng.randrange(len(words)), rng.random()
                words[i : i + 1] = [rng.choice(vocabulary)] if how < 0.5 else [] if how < 0.75 else [words[i], rng.choice(vocabulary)]
            rows.append((100 * p + j, " ".join(words)))
    rows += [(9000 + i, " ".join(["a"] * n)) for i, n in enumerate((20, 22, 25, 40, 44, 60))]
    split = {t: t.split() for _, t in rows}
    tenth = lambda a, b: max(len(split[a]), len(split[b])) // 10
    linked = lambda a, b: abs(len(split[a]) - len(split[b])) <= tenth(a, b) and 2 * len({*split[a]} & {*split[b]}) > len({*split[a]}) and distance(split[a], split[b]) <= tenth(a, b)
    root, first = classes_of(sorted(split), linked), {}
    for d, t in rows:
        first[root[t]] = min(first.get(root[t], d), d)
    assert 8 < len(first) < len(rows) - 20
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(r.doc_id, r.first_doc_id) for r in lines.classes(df).collect()} == {(d, first[root[t]]) for d, t in rows}
    assert {r.doc_id for r in lines.deduplicated(df).collect() if r.text} == set(first.values())
    whole, parted = ({(r.node, r.root) for r in components(lines.passage_links(df, most=m)).collect()} for m in (4096, 2))
    assert whole == parted and whole


def test_token_counts(spark, docs, texts, odd, tmp_path, monkeypatch):
    lib = Tokenizer.from_file(BYTES)
    lib.encode_special_tokens = True
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    assert {(r.doc_id, r.n_tokens) for r in tokencounts.counts(docs, BYTES, 50256).collect()} == {(d, n(t)) for d, t in texts.items()}
    assert sorted((r.doc_id or -1, r.n_tokens) for r in tokencounts.counts(odd, BYTES, 50256).collect()) == sorted((d or -1, n(t)) for d, t, *_ in ODD)
    assert tokencounts.counts(odd.limit(0), BYTES, 50256).count() == 0
    monkeypatch.setattr(tokencounts, "LOT", 3)
    rng, want = random.Random(10), set()
    for f, size in enumerate([0, 1, 7, 100, 333, 600]):
        x = np.array([5 if f == 3 else rng.choice([0, 0, 1, 2, 3]) for _ in range(size)], "<u2")
        x.tofile(tmp_path / f"{f}.bin")
        ordinal = start = 0
        for i, v in enumerate(x.tolist()):
            if v == 0:
                want.add((f, ordinal, start, i - start, True))
                ordinal, start = ordinal + 1, i + 1
        if start < size:
            want.add((f, ordinal, start, size - start, False))
    with open(tmp_path / "2.bin", "ab") as f:
        f.write(b"\x01")  # half an id
    got = tokencounts.separated(tokencounts.open_files(spark, str(tmp_path), 2, 11), 0, 2, 11)
    assert {(int(r.file.rsplit("/", 1)[1][0]), r.ordinal, r.start, r.n_tokens, r.closed) for r in got.collect()} == want


def test_neighbours(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, None), (2100, [0.0] * 64), (2200, [None] + [1.0] * 63), (2300, [float("nan")] * 64), (2400, [1.0] * 3), (None, [1.0] * 64)]
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and len(v) == 64 and None not in v and not np.isnan(v).any() and any(v)}
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, id int, v string")
    got = defaultdict(list)
    for r in neighbours.neighbours(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = total = 0
    for q in [i for i in x if i % 100 == 0]:
        best = sorted((math.dist(x[q], x[c]), c) for c in x if c != q)[:10]
        assert len(got[q]) == 10 and q not in [c for c, _ in got[q]]
        assert all(abs(s - math.dist(x[q], x[c])) < 1e-12 for c, s in got[q]) and [(s, c) for c, s in got[q]] == sorted((s, c) for c, s in got[q])
        hit += len({c for _, c in best} & {c for c, _ in got[q]})
        total += 10
    assert set(got) == {i for i in x if i % 100 == 0} and hit / total >= 0.9
    assert [c for c, _ in got[1000]] == [3, *range(1001, 1010)]
    assert neighbours.neighbours(df.limit(0)).count() == 0


def _uneven_vectors() -> dict[str, np.ndarray]:
    """Rows whose mean lies apart from most of them, or whose scales differ."""
    rng = np.random.default_rng(3)
    normal = lambda *shape: rng.standard_normal(shape)
    return {
        "far": np.concatenate([0.1 * normal(1480, 32) + 3, 1000 * normal(20, 32)]),
        "two": normal(2, 32)[rng.integers(0, 2, 1500)] + 0.05 * normal(1500, 32),
        "most": np.concatenate([normal(1, 32) + 0.05 * normal(1350, 32), normal(15, 32)[rng.integers(0, 15, 150)] + 0.05 * normal(150, 32)]),
        "scales": normal(1500, 32) * np.exp(2 * normal(1500, 1)),
    }


def _share_found(found: dict[int, list[int]], x: np.ndarray, k: int) -> float:
    """Of the k nearest rows of each query, by brute force, the share that was found."""
    hit = 0
    for q, near in found.items():
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        hit += len(set(near) & set([c for c in np.lexsort((np.arange(len(x)), far)).tolist() if c != q][:k]))
    return hit / (k * len(found))


@pytest.mark.parametrize("which", ["far", "two", "most", "scales"])
def test_forest_of_uneven_rows(which):
    x = _uneven_vectors()[which]
    asked = range(0, len(x), 30)
    near = neighbours.Forest(x, 48).nearest(x[list(asked)], 11, 0.05)
    found = {q: [c for c in places[np.lexsort((places, far))].tolist() if c != q][:10] for q, (places, far) in zip(asked, near, strict=True)}
    assert _share_found(found, x, 10) >= 0.95


def test_neighbours_of_uneven_rows(spark):
    x = _uneven_vectors()["far"]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = defaultdict(list)
    for r in neighbours.neighbours(df).collect():
        found[r.query_id].append(r.vec_id)
    assert sorted(found) == list(range(0, 1500, 100)) and _share_found(found, x, 10) >= 0.95


def test_neighbours_over_several_partitions(spark):
    """Rows and queries of a block meet where small shuffles aren't merged into one partition, as on larger tables."""
    x = _uneven_vectors()["scales"]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = defaultdict(list)
        for r in neighbours.neighbours(df).collect():
            found[r.query_id].append(r.vec_id)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(found) == list(range(0, 1500, 100)) and _share_found(found, x, 10) >= 0.95


@pytest.mark.parametrize("which", ["table", "hot", "odd", "none"])
def test_shards(spark, docs, odd, which):
    hot = spark.createDataFrame([(i, "copy " * 20) for i in range(700)] + [(i, "x" * (i % 97)) for i in range(700, 2000)], "doc_id bigint, text string")
    df = {"table": docs, "hot": hot, "odd": odd, "none": docs.limit(0)}[which]
    rows, want = sharding.shards(df).collect(), sorted((r.doc_id or -1, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == want
    load, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and 0 <= r.shard < 8 and r.grown_shard is None
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if which in ("table", "hot"):
        assert max(load.values()) - min(load.values()) <= max(0.002 * sum(load.values()), max(r.size for r in rows) // 4)


def test_packed_by_dot_products():
    """Against a plain version in exact fractions of the totals."""
    rng = random.Random(11)
    for _ in range(30):
        items = [[rng.randint(1, 900), rng.randint(0, 900), rng.randint(1, 9)] for _ in range(rng.randint(0, 60))]
        total = [max(1, sum(i[k] for i in items)) for k in range(3)]
        share = [[4 * i[k] / total[k] for k in range(3)] for i in items]
        room, home = [[1.0] * 3 for _ in range(4)], [0] * len(items)
        for i in sorted(range(len(items)), key=lambda i: (-max(share[i]), i)):
            gain = [float(np.dot(r, share[i])) for r in room]
            fit = [s for s in range(4) if all(room[s][k] >= share[i][k] for k in range(3))] or range(4)
            home[i] = max(fit, key=lambda s: (gain[s], -s))
            room[home[i]] = [r - x for r, x in zip(room[home[i]], share[i], strict=True)]
        assert sharding.packed(np.array(items, float).reshape(-1, 3), 4).tolist() == home


def test_shards_keep_groups_whole(spark):
    """Groups of up to a shard's share are never cut, larger ones are."""
    rows = [(i, "large group " * 3) for i in range(500)] + [(1000 + i, f"group {i % 9} " + "x" * 20 * (i % 9)) for i in range(400)] + [(5000 + i, f"single {i} " + "y" * (i % 50)) for i in range(700)]
    df, of = spark.createDataFrame(rows, "doc_id bigint, text string"), dict(rows)
    shards, load = defaultdict(set), defaultdict(int)
    for r in sharding.shards(df).collect():
        shards[of[r.doc_id]].add(r.shard)
        load[r.shard] += r.size
    assert len(shards.pop("large group " * 3)) > 1 and all(len(s) == 1 for s in shards.values())
    assert max(load.values()) - min(load.values()) <= 0.01 * sum(load.values()) / 8


def test_place_balances_jointly():
    rng = np.random.default_rng(1)
    items = rng.integers(1, 1000, (3000, 3)).astype(float)
    load = np.array([items[sharding.place(items, 8) == s].sum(axis=0) for s in range(8)])
    assert (load.max(axis=0) / load.mean(axis=0))[0] < 1.001 and (load.max(axis=0) / load.mean(axis=0)).max() < 1.05


def test_toxicity(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    bad = spark.createDataFrame([(0, None), (None, 1), (1, 7)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels.select("doc_id", "toxic").unionByName(bad))
    assert model == toxicity.train(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert {r.doc_id for r in docs.filter(toxicity.held_out("doc_id")).collect()} >= held
    pairs = [(scores[a], scores[b]) for a in held if truth[a] for b in held if not truth[b]]
    assert sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs) > 0.95
    assert sum((scores[d] >= 0.5) == truth[d] for d in held) / len(held) > 0.98
    again = toxicity.toxicity(odd, model).collect()
    assert len(again) == len(ODD) and len({r.score for r in again if r.doc_id in (5, 6)}) == 1 and len({r.score for r in again if r.doc_id in (1, 2)}) == 1
    assert toxicity.kept(odd, model).columns == odd.columns and toxicity.toxicity(odd.limit(0), model).count() == 0
    none = toxicity.train(docs, labels.filter("toxic = 0"))
    assert {r.score for r in toxicity.toxicity(odd, none).collect()} == {0.0}


def test_toxicity_against_a_plain_version(spark):
    """The same dictionaries, threshold and scores from whole lists, without Spark."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    learnt = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in texts}
    counts = defaultdict(lambda: [0, 0])
    for d, y in learnt.items():
        data = b" " + " ".join(texts[d].lower().split()).encode() + b" "
        for g in {data[i : i + 6] for i in range(len(data) - 5) if data[i : i + 1] == b" "}:
            counts[g][1 - y] += 1
    n = sum(learnt.values())
    known = set(toxicity.telling([(g, a, b) for g, (a, b) in counts.items()], n, len(learnt) - n))
    assert known and all(any(g[1:5] in model.toxic for g in [k]) for k in known)
    rows = []
    for d, y in learnt.items():
        saved = next(iter(model.saved([texts[d]])))
        rows.append((y, len(saved), [int((saved >= k).sum()) for k in range(1, 7)]))
    assert toxicity.calibrated(toxicity.Model(model.toxic, model.ordinary), sorted(rows)) == model
    for r in toxicity.toxicity(docs, model).collect():
        saved = next(iter(model.saved([texts[r.doc_id]])))
        hits = int((saved >= model.least).sum())
        z = np.dot([1, hits > 0, math.log1p(hits), hits / max(1, len(saved)), math.log1p(len(saved))], model.weights)
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-9) and r.predicted == (r.score >= 0.5)


def test_toxicity_windows_cover_the_text():
    rng = random.Random(12)
    for _ in range(300):
        data = toxicity.folded("".join(rng.choice("ab  é\n" + "c" * 9) for _ in range(rng.randint(0, 400))))
        assert b"".join(toxicity.windows(data)).strip() == data.strip() and all(len(w) <= toxicity.WINDOW for w in toxicity.windows(data))


def edits_of(g, rng):
    h, w = g.shape
    return {
        "same": g, "crop": g[h // 8 : h - h // 16, w // 6 : w - w // 12], "corner": g[: h * 3 // 4, : w * 3 // 4], "half": g[:, : w // 2 + 10], "dark": 20 + 0.7 * g, "flat": 128 + 0.5 * (g - 128), "gamma": 255 * (g / 255) ** 1.3,
        "noise": g + rng.normal(0, 2, g.shape), "blur": images._box(g, 1), "turned": np.rot90(g), "dark crop": (10 + 0.8 * g)[h // 8 :, w // 8 :], "smaller": images._scaled(g, 1.5), "framed": np.pad(g, 6, constant_values=255),
    }


def texture(rng, size=96):
    coarse = np.kron(rng.uniform(0, 255, (size // 8, size // 8)), np.ones((8, 8)))
    return 0.5 * images._box(coarse, 2) + 0.5 * images._box(rng.uniform(0, 255, (size, size)), 1)


@pytest.mark.parametrize("pairs", [32, 2])
def test_images_against_all_pairs(spark, monkeypatch, pairs):
    """Six textures with twelve edits each, five with one logo: classes as of all pairs; each edit is with its original."""
    monkeypatch.setattr(images, "PAIRS", pairs)  # of 2: keys of the edits count as keys of many
    rng, rows = np.random.default_rng(5), []
    for t in range(6):
        g = texture(rng, 160 if t == 5 else 96)
        rows += [(100 * t + i, images.encoded(e)) for i, e in enumerate(edits_of(g, rng).values())]
    logo = texture(rng)
    for t in range(5):
        g = texture(rng, 160)
        g[20:84, 20:84] = logo[:64, :64]
        rows.append((1000 + t, images.encoded(g)))
    held = {}
    for i, data in rows:
        places, bits = images.features(images.decoded(data))
        held[i] = images.packed(places).tobytes() + bits.tobytes()
    of = {i: images.corners(d) for i, d in held.items()}
    verified = lambda a, b: images.same(of[min(a, b)], held[max(a, b)]) or images.same(of[max(a, b)], held[min(a, b)])
    want = classes_of(sorted(held), verified)
    got = {r.id: r.class_id for r in images.copies(spark.createDataFrame(rows, "id bigint, image binary")).collect()}
    assert got == want
    assert sum(got[i] == i // 100 * 100 for i in got if i < 1000) / sum(i < 1000 for i in got) >= 0.9 and not [i for i in got if i < 1000 and got[i] // 100 != i // 100]


def test_crops_of_a_large_image(spark):
    """A sixteenth of a large image still holds its share of the corners."""
    g = texture(np.random.default_rng(8), 480)
    rows = [(1, images.encoded(g))] + [(2 + i, images.encoded(g[y : y + 120, x : x + 120])) for i, (y, x) in enumerate([(0, 0), (77, 201), (350, 350), (180, 33)])]
    assert {r.class_id for r in images.copies(spark.createDataFrame(rows, "id bigint, image binary")).collect()} == {1}


def test_images(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 120")
    got = {r.id: r.class_id for r in images.copies(images.rendered(vectors)).collect()}
    assert got == {i: i - 1 if i % 25 in (5, 10) else i for i in range(120)}
    pgm = images.encoded(np.random.default_rng(1).uniform(0, 255, (40, 40)))
    flat = images.encoded(np.full((60, 60), 9.0))
    colour = b"P6\n# note\n2 1\n255\n" + bytes([255, 0, 0, 0, 0, 255])
    assert images.decoded(colour).shape == (1, 2) and images.decoded(b"P5\n9 9\n255\nshort") is None and images.decoded(None) is None
    odd = spark.createDataFrame([(1, pgm, 1), (2, pgm, 1), (3, b"", 1), (4, None, 1), (5, b"", 1), (6, flat, 1), (None, pgm, 1), (1, pgm, 1)], "id bigint, image binary, data int")
    rows = images.copies(odd).collect()
    assert len(rows) == 8 and {r.id: r.class_id for r in rows} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, None: 1}
    assert images.copies(odd.limit(0)).count() == 0
