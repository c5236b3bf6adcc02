"""Each operator against brute force, on a table of hard cases: nulls, empty and long texts, copies, repeated rows,
extra columns with clashing names; and on an empty table."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import common, html_text, mixing, near_dedup, packing, quality_model, queries, repetition, substring_dedup, suffix_dedup, token_files, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, key string, row string, label string"


def shingles(text, size):
    words = text.split()
    return set(zip(*(words[k:] for k in range(size)))) if len(words) >= size else {tuple(words)} if words else set()


def components(sets, percent):
    """For each (doc_id, set) the least doc_id of its component, by all pairs."""
    label = list(range(len(sets)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    nodes = [k for k, (i, s) in enumerate(sets) if s and i is not None]
    for n, a in enumerate(nodes):
        for b in nodes[n + 1 :]:
            both = len(sets[a][1] & sets[b][1])
            if 100 * both >= percent * (len(sets[a][1]) + len(sets[b][1]) - both):
                label[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for k in nodes:
        least[find(k)] = min(least[find(k)], sets[k][0])
    return [least[find(k)] if k in set(nodes) else i for k, (i, _) in enumerate(sets)]


def thue_morse(n, flip=False):
    """Words that every polynomial hash modulo 2^64 confuses with the other one from 1,024 letters on."""
    return "".join("ab"[(k.bit_count() + flip) % 2] for k in range(n))


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6)))
    make = lambda n: " ".join(word() for _ in range(n))
    base, shared = make(120), make(60)
    edited = base.split()
    edited[50] = "changed"
    return [base, base, " ".join(edited), make(30) + "\n" + shared, shared + "\t" + make(40), None, "", " \n ", "one", "One", make(3000), "x" * 4000, "ab " * 300, make(5) + " <|endoftext|> 　 end", base.upper(), shared + " " + shared, make(20) + "<|endoftext|>" + make(20)]


@pytest.fixture(scope="module")
def rows():
    t = texts()
    found = [(k, x, "en", ["s1", "s2", None][k % 3], len(x or ""), 1, "k", "r", "l") for k, x in enumerate(t)]
    return [*found, found[3], (None, t[0], None, None, None, 2, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(found, want):
    assert sorted(map(repr, found)) == sorted(map(repr, want))


def windows_removed(rows):
    words = [(r[0], (r[1] or "").encode().split()) for r in rows]
    count = Counter(tuple(w[k : k + 35]) for _, w in words for k in range(len(w) - 34))
    want = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return want


def test_substring(docs, rows, none):
    want = windows_removed(rows)
    same([tuple(r) for r in substring_dedup.digest(docs).collect()], want)
    assert substring_dedup.digest(none).collect() == []
    kept = substring_dedup.remove_repeats(docs)
    assert sum(r.n_removed for r in kept.collect()) == sum(x[2] for x in want)


def test_words_alike(spark):
    """Words that differ and have one polynomial hash: every operator tells them apart."""
    r = random.Random(9)
    rows = []
    for n in (1024, 2048):
        other = [f"w{r.randint(0, 999)}" for _ in range(60)]
        rows += [(2 * n + flip, " ".join([*other[:30], thue_morse(n, flip), *other[30:]])) for flip in (False, True)]
        rows += [(2 * n + 2, " ".join([*other[:2], thue_morse(n), other[3], *other[:2], thue_morse(n, True), other[3]] * 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same([tuple(x) for x in substring_dedup.digest(df).collect()], windows_removed(rows))
    sets = [(i, shingles(t.encode(), 3)) for i, t in rows]
    same([(x.doc_id, x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(df, 3, 85, 6, 30).collect()], [(i, len(s), c) for (i, s), c in zip(sets, components(sets, 85))])
    same([tuple(x)[:7] for x in repetition.judge(df).collect()], repeats(rows))
    crc = {i: zlib.crc32(np.array([*reference_ids(t), 0], "<u4").tobytes()) for i, t in rows}
    joined = defaultdict(bytes)
    for x in sorted(packing.pack(df, queries.tokenizer_path(), with_ids=True).collect(), key=lambda x: x.start):
        joined[x.doc_id] += bytes(x.ids)
    assert {i: zlib.crc32(x) for i, x in joined.items()} == crc


def bytes_removed(rows, length=100):
    seen, want = set(), []
    for i, t in sorted(((r[0], (r[1] or "").encode()) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if t[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(t[k : k + length])
        spans = len(re.findall(b"\1+", bytes(gone)))
        want.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return want


def test_suffix(docs, rows, none):
    want = bytes_removed(rows)
    same([tuple(r) for r in suffix_dedup.digest(docs).collect()], want)
    assert suffix_dedup.digest(none).collect() == []
    spans = suffix_dedup.remove_repeats(docs).collect()
    same([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in spans], want)


@pytest.mark.parametrize("hot", [1, 3, 1 << 14])
def test_suffix_passages(spark, hot):
    """Passages that many texts have, with other text around them and periodic stretches, in many blocks; cores that are
    hot and those that aren't give one result."""
    r = random.Random(11)
    make = lambda n: "".join(r.choice("abcdé \0") for _ in range(n))
    shared = [make(r.randint(90, 260)) for _ in range(5)] + ["ab" * 100, "\0" * 150, "x" * 130]
    rows = [(k, "".join(r.choice([make(r.randint(0, 80)), r.choice(shared)]) for _ in range(r.randint(0, 7)))) for k in range(150)]
    found = suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot).collect()
    same([tuple(x) for x in found], bytes_removed(rows))


@pytest.mark.parametrize("length", [8, 9, 20, 100])
def test_suffix_array(length):
    """Against sorting the suffixes themselves."""
    r = random.Random(length)
    for letters in ("ab", "a", "\0\1a", "abcdefgh"):
        data = "".join(r.choice(letters) for _ in range(300)).encode() * 2
        start = [k for k in range(len(data) - length + 1) if r.random() < 0.8]
        order, same_ = suffix_dedup.suffix_array(np.frombuffer(data, np.uint8), np.array(start), length)
        want = sorted(range(len(start)), key=lambda k: (data[start[k] : start[k] + length], k))
        assert order.tolist() == want
        cut = [data[start[k] : start[k] + length] for k in want]
        assert same_.tolist() == [k > 0 and cut[k] == cut[k - 1] for k in range(len(cut))]


def test_suffix_repeated_ids(spark):
    """Rows of one id are texts of their own: together they lose what the same texts lose under ids of their own."""
    r = random.Random(13)
    shared = ["".join(r.choice("abc ") for _ in range(150)) for _ in range(6)]
    texts = ["".join(r.choice("def") for _ in range(40)) + r.choice(shared) for _ in range(60)]
    order = {t: h % (1 << 64) for t, h in spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "xxhash64(text)").collect()}
    want = bytes_removed(list(enumerate(sorted(texts, key=order.get))))
    for one in (7, None):
        found = suffix_dedup.digest(spark.createDataFrame([(one, t) for t in texts], "doc_id long, text string").repartition(3)).collect()
        same([tuple(x)[1:] for x in found], [x[1:] for x in want])


@pytest.mark.parametrize("bits", [1, 8, 14])
def test_suffix_short_keys(spark, bits):
    """Each text twice: of short core keys some are equal in a block, for cores of one bucket and of different ones."""
    r = random.Random(3)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(300)) for _ in range(300)]
    found = suffix_dedup.digest(spark.createDataFrame(enumerate(texts * 2), "doc_id long, text string"), core_bits=bits).collect()
    same([(x.doc_id, x.n_removed) for x in found], [(k, 0 if k < 300 else 300) for k in range(600)])


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near(docs, rows, none, size, percent):
    sets = [(r[0], shingles((r[1] or "").encode().lower(), size)) for r in rows]
    want = [(i, len(s), c, c == i) for (i, s), c in zip(sets, components(sets, percent))]
    same([tuple(r) for r in near_dedup.near_duplicates(docs, size, percent).collect()], want)
    assert near_dedup.near_duplicates(none).collect() == []


@pytest.mark.parametrize("bucket,chunk", [(1 << 14, 8 << 20), (50, 8 << 20), (1 << 14, 4000), (7, 2000)])
def test_near_large_group(spark, bucket, chunk):
    """A group of copies with similarities from 0.4 to 1, in one chunk or in many."""
    r = random.Random(8)
    base = [f"w{r.randint(0, 500)}" for _ in range(60)]
    rows = []
    for k in range(260):
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(60)] = f"x{r.randint(0, 40)}"
        rows.append((k, " ".join(w)))
    sets = [(k, shingles(t.encode(), 3)) for k, t in rows]
    want = [(k, c) for (k, _), c in zip(sets, components(sets, 85))]
    assert 10 < len({c for _, c in want}) < 200
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 6, 30, bucket=bucket, chunk=chunk).collect()
    same([(x.doc_id, x.component_id) for x in found], want)


def test_near_forests_meet(spark, monkeypatch):
    """Copies that meet in every band: the links of all tasks together are few for each text, not one for each task."""
    r = random.Random(4)
    base = [f"w{r.randint(0, 900)}" for _ in range(200)]
    rows = [(k, " ".join([*base[: k % 190], f"x{k}", *base[k % 190 :]])) for k in range(300)]
    made, whole = [], near_dedup.components

    def counted(links, cut):
        def kept(df):
            made.append((df.columns, (out := cut(df)).count()))
            return out

        return whole(links, kept)

    monkeypatch.setattr(near_dedup, "components", counted)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 6, 30).collect()
    assert {x.component_id for x in found} == {0}
    assert max(n for columns, n in made if columns == ["a", "b"]) <= 2 * 1.2 * 300  # both ways


def test_workers_are_tidied(spark):
    """What packing keeps in a worker is gone when another operator's task runs in it."""
    docs = spark.createDataFrame([(k, f"word{k} and more") for k in range(8)], "doc_id long, text string").repartition(2)

    def kept(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": [len(common.KEPT.get("encoders", ()))]})

    packing.pack(docs, queries.tokenizer_path()).collect()
    assert sum(r.n for r in docs.mapInArrow(kept, "n long").collect())
    near_dedup.sketches(docs, 3, 6, 30).collect()
    substring_dedup.digest(docs).collect()
    near_dedup.sketches(docs.repartition(16), 3, 6, 30).collect()
    assert not sum(r.n for r in docs.mapInArrow(kept, "n long").collect())


def test_thinned(spark):
    """Any links: the components stay, and no link is added."""
    r = random.Random(6)
    for n in (5, 40):
        links = {(r.randrange(40), r.randrange(40)) for _ in range(n)}
        df = spark.createDataFrame([(b"%03d" % a, b"%03d" % b) for a, b in links if a != b], "a binary, b binary")
        few = [(int(x.a), int(x.b)) for x in near_dedup.thinned(df).collect()]
        assert len(few) <= len(links)
        ends = lambda pairs: near_dedup._connected(40, *np.array(pairs).T).tolist()
        assert ends(few) == ends([x for x in links if x[0] != x[1]])


def test_least_matches():
    assert near_dedup.least_matches(30, 85, 1e-9) < near_dedup.least_matches(30, 85, 1e-3) < 30


def reference_ids(t):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    return tok.encode(t or "", add_special_tokens=False).ids


def test_token_files(spark, docs, rows, none, tmp_path):
    manifest = token_files.write(docs, queries.tokenizer_path(), str(tmp_path))
    found = token_files.read(spark, manifest).collect()
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    want = [(r[0], len(ids := [*reference_ids(r[1]), 2]), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in rows]
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in found], want)
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert token_files.read(spark, token_files.write(none, queries.tokenizer_path(), str(tmp_path))).collect() == []


def test_packing(docs, rows, none):
    found = packing.pack(docs, queries.tokenizer_path(), with_ids=True).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    times = Counter(r[0] for r in rows)
    for r in rows:
        if times[r[0]] == 1:
            joined = b"".join(p.ids for p in sorted(pieces[r[0]], key=lambda p: p.start))
            assert joined == np.array([*reference_ids(r[1]), 0], "<u4").tobytes() and {p.doc_tokens for p in pieces[r[0]]} == {len(joined) // 4}
    whole = sum(sum(p.length for p in s) == 1024 for s in sequences.values())
    rest = sorted(sum(p.length for p in s) for s in sequences.values() if sum(p.length for p in s) < 1024)
    assert whole * 1024 + sum(rest) == sum(p.length for s in sequences.values() for p in s)
    assert sum(x & (x - 1) > 0 for x in rest) <= docs.rdd.getNumPartitions()
    assert sum(r.length for r in found) == sum(len(reference_ids(r[1])) + 1 for r in rows)
    assert packing.pack(none, queries.tokenizer_path()).collect() == []


def repeats(rows):
    want = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        three = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        flags = [False] * len(w)
        for k in range(len(w) - 2):
            if three[tuple(w[k : k + 3])] > 1:
                flags[k : k + 3] = [True] * 3
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        want.append((i, len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), sum(flags), len(w) < 50 or 100 * sum(flags) > 50 * len(w)))
    return want


def test_repetition(docs, rows, none):
    want = repeats(rows)
    found = repetition.judge(docs).collect()
    same([tuple(r)[:7] for r in found], want)
    assert {r.doc_id: r.kept for r in found}[10] and not {r.doc_id: r.kept for r in found}[12]
    assert repetition.judge(none).collect() == []


def test_repetition_beyond_base(spark):
    """Passages that pass the base rules and cover over 12 % of a text are rejected by the method, shorter ones are not."""
    word = [f"w{k}" for k in range(300)]
    texts = [word, word[:260] + word[:40], word[:292] + word[:8], word[:282] + word[:18], word[:281] + word[:19]]
    found = repetition.judge(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_covered, x.base_failed, x.kept) for x in found) == [(0, 0, False, True), (1, 80, False, False), (2, 16, False, True), (3, 36, False, True), (4, 38, False, False)]


def test_longest_repeats():
    r = random.Random(3)
    for _ in range(60):
        s = [r.randint(0, 2) for _ in range(r.randint(1, 40))]
        common_ = lambda a, b: next((k for k in range(len(s)) if b + k >= len(s) or s[a + k] != s[b + k]), 0)
        want = [max([common_(min(a, b), max(a, b)) for b in range(len(s)) if a != b], default=0) for a in range(len(s))]
        assert repetition.longest_repeats(np.array(s, np.uint64)).tolist() == want


def test_topk(spark):
    r = random.Random(2)
    vectors = [(k, [r.uniform(-1, 1) for _ in range(4)]) for k in range(120)] + [(200, [0.5] * 4), (201, [0.5] * 4), (250, None), (300, [1.0, None, 0.0, 0.0]), (350, [float("nan")] * 4), (400, [0.1, 0.2])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    good = {i: np.floor(np.array(v, np.float32).astype(float) * 256).astype(int) for i, v in vectors if v is not None and None not in v and v[0] == v[0]}
    want = []
    for q in (i for i in good if i % 50 == 0):
        scores = sorted((-int(v @ good[q]), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])]
    same([tuple(x) for x in topk.search(df).collect()], want)
    assert topk.search(df.limit(0)).collect() == []
    same([tuple(x) for x in topk.search(df.selectExpr("*", "1 AS query", "2 AS rank", "3 AS block"), block=2).collect()], want)


def test_topk_large_scores(spark):
    """Components beyond the exact range of doubles, repeated candidates and ties."""
    vectors = [(50, [3.0e6, -2.0e6]), (1, [4.0e7, 1.0e6]), (2, [4.0e7, 1.0e6]), (2, [4.0e7, 1.0e6]), (3, [-1.0, 5.0e7]), *((100 + k, [1.0, 1.0]) for k in range(1, 9))]
    whole = {i: [int(x * 256) for x in v] for i, v in vectors}
    scores = sorted((-sum(a * b for a, b in zip(whole[50], whole[i])), i) for i, _ in vectors if i != 50)
    want = [(50, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])]
    same([tuple(x) for x in topk.search(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), every=50).filter("query_id = 50").collect()], want)


def test_topk_repeated_queries(spark):
    r = random.Random(4)
    vectors = [(k, [r.uniform(-1, 1) for _ in range(4)]) for k in range(60)]
    extra = [r.uniform(-1, 1) for _ in range(4)]
    search = lambda rows: [tuple(x) for x in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    once, other = search(vectors[:50]), search([(0, extra), *vectors[1:50]])
    assert len(once) == 5
    same(search([vectors[0], vectors[0], *vectors[:50]]), once)
    same(search([vectors[0], (0, extra), *vectors[:50]]), once + other)


def mixed(rows, weights=(1, 2, 3), epochs=3):
    """(doc_id, size, source_size, target, taken) by exact fractions."""
    size = [len((r[1] or "").encode().split()) for r in rows]
    names = sorted({r[3] for r in rows}, key=lambda x: (x is None, x or ""))
    total = {n: sum(s for r, s in zip(rows, size) if r[3] == n) for n in names}
    weight = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    free, target, left = set(names), {}, Fraction(sum(size))
    while free:
        unit = left / sum(weight[n] for n in free)
        over = {n for n in free if weight[n] * unit > epochs * total[n]}
        for n in over or free:
            target[n] = Fraction(epochs * total[n]) if over else weight[n] * unit
        left -= sum(target[n] for n in over)
        free = free - over if over else set()
    want = []
    for n in names:
        mine = [(int(hashlib.md5("|".join(["17", *(str(x) for x in (r[0], r[1]) if x is not None)]).encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0, s) for r, s in zip(rows, size) if r[3] == n]
        whole = int(target[n] / total[n]) if total[n] else 0
        rest = round(target[n]) - whole * total[n]
        for _, some, i, s in sorted(mine):
            more = max(0, min(s, rest))
            rest -= s
            want.append((i if some else None, s, total[n], float(target[n]), whole * s + more))
    return want


def test_mixing(spark, docs, rows, none, monkeypatch):
    same([tuple(r) for r in mixing.plan(docs).collect()], mixed(rows))
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.plan(none).collect() == [] and mixing.mix(none).collect() == []
    r = random.Random(12)
    many = [(k, "w " * r.randint(0, 40) or None, None, f"s{int(r.random() ** 3 * 30):02d}") for k in range(2000)]
    monkeypatch.setattr(mixing, "SMALL", 3)  # several rounds of histograms
    found = mixing.plan(spark.createDataFrame(many, "doc_id long, text string, lang string, source string")).collect()
    same([tuple(r) for r in found], mixed(many))
    assert all(r.taken <= 3 * r.size for r in found)


@pytest.mark.parametrize("sizes,weights,want", [([1, 10, 10], (10, 1, 1), [3, 9, 9]), ([0, 0], (1, 2), [0, 0]), ([5], (2,), [5]), ([0, 7], (1, 1), [0, 7])])
def test_targets(spark, sizes, weights, want):
    found = mixing._targets(spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(sizes)], "source string, s long"), weights, 3)
    assert [r.target for r in found.orderBy("name").collect()] == want


def test_quality(spark, docs, none):
    found = {r.doc_id: r for r in quality_model.classify(docs).collect()}
    assert not found[5].kept and not found[6].kept and found[10].kept
    assert quality_model.classify(none).collect() == []
    assert quality_model.keep(docs).columns == docs.columns


def test_estimate():
    """Against expectation and maximisation over single documents."""
    r = random.Random(4)
    n = len(quality_model.LABELLERS)
    docs = [tuple(r.choices(range(3), [3, 6, 1] if r.random() < 0.8 else [2, 1, 6])[0] for _ in range(n)) for _ in range(400)]
    good = [0.1 if 2 in d else 0.9 for d in docs]
    for _ in range(quality_model.ROUNDS):
        prior = [(sum(1 - g for g in good) + 1) / (len(docs) + 2), (sum(good) + 1) / (len(docs) + 2)]
        tables = []
        for j in range(n):
            table = [[sum((g if side else 1 - g) for d, g in zip(docs, good) if d[j] == v) + 0.5 for v in range(3)] for side in (0, 1)]
            table = [[x / sum(row) for x in row] for row in table]
            table[1][2] = min(table[1][2], quality_model.MOST_FALSE)
            tables.append(table)
        both = [[prior[side] * math.prod(tables[j][side][d[j]] for j in range(n)) for side in (0, 1)] for d in docs]
        good = [b / (a + b) for a, b in both]
    code = lambda d: sum(v * 3**j for j, v in enumerate(d))
    found, _ = quality_model.estimate(Counter(map(code, docs)))
    assert all(abs(found[code(d)] - g) < 1e-9 for d, g in zip(docs, good))


def test_train():
    """The scorer's loss is near the minimum that Newton's method finds."""
    r = np.random.default_rng(5)
    x = r.random((300, 6)).astype(np.float32)
    y = np.clip((x @ np.array([3, -3, 1, 0, 0, 0]) > 0.3).astype(float), 0.05, 0.95)
    w = quality_model.train(x, y, 4000)
    full = np.hstack([x, np.ones((300, 1))])
    share = y.mean()

    def loss(v):
        p = np.clip(1 / (1 + np.exp(-(full @ v))), 1e-12, 1 - 1e-12)
        return -np.mean((y * np.log(p) + (1 - y) * np.log(1 - p)) * (y / share + (1 - y) / (1 - share))) + 5e-6 * (v @ v)

    best, weight = np.zeros(7), y / share + (1 - y) / (1 - share)
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-(full @ best)))
        hessian = (full * (weight * p * (1 - p))[:, None]).T @ full / len(x) + 1e-5 * np.eye(7)
        best = best - np.linalg.solve(hessian, full.T @ ((p - y) * weight) / len(x) + 1e-5 * best)
    assert loss(best) <= loss(w) < 1.01 * loss(best) < 0.75 * loss(np.zeros(7))


def test_quality_rare_class(spark):
    """Three bad documents among 2,000: the scorer is trained all the same."""
    r = random.Random(6)
    rows = [(k, " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(30))) for k in range(2000)]
    rows += [(2000 + k, "### | $$$ | %%% | " * 10) for k in range(3)]
    found = quality_model.classify(spark.createDataFrame(rows, "doc_id long, text string"), sample=100).collect()
    assert [x.doc_id for x in found if not x.kept] == [2000, 2001, 2002]
    assert any(abs(x.score - x.posterior) > 1e-6 for x in found)


def test_quality_on_labels(spark):
    """Held-out: the labels are never shown to the model."""
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    found = quality_model.classify(spark.read.parquet(f"{d}/documents.parquet")).collect()
    right = [int(r.kept) == labels[r.doc_id] for r in found if r.doc_id in labels]
    assert sum(right) / len(right) > 0.98


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><div class='ad'>Buy</div><article><h1>A&amp;B</h1><p>One <b>two<br>three.<p>Four</p><aside>x</aside><div id=comments><p>no</p></div></article><footer>f</footer><script>var p='<p>';</script></body></html>"
    assert html_text.main_text(page) == "A&B\n\nOne two three.\n\nFour"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p><!--") == ""
    long = "word " * 40
    assert html_text.main_text(f"<div><a>menu</a></div><p>{long}</p><p>{long}</p><ul><li><a>x</a></li></ul>") == f"{long.strip()}\n\n{long.strip()}"
    df = spark.createDataFrame([(1, "u", page), (1, None, None), (None, "v", page)], "page_id long, url string, html string")
    assert [r.n_chars for r in html_text.extract(df).collect()].count(0) == 1
    assert html.unescape("&amp;") == "&" and html_text.extract(df.limit(0)).collect() == []


def test_html_weights():
    """Marks weigh on the lengths; they don't decide alone."""
    long = ("word " * 60).strip()
    main = f"<div><p>{long}</p><p>{long}</p></div>"
    teaser = "<article{}><h3><a href=x>A headline</a></h3><p>short</p></article>"
    for name in ("", " class='related'"):
        assert html_text.main_text(main + teaser.format(name) * 3) == f"{long}\n\n{long}"
    article = f"<article><p>{long}</p><p>end</p></article>"
    assert html_text.main_text(f"<div class='layout with-sidebar'>{article}<aside>x</aside></div>") == f"{long}\n\nend"
    assert html_text.main_text(f"<div class='layout with-sidebar'>{main}</div><footer>f</footer>") == f"{long}\n\n{long}"
    assert html_text.main_text(f"{article}<div id=comments><p>{long}</p></div>") == f"{long}\n\nend"


def test_html_pages():
    """Class names count by whole words, an article keeps its headers, and short pages their text."""
    long, text = ("word " * 60).strip(), html_text.main_text
    assert text(f"<div class='layout has-sidebar'><article><p>{long}</p></article></div>") == long
    assert text(f"<div class='no-sidebar'><p>{long}</p><p>{long}</p></div>") == f"{long}\n\n{long}"
    assert text(f"<article><header><h1>Title</h1></header><p>{long}</p></article>") == f"Title\n\n{long}"
    assert text(f"<article><div class='post-header'><h2>Title</h2></div><p>{long}</p></article>") == f"Title\n\n{long}"
    assert text(f"<section><article><p>{long}</p><p>{long}</p></article><article class='comment'><p>{long}</p></article></section>") == f"{long}\n\n{long}"
    assert text("<html><body><p>One short line.</p></body></html>") == "One short line."
    assert text("<body><nav><a>x</a></nav><p>a</p><p>b</p><footer>f</footer></body>") == "a\n\nb"
    assert text(f"<div><p>{long}</p><p><a href=x>A paragraph of one link</a></p><p>{long}</p></div>") == f"{long}\n\nA paragraph of one link\n\n{long}"
    assert text(f"<header><p>{long[:60]}</p></header><div><p>{long}</p></div>") == long


def test_html_generated():
    """Pages made of an article and everything that isn't one, in many orders: the article comes back, block by block."""
    r = random.Random(21)
    words = lambda n: " ".join(r.choice(["alpha", "b&amp;c", "<b>bold</b>", "déjà", "line<br>break", "<a href='x'>link</a>"]) for _ in range(n))
    plain = lambda t: " ".join(html.unescape(re.sub(r"<[^>]*>", "", t.replace("<br>", " "))).split())
    around = [
        lambda: f"<nav><ul>{''.join(f'<li><a href=/{k}>{words(2)}</a></li>' for k in range(5))}</ul></nav>", lambda: f"<div class='ad'>{words(6)}</div>", lambda: f"<header><p>{words(8)}</p></header>",
        lambda: f"<footer>&copy; {words(8)}</footer>", lambda: f"<aside>{words(20)}</aside>", lambda: f"<form><label>{words(3)}</label><input></form>", lambda: f"<script>var x = '<p>{words(30)}</p>';</script>",
        lambda: f"<div id='comments'><p>{words(25)}</p><p>{words(25)}</p></div>", lambda: "<style>p { color: red }</style><!-- <p>none</p> -->", lambda: f"<div class='cookie-notice'>{words(9)}</div>",
    ]
    for _ in range(60):
        blocks = [f"<h1>{words(4)}</h1>", *(f"<p>{words(r.randint(15, 60))}{r.choice(['</p>', ''])}" for _ in range(r.randint(1, 8)))]
        before, after = ([r.choice(around)() for _ in range(r.randint(0, 4))] for _ in range(2))
        page = "<html><body>" + "".join(before) + "<article>" + "".join(blocks) + "</article>" + "".join(after) + "</body></html>"
        assert html_text.main_text(page) == "\n\n".join(map(plain, blocks)), page


def test_pipeline_stages(spark, rows):
    """Each stage against brute force on what it is given."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    own = {r[0]: r[:5] for r in rows if r[0] is not None}
    start = spark.createDataFrame([tuple(r) for r in own.values()], columns)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(stages["quality"](spark, start, "")) == sorted(r.doc_id for r in quality_model.classify(start).collect() if r.kept)
    sets = [(i, shingles((r[1] or "").encode().lower(), 5)) for i, r in own.items()]
    assert ids(stages["near_duplicates"](spark, start, "")) == sorted(i for (i, _), c in zip(sets, components(sets, 80)) if c == i)
    gone = {w[0]: w for w in windows_removed(list(own.values()))}
    cut_ = {r.doc_id: r for r in stages["substrings"](spark, start, "").collect()}
    assert sorted(cut_) == sorted(i for i, w in gone.items() if not w[1] or w[2] < w[1])
    for i, r in cut_.items():
        assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == gone[i][3]
        assert r.text == own[i][1] if not gone[i][2] else r.n_chars == len(r.text)
    times = Counter(r.doc_id for r in stages["mixed"](spark, start, "").collect())
    assert times == Counter({i: n for i, size, _, _, taken in mixed(list(own.values())) if size and (n := int((taken + size / 2) // size))})
    pieces = stages["packed"](spark, start, "").collect()
    assert sum(p.length for p in pieces) == sum(len(reference_ids(r[1])) + 1 for r in own.values())


def test_pipeline(spark, docs, none):
    import corpus_pipeline

    for start in (docs, none):
        got = start.select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, got, "")
            assert out.columns == got.columns, name
            got = common.cut(out)
        corpus_pipeline.STAGES[-1][1](spark, got, "").collect()
