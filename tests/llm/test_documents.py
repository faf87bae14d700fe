"""The operators on documents against brute force, on one table of awkward rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from lamplight.llm import bpe, ctw, exact_dedup, licenses, mixing, near_dedup, sharding, toxicity
from lamplight.llm.queries import word_bpe_path

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
BASE = " ".join(f"term{i}" for i in range(60))
# Columns that clash with names used inside the operators come last.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id long, key string, digest string, shard int, _row long, block int, score double"


def awkward():
    texts = [
        None, "", "", " \t\n ", "One", "one two", "Same text here today", "Same text here today", "same text here today",
        LONG, LONG, LONG + " end", BASE, BASE + " more", BASE.replace("term30", "other"), "İstanbul ΣΑΣ ½ ２ <|endoftext|> it's 'LL",
        "Released under the MIT License.", "x released, under THE mit license! y", "Licensed under the Apache License", "é" * 300, "a" * 5000,
    ]
    rows = [(i, t, "en", "hot" if i % 3 else None, None) for i, t in enumerate(texts)]
    rows += [(6, texts[6], "en", "hot", 1), (6, texts[6], "en", "hot", 1), (None, "lonely words of no id", None, "b", None)]
    rows += [(100 + i, "hot copy of the same few words", "en", "hot", 30) for i in range(30)]
    return [(*r, 7, 7, "k", "d", 99, 5, 3, 0.5) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("digest_size", [16, 1])
def test_exact_dedup(docs, digest_size):
    """With one-byte digests most chunks collide, and only verification tells them apart."""
    groups = defaultdict(list)
    for r in awkward():
        groups[r[1] or ""].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
    got = exact_dedup.exact_dedup(docs, digest_size=digest_size).collect()
    assert Counter(tuple(r) for r in got) == want


def test_chunks_do_not_depend_on_what_stands_before():
    import numpy as np

    text = LONG.encode()
    alone = exact_dedup.chunk_ends(exact_dedup.cut_points(np.frombuffer(text, np.uint8)), 0, len(text))
    shifted = np.frombuffer(b"something else " + text, np.uint8)
    moved = exact_dedup.chunk_ends(exact_dedup.cut_points(shifted), 15, len(shifted))
    assert [e - 15 for e in moved] == alone and len(alone) > 20
    assert all(b - a <= exact_dedup.MOST for a, b in zip([0, *alone], alone, strict=False))


def test_sharding(docs):
    rows = sharding.byte_shards(docs).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in awkward())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and 0 <= r.shard < 24 and r.grown_shard is None
        by[r.shard].append(r)
    for held in by.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    even = docs.sparkSession.range(5000).selectExpr("id AS doc_id", "repeat('x', CAST(id % 50 AS INT)) AS text")
    sums = Counter()
    spans = {}
    for r in sharding.byte_shards(even).collect():
        sums[r.shard] += r.size
        lo, hi = spans.get(r.shard, (r.doc_id, r.doc_id))
        spans[r.shard] = (min(lo, r.doc_id), max(hi, r.doc_id))
    assert len(sums) == 24 and max(sums.values()) - min(sums.values()) <= 2 * 58
    ends = [spans[s] for s in range(24)]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_mixing(docs):
    rows = mixing.taken(docs).collect()
    again = mixing.taken(docs.repartition(3)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    words = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for r in awkward():
        sizes[r[3]] += words(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.targets([sizes[s] for s in order]), strict=True))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r[0], words(r[1])) for r in awkward())
    took = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        name = next(s for s in order if sizes[s] == r.source_size)
        assert r.target == pytest.approx(target[name])
        took[name] += r.taken
    for s in order:
        assert abs(took[s] - target[s]) <= 1


def test_mixing_laws():
    import numpy as np

    for n in (1, 2, 5, 64, 1001):
        there = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 99))
        assert sorted(there.tolist()) == list(range(n))
        assert (mixing.permute(there, np.full(n, n), np.full(n, 99), back=True) == np.arange(n)).all()
    assert mixing.targets([100, 10, 0]) == pytest.approx([145.0, 20.0, 0.0]) or sum(mixing.targets([100, 10, 0])) <= 165
    made = mixing.plan([("a", 10_000), ("b", 500), (None, 300)], shards=8)
    assert made["draws"].sum(axis=0).tolist() == [s["slots"] for s in made["sources"]]
    widths = made["draws"].sum(axis=1)
    assert widths.max() - widths.min() <= 1


def test_mixing_takes_what_its_slots_name(docs):
    """Words taken from every document, recounted one word at a time from the plan and the permutations."""
    import numpy as np

    words = lambda t: len((t or "").encode().split())
    sized = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    once = {(r.doc_id, r.size): r.taken for r in mixing.taken(sized, block=64, shards=3).collect()}
    rows = {r[0]: r for r in reversed(awkward()) if r[0] is not None}
    streams = defaultdict(list)
    for i in sorted(rows):
        streams[rows[i][3]] += [i] * words(rows[i][1])
    sizes = {r[3]: 0 for r in rows.values()} | {s: len(v) for s, v in streams.items()}
    made, took = mixing.plan(list(sizes.items()), block=64, shards=3), Counter()
    for s in made["sources"]:
        for j in range(s["slots"]):
            epoch, at = divmod(j, s["blocks"])
            b = int(mixing.permute(np.array([at]), np.array([s["blocks"]]), np.array([mixing._key(s["sid"], epoch, mixing.SEED)]))[0])
            held = streams[s["source"]][64 * b : 64 * b + 64]
            took.update(held[: s["last"]] if j == s["slots"] - 1 and s["last"] else held)
    assert {i: n for (i, _), n in once.items() if n} == dict(took)


def test_mixed_documents_say_what_was_taken(docs):
    rows = mixing.mixed_documents(docs.select("doc_id", "text", "lang", "source", "n_chars")).collect()
    took = Counter()
    for r in rows:
        took[r.doc_id] += len(r.text.encode().split())
    want = Counter()
    for r in mixing.taken(docs).collect():
        want[r.doc_id] += r.taken
    assert +took == +want


def test_bpe(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_bpe_path())
    got = bpe.bpe_encode(docs, word_bpe_path()).collect()
    want = Counter()
    for r in awkward():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], tuple(ids), library.decode(ids, skip_special_tokens=False))] += 1
    import array

    assert Counter((r.doc_id, tuple(array.array("I", bytes(r.ids))), bytes(r.decoded).decode()) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_toxicity(spark, docs):
    import random

    rng = random.Random(4)
    fill = lambda: " ".join(rng.choice(["ora", "beth", "cimo", "dalt", "envy", "furo", "gist", "holm", "ibex", "jolt"]) for _ in range(12))
    rows = [(i, f"{fill()} {'idiot' if i % 2 else 'friend'} {fill()} {'IDIOT!' if i % 2 else 'chum'} {fill()}", "en") for i in range(400)]
    known = spark.createDataFrame([(i, i % 2, i % 2) for i, *_ in rows] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = toxicity.toxicity(train, known).collect()
    assert len(found) == 400
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == r.doc_id % 2
        text = rows[r.doc_id][1]
        assert {text[s.start : s.end] for s in r.spans} == ({"idiot", "IDIOT"} if r.doc_id % 2 else set())
    odd = toxicity.toxicity(docs, known).collect()
    assert len(odd) == len(awkward()) and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in toxicity.toxicity(docs, known.limit(0)).collect()} == {odd and toxicity.Chain().score(0, [])}


def test_chain_in_one_step_is_forward_backward():
    import numpy as np

    chain = toxicity.Chain({"bad": 2.0}, -1.5, np.array([[0.4, -0.2], [-0.5, 0.3]]))
    n, at, scores = 40, [3, 4, 20], [2.0, 2.0, -0.7]
    emit = np.full(n, chain.bias)
    emit[at] += scores
    step, psi = np.exp(chain.trans), np.stack([np.ones(n), np.exp(emit)], axis=1)
    ahead, behind = [psi[0] * (np.array([0.5, 0.5]) @ step)], [np.ones(2)]
    for t in range(1, n):
        ahead.append((ahead[-1] @ step) * psi[t])
    for t in range(n - 2, -1, -1):
        behind.append(step @ (psi[t + 1] * behind[-1]))
    both = np.array(ahead) * np.array(behind[::-1])
    want = (both[:, 1] / both.sum(axis=1))[at]
    assert chain.marginals(n, at, scores) == pytest.approx(want.tolist())


def test_licenses(docs):
    got = {(r.doc_id, r.template_id, r.n_found, r.n_template) for r in licenses.license_scan(docs).collect()}
    assert got == {(16, "MIT", 1, 1), (17, "MIT", 1, 1)}
    long = docs.sparkSession.createDataFrame([(1, LONG + " " + licenses.NOTICES[1][1] + " " + LONG)], "doc_id long, text string")
    assert [(r.template_id, r.containment) for r in licenses.license_scan(long).collect()] == [("Apache-2.0-header", 1.0)]
    cut = " ".join(licenses.NOTICES[1][1].split()[:20])
    part = docs.sparkSession.createDataFrame([(1, cut)], "doc_id long, text string")
    assert licenses.license_scan(part).collect() == []


def brute_components(rows, per_cent=80):
    sets = defaultdict(set)
    for i, text in rows:
        w = (text or "").encode().lower().split()
        n = min(4, len(w))
        sets[i] |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    label = {i: i for i in sets}
    low = lambda i: -(2**63) if i is None else i
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
                    m = min(label[a], label[b], key=low)
                    if label[a] != m or label[b] != m:
                        label[a] = label[b] = m
                        moved = True
    return label, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("block", [500_000, 200])
def test_near_dedup(spark, docs, block):
    import random

    rng = random.Random(5)
    words = [f"v{i}" for i in range(3000)]
    rows = [(r[0], r[1]) for r in awkward()]
    for g in range(12):
        start = [rng.choice(words) for _ in range(80)]
        for c in range(8):
            copy = list(start)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(80)] = rng.choice(words)
            rows.append((1000 + 10 * g + c, " ".join(copy)))
    label, sizes = brute_components(rows)
    table = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, id int, component string")
    got = near_dedup.near_dedup(table, block=block).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.component_id, r.n_shingles, r.kept) == (label[r.doc_id], sizes[r.doc_id], r.doc_id == label[r.doc_id]), r.doc_id


def test_components_of_chains_stars_and_pairs(spark):
    import random

    rng = random.Random(7)
    names = rng.sample(range(10_000), 1300)
    chain = list(zip(names[:900], names[1:900], strict=False))
    star = [(names[900], x) for x in names[901:1200]]
    pairs = list(zip(names[1200::2], names[1201::2], strict=True))
    edges = [(min(e), max(e), rng.randrange(40)) for e in chain + star + pairs]
    got = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long, key long"), "key").collect()}
    want = dict.fromkeys(names[:900], min(names[:900])) | dict.fromkeys(names[900:1200], min(names[900:1200])) | {x: min(e) for e in pairs for x in e}
    assert got == want
    assert near_dedup.components(spark.createDataFrame([], "a long, b long, key long"), "key").collect() == []


def test_forest_finds_pairs_at_the_threshold(spark):
    """Recall of the candidates, measured on pairs of sets whose similarity is 0.8 or just above."""
    import numpy as np

    rng, found, n = np.random.default_rng(8), 0, 300
    for _ in range(n):
        sets = rng.integers(0, 2**64, 110, dtype=np.uint64)
        pools = np.array([near_dedup.signature(np.sort(sets[:99])), near_dedup.signature(np.sort(sets[11:]))])  # 88 of 110
        high, low = near_dedup.labels(pools)
        found += bool((near_dedup._shared(high[0] ^ high[1], low[0] ^ low[1]) >= near_dedup.DEPTH).any())
    assert found >= 0.99 * n


def test_regions_of_the_forest():
    """Rows in order -> regions, in batches of any size, against the definition by whole tables."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    values = rng.integers(0, 2, (900, 8)) * rng.integers(0, 2, (900, 1)) + rng.integers(0, 3, (900, 8)) * (rng.random((900, 8)) < 0.2)
    values[:, :3] = 7
    values = values[np.lexsort(values.T[::-1])]
    halves = [sum(values[:, h + i].astype(np.uint64) << np.uint64(48 - 16 * i) for i in range(4)) for h in (0, 4)]
    want = set()
    for d in (4, 5, 6):
        groups = defaultdict(list)
        for i, v in enumerate(values.tolist()):
            groups[tuple(v[:d])].append(i)
        for prefix, rows in groups.items():
            above = [len([1 for v in values.tolist() if tuple(v[:e]) == prefix[:e]]) for e in range(4, d)]
            if all(n > near_dedup.SPARSE for n in above) and (d == 6 or len(rows) <= near_dedup.SPARSE) and len(rows) > 1:
                want |= {(prefix, i, rows[max(0, k - 1)]) for k, i in enumerate(rows)}
    for size in (1, 7, 100, 2000):
        columns = [pa.array(halves[0].view(np.int64)), pa.array(halves[1].view(np.int64)), pa.array(np.arange(900))]
        batches = pa.RecordBatch.from_arrays(columns, ["high", "low", "id"])
        out = [r for b in near_dedup._near(iter([batches.slice(i, size) for i in range(0, 900, size)])) for r in b.to_pylist()]
        assert {(r["id"], r["before"]) for r in out} == {(i, b) for _, i, b in want} and len(out) == len(want)
        keys = {p: {r["key"] for r in out if (p, r["id"], r["before"]) in want} for p, *_ in want}
        assert all(len(k) == 1 for k in keys.values()) and len({next(iter(k)) for k in keys.values()}) == len(keys)


def brute_ctw(train, text, depth):
    """Context-tree weighting by recursion over the bits of every training byte."""
    counts = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)

    def bits(data):
        data = bytes([ctw.END]) * depth + data + bytes([ctw.END])
        for i in range(depth, len(data)):
            node = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                yield [(data[i - d : i][::-1], node) for d in range(depth + 1)], bit
                node = 2 * node + bit

    for t in train:
        for path, bit in bits(t):
            for d, (ctx, node) in enumerate(path):
                counts[ctx, node][bit] += 1
                if d < depth:
                    kids[ctx, node].add(path[d + 1])
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)
    memo = {}

    def weighted(s):
        if s not in memo:
            own = kt(counts[s])
            if len(s[0]) == depth:
                memo[s] = own
            else:
                product = sum(weighted(c) for c in kids[s])
                memo[s] = math.log(0.5) + max(own, product) + math.log1p(math.exp(-abs(own - product)))
        return memo[s]

    total = 0.0
    for path, bit in bits(text):
        one = 0.5
        for s in reversed(path):
            if s not in counts:
                one = 0.5
                continue
            n = counts[s]
            estimate = (n[1] + 0.5) / (sum(n) + 1)
            w = 1.0 if len(s[0]) == depth else math.exp(math.log(0.5) + kt(n) - weighted(s))
            one = w * estimate + (1 - w) * one
        total += math.log10(one if bit else 1 - one)
    return total


@pytest.mark.parametrize("most", [256, 3, 0])
def test_ctw(spark, docs, monkeypatch, most):
    """Whether contexts are dealt out by two bytes or by three makes no difference."""
    monkeypatch.setattr(ctw, "HOT", most)
    rows = [(r[0], r[1]) for r in awkward() if r[1] is None or len(r[1]) < 6000]
    table = spark.createDataFrame([(i, t, 1, True) for i, t in rows], "doc_id long, text string, block int, train boolean")
    got = ctw.score_documents(table, block_bytes=2000).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    streams = {t: ctw.stream((t or "").encode()) for _, t in rows}
    tokens = Counter()
    for i, t in rows:
        if not held(i):
            tokens.update([*streams[t][0], None])
    n, v = sum(tokens.values()), len(tokens)
    train = [streams[t][1] for i, t in rows if not held(i)]
    want, seen = Counter(), {}
    assert len(got) == len(rows)
    for r in got:
        want[r.doc_id] += 1
    assert want == Counter(i for i, _ in rows)
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(t)
    for r in got:
        text = by_id[r.doc_id][0]
        words = [*streams[text][0], None]
        base = sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(words), sum(tokens[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        if len(words) < 70:
            if text not in seen:
                seen[text] = brute_ctw(train, streams[text][1], ctw.DEPTH)
            assert r.score == pytest.approx(seen[text], rel=1e-5, abs=1e-5)


def test_a_byte_model_sums_to_one():
    import numpy as np

    texts = [ctw.stream(t.encode())[1] for t in ("the cat sat on the mat", "a cat and a hat", "")]
    keys, counts = np.unique(ctw.grams(texts)[0], return_counts=True)
    tree = ctw.Subtree(keys, counts)
    node = tree.levels[2][0]
    roof = ctw.build_roof((node >> np.uint64(16)).astype(np.int64), (node & np.uint64(255)).astype(np.int64), tree.zero, tree.one, tree.weighted)
    for key in keys[[0, 7, 20]]:
        all_bytes = (key >> np.uint64(8) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** ctw.predict(all_bytes, tree, roof)).sum() == pytest.approx(1.0)


def test_empty_tables(spark, none):
    assert exact_dedup.exact_dedup(none).collect() == []
    assert sharding.byte_shards(none).collect() == []
    assert mixing.taken(none).collect() == []
    assert mixing.mixed_documents(none.select("doc_id", "text", "lang", "source", "n_chars")).collect() == []
    assert bpe.bpe_encode(none, word_bpe_path()).collect() == []
    assert toxicity.toxicity(none, spark.createDataFrame([], "doc_id long, toxic int")).collect() == []
    assert licenses.license_scan(none).collect() == []
    assert near_dedup.near_dedup(none).collect() == []
    assert ctw.score_documents(none).collect() == []


def test_licenses_of_all_kinds(spark):
    from importlib.resources import files

    whole = files("lamplight.llm").joinpath("license_texts")
    gpl = whole.joinpath("GPL-3.0.txt").read_text(encoding="utf-8")
    texts = {
        1: "All rights reserved.",
        2: "Some words first. Licensed under the MIT License. And more.",
        3: "This work is licensed under the GNU General Public License, version 2.",
        4: "See. Licensed under CC BY-SA 4.0, please",
        5: gpl,
        6: licenses.HEADERS[5][1],
        7: "SPDX-License-Identifier: MIT",
        8: "all of the rights were reserved",
        9: LONG + " " + whole.joinpath("ISC.txt").read_text(encoding="utf-8"),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = defaultdict(set)
    for r in licenses.license_scan(docs).collect():
        got[r.doc_id].add(r.template_id)
    assert got[1] == {"All-rights-reserved"} and got[2] == {"MIT-licensed-0"} and got[3] == {"GPL-2-licensed-0"}
    assert got[4] == {"CC-BY-SA-4.0-licensed-0"} and got[5] == {"GPL-3.0-text"} and got[6] == {"AGPL-3.0-header"}
    assert got[7] == {"MIT-spdx"} and 8 not in got and got[9] == {"ISC-text"}
    own = spark.createDataFrame([("s", "the end")], "template_id string, text string")
    twice = spark.createDataFrame([(1, "The end is near; the end."), (2, "the ending"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in licenses.license_scan(twice, own).collect()] == [(1, "s", 1.0, 1, 1, 0, 4)]
