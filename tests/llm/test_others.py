"""Chat formatting, top-k search and the pipeline."""

import hashlib
import random
from collections import defaultdict

import corpus_pipeline
from lamplight.llm import chat, topk


def test_chat(spark):
    turns = [
        (1, 0, "user", "hi <|end|> <! <!| <<|turn|>"), (1, 1, "assistant", "a<|says|>b</s>"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "user", "bye"),
        (2, 0, "user", "only"), (3, None, None, "x"), (3, 0, "assistant", "y"), (3, 0, "assistant", "y"), (None, 5, "assistant", "z" * 10_000), (4, 1, "assis<|tant", "q"),
    ]
    rng = random.Random(1)
    turns += [(9, t, "assistant" if t % 2 else "user", "".join(rng.choice("<|!>\\ aé😀\n") for _ in range(rng.randint(0, 30)))) for t in range(700)]
    frame = spark.createDataFrame([(*t, "e", 3) for t in turns], "conv_id long, turn long, role string, text string, example string, delta int")
    got = {r.conv_id: r for r in chat.read_back(chat.chat_examples(frame)).collect()}
    by = defaultdict(list)
    for c, t, role, text in turns:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, rows in by.items():
        rows.sort()
        loss = "".join(x for *_, role, x in rows if role == "assistant")
        assert got[c].n_turns == len(rows)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in rows).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = chat.chat_examples(frame).collect()
    for c, rows in by.items():
        mine = sorted((r for r in whole if r.conv_id == c), key=lambda r: r.example)
        replies = [i for i, (*_, role, _) in enumerate(rows) if role == "assistant"]
        ends = replies + ([len(rows) - 1] if not replies or replies[-1] < len(rows) - 1 else [])
        assert [chat.parse_turns(r.text) for r in mine] == [[x[2:] for x in rows[: e + 1]] for e in ends]
        assert [r.example for r in mine] == list(range(len(ends)))
        assert [chat.unescape(r.text[r.loss_start : r.loss_end]) if r.trainable else None for r in mine] == [rows[e][3] if e in replies else None for e in ends]
        assert got[c].formatted_chars == sum(len(r.text) for r in mine)
    assert chat.read_back(chat.chat_examples(frame.limit(0))).collect() == []


def brute_top(rows, queries, k):
    import math

    ints = lambda v: [math.floor(256 * x) for x in v]
    good = [(i, ints(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if i in queries and (i not in asked or v < asked[i]):
            asked[i] = v
    out = set()
    for q, v in asked.items():
        scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v)))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)}
    return out


def test_top_k(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(300)]
    rows += [(1000 + i, list(rows[50][1])) for i in range(40)]  # ties
    rows += [(400, None), (450, [0.1] * 15 + [None]), (500, [float("nan")] * 16), (550, [float("inf")] * 16), (None, [0.1] * 16), (600, [0.5, 0.5]), (601, [0.25, -1.0]), (650, [])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, rank string")
    monkeypatch.setattr(topk, "ROWS", 64)
    monkeypatch.setattr(topk, "SLICE", 2)
    monkeypatch.setattr(topk, "QUERIES", 3)
    got = {tuple(r) for r in topk.exact_top_k(frame, frame.filter("vec_id % 50 = 0")).collect()}
    assert got == brute_top(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 5)
    few = frame.filter("vec_id < 3 OR vec_id = 50")
    got = {tuple(r) for r in topk.exact_top_k(few, few.filter("vec_id = 50")).collect()}
    assert got == brute_top([r for r in rows if r[0] is not None and (r[0] < 3 or r[0] == 50)], {50}, 5)
    assert topk.exact_top_k(frame.limit(0), frame.limit(0)).collect() == []


def test_top_k_collects_only_what_the_cutoffs_admit():
    import numpy as np

    rng = np.random.default_rng(1)
    q, r = np.floor(rng.normal(0, 40, (20, 64))), np.floor(rng.normal(0, 40, (3000, 64)))
    scores = q @ r.T
    cutoff = np.sort(scores, axis=1)[:, -5]
    qs, rs, found = topk._collected(q, r, cutoff, topk._lists(64))
    assert (found == scores[qs, rs]).all() and len(set(zip(qs.tolist(), rs.tolist(), strict=True))) == len(qs) < 0.25 * scores.size
    assert {(i, j) for i, j in zip(*np.nonzero(scores >= cutoff[:, None]), strict=True)} <= set(zip(qs, rs, strict=True))


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows = [(1, "one two three four five", "x", "a.b"), (2, "one two three four five", "y", "c"), (3, "quite another text of some words", "z", "d"), (None, None, None, None), (3, "quite another text of some words", "z", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, kept_id string").withColumnRenamed("kept_id", "row")
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "_id", "row"]
    assert sorted((r.doc_id or 0, r._id) for r in docs.collect()) == [(0, None), (2, "y"), (3, "z")]


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(300):
        text = [rng.choice(words) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(6):
                text[rng.randrange(40)] = "vilify"
        docs.append((i, " ".join(text), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(toxic)))
    docs += [(900 + i, docs[1][1], "en", "s1", 1) for i in range(5)]  # exact copies
    near = docs[2][1].split()
    near[3] = "changed"
    docs += [(950, " ".join(near), "en", "s2", 1), (951, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        assert not name.startswith("bpe") or "n_tokens" in stage(spark, now, str(tmp_path)).columns
        out = stage(spark, now, str(tmp_path))
        if name != "bpe":
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/out/{name}")
        now = spark.read.parquet(f"{tmp_path}/out/{name}")
        kept[name] = [r.doc_id for r in now.select("doc_id").collect()]
    clean = {i for i in range(300) if i % 5} | {900, 901, 902, 903, 904, 950, 951}
    assert set(kept["toxicity"]) == clean
    assert set(kept["exact_dedup"]) == clean - {1, 900, 901, 902, 903} and len(kept["exact_dedup"]) == len(set(kept["exact_dedup"]))
    assert set(kept["near_dedup"]) == set(kept["exact_dedup"]) - {950}
    assert set(kept["mixing"]) <= set(kept["near_dedup"]) and set(kept["bpe"]) == set(kept["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["bpe"])
