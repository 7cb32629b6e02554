"""Operators across documents, held against plain Python."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tallyforge.llm import graph, mixing, neardup, repeats, topk

from .conftest import collected, key, prose


def shingle_set(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def plain_classes(rows):
    """Row number to (least id of the class, links)."""
    sets = [shingle_set(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 5 * len(a & b) >= 4 * len(a | b):
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    ids = {}
    for k, (d, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in ids.items()}
    return sorted(((d, least[find(k)], links[k]) for k, (d, _) in enumerate(rows)), key=key)


def test_jaccard_on_odd_rows(spark, sf, rows):
    assert collected(neardup.op3_jaccard(spark, sf)) == plain_classes([r[:2] for r in rows])


@pytest.mark.parametrize("block", [neardup.BLOCK, 16])
def test_jaccard_on_near_copies(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rnd = random.Random(3)
    base = [prose(100 + k, 150).split() for k in range(6)]
    rows = []
    for k in range(240):
        w = list(base[min(k % 12, 5)])
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 4, 6, 9])):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_classes(rows)
    assert sum(n for _, _, n in want) > 2000
    assert collected(neardup.op3_jaccard(spark, str(tmp_path))) == want


def test_one_kept_of_each_class(docs):
    out = neardup.classes(docs).where("kept").select("class_id", "th").distinct().count()
    assert out == neardup.classes(docs).where("kept and class_id is not null").select("class_id", "th").distinct().count() + neardup.classes(docs).where("kept and class_id is null").select("th").distinct().count()


def test_pruning_bound():
    assert neardup.least_matches(16) < 16 * 0.8 and neardup.least_matches(128) < 128 * 0.8
    x = [np.unique(np.random.default_rng(k).integers(0, 400, 300)).astype(np.uint64) for k in range(40)]
    i, j = np.triu_indices(40, 1)
    assert neardup.overlaps(x, x, i, j).tolist() == [len(np.intersect1d(x[a], x[b])) for a, b in zip(i, j, strict=True)]


def test_components(spark):
    edges = [(k + 1, k) for k in range(100, 140)] + [(7, 3), (3, 9), (9, 11), (11, 12), (500, 501), (501, 500), (5, 5)] + [(900, 1000 + k) for k in range(50)]
    got = dict(graph.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[k] == 100 for k in range(100, 141)) and {got[k] for k in (3, 7, 9, 11, 12)} == {3}
    assert got[501] == got[500] == 500 and all(got[1000 + k] == 900 for k in range(50)) and 5 not in got
    assert graph.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_removed(texts, names):
    n, count = repeats.LENGTH, Counter()
    data = [(t or "").encode() for t in texts]
    held = {}
    for b, name in zip(data, names, strict=True):
        for i in range(len(b) - repeats.PASSAGE + 1):
            held.setdefault(b[i : i + repeats.PASSAGE], set()).add(name)
    for b in data:
        count.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for b in data:
        told = np.zeros(len(b), bool)
        for i in range(len(b) - repeats.PASSAGE + 1):
            if len(held[b[i : i + repeats.PASSAGE]]) > 1:
                told[i : i + repeats.PASSAGE] = True
        passages = sum(len(b[i:j].split()) > repeats.WORDS for i, j in repeats.runs(told))
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), len(repeats.runs(gone)), hashlib.sha256(kept).hexdigest(), passages, passages > 0))
    return out


@pytest.mark.parametrize(("hot", "shard"), [(repeats.HOT, repeats.SHARD), (repeats.HOT, 7), (2, 16)])
def test_repeats(spark, tmp_path, monkeypatch, rows, hot, shard):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SHARD", shard)
    monkeypatch.setattr(repeats, "BUCKET", 4 * shard)
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcd é") for _ in range(3000))
    texts = [base[:1500], base[700:1200] + "x" + base[1201:2500], "a" * 1500, "zz" + "a" * 401, base[100:499], base[100:501], base[2000:] * 2, "q" * 399, "ab" * 300, base[:600] + "Q" * 50 + base[600:1200]]
    texts += ["".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 300))) + base[rnd.randint(0, 2000) :][: rnd.randint(300, 900)] + "".join(rnd.choice("xyz") for _ in range(200)) for _ in range(30)]
    passage = prose(40, 60)
    texts += [prose(41, 30) + " " + passage + prose(42, 20), prose(43, 9) + " " + passage, (prose(44, 45) + " ") * 3]
    texts.append(texts[-1][:-1])
    all_rows = [(r[0], r[1] if r[1] is None or len(r[1]) < 10_000 else r[1][:5000]) for r in rows] + list(enumerate(texts, 1000)) + [(1000, texts[0])]
    spark.createDataFrame(all_rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(((d, *x) for (d, _), x in zip(all_rows, plain_removed([t for _, t in all_rows], all_rows), strict=True)), key=key)
    assert collected(repeats.op5_repeats(spark, str(tmp_path))) == want


def test_anchors_do_not_depend_on_segments(monkeypatch):
    data = prose(5, 3000).encode()
    whole = repeats.anchors(data)
    monkeypatch.setattr(repeats, "_SEGMENT", 1500)
    assert all((a == b).all() for a, b in zip(whole, repeats.anchors(data), strict=True))


def plain_topk(rows, k=10):
    fit = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in fit:
        if i % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in fit if j != i and len(v) == len(q))[:k]
            out += [(i, n, j, -x) for n, (x, j) in enumerate(s, 1)]
    return sorted(out, key=key)


def test_topk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "SHARD", 64)
    rng = np.random.default_rng(1)
    rows = [(int(k), [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)]) for k in range(300)]
    rows += [(k, [0.5] * 8) for k in range(300, 330)] + [(400, None), (500, [float("nan")] * 8), (600, [None] * 8), (700, [float("inf")] + [0.0] * 7), (800, [1.0, 2.0]), (801, [3.0, 1.0]), (900, []), (100, [0.1] * 8), (None, [0.2] * 8)]
    rows += [(1000, [1e6] * 8), (1001, [-1e6] * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert collected(topk.op7_topk(spark, str(tmp_path))) == plain_topk(rows)


def test_topk_prunes():
    rng = np.random.default_rng(2)
    blocks = [(np.arange(a, a + 50), rng.normal(c, 1, (50, 4)).round()) for a, c in ((0, 100), (50, 0), (100, -100))]
    q = np.ones((1, 4))
    out, scored = topk.best(q, np.array([-1]), blocks, 5)
    assert scored == 50 and len(out) == 5
    # a floor that is known beforehand prunes the first block as well
    none, scored = topk.best(q, np.array([-1]), blocks, 5, np.array([1e6]))
    assert none == [] and scored == 0
    everything = sorted((-(q[0] @ v), i) for ids, m in blocks for i, v in zip(ids, m, strict=True))[:5]
    assert [(i, s) for _, i, s in out] == [(i, -s) for s, i in everything]


def water(sizes):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        rest = [s for s in names if s not in full]
        total = sum(w[s] for s in rest)
        new = {s for s in rest if left * w[s] / total >= 2 * sizes[s]} if total else set()
        if not new:
            return target | {s: left * w[s] / total for s in rest}
        for s in new:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in new)
        full |= new


def test_mixing(spark, sf, rows):
    got = mixing.op9_mixing(spark, sf).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = water(dict(sizes))
    by_target = {(sizes[s], round(t, 6)) for s, t in target.items()}
    for r in got:
        assert (r.source_size, round(r.target, 6)) in by_target
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
    assert collected(mixing.op9_mixing(spark, sf)) == sorted(map(tuple, got), key=key)


def test_mixing_meets_targets(spark, tmp_path):
    rows = [(k, " ".join(["w"] * (k % 90)), f"s{k % 7}" if k % 11 else None) for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    taken, target = Counter(), {}
    for r, (_, _, s) in zip(sorted(mixing.op9_mixing(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id), rows, strict=True):
        taken[s] += r.taken
        target[s] = r.target
    assert all(abs(taken[s] - t) <= 0.06 * t for s, t in target.items())
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r["__copies"] for r in mixing.mix(df).collect())
