"""Periodic runs, centroid clusters and license templates against brute force."""
import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import centroid_clusters as C
from tessera.llm import license_scan as L
from tessera.llm import periodic_runs as P

SPACES = " \t\n\x0b\x0c\r"


# ------------------------------------------------------------- periodic runs

def words_of(text):
    return re.findall(f"[^{SPACES}]+", text or "")


def brute_runs(x):
    """Every period, every stretch, smallest periods only."""
    out, n = [], len(x)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(24, 3 * q) and not any(
                    all(x[i + k] == x[i + k + p] for k in range(size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_kept(x, runs):
    return [w for i, w in enumerate(x) if not any(s + q <= i < s + n for s, n, q in runs)]


@pytest.mark.parametrize("b", [8, 32, 64, 256, 4096])
def test_transform_gives_squared_differences_modulo_the_prime(b):
    rng = np.random.default_rng(b)
    x, y = rng.integers(0, P.PRIME, (2, b)), rng.integers(0, P.PRIME, (2, 2 * b))
    y[1, 5:5 + b] = x[1]
    got = P.squared_differences(x.astype(float), y.astype(float))
    for d in (0, 1, 5, b - 1):
        want = [sum((int(u) - int(v)) ** 2 for u, v in zip(x[r], y[r, d:d + b])) % P.PRIME for r in range(2)]
        assert got[:, d].tolist() == want
    assert got[1, 5] == 0


def random_text(rng):
    parts = []
    for _ in range(rng.integers(1, 6)):
        p = int(rng.integers(1, 50))
        unit = rng.integers(0, 3 if rng.random() < 0.5 else 500, p)
        parts += [np.resize(unit, int(rng.integers(1, 6 * p + 30))), rng.integers(0, 40, int(rng.integers(0, 20)))]
    return " ".join(f"w{v}" for v in np.concatenate(parts))


def fibonacci_words(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return " ".join(b[:n])


def test_runs_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    texts = [random_text(rng) for _ in range(40)] + [
        None, "", "one", "  \n\t ", "x " * 30, "x\ty\n" * 400, fibonacci_words(700), "é ü " * 12 + "é", "a b c d " * 6 + "a b c d"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(3, texts[3], 0), (None, texts[4], 0)],
                                 "doc_id long, text string, periodic int")
    rows = P.periodic_runs(spark, docs).collect()
    assert len(rows) == len(texts) + 2 and sum(len(r.periodic.runs) for r in rows) > 100
    for r in rows:
        x = words_of(r.text)
        runs = brute_runs(x)
        assert [tuple(u) for u in r.periodic.runs] == runs and r.periodic.n_words == len(x)
        assert r.periodic.collapsed == " ".join(brute_kept(x, runs))


def test_one_long_text_and_large_periods(spark):
    rng = np.random.default_rng(1)
    unit = [f"u{v}" for v in rng.integers(0, 10**6, 30_000)]
    x = ["start"] + unit * 3 + unit[:17]
    docs = spark.createDataFrame([(1, " ".join(x)), (2, "a " * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r.periodic for r in P.periodic_runs(spark, docs).collect()}
    assert [tuple(u) for u in got[1].runs] == [(1, 90_017, 30_000)] and got[1].collapsed == " ".join(x[:30_001])
    assert [tuple(u) for u in got[2].runs] == [(0, 100_000, 1)] and got[2].collapsed == "a"


def test_blocks_above_the_largest_are_searched_by_their_first_words(monkeypatch):
    monkeypatch.setattr(P, "LARGEST", 16)
    x = np.resize(np.random.default_rng(2).permutation(150), 700)
    found = [(b, s, q) for b, s, q in P.block_seeds(x, np.array([0, len(x)]))]
    assert P.find_runs(x, found) == [(0, 700, 150)]


def test_op11_reads_the_contracts_order(spark, tmp_path):
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0][:12] + [1, 2]
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"t{v}" for v in rng.integers(0, 300, int(rng.integers(1, 200))))) for i in ids] + [(5000, None), (5001, "z " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in P.op11_periodic_runs(spark, str(tmp_path)).collect()}
    some = 0
    for i, text in rows:
        x, h = words_of(text), zlib.crc32(str(i).encode())
        if h % 10 == 0 and x:
            g, n = h // 10, len(x)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            x = [x[k] if k < a else x[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(x)
        some += bool(runs)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
        r = got[i]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(brute_kept(x, runs)).encode()).hexdigest()
    assert some >= 5


def test_runs_of_an_empty_table(spark):
    assert P.periodic_runs(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --------------------------------------------------------- centroid clusters

def brute_clusters(rows, k=8, rounds=10, seed=3, dims=64):
    kept = [(i, [int(np.floor(1024 * float(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in order[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
        return min(range(len(d)), key=lambda i: (d[i], i)), min(d)

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[0], []).append(v)
        for c, g in groups.items():
            cents[c] = [sum(col) // len(g) for col in zip(*g)]
    out = [(i, *nearest(v)) for i, v in kept]
    total = {}
    for _, c, d in out:
        total[c] = total.get(c, 0) + d
    return sorted(((i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
                   for i, c, d in out), key=str)


def test_hilbert_neighbours_differ_in_one_step():
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    key = [k.tobytes() for k in C.hilbert_key(cells, 3)]
    assert len(set(key)) == len(cells)
    path = cells[sorted(range(len(cells)), key=key.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_box_bounds_never_lose_the_nearest_centroid():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x, cents = rng.integers(-9, 10, (20, 4)), rng.integers(-15, 16, (6, 4))
        able = C.candidates(x.min(0)[None], x.max(0)[None], cents)[0]
        d = ((x[:, None] - cents[None]) ** 2).sum(2)
        assert able[np.flatnonzero((d == d.min(1, keepdims=True)).any(0))].all()
    big = rng.integers(-2**27, 2**27, (5, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in big[:2]] for u in big]
    assert C.distances(big, big[:2]).tolist() == want


@pytest.mark.parametrize("block", [4, 256])
def test_clusters_equal_brute_force(spark, block):
    rng = np.random.default_rng(block)
    centers = rng.normal(size=(5, 64))
    rows = [(i, [float(c) for c in centers[i % 5] * 0.3 + rng.normal(size=64) * 0.05]) for i in range(150)]
    rows += [(150 + i, rows[0][1]) for i in range(60)] + [(7, rows[8][1]), (7, rows[8][1]), (None, rows[3][1])]
    bad = list(rows[1][1])
    rows += [(900, None), (901, []), (902, bad[:63]), (903, bad + [1.0]), (904, bad[:-1] + [None]), (905, bad[:-1] + [float("nan")]),
             (906, bad[:-1] + [float("-inf")]), (907, [0.0] * 64), (908, [-0.0005] * 64)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cluster int, v int").repartition(3)
    got = sorted((tuple(r) for r in C.cluster_vectors(spark, df, block=block).collect()), key=str)
    assert got == brute_clusters(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-1e30] * 64)]
    got = {r.vec_id: r for r in C.cluster_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert set(got) == {1, 2, 3} and all(r.distance == 0 for r in got.values()) and got[1].cluster == got[2].cluster != got[3].cluster
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    out = C.cluster_vectors(spark, none)
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


# --------------------------------------------------------- license templates

def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def backtracked(markup, words):
    """Whether some beginning of words reads as the markup, by trying every way."""
    pieces = re.findall(r"\[\[|\]\]|\{\{[^{}]*\}\}|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", markup.lower())

    def read(k, i):
        if k == len(pieces):
            return True
        piece = pieces[k]
        if piece == "[[":
            depth, end = 1, k + 1
            while depth:
                depth += {"[[": 1, "]]": -1}.get(pieces[end], 0)
                end += 1
            return read(k + 1, i) or read(end, i)
        if piece == "]]":
            return read(k + 1, i)
        if piece.startswith("{{"):
            least, _, most = piece[2:-2].split(":")[1].partition("-")
            return any(i + n <= len(words) and read(k + 1, i + n) for n in range(int(least), int(most or least) + 1))
        return i < len(words) and words[i] == piece and read(k + 1, i + 1)

    return read(0, 0)


def test_places_equal_backtracking(spark):
    rng = np.random.default_rng(4)
    templates = (("t1", "a b [[c [[d]] e]] {{x:0-2}} f"), ("t2", "b c {{x:1}} b"), ("t3", "f {{x:0-3}} a"), ("t4", "a a"))
    phrases = (("p", "a b"), ("q", "e"))
    vocabulary = ["a", "B", "c", "D", "e", "f"]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 40)))) for _ in range(60)] + [None, "", "a-b,c;F f"]
    docs = spark.createDataFrame([(t, 1, "x") for t in texts], "text string, doc_id int, license string")
    n = 0
    for r in L.scan_licenses(spark, docs, templates, phrases).collect():
        w = license_words(r.text)
        want = {(i, label, base) for shapes, base in ((phrases, True), (templates, False)) for label, m in shapes
                for i in range(len(w)) if backtracked(m, w[i:])}
        assert {(p.start, p.label, p.base) for p in r.license.places} == want and r.license.n_words == len(w)
        assert all(backtracked(dict(templates + phrases)[p.label], w[p.start:p.stop]) for p in r.license.places)
        n += len(want)
    assert n > 200


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"""


def test_license_texts(spark, tmp_path):
    rows = [(1, MIT), (2, MIT.replace("publish", "print")), (3, "Released under the\nMIT--License"), (4, "GNU General\tPublic License " * 3),
            (5, "licensed under the terms of the gnu general public license version 3"), (6, None), (7, "cc by"), (8, "ccby mit licenses éa"),
            (9, "Licensed under Creative Commons Attribution-ShareAlike 4.0 International License"), (9, "x " * 200_000 + "MIT license")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(L.op13_license_templates(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.n_words))
    labels = [(r.doc_id, r.base_labels, r.labels, r.score) for r in got]
    assert labels == [(1, "", "mit-permission", 0.75), (2, "", "", 0.0), (3, "mit", "mit,mit-grant", 0.875), (4, "gpl", "gpl", 0.5),
                      (5, "gpl", "gpl,gpl-grant", 0.875), (6, "", "", 0.0), (7, "cc-by", "cc-by", 0.5), (8, "", "", 0.0),
                      (9, "", "cc-by-grant", 0.75), (9, "mit", "mit", 0.5)]
    assert [(r.n_base, r.first_word, r.last_word) for r in got if r.doc_id in (4, 6, 9)] == [
        (3, 0, 8), (0, None, None), (0, None, None), (1, 200_000, 200_000)]
    assert got[7].n_words == 4


def test_template_markup_is_checked(spark):
    for markup in ("[[a]] b", "{{x:2}} a", "a [[b", "a b]]"):
        with pytest.raises(ValueError):
            L.compile_template("t", markup)
    assert L.scan_licenses(spark, spark.createDataFrame([], "text string")).count() == 0
