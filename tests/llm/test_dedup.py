"""Substring, line, MinHash and embedding dedup against brute force."""
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embedding_forest, line_dedup, minhash_forest, substring_dedup
from tessera.llm.hashing import chunks, grams, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, rid string, row int, `a.b` string"


def frame(spark, docs):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], SCHEMA)


def words_of(n, seed, size=5000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def texts():
    a, b, c = words_of(120, 1), words_of(90, 2), words_of(60, 3)
    return [
        (1, " ".join(a)), (2, " ".join(b + a[20:70] + c)), (3, "\t".join(a)), (4, " ".join(c + words_of(30, 9))),
        (5, None), (6, ""), (7, "one two"), (8, "same " * 100), (9, " ".join(b[:40]) + "\né ü 日本 " + " ".join(b[40:])),
        (10, " ".join(words_of(30, 5) + a[:35] + words_of(30, 6))), (11, " ".join(words_of(30, 7) + a[:34] + words_of(30, 8))),
        (12, "x"), (12, "x"), (None, " ".join(a[60:])), (13, " ".join(words_of(3000, 11)))]


def brute_substring(docs, length=35):
    lists = [(i, WORD.findall(t or "")) for i, t in docs]
    seen = {}
    for _, w in lists:
        for p in range(len(w) - length + 1):
            seen[tuple(w[p:p + length])] = seen.get(tuple(w[p:p + length]), 0) + 1
    out = []
    for i, w in lists:
        gone = set()
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p:p + length])] > 1:
                gone.update(range(p, p + length))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), kept))
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_substring_matches_brute_force(spark):
    out = substring_dedup.substring_dedup(spark, frame(spark, texts()))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()]
    assert key(got) == key(brute_substring(texts()))
    spans = {r.doc_id: r.removed for r in out.collect()}
    assert [(s.start, s.end) for s in spans[11]] == [] and [(s.start, s.end) for s in spans[10]] == [(30, 65)]


def test_substring_empty_table(spark):
    assert substring_dedup.substring_dedup(spark, frame(spark, [])).count() == 0


def test_grams_and_words_do_not_depend_on_place():
    import pyarrow as pa
    arr = pa.array(["alpha beta gamma", None, "", "beta gamma", "βeta gamma\x0bx"])
    got = []
    for lo, hi, buf, starts, ends, first in chunks(arr):
        h = word_hashes(buf, starts, ends)
        got += [h[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert got[0][1:] == got[3] and got[1] == got[2] == [] and len(got[4]) == 3 and got[4][1] == got[3][1]
    x = np.arange(50, dtype=np.uint64)
    assert grams(np.concatenate([x[7:], x]), 12)[43 + 7] == grams(x, 12)[7] and len(grams(x, 51)) == 0


def line_texts():
    long = "a line that is long enough"
    return [(3, f"{long}\nother text here too\n{long}"), (1, f"start\n  {long.upper()} \nend"), (2, f"{long}\nshort\nshort"),
            (4, None), (5, ""), (6, "\n\n"), (7, "short\nshort"), (8, "другая строка\nx"), (9, "другая строка \ny"), (9, "другая строка \ny"),
            (10, "ünïcödé77\nünïcödé77"), (11, "ünïcödé77"), (12, long + "\n" + long), (None, "only here, with null id"), (13, "only here, with null id")]


def brute_lines(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(i, (t or "").split("\n")) for i, t in docs]
    k = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    order = lambda i: -(1 << 63) if i is None else i
    least = {}
    for i, lines in rows:
        for x in lines:
            if len(k(x)) >= 10:
                least[k(x)] = min(least.get(k(x), 1 << 62), order(i))
    out = []
    for i, lines in rows:
        kept = [x for x in lines if len(k(x)) < 10 or least[k(x)] == order(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_lines_match_brute_force(spark, batches):
    out = line_dedup.line_dedup(spark, frame(spark, line_texts()), batches=batches)
    assert out.columns == ["doc_id", "text", "rid", "row", "a.b", "line_stats"]
    got = [(r.doc_id, r.text, r.line_stats.n_lines, r.line_stats.n_dropped) for r in out.collect()]
    assert key(got) == key(brute_lines(line_texts()))


def test_lines_empty_table(spark):
    assert line_dedup.line_dedup(spark, frame(spark, [])).count() == 0


def near_texts():
    base = words_of(200, 21)
    docs = [(100, " ".join(base)), (101, " ".join(base).upper())]
    for n in range(40):  # from no to many replaced words
        rng = random.Random(n)
        w = list(base)
        for _ in range(n // 4):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
        docs.append((200 + n, " ".join(w)))
    docs += [(n, " ".join(words_of(100, 1000 + n))) for n in range(300, 320)]
    return docs + [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "b a"), (50, "a b"), (50, "a b"), (None, "a b"), (7, "é " * 30), (8, "é " * 6)]


def brute_near(docs, percent=85):
    sets = []
    for i, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[p:p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for x in range(len(docs)):
        for y in range(x):
            a, b = docs[x][0], docs[y][0]
            if a is not None and b is not None and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(docs, sets)]


@pytest.mark.parametrize("block", [2048, 7])
def test_near_duplicates_match_brute_force(spark, block):
    out = minhash_forest.near_duplicates(spark, frame(spark, near_texts()), block=block)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()]
    assert key(got) == key(brute_near(near_texts()))


def test_near_duplicates_empty_table(spark):
    assert minhash_forest.near_duplicates(spark, frame(spark, [])).count() == 0


def test_dense_regions_are_cut_deeper():
    v = np.array([[1, 1, 1, 1]] * 5 + [[1, 1, 1, 2]] * 5 + [[1, 2, 0, 0]], np.uint32)
    assert minhash_forest.prefix_runs(v, 2, 100).sum() == 2
    assert minhash_forest.prefix_runs(v, 2, 8).sum() == 3


def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(300)]
    for i in range(120):
        x = np.array(rows[i % 20][1]) + rng.standard_normal(16) * 0.15 * (i % 4)
        rows.append((1000 + i, x.tolist()))
    dup = rows[0][1]
    rows += [(2000, dup), (2001, dup), (2001, dup), (2002, [2 * x for x in dup]), (3000, None), (3001, [0.0] * 16), (3002, [float("nan")] + [1.0] * 15),
             (3003, [None] + [1.0] * 15), (3004, [float("inf")] + [1.0] * 15), (3005, []), (3006, [1.0, 0.0]), (3007, [2.0, 0.0]), (None, dup)]
    return rows


def brute_vectors(rows, least=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows
          if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    n = [0] * len(ok)
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in range(len(ok)):
        for b in range(a):
            x, y = ok[a][1], ok[b][1]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                n[a] += 1
                n[b] += 1
                u, v = find(ok[a][0]), find(ok[b][0])
                root[max(u, v)] = min(u, v)
    out = [(i, k, find(i), find(i) == i) for (i, _), k in zip(ok, n)]
    usable = [i for i, _ in ok]
    for i, _ in rows:
        if i in usable:
            usable.remove(i)
        else:
            out.append((i, 0, i, True))
    return out


def test_embeddings_match_brute_force(spark):
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors()], "vec_id long, embedding array<float>, weight int")
    as_float = [(r.vec_id, r.embedding) for r in df.collect()]
    for block, leaf in ((2048, 256), (16, 32)):
        out = embedding_forest.embedding_near_duplicates(spark, df, block=block, leaf=leaf)
        got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()]
        assert key(got) == key(brute_vectors(as_float))


def test_tiny_and_huge_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(8)
    far = rng.standard_normal((150, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(far)]
    rows += [(1000 + i, (x + rng.standard_normal(16) * 0.02).tolist()) for i, x in enumerate(far)]
    rows += [(2000 + i, (x * (1e-30, 1e30, 1e-160, 1e200)[i % 4]).tolist()) for i, x in enumerate(far[:40])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_vectors([(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows])
    for block, leaf in ((2048, 256), (16, 32)):
        out = embedding_forest.embedding_near_duplicates(spark, df, block=block, leaf=leaf)
        assert key((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()) == key(want)


def test_embeddings_recall_of_small_leaves():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.standard_normal(x.shape) * 0.3 / 8  # cosine about 0.957
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (x * y).sum(axis=1) >= 0.95
    found = np.zeros(4000, bool)
    for seed in range(embedding_forest.TREES):
        tree = embedding_forest.ProjectionTree(x[:2000].astype(np.float32), 4, embedding_forest.SPILL, seed)
        leaves = []
        for z in (x, y):
            row, node = tree.leaves(z.astype(np.float32))
            s = [set() for _ in range(4000)]
            for r, q in zip(row, node):
                s[r].add(q)
            leaves.append(s)
        found |= np.array([bool(a & b) for a, b in zip(*leaves)])
    assert near.sum() > 1000 and found[near].mean() >= 0.99


def test_embeddings_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_forest.embedding_near_duplicates(spark, df).count() == 0


def test_components_of_a_long_path(spark):
    from tessera.llm.common import Scratch
    from tessera.llm.graph import connected_components
    ids = list(range(60))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids[:40], ids[1:41]), (ids[50], ids[51]), (ids[52], ids[52])], "u long, v long")
    got = {r.id: r.component for r in connected_components(spark, edges, Scratch(spark, "t")).collect()}
    assert set(got) == set(ids[:41]) | {ids[50], ids[51]}
    assert {got[i] for i in ids[:41]} == {min(ids[:41])} and got[ids[50]] == min(ids[50], ids[51])


def test_query_digest(spark, tmp_path):
    df = spark.createDataFrame([(1, "A b  c"), (2, None)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in substring_dedup.op1_substring_dedup(spark, str(tmp_path)).collect()}
    assert got[1].kept_sha256 == hashlib.sha256(b"A b c").hexdigest() and got[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert df.select(F.sha2("text", 256)).first()[0] == hashlib.sha256(b"A b  c").hexdigest()


def linked_components(rows, near):
    """Smallest id reachable per id; rows that share an id are one node."""
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(rows):
        for j, y in rows[:a]:
            if near(x, y):
                u, v = find(i), find(j)
                parent[max(u, v)] = min(u, v)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("block", [4, 2048])
def test_reused_ids_keep_the_links_of_all_their_texts(spark, block):
    rng = random.Random(block)
    rows, base = [], 0
    for group in range(12):
        texts_ = [[f"g{group}t{t}w{rng.randrange(10**6)}" for _ in range(120)] for t in range(4)]
        for _ in range(10):
            t = list(rng.choice(texts_))
            if rng.random() < 0.7:
                t[rng.randrange(120)] = f"new{rng.randrange(10**6)}"
            rows.append((base + rng.randrange(6), " ".join(t)))
        base += 10
    rows += [(1000, "a b c d e f g " * 20), (1000, "p q r s t u v " * 20), (1001, "a b c d e f g " * 20), (1002, "p q r s t u v " * 20)]
    shingles = [(i, {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)}) for i, t in rows]
    want = linked_components(shingles, lambda x, y: 100 * len(x & y) >= 85 * len(x | y))
    got = minhash_forest.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == set(want.items())
    assert want[1001] == want[1002] == 1000 and len(set(want.values())) < len(want)


def test_reused_ids_keep_the_links_of_all_their_vectors(spark):
    at = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]
    rows = [(1, at(0)), (1, at(86)), (2, at(2.9)), (3, at(88.8))]
    got = {(r.vec_id, r.n_links, r.component_id) for r in embedding_forest.embedding_near_duplicates(
        spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (3, 1, 1)}
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 16))
    rows = [(int(rng.integers(0, 60)), (centers[rng.integers(0, 30)] + rng.normal(size=16) * 0.12).tolist()) for _ in range(150)]
    rows += [(70, rows[0][1]), (70, rows[1][1]), (71, rows[2][1]), (71, rows[2][1])]

    def near(x, y):
        return np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95

    comp = linked_components(rows, near)
    want = sorted((i, sum(near(x, y) for k, (_, y) in enumerate(rows) if k != n), comp[i]) for n, (i, x) in enumerate(rows))
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_forest.embedding_near_duplicates(
        spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=16).collect())
    assert got == want
