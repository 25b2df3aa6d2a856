"""Chat formatting, quality, packing, decontamination, toxicity, personal data."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, decontaminate, packing, pii, quality, toxicity


def rnd(seed, n, size=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeiourstnlmd") for _ in range(rng.randrange(2, 9))) for _ in range(n))


# ---------------------------------------------------------------- packing

def test_packing_covers_every_token(spark):
    from tokenizers import Tokenizer
    docs = [(1, rnd(1, 3000)), (2, "Hello, it's O'Neil's naïve ÉCOLE… 3.14 x'. don't!!!\x1d日本語 áb ---"), (3, None), (4, ""), (5, "x " * 9000),
            (6, "<|endoftext|> A<|EndOfText|>b"), (6, "<|endoftext|> A<|EndOfText|>b"), (None, "null id"), (7, "ǅ İ ſ K ß ÿ ×a÷b")]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, piece string")
    path = packing.tokenizer_path()
    tok = Tokenizer.from_file(path)
    want = {}
    for i, t in docs:
        want.setdefault(i, []).append(np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4"))
    rows = packing.pack_documents(spark, df, path, with_ids=True).collect()
    seqs, pieces = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, copies in want.items():
        starts = sorted((r.start, r.length) for r in pieces[i])
        assert len(pieces[i]) == len(copies) * -(-len(copies[0]) // 4096)
        for r in pieces[i]:
            ids = copies[0][r.start:r.start + r.length].tobytes()
            assert bytes(r.ids) == ids and r.doc_tokens == len(copies[0])
        assert sum(n for _, n in starts) == sum(map(len, copies))
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 4096


def test_packing_empty_table(spark):
    assert packing.pack_documents(spark, spark.createDataFrame([], "doc_id long, text string"), packing.tokenizer_path()).count() == 0


@pytest.mark.parametrize("tiers", [packing.TIERS, (4096,), (512, 4096), (7, 99, 1234)])
def test_pack_lengths_little_padding_and_balance(tiers):
    rng = np.random.default_rng(1)
    lengths = np.concatenate([np.full(50, 4096), rng.integers(1, 4096, 3000), rng.integers(1, 300, 3000)])
    seq, off, padded = packing.pack_lengths(lengths, 4096, tiers)
    total = np.bincount(seq, lengths)
    assert (total <= padded).all() and set(padded) <= {*tiers, 4096}
    assert (total == padded)[padded < 4096].all()  # only the longest sequences have padding
    assert total.sum() / padded.sum() > 0.99
    order = np.lexsort((off, seq))
    follows = np.append(0, (off + lengths)[order][:-1]) * np.append(False, np.diff(seq[order]) == 0)
    assert (off[order] == follows).all()  # gapless from 0
    for tier in set(padded):
        cost = np.bincount(seq, lengths.astype(float) ** 2)[padded == tier]
        g = packing.step_groups(cost, 32)
        load = np.bincount(g, cost) / np.bincount(g)
        assert load.max() / load.min() < 1.5 and (tier < 4096 or load.max() / load.min() < 1.1)


def test_tiers_are_packed_by_themselves():
    """Each tier opens windows of its size, gaps of longer windows take shorter
    pieces, windows that stay open are put together."""
    at, off, size, used = packing.tier_windows(np.array([3000, 1000, 96, 400, 112, 900, 30]), (512, 1024, 2048, 4096))
    assert size.tolist() == [4096, 1024, 512] and used.tolist() == [3000 + 1000 + 96, 900 + 30, 400 + 112]
    assert at.tolist() == [0, 0, 0, 2, 2, 1, 1] and off.tolist() == [0, 3000, 4000, 0, 400, 0, 900]
    several = {t: packing.pack_lengths(np.random.default_rng(2).integers(1, 4096, 500), 4096, t)[0].tolist()
               for t in ((4096,), (512, 4096), (512, 1024, 2048, 4096))}
    assert len({tuple(v) for v in several.values()}) == 3
    empty = packing.pack_lengths(np.array([], int))
    assert [len(x) for x in empty] == [0, 0, 0]


def test_packed_tiers_and_groups(spark):
    docs = [(i, rnd(i, 20 + 37 * (i % 60))) for i in range(200)]
    out = packing.pack_documents(spark, spark.createDataFrame(docs, "doc_id long, text string"), packing.tokenizer_path(), step=4)
    rows = out.collect()
    tier, group, used = {}, {}, {}
    for r in rows:
        assert tier.setdefault(r.sequence_id, r.tier) == r.tier
        assert group.setdefault(r.step_group, r.tier) == r.tier  # groups have sequences of one tier
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert len(set(tier.values())) > 1
    want = {t: (sum(1 for v in tier.values() if v == t), sum(n for s, n in used.items() if tier[s] == t)) for t in set(tier.values())}
    assert {r.tier: (r.sequences, r.tokens) for r in packing.padding_by_tier(out).collect()} == want
    assert all(r.padding == r.tier * r.sequences - r.tokens for r in packing.padding_by_tier(out).collect())


def test_memo_may_be_emptied(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 40)
    tok = packing.WordTokenizer(packing.tokenizer_path())
    texts = [rnd(s, 30).encode() for s in range(6)] + [rnd(99, 200).encode()]
    got = [b"".join(p) for p in tok(texts)]
    monkeypatch.setattr(packing, "MEMO", 10 ** 6)
    assert got == [b"".join(p) for p in packing.WordTokenizer(packing.tokenizer_path())(texts)]


# ---------------------------------------------------------- decontamination

def levenshtein_in(pattern, text):
    """Least edits of the pattern with any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def leak_docs():
    item = rnd(50, 40)
    near = list(item)
    for p in range(20, len(near), 30):
        near[p] = "#"
    far = list(item)
    for p in range(0, len(far), 7):
        far[p] = "#"
    return item, [(1, rnd(2, 50) + " " + item.upper().replace(" ", "\n") + " " + rnd(3, 50)), (2, rnd(4, 30) + "".join(near) + rnd(5, 30)),
                  (3, "".join(far)), (4, rnd(6, 500)), (5, None), (6, ""), (7, item[:50]), (8, item[30:160]), (None, item), (1, item)]


def test_leaks_match_brute_force(spark):
    item, docs = leak_docs()
    bench = [(1, item), (2, rnd(60, 12)), (3, None), (None, "text without id that is long enough"), (4, "tiny"), (5, rnd(61, 30))]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in docs], "doc_id long, text string, body string, leaks string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    for slice_chars in (10 ** 6, 100):
        out = decontaminate.find_leaks(spark, df, b, slice_chars=slice_chars).collect()
        index = decontaminate.SegmentIndex([(i, t) for i, t in bench if i and t], 8, 80, 40, 0.08)
        for r in out:
            text = decontaminate.normalised(r.text or "")
            want = set()
            for item_id, seg, k in zip(index.item, index.text, index.edits):
                if levenshtein_in([chr(c) for c in seg], text) <= k:
                    want.add(item_id)
            assert {x.item_id for x in r.leaks} == want
        flagged = sorted((r.doc_id or 0) for r in out if r.leaks)
        assert flagged == [0, 1, 1, 2, 8]


def test_leaks_across_parts_of_a_long_text(monkeypatch):
    monkeypatch.setattr(decontaminate, "PART", 500)
    item = rnd(70, 20)[:90]
    index = decontaminate.SegmentIndex([(9, item)], 8, 80, 40, 0.08)
    for shift in range(400, 520, 7):
        found = index.leaks(rnd(71, 300)[:shift] + item + rnd(72, 300))
        assert [x["item_id"] for x in found] == [9] and found[0]["edits"] == 0


def test_excerpts_at_every_offset_are_found():
    item = decontaminate.normalised(rnd(80, 60))
    index = decontaminate.SegmentIndex([(9, item), (3, rnd(81, 60))], decontaminate.Q, decontaminate.SEGMENT, decontaminate.STRIDE, decontaminate.RATE)
    before, after = rnd(82, 20), rnd(83, 20)
    for o in range(len(item) - 80 + 1):
        for size, edits in ((80, 0), (74, 6), (80, 6)):
            part = list(item[o:o + size])
            if size == 80:
                for p in range(edits):
                    part[6 + 13 * p] = "#"
            found = index.leaks(f"{before}|{''.join(part)}|{after}")
            assert [x["item_id"] for x in found] == [9] and found[0]["edits"] <= edits
    assert not any(index.leaks(before + item[o:o + 60] + after) for o in range(0, len(item) - 60, 7))


def test_best_segment_matches_brute_force():
    items = [(1, decontaminate.normalised(rnd(90, 30))), (2, decontaminate.normalised(rnd(91, 9))), (3, "short one item")]
    index = decontaminate.SegmentIndex(items, 8, 80, 1, 0.08)
    rng = random.Random(4)
    for n in range(6):
        text = rnd(200 + n, 10)
        for _, t in items:
            t = list(t)
            for p in rng.sample(range(len(t)), len(t) * n // 60):
                t[p] = rng.choice(["", "#", t[p] + "x"])
            text += " " + "".join(t) + " " + rnd(300 + n, 5)
        text = decontaminate.normalised(text)
        want = {}
        for i, seg, k in zip(index.item, index.text, index.edits):
            e = levenshtein_in([chr(c) for c in seg], text)
            if e <= k:
                want[i] = min(e, want.get(i, k))
        assert {x["item_id"]: x["edits"] for x in index.leaks(text)} == want


def test_leaks_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(spark, docs, bench).count() == 0
    one = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert decontaminate.find_leaks(spark, one, bench).first().leaks == []


# ------------------------------------------------------------------ quality

def test_quality_separates_and_shrinks(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        t = "\n".join(rnd(i * 7 + j, 12).capitalize() + "." for j in range(6))
        if bad:
            t = " ".join(w + rng.choice(["***", "###", "$$$"]) for w in t.split())
        docs.append((i, t, "spam" if i % 50 == 0 else f"host{i % 7}", "en", "x"))
        if i % 2:
            labels.append((i, 0 if bad else 1))
        elif i % 3 == 0:
            labels.append((i, None))
    labels += [(i, 0) for i in range(0, 100, 10)]
    docs += [(900, None, None, None, "x"), (901, "", "spam", "en", "x"), (902, docs[1][1], "one", "en", "x"), (902, docs[1][1], "one", "en", "x"), (None, docs[1][1], "one", "en", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = quality.score_quality(spark, df, lab).collect()
    assert len(rows) == len(docs)
    by = {r.doc_id: r.quality for r in rows}
    assert all(by[i].kept == (i % 5 != 0) for i in range(400))
    assert 0 < by[900].score < 1
    # a section of few documents stays near the global rate
    rate = np.mean([r.quality.evidence for r in rows])
    assert abs(by[902].section_rate - rate) < 0.35


def test_quality_rates_match_brute_force(spark):
    docs = [(i, rnd(i, 20) + (" ***" * (i % 4)), f"s{i % 3}", f"l{i % 2}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    lab = spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(60)], "doc_id long, quality int")
    rows = {r.doc_id: r.quality for r in quality.score_quality(spark, df, lab).collect()}
    p = np.array([rows[i].evidence for i in range(60)])
    # labels are values of their group, and predictions by what they tell
    y = (np.arange(60) % 4 < 2).astype(float)
    own = np.maximum(0, 1 - p * (1 - p) / (y.mean() * (1 - y.mean())))
    v, w = np.concatenate([p, y]), np.concatenate([own, np.ones(60)])
    site, sec, rate = np.tile(np.arange(60) % 3, 2), np.tile(np.arange(60) % 6, 2), (v * w).sum() / w.sum()

    def strength(group, prior):
        sizes = np.bincount(group, w)
        means = np.bincount(group, v * w) / sizes
        inside = (w * (v - means[group]) ** 2).sum() / (w.sum() - len(sizes))
        between = ((sizes * (means - prior) ** 2).sum() - (len(sizes) - 1) * inside) / (w.sum() - (sizes ** 2).sum() / w.sum())
        return 1e6 if between <= 0 else min(1e6, max(1.0, inside / between))

    k1 = strength(site, rate)
    post = np.array([((v * w)[site == g].sum() + k1 * rate) / (w[site == g].sum() + k1) for g in range(3)])
    k2 = strength(sec, post[np.arange(6) % 3])
    for i in range(60):
        s = ((v * w)[site == site[i]].sum() - own[i] * p[i] + k1 * rate) / (w[site == site[i]].sum() - own[i] + k1)
        t = ((v * w)[sec == sec[i]].sum() - own[i] * p[i] + k2 * s) / (w[sec == sec[i]].sum() - own[i] + k2)
        assert rows[i].site_rate == pytest.approx(s, rel=1e-9) and rows[i].section_rate == pytest.approx(t, rel=1e-9)
        logit = lambda x: np.log(x / (1 - x))
        assert logit(rows[i].score) == pytest.approx(logit(p[i]) + logit(t) - logit(rate), rel=1e-6, abs=1e-9)


def test_quality_posteriors_change_decisions_of_a_host(spark):
    """Texts of one kind everywhere: the evidence cannot tell the hosts apart, their
    labels can; a host of few rows stays near all others."""
    docs = [(i, rnd(i, 30), f"host{i % 10}", f"path{i % 3}") for i in range(600)] + [(1000 + i, rnd(9000 + i, 30), "tiny", "path0") for i in range(2)]
    bad = {f"host{k}" for k in (3, 7)}
    labels = [(i, int(h not in bad)) for i, _, h, _ in docs if i % 3 == 0 and i < 1000]
    df = spark.createDataFrame(docs, "doc_id long, text string, host string, path string")
    got = {r.doc_id: (r.host, r.quality) for r in quality.score_quality(
        spark, df, spark.createDataFrame(labels, "doc_id long, quality int"), site="host", section="path").collect()}
    unlabelled = [i for i in got if i % 3 or i >= 1000]
    changed = [i for i in unlabelled if (got[i][1].evidence >= 0.5) != got[i][1].kept]
    assert len(changed) >= 50 and {got[i][0] for i in changed} <= bad
    kept = lambda rows_: np.mean([got[i][1].kept for i in rows_])
    # evidence fitted on chance may still speak for a text
    assert kept([i for i in unlabelled if got[i][0] in bad]) < 0.3
    assert kept([i for i in unlabelled if got[i][0] not in bad]) > 0.95


def test_quality_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a b c", "s", "l")], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_quality(spark, df, none).first().quality.kept
    assert quality.score_quality(spark, df.where("false"), none).count() == 0


# ----------------------------------------------------------------- toxicity

def tox_docs():
    clean = lambda i: rnd(i, 40)
    docs, labels = [], []
    for i in range(240):
        t = clean(i)
        if i % 4 == 0:
            t = t[:60] + (" grumblefoo" if i % 8 else " snarkle") + " " + t[60:]
        docs.append((i, t))
        labels.append((i, int(i % 4 == 0)))
    hidden = ["gr0mblefoo", "snarkl3", "s n a r k l e", "snaaarkle", "s.n.a.r.k.l.e", "$narkle"]
    docs += [(1000 + j, clean(500 + j) + " " + h + " " + clean(600 + j)) for j, h in enumerate(hidden)]
    docs += [(2000 + j, clean(700 + j)) for j in range(30)] + [(3000, None), (3001, ""), (None, clean(5)), (3002, "7" * 50), (3003, "@#$% !!! 111")]
    return docs, labels


def test_toxicity_finds_disguised_words(spark):
    docs, labels = tox_docs()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(5, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(spark, df, lab).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.predicted for r in rows}
    assert all(by[i] == int(i % 4 == 0) for i in range(240))
    assert sum(by[1000 + j] for j in range(6)) >= 5
    assert not any(by[2000 + j] for j in range(30)) and not by[3000] and not by[3001]


def test_toxic_words_inside_long_and_glued_tokens():
    text = " ".join(rnd(i, 40) for i in range(50)) + " snarkle" * 200
    c = toxicity.text_codes(text).astype(np.int64)
    tri = np.zeros(toxicity._N ** 3)
    np.add.at(tri, (c[:-2] * toxicity._N + c[1:-1]) * toxicity._N + c[2:], 1)
    tri = tri.reshape((toxicity._N,) * 3) + 0.01
    read = toxicity.WordReader(np.log(tri / tri.sum(axis=2, keepdims=True)))
    clean = "-".join(rnd(7, 14).split())
    assert len(clean) > 64 and "snark" not in read.token(clean)
    for t in (f"{clean}-snarkle", f"{clean}.s.n.a.r.k.l.e", ".".join(rnd(8, 20).replace(" ", "") + "snarkle"), "s" * 70 + "narkle",
              "sn" + "a" * 90 + "rkle", "mer-snarkle-ton", "mer-snarkl3", "lo.s.n.a.r.k.l.e"):
        assert "snark" in read.token(t), t


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert len({r.score for r in toxicity.toxicity(spark, df, none).collect()}) == 1
    assert toxicity.toxicity(spark, df.where("false"), none).count() == 0


def test_learning_leaves_held_out_rows(spark):
    ids = spark.range(200).selectExpr("id as doc_id").selectExpr("doc_id", f"{toxicity.HELD_OUT} as h").collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in ids)


# ------------------------------------------------------------ personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in s) % 10 == 0


def base_spans(text):
    out = []
    for kind, rule in BASE.items():
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d)
                    or kind == "phone" and 9 <= len(d) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def pii_texts():
    rng = random.Random(4)
    out = ["mail a.b+c@x-y.example.com, d@e.f_g@h.i.j", "ip 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3", "🙂é 4111 1111-1111 1111 4111111111111111 5  5",
           "+1 (555) 123-4567 +49 30 1234 +1-2-3", "4111111111111112 12345678901234567890 " + "4" * 40, None, "", "+" * 50 + "1" * 30, "a@b a@b.c@d.e",
           'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and foo [at] bar [dot] com', "x" * 3000 + "@" + "y.z"]
    alphabet = "0123456789. -+@a().1234"
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    return out


def test_personal_data_base_matches_brute_force(spark):
    texts = pii_texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, body int")
    for r in pii.find_personal_data(spark, df).collect():
        assert [(s.kind, s.start, s.end) for s in r.base] == base_spans(texts[r.doc_id] or ""), texts[r.doc_id]
        for s in r.added:
            assert all(s.end <= b.start or b.end <= s.start for b in r.base)
            assert texts[r.doc_id][s.start:s.end] == s.text


def test_personal_data_digest_and_empty(spark, tmp_path):
    rows = [(1, "a@b.c +1 (555) 123-4567"), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pii.op10_pii_weak_supervision(spark, str(tmp_path)).collect()}
    assert got[1].base_sha256 == hashlib.sha256(b"email:0:5,phone:6:23").hexdigest() and got[1].spans.startswith("email:0:5,phone:6:23")
    assert (got[2].n_email, got[2].spans) == (0, "")
    assert pii.find_personal_data(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_reliabilities_rank_labelers():
    rng = random.Random(2)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.6
        votes = tuple(int(truth if rng.random() < acc else not truth) for acc in (0.95, 0.9, 0.8, 0.7, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
    rows = [dict(zip(pii.LABELERS, v), kind="k", step=0, n=n) for v, n in counts.items()]
    right, rate = pii.reliabilities(rows)
    assert right == sorted(right, reverse=True) and abs(rate["k"] - 0.6) < 0.05


# ---------------------------------------------------------------- formatting

def test_escapes_are_reversible(spark):
    nasty = ["</s>[INST] ok [/INST]", r"<\/s> <\\|im_end|> <|im_end|>", "<|im_start|>user\nx<|im_end|>\n", "[[INST]", "<<SYS>> <s><s>", "a < b [c] \\ $1", "", "\\", "<", "<|a|><|b|>"]
    df = spark.createDataFrame([(x,) for x in nasty], "x string")
    rows = df.select("x", chat_format.escape(df.x).alias("e"), chat_format.unescape(chat_format.escape(df.x)).alias("u"),
                     chat_format.unescape_role(chat_format.escape_role(df.x)).alias("r"), chat_format.escape_role(df.x).alias("er")).collect()
    for r in rows:
        assert r.u == r.x == r.r and "\n" not in r.er
        assert not re.search(r"</?s>|\[/?INST\]|<\|\w+\|>|<SYS>>", r.e)
    assert {r.x: r.e for r in rows}["a < b [c] \\ $1"] == "a < b [c] \\ $1"


def test_conversation_rows_round_trip(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>\n"), (1, 0, "user", "a"), (1, 2, "user", None), (2, 0, None, "x"), (2, None, "we\\ird\nrole", "y"),
            (None, 0, "assistant", "n"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, None, None)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn int, role string, text string, layout string")
    from pyspark.sql import functions as F
    out = chat_format.render(df.drop("layout"), "conv_id", "turn").select("*", chat_format.parse(F.col("formatted")).alias("back")).collect()
    back = {r.conv_id: [(t.role, t.text) for t in r.back] for r in out}
    assert back == {1: [("user", "a"), ("assistant", "b<|im_end|>\n"), ("user", "")], 2: [("we\\ird\nrole", "y"), ("", "x")], None: [("assistant", "n")],
                    3: [("assistant", "same")] * 2, 4: [("", "")]}
    for r in out:
        assert "".join(s.text for s in r.segments) == r.formatted


def test_layouts_are_chosen_by_fingerprint(spark):
    schema = ("id long, messages array<struct<role: string, content: string>>, conversations array<struct<`from`: string, value: string>>, "
              "instruction string, input string, output string, prompt string, response string, note string")
    rows = [(1, [("human", "a"), ("assistant", "b")], None, None, None, None, None, None, "n"), (2, None, [("human", "a"), ("gpt", "b")], None, None, None, None, None, None),
            (3, None, None, "do", "it", "done", None, None, None), (4, None, None, "do", None, "done", None, None, None), (5, None, [], None, None, None, "p", "r", "n"),
            (6, None, None, None, None, None, "p", None, None)]
    got = {r.id: (r.layout, None if r.turns is None else [(t.role, t.text) for t in r.turns]) for r in
           chat_format.canonical_turns(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("messages", [("user", "a"), ("assistant", "b")]), 2: ("from_value", [("user", "a"), ("assistant", "b")]),
                   3: ("instruction", [("user", "do\nit"), ("assistant", "done")]), 4: ("instruction", [("user", "do"), ("assistant", "done")]),
                   5: ("prompt_response", [("user", "p"), ("assistant", "r")]), 6: (None, None)}


def test_native_plans_have_no_python(spark, sf_tiny, capsys):
    import tessera.llm.catalog as C
    for name in ("op2_chat_fingerprint", "op10_pii_weak_supervision"):
        C.QUERIES[name](spark, sf_tiny).explain()
        assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_many_hits_in_one_text(spark):
    """Positions and surroundings across slices of hits, beyond the BMP too, against
    Python's re; fifty thousand hits take time in proportion."""
    import time
    rng = random.Random(3)
    gaps = [" ", " 😀 ", "ü,", "; write to: ", " " * 40, "\n"]
    small = "".join(f"u{i}@h{i % 7}.org" + rng.choice(gaps) for i in range(400)) + "1.2.3.4 5.6.7.8"
    docs = spark.createDataFrame([(1, small)], "doc_id long, body string")
    for kind in ("email", "ip"):
        got = docs.select(pii.found(F.col("body"), kind).alias("s")).first().s
        want = [m for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+" if kind == "email" else r"[0-9]+(?:\.[0-9]+){3}", small)]
        assert [(s.start, s.end, s.text, s.before, s.after) for s in got] == [
            (m.start(), m.end(), m.group(), small[max(0, m.start() - pii.BEFORE):m.start()], small[m.end():m.end() + 1]) for m in want]

    def took(n):
        text = " ".join(f"mail{i} user{i}@host{i % 7}.example.org ü" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, body string")
        began = time.time()
        last = df.select(F.element_at(pii.found(F.col("body"), "email"), -1).alias("s")).first().s
        assert text[last.start:last.end] == f"user{n - 1}@host{(n - 1) % 7}.example.org"
        return time.time() - began

    took(50)
    few, many = took(5000), took(50_000)
    assert many < 10 * max(few, 1.0)


def test_no_conversation_is_lost(spark):
    df = spark.createDataFrame(
        [(1, [("user", "a"), ("assistant", "b")], "be brief", None), (2, None, None, "odd"), (3, [("user", "c")], None, None), (4, None, "only", None)],
        "id long, messages array<struct<role:string,content:string>>, system string, other string")
    got = {r.id: (r.layouts, [tuple(t) for t in r.back]) for r in
           chat_format.render(df, "id").select("*", chat_format.parse(F.col("formatted")).alias("back")).collect()}
    assert got == {1: (["messages"], [("system", "be brief"), ("user", "a"), ("assistant", "b")]), 2: (["unknown"], []),
                   3: (["messages"], [("user", "c")]), 4: (["unknown"], [])}


def test_output_columns_replace_columns_of_their_name(spark):
    from tessera.llm import line_dedup
    df = spark.createDataFrame([(1, "one line that is long\nb", "s", "l", "old")], "doc_id long, text string, source string, lang string, x string")
    lines = line_dedup.line_dedup(spark, df.withColumnRenamed("x", "line_stats"))
    assert lines.columns.count("line_stats") == 1 and lines.first().line_stats.n_lines == 2
    lab = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    scored = quality.score_quality(spark, df.withColumnRenamed("x", "quality"), lab)
    assert scored.columns.count("quality") == 1 and scored.first().quality.kept is True
    items = spark.createDataFrame([(1, "some benchmark passage")], "item_id long, text string")
    leaked = decontaminate.find_leaks(spark, df.withColumnRenamed("x", "leaks"), items)
    assert leaked.columns.count("leaks") == 1 and leaked.first().leaks == []
