"""Operators against plain versions of the same definitions."""

import math
import os
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from verstore.llm import audio_features, jaccard_join, language_id, license_scan, mixing, secret_scan, sentence_pieces, toxicity, vector_search

DATA = "/root/testdata/sf0.001"


def test_bundles():
    """Trigram by trigram: permuted letter vectors multiplied, then added."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz ABCÀéßñ一д 019.,\n"
    texts = ["", " ", "a", "Ab c", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 400))) for _ in range(40)), "xyz " * 50]
    space, table = language_id.Space(64), language_id.symbol_table()
    vectors, n = space.bundle(texts, most_cells=512)
    base = np.random.default_rng(7).choice(np.array([-1, 1], dtype=np.float32), (language_id.SYMBOLS, 64))
    for text, got, count in zip(texts, vectors, n):
        sym = [0, *(int(table[ord(c)]) for c in text), 0]
        want = np.zeros(64)
        for k in range(1, len(sym) - 1):
            if sym[k]:
                want += np.roll(base[sym[k - 1]], 2) * np.roll(base[sym[k]], 1) * base[sym[k + 1]]
        assert count == sum(s > 0 for s in sym) and np.allclose(got, want, atol=1e-3)


def test_prototypes(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    langs, prototypes = language_id.train(docs, 64)
    space, sums = language_id.Space(64), {}
    rows = docs.collect()
    for r in rows:
        if r.lang is not None and r.text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            v, n = space.bundle([r.text])
            if n[0]:
                sums[r.lang] = sums.get(r.lang, 0) + language_id.unit(v)[0].astype(np.float64)
    want = np.stack([sums[x] / np.linalg.norm(sums[x]) for x in sorted(sums)])
    want -= want.mean(axis=0)
    assert langs == sorted(sums) and np.allclose(prototypes, want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-5)
    got = {r.doc_id: r for r in language_id.predict(docs, langs, prototypes).collect()}
    assert sum(got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out) >= 0.9 * sum(r.held_out for r in got.values())


def test_toxicity_gradient():
    """The objective's gradient by differences, and the swap's penalty in it."""
    rng = np.random.default_rng(2)
    rows = lambda n: [rng.integers(0, 12, rng.integers(1, 6)) for _ in range(n)]
    x, here, there = (toxicity.Sparse(rows(n)) for n in (30, 8, 8))
    y, w, b = rng.integers(0, 2, 30), rng.normal(size=12), 0.3
    loss, g, gb = toxicity.objective(y, x, here, there, w, b)
    dense = lambda s: np.stack([np.bincount(s.col[s.row == i], minlength=12) for i in range(s.n)])
    p = 1 / (1 + np.exp(-(dense(x) @ w + b)))
    plain = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + toxicity.RIDGE / 2 * w @ w
    assert math.isclose(loss, plain + toxicity.COUNTERFACTUAL * np.mean(((dense(here) - dense(there)) @ w) ** 2), rel_tol=1e-9)
    step = 1e-6
    for k in range(12):
        e = np.eye(12)[k] * step
        slope = (toxicity.objective(y, x, here, there, w + e, b)[0] - toxicity.objective(y, x, here, there, w - e, b)[0]) / (2 * step)
        assert abs(slope - g[k]) < 1e-5
    assert abs((toxicity.objective(y, x, here, there, w, b + step)[0] - toxicity.objective(y, x, here, there, w, b - step)[0]) / (2 * step) - gb) < 1e-5


def test_toxicity_scores(spark):
    """Scores are sums over distinct words and their openings; the swapped
    twin of a labelled text scores much the same."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    chosen, weights, intercept = model = toxicity.train(docs, labels)
    by_bucket = dict(zip(chosen.tolist(), weights.tolist()))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r["score"] for r in toxicity.score(docs, model).collect()}
    for doc, text in texts.items():
        total = intercept
        for word in set(re.findall(r"\w+", text.lower())):
            for form in (word.encode(), *(b"^" + word[:k].encode() for k in (4, 5, 6) if len(word) >= k)):
                total += by_bucket.get(zlib.crc32(form) % toxicity.BUCKETS, 0.0)
        assert math.isclose(got[doc], 1 / (1 + math.exp(-total)), rel_tol=1e-6, abs_tol=1e-9)


def test_features_by_force(spark):
    """Zero-stuffed, filtered, decimated; frames by a direct Fourier transform;
    segments by a loop; tensors as they are read back."""
    a = audio_features
    rng = random.Random(3)
    for n in (64, 640, 6400):
        payload = bytes(rng.randrange(256) if i // 900 % 2 else 128 for i in range(n))
        mel, energy = a.log_mel(payload)
        x = (np.frombuffer(payload, dtype=np.uint8).astype(np.float64) - 128) / 128
        up = np.zeros(len(x) * a.UP + 10 * a.FRAME * a.DOWN)
        up[: len(x) * a.UP : a.UP] = x
        k = np.arange(a.UP * a.TAPS)
        h = np.sinc((k - (len(k) - 1) / 2) / a.DOWN) * np.hamming(len(k)) / a.DOWN * a.UP
        y = [float(sum(h[j] * up[m * a.DOWN - j] for j in range(min(len(h), m * a.DOWN + 1)))) for m in range((len(mel) - 1) * a.HOP + a.FRAME)]
        basis = np.exp(-2j * np.pi * np.outer(np.arange(a.FRAME), np.arange(a.FRAME // 2 + 1)) / a.FRAME)
        for f in range(len(mel)):
            frame = np.array(y[f * a.HOP : f * a.HOP + a.FRAME]) * a.WINDOW
            assert np.allclose(mel[f], np.log10(np.maximum(np.abs(frame @ basis) ** 2 @ a.BANK, 1e-8)), atol=2e-2)
            assert abs(energy[f] - 10 * np.log10(max((frame**2).mean(), 1e-8))) < 0.05
        on, spans, mean, half = False, [], float(energy.mean()), float(energy.std()) / 2
        for f, e in enumerate([*energy.tolist(), -math.inf]):
            if not on and e > mean + half:
                on, start = True, f
            elif on and e < mean - half:
                on = False
                spans.append((start, f))
        assert a.segments(energy) == spans
        patch, times = a.patches(a.tensors(mel))
        assert np.array_equal(patch.reshape(-1, a.MELS)[: len(mel)], mel.astype(np.float16)) and (patch.reshape(-1, a.MELS)[len(mel) :] == -8).all()
        hop = a.HOP * a.DOWN / a.UP / a.RATE
        assert np.allclose(times[:, 0], np.arange(len(patch)) * a.PATCH * hop) and math.isclose(times[-1, 1], len(mel) * hop)
    docs = spark.createDataFrame([(1, "x" * 50000, 5), (2, None, 6), (None, "x" * 50000, 7)], "doc_id bigint, text string, n_bytes int")
    kept = a.stored_tensors(a.store(docs))
    got = {r.doc_id: r for r in a.described(kept).collect()}
    assert got[1].feature == got[None].feature and got[1].tensor_crc32 == got[None].tensor_crc32 and got[2].n_patches == 1
    for r in kept.collect():
        assert f":{zlib.crc32(bytes(r.tensors)):08x}:" in r.feature and len(a.patches(bytes(r.tensors))[0]) == got[r.doc_id].n_patches


def test_license_texts(spark):
    """Whole known texts however they are set; SQL says the same of all."""
    known = license_scan.KNOWN
    bsd = known["BSD-2-Clause"]
    listed = lambda a, b: bsd.replace("redistributions of", f"\n {a} Redistributions of").replace("redistributions in", f"\n {b} Redistributions in")
    rows = {
        "MIT": ["Copyright Jane Doe\n" + known["MIT"], "Copyright [yyyy] [name of copyright owner]\nAll rights reserved.\n" + known["MIT"].replace('"', "“").replace(" the ", "  the—").title().replace("Noninfringement", "non-infringement"), "© 2001 x y\r\n" + known["MIT"].replace(". ", ".\r\n\r\n")],
        "BSD-2-Clause": [listed("1.", "2."), listed("*", "*"), listed("a)", "b)"), listed("•", "•"), "/*\n * Copyright (c) 1999 The Regents\n" + bsd.replace(". ", ".\n * ") + "\n */"],
        "Apache-2.0 (line)": ["Licenced under the Apache Licence, Version 2.0"],
        None: [known["MIT"] + " and more", known["MIT"].replace("software", "softwares", 1), "", "paper center per cent", bsd[:-9]],
    }
    flat = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, texts in rows.items() for t in texts)]
    docs = spark.createDataFrame([*flat, (None, None, None)], "doc_id bigint, text string, digest string")
    got = {r.doc_id: (r.digest, r.license_id) for r in license_scan.scan(docs).collect()}
    assert {i: got[i][1] for i, _, _ in flat} == {i: k for i, _, k in flat} and got[None][1] is None
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t, _ in flat] + [(None, None)])
    assert {r[0]: r[1:] for r in con.execute(license_scan.oracle()).fetchall()} == got


def test_license_files(spark, tmp_path):
    """Digests of files, as a list of long texts, find them in another setting."""
    words = [f"word{i}" for i in range(3000)]
    (tmp_path / "LONG").write_text("Copyright (C) 2007 Some Foundation\n\n" + "\n".join(" ".join(words[i : i + 9]) for i in range(0, 3000, 9)))
    long = {r.file: r.digest for r in license_scan.digests_of(spark, str(tmp_path / "LONG")).collect()}
    docs = spark.createDataFrame([(1, "  ".join(words).upper()), (2, " ".join(words[1:]))], "doc_id bigint, text string")
    assert {r.doc_id: r.license_id for r in license_scan.scan(docs, long=long).collect()} == {1: "LONG", 2: None}
    assert len(set(license_scan.DIGESTS.values())) == len(license_scan.DIGESTS)


def slots_by_force(blocks, shares):
    """The source of each slot, looking at all sources in each slot."""
    left, out = dict(blocks), []
    while left:
        weights = {s: Fraction(shares[s]) for s in left}
        scale, had, t = sum(weights.values()), dict.fromkeys(left, 0), 0
        while all(left.values()):
            ready = [s for s in left if math.floor(had[s] * scale / weights[s]) <= t]
            s = min(ready, key=lambda s: (math.ceil((had[s] + 1) * scale / weights[s]), str(s)))
            out.append(s)
            had[s], left[s], t = had[s] + 1, left[s] - 1, t + 1
        left = {s: n for s, n in left.items() if n}
    return out


def test_schedule_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", F.lit(1).alias("blk"), F.lit(2).alias("row"), F.lit(3).alias("p_at"), F.lit(4).alias("slot"))
    scheduled = mixing.schedule(docs)
    assert scheduled.columns == ["doc_id", "source", "blk", "row", "p_at", "block", "slot", "place"]
    rows = scheduled.orderBy("slot", "place").collect()
    sizes = Counter(r.source for r in rows)
    order = slots_by_force({s: -(-n // mixing.BLOCK) for s, n in sizes.items()}, {s: (n / len(rows)) ** mixing.TEMPERATURE for s, n in sizes.items()})
    left, want = dict(sizes), []
    for slot, s in enumerate(order):
        want += [(s, slot, k) for k in range(min(mixing.BLOCK, left[s]))]
        left[s] -= mixing.BLOCK
    assert [(r.source, r.slot, r.place) for r in rows] == want and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.blk == 1 and r.row == 2 and r.p_at == 3 for r in rows)


def test_blocks_grow(spark, monkeypatch):
    """Large tables are dealt in larger blocks, with the same bound."""
    monkeypatch.setattr(mixing, "BLOCKS", 50)
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 4 < 3 THEN 'a' ELSE 'b' END AS source")
    rows = mixing.schedule(docs).orderBy("slot", "place").collect()
    assert max(r.place for r in rows) == 79 and len({r.doc_id for r in rows}) == 4000 and len({r.slot for r in rows}) == 51
    exact = 1000**0.5 / (1000**0.5 + 3000**0.5)
    first = {r.slot: r.source for r in rows}
    had = 0
    for t in range(1, 31):  # before the smaller one ends
        had += first[t - 1] == "b"
        assert abs(had - exact * t) < 1


def test_all_segmentations(spark):
    """Every way through the lattice, enumerated."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    lattice = sentence_pieces.Lattice(path)
    texts = ["a", "hello", "of the", "no one", "x\ny", "一b", "  a"]

    def ways(s):
        if not s:
            return [(0.0, [])]
        out = []
        for n in range(1, len(s) + 1):
            piece = s[:n]
            if piece in lattice.id:
                out += [(lattice.score[lattice.id[piece]] + v, [lattice.id[piece], *i]) for v, i in ways(s[n:])]
            elif n == 1:
                out += [(lattice.unknown + v, [*lattice.spelled(piece), *i]) for v, i in ways(s[n:])]
        return out

    for r in sentence_pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path, 4, with_ids=True).collect():
        want = sorted(ways(("▁" + texts[r.doc_id]).replace(" ", "▁")), key=lambda w: -w[0])
        assert np.allclose(r.nbest_scores, [v for v, _ in want[:4]])
        every = {tuple(i): v for v, i in want}
        paths = [tuple(sentence_pieces.path_ids(r.ids, c)) for c in r.nbest_changes]
        assert len(set(paths)) == len(paths) and np.allclose([every[p] for p in paths], r.nbest_scores)


def test_secret_spans_by_force(spark):
    """Every candidate by itself, each window by itself."""
    model, rng = secret_scan.train(), random.Random(9)
    both = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    key = lambda n: "".join(rng.choice(both) for _ in range(n))
    texts = [None, "", "plain words only " * 20, f"a {key(24)} b {key(60)}/{key(90)} c", f"token={key(30)}{'0af' * 12} and {key(40)}", f"x{key(19)} services/team-name/v2/handler-name {key(18)}", "w " * 9000 + key(36), "naïve " + key(32) + " ß"]
    rows = [(i, t, "old", 1) for i, t in enumerate(texts)] + [(None, texts[3], "old", 1)]
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string, spans string, n_hex int")).collect()
    added = 0
    for r in got:
        text = texts[3 if r.doc_id is None else r.doc_id] or ""
        spans = secret_scan.rule_spans(text)
        inside = {k for a, _, b in spans for k in range(a, b)}
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
            s = m.group()
            mixed = re.search("[0-9]", s) and re.search("[A-Za-z]", s) or len(re.findall("[a-z][A-Z]", s)) > 1
            if len(s) < secret_scan.LEAST or not mixed or set(range(*m.span())) <= inside:
                continue
            p = max(float(model.probability(secret_scan.windows(text, [w]))[0]) for w in secret_scan.slices(*m.span()))
            if p >= model.threshold:
                spans.append((m.start(), 3, m.end()))
                added += 1
        assert r.spans == secret_scan.joined(sorted(spans)) and len(r.probabilities) == len(spans)
    assert added >= 6
    for t in texts[3:]:
        spans = secret_scan.found([t], model)[1][0]
        hidden = {k for a, _, b in spans for k in range(a, b)}
        assert secret_scan.blanked(t, spans) == "".join("*" if k in hidden else c for k, c in enumerate(t))


def test_scan_drops_and_tightens():
    """Few pairs reach the last block, limits from elsewhere leave fewer, and
    what a test may lose stays within its share."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index, ids, k = vector_search.Index(x[:3000], 1.0 + 1e-9, 40), np.arange(6000), 20
    q = x[::60]
    exact = np.sort(q @ x.T, axis=1)[:, ::-1][:, :k]
    left = np.zeros(8, dtype=np.int64)
    asked, found, score = vector_search.scan(index, k, x, ids, q, np.arange(len(q)), None, left)
    hits = sum(np.isclose(exact[i], s).any() for i, s in zip(asked, score))
    assert hits >= 0.95 * exact.size and left[3] < 0.35 * left[0]
    again = np.zeros(8, dtype=np.int64)
    asked, found, score = vector_search.scan(index, k, x, ids, q, np.arange(len(q)), exact[:, -1], again)
    assert sum(np.isclose(exact[i], s).any() for i, s in zip(asked, score)) >= 0.93 * exact.size and again.sum() < left.sum() and again[0] < 0.8 * len(q) * len(x)
    turned = vector_search.allowed(49, 0.02)
    share = (index.turned(x)[:, :16] ** 2).sum(axis=1) / (index.turned(x) ** 2).sum(axis=1)
    assert (share > turned[16]).mean() < 0.04


def test_doubles_stay_doubles(spark):
    rows = [(i, [1.0 + i * 1e-12, 0.5]) for i in range(30)]
    got = vector_search.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0, 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [29, 28, 27] and [r["score"] for r in got] == [(1.0 + i * 1e-12) + 0.25 for i in (29, 28, 27)]


def test_components_in_rounds(spark, monkeypatch):
    """Edges beyond one task's: forests, then labels round by round."""
    rng = random.Random(6)
    edges = [(a, a + rng.choice((1, 1, 2, 40))) for a in range(400) if rng.random() < 0.8] + [(7, 7), (1000, 7)]
    label = {n: n for e in edges for n in e}
    for a, b in edges * 40:
        low = min(label[a], label[b])
        label[a] = label[b] = low
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    for most in (10**6, 50):
        monkeypatch.setattr(jaccard_join, "TREE", most)
        got = jaccard_join.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(12))
        assert {r.node: r.label for r in got.collect()} == {n: x for n, x in label.items() if n != x}


@pytest.mark.parametrize("most", [7, 100, 5000])
def test_slices(monkeypatch, most):
    """Long texts in slices have the vectors and the sets of whole ones."""
    rng = random.Random(most)
    texts = ["".join(rng.choice("abc dé\n\t") for _ in range(rng.randint(0, 900))) for _ in range(20)] + ["x" * 300, " " * 300, "a  b", " " * 300 + "a b c d e f", ("a" + " " * 90) * 9, "one two three four five " * 20]
    space = language_id.Space(64)
    vectors, n = space.bundle(texts)
    sets = [jaccard_join.shingle_sets(texts, k) for k in (4, 5)]
    monkeypatch.setattr(language_id, "LONG", most)
    monkeypatch.setattr(jaccard_join, "LONG", most)
    again, m = space.bundle(texts)
    assert (n == m).all() and np.allclose(vectors, again, atol=1e-3)
    for k, own in zip((4, 5), sets):
        assert all(np.array_equal(a, b) for a, b in zip(own, jaccard_join.shingle_sets(texts, k)))


@pytest.mark.parametrize("words", [4, 5])
def test_long_text_sets(words):
    """A text of 2 M characters: the set is that of its words one by one."""
    rng = random.Random(words)
    text = " ".join(rng.choice(("alpha", "beta", "Gamma", "d")) + str(rng.randrange(300)) for _ in range(250_000))
    got = jaccard_join.shingle_sets([text], words)[0]
    w = text.lower().split()
    assert len(got) == len(set(zip(*(w[k:] for k in range(words))))) == len(jaccard_join.exact_set(text, words))


def test_links_in_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(jaccard_join.oracle()).fetchall()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.query(spark, DATA).collect()} == want
    assert any(i != c for i, (_, c) in want.items())
    con = duckdb.connect()
    texts = [(1, None), (2, ""), (3, "a b"), (4, "A\tb "), (5, "a b c d e"), (6, "a b c d e"), (7, "a b c")]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    want = {r[0]: r[1:] for r in con.execute(jaccard_join.oracle()).fetchall()}
    assert want == {1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (2, 5), 6: (2, 5), 7: (1, 7)}


COMMON = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="this system keeps no common licenses")
def test_common_licenses(spark):
    """The long texts' digests, where a system keeps the texts: by themselves,
    and as documents set in one line and in another case."""
    names = {"Artistic": "Artistic-1.0-Perl", **{f"{k}-{v}": f"{k}-{v}.0" for k in ("GPL",) for v in (1, 2, 3)}, "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0"}
    files = [n for n in sorted(os.listdir(COMMON)) if names.get(n, n) in license_scan.DIGESTS and not os.path.islink(f"{COMMON}/{n}")]
    got = {r.file: r.digest for r in license_scan.digests_of(spark, [f"{COMMON}/{n}" for n in files]).collect()}
    assert got == {n: license_scan.DIGESTS[names.get(n, n)] for n in files} and len(files) >= 8
    texts = [(i, open(f"{COMMON}/{n}", encoding="utf-8").read().replace("\n", "\r\n") + "\n\n") for i, n in enumerate(files)]  # noqa: SIM115
    found = {r.doc_id: r.license_id for r in license_scan.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert found == {i: names.get(n, n) for i, n in enumerate(files)}
