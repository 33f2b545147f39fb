"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import decontam, graph, gru_lm, kd_sharding, langid, line_dedup, minhash, mixing, quality, token_files, warc
from seriesloom.llm import queries as llm_queries

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text(seed, n, newline=9):
    rng = np.random.default_rng(seed)
    return "".join(w + ("\n" if (i + 1) % newline == 0 else " ") for i, w in enumerate(rng.choice(WORDS, n) + rng.integers(0, 40, n).astype(str)))


def table(spark, rows, extra=True):
    """documents with extra columns whose names clash with the operators' own."""
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return frame.withColumns({c: F.lit("x") for c in ("size", "kept", "n_words", "shard", "bucket", "target", "token", "digest")}) if extra else frame


@pytest.fixture(scope="module")
def docs(spark):
    base = text(1, 120)
    near = base.replace(base.split()[60], "changed")
    far = " ".join(base.split()[:60]) + " " + text(2, 60)
    rows = [(1, base, "en", "a"), (2, base, "fr", "b"), (3, near, "en", None), (4, far, None, "a"), (5, None, "en", "a"), (6, "", "en", "a"), (7, " \t\n ", "en", "b"), (8, "One two", "en", "b"), (9, "one TWO", "de", "b"), (10, text(3, 20_000), "en", "a"), (10, text(3, 20_000), "en", "a"), (None, base, "en", "a"), (None, None, None, None)]
    rows += [(100 + i, text(100 + i, 80), "en" if i % 2 else "de", "abc"[i % 3]) for i in range(30)]
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(t):
    return (t or "").encode().lower().split()


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 60
    rows = [(3, "http://a", long), (1, "http://b", long), (2, None, long), (4, "http://c", "short"), (5, "http://d", "short"), (6, "u\r\nv", None), (7, "http://e", ""), (8, "x", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9)]
    path = f"file://{tmp_path}/warc"
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    records = warc.read_records(spark, path)
    assert records.count() == 3 * len(rows)
    captures = warc.assemble(records)
    payloads = {r.response.record_id: r.response.payload for r in captures.collect()}
    assert payloads["urn:page:response:8"].decode() == rows[-1][2]
    got = {r.page_id: tuple(r)[1:5] for r in warc.page_digests(captures).collect()}
    for page, _, html in rows:
        body = (html or "").encode()
        revisit = len(body) >= 100 and page != min(p for p, _, h in rows if h == html)
        assert got[page] == (len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None)
    assert all(r.n_requests == r.n_metadata == 1 for r in warc.page_digests(captures).collect())


def test_warc_members_and_cut_records():
    import gzip

    record = lambda n: b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % n + b"x" * n + b"\r\n\r\n"
    data = b"".join(gzip.compress(record(n)) for n in (0, 5, 3_000_000))
    assert [len(b) for _, _, b in warc.parse(data)] == [0, 5, 3_000_000]
    assert [len(b) for _, _, b in warc.parse(record(4) + record(9)[:-8])] == [4]


def test_warc_links(spark):
    rows = [("r1", "response", []), ("q1", "request", ["r1"]), ("m1", "metadata", ["q1"]), ("r2", "response", ["q2"]), ("q2", "request", []), ("m3", "metadata", ["gone"])]
    fields = [x.split()[0] for x in warc.RECORD_FIELDS.split(", ")]
    full = [{f: None for f in fields} | {"record_id": i, "record_type": k, "concurrent_to": c, "file": "f", "offset": n} for n, (i, k, c) in enumerate(rows)]
    got = {r.capture_id: (r.response is not None, [x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for r in warc.assemble(spark.createDataFrame(full, warc.RECORD_FIELDS)).collect()}
    assert got == {"r1": (True, ["q1"], ["m1"]), "r2": (True, ["q2"], []), "m3": (False, [], ["m3"])}


def test_mixing(docs, empty):
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == docs.count() and mixing.mix_documents(empty).count() == 0
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
    sizes = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, fixed = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in fixed)
        target = {s: 3 * sizes[s] if s in fixed else left * weight[s] / sum(weight[x] for x in sizes if x not in fixed) for s in sizes}
        over = {s for s in sizes if s not in fixed and target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        fixed |= over
    for s, rs in by.items():
        assert math.isclose(rs[0].target, target[s], rel_tol=1e-9) and rs[0].source_size == sizes[s]
    assert sorted(map(repr, mixing.mix_documents(docs).collect())) == sorted(map(repr, rows))
    assert mixing.repeat_documents(docs).columns == docs.columns


def test_mixing_meets_targets_and_tilts(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 50)), None, "abcd"[i % 4]) for i in range(4000)]
    got = mixing.mix_documents(table(spark, rows, False))
    sums = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.001 * r.target for r in sums)
    for source in "abcd":  # the logarithm of an uncapped rate is linear in the size
        r = [(x["size"], math.log(x.rate)) for x in got.where(F.col("source") == source).collect() if x.rate < 2.999]
        if r:
            assert max(abs(y / x - r[0][1] / r[0][0]) for x, y in r) < 1e-6


def brute_statistics(t):
    w = [x for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
    where = defaultdict(list)
    for i in range(len(w) - 2):
        where[tuple(w[i : i + 3])].append(i)
    covered = {j for v in where.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if x.strip()]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, empty):
    extra = table(spark, [(900, "a b c d a b c d e\na b\na b\n\n|#", "en", "a"), (901, "é é é é é", "en", "a")])
    both = docs.unionByName(extra)
    got = {r.doc_id: r for r in quality.judge(both).collect() if r.doc_id is not None}
    for r in both.where("doc_id IS NOT NULL").collect():
        g = got[r.doc_id]
        assert tuple(g[1:6]) == brute_statistics(r.text)
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert not (g.base_failed and g.kept)
    assert quality.judge(empty).count() == 0
    assert quality.keep_good(both).columns == docs.columns


def test_quality_rejects_outliers_and_matches_numpy(spark):
    rows = [(i, text(i, 60 + i), "en", "a") for i in range(200)] + [(1000 + i, "### ".join(text(5000 + i, 80).split()), "en", "a") for i in range(30)]
    got = {r.doc_id: r for r in quality.judge(table(spark, rows)).collect()}
    assert all(got[i].kept for i in range(200)) and not any(got[1000 + i].kept for i in range(30))
    assert math.isclose(quality.CUTOFF, 28.47, abs_tol=0.02)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)) @ np.diag([1, 2, 3, 4]) + 5
    x[:60] += 100
    frame = spark.createDataFrame([("p", *map(float, r)) for r in x], "pool string, x0 double, x1 double, x2 double, x3 double")
    m = quality.estimate(frame).first()
    assert np.allclose([m.m0, m.m1, m.m2, m.m3], x[60:].mean(0), atol=0.6)


def test_near_duplicates(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: shingle_set(r.text) for r in rows if r.doc_id is not None}
    name = {d: d for d in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    name[a] = name[b] = min(name[a], name[b])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) and minhash.near_duplicates(empty).count() == 0
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), name[r.doc_id], name[r.doc_id] == r.doc_id)
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None and r.n_shingles) == [(len(sets[1]), 1, False)]
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect())[10] == 1


def test_large_group_of_near_copies(spark):
    base = text(7, 150).split()
    rows = []
    for i in range(300):
        w = list(base)
        for j in np.random.default_rng(i).choice(150, i % 8, replace=False):
            w[j] = f"edit{i}x{j}"
        rows.append((i, " ".join(w), None, None))
    sets = {d: shingle_set(t) for d, t, _, _ in rows}
    name = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b])) and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    while changed:
        changed = False
        for a, b in links:
            if name[a] != name[b]:
                name[a] = name[b] = min(name[a], name[b])
                changed = True
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == name


def test_bounds_of_the_posterior():
    n, t, miss = 40, 0.75, 1e-6
    m = minhash.least_matches(n, t, miss)
    grid = np.linspace(0, 1, 200_001)
    for k, keeps in ((m, True), (m - 1, False)):
        density = grid**k * (1 - grid) ** (n - k)
        assert (density[grid >= t].sum() / density.sum() >= miss) == keeps


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}


def test_language_model(spark, docs, empty):
    got = gru_lm.score_documents(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(x for r in rows if not held(r.doc_id) for x in [*words(r.text), None])
    n, v = sum(c.values()), len(c)
    want = sorted((repr(r.doc_id), held(r.doc_id), len(words(r.text)) + 1, sum(c[x] > 0 for x in [*words(r.text), None]), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*words(r.text), None]), 6)) for r in rows)
    assert want == sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert gru_lm.score_documents(empty).count() == 0
    assert gru_lm.score_documents(docs.where("doc_id = 5")).count() == 1


def test_language_model_gradient_and_normalization():
    rng = np.random.default_rng(0)
    p = {k: x.astype(np.float64) for k, x in gru_lm.start_params(rng.integers(1, 50, 130).astype(float)).items()}
    x, y = rng.integers(0, 130, (5, 3)), rng.integers(0, 130, (5, 3))
    live, h = np.ones((5, 3), bool), np.zeros((3, gru_lm.HIDDEN))
    live[3:, 2] = False
    g, _ = gru_lm.gradient(p, x, y, live, h)

    def loss():
        state, total = h, 0.0
        for t in range(5):
            state = gru_lm.step(p, p["emb"][x[t]] @ p["w"] + p["b"], state)
            total -= gru_lm.log_probs(p, state, y[t])[live[t]].sum()
        return total / live.sum()

    for k in p:
        flat = p[k].reshape(-1)
        for i in rng.choice(flat.size, 4):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert math.isclose((up - down) / 2e-5, g[k].reshape(-1)[i], abs_tol=1e-6)
    state = rng.normal(size=(192, gru_lm.HIDDEN))
    assert math.isclose(sum(np.exp(gru_lm.log_probs(p, state[:1].repeat(192, 0), np.arange(192)))), 1, rel_tol=1e-6)


def test_language_model_carries_state_and_learns(spark):
    docs = [np.array([1, 2, 3] * 20 + [0], np.int16), np.array([4, 5] * 15 + [0], np.int16)] * 40
    p = gru_lm.start_params(np.bincount(np.concatenate(docs), minlength=8).astype(float))
    before = gru_lm.log_likelihoods(p, docs)
    gru_lm.train(p, [d for _ in range(40) for d in docs], gru_lm.Adam(p))
    assert gru_lm.log_likelihoods(p, docs).sum() > 0.95 * before.sum()
    one = gru_lm.log_likelihoods(p, docs[:1])[0]
    state, total, last = np.zeros((1, gru_lm.HIDDEN), np.float32), 0.0, 0
    for s in docs[0]:
        state = gru_lm.step(p, p["emb"][[last]] @ p["w"] + p["b"], state)
        total, last = total + float(gru_lm.log_probs(p, state, np.array([s]))[0]), int(s)
    assert math.isclose(one, total, rel_tol=1e-4)


def test_language_model_learns_from_every_window(monkeypatch):
    rng, seen, gradient = np.random.default_rng(3), [], gru_lm.gradient

    def watched(p, x, y, live, h):
        seen.append(y[live])
        return gradient(p, x, y, live, h)

    monkeypatch.setattr(gru_lm, "gradient", watched)
    docs = [rng.integers(0, 100, n) for n in [*rng.integers(1, 30, 1100).tolist(), 32, 33, 150, 200]]
    p = gru_lm.start_params(np.ones(100))
    gru_lm.train(p, docs, gru_lm.Adam(p))
    assert Counter(np.concatenate(seen).tolist()) == Counter(np.concatenate(docs).tolist())


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    more = table(spark, [(50, "It's a <|endoftext|> tést… 12,345! 'S they'll. x\x1cy\x85z 👍🏽.", "en", "a")])
    path = f"file://{tmp_path}/t"
    token_files.write(docs.unionByName(more), path)
    t, start = Tokenizer.from_file(token_files.default_tokenizer()), 0
    got = {}
    for r in token_files.read(spark, path).collect():
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.token_ids, "<u4").tolist()))
    for r in sorted(docs.unionByName(more).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")):
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert (start, ids) in got[r.doc_id]
        start += len(ids)
    token_files.write(empty, f"file://{tmp_path}/none")
    assert token_files.read(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        token_files.write(docs, "hdfs://x/y")


def test_token_ids_of_letters_that_normalise_to_a_mark():
    import sys

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    library, encoder = Tokenizer.from_file(path), token_files.Encoder(path, "<u2")
    texts = ["YEN\u0130, Ye\u0130: \u0130! \u0130 TAR\u0130H.", "\u092a\u095d, \u0921\u095c? \u09af\u09df... x\u0958|", "\u00c9T\u00c9, \u0434\u0430; \u4e2d! \u0663. \u03a3\u03a3,"]
    # Every letter and digit there is, before a sign.
    texts += [f"{c}, A{c}!?" for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum()]
    ids, counts = encoder(pa.array(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_line_dedup(spark, docs, empty):
    line = text(50, 30, 999).strip()
    edited = line.replace(line.split()[29], "other")
    extra = table(spark, [(60, f"{line}\nA b\n\n{edited}", "en", "a"), (61, f"a B\n{edited}\nlast", "en", "a"), (62, line.upper(), "en", "a")])
    both = docs.where("doc_id IS NULL OR doc_id <> 10").unionByName(extra)
    lines = []
    for r in both.collect():
        for i, x in enumerate((r.text or "").lower().split("\n")):
            w = x.split()
            if w:
                lines.append((r.doc_id is None, r.doc_id or 0, i, " ".join(w), {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}))
    first = {}
    for x in sorted(lines, key=lambda x: x[:3]):
        first.setdefault(x[3], x)
    linked = {k: [o for o, b in first.items() if o != k and 100 * len(a[4] & b[4]) >= 75 * len(a[4] | b[4])] for k, a in first.items()}
    want = []
    for x in lines:
        f = first[x[3]]
        late = any(first[o][:3] < f[:3] for o in linked[x[3]])
        want.append((None if x[0] else x[1], x[2], None if f[0] else f[1], f[2], len(linked[x[3]]), late or f[:3] != x[:3]))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in line_dedup.judge_lines(both).collect())
    assert any(n for *_, n, _ in want) and line_dedup.judge_lines(empty).count() == 0
    clean = {r.doc_id: r.text for r in line_dedup.dedup_lines(both).collect()}
    assert clean[61] == "last" and clean[62] == "" and clean[5] is None


def test_line_dedup_of_many_near_copies(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK_TOKENS", 300)
    rng, base = np.random.default_rng(4), text(90, 60, 999).split()
    rows = []
    for i in range(80):
        w = list(base)
        for j in rng.choice(60, i % 5, replace=False):
            w[j] = f"edit{i}x{j}"
        rows.append((i, " ".join(w) + "\nthe same line in every text\n\n \u00c9 \t", None, None))
    rows.append((0, "another text under the first id\nthe same line in every text", None, None))
    sets = {d: shingle_set(t.split("\n")[0]) for d, t, _, _ in rows[:-1]}
    first = {}
    for d, s in sets.items():
        first.setdefault(frozenset(s), d)
    links = {s: {o for o in first if o != s and 100 * len(s & o) >= 75 * len(s | o)} for s in first}
    got = {(r.doc_id, r.line_no): r for r in line_dedup.judge_lines(table(spark, rows[:-1])).collect()}
    for d, s in sets.items():
        s = frozenset(s)
        r = got[d, 0]
        assert (r.class_doc, r.n_links, r.removed) == (first[s], len(links[s]), first[s] != d or any(first[o] < d for o in links[s]))
        assert got[d, 1].class_doc == 0 and got[d, 1].removed == (d > 0) and (d, 2) not in got and got[d, 3].class_doc == 0
    assert max(len(x) for x in links.values()) > 20
    clean = sorted(r.text for r in line_dedup.dedup_lines(table(spark, rows)).collect() if r.doc_id == 0)
    assert clean == sorted([rows[0][1], rows[-1][1]])


def test_line_dedup_links_lines_that_repeat_their_only_shingle(spark):
    # By the SQL each has the one shingle "ja ja ja ja ja"; four words are a token of their own.
    rows = [(0, "Ja ja ja ja ja", None, None), (1, "ja ja ja ja ja ja\nja ja ja ja", None, None), (2, "ja\tja ja ja ja ja ja", None, None)]
    got = {(r.doc_id, r.line_no): (r.n_links, r.removed) for r in line_dedup.judge_lines(table(spark, rows)).collect()}
    assert got == {(0, 0): (2, False), (1, 0): (2, True), (1, 1): (0, False), (2, 0): (2, True)}


def test_line_classes_find_first_lines_of_any_ids(spark, monkeypatch):
    far = [-(1 << 38), -1, 0, 5, (1 << 38) - 1]
    texts = ["same\nother\nsame", "other\nsame", "last\nsame", "last\nother"]

    def judged(ids):
        rows = [(d, texts[i % 4], None, None) for i, d in enumerate(ids)]
        fits.append(line_dedup._places_fit(line_dedup.line_sketches(table(spark, rows).select("doc_id", "text"))))
        return sorted(map(repr, line_dedup.judge_lines(table(spark, rows)).collect()))

    fits = []
    plain = judged(far)
    judged([*far, 1 << 40])
    judged([*far, None])
    assert fits == [True, False, False]
    monkeypatch.setattr(line_dedup, "_places_fit", lambda lines: False)
    assert judged(far) == plain


def test_line_dedup_compares_few_blocks_of_near_copies(spark, monkeypatch):
    made, store = {}, line_dedup.store

    def counted(df, name):
        out = store(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "store", counted)
    rng, base = np.random.default_rng(5), text(91, 60, 999).split()
    rows = [(0, " ".join(base), None, None)]
    for i in range(1, 400):
        w = list(base)
        w[rng.integers(60)] = f"edit{i}"
        rows.append((i, " ".join(w), None, None))
    got = {r.doc_id: r for r in line_dedup.judge_lines(table(spark, rows)).collect()}
    assert got[0].n_links == 399 and not got[0].removed and all(got[i].removed for i in range(1, 400))
    # 22,400 tokens: the pairs of blocks grew with the square of the copies.
    assert made["line-pairs"] <= 6


def test_language_id(spark, empty):
    rng = np.random.default_rng(0)
    say = {"en": ["the", "and", "that", "with", "house"], "fr": ["les", "être", "une", "avec", "maison"], "de": ["der", "und", "nicht", "für", "straße"]}
    rows = [(i, " ".join(rng.choice(say[k], 12)), k, "a") for i in range(150) for k in [list(say)[i % 3]]]
    rows += [(900, None, "en", "a"), (901, "", "en", "a"), (902, "123 !?", None, "a"), (903, "der und " * 60_000, None, "a")]
    both = table(spark, rows)
    model = langid.fit(both.where("doc_id % 2 = 0"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(both, model).collect()}
    assert all(got[i][0] == list(say)[i % 3] for i in range(150)) and got[903][0] == "de"
    assert got[900] == got[901] == got[902] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(both, none).collect()} == {"und"}
    whole, pieces = np.concatenate(list(langid.buckets_of("ab" * 10))), langid.PIECE
    langid.PIECE = 7
    assert Counter(whole.tolist()) == Counter(np.concatenate(list(langid.buckets_of("ab" * 10))).tolist())
    langid.PIECE = pieces


def test_kd_sharding(spark, docs, empty):
    rows = [(i, text(i % 200, 20 + i % 37), "en", "a") for i in range(1500)] + [(5000 + i, "copy " * 30, "en", "a") for i in range(700)] + [(9000, None, None, None)]
    got = kd_sharding.shard_documents(table(spark, rows)).collect()
    sums, slots, by_text = Counter(), defaultdict(list), defaultdict(set)
    sizes = {d: len((t or "").encode()) + 1 for d, t, _, _ in rows}
    for r in got:
        assert r["size"] == sizes[r.doc_id]
        sums[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        by_text[r.text_crc32].add(r.shard)
    mean = sum(sizes.values()) / 8
    assert set(sums) == set(range(8)) and all(abs(s - mean) < 0.05 * mean for s in sums.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(repr, got)) == sorted(map(repr, kd_sharding.shard_documents(table(spark, rows)).collect()))
    assert sum(len(s) > 1 for s in by_text.values()) <= 7
    assert kd_sharding.shard_documents(empty).count() == 0 and kd_sharding.shard_documents(docs).count() == docs.count()


def test_decontamination(spark, docs, empty):
    item = text(70, 30, 999).strip()
    bench = spark.createDataFrame([(1, item, "x"), (2, "alpha0, Beta1", "x"), (3, None, "x"), (4, "...", "x"), (None, text(71, 15), "x"), (5, item.upper(), "x"), (10, item, "x")], "item_id long, text string, digest string")
    extra = table(spark, [(70, "start " + item + " end", "en", "a"), (71, " ".join(item.split()[5:15]), "en", "a"), (72, " ".join(item.split()[5:14]), "en", "a"), (73, "ALPHA0-beta1 z alpha0 beta1", "en", "a"), (74, text(71, 15), "en", "a")])
    both = docs.unionByName(extra)
    windows = defaultdict(set)
    for i, t, _ in [tuple(r) for r in bench.collect()]:
        w = decontam.words_of((t or "").encode())
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])] |= {i} - {None}
    got = defaultdict(list)
    for g in decontam.document_hits(both, bench).collect():
        got[g.doc_id].append(tuple(g)[1:])
    for r in both.collect():
        w, hit, items = decontam.words_of((r.text or "").encode()), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    items |= windows[tuple(w[i : i + n])]
        assert (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)) in got[r.doc_id]
    assert got[71][0][4] and not got[72][0][4] and got[73][0][1] == 4
    assert decontam.document_hits(empty, bench).count() == 0
    assert not decontam.document_hits(both, bench.where("false")).where("contaminated").count()
    assert decontam.drop_contaminated(both, bench).columns == both.columns


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, text(i % 90, 60 + i % 30), "en", "ab"[i % 2]) for i in range(100)] + [(200, text(1, 3), "en", "a"), (201, None, None, None)]
    rows += [(300, text(400, 80) + " " + text(70, 30), "en", "a")]
    table(spark, rows, False).withColumn("n_chars", F.length("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text(70, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        path = f"{tmp_path}/{len(seen)}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    assert set(seen["quality rules"]) == set(range(100)) | {300}
    assert 300 in seen["near-duplicates"] and 300 not in seen["decontamination"]
    assert len(set(seen["near-duplicates"])) == len(seen["near-duplicates"]) < 101
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in final.collect()) == sorted(seen["mix"]) and {"shard", "slot"} <= set(final.columns)


def test_language_id_by_brute_force_and_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    say = [["ab", "abc", "bca"], ["bcd", "dcb", "cab"], ["xyz", "ab", "zzy"]]
    rows = [(i, " ".join(rng.choice(say[i % 3], 5)), f"l{i % 3}", "a") for i in range(60)] + [(100, "ab xyz bcd", None, "a"), (101, "ab xyz bcd", None, "a")]
    both = table(spark, rows)
    grams = lambda t: [f" {t} "[i : i + n] for n in (2, 3) for i in range(len(t) + 3 - n)]
    bucket = {}
    for _, t, _, _ in rows:
        for g in grams(t):
            # A gram's own bucket: what its text has beyond the buckets of its first and its last part.
            bucket.setdefault(g, None)
    c = {g: [ord(x) for x in g] for g in bucket}
    m = 0xFFFFFFFF
    for g, k in c.items():
        two = (k[0] * 0x9E3779B1 + k[1] * 0x85EBCA6B) & m
        three = (two * 0xC2B2AE35 + k[2] * 0x27D4EB2F) & m if len(k) == 3 else None
        bucket[g] = ((two ^ (two >> 15)) * 0x2C1B3C6D & m) >> 16 if three is None else ((three ^ (three >> 15)) * 0x297A2D39 & m) >> 16
    seen, docs_of = defaultdict(Counter), Counter()
    for _, t, lang, _ in rows:
        if lang:
            docs_of[lang] += 1
            seen[lang].update(bucket[g] for g in grams(t))
    want = {}
    for d, t, _, _ in rows:
        total = {k: math.log(docs_of[k] / 60) + sum(math.log((seen[k][bucket[g]] + 0.5) / (sum(seen[k].values()) + 0.5 * 65536)) for g in grams(t)) for k in sorted(docs_of)}
        top = max(total, key=total.get)
        want[d] = (top, 1 / sum(math.exp(x - total[top]) for x in total.values()))
    for block in (256, 2):
        monkeypatch.setattr(langid, "BLOCK", block)
        got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(both, langid.fit(both)).collect()}
        assert got.keys() == want.keys() and all(got[d][0] == k and math.isclose(got[d][1], s, rel_tol=1e-3) for d, (k, s) in want.items())
        assert {r.lang_pred for r in langid.predict(table(spark, [(1, None, None, None), (2, "1 2", None, None)]), langid.fit(both)).collect()} == {"und"}


def xx(data: bytes) -> int:
    import xxhash

    h = xxhash.xxh64(data, seed=42).intdigest()
    return h - (1 << 64) if h >= 1 << 63 else h


def test_mixing_rounds_as_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(n)), None, "ab"[i % 2]) for i, n in enumerate(rng.integers(0, 60, 400))]
    got = mixing.mix_documents(table(spark, rows, False)).collect()
    for source in "ab":
        left, mine = 0.0, sorted((r for r in got if r.source == source), key=lambda r: (-r["size"], xx(r.doc_id.to_bytes(8, "little"))))
        for r in mine:  # 200 documents of a source are one bucket
            want = r["size"] * r.rate + left
            copies = 1 if not r["size"] else min(math.ceil(r.rate), max(math.floor(r.rate), math.floor(want / r["size"] + 0.5)))
            assert r.copies == copies
            left = want - copies * r["size"]


def test_kd_sharding_holds_few_medians(spark, monkeypatch):
    rows = [(i, text(i % 90, 5 + i % 40) if i % 3 else text(7, 60), "en", None) for i in range(120)]
    joined, stored, store = kd_sharding.HELD, [], kd_sharding.store
    monkeypatch.setattr(kd_sharding, "store", lambda df, name: stored.append(name) or store(df, name))
    got = sorted(map(repr, kd_sharding.shard_documents(table(spark, rows)).collect()))
    # Every digit of every level had a table that was stored and joined.
    assert len(stored) <= 6 and joined >= 4
    monkeypatch.setattr(kd_sharding, "HELD", 0)
    assert got == sorted(map(repr, kd_sharding.shard_documents(table(spark, rows)).collect()))


def test_kd_sharding_by_sorting(spark):
    rows = [(i, text(i % 150, 5 + i * 7 % 90), "en", "a") for i in range(900)] + [(5000 + i, "copy " * 40, "en", "a") for i in range(500)]
    frame = table(spark, rows)
    items = [r.asDict() for r in kd_sharding.document_items(frame).collect()]
    dims = ("log_bytes", "bytes_per_char", "line_chars")
    for d in dims:
        low, high = min(x[d] for x in items), max(x[d] for x in items)
        for x in items:
            code = math.floor((x[d] - low) / (high - low) * ((1 << 24) - 1)) if high > low else 0
            x["at", d] = (code << 38) | (xx(x["text_hash"].to_bytes(8, "little", signed=True)) & ((1 << 38) - 1))

    def split(part, first, leaves, out):
        if leaves == 1:
            out.update({x["doc_id"]: first for x in part})
            return
        d = max(dims, key=lambda d: (max(x["at", d] for x in part) - min(x["at", d] for x in part), -dims.index(d)))
        whole, low = sum(x["size"] for x in part), leaves // 2
        want, upto, cut, below = whole * low / leaves, 0, None, 0
        for x in sorted(part, key=lambda x: x["at", d]):
            if cut is None or x["at", d] != cut:
                if upto >= want:
                    break
                cut, below = x["at", d], upto
            upto += x["size"]
        before, after = want - below, upto - want
        group = [x for x in part if x["at", d] == cut]
        if min(before, after) > 0.01 * whole / leaves:
            assert len({x["text_hash"] for x in group}) == 1
            tie = lambda x: (xx_pair(x["doc_id"], x["text_hash"]) % (1 << 64)) >> 2
            near, held = set(), 0
            for x in sorted(group, key=tie):
                if held >= before:
                    break
                near.add(x["doc_id"])
                held += x["size"]
        else:
            near = set() if before < after else {x["doc_id"] for x in group}
        left = [x for x in part if x["at", d] < cut or x["doc_id"] in near]
        names = {x["doc_id"] for x in left}
        split(left, first, low, out)
        split([x for x in part if x["doc_id"] not in names], first + low, leaves - low, out)

    def xx_pair(a, b):
        import xxhash

        seed = xx(a.to_bytes(8, "little")) % (1 << 64)
        h = xxhash.xxh64(b.to_bytes(8, "little", signed=True), seed=seed).intdigest()
        return h - (1 << 64) if h >= 1 << 63 else h

    want: dict[int, int] = {}
    split(items, 0, 8, want)
    assert {r.doc_id: r.shard for r in kd_sharding.shard_documents(frame).collect()} == want


def test_quality_verdicts_against_numpy(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(240):
        w = text(i, 70 + i % 50).split()
        if i % 9 == 0:  # symbols in some, repeated phrases and lines in others
            for j in rng.choice(len(w), 1 + i % 40, replace=False):
                w[j] += "#"
        t = " ".join(w)
        if i % 7 == 0:
            t += "\n" + "\n".join(["alpha beta gamma"] * (i % 12))
        rows.append((i, t, "en" if i % 2 else "de", "a"))
    rows += [(900, rows[0][1], "fr", "a"), (900, rows[0][1], "en", "a"), (901, None, None, None)]
    got = quality.judge(table(spark, rows)).collect()
    by = defaultdict(list)
    for r in got:
        if not r.base_failed:
            n = max(1, r.n_words)
            by[r.lang].append((r, [math.log(r.word_chars / n), math.log1p(100 * r.n_symbols / n), math.sqrt(10 * r.n_dup_lines / n), r.n_repeat_words / n]))
    floors = np.diag(np.square(quality.FLOORS))
    for lang in ("en", "de"):
        x = np.array([v for _, v in by[lang]])
        h, best = math.ceil(len(x) / 2), None
        for k in range(60):  # exact halves from many random starts
            own = rng.choice(len(x), h if k % 2 else 12, replace=False)
            for _ in range(50):
                m, s = x[own].mean(0), np.cov(x[own].T, bias=True) * quality.CONSISTENCY + floors
                d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
                new = np.argsort(d, kind="stable")[:h]
                if set(new) == set(own):
                    break
                own = new
            if best is None or np.linalg.det(s) < best[0]:
                best = (np.linalg.det(s), d)
        clear = [(r.kept, bool(e <= quality.CUTOFF)) for (r, _), e in zip(by[lang], best[1]) if abs(e / quality.CUTOFF - 1) > 0.25]
        assert len(clear) > 0.9 * len(x) and all(a == b for a, b in clear) and not all(a for a, _ in clear)
    kept = sorted((r.doc_id, r.lang) for r in quality.keep_good(table(spark, rows)).collect())
    assert kept == sorted((r.doc_id, r.lang) for r in got if r.kept)


def test_language_model_beats_the_unigram_counts_on_held_out_text(spark):
    scored = llm_queries.op5_lm(spark, "/root/testdata/sf0.01").where("held_out")
    better = F.avg((F.col("score") > F.col("base_score")).cast("double"))
    r = scored.agg(F.sum("base_score").alias("base"), F.sum("score").alias("score"), better.alias("better")).first()
    assert r.score > 0.97 * r.base and r.better > 0.9
