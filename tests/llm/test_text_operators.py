"""Operators on texts against brute force, with nulls, empty and long texts, repeated rows and empty tables."""

import hashlib
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from collatium.llm import op1_bpe, op2_quality, op4_lm, op5_langid, op8_mixing, op10_simhash, queries

tokenizers = pytest.importorskip("tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    t = tokenizers.Tokenizer.from_file(BPE)
    t.no_truncation()
    t.no_padding()
    for text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, dtype="<u4").tobytes()
        yield len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_equals_the_library(spark, sf, odd):
    got = {r.doc_id: tuple(r)[1:4] for r in queries.op1_bpe_roundtrip(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == {d.doc_id: x for d, x in zip(docs, library([d.text for d in docs]), strict=True)}
    rows = op1_bpe.encode_decode(odd, BPE).select("text", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert [tuple(r)[1:] for r in rows] == list(library([r.text for r in rows]))


@pytest.mark.parametrize("text", ["", " ", "don't  stop\n\n\tnow ", "<|endoftext|>a <|endoftext|>", "naïve Ωμέγα 日本語 👩‍👩‍👧  x", "a" * 9000, "\x00\x85\xa0½²", "'S 'll'RE x've"])
@pytest.mark.parametrize("fast", [True, False])
def test_bpe_of_single_texts(text, fast):
    codec = op1_bpe.Codec(BPE, fast)
    ids = codec.encode(text)
    n, sha, decoded = next(library([text]))
    assert (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()) == (n, sha, decoded)


def test_bpe_empty_table(none):
    assert op1_bpe.encode_decode(none, BPE, keep_ids=True).count() == 0


def test_forced_boundaries_never_divide_a_token():
    codec = op1_bpe.Codec(BPE, fast=False)
    assert all(len(codec.cuts(token)) == 1 for token in codec.bytes_of if token and token != b"<|endoftext|>")


def backoff(texts, order):
    """(tokens, score, score without the document's own counts) of each text by stupid backoff."""
    docs = [(t or "").lower().split() for t in texts]
    own = [Counter(tuple(w[i - n + 1 : i + 1]) for n in range(1, order + 1) for i in range(n - 1, len(w))) for w in docs]
    whole = sum(own, Counter())
    total = sum(map(len, docs))

    def score(w, c, size):
        logs = 0.0
        for i in range(len(w)):
            factor = 1.0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    logs += math.log(factor * (c(g) or op4_lm.BACKOFF) / max(1, size))
                elif c(g) > 0:
                    logs += math.log(factor * c(g) / c(g[:-1]))
                    break
                factor *= op4_lm.BACKOFF
        return logs if w else None

    for w, mine in zip(docs, own, strict=True):
        yield len(w), score(w, whole.__getitem__, total), score(w, lambda g, mine=mine: whole[g] - mine[g], total - len(w))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores(spark, sf, odd, order, monkeypatch):
    monkeypatch.setattr(op4_lm, "PART", 20_000)
    monkeypatch.setattr(op4_lm, "BLOCK", 30_000)
    for docs in (spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), odd):
        rows = docs.collect()
        want = sorted(((str(r.doc_id), n, s or 0, h or 0) for r, (n, s, h) in zip(rows, backoff([r.text for r in rows], order), strict=True)))
        got = sorted((str(r.doc_id), r.n_tokens, r.log_score or 0, r.held_out_score or 0) for r in op4_lm.score(docs, order=order).collect())
        assert [x[:2] for x in got] == [x[:2] for x in want]
        for at in (2, 3):
            assert [x[at] for x in got] == pytest.approx([x[at] for x in want], abs=0.002)
    assert op4_lm.score(odd).filter("n_tokens = 0 and (log_score is not null or held_out_score is not null)").count() == 0


def test_the_registered_model_has_contexts_of_two_words(spark):
    """'a b c' and 'x b d' are each found once more: after two words the next one is certain, after 'b' alone it isn't."""
    texts = ["a b c", "a b c", "x b d", "x b d"]
    got = op4_lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x for r in got for x in (r.log_score, r.held_out_score)] == pytest.approx([x for _, s, h in backoff(texts, 3) for x in (s, h)], abs=1e-5)


def test_backoff_empty_table(none):
    assert op4_lm.score(none).count() == 0


def test_packed_hashes_and_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        h = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (op4_lm.unpack_hashes(op4_lm.pack_hashes(h)) == h).all()
        c = rng.choice([0, 1, 254, 255, 256, 10**9], n)
        assert (op4_lm.unpack_counts(op4_lm.pack_counts(c), n) == c).all()


def test_quality_on_held_out_labels(spark, sf):
    big = sf.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    held = F.xxhash64("doc_id", F.lit(5)) % 3 == 0
    model = op2_quality.fit(docs, labels.filter(~held))
    got = op2_quality.score(docs, model).join(labels.filter(held), "doc_id").select("score", "quality", "source").collect()
    right = sum((r.score >= op2_quality.THRESHOLD) == (r.quality == 1) for r in got)
    assert right / len(got) >= 0.97
    assert all(r.score >= op2_quality.THRESHOLD for r in got if r.quality == 1)


def test_quality_of_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (3, None), (999, 1)], "doc_id long, quality int")
    rows = op2_quality.score(odd, op2_quality.fit(odd, labels))
    assert rows.count() == odd.count() and rows.filter("score is null or score < 0 or score > 1").count() == 0
    assert op2_quality.fit(odd, labels.limit(0)).constant == 1.0
    assert op2_quality.score(none, op2_quality.fit(none, labels)).count() == 0


def test_cotraining_hands_labels_over():
    """With few labels in a view, what the other view is sure of adds to it."""
    rng = np.random.default_rng(0)
    y = (rng.random(1200) < 0.5).astype(float)
    view = lambda noise: np.stack([np.ones(1200), y * 4 - 2 + rng.normal(size=1200) * noise], axis=1)
    a, b = view(0.5), view(1.0)
    model = op2_quality.cotrain((a[:40], b[:40]), y[:40], np.arange(40) % 2 == 0, op2_quality.in_memory((a[40:800], b[40:800]), np.arange(760)))
    p = model.score(a[800:], b[800:])[0]
    assert ((p > 0.5) == (y[800:] > 0)).mean() > 0.98


def test_cotraining_over_a_table_hands_over_what_brute_force_does(spark, sf):
    """One round's exchange over all unlabelled documents, and the fitted model, against the same in memory."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("xxhash64(doc_id) as name", "text", "source", "lang", "n_chars")
    table = op2_quality.features_of(docs).repartition(5)
    rows = table.collect()
    names = np.array([r.name for r in rows])
    pool = tuple(np.array([np.frombuffer(r[c], np.float32) for r in rows], dtype=float) for c in "tm")
    rng = np.random.default_rng(1)
    weights, taken = [rng.normal(size=x.shape[1]) for x in pool], [{int(n) for n in names[:20]}, set()]
    want = op2_quality.in_memory(pool, names, 7, 0.6)(weights, taken)
    got = op2_quality.in_table(table, 7, 0.6)(weights, taken)
    assert sorted(x[:3] for x in got) == sorted(x[:3] for x in want) and len(got) > 10
    assert not {n for v, _, n, _ in got if v == 0} & taken[0]


def test_quality_of_repeated_ids_repeats(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    twice = odd.unionByName(odd.selectExpr("doc_id", "reverse(text) as text", "lang", "source", "n_chars", *odd.columns[5:]))
    one, two = (op2_quality.fit(twice.repartition(k), labels) for k in (2, 3))
    assert np.allclose(one.mix, two.mix)


def test_language_of_documents_and_pages(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    half = F.xxhash64("doc_id", F.lit(9)) % 2 == 0
    model = op5_langid.fit(docs.filter(half), "doc_id", "text", "lang")
    got = op5_langid.identify(docs.filter(~half), model, "text", F.lit(None).cast("string"), F.lit(None).cast("string"))
    assert got.filter("language <> lang").count() <= 0.01 * got.count() and got.filter("not accepted").count() == 0
    pages = queries.op5_fused_language(spark, sf).collect()
    assert sum(p.language == p.declared for p in pages) >= 0.95 * len(pages)


def test_language_evidence(spark):
    names, table = op5_langid.LANGUAGES, np.full((op5_langid.BUCKETS, 5), -9.0, dtype=np.float32)
    model = op5_langid.Model(names, table)  # its texts say nothing
    rows = [(i, "some words", "es", "shop.es") for i in range(3)] + [(9, "some words", None, "shop.fr"), (10, "%% 12", "es", "shop.es"), (11, None, "de", None), (12, "x", "zz", "")]
    df = spark.createDataFrame(rows, "id long, text string, said string, host string")
    got = {r.id: (r.language, r.accepted) for r in op5_langid.identify(df, model, "text", F.col("said"), F.col("host")).collect()}
    assert got[0] == ("es", True) and got[9] == ("fr", True) and got[10] == ("und", False) and got[11] == ("de", True) and len(got) == 7


def test_host_priors_are_smoothed_by_domain(spark):
    votes = spark.createDataFrame([("a.x.org", "x.org", 0)] * 50 + [("b.x.org", "x.org", 1)] + [("c.y.org", "y.org", 1)] * 50, "_host string, _domain string, _best int")
    p = {r._host: np.exp(r._prior) for r in op5_langid.host_priors(votes, 2).collect()}
    assert all(abs(v.sum() - 1) < 1e-9 for v in p.values())
    assert p["a.x.org"][0] > 0.8 and p["c.y.org"][1] > 0.8 and p["b.x.org"][0] > 0.6


def test_posterior_by_brute_force(spark):
    """Priors, declarations, suffixes and likelihoods multiplied out by hand."""
    rng, langs = np.random.default_rng(2), op5_langid.LANGUAGES
    model = op5_langid.Model(langs, rng.normal(-9, 1, (op5_langid.BUCKETS, 5)).astype(np.float32))
    hosts = ["a.x.co.uk", "b.x.co.uk", "c.shop.de", None, "", "plain"]
    rows = [(i, "".join(rng.choice(list("abcdefg "), 40)) if i % 7 else None, ["de", "fr", None, "zz"][i % 4], hosts[i % 6]) for i in range(120)]
    got = op5_langid.identify(spark.createDataFrame(rows, "id long, text string, said string, host string"), model, "text", F.col("said"), F.col("host")).collect()
    ll = {r[0]: np.array(model.likelihoods(r[1])) for r in rows}
    domain = {"a.x.co.uk": "x.co.uk", "b.x.co.uk": "x.co.uk", "c.shop.de": "shop.de", "plain": "plain"}
    count = lambda of: np.bincount([int(ll[i].argmax()) for i, t, _, h in rows if h in of and t], minlength=5)[:4]
    base = (count(domain) + 1) / (count(domain).sum() + 4)
    smooth = lambda c, p: (c + op5_langid.STRENGTH * p) / (c.sum() + op5_langid.STRENGTH)
    prior = {h: smooth(count([h]), smooth(count([k for k in domain if domain[k] == d]), base)) for h, d in domain.items()}
    assert len(got) == len(rows)
    for r in got:
        p = np.append(np.log(prior.get(r.host, np.full(4, 0.25))), np.log(op5_langid.ODD)) + ll[r.id]
        for said, right in ((r.said, op5_langid.DECLARED), ({"a.x.co.uk": "en", "b.x.co.uk": "en", "c.shop.de": "de"}.get(r.host), op5_langid.SUFFIX)):
            if said in langs:
                p[:4] += np.log([right if x == said else (1 - right) / 3 for x in langs])
        p = np.exp(p - p.max())
        assert r.language == [*langs, "und"][int(p.argmax())] and r.confidence == pytest.approx(p.max() / p.sum(), abs=2e-6)
    quiet = [r for r in got if not r.text and not r.host and not r.said]
    assert quiet and all(r.confidence < 0.26 for r in quiet)  # nothing is known of them


def test_language_of_odd_rows(odd, none):
    model = op5_langid.fit(odd, "doc_id", "text", "lang")
    got = op5_langid.identify(odd, model, "text", F.col("lang"), F.col("source"))
    assert got.count() == odd.count() and got.filter("language is null or accepted is null").count() == 0
    assert op5_langid.identify(none, op5_langid.fit(none, "doc_id", "text", "lang"), "text", F.col("lang"), F.col("source")).count() == 0


def fingerprint(text, size=3):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints, most):
    """prints: {key: fingerprint}; smallest key reachable, by brute force."""
    of = {k: k for k in prints}

    def root(k):
        while of[k] != k:
            k = of[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= most and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                of[y] = x
    return {k: root(k) for k in keys}


def test_simhash_components(spark, sf, odd):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash_dedup(spark, sf).collect()}
    prints = {r.doc_id: fingerprint(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    comp = linked(prints, 3)
    assert got == {k: (f"{prints[k]:016x}", comp[k]) for k in prints}
    rows = op10_simhash.fingerprint_components(odd)
    assert rows.count() == odd.count()
    assert {r.doc_id: r.component_id for r in rows.filter("doc_id is not null").collect()} == {k: v for k, v in linked({r.doc_id: fingerprint(r.text) for r in odd.collect() if r.doc_id is not None}, 3).items()}


def test_simhash_links_of_random_prints(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 12)
    prints = {}
    for i in range(400):
        x = int(base[i % 12])
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            x ^= 1 << int(b)
        prints[i] = x
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in prints.items()], "node long, f0 long").dropDuplicates(["f0"])
    kept = {r.node for r in df.collect()}
    from collatium.llm.components import components

    want = linked({k: v for k, v in prints.items() if k in kept}, 3)
    for block in (8, 2048):
        comp = {r.node: r.component for r in components(op10_simhash.links(df, 1, 4, 3, True, block)).collect()}
        assert {k: comp.get(k, k) for k in kept} == want


def test_near_duplicates_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    sets = {}
    for k, t in rows.items():
        w = t.lower().split()
        sets[k] = frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    at = {}
    for k, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(k)
    met = Counter((a, b) for ks in at.values() for i, b in enumerate(ks) for a in ks[:i])
    alike = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in met.items()}
    group = {r.doc_id: r.group for r in op10_simhash.near_groups(docs).collect()}
    close = [p for p, j in alike.items() if j >= 0.8]
    caught = sum(a in group and group.get(a) == group.get(b) for a, b in close)
    assert caught >= 0.97 * len(close) and len(close) > 50
    # whoever is in a group has a partner that is at least nearly so similar
    partner = Counter()
    for (a, b), j in alike.items():
        partner[a], partner[b] = max(partner[a], j), max(partner[b], j)
    assert all(partner[k] >= 0.7 for k in group)


def passages(rng, n, shared, own):
    """n pairs of texts with a passage in common to all: each has words of its own, a pair differs in its last five words."""
    word = lambda: f"w{rng.integers(0, 10**9)}"
    passage = [word() for _ in range(shared)]
    for _ in range(n):
        mine = [word() for _ in range(own)]
        yield " ".join(passage + mine + [word() for _ in range(5)]), " ".join(passage + mine + [word() for _ in range(5)])


def test_near_duplicates_are_counted(spark):
    """Texts of n shingles with 8 in 9 of them common are at 0.8 and near; with one shingle less they aren't."""
    rng, rows, want = np.random.default_rng(5), [], {}
    for k in range(600):
        n = int(rng.choice([27, 90, 450]))
        words = [f"w{x}" for x in rng.integers(0, 10**9, n + 4)]
        shared = -(-8 * n // 9) - (k % 2)  # the least count that makes 0.8 of the union, and one less
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: shared + 4] + [f"v{x}" for x in rng.integers(0, 10**9, n - shared)]))]
        want[2 * k] = k % 2 == 0
    group = {r.doc_id: r.group for r in op10_simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not [k for k, near in want.items() if not near and k in group]
    assert sum(group.get(k + 1) == k for k, near in want.items() if near) >= 299


def test_near_duplicates_among_documents_that_share_a_passage(spark):
    """1,500 pairs at 0.9 within a passage that puts any two texts at 0.67: no pair is lost in the large buckets."""
    texts = [t for pair in passages(np.random.default_rng(8), 1500, 80, 14) for t in pair]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    group = {r.doc_id: r.group for r in op10_simhash.near_groups(docs).collect()}
    assert sum(group.get(2 * i, -1) == group.get(2 * i + 1, -2) for i in range(1500)) >= 1490


def test_exact_near_duplicates_lose_no_pair(spark):
    """With candidates by their first shingles, made pairs at 0.8 are all found; the chains stay within their budgets."""
    rng, rows = np.random.default_rng(6), []
    for k in range(200):
        n = int(rng.choice([9, 27, 90]))
        words = [f"w{x}" for x in rng.integers(0, 10**9, n + 4)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: -(-8 * n // 9) + 4] + [f"v{x}" for x in rng.integers(0, 10**9, n // 9)]))]
    group = {r.doc_id: r.group for r in op10_simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), exact=True).collect()}
    assert all(group.get(2 * k) == group.get(2 * k + 1) == 2 * k for k in range(200))


def test_keep_one_of_odd_rows(odd, none):
    kept = op10_simhash.keep_one(odd).collect()
    texts = [r.text for r in kept if (r.text or "").strip()]
    assert len(texts) == len(set(texts)) and sum(not (r.text or "").strip() for r in kept) == 1
    assert {r.text for r in odd.collect() if len((r.text or "").split()) > 12} <= {r.text for r in kept}
    assert op10_simhash.keep_one(none).count() == 0 and kept[0].__fields__ == odd.columns


def test_mixing_meets_its_targets(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    want = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
    rows = op8_mixing.described(docs)
    cells = rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    raked = op8_mixing.rake(cells, {"source": 1.0, "topic": 1.0, "lang": 1.0}, {"lang": want}).collect()
    for lang, share in want.items():
        assert sum(r.weight for r in raked if r.lang == lang) == pytest.approx(share, rel=2e-4)
    for name in ("source", "topic"):
        total = sum(r.tokens for r in raked)
        for v in {r[name] for r in raked}:
            assert sum(r.weight for r in raked if r[name] == v) == pytest.approx(sum(r.tokens for r in raked if r[name] == v) / total, rel=2e-4)
    got = op8_mixing.mix(docs).collect()
    assert len(got) == len({r.doc_id for r in got}) == docs.count()
    assert sum(r.tokens * r.prob for r in got) == pytest.approx(op8_mixing.KEEP * sum(r.tokens for r in got), rel=0.02)
    assert {r.doc_id for r in op8_mixing.sampled(docs).collect()} == {r.doc_id for r in got if r.selected}


def test_mixing_of_odd_rows(odd, none):
    got = op8_mixing.mix(odd)
    assert got.count() == odd.count() and got.filter("selected is null and doc_id is not null").count() == 0
    assert op8_mixing.sampled(odd).columns == odd.columns
    assert op8_mixing.mix(none).count() == 0 and op8_mixing.sampled(none).count() == 0
