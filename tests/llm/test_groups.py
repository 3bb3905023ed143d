"""Operators that compare documents: exact and near duplicates, resampling, components, the pipeline."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidewright.llm import exact_dedup, near_dedup, resampling, superminhash, words
from tidewright.llm.components import connected_components
from tidewright.llm.near_dedup import near_duplicates

DATA = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"component_id": F.lit("clash"), "keep_id": F.lit(1.5)})


# words and signatures

lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aAbéÉ漢 \n\t\x0b\x1c\x85\xa0", max_size=30), max_size=8))
def test_word_hashes_tell_words_apart(texts):
    hashes, counts = words.word_hashes(texts)
    want = [split(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(5000))
    whole = words.word_hashes([text, "x", text])
    monkeypatch.setattr(words, "PIECE_BYTES", 700)
    parts = words.word_hashes([text, "x", text])
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def shingles(t):
    w = split(t)
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=60), min_size=1, max_size=6))
def test_shingle_set_sizes(texts):
    elements, sizes = superminhash.shingle_sets(texts)
    assert sizes.tolist() == [len(shingles(t)) for t in texts]
    sets = np.split(elements, np.cumsum(sizes)[:-1])
    for (a, x), (b, y) in itertools.combinations(zip(texts, sets, strict=True), 2):
        assert len(set(x.tolist()) & set(y.tolist())) == len(shingles(a) & shingles(b))


def plain_superminhash(elements, m):
    """The method as published: one permutation an element, ranks in order."""
    sig = [float("inf")] * m
    for e in elements:
        p = list(range(m))
        for j in range(m):
            frac, k = superminhash._draw(np.array([e], np.uint64), j, m)
            k = int(k[0])
            p[j], p[k] = p[k], p[j]
            sig[p[j]] = min(sig[p[j]], (j << 32) | int(frac[0]))
    return sig


@pytest.mark.parametrize("n", [1, 2, 3, 10, 40, 200])
def test_signatures_equal_the_plain_method(n):
    rng = np.random.default_rng(n)
    sets = [np.sort(rng.integers(0, 2**63, n).astype(np.uint64)), np.sort(rng.integers(0, 2**63, 7).astype(np.uint64))]
    sizes = np.array([n, 0, 7])
    found = superminhash.signatures(np.concatenate(sets), sizes, 16)
    assert found[0].tolist() == plain_superminhash(sets[0], 16)
    assert found[2].tolist() == plain_superminhash(sets[1], 16)
    assert (found[1] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 300).astype(np.uint64)
    shares = []
    for _ in range(40):
        rng.shuffle(pool)
        a, b = pool[:200], pool[50:250]  # J = 150 / 250
        sig = superminhash.signatures(np.concatenate([a, b]), np.array([200, 200]), 144)
        shares.append((sig[0] == sig[1]).mean())
    assert np.mean(shares) == pytest.approx(0.6, abs=0.02) and np.std(shares) < np.sqrt(0.24 / 144) * 1.1


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 30)), st.sets(st.integers(0, 30)), st.integers(1, 100))
def test_jaccard_threshold(a, b, percent):
    arrays = [np.array(sorted(x), np.uint64) for x in (a, b)]
    assert superminhash.jaccard_at_least(*arrays, percent) == (bool(a and b) and 100 * len(a & b) >= percent * len(a | b))


# components


def union(pairs):
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none", "loops"])
def test_components(spark, kind):
    rng = random.Random(1)
    pairs = {
        "chain": [(k, k + 1) for k in range(200)],
        "star": [(500, k) for k in range(300)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)],
        "none": [],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
    }[kind]
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs, "u long, v long").repartition(5)
    found = [(r.id, r.component) for r in connected_components(df).collect()]
    want = union([p for p in pairs if p[0] != p[1]])
    assert len(found) == len(want) and dict(found) == want


# exact duplicates


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab é漢\n\t\x0b", max_size=400), st.integers(1, 40))
def test_chunks_rebuild_the_text(text, times):
    raw = exact_dedup.normalise(text * times)
    assert raw.decode() == re.sub(r"[\x20\x09-\x0D]+", " ", text * times)
    parts = exact_dedup.chunks(raw)
    assert b"".join(parts) == raw and all(parts)
    for p in parts:
        p.decode()
        assert len(p) <= exact_dedup.MOST
    assert all(len(p) >= exact_dedup.LEAST - 3 for p in parts[:-1])


def test_chunks_follow_content():
    rng = random.Random(2)
    body = bytes(rng.randrange(97, 123) for _ in range(200_000))
    a, b = exact_dedup.chunks(body), exact_dedup.chunks(b"some other beginning " + body)
    assert len(set(a) & set(b)) > 0.9 * len(a)
    assert 1000 < len(body) / len(a) < 4000
    assert max(map(len, exact_dedup.chunks(b"a" * 100_000))) <= exact_dedup.MOST


EXACT = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (5, None), (4, ""), (None, "a b"), (1, "a\nb"), (9, "long " * 20_000), (8, "long  " * 20_000), (7, " "), (6, " "), (11, "A b"), (12, "\n")]


def brute_exact(rows):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    out = []
    seen = set()
    for i, t in rows:
        same = [x for x, u in rows if key(u) == key(t)]
        ids = [x for x in same if x is not None]
        keep = min(ids) if ids else None
        kept = i == keep and (i, key(t)) not in seen
        if kept:
            seen.add((i, key(t)))
        out.append((i, keep, len(same), kept, hashlib.sha256(key(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_equals_brute_force(spark):
    found = [tuple(r) for r in exact_dedup.exact_duplicates(table(spark, EXACT)).collect()]
    assert sorted(found, key=str) == brute_exact(EXACT)
    assert exact_dedup.exact_duplicates(table(spark, EXACT).where("false")).count() == 0


def test_exact_with_colliding_chunk_hashes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_hash", lambda c: len(c) % 3)
    found = [tuple(r) for r in exact_dedup.exact_duplicates(table(spark, EXACT)).collect()]
    assert sorted(found, key=str) == brute_exact(EXACT)


# near duplicates


def brute_near(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if None not in (a, b) and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    comp = union(links)
    return sorted([(i, len(s), comp.get(i, i) if s else i, i == (comp.get(i, i) if s else i)) for i, s in sets], key=str)


def near_rows(seed, n, vocab=400, size=60, edits=4):
    """Families of near copies around the threshold, with shared passages."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocab)}"
    passage = [word() for _ in range(30)]
    rows, i = [], 0
    while i < n:
        base = [word() for _ in range(rng.randrange(1, size))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(edits)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((i, rng.choice([" ", "\n", "  "]).join(copy)))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_equals_brute_force(spark, seed):
    rows = near_rows(seed, 250) + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "x y z " * 4000), (None, "one"), (907, "x y z " * 3999)]
    found = [tuple(r) for r in near_duplicates(table(spark, rows)).collect()]
    assert sorted(found, key=str) == brute_near(rows)


def test_near_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(near_dedup, "CACHE_SHINGLES", 200)
    rows = near_rows(7, 200, edits=9)
    found = [tuple(r) for r in near_duplicates(table(spark, rows)).collect()]
    assert sorted(found, key=str) == brute_near(rows)


def test_near_without_pruning_by_signatures(spark):
    rows = near_rows(11, 120, edits=9)
    found = [tuple(r) for r in near_duplicates(table(spark, rows), sigmas=None).collect()]
    assert sorted(found, key=str) == brute_near(rows)


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12), st.sampled_from([50, 75, 100]))
def test_links_stand_on_shingles(a, b, percent):
    x, y = (near_dedup.shingles(near_dedup.words(" ".join(t))) for t in (a, b))
    want = bool(x and y) and 100 * len(x & y) >= percent * len(x | y)
    assert (x, y) == (shingles_of(a), shingles_of(b)) and near_dedup.similar(x, y, percent) == want


def shingles_of(ws):
    return {tuple(w.encode() for w in ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()


def test_hashes_alone_make_no_link(spark, monkeypatch):
    """With shingle hashes that all agree, pairs are still told apart by their shingles."""
    rows = near_rows(5, 60)
    real = near_dedup.similar
    want = brute_near(rows)
    monkeypatch.setattr(near_dedup, "jaccard_at_least", lambda a, b, percent: True)
    found = [tuple(r) for r in near_duplicates(table(spark, rows), sigmas=None).collect()]
    assert real is near_dedup.similar and sorted(found, key=str) == want


def test_texts_of_template_pages_move_once(spark, monkeypatch):
    """Pages that are half a template crowd the buckets; their texts go to no tile, nor more than once to be sketched."""
    counts = {}
    real = near_dedup.cut

    def counting(df, label):
        out = real(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "cut", counting)
    rng = random.Random(1)
    shared = [f"s{rng.randrange(10**6)}" for _ in range(104)]
    rows = [(k, " ".join(shared + [f"u{rng.randrange(10**7)}" for _ in range(50)])) for k in range(5000)]
    assert near_duplicates(table(spark, rows).repartition(8)).where("not kept").count() == 0
    assert counts["members"] > 5000 and counts["texts"] <= 5000 and counts["edges"] + counts["tiles"] < 500


def test_recall_near_the_threshold(spark):
    """Pairs of a similarity of 0.75 to 0.8 are found."""
    rng = random.Random(9)
    rows = []
    for k in range(400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        copy = list(base)
        at = rng.sample(range(10, 190, 6), rng.choice([4, 5]))
        for j in at:
            copy[j] = f"x{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    want = brute_near(rows)
    found = sorted([tuple(r) for r in near_duplicates(table(spark, rows)).collect()], key=str)
    linked = sum(not r[3] for r in want)
    assert linked > 200 and sum(not r[3] for r in found) >= 0.99 * linked


def test_near_ties_repeats_and_empty(spark):
    text = " ".join(f"t{k}" for k in range(40))
    rows = [(5, text), (5, text), (4, text.upper()), (9, "other words in a row here"), (9, text)]
    found = sorted((tuple(r) for r in near_duplicates(table(spark, rows)).collect()), key=str)
    assert found == sorted([(5, 36, 4, False), (5, 36, 4, False), (4, 36, 4, True), (9, 2, 4, False), (9, 36, 4, False)], key=str)
    assert near_duplicates(table(spark, rows).where("false")).count() == 0
    assert near_duplicates(table(spark, [(1, None), (2, "")])).where("kept").count() == 2


def test_links_across_a_hub_are_found(spark):
    """Members of one bucket that miss its hub but reach each other are linked."""
    base = [f"b{k}" for k in range(100)]
    def edited(at):
        out = list(base)
        for k in at:
            out[k] = f"e{k}-{len(at)}"
        return " ".join(out)
    rows = [(0, edited([])), (1, edited([10, 30, 50, 70])), (2, edited([10, 30, 50, 70, 90][:4]) + " tail"), (3, edited(range(0, 100, 9)))]
    found = [tuple(r) for r in near_duplicates(table(spark, rows)).collect()]
    assert sorted(found, key=str) == brute_near(rows)


# resampling


def test_kth_largest(spark):
    rng = random.Random(0)
    values = [rng.randrange(1 << 62) for _ in range(300)] + [5] * 40 + [0]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    order = sorted(values, reverse=True)
    for k in (1, 2, 150, 301, 340, 341):
        assert resampling.kth_largest(df, "x", k) == order[k - 1]
    assert resampling.kth_largest(df, "x", 342) is None


def brute_ratio(texts, good):
    """Log weights by dictionaries over the same buckets."""
    raw, target = np.zeros(resampling.BUCKETS), np.zeros(resampling.BUCKETS)
    bags = []
    for t, g in zip(texts, good, strict=True):
        at, _ = resampling.grams([t])
        bags.append(at)
        for b in at.tolist():
            raw[b] += 1
            target[b] += g
    n = resampling.BUCKETS
    r = (raw + 1) / (raw.sum() + n)
    return [float((np.log((target + n * r) / (target.sum() + n)) - np.log(r))[b].sum()) for b in bags]


def test_resampling_equals_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "one", *[" ".join(rng.choice(["good", "fine", "bad", "junk", "é"]) for _ in range(rng.randrange(1, 30))) for _ in range(60)], "word " * 20_000]
    rows = list(enumerate(texts))
    good = [i % 3 == 0 for i in range(len(texts))]
    target = spark.createDataFrame([(i,) for i, g in enumerate(good) if g], "doc_id long")
    found = {r.doc_id: r for r in resampling.resample(table(spark, rows), target, 0.5).collect()}
    for i, w in enumerate(brute_ratio(texts, good)):
        assert found[i].log_weight == pytest.approx(w, abs=1e-6), texts[i]
        assert found[i].n_grams == max(2 * len(split(texts[i])) - 1, 0)
    order = sorted(found.values(), key=lambda r: -r.gumbel_key)
    k = -(-len(texts) // 2)
    assert [r.kept for r in order] == [True] * k + [False] * (len(texts) - k)


def test_weights_do_not_depend_on_batches(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["good", "fine", "bad", "junk", "é"]) for _ in range(rng.randrange(0, 300))) for _ in range(200)]
    target = spark.createDataFrame([(i,) for i in range(0, 200, 3)], "doc_id long")
    weights = lambda df: {r.doc_id: (r.log_weight, r.gumbel_key) for r in resampling.resample(df, target, 0.5).collect()}
    rows = list(enumerate(texts))
    assert weights(table(spark, rows).coalesce(1)) == weights(table(spark, rows[::-1]).repartition(7))


def test_gumbel_noise_draws_by_weight(spark):
    """Of many equal texts any can be drawn, and noise has the Gumbel mean."""
    rows = [(i, "same text") for i in range(4000)]
    none = spark.createDataFrame([], "doc_id long")
    found = resampling.resample(table(spark, rows), none, 0.25)
    r = found.agg(F.avg("gumbel_key"), F.count_if("kept"), F.max(F.abs("log_weight"))).first()
    assert r[0] == pytest.approx(0.5772, abs=0.08) and r[1] == 1000 and r[2] == 0.0


def test_resampling_edges(spark):
    none = spark.createDataFrame([], "doc_id long")
    df = table(spark, [(None, "a b"), (1, "a b"), (1, "a b")])
    assert resampling.resample(df.where("false"), none, 0.5).count() == 0
    assert resampling.resample(df, none, 0.0).where("kept").count() == 0
    assert resampling.resample(df, none, 1.0).where("kept").count() == 3


def test_quality_labels_are_told_apart(spark):
    from tidewright.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    found = QUERIES["op1_importance_resampling"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    rate = {r.quality: r.k for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rate[1] > 0.9 and rate[0] < 0.4


# pipeline


def pipeline_rows():
    rng = random.Random(3)
    word = lambda lang: rng.choice({"en": ["the", "and", "house", "with", "over", "tree"], "de": ["der", "und", "haus", "mit", "über", "baum"]}[lang]) + str(rng.randrange(60))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    item = "question " + text("en", 30)
    rows = [(i, text(lang := ("en", "de")[i % 2], rng.randrange(3, 60)), lang) for i in range(60)]
    base = text("en", 50)
    rows += [(100, base, "en"), (101, base.replace(" ", "\n", 3), "en"), (102, base + " end", "en"), (103, "123 ...", "en"), (104, None, "de"), (105, item + " and more", "en"),
             (106, "", "de"), (107, text("de", 300) + " " + " ".join(item.split()[:14]), "de"), (0, rows[0][1], "en")]
    return rows, [(1, item), (2, None)]


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    from tidewright.llm.queries import tokenizer_path
    from test_row_operators import brute_scan

    rows, items = pipeline_rows()
    full = [(i, t, g, "s", len(t or "")) for i, t, g in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [(i, t) for i, t, _ in rows if any(c.isalpha() for c in t or "")]
    exact = {r[0] for r in brute_exact(left) if r[3]}
    left = list({i: (i, t) for i, t in left if i in exact}.values())
    near = {r[0] for r in brute_near(left) if r[3]}
    clean = {}
    for i, t in left:
        n, hit, _ = brute_scan(t, [(str(k), x) for k, x in items])
        if i in near and not (hit and 20 * len(hit) >= n):
            clean[i] = t
    assert set(found) == set(clean) and not {101, 102, 103, 104, 105, 106} & set(found) and {100, 107} <= set(found)
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for i, t in clean.items():
        assert found[i].ids == library.encode(t, add_special_tokens=False).ids


def stage_rows():
    """Ids and texts that repeat: rows, in the columns of documents."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in ("the", "and", "house"))
    texts = [(3, b), (5, a), (5, b), (5, b + " "), (7, c), (7, c), (7, c.replace(" ", "\n", 2)), (None, a), (None, "only here"), (None, "only  here"),
             (1, a + " end"), (8, " "), (8, c + " end"), (8, ""), (9, None), (None, None), (11, "é\x85x\x1c ß\xa0 漢\x0b\x00 🙂"), (11, "é\x85x\x1c ß\xa0 漢\x0c\x00\t🙂")]
    return [(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(texts)]


def test_dedup_stages_keep_the_rows_that_are_marked(spark, tmp_path):
    rows = stage_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[3])):
        least.setdefault((r[0], norm(r[1])), r)
    digest = lambda r: hashlib.sha256(norm(r[1]).encode()).hexdigest()
    marked = {(i, d) for i, _, _, kept, d in brute_exact([r[:2] for r in rows]) if kept}
    want = [r for r in least.values() if (r[0], digest(r)) in marked]
    exact = [tuple(r) for r in corpus_pipeline.exact_dedup(spark, docs, "").collect()]
    assert sorted(exact, key=str) == sorted(want, key=str) and len({norm(r[1]) for r in rows}) == len(want)

    for given in (want, rows):
        near = corpus_pipeline.minhash_near_dedup(spark, spark.createDataFrame(given, docs.schema), "")
        judged = near_duplicates(spark.createDataFrame(given, docs.schema)).where("kept").collect()
        left = [tuple(r) for r in near.collect()]
        count = lambda r, n: (str(r[0]), n)
        assert sorted(count(r, len(shingles(r[1]))) for r in left) == sorted(count(r, r.n_shingles) for r in judged)
        assert all(r in given for r in left)


def test_pipeline_gives_each_document_once(spark, tmp_path):
    rows = stage_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "question nobody asks")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = [(r.doc_id, r.source) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    # document 5 is a near copy of 1 by its text a and of 3 by its text b, (8, c end) of 7; (None, a) is an exact copy of 5
    assert sorted(found, key=str) == sorted([(7, "s6"), (None, "s9"), (1, "s10"), (11, "s16")], key=str)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        empty = stage(spark, docs.where("false"), DATA)
        assert empty.columns == docs.columns and empty.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), DATA).count() == 0


def test_stages_with_clashing_columns_nulls_and_repeats(spark, tmp_path):
    """Extra columns named as the operators' own keep their values; null, empty and repeated rows fare as stated."""
    item = " ".join(f"question{k}" for k in range(20))
    prose = lambda x: " ".join(f"{x}{k} the and house of" for k in range(12))
    texts = [(1, prose("a"), "en"), (1, prose("a"), "en"), (2, None, "en"), (3, "", None), (4, item, "en"), (5, "123 ...", "en"), (None, prose("b"), None)]
    extra = ["lang_pred", "score", "contaminated", "n_words", "hit_spans", "_name", "_place", "_bare", "_h", "d", "sig", "ids"]
    rows = [(i, t, lang, f"s{k}", len(t or ""), *[f"{c}-{k}" for c in extra]) for k, (i, t, lang) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        left[name] = sorted(int(r.source[1:]) for r in out.collect())
        assert all(tuple(r) in rows for r in out.collect())
    assert left == {
        "language_id": [0, 1, 4, 6],
        "exact_dedup": [0, 2, 4, 5, 6],
        "minhash_near_dedup": [0, 1, 2, 3, 4, 5, 6],
        "benchmark_decontamination": [0, 1, 2, 3, 5, 6],
    }
    assert corpus_pipeline.benchmark_decontamination(spark, docs, f"{tmp_path}/none").count() == 7
    coded = corpus_pipeline.bpe_encoding(spark, docs, str(tmp_path)).collect()
    assert len(coded) == 7 and all((r.n_tokens == 0) == (r.source in ("s2", "s3")) and len(r.ids) == r.n_tokens for r in coded)
