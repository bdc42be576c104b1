"""Class n-grams, Kneser-Ney quality, fingerprints, near duplicates, neighbours, archives, pipeline."""

import gzip
import hashlib
import io
import math
import time
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from learnlens.llm import brown, hamming_join, kneser_ney, packing, pstable, spotsigs, warc
from learnlens.llm.shared import components

FEW = brown.Brown(classes=12, clustered=200, passes=2, workers=3)


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def check_scores(rows, documents):
    train = Counter(t for d, text in documents if not brown.held_out(d) for t in tokens(text))
    n, v = sum(train.values()), len(train)
    expected = []
    for d, text in documents:
        own = tokens(text)
        base = sum(math.log10((train[t] + 1) / (n + v + 1)) for t in own)
        expected.append((d, brown.held_out(d), len(own), sum(train[t] > 0 for t in own), n, base))
    order = lambda r: str(r[:4])
    for got, want in zip(sorted(map(tuple, rows), key=order), sorted(expected, key=order), strict=True):
        assert got[:5] == want[:5]
        assert got[5] == pytest.approx(want[5])
        assert got[6] <= 0 and math.isfinite(got[6])


def test_base_scores_by_brute_force_and_a_better_model(small, small_rows, scratch):
    rows = brown.score(small, scratch, brown.Brown(classes=16, clustered=2000, passes=3)).collect()
    check_scores(rows, list(small_rows.items()))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def plain_brown(documents, classes, model):
    """The score of every text, from the classes of the words alone; the chances themselves."""
    k = model.classes
    train = [tokens(t) for d, t in documents if not brown.held_out(d)]
    count = Counter(w for text in train for w in text)
    total = sum(count.values())
    unknown = (sum(c == 1 for c in count.values()) + 1) / (total + 2)
    of_class = Counter()
    for word, c in count.items():
        of_class[classes[word]] += c
    one, two, three = Counter(), Counter(), Counter()
    for text in train:
        line = [brown.ENDED, brown.ENDED, *(classes[w] for w in text)]
        for a, b, c in zip(line, line[1:], line[2:], strict=False):
            one[c] += 1
            two[b, c] += 1
            three[a, b, c] += 1
    after_two, after_one = Counter(), Counter()
    for (a, b, _), n in three.items():
        after_two[a, b] += n
    for (b, _), n in two.items():
        after_one[b] += n

    def chance(a, b, c):
        p1 = (one[c] + 0.1) / (total + 0.1 * k)
        p2 = (two[b, c] + model.bigram_weight * p1) / (after_one[b] + model.bigram_weight)
        return (three[a, b, c] + model.trigram_weight * p2) / (after_two[a, b] + model.trigram_weight)

    def text_score(text):
        a = b = brown.ENDED
        score = 0.0
        for word in tokens(text):
            c = classes[word] if word in count else k
            if c == k:
                score += math.log10(unknown)
            else:
                score += math.log10((1 - unknown) * chance(a, b, c) * count[word] / of_class[c])
            a, b = b, c
        return score

    return [(d, text_score(t)) for d, t in documents], chance, unknown


@pytest.mark.parametrize("model", [FEW, brown.Brown(classes=8, clustered=50, passes=3, workers=2)])
def test_scores_by_brute_force(small, small_rows, scratch, model):
    fitted = brown.fit(small, scratch, model)
    classes = brown.classes_of(fitted)
    documents = list(small_rows.items())
    assert set(classes) == {t for d, text in documents if not brown.held_out(d) for t in tokens(text)}
    expected, chance, unknown = plain_brown(documents, classes, model)
    got = {r["doc_id"]: r["score"] for r in brown.scored(fitted).collect()}
    assert set(got) == set(small_rows)
    assert all(got[d] == pytest.approx(s, rel=1e-9) for d, s in expected)
    # known words and one unknown share all probability, whatever comes before
    known = set(classes.values())
    assert 0 < unknown < 1
    for a, b in [(brown.ENDED, brown.ENDED), (2, 3), (model.classes, 2)]:
        assert sum(chance(a, b, c) for c in range(model.classes)) == pytest.approx(1, abs=1e-9)
    assert known <= set(range(model.classes))


def test_scores_of_awkward_texts(awkward, scratch):
    rows = brown.score(awkward, scratch, FEW).collect()
    check_scores(rows, [(r["doc_id"], r["text"]) for r in awkward.collect()])


def test_scores_without_training_texts(spark, nothing, scratch):
    assert brown.score(nothing, scratch, FEW).collect() == []
    held = [i for i in range(100) if brown.held_out(i)][:3]
    alone = spark.createDataFrame([(i, "some text") for i in held], "doc_id long, text string")
    assert [r["score"] for r in brown.score(alone, scratch, FEW).collect()] == [0.0] * 3


def test_an_exchange_never_lowers_the_likelihood():
    random = np.random.default_rng(3)
    k, words = 6, 30
    pairs = random.poisson(2.0, (words, words)) * (np.add.outer(np.arange(words) % 2, np.arange(words) % 2) == 1)
    classes = np.concatenate([[0, 1], 2 + np.arange(words - 2) % (k - 2)])

    def table(classes):
        out = np.zeros((k, k))
        np.add.at(out, (classes[:, None], classes[None, :]), pairs)
        return out

    def likelihood(classes):
        m = table(classes)
        x = brown._xlogx
        return x(m).sum() - x(m.sum(0)).sum() - x(m.sum(1)).sum()

    before = likelihood(classes)
    for word in range(2, words):
        stats = np.zeros((1, 2 * k), np.int64)
        np.add.at(stats[0], classes, pairs[:, word])
        np.add.at(stats[0], k + classes, pairs[word])
        classes[word] = brown._exchange(stats, np.array([word]), classes, table(classes), k)[0]
    assert likelihood(classes) > before


# quality -------------------------------------------------------------------------------


def plain_kneser_ney(trusted, order, alphabet):
    """p(character | history) straight from the formulas, over number sequences."""
    begin = (kneser_ney.BEGIN,) * (order - 1)
    counts = [None] * (order + 1)
    counts[order] = Counter(
        tuple(line[i : i + order]) for t in trusted for line in [begin + tuple(t)] for i in range(len(t))
    )
    for m in range(order - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    discounts = [None] * (order + 1)
    totals = [defaultdict(int) for _ in range(order + 1)]
    taken = [defaultdict(float) for _ in range(order + 1)]
    for m in range(1, order + 1):
        discounts[m] = kneser_ney._discounts([sum(c == i for c in counts[m].values()) for i in range(1, 5)])
        for g, c in counts[m].items():
            totals[m][g[:-1]] += c
            taken[m][g[:-1]] += discounts[m][min(c, 3) - 1]

    def p(gram):
        m = len(gram)
        if m == 0:
            return 1.0 / (alphabet + 1)
        total = totals[m].get(gram[:-1])
        if not total:
            return p(gram[1:])
        c = counts[m].get(gram, 0)
        share = (c - discounts[m][min(c, 3) - 1]) / total if c else 0.0
        return share + taken[m][gram[:-1]] / total * p(gram[1:])

    return p


def test_perplexity_by_brute_force(spark, awkward, scratch):
    model = kneser_ney.Quality(order=3, alphabet=50, others=50, block_bytes=3000)
    good = [t for _, t in awkward.select("doc_id", "text").collect()[5:9] if t] * 3
    trusted = spark.createDataFrame([(t,) for t in good], "text string")
    rows = kneser_ney.log_perplexity(awkward, trusted, scratch, model).collect()
    table = kneser_ney._alphabet(trusted, model.alphabet)
    p = plain_kneser_ney([kneser_ney._numbers(t, table).tolist() for t in good], 3, 50)
    expected = []
    for r in awkward.collect():
        line = [kneser_ney.BEGIN] * 2 + kneser_ney._numbers(r["text"] or "", table).tolist()
        logs = [math.log(p(tuple(line[i : i + 3]))) for i in range(len(line) - 2)]
        expected.append((r["doc_id"], len(logs), round(-sum(logs) / len(logs), 4) if logs else None))
    got = [(r["doc_id"], r["n_chars"], r["log_perplexity"] and round(r["log_perplexity"], 4)) for r in rows]
    for a, b in zip(sorted(got, key=str), sorted(expected, key=str), strict=True):
        assert a[:2] == b[:2] and a[2] == (b[2] if b[2] is None else pytest.approx(b[2], abs=2e-3))


def test_texts_move_in_compressed_parcels(spark, awkward, monkeypatch):
    monkeypatch.setattr(kneser_ney, "PARCELLED", 2000)
    many = awkward.select("doc_id", "lang", "text").union(
        spark.range(100, 600).selectExpr("id", "'en'", "concat('a text of common words and number ', id, repeat(' it goes on', 20))")
    )
    moved = kneser_ney.parcels(many.coalesce(2), 3)
    rows = moved.collect()
    assert {r["block"] for r in rows} == {0, 1, 2} and len(rows) > 3
    got = [tuple(r.values()) for p in rows for r in kneser_ney.opened(pa.scalar(bytes(p["parcel"]), pa.binary())).to_pylist()]
    assert sorted(got, key=str) == sorted((tuple(r) for r in many.collect()), key=str)
    assert sum(len(p["parcel"]) for p in rows) < 0.5 * sum(len((r["text"] or "").encode()) for r in many.collect())
    assert kneser_ney.parcels(many.limit(0), 3).count() == 0


def test_junk_goes_and_clean_text_stays(spark, scratch):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = kneser_ney.judged(spark.read.parquet(f"{folder}/documents.parquet"), labels, scratch)
    shares = {r["quality"]: r["kept"] for r in rows.join(labels, "doc_id").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert shares[1] > 0.98 and shares[0] < 0.4


def test_named_quantiles_of_documents_outside_the_sample_are_the_bands(spark, scratch):
    folder, model = "/root/testdata/sf0.1", kneser_ney.Quality()
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    trained = {r["doc_id"]: r["trained"] for r in kneser_ney.trusted_ids(labels, model).collect()}
    assert 0.2 < np.mean([not t for t in trained.values()]) < 0.3
    rows = kneser_ney.judged(spark.read.parquet(f"{folder}/documents.parquet"), labels, scratch).collect()
    own = [r for r in rows if r["lang"] == "en" and trained.get(r["doc_id"]) is False and r["n_chars"]]
    below, above = (np.mean([f(r) for r in own]) for f in (
        lambda r: r["log_perplexity"] < r["low"], lambda r: r["log_perplexity"] > r["high"]))
    assert 0.005 <= below <= model.low and 0.005 <= above <= 1 - model.high
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    kept = {q: [r["kept"] for r in rows if quality.get(r["doc_id"]) == q] for q in (0, 1)}
    assert np.mean(kept[0]) < 0.09 and np.mean(kept[1]) > 0.97


def test_all_trusted_documents_train_or_are_held_out(spark):
    labels = spark.range(30_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    rows = kneser_ney.trusted_ids(labels.union(labels), kneser_ney.Quality())
    trained, held_out = (rows.filter(F.col("trained") == t).count() for t in (True, False))
    assert trained + held_out == 30_000
    assert held_out == pytest.approx(7500, rel=0.05)  # 25,000 before: 5000 trained


def test_n_grams_of_every_text_are_counted_in_parts(spark, scratch, monkeypatch):
    monkeypatch.setattr(kneser_ney, "HELD", 10)
    texts = [f"text {i} of {i % 7}" for i in range(50)] * 3
    trusted = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2)
    table = kneser_ney._alphabet(trusted, 100)
    kneser_ney._train(trusted, table, kneser_ney.Quality(order=2), scratch)
    counted = spark.read.parquet(scratch.path("counts-2"))
    lines = [[kneser_ney.BEGIN, *kneser_ney._numbers(t, table).tolist()] for t in texts]
    want = Counter((a << kneser_ney.BITS) | b for line in lines for a, b in zip(line, line[1:], strict=False))
    assert {r["key"]: r["n"] for r in counted.collect()} == want


def test_quality_of_awkward_texts(spark, awkward, nothing, scratch):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4, 9)], "doc_id long, quality int, toxic int")
    kept = kneser_ney.kept_documents(awkward, labels, scratch)
    assert kept.columns == awkward.columns
    empty = [r["text"] for r in kept.collect() if not r["text"]]
    assert len(empty) == 3  # no text, no verdict
    assert kneser_ney.kept_documents(awkward, labels.limit(0), scratch).count() == awkward.count()
    assert kneser_ney.kept_documents(nothing, labels, scratch).count() == 0


# fingerprints --------------------------------------------------------------------------


def test_edited_texts_and_likeness_by_brute_force(small, small_rows, scratch):
    rows = {r["doc_id"]: r for r in spotsigs.edited_pairs(small, scratch).collect()}
    ids = sorted(small_rows, reverse=True)
    prints = {d: set(rows[d]["fingerprint"].split()) for d in ids}
    for place, d in enumerate(ids):
        after = ids[(place + 1) % len(ids)]
        text, half = small_rows[d], len(small_rows[d]) // 2
        edited = text[: len(text) - half] + small_rows[after][:half]
        r = rows[d]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, changed = prints[d], set(r["edited_fingerprint"].split())
        for value, other in ((r["near_edited"], changed), (r["near_next"], prints[after])):
            want = len(own & other) / len(own | other) if own | other else 1.0
            assert value == pytest.approx(want)
    by_text = defaultdict(set)
    for d in ids:
        by_text[small_rows[d]].add(rows[d]["fingerprint"])
    assert all(len(p) == 1 for p in by_text.values())


def test_signatures_are_chains_after_anchors(spark):
    df = spark.createDataFrame([("The cat of the dark house is old.",)], "t string")
    spots = ["the cat dark", "of dark house", "the dark house"]
    want = df.select(F.array_sort(F.array(*(F.hash(F.lit(s)) for s in spots))).alias("s")).first()["s"]
    assert df.select(spotsigs.signatures(F.col("t")).alias("s")).first()["s"] == want


def plain_signatures(text):
    """Anchor by anchor."""
    words = regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).split()
    content = [(i, w) for i, w in enumerate(words) if w not in set(spotsigs.ANCHORS)]
    spots = set()
    for i, word in enumerate(words):
        after = [w for j, w in content if j > i][:2]
        if word in set(spotsigs.ANCHORS) and len(after) == 2:
            spots.add(" ".join([word, *after]))
    return spots or set(words)


def test_signatures_by_brute_force(spark, small_rows):
    texts = [
        *list(small_rows.values())[:60], "", "the", "the of", "the of cat", "the cat", "the cat dog", "cat dog",
        "the the cat the of the dog the", "of The CAT, the dog.", "theory of thematic", "a.b.c of 7 8 9",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    hashed = df.sparkSession.createDataFrame(
        [(i, s) for i, t in enumerate(texts) for s in plain_signatures(t)], "i int, s string"
    ).groupBy("i").agg(F.array_sort(F.collect_set(F.hash("s"))).alias("want"))
    got = df.select("i", spotsigs.signatures(F.col("t")).alias("got")).join(hashed, "i", "left").collect()
    assert len(got) == len(texts) and all(r["got"] == (r["want"] or []) for r in got)


def test_runs_of_anchors_take_linear_time(spark):
    long = spark.createDataFrame([("the " * 100_000 + "cat dog",), ("the " * 100_000,), ("the cat " * 50_000,)], "t string")
    began = time.time()
    sizes = [r["n"] for r in long.select(F.size(spotsigs.signatures(F.col("t"))).alias("n")).collect()]
    assert sizes == [1, 1, 1] and time.time() - began < 20


def test_rows_without_an_id_are_spread_over_ranges(spark, scratch):
    rows = [(None, f"the text of number {i} is here") for i in range(200)] + [(i, f"the word {i} of it") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spotsigs.edited_pairs(df, scratch).collect()
    assert len(got) == 220
    # one ring: every text is once the next
    nexts = df.withColumn("tie", F.xxhash64("text")).orderBy(F.desc_nulls_last("doc_id"), F.desc("tie")).collect()
    for one, after in zip(nexts, [*nexts[1:], nexts[0]], strict=True):
        half = len(one["text"]) // 2
        edited = one["text"][: len(one["text"]) - half] + after["text"][:half]
        assert hashlib.sha256(edited.encode()).hexdigest() in {r["edited_sha256"] for r in got if r["doc_id"] == one["doc_id"]}


def test_fingerprints_of_awkward_texts(awkward, nothing, scratch, spark):
    assert spotsigs.edited_pairs(awkward, scratch).count() == awkward.count()
    assert spotsigs.edited_pairs(nothing, scratch).collect() == []
    alone = spotsigs.edited_pairs(awkward.filter("doc_id = 4"), scratch).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"One twoOne tw").hexdigest()


def test_similar_sets_by_brute_force(spark):
    random = np.random.default_rng(5)
    base = random.integers(0, 500, (12, 30))
    sets = []
    for i in range(60):
        own = set(base[i % 12].tolist())
        own = set(list(own)[: 30 - i % 5]) | set(random.integers(1000, 2000, i % 4).tolist())
        sets.append((i, sorted(int(x) for x in own)))
    sets.append((60, []))
    got = spotsigs.similar(spark.createDataFrame(sets, "id long, sigs array<int>"), 0.8, tile=3).collect()
    one = {}
    for i, s in sets:
        one.setdefault(tuple(s), i)
    chosen = [(i, set(s)) for s, i in one.items() if s]
    want = {
        (min(i, j), max(i, j))
        for i, a in chosen for j, b in chosen
        if i < j and len(a & b) / len(a | b) >= 0.8
    }
    assert {(r["a"], r["b"]) for r in got} == want and want


# near duplicates -----------------------------------------------------------------------


def plain_components(documents, words):
    sets = {}
    for d, text in documents:
        t = (text or "").encode().lower().split()
        size = min(words, len(t))
        sets[d] = {tuple(t[i : i + size]) for i in range(len(t) - size + 1)} if t else set()
    ids, parent = sorted(sets), {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


@pytest.mark.parametrize("tile", [7, 1000])
def test_components_by_brute_force(spark, small, small_rows, scratch, tile):
    edited = []
    base = [f"word{i}" for i in range(60)]
    for i in range(40):  # a chain: neighbours are alike, the ends are not
        edited.append((10_000 + i, " ".join(base[i // 2 : i // 2 + 40] + [f"end{i}"])))
    documents = list(small_rows.items()) + edited
    df = spark.createDataFrame(documents, "doc_id long, text string")
    near = hamming_join.Near(words=4, tile=tile)
    got = {r[0]: tuple(r)[1:] for r in hamming_join.near_duplicates(df, scratch, near).collect()}
    assert got == plain_components(documents, 4)


def test_a_group_of_many_copies_is_linear(spark, scratch, monkeypatch):
    """Members that are linked with their pivot are not compared with each other."""
    base = [f"word{i}" for i in range(100)]
    documents = [(i, " ".join([*base[: i % 100], f"edit{i}", *base[i % 100 + 1 :]])) for i in range(400)]
    seen = []
    links = hamming_join._links

    def watched(tiled, sets, near):
        seen.append(tiled.count())
        return links(tiled, sets, near)

    monkeypatch.setattr(hamming_join, "_links", watched)
    df = spark.createDataFrame(documents, "doc_id long, text string")
    near = hamming_join.Near(words=4, tile=20)
    got = {r["doc_id"]: r["component_id"] for r in hamming_join.near_duplicates(df, scratch, near).collect()}
    assert got == dict.fromkeys(range(400), 0)
    star, rest = seen
    assert star <= 400 * 63 + 400 and rest <= star  # all pairs of tiles would be twenty times as many


def test_near_duplicates_of_awkward_texts(awkward, nothing, scratch):
    rows = hamming_join.near_duplicates(awkward, scratch).collect()
    assert len(rows) == awkward.count()
    own = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert own[0]["n_shingles"] == 0 and own[0]["kept"] and own[5]["component_id"] == 4
    assert own[7]["component_id"] == 6 and not own[7]["kept"]
    assert hamming_join.one_of_each(awkward, scratch).columns == awkward.columns
    assert hamming_join.near_duplicates(nothing, scratch).collect() == []


def test_one_row_stays_of_repeated_rows_and_of_rows_without_an_id(spark, scratch):
    a, b, c, d = (" ".join(f"{letter}{i}" for i in range(30)) for letter in "abcd")
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (3, c), (4, d), (4, c), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, hamming_join.one_of_each(df, scratch).collect()), key=str)
    assert kept == sorted([(1, a), (None, b), (3, c), (4, d), (None, None), (None, "")], key=str)


def test_the_pigeonhole_holds():
    near = hamming_join.Near()
    choices = hamming_join._choices(near)
    random = np.random.default_rng(2)
    for _ in range(300):
        a = random.integers(0, 1 << 16, near.symbols)
        b = a.copy()
        wrong = random.choice(near.symbols, near.distance, replace=False)
        b[wrong] += 1
        assert any((a[places] == b[places]).all() for _, places in choices)
    assert near.missed() < 1e-4


def test_components_of_a_long_chain_and_a_star(spark, scratch):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = components(spark.createDataFrame(links, "a long, b long"), scratch)
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert {r["node"]: r["component"] for r in got.collect()} == want


# neighbours ----------------------------------------------------------------------------


def test_neighbours_are_exact_scores_with_high_recall(spark, scratch):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = pstable.nearest(table, scratch, F.col("vec_id") % 5 == 0).collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    ids = sorted(vectors)
    unit = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        a, b = vectors[r["query_id"]], vectors[r["vec_id"]]
        assert r["score"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
        found[r["query_id"]].append(r["vec_id"])
    hits = total = 0
    for q in [i for i in ids if i % 5 == 0]:
        cosine = unit @ unit[ids.index(q)]
        cosine[ids.index(q)] = -2
        hits += len(set(np.array(ids)[np.argsort(-cosine)[:5]].tolist()) & set(found[q]))
        total += 5
    assert hits / total >= 0.9


def test_neighbours_with_ties_and_unusable_vectors(spark, scratch):
    nan, big = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [0.6, 0.8])]
    rows += [(i, [1.0, 0.0]) for i in range(200, 240)]
    rows += [(100, None), (150, [0.0, 0.0]), (11, [nan, 1.0]), (12, [big, 1.0]), (13, [None, 1.0]), (14, [])]
    rows += [(None, [1.0, 0.0]), (250, [1.0, 2.0, 3.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    tiny = pstable.Index(tile=2, probes=200)
    got = pstable.nearest(df, scratch, F.col("vec_id") % 50 == 0, index=tiny).collect()
    lists = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        lists[r["query_id"]].append((r["vec_id"], r["score"]))
    assert [v for v, _ in lists[0]] == [2, 3, 50, 200, 201] and [v for v, _ in lists[50]] == [0, 2, 3, 200, 201]
    assert all(s == 1.0 for _, s in lists[0]) and set(lists) == {0, 50, 200}
    assert pstable.nearest(df.limit(0), scratch, F.col("vec_id") % 50 == 0).collect() == []


def test_neighbours_that_tie_at_several_lengths_go_by_id(spark, scratch):
    random = np.random.default_rng(9)
    vectors = random.standard_normal((1000, 16))
    same = random.permutation(np.arange(1, 1000))[:40]
    vectors[same] = vectors[0] * 2.0 ** np.arange(-20, 20)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = pstable.Index(tables=1, hashes=1, cell=1000.0, probes=1)  # a single cell
    found = pstable.nearest(df, scratch, F.col("vec_id") == 0, index=one).collect()
    got = sorted(found, key=lambda r: r["rank"])
    assert [r["vec_id"] for r in got] == sorted(same.tolist())[:5]
    assert len({r["score"] for r in got}) == 1


@pytest.mark.parametrize("number", range(2, 11))
def test_few_vectors_are_all_found(spark, scratch, number):
    """Sparse cells hold fewer than k: the rest is searched too."""
    random = np.random.default_rng(number)
    size = 2 if number % 2 else 8
    vectors = random.standard_normal((number, size))
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vector string, rank int")
    got = pstable.nearest(df, scratch, F.col("vec_id") % 2 == 0, index=pstable.Index(tables=2, probes=3, tile=3))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    expected = []
    for q in range(0, number, 2):
        order = [int(i) for i in np.argsort(-(unit @ unit[q]), kind="stable") if i != q]
        expected += [(q, rank, i) for rank, i in enumerate(order[:5], 1)]
    assert sorted(tuple(r)[:3] for r in got.collect()) == expected


def test_one_id_with_different_vectors(spark, scratch):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [-1.0, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = pstable.nearest(df, scratch, F.col("vec_id") == 0, k=2).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 1), (2, 2)]


def test_perturbations_come_in_order_of_cost():
    position = np.array([0.1, 0.55, 0.8])
    steps = pstable.perturbations(position, 27)
    assert len({tuple(s) for s in steps.tolist()}) == len(steps) == 27

    def cost(step):
        return sum((p**2 if s < 0 else (1 - p) ** 2) if s else 0 for p, s in zip(position, step, strict=True))

    costs = [cost(s) for s in steps.tolist()]
    assert costs == sorted(costs)


# archives ------------------------------------------------------------------------------


def test_pages_come_back(spark, scratch):
    long, short = "<p>x</p>" * 200, "tiny"
    rows = [(1, "http://a/1", long), (2, None, long), (5, "http://a\r\nb", long), (3, "u", short), (4, "u", short)]
    rows += [(6, "u", None), (None, "u", "é" * 600), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, warc.round_trip(pages, scratch).collect()), key=str)
    want = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        revisit = html == long and page_id != 5
        want.append(
            (page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None)
        )
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0), warc.Scratch(spark, "none")).collect() == []


def test_unwanted_payloads_are_stepped_over():
    rows = [
        {"record_type": t, "record_id": f"urn:page:{i}", "date": "d", "target_uri": "u", "refers_to": "urn:page:0",
         "payload_digest": "00" * 20, "payload_bytes": 9, "payload": b"x" * 9}
        for i, t in enumerate(["response", "revisit", "response"])
    ]
    raw = b"".join(map(warc.record, rows))

    class Counting(io.BytesIO):
        blocks = 0

        def read(self, size=-1):
            Counting.blocks += 1
            return super().read(size)

    got = list(warc.records(Counting(raw), ["record_id", "payload_bytes"], {"record_type": {"revisit"}}))
    assert got == [("urn:page:1", 9)] and Counting.blocks == 0
    everything = list(warc.records(gzip.open(io.BytesIO(gzip.compress(raw))), ["payload"], {}))
    assert everything == [(b"x" * 9,), (None,), (b"x" * 9,)]


def test_filters_reach_the_reader_and_files_are_planned(spark, scratch):
    pages = spark.createDataFrame([(i, "u", f"{i}" * 3000) for i in range(40)], "page_id long, url string, html string")
    warc.register(spark)
    warc.archive(pages.coalesce(1), scratch.path("a"))
    read = spark.read.format("warc").option("path", scratch.path("a")).schema("record_type string, record_id string")
    plan = read.load().filter("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "record_type" in plan and "Filter (" not in plan.replace("Filter (isnotnull", "")
    reader = warc.WarcReader({"path": scratch.path("a"), "split_bytes": "1"}, ["record_id"])
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) == 40


def test_packed_archives_are_small_and_entered_at_their_marks(spark, scratch):
    rows = [(i, "u", f"<p>{i} some words of a page</p>\n" * 100) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.register(spark)
    got = warc.round_trip(pages, scratch)
    assert sorted((r["page_id"], r["payload_digest"]) for r in got.collect()) == [
        (i, hashlib.sha1(html.encode()).hexdigest()) for i, _, html in rows]
    folder = scratch.path("archives").removeprefix("file:").replace("///", "/")
    sizes = [f.stat().st_size for f in Path(folder).glob("*.warc*")]
    assert 0 < sum(sizes) < sum(len(html) for _, _, html in rows) / 3  # above their length before
    made = spark.createDataFrame(
        [("response", f"urn:page:{i}", "d", "u", None, "00" * 20, len(h), h.encode()) for i, _, h in rows],
        "record_type string, record_id string, date string, target_uri string, refers_to string, "
        "payload_digest string, payload_bytes long, payload binary",
    ).coalesce(1)
    path = scratch.fresh("marked")
    made.write.format("warc").mode("append").option("path", path).options(compression="gzip", mark_bytes=500).save()
    reader = warc.WarcReader({"path": path, "split_bytes": "1"}, ["record_id", "payload"])
    parts = [[tuple(r) for r in reader.read(p)] for p in reader.partitions()]
    assert len(parts) > 10
    assert sorted(r for part in parts for r in part) == sorted((f"urn:page:{i}", h.encode()) for i, _, h in rows)


# the pipeline --------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [documents]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(stage(spark, tables[-1], folder).cache())
        assert tables[-1].columns == documents.columns
    ids = [{r["doc_id"] for r in t.select("doc_id").collect()} for t in tables]
    assert ids[0] >= ids[1] == ids[2] >= ids[3]
    near = plain_components([(r["doc_id"], r["text"]) for r in tables[2].collect()], 5)
    assert ids[3] == {d for d, (_, _, kept) in near.items() if kept}
    packed = corpus_pipeline.STAGES[-1][1](spark, tables[3], folder).collect()
    assert {r["doc_id"] for r in packed} == ids[3]
    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(r["ids_crc32"] for r in whole.collect()) == sorted(r["ids_crc32"] for r in packed)
    assert packing.pieces_of(1024, 1024) == [(0, 1024)] and packing.pieces_of(1025, 1024) == [(0, 1), (1, 1024)]
