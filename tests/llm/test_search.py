"""Near duplicates, exact search and the pipeline against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from floorline.llm import near_dup, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = last + 1 if x == y else max(row[j + 1], row[j])
            last = keep
    return row[-1]


def coded(text, seen):
    codes = near_dup.word_codes(text, seen)
    return codes, near_dup.labelled_shingles(codes)


def test_alignment_matches_words():
    """Of edited copies the anchored alignment finds the longest common subsequence of words, or close to it, and never more."""
    rng, seen = random.Random(1), {}
    for _ in range(150):
        a = words(rng, rng.randint(1, 90)) * rng.choice([1, 1, 2])
        if rng.random() < 0.3:
            a = [rng.choice(["of", "the", "ha", w]) for w in a]
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = words(rng, rng.randint(0, 2))
        if not b:
            continue
        (x, xs), (y, ys) = coded(" ".join(a), seen), coded(" ".join(b), seen)
        want = lcs(x.tolist(), y.tolist()) / max(len(x), len(y))
        got = near_dup.alignment(x, y, xs, ys)
        assert got <= want + 1e-12
        assert got >= want - 0.02 or want < 0.82
        assert near_dup.alignment(y, x, ys, xs) == pytest.approx(got, abs=0.03) or want < 0.82


def test_common_words_is_the_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert near_dup.common_words(a, b, 40) == lcs(a, b)
        assert near_dup.common_words(a, b, 2) <= lcs(a, b)
    # six of 200 words changed: 97 % of the words match, though under three quarters of the shingles do
    a = [str(i) for i in range(200)]
    b = [w + "x" if i % 33 == 9 else w for i, w in enumerate(a)]
    (x, xs), (y, ys) = coded(" ".join(a), {}), coded(" ".join(b), {})
    assert near_dup.alignment(x, y, xs, ys) == 0.97 and len(np.intersect1d(xs, ys)) / len(np.union1d(xs, ys)) < 0.75


def test_bounds_spare_no_link():
    rng = random.Random(3)
    pool = words(rng, 60)
    texts = [np.array([rng.randrange(1 << 20) if rng.random() < 0.3 else hash(rng.choice(pool)) & 0xFFFFF for _ in range(rng.randint(1, 400))], np.uint32) for _ in range(20)]
    texts += [np.delete(t, rng.sample(range(len(t)), len(t) // 10)) for t in texts]
    n, counts = np.array([len(t) for t in texts]), np.stack([near_dup.word_counts(t) for t in texts])
    for i, j in itertools.combinations(range(len(texts)), 2):
        may = near_dup._may_link(n, counts, np.array([i]), np.array([j]))[0]
        assert may or lcs(texts[i].tolist(), texts[j].tolist()) < 0.8 * max(n[i], n[j])


def test_bounds_tell_long_texts_apart():
    """Long texts with little under 0.8 of their words in common are told apart by counts alone; before, none was."""
    rng = random.Random(12)
    texts = []
    base = [f"w{rng.randrange(3000)}" for _ in range(770)]
    for _ in range(40):
        b = list(base)
        for at in rng.sample(range(770), 105):
            b[at] = f"w{rng.randrange(3000)}"
        texts.append(coded(" ".join(b), {})[0])
    n, counts = np.array([len(t) for t in texts]), np.stack([near_dup.word_counts(t) for t in texts])
    x, y = np.triu_indices(40, 1)
    may, coarse = near_dup._may_link(n, counts, x, y), near_dup._may_link(n, near_dup._coarse(counts), x, y)
    assert may.mean() < 0.1 and (coarse | ~may).all()


def test_labels_are_unique():
    codes = near_dup.word_codes("a b c d e f " * 30, {})
    assert len(set(near_dup.labelled_shingles(codes).tolist())) == len(codes) - 4
    assert len(near_dup.labelled_shingles(near_dup.word_codes("two words", {}))) == 1
    assert len(near_dup.labelled_shingles(near_dup.word_codes("...", {}))) == 0


def family_rows(rng):
    """Unlike texts, exact copies, a star of near copies, and texts that share a long passage."""
    rows = [" ".join(words(rng, rng.randint(30, 200))) for _ in range(150)]
    base = words(rng, 400)
    star = []
    for _ in range(120):
        b = list(base)
        for at in rng.sample(range(400), 5):
            b[at] = words(rng, 1)[0]
        star.append(" ".join(b))
    passage = words(rng, 120)
    shared = [" ".join(words(rng, 120) + passage) for _ in range(60)]
    return rows + [" ".join(base)] + star + shared + [rows[3]] * 70 + ["", "", "one", "One!", "!!!", "!!!", None, None]


def truth(texts):
    seen, shingles, parent = {}, {}, list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first = {}
    for i, t in enumerate(texts):
        if t is not None:
            parent[find(i)] = find(first.setdefault(t, i))
            if first[t] == i:
                shingles[i] = coded(t, seen)
    for a, b in itertools.combinations(shingles, 2):
        (x, xs), (y, ys) = shingles[a], shingles[b]
        if len(x) and near_dup.alignment(x, y, xs, ys) >= 0.8:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(texts))]


def test_classes_equal_brute_force(spark):
    texts = family_rows(random.Random(2))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in near_dup.classes(df.withColumn("rep", F.lit("clash"))).collect()}
    want = truth(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    assert got[3].n_copies == 71 and got[len(texts) - 1].n_copies == 1


def test_large_keys_are_cut_and_joined(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "PIECE", 16)
    texts = family_rows(random.Random(3))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.classes(df).collect()}
    want = truth(texts)
    assert sum(got[i] != want[i] for i in range(len(texts))) <= 2


def test_pairs_under_keys_far_over_a_piece(spark, monkeypatch):
    """Texts mostly of one passage, half of them with a copy that shares hardly more than it: no copy is lost to another piece."""
    monkeypatch.setattr(near_dup, "PIECE", 8)
    rng = random.Random(7)
    passage, texts = words(rng, 70), []
    for i in range(180):
        own = words(rng, 30)
        texts.append(" ".join(passage + own))
        if i % 2 == 0:
            texts.append(" ".join(passage + own[:16] + words(rng, 14)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.classes(df).collect()}
    want = truth(texts)
    assert len(set(want)) == 180
    assert [got[i] for i in range(len(texts))] == want


def test_recall_of_near_copies(spark):
    """Nine copies in ten and more are found where one to ten words in a hundred are changed, dropped or put in."""
    rng, rows = random.Random(8), []
    for i in range(300):
        text = words(rng, rng.randint(40, 300))
        copy = list(text)
        for at in rng.sample(range(len(text)), max(1, len(text) * (i % 10 + 1) // 100)):
            copy[at] = rng.choice(["", words(rng, 1)[0], copy[at] + " " + words(rng, 1)[0]])
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[2 * i + 1] == 2 * i for i in range(300))
    assert found >= 0.97 * 300 and all(got[2 * i] == 2 * i for i in range(300))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 103), (102, 103)]
    got = {r.text: r.class_id for r in near_dup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102, 103, 200)}


def test_components_join_few_links_again(spark, monkeypatch):
    """A link within what is joined already is not read in later rounds."""
    rows, real = {}, near_dup.common.stored

    def told(df, name):
        out = real(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(near_dup.common, "stored", told)
    rng = random.Random(13)
    stars = [(i % 3, i) for i in range(3, 300)] + [(400, 401), (9, 400)]
    loose = [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(100)]
    found = {}
    for links in (loose, stars):
        rows.clear()
        found |= {r.text: r.class_id for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {t: t for link in loose + stars for t in link if link[0] != link[1]}
    for _ in want:
        for a, b in loose + stars:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert found == want
    assert sum(n for name, n in rows.items() if name.startswith("edges")) < 1.1 * len(stars)


def test_one_id_with_several_texts(spark):
    """Rows, not ids, are removed: one of equal rows, the copy of another row's text, and nothing else."""
    rng = random.Random(9)
    a, b, c = (" ".join(words(rng, 50)) for _ in range(3))
    rows = [(7, a), (7, b), (7, a), (8, b), (9, c), (None, a), (None, a), (10, None), (10, None), (3, c)]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, d, "").collect()), key=str)
    assert kept == sorted([(7, a), (7, b), (3, c), (None, a), (None, a), (10, None), (10, None)], key=str)


def test_near_dup_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.classes(none).collect() == []
    one = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.class_id) for r in near_dup.classes(one).collect()) == [(-1, None), (7, 7), (7, 7)]


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_top(rows, k=5):
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64))) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % 50 == 0:
            found = sorted((-int(q @ x), j) for j, x in good if j != i and len(x) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 64).tolist()) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 560)]  # ties
    rows += [(600, None), (650, [float("nan")] * 64), (700, [float("inf")] + [0.0] * 63), (750, [None] * 64), (800, [0.5] * 3), (801, [0.25] * 3), (850, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    for hold in (1 << 19, 64 * 3):
        got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, queries_hold=hold, candidates_hold=2 * hold).collect())
        assert got == brute_top(rows)
    again = df.unionByName(df.where("vec_id in (50, 51)")).unionByName(spark.createDataFrame([(None, [1.0] * 64, 1)], VECTORS))
    assert topk.top_k(again, F.col("vec_id") == 50).select("vec_id").first()[0] is not None
    assert topk.top_k(df, F.col("vec_id") < 0).collect() == []
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_segment_bound_holds():
    rng = np.random.default_rng(4)
    for n in (1, 3, 17, 64):
        x, y = rng.normal(size=(30, n)), rng.normal(size=(40, n))
        last = np.full((30, 40), np.inf)
        for s in (1, *topk.LEVELS, 64):
            bound = topk.statistics(x, s) @ topk.statistics(y, s).T
            assert (bound + 1e-9 >= x @ y.T).all()
            last = np.minimum(last, bound)


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(5)
    clean = lambda: "\n".join(" ".join(words(rng, 12)).capitalize() + "." for _ in range(6))
    rows, labels = [], []
    for i in range(300):
        text = clean()
        if i % 6 == 0:
            text += " zidiotic zmoronic"
        elif i % 6 == 1:
            text = "\n".join(" ".join(w + "###" for w in line.split()) for line in text.split("\n"))
        rows.append((i, text))
        labels.append((i, int(i % 6 != 1), int(i % 6 == 0)))
    copies = [(1000 + k, rows[2][1]) for k in range(5)]
    secret = clean() + " password=b7db7aa4a5fcc78305 end"
    docs = rows + copies + [(2000, secret), (2001, None), (2002, ""), (None, clean())]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], DOCS)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        if k < 4:
            assert out.columns == d.columns and [t for _, t in out.dtypes] == [t for _, t in d.dtypes]
        out.write.parquet(f"{tmp_path}/stage{k}")
        kept = spark.read.parquet(f"{tmp_path}/stage{k}")
    after = [{r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/stage{k}").collect()} for k in range(4)]
    ids = {i for i, _ in docs}
    assert ids - set(after[0]) == {i for i in range(0, 300, 6)}
    assert set(after[0]) - set(after[1]) == {i for i in range(1, 300, 6)}
    assert set(after[1]) - set(after[2]) == {i for i, _ in copies}
    assert set(after[2]) == set(after[3]) and after[3][2000].text == secret.replace("password=b7db7aa4a5fcc78305", "<SECRET>")
    assert after[3][2000].n_chars == len(after[3][2000].text) and after[3][2001].text is None
    packed = kept.collect()
    assert {r.doc_id for r in packed} == set(after[3])
    assert len({r.sequence_id for r in packed}) * 4096 >= sum(r.length for r in packed)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(after[3])


def test_queries_have_what_contracts_ask():
    from floorline.llm import queries

    names = list(queries.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)
