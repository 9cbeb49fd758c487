"""Near-duplicates of the pipeline: which pairs are found, and which rows stay."""

import random

import pytest

from loomspark.llm import simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def edited_pairs(kind, n, size, seed=5):
    """Pairs of texts alike by 0.8 to 0.81: single words changed here and there, or one passage replaced."""
    pick = random.Random(seed)
    out = []
    while len(out) < n:
        words = ["w%d" % pick.randrange(50000) for _ in range(size)]
        copy = list(words)
        if kind == "scattered":
            for at in pick.sample(range(size), size // 45):
                copy[at] = "new%d" % pick.randrange(50000)
        else:
            m = size // 9 - 5
            at = pick.randrange(size - m)
            copy[at : at + m] = ["new%d" % pick.randrange(50000) for _ in range(m)]
        pair = " ".join(words), " ".join(copy)
        if 0.8 <= alike(*pair) <= 0.81:
            out.append(pair)
    return out


def meet(x, y):
    """In some table the anchors are equal and the segments differ in one bit at most, and the sketches in no more than the bound."""
    near = any(a == b and (i ^ j).bit_count() <= 1 for a, b, i, j in zip(x[2], y[2], simhash.segments(x[1]), simhash.segments(y[1]), strict=False))
    marks = sum(int(a) % (256 if i < simhash.TABLES else 16) != int(b) % (256 if i < simhash.TABLES else 16) for i, (a, b) in enumerate(zip(x[2], y[2], strict=True)))
    return near and sum((i ^ j).bit_count() for i, j in zip(x[1], y[1], strict=True)) + 2 * marks <= simhash.FAR


@pytest.mark.parametrize("kind", ["scattered", "passage"])
def test_keys_find_pairs_at_the_threshold(kind):
    """The keys are the same at any size of the input, so the share of pairs that meet is too."""
    pairs = edited_pairs(kind, 300, 450)
    met = sum(meet(simhash.sketch(a), simhash.sketch(b)) for a, b in pairs)
    assert met >= 0.96 * len(pairs)


def groups_of(texts, least=0.8):
    """The smallest id that each id reaches over pairs alike by ``least``, all pairs being compared."""
    root = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and root[a] != root[b] and shingles(texts[a]) | shingles(texts[b]) and alike(texts[a], texts[b]) >= least:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_links_are_decided_at_the_threshold(spark):
    """Texts alike by 0.55 to 0.79 all stay, those from 0.83 up leave one."""
    pick = random.Random(6)
    texts, k = {}, 0
    for changed in (12, 16, 24, 33, 55, 62, 70, 80, 95):
        for _ in range(4):
            words = ["w%d" % pick.randrange(50000) for _ in range(404)]
            texts[k], texts[k + 1] = " ".join(words), " ".join(["n%d" % pick.randrange(50000) for _ in range(changed)] + words[changed:])
            k += 2
    want = groups_of(texts)
    assert 0 < sum(i != r for i, r in want.items()) < k // 2
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()} == want


def test_groups_of_documents(spark, sf_dir):
    """On the documents every pair at 0.8 or more is one group, and no pair below it links any."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()} == groups_of(texts)


def test_null_and_equal_ids_keep_their_texts(spark):
    pick = random.Random(7)
    a, b, c, d, e = (" ".join("w%d" % pick.randrange(50000) for _ in range(100)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b + " more"), (1, c), (1, d), (2, d + " more"), (None, e), (3, e + " more"), (4, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in simhash.keep_one(df).collect()]
    assert len(got) == len(set(got)) == 6
    assert {(None, a), (1, c), (1, d), (3, e + " more"), (4, None)} < set(got)
    assert len(set(got) & {(None, b), (None, b + " more")}) == 1
