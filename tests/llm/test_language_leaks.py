"""Language identification and benchmark decontamination."""

import random

import numpy as np
import pytest

from quillgraph.llm import decontaminate as D
from quillgraph.llm import langid as L

SYLLABLES = {"aa": ["ka", "ro", "mi", "tel"], "bb": ["schö", "ung", "ber", "ich"], "cc": ["eau", "oi", "ré", "tion"]}


def text(lang, r, n=40):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(3)
    rows = [(i, text(lang := r.choice(list(SYLLABLES)), r, r.choice([3, 20, 60])), lang) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()


def test_held_out_accuracy(spark, labelled):
    model = L.fit_language_model(labelled)
    rows = L.identify(labelled, model).join(labelled.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 300 and 60 < len(held) < 140
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert L.keep_identified(labelled, model).columns == labelled.columns
    assert L.keep_identified(labelled, model).count() > 285


def test_held_out_rows_teach_nothing(spark, labelled):
    """Labels of held-out rows can be anything without a change of any prediction."""
    wrong = labelled.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 3 = 1 then 'zz' else lang end as lang")
    a, b = (sorted(map(tuple, L.identify(labelled, L.fit_language_model(x)).collect())) for x in (labelled, wrong))
    assert a == b and "zz" not in {r[2] for r in b}


def test_undetermined(spark, labelled):
    model = L.fit_language_model(labelled)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "123 !?", 1), (4, "schöung", 1), (None, "eauoi", 1), (4, "schöung", 1), (5, "eau " * 50_000, 1)], "doc_id long, text string, score int")
    got = L.identify(odd, model).collect()
    assert len(got) == 7
    assert {(r.doc_id, r.lang_pred) for r in got} >= {(1, "und"), (2, "und"), (3, "und"), (4, "bb"), (None, "cc"), (5, "cc")}
    assert all((r.score == 0 and not r.accepted) == (r.lang_pred == "und") for r in got)
    empty = labelled.limit(0)
    assert L.fit_language_model(empty) is None
    assert {r.lang_pred for r in L.identify(odd, None).collect()} == {"und"}
    assert L.identify(empty, model).count() == 0


def test_foreign_texts_are_rejected(spark, labelled):
    """Texts of scripts and of letters that no language was learned from score low; known ones are kept."""
    model = L.fit_language_model(labelled)
    r = random.Random(9)
    foreign = ["".join(chr(r.randint(0x430, 0x44F)) if r.random() < 0.8 else " " for _ in range(200)) for _ in range(40)]
    foreign += ["".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(80)) for _ in range(40)]
    foreign += ["".join(chr(r.randint(0x3B1, 0x3C9)) if r.random() < 0.8 else " " for _ in range(200)) for _ in range(40)]
    known = [text(lang, r, r.choice([3, 20, 60])) for lang in SYLLABLES for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(foreign + known)], "doc_id long, text string")
    kept = {x.doc_id for x in L.keep_identified(docs, model).collect()}
    assert len([i for i in kept if i >= len(foreign)]) >= 0.99 * len(known)
    assert len([i for i in kept if i < len(foreign)]) <= 0.1 * len(foreign)


def test_sample_does_not_grow_with_repeated_rows(spark, labelled, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_CHARS", 20)
    seen = []
    monkeypatch.setattr(L, "train", lambda texts, labels: seen.append(list(zip(texts, labels, strict=True))))
    L.fit_language_model(labelled)
    L.fit_language_model(labelled.unionByName(labelled))
    assert seen[0] == seen[1] and max(len(t) for t, _ in seen[0]) <= 20 and len(seen[0]) > 150


# -- leaks ---------------------------------------------------------------------------------------


def plain_similarity(words, item, n_items, df):
    """Best weighted Jaccard of any window of the item's length."""
    from collections import Counter

    m = len(item)
    k = min(5, m)
    shingle = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    b, best = shingle(item), 0.0
    weight = lambda s: 1 + np.log(n_items / df[s]) if s in df else 1 + np.log(n_items)
    for s in range(len(words) - m + 1):
        a = shingle(words[s : s + m])
        if a.keys() & b.keys():
            best = max(best, sum(weight(x) * min(a[x], b[x]) for x in a.keys() | b.keys()) / sum(weight(x) * max(a[x], b[x]) for x in a.keys() | b.keys()))
    return best


def test_leaks_are_those_of_all_windows(spark):
    r = random.Random(11)
    vocabulary = [f"v{i}" for i in range(300)]
    items = {i: [r.choice(vocabulary) for _ in range(r.choice([3, 7, 15, 30, 31]))] for i in range(12)}
    items[12] = items[4][:]  # a repeated item
    docs = []
    for d in range(120):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        if r.random() < 0.6:
            leak = items[r.randrange(13)][:]
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                leak[r.randrange(len(leak))] = "zz"
            at = r.randint(0, len(words))
            words[at:at] = leak
        docs.append((d, " ".join(w.upper() + "," if r.random() < 0.1 else w for w in words)))
    from collections import Counter

    df = Counter()
    for w in items.values():
        k = min(5, len(w))
        df.update({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    want = {}
    for d, t in docs:
        words = t.lower().replace(",", " ").split()
        for i, w in items.items():
            if (s := plain_similarity(words, w, len(items), df)) >= 0.75 - 1e-12:
                want[(d, i)] = s
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(50, None), (51, ""), (None, "a b c d e f g")], "item_id long, text string")
    table = spark.createDataFrame([(d, t, 1) for d, t in docs] + [(500, None, 1), (501, "", 1)], "doc_id long, text string, item_id int")
    got = {(x.doc_id, x.item_id): x.similarity for x in D.find_leaks(table, bench).collect()}
    assert got.keys() == want.keys() and len(want) > 30
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = {x.doc_id for x in D.drop_leaks(table, bench).collect()}
    assert kept == {d for d, *_ in [*docs, (500,), (501,)]} - {d for d, _ in want}
    assert D.find_leaks(table, bench.limit(0)).count() == D.find_leaks(table.limit(0), bench).count() == 0


def test_items_in_blocks_give_the_same(spark):
    items = [(i, " ".join(f"x{i}y{k}" for k in range(9))) for i in range(8)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    seen = sorted(i for index in D.item_indexes(bench, 3) for i in index.ids)
    assert seen == list(range(8))


def test_document_shorter_than_its_item(spark):
    words = [f"w{i}" for i in range(20)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "p q r")], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words[:18])), (2, " ".join(words[1:])), (3, " ".join(words[:15])), (4, "p q"), (5, " ".join(words[:3]))], "doc_id long, text string")
    got = {x.doc_id: (x.item_id, round(x.similarity, 9), x.start_word, x.n_words) for x in D.find_leaks(docs, bench).collect()}
    assert got == {1: (1, 14 / 16, 0, 18), 2: (1, 15 / 16, 0, 19)}
    assert {x.doc_id for x in D.drop_leaks(docs, bench).collect()} == {3, 4, 5}


def test_weights_are_the_same_in_blocks(spark):
    items = [(i, " ".join([f"x{i}y{k}" for k in range(9)] + [f"c{k}" for k in range(6)])) for i in range(12)]
    bench = spark.createDataFrame([*items, (90, ""), (91, None)], "item_id long, text string")
    (whole,) = D.item_indexes(bench)
    blocks = list(D.item_indexes(bench, 4))
    assert len(blocks) > 1
    for block in blocks:
        assert block.unknown == whole.unknown
        assert np.array_equal(block.weights(whole.keys[np.isin(whole.keys, block.keys)]), whole.weights(whole.keys[np.isin(whole.keys, block.keys)]))


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 256, (300, D.BITS // 8)).astype(np.uint8)
    index = D.MultiIndex(list(range(300)), prints)
    near = prints.copy()
    for row in near:
        flip = np.zeros(D.BITS, np.uint8)
        flip[rng.choice(D.BITS, D.RADIUS, replace=False)] = 1
        row ^= np.packbits(flip)
    assert set(range(300)) <= {int(a) for a, b in zip(*index.candidates(near), strict=True) if a == b}
    # Of random fingerprints the index gives few, and just those with a block that near.
    other = rng.integers(0, 256, (200, D.BITS // 8)).astype(np.uint8)
    got = set(zip(*(x.tolist() for x in index.candidates(other)), strict=True))
    blocks = lambda p: p.view(np.uint16).reshape(len(p), D.BLOCKS)
    apart = np.bitwise_count(blocks(other)[:, None, :] ^ blocks(prints)[None, :, :])
    assert got == set(zip(*(x.tolist() for x in np.nonzero((apart <= D.NEAR).any(2))), strict=True))
    assert len(got) < 0.05 * 200 * 300


def test_recall_of_the_index_at_the_threshold():
    """Of pairs just at the similarity asked for, the index gives nearly all (99.9 % here)."""
    rng = np.random.default_rng(1)
    met, n = 0, 3000
    for _ in range(n):
        pool = rng.integers(0, 1 << 62, 64).astype(np.uint64)
        a, b = pool[:56], np.concatenate([pool[:48], pool[56:]])  # 48 shared of 64
        prints = [np.packbits(D._signs(x).sum(0) > 0)[None, :] for x in (a, b)]
        met += len(D.MultiIndex([0], prints[0]).candidates(prints[1])[0])
    assert met / n > 0.995


def test_long_text_with_far_hits_needs_little_memory():
    import tracemalloc

    items = [" ".join(f"i{k}x{j}" for j in range(50)) for k in range(30)]
    index = D.ItemIndex(list(range(30)), items)
    filler = " ".join(f"f{j % 997}" for j in range(40_000))
    text = " ".join(f"{filler} {' '.join(x.split()[:45])} t" for x in items[:5])
    raw = np.frombuffer(text.encode(), np.uint8)
    words, _ = D._words(index.hasher, raw, np.array([0, len(raw)]))
    at, w = index.hits(words, 5)
    tracemalloc.start()
    found = index.search(words, {5: (at, w)})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(found) == [0, 1, 2, 3, 4] and peak < 40 << 20
