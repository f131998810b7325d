import random

import numpy as np

from phonolake.llm import latent
from phonolake.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.01"


def eight_grams(words):
    return {tuple(words[k : k + 8]) for k in range(len(words) - 7)}


def test_finds_what_brute_force_finds(spark):
    got = {(r.doc_id, r.item_id) for r in LLM_QUERIES["op5_decontamination"](spark, SF).collect()}
    items = {r.item_id: eight_grams(latent.bare(latent.words_of(r.text))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        own = eight_grams(latent.bare(latent.words_of(r.text or "")))
        want |= {(r.doc_id, i) for i, grams in items.items() if len(grams & own) > len(grams) / 2}
    assert want and got == want


def test_paraphrase_is_found_and_unrelated_text_is_not(spark):
    draw = random.Random(2)
    lexicon = [f"word{i}" for i in range(3000)]
    item = draw.sample(lexicon, 40)
    turned = [w if k % 6 else draw.choice(lexicon) for k, w in enumerate(item)]
    rows = [(i, " ".join(draw.choices(lexicon, k=200))) for i in range(200)]
    rows += [(1000, " ".join(draw.choices(lexicon, k=70) + turned + draw.choices(lexicon, k=90)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(item), item[1]), (6, " ".join(item), "missing")], "item_id long, text string, answer string")
    assert [(r.doc_id, r.item_id) for r in latent.contamination(docs, bench).collect()] == [(1000, 5)]


def test_blocks_give_what_one_pass_gives(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = sorted(map(tuple, latent.contamination(docs, bench).select("doc_id", "item_id").collect()))
    assert sorted(map(tuple, latent.contamination(docs, bench, items_per_pass=15).select("doc_id", "item_id").collect())) == one
    clean = latent.drop_contaminated(docs, bench, items_per_pass=15)
    assert clean.columns == docs.columns and clean.count() == docs.count() - len({d for d, _ in one})


def test_edges(spark):
    item = "the answer to this rather long question is written in a book that nobody reads"
    bench = spark.createDataFrame([(1, item), (1, item), (None, "x"), (2, None), (3, "!?")], "item_id long, text string")
    rows = [(1, None, 0), (2, "", 0), (None, item, 0), (4, item, 0), (4, item, 0), (5, "pad " * 40_000 + item, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = sorted((str(r.doc_id), r.item_id) for r in latent.contamination(docs, bench).collect())
    assert got == [("4", 1), ("4", 1), ("5", 1), ("None", 1)]
    assert {r.doc_id for r in latent.drop_contaminated(docs, bench).collect()} == {1, 2}
    assert latent.contamination(docs.limit(0), bench).count() == 0
    assert latent.contamination(docs, bench.limit(0)).count() == 0
    assert latent.drop_contaminated(docs, bench.where("item_id = 3")).count() == len(rows)


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def planted(draw, lexicon, items, rarest):
    """Rows (id, text, item, kind): each item in running text, verbatim or with words replaced."""
    rows = []
    for kind in ("verbatim", "every fourth", "every third", "rarest"):
        for i, item in enumerate(items):
            for _ in range(6):
                swap = {"verbatim": (), "every fourth": range(3, len(item), 4), "every third": range(2, len(item), 3), "rarest": rarest(item)}[kind]
                copy = [draw.choice(lexicon) if k in swap else w for k, w in enumerate(item)]
                rows.append((len(rows), " ".join(draw.choices(lexicon, k=draw.randrange(150)) + copy + draw.choices(lexicon, k=draw.randrange(150))), i, kind))
    return rows


def test_short_and_paraphrased_items_are_found_as_by_brute_force(spark):
    draw = random.Random(5)
    lexicon = [f"word{i}" for i in range(2000)] + ["the", "of", "a", "and"] * 300
    items = [draw.choices(lexicon, k=n) for n in (6, 8, 8, 10, 10, 12, 15, 18, 24, 30, 45, 59, 70)]
    weight = {w: lexicon.count(w) for item in items for w in item}
    rows = planted(draw, lexicon, items, lambda item: sorted(range(len(item)), key=lambda k: (weight[item[k]], item[k]))[:3])
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(item)) for i, item in enumerate(items)], "item_id long, text string")
    found = latent.contamination(docs, bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert {(d, i) for d, _, i, kind in rows if kind == "verbatim"} <= got
    read = latent.with_features(docs, "text", "ids")
    (searcher,) = latent.searchers(read, bench)
    alike, answered = set(), set()
    for d, text, _, _ in rows:
        words = latent.bare(latent.words_of(text))
        for item, full in zip(searcher.items, items, strict=True):
            for p in range(0, len(words), item.half):
                region = words[max(0, p - len(full)) : p + 2 * item.half + len(full)]
                share = common(full, region) / len(full)
                if (p == 0 or p + item.half < len(words)) and share >= 0.6:
                    alike.add((d, item.item_id))
                    if len(item.answer & set(region)) >= len(item.answer) / 2:
                        answered.add((d, item.item_id))
    # nothing but real matches, and all that the answer decides, whatever its cosine
    assert answered <= got <= alike
    # without the answer: the cosine finds them, by kind of change
    by_cosine = {(r.doc_id, r.item_id) for r in found if r.cosine >= latent.COSINE}
    recall = {}
    for kind in ("verbatim", "every fourth", "every third", "rarest"):
        # what was planted and is still alike; short items of common words also meet by chance
        want = alike & {(d, i) for d, _, i, k in rows if k == kind}
        recall[kind] = (len(want & got) / len(want), len(want & by_cosine) / len(want), len(want))
    print("RECALL", recall)
    assert all(r >= 0.9 for r, _, _ in recall.values()), recall


def test_a_named_answer_must_be_there(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, item, "seven"), (2, item, "missing")], "item_id long, text string, answer string")
    docs = spark.createDataFrame([(1, "before " * 9 + item + " after" * 9)], "doc_id long, text string")
    assert [r.item_id for r in latent.contamination(docs, bench).collect()] == [1]


def test_passages_of_one_length_do_not_depend_on_the_others(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    table = draw.normal(size=(latent.FEATURES + 1, 16)).astype(np.float32)
    table[:50] = table[-1] = 0
    sizes = np.array([0, 1, 5, 6, 7, 23, 24, 25, 130, 0, 49])
    ids = draw.integers(0, 400, sizes.sum())
    together = latent.passage_vectors(table, ids, sizes, (6, 12, 24))
    for half in (6, 12, 24):
        alone = latent.passage_vectors(table, ids, sizes, (half,))[half]
        assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(together[half], alone, strict=True))
        begin = np.cumsum(sizes) - sizes
        for vector, text, place in zip(*alone, strict=True):
            own = ids[begin[text] : begin[text] + sizes[text]]
            assert place % half == 0 and (place == 0 or place + half < len(own))
            before = np.append(-1, own)[place : place + 2 * half]
            words = own[place : place + 2 * half]
            want = table[words[words != before[: len(words)]]].sum(axis=0)
            assert np.allclose(vector, latent.units(want[None])[0], atol=1e-4)


def test_own_columns_of_the_same_name_stay(spark):
    docs = spark.createDataFrame([(1, "some text", b"x", 7), (2, None, None, None)], "doc_id long, text string, _features binary, ids long")
    bench = spark.createDataFrame([(1, "a whole other matter")], "item_id long, text string")
    assert sorted(latent.drop_contaminated(docs, bench).collect()) == sorted(docs.collect())


def test_space_is_fitted_on_all_texts(spark):
    """The sums of the partitions are those of the whole matrix, whatever share of the rows a sample would have drawn."""
    draw = np.random.default_rng(3)
    texts = [draw.integers(0, 200, draw.integers(0, 60)).astype(np.int16) for _ in range(500)]
    weight = np.where(np.arange(latent.FEATURES) % 7 == 0, 0, 1 + np.arange(latent.FEATURES) % 5).astype(float)
    whole = np.zeros((len(texts), latent.FEATURES))
    for k, ids in enumerate(texts):
        at = np.unique(ids)
        norm = np.linalg.norm(weight[at])
        whole[k, at] = weight[at] / norm if norm else 0
    read = spark.createDataFrame([(t.tobytes(),) for t in texts], "ids binary").repartition(5)
    space = latent.latent_space(read, weight, 100, 11)
    # with more directions than words, the space divided by its values is a whitening: A V / s has unit columns
    _, values, directions = np.linalg.svd(whole, full_matrices=False)
    mine = whole @ space[:, :20]
    assert np.allclose(mine.T @ mine, np.eye(20), atol=1e-2)
    assert np.allclose(np.abs(directions[0] / values[0] @ space[:, 0]) * values[0] ** 2, 1, atol=1e-2)


def test_sums_come_to_the_driver_in_shares(spark, monkeypatch):
    from pyspark.sql import DataFrame

    def refused(self):
        raise AssertionError("the whole matrix is collected at once")

    rows = spark.range(0, 10, 1, 3).withColumnRenamed("id", "k")
    want = np.zeros((latent.FEATURES, 3))
    for k in range(10):
        want[k * 1000] += [1, k, 2]

    def part(batch):
        total = np.zeros((latent.FEATURES, 3))
        for k in batch.column(0).to_pylist():
            total[k * 1000] += [1, k, 2]
        return total

    for kind in {DataFrame, type(rows)}:
        monkeypatch.setattr(kind, "collect", refused)
    assert (latent.summed(rows, part) == want).all()
    assert latent.summed(rows.where("k < 0"), part).shape == (latent.FEATURES, 0)


def test_last_pass_sums_only_the_space(spark, monkeypatch):
    """Two passes add up a row for each feature, the last one only a row for each direction."""
    draw = np.random.default_rng(5)
    texts = [draw.integers(0, 300, n).astype(np.int16) for n in (0, 40, 1, 25, 60)]
    matrix = draw.normal(size=(latent.FEATURES, 7)).astype(np.float32)
    idf = np.where(np.arange(latent.FEATURES) % 4 == 0, 0, 2).astype(np.float32)
    whole = np.zeros((len(texts), latent.FEATURES))
    for k, ids in enumerate(texts):
        whole[k, np.unique(ids)] = idf[np.unique(ids)]
    whole /= np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-9)
    assert np.allclose(latent.text_sums(texts, idf, matrix), whole.T @ (whole @ matrix), atol=1e-4)
    assert np.allclose(latent.image_squares(texts, idf, matrix), (whole @ matrix).T @ (whole @ matrix), atol=1e-4)
    heights, plain = [], latent.summed
    monkeypatch.setattr(latent, "summed", lambda rows, fn, height=latent.FEATURES: heights.append(height) or plain(rows, fn, height))
    read = spark.createDataFrame([(t.tobytes(),) for t in texts], "ids binary")
    latent.latent_space(read, idf, 10, 11)
    assert heights == [latent.FEATURES] * latent.POWERS + [10 + latent.EXTRA]


def test_features_of_whole_columns_are_those_of_words():
    import random

    import pyarrow as pa

    draw = random.Random(1)
    signs = [*map(chr, range(128)), *"éÜßΣİſ\u0085\xa0 你_ \n"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(60))) for _ in range(3000)] + ["", None, "ΑΣ ΑΣΑ", " a  b ", "it's (this) _one_", "\x01b\x7f"]
    got = latent.ids_of_texts(pa.array(texts))
    assert all(g.tolist() == latent.ids_of(latent.words_of(t or "")).tolist() for g, t in zip(got, texts, strict=True))
    assert latent.ids_of_texts(pa.array([], pa.string())) == []
