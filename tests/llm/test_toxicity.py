import random
import zlib

from sedge.llm.toxicity import Model, dictionaries, score_toxicity, train, widened
from sedge.runtime import table

LABEL = "doc_id long, quality int, toxic int, _id long, text string"


def corpus(n=800, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioubdlmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    bad = ["grobnak", "fizzwort", "lumpkin", "snaggler"]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(30, 200))
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 0, int(toxic), 0, "x"))
    return rows, labels


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus()
    model = train(documents(rows), spark.createDataFrame(labels, LABEL))
    truth = {i: t for i, _, t, _, _ in labels}
    got = score_toxicity(documents(rows), model).collect()
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got) and len(out) > 100
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in out) / len(out)
    found = sum(r["predicted"] for r in out if truth[r["doc_id"]]) / max(1, sum(truth[r["doc_id"]] for r in out))
    assert right > 0.97 and found > 0.97


def test_held_out_labels_are_not_learnt(spark, documents):
    rows, labels = corpus(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t, a, b) for i, q, t, a, b in labels]
    a, b = (train(documents(rows), spark.createDataFrame(x, LABEL)) for x in (labels, flipped))
    assert (a.ordinary, a.toxic, a.weights) == (b.ordinary, b.toxic, b.weights)


def test_edges(spark, documents):
    rows, labels = corpus(300)
    model = train(documents(rows + rows[:20]), spark.createDataFrame(labels + labels[:50] + [(None, 0, 1, 0, ""), (1, 0, None, 0, "")], LABEL))
    odd = [(1, None, "s"), (2, "", None), (3, "...", "s"), (None, "grobnak", "s"), (4, "word " * 100000 + "grobnak fizzwort lumpkin", "s"), (5, "a grobnak b", "s"), (5, "a grobnak b", "s")]
    got = [tuple(r) for r in score_toxicity(documents(odd), model).collect()]
    assert len(got) == len(odd) and got[0][2] == got[1][2] and got[3][1] is False and got[-1] == got[-2]
    assert score_toxicity(documents([]), model).count() == 0
    bare = train(documents(rows), spark.createDataFrame([], LABEL))
    assert bare.weights == Model(b"", b"").weights and 0 <= score_toxicity(documents(odd), bare).first()["score"] < 0.3


def test_words_that_begin_alike_are_told_apart():
    rng = random.Random(3)
    plain = ["".join(rng.choice("aeioubdlmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)] + ["grobnical"]
    ordinary = [rng.choices(plain, k=60) for _ in range(200)]
    toxic = [rng.choices(plain, k=60) + ["grobnak"] * 2 for _ in range(60)]
    model = Model(*dictionaries(ordinary, toxic))
    assert widened(b" grobnak ") in model.toxic
    known = model.learn({"grobnak", "grobnical"})
    assert known["grobnak"] % 4096 > 2048 + 8 > known["grobnical"] % 4096


def test_words_of_texts_beyond_the_bound_are_learnt(monkeypatch):
    """Many toxic words, each in a few texts, and far more text than stands for a class as it is."""
    monkeypatch.setattr("sedge.llm.toxicity.TEXT_BYTES", (60_000, 15_000))
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(5, 9)))
    plain, bad = [word("aeioubdlmnrst") for _ in range(400)], [word("cfghjkpqvwxyz") for _ in range(40)]
    ordinary = [rng.choices(plain, k=150) for _ in range(300)]
    toxic = [rng.choices(plain, k=150) + [bad[i % 40], bad[(i // 40 + i) % 40]] for i in range(160)]
    model = Model(*dictionaries(ordinary, toxic))
    known = model.learn(set(bad + plain))
    gains = lambda some: sum(known[w] % 4096 - 2048 >= 8 for w in some)
    assert gains(bad) >= 36 and gains(plain) <= 20


def test_held_out_rows_of_the_table(spark):
    """37 toxic texts to learn from; 9 of the 14 held-out ones hold a word that others hold too."""
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = score_toxicity(docs, train(docs, labels)).where("held_out").join(labels, "doc_id").groupBy("toxic").agg({"predicted": "sum", "*": "count"}).collect()
    found = {r["toxic"]: (r["sum(predicted)"], r["count(1)"]) for r in got}
    assert found == {1: (9, 14), 0: (3, 80)}  # as README says
