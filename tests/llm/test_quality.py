import random
import re
from collections import Counter

import pytest

from sedge.llm.quality import host_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "bé", "c#", "😀", "d|<", "e"]
    spaces = [" ", "  ", "\t", "\n", "\x0b", "\r\n", "\xa0", " "]
    rows = []
    for i in range(150):
        parts = [rng.choice(vocabulary[: rng.randrange(1, 7)]) + rng.choice(spaces) for _ in range(rng.randrange(70))]
        text = "".join(parts)
        rows.append((i, text + text if rng.random() < 0.3 else text, rng.choice(["h1", "h2", None])))
    return rows + [(900, None, "h1"), (901, "", "h1"), (902, "one two " * 20000, "h2"), rows[3], rows[3], (None, "x " * 30, "h2")]


@pytest.mark.parametrize("seed", range(2))
def test_measures(spark, documents, seed):
    rows = corpus(seed)
    got = host_quality(documents(rows)).collect()
    assert len(got) == len(rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(str((r["doc_id"], *(r[n] for n in names))) for r in got) == sorted(str((i, *measured(t))) for i, t, _ in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and not r["host_failed"])


def test_hosts(spark, documents):
    rng = random.Random(4)
    fine = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    rows = [(i, fine(), f"good{i % 40}") for i in range(1200)]
    rows += [(2000 + i, "few words" if i < 95 else fine(), "bad") for i in range(100)]
    rows += [(3000 + i, "few words" if i < 1 else fine(), "small") for i in range(1)]
    got = {r["doc_id"]: r for r in host_quality(documents(rows)).collect()}
    assert all(got[2000 + i]["host_failed"] and not got[2000 + i]["kept"] for i in range(100))
    assert not got[3000]["host_failed"] and got[3000]["base_failed"]  # one document is no evidence against a host
    assert all(got[i]["kept"] for i in range(1200))


def test_empty(spark, documents):
    assert host_quality(documents([])).count() == 0


def test_no_python_in_the_plan(spark, documents):
    plan = host_quality(documents([(1, "a", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
