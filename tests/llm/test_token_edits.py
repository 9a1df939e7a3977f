"""Trees under many edits: equal to a fresh encoding, whatever the edits are, in time near to the text's length."""

import random
import time

import numpy as np
import pytest

from glossaria.llm import tokens

ALPHABET = ["the", " ", "  ", "\n", "\n\n", "it's", "1234567", "é", "日本", "!!", "...", "A", "aB", "\t", "🙂", "'", "x" * 30, " [PII]"]


def whole(text):
    pieces = tokens._pattern().findall(text)
    return [tokens.counts()[p] for p in pieces], [len(p) for p in pieces]


def check(tree, text):
    assert tree.text == text
    t, c = tree.pre_tokens()
    assert (t.tolist(), c.tolist()) == whole(text)
    assert tree.n_tokens == len(tokens.encoding().encode_ordinary(text)) and tree.sums[1].tolist() == [sum(t), sum(c)] and len(tree.cuts) >= 2
    n = len(tree.cuts) - 1
    assert tree.cuts[-1] == len(t) and tree.sums[tree.base : tree.base + n, 1].tolist() == [int(c[i:j].sum()) for i, j in zip(tree.cuts[:-1], tree.cuts[1:], strict=True)]
    level = np.arange(1, tree.base)
    assert (tree.sums[level] == tree.sums[2 * level] + tree.sums[2 * level + 1]).all()


@pytest.mark.parametrize("seed", range(6))
def test_edits_equal_a_fresh_encoding(seed):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, n)))
    for _ in range(60):
        text = piece(rng.choice([0, 3, 40, 400]))
        tree = tokens.TokenTree(text, tokens.counts())
        for _ in range(rng.randint(1, 4)):
            todo = []
            for _ in range(rng.choice([0, 1, 2, 5, 40])):
                at = rng.randint(-2, len(text) + 3)
                todo.append(tokens.Edit(at, at + rng.choice([0, 0, 1, 3, 20, -1]), piece(rng.choice([0, 1, 4]))))
                start = min(max(0, at), len(text))
                text = text[:start] + todo[-1].text + text[min(max(start, todo[-1].stop), len(text)) :]
            if rng.random() < 0.2:
                for e in todo:
                    tree.edit(e)
            else:
                tree.edits(todo)
            check(tree, text)


def test_edits_touch_little_of_a_long_text():
    text = "".join(random.Random(1).choice(ALPHABET) for _ in range(30_000))
    tree = tokens.TokenTree(text, tokens.counts())
    tree.edits([tokens.Edit(at, at + 3, "new") for at in range(100, 3_000, 700)])
    assert 0 < tree.encoded < 200


def test_many_edits_take_linear_time():
    def took(n):
        text = " ".join(f"write to user{i % 997}@mail.example about it" for i in range(n))
        todo = tokens.mask_edits(text)
        tree = tokens.TokenTree(text, tokens.counts())
        began = time.time()
        tree.edits(todo)
        assert len(todo) == n and tree.n_tokens == len(tokens.encoding().encode_ordinary(tokens.MASK.sub("[PII]", text)))
        return time.time() - began

    small, large = took(10_000), took(100_000)
    assert large < 20 and large < 25 * max(small, 0.05)


def test_many_edits_at_random_places():
    rng = random.Random(9)
    text = "some words of a text that is long enough " * 20_000
    tree = tokens.TokenTree(text, tokens.counts())
    todo = []
    n = len(text)
    for _ in range(20_000):
        at = rng.randrange(n)
        todo.append(tokens.Edit(at, at + 2, rng.choice(["", "x", "new words"])))
        n += len(todo[-1].text) - min(2, n - at)
    began = time.time()
    tree.edits(todo)
    assert time.time() - began < 30
    for e in todo:
        text = text[: e.start] + e.text + text[e.stop :]
    assert tree.text == text and tree.n_tokens == len(tokens.encoding().encode_ordinary(text))


def test_tables_of_edits(spark):
    docs = spark.createDataFrame([(1, "a few words here"), (2, None), (2, "twice here"), (None, "no id"), (3, "x")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 1, 0, 1, "an"), (1, 2, 5, 6, None), (9, 1, 0, 1, "unknown id"), (None, 1, 0, 1, "null id"), (2, 1, 0, 5, "once"), (3, 1, 0, 99, "")], "doc_id long, seq int, start int, stop int, text string")
    want = {(1, "an fe words here"), (2, "once"), (2, "once here"), (None, "no id"), (3, "")}
    once = tokens.edited_trees(tokens.token_trees(docs), edits)
    assert {(r.doc_id, r.text) for r in once.collect()} == want
    for r in once.collect() + tokens.recount(docs, edits).collect():
        n = r.n_tokens if "text" in r else r.n_tokens_edited
        assert any(r.doc_id == i and n == len(tokens.encoding().encode_ordinary(t)) for i, t in want)
