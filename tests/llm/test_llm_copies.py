"""Near copies: embeddings, n-gram join, line runs, fingerprints; each against a plain version."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from linetriage.llm import graph, jaccard, linededup, neardup, parsing


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_chains_stars_and_loops(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 400)] + [(5, 5), (None, 3), (2, 1), (2, 1)]
    edges += [(random.randint(1000, 1100), random.randint(1000, 1100)) for _ in range(90)]
    want = Sets()
    for a, b in edges:
        if a is not None and a != b:
            want.join(a, b)
    got = {r.id: r.component_id for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: want.find(x) for x in want.up}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_links(rows, least):
    unit = {}
    for i, (vec, values) in enumerate(rows):
        if values and all(v is not None and math.isfinite(v) for v in values) and any(values):
            x = np.array(values, float)
            unit[i] = x / np.linalg.norm(x)
    links, sets = defaultdict(int), Sets()
    for i in unit:
        for j in unit:
            if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                sets.join(rows[i][0], rows[j][0])
    return {vec: (links[i], sets.find(vec)) for i, (vec, _) in enumerate(rows)}


@pytest.mark.parametrize("block", [2048, 16])
def test_near_copies_of_vectors_against_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    rows, vec = [], 0
    for size in (1, 1, 2, 5, 40, 90):
        centre = rng.standard_normal(32)
        for _ in range(size):
            rows.append((vec, (centre + 0.08 * rng.standard_normal(32)).tolist()))
            vec += 1
    rows += [(vec + i, rows[50][1]) for i in range(6)] + [(vec + 10, [3 * v for v in rows[0][1]])]
    rows += [(vec + 20, None), (vec + 21, []), (vec + 22, [0.0] * 32), (vec + 23, [float("nan")] * 32),
             (vec + 24, [None] + [1.0] * 31), (vec + 25, [float("inf")] + [1.0] * 31), (vec + 26, [1.0, 0.0]), (vec + 27, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "1 as id", "'x' as key", "0 as label", "'y' as weight")
    got = neardup.near_copies(df, 0.95, block=block).collect()
    want = plain_links(rows, 0.95)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and len(got) == len(rows)


def test_near_copies_of_null_ids_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    got = neardup.near_copies(spark.createDataFrame([(None, [1.0, 2.0]), (4, [1.0, 2.0])], schema)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in got) == [(-1, 0, None, False), (4, 0, 4, True)]
    assert neardup.near_copies(spark.createDataFrame([], schema)).collect() == []


def test_table_plan_reaches_the_wanted_recall():
    for n in (10, 50_000, 10**9):
        bits, tables = neardup.table_plan(n, 0.95)
        assert (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables <= neardup.MISS


LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < width else frozenset(zip(*(words[i:] for i in range(width))))


def plain_join(rows, width, least):
    found, sets = [(d, shingle_set(t, width)) for d, t in rows], Sets()
    for i, (d, a) in enumerate(found):
        for e, b in found[:i]:
            if a and b and 100 * len(a & b) >= least * len(a | b):
                sets.join(d, e)
    return {d: (len(a), sets.find(d)) for d, a in found}


def edited_texts(seed, count):
    random.seed(seed)
    word = lambda: random.choice("bcdfghjk") + random.choice("aeiou") + random.choice("lmnrst")
    bases = [" ".join(word() for _ in range(random.randint(1, 70))) for _ in range(14)]
    texts = []
    for _ in range(count):
        words = random.choice(bases).split()
        for _ in range(random.choice((0, 0, 1, 1, 2, 5))):
            words[random.randrange(len(words))] = word()
        texts.append(random.choice((" ", "\n", "  ")).join(words))
    return texts


@pytest.mark.parametrize("width,least,block", [(3, 90, 2048), (5, 80, 2048), (3, 80, 8)])
def test_ngram_join_against_all_pairs(documents, monkeypatch, width, least, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = edited_texts(width, 160) + ["", None, "  \n", "One", "one", "ONE two", "É x", "é x", "w " * 5000]
    got = jaccard.link(documents(texts), width, least).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_join(list(enumerate(texts)), width, least)


def test_ngram_join_of_null_ids_repeats_and_empty_tables(documents):
    got = jaccard.link(documents([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, "a b c d")])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got if r.doc_id) == [(3, 3), (3, 3), (9, 3)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.link(documents([])).collect() == []


def test_prefix_filter_is_tight_enough():
    join = jaccard.Join(3, 90)
    for n in range(1, 200):
        for m in range(n, 230):
            need = join.overlap(n, m)
            assert 100 * need >= 90 * (n + m - need) and 100 * (need - 1) < 90 * (n + m - need + 1)
            if need <= n:  # any two sets with that overlap share one of their first elements
                assert join.prefix(n) >= n - need + 1 and join.prefix(m) >= m - need + 1


def plain_line_dedup(texts, words):
    gone, seen = [set() for _ in texts], set()
    for d, text in enumerate(texts):
        lines = text.split("\n")
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(x.split()) for x in lines[a : b + 1]) >= words:
                    key = "\n".join(lines[a : b + 1])
                    if key in seen:
                        gone[d] |= set(range(a, b + 1))
                    seen.add(key)
    return ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in enumerate(texts)]


def test_line_dedup_against_all_runs(documents):
    random.seed(9)
    line = ["a b c", "d", "", "e f", "g h i j", "k l m n o p q r s t"]
    texts = ["\n".join(random.choice(line) for _ in range(random.randint(1, 14))) for _ in range(60)]
    rows = linededup.dedup_lines(documents(texts), words=8).collect()
    want = plain_line_dedup(texts, 8)
    assert {r.doc_id: r.text for r in rows} == dict(enumerate(want))
    assert all(r.n_chars == len(r.text) for r in rows) and {r.source for r in rows} == {"s"}


def test_line_dedup_edges(documents):
    passage = " ".join(f"word{i}" for i in range(60))
    texts = [(5, passage), (2, f"own line\n{passage}\nend"), (None, passage), (7, None), (8, ""), (9, "x " * 40_000)]
    rows = {r.doc_id: r for r in linededup.dedup_lines(documents(texts)).collect()}
    assert rows[2].text == texts[1][1] and rows[5].text == "" and rows[5].removed_lines == 1
    assert rows[None].text == passage and rows[7].text is None and rows[8].text == "" and rows[9].text == texts[5][1]
    assert linededup.dedup_lines(documents([])).collect() == []


def test_fingerprints_do_not_depend_on_neighbours_or_offset():
    random.seed(6)
    text = "".join(random.choice("abcdefg hij") for _ in range(4000))
    alone = parsing.fingerprints([text], keep=10**6)[0]
    assert (parsing.fingerprints(["zz", text, "", "q" * 50], keep=10**6)[1] == alone).all()
    for shift in (1, 2, 7):
        moved = parsing.fingerprints(["#" * shift + "!" + text], keep=10**6)[0]
        assert len(np.intersect1d(moved, alone)) > 0.95 * len(alone)
    assert [len(f) for f in parsing.fingerprints(["", "a", "aaaa"])] == [0, 1, 1]


def test_fingerprints_of_a_table(documents):
    random.seed(8)
    texts = ["".join(random.choice("abcdef ghi") for _ in range(n)) for n in (0, 1, 2, 900, 901, 5000, 40)] + ["é🎉" * 300, None, "tie", "tie"]
    rows = {r.doc_id: r for r in parsing.fingerprint_beside_next(documents(texts), chars=1500).collect()}
    assert len(rows) == len(texts)
    for i, r in rows.items():
        text, after = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        want = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert r.fingerprint == parsing.written(parsing.fingerprints([text])[0])
        assert r.edited_fingerprint == parsing.written(parsing.fingerprints([want])[0])
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert rows[9].near_next == 1.0 and rows[5].near_edited > 0.25 > rows[5].near_next
    assert parsing.fingerprint_beside_next(documents([])).collect() == []
    one = parsing.fingerprint_beside_next(documents([(None, "abcd")])).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(None, 1.0)]
