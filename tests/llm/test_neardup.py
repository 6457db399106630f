import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import neardup
from quire.llm.components import connected_components
from quire.llm.neardup import drop_near_duplicates, near_duplicates

DOCS = "doc_id long, text string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows):
    """doc_id to (n, component) by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and min(len(x), len(y)) * 100 >= 85 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 85 * (len(x) + len(y) - both):
                    a_, b_ = root(a), root(b)
                    parent[max(a_, b_)] = min(a_, b_)
    return {i: (len(x), root(i)) for i, x in sets}


def found(spark, rows):
    out = near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}


def changed(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def test_chains_and_copies(spark):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"g{g}x{rng.randrange(900)}" for _ in range(rng.randint(60, 300))]
        rows += [base, base]
        for _ in range(6):
            rows.append(changed(rows[-1], rng.randint(0, 4), rng))
    rng.shuffle(rows)
    texts = [(i, rng.choice(["  ", "\n", " "]).join(w).upper() if i % 4 == 0 else " ".join(w)) for i, w in enumerate(rows)]
    assert found(spark, texts) == brute(texts)


def test_a_large_family_around_the_threshold(spark):
    rng = random.Random(6)
    base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
    texts = [(i, " ".join(changed(base, rng.randint(0, 9), rng))) for i in range(250)]
    assert found(spark, texts) == brute(texts)


def compared(spark, monkeypatch, texts, **how):
    """Pairs that are compared: candidates, and rows that meet at a shingle."""
    n, links, meeting = [0], neardup._links, neardup._meeting

    def counted_links(pairs, *others):
        n[0] += pairs.distinct().count()
        return links(pairs, *others)

    def counted_meeting(held):
        small, large = meeting(held)
        key = neardup._KEY
        a, b = (x.groupBy(key).agg(F.count("*").alias(name)) for x, name in ((small, "p"), (large, "q")))
        n[0] += a.join(b, key).agg(F.sum(F.col("p") * F.col("q"))).first()[0] or 0
        return small, large

    with monkeypatch.context() as m:
        m.setattr(neardup, "_links", counted_links)
        m.setattr(neardup, "_meeting", counted_meeting)
        for name, value in how.items():
            m.setattr(neardup, name, value)
        return found(spark, texts), n[0]


def template(n, own, first=()):
    """n texts of one template of 1000 words with own words behind, after the texts of `first` (numbers of own words)."""
    rng = random.Random(9)
    sizes = [*first, *(rng.randint(*own) for _ in range(n))]
    body = " ".join(f"t{i}" for i in range(1000))
    return [(k, " ".join([body, *(f"o{k}x{i}" for i in range(y))])) for k, y in enumerate(sizes)]


def test_pairs_of_a_template_grow_with_its_texts(spark, monkeypatch):
    # One text is linked with all others, no two of which are linked.
    few, many = (compared(spark, monkeypatch, [*template(n, (95, 134)), (n, template(1, (10, 10))[0][1])]) for n in (300, 1200))
    assert {c for _, c in few[0].values()} == {0} and {c for _, c in many[0].values()} == {0}
    assert many[1] < 6 * few[1] and many[1] < 40 * 1200


def test_pairs_of_a_template_without_a_good_hub(spark, monkeypatch):
    # The smallest texts lack a part of the template and are linked with none; the others are with each other.
    def texts(n):
        words = [f"t{i}" for i in range(1000)]
        lacking = [" ".join([*words[: 40 * k], *words[40 * k + 140 :], *(f"p{k}x{i}" for i in range(40))]) for k in range(20)]
        return [*enumerate(lacking), *((20 + k, x) for k, x in template(n, (60, 88)))]

    few, many = (compared(spark, monkeypatch, texts(n)) for n in (100, 400))
    assert len({c for _, c in many[0].values()}) == 21 and many[1] < 5 * few[1]
    # The exact stage alone: hubs of no use, no bucket small.
    own = template(150, (95, 134), [10])
    assert compared(spark, monkeypatch, own, LEAST_EQUAL=0, FEW=0)[0] == brute(own)


def edited(words, n, rng):
    """words with n of them replaced, removed or put in."""
    out = list(words)
    for _ in range(n):
        i, own = rng.randrange(len(out)), [f"w{rng.randrange(10**7)}"]
        out[i : i + 1] = rng.choice([own, [], [*own, out[i]]])
    return out


def test_pairs_of_copies_edited_in_different_places(spark, monkeypatch):
    # Some are links of the original, most are a little too far from it, and few of those are links of others.
    base = [f"b{i}" for i in range(150)]
    texts = lambda n, rng: [(i, " ".join(edited(base, rng.randint(1, 6), rng))) for i in range(n)]
    few, many = (compared(spark, monkeypatch, texts(n, random.Random(3))) for n in (600, 2400))
    assert few[0] == brute(texts(600, random.Random(3)))
    assert many[1] < 6 * few[1] and many[1] < 60 * 2400


def test_sets_apart_from_a_pivot(spark, monkeypatch):
    # The exact stage alone, over originals of several sizes, one of which is a part of another.
    rng = random.Random(12)
    base = [f"b{i}" for i in range(160)]
    rows = [(k, " ".join(edited(b, rng.randint(0, 6), rng))) for k, b in enumerate([base, base[:140], base[:100], base + base[3:60]] * 50)]
    assert compared(spark, monkeypatch, rows, LEAST_EQUAL=0, FEW=0, TURNS=0, AROUND=16)[0] == brute(rows)


def test_meeting_rows_of_one_template(spark):
    # Rows of one shingle behind 95 to 134 of their own, each its own component, and one behind 10.
    rows = [((k, 0), (k, 0), 1000 + y, y, 7) for k, y in enumerate([10, *(95 + k % 40 for k in range(5000))])]
    kind = "struct<doc_id: long, row: long>"
    small, large = neardup._meeting(spark.createDataFrame(rows, f"id {kind}, label {kind}, size long, at long, shingle long"))
    met = small.join(large, neardup._KEY).count()
    assert 5000 <= met <= 15_000


def test_a_hub_with_many_candidates_is_dealt_out(spark, monkeypatch):
    rng = random.Random(16)
    base = [f"b{i}" for i in range(200)]
    texts = [(i, " ".join(changed(base, rng.randint(0, 3), rng))) for i in range(120)]
    monkeypatch.setattr(neardup, "CELL", 8)
    assert found(spark, texts) == brute(texts)


def test_short_empty_and_null(spark):
    texts = [(5, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  two"), (6, "one two three"), (7, "É x"), (8, "é x")]
    assert found(spark, texts) == {5: (0, 5), 1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 6: (1, 6), 7: (1, 7), 8: (1, 8)}


def test_rows_without_id_repeated_rows_and_no_rows(spark):
    rows = [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f")]
    own = spark.createDataFrame(rows, DOCS).withColumns({"component_id": F.lit("x"), "id": F.lit(1), "__gone": F.lit(0)})
    out = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_duplicates(own).collect())
    assert out == [(0, None, True), (1, 1, True), (2, 1, False), (2, 1, False)]
    kept = drop_near_duplicates(own.drop("__gone")).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1] and kept[0]["component_id"] == "x"
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_a_doc_id_with_several_texts(spark):
    rng = random.Random(4)
    x, y, z = ([f"{name}{i}" for i in range(80)] for name in "xyz")
    near = " ".join(changed(x, 1, rng))
    rows = [
        (2, near), (5, " ".join(x)), (5, " ".join(y)), (5, " ".join(z)), (6, " ".join(changed(z, 1, rng))),
        (7, "own words of seven"), (7, "own words of seven"), (7, "OWN words of seven"), (8, "Own words of seven"), (9, None), (9, None),
    ]
    own = spark.createDataFrame(rows, DOCS).withColumn("more", F.monotonically_increasing_id())
    out = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(own).collect())
    assert out == [
        (2, 2, True), (5, 2, False), (5, 5, True), (5, 5, True), (6, 5, False),
        (7, 7, False), (7, 7, False), (7, 7, True), (8, 7, False), (9, 9, True), (9, 9, True),
    ]
    left = drop_near_duplicates(own)
    assert left.columns == own.columns
    kept = sorted((r["doc_id"], (r["text"] or "").lower()) for r in left.collect())
    assert kept == [(2, near), (5, " ".join(y)), (5, " ".join(z)), (7, "own words of seven"), (9, ""), (9, "")]


def test_a_very_long_text(spark):
    rng = random.Random(8)
    long = [f"v{rng.randrange(10**5)}" for _ in range(60_000)]
    texts = [(1, " ".join(long)), (2, " ".join(changed(long, 300, rng))), (3, " ".join(long[:30_000]))]
    assert {k: c for k, (_, c) in found(spark, texts).items()} == {1: 1, 2: 1, 3: 3}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_documents_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == brute(rows)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7), (None, 3)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        return i if parent[i] == i else root(parent[i])

    for a, b in edges:
        if None not in (a, b):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    wanted = {i: root(i) for i in list(parent) if root(i) != i}
    out = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["u"]: r["component"] for r in out.collect()} == wanted
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = (np.concatenate((both, rng.integers(0, 2**63, 100).astype(np.uint64))) for _ in range(2))
    equal = (neardup.minima(a) == neardup.minima(b)).mean()
    assert abs(equal - 900 / 1100) < 0.12
