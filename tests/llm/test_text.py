"""Quality rules, decontamination, license scan: cases that the tables don't have."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import decontaminate
from quire.llm.decontaminate import contamination, decontaminated
from quire.llm.licenses import Template, licenses
from quire.llm.quality import quality

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS).withColumns({"n_words": F.lit("x"), "spans": F.lit(0)})


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "a", "\x0b#*$ é\x1c", "x\n\nx\n x\nx\r", "a b c d e a b c d e", "a a a a a a a a", " lead and trail \n", "\u00a0 \u2003"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += ["the of and to " * 40_000]
    out = by_id(quality(docs(spark, *texts)))
    for i, text in enumerate(texts[:-1]):
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(text), text
    assert out[len(texts) - 1]["n_repeat_words"] == 160_000 and out[len(texts) - 1]["base_failed"]
    assert out[0]["base_failed"] and not out[0]["kept"]


def test_symbol_junk_with_a_few_stop_words_is_not_kept(spark):
    junk = " | ".join(f"cell{i}" for i in range(60)).split(" ")
    junk = [w for i, w in enumerate(junk) if w != "|" or i % 4 == 1] + ["the", "of", "and", "in"]
    share = junk.count("|") / len(junk)
    prose = " ".join(f"the word{i} of line{i} is" for i in range(12))
    out = by_id(quality(docs(spark, " ".join(junk), prose, f"{prose} # * | <b>")))
    assert 0.3 < share < 0.46 and not out[0]["base_failed"]
    assert not out[0]["kept"] and out[0]["broken_rules"] == "symbols"
    assert out[1]["kept"] and out[2]["kept"] and out[2]["n_symbols"] == 5


def test_stop_words_count_in_either_case(spark):
    prose = " ".join(f"The word{i} OF line{i} Is" for i in range(12))
    out = by_id(quality(docs(spark, prose, prose.upper(), prose.replace("The", "Qx").replace("OF", "Qy").replace("Is", "Qz"))))
    assert out[0]["kept"] and out[1]["kept"] and out[2]["broken_rules"] == "stop_words"


def test_quality_of_no_rows_and_of_repeated_ones(spark):
    assert quality(spark.createDataFrame([], DOCS)).count() == 0
    assert quality(spark.createDataFrame([(None, "a b"), (None, "a b")], DOCS)).count() == 2


def test_quality_runs_without_python(spark):
    plan = quality(docs(spark, "a"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


ITEM = "The quick brown fox jumps over the lazy dog and then, it sleeps: well all day"


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items):
    words, hit, found = norm(text), set(), set()
    for item_id, item in items:
        w = norm(item)
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item_id))
    return len(words), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("block_chars", [4_000_000, 60])
def test_contamination(spark, block_chars):
    items = [(1, ITEM), (10, ITEM), (2, "short item"), (3, None), (4, ""), (5, "..."), (6, ITEM + " " + "z " * 30), (7, "Ünï-cödé 9")]
    filler = " ".join(f"f{i}" for i in range(400))
    texts = [None, "", "...", ITEM, ITEM.upper(), f"{filler} {ITEM}", f"a-short/ITEM {filler}", ITEM.replace("fox", "cat"),
             f"{ITEM} {ITEM}", "short item", "ünï cödé 9 x", "z " * 50, filler]
    own, bench = docs(spark, *texts), spark.createDataFrame(items, ITEMS)
    out = by_id(contamination(own, bench, block_chars=block_chars))
    for i, text in enumerate(texts):
        n, hit, digest = brute_hits(text, items)
        r = out[i]
        assert (r["n_words"], r["n_hit"], r["items_sha256"]) == (n, hit, digest), text
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    left = decontaminated(own, bench, block_chars=block_chars)
    assert left.columns == own.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i in out if not out[i]["contaminated"]}
    cut = by_id(decontaminated(own, bench, "spans", block_chars=block_chars))
    assert len(cut) == len(texts) and norm(cut[5]["text"]) == norm(filler) and norm(cut[6]["text"]) == ["a", *norm(filler)]
    assert cut[12]["text"] == filler and cut[0]["text"] is None


def test_blocks_are_bounded_and_lose_no_window(spark):
    words = [f"w{i}" for i in range(3 * decontaminate.PIECE_WINDOWS)]
    items = [(1, " ".join(words)), (2, "few words"), (3, " ".join(words[:50])), (None, " ".join(words[::-1]))]
    items += [(10 + i, f"item {i} " + " ".join(words[i : i + 20])) for i in range(200)]
    bench = spark.createDataFrame(items, ITEMS)
    at = decontaminate.PIECE_WINDOWS
    texts = [" ".join(words[i : i + 13]) for i in (0, at - 13, at - 12, at - 1, at, 2 * at - 6, 3 * at - 13)] + ["few words"]
    one, many = (by_id(contamination(docs(spark, *texts), bench, block_chars=n)) for n in (10**9, 20_000))
    assert all(one[i]["n_hit"] == len(t.split()) for i, t in enumerate(texts))
    for i in one:
        assert all(one[i][c] == many[i][c] for c in ("n_words", "n_hit", "items_sha256", "contaminated"))
    named = bench.select(F.col("item_id").cast("string"), "text")
    dealt = decontaminate._dealt(named, 13, 20_000).groupBy("block").agg(F.sum(F.length("text") + 1), F.max(F.length("text"))).collect()
    assert len(dealt) > 3 and all(total <= 20_000 + longest + 1 for _, total, longest in dealt)


def test_contamination_of_nothing(spark):
    own, none = docs(spark, "a b"), spark.createDataFrame([], ITEMS)
    assert by_id(contamination(own, none))[0]["n_hit"] == 0
    assert contamination(spark.createDataFrame([], DOCS), none).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c")], DOCS)
    assert contamination(twice, spark.createDataFrame([(1, "a b"), (2, "b")], ITEMS), block_chars=1).count() == 3


BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def brute_base(text):
    words, places, labels = norm(text), [], set()
    for label, phrase in BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark):
    texts = [
        None, "", "...", "Under the MIT License.", "CC BY-NC CC-BY-NC cc by nc", "cc by", "under the mitt license under the mit, license",
        "Apache License, Version 2.0 " * 3, "a b " * 50 + "under the mit license" + " c d" * 50, "cc by cc by nc nc",
        "This work is licensed under the GNU General Public License, version 3.", "licensed under the gnu GENERAL public licence version 3",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation",
        "the license under the mit apache version 2", "under the m\u0130t license cc by n\u212a", "cc by nc " * 20_000,
    ]
    out = by_id(licenses(docs(spark, *texts)))
    for i, text in enumerate(texts):
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(text), text
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert out[10]["labels"] == "gpl-3" and out[12]["labels"] == "mit" and out[13]["labels"] == "" and out[13]["score"] == 0


def test_licenses_of_long_templates(spark):
    names = [f"w{i}" for i in range(170)]
    own = [Template(f"t{n}", " ".join(names[:n]), base, least) for n, base, least in ((65, True, 1.0), (66, True, 1.0), (67, True, 1.0), (170, False, 0.6))]
    texts = [" ".join(names), "x y " + " ".join(names[:80] + ["put", "in"] + names[80:]) + " z", " ".join(names[:66]), " ".join(names[60:150]), " ".join(names[40:])]
    out = by_id(licenses(docs(spark, *texts), own))
    assert [out[i]["labels"] for i in range(5)] == ["t170,t65,t66,t67", "t170,t65,t66,t67", "t65,t66", "", "t170"]
    assert [out[i]["n_base"] for i in range(5)] == [3, 3, 2, 0, 0]
    assert out[0]["score"] == 1 and out[1]["score"] == 1 and out[4]["score"] == 128 / 168


def test_licenses_of_repeated_rows(spark):
    rows = [(1, "cc by nc"), (1, "cc by nc"), (1, "cc by"), (None, "cc by nc"), (None, None)]
    out = licenses(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"] or 0, r["n_base"]) for r in out) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 1)]
    assert licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_licenses_run_without_python(spark):
    plan = licenses(docs(spark, "a"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_windows_of_a_block_take_little_memory():
    import pickle
    import time
    import tracemalloc

    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(50_000)]
    items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(200)).encode()) for i in range(2100)]
    assert sum(len(x) for _, x in items) > 3_900_000
    sent = pickle.dumps(decontaminate.Windows(items))
    tracemalloc.start()
    own = pickle.loads(sent)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 40 << 20 and len(sent) < 20 << 20
    texts = [items[7][1][50:400], b"x " * 50, items[9][1]]
    assert own.scan(texts).items == [["7"], [], ["9"]]
    began = time.process_time()
    many = decontaminate.Windows([(str(i), b"few words") for i in range(40_000)])
    assert len(many.scan([b"a few words"]).items[0]) == 40_000 and time.process_time() - began < 5


def test_hits_end_with_their_text():
    own = decontaminate.Windows([("1", b"a b c"), ("2", b"x y")])
    found = own.scan([b"a b", b"c x y", None, b"x y", b"x y a b c x", b"", b"y x"])
    spans = [list(zip(found.starts[i:j].tolist(), found.ends[i:j].tolist(), strict=True)) for i, j in zip(found.offsets, found.offsets[1:], strict=False)]
    assert spans == [[], [(1, 3)], [], [(0, 2)], [(0, 5)], [], []]
    assert found.items == [[], ["2"], [], ["2"], ["1", "2"], [], []] and found.n_hit().tolist() == [0, 2, 0, 2, 5, 0, 0]
    assert found.n_words.tolist() == [2, 3, 0, 2, 6, 0, 2]
    empty = decontaminate.Windows([])
    assert empty.scan([b"a b", None]).n_hit().tolist() == [0, 0] and empty.scan([]).items == []


def test_hits_of_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(decontaminate, "rolled", lambda numbers, n: np.zeros(max(0, len(numbers) - n + 1), np.uint64))
    items = [("1", ITEM.encode()), ("2", (ITEM + " and night").encode()), ("3", b"one two three"), ("1", b"one two three")]
    own = decontaminate.Windows(items)
    for text in (ITEM, ITEM.replace("fox", "cat"), "so one two three", ITEM + " and night one two three"):
        found = own.scan([text.encode(), text.encode()])
        n, hit, digest = brute_hits(text, [(i, x.decode()) for i, x in items])
        assert found.n_words.tolist() == [n, n] and found.n_hit().tolist() == [hit, hit]
        assert hashlib.sha256(",".join(found.items[1]).encode()).hexdigest() == digest


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query_in_several_blocks_equals_its_sql(spark, monkeypatch):
    from quire.llm.queries import QUERIES, SQL
    from tests.oracle import same

    found, blocks = decontaminate._blocks, []

    def small(docs, benchmark, window, block_chars):
        blocks.extend(out := found(docs, benchmark, window, 2000))
        return out

    monkeypatch.setattr(decontaminate, "_blocks", small)
    same(spark, "/root/testdata/sf0.001", QUERIES["op3_decontamination"], SQL["op3_decontamination"])
    assert len(blocks) > 2


def test_long_texts_are_split_in_chunks(monkeypatch):
    from quire.llm import common

    rng = random.Random(8)
    data = "".join(rng.choice("aB9 \n\t.é-") for _ in range(5000)).encode()
    whole = [list(common.space_words(data)), list(common.alnum_words(data))]
    assert len(whole[0]) == len(whole[1]) == 1
    monkeypatch.setattr(common, "CHUNK", 64)
    for f, (all_words,) in zip((common.space_words, common.alnum_words), whole, strict=True):
        parts = list(f(data))
        assert len(parts) > 20 and [w for x in parts for w in x] == all_words
    assert [len(x) for x in common.space_words(b"x" * 500)] == [1] and list(common.alnum_words(b"")) == [[]]
