"""Text operators against brute force and invariants."""

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moraine.llm import leakage, packing, queries, textform

DOC = "doc_id long, text string, form string, class_id long"


def docs_df(spark, texts, **more):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], DOC)


# ---------------------------------------------------------------- 10: one form


def test_form_of_known_cases():
    same = [
        ("Ｈｅｌｌｏ，　ｗｏｒｌｄ！", "Hello, world!"), ("été", "été"), ("a​b﻿c­d⁠", "abcd"), ("x y z ", "x y z "),
        ("сору", "copy"), ("ΑΒΕ", "ABE"), ("ё", "ë"), ("а́", "á"), ("ọ̈", "ọ̈"), ("ІЅЕ", "ISE"), ("ӏο", "lo"), ("Ί", "Í"),
    ]
    for a, b in same:
        assert textform.form(a) == textform.form(b), (a, b)
    different = [("a", "A"), ("e", "é"), ("2", "²"), ("1", "2"), ("a b", "ab"), ("a\nb", "a b"), ("ß", "ss"), ("к", "k"), ("З", "3")]
    for a, b in different:
        assert textform.form(a) != textform.form(b), (a, b)
    assert textform.form(None) is None and textform.form("") == ""


def test_form_of_lookalikes_without_a_latin_twin(spark):
    for a, b in (("\u0413", "\u0393"), ("\u041f", "\u03a0"), ("\u0424", "\u03a6"), ("\u0470", "\u03a8"), ("\u0471", "\u03c8"), ("\u0474", "V"), ("\u0403", "\u0393\u0301")):
        assert textform.form(a) == textform.form(b) and textform.form(f"x{a}y z") == textform.form(f"x{b}y z"), (a, b)
    assert textform.form("\u041f\u0424") == "\u041f\u0424"
    members = textform.lookalike_members(docs_df(spark, ["a \u0413\u041f", "a \u0393\u03a0", "a \u0424", "a \u03a6", "a \u0433"]))
    assert sorted(tuple(r) for r in textform.lookalike_pairs(members).collect()) == [(0, 1), (2, 3)]


def test_clean_documents_and_forms_are_queries_over_whole_tables(spark, tmp_path):
    passage = "one two three four five six seven eight"
    docs_df(spark, [f"x {passage} y", "\u0441\u043eру", "copy", None, "short"]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "s", passage, "no")], "item_id int, suite string, question string, answer string").write.parquet(f"{tmp_path}/eval_items.parquet")
    assert sorted(r[0] for r in queries.QUERIES["p9_clean"](spark, str(tmp_path)).collect()) == [1, 2, 3, 4]
    got = {r.doc_id: (r.form, r.canonical_id) for r in queries.QUERIES["p10_forms"](spark, str(tmp_path)).collect()}
    assert got == {0: (f"x {passage} y", 0), 1: ("copy", 1), 2: ("copy", 1), 3: (None, 3), 4: ("short", 4)}


def test_letter_classes_are_those_of_the_public_list(spark):
    """Each class is one in the Unicode list of confusable characters; letters of two alphabets of one case and form are in it."""
    jvm = spark._jvm.com.ibm.icu
    checker = jvm.text.SpoofChecker.Builder().build()
    scripts = {jvm.lang.UScript.getCode(n)[0] for n in ("Latin", "Cyrillic", "Greek")}
    seen, own = set(), {"QԚ", "hһҺ", "lӏ", "қⱪ", "ңⱨ"}  # not in the list, but of the same form
    for same in textform.LETTERS:
        assert len(same) > 1 and not seen & set(same) and all(jvm.lang.UScript.getScript(ord(c)) in scripts for c in same)
        seen |= set(same)
        assert len({checker.getSkeleton(c) for c in same}) == 1 or same in own, same
    for a, b in ("ΓГ", "ΠП", "ΦФ", "ÆӔ", "æӕ", "ƏӘ", "əә", "ΑА", "οо", "Өɵ".upper()):
        assert textform.form(a) == textform.form(b), (a, b)
    for a, b in ("αa", "ρp", "Il", "З3", "Оо", "кk", "ιl"):
        assert textform.form(a) != textform.form(b), (a, b)


def test_planted_pairs_of_every_letter_are_found(spark):
    words_ = [(f"{i} gate {a} of", f"{i} gate {b} of") for i, (a, b) in enumerate((s[0], c) for s in textform.LETTERS for c in s[1:])]
    texts = [t for pair in words_ for t in pair]
    members = textform.lookalike_members(docs_df(spark, texts))
    got = {tuple(r) for r in textform.lookalike_pairs(members).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(len(words_))} and len(words_) > 100
    sizes = textform.lookalike_classes(textform.lookalike_members(docs_df(spark, ["copy", "сору", "copy", "x"]))).collect()
    assert sorted(tuple(r) for r in sizes) == [(0, 0, 0, 3), (0, 1, 1, 3), (0, 2, 0, 3)]


@given(st.text(alphabet="aeоо́ё̈́Ａ１​  ²б", max_size=12))
def test_form_is_stable(text):
    once = textform.form(text)
    assert textform.form(once) == once and unicodedata.is_normalized("NFC", once)
    assert textform.form(unicodedata.normalize("NFD", text)) == once == textform.form(unicodedata.normalize("NFC", text))


def pairs_by_hand(texts):
    out = set()
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            if a is not None and texts[j] is not None and a != texts[j] and textform.form(a) == textform.form(texts[j]):
                out.add((i, j))
    return out


def test_lookalikes_against_brute_force(spark):
    rng = random.Random(9)
    base = ["open the gate", "Is it 5 + 5?", "naïve café", "ok", "Ok", "", " ", "x" * 9000, "длинный текст", "a\x01b", "ab"]
    swap = {"o": "о", "e": "е", "a": "а", " ": " ", "5": "５", "ï": "ï", "é": "é", "x": "х"}
    texts = [None, "​", "a\x01b"]
    for _ in range(120):
        t = rng.choice(base)
        texts.append("".join(swap[c] if c in swap and rng.random() < 0.2 else c for c in t) + rng.choice(["", "", "‍"]))
    members = textform.lookalike_members(docs_df(spark, texts))
    got = [tuple(r) for r in textform.lookalike_pairs(members).collect()]
    assert set(got) == pairs_by_hand(texts) and len(got) == len(set(got)) > 100
    canonical = dict(tuple(r) for r in textform.canonical_members(docs_df(spark, texts), members).collect())
    assert len(canonical) == len(texts) and canonical[0] == 0
    assert all(textform.form(texts[i]) == textform.form(texts[c]) for i, c in canonical.items())
    forms = dict(tuple(r) for r in textform.canonical_documents(docs_df(spark, texts)).collect())
    assert forms == {i: textform.form(t) for i, t in enumerate(texts)}
    assert textform.lookalike_members(docs_df(spark, texts).limit(0)).count() == 0


# ---------------------------------------------------------------- 9: leakage


def longest(a, b, least):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best if best >= least else 0


def leaks_by_hand(texts, items, least):
    out = {}
    for item, question, answer in items:
        for part, t in (("question", question), ("answer", answer)):
            for i, text in enumerate(texts):
                n = longest(leakage.words(t), leakage.words(text), least)
                if n:
                    out[item, part, i] = n
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(12)
    vocabulary = ["gate", "Gate", "öffnen", "5", "а", "x²", "the", "of", "to", "in"]
    sentence = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, sentence(rng.randrange(3, 14)), rng.choice([None, "", sentence(12)])) for i in range(8)] + [(8, "a a a a a a a a a a", "one two three four five six seven eight nine")]
    texts = [None, "", "…", "a " * 300, "One, TWO three four-five six seven ｅight"] + [sentence(rng.randrange(2, 60)) for _ in range(40)]
    texts += [t + " plus " + items[rng.randrange(9)][1] for t in texts[5:15]]
    frame = spark.createDataFrame(items, "item_id int, question string, answer string")
    for least, shard, block in ((8, 4_000_000, 2_000_000), (8, 50, 10), (3, 200, 10**6)):
        got = {(r.item_id, r.part, r.doc_id): r for r in leakage.leaked_passages(docs_df(spark, texts), frame, min_words=least, shard_words=shard, block_words=block).collect()}
        assert {k: r.matched_words for k, r in got.items()} == leaks_by_hand(texts, items, least)
        for (item, part, doc), r in got.items():
            t = leakage.words(items[item][1 if part == "question" else 2])
            assert t[r.item_word : r.item_word + r.matched_words] == leakage.words(texts[doc])[r.doc_word : r.doc_word + r.matched_words]
    found = leakage.leaked_passages(docs_df(spark, texts), frame)
    clean = leakage.clean_documents(docs_df(spark, texts), found)
    assert clean.count() == len(texts) - found.select("doc_id").distinct().count() and found.where("doc_id = 4").count() == 1
    assert leakage.leaked_passages(docs_df(spark, texts).limit(0), frame).count() == 0
    assert leakage.leaked_passages(docs_df(spark, texts), frame.limit(0)).count() == 0


@settings(deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.lists(st.integers(0, 3), min_size=1, max_size=20), st.integers(1, 5))
def test_shard_search_finds_the_longest_matches(corpus, test, least):
    texts = leakage.TestTexts([])
    texts.ids = np.array([*test, 0], dtype=np.int64)
    got = set()
    for t, c, n in leakage.search_shard(np.array([*corpus, 0], dtype=np.int64), texts, least, chunk=3):
        got |= set(zip(t.tolist(), c.tolist(), n.tolist()))
    want = set()
    for i in range(len(test)):
        for j in range(len(corpus)):
            n = 0
            while i + n < len(test) and j + n < len(corpus) and test[i + n] == corpus[j + n] != 0:
                n += 1
            before = i and j and test[i - 1] == corpus[j - 1] != 0
            if n >= least and not before:
                want.add((i, j, n))
    assert got == want


def test_a_passage_in_very_many_documents_and_items_stays_small():
    """Half of all documents and every item have one passage of 60 words: a match for each pair, no more."""
    import tracemalloc

    import pyarrow as pa

    passage = " ".join(f"w{i}" for i in range(60))
    test = leakage.TestTexts([(i, "question", f"item{i} {passage} end{i}") for i in range(200)])
    docs = pa.RecordBatch.from_arrays([pa.array(range(50_000), pa.int64()), pa.array([f"doc {passage} more" if i % 2 else "nothing here" for i in range(50_000)])], names=["doc_id", "text"])
    run = leakage._search(test, 8, 400_000)
    tracemalloc.start()
    n = 0
    for batch in run(iter([docs])):
        n += batch.num_rows
        assert set(batch.column("matched_words").unique().to_pylist()) == {60} and batch.num_rows <= 100_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 25_000 * 200 and peak < 700e6


# ---------------------------------------------------------------- 8: packing


def fill(runs, capacity):
    """Items per container by a plan, as (length, container), checked against nothing yet."""
    out = []
    for r in runs:
        for i in range(r.count):
            out.append((r.length, r.rank + i, r.first + i // r.per))
    return out


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15), st.sampled_from([packing.best_fit_plan, packing.bucket_plan]))
def test_plans_place_each_item_once_within_capacity(histogram, plan):
    capacity = 40
    placed = fill(plan(histogram, capacity), capacity)
    assert sorted((n, r) for n, r, _ in placed) == sorted((n, r) for n, c in histogram.items() for r in range(c))
    loads = {}
    for n, _, c in placed:
        loads[c] = loads.get(c, 0) + n
    assert all(load <= capacity for load in loads.values()) and set(loads) == set(range(len(loads)))
    if plan is packing.best_fit_plan:
        tokens = sum(n * c for n, c in histogram.items())
        assert len(loads) <= 11 / 9 * max(-(-tokens // capacity), sum(c for n, c in histogram.items() if n > 20)) + 1 or len(loads) <= 1.7 * tokens / capacity + 1


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 9), min_size=1, max_size=7), st.integers(1, 4))
def test_buckets_are_optimal(histogram, buckets):
    from itertools import combinations

    lengths = sorted(histogram)
    pad = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in histogram.items())
    got = packing.optimal_buckets(np.array(lengths), np.array([histogram[n] for n in lengths]), buckets)
    best = min(pad([*some, lengths[-1]]) for k in range(min(buckets, len(lengths))) for some in combinations(lengths[:-1], k))
    assert len(got) <= buckets and pad(got) == best


@pytest.mark.parametrize("plan", [packing.best_fit_plan, packing.bucket_plan])
def test_packing_whole_documents(spark, plan):
    rng = random.Random(8)
    texts = [None, "", "a"] + ["word " * rng.choice([1, 2, 3, 3, 3, 9, 17, 40, 300]) for _ in range(200)] + ["<|endoftext|> ünïcode ты"]
    containers = spark.createDataFrame([("small", 16), ("big", 64), ("big", 64), ("big", 90), ("none", 0)], "container_kind string, capacity_tokens int")
    counts = packing.token_counts(docs_df(spark, texts))
    n_tokens = {r.doc_id: r.n_tokens for r in counts.collect()}
    assert len(n_tokens) == len(texts) - 1 and n_tokens[1] == 0 and n_tokens[2] == 1
    rows = packing.pack(counts, containers, plan).collect()
    for kind, cap in (("small", 16), ("big", 64)):
        mine = [r for r in rows if r.container_kind == kind]
        loads, docs = {}, {}
        for r in mine:
            loads[r.container_id] = loads.get(r.container_id, 0) + r.n_tokens
            docs.setdefault(r.doc_id, []).append((r.piece, r.start_token, r.n_tokens))
        assert set(docs) == set(n_tokens) and all(v <= cap for v in loads.values())
        for d, parts in docs.items():
            parts.sort()
            assert sum(p[2] for p in parts) == n_tokens[d] and len(parts) == max(1, -(-n_tokens[d] // cap))
            assert [p[1] for p in parts] == [i * cap for i in range(len(parts))]
        report = {r.container_kind: r for r in packing.fill_report(packing.pack(counts, containers, plan), containers).collect()}
        assert abs(report[kind].fill - sum(n_tokens.values()) / (report[kind].containers * cap)) < 1e-9
    assert {r.container_kind for r in rows} == {"small", "big"}
    again = packing.pack(counts, containers, plan).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert packing.pack(counts.limit(0), containers, plan).count() == 0
    assert packing.pack(counts, containers.limit(0), plan).count() == 0


def test_tokens_agree_with_the_other_library(spark):
    from tokenizers import Tokenizer

    texts = ["Hello  world\n\n x=1;", "naïve ты été — 12345", "\tdef f(x):\n    return x", "can't we'll"]
    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(docs_df(spark, texts)).collect()}
    assert [got[i] for i in range(4)] == [len(other.encode(t, add_special_tokens=False).ids) for t in texts]
    assert F.lit(1) is not None
