"""Token ids, packing and spam."""

import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import DATA, rows
from vitrail.llm import bpe, packing, spam
from vitrail.sources.tables import read_table


@pytest.fixture(scope="module")
def encoders():
    import tiktoken

    with open(bpe.DEFAULT_VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.load(), tiktoken.Encoding("own", pat_str=bpe.public_pattern(), mergeable_ranks=ranks, special_tokens={})


FIXED = ["", " ", "\n\n \t x", "a" * 30_000, " " * 5000 + "x", "日本語" * 999, "<|endoftext|>", "it's I'LL 123abc", "é​﻿", "\U0001f469‍\U0001f469"]


@pytest.mark.parametrize("text", FIXED)
def test_ids_of_fixed_texts(encoders, text):
    mine, public = encoders
    assert mine.encode(text).tolist() == public.encode_ordinary(text)
    assert mine.count(text) == len(public.encode_ordinary(text))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    import tiktoken

    mine = bpe.load()
    public = tiktoken.Encoding("own", pat_str=bpe.public_pattern(), mergeable_ranks=mine.ranks, special_tokens={}) if not hasattr(test_ids_of_any_text, "e") else test_ids_of_any_text.e
    test_ids_of_any_text.e = public
    ids = mine.encode(text).tolist()
    assert ids == public.encode_ordinary(text)
    assert public.decode_bytes(ids).decode() == text


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.probe(keys).tolist()) == list(range(5000))
    assert sorted(bpe.PerfectHash([b"a"]).probe([b"a"])) == [0]


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 50)
    e = bpe.load()
    want = [e.encode(f"word{i} other{i}").tolist() for i in range(200)]
    assert len(e.memo) < 100
    assert want == [e.encode(f"word{i} other{i}").tolist() for i in range(200)]


def test_encode_table(spark, encoders):
    _, public = encoders
    df = spark.createDataFrame([(1, "Hello you", "x"), (1, "Hello you", "x"), (2, None, "y"), (3, "", "z"), (4, "  ", "z"), (None, "a", "")], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in bpe.encode_corpus(df).collect()]
    want = [(1, public.encode_ordinary("Hello you"))] * 2 + [(2, []), (3, []), (4, public.encode_ordinary("  ")), (None, public.encode_ordinary("a"))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_corpus_round_trip(spark, encoders):
    _, public = encoders
    docs = read_table(spark, DATA, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode_corpus(docs).collect():
        assert public.decode_bytes(list(r.ids)).decode() == (texts[r.doc_id] or "")


# Packing


def packed_rows(spark, items, capacity, **kw):
    df = spark.createDataFrame(items, "item_id bigint, source string, copy bigint, size bigint")
    budgets = spark.createDataFrame([(1, capacity), (2, None), (3, 0)], "budget_id int, capacity int")
    return packing.pack(df, budgets, **kw).collect()


def check(got, items, capacity):
    used, parts = {}, {}
    for r in got:
        assert r.budget_id == 1 and r.n_tokens > 0
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        parts.setdefault(r.item_id, []).append((r.first_token, r.n_tokens, r.piece))
    assert all(u <= capacity for u in used.values())
    for i, _, _, size in items:
        if not size:
            assert i not in parts
            continue
        p = sorted(parts[i])
        assert p[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(p, p[1:])) and p[-1][0] + p[-1][1] == size
        assert [x[2] for x in p] == list(range(1, len(p) + 1))
        assert len(p) == -(-size // capacity)  # cut only where it must be
    return used


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(1)
    items = [(i, rng.choice("abc"), i, int(rng.expovariate(1 / 90)) + 1) for i in range(3000)] + [(9000, None, None, None), (9001, "a", 9, 0)]
    used = check(packed_rows(spark, items, 256), items, 256)
    total = sum(s or 0 for *_, s in items)
    assert len(used) <= 1.01 * -(-total // 256)
    used = check(packed_rows(spark, items, 256, shard_items=500), items, 256)
    assert len(used) <= 1.03 * -(-total // 256)


def test_copies_are_kept_apart_unless_they_are_too_many(spark):
    items = [(i, "s", i // 3, 10 + (i // 3) % 40) for i in range(900)]
    got = packed_rows(spark, items, 200)
    seen = set()
    for r in got:
        key = (r.container_id, r.item_id // 3)
        assert key not in seen
        seen.add(key)
    hot = [(i, "s", 7, 10) for i in range(500)] + [(1000 + i, "t", 1000 + i, 10) for i in range(500)]
    used = check(packed_rows(spark, hot, 200), hot, 200)
    assert len(used) <= 51


def test_copies_of_other_sizes_are_kept_apart():
    """A class whose copies differ in size comes in several runs, between which other classes are packed."""
    items = sorted([(10 + i % 40, c, 0) for c in range(60) for i in range(c, c + 15)] + [(20 + i % 30, 100 + i, 1) for i in range(300)], key=lambda x: (-x[0], x[1]))
    at = packing.best_fit(*(list(c) for c in zip(*items)), 200)
    assert len({(b, c) for b, (_, c, _) in zip(at, items)}) == len(items)
    room = {}
    for b, (size, *_) in zip(at, items):
        room[b] = room.get(b, 0) + size
    assert max(room.values()) <= 200


def test_slack_bounds_what_keeping_copies_apart_costs(spark):
    items = [(i, "s", i, 197) for i in range(100)] + [(1000 + i, "s", 1000, 3) for i in range(100)] + [(2000 + i, "s", 2000 + i // 30, 1) for i in range(90)]
    assert len(check(packed_rows(spark, items, 200), items, 200)) > 110
    used = check(packed_rows(spark, items, 200, slack=0.01), items, 200)
    assert len(used) <= 102


def test_packing_edges(spark):
    assert packed_rows(spark, [], 100) == []
    df = spark.createDataFrame([(1, "a", 1, 5)], "item_id bigint, source string, copy bigint, size bigint")
    assert packing.pack(df, spark.createDataFrame([], "budget_id int, capacity int")).count() == 0
    items = [(1, None, None, 1_000_003)]
    check(packed_rows(spark, items, 256), items, 256)


def test_pack_documents(spark):
    docs, budgets = read_table(spark, DATA, "documents"), read_table(spark, DATA, "token_budgets")
    packed = packing.pack_documents(docs, budgets)
    lower = {r.budget_id: -(-r.n_tokens // r.capacity) for r in packing.unused_room(packed, budgets).collect()}
    for r in packing.unused_room(packed, budgets).collect():
        assert r.n_containers <= lower[r.budget_id] * 1.1 + 1
    with_text = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "one two", None)], "doc_id bigint, text string, source string")
    assert {r.doc_id for r in packing.pack_documents(with_text, budgets).collect()} == {3}


# Spam

PROSE = "The search still lists its old path until the next rescan. Near the door the stone turns dense; further south it is thin again. Her notes describe a hand-cut floor with four cracks and she says that it was wet. "
SPAM = {
    "keywords": "buy granite tiles cheap granite tiles online granite tiles discount granite tiles sale granite tiles price granite tiles best granite tiles " * 4,
    "places": " • ".join(f"wallpaper in {x}" for x in ("Silri", "Norfen", "Orben", "Tamnor", "Linlin", "Huldra", "Jytes", "Vellemor", "Kaor", "Marben")),
    "links": " | ".join(f"https://shop{i}.example/a/b-{i}.html" for i in range(30)),
    "markup": " ".join(f'<a href="https://x{i}.example/">wall panels</a>' for i in range(20)),
    "tags": " ".join(f"#tag{i}" for i in range(40)),
    "codes": "\n".join(f"SKU {i}71 granite {i}x{i + 3} 12,{i} EUR" for i in range(20)),
}


def described(text, words=frozenset("the a of and in is by with from it at to was on for its until near that her she still old".split())):
    language, n, features = spam.describe([text], spam.Vocabulary({"*": words, "en": words}))
    return int(n[0]), features[0]


@pytest.mark.parametrize("name", SPAM)
def test_spam_is_strung(name):
    assert described(SPAM[name])[1][0] > 0.5
    assert described(PROSE * 20 + SPAM[name][:60])[1][0] < 0.3 and described(PROSE)[1][0] < 0.3


def test_texts_of_a_batch_do_not_touch_each_other():
    texts = [PROSE, *SPAM.values(), None, "", "  ", "!!!", PROSE + SPAM[next(iter(SPAM))], "x", "x y x y"]
    words = frozenset("the a of and in is".split())
    known = spam.Vocabulary({"*": words, "en": words})
    language, n, features = spam.describe(texts, known)
    for k, text in enumerate(texts):
        one = spam.describe([text], spam.Vocabulary({"*": words, "en": words}))
        assert (language[k], n[k]) == (one[0][0], one[1][0]) and features[k] == pytest.approx(one[2][0], abs=1e-9)
    assert n[texts.index(None)] == n[texts.index("")] == n[texts.index("!!!")] == 0
    assert features[-1][5] == 0.5 and features[-1][8] == pytest.approx(2 / 3)


def test_lookalikes_and_invisible_characters():
    plain = described(PROSE)
    for changed in (PROSE.replace("the", "t\u200bhe"), PROSE.replace("the", "th\u0435")):
        got = described(changed)
        assert got[0] == plain[0] and got[1].tolist() == pytest.approx(plain[1].tolist())


def test_function_words_are_learned_in_any_language(spark):
    """Of an invented language: words that all pages share evenly are function words, words in bursts on as many pages are not."""
    rng = random.Random(5)
    small, topics = ["ka", "mo", "ti", "ru", "se"], [f"topic{x}" for x in "abcdefghij"]
    pages = []
    for i in range(400):
        words = [w for _ in range(30) for w in (rng.choice(small), f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}q")]
        if i % 3 == 0:
            words += [rng.choice(topics)] * 25
        pages.append((" ".join(words), "xx"))
    learned = spam.function_words(spark.createDataFrame([*pages, (None, "xx"), ("", None), ("ka mo", "zz")], "t string, l string"))
    assert set(small) <= learned["xx"] and not set(topics) & learned["xx"] and "zz" not in learned
    assert set(small) <= learned["*"]


def test_short_texts_need_more_to_be_outliers():
    import numpy as np

    x, zero = np.array([[0.9, 0.7, 0, 0, 0, 0, 0, 0, 0.0]] * 2), np.zeros(9)
    off, (near, far) = spam.deviations(x, np.array([7, 500]), zero, np.eye(9) * 0.01, {2: (zero + 0.1, zero + 0.1), 8: (zero + 0.5, zero + 0.01)})
    assert off.tolist() == x.tolist()
    assert near < spam.OUTLIER < far


@pytest.mark.parametrize("with_labels", [True, False])
def test_find_spam(spark, with_labels):
    rng = random.Random(2)
    sentences = [s.strip() + "." for s in PROSE.split(".") if s.strip()]
    pages = [(i, " ".join(rng.choices(sentences, k=rng.randint(2, 9))), "en") for i in range(300)]
    bad = [(1000 + i, rng.choice(list(SPAM.values()))[: rng.randint(150, 400)], "en") for i in range(40)]
    other = [(2000, None, None), (2001, "", "xx"), (2002, "   ", None)]
    docs = spark.createDataFrame([(*r, "s") for r in pages + bad + other + bad[:1]], "doc_id bigint, text string, lang string, score string")
    labels = [(i, "r", int(i >= 1000)) for i in [*range(60), *range(1000, 1020)]] if with_labels else []
    found = [r.doc_id for r in spam.find_spam(docs, spark.createDataFrame(labels, "doc_id bigint, rater string, spam_label int")).collect()]
    assert set(found) == {i for i, *_ in bad} and found.count(bad[0][0]) == 2


def test_find_spam_on_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, rater string, spam_label int")
    assert rows(spam.find_spam(docs, labels)) == []


def test_conflicts_send_the_search_on():
    """A tighter container that holds the class, or enough of the source, is passed over for one of more room."""
    at = packing.best_fit([60, 50, 40], [1, 2, 1], [0, 1, 2], 100)
    assert at == [0, 1, 1]  # the copy doesn't go to the tightest container, that of the other copy
    at = packing.best_fit([60, 55, 10, 10, 10], [1, 2, 3, 4, 5], [0, 1, 0, 0, 0], 100)
    assert at == [0, 1, 0, 0, 1]  # with the fourth item the source is past its share of the first container
