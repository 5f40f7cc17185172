"""Language identification, BPE, n-gram scoring and mixing against independent versions."""

import hashlib
import json
import math
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm import bpe, langid, mixing, ngram, queries
from panelwright.llm.eliasfano import EliasFano


def documents(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


# ---------------------------------------------------------------- language identification


def slow_grams(text):
    found = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        w = f"_{word}_"
        found.update(word)
        found.update(w[i : i + 2] for i in range(len(w) - 1))
        found.update(w[i : i + 3] for i in range(len(w) - 2))
    return found


def code(gram):
    c = 0
    for ch in gram:
        c = c << 21 | (1 if ch == "_" else ord(ch) + 1)
    return c


def test_language_matches_slow_profiles(spark, sf):
    docs = documents(sf)
    size = 60
    train = defaultdict(Counter)
    for d in docs:
        if zlib.crc32(str(d["doc_id"]).encode()) % 5:
            train[d["lang"]].update(slow_grams(d["text"]))
    rank = lambda counts: {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:size])}
    profiles = {k: rank(v) for k, v in train.items()}
    got = {r.doc_id: r for r in langid.identify(spark.read.parquet(f"{sf}/documents.parquet"), size).collect()}
    for d in docs[:60]:
        own = rank(slow_grams(d["text"]))
        away = {k: sum(abs(r - p[g]) if g in p else size for g, r in own.items()) for k, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        r = got[d["doc_id"]]
        assert r.lang_pred == best and abs(r.score - (1 - away[best] / (size * len(own)))) < 1e-9
        assert r.held_out == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0)


def test_language_accuracy_held_out(spark, sf):
    lang = {d["doc_id"]: d["lang"] for d in documents(sf)}
    rows = [r for r in langid.identify(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en", 1), (2, None, "en", 1), (3, "", "fr", 1), (4, "12 34 !?", None, 1), (None, "le chat", "fr", 1), (6, "le chien et le chat", "fr", 1), (7, "x" * 50000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 4))
    assert by[None].held_out and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(df.limit(0)).collect() == []
    unlearnt = langid.identify(df.withColumn("lang", df["lang"].substr(1, 0)).withColumn("lang", df["text"].substr(0, 0)).selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in unlearnt.collect()} == {"und"}


def test_language_of_kept_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "the cat", "en", 0.5, "x"), (2, "le chat", "fr", 0.5, "x")], "doc_id long, text string, lang string, score double, lang_pred string")
    profiles = langid.fit(df)
    out = langid.predict(df, profiles, keep=("score", "doc_id", "text", "lang_pred", "lang"))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert [(r.text, r.lang_pred) for r in out.orderBy("doc_id").collect()] == [("the cat", "en"), ("le chat", "fr")]
    assert langid.predict(df, profiles, keep=()).columns == ["lang_pred", "score"]


def test_many_languages_share_one_index(spark):
    """Profiles hold what each language has only, so their size is that of the profiles and not codes times languages."""
    letters = [chr(0x4E00 + k) for k in range(1500)]
    df = spark.createDataFrame([(i, c * 3, f"l{i}") for i, c in enumerate(letters)], "doc_id long, text string, lang string")
    profiles = langid.fit(df)
    assert len(profiles.langs) == 1500 and len(profiles.ranks) == len(profiles.owners) == profiles.starts[-1] < 1500 * 12
    assert [profiles.predict(c) [0] for c in letters[:50]] == [f"l{i}" for i in range(50)]


def test_pieces_count_like_the_whole(monkeypatch):
    text = "ab cde f " * 40 + "y" * 100 + " z"
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "CHUNK", 32)
    parts = langid.gram_counts(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


# ---------------------------------------------------------------- BPE

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.SpeculativeBpe(PATH)


def same(codec, texts):
    ids, bounds = codec.encode(texts)
    for k, e in enumerate(codec.library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        own = ids[bounds[k] : bounds[k + 1]].tolist()
        assert own == e.ids, texts[k]
        assert codec.decode(own) == codec.library.decode(e.ids, skip_special_tokens=False)


def test_bpe_matches_the_library(codec, sf):
    same(codec, [d["text"] for d in documents(sf)])
    same(codec, [None, "", " \n", "a<|endoftext|>B <|startoftext|>", "don't WE'LL 'S ½² x_y z__", "Σας ΑΣ İ é 日本語 𝔘", "a\x1cb\x85c​d", "ha" * 3000, "q" * 999, "'" * 50])


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_matches_the_library_on_any_text(text):
    same(bpe.codec(PATH), [text])


def test_bpe_memory_is_emptied(codec, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    same(codec, ["one two three four five six seven"])
    same(codec, ["eight nine one two"])


def test_bpe_proposals_are_mostly_accepted_and_others_merged(codec):
    words = [w + bpe._END for w in ("the", "reading", "retitioning", "ndernt", "xqzjk")]
    for w in words:
        assert codec.merge(w) == codec._merge_long([codec.vocab[c] for c in [*w[:-2], w[-2:]]])


def test_bpe_on_tables(spark):
    df = spark.createDataFrame([(1, "Hello World", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello World", "x")], "doc_id long, text string, ids string")
    out = bpe.encode(df.drop("ids"), PATH, decoded=True).collect()
    assert [r.decoded for r in out] == ["hello</w> world</w>", "", "", "hello</w> world</w>"]
    again = bpe.decode(bpe.encode(df.drop("ids"), PATH), PATH).collect()
    assert [r.decoded for r in again] == [r.decoded for r in out]
    assert bpe.encode(df.drop("ids").limit(0), PATH).collect() == []
    kept = bpe.encode(df.withColumn("decoded", df["ids"]), PATH, keep=("doc_id", "ids", "decoded", "text"))
    assert kept.columns == ["doc_id", "decoded", "text", "ids"]
    twice = bpe.decode(kept, PATH)
    assert twice.columns == ["doc_id", "text", "ids", "decoded"] and [r.decoded for r in twice.collect()] == [r.decoded for r in out]


def test_other_vocabulary_files(tmp_path):
    """Another byte-level file is split by its own rules; one that needs more is refused."""
    other = bpe.SpeculativeBpe(public_tokenizers.path("byte_bpe_50k.json"))
    same(other, ["Hello World, it's  a test\n\n x", " lead", "naïve 日本語 \U0001d518", None, "don't<|endoftext|>STOP", "12345 67 \t", "q" * 400])
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"unk_token": "<unk>"}, {"type": "WordPiece"}, {"byte_fallback": True}):
        with pytest.raises(ValueError):
            bpe.check(spec | {"model": spec["model"] | change})
    with pytest.raises(ValueError):
        bpe.check(spec | {"pre_tokenizer": {"type": "Whitespace"}})


# ---------------------------------------------------------------- n-gram scoring


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300), st.lists(st.integers(0, 1 << 41), min_size=1, max_size=50))
def test_elias_fano(values, wanted):
    v = np.sort(np.array(values, np.uint64))
    ef = EliasFano.build(v)
    assert ef.get(np.arange(len(v))).tolist() == v.tolist()
    x = np.array(wanted + [int(t) for t in v[:20]], np.uint64)
    assert ef.successor(x).tolist() == np.searchsorted(v, x).tolist()
    found = ef.find(x)
    assert (found >= 0).tolist() == np.isin(x, v).tolist() and v[found[found >= 0]].tolist() == x[found >= 0].tolist()
    pairs = ef.get_pairs(np.arange(max(len(v) - 1, 0)))
    assert pairs[0].tolist() == v[:-1].tolist() and pairs[1].tolist() == v[1:].tolist()


def slow_scores(texts, learnt, order, d):
    """(tokens, known tokens, base, score) by text, and the number of training tokens, from counts of tuples of words."""
    words = {i: (t or "").encode().lower().split() + [b"</s>"] for i, t in texts.items()}
    counts, kinds, follow = Counter(), Counter(), Counter()
    uni = Counter()
    for i in learnt:
        uni.update(words[i])
        for k, w in enumerate(words[i]):
            for n in range(1, order):
                h = tuple(words[i][k - n : k]) if k >= n else (b"<s>",) if n == 1 else None
                if h:
                    kinds[h] += (h, w) not in counts
                    counts[h, w] += 1
                    follow[h] += 1
    n, v = sum(uni.values()), len(uni)

    def p(h, w):
        if not h:
            return (uni[w] + 1) / (n + v + 1)
        low = p(h[1:], w)
        return (max(counts[h, w] - d, 0) + d * kinds[h] * low) / follow[h] if follow[h] else low

    out = {}
    for i, ws in words.items():
        full = sum(math.log10(p(tuple(ws[max(0, k - order + 1) : k]) if k or order == 1 else (b"<s>",), w)) for k, w in enumerate(ws))
        out[i] = len(ws), sum(w in uni for w in ws), sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ws), full
    return out, n


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_scores_match_a_slow_model(spark, order, sf, monkeypatch):
    monkeypatch.setattr(ngram, "SHARD", 2000)  # more shards than partitions
    texts = {d["doc_id"]: d["text"] for d in documents(sf) if order == ngram.ORDER or d["doc_id"] % 4 == 0}
    out = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    want, total = slow_scores(texts, [i for i in texts if i not in out], order, ngram.DISCOUNT)
    for r in ngram.score_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), order).collect():
        n, known, base, full = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, r.doc_id in out)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - full) < 2e-4 * order * n


def test_a_token_probability_is_a_distribution(spark):
    """Over all words, the end and one unknown word, the probabilities after any context sum to one."""
    df = spark.createDataFrame([(1, "a b a b c"), (3, "b a c a b a"), (4, "c"), (5, "")], "doc_id long, text string")
    trie = ngram.fit(df)
    one = lambda text: {r.doc_id: r.score for r in ngram.score(spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string"), trie).collect()}
    context = "a b"
    texts = [f"{context} {w}" for w in ("a", "b", "c", "zzz")]
    whole = one([context, *texts])
    # p(text end) cancels: compare the text with its continuation, both before their ends
    h = {t: ngram.token_hashes([t]) for t in texts}
    total = 0.0
    for t, (x, bounds) in h.items():
        ids, _, logs = trie.words.look_up(x)
        total += 10 ** trie.walk(ids, logs, bounds)[0][-2]
    x, bounds = ngram.token_hashes([context])
    ids, _, logs = trie.words.look_up(x)
    total += 10 ** trie.walk(ids, logs, bounds)[0][-1]
    assert abs(total - 1) < 2e-3 and all(v < 0 for v in whole.values())


def test_elias_fano_passes_long_gaps_in_a_few_steps():
    """Sequences with long runs of zeros (a parent of many successors) and of ones; steps don't grow with a run."""
    n, steps = 200_000, 0
    values = np.concatenate([np.zeros(n), np.full(n, 3 * n), np.arange(5) * n + 4 * n]).astype(np.uint64)
    coded = EliasFano.build(values)

    def count(frame, event, arg):
        nonlocal steps
        steps += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        at = np.array([0, n - 2, n - 1, n, 2 * n - 1, 2 * n, len(values) - 2])
        x, y = coded.get_pairs(at)
        found = coded.find(np.array([0, 1, 3 * n, 3 * n + 1, 4 * n, 8 * n, 9 * n], np.uint64))
    finally:
        sys.settrace(before)
    assert (x == values[at]).all() and (y == values[at + 1]).all()
    assert found.tolist() == [0, -1, n, -1, 2 * n, len(values) - 1, -1]
    assert steps < 1500


def test_merged_counts_of_sorted_parts_are_those_of_all():
    r = np.random.default_rng(5)
    held, want = ngram.Grams(), Counter()
    for _ in range(6):
        a, b = r.integers(0, 40, 300, np.uint64), r.integers(0, 40, 300, np.uint64)
        want.update(zip(a.tolist(), b.tolist(), strict=True))
        held.add(a, b, (a * np.uint64(40) + b).astype(np.uint16))
    a, b, low, n = held.merge()
    assert list(zip(a.tolist(), b.tolist(), n.tolist(), strict=True)) == [(*k, c) for k, c in sorted(want.items())]
    assert (low == a * 40 + b).all()


def test_grams_sort_alike_packed_or_not():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 50, 500, np.uint64), r.integers(0, 50, 500, np.uint64)
    for up in (0, 58):  # packed into 64 bits, or not
        order, first = ngram.ordered(a << np.uint64(up), b)
        assert list(zip(a[order[first]].tolist(), b[order[first]].tolist())) == sorted(set(zip(a.tolist(), b.tolist())))


def test_scoring_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a b a b", 5), (4, "a b", 5), (4, "a b", 5)], "doc_id long, text string, score long")
    got = ngram.score_documents(df).collect()
    assert len(got) == 5 and all(r.n_tokens >= 1 and r.score <= 0 for r in got)
    assert ngram.score_documents(df.limit(0)).collect() == []
    alone = ngram.score_documents(df.where("doc_id is null")).collect()[0]
    assert (alone.train_tokens, alone.score, alone.held_out) == (0, 0.0, True)


def test_very_long_texts_are_scored_whole(spark, monkeypatch):
    """A text beyond every batch and segment; its tokens are those of slow counting."""
    monkeypatch.setattr(ngram, "TEXTS", 1 << 16)
    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.7)) % 5000}" for _ in range(120_000)]
    texts = {1: " ".join(words), 3: " ".join(words[:500]), 4: "x" * 300_000, 5: "w1 w2"}
    want, total = slow_scores(texts, [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2], ngram.ORDER, ngram.DISCOUNT)
    got = {x.doc_id: x for x in ngram.score_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, (n, known, base, full) in want.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
        assert abs(got[i].base_score - base) < 1e-9 * abs(base) + 1e-9 and abs(got[i].score - full) < 2e-4 * ngram.ORDER * n


def test_counter_merges():
    r = random.Random(1)
    want, c = Counter(), ngram.Counter()
    for _ in range(50):
        keys = [r.randrange(40) for _ in range(r.randrange(30))]
        want.update(keys)
        c.add(np.array(keys, np.uint64))
        if r.random() < 0.2:
            c.merge()
    c.merge()
    assert dict(zip(c.keys.tolist(), c.counts.tolist())) == dict(want)


# ---------------------------------------------------------------- mixing


def test_mixing_matches_sql(spark, sf, duck, rows_of):
    assert rows_of(queries.op5_poisson_mixing(spark, sf)) == rows_of(duck.sql(mixing.oracle()).df())


def test_mixing_reaches_targets(spark):
    rows = spark.range(20000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('s', id % 5) end as source", "'t' as text", "7 as copy")
    targets = {"hot": 1.0, "s1": 2.0, None: 1.0}
    out = mixing.replicate(rows, targets)
    got = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    total = sum(got.values())
    assert set(got) == set(targets) and abs(total - 20000) < 700
    assert all(abs(got[k] / total - w / 4) < 0.02 for k, w in targets.items())
    assert out.columns == ["doc_id", "source", "text", "copy", "shuffle_key"]


def test_mixing_draws_high_rates(spark, tmp_path):
    spark.range(60000).selectExpr("id as doc_id", "case when id % 1500 = 0 then 'rare' else 'rest' end as source").write.parquet(f"{tmp_path}/docs")
    rows = spark.read.parquet(f"{tmp_path}/docs")
    for weight in (1.0, 0.48, 0.46):  # on both sides of a mean that one draw can have
        rate = 1500 * weight
        out = mixing.replicate(rows, {"rare": weight, "rest": 1 - weight}).toPandas()
        k = out[out.source == "rare"].groupby("doc_id").size().to_numpy()
        assert len(k) == 40 and abs(k.mean() - rate) < 4 * math.sqrt(rate / 40) and 0.4 < k.var() / rate < 2


def test_mixing_takes_columns_of_any_name(spark):
    names = ["steps", "rate", "source_key", "draws", "u", "k", "id", "of", "doc", "mean", "n", "w"]
    rows = spark.range(300).selectExpr("id as doc_id", "concat('s', id % 3) as source", "'t' as text", *[f"cast({i} as int) as {c}" for i, c in enumerate(names)])
    out = mixing.replicate(rows, temperature=1.0)
    assert out.columns == [*rows.columns, "copy", "shuffle_key"]
    got = out.drop("copy", "shuffle_key").distinct()
    assert got.exceptAll(rows).isEmpty() and got.count() > 150


def test_mixing_of_many_high_rates_matches_sql(spark, duck, rows_of):
    """The SQL's terms come from log-gamma, and it splits high rates as well."""
    rows = spark.range(30000).selectExpr("id as doc_id", "case when id = 7 then 'one' when id < 40 then 'few' else 'rest' end as source", "'t' as text", "cast(null as string) as lang", "1 as n_chars")
    duck.sql("create or replace temp view many as select range as doc_id, 't' as text, null::varchar as lang, case when range = 7 then 'one' when range < 40 then 'few' else 'rest' end as source, 1 as n_chars from range(30000)")
    got = mixing.replicate(rows, temperature=0.05).groupBy("source", "doc_id").count().where("source <> 'rest'").toPandas()
    want = duck.sql(f"select source, doc_id, count(*) as \"count\" from ({mixing.oracle(0.05, docs='many')}) where source <> 'rest' group by all").df()
    assert rows_of(got) == rows_of(want) and got[got.source == "one"]["count"].iloc[0] > 5000


def test_mixing_edge_cases(spark):
    df = spark.createDataFrame([(None, None, None), (None, None, None), (1, "x", None)], "doc_id long, source string, text string")
    out = mixing.replicate(df, temperature=1.0).collect()
    assert all(r.copy >= 1 for r in out)
    assert mixing.replicate(df.limit(0)).collect() == []
    keys = [r.shuffle_key for r in mixing.replicate(spark.range(500).selectExpr("id doc_id", "'a' source", "'' text"), temperature=1.0).coalesce(1).collect()]
    assert len(set(keys)) > 400 and keys != sorted(keys, reverse=True)


def test_digest_columns(spark, sf):
    r = queries.op8_bpe_codec(spark, sf).where("doc_id = 0").collect()[0]
    text = next(d["text"] for d in documents(sf) if d["doc_id"] == 0)
    e = bpe.codec(PATH).library.encode(text, add_special_tokens=False)
    assert r.n_tokens == len(e.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
