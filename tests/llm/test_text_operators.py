"""Operators against plain versions on small tables and odd rows."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quietsignal.llm import chat, decontaminate, jaccard, katz, language, licenses, packing, pii, quality, winnow
from quietsignal.llm.common import alnum_words, crc_of_id, crc_of_id_py, space_words
from tests.llm.odd import LONG, TEXTS, documents, empty

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def sentences(n, seed, words=40, vocabulary=60):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(r.randrange(1, words)))


# 1 quality


def test_quality_learns_and_is_deterministic(spark):
    good = [(i, "A plain sentence about number %d, said calmly and well. It goes on a little." % i) for i in range(0, 60)]
    bad = [(i, "BUY!!! $$$ ### now *** %d $$$ &&& @@@" % i) for i in range(60, 90)]
    docs = documents(spark, good + bad + TEXTS)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (5, None), (3, 1), (3, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    again = quality.fit(docs.repartition(7), labels, F.lit(True))
    assert np.allclose(model.weights, again.weights)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all(scores[i] >= 0.5 for i in range(30, 60)) and all(scores[i] < 0.5 for i in range(60, 90))
    assert quality.score(docs, model).count() == len(good) + len(bad) + len(TEXTS)
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= set(range(30, 60))


@pytest.mark.parametrize("only", [0, 1])
def test_quality_of_one_class_or_nothing(spark, only):
    labels = spark.createDataFrame([(1, only)], "doc_id long, quality int")
    model = quality.fit(documents(spark), labels, F.lit(True))
    assert {r["score"] >= 0.5 for r in quality.score(documents(spark), model).collect()} == {bool(only)}
    nothing = quality.fit(empty(spark), labels, F.lit(True))
    assert quality.score(empty(spark), nothing).count() == 0


def test_quality_held_out_accuracy(spark):
    found = quality.op1_bradley_terry(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (found["predicted"] == found["quality"]).mean() > 0.95


# 2 packing


def check_packed(rows, docs, capacity=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        place = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == place and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[place : place + r["length"]].tobytes())
            place += r["length"]
        assert place == len(ids)
    padding = 0
    for own in by_sequence.values():
        place = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == place
            place += r["length"]
        assert place <= capacity
        padding += 0 if place & (place - 1) == 0 else capacity - place
    return padding / sum(r["length"] for r in rows)


def test_packing_round_trip(spark):
    docs = [(i, t) for i, t in {i: (i, t) for i, t in TEXTS if i is not None}.values()] + [(100 + i, sentences(i, i, 900, 5000)) for i in range(120)]
    rows = packing.pack(documents(spark, docs), PATH).collect()
    assert check_packed(rows, docs) < 0.05


def test_packing_odd_rows(spark):
    rows = packing.pack(documents(spark), PATH).collect()
    assert sum(r["start"] == 0 for r in rows) == len(TEXTS)
    assert packing.pack(empty(spark), PATH).count() == 0


@pytest.mark.parametrize("length", [1, 63, 64, 65, 1023, 1024, 1500, 2047, 2048, 2049, 9999])
def test_cut_keeps_every_token(length):
    parts = packing.cut(length, 2048, 64)
    assert sum(parts) == length and all(0 < p <= 2048 for p in parts)


# 3 personal data

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def fine(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if fine(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_base_spans(spark):
    hard = [
        (20, "x é😀 a@b.c%d@e.f.g.. 1.2.3.4.5.6.7.8 +1 (234) 567-8901 )( 4111 1111 1111 1111"),
        (21, "a.@b@c.d.e@f 999.1.1.1 0001.002.03.255 +12345678 +123456789 5-5 5--5 5555-5555-5555-4444."),
        (22, "12 - 34 4242424242424242 +44 20 7946 0958, 10.0.0.256 255.255.255.255"),
    ]
    docs = documents(spark, TEXTS + hard)
    rows = pii.extract(docs).select("doc_id", pii.spelled(F.col("base")).alias("b")).collect()
    want = sorted((str(i), plain_spans(t)) for i, t in TEXTS + hard)
    assert sorted((str(r["doc_id"]), r["b"]) for r in rows) == want
    assert pii.extract(empty(spark)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    seeds = [(i, f"please call me at +1 (30{i}) 555-12{i}{i}") for i in range(5)]
    docs = documents(spark, [*seeds, (30, "please call me at 555-123-4567 now"), (31, "lot number 555-123-4567 sold")])
    found = {r["doc_id"]: r["s"] for r in pii.extract(docs).select("doc_id", pii.spelled(F.col("spans")).alias("s")).collect()}
    assert found[30] == "phone:18:30" and found[31] == ""
    masked = {r["doc_id"]: r for r in pii.mask(docs).collect()}
    assert masked[30]["text"] == "please call me at <PHONE> now" and masked[30]["n_chars"] == len(masked[30]["text"])
    assert masked[31]["text"] == "lot number 555-123-4567 sold"
    assert pii.mask(docs).columns == docs.columns


# 4 decontamination


def plain_hits(text, items, width=10):
    words, hit, found = alnum_words(text), set(), set()
    for item, t in items:
        own = alnum_words(t)
        m = min(width, len(own))
        for i in range(len(own) - m + 1 if m else 0):
            for j in range(len(words) - m + 1):
                if words[j : j + m] == own[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(item)
    return len(words), len(hit), sorted(x for x in found if x is not None)


def test_hits_against_plain_search(spark):
    base = [sentences(0, s, 60, 12) for s in range(12)]
    items = [(k, t) for k, t in enumerate(base[:6])] + [(50, "w3"), (51, "w4 w5"), (52, None), (53, " ,. "), (None, "w1 w2 w3"), (54, base[0])]
    texts = [(100 + k, sentences(0, 90 + k, 200, 12) + " " + base[k % 6].upper() + ", " + base[(k + 1) % 12]) for k in range(30)] + TEXTS
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.hits(documents(spark, texts), bench).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in rows)
    assert got == sorted((str(i), *plain_hits(t, items)) for i, t in texts)
    nothing = decontaminate.hits(documents(spark, texts), bench.where("false")).collect()
    assert len(nothing) == len(texts) and not any(r["spans"] for r in nothing)
    assert decontaminate.hits(empty(spark), bench).count() == 0


def test_blocks_of_the_benchmark_agree(spark, monkeypatch):
    items = [(k, sentences(0, k, 30, 10)) for k in range(20)]
    texts = [(k, sentences(0, 50 + k, 100, 10) + " " + items[k % 20][1]) for k in range(25)]
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    read = lambda: sorted((r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in decontaminate.hits(docs, bench).collect())
    whole = read()
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (300,))
    assert read() == whole


def test_cleaning_cuts_only_hits(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    texts = [(1, f"Before it. {passage.upper()}! And after."), (2, passage), (3, "one two three four"), (4, None)]
    docs = documents(spark, texts)
    out = {r["doc_id"]: r for r in decontaminate.clean(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert out[1]["text"] == "Before it. \n! And after." and out[1]["n_chars"] == len(out[1]["text"])
    assert 2 not in out and out[3]["text"] == "one two three four" and out[4]["text"] is None


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 4, 400)
    text[rng.integers(0, 400, 60)] = 0
    text[-1] = 0
    index = decontaminate.FMIndex(text.astype(np.int64))
    for m in (1, 2, 3, 5):
        phrases = rng.integers(1, 4, (20, m))
        which, at = index.search(phrases.astype(np.int64))
        want = sorted((k, i) for k, p in enumerate(phrases) for i in range(400 - m + 1) if (text[i : i + m] == p).all())
        assert sorted(zip(which.tolist(), at.tolist(), strict=True)) == want


# 5 language model


def plain_katz(docs, held):
    from collections import Counter

    tokens = lambda t: [*space_words(t), None]
    train = [tokens(t) for i, t in docs if not held(i)]
    one, two = Counter(w for x in train for w in x), Counter((h, w) for x in train for h, w in zip(["<s>", *x[:-1]], x, strict=True))
    n, v = sum(one.values()), len(one)
    counts = lambda c: np.array([sum(1 for x in c.values() if x == r) for r in range(1, katz.K + 2)])
    d1, d2 = katz.discounts(counts(one)), katz.discounts(counts(two))
    keep = lambda d, r: d[min(r, katz.K + 1)] * r
    rest = 1 - sum(keep(d1, c) for c in one.values()) / n if n else 1.0
    p = lambda w: keep(d1, one[w]) / n if one[w] else rest
    total, kept, mass = Counter(), Counter(), Counter()
    for (h, w), r in two.items():
        total[h] += r
        kept[h] += keep(d2, r)
        mass[h] += p(w)

    def prob(h, w):
        if two[h, w]:
            return keep(d2, two[h, w]) / total[h]
        return (1 - kept[h] / total[h]) / (1 - mass[h]) * p(w) if total[h] else p(w)

    out = []
    for i, t in docs:
        x = tokens(t)
        out.append((i, len(x), sum(one[w] > 0 for w in x), n, sum(np.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), sum(np.log10(prob(h, w)) for h, w in zip(["<s>", *x[:-1]], x, strict=True))))
    return out, prob, one


def test_katz_against_plain_version(spark):
    docs = [(i, sentences(i, i, 60, 25)) for i in range(150)] + [t for t in TEXTS if t[0] not in (8, 10)] + [(200 + i, " ".join(["the"] * 30 + [f"u{i}"])) for i in range(20)]
    held = lambda i: crc_of_id_py(i) % 5 == 1
    rows = katz.score(documents(spark, docs).repartition(3), crc_of_id("doc_id") % 5 == 1, buckets=3).collect()
    want, _, _ = plain_katz(docs, held)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[5], 6))
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-8)
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows)


def test_katz_is_normalised():
    docs = [(i, sentences(i, i, 40, 12)) for i in range(60)]
    _, prob, one = plain_katz(docs, lambda i: False)
    for h in ["<s>", *[w for w in one if w is not None][:5]]:
        assert abs(sum(prob(h, w) for w in one) + prob(h, b"never seen") - 1) < 1e-9


def test_katz_without_rows(spark):
    assert katz.score(empty(spark), F.lit(False)).count() == 0
    rows = katz.score(documents(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows) == [(1, 0, 0), (3, 0, 0)]


def pairs_sent(spark, docs, slices, buckets):
    rows = documents(spark, docs).repartition(slices, "doc_id").select("doc_id", (crc_of_id("doc_id") % 5 != 1).alias("train"), "text")
    known = katz.unigrams(rows, buckets)
    return known, katz.sent(rows, known, buckets).toPandas().sort_values(["bucket", "kind", "slice"], kind="stable")


def test_katz_expands_a_partition_in_parts(spark):
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    known, frame = pairs_sent(spark, [(i, " ".join(vocabulary[rng.zipf(1.3, 2500) % 3000])) for i in range(320)], 16, 1)
    entries = sum(len(katz.unpack(b)[5]) for b in frame.loc[frame["kind"] == "pairs", "blob"])
    work = katz.by_token(known, 1)
    tracemalloc.start()
    work(frame)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert entries > 400_000 and peak < 60 * entries


def test_katz_memory_does_not_grow_with_documents():
    w, h = katz.spread(np.array([katz.END])), katz.spread(np.array([katz.START]))
    own, texts, peaks = np.arange(0, 2000, 40, dtype=np.uint32), 2000, []  # a partition meets few of the texts of each slice
    blob = katz.pack(w, np.array([1], np.uint32), h, np.array([0], np.uint16), np.array([len(own)], np.uint32), own, np.ones(len(own), np.uint32), np.ones(texts, np.uint8))
    for slices in (100, 500, 1000):  # first to import what is needed
        frame = pd.DataFrame({"bucket": 0, "slice": range(slices), "kind": "pairs", "blob": [blob] * slices})
        work = katz.by_token(katz.Unigrams(texts * slices, 1, np.zeros(6, np.int64), texts * slices, []), 1)
        tracemalloc.start()
        out = work(frame)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert all(katz.unpack(b)[2].sum() == len(own) for b in out.loc[out["kind"] == "docs", "blob"]) and (out["kind"] == "docs").sum() == slices
    assert peaks[2] - peaks[1] < 16 * 500 * texts  # bytes for each further text, most of which have no entry here


def test_katz_parts_do_not_change_results(spark):
    known, frame = pairs_sent(spark, [(i, sentences(i, i, 60, 25)) for i in range(150)] + [(200 + i, " ".join(["the"] * 30 + [f"u{i}"])) for i in range(20)], 6, 3)
    assert len(known.hot) and frame["slice"].nunique() > 3
    for _, own in frame.groupby("bucket"):
        whole, parts = katz.by_token(known, 3, 10**9)(own), katz.by_token(known, 3, 40)(own)
        key = ["kind", "key", "blob"]
        assert whole.fillna("")[key].sort_values(key[:2], kind="stable").values.tolist() == parts.fillna("")[key].sort_values(key[:2], kind="stable").values.tolist()


def test_slices_stand_together():
    sizes = [(1, 5), (1, 5), (2, 30), (2, 30), (3, 1), (4, 1), (5, 9), (6, 90)]
    assert list(katz.together(sizes, 10)) == [(0, 2), (2, 4), (4, 6), (6, 7), (7, 8)]
    assert list(katz.together(sizes, 10**9)) == [(0, 8)] and list(katz.together([], 10)) == []


def test_packed_arrays_round_trip():
    arrays = [np.array([], np.uint64), np.arange(5, dtype=np.uint32), np.array([1.5, -2.0]), np.array([3], np.uint8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, katz.unpack(katz.pack(*arrays)), strict=True))


# 6 fingerprints


def test_winnowing_keeps_the_rightmost_minimum(spark):
    words = [f"w{i % 7}" for i in range(60)]
    row = documents(spark, [(1, " ".join(words)), (2, "only three words"), (3, None), (4, " ".join(words))]).select("doc_id", winnow.selected(F.col("text")).alias("s")).collect()
    by = {r["doc_id"]: r["s"] for r in row}
    h = [r[0] & ((1 << winnow.WORD_BITS) - 1) for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    runs = [sum(x * pow(winnow.BASE, winnow.K - 1 - j, winnow.PRIME) for j, x in enumerate(h[i : i + winnow.K])) % winnow.PRIME for i in range(len(h) - winnow.K + 1)]
    want = []
    for i in range(len(runs) - winnow.WINDOW + 1):
        own = runs[i : i + winnow.WINDOW]
        at = i + max(j for j, x in enumerate(own) if x == min(own))
        if not want or want[-1] != (runs[at], at):
            want.append((runs[at], at))
    assert [(v >> 31, winnow.PLACES - 1 - (v & (winnow.PLACES - 1))) for v in by[1]] == want
    assert by[4] == by[1] and len(by[2]) == 1 and by[3] == []


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_each_row_gets_the_next_text(spark, buckets):
    texts = [(i * 7 % 101 - 30, f"text {i}") for i in range(101)]
    rows = {r["doc_id"]: r for r in winnow.with_next(documents(spark, texts), buckets).collect()}
    order = sorted(texts)
    assert len(rows) == 101
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        assert rows[i]["text"] == t and rows[i]["following"] == after


def test_next_of_odd_rows(spark):
    rows = winnow.with_next(documents(spark), 4).collect()
    want = sorted(((i, t or "") for i, t in TEXTS), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    pairs = [(a[1], b[1]) for a, b in zip(want, want[1:] + want[:1], strict=True)]
    assert sorted((r["text"], r["following"]) for r in rows) == sorted(pairs)
    assert winnow.with_next(empty(spark), 4).count() == 0
    assert winnow.with_next(documents(spark, [(5, "alone")]), 4).first()["following"] == "alone"


# 7 language


def test_languages(spark):
    en, de = "the cat sat on the mat and the dog was there with them ", "der hund und die katze sind nicht in dem haus und auch nicht "
    texts = [(i, (en if i % 2 else de) * (1 + i % 5)) for i in range(60)]
    docs = documents(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    model = language.fit(docs, F.col("doc_id") % 5 != 0)
    assert sorted(model) == ["de", "en"]
    rows = language.classify(docs, model).collect()
    assert all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") and 0.5 < r["score"] <= 1 for r in rows)
    odd = language.classify(documents(spark), model).collect()
    for r, (_, t) in zip(odd, TEXTS, strict=True):
        assert (r["lang_pred"] == "und") == (not t or not any(c.isalpha() for c in t)) and 0 <= r["score"] <= 1
    assert language.fit(empty(spark), F.lit(True)) == {} and language.classify(documents(spark), {}).first()["lang_pred"] == "und"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.op7_compression_language(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.95


# 8 chat

TALK = "conv_id long, turn long, role string, text string, segment string, position int"


def test_chat_reads_back(spark):
    turns = [(1, 0, "user", "hi <|end|> & <|assistant|>"), (1, 1, "assistant", "yo &lt; <b>"), (1, 2, None, None), (1, 3, "assistant", None), (1, 3, "assistant", "tie"), (2, 0, "assistant", "only"), (3, 5, "a|>b", "é😀"), (None, None, "user", "x"), (4, 0, "assistant", LONG)]
    rows = [(*t, "clash", 9) for t in turns]
    formatted = chat.format_turns(spark.createDataFrame(rows, TALK))
    got = {r["conv_id"]: r for r in chat.read_back(chat.expand(formatted)).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        said = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own) and got[conv]["loss_chars"] == len(said)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat.read_back(chat.expand(chat.format_turns(spark.createDataFrame([], TALK)))).count() == 0


def test_expanded_examples(spark):
    rows = [(1, 0, "user", "a", "", 0), (1, 1, "assistant", "b<", "", 0), (1, 2, "user", "c", "", 0), (1, 3, "assistant", "d", "", 0)]
    out = sorted(chat.written_out(chat.expand(chat.format_turns(spark.createDataFrame(rows, TALK)))).collect(), key=lambda r: r["position"])
    assert [r["formatted"][r["loss_start"] : r["loss_end"]] for r in out] == ["b&lt;", "d"]
    assert out[1]["formatted"].startswith(out[0]["formatted"])


# 9 near duplicates


def plain_components(texts):
    def shingles(t):
        w = space_words(t)
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets = {i: shingles(t) for i, t in texts if i is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 90 * (len(sets[a]) + len(sets[b]) - o):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed, families=5, copies=14):
    r = random.Random(seed)
    out = []
    for f in range(families):
        base = [f"v{r.randrange(300)}" for _ in range(r.choice([8, 12, 40, 120]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(r.randrange(3)):
                own[r.randrange(len(own))] = f"v{r.randrange(300)}"
            out.append((len(out) + 100 * f, " ".join(own)))
    return out


@pytest.mark.parametrize("block", [400, 5])
def test_groups_against_plain_join(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = near_copies(block) + [t for t in TEXTS if t[0] is not None and t[0] != 8]
    texts = [(i + 1000, t) for i, t in near_copies(1)] + texts
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(documents(spark, texts)).collect()}
    assert got == plain_components(list(dict(texts).items()))


def test_groups_without_broadcasts(spark, monkeypatch):
    """Above the switch rows are joined; the groups and the documents kept are the same."""
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    docs = documents(spark, near_copies(3) + [(i + 1000, t) for i, t in near_copies(4)])
    results = []
    for most in (jaccard.BROADCAST_ROWS, -1):
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", most)
        results.append([sorted(jaccard.groups(docs).collect()), sorted(r["doc_id"] for r in jaccard.one_of_each(docs).select("doc_id").collect())])
    assert results[0] == results[1]


def test_groups_of_odd_rows(spark):
    rows = jaccard.groups(documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows}
    assert by[6, 13] == 1 if (6, 13) in by else True
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0 and r["doc_id"] is not None)
    assert jaccard.groups(empty(spark)).count() == 0
    kept = jaccard.one_of_each(documents(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["1", "2", "3", "4", "5", "7", "8", "9", "10", "None", "None"])


def test_no_linked_pair_goes_without_a_shared_signature():
    rng = np.random.default_rng(1)
    sizes = jaccard.Sizes()
    for _ in range(1500):
        a = np.unique(jaccard.mixed(rng.integers(0, 1 << 60, int(rng.integers(1, 130))).astype(np.uint64)))
        b = a[rng.permutation(len(a))[int(rng.integers(0, len(a) // 10 + 1)) :]]
        b = np.unique(np.concatenate([b, jaccard.mixed(rng.integers(0, 1 << 60, int(rng.integers(0, len(a) // 20 + 1))).astype(np.uint64))]))
        o = len(np.intersect1d(a, b))
        if 100 * o >= 90 * (len(a) + len(b) - o) and not np.array_equal(a, b):
            assert len(np.intersect1d(jaccard.signatures(a, sizes), jaccard.signatures(b, sizes)))


def plain_groups(texts, n, near, of):
    sets = {}
    for i, t in texts:
        w = (t or "").lower().encode("utf-8", "surrogatepass").split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, min(len(w), 1)))}
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and (o := len(sets[a] & sets[b])) and of * o >= near * len(sets[a] | sets[b])]
    while changed := [(a, b) for a, b in links if least[a] != least[b]]:
        for a, b in changed:
            least[a] = least[b] = min(least[a], least[b])
    return {i: (len(sets[i]), least[i]) for i in sets}


@pytest.mark.parametrize("block", [400, 5])
def test_groups_of_the_stage_against_plain_join(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = near_copies(block) + [(i + 1000, t) for i, t in near_copies(1)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(documents(spark, texts), jaccard.STAGE).collect()}
    plain = plain_groups(texts, 5, 4, 5)
    assert got == plain
    assert any(c != i for i, (_, c) in plain.items())


def test_the_pipeline_drops_copies_alike_by_08_on_five_words(spark):
    import corpus_pipeline

    base = [f"v{i}" for i in range(104)]
    near = base[:50] + ["other"] + base[51:]  # 95 of 105 shingles of five words, 99 of 105 of three
    edited = [w + "x" * (i in (30, 70)) for i, w in enumerate(base)]  # 90 of 110 (0.82), and 96 of 108 (0.89)
    far = [w + "y" * (i in (20, 50, 80)) for i, w in enumerate(base)]  # 85 of 115 (0.74)
    docs = documents(spark, [(i, " ".join(w)) for i, w in enumerate([base, near, edited, far], 1)])
    assert {r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()} == {1, 4}


def test_no_pair_linked_by_the_stage_goes_without_a_shared_signature():
    rng = np.random.default_rng(2)
    sizes, linked = jaccard.Sizes(jaccard.STAGE), 0
    fresh = lambda n: jaccard.mixed(rng.integers(0, 1 << 60, int(n)).astype(np.uint64))
    for _ in range(3000):
        a = np.unique(fresh(rng.integers(1, 130)))
        b = a[rng.permutation(len(a))[int(rng.integers(0, len(a) // 5 + 1)) :]]
        b = np.unique(np.concatenate([b, fresh(rng.integers(0, len(a) // 5 + 1))]))
        o = len(np.intersect1d(a, b))
        if 5 * o >= 4 * (len(a) + len(b) - o) and not np.array_equal(a, b):
            linked += 1
            assert len(np.intersect1d(jaccard.signatures(a, sizes), jaccard.signatures(b, sizes)))
    assert linked > 1000


def test_sets_that_share_a_signature_by_chance_do_not_chain(spark):
    """Of sets that share one signature only those stay together that their sketches leave open."""
    rng = np.random.default_rng(3)
    fresh = lambda n: np.unique(jaccard.mixed(rng.integers(0, 1 << 60, n).astype(np.uint64)))
    sets = [fresh(100) for _ in range(140)]
    sets[21] = np.unique(np.concatenate([sets[20][:95], fresh(5)]))
    one = spark.createDataFrame([(i, len(h), bytearray(jaccard.sketch(h))) for i, h in enumerate(sets)], "node long, n_shingles long, sketch binary")
    # A chain of 40, then groups of 16 and 17 and 60: more than FEW are hung together unseen.
    sent = [(i, [i, i + 1]) for i in range(40)] + [(i, [1000 if i < 56 else 1001 if i < 73 else 1002]) for i in range(40, 133)]
    got = sorted(map(tuple, jaccard.gathered(spark.createDataFrame(sent, "node long, sigs array<long>"), one, jaccard.STAGE).collect()))
    assert jaccard.FEW == 16 and got == [(20, 20, 2), (21, 20, 2)] + [(i, 56, 17) for i in range(56, 73)] + [(i, 73, 60) for i in range(73, 133)]


def test_sketches_differ_in_no_more_bits_than_sets_in_elements():
    rng = np.random.default_rng(4)
    for n in (0, 1, 3, 64, 65, 500, 2000):
        a = np.unique(jaccard.mixed(rng.integers(0, 1 << 60, n).astype(np.uint64)))
        for cut in range(0, n, max(1, n // 10)):
            b = np.unique(np.concatenate([a[cut:], jaccard.mixed(rng.integers(0, 1 << 60, int(rng.integers(0, n + 1))).astype(np.uint64))]))
            assert jaccard.least_difference(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


# 10 licenses


def plain_licenses(text):
    words = lambda t: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w]
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    d, out = shingles(words(text)), {}
    for name, notice in licenses.TEMPLATES:
        own = shingles(words(notice))
        for p in (i for i, g in enumerate(d) if g in set(own)):
            a = max(0, p - len(own))
            share = len(set(own) & set(d[a : a + 2 * len(own) + 8])) / len(set(own))
            if share >= 0.8:
                out[name] = max(out.get(name, 0), share)
    return out


def test_licenses_against_plain_containment(spark):
    r = random.Random(4)
    texts = []
    for i, (_, notice) in enumerate(licenses.TEMPLATES):
        for j in (0, 1, 3):
            texts.append((100 * i + j, sentences(i, i, 90) + " " * j + notice + " more words here" * j))
        words = notice.split()
        words[r.randrange(len(words))] = "changed"
        texts.append((100 * i + 9, " ".join(words)))
    rows = licenses.scan(documents(spark, texts + TEXTS)).collect()
    for r_, (_, t) in zip(rows, texts + TEXTS, strict=True):
        assert {m["license"]: m["containment"] for m in r_["matches"]} == plain_licenses(t)
    assert licenses.scan(empty(spark)).count() == 0
    assert not any(r_["matches"] for r_ in licenses.scan(documents(spark), []).collect())
