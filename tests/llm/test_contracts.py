"""Whole queries and stages against plain versions: contracts, row identity, the pipeline."""

import hashlib
import math
import os
import random
import re
import tracemalloc
import weakref
from collections import defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quietsignal.llm import chat, common, components, decontaminate, jaccard, language, licenses, pii, quality, queries, winnow
from quietsignal.llm.common import crc_of_id_py
from tests.llm.odd import LONG, TEXTS, documents, empty
from tests.llm.test_text_operators import near_copies, plain_groups, plain_hits, plain_spans, sentences

SF = "/root/testdata/sf0.001"


# SQL of op4, op8 and op9


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, found = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    at = [found.columns.index(x) for x in names]
    assert sorted((tuple(r[x] for x in names) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)


# op1


def plain_features(text):
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n, words, lines = max(1, len(raw)), raw.split(), raw.split(b"\n")
    m = max(1, len(words))
    marks = [raw.count(bytes([b])) for b in range(33, 127) if not chr(b).isalnum()]
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    rates = [*marks, upper, sum(48 <= b <= 57 for b in raw), raw.count(b"\n"), sum(b >= 128 for b in raw), sum(marks)]
    kinds = len(set(words)) / m
    shape = [math.log1p(len(words)), kinds, kinds * math.log1p(len(words)), len(raw) / m / 10, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, len(set(lines)) / len(lines)]
    shape += [upper / max(1, upper + lower), sum(w.isalpha() for w in words) / m, sum(len(w) <= 3 for w in words) / m, max((len(w) for w in words), default=0) ** 0.5 / 10]
    return [math.log1p(1000 * r / n) for r in rates] + shape


def test_quality_query_against_plain_scores(spark):
    """Scores of op1 follow from its fitted weights, and these minimise the pairwise logistic loss."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model = quality.fit(docs, labels, usable)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.op1_bradley_terry(spark, SF).collect():
        z = sum(w * max(-8, min(8, (x - m) / s)) for w, x, m, s in zip(model.weights, plain_features(texts[r["doc_id"]]), model.mean, model.scale, strict=True)) - model.threshold
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (crc_of_id_py(r["doc_id"]) % 3 == 1)
    own = [(plain_features(texts[r["doc_id"]]), r["quality"]) for r in labels.collect() if r["quality"] is not None and r["doc_id"] in texts and crc_of_id_py(r["doc_id"]) % 3 != 1]
    scaled = lambda y: np.array([[max(-8, min(8, (x - m) / s)) for x, m, s in zip(f, model.mean, model.scale, strict=True)] for f, k in own if k == y])
    d = (scaled(1)[:, None, :] - scaled(0)[None, :, :]).reshape(-1, quality.WIDTH)
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + 1e-3 * w @ w / 2
    rng = np.random.default_rng(0)
    # All pairs stand for the sampled ones, so a step away from the optimum gains nothing that matters.
    assert all(loss(model.weights) < loss(model.weights + 0.3 * v / np.linalg.norm(v)) for v in rng.normal(size=(20, quality.WIDTH)))


def test_quality_is_learned_from_all_pairs_of_all_rows(spark):
    """The weights minimise the loss of all pairs, and the threshold has exactly as many rows below it as are bad."""
    r = random.Random(4)
    marks = "!.,;:?-#$&"
    texts = [(i, " ".join(sentences(1, i, 12, 500) + r.choice(marks[: 10 if i % 5 else 5]) for _ in range(2))) for i in range(20_000)]
    labels = spark.createDataFrame([(i, int(i % 5 > 2)) for i, _ in texts], "doc_id long, quality int")
    docs = documents(spark, [*texts, (None, "no id"), (-1, "no label")])
    model = quality.fit(docs, labels, F.lit(True))
    x = np.array([quality.features(t) for _, t in texts])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale[x.std(0) > 1e-9], x.std(0)[x.std(0) > 1e-9])
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    u = z @ model.weights
    g, b = (np.array([i % 5 > 2 for i, _ in texts]) == k for k in (True, False))
    lost = [1 / (1 + np.exp(u[g][k : k + 500, None] - u[b])) for k in range(0, g.sum(), 500)]
    slope = (sum(x.sum(0) for x in lost) @ z[b] - np.concatenate([x.sum(1) for x in lost]) @ z[g]) / g.sum() / b.sum() + 1e-3 * model.weights
    assert np.abs(slope).max() < 1e-5
    order = np.sort(u)
    assert abs(model.threshold - (order[b.sum() - 1] + order[b.sum()]) / 2) < 1e-9


def test_quality_keeps_odd_rows_whole(spark):
    model = quality.Model(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), np.zeros(quality.WIDTH), -1.0)
    docs = documents(spark)
    assert sorted(map(str, quality.keep(docs, model).collect())) == sorted(map(str, docs.collect()))
    assert quality.keep(empty(spark), model).count() == 0


# op3


def plain_bootstrap(texts, forms=pii.FORMS):
    """Added spans of each text, by scoring patterns over all occurrences until nothing is added."""
    flat = lambda p: p.replace("++", "+").replace(r"\G|", "")
    occurrences = []
    for i, t in enumerate(texts):
        t = t or ""
        taken = [tuple(map(int, s.split(":")[1:])) for s in plain_spans(t).split(",") if s]
        for sure in (True, False):
            for kind in pii.KINDS:
                end = 0
                found = [m.span() for m in re.finditer(flat((pii.STRICT if sure else pii.LOOSE)[kind]), t)]
                for k, (a, b) in enumerate(found):
                    left = re.sub("[0-9]", "0", t[max(end, a - 80) : a].lower()).split()
                    right = re.sub("[0-9]", "0", t[b : min(b + 80, found[k + 1][0] if k + 1 < len(found) else len(t))].lower()).split()
                    end = b
                    good = f"{kind}:{a}:{b}" in plain_spans(t).split(",") if sure else not any(a < y and x < b for x, y in taken)
                    if good:
                        context = {"l2": " ".join(left[-2:]) if len(left) > 1 else None, "r2": " ".join(right[:2]) if len(right) > 1 else None, "lr": f"{left[-1]} _ {right[0]}" if left and right else None, "l1": left[-1] if left else None}
                        occurrences.append((i, kind, a, b, t[a:b].lower(), sure, {(kind, f, c) for f, c in context.items() if c}))
    instances = defaultdict(set)
    for _, kind, _, _, value, _, patterns in occurrences:
        for p in patterns:
            instances[p].add((kind, value))
    known = {(kind, value) for _, kind, _, _, value, sure, _ in occurrences if sure}
    while True:
        trusted = {p for p, own in instances.items() if len(own & known) >= forms[p[1]][0] and len(own & known) >= forms[p[1]][1] * len(own)}
        more = {(o[1], o[4]) for o in occurrences if o[6] & trusted}
        if more <= known:
            break
        known |= more
    added = defaultdict(set)
    for i, kind, a, b, _, sure, patterns in occurrences:
        if not sure and patterns & trusted:
            added[i].add((a, pii.KINDS.index(kind), b))
    return added


def bootstrap_texts(seed=0):
    r = random.Random(seed)
    card = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    texts = [f"Please call me at +1 (3{i:02d}) 555-1{i:03d} today" for i in range(20)]
    # Seeds make "call me" trusted; what it finds stands behind "fax us" too, and that finds more.
    unseen = [f"555-{i}23-4567" for i in range(4)]
    texts += [f"now call me at {x} or so" for x in unseen] + [f"or fax us on {x}" for x in unseen] + ["then fax us on 777-123-9999", "lot number 888-123-9999 sold"]
    texts += [f"mail to someone{i}@example.org soon" for i in range(4)] + ["mail to jane.doe [at] example [dot] org soon", "mail to you"]
    texts += [f"{sentences(i, i, 12)} order {card(16)} {sentences(i, 50 + i, 8)}" for i in range(30)]
    texts += [f"host 10.0.{i}.{j} is up" for i in range(3) for j in range(9)] + ["host fe80:1:2:3:4:5:6:7 is up", "host 10.0.0.300 is up"]
    return texts + [t for _, t in TEXTS]


def test_bootstrapping_against_a_plain_graph(spark):
    texts = bootstrap_texts()
    docs = documents(spark, list(enumerate(texts)))
    want = plain_bootstrap(texts)
    got = {r["doc_id"]: r["s"] for r in pii.extract(docs).select("doc_id", pii.spelled(F.col("spans")).alias("s")).collect()}
    for i, t in enumerate(texts):
        base = {(int(a), pii.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in plain_spans(t).split(",") if s)}
        assert got[i] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base | want[i]))
    found = {texts[i] for i in want if want[i]}
    assert "then fax us on 777-123-9999" in found and "mail to jane.doe [at] example [dot] org soon" in found and "lot number 888-123-9999 sold" not in found


def test_masks_follow_their_texts_through_a_shuffle(spark):
    texts = bootstrap_texts()
    wide = documents(spark, [*enumerate(texts), (3, texts[7]), (None, texts[0]), (3, texts[3])]).withColumn("wide", F.repeat(F.lit("x"), 2000))
    own = lambda docs: sorted(map(str, pii.mask(docs).select("doc_id", "text", "n_chars", "row").collect()))
    want = own(wide)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    try:
        assert own(wide.repartition(13, "doc_id")) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(want) == len(texts) + 3


def test_masking_odd_rows(spark):
    docs = documents(spark)
    got = pii.mask(docs)
    assert got.columns == docs.columns and got.count() == len(TEXTS) and pii.mask(empty(spark)).count() == 0
    for r, (_, t) in zip(sorted(got.collect(), key=lambda r: str(r["doc_id"])), sorted(TEXTS, key=lambda x: str(x[0])), strict=True):
        if not plain_spans(t):
            assert r["doc_id"] is None or t is None or r["text"] in [x for i, x in TEXTS if i == r["doc_id"]]


def test_many_matches_take_no_square_of_time(spark):
    import time

    pii.mask(documents(spark, [(1, "12 a")])).count()
    began = time.perf_counter()
    text = "12 a +1 (202) 555-0143 b@c.de " * 30_000  # 0.9 MB
    row = pii.mask(documents(spark, [(1, text)])).first()
    assert row["text"] == "12 a <PHONE> <EMAIL> " * 30_000 and time.perf_counter() - began < 60


# op4


@pytest.mark.parametrize("block", [16_000_000, 200])
def test_hits_and_cuts_follow_their_texts_through_a_shuffle(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (block,))
    items = [(k, sentences(0, k, 40, 9)) for k in range(12)] + [(40, None), (41, "")]
    texts = [(k % 17, sentences(0, 50 + k, 80, 9) + " " + (items[k % 12][1] if k % 3 else "")) for k in range(40)] + TEXTS
    docs, bench = documents(spark, texts).repartition(7, "doc_id"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in decontaminate.hits(docs, bench).collect())
    assert got == sorted((str(i), *plain_hits(t, items)) for i, t in texts)
    cut = decontaminate.clean(docs, bench)
    assert cut.columns == docs.columns
    left = sorted((str(r["doc_id"]), len(decontaminate.alnum_words(r["text"]))) for r in cut.collect())
    assert left == sorted((str(i), n - h) for i, (n, h, _) in ((i, plain_hits(t, items)) for i, t in texts) if not h or h < n)
    assert decontaminate.clean(empty(spark), bench).count() == 0


def test_suffix_arrays_and_shards(monkeypatch):
    rng = np.random.default_rng(3)
    for n, most in ((1, 1), (50, 2), (400, 3), (400, 200)):
        text = np.append(rng.integers(0, most + 1, n), 0)
        zeros = iter(range(-len(text), 0))
        unique = [next(zeros) if x == 0 else x for x in text.tolist()]
        assert decontaminate.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: unique[i:])
    assert len(decontaminate.suffix_array(np.zeros(0, np.int64))) == 0
    items = [(k, sentences(0, k, 40, 9)) for k in range(5)]
    texts = [sentences(0, 9 + k, 80, 9) + " " + items[k % 5][1] for k in range(20)]
    whole = decontaminate.Phrases.of(items).search(texts)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 37)
    assert decontaminate.Phrases.of(items).search(texts) == whole and any(f[1] for f in whole)


def test_an_index_takes_few_bytes_a_word_and_a_search_leaves_none():
    rng = np.random.default_rng(5)
    text = np.append(rng.integers(1, 1 << 16, 100_000), 0)
    tracemalloc.start()
    try:
        index = decontaminate.FMIndex(text)
        assert tracemalloc.get_traced_memory()[0] < 16 * len(text)
        del index
        phrases = decontaminate.Phrases.of([(1, sentences(0, 1, 40, 9))])
        texts = [" ".join(f"w{k}" for k in range(i, i + 5_000)) for i in range(0, 50_000, 5_000)]
        before = tracemalloc.get_traced_memory()[0]
        phrases.search(texts)
        assert tracemalloc.get_traced_memory()[0] < before + 500_000
    finally:
        tracemalloc.stop()


def test_wavelet_levels_against_counting():
    rng = np.random.default_rng(6)
    for n in (0, 1, 63, 64, 65, 128, 1000):
        text = rng.integers(0, 8, n)
        tree = decontaminate.WaveletMatrix(text, 3)
        for c in range(8):
            at = np.arange(n + 1)
            assert tree.rank(np.full(n + 1, c), at).tolist() == [int((text[:i] == c).sum()) for i in at]
        symbol, rank = tree.access(np.arange(n))
        assert symbol.tolist() == text.tolist() and rank.tolist() == [int((text[:i] == text[i]).sum()) for i in range(n)]


def test_memory_is_given_back_after_what_held_it_is_freed(monkeypatch):
    import pyarrow as pa

    held, freed = [], []

    def work(batches):
        for own in map(np.copy, batches):
            held.append(weakref.ref(own))
            yield own

    monkeypatch.setattr(common, "release", lambda: freed.append([r() for r in held]))
    assert sum(map(len, common.released(work)([np.zeros(9)] * 3))) == 27 and freed == [[None] * 3]
    monkeypatch.undo()
    given = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: given.append(1)))
    common.release()
    assert given == [1]


# op6


def test_winnowing_query_against_plain_version(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    marks = {}
    texts = sorted({t for _, t in docs} | {t[: len(t) - len(t) // 4] + u[: len(t) // 4] for (_, t), (_, u) in zip(docs, docs[1:] + docs[:1], strict=True)})
    rows = documents(spark, list(enumerate(texts))).select("doc_id", winnow.selected(F.col("text")).alias("s")).collect()
    for r in rows:
        marks[texts[r["doc_id"]]] = [(v >> 31, winnow.PLACES - 1 - (v & (winnow.PLACES - 1))) for v in r["s"]]
    written = lambda t: ",".join(f"{h:x}:{p}" for h, p in marks[t])

    def like(a, b):
        a, b = {h for h, _ in marks[a]}, {h for h, _ in marks[b]}
        return len(a & b) / len(a | b) if a | b else 1.0

    got = {r["doc_id"]: r for r in winnow.op6_winnowing(spark, SF).collect()}
    for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1], strict=True):
        edited = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (written(t), written(edited))
        assert abs(r["near_edited"] - like(t, edited)) < 1e-12 and abs(r["near_next"] - like(t, u)) < 1e-12


# op7


def test_language_query_against_plain_compression(spark):
    import zstandard as z

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    setting = z.ZstdCompressionParameters.from_level(6, min_match=3, strategy=z.STRATEGY_BTOPT, window_log=19, write_content_size=False, write_checksum=False, write_dict_id=False)
    for r in language.op7_compression_language(spark, SF).collect():
        t = texts[r["doc_id"]] or ""
        if not regex.search(r"\p{L}", t):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        size = {}
        for name in sorted(model):
            coder = z.ZstdCompressor(dict_data=z.ZstdCompressionDict(model[name], dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=setting)
            size[name] = sum(len(coder.compress(t[i : i + 2000].lower().encode())) for i in range(0, len(t), 2000))
        best = min(size, key=size.get)
        assert r["lang_pred"] == best and abs(r["score"] - 1 / sum(2 ** ((size[best] - n) / 3) for n in size.values())) < 1e-9


@pytest.mark.parametrize("text", ["½ 12", "²", "①", "12 34", "_ - !", "Ⅷ"])
def test_texts_without_letters_have_no_language(text):
    assert language.Classifier({"de": b"der hund", "en": b"the dog"})(text)[0] == "und"


def test_the_language_sample_is_bounded_and_counts_copies_once(spark):
    rows = [(i, "der hund und die katze") for i in range(3000)] + [(5000 + i, f"die katze nummer {i} und der hund") for i in range(900)]
    docs = documents(spark, rows).withColumn("lang", F.lit("de"))
    model = language.fit(docs, F.lit(True))
    assert model["de"].count(b"\n") + 1 == language.SAMPLE_ROWS
    assert model == language.fit(docs.repartition(9), F.lit(True)) and language.fit(docs.where("false"), F.lit(True)) == {}


# op8


def test_examples_hold_all_turns_before_them(spark):
    rows = [(c, t, r, f"{r} {c} {t} <|end|>") for c in range(4) for t, r in enumerate(["system", "user", "assistant", "user", "user", "assistant", "assistant", "user"][: 8 - c])]
    parts = chat.expand(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    full = {(r["conv_id"], r["position"]): r for r in chat.written_out(parts).collect()}
    rendered = lambda c, t, r, x: f"<|{r}|>" + x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") + "<|end|>"
    assert sorted(full) == sorted((c, t) for c, t, r, _ in rows if r == "assistant")
    for (c, t), r in full.items():
        assert r["formatted"] == "".join(rendered(*x) for x in rows if x[0] == c and x[1] <= t)
        assert chat.plain(r["formatted"][r["loss_start"] : r["loss_end"]]) == next(x[3] for x in rows if x[:2] == (c, t))
    chained = parts.where("trains").select("conv_id", "example", "parent").collect()
    assert all(r["parent"] == r["example"] - 1 for r in chained)


def test_digests_are_read_from_examples_in_full(spark, monkeypatch):
    """Each reply has a row with its whole prefix; what the query returns follows from these rows and changes with them."""
    monkeypatch.setattr(chat, "SLICE_CHARS", 300)
    rows = [(c, t, r, f"{r} {c} {t} <|end|> &amp; \u00e9") for c in (1, 2, 3, None) for t, r in enumerate(["end", "user", "assistant", "user", "assistant", "assistant", "a|"][: 7 - (c or 0)])] + [(9, 0, "user", None)]
    rendered = lambda c, t, r, x: f"<|{r}|>" + (x or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") + "<|end|>"
    examples = chat.expand(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).persist()
    found = {(r["conv_id"], r["position"]): r for r in examples.collect()}
    ends = {c: max(t for k, t, _, _ in rows if k == c) for c, *_ in rows}
    assert sorted(found, key=str) == sorted(((c, t) for c, t, r, _ in rows if r == "assistant" or ends[c] == t), key=str)
    for (c, t), e in found.items():
        assert e["formatted"] == "".join(rendered(*x) for x in rows if x[0] == c and x[1] <= t)
        own = next(x for x in rows if x[:2] == (c, t))
        assert e["trains"] == (own[2] == "assistant") and (not e["trains"] or chat.plain(e["formatted"][e["loss_start"] : e["loss_end"]]) == own[3])
    for word in ("user", "used"):
        for r in chat.read_back(examples.withColumn("formatted", F.replace("formatted", F.lit("user"), F.lit(word)))).collect():
            own = [x for x in rows if x[0] == r["conv_id"]]
            written = "".join(f"{x[2]}\n{x[3] or ''}\n" for x in own).replace("user", word)
            assert r["turns_sha256"] == hashlib.sha256(written.encode()).hexdigest()
            assert r["n_turns"] == len(own) and r["example_chars"] == sum(len(e["formatted"]) for (c, _), e in found.items() if c == r["conv_id"] and e["trains"])
    examples.unpersist()


# op9


@pytest.mark.parametrize("seed", range(6))
def test_heap_merge_counts_like_a_counter(seed):
    from collections import Counter

    r = random.Random(seed)
    lists = [sorted(r.sample(range(60), r.randrange(0, 40))) for _ in range(r.randrange(1, 12))]
    for least in range(1, len(lists) + 1):
        found, counts = jaccard.merge_skip(lists, least)
        assert dict(zip(found, counts, strict=True)) == {x: n for x, n in Counter(x for own in lists for x in own).items() if n >= least}
        assert found == sorted(found)


def shuffled_bytes(spark, act):
    """What ``act`` wrote to shuffle files, by the session's own count."""
    sc = spark.sparkContext._jsc.sc()
    written = lambda: sum(sc.statusStore().executorList(False).apply(k).totalShuffleWrite() for k in range(sc.statusStore().executorList(False).size()))
    sc.listenerBus().waitUntilEmpty()
    before = written()
    act()
    sc.listenerBus().waitUntilEmpty()
    return written() - before


@pytest.mark.parametrize("again", [False, True])
def test_texts_are_not_dealt_out_above_the_switch(spark, monkeypatch, again):
    """Where ids are too many to broadcast, only the texts that a filter of them lets through are shuffled."""
    r = random.Random(1)
    texts = [(i, f"one two three {i} four five six {i * 7} seven eight") for i in range(400)] + [(i + 1000, f"one two three {i} four five six {i * 7} seven eight") for i in range(0, 400, 100)]
    texts += [(7, "zero under an id that is taken")] * again
    wide = spark.createDataFrame([(i, t, r.randbytes(5000).hex()) for i, t in texts], "doc_id long, text string, wide string").repartition(3).checkpoint()
    want = sorted(map(str, jaccard.one_of_each(wide).collect()))
    long = wide.select("doc_id", F.concat_ws(" ", "text", "wide").alias("text"))
    chosen = spark.createDataFrame([(i, 1, 2) for i in range(0, 400, 100)], "node long, cluster long, size long")
    sets = sorted(map(str, jaccard.sets_in(long, chosen, jaccard.STAGE).collect()))
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", -1)
    assert shuffled_bytes(spark, lambda: want == sorted(map(str, jaccard.one_of_each(wide).collect())) or pytest.fail("other rows")) < 1_000_000  # of 2 MB
    assert shuffled_bytes(spark, lambda: sets == sorted(map(str, jaccard.sets_in(long, chosen, jaccard.STAGE).collect())) or pytest.fail("other sets")) < 1_000_000


def test_rows_apart_by_a_filter_of_ids(spark, monkeypatch):
    rows = spark.range(20_000).select(F.when(F.col("id") % 100 != 1, F.col("id") - 5000).alias("doc_id"), F.lit("x").alias("a.b"))
    for step, most in ((9, common.MOST_BITS), (9, common.BUCKET), (30_000, common.MOST_BITS)):
        monkeypatch.setattr(common, "MOST_BITS", most)
        ids = spark.range(-5000, 20_000, step).select(F.col("id").alias("doc_id")).where("doc_id <> -5000")
        sure, others = common.apart(rows, ids)
        assert sure.columns == others.columns == rows.columns and sure.count() + others.count() == rows.count()
        assert sure.join(ids, "doc_id").isEmpty() and others.where("doc_id IS NULL").isEmpty()
        assert others.count() <= ids.count() + rows.count() // (common.FILTER_BITS if most > common.BUCKET else 4)


def test_components_of_long_chains_and_wide_stars(spark):
    links = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000, 2001), (2001, 2001), (None, 5)] + [(1299, 3000)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{i: 1000 for i in range(1000, 1300)}, 3000: 1000, 2000: 2000, 2001: 2000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# op10


@pytest.mark.parametrize("offset", range(4))
def test_bands_retrieve_copies_at_any_offset(spark, offset):
    r = random.Random(offset)
    word = lambda: f"t{r.randrange(10**9)}"
    notices = [" ".join(word() for _ in range(12 + k % 3)) for k in range(150)]
    texts = [(k, " ".join([word() for _ in range(20 + offset)] + [n] + [word() for _ in range(17)])) for k, n in enumerate(notices)]
    table = spark.createDataFrame([(f"L{k}", n) for k, n in enumerate(notices)] + [(None, "a b c d e"), ("X", None)], "license string, text string")
    rows = licenses.scan(documents(spark, texts).drop("matches"), table, column="found").collect()
    assert all([m["license"] for m in r_["found"]] == [f"L{r_['doc_id']}"] for r_ in rows) and len(rows) == 150


# pipeline


def test_the_pipeline_against_plain_stages(spark, tmp_path):
    """All stages on a fixture with planted near copies, passages and personal data; each against a plain version."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    r = random.Random(5)
    prose = lambda seed: ". ".join(f"The {sentences(0, 100 * seed + k, 14, 400)} goes on as it was said" for k in range(r.randrange(2, 6))) + "."
    passage = " ".join(f"bench{k}" for k in range(24))
    good = [prose(i) for i in range(60)]
    good[50] = good[10] + " The end."  # a near copy if the text is long enough
    good[51] = good[11]
    good[52] += " " + passage
    good[53] += " Mail me at some.one@example.org or call +1 (202) 555-0143 soon."
    bad = ["BUY!!! $$$ ### now *** %d $$$ &&& @@@ %s" % (i, "!!! " * (i % 7)) for i in range(40)]
    texts = good + bad
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    frame.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    docs = frame
    state = {}
    for name in list(stages)[:-1]:
        docs = stages[name](spark, docs, sf)
        assert docs.columns == frame.columns
        state[name] = {r["doc_id"]: r for r in docs.collect()}
    kept = state["quality classifier"]
    assert set(kept) >= set(range(60)) - {k for k in range(60) if k not in kept} and len(set(kept) & set(range(60))) >= 57 and not set(kept) & set(range(60, 100))
    one = state["n-gram Jaccard join"]
    plain = plain_groups([(i, x["text"]) for i, x in kept.items()], 5, 4, 5)
    assert set(one) == {c for _, c in plain.values()} and len(one) < len(kept)
    cut = state["benchmark decontamination"]
    for i, x in one.items():
        n, hit, _ = plain_hits(x["text"], [(1, passage)])
        assert len(decontaminate.alnum_words(cut[i]["text"])) == n - hit and (hit or cut[i]["text"] == x["text"])
    masked = state["PII"]
    for i, x in cut.items():
        if not plain_spans(x["text"]):
            assert masked[i]["text"] == x["text"]
    if 53 in masked:
        assert "<EMAIL>" in masked[53]["text"] and "<PHONE>" in masked[53]["text"] and "@" not in masked[53]["text"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {i: len(tokenizer.encode(x["text"], add_special_tokens=False).ids) + 1 for i, x in masked.items()}
    packed = corpus_pipeline.run(spark, sf).collect()
    held = defaultdict(int)
    for p in packed:
        held[p["doc_id"]] += p["length"]
    assert dict(held) == tokens


def test_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(6, 1, 0), (7, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, LONG), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (documents(spark), empty(spark)):
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= docs.count() or name == "packing"
            assert name == "packing" or out.columns == docs.columns
    assert os.path.exists(tmp_path / "labels.parquet")


def test_the_jaccard_stage_and_repeated_ids(spark):
    texts = near_copies(3) + [(0, "another text under an id that is taken")]
    out = jaccard.one_of_each(documents(spark, texts), jaccard.STAGE)
    assert len({r["doc_id"] for r in out.collect()}) == out.count()
