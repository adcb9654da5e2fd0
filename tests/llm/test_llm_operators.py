"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import io
import itertools
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, decontaminate, induced_sort, minhash, mixing, pii, quality, sharding, suffix_dedup, url_filter, warc
from tidemark.llm.common import Scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, ids=None):
    rows = [(ids[i] if ids else i, t, "en", sources[i] if sources else "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


# ---- sharding

def test_sharding_fits_and_is_minimal(spark):
    rng = random.Random(1)
    texts = ["x" * rng.randint(0, 300) for _ in range(400)] + [None, ""]
    out = sharding.assign_shards(docs(spark, texts).withColumn("shard_id", F.lit("clash")), limit_bytes=2000).toPandas()
    assert len(out) == len(texts)
    assert out["n_bytes"].tolist() == [len(t or "") for t in texts] or sorted(out["n_bytes"]) == sorted(len(t or "") for t in texts)
    by = out.groupby("shard_id")["n_bytes"].sum()
    assert (by <= 2000).all() and (out.groupby("shard_id")["shard_bytes"].first() == by).all()
    bits = {s[1:] for s in by.index}
    assert not any(a != b and b.startswith(a) for a in bits for b in bits)  # prefix-free
    def h(row):
        return bin(int(hashlib.md5(f"{row.doc_id}\0{row.text or ''}".encode()).hexdigest()[:15], 16))[2:].zfill(60)
    sums = defaultdict(int)
    for row in out.itertuples():
        assert h(row).startswith(row.shard_id[1:])
        for d in range(30):
            sums[h(row)[:d]] += row.n_bytes
    assert all(sums[b[:-1]] > 2000 for b in bits if b)  # nothing was split without need


def test_sharding_overflow_of_equal_rows(spark):
    out = sharding.assign_shards(docs(spark, ["y" * 90] * 50, ids=[7] * 50), limit_bytes=1000).toPandas()
    assert len(out) == 50 and out["shard_id"].str.contains(r"\+").all()
    assert (out.groupby("shard_id")["n_bytes"].sum() <= 1000).all()


def test_sharding_empty_and_single_large(spark):
    assert sharding.assign_shards(docs(spark, ["a"]).limit(0), 10).count() == 0
    out = sharding.assign_shards(docs(spark, ["z" * 100, "a"]), 10).toPandas()
    assert sorted(out["shard_bytes"]) == [1, 100]
    with pytest.raises(ValueError):
        sharding.assign_shards(docs(spark, ["a"]), 0)


# ---- chat formatting

def tree(spark, rows):
    return spark.createDataFrame(rows, "tree long, msg long, parent long, role string, text string, score double")


def test_reply_tree_paths_ranked_and_read_back(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a <|end|> [INST] \\", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 3, "user", None, 0.0), (2, 1, 99, "user", "orphan", None)]
    out = chat_format.read_back(chat_format.format_trees(tree(spark, rows))).toPandas().sort_values(["tree", "rank"])
    assert [(r.tree, r.leaf, r["rank"]) for _, r in out.iterrows()] == [(1, 4, 1), (1, 2, 2), (2, 1, 1)]
    got = {(r.tree, r.leaf): [(t["role"], t["text"]) for t in r.turns] for _, r in out.iterrows()}
    assert got[(1, 4)] == [("user", "q"), ("assistant", "b"), ("user", "")]
    assert got[(1, 2)] == [("user", "q"), ("assistant", "a <|end|> [INST] \\")]
    assert dict(zip(zip(out.tree, out.leaf), out.loss_text))[(1, 2)] == "a <|end|> [INST] \\"
    assert chat_format.format_trees(tree(spark, rows), top=1).count() == 2


def test_long_thread_null_tree_and_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "<|turn|>x<|text|>", "\\<\\[", "", "<", "[\\"]
    rows = [(None, i, i - 1 if i else None, "assistant" if i % 2 else "user", texts[i % 6], None) for i in range(70)]
    out = chat_format.read_back(chat_format.format_trees(tree(spark, rows))).toPandas()
    assert len(out) == 1 and [t["text"] for t in out.turns[0]] == [texts[i % 6] for i in range(70)]
    assert out.loss_text[0] == "".join(texts[i % 6] for i in range(70) if i % 2)
    for control in ("</s>", "[INST]", "[/INST]"):
        assert control not in out.formatted[0]


def test_cycle_is_an_error_and_empty_is_empty(spark):
    with pytest.raises(ValueError):
        chat_format.format_trees(tree(spark, [(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0)])).count()
    assert chat_format.format_trees(tree(spark, [(1, 1, None, "user", "a", 0.0)]).limit(0)).count() == 0


# ---- quality

def brute_repeats(words):
    seen = defaultdict(list)
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    return len({p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 5)})


def test_repeat_words_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice("abc").encode() for _ in range(rng.randint(0, 25))]
        assert quality.repeat_words(words) == brute_repeats(words)


def test_line_rules_and_document_verdict(spark):
    prose = "This is a clean line of prose with enough words in it.\nAnother line says something else in its own words."
    menu = "Home | About | News | Shop | Help | Contact\n" * 3 + "One sentence here is fine."
    out = quality.clean_documents(docs(spark, [prose, menu, None, "", prose + "\nAll rights reserved.", "a " * 30])).orderBy("doc_id").toPandas()
    assert out["kept"].tolist() == [True, False, False, False, True, False]
    assert out["cleaned"][4] == prose and out["n_bad_lines"][4] == 1 and out["n_dup_lines"][1] == 2
    assert out["n_repeat_words"][5] == 30
    assert quality.clean_documents(docs(spark, ["a"]).limit(0)).count() == 0


# ---- mixing

def test_knapsack_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        k = int(rng.integers(1, 5))
        lengths, counts = np.sort(rng.choice(np.arange(1, 15), k, replace=False)), rng.integers(0, 4, k)
        budget = int(rng.integers(0, 40))
        sums = {0}
        for n, c in zip(lengths, counts):
            sums |= {s + n * j for s in sums for j in range(c + 1)}
        take = mixing.knapsack(lengths, counts, budget)
        assert (take <= counts).all() and (take * lengths).sum() == max(s for s in sums if s <= budget)


def test_targets_and_taken(spark):
    rng = random.Random(4)
    texts, sources = [], []
    for source, n in (("a", 40), ("b", 200), ("c", 30), (None, 20)):
        for _ in range(n):
            texts.append(" ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60))))
            sources.append(source)
    table = docs(spark, texts, sources)
    out = mixing.mix(table.withColumn("size", F.lit("clash"))).toPandas()
    sizes = out.groupby("source", dropna=False)["size"].sum()
    weights = dict(zip(["a", "b", "c", None], (5, 2, 1, 5)))
    named = {(None if not isinstance(k, str) else k): int(v) for k, v in sizes.items()}
    total, capped = sum(named.values()), {}
    while True:
        rest = {s: (total - sum(capped.values())) * weights[s] / sum(weights[x] for x in named if x not in capped) for s in named if s not in capped}
        over = {s: 3 * named[s] for s, v in rest.items() if v > 3 * named[s]}
        if not over:
            break
        capped |= over
    want = {**capped, **rest}
    for source, part in out.groupby("source", dropna=False):
        key = source if isinstance(source, str) else None
        assert abs(part["target"].iloc[0] - want[key]) < 1e-6
        assert part["target"].iloc[0] - 70 <= part["taken"].sum() <= part["target"].iloc[0] + 1e-6
    assert (out["taken"] <= 3 * out["size"]).all() and ((out["taken"] % out["size"].where(out["size"] > 0, 1)) == 0).all()
    again = mixing.mix(table.repartition(7)).toPandas()
    key = ["doc_id"]
    assert out.sort_values(key)["taken"].tolist() == again.sort_values(key)["taken"].tolist()
    assert mixing.mix(table.limit(0)).count() == 0


def test_mixing_of_equal_rows_and_large_length_groups(spark):
    table = docs(spark, ["one two three"] * 9000 + ["a b"] * 10, ["big"] * 9000 + ["a"] * 10)
    out = mixing.mix(table).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.sum("size").alias("s")).toPandas().set_index("source")
    assert out.loc["big", "g"] - 3 < out.loc["big", "t"] <= out.loc["big", "g"]
    copies = docs(spark, ["one two three"] * 50 + ["a b"] * 3, ["big"] * 50 + ["a"] * 3, ids=[5] * 50 + [1, 2, 3])
    out = mixing.mix(copies).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).toPandas().set_index("source")
    assert out.loc["big", "g"] - 3 < out.loc["big", "t"] <= out.loc["big", "g"]


# ---- suffix dedup

def naive_flags(text, length):
    seen = defaultdict(list)
    items = text.tolist()
    for i in range(len(items) - length + 1):
        seen[tuple(items[i : i + length])].append(i)
    out = np.zeros(len(items), bool)
    for at in seen.values():
        if len(at) > 1:
            out[at] = True
    return out


@pytest.mark.parametrize("memory", [64 << 20, 64])
def test_induced_sort_flags(memory, monkeypatch):
    rng = np.random.default_rng(5)
    for round_ in range(250):
        monkeypatch.setattr(induced_sort, "BLOCK", 1 << 15 if round_ % 3 else 3)
        text = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 90))).astype(np.int16)
        if round_ % 2 and len(text) > 20:
            text[10 : 10 + len(text) // 3] = text[: len(text) // 3]
        length = int(rng.integers(1, 9))
        got = induced_sort.repeated_positions(text, length, memory)
        got[max(0, len(text) - length + 1) :] = False
        assert (got == naive_flags(text, length)).all(), text.tolist()


def test_induced_sort_stays_in_budget(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(induced_sort, "BLOCK", 1 << 10)
    rng = np.random.default_rng(6)
    text = rng.integers(1, 5, 150_000).astype(np.int16)
    text[100_000:140_000] = text[:40_000]
    want = np.array(induced_sort.repeated_positions(text, 40))
    tracemalloc.start()
    try:
        got = induced_sort.repeated_positions(text, 40, 1 << 17)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (got == want).all() and 80_000 - 78 <= got.sum() < 80_100
    assert peak < 8 * len(text)  # the tuples of both passes alone are more


def brute_repeats_of(texts, length):
    seen = defaultdict(int)
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] += 1
    out = []
    for d in data:
        gone = set()
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone.update(range(i, i + length))
        out.append((len(gone), bytes(c for i, c in enumerate(d) if i not in gone)))
    return out


def test_remove_repeats_brute_force(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdé fgh") for _ in range(300))
    texts = [base, base, base[50:200] + "tail", "head" + base[:90] + "mid" + base[100:260], "z" * 120, None, "", "short", "ab" * 60, base[:39]]
    texts += ["".join(rng.choice("xyz") for _ in range(200)) for _ in range(5)]
    out = suffix_dedup.remove_repeats(docs(spark, texts), length=40, gram=16).orderBy("doc_id").toPandas()
    for i, (removed, kept) in enumerate(brute_repeats_of(texts, 40)):
        assert (out.n_removed[i], bytes(out.kept_bytes[i])) == (removed, kept), i
        assert out.kept_sha256[i] == hashlib.sha256(kept).hexdigest() and out.n_bytes[i] == len((texts[i] or "").encode())
    assert suffix_dedup.remove_repeats(docs(spark, ["a"]).limit(0)).count() == 0


def test_hot_anchors_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    rng = random.Random(7)
    common = "".join(rng.choice("abcdefgh") for _ in range(70))
    texts = ["".join(rng.choice("stuvw") for _ in range(30)) + common + "".join(rng.choice("stuvw") for _ in range(30)) for _ in range(12)] + [common] * 3
    out = suffix_dedup.remove_repeats(docs(spark, texts), length=40, gram=16).orderBy("doc_id").toPandas()
    assert out.n_removed.tolist() == [r for r, _ in brute_repeats_of(texts, 40)]


# ---- mixing: the fit

def nearest_sums(lengths, counts, budget):
    """Whether each sum up to budget is reached, by listing them."""
    reached = {0}
    for n, c in zip(lengths, counts):
        reached = {s + n * k for s in reached for k in range(c + 1) if s + n * k <= budget}
    return max(reached)


def test_fit_is_exact_for_few_sums_and_bounded_otherwise(monkeypatch):
    assert mixing.fit(np.array([100000, 150000]), np.array([1, 1]), 150000).tolist() == [0, 1]
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 10 ** int(rng.integers(1, 7)), rng.integers(1, 9)))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 2))
        got = mixing.fit(lengths, counts, budget)
        assert (got <= counts).all() and (got >= 0).all()
        assert int((got * lengths).sum()) == nearest_sums(lengths.tolist(), counts.tolist(), budget)
        with monkeypatch.context() as m:
            m.setattr(mixing, "sparse_fit", lambda *a: None)
            other = mixing.fit(lengths, counts, budget, dp_budget=50)
        short, unused = budget - int((other * lengths).sum()), lengths[other < counts]
        assert short >= 0 and (other <= counts).all() and (not len(unused) or short < unused.min())


def test_mix_with_clashing_columns_and_very_long_documents(spark):
    rows = [(1, "a " * 100_000, "s", 1, 2), (2, "b " * 150_000, "s", 3, 4), (3, "c " * 100_000, "t", 5, 6), (4, None, None, None, None), (4, "", None, 7, 8)]
    data = spark.createDataFrame(rows, "doc_id long, text string, source string, n int, epochs int")
    out = mixing.mix(data, weights=(3, 4), max_epochs=1).toPandas().sort_values("doc_id")
    assert list(out.columns) == ["doc_id", "text", "source", "n", "epochs", *mixing.OUT]
    assert out.taken.tolist()[:3] == [100_000, 150_000, 100_000] and out["size"].tolist()[3:] == [0, 0]
    lean = mixing.mix(data, weights=(3, 4), max_epochs=1, with_text=False).toPandas().sort_values("doc_id")
    assert "text" not in lean and lean.taken.tolist() == out.taken.tolist()


# ---- WARC

def test_warc_ranges_own_each_record_once():
    rng = random.Random(8)
    members = [warc.record_bytes(i, f"http://h/{i} \n", rng.randbytes(rng.randint(0, 3000)), "response", None) for i in range(60)]
    data = b"".join(members)
    for size in (1, 500, 4096, len(data)):
        got = [x for a in range(0, len(data), size) for x in warc.read_range(io.BytesIO(data), a, min(a + size, len(data)))]
        assert [warc.parse_record(x)["page_id"] for _, x in got] == list(range(60))
        assert [at for at, _ in got] == np.cumsum([0] + [len(m) for m in members[:-1]]).tolist()
        if size == 1:
            size = 1


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://b/\r\nX: 1", None), (4, "u", ""), (5, "u", "é" * 70000), (None, "u", "solo"), (6, "u", "a\r\n\r\nb"), (6, "u", "a\r\n\r\nb")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.round_trip(pages.withColumn("archive", F.lit("clash")).withColumn("__key", F.lit(1)), split_bytes=700).toPandas()
    assert len(out) == len(rows)
    one = {None if v is None or v != v else int(v): r for v, r in zip(out.page_id, out.to_dict("records"))}
    assert one[1]["record_type"] == "revisit" and one[1]["refers_to"] == 2 and one[2]["record_type"] == "response"
    assert one[3]["record_type"] == "revisit" and one[3]["refers_to"] == 4 and one[3]["payload_bytes"] == 0
    assert one[5]["payload_bytes"] == 140000 and one[None]["record_type"] == "response"
    assert one[1]["payload_digest"] == warc.digest32(b"same") and (out[out.page_id == 6].record_type == "response").all()
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_ranges_are_read_by_many_tasks(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.repeat(F.col("id").cast("string"), 300).alias("html"))
    scratch = Scratch(spark)
    folder = scratch.path("archives")
    spark._jvm.java.io.File(folder.removeprefix("file://")).mkdirs()
    manifest = scratch.table(warc.write_archives(warc.plan_records(pages, scratch).coalesce(1), folder), "manifest")
    read = warc.read_archives(spark, manifest, split_bytes=4000).withColumn("task", F.spark_partition_id())
    per_task = read.groupBy("task").count().collect()
    assert sum(r["count"] for r in per_task) == 400 and len(per_task) >= 8
    scratch.release()


# ---- personal data

@pytest.fixture(scope="module")
def model():
    return pii.train_table(pii.example_table())


def plain_spans(line):
    """The patterns as they stand, matched by the regular expression engine."""
    out = []
    for kind in pii.KINDS:
        for m in pii.BASE[kind].finditer(line):
            digits = "".join(c for c in m.group() if c in "0123456789")
            good = {"email": True, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}
            if all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else good[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_patterns():
    line = "a.b@c.example.com 300.1.1.1 10.0.0.1; 4539 1488 0343 6467, +1 (988) 555-2485 x 4539148803436468"
    got = [(k, line[a:b]) for k, a, b in pii.base_spans(line)]
    assert got == [("email", "a.b@c.example.com"), ("ip", "10.0.0.1"), ("card", "4539 1488 0343 6467"), ("phone", "+1 (988) 555-2485")]
    rng = random.Random(3)
    for _ in range(20000):
        letters = rng.choice(["a.@1- ", "0123456789. ", "+1() -.2", "a@b.c_é²", "12 -", "1.2.3.4@x", "@.a", "0123456789 -+."])
        line = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(line) == plain_spans(line), line


def test_hostile_lines_neither_crash_nor_stall(model):
    for line in ("ping 192.168.4.\u00b2 failed", "1.2.3." + "4" * 5000, "\u0663.\u0661.\u0662.\u0663 @ x", "000.00000000000000000255.1.256", "(at) dot @"):
        (base, spans), (_, other) = pii.find_spans([line, "call (415) 555-2671 now"], model)
        assert base == pii.base_spans(line) and other == [("phone", 5, 19)]
    began = time.process_time()
    for line in ("1" * 10**6, "a" * 10**6 + " @", "1." * 500_000, "a@b.c " * 150_000, "+1" + " " * 10**6, "a@" + "a." * 400_000 + "."):
        pii.base_spans(line)
    assert time.process_time() - began < 10  # any quadratic scan of a million characters takes minutes


def test_model_on_held_out_examples(model):
    found = wanted = right = 0
    for text, spans in pii.example_table(3, seed=77).itertuples(index=False):
        good = {s for s in spans if s[0] in ("email", "phone")}
        _, got = pii.find_spans([text], model)[0]
        got = {s for s in got if s[0] in ("email", "phone")}
        found, wanted, right = found + len(got), wanted + len(good), right + len(got & good)
    assert right / wanted > 0.9 and right / found > 0.9, (found, wanted, right)


def test_viterbi_is_the_best_path(model):
    words = ["call", "(988)", "555-2485", "now"]
    scores = model.scores([words])[0]
    path = model.decode([words, ["a"], words * 3])[0]
    value = lambda p: scores[range(len(p)), p].sum() + model.move[p[:-1], p[1:]].sum()
    every = [np.array(p) for p in itertools.product(range(len(pii.LABELS)), repeat=len(words))]
    assert value(path.astype(int)) == pytest.approx(max(map(value, every)))


def test_personal_data_keeps_other_columns(spark):
    rows = spark.createDataFrame([(1, "call +1 415 555 2671", 7, "x"), (1, "call +1 415 555 2671", 7, "x"), (None, None, None, None)], "doc_id long, text string, n_phone long, line string")
    out = pii.find_personal_data(rows).toPandas()
    assert sorted(out.n_phone) == [0, 1, 1] and sorted(out.n_spans) == [0, 1, 1] and list(out.columns[:3]) == ["doc_id", "text", "line"]


def test_personal_data_of_clean_and_odd_texts(spark):
    texts = [None, "", "Licensed under CC BY-NC 4.0.\nVersion 2.0 of chapter 12.", "x\ncall (415) 555-2671 today", "mail me@host.example.org"]
    out = pii.find_personal_data(docs(spark, texts)).orderBy("doc_id").toPandas()
    assert out.spans.tolist()[:3] == ["", "", ""] and "phone:7:21" in out.spans[3] and out.n_email[4] == 1
    assert pii.redact(texts[4], out.spans[4]) == "mail [email]"
    assert pii.find_personal_data(docs(spark, ["a"]).limit(0)).count() == 0


# ---- decontamination

def brute_hits(texts, items, size, share):
    import re

    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    out = []
    for t in texts:
        w, hit, ids = split(t), set(), set()
        for item, text in items:
            v = split(text)
            for i in range(max(1, len(v) - size + 1) if v else 0):
                win = v[i : i + size]
                for j in range(len(w) - len(win) + 1):
                    if w[j : j + len(win)] == win:
                        hit.update(range(j, j + len(win)))
                        ids.add(str(item))
        out.append((len(w), len(hit), sorted(ids), bool(hit) and share * len(hit) >= len(w)))
    return out


def test_decontaminate_brute_force(spark):
    rng = random.Random(10)
    vocab = ["the", "of", "É", "é", "Alpha", "beta", "x1", "gamma"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 9)))) for i in range(25)] + [(99, None), (100, "solo-word!"), (7, "the the the the")]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "SOLO word", "solo", items[3][1]] * 2
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(docs(spark, texts).withColumn("items", F.lit(1)), bench, size=4, share=3).orderBy("doc_id").toPandas()
    for i, want in enumerate(brute_hits(texts, items, 4, 3)):
        assert (out.n_words[i], out.n_hit[i], list(out["items"][i]), bool(out.contaminated[i])) == want, i
    assert decontaminate.decontaminate(docs(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs(spark, texts).limit(0), bench).count() == 0


def test_near_matches(spark):
    a = spark.createDataFrame([("d", 0, 3), ("d", 50, 2)], "doc string, start int, len int")
    b = spark.createDataFrame([("d", 6, 2), ("d", 47, 1), ("e", 0, 1)], "doc string, start int, len int")
    got = {(r.a, r.b, r.gap) for r in decontaminate.near_matches(a, b, 3).collect()}
    assert got == {(0, 6, 3), (50, 47, 2)}


# ---- URL filter

def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    end = min([rest.find(c, cut) for c in "?#" if rest.find(c, cut) >= 0], default=len(rest))
    path = rest[cut:end]
    fits = [(len(h + p), len(h), a, h + p) for h, p, a in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_url_filter_brute_force(spark):
    rng = random.Random(11)
    hosts, paths = ["com", "a.com", "b.a.com", "ab.com", "org", "x.org"], ["", "/", "/e", "/en", "/en/", "/en/7", "/en/70", "/ö"]
    rules = list({(rng.choice(hosts), rng.choice(paths)): rng.choice(["block", "allow"]) for _ in range(14)}.items())
    rules = [(h, p, a) for (h, p), a in rules]
    urls = [f"http://{rng.choice(['', 'w.', 'v.w.'])}{rng.choice(hosts).upper()}{rng.choice(paths)}{rng.choice(['', '1', '?q=/en/', '#f'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "http://", "http:///en", "x://com", "https://a.com?x://b", "http://a.com"] * 2
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    table = spark.createDataFrame(rules + [rules[0], (None, "/", "block"), ("", "/", "block")], "host string, path string, action string")
    out = url_filter.judge_urls(pages, table).orderBy("page_id").toPandas()
    for i, u in enumerate(urls):
        assert (out.host[i], out.path[i], out.rule[i], out.verdict[i]) == brute_url(u, rules), u
    assert set(url_filter.judge_urls(pages, table.limit(0)).toPandas().verdict) == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0


def test_url_filter_rules_of_the_contract(spark, tmp_path):
    from tidemark.llm import queries

    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    rules = [(r[r.index(" ") + 1 : r.index("/")], r[r.index("/") :], r.split()[0]) for r in contract.split(", ")]
    urls = [f"http://{sub}{h}{p}{end}" for h, p, _ in rules for sub in ("", "www.", "Ex.") for end in ("", "1", "?q=/de/8")]
    urls += ["http://example.net/de/7", "http://a.example.net/de/8x", "http://example.com/en/6", "http://net", "http://xnet/de/", None, "net/de/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.op9_url_filter(spark, str(tmp_path)).orderBy("page_id").toPandas()
    assert len(out) == len(urls)
    for i, u in enumerate(urls):
        assert (out.host[i], out.path[i], out.rule[i], out.verdict[i]) == brute_url(u, rules), u


# ---- near-duplicates

def brute_components(texts):
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    return [len(s) for s in sets], comp


def near_copies(seed=12, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(3, 90))] for _ in range(8)]
    texts = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    return texts + [None, "", "  \n", "ONE", "one", "one two", "é x", "É x", texts[0], texts[0].upper()]


def test_near_duplicates_brute_force(spark):
    texts = near_copies()
    n, comp = brute_components(texts)
    out = minhash.near_duplicates(docs(spark, texts).withColumn("kept", F.lit(0))).orderBy("doc_id").toPandas()
    assert out.n_shingles.tolist() == n and out.component_id.tolist() == comp
    assert out.kept.tolist() == [i == c for i, c in enumerate(comp)]
    assert minhash.near_duplicates(docs(spark, ["a"]).limit(0)).count() == 0


def test_large_clusters_go_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP_DOCS", 6)
    texts = near_copies(13)
    out = minhash.label_documents(docs(spark, texts)).orderBy("id").toPandas()
    assert out.component_id.tolist() == brute_components(texts)[1]


def test_drifting_copies_leave_open_buckets(spark, monkeypatch):
    """Copies that are links of some copies only: the lead connects a part, the others need the other comparisons."""
    rng = random.Random(21)
    texts = []
    for k in range(120):
        words = texts[rng.randrange(len(texts))].split() if texts and k % 40 else [f"w{i}" for i in range(160)]
        for at in rng.sample(range(len(words)), rng.choice([2, 6])):
            words[at] = f"x{rng.randint(0, 10**6)}"
        texts.append(" ".join(words))
    expected = brute_components(texts)[1]
    for few in (1000, 5):
        monkeypatch.setattr(minhash, "GROUP_DOCS", few)
        out = minhash.label_documents(docs(spark, texts)).orderBy("id").toPandas()
        assert out.component_id.tolist() == expected, few
    assert 5 < len(set(expected)) < 100


def test_drop_near_duplicates_with_null_and_repeated_ids(spark):
    text = "a b c d e f g h"
    table = docs(spark, [text, text, text + " ", "x y z q r s", None, ""], ids=[None, 4, 4, None, None, 1])
    out = minhash.drop_near_duplicates(table).toPandas()
    assert sorted(out.text.fillna("-").str.strip()) == ["", "-", text, "x y z q r s"]


def test_bayes_bound():
    least = minhash._least_matches(0.75, minhash.MISS)
    assert least == sorted(least) and len(least) == minhash.HASHES // minhash.BATCH and least[-1] < 0.75 * minhash.HASHES


# ---- the pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(14)
    line = lambda: " ".join(rng.choice(["ka", "lo", "mi", "ne", "pu", "ra"]) + str(rng.randint(0, 40)) for _ in range(12)) + "."
    good = ["\n".join(line() for _ in range(4)) for _ in range(30)]
    secret = " ".join(f"bench{i}" for i in range(20))
    texts = good + [good[0], good[1] + " x", "junk", None, good[2] + "\n" + secret + "."]
    table = docs(spark, texts, [f"s{i % 3}" for i in range(len(texts))])
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, secret)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id) <= set(range(30)) | {34} and 34 not in set(out.doc_id)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard_id"} <= set(out.columns)
    assert len(P.STAGES) == 5 and len(set(out.text)) == len(set(out.doc_id))
    stage = P.quality_stage(spark, table, str(tmp_path))
    assert stage.columns == table.columns and stage.count() == 33


def test_pipeline_stages_keep_clashing_columns(spark, tmp_path):
    import corpus_pipeline as P

    line = "the quick brown fox jumps over the lazy dog while it rains on number {}."
    rows = [(i, line.format(i) + "\n" + " ".join(f"k{i}x{j}" for j in range(30)) + ".", "s", -1, 5, "kept", -2) for i in range(6)] + [(None,) * 7]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, n_words int, kept string, __time int")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES[:-1]:
        for data in (table, table.limit(0)):
            out = stage(spark, data, str(tmp_path))
            assert out.columns == table.columns, name
            got = out.where("doc_id is not null").select("size", "n_words", "kept", "__time").distinct().collect()
            assert [tuple(r) for r in got] == ([(-1, 5, "kept", -2)] if data is table else []), name


def test_scratch_release(spark):
    s = Scratch(spark)
    t = s.table(spark.range(3), "x")
    assert t.count() == 3
    s.release()


def test_shards_beyond_the_memory_budget_spill(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MEMORY", 256)
    rng = random.Random(15)
    base = "".join(rng.choice("abc") for _ in range(160))
    texts = [base[i : i + 90] + "".join(rng.choice("xyz") for _ in range(20)) for i in range(0, 60, 7)]
    text = suffix_dedup._ShardText()
    for t in texts:
        text.append(t.encode())
    assert text.file is not None and len(text.array()) == sum(len(t) + 1 for t in texts)
    text.close()
    frame = docs(spark, texts)
    out = suffix_dedup.remove_repeats(frame, length=40, gram=16).orderBy("doc_id").toPandas()
    assert out.n_removed.tolist() == [r for r, _ in brute_repeats_of(texts, 40)]
