"""Operators 7 to 10 and the pipeline."""

import hashlib
import json
import math
import pickle
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import regex
from lodestone.llm import chat, common, decontamination, language, queries, scoring
from lodestone.llm.common import materialize_stage
from pyspark.sql import functions as F

from test_documents import brute_components, brute_fingerprint, size_of, targets

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_decontamination(spark, docs, rows, broadcast, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(800, None), (801, ""), (802, "one"), (803, "short item"), (None, rows[3][1])]
    texts = [(i, t) for i, t, _, _ in rows]
    for k, (_, item) in enumerate(items[:30]):  # whole items and items with words changed inside other texts
        words = item.split()
        for j in range(k % 5):
            words[(j * 7) % len(words)] = "other"
        texts.append((60_000 + k, "Before it. " * k + " ".join(words).upper() + "\nafter it" * 40))
    found = decontamination.leaks(spark.createDataFrame([(*x, 0, "x") for x in texts], "doc_id long, text string, words int, item_id string"), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, shingle int")).collect()
    want = {}
    for j, item in items:
        own = shingle_set(item)
        for i, t in texts:
            n = len(own & shingle_set(t))
            if own and n >= 0.8 * len(own) - 1e-9:
                want[i, j] = max(n, want.get((i, j), 0))
    assert {(r.doc_id, r.item_id): r.n_shared for r in found} == want and len(want) > 15
    assert len(found) == len(want)


def test_candidates_come_from_sketches(spark, docs, none):
    """The first join sees rows of the sketches alone: without them nothing is a candidate, and an item's others find none."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    index = decontamination.item_index(items).cache()
    sizes = index.groupBy("item_id").agg(F.first("n_shingles").alias("n"), F.sum(F.col("sketched").cast("int")).alias("k"), F.first("size_class").alias("c")).collect()
    assert all(r.c == int(math.log2(r.n)) and r.k == min(r.n, math.floor((2 ** (r.c + 1) - 1) * 0.2 + 1e-9) + 1) for r in sizes) and sum(r.k for r in sizes) < 0.5 * index.count()
    assert decontamination.candidates(docs, index.withColumn("sketched", F.lit(False))).count() == 0 < decontamination.candidates(docs, index).count()
    one = next(r.item_id for r in sizes if r.n > 20)
    words = items.filter(F.col("item_id") == one).first().text
    short = spark.createDataFrame([(1, words), (2, " ".join(words.split()[:6]))], "doc_id long, text string")
    assert {r._id for r in decontamination.candidates(short, index).filter(F.col("item_id") == one).collect()} == {1}  # the other is too short to hold enough of it
    assert decontamination.leaks(none, items).count() == decontamination.leaks(docs, none.withColumn("item_id", F.col("doc_id"))).count() == 0


def test_drop_leaks(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaked = {r.doc_id for r in decontamination.leaks(docs, items).collect()}
    kept = decontamination.drop_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.filter(~F.coalesce(F.col("doc_id").isin(list(leaked)), F.lit(False))).count()


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(found) > 100 and sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97


def test_language_edges(docs, rows):
    found = language.identify(docs).collect()
    texts = defaultdict(list)
    for i, t, _, _ in rows:
        texts[i].append(t)
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not regex.search(r"\p{L}", texts[r.doc_id][0] or "")), r
    kept = language.drop_unknown(docs)
    assert kept.columns == docs.columns and kept.count() == sum(bool(regex.search(r"\p{L}", t or "")) for _, t, _, _ in rows)


def test_language_rejects(spark, docs, none):
    """Texts that no learned language accounts for go; without labels, or without a text column, nothing goes for want of a model."""
    odd = spark.createDataFrame([(70_000, "\u0439\u0446\u0443 \u043a\u0435\u043d \u0433\u0448\u0449", None, "en"), (70_001, "\u65e5\u672c\u8a9e", None, "en"), (70_002, "12 34", None, "en")], "doc_id long, text string, lang string, source string")
    few = docs.select("doc_id", "text", "lang", "source")
    assert [r.doc_id for r in language.drop_unknown(few.unionByName(odd)).filter("doc_id >= 70000").collect()] == []
    bare = few.unionByName(odd).withColumn("lang", F.lit(None).cast("string"))
    assert language.drop_unknown(bare).count() == few.unionByName(odd).filter(F.col("text").rlike(r"\p{L}")).count() > 200
    assert language.drop_unknown(docs.drop("text")).count() == 0 and language.drop_unknown(docs.withColumnRenamed("text", "TEXT")).count() > 200
    assert language.identify(none).count() == language.drop_unknown(none).count() == 0 and {r.lang_pred for r in language.identify(bare).collect()} == {"und"}


def brute_language(counts, text):
    """Word first, then shorter and shorter n-grams, by the definition: (language, probability, share of words that speak)."""
    langs = sorted({k for k, _ in counts})
    grams = [None] + [Counter() for _ in range(4)]
    for (k, w), n in counts.items():
        for size in range(1, 5):
            for i in range(len(w) + 3 - size):
                grams[size][k, f" {w} "[i : i + size]] += n
    log = lambda table, k, x: math.log((table[k, x] + 0.5) / (sum(n for (j, _), n in table.items() if j == k) + 0.5 * len({y for _, y in table})))
    words = regex.findall(r"\p{L}+", text.lower())
    total, spoke = dict.fromkeys(langs, 0.0), 0
    for w in words:
        if any((k, w) in counts for k in langs):
            spoke += 1
            for k in langs:
                total[k] += log(counts, k, w)
            continue
        for size in range(4, 0, -1):
            found = [g for i in range(len(w) + 3 - size) if any((k, g := f" {w} "[i : i + size]) in grams[size] for k in langs)]
            if found:
                spoke += size >= 3
                for k in langs:
                    total[k] += sum(log(grams[size], k, g) for g in found) / len(found) + (5 - size) * math.log(0.4)
                break
    top = max(langs, key=total.get)
    return top, 1 / sum(math.exp(total[k] - total[top]) for k in langs), spoke / len(words)


def test_language_against_brute_force(spark):
    train = [("the cat and the dog", "en"), ("a dog is here", "en"), ("der hund und die katze", "de"), ("ein hund ist hier", "de")]
    ids = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, *x) for i, x in zip(ids, train, strict=False)] + [(1000 + i, t, None) for i, t in enumerate(["dog und", "cats are herd", "hunde sind heiter", "x", "the hund ist dogs qq"])]
    counts = Counter((k, w) for t, k in train for w in t.split())
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in rows:
        lang, score, evidence = brute_language(counts, t)
        r = found[i]
        assert (r.lang_pred, round(r.score, 4), round(r.evidence, 9)) == (lang, round(score, 4), round(evidence, 9)), (t, r)


def test_language_backs_off(monkeypatch):
    model = language.LanguageModel([("de", "ungen", 5), ("de", "und", 9), ("en", "tion", 5), ("en", "und", 1)])
    assert [x for x, _, _ in model.predict(["und und", "xxtion", "qungen", None, "12"])] == ["de", "en", "de", "und", "und"]  # words, n-grams of unseen words, no letters
    for _ in range(2):
        assert (model.score_words(["und"])[0][0] == model.word_logs[model.words["und"]]).all()
        one, other = model.score_words(["\u0439\u0439\u0439", "\u0436\u0436\u0436"])[0]
        assert one.tolist() == other.tolist() == model.gram_logs[model.grams[" "]].tolist()  # only the word borders are known
        monkeypatch.setattr(language, "KEPT", 1)
    assert model.predict(["und tion a", "b"]) == model.predict(["und tion a", "b"])
    assert language.LanguageModel([]).predict(["abc", None]) == [("und", 0.0, 0.0)] * 2


def brute_ppm(train, texts, order=scoring.ORDER):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        data = bytes(order) + t
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[k][data[i - k : i]][data[i]] += 1

    def probability(context, symbol):
        p, excluded = 1.0, set()
        for k in range(order, -1, -1):
            seen = {s: n for s, n in counts[k].get(context[order - k :], {}).items() if s not in excluded}
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if symbol in seen:
                return p * seen[symbol] / (n + d)
            p *= d / (n + d)
            excluded |= set(seen)
        return p / (256 - len(excluded))

    return [sum(math.log10(probability((bytes(order) + t)[i : i + order], b)) for i, b in enumerate(t)) for t in texts]


@pytest.mark.parametrize(("head", "paths"), [(200_000, 1_000_000), (40, 8_000)])
def test_scoring(docs, rows, head, paths):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    rows = [(i, (t or "").encode()) for i, t, _, _ in rows]
    train = [t for i, t in rows if not held(i)]
    counts = Counter(w for t in train for w in re.findall(rb"[^\x20\x09-\x0d]+", t.lower()))
    counts[None] = len(train)
    total, size = sum(counts.values()), len(counts)
    want = []
    for (i, t), p in zip(rows, brute_ppm(train, [t for _, t in rows]), strict=True):
        found = [*re.findall(rb"[^\x20\x09-\x0d]+", t.lower()), None]
        want.append((i, held(i), len(found), sum(counts[w] > 0 for w in found), total, sum(math.log10((counts[w] + 1) / (total + size + 1)) for w in found), p))
    got = [tuple(r) for r in scoring.score(docs, head, paths).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r[:4]) + (round(r[5], 3),)
    want, got = sorted(want, key=key), sorted(got, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-5, atol=1e-5)


def test_scoring_probabilities_add_up(spark):
    text = b"abracadabra abracadabra"
    found = np.unique(scoring._grams(np.frombuffer(bytes(scoring.ORDER) + text, np.uint8)), return_counts=True)
    paths = spark.createDataFrame([(int(g), int(n)) for g, n in zip(*found, strict=True)], "gram long, n long")
    model = scoring.build(paths)
    assert len(model.names) == 1
    for start in (b"abr", b"zzz", b"aab", b"", b"abracad", b"cadab"):
        own = model.score([start])[0]
        assert math.isclose(sum(10 ** (x - own) for x in model.score([start + bytes([k]) for k in range(256)])), 1, rel_tol=1e-4)
    parts = scoring.build(paths, 5)
    texts = [text, b"xyz", b"", b"zzab"]
    assert len(parts.names) > 3 and np.allclose(parts.score(texts), model.score(texts), atol=1e-5)


def test_slices_are_read_from_stores_too(spark, monkeypatch):
    """A slice that can't be mapped is read whole, one at a time, and gives the same; the driver holds names alone."""
    paths = spark.createDataFrame([(i * 7919 % (1 << 20), 1 + i % 5) for i in range(3000)], "gram long, n long")
    trie = scoring.build(paths, 500)
    grams = np.arange(0, 1 << 20, 997, dtype=np.uint64)
    want = trie.log10(grams)
    real = scoring.store
    monkeypatch.setattr(scoring, "store", lambda folder: (scoring.pafs.SubTreeFileSystem("/", real(folder)[0]), real(folder)[1]))
    other = pickle.loads(pickle.dumps(trie))
    assert np.array_equal(other.log10(grams), want) and len(other.open) == 1 < len(trie.open) and not other.__getstate__()["open"]


def test_scoring_beats_the_baseline(spark):
    """On held-out rows the byte model codes in fewer digits than the word unigrams."""
    found = scoring.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]


def test_scoring_without_training(spark, none):
    assert scoring.score(none).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = scoring.score(spark.createDataFrame([(only, "ab c")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0) and math.isclose(r.score, 4 * math.log10(1 / 256), rel_tol=1e-5)


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


TURNS = [
    (1, 0, "system", "<|im_start|>user\nhi<|im_end|>\n"), (1, 2, "assistant", "<\\|im_end|> <\\\\| \\ <|"), (1, 1, "user", None), (2, 0, "assistant", ""), (2, None, None, "no turn"),
    (2, 1, "odd%0A%25\n<|role|>", "x\n"), (None, 0, "assistant", "\U0001f600 é <"), (1, 2, "assistant", "<\\|im_end|> <\\\\| \\ <|"), (3, 5, "assistant", "a<|im_end|>"), (3, 5, "assistant", "<|im_start|>"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame([(*r, 1, "f") for r in TURNS], "conv_id long, turn long, role string, text string, formatted int, loss_spans string").repartition(3)
    chats = chat.format_chats(rows)
    want = defaultdict(list)
    for c, _, role, text in sorted(TURNS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    read = {r.conv_id: r for r in chat.read_back(chats).collect()}
    assert {c: [tuple(t) for t in r.turns] for c, r in read.items()} == want
    assert {c: r.loss_texts for c, r in read.items()} == {c: [t for r, t in turns if r == "assistant"] for c, turns in want.items()}
    for r in chats.collect():
        assert r.formatted.count("<|") == 2 * len(want[r.conv_id])
        under = [re.sub(r"<\\(\\*)\|", r"<\1|", r.formatted[a:b]) for a, b in r.loss_spans]
        assert under == read[r.conv_id].loss_texts
    for r in chat.chat_report(rows).collect():
        lost = "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(want[r.conv_id]), digest(want[r.conv_id]), len(lost), hashlib.sha256(lost.encode()).hexdigest())
    assert chat.chat_report(rows.limit(0)).count() == 0


def test_chats_without_ids(spark):
    """Records without an id are conversations of their own, whatever table they come from; a long text survives."""
    rows = spark.createDataFrame([(None, 0, "assistant", "x"), (None, 0, "assistant", "x"), (None, 1, "user", "y"), (4, 0, "assistant", "<|" * 300_000)], "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([("q", "a"), ("q", "b")], "prompt string, response string")
    found = sorted((r.conv_id is None, r.n_turns, r.loss_chars) for r in chat.chat_report(rows, pairs).collect())
    assert found == [(False, 1, 600_000), (True, 1, 0), (True, 1, 1), (True, 1, 1), (True, 2, 1), (True, 2, 1)]


def test_chat_layouts(spark):
    typed = {
        "messages": ("conv_id long, messages array<struct<role:string,content:string>>", [(1, [("human", "q"), ("assistant", "a")])]),
        "conversations": ("id string, conversations array<struct<from:string,value:string>>", [("x", [("human", "q"), ("gpt", "a")])]),
        "prompt": ("prompt string, response string, source string", [("q", "a", "s")]),
        "completion": ("prompt string, completion string", [("q", "a")]),
        "instruction_input": ("instruction string, input string, output string", [("q", None, "a")]),
    }
    for name, (schema, data) in typed.items():
        records = spark.createDataFrame(data, schema)
        assert chat.layout_of(records) == name
        assert [(r.role, r.text) for r in chat.canonical(records).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")], name
    with pytest.raises(ValueError, match="no single layout"):
        chat.layout_of(spark.createDataFrame([(1,)], "other int"))


def test_chat_json_records(spark):
    lines = [
        {"prompt": "q", "response": "a"}, {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "more", "output": "a"}, {"id": 4, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"else": 1},
    ]
    records = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)] + [(6, "{broken"), (7, None)], "conv_id long, record string")
    more = [
        {"prompt": "q", "response": "a", "source": {"output": "x"}}, {"instruction": "q", "output": "a", "score": 3}, {"instruction": "q", "input": "", "output": "a", "n": [1]}, {"prompt": "q", "response": "a", "completion": "b"},
        {"messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a"}], "topic": None}, {"messages": "text"}, {"messages": []}, [1], {"prompt": "w " * 200_000, "response": None},
    ]
    records = records.unionByName(spark.createDataFrame([(10 + i, json.dumps(x)) for i, x in enumerate(more)], "conv_id long, record string"))
    assert chat.canonical_json(records.limit(0)).count() == chat.canonical_json(records.drop("record")).filter("layout is not null").count() == 0
    found = {r.conv_id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.canonical_json(records).collect()}
    extra = [found.pop(10 + i) for i in range(len(more))]
    assert [x for x, _ in extra] == ["prompt", "instruction", "instruction_input", None, "messages", None, None, None, "prompt"]
    assert all(x == [("user", "q"), ("assistant", "a")] for n, x in extra[:8] if n) and extra[8][1] == [("user", "w " * 200_000), ("assistant", "")]
    plain = [("user", "q"), ("assistant", "a")]
    assert found == {0: ("prompt", plain), 1: ("instruction", plain), 2: ("instruction_input", [("user", "q\n\nmore"), plain[1]]), 3: ("messages", plain), 4: ("conversations", plain), 5: (None, None), 6: (None, None), 7: (None, None)}


def test_oracles(spark):
    """The queries with SQL agree with it."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        found = queries.queries()[name](spark, SF).toPandas()
        want = con.execute(sql).df()[list(found.columns)]
        order = list(found.columns[:3])
        import pandas as pd

        pd.testing.assert_frame_equal(found.sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True), check_dtype=False, rtol=1e-12)


def test_pipeline(spark, docs, none):
    """From end to end against plain Python: languages, components, leaks, targets and shards of what the stage before has left."""
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    stage = dict(corpus_pipeline.STAGES)
    at, left = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name in ("language_id", "near_dedup", "decontamination", "mixing"):
        at = materialize_stage(lambda name=name, at=at: stage[name](spark, at, SF))
        assert at.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
        left[name] = at.collect()
        assert all(r == rows[r.doc_id] for r in left[name])
    ids = {name: [r.doc_id for r in found] for name, found in left.items()}
    assert sorted(ids["language_id"]) == sorted(i for i, r in rows.items() if regex.search(r"\p{L}", r.text or ""))
    marks = {i: brute_fingerprint(rows[i].text) for i in ids["language_id"]}
    label = brute_components(set(marks.values()))
    assert sorted(ids["near_dedup"]) == sorted({label[m]: i for i, m in sorted(marks.items(), reverse=True)}.values())
    items = [x for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (x := shingle_set(r.text))]
    assert sorted(ids["decontamination"]) == sorted(i for i in ids["near_dedup"] if not any(len(x & shingle_set(rows[i].text)) >= 0.8 * len(x) - 1e-9 for x in items))
    clean = [(i, rows[i].text, None, rows[i].source) for i in ids["decontamination"]]
    sizes, target = targets(clean)
    taken = Counter(ids["mixing"])
    for s in sizes:
        words = sum(size_of(rows[i].text) * n for i, n in taken.items() if rows[i].source == s)
        assert abs(words - target[s]) <= max(size_of(t) for _, t, _, x in clean if x == s) / 2 + 1 and max(taken.values()) <= 2
    found = corpus_pipeline.run(spark, SF).collect()
    assert [r.doc_id for r in sorted(found, key=lambda r: r.position)] == ids["mixing"]  # the order of training goes on
    assert all(r.text == rows[r.doc_id].text and r.text_crc32 == zlib.crc32(r.text.encode()) for r in found) and len({(r.shard, r.slot) for r in found}) == len(found)
    for k in range(24):
        mine = sorted((r.slot, r.position) for r in found if r.shard == k)
        assert abs(len(mine) - len(found) / 24) < 1 and [x for x, _ in mine] == list(range(len(mine))) and [x for _, x in mine] == sorted(x for _, x in mine)
    for f in stage.values():
        f(spark, docs, SF).count()
        assert f(spark, none, SF).count() == 0
