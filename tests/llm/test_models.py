"""Tokeniser, Matroska, language and toxicity operators."""

import math
import random
import struct

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quaymark.llm import bpe, langid, matroska, toxicity
from quaymark.llm.common import table

FILE = public_tokenizers.path("byte_bpe_50k.json")


def fuzz(n=400):
    r = random.Random(1)
    out = ["".join(r.choice("ab \t\n\x1c\x85  é1٣²中'stdm!?​\x00🙂") + r.choice(["", "", "", "<|endoftext|>"]) for _ in range(r.randint(0, 50))) for _ in range(n)]
    return out + ["", None, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x" * 1000, "!" * 5000 + "ab" * 500, " " * 300, "it's IT'S we'll", "\x00<|endoftext|>", "a" * 120_000]


def test_bpe(spark, sf):
    library = Tokenizer.from_file(FILE)
    texts = fuzz() + [r.text for r in table(spark, sf, "documents").select("text").collect()]
    rows = [(i, t, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, "twice", 7), (3, texts[3], 7)], "doc_id long, text string, ids int").repartition(3)
    enc = bpe.encode(df, FILE, lexicon_words=300)
    got = bpe.decode(enc, FILE).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), FILE).count() == 0
    both = bpe.round_trip(df, FILE, lexicon_words=300, keep_text=False)
    assert both.columns == ["doc_id", "ids", "decoded"]
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.ids, r.decoded)
    assert sorted(map(key, both.collect())) == sorted(map(key, got))


def test_vocabulary_in_workers():
    """What is sent to workers has neither tables of pairs nor compiled patterns, and merges as before."""
    import pickle

    v = bpe.read_vocabulary(FILE)
    words = ["", "the", "x" * 300, "é" * 50, " Zebulon"]
    want, sizes = v.merge_many([w.encode() for w in words])
    raw = pickle.dumps(v)
    assert len(raw) < 3_000_000
    again, n = pickle.loads(raw).merge_many([w.encode() for w in words])
    assert want.tolist() == again.tolist() and sizes.tolist() == n.tolist()
    assert bpe.split_pattern({"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "a+"}}]}}) == "a+"
    assert bpe.split_pattern({"pre_tokenizer": {"type": "ByteLevel"}}) == bpe.SPLIT


def test_lexicon_is_minimal():
    entries = {w.encode(): [i] for i, w in enumerate(["a", "bat", "bats", "cat", "cats", "zzz"])}
    blob = bpe.compile_lexicon(entries)
    import tempfile

    with tempfile.NamedTemporaryFile() as f:
        f.write(blob)
        f.flush()
        lex = bpe.Lexicon(f.name)
        ranks = lex.ranks([b"bat", b"cats", b"x", b"ba", b"", b"zzz", b"y" * 200])
        assert [lex.ids(r) if r >= 0 else None for r in ranks.tolist()] == [[1], [4], None, None, None, [5], None]
        assert len(lex.parts[3]) == 7  # bat, bats, cat and cats share all states after their first letter


def test_matroska_round_trip(spark):
    texts = [None, "", "a", "é" * 40, "x" * 64, "y" * 65, "line\n" * 3000, "z" * 300_000]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)] + [(2, "a", "m")], "doc_id long, text string, media string")
    got = matroska.read_back(matroska.mux(df)).collect()
    for r in got:
        raw = (r.text or "").encode()
        assert bytes(r.payload) == raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        assert ";bad_cues=0;" in r.feature
    assert len({bytes(r.media) for r in got if r.text == "a"}) == 1
    p = matroska.packets(matroska.mux(df))
    assert p.groupBy("id").agg(F.sum("size").alias("n")).filter("id = '6'").first().n == 15_040
    assert matroska.mux(df.limit(0)).count() == 0


def test_matroska_forms():
    """Xiph lacing, an unknown-size cluster and a block group, as other writers make them."""
    e, n = matroska.element, matroska.number
    frames = [b"a" * 300, b"b" * 10, b"c" * 5]
    xiph = b"\x81" + struct.pack(">hB", 5, 0x02) + bytes([2, 255, 45, 10]) + b"".join(frames)
    group = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, b"\x81" + struct.pack(">hB", 9, 0) + b"last"))
    body = n(matroska.TIMESTAMP, 100) + e(matroska.SIMPLE_BLOCK, xiph) + group
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    data = matroska.HEADER + e(matroska.SEGMENT, matroska.TRACK_LIST + cluster + e(matroska.CUES, b""))
    found = matroska.parse(data)
    assert [data[p : p + s] for _, _, p, s, *_ in found["packets"]] == [*frames, b"last"]
    assert [t for _, t, *_ in found["packets"]] == [105.0, 105 + 300 / 8, 105 + 310 / 8, 109.0] and found["clusters"] == 1
    for sizes in ([5, 5, 70_000, 3], [200, 100, 300, 1], [1, 0, 0, 9]):
        made = b"\x81" + struct.pack(">hB", 0, 6) + bytes([len(sizes) - 1]) + matroska.ebml_lace(sizes) + b"q" * sum(sizes)
        assert matroska.lace_sizes(made, 4, len(made), 3)[0] == sizes


def test_damaged_media(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x1a\x45\xdf\xa3\xff")), (2, None), (3, bytearray(b""))], "doc_id long, media binary")
    got = {r.doc_id: r for r in matroska.read_back(df).collect()}
    assert got[1].payload is None or got[1].feature.startswith(("error", "packets=0"))
    assert got[2].payload is None and got[2].feature is None and got[3].feature == "packets=0"


def slow_phrases(arcs, symbols):
    n, state = 0, 0
    for c in symbols:
        if c in arcs[state]:
            state = arcs[state][c]
        else:
            n += state != 0
            state = arcs[0].get(c, 0)
            n += state == 0
    return n + (state != 0)


def slow_language(model, text):
    """Language and score by a plain loop over the symbols of one text."""
    table = langid.letter_table(model.letters)
    s = langid.to_symbols(text or "", table).tolist()
    if not any(c.isalpha() for c in text or "") or not model.languages:
        return "und", 0.0
    cost = []
    for (n, flat), trained in zip(model.automata, model.trained):
        arcs = [{} for _ in range(n)]
        for a, c, b in flat.tolist():
            arcs[a][c] = b
        cost.append(slow_phrases(arcs, s) * math.log2(trained + len(model.letters) + 3) / len(s))
    order = sorted(range(len(cost)), key=lambda k: cost[k])
    second = cost[order[1]]
    return model.languages[order[0]], (second - cost[order[0]]) / second


def scripts(seed=4):
    """Sentences of two languages that share a large alphabet, and one with letters of its own beyond 16 bits."""
    r = random.Random(seed)
    word = lambda a, b: "".join(chr(r.randint(a, b)) for _ in range(r.randint(1, 3)))
    lists = {"x1": [word(0x4E00, 0x5000) for _ in range(80)], "x2": [word(0x4E00, 0x5000) for _ in range(80)], "old": [word(0x10400, 0x10440) for _ in range(80)]}
    return {lang: lambda n, ws=ws: " ".join(r.choice(ws) for _ in range(n)) for lang, ws in lists.items()}


def test_cross_parsing():
    r = random.Random(6)
    sentence = scripts()
    texts = {"en": ["the cat sat on the mat and the hat"], "de": ["die katze sass auf der matte und dem hut"], "xx": ["zq zq ññ"]} | {k: [f(300)] for k, f in sentence.items()}
    m = langid.Model(texts)
    p = langid.Parser(m)
    tries = ["the cat and the hat", "die matte und der hut", "ññ!", "", "THE 123 mat", "日本", "the " * 4000, "ж" * 700, texts["x1"][0], texts["x1"][0][5:] * 2, "?"]
    tries += [f(r.randint(1, 400)) for f in sentence.values() for _ in range(10)] + ["".join(r.choice("thea cn") for _ in range(r.randint(200, 900))) for _ in range(20)]
    got, _ = p.phrases(tries)
    for t, row in zip(tries, got):
        s = langid.to_symbols(t, p.table).tolist()
        for k, lang in enumerate(m.languages):
            arcs = langid.suffix_automaton(langid.to_symbols(texts[lang][0], p.table).tolist())
            assert row[k] == slow_phrases(arcs, s)


def test_languages_with_large_alphabets_and_uneven_training(spark):
    sentence = scripts(8)
    train = [(i, sentence[lang](2000 if lang == "x1" else 150), lang) for i, lang in enumerate(["x1", "x1", "x1", "x2", "old"])]
    train += [(5, None, "x1"), (None, "zzz", "x1"), (6, "zzz", None), (3, train[3][1], "x2"), (7, "1 2 3", "digits")]
    model = langid.learn(spark.createDataFrame([(*t, 1, "x", "y") for t in train], "doc_id long, text string, lang string, _id int, _lang string, _of string"))
    assert model.languages == ["digits", "old", "x1", "x2"] and "z" not in model.letters
    asked = [(i, sentence[lang](40), lang) for i, lang in enumerate(["x1", "x2", "old"] * 10)]
    odd = [(100, None, "a"), (100, "", "a"), (101, "12 -", "b"), (102, "Ж", "c"), (103, "z" * 3000, "c"), (None, asked[0][1], "d"), (None, asked[0][1], "d"), (104, sentence["x2"](20_000), "x2")]
    df = spark.createDataFrame(asked + odd, "doc_id long, text string, lang_pred string").repartition(3)  # a clashing name
    got = langid.identify(df, model).collect()
    assert len(got) == len(asked) + len(odd)
    for r in got:
        lang, score = slow_language(model, r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9
    said = {r.doc_id: r.lang_pred for r in got}
    assert all(said[i] == lang for i, _, lang in asked) and said[104] == "x2" and said[100] == said[101] == "und"
    nothing = langid.learn(spark.createDataFrame(train, "doc_id long, text string, lang string").limit(0))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"} and langid.identify(df.limit(0), model).count() == 0


def test_sample_takes_whole_documents(spark):
    rows = [(i, "ab " * 20_000 if i == 3 else f"word{i} " * 30, "a") for i in range(100)] + [(200, "cd " * 20_000, "b"), (201, "ef " * 20_000, "b")]
    m = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.trained[0] == sum(1 for _ in range(64)) * 60 or m.trained[0] <= langid.TRAIN_SYMBOLS
    assert m.trained[1] == 60_000  # one long document, whole


def test_language_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    m = langid.learn(docs.filter(~langid.held_out()))
    x = langid.identify(docs.filter(langid.held_out()), m).filter(F.length("text") > 0).select("lang", "lang_pred", F.length("text").alias("n")).collect()
    assert sum(r.lang == r.lang_pred for r in x) >= 0.97 * len(x)
    assert all(r.lang == r.lang_pred for r in x if r.n > 1000)
    odd = spark.createDataFrame([(1, None), (2, "123 !!"), (3, ""), (None, "the of and with")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, m).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] in m.languages
    assert langid.identify(odd.limit(0), m).count() == 0


def test_toxicity_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    net = toxicity.learn(docs, labels)
    x = toxicity.score(docs, net).join(labels, "doc_id").filter(toxicity.held_out()).select("toxic", toxicity.predicted().alias("p"), "score").toPandas()
    assert x.score.between(0, 1).all()
    assert x.p[x.toxic == 1].mean() >= 0.8 and x.p[x.toxic == 0].mean() <= 0.02
    odd = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (3, "stupid " * 50_000, 3.0), (3, "good", 0.0)], "doc_id long, text string, score double")
    got = toxicity.score(odd, net).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd.limit(0), net).count() == 0


def slow_probability(net, words):
    """The network as plain loops over one document."""
    rows = net.rows()
    vector = [net.emb[rows[w]].sum(0) for w in words.reshape(-1, toxicity.IDS)] + [np.zeros(toxicity.DIM, np.float32)] * (toxicity.PAD + (len(words) == 0))
    feats = []
    for k, b in zip(net.conv, net.bias):
        for q in range(toxicity.FILTERS):
            feats.append(max(0, *(sum(float(vector[i + j] @ k[j, :, q]) for j in range(len(k))) + b[q] for i in range(max(1, len(vector) - toxicity.PAD)))))
    return 1 / (1 + math.exp(-(float(np.dot(feats, net.out)) + net.out_bias)))


def test_toxicity_depends_on_the_text_alone(spark):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    net = toxicity.learn(docs, table(spark, d, "labels"))
    odd = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate([None, "", "a", "a b", "!!", "", "a", "a b c"] * 3)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd).union(docs.select(F.col("doc_id") + 10**7, "text").limit(300))
    runs = [{r.doc_id: (r.text or "", r.score) for r in toxicity.score(x, net).collect()} for x in (every.repartition(5), every.orderBy(F.desc("doc_id")).coalesce(1))]
    assert runs[0] == runs[1]
    by_text = {}
    for text, score in runs[0].values():
        assert by_text.setdefault(text, score) == score
    words = {r.text or "": np.array(r.w, np.int64) for r in every.limit(80).union(odd).select("text", toxicity.hashed_words(F.col("text")).alias("w")).collect() if len(r.w) < 900}
    for text, w in words.items():
        p, (flat, starts) = slow_probability(net, w), toxicity.padded([net.rows()[w].reshape(-1, toxicity.IDS)])
        t = net.cuts[net.languages[int(net.ready().language(flat, starts)[0])]]
        assert abs(by_text[text] - (0.7 * p / t if p < t else 0.7 + 0.3 * (p - t) / (1 - t))) < 1e-5


def test_learning_with_odd_rows(spark):
    """Ids that are no numbers, repeated rows and labels, nulls in any column."""
    rows = [(f"d{i}", f"word{i % 7} {'bad' if i % 2 else 'good'} text", "en" if i % 3 else None) for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:20] + [("d5", "other", None), (None, "x", "en"), ("d61", None, None)], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(62)] + [("d1", 1), ("d1", 0), (None, 1), ("d2", None), ("d3", 5)], "doc_id string, toxic int")
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs.repartition(7), labels.repartition(3))
    assert (a.emb == b.emb).all() and a.cuts == b.cuts
    got = {r.text: r.score for r in toxicity.score(docs, a).collect()}
    assert got["word1 bad text"] > got["word2 good text"]


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(0, "some words", "en"), (3, "more words", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score < 0.7 for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect())


def test_gradient_of_the_network():
    """Training tells rows that hold a word from those that lack it."""
    r = np.random.default_rng(2)
    words = [r.integers(0, 50, 30 * toxicity.IDS) for _ in range(40)]
    toxic = np.arange(40) % 2
    for w, t in zip(words, toxic):
        if t:
            w[:: toxicity.IDS][3] = 77
    net = toxicity.train(words, toxic, ["en"] * 40)
    docs = [net.rows()[w].reshape(-1, toxicity.IDS) for w in words]
    p = net.probability(*toxicity.padded(docs))
    assert p[toxic == 1].mean() > p[toxic == 0].mean() + 0.05
