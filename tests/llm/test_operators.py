"""Every operator against a plain version of itself, and on odd rows and empty tables."""

import itertools
import json
import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from hondana.llm import op1_rans, op2_tools, op3_toxicity, op4_language, op5_simhash, op6_decontaminate, op7_quality, op8_pseudolikelihood, op9_topk, op10_mix, scratch
from tests.llm.conftest import ODD


@pytest.fixture(autouse=True)
def _clean():
    yield
    scratch.release()


# 1


def library_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_rans_holds_the_library_s_ids(odd, empty):
    rows = sorted(op1_rans.op1_rans(odd).collect(), key=lambda r: r.start)
    ids = dict(zip([(r[0], r[1]) for r in ODD], library_ids([r[1] for r in ODD])))
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 3, 4, 5, 6, 7]
    start = 0
    for r, key in zip(rows, sorted([(x[0], x[1]) for x in ODD], key=lambda k: -1 if k[0] is None else k[0])):
        want = np.array(ids[key], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert op1_rans.op1_rans(empty).collect() == []


def test_rans_pieces_are_the_library_s():
    """Added tokens of the tokenizer, in any case and anywhere, and letters that fold oddly."""
    import public_tokenizers

    pieces, rng = op1_rans.Pieces(public_tokenizers.path("word_bpe_49k.json")), random.Random(13)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>", "<|", " ", "\n", "a", "b", "É", "Ab", "1", "½", "'s", "'S", "漢", "İ", "ſ", "\u0301", "\xa0", "\u3000", "!?", "ß", "\x00", "🔍"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 10)))
        assert np.frombuffer(pieces.ids(text), "<u2").tolist() == pieces.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_rans_plain_pieces_ask_only_the_model():
    """Pieces that the library's pattern leaves whole cost one call of its model, and give its ids."""
    import public_tokenizers

    pieces, rng = op1_rans.Pieces(public_tokenizers.path("word_bpe_49k.json")), random.Random(17)
    library, asked = pieces.tokenizer, []

    class Counted:
        def encode(self, text, **how):
            asked.append(text)
            return library.encode(text, **how)

    pieces.tokenizer = Counted()
    letters = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(2000)] + ["×÷", "!?", "'", "7", "~|"]
    for word in words:
        assert np.frombuffer(pieces.ids(word), "<u2").tolist() == library.encode(word, add_special_tokens=False).ids, word
    assert asked == []
    assert np.frombuffer(pieces.ids("漢字"), "<u2").tolist() == library.encode("漢字", add_special_tokens=False).ids and asked == ["漢字"]


def test_rans_small_blocks_and_damage(spark, tmp_path):
    import public_tokenizers

    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "é"]) for _ in range(rng.randrange(400)))) for k in range(30)]
    tokens = op1_rans.token_table(spark.createDataFrame(docs, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"))
    path = str(tmp_path / "file")
    op1_rans.write_file(tokens, path, lanes=4, segment=32, block=128)
    rows = sorted(op1_rans.read_file(spark, path, with_ids=True).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, want in zip(rows, library_ids([t for _, t in docs])):
        assert np.frombuffer(r.ids, "<u2").tolist() == want
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    symbols, freqs = op1_rans.quantise(Counter({5: 1000, 9: 1, 11: 3}))
    assert freqs.sum() == 1 << op1_rans.SCALE_BITS and freqs.min() >= 1
    coder = op1_rans.Coder(symbols, freqs, lanes=8, segment=16)
    ids = np.array([5] * 50 + [9, 11], np.uint16)
    payload, states, places, crcs = coder.encode(ids)
    assert coder.decode(len(ids), payload, states, places, crcs).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        coder.decode(len(ids), payload, states, places, [0] * len(crcs))
    a, b = b"abc", b"defgh"
    assert op1_rans.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


# 2


def test_tools(spark):
    schemas = {"f": {"a": ("BIGINT", True), "b": ("STRING", False)}}
    kind = "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>, extra int"
    calls = spark.createDataFrame(
        [
            (1, 3, "c", "f", '{"b":"x", "a":1}', ["b", "a"], 0), (1, 1, "b", "f", '{"a":"1"}', ["a"], 0), (1, 2, "a", "f", '{"z":1}', [], 0), (1, 2, "a", "f", '{"z":1}', [], 0),
            (1, 4, "d", "g", "[", ["d"], 0), (None, None, "e", None, None, None, 0), (1, 5, None, "f", "{}", [], 0), (1, 6, "h", "f", "{", ["nowhere"], 0),
        ], kind,
    )
    results = spark.createDataFrame([(1, 4, "a", "r"), (1, 5, "a", "r2"), (1, 9, "z", None), (2, 1, None, "x")], "conv_id long, turn long, call_id string, content string")
    rows = {r.call_id: r for r in op2_tools.op2_tools(calls, results, schemas).collect()}
    assert {k: (r.level, r.errors) for k, r in rows.items()} == {
        "a": (0, ["missing a", "unknown z", "duplicate call", "duplicate result"]),
        "b": (1, ["type of a", "no result"]),
        "c": (2, ["no result"]),
        "d": (None, ["unknown tool", "no result", "needs not met"]),
        "e": (0, ["unknown tool", "no result"]),
        "h": (None, ["malformed arguments", "no result", "needs not met"]),
        "z": (None, ["no call"]),
    }
    assert [k for k, r in sorted(rows.items(), key=lambda x: x[1].position) if r.conv_id == 1] == ["a", "b", "c", "d", "h", "z"]
    assert rows["c"].json == '{"arguments":{"a":1,"b":"x"},"call_id":"c","errors":["no result"],"name":"f","result":null}'
    assert op2_tools.op2_tools(calls.limit(0), results.limit(0), schemas).collect() == []


def test_tools_keep_every_call_and_result(spark):
    """Identifiers used again in other conversations, and repeated in one: no text is lost."""
    calls = [(c, 1, "call_1", "f", f'{{"a":{c}}}', []) for c in range(5)] + [(0, 3, "call_1", "f", '{"a":70}', []), (0, 4, "call_2", "f", '{"a":71}', ["call_1"]), (0, 5, None, "f", '{"a":72}', [])]
    results = [(c, 2, "call_1", f"r{c}") for c in range(5)] + [(1, 3, "call_1", "r80"), (1, 4, None, "r81")]
    calls = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>")
    results = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    rows = op2_tools.op2_tools(calls, results, {"f": {"a": ("BIGINT", True)}}, unnamed=True).collect()
    got = sorted((r.conv_id, r.position, r.call_id, json.loads(r.json)["arguments"], json.loads(r.json)["result"], r.level, tuple(r.errors)) for r in rows)
    plain = [(c, 1, "call_1", {"a": c}, f"r{c}", 0, ()) for c in (2, 3, 4)]
    assert got == [
        (0, 1, "call_1", {"a": 0}, "r0", 0, ("duplicate call",)), (0, 2, "call_1", {"a": 70}, None, 0, ("no result", "duplicate call")), (0, 3, "call_2", {"a": 71}, None, 1, ("no result",)),
        (0, 4, None, {"a": 72}, None, None, ("no identifier", "no result")), (1, 1, "call_1", {"a": 1}, "r1", 0, ("duplicate result",)),
        (1, 2, "call_1", None, "r80", None, ("no call", "duplicate result")), (1, 3, None, None, "r81", None, ("no identifier", "no call")), *plain,
    ]


def plain_levels(rows):
    needs, level, moved = {}, {}, True
    for call, n in rows:
        needs.setdefault(call, set()).update(n)
    while moved:
        new = {c: max([level[x] + 1 for x in n], default=0) for c, n in needs.items() if c not in level and all(x in level for x in n)}
        level |= new
        moved = bool(new)
    return level


def test_tool_levels_are_the_plain_ones(spark):
    """Chains, calls with several needs, cycles, repeats and unknown needs."""
    rng = random.Random(3)
    rows = [(f"n{k}", [f"n{rng.randrange(max(1, k) if rng.random() < 0.93 else 62)}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]) for k in range(60)]
    rows += [("c1", ["c2"]), ("c2", ["c1"]), ("c3", ["c1"]), ("s", ["s"]), ("n5", ["n1"]), ("null", None), *[(f"a{k}", [f"a{k - 1}"] if k else []) for k in range(150)]]
    got = op2_tools.levels(spark.createDataFrame(rows, "call_id string, needs array<string>")).collect()
    assert {r.call_id: r.level for r in got} == plain_levels([(c, n or []) for c, n in rows]) and len({r.call_id for r in got}) == len(got)


def test_tools_on_odd_rows(spark):
    """Keys of any characters, a very long text, columns named like results, null conversations and deep chains."""
    long = "x" * 300_000
    kind = "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>, level string, n_calls int, json int, k int"
    calls = spark.createDataFrame([(None, 1, "a", "f", json.dumps({"a-b.c'\"?": long}), None, "x", 1, 1, 1), (None, 2, "a2", "f", "{}", ["a"], "x", 1, 1, 1), (1, None, "b", None, "null", [None, "a"], "x", 1, 1, 1)], kind)
    results = spark.createDataFrame([(None, 3, "a", long, 1)], "conv_id long, turn long, call_id string, content string, errors int")
    rows = {(r.conv_id, r.call_id): r for r in op2_tools.op2_tools(calls, results, {"f": {"a-b.c'\"?": ("STRING", True)}}).collect()}
    assert [rows[None, "a"].errors, rows[None, "a2"].errors, rows[1, "b"].errors] == [[], ["missing a-b.c'\"?", "no result"], ["unknown tool", "no result", "needs not met"]]
    assert [rows[None, "a"].level, rows[None, "a2"].level, rows[1, "b"].level] == [0, 1, None] and json.loads(rows[None, "a"].json)["result"] == long


# 3, 4, 7: held-out accuracy on the driver's small tables


def table(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")


def test_toxicity(spark, odd, empty):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = op3_toxicity.train(docs, labels)
    rows = op3_toxicity.scored(docs, model).join(labels, "doc_id").collect()
    assert all((r.predicted == 1) == (r.score >= 0.3) and 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) >= 0.9 * len(held)
    got = op3_toxicity.scored(odd, model).collect()
    texts = {r.doc_id: r.score for r in got}
    floor = model.score(np.array([-np.inf]))[0]
    assert texts[0] == texts[1] == texts[2] == floor and texts[3] == texts[4] and all(0 <= r.score <= 1 for r in got)
    assert len(got) == len(ODD) and op3_toxicity.op3_toxicity(empty, labels).count() == 0
    assert {r.score for r in op3_toxicity.op3_toxicity(odd, labels.limit(0)).collect()} == {0.0}


def test_toxicity_learns_inserted_characters():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abdehilnorstu") for _ in range(rng.randrange(3, 9)))
    bags = [(sorted(op3_toxicity.words_of(" ".join([word() for _ in range(30)] + ["scoundrel"] * (k % 2)))), k % 2) for k in range(200)]
    model = op3_toxicity.fit(bags)

    def score(text):
        words = op3_toxicity.words_of(text)
        return model.score(np.array([op3_toxicity.margins(sorted(words), model.weights).max() + model.bias]))[0]

    for bad in ("you scoundrel", "you sco-un-drel!", "you s.c.o.u.n.d.r.e.l", "you scouxndrel", "you s c o u n d r e l"):
        assert score(bad) >= 0.3 > score("nothing to see in here")


def plain_subsequences(word):
    out = Counter()
    for i in range(len(word)):
        for j in range(i + 1, len(word)):
            for k in range(j + 1, min(len(word), i + op3_toxicity.SPAN)):
                out[word[i], word[j], word[k]] += op3_toxicity.DECAY ** (k - i - 2)
    return out


def plain_kernel(a, b):
    x, y = plain_subsequences(a), plain_subsequences(b)
    norm = lambda z: sum(v * v for v in z.values()) ** 0.5
    return sum(v * y[k] for k, v in x.items()) / norm(x) / norm(y)


def test_string_kernel_is_the_plain_one():
    words = ["_idiot_", "_idxiot_", "_banana_", "_an_", "_a_", "_дурак_", "_dурак_", "_馬鹿者_", "_verylongwordofmanyletters"[:24]]
    got = op3_toxicity.against(words, op3_toxicity.kernel_rows(words))
    assert np.allclose(got, [[plain_kernel(a, b) for b in words] for a in words], atol=1e-5)
    assert got[0, 5] < 0.02 and got[5, 6] > 0.3  # letters of any script stay apart


def test_machine_is_that_of_all_words():
    """Margins are those of the explicit Nyström vectors, and no clean word is left violating unseen."""
    rng = random.Random(4)
    word = lambda: "_" + "".join(rng.choice("abdehilnorstu") for _ in range(rng.randrange(3, 9))) + "_"
    vocabulary = sorted({word() for _ in range(300)})
    landmarks = op3_toxicity.kernel_rows(vocabulary[:20])
    k = op3_toxicity.against(vocabulary[:20], landmarks).astype(float)
    value, vector = np.linalg.eigh(k)
    root = vector @ np.diag(1 / np.sqrt(value)) @ vector.T
    x = op3_toxicity.against(vocabulary, landmarks) @ root
    y = np.where(np.arange(len(vocabulary)) % 7 == 0, 1.0, -1.0)
    cost = np.ones(len(vocabulary))
    w = op3_toxicity.machine(x.astype(np.float32), y, cost)
    full = np.c_[x, np.ones(len(x))]
    gradient = lambda w: np.r_[0.1 * w[:-1], 1e-3 * w[-1]] - 2 * full.T @ (cost * y * np.maximum(0, 1 - y * (full @ w)))
    assert np.abs(gradient(w)).max() < 1e-3
    weights = np.zeros(1 << op3_toxicity.BITS, np.float32)
    for a, (slot, unit) in zip(root @ w[:-1], landmarks):
        np.add.at(weights, slot, (a * unit).astype(np.float32))
    assert np.allclose(op3_toxicity.margins(vocabulary, weights), x @ w[:-1], atol=1e-3)


def test_words_of_any_length_are_read_whole():
    """Windows leave out no subsequence within the span, so words that differ late differ, in training too."""
    long = "".join(random.Random(5).choice("abcdefgh") for _ in range(200))
    seen = set()
    for part in op3_toxicity.windows("_" + long + "_"):
        seen |= set(plain_subsequences(part))
    assert seen == set(plain_subsequences("_" + long + "_"))
    bags = [(sorted(op3_toxicity.words_of("harmlessbeginningofword" + ("scoundrel" if k % 2 else "gentleman"))), k % 2) for k in range(60)]
    model = op3_toxicity.fit(bags)
    assert model.score(np.array([op3_toxicity.margins(bags[1][0], model.weights).max() + model.bias]))[0] > 0.5 > model.score(np.array([op3_toxicity.margins(bags[0][0], model.weights).max() + model.bias]))[0]


def plain_code_length(texts, order, text):
    """PPM, method C, by dictionaries, over bytes the training saw."""
    seen: dict[bytes, Counter] = {}
    for k in range(order + 1):
        for i in range(len(texts) - k):
            seen.setdefault(texts[i : i + k], Counter())[texts[i + k]] += 1
    padded, total = b" " * order + text, 0.0
    for i in range(order, len(padded)):
        for k in range(order, -1, -1):
            found = seen.get(padded[i - k : i])
            if not found:
                continue
            n, d = sum(found.values()), len(found)
            if padded[i] in found:
                total -= np.log2(found[padded[i]] / (n + d))
                break
            total -= np.log2(d / (n + d))
        else:
            total += 8
    return total


def test_broken_and_spaced_words_of_any_length():
    """Runs longer than any bound, any number of marks between parts; single letters beside longer words stay apart."""
    spaced = " ".join("abcdefghijklmnopqrstu") + " " + " ".join("idiot")
    joined = "".join(w.strip("_") for w in op3_toxicity.windows("_" + spaced.replace(" ", "") + "_")[-1:])
    assert joined.endswith("idiot") and any(w.endswith("idiot_") for w in op3_toxicity.words_of(spaced))
    for text in ("id....iot", "i....d....i....o....t", "i-d-i-o-t", "i d i o t", "you i d i o t!", "i.d.i.o.t are"):
        assert "_idiot_" in op3_toxicity.words_of(text), text
    assert "_idiot_" not in op3_toxicity.words_of("is a big lot") and op3_toxicity.words_of("a b") == {"_a_", "_b_"}
    start = time.process_time()
    op3_toxicity.words_of("a " * 300_000 + "a." * 300_000 + "ab..." * 100_000)
    assert time.process_time() - start < 20


def test_language(spark, odd, empty):
    trees = op4_language.Trees({"x": b" abracadabra abba ", "y": b" banana bandana "}, 3)
    for text in (b" abra ", b" bandabra ", b" naan ", b" cab "):
        got = trees.code_lengths([b" junk ", text])[1]
        assert np.allclose(got, [plain_code_length(t, 3, text) for t in (b" abracadabra abba ", b" banana bandana ")], atol=1e-4)
    docs = table(spark, "documents")
    model = op4_language.train(docs)
    rows = op4_language.predicted(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    got = {r.doc_id: r for r in op4_language.predicted(odd, model).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[3].lang_pred in {"de", "en", "es", "fr"} and all(0 <= r.score <= 1 for r in got.values())
    assert op4_language.op4_language(empty).count() == 0
    numbers = spark.createDataFrame([(1, "½ ²", "en"), (2, "①Ⅷ", "en"), (3, "3 _ !", "en"), (4, "½é", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred == "und" for r in op4_language.predicted(numbers, model).collect()} == {1: True, 2: True, 3: True, 4: False}
    assert {r.lang_pred for r in op4_language.op4_language(docs.withColumn("lang", docs.lang.cast("string").substr(1, 0)).where("lang is null")).collect()} <= {"und"}
    nobody = op4_language.op4_language(odd.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {(r.lang_pred, r.score) for r in nobody} <= {("und", 0.0)} and len(nobody) == len(ODD)


def test_letters_keep_their_marks():
    assert op4_language.letters("हिन्दी  में, ५ और १").decode() == " हिन्दी में और "
    assert op4_language.letters("e\u0301te\u0301 \u0301x 1\u0301 Ⅷ\u0301y ½").decode() == " e\u0301te\u0301 x y "
    assert op4_language.letters("\u0301 \u0301 12") == b"" and op4_language.letters("A1b_c-É½d").decode() == " a b c é d "


def test_language_sample_is_the_least_marks(spark):
    """A language that holds nearly all rows, repeated ids too: the sample is that of a plain sort."""
    docs = spark.range(3000).selectExpr("id % 2500 as doc_id", "concat('w', id) as text", "if(id % 50 = 0, 'xx', 'yy') as lang")
    trees = op4_language.train(docs, 40)
    rows = docs.selectExpr("doc_id", "text", "lang", "xxhash64(doc_id) as mark").collect()
    for name in ("xx", "yy"):
        mine = sorted((r.mark, r.doc_id, r.text) for r in rows if r.lang == name and zlib.crc32(str(r.doc_id).encode()) % 5 != 0)[:40]
        want = op4_language.Trees({name: b"".join(op4_language.letters(t) for *_, t in mine)})
        assert all(np.array_equal(a, b) for x, y in zip(trees.levels[trees.languages.index(name)], want.levels[0]) for a, b in zip(x, y))


def test_quality(spark, odd, empty):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rows = op7_quality.op7_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all((r.predicted == 1) == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    got = op7_quality.op7_quality(odd, labels).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == len(ODD) and by[0] == by[1] and all(0 <= r.score <= 1 for r in got) and op7_quality.op7_quality(empty, labels).count() == 0
    assert {r.score for r in op7_quality.op7_quality(odd, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in op7_quality.op7_quality(docs, labels.where("quality = 1")).limit(9).collect()} == {1.0}


def test_statistics_are_the_plain_ones(spark, odd):
    """Every statistic of the rules against one counted in Python."""
    docs = odd.unionByName(table(spark, "documents").where("doc_id < 120"), allowMissingColumns=True)
    stats, names = op7_quality.statistics(docs, ("doc_id", "text"))

    def plain(text):
        t = text or ""
        n, words, lines = max(1, len(t)), re.sub("[\x00-\x20]+", " ", t).split(" "), t.split("\n")
        count = lambda marks: sum(c in marks for c in t) / n
        tokens = [m for m in re.finditer(r"\S+", t, re.ASCII)]
        repeats, at = 0, 0
        while at < len(tokens) - 1:
            a, b = tokens[at], tokens[at + 1]
            repeats += a.group() == b.group() and b.start() == a.end() + 1
            at += 1
        return [
            len(t), len(t) / len(words), sum(unicodedata.category(c)[0] == "L" for c in t) / n, sum(unicodedata.category(c) == "Lu" for c in t) / n, count("0123456789"),
            count("!?|#$%&*<>{}[]=_~^+@/\\"), count("|"), count("!"), count(".,;:"), len(lines) / n, len(set(words)) / len(words), len(set(lines)) / len(lines), repeats / len(words),
        ]

    for r in stats.collect():
        assert np.allclose([r[k] for k in names], plain(r.text)), (r.doc_id, dict(zip(names, zip([r[k] for k in names], plain(r.text)))))


def test_rules_as_columns_and_in_numpy_agree(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(int)
    rules = op7_quality.fit(x, y, ["s_a", "s_b", "s_c"])
    score = 1 / (1 + np.exp(-(rules.offset + sum(w * op7_quality.holds(r, x) for r, w in zip(rules.rules, rules.weights)))))
    df = spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(x)], "k int, s_a double, s_b double, s_c double")
    got = [r.s for r in df.select("k", rules.column().alias("s")).orderBy("k").collect()]
    assert np.allclose(got, score) and ((score >= 0.5) == y).mean() > 0.95 and len(rules.rules) < 40


# 5


def plain_components(fps, bits=2):
    parent = list(range(len(fps)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def test_simhash_links(spark):
    rng = random.Random(3)
    values = []
    for _ in range(30):
        v = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            values.append(v)
            for bit in rng.sample(range(64), rng.randrange(0, 4)):
                v ^= 1 << bit
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = plain_components(values)
    groups = {frozenset(signed[k] for k in range(len(values)) if want[k] == r) for r in set(want)}
    for dense in (64, 0):  # 0: every cell counts as crowded
        roots = {r.node: r.root for r in op5_simhash.components(op5_simhash.links(df, dense)).collect()}
        by: dict[int, set] = {}
        for v in signed:
            by.setdefault(roots.get(v, v), set()).add(v)
        assert {frozenset(g) for g in by.values()} == groups


def test_simhash_broadcasts_nothing(spark, monkeypatch, odd):
    """Of a generator's rows, and of compressed files, Spark knows no size: whatever it takes them for, they don't go through the driver."""
    plans, write = [], scratch.write
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(scratch, "write", lambda df, name: planned(df) or write(df, name))
    rng = random.Random(5)
    around = [1 << 40 ^ a ^ b for a in (1 << k for k in range(20)) for b in (0, 3)]  # crowded cells as well
    values = spark.createDataFrame([(x,) for x in {*around, *(rng.getrandbits(63) for _ in range(200))}], "fp long")
    planned(op5_simhash.components(op5_simhash.links(values, 8)))
    planned(op5_simhash.op5_simhash(odd))
    planned(op5_simhash.first_of_groups(odd.select("doc_id", "text")))
    assert sum("SortMergeJoin" in x for x in plans) >= 8 and not [x for x in plans if "Broadcast" in x or "ShuffledHashJoin" in x]


def test_simhash_odd_rows(odd, empty):
    import xxhash

    def plain(text):
        words = (text or "").encode().lower().split()
        if not words:
            return 0
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = op5_simhash.op5_simhash(odd).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint) for r in rows) == sorted((r[0] if r[0] is not None else -1, f"{plain(r[1]):016x}") for r in ODD)
    ids = {r.doc_id: r.component_id for r in rows}
    assert ids[1] == ids[2] == ids[0] == 0 and ids[4] == ids[3] == 3 and ids[None] is None and ids[6] == 6
    assert op5_simhash.op5_simhash(empty).collect() == []


def test_similar_groups(spark, odd, empty):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(300)]
        texts.append(base)
        near = list(base)
        for k in rng.sample(range(300), 4):
            near[k] = "changed"
        texts.append(near)
        far = [rng.choice(words) if rng.random() < 0.2 else w for w in base]
        texts.append(far)
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")

    def shingles(t):
        return {tuple(t[k : k + 5]) for k in range(len(t) - 4)}

    sim = lambda a, b: len(a & b) / len(a | b)
    sets = [shingles(t) for t in texts]
    assert all(sim(sets[3 * k], sets[3 * k + 1]) > 0.85 > 0.8 > sim(sets[3 * k], sets[3 * k + 2]) for k in range(12))
    kept = {r.doc_id for r in op5_simhash.first_of_groups(docs).collect()}
    assert kept == {k for k in range(36) if k % 3 != 1}
    stay = op5_simhash.first_of_groups(odd).collect()
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in stay) == [-1, 0, 3, 5, 6, 7] and set(stay[0].asDict()) == set(odd.columns)
    assert op5_simhash.first_of_groups(empty).count() == 0


def _plain_groups(texts, shingle=5, least=0.8):
    """All pairs compared on whole shingle sets; the texts that come first of their component."""
    sets = [{tuple(t[k : k + shingle]) for k in range(len(t) - shingle + 1)} for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return {k for k, r in enumerate(root) if k == r}


def test_similar_compares_all_of_a_crowded_group(spark):
    """Texts with one long passage in common, and a near copy of each: no two ends of a group are like all of it."""
    rng = random.Random(11)
    passage, texts = [f"p{k}" for k in range(200)], []
    for k in range(60):
        base = passage + [f"w{k}x{j}" for j in range(44)]
        near = list(base)
        for place in (205, 214, 223, 232):
            near[place] = "changed"
        texts += [base, near]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    expected = _plain_groups(texts)
    assert len(expected) == 60
    assert {r.doc_id for r in op5_simhash.first_of_groups(docs).collect()} == expected


def test_similar_measures_whole_texts(spark):
    """Similarities close to 0.8 on both sides, of sets far larger than any sketch."""
    rng = random.Random(12)
    texts = []
    for k in range(40):
        base = [f"v{k}x{j}" for j in range(454)]  # 450 shingles
        near = list(base)
        for place in range(5, 5 + 20 * (9 + k % 3), 20):  # 9, 10 or 11 changes of 5 shingles: similarity 0.818, 0.8 and 0.782
            near[place] = "changed"
        texts += [base, near]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    expected = _plain_groups(texts)
    assert len(expected) == 53
    assert {r.doc_id for r in op5_simhash.first_of_groups(docs).collect()} == expected


# 6


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
    return min(row)


def test_myers_is_the_plain_distance():
    rng = random.Random(6)
    for _ in range(200):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 70)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 90)))
        got = op6_decontaminate.myers(op6_decontaminate.masks(item), len(item), text, len(item))
        assert (got[0] if got else len(item)) == plain_distance(item, text)


def test_decontamination(spark, odd, empty):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    items = [" ".join(word() for _ in range(40)) for _ in range(6)]

    def edited(s, n):
        s = list(s)
        for _ in range(n):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([[], [rng.choice("xyz")], [s[k], "z"]])
        return "".join(s)

    docs = []
    for k in range(60):
        item, noise = items[k % 6], " ".join(word() for _ in range(80))
        n = rng.randrange(0, 2 * op6_decontaminate.budget(len(item)))
        docs.append((k, noise[:200] + " " + edited(item, n).upper() + "!! " + noise[200:] if k % 3 else noise))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (6, None), (7, ""), (8, "short"), (0, items[0]), (9, "!?")], "item_id long, text string")
    want = {(d, i) for d, t in docs for i, s in enumerate(items) if plain_distance(op6_decontaminate.normal(s), op6_decontaminate.normal(t)) <= op6_decontaminate.budget(len(s))}
    got = op6_decontaminate.op6_decontaminate(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 10
    assert {r.doc_id for r in op6_decontaminate.clean(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert {(r.doc_id, r.item_id) for r in op6_decontaminate.matches(df, bench, block=300).collect()} == want
    assert op6_decontaminate.clean(odd, bench).count() == len(ODD) and op6_decontaminate.op6_decontaminate(empty, bench).count() == 0 and op6_decontaminate.op6_decontaminate(odd, bench.limit(0)).count() == 0


def test_short_items_and_places(spark):
    """Short items match as whole words; places are those of the stretch at the distance; one item's matches don't overlap."""
    match = lambda item, text: [x[1:] for x in op6_decontaminate.Matcher([(1, item)]).matches(text)]
    assert match("yes", "yes sir yesterday eyes yes") == [(0, 3, 0), (23, 26, 0)] and match("2 2 4", "12 2 4 2 2 4") == [(7, 12, 0)]
    assert match("ab" * 30, "ab" * 70) == [(0, 60, 0), (60, 120, 0)]
    rng, edited = random.Random(4), 0
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(40, 80)))
        s = list(item)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([[], ["x"], [s[k], "y"]])
        text = "".join(rng.choice("abc ") for _ in range(20)) + "".join(s) + "".join(rng.choice("abc ") for _ in range(20))
        for a, b, edits in match(item, text):
            assert whole_distance(item, text[a:b]) == edits <= op6_decontaminate.budget(len(item))
            edited += edits > 0
    assert edited > 50
    docs = spark.createDataFrame([(1, "the answer: YES"), (2, "eyes"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "Yes!"), (6, "yes")], "item_id long, text string")
    assert {tuple(r) for r in op6_decontaminate.op6_decontaminate(docs, bench).collect()} == {(1, 5, 11, 14, 0), (1, 6, 11, 14, 0)}
    assert {r.doc_id for r in op6_decontaminate.clean(docs, bench, block=1).collect()} == {2, 3}


def whole_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


# 8


def plain_log_probability(net, left, right, token):
    """The network's definition, one place at a time."""
    h = np.tanh(net.bias.astype(float) + sum(net.near[k][n].astype(float) for k, n in enumerate([*left, *right])))
    c, w = divmod(int(net.slot[token]), net.size)
    soft = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    return soft(h @ net.to_class + net.class_bias)[c] + soft(h @ net.to_word[c] + net.word_bias[c])[w]


def small_network():
    return op8_pseudolikelihood.Network(list("abcdefg"), [9, 8, 7, 6, 5, 4, 3], 5, size=3, hidden=6)


def test_network_is_the_plain_one():
    net = small_network()
    framed = net.framed(np.array([1, 2, 0, 7, 3, 3], np.int32))
    at = np.arange(2, 8)
    got = net.log_probabilities(net.windows(framed, at))
    assert np.allclose(got, [plain_log_probability(net, framed[k - 2 : k], framed[k + 1 : k + 3], framed[k]) for k in at], atol=1e-5)
    # Probabilities of all tokens at a place sum to one, the rare one's included.
    total = sum(np.exp(plain_log_probability(net, framed[2:4], framed[5:7], token)) for token in range(8))
    assert abs(total - 1) < 1e-6


def test_gradient_is_the_numeric_one():
    net, rng = small_network(), np.random.default_rng(2)
    for part in op8_pseudolikelihood.PARTS:
        setattr(net, part, getattr(net, part).astype(np.float64))
    rows = net.windows(net.framed(rng.integers(0, 8, 40).astype(np.int32)), np.arange(2, 42))
    loss = lambda: -np.mean([plain_log_probability(net, r[:2], r[2:4], r[4]) for r in rows])
    steps = {}
    trainer = net.trainer()
    trainer._step = lambda part, gradient, at=...: steps.setdefault(part, []).append((at, gradient))
    trainer.batch(rows)
    for part in op8_pseudolikelihood.PARTS:
        full = np.zeros_like(getattr(net, part))
        for at, gradient in steps[part]:
            full[at] += gradient
        for place in [tuple(rng.integers(0, n) for n in full.shape) for _ in range(6)]:
            was = getattr(net, part)[place]
            values = []
            for d in (1e-4, -1e-4):
                getattr(net, part)[place] = was + d
                values.append(loss())
            getattr(net, part)[place] = was
            assert abs((values[0] - values[1]) / 2e-4 - full[place]) < 1e-4, part


def test_pseudolikelihood(spark, odd, empty):
    net, rng = small_network(), np.random.default_rng(1)
    texts = [np.array([1, 2, 3, 1, 2, 3, 1, 2, 3, int(rng.integers(0, 8))], np.int32) for _ in range(200)]
    rows = np.concatenate([net.windows(net.framed(t), np.arange(2, 12)) for t in texts])
    before, trainer = net.log_probabilities(rows).mean(), net.trainer()
    for _ in range(20):
        for k in range(0, len(rows), 64):
            trainer.batch(rows[k : k + 64])
    assert net.log_probabilities(rows).mean() > before + 0.5
    model = op8_pseudolikelihood.train(table(spark, "documents").limit(200))
    rows = {r.doc_id: r for r in op8_pseudolikelihood.scored(odd, model).collect()}
    assert rows[0].n_tokens == rows[1].n_tokens == rows[2].n_tokens == 0 and rows[0].mean is None and rows[0].log_likelihood == 0 and rows[3].n_tokens == 8 and rows[3].log_likelihood < 0
    assert op8_pseudolikelihood.op8_pseudolikelihood(empty).count() == 0
    one = op8_pseudolikelihood.scored(odd.where("doc_id = 3"), model).first()
    assert abs(one.log_likelihood - rows[3].log_likelihood) < 1e-3 and abs(rows[3].log_likelihood - rows[4].log_likelihood) < 1e-3
    # A whole document by the plain definition.
    tokens = op8_pseudolikelihood.tokens_of("one two three four five six seven eight")
    number = {w: k + 1 for k, w in enumerate(model.words)}
    framed = model.framed(np.array([number.get(t, 0) for t in tokens], np.int32))
    letters = lambda t: sum(float(model.rare.logs[a, b]) for a, b in zip([256, *t.encode()], [*t.encode(), 256]))
    spell = lambda t: math.log(model.rare.known.get(t, 0) + (1 - model.rare.share) * math.exp(letters(t)))
    plain = sum(plain_log_probability(model, framed[k : k + 2], framed[k + 3 : k + 5], framed[k + 2]) + (0 if t in number else spell(t)) for k, t in enumerate(tokens))
    assert abs(plain - one.log_likelihood) < 1e-2


def test_pseudolikelihood_learns_from_every_document(spark):
    """Rare words differ by their letters and by how often the corpus has them, and every document changes the weights."""
    docs = spark.createDataFrame([(k, f"one{k % 7} two {'three' if k % 3 else 'four'}") for k in range(1500)], "doc_id long, text string")
    other = spark.createDataFrame([(2000, "two q"), (2001, "two 3"), (2002, "two zyx"), (2003, "two xyz")], "doc_id long, text string")
    more = docs.unionByName(spark.createDataFrame([(3000 + k, "xyz zyx " + "xyz " * 9) for k in range(40)], docs.schema))
    rows = {r.doc_id: r for r in op8_pseudolikelihood.scored(other, op8_pseudolikelihood.train(docs, vocabulary=4)).collect()}
    assert rows[2000].log_likelihood < rows[2001].log_likelihood
    model = op8_pseudolikelihood.train(more, vocabulary=3, share=1.0)
    rows = {r.doc_id: r for r in op8_pseudolikelihood.scored(other, model).collect()}
    assert rows[2002].log_likelihood < rows[2003].log_likelihood
    fewer = op8_pseudolikelihood.train(more.where("doc_id != 3039"), vocabulary=3, share=1.0)
    assert not np.array_equal(model.to_word, fewer.to_word)
    logs = op8_pseudolikelihood.byte_logs(np.bincount([256 * 257 + 97, 97 * 257 + 98, 98 * 257 + 256], [3, 2, 2], 257 * 257))
    assert np.allclose(np.exp(logs.astype(float)).sum(axis=1)[[256, 97, 98]], 1, atol=1e-4) and op8_pseudolikelihood.spelt(logs, [b"ab"])[0] > op8_pseudolikelihood.spelt(logs, [b"ba"])[0]


# 9


def test_topk(spark):
    rng = np.random.default_rng(9)
    rows = [(k, [float(x) for x in rng.normal(size=24)], 1) for k in range(0, 700)]
    rows += [(k, rows[5][1], 1) for k in range(700, 730)]  # ties
    rows += [(300, rows[300][1], 1), (300, rows[7][1], 1), (500, rows[8][1], 1)]  # repeated ids, one a whole row
    rows += [(1000, None, 1), (1100, [1.0, None], 1), (1200, [float("nan")] * 24, 1), (1300, [float("inf")] * 24, 1), (None, [1.0] * 24, 1), (1400, [2.0], 1), (1500, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    fine = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int).tolist()) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for x, (i, q) in enumerate(fine):
        if i % 100 == 0:  # every row is a query, its candidates all rows but itself
            ranked = sorted(((-sum(a * b for a, b in zip(q, v)), j) for y, (j, v) in enumerate(fine) if y != x))[:10]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(ranked, 1)]
    assert sorted(tuple(r) for r in op9_topk.op9_topk(df).collect()) == sorted(want)
    assert sorted(tuple(r) for r in op9_topk.op9_topk(df, block=3 * 24 * 8).collect()) == sorted(want)
    assert op9_topk.op9_topk(df.limit(0)).collect() == []
    q = rng.integers(-50, 50, (2, 64))
    x = rng.integers(-50, 50, (3000, 64)) // np.arange(1, 65)
    best = op9_topk.Best(2, 5)
    op9_topk.search(best, q, np.arange(1000), x[:1000])
    assert op9_topk.search(best, q, np.arange(1000, 3000), x[1000:]) > 0  # the bound leaves products out


# 10


def test_mix(spark, odd, empty):
    rng = random.Random(10)
    docs = [(k, "w " * rng.randrange(0, 60), rng.choice(["a", "b", "c", None]) if k % 5 else "small") for k in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = op10_mix.op10_mix(df).collect()
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(t.split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(target[s] for s in names if s not in free)
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    target |= share
    of = {d: s for d, _, s in docs}
    taken = Counter()
    for r in rows:
        assert abs(r.target - target[of[r.doc_id]]) < 1e-6 and r.source_size == sizes[of[r.doc_id]] and r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 60 for s in names)
    assert sorted(rows) == sorted(op10_mix.op10_mix(df.repartition(7), buckets=16).collect())
    assert op10_mix.op10_mix(odd).count() == len(ODD) and op10_mix.op10_mix(empty).count() == 0


def test_mix_inclusion_is_that_of_the_size_class(spark):
    """Expected copies are in proportion to the binary digits of the size, and add up to the target; whole parts are certain."""
    rng = random.Random(14)
    sizes = [rng.choice([1, 3, 10, 60, 200]) for _ in range(6000)]
    df = spark.createDataFrame([(k, "w " * n, "b" if k % 4 else "a") for k, n in enumerate(sizes)], "doc_id long, text string, source string")
    rows = [r for r in op10_mix.op10_mix(df, weights=(1.0, 1.0)).collect() if r.doc_id % 4]
    digits = {n: len(bin(n)) - 2 for n in sizes}
    words = {n: sum(r.size for r in rows if r.size == n) for n in digits}
    rate = rows[0].target / sum(digits[n] * words[n] for n in words)
    for n, d in digits.items():
        own = [r.copies for r in rows if r.size == n]
        assert abs(sum(own) / len(own) - rate * d) < 0.06 and set(own) <= {int(rate * d), int(rate * d) + 1}, n
        half = [sum(r.copies for r in rows if r.size == n and (r.doc_id < 3000) == low) / max(1, sum(r.size == n and (r.doc_id < 3000) == low for r in rows)) for low in (True, False)]
        assert abs(half[0] - half[1]) < 0.12
    assert len({round(rate * d, 3) % 1 for d in digits.values()}) > 2  # odds differ


def test_mix_on_rows_alike(spark):
    """A third of all rows are one document: as many of them are taken as fit; values of odd rows."""
    rows = [(k, "w " * (k % 9 + 1), "a") for k in range(400)] + [(7000, "x y z", "a")] * 200 + [(k, "w w", "b") for k in range(9000, 9100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op10_mix.op10_mix(df).collect()
    assert len(got) == len(rows) and abs(sum(r.taken for r in got if r.doc_id < 9000) - got[0].target) <= 9 if got[0].doc_id < 9000 else True
    for name in ("a", "b"):
        mine = [r for r in got if (r.doc_id >= 9000) == (name == "b")]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 9, name
    names = sorted(op10_mix.mixed(df.withColumn("size", df.doc_id)).collect())
    assert Counter(r.doc_id for r in names) == +Counter({k: sum(r.copies for r in got if r.doc_id == k) for k in {r.doc_id for r in got}})


def test_mix_targets_with_many_sources(spark):
    """Filling in rounds gives the level that filling in order does."""
    sizes = [(f"s{k:03}" if k else None, 3 ** (k % 9) + k) for k in range(60)]
    got = {r.source: r.target for r in op10_mix.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    names = sorted(got, key=lambda s: (s is None, s or ""))
    weight, size = {s: k % 3 + 1 for k, s in enumerate(names)}, dict(sizes)
    capped = set()
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        over = {s for s in names if s not in capped and level * weight[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    assert all(abs(got[s] - (3 * size[s] if s in capped else level * weight[s])) < 1e-6 for s in names) and capped


def test_rare_tokens_are_a_distribution():
    """Over all strings of two letters the probabilities add up to one, however many of them are known by their counts."""
    rng = np.random.default_rng(4)
    pairs = np.zeros((257, 257), np.int64)
    pairs[256, [97, 98]] = [5, 3]
    pairs[97, [97, 98, 256]] = [1, 2, 9]
    pairs[98, [97, 256]] = [1, 9]
    logs = op8_pseudolikelihood.byte_logs(pairs.ravel())
    logs = np.where(pairs > 0, np.log(np.maximum(pairs, 1) / np.maximum(pairs.sum(axis=1, keepdims=True), 1)), -np.inf)  # no other bytes, so that the strings can be listed
    strings = ["".join(x) for n in range(1, 15) for x in itertools.product("ab", repeat=n)]
    for known in ({}, {"a": 4, "ba": 2, "bb": 1}, dict(zip(rng.choice(strings[:60], 30, replace=False).tolist(), range(1, 31)))):
        total = sum(known.values()) + 6
        p = np.exp(op8_pseudolikelihood.Rare(known, total, logs).log_probabilities(strings))
        assert abs(p.sum() - 1) < 1e-3 and all(p[strings.index(k)] > p[strings.index("ab" * 5)] for k in known)


def test_training_is_alike_however_the_input_is_split(spark, monkeypatch):
    """Several groups, averaged by slices of a few weights; every text has a place that is trained on."""
    monkeypatch.setattr(op8_pseudolikelihood, "GROUP", 400)
    monkeypatch.setattr(op8_pseudolikelihood, "SLICE", 1000)
    monkeypatch.setattr(op8_pseudolikelihood, "FAN", 2)
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, " ".join(rng.choice(["one", "two", "three", "four", "rare" + "x" * rng.randrange(4)]) for _ in range(rng.randrange(1, 30)))) for k in range(120)], "doc_id long, text string")
    models = [op8_pseudolikelihood.train(d, vocabulary=4) for d in (docs.coalesce(1), docs.repartition(7))]
    assert all(np.array_equal(getattr(models[0], k), getattr(models[1], k)) for k in op8_pseudolikelihood.PARTS) and models[0].rare.known == models[1].rare.known
    assert all(len(op8_pseudolikelihood.masked_places(text, n)) >= 1 for text in ("a", "b c", "漢") for n in range(1, 30)) and len(op8_pseudolikelihood.masked_places("", 0)) == 0


def test_lasso_meets_its_conditions():
    """At the optimum the gradient of the loss is the penalty, against the weight's sign, where a weight is not zero, and no larger elsewhere."""
    rng = np.random.default_rng(2)
    z = rng.random((400, 25)) < rng.uniform(0.1, 0.9, 25)
    y = (z[:, 0] & ~z[:, 1] | (rng.random(400) < 0.1)).astype(int)
    weight = rng.uniform(0.5, 2, 400)
    for penalty in (0.004, 0.03):
        w, offset = op7_quality.lasso(z, y, weight, penalty, steps=6000)
        p = 1 / (1 + np.exp(-(z @ w + offset)))
        g = z.T @ (weight / weight.sum() * (p - y))
        on = np.abs(w) > 1e-8
        assert on.any() and not on.all()
        assert np.allclose(g[on], -penalty * np.sign(w[on]), atol=1e-5) and (np.abs(g[~on]) <= penalty + 1e-5).all()
        assert abs((weight * (p - y)).sum() / weight.sum()) < 1e-5


def test_trees_take_the_best_split():
    """The first split is the one of all statistics and bounds that leaves the least weighted squares, found one by one."""
    rng = np.random.default_rng(7)
    for _ in range(10):
        x = rng.normal(size=(60, 4)).round(1)
        gradient, weight = x[:, rng.integers(4)] + rng.normal(size=60), rng.uniform(0.2, 2, 60)
        bins = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 9)[1:-1])) for k in range(4)]
        binned = np.stack([np.searchsorted(b, x[:, k], side="left") for k, b in enumerate(bins)], axis=1)
        paths, value = op7_quality.grow(x, bins, binned, gradient, weight, 1)

        def left(rows):
            mean = (gradient[rows] * weight[rows]).sum() / weight[rows].sum()
            return (weight[rows] * (gradient[rows] - mean) ** 2).sum()

        sums = {(k, float(b)): left(x[:, k] <= b) + left(x[:, k] > b) for k in range(4) for b in bins[k] if 8 <= (x[:, k] <= b).sum() <= 52}
        (k, above, bound), = paths[0]
        assert not above and sums[k, bound] <= min(sums.values()) + 1e-9
        side = x[:, k] <= bound
        assert np.allclose(value[side], (gradient[side] * weight[side]).sum() / weight[side].sum())
