"""Hand vectors, edge cases and round trips."""

import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import canonical, labels
from lodestone.operators import chat, digest, metrics, reports, selection, shards, tensors, text, tokenizer
from lodestone.sources import files, records, sinks


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_sample_budget(spark):
    df = spark.createDataFrame([(0, "alpha"), (1, ""), (2, "alpha"), (3, "beta"), (4, "gamma")], "idx long, text string")
    got = text.budget_accounting(df, "text", "idx", 9).first().asDict()
    assert got == {"scanned": 4, "kept": 2, "duplicates": 1, "empties": 1, "kept_bytes": 9, "next_index": 4}
    assert [r[0] for r in rows(text.budget_prefix(df, "text", "idx", 9).select("idx"), "idx")] == [0, 3]
    utf8 = spark.createDataFrame([(0, "naïve"), (1, "café")], "idx long, text string")
    assert text.budget_accounting(utf8, "text", "idx", 10).first()["kept"] == 2


def test_cap_keeps_the_first(spark):
    df = spark.createDataFrame([(0, "x" * 50), (1, "y"), (2, "z")], "idx long, text string")
    assert [r[0] for r in rows(text.cap_prefix(df, "text", "idx", 10), "idx")] == [0]


def test_split_needs_no_order(spark):
    policy = text.SplitPolicy(9, 4, 1, 1)
    docs = ["alpha", "beta", "gamma", "delta"]
    expect = {}
    for d in docs:
        h = hashlib.sha256(d.encode()).hexdigest()
        b = int.from_bytes(hashlib.sha256(f"9:{h}".encode()).digest()[:8], "big") % 4
        expect[h] = "validation" if b < 1 else "test" if b < 2 else "train"
    for order in (docs, docs[::-1]):
        got = text.hash_split(spark.createDataFrame([(d,) for d in order], "text string"), "text", policy)
        assert {r["content_hash"]: r["split"] for r in got.collect()} == expect
    bad = spark.createDataFrame([("short",), ("z" * 64,), ("A" * 64,), ("a" * 64 + "\n",), (None,)], "h string")
    assert not any(r[0] for r in bad.select(text.is_hash(F.col("h"))).collect())


def test_next_fit(spark):
    df = spark.createDataFrame([("train", i, n) for i, n in enumerate([4, 4, 6, 8, 1])], "split string, i long, n long")
    packed = shards.next_fit(df, "split", "i", "n", 8)
    assert [r[3] for r in rows(packed, "i")] == [0, 0, 1, 2, 3]
    assert [r["next_document"] for r in shards.shard_sizes(packed, "split", "i", "n").orderBy("shard").collect()] == [2, 3, 4, 5]
    with pytest.raises(Exception, match="larger than a shard"):
        shards.next_fit(df, "split", "i", "n", 7).collect()


def test_allocation(spark):
    make = lambda *r: spark.createDataFrame(list(r), "split string, available_examples long, weight double")
    got = lambda df, n: {r["split"]: r["quota"] for r in selection.largest_remainder(df, n).collect()}
    sources = make(("b", 20, 0.5), ("a", 10, 1.0))
    assert got(sources, 20) == {"b": 10, "a": 10}
    assert got(sources, 1) == {"b": 0, "a": 1}
    with pytest.raises(Exception, match="no room"):
        got(sources, 31)


def test_latest_and_gaps(spark):
    log = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.5), (2, 3, 1.0)], "step long, line long, loss double")
    assert rows(metrics.latest(log, ["step"], ["line"]), "step") == [(1, 2, 1.5), (2, 3, 1.0)]
    steps = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3)], "run string, step long")
    assert rows(metrics.gaps(steps, "run", "step"), "run") == [("a", 2, True), ("b", 2, False)]


def test_single_seed_has_no_deviation(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, 2.0), ("b", 3.0, 4.0)], "v string, x double, m double")
    got = {r["v"]: r for r in reports.summary(df, "v", "x", "m").collect()}
    assert got["a"]["deviation"] == 0.0 and got["a"]["optional_mean"] is None and got["b"]["optional_mean"] == 3.0


def test_calibration_gates(spark):
    cells = [("d", "base", 100.0, 0.0), ("d", "base", 101.0, 0.0), ("d", "fast", 120.0, 0.001), ("d", "fast", 121.0, 0.002), ("d", "wild", 100.0, 0.0), ("d", "wild", 160.0, 0.0), ("d", "off", 130.0, 0.5), ("d", "off", 130.0, 0.5)]
    df = spark.createDataFrame(cells, "architecture string, cell string, throughput double, delta double")
    got = {r["cell"]: r["promoted"] for r in reports.calibration(df, "base", 1.1, 0.05, {"delta": 0.01}).collect()}
    assert got == {"base": False, "fast": True, "wild": False, "off": False}


def test_dpo_vector(spark):
    df = spark.createDataFrame([(-2.0, -3.0, -1.0, -1.5)], "policy_chosen double, policy_rejected double, reference_chosen double, reference_rejected double")
    r = tensors.dpo(df, 0.1).first()
    assert [round(r[c], 12) for c in ("logit", "chosen_reward", "rejected_reward")] == [0.05, -0.1, -0.15]
    assert round(r["loss"], 9) == 0.668459609 or abs(r["loss"] - 0.6684596) < 1e-6


def test_zero_groups(spark):
    df = spark.createDataFrame([("z", 0.0, 1.0, None), ("n", 1.0, 0.0, 1.0)], "g string, a double, b double, d double")
    got = {r["g"]: r for r in reports.update_rms(df, "g", "a", "b", "d").collect()}
    assert got["z"]["effective_rate"] == got["z"]["angular_rate"] == 0.0 and got["z"]["gradient_rms"] == 0.0 and got["n"]["angular_rate"] == 0.0


def conversation(spark, *turns):
    return spark.createDataFrame([([{"role": r, "content": c} for r, c in turns],)], "messages array<struct<role string, content string>>")


@pytest.mark.parametrize("turns, ok", [([("system", "x")], True), ([("assistant", "x")], False), ([("user", "a"), ("user", "b")], False), ([("system", "s"), ("assistant", "b")], False), ([("user", "a"), ("assistant", "b"), ("user", "c")], True), ([("user\n", "a")], False)])
def test_grammar(spark, turns, ok):
    assert conversation(spark, *turns).select(chat.is_grammatical(F.col("messages"))).first()[0] is ok


@pytest.mark.parametrize("mark", list(chat.SPECIAL_IDS))
def test_reserved(spark, mark):
    for content in (mark, f"{mark}x", f"x{mark}", f"x{mark}y"):
        assert not conversation(spark, ("user", content)).select(chat.is_clean(F.col("messages"))).first()[0]


def test_rendering(spark):
    df = conversation(spark, ("system", "Be concise."), ("user", "Hello"), ("assistant", "Hi"))
    assert df.select(chat.rendered(F.col("messages"))).first()[0] == "<|bos|><|system|>Be concise.<|end|><|user|>Hello<|end|><|assistant|>Hi<|end|><|eos|>"


def test_truncation_is_the_loop(spark):
    """The closed form against taking pairs and tokens one by one."""
    rnd, cases = random.Random(7), []
    for k in range(150):
        roles = (["system"] if rnd.random() < 0.4 else []) + ["user", "assistant"] * rnd.randint(0, 3) + (["user"] if rnd.random() < 0.4 else [])
        parts = [(r, [8 + rnd.randrange(256) for _ in range(rnd.randint(0, 9))]) for r in roles or ["user"]]
        cases.append((k, parts, rnd.randint(1, 60)))
    df = spark.createDataFrame([(k, [{"role": r, "content": c} for r, c in p], b) for k, p, b in cases], "k int, parts array<struct<role string, content array<int>>>, b int")
    got = {r["k"]: r for r in chat.truncated(df, "parts", F.col("b")).collect()}
    for k, parts, budget in cases:
        own = [(r, list(c)) for r, c in parts]
        size = lambda: sum(len(c) + 2 for _, c in own)
        fits = True
        while size() > budget:
            start = 1 if own[0][0] == "system" else 0
            if len(own) - start >= 4:
                del own[start : start + 2]
            elif block := next((c for _, c in own if c), None):
                block.pop(0)
            else:
                fits = False
                break
        assert got[k]["fits"] is fits
        assert [(p["role"], p["content"]) for p in got[k]["parts"]] == own


#: Ids by rank of the printable characters: those of the bytes that Latin-1 prints, then U+0100 and on for the others.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {b: 8 + k for k, b in enumerate(_SHOWN + [b for b in range(256) if b not in _SHOWN])}


def test_byte_ids(spark):
    """Hand vectors: "!" is the first id, "a" 72, a blank 228; blanks, tabs and line breaks come after all printed bytes."""
    assert (BYTE[ord("!")], BYTE[ord("a")], BYTE[ord(" ")], BYTE[0], BYTE[0xAD]) == (8, 72, 228, 196, 263)
    text = "a !\n\té\u00ad\x00ÿ"
    assert spark.createDataFrame([(text,)], "t string").select(shards.byte_tokens(F.col("t"))).first()[0] == [BYTE[b] for b in text.encode()]
    assert tokenizer.BytePairs(()).encode_bytes(bytes(range(256))) == [BYTE[b] for b in range(256)]
    assert tokenizer.BytePairs(()).decode_bytes(range(8, 264)) == bytes(sorted(BYTE, key=BYTE.get))


def test_merges_by_hand(spark):
    """ "\\n\\n\\n" and "a a a" once each, mode "none". Ids: a line break 206, a blank 228, "a" 72. Counts: (206, 206) 2, (72, 228) 2,
    (228, 72) 2; the tie goes to (72, 228) = 264, which leaves 264 264 72; then (206, 206) = 265 has 2, and all others 1, of
    which (264, 72) = 266 comes first, then (264, 266), then (265, 206)."""
    df = spark.createDataFrame([("\n\n\n",), ("a a a",)], "text string")
    for most in (5_000_000, 1):
        got = tokenizer.train(df, "text", 264 + 9, 1, "none", most_segments=most)
        assert got.merges == ((72, 228), (206, 206), (264, 72), (264, 266), (265, 206))


def test_chats_with_a_tokenizer(spark):
    """Blocks, labels and truncation over the ids of a trained tokenizer, against assembling them by hand."""
    turns = (("system", "Be brief."), ("user", "banana bandana"), ("assistant", "naïve banana"), ("user", ""), ("assistant", "an"))
    pairs = tokenizer.train(spark.createDataFrame([(c,) for _, c in turns] * 3, "text string"), "text", 264 + 12, 1)
    df = conversation(spark, *turns)
    df = df.select(chat.blocks(F.col("messages"), lambda texts: tokenizer.encoded_each(spark, pairs, texts)).alias("parts"))
    got = df.select(chat.input_ids(F.col("parts")).alias("ids"), chat.labels(F.col("parts")).alias("labels")).first()
    ids, labels = [1], [-100]
    for role, content in turns:
        own = [*pairs.encode(content), 6]
        ids += [chat.SPECIAL_IDS[f"<|{role}|>"], *own]
        labels += [-100, *(own if role == "assistant" else [-100] * len(own))]
    assert got["ids"] == [*ids, 2] and got["labels"] == [*labels, 2] and max(ids) >= 264
    cut = chat.truncated(df, "parts", F.lit(14)).first()
    assert cut["fits"] and cut["dropped_pairs"] == 1


def naive_merges(freqs, size, least):
    seqs, merges = {s: [BYTE[b] for b in s] for s in freqs}, []
    while 264 + len(merges) < size:
        counts = {}
        for s, ids in seqs.items():
            for p in zip(ids, ids[1:]):
                counts[p] = counts.get(p, 0) + freqs[s]
        best = min(counts, key=lambda p: (-counts[p], p), default=None)
        if best is None or counts[best] < least:
            break
        for s, ids in seqs.items():
            out, i = [], 0
            while i < len(ids):
                if tuple(ids[i : i + 2]) == best:
                    out.append(264 + len(merges))
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            seqs[s] = out
        merges.append(best)
    return merges


def test_training_is_greedy(spark):
    docs = ["banana bandana", "ananas", "banana", "abac", "I'm naïve 42.", "naïve naïve"]
    df = spark.createDataFrame([(d,) for d in docs], "text string")
    freqs = {}
    for d in docs:
        for s in tokenizer.split_text(d):
            freqs[s.encode()] = freqs.get(s.encode(), 0) + 1
    pairs = tokenizer.train(df, "text", 264 + 30, 1)
    assert list(pairs.merges) == naive_merges(freqs, 264 + 30, 1)
    again = tokenizer.train(df, "text", 264 + 30, 1, first=pairs.merges[:5])
    assert again.merges == pairs.merges
    part = tokenizer.train(df, "text", 264 + 30, 1, pause_after=4)
    assert len(part.merges) == 4 and tokenizer.train(df, "text", 264 + 30, 1, first=part.merges).merges == pairs.merges
    assert tokenizer.train(df, "text", 264 + len(pairs.merges), 1, first=pairs.merges, pause_after=9).merges == pairs.merges
    abac = tokenizer.train(spark.createDataFrame([("abac",)], "text string"), "text", 265, 1)
    assert abac.merges == ((72, 73),)


def naive_encode(pairs, data):
    ids = [BYTE[b] for b in data]
    while True:
        best = min((pairs.ranks[p] for p in zip(ids, ids[1:]) if p in pairs.ranks), default=None)
        if best is None:
            return ids
        out, i = [], 0
        while i < len(ids):
            if tuple(ids[i : i + 2]) == pairs.merges[best]:
                out.append(264 + best)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out


def test_encoding(spark):
    pairs = tokenizer.train(spark.createDataFrame([("a  b   banana bandana aaaa aaa 0000",)] * 3, "text string"), "text", 264 + 25, 1, mode="none")
    rnd = random.Random(1)
    for _ in range(300):
        data = bytes(rnd.choice(b"abn d0\xff") for _ in range(rnd.randint(0, 40)))
        assert pairs.encode_bytes(data) == naive_encode(pairs, data)
        assert pairs.decode_bytes(pairs.encode_bytes(data)) == data
    texts = ["", "a  b", "banana <|end|> x", None, "naïve　日本"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", tokenizer.encoded(spark, pairs, F.col("text"), special=("<|end|>",)).alias("ids"), tokenizer.encoded(spark, pairs, F.col("text"), whole=True).alias("whole"))
    for r in got.collect():
        if r["text"] is not None:
            assert pairs.decode(r["ids"], render_special=True) == r["text"] == pairs.decode(r["whole"])
    assert 6 in pairs.encode("x<|end|>", ("<|end|>",)) and 6 not in pairs.encode("x<|end|>")
    with pytest.raises(ValueError):
        pairs.decode([6])
    with pytest.raises(ValueError):
        pairs.encode("x", ("<|no|>",))
    with pytest.raises(ValueError):
        tokenizer.BytePairs(((8, 264),))


def test_pretokens(spark):
    pool = ["I'm", "''s", " 's", "'S", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "  ", "   a", "\n\n b", "é", "42", "Ⅷ", "!?", "\t"]
    rnd = random.Random(3)
    texts = ["", "Hello   world! I'm naïve 42.\nTabs\there Ⅷ", *("".join(rnd.choice(pool) for _ in range(rnd.randint(1, 12))) for _ in range(400))]

    def by_hand(t):
        kind = lambda c: "space" if c.isspace() else "L" if c.isalpha() else "N" if c.isnumeric() else "other"
        out, i = [], 0
        while i < len(t):
            if c := next((c for c in ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d") if t.startswith(c, i)), None):
                out.append(c)
                i += len(c)
                continue
            j = i + 1 if t[i] == " " and i + 1 < len(t) and kind(t[i + 1]) != "space" else i
            k = j + 1
            while k < len(t) and kind(t[k]) == kind(t[j]):
                k += 1
            if kind(t[j]) == "space" and k < len(t) and k - i > 1:
                k -= 1
            out.append(t[i:k])
            i = k
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r for r in df.select("i", tokenizer.pretokens(F.col("text")).alias("a"), tokenizer.pretokens_exact(F.col("text")).alias("b")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["a"] == got[i]["b"] == by_hand(t)


def test_canonical(spark):
    assert canonical.canonical({"b": 1e-05, "a": 1e16, "c": "é"}) == '{"a":1e+16,"b":1e-05,"c":"\\u00e9"}'
    with pytest.raises(ValueError):
        canonical.canonical(float("nan"))
    lines = spark.createDataFrame([('{"a":1}',), ('{"a": 1}',), ("[1]",), ("{",), (None,)], "l string")
    assert [r[0] for r in lines.select(canonical.is_canonical(F.col("l"))).collect()] == [True, False, False, False, None]


def test_config_identity():
    one = canonical.config_digest({"a": 1, "b": False, "rank": 3}, {"b": False}, {"rank": 0})
    assert one == canonical.config_digest({"a": 1, "rank": 0}, {"b": False}) != canonical.config_digest({"a": 1, "b": True, "rank": 0}, {"b": False})


def test_step_ids(spark):
    df = spark.createDataFrame([("step-000000000012",), ("step-12",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(labels.step_of(F.col("s"))).collect()] == [12, None, None, None]


def test_stream_digest(spark):
    df = spark.createDataFrame([(1, "b"), (0, "é"), (2, None)], "i long, text string")
    h = hashlib.sha256()
    for t in ("é", "b", ""):
        h.update(len(t.encode()).to_bytes(8, "big") + t.encode())
    assert digest.stream_digest(df, "i", "text").first()["sha256"] == h.hexdigest()


def test_sample_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "alpha"), (1, "é\n\"x\""), (2, "")], "i long, text string")
    path = f"file://{tmp_path}/sample"
    sinks.write_sample(df, path, "i", "text")
    assert rows(records.checked_sample(spark, path), "ordinal") == [(0, "alpha"), (1, "é\n\"x\""), (2, "")]
    with pytest.raises(FileExistsError):
        sinks.write_sample(df, path, "i", "text")
    manifest = json.loads(files.read(f"{path}/manifest.json"))
    files.publish(f"{path}/manifest.json", json.dumps(manifest | {"bytes": 1}).encode())
    with pytest.raises(ValueError, match="manifest"):
        records.checked_sample(spark, path)


def test_shard_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    df = spark.createDataFrame([("train", 0, 0, [8, 9, 2]), ("train", 0, 3, [65535, 2]), ("test", 0, 0, [2])], "split string, shard long, start long, ids array<int>")
    sinks.write_shards(df, path, 65536)
    got = records.token_shards(spark, path, 2).orderBy("split", "shard", "start").collect()
    assert [(r["split"], r["start"], r["tokens"]) for r in got] == [("test", 0, [2]), ("train", 0, [8, 9]), ("train", 2, [2, 65535]), ("train", 4, [2])]
    files.publish(f"{path}/test-00000.bin", b"\x03\x00")
    with pytest.raises(Exception, match="manifest"):
        records.token_shards(spark, path).collect()
    with pytest.raises(Exception, match="outside the vocabulary"):
        sinks.write_shards(df, f"{path}2", 100)
    assert not files.exists(f"{path}2")


def test_record_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode("utf-16"))
    (tmp_path / "b.txt").write_bytes("héllo".encode())
    assert [r["text"] for r in records.texts(spark, f"{tmp_path}/*.txt").orderBy("path").collect()] == ["héllo", "héllo"]
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": "y", "c": 0}\n{"a": 3}\nnothing\n')
    got = records.json_lines(spark, f"{tmp_path}/x.jsonl", "a long, b string", strict=False)
    assert sorted(r["_valid"] for r in got.collect()) == [False, False, False, True]
    with pytest.raises(Exception, match="not a record"):
        records.json_lines(spark, f"{tmp_path}/x.jsonl", "a long, b string").collect()
    for k in (2, 1):
        (tmp_path / f"m/r-{k}").mkdir(parents=True)
        (tmp_path / f"m/r-{k}/result.json").write_text(json.dumps({"k": k}))
    found = records.results(spark, f"{tmp_path}/m/*/result.json", "k long")
    assert [r["k"] for r in found.collect()] == [1, 2]
    records.exactly(found, "path", 1)
    with pytest.raises(ValueError, match="records"):
        records.exactly(found, "path", 2)


def test_snapshot_and_log(spark, tmp_path):
    df = spark.createDataFrame([(2, 1.0), (1, 2.0)], "optimizer_step long, loss double")
    sinks.write_snapshot(df, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 2
    with pytest.raises(Exception):
        sinks.write_snapshot(df, f"{tmp_path}/s")
    for _ in range(2):
        sinks.append_lines(df, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4


def test_lineage_of_any_depth(spark):
    """Deeper than the engine's recursion goes, from every document; a repeated child repeats its paths; a circle is refused."""
    edges = spark.createDataFrame([(k, k - 1 if k else None) for k in range(260)], "c long, p long")
    want = {(o, o - n, n) for o in range(260) for n in range(o + 1)}
    got = rows(reports.lineage(edges, "c", "p"), "origin", "depth")
    assert len(got) == len(want) and set(got) == want
    assert set(rows(reports.lineage(edges, "c", "p", F.col("c") == 259), "depth")) == {(259, 259 - n, n) for n in range(260)}
    twice = spark.createDataFrame([(3, 2), (2, 1), (2, 1), (1, 9)], "c long, p long")
    assert rows(reports.lineage(twice, "c", "p", F.col("c") == 3), "depth") == [(3, 0, 3), (3, 1, 2), (3, 2, 1), (3, 2, 1), (3, 3, 9), (3, 3, 9)]
    with pytest.raises(ValueError, match="circle"):
        reports.lineage(spark.createDataFrame([(1, 2), (2, 1)], "c long, p long"), "c", "p")


def test_training_beyond_the_driver(spark):
    """More segments than the driver takes: the same merges from tables, with overlaps, ties, a replay and a pause."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aab c") for _ in range(rnd.randint(0, 30))) for _ in range(60)] + ["aaaa aaa", "abab baba", "naïve café", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    seen: list = []
    want = tokenizer.train(df, "text", 264 + 25, 2, on_merge=lambda m, n: seen.append((m, n)))
    far: list = []
    got = tokenizer.train(df, "text", 264 + 25, 2, most_segments=3, on_merge=lambda m, n: far.append((m, n)))
    assert got.merges == want.merges and len(want.merges) == 25 and far == seen
    assert tokenizer.train(df, "text", 264 + 8, 2, first=want.merges[:5], most_segments=3, pause_after=2).merges == want.merges[:7]
    with pytest.raises(ValueError, match="in no segment"):
        tokenizer.train(df, "text", 264 + 8, 2, first=[(8, 9)], most_segments=3)


def test_packing_of_a_document_above_the_cap(spark, tmp_path):
    """It has a shard to itself, as the query's SQL says, and takes no row of the others away."""
    from lodestone import catalog
    from lodestone.plans.shards import CAP
    from tests.conftest import compare

    df = spark.createDataFrame([("train", i, n) for i, n in enumerate([4, 9, 3, 20, 5])], "split string, i long, n long")
    assert [r[3:] for r in rows(shards.next_fit(df, "split", "i", "n", 8, oversized=True), "i")] == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)]
    docs = [(k, f"{k} " * 30_000, "en", "a", 0) for k in range(20)] + [(20, "x" * (CAP + 7), "en", "a", 0), (21, "y", "en", "a", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/d")
    (tmp_path / "t").mkdir()
    next((tmp_path / "d").glob("part-*")).rename(tmp_path / "t/documents.parquet")
    for name in "region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations".split():
        (tmp_path / f"t/{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    names = ["next_fit_shards", "document_cursor", "token_windows", "hash_shuffle", "rank_stride", "cursor_batch", "rank_partition_cover"]
    assert compare(spark, names, catalog.QUERIES, catalog.ORACLES, f"{tmp_path}/t") == []


def test_merge_pair_leaves_out_nothing(spark, tmp_path):
    from lodestone.plans.tokenizer import merge_pair

    spark.createDataFrame([(1, "ten ~ hens")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(merge_pair(spark, str(tmp_path)), "segment") == [(" hens", 1, 4), (" ~", 1, 2), ("ten", 1, 2)]


def test_streams_are_reported(spark, tmp_path):
    from lodestone.streaming import events, progress

    spark.createDataFrame([(k, "2026-01-01 00:00:00", 1.0) for k in range(50)], "event_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    with progress.watched(spark, seen.append):
        rows = events.appended(events.read(spark, f"{tmp_path}/events.parquet").select("event_id"))
        for _ in range(100):
            if seen and seen[-1]["event"] == "end":
                break
            time.sleep(0.1)
    assert rows.count() == 50 and [s["event"] for s in seen][:: len(seen) - 1] == ["start", "end"]
    assert seen[-1]["rows"] == 50 and seen[-1]["error"] is None and any(s["event"] == "progress" and s["rows"] == 50 for s in seen)


def test_next_fit_is_the_fold(spark):
    """Ranges packed from the state at their starts give what one fold over all documents gives."""
    rnd = random.Random(5)
    docs = [(rnd.choice("ab"), k * 7919 % 100_003, rnd.choice([0, 1, 5, 30, 70, 99, 100, 250])) for k in range(3000)]
    want, state = [], {}
    for g, o, n in sorted(docs):
        shard, fill = state.get(g, (0, 0))
        if fill and fill + n > 100:
            shard, fill = shard + 1, 0
        want.append((g, o, n, shard, fill))
        state[g] = shard, fill + n
    df = spark.createDataFrame(docs, "g string, o long, n long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows(shards.next_fit(df, "g", "o", "n", 100, oversized=True), "g", "o") == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with pytest.raises(Exception, match="larger than a shard"):
        shards.next_fit(df, "g", "o", "n", 100).collect()
    assert shards.next_fit(df.limit(0), "g", "o", "n", 100).count() == 0


def test_running_sums_of_sparse_orders(spark):
    from lodestone.operators.ordered import running_sum

    rnd = random.Random(6)
    ids = sorted({rnd.randrange(-(1 << 62), 1 << 62) for _ in range(400)})
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "i long, v long")
    got = rows(running_sum(df, "i", F.col("v"), "s", width=20), "i")
    assert [r[2] for r in got] == [k * (k + 1) // 2 for k in range(400)]
    assert running_sum(df.limit(0), "i", F.col("v"), "s").count() == 0


def test_nulls_are_values(spark):
    df = spark.createDataFrame([("a", 5), ("a", None), ("b", None), ("c", 5), ("c", 5), ("d", 4), ("d", 5)], "g string, v int")
    assert rows(reports.constant(df, "g", "v"), "g") == [("a", False), ("b", True), ("c", True), ("d", False)]


def test_digest_is_in_order(spark):
    texts = [f"text {k} é" * (k % 4) for k in range(500)]
    df = spark.createDataFrame([(k * 31 % 500, texts[k * 31 % 500] or None) for k in range(500)], "i int, t string").repartition(7)
    h = hashlib.sha256(b"".join(len(t.encode()).to_bytes(8, "big") + t.encode() for t in texts)).hexdigest()
    assert tuple(digest.stream_digest(df, "i", "t").first()) == (500, h)
    assert tuple(digest.stream_digest(df.limit(0), "i", "t").first()) == (0, hashlib.sha256().hexdigest())


def test_copies_that_share_an_order(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "a", 4), (2, "c", 5), (3, "", 6)], "i int, t string, x int")
    got = rows(text.first_occurrences(df, "t", "i").select("i", "t"), "i", "t")
    assert got == [(1, "a"), (1, "b"), (2, "c")]


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from lodestone.session import shared_dir

    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

        def set(self, key, value):
            self[key] = value

    spark = lambda master: SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master=master, applicationId="app", getConf=lambda: Conf()))
    assert shared_dir(spark("local[4]")).startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(spark(master))
