"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import chat, decontamination, language, license_scan, packing, simhash, token_count, token_files, topk, warc
from lodestone.llm.common import scratch
from lodestone.llm.components import components
from lodestone.llm.queries import ORACLES, QUERIES, tokenizer_path
from lodestone.sources.files import filesystem
from tests.conftest import compare

LONG = "The quick brown fox, jumps over 12 lazy dogs! Größe é " * 4000
#: Nulls in any column, empty, blank and very long texts, repeated rows and ids, and columns whose names the operators use themselves.
ROWS = [
    (1, "Hello world, it's a test.", "en", "s", 3, "x"),
    (1, "Hello world, it's a test.", "en", "s", 3, "x"),
    (2, None, "en", None, None, None),
    (3, "", None, "s", 0, "y"),
    (4, " \t\n ", "en", "s", 0, "y"),
    (5, LONG, "en", "s", None, "y"),
    (None, "no id at all here", None, None, None, None),
    (None, None, None, None, None, None),
    (7, "Ünïcödé — “quotes” 中文 한국어 😀 <|endoftext|> tail", "de", "s", 1, "z"),
    (8, "Hello world, it's a test.", "en", "s", 3, "x"),
    (9, "1234 !!! ???", "en", "s", 3, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for clash in ("_id", "fp", "ids", "score", "key"):
        df = df.withColumn(clash, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    assert compare(spark, [name], QUERIES, ORACLES, sf_dir) == []


# op1


def plain_words(text):
    return re.findall("[a-z0-9]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def dice(a, b):
    """Of two lists of words."""
    x, y = (Counter(zip(w, w[1:])) for w in (a, b))
    return 2 * (x & y).total() / max(1, x.total() + y.total())


def licences_by_hand(text):
    """(line, last line, licence, coefficient): each line, the whole text, and each licence's best window over several lines."""
    own = {k: plain_words(v) for k, v in license_scan.TEMPLATES.items()}
    vocabulary = {w for v in own.values() for w in v}
    lines = [plain_words(x) for x in text.split("\n")]
    units = [(i, i, w) for i, w in enumerate(lines, 1)] + ([(0, len(lines), [w for x in lines for w in x])] if len(lines) > 1 else [])
    out = set()
    for line, last, w in units:
        best = min((-dice(w, v), k) for k, v in own.items())
        if best[0] <= -license_scan.SIMILARITY + 1e-12:
            out.add((line, last, best[1], round(-best[0], 6)))
    share = license_scan.SIMILARITY / (2 - license_scan.SIMILARITY)
    for name, v in own.items():
        best = []
        for i, first in enumerate(lines, 1):
            if not first or sum(w in vocabulary for w in first) < share * len(first) - 1e-9:
                continue
            w, last = [], i - 1
            while last < len(lines) and len(w) < len(v):
                w += lines[last]
                last += 1
            w = w[: len(v)]
            if len(w) > len(first) and dice(w, v) >= license_scan.SIMILARITY - 1e-12:
                best.append((-dice(w, v), i, last))
        if best:
            out.add((min(best)[1], min(best)[2], name, round(-min(best)[0], 6)))
    return out


def test_licences(spark, docs, empty):
    mit, gpl, bsd = (license_scan.TEMPLATES[k] for k in ("MIT", "GPL-3.0-notice", "BSD-3-Clause"))
    flat = " ".join(mit.split())
    wrapped = "\n".join(flat[i : i + 70] for i in range(0, len(flat), 70))  # cut anywhere, words included
    at_words = "\n".join(" ".join(mit.split()[i : i + 9]) for i in range(0, len(mit.split()), 9))
    code = "\n".join(f"def f{k}(x):\n    return x + {k}\n" for k in range(120))
    marked = "\n".join(f" * {x}" for x in at_words.split("\n"))
    texts = [mit, "some words\n" + gpl, gpl.replace("version 3", "version three"), "of the of the of the of the", "licensed", mit[:300], "x\n" * 5000 + gpl.upper(), " ".join(mit.split()[:150]), "\n".join(mit.split(". "))]
    texts += [at_words + "\n\n" + code, code + wrapped + "\n" + code, "/*\n" + marked + "\n */\n" + code, code + " ".join(bsd.split()) + "\n" + at_words, at_words + "\n" + code + at_words, at_words.replace("\n", "\n\n"), "the\n" * 3000, "\n".join(gpl.split()), "Released under\nthe MIT License.\n" + code, code]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(i, *x) for i, t in enumerate(texts) for x in licences_by_hand(t)}
    got = license_scan.scan(df)
    assert {(r[0], r[1], r[2], r[3], round(r[4], 6)) for r in got.collect()} == want
    assert {(9, 1, "MIT"), (13, 1, "MIT")} <= {(x[0], x[1], x[3]) for x in want} and {x[3] for x in want if x[0] in (9, 11, 12)} >= {"MIT", "BSD-3-Clause"} and not [x for x in want if x[0] == 18]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert license_scan.scan(docs).count() == license_scan.scan(empty).count() == 0


# op2


def test_topk(spark):
    rnd = np.random.default_rng(4)
    x = [(int(i), [float(v) for v in rnd.normal(size=8) * (1 + i % 3)]) for i in range(700)]
    x += [(1000 + i, x[5][1]) for i in range(300)] + [(2000, None), (2001, [1.0, None] * 4), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [1.0] * 8), (2100, [1.0, 2.0]), (2200, [3.0, 4.0]), (2300, []), (0, x[0][1]), (2400, [0.0] * 8), (2500, [1e6] * 8)]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("v", F.lit("q")).withColumn("_query", F.lit(False)).withColumn("asked", F.lit(1)).repartition(3)
    good = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v in x if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    want = {}
    for i, v in {i: v for i, v in good if i % 100 == 0}.items():
        own = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v))[:10]
        want |= {(i, k): (j, -s) for k, (s, j) in enumerate(own, 1)}
    for sizes in ({}, {"pivots": 5, "segment": 64, "block": 3}, {"pivots": 3, "segment": 16, "lengths": 1}):
        got = topk.top_k(df, F.col("vec_id") % 100 == 0, **sizes).collect()
        assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want and len(got) == len(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_large_components(spark):
    """Scores up to 64 bits are exact, larger ones are an error instead of wrong rows."""
    rnd = random.Random(6)
    x = [(k, [float(rnd.randrange(-(1 << 20), 1 << 20)) for _ in range(4)]) for k in range(120)]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    v = {i: [int(c) * 1024 for c in e] for i, e in x}
    want = {}
    for q in (0, 100):
        own = sorted((-sum(a * b for a, b in zip(v[q], v[j])), j) for j in v if j != q)[:10]
        want |= {(q, r): (j, -s) for r, (s, j) in enumerate(own, 1)}
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()} == want
    assert max(abs(s) for _, s in want.values()) > 2**60
    big = spark.createDataFrame([(0, [2.0**30]), (1, [2.0**30]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(big, F.col("vec_id") == 0).collect()
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(big.withColumn("embedding", F.array(F.lit(1e300))), F.col("vec_id") == 0).collect()


def test_ragged_vectors(spark):
    """Every row with a length of its own, or nearly: only the most frequent lengths have pivots on the driver."""
    x = [(k, [float(k % 7)] * (1 + k // 2)) for k in range(60)]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 2 == 0, lengths=3).collect()
    assert {(r["query_id"], r["vec_id"]): r["score"] for r in got} == {(k, k + 1): 1024**2 * (k % 7) * ((k + 1) % 7) * (1 + k // 2) for k in range(0, 60, 2)}


def test_only_routed_segments_move(spark):
    """Clusters far apart: the vectors that meet queries are those of the queries' own clusters."""
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(40, 16))
    centres *= 50 / np.linalg.norm(centres, axis=1, keepdims=True)
    x = [(k, (centres[k % 40] + rnd.normal(size=16) * 0.05).tolist()) for k in range(4000)]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    seen = []
    meet = topk._meet

    def counted(index, k, block):
        run, total = meet(index, k, block), spark.sparkContext.accumulator(0)
        seen.append(total)

        def count(batches):
            def passed():
                for b in batches:
                    total.add(b.num_rows)
                    yield b

            yield from run(passed())

        return count

    topk._meet = counted
    try:
        got = topk.top_k(df, F.col("vec_id").isin(0, 1), segment=64).collect()
    finally:
        topk._meet = meet
    assert len(got) == 20 and all(r["vec_id"] % 40 == r["query_id"] for r in got)
    assert 0 < seen[-1].value < 1500


# op3


def test_decontamination(spark, docs, empty):
    rnd = random.Random(2)
    vocabulary = [f"w{k}" for k in range(12)] + ["Äb", "é", "日本"]
    line = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(["", ",", "!", " -"]) for _ in range(n))
    items = [(k, line(rnd.choice([3, 9, 10, 11, 30]))) for k in range(20)] + [(50, None), (51, "..."), (None, line(12))]
    texts = [line(rnd.randint(0, 40)) for _ in range(40)] + [f"{line(4)} {items[k][1].upper()} {line(3)}" for k in range(20)] + [None, "", items[-1][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = {}
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for k, item in items:
            v = words(item)
            for j in range(max(1, len(v) - 9) if v else 0):
                win = v[j : j + 10]
                for a in range(len(w) - len(win) + 1):
                    if w[a : a + len(win)] == win:
                        hit |= set(range(a, a + len(win)))
                        found |= {str(k)} - {"None"}
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    for limit in (1 << 20, 4000):  # one automaton, and several
        got = decontamination.decontaminate(df, bench, automaton_bytes=limit)
        assert {r[0]: tuple(r[1:]) for r in decontamination.digest(got).collect()} == want
        for r in got.filter("contaminated").collect():
            parts = [words(texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"]]
            assert sum(map(len, parts)) == r["n_hit"]
        kept = {r["doc_id"] for r in decontamination.keep_clean(df, bench, automaton_bytes=limit).collect()}
        assert kept == {i for i, v in want.items() if not v[4]}
    assert decontamination.decontaminate(docs, bench).count() == len(ROWS)
    assert decontamination.decontaminate(empty, bench).count() == 0
    none = bench.limit(0)
    assert decontamination.decontaminate(docs, none).filter("contaminated").count() == 0
    assert decontamination.keep_clean(docs, none).count() == len(ROWS)


# op4


BYTE, RANKS, WORD = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


def check_pieces(rows, texts, length):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    want = Counter()
    for d, text in texts:
        want[d, np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for d, own in by_doc.items():  # repeated rows: all pieces of the id together are all their ids
        ids = sum(len(k[1]) * n for k, n in want.items() if k[0] == d)
        assert sum(len(r["ids"]) for r in own) == ids
        if sum(n for k, n in want.items() if k[0] == d) == 1:
            own.sort(key=lambda r: r["start"])
            assert want[d, b"".join(bytes(r["ids"]) for r in own)] == 1
            assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
            assert {r["doc_tokens"] for r in own} == {ids // 4}
    padding = 0
    for own in by_seq.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        n = sum(r["length"] for r in own)
        assert n <= length
        padding += 0 if n & (n - 1) == 0 else length - n
    assert padding == 0 and set(by_doc) == {d for d, _ in texts}


def test_packing(spark, sf_dir, docs, empty):
    df = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(5)
    check_pieces(packing.pack(df, BYTE, RANKS).collect(), [tuple(r) for r in df.collect()], 2048)
    for sizes in ({}, {"length": 64, "windows": 2, "group": 1}):
        check_pieces(packing.pack(docs.repartition(3), BYTE, RANKS, **sizes).collect(), [r[:2] for r in ROWS], sizes.get("length", 2048))
    assert packing.pack(empty, BYTE, RANKS).count() == 0
    thin = packing.pack(docs, BYTE, RANKS, keep_ids=False)
    assert "ids" not in thin.columns and thin.count() > 0


def test_long_runs():
    """No text is too much for the fast path: what it gives up on goes through the library."""
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(BYTE), packing.ByteEncoder(BYTE, RANKS)
    for run in (" ", "\n", "\t", "a", ".", "9", " \n", "é", "a "):
        text = "start " + run * (2_000_000 // len(run)) + "end"
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, run


def test_fast_path_is_the_library():
    """Equal ids over texts of all characters that count as plain, in all neighbourhoods of classes."""
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(BYTE), packing.ByteEncoder(BYTE, RANKS)
    plain = [chr(c) for c in range(0x2100) if not 0xD800 <= c < 0xE000 and packing.is_plain(chr(c))]
    assert len(plain) > 400
    rnd, kinds = random.Random(8), (" ", "\n", "\t", "\xa0", "\u2009", "\x1c", "\x85", "'s", "'LL", "12", "½", "A", "é", ",", "€")
    texts = ["".join(plain), *(f"a{c}b {c} {c}{c}1{c}" for c in plain)]
    texts += ["".join(rnd.choice(plain if rnd.random() < 0.5 else kinds) for _ in range(rnd.randint(1, 60))) for _ in range(4000)]
    for text, ids in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text).tolist() == ids.ids, text


def test_best_fit():
    """Whole documents go where they fill best; only what fits nowhere is cut."""
    p = packing.Packer(10, 2)
    place = lambda d, n: [[(x[0], len(x[2])) for x in w] for w in p.place(d, 0, np.arange(n, dtype=np.uint32), n)]
    assert place("a", 6) == [] and place("b", 8) == []
    assert place("c", 2) == [[("b", 8), ("c", 2)]]
    assert place("d", 5) == [] and place("e", 7) == [[("a", 6), ("e", 4)]]
    assert [[(x[0], len(x[2])) for x in w] for w in p.rest()] == [[("d", 5), ("e", 3)]]


# op5


def cheapest(roles):
    best, legal = [10**9], {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}

    def go(i, at, cost):
        if cost >= best[0]:
            return
        if i == len(roles):
            best[0] = cost
            return
        for x in chat.ROLES:
            c = cost + (0 if x == roles[i] else 3)
            if x in legal[at]:
                go(i + 1, x, c)
            if any(x in legal[y] for y in legal[at]):
                go(i + 1, x, c + 2)
            if at == x:
                go(i + 1, x, c + 1)

    go(0, "", 0)
    return best[0]


def test_chat(spark):
    rnd = random.Random(3)
    talks = {c: [rnd.choice(["system", "user", "assistant", " User", "tool", None]) for _ in range(rnd.randint(1, 7))] for c in range(150)}
    talks[10**6] = [rnd.choice(["user", "assistant"]) for _ in range(2000)]  # spread over all ranges
    rows = [(c, i, r, f"t{i} <|user|>") for c, rs in talks.items() for i, r in enumerate(rs)]
    rows += [(None, None, "user", None), (None, 1, None, "x"), (10**6 + 1, 0, "user", "a"), (10**6 + 1, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("action", F.lit("clash")).repartition(6)
    got = defaultdict(list)
    for r in chat.format_chats(df).collect():
        got[r["conv_id"]].append(r)
    for c, rs in talks.items():
        own = sorted(got[c], key=lambda r: r["turn"])
        plain = [(r or "").strip().lower() for r in rs]
        assert len(own) == len(rs)
        if c < 10**6:
            assert sum(r["cost"] for r in own) == cheapest(plain)
        else:
            machine = chat.Automaton()
            assert sum(r["cost"] for r in own) == min(machine.forward([chat.ROLES.index(r) + 1 for r in plain], [0, *[1 << 40] * 3])[0])
        whole = "".join(r["rendered"] for r in own)
        heads = re.findall(r"<\|(\w+)\|>\n", whole)
        roles = [h for h in heads if h != "end"]
        assert re.fullmatch("(system,)?(user(,assistant,user)*(,assistant)?)|system", ",".join(roles)) and heads[1::2] == ["end"] * len(roles)
    assert len(got[None]) == 2 and sum(r["cost"] for r in got[10**6 + 1]) == 1
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_texts(spark):
    """Empty and very long texts, and texts with marks or what only looks like them."""
    long = "word <|> x |> f <| y " * 100_000
    turns = [(1, 0, "user", ""), (1, 1, "assistant", long), (1, 2, "user", "a <|end|> b <|user|>\n<|tool|> <|"), (1, 3, "assistant", None)]
    rows = sorted(chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r["turn"])
    assert "".join(r["rendered"] for r in rows) == f"<|user|>\n<|end|>\n<|assistant|>\n{long}<|end|>\n<|user|>\na < |end|> b < |user|>\n<|tool|> <|<|end|>\n<|assistant|>\n<|end|>\n"


# op6


def test_token_files(spark, sf_dir, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    for df, size in ((table(spark, sf_dir, "documents").select("doc_id", "text").repartition(7), 10_000), (docs.repartition(4), 256 << 20), (docs, 1)):
        path = token_files.write_tokens(df, scratch(spark, "tokens"), WORD, part_bytes=size)
        got = token_files.read_tokens(spark, path).collect()
        order = sorted(((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        got.sort(key=lambda r: r["start"])
        assert [r["doc_id"] for r in got] == [d for d, _ in order]
        at = 0
        for r in got:
            assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
            at += r["n_tokens"]
        raw = lambda x: np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((d, raw(x)) for d, x in order)
    assert token_files.encode_to_files(empty, WORD).count() == 0


def test_word_ids_are_the_library():
    """Ids over texts of all plain characters in all neighbourhoods equal those of the whole file's tokenizer."""
    from tokenizers import Tokenizer

    from lodestone.llm.word_bpe import is_plain

    t, own = Tokenizer.from_file(WORD), token_files.WordIds(WORD)
    plain = [chr(c) for c in range(0x2100) if not 0xD800 <= c < 0xE000 and is_plain(chr(c))]
    rnd, kinds = random.Random(12), (" ", "\n", "\xa0", "\x1c", "'s", "'LL", "12", "A", "é", ",", "<|endoftext|>", "ſ", "İ", "中")
    texts = ["".join(plain), "", *(f"a{c}b {c} {c}{c}1{c}" for c in plain)]
    texts += ["".join(rnd.choice(plain if rnd.random() < 0.5 else kinds) for _ in range(rnd.randint(1, 60))) for _ in range(4000)]
    for text, raw, ids in zip(texts, own.texts(texts), t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(raw, own.kind).tolist() == ids.ids, text


def test_repeated_rows_fill_no_task(spark):
    """A row that makes up most of the table is dealt over the tasks."""
    df = spark.createDataFrame([(1, "the same text")] * 900 + [(k, f"text {k}") for k in range(2, 102)], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = token_files.write_tokens(df, scratch(spark, "repeats"), WORD)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    where, inner = filesystem(path)
    docs = [p["docs"] for p in json.loads(where.open_input_stream(f"{inner}/manifest.json").read())["parts"]]
    assert sum(docs) == 1000 and max(docs) < 500
    assert token_files.read_tokens(spark, path).count() == 1000


def test_token_file_layout(spark):
    path = token_files.write_tokens(spark.createDataFrame([(5, "a b"), (3, None)], "doc_id long, text string").coalesce(1), scratch(spark, "layout"), WORD)
    where, inner = filesystem(path)
    manifest = json.loads(where.open_input_stream(f"{inner}/manifest.json").read())
    assert manifest["tokens"] == 4 and [p["base"] for p in manifest["parts"]] == np.cumsum([0, *(p["tokens"] for p in manifest["parts"])])[:-1].tolist()


# op7


def by_hand(text):
    b = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0d]+", b)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s, 42) for s in ([b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)])]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups(ids, fps):
    fps, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 2):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash(spark, sf_dir, docs, empty):
    for df in (table(spark, sf_dir, "documents").select("doc_id", "text"), docs.select("doc_id", "text")):
        rows = [tuple(r) for r in df.collect()]
        fps = [by_hand(t) for _, t in rows]
        want = Counter((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, groups([d for d, _ in rows], fps)))
        assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_crowded_fingerprints(spark):
    """A cloud around one fingerprint, compared pair by pair in keys of any size or by pairs of bits."""
    rnd = random.Random(5)
    base, found = rnd.getrandbits(64), set()
    for _ in range(900):
        x = rnd.choice([base, *list(found)[:3]])
        for _ in range(rnd.randint(0, 4)):
            x ^= 1 << rnd.randrange(64)
        found.add(x)
    found = sorted(found | {rnd.getrandbits(64) for _ in range(100)})
    signed = [x - (1 << 64) if x >> 63 else x for x in found]
    want = groups(signed, found)
    for most in (10**6, 20, 1):
        linked = {r["node"]: r["component"] for r in components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most)).collect()}
        assert [linked.get(x, x) for x in signed] == want


def test_frequent_fingerprints(spark):
    """Rows of frequent fingerprints are looked up by a broadcast, the others by a join; together they are all rows."""
    rnd = random.Random(2)
    rows = [(k, rnd.choice([7, 7, 7, 8, 9, k])) for k in range(400)]
    df = spark.createDataFrame(rows, "_id long, fp long")
    named = df.groupBy("fp").agg(F.count("*").alias("n")).withColumns({"component": F.col("fp") * 2, "component_id": F.col("fp") * 3})
    for hot in (1, 30, 10**6):
        got = simhash._look_up(df, named, hot).select("_id", "fp", "component", "component_id").collect()
        assert Counter(map(tuple, got)) == Counter((i, x, 2 * x, 3 * x) for i, x in rows)


def test_deduplicate(spark, docs, empty):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 5, 7, 9, None, None])
    assert simhash.deduplicate(empty).count() == 0


def test_deduplicate_judges_texts_not_ids(spark):
    """An id with a near copy of a smaller id's text and texts of its own loses the copy alone, and keeps one of each of the others."""
    rnd = random.Random(11)
    a, b, c, d = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(300)) for _ in range(4))
    df = spark.createDataFrame([(1, a), (7, a), (7, b), (7, b), (7, c), (8, c), (8, d), (None, d)], "doc_id long, text string")
    assert Counter(map(tuple, simhash.deduplicate(df).collect())) == Counter([(1, a), (7, b), (7, c), (8, d), (None, d)])


def test_long_chains_fold_up(spark):
    """A thousand edges in a row, in any order of names, take few rounds."""
    rnd = random.Random(4)
    names = list(range(1001))
    rnd.shuffle(names)
    for chain in (range(1001), names):
        rounds = []
        got = components(spark.createDataFrame(list(zip(chain, chain[1:])), "a long, b long"), rounds.append, one_task=0).collect()
        assert {r["component"] for r in got} == {0} and len(got) == 1001 and len(rounds) <= 10


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, 2000 + k) for k in range(50)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    for one_task in (0, 10**6):
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
        assert all(got[x] == find(x) for x in got) and set(got) >= {a for a, b in edges if a != b}
        assert components(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0


# op8


def test_language(spark, sf_dir, docs, empty):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    got = language.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"]: r["held_out"] for r in got} == {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got}
    assert len(got) == df.count() and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = {(r["doc_id"], r["lang_pred"]) for r in language.identify(docs).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (9, "und")} <= odd and language.identify(docs).count() == len(ROWS)
    assert language.identify(empty).count() == 0
    unlabelled = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in unlabelled.collect()} == {("und", 0.0)}
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 1, 5, None, 7, 8])


def test_documents_without_labels_stay(spark, docs):
    kept = language.keep_identified(docs.withColumn("lang", F.lit(None).cast("string")))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 1, 5, None, 7, 8])


def test_labels_are_no_inputs(spark):
    """A prediction depends on the text alone."""
    df = table(spark, "/root/testdata/sf0.001", "documents")
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df).collect()}
    swapped = df.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(swapped).collect()} == a


def spectrum(text):
    """The set of 1- to 3-grams of letters and marks in lower case, everything else one blank, with a blank at both ends."""
    import unicodedata

    if not any(unicodedata.category(c)[0] == "L" for c in text):
        return set()
    line = " " + "".join(c.lower()[0] if unicodedata.category(c)[0] in "LM" else " " for c in text) + " "
    line = re.sub(" +", " ", line)
    return {line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1)}


def regress(sets, labels, landmarks, ridge):
    """Scores of sets by languages, from the kernel matrix as it is defined."""
    names = sorted(set(labels))
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b)) if a and b else 0.0
    own = [sets[i] for i in landmarks]
    nm = np.array([[kernel(a, b) for b in own] for a in sets])
    mm = np.array([[kernel(a, b) for b in own] for a in own])
    y = np.array([[float(x == n) for n in names] for x in labels])
    alpha = np.linalg.solve(nm.T @ nm + ridge * len(sets) / len(own) * mm + 1e-8 * np.eye(len(own)), nm.T @ y)
    return names, lambda text: np.array([kernel(spectrum(text), b) for b in own]) @ alpha


def test_kernel():
    """Scores of the folded, batched form are kernel values with the landmarks times the weights, for any text."""
    texts = ["the cat and the hat", "le chat et la rue", "the dog and a man", "le chien et un homme", "das ist ein hund", "der Mann und die Frau 12"]
    labels = ["en", "fr", "en", "fr", "de", "de"]
    names, score = regress([spectrum(t) for t in texts], labels, [4, 0, 1, 3], 0.1)
    sets = [np.unique(language.grams(t)) for t in texts]
    model = language.solve(names, sets, np.array([names.index(x) for x in labels]), np.array([4, 0, 1, 3]), 0.1, rows=2)
    odd = [*texts, "", "12 !!", "zzz \U00032000 q", "İstanbul ǅ é", "中文", "a" * 5000]
    got, seen = model.score(odd, rows=3)
    assert np.allclose(got[seen], [score(t) for t, ok in zip(odd, seen) if ok], atol=1e-5)
    assert seen.tolist() == [bool(spectrum(t)) for t in odd]


def test_grams():
    for text in ("A b", "  x", "\U000323a5 é", "\U00032000\U00031350", "Größe, ab", "é", "\u0301", "\ud800a"):
        codes = np.unique(language.grams(text)) if spectrum(text) else language.grams(text)
        assert len(codes) == len(spectrum(text)), text
    assert len(language.grams("\U000323a5")) == 6  # beyond U+32000 there are letters, too


def test_identify_is_the_plain_method(spark, sf_dir):
    """Sampler, n-gram sets, kernel and regression written plainly give the same languages and scores."""
    df = table(spark, sf_dir, "documents")
    rows = df.select("doc_id", "text", "lang", F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("language")).alias("draw")).collect()
    learn = [r for r in rows if r["text"] and r["lang"] and len(r["text"]) <= language.MOST_CHARS and spectrum(r["text"]) and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    size, sample, landmarks = Counter(r["lang"] for r in learn), [], []
    for lang in sorted(size):
        own = [r for r in learn if r["lang"] == lang and r["draw"] % (1 << 30) < min(1.0, 3 * language.PER_LANGUAGE / size[lang]) * (1 << 30)]
        own = sorted(own, key=lambda r: (r["draw"], r["doc_id"]))[: language.PER_LANGUAGE]
        landmarks += range(len(sample), len(sample) + min(len(own), language.LANDMARKS))
        sample += own
    names, score = regress([spectrum(r["text"]) for r in sample], [r["lang"] for r in sample], landmarks, language.RIDGE)
    got = {r["doc_id"]: r for r in language.identify(df).collect()}
    for r in rows[::3]:
        own = got[r["doc_id"]]
        if not spectrum(r["text"] or ""):
            assert (own["lang_pred"], own["score"]) == ("und", 0.0)
            continue
        want = score(r["text"])
        assert abs(own["score"] - min(1, max(0, want.max()))) < 1e-4
        assert want[names.index(own["lang_pred"])] > want.max() - 1e-4


def test_other_scripts_are_rejected(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    other = spark.createDataFrame([(10**9 + k, t, None) for k, t in enumerate(["中文字符测试一下", "Это русский текст для проверки", "これは日本語です", "Ελληνικά είναι εδώ"])], df.schema)
    kept = {r["doc_id"] for r in language.keep_identified(df.unionByName(other)).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in df.collect() if spectrum(r["text"] or "")}


def test_models_are_bounded(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    model = language.fit(df, landmarks=64, model_bytes=60_000)
    assert model and len(model.weights) * (len(model.languages) * 4 + 8) <= 60_000
    with pytest.raises(ValueError):
        language.fit(df, model_bytes=10)
    assert language.fit(df, most_chars=0) is None
    assert set(language.fit(df.withColumn("lang", F.concat("lang", F.col("doc_id") % 30)), most_rows=100).languages)


# op9


def test_token_counts(spark, sf_dir, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    rnd = random.Random(1)
    pool = "aAbZé ÀŁßİıſǱ\t\n\x0b\x1c\x85\xa0'sStTreLL'd  019²½Ⅷ、中文字한글αΣς!!..,;-_“”‘’—…€ǅ́﻿😀 　"
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(1500)] + ["a <|endoftext|> b <|startoftext|>c", "<|endoftext|>", "'s'story I'M", "''s", "a" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (df, docs, table(spark, sf_dir, "documents")):
        rows = df.select("doc_id", "text").collect()
        n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
        want = Counter((r["doc_id"], len((r["text"] or "").encode()), n(r["text"] or ""), n(r["text"] or "") > 2048) for r in rows)
        assert Counter(map(tuple, token_count.count_tokens(df, WORD).collect())) == want
    assert token_count.count_tokens(empty, WORD).count() == 0


# op10


def test_warc(spark, tmp_path):
    big, other = "x" * 100 + "é", "y" * 99
    pages = [(4, "http://a", big), (2, "http://b\r\nX-Bad: 1", big), (9, None, big), (2, "http://b", big), (5, "u", other), (6, "u", other), (7, "u", None), (8, "u", ""), (None, "u", big), (10, "http://long", "z" * 300_000), (11, "http://c", "a\r\n\r\nb" * 50)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("headers", F.lit("clash")).repartition(3)
    got = warc.archive(df).collect()
    want = Counter()
    for page, _, html in pages:
        raw = (html or "").encode()
        to = 2 if len(raw) >= 100 and html == big and page != 2 else None
        want[page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if to else "response", to] += 1
    assert Counter(map(tuple, got)) == want
    assert warc.archive(df.limit(0)).count() == 0


def test_warc_reader(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    df = spark.createDataFrame([(k, f"http://h{k % 2}/p{k}", f"<p>{k % 7}</p>" * 20) for k in range(40)], "page_id long, url string, html string")
    warc.write_warc(df.repartition(2), path)
    read = warc.read_warc(spark, path)
    assert read.count() == 40
    some = read.filter((F.col("record_type") == "response") & F.col("target_uri").startswith("http://h1/"))
    assert {r["record_type"] for r in some.collect()} == {"response"} and {r["target_uri"][:10] for r in some.collect()} == {"http://h1/"}
    assert "StartsWith" not in some._jdf.queryExecution().executedPlan().toString()
    heads = warc.read_warc(spark, path, payload=False)
    assert heads.filter("payload is not null").count() == 0 and heads.count() == 40
    # files without skip lengths, not compressed, or with several records in one member's place
    import gzip

    raw = b"".join(warc.record({"WARC-Type": "response", "WARC-Record-ID": f"r{k}", "Content-Type": "text/plain"}, b"body %d" % k) for k in range(3))
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain/a.warc").write_bytes(raw)
    (tmp_path / "plain/b.warc.gz").write_bytes(b"".join(gzip.compress(warc.record({"WARC-Type": "resource", "WARC-Record-ID": f"g{k}", "Content-Type": "text/plain"}, b"zip %d" % k * 2000)) for k in range(3)))
    rows = warc.read_warc(spark, f"file://{tmp_path}/plain").orderBy("record_id").collect()
    assert [bytes(r["payload"])[:6] for r in rows] == [b"zip 0z", b"zip 1z", b"zip 2z", b"body 0", b"body 1", b"body 2"]


def test_warc_members_and_headers(spark, tmp_path):
    """Several records in a member, large ones among them; names in any case, folded and repeated headers; members cut off."""
    import gzip

    body = lambda k: b"%d" % k * 400_000
    three = b"".join(warc.record({"WARC-Type": "resource", "WARC-Record-ID": f"m{k}", "Content-Type": "text/plain"}, body(k)) for k in range(3))
    odd = b"WARC/1.0\r\nwarc-type: metadata\r\nwarc-record-id: odd\r\nWARC-Concurrent-To: a\r\nwarc-concurrent-to: b\r\nX-Long: one\r\n  two\r\ncontent-length: 3\r\n\r\nxyz\r\n\r\n"
    both = warc.member(warc.record({"WARC-Type": "resource", "WARC-Record-ID": "s0"}, b"0") + warc.record({"WARC-Type": "resource", "WARC-Record-ID": "s1"}, b"1"))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(three + odd) + both + warc.member(odd.replace(b"record-id: odd", b"record-id: own")))
    (tmp_path / "b.warc").write_bytes(odd.replace(b"record-id: odd", b"record-id: raw") + b"\r\n" + three)
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert Counter(r["record_id"] for r in rows) == Counter(["m0", "m1", "m2"] * 2 + ["odd", "s0", "s1", "own", "raw"])
    for r in rows:
        if r["record_id"][0] == "m":
            assert bytes(r["payload"]) == body(int(r["record_id"][1]))
        if r["record_type"] == "metadata":
            assert r["headers"]["WARC-Concurrent-To"] == "a, b" and r["headers"]["X-Long"] == "one two" and bytes(r["payload"]) == b"xyz"
    some = warc.read_warc(spark, f"file://{tmp_path}", payload=False).filter("record_type = 'metadata'")
    assert {r["record_id"] for r in some.collect()} == {"odd", "own", "raw"}
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut/a.warc.gz").write_bytes(gzip.compress(three)[:-600])
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark, f"file://{tmp_path}/cut").collect()


def test_warc_record_ids(spark, tmp_path):
    """Ids differ between records and archives; a revisit names a record that is there, with its URI and date."""
    df = spark.createDataFrame([(k, f"http://h/{k}", "<p>x</p>" * 30 if k % 2 else f"<b>{k}</b>" * 30) for k in range(12)], "page_id long, url string, html string")
    ids = []
    for name in "ab":
        warc.write_warc(df.repartition(3), f"file://{tmp_path}/{name}")
        rows = warc.read_warc(spark, f"file://{tmp_path}/{name}").collect()
        own = {r["record_id"]: r for r in rows}
        for r in rows:
            if r["record_type"] == "revisit":
                to = own[r["headers"]["WARC-Refers-To"]]
                assert to["record_type"] == "response" and to["payload_digest"] == r["payload_digest"]
                assert r["headers"]["WARC-Refers-To-Target-URI"] == to["target_uri"] and r["headers"]["WARC-Refers-To-Date"] == to["headers"]["WARC-Date"]
        ids += own
    assert len(set(ids)) == len(ids) == 24


def test_warc_pushdown():
    """Predicates on headers are taken over, others are given back."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    reader = warc.WarcReader("x", True)
    other = GreaterThan(("payload_digest",), "a")
    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), StringStartsWith(("target_uri",), "http://a"), other])) == [other]
    assert reader.keeps({"WARC-Type": "response", "WARC-Target-URI": "http://a/b"}) and not reader.keeps({"WARC-Type": "revisit", "WARC-Target-URI": "http://a"})


# pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    fps = [by_hand(t) for _, t in rows]
    rows = [r for r, c in zip(rows, groups([d for d, _ in rows], fps)) if r[0] == c]
    bad = {r["doc_id"] for r in decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").collect()}
    rows = [r for r in rows if r[0] not in bad]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = out
    packed = packing.pack(docs, BYTE, RANKS)
    check_pieces(packed.collect(), rows, 2048)
    run = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in run.select("doc_id").distinct().collect()} == {d for d, _ in rows} and bad


def test_stages_on_odd_rows(spark, sf_dir, docs, empty):
    """Each stage alone: null, empty and long texts, repeats and clashing columns; and an empty table."""
    import corpus_pipeline

    kept = {"language": [1, 1, 5, None, 7, 8], "near_duplicates": [1, 2, 5, 7, 9, None, None], "decontamination": [r[0] for r in ROWS]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name in kept:
            assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect()) == Counter(kept[name]), name
        else:
            assert out.count() > 0
        assert stage(spark, empty, sf_dir).count() == 0


def test_rest_does_without(tmp_path):
    """Without the two folders and the pipeline the entry imports and has the other queries, and their tests are found and run."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[2]
    for name in ("lodestone", "tests"):
        shutil.copytree(top / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
    run = lambda *args: subprocess.run([sys.executable, "-m", "pytest", "-q", *args], cwd=tmp_path, timeout=600, capture_output=True, text=True)
    assert "error" not in run("--collect-only", "tests").stdout.lower()
    some = run("tests", "-k", "test_entry or hash_split or test_byte_ids")
    assert some.returncode == 0, some.stdout


def test_missing_libraries_leave_the_rest(tmp_path):
    """Where a library of the operators can't be imported, the other queries are there."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'op3_decontamination' not in q and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], check=True, timeout=120)


def test_nothing_else_imports_this():
    from pathlib import Path

    top = Path(__file__).resolve().parents[2] / "lodestone"
    for path in top.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import)\s+lodestone\.llm", path.read_text(), re.M), path
