"""Token files, rANS, archives, formatting, mixing and URL rules."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, media, mixing, rans, token_output, url_filter
from tessera.llm.files import open_file
from tessera.llm.mixing import mix, plan_mix
from tests.conftest import tables_dir
from tests.llm.cases import ODD, documents, ordered, texts


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, rans.BLOCK, 2 * rans.BLOCK + 5])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_000).astype(np.uint32)
    coding = rans.Table.of_counts(np.bincount(ids, minlength=1 << 16))
    blocks = rans.encode_blocks(ids, coding)
    assert np.array_equal(np.concatenate([*rans.decode_blocks(blocks, coding), np.zeros(0, np.uint32)]), ids)
    if n > 1000:
        p = np.bincount(ids) / n
        entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() / 8
        assert sum(len(b) for _, b in blocks) < n * entropy * 1.03 + 8 * rans.LANES * len(blocks)


def test_rans_flat_table():
    counts = np.arange(60_000) % 3
    table = rans.Table.of_counts(counts)
    assert table.freq.sum() == 1 << rans.SCALE and ((table.freq > 0) == (counts > 0)).all()


def test_word_coder():
    coder = token_output.WordCoder(token_output.default_tokenizer())
    odd = ["", " ", "a  b", " a", "a ", "x\n y", "a\n\n b\tc", "é ñ　z", "a\u00a0b c", "<|endoftext|> x", "it's 12 %%% ok."]
    odd += ["\n", "a\n", "a\nb", "a.\nB, c", "a\n\nb", "é,\né. x:", "a's b're\nc;", "1, 2.\n3 a1, b", "x \ny", "\nx", "a\n\n", "- a\n- b", "a\n.b ,c"]
    assert coder.fast
    for t in odd + texts(5):
        assert coder.encode(t) == coder.whole(t)


def test_words_reach_the_model_once():
    coder = token_output.WordCoder(token_output.default_tokenizer())
    calls, merge = Counter(), coder.merge
    coder.merge = lambda w: (calls.update([w]), merge(w))[1]
    some = ["1 red lamp, red\nlamp. blue", "1 blue lamp: red. lamp%%% red%%%", "1 red\nlamp! été, été.\nété%%%", "1 lamp? lamp;\nred; blue?"]
    for t in some:
        assert coder.encode(t) == coder.whole(t)
    assert max(calls.values()) == 1


def test_texts_together(monkeypatch):
    """Many texts at a time, pieces of all kinds, a cache that never holds them: the library's ids."""
    rng = random.Random(3)
    bodies = ["red", "Lampe", "été", "ñ", "a1", "12", "it's", "x_y", "a-b", "東京", "Ⅳ", "é", "(b", "<|end", "​"]
    tails = ["", "", "", ".", ",", "...", "%%%", "'", "'s", "_", ")!", ".a", "…"]
    some = [rng.choice([" ", "\n"]).join("".join(rng.choice(x) for x in (bodies, tails)) + rng.choice(["", "", "\nb", " c."]) for _ in range(rng.randrange(12))) for _ in range(400)]
    some += ["", "\n", ".", "red\n\nred", " red", "red."]
    for size in (250_000, 7):
        monkeypatch.setattr(token_output, "CACHE_WORDS", size)
        coder = token_output.WordCoder(token_output.default_tokenizer())
        for n in (1, 10, 500):
            got = [x for i in range(0, len(some), n) for x in coder.encode_all(some[i : i + n])]
            assert got == [coder.whole(t) for t in some]
            assert len(coder.kept) <= size and len(coder.before) <= size
    assert coder.encode_all([]) == []
    assert sum(not coder.odd(t) for t in some) > 50


def test_added_tokens(spark):
    """The ids are the library's own, also where a text holds an added token's string."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_output.default_tokenizer())
    rows = list(enumerate(["a b <|endoftext|> c", "<|endoftext|>", "a<|endoftext|>b c\nd", "é <|endoftext|><|endoftext|> é", "<|endoftext |> a", "a b c"]))
    want, start = [], 0
    coder = token_output.WordCoder(token_output.default_tokenizer())
    for i, t in rows:
        own = plain.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode(t), np.uint32).tolist() == own
        want.append((i, start, len(own) + 1, zlib.crc32(np.array([*own, 2], "<u4").tobytes())))
        start += len(own) + 1
    assert 50256 in plain.encode(rows[0][1], add_special_tokens=False).ids
    assert sorted(tuple(r) for r in token_output.tokenized(documents(spark, rows)).collect()) == want


@pytest.mark.parametrize("rows", [list(enumerate(texts(6))), ODD, []], ids=["random", "odd", "empty"])
def test_tokens(spark, rows):
    got = [tuple(r) for r in token_output.tokenized(documents(spark, rows)).collect()]
    coder, start, want = token_output.WordCoder(token_output.default_tokenizer()), 0, []
    for i, t in ordered(rows):
        ids = np.append(np.frombuffer(coder.whole(t or ""), np.uint32), np.uint32(2)).astype("<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_long_text_tokens(spark):
    """A text of more ids than a file, and than a reading task's share, between short ones."""
    long = " ".join(f"{w}{i % 97}" for i in range(60_000) for w in ("alpha", "beta"))
    rows = [(1, "a"), (2, long), (3, None), (4, "b c")]
    got = sorted(map(tuple, token_output.tokenized(documents(spark, rows)).collect()))
    coder, start = token_output.WordCoder(token_output.default_tokenizer()), 0
    for (i, t), g in zip(rows, got):
        ids = np.append(np.frombuffer(coder.whole(t or ""), np.uint32), np.uint32(2)).astype("<u4")
        assert g == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    files = token_output.write_tokens(documents(spark, rows), token_output.scratch_path(spark, "t"), token_output.default_tokenizer(), file_ids=1000)
    parts = token_output.read_tokens(files, digest=True).collect()
    assert sorted(map(tuple, parts)) == got


def test_token_query(spark):
    from tokenizers import Tokenizer

    plain, start = Tokenizer.from_file(token_output.default_tokenizer()), 0
    got = {r["doc_id"]: tuple(r)[1:] for r in token_output.op10_token_output(spark, tables_dir()).collect()}
    for r in spark.read.parquet(f"{tables_dir()}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert got.pop(r["doc_id"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_every_added_string():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_output.default_tokenizer())
    coder = token_output.WordCoder(token_output.default_tokenizer())
    for token in plain.get_added_tokens_decoder().values():
        for t in (token.content, f"a {token.content} b", f"a{token.content}b\nc", token.content * 2, token.content[:-1]):
            assert np.frombuffer(coder.encode(t), np.uint32).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_damaged_block(spark, tmp_path):
    files = token_output.write_tokens(documents(spark), f"file://{tmp_path}/t", token_output.default_tokenizer(), file_ids=3000)
    listed = files.collect()
    assert len(listed) > 3 and [r["start"] for r in listed] == list(np.cumsum([0, *[r["n_ids"] for r in listed[:-1]]]))
    assert [len(r["ids"]) // 4 for r in token_output.read_tokens(files, 7).orderBy("start").collect()] == [r["n_tokens"] for r in token_output.read_tokens(files, digest=True).orderBy("start").collect()]
    path = listed[0]["path"]
    with open_file(path) as f:
        footer = token_output.read_footer(f)
        table = token_output.file_table(f, footer)
        whole = token_output.decode_range(f, footer, table, 0, sum(footer["ids"]))
        assert np.array_equal(token_output.decode_range(f, footer, table, 5, 40), whole[5:40])
    local = path.removeprefix("file://")
    data = bytearray(open(local, "rb").read())
    data[len(token_output.MAGIC) + 8 * rans.LANES + 3] ^= 1
    open(local, "wb").write(bytes(data))
    with open_file(path) as f, pytest.raises(ValueError, match="checksum"):
        token_output.decode_range(f, footer, table, 0, sum(footer["ids"]))


def brute_media(i, t):
    """All columns of a stored text, the image and its feature made by other means."""
    data = (t or "").encode()
    payload = data + b"\0" * (64 if not data else -len(data) % 64)
    piece = lambda k, body: len(body).to_bytes(4, "big") + k + body + zlib.crc32(k + body).to_bytes(4, "big")
    lines = b"".join(b"\0" + payload[a : a + 64] for a in range(0, len(payload), 64))
    size = b"\0\0\0\x40" + (len(payload) // 64).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    image = b"\x89PNG\r\n\x1a\n" + piece(b"IHDR", size) + piece(b"IDAT", zlib.compress(lines, 3)) + piece(b"IEND", b"")
    counts = Counter(payload)
    shares = [sum(n for b, n in counts.items() if b // 32 == k) / len(payload) for k in range(8)]
    bits = sum(-n / len(payload) * math.log2(n / len(payload)) for n in counts.values())
    about = f"rows={len(payload) // 64};mean={sum(payload) / len(payload):.4f};bits={bits + 0.0:.4f};shares=" + ",".join(f"{x:.4f}" for x in shares)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return i, len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(image), sha(image), about


@pytest.mark.parametrize("rows", [list(enumerate(texts(7))), ODD, [], [(1, "long é " * 400_000), (2, "b")]], ids=["random", "odd", "empty", "long"])
def test_media(spark, rows):
    got = sorted((tuple(r) for r in media.stored_texts(documents(spark, rows)).collect()), key=repr)
    assert got == sorted((brute_media(i, t) for i, t in rows), key=repr)


def test_media_query(spark):
    docs = spark.read.parquet(f"{tables_dir()}/documents.parquet").collect()
    assert {tuple(r) for r in media.op4_media_columns(spark, tables_dir()).collect()} == {brute_media(r["doc_id"], r["text"]) for r in docs}


def test_padding_and_image():
    assert [len(media.pad(bytes(n))) for n in (0, 1, 63, 64, 65)] == [64, 64, 64, 64, 128]
    for n in (64, 640):
        payload = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
        assert media.from_image(media.to_image(payload)) == payload
    broken = bytearray(media.to_image(bytes(64)))
    broken[45] ^= 1
    with pytest.raises(ValueError):
        media.from_image(bytes(broken))


def test_ranges_and_retries(spark, tmp_path):
    folder = f"file://{tmp_path}/arc"
    docs = documents(spark).select(F.col("doc_id").alias("id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    media.write_archives(docs, folder)
    (tmp_path / "arc" / "left-by-a-lost-task.arc").write_bytes(b"half")
    tiny = media.read_archives(spark, folder, rangebytes=500)
    assert tiny.rdd.getNumPartitions() > 20 and tiny.count() == docs.count()
    reader = media.ArchiveReader({"path": folder})
    part = next(p for p in reader.partitions() if p.lo == 0)
    offset, length, crc, *_ = reader.index(part.path)[1]
    calls = []

    class Flaky:
        def __init__(self, path):
            self.f = open_file(path)
            calls.append(path)

        def seek(self, at):
            self.at = at

        def read(self, n):
            if len(calls) == 1:
                raise OSError("lost")
            self.f.seek(self.at)
            data = self.f.read(n)
            return data[:-1] if len(calls) == 2 else data

    reader.opener = Flaky
    assert zlib.crc32(reader.member(part.path, offset, length, crc)) == crc and len(calls) == 3
    with pytest.raises(ValueError, match="checksum"):
        reader.member(part.path, offset, length, crc + 1)


def python_targets(sizes, weights=(1.0, 2.0, 3.0), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, cut, target = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(most * sizes[s] for s in cut)
        w = sum(weight[s] for s in names if s not in cut)
        target = {s: most * sizes[s] if s in cut else left * weight[s] / w for s in names}
        over = {s for s in names if s not in cut and target[s] > most * sizes[s]}
        if not over:
            return target
        cut |= over


@pytest.mark.parametrize("rows", [list(enumerate(texts(8, 300))), ODD], ids=["random", "odd"])
def test_mix(spark, rows):
    docs = documents(spark, rows).cache()
    plan = plan_mix(docs).collect()
    assert len(plan) == len(rows)
    size, taken, largest = Counter(), Counter(), Counter()
    for r in plan:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 3
    want = python_targets(size)
    for r in plan:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == size[r["source"]]
    for s in size:
        assert abs(taken[s] - want[s]) <= 3 * largest[s] + 1
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    copies = Counter((r["doc_id"], r["source"], r["text"]) for r in mixed.collect())
    words = Counter()
    for (_, s, t), n in copies.items():
        words[s] += n * len((t or "").split())
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}
    again = sorted(map(tuple, plan_mix(docs.repartition(7)).collect()), key=repr)
    assert again == sorted(map(tuple, plan), key=repr)


def test_small_rates(spark):
    """A source of a millionth of its weight's share still gives its target."""
    rows = [(i, "w " * 50) for i in range(4000)] + [(10_000, "a b c")]
    docs = documents(spark, rows).withColumn("source", F.when(F.col("doc_id") < 4000, F.lit("z")).otherwise(F.lit("a")))
    for big, seed in ((1e5, 0), (1e7, 1), (1e7, 2)):
        plan = plan_mix(docs, weights=(big, 1.0), seed=seed).groupBy("source").agg(F.first("target"), F.sum(F.col("size") * F.col("copies")), F.max("copies")).collect()
        for _, target, taken, most in plan:
            assert abs(taken - target) <= 50 and most <= 3
    exact = mixing.source_targets(docs.select("source", F.lit(50).alias("size")), weights=(3.0, 1e-6)).where("source = 'z'").first()
    assert exact["expected"] / mixing.UNIT == pytest.approx(exact["target"] / exact["source_size"], rel=1e-4) and exact["expected"] > 0


def test_seeds_differ(spark):
    docs = documents(spark, list(enumerate(texts(8, 300)))).cache()
    plans = {tuple(sorted((r["doc_id"], r["copies"]) for r in plan_mix(docs, seed=s).collect())) for s in range(4)}
    assert len(plans) > 1
    long = documents(spark, [(1, "word " * 300_000), (2, "a b"), (3, None)])
    assert {r["doc_id"]: r["size"] for r in plan_mix(long).collect()} == {1: 300_000, 2: 2, 3: 0}


def test_mix_nothing(spark):
    empty = documents(spark, [(1, "a")]).where("doc_id = 0")
    assert plan_mix(empty).count() == 0 and mix(empty).count() == 0
    only = documents(spark, [(1, "a b c"), (2, "")])
    assert mix(only.withColumn("source", F.lit("s"))).count() >= 1


def chat(spark, pairs):
    turns = lambda x: None if x is None else [tuple(t) for t in x]
    return spark.createDataFrame([(i, turns(a), turns(b), "kept") for i, (a, b) in enumerate(pairs)], f"i int, chosen {chat_format.TURNS}, rejected {chat_format.TURNS}, prompt string")


def test_preference_format(spark):
    u, a, b = ("user", "q"), ("assistant", "yes"), ("assistant", "né")
    rows = {r["i"]: r for r in chat_format.preference_format(chat(spark, [([u, a], [u, b]), ([u, a], [u, a]), (None, [u]), ([a], [("assistant", None)]), ([u, a, u], [u, a])])).collect()}
    draw = lambda *ts: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in ts)
    r = rows[0]
    assert (r["n_common"], r["prompt"], r["chosen_text"], r["rejected_text"]) == (1, draw(u), draw(a), draw(b))
    s, e = map(int, r["rejected_spans"].split("-"))
    assert r["rejected_text"][s:e] == "né<|end|>"
    assert (rows[1]["prompt"], rows[1]["chosen_text"], rows[1]["rejected_text"]) == (draw(u, a), "", "")
    assert (rows[2]["prompt"], rows[2]["chosen_text"], rows[2]["rejected_text"]) == ("", "", draw(u))
    assert rows[3]["n_common"] == 0 and rows[3]["rejected_text"] == draw(("assistant", ""))
    assert (rows[4]["prompt"], rows[4]["chosen_text"], rows[4]["chosen_spans"]) == (draw(u, a), draw(u), "")
    assert chat_format.preference_format(chat(spark, [])).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c"), (None, 0, "user", None), (2, None, None, "x"), (2, 0, "user", "y"), (2, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.preference_format(chat_format.last_reply_pairs(chat_format.conversation_turns(df))).collect()}
    assert got[1]["rejected_text"] == "<|assistant|>\nb<|end|>\n" and got[1]["n_common"] == 2
    assert got[2]["prompt"].endswith("<||>\nx<|end|>\n") and got[2]["chosen_text"] == ""
    assert set(got) == {1, 2, None}


def test_long_and_lone_conversations(spark):
    """A conversation of many turns is one row; turns without a conversation are one each."""
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(5000)] + [(None, 0, "user", "q")] * 300 + [(2, 0, "user", "x" * 10**6)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit("z"))
    got = chat_format.preference_format(chat_format.last_reply_pairs(chat_format.conversation_turns(df))).collect()
    assert Counter(r["conv_id"] for r in got) == {1: 1, None: 300, 2: 1}
    one = next(r for r in got if r["conv_id"] == 1)
    assert one["n_common"] == 4999 and one["chosen_text"] == "<|assistant|>\nt4999<|end|>\n" and one["rejected_text"] == "<|assistant|>\nt4997<|end|>\n"
    assert chat_format.preference_format(chat_format.last_reply_pairs(chat_format.conversation_turns(df.where("false")))).count() == 0


def test_very_long_urls(spark):
    url = "http://" + "a." * 30_000 + "com/en/" + "x" * 100_000
    got = judge(spark, [url, "http://b.co.uk/"])
    assert got[0]["host"] == "a." * 30_000 + "com" and got[0]["verdict"] == "block" and got[1]["verdict"] == "allow"


def judge(spark, urls, labels=()):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x"))
    marks = spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")
    return {r["page_id"]: r for r in url_filter.filter_urls(pages, marks).collect()}


def test_url_rules(spark):
    urls = [
        "http://A.EXAMPLE.com/en/71?x#y", "http://example.com/en/6", "http://com/en/", "http://notcom/en/", "http://b.example.net/de/81", "http://net/de/8",
        "http://x.org/es/#z", None, "no scheme", "ftp://Ä.com?q", "a://b://c/d", "http://x.org/es", "://h\n/p\nq",
    ]
    got = judge(spark, urls)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [
        ("a.example.com", "/en/71", "example.com/en/7", "allow"), ("example.com", "/en/6", "com/en/", "block"), ("com", "/en/", "com/en/", "block"),
        ("notcom", "/en/", None, "allow"), ("b.example.net", "/de/81", "example.net/de/8", "block"), ("net", "/de/8", "net/de/", "allow"),
        ("x.org", "/es/", "org/es/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("Ä.com", "", None, "allow"), ("b:", "//c/d", None, "allow"),
        ("x.org", "/es", None, "allow"), ("h\n", "/p\nq", None, "allow"),
    ]


def test_reputation(spark):
    urls = [f"http://bad.a.com/{i}" for i in range(40)] + [f"http://good{i % 4}.b.com/{i}" for i in range(120)] + ["http://new.a.com/", "http://few.c.org/"]
    labels = [(i, 0, 0) for i in range(40)] + [(i, 1, 0) for i in range(40, 160)] + [(161, 0, 0), (None, 0, 0), (3, None, None)]
    got = judge(spark, urls, labels)
    assert {got[i]["verdict"] for i in range(40)} == {"block"}
    assert {got[i]["verdict"] for i in range(40, 160)} == {"allow"}
    assert got[161]["verdict"] == "allow"  # one bad label doesn't convict a host
    assert got[0]["mean"] < got[160]["mean"] < got[40]["mean"]
    assert judge(spark, [], labels) == {}
    twice = judge(spark, urls[:2], labels[:2] * 3)
    assert len(twice) == 2


def test_long_suffixes(spark):
    urls = [f"http://h{i % 4}.bad.co.uk/{i}" for i in range(80)] + [f"http://h{i % 4}.good.co.uk/{i}" for i in range(80)] + ["http://new.bad.co.uk/", "http://new.good.co.uk/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    marks = spark.createDataFrame([(i, int(i >= 80), 0) for i in range(160)], "doc_id long, quality int, toxic int")
    mean = lambda **k: {r["page_id"]: r["mean"] for r in url_filter.filter_urls(pages, marks, **k).where("page_id >= 160").collect()}
    alike, apart = mean(suffixes=()), mean(suffixes=("co.uk", "com.au"))
    assert mean() == apart
    assert alike[160] == alike[161] and apart[160] < 0.3 and apart[161] > 0.7
    hosts = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("co.uk",), ("uk",), ("a.xco.uk",), ("a.b.com",), ("",)], "host string")
    got = [tuple(r) for r in hosts.select(url_filter.domain_of(F.col("host"), ("co.uk",)), url_filter.suffix_of(F.col("host"), ("co.uk",))).collect()]
    assert got == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("uk", "uk"), ("xco.uk", "uk"), ("b.com", "com"), ("", "")]
