"""Personal data, chat windows, encoding, quality, contamination, sharding and licences against plain versions."""

import random
import re
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from needwell.llm import bpe, chat, contamination, licenses, pii, quality, sharding


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_pii_base(docs, rows, result):
    found = pii.find_spans(docs)
    base = pii._joined(F.filter("spans", lambda s: s["kind_no"] < 4)).alias("base")
    want = [(i, brute.pii(t)[1]) for i, t in pairs(rows)]
    assert result(found.select("doc_id", base), "doc_id", "base") == sorted(want, key=repr)


def test_pii_checksums_and_context(docs):
    one = docs.where("doc_id = 913")
    text, spans = one.first()["text"], pii.find_spans(one).first()["spans"]
    found = [(s["kind"], text[s["start"] : s["end"]]) for s in spans]
    assert found == [("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789")]


def test_account_numbers_before_capitals_and_digits(spark):
    """What follows a number after a blank is no part of it, nor is a failing number in front."""
    german, british, spaced = "DE89370400440532013000", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00"
    texts = [
        (f"IBAN {german} Please pay", [german]),
        (f"{german} I paid", [german]),
        (f"IBAN {spaced} BIC COBADEFFXXX", [spaced]),
        (f"{british} 12 May", [british]),
        (f"{german} {british} {spaced}", [german, british, spaced]),
        (f"NO12 {german} A", [german]),
        (f"é {spaced} {british}x {german}1", [spaced]),
        ("DE88370400440532013000 Please", []),
        ("DE8937040044053201300 0 1", ["DE8937040044053201300 0"]),
        (" ".join([german] * 300), [german] * 300),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    spans = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == "iban"] for r in pii.find_spans(df).collect()}
    assert {i: [t[s["start"] : s["end"]] for s in spans[i]] for i, (t, _) in enumerate(texts)} == {
        i: found for i, (_, found) in enumerate(texts)
    }
    assert [spans[i][0]["score"] for i in (0, 1, 3)] == [1.0, 0.8, 0.8]


def test_pii_fuzz(spark, result):
    rng = random.Random(2)
    parts = ["a", "@", ".", "-", "1", "23", " ", "+", "(", "%", "_", "b.c", "4111 1111 1111 1111", "1.2.3.4", "é", "x@y.z"]
    data = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(1500)]
    found = pii.find_spans(spark.createDataFrame(data, "doc_id long, text string"))
    base = pii._joined(F.filter("spans", lambda s: s["kind_no"] < 4)).alias("base")
    assert result(found.select("doc_id", base), "doc_id", "base") == sorted([(i, brute.pii(t)[1]) for i, t in data], key=repr)


def conversations(spark):
    rng = random.Random(4)
    odd = ["</s>", "[INST]", "\\", "<s>", "[/INST]", "<\\s>", "\n", "word ", "é", "\\\\s>", "<", "s>"]
    data = []
    for conv in range(40):
        for turn in range(rng.randint(1, 12)):
            role = "system" if turn == 0 and conv % 3 == 0 else ("user", "assistant")[turn % 2]
            text = "".join(rng.choice(odd) for _ in range(rng.randint(0, 600)))
            data.append((conv, turn, role, text))
    data += [(50, 0, None, None), (50, 1, "assistant", None), (50, 1, "assistant", "x"), (50, 1, "assistant", "x")]
    data += [(None, None, "user", "hello"), (None, 1, "assistant", "there"), (51, 0, "</s>[INST]", "y" * 9000)]
    return data, spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("w"))


@pytest.mark.parametrize(("budget", "history"), [(1024, 256), (120, 40), (10, 0)])
def test_chat_reads_back_whole(spark, budget, history):
    data, df = conversations(spark)
    windows = chat.format_windows(df, budget, history)
    back = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    groups = {}
    for conv, turn, role, text in data:
        groups.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert back.keys() == groups.keys()
    for conv, turns in groups.items():
        turns.sort()
        row = back[conv]
        assert row["n_turns"] == len(turns)
        assert row["turns"] == "".join(f"{r}\n{t}\n" for _, r, t in turns)
        assert row["targets"] == "".join(t for _, r, t in turns if r == "assistant")


def test_a_long_system_turn_is_kept_once(spark):
    """A system turn over half of what a window may hold is no part of the other windows, and budgets hold."""
    data = [(1, 0, "system", "s" * 40_000)] + [(1, i, "user" if i % 2 else "assistant", "t" * 11) for i in range(1, 401)]
    data += [(2, 0, "system", "s" * 4 * (384 - chat.PER_TURN))] + [(2, i, "user", "t" * 400) for i in range(1, 30)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df).orderBy("conv_id", "window").collect()
    size = lambda w: sum(len(p.split("[/INST]")[1]) / 4 + chat.PER_TURN for p in w["formatted"].split("</s>")[:-1])
    long, short = ([w for w in windows if w["conv_id"] == c] for c in (1, 2))
    assert [w["formatted"].count("ssss") > 0 for w in long] == [True] + [False] * (len(long) - 1) and len(long) < 30
    assert all(size(w) <= chat.BUDGET for w in [*long[1:], *short]) and sum(len(w["formatted"]) for w in long) < 70_000
    assert all(w["formatted"].startswith("<s>[INST]%s:system" % ("r" if w["window"] else "o")) for w in short) and len(short) > 1
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_windows(df)).collect()}
    assert back[1]["targets"] == "t" * 11 * 200 and back[1]["n_turns"] == 401


def test_chat_windows_keep_budget_and_history(spark):
    turns = [(1, t, "system" if t == 0 else ("user", "assistant")[t % 2], "abcd" * 20) for t in range(30)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = chat.format_windows(df, budget=300, history=60).orderBy("window").collect()
    assert len(rows) > 5
    for number, row in enumerate(rows):
        pieces = row["formatted"].split("</s>")[:-1]
        tokens = sum(len(p.split("[/INST]")[1]) / 4 + chat.PER_TURN for p in pieces)
        assert tokens <= 300 and pieces[0].split("[/INST]")[0].endswith(":system")
        assert [p[9] for p in pieces].count("r") == (3 if number else 0)
        assert all(row["formatted"][s["start"] : s["end"]] == "abcd" * 20 for s in row["loss"])
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


def test_sharding_law(docs, rows, result):
    placed = sharding.assign_shards(docs, 8)
    got = placed.collect()
    n = len(rows)
    assert len(got) == n
    sizes = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert sorted(r["row_no"] for r in got) == list(range(n))
    for r in got:
        assert (r["shard"], r["slot"]) == sharding.locate(r["row_no"], n, 8)
        assert sharding.row_at(r["shard"], r["slot"], n, 8) == r["row_no"]
    want = sorted([(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs(rows)], key=repr)
    assert result(placed, "doc_id", "size", "text_crc32") == want
    again = sharding.assign_shards(docs.repartition(9), 8)
    key = ("doc_id", "size", "text_crc32", "shard", "slot")
    assert result(again.distinct(), *key) == result(placed, *key)


def test_sharding_of_nothing(empty):
    assert sharding.assign_shards(empty, 8).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    out = sharding.permute(np.arange(n), n)
    assert sorted(out.tolist()) == list(range(n))
    assert (sharding.permute(out, n, back=True) == np.arange(n)).all()


def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def test_bpe_equals_the_library(docs, rows, result):
    tokenizer = library()
    want = []
    for i, t in pairs(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(text)))
    got = result(bpe.round_trip(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(want, key=repr)
    encoded = bpe.encode(docs)
    decoded = bpe.decode(encoded).select("doc_id", F.sha2("text", 256).alias("d"))
    assert result(decoded, "doc_id", "d") == sorted([(w[0], w[3]) for w in want], key=repr)


def test_bpe_fuzz():
    tokenizer, own = library(), bpe.encoder(bpe.default_vocabulary())
    rng = random.Random(1)
    odd = ["the", "ing", "'s", "'LL", "<|endoftext|>", "<|startoftext|> ", "\n\t", " ", "é", "é", "Σ", "ΑΣ", "İ", "漢字", "🙂"]
    odd += ["23", "!?", "\0", "͸", "꟎", "qu", "er", "aaaaaaaa", "http://", "</w>", "\u0085", "<|"]
    for _ in range(4000):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(0, 12)))
        text += "".join(rng.choice("abcdefghinorstuvzé") for _ in range(rng.randint(0, 20)))
        assert own.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
    for text in ("a" * 5000, "ab" * 3000):
        assert own.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_quality_base(docs, rows, result):
    got = result(quality.quality(docs), "doc_id", *quality.BASE_COLUMNS, "base_failed")
    assert got == sorted([(i, *brute.quality(t)) for i, t in pairs(rows)], key=repr)


def test_quality_buckets(spark):
    values = [*range(0, 5000), 10**6, 2**31, 2**40 + 7]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket(F.col("v")).alias("b"))
    rows = df.withColumn("low", quality.bucket_floor(F.col("b"))).orderBy("v").collect()
    assert all(a["b"] <= b["b"] for a, b in zip(rows, rows[1:], strict=False))
    assert all(r["low"] <= r["v"] <= r["low"] * 17 / 16 for r in rows)


def test_quality_fences_follow_the_group(spark):
    """A share of signs that is usual in one source is an outlier in another; small groups take the language's fences."""
    rng = random.Random(9)
    prose = lambda sign, n: " ".join("w%d%s" % (rng.randrange(9000), sign if i < n else "") for i in range(100))
    data = [(i, "en", "clean", prose("#", 0)) for i in range(200)] + [(1000 + i, "en", "code", prose("#", 60)) for i in range(200)]
    data += [(2000, "en", "clean", prose("#", 60)), (2001, "en", "tiny", prose("#", 0)), (2002, "en", "code", prose("#", 60))]
    judged = quality.quality(spark.createDataFrame(data, "doc_id long, lang string, source string, text string"))
    assert {r["doc_id"] for r in judged.where("NOT kept").collect()} == {2000}


def test_quality_keeps_columns(docs, empty):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert quality.keep_good(empty).count() == 0 and quality.quality(empty).count() == 0


def items():
    rng = random.Random(8)
    words = ["w%d" % i for i in range(30)]
    runs = [[rng.choice(words) for _ in range(rng.choice([3, 12, 13, 14, 40, 60]))] for _ in range(25)]
    table = [(i % 20, " ".join(r)) for i, r in enumerate(runs)] + [(30, None), (31, "..."), (None, "Solo ITEM"), (32, "solo")]
    docs = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 5)):
            run = rng.choice(runs)
            start = rng.randrange(len(run))
            text += run[start : start + rng.randint(1, 50)] + [rng.choice(["zz", "w1", "solo item"])] * rng.randint(0, 9)
        docs.append((i, ", ".join(text).title()))
    return docs + [(200, None), (201, "!!"), (None, docs[3][1]), docs[5]], table


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_contamination(spark, result, block_bytes):
    docs, table = items()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("x"))
    found = contamination.contamination(df, spark.createDataFrame(table, "item_id long, text string"), block_bytes=block_bytes)
    got = result(
        found.select(
            "doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("h"), "contaminated"
        ),
        "doc_id", "n_words", "n_hit", "n", "h", "contaminated",
    )
    assert got == sorted(brute.contamination(docs, table), key=repr)


def test_decontamination_leaves_the_rest_alone(spark, docs, rows, empty):
    table = spark.createDataFrame([(1, rows[0][1]), (2, None)], "item_id long, text string")
    clean = contamination.drop_contaminated(docs, table)
    want = [r for r in brute.contamination(pairs(rows), [(1, rows[0][1])]) if not r[5]]
    assert clean.columns == docs.columns and clean.count() == len(want)
    assert contamination.drop_contaminated(docs, table.limit(0)).count() == len(rows)
    assert contamination.drop_contaminated(empty, table).count() == 0


def plain_cut(text, table, length, coverage):
    """A text without runs of words that lie in windows of items, found window by window."""
    find = lambda t: list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)))
    windows = set()
    for _, item in table:
        words = [m.group() for m in find(item or "")]
        size = min(len(words), contamination.WINDOW)
        windows |= {tuple(words[i : i + size]) for i in range(len(words) - size + 1) if size}
    found = find(text)
    words, hit = [m.group() for m in found], [False] * len(found)
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit[i : i + size] = [True] * size
    every, out, i = coverage * sum(hit) >= len(words), "", 0
    end = 0
    while i < len(words):
        j = i
        while j < len(words) and hit[j]:
            j += 1
        if j > i and (every or j - i >= length):
            out, end = out + text[end : found[i].start()], found[j - 1].end()
        i = max(j, i + 1)
    return out + text[end:]


@pytest.mark.parametrize(("length", "coverage", "block_bytes"), [(13, 20, 1 << 20), (20, 2, 400), (1, 1, 1 << 20)])
def test_spans_are_cut_out(spark, length, coverage, block_bytes):
    docs, table = items()
    docs = [(i, t and f"Ünö {t} -é-") for i, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("x"))
    given = spark.createDataFrame(table, "item_id long, text string")
    cut = contamination.cut_contaminated(df, given, length, coverage, block_bytes=block_bytes)
    assert cut.columns == df.columns
    want = [(i, None if t is None else plain_cut(t, table, length, coverage)) for i, t in docs]
    assert sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w != t for (_, w), (_, t) in zip(want, docs, strict=True)) > 20


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_columns_named_like_those_of_the_scan(spark, block_bytes):
    docs, table = items()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    given = spark.createDataFrame(table, "item_id long, text string")
    clash = df.select("doc_id", F.lit(1).alias("_dc_spans"), "text", F.lit("x").alias("_dc_n_words"), F.lit(2).alias("_0"), F.lit(3).alias("a b.c"))
    for operator in (contamination.drop_contaminated, contamination.cut_contaminated):
        plain = operator(df, given, block_bytes=block_bytes)
        found = operator(clash, given, block_bytes=block_bytes)
        assert found.columns == clash.columns
        assert {tuple(r)[1:2] + tuple(r)[3:] for r in found.collect()} == {(1, "x", 2, 3)}
        assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, found.select("doc_id", "text").collect()), key=repr)


def test_cutting_leaves_the_rest_alone(spark, docs, rows, empty):
    table = spark.createDataFrame([(1, rows[0][1]), (2, None)], "item_id long, text string")
    cut = contamination.cut_contaminated(docs, table.limit(0))
    assert cut.columns == docs.columns and cut.exceptAll(docs).count() == 0 and cut.count() == len(rows)
    assert contamination.cut_contaminated(empty, table).count() == 0


def test_decontaminate_drops_and_cuts(spark, docs, rows, empty):
    """Contaminated documents go, long passages in others are cut out, short ones and all else stay."""
    item, short = " ".join(f"q{i}" for i in range(20)), "just four words here"
    filler = " ".join(f"f{i}" for i in range(600))
    texts = [
        (1, f"{item} and little else", 7),
        (2, f"{filler}\n{item}, {filler}", 7),
        (3, f"{filler} {short} {filler}", 7),
        (4, filler, 7),
        (5, None, None),
        (6, "", 0),
        (2, f"{filler}\n{item}, {filler}", 7),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string, n_chars int").withColumn("_dc_out", F.lit("mine"))
    benchmark = spark.createDataFrame([(1, item), (2, short), (3, None)], "item_id long, text string")
    got = sorted(map(tuple, contamination.decontaminate(df, benchmark).collect()), key=repr)
    cut = (2, f"{filler}\n, {filler}", len(f"{filler}\n, {filler}"), "mine")
    assert got == sorted([cut, cut, *[(*t, "mine") for t in texts[2:6]]], key=repr)

    own = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    left = contamination.decontaminate(docs, own)
    assert left.schema.names == docs.columns
    assert left.count() == contamination.drop_contaminated(docs, own).count()
    assert contamination.decontaminate(docs, own.limit(0)).exceptAll(docs).count() == 0
    assert contamination.decontaminate(empty, own).count() == 0


def test_licences(spark):
    notice = licenses.TEMPLATES["MIT"][2]
    files = [
        ("a/x.py", "# Released under the MIT License.\ncode"),
        ("a/LICENSE", "Copyright someone\n\n" + notice + "\nthe software is provided as is"),
        ("a/b/y.py", "just code"),
        ("a/b/c/z.py", "more code\n" * 9 + "Licensed under CC BY-NC 4.0."),
        ("a/b/c/q.py", "nothing"),
        ("a/bb/q.py", "nothing"),
        ("d/q.py", "Apache was a people; version 2.0 of a text under the moon"),
        ("root.txt", ""),
        (None, "Released under the MIT License."),
        (None, None),
        ("d/e", None),
    ]
    df = spark.createDataFrame(files, "path string, text string").withColumn("license", F.lit("x"))
    got = {(r["path"], r["own_license"], r["place"]): (r["license"], r["from_folder"]) for r in licenses.license_scan(df).collect()}
    assert got == {
        ("a/x.py", "MIT", "header"): ("MIT", None),
        ("a/LICENSE", "MIT", "header"): ("MIT", None),
        ("a/b/y.py", None, None): (None, None),
        ("a/b/c/z.py", "CC-BY-NC-4.0", "file"): ("CC-BY-NC-4.0", None),
        ("a/b/c/q.py", None, None): ("CC-BY-NC-4.0", "a/b/c"),
        ("a/bb/q.py", None, None): (None, None),
        ("d/q.py", None, None): (None, None),
        ("root.txt", None, None): (None, None),
        (None, "MIT", "header"): ("MIT", None),
        (None, None, None): (None, None),
        ("d/e", None, None): (None, None),
    }
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_licence_files_are_judged_apart_from_headers(spark):
    """A file that is little but a licence, or has a licence file's name, covers its folder; a mere header does not."""
    notice = licenses.TEMPLATES["MIT"][2]
    files = [
        ("short/x", "Released under the MIT License.\ntext"),
        ("short/in/y", "text"),
        ("named/LICENSE", notice + "\nmany other words follow here" * 9),
        ("named/in/y", "text"),
        ("both/x", "Released under the MIT License.\n" + "text\n" * 9 + "Licensed under CC BY-NC 4.0. See there."),
        ("both/in/y", "text"),
        ("header/x.py", "Released under the MIT License." + "\nmany other words follow here" * 9),
        ("header/in/y", "text"),
        ("none/COPYING", "many other words"),
        ("none/in/y", "text"),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    rows = {r["path"]: r for r in licenses.license_scan(df, apart=True).collect()}
    got = {p.split("/")[0]: (r["license"], r["from_folder"]) for p, r in rows.items() if p.endswith("/in/y")}
    assert got == {
        "short": ("MIT", "short"),
        "named": ("MIT", "named"),
        "both": ("CC-BY-NC-4.0", "both"),
        "header": (None, None),
        "none": (None, None),
    }
    assert (rows["short/x"]["place"], rows["both/x"]["place"], rows["header/x.py"]["place"]) == ("file", "header", "header")


def test_notices_between_the_edges_are_found(spark):
    """After a shebang and copyright lines, in the middle of a long file, wrapped over lines."""
    head = "#!/usr/bin/python\n# encoding: utf-8\n# Copyright someone\n# Copyright another\n"
    code = "\n".join("value %d of a table" % i for i in range(60)) + "\n"
    wrapped = "\n#\n# ".join(licenses.TEMPLATES["MIT"][2].split())
    files = [
        ("a/head", head + "# Released under the MIT License.\n" + code),
        ("a/middle", code + "This part is licensed under CC BY-NC 4.0.\n" + code),
        ("a/wrapped", code + "# " + wrapped + "\n" + code),
        ("a/none", code * 3),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    got = {r["path"]: (r["license"], r["place"], r["from_folder"]) for r in licenses.license_scan(df, apart=True).collect()}
    assert got == {
        "a/head": ("MIT", "body", None),
        "a/middle": ("CC-BY-NC-4.0", "body", None),
        "a/wrapped": ("MIT", "body", None),
        "a/none": (None, None, None),
    }


def test_nearest_folder_wins(spark):
    closing = lambda n: "text\n" * 9 + n
    files = [
        ("r.txt", closing("Released under the MIT License.")),
        ("a/f", closing("Licensed under CC BY-NC 4.0.")),
        ("a/b/c/g", "x"),
        ("a/g", "x"),
        ("z/y/x/h", "x"),
        ("a/b/f", closing("Licensed under the Apache License, Version 2.0.")),
        ("a/b/e", closing("Licensed under CC BY-NC 4.0.")),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    got = {r["path"]: (r["license"], r["from_folder"]) for r in licenses.license_scan(df).collect()}
    assert got["a/b/c/g"] == ("CC-BY-NC-4.0", "a/b")
    assert got["a/g"] == ("CC-BY-NC-4.0", "a") and got["z/y/x/h"] == ("MIT", "")


def test_cosine_is_that_of_plain_vectors():
    import math
    from collections import Counter

    scorer = licenses.Scorer(licenses.TEMPLATES, {"license": 40, "the": 900, "under": 100}, 1000)
    idf = lambda t: math.log(1001 / ({"license": 40, "the": 900, "under": 100}.get(t, 0) + 1)) + 1
    vector = lambda s: {t: n * idf(t) for t, n in Counter(licenses.terms(s)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    part = "released under the mit license of the moon"
    own = vector(part)
    best = max(
        (round(sum(own.get(t, 0) * x for t, x in v.items()) / norm(own) / norm(v), 6), name)
        for name, texts in licenses.TEMPLATES.items()
        for v in map(vector, texts)
    )
    assert scorer.best(part) == best


SENTENCE = licenses.TEMPLATES["GPL-3.0"][1].replace("or any later", "or (at your option) any later")
BY = licenses.TEMPLATES["CC-BY-4.0"][1]
CLAUSES = licenses.TEMPLATES["BSD-2-Clause"][1].replace(": ", ":\n").replace(". ", ".\n")
FAMILIES = {
    SENTENCE: "GPL-3.0",
    SENTENCE.replace("version 3", "version 2"): "GPL-2.0",
    SENTENCE.replace("GNU General", "GNU Affero General"): "AGPL-3.0",
    SENTENCE.replace("GNU General", "GNU Lesser General"): "LGPL-3.0",
    SENTENCE.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"): "LGPL-2.1",
    SENTENCE.replace("version 3", "version 1"): None,
    BY: "CC-BY-4.0",
    BY.replace("Attribution", "Attribution-ShareAlike"): "CC-BY-SA-4.0",
    BY.replace("Attribution", "Attribution-NoDerivatives"): "CC-BY-ND-4.0",
    BY.replace("Attribution", "Attribution-NonCommercial"): "CC-BY-NC-4.0",
    BY.replace("Attribution", "Attribution-NonCommercial-\nShareAlike"): "CC-BY-NC-SA-4.0",
    BY.replace("Attribution", "Attribution-NonCommercial-NoDerivatives"): "CC-BY-NC-ND-4.0",
    BY.replace("4.0", "3.0"): None,
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Copyright 2020 A\n" + CLAUSES: "BSD-2-Clause",
    CLAUSES + "\n" + "Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote "
    "products derived from this software without\nspecific prior written permission.": "BSD-3-Clause",
    CLAUSES.split("\n")[0]: None,
    "Mozilla Public License Version 2.0\n==================\n1. Definitions": "MPL-2.0",
    "ISC License\nCopyright (c) A\n" + licenses.TEMPLATES["ISC"][1] + "\nTHE SOFTWARE IS PROVIDED AS IS": "ISC",
    licenses.TEMPLATES["Unlicense"][0]: "Unlicense",
    "# SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1",
    "# SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0",
    "// SPDX-License-Identifier: GPL-2.0+": "GPL-2.0",
    "SPDX-License-Identifier: EPL-2.0": None,
    "SPDX-License-Identifier: MIT": "MIT",
    "This file is not licensed under the MIT License.": None,
    "This file is no longer\nlicensed under the MIT License.": None,
}


def test_licences_of_a_family_are_told_apart(spark):
    """Each notice alone, between lines of code, and in the middle of a long text."""
    data = []
    for n, notice in enumerate(FAMILIES):
        code = [f"x{i} = y{i * n}" for i in range(40)]
        data += [(f"a{n}", notice), (f"b{n}", "\n".join(["#!x", notice, *code])), (f"c{n}", "\n".join([*code, notice, *code]))]
    found = {r["path"]: r["own_license"] for r in licenses.license_scan(spark.createDataFrame(data, "path string, text string"), apart=True).collect()}
    assert {p: (found[p], t) for p, t in data if found[p] != list(FAMILIES.values())[int(p[1:])]} == {}


def plain_scan(files):
    """Licence and score of each text: every run of lines against every template, one by one."""
    vocabulary = {t for texts in licenses.TEMPLATES.values() for text in texts for t in licenses.terms(text)}
    total, held = len(files), dict.fromkeys(vocabulary, 0)
    for _, text in files:
        for t in vocabulary.intersection(licenses.terms(text or "")):
            held[t] += 1
    weight = lambda t: np.log((total + 1) / (held.get(t, 0) + 1)) + 1

    def vector(text):
        own = licenses.terms(text)
        return {t: own.count(t) * weight(t) for t in own}

    def cosine(x, y):
        size = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return round(float(sum(v * y.get(t, 0) for t, v in x.items()) / size), 6) if size else 0.0

    templates = [(name, vector(text)) for name in sorted(licenses.TEMPLATES) for text in licenses.TEMPLATES[name]]
    out = {}
    for path, text in files:
        lines = [line for line in (text or "").split("\n") if line.strip()]
        runs = [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1)]
        best = 0.0, None
        for i, j in runs:
            part, around = "\n".join(lines[i:j]), "\n".join(lines[max(i - 1, 0) : j + 1])
            own = vector(part)
            for name, template in templates:
                score = cosine(own, template)
                if score >= licenses.THRESHOLD and score > best[0] and licenses.stands(name, part, around):
                    best = score, name
        out[path] = best
    return out


def test_licences_against_every_run_of_lines(spark):
    rng = random.Random(12)
    pieces = [line for texts in licenses.TEMPLATES.values() for text in texts for line in (text, *text.split(", "))]
    words = ["the", "license", "version", "x", "public", "zeta", "2.0", "not"]
    files = []
    for i in range(60):
        lines = [rng.choice([rng.choice(pieces), " ".join(rng.choices(words, k=rng.randint(0, 9)))]) for _ in range(rng.randint(0, 7))]
        files.append((f"p{i}", "\n".join(lines)))
    files += [("null", None), ("empty", "")]
    want = plain_scan(files)
    df = spark.createDataFrame(files, "path string, text string")
    got = {r["path"]: (r["own_license"], r["score"]) for r in licenses.license_scan(df, apart=True).collect()}
    for path, (score, name) in want.items():
        licence, found = got[path]
        assert (licence is None) == (name is None) and (name is None or abs(found - score) < 2e-6), path
    assert sum(name is not None for _, name in want.values()) > 20


def test_licences_on_hostile_rows(docs, rows, empty):
    files = docs.withColumn("path", F.concat(F.lit("a/"), F.col("doc_id").cast("string")))
    assert licenses.license_scan(files, keep=("doc_id",), apart=True).count() == len(rows)
    assert licenses.license_scan(empty.withColumn("path", F.lit("x")), apart=True).count() == 0
