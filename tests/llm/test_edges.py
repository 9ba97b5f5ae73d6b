"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from peerpanel.llm import host_text, latent_leaks, packing, preferences, quality_rules, simhash, token_counts, toxicity, url_rules, warc_zip

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977} of{k}" for k in range(40_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and then it runs far away from here.", "en", "a", 80),
    (1, "The quick brown fox jumps over the lazy dog and then it runs far away from here.", "en", "a", 80),
    (2, "", "en", None, None), (3, None, None, None, None), (4, " \t\n ", "", "a", 4),
    (5, LONG, "en", "a", len(LONG)), (None, "short one", "fr", "b", 9), (None, None, None, None, None),
    (6, "SAME line\nSAME line\nSAME line\n### $$$ |||", "en", "a", 40), (7, "naïve ▁ café  <|endoftext|> <s> 　 \x00 中文", "fr", "b", 30),
]
CLASH = ["fingerprint", "component_id", "piece", "length", "n_words", "kept", "toxic", "n_tokens", "stratum", "severity", "rule"]


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame(ROWS, DOCS)
    return out.select("*", *(F.lit("x").alias(c) for c in CLASH)).repartition(3).checkpoint()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None), (5, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs, 3, 2)
    assert got.columns.count("fingerprint") == 1 and "piece" in got.columns
    rows = got.collect()
    assert len(rows) == len(ROWS)
    blank = {(r["fingerprint"], r["component_id"]) for r in rows if r["doc_id"] in (2, 3, 4)}
    assert blank == {("0" * 16, 2)}
    assert simhash.near_duplicates(none, 3, 2).count() == 0
    one = simhash.one_of_each(docs, 3, 2)
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in one.collect()) == [0, 1, 2, 5, 6, 7]
    assert simhash.one_of_each(none, 3, 2).count() == 0


def test_simhash_odd_distance_and_chains(spark):
    values = [0, 0b111, 0b111111, 1 << 63, 0x0F0F0F0F0F0F0F0F, 0x0F0F0F0F0F0F0F0E]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "_fp long"), 3).collect()
    assert links
    for a, b in links:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    got = {r["_vertex"]: r["component"] for r in simhash.components_of(
        spark.createDataFrame([(v, k) for k, v in enumerate(signed)], "_fp long, id long"), 3, F.col("id")).collect()}
    assert [got[v] for v in signed] == [0, 0, 0, 0, 4, 4]


def test_packing(docs, none):
    got = packing.pack(docs, "byte_bpe_50k.json")
    rows = got.collect()
    assert got.columns.count("length") == 1 and "toxic" in got.columns
    assert sum(r["piece"] == 0 for r in rows) == len(ROWS)
    assert [r["length"] for r in rows if r["doc_id"] in (2, 3)] == [1, 1]
    assert sum(r["doc_id"] == 5 for r in rows) > 50
    assert packing.pack(none, "byte_bpe_50k.json").count() == 0


def test_fast_ids_equal_the_tokenizer():
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    slow, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder("byte_bpe_50k.json")

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.text(), st.text(alphabet="aé ß'sZ09\n\t.,<|>_ \xa0")))
    def same(text):
        assert encode(text) == slow.encode(text, add_special_tokens=False).ids

    same()
    assert encode("a <|endoftext|> b") == slow.encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_ranks_of_another_vocabulary_raise(tmp_path):
    import os

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    os.symlink(path, tmp_path / "own.json")
    lines = open(path.replace(".json", ".tiktoken"), "rb").read().split(b"\n")
    (a, x), (b, y) = lines[700].split(), lines[900].split()
    lines[700], lines[900] = a + b" " + y, b + b" " + x
    (tmp_path / "own.tiktoken").write_bytes(b"\n".join(lines))
    with pytest.raises(ValueError, match="does not belong"):
        packing.encoder(str(tmp_path / "own.json"))


def test_packing_plans():
    import random

    rng = random.Random(5)
    for sizes in ([], [1024] * 3, [1] * 5, [600] * 50 + [500] * 3, [rng.randint(1, 1024) for _ in range(3000)], [rng.choice([340, 342, 350, 520]) for _ in range(3000)]):
        counts = {s: sizes.count(s) for s in set(sizes)}
        plan = packing.make_plan(counts)
        used = [0] * plan.sequences
        placed = dict.fromkeys(counts, 0)
        by = {}
        for length, first, sequence, offset in sorted(plan.runs):
            by.setdefault(length, []).append((first, sequence, offset))
        for length, runs in by.items():
            for (first, sequence, _), after in zip(runs, [*(r[0] for r in runs[1:]), counts[length]], strict=True):
                for k in range(after - first):
                    used[sequence + k] += length
                    placed[length] += 1
        assert placed == counts and all(u <= 1024 for u in used)


def test_token_counts(docs, none):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = token_counts.count_tokens(docs, "piece_bpe_32k.model")
    assert got.columns.count("n_tokens") == 1
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got.collect()) == sorted(
        (r[0] or 0, len((r[1] or "").encode()), len(sp.encode(r[1] or ""))) for r in ROWS)
    assert token_counts.count_tokens(none, "piece_bpe_32k.model").count() == 0


def test_pre_tokens_add_up():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    sp = token_counts.load("piece_bpe_32k.model")

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.text(), st.text(alphabet="ab ▁\né")))
    def same(text):
        own = token_counts.pre_tokens(text)
        assert sum(n * p for n, p in zip(own.values(), token_counts.piece_counts(sp, list(own)), strict=True)) == len(sp.encode(text))

    same()


def test_quality(docs, none, labels):
    got = quality_rules.judge(docs, labels)
    rows = got.collect()
    assert len(rows) == len(ROWS) and got.columns.count("kept") == 1
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [by[k]["kept"] for k in (1, 2, 3, 4, 5)] == [True, False, False, False, True]
    assert by[6]["n_dup_lines"] == 2 and by[6]["n_symbols"] == 9 and by[6]["n_repeat_words"] == 0
    assert quality_rules.judge(none, labels).count() == 0
    assert quality_rules.judge(docs, labels.limit(0)).where("kept").count() == 3
    assert sorted(r["doc_id"] for r in quality_rules.keep(docs, labels).collect()) == [1, 1, 5]


def test_quality_rules_of_more_strata_than_may_be_broadcast(spark, monkeypatch):
    n = 4000
    bad = F.col("id") % 2 == 0
    text = F.when(bad, F.lit("# a1 | b2 # c3 | d4 # e5 | f6 # g7 | h8")).otherwise(F.concat(F.lit("plain words of one clean text no "), F.col("id"), F.lit(" that stays here")))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"),
                                 F.when(F.col("id") % 4 < 3, "en").when(F.col("id") % 5 > 0, F.lit(None)).otherwise("fr").alias("lang"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (~bad).cast("int").alias("quality"))
    want = sorted(map(repr, quality_rules.judge(docs, labels).collect()))
    assert 0 < sum("kept=True" in r for r in want) < n
    monkeypatch.setattr(quality_rules, "MAX_RULE_BYTES", 0)
    assert sorted(map(repr, quality_rules.judge(docs, labels).collect())) == want


def test_repeated_words(spark):
    import re

    texts = ["a b c d e a b c d e", "a a a a a a a", "a b c d e", "", "x " * 9 + "y z", "a b c d e f a b c d e g b c d e f"]
    got = quality_rules.text_metrics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        w = re.findall(r"\S+", t)
        seen = {}
        for k in range(len(w) - 4):
            seen.setdefault(tuple(w[k:k + 5]), []).append(k)
        assert r["n_repeat_words"] == len({k + j for at in seen.values() if len(at) > 1 for k in at for j in range(5)})


def test_binomial_bound_and_certified_cutoffs(spark):
    from math import comb

    cases = [(0, 10, 0.1), (3, 100, 0.1), (50, 1000, 0.1), (99, 1000, 0.1), (5, 20, 0.1)]
    for k, n, p in cases:
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        want = sum(comb(n, j) * p**j * (1 - p)**(n - j) for j in range(k + 1)) if k < n * p else 1.0
        assert got == pytest.approx(want, rel=1e-9)
    # good documents have no symbols but for one in 300; bad ones have many
    rows = [("en", True, 0.0 if k % 300 else 0.9, 0.0, 0.03) for k in range(3000)] + [("en", False, 0.65, 0.0, 0.03) for _ in range(200)]
    rows += [("de", True, 0.0, 0.0, 0.03)] * 50 + [("de", False, 0.65, 0.0, 0.03)] * 50  # too few to certify
    found = quality_rules.certified_cutoffs(spark.createDataFrame(rows, "stratum string, good boolean, symbol_share double, dup_line_share double, caps_share double"))
    assert [tuple(r) for r in found.collect()] == [("en", "symbol_share", 0.6)]


def test_toxicity(spark, docs, none, labels):
    model = toxicity.fit(docs, labels)
    got = toxicity.judge(docs, model)
    assert got.columns.count("toxic") == 1 and got.count() == len(ROWS)
    assert toxicity.judge(none, toxicity.fit(none, labels)).count() == 0
    # held-out accuracy on texts that are toxic by two stems
    import random

    rng = random.Random(1)
    plain = [f"w{k}" for k in range(300)]

    def text(toxic):
        words = [rng.choice(plain) for _ in range(60)]
        for _ in range(rng.randint(1, 6) if toxic else 0):
            words.insert(rng.randrange(60), rng.choice(["vile", "grubby", "grubbiest", "grubbed"]))
        return " ".join(words)

    all_rows = [(k, text(k % 5 == 0), int(k % 5 == 0)) for k in range(2000)]
    frame = spark.createDataFrame(all_rows, "doc_id long, text string, y int")
    model = toxicity.fit(frame, frame.where("doc_id < 1500").select("doc_id", F.col("y").alias("toxic")))
    assert model.thresholds == sorted(model.thresholds)
    held = toxicity.judge(frame.where("doc_id >= 1500"), model)
    wrong = held.where("toxic <> (y = 1)").count()
    assert wrong <= 5
    severe = {r["y"]: r["s"] for r in held.groupBy("y").agg(F.avg("severity").alias("s")).collect()}
    assert severe[1] > 1 > severe[0]


def test_host_text(spark):
    shared = "Read our weekly letter with many words for every single reader of this site today"
    rows = [(k, "http://a.net/x", f"<body><div>{shared}</div><section>Own text of page number {k} with some words</section></body>") for k in range(5)]
    rows += [(10, None, None), (11, "", ""), (12, "x", "<article>Kept <b>bo</b>ld<br>text &amp; more<nav>no</nav><aside>no</aside></article><p class='ad'>no"),
             (13, "http://b.net", f"<p>{shared}</p>"), (0, "http://a.net/x", rows[0][2]), (14, "http://c.net", "<article>" + "long text " * 50_000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(3).checkpoint()
    got = host_text.extract(pages)
    assert sorted(got.columns) == ["n_chars", "page_id", "text", "url"]
    out = sorted((r["page_id"], r["text"]) for r in got.collect())
    assert len(out) == len(rows)
    texts = dict(out)
    assert texts[1] == "Own text of page number 1 with some words"
    assert texts[13] == shared  # found on one page of its host
    assert (texts[10], texts[11], texts[12]) == ("", "", "Kept bold text & more")
    assert texts[14] == ("long text " * 50_000).strip()
    assert host_text.extract(pages.limit(0)).count() == 0


def test_url_rules(spark):
    rules = [url_rules.host_rule("block", "net", "/"), url_rules.host_rule("allow", "example.net", "/en"),
             url_rules.Rule("ads", "block", "/ads?[0-9]*/", ""), url_rules.host_rule("allow", "net", "/")]
    urls = {"http://a.net/": "net/", "http://A.NET": None, "https://x.example.net/english?q": "example.net/en", "http://myexample.net/en/": "net/",
            "http://o.org/ads12/x": "ads", "net/": None, None: None, "": None, "http://network.com/": None, "http://[[.net/\\Q\\E": "net/"}
    rows = [(k, u) for k, u in enumerate(urls)] + [(100 + k, "http://hot.net/x") for k in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("verdict", F.lit(1))
    got = {r["page_id"]: r for r in url_rules.filter_urls(pages, rules).collect()}
    assert len(got) == len(rows)
    for k, (_, rule) in enumerate(urls.items()):
        assert got[k]["rule"] == rule, (k, got[k])
    assert got[0]["verdict"] == "block" and got[1]["verdict"] == "allow" and got[1]["host"] == "a.net" and got[6]["host"] == ""
    assert got[120]["rule"] == "net/"
    assert url_rules.filter_urls(pages, []).where("verdict = 'allow' AND rule IS NULL").count() == len(rows)
    assert url_rules.filter_urls(pages.limit(0), rules).count() == 0
    index = {r["name"]: r["token"] for r in url_rules.rule_index(
        spark.createDataFrame([("a.net", "/"), ("b.net", "/"), ("c.example.net", "/en")], "host string, path string"),
        url_rules.literal_table(spark, [(r.name, r.verdict, r.pattern, r.literal) for r in rules[:3]], url_rules.RULE_COLUMNS)).collect()}
    assert index == {"net/": "net", "example.net/en": "example", "ads": ""}


def test_warc(spark, tmp_path):
    big = "x" * 200
    rows = [(1, "http://a/\r\nb", big), (2, None, big), (None, "u", big), (3, "u", "tiny"), (4, "u", "tiny"), (5, "u", None), (6, "u", ""), (1, "again", big),
            (7, "u", "é" * 60_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    packages = warc_zip.write_archives(pages, str(tmp_path / "out"))
    got = warc_zip.read_archives(packages).collect()
    assert len(got) == len(rows)
    kinds = sorted((r["key"] or 0, r["record_type"], r["refers_to"]) for r in got)
    assert kinds == sorted([(1, "response", None), (1, "response", None), (2, "revisit", 1), (0, "revisit", 1), (3, "response", None), (4, "response", None),
                            (5, "response", None), (6, "response", None), (7, "response", None)], key=str) or set(kinds) == {
        (0, "revisit", 1), (1, "response", None), (2, "revisit", 1), *((k, "response", None) for k in range(3, 8))}
    payload = {r["key"]: r["payload"] for r in got}
    assert bytes(payload[7]).decode() == "é" * 60_000 and payload[2] is None and bytes(payload[5]) == b""
    assert {r["payload_bytes"] for r in got if r["key"] == 2} == {200}
    empty = warc_zip.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert empty.count() == 0 and warc_zip.read_archives(empty).count() == 0


def test_zip64_directory(tmp_path, monkeypatch):
    import zipfile

    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k in range(66_000):  # more members than the plain end record can count
            z.writestr(f"m{k}", b"")
        z.writestr("archive/last", b"found")
        z.writestr("packed", b"a" * 100, zipfile.ZIP_DEFLATED)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)  # sizes and offsets go to the ZIP64 fields
    small = tmp_path / "small.zip"
    with zipfile.ZipFile(small, "w") as z:
        z.writestr("a", b"0123456789abcdef")
        with z.open("b", "w", force_zip64=True) as f:
            f.write(b"second member of some length")
    for p, name, want in ((path, "archive/last", b"found"), (small, "a", b"0123456789abcdef"), (small, "b", b"second member of some length")):
        with open(p, "rb") as f:
            members = warc_zip.zip_members(f, p.stat().st_size)
            offset, n = members[name]
            f.seek(offset)
            assert f.read(n) == want
            assert "packed" not in members
    with pytest.raises(ValueError, match="directory"), open(__file__, "rb") as f:
        warc_zip.zip_members(f, 100)


def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, None, None),
             (2, None, "user", "alone"), (None, 0, "user", "lost"), (4, 0, "user", "same"), (5, 7, "user", "same"), (6, 0, "user", "x" * 300_000), (7, 0, "assistant", "")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit(1))
    conv = F.col("conv_id")
    got = {r["pair"]: r for r in preferences.format_preferences(frame, F.shiftright(conv, 1), conv % 2 == 0).collect()}
    first = got[0]
    assert first["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and first["prefix_turns"] == 1
    assert first["chosen"] == "<|im_start|>assistant\nyes<|im_end|>\n" and first["rejected"].endswith("<|im_start|>\n<|im_end|>\n")
    assert [first["chosen"][s["start"]:s["end"]] for s in first["chosen_spans"]] == ["yes<|im_end|>\n"]
    assert [first["rejected"][s["start"]:s["end"]] for s in first["rejected_spans"]] == ["no<|im_end|>\n"]
    assert (got[1]["prompt"], got[1]["rejected"], got[1]["prefix_turns"]) == ("", "", 0) and "alone" in got[1]["chosen"]
    assert (got[2]["chosen"], got[2]["rejected"], got[2]["prefix_turns"]) == ("", "", 1)
    assert sorted(got) == [0, 1, 2, 3]
    assert preferences.format_preferences(frame.limit(0), F.shiftright(conv, 1), conv % 2 == 0).count() == 0


def test_leaks(spark, docs, none):
    import random

    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "l")]
    sentence = lambda n: [rng.choice(words) for _ in range(n)]
    item = sentence(40)
    changed = list(item)
    for k in (3, 11, 19, 26):
        changed[k] = rng.choice(words)
    texts = [sentence(200) + item + sentence(100), sentence(50) + changed + sentence(30), sentence(300), item, sentence(5)]
    rest = [(100 + k, " ".join(sentence(400))) for k in range(60)]
    frame = spark.createDataFrame([*((k, " ".join(t)) for k, t in enumerate(texts)), *rest], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, ""), (9, None), (None, "x y z")], "item_id long, text string")
    got = latent_leaks.find_leaks(frame, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(0, 7), (1, 7), (3, 7)]
    assert {r["doc_id"]: r["lcs_share"] for r in got} == {0: 1.0, 1: 0.9, 3: 1.0}
    assert sorted(r["doc_id"] for r in latent_leaks.without_leaks(frame, items).collect() if r["doc_id"] < 100) == [2, 4]
    assert latent_leaks.find_leaks(docs, items).count() == 0
    assert latent_leaks.without_leaks(docs, items).count() == len(ROWS)
    assert latent_leaks.without_leaks(none, items).count() == 0
    assert latent_leaks.find_leaks(frame, items.limit(0)).count() == 0


def test_common_subsequence():
    from hypothesis import given
    from hypothesis import strategies as st

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for k, y in enumerate(b, 1):
                before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
        return row[-1]

    numbers = st.lists(st.integers(0, 4), max_size=30)

    @given(numbers, numbers)
    def same(a, b):
        assert latent_leaks.common_subsequence(a, b) == plain(a, b)

    same()


def test_stages_on_edge_cases(spark, docs, none, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "an item that is nowhere in these few texts at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns, name
        assert out.count() > 0, name
        empty = stage(spark, none, str(tmp_path))
        assert empty.count() == 0, name
        assert name == "packing" or empty.columns == none.columns


def test_toxicity_cut_does_not_depend_on_the_sample(spark):
    """A weak feature, in 20 % of 400 toxic and 2.5 % of 9600 other documents, tells no toxic document (25 %),
    nor where the sample takes as many toxic as other documents."""
    rows = [(k, f"w{k % 7} " + ("mild" if (k % 5 == 0 if k < 400 else k % 40 == 0) else "") + (" vile" if k < 400 and k % 5 > 2 else ""), int(k < 400)) for k in range(10_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for sample in (20_000, 400):
        model = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"), sample=sample)
        weak, strong = model.exceed(np.array([model.score("w1 mild"), model.score("w1 vile vile")]))[:, 0]
        assert 0.1 < weak < 0.5 < strong, (sample, weak, strong)


def test_leaks_of_a_key_with_many_texts_and_of_null_keys(spark, monkeypatch):
    """Texts of one key go over several blocks."""
    import random

    rng = random.Random(5)
    sentence = lambda n: [f"{rng.choice('bdfgklm')}{rng.choice('aeiou')}{rng.choice('nrstl')}{rng.randrange(30)}" for _ in range(n)]
    own = [sentence(40) for _ in range(6)]
    rows = [(k, " ".join(sentence(80) + t + sentence(60))) for k, t in enumerate(own)] + [(100 + k, " ".join(sentence(200))) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(None if k == 5 else 7, " ".join(t)) for k, t in enumerate(own)], "item_id long, text string")
    monkeypatch.setattr(latent_leaks, "ITEM_BLOCK", 2)
    assert sorted(r["doc_id"] for r in latent_leaks.find_leaks(frame, items).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r["doc_id"] for r in latent_leaks.without_leaks(frame, items).collect()) == [100 + k for k in range(40)]


def test_article_in_a_marked_wrapper():
    """An open head, a form around the page and names with a marked part do not take the article along."""
    article = "<article><p>The whole text of the page</p><div class='share'>no</div></article>"
    wrapped = [f"<html><head><title>t</title><meta charset=utf-8><body>{article}", f"<head><link rel=x>{article}", f"<form action=x><input>Search {article} no</form>",
               f"<div class='page has-sidebar'>{article}</div>", f"<div id='no-header'>{article}</div>", f"<div class='overlay'>no<div class='content'>{article}</div>no</div>"]
    for page in wrapped:
        assert host_text.main_text(host_text.page_blocks(page), None) == "The whole text of the page", page
    assert host_text.main_text(host_text.page_blocks("<head><title>t</title>Plain text<p>and more"), None) == "Plain text and more"
    for page in ("<nav><article>no</article></nav>", "<form>no</form>", "<article><div class='related'><article>no</article></div></article>", "<form hidden><main>no</main></form>"):
        assert host_text.main_text(host_text.page_blocks(page), None) == "", page


def test_boilerplate_of_a_host_with_two_pages_goes(spark):
    shared = "Read our weekly letter with many words for every single reader of this site today"
    rows = [(k, "http://a.net/x", f"<body><div>{shared}</div><section>Own text of page number {k} with some words</section></body>") for k in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).checkpoint()
    assert sorted(r["text"] for r in host_text.extract(pages).collect()) == [f"Own text of page number {k} with some words" for k in range(2)]


def test_unfinished_tags_and_open_quotes_take_linear_time():
    import time

    n = 1_000_000
    for page in ("<p>x</p><a href=" + "b" * n, '<p>x</p><a href="' + "b" * n, "<p>" + '<a x="1 ' * (n // 8), "<p a='" + " b=' c=\"" * (n // 8), "a <b " + "c " * (n // 2), "<a" + " " * n,
                 "<a " + "x=1 " * (n // 4) + '"', "<!--" * (n // 4), "<script " * (n // 8), "<p " + "= " * (n // 2), "<" * n, "<a " + "k='v' " * (n // 6)):
        began = time.process_time()
        host_text.page_blocks(page)
        assert time.process_time() - began < 1, page[:20]


def test_words_in_attribute_values_and_inline_names_are_no_markup():
    text = lambda page: host_text.main_text(host_text.page_blocks(page), None)
    assert text('<p title="the hidden gem">Text</p>') == "Text"
    assert text('<div class="flex hidden md:block">Text</div>') == "Text"
    assert text('<p title="class=ad">Text</p>') == "Text"
    assert text('<article><p>a <span class="token comment">b</span> <a class="promo">great</a> c</p></article>') == "a b great c"
    assert text('<article><p>x</p><div class="comment-list">no</div><div class="cookie-banner">no</div></article><div class="related-posts">no</div>') == "x"
    assert text('<p hidden>no</p><p aria-hidden="true">no</p><p style="display: none">no</p>yes') == "yes"
    assert text('<div class="ad-free">yes</div><div class="has-sidebar"><main>m</main></div>') == "yes m"


def test_columns_named_like_our_own_stay(spark, labels):
    """Inputs with the names the operators give to places, hosts and pages."""
    docs = spark.createDataFrame(ROWS, DOCS).withColumns({c: F.lit(-5) for c in ("_row", "place", "kept", "_key", "__row", "bits", "bucket")}).repartition(3).checkpoint()
    for out in (quality_rules.keep(docs, labels), simhash.one_of_each(docs, 3, 2)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r["_row"] == r["place"] == r["__row"] == -5 for r in rows)
    names = {c: F.lit(-5) for c in ("_row", "_host", "_html", "_at", "row", "key", "at", "of")}
    pages = spark.createDataFrame([(1, "http://a.net/x", "<p>one two</p>"), (2, "http://a.net/y", "<article>three</article>")], "page_id long, url string, html string").withColumns(names).checkpoint()
    got = {r["page_id"]: r for r in host_text.extract(pages).collect()}
    assert [got[k]["text"] for k in (1, 2)] == ["one two", "three"] and all(got[k][c] == -5 for k in (1, 2) for c in names)


def test_places_by_bitmaps_and_by_a_join(spark, monkeypatch):
    from peerpanel.llm import common

    frame = spark.range(0, 70_000, 1, 2).select("id", F.lit("x").alias("text")).checkpoint()
    placed = frame.withColumn("p`l", F.monotonically_increasing_id())
    places = placed.where("id % 3 = 1 OR id IN (0, 32767, 32768, 69999)").select(F.col("`p``l`").alias("place"))
    want = sorted(x for x in range(70_000) if x % 3 == 1 or x in (0, 32767, 32768, 69999))
    assert sorted(r["id"] for r in common.at_places(placed, "p`l", places).collect()) == want
    monkeypatch.setattr(common, "MAX_BITMAPS", 0)
    assert sorted(r["id"] for r in common.at_places(placed, "p`l", places).collect()) == want


def test_many_small_records_of_a_range(spark, monkeypatch, tmp_path):
    """Ranges smaller than a record, and one range for all; records are cut by the index."""
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), "id").alias("url"), F.concat(F.lit("t"), F.col("id") % 7).alias("html")).repartition(2).checkpoint()
    written = warc_zip.write_archives(pages, f"file:{tmp_path}/a")
    for size in (1, 5000, 1 << 30):
        monkeypatch.setattr(warc_zip, "RANGE_BYTES", size)
        got = warc_zip.read_archives(written).collect()
        assert sorted((r["key"], bytes(r["payload"])) for r in got) == [(k, b"t%d" % (k % 7)) for k in range(3000)]


def test_toxicity_of_a_hot_key(spark):
    """A key with very many rows is one document of the sample."""
    rows = [(7, f"vile text {k % 3}", 1) for k in range(3000)] + [(100 + k, "kind words here", 0) for k in range(60)] + [(200 + k, "vile vile", 1) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic").distinct())
    assert model.exceed(np.array([model.score("vile")]))[0, 0] > 0.5 > model.exceed(np.array([model.score("kind words")]))[0, 0]


def test_leaks_have_the_shares_of_a_plain_search(spark):
    """Every window of every text against every item by plain dynamic programming; text keys."""
    import random

    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "nrstlm"]
    items = {f"item {j}": [rng.choice(vocabulary) for _ in range(rng.choice([9, 30, 44, 70]))] for j in range(12)}
    docs, planted = [], set()
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 150, 400]))]
        if k % 2:
            j = f"item {k % 12}"
            own = [rng.choice(vocabulary) if rng.random() < (k % 5) * 0.06 else w for w in items[j]]
            at = rng.randrange(len(words))
            words[at:at] = own
        docs.append((k, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in latent_leaks.find_leaks(frame, spark.createDataFrame([(j, " ".join(t)) for j, t in items.items()], "item_id string, text string")).collect()}

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for k, y in enumerate(b, 1):
                before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
        return row[-1]

    for k, text in docs:
        words = text.split()
        for j, item in items.items():
            span, half = max(4, 1 << round(np.log2(len(item)))), max(1, len(item) // 2)
            best = (0, 0)
            for start in range(0, max(1, len(words) - span + span // 4), span // 4):
                part = words[max(0, start - half):start + span + half]
                if len(set(part) & set(item)) > 0.3 * len(item):
                    best = max(best, (longest(item, part) / len(item), longest(item[-8:], part) / len(item[-8:])))
            accepted = best[0] >= 0.9 or (best[0] >= 0.65 and best[1] >= 0.75)
            if (k, j) in found:
                r = found[k, j]
                assert r["lcs_share"] <= best[0] + 1e-9 and (r["lcs_share"] >= 0.9 or (r["lcs_share"] >= 0.65 and r["answer_share"] >= 0.75))
                assert accepted or r["lcs_share"] >= 0.65
            else:
                assert not accepted or best[0] < 0.75, (k, j, best)  # only weak paraphrases may be lost to the cosine
            if accepted and best[0] >= 0.75:
                planted.add((k, j))
    assert len(planted) > 15


def test_leaks_in_groups_of_a_few_short_texts():
    """Texts shorter than the longest item's blocks, searched by themselves, with and without empty ones."""
    rng = np.random.default_rng(5)
    items = [(0, rng.integers(0, 2**32, 9, np.uint32)), (1, rng.integers(0, 2**32, 70, np.uint32))]
    search = latent_leaks.Search(latent_leaks.LatentModel(rng.standard_normal((256, 96))), items)
    none, other = np.zeros(0, np.uint32), rng.integers(0, 2**32, 6, np.uint32)
    for texts in ([none], [other], [other[:1]], [none, none], [none, other], [items[0][1]], [none, items[0][1]],
                  [items[1][1]], [other, items[0][1], none], [np.concatenate([other, items[0][1]])]):
        got = [[leak[0] for leak in leaks] for leaks in search.leaks(texts)]
        assert got == [[key for key, ids in items if len(text) >= len(ids) and (text[-len(ids):] == ids).all()] for text in texts]


def test_words_of_a_column_are_those_of_its_texts(monkeypatch):
    """Cut and told apart by Arrow, hashed as Python's own words, whatever white space and capitals; each different word of a column once."""
    import sys

    import pyarrow as pa
    import xxhash

    def plain(text):
        words = (text or "").lower().split()
        return [xxhash.xxh32_intdigest((w.strip(latent_leaks.PUNCTUATION) or w).encode()) for w in words]

    odd = [f"A{chr(i)}bΣ{chr(i)}" for i in range(1, sys.maxunicode + 1) if chr(i).isspace() or i % 97 == 0 and not 0xD800 <= i < 0xE000]
    texts = [None, "", "  ", " a ", "x ", "ΑΣ 'ΑΣ. A'Σ İx İ", "Same same, (SAME) ... « » «", *odd]
    column = pa.array([*texts, *texts], pa.string())
    assert [x.tolist() for x in latent_leaks.WordHash().column(column)] == [plain(t) for t in [*texts, *texts]]
    assert [x.tolist() for x in latent_leaks.WordHash().column(column.slice(3, 5))] == [plain(t) for t in texts[3:8]]
    assert latent_leaks.WordHash().column(column.slice(0, 0)) == []
    assert latent_leaks.WordHash()("One two, ONE").tolist() == plain("One two, ONE")
    calls, digest = [], xxhash.xxh32_intdigest
    monkeypatch.setattr(latent_leaks.xxhash, "xxh32_intdigest", lambda w: (calls.append(w), digest(w))[1])
    latent_leaks.WordHash().column(pa.array(["one two three one"] * 1000))
    assert sorted(calls) == ["one", "three", "two"]


def test_words_are_hashed_in_pieces_of_bounded_size(monkeypatch):
    import pyarrow as pa

    texts = ["abc", None, "", "x" * 50, "de", "fgh", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(range(7))], ["text", "k"])
    monkeypatch.setattr(latent_leaks, "PIECE", 5)
    assert [p.column("k").to_pylist() for p in latent_leaks.pieces(batch, "text")] == [[0, 1, 2], [3], [4, 5, 6]]
    assert [p.column("k").to_pylist() for p in latent_leaks.pieces(batch.slice(2), "text")] == [[2], [3], [4, 5, 6]]
    assert list(latent_leaks.pieces(batch.slice(0, 0), "text")) == []
