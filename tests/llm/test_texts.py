"""The operators on single texts against brute force, the public library, or held-out rows."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from logtrail.llm import bpe_count, brown_lm, compression, decontaminate, language, license_scan, quality
from logtrail.llm.queries import QUERIES, VOCABULARIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_quality_of_held_out_rows(spark, sf_dir):
    scored = QUERIES["op2_quality_discriminant"](spark, sf_dir.replace("0.001", "0.01"))
    labels = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(4, 0), (5, 1), (6, 1), (9, 1), (9, 1), (11, 0), (12, None)], "doc_id long, quality int")
    got = quality.classify(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(nothing, labels).count() == 0
    assert {r.score for r in quality.classify(awkward, labels.filter("doc_id < 0")).collect()} == {0.5}
    assert {r.score for r in quality.classify(awkward, labels.filter("quality = 1")).collect()} == {1.0}


def brute_surface(text):
    words = WORD.findall(text)
    wide = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often, marked = Counter(wide), set()
    for k, w in enumerate(wide):
        if often[w] > 1:
            marked.update(range(k, k + 8))
    lines, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), lines, len(marked)


def test_surface_counts(spark, awkward, sf_dir, nothing):
    for df in (awkward.filter("doc_id is not null").dropDuplicates(["doc_id"]), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        for r in compression.rules(df).collect():
            expected = brute_surface(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
            assert r.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
            assert not (r.base_failed and r.kept)
    assert compression.rules(nothing).count() == 0


def test_compression_bands():
    import zstandard

    z, rng = zstandard.ZstdCompressor(level=3), random.Random(1)
    plain = " ".join(rng.choices([f"{a}{b}" for a in ("th", "an", "er", "on") for b in ("ing", "ed", "ly", "a", "is")], k=900)).encode()
    noise = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(1500)).encode()
    assert compression.verdict(plain, z)[3]
    assert not compression.verdict(b"spam and " * 500, z)[3]
    assert not compression.verdict(bytes(rng.randrange(256) for _ in range(4000)), z)[3] and len(noise) > 4000
    # a bad half is seen in the chunks of a long text
    assert not compression.verdict(plain * 1 + b"spam and " * 1500, z)[3]


def test_token_counts_equal_the_library(spark, awkward, sf_dir, nothing):
    from tokenizers import Tokenizer

    path = f"{VOCABULARIES}/word_bpe_49k.json"
    library, own, rng = Tokenizer.from_file(path), bpe_count.MergeCounter(path), random.Random(9)
    pool = ["'s", " ", "\x85", "Σ", "İ", "é", "é", "日本", "²", "😀", "<|endoftext|>", "<|", "don't", "HELLO", "1234", "_", "\n", "ﬁ"]
    for _ in range(500):
        text = "".join(rng.choice(pool) if rng.random() < 0.5 else chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x52F)])) for _ in range(12))
        assert own.text(text) == len(library.encode(text, add_special_tokens=False).ids), ascii(text)
    for df in (awkward.filter("doc_id is not null").dropDuplicates(["doc_id"]), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        for r in bpe_count.count_tokens(df, path).collect():
            assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
            assert r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048)
    assert bpe_count.count_tokens(nothing, path).count() == 0


def test_languages_of_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op7_language_bitmasks"](spark, sf_dir).filter("held_out").join(docs, "doc_id").collect()
    assert len(rows) > 30 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_languages_of_awkward_rows(spark, awkward, nothing):
    learned = spark.createDataFrame([("aa bb aab", "a"), ("cc dd ccd", "b"), (None, "a"), ("x", None)], "text string, lang string")
    filters = language.fit(learned)
    got = {r.doc_id: r for r in language.identify(awkward, filters).collect()}
    assert {got[k].lang_pred for k in (1, 2, 3, 13)} == {"und"} and all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(nothing, filters).count() == 0
    empty = language.fit(learned.filter("lang = 'zz'"))
    assert {r.lang_pred for r in language.identify(awkward, empty).collect()} == {"und"}
    many = language.fit(spark.createDataFrame([(f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 3}", f"l{k}") for k in range(130)], "text string, lang string"))
    assert language.identify(spark.createDataFrame([(1, "eeeeee")], "doc_id long, text string"), many).first().lang_pred == "l108"


def test_license_base_counts(spark, awkward, sf_dir, nothing):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))
    for df in (awkward.filter("doc_id is not null").dropDuplicates(["doc_id"]), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in license_scan.scan(df).collect():
            words, places, labels = word.findall(lower(texts[r.doc_id])), [], set()
            for phrase, label in phrases:
                found = [k for k in range(len(words)) if tuple(words[k : k + len(phrase)]) == phrase]
                places += found
                labels |= {label} if found else set()
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
            assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert license_scan.scan(nothing).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("licensed under the GNU Lesser General Public License, version 2.1", "gpl,lgpl-2.1"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("SPDX-License-Identifier: Apache-2.0 and the MPL 2.0 license", "apache-2.0,mpl-2.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy; MIT License", "mit"),
        ("the mit of the band", ""),
    ],
)
def test_license_rules(spark, text, labels):
    assert license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == labels


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("This work is CC BY-SA 4.0", "cc-by-sa-4.0"),
        ("see MPL 2.0 and the Apache 2.0 terms", "apache-2.0,mpl-2.0"),
        ("All Rights Reserved.", "proprietary"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        ("under the Expat license; or APL v2.0 (a licence)", "apache-2.0,mit"),
        ("a simple example of replaced maps", ""),
    ],
)
def test_license_rules_in_texts_without_a_common_word(spark, text, labels):
    assert license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == labels


def test_license_words_of_a_long_text_take_time_in_proportion(spark):
    texts = ["", None, " ", "..x..", "x", " Mit\x00License\x7f", "\u00e9\U0001f600 a1_b2", "MIT license, the Apache license"]
    texts.append("apache license mit license " + "ab, 12 " * 300_000)
    started = time.monotonic()
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert time.monotonic() - started < 60
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word) for r in rows}
    for k, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [i for i, pair in enumerate(zip(words, words[1:], strict=False)) if pair in (("mit", "license"), ("apache", "license"))]
        assert got[k] == (len(words), len(at), min(at, default=None), max(at, default=None))


def test_license_gate_lets_every_match_pass():
    shapes = ("licensed under the {} {}", "{} {}", "released under the terms of the {}", "x. {}, {}")
    names = ("APL", "Expat licence", "cc-by-nc-nd", "Creative Commons attribution share alike", "two-clause BSD", "CeCILL", "WTFPL", "gnu fdl", "ODC-By", "cc0", "released into the public domain")
    gate = re.compile(license_scan._gate())
    for text in (lower(shape.format(name, "1.0")) for shape in shapes for name in names):
        hits = [(e, need) for (_, _, _, e, *_), need in license_scan._with_needs() if re.search(e, text)]
        assert hits, text
        assert gate.search(text.title()) and all(re.search(need, text) for _, need in hits), text
        assert all(key in text for _, _, key, e, *_ in license_scan.rules() if re.search(e, text)), text


def test_license_suppression_equals_brute_force(spark):
    text = lower("Licensed under the Apache License, Version 2.0; GPL v3 or later license, Apache License. EPL-2.0 license " * 3)
    found = [(m.start(), m.end(), p, i, label) for i, label, key, e, p, _ in license_scan.rules() if key in text for m in re.finditer(e, text)]

    def beaten(d):
        return any(
            e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and (e[1] - e[0], -e[3]) > (d[1] - d[0], -d[3])) for e in found
        )

    expected = {d[4] for d in found if not beaten(d)} | {"apache"}
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert set(row.labels.split(",")) == expected and len(license_scan.rules()) > 200


def test_language_model(spark, awkward, sf_dir, nothing):
    rows = QUERIES["op3_brown_class_lm"](spark, sf_dir).collect()
    docs = {r.doc_id: WORD.findall(lower(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counts = Counter()
    for r in rows:
        if not r.held_out:
            counts.update([*docs[r.doc_id], None])
    total, distinct = sum(counts.values()), len(counts)
    for r in rows:
        words = [*docs[r.doc_id], None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    scored = brown_lm.score(awkward, awkward.filter("doc_id in (6, 9)"), rounds=2)
    assert scored.count() == awkward.count() and scored.filter("n_tokens = 1").count() == 3
    assert all(r.n_known == 0 for r in brown_lm.score(awkward, nothing, rounds=1).collect())
    assert brown_lm.score(nothing, awkward, rounds=1).count() == 0


def test_language_model_sums_to_one(spark):
    text = "a b c a b d a b c e " * 30 + "rare once words here"
    training = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = brown_lm.fit(training, brown_lm.word_counts(training), classes=3, rounds=3)
    share = np.bincount(model.classes, weights=10**model.emission, minlength=4)
    assert np.allclose(share, 1) and np.allclose((10**model.transition).sum(axis=1), 1)


def test_leaks(spark, awkward, nothing):
    rng = random.Random(4)
    words = [f"tok{k}" for k in range(3000)]
    items = [(k, " ".join(rng.sample(words, 20 + 5 * k)).capitalize() + ".") for k in range(8)] + [(90, None), (91, ""), (92, "too short")]
    docs, expected = [], set()
    for k in range(80):
        text = rng.choices(words, k=300)
        item = items[k % 8][1].lower().rstrip(".").split()
        if k % 4 == 0:  # whole, with other case and punctuation
            text[100:100] = [w.upper() + "," for w in item]
            expected.add((k, k % 8))
        elif k % 4 == 1:  # every ninth token substituted
            text[50:50] = [rng.choice(words) if j % 9 == 4 else w for j, w in enumerate(item)]
            expected.add((k, k % 8))
        elif k % 4 == 2:  # six tokens are no leak
            text[10:10] = item[:6]
        docs.append((k, " ".join(text)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    whole = next(r for r in found if r.doc_id == 0)
    assert (whole.coverage, whole.first_token) == (1.0, 100)
    assert decontaminate.leaks(awkward, benchmark).count() == 0
    assert decontaminate.leaks(nothing, benchmark).count() == 0
    assert decontaminate.leaks(awkward, benchmark.filter("item_id < 0")).count() == 0


def test_leaks_between_substituted_blocks(spark):
    words = [f"tok{k}" for k in range(400)]
    # lengths of equal (+) and substituted (-) blocks; the third stretch of the second is neither first nor last
    plans = [(8, -5, 25, -5, 8), (8, -6, 10, -7, 30, -6, 12, -9, 8), (8, -20, 8)]
    items, docs = [], []
    for k, plan in enumerate(plans):
        item, copy = [f"item{k}word{j}" for j in range(sum(map(abs, plan)))], []
        for n in plan:
            copy += item[len(copy) : len(copy) + n] if n > 0 else [f"other{k}word{len(copy) + j}" for j in range(-n)]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join([*words[:100], *copy, *words[100:]])))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.item_id, r.matched_tokens, r.item_tokens, r.first_token, r.last_token) for r in found.collect()}
    assert got == {0: (0, 41, 51, 100, 150), 1: (1, 68, 96, 100, 195)}
