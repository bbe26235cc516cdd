"""Aligned tokens and pair counts against brute force with the public libraries."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from logtrail.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    linked, out = Counter(), []
    for doc_id, text in rows:
        a = first.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_bytes = [bytes(chars[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:-1], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]
        if not text or b"".join(a_bytes) != f" {text}".encode() or b"".join(b_bytes) != f" {text}".encode():
            out.append((doc_id, 0, 0, 0, [], ""))
            continue
        a_at = np.cumsum([0, *map(len, a_bytes)]).tolist()
        b_at = np.cumsum([0, *map(len, b_bytes)]).tolist()
        links, groups, i, j, opened = [], [], 0, 0, (0, 0)
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            low = min(a_at[i + 1], b_at[j + 1])
            i, j = i + (a_at[i + 1] == low), j + (b_at[j + 1] == low)
            if a_at[i] == b_at[j]:
                groups.append(",".join(map(str, a[opened[0] : i])) + "|" + ",".join(map(str, b[opened[1] : j])))
                opened = (i, j)
        linked.update(links)
        out.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    highest = {}
    for (_, y), n in linked.items():
        highest[y] = max(n, highest.get(y, 0))
    key = [(i, na, nb, g, len(k), sum(linked[p] == highest[p[1]] for p in k), sum(linked[p] for p in k), h) for i, na, nb, g, k, h in out]
    return sorted(key, key=str)


def aligned(docs):
    return sorted((tuple(r) for r in alignment.align(docs, A, B).select("doc_id", *NAMES).collect()), key=str)


def test_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute(rows)
    assert sum(r[1] > 0 for r in expected) > 150
    assert aligned(docs) == expected


@pytest.mark.parametrize(("records", "fan"), [(1 << 21, 64), (300, 2)])
def test_awkward_rows_in_one_run_and_in_many(spark, awkward, nothing, monkeypatch, records, fan):
    monkeypatch.setattr(alignment, "RUN_RECORDS", records)
    monkeypatch.setattr(alignment, "FAN_IN", fan)
    extra = [(20, "<|endoftext|> and <s> are text"), (21, "a ▁ that is no blank"), (22, " x"), (23, "tab\tand \x00 zero"), (24, "\U0001f600 fi ① ﬁ")]
    docs = awkward.select("doc_id", "text", "score", "label").unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert aligned(docs.repartition(5)) == brute(rows)
    assert aligned(nothing) == []


def test_merge_adds_up_runs():
    rng = np.random.default_rng(5)
    runs, expected = [], Counter()
    for _ in range(9):
        pairs = np.unique((rng.integers(0, 7, 60) << 17) + rng.integers(0, 20, 60))[: rng.integers(0, 60)]
        counts = rng.integers(1, 9, len(pairs))
        runs.append((pairs, counts))
        expected.update(dict(zip(pairs.tolist(), counts.tolist(), strict=True)))
    got = list(alignment.merge(runs))
    sides = [set((p >> 17).tolist()) for p, _ in got]
    assert all(len(s) == 1 for s in sides) and len(set().union(*sides)) == len(sides)
    assert {p: c for ps, cs in got for p, c in zip(ps.tolist(), cs.tolist(), strict=True)} == expected
    assert [p for ps, _ in got for p in ps.tolist()] == sorted(expected)
