"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a linked list, and every adjacent pair that the vocabulary can
merge lies in a heap by rank and place. The lowest is taken until none is left; the
number of tokens is the number of symbols minus the merges. Which tokens they are is
never asked. Words repeat, so a task keeps the counts of words it has seen, up to a bound.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtrail.llm.tables import id_and_text

#: Words whose counts a task keeps; beyond that it starts afresh.
KEPT_WORDS = 400_000


class MergeCounter:
    """Counts as the tokenizers library does for a BPE file with NFC, lower case, a word pattern and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"] or ""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printable]
        chars = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.inner = [vocab[chars[b]] for b in range(256)]
        self.last = [vocab[chars[b] + end] for b in range(256)]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(spec["model"]["merges"])}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.seen: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one word of the pattern."""
        data = word.encode()
        symbols = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = [(*merges[pair], k, *pair) for k in range(n - 1) if (pair := (symbols[k], symbols[k + 1])) in merges]
        heapq.heapify(heap)
        left = n
        while heap:
            _, merged, k, a, b = heapq.heappop(heap)
            j = after[k]
            # an entry is stale once either of its symbols was merged into another
            if symbols[k] != a or j >= n or symbols[j] != b:
                continue
            symbols[k], symbols[j] = merged, -1
            after[k] = following = after[j]
            left -= 1
            if following < n:
                before[following] = k
                if (pair := (merged, symbols[following])) in merges:
                    heapq.heappush(heap, (*merges[pair], k, *pair))
            if (earlier := before[k]) >= 0 and (pair := (symbols[earlier], merged)) in merges:
                heapq.heappush(heap, (*merges[pair], earlier, *pair))
        return left

    def _plain(self, text: str) -> int:
        # the final sigma depends on its neighbours in Python's lower case, but not here
        words = self.words(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        seen = self.seen
        total = 0
        for word in words:
            count = seen.get(word)
            if count is None:
                if len(seen) >= KEPT_WORDS:
                    seen.clear()
                count = seen[word] = self.word(word)
            total += count
        return total

    def text(self, text: str) -> int:
        """Tokens of a text; strings of special tokens are one each."""
        if "<|" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``.

    Null and empty texts have no tokens; repeated rows count each; an empty table gives
    no rows. ``vocabulary`` is the file's path on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = MergeCounter(vocabulary)
        for batch in batches:
            counts = [counter.text(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, type=pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = id_and_text(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
