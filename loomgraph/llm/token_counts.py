"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as one symbol per byte, the last with the vocabulary's end-of-word mark. Adjacent pairs
that can merge wait in a heap by rank; the lowest is popped, its two symbols become one in a linked list,
and the pairs with its new neighbours are pushed. The count is the initial symbols minus the merges: no
identifier is looked up or emitted. The whole costs O(n log n) for a word of n bytes, however long.

Text between white space is independent of its surroundings under this vocabulary's normaliser (NFC, white
space to blanks, lower case) and splitter, so counts are kept by such piece in a bounded table per worker.

Defined results: a null text is empty and has no token; repeated rows are counted one by one.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counts kept per worker; the table starts anew when full.
MAX_KEPT = 400_000
LIMIT = 2048


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: itself where printable, else the next free code from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class MergeCounter(dict):
    """Counts of white-space-free pieces; looks like a dict so that a text is one ``sum(map(...))``."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in reversed(list(enumerate(pairs)))}
        self.end = model.get("end_of_word_suffix") or ""
        self.symbols = byte_symbols()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.specials = [t["content"] for t in spec["added_tokens"] if not t["normalized"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.words: dict[str, int] = {}

    def merge(self, word: str) -> int:
        """Tokens of one pre-token."""
        rank = self.rank
        symbols = [self.symbols[b] for b in word.encode("utf-8")]
        symbols[-1] += self.end
        n = len(symbols)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = following[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has merged meanwhile
            symbols[i], symbols[j] = a + b, ""
            merges += 1
            after = following[i] = following[j]
            if after < n:
                previous[after] = i
                if (r := rank.get((symbols[i], symbols[after]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[after]))
            before = previous[i]
            if before >= 0 and (r := rank.get((symbols[before], symbols[i]))) is not None:
                heapq.heappush(heap, (r, before, symbols[before], symbols[i]))
        return n - merges

    def __missing__(self, piece: str) -> int:
        if len(self) >= MAX_KEPT:
            self.clear()
        if len(self.words) >= MAX_KEPT:
            self.words.clear()
        total = 0
        for word in self.split.findall(lower(unicodedata.normalize("NFC", piece))):
            count = self.words.get(word)
            if count is None:
                count = self.merge(word)
                if len(word) < 64:
                    self.words[word] = count
            total += count
        if len(piece) < 64:
            self[piece] = total
        return total

    def plain(self, text: str) -> int:
        pieces = re.split(r"[^\S\x1c-\x1f]+", text) if SEPARATORS.search(text) else text.split()
        return sum(map(self.__getitem__, filter(None, pieces)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special and "<|" in text and (found := self.special.findall(text)):
            return len(found) + sum(map(self.plain, self.special.split(text)))
        return self.plain(text)


#: Python takes these for white space, Unicode does not.
SEPARATORS = re.compile("[\x1c-\x1f]")


def lower(text: str) -> str:
    """Lower case by single characters: no sigma depends on its place."""
    return text.replace("Σ", "σ").lower()


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, name: str = "word_bpe_49k.json", limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary(name))
        for b in batches:
            n = pa.array([own.count(t.as_py()) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(t).cast("long").alias("n_bytes"), t.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(counts, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
