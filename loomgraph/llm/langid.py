"""Language identification by compression.

Each language has a raw-content dictionary for zstandard: text of its own, from labelled documents. A text
in lower case, with its ASCII signs and digits as blanks, is cut into pieces, all of which are compressed
with every language's dictionary; the language with the smallest sum is chosen. Pieces are short, so that
what the compressor learns from the text itself does not drown the dictionaries. Where the runner-up comes
within ``NARROW`` of the winner, the choice is rejected.

Defined results: a null text or one without a letter is ``und`` with score 0 and is rejected; with no
labelled text, all are ``und``; ties go to the language with most labelled documents, then to the one that
sorts first, and are rejected; repeated rows get equal results.
Dictionaries hold at most ``DICTIONARY`` bytes of each language, from a sample of at most ``MAX_DOCS`` documents each,
chosen by hash, of each of which an excerpt of at most ``EXCERPT`` characters from a place that the hash names is taken.
Every language is learned; more than ``MAX_LANGUAGES`` are an error, since dictionaries go to every task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_table, small_batches

DICTIONARY = 32_768
MAX_DOCS = 100
MAX_LANGUAGES = 1_000
EXCERPT = 1_500
PIECE = 4_096
#: Matches of 3 bytes count, since words share short parts; a lazy binary-tree search finds them.
PARAMETERS = dict(min_match=3, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_dict_id=0)
#: Least saving of the winner over the runner-up, as a part of the winner's size.
NARROW = 0.001
LETTERS_ONLY = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
UNKNOWN = "und"


def learn(labelled: DataFrame, text: Column, lang: Column, key: Column) -> dict[str, bytes]:
    """Dictionaries from labelled rows; ``key`` orders the rows of a language by hash."""
    rows = labelled.where(lang.isNotNull() & text.isNotNull() & (F.length(text) > 0)).select(lang.alias("lang"), F.abs(F.xxhash64(key, text)).alias("h"), text.alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    # About twice the rows wanted of each language, then exactly those of the least hashes; tasks leave out the rest first.
    top = 1 << 63
    shares = literal_table(labelled.sparkSession, [{"of": k, "share": min(top - 1, int(top * (2 * MAX_DOCS / n)))} for k, n in counts.items()], "of string, share long")
    place = F.lit(1) + F.pmod(F.col("h"), F.greatest(F.length("text") - (EXCERPT - 1), F.lit(1)))
    drawn = rows.join(F.broadcast(shares), (F.col("lang") == F.col("of")) & (F.col("h") <= F.col("share"))).select("lang", "h", F.substr("text", place.cast("int"), F.lit(EXCERPT)).alias("text"))
    few = drawn.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("_n") <= MAX_DOCS).select("lang", "h", "text").collect()
    out: dict[str, bytes] = {}
    for name in sorted(counts, key=lambda k: (-counts[k], k)):
        own = sorted((r["h"], r["text"]) for r in few if r["lang"] == name)
        out[name] = b"\n".join(letters(t) for _, t in own)[:DICTIONARY]
    return {k: v for k, v in out.items() if v}


def letters(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(LETTERS_ONLY).split()) + b" "


class Compressed:
    """Sizes of texts under each language's dictionary; languages come in the order of preference."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.compressors = []
        parameters = zstandard.ZstdCompressionParameters.from_level(3, **PARAMETERS)
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=parameters)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=parameters))

    def sizes(self, text: str) -> list[int]:
        data = letters(text)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]

    def best(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in 0..1, and whether the margin is wide enough to accept."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(order) == 1:
            return self.names[order[0]], 1.0, True
        margin = (sizes[order[1]] - sizes[order[0]]) / max(sizes[order[0]], 1)
        return self.names[order[0]], 1 - 0.5 * math.exp(-20 * margin), margin >= NARROW


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry`` columns, doc_id, lang_pred, score, accepted for every row."""
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"c_{c}") for c in carry))
    keep = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Compressed(dictionaries)
        for b in batches:
            found = [own.best(t.as_py()) for t in b.column("text")]
            arrays = [b.column(c) for c in keep] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "lang_pred", "score", "accepted"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double, accepted boolean")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is accepted; in one pass, without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Compressed(dictionaries)
        for b in batches:
            yield b.filter(pa.array([own.best(t.as_py())[2] for t in b.column(text_col)], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
