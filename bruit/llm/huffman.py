"""Token ids as binary files: canonical length-limited Huffman codes in independent blocks (operator 5).

A first job encodes the texts and counts each id over all documents.  From the
counts (bounded by the vocabulary) the driver derives code lengths of at most
``max_bits`` by package-merge; canonical order of (length, id) then fixes the
codes, so a file needs the lengths alone.  A second job packs each block of
whole documents into a bit string with the bit offset of every ``every``-th
symbol.  Reading, all those segments of a block are decoded side by side with
one table look-up per symbol.

Files: ``blocks`` (Parquet, ascending document ids) holds for each block its
document ids and token counts, the bit string and the offsets, and its start
within the range of ids that one task packed; ``parts`` holds the start of each
range, ``lengths`` the code length of each id.

Defined results: null or empty text has the end id alone; null ``doc_id`` comes
first; repeated ids stay together in text order; an empty table gives
empty files; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bruit.llm.common import map_pandas, new_path, pick, remove, table
from bruit.llm.words_cache import ChunkCache


@dataclass(frozen=True)
class TokenFileParams:
    """``vocabulary``: name of a public tokenizer's file; ``block_ids``: ids of a block, unless one document has more;
    ``range_bytes``: size of what one task packs, its ids at 32 bits."""

    vocabulary: str = "word_bpe_49k.json"
    end_id: int = 1
    max_bits: int = 16
    every: int = 256
    block_ids: int = 1 << 17
    range_bytes: int = 16 << 20


# --- codes -----------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal prefix-code lengths of at most ``limit`` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("too many ids for this length limit")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = [int(c) for c in counts[used]]
    # Per level the weights in order; a package is known by its rank, so levels need no lists of leaves.
    levels: list[np.ndarray] = []
    packages: list[int] = []
    for _ in range(limit):
        merged = list(heapq.merge(((w, 0) for w in leaves), ((w, 1) for w in packages)))
        levels.append(np.array([k for _, k in merged], np.uint8))
        weights = [w for w, _ in merged]
        packages = [a + b for a, b in zip(weights[0::2], weights[1::2], strict=False)]
    take, out = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for kinds in reversed(levels):
        n_packages = int(kinds[:take].sum())
        out[: take - n_packages] += 1
        take = 2 * n_packages
    lengths[used] = out
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    for i in sorted(np.flatnonzero(lengths), key=lambda i: (lengths[i], i)):
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, every: int) -> tuple[bytes, bytes]:
    """The ids' bits and, as unsigned 32-bit little-endian numbers, the bit offset of each ``every``-th id."""
    n = lengths[ids].astype(np.int64)
    starts = np.cumsum(n) - n
    total = int(starts[-1] + n[-1]) if len(ids) else 0
    # A code of at most 32 bits touches two 32-bit words; bits never overlap, so sums (exact in doubles) join them.
    word = starts >> 5
    wide = codes[ids].astype(np.uint64) << (64 - n - (starts & 31)).astype(np.uint64)
    size = (total >> 5) + 2
    words = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), size)
    words += np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], starts[::every].astype("<u4").tobytes()


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of the next ``bits`` bits: the id and its code's length."""
    bits = int(lengths.max()) if lengths.size and lengths.max() else 1
    order = sorted(np.flatnonzero(lengths), key=lambda i: (lengths[i], i))
    spans = np.array([1 << (bits - int(lengths[i])) for i in order], np.int64)
    symbols = np.zeros(1 << bits, np.uint32)
    n_bits = np.ones(1 << bits, np.uint8)
    full = int(spans.sum())
    symbols[:full] = np.repeat(np.array(order, np.uint32), spans)
    n_bits[:full] = np.repeat(lengths[order], spans)
    return symbols, n_bits, bits


def unpack(bits: bytes, offsets: bytes, n: int, every: int, tables: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ``n`` ids of a block: every segment advances one id at each step."""
    symbols, n_bits, width = tables
    data = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    words = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]  # the 32 bits from each byte on
    at = np.frombuffer(offsets, "<u4").astype(np.int64)
    out = np.zeros((len(at), every), np.uint32)
    last = n - (len(at) - 1) * every if len(at) else 0
    live = at
    for k in range(min(every, n)):
        if k == last:  # the final segment is shorter
            live = live[:-1]
        window = (words[live >> 3] >> (32 - width - (live & 7)).astype(np.uint32)) & ((1 << width) - 1)
        out[: len(live), k] = symbols[window]
        live = live + n_bits[window]
    return out.reshape(-1)[:n]


# --- text to ids -----------------------------------------------------------

_caches: dict[str, ChunkCache | WholeTexts] = {}


class WholeTexts:
    """In the place of a memo of chunks, for a tokenizer that may join what stands on both sides of a blank."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]]):
        self.encode_many = encode_many

    def encode_texts(self, texts: list[list[str]]) -> list[bytes]:
        return self.encode_many(["".join(t) for t in texts])

    def chunks(self, text: str) -> list[str]:
        return [text]


#: What a tokenizer's file says if it cuts at white space, drops it, and writes words letter by letter.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = [
    {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]

#: Characters below this are the same letters and numbers in every version of Unicode's tables.
SETTLED = 0x250
#: One run of these is one word to the pattern above.
MARKS = ".,;:!?()\"-"


def cuts_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer's file works as said above, so that a text's ids are those of its chunks between blanks."""
    own = (spec["normalizer"] or {}).get("normalizers"), (spec["pre_tokenizer"] or {}).get("pretokenizers")
    return own == (NORMALIZER, PRE_TOKENIZER) and not spec["post_processor"]


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def _cache(vocabulary: str) -> ChunkCache | WholeTexts:
    """The worker's memo for a vocabulary file.

    Where the file cuts texts at white space, a text's ids are those of its chunks.  A chunk of settled characters
    is cut by the file's pattern and its words, remembered as well, go to the file's model; any other chunk goes
    through the whole tokenizer.  With another kind of file all texts do.
    """
    if vocabulary in _caches:
        return _caches[vocabulary]
    import os
    import unicodedata

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    spec = json.loads(tok.to_str())
    kind = "H" if tok.get_vocab_size() <= 1 << 16 else "I"
    as_bytes = lambda ids: array(kind, ids).tobytes()
    library = lambda texts: [as_bytes(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    if not cuts_at_blanks(spec):
        own = WholeTexts(library)
        own.kind = "<u2" if kind == "H" else "<u4"
        return _caches.setdefault(vocabulary, own)
    split = regex.compile(PATTERN).findall
    special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)").search
    tokenize, letters = tok.model.tokenize, _byte_letters()
    parts: dict[str, bytes] = {}

    def part(x: str) -> bytes:
        shown = x if x.isascii() and x.isalpha() else "".join([letters[b] for b in x.encode()])
        out = as_bytes([t.id for t in tokenize(shown)])
        if len(x) <= 64:
            parts[x] = out
        return out

    def many(chunks: list[str]) -> list[bytes]:
        if len(parts) > 500_000:
            parts.clear()
        out: list = [None] * len(chunks)
        rest, known = [], parts.get
        for i, c in enumerate(chunks):
            if c.isascii():
                x = c.lower()
            elif ord(max(c)) < SETTLED:
                x = unicodedata.normalize("NFC", c).lower()
            else:
                rest.append(i)
                continue
            if x.isalpha():
                out[i] = known(x) or part(x)
                continue
            word = x.rstrip(MARKS)
            if word.isalpha():
                tail = x[len(word) :]
                out[i] = (known(word) or part(word)) + (known(tail) or part(tail))
            elif x.isprintable() and not special(c):
                out[i] = b"".join([known(y) or part(y) for y in split(x)])
            else:  # white space of other kinds, and what the tokenizer takes out first
                rest.append(i)
        if rest:
            for i, ids in zip(rest, library([chunks[i] for i in rest]), strict=True):
                out[i] = ids
        return out

    _caches[vocabulary] = own = ChunkCache(many)
    own.kind, own.chunks = "<u2" if kind == "H" else "<u4", _chunks
    return own


def encode_texts(texts: Iterable[str | None], vocabulary: str) -> tuple[list[bytes], str]:
    """Ids of each text as little-endian numbers, without the end id, and their kind: 16 bits if the vocabulary fits, else 32."""
    cache = _cache(vocabulary)
    return cache.encode_texts([cache.chunks(t) if t else [] for t in texts]), cache.kind


def _chunks(text: str) -> list[str]:
    # Python's split also cuts at these four, which aren't white space to the tokenizer.
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [c for c in text.replace("\n", " ").split(" ") if c]
    return text.split()


STAGED = "doc_id long, n long, ids binary, kind string, used binary, counts binary"


def encoded(docs: DataFrame, p: TokenFileParams) -> DataFrame:
    """(doc_id, n, ids, kind) with the end id; a row now and then also has the counts of ids since the last such row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.iloc[k : k + 500]
                ids, kind = encode_texts(part["text"], p.vocabulary)
                width, end = int(kind[-1]), np.array([p.end_id], kind).tobytes()
                ids = [x + end for x in ids]
                total = np.bincount(np.frombuffer(b"".join(ids), kind))
                used = np.flatnonzero(total)
                rest = [None] * (len(ids) - 1)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"], "n": [len(x) // width for x in ids], "ids": ids, "kind": kind,
                    "used": [used.astype("<u4").tobytes(), *rest], "counts": [total[used].astype("<u8").tobytes(), *rest],
                })

    return map_pandas(docs, run, STAGED)


def global_counts(staged: DataFrame) -> np.ndarray:
    """Occurrences of each id over all documents; one row per id and partition is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for used, n in zip(b["used"], b["counts"], strict=True):
                used, n = np.frombuffer(used, "<u4"), np.frombuffer(n, "<u8").astype(np.int64)
                if used[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(int(used[-1]) + 1 - len(total), np.int64)])
                total[used] += n
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    rows = staged.where("used is not null").select("used", "counts")
    got = map_pandas(rows, run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(got["id"].max()) + 1 if len(got) else 1, np.int64)
    counts[got["id"].to_numpy()] = got["n"].to_numpy()
    return counts


# --- files -----------------------------------------------------------------

PARTS = "part int, first long"
BLOCK = "part int, block int, start long, n long, doc_ids array<long>, n_tokens array<long>, bits binary, offsets binary"


def write_files(docs: DataFrame, path: str, p: TokenFileParams = TokenFileParams()) -> None:
    """Encodes ``docs`` (doc_id, text) and writes ``blocks`` and ``lengths`` under ``path``."""
    spark = docs.sparkSession
    stage = new_path(spark, "staged")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    encoded(docs, p).write.parquet(stage)
    staged = spark.read.schema(STAGED).parquet(stage)
    counts = global_counts(staged)
    lengths = code_lengths(counts, p.max_bits)
    codes = canonical_codes(lengths)
    total = staged.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-total * 4 // p.range_bytes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, part, block, start = [], 0, None, 0, 0

        def flush() -> pd.DataFrame:
            ids = np.concatenate([x for _, x in held])
            bits, offsets = pack(ids, codes, lengths, p.every)
            row = (part, block, start, len(ids), [d for d, _ in held], [len(x) for _, x in held], bits, offsets)
            return pd.DataFrame([row], columns=["part", "block", "start", "n", "doc_ids", "n_tokens", "bits", "offsets"])

        for b in batches:
            doc_ids = [None if pd.isna(d) else int(d) for d in b["doc_id"]]
            for key, doc_id, x, kind in zip(b["part"], doc_ids, b["ids"], b["kind"], strict=True):
                ids = np.frombuffer(x, kind)
                if held and (key != part or size + len(ids) > p.block_ids):
                    yield flush()
                    held, block, start, size = [], block + 1, start + size, 0
                if key != part:
                    part, block, start = int(key), 0, 0
                held.append((doc_id, ids))
                size += len(ids)
        if held:
            yield flush()

    # Ranges of (id, ids' hash, row) keep the files in order; the row splits a large group of equal rows.
    order = ["doc_id", "h", "row"]
    ordered = staged.withColumns({"h": F.xxhash64("ids"), "row": F.monotonically_increasing_id()})
    ordered = ordered.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    map_pandas(ordered.select("part", "doc_id", "ids", "kind"), run, BLOCK).write.parquet(f"{path}/blocks")
    # One row for each range, of a fixed size.
    sums = spark.read.schema(BLOCK).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n")).collect()
    starts, at = [], 0
    for r in sorted(sums):
        starts.append((r["part"], at))
        at += r["n"]
    spark.createDataFrame(starts, PARTS).coalesce(1).write.parquet(f"{path}/parts")
    used = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(used, "id int, bits int").coalesce(1).write.parquet(f"{path}/lengths")
    remove(spark, stage)


def read_files(spark: SparkSession, path: str, p: TokenFileParams = TokenFileParams()) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files; ids are unsigned 32-bit little-endian numbers."""
    rows = spark.read.schema("id int, bits int").parquet(f"{path}/lengths").collect()
    lengths = np.zeros(max([0, *(r["id"] for r in rows)]) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = decode_table(lengths)
        for b in batches:
            for r in b.itertuples():
                ids = unpack(r.bits, r.offsets, r.n, p.every, tables).astype("<u4")
                ends = np.cumsum(np.asarray(r.n_tokens))
                cut = [x.tobytes() for x in np.split(ids, ends[:-1])]
                doc_ids = pd.array([None if pd.isna(d) else int(d) for d in r.doc_ids], dtype="Int64")
                start = r.start + ends - np.asarray(r.n_tokens)
                yield pd.DataFrame({"doc_id": doc_ids, "start": start, "n_tokens": r.n_tokens, "ids": cut})

    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    parts = F.broadcast(spark.read.schema(PARTS).parquet(f"{path}/parts"))  # one row for each range
    blocks = blocks.join(parts, "part").withColumn("start", F.col("start") + F.col("first")).drop("first")
    return map_pandas(blocks, run, "doc_id long, start long, n_tokens long, ids binary")


def op5_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_files(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), path)
    return read_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
