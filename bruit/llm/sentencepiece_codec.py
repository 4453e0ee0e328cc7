"""SentencePiece encoding and decoding by a streaming Viterbi search (operator 2).

The public model file is of the BPE kind, whose result is not the path of the
largest score sum.  But it is the only path on which each piece is stable (its
own text encodes to itself) and each pair of neighbours is stable (their joined
text encodes to these two).  So the search over boundaries is the usual one:
each boundary keeps a backpointer to the piece that ends there, extended by the
pieces that end later; stability of the pair is the test of a step.  At every
boundary exactly one backpointer survives.  Only the boundaries of the last
``max_len`` characters (the longest piece) can be extended; when all of their
backpointer paths meet in one boundary, ids up to it are final and leave the
window.  At a place that no piece of the vocabulary crosses, all paths meet.

Such places are the starts of blanks, so what a chunk between them gives is
remembered per worker, within bounds; characters without a piece are coded as
bytes.  Decoding joins the pieces' bytes and gives the text back exactly,
but for U+2581, the model's own sign for a blank, which comes back as a blank.

Defined results: null text is an empty text, without ids; lone surrogates can't
occur in Spark strings; repeated rows give repeated results; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bruit.llm.common import map_pandas, pick, table
from bruit.llm.words_cache import ChunkCache

BLANK = "▁"


@dataclass(frozen=True)
class PieceParams:
    model: str = "piece_bpe_32k.model"
    end_id: int | None = None


class Pieces:
    """Vocabulary of a BPE model file and the search over it."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.max_len = max(map(len, self.ids))
        lengths: dict[str, set[int]] = {}
        for t in self.ids:  # by the last three characters, and by two for pieces of two
            if len(t) > 1:
                lengths.setdefault(t[-3:], set()).add(len(t))
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}
        self.inner = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        self.raw = [b""] * n
        for t, i in self.ids.items():
            self.raw[i] = t.replace(BLANK, " ").encode()
        for b, i in enumerate(self.byte_id):
            self.raw[i] = bytes([b])
        self._pairs: dict[int, bool] = {}
        self._alone: dict[str, bool] = {}
        if any(a != BLANK and b == BLANK for a, b in self.inner):
            raise ValueError("a piece crosses the start of a blank")

    def merge(self, s: str) -> list[str]:
        """BPE by its definition, for short strings: join the best-scored neighbours, leftmost first."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                v = self.score.get(parts[i] + parts[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stable(self, t: str) -> bool:
        if (v := self._alone.get(t)) is None:
            v = self._alone[t] = self.merge(t) == [t]
        return v

    def pair(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (v := self._pairs.get(key)) is None:
            if len(self._pairs) > 500_000:
                self._pairs.clear()
            x, y = self.text[a], self.text[b]
            v = self._pairs[key] = self.stable(y) and self.merge(x + y) == [x, y]
        return v

    def search(self, chars: Iterable[str]) -> Iterator[int]:
        """Ids of a text given in parts, each id as soon as it is final."""
        s, last, size = "", [-1], [0]  # window; id and length of the piece that ends at each of its boundaries
        i, ids, ends, pairs, pair = 0, self.ids, self.ends, self._pairs, self.pair
        for part in chars:
            s += part
            while i < len(s):
                i += 1
                tail = s[i - 3 : i] if i > 2 else ""
                for n in (*ends.get(tail, ()), *ends.get(s[i - 2 : i], ())) if i > 1 else ():
                    if n <= i and (t := ids.get(s[i - n : i])) is not None:
                        p = last[i - n]
                        if p < 0:
                            ok = self.stable(s[i - n : i])
                        elif (ok := pairs.get(p << 20 | t)) is None:
                            ok = pair(p, t)
                        if ok:
                            last.append(t)
                            size.append(n)
                            break
                else:
                    last.append(ids.get(s[i - 1], -2))
                    size.append(1)
                if i >= 4096:
                    at = self._meeting(size, i)
                    if at:
                        yield from self._ids(s[:at], last, size, at)
                        # The piece before the window still decides what may follow it.
                        s, last, size, i = s[at:], last[at:], [0, *size[at + 1 :]], i - at
        yield from self._ids(s, last, size, i)

    def short(self, s: str) -> bytes:
        """The same search over a chunk that fits the window, without commits on the way."""
        ids, ends, pairs = self.ids, self.ends, self._pairs
        last, size, none = [-1], [0], ()
        for i, c in enumerate(s, 1):
            three = ends.get(s[i - 3 : i], none) if i > 2 else none
            two = ends.get(s[i - 2 : i], none) if i > 1 else none
            for n in three + two:
                if n <= i and (t := ids.get(s[i - n : i])) is not None:
                    p = last[i - n]
                    if p < 0:
                        ok = self.stable(s[i - n : i])
                    elif (ok := pairs.get(p << 20 | t)) is None:
                        ok = self.pair(p, t)
                    if ok:
                        last.append(t)
                        size.append(n)
                        break
            else:
                last.append(ids.get(c, -2))
                size.append(1)
            prev = c
        return array("I", self._ids(s, last, size, len(s))).tobytes()

    def parts(self, s: str) -> list[str]:
        """Cuts a chunk at the places that no piece crosses."""
        inner = self.inner
        cuts = [i for i in range(1, len(s)) if s[i - 1 : i + 1] not in inner]
        return [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)]

    def _meeting(self, size: list[int], end: int) -> int:
        """The last boundary on all paths back from the boundaries that can still be extended."""
        at = set(range(max(0, end - self.max_len + 1), end + 1))
        while len(at) > 1:
            top = max(at)
            at.remove(top)
            at.add(top - size[top])
        return at.pop()

    def _ids(self, s: str, last: list[int], size: list[int], end: int) -> list[int]:
        out: list[int] = []
        while end > 0:
            if last[end] == -2:
                out += [self.byte_id[b] for b in reversed(s[end - 1].encode())]
            else:
                out.append(last[end])
            end -= size[end]
        return out[::-1]


_loaded: dict[str, tuple[Pieces, ChunkCache]] = {}


def _load(model: str) -> tuple[Pieces, ChunkCache]:
    if model not in _loaded:
        import public_tokenizers

        p = Pieces(public_tokenizers.path(model))
        known: dict[str, bytes] = {}

        def part(x: str) -> bytes:
            if len(x) > 512:
                return np.fromiter(p.search(x[i : i + 4096] for i in range(0, len(x), 4096)), "<u4").tobytes()
            known[x] = out = p.short(x)
            return out

        def many(chunks: list[str]) -> list[bytes]:
            if len(known) > 150_000:
                known.clear()
            return [b"".join([known.get(x) or part(x) for x in p.parts(c)]) for c in chunks]

        # About 200 bytes a chunk or part; a worker shares its executor with the JVM and other workers.
        _loaded[model] = p, ChunkCache(many, limit=300_000)
    return _loaded[model]


def encode_texts(texts: Iterable[str | None], model: str) -> list[bytes]:
    """Ids of each text as unsigned 32-bit little-endian numbers."""
    return _load(model)[1].encode_texts([_chunks(t) if t else [] for t in texts])


def _chunks(text: str) -> list[str]:
    if "  " in text or BLANK in text or text[0] in " \n" or text[-1] == " " or " \n" in text:
        return _whole(text)
    # A line end has no piece, so paths meet on both of its sides: it stands as a chunk's first character.
    return [c if c[:1] == "\n" else BLANK + c for c in text.replace("\n", " \n").split(" ")]


def _whole(text: str) -> list[str]:
    """Chunks of a text with runs of blanks: each run stands before the word that follows it."""
    s = BLANK + text.replace(" ", BLANK)
    cuts = [0] + [i for i in range(1, len(s)) if (s[i] == BLANK and s[i - 1] != BLANK) or s[i] == "\n"]
    return [s[a:b] for a, b in zip(cuts, [*cuts[1:], len(s)], strict=True)]


def decode_ids(ids: bytes, model: str) -> str:
    raw = _load(model)[0].raw
    out = b"".join(map(raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    return out.decode("utf-8", "replace")[1:]  # without the blank that stands before every text


def _slices(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    for b in batches:
        for k in range(0, len(b), rows):
            yield b.iloc[k : k + rows]


def encode(docs: DataFrame, p: PieceParams = PieceParams()) -> DataFrame:
    """(doc_id, ids): unsigned 32-bit little-endian numbers, with ``end_id`` if set."""
    end = b"" if p.end_id is None else np.array([p.end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches):
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [x + end for x in encode_texts(b["text"], p.model)]})

    return map_pandas(_docs(docs), run, "doc_id long, ids binary")


def decode(rows: DataFrame, p: PieceParams = PieceParams()) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [decode_ids(x, p.model) for x in b["ids"]]})

    return map_pandas(rows, run, "doc_id long, text string")


def _docs(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))


def digest(docs: DataFrame, p: PieceParams = PieceParams(), with_ids: bool = False) -> DataFrame:
    """Per document: n_ids, ids_crc32 (of the ids as 32-bit little-endian numbers), and of the decoded text its
    SHA-256 and whether it is the text that was encoded; on demand the ids themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in _slices(batches):
            rows = []
            for doc_id, text, ids in zip(b["doc_id"], b["text"], encode_texts(b["text"], p.model), strict=True):
                back = decode_ids(ids, p.model)
                sha = hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((doc_id, len(ids) // 4, zlib.crc32(ids), sha, back == (text or ""), ids)[: len(names)])
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    return map_pandas(_docs(docs), run, schema)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
