"""Packing documents into sequences along a space-filling curve.

1. A document's words are hashed to +1/-1 vectors in a few dimensions and
   averaged, so documents with much in common lie near each other.  The point is
   put on a grid and numbered along a Hilbert curve.
2. Curve positions (made unique-ish by a hash of the id, so that equal texts can
   be dealt out) are cut at quantiles, by bytes of ids, into ranges, one task each.
   The number of ranges follows from the bytes, so a range does not grow with the
   input; the quantiles come from a sample of SAMPLE positions a range, which only
   moves the borders.
3. A task reads its documents in curve order and packs the running stream of
   token ids into sequences of ``length``: every sequence but the last ones of a
   range is full, and the rest of a range is cut into powers of two, which need
   no padding.

Texts are read and tokenised once; ids and curve positions are written before they
are dealt out.  Ids travel as two bytes each when the vocabulary allows; the packer
holds one Arrow batch and one open sequence at a time.

Defined results
* Null text: empty; such a document is its end id alone.
* Null ids are allowed.  Repeated rows are packed as often as they occur.
* Strings of special tokens inside a text become those tokens, as the tokenizer
  does by default; ``special_as_text`` makes them ordinary text.
* Texts of any length are cut over as many sequences as they need.  A text is
  tokenised in pieces that begin at white space, so only a run without white space
  (or a run of white space) is ever whole in the tokenizer.
* Empty table: no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm import kernels
from wattline.llm.text import settle, small_batches

LENGTH = 2048
END = 1
DIMS, GRID_BITS = 4, 10
TIE_BITS = 62 - DIMS * GRID_BITS
#: Bytes of ids in a range, and sampled positions a range.
RANGE_BYTES, SAMPLE = 512 << 20, 20
#: Ids of so many short pieces of text are remembered by a Python worker.
REMEMBERED, SHORT = 500_000, 48
#: A Latin word, with the blank before it, that no letter follows; else white space
#: and what follows it up to the next white space.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
PIECE = re.compile(rf" ?[{LETTERS}]++(?![^\W\d_])|\s*\S+|\s+")
PLAIN = re.compile(rf" ?[{LETTERS}]+")
#: How many plain words go through the model at once.
TOGETHER = 500

_encoders: dict = {}


def vocabulary() -> str:
    """The byte-level BPE with 50,257 ids that the tokenizer package installs."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str, kind: type = np.uint32, special_as_text: bool = False) -> Callable[[list[str]], list[bytes]]:
    """texts -> their ids as arrays of ``kind`` in bytes; made once a process.

    No rule of a byte-level tokenizer's word pattern goes on from a letter to another
    kind of character, or from a visible character into white space, and its special
    tokens have no white space and no letter first.  So the ids of a text are those of
    its pieces, and the ids of frequent pieces need not be made again.  A plain word is
    one match of the pattern; its bytes go to the model as they are after the
    pre-tokenizer, many words at once with a line feed, which they lack, between two.
    """
    key = path, kind, special_as_text
    if key in _encoders:
        return _encoders[key]
    # Spark runs a worker on every core; threads of the tokenizer's own would only contend.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = special_as_text
    bare = Tokenizer(made.model)
    bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    # Printable bytes stand for themselves; the others are numbered on from 256.
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    signs = "".join(chr(b if b in printable else 256 + others.index(b)) for b in range(256))
    feed = signs[10]
    feed_id = bare.token_to_id(feed)
    known: dict[str, bytes] = {}

    def each(pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=kind).tobytes() for e in made.encode_batch_fast(pieces, add_special_tokens=False)]

    def at_once(words: list[str]) -> list[bytes]:
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        joined = [codecs.charmap_decode("\n".join(g).encode(), "strict", signs)[0] for g in groups]
        out = []
        for group, e in zip(groups, bare.encode_batch_fast([x.replace(feed, f"\n{feed}\n") for x in joined], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=kind)
            cuts = np.concatenate(([-1], np.flatnonzero(ids == feed_id), [len(ids)])) * ids.itemsize
            raw = ids.tobytes()
            out += [raw[a + ids.itemsize : b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return out

    def ids_of(pieces: list[str]) -> dict[str, bytes]:
        plain = list(filter(PLAIN.fullmatch, pieces))
        other = list(set(pieces).difference(plain))
        return dict(zip(plain + other, at_once(plain) + each(other), strict=True))

    def encode(texts: list[str]) -> list[bytes]:
        cut = [PIECE.findall(t) for t in texts]
        new = set().union(*cut) - known.keys()
        long = {p: each([p])[0] for p in new if len(p) > SHORT}
        short = [p for p in new if len(p) <= SHORT]
        if len(known) + len(short) > REMEMBERED:
            known.clear()
            short = list({p for pieces in cut for p in pieces if len(p) <= SHORT})
        known.update(ids_of(short))
        look = {**known, **long}.__getitem__ if long else known.__getitem__
        return [b"".join(map(look, pieces)) for pieces in cut]

    _encoders[key] = encode
    return encode


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Curve positions of integer points, shape (n, dims), each below 2^bits.

    Skilling's transform: undo the excess work of each bit plane from the top,
    Gray-encode, then interleave the bits.
    """
    x = points.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > 1:
        low = q - one
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.uint64)
    q = one << np.uint64(bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= turn
    out = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out


def curve_keys(texts: pa.Array, dims: int = DIMS, bits: int = GRID_BITS) -> np.ndarray:
    """Hilbert positions of the texts' hashed word vectors."""
    words, counts = kernels.word_hashes(*kernels.buffers(texts))
    full = np.flatnonzero(counts)
    points = np.full((len(counts), dims), (1 << bits) // 2, dtype=np.int64)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        for d in range(dims):
            sign = ((words >> np.uint64(d)) & np.uint64(1)).astype(np.float32) * 2 - 1
            mean = np.add.reduceat(sign, starts) / counts[full]
            points[full, d] = np.clip((mean + 1) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
    return hilbert(points, bits)


def _key(texts: pa.Array, tie: pa.Array) -> pa.Array:
    ties = tie.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - TIE_BITS)
    return pa.array(((curve_keys(texts) << np.uint64(TIE_BITS)) | ties).view(np.int64))


def _tokenise(path: str, end: int, wide: bool, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint32 if wide else np.uint16
        encode, last = encoder(path, kind, special_as_text), np.array([end], dtype=kind).tobytes()
        for batch in kernels.slices(batches, 2000):
            ids = [x + last for x in encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), _key(batch.column(1), batch.column(2)), pa.array([len(x) for x in ids]), pa.array(ids, pa.binary())], ["doc_id", "key", "bytes", "ids"])

    return run


def _ranges(keys: DataFrame, parts: int | None) -> list[int]:
    """Borders between ranges of about equal bytes of ids, from (key, bytes) rows.

    What one task and the driver see is SAMPLE rows and one number a range.
    """
    n, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if parts is None:
        parts = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    if parts < 2 or not n:
        return []
    share = min(1.0, max(100_000, SAMPLE * parts) / n)
    sample = keys.where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < int(share * (1 << 40)))
    found = sample.agg(F.percentile("key", [i / parts for i in range(1, parts)], F.col("bytes"))).first()[0]
    return sorted({int(x) for x in found or []})


def _tail(rest: int, length: int) -> list[int]:
    """Cuts the last tokens of a range into powers of two, large first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if rest >> b & 1]


class _Packer:
    """Lays documents end to end and cuts the stream into sequences."""

    def __init__(self, length: int, part: int):
        self.length, self.next, self.held, self.size = length, part << 40, [], 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        while start < len(ids):
            piece = ids[start : start + self.length - self.size]
            self.held.append((doc, start, piece, len(ids)))
            self.size += len(piece)
            start += len(piece)
            if self.size == self.length:
                yield from self._close([self.length])

    def finish(self) -> Iterator[tuple]:
        if self.size:
            yield from self._close(_tail(self.size, self.length))

    def _close(self, sizes: list[int]) -> Iterator[tuple]:
        held, self.held, self.size = self.held, [], 0
        room, offset, sizes = sizes[0], 0, sizes[1:]
        for doc, start, ids, total in held:
            while len(ids):
                piece, ids = ids[:room], ids[room:]
                yield doc, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), total, self.next, offset
                start, offset, room = start + len(piece), offset + len(piece), room - len(piece)
                if room == 0:
                    self.next += 1
                    room, offset, sizes = (sizes[0], 0, sizes[1:]) if sizes else (self.length, 0, [])


_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _pack(length: int, wide: bool, kind: pa.DataType):
    types = [kind] + [pa.int64()] * 6

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(_FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, code, rows = None, np.uint32 if wide else np.uint16, []
        for batch in batches:
            if packer is None and batch.num_rows:
                packer = _Packer(length, batch.column(1)[0].as_py())
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                rows.extend(packer.add(doc, np.frombuffer(ids.as_buffer(), dtype=code)))
                if len(rows) >= 4096:
                    yield batch_of(rows)
                    rows = []
        if packer is not None:
            rows.extend(packer.finish())
        if rows:
            yield batch_of(rows)

    return run


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    length: int = LENGTH,
    end: int = END,
    wide: bool = False,
    special_as_text: bool = False,
    parts: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``wide`` is for vocabularies over 65,536 ids.  ``parts`` is the number of
    ranges, by default one for RANGE_BYTES of ids and at least the session's
    number of shuffle partitions.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer or vocabulary()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("tie"))
    kind = rows.schema["doc_id"].dataType
    # Written, so that borders come from two narrow columns and no text is read twice.
    coded = settle(rows.mapInArrow(_tokenise(path, end, wide, special_as_text), f"doc_id {kind.simpleString()}, key long, bytes long, ids binary"))
    cuts = np.array(_ranges(coded, parts), dtype=np.int64)

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), "right").astype(np.int32))

    dealt = coded.withColumn("part", part("key")).repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("key", "doc_id").select("doc_id", "part", "ids")
    out = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long".format(kind.simpleString())
    from pyspark.sql.pandas.types import to_arrow_type

    return dealt.mapInArrow(_pack(length, wide, to_arrow_type(kind)), out)
