"""Token ids in a binary format: static range asymmetric numeral system (rANS).

One frequency table, counted over the whole corpus, codes every block. A block holds whole
documents up to ``BLOCK`` tokens (a longer document goes on in the next blocks) and is coded by
``LANES`` interleaved states. Every ``SEGMENT`` tokens a checkpoint keeps the states and the place in
the word stream, so that segments of a block decode independently; every segment has a CRC-32 of its
ids, every block one of its bytes.

File format (two Parquet tables below one folder; any store Spark writes can hold them):

* ``header``: one row: version, scale_bits, lanes, segment, symbols array<int>, freqs array<int>.
* ``blocks``: part, block, start (tokens of the part before it), n_tokens, doc_ids array<long>,
  doc_tokens array<long> (tokens in this block), goes_on (its first entry continues the document
  before), segments array<long> (CRC-32 of each), states binary (checkpoints, uint64 LE, segment-major),
  places array<int> (first word of each segment), payload binary (uint32 LE words), crc32 long.

Edge cases: a null or empty text is a document of only the end id; null doc_ids come first; equal
doc_ids are ordered by a hash of their ids; an empty table gives an empty file; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hondana.llm import scratch
from hondana.llm.worker import kept

VERSION = 1
SCALE_BITS = 18
LANES = 512
SEGMENT = 1 << 16
BLOCK = 1 << 18
LOW = 1 << 31
END_ID = 1
#: Word pieces kept per Python worker; beyond it the cache starts anew.
CACHE = 600_000

#: Characters for which lower-casing and the tokenizer's own pattern are plain; chunks with others go to the library whole.
_SAFE = re.compile("[\\t\\n\\r\\x20-\\x7eÀ-ÿ]*")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
_CHUNKS = re.compile("[^\\t\\n\\r ]+")

_BLOCKS = (
    "part int, block int, start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, goes_on boolean, "
    "segments array<long>, states binary, places array<int>, payload binary, crc32 long"
)


class Pieces(dict):
    """Piece of text -> its ids as little-endian uint16 bytes, asked from the library once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this tokenizer do not fit 16 bits")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Tokens that the library takes out before its pattern splits the text; those that hold white space cut across chunks.
        self.added = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        self.across = any(_CHUNKS.fullmatch(x) is None for x in added)
        #: How the tokenizer spells letters for its model, byte by byte, and the model's own call, where it gives the ids of each plain character.
        spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {k: spelt(chr(k))[0][0] for k in range(0xC0, 0x100)}
        plain = [chr(k) for k in (*range(0x21, 0x7F), *range(0xC0, 0x100)) if chr(k).lower() == chr(k)]
        self.model = self.tokenizer.model.tokenize
        self.alone = all([t.id for t in self.model(x.translate(self.spelling))] == self.tokenizer.encode(x, add_special_tokens=False).ids for x in plain)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        if self.alone and _PIECES.fullmatch(piece) and _SAFE.fullmatch(piece):  # the library's pattern leaves it whole: only its model is asked
            ids = [t.id for t in self.model(piece if piece.isascii() else piece.translate(self.spelling))]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        ids = pack(f"<{len(ids)}H", *ids)
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """All ids of ``text``. No piece of the tokenizer spans white space, so chunks encode alone, and those that hold one of its added tokens whole."""
        if not text:
            return b""
        get, added = self.__getitem__, self.added
        if added and added.search(text):
            if self.across:
                return self[text]
        elif _SAFE.fullmatch(text):
            return b"".join(map(get, _PIECES.findall(text.lower())))
        return b"".join(b"".join(map(get, _PIECES.findall(c.lower()))) if _SAFE.fullmatch(c) and not (added and added.search(c)) else self[c] for c in _CHUNKS.findall(text))


def token_table(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids (binary, uint16 LE, end id included) of every row of ``docs``."""
    end = np.asarray([end_id], "<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept("pieces", path, lambda: Pieces(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [pieces.ids(x.as_py()) + end for x in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def count_symbols(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs in the whole table. At most one row per id reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), "<u2"), minlength=1 << 16) if len(x.as_py()) > 1 << 15 else 0
            small = b"".join(y for x in batch.column(0) if len(y := x.as_py()) <= 1 << 15)
            total += np.bincount(np.frombuffer(small, "<u2"), minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["symbol", "n"])

    rows = tokens.select("ids").mapInArrow(count, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    return {r.symbol: r.n for r in rows.collect()}


def quantise(counts: dict[int, int], bits: int = SCALE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in ascending order and frequencies of at least 1 that sum to 2 ** bits."""
    symbols = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in symbols.tolist()], np.float64)
    if not len(symbols):
        return symbols, np.zeros(0, np.int64)
    room = (1 << bits) - len(symbols)
    if room < 0:
        raise ValueError("more symbols than the scale has slots")
    share = n / n.sum() * room
    freqs = 1 + np.floor(share).astype(np.int64)
    rest = (1 << bits) - int(freqs.sum())
    freqs[np.argsort(-(share - np.floor(share)), kind="stable")[:rest]] += 1
    return symbols, freqs


class Coder:
    """rANS over one shared table: 64-bit states, 32-bit words."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray, bits: int = SCALE_BITS, lanes: int = LANES, segment: int = SEGMENT):
        self.bits, self.lanes, self.segment = np.uint64(bits), lanes, segment
        self.freq = np.zeros(1 << 16, np.uint64)
        self.base = np.zeros(1 << 16, np.uint64)
        self.freq[symbols] = freqs
        self.base[symbols] = np.cumsum(freqs) - freqs
        self.slots = np.repeat(symbols.astype(np.uint16), freqs)
        self.most = self.freq << np.uint64(63 - bits)
        self.scale = np.uint64((1 << bits) - 1)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, list[int], list[int]]:
        """payload, states, places and CRCs of the segments of one block."""
        half, low32 = np.uint64(32), np.uint64(0xFFFFFFFF)
        words: list[np.ndarray] = []
        states, sizes, crcs = [], [], []
        for at in reversed(range(0, len(ids), self.segment)):
            part = ids[at : at + self.segment]
            x = np.full(self.lanes, LOW, np.uint64)
            out: list[np.ndarray] = []
            for step in reversed(range(0, len(part), self.lanes)):
                s = part[step : step + self.lanes]
                y, f = x[: len(s)], self.freq[s]
                full = y >= self.most[s]
                if full.any():
                    out.append((y[full] & low32).astype("<u4")[::-1])
                    y = np.where(full, y >> half, y)
                q = y // f
                x[: len(s)] = (q << self.bits) + (y - q * f) + self.base[s]
            stream = np.concatenate(out)[::-1] if out else np.zeros(0, "<u4")
            words.append(stream)
            sizes.append(len(stream))
            states.append(x.astype("<u8").tobytes())
            crcs.append(zlib.crc32(part.astype("<u4").tobytes()))
        places = np.concatenate([[0], np.cumsum(sizes[::-1])]).astype(int).tolist()[:-1]
        return b"".join(w.tobytes() for w in words[::-1]), b"".join(states[::-1]), places, crcs[::-1]

    def decode_segment(self, words: np.ndarray, state: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of one segment from its checkpoint; needs no other segment."""
        x, at, half, low = state.astype(np.uint64), 0, np.uint64(32), np.uint64(LOW)
        out = np.empty(n, np.uint16)
        for step in range(0, n, self.lanes):
            m = min(self.lanes, n - step)
            y = x[:m]
            slot = y & self.scale
            s = self.slots[slot]
            out[step : step + m] = s
            y = self.freq[s] * (y >> self.bits) + slot - self.base[s]
            need = np.flatnonzero(y < low)
            if len(need):
                y[need] = (y[need] << half) | words[at : at + len(need)]
                at += len(need)
            x[:m] = y
        return out

    def decode(self, n: int, payload: bytes, states: bytes, places: list[int], crcs: list[int]) -> np.ndarray:
        """All ids of a block; every segment is checked against its CRC."""
        words = np.frombuffer(payload, "<u4").astype(np.uint64)
        points = np.frombuffer(states, "<u8").reshape(-1, self.lanes)
        parts = []
        for k, at in enumerate(range(0, n, self.segment)):
            part = self.decode_segment(words[places[k] :], points[k], min(self.segment, n - at))
            if zlib.crc32(part.astype("<u4").tobytes()) != crcs[k]:
                raise ValueError(f"segment {k} of a block is damaged")
            parts.append(part)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_file(tokens: DataFrame, path: str, lanes: int = LANES, segment: int = SEGMENT, block: int = BLOCK) -> None:
    """Write the ids of ``tokens`` (see :func:`token_table`) in ascending doc_id order to ``path``."""
    spark = tokens.sparkSession
    symbols, freqs = quantise(count_symbols(tokens))
    header = [(VERSION, SCALE_BITS, lanes, segment, symbols.tolist(), freqs.tolist())]
    spark.createDataFrame(header, "version int, scale_bits int, lanes int, segment int, symbols array<int>, freqs array<int>").coalesce(1).write.parquet(f"{path}/header")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = Coder(symbols, freqs, SCALE_BITS, lanes, segment), TaskContext.get().partitionId()
        docs: list[int | None] = []
        sizes: list[int] = []
        ids: list[bytes] = []
        held = start = number = 0
        goes_on = False

        def close(last_goes_on: bool) -> pa.RecordBatch:
            nonlocal held, start, number, goes_on, docs, sizes, ids
            payload, states, places, crcs = coder.encode(np.frombuffer(b"".join(ids), "<u2"))
            row = {"part": part, "block": number, "start": start, "n_tokens": held, "doc_ids": docs, "doc_tokens": sizes, "goes_on": goes_on, "segments": crcs, "states": states, "places": places, "payload": payload, "crc32": zlib.crc32(payload)}
            start, number, goes_on = start + held, number + 1, last_goes_on
            held, docs, sizes, ids = 0, [], [], []
            return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                rest = x.as_py()
                while len(rest) // 2 > block:  # a document of more than a block: fill block after block
                    take = 2 * (block - held)
                    docs.append(doc), sizes.append(take // 2), ids.append(rest[:take])
                    held, rest = block, rest[take:]
                    yield close(True)
                if held and held + len(rest) // 2 > block:
                    yield close(False)
                docs.append(doc), sizes.append(len(rest) // 2), ids.append(rest)
                held += len(rest) // 2
        if held:
            yield close(False)

    # The ids' hash, not the ids, beside doc_id: range bounds are sampled to the driver, and rows of one doc_id may be many.
    ordered = tokens.select("doc_id", "ids", F.xxhash64("ids").alias("mark")).repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "ids").drop("mark")
    ordered.mapInArrow(encode, _BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


_SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())),
        ("goes_on", pa.bool_()),
        ("segments", pa.list_(pa.int64())),
        ("states", pa.binary()),
        ("places", pa.list_(pa.int32())),
        ("payload", pa.binary()),
        ("crc32", pa.int64()),
    ]
)


def _shifted(matrix: list[int], vector: int) -> int:
    out = 0
    for bit in range(32):
        if vector >> bit & 1:
            out ^= matrix[bit]
    return out


def crc32_join(first: int, second: int, n_bytes: int) -> int:
    """CRC-32 of two byte strings one after the other, from theirs and the second's length (linear maps over GF(2))."""
    matrix = [0xEDB88320] + [1 << i for i in range(31)]  # appends one zero bit
    n = n_bytes * 8
    while n:
        if n & 1:
            first = _shifted(matrix, first)
        matrix = [_shifted(matrix, column) for column in matrix]
        n >>= 1
    return first ^ second


def read_header(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/header").first()


def read_file(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, uint16 LE, if asked for) of every document of a file, decoded from its blocks.

    Documents that span blocks come as pieces, whose CRCs are joined; with ``with_ids`` the pieces' bytes are too.
    """
    head = read_header(spark, path)
    symbols, freqs, bits, lanes, segment = np.array(head.symbols, np.int64), np.array(head.freqs, np.int64), head.scale_bits, head.lanes, head.segment
    blocks = spark.read.parquet(f"{path}/blocks")
    out = "part int, first long, piece int, doc_id long, n_tokens long, ids_crc32 long, ids binary"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(symbols, freqs, bits, lanes, segment)
        for batch in batches:
            for r in batch.to_pylist():
                if zlib.crc32(r["payload"]) != r["crc32"]:
                    raise ValueError(f"block {r['block']} of part {r['part']} is damaged")
                ids = coder.decode(r["n_tokens"], r["payload"], r["states"], r["places"], r["segments"])
                wide, at = ids.astype("<u4").tobytes(), 0
                first, piece, crcs, own = [], [], [], []
                for k, n in enumerate(r["doc_tokens"]):
                    first.append(r["start"] + at)
                    piece.append(1 if k == 0 and r["goes_on"] else 0)
                    crcs.append(zlib.crc32(wide[4 * at : 4 * (at + n)]))
                    own.append(ids[at : at + n].astype("<u2").tobytes() if with_ids else None)
                    at += n
                m = len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * m, pa.int32()), pa.array(first, pa.int64()), pa.array(piece, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["doc_tokens"], pa.int64()), pa.array(crcs, pa.int64()), pa.array(own, pa.binary())],
                    ["part", "first", "piece", "doc_id", "n_tokens", "ids_crc32", "ids"],
                )

    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # as many rows as the file has parts
    base, before = [], 0
    for r in parts:
        base.append((r.part, before))
        before += r.n
    bases = spark.createDataFrame(base, "part int, before long")
    pieces = blocks.mapInArrow(decode, out)
    # The blocks that a document goes on in name its place in the part; a document is open from its first piece to there.
    keys = blocks.where("goes_on").select("part", "start").distinct()
    if not keys.take(1):
        whole = pieces.drop("piece")
    else:
        whole = _joined(pieces, with_ids)
    rows = whole.join(F.broadcast(bases), "part").withColumn("start", F.col("before") + F.col("first"))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def _joined(pieces: DataFrame, with_ids: bool) -> DataFrame:
    """Pieces of one document put together. Only documents of more than a block have several."""
    pieces = scratch.write(pieces, "pieces")
    follow = pieces.where("piece = 1").select("part", "first")
    # The piece before a follower ends where the follower begins.
    ends = pieces.withColumn("end", F.col("first") + F.col("n_tokens"))
    broken = ends.join(follow.select("part", F.col("first").alias("end")), ["part", "end"], "left_semi").select("part", "first").union(follow).distinct()
    alone = pieces.join(broken, ["part", "first"], "left_anti").drop("piece")
    several = pieces.join(broken, ["part", "first"], "left_semi")
    # A document of several pieces is a run of followers after a first piece; runs of one part are numbered in order.
    from pyspark.sql import Window

    w = Window.partitionBy("part").orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    runs = several.withColumn("run", F.sum(1 - F.col("piece")).over(w))

    def put(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["first"])
        crc, ids = 0, b""
        for k, r in enumerate(rows):
            crc = r["ids_crc32"] if k == 0 else crc32_join(crc, r["ids_crc32"], 4 * r["n_tokens"])
            ids += r["ids"] or b""
        return pa.Table.from_pylist([{"part": rows[0]["part"], "first": rows[0]["first"], "doc_id": rows[0]["doc_id"], "n_tokens": sum(r["n_tokens"] for r in rows), "ids_crc32": crc, "ids": ids if with_ids else None}], schema=pa.schema([("part", pa.int32()), ("first", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]))

    put_together = runs.groupBy("part", "run").applyInArrow(put, "part int, first long, doc_id long, n_tokens long, ids_crc32 long, ids binary")
    return alone.unionByName(put_together)


def encode_documents(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Tokenise, count, order and write all of ``docs`` to the file at ``path``."""
    tokens = scratch.write(token_table(docs, tokenizer, end_id), "tokens")
    write_file(tokens, path)
    scratch.drop(tokens)


def op1_rans(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encode ``docs`` to a new file in the shared folder and return what it holds per document."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    path = scratch.folder(spark, "ids")
    encode_documents(docs, tokenizer, path)
    return read_file(spark, path)
