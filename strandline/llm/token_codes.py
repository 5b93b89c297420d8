"""Token ids as directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level 0 holds the first chunk of every id;
a continuation bitmap says which ids go on in level 1, and so forth. A rank directory (one count for
512 bits) turns a position of one level into the position of the next, so any token is read from a
few bytes without decoding a block. A shard is one binary value:

    magic "SLDA", version, number of levels, number of tokens,
    per level: number of chunks, chunks (1 byte each), bitmap (little bit order, whole 64-bit words), directory (u32)

Shards are rows of a Parquet table that Spark's committer writes in the shared folder, so a lost
executor leaves no half-written file and any Hadoop store will do.

Null texts are empty; an empty text has the end id only. Repeated rows and equal ids are kept, ordered
by id, then by a hash of the text; null ids come first. Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, col, ranges, slices, table, text_buffers, written

MAGIC, VERSION, BLOCK = b"SLDA", 1, 512
#: Bytes of text that are tokenised at a time, tokens of a shard, and words whose ids a worker remembers.
SLICE_BYTES, SHARD_TOKENS, MEMO_WORDS = 4 << 20, 1 << 20, 700_000
#: Bytes of remembered words, which may be long, beyond which they are forgotten.
MEMO_BYTES = 128 << 20
#: Range partitions whose totals are broadcast.
FEW_PARTS = 250_000
#: The normaliser and the pattern of words for which ids of a text are those of its words, in order (fixed values
#: of a tokenizer's file). White space is never of a word; a letter or digit and CUT's punctuation are never of one word;
#: A-Z are lower-cased before words are looked up. A tokenizer with any other settings encodes whole texts.
WORD_NORMALISERS = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Only letters up to U+00FF, which NFC and lower case leave single letters; others may end in a mark, which goes with the punctuation.
CUT = r"([0-9A-Za-zÀ-ÖØ-öø-ÿ])([.,!?;:])"
#: Words that are not folded: with special tokens, or letters above U+00FF (H and a mark stay two where h and it are one).
KEPT = r"<\||[^\x{00}-\x{FF}]"
#: Words that WORD_PATTERN leaves whole, whatever stands around them, and how many of them are encoded as one text.
PLAIN, JOINED = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+$", 512


def by_words(settings: dict) -> bool:
    """Whether a tokenizer's file has the settings under which a text may be cut into words."""
    norm, pre, model = settings.get("normalizer") or {}, settings.get("pre_tokenizer") or {}, settings.get("model") or {}
    steps, splits = norm.get("normalizers") or [], pre.get("pretokenizers") or []
    if [x.get("type") for x in steps] != WORD_NORMALISERS or [x.get("type") for x in splits] != ["Split", "ByteLevel"]:
        return False
    split, level = splits
    spaces = steps[1].get("pattern") == {"Regex": r"\s+"} and steps[1].get("content") == " "
    words = split.get("pattern") == {"Regex": WORD_PATTERN} and split.get("behavior") == "Removed" and split.get("invert") is True
    plain = level.get("add_prefix_space") is False and level.get("use_regex") is False and model.get("type") == "BPE" and not model.get("dropout")
    special = all(re.fullmatch(r"<\|[^\s.,!?;:]*\|>", x["content"]) and not x.get("lstrip") and not x.get("rstrip") and not x.get("normalized") for x in settings.get("added_tokens") or [])
    return bool(spaces and words and plain and special and not settings.get("post_processor") and not settings.get("truncation") and not settings.get("padding"))


def encode_codes(ids: np.ndarray) -> bytes:
    """The shard of a sequence of ids below 2**32."""
    rest = np.ascontiguousarray(ids, np.uint32)
    levels: list[bytes] = []
    while len(rest) or not levels:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)])
        words = np.bitwise_count(bits.view(np.uint64)).astype(np.uint32)
        per = np.add.reduceat(words, np.arange(0, len(words), BLOCK // 64)) if len(words) else np.zeros(0, np.uint32)
        directory = np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.uint32) if len(per) else np.zeros(0, np.uint32)
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + directory.tobytes())
        rest = rest[more] >> 8
    return MAGIC + struct.pack("<BBQ", VERSION, len(levels), len(ids)) + b"".join(levels)


class Codes:
    """Random access to a shard."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard of token codes")
        version, levels, self.n = struct.unpack_from("<BBQ", blob, 4)
        if version != VERSION:
            raise ValueError(f"unknown version {version}")
        at, self.levels = 14, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", blob, at)
            at += 8
            chunks = np.frombuffer(blob, np.uint8, n, at)
            at += n
            nbits = -(-(-(-n // 8)) // 8) * 8
            bits = np.frombuffer(blob, np.uint8, nbits, at)
            at += nbits
            directory = np.frombuffer(blob, np.uint32, -(-nbits * 8 // BLOCK), at)
            at += 4 * len(directory)
            self.levels.append((chunks, bits, directory))

    def rank(self, level: int, i: int) -> int:
        """Set bits before position i of a level's bitmap."""
        _, bits, directory = self.levels[level]
        if i >= len(bits) * 8:
            return int(directory[-1]) + int(np.bitwise_count(bits[(len(directory) - 1) * (BLOCK // 8) :]).sum()) if len(directory) else 0
        b = i // BLOCK
        whole = bits[b * (BLOCK // 8) : i // 8]
        return int(directory[b]) + int(np.bitwise_count(whole).sum()) + int(bits[i // 8] & ((1 << (i % 8)) - 1)).bit_count()

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i = self.rank(level, i)
        return value

    def range(self, lo: int, hi: int) -> np.ndarray:
        """The ids of positions lo to hi, reading only their own chunks."""
        out = np.zeros(hi - lo, np.uint32)
        where = None
        for level, (chunks, bits, _) in enumerate(self.levels):
            part = chunks[lo:hi].astype(np.uint32) << np.uint32(8 * level)
            if where is None:
                out |= part
            else:
                out[where] |= part
            first = lo // 8
            on = np.unpackbits(bits[first : -(-hi // 8)], bitorder="little")[lo - first * 8 : hi - first * 8].astype(bool)
            n = int(on.sum())
            if not n:
                break
            where = np.flatnonzero(on) if where is None else where[on]
            lo = self.rank(level, lo)
            hi = lo + n
        return out


class Tokens:
    """Ids of whole texts by a tokenizer of the tokenizers library.

    Where the tokenizer's settings allow it (see by_words), the ids of each word are remembered: the ids
    of a text are those of its words, cut at ASCII white space and at CUT, which repeat, in order.
    Plain words are encoded many in a text, as a call for each costs more than its ids; where the model marks the
    last token of a word, each word's ids end there.
    """

    def __init__(self, path: str, memo: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), memo
        settings = json.loads(self.tokenizer.to_str())
        self.by_words, mark = by_words(settings), settings["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab() if self.by_words and mark else {}
        self.last = np.zeros(max(vocab.values(), default=-1) + 1, bool)  # whether a token is the last of its word
        self.last[[i for t, i in vocab.items() if t.endswith(mark)]] = True
        self.forget()

    def forget(self) -> None:
        import pyarrow as pa

        self.known = pa.array([], pa.string())
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint16), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(n.sum())), n

    def plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What encoded gives for words of PLAIN."""
        ids, n = self.encoded([" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)])
        stop = np.flatnonzero(self.last[ids]) + 1 if len(self.last) else np.zeros(0, np.int64)
        # As many marks in each text as words, the last of them at its end.
        upto = np.cumsum(n)
        want = np.minimum(np.arange(1, len(n) + 1) * JOINED, len(words))
        if len(stop) != len(words) or not np.array_equal(stop[want - 1], upto):
            return self.encoded(words)
        return ids, np.diff(np.append(0, stop))

    def words(self, words) -> np.ndarray:
        """The place of each word of an Arrow array of different words in starts and lengths, which point into flat."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.known) > self.memo or self.known.nbytes > MEMO_BYTES:
            self.forget()
        words = words.cast(pa.string())
        at = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = words.take(pa.array(new))
            plain = pc.match_substring_regex(fresh, PLAIN).to_numpy(zero_copy_only=False) if len(self.last) else np.zeros(len(new), bool)
            order = np.argsort(~plain, kind="stable")
            fresh, n_plain = fresh.take(pa.array(order)), int(plain.sum())
            (got, n), (others, n_others) = self.plain(fresh.slice(0, n_plain).to_pylist()), self.encoded(fresh.slice(n_plain).to_pylist())
            got, n = np.concatenate([got, others]), np.concatenate([n, n_others])
            kind = np.uint32 if len(got) and got.max() > 65535 else np.uint16
            at[new[order]] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, fresh])
            self.starts = np.concatenate([self.starts, (len(self.flat) + np.cumsum(n) - n).astype(np.int32)])
            self.lengths = np.concatenate([self.lengths, n.astype(np.int32)])
            self.flat = np.concatenate([self.flat, got.astype(kind)])
        return at

    def texts(self, column, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by end_id; number of ids of each)."""
        import pyarrow.compute as pc

        column = pc.fill_null(column, "")
        if not self.by_words:
            ids, n = self.encoded(column.to_pylist())
            return self.ended(ids, n, end_id)
        column = pc.replace_substring_regex(column, pattern=CUT, replacement=r"\1 \2")
        split = pc.ascii_split_whitespace(column)
        n_words = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(split).dictionary_encode()
        words, of = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        if len(words):
            folded = pc.if_else(pc.match_substring_regex(words, KEPT), words, pc.ascii_lower(words)).dictionary_encode()
            words, of = folded.dictionary, folded.indices.to_numpy(zero_copy_only=False)[of]
        at = self.words(words)
        start, lengths = (x[at][of] if len(of) else np.zeros(0, np.int32) for x in (self.starts, self.lengths))
        ids = self.flat[ranges(start, lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        upto = ends[np.cumsum(n_words)] if len(n_words) else np.zeros(0, np.int64)
        return self.ended(ids, np.diff(np.concatenate([[0], upto])), end_id)

    @staticmethod
    def ended(ids: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of texts, of which each has n, with end_id after each; number of ids of each then."""
        out = np.full(len(ids) + len(n), end_id, np.uint32)
        stay = np.ones(len(out), bool)
        stay[np.cumsum(n + 1) - 1] = False
        out[stay] = ids
        return out, n + 1


def _writer(path: str, end_id: int, slice_bytes: int, shard_tokens: int):
    def write(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa
        from pyspark import TaskContext

        part, tokens, base = TaskContext.get().partitionId(), Tokens(path), 0
        docs, counts, ids, held = [], [], [], 0

        def shard():
            nonlocal base, held
            n = np.concatenate(counts)
            row = {"part": [part], "base": [base], "n_tokens": [held], "doc_ids": [pa.concat_arrays(docs).to_pylist()], "counts": [n.tolist()], "codes": [encode_codes(np.concatenate(ids))]}
            base += held
            docs.clear(), counts.clear(), ids.clear()
            held = 0
            return pa.RecordBatch.from_pydict(row, schema=schema)

        schema = pa.schema([("part", pa.int32()), ("base", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary())])
        for batch in batches:
            _, start, end = text_buffers(batch.column(1))
            for i, j in slices(start, end, slice_bytes):
                got, n = tokens.texts(batch.column(1).slice(i, j - i), end_id)
                docs.append(batch.column(0).slice(i, j - i))
                counts.append(n)
                ids.append(got)
                held += len(got)
                if held >= shard_tokens:
                    yield shard()
        if held:
            yield shard()

    return write


def write_token_codes(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes docs in ascending id order into a table of shards and returns that table, read back lazily."""
    n = buckets_for(docs.sparkSession, docs, 16 << 20)
    ordered = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    shards = ordered.mapInArrow(_writer(tokenizer_path, end_id, slice_bytes, shard_tokens), "part int, base long, n_tokens long, doc_ids array<long>, counts array<long>, codes binary")
    return written(shards, "token-codes")


def read_token_codes(shards: DataFrame) -> DataFrame:
    """Per document of a shard table, from its codes: doc_id, start, n_tokens, ids_crc32."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                codes, n = Codes(row["codes"]), np.array(row["counts"], np.int64)
                first = np.cumsum(n) - n
                crc = [zlib.crc32(codes.range(int(lo), int(lo + k)).astype("<u4").tobytes()) for lo, k in zip(first, n, strict=True)]
                yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]] * len(n), pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()), "at": first + row["base"], "n_tokens": n, "ids_crc32": pa.array(crc, pa.int64())})

    from pyspark.sql import Window

    # One row for each range partition: small enough for one window. Broadcast behind a check of their number, else joined.
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    before = F.broadcast(before) if totals.count() <= FEW_PARTS else before
    rows = shards.select("part", "base", "doc_ids", "counts", "codes").mapInArrow(read, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_token_codes(write_token_codes(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2))
