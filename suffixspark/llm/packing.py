"""Packing documents into sequences of at most 1024 tokens by minimum bin slack.

A document's tokens are cut into full sequences and one remainder. Remainders are dealt into buckets by hash. Within a
bucket a window of remainders is held; each sequence starts with the longest of them, and a subset-sum over
bitsets (one bit for each reachable length) picks the others that fill it closest to capacity; walking
the bitsets back gives which. The window is filled up again after each sequence.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

CAPACITY, WINDOW, BUCKET_DOCS, END = 1024, 1024, 8192, 0
#: Pieces packed at once: a bucket that has more is packed in parts.
HELD_PIECES = 1 << 18
#: White space runs this long are encoded apart; texts are encoded in parts of PART characters or a little more.
LONG_RUN, PART = 4096, 1 << 20
#: What the splitting pattern takes for white space, of the characters that the fast way is for.
_WHITE = r"[\t-\r \xa0]"
VOCABULARY = "byte_bpe_50k"
#: Outside of these characters, and for the vocabulary's special token, texts go through the tokenizers library itself.
_PLAIN = r"[^\x00-\x84\x86-ɏ‐-‧‰-⁞€]|<\|endoftext\|>"

_SPLIT = re.compile(r"(?<=[A-Za-z0-9])[ \n]")


def encoder(vocabulary: str = VOCABULARY):
    """text -> list of ids, as tokenizers gives them with add_special_tokens=False.

    The .tiktoken file holds the same vocabulary as ranks and is several times as fast. Its splitting pattern
    has another regular expression engine behind it, so it only takes texts of characters whose classes
    can't differ between versions of Unicode. Its engine keeps a step on a stack for each character of a run of
    white space, so a long run goes by itself: it is one piece of the pattern, but for its last character where
    more text follows. Both take a text in parts that end where a word does and white space begins, where
    the pattern always splits; so any length costs linear time, and a part's memory.
    """
    import base64
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    other, long_run = re.compile(_PLAIN), re.compile(rf"(?<!{_WHITE}){_WHITE}{{{LONG_RUN},}}")

    def plain(text: str) -> list[int]:
        out, done = [], 0
        for m in long_run.finditer(text):
            out += fast.encode_ordinary(text[done : m.start()])
            done = m.end() if m.end() == len(text) else m.end() - 1
            out += fast._encode_single_piece(text[m.start() : done])
        return out + fast.encode_ordinary(text[done:]) if done else fast.encode_ordinary(text)

    def encode(text: str) -> list[int]:
        out: list[int] = []
        for part in parts(text):
            out += exact.encode(part, add_special_tokens=False).ids if other.search(part) else plain(part)
        return out

    return encode


def parts(text: str, size: int = PART) -> list[str]:
    """The text cut before the first space or newline after a letter or digit of ASCII that follows ``size`` characters, and so on."""
    out, done = [], 0
    while len(text) - done > size and (m := _SPLIT.search(text, done + size)):
        out.append(text[done : m.start()])
        done = m.start()
    return [*out, text[done:]]


def _token_rows(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            counts, sums = [], []
            for text in batch.column("body"):
                ids = np.array(encode(text.as_py()) + [END], "<u4")
                counts.append(len(ids))
                sums.append([zlib.crc32(ids[a : a + CAPACITY]) for a in range(0, len(ids), CAPACITY)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("bucket"), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["doc_id", "bucket", "doc_tokens", "crcs"])

    return run


def best_fill(lengths: Iterable[int], room: int) -> list[int]:
    """Which of the lengths (longest first is best) sum up to the most within room."""
    mask = (1 << (room + 1)) - 1
    steps, reach = [], 1
    for n in lengths:
        steps.append((n, reach))
        reach |= (reach << n) & mask
        if reach >> room & 1:
            break
    left, out = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        if not before >> left & 1:
            out.append(n)
            left -= n
    return out


def pack(remainders: Iterator[tuple[int, int]], capacity: int = CAPACITY, window: int = WINDOW) -> Iterator[list[tuple[int, int]]]:
    """Sequences of (length, item) from such pairs, all below capacity in length."""
    pool: dict[int, list[int]] = {}
    keys: list[int] = []  # the lengths in the pool, ascending

    def below(room: int) -> Iterator[int]:
        for k in range(bisect_right(keys, room) - 1, -1, -1):
            n = keys[k]
            for _ in range(min(len(pool[n]), room // n)):
                yield n

    def take(n: int) -> tuple[int, int]:
        item = pool[n].pop()
        if not pool[n]:
            del pool[n]
            keys.pop(bisect_left(keys, n))
        return n, item

    held, ended = 0, False
    while True:
        while not ended and held < window:
            pair = next(remainders, None)
            if pair is None:
                ended = True
                break
            if pair[0] not in pool:
                insort(keys, pair[0])
                pool[pair[0]] = []
            pool[pair[0]].append(pair[1])
            held += 1
        if not held:
            return
        out = [take(keys[-1])]
        room = capacity - out[0][0]
        out += [take(n) for n in best_fill(below(room), room)]
        held -= len(out)
        yield out


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solve(sequence: int, docs: list[tuple]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        rest = []
        for k, (doc_id, tokens, crcs) in enumerate(docs):
            for i, crc in enumerate(crcs):
                start = i * CAPACITY
                n = min(CAPACITY, tokens - start)
                if n == CAPACITY:
                    out.append((doc_id, start, n, crc, tokens, sequence, 0))
                    sequence += 1
                else:
                    rest.append((n, k))
        for members in pack(iter(rest)):
            offset = 0
            for n, k in members:
                doc_id, tokens, crcs = docs[k]
                out.append((doc_id, tokens - n, n, crcs[-1], tokens, sequence, offset))
                offset += n
            sequence += 1
        for a in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[a : a + 20_000], strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # A piece is in one sequence, so numbers from the bucket's first on that count its pieces so far are free.
    bucket, first, held, pieces = None, 0, [], 0
    for batch in batches:
        for b, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "doc_tokens", "crcs")), strict=True):
            if (b != bucket or pieces >= HELD_PIECES) and held:
                yield from solve(first, held)
                first, held, pieces = first + pieces, [], 0
            if b != bucket:
                bucket, first = b, b << 40
            held.append(row)
            pieces += len(row[-1])
    if held:
        yield from solve(first, held)


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of ``docs`` (doc_id, text).

    Null text is empty and packs as the one end id; a text of any length is cut into full sequences and one
    remainder; repeated rows are packed each on its own; other columns are ignored; an empty table gives no
    rows. Only numbers are shuffled: token counts and checksums of pieces. Rows of one doc_id, or of none, are dealt
    to a bucket for each partition of ``docs`` that holds any, and a large bucket is packed in parts.
    """
    n = max(1, -(-docs.count() // bucket_docs))
    rows = docs.select("doc_id", whole_text().alias("body"), F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(n)).alias("bucket"))
    tokens = rows.mapInArrow(_token_rows(vocabulary), "doc_id long, bucket long, doc_tokens long, crcs array<long>")
    dealt = tokens.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "doc_tokens", "crcs")
    return dealt.mapInArrow(_pack_rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
