"""Alignment of two tokenizers' tokens of one text by the byte offsets at which both end."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import arrow_rows, stored


BLOCK = 256  # ends of the shorter list that gallop together
# How byte-level BPE files without a pattern of their own cut texts: fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_TEXT = 200_000  # characters from which the tokenizers library encodes alone


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in ``a`` and in ``b`` of the values that both ascending lists hold.

    Galloping: the last of each block of the shorter list is looked for in the longer one
    from the last place on, in steps that double until they pass it; the block's values are
    then searched by halving within the stretch that was passed.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at, size = 0, len(long)
    in_short, in_long = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(short), BLOCK):
        block = short[i:i + BLOCK]
        low, step = at, BLOCK
        while at < size and long[at] <= block[-1]:
            at, step = at + step, step + step
        at = min(at, size)
        stretch = long[low:at]
        if not len(stretch):
            continue
        place = np.searchsorted(stretch, block)
        hit = np.flatnonzero(stretch[np.minimum(place, len(stretch) - 1)] == block)
        in_short.append(hit + i)
        in_long.append(place[hit] + low)
        at = low + int(place[-1])  # ends up to here are below the next block
    found = np.concatenate(in_short), np.concatenate(in_long)
    return found if short is a else found[::-1]


def _byte_letters() -> dict[str, int]:
    """The byte of each printable stand-in of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(spare)): b for b in range(256)}


class Printer:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group, cut after the common ends."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a, self.n = n_a, n_a + n_b
        ids = [*range(n_a), *range(n_b)]
        # every id with each of the signs that may follow it
        self.names = [f"{i},".encode() for i in ids] + [f"{i}|".encode() for i in ids] + [f"{i};".encode() for i in ids]

    def groups(self, a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> bytes:
        if not len(a):
            return b""
        # tokens of a stand behind those of b in earlier groups, tokens of b behind those of a up to their own
        a_group, b_group = (np.searchsorted(at, np.arange(len(x))) for at, x in ((a_at, a), (b_at, b)))
        out = np.zeros(len(a) + len(b), np.int64)
        a_name, b_name = a.copy(), b + self.n_a
        a_name[a_at] += self.n
        b_name[b_at] += 2 * self.n
        out[np.arange(len(a)) + np.concatenate([[0], b_at + 1])[a_group]] = a_name
        out[np.arange(len(b)) + (a_at + 1)[b_group]] = b_name
        return b"".join(map(self.names.__getitem__, out.tolist()))[:-1]


class ByteBpe:
    """A byte-level BPE file; strings of special tokens in a text are plain text."""

    def __init__(self, file: bytes):
        self.file, self.library = file, None
        spec, letters = json.loads(file), _byte_letters()
        vocab = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
        self.tokens = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            known = all(c in letters for c in token)
            self.tokens[i] = bytes(letters[c] for c in token) if known else token.encode()
        self.fast = self._by_rank(spec)

    def _from_library(self):
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_buffer(self.file)
            self.library.encode_special_tokens = True
            self.library.no_padding()
            self.library.no_truncation()
        return self.library

    def _by_rank(self, spec: dict):
        """An encoder by token ranks, where ids follow the order of merges, which gives the same ids."""
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not any(
            model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if not plain or any(model["vocab"].get(x + y) != 256 + i for i, (x, y) in enumerate(merges)):
            return None
        import tiktoken
        return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks={self.tokens[i]: i for i in range(256 + len(merges))}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast and max(map(len, texts)) < LONG_TEXT:
            return [self.fast.encode_ordinary(" " + t) for t in texts]
        return [e.ids for e in self._from_library().encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceBpe:
    """A sentencepiece model, which puts the space before a text itself."""

    def __init__(self, file: bytes):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_proto=file)
        self.tokens = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.tokens.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def ending_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted keys ``a id * len(b) + b id`` of all tokens that can end together.

    Of two tokens that end at one byte the shorter is the end of the longer, so each
    token meets at most as many others as it has ends: some hundred thousand pairs for two
    vocabularies, however many texts there are.
    """
    def of(tokens: list[bytes]) -> dict[bytes, list[int]]:
        found: dict[bytes, list[int]] = {}
        for i, t in enumerate(tokens):
            if t:
                found.setdefault(t, []).append(i)
        return found
    in_a, in_b, keys = of(a), of(b), set()
    for i, t in enumerate(a):
        keys.update(i * len(b) + j for k in range(len(t)) for j in in_b.get(t[k:], ()))
    for j, t in enumerate(b):
        keys.update(i * len(b) + j for k in range(len(t)) for i in in_a.get(t[k:], ()))
    return np.array(sorted(keys), np.int64)


class Aligner:
    """Both tokenizers and the numbers of their pairs."""

    def __init__(self, a: bytes, b: bytes, pairs: np.ndarray):
        self.a, self.b, self.pairs = ByteBpe(a), PieceBpe(b), pairs
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x.tokens], np.int64) for x in (self.a, self.b))
        self.printer = Printer(len(self.a.tokens), len(self.b.tokens))

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, bytes]]:
        """(n_a, n_b, pair numbers of the links in order, groups) of each text."""
        full = [t for t in texts if t]
        encoded = iter(zip(self.a.encode(full), self.b.encode(full), strict=True)) if full else iter(())
        nothing = (0, 0, np.zeros(0, np.int32), b"")
        for text in texts:
            if not text:
                yield nothing
                continue
            a, b = next(encoded)
            whole = b" " + text.encode()
            if b"".join(map(self.a.tokens.__getitem__, a)) != whole or b"".join(map(self.b.tokens.__getitem__, b)) != whole:
                yield nothing
                continue
            a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
            a_at, b_at = common_ends(np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids]))
            keys = a_ids[a_at] * len(self.b.tokens) + b_ids[b_at]
            yield len(a), len(b), np.searchsorted(self.pairs, keys).astype(np.int32), self.printer.groups(a_ids, b_ids, a_at, b_at)


_LOADED: dict[int, Aligner] = {}


def _aligner(number: int, a, b, pairs) -> Aligner:
    """One a worker."""
    if number not in _LOADED:
        _LOADED.clear()
        _LOADED[number] = Aligner(a.value, b.value, pairs.value)
    return _LOADED[number]


def _in_parts(column: pa.Array, most_chars: int = 1 << 18) -> Iterator[list[str | None]]:
    part, size = [], 0
    for text in (t.as_py() for t in column):
        part.append(text)
        size += len(text or "")
        if size >= most_chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id", keep_groups: bool = False) -> tuple[DataFrame, np.ndarray]:
    """One row a row of ``docs``: key, n_a, n_b, groups_sha256, links; and the keys of the link numbers.

    ``a_path`` is a byte-level BPE file, given a space before the text, ``b_path`` a
    sentencepiece model, both read by the driver and sent to the tasks (a vocabulary bounds
    their size).  Both tokens' bytes must join to the space and the text, else, and for a
    null or empty text, there are no tokens and ``groups_sha256`` is ''.  The offsets at
    which tokens of both end cut them into groups; ``links`` holds, in order, the number of
    each pair of tokens that end together.  ``keep_groups`` adds the printed ``groups``.
    Whole texts of any length; repeated rows have a row each; other columns are not used.
    """
    context = docs.sparkSession.sparkContext
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        a_file, b_file = f.read(), g.read()
    pairs = ending_pairs(ByteBpe(a_file).tokens, PieceBpe(b_file).tokens)
    held = [context.broadcast(x) for x in (a_file, b_file, pairs)]
    number = hash((a_file, b_file))
    key_type = docs.schema[key].dataType.simpleString()
    schema = f"key {key_type}, n_a long, n_b long, groups_sha256 string, links array<int>" + (", groups string" if keep_groups else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(number, *held)
        for batch in batches:
            at = 0
            for part in _in_parts(batch.column(1)):
                found = list(aligner.align(part))
                n_a, n_b, links, groups = zip(*found, strict=True)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in links])]).astype(np.int32)
                columns = [batch.column(0).slice(at, len(part)), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()),
                           pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups], pa.string()),
                           pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(links), pa.int32()))]
                names = ["key", "n_a", "n_b", "groups_sha256", "links"]
                if keep_groups:
                    columns.append(pa.array(groups, pa.binary()).cast(pa.string()))
                    names.append("groups")
                at += len(part)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, schema).withColumnRenamed("key", key), pairs


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links of all documents are of each pair; counted a task first."""
    schema = pa.schema([("pair", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(batch.column(0).flatten().to_numpy())
            if len(n) > len(total):
                n, total = total, n.astype(np.int64)
            total[:len(n)] += n
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i:i + 100_000], pa.int32()), pa.array(total[at[i:i + 100_000]])], schema=schema)

    return aligned.select("links").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def aligned_documents(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a row of ``docs``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    An id pair's count is the number of its links in all documents; ``n_best`` are the links
    whose count is the highest of all pairs of their b id, ties included, ``count_sum`` is
    the sum of counts over links.

    Alignments are written once; counts are summed a task before they are shuffled, and
    come back as two arrays over the pairs that two vocabularies can form, a proven bound.
    """
    found, pairs = align(docs, a_path, b_path, text, key)
    with arrow_rows(docs.sparkSession, 500):
        found = stored(found, "alignments")
    counts = np.zeros(len(pairs), np.int64)
    table = link_counts(found).toArrow()
    counts[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    with open(b_path, "rb") as f:
        b_id = pairs % len(PieceBpe(f.read()).tokens)
    highest = np.zeros(1 + int(b_id.max()), np.int64)
    np.maximum.at(highest, b_id, counts)
    held = docs.sparkSession.sparkContext.broadcast((counts, counts == highest[b_id]))
    names = [key, "n_a", "n_b", "n_links", "n_best", "count_sum", "groups_sha256"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = held.value
        for batch in batches:
            links = batch.column(batch.schema.names.index("links"))
            flat, ends = links.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(links.offsets.to_numpy()))])
            sums = [np.concatenate([[0], np.cumsum(x[flat])]) for x in (best.astype(np.int64), counts)]
            n_best, count_sum = (s[ends[1:]] - s[ends[:-1]] for s in sums)
            old = dict(zip(batch.schema.names, batch.columns, strict=True))
            yield pa.RecordBatch.from_arrays([old[key], old["n_a"], old["n_b"], pa.array(np.diff(ends)), pa.array(n_best), pa.array(count_sum), old["groups_sha256"]], names)

    key_type = docs.schema[key].dataType.simpleString()
    return found.mapInArrow(judge, f"`{key}` {key_type}, n_a long, n_b long, n_links long, n_best long, count_sum long, groups_sha256 string").select(
        key, "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")
