"""BPE encoding and decoding over a trie of the distinct words of a batch."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# White space of Unicode; Python's str.split also cuts at \x1c-\x1f.
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
END = "\uffff"  # ends a word; byte letters never reach it
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A word-end BPE vocabulary and its encoder.

    The encoding of a word is found along the trie of all distinct words: the state of a
    prefix is the last token of its encoding and where that token begins.  Token ``t``
    ends the encoding of a prefix exactly when it is a suffix of the prefix and follows
    the last token ``s`` of what is left in a valid way, that is when encoding ``s + t``
    gives ``s, t`` again; there is one such ``t``.  So a prefix that thousands of words
    share is encoded once.
    """

    def __init__(self, spec: dict, cache_words: int = 150_000):
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.halves = {a + b: (a, b) for a, b in reversed(merges)}
        self.made = {token: self.rank[pair] for token, pair in self.halves.items()}
        self.names = {i: t for t, i in self.ids.items()}
        self._build_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = _byte_letters()
        self.cache_words = cache_words
        # what was met lately, and before that
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.older_words: dict[str, tuple[int, ...]] = {}
        self.follows: dict[int, bool] = {}

    def _build_automaton(self) -> None:
        """States of an automaton over all tokens: where a letter leads, and which tokens end there.

        The end of a word is a letter of its own.  ``ends`` holds (length, id) of the
        tokens that end at a state, longest first, the end sign not counted.
        """
        self.steps: list[dict[str, int]] = [{}]
        own: list[tuple[int, int] | None] = [None]
        for token, i in self.ids.items():
            word_end = bool(self.suffix) and token.endswith(self.suffix)
            letters = token.removesuffix(self.suffix) if word_end else token
            state = 0
            for c in [*letters, END] if word_end else letters:
                following = self.steps[state].get(c)
                if following is None:
                    following = self.steps[state][c] = len(self.steps)
                    self.steps.append({})
                    own.append(None)
                state = following
            own[state] = (len(letters), i)
        self.fails, self.ends = [0] * len(self.steps), [()] * len(self.steps)
        level = list(self.steps[0].values())
        for state in level:
            self.ends[state] = (own[state],) if own[state] else ()
        while level:
            below = []
            for state in level:
                for c, following in self.steps[state].items():
                    fail = self.fails[state]
                    while fail and c not in self.steps[fail]:
                        fail = self.fails[fail]
                    fail = self.steps[fail].get(c, 0)
                    self.fails[following] = fail
                    self.ends[following] = ((own[following],) if own[following] else ()) + self.ends[fail]
                    below.append(following)
            level = below

    # --- tokens -----------------------------------------------------------------------

    def _may_follow(self, left: str | None, right: str) -> bool:
        """Whether encoding the two tokens' letters together gives just these two.

        The merges of both are undone from the latest back.  At every moment the last piece
        of ``left`` and the first of ``right`` touch; the border is merged away if their own
        merge comes before each of them is merged further within its token.  Of equal merges
        the leftmost comes first.
        """
        left_until = right_until = len(self.rank)
        rank, made, halves = self.rank, self.made, self.halves
        while True:
            across = rank.get((left, right))
            if across is not None and across < left_until and across <= right_until and across < len(rank):
                return False
            left_made, right_made = made.get(left, -1), made.get(right, -1)
            if left_made > right_made:
                left_until, left = left_made, halves[left][1]
            elif right_made >= 0:
                right_until, right = right_made, halves[right][0]
            else:
                return True

    def _is_own_encoding(self, token: str) -> bool:
        """Whether the token's letters encode to the token."""
        if token not in self.halves:
            return True
        left, right = self.halves[token]
        a, b, until = left, right, self.made[token]
        while True:  # as in _may_follow, but the border must hold until the token itself is made
            a_made, b_made = self.made.get(a, -1), self.made.get(b, -1)
            if max(a_made, b_made) < 0:
                break
            if a_made > b_made:
                a_until, a, b_until = a_made, self.halves[a][1], until
            else:
                b_until, b, a_until = b_made, self.halves[b][0], until
            across = self.rank.get((a, b))
            if across is not None and across < a_until and across <= b_until:
                return False
        return self._is_own_encoding(left) and self._is_own_encoding(right)

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct words (in byte letters), along their trie.

        Sorted, the words are their trie in preorder: what a word shares with the one before
        is the path down to the node where they part, whose states are still at hand, and
        its other letters are the new nodes below.
        """
        out: dict[str, tuple[int, ...]] = {}
        steps, fails, ends, follows, names, size_of = self.steps, self.fails, self.ends, self.follows, self.names, len(self.names) + 1
        # of each node on the path: its state, the last token of its encoding, and where that begins
        states, last, begins = [0], [-1], [0]
        before = ""
        for word in sorted(words):
            size, shared, most = len(word), 0, min(len(before), len(last) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            shared = min(shared, size - 1)
            del states[shared + 1:], last[shared + 1:], begins[shared + 1:]
            state = states[shared]
            for depth in range(shared + 1, size + 1):
                c = word[depth - 1]
                while state and c not in steps[state]:
                    state = fails[state]
                state = steps[state].get(c, 0)
                here = state
                if depth == size and self.suffix:  # tokens that end here and end the word
                    while here and END not in steps[here]:
                        here = fails[here]
                    here = steps[here].get(END, 0)
                for length, token in ends[here]:
                    begin = depth - length
                    key = (last[begin] + 1) * size_of + token
                    known = follows.get(key)
                    if known is None:
                        known = follows[key] = self._may_follow(names[last[begin]], names[token]) if begin else self._is_own_encoding(names[token])
                    if known:
                        break
                else:
                    raise ValueError(f"no token of the vocabulary ends {word[:depth]!r}")
                if depth < size:
                    states.append(state)
                    last.append(token)
                    begins.append(begin)
            tokens = [token]
            while begin:
                tokens.append(last[begin])
                begin = begins[begin]
            out[word] = tuple(tokens[::-1])
            before = word
        if len(follows) > 4 * self.cache_words:
            follows.clear()
        return out

    # --- texts ------------------------------------------------------------------------

    def _normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # no final sigma

    def _pieces(self, chunk: str) -> list[int | str]:
        """Ids of special tokens and byte-letter words of a run without white space."""
        if chunk.isascii():
            # most are a word, or a word before one sign
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[:-1].isalpha():
                return [chunk[:-1].lower(), self.letters[ord(chunk[-1])]]
        out: list[int | str] = []
        for section in self.cut_special.split(chunk) if self.cut_special else [chunk]:
            if section in self.special:
                out.append(self.special[section])
            elif section:
                out.extend("".join([self.letters[b] for b in m.encode()]) for m in self.pattern.findall(self._normal(section)) if m)
        return out

    def _learn(self, chunks: set[str]) -> None:
        pieces = {chunk: self._pieces(chunk) for chunk in chunks}
        if len(self.words) > self.cache_words:
            self.words, self.older_words = {}, self.words
        words = {p for found in pieces.values() for p in found if p.__class__ is str} - self.words.keys()
        known = words & self.older_words.keys()
        self.words.update((w, self.older_words[w]) for w in known)
        self.words |= self.encode_words(words - known)
        known = self.words
        for chunk, found in pieces.items():
            if len(found) == 1:
                first = found[0]
                self.cache[chunk] = (first,) if first.__class__ is int else known[first]
            else:
                self.cache[chunk] = tuple(chain.from_iterable((p,) if p.__class__ is int else known[p] for p in found))

    def encode(self, texts: Iterable[str | None]) -> pa.ListArray:
        flat, ends, group, held = [], [0], [], 0
        for text in texts:
            text = text or ""
            group.append(_SPACE.split(text) if any(c in text for c in _NOT_SPACE) else text.split())
            held += len(group[-1])
            if held >= 100_000:
                self._encode_group(group, flat, ends)
                group, held = [], 0
        self._encode_group(group, flat, ends)
        values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))

    def _encode_group(self, group: list[list[str]], flat: list[np.ndarray], ends: list[int]) -> None:
        """One trie for all words of some texts that are not in the cache yet."""
        if len(self.cache) > self.cache_words:
            self.cache, self.older = {}, self.cache
        unknown = set(chain.from_iterable(group)) - self.cache.keys()
        known = unknown & self.older.keys()
        self.cache.update((chunk, self.older[chunk]) for chunk in known)
        self._learn(unknown - known)
        for chunks in group:
            ids = np.fromiter(chain.from_iterable(map(self.cache.__getitem__, chunks)), np.int32)
            flat.append(ids)
            ends.append(ends[-1] + len(ids))


class Decoder:
    """Tokens by id."""

    def __init__(self, spec: dict):
        ids = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
        names = [""] * (1 + max(ids.values()))
        for token, i in ids.items():
            names[i] = token
        self.names = pa.array(names, pa.large_string())

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Tokens joined by spaces, as a tokenizer without a decoder gives them."""
        tokens = self.names.take(ids.values)
        return pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), tokens), pa.scalar(" ", pa.large_string()))


_LOADED: dict[tuple, object] = {}


def _loaded(holder: _Holder, make):
    """One encoder or decoder a worker, so that its words serve the next tasks too."""
    key = (make, holder.id)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = make(json.loads(holder.value))
    return _LOADED[key]


class _Holder:
    """A broadcast tokenizer file; the vocabulary bounds its size."""

    def __init__(self, df: DataFrame, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.broadcast = df.sparkSession.sparkContext.broadcast(text)
        self.id = hash(text)

    @property
    def value(self) -> str:
        return self.broadcast.value


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of every whole text in ``ids``.

    ``tokenizer`` is the path of a word-end BPE file in the JSON form of the tokenizers
    library, read by the driver.  Special tokens in a text are taken as such, none are
    added; nothing is cut or padded.  A null or blank text has no ids.  No shuffle: the
    words of a text are looked up among those its worker has met, and only new ones go
    through the trie; at ``cache_words`` words a worker starts anew.  Other columns stay as
    they are; one already named ``ids`` is replaced.
    """
    return _mapped(docs, tokenizer, text, ids, "array<int>", WordBpe, lambda bpe, column: bpe.encode(t.as_py() for t in column))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids`` (null: empty): their tokens joined by one space, special ones included."""
    return _mapped(df, tokenizer, ids, text, "string", Decoder, lambda names, column: names.decode(_whole(column)))


def _whole(ids: pa.Array) -> pa.ListArray:
    """Without nulls and not a slice of a longer array."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))]), pa.int32()), ids.flatten())


def _mapped(df: DataFrame, tokenizer: str, source: str, target: str, kind: str, make, work) -> DataFrame:
    shaped = df.withColumn(target, F.lit(None).cast(kind)) if target != source else df
    source_at, target_at = shaped.columns.index(source), shaped.columns.index(target)
    holder = _Holder(df, tokenizer)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = list(batch.columns)
            arrays[target_at] = work(_loaded(holder, make), arrays[source_at]).cast(batch.schema.field(target_at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return shaped.mapInArrow(apply, shaped.schema)
