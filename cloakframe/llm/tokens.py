"""Whole-text encoding with a table of the words met so far.

The tokenizer that the queries use drops white space, so a text's ids are those of its
white-space-delimited words in order. Most words recur; a worker keeps the ids of up to
`limit` different ones and asks the tokenizer only for new ones. The result equals an
encode() of the whole text. Beyond the limit a table forgets its rarest words, so a
worker's memory has a fixed bound.

Whether a tokenizer is of this kind is tried on probe texts when it is loaded. With any
other one (such as a byte-level one, whose ids hold white space), whole texts are encoded
and no table is kept.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_buffers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
END_ID = 1


_PUNCTUATION = b".,;:!?#*$%&)]}\""  # without quotes and brackets that contractions and special tokens have


def _ends_in_letter(word: bytes) -> bool:
    """Whether the last character is a letter up to U+024F that lower-casing leaves one letter."""
    if word[-1] < 128:
        return 97 <= word[-1] | 32 <= 122
    return 0xC3 <= word[-2] <= 0xC9 and word[-2:].decode("utf-8").lower().isalpha()


_PROBES = (
    "Hello world.  Foo\n\tbar",
    " lead",
    "trail \n",
    "don't we'll it's",
    "x  <|endoftext|> y",
    "1 000 2.5",
    "é ñandú über",
    "a\x0bb\x0cc\r\nd",
    "中文 字 , ; !",
    "snake_case CamelCase",
    "( ) \" ' a-b",
    "\U0001F600 end",
)
_MARKED = ("word.", "word,", "word;:", "word!?", "word###", "word)]}", 'word"', "word...!!", "né%%", "über&*$")


class _Index(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def _own_buffers(column: pa.Array) -> pa.Array:
    """A string column whose first offset is 0, as kernels that change letters need it; null is empty."""
    data, offsets = text_buffers(column)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data))


def _byte_strings(column: pa.Array) -> list[bytes]:
    """The values of a large_binary column without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset).tolist() if len(column) else [0]
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


class WordEncoder:
    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a run of letters
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        plain = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.lowers = plain("Ab") == plain("ab")
        self.by_word = all(plain(t) == [i for w in t.encode("utf-8").split() for i in plain(w.decode("utf-8"))] for t in _PROBES)
        self.by_mark = all(
            plain(t) == plain(c := t.encode("utf-8").rstrip(_PUNCTUATION).decode("utf-8")) + plain(t[len(c) :])
            for t in _MARKED
        )
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.n_ids = 0
        self.starts, self.lens, self.seen = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.pool = np.zeros(1 << 16, np.uint32)

    def _forget(self) -> None:
        """Keep the words met most often, half of the limit at most."""
        n = len(self.index)
        seen, least = self.seen[:n], 1
        while np.count_nonzero(seen >= least) > self.limit // 2:
            least *= 2
        keep = np.flatnonzero(seen >= least)
        words, starts, lens = list(self.index), self.starts[keep], self.lens[keep]
        ends = np.cumsum(lens)
        pool = self.pool[np.repeat(starts - (ends - lens), lens) + np.arange(int(lens.sum()))]
        self.clear()
        self.index.update(zip([words[i] for i in keep.tolist()], range(len(keep)), strict=True))
        self.n_ids, self.pool = len(pool), np.concatenate([pool, np.zeros(1 << 16, np.uint32)])
        self.starts, self.lens, self.seen = (
            np.concatenate([x, np.zeros(1 << 14, np.int64)])
            for x in (ends - lens, lens, np.ones(len(keep), np.int64))
        )

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and their numbers. Words of letters alone share one call, as each ends with a closing id."""
        plain = [w.isalpha() and (w.isascii() or w.lower().isalpha()) for w in words]
        lens = np.zeros(len(words), np.int64)
        at = np.array(plain, bool)
        letters = [w for w, p in zip(words, plain, strict=True) if p]
        joined = np.array(
            self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids,
            np.uint32,
        ) if letters else np.zeros(0, np.uint32)
        ends = np.flatnonzero(self.closes[joined]) + 1
        if len(ends) != len(letters) or len(ends) and ends[-1] != len(joined):
            at[:], letters, joined, ends = False, [], joined[:0], ends[:0]
        lens[at] = np.diff(ends, prepend=0)
        rest = [w for w, p in zip(words, at, strict=True) if not p]
        other = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)] if rest else []
        lens[~at] = [len(x) for x in other]
        out = np.zeros(int(lens.sum()), np.uint32)
        own = np.repeat(at, lens)
        out[own] = joined
        out[~own] = np.fromiter(chain.from_iterable(other), np.uint32, int((~own).sum()))
        return out, lens

    def _add(self) -> None:
        """Encode the words that were new."""
        new, self.index.new = self.index.new, []
        first = len(self.index) - len(new)
        # A word that ends with marks after a letter is the word and the marks: most such words are known without them.
        for a in range(0, len(new), 20_000):
            words, k = new[a : a + 20_000], first + a
            # ~j: part j of those to encode; a word from an earlier turn has its number, and isn't encoded again.
            of, number = [], {}
            for w in words:
                core = w.rstrip(_PUNCTUATION)
                if self.by_mark and core and core != w and _ends_in_letter(core):
                    at = self.index.get(core, k)
                    of.append(at if at < k else ~number.setdefault(core, len(number)))
                    of.append(~number.setdefault(w[len(core) :], len(number)))
                else:
                    of.append(~number.setdefault(w, len(number)))
                    of.append(~number.setdefault(b"", len(number)))
            ids, lens = self._ids([w.decode("utf-8") for w in number])
            of = np.array(of, np.int64)
            fresh, of = of < 0, np.where(of < 0, ~of, of)
            starts = np.where(fresh, (np.cumsum(lens) - lens + self.n_ids)[np.where(fresh, of, 0)], self.starts[np.where(fresh, 0, of)])
            n = np.where(fresh, lens[np.where(fresh, of, 0)], self.lens[np.where(fresh, 0, of)])
            total = int(n.sum())
            while k + len(words) > len(self.starts):
                self.starts, self.lens, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens, self.seen))
            while self.n_ids + max(total, len(ids)) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.n_ids : self.n_ids + len(ids)] = ids  # for the next line alone
            ids = self.pool[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(total)]
            n = n[::2] + n[1::2]
            self.starts[k : k + len(words)] = self.n_ids + np.cumsum(n) - n
            self.lens[k : k + len(words)] = n
            self.pool[self.n_ids : self.n_ids + total] = ids
            self.n_ids += total

    def _words(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words, one text after another, and how many each text has (one, the empty word, where it has none).

        Where the tokenizer lowers letters and no special token can be in the text, they are lowered here.
        """
        if len(self.index) > self.limit:
            self._forget()
        column = _own_buffers(texts) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()).fill_null("")
        if self.lowers:
            special, low = pc.match_substring(column, "<|"), pc.ascii_lower(column)
            column = pc.if_else(special, column, low) if special.true_count else low
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(column))
        per_text = np.diff(split.offsets.to_numpy()).astype(np.int64)
        words = split.flatten().cast(pa.large_binary()).dictionary_encode()
        here = words.indices.to_numpy()
        different = _byte_strings(words.dictionary)
        numbers = np.fromiter(map(self.index.__getitem__, different), np.int64, len(different))
        if self.index.new:
            self._add()
        self.seen[numbers] += np.bincount(here, minlength=len(numbers))
        return numbers.take(here), per_text

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text; null is empty."""
        return self.encode_with_heads(texts, None)[:2]

    def encode_with_heads(
        self,
        texts: list[str | None] | pa.Array,
        heads: list[str | None] | None,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """encode(), and how many of each text's ids are those of its head, the text that it begins with. A word in which the head ends counts whole."""
        if not self.by_word:
            own = [
                e.ids
                for e in self.tokenizer.encode_batch_fast(
                    [t or "" for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)],
                    add_special_tokens=False,
                )
            ]
            lens = np.fromiter(map(len, own), np.int64, len(own))
            ids = np.fromiter(chain.from_iterable(own), np.uint32, int(lens.sum()))
            return ids, lens, np.minimum(lens, self.encode(heads)[1]) if heads else np.zeros_like(lens)
        at, per_text = self._words(texts)
        n = self.lens.take(at)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total)
        where += np.repeat(self.starts.take(at) - (ends - n), n)
        ids = self.pool.take(where)
        ends, past = np.concatenate([[0], ends]), np.cumsum(per_text)
        lens = np.diff(ends[np.concatenate([[0], past])])
        if not heads:
            return ids, lens, np.zeros_like(lens)
        words = np.fromiter((len(h.encode("utf-8").split()) if h else 0 for h in heads), np.int64, len(heads))
        first = past - per_text
        return ids, lens, ends[first + np.minimum(words, per_text)] - ends[first]

    def counts(self, texts: list[str | None] | pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        if not self.by_word:
            return self.encode(texts)[1]
        at, per_text = self._words(texts)
        total = np.concatenate([[0], np.cumsum(self.lens.take(at))])
        return np.diff(total[np.concatenate([[0], np.cumsum(per_text)])])


def groups_of(texts: list[str | None] | pa.Array, most: int = 2 << 20):
    """Runs (start, end) of texts of about `most` characters, or bytes of a column."""
    lens = pc.binary_length(texts.fill_null("")).to_pylist() if isinstance(texts, pa.Array) else [len(t or "") for t in texts]
    a, size = 0, 0
    for i, n in enumerate(lens):
        size += n
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(lens):
        yield a, len(lens)


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder_of(path: str, limit: int = 1_000_000) -> WordEncoder:
    """This worker's encoder, whose table lasts from task to task. A million words take about 120 MB."""
    if (path, limit) not in _encoders:
        _encoders.clear()
        _encoders[path, limit] = WordEncoder(path, limit)
    return _encoders[path, limit]
