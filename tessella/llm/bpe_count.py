"""Token counts by the whole-token shortcut, and the encoding that the id writer uses.

A byte-level BPE tokenizer first cuts a text into pre-tokens and then merges inside each of them. Which vocabulary strings
encode alone as exactly one token is proved once, on the driver, by encoding every one of them. A pre-token in that set
counts 1 without any merging; only the rest goes to the library, once per distinct string.

A space between two characters that aren't white space always starts a pre-token, so a text may be cut there, and the
count of a text is the sum over its pieces. Pieces that recur are remembered in a map of bounded size.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import texts

SAFE = re.compile(r"(?<=\S) (?=\S)")
#: White space other than space and line feed; a text with any of it is cut by the pattern.
RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: After letters, each of these is a pre-token of its own at the end of a piece.
ENDS = frozenset(".,;:!?")
#: Pieces a worker remembers; about 200 bytes each.
REMEMBERED = 600_000
#: By how many ids there are.
PACK = {n: struct.Struct(f"<{n}I").pack for n in range(64)}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def pieces(text: str) -> list[str]:
    """Cuts a text at spaces that surely start a pre-token; all pieces but the first have lost that space."""
    return text.split(" ") if cut_at_spaces(text) else SAFE.split(text)


def cut_at_spaces(text: str) -> bool:
    """Whether every space of a text surely starts a pre-token."""
    return not ("  " in text or " \n" in text or "\n " in text or any(c in text for c in RARE))


class Memo:
    """What a function of a piece returns, for the pieces seen last. ``many`` maps strings and what precedes them to values."""

    def __init__(self, many: Callable[[list[str], str], list], limit: int = REMEMBERED) -> None:
        self.many, self.limit = many, limit
        self.first: dict[str, object] = {}
        self.rest: dict[str, object] = {}

    def learn(self, lists: list[list[str]]) -> None:
        self._bound()
        heads = {x[0] for x in lists}.difference(self.first)  # looks each up; a difference of key views would walk the map
        new = set().union(*lists).difference(self.rest)
        for where, keys, lead in ((self.first, list(heads), ""), (self.rest, list(new), " ")):
            if keys:
                where.update(zip(keys, self.many(keys, lead), strict=True))

    def _bound(self) -> None:
        if len(self.rest) > self.limit:
            self.rest.clear()
        if len(self.first) > self.limit:
            self.first.clear()

    def joined(self, ts: list[str]) -> list[bytes]:
        """The values (bytes) of each text's pieces, joined.

        Arrow cuts the texts, numbers their distinct pieces and puts the values in place, so that Python meets each piece once a batch.
        """
        out = [b""] * len(ts)
        even = [i for i, t in enumerate(ts) if cut_at_spaces(t)]
        if even:
            self._bound()
            cut = pc.split_pattern(pa.array([ts[i] for i in even], pa.large_string()), " ")
            flat, at = cut.flatten(), cut.offsets.to_numpy()
            heads = flat.take(cut.offsets[:-1]).to_pylist()
            new = list(set(heads).difference(self.first))
            self.first.update(zip(new, self.many(new, ""), strict=True))
            coded = flat.dictionary_encode()
            distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes nine times as long
            values = list(map(self.rest.get, distinct))
            if None in values:
                new = [k for k, v in zip(distinct, values, strict=True) if v is None]
                learned = self.many(new, " ")
                self.rest.update(zip(new, learned, strict=True))
                take = iter(learned)
                values = [next(take) if v is None else v for v in values]
            placed = pa.array(values, pa.large_binary()).take(coded.indices)
            raw, ends = memoryview(placed.buffers()[2] or b""), np.frombuffer(placed.buffers()[1], "i8")[placed.offset :]
            for i, head, a, b in zip(even, heads, ends[at[:-1] + 1].tolist(), ends[at[1:]].tolist(), strict=True):
                out[i] = self.first[head] + raw[a:b]
        if len(even) < len(ts):
            odd = sorted(set(range(len(ts))).difference(even))
            lists = [pieces(ts[i]) for i in odd]
            self.learn(lists)
            for i, x in zip(odd, lists, strict=True):
                out[i] = b"".join([self.first[x[0]], *map(self.rest.__getitem__, x[1:])])
        return out


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that are one pre-token and encode alone as exactly their own id."""
    t = load(path)
    listed = t.get_vocab()
    named = {i: t.decode([i], skip_special_tokens=False) for i in listed.values()}
    special = {x.content for x in t.get_added_tokens_decoder().values()}
    tried = [(i, s) for i, s in named.items() if s and "�" not in s and s not in special]
    found = t.encode_batch([s for _, s in tried], add_special_tokens=False)
    return frozenset(s for (i, s), e in zip(tried, found, strict=True) if e.ids == [i] and len(t.pre_tokenizer.pre_tokenize_str(s)) == 1)


_COUNTERS: dict[tuple, Memo] = {}


def counter(path: str, whole: frozenset[str], limit: int = REMEMBERED) -> Memo:
    """A worker's counter: pre-tokens in ``whole`` count 1, the others are merged by the library, each once."""
    if found := _COUNTERS.get((path, limit)):
        return found
    import public_tokenizers
    import regex

    t = load(path)
    merge = merger(t)
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    cut = regex.compile(public_tokenizers.PATTERN).findall
    merged: dict[str, int] = {}

    def one(p: str) -> int:
        if p in whole:
            return 1
        k = merged.get(p)
        if k is None:
            k = merged[p] = len(merge(p))
        return k

    def many(strings: list[str], lead: str) -> list[int]:
        if len(merged) > limit:
            merged.clear()
        out = []
        for s in strings:
            if s.isalpha():  # one pre-token
                out.append(one(lead + s))
            elif s[:-1].isalpha() and s[-1] in ENDS:  # two
                out.append(one(lead + s[:-1]) + one(s[-1]))
            elif special and any(x in s for x in special):
                out.append(len(t.encode(lead + s, add_special_tokens=False).ids))
            else:
                out.append(sum(map(one, cut(lead + s))))
        return out

    return _COUNTERS.setdefault((path, limit), Memo(many, limit))


def merger(t) -> Callable[[str], list]:
    """The library's merges on one pre-token: its bytes are spelled as the byte-level alphabet does, then go to the model."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    alphabet = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}
    tokenize = t.model.tokenize
    return lambda p: tokenize(p.encode().decode("latin-1").translate(alphabet))


def piece_encoder(path: str, limit: int) -> Callable[[list[str]], list[bytes]]:
    """Ids of many pieces, as unsigned 32-bit little-endian: pre-tokens by the library's model, each remembered.

    A piece with a special string in it goes through the library as a whole.
    """
    import public_tokenizers
    import regex

    t = load(path)
    merge = merger(t)
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    cut = regex.compile(public_tokenizers.PATTERN).findall
    tokenize, known = t.model.tokenize, PACK.get
    merged: dict[str, bytes] = {}

    def packed(ids: list[int]) -> bytes:
        pack = known(len(ids))
        return pack(*ids) if pack else struct.pack(f"<{len(ids)}I", *ids)

    def one(p: str) -> bytes:
        b = merged.get(p)
        if b is None:
            b = merged[p] = packed([x.id for x in merge(p)])
        return b

    def many(strings: list[str], lead: str) -> list[bytes]:
        if len(merged) > limit:
            merged.clear()
        out = []
        spelled = {"": "", " ": "Ġ"}.get(lead)
        for s in strings:
            if s.isalpha():  # one pre-token
                b = merged.get(p := lead + s)
                if b is None:
                    # ASCII letters are spelled as they are; most new pieces are such words
                    ids = [x.id for x in (tokenize(spelled + s) if spelled is not None and s.isascii() else merge(p))]
                    pack = known(len(ids))
                    b = merged[p] = pack(*ids) if pack else packed(ids)
                out.append(b)
            elif s[-1:] in ENDS and s[:-1].isalpha():  # two
                out.append(one(lead + s[:-1]) + one(s[-1]))
            elif special and any(x in s for x in special):
                out.append(packed(t.encode(lead + s, add_special_tokens=False).ids))
            else:
                out.append(b"".join(map(one, cut(lead + s))))
        return out

    return many


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row's whole text, equal to the library's own count.

    Null or empty text: 0 bytes, 0 tokens. Repeated rows give repeated rows; other columns are ignored. Special strings in a
    text are handled as the library does by default. One narrow pass, no shuffle.
    """
    path = path or tokenizer_path()
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # at most the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = counter(path, whole.value, remembered)
        for ids, ts in texts(batches, "doc_id", "text"):
            lists = [pieces(t) for t in ts]
            memo.learn(lists)
            n = [memo.first[x[0]] + sum(map(memo.rest.__getitem__, x[1:])) for x in lists]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(t.encode()) for t in ts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
