"""SentencePiece encoding and decoding by an Aho-Corasick automaton over the pieces.

The automaton reads a text once. At every position its output links list the pieces that end there, longest first, and each
relaxes the best result known at its start:

* unigram models: the best sum of scores (Viterbi); a character no piece covers costs the smallest score less 10.
* BPE models: scores there are merge priorities, and their best sum is not what merging gives. But merging has exactly one
  result for every prefix, and a sequence is that result if and only if every neighbouring pair alone merges to itself. So
  the piece to keep at a position is the first whose start has a result with a compatible last piece; pair answers are
  remembered. This is exact, still one pass, and tested against the library on whole tables.

A text is cut before each mark of a space that follows another character: no piece has that mark inside, so nothing spans
the cut. For BPE models a new word is also cut between neighbours that stand together in no piece, as no merge spans them
either: words that differ in their marks share the rest. Parts seen before are remembered in a map of bounded size. Characters without a piece become their UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import remembered, texts

SPACE = "▁"
CUT = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words a worker remembers, and half as many pairs: some 270 MB, as workers outlive a task.
REMEMBERED = 1_000_000
NEVER = float("inf")
#: Longer texts are merged with a heap instead of a scan for each merge.
SHORT = 64


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    i, n = 0, len(raw)

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            x = raw[i]
            i += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value

    while i < n:
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[i : i + size]
            i += size


class PieceModel:
    """Pieces, scores and kinds from a .model file; ``encode`` one part, ``encode_text`` and ``decode`` whole texts."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        import sentencepiece

        self.normalize = sentencepiece.SentencePieceProcessor(model_file=path).normalize
        listed, self.bpe, self.prefix = [], False, True
        with open(path, "rb") as f:
            for key, value in fields(f.read()):
                if key == 1:
                    d = dict(fields(value))
                    listed.append((d[1].decode(), struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0], d.get(3, NORMAL)))
                elif key == 2:
                    self.bpe = dict(fields(value)).get(3, 1) == 2
                elif key == 3:
                    self.prefix = bool(dict(fields(value)).get(3, 1))
        self._set(listed, remembered)

    @classmethod
    def of(cls, listed: list[tuple[str, float, int]], bpe: bool, remembered: int = REMEMBERED) -> PieceModel:
        """From (piece, score, kind) rows, with identity normalisation."""
        m = cls.__new__(cls)
        m.normalize, m.bpe, m.prefix = (lambda t: (SPACE + t.replace(" ", SPACE)) if t else ""), bpe, True
        m._set(listed, remembered)
        return m

    block = 0

    def _set(self, listed: list[tuple[str, float, int]], remembered: int) -> None:
        self.listed, self.limit = listed, remembered
        self.unk = next((i for i, x in enumerate(listed) if x[2] == UNKNOWN), 0)
        self.bytes_of = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(listed) if k == BYTE}
        self.spelled = [bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for p, _, k in listed]
        self.index = {p: i for i, (p, _, k) in enumerate(listed) if k in (NORMAL, USER)}
        self.score = [s for _, s, _ in listed]
        self.low = min((s for _, s, k in listed if k == NORMAL), default=0.0) - 10
        self.auto = ahocorasick.Automaton()
        for p, i in self.index.items():
            self.auto.add_word(p, (len(p), i))
        self.auto.make_automaton()
        self.pairs: dict[int, bool] = {}  # by left x number of pieces + right
        self.alone: dict[int, bool] = {}
        self.parts: dict[str, bytes] = {}
        order = {p: -self.score[i] for p, i in self.index.items()}
        self.rank = lambda pair: order.get(pair, NEVER)
        self.words: dict[str, bytes] = {}
        self.joined = {p[i : i + 2] for p in self.index for i in range(len(p) - 1)}  # neighbours in some piece
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.index)
        # A leading run of marks gives the longest run piece again and again, if all run pieces have one score and none goes on
        # with another character: merging then fills that piece from the left, and nothing can join it.
        runs = [p for p in self.index if not p.strip(SPACE)]
        k, self.block = max(map(len, runs), default=0), 0
        if k > 1 and len({self.score[self.index[p]] for p in runs}) == 1 and not any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.index):
            if all(self.merge(SPACE * (k + j))[0] == SPACE * k for j in range(2 * k + 1)):
                self.block = k

    def merge(self, text: str) -> list[str]:
        """The merge rule itself: the adjacent pair that makes the piece of best score, leftmost of equals, again and again."""
        s, rank = list(text), self.rank
        if len(s) > SHORT:
            k = self.block
            ready = max(0, (len(text) - len(text.lstrip(SPACE))) // k - 2) if k else 0
            return [SPACE * k] * ready + self._merge_long(s[ready * k :])
        joined = [rank(s[i] + s[i + 1]) for i in range(len(s) - 1)]  # the priority of each neighbouring pair, lower first
        while joined and (best := min(joined)) < NEVER:
            at = joined.index(best)
            s[at : at + 2] = [s[at] + s[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = rank(s[at - 1] + s[at])
            if at < len(joined):
                joined[at] = rank(s[at] + s[at + 1])
        return s

    def _merge_long(self, s: list[str]) -> list[str]:
        """The merge rule with a heap of pairs over a linked list: n log n."""
        n, rank = len(s), self.rank
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(s[i] + s[i + 1])) < NEVER]
        width = [1] * n  # how many of the first symbols stand in one, 0: in another
        heapq.heapify(heap)
        while heap:
            _, i, held = heapq.heappop(heap)
            j = after[i]
            if not size[i] or j >= n or width[i] + width[j] != held:  # one of the two has changed since
                continue
            s[i] += s[j]
            width[i] += width[j]
            size[j] = 0
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := rank(s[i] + s[after[j]])) < NEVER:
                    heapq.heappush(heap, (r, i, width[i] + width[after[j]]))
            if (b := before[i]) >= 0 and (r := rank(s[b] + s[i])) < NEVER:
                heapq.heappush(heap, (r, b, width[b] + width[i]))
        return [x for x, k in zip(s, size, strict=True) if k]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces stand when their joined string is merged; -1: a character of its own."""
        if left < 0 and right < 0:
            return True
        if left < 0 or right < 0:
            i = max(left, right)
            if i not in self.alone:
                p = self.listed[i][0]
                self.alone[i] = self.merge(p) == [p]
            return self.alone[i]
        key = left * len(self.listed) + right
        known = self.pairs.get(key)
        if known is None:
            a, b = self.listed[left][0], self.listed[right][0]
            if len(self.pairs) > self.limit // 2:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(a + b) == [a, b]
        return known

    def encode(self, part: str) -> list[int]:
        """Ids of one part, with -1-c for a character c that no piece covers."""
        n = len(part)
        if self.bpe and SPACE * 2 in part:  # runs of the mark have pieces of equal score: the merge rule's own order decides
            return [self.index.get(p, -1 - ord(p[0])) for p in self.merge(part)]
        if n == 1 or (self.bpe and part in self.index and self.compatible(-1, self.index[part])):
            return [self.index[part]] if part in self.index else [-1 - ord(part)]
        if self.bpe:
            return self._merged(part)
        last: list = [None] * (n + 1)
        size = [1] * (n + 1)
        best = [float("-inf")] * (n + 1)
        best[0] = 0.0
        for at, found in self._ends(part):
            if not found or all(length > 1 for length, _ in found):  # a character of its own is always possible
                best[at], last[at] = best[at - 1] + self.low, -1 - ord(part[at - 1])
            for length, i in found:
                if best[at - length] + self.score[i] > best[at]:
                    best[at], last[at], size[at] = best[at - length] + self.score[i], i, length
        out, at = [], n
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _ends(self, part: str) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """For every position, the pieces that end there (the automaton's output links)."""
        at, found = 1, []
        for end, piece in self.auto.iter(part):
            while at <= end:
                yield at, found
                at, found = at + 1, []
            found.append(piece)
        while at <= len(part):
            yield at, found
            at, found = at + 1, []

    def _merged(self, part: str) -> list[int]:
        n = len(part)
        last: list = [None] * (n + 1)
        size = [1] * (n + 1)
        last[0] = -1
        done, pairs, alone, check, many = 0, self.pairs.get, self.alone.get, self.compatible, len(self.listed)
        for end, (length, i) in self.auto.iter(part):
            at = end + 1
            if last[at] is not None:
                continue
            while done < end:  # no piece ended there: a character of its own
                done += 1
                if last[done] is None:
                    last[done] = -1 - ord(part[done - 1])
            left = last[at - length]
            ok = pairs(left * many + i) if left >= 0 else alone(i)
            if ok is None:
                ok = check(left, i)
            if ok:
                last[at], size[at] = i, length
        while done < n:
            done += 1
            if last[done] is None:
                last[done] = -1 - ord(part[done - 1])
        out, at = [], n
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def pack(self, part: str) -> bytes:
        ids = self.encode(part)
        if min(ids) < 0:
            spelled: list[int] = []
            for i in ids:
                if i >= 0:
                    spelled.append(i)
                elif self.bytes_of:
                    spelled += [self.bytes_of[b] for b in chr(-1 - i).encode()]
                else:
                    spelled.append(self.unk)
            ids = spelled
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) > self.limit // 8:
                self.parts.clear()
            found = self.parts[part] = self.pack(part)
        return found

    def packed_word(self, word: str) -> bytes:
        """As ``packed`` for a mark and the word after it, remembered by the word."""
        if len(self.words) > self.limit:
            self.words.clear()
        part = SPACE + word
        if not self.bpe or word.isalpha():
            found = self.words[word] = self.pack(part)
            return found
        joined = self.joined
        cuts = [i for i, pair in enumerate(map(add, part, word), 1) if pair not in joined]
        if not cuts:
            found = self.pack(part)
        elif cuts[0] == 1:
            found = b"".join([self.packed(part[a:b]) for a, b in zip([0, *cuts], [*cuts, None], strict=True)])
        else:
            head = word[: cuts[0] - 1]  # a word of its own, as likely as not seen before
            known = self.words.get(head)
            if known is None:
                known = self.words[head] = self.pack(SPACE + head)
            found = b"".join([known, *(self.packed(part[a:b]) for a, b in zip(cuts, [*cuts[1:], None], strict=True))])
        self.words[word] = found
        return found

    def encode_text(self, text: str) -> bytes:
        """Ids as unsigned 32-bit little-endian; the empty text has none."""
        t = self.normalize(text) if text else ""
        if not t:
            return b""
        if SPACE * 2 not in t and t[0] == SPACE and t[-1] != SPACE and self.cuts:
            known, packed = self.words.get, self.packed_word
            return b"".join([known(k) or packed(k) for k in t.split(SPACE)[1:]])
        return b"".join(map(self.packed, CUT.split(t) if self.cuts else [t]))

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8, marks as spaces, without the space put before the text."""
        text = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_MODELS: dict[str, PieceModel] = remembered()


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def piece_codes(docs: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """Encodes and decodes every row's whole text: doc_id, n_tokens, ids_crc32, lossless (the decoded ids give the text back).

    The default model is a BPE one, so its pieces are merge results, kept by the compatibility rule above; a unigram model takes
    the Viterbi scores.

    With ``ids`` also the ids themselves. Null text: empty, no ids, lossless. Repeated rows give repeated rows. One narrow
    pass, no shuffle. A text that itself holds the space mark decodes to a space there and so is not lossless.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for ds, ts in texts(batches, "doc_id", "text"):
            codes = [m.encode_text(t) for t in ts]
            cols = {"doc_id": pa.array(ds, pa.int64()), "n_tokens": pa.array([len(c) // 4 for c in codes], pa.int64()), "ids_crc32": pa.array([zlib.crc32(c) for c in codes], pa.int64()), "lossless": pa.array([m.decode(c) == t for c, t in zip(codes, ts, strict=True)], pa.bool_())}
            if ids:
                ends = np.cumsum([0, *(len(c) // 4 for c in codes)]).astype("i4")
                cols["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(codes), "<u4").astype("i4"), pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, lossless boolean" + ", ids array<int>" * ids)
