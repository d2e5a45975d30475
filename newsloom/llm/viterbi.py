"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over a text once. It keeps the best way to reach each of the last boundaries, as many as the longest
piece has characters, and a backpointer for each. Whenever all boundaries that can still be built upon lead back to one
boundary, the ids up to it are final and are given out; what lies before is dropped. Memory follows the longest stretch
without such a boundary, not the text.

Unigram models add up the scores of their pieces. In BPE models a score is a merge's rank, and a sum of ranks means
nothing: there a path is admissible if each piece and the one before it stay apart when merged by themselves. Exactly one
path to each boundary is, and it is what merging the whole text gives. New words of up to ``WORD`` characters are searched
together by ``word_search``, as no piece reaches over the beginning of a word.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrays import batches_of
from newsloom.llm.shared import free_name, map_arrow
from newsloom.llm.word_search import WordSearch

SPACE = "▁"
#: Marks and what stands behind them up to the next mark.
_MARKED = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Texts whose words aren't simply what stands between spaces.
_UNEVEN = f"^ | $|  |{SPACE}"
#: Entries of a worker's caches; they are emptied when full.
CACHE = 600_000
#: Characters of the longest words that are kept, and searched together.
WORD = 64
#: Bytes of text that are cut into words at a time; a longer text stands alone.
SLICE = 1 << 22


class _Words(dict):
    """Ids of the words met so far; a new word is encoded when it is asked for."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self._encode = encode

    def __missing__(self, word: str) -> bytes:
        return self._encode(word)


class Pieces:
    """The vocabulary of a model file, and the search over it."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
        byte_ids = [i for i in range(size) if model.is_byte(i)]
        self.texts = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {i: int(self.texts[i][3:-1], 16) for i in byte_ids}
        self.byte_ids = [0] * 256
        for i, b in self.bytes.items():
            self.byte_ids[b] = i
        self.fallback = len(byte_ids) == 256
        self.unknown = model.unk_id()
        self.control = {i for i in special if i != self.unknown}
        hidden = {*special, *byte_ids}
        self.ids = {t: i for i, t in enumerate(self.texts) if i not in hidden}
        self.scores = [model.get_score(i) for i in range(size)]
        self.longest = max(map(len, self.ids), default=1)
        self.least = min((self.scores[i] for i in self.ids.values()), default=0.0)
        # Scores of BPE models are whole and fall with the rank; those of unigram models are logarithms.
        found = [self.scores[i] for i in self.ids.values()]
        self.merging = all(s == int(s) for s in found) and len(set(found)) > 1
        self._apart: dict[tuple[str, str], bool] = {}
        self._words = _Words(self._word)
        self._search_words: WordSearch | None = None
        self._plain: tuple[pa.Array, np.ndarray] | None = None
        self._halves: dict[str, tuple[str, str] | None] = {}
        # No merge reaches into a word's mark if no piece holds one behind another character.
        self.by_word = self.merging and not any(SPACE in t.lstrip(SPACE) for t in self.ids)
        self._odd = {*self.bytes, *self.control, self.unknown}
        #: Pieces that a path may hold, and their lengths by their last three characters, longest first.
        self.usable = {t: i for t, i in self.ids.items() if not self.merging or self.halves(t) is not None}
        self.lengths = self._lengths()
        self.joined = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}

    def _lengths(self) -> dict[str, tuple[int, ...]]:
        found: dict[str, set[int]] = {}
        for text in self.usable:
            if len(text) > 2:
                found.setdefault(text[-3:], {1, 2}).add(len(text))
        return {end: tuple(sorted(lengths, reverse=True)) for end, lengths in found.items()}

    def rank(self, piece: str) -> float:
        """When merging forms a piece: characters are there from the beginning, better scores come earlier."""
        return -1.0 if len(piece) == 1 else -self.scores[self.ids[piece]]

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merge neighbours whose union is a piece, best rank first, leftmost among equals; and the last merge."""
        parts, last = list(text), None
        while True:
            best, place = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, place = self.scores[found], i
            if best is None:
                return parts, last
            last = (parts[place], parts[place + 1])
            parts[place : place + 2] = [parts[place] + parts[place + 1]]

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge gives a piece; the same twice for a character; None if merging never gives it."""
        if piece not in self._halves:
            parts, last = self.merge(piece)
            known = (piece, piece) if len(piece) == 1 else last if parts == [piece] else None
            self._halves[piece] = known  # one entry for each piece or character
        return self._halves[piece]

    def apart(self, left: str, right: str) -> bool:
        """Whether merging keeps the boundary between two pieces.

        Time is wound back: of the two pieces at the boundary the one that was formed later is split again. If the two
        that then meet could merge, and earlier than the merge just undone, the boundary would not have lasted. Among
        equal ranks the leftmost merge comes first.
        """
        key = (left, right)
        known = self._apart.get(key)
        if known is not None:
            return known
        limit, at_right = float("inf"), False
        known = True
        while True:
            union = self.ids.get(left + right)
            if union is not None:
                rank = -self.scores[union]
                if rank < limit or (at_right and rank == limit):
                    known = False
                    break
            a, b = self.rank(left), self.rank(right)
            if a == b == -1.0:
                break
            if a > b:
                limit, at_right, left = a, False, self.halves(left)[1]
            else:
                limit, at_right, right = b, True, self.halves(right)[0]
        if len(self._apart) > CACHE:
            self._apart.clear()
        self._apart[key] = known
        return known

    def search(self, text: str) -> Iterator[tuple[int, int]]:
        """(begin, end) of the pieces of a marked text, given out as soon as they are final."""
        n, w = len(text), self.longest
        usable, lengths, short, merging, known_apart = self.usable, self.lengths, (2, 1), self.merging, self._apart
        # For each boundary of the window the one before it, and, where scores count, the score of the way to it.
        back: dict[int, int] = {0: -1}
        score: dict[int, float] = {0: 0.0}
        committed = 0
        for end in range(1, n + 1):
            best = None
            for length in lengths.get(text[end - 3 : end], short) if end > 2 else short:
                begin = end - length
                if begin < committed or begin not in back:
                    continue
                piece = text[begin:end]
                if length > 1 and piece not in usable:
                    continue
                if not merging:
                    reached = score[begin] + (self.scores[usable[piece]] if piece in usable else self.least - 10.0)
                    if best is None or reached > best:
                        best = score[end] = reached
                        back[end] = begin
                    continue
                if begin:
                    left = text[back[begin] : begin]
                    apart = known_apart.get((left, piece))
                    if not (self.apart(left, piece) if apart is None else apart):
                        continue
                back[end] = begin
                break  # no other path to this boundary is admissible
            if end < n and (end - committed) % w:
                continue
            # Where do all boundaries lead that later pieces can begin at?
            heads = {b for b in range(max(committed, end - w + 1), end + 1) if b in back} if end < n else {n}
            while len(heads) > 1:
                top = max(heads)
                heads.remove(top)
                heads.add(back[top] if top > committed else committed)
                if top == committed:
                    heads = {committed}
            root = heads.pop()
            if root == committed:
                continue
            trail, at = [], root
            while at > committed:
                trail.append((back[at], at))
                at = back[at]
            yield from reversed(trail)
            if root < n:
                back = {b: a for b, a in back.items() if b >= root}
                if not merging:
                    score = {b: s - score[root] for b, s in score.items() if b >= root}
            committed = root

    def _ids_of(self, piece: str) -> list[int]:
        known = self.ids.get(piece)
        if known is not None:
            return [known]
        return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")] if self.fallback else [self.unknown]

    def _search_ids(self, marked: str) -> bytes:
        return array("i", [i for a, b in self.search(marked) for i in self._ids_of(marked[a:b])]).tobytes()

    def _short_ids(self, part: str) -> bytes:
        """``_search_ids`` of a part no longer than the window, where merging decides: nothing is to be committed before its end."""
        n = len(part)
        usable, lengths, short, known_apart = self.usable, self.lengths, (2, 1), self._apart
        back = [-1] * (n + 1)
        back[0] = 0
        for end in range(1, n + 1):
            for length in lengths.get(part[end - 3 : end], short) if end > 2 else short:
                begin = end - length
                if begin < 0 or back[begin] < 0:
                    continue
                piece = part[begin:end]
                if length > 1 and piece not in usable:
                    continue
                if begin:
                    left = part[back[begin] : begin]
                    apart = known_apart.get((left, piece))
                    if not (self.apart(left, piece) if apart is None else apart):
                        continue
                back[end] = begin
                break  # no other path to this boundary is admissible
        ids, end, known = [], n, self.ids
        while end:
            piece = part[back[end] : end]
            i = known.get(piece)
            if i is None:
                ids.extend(reversed(self._ids_of(piece)))
            else:
                ids.append(i)
            end = back[end]
        ids.reverse()
        return array("i", ids).tobytes()

    def _part_ids(self, part: str) -> bytes:
        return self._short_ids(part) if self.merging and len(part) <= self.longest else self._search_ids(part)

    def _word(self, word: str) -> bytes:
        """Ids of a word after its mark, for one that wasn't met before."""
        parts = self._cut(SPACE + word)
        ids = self._part_ids(parts[0]) if len(parts) == 1 else b"".join([self._part(p) for p in parts])
        self._keep(word, ids)
        return ids

    def _part(self, part: str) -> bytes:
        """Ids of a part of a word; the first one begins with the mark and is kept under the word without it, others behind a space."""
        key = part[1:] if part[0] == SPACE else " " + part
        ids = self._words.get(key)
        if ids is None:
            ids = self._part_ids(part)
            self._keep(key, ids)
        return ids

    def _keep(self, key: str, ids: bytes) -> None:
        if len(key) <= WORD:
            if len(self._words) > CACHE:
                self._words.clear()
            self._words[key] = ids

    def _cut(self, word: str) -> list[str]:
        """Parts of a word between characters that stand side by side in no piece: no path has a piece over these."""
        joined = self.joined
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joined]
        if not cuts:
            return [word]
        return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)])]

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers: spaces become marks, and one stands before the text. Empty for no text."""
        if not text:
            return b""
        if not self.by_word:
            return self._search_ids(SPACE + text.replace(" ", SPACE))
        return b"".join(map(self._words.__getitem__, self._split(text)))

    def _split(self, text: str) -> list[str]:
        """Words of a text without the mark before each; further marks stay, and mark and word together are the text."""
        if text[0] != " " and text[-1] != " " and "  " not in text and SPACE not in text:
            return text.split(" ")
        return [marked[1:] for marked in _MARKED.findall(SPACE + text.replace(" ", SPACE))]

    def _made(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; those not met before are searched together."""
        made = list(map(self._words.get, words))
        new = [i for i, ids in enumerate(made) if ids is None]
        if self._search_words is None:
            self._search_words = WordSearch(self.ids, self.usable, self.scores, self.halves, self._ids_of, SPACE)
        found = self._search_words.search([words[i] for i in new if len(words[i]) <= WORD])
        for i in new:
            made[i] = found[words[i]] if words[i] in found else self._word(words[i])
        if len(self._words) + len(found) > CACHE:
            self._words.clear()
        self._words.update(found)
        return made

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """Lists of the ids of texts; null for null."""
        null = pa.array(texts.is_null().to_numpy(zero_copy_only=False))
        if not self.by_word:
            made = [self.encode_bytes(t or "") for t in texts.to_pylist()]
            return _lists(made, null)
        some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        kept = texts.filter(some)
        uneven = pc.match_substring_regex(kept, _UNEVEN)
        if pc.any(uneven).as_py():
            split = [" ".join(self._split(t)) for t in kept.filter(uneven).to_pylist()]
            kept = pc.replace_with_mask(kept, uneven, pa.array(split, kept.type))
        words = pc.split_pattern(kept, " ")
        distinct = words.values.dictionary_encode()
        ids = _lists(self._made(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())).take(distinct.indices)
        n = np.zeros(len(texts), np.int64)
        n[some.to_numpy(zero_copy_only=False)] = np.diff(ids.offsets.take(words.offsets).to_numpy())
        return pa.ListArray.from_arrays(_offsets(n), ids.values, mask=null)

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are joined to characters, marks become spaces, the first of which is not part of it."""
        if self._odd.isdisjoint(ids):
            text = "".join(map(self.texts.__getitem__, ids)).replace(SPACE, " ")
            return text[1:] if text.startswith(" ") else text
        out, held = [], bytearray()
        for i in ids:
            if i in self.bytes:
                held.append(self.bytes[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in self.control:
                out.append(self.texts[i] if i != self.unknown else " ⁇ ")
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def _texts(self) -> tuple[pa.Array, np.ndarray]:
        """The texts of all pieces, once more as they begin a text; and which of them can't be read alone."""
        if self._plain is None:
            odd = np.zeros(len(self.texts), bool)
            odd[[*self.control, self.unknown, *(i for i, b in self.bytes.items() if b > 127)]] = True
            texts = [(chr(self.bytes[i]) if i in self.bytes else t).replace(SPACE, " ") for i, t in enumerate(self.texts)]
            self._plain = pa.array(texts + [t[1:] if t.startswith(" ") else t for t in texts], pa.string()), odd
        return self._plain

    def decode_column(self, ids: pa.Array) -> pa.Array:
        """``decode`` of lists of ids; null for null."""
        plain, odd = self._texts()
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        if not len(flat):
            return pa.array(["" if v else None for v in valid], pa.string())
        n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        alone = odd[flat]
        strange = np.unique(np.searchsorted(bounds, np.flatnonzero(alone), side="right") - 1)
        piece = np.where(alone, 0, flat).astype(np.int64)
        piece[bounds[:-1][n > 0]] += len(odd)
        letters = plain.take(pa.array(piece))
        ends = np.frombuffer(letters.buffers()[1], np.int32)
        buffers = [pa.array(valid).buffers()[1], pa.py_buffer(ends[bounds]), letters.buffers()[2]]
        out = pa.Array.from_buffers(pa.string(), len(ids), buffers)
        if not len(strange):
            return out
        texts = [self.decode(x) for x in ids.take(pa.array(strange)).to_pylist()]
        mask = np.zeros(len(ids), bool)
        mask[strange] = True
        return pc.replace_with_mask(out, pa.array(mask), pa.array(texts, pa.string()))


def _offsets(n: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))


def _lists(made: list[bytes], null: pa.Array | None = None) -> pa.Array:
    """32-bit integers as an array of lists."""
    n = np.fromiter(map(len, made), np.int64, len(made)) // 4
    return pa.ListArray.from_arrays(_offsets(n), pa.array(np.frombuffer(b"".join(made), np.int32)), mask=null)


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One vocabulary per worker and file."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """Add the ids of every whole text; a null text has null ids, an empty one none. The text column is given up.

    Long texts are searched in a window. Another column called like the new one gets an underscore behind its name. An empty
    table gives an empty result.
    """
    kept = [f for f in docs.schema.fields if f.name != text_column]
    names = [f.name for f in kept]
    named = [free_name(c, [ids_column], names) for c in names]
    schema = ", ".join([f"`{new}` {f.dataType.simpleString()}" for new, f in zip(named, kept)] + [f"`{ids_column}` array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for at, to in batches_of(batch.column(len(names)), SLICE):
                part = batch.slice(at, to - at)
                columns = [part.column(i) for i in range(len(names))] + [model.encode_column(part.column(len(names)))]
                yield pa.RecordBatch.from_arrays(columns, [*named, ids_column])

    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_column).cast("string")), run, schema)


def decode(encoded: DataFrame, path: str, ids_column: str = "ids", text_column: str = "text") -> DataFrame:
    """Add the text of every row's ids; null for null. A text's own U+2581 reads back as a space, like any mark.

    A column called like the new one gets an underscore behind its name. An empty table gives an empty result.
    """
    kept = encoded.schema.fields
    names = [f.name for f in kept]
    named = [free_name(c, [text_column], names) for c in names]
    schema = ", ".join([f"`{new}` {f.dataType.simpleString()}" for new, f in zip(named, kept)] + [f"`{text_column}` string"])
    place = names.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                columns = [part.column(i) for i in range(len(names))] + [model.decode_column(part.column(place))]
                yield pa.RecordBatch.from_arrays(columns, [*named, text_column])

    return map_arrow(encoded.select(*[F.col(f"`{c}`") for c in names]), run, schema)
