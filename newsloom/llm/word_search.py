"""The Viterbi search of ``viterbi`` for BPE models, over many words at once.

All words of a call go forward together, one character a step. Pieces are numbers here: which of them end at a character
comes from a trie of reversed pieces, the shorter ones from the longest, and whether two stay apart from a table of pairs
met before. Memory follows ``CELLS``, not the number of words.

Used inside tasks only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Words times characters that are searched at a time.
CELLS = 1 << 18
#: Pairs of pieces that are remembered, as a power of two; a pair gives way to another one with its place.
PAIR_BITS = 20
_MIX = 0x9E3779B97F4A7C15 - (1 << 64)


class WordSearch:
    """The search over a vocabulary: ``ids`` are all pieces, ``usable`` those that merging gives, each with its id."""

    def __init__(
        self,
        ids: dict[str, int],
        usable: dict[str, int],
        scores: list[float],
        halves: Callable[[str], tuple[str, str] | None],
        ids_of: Callable[[str], list[int]],
        mark: str,
    ) -> None:
        self._mark = mark
        self._ids_of = ids_of
        # The vocabulary's characters are pieces, too, even if it has them in longer pieces only.
        letters = {c for t in ids for c in t}
        texts = [*usable, *sorted(letters - usable.keys())]
        number = {t: i for i, t in enumerate(texts)}
        #: What stands before a word, and for any character that no piece has; nothing merges with it.
        self.other = len(texts)
        self.length = np.array([*map(len, texts), 1], np.int32)
        self.rank = np.array([*(-1.0 if len(t) == 1 else -scores[ids[t]] for t in texts), -1.0])
        split = [halves(t) for t in texts]
        self.left = np.array([*(number[a] for a, _ in split), self.other], np.int32)
        self.right = np.array([*(number[b] for _, b in split), self.other], np.int32)
        self.shorter = np.array([*(self._shorter(t, number) for t in texts), -1], np.int32)
        self._set_unions(ids, scores, number)
        self._set_trie(texts, sorted(letters))
        made = [ids_of(t) for t in texts]
        self.n_ids = np.array([*map(len, made), 0], np.int64)
        self.first_id = np.concatenate([[0], np.cumsum(self.n_ids)[:-1]])
        self.all_ids = np.array([i for m in made for i in m], np.int32)
        self._met = np.full(1 << PAIR_BITS, -1, np.int64)

    @staticmethod
    def _shorter(text: str, number: dict[str, int]) -> int:
        """The longest piece that a piece ends with, besides itself; -1 for a character."""
        return next((number[text[i:]] for i in range(1, len(text)) if text[i:] in number), -1)

    def _set_unions(self, ids: dict[str, int], scores: list[float], number: dict[str, int]) -> None:
        """Ranks of the pieces that two others make, by pair."""
        found = {}
        for text, i in ids.items():
            for at in range(1, len(text)):
                a, b = number.get(text[:at]), number.get(text[at:])
                if a is not None and b is not None:
                    found[a * (self.other + 1) + b] = -scores[i]
        keys = sorted(found)
        self._unions = np.array([*keys, np.iinfo(np.int64).max], np.int64)
        self._union_ranks = np.array([*(found[k] for k in keys), np.inf])

    def _set_trie(self, texts: list[str], letters: list[str]) -> None:
        """The trie of reversed pieces: the child of node ``n`` by letter ``c`` is ``base[n] + c`` if ``parent`` there is ``n``."""
        code = {c: i + 1 for i, c in enumerate(letters)}
        #: Letters by code point; 0 for those in no piece.
        self._codes = np.zeros(0x110000, np.int32)
        self._codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for i, text in enumerate(texts):
            node = 0
            for c in reversed(text):
                below = children[node].get(code[c])
                if below is None:
                    below = children[node][code[c]] = len(children)
                    children.append({})
                    piece.append(-1)
                node = below
            piece[node] = i
        width = len(letters) + 1
        size = 1 << (4 * len(children)).bit_length()
        base, parent, found = ([0] * (size + width), [-1] * (size + width), [-1] * (size + width))
        # Nodes with many children take their places first, each wherever all of its children fit.
        place = [0] * len(children)
        parent[0] = 0  # the root's own place is nobody's child
        level, probe = [0], 1
        while level:
            below_level = []
            for node in sorted(level, key=lambda n: -len(children[n])):
                if not children[node]:
                    continue
                while True:
                    probe = (probe * 69069 + 1) % size  # comes by every place once
                    if all(parent[probe + c] < 0 for c in children[node]):
                        break
                base[place[node]] = probe
                for c, child in children[node].items():
                    parent[probe + c] = place[node]
                    found[probe + c] = piece[child]
                    place[child] = probe + c
                    below_level.append(child)
            level = below_level
        parent[0] = -1
        self._base, self._parent, self._piece = (np.array(x, np.int32) for x in (base, parent, found))
        self._depth = max(map(len, texts))

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Pieces.apart`` of many pairs."""
        known = np.ones(len(left), bool)
        limit, at_right, here = np.full(len(left), np.inf), np.zeros(len(left), bool), np.arange(len(left))
        while len(here):
            key = left.astype(np.int64) * (self.other + 1) + right
            at = np.searchsorted(self._unions, key)
            rank = self._union_ranks[at]
            merged = (self._unions[at] == key) & ((rank < limit) | (at_right & (rank == limit)))
            known[here[merged]] = False
            a, b = self.rank[left], self.rank[right]
            go = np.flatnonzero(~merged & ((a != -1) | (b != -1)))
            a, b, left, right, here = a[go], b[go], left[go], right[go], here[go]
            at_right = a <= b
            limit = np.where(at_right, b, a)
            left, right = np.where(at_right, left, self.right[left]), np.where(at_right, self.left[right], right)
        return known

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging keeps the boundary between two pieces, remembered by pair."""
        key = left.astype(np.int64) * (self.other + 1) + right
        place = (key * _MIX >> (64 - PAIR_BITS)) & ((1 << PAIR_BITS) - 1)
        met = self._met[place]
        known = (met & 1).astype(bool)
        new = np.flatnonzero(met >> 1 != key)
        if len(new):
            pairs, which = np.unique(key[new], return_inverse=True)
            found = self._apart((pairs // (self.other + 1)).astype(np.int32), (pairs % (self.other + 1)).astype(np.int32))
            known[new] = found[which]
            self._met[place[new]] = key[new] * 2 + known[new]
        return known

    def _longest(self, letters: np.ndarray) -> np.ndarray:
        """The longest piece that ends at each letter."""
        out = np.full(len(letters), self.other, np.int32)
        here = np.arange(len(letters))
        node = np.zeros(len(letters), np.int32)
        for back in range(self._depth):
            below = self._base[node] + letters[here - back]
            go = np.flatnonzero((self._parent[below] == node) & (here >= back))
            if not len(go):
                break
            here, node = here[go], below[go]
            piece = self._piece[node]
            ends = np.flatnonzero(piece >= 0)
            out[here[ends]] = piece[ends]
        return out

    def search(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words with the mark before each, as 32-bit integers."""
        out: dict[str, bytes] = {}
        words = sorted(words, key=len, reverse=True)
        at = 0
        while at < len(words):
            to = at + max(1, CELLS // (1 + len(words[at])))
            self._search(words[at:to], out)
            at = to
        return out

    def _search(self, words: list[str], out: dict[str, bytes]) -> None:
        """Words by falling length."""
        end = "\n"  # behind each word, so that its letters stand apart from the next one's
        text = f"{self._mark}{(end + self._mark).join(words)}{end}"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begins = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
        letters = self._codes[points]
        letters[begins + lens] = 0
        longest = self._longest(letters)
        # For each boundary of each word the piece before it.
        last = np.full((int(lens[0]) + 1, len(words)), self.other, np.int32)
        for end in range(1, len(last)):
            here = np.arange(np.searchsorted(-lens, -end, side="right"))
            piece = longest[begins[here] + end - 1]
            while len(here):
                fits = self.apart(last[end - self.length[piece], here], piece)
                last[end, here[fits]] = piece[fits]
                rest = np.flatnonzero(~fits)
                here, piece = here[rest], self.shorter[piece[rest]]
        # Each piece of the way back is noted where it begins, so that they lie in order.
        noted = np.full(len(letters), -1, np.int32)
        here, at = np.arange(len(words)), lens
        while len(here):
            piece = last[at, here]
            at = at - self.length[piece]
            noted[begins[here] + at] = piece
            go = np.flatnonzero(at)
            here, at = here[go], at[go]
        places = np.flatnonzero(noted >= 0)
        pieces = noted[places]
        n, first, every = self.n_ids[pieces], self.first_id[pieces], self.all_ids
        others = np.flatnonzero(pieces == self.other)
        if len(others):
            found, which = np.unique(points[places[others]], return_inverse=True)
            made = [self._ids_of(chr(c)) for c in found.tolist()]
            sizes = np.array([len(m) for m in made], np.int64)
            n[others], first[others] = sizes[which], (len(every) + np.cumsum(sizes) - sizes)[which]
            every = np.concatenate([every, np.array([i for m in made for i in m], np.int32)])
        stops = np.concatenate([[0], np.cumsum(n)])
        ids = every[np.repeat(first - stops[:-1], n) + np.arange(stops[-1])]
        cuts = 4 * stops[np.searchsorted(places, np.append(begins, len(letters)))]
        data, cuts = ids.tobytes(), cuts.tolist()
        for word, a, b in zip(words, cuts, cuts[1:]):
            out[word] = data[a:b]
