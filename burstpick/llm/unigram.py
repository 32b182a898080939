"""A unigram lattice over the pieces of a SentencePiece vocabulary file, read as a unigram vocabulary with the scores
that the file holds.

A text is its units (it counts as having a blank before it): where no piece holds a blank behind another character, a run
of blanks and the word after it are a unit, and where no piece holds a line feed, each line feed is a unit of its own.
So no piece of the vocabulary crosses units, the best path of a text is the best paths of its units, and a worker
remembers those of the units that it has met. An Aho-Corasick automaton finds every piece in a unit. A character
that is no piece is unknown: it costs ``lowest score - 10`` and stands for its UTF-8 bytes. Ties follow the tokenizer's rule:
of paths with one score to a place, the one whose last piece is longer wins.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable
from functools import cached_property
from itertools import chain

MARK = "▁"
#: Stands in units for a MARK of the text itself, which is no blank: it is unknown there. No text holds a lone surrogate.
LITERAL = "\ud800"
UNKNOWN_COST = 10.0
#: Below every score.
NONE = float("-inf")
#: Longest unit that is remembered, in characters.
REMEMBERED = 64

_VOCABULARIES: dict[str, Vocabulary] = {}


class Memo(dict):
    """At most ``2 * cap`` results of ``of``: once ``cap`` are held, they become the old ones, and those of the old
    that are asked for again move over."""

    def __init__(self, of, cap: int):
        super().__init__()
        self.of, self.cap, self.old = of, cap, {}

    def __missing__(self, key):
        if (found := self.old.pop(key, None)) is None:
            found = self.of(key)
            if len(key) > REMEMBERED:
                return found
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        kept = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.unknown = min(model.get_score(i) for i in kept) - UNKNOWN_COST
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in kept if model.is_byte(i)}
        #: Piece -> its id and score.
        self.pieces = {model.id_to_piece(i): (i, float(model.get_score(i))) for i in kept if not model.is_byte(i)}
        #: Bytes that an id stands for.
        self.spelled = {i: p.replace(MARK, " ").encode() for p, (i, _) in self.pieces.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        #: Ids as bytes.
        self.coded = {i: i.to_bytes(4, "little") for i in self.spelled}
        self.cut = self.units_of(self.pieces)

    @staticmethod
    def units_of(pieces: Iterable[str]) -> re.Pattern[str]:
        """Finds the units of a text: as short as may be without one of the pieces crossing them."""
        feed = any("\n" in p for p in pieces)
        if any(MARK in p.lstrip(MARK) for p in pieces):
            return re.compile(r"(?s:.+)" if feed else r"\n|[^\n]+")
        return re.compile(r" *[^ ]+| +" if feed else r"\n| *[^ \n]+| +")

    @cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for piece, (i, score) in self.pieces.items():
            found.add_word(piece, (len(piece), score, i))
        found.make_automaton()
        return found

    def units(self, text: str) -> list[str]:
        return self.cut.findall(" " + text) if text else []

    def lattice(self, unit: str) -> tuple[str, list[float], list[int], list[list[tuple[int, float, int]]]]:
        """Forward Viterbi: the unit as pieces spell it; by place the best score and where its last piece starts; by place
        the edges that end there (start, score, id; -1: unknown), the longest first."""
        unit = unit.replace(MARK, LITERAL).replace(" ", MARK)
        n = len(unit)
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        for last, (size, score, i) in self.automaton.iter(unit):
            ends[last + 1].append((last + 1 - size, score, i))
        best, back = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            edges = ends[end]
            if not edges or edges[-1][0] != end - 1:
                edges.append((end - 1, self.unknown, -1))
            top = None
            for start, score, _ in edges:
                if top is None or best[start] + score > top:
                    top, back[end] = best[start] + score, start
            best[end] = top
        return unit, best, back, ends

    def count(self, unit: str) -> tuple[int, float]:
        """Pieces of the unit's best path, and its score; only scores and counts are carried along."""
        unit = unit.replace(MARK, LITERAL).replace(" ", MARK)
        best, pieces = [0.0], [0]
        found = self.automaton.iter(unit)
        last, match = next(found, (-1, None))
        for end, char in enumerate(unit):
            top, n, single = None, 0, False
            while last == end:
                start = end + 1 - match[0]
                score = best[start] + match[1]
                if top is None or score > top:
                    top, n = score, pieces[start] + 1
                single |= match[0] == 1
                last, match = next(found, (-1, None))
            if not single:
                score = best[end] + self.unknown
                if top is None or score > top:
                    top, n = score, pieces[end] + self.n_bytes(char)
            best.append(top)
            pieces.append(n)
        return pieces[-1], best[-1]

    def best_two(self, unit: str) -> tuple[float, bytes, float]:
        """Score and ids (little-endian unsigned 32-bit) of the unit's best path, and how much more the second one costs (infinite:
        there is none): forward Viterbi that carries the two best scores of each place."""
        unit = unit.replace(MARK, LITERAL).replace(" ", MARK)
        n, unknown = len(unit), self.unknown
        best, second, starts, last_ids = [0.0] * (n + 1), [NONE] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        end, top, runner, size, start, own_id = 0, NONE, NONE, 0, 0, -1
        for last, (length, score, i) in chain(self.automaton.iter(unit), ((n, (0, 0.0, 0)),)):
            while end < last:  # no more pieces end behind this character
                if size != 1:  # the shortest comes last
                    own = best[end] + unknown
                    if own > top:
                        other = second[end] + unknown
                        runner = top if top > other else other
                        top, start, own_id = own, end, -1
                    elif own > runner:
                        runner = own
                end += 1
                best[end], second[end], starts[end], last_ids[end] = top, runner, start, own_id
                top, runner, size = NONE, NONE, 0
            if last == n:
                break
            size, at = length, last + 1 - length
            own = best[at] + score
            if own > top:
                other = second[at] + score
                runner = top if top > other else other
                top, start, own_id = own, at, i
            elif own > runner:
                runner = own
        ids, end = [], n
        while end:
            start, i = starts[end], last_ids[end]
            ids.append(self.coded[i] if i >= 0 else self.spelling(unit[start]))
            end = start
        ids.reverse()
        return best[n], b"".join(ids), best[n] - second[n]

    def spelling(self, char: str) -> bytes:
        """Ids of the bytes of an unknown character."""
        return b"".join(self.coded[self.bytes[x]] for x in (MARK if char == LITERAL else char).encode())

    @staticmethod
    def n_bytes(char: str) -> int:
        return len((MARK if char == LITERAL else char).encode())

    def ids(self, unit: str, spans: list[tuple[int, int]]) -> list[int]:
        out = []
        for a, b in spans:
            own = unit[a:b]
            out += [self.pieces[own][0]] if own in self.pieces else [self.bytes[x] for x in (MARK if own == LITERAL else own).encode()]
        return out

    def n_best(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """Score and ids of the unit's ``n`` best paths, in order.

        A-star from the end of the unit: a hypothesis is a suffix of a path, and the forward score of the place
        before it is exactly what the rest costs; so it stands for the path that goes on along ``back``. It is held as
        the edges that leave ``back``; taking a path adds those that leave it once more. Equal scores: from the
        end, the path whose piece is longer where two part comes first.
        """
        unit, best, back, ends = self.lattice(unit)
        heap, out = [(-best[-1], ((1,),), len(unit), 0.0, ())], []
        least = [best[-1]]  # the n smallest costs so far, negated, the largest of them first
        while heap and len(out) < n:
            cost, key, place, tail, left = heapq.heappop(heap)
            out.append((-cost, self.ids(unit, self._spans(len(unit), back, dict(left)))))
            gone = tail  # score of the suffix behind place
            while place > 0:
                own = None
                for start, score, _ in ends[place]:
                    if start == back[place] and own is None:
                        own = score
                        continue
                    cost = -(gone + score + best[start])
                    if len(least) == n and cost > -least[0]:  # n paths cost less
                        continue
                    (heapq.heappush if len(least) < n else heapq.heappushpop)(least, -cost)
                    side = (0, -place, start) if start < back[place] else (2, place, start)
                    heapq.heappush(heap, (cost, (*key[:-1], side, (1,)), start, gone + score, (*left, (place, start))))
                gone, place = gone + own, back[place]
        return out

    @staticmethod
    def _spans(n: int, back: list[int], left: dict[int, int]) -> list[tuple[int, int]]:
        out = []
        while n > 0:
            start = left.get(n, back[n])
            out.append((start, n))
            n = start
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.spelled.__getitem__, ids)).decode()[1:]


def vocabulary(path: str) -> Vocabulary:
    """This worker's vocabulary from ``path``, loaded once."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
