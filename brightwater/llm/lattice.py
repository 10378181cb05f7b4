"""The lattice of all segmentations of words into pieces of a fixed vocabulary."""

from __future__ import annotations

import math

import numpy as np

from .textkernel import mix

_B = np.uint64(0x9E3779B97F4A7C15)
SPACE = 0x2581  # what stands for a space in a piece
#: A literal U+2581 of a text, which no piece may match.
LITERAL = 0x110000 + SPACE
#: Positions between rescalings; at least the length of the longest piece.
_BLOCK = 32
#: Characters from which a word is worked through by itself.
_LONG = 1024


class Vocabulary:
    """Pieces of a SentencePiece model; number `size` is the fallback for a character in none of them."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.total = model.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        pieces, ids, scores = [], [], []
        for i in range(self.total):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if "▁" in piece.lstrip("▁"):
                    raise ValueError(f"piece {piece!r} has a space inside; words are not independent")
                pieces.append(piece), ids.append(i), scores.append(model.get_score(i))
        self.pieces, self.ids, self.scores = pieces, np.array(ids), np.array(scores)
        self.size = len(pieces)
        self.longest = max(map(len, pieces))
        if self.longest > _BLOCK:
            raise ValueError("pieces are longer than a block")
        #: For each length: sorted hashes of all pieces' beginnings, the piece that is just that (or -1), whether any goes on.
        self._by_length = []
        lengths = np.array([len(p) for p in pieces])
        code = np.zeros((self.size, self.longest), np.uint64)
        for i, piece in enumerate(pieces):
            code[i, : len(piece)] = [ord(c) + 1 for c in piece]
        h = np.zeros(self.size, np.uint64)
        for n in range(1, self.longest + 1):
            h = h * _B + code[:, n - 1]
            own = np.flatnonzero(lengths >= n)
            keys, slot = np.unique(mix(h[own]), return_inverse=True)
            whole, longer = lengths[own] == n, np.zeros(len(keys), bool)
            number = np.full(len(keys), -1)
            number[slot[whole]] = own[whole]
            longer[slot[~whole]] = True
            if len(keys) != len({pieces[i][:n] for i in own}):
                raise ValueError("two pieces share a hash")
            self._by_length.append((keys, number, longer))

        #: Code points that are pieces by themselves, in order, and their numbers.
        alone = sorted((ord(p), i) for i, p in enumerate(pieces) if len(p) == 1)
        self.single, self._single_piece = [c for c, _ in alone], np.array([i for _, i in alone])

    def letters(self, codes: np.ndarray) -> np.ndarray:
        """The piece that is just each character, or the fallback."""
        slot = np.searchsorted(self.single, codes)
        slot[slot == len(self.single)] = 0
        return np.where(np.array(self.single)[slot] == codes, self._single_piece[slot], self.size)

    def lattice(self, codes: np.ndarray, lengths: np.ndarray) -> Lattice:
        return Lattice(self, codes, lengths)


class Lattice:
    """Edges of all words, sorted by their end's place in the word, then by word.

    Node j of word w has number first[w] + w + j, where first counts characters.
    """

    def __init__(self, vocabulary: Vocabulary, codes: np.ndarray, lengths: np.ndarray):
        self.lengths = lengths
        self.codes = codes
        ends = np.cumsum(lengths)
        self.first = ends - lengths
        n_chars = int(ends[-1]) if len(ends) else 0
        self.word = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(n_chars) - self.first[self.word]
        left = lengths[self.word] - place
        at = np.arange(n_chars)
        h = np.zeros(n_chars, np.uint64)
        code = codes.astype(np.uint64) + np.uint64(1)
        found_at, found_len, found_piece = [], [], []
        for n in range(1, vocabulary.longest + 1):
            at = at[left[at] >= n] if n > 1 else at
            if not len(at):
                break
            value = h[at] * _B + code[at + n - 1]
            h[at] = value
            keys, pieces, longer = vocabulary._by_length[n - 1]
            value = mix(value)
            slot = np.searchsorted(keys, value)
            slot[slot == len(keys)] = 0
            begins = keys[slot] == value
            piece = np.where(begins, pieces[slot], -1)
            hit = piece >= 0
            found_at.append(at[hit]), found_len.append(np.full(int(hit.sum()), n)), found_piece.append(piece[hit])
            if n == 1:
                miss = at[~hit]
                found_at.append(miss), found_len.append(np.ones(len(miss), np.int64)), found_piece.append(np.full(len(miss), vocabulary.size))
            at = at[begins & longer[slot]]
        start = np.concatenate(found_at) if found_at else np.empty(0, np.int64)
        size = np.concatenate(found_len) if found_len else np.empty(0, np.int64)
        piece = np.concatenate(found_piece) if found_piece else np.empty(0, np.int64)
        word = self.word[start]
        stop = place[start] + size
        order = np.argsort(stop * max(1, len(lengths)) + word, kind="stable")
        self.start_char, self.piece, self.stop, self.edge_word = start[order], piece[order], stop[order], word[order]
        self.start = self.start_char + self.edge_word  # node numbers
        self.end = self.start + size[order]
        self.steps = np.searchsorted(self.stop, np.arange(1, (int(lengths.max()) if len(lengths) else 0) + 2))

    def forward(self, weight: np.ndarray, shares: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """log of the sum over all segmentations of the product of weights, per word and column.

        weight: (pieces + 1, columns).  shares: also the chance of each edge given
        its end node (first column).  Sums are rescaled per word and column every
        block, so words may be of any length.
        """
        n_words, columns = len(self.lengths), weight.shape[1]
        out = np.zeros((n_words, columns))
        share = np.empty(len(self.piece)) if shares else None
        for w in np.flatnonzero(self.lengths > _LONG).tolist():
            out[w] = self._forward_one(w, weight, share)
        short = np.flatnonzero(self.lengths[self.edge_word] <= _LONG) if n_words and int(self.lengths.max()) > _LONG else slice(None)
        start, end, piece, word, stop = (x[short] for x in (self.start, self.end, self.piece, self.edge_word, self.stop))
        steps = np.searchsorted(stop, np.arange(1, (int(stop.max()) if len(stop) else 0) + 2))
        part_share = np.empty(len(piece)) if shares else None
        alpha = np.zeros((int(self.lengths.sum()) + n_words, columns))
        root = self.first + np.arange(n_words)
        alpha[root] = 1.0
        log_scale = np.zeros((n_words, columns))
        for j in range(1, len(steps)):
            a, b = steps[j - 1], steps[j]
            if a == b:
                break
            part = alpha[start[a:b]] * weight[piece[a:b]]
            ends = end[a:b]
            cut = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
            total = np.add.reduceat(part, cut, axis=0)
            alpha[ends[cut]] = total
            if shares:
                part_share[a:b] = part[:, 0] / np.repeat(total[:, 0], np.diff(np.append(cut, b - a)))
            if j % _BLOCK == 0:
                words = word[a:b][cut]
                tail = root[words][:, None] + j - np.arange(_BLOCK)
                block = alpha[tail]
                top = block.max(axis=1)
                log_scale[words] += np.log(top)
                alpha[tail] = block / top[:, None, :]
        if shares:
            share[short] = part_share
        own = np.flatnonzero(self.lengths <= _LONG)
        out[own] = np.log(alpha[(root + self.lengths)[own]]) + log_scale[own]
        return out, share

    def _forward_one(self, w: int, weight: np.ndarray, share: np.ndarray | None) -> list[float]:
        """forward() of one long word, in time linear in it."""
        own = np.flatnonzero(self.edge_word == w)
        length = int(self.lengths[w])
        start = (self.start[own] - (self.first[w] + w)).tolist()
        bounds = np.searchsorted(self.stop[own], np.arange(1, length + 2)).tolist()
        out = []
        for c in range(weight.shape[1]):
            value = weight[self.piece[own], c].tolist()
            alpha, scale = [1.0] + [0.0] * length, 0.0
            shares = [0.0] * len(own)
            for j in range(1, length + 1):
                total = 0.0
                for e in range(bounds[j - 1], bounds[j]):
                    shares[e] = part = alpha[start[e]] * value[e]
                    total += part
                alpha[j] = total
                if share is not None and not c:
                    for e in range(bounds[j - 1], bounds[j]):
                        shares[e] /= total
                if j % _BLOCK == 0:
                    top = max(alpha[j - _BLOCK + 1 : j + 1])
                    scale += math.log(top)
                    alpha[j - _BLOCK + 1 : j + 1] = [x / top for x in alpha[j - _BLOCK + 1 : j + 1]]
            if share is not None and not c:
                share[own] = shares
            out.append(math.log(alpha[length]) + scale)
        return out

    def expected(self, share: np.ndarray, counts: np.ndarray, n_pieces: int) -> np.ndarray:
        """Expected uses of each piece, words weighted by counts."""
        visit = np.zeros(int(self.lengths.sum()) + len(self.lengths))
        visit[self.first + np.arange(len(self.lengths)) + self.lengths] = counts
        total = np.zeros(n_pieces)
        for j in range(len(self.steps) - 1, 0, -1):
            a, b = self.steps[j - 1], self.steps[j]
            if a == b:
                continue
            flow = visit[self.end[a:b]] * share[a:b]
            visit += np.bincount(self.start[a:b], flow, len(visit)) if b - a > len(visit) // 8 else 0
            if b - a <= len(visit) // 8:
                np.add.at(visit, self.start[a:b], flow)
            total += np.bincount(self.piece[a:b], flow, n_pieces)
        return total


def word_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words end to end, spaces as pieces have them, and lengths."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = np.where(codes == SPACE, LITERAL, codes)
    codes[codes == 0x20] = SPACE
    return codes, np.fromiter(map(len, words), np.int64, len(words))


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]
