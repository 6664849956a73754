"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Text is cut where no piece can reach: at the start of a run of spaces, around
line breaks, and between words and punctuation if the vocabulary allows. Distinct segments of equal length are the rows of one
matrix and advance together, position by position, over the lattice of pieces
that end there. Substring hashes find pieces by binary search in the sorted
hashes of the vocabulary.

At every position the best arc of each row is a maximum over the lengths of
the pieces that end there, stored as a backpointer. A unigram model's best
path is the one with the greatest sum of piece scores. A BPE model merges
neighbours in order of score, so its result is the one path on which any two
neighbouring pieces, taken alone, would stay as they are; for BPE only such
arcs enter the maximum, and the path it leaves is exactly the model's own
segmentation.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces as text_pieces

SPACE = "▁"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Longer segments are merged one at a time; their number of positions would rule a batch.
LONG_SEGMENT = 256
#: Distinct segments, and their characters, that a worker remembers before it starts anew.
REMEMBERED = 400_000
REMEMBERED_CHARS = 4_000_000
_NEVER = np.int32(2**31 - 1)
#: Spreads hashes of short strings over all leading bits.
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_HEADS = 1 << 20
_HEAD = np.uint64(44)
#: Slots of a task's memory of piece pairs; a pair that finds its slot taken replaces what is there.
_PAIR_SLOTS = _HEADS


def _hash(text: str) -> int:
    h, m = 0, int(MULTIPLIER)
    for c in text:
        h = (h * m + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class PieceModel:
    """A vocabulary with what batched encoding needs; built on the driver, then only read.

    ``entries`` lists ``(piece, score, kind)`` by id; kinds are "normal",
    "byte", "unknown" and "control". ``algorithm`` is "bpe" or "unigram".
    """

    def __init__(self, entries: list[tuple[str, float, str]], algorithm: str = "bpe"):
        self.algorithm = algorithm
        self.unknown = next((i for i, e in enumerate(entries) if e[2] == "unknown"), 0)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(entries) if k == "byte"}
        self.surface = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(SPACE, " ").encode() if k == "normal" else b"" for p, _, k in entries]
        normal = [(i, p, s) for i, (p, s, k) in enumerate(entries) if k == "normal"]
        self.ids = {p: i for i, p, _ in normal}
        self.score = np.full(len(entries), -np.inf)
        for i, _, s in normal:
            self.score[i] = s
        self.longest = max((len(p) for _, p, _ in normal), default=1)
        self.joined = {c for _, p, _ in normal if len(p) > 1 for c in p}
        # Letters, less those that some piece joins to another character, so that texts may be cut around words too.
        beside = {(x, y) for _, p, _ in normal for x, y in zip(p, p[1:]) if x != SPACE}
        self.letters, apart = r"\W\d_", set()
        for x, y in sorted(beside):
            inside = [c for c in (x, y) if re.fullmatch(rf"[^{self.letters}]", c)]
            if len(inside) == 1:
                apart.add(inside[0])
        self.letters += "".join(map(re.escape, sorted(apart)))
        self.letters = rf"[^{self.letters}]"
        if any(len([c for c in pair if re.fullmatch(self.letters, c)]) == 1 for pair in beside):
            self.letters = None
        self.run_lengths = sorted(len(p) for _, p, _ in normal if set(p) == {SPACE})
        hashes = np.array([_hash(p) for _, p, _ in normal], np.uint64) * _SPREAD
        order = np.argsort(hashes)
        self.keys, self.key_ids = hashes[order], np.array([i for i, _, _ in normal], np.int32)[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one hash")
        # Where in the sorted keys those with the same leading bits start, and how many share them at most.
        heads = (self.keys >> _HEAD).astype(np.int64)
        self.first = np.searchsorted(heads, np.arange(_HEADS + 1)).astype(np.int32)
        self.crowd = int(np.diff(self.first).max(initial=0))
        self.occupied = np.diff(self.first) > 0
        self.keys = np.concatenate([self.keys, np.zeros(self.crowd + 1, np.uint64)])
        self.key_ids = np.concatenate([self.key_ids, np.full(self.crowd + 1, -1, np.int32)])
        self.piece_hash = np.zeros(len(entries), np.uint64)
        self.piece_power = np.ones(len(entries), np.uint64)
        power = [1]
        for _ in range(self.longest + 1):
            power.append(power[-1] * int(MULTIPLIER) & 0xFFFFFFFFFFFFFFFF)
        self.power = np.array(power, np.uint64)
        for i, p, _ in normal:
            self.piece_hash[i], self.piece_power[i] = _hash(p), power[len(p)]
        if algorithm == "bpe":
            self._grow(normal, len(entries))

    def _grow(self, normal: list, n: int) -> None:
        """Ranks of merges, and for every piece the symbols at its two edges while it forms."""
        place = {s: r for r, s in enumerate(sorted({-s for _, _, s in normal}))}
        self.rank = np.full(n, _NEVER, np.int32)
        for i, _, s in normal:
            self.rank[i] = place[-s]
        left, right = {}, {}
        self.whole = np.zeros(n, bool)
        for i, p, _ in normal:
            if len(p) == 1:
                self.whole[i] = True
                continue
            made: dict[int, tuple[int, int]] = {}
            if set(p) != {SPACE} and self.merge(p, made) == [i]:
                self.whole[i] = True
                left[i], right[i] = made[i]
        edges = []
        for side in (left, right):
            chains = {}
            for i, p, _ in normal:
                if self.whole[i]:
                    chain = [i]
                    while chain[-1] in side:
                        chain.append(side[chain[-1]])
                    chains[i] = chain[::-1]
            deep = max(map(len, chains.values()), default=1)
            nodes, nexts = np.zeros((n, deep), np.int32), np.full((n, deep), _NEVER, np.int32)
            for i, chain in chains.items():
                nodes[i, : len(chain)] = chain
                after = [int(self.rank[x]) for x in chain[1:]]
                if after != sorted(after):
                    raise ValueError("a piece forms before its parts")
                nexts[i, : len(after)] = after
            edges += [nodes, nexts]
        self.left_edge, self.left_next, self.right_edge, self.right_next = edges

    def merge(self, text: str, made: dict | None = None) -> list[int]:
        """One text by merging neighbours in order of score, the leftmost first; unknown characters give -1 less the code point."""
        parts = [self.ids.get(c, -1 - ord(c)) for c in text]
        words: list[str | None] = list(text)
        after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(text) and (k := self.ids.get(words[i] + words[j])) is not None:
                heapq.heappush(heap, (-self.score[k], i, j, len(words[i]) + len(words[j])))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if words[i] is None or words[j] is None or after[i] != j or len(words[i]) + len(words[j]) != size:
                continue
            k = self.ids[words[i] + words[j]]
            if made is not None:
                made[k] = (parts[i], parts[j])
            words[i], words[j], parts[i] = words[i] + words[j], None, k
            after[i] = after[j]
            if after[i] < len(text):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p, w in zip(parts, words) if w is not None]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        out = np.full(hashes.shape, -1, np.int32)
        hashes = hashes * _SPREAD
        head = (hashes >> _HEAD).astype(np.int64)
        likely = np.flatnonzero(self.occupied[head])
        h, at = hashes.ravel()[likely], self.first[head.ravel()[likely]]
        for step in range(self.crowd):
            hit = self.keys[at + step] == h
            out.ravel()[likely[hit]] = self.key_ids[at[hit] + step]
        return out

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`_stable`, with a memory of pairs."""
        if "pair_key" not in self.__dict__:
            self.pair_key, self.pair_ok = np.full(_PAIR_SLOTS, -1, np.int64), np.zeros(_PAIR_SLOTS, bool)
        pair = (a << 32) | b
        slot = ((pair.astype(np.uint64) * _SPREAD) >> _HEAD).astype(np.int64)
        ok = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_key[slot] != pair)
        if len(new):
            fresh = self._stable(a[new], b[new])
            ok[new] = fresh
            # slots that two new pairs share would mix key and answer, so the pair's last writer sets both
            self.pair_key[slot[new]] = pair[new]
            mine = self.pair_key[slot[new]] == pair[new]
            self.pair_ok[slot[new][mine]] = fresh[mine]
        return ok

    def state(self) -> dict:
        """The tables alone, as plain data."""
        return {k: v for k, v in self.__dict__.items() if k not in ("pair_key", "pair_ok")}

    @classmethod
    def of(cls, state: dict) -> PieceModel:
        made = cls.__new__(cls)
        made.__dict__.update(state)
        return made

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces ``a`` and ``b`` side by side stay two pieces.

        Both form in order of rank. Whenever their edge symbols would merge
        across the seam before the next step on either side, they do not.
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(at):
            x, y = self.right_edge[a, i], self.left_edge[b, j]
            nx, ny = self.right_next[a, i], self.left_next[b, j]
            k = self.find(self.piece_hash[x] * self.piece_power[y] + self.piece_hash[y])
            r = np.where(k >= 0, self.rank[k], _NEVER)
            bad = (r < nx) & (r <= ny)  # of equal ranks the leftmost goes first
            ok[at[bad]] = False
            on = ~bad & ((nx != _NEVER) | (ny != _NEVER))
            step = nx <= ny
            at, a, b, i, j = at[on], a[on], b[on], (i + step)[on], (j + ~step)[on]
        return ok

    def _lattice(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece (or -1 less the code point) and its length ending at every position of equal-length rows."""
        rows, width = codes.shape
        h = np.zeros((rows, width + 1), np.uint64)
        for i in range(width):
            h[:, i + 1] = h[:, i] * MULTIPLIER + codes[:, i].astype(np.uint64) + np.uint64(1)
        top = min(self.longest, width)
        arcs = np.full((top, rows, width + 1), -1, np.int32)
        for n in range(1, top + 1):
            found = self.find(np.ascontiguousarray(h[:, n:] - h[:, :-n] * self.power[n]))
            if self.algorithm == "bpe":
                found = np.where((found >= 0) & self.whole[found], found, -1)
            arcs[n - 1, :, n:] = found
        last, back = np.zeros((rows, width + 1), np.int64), np.ones((rows, width + 1), np.int16)
        best = np.zeros((rows, width + 1))
        floor = float(self.score[np.isfinite(self.score)].min(initial=0)) - 10.0
        for i in range(1, width + 1):
            last[:, i] = -1 - codes[:, i - 1].astype(np.int64)  # the character itself, if nothing ends here
            n, row = np.nonzero(arcs[: min(top, i), :, i] >= 0)
            piece = arcs[n, row, i].astype(np.int64)
            if self.algorithm == "bpe":
                prev = last[row, i - 1 - n]
                need = np.flatnonzero((i - 1 - n > 0) & (prev >= 0))
                ok = np.ones(len(n), bool)
                ok[need] = self.stable(prev[need], piece[need])
                n, row, piece = n[ok], row[ok], piece[ok]
            value = best[row, i - 1 - n] + self.score[piece]
            best[:, i] = best[:, i - 1] + floor
            if len(row):
                # the greatest value of each row that has an arc here; of equal ones the shortest piece
                order = np.lexsort((-n, value, row))
                pick = order[np.append(row[order[1:]] != row[order[:-1]], True)]
                held = row[pick]
                best[held, i], last[held, i], back[held, i] = value[pick], piece[pick], n[pick] + 1
        return last, back

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of many distinct segments, as ``(flat, starts, sizes)``; unknown characters as in :meth:`merge`."""
        starts, sizes, flats, used = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        alone = (lengths > LONG_SEGMENT) & (self.algorithm == "bpe")
        for k in np.flatnonzero(alone).tolist():
            tokens = np.array(self.merge(words[k]), np.int64)
            starts[k], sizes[k] = used, len(tokens)
            flats.append(tokens)
            used += len(tokens)
        # Equal lengths go together; beyond 24 they share a width, padded, and nothing after a row's own end is read.
        width_of = np.where(lengths <= 24, lengths, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for width in np.unique(width_of[~alone & (lengths > 0)]).tolist():
            members = np.flatnonzero(~alone & (width_of == width))
            step = max(1, 200_000 // width)
            for at in range(0, len(members), step):
                some = members[at : at + step]
                n = lengths[some]
                flat = np.frombuffer("".join([words[k] for k in some.tolist()]).encode("utf-32-le"), np.uint32)
                if (n == width).all():
                    codes = flat.reshape(len(some), width)
                else:
                    codes = np.zeros((len(some), width), np.uint32)
                    codes[np.repeat(np.arange(len(some)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
                last, back = self._lattice(codes)
                end, rows, steps = n.copy(), np.arange(len(some)), []
                while len(rows):
                    steps.append((rows, last[rows, end[rows]]))
                    end[rows] -= back[rows, end[rows]]
                    rows = rows[end[rows] > 0]
                row, token = np.concatenate([r for r, _ in reversed(steps)]), np.concatenate([t for _, t in reversed(steps)])
                count = np.bincount(row, minlength=len(some))
                flats.append(token[np.argsort(row, kind="stable")])
                sizes[some], starts[some] = count, used + np.cumsum(count) - count
                used += len(token)
        return np.concatenate(flats) if flats else np.zeros(0, np.int64), starts, sizes

    def spaces(self, n: int) -> list[int]:
        """Pieces of a run of ``n`` spaces that no word takes part in: merged from the left, the longest run piece over and over."""
        if n <= 0:
            return []
        longest = 1
        while longest + 1 in self.run_lengths:
            longest += 1
        if self.algorithm != "bpe" or longest != (self.run_lengths or [1])[-1]:
            return self.segment([SPACE * n])[0].tolist() if self.algorithm != "bpe" else self.merge(SPACE * n)
        out = [self.ids[SPACE * longest]] * (n // longest) if SPACE * longest in self.ids else [-1 - ord(SPACE)] * n
        return out + ([self.ids[SPACE * (n % longest)]] if n % longest else [])

    def finished(self, tokens: list[int]) -> list[int]:
        """Unknown characters as byte pieces, or the unknown id where the model has none."""
        if all(t >= 0 for t in tokens):
            return tokens
        out: list[int] = []
        for t in tokens:
            out += [t] if t >= 0 else [self.byte_ids.get(b, self.unknown) for b in chr(-1 - t).encode()] if self.byte_ids else [self.unknown]
        return out

    def decode(self, ids) -> str:
        """The text of the ids, without the space that encoding puts in front."""
        surface = self.surface
        text = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class Encoder:
    """Encodes texts with a model; remembers the segments it has seen."""

    def __init__(self, model: PieceModel):
        self.model = model
        breaks = "" if "\n" in model.joined else "\n"
        rest = rf"(?:(?!{model.letters})[^{SPACE}{breaks}])+" if model.letters else f"[^{SPACE}{breaks}]+"
        self.cut = re.compile((f"{SPACE}*{model.letters}+|" if model.letters else "") + f"{SPACE}*{rest}|{SPACE}+" + (f"|{breaks}" if breaks else ""))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, new: list[str]) -> None:
        model = self.model
        bare = model.ids.get(SPACE, -1 - ord(SPACE))
        at = len(self.flat)
        # A segment with one space in front, or none, is a row of the lattice as it stands.
        odd = [k for k, s in enumerate(new) if s[:2] == SPACE + SPACE or s == SPACE]
        words = list(new)
        for k in odd:
            word = new[k].lstrip(SPACE)
            words[k] = SPACE + word if word else ""
        flat, starts, sizes = model.segment(words)
        unknown = np.concatenate([[0], np.cumsum(flat < 0)])
        spaced = set(odd)
        rework = spaced.union(np.flatnonzero(unknown[starts + sizes] > unknown[starts]).tolist())
        parts, used = [flat], len(flat)
        for k in sorted(rework):
            tokens = flat[starts[k] : starts[k] + sizes[k]].tolist()
            if k in spaced:
                n = len(new[k]) - len(new[k].lstrip(SPACE))
                tokens = model.spaces(n) + tokens[1:] if not tokens or tokens[0] == bare else model.spaces(n - 1) + tokens
            tokens = model.finished(tokens)
            parts.append(np.array(tokens, np.int64))
            starts[k], sizes[k] = used, len(tokens)
            used += len(tokens)
        self.starts, self.sizes = np.concatenate([self.starts, at + starts]), np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.concatenate(parts).astype(np.int32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)``: the ids of all texts in a row, and where each text's start."""
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_CHARS:
            self._forget()
        known, cut = self.known, self.cut.findall
        docs = [cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        segments = list(chain.from_iterable(docs))
        new = [s for s in dict.fromkeys(segments) if s not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.held += sum(map(len, new))
            self._learn(new)
        codes = np.fromiter(map(known.__getitem__, segments), np.int64, len(segments))
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[codes] - (ends - sizes), sizes)]
        bounds = np.cumsum([0, *map(len, docs)])
        offsets = np.concatenate([[0], ends])[bounds]
        return ids, offsets


def load(path: str, algorithm: str = "bpe") -> PieceModel:
    """A model file, read on the driver. Its vocabulary, not the library, does the encoding.

    Models with the identity normaliser, a space put in front and spaces
    escaped are supported.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = ["unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) or sp.is_unused(i) else "byte" if sp.is_byte(i) else "normal" for i in range(sp.get_piece_size())]
    return PieceModel([(sp.id_to_piece(i), sp.get_score(i), k) for i, k in enumerate(kinds)], algorithm)


def encode_documents(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``doc_id, n_tokens, ids, text_sha256, decoded_sha256``.

    ``decoded_sha256`` is of the text that decoding ``ids`` gives; the two
    digests agree unless the text itself holds the escape U+2581. Null texts
    are empty texts and have no ids. Whole texts are encoded, also very long
    ones; repeated rows give repeated rows; an empty table gives none. Other
    columns are not read. The vocabulary is the only thing broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"state": model.state()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value  # later tasks of a Python worker go on with the encoder of the first
        if "encoder" not in held:
            held["encoder"] = Encoder(PieceModel.of(held["state"]))
        encoder = held["encoder"]
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        for batch in text_pieces(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, offsets = encoder.encode(texts)
            decoded = [encoder.model.decode(ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(map(digest, texts), pa.string()), pa.array(map(digest, decoded), pa.string())],
                ["doc_id", "n_tokens", "ids", "text_sha256", "decoded_sha256"],
            )

    id_type = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids array<int>, text_sha256 string, decoded_sha256 string")


def decode_documents(rows: DataFrame, model: PieceModel, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from token ids; null ids give the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(model.state())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.of(shared.value)
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([model.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    id_type = dict(rows.dtypes)[id_col]
    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {id_type}, text string")
