"""Token counts of a byte-pair model by rank-synchronous merging in numpy.

The pre-tokens of a batch lie behind each other in one array of symbols. In
every round each pre-token's pair of lowest rank is merged wherever it stands,
in all pre-tokens at once; when no pair is left, the symbols that remain are
its tokens. A pre-token is merged once while a worker remembers it.

Taking all places of a pair at once gives what merging one at a time gives,
because a pair that holds a merged symbol always has a higher rank than the
merge that made the symbol; a model for which that does not hold is refused.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces

#: Tokens that a text may have before it counts as over the limit.
LIMIT = 2048
#: Pre-tokens, and their characters, that a worker remembers before it starts anew.
REMEMBERED = 400_000
REMEMBERED_CHARS = 4_000_000
#: Symbols merged side by side in one batch.
BATCH_SYMBOLS = 1 << 20
#: Rounds after which the few pre-tokens that still have pairs keep their pairs by rank.
ROUNDS = 64
_NEVER = np.int32(2**31 - 1)
#: Lower case where Python's is another: a final sigma is a matter of words, not of characters, and letters newer than Python's tables.
_LOWER = {0x3A3: 0x3C3, 0xA7CB: 0x264, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


class MergeModel:
    """Merges and vocabulary of a byte-level model with word ends, read from its JSON on the driver."""

    def __init__(self, state: dict):
        self.__dict__.update(state)

    @classmethod
    def load(cls, path: str) -> MergeModel:
        """The model of a ``tokenizers`` file; other normalisers and splits than those handled here are refused."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, norm, split = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        steps = [n["type"] for n in norm["normalizers"]]
        cut, level = split["pretokenizers"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        blank = norm["normalizers"][1].get("pattern"), norm["normalizers"][1].get("content")
        if not plain or steps != ["NFC", "Replace", "Lowercase"] or blank != ({"Regex": r"\s+"}, " "):
            raise ValueError("a model of another kind")
        if (cut["type"], cut["behavior"], cut["invert"]) != ("Split", "Removed", True) or (level["type"], level["add_prefix_space"], level["use_regex"]) != ("ByteLevel", False, False):
            raise ValueError("a model that splits in another way")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens of another kind")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        latest = np.full(max(vocab.values()) + 1, -1, np.int64)
        np.maximum.at(latest, made, np.arange(len(made)))
        if (np.maximum(latest[left], latest[right]) >= np.arange(len(made))).any():
            raise ValueError("a pair merges before its parts do")
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        if (np.diff(keys[order]) == 0).any():
            raise ValueError("a pair has two ranks")
        state = {
            "inside": np.array([vocab[c] for c in letters], np.int32), "ending": np.array([vocab[c + end] for c in letters], np.int32),
            "keys": keys[order], "ranks": order.astype(np.int32), "made": made,
            "pattern": cut["pattern"]["Regex"], "special": [t["content"] for t in spec["added_tokens"]],
        }
        return cls(state)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the pairs ``(a, b)``, the greatest number where they do not merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Byte symbols of all words behind each other, and the words' lengths."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        flat = self.inside[raw]
        last = np.cumsum(n) - 1
        flat[last] = self.ending[raw[last]]
        return flat, n

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many tokens each of the non-empty ``words`` has."""
        out, start, held = [], 0, 0
        for i, w in enumerate(words):
            if held and held + len(w) > BATCH_SYMBOLS:
                out.append(self._batch(words[start:i]))
                start, held = i, 0
            held += len(w)
        if start < len(words):
            out.append(self._batch(words[start:]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _batch(self, words: list[bytes]) -> np.ndarray:
        flat, n = self.symbols(words)
        owner = np.repeat(np.arange(len(words)), n)
        total = np.zeros(len(words), np.int64)
        # rank[i]: of symbol i and the one behind it in the same word
        rank = np.full(len(flat), _NEVER, np.int32)
        pair = np.flatnonzero(owner[:-1] == owner[1:])
        rank[pair] = self.rank(flat[pair], flat[pair + 1])
        for _ in range(ROUNDS):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
            if not len(starts):
                return total
            sizes = np.diff(np.append(starts, len(owner)))
            least = np.minimum.reduceat(rank, starts)
            live = least < _NEVER
            total[owner[starts[~live]]] = sizes[~live]
            low = np.repeat(least, sizes)
            keep = low < _NEVER
            flat, owner, rank, low = flat[keep], owner[keep], rank[keep], low[keep]
            flat, owner, rank = self._merged(flat, owner, rank, np.flatnonzero(rank == low))
        for w in np.unique(owner).tolist():
            total[w] = self._long(flat[owner == w])
        return total

    def _merged(self, flat: np.ndarray, owner: np.ndarray, rank: np.ndarray, at: np.ndarray) -> tuple:
        """Merge the pairs that start at ``at``; of pairs that overlap, in a run of one symbol, every other one from the left."""
        at = at[_alternate(at)]
        if not len(at):
            return flat, owner, rank
        flat[at] = self.made[rank[at]]
        keep = np.ones(len(flat), bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        flat, owner, rank, at = flat[keep], owner[keep], rank[keep], place[at]
        for i in (at, at[at > 0] - 1):  # the pairs that a new symbol begins and ends
            rank[i] = _NEVER
            i = i[i + 1 < len(flat)]
            i = i[owner[i] == owner[i + 1]]
            rank[i] = self.rank(flat[i], flat[i + 1])
        return flat, owner, rank

    def _long(self, flat: np.ndarray) -> int:
        """The same for one long word: its places are kept by rank, so a round touches only the places that merge."""
        size = len(flat)
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        alive, count = np.ones(size, bool), size
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def offer(i: np.ndarray) -> None:
            i = i[(i >= 0) & (after[i] < size)]
            r = self.rank(flat[i], flat[after[i]])
            i, r = i[r < _NEVER], r[r < _NEVER]
            order = np.argsort(r, kind="stable")
            i, r = i[order], r[order]
            for part in np.split(i, np.flatnonzero(np.diff(r)) + 1) if len(i) else []:
                k = int(self.rank(flat[part[:1]], flat[after[part[:1]]])[0])
                if k not in places:
                    heapq.heappush(heap, k)
                places.setdefault(k, []).append(part)

        offer(np.arange(size))
        while heap:
            k = heapq.heappop(heap)
            i = np.unique(np.concatenate(places.pop(k)))
            i = i[alive[i] & (after[i] < size)]
            i = i[self.rank(flat[i], flat[after[i]]) == k]
            if not len(i):
                continue
            # number of each pair in its run of pairs that overlap
            i = i[_chained(i, after)]
            j = after[i]
            flat[i], alive[j] = self.made[k], False
            after[i] = after[j]
            on = after[i] < size
            before[after[i][on]] = i[on]
            count -= len(i)
            offer(np.unique(np.concatenate([i, before[i]])))
        return count


def _alternate(at: np.ndarray) -> np.ndarray:
    """Which of the ascending places stay when of neighbours every other one goes."""
    first = np.append(True, np.diff(at) > 1)
    starts = np.flatnonzero(first)
    return (np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))) % 2 == 0


def _chained(i: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The same where neighbours are linked by ``after``."""
    first = np.append(True, after[i[:-1]] != i[1:])
    starts = np.flatnonzero(first)
    return (np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))) % 2 == 0


class Counter:
    """Counts the tokens of texts; remembers the pre-tokens it has seen."""

    def __init__(self, model: MergeModel):
        self.model = model
        self.any = regex.compile(model.pattern)
        self.special = re.compile("|".join(map(re.escape, sorted(model.special, key=len, reverse=True)))) if model.special else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens."""
        if text.isascii():
            return self.any.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.any.findall(text.translate(_LOWER).lower())

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; an added token's string counts as that token, wherever it stands."""
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_CHARS:
            self._forget()
        known, total, found = self.known, [], []
        for t in texts:
            parts, extra = [t], 0
            if self.special and self.special.search(t):
                parts = self.special.split(t)
                extra = len(parts) - 1
            words = [w for p in parts if p for w in self.split(p)]
            found.append(words)
            total.append(extra)
        new = list({w for words in found for w in words if w not in known})
        known.update(zip(new, self.model.counts([w.encode() for w in new]).tolist()))
        self.held += sum(map(len, new))
        return [n + sum(map(known.__getitem__, words)) for n, words in zip(total, found)]


def count_tokens(docs: DataFrame, model: MergeModel, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """A row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts are those of the model's own library without added begin and end:
    special strings inside a text are one token each, nothing is cut or
    padded. Null and empty texts have none. Whole texts are counted, also very
    long ones and such as are one word; repeated rows give repeated rows, null
    ids stay, an empty table gives no rows; other columns are not read. Only
    the merge table is broadcast; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"state": model.__dict__})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value  # later tasks of a Python worker go on with the words of the first
        if "counter" not in held:
            held["counter"] = Counter(MergeModel(held["state"]))
        for batch in pieces(batches):
            texts = batch.column("text")
            sizes = pa.compute.binary_length(texts).cast(pa.int64())
            n = pa.array(held["counter"].count(texts.to_pylist()), pa.int64())
            yield pa.record_batch([batch.column("doc_id"), sizes, n, pa.compute.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
