"""SentencePiece encoding by sampling, and lossless decoding.

A text is a lattice whose arcs are the pieces of a vocabulary. Forward
filtering sums the weight of all ways to reach each character; backward
sampling then walks from the end and draws each piece in proportion to the
ways through it. The draws depend on the seed, the row's key and the place
in the text alone, so a row is segmented alike wherever and whenever it runs.

No piece crosses from a character into a following space, and line breaks are
single bytes, so the lattice falls apart at these places. Each distinct part
of a batch is filtered once; every occurrence is sampled on its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read_table
from .token_counts import tokenizer_path

_SPACE, _BLOCK = 0x20, 0x2581
#: Stands for the block character itself, which pieces use for a space; outside Unicode.
_LITERAL = 0x110000
_PART = re.compile("[ ]*[^ \n▁]+|[ ]+|\n|▁")
_U = np.uint64
_FACTOR = _U(0x100000001B3)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Vocabulary:
    """Pieces of a SentencePiece model with their log weights.

    The weight of a piece falls with its rank as Zipf's law has it, to the
    power ``alpha``: models merged pair by pair store ranks, not
    probabilities. A character without a piece of its own becomes its bytes.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        crossing = [pieces[i] for i in plain if re.search("[^▁]▁|.\n|\n.", pieces[i])]
        if crossing or not all(model.piece_to_id(f"<0x{b:02X}>") != model.unk_id() for b in range(256)):
            raise ValueError(f"{path}: needs a piece for each byte and none across a space: {crossing[:5]}")
        #: Byte strings by id; what else the model has stands for nothing.
        self.bytes = [b""] * self.size
        for i in plain:
            self.bytes[i] = pieces[i].replace("▁", " ").encode("utf-8")
        self.byte_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        for b, i in enumerate(self.byte_id):
            self.bytes[i] = bytes([b])
        rank = np.full(self.size, float(self.size))
        rank[plain] = [min(-model.get_score(i), self.size) for i in plain]
        zipf = alpha * -np.log1p(rank)
        self.weight = zipf - np.log(np.exp(zipf).sum())
        self.longest = max(len(pieces[i]) for i in plain)
        #: Byte ids of characters without a piece, which are numbered beyond the model's ids.
        self.spelling: list[list[int]] = []
        self._spelt: dict[int, int] = {}
        self.by_length = []
        self.single = np.full(_LITERAL + 1, -1, np.int32)
        for n in range(1, self.longest + 1):
            own = [i for i in plain if len(pieces[i]) == n]
            h = np.zeros(len(own), np.uint64)
            if own:
                codes = np.array([[ord(c) for c in pieces[i]] for i in own], np.uint64)
                for k in range(n):
                    h = h * _FACTOR + codes[:, k] + _U(1)
                if n == 1:
                    self.single[codes[:, 0].astype(np.int64)] = own
            h = _mix(h)
            order = np.argsort(h)
            seen = np.zeros(1 << 16, bool)
            seen[(h >> _U(48)).astype(np.int64)] = True
            self.by_length.append((h[order], np.array(own, np.int32)[order], seen))

    def spelt(self, code: int) -> int:
        if code not in self._spelt:
            char = chr(code if code != _LITERAL else _BLOCK)
            self.spelling.append([self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")])
            self._spelt[code] = self.size + len(self.spelling) - 1
            self.weight = np.append(self.weight, sum(self.weight[i] for i in self.spelling[-1]))
        return self._spelt[code]

    def arcs(self, codes: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Ids of the pieces that end at each character, by length; -1 where there is none.

        ``room`` tells how many characters of the part there are up to here.
        """
        out = np.full((len(codes), self.longest), -1, np.int32)
        wide = codes.astype(np.uint64) + _U(1)
        out[:, 0] = self.single[codes]
        at, h, powers = np.arange(len(codes)), wide, np.cumprod(np.full(self.longest, _FACTOR))
        for n in range(2, self.longest + 1):
            # The hash of the n characters that end here; it grows at its start.
            more = np.flatnonzero(room[at] >= n)
            if not len(more):
                break
            at, h = at[more], h[more]
            h = h + wide[at - n + 1] * powers[n - 2]
            keys, ids, seen = self.by_length[n - 1]
            if not len(keys):
                continue
            mixed = _mix(h)
            likely = np.flatnonzero(seen[(mixed >> _U(48)).astype(np.int64)])
            k = np.minimum(np.searchsorted(keys, mixed[likely]), len(keys) - 1)
            hit = keys[k] == mixed[likely]
            out[at[likely[hit]], n - 1] = ids[k[hit]]
        return out


def _codes(text: str) -> np.ndarray:
    """Code points as pieces have them: the block character for a space."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[codes == _BLOCK] = _LITERAL
    codes[codes == _SPACE] = _BLOCK
    return codes


class _Numbers(dict):
    """Parts by order of appearance."""

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        return n


class Lattice:
    """Forward-filtered lattices of distinct parts, ready for sampling.

    ``base`` and ``lengths`` are by part: where its states start, one for
    each character, and how many there are. ``first`` is by state: its first
    arc. By arc: ``piece``, ``back`` (characters), and ``upto``, the share of
    the state's ways up to this arc.
    """

    def __init__(self, vocabulary: Vocabulary, parts: list[str]):
        # Longest first, so that those with an e-th character come first for every e.
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths
        sorted_lengths = lengths[order]
        starts = np.cumsum(sorted_lengths) - sorted_lengths
        self.base = np.empty(len(parts), np.int64)
        self.base[order] = starts
        codes = _codes("".join([parts[i] for i in order.tolist()]))
        room = np.arange(len(codes)) - np.repeat(starts, sorted_lengths) + 1
        found = vocabulary.arcs(codes, room)
        bare = np.flatnonzero(found[:, 0] < 0)
        if len(bare):
            odd, which = np.unique(codes[bare], return_inverse=True)
            found[bare, 0] = np.array([vocabulary.spelt(c) for c in odd.tolist()])[which]
        there = found >= 0
        n_arcs = there.sum(1)
        state, length = np.nonzero(there)
        self.piece = found[state, length]
        self.back = (length + 1).astype(np.int8)
        w = vocabulary.weight[self.piece]
        first = np.cumsum(n_arcs) - n_arcs
        alpha = np.zeros(len(codes))
        at_start = room[state] == self.back
        before = np.where(at_start, 0, state - self.back)
        share = np.empty(len(state))
        n_from = np.searchsorted(-sorted_lengths, -np.arange(1, (sorted_lengths[0] if len(parts) else 0) + 1), side="right")
        for e, n in enumerate(n_from.tolist()):
            here = starts[:n] + e
            count = n_arcs[here]
            cut = np.cumsum(count) - count
            at = np.repeat(first[here] - cut, count) + np.arange(int(count.sum()))
            s = w[at] + np.where(at_start[at], 0.0, alpha[before[at]])
            top = np.maximum.reduceat(s, cut)
            ways = np.exp(s - np.repeat(top, count))
            all_ways = np.add.reduceat(ways, cut)
            share[at] = ways / np.repeat(all_ways, count)
            alpha[here] = top + np.log(all_ways)
        # Summed arc by arc within each state, so that a part's table doesn't depend on its neighbours.
        rank = np.arange(len(state)) - first[state]
        for k in range(1, int(n_arcs.max()) if len(codes) else 0):
            at = np.flatnonzero(rank == k)
            share[at] += share[at - 1]
        share[first + n_arcs - 1] = 1.0
        self.first, self.upto = first, share

    def sample(self, vocabulary: Vocabulary, which: np.ndarray, place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per occurrence) for occurrences of parts.

        ``place``: where in its text an occurrence starts; ``key``: of its row.
        """
        active = np.arange(len(which))
        base = self.base[which]
        left = self.lengths[which].copy()
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        while len(active):
            rest = left[active]
            u = (_mix(key[active] + (place[active] + rest).astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(11)) * 2.0**-53
            arc = self.first[base[active] + rest - 1]
            more = np.flatnonzero(self.upto[arc] <= u)
            while len(more):
                arc[more] += 1
                more = more[self.upto[arc[more]] <= u[more]]
            rounds.append((active, self.piece[arc]))
            left[active] = rest - self.back[arc]
            active = active[left[active] > 0]
        steps = np.zeros(len(which), np.int64)
        for act, _ in rounds:
            steps[act] += 1
        ends = np.cumsum(steps)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for k, (act, ids) in enumerate(rounds):
            out[ends[act] - 1 - k] = ids
        size = vocabulary.size
        if len(out) and out.max() >= size:
            spelling = vocabulary.spelling
            spelt = np.array([len(s) for s in spelling])
            n = np.ones(len(out), np.int64)
            wide = out >= size
            n[wide] = spelt[out[wide] - size]
            longer = np.repeat(out, n)
            within = np.arange(len(longer)) - np.repeat(np.cumsum(n) - n, n)
            flat = np.array([i for s in spelling for i in s], np.int32)
            own = longer >= size
            longer[own] = flat[(np.cumsum(spelt) - spelt)[longer[own] - size] + within[own]]
            steps = np.add.reduceat(n, ends - steps)
            out = longer
        return out, steps


class _Store(Lattice):
    """Lattices one after another in arrays that grow by half; the end can be cut off again."""

    #: By field: whether it has an entry for each part, state or arc, and which of these its values count.
    FIELDS = {"base": (0, 1), "lengths": (0, None), "first": (1, 2), "upto": (2, None), "piece": (2, None), "back": (2, None)}

    def __init__(self, vocabulary: Vocabulary):
        one = Lattice(vocabulary, [])
        for name in self.FIELDS:
            setattr(self, name, getattr(one, name))
        self.sizes = [0, 0, 0]

    def push(self, more: Lattice) -> None:
        added = [len(more.base), len(more.first), len(more.piece)]
        for name, (unit, counted) in self.FIELDS.items():
            own, new, n = getattr(self, name), getattr(more, name), self.sizes[unit]
            if n + len(new) > len(own):
                wider = np.empty(n + len(new) + n // 2, own.dtype)
                wider[:n] = own[:n]
                setattr(self, name, own := wider)
            own[n : n + len(new)] = new if counted is None else new + self.sizes[counted]
        self.sizes = [x + y for x, y in zip(self.sizes, added, strict=True)]


class Encoder:
    """Encodes batches of texts in bounded memory.

    ``batch_chars``: characters whose lattices are held at once.
    ``most_arcs``: arcs of the lattices that are kept for parts that recur,
    at about 25 bytes each. ``window``: longer parts are filtered and sampled
    stretch by stretch; of these only a number for each character is held.
    """

    def __init__(self, vocabulary: Vocabulary, batch_chars: int = 1 << 17, most_arcs: int = 1 << 21, window: int = 2048):
        self.vocabulary, self.batch_chars, self.most_arcs, self.window = vocabulary, batch_chars, most_arcs, window
        self.numbers = _Numbers()
        self.kept = _Store(vocabulary)
        #: Marks of the parts that were met before, by hash; a wrong mark only keeps a lattice too early.
        self.seen = np.zeros(1 << 20, bool)

    def _sample(self, held: list[tuple[int, int, list[str]]], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        n_kept, before = len(self.numbers), list(self.kept.sizes)
        number = [np.fromiter(map(self.numbers.__getitem__, parts), np.int64, len(parts)) for _, _, parts in held]
        new = list(islice(self.numbers, n_kept, None))
        self.kept.push(Lattice(self.vocabulary, new))
        which = np.concatenate(number)
        n = np.array([len(x) for x in number])
        lengths = self.kept.lengths[which]
        ends = np.cumsum(lengths)
        first = np.cumsum(n) - n
        shift = np.repeat(np.array([at for _, at, _ in held]) - (ends[first] - lengths[first]), n)
        key = np.repeat(np.array([keys[t] for t, _, _ in held], np.uint64), n)
        ids, per_part = self.kept.sample(self.vocabulary, which, ends - lengths + shift, key)
        self.kept.sizes = before
        self._keep(new)
        return ids, np.add.reduceat(per_part, first)

    def _keep(self, new: list[str]) -> None:
        for part in new:
            del self.numbers[part]
        if self.kept.sizes[2] >= self.most_arcs:
            return
        short = [p for p in new if len(p) <= 32]
        marks = np.fromiter(map(hash, short), np.int64, len(short)) & (len(self.seen) - 1)
        again = [p for p, met in zip(short, self.seen[marks].tolist(), strict=True) if met]
        self.seen[marks] = True
        for part in again:
            self.numbers[part] = len(self.numbers)
        self.kept.push(Lattice(self.vocabulary, again))

    def _arcs(self, codes: np.ndarray, a: int, b: int) -> np.ndarray:
        """Ids of the pieces that end at characters a to b of one part, by length; -1 where there is none."""
        low = max(0, a - self.vocabulary.longest + 1)
        found = self.vocabulary.arcs(codes[low:b], np.arange(1, b - low + 1))[a - low :]
        bare = np.flatnonzero(found[:, 0] < 0)
        if len(bare):
            odd, which = np.unique(codes[a:b][bare], return_inverse=True)
            found[bare, 0] = np.array([self.vocabulary.spelt(c) for c in odd.tolist()])[which]
        return found

    def _sample_long(self, part: str, place: int, key: int, stretch: int = 1 << 14) -> np.ndarray:
        """Ids of one long part, by the same draws as in a lattice."""
        codes = _codes(part)
        # upto[i]: log weight of all ways to the first i characters.
        upto = np.zeros(len(codes) + 1)
        for a in range(0, len(codes), stretch):
            b = min(a + stretch, len(codes))
            found = self._arcs(codes, a, b)
            state, length = np.nonzero(found >= 0)
            w = np.exp(self.vocabulary.weight[found[state, length]]).tolist()
            back, stops = (length + 1).tolist(), np.searchsorted(state, np.arange(b - a), side="right").tolist()
            # Weights of the last few states over that of the first of them, so that none gets too small.
            low = max(0, a - self.vocabulary.longest)
            ways, base, k = np.exp(upto[low : a + 1] - upto[a]).tolist(), float(upto[a]), 0
            for i, stop in enumerate(stops):
                n, s = len(ways), 0.0
                while k < stop:
                    s += w[k] * ways[n - back[k]]
                    k += 1
                if s < 1e-200:
                    ways = [x / s for x in ways[-self.vocabulary.longest :]]
                    base, s = base + math.log(s), 1.0
                ways.append(s)
                upto[a + i + 1] = base + math.log(s)
        out, at = [], len(codes)
        for a in range((len(codes) - 1) // stretch * stretch, -1, -stretch):
            b = min(a + stretch, len(codes))
            found = self._arcs(codes, a, b)
            there = found >= 0
            state = np.arange(a + 1, b + 1)[:, None]
            before = np.maximum(state - np.arange(1, found.shape[1] + 1), 0)
            share = np.where(there, np.exp(np.where(there, self.vocabulary.weight[found], -np.inf) + upto[before] - upto[state]), 0.0)
            # Beyond the last arc there is nothing to draw.
            share = np.where(np.cumsum(there[:, ::-1], axis=1)[:, ::-1] <= 1, np.where(there, 2.0, 0.0), share)
            draws = (_mix(np.uint64(key) + (np.arange(a + 1, b + 1) + place).astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(11)) * 2.0**-53
            picked = np.argmax(np.cumsum(share, axis=1) > draws[:, None], axis=1)
            ids, picked = found[np.arange(b - a), picked].tolist(), picked.tolist()
            while at > a:
                out.append(ids[at - a - 1])
                at -= picked[at - a - 1] + 1
        spelling, size = self.vocabulary.spelling, self.vocabulary.size
        return np.array([y for x in reversed(out) for y in ((x,) if x < size else spelling[x - size])], np.int32)

    def encode(self, texts: list[str | None], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text): a space is put before each text, as the library does; none for empty ones."""
        n_ids = np.zeros(len(texts), np.int64)
        found: list[np.ndarray] = [np.zeros(0, np.int32)]
        held: list[tuple[int, int, list[str]]] = []
        size = 0

        def flush() -> None:
            if held:
                ids, per_slice = self._sample(held, keys)
                np.add.at(n_ids, [t for t, _, _ in held], per_slice)
                found.append(ids)
                held.clear()

        for t, text in enumerate(texts):
            if text:
                for at, piece in _slices(f" {text}", self.batch_chars):
                    for long, place, parts in _runs(_PART.findall(piece), at, self.window):
                        if long:
                            flush()
                            found.append(self._sample_long(parts[0], place, keys[t]))
                            n_ids[t] += len(found[-1])
                        else:
                            held.append((t, place, parts))
                    size += len(piece)
                    if size >= self.batch_chars:
                        flush()
                        size = 0
        flush()
        return np.concatenate(found), n_ids


def _runs(parts: list[str], at: int, window: int) -> Iterator[tuple[bool, int, list[str]]]:
    """(is one long part, place, parts) in order."""
    if max(map(len, parts)) <= window:
        yield False, at, parts
        return
    for long, some in groupby(parts, lambda p: len(p) > window):
        for run in ([p] for p in some) if long else (list(some),):
            yield long, at, run
            at += sum(map(len, run))


def _slices(text: str, most: int) -> Iterator[tuple[int, str]]:
    """Cuts between parts, so that a very long text needs little memory at a time."""
    at = 0
    while len(text) - at > most:
        cut = at + most
        while cut < len(text) and not (text[cut] == " " != text[cut - 1]) and text[cut - 1] != "\n":
            cut += 1
        yield at, text[at:cut]
        at = cut
    if at < len(text):
        yield at, text[at:]


def _smaller(batches: Iterator[tuple[pa.Array, ...]], most_rows: int = 512) -> Iterator[tuple[pa.Array, ...]]:
    """The same rows in shorter batches, as what they become is larger than they are."""
    for arrays in batches:
        for at in range(0, len(arrays[0]), most_rows):
            yield tuple(a.slice(at, most_rows) for a in arrays)


@lru_cache(2)
def _encoder(path: str, alpha: float) -> Encoder:
    """Loaded once in a Python worker."""
    return Encoder(Vocabulary(path, alpha))


def _sampled(encoder: Encoder, keys: pa.Array, texts: pa.Array, seed: int) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    """(pieces, their ids, where each text's begin and end)."""
    hashed = [xxhash.xxh64_intdigest("" if k is None else k, seed) for k in keys.to_pylist()]
    ids, n = encoder.encode(texts.to_pylist(), hashed)
    offsets = np.concatenate([[0], np.cumsum(n)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=texts.is_null()), ids, offsets


def _spelt_out(table: list[bytes], ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The texts of ids, without the space that encoding put before them."""
    each = list(map(table.__getitem__, ids.tolist()))
    return [b"".join(each[a:b]).removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", seed: int = 0, alpha: float = 1.0, into: str = "pieces", check: str | None = None) -> DataFrame:
    """``docs`` with an array of sampled piece ids.

    Equal keys, texts and seeds give equal arrays, wherever they run. A null
    text has a null array, an empty one an empty array; a null key is a key
    like any other, and repeated rows get the same ids. A very long text is
    sampled slice by slice, one without any space stretch by stretch, to the
    same effect. ``alpha`` above 1 favours frequent pieces more, 0 makes all
    pieces equal. Other columns stay; one named as ``into`` is an error.
    With ``check`` there is a column of that name too, which tells whether
    the pieces, decoded in the same task, give the text again; null is its
    own decoding.
    """
    clash = {x.lower() for x in (into, check) if x} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist")

    if check is None:

        @F.arrow_udf("array<int>")
        def sampled(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            encoder = _encoder(tokenizer, alpha)
            for keys, texts in _smaller(batches):
                yield _sampled(encoder, keys, texts, seed)[0]

        return docs.withColumn(into, sampled(F.col(id_col).cast("string"), F.col(text)))

    @F.arrow_udf("pieces array<int>, same boolean")
    def checked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encoder = _encoder(tokenizer, alpha)
        for keys, texts in _smaller(batches):
            pieces, ids, offsets = _sampled(encoder, keys, texts, seed)
            same = [a == (b or "") for a, b in zip(_spelt_out(encoder.vocabulary.bytes, ids, offsets), texts.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([pieces, pa.array(same, pa.bool_())], names=["pieces", "same"])

    both = fresh(docs, "checked")
    out = docs.withColumn(both, checked(F.col(id_col).cast("string"), F.col(text)))
    return out.withColumns({into: F.col(f"{both}.pieces"), check: F.col(f"{both}.same")}).drop(both)


def decode(encoded: DataFrame, tokenizer: str, pieces: str = "pieces", into: str = "decoded", alpha: float = 1.0) -> DataFrame:
    """``encoded`` with the text of its piece ids: exactly what was encoded.

    A null array gives null, an empty one the empty text; ids that no text
    has, such as control pieces, stand for nothing. Rows are decoded one by
    one, so repeats and other columns stay as they are; one named as ``into``
    is an error.
    """
    if into.lower() in {c.lower() for c in encoded.columns}:
        raise ValueError(f"column {into!r} exists")

    @F.arrow_udf("string")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _encoder(tokenizer, alpha).vocabulary.bytes
        for (arrays,) in _smaller((a,) for a in batches):
            # A slice keeps the whole array's values; its offsets are into these.
            offsets = arrays.offsets.to_numpy()
            ids = arrays.values[offsets[0] : offsets[-1]].to_numpy(zero_copy_only=False)
            texts = _spelt_out(table, ids, offsets - offsets[0])
            yield pa.array([t if there else None for t, there in zip(texts, arrays.is_valid().to_pylist(), strict=True)], pa.string())

    return encoded.withColumn(into, joined(F.col(pieces)))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, pieces, lossless) for every document.

    A null text has null pieces and none of them, an empty one an empty
    array; both are lossless. One row for each row of the table, repeated or
    not; an empty table gives no rows.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = encode(docs, tokenizer_path("piece_bpe_32k.model"), check="lossless")
    return found.select("doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), "pieces", "lossless")


def with_pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pipeline stage: the sampled pieces beside each document.

    As :func:`encode` has it: null texts have null pieces, empty ones none,
    repeated rows the same. The new column is ``pieces``, or that with
    underscores before it where the table has one. No rows give no rows.
    """
    return encode(docs, tokenizer, into=fresh(docs, "pieces"))
