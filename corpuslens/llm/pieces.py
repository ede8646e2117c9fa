"""SentencePiece sampling without replacement, and decoding.

A text's segmentations into vocabulary pieces are the paths of a lattice, with
probability proportional to exp(theta * sum of piece scores). A perturbed A* search
emits the k segmentations of greatest Gumbel-perturbed log-probability, which is
a sample without replacement: the agenda holds, for each decision on an emitted
path, the set of all paths that leave it there, with the set's perturbed maximum,
a Gumbel of the set's probability truncated at the path's own. Forward sums of
the lattice make these probabilities exact, so every set that leaves the agenda
gives one sample. An inclusion score is the probability that a sample's value
exceeds the (k+1)-th.

Pieces never span a blank, so lattices are built once for each distinct blank-led
unit of a batch, and all units of all its texts walk theirs together. Random
numbers are a hash of seed, row key, sample, unit and step: a row's samples don't
depend on its neighbours or on the partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import mix, powers, range_hash, tidy
from .quality import _slices as slices

#: The model where neither a parameter nor the session's corpuslens.tokenizer.model names one.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = 0x2581
SLICE = 1 << 20
CACHE = 1_000_000
NO_PIECE = -1
#: Lengths that a decision bars are kept as bits of a 64-bit word.
WIDEST = 64


class Vocabulary:
    """The pieces of a model, as arrays; small enough to travel with a task."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_ids, texts, ids, scores = np.full(256, -1, np.int32), [], [], []
        self.surface: list = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
                continue
            ordinary = not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
            self.surface.append(piece.replace(chr(BLANK), " ").encode() if ordinary else b"")
            if ordinary and chr(BLANK) not in piece[1:]:  # runs of blanks are left to single ones
                texts.append(piece), ids.append(i), scores.append(sp.get_score(i))
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        key = range_hash(flat, np.concatenate(([0], ends[:-1])), ends)
        order = np.argsort(key)
        self.key, self.id, self.score = key[order], np.array(ids, np.int32)[order], np.array(scores)[order]
        self.longest = -(-max(len(t) for t in texts) // 8) * 8
        if self.longest > WIDEST:
            raise ValueError(f"{path} has a piece of more than {WIDEST} characters")
        slot = (self.key >> np.uint64(44)).astype(np.int64)
        self.slot = np.full(1 << 20, -1, np.int32)  # keys with the same leading bits are neighbours: the first, and
        self.slot[slot[::-1]] = np.arange(len(slot))[::-1]
        self.crowd = int(np.bincount(slot).max())  # how many there can be
        #: A character without a piece is spelt in bytes, at this score. Pieces that a
        #: model bars by a score like -1e9, the lone blank among them, get it too.
        self.spelt = float(self.score[self.score > -1e8].min()) - 10
        self.score = np.maximum(self.score, self.spelt)
        sizes = np.array([len(s) for s in self.surface])
        self.bytes, self.at = np.frombuffer(b"".join(self.surface), np.uint8), np.concatenate(([0], np.cumsum(sizes)))

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are pieces, and their indices."""
        at = self.slot[(key >> np.uint64(44)).astype(np.int64)]
        some = np.flatnonzero(at >= 0)
        at, key = at[some], key[some]
        hit = self.key[at] == key
        where, index = [some[hit]], [at[hit]]
        for _ in range(1, self.crowd):
            miss = np.flatnonzero(~hit & (at + 1 < len(self.key)))
            some, at, key = some[miss], at[miss] + 1, key[miss]
            hit = self.key[at] == key
            where.append(some[hit]), index.append(at[hit])
        return np.concatenate(where), np.concatenate(index)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that pieces stand for, blanks as spaces; the first is the dummy prefix."""
        begin = self.at[ids]
        size = self.at[ids + 1] - begin
        ends = np.cumsum(size, dtype=np.int32)
        place = np.repeat((begin - ends + size).astype(np.int32), size)
        place += np.arange(len(place), dtype=np.int32)
        return self.bytes[place]


class Lattices:
    """Lattices of distinct units, kept from batch to batch: for each last character and length, piece and conditional probability.

    The units of a batch lie side by side, longest first: all first characters,
    then all second ones, and so on, so a step of all units is one stretch of
    memory. At most `most` characters are kept; when more come, those of the
    present batch stay.
    """

    def __init__(self, vocabulary: Vocabulary, theta: float, most: int = CACHE):
        self.vocabulary, self.theta, self.most = vocabulary, theta, most
        self._reset(1 << 16)

    def _reset(self, room: int) -> None:
        width = self.vocabulary.longest
        self.size, self.known, self.unit = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.steps, self.first, self.rank = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.chars = np.zeros(room, np.uint32)
        self.piece, self.log, self.cum = np.zeros((room, width), np.int32), np.zeros((room, width), np.float32), np.zeros((room, width), np.float32)

    def place(self, unit: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Where the pos-th character (from 1) of each unit lies."""
        return self.steps.take(self.first.take(unit) + (pos - 1)) + self.rank.take(unit)

    def units(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of the lattice of each unit chars[start:end]."""
        key, lead, which = np.unique(range_hash(chars, start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, key), max(0, len(self.known) - 1))
        new = self.known[at] != key if len(self.known) else np.ones(len(key), bool)
        extra = int((end - start)[lead[new]].sum())
        if self.size and self.size + extra > self.most:
            extra = int((end - start)[lead].sum())
            self._reset(max(1 << 16, extra))
            new = np.ones(len(key), bool)
        if new.any():
            self._add(chars, start[lead[new]], end[lead[new]], extra, key[new])
            at = np.searchsorted(self.known, key)
        return self.unit[at][which]

    def _add(self, chars, start, end, extra, key) -> None:
        if self.size + extra > len(self.chars):
            room = max(min(2 * len(self.chars), self.most), self.size + extra)
            for name in ("chars", "piece", "log", "cum"):
                old = getattr(self, name)
                grown = np.empty((room, *old.shape[1:]), old.dtype)
                grown[: self.size] = old[: self.size]
                setattr(self, name, grown)
        size = end - start
        by = np.argsort(-size, kind="stable")
        start, size, key = start[by], size[by], key[by]
        active = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), side="right")
        at = np.concatenate(([0], np.cumsum(active)))
        ends = np.cumsum(size)
        inner = np.arange(extra) - np.repeat(ends - size, size)
        flat = chars[inner + np.repeat(start, size)]
        there = at[inner] + np.repeat(np.arange(len(size)), size)  # from text order to this order
        part = slice(self.size, self.size + extra)
        self.chars[part][there] = flat
        self._build(flat, np.repeat(ends, size), there, at, self.piece[part], self.log[part], self.cum[part])
        number = len(self.first) + np.arange(len(size))
        self.first = np.concatenate((self.first, np.full(len(size), len(self.steps))))
        self.rank = np.concatenate((self.rank, np.arange(len(size))))
        self.steps = np.concatenate((self.steps, self.size + at[:-1]))
        self.size += extra
        order = np.argsort(key)
        spot = np.searchsorted(self.known, key[order])
        self.known, self.unit = np.insert(self.known, spot, key[order]), np.insert(self.unit, spot, number[order])

    def _build(self, chars, limit, there, at, piece, log, cum) -> None:
        v, n = self.vocabulary, len(chars)
        width = v.longest
        piece[:] = NO_PIECE
        logs = np.full((width, n), -np.inf, np.float32)
        p, q = powers(n + 1)
        with np.errstate(over="ignore"):
            h = np.zeros(n + 1, np.uint64)
            np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * p[:n], out=h[1:])
            s, room = np.arange(n), limit - np.arange(n)
            for length in range(1, width + 1):
                on = np.flatnonzero(room >= length)
                s, room = s[on], room[on]
                if not len(s):
                    break
                key = mix((h[s + length] - h[s]) * q[s] + np.uint64((length * 0xD6E8FEB86659FD93) & (2**64 - 1)))
                where, index = v.find(key)
                where = there[s[where] + (length - 1)]
                piece[where, length - 1], logs[length - 1, where] = v.id[index], self.theta * v.score[index]
        logs[0, piece[:, 0] == NO_PIECE] = self.theta * v.spelt
        total = np.zeros(n)
        for step, (low, high) in enumerate(zip(at[:-1].tolist(), at[1:].tolist()), 1):
            count, reach = high - low, min(step, width)
            a = logs[:reach, low:high]
            near = total[at[step - 2]:at[step - 2] + count] if step > 1 else 0.0
            for length in range(2, min(step - 1, width) + 1):  # sums relative to the last character's keep their precision
                a[length - 1] += total[at[step - length - 1]:at[step - length - 1] + count] - near
            if step <= width:
                a[step - 1] -= near
            top = a.max(0)
            a -= top
            e = np.exp(a)
            for length in range(1, reach):
                e[length] += e[length - 1]
            z = np.log(e[reach - 1])
            total[low:high] = near + top + z
            a -= z
            e /= e[reach - 1].copy()
            log[low:high], cum[low:high, reach:] = logs[:, low:high].T, 1
            cum[low:high, :reach] = e.T


def _uniform(key: np.ndarray, stream: int, step) -> np.ndarray:
    """A number in (0, 1) for each key and step of a stream."""
    with np.errstate(over="ignore"):
        x = mix(key + (np.asarray(step, np.int64).astype(np.uint64) + np.uint64(stream << 40)) * np.uint64(0x9E3779B97F4A7C15))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


class Walk:
    """Decisions on paths: for each the unit occurrence, step, last character, length, log-probability, mass left."""

    __slots__ = ("occ", "step", "pos", "c", "length", "logp", "rest", "mask")

    def __init__(self, *columns):
        for name, column in zip(self.__slots__, columns):
            setattr(self, name, column)

    def take(self, index) -> Walk:
        return Walk(*(getattr(self, x).take(index) if index.dtype != bool else getattr(self, x)[index] for x in self.__slots__))

    def scatter(self, place) -> Walk:
        out = []
        for x in self.__slots__:
            column = getattr(self, x)
            moved = np.empty_like(column)
            moved[place] = column
            out.append(moved)
        return Walk(*out)

    @staticmethod
    def merge(walks: list) -> Walk:
        return Walk(*(np.concatenate([getattr(w, x) for w in walks]) for x in Walk.__slots__))


def _walk(lat: Lattices, unit: np.ndarray, occ: np.ndarray, pos: np.ndarray, step: np.ndarray, mask: np.ndarray, key: np.ndarray, sample: int) -> Walk:
    """Draws each occurrence's pieces from position pos down to its start; mask bars lengths at the first step."""
    width = lat.log.shape[1]
    bit = np.uint64(1) << np.arange(width, dtype=np.uint64)
    flat = lat.log.reshape(-1)
    out, barred, first_occ, first_step = [], mask.any(), occ, step
    base, rank = lat.first.take(unit) - 1, lat.rank.take(unit)
    while len(occ):
        c = lat.steps.take(base.take(occ) + pos) + rank.take(occ)
        draw = _uniform(key.take(occ), sample, step)
        cum = lat.cum.take(c, 0)
        if barred:  # only a few: the decisions at which paths leave earlier ones
            few = np.flatnonzero(mask)
            p = np.exp(lat.log[c[few]].astype(np.float64))
            p[(mask[few, None] & bit) > 0] = 0
            part = np.cumsum(p, 1)
            cum[few] = part / part[:, -1:]
        draw = np.minimum(draw.astype(np.float32), np.float32(1 - 2.0**-24))  # below 1, where every row of cum ends
        words = np.bitwise_count((cum <= draw[:, None]).view(np.uint64))  # a row's flags are whole words
        length = words[:, 0].astype(np.int32)
        for j in range(1, words.shape[1]):
            length += words[:, j]
        logp = flat.take(c.astype(np.int64) * width + length).astype(np.float64)
        rest = -np.expm1(logp)
        if barred:
            p[np.arange(len(few)), length[few]] = 0
            rest[few] = p.sum(1)
        out.append(Walk(occ, step, pos, c, length + 1, logp, rest, mask))
        pos, step = pos - length - 1, step + 1
        on = pos > 0
        occ, pos, step, barred = occ[on], pos[on], step[on], False
        mask = np.zeros(len(occ), np.uint64)
    if not out:
        e = np.zeros(0, np.int64)
        return Walk(e, e, e, e, e, e.astype(float), e.astype(float), e.astype(np.uint64))
    w = Walk.merge(out)
    # By occurrence and step: an occurrence's steps are consecutive, so places are counted, not sorted.
    count = np.bincount(w.occ, minlength=len(unit))
    at = np.cumsum(count) - count
    at[first_occ] -= first_step
    return w.scatter(at[w.occ] + w.step)


def sample_batch(texts: list, keys: np.ndarray, k: int, lat: Lattices, seed: int) -> list:
    """For each sample number: (text index, ids, ends of each text's ids, log-probability, log-inclusion).

    A text with fewer segmentations than k gives all of them, with inclusion 1 (logarithm 0).
    """
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    full = np.flatnonzero([len(c) > 0 for c in codes])
    if not len(full):
        return []
    blank = np.array([BLANK], np.uint32)
    chars = np.concatenate([x for i in full for x in (blank, codes[i])])
    chars[chars == 32] = BLANK
    first = np.concatenate(([0], np.cumsum([len(codes[i]) + 1 for i in full])))
    u_start = np.flatnonzero(chars == BLANK)
    u_end = np.append(u_start[1:], len(chars))
    u_text = np.searchsorted(first, u_start, side="right") - 1
    unit = lat.units(chars, u_start, u_end)
    length = u_end - u_start
    n = len(full)
    row_key = mix(keys[full].astype(np.uint64) ^ mix(np.full(n, seed, np.uint64)))
    with np.errstate(over="ignore"):
        inner = np.arange(len(unit)) - np.searchsorted(u_text, np.arange(n))[u_text]
        key = mix(row_key[u_text] + inner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    value = _gumbel(_uniform(row_key, 0, 0))
    length = length.astype(np.int32)
    occ = np.arange(len(unit), dtype=np.int32)
    whole = _walk(lat, unit, occ, length, np.zeros(len(occ), np.int32), np.zeros(len(occ), np.uint64), key, 1)
    paths, out, alive = [], [], np.arange(n)
    branch = np.zeros(n, np.int64)  # each text's first new decision
    for number in range(1, k + 1):
        text = u_text.take(whole.occ)
        at = np.searchsorted(text, np.arange(n + 1))
        done = np.cumsum(whole.logp)
        base = np.where(at[:-1] > 0, done[at[:-1] - 1], 0.0)
        before = done - whole.logp - base[text]
        # Of a path's sets the one with the greatest free value has the greatest truncated value too.
        with np.errstate(divide="ignore"):
            entry = before + np.log(np.maximum(whole.rest, 0)) + _gumbel(_uniform(key.take(whole.occ), 1000 + number, whole.step))
        entry[np.arange(len(text)) - at[text] < branch[text]] = -np.inf
        total = np.where(at[1:] > at[:-1], done[np.maximum(at[1:] - 1, 0)] - base, 0.0)
        paths.append((whole, at, entry, value))
        out.append([alive, whole, at, total[alive]])
        # The agenda's best entry of each text.
        best, source, free = np.full(n, -np.inf), np.zeros(n, np.int64), np.full(n, -np.inf)
        for j, (_, a, e, bound) in enumerate(paths):
            has = np.flatnonzero(a[1:] > a[:-1])
            if not len(has):
                continue
            g = np.full(n, -np.inf)
            g[has] = np.maximum.reduceat(e, a[:-1][has])
            some = np.flatnonzero(np.isfinite(g))
            top = np.full(n, -np.inf)
            top[some] = -np.logaddexp(-bound[some], -g[some])
            better = top > best
            best[better], source[better], free[better] = top[better], j, g[better]
        alive = np.flatnonzero(np.isfinite(best))
        if number == k or not len(alive):
            break
        parts, again = [], []
        branch = np.zeros(n, np.int64)
        for j, (w, a, e, _) in enumerate(paths):
            mine = alive[source[alive] == j]
            if not len(mine):
                continue
            many = a[mine + 1] - a[mine]
            owner = np.repeat(mine, many)
            rows = np.arange(int(many.sum())) + np.repeat(a[mine] - (np.cumsum(many) - many), many)
            hit = rows[e[rows] == free[owner]]
            _, only = np.unique(u_text[w.occ[hit]], return_index=True)
            hit = hit[only]
            branch[mine] = hit - a[mine]
            parts.append(w.take(rows[rows < np.repeat(hit, many)]))
            again.append((w.occ[hit], w.pos[hit], w.step[hit], w.mask[hit] | (np.uint64(1) << (w.length[hit] - 1).astype(np.uint64))))
            e[hit] = -np.inf
        value = best
        b_occ, b_pos, b_step, b_mask = (np.concatenate(x) for x in zip(*again))
        b_of = np.full(n, len(unit))
        b_of[u_text[b_occ]] = b_occ
        later = np.flatnonzero(occ > b_of[u_text])
        fresh = _walk(
            lat, unit, np.concatenate((b_occ, later)), np.concatenate((b_pos, length[later])), np.concatenate((b_step, np.zeros(len(later), np.int32))),
            np.concatenate((b_mask, np.zeros(len(later), np.uint64))), key, number + 1,
        )
        # A path is what it shares with an earlier one, then its own decisions.
        parts = Walk.merge(parts)
        shared, own = u_text[parts.occ], u_text[fresh.occ]
        n_shared, n_own = np.bincount(shared, minlength=n), np.bincount(own, minlength=n)
        offset = np.cumsum(n_shared + n_own) - (n_shared + n_own)
        by = np.argsort(shared, kind="stable")  # parts come from several earlier paths, each by text
        rank = np.empty(len(shared), np.int64)
        rank[by] = np.arange(len(shared))
        place = np.concatenate((offset[shared] + rank - (np.cumsum(n_shared) - n_shared)[shared], offset[own] + n_shared[own] + np.arange(len(own)) - (np.cumsum(n_own) - n_own)[own]))
        whole = Walk.merge([parts, fresh]).scatter(place)
    results = []
    for live, w, at, total in out:
        with np.errstate(over="ignore", under="ignore"):
            x = total - best[live]
            score = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.clip(x, -30, 700)))))
        # Decisions of a unit run from its end to its start; the ids run forwards.
        size = np.bincount(w.occ, minlength=len(unit))
        last = np.cumsum(size) - 1
        order = (2 * last - size + 1)[w.occ] - np.arange(len(w.occ))
        ids, counts = _ids(lat, w.c[order], w.length[order])
        ends = np.concatenate(([0], np.cumsum(counts)))[at[1:]]
        results.append((full[live], ids, np.concatenate(([0], ends[live])), total, score))
    return results


def _ids(lat: Lattices, c: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of decisions, spelt characters as bytes, and how many ids each has."""
    ids = lat.piece.reshape(-1).take(c.astype(np.int64) * lat.piece.shape[1] + length - 1)
    spelt = np.flatnonzero(ids == NO_PIECE)
    counts = np.ones(len(ids), np.int64)
    if not len(spelt):
        return ids, counts
    kinds, which = np.unique(lat.chars[c[spelt]], return_inverse=True)
    raw = [chr(x).encode("utf-8", "surrogatepass") for x in kinds.tolist()]
    counts[spelt] = np.array([len(r) for r in raw])[which]
    out = np.repeat(ids, counts)
    table = np.zeros((len(raw), 4), np.int32)
    for i, r in enumerate(raw):
        table[i, : len(r)] = lat.vocabulary.byte_ids[list(r)]
    at = (np.cumsum(counts) - counts)[spelt]
    many = counts[spelt]
    inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    out[np.repeat(at, many) + inside] = table[np.repeat(which, many), inside]
    return out, counts


def sample(
    docs: DataFrame, k: int = 2, theta: float = 1e-3, seed: int = 1, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE, slice_bytes: int = SLICE
) -> DataFrame:
    """(id, sample, ids, log_prob, log_inclusion, exact): up to k distinct segmentations of every text.

    Samples are numbered from 1 by falling perturbed value. exact says that the
    ids decode to the text; a text that holds U+2581, the model's sign for a blank,
    decodes to a blank there and isn't exact. A null or empty text has one sample without ids, of
    probability and inclusion 1. Rows with the same id, null included, and the
    same text get the same samples. cache (characters of lattices kept, 200 bytes
    each) and slice_bytes bound a task's memory; they don't change results.
    """
    vocabulary = Vocabulary(model or docs.sparkSession.conf.get("corpuslens.tokenizer.model", MODEL))
    src = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col).cast("string")).alias("_key"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches):
        lattices = Lattices(vocabulary, theta, cache)
        for b in batches:
            for part in slices(b.column("text"), slice_bytes):
                piece = b.slice(*part)
                texts = [t or "" for t in piece.column("text").to_pylist()]
                raw = [t.encode("utf-8", "surrogatepass") for t in texts]
                none = np.flatnonzero([not t for t in texts])
                if len(none):
                    yield batch(piece, none, 1, np.zeros(0, np.int32), np.zeros(len(none) + 1, np.int64), np.zeros(len(none)), np.zeros(len(none)), np.ones(len(none), bool))
                for number, (live, ids, ends, logp, score) in enumerate(sample_batch(texts, piece.column("_key").to_numpy(zero_copy_only=False), k, lattices, seed), 1):
                    if not len(live):
                        continue
                    text = vocabulary.decode(ids).tobytes()
                    cuts = np.concatenate(([0], np.cumsum(vocabulary.at[ids + 1] - vocabulary.at[ids])))[ends]
                    exact = [text[x + 1:y] == raw[i] for i, x, y in zip(live.tolist(), cuts[:-1].tolist(), cuts[1:].tolist())]
                    yield batch(piece, live, number, ids, ends, logp, score, np.array(exact))

    def batch(piece, rows, number, ids, ends, logp, score, exact):
        arrays = [
            piece.column("_id").take(pa.array(rows)), pa.array(np.full(len(rows), number, np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32())),
            pa.array(logp, pa.float64()), pa.array(score, pa.float64()), pa.array(exact, pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["_id", "sample", "ids", "log_prob", "log_inclusion", "exact"])

    out = src.mapInArrow(tidy(run), f"_id {kind}, sample int, ids array<int>, log_prob double, log_inclusion double, exact boolean")
    return out.withColumnRenamed("_id", id_col)


def decode(df: DataFrame, ids_col: str = "ids", to: str = "text", model: str | None = None) -> DataFrame:
    """df with the text that each row's ids stand for; null ids give a null text."""
    vocabulary = Vocabulary(model or df.sparkSession.conf.get("corpuslens.tokenizer.model", MODEL))

    def run(batches):
        for b in batches:
            lists = b.column(ids_col).to_pylist()
            texts = [None if x is None else vocabulary.decode(np.array(x, np.int64)).tobytes()[1:].decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, to])

    return df.mapInArrow(tidy(run), StructType([*df.schema.fields, StructField(to, StringType())]))
