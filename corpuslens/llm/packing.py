"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents become token ids; longer ones are cut, the shorter piece first. Pieces
are placed in bulk-synchronous rounds, from the largest sizes down: unplaced
pieces and the gaps of open sequences are range-sorted together by size, every
partition sweeps its rows and gives each piece its successor, the smallest free
gap that holds it, and what a partition can't match within itself is matched
with gaps of the partitions before it by rank. Then gaps are updated, and the
next round begins. No step holds more than a range partition in a task; the
driver sees counts of sizes and of partitions only.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import Store, parallelism, tidy
from .quality import _slices as slices

CAPACITY, END = 1024, 2
#: Rows of a range partition of a round, if the session's partitions suffice.
SWEEP_ROWS = 20_000
#: Spelt units that a worker keeps, and the longest of them, in bytes.
KEPT_UNITS, KEPT_LENGTH = 500_000, 64
#: Bytes of text encoded at once.
SLICE = 1 << 23
#: Units spelt in one call, a line feed between them.
JOINED = 1000

#: What a byte is, one bit each.
VISIBLE, SPACE, WORD, SIGN, UPPER, LEAD, C3, NO_LETTER = (1 << i for i in range(8))


def _kinds() -> np.ndarray:
    """The bits of all bytes: a visible ASCII sign, white space, a letter or digit, a sign that ends a run of these (an apostrophe may begin a contraction), a byte over 7F, the lead of a two-byte letter, C3, and what follows C3 in the two signs that are no letters."""
    out = np.zeros(256, np.uint8)
    out[33:127] |= VISIBLE
    out[[9, 10, 13, 32]] |= SPACE
    out[[c for c in range(128) if chr(c).isalnum()]] |= WORD
    out[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'\\^`"]] |= SIGN
    out[128:] |= UPPER
    out[0xC3:0xE0] |= LEAD
    out[0xC3] |= C3
    out[[0x97, 0xB7]] |= NO_LETTER
    return out


_KINDS = _kinds()


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Where a byte-level model with blank-led words begins a token whatever else the text holds.

    A token that is not white space has at most one blank, in front. So tokens end
    before white space that follows anything else; after a lone line feed between
    signs that are none; and between letters or digits and a sign. The byte before
    is an ASCII sign or ends a two-byte letter (of a lead from C3 up), which no
    white space does.
    """
    kind = _KINDS[data]
    before, before2 = np.zeros_like(kind), np.zeros_like(kind)
    before[1:], before2[2:] = kind[:-1], kind[:-2]
    latin = ((before & UPPER) != 0) & ((before2 & LEAD) != 0)
    out = ((kind & SPACE) != 0) & (((before & VISIBLE) != 0) | latin)
    feed = out[:-1] & (data[:-1] == 10) & ((kind[1:] & VISIBLE) != 0)
    letter = ((before & WORD) != 0) | (latin & ((before2 & C3) != 0) & ((before & NO_LETTER) == 0))
    out |= ((kind & SIGN) != 0) & letter
    out[1:] |= feed
    return out


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit words, from a tokenizers file.

    Where the model is byte-level and its words begin with their blank, a text's
    ids are those of its units in a row; equal units are spelt once and kept. Texts
    of other models, and texts that hold an added token's name, are spelt whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        split = known.get("pre_tokenizer") or {}
        self.cuts = not known.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        if self.cuts:  # bytes of each id: a sign of a token's name is a byte, added tokens are themselves
            added = {x["id"]: len(x["content"].encode()) for x in known.get("added_tokens", [])}
            self.added = [x["content"] for x in known.get("added_tokens", [])]
            names = self.model.get_vocab(with_added_tokens=True)
            self.size = np.zeros(max(names.values()) + 1, np.int64)
            for name, i in names.items():
                self.size[i] = added.get(i, len(name))
            self.cuts = len(self._alone(["\n"])[0]) == 1
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.many, self.ids, self.uses = {}, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Keeps the units that came more than once, if they are few enough."""
        kept = [(u, p) for u, p in self.known.items() if self.uses[p] > 1]
        at, many, ids = self.at, self.many, self.ids
        self._forget()
        if 2 * len(kept) < KEPT_UNITS and kept:
            old = np.array([p for _, p in kept])
            self.known = {u: i for i, (u, _) in enumerate(kept)}
            self.many, self.uses = many[old], np.ones(len(old), np.int64)
            self.at = np.cumsum(self.many) - self.many
            self.ids = ids[np.repeat(at[old] - self.at, self.many) + np.arange(self.many.sum())]

    def _alone(self, texts: list) -> list:
        return [np.array(e.ids, np.uint32) for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def _spelt(self, units: list) -> list:
        """The ids of each unit (bytes): lines of units are spelt together and cut where the units end."""
        plain = lambda u: 32 < u[-1] < 127 and (32 < u[0] < 127 or (u[0] == 32 and len(u) > 1 and 32 < u[1] < 127))
        out: list = [None] * len(units)
        lined = [i for i, u in enumerate(units) if plain(u)]
        lines = [lined[k:k + JOINED] for k in range(0, len(lined), JOINED)]
        for line, ids in zip(lines, self._alone([b"\n".join([units[i] for i in line]).decode() for line in lines])):
            ends = np.cumsum(self.size[ids])
            wanted = np.cumsum([len(units[i]) + 1 for i in line])
            last = np.searchsorted(ends, wanted - 1)  # the token that ends with the unit; then comes the line feed's
            if (ends[last] != wanted - 1).any() or (ends[last[:-1] + 1] != wanted[:-1]).any():
                continue
            first = np.concatenate(([0], last[:-1] + 2))
            for i, lo, hi in zip(line, first.tolist(), (last + 1).tolist()):
                out[i] = ids[lo:hi]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._alone([units[i].decode() for i in rest])):
            out[i] = ids
        return out

    def __call__(self, texts: list) -> list:
        whole = [i for i, t in enumerate(texts) if not self.cuts or any(x in t for x in self.added)]
        out = self._by_units([t if i not in whole else "" for i, t in enumerate(texts)] if whole else texts) if self.cuts else [b""] * len(texts)
        for i, ids in zip(whole, self._alone([texts[i] for i in whole]) if whole else []):
            out[i] = ids.astype("<u4").tobytes()
        return out

    def _by_units(self, texts: list) -> list:
        raw = [t.encode() for t in texts]
        if not any(raw):
            return [b""] * len(texts)
        ends = np.cumsum([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts = unit_starts(data)
        starts[ends[ends < len(data)]] = True
        starts[0] = True
        edges = np.append(np.flatnonzero(starts), len(data)).astype(np.int64)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        names = units.dictionary.to_pylist()
        place = np.array([self.known.get(u, -1) for u in names], np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            spelt = self._spelt([names[i] for i in new.tolist()])
            place[new] = len(self.at) + np.arange(len(new))
            self.known.update((names[i], p) for i, p in zip(new.tolist(), place[new].tolist()) if len(names[i]) <= KEPT_LENGTH)
            many = np.array([len(x) for x in spelt], np.int64)
            self.at = np.concatenate((self.at, len(self.ids) + np.cumsum(many) - many))
            self.many, self.ids, self.uses = np.concatenate((self.many, many)), np.concatenate((self.ids, *spelt)), np.concatenate((self.uses, np.zeros(len(new), np.int64)))
        self.uses[place] += 1
        unit = place[units.indices.to_numpy()]
        many = self.many[unit]
        upto = np.concatenate(([0], np.cumsum(many)))
        code = self.ids[np.repeat(self.at[unit] - upto[:-1], many) + np.arange(upto[-1])].astype("<u4")
        cut = upto[np.searchsorted(edges, np.concatenate(([0], ends)))]
        if len(self.at) > KEPT_UNITS:
            self._shrink()
        return [code[lo:hi].tobytes() for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist())]


_encoders: dict = {}


def _encoder(path: str) -> Encoder:
    """The worker's encoder of a file, kept from task to task: this function is imported there, not sent."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): documents as token ids and `end`, in pieces of at most `capacity`.

    A document of more ids is cut into pieces of `capacity`, but for the first,
    which takes the remainder. A null text is empty: one piece, `end` alone. Rows
    that repeat a doc_id, or have none, are documents of their own. ids are
    little-endian 32-bit words; ids_crc32 is their unsigned CRC-32.
    """
    last = int(end).to_bytes(4, "little")

    def arrow(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            for at, size in slices(batch.column("text"), SLICE):
                part = batch.slice(at, size)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, code in enumerate(encoder([t or "" for t in part.column("text").to_pylist()])):
                    code += last
                    n, at, k = len(code) // 4, 0, 0
                    while at < n:
                        take = (n - at) % capacity or capacity
                        own = code[4 * at:4 * (at + take)]
                        row.append(i), piece.append(k), start.append(at), length.append(take), crc.append(zlib.crc32(own))
                        if keep_ids:
                            ids.append(own)
                        at, k = at + take, k + 1
                columns = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(tidy(arrow), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else ""))


def swept(order: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One partition's sweep: each piece's gap row or -1, and what is left of each gap row's slots; also which rows are gaps.

    order ascends; it is -(2 * size + 1) for gaps and -(2 * size) for pieces, so
    sizes fall and a gap stands before the pieces that fill it. A piece takes the
    nearest free slot before it. slots is a gap's number of slots.
    """
    gap = (order & 1).astype(bool)
    upto = np.cumsum(np.where(gap, slots, 0))
    edges = np.concatenate(([0], np.flatnonzero(np.diff(order)) + 1, [len(order)]))
    taken = np.full(len(order), -1, np.int64)  # a piece's slot
    free: list = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if lo == hi:
            continue
        if gap[lo]:
            free.append([int(upto[lo] - slots[lo]), int(upto[hi - 1])])
            continue
        while lo < hi and free:
            top = free[-1]
            n = min(hi - lo, top[1] - top[0])
            taken[lo:lo + n] = np.arange(top[1] - 1, top[1] - 1 - n, -1)
            lo, top[1] = lo + n, top[1] - n
            if top[0] == top[1]:
                free.pop()
    hit = np.flatnonzero(taken >= 0)
    rows = np.flatnonzero(gap)
    own = np.full(len(order), -1, np.int64)
    own[hit] = rows[np.searchsorted(upto[rows], taken[hit], side="right")]
    left = np.where(gap, slots, 0) - np.bincount(own[hit], minlength=len(order))
    return own, left, gap


def across(counts: list) -> tuple[list, list]:
    """Matches between partitions, from (partition, unmatched pieces, free slots) in their order.

    Returns (partition, from, to, of, top): pieces ranked from..to take the slots
    of partition `of` below `top`, downwards; and (partition, low): slots from low on are taken.
    """
    free, pairs, low = [], [], {}
    for p, need, slots in sorted(counts):
        at = 0
        while need and free:
            q, top = free[-1]
            n = min(need, top)
            pairs.append((p, at, at + n, q, top))
            at, need, low[q] = at + n, need - n, top - n
            free[-1][1] = top - n
            if not free[-1][1]:
                free.pop()
        if slots:
            free.append([p, slots])
    return pairs, sorted(low.items())


_SWEPT = "kind int, part int, id long, length long, seq long, at long, n long"
MATCHED, OPEN_PIECE, OPEN_GAP, SUMMARY = range(4)


def _sweep(unplaced: DataFrame, gaps: DataFrame, high: int, parts: int) -> DataFrame:
    """Rows of MATCHED, OPEN_PIECE, OPEN_GAP and SUMMARY kind from one round's range-sorted sweep.

    A gap that holds several pieces of any size up to `high` is so many equal slots.
    """
    slots = F.greatest(F.floor(F.col("gap") / high), F.lit(1))
    rows = unplaced.select((F.col("length") * -2).alias("ord"), F.col("uid").alias("id"), F.lit(0).cast("long").alias("slots")).unionByName(
        gaps.select((F.floor(F.col("gap") / slots) * -2 - 1).alias("ord"), F.col("seq").alias("id"), slots.cast("long").alias("slots"))
    )

    def arrow(batches):
        read = [(b.column("part")[0].as_py(), *(b.column(x).to_numpy() for x in ("ord", "id", "slots"))) for b in batches if b.num_rows]
        if not read:
            return
        order, ids, many = (np.concatenate([r[i] for r in read]) for i in (1, 2, 3))
        own, left, gap = swept(order, many)
        size, none = -(order >> 1), np.int64(0)
        hit, out, rest = np.flatnonzero(own >= 0), np.flatnonzero(~gap & (own < 0)), np.flatnonzero(left > 0)
        zero = lambda x: np.full(len(x), none)
        columns = (
            (MATCHED, ids[hit], size[hit], ids[own[hit]], zero(hit), zero(hit)),
            (OPEN_PIECE, ids[out], size[out], zero(out), np.arange(len(out)), zero(out)),
            (OPEN_GAP, zero(rest), zero(rest), ids[rest], np.cumsum(left[rest]) - left[rest], left[rest]),
            (SUMMARY, *(np.array([x], np.int64) for x in (0, 0, len(hit), len(out), left.sum()))),
        )
        for kind, *values in columns:
            n = len(values[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, read[0][0], np.int32)), *(pa.array(v.astype(np.int64)) for v in values)], names=["kind", "part", "id", "length", "seq", "at", "n"]
            )

    ordered = rows.repartitionByRange(parts, "ord", "id").sortWithinPartitions("ord", "id").withColumn("part", F.spark_partition_id())
    return ordered.mapInArrow(tidy(arrow), _SWEPT)


def placed(items: DataFrame, capacity: int, store: Store) -> DataFrame:
    """(uid, length, seq) of items (uid, length), a written table with lengths from 1 to capacity; uid is 0 or more and unique.

    A sequence that an item opens has its uid as number, others have negative
    numbers. Bands of sizes (capacity / (j + 1), capacity / j] are placed from the
    largest down, as in best-fit decreasing; an item of more than half the
    capacity opens a sequence, others get new ones only when no gap holds them.
    """
    spark = items.sparkSession
    # At most `capacity` rows.
    sizes = sorted((r["length"], r["n"]) for r in items.groupBy("length").agg(F.count("*").alias("n")).collect())
    if not sizes:
        return items.select("uid", "length", F.col("uid").alias("seq"))
    half, least = capacity // 2, sizes[0][0]
    own = items.where(F.col("length") > half).select("uid", "length", F.col("uid").alias("seq"))
    done = [own]
    gaps = own.select("seq", (F.lit(capacity) - F.col("length")).alias("gap")).where(F.col("gap") >= least)
    most = max([capacity - x for x, _ in sizes if x > half], default=0)
    opened, fresh = sum(n for x, n in sizes if half < x < capacity), 0
    bands = sorted({capacity // j for j in (*range(2, 9), 16) if capacity // j} | {0}, reverse=True)
    for high, low in zip(bands, bands[1:]):
        band = [(x, n) for x, n in sizes if low < x <= high]
        if not band:
            continue
        rest = items.where((F.col("length") > low) & (F.col("length") <= high)).select("uid", "length")
        bottom, top, n = band[0][0], band[-1][0], sum(k for _, k in band)
        while n:
            parts = max(1, min(parallelism(spark), -(-(n + opened) // SWEEP_ROWS)))
            sweep = store.put(_sweep(rest, gaps.where(F.col("gap") >= bottom), top, parts), "sweep")
            hit = sweep.where(F.col("kind") == MATCHED).select(F.col("id").alias("uid"), "length", "seq")
            done.append(hit)
            # One row a partition.
            counts = sorted((r["part"], r["at"], r["n"], r["seq"]) for r in sweep.where(F.col("kind") == SUMMARY).collect())
            pairs, lows = across([c[:3] for c in counts])
            out = sweep.where(F.col("kind") == OPEN_PIECE).select("part", F.col("id").alias("uid"), "length", "at")
            if pairs:
                # Two rows a partition at most.
                a = F.broadcast(spark.createDataFrame(pairs, "part int, a long, b long, of int, top long"))
                b = F.broadcast(spark.createDataFrame(lows, "part int, low long"))
                takers = out.join(a, "part").where("at >= a and at < b").select("uid", "length", "of", (F.col("top") - 1 - (F.col("at") - F.col("a"))).alias("slot"))
                free = sweep.where(F.col("kind") == OPEN_GAP).join(b, "part").where("at + n > low")
                free = free.select(F.col("part").alias("of"), "seq", F.explode(F.sequence(F.greatest("at", "low"), F.col("at") + F.col("n") - 1)).alias("slot"))
                crossed = store.put(takers.join(free, ["of", "slot"]).select("uid", "length", "seq"), "crossed")
                done.append(crossed)
                hit = hit.unionByName(crossed)
            matched = sum(c[3] for c in counts) + sum(to - at for _, at, to, _, _ in pairs)
            if matched:
                seen = Observation()
                update = gaps.unionByName(hit.select("seq", (-F.col("length")).alias("gap"))).groupBy("seq").agg(F.sum("gap").alias("gap")).where(F.col("gap") >= least)
                gaps, before = store.put(update.observe(seen, F.max("gap").alias("most")), "gaps"), gaps
                if hasattr(before, "_corpuslens_path"):
                    store.drop(before)
                most = seen.get["most"] or 0
            n -= matched
            if not n:
                break
            # What is left of a partition are its last pieces; numbered over the partitions they are in falling size.
            upto = {p: to for p, _, to, _, _ in pairs}
            known, base = [], 0
            for p, pieces_, _, _ in counts:
                known.append((p, upto.get(p, 0), base))
                base += pieces_ - upto.get(p, 0)
            rest = out.join(F.broadcast(spark.createDataFrame(known, "part int, upto long, base long")), "part").where("at >= upto").select("uid", "length", (F.col("base") + F.col("at") - F.col("upto")).alias("rank"))
            bottom, top, total = rest.agg(F.min("length"), F.max("length"), F.sum("length")).first()
            if matched and most >= bottom:
                continue
            # No gap holds any of them: new sequences, with as many pieces each as fit whatever their sizes.
            each = capacity // top
            more = -(-n // each) if capacity // bottom == each else -(-total // capacity)
            first = rest.where(F.col("rank") < more * each).select("uid", "length", (-1 - fresh - F.floor(F.col("rank") / each)).alias("seq"))
            done.append(first)
            gaps = gaps.unionByName(first.groupBy("seq").agg((F.lit(capacity) - F.sum("length")).alias("gap")).where(F.col("gap") >= least))
            rest = rest.where(F.col("rank") >= more * each)
            n -= min(n, more * each)
            fresh, opened, most = fresh + more, opened + more, max(most, capacity - bottom)
            if n:
                bottom, top = rest.agg(F.min("length"), F.max("length")).first()
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset: where each piece lies, gapless from 0, in sequences of at most `capacity` ids.

    A null doc_id or text, repeated rows and very long texts are as in pieces();
    an empty table gives none. Other columns of docs are not read. Sequence
    numbers are of no meaning.
    """
    store = Store(docs.sparkSession)
    # Numbers are written with the rows, so they stay what they are if a task is lost later.
    cut = store.put(pieces(docs, tokenizer, capacity, end, keep_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    at = placed(cut.select("uid", "length"), capacity, store)
    before = Window.partitionBy("seq").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)  # at most `capacity` pieces
    at = at.select("uid", F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")).alias("offset"))
    return cut.join(at, "uid").drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, ids): the packed sequences themselves, from pack(keep_ids=True)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), joined.alias("ids"))


def tokenizer_of(spark: SparkSession) -> str:
    """The model's file: the session's corpuslens.packing.tokenizer, else the public byte-level model of 50,257 ids."""
    at = spark.conf.get("corpuslens.packing.tokenizer", None)
    if at:
        return at
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
