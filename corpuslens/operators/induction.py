"""Suffix induction by description length, and synthetic sequences from a Markov model."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import suffixes
from .nulls import repeated


def _coded(words: DataFrame, names: list, stem: int, longest: int) -> DataFrame:
    """(f, cut, size, s0.., e1..): types as numbers: the stem that each cut leaves, numbered within the partition, and the ending's place in names, -1 where there is none."""
    cols = [*(f"s{j}" for j in range(longest + 1)), *(f"e{j}" for j in range(1, longest + 1))]

    def run(batches):
        known = {e: i for i, e in enumerate(names)}
        whole = [b for b in batches if b.num_rows]
        if whole:
            rows = pa.Table.from_batches(whole)
            w = rows.column("w").to_pylist()
            stems = [x[: len(x) - j] if not j or len(x) - j >= stem else x for j in range(longest + 1) for x in w]
            ends = [known.get(x[-j:], -1) if len(x) - j >= stem else -1 for j in range(1, longest + 1) for x in w]
            s = pd.factorize(np.array(stems, object))[0].astype(np.int32).reshape(longest + 1, -1)
            e = np.array(ends, np.int32).reshape(longest, -1)
            size = np.fromiter(map(len, w), np.int32, len(w))
            fixed = [rows.column("f").combine_chunks(), pa.array(np.zeros(len(w), np.int32)), pa.array(size)]
            yield from pa.Table.from_arrays([*fixed, *map(pa.array, s), *map(pa.array, e)], ["f", "cut", "size", *cols]).to_batches(50_000)

    return words.mapInArrow(run, ", ".join(["f long", "cut int", "size int", *(f"{c} int" for c in cols)]))


def _logs(counts: np.ndarray) -> np.ndarray:
    """log2(c + 1) of whole numbers, each distinct one taken once."""
    few, at = np.unique(counts, return_inverse=True)
    return np.array([math.log2(c + 1) for c in few.tolist()])[at]


class _Words:
    """The types of one bucket, in order, with how many letters each gives to its ending: all types that can share a stem are here."""

    def __init__(self, batches: list, code: dict):
        self.rows, self.code = pa.Table.from_batches(batches), code
        own = lambda c: self.rows.column(c).to_numpy()
        self.f, self.cut, self.size = own("f"), own("cut").copy(), own("size")
        self.s = np.stack([own(f"s{j}") for j in range(code["longest"] + 1)])
        # The empty ending comes after the names.
        self.e = np.stack([np.full(len(self.f), len(code["names"]), np.int32), *(own(f"e{j}") for j in range(1, code["longest"] + 1))])
        self.many, self.at = int(self.s.max()) + 1, np.arange(len(self.f))
        self.letters = np.zeros(self.many, np.int64)
        for j in range(code["longest"], -1, -1):
            use = self.at if not j else np.flatnonzero(self.e[j] >= 0)
            self.letters[self.s[j][use]] = self.size[use] - j
        self.count()

    def count(self) -> None:
        """Tokens and types a stem, tokens an ending."""
        self.own, self.end = self.s[self.cut, self.at], self.e[self.cut, self.at]
        self.tokens = np.bincount(self.own, self.f, self.many).astype(np.int64)  # below 2^53
        self.types = np.bincount(self.own, minlength=self.many)
        self.ends = np.bincount(self.end, self.f, len(self.code["names"]) + 1).astype(np.int64)
        self.logs = _logs(self.tokens)

    def prices(self, costs: dict) -> np.ndarray:
        """An ending's cost at its place, NaN where it has none."""
        out = np.full(len(self.code["names"]) + 1, np.nan)
        for e, x in costs.items():
            out[self.code["place"][e]] = x
        return out

    def switches(self, estimates: dict) -> tuple:
        """(ending, index, old stem, new stem, letters cut) of types that a candidate ending would win, at frozen code lengths.

        estimates has each candidate's tokens. Types that share an old stem are
        taken in order, as the last to leave it frees its letters: that is the
        last of the stem's types, where all others leave without it.
        """
        n, ends, bits = self.code["n"], self.code["ends"], self.code["bits"]
        log, stems, of = math.log2, math.log2(self.code["n"] + self.code["stems"]), math.log2(n + len(ends))
        own = self.prices({e: of - log(c + 1) for e, c in ends.items()})
        new = self.prices({c: log(n + len(ends) + 1) - log(f + 1) for c, f in estimates.items()})
        old = stems - self.logs[self.own] + own[self.end]
        last = np.zeros(self.many, np.int64)
        last[self.own] = self.at  # the last write stays
        found = []
        for j in {len(c) for c in estimates}:
            i = np.flatnonzero(self.e[j] >= 0)
            i = i[~np.isnan(new[self.e[j][i]])]
            c, to, st = self.e[j][i].astype(np.int64), self.s[j][i], self.own[i]
            d = self.f[i] * (stems - self.logs[to] + new[c] - old[i])
            d = np.where(self.types[to] == 0, d + (self.size[i] - j + 1) * bits, d)
            found.append((c, i, st, to, np.full(len(i), j), d))
        if not found:
            return (np.zeros(0, np.int64),) * 5
        c, i, st, to, j, d = (np.concatenate(x) for x in zip(*found))
        leaves = d < -1e-12
        alone = self.types[st] == 1
        final = (i == last[st]) & ~alone
        key = c * self.many + st
        gone, times = np.unique(key[leaves & ~alone & (i != last[st])], return_counts=True)
        if final.any() and len(gone):
            at = np.minimum(np.searchsorted(gone, key[final]), len(gone) - 1)
            alone[np.flatnonzero(final)] = (gone[at] == key[final]) & (times[at] == self.types[st[final]] - 1)
        d = np.where(alone, d - (self.size[i] - self.cut[i] + 1) * bits, d)
        hit = d < -1e-12
        return c[hit], i[hit], st[hit], to[hit], j[hit]

    def won(self, estimates: dict) -> pa.RecordBatch:
        """(c, f): the tokens that each candidate would win."""
        c, i, *_ = self.switches(estimates)
        few, at = np.unique(c, return_inverse=True)
        return pa.RecordBatch.from_arrays([self.named(few), pa.array(np.bincount(at, self.f[i], len(few)).astype(np.int64))], ["c", "f"])

    def named(self, places: np.ndarray) -> pa.Array:
        return pa.array([*self.code["names"], ""], pa.string()).take(pa.array(places))

    def add(self, c: str, estimate: float) -> None:
        _, i, _, _, j = self.switches({c: estimate})
        self.cut[i] = j
        self.count()

    def assign(self, stem_count: int, ends: dict) -> None:
        """One round: every type in order takes its cheapest analysis, at code lengths frozen at the round's start; only the stems' numbers of types follow.

        A stem with a type that has no choice is never without types, and one that a
        single type can take is its own affair: types whose stems are all such are
        decided at once. Those left meet on stems that no other type can take, and
        go one after another.
        """
        n, bits, log = self.code["n"], self.code["bits"], math.log2
        stems, of = log(n + stem_count), log(n + len(ends))
        price = self.prices({e: of - log(c + 1) for e, c in ends.items()})
        open_ = (self.e >= 0) & ~np.isnan(price[self.e])
        free = open_.sum(axis=0) > 1
        fixed, i = np.bincount(self.own[~free], minlength=self.many) > 0, np.flatnonzero(free)
        open_, s, size, cut, own = open_[:, i], self.s[:, i], self.size[i], self.cut[i], self.own[i]
        takers = np.bincount(s[open_], minlength=self.many)
        open_stem = ~fixed & (takers > 1)
        unsure = (open_ & open_stem[s]).any(axis=0)
        base = self.f[i] * (stems - self.logs[s] + price[self.e[:, i]])
        frees = (size - cut + 1) * bits * (self.types[own] == 1)
        best, pick = np.full(len(i), np.inf), np.zeros(len(i), np.int32)
        for j in range(len(s)):
            d = np.where(cut == j, base[j], base[j] + ((size - j + 1) * bits * (self.types[s[j]] == 0) - frees))
            better = open_[j] & (d < best - 1e-12)
            best, pick = np.where(better, d, best), np.where(better, j, pick)
        live = dict(zip(*(x.tolist() for x in (np.flatnonzero(open_stem), self.types[open_stem]))))
        sure = 2  # of a stem that does not run empty; only 0 and 1 tell
        left = np.flatnonzero(unsure)
        one = lambda x: x[:, left].T.tolist()
        for at, k, length, stem, cost, ok in zip(left.tolist(), cut[left].tolist(), size[left].tolist(), one(s), one(base), one(open_)):
            # Stems out of the others' reach have the number of types they began with.
            now = stem[k]
            number = live[now] if now in live else sure if fixed[now] else int(self.types[now])
            least = None
            for j, st in enumerate(stem):
                if not ok[j]:
                    continue
                d = cost[j]
                if j != k:
                    there = live[st] if st in live else int(self.types[st])
                    d += (length - j + 1) * bits * (there == 0) - (length - k + 1) * bits * (number == 1)
                if least is None or d < least[0] - 1e-12:
                    least = (d, j, st)
            pick[at] = least[1]
            if least[1] != k:
                if now in live:
                    live[now] -= 1
                if least[2] in live:
                    live[least[2]] += 1
        self.cut[i] = pick
        self.count()

    def replay(self, c: str, estimate: float, rounds: list) -> None:
        self.add(c, estimate)
        for stem_count, ends in rounds:
            self.assign(stem_count, ends)


_GAINS = "c string, end string, f long, stems long, letters long, before double, after double"


def _gains(words: _Words, estimates: dict) -> pa.RecordBatch:
    """What each candidate's switches change in this bucket: a row for the stems (end null) and one for each ending that loses tokens."""
    c, i, st, to, _ = words.switches(estimates)
    f, width = words.f[i], len(words.code["names"]) + 1
    few, at = np.unique(c * width + words.end[i], return_inverse=True)
    lost = np.bincount(at, f, len(few)).astype(np.int64)
    stem, own = np.unique(np.concatenate((c * words.many + st, c * words.many + to)), return_inverse=True)
    moved = np.bincount(own, np.concatenate((-f, f)), len(stem)).astype(np.int64)
    users = np.bincount(own, np.repeat([-1, 1], len(f)), len(stem)).astype(np.int64)
    by, stem = stem // words.many, stem % words.many
    was, had = words.tokens[stem], words.types[stem]
    change = ((had == 0) & (users > 0)).astype(np.int64) - ((had > 0) & (had + users == 0))
    every, at = np.unique(by, return_inverse=True)
    whole = lambda x: np.bincount(at, x, len(every))
    after, none = was + moved, np.zeros(len(few))
    cols = [
        words.named(np.concatenate((few // width, every))), pa.concat_arrays([words.named(few % width), pa.nulls(len(every), pa.string())]),
        *(pa.array(np.concatenate((x, whole(y))).astype(np.int64)) for x, y in ((lost, 0 * change), (none, change), (none, change * (words.letters[stem] + 1)))),
        *(pa.array(np.concatenate((none, whole(x * _logs(x))))) for x in (was, after)),
    ]
    return pa.RecordBatch.from_arrays(cols, ["c", "end", "f", "stems", "letters", "before", "after"])


def mdl_suffixes(types: DataFrame, cut: Callable, stem: int = 3, longest: int = 4, least: int = 15, most: int = 60) -> DataFrame:
    """(step, suffix, accepted, approx_bits, gain_bits, n_tokens, total_bits): endings added greedily while they shorten lexicon and text.

    A type is a stem and an ending of the list, or a stem alone. The description is
    the letters of the endings and of the stems in use, with an end mark each, and
    every token's two code lengths by add-one shares. A step scores all candidates
    (endings of `least` types or more) at frozen code lengths, in two passes, the
    second with the tokens that the first let switch; gives the best candidate its
    types; lets all types choose anew in three rounds, each in the types' order;
    and keeps the ending if the exact length fell by gain_bits, else takes the step
    back and bars it. It ends without a candidate that gains, or at `most` endings.

    A stem of a type is a prefix of at least `stem` letters, so types are dealt into
    partitions by their first letters, and a partition is scored and assigned whole
    in a task, without a shuffle after the first; types that begin alike are one
    task, as a round is sequential among them. A step is five jobs of sums. The
    driver holds the endings and their counts. types: (w, freq), each w once;
    null words take no part. cut() ends lineage.
    """
    spark = types.sparkSession
    # Kept, as the types are read four times and their texts only once.
    words = cut(types.where("w is not null").select("w", F.col("freq").cast("long").alias("f")))
    letters = words.select(F.explode(F.filter(F.split("w", ""), lambda c: c != "")).alias("c")).distinct().count()
    n, many = words.agg(F.coalesce(F.sum("f"), F.lit(0)), F.count("*")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-many // 100_000))
    bits = math.log2(letters + 1)
    pool = words.select("f", F.length("w").alias("m"), F.explode(suffixes(F.col("w"), longest)).alias("suffix")).where(F.col("m") - F.length("suffix") >= stem)
    pool = pool.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("f").alias("f")).where(F.col("n") >= least)
    pool = {r["suffix"]: r["f"] for r in pool.collect()}  # one row an ending
    names = sorted(pool)
    # A partition is a bucket for good: all that follows is narrow.
    state = cut(_coded(words.repartition(parts, F.left("w", F.lit(stem))).sortWithinPartitions("w"), names, stem, longest))
    schema = state.schema
    code = {"n": n, "bits": bits, "stem": stem, "longest": longest, "stems": many, "ends": {"": n}, "names": names, "place": {e: i for i, e in enumerate([*names, ""])}}

    def per_bucket(run, schema):
        known = dict(code)

        def bucket(batches):
            whole = [x for x in batches if x.num_rows]
            if whole:
                out = run(_Words(whole, known))
                yield from out.to_batches(50_000) if isinstance(out, pa.Table) else [out]

        return state.mapInArrow(bucket, schema)

    def counts(x: _Words) -> pa.RecordBatch:
        used, ends = x.types > 0, np.flatnonzero(x.ends)
        none = [0.0] * len(ends)
        rows = [[int(used.sum()), *x.ends[ends].tolist()], [float((x.letters[used] + 1).sum()), *none], [float((x.tokens * x.logs).sum()), *none]]
        return pa.RecordBatch.from_arrays([pa.array([None, *x.named(ends).to_pylist()], pa.string()), *map(pa.array, rows)], ["end", "c", "letters", "term"])

    def totals(replay=None) -> tuple[int, dict, float]:
        """Stems in use, endings' tokens and the description's length after replay, from sums over the buckets."""

        def run(x):
            if replay:
                x.replay(*replay)
            return counts(x)

        got = per_bucket(run, "end string, c long, letters double, term double").groupBy("end").agg(F.sum("c").alias("c"), F.sum("letters").alias("letters"), F.sum("term").alias("term")).collect()
        found = {r["end"]: r["c"] for r in got if r["end"] is not None}
        names = [*code["ends"], replay[0]] if replay else list(code["ends"])
        ends, one = {e: found.get(e, 0) for e in names}, next(r for r in got if r["end"] is None)
        length = bits * (sum(len(e) + 1 for e in ends) + one["letters"]) + n * math.log2(n + one["c"]) - one["term"] + n * math.log2(n + len(ends)) - sum(c * math.log2(c + 1) for c in ends.values())
        return one["c"], ends, length

    def best_of(estimates) -> tuple | None:
        """The ending of the greatest gain: its name, tokens and gain, and the stems and endings' tokens once its types are its own."""
        stems, ends = code["stems"], code["ends"]
        v, term = len(ends), lambda c, of: -c * math.log2((c + 1) / (n + of)) if c > 0 else 0.0
        raise_ = sum(term(c, v + 1) - term(c, v) for c in ends.values())
        known = F.create_map(*[x for e, c in ends.items() for x in (F.lit(e), F.lit(c))])
        entropy = lambda c: F.when(c > 0, -c * F.log2((c + 1) / F.lit(float(n + v + 1)))).otherwise(0.0)
        rows = per_bucket(lambda x: _gains(x, estimates), _GAINS).groupBy("c", "end").agg(*[F.sum(x).alias(x) for x in ("f", "stems", "letters", "before", "after")])
        was = F.element_at(known, F.col("end"))
        rows = rows.withColumn("ends", F.when(F.col("end").isNotNull(), entropy(was - F.col("f")) - entropy(was)).otherwise(0.0))
        lost = F.collect_list(F.when(F.col("end").isNotNull(), F.struct("end", "f"))).alias("lost")  # the endings in use at most
        per = rows.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("f", "stems", "letters", "before", "after", "ends")], lost)
        wide, now = F.log2((F.col("stems") + (n + stems)).cast("double")), math.log2(n + stems)
        data = F.col("ends") + raise_ + entropy(F.col("f")) + F.col("before") - F.col("after") + F.lit(float(n)) * (wide - now)
        gain = -(data + (F.length("c") + 1 + F.col("letters")) * bits)
        top = per.select("c", "f", "stems", "lost", gain.alias("gain")).where("gain > 1e-9").orderBy(F.desc(F.round("gain", 8)), "c").first()
        if not top:
            return None
        left = dict(ends, **{top["c"]: top["f"]})
        for x in top["lost"]:
            left[x["end"]] -= x["f"]
        return top["c"], top["gain"], (stems + top["stems"], left)

    steps, barred, held = [], set(), []
    code["stems"], code["ends"], length = totals() if many else (0, {"": 0}, 0.0)
    while many and sum(s[2] for s in steps) < most:
        open_ = {c: f for c, f in pool.items() if c not in code["ends"] and c not in barred}
        if not open_:
            break
        first = per_bucket(lambda x: x.won(open_), "c string, f long").groupBy("c").agg(F.sum("f").alias("f"))
        won = {r["c"]: r["f"] for r in first.collect()}  # one row an ending
        refined = {c: won.get(c, 0) for c in open_}
        best = best_of(refined)
        if not best:
            break
        c, approx, counted = best
        estimate, rounds = refined[c], []
        for _ in range(3):
            rounds.append(counted[:2])
            counted = totals((c, estimate, rounds))
        gain = length - counted[2]
        kept = gain > 1e-6
        steps.append((len(steps) + 1, c, kept, approx, gain, counted[1][c], length - gain if kept else length))
        if not kept:
            barred.add(c)
            continue

        def moved(x, replay=(c, estimate, rounds)):
            x.replay(*replay)
            return x.rows.set_column(1, "cut", pa.array(x.cut))

        state = per_bucket(moved, schema)
        # Lineage grows by a step each time; a lost part is replayed from the last checkpoint.
        state = cut(state) if sum(s[2] for s in steps) % 5 == 0 else state.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(state)
        if len(held) > 2:  # the one before is read once more, to make this one
            held.pop(0).unpersist()
        code["stems"], code["ends"], length = counted
    return spark.createDataFrame(steps, "step int, suffix string, accepted boolean, approx_bits double, gain_bits double, n_tokens long, total_bits double")


def markov_sequences(histories: DataFrame, bigrams: pd.DataFrame, r: int, seed: int) -> DataFrame:
    """(rep, seq, i, w): for each replicate a sequence of n symbols for every row of histories (seq, n), drawn from bigram counts (a, b, c).

    The model holds each distinct pair once and travels with the task; the first
    symbol, and one after a symbol without a follower, is drawn from all left
    sides. Rows of (rep, seq) are dealt over the tasks, and a draw depends on
    seed, replicate, sequence and place alone.
    """
    spark = histories.sparkSession
    names, code = np.unique(np.concatenate((bigrams["a"].to_numpy(object), bigrams["b"].to_numpy(object))).astype(str), return_inverse=True)
    left, right, c = code[: len(bigrams)], code[len(bigrams):], bigrams["c"].to_numpy(np.int64)
    order = np.lexsort((right, left))
    left, right, upto = left[order], right[order], c[order].cumsum()
    total = np.zeros(len(names), np.int64)
    np.add.at(total, left, c[order])
    first = total.cumsum()

    def mixed(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def run(batches):
        words = pa.array(names.tolist(), pa.string())
        for b in batches:
            n = b.column("n").to_numpy()
            by = np.argsort(-n, kind="stable")
            n, key = n[by], mixed(b.column("key").to_numpy()[by].view(np.uint64))
            w, places, own, many = np.zeros(len(n), np.int64), [], [], 0
            for i in range(int(n[0]) if len(n) else 0):
                live = int(np.searchsorted(-n, -i, side="left"))  # n > i
                u = (mixed(key[:live] + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)) / 2.0**53
                stay = total[w[:live]] if i else np.zeros(live, np.int64)
                start = np.searchsorted(first, (u * first[-1]).astype(np.int64), side="right")
                step = np.searchsorted(upto, first[w[:live]] - stay + (u * stay).astype(np.int64), side="right")
                w[:live] = np.where(stay > 0, right[np.minimum(step, len(right) - 1)], start)
                places.append(w[:live].copy())
                own.append(np.full(live, i, np.int32))
                many += live
                if many > 200_000 or i + 1 == n[0]:
                    at = pa.array(np.concatenate([by[: len(x)] for x in places]))
                    drawn = words.take(pa.array(np.concatenate(places)))
                    yield pa.RecordBatch.from_arrays([b.column("rep").take(at), b.column("seq").take(at), pa.array(np.concatenate(own)), drawn], names=["rep", "seq", "i", "w"])
                    places, own, many = [], [], 0

    work = repeated(histories.select("seq", F.col("n").cast("long").alias("n")), r)
    work = work.select("rep", F.col("seq").cast("long").alias("seq"), "n", F.xxhash64(F.lit(seed), "rep", "seq").alias("key"))
    work = work.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rep", "seq")
    return work.where("n > 0").mapInArrow(run, "rep long, seq long, i int, w string") if len(names) else work.select("rep", "seq", F.lit(0).alias("i"), F.lit("").alias("w")).limit(0)
