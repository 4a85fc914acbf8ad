"""Toxicity scores from a convolutional text classifier trained in numpy.

A word's embedding is the sum of two hashed rows: the word and its first five
letters. Filters of widths 1, 2 and 3 slide over the words, their largest responses
over the whole text (max pooling) feed a logistic output. Gradients flow through the
pooled positions only, so training costs little beyond the forward pass.

Thresholds are calibrated by language on training rows that the weights were not
fitted to. The language is told from the words themselves, never from a column, and
the score is shifted so that its language's threshold lies at 0.5.

Every labelled row and every word of it is learned from, equal rows of one id once. The rows
are dealt by hashes into shards of about SHARD_WORDS words. In each of ROUNDS rounds every
shard runs some epochs from the common weights in a task of its own, then the changes are
averaged: those of a word's row by how often each shard changed it, the others by rows. One
shard runs all epochs at once. Counts of words by language, and of logits by label for the
thresholds (in steps of 1 / STEPS), are summed over all shards; the driver holds the model
and one round's changes. Scoring uses every row and every word.

Defined results: a null text counts as empty; an empty text scores what no words give.
Rows without a label, or with a null one, are not learned from.
Without labels of both kinds every score is 0.0. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, release, ship, unused

#: Words of one shard of the labelled rows, and rounds of averaging where there are several.
SHARD_WORDS, ROUNDS = 2_000_000, 6
#: Parts of the word table that are averaged apart; steps of a logit for the thresholds, and the largest.
PARTS, STEPS, LARGEST = 64, 256, 64
#: Marks of labelled ids (a multiple of 32,768) that say which texts to read for learning.
MARKS = 1 << 25
BUCKETS, PREFIX = 1 << 15, 5
WIDTHS, FILTERS, DIM = (1, 2, 3), 8, 12
EPOCHS, BATCH, RATE = 12, 48, 0.12
PAD = max(WIDTHS) - 1
CHUNK_WORDS = 40_000
WORD = re.compile(r"[^\W\d_]+")
#: Column of each (width, tap, filter) in the table of word responses.
COLUMNS = {}
for _w in WIDTHS:
    for _t in range(_w):
        COLUMNS[_w, _t] = len(COLUMNS) * FILTERS
RESPONSES = len(COLUMNS) * FILTERS


class Hashes(dict):
    """word -> its bucket, and its prefix's bucket in the upper half."""

    def __missing__(self, word: str) -> int:
        if len(self) > 600_000:
            self.clear()
        full = zlib.crc32(word.encode()) & (BUCKETS - 1)
        head = zlib.crc32(b"^" + word[:PREFIX].encode()) & (BUCKETS - 1)
        self[word] = found = full | head << 16
        return found


def hashed(text: str, memo: Hashes) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))


def responses(full: np.ndarray, head: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return full[codes & 0xFFFF] + head[codes >> 16]


def slide(g: np.ndarray) -> np.ndarray:
    """Filter outputs at every position of padded word responses ``g``."""
    n, out = len(g) - PAD, []
    for w in WIDTHS:
        total = g[:n, COLUMNS[w, 0] : COLUMNS[w, 0] + FILTERS]
        for t in range(1, w):
            total = total + g[t : n + t, COLUMNS[w, t] : COLUMNS[w, t] + FILTERS]
        out.append(total)
    return np.concatenate(out, axis=1)


@dataclass
class Model:
    full: np.ndarray  # responses and language weights of word buckets
    head: np.ndarray  # the same of prefix buckets
    bias: np.ndarray
    out: np.ndarray
    base: float
    shift: np.ndarray  # by language

    def logits(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Logit and language of each text, given as word codes."""
        logit, lang, at = np.zeros(len(texts)), np.zeros(len(texts), np.int64), 0
        langs = len(self.shift)
        while at < len(texts):
            end, words = at, 0
            while end < len(texts) and (end == at or words + len(texts[end]) <= CHUNK_WORDS):
                words += len(texts[end])
                end += 1
            pooled = np.full((end - at, len(self.bias)), -np.inf, np.float32)
            tongue = np.zeros((end - at, langs))
            for start in range(0, max(words, 1), CHUNK_WORDS) if end - at == 1 else (0,):
                some = [texts[at][start : start + CHUNK_WORDS + PAD]] if end - at == 1 else texts[at:end]
                sizes = np.array([len(t) for t in some])
                # PAD empty words follow each text, so no filter spans two texts
                first = np.concatenate([[0], np.cumsum(sizes + PAD)[:-1]])
                g = np.zeros((int(sizes.sum()) + PAD * len(some) + PAD, RESPONSES + langs), np.float32)
                place = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(some)) * PAD, sizes)
                g[place] = responses(self.full, self.head, np.concatenate(some))
                moved = slide(g)
                if end - at == 1 and start + CHUNK_WORDS < words:  # the text goes on
                    moved = moved[:CHUNK_WORDS]
                pooled = np.maximum(pooled, np.maximum.reduceat(moved, first, axis=0))
                if end - at == 1:
                    tongue += g[: min(CHUNK_WORDS, len(some[0])), RESPONSES:].sum(axis=0)
                else:
                    tongue += np.add.reduceat(g[:, RESPONSES:], first, axis=0)[: len(some)]
            logit[at:end] = np.maximum(pooled + self.bias, 0) @ self.out + self.base
            lang[at:end] = tongue.argmax(axis=1) if langs else 0
            at = end
        return logit, lang

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        logit, lang = self.logits(texts)
        return 1 / (1 + np.exp(-np.clip(logit - self.shift[lang], -40, 40)))


def _start(share: float, seed: int = 7) -> list[np.ndarray]:
    """Word table, filters, biases, output weights, output bias; then the squared gradients of each."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (2 * BUCKETS, DIM))
    w = rng.normal(0, 0.4, (DIM, RESPONSES))
    bias, out, base = np.zeros(len(WIDTHS) * FILTERS), rng.uniform(0.2, 0.6, len(WIDTHS) * FILTERS), np.full(1, np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    out[FILTERS // 2 :: FILTERS] *= -1
    weights = [table, w, bias, out, base]
    return weights + [np.full_like(x, 1e-3) for x in weights]


def _learn(state: list[np.ndarray], texts: list[np.ndarray], y: np.ndarray, share: float, epochs: int, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The state after ``epochs`` over the texts, and how often each row of the table changed."""
    state = [x.copy() for x in state]
    table, w, bias, out, base, *seen = state
    rng, hits = np.random.default_rng(seed), np.zeros(len(table))
    taps = [(i * FILTERS + f, t, COLUMNS[wd, t] + f) for i, wd in enumerate(WIDTHS) for f in range(FILTERS) for t in range(wd)]
    which, tap, column = (np.array(x) for x in zip(*taps, strict=True))
    weight = np.where(y == 1, np.sqrt((1 - share) / max(share, 1e-3)), 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for low in range(0, len(order), BATCH):
            batch = order[low : low + BATCH]
            rows, cols, vals, words = [], [], [], []
            d_out, d_bias, d_base, offset = np.zeros_like(out), np.zeros_like(bias), 0.0, 0
            for i in batch:
                codes = texts[i]
                e = np.zeros((len(codes) + 2 * PAD, DIM))
                e[: len(codes)] = table[codes & 0xFFFF] + table[BUCKETS + (codes >> 16)]
                c = slide(e @ w)
                at = c.argmax(axis=0)
                pre = c[at, np.arange(len(at))] + bias
                h = np.maximum(pre, 0)
                z = h @ out + base[0]
                d = weight[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) / len(batch)
                d_out += d * h
                d_base += d
                dh = d * out * (pre > 0)
                d_bias += dh
                place = at[which] + tap
                ok = (place < len(codes)) & (dh[which] != 0)
                rows.append(offset + place[ok])
                cols.append(column[ok])
                vals.append(dh[which][ok])
                words.append(codes)
                offset += len(codes)
            codes = np.concatenate(words) if words else np.zeros(0, np.int64)
            rows, cols, vals = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
            picked = codes[rows]
            e = table[picked & 0xFFFF] + table[BUCKETS + (picked >> 16)]
            d_w = np.zeros_like(w)
            np.add.at(d_w.T, cols, vals[:, None] * e)
            d_e = vals[:, None] * w[:, cols].T
            at_rows, inverse = np.unique(np.concatenate([picked & 0xFFFF, BUCKETS + (picked >> 16)]), return_inverse=True)
            d_table = np.zeros((len(at_rows), DIM))
            np.add.at(d_table, inverse, np.concatenate([d_e, d_e]))
            hits[at_rows] += 1
            seen[0][at_rows] += d_table**2
            table[at_rows] -= RATE * d_table / np.sqrt(seen[0][at_rows])
            for x, dx, s in ((w, d_w + 1e-5 * w, seen[1]), (bias, d_bias, seen[2]), (out, d_out + 1e-4 * out, seen[3]), (base, np.array([d_base]), seen[4])):
                s += dx**2
                x -= RATE * dx / np.sqrt(s)
    return state, hits


def _threshold(z: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float | None:
    """The logit that loses the least balanced accuracy and false alarms, from the rows of each
    kind at each of the ascending logits ``z``; None where one kind is too rare to tell."""
    if toxic.sum() < 12 or clean.sum() < 12:
        return None
    missed = np.concatenate([[0], np.cumsum(toxic)])  # positives below the cut
    alarms = clean.sum() - np.concatenate([[0], np.cumsum(clean)])
    cost = missed + alarms
    best = np.flatnonzero(cost == cost.min())
    k = int(best[len(best) // 2])
    return float((z[max(k - 1, 0)] + z[min(k, len(z) - 1)]) / 2)


def _mark(ids: str) -> Column:
    return F.pmod(F.xxhash64(F.col(ids).cast("long")), F.lit(MARKS))


def _marks(named: DataFrame) -> np.ndarray:
    """A bit for each mark that an id of ``named`` has: 4 MB whatever the labels."""
    bits = np.zeros(MARKS // 8, np.uint8)
    spots = named.select(_mark("doc_id").alias("mark")).where("mark IS NOT NULL")
    for r in spots.groupBy(F.expr("mark div 32768").alias("part")).agg(F.bitmap_construct_agg(F.col("mark") % 32768).alias("bits")).collect():
        bits[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """codes (word hashes), n (words), y, lang, place (a hash), held (for the thresholds) of
    every labelled row outside the held-out fifth; equal rows of one id are one. Texts are
    not shuffled: those with a labelled id's mark are coded, then the join decides by the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bits = Hashes(), sent.value
        for batch in batches:
            mark = batch.column(3).to_numpy()
            batch = batch.filter(pa.array((bits[mark >> 3] >> (mark & 7) & 1).astype(bool)))
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                codes = [hashed(t or "", memo).astype(np.int32) for t in some.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([len(c) for c in codes], pa.int64()), some.column(1), some.column(2)], ["codes", "n", "doc_id", "lang"])

    ship(docs.sparkSession)
    learned = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    named = labels.where(F.col("toxic").isNotNull() & learned).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    sent = docs.sparkSession.sparkContext.broadcast(_marks(named))
    rows = docs.where(learned).select("text", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), _mark("doc_id").alias("mark"))
    coded = rows.mapInArrow(run, "codes binary, n long, doc_id long, lang string").join(named, "doc_id")
    held = F.pmod(F.xxhash64("doc_id", F.lit("thresholds")), F.lit(5)) == 0
    return coded.groupBy("doc_id", "codes", "n", "lang").agg(F.max("y").alias("y")).select("codes", "n", "y", "lang", F.xxhash64("doc_id", "codes").alias("place"), held.alias("held"))


def _packed(group: pa.Table) -> pa.Table:
    """One row of a shard: its texts end to end, in an order that the data decide."""
    columns = [group.column(c).to_pylist() for c in ("codes", "y", "lang", "held", "n")]
    codes, y, lang, held, n = zip(*sorted(zip(*columns, strict=True)), strict=True)
    return pa.table(
        {
            "shard": group.column("shard").slice(0, 1),
            "codes": pa.array([b"".join(codes)], pa.binary()),
            "n": pa.array([np.array(n, np.int64).tobytes()], pa.binary()),
            "y": pa.array([np.array(y, np.int32).tobytes()], pa.binary()),
            "held": pa.array([np.array(held, bool).tobytes()], pa.binary()),
            "lang": pa.array([list(lang)], pa.list_(pa.string())),
        }
    )


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """shard, texts, y, held, lang of each shard."""
    for batch in batches:
        for at in range(batch.num_rows):
            r = {c: batch.column(c)[at].as_py() for c in ("shard", "codes", "n", "y", "held", "lang")}
            ends = np.cumsum(np.frombuffer(r["n"], np.int64))
            texts = np.split(np.frombuffer(r["codes"], np.int32).astype(np.int64), ends[:-1])
            yield r["shard"], texts, np.frombuffer(r["y"], np.int32), np.frombuffer(r["held"], bool), np.array(r["lang"])


_CHANGE = "key string, shard long, ids binary, weight binary, value binary"
_CHANGES = pa.schema([("key", pa.string()), ("shard", pa.int64()), ("ids", pa.binary()), ("weight", pa.binary()), ("value", pa.binary())])


def _averaged(group: pa.Table) -> pa.Table:
    """The changes of one key over all shards: averages by weight, or sums of word counts."""
    key = group.column("key")[0].as_py()
    order = np.argsort(group.column("shard").to_numpy(), kind="stable")
    size = BUCKETS if key.startswith("lang") else 1 + max(int(np.frombuffer(x, np.int32).max(initial=0)) for x in group.column("ids").to_pylist())
    total, weights = None, np.zeros(size)
    for at in order.tolist():
        ids, weight = (np.frombuffer(group.column(c)[at].as_py(), t) for c, t in (("ids", np.int32), ("weight", np.float64)))
        value = np.frombuffer(group.column("value")[at].as_py(), np.float32)
        value = value.reshape(len(ids), len(value) // max(1, len(ids)) or 1)
        total = np.zeros((size, value.shape[1])) if total is None else total
        total[ids] += weight[:, None] * value
        weights[ids] += weight
    ids = np.flatnonzero(weights > 0).astype(np.int32)
    mean = total[ids] if key.startswith("lang") else total[ids] / weights[ids, None]
    return pa.Table.from_arrays([pa.array([x], t) for x, t in zip((key, 0, ids.tobytes(), weights[ids].tobytes(), mean.astype(np.float32).tobytes()), _CHANGES.types, strict=True)], schema=_CHANGES)


def _round(shards: DataFrame, state: list[np.ndarray], share: float, epochs: int, number: int) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    """The state after a round over all shards; in the first round also word counts by language."""
    sent = shards.sparkSession.sparkContext.broadcast([x.astype(np.float32) for x in state])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, texts, y, held, lang in _unpacked(batches):
            old = [x.astype(np.float64) for x in sent.value]
            fitted = [t for t, h in zip(texts, held, strict=True) if not h]
            found = []
            if fitted:
                new, hits = _learn(old, fitted, y[~held].astype(float), share, epochs, 7 + 1000 * number + shard)
                change = np.concatenate([new[0] - old[0], new[5] - old[5]], axis=1)
                for part in range(PARTS):
                    rows = np.flatnonzero(hits[part::PARTS]) * PARTS + part
                    if len(rows):
                        found.append((f"table {part}", rows // PARTS, hits[rows], change[rows]))
                dense = np.concatenate([(a - b).ravel() for i, (a, b) in enumerate(zip(new, old, strict=True)) if i not in (0, 5)])
                found.append(("dense", np.arange(len(dense)), np.full(len(dense), float(len(fitted))), dense))
            for name in np.unique(lang).tolist() if not number else ():
                count = np.bincount(np.concatenate([t for t, x in zip(texts, lang, strict=True) if x == name]) & 0xFFFF, minlength=BUCKETS)
                ids = np.flatnonzero(count)
                found.append((f"lang {name}", ids, np.ones(len(ids)), count[ids]))
            for key, ids, weight, value in found:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((key, shard, ids.astype(np.int32).tobytes(), weight.astype(np.float64).tobytes(), value.astype(np.float32).tobytes()), _CHANGES.types, strict=True)], schema=_CHANGES)

    state, words = [x.copy() for x in state], {}
    for r in shards.mapInArrow(run, _CHANGE).groupBy("key").applyInArrow(_averaged, _CHANGE).toLocalIterator():
        ids, value = np.frombuffer(r["ids"], np.int32), np.frombuffer(r["value"], np.float32)
        kind, _, name = r["key"].partition(" ")
        if kind == "table":
            rows, value = ids * PARTS + int(name), value.reshape(len(ids), -1)
            state[0][rows] += value[:, :DIM]
            state[5][rows] += value[:, DIM:]
        elif kind == "dense":
            low = 0
            for i in (1, 2, 3, 4, 6, 7, 8, 9):
                state[i] += value[low : low + state[i].size].reshape(state[i].shape)
                low += state[i].size
        else:
            words[name] = np.zeros(BUCKETS)
            words[name][ids] = value
    sent.destroy()
    release(shards.sparkSession)  # else the shuffle files of all rounds lie side by side
    return state, words


def _calibrated(shards: DataFrame, model: Model) -> np.ndarray:
    """The threshold of each language over all rows that the weights were not fitted to."""
    sent = shards.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, y, held, _ in _unpacked(batches):
            logit, told = sent.value.logits([t for t, h in zip(texts, held, strict=True) if h])
            step, toxic = np.round(np.clip(logit, -LARGEST, LARGEST) * STEPS).astype(np.int64), (y[held] == 1).astype(np.int64)
            cells, many = np.unique(np.stack([np.r_[told, np.full(len(told), -1)], np.r_[step, step], np.r_[toxic, toxic]]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in cells.astype(np.int64)), pa.array(many.astype(np.int64))], ["told", "step", "toxic", "n"])

    def decide(group: pa.Table) -> pa.Table:
        step, toxic, n = (group.column(c).to_numpy() for c in ("step", "toxic", "n"))
        z, at = np.unique(step, return_inverse=True)
        clean, bad = (np.bincount(at, np.where(toxic == kind, n, 0), len(z)) for kind in (0, 1))
        return pa.table({"told": group.column("told").slice(0, 1), "shift": pa.array([_threshold(z / STEPS, clean, bad)], pa.float64())})

    cells = shards.mapInArrow(run, "told long, step long, toxic long, n long").groupBy("told", "step", "toxic").agg(F.sum("n").alias("n"))
    found = {r["told"]: r["shift"] for r in cells.groupBy("told").applyInArrow(decide, "told long, shift double").collect()}
    sent.destroy()
    common = found.get(-1) or 0.0
    return np.array([common if found.get(k) is None else found[k] for k in range(len(model.shift))])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit from every labelled row. None without both kinds of label."""
    spark = docs.sparkSession
    rows = Table(training_rows(docs, labels))
    release(spark)
    words, least, most, share = rows.df.agg(F.sum("n"), F.min("y"), F.max("y"), F.avg(F.when(~F.col("held"), F.col("y")))).first()
    if words is None or least == most:
        return None
    count = max(1, -(-words // SHARD_WORDS))
    share, rounds = float(share or 0.0), 1 if count == 1 else ROUNDS
    dealt = rows.df.withColumn("shard", F.pmod("place", F.lit(count)))
    packed = "shard long, codes binary, n binary, y binary, held binary, lang array<string>"
    shards = Table(dealt.drop("place").groupBy("shard").applyInArrow(_packed, packed))
    rows.drop()
    release(spark)
    state, counts = _start(share), {}
    for number in range(rounds):
        state, told = _round(shards.df, state, share, EPOCHS // rounds, number)
        counts = counts or told
    table, w, bias, out, base = state[:5]
    tables = np.log(p / p.sum(axis=0)) if (p := np.stack([counts[x] + 0.5 for x in sorted(counts)], axis=1)).size else p
    tables -= tables.mean(axis=1, keepdims=True)
    full = np.concatenate([table[:BUCKETS] @ w, tables], axis=1).astype(np.float32)
    head = np.concatenate([table[BUCKETS:] @ w, np.zeros_like(tables)], axis=1).astype(np.float32)
    model = Model(full, head, bias.astype(np.float32), out.astype(np.float32), float(base[0]), np.zeros(len(counts)))
    model.shift = _calibrated(shards.df, model)
    shards.drop()
    return model


def with_score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; only the text column goes through Python."""
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # about 14 MB whatever the corpus

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = Hashes()
        for batch in batches:
            found: list[np.ndarray] = []
            for low in range(0, len(batch), 256):
                found.append(sent.value.scores([hashed(t or "", memo) for t in batch[low : low + 256].to_pylist()]))
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return docs.withColumn(out, score(F.col(text)))


def score_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows scored 0.5 or more; all columns stay."""
    out = unused(docs, "_toxicity")
    return with_score(docs, train(docs, labels), out=out).where(F.col(out) < 0.5).drop(out)
