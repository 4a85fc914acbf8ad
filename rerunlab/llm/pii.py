"""Personal identifiers: fixed patterns, and contextual ones learned by bootstrapping.

Entities that the fixed patterns find are seeds. A seed and everything else that
could be an identifier by its look (digits and separators, or an at sign) stand in
lexical contexts: the words beside them. Contexts and instances form a graph, scored
in rounds by Spark: a context is as reliable for a kind as the mean goodness of its
distinct instances, an instance as good as the contexts it stands in. A context is
trusted with SUPPORT distinct seeds and a reliability of CONFIDENCE. Instances of a
trusted context whose contexts are on the whole as reliable are seeds from the next
round on, so that contexts they alone stand in can be trusted in turn. What stands in a
context trusted at the end joins the spans. Copies of one entity in one context count
once, so copied documents lend no support.

A place is an instance of every kind whose look it has; where learned spans overlap,
that of the more reliable context stays (ties: the earlier, then the kind listed first).

Defined results: a null text counts as empty. Base spans stay as found; a learned one
never overlaps them. Repeated rows are searched each for itself. An empty table gives
an empty result. The counts are those of the base spans. Time is linear in a text's length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, join_hot, settled, unused, with_row_id

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, fixed.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SUPPORT, CONFIDENCE, ROUNDS = 8, 0.8, 3

DIGIT = re.compile(r"[0-9]")
#: IP for searching: the same spans, without starting anew inside a run of digits.
IP_RUNS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
#: What may be an identifier by its look, by kind, not inside a longer word; e-mail
#: addresses (kind 0) are looked for around at signs.
LOOKS = (
    (1, re.compile(r"(?<![0-9A-Za-z])[0-9]{1,4}(?:[.:][0-9]{1,4}){3}(?![0-9A-Za-z])")),
    (2, re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){11,18}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])")),
)
WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """The spans of EMAIL. The search starts at each at sign and goes back over the
    characters that may come before it, so words without one cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m is not None:
            out.append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if not DIGIT.search(text):
        return out
    for m in IP_RUNS.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def _at_signs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of other than white space and at signs, on both sides of one."""
    at = text.find("@")
    while at >= 0:
        start, end = at, at + 1
        while start and text[start - 1] != "@" and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and text[end] != "@" and not text[end].isspace():
            end += 1
        if start < at and end > at + 1:
            yield start, end
        at = text.find("@", at + 1)


class Beside:
    """The lexical contexts of spans: the two words before and the one after, lower-cased,
    digits as 0. Words end at white space and at the edges of spans."""

    def __init__(self, text: str, spans: list[tuple[int, int]]):
        self.text, self.pieces, self.words = text, [], {}
        edges = sorted({0, len(text), *(x for s in spans for x in s)})
        for a, b in zip(edges, edges[1:], strict=False):
            self.pieces += [m.span() for m in WORD.finditer(text, a, b)]
        self.starts = [a for a, _ in self.pieces]

    def word(self, i: int) -> str | None:
        if not 0 <= i < len(self.pieces):
            return None
        if i not in self.words:
            a, b = self.pieces[i]
            self.words[i] = DIGIT.sub("0", self.text[a:b].lower())
        return self.words[i]

    def contexts(self, start: int, end: int) -> list[str]:
        at = bisect_left(self.starts, start)
        left, before, right = self.word(at - 1), self.word(at - 2), self.word(bisect_left(self.starts, end))
        found = []
        if left:
            found.append(f"{left} _")
        if before:
            found.append(f"{before} {left} _")
        if right:
            found.append(f"_ {right}")
        if left and right:
            found.append(f"{left} _ {right}")
        return found


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, bool, int, int, str, list[str]]]:
    """(kind, seed, start, end, value, contexts) of the seeds and of what else looks like
    an identifier of a kind, outside the base spans."""
    spots = [(k, True, a, b) for k, a, b in base]
    taken: list[list[int]] = []  # the base spans, united
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    starts = [a for a, _ in taken]

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b) - 1  # the last that starts before the end
        return i < 0 or taken[i][1] <= a

    if "@" in text:
        spots += [(0, False, a, b) for a, b in _at_signs(text) if free(a, b)]
    if DIGIT.search(text):
        spots += [(kind, False, *m.span()) for kind, look in LOOKS for m in look.finditer(text) if free(*m.span())]
    if not spots:
        return []
    beside = Beside(text, [(a, b) for _, _, a, b in spots])
    return [(k, seed, a, b, text[a:b], beside.contexts(a, b)) for k, seed, a, b in spots]


def apart(spans: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the ``spans`` (reliability, start, kind, end) that overlap no better one."""
    kept: list[tuple[int, int, int]] = []
    for _, a, kind, b in sorted(spans, key=lambda s: (-s[0], *s[1:])):
        i = bisect_left(kept, (a, b, kind))
        if (i == len(kept) or kept[i][0] >= b) and (i == 0 or kept[i - 1][1] <= a):
            kept.insert(i, (a, b, kind))
    return [(kind, a, b) for a, b, kind in kept]


ROW = "rid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<kind:int,start:int,end:int>>, seen array<struct<kind:int,seed:boolean,start:int,end:int,value:string,contexts:array<string>>>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_SEEN = pa.struct([("kind", pa.int32()), ("seed", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("contexts", pa.list_(pa.string()))])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs`` with its base spans and occurrences."""
    names = [c.split()[0] for c in ROW.split(", ")[:7]] + ["base", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums, spans, seen = [[], [], [], []], [], [], []
            for t in batch.column(2):
                body = t.as_py() or ""
                base = base_spans(body)
                for k in range(4):
                    counts[k].append(sum(s[0] == k for s in base))
                sums.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in base])
                seen.append([dict(zip(("kind", "seed", "start", "end", "value", "contexts"), o, strict=True)) for o in occurrences(body, base)])
            columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(spans, pa.list_(_SPAN)), pa.array(seen, pa.list_(_SEEN))]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = with_row_id(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "rid")
    return rows.select("rid", "doc_id", "text").mapInArrow(run, ROW)


def _sized(edges: DataFrame, key: str) -> tuple[DataFrame, int]:
    """How many edges each context or instance has, and the most that one has."""
    sizes = Table(edges.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))).df
    return sizes, sizes.agg(F.max("_n")).first()[0] or 0


def _weighted(edges: DataFrame, sized: tuple[DataFrame, int], scores: DataFrame, key: str, rows: int) -> DataFrame:
    """Edges with the score of their context or instance."""
    sizes, most = sized
    return join_hot(edges, sizes.join(scores.hint("merge"), key), key, "_n", rows, most).drop("_n")


def reliable_contexts(seen: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """context (kind and words) and reliable of the contexts that may discover identifiers.
    ``seen``: kind, seed, value, contexts."""
    spots = seen.select(F.explode("contexts").alias("words"), "kind", "value", "seed")
    edges = Table(spots.groupBy(F.struct("kind", "words").alias("context"), F.struct("kind", "value").alias("instance")).agg(F.max("seed").alias("seed"))).df
    rows = edges.count()
    first = edges.groupBy("instance").agg(F.max("seed").alias("seed"))
    known = first.select("instance", F.col("seed").cast("double").alias("good"), F.col("seed").alias("sure"))
    edges = edges.drop("seed")
    of_instance, of_context = _sized(edges, "instance"), _sized(edges, "context")
    contexts = None
    for _ in range(rounds):
        scored = _weighted(edges, of_instance, known, "instance", rows)
        contexts = Table(scored.groupBy("context").agg(F.avg("good").alias("reliable"), F.sum(F.col("sure").cast("long")).alias("seeds"))).df
        trusted = (F.col("seeds") >= support) & (F.col("reliable") >= confidence)
        voted = _weighted(edges, of_context, contexts.where(F.col("seeds") >= support).withColumn("trusted", trusted), "context", rows)
        votes = voted.groupBy("instance").agg((F.sum(F.col("reliable") * F.col("seeds")) / F.sum("seeds")).alias("vote"), F.max("trusted").alias("met"))
        joined = first.join(votes, "instance", "left")
        good = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("vote", F.lit(0.0)))
        found = F.col("seed") | (F.coalesce("met", F.lit(False)) & (good >= confidence))
        known = Table(joined.select("instance", good.alias("good"), found.alias("sure"))).df
    return contexts.where((F.col("seeds") >= support) & (F.col("reliable") >= confidence)).select("context", "reliable")


def learned_spans(spots: DataFrame, contexts: DataFrame) -> DataFrame:
    """rid, learned (kind, start, end): the ``spots`` (rid, kind, start, end, context) that
    stand in ``contexts`` (context, reliable), none of them overlapping."""
    sizes = spots.groupBy("context").agg(F.count(F.lit(1)).alias("_n"))
    met = join_hot(spots, sizes.join(contexts, "context"), "context", "_n", spots.count())
    best = met.groupBy("rid", "kind", "start", "end").agg(F.max("reliable").alias("reliable"))
    listed = best.groupBy("rid").agg(F.collect_list(F.struct("reliable", "start", "kind", "end")).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [apart([tuple(x.values()) for x in s]) for s in batch.column(1).to_pylist()]
            spans = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in s] for s in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], ["rid", "learned"])

    return listed.mapInArrow(run, "rid long, learned array<struct<kind:int,start:int,end:int>>")


def _text_of(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """rid, doc_id, n_email, n_ip, n_card, n_phone, base_sha256, found (all spans: kind,
    start, end in code points), spans (as text) for every row of ``docs``."""
    rows = Table(scan(docs, text, key)).df
    seen = rows.select("rid", F.explode("seen").alias("s")).select("rid", "s.*")
    chosen = reliable_contexts(seen.select("kind", "seed", "value", "contexts"), **how)
    spots = seen.where(~F.col("seed")).select("rid", "kind", "start", "end", F.explode("contexts").alias("words")).withColumn("context", F.struct("kind", "words"))
    learned = learned_spans(spots.drop("words"), chosen)
    out = rows.drop("seen").join(learned, "rid", "left")
    out = out.withColumn("found", F.when(F.col("learned").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "learned"))))
    return out.select("rid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "found", _text_of(F.col("found")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets. Spans that
    overlap are united and replaced by the kind of the first. ``n_chars``, where there is one, follows the text."""
    docs = settled(docs)
    row, rid, spans = (unused(docs, c) for c in ("_row", "_rid", "_found"))
    found = find(docs, text, key, **how).where(F.size("found") > 0).select(F.col("rid").alias(rid), F.col("found").alias(spans))
    rows = with_row_id(docs, row).join(found, F.col(row) == F.col(rid), "left")
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    body = F.col(text)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        new = F.struct(
            F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(kinds, s["kind"] + 1)).alias("out"),
            s["end"].alias("at"),
        )
        united = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.when(s["start"] >= acc["at"], new).otherwise(united)

    clean = F.aggregate(ordered, begin, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    out = rows.withColumn(text, F.when(F.col(spans).isNull(), body).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
