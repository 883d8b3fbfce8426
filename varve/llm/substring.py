"""Repeated passages across documents: MinHash banding of sliding paragraphs, exact check, removal by components.

A paragraph is any run of SPAN words, wherever lines break, so a passage set into the middle of another paragraph is found
too. Two paragraphs without inner repeats have 46 shingles of WIDTH words each, and reach similarity .8 (41 of 51) if they
share a run of EXACT words, if one changed, added or missing word parts two shared runs, or if one is a rotation of the other.
So the check is by edit distance: a paragraph repeats if a run of EXACT of its words, all of it but for one edit, or a rotation of
it is in an earlier document.

1. Bands. In either case the paragraphs share STRETCH words in a row. The MinHash of such a stretch is its least RUN-word shingle,
   and a document bands the MinHash of each of its stretches, about one key for seven words. So each repeat collides
   in some band. Documents of equal words are one document here.
2. Paragraphs around colliding bands are joined on keys that hold all words but those an edit may take: runs of EXACT words for
   exact repeats; for others half of a paragraph with the END words at its far end, or what all rotations have in common.
3. Paragraphs that collide there with unlike ones are compared on the words between, by the hash of all but one of them.
   Paragraphs that miss a word are looked for at every second word, which finds any passage of 50 shared words.

All three are joins on equal keys, so costs grow with the rows, never with the pairs of a group, and no group is cut down.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, give_back, keep, mix, powers, shingles, split_by_bytes, words_of
from .exchange import FILTER_BITS, KEY_BITS, KeyFilter, exchange, key_filter, tasks_for
from .neardup import BROADCAST_IDS

SPAN, WIDTH, EXACT = 50, 5, 45
STRETCH, RUN = 25, 13
HALF, END = 25, 5
#: Words between the half and the far end. Where a word is missing there is one less; such paragraphs start at every SHORT-th word.
BETWEEN, SHORT = SPAN - HALF - END, 2
SHORTER, TURNED = 1, 2
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_KEYS, _PARAGRAPHS = ["<u8", "<i8", "<u4", "<u4"], ["<u8", "<i8", "<u4", "<u4", f"({BETWEEN},)<u4"]
_ODD = np.random.default_rng(3).integers(1, 2**63, 2 * BETWEEN + 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Mark of a key that unlike documents are known to share.
_MANY = np.uint32(2**32 - 1)
_WHOLE = 1 << 30
#: Bytes of spans that are sent to every executor; beyond, they are joined to the texts by a shuffle.
SENT_BYTES = 32 << 20


def least_positions(h: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the least hash (the last of equals) of some ``window`` consecutive ones."""
    if len(h) < window:
        return np.empty(0, np.int64)
    # hash in the upper bits, position in the lower: one minimum gives both
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    low = (h >> bits << bits) | (np.uint64(len(h)) - np.arange(1, len(h) + 1, dtype=np.uint64))
    least, size = low, 1
    while size * 2 <= window:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: len(h) - window + 1], least[window - size : window - size + len(h) - window + 1])
    at = len(h) - 1 - (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return np.unique(at)


# ---------------------------------------------------------------- documents of a batch as one array of words


class Rolling:
    """Hashes of runs of words by differences of prefix sums, modulo 2**64."""

    def __init__(self, words: np.ndarray):
        self.power, self.back = powers(len(words) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * self.power[: len(words)])))

    def plain(self, at: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.back[at]

    def __call__(self, at: np.ndarray, length: int) -> np.ndarray:
        return mix(self.plain(at, length) + np.uint64(length))

    def turned(self, at: np.ndarray, length: int) -> np.ndarray:
        """The same for a run and any rotation of it: the sum over its WIDTH-word shingles, with those across its end."""
        if not len(at):
            return np.empty(0, np.uint64)
        each = self(np.arange(len(self.sums) - WIDTH), WIDTH)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each)))
        out = total[at + length - WIDTH + 1] - total[at]
        for j in range(1, WIDTH):
            out += mix(self.plain(at + length - j, j) + self.power[j] * self.plain(at, WIDTH - j) + np.uint64(WIDTH))
        return mix(out)


def _digest(ids: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(ids.tobytes())
    return d & (2**64 - 1), (d >> 64) % (2**32 - 1)


class Batch:
    """Documents of SPAN words at least, without later copies: their words in one array, and where each starts."""

    def __init__(self, part: pa.RecordBatch):
        words, at = words_of(part.column("text"))
        keys = part.column("key").to_pylist()
        gone = part.column("tags").to_pylist() if "tags" in part.schema.names else [None] * len(keys)
        some = [(keys[k], d, k) for k in np.flatnonzero(np.diff(at) >= SPAN).tolist() for d in (_digest(words[at[k] : at[k + 1]]),) if not gone[k] or d[1] not in gone[k]]
        self.ids = np.array([k for k, _, _ in some], np.int64)
        self.digests = np.array([d for _, (d, _), _ in some], np.uint64)
        self.tags = np.array([t for _, (_, t), _ in some], np.uint32)
        rows = np.array([k for _, _, k in some], np.int64)
        sizes = np.diff(at)[rows] if len(rows) else rows
        self.start = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        self.words = np.concatenate([words[at[k] : at[k + 1]] for k in rows]) if len(rows) else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(rows)), sizes)

    def bands(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, positions) of the bands of every document."""
        h = shingles(self.words, RUN) if len(self.words) >= RUN else np.empty(0, np.uint64)
        at = least_positions(h, STRETCH - RUN + 1)
        at = at[at + RUN <= self.start[1:][self.doc[at]]] if len(at) else at
        return h[at] if len(at) else np.empty(0, np.uint64), at

    def starts(self, at: np.ndarray, span: int) -> np.ndarray:
        """Starts of the runs of ``span`` words that hold a band at ``at``."""
        if not len(at):
            return at
        doc = self.doc[at]
        lo, hi = np.maximum(self.start[doc], at + RUN - span), np.minimum(at, self.start[doc + 1] - span) + 1
        some = hi > lo
        change = np.bincount(lo[some], minlength=len(self.words) + 1) - np.bincount(hi[some], minlength=len(self.words) + 1)
        return np.flatnonzero(np.cumsum(change) > 0)


def paragraphs(batch: Batch, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, start, content hash, first word between, kind) of the paragraphs that hold a band at ``at``.

    Kinds are 0, SHORTER (a word is missing; the last bit of the content hash tells) and TURNED (the key is that of all rotations).
    """
    roll, out = Rolling(batch.words), []
    for less in (0, 1):
        s = batch.starts(at, SPAN - less)
        if less and len(s):
            s = s[(s - batch.start[batch.doc[s]]) % SHORT == 0]
        content = roll(s, SPAN - less) >> np.uint64(1) << np.uint64(1) | np.uint64(less)
        for first, half, end in ((HALF, 0, SPAN - less - END), (END, END + BETWEEN - less, 0)):
            h = mix(roll(s + half, HALF) * _ODD[0] + roll(s + end, END) * _ODD[1 if end else 2])
            out.append((h, s, content, s + first, np.full(len(s), less)))
        if not less:
            out.append((roll.turned(s, SPAN), s, content, s + END, np.full(len(s), TURNED)))
    return tuple(np.concatenate(c) for c in zip(*out))


# ---------------------------------------------------------------- groups


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, group of each row) of sorted keys."""
    fresh = np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1]))
    return np.flatnonzero(fresh), np.cumsum(fresh) - 1


def _sorted(columns: list[np.ndarray], by: tuple[int, ...]) -> list[np.ndarray]:
    """Rows by the first column of ``by``, then by the others; only rows that are equal in the first are sorted by these."""
    first = columns[by[0]]
    order = np.argsort(first)
    if len(by) > 1:
        h = first[order]
        same = np.concatenate((h[1:] == h[:-1], np.zeros(min(1, len(h)), bool)))
        same[1:] |= same[:-1]
        at, some = np.flatnonzero(same), order[same]
        order[at] = some[np.lexsort(tuple(columns[k][some] for k in reversed(by)))]
    return [c[order] for c in columns]


def _unlike(h: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, group, whether a group has unlike tags or the mark of them)."""
    start, group = _groups(h)
    least, most = (f.reduceat(tags, start) if len(start) else tags for f in (np.minimum, np.maximum))
    return start, group, (least != most) | (most == _MANY)


def _copies(columns):
    """(id, first id) of rows with equal digests, as rows of results; and the rows that are first."""
    h, ids, tag, _ = columns = _sorted(columns, (0, 2, 1))
    fresh = np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (tag[1:] != tag[:-1])))
    first = ids[np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))] if len(h) else ids
    later = ids > first
    return [np.ones(int(later.sum()), np.int64), ids[later], first[later], tag[later]], [c[fresh] for c in columns]


def _fold_bands(kind: int, columns: list[np.ndarray]):
    if kind == 1:
        known, rest = _copies(columns)
        return known, _sorted(rest, (1,))
    h, ids, tag, x = columns = _sorted(columns, (0, 1))
    again = np.concatenate((np.zeros(min(1, len(h)), bool), (h[1:] == h[:-1]) & (ids[1:] == ids[:-1]) & (tag[1:] == tag[:-1])))
    h, ids, tag, x = columns = [c[~again] for c in columns]
    start, group, many = _unlike(h, tag)
    flagged = many[group] if len(h) else np.empty(0, bool)
    known = [np.zeros(int(flagged.sum()), np.int64), ids[flagged], h[flagged].view(np.int64), tag[flagged]]
    first = [c[start].copy() for c in columns]
    first[2][many] = _MANY
    return known, _sorted(first, (1,))


def _scan_bands(kind: int, columns: list[np.ndarray]):
    if kind == 1:
        return _copies(columns)[0]
    h, ids, tag, _ = _sorted(columns, (0, 1))
    _, group, many = _unlike(h, tag)
    flagged = many[group] & (tag != _MANY) if len(h) else np.empty(0, bool)
    return [np.zeros(int(flagged.sum()), np.int64), ids[flagged], h[flagged].view(np.int64), tag[flagged]]


#: Result rows of the second exchange: EXACT words from ``s`` on that ``first`` has; or (``s`` negative) a key of unlike paragraphs.
def _repeats(columns):
    h, ids, tag, x = columns = _sorted(columns, (0, 1, 3))
    start, group = _groups(h)
    first = ids[start][group] if len(h) else ids
    later = ids > first
    s = x[later].astype(np.int64)
    return [ids[later], tag[later], s, s + EXACT, first[later]], [c[~later] for c in columns]


def _fold_runs(kind: int, columns: list[np.ndarray]):
    if kind == 0:
        known, rest = _repeats(columns)
        return known, _sorted(rest, (1, 3))
    columns = _sorted(columns, (0, 3, 1))
    h, _, _, content = columns
    fresh = np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (content[1:] != content[:-1])))
    return None, _sorted([c[fresh] for c in columns], (1,))


def _scan_runs(kind: int, columns: list[np.ndarray]):
    if kind == 0:
        return _repeats(columns)[0]
    h, ids, tag, content = _sorted(columns, (0, 3, 1))
    start, group = _groups(h)
    chosen = np.empty(0, bool)
    if len(h):
        short, none = content & 1, np.uint32(2**32 - 1)
        least, most = np.minimum.reduceat(np.where(short, none, content), start), np.maximum.reduceat(np.where(short, 0, content), start)
        unlike = (least != none) & ((least != most) | (np.maximum.reduceat(short, start) > 0))
        chosen = (unlike & (np.maximum.reduceat(ids, start) != np.minimum.reduceat(ids, start)))[group]
    h, ids, tag = h[chosen], ids[chosen], tag[chosen]
    return [ids, tag, np.full(len(h), -1), np.zeros(len(h), np.int64), h.view(np.int64)]


def _fold_between(kind: int, columns: list[np.ndarray]):
    content = mix((columns[4] * _ODD[:BETWEEN]).sum(axis=1, dtype=np.uint64) + (columns[3] & 3))
    *columns, content = _sorted([*columns, content], (0, 5, 1))
    h = columns[0]
    fresh = np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (content[1:] != content[:-1])))
    return None, _sorted([c[fresh] for c in columns], (1,))


def _least_by(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the least id among rows of equal key."""
    order = np.lexsort((ids, keys))
    start, group = _groups(keys[order])
    out = np.empty_like(ids)
    out[order] = ids[order][start][group]
    return out


def _scan_between(kind: int, columns: list[np.ndarray]):
    """Paragraphs of one key whose words between differ by one changed, added or missing word from those of a smaller id,
    or which are rotations of them."""
    h, ids, tag, x, words = columns
    short, turned, none = (x & 3) == SHORTER, (x & 3) == TURNED, np.iinfo(np.int64).max
    first, full = np.full(len(h), none), np.flatnonzero((x & 3) == 0)
    first[turned] = _least_by(h[turned], ids[turned])
    w = words.astype(np.uint64)
    whole = (w * _ODD[:BETWEEN]).sum(axis=1, dtype=np.uint64)
    for i in range(BETWEEN):
        first[full] = np.minimum(first[full], _least_by(mix(h[full] + (whole[full] - w[full, i] * _ODD[i]) * _ODD[BETWEEN + i]), ids[full]))
    if short.any():
        full = full[np.isin(h[full], h[short])]
        w = w[full]
        before = np.cumsum(w * _ODD[:BETWEEN], axis=1, dtype=np.uint64)
        after = np.cumsum((w[:, 1:] * _ODD[: BETWEEN - 1])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        zero = np.zeros((len(full), 1), np.uint64)
        less = np.concatenate((zero, before[:, :-1]), axis=1) + np.concatenate((after, zero), axis=1)
        key = lambda h, total: mix(h + total * _ODD[2 * BETWEEN])
        keys = np.concatenate((key(h[short], whole[short]), key(h[full][:, None], less).ravel()))
        row = np.concatenate((np.flatnonzero(short), np.repeat(full, BETWEEN)))
        for side in (short, ~short):
            # rows of one side against the least id of the other
            least = _least_by(keys, np.where(side[row], ids[row], none))
            np.minimum.at(first, row[~side[row]], least[~side[row]])
    hit = first < ids
    s = (x[hit] >> 2).astype(np.int64)
    return [ids[hit], tag[hit], s, s + SPAN - short[hit], first[hit]]


# ---------------------------------------------------------------- spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space after them."""
    data = text.encode("utf-8", "surrogatepass")
    starts = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    out, at = [], 0
    for s, e in spans:
        out.append(data[at : starts[s]])
        at = starts[min(e, len(starts) - 1)]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows that are not in ids (id, tag) by a column of both; the caller compares tags."""
    few = ids.count() <= BROADCAST_IDS
    gone = ids.groupBy(F.col("id").alias("gone")).agg(F.collect_set("tag").alias("tags"))
    return rows.join(F.broadcast(gone) if few else gone, rows["key"] == F.col("gone"), "left").drop("gone")


def _marked(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, object]:
    """Rows and a broadcast filter of keys (id, key); or, beyond FILTER_BITS, rows with their keys in a column and None."""
    few = keys.select("key").distinct()
    count = few.count()
    if count * KEY_BITS <= FILTER_BITS:
        return rows.withColumn("keys", F.lit(None).cast("array<bigint>")), rows.sparkSession.sparkContext.broadcast(key_filter(few, count))
    lists = keys.groupBy("id").agg(F.collect_set("key").alias("keys"))
    return rows.join(lists, rows["key"] == lists["id"]).drop("id"), None


def _has(found: KeyFilter | None, part: pa.RecordBatch, batch: Batch, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if found is not None:
        return found.has(keys)
    wanted = {k: set(v) for k, v in zip(part.column("key").to_pylist(), part.column("keys").to_pylist()) if v}
    return np.fromiter((k in wanted.get(i, ()) for i, k in zip(batch.ids[batch.doc[at]].tolist(), keys.view(np.int64).tolist())), bool, len(keys))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(id, tag, s, e, first): words s to e of a document of rows (key, text) that the earlier document ``first`` has.

    ``tag`` tells texts that share a key apart; a text that repeats as a whole has an end beyond its words.
    """
    rows = rows.where("key is not null")
    parts = tasks_for(rows)

    def bands(part: pa.RecordBatch):
        batch = Batch(part)
        h, at = batch.bands()
        yield 0, [h, batch.ids[batch.doc[at]], batch.tags[batch.doc[at]], np.zeros(len(h), np.uint32)]
        yield 1, [batch.digests, batch.ids, batch.tags, np.zeros(len(batch.ids), np.uint32)]

    banded = exchange(rows, bands, _fold_bands, _scan_bands, _KEYS, "kind bigint, id bigint, key bigint, tag bigint", parts)
    copies = banded.where("kind = 1").select("id", "tag", F.col("key").alias("first"))
    first_rows = _without(rows, copies.select("id", "tag"))
    near, sent = _marked(first_rows, banded.where("kind = 0").select("id", "key"))

    def runs(part: pa.RecordBatch):
        batch = Batch(part)
        h, at = batch.bands()
        at = at[_has(sent and sent.value, part, batch, at, h)]
        if not len(at):
            return
        s = batch.starts(at, EXACT)
        of = lambda s: (batch.ids[batch.doc[s]], batch.tags[batch.doc[s]])
        yield 0, [Rolling(batch.words)(s, EXACT), *of(s), (s - batch.start[batch.doc[s]]).astype(np.uint32)]
        h, s, content, _, _ = paragraphs(batch, at)
        yield 1, [h, *of(s), content.astype(np.uint32)]

    found = exchange(near, runs, _fold_runs, _scan_runs, _KEYS, "id bigint, tag bigint, s bigint, e bigint, first bigint", parts)
    both, chosen = _marked(first_rows, found.where("s < 0").select("id", F.col("first").alias("key")))

    def between(part: pa.RecordBatch):
        batch = Batch(part)
        at = batch.bands()[1]
        if sent:
            at = at[sent.value.has(batch.bands()[0])]
        if not len(at):
            return
        h, s, content, first, kind = paragraphs(batch, at)
        some = np.flatnonzero(_has(chosen and chosen.value, part, batch, s, h))
        if len(some):
            h, s, content, first, kind = h[some], s[some], content[some], first[some], kind[some]
            words = batch.words.astype(np.uint32)[first[:, None] + np.arange(BETWEEN)]
            words[kind == SHORTER, BETWEEN - 1] = 0
            words[kind == TURNED] = content[kind == TURNED].astype(np.uint32)[:, None]
            x = (s - batch.start[batch.doc[s]]) * 4 + kind
            yield 0, [h, batch.ids[batch.doc[s]], batch.tags[batch.doc[s]], x.astype(np.uint32), words]

    edited = exchange(both, between, _fold_between, _scan_between, _PARAGRAPHS, "id bigint, tag bigint, s bigint, e bigint, first bigint", parts)
    whole = copies.select("id", "tag", F.lit(0).cast("bigint").alias("s"), F.lit(_WHOLE).cast("bigint").alias("e"), "first")
    return found.where("s >= 0").unionByName(edited).unionByName(whole)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each document, merged by tag, as triples (tag, start, end) of 32 bits."""
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            by_tag = {}
            for x in spans:
                by_tag.setdefault(x["tag"], []).append((x["s"], x["e"]))
            out.append(np.array([(tag, a, b) for tag, found in sorted(by_tag.items()) for a, b in merged(found)], np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "spans"])


def deduplicate_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", columns: list[str] = ()) -> DataFrame:
    """Per row: key, clean (the text without passages that an earlier document has), n_words, n_removed, spans, cluster_id, others.

    Earlier means a smaller key; the smallest document of each chain of repeats keeps its passage, so a passage of a
    cluster (component of documents linked by repeats; its smallest key) always stays somewhere. Words are as for near
    duplicates, spans count words. Texts of fewer than SPAN words, empty ones and rows with a null key stay as they are; a null
    text stays null. Rows that share a key are one document, whatever their texts, and each keeps its row. Repeats within one
    document stay. Inner repeats of a paragraph count in order, as its other words do. ``others`` is a struct of ``columns`` under
    their own names, so they clash with no column of the result; it is absent if none are asked for.
    """
    others = [F.struct(*[F.col(c) for c in columns]).alias("others")] if columns else []
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), *others)
    found = keep(repeated_spans(rows.select("key", "text")))
    cluster = keep(components(found.select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()))
    spans = found.groupBy("id").agg(F.collect_list(F.struct("tag", "s", "e")).alias("spans")).mapInArrow(_packed, "id bigint, spans binary")
    spans = keep(cluster.withColumnRenamed("node", "id").join(spans, "id", "left"))
    forget(found)
    small = spans.agg(F.coalesce(F.sum(F.lit(24) + F.coalesce(F.octet_length("spans"), F.lit(0))), F.lit(0))).first()[0] <= SENT_BYTES
    placed = rows.join(F.broadcast(spans) if small else spans, rows["key"] == spans["id"], "left").drop("id")
    sent = [c for c in placed.columns if c not in ("text", "spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_by_bytes(batch):
                words, at = words_of(part.column("text"))
                clean, removed, kept_spans = [], [], []
                for k, found_spans in enumerate(part.column("spans").to_pylist()):
                    t, w, s = None, int(at[k + 1] - at[k]), []
                    if found_spans and w >= SPAN:
                        tag = _digest(words[at[k] : at[k + 1]])[1]
                        s = merged([(s, min(e, w)) for g, s, e in np.frombuffer(found_spans, np.uint32).reshape(-1, 3).tolist() if g == tag])
                    t = part.column("text")[k].as_py()
                    clean.append(cut(t, s) if s else t), removed.append(sum(b - a for a, b in s)), kept_spans.append([{"s": a, "e": b} for a, b in s])
                kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in sent), pa.array(clean, pa.string()), pa.array(np.diff(at), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_spans, kind)], [*sent, "clean", "n_words", "n_removed", "spans"])
        give_back()

    kinds = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in sent)
    out = placed.mapInArrow(run, f"{kinds}, clean string, n_words bigint, n_removed bigint, spans array<struct<s:bigint,e:bigint>>")
    return out.select(F.col("key").alias(key), "clean", "n_words", "n_removed", "spans", F.coalesce("component", "key").alias("cluster_id"), *(["others"] if columns else []))
