"""Substring dedup: words covered by a window of `width` words that also starts elsewhere go.

Documents are cut into segments: runs of consecutive windows with the same minimizer (the least
hash of their 8-word pieces). Equal windows have equal minimizers, so whatever a window could
equal has its minimizer, and a minimizer that occurs once needs no more looking at. All segments
with a common minimizer go, each different one once and with the number of its occurrences, to the
shard of their minimizer, where a compressed FM-index (Burrows-Wheeler transform in a wavelet
matrix) is built from them and they are streamed through it: backward search gives the matching
statistics, and intervals of at least `width` words that weigh two occurrences or more are
reported back to every document that has the segment.

No shard collects a hot phrase: the segments of a minimizer with more than `crowded` different
ones are taken apart into windows, which are counted by their own hash instead.

Words, windows and segments are compared by 64-bit hashes (the chance that any two of a billion
different ones meet is about 3 %, that of one given pair 5e-20).

Defined results: a null or wordless text has no words and keeps none (the hash of an empty
string); repeated rows are documents like any other, so their windows are repeats; a doc_id may
name several texts, and may be null: rows are told apart by doc_id and 64-bit text hash; texts of
any length are cut whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidmark.llm import words
from braidmark.llm.fm_index import repeated_windows
from braidmark.llm.store import discard, settle
from braidmark.llm.words import U, hash_words, mix, pieces, rolling

PIECE = 8
_SEGMENTS = "doc_id long, h long, start array<int>, nw array<int>, m array<long>, sh array<long>, self array<boolean>"


def _sums(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over word hashes."""
    if len(words._POWERS[0]) < len(hashes) + 1:
        words._POWERS = words._powers(len(hashes) + 1)
    out = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * words._POWERS[0][: len(hashes)], out=out[1:])
    return out


def _hash_of(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * words._POWERS[1][start] + (end - start).astype(U))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, size = x, 1
    while size * 2 <= width:
        have, size = np.minimum(have[: len(have) - size], have[size:]), size * 2
    return np.minimum(have[: len(x) - width + 1], have[width - size : width - size + len(x) - width + 1])


def cut_segments(hashes: np.ndarray, before: np.ndarray, width: int):
    """start, number of windows, minimizer, end of the first segment of each text, and self: two equal windows inside."""
    n = len(hashes)
    span = width - PIECE + 1
    if n < width:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, U), np.zeros(len(before), np.int64), np.empty(0, bool)
    least = _sliding_min(rolling(hashes, PIECE), span)
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    valid = text[: n - width + 1] == text[width - 1 :]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (text[1 : n - width + 1] != text[: n - width])
    starts = np.flatnonzero(first)
    stops = np.flatnonzero(valid & np.concatenate([first[1:] | ~valid[1:], [True]])) + 1
    # runs of more windows than one minimizer's place can give are cut
    counts = -(-(stops - starts) // span)
    cut = np.repeat(starts, counts) + span * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    nw = np.minimum(np.repeat(stops, counts) - cut, span)
    full = rolling(hashes, width)
    own = np.zeros(len(cut), bool)
    for d in range(1, span):
        same = np.flatnonzero(full[:-d] == full[d:]) if d < len(full) else np.empty(0, np.int64)
        if len(same):
            j = np.searchsorted(cut, same, "right") - 1
            own[j[(j >= 0) & (same + d < cut[j] + nw[j])]] = True
    return cut, nw, least[cut], np.searchsorted(cut, before), own


def _cut(doc_id: str, text: str, width: int):
    def run(batches):
        for batch in pieces(batches, text):
            ids = batch.column(batch.schema.get_field_index(doc_id))
            hashes, before, *_ = hash_words(batch.column(batch.schema.get_field_index(text)))
            sums = _sums(hashes)
            start, nw, m, at, own = cut_segments(hashes, before, width)
            sh = _hash_of(sums, start, start + nw + width - 1)
            inside = start - np.repeat(before[:-1], np.diff(at))
            at = pa.array(at.astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (inside.astype(np.int32), nw.astype(np.int32), m.view(np.int64), sh.view(np.int64), own)]
            yield pa.RecordBatch.from_arrays([ids, batch.column(batch.schema.get_field_index("h")), *lists], names=["doc_id", "h", "start", "nw", "m", "sh", "self"])

    return run


def _read_words(text: str, width: int):
    """Rows with a list of wanted segments (start, nw, m, sh, weight) to the words of each."""
    fields = [("m", pa.int64()), ("sh", pa.int64()), ("nw", pa.int32()), ("weight", pa.int32()), ("words", pa.list_(pa.int64()))]

    def run(batches):
        for batch in pieces(batches, text):
            hashes, before, *_ = hash_words(batch.column(batch.schema.get_field_index(text)))
            out = {name: [] for name, _ in fields}
            for i, wanted in enumerate(batch.column(batch.schema.get_field_index("wanted")).to_pylist()):
                for s in wanted:
                    at = int(before[i]) + s["start"]
                    for name in ("m", "sh", "nw", "weight"):
                        out[name].append(s[name])
                    out["words"].append(hashes[at : at + s["nw"] + width - 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in fields], names=[n for n, _ in fields])

    return run


def _runs(mask: np.ndarray) -> list[int]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [int(x) for s, e in zip(edge[::2], edge[1::2], strict=True) for x in (s, e - 1)]


_FOUND = pa.schema([("m", pa.int64()), ("sh", pa.int64()), ("nw", pa.int32()), ("runs", pa.list_(pa.int32()))])


def _search(width: int):
    """A shard's segments to the runs of repeated windows (first, last, first, last ...) of each."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = table.column("words").combine_chunks()
        flat = np.asarray(column.flatten())
        size = np.asarray(table.column("nw")).astype(np.int64)
        symbols, number = np.unique(flat, return_inverse=True)
        length = size + width - 1
        starts = np.concatenate([[0], np.cumsum(length + 1)[:-1]]).astype(np.int64)
        text = np.zeros(int((length + 1).sum()), np.int64)
        text[np.arange(len(flat)) + np.repeat(np.arange(len(size)), length)] = number + 1
        hit = repeated_windows(text, starts, size, width, len(symbols) + 1, np.asarray(table.column("weight")).astype(np.int64))
        runs = [_runs(hit[s : s + n]) for s, n in zip(starts.tolist(), size.tolist(), strict=True)]
        found = pa.Table.from_arrays([table.column("m"), table.column("sh"), table.column("nw"), pa.array(runs, pa.list_(pa.int32()))], schema=_FOUND)
        return found.filter(pa.array([bool(r) for r in runs], pa.bool_()))

    return run


def _apart(width: int):
    """Segments to their windows' hashes, each window once a segment and as heavy as it."""

    def run(batches):
        for batch in batches:
            m, sh, nw, weight = (batch.column(batch.schema.get_field_index(c)) for c in ("m", "sh", "nw", "weight"))
            full = [rolling(np.asarray(w.values).view(U), width).view(np.int64) for w in batch.column(batch.schema.get_field_index("words"))]
            count = np.array([len(f) for f in full], np.int64)
            at = pa.array(np.repeat(np.arange(len(full)), count))
            place = np.concatenate([np.arange(c) for c in count] or [np.empty(0)]).astype(np.int32)
            hashes = np.concatenate(full) if full else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([m.take(at), sh.take(at), nw.take(at), weight.take(at), pa.array(place), pa.array(hashes)], names=["m", "sh", "nw", "weight", "place", "window"])

    return run


def _strip(doc_id: str, text: str, width: int):
    def run(batches):
        for batch in pieces(batches, text):
            ids = batch.column(batch.schema.get_field_index(doc_id))
            hashes, before, data, starts, ends = hash_words(batch.column(batch.schema.get_field_index(text)))
            found = batch.column(batch.schema.get_field_index("found"))
            rows, raw = [], data.tobytes()
            for i in range(batch.num_rows):
                s, e = int(before[i]), int(before[i + 1])
                change = np.zeros(e - s + 1, np.int64)
                for seg in found[i].as_py() or ():
                    for a, b in zip(seg["runs"][::2], seg["runs"][1::2], strict=True):
                        change[seg["start"] + a] += 1
                        change[min(seg["start"] + b + width, e - s)] -= 1
                gone = np.cumsum(change[:-1]) > 0
                left = np.flatnonzero(~gone) + s
                kept = b" ".join([raw[x:y] for x, y in zip(starts[left].tolist(), ends[left].tolist(), strict=True)])
                spans = _runs(gone)
                rows.append((ids[i].as_py(), e - s, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode(), spans))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "removed"])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 35, crowded: int = 2000, shard_words: int = 300_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text and removed (first, last word of each removed stretch)."""
    docs = docs.select(doc_id, text, F.xxhash64(text).alias("h"))
    cut = settle(docs.mapInArrow(_cut(doc_id, text, width), _SEGMENTS), "segments")
    every = cut.select("doc_id", "h", F.inline(F.arrays_zip("start", "nw", "m", "sh", "self")))
    # what is joined back to rows is written first: a join of two tables, whose hot keys Spark can split
    met = settle(every.groupBy("m").agg(F.count(F.lit(1)).alias("c"), F.max("self").alias("own")).filter("c > 1 OR own").select("m"), "met")
    shared = settle(every.join(met, "m"), "shared")
    discard(cut, met)

    kinds = shared.groupBy("m", "sh", "nw").agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("weight"), F.min(F.struct("doc_id", "h", "start")).alias("at"))
    kinds = settle(kinds.select("m", "sh", "nw", "weight", "at.*"), "kinds")
    wanted = kinds.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "nw", "m", "sh", "weight")).alias("wanted"))
    same_row = lambda x: F.col(doc_id).eqNullSafe(F.col(f"{x}_id")) & (F.col("h") == F.col(f"{x}_h"))
    given = docs.join(wanted.withColumnsRenamed({"doc_id": "w_id", "h": "w_h"}), same_row("w")).select(text, "wanted")
    read = given.mapInArrow(_read_words(text, width), "m long, sh long, nw int, weight int, words array<long>")
    read = settle(read.dropDuplicates(["m", "sh", "nw"]), "words")

    hot = settle(kinds.groupBy("m").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > crowded).select("m"), "hot")
    easy = read.join(hot, "m", "left_anti")
    total = read.agg(F.sum(F.col("nw") + width)).first()[0] or 0
    shards = total // shard_words + 1
    found = easy.groupBy(F.pmod(F.xxhash64("m"), F.lit(shards)).alias("shard")).applyInArrow(_search(width), "m long, sh long, nw int, runs array<int>")
    windows = settle(read.join(hot, "m", "left_semi").mapInArrow(_apart(width), "m long, sh long, nw int, weight int, place int, window long"), "windows")
    twice = settle(windows.groupBy("window").agg(F.sum("weight").alias("n")).filter("n > 1").select("window"), "twice")
    single = windows.join(twice, "window").groupBy("m", "sh", "nw").agg(F.flatten(F.collect_list(F.array("place", "place"))).alias("runs"))
    again = settle(found.unionByName(single), "found")
    discard(read, hot, windows, twice, kinds)

    # repeated rows share their doc_id and hash, and so their segments
    own = shared.dropDuplicates(["doc_id", "h", "start"])
    spans = own.join(again, ["m", "sh", "nw"]).groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "runs")).alias("found"))
    full = docs.join(spans.withColumnsRenamed({"doc_id": "s_id", "h": "s_h"}), same_row("s"), "left").select(doc_id, text, "found")
    return full.mapInArrow(_strip(doc_id, text, width), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<int>")
