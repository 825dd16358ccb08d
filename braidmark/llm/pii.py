"""Personal data: exact base patterns, and more kinds found by weak supervision.

Base kinds (email, ip, card, phone) are found by fixed patterns and kept as they are. Other
candidates (secrets, national ids, account numbers, phones without a country code) come from
wide patterns; labelers of their own for form, issuer's prefix, gazetteer of the word before, words
near, density and quoting each vote for, against or not at all on each candidate. The counts of vote patterns, which are few however many documents there are,
go to an expectation-maximisation that estimates each labeler's reliability without labels.
Its posteriors train the final classifier, a logistic regression on coarse features of the span
and its neighbours, most of which no labeler votes on, over counts of feature patterns (few as well), and the classifier decides on every
candidate, which a column expression applies.

Spans are code points, end exclusive. A candidate that overlaps a base span is dropped.

Defined results: a null or empty text has no spans; of spans that start together the first kind
listed comes first; texts of any length are searched whole; repeated rows are searched row by row; extra
columns are ignored (pass through in `mask_documents`); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from braidmark.llm.words import pieces

# The base patterns and their order.
BASE = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match that fails at a run's first digit fails at its others too, so runs are taken whole
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

EXTRA = ("secret", "national_id", "account", "local_phone")
WIDE = {
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "local_phone": re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
}
CUES = {
    "secret": ("token", "secret", "key", "apikey", "password", "passwd", "pwd", "bearer", "auth", "credential"),
    "national_id": ("ssn", "social", "security", "national", "id"),
    "account": ("iban", "account", "konto", "cuenta", "compte", "bank"),
    "local_phone": ("phone", "tel", "telephone", "call", "fax", "mobile", "teléfono", "telefon", "téléphone"),
}
#: What stands before numbers and hashes that are no one's secret.
PLAIN_CUES = ("sha", "sha1", "sha256", "md5", "checksum", "commit", "digest", "version", "build", "isbn", "issn", "doi", "order", "article", "page", "figure", "table", "id")
PREFIXES = ("ghp_", "gho_", "sk-", "xoxb-", "AKIA", "AIza", "eyJ", "-----")
HEX_SIZES = (32, 40, 48, 56, 64, 96, 128)
BEFORE = re.compile(r"(\w+)[^\w\n]{0,8}$")
N_LABELERS, N_FEATURES = 6, 10


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > end and text[s - 1] in LOCAL:
            s -= 1
        if s < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", s, end))
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], BASE.index(x[0])))


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in (s.count(c) for c in set(s)))


def votes_and_features(kind: str, text: str, start: int, end: int) -> tuple[list[int], list[int]]:
    """Votes (1, -1, 0: none) of the labelers and coarse features, both few-valued."""
    s, before = text[start:end], text[max(0, start - 40) : start]
    core = s.strip("=")
    cue = m[1].lower() if (m := BEFORE.search(before)) else ""
    known = any(c in cue for c in CUES[kind]) if kind == "secret" else cue in CUES[kind]
    near = any(c in before.lower() for c in CUES[kind])
    digits, letters = sum(c.isdigit() for c in s), sum(c.isalpha() for c in s)
    hexed = len(core) in HEX_SIZES and not core.lower().strip("0123456789abcdef")
    mixed = digits >= 3 and letters >= 3
    if kind == "secret":
        shape = 1 if hexed or s.startswith(PREFIXES) else (-1 if not digits else 0)
        dense = 1 if mixed and _entropy(core[:256]) > 3.0 else -1
    elif kind == "account":
        shape, dense = (1 if _iban(s) else -1), (1 if digits >= 10 else -1)
    elif kind == "national_id":
        shape = -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
        dense = 0
    else:
        shape, dense = (1 if s[0] == "(" or "-" in s else 0), (-1 if s.count(".") == 2 else 0)
    plain = cue in PLAIN_CUES and not known
    quoted = text[start - 1 : start] in ("'", '"', "=", ":") or before.endswith((": ", "= "))
    # labelers: form, issuer's prefix, gazetteer of the word before, words near, density, quoting
    votes = [shape, 1 if s.startswith(PREFIXES) else 0, 1 if known else -1 if plain else 0, 1 if near else -1 if plain else 0, dense, 1 if quoted else 0]
    k = EXTRA.index(kind)
    # what the classifier sees besides: length, share of digits, neighbours
    features = [k == 1, k == 2, k == 3, known, plain, 3 * digits > 2 * len(s), len(s) >= 32, quoted, text[end : end + 1] in ("'", '"', ";", "\n", ""), letters > 0 and s.lower() == s]
    return votes, list(map(int, features))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple]:
    if not DIGIT.search(text):
        return []
    out = []
    for kind, pattern in WIDE.items():
        for m in pattern.finditer(text):
            if DIGIT.search(m[0]):
                out.append((kind, m.start(), m.end()))
    out.sort(key=lambda x: (x[1], EXTRA.index(x[0])))
    kept, i, end = [], 0, 0
    for kind, s, e in out:
        while i < len(base) and base[i][2] <= s:
            i += 1
        if s >= end and not (i < len(base) and base[i][1] < e):
            kept.append((kind, s, e, *votes_and_features(kind, text, s, e)))
            end = e
    return kept


_SPANS = "array<struct<start:int,place:int,kind:string,end:int>>"
_FOUND = "array<struct<kind:string,start:int,end:int,votes:array<int>,features:array<int>>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("place", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
_FOUND_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))]))


def _labelled(keep: list[str], text: str):
    def run(batches):
        for batch in pieces(batches, text):
            bases, found = [], []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                spans = base_spans(t or "")
                bases.append([{"start": s, "place": BASE.index(k), "kind": k, "end": e} for k, s, e in spans])
                found.append([dict(zip(("kind", "start", "end", "votes", "features"), c, strict=True)) for c in candidates(t or "", spans)])
            own = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(bases, _SPAN_TYPE), pa.array(found, _FOUND_TYPE)], names=[*keep, "__base", "__found"])

    return run


def reliabilities(votes: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Dawid and Skene's EM on vote patterns: each labeler's chance of -1, 0, 1 by truth, and each pattern's posterior."""
    post = np.clip(0.5 + votes.sum(1) / (2 * votes.shape[1]), 0.05, 0.95)
    table = np.empty((2, votes.shape[1], 3))
    for _ in range(rounds):
        for truth, p in ((1, post), (0, 1 - post)):
            for v in (-1, 0, 1):
                table[truth, :, v + 1] = ((votes == v) * (p * count)[:, None]).sum(0) + (2.0 if v == (1 if truth else -1) else 1.0)
        table /= table.sum(2, keepdims=True)
        prior = np.clip((post * count).sum() / count.sum(), 0.05, 0.95)
        at = np.arange(votes.shape[1])
        logit = math.log(prior / (1 - prior)) + (np.log(table[1][at, votes + 1]) - np.log(table[0][at, votes + 1])).sum(1)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return table, post


def fit_logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the bias) by Newton steps on counted feature patterns."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    weight = weight / weight.sum() * min(weight.sum(), 1000.0)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + ridge * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w


def label(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of keep, __base (base spans) and __found (candidates with votes and features)."""
    fields = StructType([docs.schema[c] for c in keep] + StructType.fromDDL(f"__base {_SPANS}, __found {_FOUND}").fields)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(_labelled(keep, text), fields)


def train(labelled: DataFrame) -> np.ndarray:
    """The span classifier's weights; the driver gets pattern counts, at most 3^6 * 2^10 rows.

    A labeler's reliability is estimated for each kind apart, as some speak of one kind only.
    """
    rows = labelled.select(F.inline("__found")).groupBy("kind", "votes", "features").count().collect()
    if not rows:
        return np.zeros(N_FEATURES + 1)
    rows.sort(key=lambda r: (r["kind"], r["votes"], r["features"]))
    votes, x = np.array([r["votes"] for r in rows]), np.array([r["features"] for r in rows])
    count = np.array([r["count"] for r in rows], float)
    kinds, post = np.array([r["kind"] for r in rows]), np.empty(len(rows))
    for kind in set(kinds):
        post[kinds == kind] = reliabilities(votes[kinds == kind], count[kinds == kind])[1]
    return fit_logistic(x, post, count)


def decided(labelled: DataFrame, weights: np.ndarray) -> DataFrame:
    """Adds __all: base spans and accepted candidates by start."""

    def accepted(c: Column) -> Column:
        score = F.lit(float(weights[-1]))
        for i in range(N_FEATURES):
            score = score + F.get(c["features"], F.lit(i)) * float(weights[i])
        return score > 0

    place = lambda c: F.array_position(F.array(*map(F.lit, EXTRA)), c["kind"]).cast("int") + 3
    extra = F.transform(F.filter("__found", accepted), lambda c: F.struct(c["start"].alias("start"), place(c).alias("place"), c["kind"].alias("kind"), c["end"].alias("end")))
    return labelled.withColumn("__all", F.array_sort(F.concat("__base", extra)))


def spelled(spans: str | Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_spans(docs: DataFrame, settle, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_<base kind>, base_sha256, spans (text form) and all_spans."""
    labelled = settle(label(docs, [doc_id], text), "labelled")
    out = decided(labelled, train(labelled))
    of = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("__base", of(k))).cast("bigint").alias(f"n_{k}") for k in BASE]
    return out.select(doc_id, *counts, F.sha2(spelled("__base"), 256).alias("base_sha256"), spelled("__all").alias("spans"), F.col("__all").alias("all_spans"))


def _masked(text: str):
    def run(batches):
        for batch in batches:
            at, out = batch.schema.get_field_index(text), []
            for t, spans in zip(batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index("__all")).to_pylist(), strict=True):
                parts, end = [], 0
                for s in spans or ():
                    if s["start"] >= end:
                        parts += [t[end : s["start"]], f"[{s['kind'].upper()}]"]
                    end = max(end, s["end"])
                out.append(None if t is None else "".join(parts) + t[end:])
            yield batch.set_column(at, text, pa.array(out, pa.string())).drop_columns(["__all"])

    return run


def mask_documents(docs: DataFrame, settle, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; all other columns as they were."""
    labelled = settle(label(docs, docs.columns, text), "labelled")
    spans = decided(labelled, train(labelled)).select(*docs.columns, "__all")
    return spans.mapInArrow(_masked(text), docs.schema)
