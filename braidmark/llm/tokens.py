"""Token counts with a whole-token shortcut.

The tokenizer file names its pieces with an end-of-word mark. Before any text is read, every
such piece is encoded alone: the pieces that come out as one token are proven, and a pre-token
that spells one counts 1 without merging. Proof and merging are the same for all texts, so the
table is made once per worker. All other pre-tokens are merged once each and cached.

Texts are normalised and cut as the tokenizer file says: special strings are taken out of the
raw text first (each counts one), the rest is composed (NFC), white space becomes single
spaces, letters are lower-cased, and a pattern finds the pre-tokens. Case and composition are
the tokenizer library's own normaliser, so that its Unicode version decides.

Defined results: a null or empty text has no tokens; repeated rows are counted row by row; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from braidmark.llm.store import bound_batches
from braidmark.llm.words import pieces


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Counter(dict):
    """pre-token -> number of tokens: proven ones at the start, merged ones as they come."""

    def __init__(self, path: str, most_cached: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.order = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.letters = _byte_letters()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.normal = Tokenizer.from_file(path).normalizer.normalize_str
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.most = most_cached
        bytes_of = {c: b for b, c in enumerate(self.letters)}
        for piece in model["vocab"]:
            if not piece.endswith(self.end) or piece in special:
                continue
            try:
                spelled = bytes(bytes_of[c] for c in piece[: len(piece) - len(self.end)]).decode()
            except (KeyError, UnicodeDecodeError):
                continue  # not a whole text of its own
            if spelled and self.merged(spelled) == 1:
                self[spelled] = 1
        self.proven = dict(self)

    def merged(self, pre_token: str) -> int:
        """Merges pairs, the earliest rule first and the leftmost of equals."""
        parts = [self.letters[b] for b in pre_token.encode()]
        parts[-1] += self.end
        if len(parts) > 64:
            return self._merged_long(parts)
        order, none = self.order.get, len(self.order)
        ranks = [order(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = order((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = order((parts[i - 1], parts[i]), none)
        return len(parts)

    def _merged_long(self, parts: list[str]) -> int:
        """The same by a heap of pairs, for pre-tokens of any length."""
        import heapq

        n, order = len(parts), self.order.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := order((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if parts[i] != x or j >= n or parts[j] != y:
                continue
            parts[i], parts[j] = x + y, ""
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := order((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := order((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return left

    def __missing__(self, pre_token: str) -> int:
        n = self.merged(pre_token)
        if len(pre_token) <= 256:
            self[pre_token] = n
        return n

    def count(self, text: str) -> int:
        if len(self) > self.most:
            self.clear()
            self.update(self.proven)
        if "<|" not in text:
            # an ASCII text is composed already, and white space is dropped in any case
            return sum(map(self.__getitem__, self.find(text.lower() if text.isascii() else self.normal(text))))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.find(self.normal(p)))) for p in parts if p)


@lru_cache(2)
def load_counter(path: str) -> Counter:
    return Counter(path)


def _counted(path: str, doc_id: str, text: str):
    def run(batches):
        counter = load_counter(path)
        for batch in pieces(batches, text):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            n = pa.array(map(counter.count, texts), pa.int64())
            size = pa.array((len(t.encode()) for t in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(doc_id)), size, n], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    bound_batches(docs.sparkSession)
    counted = docs.select(doc_id, text).mapInArrow(_counted(path, doc_id, text), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", counted.n_tokens > limit)
