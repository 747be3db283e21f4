"""Byte-pair encoding by forced-boundary splitting, and decoding.

A merge can never join two bytes that stand next to each other inside no vocabulary token. Between
such a pair there is a certain cut: the fragments on either side are encoded on their own and their
ids are concatenated. White space and pre-token borders are certain cuts as well, so each distinct
fragment is merged once per task and then looked up.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catchment.llm.common import map_batches

#: Entries of each half of a look-up table, at most.
CACHE_ENTRIES = 300_000


@lru_cache(1)
def byte_letters() -> tuple[str, ...]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others follow from code point 256 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return tuple(chr(b) if b in plain else chr(next(rest)) for b in range(256))


#: The file's word pattern where all characters are lower-case ASCII, in the faster engine.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+").findall

#: The same for Latin-1: its letters, digits and spaces. NFC changes none of its characters, and lower case keeps to it.
_LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-z0-9ªµºß-öø-ÿ²³¹¼-¾]+").findall

#: Fragments up to this many bytes are merged many at a time; the few longer ones one by one.
_SHORT = 32


class Seen:
    """A bounded look-up table of two halves: what the old half still serves moves to the young one."""

    def __init__(self, entries: int):
        self.entries, self.young, self.old, self.long = entries, {}, {}, []

    def serve(self, words: set[str], make: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """A table that has all of ``words``; those in neither half are made. ``forget`` the long ones afterwards."""
        if len(self.young) >= self.entries:
            self.old, self.young = self.young, {}
        new = words.difference(self.young)
        known = {w: ids for w in new if (ids := self.old.get(w)) is not None}
        self.young.update(known)
        if todo := list(new.difference(known)):
            self.young.update(zip(todo, make(todo)))
            self.long = [w for w in todo if len(w) > 64]
        return self.young

    def forget(self) -> None:
        """Long words aren't kept for the next texts."""
        for w in self.long:
            del self.young[w]
        self.long = []


#: The pre-token pattern and the normaliser that a file must have.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def check_file(spec: dict) -> None:
    """Raises ValueError for a tokenizer file that asks for anything that the encoder doesn't do."""
    model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    normalizers = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers") or []]
    ids = [*model.get("vocab", {}).values(), *(t["id"] for t in spec.get("added_tokens", []))]
    faults = {
        "a model that is not BPE": model.get("type") != "BPE",
        "options of the model": any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")),
        "no end of word": not model.get("end_of_word_suffix"),
        "another normaliser": normalizers != _NORMALIZERS or spec["normalizer"]["normalizers"][1].get("pattern") != {"Regex": r"\s+"},
        "other pre-tokens": [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[0]["pattern"] != {"Regex": _PATTERN} or steps[1].get("use_regex") or steps[1].get("add_prefix_space"),
        "a decoder or post-processor": bool(spec.get("decoder") or spec.get("post_processor")),
        "added tokens that strip or normalise": any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")),
        "ids over 16 bits": max(ids, default=0) >= 1 << 16,
    }
    found = [name for name, wrong in faults.items() if wrong]
    if found:
        raise ValueError("the tokenizer file has " + ", ".join(found))


class ForcedBoundaryBPE:
    """Encoder and decoder for a byte-level BPE file with word ends (``tokenizers`` JSON).

    Files that ask for another normaliser, pattern or decoder, or for ids over 16 bits, are rejected.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_file(spec)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.marks = tuple({s[:2] for s in self.special})
        self.seen = Seen(CACHE_ENTRIES)

        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(self.vocab[x], self.vocab[y]): k for k, (x, y) in enumerate(pairs)}
        self.none = len(pairs)
        self.made = np.array([self.vocab[x + y] for x, y in pairs] + [0], np.int32)
        keys = np.array([x << 32 | y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_of = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, self.none).astype(np.int32)
        # A fragment's first symbols: its bytes, the last of a word with the end mark.
        letters = byte_letters()
        self.base = np.array([self.vocab[c] for c in letters] + [self.vocab[c + self.end] for c in letters], np.int32)
        # Pairs of bytes that some token holds side by side; any other pair is a forced boundary.
        code = {c: b for b, c in enumerate(letters)}
        self.inside = np.zeros((256, 256), bool)
        for token in self.vocab:
            spelt = [code[c] for c in token.removesuffix(self.end)]
            self.inside[spelt[:-1], spelt[1:]] = True

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of token ids; ``none`` where no merge joins it."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.rank_of[at], np.int32(self.none))

    def merged_one(self, symbols: list[int]) -> list[int]:
        """Ids of one fragment: merges by rank, lowest first and leftmost first."""
        parts, rank, none = list(symbols), self.merges.get, self.none
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            parts[k : k + 2] = [int(self.made[best])]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((parts[k - 1], parts[k]), none)
            if k < len(ranks):
                ranks[k] = rank((parts[k], parts[k + 1]), none)
        return parts

    def merged_many(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for fragments of one length, a row each: ids, and how many of a row count."""
        n, width = symbols.shape
        out, lengths = symbols.copy(), np.full(n, width)
        rows, parts = np.arange(n), symbols
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        left = width
        while left > 1 and len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            live = best < self.none
            if not live.all():
                out[rows[~live], :left], lengths[rows[~live]] = parts[~live], left
                rows, parts, ranks, at, best = rows[live], parts[live], ranks[live], at[live], best[live]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            parts[every, at] = self.made[best]
            keep = np.arange(left - 1) + (np.arange(left - 1) > at[:, None])
            parts = np.take_along_axis(parts, keep, 1)
            left -= 1
            if left > 1:
                keep = np.arange(left - 1) + (np.arange(left - 1) >= at[:, None])
                ranks = np.take_along_axis(ranks, keep, 1)
                for k, has in ((at - 1, at > 0), (at, at < left - 1)):
                    r, k = every[has], k[has]
                    ranks[r, k] = self.ranks(parts[r, k], parts[r, k + 1])
        out[rows, :left], lengths[rows] = parts, left
        return out, lengths

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens: cut at forced boundaries, merged fragment by fragment, concatenated."""
        spelt = [w.encode() for w in words]
        sizes = np.array([len(x) for x in spelt])
        ends = np.cumsum(sizes)
        letters = np.frombuffer(b"".join(spelt), np.uint8)
        cut = np.ones(len(letters) + 1, bool)
        cut[1:-1] = ~self.inside[letters[:-1], letters[1:]]
        cut[ends] = True
        borders = np.flatnonzero(cut)
        starts, lengths = borders[:-1], np.diff(borders)
        symbols = letters.astype(np.int32)
        symbols[ends - 1] += 256
        symbols = self.base[symbols]
        ids, counts = symbols.copy(), np.ones(len(starts), np.int64)
        for width in np.unique(lengths):
            own = np.flatnonzero(lengths == width)
            if width == 1:
                continue
            places = starts[own][:, None] + np.arange(width)
            if width <= _SHORT:
                ids[places], counts[own] = self.merged_many(symbols[places])
            else:
                for k, row in zip(own, places):
                    got = self.merged_one(symbols[row].tolist())
                    ids[row[: len(got)]], counts[k] = got, len(got)
        # A fragment's ids lie at its first places; the rest of its places go.
        offset = np.arange(len(letters)) - np.repeat(starts, lengths)
        filled = offset < np.repeat(counts, lengths)
        flat = ids[filled].astype("<u2").tobytes()
        stops = np.cumsum(filled)[ends - 1] * 2
        return [flat[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII_WORDS(text.lower())
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-cased letter by letter: no final sigma
            return self.words.findall(text.lower())
        return _LATIN_WORDS(text.lower())

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (uint16) of each whole text; null and empty texts have none."""
        plan, words = [], set()
        for text in texts:
            if text and any([m in text for m in self.marks]):
                plan.append([np.asarray([self.special[p]], "<u2").tobytes() if p in self.special else self._words(p) for p in self.specials.split(text)])
            else:
                plan.append([self._words(text)] if text else [])
            for part in plan[-1]:
                if isinstance(part, list):
                    words.update(part)
        ids = self.seen.serve(words, self.merge_words).__getitem__
        out = [np.frombuffer(b"".join([x if isinstance(x, bytes) else b"".join(map(ids, x)) for x in parts]), "<u2") for parts in plan]
        self.seen.forget()
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    @property
    def decimals(self) -> list[bytes]:
        if not hasattr(self, "_decimals"):
            self._decimals = [b"%d" % k for k in range(1 << 16)]
        return self._decimals

    @property
    def spelled(self) -> list[bytes]:
        """Each id's token as UTF-8; ids without a token are empty."""
        if not hasattr(self, "_spelled"):
            self._spelled = [self.names.get(k, "").encode() for k in range(max(self.names) + 1)]
        return self._spelled

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens with one space between, as the file (which names no decoder) asks for; UTF-8."""
        return b" ".join(map(self.spelled.__getitem__, ids.tolist()))

    def text_of(self, ids: np.ndarray) -> str:
        """Readable text: word ends become spaces, byte letters become bytes."""
        code = {c: b for b, c in enumerate(byte_letters())}
        words = "".join(self.names[int(i)] for i in ids).split(self.end)
        return " ".join(bytes(code[c] for c in w).decode("utf-8", "replace") for w in words).rstrip()


@lru_cache(2)
def tokenizer(path: str) -> ForcedBoundaryBPE:
    """The encoder of a file; one for each Python worker, so its tables serve many tasks."""
    return ForcedBoundaryBPE(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``token_ids`` (array of int), ``n_tokens`` and ``decoded`` to ``docs``.

    Null and empty texts give an empty array, 0 and "". Columns of those names in ``docs`` are
    replaced; all others are kept. Repeated rows are kept.
    """
    docs = docs.drop("token_ids", "n_tokens", "decoded")
    kept = [c for c in docs.columns]
    schema = T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])

    def make():
        bpe = tokenizer(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = bpe.encode_all(batch.column(batch.schema.names.index(text)).to_pylist())
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            new = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(np.diff(offsets).astype(np.int64)), pa.array([bpe.decode(x).decode() for x in ids])]
            return pa.RecordBatch.from_arrays([*batch.columns, *new], [*kept, "token_ids", "n_tokens", "decoded"])

        return work

    return map_batches(docs, make, schema)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document's whole text.

    The ids are encoded, decoded again, and both are digested inside the task, so that neither ids
    nor decoded texts leave it. A null or empty text has no ids; its digests are those of "".
    """

    def make():
        bpe = tokenizer(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, a, b = [], [], []
            for ids in bpe.encode_all(batch.column(1).to_pylist()):
                n.append(len(ids))
                a.append(hashlib.sha256(b" ".join(map(bpe.decimals.__getitem__, ids.tolist()))).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(narrow, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
