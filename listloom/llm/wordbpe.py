"""BPE encoding and decoding with forced boundaries: what no vocabulary token spans is cut, and the pieces are encoded alone.

The vocabulary file is one of the tokenizers library: its normaliser, pre-tokenizer and merges are used as they are. A pair
of adjacent bytes that occurs inside no token can never be merged over, so it marks a certain cut:

- white space is inside no token, so a raw text is cut around it (see `Vocabulary`) and each distinct stretch is normalised
  and split into words once while it is in a task's memory;
- inside a word the table of pairs that occur in some token gives the cuts; each fragment is encoded alone, only the last
  with the end-of-word mark, and the ids are joined.

A word's merges on both sides of a cut never meet, so the joined ids are those of the whole word, however long it is.

Null texts count as empty and give no ids. Rows keep their own ids, so ties and repeated rows need no rule; an empty table
gives an empty table. Other columns pass through or play no part; those with the name of a result are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import ChainMap
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .bpe import _lists, _with
from .frames import small_batches, table

#: Rows in one step of a task, characters of texts that are encoded together, and ids that are turned into text in one.
ROWS, GROUP, PIECE = 2048, 1 << 22, 1 << 16
#: Stretches, words and fragments that a task remembers (each), and the longest that it does: memory, never results.
KEPT, SHORT = 1 << 19, 48
_STRETCH = re.compile(r"[^ \t-\r]+")
_BLANK = re.compile(r"[ \t-\r]")
#: Letters below this one compose with nothing before them and have not changed their kind since Unicode 5.
_SETTLED = 0x250
_LOADED: dict[str, Vocabulary] = {}


class Vocabulary:
    """A vocabulary file with its pairs; read once in each worker.

    Raw texts are cut at ASCII white space. That is safe where the pre-tokenizer drops white space, no token holds any next
    to another character, and the normaliser looks at most at a stretch of composing characters: a blank starts a new one.
    Files that keep white space, or added tokens that take it in, are refused.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        model, self.own = spec["model"], Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.normalise = self.own.normalizer.normalize_str if self.own.normalizer else str
        self.split = self.own.pre_tokenizer.pre_tokenize_str
        added = [x for x in spec["added_tokens"] if x["content"]]
        keeps_blanks = [w for w, _ in self.split(self.normalise("a b\tc"))] != ["a", "b", "c"]
        odd = any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] or _STRETCH.fullmatch(x["content"]) is None for x in added)
        if model["type"] != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix") or keeps_blanks or odd:
            raise ValueError(f"{path}: only BPE over bytes that drops white space and has plain added tokens is cut here")
        self.added = {x["content"]: x["id"] for x in added}
        self.special = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")") if added else None
        end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)
        self.last = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=end) if end else self.inner
        # Whether two bytes stand side by side in some token; a byte is a letter below 512 there.
        self.spans = np.zeros((512, 512), bool)
        for token in model["vocab"]:
            letters = [min(ord(x), 511) for x in (token.removesuffix(end) if end else token)]
            self.spans[letters[:-1], letters[1:]] = True
        self.names = [self.own.id_to_token(k) or "" for k in range(max([*model["vocab"].values(), *self.added.values()]) + 1)]
        self.numbers = list(range(len(self.names)))  # one object an id, whatever remembers it
        self.named = np.array([bool(x) for x in self.names])
        self.settled = self._settled(spec["pre_tokenizer"])
        self.stretches: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}

    def _settled(self, spec: dict) -> tuple | None:
        """For stretches of settled letters: a test for them, the normal form of each, the pattern of words, and the letters
        that stand for their bytes; None where the file splits in another way than by one pattern of what is kept."""
        import regex

        steps = spec.get("pretokenizers", [])
        kinds = [x["type"] for x in steps]
        if kinds != ["Split", "ByteLevel"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or "Regex" not in steps[0]["pattern"]:
            return None
        lower = {c: self.normalise(chr(c)) for c in range(1, _SETTLED) if not _BLANK.match(chr(c))}
        lower = {c: x for c, x in lower.items() if len(x) == 1 and 0 < ord(x) < _SETTLED and not x.isspace()}
        from tokenizers.pre_tokenizers import ByteLevel

        bytes_ = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = {ord(x): bytes_.pre_tokenize_str(x)[0][0] for x in set(lower.values())}
        return re.compile("[" + re.escape("".join(map(chr, lower))) + "]+").fullmatch, lower, regex.compile(steps[0]["pattern"]["Regex"]).findall, letters

    def _words(self, raw: str) -> list[str | int]:
        """The words of a stretch without ASCII white space, letters standing for their bytes; ids of added tokens."""
        if self.special is not None and self.special.search(raw):
            return [y for part in self.special.split(raw) if part for y in ([self.added[part]] if part in self.added else self._words(part))]
        if self.settled is not None and self.settled[0](raw):
            _, lower, found, letters = self.settled
            low = raw.lower() if raw.isascii() else raw.translate(lower)
            return found(low) if low.isascii() and low.isprintable() else [w.translate(letters) for w in found(low)]
        return [w for w, _ in self.split(self.normalise(raw))]

    def cuts(self, letters: str) -> np.ndarray:
        """Where a new fragment begins: between two bytes that no token has side by side."""
        codes = np.minimum(np.frombuffer(letters.encode("utf-32-le"), np.uint32), 511)
        return np.flatnonzero(~self.spans[codes[:-1], codes[1:]]) + 1

    def _encoded(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of different words: all are cut in one step (a blank between two is no token's, so it cuts too)."""
        whole, out = " ".join(words), {}
        at = [0, *self.cuts(whole).tolist(), len(whole)]
        pieces = iter([whole[a:b] for a, b in zip(at, at[1:], strict=False)])
        for word in words:
            piece = next(pieces)
            if piece == " ":
                piece = next(pieces)
            if len(piece) == len(word):
                out[word] = self._fragment(piece, True)
                continue
            found, size = [], len(piece)
            found += self._fragment(piece, False)
            while size < len(word):
                piece = next(pieces)
                size += len(piece)
                found += self._fragment(piece, size == len(word))
            out[word] = tuple(found)
        return out

    def _fragment(self, text: str, last: bool) -> tuple[int, ...]:
        found = self.fragments.get((text, last))
        if found is None:
            found = tuple([self.numbers[t.id] for t in (self.last if last else self.inner).tokenize(text)])
            if len(text) <= SHORT:
                self.fragments[text, last] = found
        return found

    def _ids(self, stretches: list[str]) -> list[tuple[int, ...]]:
        """The ids of different stretches; those of short ones are remembered."""
        for memory in (self.stretches, self.words, self.fragments):
            if len(memory) > KEPT:
                memory.clear()
        split = {raw: self._words(raw) for raw in stretches if raw not in self.stretches}
        new = self._encoded(list({w for ws in split.values() for w in ws if isinstance(w, str) and w not in self.words}))
        for w in list(new):
            if len(w) <= SHORT:
                self.words[w] = new[w]
        of = ChainMap(self.words, new) if any(len(w) > SHORT for w in new) else self.words
        long = {}
        for raw, ws in split.items():
            ids = of[ws[0]] if len(ws) == 1 and isinstance(ws[0], str) else tuple([i for w in ws for i in (of[w] if isinstance(w, str) else (w,))])
            (self.stretches if len(raw) <= SHORT else long)[raw] = ids
        return [long[raw] if raw in long else self.stretches[raw] for raw in stretches] if long else list(map(self.stretches.__getitem__, stretches))

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text. Texts are taken together up to GROUP characters, longer ones in pieces cut at a blank."""
        group: list[tuple[int, str]] = []
        size, nth, parts = 0, -1, []

        def flush(whole: int) -> Iterator[np.ndarray]:
            """Encodes the group; gives out the texts below `whole`, what there is of a later one stays."""
            for (k, _), ids in zip(group, self._group([p for _, p in group]), strict=True):
                while parts and parts[0][0] < k:
                    yield _merged(parts)
                if parts:
                    parts[0][1].append(ids)
                else:
                    parts.append((k, [ids]))
            group.clear()
            if parts and parts[0][0] < whole:
                yield _merged(parts)

        for text in texts:
            nth += 1
            for piece in _pieces(text):
                group.append((nth, piece))
                size += len(piece)
                if size >= GROUP:
                    yield from flush(nth)
                    size = 0
        yield from flush(nth + 1)

    def _group(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of pieces: each different stretch in them is encoded once, then ids are gathered by its number."""
        if not pieces:
            return []
        split = pc.split_pattern_regex(pa.array(pieces, pa.large_string()), "[ \\t-\\r]+")
        coded = split.values.dictionary_encode()
        each = self._ids(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter(chain.from_iterable(each), np.int32, int(size.sum()))
        of = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(size[of])
        begins = ends - size[of]
        ids = flat[np.repeat((np.cumsum(size) - size)[of] - begins, size[of]) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> Iterator[str]:
        """The text of the ids in pieces; special tokens are kept and unknown ids dropped."""
        if self.own.decoder is not None:
            yield self.own.decode(ids.tolist(), skip_special_tokens=False)
            return
        ids = ids[(ids >= 0) & (ids < len(self.names))]
        yield from _joined(ids[self.named[ids]], self.names)


def _merged(parts: list) -> np.ndarray:
    _, found = parts.pop(0)
    return found[0] if len(found) == 1 else np.concatenate(found)


def _joined(ids: np.ndarray, names: list[str]) -> Iterator[str]:
    """The names of ids with a blank between two, in pieces."""
    for at in range(0, len(ids), PIECE):
        yield (" " if at else "") + " ".join([names[i] for i in ids[at : at + PIECE].tolist()])


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > GROUP and (blank := _BLANK.search(text, at + GROUP)):
        yield text[at : blank.start()]
        at = blank.start()
    yield text[at:] if at else text


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _texts(column: pa.Array) -> Iterator[str]:
    return (t.as_py() or "" for t in column)


def _default(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return path


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """docs with a column `ids` of token ids at the end, without special tokens around them."""
    path, at, rest = _default(path), docs.columns.index(text), [c for c in docs.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in small_batches(batches, ROWS):
            yield batch.select(rest).append_column(ids, _lists(list(own.encode(_texts(batch.column(at))))))

    return docs.mapInArrow(run, _with(docs.select(rest).schema, ids, ArrayType(IntegerType())))


def decode(docs: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """docs with a column `text` at the end, what the ids stand for; null ids give null."""
    path, at, rest = _default(path), docs.columns.index(ids), [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in small_batches(batches, ROWS):
            found = ["".join(own.decode(x.values.to_numpy())) if x.is_valid else None for x in batch.column(at)]
            yield batch.select(rest).append_column(text, pa.array(found, pa.string()))

    return docs.mapInArrow(run, _with(docs.select(rest).schema, text, StringType()))


def round_trip(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of what they decode to, in one pass over the texts."""
    path = _default(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        numbers = list(map(str, own.numbers))
        for batch in small_batches(batches, ROWS):
            counts, shas, backs = [], [], []
            for ids in own.encode(_texts(batch.column(1))):
                sha, back = hashlib.sha256(), hashlib.sha256()
                for piece in _joined(ids, numbers):
                    sha.update(piece.encode())
                for piece in own.decode(ids):
                    back.update(piece.encode())
                counts.append(len(ids))
                shas.append(sha.hexdigest())
                backs.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
